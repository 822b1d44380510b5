"""All families over one trace: what is read and looked up once, and scans of many short keys."""

import datetime

import pytest
from pyspark.sql import functions as F

from tests.util import make, rows
from tracelake.operators import asof
from tracelake.operators.carry import fill, short_keys
from tracelake.plans import families, network
from workload import views
from workload.views import Trace, kernel, kernel_once


def test_families_read_the_source_once(spark, sf_dir):
    context = Trace(spark, sf_dir).parsed_once().context()
    for cls in ("cswitch", "isr", "dpc", "disk_read", "tcp_send", "registry_op", "hard_fault", "thread_start", "process_end"):
        assert not any("events.parquet" in f for f in context.events(cls).inputFiles()), cls


def test_rows_parsed_once_are_the_same(spark):
    at = datetime.datetime(2024, 1, 2)
    data = [
        (1, at, 5, "click", 1.005, '{"k": 7}'), (2, at, None, "view", None, "{}"), (3, None, 6, "purchase", 2.5, None), (4, at, 7, "signup", 0.0, '{"k": null}'),
        (5, at, 8, "error", -1.25, '{"k": 3}'), (5, at, 8, "error", -1.25, '{"k": 3}'), (6, at, 9, "view", 1e15, '{"k": "12"}'), (7, at, 9, "click", 3.0, "no json"),
    ]
    events = spark.createDataFrame(data, "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string")
    assert rows(kernel_once(events)) == rows(kernel(events))
    # What no number can be read from fails only the plans that look at it.
    odd = spark.createDataFrame([(1, at, 5, "click", float("nan"), '{"k": "x"}')], events.schema)
    assert rows(kernel_once(odd), "seq", "tid") == rows(kernel(odd), "seq", "tid") == [(1, 5)]
    assert kernel_once(events.filter("event_id < 0")).count() == 0


def test_network_family_looks_up_owners_once(spark, sf_dir, monkeypatch):
    calls = []

    def counted(facts, processes, **options):
        calls.append(1)
        return real(facts, processes, **options)

    real = network.attribute_by_pid
    monkeypatch.setattr(network, "attribute_by_pid", counted)
    t = Trace(spark, sf_dir)
    context = t.context(by_protocol=True, connection_stats=True, retransmissions=True)
    got = families.samples(context, ["network"])
    assert len(calls) == 1
    sums = {r[0]: r[1] for r in got.groupBy("metric").agg(F.sum("value")).collect()}
    p = t.processes
    moved = network.network_bytes(t.network, p, **t.options).agg(F.sum("sent_bytes"), F.sum("received_bytes")).first()
    assert (sums["network_process_sent_bytes_total"], sums["network_process_received_bytes_total"]) == tuple(moved)
    made = network.connections(t.network, p, **t.options).agg(F.sum("attempted"), F.sum("accepted")).first()
    assert (sums["network_process_connections_attempted_total"], sums["network_process_connections_accepted_total"]) == tuple(made)
    assert sums["network_process_retransmissions_total"] == network.retransmissions(t.network, p, **t.options).agg(F.sum("value")).first()[0]


def test_classes_in_one_table_are_scanned_once(spark, sf_dir):
    plan = Trace(spark, sf_dir).context().events(*network.CLASSES)._jdf.queryExecution().optimizedPlan().toString()
    assert "Union" not in plan
    context = views.Trace(spark, sf_dir).context()
    apart = families.Context(typed=context.typed)
    for classes in (("disk_read", "disk_flush"), ("tcp_send", "udp_fail", "cswitch")):
        columns = ["cls", "seq", "ts_ns"]
        assert rows(context.events(*classes), *columns) == rows(apart.events(*classes), *columns)


EPOCHS = "tid bigint, seq bigint, valid_from bigint, valid_to bigint, start_key bigint"


@pytest.fixture
def epochs_and_facts(spark):
    epochs = make(spark, EPOCHS, *[(t, 10 * t + i, 100 * i, 100 * i + 70, 1000 * t + i) for t in range(5) for i in range(4)], (None, 99, 0, 1000, 7))
    facts = make(spark, "tid bigint, ts_ns bigint, seq bigint", *[(t, s, n) for t in (0, 1, 4, 9, None) for n, s in enumerate((-1, 0, 69, 70, 205, 399, None))])
    return epochs, facts


def test_short_keys_are_scanned_without_chunks(epochs_and_facts, monkeypatch):
    epochs, facts = epochs_and_facts
    want = rows(asof.asof_join(facts, epochs, ["host", "tid"], ["start_key"], strategy="scan", chunk_ns=50))
    monkeypatch.setattr(asof, "BROADCAST_BYTES", 0)
    cut, real = [], asof._carried
    monkeypatch.setattr(asof, "_carried", lambda *args: cut.append(1) or real(*args))
    assert rows(asof.asof_join(facts, epochs, ["host", "tid"], ["start_key"], chunk_ns=50)) == want
    assert not cut
    # A busy key is cut into chunks as before.
    monkeypatch.setattr("tracelake.operators.carry.KEY_ROWS", 3)
    assert rows(asof.asof_join(facts, epochs, ["host", "tid"], ["start_key"], chunk_ns=50)) == want
    assert cut


def test_fill_without_chunks(spark):
    df = make(spark, "tid bigint, ts_ns bigint, seq bigint, v bigint", (1, 5, 1, 10), (1, 250, 2, None), (1, None, 3, 30), (2, 7, 4, None), (2, 900, 5, 50), (None, 1, 6, 60), (None, 2, 7, None))
    for backward in (False, True):
        got = [rows(fill(df, ["host", "tid"], ["ts_ns", "seq"], {"out": F.col("v")}, backward=backward, chunk_ns=c)) for c in (100, None)]
        assert got[0] == got[1]
    assert short_keys(["host", "tid"], df)
