"""Scrapes, registered families and silent hosts on streams: slices by hand, replays, timers without input."""

import time

import pytest
from pyspark.sql import functions as F

from tests.util import S, rows
from tracelake.operators.asof import OPEN_END
from tracelake.plans import families
from tracelake.plans.families import Context, register_family, samples
from tracelake.plans.rollup import LABELS, rollup_programs
from tracelake.sources.events import wide_events
from tracelake.sources.samples import to_samples
from tracelake.streaming import stateful
from tracelake.streaming.runner import StreamOptions, process_slice
from tracelake.streaming.scraping import ScrapeOptions
from tracelake.streaming.totals import compact, stream_cleaned, stream_samples, stream_snapshots

FIELDS = "cls string, ts_ns long, seq long, pid long, start_key long, process_name string, session_id long, size long"


def wide(spark, *values):
    """Rows (cls, seconds, pid, start_key, name) of host h, in the order of ``seq``."""
    full = [("h", cls, int(at * S), i, pid, key, name, 0, 1) for i, (cls, at, pid, key, name) in enumerate(values)]
    return wide_events(spark.createDataFrame(full, f"host string, {FIELDS}"))


def sends(s):
    from tracelake.operators.attribute import attribute_by_pid, known_only

    facts = s.of("tcp_send").select("host", "seq", "ts_ns", "pid", "size")
    return known_only(attribute_by_pid(facts, s.processes)).select("host", "start_key", "ts_ns", F.col("size").alias("value"))


@pytest.fixture(scope="module")
def slices(spark):
    first = wide(spark, ("process_start", 1, 10, 7, "a.exe"), ("tcp_send", 2, 10, None, None), ("scrape", 3, None, None, None), ("tcp_send", 4, 10, None, None), ("scrape", 5, None, None, None))
    second = wide(spark, ("tcp_send", 6, 10, None, None), ("process_end", 7, 10, None, None), ("process_start", 8, 11, 8, "b.exe"), ("tcp_send", 9, 11, None, None), ("scrape", 10, None, None, None))
    third = wide(spark, ("scrape", 50, None, None, None), ("tcp_send", 51, 11, None, None), ("scrape", 60, None, None, None), ("scrape", 200, None, None, None))
    return [first, second, third]


def run(slices, root, options, replay=()):
    for i, batch in enumerate(slices):
        for _ in range(2 if i in replay else 1):
            process_slice(batch, i, f"{root}/carry", f"{root}/out", options)
    process_slice(slices[0].limit(0), len(slices), f"{root}/carry", f"{root}/out", options, final=True)
    return f"{root}/out"


def test_counts_leave_once(spark, slices, tmp_path):
    """The first instance expires at 37 s: its three counts are gone from the scrape at 50 s on, also if that batch runs twice."""
    options = StreamOptions(families=["process"], delay_ns=0, scrapes=ScrapeOptions(snapshots={"sent": ([], sends)}))
    out = run(slices, str(tmp_path), options, replay=(1,))
    got = stream_snapshots(spark, out, "sent", [], every_scrape=True)
    assert rows(got, "scrape_id", "value") == [(1, 1), (2, 2), (3, 4), (4, 1), (5, 2), (6, 2)]
    # Generations: the end at 7 s comes after two scrapes; the gap before the scrape at 200 s exceeds twice the grace.
    ended = rows(stream_cleaned(spark, out), "start_key", "generation", "cleaned_scrape")
    assert ended == [(7, 2, 6), (8, None, None)]


def test_idle_rows_clean_up(spark, tmp_path):
    """A host that falls silent after its process has ended: only the failsafe's rows come, and they clean it."""
    options = StreamOptions(families=["process"], delay_ns=5 * S, scrapes=ScrapeOptions())
    before = wide(spark, ("scrape", 1, None, None, None), ("process_start", 2, 10, 7, "a.exe"), ("process_end", 3, 10, None, None))
    process_slice(before, 0, f"{tmp_path}/carry", f"{tmp_path}/out", options)
    limit = 3 * 3600
    process_slice(wide(spark, ("idle", 3 + limit, None, None, None)), 1, f"{tmp_path}/carry", f"{tmp_path}/out", options)
    assert rows(stream_cleaned(spark, f"{tmp_path}/out"), "start_key", "cleaned_scrape", "cleaned_ns") == [(7, 2, (3 + limit) * S)]


def test_silent_hosts_fire_without_input(spark, tmp_path):
    """Timers of the state store make a row for every limit of silence, though nothing arrives any more."""
    stateful.use_state_store(spark)
    wide(spark, ("scrape", 1, None, None, None), ("scrape", 4, None, None, None)).write.parquet(f"{tmp_path}/in")
    events = stateful.read_stream(spark, f"{tmp_path}/in", wide(spark, ("scrape", 1, None, None, None)).schema)
    silent = stateful.silent_hosts(events, limit_ns=S)
    query = stateful.write_stream(silent, f"{tmp_path}/ck", f"{tmp_path}/out", {"processingTime": "200 milliseconds"})
    try:
        until = time.time() + 120
        while time.time() < until:
            got = spark.read.schema("host string, ts_ns long, cls string").parquet(f"{tmp_path}/out").collect() if (tmp_path / "out" / "_spark_metadata").exists() else []
            if len(got) >= 2:
                break
            time.sleep(0.5)
    finally:
        query.stop()
    assert sorted(r.ts_ns for r in got)[:2] == [5 * S, 6 * S] and {r.cls for r in got} == {"idle"}


def _launched(c: Context):
    """A user's family: starts per program, and sends in all."""
    owned = c.events("process_start").select("host", "start_key")
    per_program = rollup_programs(owned, c.processes, [], {"value": F.count(F.lit(1))})
    sent = c.events("tcp_send").groupBy("host").agg(F.sum("size").alias("value"))
    return to_samples(c.programs(per_program), "launched_total", LABELS, "value").unionByName(to_samples(sent, "sent_total", [], "value"))


@pytest.fixture
def launched():
    register_family("launched", ("process_start", "process_end", "tcp_send"), _launched)
    yield
    del families.FAMILIES["launched"]


def test_one_registration_for_both_modes(spark, slices, launched, tmp_path):
    every = slices[0].unionByName(slices[1]).unionByName(slices[2])
    shown = lambda df: sorted((r.metric, tuple(sorted(r.labels.items())), r.value, r.kind) for r in df.collect())
    want = shown(samples(Context(wide=every), ["launched", "process"]))
    out = run(slices, str(tmp_path), StreamOptions(families=["launched", "process"], delay_ns=0), replay=(0,))
    assert shown(stream_samples(spark, out, ["launched", "process"])) == want and len(want) == 6
    compact(spark, out, f"{tmp_path}/compact")
    assert shown(stream_samples(spark, f"{tmp_path}/compact", ["launched", "process"])) == want
    only = shown(stream_samples(spark, out, ["launched"], include_names=["a.*"]))
    assert [m for m, *_ in only] == ["launched_total", "sent_total"]
    with pytest.raises(KeyError):
        from tracelake.streaming.runner import run_stream

        run_stream(every, "x", "y", StreamOptions(families=["no such family"]))


def test_drivers_start_again(spark, tmp_path):
    """Calls before the unload of their driver leave its histogram, in the sink and in its compact form."""
    fields = "host string, cls string, ts_ns long, seq long, cpu int, initial_ns long, routine long, base long, size long, file_name string"
    image = ("image_load", 0, 0, None, None, None, 4096, 100, "a.sys")
    call = lambda at, i: ("dpc", at, i, 0, at, 4100, None, None, None)
    first = [image, call(1000, 1), ("cswitch", 2000, 2, 0, None, None, None, None, None), call(3000, 3), ("cswitch", 4000, 4, 0, None, None, None, None, None)]
    again = [("image_unload", 5000, 5, None, None, None, 4096, None, None), ("image_load", 6000, 6, None, None, None, 4096, 100, "a.sys"), call(7000, 7), ("cswitch", 9000, 8, 0, None, None, None, None, None)]
    batches = [wide_events(spark.createDataFrame([("h", *r) for r in b], fields)) for b in (first, again)]
    options = StreamOptions(families=["interrupts"], delay_ns=0, per_driver=True, prune_unloaded=True)
    out = run(batches, str(tmp_path), options, replay=(1,))
    from tracelake.operators.histogram import DURATION_BOUNDS_US
    from tracelake.streaming.exposing import DURATIONS
    from tracelake.streaming.totals import stream_histograms

    compact(spark, out, f"{tmp_path}/compact")
    for place in (out, f"{tmp_path}/compact"):
        got = stream_histograms(spark, place, DURATIONS, ["host", "image_name"], DURATION_BOUNDS_US)
        assert rows(got, "image_name", "n", "total") == [("a.sys", 1, 2)]
    assert OPEN_END > 0
