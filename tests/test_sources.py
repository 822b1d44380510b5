"""Decode, routing, sinks and the family registry."""

import re
import struct

import pytest
from pyspark.sql import functions as F

from tests.util import rows
from tracelake.plans import families
from tracelake.plans.inventory import PROVIDERS, events_received
from tracelake.sources import events, schema
from tracelake.sources.samples import exposition, histogram_samples, to_samples, write_exposition, write_samples
from workload.views import Trace

RAW = "host string, seq bigint, ts_ns bigint, cpu int, header_pid bigint, provider string, opcode int, pointer_bytes int, payload binary, cls string"


def raw(spark, *items):
    """(seq, cls, payload) or (seq, cls, payload, pointer_bytes)."""
    data = [("h", i[0], i[0], 0, 4, "", 0, i[3] if len(i) > 3 else 8, bytearray(i[2]), i[1]) for i in items]
    return spark.createDataFrame(data, RAW)


def test_every_layout_round_trips(spark):
    for cls, layout in schema.LAYOUTS.items():
        length = max([f.offset + f.width for f in layout.fields], default=0)
        payload, want = bytearray(b"\xAA" * length), {}
        for i, f in enumerate(layout.fields):
            value = ((1 << (8 * f.width)) - 1 - i * 3) if f.width < 8 else (1 << 63) + 5 + i
            payload[f.offset : f.offset + f.width] = value.to_bytes(f.width, "little")
            want[f.name] = value - (1 << 64) if value >= 1 << 63 else value
        got = events.decode_events(raw(spark, (1, cls, payload)), cls).collect()
        assert len(got) == 1
        assert {k: got[0][k] for k in want} == want, cls


def test_narrow_pointers_move_the_thread_id(spark):
    wide = struct.pack("<II I", 1, 0, 512) + b"\0" * 36 + struct.pack("<I", 77)
    narrow = struct.pack("<II I", 1, 0, 512) + b"\0" * 28 + struct.pack("<I", 78)
    got = events.decode_events(raw(spark, (1, "disk_read", wide), (2, "disk_write", narrow, 4), (3, "disk_read", narrow)), "disk_read", "disk_write")
    assert rows(got, "seq", "size", "issuing_tid") == [(1, 512, 77), (2, 512, 78)]


def test_short_payloads_are_counted(spark):
    df = raw(spark, (1, "cswitch", b"\1\0\0\0"), (2, "hard_fault", b""), (3, "ready_thread", b""), (4, "thread_start", b"\7\0\0\0\x08\0\0\0"), (5, "tcp_fail", b"\x17\0\3\0"))
    assert rows(events.decode_errors(df), "cls", "errors") == [("cswitch", 1), ("hard_fault", 1)]
    assert rows(events.decode_events(df, "thread_start"), "pid", "tid", "sub_process_tag") == [(7, 8, 0)]
    mixed = events.decode_events(df, "tcp_fail", "thread_start")
    assert rows(mixed, "seq", "proto", "pid") == [(4, None, 7), (5, 23, None)]


def test_undecodable_faults_count_in_the_total(spark):
    lifecycle = {
        "process_start": spark.createDataFrame([("h", 1, 0, 10, 4, "System", 0)], "host string, seq bigint, ts_ns bigint, start_key bigint, pid bigint, process_name string, session_id bigint"),
        "process_end": spark.createDataFrame([], "host string, seq bigint, ts_ns bigint, start_key bigint"),
    }
    context = families.Context(raw=raw(spark, (1, "hard_fault", b"\0" * 32 + b"\5\0\0\0"), (2, "hard_fault", b"")), typed=lifecycle)
    got = rows(families.samples(context, ["memory"]), "metric", "value")
    assert got == [("memory_hard_pagefaults_per_process_total", 1.0), ("memory_hard_pagefaults_total", 2.0)]


def test_routing_and_provider_counts(spark):
    data = [
        ("{3D6FA8D1-FE05-11D0-9DDA-00C04FD7BA7C}", 36, "cswitch"), (schema.KERNEL_PROCESS, 15, "process_start"), (schema.PERF_INFO, 70, None),
        (schema.SYSTEM_IO, 10, "tcp_send"), (schema.SYSTEM_REGISTRY, 33, "registry_op"), (schema.SYSTEM_REGISTRY, 34, None), ("other", 1, None),
        (schema.IMAGE, 4, "image_load"), (schema.THREAD, 4, "thread_start"), (schema.PROCESS, 4, None),
    ]
    df = spark.createDataFrame([("h", p, o, c) for p, o, c in data], "host string, provider string, opcode int, want string")
    got = events.classify(df)
    assert got.filter(~F.col("cls").eqNullSafe(F.col("want"))).count() == 0
    counts = dict(rows(events_received(got), "provider", "value"))
    assert set(counts) == set(PROVIDERS) and len(PROVIDERS) == 11
    assert counts["microsoft-windows-kernel-registry"] == 2 and counts["perfinfo-kernel"] == 1 and counts["microsoft-windows-kernel-file"] == 0


def test_class_in_the_data_wins_over_the_route(spark):
    df = spark.createDataFrame([("h", schema.SYSTEM_IO, 10, "disk_read")], "host string, provider string, opcode int, cls string")
    assert rows(events.classify(df), "cls", "provider") == [("disk_read", "microsoft-windows-kernel-disk")]


def test_written_events_prune_by_class(spark, tmp_path):
    df = raw(spark, (1, "cswitch", b"\1" * 16), (2, "hard_fault", b"\0" * 36)).withColumn("ts", F.lit(None).cast("timestamp"))
    events.write_events(df, str(tmp_path / "ev"))
    back = events.read_events(spark, str(tmp_path / "ev"), classes=["cswitch"])
    assert back.count() == 1
    plan = back._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PartitionFilters: \[[^\]]*cls", plan)


def test_scope_host(spark):
    df = spark.createDataFrame([("h", 3)], "host string, boot_id int")
    assert rows(events.scope_host(df), "host") == [("h/3",)]


def test_exposition_lines(spark, tmp_path):
    h = spark.createDataFrame([("h", 0, 3, 2_500_000, [1, 1, 0])], "host string, cpu int, n bigint, total bigint, buckets array<bigint>")
    counters = spark.createDataFrame([("h", 'a"b\\c', 7)], "host string, process_name string, value bigint")
    samples = histogram_samples(h, "gap_ms", ["cpu"], [0.001, 0.002, 0.004], scale=1e6).unionByName(
        to_samples(counters, "ops_total", ["process_name"], "value")
    )
    lines = [r[0] for r in exposition(samples).collect()]
    assert lines == [
        "# TYPE gap_ms histogram",
        'gap_ms_bucket{host="h",cpu="0",le="0.001"} 1',
        'gap_ms_bucket{host="h",cpu="0",le="0.002"} 2',
        'gap_ms_bucket{host="h",cpu="0",le="0.004"} 2',
        'gap_ms_bucket{host="h",cpu="0",le="+Inf"} 3',
        'gap_ms_count{host="h",cpu="0"} 3',
        'gap_ms_sum{host="h",cpu="0"} 2.5',
        "# TYPE ops_total counter",
        'ops_total{host="h",process_name="a\\"b\\\\c"} 7',
    ]
    write_exposition(samples, str(tmp_path / "text"))
    assert spark.read.text(str(tmp_path / "text")).count() == 9
    write_samples(samples, str(tmp_path / "samples"))
    assert spark.read.parquet(str(tmp_path / "samples")).filter("metric = 'ops_total'").count() == 1


@pytest.fixture(scope="module")
def trace(spark, sf_dir):
    return Trace(spark, sf_dir)


def test_families_need_their_classes(trace):
    context = trace.context()
    with pytest.raises(KeyError):
        families.samples(families.Context(typed={}), ["disk_io"])
    with pytest.raises(KeyError):
        families.samples(context, ["nope"])
    with pytest.raises(ValueError):
        families.samples(context, [])
    assert families.required_classes(["interrupts"]) == {"isr", "dpc", "cswitch"}
    assert [f.name for f in families.FAMILIES.values() if f.default] == ["disk_io", "memory", "process"]


def test_interrupts_build_no_process_table(trace):
    context = trace.context(per_cpu=True)
    assert families.samples(context, ["interrupts"]).count() > 0
    assert "processes" not in context.__dict__ and "_instances" not in context.__dict__


def test_switches_add_series(trace):
    bare = {r[0] for r in rows(families.samples(trace.context(), ["network"]).select("metric").distinct())}
    full = {r[0] for r in rows(families.samples(trace.context(by_protocol=True, connection_stats=True, retransmissions=True), ["network"]).select("metric").distinct())}
    assert bare == {"network_process_sent_bytes_total", "network_process_received_bytes_total"}
    assert full - bare == {
        "network_sent_bytes_total", "network_received_bytes_total", "network_process_connections_attempted_total",
        "network_process_connections_accepted_total", "network_connections_failed_total", "network_process_retransmissions_total",
    }


def test_name_filter_leaves_totals_alone(trace):
    kept = families.samples(trace.context(include_names=["app1"]), ["memory"])
    every = families.samples(trace.context(), ["memory"])
    assert rows(kept.filter("size(labels) = 0")) == rows(every.filter("size(labels) = 0"))
    names = {r[0]["process_name"] for r in kept.filter("size(labels) > 0").select("labels").collect()}
    assert names == {"app1.exe"}


def test_user_family(trace):
    families.register_family("switches", ("cswitch",), lambda c: to_samples(c.events("cswitch").groupBy("host").count(), "switches_total", [], "count"))
    try:
        assert rows(families.samples(trace.context(), ["switches"]), "metric") == [("switches_total",)]
    finally:
        del families.FAMILIES["switches"]
