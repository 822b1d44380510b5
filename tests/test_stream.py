"""Stream totals equal one batch run over the same rows."""

import functools

import pytest
from pyspark.sql import functions as F

from tests.util import rows
from tracelake.operators import entities
from tracelake.operators.asof import OPEN_END
from tracelake.operators.histogram import DURATION_BOUNDS_US, GAP_BOUNDS_MS, LATENCY_BOUNDS_US
from tracelake.plans import disk, interrupts, memory, network, registry_ops, threads
from tracelake.sources.dimensions import service_dim
from tracelake.sources.events import read_events, wide_events
from tracelake.sources.samples import exposition
from tracelake.sources.schema import WIDE_EVENTS
from tracelake.streaming import native, runner
from tracelake.streaming.runner import StreamOptions, drain, run_stream
from tracelake.streaming.state import Carry, latest_batch
from tracelake.streaming.totals import compact, late_rows, stream_counters, stream_histograms, stream_instances, stream_samples
from workload.views import CHUNK_NS, GRACE_NS, Trace

DELAY_NS = 3_000_000
OPTIONS = StreamOptions(delay_ns=DELAY_NS, grace_ns=GRACE_NS, chunk_ns=CHUNK_NS, call_limit_ns=1_000_000, per_driver=True)


def wide_table(t: Trace):
    context = t.context()
    context.typed.update({"image_load": t.image_loads, "image_unload": t.image_unloads, "service_config": t.service_config.withColumn("ts_ns", F.lit(0))})
    context.typed["dpc"] = t.dpc.withColumn("routine", F.col("seq") * 31 % 100 * 4096 + 4096 + F.col("seq") % 600)
    parts = [wide_events(df.withColumn("cls", F.lit(c))) for c, df in context.typed.items() if not c.startswith("disk_phys") and not c.startswith("disk_log")]
    table = functools.reduce(lambda a, b: a.unionByName(b), parts)
    return table.withColumn("ts", F.timestamp_micros(F.col("ts_ns").cast("bigint")))


@pytest.fixture(scope="module")
def trace(spark, sf_dir):
    return Trace(spark, sf_dir)


@pytest.fixture(scope="module")
def streamed(spark, trace, tmp_path_factory):
    """The events in four files; rows up to 2 ms late are in the file before or after their time's."""
    root = tmp_path_factory.mktemp("stream")
    table = wide_table(trace).cache()
    span = table.agg(F.max("ts_ns")).first()[0] // 4 + 1
    jitter = F.pmod(F.xxhash64("seq", "cls"), F.lit(2_000_000))
    placed = table.withColumn("part", ((F.col("ts_ns") + jitter) / F.lit(span)).cast("int"))
    for i in range(5):
        part = placed.filter(F.col("part") == i).drop("part")
        if not part.isEmpty():
            part.coalesce(1).write.mode("append").parquet(str(root / "in"))
    events = read_events(spark, str(root / "in"), streaming=True, schema=WIDE_EVENTS, maxFilesPerTrigger="1")
    run_stream(events, str(root / "ck"), str(root / "out"), OPTIONS).awaitTermination()
    drain(spark, str(root / "ck"), str(root / "out"), OPTIONS)
    table.unpersist()
    return root


def enriched(trace):
    """The trace with its process table enriched, as the stream has it."""
    t = Trace(trace.spark, trace.sf_dir)
    t.threads = trace.threads
    p = entities.enrich_programs(trace.processes, trace.image_loads, CHUNK_NS)
    t.processes = entities.resolve_services(p, trace.threads, service_dim(trace.service_config))
    return t


PROGRAM = ["process_name", "service_name", "pe_checksum", "session_id"]


def test_batches_and_lateness(spark, streamed):
    assert latest_batch(spark, str(streamed / "ck" / "carry")) >= 4
    assert late_rows(spark, str(streamed / "out")).count() == 0


def test_instances(spark, streamed, trace):
    got = stream_instances(spark, str(streamed / "out"))
    assert rows(got, "start_key", "session_id") == rows(trace.processes, "start_key", "session_id")


@pytest.mark.parametrize(
    "metric, dims, batch",
    [
        ("disk_process_io_operations_total", ["disk", "operation"], lambda t, o: disk.disk_by_program(t.disk, t.threads, t.processes, **o).withColumnRenamed("operations", "value")),
        ("network_process_sent_bytes_total", ["protocol"], lambda t, o: network.network_bytes(t.network, t.processes, **o).withColumnRenamed("sent_bytes", "value").filter("value > 0")),
        ("network_connections_failed_total", ["protocol", "address_family", "failure_code"], lambda t, o: network.connections_failed(t.network, t.processes, **o)),
        ("network_process_retransmissions_total", [], lambda t, o: network.retransmissions(t.network, t.processes, **o)),
        ("thread_context_switches_process_total", [], lambda t, o: threads.cswitch_by_program(t.cswitch, t.threads, t.processes, **o)),
        ("memory_hard_pagefaults_per_process_total", [], lambda t, o: memory.hard_faults_by_program(t.faults, t.threads, t.processes, **o)),
        ("registry_operations_process_total", ["operation", "result"], lambda t, o: registry_ops.registry_by_program(t.registry, t.processes, **o)),
    ],
)
def test_program_counters(spark, streamed, trace, metric, dims, batch):
    want = batch(enriched(trace), trace.options)
    want = want.select(*PROGRAM, *[F.col(d).cast("string").alias(d) for d in dims], "value")
    got = stream_counters(spark, str(streamed / "out"), metric, dims, per_program=True)
    assert rows(got, *PROGRAM, *dims, "value") == rows(want)
    assert want.count() > 0


def test_system_counters(spark, streamed, trace):
    out = str(streamed / "out")
    got = stream_counters(spark, out, "thread_states_total", ["state", "wait_reason"], per_program=False)
    want = threads.thread_states(trace.cswitch, trace.ready, trace.thread_starts, trace.thread_ends)
    assert rows(got, "state", "wait_reason", "value") == rows(want, "state", "wait_reason", "value")
    got = stream_counters(spark, out, "perfinfo_dpc_executed_cpu_total", ["cpu"], per_program=False)
    want = interrupts.dpc_counts(trace.isr, trace.dpc, trace.cswitch, per_cpu=True, chunk_ns=CHUNK_NS).filter("executed > 0")
    assert rows(got, "cpu", "value") == rows(want.select(F.col("cpu").cast("string"), "executed"))
    got = stream_counters(spark, out, "perfinfo_dpc_executed_total", [], per_program=False)
    assert rows(got, "value") == rows(want.agg(F.sum("executed")))
    got = stream_counters(spark, out, "network_sent_bytes_total", ["protocol"], per_program=False)
    assert rows(got, "protocol", "value") == rows(network.network_totals(trace.network, trace.processes, **trace.options).filter("sent_bytes > 0"), "protocol", "sent_bytes")
    got = stream_counters(spark, out, "registry_operations_total", ["operation", "result"], per_program=False)
    want = registry_ops.registry_totals(trace.registry, trace.processes, **trace.options)
    assert rows(got, "operation", "result", "value") == rows(want.select("operation", F.col("result").cast("string").alias("result"), "value"))


def test_histograms(spark, streamed, trace):
    out = str(streamed / "out")
    got = stream_histograms(spark, out, "thread_context_switch_interval_milliseconds", ["host", "cpu"], GAP_BOUNDS_MS)
    want = threads.cswitch_intervals(trace.cswitch, chunk_ns=CHUNK_NS)
    assert rows(got, "cpu", "n", "total", "buckets") == rows(want, "cpu", "n", "total", "buckets")
    got = stream_histograms(spark, out, "perfinfo_isr_to_dpc_latency_microseconds", ["host"], LATENCY_BOUNDS_US)
    want = interrupts.isr_dpc_latency(trace.isr, trace.dpc, trace.cswitch, chunk_ns=CHUNK_NS)
    assert rows(got, "n", "total", "buckets") == rows(want, "n", "total", "buckets")


def test_durations_by_driver(spark, streamed, trace):
    calls = trace.dpc.withColumn("routine", F.col("seq") * 31 % 100 * 4096 + 4096 + F.col("seq") % 600)
    durations = interrupts.dpc_durations(calls, trace.cswitch, CHUNK_NS)
    images = entities.image_intervals(trace.image_loads, trace.image_unloads, CHUNK_NS)
    want = interrupts.dpc_duration_by_image(durations, images, prune_unloaded=False, chunk_ns=CHUNK_NS)
    got = stream_histograms(spark, str(streamed / "out"), "perfinfo_dpc_execution_time_microseconds", ["host", "image_name"], DURATION_BOUNDS_US)
    assert rows(got, "image_name", "n", "total", "buckets") == rows(want, "image_name", "n", "total", "buckets")
    assert want.count() > 10


def test_enrichment(spark, streamed, trace):
    want = entities.enrich_programs(trace.processes, trace.image_loads, CHUNK_NS)
    want = entities.resolve_services(want, trace.threads, service_dim(trace.service_config))
    got = stream_instances(spark, str(streamed / "out"))
    columns = ["start_key", "process_name", "service_name", "pe_checksum", "session_id"]
    assert rows(got, *columns) == rows(want, *columns)
    assert want.filter("service_name <> ''").count() > 0


def test_compaction_keeps_totals(spark, streamed, tmp_path):
    compact(spark, str(streamed / "out"), str(tmp_path))
    before = stream_counters(spark, str(streamed / "out"), "thread_states_total", ["state"], per_program=False)
    after = stream_counters(spark, str(tmp_path), "thread_states_total", ["state"], per_program=False)
    assert rows(before) == rows(after)


def _run(df, mode, spark, name):
    query = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.table(name)


def test_native_forms(spark, streamed, trace):
    events = read_events(spark, str(streamed / "in"), streaming=True, schema=WIDE_EVENTS, maxFilesPerTrigger="1")
    per_cpu = threads.cswitch_per_cpu(events.filter("cls = 'cswitch'"))
    assert rows(_run(per_cpu, "complete", spark, "per_cpu")) == rows(threads.cswitch_per_cpu(trace.cswitch))
    starts = native.distinct_starts(events.filter("cls = 'process_start'"))
    assert _run(starts, "append", spark, "starts").count() == trace.process_starts.count()
    counts = native.interval_counts(events, "1 second")
    got = _run(counts, "update", spark, "counts").groupBy("interval_start").agg(F.max("new_processes").alias("n")).agg(F.sum("n")).first()[0]
    assert got == trace.process_starts.count()


def test_a_host_ahead_makes_no_other_late(spark, tmp_path):
    """Host b runs three hours ahead and comes first; a's disk only flushes."""
    hour = 3600 * 10**9
    schema = "host string, seq bigint, ts_ns bigint, cls string, disk int"
    slices = [[("b", 1, 3 * hour, "hard_fault", None)], [("a", 1, 1, "hard_fault", None), ("a", 2, 10**9, "disk_flush", 0)], [("a", 3, 40 * 10**9, "hard_fault", None)], [("a", 4, 41 * 10**9, "hard_fault", None), ("b", 2, 1, "hard_fault", None)]]
    for i, part in enumerate(slices):
        wide_events(spark.createDataFrame(part, schema)).withColumn("ts", F.timestamp_micros(F.lit(i))).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    events = read_events(spark, str(tmp_path / "in"), streaming=True, schema=WIDE_EVENTS, maxFilesPerTrigger="1")
    options = StreamOptions(families=("disk_io", "memory"))
    run_stream(events, str(tmp_path / "ck"), str(tmp_path / "out"), options).awaitTermination()
    drain(spark, str(tmp_path / "ck"), str(tmp_path / "out"), options)
    out = str(tmp_path / "out")
    assert rows(stream_counters(spark, out, "memory_hard_pagefaults_total", [], per_program=False), "host", "value") == [("a", 3), ("b", 1)]
    assert rows(late_rows(spark, out), "host", "rows") == [("b", 1)]
    got = stream_counters(spark, out, "disk_io_operations_total", ["disk", "operation"], per_program=False)
    assert rows(got, "operation", "value") == [("flush", 1), ("read", 0), ("write", 0)]
    assert rows(stream_counters(spark, out, "disk_read_bytes_total", ["disk"], per_program=False), "value") == [(0,)]


def test_rows_of_one_host_stay_in_their_partitions(spark, tmp_path):
    """A busy host's rows are many tasks' work, also before there is a clock."""
    rows_ = spark.range(0, 400, 1, 4).select(F.lit("h").alias("host"), F.col("id").alias("ts_ns"))
    clock = spark.createDataFrame([("h", 7)], runner._CLOCK)
    for known in (Carry(spark, str(tmp_path)).read("clock", -1, runner._CLOCK), clock):
        marked = runner._marked(rows_, known)
        assert marked.select(F.spark_partition_id()).distinct().count() == 4
        assert marked.filter(F.col("_mark") == (7 if known is clock else -OPEN_END)).count() == 400


def test_no_slice_is_kept_in_memory(spark, tmp_path, monkeypatch):
    kept = []
    monkeypatch.setattr(type(spark.range(0)), "persist", lambda df, *a: kept.append(df) or df)
    row = wide_events(spark.createDataFrame([("a", 1, 1, "hard_fault")], "host string, seq bigint, ts_ns bigint, cls string"))
    runner.process_slice(row, 0, str(tmp_path / "carry"), str(tmp_path / "out"), StreamOptions(families=("memory",)), final=True)
    assert kept == []
    assert rows(stream_counters(spark, str(tmp_path / "out"), "memory_hard_pagefaults_total", [], per_program=False), "value") == [(1,)]


def test_exposition_text_is_ordered_over_files(spark, tmp_path):
    flushes = [("a", i, i, "disk_flush", i) for i in range(40)]
    batch = wide_events(spark.createDataFrame(flushes, "host string, seq bigint, ts_ns bigint, cls string, disk int"))
    options = StreamOptions(families=("disk_io",), exposition=True)
    name = "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set(name, "false")
    try:
        runner.process_slice(batch, 0, str(tmp_path / "carry"), str(tmp_path / "out"), options, final=True)
    finally:
        spark.conf.unset(name)
    files = sorted((tmp_path / "out" / "exposition" / "batch=0").glob("part-*"))
    lines = [line for f in files for line in f.read_text().splitlines()]
    want = [r[0] for r in exposition(stream_samples(spark, str(tmp_path / "out"), options.families)).collect()]
    assert len([f for f in files if f.stat().st_size]) > 1
    assert lines == want and lines[0].startswith("# TYPE ")
