"""Queries that run operators another way: other inputs, the other join strategy, streams in slices of time.

They register themselves beside those of ``workload.queries``; most share its SQL.
"""

import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracelake import functions as fn
from tracelake.operators import attribute, entities, images, pairing, scrapes
from tracelake.operators.histogram import DURATION_BOUNDS_US, GAP_BOUNDS_MS, cumulative
from tracelake.operators.materialise import ensure_checkpoint_dir
from tracelake.plans import memory, network, threads
from tracelake.plans.families import Context, samples
from tracelake.plans.rollup import rollup_programs
from tracelake.sources.events import classify, read_events, wide_events, write_events
from tracelake.sources.schema import WIDE_EVENTS
from tracelake.streaming import native, stateful
from tracelake.streaming.exposing import DURATIONS
from tracelake.streaming.runner import Slice, StreamOptions, drain, run_stream
from tracelake.streaming.scraping import ScrapeOptions
from tracelake.streaming.totals import (
    compact, stream_cleaned, stream_counters, stream_histograms, stream_instances, stream_samples, stream_snapshots,
)
from workload import oracle as o
from workload.queries import ALL_SAMPLES, LIFECYCLE, ORACLE, THRESHOLDS, flat, histogram_sql, query, sample_sql
from workload.views import CHUNK_NS, DAY_NS, GRACE_NS, HOST, IMAGE_SPACING, Trace, in_slices, typed_rows

# Slices of time a stream is fed in; each is a restart, and a last batch drains what waits.
SLICES = 2


def _folder(t: Trace, name: str) -> str:
    return f"{ensure_checkpoint_dir(t.spark)}/{name}-{uuid.uuid4().hex}"


# Sources --------------------------------------------------------------------------------------


@query(o.with_(o.K, o.NET, select=f"""SELECT '{HOST}' AS host, 'registry_op' AS cls, count(*) AS n, CAST(sum(ts_ns) AS BIGINT) AS times
    FROM k WHERE event_type = 'click'
    UNION ALL SELECT '{HOST}', protocol || '_send', count(*), CAST(sum(ts_ns) AS BIGINT) FROM net WHERE kind = 'send' GROUP BY protocol"""))
def event_source(t: Trace) -> DataFrame:
    """Events written by class, and three classes of them read back."""
    typed, path = t.context().typed, _folder(t, "events")
    wide = [wide_events(typed[c].withColumn("cls", F.lit(c))) for c in ("registry_op", *network.CLASSES)]
    write_events(reduce(DataFrame.unionByName, wide), path)
    read = read_events(t.spark, path, classes=["registry_op", "tcp_send", "udp_send"], schema=WIDE_EVENTS)
    return read.groupBy("host", "cls").agg(F.count(F.lit(1)).alias("n"), F.sum("ts_ns").alias("times"))


@query(ALL_SAMPLES)
def wide_family_samples(t: Trace) -> DataFrame:
    """The families over one table of typed rows, where columns a class does not have are null."""
    given = t.parsed_once().context(per_cpu=True, by_protocol=True, connection_stats=True, retransmissions=True)
    apart = [df.withColumn("cls", F.lit(c)) for c, df in given.typed.items() if not any(c in several for several in given.mixed)]
    wide = reduce(DataFrame.unionByName, [wide_events(df) for df in (*apart, *given.mixed.values())])
    context = Context(wide=wide, switches=given.switches, grace_ns=given.grace_ns, chunk_ns=given.chunk_ns)
    return flat(samples(context, ["disk_io", "system", "threads", "interrupts", "network", "memory", "registry", "process"]))


@query("\nUNION ALL ".join([
    sample_sql("dpc_counts", "perfinfo_dpc_queued_total", [], "queued"),
    sample_sql("dpc_counts", "perfinfo_dpc_executed_total", [], "executed"),
    histogram_sql("dpc_duration_by_image", "perfinfo_dpc_execution_time_microseconds", ["image_name"], DURATION_BOUNDS_US, 1.0),
]))
def driver_samples(t: Trace) -> DataFrame:
    """The interrupt family with per-driver series, its latency left to ``all_family_samples``."""
    context = t.context(per_driver=True)
    context.images = t.part_images
    return flat(samples(context, ["interrupts"]).filter("metric NOT LIKE 'perfinfo_isr_to_dpc%'"))


@query(sample_sql("events_received", "handler_events_received_total", ["provider"], "value"))
def health_samples(t: Trace) -> DataFrame:
    return flat(samples(Context(raw=classify(t.routed)), ["health"]))


# Joins ----------------------------------------------------------------------------------------


@query(ORACLE["disk_attribution"])
def disk_attribution_scan(t: Trace) -> DataFrame:
    """The disk chain as it runs where entity tables are too large to broadcast."""
    moved = t.disk.filter("operation <> 'flush'")
    owned = attribute.attribute_disk(moved, t.threads, t.processes, strategy="scan", **t.options)
    return owned.select("seq", "start_key", "attribution")


@query(ORACLE["hard_faults_by_program"])
def hard_faults_by_program_scan(t: Trace) -> DataFrame:
    return memory.hard_faults_by_program(t.faults, t.threads, t.processes, strategy="scan", **t.options)


_TIMED_IMAGES = o.with_(o.K, f"""
loads AS (SELECT p_partkey AS seq, (p_partkey // 3 + 1) * {IMAGE_SPACING} + p_partkey % 3 * 256 AS base, 1024 + p_size * 32 AS size, p_name AS image_name,
                 p_partkey % 7 * 3 * {DAY_NS} AS valid_from, (p_partkey % 7 * 3 + 2 + p_partkey % 11) * {DAY_NS} AS valid_to FROM part),
calls AS (SELECT seq, ts_ns, (seq * 7919 % 700 + 1) * {IMAGE_SPACING} + seq * 37 % 2048 AS address FROM k WHERE event_type = 'purchase'),
held AS (SELECT c.seq, arg_max(image_name, (valid_from, base, i.seq)) AS image_name FROM calls c JOIN loads i
         ON c.address >= i.base AND c.address < i.base + i.size AND i.valid_from <= c.ts_ns AND c.ts_ns < i.valid_to GROUP BY c.seq)""",
    select="SELECT calls.seq, image_name FROM calls LEFT JOIN held USING (seq)")


def _calls_in_images(t: Trace, strategy: str) -> DataFrame:
    key = F.col("p_partkey")
    loads = t.table("part").select(
        F.lit(HOST).alias("host"), key.alias("seq"), (fn.units.whole(key, 3) + 1).cast("bigint").alias("page"), (key % 3).alias("part"),
        (F.lit(1024) + F.col("p_size") * 32).cast("bigint").alias("size"), F.col("p_name").alias("image_name"),
        (key % 7 * 3 * DAY_NS).cast("bigint").alias("valid_from"), ((key % 7 * 3 + 2 + key % 11) * DAY_NS).cast("bigint").alias("valid_to"),
    )
    loads = loads.select("*", (F.col("page") * IMAGE_SPACING + F.col("part") * 256).alias("base")).drop("page", "part")
    address = (F.col("seq") * 7919 % 700 + 1) * IMAGE_SPACING + F.col("seq") * 37 % 2048
    calls = t.dpc.select("host", "seq", "ts_ns", address.alias("address"))
    return images.resolve_images(calls, loads, strategy=strategy, **t.options).select("seq", "image_name")


@query(_TIMED_IMAGES)
def address_images_over_time(t: Trace) -> DataFrame:
    """Images that lie over each other, load and unload, looked up at many times."""
    return _calls_in_images(t, "broadcast")


@query(_TIMED_IMAGES)
def address_images_over_time_scan(t: Trace) -> DataFrame:
    return _calls_in_images(t, "scan")


# Scrapes --------------------------------------------------------------------------------------

IDLE_NS = DAY_NS * 2 // 5


@query(o.with_(o.K, o.PROC, f"""
days AS (SELECT DISTINCT (ts_ns // {DAY_NS} + 1) * {DAY_NS} AS ts_ns FROM k),
pauses AS (SELECT ts_ns, lead(ts_ns) OVER (ORDER BY ts_ns) AS next_ns FROM days),
forced AS (SELECT unnest(range(ts_ns + {IDLE_NS}, next_ns, {IDLE_NS})) AS ts_ns FROM pauses WHERE next_ns IS NOT NULL),
scrapes AS (SELECT ts_ns, row_number() OVER (ORDER BY ts_ns) AS scrape_id FROM (FROM days UNION ALL FROM forced))""", THRESHOLDS, """
aged AS (SELECT start_key, end_ns, CASE WHEN end_ns IS NOT NULL THEN (SELECT count(*) FROM scrapes WHERE scrapes.ts_ns <= end_ns) END AS generation FROM proc)""",
    select=f"""SELECT '{HOST}' AS host, start_key, generation,
    (SELECT min(scrape_id) FROM limits WHERE limits.threshold > aged.generation AND limits.scrape_id > aged.generation) AS cleaned_scrape FROM aged"""))
def cleaned_at_idle(t: Trace) -> DataFrame:
    """Expiry by generations where the failsafe cleans up between scrapes that are far apart."""
    cleaned = scrapes.cleaned_at(t.processes, t.scrapes, min_grace_s=0.2, idle_limit_ns=IDLE_NS)
    return cleaned.select("host", "start_key", "generation", "cleaned_scrape")


# Streams in slices ----------------------------------------------------------------------------


def _options(families: list[str], **more) -> StreamOptions:
    return StreamOptions(families=families, delay_ns=DAY_NS // 24, grace_ns=GRACE_NS, chunk_ns=CHUNK_NS, **more)


def _run(t: Trace, rows: DataFrame, options: StreamOptions) -> str:
    """Run the families over slices of time, a restart of the stream each; returns where the results are."""
    root = _folder(t, "slices")
    for events in in_slices(rows, f"{root}/in", SLICES):
        run_stream(events, root, f"{root}/out", options).awaitTermination()
    drain(t.spark, root, f"{root}/out", options)
    return f"{root}/out"


def _sliced(t: Trace, classes: list[str], families: list[str], compacted: bool = False) -> str:
    out = _run(t, typed_rows(t.context().typed, classes), _options(families))
    if compacted:
        compact(t.spark, out, f"{out}-compact")
    return f"{out}-compact" if compacted else out


@query(f"SELECT host, CAST(disk AS VARCHAR) AS disk, operation, value FROM ({ORACLE['disk_operations']})")
def stream_disk_operations(t: Trace) -> DataFrame:
    """Operations per disk, zeros of seen disks included, from a compacted sink."""
    out = _sliced(t, [*LIFECYCLE, "disk_read", "disk_write", "disk_flush"], ["disk_io"], compacted=True)
    return stream_counters(t.spark, out, "disk_io_operations_total", ["disk", "operation"], per_program=False)


@query(f"""SELECT host, {o.PROGRAM_COLUMNS}, protocol, CAST(sent_bytes AS BIGINT) AS value
    FROM ({ORACLE['network_bytes_by_program']}) WHERE sent_bytes > 0""")
def stream_network_bytes_by_program(t: Trace) -> DataFrame:
    out = _sliced(t, ["process_start", "process_end", *network.CLASSES], ["network"])
    return stream_counters(t.spark, out, "network_process_sent_bytes_total", ["protocol"], per_program=True)


@query(ORACLE["cswitch_gap_histogram"])
def stream_gap_histogram(t: Trace) -> DataFrame:
    """Gaps between switches, those across slices included, from a compacted sink."""
    out = _sliced(t, [*LIFECYCLE, "cswitch", "ready_thread"], ["threads"], compacted=True)
    h = stream_histograms(t.spark, out, "thread_context_switch_interval_milliseconds", ["host", "cpu"], GAP_BOUNDS_MS)
    return cumulative(h, GAP_BOUNDS_MS)


@query(o.with_(o.K, select=f"SELECT '{HOST}' AS host, seq + 2 AS start_key FROM k WHERE event_type = 'signup'"))
def stream_distinct_starts(t: Trace) -> DataFrame:
    """Process starts without the repeats that snapshots bring a second later."""
    root = _folder(t, "starts")
    for events in in_slices(typed_rows(t.context().typed, ["process_start"]), f"{root}/in", SLICES):
        repeated = events.withColumn("ts_ns", F.explode(F.array(F.col("ts_ns"), F.col("ts_ns") + 1000)))
        timed = repeated.withColumn("ts", F.timestamp_seconds(fn.micros(F.col("ts_ns"))))
        stateful.write_stream(native.distinct_starts(timed, "1 day").select("host", "start_key"), f"{root}/ck", f"{root}/out").awaitTermination()
    return t.spark.read.schema("host string, start_key bigint").parquet(f"{root}/out")


def _scrape_rows(t: Trace) -> DataFrame:
    return typed_rows({"scrape": t.scrapes}, ["scrape"])


_INSTANCES = ["process_start", "process_end"]
_EVERY_FAMILY = ["disk_io", "system", "threads", "interrupts", "network", "memory", "registry", "process"]
# Results of the run that several queries read, by application and input.
_whole_runs: dict[tuple[str, str], str] = {}


def _whole_run(t: Trace) -> str:
    """One run of every family, with scrapes, a snapshot counter and exposition text."""
    key = (t.spark.sparkContext.applicationId, t.sf_dir)
    if key not in _whole_runs:
        typed = t.context().typed
        rows = typed_rows(typed, list(typed)).unionByName(_scrape_rows(t))
        followed = ScrapeOptions(min_grace_s=0.2, snapshots={"disk_operations": (["disk"], _disk_counts)})
        _whole_runs[key] = _run(t, rows, _options(_EVERY_FAMILY, scrapes=followed, exposition=True))
    return _whole_runs[key]


@query(ORACLE["cleaned_at"])
def stream_cleaned_at(t: Trace) -> DataFrame:
    """Expiry by generations, with the scrapes and the ended instances carried from slice to slice."""
    return stream_cleaned(t.spark, _whole_run(t)).select("host", "start_key", "generation", "cleaned_scrape")


@query(ORACLE["cleaned_at_idle"])
def stream_cleaned_at_idle(t: Trace) -> DataFrame:
    """The same where the failsafe cleans up between scrapes that are far apart."""
    rows = typed_rows(t.context().typed, _INSTANCES).unionByName(_scrape_rows(t))
    out = _run(t, rows, _options(["process"], scrapes=ScrapeOptions(min_grace_s=0.2, idle_limit_ns=IDLE_NS)))
    return stream_cleaned(t.spark, out).select("host", "start_key", "generation", "cleaned_scrape")


def _disk_counts(s: Slice) -> DataFrame:
    moved = s.of("disk_read", "disk_write").select("host", "seq", "ts_ns", "disk", "issuing_tid", "header_pid")
    owned = attribute.known_only(attribute.attribute_disk(moved, s.threads, s.processes, chunk_ns=CHUNK_NS))
    return owned.select("host", "start_key", "ts_ns", "disk", F.lit(1).alias("value"))


@query(ORACLE["counter_snapshots_expiring"])
def stream_counter_snapshots_expiring(t: Trace) -> DataFrame:
    """Counters that fall when an instance expires, each instance's counts taken back once."""
    levels = stream_snapshots(t.spark, _whole_run(t), "disk_operations", ["disk"], every_scrape=True)
    return levels.withColumn("disk", F.col("disk").cast("bigint"))


@query(ORACLE["dpc_duration_by_image"])
def stream_dpc_duration_by_image(t: Trace) -> DataFrame:
    """Call durations by driver; a driver's series starts again when it is unloaded."""
    loaded = t.part_images.select("host", "seq", F.col("valid_from").alias("ts_ns"), "base", "size", F.col("image_name").alias("file_name"))
    unloaded = t.part_images.filter("unload_ns IS NOT NULL").select("host", "seq", F.col("unload_ns").alias("ts_ns"), "base")
    typed = {**t.context().typed, "image_load": loaded, "image_unload": unloaded}
    rows = typed_rows(typed, ["isr", "dpc", "cswitch", "image_load", "image_unload"])
    out = _run(t, rows, _options(["interrupts"], per_driver=True, prune_unloaded=True))
    return cumulative(stream_histograms(t.spark, out, DURATIONS, ["host", "image_name"], DURATION_BOUNDS_US), DURATION_BOUNDS_US)


@query(ORACLE["enrich_running"])
def stream_enrich_running(t: Trace) -> DataFrame:
    """Instances that earlier slices carry, named by a snapshot of running services that comes last."""
    end = t.k.agg(F.max("ts_ns")).first()[0] + DAY_NS
    typed = {**t.context().typed, "service_config": t.service_config, "running_service": t.running_snapshot.withColumn("ts_ns", F.lit(end))}
    out = _run(t, typed_rows(typed, [*_INSTANCES, "service_config", "running_service"]), _options(["process"]))
    return stream_instances(t.spark, out).select("host", "start_key", "service_name")


@query(ALL_SAMPLES)
def stream_family_samples(t: Trace) -> DataFrame:
    """Every family over slices of a stream, the registered ones among them, read as samples."""
    return flat(stream_samples(t.spark, _whole_run(t), _EVERY_FAMILY))


@query(sample_sql("events_received", "handler_events_received_total", ["provider"], "value"))
def stream_health_samples(t: Trace) -> DataFrame:
    """The health family, which only its registration describes, on a stream."""
    rows = wide_events(classify(t.routed))
    return flat(stream_samples(t.spark, _run(t, rows, _options(["health"])), ["health"]))


def _lines(sql: str, metric: str, labels: list[str], value: str, where: str = "true") -> str:
    # Labels in the order of their names, after the host.
    shown = "".join(f"""||',{c}="'||{c}||'"'""" for c in sorted(labels))
    return f"""SELECT '{metric}{{host="'||host||'"'{shown}||'}} '||CAST({value} AS BIGINT) AS line FROM ({sql}) WHERE {where}"""


_PROGRAM = ["process_name", "service_name", "pe_checksum", "session_id"]
_EXPOSED = [
    ("disk_operations", "disk_io_operations_total", ["disk", "operation"], "value", "true"),
    ("disk_bytes", "disk_read_bytes_total", ["disk"], "read_bytes", "true"),
    ("disk_bytes", "disk_written_bytes_total", ["disk"], "written_bytes", "true"),
    ("disk_by_program", "disk_process_io_operations_total", [*_PROGRAM, "disk", "operation"], "operations", "true"),
    ("disk_by_program", "disk_process_read_bytes_total", [*_PROGRAM, "disk"], "bytes", "operation = 'read' AND bytes > 0"),
    ("disk_by_program", "disk_process_written_bytes_total", [*_PROGRAM, "disk"], "bytes", "operation = 'write' AND bytes > 0"),
]


@query("\nUNION ALL ".join(
    [_lines(ORACLE[q], metric, labels, value, where) for q, metric, labels, value, where in _EXPOSED]
    + [f"SELECT '# TYPE {metric} counter' AS line" for _, metric, *_ in _EXPOSED]
))
def stream_exposition_text(t: Trace) -> DataFrame:
    """The disk series of the exposition text that the last batch of a stream has left: one folder, all series."""
    texts = t.spark.read.text(f"{_whole_run(t)}/exposition")
    last = texts.filter(F.col("batch") == texts.agg(F.max("batch")).first()[0])
    return last.select(F.col("value").alias("line")).filter(F.col("line").rlike("^(# TYPE )?disk_"))


# Streams with state in the state store ----------------------------------------------------------

_DELAY_NS = DAY_NS // 2


def _in_store(t: Trace, classes: list[str], name: str, run: Callable[[DataFrame, str], None]) -> str:
    """Feed shuffled slices and at last an end marker to ``run(events, root)``, which awaits its queries."""
    stateful.use_state_store(t.spark)
    root = _folder(t, name)
    rows = typed_rows(t.context().typed, classes)
    for events in in_slices(rows, f"{root}/in", SLICES, jitter_ns=_DELAY_NS // 2):
        run(events, root)
    end = t.k.agg(F.max("ts_ns")).first()[0] + 2 * pairing.MAX_PAIR_NS
    stateful.end_marker(t.spark, end).withColumn("ts", F.timestamp_micros(fn.units.whole(F.col("ts_ns"), 1000))).write.parquet(f"{root}/in/s-end")
    run(events, root)
    return root


_DELAY = f"{_DELAY_NS // 1_000_000} milliseconds"


@query(ORACLE["isr_dpc_pairs"])
def stream_state_isr_dpc_pairs(t: Trace) -> DataFrame:
    """Interrupt pairing with a stack per CPU in the state store, over micro-batches whose rows come late."""

    def run(events: DataFrame, root: str) -> None:
        pairs = stateful.interrupt_pairs(events, _DELAY, call_limit_ns=1_000_000)
        stateful.write_stream(pairs, f"{root}/ck", f"{root}/pairs").awaitTermination()

    root = _in_store(t, ["isr", "dpc", "cswitch"], "pairs", run)
    return t.spark.read.schema(stateful.PAIRS).parquet(f"{root}/pairs").withColumn("cpu", F.col("cpu").cast("int"))


def _per_program(owned: DataFrame, dims: list[str], value: Column) -> DataFrame:
    """Facts of the state store summed per program."""
    starts = owned.filter("cls = 'process_start'").withColumn("session_id", entities.normalise_session(F.col("session_id"), F.col("pid")))
    instances = starts.select("host", "start_key", "process_name", F.lit("").alias("service_name"), "pe_checksum", "session_id")
    facts = owned.filter("cls <> 'process_start'")
    return rollup_programs(facts, instances, dims, {"value": value})


@query(f"""SELECT host, {o.PROGRAM_COLUMNS}, protocol, CAST(sent_bytes AS BIGINT) AS value
    FROM ({ORACLE['network_bytes_by_program']}) WHERE sent_bytes > 0""")
def stream_state_network_bytes(t: Trace) -> DataFrame:
    """Bytes sent by program, with the owner of every pid in the state store."""

    def run(events: DataFrame, root: str) -> None:
        owned = stateful.process_owners(events, _DELAY, ["tcp_send", "udp_send"], GRACE_NS)
        stateful.write_stream(owned, f"{root}/ck", f"{root}/owned").awaitTermination()

    root = _in_store(t, [*_INSTANCES, "tcp_send", "udp_send"], "owners", run)
    owned = t.spark.read.schema(stateful.OWNED).parquet(f"{root}/owned").filter("start_key IS NOT NULL")
    sent = _per_program(owned.withColumn("protocol", F.substring("cls", 1, 3)), ["protocol"], F.sum("size"))
    return sent.filter("value > 0")


@query(ORACLE["hard_faults_by_program"])
def stream_state_hard_faults(t: Trace) -> DataFrame:
    """Faults by program of their thread: threads find their process by one state store, faults their thread by another."""

    def run(events: DataFrame, root: str) -> None:
        owned = stateful.process_owners(events, _DELAY, [], GRACE_NS)
        stateful.write_stream(owned, f"{root}/ck-pid", f"{root}/owned").awaitTermination()
        faults = stateful.thread_owners(stateful.read_stream(t.spark, f"{root}/owned"), events, _DELAY, ["hard_fault"], GRACE_NS)
        stateful.write_stream(faults, f"{root}/ck-tid", f"{root}/faults").awaitTermination()

    root = _in_store(t, [*LIFECYCLE, "hard_fault"], "owners", run)
    starts, facts = (t.spark.read.schema(stateful.OWNED).parquet(f"{root}/{n}") for n in ("owned", "faults"))
    return _per_program(starts.filter("cls = 'process_start'").unionByName(attribute.or_unknown(facts)), [], F.count(F.lit(1)))
