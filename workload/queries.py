"""Registered queries: each operator over the driver tables, with its SQL oracle where SQL can say it.

``QUERIES[name]`` is a function of (spark, sf_dir); ``ORACLE[name]`` the SQL.
"""

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracelake import functions as fn
from tracelake.functions import micros, pseudo_start_key
from tracelake.operators import attribute, entities, images, pairing, scrapes
from tracelake.operators.materialise import ensure_checkpoint_dir, materialise
from tracelake.operators.histogram import DURATION_BOUNDS_US, GAP_BOUNDS_MS, LATENCY_BOUNDS_US, cumulative, histogram, merge_histograms
from tracelake.plans import disk, interrupts, inventory, memory, network, registry_ops, threads
from tracelake.plans.families import samples
from tracelake.sources import dimensions
from tracelake.sources.events import classify, decode_events
from tracelake.sources.events import decode_errors as count_errors
from tracelake.sources.samples import exposition, histogram_samples
from tracelake.streaming import native
from tracelake.streaming.runner import StreamOptions, drain, run_stream
from tracelake.streaming.totals import stream_counters, stream_histograms
from workload import oracle as o
from workload.views import CHUNK_NS, DAY_NS, GRACE_NS, HOST, StreamTrace, Trace

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Callable[[Trace], DataFrame]], Callable[[Trace], DataFrame]]:
    def register(build: Callable[[Trace], DataFrame]) -> Callable[[Trace], DataFrame]:
        QUERIES[build.__name__] = lambda spark, sf_dir: build(Trace(spark, sf_dir))
        if sql is not None:
            ORACLE[build.__name__] = sql
        return build

    return register


# Entities -------------------------------------------------------------------------------------


@query(o.with_(o.K, o.PROC, select=f"""SELECT '{HOST}' AS host, pid, start_key, process_name, session_id, pe_checksum, end_ns,
    valid_from, valid_to FROM proc"""))
def process_intervals(t: Trace) -> DataFrame:
    return t.process_plan().select(
        "host", "pid", "start_key", "process_name", "session_id", "pe_checksum", "end_ns", "valid_from", "valid_to"
    )


@query(o.with_(o.K, o.PROC, o.THREAD, select=f"""SELECT '{HOST}' AS host, tid, pid, start_key, owner_known, end_ns, valid_from,
    valid_to, seq FROM thread"""))
def thread_intervals(t: Trace) -> DataFrame:
    return t.thread_plan().select("host", "tid", "pid", "start_key", "owner_known", "end_ns", "valid_from", "valid_to", "seq")


@query(o.with_(o.K, f"""
steps AS (SELECT seq, ts_ns, k, event_type, CASE event_type WHEN 'signup' THEN 1 ELSE -1 END AS step,
                 CASE WHEN k % 3 = 0 THEN 'a' || k || '.EXE' ELSE 'd' || k || '.sys' END AS image_name
          FROM k WHERE event_type IN ('signup', 'error')),
sums AS (SELECT *, sum(step) OVER (PARTITION BY k ORDER BY ts_ns, seq ROWS UNBOUNDED PRECEDING) AS total FROM steps),
refs AS (SELECT *, total - least(0, min(total) OVER (PARTITION BY k ORDER BY ts_ns, seq ROWS UNBOUNDED PRECEDING)) AS refs FROM sums),
dead AS (SELECT *, min(CASE WHEN step = -1 AND refs = 0 THEN ts_ns END)
             OVER (PARTITION BY k ORDER BY ts_ns, seq ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS unload_ns FROM refs)""",
    select=f"""SELECT '{HOST}' AS host, (k + 1) * 4096 AS base, k * 16 + 512 AS size, seq, image_name, unload_ns,
    ts_ns AS valid_from FROM dead WHERE step = 1 AND refs = 1"""))
def image_intervals(t: Trace) -> DataFrame:
    return entities.image_intervals(t.image_loads, t.image_unloads, CHUNK_NS).drop("valid_to")


@query(o.with_(o.K, f"""ps AS (SELECT * FROM k WHERE event_type = 'signup')""", select=f"""
    SELECT '{HOST}' AS host, tid AS start_key, arg_min(seq, (ts_ns, seq)) AS seq, min(ts_ns) AS ts_ns,
    arg_min(pid, (ts_ns, seq)) AS pid, max(ts_ns) AS last_seen_ns FROM ps GROUP BY tid"""))
def snapshot_merge(t: Trace) -> DataFrame:
    """Repeated sightings of an instance: here every start of a tid counts as the same key."""
    starts = t.process_starts.join(t.thread_starts.select("seq", "tid"), "seq")
    starts = starts.select("host", F.col("tid").alias("start_key"), "seq", "ts_ns", "pid")
    return entities.merge_snapshots(starts)


SERVICES = """
sdim AS (SELECT n_nationkey AS tag, n_name AS service_name FROM nation WHERE n_nationkey > 0 AND n_name <> '')"""
NAMED = """
named AS (SELECT thread.start_key, arg_min(sdim.service_name, (thread.valid_from, thread.seq)) AS service
          FROM thread JOIN sdim USING (tag) WHERE owner_known GROUP BY 1)"""


def _service_dim(t: Trace) -> DataFrame:
    return dimensions.service_dim(t.service_config)


@query(o.with_(o.K, o.PROC, o.THREAD, SERVICES, NAMED, select=f"""SELECT '{HOST}' AS host, start_key,
    coalesce(service, '') AS service_name FROM proc LEFT JOIN named USING (start_key)"""))
def resolve_services(t: Trace) -> DataFrame:
    return entities.resolve_services(t.processes, t.threads, _service_dim(t)).select("host", "start_key", "service_name")


RUNNING = """
running AS (SELECT s_suppkey % 40 + 4 AS pid, arg_max(n_name, s_suppkey) AS service FROM supplier JOIN nation ON s_nationkey = n_nationkey
            GROUP BY 1)"""


@query(o.with_(o.K, o.PROC, SERVICES, RUNNING, select=f"""SELECT '{HOST}' AS host, start_key,
    CASE WHEN valid_to = {o.OPEN} AND service IN (SELECT service_name FROM sdim) THEN service ELSE '' END AS service_name
    FROM proc LEFT JOIN running USING (pid)"""))
def enrich_running(t: Trace) -> DataFrame:
    running = dimensions.running_services(t.running_snapshot)
    return entities.enrich_running(t.processes, running, _service_dim(t)).select("host", "start_key", "service_name")


@query(o.with_(o.K, o.PROC, """
loads AS (SELECT seq, ts_ns, pid, tid % 5 AS checksum, 'C:\\bin\\a' || k || '.EXE' AS path FROM k WHERE event_type = 'signup' AND k % 3 = 0),
ownl AS (SELECT l.*, p.start_key FROM loads l JOIN proc p ON p.pid = l.pid AND p.valid_from <= l.ts_ns AND l.ts_ns < p.valid_to),
found AS (SELECT start_key, arg_min(checksum, (ts_ns, seq)) FILTER (WHERE checksum <> 0) AS checksum,
                 arg_min(path, (ts_ns, seq)) AS path FROM ownl GROUP BY 1)""", select=f"""SELECT '{HOST}' AS host, start_key,
    coalesce(path, process_name) AS process_name, coalesce(found.checksum, 0) AS pe_checksum FROM proc LEFT JOIN found USING (start_key)"""))
def enrich_programs(t: Trace) -> DataFrame:
    bare = t.processes.withColumn("pe_checksum", F.lit(0).cast("bigint"))
    return entities.enrich_programs(bare, t.image_loads, CHUNK_NS).select("host", "start_key", "process_name", "pe_checksum")


CLEANED = f"cleaned AS (SELECT * FROM proc WHERE expires_ns <= {20 * DAY_NS})"


def _cleaned(t: Trace) -> DataFrame:
    return t.processes.filter(F.col("expires_ns") <= 20 * DAY_NS)


@query(o.with_(o.K, o.PROC, o.THREAD, CLEANED, select=f"""SELECT '{HOST}' AS host, tid, seq, start_key FROM thread
    WHERE start_key NOT IN (SELECT start_key FROM cleaned)"""))
def expire_threads(t: Trace) -> DataFrame:
    return entities.expire_threads(t.threads, _cleaned(t)).select("host", "tid", "seq", "start_key")


@query(o.with_(o.K, o.PROC, CLEANED, f"""
current AS (SELECT pid, arg_max(start_key, (valid_from, seq)) AS start_key FROM proc GROUP BY 1)""", select=f"""
    SELECT '{HOST}' AS host, pid, start_key FROM current WHERE start_key NOT IN (SELECT start_key FROM cleaned)"""))
def expire_mappings(t: Trace) -> DataFrame:
    """The pid mappings (latest instance per pid) that survive the clean-up."""
    mapping = t.processes.groupBy("host", "pid").agg(F.max_by("start_key", F.struct("valid_from", "seq")).alias("start_key"))
    return entities.expire_mappings(mapping, _cleaned(t), "pid")


@query(o.with_(o.K, o.PROC, select=f"""SELECT '{HOST}' AS host, start_key, process_name FROM proc
    WHERE regexp_matches(process_name, 'app[0-2]|^app5')"""))
def filter_programs(t: Trace) -> DataFrame:
    return entities.filter_programs(t.processes, ["app[0-2]", "^app5", "app(["]).select("host", "start_key", "process_name")


AT = 15 * DAY_NS


def _count_sql(source: str, entity: str, end: str) -> str:
    kept = f"valid_from <= {AT} AND {AT} < valid_to"
    over = f"coalesce({end} <= {AT}, false)"
    return f"""SELECT '{HOST}' AS host, '{entity}' AS entity, count(*) FILTER (WHERE {kept} AND NOT {over}) AS live,
    count(*) FILTER (WHERE {kept} AND {over}) AS terminated FROM {source}"""


@query(o.with_(o.K, o.PROC, o.THREAD, SERVICES, f"""
parts AS (SELECT 0 AS valid_from, CASE WHEN p_partkey % 10 = 0 THEN {15 * DAY_NS} END AS unload_ns FROM part),
image AS (SELECT *, coalesce(unload_ns, {o.OPEN}) AS valid_to FROM parts)""", select=" UNION ALL ".join([
    _count_sql("proc", "process", "end_ns"), _count_sql("thread", "thread", "end_ns"), _count_sql("image", "image", "unload_ns"),
    f"SELECT '{HOST}', 'service', count(*), 0 FROM sdim"])))
def entity_counts(t: Trace) -> DataFrame:
    return entities.entity_counts(t.processes, t.threads, t.part_images, _service_dim(t), AT)


# Attribution ----------------------------------------------------------------------------------


@query(o.with_(o.K, o.PROC, select=f"""SELECT f.seq, p.start_key FROM k f LEFT JOIN proc p ON p.pid = f.pid
    AND p.valid_from <= f.ts_ns AND f.ts_ns < p.valid_to WHERE f.event_type = 'purchase'"""))
def attribute_by_pid(t: Trace) -> DataFrame:
    facts = t.disk.withColumn("pid", F.col("header_pid"))
    return attribute.attribute_by_pid(facts, t.processes, **t.options).select("seq", "start_key")


@query(o.with_(o.K, o.PROC, o.THREAD, select=f"""SELECT f.seq, p.start_key FROM k f LEFT JOIN thread p ON p.tid = f.tid
    AND p.valid_from <= f.ts_ns AND f.ts_ns < p.valid_to WHERE f.event_type = 'error'"""))
def attribute_by_tid(t: Trace) -> DataFrame:
    return attribute.attribute_by_tid(t.faults, t.threads, **t.options).select("seq", "start_key")


@query(o.with_(o.K, o.PROC, o.THREAD, o.DISK, select="SELECT seq, start_key, attribution FROM owned"))
def disk_attribution(t: Trace) -> DataFrame:
    moved = t.disk.filter("operation <> 'flush'")
    return attribute.attribute_disk(moved, t.threads, t.processes, **t.options).select("seq", "start_key", "attribution")


@query(o.with_(o.IMAGES, f"""
addr AS (SELECT (l_partkey + 1) * 4096 + l_orderkey * 37 % 4096 AS address FROM lineitem)""", select=f"""SELECT '{HOST}' AS host,
    coalesce(image_name, 'unknown') AS image_name, count(*) AS n FROM addr LEFT JOIN img
    ON address // 4096 = base // 4096 AND address >= base AND address < base + size GROUP BY 2"""))
def address_images(t: Trace) -> DataFrame:
    resolved = images.resolve_images(t.item_addresses, t.part_images, **t.options)
    return resolved.groupBy("host", F.coalesce("image_name", F.lit("unknown")).alias("image_name")).agg(F.count(F.lit(1)).alias("n"))


# Disk -----------------------------------------------------------------------------------------


@query(o.with_(o.K, o.PROC, o.THREAD, o.PROGRAMS, o.DISK,
               select=o.by_program("owned", "disk, operation", "count(*) AS operations, CAST(sum(size) AS BIGINT) AS bytes")))
def disk_by_program(t: Trace) -> DataFrame:
    return disk.disk_by_program(t.disk, t.threads, t.processes, **t.options)


@query(o.with_(o.K, """
disk AS (SELECT k % 4 AS disk, CASE WHEN k % 10 = 9 THEN 'flush' WHEN seq % 2 = 1 THEN 'write' ELSE 'read' END AS operation
         FROM k WHERE event_type = 'purchase'),
ops(operation) AS (VALUES ('read'), ('write'), ('flush'))""", select=f"""SELECT '{HOST}' AS host, d.disk, ops.operation,
    (SELECT count(*) FROM disk WHERE disk.disk = d.disk AND disk.operation = ops.operation) AS value
    FROM (SELECT DISTINCT disk FROM disk) d CROSS JOIN ops"""))
def disk_operations(t: Trace) -> DataFrame:
    return disk.disk_operations(t.disk)


@query(o.with_(o.K, """
disk AS (SELECT k % 4 AS disk, size, CASE WHEN k % 10 = 9 THEN 'flush' WHEN seq % 2 = 1 THEN 'write' ELSE 'read' END AS operation
         FROM k WHERE event_type = 'purchase')""", select=f"""SELECT '{HOST}' AS host, disk,
    CAST(coalesce(sum(size) FILTER (WHERE operation = 'read'), 0) AS BIGINT) AS read_bytes,
    CAST(coalesce(sum(size) FILTER (WHERE operation = 'write'), 0) AS BIGINT) AS written_bytes FROM disk GROUP BY disk"""))
def disk_bytes(t: Trace) -> DataFrame:
    return disk.disk_totals(t.disk).select("host", "disk", "read_bytes", "written_bytes")


DISK_DIM = """
lg AS (SELECT n_regionkey AS disk, arg_max(n_name[1] || ':', n_nationkey) AS drive_letter,
              arg_max(CASE WHEN n_nationkey % 4 <> 0 THEN 'NTFS' ELSE 'Unknown' END, n_nationkey) AS file_system FROM nation GROUP BY 1),
ddim AS (SELECT r_regionkey AS disk, r_name AS manufacturer, drive_letter, file_system FROM region FULL JOIN lg ON r_regionkey = lg.disk)"""


@query(o.with_(DISK_DIM, select=f"SELECT '{HOST}' AS host, CAST(disk AS BIGINT) AS disk, manufacturer, drive_letter, file_system FROM ddim"))
def disk_dim(t: Trace) -> DataFrame:
    return dimensions.disk_dim(t.physical_disks, t.logical_disks)


@query(o.with_(DISK_DIM, select=f"SELECT '{HOST}' AS host, CAST(disk AS BIGINT) AS disk, manufacturer, 1 AS value FROM ddim WHERE manufacturer IS NOT NULL"))
def disk_physical_info(t: Trace) -> DataFrame:
    return inventory.disk_physical_info(dimensions.disk_dim(t.physical_disks, t.logical_disks))


@query(o.with_(DISK_DIM, select=f"SELECT '{HOST}' AS host, CAST(disk AS BIGINT) AS disk, drive_letter, file_system, 1 AS value FROM ddim WHERE file_system IS NOT NULL"))
def disk_logical_info(t: Trace) -> DataFrame:
    return inventory.disk_logical_info(dimensions.disk_dim(t.physical_disks, t.logical_disks))


@query(o.with_(o.K, DISK_DIM, """
moved AS (SELECT k % 4 AS disk, count(*) AS n FROM k WHERE event_type = 'purchase' GROUP BY 1)""", select=f"""
    SELECT '{HOST}' AS host, moved.disk, n, manufacturer, drive_letter, file_system FROM moved LEFT JOIN ddim ON moved.disk = ddim.disk"""))
def disk_with_info(t: Trace) -> DataFrame:
    counts = t.disk.groupBy("host", "disk").agg(F.count(F.lit(1)).alias("n"))
    return disk.with_disk_info(counts, dimensions.disk_dim(t.physical_disks, t.logical_disks))


@query(o.with_(SERVICES, select=f"SELECT '{HOST}' AS host, CAST(tag AS BIGINT) AS tag, service_name FROM sdim"))
def service_dim(t: Trace) -> DataFrame:
    return _service_dim(t)


@query(o.with_(RUNNING, select=f"SELECT '{HOST}' AS host, pid, service AS service_name FROM running"))
def running_services(t: Trace) -> DataFrame:
    return dimensions.running_services(t.running_snapshot)


# Network --------------------------------------------------------------------------------------

_MOVED = ", ".join(
    f"CAST(sum(CASE WHEN kind = '{kind}' THEN size ELSE 0 END) AS BIGINT) AS {name}"
    for kind, name in (("send", "sent_bytes"), ("recv", "received_bytes"))
)


@query(o.with_(o.K, o.PROC, o.PROGRAMS, o.NET, "moved AS (SELECT * FROM netown WHERE kind IN ('send', 'recv'))",
               select=o.by_program("moved", "protocol", _MOVED)))
def network_bytes_by_program(t: Trace) -> DataFrame:
    return network.network_bytes(t.network, t.processes, **t.options)


@query(o.with_(o.K, o.PROC, o.NET, select=f"""SELECT '{HOST}' AS host, protocol, {_MOVED} FROM netown
    WHERE kind IN ('send', 'recv') GROUP BY protocol"""))
def network_totals(t: Trace) -> DataFrame:
    return network.network_totals(t.network, t.processes, **t.options)


@query(o.with_(o.K, o.PROC, o.PROGRAMS, o.NET, "conn AS (SELECT * FROM netown WHERE kind IN ('connect', 'accept'))",
               select=o.by_program("conn", "protocol", "count(*) FILTER (WHERE kind = 'connect') AS attempted, count(*) FILTER (WHERE kind = 'accept') AS accepted")))
def connections(t: Trace) -> DataFrame:
    return network.connections(t.network, t.processes, **t.options)


@query(o.with_(o.K, o.PROC, o.PROGRAMS, o.NET, """
failed AS (SELECT n.*, p.start_key FROM net n JOIN proc p ON p.pid = 4 AND p.valid_from <= n.ts_ns AND n.ts_ns < p.valid_to WHERE kind = 'fail')""",
               select=o.by_program("failed", "protocol, address_family, failure_code", "count(*) AS value")))
def connections_failed(t: Trace) -> DataFrame:
    return network.connections_failed(t.network, t.processes, **t.options)


@query(o.with_(o.K, o.PROC, o.PROGRAMS, o.NET, "again AS (SELECT * FROM netown WHERE kind = 'retransmit')",
               select=o.by_program("again", "", "count(*) AS value")))
def retransmissions(t: Trace) -> DataFrame:
    return network.retransmissions(t.network, t.processes, **t.options)


# Threads --------------------------------------------------------------------------------------


@query(o.with_(o.K, select=f"SELECT '{HOST}' AS host, cpu, count(*) AS value FROM k WHERE event_type = 'click' GROUP BY cpu"))
def cswitch_per_cpu(t: Trace) -> DataFrame:
    return threads.cswitch_per_cpu(t.cswitch)


@query(o.with_(o.K, o.PROC, o.THREAD, o.PROGRAMS, """
sw AS (SELECT f.seq, p.start_key FROM k f JOIN thread p ON p.tid = f.tid AND p.valid_from <= f.ts_ns AND f.ts_ns < p.valid_to
       WHERE f.event_type = 'click')""", select=o.by_program("sw", "", "count(*) AS value")))
def cswitch_by_program(t: Trace) -> DataFrame:
    return threads.cswitch_by_program(t.cswitch, t.threads, t.processes, **t.options)


GAPS = """
lagged AS (SELECT seq, cpu, ts_ns, ts_ns - lag(ts_ns) OVER (PARTITION BY cpu ORDER BY ts_ns, seq) AS gap_ns FROM k WHERE event_type = 'click'),
gaps AS (SELECT *, gap_ns // 1000 AS us, gap_ns / 1000000.0::DOUBLE AS ms FROM lagged WHERE gap_ns > 0)"""


@query(o.with_(o.K, GAPS, select=f"SELECT '{HOST}' AS host, cpu, ts_ns, seq, gap_ns FROM gaps"))
def switch_gaps(t: Trace) -> DataFrame:
    return pairing.switch_gaps(t.cswitch, CHUNK_NS)


_cte, _select = o.cumulative_sql("gaps", ["cpu"], o.BOUNDS_GAP_MS, "us", "log2", "gap_ns")


@query(o.with_(o.K, GAPS, _cte, select=_select))
def cswitch_gap_histogram(t: Trace) -> DataFrame:
    return cumulative(threads.cswitch_intervals(t.cswitch, chunk_ns=CHUNK_NS), GAP_BOUNDS_MS)


_cte, _select = o.cumulative_sql("gaps", ["cpu"], o.BOUNDS_GAP_MS, "ms", "first_ge", "gap_ns")


@query(o.with_(o.K, GAPS, _cte, select=_select))
def cswitch_gap_histogram_upper(t: Trace) -> DataFrame:
    return cumulative(threads.cswitch_intervals(t.cswitch, "upper", CHUNK_NS), GAP_BOUNDS_MS)


_REASONS = ", ".join(f"'{r}'" for r in (
    "Executive FreePage PageIn PoolAllocation DelayExecution Suspended UserRequest WrExecutive WrFreePage WrPageIn WrPoolAllocation "
    "WrDelayExecution WrSuspended WrUserRequest WrEventPair WrQueue WrLpcReceive WrLpcReply WrVirtualMemory WrPageOut WrRendezvous "
    "WrKeyedEvent WrTerminated WrProcessInSwap WrCpuRateControl WrCalloutStack WrKernel WrResource WrPushLock WrMutex WrQuantumEnd "
    "WrDispatchInt WrPreempted WrYieldExecution WrFastMutex WrGuardedMutex WrRundown MaximumWaitReason"
).split())


@query(o.with_(o.K, f"""
states AS (SELECT 'waiting' AS state, [{_REASONS}][1 + k % 45] AS wait_reason FROM k WHERE event_type = 'click' AND k % 45 < 38
           UNION ALL SELECT CASE event_type WHEN 'click' THEN 'running' WHEN 'view' THEN 'ready' WHEN 'signup' THEN 'created' ELSE 'terminated' END, 'none'
           FROM k WHERE event_type IN ('click', 'view', 'signup', 'error'))""",
    select=f"SELECT '{HOST}' AS host, state, wait_reason, count(*) AS value FROM states GROUP BY state, wait_reason"))
def thread_states(t: Trace) -> DataFrame:
    return threads.thread_states(t.cswitch, t.ready, t.thread_starts, t.thread_ends)


# Interrupts -----------------------------------------------------------------------------------


@query(o.with_(o.K, o.DPC, select=f"SELECT '{HOST}' AS host, cpu, seq, ts_ns, end_ns, duration_ns // 1000 AS duration_us FROM dpc"))
def dpc_durations(t: Trace) -> DataFrame:
    return interrupts.dpc_durations(t.dpc, t.cswitch, CHUNK_NS).select("host", "cpu", "seq", "ts_ns", "end_ns", "duration_us")


@query(o.with_(o.K, o.DPC, select=f"""SELECT '{HOST}' AS host, (SELECT count(*) FROM k WHERE event_type = 'view') AS queued,
    (SELECT count(*) FROM dpc) AS executed"""))
def dpc_counts(t: Trace) -> DataFrame:
    return interrupts.dpc_counts(t.isr, t.dpc, t.cswitch, chunk_ns=CHUNK_NS)


@query(o.with_(o.K, o.DPC, """
q AS (SELECT cpu, count(*) AS queued FROM k WHERE event_type = 'view' GROUP BY cpu),
e AS (SELECT cpu, count(*) AS executed FROM dpc GROUP BY cpu)""", select=f"""SELECT '{HOST}' AS host, coalesce(q.cpu, e.cpu) AS cpu,
    coalesce(queued, 0) AS queued, coalesce(executed, 0) AS executed FROM q FULL JOIN e ON q.cpu = e.cpu"""))
def dpc_counts_cpu(t: Trace) -> DataFrame:
    return interrupts.dpc_counts(t.isr, t.dpc, t.cswitch, per_cpu=True, chunk_ns=CHUNK_NS)


@query(o.with_(o.K, o.DPC, f"""
q AS (SELECT cpu, ts_ns // {DAY_NS} AS window_id, count(*) AS queued FROM k WHERE event_type = 'view' GROUP BY 1, 2),
e AS (SELECT cpu, end_ns // {DAY_NS} AS window_id, count(*) AS executed FROM dpc GROUP BY 1, 2),
b AS (SELECT coalesce(q.cpu, e.cpu) AS cpu, coalesce(q.window_id, e.window_id) AS window_id, coalesce(queued, 0) AS queued,
             coalesce(executed, 0) AS executed FROM q FULL JOIN e ON q.cpu = e.cpu AND q.window_id = e.window_id)""",
    select=f"SELECT '{HOST}' AS host, cpu, window_id, queued, executed, (queued - executed) / {DAY_NS / 1e9}::DOUBLE AS pressure FROM b"))
def dpc_pressure(t: Trace) -> DataFrame:
    return interrupts.dpc_pressure(t.isr, t.dpc, t.cswitch, DAY_NS, CHUNK_NS)


@query(o.with_(o.K, o.PAIRS, select=f"SELECT '{HOST}' AS host, * FROM pairs"))
def isr_dpc_pairs(t: Trace) -> DataFrame:
    finalised = materialise(pairing.finalised_dpcs(t.dpc, t.cswitch, CHUNK_NS))
    return pairing.pair_isr_dpc(t.isr, finalised, chunk_ns=CHUNK_NS)


@query(o.with_(o.K, o.PAIRS, select=f"SELECT '{HOST}' AS host, * FROM pairs WHERE latency_ns <= 10000000"))
def isr_dpc_pairs_aged(t: Trace) -> DataFrame:
    finalised = materialise(pairing.finalised_dpcs(t.dpc, t.cswitch, CHUNK_NS))
    return pairing.pair_isr_dpc(t.isr, finalised, max_isr_age_ms=10, chunk_ns=CHUNK_NS)


_cte, _select = o.cumulative_sql("lat", [], o.BOUNDS_LATENCY, "us", "first_ge", "us")


@query(o.with_(o.K, o.PAIRS, "lat AS (SELECT latency_ns // 1000 AS us FROM pairs)", _cte, select=_select))
def isr_dpc_latency(t: Trace) -> DataFrame:
    return cumulative(interrupts.isr_dpc_latency(t.isr, t.dpc, t.cswitch, chunk_ns=CHUNK_NS), LATENCY_BOUNDS_US)


ROUTINES = f"""
calls AS (SELECT end_ns, duration_ns // 1000 AS us, (seq * 7919 % 2000 + 1) * 4096 + seq * 37 % 2048 AS address FROM dpc),
hits AS (SELECT c.us, c.end_ns, i.image_name FROM calls c JOIN img i ON c.address // 4096 = i.base // 4096 AND c.address < i.base + i.size
         AND (i.unload_ns IS NULL OR c.end_ns < i.unload_ns)),
gone AS (SELECT image_name, max(unload_ns) AS gone_ns FROM img WHERE unload_ns IS NOT NULL GROUP BY 1),
fresh AS (SELECT hits.* FROM hits LEFT JOIN gone USING (image_name) WHERE gone_ns IS NULL OR end_ns > gone_ns)"""
_cte, _select = o.cumulative_sql("fresh", ["image_name"], o.BOUNDS_DURATION, "us", "first_ge", "us")


@query(o.with_(o.K, o.DPC, o.IMAGES, ROUTINES, _cte, select=_select))
def dpc_duration_by_image(t: Trace) -> DataFrame:
    durations = interrupts.dpc_durations(t.dpc, t.cswitch, CHUNK_NS)
    return cumulative(interrupts.dpc_duration_by_image(durations, t.part_images, dpc=t.dpc, **t.options), DURATION_BOUNDS_US)


_cte, _select = o.cumulative_sql("hits", ["image_name"], o.BOUNDS_DURATION, "us", "first_ge", "us")


@query(o.with_(o.K, o.DPC, o.IMAGES, ROUTINES, _cte, select=_select))
def dpc_duration_by_image_unpruned(t: Trace) -> DataFrame:
    durations = interrupts.dpc_durations(t.dpc, t.cswitch, CHUNK_NS)
    h = interrupts.dpc_duration_by_image(durations, t.part_images, prune_unloaded=False, **t.options)
    return cumulative(h, DURATION_BOUNDS_US)


_cte, _select = o.cumulative_sql("gaps", ["cpu"], o.BOUNDS_GAP_MS, "us", "log2", "gap_ns")


@query(o.with_(o.K, GAPS, _cte, select=_select))
def histogram_merge(t: Trace) -> DataFrame:
    """Histograms of two halves of the gaps, merged, equal the histogram of all gaps."""
    gaps = pairing.switch_gaps(t.cswitch, CHUNK_NS)
    halves = [
        histogram(gaps.filter(F.col("ts_ns") < AT if early else F.col("ts_ns") >= AT), micros(F.col("gap_ns")),
                  ["host", "cpu"], GAP_BOUNDS_MS, "log2", F.col("gap_ns"))
        for early in (True, False)
    ]
    return cumulative(merge_histograms(*halves, ["host", "cpu"], GAP_BOUNDS_MS), GAP_BOUNDS_MS)


# Memory, registry, processes ------------------------------------------------------------------


@query(o.with_(o.K, select=f"SELECT '{HOST}' AS host, count(*) AS value FROM k WHERE event_type = 'error'"))
def hard_faults(t: Trace) -> DataFrame:
    return memory.hard_faults(t.faults)


@query(o.with_(o.K, o.PROC, o.THREAD, o.PROGRAMS, """
hf AS (SELECT f.seq, coalesce(p.start_key, 1) AS start_key FROM k f LEFT JOIN thread p ON p.tid = f.tid AND p.valid_from <= f.ts_ns
       AND f.ts_ns < p.valid_to WHERE f.event_type = 'error')""", select=o.by_program("hf", "", "count(*) AS value")))
def hard_faults_by_program(t: Trace) -> DataFrame:
    return memory.hard_faults_by_program(t.faults, t.threads, t.processes, **t.options)


@query(o.with_(o.K, o.PROC, o.REG, select=f"SELECT '{HOST}' AS host, operation, result, count(*) AS value FROM reg GROUP BY operation, result"))
def registry_totals(t: Trace) -> DataFrame:
    return registry_ops.registry_totals(t.registry, t.processes, **t.options)


@query(o.with_(o.K, o.PROC, o.PROGRAMS, o.REG, select=o.by_program("reg", "operation, result", "count(*) AS value")))
def registry_by_program(t: Trace) -> DataFrame:
    return registry_ops.registry_by_program(t.registry, t.processes, **t.options)


@query(o.with_(o.K, o.PROC, o.PROGRAMS, select=f"SELECT DISTINCT '{HOST}' AS host, {o.PROGRAM_COLUMNS}, 1 AS value FROM programs"))
def process_info(t: Trace) -> DataFrame:
    return inventory.process_info(t.processes)


@query(o.with_(o.K, o.PROC, o.THREAD, f"""
pid_names AS (SELECT valid_from // {DAY_NS} AS interval, pid, count(*) AS n, arg_max(process_name, (valid_from, seq)) AS name FROM proc GROUP BY 1, 2),
p AS (SELECT interval, CAST(sum(n) AS BIGINT) AS new_processes, string_agg(pid || '-' || name, ',' ORDER BY pid || '-' || name) AS processes
      FROM pid_names GROUP BY 1),
th AS (SELECT valid_from // {DAY_NS} AS interval, count(*) AS new_threads FROM thread WHERE owner_known GROUP BY 1),
b AS (SELECT coalesce(p.interval, th.interval) AS interval, coalesce(new_processes, 0) AS new_processes,
             coalesce(new_threads, 0) AS new_threads, 0 AS services_enriched, coalesce(processes, '') AS processes
      FROM p FULL JOIN th ON p.interval = th.interval)""",
    select=f"SELECT '{HOST}' AS host, * FROM b WHERE ((SELECT max(interval) FROM b) - interval) < 10"))
def interval_diagnostics(t: Trace) -> DataFrame:
    return inventory.interval_diagnostics(t.processes, t.threads, DAY_NS, 10 * DAY_NS)


# Scrapes --------------------------------------------------------------------------------------

THRESHOLDS = """
gapped AS (SELECT *, ts_ns - lag(ts_ns) OVER (ORDER BY scrape_id) AS gap_ns FROM scrapes),
means AS (SELECT *, sum(gap_ns) OVER w // nullif(count(gap_ns) OVER w, 0) AS mean_gap_ns FROM gapped
          WINDOW w AS (ORDER BY scrape_id ROWS 3 PRECEDING)),
graced AS (SELECT *, CASE WHEN mean_gap_ns > 0 THEN greatest(1, CAST(ceil(200000000 / mean_gap_ns::DOUBLE) AS BIGINT)) ELSE 1 END AS grace FROM means),
limits AS (SELECT *, CASE WHEN gap_ns > 400000000 THEN scrape_id WHEN scrape_id > grace THEN scrape_id - grace ELSE 0 END AS threshold FROM graced)"""


@query(o.with_(o.K, o.SCRAPES, THRESHOLDS, select=f"""SELECT '{HOST}' AS host, ts_ns, scrape_id, gap_ns, CAST(mean_gap_ns AS BIGINT) AS mean_gap_ns,
    grace, threshold FROM limits"""))
def cleanup_thresholds(t: Trace) -> DataFrame:
    return scrapes.cleanup_thresholds(t.scrapes, min_grace_s=0.2)


@query(o.with_(o.K, o.PROC, o.SCRAPES, THRESHOLDS, """
aged AS (SELECT start_key, end_ns, CASE WHEN end_ns IS NOT NULL THEN (SELECT count(*) FROM scrapes WHERE scrapes.ts_ns <= end_ns) END AS generation FROM proc)""",
    select=f"""SELECT '{HOST}' AS host, start_key, generation,
    (SELECT min(scrape_id) FROM limits WHERE limits.threshold > aged.generation AND limits.scrape_id > aged.generation) AS cleaned_scrape FROM aged"""))
def cleaned_at(t: Trace) -> DataFrame:
    return scrapes.cleaned_at(t.processes, t.scrapes, min_grace_s=0.2).select("host", "start_key", "generation", "cleaned_scrape")


@query(o.with_(o.K, o.PROC, o.SCRAPES, THRESHOLDS, """
aged AS (SELECT *, CASE WHEN end_ns IS NOT NULL THEN (SELECT count(*) FROM scrapes WHERE scrapes.ts_ns <= end_ns) END AS generation FROM proc),
gone AS (SELECT *, (SELECT min(scrape_id) FROM limits WHERE limits.threshold > aged.generation AND limits.scrape_id > aged.generation) AS cleaned_scrape FROM aged)""",
    select=f"""SELECT '{HOST}' AS host, cleaned_scrape, count(*) AS cleaned,
    string_agg(start_key || '-' || pid || '-' || process_name, ',' ORDER BY start_key || '-' || pid || '-' || process_name) AS processes
    FROM gone WHERE cleaned_scrape IS NOT NULL GROUP BY cleaned_scrape"""))
def cleaned_processes(t: Trace) -> DataFrame:
    return inventory.cleaned_processes(scrapes.cleaned_at(t.processes, t.scrapes, min_grace_s=0.2))


def _levels(deltas: str) -> str:
    return f"""
steps AS (SELECT d.disk, (SELECT min(scrape_id) FROM scrapes WHERE scrapes.ts_ns >= d.ts_ns) AS scrape_id, d.value FROM {deltas} d),
sums AS (SELECT disk, scrape_id, sum(value) AS step FROM steps WHERE scrape_id IS NOT NULL GROUP BY 1, 2),
first AS (SELECT disk, min(scrape_id) AS scrape_id FROM sums GROUP BY 1),
dense AS (SELECT f.disk, s.scrape_id, coalesce(sums.step, 0) AS step FROM first f JOIN scrapes s ON s.scrape_id >= f.scrape_id
          LEFT JOIN sums ON sums.disk = f.disk AND sums.scrape_id = s.scrape_id)"""


_LEVEL_SELECT = f"""SELECT '{HOST}' AS host, disk, scrape_id, CAST(sum(step) OVER (PARTITION BY disk ORDER BY scrape_id) AS BIGINT) AS value FROM dense"""
_DELTAS = "deltas AS (SELECT disk, ts_ns, 1 AS value FROM disk)"
_EXPIRING = """
deltas AS (SELECT disk, ts_ns, 1 AS value FROM owned WHERE start_key IS NOT NULL
           UNION ALL SELECT disk, expires_ns, -1 FROM owned JOIN proc USING (start_key) WHERE expires_ns < 9223372036854775807)"""


@query(o.with_(o.K, o.SCRAPES, "disk AS (SELECT k % 4 AS disk, ts_ns FROM k WHERE event_type = 'purchase')", _DELTAS, _levels("deltas"), select=_LEVEL_SELECT))
def counter_snapshots(t: Trace) -> DataFrame:
    deltas = t.disk.select("host", "ts_ns", "disk", F.lit(1).alias("value"))
    return scrapes.snapshot_counters(deltas, t.scrapes, ["disk"], every_scrape=True, **t.options)


@query(o.with_(o.K, o.PROC, o.THREAD, o.SCRAPES, o.DISK, _EXPIRING, _levels("deltas"), select=_LEVEL_SELECT))
def counter_snapshots_expiring(t: Trace) -> DataFrame:
    """Counters that fall when an instance expires."""
    moved = t.disk.filter("operation <> 'flush'")
    owned = attribute.known_only(attribute.attribute_disk(moved, t.threads, t.processes, **t.options))
    deltas = owned.select("host", "start_key", "ts_ns", "disk", F.lit(1).alias("value"))
    return scrapes.snapshot_counters(
        deltas, t.scrapes, ["disk"], processes=t.processes, retain_expired=False, every_scrape=True, **t.options
    )


# Sources and samples --------------------------------------------------------------------------


@query(o.with_(o.K, select=f"""SELECT '{HOST}' AS host, seq, pid AS header_pid, k % 4 AS disk, size, tid AS issuing_tid,
    CASE WHEN seq % 2 = 1 THEN 'disk_write' ELSE 'disk_read' END AS cls FROM k WHERE event_type = 'purchase' AND seq % 97 <> 0"""))
def decode_disk(t: Trace) -> DataFrame:
    raw = classify(t.disk_payloads)
    decoded = decode_events(raw, "disk_read", "disk_write")
    return decoded.select("host", "seq", "header_pid", "disk", "size", "issuing_tid", "cls")


@query(o.with_(o.K, select=f"""SELECT '{HOST}' AS host, CASE WHEN seq % 2 = 1 THEN 'disk_write' ELSE 'disk_read' END AS cls,
    count(*) AS errors FROM k WHERE event_type = 'purchase' AND seq % 97 = 0 GROUP BY 2"""))
def decode_errors(t: Trace) -> DataFrame:
    return count_errors(classify(t.disk_payloads))


ROUTED = """
routed AS (SELECT seq, CASE event_type
    WHEN 'click' THEN 'cswitch'
    WHEN 'view' THEN CASE WHEN k % 20 + 10 IN (10, 26) THEN 'tcp_send' WHEN k % 20 + 10 IN (11, 27) THEN 'tcp_recv'
        WHEN k % 20 + 10 IN (12, 28) THEN 'tcp_connect' WHEN k % 20 + 10 = 15 THEN 'tcp_accept'
        WHEN k % 20 + 10 = 14 THEN 'tcp_retransmit' WHEN k % 20 + 10 = 17 THEN 'tcp_fail' END
    WHEN 'purchase' THEN CASE k % 5 + 10 WHEN 10 THEN 'disk_read' WHEN 11 THEN 'disk_write' WHEN 14 THEN 'disk_flush' END
    WHEN 'signup' THEN CASE k % 8 WHEN 1 THEN 'process_start' WHEN 2 THEN 'process_end' WHEN 3 THEN 'thread_start'
        WHEN 4 THEN 'thread_end' WHEN 5 THEN 'image_load' WHEN 6 THEN 'image_unload' END
    ELSE CASE WHEN k % 30 + 10 <= 33 THEN 'registry_op' END END AS cls, event_type FROM k),
named AS (SELECT *, CASE WHEN cls LIKE 'thread%' OR event_type = 'click' THEN 'thread-kernel' WHEN cls LIKE 'image%' THEN 'image-kernel'
    WHEN event_type = 'view' THEN 'microsoft-windows-kernel-network' WHEN event_type = 'purchase' THEN 'microsoft-windows-kernel-disk'
    WHEN event_type = 'signup' THEN 'microsoft-windows-kernel-process' ELSE 'microsoft-windows-kernel-registry' END AS provider FROM routed)"""


@query(o.with_(o.K, ROUTED, select=f"SELECT '{HOST}' AS host, cls, provider, count(*) AS n FROM named GROUP BY cls, provider"))
def event_classes(t: Trace) -> DataFrame:
    return classify(t.routed).groupBy("host", "cls", "provider").agg(F.count(F.lit(1)).alias("n"))


_PROVIDERS = ", ".join(f"('{p}')" for p in (
    "microsoft-windows-kernel-disk", "microsoft-windows-kernel-process", "thread-kernel", "microsoft-windows-kernel-file",
    "perfinfo-kernel", "system-config-kernel", "image-kernel", "pagefault-kernel", "microsoft-windows-kernel-network",
    "microsoft-windows-kernel-registry", "microsoft-windows-kernel-eventtracing",
))


@query(o.with_(o.K, ROUTED, f"names(provider) AS (VALUES {_PROVIDERS})", select=f"""SELECT '{HOST}' AS host, names.provider,
    count(named.seq) AS value FROM names LEFT JOIN named USING (provider) GROUP BY names.provider"""))
def events_received(t: Trace) -> DataFrame:
    return inventory.events_received(classify(t.routed))


def _fold_sql() -> str:
    """The 16 bytes hashed one after the other."""
    steps = []
    previous = "14695981039346656037::HUGEINT"
    shifts = [("ptr", 8 * i) for i in range(8)] + [("pid", 8 * i) for i in range(4)] + [("tid", 8 * i) for i in range(4)]
    for i, (name, shift) in enumerate(shifts):
        steps.append(f"h{i} AS (SELECT *, (xor({previous}, (({name} >> {shift}) & 255)::HUGEINT) * 1099511628211) % 18446744073709551616 AS v{i} FROM "
                     + ("src" if i == 0 else f"h{i - 1}") + ")")
        previous = f"v{i}"
    return ",".join(steps)


@query(o.with_(o.K, "src AS (SELECT seq, pid, tid, seq % 1000 AS ptr FROM k)", _fold_sql(), select="""SELECT seq, lower(printf('%x', CAST(v15 AS UBIGINT))) AS start_key
    FROM h15 WHERE ptr <> 0"""))
def start_keys(t: Trace) -> DataFrame:
    key = pseudo_start_key(F.col("pid"), F.col("tid"), F.col("seq") % 1000)
    keyed = t.k.select("seq", key.alias("key")).filter(F.col("key").isNotNull())
    return keyed.select("seq", F.lower(F.hex("key")).alias("start_key"))


@query(o.with_(o.K, select="""SELECT seq, ((tid % 100) << 48) | seq AS sequence_key, ((k % 2) << 24) | ((k % 3) << 16) | (size & 65535) AS failure_key,
    size & 65535 AS failure_code, '0x' || lower(to_hex(size)) AS label,
    CASE WHEN k % 3 = 0 THEN 'a' || k || '.EXE' ELSE 'b' || k || '.sys' END AS base, k % 3 = 0 AS exe, k % 2 = 0 AS full_path,
    ts_ns // 1000 AS us, ts_ns / 1000000.0::DOUBLE AS ms FROM k"""))
def scalar_functions(t: Trace) -> DataFrame:
    file_name = F.when(F.col("k") % 3 == 0, F.concat(F.lit("a"), F.col("k").cast("string"), F.lit(".EXE"))).otherwise(
        F.concat(F.lit("b"), F.col("k").cast("string"), F.lit(".sys"))
    )
    path = F.concat(F.when(F.col("k") % 2 == 0, F.lit("C:\\x\\")).otherwise(F.lit("/y/")), file_name)
    packed = fn.failure_key(F.col("k") % 2, F.col("k") % 3, F.col("size").bitwiseAND(F.lit(65535)))
    return t.k.select(
        "seq", fn.sequence_start_key(F.col("tid") % 100, F.col("seq")).alias("sequence_key"), packed.alias("failure_key"),
        fn.unpack_failure_key(packed)["failure_code"].alias("failure_code"), fn.hex_label(F.col("size")).alias("label"),
        fn.base_name(path).alias("base"), fn.is_exe(path).alias("exe"), fn.is_full_path(path).alias("full_path"),
        fn.micros(F.col("ts_ns")).alias("us"), fn.millis(F.col("ts_ns")).alias("ms"),
    )


def flat(samples: DataFrame) -> DataFrame:
    """Samples with the label map as text, for comparison."""
    pairs = F.array_sort(F.transform(F.map_entries("labels"), lambda e: F.concat(e["key"], F.lit("="), e["value"])))
    return samples.select("host", "metric", F.array_join(pairs, ",").alias("labels"), F.col("value"), "kind")


_FAULT_SAMPLES = o.with_(o.K, o.PROC, o.THREAD, o.PROGRAMS, """
hf AS (SELECT coalesce(p.start_key, 1) AS start_key FROM k f LEFT JOIN thread p ON p.tid = f.tid AND p.valid_from <= f.ts_ns
       AND f.ts_ns < p.valid_to WHERE f.event_type = 'error')""", select=f"""
    SELECT '{HOST}' AS host, 'memory_hard_pagefaults_total' AS metric, '' AS labels, CAST(count(*) AS DOUBLE) AS value, 'counter' AS kind FROM hf
    UNION ALL SELECT '{HOST}', 'memory_hard_pagefaults_per_process_total', 'pe_checksum=' || pe_checksum || ',process_name=' || process_name
      || ',service_name=' || service_name || ',session_id=' || session_id, CAST(count(*) AS DOUBLE), 'counter'
      FROM hf JOIN programs USING (start_key) GROUP BY pe_checksum, process_name, service_name, session_id
    UNION ALL SELECT DISTINCT '{HOST}', 'process_info', 'pe_checksum=' || pe_checksum || ',process_name=' || process_name
      || ',service_name=' || service_name || ',session_id=' || session_id, 1.0, 'gauge' FROM programs""")


@query(_FAULT_SAMPLES)
def family_samples(t: Trace) -> DataFrame:
    """Two families through the registry."""
    return flat(samples(t.context(), ["memory", "process"]))


_PROGRAM = ["process_name", "service_name", "pe_checksum", "session_id"]


def sample_sql(name: str, metric: str, labels: list[str], value: str, kind: str = "counter", where: str = "true") -> str:
    """Samples of a metric from the SQL of another query."""
    text = " || ',' || ".join(f"'{c}=' || {c}" for c in sorted(labels)) or "''"
    return (
        f"SELECT host, '{metric}' AS metric, {text} AS labels, CAST({value} AS DOUBLE) AS value, '{kind}' AS kind "
        f"FROM ({ORACLE[name]}) WHERE {where}"
    )


def histogram_sql(name: str, metric: str, labels: list[str], bounds: tuple, scale: float) -> str:
    names = ", ".join(f"({float(b)!r}::DOUBLE, 'le={b:.10g}')" for b in bounds)
    text = " || ',' || ".join(f"'{c}=' || {c}" for c in labels)
    with_le = f"{text} || ',' || text" if labels else "text"
    inf = f"{text} || ',le=+Inf'" if labels else "'le=+Inf'"
    plain = text or "''"
    rows = f"({ORACLE[name]})"
    return f"""SELECT host, '{metric}_bucket', {with_le}, CAST(bucket_count AS DOUBLE), 'histogram' FROM {rows} h
      JOIN (VALUES {names}) b(bound, text) ON h.le = b.bound
    UNION ALL SELECT DISTINCT host, '{metric}_bucket', {inf}, CAST(n AS DOUBLE), 'histogram' FROM {rows}
    UNION ALL SELECT DISTINCT host, '{metric}_sum', {plain}, total / {scale}::DOUBLE, 'histogram' FROM {rows}
    UNION ALL SELECT DISTINCT host, '{metric}_count', {plain}, CAST(n AS DOUBLE), 'histogram' FROM {rows}"""


ALL_SAMPLES = "\nUNION ALL ".join([
    sample_sql("disk_operations", "disk_io_operations_total", ["disk", "operation"], "value"),
    sample_sql("disk_bytes", "disk_read_bytes_total", ["disk"], "read_bytes"),
    sample_sql("disk_bytes", "disk_written_bytes_total", ["disk"], "written_bytes"),
    sample_sql("disk_by_program", "disk_process_io_operations_total", [*_PROGRAM, "disk", "operation"], "operations"),
    sample_sql("disk_by_program", "disk_process_read_bytes_total", [*_PROGRAM, "disk"], "bytes", where="operation = 'read' AND bytes > 0"),
    sample_sql("disk_by_program", "disk_process_written_bytes_total", [*_PROGRAM, "disk"], "bytes", where="operation = 'write' AND bytes > 0"),
    sample_sql("disk_physical_info", "system_disk_physical_info", ["disk", "manufacturer"], "value", "gauge"),
    sample_sql("disk_logical_info", "system_disk_logical_info", ["disk", "drive_letter", "file_system"], "value", "gauge"),
    sample_sql("cswitch_per_cpu", "thread_context_switches_cpu_total", ["cpu"], "value"),
    histogram_sql("cswitch_gap_histogram", "thread_context_switch_interval_milliseconds", ["cpu"], GAP_BOUNDS_MS, 1e6),
    sample_sql("thread_states", "thread_states_total", ["state", "wait_reason"], "value"),
    sample_sql("cswitch_by_program", "thread_context_switches_process_total", _PROGRAM, "value"),
    sample_sql("dpc_counts", "perfinfo_dpc_queued_total", [], "queued"),
    sample_sql("dpc_counts", "perfinfo_dpc_executed_total", [], "executed"),
    sample_sql("dpc_counts_cpu", "perfinfo_dpc_queued_cpu_total", ["cpu"], "queued"),
    sample_sql("dpc_counts_cpu", "perfinfo_dpc_executed_cpu_total", ["cpu"], "executed"),
    histogram_sql("isr_dpc_latency", "perfinfo_isr_to_dpc_latency_microseconds", [], LATENCY_BOUNDS_US, 1.0),
    sample_sql("network_bytes_by_program", "network_process_sent_bytes_total", [*_PROGRAM, "protocol"], "sent_bytes", where="sent_bytes > 0"),
    sample_sql("network_bytes_by_program", "network_process_received_bytes_total", [*_PROGRAM, "protocol"], "received_bytes", where="received_bytes > 0"),
    sample_sql("network_totals", "network_sent_bytes_total", ["protocol"], "sent_bytes", where="sent_bytes > 0"),
    sample_sql("network_totals", "network_received_bytes_total", ["protocol"], "received_bytes", where="received_bytes > 0"),
    sample_sql("connections", "network_process_connections_attempted_total", [*_PROGRAM, "protocol"], "attempted", where="attempted > 0"),
    sample_sql("connections", "network_process_connections_accepted_total", [*_PROGRAM, "protocol"], "accepted", where="accepted > 0"),
    sample_sql("connections_failed", "network_connections_failed_total", [*_PROGRAM, "protocol", "address_family", "failure_code"], "value"),
    sample_sql("retransmissions", "network_process_retransmissions_total", _PROGRAM, "value"),
    sample_sql("hard_faults", "memory_hard_pagefaults_total", [], "value"),
    sample_sql("hard_faults_by_program", "memory_hard_pagefaults_per_process_total", _PROGRAM, "value"),
    sample_sql("registry_totals", "registry_operations_total", ["operation", "result"], "value"),
    sample_sql("registry_by_program", "registry_operations_process_total", [*_PROGRAM, "operation", "result"], "value"),
    sample_sql("process_info", "process_info", _PROGRAM, "value", "gauge"),
])


@query(ALL_SAMPLES)
def all_family_samples(t: Trace) -> DataFrame:
    """Every family that the views can feed, with all switches on except per-driver series."""
    context = t.parsed_once().context(per_cpu=True, by_protocol=True, connection_stats=True, retransmissions=True)
    names = ["disk_io", "system", "threads", "interrupts", "network", "memory", "registry", "process"]
    return flat(samples(context, names))


@query(o.with_(o.K, GAPS, o.cumulative_sql("gaps", ["cpu"], o.BOUNDS_GAP_MS, "us", "log2", "gap_ns")[0], f"""
c AS (SELECT cpu, le, count(*) FILTER (WHERE us < threshold OR is_last) AS n FROM gaps CROSS JOIN bounds GROUP BY cpu, le),
h AS (SELECT 'gap_milliseconds' AS name)""", select=f"""
    SELECT '# TYPE ' || name || ' histogram' AS line FROM h
    UNION ALL SELECT 'gap_milliseconds_bucket{{host="{HOST}",cpu="' || cpu || '",le="' || le || '"}} ' || n FROM c
    UNION ALL SELECT 'gap_milliseconds_bucket{{host="{HOST}",cpu="' || cpu || '",le="+Inf"}} ' || count(*) FROM gaps GROUP BY cpu
    UNION ALL SELECT 'gap_milliseconds_sum{{host="{HOST}",cpu="' || cpu || '"}} ' || CAST(sum(gap_ns) AS BIGINT) FROM gaps GROUP BY cpu
    UNION ALL SELECT 'gap_milliseconds_count{{host="{HOST}",cpu="' || cpu || '"}} ' || count(*) FROM gaps GROUP BY cpu"""))
def exposition_text(t: Trace) -> DataFrame:
    """Text lines of a histogram; its sums are in nanoseconds here."""
    h = threads.cswitch_intervals(t.cswitch, chunk_ns=CHUNK_NS)
    return exposition(histogram_samples(h, "gap_milliseconds", ["cpu"], GAP_BOUNDS_MS))


# Streams --------------------------------------------------------------------------------------


def _streamed(t: Trace, classes: list[str], families: list[str]) -> str:
    """Run the families over the events as a stream to the end; returns where the results are."""
    root = f"{ensure_checkpoint_dir(t.spark)}/stream-{uuid.uuid4().hex}"
    options = StreamOptions(families=families, delay_ns=3 * DAY_NS, grace_ns=GRACE_NS, chunk_ns=CHUNK_NS)
    run_stream(StreamTrace(t.spark, t.sf_dir).wide(classes), root, f"{root}/out", options).awaitTermination()
    drain(t.spark, root, f"{root}/out", options)
    return f"{root}/out"


LIFECYCLE = ["process_start", "process_end", "thread_start", "thread_end"]


@query(o.with_(o.K, o.PROC, o.THREAD, o.PROGRAMS, o.DISK, select=o.by_program(
    "owned", "CAST(disk AS VARCHAR) AS disk, operation", "count(*) AS value")))
def stream_disk_by_program(t: Trace) -> DataFrame:
    """Attributed disk operations, summed over the slices of a stream."""
    out = _streamed(t, [*LIFECYCLE, "disk_read", "disk_write", "disk_flush"], ["disk_io"])
    return stream_counters(t.spark, out, "disk_process_io_operations_total", ["disk", "operation"], per_program=True)


_cte, _select = o.cumulative_sql("lat", [], o.BOUNDS_LATENCY, "us", "first_ge", "us")


@query(o.with_(o.K, o.PAIRS, "lat AS (SELECT latency_ns // 1000 AS us FROM pairs)", _cte, select=_select))
def stream_isr_dpc_latency(t: Trace) -> DataFrame:
    """Interrupt latency, paired across the slices of a stream."""
    out = _streamed(t, ["isr", "dpc", "cswitch"], ["interrupts"])
    h = stream_histograms(t.spark, out, "perfinfo_isr_to_dpc_latency_microseconds", ["host"], LATENCY_BOUNDS_US)
    return cumulative(h, LATENCY_BOUNDS_US)


def _upserted(t: Trace, aggregated: DataFrame, keys: list[str]) -> DataFrame:
    """Run a streaming aggregation to its end; the last row of each key. A batch writes only the groups it has changed."""
    root = f"{ensure_checkpoint_dir(t.spark)}/stream-{uuid.uuid4().hex}"

    def put(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{root}/table/batch={batch_id}")

    writer = aggregated.writeStream.outputMode("update").foreachBatch(put).option("checkpointLocation", f"{root}/ck")
    writer.trigger(availableNow=True).start().awaitTermination()
    values = [c for c in aggregated.columns if c not in keys]
    last = t.spark.read.parquet(f"{root}/table").groupBy(*keys).agg(F.max_by(F.struct(*values), "batch").alias("last"))
    return last.select(*keys, "last.*")


@query(o.with_(o.K, f"""
started AS (SELECT ts_ns // {DAY_NS} AS interval, pid || '-app' || (tid % 7) || '.exe' AS label FROM k WHERE event_type = 'signup')""",
    select=f"""SELECT '{HOST}' AS host, interval, count(*) AS new_processes, count(*) AS new_threads,
    string_agg(DISTINCT label, ',' ORDER BY label) AS processes FROM started GROUP BY interval"""))
def stream_interval_counts(t: Trace) -> DataFrame:
    """Per-interval diagnostics as a watermarked streaming aggregation. Here intervals are days of table time."""
    lifecycle = StreamTrace(t.spark, t.sf_dir).wide(["process_start", "thread_start"])
    timed = lifecycle.withColumn("ts", F.timestamp_seconds(fn.micros(F.col("ts_ns"))))
    counts = _upserted(t, native.interval_counts(timed, "1 day", "3 days"), ["host", "interval_start"])
    interval = F.unix_seconds("interval_start") / 86_400
    return counts.select("host", interval.cast("bigint").alias("interval"), "new_processes", "new_threads", "processes")


@query(o.with_(o.K, o.DPC, select=f"SELECT '{HOST}' AS host, cpu, count(*) AS value FROM k WHERE event_type = 'click' GROUP BY cpu"))
def stream_cswitch_per_cpu(t: Trace) -> DataFrame:
    """A stateless family function applied to a stream as it is."""
    return _upserted(t, threads.cswitch_per_cpu(StreamTrace(t.spark, t.sf_dir).cswitch), ["host", "cpu"])
