"""Entity tables: process instances, threads and images as rows with a validity interval.

Every fact is later attributed by an as-of join to these tables, so the tables hold the whole
lifecycle logic: id reuse, the grace after an end, unknown owners, reference counts, enrichment.
"""

from collections.abc import Sequence

from pyspark.errors import IllegalArgumentException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracelake.functions.names import INVALID_ID, SYSTEM_PID, TAGLESS_PROCESSES, UNKNOWN_PROCESS, UNKNOWN_START_KEY
from tracelake.functions.text import base_name, is_exe, is_full_path
from tracelake.functions.units import NS_PER_MS, NS_PER_S
from tracelake.operators.asof import OPEN_END, asof_join
from tracelake.operators.carry import CHUNK_NS, fill, neighbour_time, stack_depth

GRACE_NS = 30 * NS_PER_S
# A thread may look older than its process by less than this.
THREAD_SLACK_NS = NS_PER_MS

# Columns the start rows may lack or leave null, with what they then hold until enrichment.
_UNSET = {"parent_pid": "cast(null as bigint)", "service_name": "''", "pe_checksum": "0L"}

PROGRAM = ("process_name", "service_name", "pe_checksum", "session_id")


def normalise_session(session_id: Column, pid: Column) -> Column:
    """Session 0 where the id is the invalid marker or the process is System."""
    return F.when((session_id == INVALID_ID) | (pid == SYSTEM_PID), F.lit(0)).otherwise(session_id).cast("bigint")


def merge_snapshots(starts: DataFrame) -> DataFrame:
    """One row per (host, start_key): the first sighting, with the time of the last one."""
    fields = [c for c in starts.columns if c not in ("host", "start_key", "last_seen_ns")]
    seen = F.coalesce("last_seen_ns", "ts_ns") if "last_seen_ns" in starts.columns else F.col("ts_ns")
    return (
        starts.groupBy("host", "start_key")
        .agg(F.min_by(F.struct(*fields), F.struct("ts_ns", "seq")).alias("first"), F.max(seen).alias("last_seen_ns"))
        .select("host", "start_key", "first.*", "last_seen_ns")
    )


def process_intervals(
    starts: DataFrame, ends: DataFrame, grace_ns: int = GRACE_NS, chunk_ns: int = CHUNK_NS
) -> DataFrame:
    """Process instances and the time in which each one owns its pid.

    ``starts``: host, seq, ts_ns, start_key, pid, process_name, session_id (parent_pid, service_name and
    pe_checksum optional). ``ends``: host, seq, ts_ns and start_key or pid or both; an end without a key
    ends the instance that last started on its pid.
    An instance owns its pid from its start until the pid starts again or ``grace_ns`` after its end.
    """
    first = merge_snapshots(starts.filter(F.col("start_key").isNotNull()))
    keyed = ends.filter(F.col("start_key").isNotNull()) if "start_key" in ends.columns else None
    by_pid = None
    if "pid" in ends.columns:
        by_pid = ends if keyed is None else ends.filter(F.col("start_key").isNull())
    timed = _followed(first, by_pid, "pid", chunk_ns)
    if keyed is not None:
        ended = keyed.groupBy("host", "start_key").agg(F.min("ts_ns").alias("_keyed_end"))
        timed = timed.join(ended, ["host", "start_key"], "left")
        timed = timed.withColumn("end_ns", F.least("end_ns", "_keyed_end")).drop("_keyed_end")
    expires = F.coalesce(F.col("end_ns") + F.lit(grace_ns), F.lit(OPEN_END))
    return timed.select(
        "host",
        "pid",
        "start_key",
        "seq",
        *[(F.coalesce(c, F.expr(default)) if c in first.columns else F.expr(default)).alias(c) for c, default in _UNSET.items()],
        "process_name",
        normalise_session(F.col("session_id"), F.col("pid")).alias("session_id"),
        F.col("ts_ns").alias("create_ns"),
        "end_ns",
        "last_seen_ns",
        "next_ns",
        expires.alias("expires_ns"),
        F.col("ts_ns").alias("valid_from"),
        F.least("next_ns", expires).alias("valid_to"),
    )


def _followed(starts: DataFrame, ends: DataFrame | None, id_column: str, chunk_ns: int | None) -> DataFrame:
    """Add to each start of an id: ``next_ns`` (its next start, or OPEN_END) and ``end_ns`` (its first end before that)."""
    at = F.struct("ts_ns", "seq")
    keys, order = ["host", id_column], ["ts_ns", "seq"]
    if ends is None:
        timed = neighbour_time(starts, keys, order, "next_ns", backward=True, chunk_ns=CHUNK_NS if chunk_ns is None else chunk_ns)
        end = F.lit(None).cast("bigint")
    else:
        rows = starts.withColumn("_start", F.lit(True)).unionByName(
            ends.select(*keys, *order, F.lit(False).alias("_start")), allowMissingColumns=True
        )
        values = {"_next": F.when(F.col("_start"), at), "_end": F.when(~F.col("_start"), at)}
        timed = fill(rows, keys, order, values, backward=True, chunk_ns=chunk_ns).filter("_start")
        timed = timed.withColumn("next_ns", F.col("_next.ts_ns"))
        end = F.when(F.col("_next").isNull() | (F.col("_end") < F.col("_next")), F.col("_end.ts_ns"))
    next_ns = F.coalesce("next_ns", F.lit(OPEN_END))
    if "known_next_ns" in starts.columns:
        # What an earlier slice of a stream found out stays.
        cut = F.coalesce("known_next_ns", F.lit(OPEN_END))
        next_ns = F.least(next_ns, cut)
        end = F.coalesce("known_end_ns", F.when(end < cut, end))
    return timed.select(*starts.columns, next_ns.alias("next_ns"), end.alias("end_ns"))


def thread_intervals(
    starts: DataFrame,
    ends: DataFrame,
    processes: DataFrame,
    grace_ns: int = GRACE_NS,
    slack_ns: int = THREAD_SLACK_NS,
    chunk_ns: int = CHUNK_NS,
    short_tids: bool = False,
) -> DataFrame:
    """Which process instance each tid belongs to, over time.

    ``starts``: host, seq, ts_ns, pid, tid, sub_process_tag. ``ends``: host, seq, ts_ns, tid.
    A thread belongs to the process that owns its pid at its start; if there is none, to the one that starts
    on the pid less than ``slack_ns`` later, else to the unknown process. A tid stays mapped
    until it starts again, ``grace_ns`` after the thread ended, or when its process expires. ``short_tids``: no tid has many rows
    (see ``short_keys``), so they are not cut into chunks.
    """
    tags = F.col("sub_process_tag") if "sub_process_tag" in starts.columns else F.lit(0)
    known = [c for c in ("known_next_ns", "known_end_ns", "known_start_key") if c in starts.columns]
    rows = starts.select("host", "tid", "ts_ns", "seq", "pid", tags.cast("bigint").alias("sub_process_tag"), *known)
    owned = asof_join(
        _followed(rows, ends, "tid", None if short_tids else chunk_ns), _owners(processes, slack_ns, chunk_ns), ["host", "pid"], ["start_key", "expires_ns"],
        chunk_ns=chunk_ns, directory=starts.select("host", "pid", "ts_ns"),
    )
    if known:
        owned = _keep_owners(owned, processes)
    return owned.select(
        "host",
        "tid",
        "pid",
        "seq",
        "sub_process_tag",
        F.coalesce("start_key", F.lit(UNKNOWN_START_KEY).cast("bigint")).alias("start_key"),
        F.col("start_key").isNotNull().alias("owner_known"),
        F.col("ts_ns").alias("create_ns"),
        "end_ns",
        "next_ns",
        F.col("ts_ns").alias("valid_from"),
        F.least(
            "next_ns",
            F.coalesce(F.col("end_ns") + F.lit(grace_ns), F.lit(OPEN_END)),
            F.coalesce("expires_ns", F.lit(OPEN_END)),
        ).alias("valid_to"),
    )


def _owners(processes: DataFrame, slack_ns: int, chunk_ns: int) -> DataFrame:
    """Process epochs that begin up to ``slack_ns`` early where nobody owns the pid just before."""
    columns = ["host", "pid", "start_key", "seq", "valid_from", "valid_to", "expires_ns"]
    followed = fill(
        processes.select(*columns), ["host", "pid"], ["valid_from", "seq"], {"_before": F.col("valid_to")}, chunk_ns=chunk_ns
    )
    early = F.greatest(F.col("valid_from") - F.lit(slack_ns - 1), F.coalesce("_before", F.lit(-OPEN_END)))
    return followed.select(*[F.least("valid_from", early).alias(c) if c == "valid_from" else F.col(c) for c in columns])


def _keep_owners(owned: DataFrame, processes: DataFrame) -> DataFrame:
    """Threads whose owner an earlier slice settled keep it, with the owner's present expiry."""
    current = processes.select("host", F.col("start_key").alias("known_start_key"), F.col("expires_ns").alias("_known_expires"))
    joined = owned.join(current, ["host", "known_start_key"], "left")
    settled = F.col("known_start_key").isNotNull()
    unknown = F.col("known_start_key") == UNKNOWN_START_KEY
    return (
        joined.withColumn("expires_ns", F.when(settled, F.col("_known_expires")).otherwise(F.col("expires_ns")))
        .withColumn("start_key", F.when(unknown, F.lit(None)).otherwise(F.coalesce("known_start_key", "start_key")))
        .drop("_known_expires")
    )


def image_references(loads: DataFrame, unloads: DataFrame, chunk_ns: int = CHUNK_NS) -> DataFrame:
    """Loads (``step`` > 0) and unloads (-1) with the references to their base after each, ``refs``.

    ``loads``: host, seq, ts_ns, base, size, file_name, and optionally ``weight``, the loads a row stands for.
    Loads with base or size 0 are skipped. Unloads without a reference leave 0.
    """
    weight = F.coalesce("weight", F.lit(1)) if "weight" in loads.columns else F.lit(1)
    rows = (
        loads.filter((F.col("base") != 0) & (F.col("size") != 0))
        .select("host", "base", "ts_ns", "seq", "size", "file_name", weight.cast("bigint").alias("step"))
        .unionByName(
            unloads.select("host", "base", "ts_ns", "seq", F.lit(-1).cast("bigint").alias("step")), allowMissingColumns=True
        )
    )
    return stack_depth(rows, ["host", "base"], ["ts_ns", "seq"], F.col("step"), "refs", chunk_ns=chunk_ns)


def image_intervals(loads: DataFrame, unloads: DataFrame, chunk_ns: int = CHUNK_NS) -> DataFrame:
    """Load epochs of images, by reference count per base address.

    An epoch starts with the load that finds no reference and ends with the unload that drops the last one.
    """
    return load_epochs(image_references(loads, unloads, chunk_ns), chunk_ns)


def load_epochs(references: DataFrame, chunk_ns: int = CHUNK_NS) -> DataFrame:
    edges = references.filter((F.col("refs") == F.col("step")) | ((F.col("step") == -1) & (F.col("refs") == 0)))
    dead = F.when(F.col("step") == -1, F.col("ts_ns"))
    timed = fill(edges, ["host", "base"], ["ts_ns", "seq"], {"unload_ns": dead}, backward=True, chunk_ns=chunk_ns)
    return timed.filter(F.col("step") > 0).select(
        "host",
        "base",
        "size",
        "seq",
        base_name(F.col("file_name")).alias("image_name"),
        "unload_ns",
        F.col("ts_ns").alias("valid_from"),
        F.coalesce("unload_ns", F.lit(OPEN_END)).alias("valid_to"),
    )


def resolve_services(processes: DataFrame, threads: DataFrame, services: DataFrame) -> DataFrame:
    """Name an instance by the first of its thread tags that resolves; never System and the like.

    ``services``: host, tag, service_name (one row per tag, see ``service_dim``).
    """
    tagged = threads.filter((F.col("sub_process_tag") > 0) & F.col("owner_known")).select(
        "host", "start_key", F.col("sub_process_tag").alias("tag"), F.col("create_ns").alias("ts_ns"), "seq"
    )
    # One row per (instance, tag) before the join keeps busy service hosts small.
    tagged = tagged.groupBy("host", "start_key", "tag").agg(F.min(F.struct("ts_ns", "seq")).alias("at"))
    named = (
        tagged.join(services, ["host", "tag"])
        .groupBy("host", "start_key")
        .agg(F.min_by("service_name", "at").alias("_service"))
    )
    may_name = ~F.col("process_name").isin(*TAGLESS_PROCESSES) & (F.col("service_name") == "")
    joined = processes.join(named, ["host", "start_key"], "left")
    return _replace(joined, processes.columns, "service_name", F.when(may_name, F.col("_service")))


def enrich_running(
    processes: DataFrame, running: DataFrame, services: DataFrame, at_ns: Column | int | str | None = None
) -> DataFrame:
    """Name instances that are still unnamed from a snapshot of running services (pid -> service).

    The service must have a known tag, and the instance must own the pid at ``at_ns`` (default: now,
    that is after the last event). As a name, ``at_ns`` is the column of ``running`` that says when each row was taken.
    """
    own_time = isinstance(at_ns, str)
    at = F.lit(OPEN_END - 1) if at_ns is None else (F.lit(at_ns) if isinstance(at_ns, int) else F.col("_taken") if own_time else at_ns)
    known = services.select("host", "service_name").distinct()
    named = running.join(known, ["host", "service_name"], "left_semi").select(
        "host", "pid", F.col("service_name").alias("_service"), *([F.col(at_ns).alias("_taken")] if own_time else [])
    )
    joined = processes.join(named, ["host", "pid"], "left")
    current = (F.col("valid_from") <= at) & (at < F.col("valid_to"))
    may_name = current & ~F.col("process_name").isin(*TAGLESS_PROCESSES) & (F.col("service_name") == "")
    return _replace(joined, processes.columns, "service_name", F.when(may_name, F.col("_service")))


def enrich_programs(processes: DataFrame, loads: DataFrame, chunk_ns: int = CHUNK_NS, **join_options) -> DataFrame:
    """Take checksum and full path of a program from the .exe loads of its process.

    ``loads``: host, seq, ts_ns, pid, pe_checksum, file_name. The first non-zero checksum wins; the
    first full path replaces a bare name.
    """
    exes = loads.filter(is_exe(F.col("file_name"))).select("host", "pid", "ts_ns", "seq", F.col("pe_checksum").alias("_sum"), "file_name")
    owned = asof_join(exes, processes, ["host", "pid"], ["start_key"], chunk_ns=chunk_ns, **join_options)
    at = F.struct("ts_ns", "seq")
    found = (
        owned.filter(F.col("start_key").isNotNull())
        .groupBy("host", "start_key")
        .agg(
            F.min_by("_sum", F.when(F.col("_sum") != 0, at)).alias("_sum"),
            F.min_by("file_name", F.when(is_full_path(F.col("file_name")), at)).alias("_path"),
        )
    )
    joined = processes.join(found, ["host", "start_key"], "left")
    named = F.when(~is_full_path(F.col("process_name")), F.col("_path"))
    hashed = F.when((F.col("pe_checksum") == 0) & (F.col("_sum") != 0), F.col("_sum"))
    return joined.select(
        *[
            F.coalesce(named, "process_name").alias(c) if c == "process_name"
            else F.coalesce(hashed, "pe_checksum").alias(c) if c == "pe_checksum"
            else F.col(c)
            for c in processes.columns
        ]
    )


def _replace(df: DataFrame, columns: Sequence[str], name: str, value: Column) -> DataFrame:
    return df.select(*[F.coalesce(value, F.col(c)).alias(c) if c == name else F.col(c) for c in columns])


def with_unknown_process(processes: DataFrame) -> DataFrame:
    """Program columns of all instances, plus the unknown process of every host."""
    named = processes.select("host", "start_key", *PROGRAM)
    unknown = processes.select("host").distinct().select(
        "host",
        F.lit(UNKNOWN_START_KEY).cast("bigint").alias("start_key"),
        F.lit(UNKNOWN_PROCESS).alias("process_name"),
        F.lit("").alias("service_name"),
        F.lit(0).cast("bigint").alias("pe_checksum"),
        F.lit(0).cast("bigint").alias("session_id"),
    )
    return named.unionByName(unknown)


def filter_programs(df: DataFrame, patterns: Sequence[str]) -> DataFrame:
    """Keep rows whose ``process_name`` matches any pattern; invalid patterns are ignored.

    No pattern at all keeps every row (the filter is off); if all patterns are invalid nothing matches.
    """
    if not patterns:
        return df
    valid = [p for p in patterns if _compiles(df.sparkSession, p)]
    if not valid:
        return df.filter(F.lit(False))
    return df.filter(F.col("process_name").rlike("|".join(f"(?:{p})" for p in valid)))


def _compiles(spark: SparkSession, pattern: str) -> bool:
    """Ask the regular expressions that will run the pattern, not Python's. Only a syntax error is an answer."""
    try:
        spark._jvm.java.util.regex.Pattern.compile(pattern)
    except IllegalArgumentException:  # what a syntax error arrives as
        return False
    return True


def expire_threads(threads: DataFrame, cleaned: DataFrame) -> DataFrame:
    """Threads that remain once the processes in ``cleaned`` (host, start_key) are gone."""
    return threads.join(cleaned.select("host", "start_key").distinct(), ["host", "start_key"], "left_anti")


def expire_mappings(mappings: DataFrame, cleaned: DataFrame, id_column: str) -> DataFrame:
    """Drop an id mapping only if it still points at the cleaned instance, not at one that reused the id."""
    keys = ["host", id_column, "start_key"]
    return mappings.join(cleaned.select(*keys).distinct(), keys, "left_anti")


def entity_counts(
    processes: DataFrame, threads: DataFrame, images: DataFrame, services: DataFrame, at_ns: int
) -> DataFrame:
    """Live and terminated-but-kept entities at a time, per host and kind.

    Long form: host, entity, live, terminated.
    """

    def count(df: DataFrame, entity: str, end: Column) -> DataFrame:
        kept = (F.col("valid_from") <= at_ns) & (F.lit(at_ns) < F.col("valid_to"))
        over = kept & end.isNotNull() & (end <= at_ns)
        return df.groupBy("host").agg(
            F.lit(entity).alias("entity"),
            F.count_if(kept & ~F.coalesce(over, F.lit(False))).alias("live"),
            F.count_if(over).alias("terminated"),
        )

    tags = services.groupBy("host").agg(
        F.lit("service").alias("entity"), F.count(F.lit(1)).alias("live"), F.lit(0).cast("bigint").alias("terminated")
    )
    return (
        count(processes, "process", F.col("end_ns"))
        .unionByName(count(threads, "thread", F.col("end_ns")))
        .unionByName(count(images, "image", F.col("unload_ns")))
        .unionByName(tags)
    )
