"""Attribution of facts to process instances."""

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracelake.functions.names import INVALID_ID, SYSTEM_PID, UNKNOWN_START_KEY
from tracelake.operators.asof import asof_join

OWNER = "start_key"


def usable_id(column: Column) -> Column:
    """The id, or null for the two values that never name a thread or process."""
    return F.when((column != 0) & (column != INVALID_ID), column)


def attribute_by_pid(facts: DataFrame, processes: DataFrame, pid: str = "pid", **options) -> DataFrame:
    """Add the start key of the instance that owns the pid at the time of the fact, else null."""
    return asof_join(facts, processes, ["host", "pid"], [OWNER], fact_keys=["host", pid], **options)


def attribute_by_tid(facts: DataFrame, threads: DataFrame, tid: str = "tid", **options) -> DataFrame:
    """Add the start key of the process the thread belongs to at the time of the fact, else null.

    Threads of unknown owner carry the unknown process's key.
    """
    return asof_join(facts, threads, ["host", "tid"], [OWNER], fact_keys=["host", tid], **options)


def attribute_system(facts: DataFrame, processes: DataFrame, **options) -> DataFrame:
    """Add the start key of the System process at the time of the fact."""
    system = facts.withColumn("_pid", F.lit(SYSTEM_PID).cast("bigint"))
    return attribute_by_pid(system, processes, "_pid", **options).drop("_pid")


def attribute_disk(facts: DataFrame, threads: DataFrame, processes: DataFrame, **options) -> DataFrame:
    """Attribute disk I/O: issuing thread, else header pid, else System, else nobody.

    ``facts`` has host, ts_ns, issuing_tid (may be missing for sources without one) and header_pid. Adds
    ``start_key`` and ``attribution`` (``thread``, ``process``, ``system`` or null). A thread of
    unknown owner settles the question: no later step is tried. Each step looks only at rows still
    open: the others carry a null key, which an as-of join passes through.
    """
    columns = facts.columns

    def step(df: DataFrame, table: DataFrame, by: Callable, key: str, ident: Column, open_: Column, out: str) -> DataFrame:
        # The directory lists the ids of all facts: it needs no result of an earlier step.
        every = facts.select("host", "ts_ns", ident.alias(key))
        probe = df.withColumn(key, F.when(open_, ident))
        return by(probe, table, key, directory=every, **options).withColumnRenamed(OWNER, out)

    owned = facts.withColumn("_thread", F.lit(None).cast("bigint"))
    if "issuing_tid" in columns:
        tid = usable_id(F.col("issuing_tid"))
        owned = step(facts, threads, attribute_by_tid, "_tid", tid, F.lit(True), "_thread")
    open_ = F.col("_thread").isNull()
    owned = step(owned, processes, attribute_by_pid, "_pid", usable_id(F.col("header_pid")), open_, "_process")
    open_ = open_ & F.col("_process").isNull()
    owned = step(owned, processes, attribute_by_pid, "_sys", F.lit(SYSTEM_PID).cast("bigint"), open_, "_system")
    found = (
        F.when(F.col("_thread").isNotNull(), F.lit("thread"))
        .when(F.col("_process").isNotNull(), F.lit("process"))
        .when(F.col("_system").isNotNull(), F.lit("system"))
    )
    return owned.select(*columns, F.coalesce("_thread", "_process", "_system").alias(OWNER), found.alias("attribution"))


def or_unknown(attributed: DataFrame) -> DataFrame:
    """Facts without an owner go to the unknown process."""
    return attributed.withColumn(OWNER, F.coalesce(OWNER, F.lit(UNKNOWN_START_KEY).cast("bigint")))


def known_only(attributed: DataFrame) -> DataFrame:
    """Facts without an owner are dropped, also from system-wide totals."""
    return attributed.filter(F.col(OWNER).isNotNull())
