"""Scheduling family: context switches, switch gaps, thread states."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracelake.functions.names import wait_reason_name
from tracelake.functions.units import micros, millis
from tracelake.operators.attribute import attribute_by_tid, known_only
from tracelake.operators.carry import CHUNK_NS
from tracelake.operators.histogram import GAP_BOUNDS_MS, histogram
from tracelake.operators.pairing import switch_gaps
from tracelake.plans.rollup import rollup_programs


def cswitch_per_cpu(cswitch: DataFrame) -> DataFrame:
    return cswitch.groupBy("host", "cpu").agg(F.count(F.lit(1)).alias("value"))


def cswitch_by_program(
    cswitch: DataFrame, threads: DataFrame, processes: DataFrame, level: str = "program", **options
) -> DataFrame:
    """Switches per program of the incoming thread. Untracked threads do not count; those mapped to the unknown process do."""
    incoming = cswitch.select("host", "ts_ns", F.col("new_tid").alias("tid"))
    known = known_only(attribute_by_tid(incoming, threads, **options))
    return rollup_programs(known, processes, [], {"value": F.count(F.lit(1))}, level)


def cswitch_intervals(cswitch: DataFrame, bounds: str = "reference", chunk_ns: int = CHUNK_NS) -> DataFrame:
    """Histogram of the gap between switches per (host, cpu), over ``GAP_BOUNDS_MS``; ``total`` is in ns.

    ``bounds="reference"`` files a gap by the power of two at or below it and keeps overflow in the
    last bucket; ``bounds="upper"`` files it under the first bound not below it.
    """
    gaps = switch_gaps(cswitch, chunk_ns)
    if bounds == "reference":
        return histogram(gaps, micros(F.col("gap_ns")), ["host", "cpu"], GAP_BOUNDS_MS, "log2", F.col("gap_ns"))
    if bounds == "upper":
        return histogram(gaps, millis(F.col("gap_ns")), ["host", "cpu"], GAP_BOUNDS_MS, "first_ge", F.col("gap_ns"))
    raise ValueError(f"unknown bounds {bounds!r}")


def thread_states(cswitch: DataFrame, ready: DataFrame, starts: DataFrame, ends: DataFrame) -> DataFrame:
    """State transitions per (host, state, wait_reason).

    A switch means one thread waits (for its reason, whatever its state) and one runs. Reasons outside the
    name table are dropped; their ``running`` half is not. Each source is counted first, so only a
    few rows per host are merged.
    """

    def count(df: DataFrame, state: str) -> DataFrame:
        return df.groupBy("host").agg(F.lit(state).alias("state"), F.lit("none").alias("wait_reason"), F.count(F.lit(1)).alias("value"))

    reasons = cswitch.groupBy("host", "old_wait_reason").agg(F.count(F.lit(1)).alias("value"))
    halves = F.array(
        F.struct(F.lit("waiting").alias("state"), wait_reason_name(F.col("old_wait_reason")).alias("wait_reason")),
        F.struct(F.lit("running").alias("state"), F.lit("none").alias("wait_reason")),
    )
    switched = (
        reasons.select("host", "value", F.inline(halves))
        .filter(F.col("wait_reason").isNotNull())
        .groupBy("host", "state", "wait_reason")
        .agg(F.sum("value").alias("value"))
    )
    return (
        switched.unionByName(count(ready, "ready"))
        .unionByName(count(starts, "created"))
        .unionByName(count(ends, "terminated"))
    )
