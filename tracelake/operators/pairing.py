"""Per-CPU sequences: gaps between switches, ends of deferred calls, interrupt to call pairing."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracelake.functions.units import NS_PER_MS, NS_PER_S
from tracelake.operators.carry import CHUNK_NS, fill, neighbour_time, stack_depth
from tracelake.operators.materialise import materialise

MAX_PAIR_NS = 3600 * NS_PER_S
CPU = ["host", "cpu"]


def switch_gaps(cswitch: DataFrame, chunk_ns: int = CHUNK_NS) -> DataFrame:
    """Time since the previous switch on the CPU (``gap_ns``); first rows and gaps <= 0 are left out."""
    rows = cswitch.select("host", "cpu", "ts_ns", "seq")
    timed = neighbour_time(rows, CPU, ["ts_ns", "seq"], "_prev", chunk_ns=chunk_ns)
    return timed.withColumn("gap_ns", F.col("ts_ns") - F.col("_prev")).filter(F.col("gap_ns") > 0).drop("_prev")


def finalised_dpcs(dpc: DataFrame, cswitch: DataFrame, chunk_ns: int = CHUNK_NS) -> DataFrame:
    """Deferred calls with their end: the next call or switch on the CPU. Calls with none are left out.

    ``dpc``: host, cpu, ts_ns, seq, initial_ns, routine (optional). Adds ``end_ns`` and ``duration_ns``.
    """
    carried = [c for c in ("initial_ns", "routine") if c in dpc.columns]
    rows = dpc.select("host", "cpu", "ts_ns", "seq", *carried, F.lit(True).alias("_dpc")).unionByName(
        cswitch.select("host", "cpu", "ts_ns", "seq", F.lit(False).alias("_dpc")), allowMissingColumns=True
    )
    timed = neighbour_time(rows, CPU, ["ts_ns", "seq"], "end_ns", backward=True, chunk_ns=chunk_ns)
    return (
        timed.filter(F.col("_dpc") & F.col("end_ns").isNotNull())
        .withColumn("duration_ns", F.col("end_ns") - F.col("initial_ns"))
        .drop("_dpc")
    )


def pair_isr_dpc(
    isr: DataFrame, finalised: DataFrame, max_isr_age_ms: int | None = None, chunk_ns: int = CHUNK_NS
) -> DataFrame:
    """Pair each finalised call with the closest earlier unpaired interrupt on its CPU, less than 1 h back.

    Interrupts stack up and a call takes the top one, so a row's partner is the previous row on its
    stack level. Adds nothing for calls without a partner. Output: host, cpu, dpc_seq, isr_seq,
    isr_ns, dpc_ns, latency_ns. ``max_isr_age_ms`` narrows the 1 h. Ordering is by initial time.

    The rows with their stack level are written once: the last step looks at them twice, and behind them are two scans.
    """
    rows = isr.select("host", "cpu", F.col("initial_ns").alias("at_ns"), "seq", F.lit(0).alias("is_dpc")).unionByName(
        finalised.select("host", "cpu", F.col("initial_ns").alias("at_ns"), "seq", F.lit(1).alias("is_dpc"))
    )
    order = ["at_ns", "is_dpc", "seq"]
    levelled = stack_depth(
        rows, CPU, order, F.when(F.col("is_dpc") == 1, -1).otherwise(1), "depth", chunk_ns=chunk_ns
    ).withColumn("level", F.col("depth") + F.col("is_dpc"))
    levelled = materialise(levelled.drop("depth"))
    here = F.struct("is_dpc", "at_ns", "seq")
    paired = fill(levelled, [*CPU, "level"], order, {"below": here}, chunk_ns=chunk_ns)
    limit = MAX_PAIR_NS if max_isr_age_ms is None else min(MAX_PAIR_NS, max_isr_age_ms * NS_PER_MS + 1)
    latency = F.col("at_ns") - F.col("below.at_ns")
    return paired.filter((F.col("is_dpc") == 1) & (F.col("below.is_dpc") == 0) & (latency < limit)).select(
        "host",
        "cpu",
        F.col("seq").alias("dpc_seq"),
        F.col("below.seq").alias("isr_seq"),
        F.col("below.at_ns").alias("isr_ns"),
        F.col("at_ns").alias("dpc_ns"),
        latency.alias("latency_ns"),
    )
