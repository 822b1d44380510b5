"""Two-level roll-up: facts to process instances, instances to programs."""

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracelake.functions.names import UNKNOWN_PROCESS, UNKNOWN_START_KEY
from tracelake.functions.text import hex_label
from tracelake.operators.entities import PROGRAM

LABELS = list(PROGRAM)


def name_programs(per_instance: DataFrame, processes: DataFrame) -> DataFrame:
    """Add the program columns of ``start_key``, with the checksum as its hex label.

    The unknown process is not in the instance table; its columns are constants.
    """
    programs = processes.select("host", "start_key", *PROGRAM)
    joined = per_instance.join(programs, ["host", "start_key"], "left")
    unknown = F.col("start_key") == UNKNOWN_START_KEY
    return joined.select(
        *per_instance.columns,
        F.when(unknown, F.lit(UNKNOWN_PROCESS)).otherwise(F.col("process_name")).alias("process_name"),
        F.when(unknown, F.lit("")).otherwise(F.col("service_name")).alias("service_name"),
        hex_label(F.when(unknown, F.lit(0).cast("bigint")).otherwise(F.col("pe_checksum"))).alias("pe_checksum"),
        F.when(unknown, F.lit(0).cast("bigint")).otherwise(F.col("session_id")).alias("session_id"),
    )


def rollup_programs(
    attributed: DataFrame, processes: DataFrame, dims: Sequence[str], aggs: Mapping[str, Column], level: str = "program"
) -> DataFrame:
    """Sum ``aggs`` per (host, program, dims), or per (host, start_key, dims) with ``level="instance"``.

    The first aggregation, per instance, shrinks the facts before they meet the instance table; all
    ``aggs`` must be sums or counts, so that the second one can add them.
    """
    per_instance = attributed.groupBy("host", "start_key", *dims).agg(*[c.alias(n) for n, c in aggs.items()])
    if level == "instance":
        return per_instance
    return sum_programs(per_instance, processes, dims, list(aggs))


def sum_programs(per_instance: DataFrame, processes: DataFrame, dims: Sequence[str], values: Sequence[str]) -> DataFrame:
    """Per-instance sums to per-program sums."""
    named = name_programs(per_instance, processes)
    return named.groupBy("host", *LABELS, *dims).agg(*[F.sum(v).alias(v) for v in values])


def drop_zero(df: DataFrame, value: str = "value") -> DataFrame:
    return df.filter(F.col(value) > 0)


def full_keys(a: DataFrame, b: DataFrame, keys: Sequence[str], values: Sequence[str]) -> DataFrame:
    """Union of the key sets of two counter tables; values missing on one side are 0."""
    both = a.unionByName(b, allowMissingColumns=True)
    return both.groupBy(*keys).agg(*[F.coalesce(F.sum(v), F.lit(0).cast("bigint")).alias(v) for v in values])
