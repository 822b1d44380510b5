"""Registry family. Operations of unknown processes are dropped everywhere, totals included."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracelake.functions.names import registry_op_name, result_name
from tracelake.operators.attribute import attribute_by_pid, known_only
from tracelake.plans.rollup import rollup_programs


def known_registry_ops(events: DataFrame, processes: DataFrame, **options) -> DataFrame:
    """Named operations of known processes. ``events``: host, ts_ns, header_pid, opcode, status."""
    named = events.select(
        "host", "ts_ns", F.col("header_pid").alias("pid"),
        registry_op_name(F.col("opcode")).alias("operation"), result_name(F.col("status")).alias("result"),
    ).filter(F.col("operation").isNotNull())
    return known_only(attribute_by_pid(named, processes, **options))


def registry_totals(events: DataFrame, processes: DataFrame, **options) -> DataFrame:
    """Operations per (host, operation, result)."""
    known = known_registry_ops(events, processes, **options)
    return known.groupBy("host", "operation", "result").agg(F.count(F.lit(1)).alias("value"))


def registry_by_program(events: DataFrame, processes: DataFrame, level: str = "program", **options) -> DataFrame:
    """Operations per (host, program, operation, result)."""
    known = known_registry_ops(events, processes, **options)
    return rollup_programs(known, processes, ["operation", "result"], {"value": F.count(F.lit(1))}, level)
