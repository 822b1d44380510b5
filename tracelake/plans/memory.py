"""Memory family: hard page faults."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracelake.operators.attribute import attribute_by_tid, or_unknown
from tracelake.plans.rollup import rollup_programs


def hard_faults(faults: DataFrame) -> DataFrame:
    return faults.groupBy("host").agg(F.count(F.lit(1)).alias("value"))


def hard_faults_by_program(
    faults: DataFrame, threads: DataFrame, processes: DataFrame, level: str = "program", **options
) -> DataFrame:
    """Faults per program of the faulting thread; faults without an owner go to the unknown process."""
    owned = or_unknown(attribute_by_tid(faults.select("host", "ts_ns", "tid"), threads, **options))
    return rollup_programs(owned, processes, [], {"value": F.count(F.lit(1))}, level)
