"""Small helpers for hand-written rows."""

from pyspark.sql import DataFrame

S = 1_000_000_000


def rows(df: DataFrame, *columns: str) -> list[tuple]:
    picked = df.select(*columns) if columns else df
    return sorted((tuple(r) for r in picked.collect()), key=repr)


def make(spark, columns: str, *values: tuple) -> DataFrame:
    """Rows of host "h"; ``columns`` is a DDL list without host."""
    return spark.createDataFrame([("h", *v) for v in values], f"host string, {columns}")
