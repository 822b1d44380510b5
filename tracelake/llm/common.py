"""Small helpers the operators share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracelake.operators.materialise import materialise

#: White space of all word and strip rules: the six ASCII characters.
BLANKS = " \t\n\x0b\x0c\r"
#: One word, as a regular expression of both Java and Python.
WORD = r"[^\x20\x09-\x0D]+"

store = materialise


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_or_empty(column: str | Column) -> Column:
    return F.coalesce(F.col(column) if isinstance(column, str) else column, F.lit(""))


def row_keys(*columns: Column) -> list[Column]:
    """128 bits that stand for a row: equal rows, and only they, share both columns."""
    return [F.xxhash64(*columns).alias("k1"), F.xxhash64(F.lit("k2"), *columns).alias("k2")]


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def bounded_batches(spark: SparkSession, rows: int = 500) -> None:
    """Lower the session's Arrow batch size to ``rows`` texts, so that a Python worker holds few of them at a time."""
    setting = "spark.sql.execution.arrow.maxRecordsPerBatch"
    current = int(spark.conf.get(setting))
    if current <= 0 or current > rows:
        spark.conf.set(setting, str(rows))
