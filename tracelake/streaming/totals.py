"""Totals over what the stream has written so far."""

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracelake.operators.histogram import add_histograms
from tracelake.operators.scrapes import levels
from tracelake.plans.rollup import LABELS, name_programs
from tracelake.streaming.exposing import latest_instances, restarted, summed, totals_as_samples
from tracelake.streaming.state import Carry


def _sink(spark: SparkSession, out: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{out.rstrip('/')}/{table}")


def _reader(spark: SparkSession, out: str) -> Callable[[str], DataFrame | None]:
    """Tables of a sink by name; None for those it does not have."""
    sink = Carry(spark, out)
    return lambda table: _sink(spark, out, table) if sink.has(table) else None


def stream_instances(spark: SparkSession, out: str) -> DataFrame:
    """Every instance seen, with its latest name, service and checksum."""
    seen = _sink(spark, out, "instances")
    return latest_instances(seen)


def stream_counters(spark: SparkSession, out: str, metric: str, dims: Sequence[str], per_program: bool) -> DataFrame:
    """Lifetime value of one counter per (host, [program,] dims)."""
    deltas = _sink(spark, out, "deltas").filter(F.col("metric") == metric)
    sums = deltas.groupBy("host", "start_key", "dims").agg(F.sum("value").alias("value"))
    read = [F.get_json_object("dims", f"$.{d}").alias(d) for d in dims]
    if not per_program:
        return sums.groupBy("host", "dims").agg(F.sum("value").alias("value")).select("host", *read, "value")
    named = name_programs(sums.select("host", "start_key", *read, "value"), stream_instances(spark, out))
    return named.groupBy("host", *LABELS, *dims).agg(F.sum("value").alias("value"))


def stream_histograms(spark: SparkSession, out: str, metric: str, labels: Sequence[str], bounds: Sequence[float]) -> DataFrame:
    """Histogram of one metric per label set: of the whole run, or where drivers restart since the last unload."""
    read = _reader(spark, out)
    parts = restarted(read("histograms"), read("restarts")).filter(F.col("metric") == metric)
    return add_histograms(parts.select(*labels, "n", "total", "buckets"), labels, bounds)


def late_rows(spark: SparkSession, out: str) -> DataFrame:
    """Rows that came after the watermark had passed them, per (host, class)."""
    return _sink(spark, out, "late").groupBy("host", "cls").agg(F.sum("rows").alias("rows"))


def compact(spark: SparkSession, out: str, target: str) -> None:
    """Write a whole sink into ``target`` with what its batches add up to: counters and histograms summed, the latest row of each instance, late rows.

    For long runs with many small batches. ``target`` reads like the sink itself.
    """
    root = target.rstrip("/")

    def put(df: DataFrame, table: str) -> None:
        df.write.mode("overwrite").parquet(f"{root}/{table}/batch=0")

    summed(_reader(spark, out), put)


def stream_samples(spark: SparkSession, out: str, families: Sequence[str], include_names: Sequence[str] = ()) -> DataFrame:
    """Every series of the stream so far as samples (see ``to_samples``), with the program names of now.

    ``families`` are those the stream runs; ``include_names`` keeps series of matching programs, and those without one.
    """
    return totals_as_samples(spark, _reader(spark, out), families, include_names)


def stream_cleaned(spark: SparkSession, out: str) -> DataFrame:
    """Every instance seen, with the generation it ended in and the scrape that removed it, null where that has not happened."""
    seen = stream_instances(spark, out).select("host", "start_key")
    ended = _sink(spark, out, "generations").select("host", "start_key", "generation")
    cleaned = _sink(spark, out, "cleaned").select("host", "start_key", "cleaned_scrape", "cleaned_ns")
    return seen.join(ended, ["host", "start_key"], "left").join(cleaned, ["host", "start_key"], "left")


def stream_snapshots(spark: SparkSession, out: str, metric: str, dims: Sequence[str], every_scrape: bool = False) -> DataFrame:
    """Value of each series of a snapshot counter at each scrape (see ``snapshot_counters``): counts leave with their instance."""
    ids = _sink(spark, out, "scrapes").select("host", "scrape_id")
    last = ids.groupBy("host").agg(F.max("scrape_id").alias("_last"))
    steps = _sink(spark, out, "steps").filter(F.col("metric") == metric)
    read = [F.get_json_object("dims", f"$.{d}").alias(d) for d in dims]
    shown = steps.join(last, "host").filter(F.col("scrape_id") <= F.col("_last"))
    shown = shown.groupBy("host", "dims", "scrape_id").agg(F.sum("step").alias("step")).select("host", *read, "scrape_id", "step")
    return levels(shown, list(dims), ids, every_scrape)
