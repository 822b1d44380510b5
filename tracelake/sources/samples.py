"""Metric samples: the common output of all families, as a table and as exposition text."""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

COUNTER, GAUGE, HISTOGRAM = "counter", "gauge", "histogram"


def _label_map(labels: Sequence[str], *extra: Column) -> Column:
    pairs: list[Column] = []
    for name in labels:
        pairs += [F.lit(name), F.col(name).cast("string")]
    pairs += extra
    return F.create_map(*pairs).cast("map<string,string>") if pairs else F.expr("cast(map() as map<string,string>)")


def to_samples(df: DataFrame, metric: str, labels: Sequence[str], value: str, kind: str = COUNTER) -> DataFrame:
    """Rows of (host, metric, labels, value, kind), with ``scrape_id`` where ``df`` has it."""
    return df.select(
        *[c for c in ("scrape_id",) if c in df.columns],
        "host",
        F.lit(metric).alias("metric"),
        _label_map(labels).alias("labels"),
        F.col(value).cast("double").alias("value"),
        F.lit(kind).alias("kind"),
    )


def histogram_samples(
    h: DataFrame, metric: str, labels: Sequence[str], bounds: Sequence[float], scale: float = 1.0
) -> DataFrame:
    """Cumulative ``_bucket`` samples up to ``+Inf``, and ``_sum`` and ``_count``. ``scale`` divides the total."""
    running = F.lit(0).cast("bigint")
    parts = []
    for i, bound in enumerate(bounds):
        running = running + F.get("buckets", F.lit(i))
        parts.append(_part("_bucket", running, _label_map(labels, F.lit("le"), F.lit(_number(bound)))))
    parts.append(_part("_bucket", F.col("n"), _label_map(labels, F.lit("le"), F.lit("+Inf"))))
    parts.append(_part("_sum", F.col("total") / F.lit(scale), _label_map(labels)))
    parts.append(_part("_count", F.col("n"), _label_map(labels)))
    each = h.select("host", F.inline(F.array(*parts)))
    return each.select(
        "host",
        F.concat(F.lit(metric), "suffix").alias("metric"),
        "labels",
        "value",
        F.lit(HISTOGRAM).alias("kind"),
    )


def _part(suffix: str, value: Column, labels: Column) -> Column:
    return F.struct(F.lit(suffix).alias("suffix"), labels.alias("labels"), value.cast("double").alias("value"))


def _number(bound: float) -> str:
    return f"{bound:.10g}"


def at_scrape(samples: DataFrame, scrape_id: int) -> DataFrame:
    """Stamp the samples of one evaluation."""
    return samples.select(F.lit(scrape_id).cast("bigint").alias("scrape_id"), "*")


def write_samples(samples: DataFrame, path: str, mode: str = "append") -> None:
    """Write samples partitioned by metric. Rows are ranged by (metric, host), so a large metric gets several files."""
    samples.repartitionByRange("metric", "host").write.mode(mode).partitionBy("metric").parquet(path)


def exposition(samples: DataFrame) -> DataFrame:
    """Exposition text: one ``line`` per sample, each metric family led by its TYPE line, ordered.

    The order is a range sort, so no family has to fit one task. With several hosts in the samples, lines carry a ``host``
    label.
    """
    family = F.when(F.col("kind") == HISTOGRAM, F.regexp_replace("metric", "_(bucket|sum|count)$", "")).otherwise(F.col("metric"))

    def quoted(text: Column) -> Column:
        for plain, escaped in (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n")):
            text = F.replace(text, F.lit(plain), F.lit(escaped))
        return F.concat(F.lit('"'), text, F.lit('"'))

    shown = F.map_entries(F.map_concat(F.create_map(F.lit("host"), F.col("host")), "labels"))
    ordered = F.concat(
        F.filter(shown, lambda e: e["key"] != "le"), F.filter(shown, lambda e: e["key"] == "le")
    )
    pairs = F.array_join(F.transform(ordered, lambda e: F.concat(e["key"], F.lit("="), quoted(e["value"]))), ",")
    whole = (F.col("value") == F.floor("value")) & (F.abs("value") < 1e15)
    number = F.when(whole, F.col("value").cast("bigint").cast("string")).otherwise(F.col("value").cast("string"))
    # Within a series, buckets come in order of their bound, then sum, then count.
    le = F.try_element_at("labels", F.lit("le"))
    bound = F.when(le == "+Inf", F.lit(float("inf"))).otherwise(le.cast("double"))
    series = F.array_join(
        F.transform(F.filter(shown, lambda e: e["key"] != "le"), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ","
    )
    lines = samples.select(
        family.alias("family"),
        F.lit(1).alias("rank"),
        series.alias("series"),
        F.col("metric").alias("part"),
        bound.alias("bound"),
        F.concat("metric", F.lit("{"), pairs, F.lit("} "), number).alias("line"),
    )
    heads = samples.select(family.alias("family"), "kind").distinct().select(
        "family",
        F.lit(0).alias("rank"),
        F.lit("").alias("series"),
        F.lit("").alias("part"),
        F.lit(None).cast("double").alias("bound"),
        F.concat(F.lit("# TYPE "), "family", F.lit(" "), "kind").alias("line"),
    )
    return lines.unionByName(heads).orderBy("family", "rank", "series", "part", "bound").select("line")


def write_exposition(samples: DataFrame, path: str, mode: str = "overwrite") -> None:
    exposition(samples).write.mode(mode).text(path)
