"""Mixing sources to target weights: tokens per source, repetition rates, floor(rate) copies and one Bernoulli copy."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracelake.llm.common import WORD, store, text_or_empty


def words(text: str | Column) -> Column:
    return F.regexp_count(text_or_empty(text), F.lit(WORD)).cast("long")


def _ranked(sources: DataFrame) -> DataFrame:
    """Adds ``rank`` from 0 by code point order, nulls last, without sorting all sources in one task."""
    split = store(sources.repartitionByRange(F.col("source").asc_nulls_last()).withColumn("part", F.spark_partition_id()))
    counts = split.groupBy("part").agg(F.count(F.lit(1)).alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row per partition, not per source
    first = counts.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    place = F.row_number().over(Window.partitionBy("part").orderBy(F.col("source").asc_nulls_last()))
    return split.withColumn("place", place).join(first, "part").select("source", "source_size", (F.col("first") + F.col("place") - 1).alias("rank"))


def source_targets(sized: DataFrame, weights: tuple[int, ...] = (5, 2, 1), cap: int = 3) -> DataFrame:
    """(source, source_size, target): the sum of all sizes shared by weight, none above ``cap`` times its source's size.

    Sources take ``weights`` in turn by code point order (null last). What a capped source leaves is shared again among the
    open ones by weight until none is above its cap. The level rises with every round, so a source is capped exactly if its cap is
    below level x weight, and a round is one aggregate over the table of sources. No rows, or no words: targets are 0.
    """
    sums = _ranked(sized.groupBy("source").agg(F.sum("size").alias("source_size")))
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.col("rank") % len(weights) + 1).cast("int"))
    sources = store(sums.select("source", "source_size", weight.alias("weight"), (F.col("source_size") * cap).alias("most")))
    total = sources.agg(F.sum("source_size")).first()[0] or 0
    level, capped = 0.0, -1
    while total:
        over = F.col("most") < F.lit(level) * F.col("weight")
        row = sources.agg(
            F.count(F.when(over, 1)).alias("capped"), F.sum(F.when(over, F.col("most")).otherwise(0)).alias("most"), F.sum(F.when(over, 0).otherwise(F.col("weight"))).alias("weight")
        ).first()
        if row["capped"] == capped:
            break
        capped, level = row["capped"], (total - row["most"]) / row["weight"]
    return sources.select("source", "source_size", F.least(F.col("most").cast("double"), F.lit(level) * F.col("weight")).alias("target"))


def unit_hash(seed: int, *columns: Column) -> Column:
    """A number in [0, 1) that depends on the seed and the columns alone."""
    text = F.concat_ws("|", F.lit(str(seed)), *[F.coalesce(c.cast("string"), F.lit("null")) for c in columns])
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("double") / float(16**13)


def mix_plan(docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), cap: int = 3, seed: int = 0) -> DataFrame:
    """Every row with ``size`` (words), ``source_size``, ``target`` of its source, and ``copies``, how often the mix takes it.

    copies = floor(rate) plus one if the document's hash falls below the fraction, rate = target / source_size; so no row
    is taken more than ``cap`` times, and equal input gives equal copies. Rows that share a doc_id and source share the draw; a
    null doc_id is a value like any other. Null text has size 0; a source without words has rate 0. Sources are aggregated
    before they meet the documents, so a source with most of the rows costs one row per task. Other columns pass through,
    but for input columns of the four names, which are replaced.
    """
    sized = docs.select(F.struct("*").alias("row"), F.col("doc_id"), F.col("source"), words("text").alias("size"))
    targets = source_targets(sized.select("source", "size"), weights, cap).withColumnRenamed("source", "of")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    drawn = (unit_hash(seed, F.col("doc_id"), F.col("source")) < F.col("rate") - F.floor("rate")).cast("long")
    joined = sized.join(targets, F.col("source").eqNullSafe(F.col("of"))).withColumn("rate", rate).withColumn("copies", F.floor("rate") + drawn)
    names = [c for c in docs.columns if c not in ("size", "source_size", "target", "copies")]
    return joined.select(*[F.col(f"row.`{c}`").alias(c) for c in names], "size", "source_size", "target", "copies")


def mix(docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), cap: int = 3, seed: int = 0) -> DataFrame:
    """The mix itself: each row of ``docs`` as many times as its plan says, with the columns of ``docs`` whatever their names."""
    packed = docs.select(F.struct("*").alias("own_"), "doc_id", "source", "text")
    plan = mix_plan(packed, weights, cap, seed).filter(F.col("copies") > 0)
    copies = plan.select("own_", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("copy_"))
    return copies.select(*[F.col(f"own_.`{c}`").alias(c) for c in docs.columns])
