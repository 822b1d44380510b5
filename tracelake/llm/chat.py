"""Chat logs: snapshots of one growing conversation collapse to the longest before rendering."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracelake.llm.common import store

#: Turns of one task's window, and of one rendered part.
PART = 1024


def _turn_hash(seed: int) -> Column:
    return F.xxhash64(F.lit(seed), F.col("place"), F.col("role").isNull(), F.col("role"), F.col("text").isNull(), F.col("text"))


def placed_turns(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, place, part): place counts from 1 by (turn, role, text), nulls first; equal turns of a conversation count once.

    Turns are placed in chunks of ``PART`` turn numbers, so a conversation with most of all turns spreads over many tasks.
    """
    unique = conversations.select("conv_id", "turn", "role", "text").distinct()
    chunked = unique.withColumn("chunk", F.coalesce(F.floor(F.col("turn") / PART), F.lit(-(2**62))))
    inside = Window.partitionBy("conv_id", "chunk").orderBy(*[F.col(c).asc_nulls_first() for c in ("turn", "role", "text")])
    before = Window.partitionBy("conv_id").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    sizes = chunked.groupBy("conv_id", "chunk").agg(F.count(F.lit(1)).alias("n"))
    offsets = sizes.select(F.col("conv_id").alias("of"), F.col("chunk").alias("in"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    ranked = chunked.withColumn("rank", F.row_number().over(inside))
    joined = ranked.join(offsets, F.col("conv_id").eqNullSafe(F.col("of")) & (F.col("chunk") == F.col("in")))
    place = (F.col("first") + F.col("rank")).cast("long")
    return joined.select("conv_id", "turn", "role", "text", place.alias("place")).withColumn("part", F.floor((F.col("place") - 1) / PART))


def prefix_hashes(turns: DataFrame) -> DataFrame:
    """(conv_id, place, p1, p2): 128 bits that stand for the first ``place`` turns.

    A turn's hash covers its place, role and text; a prefix is the exclusive or of its turns' hashes, so the parts of a
    conversation are hashed apart and carried over.
    """
    hashed = turns.select("conv_id", "part", "place", _turn_hash(1).alias("t1"), _turn_hash(2).alias("t2"))
    parts = hashed.groupBy("conv_id", "part").agg(F.bit_xor("t1").alias("x1"), F.bit_xor("t2").alias("x2"))
    before = Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    carried = parts.select(
        F.col("conv_id").alias("of"), F.col("part").alias("in"), *[F.coalesce(F.bit_xor(f"x{i}").over(before), F.lit(0)).alias(f"c{i}") for i in (1, 2)]
    )
    upto = Window.partitionBy("conv_id", "part").orderBy("place").rowsBetween(Window.unboundedPreceding, 0)
    own = hashed.select("conv_id", "part", "place", *[F.bit_xor(f"t{i}").over(upto).alias(f"o{i}") for i in (1, 2)])
    joined = own.join(carried, F.col("conv_id").eqNullSafe(F.col("of")) & (F.col("part") == F.col("in")))
    return joined.select("conv_id", "place", *[F.col(f"o{i}").bitwiseXOR(F.col(f"c{i}")).alias(f"p{i}") for i in (1, 2)])


def maximal(turns: DataFrame) -> DataFrame:
    """(conv_id, n_turns, n_copies) of the conversations that prefix no longer one; of equal ones the smallest conv_id stays.

    Prefixes are made distinct before the anti-join, so a first turn that a third of all logs share is one row.
    """
    prefixes = store(prefix_hashes(turns))
    lengths = turns.groupBy("conv_id").agg(F.max("place").alias("n_turns")).withColumnRenamed("conv_id", "of")
    ends = store(prefixes.join(lengths, F.col("conv_id").eqNullSafe(F.col("of")) & (F.col("place") == F.col("n_turns"))).select("conv_id", "n_turns", "p1", "p2"))
    whole = ends.groupBy("n_turns", "p1", "p2").agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_copies"))
    longer = prefixes.join(lengths, F.col("conv_id").eqNullSafe(F.col("of"))).filter(F.col("place") < F.col("n_turns"))
    proper = longer.select(F.col("place").alias("n_turns"), "p1", "p2").distinct()
    return whole.join(proper, ["n_turns", "p1", "p2"], "left_anti").select("conv_id", "n_turns", "n_copies")


def render(conversations: DataFrame) -> DataFrame:
    """(conv_id, part, n_turns, n_copies, text): the maximal conversations, in parts of at most ``PART`` turns.

    A turn reads ``<|im_start|>role``, its text on the next lines, ``<|im_end|>``; a null role or text is empty there, but differs from
    an empty one in comparisons. A null conv_id is one conversation. n_copies counts the equal logs it stands for, itself included.
    Repeated rows count once. No rows: no rows. Other columns are not read.
    """
    turns = store(placed_turns(conversations))
    chosen = store(maximal(turns)).withColumnRenamed("conv_id", "of")
    piece = F.concat(F.lit("<|im_start|>"), F.coalesce("role", F.lit("")), F.lit("\n"), F.coalesce("text", F.lit("")), F.lit("<|im_end|>\n"))
    joined = turns.join(chosen, F.col("conv_id").eqNullSafe(F.col("of")))
    parts = joined.groupBy("conv_id", "part", "n_turns", "n_copies").agg(F.sort_array(F.collect_list(F.struct("place", piece.alias("piece")))).alias("pieces"))
    return parts.select("conv_id", "part", "n_turns", "n_copies", F.array_join(F.col("pieces.piece"), "").alias("text"))
