"""Whole-number vectors in Spark, and blocks of queries that meet shares of the candidates."""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracelake.llm.common import shuffle_partitions

#: Queries of one block, and components of the candidates of one share: what a task holds of each at a time.
QUERY_BLOCK, SHARE_COMPONENTS = 4096, 1 << 22
#: Doubles hold whole numbers up to this exactly.
EXACT = 2.0**53
_LONG = 2**63 - 1


def usable(vector: str, scale: int) -> Column:
    """Neither null nor holding a component that is null or, scaled, not finite."""
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double") * F.lit(float(scale))) < F.lit(math.inf))
    return F.coalesce(F.forall(vector, finite), F.lit(False))


def scaled(vector: str, scale: int) -> Column:
    """floor(scale * x) of each component, as doubles. From 2^52 on a double is whole already."""

    def whole(x: Column) -> Column:
        y = x.cast("double") * F.lit(float(scale))
        return F.when(F.abs(y) < F.lit(2.0**52), F.floor(y).cast("double")).otherwise(y)

    return F.transform(vector, whole)


def matrix(column: pa.ChunkedArray | pa.Array, width: int = 0) -> np.ndarray:
    """Rows of a list column as a matrix of doubles; shorter vectors end in zeros."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    lengths = np.diff(column.offsets.to_numpy()).astype(np.int64)
    width = max(width, int(lengths.max(initial=0)))
    flat = column.flatten().to_numpy(zero_copy_only=False)
    if (lengths == width).all():
        return flat.reshape(len(lengths), width)
    out = np.zeros((len(lengths), width))
    out[np.arange(width) < lengths[:, None]] = flat
    return out


def matrices(*columns: pa.ChunkedArray) -> list[np.ndarray]:
    """Matrices of equal width."""
    width = max(matrix(c).shape[1] for c in columns)
    return [matrix(c, width) for c in columns]


def norms(rows: np.ndarray) -> np.ndarray:
    """Euclidean lengths, also where squares would overflow."""
    top = np.abs(rows).max(axis=1, initial=0)
    return top * np.sqrt(((rows / np.where(top > 0, top, 1)[:, None]) ** 2).sum(axis=1))


def dots(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Exact inner products, row by row, as longs; beyond them the nearest long. ``left`` may be one vector for all rows."""
    largest = float(np.abs(left).max(initial=0)) * float(np.abs(right).max(initial=0)) * max(1, right.shape[1])
    if largest < EXACT:
        return (right @ left if left.ndim == 1 else np.einsum("ij,ij->i", left, right)).astype(np.int64)
    sums = (sum(int(a) * int(b) for a, b in zip(x, y, strict=True)) for x, y in zip(np.broadcast_to(left, right.shape).tolist(), right.tolist(), strict=True))
    return np.array([max(-_LONG - 1, min(_LONG, s)) for s in sums], np.int64)


def best(scores: np.ndarray, ids: pa.Array, at: np.ndarray, k: int) -> np.ndarray:
    """Places in ``scores`` of the ``k`` highest, ties to the smaller id; ``at`` says which row of ``ids`` a score is of. Null ids come last."""
    if len(scores) > k:
        least = np.partition(scores, len(scores) - k)[len(scores) - k]
        near = np.flatnonzero(scores >= least)
    else:
        near = np.arange(len(scores))
    names = ids.take(pa.array(at[near]))
    unknown = names.is_null().to_numpy(zero_copy_only=False)
    return near[np.lexsort((names.fill_null(0).to_numpy(), unknown, ~scores[near]))[:k]]


def against_all(
    queries: DataFrame, rows: DataFrame, components: int, work: Callable[[pa.Table, pa.Table], pa.Table], schema: str
) -> DataFrame:
    """``work`` applied to each block of queries with each share of the rows; what it returns, of all of them.

    ``queries`` are distinct (columns k1 and k2), ``rows`` stored; ``components`` is the length of the longest vector. Blocks and shares
    hold a bounded number of vectors and are of equal size whatever the values: neither copies of one vector nor a large label make a hot
    group. Shares are at least as many as shuffle partitions. Only counts pass through the driver.
    """
    spark = rows.sparkSession
    blocks = math.ceil(queries.count() / QUERY_BLOCK) or 1
    shares = max(shuffle_partitions(spark), math.ceil(rows.count() * max(1, components) / SHARE_COMPONENTS))
    share = F.pmod(F.monotonically_increasing_id(), F.lit(shares)).cast("int").alias("share")
    left = queries.select("*", F.pmod(F.xxhash64("k1", "k2"), F.lit(blocks)).cast("int").alias("block"), F.explode(F.sequence(F.lit(0), F.lit(shares - 1))).alias("share"))
    right = rows.select("*", share).select("*", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"))
    return left.groupBy("block", "share").cogroup(right.groupBy("block", "share")).applyInArrow(work, schema)


def longest(rows: DataFrame, vector: str) -> int:
    return rows.agg(F.max(F.size(vector))).first()[0] or 0
