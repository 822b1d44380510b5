"""Exact top-k search: a table of angles to pivots bounds every score; candidates are evaluated in the order of their bounds."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracelake.llm import vectors
from tracelake.llm.common import row_keys, store

#: Pivots, and the rows of which they are chosen; both bound what passes through the driver.
PIVOTS, PIVOT_SAMPLE = 32, 1024
#: Bounds are widened by this share of the product of both lengths: far more than the rounding of an angle.
SLACK = 1e-6


def angles(rows: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """Angle of each row to each pivot; zero where either has no length, so that it bounds nothing."""
    length, of_pivot = vectors.norms(rows), vectors.norms(pivots)
    unit = rows / np.where(length > 0, length, 1)[:, None]
    cosine = unit @ (pivots / np.where(of_pivot > 0, of_pivot, 1)[:, None]).T
    return np.where((length > 0)[:, None] & (of_pivot > 0), np.arccos(np.clip(cosine, -1, 1)), 0.0)


def choose_pivots(sample: np.ndarray, n: int) -> np.ndarray:
    """``n`` rows far from each other: each next one has the widest angle to its nearest one so far."""
    sample = np.unique(sample[vectors.norms(sample) > 0], axis=0)
    if not len(sample):
        return sample
    chosen, nearest = [0], angles(sample, sample[:1])[:, 0]
    while len(chosen) < min(n, len(sample)):
        chosen.append(int(nearest.argmax()))
        nearest = np.minimum(nearest, angles(sample, sample[chosen[-1:]])[:, 0])
    return sample[chosen]


def pivot_table(rows: DataFrame, n_pivots: int = PIVOTS, sample: int = PIVOT_SAMPLE) -> DataFrame:
    """``rows`` (with ``vector``, k1 and k2) and ``angles``, those to ``n_pivots`` pivots, written once.

    The pivots come from the ``sample`` rows with the smallest keys. A poor choice costs time, never a result.
    """
    drawn = [r[0] for r in rows.select("vector").orderBy("k1", "k2").limit(sample).collect()]
    width = max(map(len, drawn), default=0)
    padded = np.array([v + [0.0] * (width - len(v)) for v in drawn]).reshape(len(drawn), width)
    pivots = choose_pivots(padded, n_pivots)
    names = rows.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = vectors.matrix(batch.column(names.index("vector")), pivots.shape[1])
            table = angles(x, np.pad(pivots, ((0, 0), (0, x.shape[1] - pivots.shape[1]))))
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * table.shape[1], pa.int32()), pa.array(table.ravel()))
            yield pa.RecordBatch.from_arrays([*batch.columns, lists], [*names, "angles"])

    return store(rows.mapInArrow(run, "vec_id long, vector array<double>, k1 long, k2 long, angles array<double>"))


def search(query: np.ndarray, to_pivots: np.ndarray, rows: np.ndarray, table: np.ndarray, length: np.ndarray, ids: pa.Array, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(rows, scores) of the ``k`` best by inner product, ties to the smaller id.

    Angles obey the triangle inequality: a row is at least as far from the query as their angles to any pivot differ, and the pivot with the widest
    difference gives the least upper bound of its score. Rows are evaluated in the order of the bounds, in growing steps, until
    the next bound is below the k-th score: nothing after it can enter or tie.
    """
    apart = np.abs(table - to_pivots).max(axis=1, initial=0)
    reach = vectors.norms(query[None])[0] * length
    bound = np.nan_to_num(reach * np.cos(np.minimum(apart, np.pi)) + reach * SLACK, nan=np.inf) + 1
    order = np.argsort(-bound, kind="stable")
    at, score = np.zeros(0, np.int64), np.zeros(0, np.int64)
    done, step = 0, 4 * k
    while done < len(order) and (len(score) < k or bound[order[done]] >= score[-1]):
        next_ = order[done : done + step]
        at, score = np.concatenate([at, next_]), np.concatenate([score, vectors.dots(query, rows[next_])])
        kept = vectors.best(score, ids, at, k)
        at, score = at[kept], score[kept]
        done, step = done + len(next_), min(2 * step, 4096)
    return at, score


def _searcher(k: int) -> Callable[[pa.Table, pa.Table], pa.Table]:
    def work(queries: pa.Table, rows: pa.Table) -> pa.Table:
        q, x = vectors.matrices(queries["vector"], rows["vector"])
        to_pivots, table = vectors.matrices(queries["angles"], rows["angles"])
        length, ids = vectors.norms(x), rows["vec_id"].combine_chunks()
        keys = [[t[c].to_numpy() for c in ("k1", "k2")] for t in (queries, rows)]
        of, at, scores = [], [], []
        for i in range(len(q) if len(x) else 0):
            found, score = search(q[i], to_pivots[i], x, table, length, ids, k)
            of.append(np.full(len(found), i))
            at.append(found)
            scores.append(score)
        of, at, scores = (np.concatenate(a) if a else np.zeros(0, np.int64) for a in (of, at, scores))
        own = (keys[0][0][of] == keys[1][0][at]) & (keys[0][1][of] == keys[1][1][at])
        who = queries.select(["k1", "k2", "vec_id", "copies"]).take(pa.array(of, pa.int64())).rename_columns(["k1", "k2", "query_id", "copies"])
        return who.append_column("vec_id", pc.take(ids, pa.array(at, pa.int64()))).append_column("score", pa.array(scores)).append_column("own", pa.array(own))

    return work


def top_k(rows: DataFrame, every: int = 100, k: int = 10, scale: int = 1024, n_pivots: int = PIVOTS) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row whose vec_id is divisible by ``every`` the ``k`` other rows with the highest inner product.

    ``rows`` has vec_id and embedding; components become floor(``scale`` * x). Rows with a null vector, or a null or non-finite component (also once
    scaled), take no part. Ties go to the smaller vec_id, null ids last; a null id is never a query. Missing components of shorter vectors count as zero.
    Rows are candidates each on their own, equal ones too, and equal queries each have their list; a query skips itself alone. Scores beyond a
    long become the nearest long. Fewer than ``k`` others: all of them. No rows: no rows. Other columns are not read.
    """
    whole = rows.filter(vectors.usable("embedding", scale)).select(F.col("vec_id").cast("long").alias("vec_id"), vectors.scaled("embedding", scale).alias("vector"))
    table = pivot_table(store(whole.select("*", *row_keys(F.col("vec_id"), F.col("vector")))), n_pivots)
    asked = table.filter(F.col("vec_id") % every == 0)
    queries = store(asked.groupBy("k1", "k2").agg(F.count(F.lit(1)).alias("copies"), *[F.first(c).alias(c) for c in ("vec_id", "vector", "angles")]))
    # One more than k, as a query may find itself.
    found = vectors.against_all(
        queries, table, vectors.longest(table, "vector"), _searcher(k + 1), "k1 long, k2 long, query_id long, copies long, vec_id long, score long, own boolean"
    )
    order = [F.desc("score"), F.asc_nulls_last("vec_id")]
    near = found.withColumn("place", F.row_number().over(Window.partitionBy("k1", "k2").orderBy(*order, F.desc("own")))).filter(F.col("place") <= k + 1)
    nth_own = F.row_number().over(Window.partitionBy("k1", "k2", "own").orderBy("place"))
    others = near.withColumn("nth", nth_own).filter(~(F.col("own") & (F.col("nth") == 1)))
    ranked = others.withColumn("rank", F.row_number().over(Window.partitionBy("k1", "k2").orderBy("place"))).filter(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score", F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("copy")).drop("copy")
