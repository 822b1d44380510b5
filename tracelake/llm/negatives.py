"""Hard negatives by threshold joins: partial inverted indexes, partial scores pruned by remaining norms, thresholds lowered until windows fill."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracelake.llm import vectors
from tracelake.llm.common import row_keys, store

#: Partial scores one step of a join holds at a time, and pairs it verifies at a time.
CELLS, PAIRS = 1 << 22, 1 << 16
#: Dimensions accumulated between two prunings.
DIMENSIONS = 8
#: Bounds are widened by this share of the product of both lengths: far more than the rounding of a norm.
SLACK = 1e-9
#: Where thresholds stand between the top of what can be asked for and its floor.
LEVELS = (0.25, 0.5, 0.75, 0.9, 1.0)


def suffix_norms(rows: np.ndarray) -> np.ndarray:
    """Column d: the length of what a row holds from dimension d on."""
    top = np.abs(rows).max(axis=1, initial=0)
    unit = rows / np.where(top > 0, top, 1)[:, None]
    rest = np.sqrt(np.cumsum(unit[:, ::-1] ** 2, axis=1)[:, ::-1]) * top[:, None]
    return np.concatenate([rest, np.zeros((len(rows), 1))], axis=1)


class Index:
    """Inverted lists of a block of rows for pairs that score at least ``least`` times the query's length.

    A row's last dimensions are left out once their norm is below ``least``: they cannot reach a threshold alone. Dimensions come in the order of
    their energy, and rows in that of how many of them they need, so the list of a dimension is a run of the first rows.
    """

    def __init__(self, rows: np.ndarray, least: float):
        self.dimensions = np.argsort(-np.abs(rows).max(axis=0, initial=0) * np.abs(rows).mean(axis=0) if len(rows) else np.zeros(rows.shape[1]), kind="stable")
        ordered = rows[:, self.dimensions]
        rest = suffix_norms(ordered)
        needed = (rest >= least * (1 - SLACK)).sum(axis=1) if least > 0 else np.full(len(rows), rows.shape[1])
        needed = np.minimum(needed, rows.shape[1])
        self.place = np.argsort(-needed, kind="stable")
        self.needed = needed[self.place]
        ordered, self.rest = ordered[self.place], rest[self.place]
        self.left_out = self.rest[np.arange(len(rows)), self.needed]
        self.lists = np.where(np.arange(rows.shape[1]) < self.needed[:, None], ordered, 0.0)

    def candidates(self, queries: np.ndarray, thresholds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(query, row) of all pairs that may reach their query's threshold, and few others."""
        q, n = queries[:, self.dimensions], len(self.place)
        rest = suffix_norms(q)
        slack = SLACK * rest[:, :1] * self.rest[None, :, 0] + 0.5
        wanted = thresholds[:, None] - slack
        score = np.zeros((len(q), n))
        open_rows = np.arange(n)
        for d in range(0, q.shape[1], DIMENSIONS):
            open_rows = open_rows[: np.searchsorted(-self.needed[open_rows], -d, side="left")]
            if not len(open_rows):
                break
            end = min(d + DIMENSIONS, q.shape[1])
            score[:, open_rows] += q[:, d:end] @ self.lists[open_rows, d:end].T
            still = self.needed[open_rows] > end
            ahead = rest[:, end, None] * self.rest[open_rows, end]
            # Rows that no query can bring to its threshold any more are done with.
            alive = (score[:, open_rows] + ahead >= wanted[:, open_rows]).any(axis=0)
            score[:, open_rows[still & ~alive]] = -np.inf
            open_rows = open_rows[still & alive]
        reach = score + rest[:, self.needed] * self.left_out
        of, at = np.nonzero(reach >= wanted)
        return of, self.place[at]


def threshold_join(queries: np.ndarray, rows: np.ndarray, thresholds: np.ndarray, take: Callable[[np.ndarray, np.ndarray, np.ndarray], None]) -> None:
    """Calls ``take(query, rows, scores)`` for blocks of queries with all pairs of at least the thresholds; exact, in bounded memory."""
    if not len(queries) or not len(rows):
        return
    length = vectors.norms(queries)
    with np.errstate(divide="ignore", invalid="ignore"):
        least = np.where(length > 0, thresholds / length, -np.inf).min()
    index = Index(rows, float(least))
    step = max(1, CELLS // len(rows))
    for a in range(0, len(queries), step):
        of, at = index.candidates(queries[a : a + step], thresholds[a : a + step].astype(float))
        of = of + a
        score = np.concatenate([np.zeros(0, np.int64), *[vectors.dots(queries[of[i : i + PAIRS]], rows[at[i : i + PAIRS]]) for i in range(0, len(of), PAIRS)]])
        good = score >= thresholds[of]
        take(of[good], at[good], score[good])


def _by_query(of: np.ndarray, n: int) -> np.ndarray:
    """Borders of each query's run in the sorted ``of``."""
    return np.searchsorted(of, np.arange(n + 1))


def nearest(queries: np.ndarray, rows: np.ndarray, ids: pa.Array, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, row, score) of the ``k`` best rows of each query: thresholds fall from the highest possible score until ``k`` are found."""
    top = vectors.norms(queries) * vectors.norms(rows).max(initial=0) + 1
    open_, out = np.arange(len(queries)), []
    for level in (*LEVELS, 2.0):
        thresholds = np.maximum(np.floor(top[open_] * (1 - level)), -(2.0**63)).astype(np.int64)
        last, filled = level == 2.0, []

        def take(of: np.ndarray, at: np.ndarray, score: np.ndarray) -> None:
            cuts = _by_query(of, len(open_))  # noqa: B023
            for i in np.unique(of).tolist():
                a, b = cuts[i], cuts[i + 1]
                if b - a >= k or last:  # noqa: B023
                    found = a + vectors.best(score[a:b], ids, at[a:b], k)
                    out.append((np.full(len(found), open_[i]), at[found], score[found]))  # noqa: B023
                    filled.append(i)  # noqa: B023

        threshold_join(queries[open_], rows, thresholds, take)
        open_ = np.delete(open_, filled)
        if not len(open_):
            break
    return tuple(np.concatenate([np.zeros(0, np.int64), *[o[i] for o in out]]) for i in range(3))


def windowed(queries: np.ndarray, windows: list[list[tuple[int, int, int]]], rows: np.ndarray, ids: pa.Array, k: int) -> list[tuple[int, int, int, int]]:
    """(query, window's name, row, score) of the ``k`` best rows in each window (name, low, high) of each query.

    A query's threshold starts near the top of its windows and falls towards their floors; a window with ``k`` rows above
    the level is full, as all below would rank after them, and closes.
    """
    out, open_ = [], {i: list(w) for i, w in enumerate(windows) if w}
    for level in LEVELS:
        if not open_:
            break
        names = np.array(list(open_))
        at_level = {i: [high - int((high - low) * level) if level < 1 else low for _, low, high in w] for i, w in open_.items()}
        thresholds = np.array([min(at_level[i]) for i in names.tolist()], np.int64)

        def take(of: np.ndarray, at: np.ndarray, score: np.ndarray) -> None:
            cuts = _by_query(of, len(names))  # noqa: B023
            for j in np.unique(of).tolist():
                i, a, b = int(names[j]), cuts[j], cuts[j + 1]  # noqa: B023
                left = []
                for (name, low, high), least in zip(open_[i], at_level[i], strict=True):  # noqa: B023
                    inside = a + np.flatnonzero((score[a:b] <= high) & (score[a:b] >= least))
                    if len(inside) < k and level < 1:  # noqa: B023
                        left.append((name, low, high))
                        continue
                    found = inside[vectors.best(score[inside], ids, at[inside], k)]
                    out.extend((i, name, r, s) for r, s in zip(at[found].tolist(), score[found].tolist(), strict=True))
                open_[i] = left

        threshold_join(queries[names], rows, thresholds, take)
        open_ = {i: w for i, w in open_.items() if w}
    return out


def _per_label(queries: pa.Table, rows: pa.Table) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(label, queries of it, rows of it) as places, for the labels that have queries."""
    of_query, of_row = queries["label"].to_numpy(), rows["label"].to_numpy()
    return [(np.flatnonzero(of_query == label), of_row == label) for label in np.unique(of_query)]


def _positives(k: int) -> Callable[[pa.Table, pa.Table], pa.Table]:
    def work(queries: pa.Table, rows: pa.Table) -> pa.Table:
        q, x = vectors.matrices(queries["vector"], rows["vector"])
        ids, found = rows["vec_id"].combine_chunks(), []
        for mine, same in _per_label(queries, rows):
            theirs = np.flatnonzero(same)
            of, at, score = nearest(q[mine], x[theirs], ids.take(pa.array(theirs)), k)
            found.append((mine[of], theirs[at], score))
        of, at, score = (np.concatenate([np.zeros(0, np.int64), *[f[i] for f in found]]) for i in range(3))
        own = np.ones(len(of), bool)
        for c in ("k1", "k2"):
            own &= queries[c].to_numpy()[of] == rows[c].to_numpy()[at]
        who = queries.select(["k1", "k2"]).take(pa.array(of))
        return who.append_column("positive_id", pc.take(ids, pa.array(at))).append_column("positive_score", pa.array(score)).append_column("own", pa.array(own))

    return work


def _negatives(k: int, low: int, high: int) -> Callable[[pa.Table, pa.Table], pa.Table]:
    def work(queries: pa.Table, rows: pa.Table) -> pa.Table:
        q, x = vectors.matrices(queries["vector"], rows["vector"])
        ids, scores = rows["vec_id"].combine_chunks(), queries["positive_scores"].to_pylist()
        spans = [[(s, -(-low * s // 100), high * s // 100) for s in of if -(-low * s // 100) <= high * s // 100] for of in scores]
        found: list[tuple[int, int, int, int]] = []
        for mine, same in _per_label(queries, rows):
            theirs = np.flatnonzero(~same)
            part = windowed(q[mine], [spans[i] for i in mine.tolist()], x[theirs], ids.take(pa.array(theirs)), k)
            found += [(int(mine[i]), s, int(theirs[r]), score) for i, s, r, score in part]
        of, span, at, score = (np.array([f[i] for f in found], np.int64) for i in range(4))
        who = queries.select(["k1", "k2"]).take(pa.array(of)).append_column("positive_score", pa.array(span))
        return who.append_column("negative_id", pc.take(ids, pa.array(at))).append_column("negative_score", pa.array(score))

    return work


def hard_negatives(rows: DataFrame, every: int = 100, positives: int = 5, negatives: int = 5, low: int = 80, high: int = 100, scale: int = 256) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) for the rows whose vec_id is divisible by ``every``.

    ``rows`` has vec_id, embedding and label; components become floor(``scale`` * x) and scores are whole inner products. An anchor's positives are the
    ``positives`` best other rows of its label; for each of them the ``negatives`` best rows of other labels are returned whose score
    is from ``low`` to ``high`` percent of the positive's. Ties go to the smaller vec_id, null ids last. Rows with a null label, a null vector, or a null
    or non-finite component (also once scaled) take no part; a null id is never an anchor. Rows count each on their own, equal ones too; equal anchors
    each have their result, and an anchor is not its own positive. Shorter vectors end in zeros. Fewer rows than asked for: all of them; a positive without
    negatives, or with a negative score, gives no row. Other columns are not read.
    """
    whole = rows.filter(vectors.usable("embedding", scale) & F.col("label").isNotNull()).select(
        F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), vectors.scaled("embedding", scale).alias("vector")
    )
    table = store(whole.select("*", *row_keys(F.col("vec_id"), F.col("label"), F.col("vector"))))
    components = vectors.longest(table, "vector")
    asked = table.filter(F.col("vec_id") % every == 0).groupBy("k1", "k2")
    anchors = store(asked.agg(F.count(F.lit(1)).alias("copies"), *[F.first(c).alias(c) for c in ("vec_id", "label", "vector")]))
    key = ["k1", "k2"]

    # One more than asked for, as an anchor may find itself.
    schema = "k1 long, k2 long, positive_id long, positive_score long, own boolean"
    found = vectors.against_all(anchors, table, components, _positives(positives + 1), schema)
    order = [F.desc("positive_score"), F.asc_nulls_last("positive_id")]
    near = found.withColumn("place", F.row_number().over(Window.partitionBy(*key).orderBy(*order, F.desc("own")))).filter(F.col("place") <= positives + 1)
    others = near.withColumn("nth", F.row_number().over(Window.partitionBy(*key, "own").orderBy("place"))).filter(~(F.col("own") & (F.col("nth") == 1)))
    place = F.row_number().over(Window.partitionBy(*key).orderBy("place"))
    chosen = store(others.withColumn("nth", place).filter(F.col("nth") <= positives).select(*key, "positive_id", "positive_score"))

    sought = store(anchors.join(chosen.groupBy(*key).agg(F.collect_set("positive_score").alias("positive_scores")), key))
    schema = "k1 long, k2 long, positive_score long, negative_id long, negative_score long"
    found = vectors.against_all(sought, table, components, _negatives(negatives, low, high), schema)
    rank = F.row_number().over(Window.partitionBy(*key, "positive_score").orderBy(F.desc("negative_score"), F.asc_nulls_last("negative_id")))
    hard = found.withColumn("rank", rank).filter(F.col("rank") <= negatives)
    named = hard.join(chosen, [*key, "positive_score"]).join(anchors.select(*key, F.col("vec_id").alias("anchor_id"), "copies"), key)
    out = named.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score", F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("copy"))
    return out.drop("copy")
