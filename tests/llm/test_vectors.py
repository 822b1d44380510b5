"""Exact top-k search and hard negatives against plain Python: whole table, ties, copies, odd vectors."""

import math
import random

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tracelake.llm import negatives, topk, vectors
from tracelake.llm.queries import QUERIES

ROWS = "vec_id long, embedding array<double>, label int"


def whole(vector, scale):
    """Components as Python integers; None where the vector takes no part."""
    if vector is None or any(x is None or not math.isfinite(x * scale) for x in vector):
        return None
    return [math.floor(x * scale) for x in vector]


def dot(a, b):
    return max(-(2**63), min(2**63 - 1, sum(x * y for x, y in zip(a, b, strict=False))))


def in_order(found):
    """Highest score first, then smallest id, null ids last."""
    return sorted(found, key=lambda f: (-f[0], f[1] is None, f[1] or 0))


def brute_top_k(rows, every=100, k=10, scale=1024):
    kept = [(i, v) for i, x, _ in rows if (v := whole(x, scale)) is not None]
    out = []
    for place, (i, q) in enumerate(kept):
        if i is not None and i % every == 0:
            near = in_order([(dot(q, x), j) for other, (j, x) in enumerate(kept) if other != place])[:k]
            out += [(i, rank, j, score) for rank, (score, j) in enumerate(near, 1)]
    return sorted(out, key=repr)


def brute_negatives(rows, every=100, scale=256, k=5, low=80, high=100):
    kept = [(i, v, label) for i, x, label in rows if label is not None and (v := whole(x, scale)) is not None]
    out = []
    for place, (i, q, label) in enumerate(kept):
        if i is None or i % every:
            continue
        scored = [(dot(q, x), j, other) for at, (j, x, other) in enumerate(kept) if at != place]
        for ps, p, _ in in_order([s for s in scored if s[2] == label])[:k]:
            hard = in_order([s for s in scored if s[2] != label and low * ps <= 100 * s[0] <= high * ps])[:k]
            out += [(i, p, rank, j, ps, ns) for rank, (ns, j, _) in enumerate(hard, 1)]
    return sorted(out, key=repr)


def got(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def frame(spark, rows, clashes=True):
    df = spark.createDataFrame(rows, ROWS).repartition(5)
    names = ["vector", "angles", "k1", "k2", "block", "share", "copies", "score", "rank", "own"]
    return df.select("*", *[F.lit(c).alias(c) for c in names]) if clashes else df


@pytest.fixture(scope="module")
def table(sf_dir):
    return duckdb.sql(f"SELECT vec_id, embedding, label FROM '{sf_dir}/embeddings.parquet'").fetchall()


@pytest.fixture(scope="module")
def odd():
    """Clusters, copies under equal and other ids, zero and ragged vectors, nulls, non-finite components, null and repeated ids."""
    r = np.random.default_rng(1)
    centres = r.normal(size=(6, 12))
    rows = [(i, (centres[i % 6] + 0.3 * r.normal(size=12)).tolist(), i % 3) for i in range(150)]
    rows += [(200 + i, rows[10][1], 1) for i in range(30)] + [rows[100], rows[100], rows[0], (100, rows[3][1], 2), (300, rows[0][1], 0), (400, [0.0] * 12, 0), (401, [0.0] * 12, 1)]
    rows += [(None, rows[0][1], 0), (None, rows[5][1], None), (500, None, 1), (501, [1.0, None], 1), (600, [math.nan] * 12, 0), (700, [math.inf] + [0.0] * 11, 2), (800, [], 0), (900, [2.5, -1.5], 1)]
    rows += [(1000, rows[0][1], None), (1100, (-centres[0]).tolist(), 0), (1200, [0.25] * 12, 2), (1201, [0.25] * 12, 2), (1202, [0.25] * 12, 1)]
    return rows


def test_top_k_of_the_table(spark, sf_dir, table):
    assert got(QUERIES["op12_exact_top_k"](spark, sf_dir)) == brute_top_k(table)


def test_negatives_of_the_table(spark, sf_dir, table):
    shifted = [(i, x, (label + 1) % 10 if i % 7 == 0 else label) for i, x, label in table]
    assert got(QUERIES["op13_hard_negatives"](spark, sf_dir)) == brute_negatives(shifted)


@pytest.mark.parametrize("block,components", [(4096, 1 << 22), (2, 100)])
def test_odd_rows(spark, odd, monkeypatch, block, components):
    """Small blocks of queries and shares of candidates give the same rows."""
    monkeypatch.setattr(vectors, "QUERY_BLOCK", block)
    monkeypatch.setattr(vectors, "SHARE_COMPONENTS", components)
    assert got(topk.top_k(frame(spark, odd))) == brute_top_k(odd)
    assert got(negatives.hard_negatives(frame(spark, odd))) == brute_negatives(odd)


def test_other_parameters(spark, odd):
    assert got(topk.top_k(frame(spark, odd), every=7, k=3, scale=10, n_pivots=2)) == brute_top_k(odd, 7, 3, 10)
    found = negatives.hard_negatives(frame(spark, odd), every=50, positives=3, negatives=3, low=50, high=130, scale=10)
    assert got(found) == brute_negatives(odd, 50, 10, 3, 50, 130)


def test_few_rows(spark):
    for rows in ([], [(0, [1.0], 1)], [(0, [1.0], 1), (1, [2.0], 1)], [(0, [1.0], 1), (1, [2.0], 1), (2, [1.9], 2), (3, [0.1], 2)], [(0, None, None)], [(None, [1.0], 1)] * 3):
        df = frame(spark, rows, clashes=False)
        assert got(topk.top_k(df)) == brute_top_k(rows)
        assert got(negatives.hard_negatives(df)) == brute_negatives(rows)


def test_huge_components(spark):
    """Scores beyond the range of doubles' whole numbers stay exact; beyond a long they become the nearest long."""
    r = random.Random(2)
    rows = [(i, [r.choice([-1, 1]) * r.randrange(2**18, 2**19) + r.random() for _ in range(6)], i % 2) for i in range(120)]
    rows += [(200, [1e300, -1e300], 0), (201, [1e305, 1e3], 1), (300, [1e10, 1.0], 1)]
    assert got(topk.top_k(frame(spark, rows), scale=1024)) == brute_top_k(rows)


def test_search_stops_early():
    """Rows far beyond the bound are not evaluated, and nothing that could tie is missed."""
    r = np.random.default_rng(3)
    centres = np.eye(8) * 1000
    rows = np.floor(np.repeat(centres, 500, axis=0) + r.normal(size=(4000, 8)))
    pivots = topk.choose_pivots(rows[::7], 8)
    table, evaluated = topk.angles(rows, pivots), []
    real = vectors.dots

    def counted(q, x):
        evaluated.append(len(x))
        return real(q, x)

    vectors.dots = counted
    try:
        at, score = topk.search(rows[0], table[0], rows, table, vectors.norms(rows), pa.array(np.arange(4000)), 10)
    finally:
        vectors.dots = real
    assert sum(evaluated) < 1500
    want = np.lexsort((np.arange(4000), -(rows @ rows[0])))[:10]
    assert at.tolist() == want.tolist() and score.tolist() == (rows @ rows[0])[want].astype(int).tolist()


def test_bounds_hold():
    r = np.random.default_rng(4)
    rows = np.floor(r.normal(size=(300, 10)) * 100)
    rows[5] = 0
    table = topk.angles(rows, topk.choose_pivots(rows, 16))
    for i in range(40):
        apart = np.abs(table - table[i]).max(axis=1)
        reach = vectors.norms(rows[i][None])[0] * vectors.norms(rows)
        assert (rows @ rows[i] <= reach * np.cos(apart) + reach * topk.SLACK + 1).all()


def test_index_leaves_out_what_cannot_matter():
    r = np.random.default_rng(5)
    rows = np.floor(r.normal(size=(400, 32)) * 256 * 0.8 ** np.arange(32))
    queries = rows[:20]
    length = vectors.norms(queries)
    for share in (0.9, 0.6, 0.3):
        thresholds = np.floor(length * length.max() * share).astype(np.int64)
        index = negatives.Index(rows, float((thresholds / length).min()))
        assert index.needed.sum() < rows.size
        pairs = {}
        negatives.threshold_join(queries, rows, thresholds, lambda of, at, s: pairs.update({(a, b): c for a, b, c in zip(of.tolist(), at.tolist(), s.tolist(), strict=True)}))
        full = (queries @ rows.T).astype(np.int64)
        assert pairs == {(a, b): full[a, b] for a, b in zip(*map(np.ndarray.tolist, np.nonzero(full >= thresholds[:, None])), strict=True)}
        of, _ = index.candidates(queries, thresholds.astype(float))
        assert len(of) < full.size
