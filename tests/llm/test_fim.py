"""Fill-in-middle: the contract against plain Python, exact round trips, odd rows."""

import hashlib
import random
import re

import duckdb
import pytest
from pyspark.sql import functions as F

from tests.llm import brute
from tracelake.llm import fim
from tracelake.llm.queries import QUERIES

UNIT = re.compile(r"[^\n]*\n|[^\n]+")


def plain_version(doc_id, text):
    """(n, form, prefix_chars, middle_chars, output), written from the contract."""
    units = UNIT.findall(text)
    n = len(units)
    digest = hashlib.sha256(f"7:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * i : 8 * i + 8], 16) for i in range(4)]
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")):
        return n, "plain", None, None, text
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    prefix, middle, suffix = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    form = "spm" if h[3] % 100 < 50 else "psm"
    output = f"<S>{suffix}<P>{prefix}<M>{middle}" if form == "spm" else f"<P>{prefix}<S>{suffix}<M>{middle}"
    return n, form, len(prefix), len(middle), output


def test_whole_table(spark, sf_dir):
    docs = duckdb.sql(f"SELECT doc_id, coalesce(text, '') FROM '{sf_dir}/documents.parquet'").fetchall()
    got = {r[0]: tuple(r[1:]) for r in QUERIES["op11_fill_in_middle"](spark, sf_dir).collect()}
    want = {}
    for doc_id, text in docs:
        *facts, output = plain_version(doc_id, text)
        want[doc_id] = (*facts, brute.sha(output), brute.sha(text))
    assert got == want and {"spm", "psm"} <= {v[1] for v in got.values()}


def test_odd_texts(spark):
    texts = [None, "", "\n", "\n\n\n", "a", "a\nb", "ü\n🙂\n\nlast", "has <P> in it\nx", "< P>\n<S\n>M>", "<\nP>", "\r\n\x00\n line", "x\n" * 40_000, "y" * 300_000, "<<<\n>>>\n<P\n>"]
    rows = [(i, t, "clash", 1) for i, t in enumerate(texts)] + [(None, "a\nb\nc", None, None), (6, texts[6], "again", 2), (None, None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, output string, n int")
    rewritten = fim.fill_in_middle(docs)
    got = sorted((tuple(r) for r in rewritten.collect()), key=repr)
    assert got == sorted(((r[0], *plain_version(r[0], r[1] or "")) for r in rows), key=repr)
    back = fim.restore(rewritten.withColumn("extra", F.lit(1)))
    assert back.columns == [*rewritten.columns, "extra", "restored"]
    assert sorted((r.doc_id, r.restored) for r in back.collect() if r.doc_id is not None) == sorted((r[0], r[1] or "") for r in rows if r[0] is not None)
    assert fim.fill_in_middle(docs.limit(0)).collect() == [] and fim.restore(rewritten.limit(0)).collect() == []
    unknown = spark.createDataFrame([(None, "psm"), ("x", None), ("x", "plain")], "output string, form string")
    assert [r.restored for r in fim.restore(unknown).collect()] == [None, None, "x"]


@pytest.mark.parametrize("form", ["psm", "spm"])
def test_rotations_invert(form):
    r, marks = random.Random(form), fim.Rule().marks
    for _ in range(300):
        raw = "".join(r.choice("ab<>PSM\nü") for _ in range(r.randrange(1, 40)))
        if any(m.decode() in raw for m in marks):
            continue
        raw = raw.encode()
        first, second = sorted(r.randrange(len(raw) + 1) for _ in range(2))
        output = bytes(fim.rearrange(raw, first, second, form, marks))
        p, m, s = raw[:first], raw[first:second], raw[second:]
        assert output == (b"<P>" + p + b"<S>" + s + b"<M>" + m if form == "psm" else b"<S>" + s + b"<P>" + p + b"<M>" + m)
        assert fim.rebuild(output, form, marks) == raw


def test_rotate_in_place():
    for n in range(8):
        for cut in range(n + 1):
            buffer = bytearray(range(n))
            fim.rotate(buffer, 0, cut, n)
            assert list(buffer) == [*range(cut, n), *range(cut)]


def test_rules(spark):
    docs = spark.range(400).select(F.col("id").alias("doc_id"), F.lit("a\nb\nc\n").alias("text"))
    forms = lambda **how: [r.form for r in fim.fill_in_middle(docs, fim.Rule(**how)).collect()]
    assert set(forms(percent=0)) == {"plain"} and set(forms(spm_percent=100)) == {"spm"} and set(forms(spm_percent=0)) == {"psm"}
    assert 100 < forms(percent=50).count("plain") < 300
    for bad in (("", "b", "c"), ("a", "a", "c"), ("ab", "b", "c"), ("<x", "x>", "y")):
        with pytest.raises(ValueError):
            fim.Rule(prefix=bad[0], suffix=bad[1], middle=bad[2])
