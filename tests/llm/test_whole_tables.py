"""The queries that SQL cannot express, over the whole smallest tables, against plain Python."""

import base64
import html as htmllib
import re

import duckdb
import numpy as np
import public_tokenizers
import pytest
import tiktoken

from tests.llm import brute
from tracelake.llm import fingerprint
from tracelake.llm.queries import QUERIES


@pytest.fixture(scope="module")
def docs(sf_dir):
    return duckdb.sql(f"SELECT doc_id, coalesce(text, '') FROM '{sf_dir}/documents.parquet' ORDER BY 1").fetchall()


def encoder():
    lines = open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def got(spark, sf_dir, name):
    return {r[0]: tuple(r[1:]) for r in QUERIES[name](spark, sf_dir).collect()}


def test_personal_data(spark, sf_dir, docs):
    """Base spans by plain Python; what is discovered beyond them are the quoted tokens, all of them and nothing else."""
    found = got(spark, sf_dir, "op1_pii_spans")
    assert len(found) == len(docs)
    tokens = {m[1] for _, text in docs for m in re.finditer(r'token = "([0-9a-f]{40})"', text)}
    for doc_id, text in docs:
        base = brute.base_spans(text)
        joined = ",".join(f"{k}:{a}:{b}" for k, a, b in base)
        assert found[doc_id][:5] == (*[sum(s[0] == k for s in base) for k in ("email", "ip", "card", "phone")], brute.sha(joined))
        new = [f"secret:{m.start()}:{m.end()}" for m in re.finditer(r"(?<![0-9a-f])[0-9a-f]{40}(?![0-9a-f])", text) if m[0] in tokens] if len(tokens) > 3 else []
        assert found[doc_id][5] == ",".join([*filter(None, [joined]), *new]) and found[doc_id][6] == len(base) + len(new)


def test_repeated_strings(spark, sf_dir, docs):
    want = {d: (*v[:3], brute.sha(v[3])) for d, v in brute.repeats(docs).items()}
    assert got(spark, sf_dir, "op2_suffix_dedup") == want


def test_bpe(spark, sf_dir, docs):
    e = encoder()
    ids = {d: e.encode_ordinary(t) for d, t in docs}
    want = {d: (len(ids[d]), brute.sha(np.array(ids[d], "<u4").tobytes()), brute.sha(t)) for d, t in docs}
    assert got(spark, sf_dir, "op3_byte_bpe") == want


def test_fingerprints_of_edits(spark, sf_dir, docs):
    got_ = got(spark, sf_dir, "op4_spot_signatures")
    assert len(got_) == len(docs)
    sizes = {}
    for i, (d, t) in enumerate(docs):
        after = docs[(i + 1) % len(docs)][1]
        edit = t[: len(t) - len(t) // 2] + after[: len(t) // 2]
        a, b, c = map(brute.spots, (t, edit, after))
        n_chars, sha, own, changed, near_edited, near_next = got_[d]
        assert (n_chars, sha, near_edited, near_next) == (len(t), brute.sha(edit), brute.alike(a, b), brute.alike(a, c))
        assert (len(fingerprint.decode(own)), len(fingerprint.decode(changed))) == (len(a), len(b))
        sizes.setdefault(own, a)
        assert sizes[own] == a  # equal fingerprints, equal signatures
    assert len(sizes) == len({frozenset(s) for s in sizes.values()})
    near, far = [v[4] for v in got_.values()], [v[5] for v in got_.values()]
    assert np.median(near) > 0.3 and np.median(far) < 0.05


def test_documents_with_like_signatures(spark, sf_dir, docs):
    """Every pair at least 0.8 alike is found: the classes equal those of a comparison of all pairs."""
    found = fingerprint.near_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"), 0.8)
    want = brute.linked({d: brute.spots(t) for d, t in docs}, 0.8)
    assert {r.doc_id: r.class_id for r in found.collect()} == want and len(set(want.values())) < len(docs)


def test_near_duplicates(spark, sf_dir, docs):
    fps = {d: brute.fingerprint(t) for d, t in docs}
    label = brute.classes(fps)
    assert got(spark, sf_dir, "op9_simhash") == {d: (f"{fps[d]:016x}", label[d]) for d in fps}


def test_pages(spark, sf_dir):
    pages = duckdb.sql(f"SELECT page_id, url, html FROM '{sf_dir}/pages.parquet'").fetchall()
    want = {}
    for page_id, url, html in pages:
        article = re.search(r"<article>(.*?)</article>", html, re.S)[1].replace("<br>", " ")
        blocks = [re.sub(r"<[^>]*>", "", b) for b in re.split(r"</?(?:p|h1)>", article)]
        text = "\n".join(x for x in (" ".join(htmllib.unescape(b).split()) for b in blocks) if x)
        want[page_id] = url, text, len(text)
    assert got(spark, sf_dir, "op10_page_text") == want


def test_pipeline_stages(spark, sf_dir):
    """Each stage on its own input, against plain Python or the SQL of its operator."""
    import corpus_pipeline
    from tracelake.llm import sql
    from tracelake.llm.common import store, table

    documents = table(spark, sf_dir, "documents")
    stage = dict(corpus_pipeline.STAGES)
    assert list(stage) == ["quality rules", "line dedup", "near dedup", "source mix", "byte BPE"]
    con = duckdb.connect()
    labels = f"'{sf_dir}/labels.parquet'"
    rows = lambda df: [tuple(r) for r in df.select("doc_id", "text", "lang", "source", "n_chars").collect()]

    kept = store(stage["quality rules"](spark, documents, sf_dir))
    assert kept.columns == documents.columns
    want = con.sql(f"SELECT doc_id FROM ({sql.judged(f'(SELECT * FROM {chr(39)}{sf_dir}/documents.parquet{chr(39)})', labels)}) WHERE kept").fetchall()
    assert sorted(r[0] for r in rows(kept)) == sorted(r[0] for r in want) and 0 < len(want) < documents.count()

    lines = store(stage["line dedup"](spark, kept, sf_dir))
    want = brute.dedup([(d, t or "") for d, t, *_ in rows(kept)])
    assert {r[0]: r[1] for r in rows(lines)} == {d: v[2] for d, v in want.items()}
    assert all(r[4] == len(r[1]) for r in rows(lines))

    single = store(stage["near dedup"](spark, lines, sf_dir))
    label = brute.classes({d: brute.fingerprint(t) for d, t, *_ in rows(lines)})
    assert sorted(r[0] for r in rows(single)) == sorted(set(label.values()))

    mixed = store(stage["source mix"](spark, single, sf_dir))
    data = single.toPandas()  # noqa: F841  (DuckDB reads it by name)
    want = con.sql(f"SELECT doc_id, copies FROM ({sql.mix_plan('data')}) WHERE copies > 0").fetchall()
    count = {}
    for r in rows(mixed):
        count[r[0]] = count.get(r[0], 0) + 1
    assert count == dict(want)

    e = encoder()
    encoded = [tuple(r) for r in stage["byte BPE"](spark, mixed, sf_dir).collect()]
    want = []
    for doc_id, text, *_ in rows(mixed):
        ids = e.encode_ordinary(text)
        want.append((doc_id, len(ids), bytearray(np.array(ids, "<u4").tobytes()), brute.sha(text)))
    assert sorted(encoded, key=lambda r: (r[0], bytes(r[2]))) == sorted(want, key=lambda r: (r[0], bytes(r[2])))
