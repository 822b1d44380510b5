"""Small inputs: nulls, empty and long texts, ties, repeated rows, empty tables, clashing column names, and each method's own rules."""

import hashlib
import random
from itertools import combinations

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken
from pyspark.sql import functions as F

import corpus_pipeline
from tests.llm import brute
from tests.llm.test_whole_tables import encoder
from tracelake.llm import bpe, chat, components, fingerprint, html, lines, mixing, pii, quality, simhash, suffix_dedup

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
#: Names that the operators use inside, on top of the columns of documents.
CLASHES = ["row", "own_", "k1", "k2", "fp", "label", "size", "copies", "target", "of", "n_words", "kept", "drops", "key", "mask", "out", "copy_", "bucket"]
WORDS = "alpha bravo carbon delta echo forest garden hotel island jungle kernel lemon market north ocean paper quartz river stone tower".split()


def prose(seed: int, n: int) -> str:
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) + str(r.randrange(50)) for _ in range(n))


def frame(spark, *rows, clashes=False):
    full = [(*r, *[None, None, None, None, None][len(r) :]) for r in rows]
    df = spark.createDataFrame(full, DOCS)
    return df.select("*", *[F.concat(F.lit(c), F.col("doc_id").cast("string")).alias(c) for c in CLASHES]) if clashes else df


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls in every column, empty, blank, short and long texts, repeated rows and ids."""
    long = prose(1, 30_000)
    return frame(
        spark, (None, None), (None, "a b"), (1, None), (2, ""), (3, " \t\n"), (4, "x"), (5, prose(5, 80), "en", "s1"), (5, prose(5, 80), "en", "s1"), (5, prose(6, 80), "en", "s2"),
        (6, prose(5, 80), None, "s1"), (7, long, "en", "s2"), (8, long + " end", "de", None), (9, "ü" * 5000, "de", "s3"), (10, "1" * 100_000), (11, "a@" * 5000), (12, "a.b" * 20000 + "@"),
        clashes=True,
    )


def run_all(spark, docs, model):
    """Every operator that takes documents, as (name, frame)."""
    labels = spark.createDataFrame([(5, 1, 0), (6, 1, 0), (None, None, None), (5, None, 0)], "doc_id long, quality int, toxic int")
    return {
        "pii": pii.extract(docs), "suffix": suffix_dedup.remove_repeats(docs), "bpe": bpe.encode_documents(docs, model, public_tokenizers.PATTERN), "spots": fingerprint.compare_edits(docs),
        "lines": lines.dedup_lines(docs), "quality": quality.keep_good(docs, labels), "measure": quality.measure(docs), "mix": mixing.mix(docs), "plan": mixing.mix_plan(docs),
        "near": simhash.near_duplicates(docs), "one": simhash.keep_one(docs),
    }


@pytest.fixture(scope="module")
def model(spark):
    return bpe.load_model(spark, public_tokenizers.path("byte_bpe_50k.tiktoken"))


def test_odd_rows(spark, odd, model):
    out = {k: v.collect() for k, v in run_all(spark, odd, model).items()}
    n = odd.count()
    assert {k: len(v) for k, v in out.items() if k not in ("quality", "one", "mix")} == dict.fromkeys(["pii", "suffix", "bpe", "spots", "lines", "measure", "plan", "near"], n)
    assert all(r.asDict()[c] == f"{c}{r.doc_id}" for k in ("lines", "one", "mix", "quality") for r in out[k] for c in CLASHES if r.doc_id is not None)
    empty = next(r for r in out["suffix"] if r.doc_id == 2)
    assert (empty.n_bytes, empty.n_removed, empty.n_spans, bytes(empty.kept)) == (0, 0, 0, b"")
    second = next(r for r in out["suffix"] if r.doc_id == 6)  # the text of document 5
    assert bytes(second.kept) == b"" and second.n_spans == 1
    ids = {r.doc_id: r.component_id for r in out["near"] if r.doc_id is not None}
    assert ids[1] == ids[2] == ids[3] == 1 and ids[6] == 5 and ids[8] == 7
    assert {r.doc_id for r in out["one"]} >= {1, 4, 5, 7} and not {r.doc_id for r in out["one"]} & {2, 3, 6, 8}
    assert {r.doc_id for r in out["quality"]} >= {5, 6, 7, 8}
    blank = next(r for r in out["lines"] if r.doc_id == 1)
    assert (blank.text, blank.n_lines, blank.n_dropped) == ("", 1, 0)
    assert all(r.near_next == 1.0 for r in out["spots"] if r.doc_id in (1, 2))
    spans = {r.doc_id: r.base for r in out["pii"] if r.doc_id is not None}
    assert spans[10] == spans[11] == spans[12] == []


def test_empty_tables(spark, model):
    none = frame(spark)
    assert all(df.collect() == [] for df in run_all(spark, none, model).values())
    assert chat.render(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).collect() == []
    assert html.extract_pages(spark.createDataFrame([], "page_id long, url string, html string")).collect() == []


def test_pipeline_on_nulls(spark, odd, sf_dir):
    docs = odd.select("doc_id", "text", "lang", "source", "n_chars", "size", "row")
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        docs = lines.store(stage(spark, docs, sf_dir))
        assert i == 4 or docs.columns == ["doc_id", "text", "lang", "source", "n_chars", "size", "row"]
    assert docs.count() > 0


def test_base_spans_of_odd_texts(spark):
    texts = [
        "a@b.c_d@e.f", "a@b..c x@y.z-", "1.2.3.4.5.6.7.8 0256.1.1.1 00255.01.1.1 1.2.3", "4111 1111 1111 1111, 4111-1111-1111-1112", "+1 (017) 555-7713 +123 +()- 1234567890123456", "é+49 30 1234567ü",
        "a@b.c.d@e.f.g", "%@x.y", "4111 1111 1111 1111 111", "+" * 50 + "1 2345 67890", "x" * 3000 + "@" + "y." * 3000 + "z", "🙂 me@x.io 🙂 10.0.0.1",
    ]
    found = pii.extract(frame(spark, *enumerate(texts))).collect()
    for r in found:
        assert [(pii.KINDS[k], a, b) for k, a, b in r.base] == brute.base_spans(texts[r.doc_id]), texts[r.doc_id]


def test_contexts_discover_unseen_identifiers(spark):
    r = random.Random(3)
    known = [(i, f"{prose(i, 20)} customer hotline: +1 (017) 555-{r.randrange(1000, 9999)} {prose(i + 99, 20)}") for i in range(40)]
    unseen = [(100, f"{prose(7, 9)} customer hotline: (017) 555-1234 {prose(8, 9)}"), (101, f"{prose(7, 9)} part number (017) 555-9999 {prose(8, 9)}")]
    found = {x.doc_id: x for x in pii.extract(frame(spark, *known, *unseen)).collect()}
    text = unseen[0][1]
    assert [(k, text[a:b]) for k, a, b in found[100].spans] == [(3, "(017) 555-1234")] and found[100].base == []
    assert found[101].spans == []
    assert all(len(found[i].base) == 1 and found[i].spans == found[i].base for i in range(40))


def test_found_identifiers_are_reported_everywhere(spark):
    known = [(i, f"{prose(i, 20)} customer hotline: +1 (017) 555-{1000 + i} {prose(i + 99, 20)}") for i in range(40)]
    others = [f"{prose(7, 9)} customer hotline: (017) 555-1234 {prose(8, 9)}", f"{prose(5, 9)} part number (017) 555-1234 {prose(6, 9)}", "(017) 555-1234"]
    found = {x.doc_id: x for x in pii.extract(frame(spark, *known, *enumerate(others, 100))).collect()}
    assert all([(k, text[a:b]) for k, a, b in found[i].spans] == [(3, "(017) 555-1234")] for i, text in enumerate(others, 100))


def test_contexts_prove_secrets(spark):
    """Random strings under a recurring name are secrets, also shorter ones of that name and wherever they stand; checksums and codes without such a name are not."""
    r = random.Random(5)
    token = lambda n: "".join(r.choice("0123456789abcdef") for _ in range(n - 2)) + "a1"
    known = [(i, f'{prose(i, 12)} api_key = "{token(40)}" {prose(i + 99, 12)}') for i in range(30)]
    short, lone, repeated = token(20), token(40), known[3][1].split('"')[1]
    others = [f'{prose(1, 5)} api_key = "{short}" {prose(2, 5)}', f"{prose(3, 5)} {short} again", f"checksum {lone} of a file", f"see {repeated} there", "order AB1234567890123 and JUST_A_LONG_NAME_1", "x" * 50 + " 12345678901234567890"]
    found = {x.doc_id: x for x in pii.extract(frame(spark, *known, *enumerate(others, 100))).collect()}
    told = lambda i: [(pii.NAMES[k], others[i - 100][a:b]) for k, a, b in found[i].spans if pii.NAMES[k] == "secret"]
    assert told(100) == [("secret", short)] and told(101) == [("secret", short)] and told(103) == [("secret", repeated)]
    assert told(102) == told(104) == told(105) == []
    assert all([pii.NAMES[k] for k, _, _ in found[i].spans] == ["secret"] and found[i].base == [] for i in range(30))


def test_rounds_go_on_while_instances_come_up(spark):
    """Each generation stands in contexts only with the one before it; the last is four rounds away from the seeds."""
    sizes, rows = [800, 190, 45, 9, 1], []
    for g, (old, new) in enumerate(zip(sizes, sizes[1:], strict=False)):
        members = [(f"{g}-{i}", g == 0) for i in range(old)] + [(f"{g + 1}-{i}", False) for i in range(new)]
        rows += [(3, f"c{g}{c}", form, seed) for c in range(3) for form, seed in members]
    occurrences = spark.createDataFrame(rows, "kind int, context string, form string, seed boolean")
    assert {r.form for r in pii.bootstrap(occurrences).collect()} == {f"{g}-{i}" for g in (1, 2, 3, 4) for i in range(sizes[g])}


def test_running_sum_over_chunks(spark):
    values = [random.Random(1).randrange(100) for _ in range(1000)]
    df = spark.createDataFrame([(values,), ([],), ([7] * 256,)], "v array<long>")
    got = [r[0] for r in df.select(pii.running_sum(F.col("v"))).collect()]
    assert got == [np.cumsum(values).tolist(), [], (np.arange(1, 257) * 7).tolist()]


@pytest.mark.parametrize("group", [4096, 2])
def test_repeats_across_blocks(spark, monkeypatch, group):
    """Shared passages, near copies, repeats inside a text; with tiny groups every frequent anchor is dealt over blocks."""
    monkeypatch.setattr(suffix_dedup, "GROUP", group)
    shared = prose(50, 40)
    rows = [(i, prose(i, 30) + " " + shared + " " + prose(i + 1000, 30)) for i in range(25)]
    rows += [(30, shared), (31, shared[:99]), (32, shared[:100]), (33, "z" * 500), (34, "ab" * 300), (35, shared * 3), (36, rows[3][1].replace("a", "ä", 1)), (37, rows[3][1])]
    got = {r[0]: (*r[1:4], bytes(r[4])) for r in suffix_dedup.remove_repeats(frame(spark, *rows)).collect()}
    assert got == brute.repeats(rows)


def test_repeats_with_full_filters(spark, monkeypatch):
    """Filters that let everything through change no result."""
    full = np.full(1 << (suffix_dedup.FILTER_BITS - 6), 2**64 - 1, np.uint64)
    monkeypatch.setattr(suffix_dedup, "_filter", lambda slots, spark: spark.sparkContext.broadcast(full))
    shared = prose(51, 40)
    rows = [(i % 40, prose(i, 20) + " " + shared + " " + prose(i % 3, 20)) for i in range(40)] + [(50 + i, shared) for i in range(40)]
    got = {r[0]: (*r[1:4], bytes(r[4])) for r in suffix_dedup.remove_repeats(frame(spark, *rows)).collect()}
    assert got == brute.repeats(rows)


def test_copies_of_a_window_are_shipped_and_compared_once():
    shipped = {}
    assert suffix_dedup._unshipped(shipped, [7, 7, 8, 7, 7], [5, 6, 5, 4, 4], [0, 0, 9, 3, 3]) == [0, 2, 3]
    assert suffix_dedup._unshipped(shipped, [7, 8], [4, 5], [2, 10]) == [0]
    window, other = b"x" * 10 + b"abcdefgh", b"y" * 10 + b"abcdefgh"
    rows = [(window, d, 0, 1, 1, 3, 0) for d in range(1000)] + [(other, 1, 50, 1, 2, 3, 0)] + [(other, d, 0, 1, 2, 3, 0) for d in range(2, 900)]
    names = ("raw", "doc", "pos", "blocks", "win", "anchor", "salt")
    batches = pa.Table.from_pylist([dict(zip(names, r, strict=True)) for r in rows]).to_batches(max_chunksize=100)
    found = [r for b in suffix_dedup._covered(8)(iter(batches)) for r in b.to_pylist()]
    # The letters that a window repeats, and in the second one what it shares with the first; nothing of the copies.
    assert {(r["doc"], r["pos"], r["size"]) for r in found} == {(0, 1, 9), (1, 51, 17)}


def test_borders_equal_sorted_prefixes():
    r = random.Random(5)
    windows = [bytes(r.choice(b"ab") for _ in range(r.randrange(5, 60))) for _ in range(30)]
    number, window, offset = suffix_dedup.repeats_in_block(windows, 7)
    want = {(w, o): x[o : o + 7] for w, x in enumerate(windows) for o in range(len(x) - 6)}
    assert len(number) == len(want)
    named = {}
    for c, w, o in zip(number.tolist(), window.tolist(), offset.tolist(), strict=True):
        assert named.setdefault(c, want[w, o]) == want[w, o]
    assert len(named) == len(set(want.values()))


def test_bpe_equals_tiktoken_on_any_text(model):
    e, codec = encoder(), bpe.Codec(model.value, public_tokenizers.PATTERN)
    r = random.Random(2)
    texts = ["", " ", "\x00\x01", "<|endoftext|>", "⁇ <unk>", "a" * 5000, "  \n\n  x", "naïve 🙂👩‍👩‍👧 日本語テキスト", "▁x", "'s 'LL don't", "1234567890 ½", "̀é"]
    texts += ["".join(chr(r.choice([r.randrange(32, 127), r.randrange(0x80, 0x3000), r.randrange(0x10000, 0x10400)])) for _ in range(200)) for _ in range(30)]
    for t in texts:
        ids = e.encode_ordinary(t)
        packed = codec.encode(t)
        assert np.frombuffer(packed, "<u4").tolist() == ids, t
        assert codec.decode(packed) == t.encode()


def test_bpe_round_trip(spark, model):
    docs = frame(spark, (1, "Grüße, 世界"), (2, None))
    back = bpe.decode_documents(bpe.encode_documents(docs, model, public_tokenizers.PATTERN), model, public_tokenizers.PATTERN)
    assert sorted(tuple(r) for r in back.collect()) == [(1, "Grüße, 世界"), (2, "")]


def test_ranks_without_gaps(tmp_path):
    (tmp_path / "r").write_text("YQ== 0\nYg== 2\n")
    with pytest.raises(ValueError):
        bpe.read_ranks(tmp_path / "r")
    assert tiktoken and hashlib


def test_spots():
    spots = fingerprint.spots
    assert spots("") == frozenset() and len(spots("the of and")) == 1 and len(spots("word")) == 1
    assert spots("the Big dog, the small cat") == spots("THE big dog the small  cat!")
    assert fingerprint.decode(fingerprint.encode(spots(prose(1, 50)))) == spots(prose(1, 50))
    a, b = frozenset(range(10)), frozenset(range(5))
    assert fingerprint.likeness(a, b) == 0.5 and fingerprint.likeness(a, b, floor=0.6) == 0.0 and fingerprint.likeness(frozenset(), b) == 0.0
    assert abs(fingerprint.length_partition(80, 0.8) - fingerprint.length_partition(100, 0.8)) <= 1


@pytest.mark.parametrize("floor,bucket", [(0.8, 1024), (0.8, 2), (0.5, 3), (1.0, 1024)])
def test_like_signatures(spark, monkeypatch, floor, bucket):
    """Chains of edits, copies, empty and null texts, spots that all share; small groups are cut into tiles."""
    monkeypatch.setattr(fingerprint, "BUCKET", bucket)
    r = random.Random(12)
    texts = [None, "", "the of", "the of", "word", "the of and"]
    for i in range(6):
        words = [f"the {r.choice(WORDS)} {r.choice(WORDS)}{i}" for _ in range(30)]
        for _ in range(8):
            words[r.randrange(30)] = f"the {r.choice(WORDS)} {r.randrange(1000)}"
            texts.append("the common beginning " + " ".join(words))
    rows = [*enumerate(texts), (7, texts[7]), (None, texts[8])]
    got = sorted((tuple(x) for x in fingerprint.near_documents(frame(spark, *rows, clashes=True), floor).collect()), key=repr)
    want = brute.linked({i: brute.spots(t or "") for i, t in enumerate(texts)}, floor)
    assert got == sorted([*want.items(), (7, want[7]), (None, want[8])], key=repr)
    assert fingerprint.near_documents(frame(spark), floor).collect() == []


def test_build_time_does_not_grow_with_partitions(spark):
    """Ranges are rows of a small table: a plan for 2,000 partitions is built as fast as one for four."""
    from time import perf_counter

    docs = frame(spark, *[(i, "x") for i in range(200)])
    before, spent = spark.conf.get("spark.sql.shuffle.partitions"), []
    try:
        for parts in ("4", "2000"):
            spark.conf.set("spark.sql.shuffle.partitions", parts)
            start = perf_counter()
            fingerprint.compare_edits(docs)
            spent.append(perf_counter() - start)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert spent[1] < 5 * spent[0] + 5


def test_frequent_lines(spark):
    shared, short = "this line has many characters", "short"
    rows = [(i, f"  {shared.upper() if i % 2 else shared}\t\n{short}\nown {i}") for i in (1, 2, 9)] + [(3, "twice in one document only\n" * 3)]
    got = {r.doc_id: (r.text, r.n_dropped) for r in lines.dedup_lines(frame(spark, *rows)).collect()}
    assert got[1] == ("short\nown 1", 1) and got[9][1] == 0 and got[3][1] == 0
    twins = [(7, shared), (7, shared), (7, shared)]  # rows are documents, and all hold the largest id
    assert [r.text for r in lines.dedup_lines(frame(spark, *twins)).collect()] == [shared] * 3


def test_safe_cutoffs(spark):
    """Cutoffs follow the exact binomial bound: no rejection of good documents beyond the risk, nothing without enough labels."""
    good = [(i, prose(i, 60) + (" #" * 6 if i < 2 else ""), "en") for i in range(1500)]
    bad = [(i, prose(i, 60) + " #$%" * 60, "en") for i in range(2000, 2040)]
    few = [(i, prose(i, 60) + " #$%" * 60, "fr") for i in range(3000, 3010)]
    docs = frame(spark, *good, *bad, *few)
    labels = spark.createDataFrame([(i, 1) for i in range(1500)] + [(i, 0) for i in range(2000, 2040)] + [(i, 1) for i in range(3000, 3002)], "doc_id long, quality int")
    measured = quality.store(quality.measure(docs))
    cuts = {r.of: r for r in quality.calibrate_joint(measured, labels).collect()}
    assert cuts["en"].cut_symbols is not None and cuts["en"].cut_symbols < 1.0 and cuts["fr"].cut_symbols is None
    kept = {r[0] for r in quality.keep_good(docs, labels).select("doc_id").collect()}
    assert not kept & set(range(2000, 2040)) and kept >= set(range(3000, 3010)) and len(kept & set(range(1500))) >= 1470


def test_joint_cutoffs(spark):
    """A few hundred good labels without false rejections let a stratum reject; too few do not, and the rows rejected by any rule count together."""
    docs = frame(
        spark,
        *[(i, prose(i, 60), "de") for i in range(400)], *[(i, prose(i, 60) + " #$%" * 60, "de") for i in range(1000, 1030)],
        *[(i, prose(i, 60) + (" #" * 6 if i < 2030 else "") + (f"\n{prose(9, 5)}" * 2 if i % 60 == 0 else ""), "fr") for i in range(2000, 2600)], *[(i, prose(i, 60) + " #$%" * 60, "fr") for i in range(3000, 3010)],
        *[(i, prose(i, 60), None) for i in range(4000, 4100)], *[(i, prose(i, 60) + " #$%" * 60, None) for i in range(4200, 4210)],
    )
    good = [*range(400), *range(2000, 2600), *range(4000, 4100)]
    labels = spark.createDataFrame([(i, 1) for i in good] + [(i, 0) for i in [*range(1000, 1030), *range(3000, 3005), *range(4200, 4205)]] + [(None, 1), (1, None)], "doc_id long, quality int")
    cuts = {r.of: r for r in quality.calibrate_joint(quality.store(quality.measure(docs)), labels).collect()}
    least = int(np.ceil(np.log(0.05 / 12) / np.log(0.98)))
    assert {k: (r.n, r.least) for k, r in cuts.items()} == {"de": (400, least), "fr": (600, least), None: (100, least)}
    assert cuts["de"].cut_symbols == 0.05 and cuts["fr"].cut_symbols == 0.1 and cuts["fr"].cut_dup_lines is None and cuts[None].cut_symbols is None
    kept = {r[0] for r in quality.keep_good(docs, labels).select("doc_id").collect()}
    assert not kept & {*range(1000, 1030), *range(3000, 3010)} and kept >= {*good, *range(4200, 4210)}
    # The same by SQL, where cutoffs exist in two strata.
    import duckdb

    from tracelake.llm import sql

    con = duckdb.connect()
    con.register("docs_", docs.select("doc_id", "text", "lang").toPandas())
    con.register("labels_", labels.toPandas())
    assert {r[0] for r in con.sql(f"SELECT doc_id FROM ({sql.judged('docs_', 'labels_')}) WHERE kept").fetchall()} == kept
    assert sum(any(x is not None for x in c[4:]) for c in cuts.values()) >= 2


def test_equal_texts_count_once(spark):
    """Copies of a few good texts make no holdout: the bound's documents are independent."""
    docs = frame(spark, *[(i, prose(i % 20, 60), "de") for i in range(2000)], *[(i, prose(i, 60) + " #$%" * 60, "de") for i in range(3000, 3010)])
    labels = spark.createDataFrame([(i, int(i < 2000)) for i in [*range(2000), *range(3000, 3010)]], "doc_id long, quality int")
    cuts = quality.calibrate_joint(quality.store(quality.keyed(quality.measure(docs))), labels).first()
    assert cuts.n == 20 and cuts.cut_symbols is None
    assert quality.keep_good(docs, labels).count() == 2010


def test_binomial_tail(spark):
    from math import comb, log

    cases = [(10, 0, 0.1), (10, 0, 0.01), (500, 3, 0.01), (5000, 10, 0.005)]
    for n, k, p in cases:
        got = spark.range(1).select(quality.log_binomial_tail(F.lit(n).cast("long"), F.lit(k).cast("long"), p)).first()[0]
        want = log(sum(comb(n, j) * p**j * (1 - p) ** (n - j) for j in range(k + 1)))
        assert abs(got - want) < 1e-9


def test_snapshots_collapse(spark):
    c = lambda conv, *texts: [(conv, i, "user" if i % 2 == 0 else "assistant", t) for i, t in enumerate(texts)]
    rows = [*c(1, "a", "b"), *c(2, "a", "b", "c"), *c(3, "a", "b", "c"), *c(4, "a", "x"), *c(5, "a"), *c(6, None), *c(7, ""), (2, 1, "assistant", "b"), (None, None, None, None)]
    got = {r.conv_id: (r.n_turns, r.n_copies) for r in chat.render(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()}
    assert got == {2: (3, 2), 4: (2, 1), 6: (1, 1), 7: (1, 1), None: (1, 1)}


def test_long_conversations_are_rendered_in_parts(spark, monkeypatch):
    monkeypatch.setattr(chat, "PART", 4)
    rows = [(1, i, "user", f"t{i}") for i in range(11)] + [(2, i, "user", f"t{i}") for i in range(9)] + [(3, i, "user", f"t{i}") for i in range(9)] + [(3, 20, "user", "z")]
    got = chat.render(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()
    assert sorted((r.conv_id, r.part, r.n_turns) for r in got) == [(1, 0, 11), (1, 1, 11), (1, 2, 11), (3, 0, 10), (3, 1, 10), (3, 2, 10)]
    whole = "".join(r.text for r in sorted(got, key=lambda r: r.part) if r.conv_id == 1)
    assert whole == "".join(f"<|im_start|>user\nt{i}<|im_end|>\n" for i in range(11))


def test_targets(spark):
    sized = spark.createDataFrame([("a", 10), ("b", 500), ("c", 1000), (None, 0), ("d", 3)], "source string, size long")
    got = {r.source: r.target for r in mixing.source_targets(sized).collect()}
    # a is capped at 30 and d (weight 5, the turn after c) at 9; b and c share the rest 2 to 1.
    assert got["a"] == 30 and got["d"] == 9 and got[None] == 0
    assert got["b"] == pytest.approx(982.6666667) and got["c"] == pytest.approx(491.3333333)
    assert sum(got.values()) == pytest.approx(1513)


def test_mix_repeats_itself(spark):
    docs = frame(spark, *[(i, prose(i, 20), None, f"s{i % 3}") for i in range(300)])
    a, b = (sorted(r.doc_id for r in mixing.mix(docs).collect()) for _ in range(2))
    assert a == b and max(a.count(i) for i in set(a)) <= 3
    assert 0.85 * 300 < len(a) < 1.15 * 300


@pytest.mark.parametrize("bucket", [1024, 3])
def test_links_find_all_pairs(spark, monkeypatch, bucket):
    """A chain of near fingerprints, a dense cluster and strangers; tiny buckets are dealt out again and again."""
    monkeypatch.setattr(simhash, "BUCKET", bucket)
    r = random.Random(4)
    fps = [r.getrandbits(64) for _ in range(60)]
    for _ in range(60):
        fps.append(fps[r.randrange(len(fps))] ^ sum({1 << r.randrange(64) for _ in range(r.randrange(1, 6))}))
    fps = list(dict.fromkeys(fps))
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    edges = simhash.links(spark.createDataFrame([(f,) for f in signed], "fp long"))
    got = {r.node: r.label for r in components.components(edges).collect()}
    want = brute.classes(dict(zip(signed, fps, strict=True)))
    assert {f: got.get(f, f) for f in signed} == want


def test_components_of_a_long_path(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(200)] + [(500, 501), (501, 500), (7, 7)], "u long, v long")
    got = {r.node: r.label for r in components.components(edges).collect()}
    assert got == {i: 0 for i in range(201)} | {500: 500, 501: 500}


def test_page_furniture():
    page = (
        "<title>T</title><body><header>Site<h1>x</h1></header><div class='cookie-notice'>ok?</div><nav><a>m</a></nav><article><header><h1>Title <b>one</b></h1><p>by me</p></header>"
        "<p>a &amp; b &#8364;&nbsp;c<p>second<br>line <i>in</i>line<script>var x='</p>'</script><div id=userComments><p>bad</div><ul><li>one<li>two</ul><form>f</form>"
        "<pre>x   y</pre><table><tr><td>c1<td>c2</table>tail<footer>share</footer></article><aside>s</aside><!-- <p>no</p> --><p>after"
    )
    assert html.main_text(page).split("\n") == ["Title one", "a & b € c", "second line inline", "one", "two", "x y", "c1", "c2", "tail"]
    assert html.main_text("") == "" and html.main_text("<") == "<"
    assert html.main_text("plain < text <b>bold") == "plain < text bold"
    assert html.main_text("<div>" * 20_000 + "deep") == "deep"


def test_names_count_as_a_whole():
    """Slugs that hold a furniture word are text; a teaser in an article is not the page; whole names and compounds of them are furniture."""
    article = "<article><h2 id='related-work'>Related work</h2><p class='comment-free'>no comment</p><div id='share-of-market'>half</div><h3 class='header'>part</h3>{}</article>"
    text = "Related work\nno comment\nhalf\npart"
    assert html.main_text(article.format("")) == text
    for name in ("ad", "ad-container", "userComments", "social share", "cookie-notice top", "newsletter_signup", "ads-300"):
        assert html.main_text(article.format(f"<div class='{name}'>gone</div><div id='{name.split()[0]}'>gone</div>")) == text
    assert html.main_text("<article><p>teaser</p></article><div>long main story</div>") == "teaser\nlong main story"
    assert html.main_text("<article><p>a long main story</p></article><div>teaser</div>") == "a long main story"
    assert html.main_text("<p>one <b class=ad>x</b>two<div class=ad>y</div>three") == "one two\nthree"


def test_badly_nested_pages_are_linear():
    from time import process_time

    spent = []
    for n in (20_000, 80_000):
        start = process_time()
        assert html.main_text("<b>" * n + "</i>" * n + "<td>" + "<i>" * n + "</b>" * n + "end") == "end"
        spent.append(process_time() - start)
    assert spent[1] < 16 * spent[0] + 1


def test_pages_without_articles(spark):
    """A site of which every page is built from parts: what is the site's goes by its recurrence alone, what is the page's stays, small things included."""
    r = random.Random(11)
    menu = "<div><div><a href=/>Start</a> <a href=/b>Books</a></div><div>Find us</div></div>"
    bottom = "<section><p>Opening hours: nine to five</p><p>Call 555</p></section>"
    rows, want = [], {}
    for i in range(60):
        own = [f"<p>{prose(100 + i, 12)} <b>Note:</b> {prose(200 + i, 3)}</p>", "<h2>History</h2>", f"<table><tr><td>Yes<td>{prose(300 + i, 2)}</table>", f"<ul><li>Home<li>{prose(400 + i, 3)}</ul>"]
        r.shuffle(own)
        rows.append((i, f"http://shop.example/{i}", f"<body>{menu}<div>{''.join(own)}</div>{bottom}</body>"))
        want[i] = "\n".join(
            block for part in own for block in [" ".join(html.re.sub(r"<[^>]*>", "\0", b).replace("\0", "").split()) for b in html.re.split(r"<(?:li|td|tr|/?ul|/?table|/?p|/?h2)>", part)] if block
        )
    got = {x.page_id: x.text for x in html.extract_pages(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == want and all("Note:" in t and "History" in t and "Yes" in t and "Home" in t for t in want.values())


def test_templates_of_the_table(sf_dir):
    """The site's menus and footers are found as recurring subtrees, and taking them out changes no page's main text."""
    import duckdb

    rows = duckdb.sql(f"SELECT regexp_extract(url, '//([^/]+)', 1), html FROM '{sf_dir}/pages.parquet'").fetchall()
    menu = "<nav><ul><li>Home<li>News</ul></nav>"
    count, gone = {}, 0
    with_menu = [(host, page.replace("<article>", f"{menu}<article>")) for host, page in rows]
    for _, page in with_menu:
        for digest in html.subtree_hashes(page)[1]:
            count[digest] = count.get(digest, 0) + 1
    template = frozenset(d for d, n in count.items() if n == len(rows))
    for (_, plain), (_, page) in zip(rows, with_menu, strict=True):
        root = html.parse(page)
        html.annotate(root)
        gone += html.without(root, template) > 0
        assert html.main_text(page, template) == html.main_text(plain)
    assert gone == len(rows)


def test_site_templates(spark):
    """Boilerplate without a telling name goes once it recurs on a host; copies of one article and other hosts' text stay."""
    page = lambda i, host, body: (i, f"https://{host}/p{i}", f"<body><div><p>Welcome to our site</p><p>Call us</p></div><div><p>{body}</p></div></body>")
    rows = [page(i, "a.example", prose(i, 30)) for i in range(30)] + [page(i, "a.example", "copied words") for i in range(30, 60)] + [page(i, "b.example", prose(i, 30)) for i in range(60, 64)]
    rows += [(70, None, "<p>x</p>"), (71, "https://a.example/", None), (0, "https://a.example/p0", rows[0][2])]
    got = {r.page_id: r.text for r in html.extract_pages(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert all(got[i] == prose(i, 30) for i in range(30)) and all(got[i] == "copied words" for i in range(30, 60))
    assert got[60].startswith("Welcome to our site\nCall us\n") and got[70] == "x" and got[71] == ""


def signed(fps):
    return [f - (1 << 64) if f >> 63 else f for f in fps]


def test_links_of_a_ball(spark):
    """All 43,745 fingerprints within three bits of one, strangers, and a second centre six bits away that one stray connects to the ball."""
    r = random.Random(8)
    centre = r.getrandbits(64)
    bits = [1 << b for b in range(64)]
    ball = [centre] + [centre ^ a for a in bits] + [centre ^ a ^ b for a, b in combinations(bits, 2)] + [centre ^ a ^ b ^ c for a, b, c in combinations(bits, 3)]
    assert len(ball) == 43_745
    far = centre ^ sum(bits[20:28])  # five bits from the nearest of the ball
    bridge = [far, far ^ bits[20]]
    lone = centre ^ sum(bits[40:50])
    strangers = [r.getrandbits(64) for _ in range(500)]
    edges = simhash.links(spark.createDataFrame([(f,) for f in signed([*ball, *bridge, lone, *strangers])], "fp long"))
    got = {x.node: x.label for x in components.components(edges).collect()}
    labels = {got[f] for f in signed([*ball, *bridge])}
    assert labels == {min(signed([*ball, *bridge]))} and not set(signed([lone, *strangers])) & set(got)


@pytest.mark.parametrize("distance", [1, 2, 3])
def test_tiles_at_other_distances(spark, monkeypatch, distance):
    """Chains of growing steps: with buckets of two every bit pattern ends in tiles, and components equal brute force."""
    monkeypatch.setattr(simhash, "BUCKET", 2)
    r = random.Random(distance)
    fps = [r.getrandbits(64) & 0xFFFF for _ in range(150)]
    fps = list(dict.fromkeys(fps))
    edges = simhash.links(spark.createDataFrame([(f,) for f in fps], "fp long"), distance)
    got = {x.node: x.label for x in components.components(edges).collect()}
    assert {f: got.get(f, f) for f in fps} == brute.classes(dict(zip(fps, fps, strict=True)), distance)
