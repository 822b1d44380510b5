"""SpotSigs fingerprints: chains of content words after common-word anchors, compared through length-pruned Jaccard."""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracelake.llm.common import bounded_batches, row_keys, shuffle_partitions, store, text_or_empty
from tracelake.llm.components import components

# Common words of English, French, German and Spanish that start a chain, and those that only are no content words.
ANCHORS = frozenset("the a an is was that it le la une est qui der die das ist ein el los una es que".split())
COMMON = ANCHORS | frozenset(
    """of and to in for on with by as at be are this from or les de des du un et en dans par pour sur avec pas au und zu den dem von mit auf für nicht sich auch
    im eine y en del por con para no su al lo se""".split()
)
#: Sets one group of a comparison holds before it is cut into tiles.
BUCKET = 1024
_WORDS = re.compile(r"\w+").findall


def spots(text: str, chain: int = 2) -> frozenset[int]:
    """32-bit hashes of the spots: an anchor and the ``chain`` content words that follow it, common words skipped.

    The start of the text is an anchor too, so every text with a word has a spot; where fewer content words follow, the chain ends early, and a text of common
    words alone has its words for a chain.
    """
    words = _WORDS(text.lower())
    content: list[str] = []
    anchors: list[tuple[str, int]] = [("", 0)]
    for w in words:
        if w not in COMMON:
            content.append(w)
        elif w in ANCHORS:
            anchors.append((w, len(content)))
    if not content:
        return frozenset([xxhash.xxh32_intdigest(" ".join(words))]) if words else frozenset()
    digest = xxhash.xxh32_intdigest
    return frozenset([digest(f"{w}\0" + "\0".join(content[k : k + chain])) for w, k in anchors if k < len(content)])


def encode(found: frozenset[int]) -> str:
    """The spots in ascending order, four bytes each, in base64: equal sets, and only they, read alike."""
    return base64.b64encode(np.sort(np.fromiter(found, np.uint32, len(found))).astype(">u4").tobytes()).decode()


def decode(fingerprint: str) -> frozenset[int]:
    return frozenset(np.frombuffer(base64.b64decode(fingerprint), ">u4").tolist())


def likeness(a: frozenset[int], b: frozenset[int], floor: float = 0.0) -> float:
    """Jaccard similarity; below ``floor`` it may come out as 0. Sets whose lengths alone keep them under the floor are not compared. Two empty sets are alike."""
    if not a and not b:
        return 1.0
    small, large = (a, b) if len(a) <= len(b) else (b, a)
    if len(small) < floor * len(large) - 1e-9 or not small:
        return 0.0
    common = len(small & large)
    return common / (len(a) + len(b) - common)


def length_partition(size: int, threshold: float) -> int:
    """Sets at least ``threshold`` alike lie in the same or in neighbouring partitions, whose bounds grow by 1 / threshold."""
    return int(np.floor(np.log(max(size, 1)) / -np.log(threshold))) if 0 < threshold < 1 else size


def edited(text: str, following: str) -> str:
    """The text with its last floor(n / 2) code points replaced by as many of the next text, or by all of it."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def _bucket(bounds: np.ndarray) -> Callable:
    @F.pandas_udf(T.IntegerType())
    def bucket(ids: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(bounds, ids.to_numpy(), side="right").astype("int32"))

    return bucket


def with_next(docs: DataFrame, work: Callable[[Iterator[tuple[object, str, str]]], Iterator[tuple]], schema: T.StructType) -> DataFrame:
    """``work`` over (doc_id, text, next text) in ascending doc_id, a range of ids at a time; after the last id comes the first.

    Ties are ordered by a hash of the text, null ids come first. Ids are cut into ranges at quantiles (driver: one number per
    range); each range also gets the first rows of the next non-empty one, so texts are shuffled once and no range is read whole. Rows that share one id, or
    have none, are neighbours and so lie in one range: ids are meant to tell documents apart.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    parts = shuffle_partitions(spark)
    keyed = docs.select("doc_id", F.coalesce("doc_id", F.lit(-(2**63))).alias("order"), text_or_empty("text").alias("text"))
    steps = 4 * parts
    cuts = docs.stat.approxQuantile("doc_id", [i / steps for i in range(1, steps)], 0.25 / steps)
    bounds = np.array(sorted({int(c) for c in cuts}), "i8")
    bucketed = keyed.withColumn("bucket", _bucket(bounds)("order"))
    # The first row of each range goes to the range before it too, the first of all to the last: one row per range, 4 x partitions at most.
    starts = bucketed.groupBy("bucket").agg(F.min("order").alias("first"))
    by_bucket = Window.orderBy("bucket")
    before = F.coalesce(F.lag("bucket").over(by_bucket), F.max("bucket").over(Window.partitionBy()))
    starts = F.broadcast(starts.select(F.col("bucket").alias("of"), "first", before.alias("to")))
    own = F.struct(F.col("bucket").alias("bucket"), F.lit(False).alias("ahead"))
    ahead = F.struct(F.col("to").alias("bucket"), F.lit(True).alias("ahead"))
    marked = bucketed.join(starts, F.col("bucket") == F.col("of"))
    sent = marked.select("doc_id", "order", "text", F.explode(F.when(F.col("first") == F.col("order"), F.array(own, ahead)).otherwise(F.array(own))).alias("at"))
    dealt = sent.select("at.bucket", "at.ahead", "doc_id", "order", F.xxhash64("text").alias("tie"), "text").repartition(parts, "bucket")
    dealt = dealt.sortWithinPartitions("bucket", "ahead", "order", "tie").select("bucket", "ahead", "doc_id", "text")
    names, types = schema.names, [pa.int64(), *[{"long": pa.int64(), "bigint": pa.int64(), "double": pa.float64()}.get(f.dataType.simpleString(), pa.string()) for f in schema.fields[1:]]]

    def triples(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[object, str, str]]:
        held: tuple | None = None
        for batch in batches:
            for bucket, is_ahead, doc_id, text in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if held is not None and held[0] == bucket:
                    yield held[1], held[2], text
                    held = None
                if not is_ahead:
                    held = (bucket, doc_id, text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []

        def batch() -> pa.RecordBatch:
            columns = list(zip(*rows, strict=True)) if rows else [[] for _ in names]
            return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, types, strict=True)], names)

        for row in work(triples(batches)):
            rows.append(row)
            if len(rows) == 1000:
                yield batch()
                rows.clear()
        yield batch()

    return dealt.mapInArrow(run, schema)


_LONG, _TEXT, _DOUBLE = T.LongType(), T.StringType(), T.DoubleType()
COMPARED = T.StructType(
    [
        T.StructField(n, t)
        for n, t in (("doc_id", _LONG), ("n_chars", _LONG), ("edited_sha256", _TEXT), ("fingerprint", _TEXT), ("edited_fingerprint", _TEXT), ("near_edited", _DOUBLE), ("near_next", _DOUBLE))
    ]
)


def compare_edits(docs: DataFrame, chain: int = 2) -> DataFrame:
    """Per document its fingerprint, that of its edited text (see ``edited``), and how like its own those of the edit and of the next document are.

    Null text is empty: an empty fingerprint, alike only to others. A lone row is its own next document. Repeated rows are documents of
    their own, next to each other. Other columns are not read.
    """

    def work(rows: Iterator[tuple[object, str, str]]) -> Iterator[tuple]:
        known: tuple[str, frozenset[int]] | None = None
        for doc_id, text, following in rows:
            own = known[1] if known and known[0] == text else spots(text, chain)
            changed = edited(text, following)
            other, after = spots(changed, chain), spots(following, chain)
            known = (following, after)
            digest = hashlib.sha256(changed.encode()).hexdigest()
            yield doc_id, len(text), digest, encode(own), encode(other), likeness(own, other), likeness(own, after)

    return with_next(docs, work, COMPARED)


def fingerprints(docs: DataFrame, chain: int = 2) -> DataFrame:
    """(doc_id, fingerprint) of every row, without a shuffle. Null text has the empty fingerprint."""

    bounded_batches(docs.sparkSession)

    @F.pandas_udf(T.StringType())
    def of(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: encode(spots(t, chain)))

    return docs.select("doc_id", of(text_or_empty("text")).alias("fingerprint"))


def _alike(sets: list[frozenset[int]], ids: list[int], floor: float) -> list[tuple[int, int]]:
    """Edges that connect exactly the pairs of at least ``floor``: sets by length, each with those that are long enough and not connected to it yet."""
    order = sorted(range(len(sets)), key=lambda i: len(sets[i]))
    label = list(range(len(sets)))

    def top(i: int) -> int:
        while label[i] != i:
            label[i] = label[label[i]]
            i = label[i]
        return i

    edges = []
    for n, i in enumerate(order):
        for j in order[n + 1 :]:
            if len(sets[i]) < floor * len(sets[j]) - 1e-9:
                break
            if top(i) != top(j) and likeness(sets[i], sets[j], floor) >= floor:
                label[top(i)] = top(j)
                edges.append((ids[i], ids[j]))
    return edges


def _tiles(floor: float) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Edges of each tile; rows arrive sorted by tile, and a tile may run over batches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, ids, sets = None, [], []

        def flush() -> pa.RecordBatch:
            edges = _alike(sets, ids, floor)
            return pa.RecordBatch.from_arrays([pa.array([e[k] for e in edges], pa.int64()) for k in (0, 1)], ["u", "v"])

        for batch in batches:
            for tile, ident, found in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if tile != at:
                    if len(ids) > 1:
                        yield flush()
                    at, ids, sets = tile, [], []
                ids.append(ident)
                sets.append(frozenset(found))
        if len(ids) > 1:
            yield flush()

    return run


def links(sets: DataFrame, floor: float) -> DataFrame:
    """(u, v): edges that connect exactly the pairs of sets with a Jaccard similarity of at least ``floor``, 0 < floor <= 1.

    ``sets`` are stored and distinct: id long, spots array<long>. Sets lie in partitions by length (``length_partition``), and alike ones in the same or the
    next. Spots are ordered from the rarest; two alike sets share one among the first n - ceil(floor * n) + 1 of each, so sets meet by these
    and by partition. What many sets share there is cut into tiles of about two times ``BUCKET`` sets, so no group is held whole.
    """
    exploded = sets.select("id", F.explode("spots").alias("spot"))
    counts = exploded.groupBy("spot").agg(F.count(F.lit(1)).alias("n"))
    ordered = exploded.join(counts, "spot").groupBy("id").agg(F.sort_array(F.collect_list(F.struct("n", "spot")))["spot"].alias("spots"))
    size = F.size("spots")
    prefix = F.slice("spots", 1, (size - F.ceil(size * F.lit(floor) - F.lit(1e-9)) + 1).cast("int"))
    part = F.floor(F.log(size.cast("double")) / F.lit(-float(np.log(floor))) + 1e-9) if floor < 1 else size
    placed = ordered.select("id", "spots", part.cast("long").alias("part"), F.explode(prefix).alias("spot"))
    met = store(placed.select("id", "spots", "spot", F.explode(F.array(F.col("part"), F.col("part") + 1)).alias("part")))
    groups = met.groupBy("spot", "part").agg(F.count(F.lit(1)).alias("sets")).filter("sets > 1")
    cut = F.ceil(F.col("sets") / F.lit(float(BUCKET))).cast("int")
    joined = met.join(groups, ["spot", "part"]).select("id", "spots", "spot", "part", cut.alias("blocks"), F.pmod(F.xxhash64("id"), cut).cast("int").alias("block"))
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")
    tiles = joined.select("id", "spots", "spot", "part", "block", other)
    tiles = tiles.select(F.xxhash64("spot", "part", F.least("block", "other"), F.greatest("block", "other")).alias("tile"), "id", "spots")
    return tiles.repartition("tile").sortWithinPartitions("tile").mapInArrow(_tiles(floor), "u long, v long")


def near_documents(docs: DataFrame, floor: float = 0.8, chain: int = 2) -> DataFrame:
    """(doc_id, class_id): class_id is the smallest doc_id reachable over pairs of documents whose fingerprints are at least ``floor`` alike.

    Equal fingerprints, empty ones among them, are one class, and collapse before any comparison. Rows with a null doc_id take part but name a class only if all its
    ids are null: then it is null. No rows: no rows. Other columns are not read.
    """
    bounded_batches(docs.sparkSession)

    @F.pandas_udf(T.ArrayType(T.LongType()))
    def of(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: sorted(spots(t, chain)))

    marked = docs.select("doc_id", of(text_or_empty("text")).alias("spots"))
    marked = store(marked.select("doc_id", *row_keys(F.col("spots")), "spots"))
    whole = marked.groupBy("k1", "k2").agg(F.min("doc_id").alias("least"), F.first("spots").alias("spots"))
    sets = store(store(whole).withColumn("id", F.monotonically_increasing_id()))
    label = components(links(sets.select("id", "spots"), floor)).withColumnRenamed("node", "id")
    named = store(sets.select("k1", "k2", "id", "least").join(label, "id", "left").withColumn("label", F.coalesce("label", "id")))
    classes = named.join(named.groupBy("label").agg(F.min("least").alias("class_id")), "label").select("k1", "k2", "class_id")
    return marked.select("doc_id", "k1", "k2").join(classes, ["k1", "k2"]).select("doc_id", "class_id")
