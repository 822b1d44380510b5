"""SimHash near-duplicates: fingerprints, candidates by pigeonring chains, Hamming check, components."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracelake.llm.common import bounded_batches, row_keys, store, text_or_empty
from tracelake.llm.components import components

#: Fingerprints one bucket may hold before it is dealt out by more bits, and how often that happens before tiles follow.
BUCKET, DEALS = 1024, 2
#: What names a bucket: the segment its chains start from, the bits it fixes, and their values.
PLACE = ["start", "mask", "key"]


def fingerprint(text: bytes, width: int = 4) -> bytes:
    """64 bits, high bit first: a bit is set if set in over half the XXH64 (seed 42) of the word shingles, repeats included."""
    words = text.lower().split()  # bytes: A-Z and the six ASCII blanks only
    if not words:
        return bytes(8)
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    last = ends[width - 1 :] - 1 if len(words) > width else ends[-1:] - 1
    first = np.concatenate(([0], ends))[: len(last)]
    digest, memory = xxhash.xxh64_digest, memoryview(joined)
    hashes = np.frombuffer(b"".join([digest(memory[a:b], 42) for a, b in zip(first.tolist(), last.tolist(), strict=True)]), np.uint8)
    total = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 19):  # bounded memory for very long texts
        total += np.unpackbits(hashes[at : at + (1 << 19)]).reshape(-1, 64).sum(axis=0, dtype=np.int64)
    return np.packbits(total * 2 > len(last)).tobytes()


def _fingerprints(width: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bits = b"".join([fingerprint(t, width) for t in batch.column("text").cast(pa.binary()).to_pylist()])
            kept = [batch.column(i) for i in range(batch.num_columns - 1)]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(np.frombuffer(bits, ">i8").astype("i8"))], [*batch.schema.names[:-1], "fp"])

    return run


def fingerprints(docs: DataFrame, width: int = 4, keys: bool = False) -> DataFrame:
    """(doc_id, fp long), with ``keys`` (doc_id, k1, k2, fp). Null or blank text: fingerprint zero; under ``width`` + 1 words: one shingle of all."""
    bounded_batches(docs.sparkSession)
    text = text_or_empty("text")
    extra = row_keys(text, F.col("doc_id")) if keys else []
    return docs.select("doc_id", *extra, text.alias("text")).mapInArrow(_fingerprints(width), "doc_id long, " + "k1 long, k2 long, " * keys + "fp long")


def ring(segments: int) -> list[int]:
    """Masks of ``segments`` consecutive segments of the 64 bits, in ring order."""
    cuts = [round(64 * i / segments) for i in range(segments + 1)]
    return [(1 << b) - (1 << a) for a, b in zip(cuts, cuts[1:], strict=False)]


def chain_pairs(fps: np.ndarray, start: int, masks: list[int], distance: int) -> np.ndarray:
    """Symmetric matrix of the pairs within ``distance`` whose chains from segment ``start`` stay within budget.

    A chain of l consecutive segments may differ in floor(l * distance / segments) bits at most. If two fingerprints are within the distance, the
    chains of all lengths from at least one start do so: it is enough to look for pairs from each start.
    """
    m = len(masks)
    rows, columns = np.triu_indices(len(fps), 1)
    reach = 0
    for length in range(1, m + 1):
        reach |= masks[(start + length - 1) % m]
        near = np.bitwise_count((fps[rows] ^ fps[columns]) & np.uint64(reach)) <= length * distance // m
        rows, columns = rows[near], columns[near]
        if not len(rows):
            break
    full = np.bitwise_count(fps[rows] ^ fps[columns]) <= distance
    out = np.zeros((len(fps), len(fps)), bool)
    out[rows[full], columns[full]] = out[columns[full], rows[full]] = True
    return out


def spanning(linked: np.ndarray) -> np.ndarray:
    """Label of each row: the least index it can reach. One edge to the label stands for all the links of a bucket."""
    label = np.arange(len(linked))
    while True:
        least = np.minimum(label, np.where(linked, label[None, :], len(label)).min(axis=1))
        least = least[least]
        if (least == label).all():
            return label
        label = least


def _link(masks: list[int], distance: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Edges among each bucket's fingerprints; rows arrive sorted by bucket, and a bucket may run over batches."""

    def solve(start: int, fps: np.ndarray, out: list[np.ndarray]) -> None:
        linked = chain_pairs(fps, start, masks, distance)
        if linked.any():
            label = spanning(linked)
            other = np.flatnonzero(label != np.arange(len(label)))
            out.append(np.stack([fps[other], fps[label[other]]]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = np.zeros((4, 0), np.uint64)

        def groups(held: np.ndarray, upto: int, out: list[np.ndarray]) -> None:
            cuts = np.flatnonzero((held[:3, 1:] != held[:3, :-1]).any(axis=0)) + 1
            for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), held.shape[1]], strict=True):
                if b <= upto and b - a > 1:
                    solve(int(held[0, a]), held[3, a:b], out)

        def edges(out: list[np.ndarray]) -> pa.RecordBatch:
            pair = np.concatenate(out, axis=1) if out else np.zeros((2, 0), np.uint64)
            return pa.RecordBatch.from_arrays([pa.array(pair[0].view("i8").copy()), pa.array(pair[1].view("i8").copy())], ["u", "v"])

        for batch in batches:
            new = np.stack([batch.column(c).to_numpy(zero_copy_only=False).astype("i8").view("u8") for c in ("start", "mask", "key", "fp")])
            rest = np.concatenate([rest, new], axis=1)
            if not rest.shape[1]:
                continue
            same = (rest[:3] == rest[:3, -1:]).all(axis=0)
            upto = int(np.flatnonzero(~same)[-1]) + 1 if not same.all() else 0
            out: list[np.ndarray] = []
            groups(rest[:, :upto], upto, out)
            rest = rest[:, upto:]
            yield edges(out)
        out = []
        if rest.shape[1]:
            groups(rest, rest.shape[1], out)
        yield edges(out)

    return run


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _finer(mask: int, parts: int) -> list[int]:
    """The mask with each of ``parts`` runs of the free bits added; what differs in fewer bits than that agrees in one of the runs."""
    free = [1 << b for b in range(64) if not mask >> b & 1]
    cuts = [round(len(free) * i / parts) for i in range(parts + 1)]
    return [mask | sum(free[a:b]) for a, b in zip(cuts, cuts[1:], strict=False) if a < b]


def links(fps: DataFrame, distance: int = 4) -> DataFrame:
    """(u, v): edges among distinct fingerprints that connect exactly the pairs within ``distance`` bits.

    The bits form a ring of ``distance`` + 1 segments. A fingerprint goes to one bucket per segment; a bucket's pairs pass the chain
    test from that segment and the full check, and leave as a spanning forest. A bucket of over ``BUCKET`` fingerprints is dealt out again: its
    pairs differ only in the free bits, in at most ``distance`` of them, so they agree in one of ``distance`` + 1 runs of these. Two such rounds
    fix some 30 bits, which is enough for strangers at any corpus size; what is still hot after them are balls of fingerprints
    that differ in few bits, and these are compared in tiles (``_tiled``). No bucket is cut.
    """
    masks = ring(distance + 1)
    rows = fps.select("fp").distinct().select(
        "fp", F.explode(F.array(*[F.struct(F.lit(i).alias("start"), F.lit(_signed(m)).alias("mask")) for i, m in enumerate(masks)])).alias("at")
    ).select("fp", "at.start", "at.mask")
    level, found = masks, []
    for deal in range(DEALS + 1):
        rows = rows.withColumn("key", F.col("fp").bitwiseAND(F.col("mask")))
        hot = store(rows.groupBy(*PLACE).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > BUCKET).select(*PLACE))
        done = hot.isEmpty()
        found.append(store(_linked(rows if done else rows.join(hot, PLACE, "left_anti"), masks, distance)))
        if done:
            break
        rows = rows.join(hot, PLACE, "left_semi")
        if deal == DEALS:
            found += _tiled(store(rows), masks, distance)
            break
        finer = {m: _finer(m, distance + 1) for m in level}
        split = F.create_map(*[x for m, f in finer.items() for x in (F.lit(_signed(m)), F.array(*[F.lit(_signed(y)) for y in f]))])
        rows = store(rows.select("fp", "start", F.explode(split[F.col("mask")]).alias("mask")))
        level = sorted({y for f in finer.values() for y in f})
    edges = found[0]
    for more in found[1:]:
        edges = edges.unionByName(more)
    return edges


def _linked(rows: DataFrame, masks: list[int], distance: int) -> DataFrame:
    """(u, v) from whole buckets."""
    dealt = rows.repartition(*PLACE).sortWithinPartitions(*PLACE).select(*PLACE, "fp")
    return dealt.mapInArrow(_link(masks, distance), "u long, v long")


def _two_bits(fps: DataFrame) -> DataFrame:
    """(u, v): edges that connect exactly the pairs within two bits. These share a key among themselves and their one-bit neighbours."""
    near = F.concat(F.array("fp"), F.transform(F.sequence(F.lit(0), F.lit(63)), lambda b: F.col("fp").bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("long"), b))))
    keyed = fps.select("fp", F.explode(near).alias("near"))
    least = keyed.groupBy("near").agg(F.min("fp").alias("v"), F.max("fp").alias("top")).filter("v < top").select("near", "v")
    return keyed.join(least, "near").filter("fp <> v").select(F.col("fp").alias("u"), "v").distinct()


def _tiled(rows: DataFrame, masks: list[int], distance: int) -> list[DataFrame]:
    """Edge tables of the buckets that stay hot.

    Pairs within two bits connect first, by a linear step, which in a ball leaves few components. Then each bucket is cut into blocks of about ``BUCKET``
    rows, large components into blocks of their own, and every two blocks make a tile, but for two of the same component, which need
    no more links. A tile is one small group: all pairs between different components are met, and none is held with its bucket.
    """
    out = []
    if distance >= 2:
        out.append(store(_two_bits(rows.select("fp").distinct())))
        label = components(out[0]).withColumnRenamed("node", "fp")
        rows = store(rows.join(label, "fp", "left").select(*PLACE, "fp", F.coalesce("label", "fp").alias("label")))
    else:
        rows = rows.select(*PLACE, "fp", F.col("fp").alias("label"))
    counts = store(rows.groupBy(*PLACE, "label").agg(F.count(F.lit(1)).alias("n")))
    large = counts.filter(F.col("n") > BUCKET)
    small = counts.filter(F.col("n") <= BUCKET).groupBy(*PLACE).agg(F.sum("n").alias("others"))
    blocks_of = lambda n: F.ceil(F.col(n) / F.lit(float(BUCKET)))
    sized = rows.join(large, [*PLACE, "label"], "left").join(small, PLACE, "left")
    cut = sized.select(
        *PLACE, "fp", F.when(F.col("n").isNotNull(), F.col("label")).alias("owner"),
        F.pmod(F.xxhash64("fp"), F.coalesce(blocks_of("n"), blocks_of("others"))).alias("part"),
    )
    cut = store(cut.withColumn("block", F.xxhash64(*PLACE, F.col("owner").isNull(), "owner", "part")))
    blocks = store(cut.select(*PLACE, "block", "owner").distinct())
    one, two = blocks.alias("one"), blocks.alias("two")
    same = [F.col(f"one.{c}") == F.col(f"two.{c}") for c in PLACE]
    foreign = F.col("one.owner").isNull() | F.col("two.owner").isNull() | (F.col("one.owner") != F.col("two.owner"))
    tiles = one.join(two, same).filter((F.col("one.block") <= F.col("two.block")) & foreign)
    tiles = tiles.select(F.col("one.start").alias("start"), F.col("one.block").alias("mask"), F.col("two.block").alias("key"))
    held = tiles.select("*", F.explode(F.array_distinct(F.array("mask", "key"))).alias("block"))
    return [*out, store(_linked(cut.select("block", "fp").distinct().join(held, "block"), masks, distance))]


def _classes(marked: DataFrame, distance: int) -> DataFrame:
    """(fp, label, component_id) of every distinct fingerprint; label is a fingerprint that stands for the class."""
    least = store(marked.groupBy("fp").agg(F.min("doc_id").alias("least")))
    label = components(links(least, distance)).withColumnRenamed("node", "fp")
    named = store(least.join(label, "fp", "left").select("fp", "least", F.coalesce("label", "fp").alias("label")))
    ids = named.groupBy("label").agg(F.min("least").alias("component_id"))
    return store(named.join(ids, "label").select("fp", "label", "component_id"))


def near_duplicates(docs: DataFrame, distance: int = 4, width: int = 4) -> DataFrame:
    """(doc_id, fp, component_id): component_id is the smallest doc_id reachable over links of at most ``distance`` bits.

    Links join fingerprints, so rows with equal fingerprints, null and blank texts (zero) among them, are one class whatever
    their ids; copies collapse before any comparison. Rows with a null doc_id take part but never name a component, which is null
    if all its ids are. No rows: no rows. Other columns are not read.
    """
    marked = store(fingerprints(docs, width))
    return marked.join(_classes(marked, distance), "fp").select("doc_id", "fp", "component_id")


def keep_one(docs: DataFrame, distance: int = 4, width: int = 4) -> DataFrame:
    """One document of each near-duplicate class, all columns kept: the one with the smallest doc_id, then the smallest row key.

    Of rows with equal doc_id and text one stays. A class whose ids are all null keeps its row of the smallest key.
    """
    marked = store(fingerprints(docs, width, keys=True))
    place = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "k1", "k2")
    first = marked.join(_classes(marked, distance), "fp").groupBy("label").agg(F.min(place).alias("first")).select("first.k1", "first.k2")
    rows = docs.select(F.struct("*").alias("row"), *row_keys(text_or_empty("text"), F.col("doc_id")))
    return rows.join(first, ["k1", "k2"], "left_semi").dropDuplicates(["k1", "k2"]).select(*[F.col(f"row.`{c}`").alias(c) for c in docs.columns])
