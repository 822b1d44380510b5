"""Line deduplication: explode normalised lines, hash, count documents per hash, drop frequent lines, reassemble by position."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracelake.llm.common import BLANKS, bounded_batches, row_keys, store, text_or_empty

_BLANKS = BLANKS.encode()
_CODE_POINT = b"".join(bytes([b]) for b in range(0x80, 0xC0))  # continuation bytes, which start no code point


def line_key(line: bytes) -> bytes:
    """White space stripped at both ends, A-Z in lower case."""
    return line.strip(_BLANKS).lower()


def _long_enough(key: bytes, min_chars: int) -> bool:
    return len(key) >= min_chars and (len(key) >= 4 * min_chars or len(key.translate(None, _CODE_POINT)) >= min_chars)


def _hashes(min_chars: int, positions: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows (h1, h2, doc_id) once per key of a document, or (h1, h2, doc_id, k1, k2, pos) once per line."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            digests, rows, places = bytearray(), [], []
            for row, raw in enumerate(batch.column("text").cast(pa.binary()).to_pylist()):
                seen: set[bytes] = set()
                for place, line in enumerate(raw.split(b"\n")):
                    key = line_key(line)
                    if not _long_enough(key, min_chars):
                        continue
                    digest = xxhash.xxh3_128_digest(key)
                    if positions:
                        places.append(place)
                    elif digest in seen:
                        continue
                    else:
                        seen.add(digest)
                    digests += digest
                    rows.append(row)
            pair = np.frombuffer(bytes(digests), ">i8").astype("i8").reshape(-1, 2)
            kept = batch.take(pa.array(rows, pa.int64()))
            columns = {"h1": pa.array(pair[:, 0].copy()), "h2": pa.array(pair[:, 1].copy()), "doc_id": kept.column("doc_id")}
            if positions:
                columns |= {"k1": kept.column("k1"), "k2": kept.column("k2"), "pos": pa.array(places, pa.int32())}
            yield pa.RecordBatch.from_pydict(columns)

    return run


_ASSEMBLED = T.StructType([T.StructField("text", T.StringType()), T.StructField("n_lines", T.LongType()), T.StructField("n_dropped", T.LongType())])


@F.pandas_udf(_ASSEMBLED)
def _reassemble(texts: pd.Series, drops: pd.Series) -> pd.DataFrame:
    out = []
    for text, drop in zip(texts, drops, strict=True):
        lines = text.split("\n")
        gone = frozenset() if drop is None else frozenset(drop.tolist())
        out.append(("\n".join([x for i, x in enumerate(lines) if i not in gone]) if gone else text, len(lines), len(gone)))
    return pd.DataFrame(out, columns=["text", "n_lines", "n_dropped"])


def frequent_lines(docs: DataFrame, min_chars: int = 20, min_docs: int = 3) -> DataFrame:
    """(h1, h2, keep): 128-bit hashes of the keys found in at least ``min_docs`` documents, and the largest doc_id holding each."""
    bounded_batches(docs.sparkSession)
    lines = docs.select("doc_id", text_or_empty("text").alias("text")).mapInArrow(_hashes(min_chars, False), "h1 long, h2 long, doc_id long")
    counted = lines.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("n"), F.max("doc_id").alias("keep"))
    return counted.filter(F.col("n") >= min_docs).select("h1", "h2", "keep")


def dedup_lines(docs: DataFrame, min_chars: int = 20, min_docs: int = 3) -> DataFrame:
    """Documents without their frequent lines, with ``n_lines`` (before) and ``n_dropped``.

    A line's key is the line stripped of ASCII white space, A-Z lower-cased. Keys of at least ``min_chars`` code points in
    at least ``min_docs`` documents lose all their lines but those of the largest doc_id holding the key.

    Every row counts as a document, also if another has its doc_id; rows that share the largest doc_id of a key all keep
    it. A null doc_id ranks lowest; a key held by null ids alone is kept. Null text is empty: one empty line. Other columns
    pass through. One row of hashes per line is shuffled with map-side counts; text is shuffled once, by row key.
    """
    bounded_batches(docs.sparkSession)
    whole = docs.select(F.struct("*").alias("row"), "doc_id", text_or_empty("text").alias("text"))
    keyed = whole.select("row", "doc_id", "text", *row_keys(F.col("text"), F.col("doc_id")))
    frequent = store(frequent_lines(docs, min_chars, min_docs))
    lines = keyed.select("doc_id", "text", "k1", "k2").mapInArrow(_hashes(min_chars, True), "h1 long, h2 long, doc_id long, k1 long, k2 long, pos int")
    dropped = (
        lines.join(frequent, ["h1", "h2"])
        .filter(~F.col("doc_id").eqNullSafe(F.col("keep")))
        .groupBy("k1", "k2")
        .agg(F.collect_set("pos").alias("drops"))
    )
    joined = keyed.join(dropped, ["k1", "k2"], "left").select("row", _reassemble("text", "drops").alias("out"))
    names = [c for c in docs.columns if c not in ("n_lines", "n_dropped")]
    return joined.select(
        *[F.col("out.text").alias("text") if c == "text" else F.col(f"row.`{c}`").alias(c) for c in names], "out.n_lines", "out.n_dropped"
    )
