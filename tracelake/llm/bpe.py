"""Byte-level BPE through sentencepiece: the rank file becomes a BPE model of byte-mapped pieces scored by negative rank."""

from __future__ import annotations

import base64
import hashlib
import struct
from collections.abc import Callable, Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import regex
import sentencepiece
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracelake.llm.common import bounded_batches, text_or_empty

#: Pieces the encoder of a task remembers before it starts afresh.
CACHE = 200_000
UNKNOWN = "⁇"  # its byte map never yields this character


def byte_map() -> list[str]:
    """A printable character for every byte: itself where it is printable Latin-1, else one from U+0100 on."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    spare = iter(range(0x100, 0x200))
    return [chr(b) if b in printable else chr(next(spare)) for b in range(256)]


def read_ranks(path: str | Path) -> list[bytes]:
    """Tokens by rank from lines of base64 and rank; ranks must run from 0 without gaps."""
    pairs = (line.split() for line in Path(path).read_bytes().splitlines() if line)
    ranks = {int(rank): base64.b64decode(token) for token, rank in pairs}
    if sorted(ranks) != list(range(len(ranks))):
        raise ValueError("ranks must run from 0 without gaps")
    return [ranks[i] for i in range(len(ranks))]


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    return bytes([*out, n])


def _field(number: int, value: int | float | bytes) -> bytes:
    if isinstance(value, bytes):
        return _varint(number << 3 | 2) + _varint(len(value)) + value
    if isinstance(value, float):
        return _varint(number << 3 | 5) + struct.pack("<f", value)
    return _varint(number << 3) + _varint(value)


def build_model(tokens: list[bytes]) -> bytes:
    """A serialised sentencepiece BPE model whose ids are the ranks; the unknown piece comes last. Text is left as it is."""
    mapped = byte_map()
    normal, unknown, bpe, absent = 1, 2, 2, 2**64 - 1
    pieces = [_field(1, "".join(mapped[b] for b in token).encode()) + _field(2, float(-rank)) + _field(3, normal) for rank, token in enumerate(tokens)]
    pieces.append(_field(1, UNKNOWN.encode()) + _field(2, 0.0) + _field(3, unknown))
    trainer = _field(3, bpe) + _field(4, len(pieces)) + _field(40, len(tokens)) + b"".join(_field(n, absent) for n in (41, 42, 43)) + _field(45, UNKNOWN.encode())
    normaliser = _field(1, b"identity") + b"".join(_field(n, 0) for n in (3, 4, 5))
    return b"".join(_field(1, p) for p in pieces) + _field(2, trainer) + _field(3, normaliser)


class Codec:
    """Encodes pre-tokens by the model, each on its own, and decodes ids by the inverse byte map."""

    def __init__(self, model: bytes, pattern: str):
        self.model = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.split = regex.compile(pattern).findall
        self.mapped = dict(enumerate(byte_map()))
        back = {c: b for b, c in self.mapped.items()}
        self.bytes_of = [bytes(back[c] for c in self.model.id_to_piece(i)) for i in range(self.model.get_piece_size() - 1)]
        self.cache: dict[str, bytes] = {}

    def _piece(self, token: str) -> bytes:
        ids = self.model.encode(token.encode().decode("latin-1").translate(self.mapped))
        return np.array(ids, "<u4").tobytes()

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        cache, tokens = self.cache, self.split(text)
        try:
            return b"".join([cache[t] for t in tokens])
        except KeyError:
            if len(cache) > CACHE:
                cache.clear()
            out = []
            for t in tokens:
                packed = cache.get(t)
                if packed is None:
                    packed = self._piece(t)
                    if len(t) <= 64:
                        cache[t] = packed
                out.append(packed)
            return b"".join(out)

    def decode(self, packed: bytes) -> bytes:
        table = self.bytes_of
        return b"".join([table[i] for i in np.frombuffer(packed, "<u4").tolist()])


def load_model(spark: SparkSession, ranks: str | Path) -> Broadcast:
    """The model, built once on the driver; its size depends on the vocabulary alone (about 1 MB for 50,000 tokens)."""
    bounded_batches(spark)
    return spark.sparkContext.broadcast(build_model(read_ranks(ranks)))


def _batches(work: Callable[[Codec, str], tuple], names: list[str], types: list[pa.DataType], model: Broadcast, pattern: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec(model.value, pattern)
        for batch in batches:
            rows = [work(codec, text) for text in batch.column(batch.num_columns - 1).to_pylist()]
            new = zip(*rows, strict=True) if rows else [[] for _ in names]
            old = [batch.column(i) for i in range(batch.num_columns - 1)]
            yield pa.RecordBatch.from_arrays([*old, *[pa.array(list(v), t) for v, t in zip(new, types, strict=True)]], [*batch.schema.names[:-1], *names])

    return run


def encode_documents(docs: DataFrame, model: Broadcast, pattern: str) -> DataFrame:
    """(doc_id, n_tokens, ids, decoded): ids as little-endian unsigned 32-bit integers, decoded as the bytes they stand for.

    No special tokens: their strings are ordinary text. Null text is empty: no ids. Rows are independent, so repeated rows and ids repeat.
    A document is one row of one task; a batch is as large as Arrow's settings say.
    """

    def work(codec: Codec, text: str) -> tuple:
        ids = codec.encode(text)
        return len(ids) // 4, ids, codec.decode(ids)

    run = _batches(work, ["n_tokens", "ids", "decoded"], [pa.int64(), pa.binary(), pa.binary()], model, pattern)
    return docs.select("doc_id", text_or_empty("text").alias("text")).mapInArrow(run, "doc_id long, n_tokens long, ids binary, decoded binary")


def digest_documents(docs: DataFrame, model: Broadcast, pattern: str) -> DataFrame:
    """As ``encode_documents``, with SHA-256 of ids and decoded bytes in place of both, so that they never leave the task."""

    def work(codec: Codec, text: str) -> tuple:
        ids = codec.encode(text)
        return len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(codec.decode(ids)).hexdigest()

    run = _batches(work, ["n_tokens", "ids_sha256", "decoded_sha256"], [pa.int64(), pa.string(), pa.string()], model, pattern)
    return docs.select("doc_id", text_or_empty("text").alias("text")).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def decode_documents(encoded: DataFrame, model: Broadcast, pattern: str) -> DataFrame:
    """(doc_id, text) from (doc_id, ids); bytes that are no UTF-8 become U+FFFD. Null ids decode to an empty text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec(model.value, pattern)
        for batch in batches:
            texts = [codec.decode(ids or b"").decode("utf-8", "replace") for ids in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], ["doc_id", "text"])

    return encoded.select("doc_id", F.col("ids").cast("binary").alias("ids")).mapInArrow(run, "doc_id long, text string")
