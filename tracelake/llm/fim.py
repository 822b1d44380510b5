"""Fill-in-middle rewriting: cuts at line ends, sentinels in one buffer, segments exchanged and restored by three reversals."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import StringType, StructField, StructType

from tracelake.llm.common import bounded_batches, text_or_empty

PLAIN, PSM, SPM = "plain", "psm", "spm"
_CONTINUATION = bytes(range(0x80, 0xC0))  # bytes that start no code point


@dataclass(frozen=True)
class Rule:
    """Percentages of documents rewritten and, of these, put in suffix-prefix-middle order; the seed stands before the id in the hash."""

    percent: int = 100
    spm_percent: int = 50
    seed: str = "7"
    prefix: str = "<P>"
    suffix: str = "<S>"
    middle: str = "<M>"

    def __post_init__(self) -> None:
        marks = (self.prefix, self.suffix, self.middle)
        if any(not m for m in marks) or len(set(marks)) < 3 or any(a != b and (a in b or _overlap(a, b)) for a in marks for b in marks):
            raise ValueError("sentinels must differ, and none may hold another or run into one")

    @property
    def marks(self) -> tuple[bytes, bytes, bytes]:
        return self.prefix.encode(), self.suffix.encode(), self.middle.encode()


def _overlap(a: str, b: str) -> bool:
    """Does an end of ``a`` begin ``b``?"""
    return any(a.endswith(b[:i]) for i in range(1, min(len(a), len(b)) + 1))


def draws(doc_id: int | None, seed: str) -> list[int]:
    """Four 32-bit numbers of a document; a null id counts as the empty string."""
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).digest()
    return np.frombuffer(digest[:16], ">u4").tolist()


def line_ends(raw: bytes) -> np.ndarray:
    """Byte offsets after 0, 1, ..., n units, where a unit is a line with its newline, or the rest."""
    ends = np.flatnonzero(np.frombuffer(raw, np.uint8) == 10) + 1
    if raw and not raw.endswith(b"\n"):
        ends = np.append(ends, len(raw))
    return np.concatenate([[0], ends]).astype(np.int64)


def rotate(buffer: bytearray, start: int, cut: int, end: int) -> None:
    """Exchange ``buffer[start:cut]`` and ``buffer[cut:end]`` in place: reverse each, then both together."""
    view = np.frombuffer(buffer, np.uint8)
    for a, b in ((start, cut), (cut, end), (start, end)):
        half = (b - a) // 2
        head, tail = view[a : a + half], view[b - half : b][::-1]
        head[:], tail[:] = tail.copy(), head.copy()


def rearrange(raw: bytes, first: int, second: int, form: str, marks: tuple[bytes, bytes, bytes]) -> bytearray:
    """The text with a sentinel before each of its three segments (cut at ``first`` and ``second``), in the order of ``form``."""
    prefix, suffix, middle = marks
    buffer = bytearray(raw)
    buffer[second:second] = suffix
    buffer[first:first] = middle
    buffer[0:0] = prefix
    before_middle = len(prefix) + first
    before_suffix = before_middle + len(middle) + second - first
    rotate(buffer, before_middle if form == PSM else 0, before_suffix, len(buffer))
    return buffer


def rebuild(output: bytes, form: str, marks: tuple[bytes, bytes, bytes]) -> bytes:
    """The exact text: the rotation inverted, the sentinels taken out."""
    if form == PLAIN:
        return bytes(output)
    prefix, suffix, middle = marks
    buffer = bytearray(output)
    moved_to = buffer.index(middle if form == PSM else prefix)
    start = buffer.index(suffix) if form == PSM else 0
    rotate(buffer, start, moved_to, len(buffer))
    for mark in (suffix, middle, prefix):
        at = buffer.index(mark)
        del buffer[at : at + len(mark)]
    return bytes(buffer)


def _points(raw: bytes) -> int:
    return len(raw.translate(None, _CONTINUATION))


def _rewrite(raw: bytes, doc_id: int | None, rule: Rule) -> tuple[int, str, int | None, int | None, bytes]:
    ends = line_ends(raw)
    n = len(ends) - 1
    h1, h2, h3, h4 = draws(doc_id, rule.seed)
    if not raw or any(m in raw for m in rule.marks) or h3 % 100 >= rule.percent:
        return n, PLAIN, None, None, raw
    first, second = sorted((h1 % (n + 1), h2 % (n + 1)))
    first, second = int(ends[first]), int(ends[second])
    form = SPM if h4 % 100 < rule.spm_percent else PSM
    output = rearrange(raw, first, second, form, rule.marks)
    return n, form, _points(raw[:first]), _points(raw[first:second]), bytes(output)


def _rewriter(rule: Rule) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, raws = batch.column("doc_id").to_pylist(), batch.column("text").cast(pa.binary()).to_pylist()
            done = [_rewrite(raw, doc_id, rule) for doc_id, raw in zip(ids, raws, strict=True)]
            n, form, prefix, middle, output = zip(*done, strict=True) if done else ([],) * 5
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(form, pa.string()), pa.array(prefix, pa.int64()), pa.array(middle, pa.int64()),
                 pa.array(output, pa.binary()).cast(pa.string())],
                ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"],
            )

    return run


def fill_in_middle(docs: DataFrame, rule: Rule = Rule()) -> DataFrame:
    """(doc_id, n, form, prefix_chars, middle_chars, output): every text cut at two line ends into prefix, middle and suffix.

    ``psm`` puts the suffix before the middle, ``spm`` the suffix before the prefix. A text stays as it is (``plain``, lengths null) if it is null or
    empty, holds a sentinel, or is not drawn. Cuts depend on the id alone, so repeated rows come out alike; a null id draws as the
    empty string. Texts are rewritten where they lie, one at a time, without a shuffle. Other columns are not read. No rows: no rows.
    """
    bounded_batches(docs.sparkSession)
    return docs.select("doc_id", text_or_empty("text").alias("text")).mapInArrow(
        _rewriter(rule), "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string"
    )


def restore(rewritten: DataFrame, rule: Rule = Rule()) -> DataFrame:
    """All columns and ``restored``, the exact text behind ``output`` and ``form``; null where either is null."""
    bounded_batches(rewritten.sparkSession)
    fields = rewritten.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            outputs, forms = batch.column(fields.index("output")).cast(pa.binary()).to_pylist(), batch.column(fields.index("form")).to_pylist()
            texts = [None if o is None or f is None else rebuild(o, f, rule.marks) for o, f in zip(outputs, forms, strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.binary()).cast(pa.string())], [*fields, "restored"])

    return rewritten.mapInArrow(run, StructType([*rewritten.schema.fields, StructField("restored", StringType())]))
