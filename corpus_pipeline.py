"""The corpus pipeline: quality rules, line dedup, near-duplicate removal, source mixing, byte-level BPE.

``STAGES`` lists (name, function); a function takes (spark, docs, sf_dir) and returns a DataFrame, all but the last with the columns of ``documents``.
Each stage works on all that its predecessor kept; between stages rows are written as Parquet and read again.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracelake.llm import bpe, lines, mixing, quality, simhash
from tracelake.llm.common import store, table


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules and the risk-controlled cutoffs keep."""
    return quality.keep_good(docs, table(spark, sf_dir, "labels"), risk=0.02, level=0.05)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that occur in three or more; a document that loses all its lines stays, empty."""
    kept = lines.dedup_lines(docs, min_chars=20, min_docs=3)
    return kept.withColumn("n_chars", F.length("text").cast("long")).select(docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group whose fingerprints are linked by at most four differing bits."""
    return simhash.keep_one(docs, distance=4, width=4)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as its source's repetition rate asks for."""
    return mixing.mix(docs, weights=(5, 2, 1), cap=3, seed=0)


def byte_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids, decoded_sha256) of each copy; ids are little-endian unsigned 32-bit integers."""
    model = bpe.load_model(spark, public_tokenizers.path("byte_bpe_50k.tiktoken"))
    encoded = bpe.encode_documents(docs, model, public_tokenizers.PATTERN)
    return encoded.select("doc_id", "n_tokens", "ids", F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [("quality rules", quality_rules), ("line dedup", line_dedup), ("near dedup", near_dedup), ("source mix", source_mix), ("byte BPE", byte_bpe)]

#: SimHash components and BPE have no SQL form; tests hold each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = store(docs)
    return docs
