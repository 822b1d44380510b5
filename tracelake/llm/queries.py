"""The dealt operators as queries over the given tables: each reads its whole table and returns its full result."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracelake.llm import bpe, chat, fim, fingerprint, html, lines, mixing, negatives, pii, quality, simhash, suffix_dedup, topk
from tracelake.llm.common import store, table
from tracelake.llm.sql import ORACLE  # noqa: F401  (the entry point takes both)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


@query
def op1_pii_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.extract(table(spark, sf_dir, "documents").select("doc_id", "text"))
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == pii.KINDS.index(kind))).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", *[count(k) for k in pii.KINDS], F.sha2(pii.span_text("base"), 256).alias("base_sha256"), pii.span_text("spans").alias("spans"), F.size("spans").cast("long").alias("n_spans"))


@query
def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = suffix_dedup.remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"), length=100, digest=True)
    return kept.withColumnRenamed("kept", "kept_sha256")


@query
def op3_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = bpe.load_model(spark, public_tokenizers.path("byte_bpe_50k.tiktoken"))
    return bpe.digest_documents(table(spark, sf_dir, "documents"), model, public_tokenizers.PATTERN)


@query
def op4_spot_signatures(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.compare_edits(table(spark, sf_dir, "documents").select("doc_id", "text"))


@query
def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = lines.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"), min_chars=20, min_docs=3)
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


@query
def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    measured = quality.measure(table(spark, sf_dir, "documents").select("doc_id", "lang", "text"))
    measured = store(quality.keyed(measured).select("doc_id", "lang", "text_key", *quality.MEASURES))
    verdict = quality.judge(measured, quality.calibrate_joint(measured, table(spark, sf_dir, "labels"), risk=0.02, level=0.05))
    return verdict.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


@query
def op7_chat_snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.render(table(spark, sf_dir, "conversations"))


@query
def op8_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = mixing.mix_plan(table(spark, sf_dir, "documents").select("doc_id", "source", "text"), weights=(5, 2, 1), cap=3, seed=0)
    return plan.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


@query
def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"), distance=4, width=4)
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


@query
def op10_page_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = html.extract_pages(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return pages.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


@query
def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    rewritten = fim.restore(fim.fill_in_middle(table(spark, sf_dir, "documents")))
    return rewritten.select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2("restored", 256).alias("restored_sha256")
    )


@query
def op12_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"), every=100, k=10, scale=1024)


@query
def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    shifted = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "embedding", shifted.alias("label"))
    return negatives.hard_negatives(rows, every=100, positives=5, negatives=5, low=80, high=100, scale=256)
