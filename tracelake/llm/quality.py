"""Quality rules with risk-controlled cutoffs: labelled holdouts and exact binomial bounds pick the cutoff of each rule and stratum."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracelake.llm.common import store, text_or_empty

MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_text_lines")


@dataclass(frozen=True)
class Rule:
    """Rejects what lies above a cutoff; the cutoffs run from the most lenient to the strictest."""

    name: str
    value: str  # SQL over the measures
    cutoffs: tuple[float, ...]


RULES = (
    Rule("symbols", "n_symbols / greatest(n_words, 1)", (3.0, 2.5, 2.0, 1.5, 1.0, 0.75, 0.5, 0.4, 0.3, 0.2, 0.1, 0.05)),
    Rule("dup_lines", "n_dup_lines / greatest(n_text_lines, 1)", (0.9, 0.8, 0.7, 0.6, 0.5, 0.4, 0.35, 0.3, 0.25, 0.2)),
    Rule("repeats", "n_repeat_words / greatest(n_words, 1)", (0.45, 0.4, 0.35, 0.3, 0.25, 0.2, 0.15, 0.1)),
    Rule("long_words", "word_chars / greatest(n_words, 1)", (20.0, 16.0, 14.0, 12.0, 11.0, 10.0, 9.0, 8.5, 8.0, 7.5, 7.0)),
)


def _repeat_words(windows: Column, has: Column, order: Column) -> Column:
    """Words covered by windows that occur twice or more; ``order`` holds (hash, place) sorted, null if no window repeats."""
    last = F.size(order) - 1

    def twin(j: Column) -> Column:
        h = F.get(order, j)["h"]
        return h.eqNullSafe(F.get(order, j - 1)["h"]) | h.eqNullSafe(F.get(order, j + 1)["h"])

    places = F.sort_array(F.transform(F.filter(F.sequence(F.lit(0), last), twin), lambda j: F.get(order, j)["at"]))
    start = F.struct(F.lit(0).alias("sum"), F.lit(-3).alias("prev"))
    # A window covers three words, less those the one before it has covered.
    add = lambda s, p: F.struct((s["sum"] + F.least(F.lit(3), p - s["prev"])).alias("sum"), p.alias("prev"))
    return F.when(has, F.aggregate(places, start, add)["sum"]).otherwise(F.lit(0))


def measure(docs: DataFrame) -> DataFrame:
    """Adds the measures of each text, all from its own row: no shuffle, no Python.

    Words are runs without ASCII white space. ``word_chars``: code points in words. ``n_symbols``: characters of ``#*$%&|<>``. ``n_dup_lines``: lines with
    a word that equal an earlier line. ``n_repeat_words``: words in three-word windows found twice or more in the text. Windows are
    compared by 64-bit hashes within one text and sorted only if one repeats, so time stays near linear in its length. Null text has no words. Input columns
    of the measures' names are replaced.
    """
    text = text_or_empty("text")
    blank = r"[\x20\x09-\x0D]"
    kept = [c for c in docs.columns if c not in MEASURES]
    split = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in kept]).alias("row"),
        F.filter(F.split(text, f"{blank}+"), lambda w: w != "").alias("words"),
        F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")).alias("lines"),
        F.regexp_count(text, F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
    )
    count = F.size("words")
    window = lambda i: F.xxhash64(F.get("words", i), F.get("words", i + 1), F.get("words", i + 2))
    hashed = split.select(
        "row", "n_symbols",
        count.cast("long").alias("n_words"),
        F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        F.size("lines").cast("long").alias("n_text_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.when(count >= 3, F.transform(F.sequence(F.lit(0), count - 3), window)).otherwise(F.array().cast("array<long>")).alias("windows"),
    )
    has = F.size(F.array_distinct("windows")) < F.size("windows")
    placed = F.transform("windows", lambda h, i: F.struct(h.alias("h"), i.alias("at")))
    names = [c for c in MEASURES if c != "n_repeat_words"]
    ordered = hashed.select("row", *names, "windows", F.when(has, F.sort_array(placed)).alias("order"))
    repeats = _repeat_words(F.col("windows"), F.col("order").isNotNull(), F.col("order")).cast("long")
    return ordered.select(*[F.col(f"row.`{c}`").alias(c) for c in kept], *[F.col(c) if c != "n_repeat_words" else repeats.alias(c) for c in MEASURES])


def keyed(docs: DataFrame) -> DataFrame:
    """Adds ``text_key``: equal texts, and only they, share it (128 bits)."""
    text = text_or_empty("text")
    return docs.withColumn("text_key", F.struct(F.xxhash64(text).alias("a"), F.xxhash64(F.lit("k2"), text).alias("b")))


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 50)


def log_binomial_tail(n: Column, k: Column, p: float) -> Column:
    """log P(Binomial(n, p) <= k), summed term by term on the log scale; for k < n * p."""
    odds = float(p / (1 - p))
    first = n.cast("double") * F.log1p(F.lit(-p))
    start = F.struct(first.alias("term"), first.alias("sum"))

    def add(state: Column, j: Column) -> Column:
        term = state["term"] + F.log((n - j + 1).cast("double") / j.cast("double") * odds)
        high = F.greatest(term, state["sum"])
        return F.struct(term.alias("term"), (high + F.log1p(F.exp(F.least(term, state["sum"]) - high))).alias("sum"))

    steps = F.when(k > 0, F.sequence(F.lit(1).cast("long"), k)).otherwise(F.array().cast("array<long>"))
    return F.aggregate(steps, start, add)["sum"]


def calibrate_joint(measured: DataFrame, labels: DataFrame, risk: float = 0.02, level: float = 0.05, stratum: str = "lang", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(of, n, least, lead, cut_<rule>...): joint cutoffs of all rules per stratum, each test at the whole ``risk``; a cutoff is null where none is safe. Store ``measured`` first.

    The holdout is every labelled text that the base rules keep: good if all labels of all its documents say quality 1. Equal texts of a stratum (by ``text_key``, where
    ``measured`` has it) count once, as the bound takes its documents for independent draws. A setting is safe if the exact (Clopper-Pearson) upper bound of its
    false rejection rate, at its share of ``level``, is at most ``risk``; that holds if P(Binomial(n, risk) <= k) does not exceed the level.

    What is tested is not a rule alone but a setting of all rules: its false rejections are the held-out texts that any of its cutoffs rejects. There is a family of settings per rule: it tightens that rule through all of its cutoffs first,
    then the others in their order, so each setting rejects what the one before it does. Tests run along a family and stop at the first failure. The level is split
    over strata and families, so every setting that passed is safe with probability 1 - ``level``, and a stratum may take any: it takes the last of
    the family that rejects most of its documents labelled bad (ties: the first rule's). ``n`` is the holdout's size, ``least`` the smallest
    with which a setting without false rejections passes, ``lead`` the place of the family's first rule.

    Labels of unknown documents, null labels and null ids are left out; a null stratum is a stratum.
    Strata without a good held-out text have no row, so nothing is rejected there. Counts are combined before the shuffle, by stratum, family and step.
    """
    orders = [[i, *[j for j in range(len(rules)) if j != i]] for i in range(len(rules))]
    length = sum(len(r.cutoffs) for r in rules)
    offsets = [{j: sum(len(rules[x].cutoffs) for x in order[: order.index(j)]) for j in order} for order in orders]
    # The first step of each family whose setting rejects the row; ``length`` if none does.
    passes = lambda r: F.size(F.filter(F.array(*[F.lit(c) for c in r.cutoffs]), lambda c: F.expr(r.value) <= c))
    first = {j: passes(r) for j, r in enumerate(rules)}
    step = lambda at: F.least(F.lit(length), *[F.when(first[j] < len(r.cutoffs), first[j] + at[j]).otherwise(F.lit(length)) for j, r in enumerate(rules)])
    known = labels.filter(F.col("doc_id").isNotNull() & F.col("quality").isNotNull()).groupBy("doc_id").agg(F.min("quality").alias("label_"))
    held = measured.filter(~base_failed()).join(known, "doc_id")
    if "text_key" in measured.columns:
        each = held.groupBy(F.col(f"`{stratum}`").alias("of"), "text_key").agg(F.min("label_").alias("label_"), *[F.first(m).alias(m) for m in MEASURES])
    else:
        each = held.select(F.col(f"`{stratum}`").alias("of"), "label_", *MEASURES)
    held = each.select("of", (F.col("label_") == 1).alias("good"), F.posexplode(F.array(*[step(at) for at in offsets])).alias("lead", "step"))
    counts = held.groupBy("of", "lead", "step").agg(F.count_if("good").alias("k"), F.count_if(~F.col("good")).alias("bad"))
    families = store(counts.groupBy("of", "lead").agg(F.sum("k").alias("n"), F.collect_list(F.struct("step", "k", "bad")).alias("steps")).filter("n > 0"))
    strata = max(families.select("of").distinct().count(), 1)
    share = float(np.log(level / (strata * len(rules))))
    total = lambda name, upto: F.aggregate(F.filter("steps", lambda s: s["step"] < upto), F.lit(0).cast("long"), lambda a, s: a + s[name])
    tests = families.select("*", F.explode(F.sequence(F.lit(0), F.lit(length - 1))).alias("place"))
    tests = tests.select("of", "lead", "n", "steps", "place", total("k", F.col("place") + 1).alias("k"))
    safe = F.when(F.col("k") < F.col("n") * risk, log_binomial_tail(F.col("n"), F.col("k"), risk) <= share).otherwise(F.lit(False))
    passed = tests.select("*", safe.alias("safe")).groupBy("of", "lead").agg(
        F.first("n").alias("n"), F.first("steps").alias("steps"), F.coalesce(F.min(F.when(~F.col("safe"), F.col("place"))), F.lit(length)).alias("passed")
    )
    ranked = passed.select("of", F.struct(total("bad", F.col("passed")).alias("bad"), (-F.col("lead")).alias("rank"), "lead", "n", "passed").alias("family"))
    best = ranked.groupBy("of").agg(F.max("family").alias("family")).select("of", "family.*")

    def cutoff(j: int, r: Rule) -> Column:
        taken = F.col("passed") - F.get(F.array(*[F.lit(at[j]) for at in offsets]), F.col("lead"))
        return F.when(taken > 0, F.get(F.array(*[F.lit(c) for c in r.cutoffs]), F.least(taken, F.lit(len(r.cutoffs))) - 1)).alias(f"cut_{r.name}")

    least = F.lit(int(np.ceil(share / np.log1p(-risk)))).cast("long").alias("least")
    return store(best.select("of", "n", least, "lead", *[cutoff(j, r) for j, r in enumerate(rules)]))


def judge(measured: DataFrame, cutoffs: DataFrame, stratum: str = "lang", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Adds ``base_failed`` and ``kept``: false if the base rules fail or a value lies above its stratum's cutoff. No cutoff rejects nothing."""
    above = F.lit(False)
    for r in rules:
        above = above | F.coalesce(F.expr(r.value) > F.col(f"cut_{r.name}"), F.lit(False))
    kept = [c for c in measured.columns if c not in ("base_failed", "kept")]
    joined = measured.join(cutoffs, F.col(f"`{stratum}`").eqNullSafe(F.col("of")), "left")
    return joined.select(*[measured[f"`{c}`"] for c in kept], base_failed().alias("base_failed"), (~base_failed() & ~above).alias("kept"))


def keep_good(docs: DataFrame, labels: DataFrame, risk: float = 0.02, level: float = 0.05) -> DataFrame:
    """The documents that the base rules and the jointly calibrated cutoffs keep, with their own columns. Rows are judged alike however often they repeat."""
    packed = docs.select(F.struct("*").alias("own_"), "doc_id", "lang", "text")
    measured = store(keyed(measure(packed)).select("own_", "doc_id", "lang", "text_key", *MEASURES))
    verdict = judge(measured, calibrate_joint(measured, labels, risk, level))
    return verdict.filter("kept").select(*[F.col(f"own_.`{c}`").alias(c) for c in docs.columns])
