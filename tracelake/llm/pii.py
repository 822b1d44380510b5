"""Personal data: patterns as seeds, then bootstrapped contextual extraction over the graph of contexts and instances."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracelake.llm.common import row_keys, store, text_or_empty

KINDS = ("email", "ip", "card", "phone")
#: Kinds that no pattern alone makes an identifier: a seed must stand in a confident context too.
FURTHER = ("secret",)
NAMES = KINDS + FURTHER
_LOCAL = "[A-Za-z0-9._%+-]"
# The seeds' patterns, with starts and repeats made possessive where that changes no match, so that time stays linear.
SEEDS = {
    "email": rf"(?:(?<!{_LOCAL})|\G){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: Shapes that only a confident context makes an identifier: addresses with a spelt-out or dotless domain, numbers without a country code.
LOOSE = {
    "email": rf"(?<!{_LOCAL}){_LOCAL}++(?:@[A-Za-z0-9-]++(?![A-Za-z0-9-]|\.[A-Za-z0-9-])|\x20?[(\[]at[)\]]\x20?[A-Za-z0-9-]++(?:\x20?(?:\.|[(\[]dot[)\]])\x20?[A-Za-z0-9-]++)*+)",
    "phone": r"(?<![0-9+.-])(?<!\+[\x20().0-9-]{1,24})\(?[0-9]{2,4}\)?[\x20.-][0-9]{3,4}[\x20.-][0-9]{3,4}(?![0-9.-])",
}
#: Secrets: runs of 12 or more letters and digits, with both; those that are long and look random are seeds.
TOKEN = r"(?<![A-Za-z0-9_.@-])(?=[A-Za-z_]*+[0-9])(?=[0-9_]*+[A-Za-z])[A-Za-z0-9_]{12,}+(?![A-Za-z0-9_@-])"
_RANDOM = r"^(?:(?=.*[a-z])(?=.*[A-Z])(?=.*[0-9]).{20,}|[0-9a-f]{32,}|[0-9A-F]{32,})$"
#: What a text must hold before a pattern is tried.
_NEEDS = {"email": "@", "ip": ".", "card": None, "phone": "+"}
_OCTET = "0*+(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9]?)"  # leading zeros go first; a part has a digit by the seed's pattern
#: Code points looked at on either side of an instance.
CONTEXT = 48


def _digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def _valid(kind: str, x: Column) -> Column:
    if kind == "ip":
        return x.rlike(rf"^{_OCTET}(?:[.]{_OCTET}){{3}}$")
    if kind == "card":
        return F.length(_digits(x)).between(16, 19) & F.call_function("luhn_check", _digits(x))
    if kind == "phone":
        return F.length(_digits(x)).between(8, 15)
    if kind == "secret":
        return x.rlike(_RANDOM)
    return F.lit(True)


def _plausible(kind: str, x: Column) -> Column:
    """Of what fails the seed's test, what a context may still prove."""
    if kind == "card":
        return F.length(_digits(x)).between(13, 19)
    if kind == "phone":
        return F.length(_digits(x)).between(7, 15)
    return F.lit(True)


def running_sum(steps: Column) -> Column:
    """Prefix sums of an array column, in chunks so that long arrays are not copied for every element."""
    chunk = 256
    none = F.array().cast("array<long>")
    inside = lambda part: F.aggregate(part, none, lambda a, x: F.concat(a, F.array(F.coalesce(F.get(a, F.size(a) - 1), F.lit(0)) + x)))
    chunks = F.transform(F.sequence(F.lit(0), F.floor((F.size(steps) - 1) / chunk).cast("int")), lambda i: F.slice(steps, i * chunk + 1, chunk))

    def add(state: Column, part: Column) -> Column:
        total = state["base"] + F.aggregate(part, F.lit(0).cast("long"), lambda a, x: a + x)
        return F.struct(total.alias("base"), F.concat(state["out"], F.transform(inside(part), lambda v: v + state["base"])).alias("out"))

    start = F.struct(F.lit(0).cast("long").alias("base"), none.alias("out"))
    return F.when(F.size(steps) > 0, F.aggregate(chunks, start, add)["out"]).otherwise(none)


def locate(texts: DataFrame, patterns: dict[str, tuple[str, Column]]) -> DataFrame:
    """Adds per name an array of (start, end, word, left, right): leftmost non-overlapping matches in code points, end exclusive, with the text at their sides.

    ``patterns``: name to (regular expression, condition under which it can match). Positions come from the lengths of the pieces that a split by
    the pattern leaves, so a text is read twice per pattern whatever the number of matches. A side ends at the neighbouring match.
    """
    rest = texts.columns
    text = F.col("text")
    out = texts.select(
        *rest,
        *[F.when(when, F.regexp_extract_all(text, F.lit(p), 0)).otherwise(F.array().cast("array<string>")).alias(f"m_{n}") for n, (p, when) in patterns.items()],
        *[F.when(when, F.split(text, p, -1)).otherwise(F.array(text)).alias(f"p_{n}") for n, (p, when) in patterns.items()],
    )
    step = lambda n: F.transform(
        f"m_{n}", lambda _, i: (F.length(F.get(f"p_{n}", i)) + F.coalesce(F.length(F.get(f"m_{n}", i - 1)), F.lit(0))).cast("long")
    )
    out = out.select("*", *[step(n).alias(f"s_{n}") for n in patterns])
    out = out.select("*", *[running_sum(F.col(f"s_{n}")).alias(f"r_{n}") for n in patterns])

    def spans(n: str) -> Column:
        def one(word: Column, i: Column) -> Column:
            at = F.get(f"r_{n}", i)
            sides = F.right(F.get(f"p_{n}", i), F.lit(CONTEXT)), F.left(F.get(f"p_{n}", i + 1), F.lit(CONTEXT))
            return F.struct(at.alias("start"), (at + F.length(word)).alias("end"), word.alias("word"), sides[0].alias("left"), sides[1].alias("right"))

        return F.transform(f"m_{n}", one)

    return out.select(*rest, *[spans(n).alias(n) for n in patterns])


def find(docs: DataFrame) -> DataFrame:
    """(doc_id, k1, k2, base, found): the seeds' spans in order of kind and start, and all identifier-like spans with form, side texts and whether they are seeds."""
    text = text_or_empty("text")
    digit = text.rlike("[0-9]")
    patterns = {k: (p, digit & F.contains(text, F.lit(_NEEDS[k])) if _NEEDS[k] and k != "email" else digit if k != "email" else F.contains(text, F.lit("@"))) for k, p in SEEDS.items()}
    patterns |= {"loose_email": (LOOSE["email"], F.contains(text, F.lit("@")) | text.rlike(r"[(\[]at[)\]]")), "loose_phone": (LOOSE["phone"], digit), "secret": (TOKEN, digit)}
    located = locate(docs.select("doc_id", *row_keys(text, F.col("doc_id")), text.alias("text")), patterns)

    def typed(name: str, kind: str, seed: bool) -> Column:
        form = {"email": F.lower, "ip": lambda x: x, "secret": lambda x: x}.get(kind, _digits)

        def one(s: Column) -> Column:
            ok = _valid(kind, s["word"]) if seed else F.lit(False)
            return F.struct(F.lit(NAMES.index(kind)).alias("kind"), s["start"].alias("start"), s["end"].alias("end"), form(s["word"]).alias("form"), ok.alias("seed"), s["left"].alias("left"), s["right"].alias("right"))

        kept = F.filter(name, lambda s: _plausible(kind, s["word"])) if kind in ("card", "phone") else F.col(name)
        return F.transform(kept, one)

    every = F.concat(*[typed(k, k, True) for k in NAMES], typed("loose_email", "email", False), typed("loose_phone", "phone", False))
    typed_rows = located.select("doc_id", "k1", "k2", every.alias("found"))
    base = F.transform(F.filter("found", lambda s: s["seed"] & (s["kind"] < len(KINDS))), lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end")))
    return typed_rows.select("doc_id", "k1", "k2", base.alias("base"), "found")


def _contexts(kind: Column, left: Column, right: Column) -> Column:
    """Lexical patterns of an instance: the two words before it, and the word before with the word after; none without a word before.

    Marks such as ``= "`` are words here; a secret's patterns also hold the last word with a letter or digit before it.
    """
    before = F.filter(F.split(F.lower(left), r"[\x20\x09-\x0D]+"), lambda w: w != "")
    after = F.coalesce(F.get(F.filter(F.split(F.lower(right), r"[\x20\x09-\x0D]+"), lambda w: w != ""), F.lit(0)), F.lit(""))
    last, second = F.element_at(before, -1), F.coalesce(F.get(before, F.size(before) - 2), F.lit(""))
    pair = F.array(F.concat_ws(" ", F.lit("2:"), second, last), F.concat_ws(" ", F.lit("b:"), last, after))
    name = F.regexp_extract(F.lower(left), r"([\p{L}\p{N}]+)([^\p{L}\p{N}]{1,16})$", 0)
    pair = F.when(kind < len(KINDS), pair).otherwise(F.array(F.concat(F.lit("n: "), name)))
    return F.when(F.size(before) > 0, pair).otherwise(F.array().cast("array<string>"))


def bootstrap(occurrences: DataFrame, rounds: int | None = None, support: float = 3.0, pattern_floor: float = 0.8, instance_floor: float = 0.9) -> DataFrame:
    """(kind, form) of the unseen instances that are confident and stand in a confident context at least once; of the further kinds, seeds too.

    The graph links contexts and distinct instances of a kind. A context's score is the confidence of its instances over their number, nothing if
    they add up to less than ``support``; an instance that is no seed is as confident as the noisy-or of its contexts. Scores and
    confidences are computed in turn until a round adds no instance and no confident context, or ``rounds`` times if given; an instance counts for a context once confident
    by ``instance_floor``. Confidences never fall from one round to the next, so that ends. Each step is two
    aggregates over distinct edges, combined before the shuffle, so a context or an instance with most of the rows is no hot group.
    """
    graph = store(occurrences.groupBy("kind", "context", "form").agg(F.max("seed").alias("seed")))
    # Contexts without a seed can get support only from instances that contexts with seeds have promoted.
    sure = graph.filter("seed").select("kind", "form").distinct().withColumn("sure", F.lit(1.0))
    sure = store(sure)
    seeds, reached, done = sure, (0, 0), 0
    while True:
        weighed = graph.join(sure, ["kind", "form"], "left")
        sums = weighed.groupBy("kind", "context").agg(F.sum(F.coalesce("sure", F.lit(0.0))).alias("sum"), F.count(F.lit(1)).alias("n"))
        scores = store(sums.filter(F.col("sum") >= support).select("kind", "context", (F.col("sum") / (F.col("n") + 1)).alias("score")))
        unseen = graph.join(seeds, ["kind", "form"], "left_anti").join(scores, ["kind", "context"])
        doubt = unseen.groupBy("kind", "form").agg(F.sum(F.log1p(-F.col("score"))).alias("doubt"))
        found = store(doubt.filter(1 - F.exp("doubt") >= instance_floor).select("kind", "form", (1 - F.exp("doubt")).alias("sure")))
        sure = seeds.unionByName(found)
        trusted = scores.filter(F.col("score") >= pattern_floor).select("kind", "context")
        now, done = (found.count(), trusted.count()), done + 1
        if done == rounds or not now[0] or done > 1 and now[0] <= reached[0] and now[1] <= reached[1]:
            break
        reached = now
    named = found.select("kind", "form").unionByName(seeds.filter(F.col("kind") >= len(KINDS)).select("kind", "form"))
    return store(graph.join(named, ["kind", "form"]).join(trusted, ["kind", "context"]).select("kind", "form").distinct())


def extract(docs: DataFrame, rounds: int | None = None, support: float = 3.0, pattern_floor: float = 0.8, instance_floor: float = 0.9) -> DataFrame:
    """(doc_id, base, spans) per row: arrays of (kind, start, end) in order, kind as its place in ``NAMES``; base by the seeds' patterns, spans with the discovered ones.

    Whole texts are read, once, and never shuffled: what goes on is a row per identifier-like span with its side texts. Null text is empty. Repeated
    rows get equal results. An instance found anywhere is reported wherever it stands, whatever its context. Kinds are matched apart, so spans of two kinds may overlap. Discovered spans never replace a base span; of those of one kind that
    overlap a base span, none comes about, as loose shapes exclude the seeds' own.
    """
    found = store(find(docs))
    place = found.select("k1", "k2", F.explode("found").alias("s")).select("k1", "k2", "s.*")
    occurrences = place.select("k1", "k2", "kind", "start", "end", "form", "seed", F.explode(_contexts(F.col("kind"), F.col("left"), F.col("right"))).alias("context"))
    forms = bootstrap(occurrences, rounds, support, pattern_floor, instance_floor)
    fresh = place.filter(~F.col("seed") | (F.col("kind") >= len(KINDS))).join(forms, ["kind", "form"])
    new = fresh.groupBy("k1", "k2").agg(F.collect_set(F.struct("kind", "start", "end")).alias("new"))
    joined = found.select("doc_id", "k1", "k2", "base").join(new, ["k1", "k2"], "left")
    return joined.select("doc_id", "base", F.when(F.col("new").isNull(), F.col("base")).otherwise(F.sort_array(F.concat("base", "new"))).alias("spans"))


def span_text(spans: str) -> Column:
    """kind:start:end of each span, comma-joined."""
    names = F.array(*[F.lit(k) for k in NAMES])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")
