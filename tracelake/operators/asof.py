"""As-of join: give each fact the epoch of its key that was current at the fact's time.

An epoch covers ``valid_from <= ts < valid_to``; at equal times the epoch precedes the fact. Of epochs of one key that overlap the latest to start
(then the highest ``seq``) counts, from its start on: an older one does not come back when it ends.
"""

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from tracelake.operators.carry import _CHUNK, CHUNK_NS, chunk_of, short_keys

OPEN_END = (1 << 63) - 1

# A table is broadcast only up to this size, measured, and only if no key has so many rows that trying them
# one by one for each fact would cost more than an ordered scan. The driver collects and hashes it alone, once per join,
# so that larger tables are sooner scanned by all.
BROADCAST_BYTES = 32 << 20
BROADCAST_ROWS_PER_KEY = 64


def row_bytes(table: DataFrame, columns: Sequence[str]) -> Column:
    """About how much memory a row takes: 8 bytes per column, and the length of its text."""
    text = [c for c in columns if isinstance(table.schema[c].dataType, StringType)]
    return reduce(lambda a, b: a + b, [F.coalesce(F.length(c), F.lit(0)) for c in text], F.lit(16 + 8 * len(columns)))


def measured(table: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> tuple[int, int]:
    """Bytes of ``columns`` in memory, and the largest number of rows of a key. One aggregate job per DataFrame."""
    known = table.__dict__.setdefault("_tracelake_measured", {})
    name = (tuple(keys), tuple(columns))
    if name not in known:
        per_key = table.groupBy(*keys).agg(F.sum(row_bytes(table, columns)).alias("bytes"), F.count(F.lit(1)).alias("n"))
        total, top = per_key.agg(F.sum("bytes"), F.max("n")).first()
        known[name] = (total or 0, top or 0)
    return known[name]


def broadcastable(table: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> bool:
    """May ``columns`` of the table be broadcast and probed by ``keys``?"""
    total, top = measured(table, keys, columns)
    return total <= BROADCAST_BYTES and top <= BROADCAST_ROWS_PER_KEY


def asof_join(
    facts: DataFrame,
    epochs: DataFrame,
    keys: Sequence[str],
    payload: Sequence[str],
    *,
    fact_keys: Sequence[str] | None = None,
    fact_time: str = "ts_ns",
    strategy: str = "auto",
    directory: DataFrame | None = None,
    chunk_ns: int = CHUNK_NS,
) -> DataFrame:
    """Left as-of join of ``facts`` to ``epochs`` on ``keys`` (``fact_keys`` on the fact side); adds the ``payload`` columns.

    ``epochs`` has the keys, ``valid_from``, ``valid_to``, ``seq`` and the payload. ``strategy`` is
    ``broadcast`` (interval join, facts stay in place), ``scan`` (facts and epochs are
    shuffled once by key and time chunk and merged in order), or ``auto``: broadcast if
    measured small, else scan, and without time chunks where no key has many rows (see ``short_keys``). ``directory`` may
    name a cheaper DataFrame that holds at least the (fact keys, time) of ``facts``, such as the source ``facts`` was derived
    from. A fact with a null key matches nothing.
    """
    fact_keys = list(fact_keys or keys)
    directory = facts if directory is None else directory
    if strategy == "auto":
        used = dict.fromkeys([*keys, "seq", "valid_from", "valid_to", *payload])
        strategy = "broadcast" if broadcastable(epochs, keys, list(used)) else "scan"
        if strategy == "scan":
            ids = directory.select(*[F.col(c).alias(k) for c, k in zip(fact_keys, keys)])
            chunk_ns = None if short_keys(keys, ids, epochs.select(*keys)) else chunk_ns
    # The epoch side has the same columns whatever the facts call their keys, so joins to one table share its exchange.
    points = epochs.select(
        *[F.col(k).alias(f"_key{i}") for i, k in enumerate(keys)],
        F.col("valid_from").alias("_from"),
        F.col("valid_to").alias("_to"),
        F.col("seq").alias("_seq"),
        *[F.col(c).alias(f"_p_{c}") for c in payload],
    ).filter(F.col("_from") < F.col("_to"))
    if strategy == "broadcast":
        return _interval_join(facts, points, fact_keys, payload, fact_time)
    if strategy == "scan":
        return _scan_join(facts, points, fact_keys, payload, fact_time, directory, chunk_ns)
    raise ValueError(f"unknown strategy {strategy!r}")


def _interval_join(
    facts: DataFrame, points: DataFrame, fact_keys: Sequence[str], payload: Sequence[str], fact_time: str
) -> DataFrame:
    match = (F.col(fact_time) >= F.col("_from")) & (F.col(fact_time) < F.col("_to"))
    for i, k in enumerate(fact_keys):
        match = match & (F.col(k) == F.col(f"_key{i}"))
    # The table is known to be small; cutting it at the next start gives what the scan gives where epochs overlap.
    by_key = Window.partitionBy(*[f"_key{i}" for i in range(len(fact_keys))]).orderBy("_from", "_seq")
    cut = points.withColumn("_to", F.least("_to", F.coalesce(F.lead("_from").over(by_key), F.lit(OPEN_END)))).filter(F.col("_from") < F.col("_to"))
    joined = facts.join(F.broadcast(cut.drop("_seq")), match, "left")
    return joined.select(*facts.columns, *[F.col(f"_p_{c}").alias(c) for c in payload])


def _scan_join(
    facts: DataFrame,
    points: DataFrame,
    fact_keys: Sequence[str],
    payload: Sequence[str],
    fact_time: str,
    directory: DataFrame,
    chunk_ns: int | None,
) -> DataFrame:
    keys = [f"_key{i}" for i in range(len(fact_keys))]

    def keyed() -> Column:
        return reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in keys])

    # Empty epochs are gone, so at most one epoch of a key starts at any time.
    starts = points.filter(keyed()).select(
        *keys,
        F.col("_from").alias("_time"),
        F.lit(0).cast("tinyint").alias("_kind"),
        "_seq",
        chunk_of(F.col("_from"), chunk_ns).alias(_CHUNK),
        F.struct("_to", *[f"_p_{c}" for c in payload]).alias("_at"),
    )
    carried = None
    if chunk_ns is not None:
        at = [F.col(c).alias(k) for c, k in zip(fact_keys, keys)]
        seen = directory.select(*at, chunk_of(F.col(fact_time), chunk_ns).alias(_CHUNK)).filter(keyed()).distinct()
        carried = _carried(starts, seen, keys)
    # Facts without a key or a time match nothing; their rows spread over as many window partitions as they have hashes.
    spread = F.xxhash64(*[c for c in dict.fromkeys((*fact_keys, fact_time, "seq", "start_key")) if c in facts.columns])
    present = reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in (*fact_keys, fact_time)])
    others = [c for c in facts.columns if c not in (*fact_keys, fact_time)]
    probes = facts.select(
        *others,
        *[F.col(c).alias(k) for c, k in zip(fact_keys, keys)],
        F.col(fact_time).alias("_time"),
        F.lit(1).cast("tinyint").alias("_kind"),
        F.when(present, chunk_of(F.col(fact_time), chunk_ns)).otherwise(spread).alias(_CHUNK),
    )
    rows = probes.unionByName(starts, allowMissingColumns=True)
    if carried is not None:
        rows = rows.unionByName(carried, allowMissingColumns=True)
    # The carried epoch has no time and comes first; at equal times an epoch precedes the facts.
    upto = Window.partitionBy(*keys, _CHUNK).orderBy(F.col("_time").asc_nulls_first(), "_kind", "_seq")
    upto = upto.rowsBetween(Window.unboundedPreceding, 0)
    scanned = rows.select("*", F.last("_at", ignorenulls=True).over(upto).alias("_epoch")).filter(F.col("_kind") == 1)
    back = {**{c: k for c, k in zip(fact_keys, keys)}, fact_time: "_time"}
    live = F.col("_time") < F.col("_epoch._to")
    return scanned.select(
        *[F.col(back.get(c, c)).alias(c) for c in facts.columns],
        *[F.when(live, F.col(f"_epoch._p_{c}")).alias(c) for c in payload],
    )


def _carried(starts: DataFrame, seen: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The last epoch of earlier chunks for each (key, chunk) in ``seen``: its own row sorts ahead of the epochs of its chunk."""
    last = starts.groupBy(*keys, _CHUNK).agg(F.max_by("_at", F.struct("_time", "_seq")).alias("_epoch"))
    listed = last.withColumn("_kind", F.lit(1)).unionByName(seen.withColumn("_kind", F.lit(0)), allowMissingColumns=True)
    before = Window.partitionBy(*keys).orderBy(_CHUNK, "_kind").rowsBetween(Window.unboundedPreceding, -1)
    received = (
        listed.select(*keys, _CHUNK, "_kind", F.last("_epoch", ignorenulls=True).over(before).alias("_epoch"))
        .filter((F.col("_kind") == 0) & F.col("_epoch").isNotNull())
        .drop("_kind")
    )
    return received.select(*keys, _CHUNK, F.lit(-1).cast("tinyint").alias("_kind"), F.col("_epoch").alias("_at"))
