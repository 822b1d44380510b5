"""Ordered scans over few, very long sequences.

A window partitioned by ``(host, cpu)`` or ``(host, pid)`` puts a whole sequence in one task, and
one busy key can own most of a trace. The scans here cut each sequence into time chunks, so the
window partitions are ``(key, chunk)``:

1. one small row per ``(key, chunk)`` summarises what the chunk hands to later ones;
2. a window over these rows (their number is trace length / chunk length) gives what
   each chunk receives;
3. that value enters the chunk as one extra leading row, and a window inside the chunk finishes.

Rows are shuffled once. Results do not depend on the chunk length.

With many short sequences the chunks only add rows: where no key has more than ``KEY_ROWS`` (see :func:`short_keys`), a scan may
take each sequence as one (``chunk_ns=None``).
"""

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracelake.functions.units import NS_PER_S, whole

CHUNK_NS = 10 * NS_PER_S

#: So many rows of a key are scanned in one piece at most.
KEY_ROWS = 200_000

_CHUNK = "_chunk"
_REAL = "_real"


def chunk_of(time: Column, chunk_ns: int | None) -> Column:
    return F.lit(0).cast("bigint") if chunk_ns is None else whole(time, chunk_ns)


def short_keys(keys: Sequence[str], *tables: DataFrame) -> bool:
    """Has no key more than ``KEY_ROWS`` rows in the tables together? One aggregate job; null keys do not count."""
    counts = [t.dropna(subset=list(keys)).groupBy(*keys).agg(F.count(F.lit(1)).alias("n")) for t in tables]
    per_key = reduce(DataFrame.unionByName, counts).groupBy(*keys).agg(F.sum("n").alias("n"))
    return (per_key.agg(F.max("n")).first()[0] or 0) <= KEY_ROWS


def _received(handed: DataFrame, keys: Sequence[str], outs: Sequence[str], backward: bool) -> DataFrame:
    """For each (key, chunk): the last non-null value of every column over earlier chunks."""
    position = F.col(_CHUNK).desc() if backward else F.col(_CHUNK).asc()
    before = Window.partitionBy(*keys).orderBy(position).rowsBetween(Window.unboundedPreceding, -1)
    carried = handed.select(
        *keys, _CHUNK, *[F.last(F.col(o), ignorenulls=True).over(before).alias(o) for o in outs]
    )
    return carried.filter(_any_set(outs))


def _any_set(columns: Sequence[str]) -> Column:
    test = F.col(columns[0]).isNotNull()
    for name in columns[1:]:
        test = test | F.col(name).isNotNull()
    return test


def _finish(
    rows: DataFrame,
    received: DataFrame | None,
    keys: Sequence[str],
    order: Sequence[str],
    outs: Sequence[str],
    backward: bool,
    inclusive: bool,
) -> DataFrame:
    """Rows hold ``_in_<out>`` values; add ``<out>`` by a scan inside each chunk."""
    merged = rows.withColumn(_REAL, F.lit(1).cast("tinyint"))
    if received is not None:
        extra = received.select(
            *keys, _CHUNK, *[F.col(o).alias(f"_in_{o}") for o in outs], F.lit(0).cast("tinyint").alias(_REAL)
        )
        merged = merged.unionByName(extra, allowMissingColumns=True)
    positions = [F.col(c).desc_nulls_last() if backward else F.col(c).asc_nulls_first() for c in order]
    upto = Window.partitionBy(*keys, _CHUNK).orderBy(F.col(_REAL), *positions)
    upto = upto.rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
    scanned = merged.select("*", *[F.last(F.col(f"_in_{o}"), ignorenulls=True).over(upto).alias(o) for o in outs])
    return scanned.filter(F.col(_REAL) == 1).drop(_REAL, _CHUNK, *[f"_in_{o}" for o in outs])


def fill(
    rows: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    values: Mapping[str, Column],
    *,
    backward: bool = False,
    inclusive: bool = False,
    chunk_ns: int | None = CHUNK_NS,
) -> DataFrame:
    """Add, for each ``out -> value``, the nearest non-null value before the row (after it, if backward).

    ``order`` starts with an integer time column and must order the rows of a key totally.
    """
    outs = list(values)
    chunked = rows.select(
        "*", chunk_of(F.col(order[0]), chunk_ns).alias(_CHUNK), *[values[o].alias(f"_in_{o}") for o in outs]
    )
    if chunk_ns is None:
        return _finish(chunked, None, keys, order, outs, backward, inclusive)
    pick = F.min_by if backward else F.max_by
    place = F.struct(*[F.col(c) for c in order])
    handed = chunked.groupBy(*keys, _CHUNK).agg(
        *[pick(F.col(f"_in_{o}"), F.when(F.col(f"_in_{o}").isNotNull(), place)).alias(o) for o in outs]
    )
    return _finish(chunked, _received(handed, keys, outs, backward), keys, order, outs, backward, inclusive)


def neighbour_time(
    rows: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    out: str,
    *,
    backward: bool = False,
    chunk_ns: int = CHUNK_NS,
) -> DataFrame:
    """Add the time of the previous row of the key (the next one, if backward); null at the end.

    The case of :func:`fill` whose value is the time itself: a chunk is summarised by a plain ``max`` / ``min``
    (hash aggregated on the map side) and the scan is a plain ``lag``.
    """
    time = order[0]
    chunked = rows.select("*", chunk_of(F.col(time), chunk_ns).alias(_CHUNK))
    edge = F.min(time) if backward else F.max(time)
    handed = chunked.groupBy(*keys, _CHUNK).agg(edge.alias(time))
    # The edge of an earlier chunk lies outside this one, so it sorts ahead of all its rows by its own time.
    extra = _received(handed, keys, [time], backward).withColumn(_REAL, F.lit(False))
    merged = chunked.withColumn(_REAL, F.lit(True)).unionByName(extra, allowMissingColumns=True)
    positions = [F.col(c).desc() if backward else F.col(c).asc() for c in order]
    beside = Window.partitionBy(*keys, _CHUNK).orderBy(*positions)
    return merged.select("*", F.lag(time).over(beside).alias(out)).filter(F.col(_REAL)).drop(_REAL, _CHUNK)


def stack_depth(
    rows: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    step: Column,
    out: str,
    *,
    chunk_ns: int = CHUNK_NS,
) -> DataFrame:
    """Add the height after each row of a counter that moves by ``step`` (+1 / -1) but never below 0.

    The height is the running sum minus the lowest running sum so far (or 0). A chunk is
    summarised by its sum and lowest prefix; the height it receives enters as a first step.
    """
    chunked = rows.select("*", chunk_of(F.col(order[0]), chunk_ns).alias(_CHUNK), step.cast("bigint").alias("_step"))
    inside = Window.partitionBy(*keys, _CHUNK).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    chunks = (
        chunked.select(*keys, _CHUNK, "_step", F.sum("_step").over(inside).alias("_prefix"))
        .groupBy(*keys, _CHUNK)
        .agg(F.sum("_step").alias("_sum"), F.min("_prefix").alias("_low"))
    )
    before = Window.partitionBy(*keys).orderBy(_CHUNK).rowsBetween(Window.unboundedPreceding, -1)
    received = (
        chunks.withColumn("_base", F.coalesce(F.sum("_sum").over(before), F.lit(0)))
        .withColumn("_floor", F.least(F.lit(0), F.min(F.col("_base") + F.col("_low")).over(before)))
        .select(*keys, _CHUNK, (F.col("_base") - F.col("_floor")).alias("_step"), F.lit(0).cast("tinyint").alias(_REAL))
        .filter(F.col("_step") > 0)
    )
    merged = chunked.withColumn(_REAL, F.lit(1).cast("tinyint")).unionByName(received, allowMissingColumns=True)
    upto = Window.partitionBy(*keys, _CHUNK).orderBy(_REAL, *order).rowsBetween(Window.unboundedPreceding, 0)
    return (
        merged.withColumn("_prefix", F.sum("_step").over(upto))
        .withColumn(out, F.col("_prefix") - F.least(F.lit(0), F.min("_prefix").over(upto)))
        .filter(F.col(_REAL) == 1)
        .drop(_REAL, _CHUNK, "_step", "_prefix")
    )
