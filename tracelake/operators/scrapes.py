"""Scrapes: clean-up thresholds and cumulative counter snapshots.

``scrapes`` has one row per host and scrape: host, ts_ns.
"""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracelake.functions.units import NS_PER_S
from tracelake.operators.asof import OPEN_END, asof_join
from tracelake.operators.carry import CHUNK_NS
from tracelake.operators.materialise import materialise

IDLE_LIMIT_NS = 3 * 3600 * NS_PER_S


#: What a stream knows of the scrapes before its slice: their number, gap, and the highest threshold so far.
KNOWN = ("known_id", "known_gap_ns", "known_limit")


def numbered(scrapes: DataFrame) -> DataFrame:
    """Add ``scrape_id``: 1, 2, ... per host in time order, or onwards from the ``known_id`` that the first rows of a host bring along."""
    known = [c for c in KNOWN if c in scrapes.columns]
    place = F.row_number().over(Window.partitionBy("host").orderBy("ts_ns"))
    if known:
        place = place + F.coalesce(F.min("known_id").over(Window.partitionBy("host")), F.lit(1)) - 1
    return scrapes.select("host", "ts_ns", *known, place.cast("bigint").alias("scrape_id"))


def cleanup_thresholds(
    scrapes: DataFrame, min_grace_s: float = 30, samples: int = 4, started_ns: int | None = None
) -> DataFrame:
    """Which generations each scrape may clean: entities that ended in a generation below ``threshold``.

    Adds the gap to the previous scrape, the mean of the last ``samples`` gaps, the grace in
    generations that covers ``min_grace_s``, and the threshold. After a gap of more than twice the grace
    everything that ended before goes. The first gap counts from ``started_ns``, or is left out.
    Scrapes with a ``known_id`` are the last ``samples`` of an earlier slice; their gap and threshold stay as they were.
    """
    by_time = Window.partitionBy("host").orderBy("scrape_id")
    recent = by_time.rowsBetween(-(samples - 1), 0)
    grace_ns = int(min_grace_s * NS_PER_S)
    gaps = numbered(scrapes).withColumn("gap_ns", F.col("ts_ns") - F.lag("ts_ns", 1, started_ns).over(by_time))
    known = "known_id" in scrapes.columns
    if known:
        gaps = gaps.withColumn("gap_ns", F.when(F.col("known_id").isNotNull(), F.col("known_gap_ns")).otherwise(F.col("gap_ns")))
    mean = F.call_function("div", F.sum("gap_ns").over(recent), F.count("gap_ns").over(recent))
    needed = F.ceil(F.lit(float(grace_ns)) / F.col("mean_gap_ns"))
    limits = (
        gaps.withColumn("mean_gap_ns", F.when(F.count("gap_ns").over(recent) > 0, mean))
        .withColumn("grace", F.when(F.col("mean_gap_ns") > 0, F.greatest(needed, F.lit(1))).otherwise(F.lit(1)).cast("bigint"))
        .withColumn(
            "threshold",
            F.when(F.col("gap_ns") > F.lit(2 * grace_ns), F.col("scrape_id"))
            .when(F.col("scrape_id") > F.col("grace"), F.col("scrape_id") - F.col("grace"))
            .otherwise(F.lit(0).cast("bigint")),
        )
    )
    if not known:
        return limits
    return limits.withColumn("threshold", F.coalesce("known_limit", "threshold")).drop("known_gap_ns", "known_limit")


def with_idle_cleanups(scrapes: DataFrame, limit_ns: int = IDLE_LIMIT_NS, until_ns: int | Column | None = None) -> DataFrame:
    """``scrapes`` and the failsafe's clean-ups: one whenever none of either has come for ``limit_ns``, up to ``until_ns``.

    They count as scrapes (generations) of their own. A pause of exactly the limit has none.
    """
    until = until_ns if isinstance(until_ns, Column) else F.lit(until_ns)
    following = F.coalesce(F.lead("ts_ns").over(Window.partitionBy("host").orderBy("ts_ns")), until.cast("bigint"))
    idle = scrapes.select("host", "ts_ns", following.alias("_next")).filter(F.col("_next") - F.col("ts_ns") > limit_ns)
    forced = idle.select("host", F.explode(F.sequence(F.col("ts_ns") + limit_ns, F.col("_next") - 1, F.lit(limit_ns).cast("bigint"))).alias("ts_ns"))
    return scrapes.select("host", "ts_ns").unionByName(forced)


def cleaned_at(
    entities: DataFrame, scrapes: DataFrame, end: str = "end_ns", idle_limit_ns: int | None = None, until_ns: int | None = None, **thresholds
) -> DataFrame:
    """Generation-based expiry: add the scrape that removes each ended entity (null if none does yet).

    An entity that ends after g scrapes has generation g and goes with the first scrape whose threshold
    exceeds g. With ``idle_limit_ns`` the failsafe cleans up where scrapes stay away for longer (``with_idle_cleanups``).
    """
    if idle_limit_ns is not None:
        scrapes = with_idle_cleanups(scrapes, idle_limit_ns, until_ns)
    return cleaned_by(entities, cleanup_thresholds(scrapes, **thresholds), end)


def cleaned_by(entities: DataFrame, limits: DataFrame, end: str = "end_ns") -> DataFrame:
    """``cleaned_at`` for given ``cleanup_thresholds``. Entities may bring a ``known_generation`` along, from an earlier slice."""
    by_time = Window.partitionBy("host").orderBy("scrape_id")
    upto = by_time.rowsBetween(Window.unboundedPreceding, 0)
    before = by_time.rowsBetween(Window.unboundedPreceding, -1)
    sections = limits.select(
        "host",
        F.col("scrape_id").alias("seq"),
        F.coalesce(F.max("threshold").over(before), F.lit(0)).alias("valid_from"),
        F.max("threshold").over(upto).alias("valid_to"),
        F.col("scrape_id").alias("cleaned_scrape"),
        F.col("ts_ns").alias("cleaned_ns"),
    )
    generations = limits.select(
        "host",
        F.col("scrape_id").alias("seq"),
        F.col("ts_ns").alias("valid_from"),
        F.lead("ts_ns", 1, OPEN_END).over(by_time).alias("valid_to"),
        F.col("scrape_id").alias("generation"),
    )
    aged = asof_join(entities, generations, ["host"], ["generation"], fact_time=end)
    generation: Column = F.when(F.col(end).isNotNull(), F.coalesce("generation", F.lit(0)))
    if "known_generation" in entities.columns:
        generation = F.coalesce("known_generation", generation)
    aged = aged.withColumn("generation", generation)
    return asof_join(aged, sections, ["host"], ["cleaned_scrape", "cleaned_ns"], fact_time="generation", chunk_ns=1000)


def idle_cleanup_due(last_scrape_ns: int, now_ns: int, limit_ns: int = IDLE_LIMIT_NS) -> bool:
    """Failsafe: clean up without a scrape once none has come for the limit."""
    return now_ns - last_scrape_ns > limit_ns


def snapshot_counters(
    deltas: DataFrame,
    scrapes: DataFrame,
    series: Sequence[str],
    *,
    processes: DataFrame | None = None,
    retain_expired: bool = True,
    every_scrape: bool = False,
    chunk_ns: int = CHUNK_NS,
) -> DataFrame:
    """Cumulative value of each series at each scrape.

    ``deltas``: host, ts_ns, the series columns, value. Output: host, series, scrape_id, value, one row per
    scrape at which the series changed; with ``every_scrape`` also the unchanged ones after its first.
    With ``retain_expired=False`` (deltas need start_key, and ``processes``) the counts of an
    instance leave the sums when it expires, so values can fall.
    """
    by_time = Window.partitionBy("host").orderBy("scrape_id")
    ids = numbered(scrapes)
    spans = ids.select(
        "host",
        F.col("scrape_id").alias("seq"),
        (F.lag("ts_ns", 1, -OPEN_END).over(by_time) + 1).alias("valid_from"),
        (F.col("ts_ns") + 1).alias("valid_to"),
        "scrape_id",
    )

    def placed(df: DataFrame) -> DataFrame:
        at = asof_join(df, spans, ["host"], ["scrape_id"], chunk_ns=chunk_ns)
        return at.filter(F.col("scrape_id").isNotNull()).drop("ts_ns")

    if retain_expired:
        increments = placed(deltas)
    else:
        # Sums per instance and scrape serve twice: as increments, and in total to be taken back at the expiry.
        own = ["host", "start_key", *series]
        sums = materialise(placed(deltas).groupBy(*own, "scrape_id").agg(F.sum("value").alias("value")))
        gone = processes.filter(F.col("expires_ns") < OPEN_END).select("host", "start_key", F.col("expires_ns").alias("ts_ns"))
        whole = sums.groupBy(*own).agg((-F.sum("value")).alias("value"))
        increments = sums.unionByName(placed(whole.join(gone, ["host", "start_key"])))
    steps = increments.groupBy("host", *series, "scrape_id").agg(F.sum("value").alias("step"))
    return levels(steps, series, ids, every_scrape)


def levels(steps: DataFrame, series: Sequence[str], ids: DataFrame, every_scrape: bool) -> DataFrame:
    """Running sums of ``step`` per series over scrapes; ``ids`` holds the scrapes (host, scrape_id)."""
    by_series = Window.partitionBy("host", *series).orderBy("scrape_id")
    summed = steps.select(
        "host", *series, "scrape_id",
        F.sum("step").over(by_series.rowsBetween(Window.unboundedPreceding, 0)).alias("value"),
        F.lead("scrape_id").over(by_series).alias("_next"),
    )
    if not every_scrape:
        return summed.drop("_next")
    last = ids.groupBy("host").agg(F.max("scrape_id").alias("_last"))
    repeated = summed.join(last, "host").withColumn(
        "scrape_id", F.explode(F.sequence("scrape_id", F.coalesce(F.col("_next") - 1, "_last")))
    )
    return repeated.select("host", *series, "scrape_id", "value")

