"""Scrapes on a stream: clean-up by generations, the failsafe for idle hosts, counters that fall when an instance expires.

Scrapes are rows of the classes ``scrape`` (someone has read the metrics) and ``idle`` (the failsafe cleans up, see ``stateful.silent_hosts``). A slice
knows of the earlier ones what the rules need: the last few with their gaps, and the highest threshold. Everything a batch writes goes to
folders of that batch, so a replay writes the same rows again and takes nothing back twice.
"""

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from tracelake.operators import scrapes
from tracelake.operators.asof import OPEN_END, asof_join
from tracelake.streaming.state import Carry

SCRAPE_CLASSES = ("scrape", "idle")
_HOST = StructField("host", StringType())
_SCRAPES = StructType([_HOST, *[StructField(n, LongType()) for n in ("ts_ns", *scrapes.KNOWN)]])
_ENDED = StructType([_HOST, *[StructField(n, LongType()) for n in ("start_key", "end_ns", "known_generation")]])
_SUMS = StructType([_HOST, StructField("start_key", LongType()), StructField("metric", StringType()), StructField("dims", StringType()), StructField("value", LongType())])
TABLES = ("scrapes", "ended", "sums", "work_scrapes", "work_ended", "work_increments", "work_gone")


@dataclass(frozen=True)
class ScrapeOptions:
    """What to follow at scrapes.

    ``snapshots`` maps a metric to (its dimensions, a function of the slice that returns rows of host, start_key, ts_ns, the dimensions and value):
    counters whose counts leave with their instance. With ``idle_limit_ns`` hosts are also cleaned up where scrapes stay away for longer.
    """

    min_grace_s: float = 30
    samples: int = 4
    idle_limit_ns: int | None = None
    snapshots: Mapping[str, tuple[Sequence[str], Callable]] = field(default_factory=dict)


class Scraping:
    """The scrapes of one slice, after those before it."""

    def __init__(self, slice_, options: ScrapeOptions):
        self.slice, self.options = slice_, options
        self.carry, self.batch_id = slice_.carry, slice_.batch_id
        before = self.carry.read("scrapes", self.batch_id - 1, _SCRAPES)
        new = slice_.of(*SCRAPE_CLASSES).select("host", F.col("ts_ns").cast("bigint").alias("ts_ns")).distinct()
        times = before.select("host", "ts_ns").unionByName(new)
        if options.idle_limit_ns is not None:
            until = F.lit(None) if slice_.final else F.col("watermark_ns") + 1
            ends = slice_.clock.select("host", until.cast("bigint").alias("_until"))
            times = scrapes.with_idle_cleanups(times.join(ends, "host", "left"), options.idle_limit_ns, F.col("_until"))
        rows = times.distinct().join(before, ["host", "ts_ns"], "left").select(_SCRAPES.names)
        limits = scrapes.cleanup_thresholds(rows, options.min_grace_s, options.samples)
        highest = F.max("threshold").over(Window.partitionBy("host").orderBy("scrape_id"))
        self.limits = self.carry.write(limits.withColumn("limit", highest), "work_scrapes", self.batch_id)

    def write(self, sink: Carry) -> None:
        new = self.limits.filter("known_id IS NULL")
        sink.write(new.select("host", "scrape_id", "ts_ns", "threshold"), "scrapes", self.batch_id)
        last = F.row_number().over(Window.partitionBy("host").orderBy(F.desc("scrape_id")))
        kept = self.limits.withColumn("_last", last).filter(F.col("_last") <= self.options.samples)
        self.carry.write(kept.select("host", "ts_ns", F.col("scrape_id").alias("known_id"), F.col("gap_ns").alias("known_gap_ns"), F.col("limit").alias("known_limit")), "scrapes", self.batch_id)
        if self.slice.has_entities:
            self._clean(sink)
        if self.options.snapshots:
            self._retract(sink)

    def _clean(self, sink: Carry) -> None:
        """Instances that ended get the generation they ended in, once, and wait until a scrape's threshold passes it."""
        waiting = self.carry.read("ended", self.batch_id - 1, _ENDED)
        ended = self.slice.processes.filter(F.col("end_ns").isNotNull()).select("host", "start_key", "end_ns")
        # An instance stays among the processes for its grace after the end; its end is new in one slice only.
        new = self.slice.marked_before(self.slice.marked(ended).filter(F.col("end_ns") <= F.col("_mark")).drop("_mark")).filter(F.col("end_ns") > F.col("_mark"))
        new = new.drop("_mark").withColumn("known_generation", F.lit(None).cast("bigint"))
        aged = self.carry.write(scrapes.cleaned_by(waiting.unionByName(new), self.limits), "work_ended", self.batch_id)
        sink.write(aged.filter("known_generation IS NULL").select("host", "start_key", "generation"), "generations", self.batch_id)
        sink.write(aged.filter("cleaned_scrape IS NOT NULL").select("host", "start_key", "generation", "cleaned_scrape", "cleaned_ns"), "cleaned", self.batch_id)
        left = aged.filter("cleaned_scrape IS NULL").select("host", "start_key", "end_ns", F.col("generation").alias("known_generation"))
        self.carry.write(left, "ended", self.batch_id)

    def place(self, rows: DataFrame) -> DataFrame:
        """Add ``scrape_id``, the scrape that first shows a row: the one at its time or the next, which may still be to come."""
        by_time = Window.partitionBy("host").orderBy("scrape_id")
        after = self.limits.select(
            "host", F.col("scrape_id").alias("seq"), (F.col("ts_ns") + 1).alias("valid_from"),
            (F.lead("ts_ns", 1, OPEN_END - 1).over(by_time) + 1).alias("valid_to"), "scrape_id",
        )
        placed = asof_join(rows, after, ["host"], ["scrape_id"], chunk_ns=self.slice.options.chunk_ns)
        return placed.withColumn("scrape_id", F.coalesce("scrape_id", F.lit(0)) + 1).drop("ts_ns")

    def _retract(self, sink: Carry) -> None:
        """Counts of the slice at their scrapes, and minus all counts of an instance at the scrape after its expiry."""
        parts = []
        for metric, (dims, rows) in self.options.snapshots.items():
            names = F.to_json(F.struct(*[F.col(d).cast("string").alias(d) for d in dims])) if dims else F.lit("{}")
            parts.append(self.place(rows(self.slice).select("host", "start_key", "ts_ns", F.lit(metric).alias("metric"), names.alias("dims"), F.col("value").cast("bigint").alias("value"))))
        own = ["host", "start_key", "metric", "dims"]
        every = parts[0]
        for part in parts[1:]:
            every = every.unionByName(part)
        added = self.carry.write(every.groupBy(*own, "scrape_id").agg(F.sum("value").alias("value")), "work_increments", self.batch_id)
        before = self.carry.read("sums", self.batch_id - 1, _SUMS)
        sums = before.unionByName(added.select(*own, "value")).groupBy(*own).agg(F.sum("value").alias("value"))
        expired = self.slice.marked(self.slice.processes).filter((F.col("expires_ns") <= F.col("_mark")) & (F.col("expires_ns") < OPEN_END))
        expired = expired.select("host", "start_key", F.col("expires_ns").alias("ts_ns"))
        gone = self.carry.write(sums.join(expired, ["host", "start_key"]), "work_gone", self.batch_id)
        taken = self.place(gone.select("host", "start_key", "ts_ns", "metric", "dims", (-F.col("value")).alias("value")))
        steps = added.select("host", "metric", "dims", "scrape_id", "value").unionByName(taken.select("host", "metric", "dims", "scrape_id", "value"))
        sink.write(steps.groupBy("host", "metric", "dims", "scrape_id").agg(F.sum("value").alias("step")), "steps", self.batch_id)
        self.carry.write(sums.join(expired, ["host", "start_key"], "left_anti").select(_SUMS.names), "sums", self.batch_id)
