"""Samples and exposition text of a stream, and registered families over its slices."""

from collections.abc import Callable, Iterable, Sequence
from functools import cached_property, reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from tracelake.operators.entities import PROGRAM, filter_programs
from tracelake.operators.histogram import DURATION_BOUNDS_US, GAP_BOUNDS_MS, LATENCY_BOUNDS_US, add_histograms
from tracelake.plans import families
from tracelake.plans.families import Context
from tracelake.plans.rollup import LABELS, name_programs
from tracelake.sources.dimensions import disk_dim
from tracelake.sources.samples import COUNTER, GAUGE, histogram_samples, write_exposition
from tracelake.streaming.state import Carry

DURATIONS = "perfinfo_dpc_execution_time_microseconds"
#: Labels, bounds and the divisor of the total, by histogram.
HISTOGRAMS = {
    "thread_context_switch_interval_milliseconds": (["cpu"], GAP_BOUNDS_MS, 1e6),
    "perfinfo_isr_to_dpc_latency_microseconds": ([], LATENCY_BOUNDS_US, 1.0),
    DURATIONS: (["image_name"], DURATION_BOUNDS_US, 1.0),
}
SINK = ("deltas", "histograms", "instances", "late", "restarts", "samples")
TABLES = (*(f"total_{t}" for t in SINK), "work_samples")
#: Stands before the start key in the place of a process name until the totals are read.
INSTANCE = "\u0001"


class SliceContext(Context):
    """The context of a registered family on a stream: the rows of a slice, and the entities known at its end.

    A process carries its start key as its name: samples per program are samples per instance, and get the name that the instance
    has when the totals are read.
    """

    def __init__(self, slice_):
        super().__init__(wide=slice_.rows, switches=slice_.options.switches, grace_ns=slice_.options.grace_ns, chunk_ns=slice_.options.chunk_ns)
        self.slice = slice_

    @cached_property
    def threads(self) -> DataFrame:
        return self.slice.threads

    @cached_property
    def processes(self) -> DataFrame:
        given = {"process_name": F.concat(F.lit(INSTANCE), F.col("start_key").cast("string")), "service_name": F.lit(""), "pe_checksum": F.lit(0).cast("bigint"), "session_id": F.lit(0).cast("bigint")}
        return self.slice.processes.withColumns(given)

    @cached_property
    def images(self) -> DataFrame:
        return self.slice.images

    @cached_property
    def disks(self) -> DataFrame:
        rows = self.slice.disk_rows
        return disk_dim(rows.filter("cls = 'disk_physical'"), rows.filter("cls = 'disk_logical'"))

    def programs(self, df: DataFrame) -> DataFrame:
        """Names are filtered when the totals are read."""
        return df


def write_registered(slice_, sink: Carry) -> None:
    context = SliceContext(slice_)
    parts = [f.build(context) for f in slice_.registered if f.stream == families.SUM]
    if parts:
        shaped = [p.select("host", "metric", F.array_sort(F.map_entries("labels")).alias("labels"), "value", "kind") for p in parts]
        sink.write(reduce(lambda a, b: a.unionByName(b), shaped), "samples", slice_.batch_id)


# Totals ---------------------------------------------------------------------------------------


def restarted(parts: DataFrame, restarts: DataFrame | None) -> DataFrame:
    """Parts of driver histograms from before the last unload of the driver left out. Both have ``batch``."""
    if restarts is None:
        return parts
    last = restarts.groupBy("host", "image_name").agg(F.max("batch").alias("_from"))
    same = [F.col(f"p.{c}") == F.col(f"r.{c}") for c in ("host", "image_name")]
    joined = parts.alias("p").join(last.alias("r"), [*same, F.col("p.metric") == DURATIONS], "left")
    return joined.filter(F.coalesce(F.col("p.batch") >= F.col("r._from"), F.lit(True))).select("p.*")


def latest_instances(seen: DataFrame) -> DataFrame:
    last = seen.groupBy("host", "start_key").agg(F.max_by(F.struct(*PROGRAM), "batch").alias("last"))
    return last.select("host", "start_key", "last.*")


def summed(read: Callable[[str], DataFrame | None], put: Callable[[DataFrame, str], None]) -> None:
    """What the batches of a sink add up to, table by table: counters, histograms and samples summed, the latest row of each instance, late rows."""
    if (deltas := read("deltas")) is not None:
        put(deltas.groupBy("host", "start_key", "metric", "dims").agg(F.sum("value").alias("value")), "deltas")
    if (histograms := read("histograms")) is not None:
        # Metrics have different bounds: buckets are summed by place and put in order again.
        labels = ["host", "cpu", "image_name", "metric"]
        parts = restarted(histograms, read("restarts")).select(*labels, "n", "total", "buckets")
        totals = parts.groupBy(*labels).agg(F.sum("n").alias("n"), F.sum("total").alias("total"))
        counts = parts.select(*labels, F.posexplode("buckets").alias("place", "bucket")).groupBy(*labels, "place").agg(F.sum("bucket").alias("bucket"))
        buckets = counts.groupBy(*labels).agg(F.sort_array(F.collect_list(F.struct("place", "bucket")))["bucket"].alias("buckets"))
        same = [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in labels]
        put(totals.alias("a").join(buckets.alias("b"), same).select("a.*", "b.buckets"), "histograms")
    if (instances := read("instances")) is not None:
        put(latest_instances(instances), "instances")
    if (late := read("late")) is not None:
        put(late.groupBy("host", "cls").agg(F.sum("rows").alias("rows")), "late")
    if (samples := read("samples")) is not None:
        put(add_samples(samples), "samples")


def add_samples(parts: DataFrame) -> DataFrame:
    """Counters and histograms summed per series; of each gauge metric the rows of its latest batch."""
    series = ["host", "metric", "labels", "kind"]
    sums = parts.filter(F.col("kind") != GAUGE).groupBy(*series).agg(F.sum("value").alias("value"))
    gauges = parts.filter(F.col("kind") == GAUGE)
    latest = gauges.groupBy(F.col("metric").alias("_of")).agg(F.max("batch").alias("_last"))
    now = gauges.join(latest, (F.col("metric") == F.col("_of")) & (F.col("batch") == F.col("_last"))).select(*series, "value")
    return sums.unionByName(now).select("host", "metric", "labels", "value", "kind")


def _label(name: str, value: Column) -> Column:
    return F.struct(F.lit(name).alias("key"), value.cast("string").alias("value"))


def _program_labels() -> list[Column]:
    return [_label(c, F.col(c)) for c in LABELS]


def _counters(deltas: DataFrame, instances: DataFrame | None) -> DataFrame:
    """Counter samples: per-instance counts under the program's labels, others under their dimensions alone."""
    dims = F.map_entries(F.from_json("dims", "map<string,string>"))
    sums = deltas.groupBy("host", "start_key", "metric", "dims").agg(F.sum("value").alias("value"))
    parts = [sums.filter("start_key IS NULL").select("host", "metric", dims.alias("labels"), "value")]
    if instances is not None:
        named = name_programs(sums.filter("start_key IS NOT NULL").select("host", "start_key", "metric", "dims", "value"), instances)
        parts.append(named.select("host", "metric", F.concat(F.array(*_program_labels()), dims).alias("labels"), "value"))
    every = reduce(lambda a, b: a.unionByName(b), parts).withColumn("labels", F.array_sort("labels"))
    total = every.groupBy("host", "metric", "labels").agg(F.sum("value").alias("value"))
    return total.select("host", "metric", "labels", F.col("value").cast("double").alias("value"), F.lit(COUNTER).alias("kind"))


def _named(samples: DataFrame, instances: DataFrame) -> DataFrame:
    """Samples per instance, which carry its start key, under the program's labels, and summed."""
    name = F.get(F.filter("labels", lambda e: e["key"] == "process_name"), F.lit(0))["value"]
    marked = samples.withColumn("_name", name)
    own = F.col("_name").startswith(INSTANCE)
    plain = marked.filter(~F.coalesce(own, F.lit(False))).drop("_name")
    keyed = marked.filter(own).withColumn("start_key", F.expr("substring(_name, 2)").cast(LongType())).drop("_name")
    rest = F.filter("labels", lambda e: ~e["key"].isin(*LABELS))
    named = name_programs(keyed, instances).withColumn("labels", F.array_sort(F.concat(F.array(*_program_labels()), rest)))
    again = named.groupBy("host", "metric", "labels", "kind").agg(F.when(F.col("kind") == GAUGE, F.max("value")).otherwise(F.sum("value")).alias("value"))
    return plain.unionByName(again.select(*plain.columns))


def totals_as_samples(spark: SparkSession, read: Callable[[str], DataFrame | None], names: Sequence[str], include_names: Sequence[str] = ()) -> DataFrame:
    """All series of a sink's tables as samples (see ``to_samples``)."""
    instances = read("instances")
    instances = None if instances is None else latest_instances(instances)
    parts = []
    if (deltas := read("deltas")) is not None:
        parts.append(_counters(deltas, instances))
    if (samples := read("samples")) is not None:
        added = add_samples(samples)
        parts.append(added if instances is None else _named(added, instances))
    if (histograms := read("histograms")) is not None:
        kept = restarted(histograms, read("restarts"))
        for metric, (labels, bounds, scale) in HISTOGRAMS.items():
            h = add_histograms(kept.filter(F.col("metric") == metric).select("host", *labels, "n", "total", "buckets"), ["host", *labels], bounds)
            each = histogram_samples(h, metric, labels, bounds, scale)
            parts.append(each.withColumn("labels", F.array_sort(F.map_entries("labels"))))
    at_end = [families.FAMILIES[n] for n in names if n in families.FAMILIES and families.FAMILIES[n].stream == families.AT_END]
    if at_end and instances is not None:
        context = Context(typed={})
        context.processes = instances
        parts += [f.build(context).withColumn("labels", F.array_sort(F.map_entries("labels"))) for f in at_end]
    if not parts:
        raise ValueError("no totals yet")
    every = reduce(lambda a, b: a.unionByName(b), [p.select("host", "metric", "labels", "value", "kind") for p in parts])
    if include_names:
        name = F.get(F.filter("labels", lambda e: e["key"] == "process_name"), F.lit(0))["value"]
        named = every.withColumn("process_name", name)
        every = named.filter("process_name IS NULL").unionByName(filter_programs(named.filter("process_name IS NOT NULL"), include_names)).drop("process_name")
    return every.withColumn("labels", F.map_from_entries("labels"))


def write_scrape(carry: Carry, sink: Carry, batch_id: int, names: Iterable[str]) -> None:
    """Add the batch to the carried totals and write the exposition text of all of them, in one folder of the batch.

    The lines are ranged in order over the files of the folder: one file while the text is small. No task has to hold all series.
    A batch reads the totals before it and its own rows, never the whole sink. A replay writes the same totals and the same file again.
    """

    def both(table: str) -> DataFrame | None:
        parts = []
        if carry.exists(f"total_{table}", batch_id - 1):
            parts.append(carry.spark.read.parquet(carry.path(f"total_{table}", batch_id - 1)).withColumn("batch", F.lit(batch_id - 1)))
        if sink.exists(table, batch_id):
            parts.append(sink.spark.read.parquet(sink.path(table, batch_id)).withColumn("batch", F.lit(batch_id)))
        return reduce(lambda a, b: a.unionByName(b), parts) if parts else None

    summed(both, lambda df, table: carry.write(df, f"total_{table}", batch_id) and None)

    def now(table: str) -> DataFrame | None:
        path = carry.path(f"total_{table}", batch_id)
        return carry.spark.read.parquet(path).withColumn("batch", F.lit(batch_id)) if carry.exists(f"total_{table}", batch_id) else None

    # The text needs them three times: for its lines, their ranges and the TYPE lines.
    samples = carry.write(totals_as_samples(carry.spark, now, list(names)), "work_samples", batch_id)
    write_exposition(samples, sink.path("exposition", batch_id))
