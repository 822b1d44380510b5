"""Continuous metric families: the batch operators over ``carry + micro-batch``.

Each micro-batch advances the watermark of every host it has rows of (its latest event time minus ``delay_ns``). Rows up to their
host's watermark form a slice in time order; later rows wait in the carry, and rows older than the previous watermark of their host are set aside
as late. A host whose clock runs ahead thus makes no other host late, and the last rows of a host that falls silent wait for ``drain``. A slice
is attributed with the entity intervals known so far, so the totals over all slices equal one batch run over the same
rows. The carry holds what later slices can still need: waiting rows, live entities, the last switch and the open call per
CPU, and interrupts without a partner that are younger than one hour.
"""

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field
from functools import cached_property, reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import LongType, StringType, StructField, StructType

from tracelake.functions.units import NS_PER_S, micros
from tracelake.operators import entities
from tracelake.operators.asof import OPEN_END
from tracelake.operators.carry import CHUNK_NS
from tracelake.operators.histogram import LATENCY_BOUNDS_US, histogram
from tracelake.operators.pairing import MAX_PAIR_NS, finalised_dpcs, pair_isr_dpc
from tracelake.operators.scrapes import IDLE_LIMIT_NS
from tracelake.plans import disk, interrupts, memory, network, registry_ops, threads
from tracelake.plans import families as registered
from tracelake.plans.network import CLASSES as NETWORK_CLASSES
from tracelake.sources.dimensions import service_dim
from tracelake.sources.schema import WIDE_EVENTS
from tracelake.streaming import exposing, scraping
from tracelake.streaming.state import Carry, empty_table, latest_batch

FAMILIES = ("disk_io", "threads", "interrupts", "network", "memory", "registry")

_CLOCK = StructType([StructField("host", StringType()), StructField("watermark_ns", LongType())])
_KNOWN = [StructField(n, LongType()) for n in ("known_next_ns", "known_end_ns", "known_start_key", "last_seen_ns")]
_ENTITY = StructType([*WIDE_EVENTS.fields, *_KNOWN, StructField("weight", LongType())])
# Columns that start rows may leave open.
_DEFAULTS = {"session_id": 0, "service_name": "", "pe_checksum": 0}
# Families that attribute events to processes.
_ATTRIBUTED = {"disk_io", "threads", "network", "memory", "registry"}
_TABLES = (
    "clock", "pending", "entities", "cpu", "work_arrived", "work_clock", "work_instances", "work_threads", "work_processes", "work_images",
    "work_calls", "work_ordered", "work_pairs", "work_network", "work_registry", *scraping.TABLES, *exposing.TABLES,
)


@dataclass(frozen=True)
class StreamOptions:
    families: Sequence[str] = FAMILIES
    delay_ns: int = 30 * NS_PER_S
    grace_ns: int = entities.GRACE_NS
    # A call may last this long between its initial time and its own event.
    call_limit_ns: int = NS_PER_S
    idle_limit_ns: int = IDLE_LIMIT_NS
    max_isr_age_ms: int | None = None
    # Call durations by driver; with ``prune_unloaded`` a series starts again when an image of its name is unloaded.
    per_driver: bool = False
    prune_unloaded: bool = False
    chunk_ns: int = CHUNK_NS
    # Follow scrapes: clean-up by generations, counters that fall.
    scrapes: scraping.ScrapeOptions | None = None
    # Write the exposition text of all totals with every batch.
    exposition: bool = False
    # What registered families compute beyond their core.
    switches: registered.Switches = field(default_factory=registered.Switches)


def run_stream(
    events: DataFrame, checkpoint: str, out: str, options: StreamOptions = StreamOptions(), trigger: dict | None = None
) -> StreamingQuery:
    """Start the families over a stream of ``WIDE_EVENTS`` rows: those of ``FAMILIES``, and any that is registered in ``plans.families``.

    ``out`` gets ``deltas``, ``histograms``, ``instances`` and ``late``, one folder per batch; ``checkpoint`` holds Spark's
    own checkpoint and the carry. Read results with ``stream_samples``, or one by one with ``stream_counters`` and ``stream_histograms``. Registered
    families add ``samples``, ``prune_unloaded`` adds ``restarts``, scrapes add ``scrapes``, ``generations``, ``cleaned`` and ``steps``.
    """
    unknown = set(options.families) - set(FAMILIES) - set(registered.FAMILIES)
    if unknown:
        raise KeyError(f"unknown families {sorted(unknown)}")

    def each(batch: DataFrame, batch_id: int) -> None:
        process_slice(batch, batch_id, f"{checkpoint}/carry", out, options)

    writer = events.writeStream.foreachBatch(each).option("checkpointLocation", f"{checkpoint}/spark")
    return writer.trigger(**(trigger or {"availableNow": True})).start()


def drain(spark: SparkSession, checkpoint: str, out: str, options: StreamOptions = StreamOptions()) -> None:
    """Process what still waits for the watermark, once the stream has ended for good."""
    root = f"{checkpoint}/carry"
    process_slice(empty_table(spark, WIDE_EVENTS), latest_batch(spark, root) + 1, root, out, options, final=True)


def process_slice(
    batch: DataFrame, batch_id: int, carry_root: str, out: str, options: StreamOptions, final: bool = False
) -> None:
    spark = batch.sparkSession
    carry, sink = Carry(spark, carry_root), Carry(spark, out)
    previous = batch_id - 1
    reached = carry.read("clock", previous, _CLOCK)
    marked = _marked(batch.select(*[f.name for f in WIDE_EVENTS.fields]), reached)
    arrived = carry.read("pending", previous, WIDE_EVENTS).unionByName(marked.filter(F.col("ts_ns") > F.col("_mark")).drop("_mark"))
    arrived = carry.write(arrived, "work_arrived", batch_id)
    # Nothing is under way any more from a host that has been silent for the idle limit.
    reach = F.when(F.col("cls") == "idle", F.col("ts_ns")).otherwise(F.col("ts_ns") - F.lit(options.delay_ns))
    seen = arrived.groupBy("host").agg(F.max(reach).alias("watermark_ns"))
    clock = seen.unionByName(reached).groupBy("host").agg(F.lit(OPEN_END) if final else F.max("watermark_ns")).toDF(*_CLOCK.names)
    clock = carry.write(clock, "work_clock", batch_id)
    late = marked.filter(F.col("ts_ns") <= F.col("_mark")).groupBy("host", "cls").agg(F.count(F.lit(1)).alias("rows"))
    sink.write(late, "late", batch_id)
    timed = _marked(arrived, clock)
    carry.write(timed.filter(F.col("ts_ns") > F.col("_mark")).drop("_mark"), "pending", batch_id)
    current = Slice(carry, batch_id, timed.filter(F.col("ts_ns") <= F.col("_mark")).drop("_mark"), clock, reached, options, final)
    _write_results(current, sink, batch_id)
    if options.scrapes is not None:
        scraping.Scraping(current, options.scrapes).write(sink)
    if options.exposition:
        exposing.write_scrape(carry, sink, batch_id, options.families)
    current.write_carry()
    carry.write(clock, "clock", batch_id)
    carry.forget(_TABLES, batch_id)


def _marked(rows: DataFrame, clock: DataFrame) -> DataFrame:
    """Add ``_mark``, the watermark of the row's host; a host without one is at the beginning of time.

    The clock has one short row per host. The rows stay where they are: dealt by host, all rows of a busy one would be one task's.
    """
    of = clock.select(F.col("host").alias("_of"), F.col("watermark_ns").alias("_at"))
    joined = rows.join(F.broadcast(of), F.col("host").eqNullSafe(F.col("_of")), "left")
    return joined.select(*rows.columns, F.coalesce("_at", F.lit(-OPEN_END)).alias("_mark"))


class Slice:
    """Rows of one watermark step of every host, with the carried state before it."""

    def __init__(self, carry: Carry, batch_id: int, rows: DataFrame, clock: DataFrame, reached: DataFrame, options: StreamOptions, final: bool):
        self.carry, self.batch_id, self.rows, self.clock, self.reached = carry, batch_id, rows, clock, reached
        self.options, self.final = options, final
        self.registered = [registered.FAMILIES[f] for f in options.families if f not in FAMILIES]
        self.needs = {c for f in self.registered for c in f.needs}
        self.before = carry.read("entities", batch_id - 1, _ENTITY)
        self.cpu_before = carry.read("cpu", batch_id - 1, WIDE_EVENTS)
        self._known()

    def of(self, *classes: str) -> DataFrame:
        return self.rows.filter(F.col("cls").isin(*classes))

    def marked(self, rows: DataFrame) -> DataFrame:
        """Rows with ``_mark``, the watermark their host has reached."""
        return _marked(rows, self.clock)

    def marked_before(self, rows: DataFrame) -> DataFrame:
        """Rows with ``_mark``, the watermark before this slice."""
        return _marked(rows, self.reached)

    def _with_carried(self, cls: str) -> DataFrame:
        return self.before.filter(F.col("cls") == cls).unionByName(self.of(cls), allowMissingColumns=True)

    def on_cpu(self, *classes: str) -> DataFrame:
        carried = self.cpu_before.filter(F.col("cls").isin(*classes))
        return carried.unionByName(self.of(*classes))

    def _known(self) -> None:
        """Entity tables as of the watermark, written once: the carry of this batch and the base of its joins."""
        o = self.options
        if self.has_entities:
            starts = self._with_carried("process_start").select(
                *[c for c in _ENTITY.names if c not in _DEFAULTS],
                *[F.coalesce(c, F.lit(default)).alias(c) for c, default in _DEFAULTS.items()],
            )
            plan = entities.process_intervals(starts, self.of("process_end"), o.grace_ns, o.chunk_ns)
            instances = self.carry.write(plan, "work_instances", self.batch_id)
            plan = entities.thread_intervals(
                self._with_carried("thread_start"), self.of("thread_end"), instances, o.grace_ns, chunk_ns=o.chunk_ns
            )
            self.threads = self.carry.write(plan, "work_threads", self.batch_id)
            enriched = entities.enrich_programs(instances, self.of("image_load"), o.chunk_ns)
            self.service_rows = self._with_carried("service_config")
            services = service_dim(self.service_rows)
            enriched = entities.resolve_services(enriched, self.threads, services)
            # A snapshot of running services names whoever owned the pid when it was taken, also if the service is made known later.
            self.running = _last_of(self._with_carried("running_service").filter("pid <> 0"), ["host", "pid"], [f.name for f in WIDE_EVENTS.fields])
            enriched = entities.enrich_running(enriched, self.running, services, at_ns="ts_ns")
            self.processes = self.carry.write(enriched, "work_processes", self.batch_id)
        if self.has_images:
            plan = entities.image_references(self._with_carried("image_load"), self.of("image_unload"), o.chunk_ns)
            self.references = self.carry.write(plan, "work_images", self.batch_id)
            self.images = entities.load_epochs(self.references, o.chunk_ns)

    @property
    def has_entities(self) -> bool:
        return bool(_ATTRIBUTED & set(self.options.families)) or "process_start" in self.needs

    @property
    def has_images(self) -> bool:
        return (self.options.per_driver and "interrupts" in self.options.families) or "image_load" in self.needs

    @property
    def has_disks(self) -> bool:
        return bool({"disk_physical", "disk_logical"} & self.needs)

    @cached_property
    def disk_rows(self) -> DataFrame:
        """The last configuration row of each disk and class, so far."""
        rows = self._with_carried("disk_physical").unionByName(self._with_carried("disk_logical"))
        return _last_of(rows, ["host", "cls", "disk"], [f.name for f in WIDE_EVENTS.fields], order=("seq",))

    def write_carry(self) -> None:
        parts = (self._entity_carry() if self.has_entities else []) + (self._image_carry() if self.has_images else [])
        parts += [self.disk_rows] if self.has_disks else []
        if parts:
            self.carry.write(_union(_ENTITY, *parts), "entities", self.batch_id)
        parts = self._cpu_carry()
        if parts:
            self.carry.write(_union(WIDE_EVENTS, *parts), "cpu", self.batch_id)

    def _entity_carry(self) -> list[DataFrame]:
        mark = F.col("_mark")
        # An entity that was cut but never ended goes after the idle limit.
        abandoned = F.col("valid_to") <= _back(mark, self.options.idle_limit_ns)
        needed = (F.greatest("valid_to", "expires_ns") > mark) & ~abandoned
        known_next = F.when(F.col("next_ns") < OPEN_END, F.col("next_ns")).alias("known_next_ns")
        known_end = F.col("end_ns").alias("known_end_ns")
        starts = _marked(self.processes, self.clock).filter(needed).select(
            "host", "seq", F.col("create_ns").alias("ts_ns"), F.lit("process_start").alias("cls"), "start_key", "pid",
            "parent_pid", "session_id", "process_name", "service_name", "pe_checksum", "last_seen_ns", known_next, known_end,
        )
        tids = _marked(self.threads, self.clock).filter(F.col("valid_to") > mark).select(
            "host", "seq", F.col("create_ns").alias("ts_ns"), F.lit("thread_start").alias("cls"), "pid", "tid",
            "sub_process_tag", known_next, known_end, F.col("start_key").alias("known_start_key"),
        )
        named = self.service_rows.filter((F.col("tag") > 0) & (F.col("service_name") != ""))
        tags = named.groupBy("host", "tag").agg(F.max("seq").alias("seq"), F.max_by("service_name", "seq").alias("service_name"))
        return [starts, tids, tags.withColumn("cls", F.lit("service_config")), self.running]

    def _image_carry(self) -> list[DataFrame]:
        refs = self.references.groupBy("host", "base").agg(F.max_by("refs", F.struct("ts_ns", "seq")).alias("weight"))
        live = self.images.filter(F.col("unload_ns").isNull()).join(refs, ["host", "base"])
        return [live.select(
            "host", "seq", F.col("valid_from").alias("ts_ns"), F.lit("image_load").alias("cls"), "base", "size",
            F.col("image_name").alias("file_name"), "weight",
        )]

    def _cpu_carry(self) -> list[DataFrame]:
        wide = [f.name for f in WIDE_EVENTS.fields]
        parts = []
        if {"threads", "interrupts"} & set(self.options.families):
            # The last row per CPU: the previous switch of the next gap, or the call still open.
            parts.append(_last_on_cpu(self.on_cpu("cswitch"), wide))
        if "interrupts" in self.options.families:
            parts.append(self.open_calls())
            parts += [self.waiting(), self.unpaired()]
        return parts

    def open_calls(self) -> DataFrame:
        last = _last_on_cpu(self.on_cpu("dpc", "cswitch"), [f.name for f in WIDE_EVENTS.fields])
        return last.filter(F.col("cls") == "dpc")

    @cached_property
    def finalised(self) -> DataFrame:
        """Calls that ended in this slice."""
        ended = finalised_dpcs(self.on_cpu("dpc"), self.on_cpu("cswitch"), self.options.chunk_ns)
        return self.carry.write(ended, "work_calls", self.batch_id)

    @cached_property
    def ordered(self) -> DataFrame:
        """Interrupts and finalised calls with ``ready``: nothing still to come can precede them on their CPU."""
        columns = ["host", "cpu", "seq", "ts_ns", "initial_ns", "cls"]
        done = self.finalised.withColumn("cls", F.lit("finalised_dpc")).select(*columns)
        waiting = self.cpu_before.filter(F.col("cls") == "finalised_dpc").select(*columns)
        rows = waiting.unionByName(done).unionByName(self.on_cpu("isr").select(*columns))
        if self.final:
            return self.carry.write(rows.withColumn("ready", F.lit(True)), "work_ordered", self.batch_id)
        open_ = self.open_calls().select("host", "cpu", F.col("initial_ns").alias("_open"))
        frontier = F.least(_back(F.col("_mark"), self.options.call_limit_ns), F.coalesce("_open", F.lit(OPEN_END)))
        # One open call per CPU at most.
        marked = _marked(rows.join(F.broadcast(open_), ["host", "cpu"], "left"), self.clock)
        marked = marked.withColumn("ready", F.col("initial_ns") < frontier).drop("_open", "_mark")
        return self.carry.write(marked, "work_ordered", self.batch_id)

    @cached_property
    def pairs(self) -> DataFrame:
        ready = self.ordered.filter("ready")
        found = pair_isr_dpc(
            ready.filter("cls = 'isr'"), ready.filter("cls = 'finalised_dpc'"), None, self.options.chunk_ns
        )
        return self.carry.write(found, "work_pairs", self.batch_id)

    def waiting(self) -> DataFrame:
        return self.ordered.filter(~F.col("ready")).drop("ready")

    def unpaired(self) -> DataFrame:
        young = F.col("initial_ns") > _back(F.col("_mark"), MAX_PAIR_NS + self.options.call_limit_ns)
        isrs = _marked(self.ordered.filter(F.col("ready") & (F.col("cls") == "isr")), self.clock)
        kept = isrs.filter(young).drop("ready", "_mark")
        paired = self.pairs.select("host", "cpu", F.col("isr_seq").alias("seq"))
        return kept.join(paired, ["host", "cpu", "seq"], "left_anti")


def _back(time_ns: Column, by_ns: int) -> Column:
    return F.greatest(time_ns, F.lit(by_ns - OPEN_END)) - F.lit(by_ns)


def _last_of(rows: DataFrame, keys: Sequence[str], columns: Sequence[str], order: Sequence[str] = ("ts_ns", "seq")) -> DataFrame:
    last = rows.groupBy(*keys).agg(F.max_by(F.struct(*columns), F.struct(*order)).alias("last"))
    return last.select("last.*")


def _last_on_cpu(rows: DataFrame, columns: Sequence[str]) -> DataFrame:
    return _last_of(rows, ["host", "cpu"], columns)


def _union(schema: StructType, *parts: DataFrame) -> DataFrame:
    shaped = [
        p.select(*[
            (F.col(f.name) if f.name in p.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema.fields
        ])
        for p in parts
    ]
    return reduce(lambda a, b: a.unionByName(b), shaped)


# Results --------------------------------------------------------------------------------------

DELTAS = StructType([
    StructField("host", StringType()), StructField("start_key", LongType()), StructField("metric", StringType()),
    StructField("dims", StringType()), StructField("value", LongType()),
])


def _delta(df: DataFrame, metric: str, value: str, *dims: str, zeros: bool = False) -> DataFrame:
    """Counter increments; dimensions as a JSON text, which groups and sorts. ``zeros``: an increment of 0 makes the series known."""
    names = F.to_json(F.struct(*[F.col(d).cast("string").alias(d) for d in dims])) if dims else F.lit("{}")
    owner: Column = F.col("start_key") if "start_key" in df.columns else F.lit(None).cast("bigint")
    return df.select(
        "host",
        owner.alias("start_key"),
        F.lit(metric).alias("metric"),
        names.alias("dims"),
        F.col(value).cast("bigint").alias("value"),
    ).filter(F.col("value") >= (0 if zeros else 1))


def _disk(s: Slice, how: dict) -> list[DataFrame]:
    events = s.of("disk_read", "disk_write", "disk_flush").withColumn("operation", F.substring("cls", 6, 5))
    totals = disk.disk_totals(events)
    moved = disk.disk_by_program(events, s.threads, s.processes, level="instance", **how)
    return [
        _delta(disk.operations_of(totals), "disk_io_operations_total", "value", "disk", "operation", zeros=True),
        _delta(totals, "disk_read_bytes_total", "read_bytes", "disk", zeros=True),
        _delta(totals, "disk_written_bytes_total", "written_bytes", "disk", zeros=True),
        _delta(moved, "disk_process_io_operations_total", "operations", "disk", "operation"),
        _delta(moved.filter("operation = 'read'"), "disk_process_read_bytes_total", "bytes", "disk"),
        _delta(moved.filter("operation = 'write'"), "disk_process_written_bytes_total", "bytes", "disk"),
    ]


def _threads(s: Slice, how: dict) -> list[DataFrame]:
    switches = s.of("cswitch")
    states = threads.thread_states(switches, s.of("ready_thread"), s.of("thread_start"), s.of("thread_end"))
    return [
        _delta(threads.cswitch_per_cpu(switches), "thread_context_switches_cpu_total", "value", "cpu"),
        _delta(states, "thread_states_total", "value", "state", "wait_reason"),
        _delta(
            threads.cswitch_by_program(switches, s.threads, s.processes, level="instance", **how),
            "thread_context_switches_process_total", "value",
        ),
    ]


def _interrupts(s: Slice, how: dict) -> list[DataFrame]:
    one = F.count(F.lit(1)).alias("value")
    queued, executed = s.of("isr"), s.finalised
    return [
        _delta(queued.groupBy("host").agg(one), "perfinfo_dpc_queued_total", "value"),
        _delta(executed.groupBy("host").agg(one), "perfinfo_dpc_executed_total", "value"),
        _delta(queued.groupBy("host", "cpu").agg(one), "perfinfo_dpc_queued_cpu_total", "value", "cpu"),
        _delta(executed.groupBy("host", "cpu").agg(one), "perfinfo_dpc_executed_cpu_total", "value", "cpu"),
    ]


def _network(s: Slice, how: dict) -> list[DataFrame]:
    events = s.of(*NETWORK_CLASSES)
    moved = s.carry.write(network.network_bytes(events, s.processes, level="instance", **how), "work_network", s.batch_id)
    totals = moved.groupBy("host", "protocol").agg(*[F.sum(c).alias(c) for c in ("sent_bytes", "received_bytes")])
    made = network.connections(events, s.processes, level="instance", **how)
    failed = network.connections_failed(events, s.processes, level="instance", **how)
    again = network.retransmissions(events, s.processes, level="instance", **how)
    return [
        _delta(totals, "network_sent_bytes_total", "sent_bytes", "protocol"),
        _delta(totals, "network_received_bytes_total", "received_bytes", "protocol"),
        _delta(moved, "network_process_sent_bytes_total", "sent_bytes", "protocol"),
        _delta(moved, "network_process_received_bytes_total", "received_bytes", "protocol"),
        _delta(made, "network_process_connections_attempted_total", "attempted", "protocol"),
        _delta(made, "network_process_connections_accepted_total", "accepted", "protocol"),
        _delta(failed, "network_connections_failed_total", "value", "protocol", "address_family", "failure_code"),
        _delta(again, "network_process_retransmissions_total", "value"),
    ]


def _memory(s: Slice, how: dict) -> list[DataFrame]:
    faults = s.of("hard_fault")
    by_program = memory.hard_faults_by_program(faults, s.threads, s.processes, level="instance", **how)
    return [
        _delta(memory.hard_faults(faults), "memory_hard_pagefaults_total", "value"),
        _delta(by_program, "memory_hard_pagefaults_per_process_total", "value"),
    ]


def _registry(s: Slice, how: dict) -> list[DataFrame]:
    by_program = registry_ops.registry_by_program(s.of("registry_op"), s.processes, level="instance", **how)
    by_program = s.carry.write(by_program, "work_registry", s.batch_id)
    totals = by_program.groupBy("host", "operation", "result").agg(F.sum("value").alias("value"))
    return [
        _delta(totals, "registry_operations_total", "value", "operation", "result"),
        _delta(by_program, "registry_operations_process_total", "value", "operation", "result"),
    ]


_BUILD: dict[str, Callable[[Slice, dict], list[DataFrame]]] = {
    "disk_io": _disk, "threads": _threads, "interrupts": _interrupts, "network": _network, "memory": _memory,
    "registry": _registry,
}


def _write_results(s: Slice, sink: Carry, batch_id: int) -> None:
    how = {"chunk_ns": s.options.chunk_ns}
    deltas = [d for f in s.options.families if f in _BUILD for d in _BUILD[f](s, how)]
    if deltas:
        sink.write(reduce(lambda a, b: a.unionByName(b), deltas), "deltas", batch_id)
    parts = []
    if "threads" in s.options.families:
        gaps = threads.cswitch_intervals(s.on_cpu("cswitch"), chunk_ns=s.options.chunk_ns)
        parts.append(_labelled(gaps, "thread_context_switch_interval_milliseconds"))
    if "interrupts" in s.options.families:
        latency = micros(F.col("latency_ns"))
        pairs = s.pairs
        if s.options.max_isr_age_ms is not None:
            pairs = pairs.filter(F.col("latency_ns") <= s.options.max_isr_age_ms * 1_000_000)
        h = histogram(pairs, latency, ["host"], LATENCY_BOUNDS_US)
        parts.append(_labelled(h, "perfinfo_isr_to_dpc_latency_microseconds"))
    if s.options.per_driver and "interrupts" in s.options.families:
        durations = s.finalised.withColumn("duration_us", micros(F.col("duration_ns")))
        h = interrupts.dpc_duration_by_image(durations, s.images, prune_unloaded=s.options.prune_unloaded, chunk_ns=s.options.chunk_ns)
        parts.append(_labelled(h, exposing.DURATIONS))
        if s.options.prune_unloaded:
            # Of what the earlier batches counted for these drivers nothing remains.
            sink.write(s.images.filter(F.col("unload_ns").isNotNull()).select("host", "image_name").distinct(), "restarts", batch_id)
    if parts:
        sink.write(reduce(lambda a, b: a.unionByName(b), parts), "histograms", batch_id)
    if s.has_entities:
        sink.write(s.processes.select("host", "start_key", *entities.PROGRAM), "instances", batch_id)
    if s.registered:
        exposing.write_registered(s, sink)


def _labelled(h: DataFrame, metric: str) -> DataFrame:
    """Histograms of all metrics in one table."""
    kinds = {"cpu": "int", "image_name": "string"}
    labels = [(F.col(c) if c in h.columns else F.lit(None)).cast(kind).alias(c) for c, kind in kinds.items()]
    return h.select("host", *labels, F.lit(metric).alias("metric"), "n", "total", "buckets")
