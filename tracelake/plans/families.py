"""Metric families over one context, and the registry that users extend.

A family names the event classes it needs and builds samples from a context. Classes, entity tables and dimensions
come into being when a family asks for them, so a family that is off costs nothing: its classes are not
read, and without a family that attributes events no process table is built.
"""

from collections.abc import Callable, Iterable, Mapping, Sequence
from dataclasses import dataclass, field
from functools import cached_property, reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracelake.functions.names import FIRST_REGISTRY_OPCODE, REGISTRY_OPS
from tracelake.operators import entities
from tracelake.operators.carry import CHUNK_NS, short_keys
from tracelake.operators.histogram import DURATION_BOUNDS_US, GAP_BOUNDS_MS, LATENCY_BOUNDS_US
from tracelake.operators.materialise import materialise
from tracelake.operators.pairing import finalised_dpcs
from tracelake.plans import disk, interrupts, inventory, memory, network, registry_ops, threads
from tracelake.plans.rollup import LABELS, drop_zero
from tracelake.sources import dimensions
from tracelake.sources.events import decode_events
from tracelake.sources.samples import GAUGE, histogram_samples, to_samples
from tracelake.sources.schema import LAYOUTS


@dataclass(frozen=True)
class Switches:
    """What the families compute beyond their core."""

    per_process: bool = True
    per_cpu: bool = False
    per_driver: bool = False
    by_protocol: bool = False
    connection_stats: bool = False
    retransmissions: bool = False
    prune_unloaded: bool = True
    max_isr_age_ms: int | None = None
    include_names: Sequence[str] = ()


@dataclass
class Context:
    """Events by class, with the entity tables and dimensions derived from them.

    ``typed`` maps class names to DataFrames of typed rows, ``mixed`` several names to one DataFrame with ``cls``, which is then
    scanned once for all of them; ``wide`` holds typed rows of any classes (``WIDE_EVENTS``); classes in none are decoded from ``raw``.
    """

    raw: DataFrame | None = None
    wide: DataFrame | None = None
    typed: Mapping[str, DataFrame] = field(default_factory=dict)
    switches: Switches = field(default_factory=Switches)
    mixed: Mapping[tuple[str, ...], DataFrame] = field(default_factory=dict)
    grace_ns: int = entities.GRACE_NS
    chunk_ns: int = CHUNK_NS

    def events(self, *classes: str) -> DataFrame:
        """Rows of the classes, with ``cls``; one scan of the raw events for all classes not given as typed tables."""
        given, rest = [], list(classes)
        for names, df in self.mixed.items():
            if picked := [c for c in rest if c in names]:
                given.append(df.filter(F.col("cls").isin(*picked)))
                rest = [c for c in rest if c not in names]
        given += [self.typed[c].withColumn("cls", F.lit(c)) for c in rest if c in self.typed]
        rest = [c for c in rest if c not in self.typed]
        if self.wide is not None and rest:
            given.append(self.wide.filter(F.col("cls").isin(*rest)))
            rest = []
        unknown = [c for c in rest if c not in LAYOUTS or self.raw is None]
        if unknown:
            raise KeyError(f"no source for {', '.join(unknown)}")
        parts = given + ([decode_events(self.raw, *rest)] if rest else [])
        return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)

    def has(self, cls: str) -> bool:
        return cls in self.typed or any(cls in names for names in self.mixed) or self.wide is not None or (self.raw is not None and cls in LAYOUTS)

    @property
    def options(self) -> dict:
        return {"chunk_ns": self.chunk_ns}

    @cached_property
    def _instances(self) -> DataFrame:
        plan = entities.process_intervals(
            self.events("process_start"), self.events("process_end"), self.grace_ns, self.chunk_ns
        )
        return materialise(plan)

    @cached_property
    def threads(self) -> DataFrame:
        starts, ends = self.events("thread_start"), self.events("thread_end")
        plan = entities.thread_intervals(
            starts, ends, self._instances, self.grace_ns, chunk_ns=self.chunk_ns,
            short_tids=short_keys(["host", "tid"], starts.select("host", "tid"), ends.select("host", "tid")),
        )
        return materialise(plan)

    @cached_property
    def processes(self) -> DataFrame:
        """Instances with what image loads, thread tags and the running services tell about them."""
        plan = self._instances
        if self.has("image_load"):
            plan = entities.enrich_programs(plan, self.events("image_load"), self.chunk_ns)
        if self.has("service_config"):
            plan = entities.resolve_services(plan, self.threads, self.services)
            if "running_service" in self.typed:
                running = dimensions.running_services(self.typed["running_service"])
                plan = entities.enrich_running(plan, running, self.services)
        return plan if plan is self._instances else materialise(plan)

    @cached_property
    def images(self) -> DataFrame:
        return materialise(entities.image_intervals(self.events("image_load"), self.events("image_unload"), self.chunk_ns))

    @cached_property
    def services(self) -> DataFrame:
        return dimensions.service_dim(self.events("service_config"))

    @cached_property
    def disks(self) -> DataFrame:
        return dimensions.disk_dim(self.events("disk_physical"), self.events("disk_logical"))

    @cached_property
    def disk_events(self) -> DataFrame:
        moves = self.events("disk_read", "disk_write", "disk_flush")
        return moves.withColumn("operation", F.substring("cls", 6, 5))

    def programs(self, df: DataFrame) -> DataFrame:
        """Apply the program name filter to a per-program result."""
        return entities.filter_programs(df, self.switches.include_names)


#: How a family's samples of several slices of a stream come together.
SUM, AT_END = "sum", "at_end"


@dataclass(frozen=True)
class Family:
    name: str
    needs: tuple[str, ...]
    build: Callable[[Context], DataFrame]
    default: bool
    stream: str = SUM


FAMILIES: dict[str, Family] = {}


def register_family(
    name: str, needs: Iterable[str], build: Callable[[Context], DataFrame], default: bool = False, stream: str = SUM
) -> None:
    """Add a family, for batches and streams. ``build(context)`` returns samples (see ``to_samples``); ``needs`` lists the classes it reads.

    On a stream ``build`` gets the rows of one slice, with the entities known by then, and ``stream`` says what its samples of several slices make: ``SUM`` adds
    up counters and histograms and keeps the latest gauges; with ``AT_END`` it is built from all instances when the totals are read.
    What looks from one row to the next (gaps, pairs) sees the rows of a slice only.
    """
    if stream not in (SUM, AT_END):
        raise ValueError(f"unknown way to run on a stream: {stream!r}")
    FAMILIES[name] = Family(name, tuple(needs), build, default, stream)


def samples(context: Context, families: Sequence[str] | None = None) -> DataFrame:
    """Samples of the families (default: those on by default), as one DataFrame."""
    names = [f.name for f in FAMILIES.values() if f.default] if families is None else list(families)
    if not names:
        raise ValueError("no family enabled")
    for name in names:
        if name not in FAMILIES:
            raise KeyError(f"unknown family {name!r}")
        missing = [c for c in FAMILIES[name].needs if not context.has(c)]
        if missing:
            raise KeyError(f"family {name!r} needs {', '.join(missing)}")
    return _all([FAMILIES[n].build(context) for n in names])


def required_classes(families: Sequence[str]) -> set[str]:
    """The classes to read for some families."""
    return {c for n in families for c in FAMILIES[n].needs}


def _all(parts: Sequence[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), parts)


_LIFECYCLE = ("process_start", "process_end")
_THREADS = (*_LIFECYCLE, "thread_start", "thread_end")


def _disk(c: Context) -> DataFrame:
    # The attribution looks at the events many times over; they are decoded once.
    events = c.disk_events
    if c.switches.per_process:
        events = materialise(events.select(*[x for x in disk.COLUMNS if x in events.columns]))
    # One pass over the facts per aggregate; the series below read its few rows.
    totals = materialise(disk.disk_totals(events))
    parts = [
        to_samples(disk.operations_of(totals), "disk_io_operations_total", ["disk", "operation"], "value"),
        to_samples(totals, "disk_read_bytes_total", ["disk"], "read_bytes"),
        to_samples(totals, "disk_written_bytes_total", ["disk"], "written_bytes"),
    ]
    if c.switches.per_process:
        moved = materialise(c.programs(disk.disk_by_program(events, c.threads, c.processes, **c.options)))
        labels = [*LABELS, "disk"]
        parts.append(to_samples(moved, "disk_process_io_operations_total", [*labels, "operation"], "operations"))
        for operation, metric in (("read", "disk_process_read_bytes_total"), ("write", "disk_process_written_bytes_total")):
            one_way = drop_zero(moved.filter(F.col("operation") == operation), "bytes")
            parts.append(to_samples(one_way, metric, labels, "bytes"))
    return _all(parts)


def _system(c: Context) -> DataFrame:
    return _all([
        to_samples(inventory.disk_physical_info(c.disks), "system_disk_physical_info", ["disk", "manufacturer"], "value", GAUGE),
        to_samples(
            inventory.disk_logical_info(c.disks), "system_disk_logical_info", ["disk", "drive_letter", "file_system"], "value", GAUGE
        ),
    ])


def _threads(c: Context) -> DataFrame:
    switches = c.events("cswitch")
    states = threads.thread_states(switches, c.events("ready_thread"), c.events("thread_start"), c.events("thread_end"))
    parts = [
        to_samples(threads.cswitch_per_cpu(switches), "thread_context_switches_cpu_total", ["cpu"], "value"),
        histogram_samples(
            threads.cswitch_intervals(switches, chunk_ns=c.chunk_ns),
            "thread_context_switch_interval_milliseconds", ["cpu"], GAP_BOUNDS_MS, scale=1e6,
        ),
        to_samples(states, "thread_states_total", ["state", "wait_reason"], "value"),
    ]
    if c.switches.per_process:
        by_program = c.programs(threads.cswitch_by_program(switches, c.threads, c.processes, **c.options))
        parts.append(to_samples(by_program, "thread_context_switches_process_total", LABELS, "value"))
    return _all(parts)


def _interrupts(c: Context) -> DataFrame:
    isr, dpc, switches = c.events("isr"), c.events("dpc"), c.events("cswitch")
    # The switches are read once, for the ends of the calls.
    finalised = materialise(finalised_dpcs(dpc, switches, c.chunk_ns))
    per_cpu = materialise(interrupts.dpc_counts(isr, dpc, switches, per_cpu=True, finalised=finalised))
    counts = per_cpu.groupBy("host").agg(F.sum("queued").alias("queued"), F.sum("executed").alias("executed"))
    latency = interrupts.isr_dpc_latency(isr, dpc, switches, c.switches.max_isr_age_ms, c.chunk_ns, finalised)
    parts = [
        to_samples(counts, "perfinfo_dpc_queued_total", [], "queued"),
        to_samples(counts, "perfinfo_dpc_executed_total", [], "executed"),
        histogram_samples(latency, "perfinfo_isr_to_dpc_latency_microseconds", [], LATENCY_BOUNDS_US),
    ]
    if c.switches.per_cpu:
        parts.append(to_samples(per_cpu, "perfinfo_dpc_queued_cpu_total", ["cpu"], "queued"))
        parts.append(to_samples(per_cpu, "perfinfo_dpc_executed_cpu_total", ["cpu"], "executed"))
    if c.switches.per_driver:
        durations = interrupts.dpc_durations(dpc, switches, finalised=finalised)
        by_image = interrupts.dpc_duration_by_image(durations, c.images, c.switches.prune_unloaded, dpc, **c.options)
        parts.append(
            histogram_samples(by_image, "perfinfo_dpc_execution_time_microseconds", ["image_name"], DURATION_BOUNDS_US)
        )
    return _all(parts)


def _network(c: Context) -> DataFrame:
    events, s = c.events(*network.CLASSES), c.switches
    known = None
    if s.connection_stats or s.retransmissions:
        # Several series: events are decoded once, and their owners are looked up once.
        events = materialise(network.narrow(events))
        known = materialise(network.known_traffic(events, c.processes, **c.options))
    all_moved = materialise(network.network_bytes(events, c.processes, known=known, **c.options))
    moved = c.programs(all_moved)
    by_protocol = [*LABELS, "protocol"]
    parts = [
        to_samples(drop_zero(moved, "sent_bytes"), "network_process_sent_bytes_total", by_protocol, "sent_bytes"),
        to_samples(drop_zero(moved, "received_bytes"), "network_process_received_bytes_total", by_protocol, "received_bytes"),
    ]
    if s.by_protocol:
        totals = all_moved.groupBy("host", "protocol").agg(
            F.sum("sent_bytes").alias("sent_bytes"), F.sum("received_bytes").alias("received_bytes")
        )
        parts.append(to_samples(drop_zero(totals, "sent_bytes"), "network_sent_bytes_total", ["protocol"], "sent_bytes"))
        parts.append(
            to_samples(drop_zero(totals, "received_bytes"), "network_received_bytes_total", ["protocol"], "received_bytes")
        )
    if s.connection_stats:
        made = materialise(c.programs(network.connections(events, c.processes, known=known, **c.options)))
        failed = c.programs(network.connections_failed(events, c.processes, **c.options))
        parts += [
            to_samples(drop_zero(made, "attempted"), "network_process_connections_attempted_total", by_protocol, "attempted"),
            to_samples(drop_zero(made, "accepted"), "network_process_connections_accepted_total", by_protocol, "accepted"),
            to_samples(failed, "network_connections_failed_total", [*by_protocol, "address_family", "failure_code"], "value"),
        ]
    if s.retransmissions:
        again = c.programs(network.retransmissions(events, c.processes, known=known, **c.options))
        parts.append(to_samples(again, "network_process_retransmissions_total", LABELS, "value"))
    return _all(parts)


def _memory(c: Context) -> DataFrame:
    # Faults whose payload is too short still count in the total.
    all_faults = c.typed.get("hard_fault")
    if all_faults is None:
        all_faults = c.events("hard_fault") if c.raw is None else c.raw.filter(F.col("cls") == "hard_fault")
    parts = [to_samples(memory.hard_faults(all_faults), "memory_hard_pagefaults_total", [], "value")]
    if c.switches.per_process:
        by_program = c.programs(memory.hard_faults_by_program(c.events("hard_fault"), c.threads, c.processes, **c.options))
        parts.append(to_samples(by_program, "memory_hard_pagefaults_per_process_total", LABELS, "value"))
    return _all(parts)


def _registry(c: Context) -> DataFrame:
    last = FIRST_REGISTRY_OPCODE + len(REGISTRY_OPS) - 1
    events = c.events("registry_op").filter(F.col("opcode").between(FIRST_REGISTRY_OPCODE, last))
    if not c.switches.per_process:
        totals = registry_ops.registry_totals(events, c.processes, **c.options)
        return to_samples(totals, "registry_operations_total", ["operation", "result"], "value")
    by_program = materialise(registry_ops.registry_by_program(events, c.processes, **c.options))
    totals = by_program.groupBy("host", "operation", "result").agg(F.sum("value").alias("value"))
    return _all([
        to_samples(totals, "registry_operations_total", ["operation", "result"], "value"),
        to_samples(
            c.programs(by_program), "registry_operations_process_total", [*LABELS, "operation", "result"], "value"
        ),
    ])


def _process(c: Context) -> DataFrame:
    return to_samples(c.programs(inventory.process_info(c.processes)), "process_info", LABELS, "value", GAUGE)


def _health(c: Context) -> DataFrame:
    received = c.raw if c.raw is not None else c.wide
    if received is None:
        raise KeyError("family 'health' needs the events as one table")
    return to_samples(inventory.events_received(received), "handler_events_received_total", ["provider"], "value")


register_family("disk_io", (*_THREADS, "disk_read", "disk_write", "disk_flush"), _disk, default=True)
register_family("system", ("disk_physical", "disk_logical"), _system)
register_family("threads", (*_THREADS, "cswitch", "ready_thread"), _threads)
register_family("interrupts", ("isr", "dpc", "cswitch"), _interrupts)
register_family("network", (*_LIFECYCLE, *network.CLASSES), _network)
register_family("memory", (*_THREADS, "hard_fault"), _memory, default=True)
register_family("registry", (*_LIFECYCLE, "registry_op"), _registry)
register_family("process", _LIFECYCLE, _process, default=True, stream=AT_END)
register_family("health", (), _health)
