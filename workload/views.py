"""The driver tables read as kernel events.

The tables hold no kernel events, so each event type stands for some classes. One second of table time
stands for one microsecond; ``ts_ns`` is that in nanoseconds.
"""

from collections.abc import Iterator
from copy import copy
from functools import cached_property, reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracelake.functions.units import whole
from tracelake.operators.entities import process_intervals, thread_intervals
from tracelake.operators.materialise import materialise
from tracelake.plans import network
from tracelake.plans.families import Context, Switches
from tracelake.sources import schema
from tracelake.sources.events import wide_events

HOST = "local"
EPOCH_US = 1_704_067_200_000_000
GRACE_NS = 30_000
# 50,000 s of table time: about fifty chunks.
CHUNK_NS = 50_000_000
DAY_NS = 86_400 * 1_000
IMAGE_SPACING = 4096
#: The event types that stand for classes.
EVENT_TYPES = ("click", "view", "purchase", "signup", "error")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _time_ns() -> Column:
    micros = F.unix_micros(F.col("ts").cast("timestamp")) - F.lit(EPOCH_US)
    return (whole(micros, 1_000_000) * 1000).alias("ts_ns")


def kernel(events: DataFrame) -> DataFrame:
    measure, size = F.get_json_object("props", "$.k"), F.round(F.col("value") * 100)
    return _kernel_rows(events.select("event_id", "user_id", "event_type", _time_ns(), measure.cast("bigint").alias("k"), size.cast("bigint").alias("size")))


def _kernel_rows(events: DataFrame) -> DataFrame:
    return events.select(
        F.lit(HOST).alias("host"),
        F.col("event_id").alias("seq"),
        "ts_ns",
        (F.col("user_id") % 8).cast("int").alias("cpu"),
        F.col("user_id").alias("tid"),
        (F.col("user_id") % 40 + 4).alias("pid"),
        "event_type",
        "k",
        "size",
    )


def kernel_once(events: DataFrame) -> DataFrame:
    """The rows of ``kernel`` of all types that stand for classes, parsed once and written by type.

    A number that does not parse, or that no class of the type has, is left as it came: it costs, or fails, only the plans that look at it.
    """
    kind = F.col("event_type")
    measure, size = F.get_json_object("props", "$.k"), F.round(F.col("value") * 100)
    read = events.filter(kind.isin(*EVENT_TYPES)).select(
        "event_id", "user_id", "event_type", _time_ns(), "props", "value",
        F.when(kind != "error", measure.try_cast("bigint")).alias("k"),
        F.when(kind.isin("view", "purchase"), size.try_cast("bigint")).alias("size"),
    )
    rest = [F.when(F.col(n).isNull(), F.col(c)).alias(c) for n, c in (("k", "props"), ("size", "value"))]
    written = materialise(read.select("event_id", "user_id", "event_type", "ts_ns", "k", "size", *rest), by=["event_type"])
    numbers = [F.coalesce("k", measure.cast("bigint")).alias("k"), F.coalesce("size", size.cast("bigint")).alias("size")]
    return _kernel_rows(written.select("event_id", "user_id", "event_type", "ts_ns", *numbers))


class Trace:
    """The event classes and entities of one scale factor."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir
        self.k = kernel(self.read_events())
        # Where an operator shuffles in time chunks, chunks fit the time scale of these views.
        self.options = {"chunk_ns": CHUNK_NS}

    def read_events(self) -> DataFrame:
        return table(self.spark, self.sf_dir, "events")

    def parsed_once(self) -> "Trace":
        """The same trace over events parsed once and written by type, for queries that look at many classes many times.

        Events of types that no class has are not in it.
        """
        once = copy(self)
        once.k = kernel_once(self.read_events())
        return once

    def _of(self, event_type: str) -> DataFrame:
        return self.k.filter(F.col("event_type") == event_type)

    def table(self, name: str) -> DataFrame:
        return table(self.spark, self.sf_dir, name)

    @property
    def cswitch(self) -> DataFrame:
        return self._of("click").select(
            "host", "seq", "ts_ns", "cpu", F.col("tid").alias("new_tid"), (F.col("k") % 45).alias("old_wait_reason")
        )

    @property
    def ready(self) -> DataFrame:
        return self._of("view").select("host", "seq", "ts_ns")

    @property
    def isr(self) -> DataFrame:
        return self._of("view").select("host", "seq", "ts_ns", "cpu", F.col("ts_ns").alias("initial_ns"))

    @property
    def dpc(self) -> DataFrame:
        routine = (F.col("seq") * 7919 % 2000 + 1) * IMAGE_SPACING + F.col("seq") * 37 % 2048
        return self._of("purchase").select(
            "host", "seq", "ts_ns", "cpu", F.col("ts_ns").alias("initial_ns"), routine.alias("routine")
        )

    @property
    def disk(self) -> DataFrame:
        move = F.when(F.col("seq") % 2 == 1, F.lit("write")).otherwise(F.lit("read"))
        return self._of("purchase").select(
            "host", "seq", "ts_ns", (F.col("k") % 4).alias("disk"),
            F.when(F.col("k") % 10 == 9, F.lit("flush")).otherwise(move).alias("operation"),
            "size", F.col("tid").alias("issuing_tid"), F.col("pid").alias("header_pid"),
        )

    @property
    def network(self) -> DataFrame:
        kinds = F.array(*[F.lit(x) for x in ("send", "recv", "connect", "accept", "retransmit", "fail")])
        kind = F.get(kinds, (F.col("k") % 6).cast("int"))
        udp = (F.col("seq") % 3 == 0) & kind.isin("send", "recv", "fail")
        return self._of("view").select(
            "host", "seq", "ts_ns", "pid", "size",
            F.concat(F.when(udp, F.lit("udp_")).otherwise(F.lit("tcp_")), kind).alias("cls"),
            F.when(F.col("seq") % 4 == 1, F.lit(23)).otherwise(F.lit(2)).alias("proto"),
            (F.col("k") % 7).alias("failure_code"),
        )

    @property
    def registry(self) -> DataFrame:
        return self._of("click").select(
            "host", "seq", "ts_ns", F.col("pid").alias("header_pid"),
            (F.col("k") % 30 + 10).alias("opcode"), (F.col("k") % 5).alias("status"),
        )

    @property
    def faults(self) -> DataFrame:
        return self._of("error").select("host", "seq", "ts_ns", "tid")

    @property
    def process_starts(self) -> DataFrame:
        return self._of("signup").select(
            "host", "seq", "ts_ns", (F.col("seq") + 2).alias("start_key"), "pid",  # 1 is the unknown process
            F.concat(F.lit("app"), (F.col("tid") % 7).cast("string"), F.lit(".exe")).alias("process_name"),
            (F.col("tid") % 3).alias("session_id"),
            (F.col("tid") * 2654435761 % 4294967296).alias("pe_checksum"),
        )

    @property
    def process_ends(self) -> DataFrame:
        return self._of("error").select("host", "seq", "ts_ns", "pid")

    @property
    def thread_starts(self) -> DataFrame:
        return self._of("signup").select("host", "seq", "ts_ns", "tid", "pid", (F.col("k") % 30).alias("sub_process_tag"))

    @property
    def thread_ends(self) -> DataFrame:
        return self._of("error").select("host", "seq", "ts_ns", "tid")

    def process_plan(self) -> DataFrame:
        return process_intervals(self.process_starts, self.process_ends, GRACE_NS, CHUNK_NS)

    def thread_plan(self) -> DataFrame:
        return thread_intervals(self.thread_starts, self.thread_ends, self.processes, GRACE_NS, chunk_ns=CHUNK_NS)

    @cached_property
    def processes(self) -> DataFrame:
        return materialise(self.process_plan())

    @cached_property
    def threads(self) -> DataFrame:
        return materialise(self.thread_plan())

    @property
    def image_loads(self) -> DataFrame:
        return self._of("signup").select(
            "host", "seq", "ts_ns", "pid", ((F.col("k") + 1) * IMAGE_SPACING).alias("base"), (F.col("k") * 16 + 512).alias("size"),
            F.when(F.col("k") % 3 == 0, F.concat(F.lit("C:\\bin\\a"), F.col("k").cast("string"), F.lit(".EXE")))
            .otherwise(F.concat(F.lit("d"), F.col("k").cast("string"), F.lit(".sys"))).alias("file_name"),
            (F.col("tid") % 5).alias("pe_checksum"),
        )

    @property
    def image_unloads(self) -> DataFrame:
        return self._of("error").select("host", "seq", "ts_ns", ((F.col("k") + 1) * IMAGE_SPACING).alias("base"))

    @property
    def part_images(self) -> DataFrame:
        """Images from parts: loaded at time 0; every tenth unloads half-way."""
        unload = F.when(F.col("p_partkey") % 10 == 0, F.lit(15 * DAY_NS))
        return self.table("part").select(
            F.lit(HOST).alias("host"), ((F.col("p_partkey") + 1) * IMAGE_SPACING).alias("base"),
            (F.col("p_size") * 64 + 512).cast("bigint").alias("size"), F.col("p_partkey").alias("seq"),
            F.col("p_name").alias("image_name"), unload.alias("unload_ns"), F.lit(0).cast("bigint").alias("valid_from"),
            F.coalesce(unload, F.lit((1 << 63) - 1)).alias("valid_to"),
        )

    @property
    def item_addresses(self) -> DataFrame:
        return self.table("lineitem").select(
            F.lit(HOST).alias("host"), F.lit(1).cast("bigint").alias("ts_ns"),
            ((F.col("l_partkey") + 1) * IMAGE_SPACING + F.col("l_orderkey") * 37 % IMAGE_SPACING).alias("address"),
        )

    @property
    def scrapes(self) -> DataFrame:
        """One scrape at the end of each day that has events."""
        day = (whole(F.col("ts_ns"), DAY_NS) + 1) * DAY_NS
        return self.k.select("host", day.alias("ts_ns")).distinct()

    @property
    def service_config(self) -> DataFrame:
        return self.table("nation").select(
            F.lit(HOST).alias("host"), F.col("n_nationkey").alias("seq"),
            F.col("n_nationkey").cast("bigint").alias("tag"), F.col("n_name").alias("service_name"),
        )

    @property
    def running_snapshot(self) -> DataFrame:
        nation = self.table("nation").select(F.col("n_nationkey").alias("s_nationkey"), F.col("n_name").alias("service_name"))
        return self.table("supplier").join(nation, "s_nationkey").select(
            F.lit(HOST).alias("host"), F.col("s_suppkey").alias("seq"), (F.col("s_suppkey") % 40 + 4).alias("pid"), "service_name"
        )

    @property
    def physical_disks(self) -> DataFrame:
        return self.table("region").select(
            F.lit(HOST).alias("host"), F.col("r_regionkey").alias("seq"),
            F.col("r_regionkey").cast("bigint").alias("disk"), F.col("r_name").alias("manufacturer"),
        )

    @property
    def logical_disks(self) -> DataFrame:
        return self.table("nation").select(
            F.lit(HOST).alias("host"), F.col("n_nationkey").alias("seq"),
            F.col("n_regionkey").cast("bigint").alias("disk"),
            F.concat(F.substring("n_name", 1, 1), F.lit(":")).alias("drive_letter"),
            F.when(F.col("n_nationkey") % 4 != 0, F.lit("NTFS")).alias("file_system"),
        )

    def context(self, **switches: object) -> Context:
        """All classes as a family context."""
        moves = self.disk.drop("operation")
        typed = {
            "process_start": self.process_starts, "process_end": self.process_ends,
            "thread_start": self.thread_starts, "thread_end": self.thread_ends,
            "cswitch": self.cswitch, "ready_thread": self.ready, "isr": self.isr, "dpc": self.dpc,
            "hard_fault": self.faults, "registry_op": self.registry,
            "disk_physical": self.physical_disks, "disk_logical": self.logical_disks,
            **{f"disk_{op}": self.disk.filter(F.col("operation") == op).select(moves.columns) for op in ("read", "write", "flush")},
            **{c: self.network.filter(F.col("cls") == c) for c in network.CLASSES},
        }
        mixed = {
            ("disk_read", "disk_write", "disk_flush"): self.disk.withColumn("cls", F.concat(F.lit("disk_"), "operation")).drop("operation"),
            network.CLASSES: self.network,
        }
        return Context(typed=typed, mixed=mixed, switches=Switches(**switches), grace_ns=GRACE_NS, chunk_ns=CHUNK_NS)

    @property
    def disk_payloads(self) -> DataFrame:
        """Disk transfers as binary payloads; every 97th is cut short."""

        def little_endian(value: Column, width: int) -> Column:
            digits = F.lpad(F.hex(value), 2 * width, "0")
            return F.concat(*[F.substring(digits, 2 * i + 1, 2) for i in reversed(range(width))])

        d = self._of("purchase")
        full = F.concat(
            little_endian(d["k"] % 4, 4), F.lit("00" * 4), little_endian(d["size"], 4), F.lit("00" * 36), little_endian(d["tid"], 4)
        )
        text = F.when(F.col("seq") % 97 == 0, F.substring(full, 1, 40)).otherwise(full)
        return d.select(
            "host", "seq", F.col("ts_ns"), "cpu", F.col("pid").alias("header_pid"),
            F.lit("{3D6FA8D4-FE05-11D0-9DDA-00C04FD7BA7C}").alias("provider"),
            F.when(F.col("seq") % 2 == 1, F.lit(11)).otherwise(F.lit(10)).alias("opcode"), F.unhex(text).alias("payload"),
        )

    @property
    def routed(self) -> DataFrame:
        """Every event under a provider and event id that depend on its type and measure."""
        ids = {
            "click": (schema.SYSTEM_SCHEDULER, F.lit(36)), "view": (schema.TCP_IP, F.col("k") % 20 + 10),
            "purchase": (schema.DISK_IO, F.col("k") % 5 + 10), "signup": (schema.KERNEL_PROCESS, F.col("k") % 8),
            "error": (schema.REGISTRY, F.col("k") % 30 + 10),
        }
        provider, opcode = F.lit(None).cast("string"), F.lit(None).cast("bigint")
        for event_type, (guid, number) in ids.items():
            provider = F.when(F.col("event_type") == event_type, F.lit(guid)).otherwise(provider)
            opcode = F.when(F.col("event_type") == event_type, number).otherwise(opcode)
        return self.k.select("host", "seq", "ts_ns", provider.alias("provider"), opcode.cast("int").alias("opcode"))


class StreamTrace(Trace):
    """The same classes over the events read as a stream."""

    def read_events(self) -> DataFrame:
        schema_ = table(self.spark, self.sf_dir, "events").schema
        return self.spark.readStream.schema(schema_).parquet(f"{self.sf_dir}/events*.parquet")

    def wide(self, classes: list[str]) -> DataFrame:
        typed = self.context().typed
        parts = [wide_events(typed[c].withColumn("cls", F.lit(c))) for c in classes]
        return reduce(lambda a, b: a.unionByName(b), parts)


def in_slices(rows: DataFrame, folder: str, slices: int, jitter_ns: int = 0) -> Iterator[DataFrame]:
    """``WIDE_EVENTS`` rows written slice by slice in time order; yields after each the stream of all that is there.

    A slice is a folder that is written in parallel. The caller runs its query over the stream to the end of what is there before it asks for the next slice, so
    every slice is a restart from the checkpoint. Rows may come in a slice too late by up to ``jitter_ns``.
    """
    spark = rows.sparkSession
    timed = materialise(rows.withColumn("ts", F.timestamp_micros(whole(F.col("ts_ns"), 1000))))
    first, last = timed.agg(F.min("ts_ns"), F.max("ts_ns")).first()
    late = F.pmod(F.xxhash64("seq", "cls"), F.lit(jitter_ns + 1))
    place = F.least(whole((F.col("ts_ns") + late - F.lit(first)) * slices, last - first + 1), F.lit(slices - 1))
    for i in range(slices):
        timed.filter(place == i).write.parquet(f"{folder}/s{i}")
        yield spark.readStream.schema(schema.WIDE_EVENTS).parquet(f"{folder}/s*")


def typed_rows(typed: dict[str, DataFrame], classes: list[str]) -> DataFrame:
    """Rows of some classes in the columns of ``WIDE_EVENTS``; those without a time stand at the beginning."""
    parts = [wide_events(typed[c].withColumn("cls", F.lit(c))) for c in classes]
    return reduce(DataFrame.unionByName, parts).withColumn("ts_ns", F.coalesce("ts_ns", F.lit(0).cast("bigint")))
