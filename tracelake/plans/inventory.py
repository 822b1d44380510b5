"""Process, disk and health series: information gauges, provider counts, interval diagnostics."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracelake.functions.text import base_name, hex_label
from tracelake.functions.units import NS_PER_S, whole
from tracelake.operators.entities import PROGRAM, with_unknown_process

# Provider names of the received-events series, in report order.
PROVIDERS = (
    "microsoft-windows-kernel-disk", "microsoft-windows-kernel-process", "thread-kernel",
    "microsoft-windows-kernel-file", "perfinfo-kernel", "system-config-kernel", "image-kernel",
    "pagefault-kernel", "microsoft-windows-kernel-network", "microsoft-windows-kernel-registry",
    "microsoft-windows-kernel-eventtracing",
)


def process_info(processes: DataFrame) -> DataFrame:
    """One row with value 1 per distinct program of each host, the unknown process included."""
    named = with_unknown_process(processes).select("host", *PROGRAM).distinct()
    return named.withColumn("pe_checksum", hex_label(F.col("pe_checksum"))).withColumn("value", F.lit(1))


def disk_physical_info(disks: DataFrame) -> DataFrame:
    physical = disks.filter(F.col("manufacturer").isNotNull())
    return physical.select("host", "disk", "manufacturer", F.lit(1).alias("value"))


def disk_logical_info(disks: DataFrame) -> DataFrame:
    logical = disks.filter(F.col("file_system").isNotNull())
    return logical.select("host", "disk", "drive_letter", "file_system", F.lit(1).alias("value"))


def events_received(raw: DataFrame) -> DataFrame:
    """Events per (host, provider); every provider of the fixed list is present, with 0 if silent."""
    per_host = raw.groupBy("host").agg(*[F.count_if(F.col("provider") == p).alias(f"p{i}") for i, p in enumerate(PROVIDERS)])
    each = [F.struct(F.lit(p).alias("provider"), F.col(f"p{i}").alias("value")) for i, p in enumerate(PROVIDERS)]
    return per_host.select("host", F.inline(F.array(*each)))


def interval_diagnostics(
    processes: DataFrame, threads: DataFrame, every_ns: int = 60 * NS_PER_S, keep_ns: int | None = 3600 * NS_PER_S
) -> DataFrame:
    """Per (host, interval): new processes, new threads with a known owner, services named, and the new processes.

    The list holds ``pid-basename`` once per pid (its latest name), sorted. Only intervals that
    begin within ``keep_ns`` of the host's latest event stay; None keeps all.
    """
    interval = whole(F.col("create_ns"), every_ns).alias("interval")
    per_pid = processes.groupBy("host", interval, "pid").agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(F.col("service_name") != "").alias("named"),
        F.max_by("process_name", F.struct("create_ns", "seq")).alias("name"),
    )
    label = F.concat_ws("-", F.col("pid").cast("string"), base_name(F.col("name")))
    started = per_pid.groupBy("host", "interval").agg(
        F.sum("n").alias("new_processes"),
        F.sum("named").alias("services_enriched"),
        F.array_join(F.sort_array(F.collect_list(label)), ",").alias("processes"),
    )
    attached = threads.filter("owner_known").groupBy("host", interval).agg(F.count(F.lit(1)).alias("new_threads"))
    zero = F.lit(0).cast("bigint")
    both = started.join(attached, ["host", "interval"], "full_outer").select(
        "host",
        "interval",
        F.coalesce("new_processes", zero).alias("new_processes"),
        F.coalesce("new_threads", zero).alias("new_threads"),
        F.coalesce("services_enriched", zero).alias("services_enriched"),
        F.coalesce("processes", F.lit("")).alias("processes"),
    )
    if keep_ns is None:
        return both
    latest = both.groupBy("host").agg(F.max("interval").alias("_latest"))
    recent = (F.col("_latest") - F.col("interval")) * F.lit(every_ns) < F.lit(keep_ns)
    return both.join(latest, "host").filter(recent).drop("_latest")


def cleaned_processes(cleaned: DataFrame) -> DataFrame:
    """Per (host, scrape): how many instances were cleaned, and the sorted ``start_key-pid-basename`` list.

    ``cleaned``: instances with ``cleaned_scrape`` (see ``cleaned_at``); those not cleaned yet are left out.
    """
    label = F.concat_ws(
        "-", F.col("start_key").cast("string"), F.col("pid").cast("string"), base_name(F.col("process_name"))
    )
    gone = cleaned.filter(F.col("cleaned_scrape").isNotNull())
    return gone.groupBy("host", "cleaned_scrape").agg(
        F.count(F.lit(1)).alias("cleaned"), F.array_join(F.sort_array(F.collect_list(label)), ",").alias("processes")
    )
