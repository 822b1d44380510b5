"""Disk family: per-disk totals, per-program I/O, disk information."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracelake.functions.names import DISK_OPS
from tracelake.operators.attribute import attribute_disk, known_only
from tracelake.plans.rollup import rollup_programs


#: What the totals and the series per program read of an event.
COLUMNS = ("host", "ts_ns", "disk", "operation", "size", "header_pid", "issuing_tid")


def disk_totals(events: DataFrame) -> DataFrame:
    """Per (host, disk): counts and bytes by direction. ``events``: host, disk, operation, size."""
    read, written = F.col("operation") == "read", F.col("operation") == "write"
    return events.groupBy("host", "disk").agg(
        *[F.count_if(F.col("operation") == op).alias(op) for op in DISK_OPS],
        F.coalesce(F.sum(F.when(read, F.col("size"))), F.lit(0)).alias("read_bytes"),
        F.coalesce(F.sum(F.when(written, F.col("size"))), F.lit(0)).alias("written_bytes"),
    )


def disk_operations(events: DataFrame) -> DataFrame:
    """Operations per (host, disk, operation); a disk once seen has all three, zeros included."""
    return operations_of(disk_totals(events))


def operations_of(totals: DataFrame) -> DataFrame:
    each = F.inline(F.array(*[F.struct(F.lit(op).alias("operation"), F.col(op).alias("value")) for op in DISK_OPS]))
    return totals.select("host", "disk", each)


def disk_by_program(
    events: DataFrame, threads: DataFrame, processes: DataFrame, level: str = "program", **options
) -> DataFrame:
    """Reads and writes per (host, program, disk, operation): operations and bytes. Flushes are not attributed."""
    columns = ["host", "ts_ns", "disk", "operation", "size", "header_pid"]
    columns += [c for c in ("issuing_tid",) if c in events.columns]
    moved = events.filter(F.col("operation") != "flush").select(*columns)
    attributed = known_only(attribute_disk(moved, threads, processes, **options))
    return rollup_programs(
        attributed, processes, ["disk", "operation"], {"operations": F.count(F.lit(1)), "bytes": F.sum("size")}, level
    )


def with_disk_info(samples: DataFrame, disks: DataFrame) -> DataFrame:
    """Attach manufacturer, drive letter and file system to rows with host and disk.

    A host has a handful of disks, but a fleet has many hosts: no broadcast hint, the planner decides by size.
    """
    return samples.join(disks, ["host", "disk"], "left")
