"""Dimension tables from configuration events and snapshots. In each, the last row wins."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def disk_dim(physical: DataFrame, logical: DataFrame) -> DataFrame:
    """One row per (host, disk): manufacturer, drive_letter, file_system.

    ``physical``: host, seq, disk, manufacturer. ``logical``: host, seq, disk, drive_letter, file_system. Missing
    text reads "Unknown" (drive letter: empty). Columns of a kind never reported for a disk are null.
    """
    whole = physical.groupBy("host", "disk").agg(
        F.max_by(F.coalesce("manufacturer", F.lit("Unknown")), "seq").alias("manufacturer")
    )
    parts = logical.groupBy("host", "disk").agg(
        F.max_by(
            F.struct(
                F.coalesce("drive_letter", F.lit("")).alias("drive_letter"),
                F.coalesce("file_system", F.lit("Unknown")).alias("file_system"),
            ),
            "seq",
        ).alias("last")
    )
    return whole.join(parts, ["host", "disk"], "full_outer").select(
        "host", "disk", "manufacturer", "last.drive_letter", "last.file_system"
    )


def service_dim(service_config: DataFrame) -> DataFrame:
    """One row per (host, tag). ``service_config``: host, seq, tag, service_name. Tag 0 and empty names are ignored."""
    usable = service_config.filter((F.col("tag") > 0) & (F.col("service_name") != ""))
    return usable.groupBy("host", "tag").agg(F.max_by("service_name", "seq").alias("service_name"))


def running_services(snapshot: DataFrame) -> DataFrame:
    """One row per (host, pid). ``snapshot``: host, seq, pid, service_name. Pid 0 is ignored."""
    running = snapshot.filter(F.col("pid") != 0)
    return running.groupBy("host", "pid").agg(F.max_by("service_name", "seq").alias("service_name"))
