"""Streaming forms that need no entity state: plain watermarked aggregations.

System-wide counters (``disk_totals``, ``cswitch_per_cpu``, ``hard_faults``, ``events_received``, ...) are group-bys
and accept a streaming DataFrame as they are, in update or complete mode.
"""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracelake.functions.text import base_name

WATERMARK = "30 seconds"


def distinct_starts(starts: DataFrame, delay: str = WATERMARK) -> DataFrame:
    """Process starts without the repeats of periodic snapshots. State is kept for the watermark delay only;
    repeats that come later reach ``merge_snapshots``, where they only refresh the last sighting."""
    return starts.withWatermark("ts", delay).dropDuplicatesWithinWatermark(["host", "start_key"])


def interval_counts(lifecycle: DataFrame, every: str = "1 minute", delay: str = WATERMARK) -> DataFrame:
    """Per (host, interval): new processes, new threads, and the sorted ``pid-basename`` list of new processes.

    ``lifecycle``: host, ts, cls, pid, process_name.
    """
    started = F.col("cls") == "process_start"
    label = F.when(started, F.concat_ws("-", F.col("pid").cast("string"), base_name(F.col("process_name"))))
    windows = lifecycle.withWatermark("ts", delay).groupBy("host", F.window("ts", every))
    return windows.agg(
        F.count_if(started).alias("new_processes"),
        F.count_if(F.col("cls") == "thread_start").alias("new_threads"),
        F.array_join(F.sort_array(F.collect_set(label)), ",").alias("processes"),
    ).select("host", F.col("window.start").alias("interval_start"), "new_processes", "new_threads", "processes")
