"""Session settings the plans rely on."""

from pyspark.sql import SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    # Many small shuffle partitions to start from; AQE merges them up to the advisory size.
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "128m",
    "spark.sql.files.maxPartitionBytes": "256m",
    # One event row is narrow, so a chunk of a busy key has many: keep them in memory before falling back to the sorter.
    "spark.sql.windowExec.buffer.in.memory.threshold": "65536",
}


def tuned(builder: SparkSession.Builder, shuffle_partitions: int, checkpoint_dir: str | None = None) -> SparkSession.Builder:
    """Apply the settings. ``shuffle_partitions``: a few times the cores; ``checkpoint_dir``: a folder all executors share."""
    for key, value in SETTINGS.items():
        builder = builder.config(key, value)
    builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    return builder if checkpoint_dir is None else builder.config("spark.checkpoint.dir", checkpoint_dir)
