"""Cut lineage where a small table feeds many plans."""

import tempfile
import uuid
from collections.abc import Iterator, Sequence
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

# Tables by application, in the order written.
_written: dict[str, list[str]] = {}


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The session's checkpoint folder. One is made up only for a local session that has none."""
    context = spark.sparkContext
    current = context.getCheckpointDir()
    if current:
        return current
    configured = context.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if configured is None:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder all executors share")
        configured = tempfile.mkdtemp(prefix="tracelake-")
    context.setCheckpointDir(configured)
    return configured


def materialise(df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Compute ``df`` once into a table in the checkpoint folder; later plans read that, pruned to their columns.

    Entity tables and aggregates are far smaller than the facts, but deriving one takes several shuffles, and
    each as-of join refers to its epochs more than once. The table survives the loss of executors, and
    its size is known to the planner. ``by`` names columns of few values that later plans select by: they then read only the files
    of the values they want.
    """
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark)}/tracelake/{uuid.uuid4().hex}"
    (df.write.partitionBy(*by) if by else df.write).parquet(path)
    _written.setdefault(spark.sparkContext.applicationId, []).append(path)
    return spark.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> int:
    """Delete the tables this application has materialised so far, once nothing reads them any more; returns how many."""
    return _delete(spark, 0)


@contextmanager
def temporary_tables(spark: SparkSession) -> Iterator[None]:
    """Deletes, at its end, the tables materialised inside it. Results must have been read or written by then."""
    before = len(_written.get(spark.sparkContext.applicationId, ()))
    try:
        yield
    finally:
        _delete(spark, before)


def _delete(spark: SparkSession, keep: int) -> int:
    paths = _written.get(spark.sparkContext.applicationId, [])
    count = 0
    while len(paths) > keep:
        location = spark._jvm.org.apache.hadoop.fs.Path(paths.pop())
        system = location.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
        count += bool(system.delete(location, True))
    return count
