"""Tables carried from one micro-batch to the next.

Batch N reads the tables of batch N-1 and writes its own, so a replayed batch overwrites its own output and
reads the same input: nothing is counted twice.
"""

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

KEEP_BATCHES = 2


class Carry:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def path(self, table: str, batch: int) -> str:
        return f"{self.root}/{table}/batch={batch}"

    def exists(self, table: str, batch: int) -> bool:
        return self._file_system(self.path(table, batch))[0]

    def has(self, table: str) -> bool:
        """Has any batch written the table?"""
        return self._file_system(f"{self.root}/{table}")[0]

    def read(self, table: str, batch: int, schema: StructType) -> DataFrame:
        """The table as batch ``batch`` left it; empty before the first batch."""
        path = self.path(table, batch)
        if batch < 0 or not self.exists(table, batch):
            return empty_table(self.spark, schema)
        return self.spark.read.schema(schema).parquet(path)

    def write(self, df: DataFrame, table: str, batch: int) -> DataFrame:
        """Write and read back: what follows no longer depends on how the table came about."""
        path = self.path(table, batch)
        df.write.mode("overwrite").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def forget(self, tables: Sequence[str], batch: int) -> None:
        """Remove tables no replay can ask for any more."""
        old = batch - KEEP_BATCHES
        for table in tables:
            found, system, path = self._file_system(self.path(table, old)) if old >= 0 else (False, None, None)
            if found:
                system.delete(path, True)

    def _file_system(self, path: str):
        jvm = self.spark._jvm
        location = jvm.org.apache.hadoop.fs.Path(path)
        system = location.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf())
        return system.exists(location), system, location


def empty_table(spark: SparkSession, schema: StructType) -> DataFrame:
    """No rows, and known to the planner to be none: joins and unions with it cost nothing."""
    return spark.range(0).filter(F.lit(False)).select(*[F.lit(None).cast(f.dataType).alias(f.name) for f in schema.fields])


def latest_batch(spark: SparkSession, root: str) -> int:
    """The last batch whose clock was written, -1 if none."""
    carry = Carry(spark, root)
    found, system, path = carry._file_system(f"{carry.root}/clock")
    if not found:
        return -1
    names = [s.getPath().getName() for s in system.listStatus(path)]
    done = [int(n.split("=")[1]) for n in names if n.startswith("batch=")]
    return max((b for b in done if carry._file_system(f"{carry.path('clock', b)}/_SUCCESS")[0]), default=-1)
