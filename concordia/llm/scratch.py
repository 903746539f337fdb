"""Tables between the steps of an operator, in the folder that all executors share."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark import SparkContext
from pyspark.sql import DataFrame, SparkSession


def shared_root(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir.

    Only where neither the setting nor a checkpoint folder exists and Spark runs in this
    process alone (local runs and tests) a folder of this machine is made and set.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise ValueError(f"set spark.checkpoint.dir to a folder that all executors of {master} share")
        root = "file://" + tempfile.mkdtemp(prefix="concordia-checkpoint-")
        spark.sparkContext.setCheckpointDir(root)
    return root.rstrip("/")


#: Rows that pass to Python at once.  They hold whole texts, so the usual 10,000 are too many.
BATCH_ROWS = 500


def small_batches(spark: SparkSession) -> None:
    """Bound what a Python worker and its executor hold of one batch."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


#: Rows of the input to a task that writes, see Scratch.expect.
TASK_ROWS = 5_000
#: Whether partitions stay as many as there are cores, whatever their size.
JOIN_FIRST = "spark.sql.adaptive.coalescePartitions.parallelismFirst"


class Scratch:
    """Written tables that cut lineage: a lost executor costs a read, not a recomputation.

    Results may be read as long as the driver runs; when it ends, the folder goes.
    """

    def __init__(self, spark: SparkSession, label: str):
        self.spark = spark
        self.path = f"{shared_root(spark)}/concordia-{label}-{uuid.uuid4().hex}"
        self.names: set[str] = set()
        #: Tables are written in so many tasks at most, if set.
        self.tasks: int | None = None
        atexit.register(self._remove)

    def expect(self, rows: int) -> None:
        """Write further tables in tasks of about TASK_ROWS of so many rows, but two a core at least.

        Each file of a local folder costs several processes (for modes of it, its checksum and
        folders) that the executor's JVM forks, so a small table should not be a file a partition.
        """
        self.tasks = max(2 * self.spark.sparkContext.defaultParallelism, rows // TASK_ROWS)

    def keep(self, df: DataFrame, name: str, spread: bool = True, join: bool = True) -> DataFrame:
        """Write df as Parquet and return the written table.

        Unless ``spread``, shuffled partitions are joined up to the advisory size, so that a
        small table is few tasks and files; else they are as many as there are cores.  Unless
        ``join`` is false, what is left of them is joined further where expect() was called.
        """
        if join and self.tasks:
            df = df.coalesce(self.tasks)
        at = f"{self.path}/{name}"
        was = self.spark.conf.get(JOIN_FIRST)
        try:
            self.spark.conf.set(JOIN_FIRST, str(spread).lower())
            df.write.mode("overwrite").parquet(at)
        finally:
            self.spark.conf.set(JOIN_FIRST, was)
        self.names.add(name)
        return self.spark.read.schema(df.schema).parquet(at)

    def finish(self, df: DataFrame) -> DataFrame:
        """Write the result and remove all other tables."""
        out = self.keep(df, "result")
        self.drop(*(self.names - {"result"}))
        return out

    def drop(self, *names: str) -> None:
        """Remove tables that no later step reads."""
        for name in names:
            _delete(f"{self.path}/{name}")
            self.names.discard(name)

    def _remove(self) -> None:
        if SparkContext._active_spark_context is not None:
            _delete(self.path)


def _delete(path: str) -> None:
    context = SparkContext._active_spark_context
    at = context._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(context._jsc.hadoopConfiguration()).delete(at, True)
