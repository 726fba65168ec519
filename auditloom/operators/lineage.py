"""Cutting the lineage of frames that steps in turn build on, and tasks whose number grows with the rows."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_own: list[str] = []
# Fixed value: rows that a task sorts.
TASK_ROWS = 300_000


def shared_folder(spark: SparkSession) -> str:
    """The session's spark.checkpoint.dir. Where it is unset, a local master (tests) gets a temporary folder; a cluster has to name one."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    if not _own:
        _own.append(tempfile.mkdtemp(prefix="auditloom-"))
    return "file://" + _own[0]


class Levels:
    """Steps of an iteration, each written once as Parquet to the shared folder, so that a lost executor costs a re-read.

    add writes a step and tells whether it has rows (of a condition), without another job; last and every read the last
    step and all so far; drop deletes them.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.base, self.count, self.schema = spark, f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}", 0, None

    def add(self, df: DataFrame, condition: str = "true") -> bool:
        from pyspark.sql import Observation

        rows = Observation()
        self.schema = df.schema
        df.observe(rows, F.count_if(F.expr(condition)).alias("n")).write.parquet(f"{self.base}/step={self.count}")
        self.count += 1
        return rows.get["n"] > 0

    def _read(self, *steps: int) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(*[f"{self.base}/step={k}" for k in steps])

    def last(self) -> DataFrame:
        return self._read(self.count - 1)

    def every(self) -> DataFrame:
        return self._read(*range(self.count))

    def drop(self, keep_last: bool = False) -> None:
        """Deletes the steps, or those before the last."""
        for k in range(self.count - keep_last):
            at = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.base}/step={k}")  # noqa: SLF001
            at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)  # noqa: SLF001


def cut(df: DataFrame) -> DataFrame:
    """The rows of df, computed once and written to the shared folder, so that a lost executor costs a re-read."""
    written = Levels(df.sparkSession, "cut")
    written.add(df)
    return written.last()


def tasks_for(table: DataFrame, rows: int | None = None) -> int:
    """A task for each so many rows (TASK_ROWS) of a stored table, the session's shuffle partitions at least; 1 where one task holds all. The count of a Parquet table reads its footers alone."""
    tasks = -(-table.count() // (rows or TASK_ROWS))
    return max(tasks, int(table.sparkSession.conf.get("spark.sql.shuffle.partitions"))) if tasks > 1 else 1


def dealt(df: DataFrame, tasks: int, *keys: str) -> DataFrame:
    """df dealt out by keys in so many tasks; what is dealt out by them anyway keeps these tasks. Without a number, adaptive execution
    would put tasks together by their compressed bytes, and a task would get several times the rows. One task is left to the session."""
    return df.repartition(tasks, *keys) if tasks > 1 else df
