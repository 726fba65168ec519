"""Incremental arrival: a monitor of new filings, windowed rates, expiring values."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def _exists(spark: SparkSession, path: str) -> bool:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)  # noqa: SLF001
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)  # noqa: SLF001


def process_batch(batch: DataFrame, batch_id: int, process: Callable[[DataFrame], DataFrame], done_path: str, failed_path: str, key: str = "filing_id") -> None:
    """Processes the filings of a batch and those that failed in earlier ones, but for those that are done.

    Both tables have a folder for each batch, which a repeated batch replaces, and a batch looks at earlier folders
    alone. So a batch that is repeated after a failure halfway leaves the same tables as one that ran once.
    """
    spark = batch.sparkSession
    earlier = lambda path: spark.read.parquet(path).filter(F.col("batch") < batch_id)
    new = batch
    if _exists(spark, failed_path):
        again = earlier(failed_path).join(batch.select(key), key, "left_anti")  # what arrives anew counts before what failed
        new = new.unionByName(again.select(*batch.columns).dropDuplicates([key]))
    new = new.dropDuplicates([key])
    if _exists(spark, done_path):
        new = new.join(earlier(done_path).select(key), key, "left_anti")
    own = f"{done_path}/batch={batch_id}"
    process(new).write.mode("overwrite").parquet(own)
    new.join(spark.read.parquet(own).select(key), key, "left_anti").write.mode("overwrite").parquet(f"{failed_path}/batch={batch_id}")


def monitor(arrivals: DataFrame, process: Callable[[DataFrame], DataFrame], done_path: str, checkpoint: str, key: str = "filing_id", available_now: bool = True) -> StreamingQuery:
    """Processes each new filing until it succeeds, and then no more.

    process gets the filings of a trigger that are not done yet, with those that failed before, and returns those that
    succeeded, with their key. These are written to done_path and the others to a folder of the same name that ends in
    _failed, from where each later batch takes them again. See process_batch.
    """

    def each(batch: DataFrame, batch_id: int) -> None:
        process_batch(batch, batch_id, process, done_path, done_path.rstrip("/") + "_failed", key)

    writer = arrivals.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="60 seconds")).start()


def read_arrivals(spark: SparkSession, path: str, schema: str, files_per_trigger: int = 1000) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def windowed_counts(events: DataFrame, ts: str, by: list[str], width: str = "5 minutes", late: str = "1 hour") -> DataFrame:
    """Counts by tumbling window with a watermark; runs on a stream or a table. Times without a zone count as the session's."""
    events = events.withColumn(ts, F.col(ts).cast("timestamp"))
    return events.withWatermark(ts, late).groupBy(F.window(ts, width), *by).agg(F.count("*").alias("n"))


def distinct_events(events: DataFrame, key: str, ts: str, late: str = "1 day") -> DataFrame:
    """Events by key once, with state that the watermark bounds."""
    return events.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late).dropDuplicatesWithinWatermark([key])


def rate(ts: Column, by: list[str], seconds: int) -> Column:
    """Number of rows of a group within the seconds up to each row."""
    return F.count("*").over(Window.partitionBy(*by).orderBy(F.unix_micros(ts)).rangeBetween(-seconds * 1_000_000, 0))


def gap_seconds(ts: Column, by: list[str], *tie: str) -> Column:
    """Seconds since the row before."""
    w = Window.partitionBy(*by).orderBy(ts, *tie)
    return (F.unix_micros(ts) - F.lag(F.unix_micros(ts)).over(w)) / 1_000_000


def unexpired(entries: DataFrame, key: str, ts: str, seconds: int, now: Column) -> DataFrame:
    """The latest value of each key that is not older than some seconds."""
    latest = entries.groupBy(key).agg(*[F.max_by(c, ts).alias(c) for c in entries.columns if c not in (key, ts)], F.max(ts).alias(ts))
    return latest.filter(F.unix_micros(now) - F.unix_micros(F.col(ts)) <= seconds * 1_000_000)
