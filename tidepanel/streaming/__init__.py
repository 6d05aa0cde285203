"""Structured Streaming over arriving events: daily counts, of all days or of those that close, captures that are due, runs over what has arrived."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from ..plans.tables import shared_folder


def daily_counts(events: DataFrame, delay: str = "2 days") -> DataFrame:
    """day, event_type, n and top of a stream of events (ts, event_type, value).

    In append mode a day is written once, when the latest event is more than ``delay`` after its end; its state is dropped then, and
    events that come later for it are dropped too.
    """
    timed = events.withWatermark("ts", delay)
    counted = timed.groupBy(F.window("ts", "1 day").alias("w"), "event_type").agg(F.count("*").alias("n"), F.max("value").alias("top"))
    return counted.select(F.to_date("w.start").alias("day"), "event_type", "n", "top")


def running_counts(events: DataFrame) -> DataFrame:
    """day, event_type, n and top of all events of a stream so far, for update mode: nothing is dropped, however late it comes.

    The state is a row for each day (null included) and type, which no later event may miss.
    """
    return events.groupBy(F.to_date("ts").alias("day"), "event_type").agg(F.count("*").alias("n"), F.max("value").alias("top"))


def captures(due: DataFrame, records: DataFrame, keys: list[str], within: str, closes: str, delay: str = "1 day") -> DataFrame:
    """due (keys, due_id, due_at) with at and status of every record of its key that comes between due_at and ``closes`` after it.

    captured: within ``within``; late: after that; missed: none came, which is written when both streams are past the close by
    ``delay``. Both sides' state is dropped by then, so it is bounded by what falls due in that time.
    """
    left = due.withWatermark("due_at", delay).alias("d")
    right = records.select(*(F.col(k).alias(f"_{k}") for k in keys), F.col("at")).withWatermark("at", delay)
    same = F.lit(True)
    for k in keys:
        same = same & (F.col(f"d.{k}") == F.col(f"_{k}"))
    met = left.join(right, same & (F.col("at") >= F.col("due_at")) & (F.col("at") <= F.col("due_at") + F.expr(f"INTERVAL {closes}")), "left_outer")
    return met.select(*keys, "due_id", "due_at", "at", capture_status(F.col("due_at"), F.col("at"), within).alias("status"))


def capture_status(due_at: Column, at: Column, within: str) -> Column:
    return F.when(at.isNull(), "missed").when(at <= due_at + F.expr(f"INTERVAL {within}"), "captured").otherwise("late")


def source(spark: SparkSession, path: str, schema, files_a_batch: int | None = None) -> DataFrame:
    """A stream of the Parquet files of a folder, or of one file, that Spark's readers can open."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    status = hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(hadoop)
    reader = spark.readStream.schema(schema)
    if files_a_batch:
        reader = reader.option("maxFilesPerTrigger", files_a_batch)
    if status.isDirectory():
        return reader.parquet(path)
    folder, name = path.rsplit("/", 1)
    return reader.option("pathGlobFilter", name).parquet(folder)


def drained(stream: DataFrame, folder: str | None = None, keys: list[str] | None = None) -> DataFrame:
    """What a stream appends of all its sources hold by now: run until they are drained, written under the shared folder and read again.

    With keys the stream updates its rows instead, and the last row of each key is told.

    A source without rows, or nothing to append yet, gives no rows. The run's folder is new unless one is given; with the
    folder of an earlier run it goes on where that one ended, with its state.
    """
    spark = stream.sparkSession
    run = folder or f"{shared_folder(spark)}/{uuid.uuid4().hex}"
    spark.createDataFrame([], stream.schema).write.mode("append").parquet(f"{run}/rows")

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{run}/rows/batch={number}")  # a batch that runs again replaces itself

    stream.writeStream.outputMode("update" if keys else "append").foreachBatch(write).option("checkpointLocation", f"{run}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    if not keys:
        return spark.read.schema(stream.schema).parquet(f"{run}/rows").select(stream.columns)
    rows = spark.read.schema(StructType([*stream.schema, StructField("batch", LongType())])).parquet(f"{run}/rows")
    last = rows.groupBy(*keys).agg(F.max_by(F.struct(*(c for c in stream.columns if c not in keys)), "batch").alias("last"))
    return last.select(*keys, "last.*").select(stream.columns)
