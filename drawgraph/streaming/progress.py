"""Progress and feedback as streams. These are extensions: counts by window, repeats dropped, sessions, latest rows kept by batches."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

EVENTS = "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string"


def event_stream(spark: SparkSession, path: str, files_per_batch: int = 1) -> DataFrame:
    """Events of a folder or file pattern as a stream, with a timestamp for watermarks."""
    rows = spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", files_per_batch).parquet(path)
    return rows.withColumn("ts", F.col("ts").cast("timestamp"))


def windowed_counts(events: DataFrame, late: str = "1 hour", width: str = "1 day") -> DataFrame:
    """Events and errors by window and type."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", width), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("value"))


def without_repeats(events: DataFrame, late: str = "1 hour") -> DataFrame:
    """Feedback told twice within the watermark counts once."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(["event_id"])


def sessions(events: DataFrame, gap: str = "2 hours", late: str = "1 hour") -> DataFrame:
    """Runs of events of a user without a longer gap."""
    return events.withWatermark("ts", late).groupBy(F.session_window("ts", gap).alias("session"), "user_id").agg(F.count(F.lit(1)).alias("n"), F.max("value").alias("most"))


def upsert_batches(events: DataFrame, folder: str, checkpoint: str):
    """D02 as a stream: each batch appends its latest row of every key to a log; reading takes the latest of those."""

    def append(batch: DataFrame, number: int) -> None:
        latest = batch.groupBy("user_id").agg(F.max_by(F.struct("event_id", "event_type", "ts"), "event_id").alias("row")).select("user_id", "row.*", F.lit(number).cast("long").alias("batch"))
        latest.write.mode("overwrite").parquet(f"{folder}/batch={number:06d}")  # a batch that is run again replaces itself

    return events.writeStream.foreachBatch(append).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def run_to_memory(spark: SparkSession, df: DataFrame, name: str, mode: str = "complete") -> DataFrame:
    """Let a stream read all there is and give its table: for tests and small results."""
    query = df.writeStream.outputMode(mode).format("memory").queryName(name).trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.table(name)
