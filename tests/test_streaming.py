"""Streams against the same counts in batch."""

import uuid

from pyspark.sql import functions as F

from drawgraph.streaming import progress


def test_stream_counts_each_event_once(spark, sf_dir):
    path = f"{sf_dir}/events.parquet"
    doubled = progress.without_repeats(progress.event_stream(spark, f"{sf_dir}/events*.parquet"))
    got = progress.run_to_memory(spark, doubled, f"m{uuid.uuid4().hex}", "append").count()
    assert got == spark.read.parquet(path).select("event_id").distinct().count()


def test_upserts(spark, sf_dir, tmp_path):
    query = progress.upsert_batches(progress.event_stream(spark, f"{sf_dir}/events*.parquet"), str(tmp_path / "log"), str(tmp_path / "check"))
    query.awaitTermination()
    got = {r.user_id: r.e for r in spark.read.parquet(str(tmp_path / "log")).groupBy("user_id").agg(F.max("event_id").alias("e")).collect()}
    want = {r.user_id: r.e for r in spark.read.parquet(f"{sf_dir}/events.parquet").groupBy("user_id").agg(F.max("event_id").alias("e")).collect()}
    assert got == want
