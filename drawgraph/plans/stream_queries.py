"""Streams and sources over the supplied tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import readers
from ..sources import tables as t
from ..streaming import progress
from .registry import query


@query("select date_trunc('day', ts) as day, event_type, count(*) as n, cast(floor(min(value) * 4) as bigint) as least from events group by 1, 2")
def daily_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stream's counts by day and type, read to its end."""
    events = progress.event_stream(spark, f"{sf_dir}/events*.parquet")
    counts = events.withWatermark("ts", "1 hour").groupBy(F.window("ts", "1 day"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.floor(F.min("value") * 4).alias("least"))
    done = progress.run_to_memory(spark, counts, f"progress_{uuid.uuid4().hex}")
    return done.select(F.col("window.start").cast("timestamp_ntz").alias("day"), "event_type", "n", "least")


@query("""with marked as (select user_id, ts, value, case when ts - lag(ts) over (partition by user_id order by ts, event_id) < interval 2 hour then 0 else 1 end as opens from events),
numbered as (select *, sum(opens) over (partition by user_id order by ts rows unbounded preceding) as k from marked)
select user_id, min(ts) as start, count(*) as n from numbered group by user_id, k""")
def user_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions of users (W10's gaps over time), in batch by the same operator as in a stream."""
    rows = t.supplied(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return progress.sessions(rows).select("user_id", F.col("session.start").cast("timestamp_ntz").alias("start"), "n")


@query(t.with_views("""k as (select page, stroke_id, linewidth, sqrt((x1 - x0) * (x1 - x0) + (y1 - y0) * (y1 - y0)) as length from strokes), c as (select *, case when linewidth <= 0.8 and length >= 20 then 'dimension' when linewidth >= 0.95 then 'axis' end as kind from k)
select page, stroke_id, kind, cast(row_number() over (partition by page order by stroke_id) - 1 as int) as index from c where kind is not null""", "strokes"))  # fmt: skip
def classed_strokes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S04, S05, with longer dimension lines, as no derived stroke is short."""
    return readers.classed_strokes(t.strokes(spark, sf_dir), least=20.0).select("page", "stroke_id", "kind", "index")


@query("select o_orderkey, array_to_string(list_sort(list_distinct(list_concat(range(1 + o_orderkey % 5, 4 + o_orderkey % 5 + 1), [2 + o_custkey % 9]))), ',') as pages from orders")
def page_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S14"""
    o = t.supplied(spark, sf_dir, "orders")
    low = F.col("o_orderkey") % 5
    typed = F.concat_ws(",", F.concat_ws("-", 1 + low, 4 + low), F.concat(F.lit(" "), 2 + F.col("o_custkey") % 9))
    return o.select("o_orderkey", F.array_join(readers.page_ranges(typed), ",").alias("pages"))


@query(t.with_views("select run_id, count(*) as n from feedback where prompt_name = 'dimension' group by run_id", "feedback"))
def feedback_of_prompt(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A key's rows only, newest first where they are shown; here counted."""
    return t.feedback(spark, sf_dir).filter("prompt_name = 'dimension'").groupBy("run_id").agg(F.count(F.lit(1)).alias("n"))
