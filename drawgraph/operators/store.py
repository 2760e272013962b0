"""Append-only logs and what is read from them: latest rows, feedback by version, run history."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def latest(log: DataFrame, keys: list[str], order: str, first_of: str | None = None) -> DataFrame:
    """The last row of each key; first_of keeps its earliest value, as a run keeps when it was made."""
    rest = [c for c in log.columns if c not in keys]
    made = [F.min(first_of).alias("_first")] if first_of else []
    out = log.groupBy(*keys).agg(F.max_by(F.struct(*rest), order).alias("row"), *made)
    kept = [F.col("_first").alias(c) if c == first_of else F.col(f"row.{c}").alias(c) for c in rest]
    return out.select(*keys, *kept)


def feedback_counts(feedback: DataFrame, *by: str) -> DataFrame:
    """A03, A04"""
    return feedback.groupBy(*by).agg(F.count_if(F.col("rating") == "up").alias("positive"), F.count_if(F.col("rating") == "down").alias("negative"), F.count(F.lit(1)).alias("total"))


def is_unversioned(version: Column, sha: Column) -> Column:
    return F.coalesce(version, F.lit("")).isin("", "unversioned") | (F.coalesce(sha, F.lit("")) == "")


def feedback_slices(feedback: DataFrame, version: str, sha: str) -> DataFrame:
    """All, one revision and unversioned ratings of each prompt in one pass; what is not up counts as down."""
    exact = F.coalesce((F.col("prompt_version") == version) & (F.col("prompt_sha256") == sha), F.lit(False))
    none = is_unversioned(F.col("prompt_version"), F.col("prompt_sha256"))
    up = F.col("rating").eqNullSafe("up")
    return feedback.groupBy("prompt_name").agg(F.count_if(up).alias("up"), F.count_if(~up).alias("down"), F.count_if(exact & up).alias("exact_up"), F.count_if(exact & ~up).alias("exact_down"), F.count_if(none & up).alias("unversioned_up"), F.count_if(none & ~up).alias("unversioned_down"))


def resolved_revisions(rows: DataFrame, versions: DataFrame) -> DataFrame:
    """rows(id, version, sha) with what is missing filled from the only version of that text; several leave it open."""
    known = versions.groupBy("prompt_sha256").agg(F.count(F.lit(1)).alias("n"), F.max("prompt_version").alias("only_version"))
    joined = rows.join(known, "prompt_sha256", "left")
    return joined.withColumn("resolved", F.when(F.col("prompt_version").isNotNull() & F.col("prompt_sha256").isNotNull(), F.col("prompt_version")).when(F.col("n") == 1, F.col("only_version"))).drop("n", "only_version")


def run_history(log: DataFrame) -> DataFrame:
    """By run the first three errors, seconds (null for 0), tokens (null where none was told), status."""
    errors = F.array_sort(F.collect_list(F.when(F.col("status") == "error", F.struct("seq", "page"))))
    out = log.groupBy("run_id").agg(F.min("at").alias("created_at"), F.max("at").alias("updated_at"), errors.alias("errors"), F.nullif(F.sum("seconds"), F.lit(0.0)).alias("seconds"), F.sum("tokens").alias("tokens"), F.max_by("status", "seq").alias("last_status"))
    told = F.transform(F.slice("errors", 1, 3), lambda e: F.concat(F.lit("page "), e["page"]))
    return out.select("run_id", "created_at", "updated_at", F.array_join(told, "; ").alias("errors"), F.size("errors").cast("long").alias("error_count"), "seconds", "tokens", F.when(F.size("errors") > 0, "error").otherwise(F.col("last_status")).alias("status"))


def interrupted(log: DataFrame) -> DataFrame:
    """After a restart, running and pending pages of a run are errors; what is complete stays."""
    state = log.groupBy("run_id", "line_id", "page").agg(F.max_by("status", "seq").alias("status"))
    return state.withColumn("status", F.when(F.col("status").isin("running", "pending"), "error").otherwise(F.col("status")))


def last_events(log: DataFrame, most: int = 12) -> DataFrame:
    """The last events of each page, light columns only."""
    place = F.row_number().over(Window.partitionBy("run_id", "page").orderBy(F.desc("seq")))
    return log.select("run_id", "page", "seq", "status", place.alias("place")).filter(F.col("place") <= most)


def confirmed(rows: DataFrame) -> DataFrame:
    """rows(run_id, known, accepted, kept) with new choices merged: what is kept local is never accepted; unknown ids are told."""
    return rows.select("run_id", F.array_sort(F.array_except("accepted", "kept")).alias("accepted"), F.array_sort(F.array_distinct("kept")).alias("kept"), F.array_sort(F.array_except(F.array_union("accepted", "kept"), "known")).alias("unknown"))


def create_table(spark: SparkSession, name: str, columns: str) -> None:
    """D01"""
    spark.sql(f"create table if not exists {name} ({columns}) using parquet")


def run_trees(log: DataFrame, most: int = 12) -> DataFrame:
    """(run_id, created_at, tree): a run with its lines in the order of their first event, those with their pages by number, those with their last events, as one JSON text; nulls are told.

    A page's error is that of its last failure. A line is complete if all its pages are, failed if one is, else running; a run likewise. A run has few lines and pages, however many events: these are
    summed before they are nested, and only the last ones of a page are listed."""
    at = ["run_id", "line_id", "page"]
    state = log.groupBy(*at).agg(F.min("at").alias("created_at"), F.min("seq").alias("first"), F.max_by("status", "seq").alias("status"), F.max(F.when(F.col("status") == "error", F.col("seq"))).alias("error"), F.sum("seconds").alias("seconds"), F.sum("tokens").alias("tokens"), F.count(F.lit(1)).alias("n_events"))
    place = F.row_number().over(Window.partitionBy(*at).orderBy(F.desc("seq")))
    events = log.select(*at, "seq", "status", place.alias("place")).filter(F.col("place") <= most).groupBy(*at).agg(F.array_sort(F.collect_list(F.struct("seq", "status"))).alias("events"))
    page = F.struct(F.col("page").alias("page_number"), "status", "error", "seconds", "tokens", "n_events", "events")
    worst = lambda c: F.when(F.bool_or(F.col(c) == "error"), "error").when(F.bool_and(F.col(c) == "complete"), "complete").otherwise("running")
    lines = state.join(events, at).groupBy("run_id", "line_id").agg(F.min("created_at").alias("created_at"), F.min("first").alias("first"), worst("status").alias("status"), F.array_sort(F.collect_list(page)).alias("page_results"))
    line = F.struct("first", F.struct("line_id", F.transform("page_results", lambda p: p["page_number"]).alias("pages"), "status", "page_results").alias("line"))
    runs = lines.groupBy("run_id").agg(F.min("created_at").alias("created_at"), worst("status").alias("status"), F.array_sort(F.collect_list(line)).alias("lines"))
    listed = F.transform("lines", lambda x: x["line"])
    tree = F.struct("run_id", "status", F.transform(listed, lambda x: x["line_id"]).alias("line_ids"), listed.alias("lines"))
    return runs.select("run_id", "created_at", F.to_json(tree, {"ignoreNullFields": "false"}).alias("tree"))


def run_overviews(log: DataFrame, confirmations: DataFrame, edits: DataFrame, feedback: DataFrame) -> DataFrame:
    """run_history with, for each run, how many fixes of the reviewer were accepted, how many local decisions kept and the difference, manual edits, and feedback by rating; 0 where there is none.

    confirmations(run_id, line_id, accepted, kept) have lists of ids; edits(run_id) and feedback(run_id, rating) a row each. Errors are the first three, counts are of all."""
    confirmed_ = confirmations.groupBy("run_id").agg(F.sum(F.coalesce(F.size("accepted"), F.lit(0))).alias("fixes"), F.sum(F.coalesce(F.size("kept"), F.lit(0))).alias("kept"))
    out = run_history(log)
    for part in (confirmed_, edits.groupBy("run_id").agg(F.count(F.lit(1)).alias("manual_edits")), feedback_counts(feedback, "run_id")):
        out = out.join(part, "run_id", "left")
    n = lambda c: F.coalesce(c, F.lit(0))
    return out.withColumns({c: n(c) for c in ("fixes", "kept", "manual_edits", "positive", "negative", "total")}).withColumn("net", F.col("fixes") - F.col("kept"))
