"""Decisions and lengths: who has the last word on a dimension, and what a line's pipes add up to."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Kinds and words of decisions that were settled before review.
INVALID_KINDS = ("valve_dimension", "cross_sheet_dimension", "other")
INVALID_WORDS = r"handwheel|cross_sheet|see sheet|continuation|invalid_overlap|same axis"


def effective_decision(local: Column, assessment: Column, proposed: Column, keep_local: Column, accept: Column, reviewed: Column | None = None) -> Column:
    """Kept by a person > accepted by a person > proposed > assessed > local. reviewed: the reviewer's own note of the local decision."""
    keep, take = F.coalesce(keep_local, F.lit(False)), F.coalesce(accept, F.lit(False))
    seen = local if reviewed is None else F.coalesce(reviewed, local)
    return F.when(keep, local).when(take, F.coalesce(proposed, local)).when(proposed.isNotNull(), proposed).when(assessment == "accepted", seen).when(assessment.isin("disputed", "insufficient"), F.lit("ambiguous")).otherwise(local)


def decided(dims: DataFrame, reviews: DataFrame, overrides: DataFrame) -> DataFrame:
    """dims with decision; reviews and overrides are equi-joined by dimension, left."""
    joined = dims.join(reviews, "dim_id", "left").join(overrides, "dim_id", "left")
    return joined.withColumn("decision", effective_decision(F.col("local_decision"), F.col("assessment"), F.col("proposed"), F.col("keep_local"), F.col("accept")))


def length_sums(decision: Column, value: Column) -> list[Column]:
    """Clean counts what is included, dirty also what is uncertain, ambiguous only that."""
    zero = F.lit(0.0)
    return [F.sum(F.when(decision == "include", value).otherwise(zero)).alias("clean_mm"), F.sum(F.when(decision != "exclude", value).otherwise(zero)).alias("dirty_mm"), F.sum(F.when(~decision.isin("include", "exclude"), value).otherwise(zero)).alias("ambiguous_mm")]


def local_summary(dims: DataFrame) -> DataFrame:
    """By page, and in a row without page over all. Nothing is deduplicated here."""
    return dims.groupingSets([["page"], []], "page").agg(*length_sums(F.col("local_decision"), F.col("value_mm")), F.count(F.lit(1)).alias("n"))


def primary_edge_winners(rows: DataFrame) -> DataFrame:
    """Of the included dimensions of an edge the widest, then largest, then last counts; those without an edge all do. Adds counted."""
    order = Window.partitionBy("page", "edge_id").orderBy(F.desc("coverage"), F.desc("value_mm"), F.desc("dim_id"))
    return rows.withColumn("counted", F.col("edge_id").isNull() | (F.row_number().over(order) == 1))


def route(candidate_branch: Column, edge_branch: Column, edge_route: Column) -> Column:
    """A branch by candidate, then by edge; then the edge's route; then main."""
    return F.when(F.coalesce(candidate_branch, edge_branch).isNotNull(), F.lit("branch")).otherwise(F.coalesce(edge_route, F.lit("main")))


def is_prevalidated_invalid(decision: Column, kind: Column, reason: Column) -> Column:
    """R16"""
    return F.coalesce((decision == "exclude") & (kind.isin(*INVALID_KINDS) | F.lower(reason).rlike(INVALID_WORDS)), F.lit(False))


def reviewed_lengths(rows: DataFrame) -> DataFrame:
    """A10: rows(page, dim_id, value_mm, decision, kind, edge_id, coverage, route_type) by page and route: clean of the winners, dirty and ambiguous of all pipe lengths."""
    pipes = rows.filter(F.coalesce(F.col("kind"), F.lit("pipe_length")) == "pipe_length")
    counted = primary_edge_winners(pipes.filter("decision = 'include'"))
    marked = pipes.join(counted.select("dim_id", "counted"), "dim_id", "left").withColumn("route", F.coalesce("route_type", F.lit("main")))
    value = F.col("value_mm")
    return marked.groupBy("page", "route").agg(
        F.sum(F.when(F.col("counted"), value).otherwise(0.0)).alias("clean_mm"), F.sum(F.when(F.col("decision").isin("include", "ambiguous"), value).otherwise(0.0)).alias("dirty_mm"),
        F.sum(F.when(F.col("decision") == "ambiguous", value).otherwise(0.0)).alias("ambiguous_mm"), F.count_if(~F.col("counted")).alias("duplicates"),
    )


def route_totals(rows: DataFrame) -> DataFrame:
    """rows(line_no, route, branch_id, decision, value_mm), each candidate once, rolled up over route and branch."""
    return rows.rollup("line_no", "route", "branch_id").agg(*length_sums(F.col("decision"), F.col("value_mm")), F.grouping_id().cast("long").alias("level"))


def last_named(rows: DataFrame, name: str, values: list[str], order: str = "pos") -> DataFrame:
    """(line_no, name, values...): of rows of a line with one name the last in order."""
    return rows.filter(F.col(name).isNotNull()).groupBy("line_no", name).agg(F.max_by(F.struct(*values), order).alias("_v")).select("line_no", name, "_v.*")


def reviewed_totals(dims: DataFrame, assessments: DataFrame, edge_routes: DataFrame, branches: DataFrame, confirmed: DataFrame, distances: DataFrame) -> DataFrame:
    """A09 with R10 and R11: lengths of each line by route and branch after local, reviewer and human decisions, with accepted distances between sheets.

    dims(line_no, pos, page, dim_id, candidate_key, edge_id, local_decision, value_mm): the first row of a candidate counts. assessments(line_no, pos, candidate_id, assessment, proposed, noted),
    edge_routes(line_no, pos, edge_id, route_type) and branches(line_no, pos, branch_id, candidate_ids, edge_ids) name candidates and edges with their page or without it, with it first; the last
    that names one counts. confirmed(line_no, candidate_ids, keep_ids, distance_ids): what a person accepted and kept. distances(line_no, idx, value_mm, route, branch_id) count if they are accepted
    and positive, in their branch if the line has it, else by route. (line_no, route, branch_id, sums, n_candidates, n_distances, level), rolled up to routes and lines."""
    own = lambda c: F.concat_ws(":", F.col("page").cast("string"), c)
    rows = dims.withColumn("id", F.col("dim_id").cast("string")).withColumn("key", F.coalesce("candidate_key", own(F.col("id")))).withColumn("edge", F.coalesce(F.col("edge_id").cast("string"), F.lit("")))
    rows = rows.groupBy("line_no", "key").agg(F.min_by(F.struct("page", "id", "edge", "local_decision", "value_mm"), "pos").alias("_d")).select("line_no", "key", "_d.*").withColumn("own_edge", own(F.col("edge")))

    def named(rows: DataFrame, table: DataFrame, name: str, full: str, plain: str, made: str) -> DataFrame:
        """rows with what table says of the full name, else of the plain one."""
        for column, tag in ((full, "_full"), (plain, "_plain")):
            rows = rows.join(table.select("line_no", F.col(name).alias(column), F.struct(*[c for c in table.columns if c not in ("line_no", name)]).alias(tag)), ["line_no", column], "left")
        return rows.withColumn(made, F.coalesce("_full", "_plain")).drop("_full", "_plain")

    rows = named(rows, last_named(assessments, "candidate_id", ["assessment", "proposed", "noted"]), "candidate_id", "key", "id", "review")
    rows = named(rows, last_named(edge_routes, "edge_id", ["route_type"]), "edge_id", "own_edge", "edge", "route_of")
    for part, name, full, plain, made in (("candidate_ids", "candidate_id", "key", "id", "by_candidate"), ("edge_ids", "edge_id", "own_edge", "edge", "by_edge")):
        members = branches.select("line_no", "pos", "branch_id", F.explode(part).alias(name))
        rows = named(rows, last_named(members, name, ["branch_id"]), name, full, plain, made)
    rows = rows.join(confirmed, "line_no", "left")
    among = lambda c: F.coalesce(F.array_contains(c, F.col("key")) | F.array_contains(c, F.col("id")), F.lit(False))
    decision = effective_decision(F.col("local_decision"), F.col("review.assessment"), F.col("review.proposed"), among("keep_ids"), among("candidate_ids"), F.col("review.noted"))
    branch = F.coalesce("by_candidate.branch_id", "by_edge.branch_id")
    counted = rows.select("line_no", F.when(branch.isNotNull() | (F.col("route_of.route_type") == "branch"), "branch").otherwise("main").alias("route"), branch.alias("branch_id"), decision.alias("decision"), "value_mm", F.lit(False).alias("between"))
    told = distances.join(confirmed.select("line_no", F.explode("distance_ids").alias("idx")).distinct(), ["line_no", "idx"]).filter("value_mm > 0").join(branches.select("line_no", "branch_id", F.lit(True).alias("there")).distinct(), ["line_no", "branch_id"], "left")
    between = told.select("line_no", F.when(F.col("there") | (F.lower("route") == "branch"), "branch").otherwise("main").alias("route"), F.when(F.col("there"), F.col("branch_id")).alias("branch_id"), F.lit("include").alias("decision"), "value_mm", F.lit(True).alias("between"))
    level = F.grouping_id().cast("long").alias("level")
    every = counted.unionByName(between).groupingSets([["line_no", "route", "branch_id"], ["line_no", "route"], ["line_no"]], "line_no", "route", "branch_id")
    included = F.col("decision") == "include"
    return every.agg(*length_sums(F.col("decision"), F.col("value_mm")), F.count_if(included & ~F.col("between")).alias("n_candidates"), F.count_if(F.col("between")).alias("n_distances"), level)


def line_status(statuses: DataFrame, by: list[str]) -> DataFrame:
    """No pages or any error: error; all complete: complete; else partial."""
    return statuses.groupBy(*by).agg(F.when(F.bool_or(F.col("status") == "error"), "error").when(F.every(F.col("status") == "complete"), "complete").otherwise("partial").alias("state"), F.count(F.lit(1)).alias("n"))
