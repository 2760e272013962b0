"""Segments of lines brought in step with what was decided about their candidates, and edges for handwheels."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geometry as g
from . import spatial

# How labels name candidates, which kind leads a label, where numbers of new segments begin, how far an arrow may end from its edge.
CANDIDATE = r"C-[0-9]{3}-[0-9]{4}"
LEADS = ("dimension", "coordinate_delta")
FIRST_NUMBER = {"main": 0, "branch": 1}
ARROW_REACH = 45.0


def assigned_routes(parts: DataFrame) -> DataFrame:
    """parts(line_id, candidate_id, route, pos) as (line_id, candidate_id, route, order): main ones stand before branches; who is both is a branch in the main one's place."""
    branch = F.col("route") == "branch"
    return parts.groupBy("line_id", "candidate_id").agg(F.when(F.bool_or(branch), "branch").otherwise("main").alias("route"), F.min(F.struct(branch.alias("after"), "pos")).alias("order"))


def references(segments: DataFrame, candidates: DataFrame) -> DataFrame:
    """(line_id, segment_id, at, candidate_id, kind, value): candidates of the segment's own line that its label names, in the label's order. Null labels name none."""
    named = segments.select("line_id", "segment_id", F.posexplode(F.regexp_extract_all("label", F.lit(CANDIDATE), F.lit(0))).alias("at", "candidate_id"))
    return named.join(candidates.select("line_id", "candidate_id", "kind", "value"), ["line_id", "candidate_id"])


def updated_segments(segments: DataFrame, refs: DataFrame, assigned: DataFrame) -> DataFrame:
    """R25, first half: segments(line_id, segment_id, label, length, route) that name assigned candidates take the last one's route and, where they have none, the first one's value as length.

    A segment that a coordinate difference leads (no dimension is named before it) that nobody assigned gets the route unknown."""
    by = refs.join(assigned, ["line_id", "candidate_id"], "left")
    rank = F.when(F.col("kind") == LEADS[0], 0).when(F.col("kind") == LEADS[1], 1).otherwise(2)
    has = F.col("order").isNotNull()
    lead = F.min_by(F.struct("kind", has.alias("counted")), F.struct(rank.alias("rank"), "at"))
    told = by.groupBy("line_id", "segment_id").agg(F.max_by("route", "order").alias("new_route"), F.min_by(F.when(has, F.col("value")), "order").alias("new_length"), lead.alias("lead"))
    loose = F.coalesce((F.col("lead.kind") == LEADS[1]) & ~F.col("lead.counted"), F.lit(False))
    out = segments.join(told, ["line_id", "segment_id"], "left")
    return out.withColumns({"route": F.when(loose, "unknown").otherwise(F.coalesce("new_route", "route")), "length": F.coalesce("length", "new_length")}).drop("new_route", "new_length", "lead")


def created_segments(segments: DataFrame, refs: DataFrame, assigned: DataFrame, candidates: DataFrame) -> DataFrame:
    """R25, second half: assigned candidates that no segment names get one of their own: (line_id, segment_id, candidate_id, page, text, box, route, length).

    Ids are R-<line>-<ROUTE><number of two digits or more>; within line and route candidates in order take the least numbers that no segment of the line holds. A number is found by a running count:
    a held number moves up all candidates from the place on that the free numbers before it leave."""
    new = assigned.join(refs.select("line_id", "candidate_id").distinct(), ["line_id", "candidate_id"], "left_anti")
    new = new.withColumn("k", F.row_number().over(Window.partitionBy("line_id", "route").orderBy("order", "candidate_id")) - 1)
    start = F.when(F.col("route") == "branch", FIRST_NUMBER["branch"]).otherwise(FIRST_NUMBER["main"])
    tail = F.regexp_extract("segment_id", r"-(MAIN|BRANCH)([0-9]{2,9})$", 2)
    held = segments.select("line_id", "segment_id", F.lower(F.regexp_extract("segment_id", r"-(MAIN|BRANCH)[0-9]{2,9}$", 1)).alias("route"), F.nullif(tail, F.lit("")).cast("long").alias("number"))
    held = held.filter("number is not null").filter(F.col("segment_id") == _segment_id(F.col("number"))).filter(F.col("number") >= start).select("line_id", "route", "number").distinct()
    place = F.row_number().over(Window.partitionBy("line_id", "route").orderBy("number"))
    marks = held.select("line_id", "route", (F.col("number") - start - place + 1).alias("k"), F.lit(1).alias("held"), F.lit(None).cast("string").alias("candidate_id"))
    both = marks.unionByName(new.select("line_id", "route", F.col("k").cast("long").alias("k"), F.lit(0).alias("held"), "candidate_id"))
    before = F.sum("held").over(Window.partitionBy("line_id", "route").orderBy("k", F.desc("held")).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    numbered = both.withColumn("number", F.col("k") + before + start).filter("held = 0").withColumn("segment_id", _segment_id(F.col("number")))
    return numbered.join(candidates.select("line_id", "candidate_id", "page", "text", "box", F.col("value").alias("length")), ["line_id", "candidate_id"]).select("line_id", "segment_id", "candidate_id", "page", "text", "box", "route", "length")


def _segment_id(number):
    shown = number.cast("string")
    return F.concat(F.lit("R-"), F.col("line_id").cast("string"), F.lit("-"), F.upper("route"), F.when(F.length(shown) < 2, F.lpad(shown, 2, "0")).otherwise(shown))


def reconciled(segments: DataFrame, candidates: DataFrame, parts: DataFrame, points: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(segments with their origin, new points, new annotations).

    candidates(line_id, candidate_id, page, text, kind, value, box), an id once a line; parts(line_id, candidate_id, route, pos) are accepted ones; points(point_id) exist already. Each new segment
    has two points without coordinates, but for those that exist, and an annotation. Parts that are no candidates of their line create nothing."""
    assigned = assigned_routes(parts).join(candidates.select("line_id", "candidate_id"), ["line_id", "candidate_id"], "left_semi")
    refs = references(segments, candidates)
    new = created_segments(segments, refs, assigned, candidates)
    label = F.concat("candidate_id", F.lit(" route_reconstruction "), "text")
    ends = F.array(*[F.struct(F.concat("segment_id", F.lit(f"-P0{i}")).alias("point_id"), F.lit(f"route {end}").alias("role")) for i, end in ((1, "start"), (2, "end"))])
    kept = updated_segments(segments, refs, assigned).withColumn("origin", F.lit("kept"))
    whole = kept.unionByName(new.select("line_id", "segment_id", label.alias("label"), "length", "route", F.lit("created").alias("origin")), allowMissingColumns=True)
    made = new.select("line_id", "segment_id", "page", "candidate_id", F.explode(ends).alias("e")).select("line_id", "segment_id", "e.point_id", "e.role", "page", F.concat(F.lit("route_reconstruction "), "candidate_id").alias("label"), F.lit("calculated").alias("source"))
    made = made.join(points.select("point_id").distinct(), "point_id", "left_anti")
    notes = new.select("line_id", F.concat(F.lit("A-"), "segment_id").alias("annotation_id"), "page", F.concat("segment_id", F.lit(" "), "text").alias("label"), F.lit("route_reconstruction_segment").alias("kind"), "box")
    return whole, made, notes


def handwheel_edges(wheels: DataFrame, edges: DataFrame, most: float = ARROW_REACH) -> DataFrame:
    """wheels(page, id, pos, tip) with the edge(page, edge_id, a, b) next to the arrow's tip, the first in order among equals; without one within reach an edge of their own, named by pos.

    A wheel without an arrow (tip null) has no edge and creates none."""
    tips = wheels.filter("tip is not null").select("page", "id", "tip")
    near = spatial.gridded_within(tips, edges, "tip", "edge_id", most).groupBy("page", "id").agg(F.min_by(F.struct("near_id", "d2"), F.struct("d2", "near_id")).alias("n"))
    out = wheels.join(near, ["page", "id"], "left")
    arrow, own = F.col("tip").isNotNull(), F.col("n").isNull()
    shown = F.col("pos").cast("string")
    name = F.concat(F.lit("HW_EDGE_"), F.when(F.length(shown) < 3, F.lpad(shown, 3, "0")).otherwise(shown))
    kind = F.when(arrow, F.when(own, "handwheel_attachment").otherwise("pipe_edge"))
    return out.select("page", "id", "pos", arrow.alias("arrow_found"), F.when(arrow, F.coalesce(F.col("n.near_id").cast("string"), name)).alias("edge_id"), F.round(F.sqrt("n.d2"), 2).alias("distance"), F.when(arrow, own).alias("edge_created"), kind.alias("edge_kind"), F.when(arrow, ~own).alias("is_pipe_edge"))
