"""Tables put together from parts: pages of lines, coordinates of vertices, groups of candidates, nested payloads."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def lines_of_pages(pages: DataFrame) -> DataFrame:
    """Pages of each line in order."""
    return pages.groupBy("line_id").agg(F.array_sort(F.collect_list("page")).alias("pages"), F.count(F.lit(1)).alias("n"))


def vertex_coordinates(labels: DataFrame) -> DataFrame:
    """labels(page, vertex, axis, value, pos): the first value of an axis stays; confidence by how many axes are known."""
    first = labels.groupBy("page", "vertex").pivot("axis", ["x", "y", "z"]).agg(F.min_by("value", "pos"))
    known = sum(F.when(F.col(a).isNotNull(), 1).otherwise(0) for a in ("x", "y", "z"))
    return first.withColumn("axes", known).withColumn("confidence", F.when(known == 3, 0.95).when(known > 0, 0.7).otherwise(0.0)).withColumn("state", F.when(known == 3, "known").when(known > 0, "partial").otherwise("unknown"))


def coordinate_conflicts(labels: DataFrame) -> DataFrame:
    """Later values that differ from the first."""
    first = F.first_value("value").over(Window.partitionBy("page", "vertex", "axis").orderBy("pos"))
    return labels.withColumn("kept", first).filter("value <> kept").select("page", "vertex", "axis", "pos", "kept", F.col("value").alias("conflict"))


def interval_groups(edges: DataFrame, dims: DataFrame) -> DataFrame:
    """Every edge with the ids, values and decisions of its candidates; edges without any stay."""
    rows = dims.groupBy("edge_id").agg(F.array_sort(F.collect_list(F.struct("dim_id", "value_mm", "local_decision"))).alias("candidates"))
    joined = edges.join(rows, "edge_id", "left")
    n = F.coalesce(F.size("candidates"), F.lit(0))
    return joined.select("edge_id", F.coalesce(F.transform("candidates", lambda c: c["dim_id"].cast("string")), F.array()).alias("ids"), F.aggregate("candidates", F.lit(0.0), lambda a, c: a + c["value_mm"]).alias("sum_mm"), F.when(F.col("candidates").isNull(), 0).otherwise(n).alias("n"))


def text_lines(words: DataFrame, needle: str) -> DataFrame:
    """words(page, block, line, word_no, x0, y0, x1, y1, text) by line: text in order and box of the lines that hold a word with needle."""
    out = words.groupBy("page", "block", "line").agg(F.bool_or(F.contains(F.lower("text"), F.lit(needle))).alias("has"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("x0", "word_no", "text"))), lambda w: w["text"]), " ").alias("line_text"), F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"))
    return out.filter("has").drop("has")


def page_payloads(dims: DataFrame, strokes: DataFrame) -> DataFrame:
    """A page as one JSON text without nulls, its parts in order; pages of either side stay."""
    d = dims.groupBy("page").agg(F.array_sort(F.collect_list(F.struct("dim_id", "value_mm", "local_decision"))).alias("dimensions"))
    s = strokes.groupBy("page").agg(F.count(F.lit(1)).alias("strokes"), F.slice(F.array_sort(F.collect_list("stroke_id")), 1, 3).alias("first_strokes"))
    return d.join(s, "page", "full_outer").select("page", F.to_json(F.struct("page", "dimensions", "strokes", "first_strokes")).alias("payload"))


def split_at_points(edges: DataFrame, points: DataFrame, slack: float = 14.0) -> DataFrame:
    """K19's first step: edges(page, edge_id, a, b) cut at points(page, point_id, p) within slack of them: pieces between neighbours, in order along the edge."""
    from ..functions import geometry as g

    near = edges.join(points, "page").withColumn("hit", g.to_segment(F.col("p"), F.col("a"), F.col("b"))).filter(F.col("hit.distance") <= slack).select("page", "edge_id", F.col("hit.at").alias("at"))
    ends = edges.select("page", "edge_id", F.explode(F.array(F.lit(0.0), F.lit(1.0))).alias("at"))
    cuts = near.unionByName(ends).distinct()
    order = Window.partitionBy("page", "edge_id").orderBy("at")
    pieces = cuts.select("page", "edge_id", F.col("at").alias("start"), F.lead("at").over(order).alias("end"), (F.row_number().over(order) - 1).alias("piece"))
    return pieces.filter("end is not null and end - start > 0.002")


def merged_results(*parts: DataFrame) -> DataFrame:
    """Bundles laid on one another; columns that one lacks are null."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out


#: Columns of a finished page; a snapshot of the local stage has none of them.
FINAL = ("final_vertices", "handwheel_vertices", "edge_segments", "final_contour", "handwheels", "handwheel_edges", "valve_edges", "handwheel_glyphs", "source_edges", "parent_edges")


def _listed(c: str) -> Column:
    return F.coalesce(F.col(c), F.array())


def local_snapshot(pages: DataFrame) -> DataFrame:
    """pages(page, vertices, edges, dimensions, ...) as they were before the final contour: without FINAL, with copies of vertices and edges, and each named dimension's decision. Null lists are empty."""
    named = F.filter(_listed("dimensions"), lambda d: d["id"].isNotNull())
    decisions = F.transform(named, lambda d: F.struct(d["id"].alias("candidate_id"), d["value_mm"].alias("value_mm"), d["decision"].alias("decision"), d["reason"].alias("reason"), d["conflict_with"].alias("conflict_with"), d["status"].alias("status")))
    return pages.drop(*FINAL).withColumns({"analysis_stage": F.lit("local_processing"), "base_vertices": _listed("vertices"), "base_edges": _listed("edges"), "local_decisions": decisions})


def _line(*parts: Column | str) -> Column:
    """Parts after one another; what is null is told as None."""
    return F.concat(*[F.lit(x) if isinstance(x, str) else F.coalesce(x.cast("string"), F.lit("None")) for x in parts])


def map_text(pages: DataFrame) -> DataFrame:
    """(page, map_text): pages(page, pdf, vertices, edges, dimensions) as text for a reviewer, one line for each part, in the order of the lists."""
    vertices = F.transform(_listed("vertices"), lambda v: _line(v["id"], " role=", v["role"], " x=", v["x"], " y=", v["y"], " confidence=", F.coalesce(v["confidence"], F.lit(1.0))))
    edges = F.transform(_listed("edges"), lambda e: _line(e["id"], " ", e["from_vertex"], " -> ", e["to_vertex"], " status=", e["status"], " pixel_length=", e["pixel_length"]))
    dims = F.transform(_listed("dimensions"), lambda d: _line(d["id"], " value_mm=", d["value_mm"], " selected_edge=", d["selected_edge_id"], " status=", d["status"], " preliminary_decision=", d["decision"], " preliminary_reason=", d["reason"], " preliminary_conflict_with=", d["conflict_with"]))
    head = F.array(_line("PDF: ", F.col("pdf")), _line("PAGE: ", F.col("page")))
    lines = F.concat(head, F.array(F.lit("VERTICES:")), vertices, F.array(F.lit("EDGES:")), edges, F.array(F.lit("DIMENSIONS:")), dims)
    return pages.select("page", F.concat(F.array_join(lines, "\n"), F.lit("\n")).alias("map_text"))


def review_payload(pages: DataFrame) -> DataFrame:
    """(page, payload): what a reviewer gets of a page as one JSON text: its parts and the preliminary decision of each dimension. Nulls are told."""
    decisions = F.transform(_listed("dimensions"), lambda d: F.struct(d["id"].alias("candidate_id"), d["value_mm"].alias("value_mm"), d["selected_edge_id"].alias("edge_id"), d["decision"].alias("decision"), d["reason"].alias("reason"), d["conflict_with"].alias("conflict_with")))
    parts = F.struct("page", _listed("vertices").alias("vertices"), _listed("edges").alias("edges"), decisions.alias("preliminary_decisions"))
    return pages.select("page", F.to_json(parts, {"ignoreNullFields": "false"}).alias("payload"))
