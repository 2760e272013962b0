"""Reviews beside local results: which answer belongs to which row, whose coordinates count, what stays unresolved."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geometry as g
from ..functions import text as x

# Confidences and tolerances that results depend on.
LOCAL_CONFIDENCE, SECOND_AXIS = 0.7, 10.0
#: Arrays of a reviewer's answer; the second name counts where the first is missing or empty.
ANSWER_PARTS = (("candidate_assessments",), ("unresolved_reviews",), ("edge_routes",), ("branch_routes", "branches"), ("route_segments",), ("cross_sheet_links",), ("intermediate_distances",), ("vertex_coordinates", "points"))


def last_of(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Of rows with one key the last counts."""
    rest = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), order).alias("_last")).select(*keys, "_last.*")


def reviewed(estimates: DataFrame, reviews: DataFrame) -> DataFrame:
    """estimates(page, candidate_id) with the review(key, pos, assessment) of their exact key page:id, else the first by pos whose key ends in their id."""
    exact = reviews.select(F.col("key").alias("exact_key"), F.col("assessment").alias("exact"))
    suffix = reviews.filter(F.contains("key", F.lit(":"))).groupBy(F.element_at(F.split("key", ":"), -1).alias("suffix")).agg(F.min_by("assessment", "pos").alias("other"))
    keyed = estimates.withColumns({"key": x.page_key(F.col("page"), F.col("candidate_id").cast("string")), "suffix": F.col("candidate_id").cast("string")})
    joined = keyed.join(exact, F.col("key") == F.col("exact_key"), "left").join(suffix, "suffix", "left")
    return joined.select("page", "candidate_id", F.coalesce("exact", "other").alias("assessment"), F.when(F.col("exact").isNotNull(), "exact").when(F.col("other").isNotNull(), "suffix").alias("matched"))


def matched_classes(segments: DataFrame, candidates: DataFrame) -> DataFrame:
    """segments(page, seg_id, ids, size, x, y) with the candidate(page, cand_id, kind, text, zone, x, y, cls) they stem from.

    First a candidate that their label names: dimensions of the route before others, then coordinate deltas, and those of their size first; then the first one whose
    place is within 3; then the only one of the drawing with their text."""
    c = candidates.alias("c")
    named = segments.select("page", "seg_id", "size", F.posexplode("ids").alias("pos", "cand_id")).alias("s").join(c, ["page", "cand_id"])
    rank = F.when((F.col("c.kind") == "dimension") & (F.col("c.cls") == "route_segment"), 0).when(F.col("c.kind") == "dimension", 1).when(F.col("c.kind") == "coordinate_delta", 2).otherwise(3)
    by_label = named.groupBy("page", "seg_id").agg(F.min_by("cand_id", F.struct(rank, F.when(F.col("c.text") == F.col("s.size"), 0).otherwise(1), "pos")).alias("by_label"))
    near = segments.filter("x is not null").alias("s").join(c, (F.col("s.page") == F.col("c.page")) & (F.abs(F.col("s.x") - F.col("c.x")) <= 3) & (F.abs(F.col("s.y") - F.col("c.y")) <= 3))
    by_place = near.groupBy(F.col("s.page").alias("page"), F.col("s.seg_id").alias("seg_id")).agg(F.min("c.cand_id").alias("by_place"))
    only = candidates.filter("zone = 'drawing'").groupBy("page", F.col("text").alias("size")).agg(F.min("cand_id").alias("by_text"), F.count(F.lit(1)).alias("n")).filter("n = 1").drop("n")
    joined = segments.join(by_label, ["page", "seg_id"], "left").join(by_place, ["page", "seg_id"], "left").join(only, ["page", "size"], "left")
    how = F.when(F.col("by_label").isNotNull(), "label").when(F.col("by_place").isNotNull(), "place").when(F.col("by_text").isNotNull(), "text")
    return joined.select("page", "seg_id", F.coalesce("by_label", "by_place", "by_text").alias("cand_id"), how.alias("how"))


def edge_diagnostics(edges: DataFrame, vertices: DataFrame) -> DataFrame:
    """The axis of edges(page, edge_id, source, target, value, dx, dy) from their direction on the sheet, held against the coordinates of both vertices(page, vertex, x, y, z).

    Rule 3: there is an axis and at least one end is known; 4: else. An axis whose known difference is not the value, or beside a second difference, is taken back."""
    ends = [vertices.select("page", F.col("vertex").alias(side), F.struct("x", "y", "z").alias(f"{side}_at")) for side in ("source", "target")]
    e = edges.join(ends[0], ["page", "source"], "left").join(ends[1], ["page", "target"], "left")
    found = g.axis_of(F.col("dx"), F.col("dy"))
    e = e.withColumns({"axis_": found["axis"], "sign_": found["sign"]})
    deltas = {n: F.col("target_at")[n.lower()] - F.col("source_at")[n.lower()] for n in ("X", "Y", "Z")}
    own = F.coalesce(*[F.when(F.col("axis_") == n, d) for n, d in deltas.items()])
    off = own.isNotNull() & ~g.values_agree(F.abs(own), F.col("value"))
    second = F.coalesce(F.greatest(*[F.when(F.col("axis_") != n, F.abs(d)) for n, d in deltas.items()]) > SECOND_AXIS, F.lit(False))
    both, any_ = F.col("source_at").isNotNull() & F.col("target_at").isNotNull(), F.col("source_at").isNotNull() | F.col("target_at").isNotNull()
    wrong = F.coalesce(both & F.col("axis_").isNotNull() & (off | second), F.lit(False))
    keep = any_ & ~wrong
    reason = F.when(~any_, "missing_vertex_rows").when(F.col("axis_").isNull(), "no_clear_axis").when(wrong & off, "delta_does_not_match_value").when(wrong, "second_coordinate_delta").otherwise("path_direction")
    return e.select("page", "edge_id", F.when(both | (any_ & F.col("axis_").isNotNull()), 3).otherwise(4).alias("rule"), F.when(keep, F.col("axis_")).alias("axis"), F.when(keep, F.col("sign_")).alias("sign"), wrong.alias("inconsistent"), reason.alias("reason"))


def diagnostics_summary(diagnostics: DataFrame) -> DataFrame:
    """Counts by page."""
    return diagnostics.groupBy("page").agg(F.count(F.lit(1)).alias("edges_total"), F.count("axis").alias("axis_filled"), F.count_if(F.col("axis").isNull()).alias("axis_null"), F.count_if("inconsistent").alias("inconsistent"))


def preferred_coordinates(vertices: DataFrame, reviews: DataFrame) -> DataFrame:
    """Local coordinates(page, vertex, x, y, z, confidence) with enough confidence before the reviewer's (page, vertex, rx, ry, rz); places on the sheet never count."""
    joined = vertices.join(reviews, ["page", "vertex"], "full_outer")
    local = F.coalesce(F.col("confidence") >= LOCAL_CONFIDENCE, F.lit(False))
    return joined.select("page", "vertex", *[F.when(local, F.coalesce(a, f"r{a}")).otherwise(F.coalesce(F.col(f"r{a}"), F.col(a))).alias(a) for a in ("x", "y", "z")], F.when(local, "local").when(F.coalesce("rx", "ry", "rz").isNotNull(), "reviewer").otherwise("none").alias("origin"))


def backfilled(candidates: DataFrame, dims: DataFrame) -> DataFrame:
    """An edge's candidates with the dimension's decision and reason where they have none of their own."""
    own = dims.select("dim_id", F.col("local_decision").alias("of_dim"), F.col("reason").alias("dim_reason"))
    return candidates.join(own, "dim_id", "left").withColumns({"decision": F.coalesce(x.first_filled(F.col("decision")), "of_dim"), "reason": F.coalesce(x.first_filled(F.col("reason")), "dim_reason")}).drop("of_dim", "dim_reason")


def unresolved_rows(dims: DataFrame) -> DataFrame:
    """dims(page, dim_id, value_mm, local_decision, interval, state, reason) without an interval of their own."""
    missing = ~F.coalesce(F.col("state") == "resolved", F.lit(False)) | x.first_filled(F.col("interval")).isNull()
    return dims.filter(missing).select("dim_id", x.page_key(F.col("page"), F.col("dim_id").cast("string")).alias("candidate_key"), "value_mm", "local_decision", F.coalesce(x.first_filled(F.col("state")), F.lit("unresolved")).alias("state"), x.first_filled(F.col("reason"), F.col("local_decision")).alias("reason"))


def answer_rows(answers: DataFrame, page: str, text: str) -> DataFrame:
    """A row for each item of the arrays of JSON answers, read as VARIANT: (page, part, pos, ids..., from_page, to_page, on_page, local_decision, item).

    Ids of this page get it before them: candidate_id and candidate_key, either of which stands for the other, target_final_edge_id, edge_id, vertex_id (also named id) with
    vertex_key, which it stands for, and its own form as local_vertex_id, and those within edge_ids and candidate_ids. Pages that an item does not name are its answer's;
    one that it gives as null stays null. A local decision may be an object that holds it. What a part does not have is null; other fields are in item. Answers that are no
    objects, and arrays that are missing, have no rows."""
    field = lambda name, kind="string": F.try_variant_get("_v", f"$.{name}", kind)
    filled = lambda *names: F.coalesce(*[F.nullif(field(n), F.lit("")) for n in names])
    key = lambda c: x.page_key(F.col(page), c)
    keys = lambda name: F.transform(F.coalesce(field(name, "array<string>"), F.array().cast("array<string>")), key)
    in_ = lambda *parts: F.col("part").isin(*parts)

    def own_page(name: str) -> Column:
        """The page that an item names, null if it names null, its answer's if it names none."""
        return F.when(field(name, "variant").isNull(), F.col(page).cast("string")).otherwise(field(name))

    arrays = []
    for names in ANSWER_PARTS:
        lists = [F.try_variant_get("_a", f"$.{n}", "array<variant>") for n in names]
        arrays.append(F.struct(F.lit(names[0]).alias("part"), F.coalesce(*[F.when(F.size(v) > 0, v) for v in lists]).alias("rows")))
    rows = answers.select(page, x.answer_object(F.col(text) if isinstance(text, str) else text).alias("_a")).select(page, F.explode(F.array(*arrays)).alias("_p")).select(page, "_p.part", F.posexplode("_p.rows").alias("pos", "_v"))
    judged, with_candidate = in_("candidate_assessments", "unresolved_reviews"), in_("intermediate_distances")
    vertex = in_("vertex_coordinates")
    decision = F.when(F.schema_of_variant(field("local_decision", "variant")).startswith("OBJECT"), F.try_variant_get("_v", "$.local_decision.decision", "string")).otherwise(field("local_decision"))
    return rows.select(
        page, "part", "pos",
        F.when(judged, key(filled("candidate_id", "candidate_key"))).when(with_candidate, key(filled("candidate_id"))).alias("candidate_id"),
        F.when(judged, key(filled("candidate_key", "candidate_id"))).alias("candidate_key"),
        F.when(in_("candidate_assessments"), key(filled("target_final_edge_id"))).alias("target_final_edge_id"),
        F.when(in_("edge_routes"), key(filled("edge_id"))).alias("edge_id"),
        F.when(vertex, key(filled("vertex_id", "id"))).alias("vertex_id"),
        F.when(vertex, key(filled("vertex_key", "vertex_id", "id"))).alias("vertex_key"),
        F.when(vertex & filled("vertex_id", "id").isNotNull(), F.when(field("local_vertex_id", "variant").isNull(), filled("vertex_id", "id")).otherwise(field("local_vertex_id"))).alias("local_vertex_id"),
        F.when(in_("branch_routes"), keys("edge_ids")).alias("edge_ids"),
        F.when(in_("branch_routes", "route_segments"), keys("candidate_ids")).alias("candidate_ids"),
        F.when(in_("route_segments", "cross_sheet_links", "intermediate_distances"), own_page("from_page")).alias("from_page"),
        F.when(in_("route_segments"), own_page("to_page")).alias("to_page"),
        F.when(in_("cross_sheet_links", "intermediate_distances", "vertex_coordinates"), own_page("page")).alias("on_page"),
        F.when(in_("candidate_assessments"), decision).alias("local_decision"),
        F.to_json("_v").alias("item"),
    )


def valve_edges(edges: DataFrame, handwheels: DataFrame) -> DataFrame:
    """Pipe edges(page, edge_id, a, b) that handwheels(page, wheel_id, edge_id, created) lead to, with all of their wheels; edges made for a wheel are none."""
    wheels = handwheels.filter(F.col("edge_id").isNotNull() & ~F.coalesce("created", F.lit(False))).groupBy("page", "edge_id").agg(F.array_sort(F.collect_set("wheel_id")).alias("wheels"))
    return edges.join(wheels, ["page", "edge_id"]).select("page", "edge_id", "a", "b", "wheels", F.lit("valve").alias("element_type"))


def guarded(rows: DataFrame, *known: tuple[DataFrame, list[str]]) -> DataFrame:
    """Rows whose keys exist in every table named."""
    for table, keys in known:
        rows = rows.join(table.select(*keys).distinct(), keys, "left_semi")
    return rows


def lead_vertices(base: DataFrame, final: DataFrame) -> DataFrame:
    """Of a page the final vertices if there are any, else the base ones."""
    return final.unionByName(base.join(final.select("page").distinct(), "page", "left_anti"))


def coordinate_deltas(blocks: DataFrame, values: DataFrame) -> DataFrame:
    """Lengths that follow from pairs of coordinate blocks(page, block, X, Y, Z, x0, y0, x1, y1), and whether a drawing dimension among values(page, text) shows them already.

    A changed axis counts where its difference is a dimension of the page and another axis is shared (once for axis and length, of the first pair), or where it alone
    changed and two are shared; so do the two levels of a page that has just two. Equal lengths with equal boxes count once."""
    axes = ("X", "Y", "Z")
    l, r = blocks.alias("l"), blocks.alias("r")
    pairs = l.join(r, (F.col("l.page") == F.col("r.page")) & (F.col("l.block") < F.col("r.block")))
    delta = {a: F.abs(F.col(f"l.{a}") - F.col(f"r.{a}")) for a in axes}
    changed = sum(F.when(d != 0, 1).otherwise(0) for d in delta.values())
    shared = sum(F.when(d == 0, 1).otherwise(0) for d in delta.values())
    box = [F.least("l.x0", "r.x0").alias("x0"), F.least("l.y0", "r.y0").alias("y0"), F.greatest("l.x1", "r.x1").alias("x1"), F.greatest("l.y1", "r.y1").alias("y1")]
    rows = pairs.select(F.col("l.page").alias("page"), F.col("l.block").alias("left"), F.col("r.block").alias("right"), *box, changed.alias("changed"), shared.alias("shared"), F.explode(F.array(*[F.struct(F.lit(a).alias("axis"), d.alias("delta")) for a, d in delta.items()])).alias("d")).filter("d.delta > 0")
    rows = rows.withColumn("text", F.col("d.delta").cast("string"))
    shown = rows.filter("shared > 0").join(values.select("page", "text").distinct(), ["page", "text"], "left_semi")
    first = shown.withColumn("place", F.row_number().over(Window.partitionBy("page", "d.axis", "text").orderBy("left", "right"))).filter("place = 1")
    alone = rows.filter("changed = 1 and shared >= 2")
    out = ["page", "text", "x0", "y0", "x1", "y1"]
    levels = blocks.filter("Z is not null").groupBy("page").agg(F.count_distinct("Z").alias("levels"), (F.max("Z") - F.min("Z")).cast("string").alias("text"), F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1")).filter("levels = 2")
    sure = first.select(*out, F.lit(0.9).alias("confidence")).unionByName(alone.select(*out, F.lit(0.9).alias("confidence")))
    every = sure.unionByName(levels.select(*out, F.lit(0.85).alias("confidence"))).groupBy(*out).agg(F.max("confidence").alias("confidence"))
    known = values.select("page", "text").distinct().withColumn("duplicate", F.lit(True))
    return every.join(known, ["page", "text"], "left").withColumn("duplicate", F.coalesce("duplicate", F.lit(False)))


# What a person may set, and how it is told.
STATUSES = ("include", "exclude", "ambiguous")
EDIT_REASON = "Ручная правка пользователя: %s -> %s."


def manual_edits(decisions: DataFrame, edits: DataFrame) -> DataFrame:
    """edits(page, dim_id, seq, status, changed_at) with what they change: (page, dim_id, seq, old_status, new_status, reason, changed_at, rating, error), one row for each edit.

    decisions(page, dim_id, decision, status), one a candidate. Edits of a candidate count one after another: the old status is that of the last accepted edit before, else the decision, else the status. An unknown
    status is an error, then a candidate without a decision; these change nothing and are no feedback, all others rate the answer down."""
    joined = edits.join(decisions.select("page", "dim_id", F.col("status").alias("had"), "decision", F.lit(True).alias("known")), ["page", "dim_id"], "left")
    valid = F.coalesce(F.col("status").isin(*STATUSES), F.lit(False))
    joined = joined.withColumn("error", F.when(~valid, "invalid_status").when(F.col("known").isNull(), "not_found"))
    fits = F.col("error").isNull()
    before = F.last(F.when(fits, F.col("status")), ignorenulls=True).over(Window.partitionBy("page", "dim_id").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1))
    out = joined.withColumn("old_status", F.when(fits, F.coalesce(before, "decision", "had")))
    return out.select("page", "dim_id", "seq", "old_status", F.col("status").alias("new_status"), F.when(fits, F.format_string(EDIT_REASON, "old_status", "status")).alias("reason"), "changed_at", F.when(fits, "down").alias("rating"), "error")


def edited_decisions(decisions: DataFrame, log: DataFrame) -> DataFrame:
    """Decisions after the accepted edits of manual_edits, with the last one's status and reason; the rest stay."""
    last = log.filter("error is null").groupBy("page", "dim_id").agg(F.max_by(F.struct("new_status", "reason"), "seq").alias("e"), F.count(F.lit(1)).alias("edits"))
    kept = [c for c in decisions.columns if c not in ("decision", "reason")]
    return decisions.join(last, ["page", "dim_id"], "left").select(*kept, F.coalesce("e.new_status", "decision").alias("decision"), F.coalesce("e.reason", "reason").alias("reason"), F.coalesce("edits", F.lit(0)).alias("edits"))
