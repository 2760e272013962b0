"""Rules over candidates, lines and routes: gates, filters, status changes. Each is one CASE over columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geometry as g

# Confidences and sizes that results depend on.
LEAST_CONFIDENCE, FULL_CONFIDENCE = 0.5, 0.7
SHORT_STROKE, LONG_LEADER, END_SHARE, CALLOUT_VALUE = 24.0, 55.0, 0.12, 250.0


def gate(classification: Column, confidence: Column, route: Column) -> Column:
    """struct(accepted, reason)."""
    kind = F.coalesce(classification == "route_segment", F.lit(False))
    reason = F.when(~kind, "not_route_segment").when(confidence < LEAST_CONFIDENCE, "low_confidence").when(~F.coalesce(route.isin("main", "branch"), F.lit(False)), "unknown_route").when(confidence < FULL_CONFIDENCE, "accepted_low_confidence").otherwise("accepted")
    return F.struct((kind & (confidence >= LEAST_CONFIDENCE)).alias("accepted"), reason.alias("reason"))


def base_filter(status: Column, valid: Column) -> Column:
    """What geometry alone says, in that order: invalid rows first, then handwheels."""
    bad = status.isin("cross_sheet_reference", "unresolved") | ~F.coalesce(valid, F.lit(True))
    return F.when(bad & (status == "invalid_overlap"), "exclude").when(bad, "ambiguous").when(status == "handwheel", "exclude").otherwise("include")


def preliminary(decision: Column, status: Column) -> Column:
    """The local decision, or what the status suggests where there is none."""
    return F.coalesce(decision, F.when(status.isin("exact", "projected"), "include").otherwise("ambiguous"))


def short_end_leader(kind: Column, value: Column, stroke: Column, leader: Column, at: Column) -> Column:
    """A long leader that hits the very end of a short dimension line."""
    return F.coalesce((kind == "leader_to_dimension_arrow") & (value < CALLOUT_VALUE) & (stroke <= SHORT_STROKE) & (leader >= LONG_LEADER) & ((at <= END_SHARE) | (at >= 1 - END_SHARE)), F.lit(False))


def unknown_to_null(value: Column, source: Column) -> Column:
    """A zero from an unknown source is no coordinate."""
    return F.when((source == "unknown") & (value == 0), None).otherwise(value)


def branch_routes(rows: DataFrame) -> DataFrame:
    """rows(line_id, id, accepted, route, value, isolated, evidence): unknown routes are main; small isolated ones with evidence are branches.

    Small: up to 15 % of the line's largest main value, 5 at least."""
    largest = F.max(F.when(F.col("accepted") & (F.coalesce("route", F.lit("main")) == "main"), F.col("value"))).over(Window.partitionBy("line_id"))
    small = F.col("value") <= F.greatest(0.15 * F.coalesce(largest, F.lit(0.0)), F.lit(5.0))
    return rows.withColumn("final_route", F.when(~F.col("accepted"), None).when(F.col("route") == "branch", "branch").when(small & F.col("isolated") & F.col("evidence"), "branch").otherwise("main"))


def line_results(segments: DataFrame, claims: DataFrame, tolerance: float = 0.5) -> DataFrame:
    """Sums recomputed from segments(line_id, route, length) beside claims(line_id, main, branch); unknown routes are in no sum. A row tells where they differ."""
    of = lambda r: F.sum(F.when(F.col("route") == r, F.col("length")))
    sums = segments.groupBy("line_id").agg(of("main").alias("sum_main"), of("branch").alias("sum_branch"), F.count_if(~F.coalesce(F.col("route").isin("main", "branch"), F.lit(False))).alias("unknown"))
    both = claims.join(sums, "line_id", "left")
    off = lambda r: F.coalesce(F.abs(F.col(f"sum_{r}") - F.col(r)) > tolerance, F.col(r).isNotNull() & F.col(f"sum_{r}").isNull())
    return both.withColumn("mismatch", F.array_compact(F.array(*[F.when(off(r), F.lit(r)) for r in ("main", "branch")])))


def line_states(lines: DataFrame, notes: DataFrame) -> DataFrame:
    """Critical notes call for review unless the line failed, warnings make a complete line partial; equal notes count once."""
    once = notes.dropDuplicates(["line_id", "target", "reason"]).groupBy("line_id").agg(F.bool_or(F.col("severity") == "critical").alias("critical"), F.bool_or(F.col("severity") == "warning").alias("warning"), F.count(F.lit(1)).alias("notes"))
    joined = lines.join(once, "line_id", "left")
    state = F.when(F.col("critical") & (F.col("status") != "failed"), "needs_review").when(F.col("warning") & (F.col("status") == "complete"), "partial").otherwise(F.col("status"))
    return joined.select("line_id", "status", state.alias("state"), F.coalesce("notes", F.lit(0)).alias("notes"))


def unreferenced(candidates: DataFrame, segments: DataFrame) -> DataFrame:
    """Accepted candidates that no segment refers to become segments of their own; the rest keep theirs."""
    used = segments.select("candidate_id", F.col("length").alias("known"), "route")
    kept = candidates.join(used, "candidate_id").select("candidate_id", F.coalesce("known", "value").alias("length"), "route", F.lit("referenced").alias("origin"))
    new = candidates.filter("accepted").join(used, "candidate_id", "left_anti").select("candidate_id", F.col("value").alias("length"), F.lit("main").alias("route"), F.lit("created").alias("origin"))
    return kept.unionByName(new)


def evidence(rows: DataFrame, notes: DataFrame) -> DataFrame:
    """A candidate's reason and the notes about it, by its id."""
    joined = rows.join(notes.select(F.col("candidate_id"), F.col("reason").alias("note")), "candidate_id", "left")
    return joined.groupBy("candidate_id", "reason").agg(F.array_sort(F.collect_set("note")).alias("notes")).select("candidate_id", F.concat_ws("; ", F.array("reason"), "notes").alias("evidence"))


# Limits that results depend on, and reasons.
SAME_WAY, NESTED_WAY, LEAST_SHARED, SHARED_SHARE, SAME_AXIS, REPEATED, REPEATED_SHARE = 0.97, 0.965, 10.0, 0.25, 22.0, 32.0, 0.15
COVERED, OVER, OVER_SHARE, LONGER, BESIDE, LARGE_VALUE, LARGE_SHARE = 0.82, 8.0, 0.08, 1.08, (6.0, 38.0), 500.0, 0.18
COVERED_BY = {"end": "covered_by_short_endpoint_leader_overlap", "reference": "covered_by_shared_extension_reference", "section": "covered_by_larger_dimension_on_same_section"}


def _span(a: Column, b: Column, o: Column, u: Column) -> Column:
    """struct(low, high) of a segment along unit vector u from o."""
    along = [(p["x"] - o["x"]) * u["x"] + (p["y"] - o["y"]) * u["y"] for p in (a, b)]
    return F.struct(F.least(*along).alias("low"), F.greatest(*along).alias("high"))


def _unit(a: Column, b: Column) -> Column:
    size = F.coalesce(F.nullif(g.distance(a, b), F.lit(0.0)), F.lit(1.0))
    return g.point((b["x"] - a["x"]) / size, (b["y"] - a["y"]) / size)


def same_contour(one: str, other: str) -> Column:
    """Whether two dimension lines, one before other in order, measure a common stretch of the contour from different lines: on one edge or on edges that follow each other."""
    p, q = (lambda c: F.col(f"{one}.{c}")), (lambda c: F.col(f"{other}.{c}"))
    follows = (p("edge_id") == q("edge_id")) | (p("to_node") == q("from_node")) | (q("to_node") == p("from_node"))
    origin = g.point(F.lit(0.0), F.lit(0.0))
    u = p("u")
    first, second = _span(p("a"), p("b"), origin, u), _span(q("a"), q("b"), origin, u)
    shared = F.least(first["high"], second["high"]) - F.greatest(first["low"], second["low"])
    sizes = [F.coalesce(F.nullif(c("size"), F.lit(0.0)), F.lit(1.0)) for c in (p, q)]
    shorter = F.least(*sizes)
    apart = F.abs(p("offset") - q("offset"))
    centres = F.abs((first["low"] + first["high"]) / 2 - (second["low"] + second["high"]) / 2)
    alike = F.abs(g.dot(p("a"), p("b"), q("a"), q("b")) / (sizes[0] * sizes[1])) >= SAME_WAY
    fits = follows & ~F.arrays_overlap(p("strokes"), q("strokes")) & alike & (shared > 2) & (shared >= F.greatest(F.lit(LEAST_SHARED), SHARED_SHARE * shorter))
    return F.coalesce(fits, F.lit(False)) & ~F.coalesce((apart <= SAME_AXIS) | ((centres <= REPEATED_SHARE * shorter) & (apart <= REPEATED)), F.lit(False))


def contains_line(whole: Column, part: Column) -> Column:
    """Whether nearly all of a line (span, from the start of another and along it) lies on that one, of length whole."""
    size = part["high"] - part["low"]
    shared = F.greatest(F.lit(0.0), F.least(whole, part["high"]) - F.greatest(F.lit(0.0), part["low"]))
    over = F.greatest(-part["low"], part["high"] - whole, F.lit(0.0))
    return (whole > 1e-6) & (size > 0) & (shared >= COVERED * size) & (over <= F.greatest(F.lit(OVER), OVER_SHARE * F.greatest(F.lit(1.0), whole)))


def nested_exclusions(dims: DataFrame, edges: DataFrame) -> DataFrame:
    """Dimensions that a larger one of their page covers: (page, id, reason, conflict_with, pairs).

    dims(page, id, value, a, b, edge_id, offset, strokes, lines, pipes, attachment, leader_size, target_at): all that are included and have a line; strokes are the parts of the line, lines and pipes
    the extension lines and the pipes they lead to. edges(page, edge_id, from_node, to_node). A smaller value goes if it lies along a larger one of its edge or contour; if it lies beside a larger parallel
    line of those, or of the same extension lines or pipes, or is a substantial part of it; if it is a long leader to the end of a short line of that edge; or if it is a large leader's with the
    same extension lines or pipes. All pairs are judged as they were; the last pair in order gives reason and conflict."""
    shaped = dims.join(edges, ["page", "edge_id"], "left").withColumns({"u": _unit(F.col("a"), F.col("b")), "size": g.distance(F.col("a"), F.col("b"))})
    i, j = shaped.alias("i"), shaped.alias("j")
    pairs = i.join(j, (F.col("i.page") == F.col("j.page")) & (F.col("i.id") < F.col("j.id")) & (F.col("i.value") != F.col("j.value"))).withColumn("contour", same_contour("i", "j"))
    fields = [*[c for c in dims.columns if c != "page"], "u", "size"]
    less = F.col("i.value") < F.col("j.value")
    side = lambda first, c: F.when(less if first else ~less, F.col(f"i.{c}")).otherwise(F.col(f"j.{c}"))
    pairs = pairs.select(F.col("i.page").alias("page"), "contour", F.struct(F.col("i.id").alias("i"), F.col("j.id").alias("j")).alias("order"), F.struct(*[side(True, c).alias(c) for c in fields]).alias("s"), F.struct(*[side(False, c).alias(c) for c in fields]).alias("l"))
    s, l = (lambda c: F.col(f"s.{c}")), (lambda c: F.col(f"l.{c}"))
    callout = F.coalesce(s("attachment") == "leader_to_dimension_arrow", F.lit(False))
    same_edge = F.coalesce(s("edge_id") == l("edge_id"), F.lit(False))
    shared = F.coalesce(F.arrays_overlap(s("lines"), l("lines")), F.lit(False)) | F.coalesce(F.arrays_overlap(s("pipes"), l("pipes")), F.lit(False))
    substantial = (s("value") >= LARGE_VALUE) & (s("value") / F.greatest(l("value"), F.lit(1.0)) >= LARGE_SHARE)
    inside = contains_line(l("size"), _span(s("a"), s("b"), l("a"), l("u")))
    sizes = [l("size"), s("size")]
    gap = (g.to_segment(s("a"), l("a"), l("b"))["distance"] + g.to_segment(s("b"), l("a"), l("b"))["distance"]) / 2
    beside = (sizes[0] > 1e-6) & (sizes[1] > 1e-6) & (sizes[0] >= sizes[1] * LONGER) & (F.abs(l("u.x") * s("u.x") + l("u.y") * s("u.y")) >= NESTED_WAY) & inside & gap.between(*BESIDE)
    on_section = ~callout & (same_edge | F.col("contour")) & inside
    parallel = ~callout & (same_edge | F.col("contour") | shared | substantial) & beside
    at_end = same_edge & short_end_leader(s("attachment"), s("value"), sizes[1], s("leader_size"), s("target_at"))
    reference = callout & (s("value") >= LARGE_VALUE) & shared
    reason = F.when(at_end, COVERED_BY["end"]).when(reference, COVERED_BY["reference"]).when(on_section | parallel, COVERED_BY["section"])
    lost = pairs.withColumn("reason", reason).filter("reason is not null")
    return lost.groupBy("page", F.col("s.id").alias("id")).agg(F.max_by(F.struct("reason", F.col("l.id").alias("conflict_with")), "order").alias("w"), F.count(F.lit(1)).alias("pairs")).select("page", "id", "w.reason", "w.conflict_with", "pairs")
