"""Joins by place: nearest, contained, overlapping, crossing. Everything is bound to a page first.

Pages have a bounded number of marks, so pairs within a page grow with the number of pages only. Those that
are many and of which few count are numbers in arrays and no rows of a table (see pages.py).
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geometry as g
from .pages import paired, spread, squared, within

#: The numbers of a segment.
_SEGMENT = ("a.x", "a.y", "b.x", "b.y")


def ends(df: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Strokes with their end points as structs."""
    return df.withColumns({a: g.point(F.col("x0"), F.col("y0")), b: g.point(F.col("x1"), F.col("y1"))})


def _squared(point: list[np.ndarray], segment: list[np.ndarray]) -> np.ndarray:
    return squared(*point, *segment)


def nearest(points: DataFrame, segments: DataFrame, point: str, key: str, most: float | None = None, strict: bool = False) -> DataFrame:
    """For each row of points(page, ..., point) the nearest of segments(page, key, a, b), least key first where they tie; null if none is within most."""
    sides = segments.select("page", F.col(key).alias("near_id"), "a", "b")
    found = paired(points, sides, (f"{point}.x", f"{point}.y"), _SEGMENT, _squared, "near_id", kind="least", distinct=True)
    own = [c for c in points.columns if c != point]
    if most is None:
        return found.select(*own, point, "near_id", "d2", "a", "b")
    within_ = F.col("d2") < most * most if strict else F.col("d2") <= most * most
    return found.select(*own, point, *[F.when(within_, F.col(c)).alias(c) for c in ("near_id", "d2", "a", "b")])


def gridded_within(points: DataFrame, segments: DataFrame, point: str, key: str, most: float) -> DataFrame:
    """All pairs within most of each other; crowded pages are swept from left to right."""

    def near(p: list[np.ndarray], s: list[np.ndarray]) -> np.ndarray:
        d2 = squared(*p, *s)
        return within(d2, d2 <= most * most)

    return paired(points, segments.select("page", F.col(key).alias("near_id"), "a", "b"), (f"{point}.x", f"{point}.y"), _SEGMENT, near, most=most)


def same_row_values(labels: DataFrame, values: DataFrame) -> DataFrame:
    """For each label the value next to it on its row: centres within 2, a gap from 0 to 8."""
    pairs = labels.alias("l").join(values.alias("v"), (F.col("l.page") == F.col("v.page")) & (F.abs(F.col("l.cy") - F.col("v.cy")) <= 2) & ((F.col("v.x0") - F.col("l.x1")).between(0, 8)))
    return pairs.groupBy(F.col("l.page").alias("page"), F.col("l.id").alias("label_id")).agg(F.min_by(F.col("v.id"), F.struct(F.col("v.x0") - F.col("l.x1"), F.col("v.id"))).alias("value_id"))


def contained(points: DataFrame, boxes: DataFrame, slack: float = 1.0) -> Column:
    """J09 as a condition between points p and boxes b of a page."""
    return (F.col("p.page") == F.col("b.page")) & F.col("p.x").between(F.col("b.x0") - slack, F.col("b.x1") + slack) & F.col("p.y").between(F.col("b.y0") - slack, F.col("b.y1") + slack)


def overlapping_intervals(rows: DataFrame, order: str) -> DataFrame:
    """Pairs of parallel dimension lines of a page that measure overlapping stretches at a distance.

    rows(page, id, a, b, offset). The shared stretch is over 2, at least 10 and a quarter of the shorter line; lines within 22 of each other's
    offset are one axis; near-equal centres within 32 are repeats."""
    m = _measured(rows)
    l, r = m.alias("l"), m.alias("r")
    pairs = l.join(r, (F.col("l.page") == F.col("r.page")) & (F.col(f"l.{order}") < F.col(f"r.{order}")))
    low, high, cosine = _along("l", "r")
    pairs = pairs.select(F.col("l.page").alias("page"), F.col("l.id").alias("left_id"), F.col("r.id").alias("right_id"), low.alias("low"), high.alias("high"), cosine.alias("cosine"), F.col("l.full").alias("size"), F.least("l.size", "r.size").alias("shorter"), F.abs(F.col("l.offset") - F.col("r.offset")).alias("delta"))
    shared = F.least("size", "high") - F.greatest(F.lit(0.0), F.col("low"))
    centres = F.abs((0 + F.col("size")) / 2 - (F.col("low") + F.col("high")) / 2)
    keep = (F.abs("cosine") >= g.ANGLE_MATCH) & (shared > 2) & (F.col("delta") > 22) & (shared >= F.greatest(F.lit(10.0), 0.25 * F.col("shorter"))) & ~((centres <= 0.15 * F.col("shorter")) & (F.col("delta") <= 32))
    return pairs.filter(keep).select("page", "left_id", "right_id", shared.alias("shared"))


def _measured(rows: DataFrame) -> DataFrame:
    """Lines (a, b) as plain numbers, so that pairs of them need few: start, end, way and length. Dealt by page over all partitions, as pairs are many beside the rows' few bytes."""
    a, b = F.col("a"), F.col("b")
    dx, dy = b["x"] - a["x"], b["y"] - a["y"]
    flat = rows.withColumns({"ax": a["x"], "ay": a["y"], "bx": b["x"], "by": b["y"], "dx": dx, "dy": dy, "ll": dx * dx + dy * dy, "size": F.sqrt(dx * dx + dy * dy)}).drop("a", "b")
    return spread(flat.withColumn("full", F.col("ll") / F.nullif("size", F.lit(0.0))), "page")


def _along(o: str, i: str) -> tuple[Column, Column, Column]:
    """G12 and the cosine of two measured lines: where line i lies along line o."""
    c = lambda t, n: F.col(f"{t}.{n}")
    size = F.nullif(c(o, "size"), F.lit(0.0))
    one, two = [(c(o, "dx") * (c(i, f"{e}x") - c(o, "ax")) + c(o, "dy") * (c(i, f"{e}y") - c(o, "ay"))) / size for e in "ab"]
    cosine = (c(o, "dx") * c(i, "dx") + c(o, "dy") * c(i, "dy")) / F.nullif(F.sqrt(c(o, "ll") * c(i, "ll")), F.lit(0.0))
    return F.least(one, two), F.greatest(one, two), cosine


def nested_intervals(rows: DataFrame) -> DataFrame:
    """Pairs (outer, inner) of a page: 82 % of the inner line lies along the outer, which it exceeds by 8 or 8 % at most."""
    m = _measured(rows)
    o, i = m.alias("o"), m.alias("i")
    pairs = o.join(i, (F.col("o.page") == F.col("i.page")) & (F.col("o.id") != F.col("i.id")))
    low, high, _ = _along("o", "i")
    pairs = pairs.select(F.col("o.page").alias("page"), F.col("o.id").alias("outer_id"), F.col("i.id").alias("inner_id"), F.col("o.value").alias("outer_value"), F.col("i.value").alias("inner_value"), low.alias("low"), high.alias("high"), F.col("o.full").alias("size"))
    child = F.col("high") - F.col("low")
    overlap = F.greatest(F.lit(0.0), F.least("size", "high") - F.greatest(F.lit(0.0), F.col("low")))
    over = F.greatest(-F.col("low"), F.col("high") - F.col("size"), F.lit(0.0))
    keep = (child > 0) & (overlap >= 0.82 * child) & (over <= F.greatest(F.lit(8.0), 0.08 * F.greatest(F.lit(1.0), F.col("size"))))
    return pairs.filter(keep).drop("low", "high", "size")


def shared_strokes(rows: DataFrame) -> DataFrame:
    """Included rows(page, id, decision, strokes, leader) whose strokes an excluded row has too: all of them, or for leaders as part of more."""
    i, e = rows.filter("decision = 'include'").alias("i"), rows.filter("decision = 'exclude'").alias("e")
    same = F.array_sort("i.strokes") == F.array_sort("e.strokes")
    part = (F.size(F.array_except("i.strokes", "e.strokes")) == 0) & (F.size("i.strokes") < F.size("e.strokes"))
    pairs = i.join(e, (F.col("i.page") == F.col("e.page")) & F.arrays_overlap("i.strokes", "e.strokes") & (same | (part & F.col("i.leader"))))
    return pairs.groupBy(F.col("i.page").alias("page"), F.col("i.id").alias("id")).agg(F.min("e.id").alias("conflict_with"))


def ranked(df: DataFrame, by: list[str], *order: Column) -> DataFrame:
    """The first row of each group in a lexicographic order."""
    return df.withColumn("_place", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).filter("_place = 1").drop("_place")


def parallel_nested(rows: DataFrame) -> DataFrame:
    """Nested pairs (J11) of parallel lines, the outer 8 % longer at least, that stand 6 to 38 apart on average."""
    pairs = nested_intervals(rows)
    o, i = rows.select("page", F.col("id").alias("outer_id"), F.col("a").alias("oa"), F.col("b").alias("ob")), rows.select("page", F.col("id").alias("inner_id"), F.col("a").alias("ia"), F.col("b").alias("ib"))
    both = pairs.join(o, ["page", "outer_id"]).join(i, ["page", "inner_id"])
    oa, ob, ia, ib = (F.col(c) for c in ("oa", "ob", "ia", "ib"))
    gap = (g.to_segment(ia, oa, ob)["distance"] + g.to_segment(ib, oa, ob)["distance"]) / 2
    keep = (g.distance(oa, ob) >= 1.08 * g.distance(ia, ib)) & g.same_direction(oa, ob, ia, ib, 0.965) & (F.abs(gap - 22) <= 16)
    return both.filter(keep).select("page", "outer_id", "inner_id")


def _may_cross(first: list[np.ndarray], second: list[np.ndarray]) -> np.ndarray:
    """Which strokes crossing_legs() should look at: a little more than those that cross."""
    (ax, ay, bx, by), (cx, cy, dx, dy) = first, second
    ux, uy, vx, vy = bx - ax, by - ay, dx - cx, dy - cy
    one, other = np.sqrt(ux * ux + uy * uy), np.sqrt(vx * vx + vy * vy)
    det, wx, wy = ux * vy - uy * vx, cx - ax, cy - ay
    s, t = (wx * vy - wy * vx) / det, (wx * uy - wy * ux) / det
    return within(det, (det != 0) & (np.maximum(one, other) <= 2.001 * np.minimum(one, other)) & (s > 0.279) & (s < 0.721) & (t > 0.279) & (t < 0.721))


def crossing_legs(strokes: DataFrame) -> DataFrame:
    """Pairs of strokes(page, id, a, b) of 8 to 90, at most twice as long as each other, that cross between 28 % and 72 % of both; (page, first_id, second_id, x, y)."""
    s = strokes.select("page", "id", "a", "b", g.distance(F.col("a"), F.col("b")).alias("size")).filter(F.col("size").between(8, 90))
    pairs = paired(s, None, _SEGMENT, _SEGMENT, _may_cross, "id", kind="same").filter((F.col("id") < F.col("second_id")) & (F.greatest("size", "second_size") <= 2 * F.least("size", "second_size")))
    args = [F.col(c) for c in ("a", "b", "second_a", "second_b")]
    one, two = g.lines_meet_at(*args), g.lines_meet_at(*args[2:], *args[:2])
    out = pairs.withColumns({"one": one, "two": two}).filter(F.col("one").between(0.28, 0.72) & F.col("two").between(0.28, 0.72))
    place = lambda k: F.col("a")[k] + F.col("one") * (F.col("b")[k] - F.col("a")[k])
    return out.select("page", F.col("id").alias("first_id"), "second_id", place("x").alias("x"), place("y").alias("y"))


def near_marks(points: DataFrame, arrows: DataFrame, texts: DataFrame, arrow: float = 36.0, text: float = 95.0, others: bool = False) -> DataFrame:
    """points(page, id, x, y) with what speaks for them: an arrow (page, x, y) within 36, else a text within 95; others are left out. With others, texts have ids and none speaks for itself."""
    near = lambda marks, most, kind, apart=F.lit(True): points.alias("p").join(marks.alias("m"), (F.col("p.page") == F.col("m.page")) & (g.distance(g.point(F.col("p.x"), F.col("p.y")), g.point(F.col("m.x"), F.col("m.y"))) <= most) & apart, "left_semi").select("p.*").withColumn("by", F.lit(kind))
    first = near(arrows, arrow, "arrow")
    return first.unionByName(near(texts, text, "text", F.col("p.id") != F.col("m.id") if others else F.lit(True)).join(first.select("page", "id"), ["page", "id"], "left_anti"))


def gaps(strokes: DataFrame, pipes: DataFrame) -> DataFrame:
    """strokes(page, ..., a, b) with "d2", the square of the farther end's distance from that of pipes(page, c, d) for which it is least; null on pages without pipes."""
    farther = lambda s, p: np.maximum(squared(*s[:2], *p), squared(*s[2:], *p))
    return paired(strokes, pipes.select("page", "c", "d"), _SEGMENT, ("c.x", "c.y", "d.x", "d.y"), farther, kind="least").select(*strokes.columns, "d2")


def reserved(strokes: DataFrame, arrows: DataFrame, slack: float = 3.0) -> DataFrame:
    """strokes(page, id, a, b) both ends of which lie within slack of one of arrows(page, c, d)."""
    return gaps(strokes, arrows).filter(F.col("d2") <= slack * slack).drop("d2")


def on_pipes(strokes: DataFrame, pipes: DataFrame, slack: float = 2.5) -> DataFrame:
    """Strokes that do not lie on a pipe."""
    return gaps(strokes, pipes).filter(F.col("d2").isNull() | (F.col("d2") > slack * slack)).drop("d2")


def support_offsets(dims: DataFrame, strokes: DataFrame) -> DataFrame:
    """Attached strokes of up to 30 beside another, parallel dimension stroke of over 40 at most 30 away: (page, dim_id)."""
    small = dims.filter(g.distance(F.col("a"), F.col("b")) <= 30)
    long = strokes.select(F.col("page").alias("p"), F.col("id").alias("long_id"), F.col("a").alias("c"), F.col("b").alias("d")).filter(g.distance(F.col("c"), F.col("d")) > 40)
    beside = g.is_parallel(F.col("a"), F.col("b"), F.col("c"), F.col("d")) & (g.to_segment(F.col("a"), F.col("c"), F.col("d"))["distance"] <= 30)
    return small.join(long, (F.col("page") == F.col("p")) & (F.col("stroke_id") != F.col("long_id")) & beside, "left_semi").select("page", "dim_id")


def as_segments(points: DataFrame, key: str) -> DataFrame:
    """Points(page, key, x, y) as segments without length, for nearest()."""
    return points.select("page", key, g.point(F.col("x"), F.col("y")).alias("a"), g.point(F.col("x"), F.col("y")).alias("b"))


def pipe_anchors(dims: DataFrame, edges: DataFrame, plain: float = 20.0, led: float = 35.0) -> DataFrame:
    """Where dims(page, id, edge_id, a, b, leader) are anchored on their own edge(page, edge_id, c, d): (page, id, edge_id, at, x, y, gap). The end of the line that is nearer to it counts,
    within 20, or 35 for those with a leader; others are left out."""
    rows = dims.join(edges, ["page", "edge_id"])
    one, two = g.to_segment(F.col("a"), F.col("c"), F.col("d")), g.to_segment(F.col("b"), F.col("c"), F.col("d"))
    rows = rows.withColumn("foot", F.when(one["distance"] <= two["distance"], one).otherwise(two)).filter(F.col("foot.distance") <= F.when(F.col("leader"), led).otherwise(plain))
    return rows.select("page", "id", "edge_id", F.round("foot.at", 4).alias("at"), F.round("foot.x", 2).alias("x"), F.round("foot.y", 2).alias("y"), F.round("foot.distance", 2).alias("gap"))


def touching(edges: DataFrame, most: float = 12.0) -> DataFrame:
    """Pairs of edges(page, edge_id, a, b) of which two ends are within most of each other; pairs count once."""

    def near(one: list[np.ndarray], other: list[np.ndarray]) -> np.ndarray:
        gap = np.minimum.reduce([np.sqrt((one[i] - other[j]) * (one[i] - other[j]) + (one[i + 1] - other[j + 1]) * (one[i + 1] - other[j + 1])) for i in (0, 2) for j in (0, 2)])
        return within(gap, gap <= most)

    pairs = paired(edges.select("page", "edge_id", "a", "b"), None, _SEGMENT, _SEGMENT, near, "edge_id", kind="same").filter("edge_id < second_edge_id")
    return pairs.select("page", F.col("edge_id").alias("first_id"), F.col("second_edge_id").alias("second_id")).distinct()


def snapped_misses(misses: DataFrame, vertices: DataFrame, side: float = 6.0, away: float = 22.0, reach: float = 90.0, back: float = 6.0) -> DataFrame:
    """Near misses(page, id, o, ux, uy, p) of rays snapped to the best vertex(page, vertex, x, y, role) beside the ray and near the point: by side gap, role, gap, way along the ray."""
    pairs = misses.join(vertices, "page")
    qx, qy = F.col("x") - F.col("o")["x"], F.col("y") - F.col("o")["y"]
    along, beside = qx * F.col("ux") + qy * F.col("uy"), F.abs(qy * F.col("ux") - qx * F.col("uy"))
    gap = g.distance(F.col("p"), g.point(F.col("x"), F.col("y")))
    role = F.when(F.col("role") == "junction", 0).when(F.col("role") == "corner", 1).when(F.col("role") == "endpoint", 2)
    fits = along.between(-back, reach) & (beside <= side) & (gap <= away) & role.isNotNull()
    return pairs.filter(fits).groupBy("page", "id").agg(F.min_by("vertex", F.struct(beside, role, gap, F.abs(along), "vertex")).alias("vertex"))


def invalid_overlaps(pairs: DataFrame, values: DataFrame) -> DataFrame:
    """Of overlapping pairs(page, left_id, right_id) the one with the smaller of values(id, value) is invalid; equal ones are not. The last pair in order names the conflict."""
    l, r = values.select(F.col("id").alias("left_id"), F.col("value").alias("lv")), values.select(F.col("id").alias("right_id"), F.col("value").alias("rv"))
    lost = pairs.join(l, "left_id").join(r, "right_id").filter("lv <> rv")
    lost = lost.select("page", F.when(F.col("lv") < F.col("rv"), F.col("left_id")).otherwise(F.col("right_id")).alias("id"), F.when(F.col("lv") < F.col("rv"), F.col("right_id")).otherwise(F.col("left_id")).alias("larger"), F.struct("left_id", "right_id").alias("pos"))
    return lost.groupBy("page", "id").agg(F.max_by("larger", "pos").alias("conflict_with"), F.count(F.lit(1)).alias("conflicts"))


def oriented_leaders(strokes: DataFrame, tip: float = 5.0, start: float = 28.0) -> DataFrame:
    """strokes(page, id, a, b, label, tips): the end away from the label is the target; a leader has an arrowhead there and starts near its number."""
    to_a, to_b = g.distance(F.col("a"), F.col("label")), g.distance(F.col("b"), F.col("label"))
    target = F.when(to_b >= to_a, F.col("b")).otherwise(F.col("a"))
    rows = strokes.withColumns({"target": target, "near": F.least(to_a, to_b)})
    return rows.select("page", "id", F.col("target")["x"].alias("x"), F.col("target")["y"].alias("y"), (F.exists("tips", lambda q: g.distance(q, F.col("target")) <= tip) & (F.col("near") <= start)).alias("is_leader"))
