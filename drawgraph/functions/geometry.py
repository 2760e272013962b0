"""Plane geometry as column expressions. Points are structs (x, y); segments are given by their end points.

Everything is arithmetic over doubles, so it stays in generated code; nothing is rounded on the way.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Tolerances that results depend on.
PARALLEL = 1e-9
SEGMENT_SLACK, LINE_SLACK, RAY_BACK = 0.02, 0.03, 6.0
ANGLE_MATCH, CORNER, STABLE = 0.97, -0.94, 0.72
#: Directions of the drawing's axes on a sheet, y downwards.
ISOMETRIC = {"X": (0.8660254037844386, -0.5), "Y": (0.8660254037844386, 0.5), "Z": (0.0, 1.0)}


def point(x: Column, y: Column) -> Column:
    return F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))


def size_of(dx: Column, dy: Column) -> Column:
    """Length of a difference; the root of the squares rounds once, so engines agree where the squares are exact."""
    return F.sqrt(dx * dx + dy * dy)


def distance(a: Column, b: Column) -> Column:
    """G01"""
    return size_of(a["x"] - b["x"], a["y"] - b["y"])


def dot(a: Column, b: Column, c: Column, d: Column) -> Column:
    return (b["x"] - a["x"]) * (d["x"] - c["x"]) + (b["y"] - a["y"]) * (d["y"] - c["y"])


def cross(a: Column, b: Column, c: Column, d: Column) -> Column:
    return (b["x"] - a["x"]) * (d["y"] - c["y"]) - (b["y"] - a["y"]) * (d["x"] - c["x"])


def to_segment(p: Column, a: Column, b: Column) -> Column:
    """struct(distance, at, x, y): the nearest place of a segment; at is 0 on a segment without length."""
    long = dot(a, b, a, b)
    at = F.when(long <= PARALLEL, F.lit(0.0)).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), dot(a, b, a, p) / long)))
    x, y = a["x"] + at * (b["x"] - a["x"]), a["y"] + at * (b["y"] - a["y"])
    return F.struct(F.hypot(p["x"] - x, p["y"] - y).alias("distance"), at.alias("at"), x.alias("x"), y.alias("y"))


def squared_to_segment(p: Column, a: Column, b: Column) -> Column:
    """The square of G02's distance; comparing squares needs no root."""
    long = dot(a, b, a, b)
    at = F.when(long <= PARALLEL, F.lit(0.0)).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), dot(a, b, a, p) / long)))
    dx, dy = p["x"] - (a["x"] + at * (b["x"] - a["x"])), p["y"] - (a["y"] + at * (b["y"] - a["y"]))
    return dx * dx + dy * dy


def to_rectangle(p: Column, x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    """G03"""
    zero = F.lit(0.0)
    return size_of(F.greatest(x0 - p["x"], zero, p["x"] - x1), F.greatest(y0 - p["y"], zero, p["y"] - y1))


def _meet(a: Column, b: Column, c: Column, d: Column) -> tuple[Column, Column, Column]:
    """Cross product of two directions, and where along each the lines meet."""
    det = cross(a, b, c, d)
    safe = F.nullif(det, F.lit(0.0))
    return det, cross(a, c, c, d) / safe, cross(a, c, a, b) / safe


def intersection(a: Column, b: Column, c: Column, d: Column, slack: float = SEGMENT_SLACK) -> Column:
    """Where two segments meet, each reaching slack of its length further, as a point of the first; null if they don't or are parallel."""
    det, s, t = _meet(a, b, c, d)
    inside = (F.abs(det) > PARALLEL) & s.between(-slack, 1 + slack) & t.between(-slack, 1 + slack)
    at = F.least(F.lit(1.0), F.greatest(F.lit(0.0), s))
    return F.when(inside, point(a["x"] + at * (b["x"] - a["x"]), a["y"] + at * (b["y"] - a["y"])))


def line_meets_segment(a: Column, b: Column, c: Column, d: Column, slack: float = LINE_SLACK) -> Column:
    """Where the line through c and d meets segment ab."""
    det, s, _ = _meet(a, b, c, d)
    return F.when((F.abs(det) > PARALLEL) & s.between(-slack, 1 + slack), point(a["x"] + s * (b["x"] - a["x"]), a["y"] + s * (b["y"] - a["y"])))


def lines_meet_at(a: Column, b: Column, c: Column, d: Column) -> Column:
    """The place along ab, in its lengths, where the lines meet."""
    det, s, _ = _meet(a, b, c, d)
    return F.when(F.abs(det) > PARALLEL, s)


def contact(a: Column, b: Column, c: Column, d: Column) -> Column:
    """struct(gap, x, y) of stroke ab on edge cd: their meeting, else the nearer end's place on the edge."""
    hit = intersection(c, d, a, b)
    one, two = to_segment(a, c, d), to_segment(b, c, d)
    nearer = F.when(one["distance"] <= two["distance"], one).otherwise(two)
    return F.struct(F.when(hit.isNotNull(), F.lit(0.0)).otherwise(nearer["distance"]).alias("gap"), F.coalesce(hit["x"], nearer["x"]).alias("x"), F.coalesce(hit["y"], nearer["y"]).alias("y"))


def ray_hit(o: Column, u: Column, a: Column, b: Column, most: Column | float, back: float = RAY_BACK) -> Column:
    """struct(distance, at) where a ray from o along unit vector u meets segment ab."""
    det = u["x"] * (b["y"] - a["y"]) - u["y"] * (b["x"] - a["x"])
    safe = F.nullif(det, F.lit(0.0))
    far = ((a["x"] - o["x"]) * (b["y"] - a["y"]) - (a["y"] - o["y"]) * (b["x"] - a["x"])) / safe
    at = ((a["x"] - o["x"]) * u["y"] - (a["y"] - o["y"]) * u["x"]) / safe
    return F.when((F.abs(det) > PARALLEL) & far.between(-back, most) & at.between(-SEGMENT_SLACK, 1 + SEGMENT_SLACK), F.struct(far.alias("distance"), at.alias("at")))


def ray_near_miss(o: Column, u: Column, a: Column, b: Column, most: Column | float, side: float) -> Column:
    """struct(side_gap, reach, distance, x, y) of the best of both ends and the place where ab crosses the ray's line, none behind its start."""

    def seen(p: Column) -> Column:
        ahead = (p["x"] - o["x"]) * u["x"] + (p["y"] - o["y"]) * u["y"]
        off = F.abs((p["x"] - o["x"]) * u["y"] - (p["y"] - o["y"]) * u["x"])
        return F.struct(off.alias("side_gap"), F.abs(ahead).alias("reach"), ahead.alias("distance"), p["x"].alias("x"), p["y"].alias("y"))

    end = point(o["x"] + u["x"], o["y"] + u["y"])
    middle = line_meets_segment(a, b, o, end, SEGMENT_SLACK)
    places = F.array_compact(F.array(seen(a), seen(b), F.when(middle.isNotNull(), seen(middle))))
    return F.array_min(F.filter(places, lambda p: (p["side_gap"] <= side) & p["distance"].between(0.0, most)))


def parallel_sine(a: Column, b: Column, c: Column, d: Column) -> Column:
    """1 for segments without length."""
    size = F.sqrt(dot(a, b, a, b) * dot(c, d, c, d))
    return F.when(size <= PARALLEL, F.lit(1.0)).otherwise(F.abs(cross(a, b, c, d)) / size)


def cosine(a: Column, b: Column, c: Column, d: Column) -> Column:
    size = F.sqrt(dot(a, b, a, b) * dot(c, d, c, d))
    return dot(a, b, c, d) / F.when(size == 0, F.lit(1.0)).otherwise(size)


def same_direction(a: Column, b: Column, c: Column, d: Column, least: float = ANGLE_MATCH) -> Column:
    """G11"""
    return F.abs(cosine(a, b, c, d)) >= least


def interval_on(a: Column, b: Column, c: Column, d: Column) -> Column:
    """struct(low, high) of ab along cd, in its units from c; null if cd has no length."""
    size = size_of(d["x"] - c["x"], d["y"] - c["y"])
    along = [dot(c, d, c, p) / F.nullif(size, F.lit(0.0)) for p in (a, b)]
    return F.when(size > 1e-6, F.struct(F.least(*along).alias("low"), F.greatest(*along).alias("high")))


def outgoing(node: Column, a: Column, b: Column) -> Column:
    """The direction in which a segment leaves the end that is nearer to a node."""
    near_a = distance(node, a) <= distance(node, b)
    return F.when(near_a, point(b["x"] - a["x"], b["y"] - a["y"])).otherwise(point(a["x"] - b["x"], a["y"] - b["y"]))


def is_corner(u: Column, v: Column) -> Column:
    """Two directions that leave a node do not run on straight."""
    size = size_of(u["x"], u["y"]) * size_of(v["x"], v["y"])
    return (size > 0) & ((u["x"] * v["x"] + u["y"] * v["y"]) / F.nullif(size, F.lit(0.0)) > CORNER)


def is_frame_line(a: Column, b: Column, width: Column, height: Column) -> Column:
    """Long lines along the margins."""
    long = distance(a, b) > 0.5 * F.greatest(width, height)
    side = ((F.least(a["x"], b["x"]) < 0.06 * width) & (F.greatest(a["x"], b["x"]) < 0.06 * width)) | (F.least(a["x"], b["x"]) > 0.95 * width)
    edge = (F.greatest(a["y"], b["y"]) < 0.06 * height) | (F.least(a["y"], b["y"]) > 0.95 * height)
    return long & (side | edge)


def box_union(p: Column, q: Column) -> Column:
    """Of boxes (x0, y0, x1, y1)."""
    return F.struct(F.least(p["x0"], q["x0"]).alias("x0"), F.least(p["y0"], q["y0"]).alias("y0"), F.greatest(p["x1"], q["x1"]).alias("x1"), F.greatest(p["y1"], q["y1"]).alias("y1"))


def box_centre(p: Column) -> Column:
    return point((p["x0"] + p["x1"]) / 2, (p["y0"] + p["y1"]) / 2)


def boxes_close(p: Column, q: Column, most: float = 3.0) -> Column:
    return F.greatest(*[F.abs(p[k] - q[k]) for k in ("x0", "y0", "x1", "y1")]) <= most


def boxes_overlap(p: Column, q: Column, slack: float = 0.0) -> Column:
    """G17"""
    return (p["x0"] <= q["x1"] + slack) & (q["x0"] <= p["x1"] + slack) & (p["y0"] <= q["y1"] + slack) & (q["y0"] <= p["y1"] + slack)


def box_inside(inner: Column, outer: Column, slack: float = 1.0) -> Column:
    return (inner["x0"] >= outer["x0"] - slack) & (inner["y0"] >= outer["y0"] - slack) & (inner["x1"] <= outer["x1"] + slack) & (inner["y1"] <= outer["y1"] + slack)


def path_length(path: Column) -> Column:
    """Of an array of points."""
    steps = F.zip_with(F.slice(path, F.lit(1), F.greatest(F.size(path) - 1, F.lit(0))), F.slice(path, F.lit(2), F.greatest(F.size(path) - 1, F.lit(0))), distance)
    return F.aggregate(steps, F.lit(0.0), lambda a, x: a + x)


def path_is_stable(path: Column, least: float = STABLE) -> Column:
    """Every step keeps to the overall direction and to that of the step before."""
    whole = lambda p, q: cosine(p, q, F.get(path, F.lit(0)), F.element_at(path, -1))
    n = F.size(path)
    steps = F.slice(F.transform(path, lambda p, i: F.struct(p.alias("p"), F.get(path, i + 1).alias("q"), F.when(i > 0, F.get(path, i - 1)).alias("o"))), F.lit(1), F.greatest(n - 1, F.lit(0)))
    return F.forall(steps, lambda s: (whole(s["p"], s["q"]) >= least) & F.coalesce(cosine(s["o"], s["p"], s["p"], s["q"]) >= least, F.lit(True)))


def gap_follows(target: Column, start: Column, place: Column, least: float = 0.82) -> Column:
    """What is left between a leader's end and its target keeps to the leader's direction; nothing left always does."""
    return (distance(target, place) <= PARALLEL) | (cosine(start, target, target, place) >= least)


def is_parallel(a: Column, b: Column, c: Column, d: Column, legacy: bool = False) -> Column:
    """Legacy also takes exactly perpendicular strokes."""
    sine = parallel_sine(a, b, c, d)
    return (sine <= 0.10) | (sine >= 1.0) if legacy else sine <= 0.10


def axis_of(dx: Column, dy: Column) -> Column:
    """struct(axis, sign) of a sheet vector: the axis with cosine 0.7 or more that leads the next by 0.1."""
    size = size_of(dx, dy)
    found = F.array(*[F.struct(F.abs((dx * ux + dy * uy) / F.nullif(size, F.lit(0.0))).alias("fit"), F.lit(name).alias("axis"), (dx * ux + dy * uy).alias("along")) for name, (ux, uy) in ISOMETRIC.items()])
    order = F.sort_array(found, asc=False)
    best, next_ = F.get(order, F.lit(0)), F.get(order, F.lit(1))
    return F.when((best["fit"] >= 0.7) & (best["fit"] - next_["fit"] >= 0.1), F.struct(best["axis"].alias("axis"), F.when(best["along"] >= 0, "+").otherwise("-").alias("sign")))


def values_agree(value: Column, expected: Column, least: float = 10.0, share: float = 0.05) -> Column:
    """G24 (and G22 with 8 and 15 %)."""
    return F.abs(value - expected) <= F.greatest(F.lit(least), share * F.abs(expected))


def spatial_length(dx: Column, dy: Column, dz: Column) -> Column:
    """Of a difference of coordinates."""
    return F.sqrt(dx * dx + dy * dy + dz * dz)


def first_third(a: Column, b: Column) -> Column:
    """G25"""
    return point(a["x"] + (b["x"] - a["x"]) / 3, a["y"] + (b["y"] - a["y"]) / 3)
