"""Geometry and joins by place."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geometry as g
from ..operators import spatial
from ..sources import tables as t
from .registry import query


def _dims(spark: SparkSession, sf_dir: str) -> DataFrame:
    return t.dims(spark, sf_dir).select("page", "dim_id", g.point(F.col("cx"), F.col("cy")).alias("p"))


def _at(px: str, py: str) -> str:
    """Square of a point's distance to a segment, in SQL."""
    at = f"(case when len2 <= 1e-9 then 0.0::double else least(1.0::double, greatest(0.0::double, (({px} - x0) * (x1 - x0) + ({py} - y0) * (y1 - y0)) / len2)) end)"
    return f"(({px} - (x0 + {at} * (x1 - x0))) * ({px} - (x0 + {at} * (x1 - x0))) + ({py} - (y0 + {at} * (y1 - y0))) * ({py} - (y0 + {at} * (y1 - y0))))"


_NEAR = f"""pairs as (
  select d.page, d.dim_id, s.stroke_id, {_at('cx', 'cy')} as d2 from dims d join (select *, (x1 - x0) * (x1 - x0) + (y1 - y0) * (y1 - y0) as len2 from axes) s on s.page = d.page
), best as (
  select page, dim_id, stroke_id, d2 from (select *, row_number() over (partition by page, dim_id order by d2, stroke_id) as k from pairs) where k = 1
)
"""


@query(t.with_views(_NEAR + """select d.page, d.dim_id, case when b.d2 <= 2025 then b.stroke_id end as edge_id, case when b.d2 <= 1 then 'exact' when b.d2 <= 2025 then 'projected' else 'unresolved' end as status
  from dims d left join best b on b.dim_id = d.dim_id and b.page = d.page""", "strokes", "axes", "dims"))  # fmt: skip
def nearest_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pipe edge of each number, within 45; exact within 1."""
    near = spatial.nearest(_dims(spark, sf_dir), spatial.ends(t.axis_strokes(spark, sf_dir)), "p", "stroke_id", 45.0)
    return near.select("page", "dim_id", F.col("near_id").alias("edge_id"), F.when(F.col("d2") <= 1, "exact").when(F.col("d2").isNotNull(), "projected").otherwise("unresolved").alias("status"))


@query(t.with_views(_NEAR.replace("from axes", "from thin") + "select page, dim_id, stroke_id from best where d2 < 81", "strokes", "thin", "dims"))
def attached_strokes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The dimension stroke of each label, nearer than 9."""
    near = spatial.nearest(_dims(spark, sf_dir), spatial.ends(t.thin_strokes(spark, sf_dir)), "p", "stroke_id", 9.0, strict=True)
    return near.filter("near_id is not null").select("page", "dim_id", F.col("near_id").alias("stroke_id"))


@query(t.with_views(_NEAR + "select page, dim_id, stroke_id, d2 from pairs where d2 <= 2025", "strokes", "axes", "dims"))
def strokes_within(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every pair within 45, through a grid of cells."""
    pairs = spatial.gridded_within(_dims(spark, sf_dir), spatial.ends(t.axis_strokes(spark, sf_dir)), "p", "stroke_id", 45.0)
    return pairs.select("page", "dim_id", F.col("near_id").alias("stroke_id"), "d2")


@query(t.with_views("""boxes as (
  select page, stroke_id, least(x0, x1) as bx0, least(y0, y1) as by0, greatest(x0, x1) as bx1, greatest(y0, y1) as by1 from axes
) select d.page, d.dim_id, count(b.stroke_id) as boxes, count(b.stroke_id) = 0 as free from dims d left join boxes b on b.page = d.page and cx between bx0 - 1 and bx1 + 1 and cy between by0 - 1 and by1 + 1 group by d.page, d.dim_id""", "strokes", "axes", "dims"))  # fmt: skip
def containing_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boxes that hold a number."""
    p = t.dims(spark, sf_dir).select("page", "dim_id", F.col("cx").alias("x"), F.col("cy").alias("y")).alias("p")
    s = t.axis_strokes(spark, sf_dir)
    b = s.select("page", "stroke_id", *[f("x0", "x1").alias(f"x{i}") for i, f in enumerate((F.least, F.greatest))], *[f("y0", "y1").alias(f"y{i}") for i, f in enumerate((F.least, F.greatest))]).alias("b")
    out = p.join(b, spatial.contained(p, b), "left").groupBy("p.page", "p.dim_id").agg(F.count("b.stroke_id").alias("boxes"))
    return out.withColumn("free", F.col("boxes") == 0)


@query(t.with_views("""select a.page, a.stroke_id as axis_id, b.stroke_id as thin_id, ((a.x1 - a.x0) * (b.y1 - b.y0) - (a.y1 - a.y0) * (b.x1 - b.x0)) = 0 as parallel,
  case when ((a.x1 - a.x0) * (b.y1 - b.y0) - (a.y1 - a.y0) * (b.x1 - b.x0)) <> 0 then
    ((b.x0 - a.x0) * (b.y1 - b.y0) - (b.y0 - a.y0) * (b.x1 - b.x0)) / ((a.x1 - a.x0) * (b.y1 - b.y0) - (a.y1 - a.y0) * (b.x1 - b.x0)) end as at
  from axes a join thin b on b.page = a.page""", "strokes", "axes", "thin"))  # fmt: skip
def line_crossings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where dimension lines cross pipe lines."""
    a = spatial.ends(t.axis_strokes(spark, sf_dir)).select("page", F.col("stroke_id").alias("axis_id"), "a", "b")
    b = spatial.ends(t.thin_strokes(spark, sf_dir), "c", "d").select("page", F.col("stroke_id").alias("thin_id"), "c", "d")
    pairs = a.join(b, "page")
    args = [F.col(k) for k in "abcd"]
    return pairs.select("page", "axis_id", "thin_id", (g.cross(*args) == 0).alias("parallel"), g.lines_meet_at(*args).alias("at"))


_THIN = """rows as (
  select page, stroke_id as id, x0, y0, x1, y1, cast(stroke_id % 97 as double) as off, x1 - x0 as dx, y1 - y0 as dy, (x1 - x0) * (x1 - x0) + (y1 - y0) * (y1 - y0) as len2 from thin
), pairs as (
  select l.page, l.id as l_id, r.id as r_id, l.off as l_off, r.off as r_off, l.len2 as ll, r.len2 as rl, l.dx * r.dx + l.dy * r.dy as dot, 0.0::double as l_low, l.len2 / sqrt(l.len2) as l_high,
    least((l.dx * (r.x0 - l.x0) + l.dy * (r.y0 - l.y0)) / sqrt(l.len2), (l.dx * (r.x1 - l.x0) + l.dy * (r.y1 - l.y0)) / sqrt(l.len2)) as r_low,
    greatest((l.dx * (r.x0 - l.x0) + l.dy * (r.y0 - l.y0)) / sqrt(l.len2), (l.dx * (r.x1 - l.x0) + l.dy * (r.y1 - l.y0)) / sqrt(l.len2)) as r_high
  from rows l join rows r on l.page = r.page and l.id <> r.id
), measured as (
  select *, least(l_high, r_high) - greatest(l_low, r_low) as shared, least(sqrt(ll), sqrt(rl)) as shorter, abs(l_off - r_off) as delta, abs((l_low + l_high) / 2 - (r_low + r_high) / 2) as centres from pairs
)
"""


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = spatial.ends(t.thin_strokes(spark, sf_dir))
    return s.select("page", F.col("stroke_id").alias("id"), "a", "b", (F.col("stroke_id") % 97).cast("double").alias("offset"), (F.col("stroke_id") % 50).cast("double").alias("value"))


@query(t.with_views(_THIN + """select page, l_id as left_id, r_id as right_id from measured where l_id < r_id and abs(dot / sqrt(ll * rl)) >= 0.97 and shared > 2 and delta > 22 and shared >= greatest(10.0, 0.25 * shorter)
  and not (centres <= 0.15 * shorter and delta <= 32)""", "strokes", "thin"))  # fmt: skip
def overlapping_dimensions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dimension lines that measure the same stretch at a distance."""
    return spatial.overlapping_intervals(_lines(spark, sf_dir), "id").drop("shared")


@query(t.with_views(_THIN + """, nested as (
  select page, l_id, r_id from measured where r_high - r_low > 0 and greatest(0.0, shared) >= 0.82 * (r_high - r_low) and greatest(l_low - r_low, r_high - l_high, 0.0) <= greatest(8.0, 0.08 * greatest(1.0, l_high - l_low))
) select page, r_id as id, max(l_id) as conflict_with, count(*) as covers from nested where r_id % 50 < l_id % 50 group by page, r_id""", "strokes", "thin"))  # fmt: skip
def covered_dimensions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Smaller values along larger ones; the last of them in order is the conflict."""
    pairs = spatial.nested_intervals(_lines(spark, sf_dir)).filter("inner_value < outer_value")
    return pairs.groupBy("page", F.col("inner_id").alias("id")).agg(F.max("outer_id").alias("conflict_with"), F.count(F.lit(1)).alias("covers"))


@query(t.with_views("""rows as (
  select page, dim_id as id, local_decision as decision, [dim_id % 3, 3 + dim_id % 2] || case when local_decision = 'exclude' then [9] else [] end as strokes, dim_id % 2 = 0 as leader from dims
) select i.page, i.id, min(e.id) as conflict_with from rows i join rows e on i.page = e.page and i.decision = 'include' and e.decision = 'exclude' and i.leader and list_has_all(e.strokes, i.strokes) group by i.page, i.id""", "dims"))  # fmt: skip
def shared_stroke_exclusions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J14, J15, R05"""
    base = F.array(F.col("dim_id") % 3, 3 + F.col("dim_id") % 2)
    rows = t.dims(spark, sf_dir).select("page", F.col("dim_id").alias("id"), F.col("local_decision").alias("decision"), F.when(F.col("local_decision") == "exclude", F.concat(base, F.array(F.lit(9).cast("long")))).otherwise(base).alias("strokes"), (F.col("dim_id") % 2 == 0).alias("leader"))
    return spatial.shared_strokes(rows)


@query(t.with_views("""pairs as (select l.page, l.id as label_id, v.id as value_id, row_number() over (partition by l.page, l.id order by v.x0 - l.x1, v.id) as k from letters l join letter_values v on l.page = v.page and abs(l.cy - v.cy) <= 2 and v.x0 - l.x1 between 0 and 8)
select page, label_id, value_id from pairs where k = 1""", "label_texts", "letters", "letter_values"))  # fmt: skip
def values_beside_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J08, T12"""
    w = t.coordinate_words(spark, sf_dir)
    return spatial.same_row_values(w.filter("is_label"), w.filter("not is_label"))


@query(t.with_views("""select d.page, d.dim_id from dims d where d.page % 5 <> 0 and not exists (select 1 from axes a where a.page = d.page and abs(a.x0 - d.cx) <= 20 and abs(a.y0 - d.cy) <= 20)""", "strokes", "axes", "dims"))
def free_standing_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Without excluded pages and without labels beside a pipe's start."""
    d, a = t.dims(spark, sf_dir).filter("page % 5 <> 0"), t.axis_strokes(spark, sf_dir).select(F.col("page").alias("p"), "x0", "y0")
    return d.join(a, (d["page"] == a["p"]) & (F.abs(F.col("x0") - F.col("cx")) <= 20) & (F.abs(F.col("y0") - F.col("cy")) <= 20), "left_anti").select("page", "dim_id")


_RAYS = """hits as (
  select a.page, a.stroke_id as ray_id, b.stroke_id as edge_id, (a.x0 - b.x0) * 1.0 as dx, b.x0 as ex, case when b.y1 = b.y0 then null else (a.y0 - b.y0) / (b.y1 - b.y0) end as place, b.x0 + (case when b.y1 = b.y0 then null else (a.y0 - b.y0) / (b.y1 - b.y0) end) * (b.x1 - b.x0) - a.x0 as far
  from thin a join axes b on a.page = b.page
)
"""


@query(t.with_views(_RAYS + """select page, ray_id, edge_id, far from (select *, row_number() over (partition by page, ray_id order by far, edge_id) as k from hits where place between -0.02 and 1.02 and far between -6 and 2000) where k = 1""", "strokes", "axes", "thin"))
def first_ray_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first pipe edge that a ray to the right meets."""
    rays = t.thin_strokes(spark, sf_dir).select("page", F.col("stroke_id").alias("ray_id"), g.point(F.col("x0"), F.col("y0")).alias("o"))
    edges = spatial.ends(t.axis_strokes(spark, sf_dir)).select("page", F.col("stroke_id").alias("edge_id"), "a", "b")
    hit = g.ray_hit(F.col("o"), g.point(F.lit(1.0), F.lit(0.0)), F.col("a"), F.col("b"), 2000.0)
    found = rays.join(edges, "page").select("page", "ray_id", "edge_id", hit.alias("h")).filter("h is not null")
    return spatial.ranked(found, ["page", "ray_id"], F.col("h.distance"), F.col("edge_id")).select("page", "ray_id", "edge_id", (F.col("h.distance") + 0.0).alias("far"))


@query(t.with_views("""select stroke_id, case when dx = 0 then 'Z' when dy = 0 then null else case when dx > 0 and dy < 0 then 'X' else 'Y' end end as axis, case when dx = 0 then case when dy > 0 then '+' else '-' end when dy = 0 then null when dx * dy < 0 then case when dx > 0 then '+' else '-' end end as sign
  from (select stroke_id, x1 - x0 as dx, y1 - y0 as dy from axes) where dx = 0 or abs(dx) = abs(dy)""", "strokes", "axes"))  # fmt: skip
def edge_axes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Axis and sign of an edge on the sheet."""
    s = t.axis_strokes(spark, sf_dir).select("stroke_id", (F.col("x1") - F.col("x0")).alias("dx"), (F.col("y1") - F.col("y0")).alias("dy")).filter("dx = 0 or abs(dx) = abs(dy)")
    found = g.axis_of(F.col("dx"), F.col("dy"))
    return s.select("stroke_id", found["axis"].alias("axis"), found["sign"].alias("sign"))


@query(t.with_views(_THIN + """, nested as (
  select page, l_id, r_id, ll, rl, dot from measured where r_high - r_low > 0 and greatest(0.0, shared) >= 0.82 * (r_high - r_low) and greatest(l_low - r_low, r_high - l_high, 0.0) <= greatest(8.0, 0.08 * greatest(1.0, l_high - l_low))
), ends as (
  select n.*, o.x0 as ox, o.y0 as oy, o.dx, o.dy, i.x0 as ax, i.y0 as ay, i.x1 as bx, i.y1 as b_y from nested n join rows o on o.page = n.page and o.id = n.l_id join rows i on i.page = n.page and i.id = n.r_id
), placed as (
  select *, least(1.0::double, greatest(0.0::double, (dx * (ax - ox) + dy * (ay - oy)) / ll)) as pa, least(1.0::double, greatest(0.0::double, (dx * (bx - ox) + dy * (b_y - oy)) / ll)) as pb from ends
), gaps as (
  select *, (sqrt((ax - (ox + pa * dx)) * (ax - (ox + pa * dx)) + (ay - (oy + pa * dy)) * (ay - (oy + pa * dy))) + sqrt((bx - (ox + pb * dx)) * (bx - (ox + pb * dx)) + (b_y - (oy + pb * dy)) * (b_y - (oy + pb * dy)))) / 2 as gap from placed
) select page, l_id as outer_id, r_id as inner_id from gaps where sqrt(ll) >= 1.08 * sqrt(rl) and abs(dot / sqrt(ll * rl)) >= 0.965 and gap between 6 and 38""", "strokes", "thin"))  # fmt: skip
def parallel_nested_dimensions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J12"""
    return spatial.parallel_nested(_lines(spark, sf_dir))


@query(t.with_views("""s as (select page, stroke_id as id, x0, y0, x1 - x0 as dx, y1 - y0 as dy, sqrt((x1 - x0) * (x1 - x0) + (y1 - y0) * (y1 - y0)) as size from strokes), k as (select * from s where size between 8 and 90),
pairs as (select l.page, l.id as first_id, r.id as second_id, l.x0, l.y0, l.dx, l.dy, l.dx * r.dy - l.dy * r.dx as det, (r.x0 - l.x0) * r.dy - (r.y0 - l.y0) * r.dx as n1, (l.x0 - r.x0) * l.dy - (l.y0 - r.y0) * l.dx as n2 from k l join k r on l.page = r.page and l.id < r.id and greatest(l.size, r.size) <= 2 * least(l.size, r.size)),
met as (select *, n1 / det as one, n2 / -det as two from pairs where det <> 0)
select page, first_id, second_id, x0 + one * dx as x, y0 + one * dy as y from met where one between 0.28 and 0.72 and two between 0.28 and 0.72""", "strokes"))  # fmt: skip
def crossing_legs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J24"""
    s = spatial.ends(t.strokes(spark, sf_dir)).select("page", F.col("stroke_id").alias("id"), "a", "b")
    return spatial.crossing_legs(s)


@query(t.with_views("""p as (select page, dim_id as id, cx as x, cy as y from dims), a as (select page, x0 as x, y0 as y from axes), m as (select * from p)
select page, id, x, y, case when exists (select 1 from a where a.page = p.page and sqrt((p.x - a.x) * (p.x - a.x) + (p.y - a.y) * (p.y - a.y)) <= 36) then 'arrow' else 'text' end as "by" from p
where exists (select 1 from a where a.page = p.page and sqrt((p.x - a.x) * (p.x - a.x) + (p.y - a.y) * (p.y - a.y)) <= 36) or exists (select 1 from m where m.page = p.page and m.id <> p.id and sqrt((p.x - m.x) * (p.x - m.x) + (p.y - m.y) * (p.y - m.y)) <= 95)""", "strokes", "axes", "dims"))  # fmt: skip
def near_marks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every label, with all others as texts."""
    d = t.dims(spark, sf_dir).select("page", F.col("dim_id").alias("id"), F.col("cx").alias("x"), F.col("cy").alias("y"))
    arrows = t.axis_strokes(spark, sf_dir).select("page", F.col("x0").alias("x"), F.col("y0").alias("y"))
    return spatial.near_marks(d, arrows, d, others=True)


@query(t.with_views("""p as (select *, x1 - x0 as dx, y1 - y0 as dy, (x1 - x0) * (x1 - x0) + (y1 - y0) * (y1 - y0) as len2 from axes),
pairs as (select s.page, s.seg_id, s.x0 as ax, s.y0 as ay, s.x1 as bx, s.y1 as b_y, p.x0, p.y0, p.dx, p.dy, least(1.0::double, greatest(0.0::double, ((s.x0 - p.x0) * dx + (s.y0 - p.y0) * dy) / len2)) as pa, least(1.0::double, greatest(0.0::double, ((s.x1 - p.x0) * dx + (s.y1 - p.y0) * dy) / len2)) as pb from drawn s join p on p.page = s.page),
gaps as (select page, seg_id, greatest((ax - (x0 + pa * dx)) * (ax - (x0 + pa * dx)) + (ay - (y0 + pa * dy)) * (ay - (y0 + pa * dy)), (bx - (x0 + pb * dx)) * (bx - (x0 + pb * dx)) + (b_y - (y0 + pb * dy)) * (b_y - (y0 + pb * dy))) as d2 from pairs), best as (select page, seg_id, min(d2) as d2 from gaps group by 1, 2)
select s.page, s.seg_id as id, coalesce(d2 <= 9, false) as reserved, coalesce(d2 <= 6.25, false) as on_pipe from drawn s left join best b on b.page = s.page and b.seg_id = s.seg_id""", "strokes", "axes", "thin", "drawn"))  # fmt: skip
def reserved_strokes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Drawn segments that lie on a pipe, within 3 as a handwheel's arrow would, within 2.5 as a part of it."""
    s = spatial.ends(t.drawn_segments(spark, sf_dir)).select("page", F.col("seg_id").alias("id"), "a", "b")
    pipes = spatial.ends(t.axis_strokes(spark, sf_dir), "c", "d").select("page", "c", "d")
    told = lambda most: F.coalesce(F.col("d2") <= most * most, F.lit(False))
    return spatial.gaps(s, pipes).select("page", "id", told(3.0).alias("reserved"), told(2.5).alias("on_pipe"))
