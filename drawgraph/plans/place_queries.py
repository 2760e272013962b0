"""Further joins by place: anchors, touching edges, snapped misses, leaders and conflicts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geometry as g
from ..operators import spatial
from ..sources import tables as t
from .registry import query
from .spatial_queries import _THIN, _lines

_NEAREST = """placed as (select *, case when len2 <= 0 then 0.0::double else least(1.0::double, greatest(0.0::double, ((px - x0) * sx + (py - y0) * sy) / len2)) end as t from pairs),
far as (select *, (px - (x0 + t * sx)) * (px - (x0 + t * sx)) + (py - (y0 + t * sy)) * (py - (y0 + t * sy)) as d2 from placed)"""
_PIPES = "pipes as (select page as p, stroke_id as edge_id, x0, y0, x1 - x0 as sx, y1 - y0 as sy, (x1 - x0) * (x1 - x0) + (y1 - y0) * (y1 - y0) as len2 from axes)"


@query(t.with_views(_PIPES + """, e as (select page, stroke_id, 0 as "end", x0 as px, y0 as py from thin union all select page, stroke_id, 1, x1, y1 from thin), pairs as (select * from e left join pipes on p = page), """ + _NEAREST + """,
v as (select page, dim_id as vertex, cx, cy from dims), n as (select e.page, stroke_id, "end", vertex, row_number() over (partition by e.page, stroke_id, "end" order by (px - cx) * (px - cx) + (py - cy) * (py - cy), vertex) as k from e left join v on v.page = e.page)
select f.page, f.stroke_id, f."end", f.edge_id, n.vertex from (select *, row_number() over (partition by page, stroke_id, "end" order by d2, edge_id) as k from far) f join n using (page, stroke_id, "end") where f.k = 1 and n.k = 1""", "strokes", "axes", "thin", "dims"))  # fmt: skip
def stroke_end_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For both ends of a thin stroke the nearest pipe edge and the nearest vertex, however far."""
    s = spatial.ends(t.thin_strokes(spark, sf_dir)).select("page", "stroke_id", F.posexplode(F.array("a", "b")).alias("end", "p"))
    pipes = spatial.ends(t.axis_strokes(spark, sf_dir)).select("page", F.col("stroke_id").alias("edge_id"), "a", "b")
    v = spatial.as_segments(t.dims(spark, sf_dir).select("page", F.col("dim_id").alias("vertex"), F.col("cx").alias("x"), F.col("cy").alias("y")), "vertex")
    edge = spatial.nearest(s, pipes, "p", "edge_id").select("page", "stroke_id", "end", F.col("near_id").alias("edge_id"))
    return edge.join(spatial.nearest(s, v, "p", "vertex").select("page", "stroke_id", "end", F.col("near_id").alias("vertex")), ["page", "stroke_id", "end"])


@query(t.with_views("""n as (select distinct page as p, x0, y0 from axes), pairs as (select d.page, dim_id, x0, y0, (cx - x0) * (cx - x0) + (cy - y0) * (cy - y0) as d2 from dims d join n on p = page)
select page, dim_id, x0 as x, y0 as y from (select *, row_number() over (partition by page, dim_id order by d2, x0, y0) as k from pairs where d2 < 6400) where k = 1""", "strokes", "axes", "dims"))
def anchor_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The node nearer than 80 to a coordinate, by a grid."""
    nodes = t.axis_strokes(spark, sf_dir).select("page", "x0", "y0").distinct().select("page", F.struct("x0", "y0").alias("node"), g.point(F.col("x0"), F.col("y0")).alias("a")).withColumn("b", F.col("a"))
    points = t.dims(spark, sf_dir).select("page", "dim_id", g.point(F.col("cx"), F.col("cy")).alias("p"))
    near = spatial.gridded_within(points, nodes, "p", "node", 80.0).filter("d2 < 6400")
    return near.groupBy("page", "dim_id").agg(F.min_by("near_id", F.struct("d2", "near_id")).alias("n")).select("page", "dim_id", F.col("n.x0").alias("x"), F.col("n.y0").alias("y"))


@query(t.with_views(_PIPES + """, e as (select page, stroke_id as id, x0 as ax, y0 as ay, x1 as bx, y1 as "by", (x0 + x1) / 2 as px, (y0 + y1) / 2 as py from thin), pairs as (select * from e join pipes on p = page), """ + _NEAREST + """,
own as (select * from far qualify row_number() over (partition by page, id order by d2, edge_id) = 1),
feet as (select *, least(1.0::double, greatest(0.0::double, ((ax - x0) * sx + (ay - y0) * sy) / len2)) as ta, least(1.0::double, greatest(0.0::double, ((bx - x0) * sx + ("by" - y0) * sy) / len2)) as tb from own),
gaps as (select *, sqrt((ax - (x0 + ta * sx)) * (ax - (x0 + ta * sx)) + (ay - (y0 + ta * sy)) * (ay - (y0 + ta * sy))) as ga, sqrt((bx - (x0 + tb * sx)) * (bx - (x0 + tb * sx)) + ("by" - (y0 + tb * sy)) * ("by" - (y0 + tb * sy))) as gb from feet),
best as (select *, case when ga <= gb then ta else tb end as a, least(ga, gb) as gap from gaps)
select page, id, edge_id, round(a, 4) as "at", round(x0 + a * sx, 2) as x, round(y0 + a * sy, 2) as y, round(gap, 2) as gap from best where gap <= case when id % 2 = 0 then 35 else 20 end""", "strokes", "axes", "thin"))  # fmt: skip
def pipe_anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Thin strokes as dimension lines, their edge the pipe nearest to their middle; every second has a leader."""
    thin = spatial.ends(t.thin_strokes(spark, sf_dir))
    pipes = spatial.ends(t.axis_strokes(spark, sf_dir)).select("page", F.col("stroke_id").alias("edge_id"), "a", "b")
    middles = thin.select("page", F.col("stroke_id").alias("id"), g.point((F.col("x0") + F.col("x1")) / 2, (F.col("y0") + F.col("y1")) / 2).alias("p"))
    own = spatial.nearest(middles, pipes, "p", "edge_id").select("page", "id", F.col("near_id").alias("edge_id"))
    dims = thin.select("page", F.col("stroke_id").alias("id"), "a", "b", (F.col("stroke_id") % 2 == 0).alias("leader")).join(own, ["page", "id"])
    return spatial.pipe_anchors(dims, pipes.withColumnsRenamed({"a": "c", "b": "d"}))


@query(t.with_views("""e as (select page, stroke_id, x0 as x, y0 as y from axes union select page, stroke_id, x1, y1 from axes)
select distinct l.page, l.stroke_id as first_id, r.stroke_id as second_id from e l join e r on l.page = r.page and l.stroke_id < r.stroke_id and (l.x - r.x) * (l.x - r.x) + (l.y - r.y) * (l.y - r.y) <= 144""", "strokes", "axes"))
def touching_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J39"""
    return spatial.touching(spatial.ends(t.axis_strokes(spark, sf_dir)).select("page", F.col("stroke_id").alias("edge_id"), "a", "b"))


@query(t.with_views("""m as (select page, dim_id as id, cx as ox, cy as oy, cx + 16 as px, cy as py from dims), v as (select page, stroke_id as vertex, x0 as x, y0 as y, case stroke_id % 4 when 0 then 2 when 1 then 1 when 2 then 0 end as role from axes),
pairs as (select m.page, id, vertex, role, x - ox as along, abs(y - oy) as beside, sqrt((px - x) * (px - x) + (py - y) * (py - y)) as gap from m join v on m.page = v.page)
select page, id, vertex from (select *, row_number() over (partition by page, id order by beside, role, gap, abs(along), vertex) as k from pairs where along between -6 and 90 and beside <= 6 and gap <= 22 and role is not null) where k = 1""", "strokes", "axes", "dims"))  # fmt: skip
def snapped_misses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near misses of rays to the right, snapped to a vertex beside them."""
    d, k = t.dims(spark, sf_dir), F.col("stroke_id")
    misses = d.select("page", F.col("dim_id").alias("id"), g.point(F.col("cx"), F.col("cy")).alias("o"), F.lit(1.0).alias("ux"), F.lit(0.0).alias("uy"), g.point(F.col("cx") + 16, F.col("cy")).alias("p"))
    role = F.when(k % 4 == 0, "endpoint").when(k % 4 == 1, "corner").when(k % 4 == 2, "junction").otherwise("through")
    return spatial.snapped_misses(misses, t.axis_strokes(spark, sf_dir).select("page", k.alias("vertex"), F.col("x0").alias("x"), F.col("y0").alias("y"), role.alias("role")))


@query(t.with_views(_THIN + """, pairs2 as (select page, l_id, r_id, l_id % 50 as lv, r_id % 50 as rv from measured where l_id < r_id and abs(dot / sqrt(ll * rl)) >= 0.97 and shared > 2 and delta > 22 and shared >= greatest(10.0, 0.25 * shorter) and not (centres <= 0.15 * shorter and delta <= 32)),
lost as (select page, case when lv < rv then l_id else r_id end as id, case when lv < rv then r_id else l_id end as larger, l_id, r_id from pairs2 where lv <> rv)
select page, id, arg_max(larger, row(l_id, r_id)) as conflict_with, count(*) as conflicts from lost group by page, id""", "strokes", "thin"))  # fmt: skip
def invalid_overlaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The smaller of two values that measure the same stretch is invalid."""
    lines = _lines(spark, sf_dir)
    return spatial.invalid_overlaps(spatial.overlapping_intervals(lines, "id"), lines.select("id", "value"))


@query(t.with_views("""s as (select t.page, stroke_id as id, x0, y0, x1, y1, x0 + stroke_id % 5 * 8 as lx, y0 + stroke_id % 7 * 4 as ly, x1 + stroke_id % 3 * 4 as tx, y1 as ty from thin t),
m as (select *, sqrt((x0 - lx) * (x0 - lx) + (y0 - ly) * (y0 - ly)) as da, sqrt((x1 - lx) * (x1 - lx) + (y1 - ly) * (y1 - ly)) as db from s), f as (select *, case when db >= da then x1 else x0 end as x, case when db >= da then y1 else y0 end as y from m)
select page, id, x, y, sqrt((tx - x) * (tx - x) + (ty - y) * (ty - y)) <= 5 and least(da, db) <= 28 as is_leader from f""", "strokes", "thin"))  # fmt: skip
def oriented_leaders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """R23"""
    k = F.col("stroke_id")
    s = spatial.ends(t.thin_strokes(spark, sf_dir)).select("page", k.alias("id"), "a", "b", g.point(F.col("x0") + k % 5 * 8, F.col("y0") + k % 7 * 4).alias("label"), F.array(g.point(F.col("x1") + k % 3 * 4, F.col("y1"))).alias("tips"))
    return spatial.oriented_leaders(s)


@query(t.with_views("""s as (select page, stroke_id, x0, y0, x1, y1, x1 - x0 as dx, y1 - y0 as dy, sqrt((x1 - x0) * (x1 - x0) + (y1 - y0) * (y1 - y0)) as size from thin), pairs as (
  select d.page, d.stroke_id, l.x0, l.y0, l.dx, l.dy, l.size, d.x0 as px, d.y0 as py, least(1.0::double, greatest(0.0::double, ((d.x0 - l.x0) * l.dx + (d.y0 - l.y0) * l.dy) / (l.size * l.size))) as at, abs(d.dx * l.dy - d.dy * l.dx) / (d.size * l.size) as sine
  from s d join s l on d.page = l.page and d.stroke_id <> l.stroke_id and d.size <= 30 and l.size > 40)
select distinct page, stroke_id as dim_id from pairs where sine <= 0.1 and sqrt((px - (x0 + "at" * dx)) * (px - (x0 + "at" * dx)) + (py - (y0 + "at" * dy)) * (py - (y0 + "at" * dy))) <= 30""".replace(" as at,", ' as "at",'), "strokes", "thin"))  # fmt: skip
def support_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Short dimension lines beside long parallel ones."""
    s = spatial.ends(t.thin_strokes(spark, sf_dir))
    return spatial.support_offsets(s.select("page", F.col("stroke_id").alias("dim_id"), "stroke_id", "a", "b"), s.select("page", F.col("stroke_id").alias("id"), "a", "b"))
