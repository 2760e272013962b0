"""Segments brought in step with decisions, and edges of handwheels."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import geometry as g
from ..operators import routes, spatial
from ..sources import tables as t
from .registry import query

_ROUTES = """cand as (select dim_id // 32 as line_id, 'C-' || lpad(cast(page % 1000 as varchar), 3, '0') || '-' || lpad(cast(dim_id % 10000 as varchar), 4, '0') as candidate_id, dim_id, page, 'L' || dim_id as text, cx,
  case when dim_id % 5 = 0 then 'coordinate_delta' when dim_id % 7 = 0 then 'note' else 'dimension' end as kind, value_mm as value, local_decision from dims),
parts as (select line_id, candidate_id, case when dim_id % 3 = 1 then 'branch' else 'main' end as route, dim_id as pos from cand where local_decision = 'include' union all select line_id, candidate_id, 'branch', -dim_id from cand where local_decision = 'include' and dim_id % 7 = 0),
seg as (select line_id, 'R-' || line_id || '-' || case when dim_id % 8 = 5 then 'BRANCH' else 'MAIN' end || lpad(cast((dim_id // 4) % 8 as varchar), 2, '0') as segment_id, case when dim_id % 16 = 13 then 'by hand' when dim_id % 16 <> 12 then candidate_id || case when dim_id % 2 = 0 then ' C-' || lpad(cast(page % 1000 as varchar), 3, '0') || '-' || lpad(cast((dim_id + 1) % 10000 as varchar), 4, '0') else '' end end as label,
  case when dim_id % 3 <> 0 then value + 1 end as length, case when dim_id % 3 = 0 then 'main' else 'unknown' end as route from cand where dim_id % 4 = 0 or dim_id % 8 = 5),
taken as (select line_id, 'R-' || line_id || '-MAIN' || lpad(cast(dim_id % 12 as varchar), 2, '0') || '-P01' as point_id from cand where dim_id % 5 = 2),
assigned as (select line_id, candidate_id, case when bool_or(route = 'branch') then 'branch' else 'main' end as route, min(case route when 'main' then 0 else 1 end * 1e12 + pos) as place from parts group by 1, 2),
named as (select s.line_id, s.segment_id, instr(s.label, c.candidate_id) as spot, c.candidate_id, c.kind, c.value, a.route, a.place from seg s join cand c on c.line_id = s.line_id and contains(s.label, c.candidate_id) left join assigned a on a.line_id = c.line_id and a.candidate_id = c.candidate_id),
told as (select line_id, segment_id, max_by(route, place) as new_route, min_by(value, place) filter (place is not null) as new_length, min_by(kind = 'coordinate_delta' and place is null, case kind when 'dimension' then 0 when 'coordinate_delta' then 1 else 2 end * 1000 + spot) as loose from named group by 1, 2),
todo as (select *, row_number() over (partition by line_id, route order by place) as k from assigned a where not exists (select 1 from named n where n.line_id = a.line_id and n.candidate_id = a.candidate_id)),
numbers as (select line_id, route, 'R-' || line_id || '-' || upper(route) || case when i < 10 then '0' else '' end || i as segment_id, i from (select distinct line_id, route from todo), range(0, 100) r(i) where i >= case route when 'branch' then 1 else 0 end),
free as (select line_id, route, segment_id, row_number() over (partition by line_id, route order by i) as k from numbers n where not exists (select 1 from seg s where s.segment_id = n.segment_id)),
made as (select d.line_id, f.segment_id, d.candidate_id, d.route, c.page, c.text, c.cx, c.value from todo d join free f on f.line_id = d.line_id and f.route = d.route and f.k = d.k join cand c on c.line_id = d.line_id and c.candidate_id = d.candidate_id)
"""


def _reconciled(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Eight of 32 numbers make a line; segments name their own candidate and the next one, no candidate or nothing, and hold some numbers that new ones would take."""
    k = F.col("dim_id")
    number = lambda c, n: F.lpad(c.cast("string"), n, "0")
    cid = lambda d: F.concat(F.lit("C-"), number(F.col("page") % 1000, 3), F.lit("-"), number(d % 10000, 4))
    cand = t.dims(spark, sf_dir).select(F.floor(k / 32).alias("line_id"), cid(k).alias("candidate_id"), "dim_id", "page", F.concat(F.lit("L"), k).alias("text"), F.struct(F.col("cx").alias("x0")).alias("box"), F.when(k % 5 == 0, "coordinate_delta").when(k % 7 == 0, "note").otherwise("dimension").alias("kind"), F.col("value_mm").alias("value"), "local_decision")
    kept = cand.filter("local_decision = 'include'")
    parts = kept.select("line_id", "candidate_id", F.when(k % 3 == 1, "branch").otherwise("main").alias("route"), k.alias("pos")).unionByName(kept.filter(k % 7 == 0).select("line_id", "candidate_id", F.lit("branch").alias("route"), (-k).alias("pos")))
    label = F.when(k % 16 == 13, "by hand").when(k % 16 != 12, F.concat("candidate_id", F.when(k % 2 == 0, F.concat(F.lit(" "), cid(k + 1))).otherwise("")))
    name = F.concat(F.lit("R-"), "line_id", F.lit("-"), F.when(k % 8 == 5, "BRANCH").otherwise("MAIN"), number(F.floor(k / 4) % 8, 2))
    seg = cand.filter((k % 4 == 0) | (k % 8 == 5)).select("line_id", name.alias("segment_id"), label.alias("label"), F.when(k % 3 != 0, F.col("value") + 1).alias("length"), F.when(k % 3 == 0, "main").otherwise("unknown").alias("route"))
    points = cand.filter(k % 5 == 2).select(F.concat(F.lit("R-"), "line_id", F.lit("-MAIN"), number(k % 12, 2), F.lit("-P01")).alias("point_id"))
    return routes.reconciled(seg, cand.drop("dim_id", "local_decision"), parts, points)


@query(t.with_views(_ROUTES + """select s.line_id, s.segment_id, s.label, coalesce(s.length, t.new_length) as length, case when coalesce(t.loose, false) then 'unknown' else coalesce(t.new_route, s.route) end as route, 'kept' as origin from seg s left join told t on t.line_id = s.line_id and t.segment_id = s.segment_id
union all select line_id, segment_id, candidate_id || ' route_reconstruction ' || text, value, route, 'created' from made""", "dims"))  # fmt: skip
def route_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Segments of every line after the decisions, kept and new ones."""
    return _reconciled(spark, sf_dir)[0]


@query(t.with_views(_ROUTES + """select line_id, segment_id, segment_id || '-P0' || n as point_id, 'route ' || case n when 1 then 'start' else 'end' end as role, page, 'route_reconstruction ' || candidate_id as label, 'calculated' as source from made, (values (1), (2)) v(n)
where segment_id || '-P0' || n not in (select point_id from taken)""", "dims"))  # fmt: skip
def route_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The points of new segments."""
    return _reconciled(spark, sf_dir)[1]


@query(t.with_views(_ROUTES + "select line_id, 'A-' || segment_id as annotation_id, page, segment_id || ' ' || text as label, 'route_reconstruction_segment' as kind, cx as x0 from made", "dims"))
def route_annotations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The annotations of new segments."""
    return _reconciled(spark, sf_dir)[2].select("line_id", "annotation_id", "page", "label", "kind", F.col("box.x0").alias("x0"))


@query(t.with_views("""wheels as (select page, dim_id as id, row_number() over (partition by page order by dim_id) as pos, case when dim_id % 5 <> 0 then cx end as x, cy as y from dims),
e as (select page, stroke_id, x0, y0, x1 - x0 as dx, y1 - y0 as dy, (x1 - x0) * (x1 - x0) + (y1 - y0) * (y1 - y0) as len2 from axes),
feet as (select w.page, w.id, e.stroke_id, w.x, w.y, x0, y0, dx, dy, case when len2 = 0 then 0.0::double else least(1.0::double, greatest(0.0::double, ((w.x - x0) * dx + (w.y - y0) * dy) / len2)) end as s from wheels w join e on e.page = w.page where w.x is not null),
near as (select page, id, stroke_id, (x - (x0 + s * dx)) * (x - (x0 + s * dx)) + (y - (y0 + s * dy)) * (y - (y0 + s * dy)) as d2 from feet where d2 <= 2025),
best as (select page, id, stroke_id, d2 from near qualify row_number() over (partition by page, id order by d2, stroke_id) = 1)
select w.page, w.id, cast(w.pos as int) as pos, w.x is not null as arrow_found, case when w.x is not null then coalesce(cast(b.stroke_id as varchar), 'HW_EDGE_' || case when w.pos < 10 then '00' when w.pos < 100 then '0' else '' end || w.pos) end as edge_id, round(sqrt(b.d2), 2) as distance,
  w.x is not null and b.id is null as edge_created, case when w.x is not null then case when b.id is null then 'handwheel_attachment' else 'pipe_edge' end end as edge_kind, b.id is not null as is_pipe_edge from wheels w left join best b on b.page = w.page and b.id = w.id""", "strokes", "axes", "dims"))  # fmt: skip
def handwheel_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every label as a handwheel, a fifth without an arrow, with its pipe edge or one of its own."""
    k = F.col("dim_id")
    pos = F.row_number().over(Window.partitionBy("page").orderBy("dim_id"))
    wheels = t.dims(spark, sf_dir).select("page", k.alias("id"), pos.alias("pos"), F.when(k % 5 != 0, g.point(F.col("cx"), F.col("cy"))).alias("tip"))
    edges = spatial.ends(t.axis_strokes(spark, sf_dir)).select("page", F.col("stroke_id").alias("edge_id"), "a", "b")
    told = lambda c: F.coalesce(c, F.lit(False)).alias(c)
    return routes.handwheel_edges(wheels, edges).select("page", "id", "pos", "arrow_found", "edge_id", "distance", told("edge_created"), "edge_kind", told("is_pipe_edge"))
