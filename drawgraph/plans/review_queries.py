"""Reviewers' answers beside local results."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import review, rules, spatial
from ..sources import tables as t
from .registry import query


@query(t.with_views("select sheet, candidate_id, status from (select *, row_number() over (partition by sheet, candidate_id order by pos desc) as k from answers) where k = 1", "answers"))
def last_classifications(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J01"""
    return review.last_of(t.answers(spark, sf_dir), ["sheet", "candidate_id"], "pos").select("sheet", "candidate_id", "status")


@query(t.with_views("""est as (select page, dim_id as candidate_id from dims), rev as (
  select case when dim_id % 4 = 1 then page || ':' || dim_id when dim_id % 4 = 2 then (page + 1) || ':' || dim_id else cast(dim_id as varchar) end as key, dim_id as pos, assessment from reviews join dims using (dim_id)
), other as (select string_split(key, ':')[-1] as suffix, arg_min(assessment, pos) as other from rev where contains(key, ':') group by suffix)
select page, candidate_id, coalesce(e.assessment, other) as assessment, case when e.assessment is not null then 'exact' when other is not null then 'suffix' end as matched
from est left join rev e on e.key = page || ':' || candidate_id left join other on suffix = cast(candidate_id as varchar)""", "dims", "reviews"))  # fmt: skip
def reviewed_estimates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reviews by exact key, else by what their key ends in."""
    d, k = t.dims(spark, sf_dir), F.col("dim_id")
    name = F.when(k % 4 == 1, F.concat_ws(":", "page", k)).when(k % 4 == 2, F.concat_ws(":", F.col("page") + 1, k)).otherwise(k.cast("string"))
    reviews = t.reviews(d).join(d.select("dim_id", "page"), "dim_id").select(name.alias("key"), k.alias("pos"), "assessment")
    return review.reviewed(d.select("page", k.alias("candidate_id")), reviews)


@query(t.with_views("""c as (select page, dim_id as cand_id, case when dim_id % 3 = 0 then 'coordinate_delta' when dim_id % 7 = 0 then 'dn' else 'dimension' end as kind, cast(cast(value_mm as bigint) % 40 as varchar) as text, case when dim_id % 5 = 0 then 'title_block' else 'drawing' end as zone, cx as x, cy as y, case when dim_id % 2 = 0 then 'route_segment' else 'other' end as cls from dims),
s as (select page, dim_id as seg_id, case when dim_id % 4 = 0 then [page * 8 + 1, page * 8 + 2, page * 8 + 5, page * 8 + 6] else [] end as ids, cast(cast(value_mm as bigint) % 40 as varchar) as size, case when dim_id % 4 = 1 then cx + 2 end as x, case when dim_id % 4 = 1 then cy - 3 end as y from dims),
named as (select s.page, s.seg_id, s.size, unnest(ids) as cand_id, unnest(range(len(ids))) as pos from s),
by_label as (select page, seg_id, cand_id as by_label from (select n.*, row_number() over (partition by n.page, n.seg_id order by case when kind = 'dimension' and cls = 'route_segment' then 0 when kind = 'dimension' then 1 when kind = 'coordinate_delta' then 2 else 3 end, case when c.text = n.size then 0 else 1 end, pos) as k from named n join c on c.page = n.page and c.cand_id = n.cand_id) where k = 1),
by_place as (select s.page, s.seg_id, min(c.cand_id) as by_place from s join c on s.page = c.page and abs(s.x - c.x) <= 3 and abs(s.y - c.y) <= 3 group by s.page, s.seg_id),
only_one as (select page, text as size, min(cand_id) as by_text from c where zone = 'drawing' group by page, text having count(*) = 1)
select page, seg_id, coalesce(by_label, by_place, by_text) as cand_id, case when by_label is not null then 'label' when by_place is not null then 'place' when by_text is not null then 'text' end as how
from s left join by_label using (page, seg_id) left join by_place using (page, seg_id) left join only_one using (page, size)""", "dims"))  # fmt: skip
def matched_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By label, else by place, else by a text that stands once."""
    d, k = t.dims(spark, sf_dir), F.col("dim_id")
    text = (F.col("value_mm").cast("long") % 40).cast("string")
    kind = F.when(k % 3 == 0, "coordinate_delta").when(k % 7 == 0, "dn").otherwise("dimension")
    candidates = d.select("page", k.alias("cand_id"), kind.alias("kind"), text.alias("text"), F.when(k % 5 == 0, "title_block").otherwise("drawing").alias("zone"), F.col("cx").alias("x"), F.col("cy").alias("y"), F.when(k % 2 == 0, "route_segment").otherwise("other").alias("cls"))
    ids = F.when(k % 4 == 0, F.array(*[F.col("page").cast("long") * 8 + i for i in (1, 2, 5, 6)])).otherwise(F.array().cast("array<long>"))
    segments = d.select("page", k.alias("seg_id"), ids.alias("ids"), text.alias("size"), F.when(k % 4 == 1, F.col("cx") + 2).alias("x"), F.when(k % 4 == 1, F.col("cy") - 3).alias("y"))
    return review.matched_classes(segments, candidates)


_DIAGNOSED = """v as (select page, dim_id as vertex, case when dim_id % 2 = 0 then cx end as x, case when dim_id % 3 = 0 then cy end as y, case when dim_id % 4 <> 0 then value_mm end as z from dims where dim_id % 5 <> 0),
e as (select page, stroke_id as edge_id, page * 8 + 1 + stroke_id % 3 as source, page * 8 + 4 + stroke_id % 4 as target, cast(50 + stroke_id % 900 as double) as value, x1 - x0 as dx, y1 - y0 as dy from axes where x1 = x0 or abs(x1 - x0) = abs(y1 - y0) or y1 = y0),
j as (select e.*, s.vertex as sv, t.vertex as tv, case when dx = 0 then 'Z' when dy = 0 then null when dx * dy < 0 then 'X' else 'Y' end as ax, case when dx = 0 then case when dy > 0 then '+' else '-' end when dy = 0 then null when dx * dy < 0 then case when dx > 0 then '+' else '-' end else case when dx > 0 then '+' else '-' end end as sg, t.x - s.x as d1, t.y - s.y as d2, t.z - s.z as d3
  from e left join v s on s.page = e.page and s.vertex = e.source left join v t on t.page = e.page and t.vertex = e.target),
m as (select *, case ax when 'X' then d1 when 'Y' then d2 when 'Z' then d3 end as own, coalesce(ax <> 'X' and abs(d1) > 10, false) or coalesce(ax <> 'Y' and abs(d2) > 10, false) or coalesce(ax <> 'Z' and abs(d3) > 10, false) as second from j),
w as (select *, coalesce(abs(abs(own) - value) > greatest(10.0, 0.05 * value), false) as off from m), x as (select *, coalesce(sv is not null and tv is not null and ax is not null and (off or second), false) as wrong, sv is not null and tv is not null as both_, sv is not null or tv is not null as any_ from w),
diagnosed as (select page, edge_id, case when both_ or (any_ and ax is not null) then 3 else 4 end as rule, case when any_ and not wrong then ax end as axis, case when any_ and not wrong then sg end as sign, wrong as inconsistent,
  case when not any_ then 'missing_vertex_rows' when ax is null then 'no_clear_axis' when wrong and off then 'delta_does_not_match_value' when wrong then 'second_coordinate_delta' else 'path_direction' end as reason from x)
"""


def _diagnosed(spark: SparkSession, sf_dir: str) -> DataFrame:
    d, k, n = t.dims(spark, sf_dir), F.col("dim_id"), F.col("stroke_id")
    vertices = d.filter(k % 5 != 0).select("page", k.alias("vertex"), F.when(k % 2 == 0, F.col("cx")).alias("x"), F.when(k % 3 == 0, F.col("cy")).alias("y"), F.when(k % 4 != 0, F.col("value_mm")).alias("z"))
    first = F.col("page").cast("long") * 8
    rows = t.axis_strokes(spark, sf_dir).select("page", n.alias("edge_id"), (first + 1 + n % 3).alias("source"), (first + 4 + n % 4).alias("target"), (50 + n % 900).cast("double").alias("value"), (F.col("x1") - F.col("x0")).alias("dx"), (F.col("y1") - F.col("y0")).alias("dy"))
    return review.edge_diagnostics(rows.filter("dx = 0 or dy = 0 or abs(dx) = abs(dy)"), vertices)


@query(t.with_views(_DIAGNOSED + "select * from diagnosed", "strokes", "axes", "dims"))
def edge_diagnostics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The axis of each pipe edge that lies along one of the sheet's directions, held against its ends' coordinates."""
    return _diagnosed(spark, sf_dir)


@query(t.with_views(_DIAGNOSED + "select page, count(*) as edges_total, count(axis) as axis_filled, count(*) filter (axis is null) as axis_null, count(*) filter (inconsistent) as inconsistent from diagnosed group by page", "strokes", "axes", "dims"))
def diagnostics_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A19"""
    return review.diagnostics_summary(_diagnosed(spark, sf_dir))


@query(t.with_views("""v as (select page, dim_id as vertex, cx as x, case when dim_id % 2 = 0 then cy end as y, cast(null as double) as z, case dim_id % 3 when 0 then 0.95 when 1 then 0.7 else 0.0 end as confidence from dims where dim_id % 4 <> 1),
r as (select page, dim_id as vertex, value_mm as rx, cx as ry, case when dim_id % 2 = 1 then cy end as rz from dims where dim_id % 4 <> 2)
select page, vertex, case when ok then coalesce(x, rx) else coalesce(rx, x) end as x, case when ok then coalesce(y, ry) else coalesce(ry, y) end as y, case when ok then coalesce(z, rz) else coalesce(rz, z) end as z, case when ok then 'local' when coalesce(rx, ry, rz) is not null then 'reviewer' else 'none' end as origin
from (select page, vertex, v.* exclude (page, vertex), r.* exclude (page, vertex), coalesce(confidence >= 0.7, false) as ok from v full join r using (page, vertex))""", "dims"))  # fmt: skip
def preferred_coordinates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J37"""
    d, k = t.dims(spark, sf_dir), F.col("dim_id")
    local = d.filter(k % 4 != 1).select("page", k.alias("vertex"), F.col("cx").alias("x"), F.when(k % 2 == 0, F.col("cy")).alias("y"), F.lit(None).cast("double").alias("z"), F.when(k % 3 == 0, 0.95).when(k % 3 == 1, 0.7).otherwise(0.0).alias("confidence"))
    told = d.filter(k % 4 != 2).select("page", k.alias("vertex"), F.col("value_mm").alias("rx"), F.col("cx").alias("ry"), F.when(k % 2 == 1, F.col("cy")).alias("rz"))
    return review.preferred_coordinates(local, told)


@query(t.with_views("""select dim_id, edge_id, coalesce(case when dim_id % 3 = 0 then 'include' when dim_id % 3 = 1 then nullif(' ', ' ') end, local_decision) as decision, coalesce(case when dim_id % 2 = 0 then 'own' end, 'status ' || local_decision) as reason from candidate_edges join dims using (dim_id)""", "dims", "candidate_edges"))
def backfilled_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates of edges with decision and reason, their own or the dimension's."""
    d, k = t.dims(spark, sf_dir), F.col("dim_id")
    own = t.candidate_edges(d).select("dim_id", "edge_id", F.when(k % 3 == 0, "include").when(k % 3 == 1, " ").alias("decision"), F.when(k % 2 == 0, "own").alias("reason"))
    return review.backfilled(own, d.withColumn("reason", F.concat(F.lit("status "), "local_decision")))


@query(t.with_views("""select dim_id, page || ':' || dim_id as candidate_key, value_mm, local_decision, case when dim_id % 6 = 0 then 'covered' when dim_id % 6 = 1 then 'unresolved' else 'resolved' end as state, case when dim_id % 4 = 0 then 'no ray' else local_decision end as reason
from dims where dim_id % 6 in (0, 1) or dim_id % 5 = 0""", "dims"))
def unresolved_dimensions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P06"""
    k = F.col("dim_id")
    rows = t.dims(spark, sf_dir).select("page", "dim_id", "value_mm", "local_decision", F.when(k % 5 != 0, F.concat(F.lit("F-"), k)).alias("interval"), F.when(k % 6 == 0, "covered").when(k % 6 != 1, "resolved").alias("state"), F.when(k % 4 == 0, "no ray").alias("reason"))
    return review.unresolved_rows(rows)


_ANSWER_SQL = """a as (select page, dim_id as k, cast(row_number() over (partition by page order by dim_id) - 1 as int) as pos, local_decision as d from dims),
e as (select page, pos, k, d, page || ':' as own, cast(page as varchar) as pg from a),
r as (select page, 'candidate_assessments' as part, pos, case k % 3 when 0 then own || k when 1 then '7:' || k else own || 'K' || k end as candidate_id, case k % 3 when 0 then own || k when 1 then '7:' || k else own || 'K' || k end as candidate_key,
  case when k % 4 = 0 then own || 'F' || k end as target_final_edge_id, null as edge_id, null as vertex_id, null as vertex_key, null as local_vertex_id, null as edge_ids, null as candidate_ids, null as from_page, null as to_page, null as on_page, d as local_decision from e
union all select page, 'unresolved_reviews', pos, own || 'K' || k, own || 'K' || k, null, null, null, null, null, null, null, null, null, null, null from e where k % 2 = 0
union all select page, 'edge_routes', pos, null, null, null, own || k, null, null, null, null, null, null, null, null, null from e
union all select page, 'branch_routes', pos, null, null, null, null, null, null, null, own || 'e' || k || ',9:x', own || k, null, null, null, null from e
union all select page, 'route_segments', pos, null, null, null, null, null, null, null, null, own || k, case when k % 2 = 0 then '5' else pg end, pg, null, null from e
union all select page, 'cross_sheet_links', pos, null, null, null, null, null, null, null, null, null, pg, null, case when k % 2 = 0 then '3' else pg end, null from e
union all select page, 'intermediate_distances', pos, case when k % 2 = 0 then own || k end, null, null, null, null, null, null, null, null, case when k % 2 = 1 then pg end, null, pg, null from e
union all select page, 'vertex_coordinates', pos, null, null, null, null, own || 'V' || k, case when k % 2 = 0 then own || 'V' || k else own || 'W' end, 'V' || k, null, null, null, null, pg, null from e)
select r.* replace (cast(row_number() over (partition by page, part order by pos) - 1 as int) as pos) from r"""


@query(t.with_views(_ANSWER_SQL, "dims"))
def answer_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JSON answers of one page each, with all of their arrays, some by their other names, and nested lists of ids."""
    k, odd = F.col("dim_id"), F.col("dim_id") % 2 == 1
    text = lambda *parts: F.concat(*[p if not isinstance(p, str) else F.lit(p) for p in parts])
    items = {
        "candidate_assessments": text("{", F.when(k % 3 == 0, text('"candidate_id":"', k, '"')).when(k % 3 == 1, text('"candidate_id":"7:', k, '","candidate_key":""')).otherwise(text('"candidate_key":"K', k, '"')), F.when(k % 4 == 0, text(',"target_final_edge_id":"F', k, '"')).otherwise(""), ',"local_decision":', F.when(odd, text('{"decision":"', F.col("local_decision"), '"}')).otherwise(text('"', F.col("local_decision"), '"')), "}"),
        "unresolved_reviews": F.when(~odd, text('{"candidate_key":"K', k, '"}')),
        "edge_routes": text('{"edge_id":', k, "}"),
        "branches": text('{"edge_ids":["e', k, '","9:x"],"candidate_ids":[', k, "]}"),
        "route_segments": text('{"candidate_ids":["', k, '"]', F.when(odd, "").otherwise(',"from_page":5'), "}"),
        "cross_sheet_links": F.when(odd, "{}").otherwise('{"page":3}'),
        "intermediate_distances": F.when(odd, '{"candidate_id":""}').otherwise(text('{"from_page":null,"candidate_id":"', k, '"}')),
        "points": F.when(odd, text('{"id":"V', k, '","vertex_key":"W"}')).otherwise(text('{"vertex_id":"V', k, '"}')),
    }
    rows = t.dims(spark, sf_dir).select("page", "dim_id", *[v.alias(n) for n, v in items.items()])
    pages = rows.groupBy("page").agg(*[F.array_sort(F.collect_list(F.when(F.col(n).isNotNull(), F.struct("dim_id", F.col(n).alias("j"))))).alias(n) for n in items])
    lists = {n: text("[", F.array_join(F.transform(n, lambda r: r["j"]), ","), "]") for n in items}
    named = [text('"', F.when(F.col("page") % 2 == 0, {"branches": "branch_routes", "points": "vertex_coordinates"}.get(n, n)).otherwise(n), '":', v) for n, v in lists.items()]
    answer = text("{", F.when(F.col("page") % 2 == 1, '"branch_routes":[],').otherwise(""), F.concat_ws(",", *named), "}")
    found = review.answer_rows(pages.select("page", answer.alias("answer")), "page", "answer")
    return found.drop("item").withColumns({c: F.array_join(c, ",") for c in ("edge_ids", "candidate_ids")})


@query(t.with_views("""w as (select page, dim_id as wheel_id, page * 800 + 101 + dim_id % 3 as edge_id, dim_id % 5 = 0 as created from dims where dim_id % 7 <> 0)
select page, stroke_id as edge_id, string_agg(wheel_id, ',' order by wheel_id) as wheels, 'valve' as element_type from axes join w on w.page = axes.page and w.edge_id = axes.stroke_id where not created group by all""".replace("select page, stroke_id", "select axes.page, stroke_id"), "strokes", "axes", "dims"))  # fmt: skip
def valve_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """R17, A20"""
    k = F.col("dim_id")
    wheels = t.dims(spark, sf_dir).filter(k % 7 != 0).select("page", k.alias("wheel_id"), (F.col("page").cast("long") * 800 + 101 + k % 3).alias("edge_id"), (k % 5 == 0).alias("created"))
    edges = spatial.ends(t.axis_strokes(spark, sf_dir)).select("page", F.col("stroke_id").alias("edge_id"), "a", "b")
    return review.valve_edges(edges, wheels).select("page", "edge_id", F.array_join("wheels", ",").alias("wheels"), "element_type")


@query(t.with_views("""select id, run_id, candidate_id, rating from feedback f where exists (select 1 from run_log r where r.run_id = f.run_id and r.status = 'complete') and exists (select 1 from run_log r where r.run_id = f.run_id and r.page = f.id % 12)""", "feedback", "run_log"))
def guarded_feedback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Feedback on runs that were completed and on pages that they have."""
    log = t.run_log(spark, sf_dir)
    rows = t.feedback(spark, sf_dir).withColumn("page", F.col("id") % 12)
    return review.guarded(rows, (log.filter("status = 'complete'"), ["run_id"]), (log, ["run_id", "page"])).select("id", "run_id", "candidate_id", "rating")


@query(t.with_views("""f as (select page, dim_id as vertex, cx as x, cy as y from dims where page % 3 <> 0), b as (select page, stroke_id as vertex, x0 as x, y0 as y from axes)
select * from f union all select * from b where page not in (select page from f)""", "strokes", "axes", "dims"))
def lead_vertices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P15"""
    final = t.dims(spark, sf_dir).filter("page % 3 <> 0").select("page", F.col("dim_id").alias("vertex"), F.col("cx").alias("x"), F.col("cy").alias("y"))
    base = t.axis_strokes(spark, sf_dir).select("page", F.col("stroke_id").alias("vertex"), F.col("x0").alias("x"), F.col("y0").alias("y"))
    return review.lead_vertices(base, final)


@query(t.with_views("""select page, count(*) as dimensions, count(*) filter (decision = 'include') as included, count(*) filter (own is null) as defaulted, true as manual_confirmation_required, false as applied
from (select *, coalesce(own, case when dim_id % 4 in (0, 1) then 'include' else 'ambiguous' end) as decision from (select *, case when dim_id % 3 <> 0 then local_decision end as own from dims)) group by page""", "dims"))
def review_objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page's dimensions with preliminary decisions, as an object that waits for a person."""
    k = F.col("dim_id")
    status = F.when(k % 4 == 0, "exact").when(k % 4 == 1, "projected").otherwise("unresolved")
    rows = t.dims(spark, sf_dir).withColumn("own", F.when(k % 3 != 0, F.col("local_decision"))).withColumn("decision", rules.preliminary(F.col("own"), status))
    out = rows.groupBy("page").agg(F.count(F.lit(1)).alias("dimensions"), F.count_if(F.col("decision") == "include").alias("included"), F.count_if(F.col("own").isNull()).alias("defaulted"))
    return out.withColumns({"manual_confirmation_required": F.lit(True), "applied": F.lit(False)})


@query(t.with_views("""select run_id, "at" as created_at, status, row_number() over (order by "at" desc, run_id) as place from (select *, row_number() over (partition by run_id order by seq desc) as k from run_log) where k = 1 and run_id is not null order by "at" desc, run_id limit 100""", "run_log"))
def newest_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The hundred newest runs in order, for a report."""
    from pyspark.sql import Window

    last = review.last_of(t.run_log(spark, sf_dir).filter("run_id is not null").select("run_id", "seq", F.col("at").alias("created_at"), "status"), ["run_id"], "seq")
    top = last.orderBy(F.desc("created_at"), "run_id").limit(100)
    return top.select("run_id", "created_at", "status", F.row_number().over(Window.orderBy(F.desc("created_at"), "run_id")).alias("place"))


_EDITED = """edits as (select page, dim_id, 1 as seq, 'include' as status from dims where dim_id % 7 = 0 union all select page, dim_id, 2, 'bogus' from dims where dim_id % 7 = 0 union all select page, dim_id, 3, 'exclude' from dims where dim_id % 14 = 0 union all select page, -dim_id - 1, 1, 'include' from dims where dim_id % 35 = 0),
log as (select e.page, e.dim_id, e.seq, e.status as new_status, case when e.status = 'bogus' then 'invalid_status' when d.dim_id is null then 'not_found' end as error, case when e.seq = 3 then 'include' else coalesce(case when d.dim_id % 2 = 0 then d.local_decision end, 'exact') end as old from edits e left join dims d on d.page = e.page and d.dim_id = e.dim_id),
told as (select page, dim_id, seq, case when error is null then old end as old_status, new_status, case when error is null then 'Ручная правка пользователя: ' || old || ' -> ' || new_status || '.' end as reason, cast(seq as bigint) as changed_at, case when error is null then 'down' end as rating, error from log)
"""


def _edited(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Decisions of all dimensions, half of them open, and up to three edits of every seventh."""
    d, k = t.dims(spark, sf_dir), F.col("dim_id")
    decisions = d.select("page", "dim_id", "value_mm", F.when(k % 2 == 0, F.col("local_decision")).alias("decision"), F.lit("exact").alias("status"), F.lit(None).cast("string").alias("reason"))
    step = lambda every, seq, status, key=k: F.when(k % every == 0, F.struct(key.alias("dim_id"), F.lit(seq).alias("seq"), F.lit(status).alias("status"), F.lit(seq).cast("long").alias("changed_at")))
    steps = F.array_compact(F.array(step(7, 1, "include"), step(7, 2, "bogus"), step(14, 3, "exclude"), step(35, 1, "include", -k - 1)))
    edits = d.select("page", F.explode(steps).alias("e")).select("page", "e.*")
    return decisions, review.manual_edits(decisions, edits)


@query(t.with_views(_EDITED + "select * from told", "dims"))
def manual_edits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each edit of a person changes, and the feedback it is."""
    return _edited(spark, sf_dir)[1]


@query(t.with_views(_EDITED + """, last as (select page, dim_id, max_by(new_status, seq) as new_status, max_by(reason, seq) as reason, count(*) as edits from told where error is null group by 1, 2)
select d.page, d.dim_id, d.value_mm, 'exact' as status, coalesce(l.new_status, case when d.dim_id % 2 = 0 then d.local_decision end) as decision, l.reason as reason, coalesce(l.edits, 0) as edits from dims d left join last l on l.page = d.page and l.dim_id = d.dim_id""", "dims"))  # fmt: skip
def edited_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All decisions after the edits."""
    return review.edited_decisions(*_edited(spark, sf_dir))


@query(t.with_views(_EDITED + """, last as (select page, dim_id, max_by(new_status, seq) as new_status from told where error is null group by 1, 2),
after as (select d.page, d.value_mm, coalesce(l.new_status, case when d.dim_id % 2 = 0 then d.local_decision end) as decision from dims d left join last l on l.page = d.page and l.dim_id = d.dim_id)
select page, coalesce(sum(value_mm) filter (decision = 'include'), 0) as clean_mm, coalesce(sum(value_mm) filter (decision in ('include', 'ambiguous')), 0) as dirty_mm, coalesce(sum(value_mm) filter (decision = 'ambiguous'), 0) as ambiguous_mm from after group by page""", "dims"))  # fmt: skip
def edited_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lengths of every page computed again after the edits; a candidate without a decision is in none."""
    after = review.edited_decisions(*_edited(spark, sf_dir))
    of = lambda *d: F.sum(F.when(F.col("decision").isin(*d), F.col("value_mm")).otherwise(0.0))
    return after.groupBy("page").agg(of("include").alias("clean_mm"), of("include", "ambiguous").alias("dirty_mm"), of("ambiguous").alias("ambiguous_mm"))
