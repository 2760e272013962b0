"""Rules and assembled tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geometry as g
from ..operators import assembly, rules, spatial
from ..sources import tables as t
from .registry import query

_GATED = "select dim_id, case when dim_id % 4 <> 0 then 'route_segment' else 'support' end as kind, (dim_id % 10) / 10.0 as confidence, case dim_id % 3 when 0 then 'main' when 1 then 'branch' end as route from dims"


@query(t.with_views(f"""rows as ({_GATED}) select dim_id, kind = 'route_segment' and confidence >= 0.5 as accepted, case when kind <> 'route_segment' then 'not_route_segment' when confidence < 0.5 then 'low_confidence'
  when route is null then 'unknown_route' when confidence < 0.7 then 'accepted_low_confidence' else 'accepted' end as reason from rows""", "dims"))  # fmt: skip
def candidate_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """R01"""
    k = F.col("dim_id")
    found = rules.gate(F.when(k % 4 != 0, "route_segment").otherwise("support"), (k % 10) / 10.0, F.when(k % 3 == 0, "main").when(k % 3 == 1, "branch"))
    return t.dims(spark, sf_dir).select("dim_id", found.alias("g")).select("dim_id", "g.accepted", "g.reason")


_STATES = "select page, dim_id, value_mm, case dim_id % 7 when 0 then 'invalid_overlap' when 1 then 'handwheel' when 2 then 'unresolved' when 3 then 'cross_sheet_reference' when 4 then 'exact' else 'projected' end as status, dim_id % 7 <> 0 and dim_id % 14 <> 1 as valid from dims"


@query(t.with_views(f"""rows as ({_STATES}) select dim_id, case when status in ('cross_sheet_reference', 'unresolved') or not valid then case when status = 'invalid_overlap' then 'exclude' else 'ambiguous' end when status = 'handwheel' then 'exclude' else 'include' end as base,
  coalesce(case when dim_id % 2 = 0 then 'exclude' end, case when status in ('exact', 'projected') then 'include' else 'ambiguous' end) as preliminary,
  value_mm < 250 and dim_id % 50 <= 24 and dim_id % 90 >= 55 and (dim_id % 100 <= 12 or dim_id % 100 >= 88) as short_leader from rows""", "dims"))  # fmt: skip
def local_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """R03, R06, R22"""
    k = F.col("dim_id")
    status = F.element_at(F.array(*map(F.lit, ("invalid_overlap", "handwheel", "unresolved", "cross_sheet_reference", "exact", "projected", "projected"))), (k % 7 + 1).cast("int"))
    valid = (k % 7 != 0) & (k % 14 != 1)
    leader = rules.short_end_leader(F.lit("leader_to_dimension_arrow"), F.col("value_mm"), k % 50, k % 90, (k % 100) / 100.0)
    return t.dims(spark, sf_dir).select("dim_id", rules.base_filter(status, valid).alias("base"), rules.preliminary(F.when(k % 2 == 0, "exclude"), status).alias("preliminary"), leader.alias("short_leader"))


@query(t.with_views("""rows as (select cast(floor(page / 4) as int) as line_id, dim_id as id, dim_id % 5 <> 0 as accepted, case dim_id % 4 when 0 then 'branch' when 1 then 'main' end as route, value_mm as value, dim_id % 3 = 0 as isolated, dim_id % 2 = 0 as evidence from dims),
most as (select *, max(value) filter (accepted and coalesce(route, 'main') = 'main') over (partition by line_id) as largest from rows)
select line_id, id, case when not accepted then null when route = 'branch' then 'branch' when value <= greatest(0.15::double * coalesce(largest, 0), 5) and isolated and evidence then 'branch' else 'main' end as final_route from most""", "dims"))  # fmt: skip
def branch_routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """R07, T21"""
    k = F.col("dim_id")
    rows = t.dims(spark, sf_dir).select(F.floor(F.col("page") / 4).cast("int").alias("line_id"), k.alias("id"), (k % 5 != 0).alias("accepted"), F.when(k % 4 == 0, "branch").when(k % 4 == 1, "main").alias("route"), F.col("value_mm").alias("value"), (k % 3 == 0).alias("isolated"), (k % 2 == 0).alias("evidence"))
    return rules.branch_routes(rows).select("line_id", "id", "final_route")


@query(t.with_views("""seg as (select cast(floor(page / 4) as int) as line_id, case dim_id % 3 when 0 then 'main' when 1 then 'branch' end as route, value_mm as length from dims),
sums as (select line_id, sum(length) filter (route = 'main') as m, sum(length) filter (route = 'branch') as b, count(*) filter (route is null) as unknown from seg group by line_id)
select line_id, m as sum_main, b as sum_branch, unknown, case when line_id % 5 = 0 then 'main' else '' end || case when line_id % 10 = 0 then ',branch' when line_id % 7 = 0 and line_id % 5 <> 0 then 'branch' when line_id % 7 = 0 then ',branch' else '' end as mismatch from sums""", "dims"))  # fmt: skip
def line_sums(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Claims of every fifth, seventh and tenth line are off."""
    k = F.col("dim_id")
    seg = t.dims(spark, sf_dir).select(F.floor(F.col("page") / 4).cast("int").alias("line_id"), F.when(k % 3 == 0, "main").when(k % 3 == 1, "branch").alias("route"), F.col("value_mm").alias("length"))
    off = lambda *n: sum(F.when(F.col("line_id") % i == 0, 100.0).otherwise(0.0) for i in n)
    of = lambda r: F.sum(F.when(F.col("route") == r, F.col("length")))
    claims = seg.groupBy("line_id").agg(of("main").alias("main"), of("branch").alias("branch")).select("line_id", (F.col("main") + off(5)).alias("main"), (F.col("branch") + off(7, 10)).alias("branch"))
    return rules.line_results(seg, claims).select("line_id", "sum_main", "sum_branch", "unknown", F.array_join("mismatch", ",").alias("mismatch"))


@query(t.with_views("""notes as (select distinct line_id, page, status from run_log where status <> 'complete'), marks as (select line_id, page % 3 = 0 as crit, page % 3 = 1 as warn, page, status from notes)
select l.line_id, l.status, case when bool_or(crit) and l.status <> 'failed' then 'needs_review' when bool_or(warn) and l.status = 'complete' then 'partial' else l.status end as state, count(m.line_id) as notes
from (select distinct line_id, case line_id when 0 then 'complete' when 1 then 'failed' else 'partial' end as status from run_log) l left join marks m on m.line_id = l.line_id and m.page % 3 <> l.line_id group by l.line_id, l.status""", "run_log"))  # fmt: skip
def line_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """R14, R15"""
    log = t.run_log(spark, sf_dir)
    lines = log.select("line_id", F.when(F.col("line_id") == 0, "complete").when(F.col("line_id") == 1, "failed").otherwise("partial").alias("status")).distinct()
    severity = F.when(F.col("page") % 3 == 0, "critical").when(F.col("page") % 3 == 1, "warning").otherwise("info")
    notes = log.filter((F.col("status") != "complete") & (F.col("page") % 3 != F.col("line_id"))).select("line_id", F.col("page").alias("target"), F.col("status").alias("reason"), severity.alias("severity"))
    return rules.line_states(lines, notes)


@query(t.with_views("""cand as (select dim_id as candidate_id, value_mm as value, local_decision = 'include' as accepted from dims), seg as (select dim_id as candidate_id, case when dim_id % 8 <> 0 then value_mm + 1 end as length, 'branch' as route from dims where dim_id % 4 = 0)
select c.candidate_id, coalesce(s.length, c.value) as length, s.route, 'referenced' as origin from cand c join seg s using (candidate_id)
union all select candidate_id, value, 'main', 'created' from cand c where accepted and not exists (select 1 from seg s where s.candidate_id = c.candidate_id)""", "dims"))  # fmt: skip
def reconciled_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """R25, R27"""
    d = t.dims(spark, sf_dir)
    cand = d.select(F.col("dim_id").alias("candidate_id"), F.col("value_mm").alias("value"), (F.col("local_decision") == "include").alias("accepted"))
    seg = d.filter("dim_id % 4 = 0").select(F.col("dim_id").alias("candidate_id"), F.when(F.col("dim_id") % 8 != 0, F.col("value_mm") + 1).alias("length"), F.lit("branch").alias("route"))
    return rules.unreferenced(cand, seg)


@query(t.with_views("""notes as (select candidate_id, 'note ' || (candidate_id % 3) as note from answers where pos = 0 and candidate_id % 2 = 0 union select candidate_id, 'second' from answers where candidate_id % 5 = 0)
select t.candidate_id, array_to_string(list_concat([coalesce(t.status, 'none')], list_sort(list_distinct(list(n.note)))), '; ') as evidence from truth t left join notes n on n.candidate_id = t.candidate_id group by t.candidate_id, t.status""", "truth", "answers"))  # fmt: skip
def candidate_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """R26"""
    a = t.answers(spark, sf_dir)
    notes = a.filter("pos = 0 and candidate_id % 2 = 0").select("candidate_id", F.concat(F.lit("note "), F.col("candidate_id") % 3).alias("reason")).union(a.filter("candidate_id % 5 = 0").select("candidate_id", F.lit("second").alias("reason")))
    return rules.evidence(t.truth(spark, sf_dir).select("candidate_id", F.coalesce("status", F.lit("none")).alias("reason")), notes)


@query(t.with_views("select cast(floor(page / 4) as int) as line_id, array_to_string(list_sort(list(distinct page)), ',') as pages, count(distinct page) as n from dims where page % 11 <> 0 group by 1", "dims"))
def pages_of_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A01, J38, P04"""
    pages = t.dims(spark, sf_dir).filter("page % 11 <> 0").select("page").distinct().withColumn("line_id", F.floor(F.col("page") / 4).cast("int"))
    return assembly.lines_of_pages(pages).withColumn("pages", F.array_join("pages", ","))


_LABELS = "select page, dim_id % 3 as vertex, case dim_id % 5 when 0 then 'x' when 1 then 'y' when 2 then 'z' else 'x' end as axis, value_mm as value, dim_id as pos from dims"


@query(t.with_views(f"""labels as ({_LABELS}), firsts as (select page, vertex, min_by(value, pos) filter (axis = 'x') as x, min_by(value, pos) filter (axis = 'y') as y, min_by(value, pos) filter (axis = 'z') as z from labels group by page, vertex),
counted as (select *, (case when x is null then 0 else 1 end) + (case when y is null then 0 else 1 end) + (case when z is null then 0 else 1 end) as axes from firsts)
select *, case when axes = 3 then 0.95::double when axes > 0 then 0.7::double else 0.0::double end as confidence, case when axes = 3 then 'known' when axes > 0 then 'partial' else 'unknown' end as state from counted""".replace("labels as", "labels_ as").replace("from labels ", "from labels_ "), "dims"))  # fmt: skip
def vertex_coordinates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A17, A18, T19"""
    return assembly.vertex_coordinates(_labels(spark, sf_dir))


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("dim_id")
    axis = F.when(k % 5 == 1, "y").when(k % 5 == 2, "z").otherwise("x")
    return t.dims(spark, sf_dir).select("page", (k % 3).alias("vertex"), axis.alias("axis"), F.col("value_mm").alias("value"), k.alias("pos"))


@query(t.with_views(f"labels_ as ({_LABELS}) select page, vertex, axis, pos, kept, value as conflict from (select *, first_value(value) over (partition by page, vertex, axis order by pos) as kept from labels_) where value <> kept", "dims"))
def coordinate_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A17"""
    return assembly.coordinate_conflicts(_labels(spark, sf_dir))


@query(t.with_views("""every as (select distinct page * 10 + k as edge_id from dims cross join (values (0), (1), (2), (3)) v(k)), rows as (select c.edge_id, d.dim_id, d.value_mm from dims d join candidate_edges c on c.dim_id = d.dim_id)
select e.edge_id, coalesce(array_to_string(list_sort(list(r.dim_id) filter (r.dim_id is not null)), ','), '') as ids, sum(r.value_mm) as sum_mm, cast(count(r.dim_id) as int) as n from every e left join rows r on r.edge_id = e.edge_id group by e.edge_id""", "dims", "candidate_edges"))  # fmt: skip
def interval_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A16, A20, J33"""
    d = t.dims(spark, sf_dir)
    edges = d.select(F.explode(F.transform(F.array(*map(F.lit, range(4))), lambda k: (F.col("page") * 10 + k).cast("long"))).alias("edge_id")).distinct()
    dims = d.join(t.candidate_edges(d).drop("page"), "dim_id").filter("edge_id is not null")
    return assembly.interval_groups(edges, dims).withColumn("ids", F.array_join("ids", ","))


@query(r"""with w as (select doc_id, regexp_extract_all(text, '[^\x20\x09-\x0D]+') as w from documents), words as (select doc_id, unnest(w) as word, unnest(range(0, len(w))) as i from w)
select doc_id, i // 100 as block, (i // 10) % 10 as line, string_agg(word, ' ' order by (i * 7) % 10, i) as line_text, cast(min((i * 7) % 10) as double) as x0, cast(max((i * 7) % 10 + 1) as double) as x1 from words group by 1, 2, 3 having bool_or(contains(lower(word), 'the'))""")
def keyword_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of words that hold a keyword, in reading order, with their box."""
    words = t.supplied(spark, sf_dir, "documents").select(F.col("doc_id").alias("page"), F.posexplode(F.regexp_extract_all("text", F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))).alias("i", "text"))
    x = ((F.col("i") * 7) % 10).cast("double")
    rows = words.select("page", F.floor(F.col("i") / 100).alias("block"), (F.floor(F.col("i") / 10) % 10).alias("line"), F.col("i").alias("word_no"), x.alias("x0"), F.lit(0.0).alias("y0"), (x + 1).alias("x1"), F.lit(1.0).alias("y1"), "text")
    return assembly.text_lines(rows, "the").select(F.col("page").alias("doc_id"), "block", "line", "line_text", "x0", "x1")


@query(t.with_views("""d as (select page, list_sort(list({'dim_id': dim_id, 'value_mm': value_mm, 'local_decision': local_decision})) as dimensions from dims group by page), s as (select page, count(*) as strokes, list_sort(list(stroke_id))[:3] as first_strokes from strokes group by page)
select coalesce(d.page, s.page) as page, coalesce(len(dimensions), 0) as n_dims, coalesce(dimensions[1].dim_id, -1) as first_dim, coalesce(strokes, -1) as strokes, coalesce(array_to_string(first_strokes, ','), '') as first_strokes from d full join s on d.page = s.page""", "strokes", "dims"))  # fmt: skip
def page_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages as JSON, read again as VARIANT."""
    made = assembly.page_payloads(t.dims(spark, sf_dir), t.strokes(spark, sf_dir)).withColumn("v", F.parse_json("payload"))
    get = lambda path, kind: F.try_variant_get("v", path, kind)
    listed = get("$.first_strokes", "array<bigint>")
    return made.select("page", F.coalesce(F.size(get("$.dimensions", "array<variant>")).cast("long"), F.lit(0)).alias("n_dims"), F.coalesce(get("$.dimensions[0].dim_id", "bigint"), F.lit(-1)).alias("first_dim"), F.coalesce(get("$.strokes", "bigint"), F.lit(-1)).alias("strokes"), F.coalesce(F.array_join(listed, ","), F.lit("")).alias("first_strokes"))


@query(t.with_views("""e as (select *, (x1 - x0) * (x1 - x0) + (y1 - y0) * (y1 - y0) as len2 from axes where x1 <> x0 or y1 <> y0), near as (
  select page, stroke_id, at from (select e.page, e.stroke_id, x0, y0, x1, y1, cx, cy, least(1.0::double, greatest(0.0::double, ((cx - x0) * (x1 - x0) + (cy - y0) * (y1 - y0)) / len2)) as at from e join dims d on d.page = e.page)
  where (cx - (x0 + at * (x1 - x0))) * (cx - (x0 + at * (x1 - x0))) + (cy - (y0 + at * (y1 - y0))) * (cy - (y0 + at * (y1 - y0))) <= 196
), cuts as (select * from near union select page, stroke_id, 0.0 from e union select page, stroke_id, 1.0 from e)
select page, stroke_id as edge_id, at as "start", lead(at) over w as "end", cast(row_number() over w - 1 as int) as piece from cuts window w as (partition by page, stroke_id order by at) qualify lead(at) over w - at > 0.002""".replace(" at ", ' "at" ').replace(" at)", ' "at")').replace("(at)", '("at")').replace(", at ", ', "at" ').replace("+ at ", '+ "at" '), "strokes", "axes", "dims"))  # fmt: skip
def split_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pipe edges cut where labels touch them."""
    edges = spatial.ends(t.axis_strokes(spark, sf_dir).filter("x1 <> x0 or y1 <> y0")).select("page", F.col("stroke_id").alias("edge_id"), "a", "b")
    points = t.dims(spark, sf_dir).select("page", F.col("dim_id").alias("point_id"), g.point(F.col("cx"), F.col("cy")).alias("p"))
    return assembly.split_at_points(edges, points)


@query(t.with_views("""select 'dimension' as kind, dim_id as id, page, value_mm, null as linewidth from dims union all select 'stroke', stroke_id, page, null, linewidth from strokes""", "strokes", "dims"))
def merged_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two kinds of rows under one another."""
    d = t.dims(spark, sf_dir).select(F.lit("dimension").alias("kind"), F.col("dim_id").alias("id"), "page", "value_mm")
    s = t.strokes(spark, sf_dir).select(F.lit("stroke").alias("kind"), F.col("stroke_id").alias("id"), "page", "linewidth")
    return assembly.merged_results(d, s)
