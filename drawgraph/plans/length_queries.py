"""Decisions and lengths: the flagship query and its kin."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import lengths
from ..sources import tables as t
from .registry import query

_DECIDED = """decided as (
  select d.*, case when o.keep_local then d.local_decision when o.accept then coalesce(r.proposed, d.local_decision) when r.proposed is not null then r.proposed
    when r.assessment = 'accepted' then d.local_decision when r.assessment in ('disputed', 'insufficient') then 'ambiguous' else d.local_decision end as decision
  from dims d left join reviews r on r.dim_id = d.dim_id left join overrides o on o.dim_id = d.dim_id
)
"""
_SUMS = """sum(case when decision = 'include' then value_mm else 0 end) as clean_mm, sum(case when decision <> 'exclude' then value_mm else 0 end) as dirty_mm,
  sum(case when decision not in ('include', 'exclude') then value_mm else 0 end) as ambiguous_mm"""


def _decided(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = t.dims(spark, sf_dir)
    return lengths.decided(d, t.reviews(d), t.overrides(d))


@query(t.with_views(_DECIDED + f"select cast(floor(page / 4) as int) as line_no, {_SUMS} from decided group by 1", "dims", "reviews", "overrides"))
def effective_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """R10 and A08 by line."""
    return _decided(spark, sf_dir).groupBy(F.floor(F.col("page") / 4).cast("int").alias("line_no")).agg(*lengths.length_sums(F.col("decision"), F.col("value_mm")))


@query(t.with_views("select page, " + _SUMS.replace("decision", "local_decision") + ", count(*) as n from dims group by grouping sets ((page), ())", "dims"))
def local_length_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A08, A27 with the total row."""
    return lengths.local_summary(t.dims(spark, sf_dir))


_CANDIDATES = """rows as (
  select d.page, d.dim_id, d.value_mm, d.decision, c.kind, c.edge_id, c.coverage, c.route_type from decided d join candidate_edges c on c.dim_id = d.dim_id
), pipes as (
  select * from rows where coalesce(kind, 'pipe_length') = 'pipe_length'
), ranked as (
  select dim_id, edge_id is null or row_number() over (partition by page, edge_id order by coverage desc, value_mm desc, dim_id desc) = 1 as counted from pipes where decision = 'include'
), marked as (
  select p.*, r.counted, coalesce(route_type, 'main') as route from pipes p left join ranked r on r.dim_id = p.dim_id
)
"""


def _candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = t.dims(spark, sf_dir)
    return _decided(spark, sf_dir).select("page", "dim_id", "value_mm", "decision").join(t.candidate_edges(d).drop("page"), "dim_id")


@query(t.with_views(_DECIDED + ", " + _CANDIDATES + """select page, route, sum(case when counted then value_mm else 0 end) as clean_mm, sum(case when decision in ('include', 'ambiguous') then value_mm else 0 end) as dirty_mm,
  sum(case when decision = 'ambiguous' then value_mm else 0 end) as ambiguous_mm, count(*) filter (not counted) as duplicates from marked group by page, route""", "dims", "reviews", "overrides", "candidate_edges"))  # fmt: skip
def reviewed_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A10 with W05 and R11."""
    return lengths.reviewed_lengths(_candidates(spark, sf_dir))


@query(t.with_views(_DECIDED + """, rows as (
  select cast(floor(d.page / 4) as int) as line_no, d.value_mm, d.decision, case when c.edge_id % 10 = 2 then 'branch' else coalesce(c.route_type, 'main') end as route, case when c.edge_id % 10 = 2 then 'BR-' || (c.edge_id % 20) end as branch_id
  from decided d join candidate_edges c on c.dim_id = d.dim_id
) select line_no, route, branch_id, """ + _SUMS + ", cast(grouping(line_no, route, branch_id) as bigint) as level from rows group by rollup (line_no, route, branch_id)", "dims", "reviews", "overrides", "candidate_edges"))  # fmt: skip
def route_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A09 with R10 and R11: lines, routes, branches and the grand total."""
    rows = _candidates(spark, sf_dir)
    branch = F.when(F.col("edge_id") % 10 == 2, F.concat(F.lit("BR-"), (F.col("edge_id") % 20).cast("string")))
    rows = rows.select(F.floor(F.col("page") / 4).cast("int").alias("line_no"), "value_mm", "decision", lengths.route(F.lit(None).cast("string"), branch, F.col("route_type")).alias("route"), branch.alias("branch_id"))
    return lengths.route_totals(rows)


_REVIEWED_SQL = """c as (select d.*, c.edge_id, c.route_type, cast(floor(d.page / 4) as int) as line_no from dims d join candidate_edges c on c.dim_id = d.dim_id),
twice as (select line_no, dim_id as pos, page, dim_id, page || ':' || dim_id as key, edge_id, local_decision, value_mm from c
  union all select line_no, dim_id + 10000000000, page + 1, dim_id, page || ':' || dim_id, edge_id, 'include', value_mm * 2 from c where dim_id % 10 = 0),
d as (select * from twice qualify row_number() over (partition by line_no, key order by pos) = 1),
a as (select line_no, key, max(case when k = 0 then s end) as s0, max(case when k = 1 then s end) as s1 from (
  select c.line_no, c.page || ':' || c.dim_id as key, case when c.dim_id % 2 = 0 then 0 else 1 end as k, {'a': r.assessment, 'p': r.proposed, 'n': case when c.dim_id % 3 = 0 then 'include' end} as s from c join reviews r on r.dim_id = c.dim_id) group by 1, 2),
er as (select line_no, edge_id, arg_max(coalesce(route_type, 'main'), dim_id) as route from c where edge_id is not null group by 1, 2),
b as (select *, case when dim_id % 19 = 0 then 'BC-' || line_no when edge_id % 10 = 2 then 'BR-' || (page % 2) end as branch_id from d),
has as (select distinct line_no, branch_id from (select line_no, 'BR-' || (page % 2) as branch_id from c where edge_id % 10 = 2 union all select line_no, 'BC-' || line_no from c where dim_id % 19 = 0)),
p as (select b.*, coalesce(s0, s1) as s, er.route as edge_route, b.dim_id % 7 = 0 as keep, b.dim_id % 11 = 0 as accept from b left join a on a.line_no = b.line_no and a.key = b.key left join er on er.line_no = b.line_no and er.edge_id = b.edge_id),
q as (select line_no, case when branch_id is not null or edge_route = 'branch' then 'branch' else 'main' end as route, branch_id, value_mm, false as between,
  case when keep then local_decision when accept then coalesce(s.p, local_decision) when s.p is not null then s.p when s.a = 'accepted' then coalesce(s.n, local_decision) when s.a in ('disputed', 'insufficient') then 'ambiguous' else local_decision end as decision from p),
i as (select *, row_number() over (partition by line_no order by dim_id) - 1 as idx, case when dim_id % 3 = 0 then 'BR-' || (dim_id % 2) end as br from c where dim_id % 23 = 0),
u as (select * from q union all select i.line_no, case when has.branch_id is not null or dim_id % 5 = 0 then 'branch' else 'main' end, has.branch_id, case when dim_id % 4 = 0 then 0 else value_mm end, true, 'include' from i left join has on has.line_no = i.line_no and has.branch_id = br where idx % 2 = 0 and dim_id % 4 <> 0)
"""


@query(t.with_views(_REVIEWED_SQL + f"select line_no, route, branch_id, {_SUMS}, count(*) filter (decision = 'include' and not between) as n_candidates, count(*) filter (between) as n_distances, cast(grouping(line_no, route, branch_id) as bigint) as level from u group by grouping sets ((line_no, route, branch_id), (line_no, route), (line_no))", "dims", "candidate_edges", "reviews"))
def reviewed_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A09 with R10, R11 and distances between sheets: some candidates are listed twice, reviews and branches name them with and without their page."""
    d, k = t.dims(spark, sf_dir), F.col("dim_id")
    line = F.floor(F.col("page") / 4).cast("int").alias("line_no")
    c = d.join(t.candidate_edges(d).drop("page"), "dim_id").withColumn("line_no", line)
    name = F.concat_ws(":", "page", "dim_id")
    dims = c.select("line_no", k.alias("pos"), "page", "dim_id", F.when(k % 4 != 0, name).alias("candidate_key"), "edge_id", "local_decision", "value_mm")
    dims = dims.unionByName(c.filter(k % 10 == 0).select("line_no", (k + 10_000_000_000).alias("pos"), (F.col("page") + 1).alias("page"), "dim_id", name.alias("candidate_key"), "edge_id", F.lit("include").alias("local_decision"), (F.col("value_mm") * 2).alias("value_mm")))
    assessments = c.join(t.reviews(d), "dim_id").select("line_no", k.alias("pos"), F.when(k % 2 == 0, name).otherwise(k.cast("string")).alias("candidate_id"), "assessment", "proposed", F.when(k % 3 == 0, "include").alias("noted"))
    edges = c.filter("edge_id is not null").select("line_no", k.alias("pos"), F.col("edge_id").cast("string").alias("edge_id"), F.coalesce("route_type", F.lit("main")).alias("route_type"))
    none = F.array().cast("array<string>")
    by_edge = c.filter("edge_id % 10 = 2").groupBy("line_no", "page").agg(F.max(k).alias("pos"), F.collect_set(F.concat_ws(":", "page", "edge_id")).alias("edge_ids")).select("line_no", "pos", F.concat(F.lit("BR-"), F.col("page") % 2).alias("branch_id"), none.alias("candidate_ids"), "edge_ids")
    by_name = c.filter(k % 19 == 0).groupBy("line_no").agg(F.max(k).alias("pos"), F.collect_set(k.cast("string")).alias("candidate_ids")).select("line_no", "pos", F.concat(F.lit("BC-"), "line_no").alias("branch_id"), "candidate_ids", none.alias("edge_ids"))
    place = F.row_number().over(Window.partitionBy("line_no").orderBy("dim_id")) - 1
    between = c.filter(k % 23 == 0).withColumn("idx", place).select("line_no", "idx", F.when(k % 4 == 0, 0.0).otherwise(F.col("value_mm")).alias("value_mm"), F.when(k % 5 == 0, "Branch").alias("route"), F.when(k % 3 == 0, F.concat(F.lit("BR-"), k % 2)).alias("branch_id"))
    said = c.groupBy("line_no").agg(F.collect_set(F.when(k % 11 == 0, name)).alias("candidate_ids"), F.collect_set(F.when(k % 7 == 0, k.cast("string"))).alias("keep_ids"))
    confirmed = said.join(between.filter("idx % 2 = 0").groupBy("line_no").agg(F.collect_set("idx").alias("distance_ids")), "line_no", "left")
    return lengths.reviewed_totals(dims, assessments, edges, by_edge.unionByName(by_name), confirmed, between)


@query(t.with_views(_DECIDED + """, rows as (
  select d.dim_id, d.decision, c.kind, case d.dim_id % 4 when 0 then 'Same Axis label' when 1 then 'see sheet 3' else 'plain' end as reason from decided d join candidate_edges c on c.dim_id = d.dim_id
) select dim_id, coalesce(decision = 'exclude' and (kind in ('valve_dimension', 'cross_sheet_dimension', 'other') or regexp_matches(lower(reason), 'handwheel|cross_sheet|see sheet|continuation|invalid_overlap|same axis')), false) as invalid from rows""", "dims", "reviews", "overrides", "candidate_edges"))  # fmt: skip
def prevalidated_invalid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """R16"""
    k = F.col("dim_id") % 4
    rows = _candidates(spark, sf_dir).withColumn("reason", F.when(k == 0, "Same Axis label").when(k == 1, "see sheet 3").otherwise("plain"))
    return rows.select("dim_id", lengths.is_prevalidated_invalid(F.col("decision"), F.col("kind"), F.col("reason")).alias("invalid"))


@query(t.with_views("""select page, max(value_mm) filter (edge_id is not null) as widest_mm, nullif(sum(case when local_decision = 'include' then value_mm else 0 end), 0) as included_mm,
  count(*) filter (kind = 'valve_dimension') as valves, count(*) filter (edge_id is null) as loose from dims join candidate_edges using (dim_id, page) group by page""", "dims", "candidate_edges"))  # fmt: skip
def page_elements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and included length of a page, null where nothing is included."""
    d = t.dims(spark, sf_dir)
    rows = d.join(t.candidate_edges(d), ["dim_id", "page"])
    value = F.col("value_mm")
    return rows.groupBy("page").agg(F.max(F.when(F.col("edge_id").isNotNull(), value)).alias("widest_mm"), F.nullif(F.sum(F.when(F.col("local_decision") == "include", value).otherwise(0.0)), F.lit(0.0)).alias("included_mm"), F.count_if(F.col("kind") == "valve_dimension").alias("valves"), F.count_if(F.col("edge_id").isNull()).alias("loose"))


@query(t.with_views("""select edge_id, min(dim_id) filter (value_mm = most) as winner, max(n) as shared, cast(sum(case when value_mm < most and (most - value_mm) <= 600 then 1 else 0 end) as bigint) as moved
  from (select c.edge_id, d.dim_id, d.value_mm, max(d.value_mm) over (partition by c.edge_id) as most, count(*) over (partition by c.edge_id) as n from dims d join candidate_edges c on c.dim_id = d.dim_id where c.edge_id is not null) group by edge_id""", "dims", "candidate_edges"))  # fmt: skip
def shared_interval_winners(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The largest value of an interval stays, smaller ones near it are moved on."""
    from pyspark.sql import Window

    d = t.dims(spark, sf_dir)
    own = Window.partitionBy("edge_id")
    rows = d.join(t.candidate_edges(d).drop("page"), "dim_id").filter("edge_id is not null").select("edge_id", "dim_id", "value_mm", F.max("value_mm").over(own).alias("most"), F.count(F.lit(1)).over(own).alias("n"))
    return rows.groupBy("edge_id").agg(F.min(F.when(F.col("value_mm") == F.col("most"), F.col("dim_id"))).alias("winner"), F.max("n").alias("shared"), F.sum(F.when((F.col("value_mm") < F.col("most")) & (F.col("most") - F.col("value_mm") <= 600), 1).otherwise(0)).alias("moved"))


@query(t.with_views("""select run_id, line_id, case when bool_or(status = 'error') then 'error' when bool_and(status = 'complete') then 'complete' else 'partial' end as state, count(*) as n from run_log group by run_id, line_id""", "run_log"))
def line_statuses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A22"""
    return lengths.line_status(t.run_log(spark, sf_dir), ["run_id", "line_id"])


@query(t.with_views("""select page, dim_id, value_mm, position from (select page, dim_id, value_mm, row_number() over (partition by page order by value_mm desc, dim_id) as position from dims) where position <= 3""", "dims"))
def longest_per_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A top-k report."""
    from pyspark.sql import Window

    place = F.row_number().over(Window.partitionBy("page").orderBy(F.desc("value_mm"), "dim_id"))
    return t.dims(spark, sf_dir).select("page", "dim_id", "value_mm", place.alias("position")).filter("position <= 3")


@query(t.with_views("""select d.page, d.dim_id, 'D' || lpad(cast(row_number() over (partition by d.page order by d.dim_id) as varchar), 3, '0') as name, cast(d.page as varchar) || ':' || d.dim_id as candidate_key from dims d""", "dims"))
def dense_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers per page in scan order, and keys over pages."""
    from pyspark.sql import Window

    from ..functions.text import page_key

    place = F.row_number().over(Window.partitionBy("page").orderBy("dim_id"))
    return t.dims(spark, sf_dir).select("page", "dim_id", F.format_string("D%03d", place).alias("name"), page_key(F.col("page"), F.col("dim_id").cast("string")).alias("candidate_key"))
