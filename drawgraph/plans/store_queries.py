"""Evaluation, feedback and run history."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import evaluate, store
from ..sources import tables as t
from .registry import query

_COMPARED = r"""actual as (
  select sheet, candidate_id, max_by(status, pos) as actual from (select regexp_replace(sheet, '^[Ss]([0-9]+)$', '\1') as sheet, candidate_id, status, pos from answers) group by sheet, candidate_id
), compared as (
  select t.group_id, coalesce(t.sheet, a.sheet) as sheet, coalesce(t.candidate_id, a.candidate_id) as candidate_id, t.status as expected, a.actual,
    case when t.candidate_id is null then 'extra' when t.status is not distinct from a.actual then 'match' when a.candidate_id is null then 'missing' else 'mismatch' end as kind, a.candidate_id is null as unanswered
  from truth t full join actual a on a.sheet = t.sheet and a.candidate_id = t.candidate_id
)
"""


@query(t.with_views(_COMPARED + "select * from compared", "truth", "answers"))
def truth_compared(spark: SparkSession, sf_dir: str) -> DataFrame:
    """E01-E03, J36, T26"""
    return evaluate.compared(t.truth(spark, sf_dir), t.answers(spark, sf_dir))


@query(t.with_views(_COMPARED + """select group_id, count(*) as total, count(*) filter (kind = 'match') as correct, count(*) filter (unanswered) as missing, count(*) filter (kind = 'match') * 100.0::double / greatest(count(*), 1) as accuracy,
  cast(grouping(group_id) as int) as all_groups from compared where kind <> 'extra' group by rollup (group_id)""", "truth", "answers"))  # fmt: skip
def truth_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A14, A15, E05"""
    return evaluate.accuracy(evaluate.compared(t.truth(spark, sf_dir), t.answers(spark, sf_dir)))


_NAMES = "lines as (select distinct case when c_custkey % 5 = 0 then c_mktsegment || '_' || (c_custkey % 3) else left(c_mktsegment, 4) || (c_custkey % 2) end as line_id from customer), grps as (select distinct c_mktsegment as group_id from customer union select 'BUIL')"


@query("with " + _NAMES + """, found as (
  select line_id, group_id, case when line_id = group_id or starts_with(line_id, group_id || '_') or starts_with(group_id, line_id || '_') then 1 when starts_with(line_id, group_id) or starts_with(group_id, line_id) then 2 end as level from lines cross join grps
), best as (select line_id, group_id, level from found f where level = (select min(level) from found g where g.line_id = f.line_id))
select l.line_id, b.level, b.group_id, case when b.group_id is null then 'not_configured' else 'evaluated' end as status from lines l left join best b on b.line_id = l.line_id""")
def groups_of_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """E04, E06"""
    c = t.supplied(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment")
    k = F.col("c_custkey")
    lines = c.select(F.when(k % 5 == 0, F.concat("c_mktsegment", F.lit("_"), k % 3)).otherwise(F.concat(F.left("c_mktsegment", F.lit(4)), k % 2)).alias("line_id")).distinct()
    groups = c.select(F.col("c_mktsegment").alias("group_id")).union(spark.sql("select 'BUIL'")).distinct()
    return evaluate.groups_of_lines(lines, groups)


@query(t.with_views("select run_id, count(*) filter (rating = 'up') as positive, count(*) filter (rating = 'down') as negative, count(*) as total from feedback group by run_id", "feedback"))
def feedback_by_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A03"""
    return store.feedback_counts(t.feedback(spark, sf_dir), "run_id")


@query(t.with_views("select prompt_name, prompt_version, prompt_sha256, count(*) filter (rating = 'up') as positive, count(*) filter (rating = 'down') as negative, count(*) as total from feedback group by 1, 2, 3", "feedback"))
def feedback_by_version(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A04"""
    return store.feedback_counts(t.feedback(spark, sf_dir), "prompt_name", "prompt_version", "prompt_sha256")


@query(t.with_views("""marked as (select *, coalesce(prompt_version = '1' and prompt_sha256 = sha256('1'), false) as exact, coalesce(prompt_version, '') in ('', 'unversioned') or coalesce(prompt_sha256, '') = '' as none from feedback)
select prompt_name, count(*) filter (rating = 'up') as up, count(*) filter (rating <> 'up') as down, count(*) filter (exact and rating = 'up') as exact_up, count(*) filter (exact and rating <> 'up') as exact_down,
  count(*) filter (none and rating = 'up') as unversioned_up, count(*) filter (none and rating <> 'up') as unversioned_down from marked group by prompt_name""", "feedback"))  # fmt: skip
def feedback_slices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A05, A06"""
    import hashlib

    return store.feedback_slices(t.feedback(spark, sf_dir), "1", hashlib.sha256(b"1").hexdigest())


@query(t.with_views("""versions as (select distinct prompt_sha256, prompt_version from feedback where prompt_version is not null and prompt_sha256 is not null), known as (select prompt_sha256, count(*) as n, max(prompt_version) as only_version from versions group by 1)
select f.id, f.prompt_version, f.prompt_sha256, case when f.prompt_version is not null and f.prompt_sha256 is not null then f.prompt_version when k.n = 1 then k.only_version end as resolved from feedback f left join known k on k.prompt_sha256 = f.prompt_sha256""", "feedback"))  # fmt: skip
def resolved_revisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """D06, D12"""
    f = t.feedback(spark, sf_dir).select("id", "prompt_version", "prompt_sha256")
    versions = f.filter("prompt_version is not null and prompt_sha256 is not null").select("prompt_sha256", "prompt_version").distinct()
    return store.resolved_revisions(f, versions)


@query(t.with_views("select run_id, candidate_id, max_by(id, id) as id, min(created_at) as created_at, max_by(rating, id) as rating from feedback group by run_id, candidate_id", "feedback"))
def latest_feedback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Upserts as the latest row of a log; when it was made stays."""
    return store.latest(t.feedback(spark, sf_dir).select("run_id", "candidate_id", "id", "created_at", "rating"), ["run_id", "candidate_id"], "id", "created_at")


@query(t.with_views("""select run_id, min("at") as created_at, max("at") as updated_at, coalesce(array_to_string(list_transform(list_sort(list({'s': seq, 'p': page}) filter (status = 'error'))[:3], lambda e: 'page ' || e.p), '; '), '') as errors,
  count(*) filter (status = 'error') as error_count, nullif(sum(seconds), 0) as seconds, cast(sum(tokens) as bigint) as tokens, case when count(*) filter (status = 'error') > 0 then 'error' else max_by(status, seq) end as status from run_log group by run_id""", "run_log"))  # fmt: skip
def run_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A07, A21, S09"""
    return store.run_history(t.run_log(spark, sf_dir))


@query(t.with_views("select run_id, line_id, page, case when s in ('running', 'pending') then 'error' else s end as status from (select run_id, line_id, page, max_by(status, seq) as s from run_log group by 1, 2, 3)", "run_log"))
def interrupted_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """D04"""
    return store.interrupted(t.run_log(spark, sf_dir))


@query(t.with_views("select run_id, page, seq, status, place from (select run_id, page, seq, status, cast(row_number() over (partition by run_id, page order by seq desc) as int) as place from run_log) where place <= 12", "run_log"))
def last_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A top-k report."""
    return store.last_events(t.run_log(spark, sf_dir))


@query(t.with_views("""sets as (select run_id, list(distinct candidate_id) filter (rating = 'up') as accepted, list(distinct candidate_id) filter (rating = 'down') as kept, list(distinct candidate_id) filter (id % 9 <> 0) as known from feedback group by run_id),
full_sets as (select run_id, coalesce(accepted, []) as accepted, coalesce(kept, []) as kept, coalesce(known, []) as known from sets)
select run_id, array_to_string(list_sort(list_filter(accepted, lambda v: not list_contains(kept, v))), ',') as accepted, array_to_string(list_sort(kept), ',') as kept, array_to_string(list_sort(list_filter(list_distinct(list_concat(accepted, kept)), lambda v: not list_contains(known, v))), ',') as unknown from full_sets""", "feedback"))  # fmt: skip
def confirmed_choices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """R18, R19, U02, U03, U04"""
    f = t.feedback(spark, sf_dir)
    ids = lambda c: F.collect_set(F.when(c, F.col("candidate_id")))
    sets = f.groupBy("run_id").agg(ids(F.col("rating") == "up").alias("accepted"), ids(F.col("rating") == "down").alias("kept"), ids(F.col("id") % 9 != 0).alias("known"))
    out = store.confirmed(sets)
    return out.select("run_id", *[F.array_join(c, ",").alias(c) for c in ("accepted", "kept", "unknown")])


_EVALUATED = """expected as (select doc_id // 40 as group_id, (doc_id // 10) % 4 as sheet, doc_id as candidate_id, case when doc_id % 17 <> 0 then case when quality = 1 then 'include' else 'exclude' end end as expected from labels where (doc_id // 40) % 5 <> 4 and ((doc_id // 40) % 3 <> 2 or (doc_id // 10) % 4 <> 3)),
said as (select 'v' || v as version, doc_id // 40 as group_id, (doc_id // 10) % 4 as sheet, doc_id as candidate_id, case when (n_chars + v) % 3 <> 0 then 'include' else 'exclude' end as actual from documents, (values (0), (1), (2)) as versions(v) where (doc_id + v) % 10 <> 3),
answered as (select distinct version, group_id, sheet from said), wanted as (select version, group_id, sheet, candidate_id, expected from answered join expected using (group_id, sheet)),
paired as (select version, group_id, sheet, candidate_id, w.expected, s.actual, w.candidate_id is not null as known, s.candidate_id is not null as told from wanted w full join said s using (version, group_id, sheet, candidate_id)),
states as (select version, group_id, sheet, count(*) filter (known) as total from paired group by all), kept as (select p.* from paired p join states s using (version, group_id, sheet) where s.total > 0),
lists as (select version, group_id, count(*) filter (known) as total, count(*) filter (known and expected is not distinct from actual) as correct, string_agg(sheet || ':' || candidate_id || ':' || coalesce(expected, '-') || ':' || coalesce(actual, '-'), ' ' order by sheet, candidate_id) filter (known and expected is distinct from actual) as mismatches,
  string_agg(sheet || ':' || candidate_id, ' ' order by sheet || ':' || candidate_id) filter (known and not told) as missing, string_agg(sheet || ':' || candidate_id, ' ' order by sheet || ':' || candidate_id) filter (not known) as extra from kept group by 1, 2),
groups_ as (select a.version, a.group_id, coalesce(l.total, 0) as total, coalesce(l.correct, 0) as correct, coalesce(l.total - l.correct, 0) as incorrect, coalesce(l.mismatches, '') as mismatches, coalesce(l.missing, '') as missing, coalesce(l.extra, '') as extra, round(coalesce(l.correct, 0)::double / greatest(coalesce(l.total, 0), 1) * 100, 2) as accuracy,
  case when l.total > 0 then 'evaluated' when a.group_id in (select group_id from expected) then 'empty' else 'not_configured' end as status from (select distinct version, group_id from answered) a left join lists l using (version, group_id))
"""


def _evaluated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of forty candidates on four sheets, answered under three versions of a prompt; every fifth line has no truth, and one sheet of every third."""
    k = F.col("doc_id")
    at = [F.floor(k / 40).alias("group_id"), (F.floor(k / 10) % 4).alias("sheet"), k.alias("candidate_id")]
    has = (F.col("group_id") % 5 != 4) & ((F.col("group_id") % 3 != 2) | (F.col("sheet") != 3))
    truth = t.supplied(spark, sf_dir, "labels").select(*at, F.when(k % 17 != 0, F.when(F.col("quality") == 1, "include").otherwise("exclude")).alias("expected")).filter(has)
    said = t.supplied(spark, sf_dir, "documents").select("doc_id", "n_chars", F.explode(F.array(*map(F.lit, range(3)))).alias("v")).filter((k + F.col("v")) % 10 != 3)
    said = said.select(F.concat(F.lit("v"), "v").alias("version"), *at, F.when((F.col("n_chars") + F.col("v")) % 3 != 0, "include").otherwise("exclude").alias("actual"))
    pages = said.select("version", "group_id", "sheet").distinct()
    return evaluate.group_results(evaluate.page_results(pages, truth, said, ["version"]), ["version"])


@query("with " + _EVALUATED + "select * from groups_")
def evaluation_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each line under each version, with what differs, is missing and is too much."""
    shown = F.transform("mismatches", lambda m: F.concat_ws(":", m["sheet"].cast("string"), m["candidate_id"].cast("string"), F.coalesce(m["expected"], F.lit("-")), F.coalesce(m["actual"], F.lit("-"))))
    return _evaluated(spark, sf_dir).withColumns({"mismatches": F.array_join(shown, " "), "missing": F.array_join("missing", " "), "extra": F.array_join("extra", " ")})


@query("with " + _EVALUATED + """select version, sum(total)::bigint as total, sum(correct)::bigint as correct, sum(incorrect)::bigint as incorrect, count(*) as groups, count(*) filter (status = 'evaluated') as evaluated, count(*) filter (status = 'empty') as empty, count(*) filter (status = 'not_configured') as not_configured,
  round(sum(correct)::double / sum(total) * 100, 2) as accuracy, 'evaluated' as status from groups_ group by version having sum(total) > 0""")
def evaluation_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each version over all lines."""
    return evaluate.version_results(_evaluated(spark, sf_dir), ["version"])


@query(t.with_views("""state as (select run_id, line_id, page, min("at") as created_at, min(seq) as first, max_by(status, seq) as status, max(seq) filter (status = 'error') as error, sum(seconds) as seconds, sum(tokens)::bigint as tokens, count(*) as n_events, list({'seq': seq, 'status': status} order by seq) as every from run_log group by 1, 2, 3),
by_line as (select run_id, line_id, min(created_at) as created_at, min(first) as first, case when bool_or(status = 'error') then 'error' when bool_and(status = 'complete') then 'complete' else 'running' end as status, list(page order by page) as pages,
  list({'page_number': page, 'status': status, 'error': error, 'seconds': seconds, 'tokens': tokens, 'n_events': n_events, 'events': every[greatest(len(every) - 11, 1):]} order by page) as page_results from state group by 1, 2)
select run_id, min(created_at) as created_at, cast(to_json({'run_id': run_id, 'status': case when bool_or(status = 'error') then 'error' when bool_and(status = 'complete') then 'complete' else 'running' end, 'line_ids': list(line_id order by first), 'lines': list({'line_id': line_id, 'pages': pages, 'status': status, 'page_results': page_results} order by first)}) as varchar) as tree from by_line group by run_id""", "run_log"))  # fmt: skip
def run_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs with their lines, pages and last events, nested."""
    return store.run_trees(t.run_log(spark, sf_dir))


@query(t.with_views("""history as (select run_id, min("at") as created_at, max("at") as updated_at, coalesce(array_to_string(list_transform(list_sort(list({'s': seq, 'p': page}) filter (status = 'error'))[:3], lambda e: 'page ' || e.p), '; '), '') as errors,
  count(*) filter (status = 'error') as error_count, nullif(sum(seconds), 0) as seconds, cast(sum(tokens) as bigint) as tokens, case when count(*) filter (status = 'error') > 0 then 'error' else max_by(status, seq) end as status from run_log group by run_id),
fed as (select run_id, count(*) filter (rating = 'up') as positive, count(*) filter (rating = 'down') as negative, count(*) as total, count(distinct candidate_id) filter (rating = 'down') as kept, count(*) filter (id % 3 = 0) as manual_edits from feedback group by run_id),
mixed as (select run_id, count(*) filter (up and not down) as fixes from (select run_id, candidate_id, bool_or(rating = 'up') as up, bool_or(rating = 'down') as down from feedback group by 1, 2) group by run_id)
select h.*, coalesce(b.fixes, 0) as fixes, coalesce(f.kept, 0) as kept, coalesce(f.manual_edits, 0) as manual_edits, coalesce(f.positive, 0) as positive, coalesce(f.negative, 0) as negative, coalesce(f.total, 0) as total, coalesce(b.fixes, 0) - coalesce(f.kept, 0) as net from history h left join fed f on f.run_id = h.run_id left join mixed b on b.run_id = h.run_id""", "feedback", "run_log"))  # fmt: skip
def run_overviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A line for each day's candidates of a run."""
    f = t.feedback(spark, sf_dir)
    ids = lambda c: F.array_compact(F.array(F.when(c, F.col("candidate_id"))))
    seen = f.groupBy("run_id", "candidate_id").agg(F.bool_or(F.col("rating") == "up").alias("up"), F.bool_or(F.col("rating") == "down").alias("down"))
    confirmations = seen.select("run_id", F.col("candidate_id").alias("line_id"), ids(F.col("up") & ~F.col("down")).alias("accepted"), ids(F.col("down")).alias("kept"))
    return store.run_overviews(t.run_log(spark, sf_dir), confirmations, f.filter("id % 3 = 0").select("run_id"), f)
