"""Text rules over drawing labels."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as x
from ..sources import tables as t
from .registry import query

_KIND = """case when k in ('X', 'Y', 'Z', 'Z+') then 'coordinate_label' when regexp_matches(k, '^DN[0-9]+(X[0-9]+)?$') then 'dn' when regexp_matches(k, '(^|[^A-ZА-Я0-9_])[A-ZА-Я]{2}[_-][0-9]{4}($|[^A-ZА-Я0-9_])') then 'line_ref'
  when regexp_matches(k, '^[0-9]{5}$') then 'coordinate_value' when regexp_matches(k, '^[0-9]{2,5}$') then 'dimension' end"""


@query(t.with_views(f"select label_id, upper(replace(txt, '-', '_')) as line_id, {_KIND} as kind from (select *, replace(upper(trim(txt)), 'Х', 'X') as k from label_texts)", "label_texts"))
def label_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T01, T06"""
    return t.label_texts(spark, sf_dir).select("label_id", x.line_id(F.col("txt")).alias("line_id"), x.candidate_kind(F.col("txt")).alias("kind"))


_ZONE = "case when cy >= 602 then 'title_block' when cx >= 680 and cy <= 504 then 'materials_spec' when cx >= 680 and cy <= 602 then 'length_table' else 'drawing' end"


@query(t.with_views(f"select kind, zone, count(*) as n from (select {_KIND} as kind, {_ZONE} as zone from (select *, replace(upper(trim(txt)), 'Х', 'X') as k from label_texts)) where kind is not null group by kind, zone", "label_texts"))
def kind_zone_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S07, T07, A02"""
    width, height = F.lit(1000.0), F.lit(700.0)
    rows = t.label_texts(spark, sf_dir).select(x.candidate_kind(F.col("txt")).alias("kind"), x.zone(F.col("cx"), F.col("cy"), width, height).alias("zone"))
    return rows.filter("kind is not null").groupBy("kind", "zone").agg(F.count(F.lit(1)).alias("n"))


@query(t.with_views(r"""select label_id, array_to_string(ids, ',') as ids, coalesce(case when label_id % 10 = 0 then 'STAMP_1' end, list_filter(ids, lambda v: contains(v, '_'))[1], 'UNKNOWN_' || lpad(cast(page as varchar), 3, '0')) as primary_id
  from (select *, list_sort(list_distinct(list_filter(list_transform(regexp_extract_all(' ' || txt || ' ', '[^A-Za-z0-9_]([A-Z]{1,4}[0-9]{0,2}[_-][0-9]{4})[^A-Za-z0-9_]', 1), lambda v: replace(v, '-', '_')), lambda v: not starts_with(v, 'RD_')))) as ids from label_texts)""", "label_texts"))  # fmt: skip
def line_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T02, T05"""
    ids = x.line_ids(F.col("txt"))
    return t.label_texts(spark, sf_dir).select("label_id", F.array_join(ids, ",").alias("ids"), x.primary_id(F.when(F.col("label_id") % 10 == 0, "STAMP_1"), ids, F.col("page")).alias("primary_id"))


@query(t.with_views(r"""select label_id, case when regexp_full_match(txt, '[0-9]+([.,][0-9]+)?') and cast(replace(txt, ',', '.') as double) between 1 and 100000 then cast(replace(txt, ',', '.') as double) end as number,
  case upper(trim(txt)) when 'X' then 'x' when 'Y' then 'y' when 'Z+' then 'z' when 'Z' then 'z' when 'Z-' then 'z' end as axis,
  not upper(trim(txt)) in ('X', 'Y', 'Z', 'Z+', 'Z-') and not regexp_full_match(trim(txt), '[0-9]+([.,][0-9]+)?') and regexp_matches(trim(txt), '[\p{L}\-_/]') as is_reference,
  case when label_id % 2 = 0 then -try_cast(trim(txt) as double) else try_cast(trim(txt) as double) end as coordinate from label_texts""", "label_texts"))  # fmt: skip
def label_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T09, T17, T18, T19, T20"""
    c = F.col("txt")
    label = F.when(F.col("label_id") % 2 == 0, "Z-").otherwise("Z")
    return t.label_texts(spark, sf_dir).select("label_id", x.number(c).alias("number"), x.axis(c).alias("axis"), x.looks_like_reference(c).alias("is_reference"), x.coordinate(label, c).alias("coordinate"))


@query(t.with_views(r"""select label_id, case when regexp_matches(txt, '(ЛИСТ|SHEET) *[0-9]+') then cast(regexp_extract(txt, '(ЛИСТ|SHEET) *([0-9]+)', 2) as int) end as sheet,
  case when regexp_matches(txt, '(ЛИСТ|SHEET) *[0-9]+') then 'continuation' else 'other' end as connection, regexp_matches(txt, '(ЛИСТ|SHEET) *[0-9]+') as hint,
  case when regexp_matches(txt, 'ЛИСТ [0-9]+$') then cast(regexp_extract(txt, 'ЛИСТ ([0-9]+)$', 1) as int) when regexp_matches(txt, 'ЛИСТ [0-9]{2}X') then cast(null as int) end as cross_sheet,
  case when regexp_matches(txt, '(ЛИСТ|SHEET) *[0-9]+') then 'cross_sheet_reference' else '' end as hints
  from label_texts""", "label_texts"))  # fmt: skip
def sheet_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T13, T14, T15, T16"""
    c = F.col("txt")
    kind = x.connection_class(c)
    return t.label_texts(spark, sf_dir).select("label_id", x.sheet_number(c).cast("int").alias("sheet"), kind["kind"].alias("connection"), kind["hint"].alias("hint"), x.cross_sheet_reference(c).alias("cross_sheet"), F.array_join(x.text_hints(c), ",").alias("hints"))


@query(t.with_views(r"""select label_id, case when length(s) > 12 then left(s, 11) || '…' else s end as short, regexp_replace(regexp_replace(s, '[^\p{L}\p{N}_-]', '_', 'g'), '^_+|_+$', '', 'g') as file,
  contains(upper(replace(s, '-', '_')), 'LC_1') as found, contains(lower(s), 'sheet') as branch, regexp_replace('S' || (label_id % 300), '^[Ss]([0-9]+)$', '\1') as sheet,
  coalesce(nullif(trim(case when label_id % 2 = 0 then ' ' else s end), ''), 'none') as filled from (select label_id, txt as s from label_texts)""", "label_texts"))  # fmt: skip
def label_clean_up(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T21, T22, T26, T27, T28, T30"""
    s = F.col("txt")
    return t.label_texts(spark, sf_dir).select(
        "label_id", x.shortened(s, 12).alias("short"), x.file_name(s).alias("file"), x.matches_search(s, F.lit("lc-1")).alias("found"), F.coalesce(x.branch_evidence(s, ("sheet",), ("main",)), F.lit(False)).alias("branch"),
        x.sheet_key(F.concat(F.lit("S"), F.col("label_id") % 300)).alias("sheet"), x.first_filled(F.when(F.col("label_id") % 2 == 0, " ").otherwise(s), F.lit("none")).alias("filled"),
    )


@query("""select event_id, cast(json_extract(props, '$.k') as bigint) as k, false as broken from events""")
def reviewer_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JSON answers, fenced or cut off, read as VARIANT."""
    fence = F.when(F.col("event_id") % 2 == 0, F.concat(F.lit("answer:\n```json\n"), F.col("props"), F.lit("\n```"))).otherwise(F.col("props"))
    rows = t.supplied(spark, sf_dir, "events").select("event_id", x.answer_object(fence).alias("v"))
    return rows.select("event_id", F.try_variant_get("v", "$.k", "bigint").alias("k"), F.col("v").isNull().alias("broken"))


@query(r"""with w as (select doc_id, regexp_extract_all(text, '[^\x20\x09-\x0D]+') as w from documents), words as (select doc_id, unnest(w) as word, unnest(range(1, len(w) + 1)) as i from w),
lines as (select doc_id, i, word, sum(case when ends_with(coalesce(before, ''), '.') then 1 else 0 end) over (partition by doc_id order by i) as line from (select *, lag(word) over (partition by doc_id order by i) as before from words))
select doc_id, count(distinct line) as n_lines, max(n) as longest, max(first) as last_start from (select doc_id, line, count(*) as n, min(i) as first from lines group by doc_id, line) group by doc_id""")
def reading_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines open where the word before ended one (gaps and islands)."""
    from pyspark.sql import Window

    docs = t.supplied(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.regexp_extract_all("text", F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))).alias("p", "word"))
    order = Window.partitionBy("doc_id").orderBy("p")
    opens = F.coalesce(F.lag("word").over(order).endswith("."), F.lit(False)).cast("int")
    lines = docs.withColumn("opens", opens).withColumn("line", F.sum("opens").over(order))
    sizes = lines.groupBy("doc_id", "line").agg(F.count(F.lit(1)).alias("n"), (F.min("p") + 1).cast("long").alias("first"))
    return sizes.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_lines"), F.max("n").alias("longest"), F.max("first").alias("last_start"))
