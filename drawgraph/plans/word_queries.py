"""Words in blocks and lines: areas, dimension numbers, coordinates, stamps, and lengths that follow from coordinates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import review, words
from ..sources import tables as t
from .registry import query


@query("""select page, case when k = 3 then 0.0::double else 56.9::double end as x0, case when k = 3 then 0.0::double else 13.0::double end as y0, case when k = 3 then w * 0.65 else 810.0 end as x1, case when k = 3 then h * 0.83 else 705.0 end as y1
from (select distinct cast(floor(p_partkey / 8) as int) as page, cast(floor(p_partkey / 8) as int) % 4 as k, [1190.0, 840.0, 1680.0, 1000.0][cast(floor(p_partkey / 8) as int) % 4 + 1]::double as w, [840.0, 600.0, 1184.0, 700.0][cast(floor(p_partkey / 8) as int) % 4 + 1]::double as h from part)""")
def drawing_areas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages of three known sizes, and of another."""
    sizes = [F.element_at(F.array(*map(F.lit, v)), F.col("page") % 4 + 1) for v in ((1190.0, 840.0, 1680.0, 1000.0), (840.0, 600.0, 1184.0, 700.0))]
    return t.label_texts(spark, sf_dir).select("page").distinct().select("page", words.drawing_area(*sizes).alias("a")).select("page", "a.*")


@query(t.with_views("""n as (
  select *, cast(text as double) as value, max(case when text in ('X', 'Z+') or starts_with(text, 'DN') or starts_with(text, 'LC-') then 1 else 0 end) over (partition by page, block, line) as coord from words
), numbers as (select * from n where regexp_full_match(text, '[0-9]+') and x0 < 810 and x1 > 56.9 and y0 < 705 and y1 > 13), boxes as (
  select page, least(x0, x1) as x0, greatest(x0, x1) as x1, least(y0, y1) as y0, greatest(y0, y1) as y1 from strokes
), ruled as (select *, case when exists (select 1 from boxes b where b.page = n.page and n.x0 >= b.x0 - 1 and n.x1 <= b.x1 + 1 and n.y0 >= b.y0 - 1 and n.y1 <= b.y1 + 1) then 'inside_rect' when coord = 1 then 'coord' end as rule from numbers n)
select page, word_id, value, rule from (select *, row_number() over (partition by page, rule is null, text, round(x0, 1), round(y0, 1) order by word_id) as k from ruled) where rule is not null or k = 1""".replace("cast(text as double)", "try_cast(text as double)"), "strokes", "label_texts", "words"))  # fmt: skip
def dimension_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers that are dimensions, and why others are not."""
    s = t.strokes(spark, sf_dir)
    boxes = s.select("page", F.least("x0", "x1").alias("x0"), F.least("y0", "y1").alias("y0"), F.greatest("x0", "x1").alias("x1"), F.greatest("y0", "y1").alias("y1"))
    return words.dimension_numbers(t.words(spark, sf_dir), boxes)


@query(t.with_views("""l as (select page, block, line, word_id as label_id, upper(text) as label, x1 as after from words where upper(text) in ('X', 'Y', 'Z', 'Z+', 'Z-')), v as (select page, block, line, word_id, text as value, x0 from words where regexp_full_match(text, '[0-9]+'))
select page, label_id, label, word_id, value from (select l.page, label_id, label, word_id, value, row_number() over (partition by l.page, label_id order by x0, word_id) as k from l join v on l.page = v.page and l.block = v.block and l.line = v.line and v.x0 >= l.after - 1) where k = 1""", "label_texts", "words"))  # fmt: skip
def word_coordinates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The number to the right of a coordinate's label, on its line."""
    return words.word_coordinates(t.words(spark, sf_dir))


@query(t.with_views("""a as (select * from stamp_words where lower(text) = 'номер'), b as (select * from stamp_words where lower(text) = 'линии'), h as (
  select a.page, least(a.x0, b.x0) as x0, greatest(a.x1, b.x1) as x1, greatest(a.bottom, b.bottom) as low from a join b on a.page = b.page and b.idx - a.idx between 1 and 5 and abs(b.top - a.top) <= 4
), texts as (select h.page, string_agg(replace(v.text, ' ', ''), '' order by v.top, v.x0) as text from h join stamp_words v on v.page = h.page and v.top between h.low + 8 and h.low + 42 and v.x0 >= h.x0 - 30 and v.x1 <= h.x1 + 30 group by h.page)
select page, replace(text, '-', '_') as line_id from texts where regexp_full_match(text, '[A-Z]{1,4}-[0-9]{4}')""", "stamp_words"))  # fmt: skip
def stamp_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The line number below the head of a page's stamp."""
    return words.stamp_lines(t.stamp_words(spark, sf_dir))


_BLOCKS = """blocks as (select page, dim_id as block, cast(dim_id % 5 * 100 as bigint) as X, cast(case when dim_id % 3 <> 0 then value_mm - value_mm % 50 end as bigint) as Y, cast(case when dim_id % 4 <> 0 then dim_id % 2 * 250 end as bigint) as Z, cx as x0, cy as y0, cx + 20 as x1, cy + 30 as y1 from dims),
vals as (select distinct page, cast(cast(value_mm - value_mm % 50 as bigint) as varchar) as text from dims union select distinct page, '200' from dims where dim_id % 3 = 0)"""


@query(t.with_views(_BLOCKS + """, pairs as (
  select l.page, l.block as lb, r.block as rb, abs(l.X - r.X) as dx, abs(l.Y - r.Y) as dy, abs(l.Z - r.Z) as dz, least(l.x0, r.x0) as x0, least(l.y0, r.y0) as y0, greatest(l.x1, r.x1) as x1, greatest(l.y1, r.y1) as y1 from blocks l join blocks r on l.page = r.page and l.block < r.block
), counted as (select *, coalesce(cast(dx <> 0 as int), 0) + coalesce(cast(dy <> 0 as int), 0) + coalesce(cast(dz <> 0 as int), 0) as changed, coalesce(cast(dx = 0 as int), 0) + coalesce(cast(dy = 0 as int), 0) + coalesce(cast(dz = 0 as int), 0) as shared from pairs
), axes3 as (select *, 'X' as axis, cast(dx as varchar) as text from counted where dx > 0 union all select *, 'Y', cast(dy as varchar) from counted where dy > 0 union all select *, 'Z', cast(dz as varchar) from counted where dz > 0
), firsts as (select * from axes3 join vals using (page, text) where shared > 0 qualify row_number() over (partition by page, axis, text order by lb, rb) = 1
), levels as (select page, cast(max(Z) - min(Z) as varchar) as text, min(x0) as x0, min(y0) as y0, max(x1) as x1, max(y1) as y1 from blocks where Z is not null group by page having count(distinct Z) = 2
), every as (select page, text, x0, y0, x1, y1, 0.9::double as confidence from firsts union all select page, text, x0, y0, x1, y1, 0.9 from axes3 where changed = 1 and shared >= 2 union all select *, 0.85 from levels)
select page, text, x0, y0, x1, y1, max(confidence) as confidence, exists (select 1 from vals v where v.page = every.page and v.text = every.text) as duplicate from every group by page, text, x0, y0, x1, y1""", "dims"))  # fmt: skip
def coordinate_deltas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lengths between coordinate blocks, and whether a dimension shows them already."""
    d, k = t.dims(spark, sf_dir), F.col("dim_id")
    step = F.col("value_mm") - F.col("value_mm") % 50
    blocks = d.select("page", k.alias("block"), (k % 5 * 100).cast("long").alias("X"), F.when(k % 3 != 0, step).cast("long").alias("Y"), F.when(k % 4 != 0, k % 2 * 250).cast("long").alias("Z"), F.col("cx").alias("x0"), F.col("cy").alias("y0"), (F.col("cx") + 20).alias("x1"), (F.col("cy") + 30).alias("y1"))
    values = d.select("page", step.cast("long").cast("string").alias("text")).unionByName(d.filter(k % 3 == 0).select("page", F.lit("200").alias("text")))
    return review.coordinate_deltas(blocks, values)


@query(t.with_views(r"""texts as (select label_id, page, case when label_id % 14 = 4 then 'ПОДКЛЮЧЕНИЕ ' || txt else txt end as txt, cx, cy from label_texts), tokens as (select *, unnest(string_split(txt, ' ')) as text, unnest(range(len(string_split(txt, ' ')))) as i from texts),
placed as (select page, label_id * 100 + i as pos, cx + 30 * case when label_id % 5 = 3 then -i else i end as x0, cy - 4 + case when label_id % 6 = 0 and i >= 2 then 13 else 0 end as y0, text from tokens where text <> ''),
marked as (select *, case when abs(y0 - lag(y0 + 4) over (partition by page order by pos)) > 8 then 1 else 0 end as opens from placed), numbered as (select *, sum(opens) over (partition by page order by pos) + 1 as line from marked),
lines as (select page, cast(line as bigint) as line, string_agg(text, ' ' order by x0, pos) as label, min(x0) as x0, min(y0) as y0, max(x0) + 25 as x1, max(y0) + 8 as y1 from numbered group by 1, 2),
named as (select *, contains(label, 'ПОДКЛЮЧЕНИЕ') as tie, nullif(regexp_extract(label, '(ЛИСТ|SHEET) *([0-9]+)', 2), '') as sheet from lines)
select page, line, label, x0, y0, x1, y1, case when tie then 'tie_in' else 'continuation' end as kind, case when not tie then sheet end as sheet, not tie as hint from named where tie or regexp_matches(label, '(^| )ЛИСТ *[0-9]+')""", "label_texts"))  # fmt: skip
def connection_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels word by word, some over two rows and some from right to left, read as lines that name a connection or a sheet."""
    k = F.col("label_id")
    txt = F.when(k % 14 == 4, F.concat(F.lit("ПОДКЛЮЧЕНИЕ "), "txt")).otherwise(F.col("txt"))
    w = t.label_texts(spark, sf_dir).select("label_id", "page", "cx", "cy", F.posexplode(F.split(txt, " ")).alias("i", "text"))
    left = F.col("cx") + 30 * F.when(k % 5 == 3, -F.col("i")).otherwise(F.col("i"))
    top = F.col("cy") - 4 + F.when((k % 6 == 0) & (F.col("i") >= 2), 13).otherwise(0)
    return words.connection_lines(w.select("page", (k * 100 + F.col("i")).alias("pos"), left.alias("x0"), top.alias("y0"), (left + 25).alias("x1"), (top + 8).alias("y1"), "text"))
