"""Decoded drawings as tables: strokes, labels, decisions, feedback and runs, derived from the supplied tables.

A page holds eight orders' rows, so work on a page does not grow with the data; coordinates are multiples
of small powers of two, so sums and products are exact. VIEWS has the same tables as SQL, for checks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Width up to which a stroke is a dimension line, and from which it is a pipe axis; strokes between are neither.
DIMENSION_WIDTH, AXIS_WIDTH = 0.8, 0.95


def supplied(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def strokes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(page, stroke_id, x0, y0, x1, y1, linewidth)"""
    li = supplied(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")
    place = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice"))
    x, y, kind = (F.col("l_partkey") * 7) % 40 * 16, (F.col("l_suppkey") * 3) % 30 * 16, F.col("l_linenumber") % 3
    dx = F.when(kind == 0, F.lit(0)).otherwise(16 * (1 + F.col("l_suppkey") % 6))
    dy = F.when(kind == 0, 16 * (1 + F.col("l_partkey") % 6)).when(kind == 1, F.lit(0)).otherwise(-16 * (1 + F.col("l_suppkey") % 6))
    width = F.when(F.col("l_quantity") >= 25, 1.25).when(F.col("l_quantity") >= 5, 0.5).otherwise(0.875)
    return li.select(((F.col("l_orderkey") - F.col("l_orderkey") % 8) / 8).cast("int").alias("page"), (F.col("l_orderkey") * 100 + place).alias("stroke_id"), x.cast("double").alias("x0"), y.cast("double").alias("y0"), (x + dx).cast("double").alias("x1"), (y + dy).cast("double").alias("y1"), width.alias("linewidth"))


def axes(rows: DataFrame) -> DataFrame:
    return rows.filter(F.col("linewidth") >= AXIS_WIDTH)


def thin(rows: DataFrame) -> DataFrame:
    return rows.filter(F.col("linewidth") <= DIMENSION_WIDTH)


def axis_strokes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pipe axes."""
    return axes(strokes(spark, sf_dir))


def thin_strokes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return thin(strokes(spark, sf_dir))


def dims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(page, dim_id, value_mm, cx, cy, local_decision)"""
    o = supplied(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus")
    decision = F.when(F.col("o_orderstatus") == "F", "include").when(F.col("o_orderstatus") == "O", "exclude").otherwise("ambiguous")
    return o.select(((F.col("o_orderkey") - F.col("o_orderkey") % 8) / 8).cast("int").alias("page"), F.col("o_orderkey").alias("dim_id"), (50 + (F.col("o_custkey") * 13) % 4000).cast("double").alias("value_mm"), ((F.col("o_custkey") * 11) % 640).cast("double").alias("cx"), ((F.col("o_orderkey") * 17) % 480).cast("double").alias("cy"), decision.alias("local_decision"))


def reviews(d: DataFrame) -> DataFrame:
    """(dim_id, assessment, proposed) of four in five dimensions."""
    k = F.col("dim_id") % 5
    return d.filter(k != 4).select("dim_id", F.when(k == 0, "accepted").when(k == 3, "insufficient").otherwise("disputed").alias("assessment"), F.when(k == 1, "include").alias("proposed"))


def overrides(d: DataFrame) -> DataFrame:
    """(dim_id, keep_local, accept) by a person."""
    return d.select("dim_id", (F.col("dim_id") % 7 == 0).alias("keep_local"), (F.col("dim_id") % 11 == 0).alias("accept"))


def candidate_edges(d: DataFrame) -> DataFrame:
    """(dim_id, edge_id, coverage, kind, route_type): what a reviewer says a dimension covers."""
    return d.select("dim_id", "page", F.when(F.col("dim_id") % 9 != 0, F.col("page") * 10 + F.col("dim_id") % 3).alias("edge_id"), (1 + F.col("dim_id") % 4).cast("int").alias("coverage"), F.when(F.col("dim_id") % 13 == 0, "valve_dimension").when(F.col("dim_id") % 2 == 0, "pipe_length").alias("kind"), F.when(F.col("dim_id") % 6 == 0, "branch").alias("route_type"))


def label_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(label_id, page, txt, cx, cy): seven kinds of drawing labels."""
    p = supplied(spark, sf_dir, "part").select("p_partkey", "p_name", "p_size")
    k, n = F.col("p_partkey") % 7, F.col("p_partkey")
    txt = F.when(k == 0, F.concat(F.lit("DN"), F.col("p_size"), F.lit("X25"))).when(k == 1, F.element_at(F.array(*map(F.lit, ("X", "y", "Z+", "Х"))), (n % 4 + 1).cast("int"))).when(k == 2, (10000 + n % 80000).cast("string"))
    txt = txt.when(k == 3, F.concat(F.lit("LC-"), F.lpad((n % 10000).cast("string"), 4, "0"))).when(k == 4, (20 + n % 900).cast("string")).when(k == 5, F.concat(F.lit("SEE SHEET "), (n % 50).cast("string"), F.lit(" rd_0001 CO_0166"))).otherwise(F.concat(F.col("p_name"), F.lit(" ЛИСТ "), (n % 30).cast("string"), F.when(n % 2 == 0, "X300").otherwise("")))
    return p.select(n.alias("label_id"), (n / 8).cast("int").alias("page"), txt.alias("txt"), ((n * 37) % 1000).cast("double").alias("cx"), ((n * 53) % 700).cast("double").alias("cy"))


def words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(page, block, line, word_id, text, x0, y0, x1, y1): labels as words on two lines of their page."""
    k = F.col("label_id")
    return label_texts(spark, sf_dir).select("page", F.col("page").alias("block"), (k % 2).alias("line"), k.alias("word_id"), F.col("txt").alias("text"), F.col("cx").alias("x0"), (F.col("cy") - 4).alias("y0"), (F.col("cx") + 8).alias("x1"), (F.col("cy") + 4).alias("y1"))


def stamp_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(page, idx, text, x0, x1, top, bottom): a stamp for each supplier: two words of its head, some far from each other, and a number in two parts, some outside its box."""
    k = F.col("s_suppkey")
    word = lambda idx, text, x0, top: F.struct(idx.cast("int").alias("idx"), text.alias("text"), x0.cast("double").alias("x0"), (x0 + 40).cast("double").alias("x1"), top.cast("double").alias("top"), (top + 8).cast("double").alias("bottom"))
    number = F.lpad((k % 10000).cast("string"), 4, "0")
    parts = [word(F.lit(0), F.lit("Номер"), F.lit(100), F.lit(600)), word(1 + k % 7, F.lit("линии"), F.lit(150), 600 + k % 6), word(F.lit(20), F.lit("LC -"), F.lit(100), 618 + k % 40), word(F.lit(21), number, F.lit(142), 618 + k % 40)]
    return supplied(spark, sf_dir, "supplier").select(k.cast("int").alias("page"), F.explode(F.array(*parts)).alias("w")).select("page", "w.*")


def feedback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, created_at, run_id, candidate_id, rating, prompt_name, prompt_version, prompt_sha256)"""
    e = supplied(spark, sf_dir, "events").select("event_id", "ts", "user_id", "event_type", "value")
    rating = F.when(F.col("event_type").isin("purchase", "signup"), "up").when(F.col("event_type") == "error", "down")
    version = F.when(F.col("event_id") % 4 != 0, (F.col("event_id") % 3).cast("string"))
    return e.filter(rating.isNotNull()).select(F.col("event_id").alias("id"), F.col("ts").alias("created_at"), F.col("user_id").alias("run_id"), F.date_format("ts", "yyyy-MM-dd").alias("candidate_id"), rating.alias("rating"), F.when(F.col("user_id") % 2 == 0, "dimension").otherwise("length").alias("prompt_name"), version.alias("prompt_version"), F.when(F.col("event_id") % 5 != 0, F.sha2(F.coalesce(version, F.lit("0")), 256)).alias("prompt_sha256"))


def run_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(run_id, seq, at, line_id, page, status, seconds, tokens): append-only progress of runs."""
    e = supplied(spark, sf_dir, "events").select("event_id", "ts", "user_id", "event_type", "value")
    status = F.when(F.col("event_type") == "error", "error").when(F.col("event_type") == "purchase", "complete").when(F.col("event_type") == "click", "running").otherwise("pending")
    return e.select(F.col("user_id").alias("run_id"), F.col("event_id").alias("seq"), F.col("ts").alias("at"), (F.col("event_id") % 3).alias("line_id"), (F.col("event_id") % 12).alias("page"), status.alias("status"), (F.floor(F.col("value") * 4) / 4).alias("seconds"), F.when(F.col("event_id") % 3 == 0, F.col("event_id") % 1000).alias("tokens"))


def truth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(group_id, sheet, candidate_id, status): what reviewers should have said."""
    return supplied(spark, sf_dir, "labels").select((F.col("doc_id") % 7).cast("string").alias("group_id"), (F.col("doc_id") % 4).cast("string").alias("sheet"), F.col("doc_id").alias("candidate_id"), F.when(F.col("doc_id") % 17 != 0, F.when(F.col("quality") == 1, "include").otherwise("exclude")).alias("status"))


def answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(sheet, candidate_id, status, pos): what they said; some twice, some missing, some about nothing."""
    d = supplied(spark, sf_dir, "documents").select("doc_id", "n_chars").filter(F.col("doc_id") % 10 != 3)
    twice = d.withColumn("pos", F.explode(F.when(F.col("doc_id") % 6 == 0, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))))
    status = F.when((F.col("n_chars") + F.col("pos")) % 3 != 0, "include").otherwise("exclude")
    return twice.select(F.concat(F.when(F.col("doc_id") % 2 == 0, "S").otherwise(""), (F.col("doc_id") % 4).cast("string")).alias("sheet"), F.col("doc_id").alias("candidate_id"), status.alias("status"), "pos")


_PAGE = "cast((o_orderkey - o_orderkey % 8) / 8 as int)"
VIEWS = {
    "strokes": """select cast((l_orderkey - l_orderkey % 8) / 8 as int) as page, l_orderkey * 100 + row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) as stroke_id,
  cast((l_partkey * 7) % 40 * 16 as double) as x0, cast((l_suppkey * 3) % 30 * 16 as double) as y0,
  cast((l_partkey * 7) % 40 * 16 + case when l_linenumber % 3 = 0 then 0 else 16 * (1 + l_suppkey % 6) end as double) as x1,
  cast((l_suppkey * 3) % 30 * 16 + case when l_linenumber % 3 = 0 then 16 * (1 + l_partkey % 6) when l_linenumber % 3 = 1 then 0 else -16 * (1 + l_suppkey % 6) end as double) as y1,
  case when l_quantity >= 25 then 1.25::double when l_quantity >= 5 then 0.5::double else 0.875::double end as linewidth from lineitem""",
    "axes": "select * from strokes where linewidth >= 0.95",
    "thin": "select * from strokes where linewidth <= 0.8",
    "dims": f"""select {_PAGE} as page, o_orderkey as dim_id, cast(50 + (o_custkey * 13) % 4000 as double) as value_mm, cast((o_custkey * 11) % 640 as double) as cx, cast((o_orderkey * 17) % 480 as double) as cy,
  case o_orderstatus when 'F' then 'include' when 'O' then 'exclude' else 'ambiguous' end as local_decision from orders""",
    "reviews": "select dim_id, case dim_id % 5 when 0 then 'accepted' when 3 then 'insufficient' else 'disputed' end as assessment, case when dim_id % 5 = 1 then 'include' end as proposed from dims where dim_id % 5 <> 4",
    "overrides": "select dim_id, dim_id % 7 = 0 as keep_local, dim_id % 11 = 0 as accept from dims",
    "candidate_edges": "select dim_id, page, case when dim_id % 9 <> 0 then page * 10 + dim_id % 3 end as edge_id, cast(1 + dim_id % 4 as int) as coverage, case when dim_id % 13 = 0 then 'valve_dimension' when dim_id % 2 = 0 then 'pipe_length' end as kind, case when dim_id % 6 = 0 then 'branch' end as route_type from dims",
    "label_texts": """select p_partkey as label_id, cast(floor(p_partkey / 8) as int) as page, case p_partkey % 7 when 0 then 'DN' || p_size || 'X25' when 1 then ['X', 'y', 'Z+', 'Х'][p_partkey % 4 + 1] when 2 then cast(10000 + p_partkey % 80000 as varchar)
  when 3 then 'LC-' || lpad(cast(p_partkey % 10000 as varchar), 4, '0') when 4 then cast(20 + p_partkey % 900 as varchar) when 5 then 'SEE SHEET ' || (p_partkey % 50) || ' rd_0001 CO_0166'
  else p_name || ' ЛИСТ ' || (p_partkey % 30) || case when p_partkey % 2 = 0 then 'X300' else '' end end as txt, cast((p_partkey * 37) % 1000 as double) as cx, cast((p_partkey * 53) % 700 as double) as cy from part""",
    "words": "select page, page as block, label_id % 2 as line, label_id as word_id, txt as text, cx as x0, cy - 4 as y0, cx + 8 as x1, cy + 4 as y1 from label_texts",
    "stamp_words": """select page, w.idx as idx, w.text as text, cast(w.x0 as double) as x0, cast(w.x0 + 40 as double) as x1, cast(w.top as double) as top, cast(w.top + 8 as double) as bottom from (
  select cast(s_suppkey as int) as page, unnest([{'idx': 0, 'text': 'Номер', 'x0': 100, 'top': 600}, {'idx': 1 + s_suppkey % 7, 'text': 'линии', 'x0': 150, 'top': 600 + s_suppkey % 6},
    {'idx': 20, 'text': 'LC -', 'x0': 100, 'top': 618 + s_suppkey % 40}, {'idx': 21, 'text': lpad(cast(s_suppkey % 10000 as varchar), 4, '0'), 'x0': 142, 'top': 618 + s_suppkey % 40}]) as w from supplier)""",
    "feedback": """select event_id as id, ts as created_at, user_id as run_id, strftime(ts, '%Y-%m-%d') as candidate_id, case when event_type = 'error' then 'down' else 'up' end as rating, case when user_id % 2 = 0 then 'dimension' else 'length' end as prompt_name,
  case when event_id % 4 <> 0 then cast(event_id % 3 as varchar) end as prompt_version, case when event_id % 5 <> 0 then sha256(case when event_id % 4 <> 0 then cast(event_id % 3 as varchar) else '0' end) end as prompt_sha256
  from events where event_type in ('purchase', 'signup', 'error')""",
    "run_log": """select user_id as run_id, event_id as seq, ts as at, event_id % 3 as line_id, event_id % 12 as page, case event_type when 'error' then 'error' when 'purchase' then 'complete' when 'click' then 'running' else 'pending' end as status,
  floor(value * 4) / 4 as seconds, case when event_id % 3 = 0 then event_id % 1000 end as tokens from events""",
    "truth": "select cast(doc_id % 7 as varchar) as group_id, cast(doc_id % 4 as varchar) as sheet, doc_id as candidate_id, case when doc_id % 17 <> 0 then case when quality = 1 then 'include' else 'exclude' end end as status from labels",
    "answers": """select case when doc_id % 2 = 0 then 'S' else '' end || (doc_id % 4) as sheet, doc_id as candidate_id, case when (n_chars + pos) % 3 <> 0 then 'include' else 'exclude' end as status, pos
  from (select doc_id, n_chars, unnest(case when doc_id % 6 = 0 then [0, 1] else [0] end) as pos from documents where doc_id % 10 <> 3)""",
}


def with_views(sql: str, *names: str) -> str:
    """A query over some of VIEWS, in their order."""
    return "with " + ",\n".join(f"{n} as (\n{VIEWS[n]}\n)" for n in VIEWS if n in names) + ("\n" if sql.lstrip().startswith("select") else ",\n") + sql.strip()


def drawn_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(page, seg_id, x0, y0, x1, y1): thin strokes as they are drawn: in two halves, and every third with the two legs of an arrowhead at its end."""
    s = thin_strokes(spark, sf_dir)
    x0, y0, x1, y1 = (F.col(c) for c in ("x0", "y0", "x1", "y1"))
    size = F.sqrt((x1 - x0) * (x1 - x0) + (y1 - y0) * (y1 - y0))
    mx, my, ux, uy = (x0 + x1) / 2, (y0 + y1) / 2, (x1 - x0) / size, (y1 - y0) / size
    part = lambda k, *ends: F.struct(F.lit(k).alias("k"), *[v.alias(n) for v, n in zip(ends, ("x0", "y0", "x1", "y1"), strict=True)])
    legs = [part(2 + i, x1, y1, x1 - 6 * ux - side * 3 * uy, y1 - 6 * uy + side * 3 * ux) for i, side in enumerate((1, -1))]
    parts = F.concat(F.array(part(0, x0, y0, mx, my), part(1, mx, my, x1, y1)), F.when(F.col("stroke_id") % 3 == 0, F.array(*legs)).otherwise(F.array().cast("array<struct<k: int, x0: double, y0: double, x1: double, y1: double>>")))
    return s.select("page", "stroke_id", F.explode(parts).alias("p")).select("page", (F.col("stroke_id") * 4 + F.col("p.k")).alias("seg_id"), "p.x0", "p.y0", "p.x1", "p.y1")


def box_strokes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(page, x0, y0, x1, y1): the four sides of a box around every ninth label, those of odd number without one side, some wider than a box may be."""
    k, cx, cy = F.col("dim_id"), F.col("cx"), F.col("cy")
    half = (6 + k % 20).cast("double")
    sides = F.array(*[F.struct(F.lit(i).alias("i"), *[v.alias(n) for v, n in zip(ends, ("x0", "y0", "x1", "y1"), strict=True)]) for i, ends in enumerate(((cx - half, cy - 5, cx + half, cy - 5), (cx - half, cy + 5, cx + half, cy + 5), (cx - half, cy - 5, cx - half, cy + 5), (cx + half, cy + 5, cx + half, cy - 5)))])
    return dims(spark, sf_dir).filter(k % 9 == 0).select("page", "dim_id", F.explode(sides).alias("s")).filter((F.col("dim_id") % 2 == 0) | (F.col("s.i") != 3)).select("page", "s.x0", "s.y0", "s.x1", "s.y1")


def coordinate_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(page, id, is_label, x0, x1, cy): axis letters and, on most of their rows, a value to their right, some too far or too low."""
    k = F.col("label_id")
    letters = label_texts(spark, sf_dir).filter(k % 7 == 1).select("page", k.alias("id"), F.lit(True).alias("is_label"), F.col("cx").alias("x0"), (F.col("cx") + 8).alias("x1"), "cy")
    values = letters.filter("id % 5 <> 0").select("page", (F.col("id") + 1_000_000_000).alias("id"), F.lit(False).alias("is_label"), (F.col("x1") + F.col("id") % 11).alias("x0"), (F.col("x1") + F.col("id") % 11 + 30).alias("x1"), (F.col("cy") + F.col("id") % 4 - 1).alias("cy"))
    return letters.unionByName(values)


VIEWS |= {
    "boxes": """select page, unnest([{'x0': cx - h, 'y0': cy - 5, 'x1': cx + h, 'y1': cy - 5}, {'x0': cx - h, 'y0': cy + 5, 'x1': cx + h, 'y1': cy + 5}, {'x0': cx - h, 'y0': cy - 5, 'x1': cx - h, 'y1': cy + 5}] || case when dim_id % 2 = 0 then [{'x0': cx + h, 'y0': cy + 5, 'x1': cx + h, 'y1': cy - 5}] else [] end, recursive := true)
  from (select *, cast(6 + dim_id % 20 as double) as h from dims where dim_id % 9 = 0)""",
    "letters": """select page, label_id as id, cx as x0, cx + 8 as x1, cy from label_texts where label_id % 7 = 1""",
    "letter_values": """select page, id + 1000000000 as id, x1 + id % 11 as x0, cy + id % 4 - 1 as cy from letters where id % 5 <> 0""",
    "drawn": """select page, stroke_id * 4 as seg_id, x0, y0, (x0 + x1) / 2 as x1, (y0 + y1) / 2 as y1 from thin union all select page, stroke_id * 4 + 1, (x0 + x1) / 2, (y0 + y1) / 2, x1, y1 from thin
  union all select page, stroke_id * 4 + 2 + k, x1, y1, x1 - 6 * ((x1 - x0) / size) - f * 3 * ((y1 - y0) / size), y1 - 6 * ((y1 - y0) / size) + f * 3 * ((x1 - x0) / size) from (select *, sqrt((x1 - x0) * (x1 - x0) + (y1 - y0) * (y1 - y0)) as size from thin where stroke_id % 3 = 0), (values (0, 1), (1, -1)) as legs(k, f)""",
}
