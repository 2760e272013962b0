"""Words of a page as they stand in blocks and lines: dimension numbers, coordinates, the stamp's line number."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as x

# Page sizes with a known drawing area, and distances of the stamp.
PAGE_SIZES, PAGE_SLACK = ((1190.55, 841.89), (842.0, 595.0), (1684.0, 1190.0)), 10.0
DRAWING_AREA = (56.9, 13.0, 810.0, 705.0)
OTHER_WIDTH, OTHER_HEIGHT = 0.65, 0.83
STAMP_HEAD, STAMP_NEXT = "номер", "линии"
HEAD_WORDS, HEAD_ROW, BELOW, BESIDE = 5, 4.0, (8.0, 42.0), 30.0
COORDINATE_WORDS = ("X", "Y", "Z", "Z+", "Z-")


def drawing_area(width: Column, height: Column) -> Column:
    """struct(x0, y0, x1, y1) by page size; of unknown sizes a share from the upper left corner."""
    box = lambda *v: F.struct(*[c.cast("double").alias(n) for n, c in zip(("x0", "y0", "x1", "y1"), v, strict=True)])
    known = F.lit(False)
    for w, h in PAGE_SIZES:
        known = known | ((F.abs(width - w) < PAGE_SLACK) & (F.abs(height - h) < PAGE_SLACK))
    return F.when(known, box(*map(F.lit, DRAWING_AREA))).otherwise(box(F.lit(0.0), F.lit(0.0), width * OTHER_WIDTH, height * OTHER_HEIGHT))


def dimension_numbers(words: DataFrame, rectangles: DataFrame, area: tuple[float, float, float, float] = DRAWING_AREA) -> DataFrame:
    """Numeric words(page, block, line, word_id, text, x0, y0, x1, y1) in the drawing area, with what speaks against them.

    rule is null for dimension numbers, else inside_rect (a rectangle(page, x0, y0, x1, y1) holds the word) or coord (a word on its line marks coordinates).
    Of words alike in text and place to one digit the first stays."""
    marked = F.bool_or(x.marks_coordinate(F.trim("text"))).over(Window.partitionBy("page", "block", "line"))
    ax0, ay0, ax1, ay1 = area
    numbers = words.withColumns({"coord": marked, "value": x.number(F.trim("text"))}).filter("value is not null")
    numbers = numbers.filter((F.col("x0") < ax1) & (F.col("x1") > ax0) & (F.col("y0") < ay1) & (F.col("y1") > ay0))
    w, r = numbers.alias("w"), rectangles.alias("r")
    inside = (F.col("w.page") == F.col("r.page")) & (F.col("w.x0") >= F.col("r.x0") - 1) & (F.col("w.x1") <= F.col("r.x1") + 1) & (F.col("w.y0") >= F.col("r.y0") - 1) & (F.col("w.y1") <= F.col("r.y1") + 1)
    held = w.join(r, inside, "left_semi").select("page", "word_id", F.lit(True).alias("held"))
    ruled = numbers.join(held, ["page", "word_id"], "left").withColumn("rule", F.when(F.col("held"), "inside_rect").when(F.col("coord"), "coord"))
    same = Window.partitionBy("page", F.col("rule").isNull(), "text", F.round("x0", 1), F.round("y0", 1)).orderBy("word_id")
    return ruled.withColumn("place", F.row_number().over(same)).filter("rule is not null or place = 1").select("page", "word_id", "value", "rule")


def word_coordinates(words: DataFrame) -> DataFrame:
    """For each coordinate word the nearest number to its right on its line: (page, label_id, label, word_id, value)."""
    label = F.upper(F.trim("text"))
    l = words.withColumn("label", label).filter(F.col("label").isin(*COORDINATE_WORDS)).select("page", "block", "line", F.col("word_id").alias("label_id"), "label", F.col("x1").alias("after"))
    v = words.filter(F.trim("text").rlike(x.NUMBER)).select("page", "block", "line", "word_id", F.trim("text").alias("value"), "x0")
    best = F.min_by(F.struct("word_id", "value"), F.struct("x0", "word_id"))
    return l.join(v, ["page", "block", "line"]).filter(F.col("x0") >= F.col("after") - 1).groupBy("page", "label_id", "label").agg(best.alias("best")).select("page", "label_id", "label", "best.*")


def stamp_lines(words: DataFrame) -> DataFrame:
    """The first line number in the box below a page's two stamp words: words(page, idx, text, x0, x1, top, bottom) to (page, line_id)."""
    word = F.lower(F.trim("text"))
    a = words.filter(word == STAMP_HEAD).alias("a")
    b = words.filter(word == STAMP_NEXT).alias("b")
    near = (F.col("a.page") == F.col("b.page")) & (F.col("b.idx") - F.col("a.idx")).between(1, HEAD_WORDS) & (F.abs(F.col("b.top") - F.col("a.top")) <= HEAD_ROW)
    heads = a.join(b, near).select("a.page", F.col("a.idx").alias("head"), F.col("b.idx").alias("next"), F.least("a.x0", "b.x0").alias("left"), F.greatest("a.x1", "b.x1").alias("right"), F.greatest("a.bottom", "b.bottom").alias("low")).alias("h")
    v = words.alias("v")
    under = (F.col("h.page") == F.col("v.page")) & F.col("v.top").between(F.col("h.low") + BELOW[0], F.col("h.low") + BELOW[1]) & (F.col("v.x0") >= F.col("h.left") - BESIDE) & (F.col("v.x1") <= F.col("h.right") + BESIDE)
    texts = heads.join(v, under).groupBy("h.page", "h.head", "h.next").agg(F.array_sort(F.collect_list(F.struct("v.top", "v.x0", "v.text"))).alias("held"))
    found = texts.withColumn("line_id", F.get(x.line_ids_unspaced(F.array_join(F.transform("held", lambda w: w["text"]), " ")), F.lit(0))).filter("line_id is not null")
    return found.groupBy("page").agg(F.min_by("line_id", F.struct("head", "next")).alias("line_id"))


# How far below the middle of the word before a line may go on, words that name a connection, an explicit reference to a sheet.
LINE_STEP = 8.0
CONNECTION_WORDS = ("ПОДКЛЮЧЕНИЕ", "TIE-IN", "TIE IN")
SHEET_NAMED = r"(?iuU)\bЛИСТ\b\s*[:№]?\s*(?:№\s*)?\d+"


def reading_rows(words: DataFrame, step: float = LINE_STEP) -> DataFrame:
    """words(page, pos, x0, y0, x1, y1, text) in scan order with their line, from 1: a line opens where the top of a word is further than step from the middle of the word before. Blank words count for nothing."""
    order = Window.partitionBy("page").orderBy("pos")
    said = words.filter(F.trim("text") != "").withColumn("text", F.trim("text"))
    opens = F.abs(F.col("y0") - F.lag((F.col("y0") + F.col("y1")) / 2).over(order)) > step
    return said.withColumn("opens", F.coalesce(opens, F.lit(False)).cast("int")).withColumn("line", F.sum("opens").over(order) + 1).drop("opens")


def connection_lines(words: DataFrame, strict: bool = True) -> DataFrame:
    """Lines of a page that name a connection or another sheet: (page, line, label, x0, y0, x1, y1, kind, sheet, hint). A label has its words from left to right; lines count with those left out."""
    lines = reading_rows(words).groupBy("page", "line").agg(F.array_sort(F.collect_list(F.struct("x0", "pos", "text"))).alias("parts"), F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"))
    lines = lines.withColumn("label", F.array_join(F.transform("parts", lambda w: w["text"]), " "))
    named = x.any_of([F.contains(F.upper("label"), F.lit(k)) for k in CONNECTION_WORDS])
    kept = lines.filter(named | F.col("label").rlike(SHEET_NAMED)).withColumn("c", x.connection_class(F.col("label"), strict))
    kept = kept.filter((F.col("c.kind") != "other") | F.col("c.hint") | named)
    return kept.select("page", "line", "label", "x0", "y0", "x1", "y1", "c.kind", "c.sheet", "c.hint")
