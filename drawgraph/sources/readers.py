"""Sources: version logs, sectioned texts, page ranges, decoded pages; all read by Spark, from any store it reaches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

VERSION = "version int, created_at string, text string, sha256 string"


def versions(spark: SparkSession, path: str) -> DataFrame:
    """A JSON-lines log of texts. Blank, broken and non-object lines are left out; missing numbers and hashes are filled in."""
    lines = spark.read.text(path).filter(F.trim("value") != "")
    rows = lines.select("value", F.from_json("value", VERSION, {"mode": "PERMISSIVE"}).alias("v")).filter(F.schema_of_variant(F.try_parse_json("value")).startswith("OBJECT") & F.col("v.text").isNotNull())
    place = F.row_number().over(Window.orderBy("created_at", "text")) - 1  # one prompt's log is short
    return rows.select("v.*").withColumn("version", F.coalesce("version", place)).withColumn("sha256", F.coalesce("sha256", F.sha2("text", 256)))


def active_version(log: DataFrame, text: str, remembered: int | None = None) -> DataFrame:
    """Log with is_active: the remembered version if its text is the one in use, else the last of that text."""
    sha = F.sha2(F.lit(text), 256)
    same = log.filter(F.col("sha256") == sha).agg(F.max("version").alias("last"), F.bool_or(F.col("version") == F.lit(remembered)).alias("kept"))
    active = F.when(F.col("kept"), F.lit(remembered)).otherwise(F.col("last"))
    return log.join(F.broadcast(same)).withColumn("is_active", F.coalesce(F.col("version") == active, F.lit(False))).drop("last", "kept")  # one row


def append_version(log: DataFrame, text: str, at: str) -> DataFrame:
    """The log with one more version, unless the last has this text."""
    last = log.agg(F.max_by("text", "version").alias("text"), F.count(F.lit(1)).alias("n"))
    new = last.filter(~F.col("text").eqNullSafe(F.lit(text))).select(F.col("n").cast("int").alias("version"), F.lit(at).alias("created_at"), F.lit(text).alias("text"), F.sha2(F.lit(text), 256).alias("sha256"))
    return log.select("version", "created_at", "text", "sha256").unionByName(new)


def sections(spark: SparkSession, path: str) -> DataFrame:
    """(file, section, row, fields): lines of a text with # headers, parted by tabs; the header before a line is its section."""
    lines = spark.read.option("wholetext", True).text(path).select(F.input_file_name().alias("file"), F.posexplode(F.split("value", r"\r?\n")).alias("row", "line"))
    header = F.when(F.col("line").startswith("#"), F.trim(F.regexp_replace("line", r"^#+", "")))
    order = Window.partitionBy("file").orderBy("row")
    found = lines.withColumn("section", F.last(header, ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return found.filter(~F.col("line").startswith("#") & (F.trim("line") != "")).select("file", "section", "row", F.split("line", "\t").alias("fields"))


def page_ranges(c: Column) -> Column:
    """S14: '1,3-5' as sorted distinct page numbers; other texts are an error."""
    parts = F.filter(F.transform(F.split(c, ","), lambda p: F.trim(p)), lambda p: p != "")
    bad = F.exists(parts, lambda p: ~p.rlike(r"^\d+(\s*-\s*\d+)?$"))
    low = lambda p: F.regexp_extract(p, r"^(\d+)", 1).cast("int")
    high = lambda p: F.regexp_extract(p, r"(\d+)$", 1).cast("int")
    wrong = F.exists(parts, lambda p: (low(p) <= 0) | (low(p) > high(p)))
    return F.when(bad | wrong, F.raise_error(F.lit("page numbers look like 1,3-5"))).otherwise(F.array_sort(F.array_distinct(F.flatten(F.transform(parts, lambda p: F.sequence(low(p), high(p)))))))


def classed_strokes(raw: DataFrame, thin: float = 0.8, thick: float = 0.95, least: float = 10.0) -> DataFrame:
    """Axes by width, dimension lines by width and length; what lies between the widths is left out. index is dense per page."""
    size = F.sqrt((F.col("x1") - F.col("x0")) ** 2 + (F.col("y1") - F.col("y0")) ** 2)
    kind = F.when((F.col("linewidth") <= thin) & (size >= least), "dimension").when(F.col("linewidth") >= thick, "axis")
    rows = raw.withColumns({"length": size, "kind": kind}).filter("kind is not null")
    return rows.withColumn("index", F.row_number().over(Window.partitionBy("page").orderBy("stroke_id")) - 1)


def drawing_segments(items: DataFrame, boxes: DataFrame, least: float = 6.0) -> DataFrame:
    """items(page, item_id, op, points) of lines and curves as segments from first to last point, but for short ones and sides of boxes."""
    s = items.filter(F.col("op").isin("l", "c") & (F.size("points") >= 2)).select("page", "item_id", F.get("points", F.lit(0)).alias("a"), F.element_at("points", -1).alias("b"))
    s = s.filter((F.col("a.x") - F.col("b.x")) ** 2 + (F.col("a.y") - F.col("b.y")) ** 2 >= least * least)
    near = lambda u, v: F.abs(u - v) <= 1
    tall = near(F.col("a.x"), F.col("b.x")) & (near(F.col("a.x"), F.col("x0")) | near(F.col("a.x"), F.col("x1"))) & (F.least("a.y", "b.y") >= F.col("y0") - 1) & (F.greatest("a.y", "b.y") <= F.col("y1") + 1)
    flat = near(F.col("a.y"), F.col("b.y")) & (near(F.col("a.y"), F.col("y0")) | near(F.col("a.y"), F.col("y1"))) & (F.least("a.x", "b.x") >= F.col("x0") - 1) & (F.greatest("a.x", "b.x") <= F.col("x1") + 1)
    return s.join(boxes.withColumnRenamed("page", "p"), (F.col("page") == F.col("p")) & (tall | flat), "left_anti")


def cached(spark: SparkSession, folder: str, parts: list[str], make) -> DataFrame:
    """Decoded pages kept as Parquet under a hash of what they depend on; made where there are none."""
    import hashlib

    path = f"{folder.rstrip('/')}/{hashlib.sha256('|'.join(parts).encode()).hexdigest()}"
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    if not hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop):
        make().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)
