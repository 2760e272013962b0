"""Quality rules whose cut-offs follow the corpus: quantile sketches per language and source.

Each text is measured once, in its row. The measures go into mergeable quantile sketches: counts of
log-linear bins (whole numbers keep their seven leading bits, so a bin is within 1/64 of its values).
Adding counts merges sketches, so map tasks combine first and a hot source costs no more than another.
Fences come from the quartiles of a group; a group of few documents uses the merged sketch of its
language, and a language of few documents that of all.

Defined results: a null text has no words and fails the base rule; null languages and sources are groups
of their own; repeated rows count as often as they stand; an empty table gives an empty result; columns
named like the operator's own are replaced, others pass through, text excepted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import SPACES, count_words, settle, squeeze

#: Measures, scaled to whole numbers: (name, numerator, denominator, scale, smallest spread that counts, sides that are fenced).
MEASURES = (
    ("symbol_rate", "n_symbols", "word_chars", 10_000, 100, "above"),
    ("dup_line_rate", "n_dup_lines", "n_lines", 10_000, 500, "above"),
    ("repeat_rate", "n_repeat_words", "n_words", 10_000, 300, "above"),
    ("word_length", "word_chars", "n_words", 1_000, 250, "both"),
)
#: Fences stand so many spreads (upper less lower quartile) beyond the quartiles.
REACH = 4
#: Documents that a group needs for fences of its own.
LEAST_DOCS = 100
#: The base rule.
LEAST_WORDS, MOST_REPEATED_PERCENT = 50, 50

_COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def _f(name: str, *args) -> Column:
    return F.call_function(name, *[a if isinstance(a, Column) else F.lit(a) for a in args])


def measure(docs: DataFrame) -> DataFrame:
    """The counts of every text, taken in its row; the text itself is left behind.

    Repeated three-word windows: their 64-bit hashes are sorted with their places packed into the low bits, equal
    neighbours are repeats, and the words under the union of their windows are counted. Rows without a repeat stop early.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    own = {*_COUNTS, "n_lines", "base_failed", "kept", "text", *[m[0] for m in MEASURES]}
    df = docs.select(*[c for c in docs.columns if c not in own], squeeze(F.col("text"), SPACES).alias("__flat"),
                     (F.length(text) - F.length(F.translate(text, "#*$%&|<>", ""))).cast("long").alias("n_symbols"),
                     F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")).alias("__lines"))
    df = df.withColumn("n_words", count_words(F.col("__flat")))
    df = df.withColumn("word_chars", F.when(F.col("n_words") > 0, F.length("__flat") - F.col("n_words") + 1).otherwise(0).cast("long"))
    df = df.withColumn("n_lines", F.size("__lines").cast("long")).withColumn("n_dup_lines", (F.col("n_lines") - F.size(F.array_distinct("__lines"))).cast("long")).drop("__lines")
    df = df.withColumn("__w", F.split("__flat", " ")).drop("__flat")
    df = df.withColumn("__g", F.when(F.col("n_words") >= 4, F.transform(F.slice("__w", F.lit(1), (F.col("n_words") - 2).cast("int")), lambda x, i: F.xxhash64(x, F.get("__w", i + 1), F.get("__w", i + 2))))).drop("__w")
    df = df.withColumn("__again", F.coalesce(F.size(F.array_distinct("__g")) < F.size("__g"), F.lit(False)))
    df = df.withColumn("__bits", F.length(F.bin("n_words")).cast("int"))
    packed = F.sort_array(F.transform("__g", lambda x, i: _f("shiftleft", _f("shiftright", x, F.col("__bits")), F.col("__bits")) + i.cast("long")))
    df = df.withColumn("__p", F.when(F.col("__again"), packed))
    df = df.withColumn("__at", F.transform("__p", lambda x: x.bitwiseAND(_f("shiftleft", F.lit(1).cast("long"), F.col("__bits")) - 1).cast("int"))).drop("__p")
    df = df.withColumn("__s", F.transform("__at", lambda x: F.get("__g", x))).drop("__g")
    twice = F.filter("__at", lambda x, i: F.coalesce((F.get("__s", i) == F.get("__s", i + 1)), F.lit(False)) | F.coalesce((i > 0) & (F.get("__s", i) == F.get("__s", F.greatest(i - 1, F.lit(0)))), F.lit(False)))
    df = df.withColumn("__twice", F.sort_array(twice)).drop("__s", "__at")
    covered = F.aggregate("__twice", F.struct(F.lit(0).cast("int").alias("n"), F.lit(0).cast("int").alias("end")), lambda a, p: F.struct((a["n"] + p + 3 - F.greatest(a["end"], p)).cast("int").alias("n"), (p + 3).cast("int").alias("end")))
    return df.withColumn("n_repeat_words", F.coalesce(covered["n"], F.lit(0)).cast("long")).drop("__twice", "__again", "__bits")


def bin_of(x: Column) -> Column:
    """The log-linear bin of a whole number from 0: its seven leading bits, zeros below."""
    step = F.greatest(F.length(F.bin(x)) - 7, F.lit(0))
    return _f("shiftleft", _f("shiftright", x, step), step)


def sketches(measured: DataFrame, by: tuple[str, ...] = ("lang", "source")) -> DataFrame:
    """Rows (by..., measure, bin, n): a quantile sketch for each group and measure. Texts without words have no part in it."""
    values = F.array(*[F.struct(F.lit(name).alias("measure"), bin_of(F.floor(F.col(num) * scale / F.greatest(F.col(den), F.lit(1))).cast("long")).alias("bin")) for name, num, den, scale, _, _ in MEASURES])
    return measured.filter("n_words > 0").select(*by, F.explode(values).alias("x")).groupBy(*by, "x.measure", "x.bin").agg(F.count(F.lit(1)).alias("n"))


def fences(sketch: DataFrame, by: tuple[str, ...], reach: int = REACH) -> DataFrame:
    """From merged sketches: rows (by..., docs, and low and high of each measure)."""
    merged = sketch.groupBy(*by, "measure", "bin").agg(F.sum("n").alias("n"))
    run = Window.partitionBy(*by, "measure").orderBy("bin")
    ranked = merged.withColumn("run", F.sum("n").over(run)).withColumn("all", F.sum("n").over(Window.partitionBy(*by, "measure")))
    quartiles = ranked.groupBy(*by, "measure").agg(F.max("all").alias("docs"), F.min(F.when(F.col("run") * 4 >= F.col("all"), F.col("bin"))).alias("q1"), F.min(F.when(F.col("run") * 4 >= F.col("all") * 3, F.col("bin"))).alias("q3"))
    out = []
    for name, _, _, _, least, _ in MEASURES:
        spread = F.greatest(F.col("q3") - F.col("q1"), F.lit(least))
        mine = F.col("measure") == name
        out += [F.max(F.when(mine, F.col("q1") - reach * spread)).alias(f"{name}_low"), F.max(F.when(mine, F.col("q3") + reach * spread)).alias(f"{name}_high")]
    return quartiles.groupBy(*by).agg(F.max("docs").alias("docs"), *out)


def apply_quality_rules(docs: DataFrame, reach: int = REACH, least_docs: int = LEAST_DOCS) -> DataFrame:
    """docs(doc_id, text, lang, source, ...) with the counts, base_failed, the rules that a text broke and kept."""
    measured = settle(measure(docs), "measured")
    sketch = settle(sketches(measured), "sketch")
    ends = [f"{m[0]}_{s}" for m in MEASURES for s in ("low", "high")]
    own = fences(sketch, ("lang", "source"), reach)
    lang = fences(sketch, ("lang",), reach)
    every = fences(sketch, (), reach)
    table = own.alias("o").join(lang.alias("l"), F.col("o.lang").eqNullSafe(F.col("l.lang")), "left").join(F.broadcast(every).alias("e"))  # every is one row
    pick = lambda c: F.when(F.col("o.docs") >= least_docs, F.col(f"o.{c}")).when(F.col("l.docs") >= least_docs, F.col(f"l.{c}")).otherwise(F.col(f"e.{c}"))
    table = settle(table.select(F.col("o.lang").alias("__lang"), F.col("o.source").alias("__source"), *[pick(c).alias(f"__{c}") for c in ends]), "fences")
    rows = measured.join(table, F.col("lang").eqNullSafe(F.col("__lang")) & F.col("source").eqNullSafe(F.col("__source")), "left")
    broke = []
    for name, num, den, scale, _, sides in MEASURES:
        x = F.floor(F.col(num) * scale / F.greatest(F.col(den), F.lit(1))).cast("long")
        out = x > F.col(f"__{name}_high")
        broke.append(F.when(out | (x < F.col(f"__{name}_low")) if sides == "both" else out, F.lit(name)))
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED_PERCENT * F.col("n_words"))
    rows = rows.withColumn("base_failed", failed).withColumn("broke", F.array_compact(F.array(*broke)))
    rows = rows.withColumn("kept", ~F.col("base_failed") & (F.size("broke") == 0))
    return rows.drop("__lang", "__source", *[f"__{c}" for c in ends])


