"""License scans by ordered signature rules, in DataFrame operations only.

A text is normalised once, in its row. Texts without any gate word are done there. For others, the rules
whose keyword stands in the text are tried; every match is an interval of the text. Intervals are sorted
by start, then by length, level and rule order, and one fold keeps the reach of each level so far: a match
that lies within an earlier one of its own or a stronger level is suppressed. There is no shuffle, and
nothing is held but a row's own matches.

Defined results: a null text has no words and no labels; a long text with many matches takes time in
proportion to them, but for their sorting; repeated rows are scanned each by itself; an empty
table gives an empty result; columns named like the operator's own are replaced, others pass through, the
text excepted.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from itertools import groupby

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import NON_WORD, count_words, lower_ascii, squeeze
from .license_rules import BASE, GATES, build

#: Score by the strongest level that stays.
SCORES = {1: 1.0, 2: 0.8, 3: 0.5}

#: Matches that are laid out in one fold.
PIECE = 256

_SPAN = "array<struct<start:int,back:int,level:int,ord:int,end:int,label:string>>"


def _spaces(text: Column) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit(" "), F.lit("")))


def _rules() -> Column:
    """An array of (keyword, rules) in rule order; rules of one keyword share its test."""
    rules = [(*r, i) for i, r in enumerate(build())]
    return F.array(*[F.struct(F.lit(k).alias("keyword"), F.array(*[F.struct(F.lit(label).alias("label"), F.lit(level).alias("level"), F.lit(f"(?<= )(?:{rx})(?= )").alias("rx"), F.lit(i).alias("ord")) for label, level, _, rx, i in own]).alias("rules")) for k, own in groupby(sorted(rules, key=lambda r: r[2]), key=lambda r: r[2])])


def _once(x: Column, f: Callable[[Column], Column]) -> Column:
    """f of a value that is computed once, however often f names it."""
    return F.get(F.transform(F.array(x), f), F.lit(0))


def _matches(text: Column, rule: Column) -> Column:
    """Intervals of all matches of a rule: what stands between matches and the matches themselves, laid end to end.

    A fold copies what it has gathered at every step, so matches are laid in pieces of PIECE, each from where the pieces before end."""

    def lay(a, x):
        start = a["at"] + x["gap"]
        span = F.struct(start.cast("int").alias("start"), (-x["hit"]).cast("int").alias("back"), rule["level"].alias("level"), rule["ord"].alias("ord"), (start + x["hit"]).cast("int").alias("end"), rule["label"].alias("label"))
        return F.struct((start + F.coalesce(x["hit"], F.lit(0))).cast("int").alias("at"), F.when(x["hit"].isNull(), a["out"]).otherwise(F.concat(a["out"], F.array(span))).alias("out"))

    def laid(piece, at):
        return F.aggregate(piece, F.struct(at.cast("int").alias("at"), F.array().cast(_SPAN).alias("out")), lay, lambda a: a["out"])

    def starts(pieces):
        sizes = F.transform(pieces, lambda p: F.aggregate(p, F.lit(0), lambda a, x: (a + x["gap"] + F.coalesce(x["hit"], F.lit(0))).cast("int")))
        return F.aggregate(sizes, F.array(F.lit(0)), lambda a, n: F.concat(a, F.array((F.element_at(a, -1) + n).cast("int"))), lambda a: F.slice(a, 1, F.size(a) - 1))

    parts = F.zip_with(F.split(text, rule["rx"]), F.regexp_extract_all(text, rule["rx"], F.lit(0)), lambda gap, hit: F.struct(F.length(gap).alias("gap"), F.length(hit).alias("hit")))
    pieces = _once(parts, lambda p: F.transform(F.sequence(F.lit(0), F.size(p) - 1, F.lit(PIECE)), lambda i: F.slice(p, i + 1, F.lit(PIECE))))
    return _once(pieces, lambda ps: F.flatten(F.zip_with(ps, starts(ps), laid)))


def _settled(spans: Column) -> Column:
    """Labels, count and strongest level of the matches that no earlier and at least as strong one contains."""
    start = F.struct(F.lit(-1).alias("e1"), F.lit(-1).alias("e2"), F.lit(-1).alias("e3"), F.array().cast("array<string>").alias("labels"), F.lit(0).alias("n"), F.lit(9).alias("best"))

    def fold(a, x):
        reach = F.when(x["level"] == 1, a["e1"]).when(x["level"] == 2, F.greatest(a["e1"], a["e2"])).otherwise(F.greatest(a["e1"], a["e2"], a["e3"]))
        stays = x["end"] > reach
        ends = [F.when(x["level"] == k, F.greatest(a[f"e{k}"], x["end"])).otherwise(a[f"e{k}"]).alias(f"e{k}") for k in (1, 2, 3)]
        return F.struct(*ends, F.when(stays, F.array_union(a["labels"], F.array(x["label"]))).otherwise(a["labels"]).alias("labels"), F.when(stays, a["n"] + 1).otherwise(a["n"]).alias("n"), F.when(stays, F.least(a["best"], x["level"])).otherwise(a["best"]).alias("best"))

    return F.aggregate(F.array_sort(spans), start, fold)


def scan(docs: DataFrame) -> DataFrame:
    """docs(text, ...) without text, with n_words, n_base, first_word, last_word, base_labels, labels, n_found and score."""
    own = {"n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "n_found", "score", "text"}
    flat = squeeze(lower_ascii(F.col("text")), NON_WORD)
    df = docs.select(*[c for c in docs.columns if c not in own], flat.alias("__flat"))
    df = df.select(*[c for c in df.columns if c != "__flat"], count_words(F.col("__flat")).alias("n_words"), F.concat(F.lit(" "), F.col("__flat"), F.lit(" ")).alias("__t"))
    t = F.col("__t")
    df = df.withColumn("__gate", reduce(lambda a, b: a | b, [t.contains(g) for g in GATES]))
    for i, (phrase, _) in enumerate(BASE):
        has = F.col("__gate") & t.contains(f" {phrase} ")
        df = df.withColumn(f"__n{i}", F.when(has, F.size(F.regexp_extract_all(t, F.lit(f"(?<= ){phrase}(?= )"), F.lit(0)))).otherwise(0).cast("long"))
        df = df.withColumn(f"__a{i}", F.when(has, _spaces(F.substring(t, F.lit(1), F.instr(t, f" {phrase} ") - 1))).cast("long"))
        after = _spaces(F.substring_index(t, f" {phrase} ", -1))
        df = df.withColumn(f"__z{i}", F.when(has, F.col("n_words") - after - len(phrase.split(" "))).cast("long"))
    tried = F.flatten(F.transform(F.filter(_rules(), lambda k: F.contains(t, k["keyword"])), lambda k: F.flatten(F.transform(F.filter(k["rules"], lambda r: F.rlike(t, r["rx"])), lambda r: _matches(t, r)))))
    df = df.withColumn("__found", F.when(F.col("__gate"), _settled(tried)))
    every = range(len(BASE))
    base = F.array_compact(F.array(*[F.when(F.col(f"__n{i}") > 0, F.lit(label)) for i, (_, label) in enumerate(BASE)]))
    labels = F.array_union(base, F.coalesce(F.col("__found.labels"), F.array().cast("array<string>")))
    best = F.least(F.coalesce(F.col("__found.best"), F.lit(9)), F.when(F.size(base) > 0, F.lit(3)).otherwise(9))
    df = df.withColumn("n_base", reduce(lambda a, b: a + b, [F.col(f"__n{i}") for i in every])).withColumn("first_word", F.least(*[F.col(f"__a{i}") for i in every])).withColumn("last_word", F.greatest(*[F.col(f"__z{i}") for i in every]))
    df = df.withColumn("base_labels", F.array_join(F.array_sort(base), ",")).withColumn("labels", F.array_join(F.array_sort(labels), ",")).withColumn("n_found", F.coalesce(F.col("__found.n"), F.lit(0)).cast("long"))
    score = F.lit(0.0)
    for level, value in SCORES.items():
        score = F.when(best == level, F.lit(value)).otherwise(score)
    return df.withColumn("score", score).drop("__t", "__gate", "__found", *[f"__{x}{i}" for x in "naz" for i in every])
