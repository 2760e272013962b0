"""Mixing sources to target weights by weighted fair queueing, in DataFrame operations only.

Every document gets a place in its source's shuffled order (by the MD5 of its id) and a virtual finish
time: the source's words up to and with it, divided by the source's target. A second pass over a source
goes on where the first ended. All copies are ordered by finish time over all sources and taken until the
total budget is used up.

At scale: a hot source does not meet in one task. Its running sum is taken per slice of the MD5 range,
and the sums of the slices before it are added; slices follow the number of documents. The cut in the
global order is found by two histograms over ranges of finish time, so only one thin range of copies is
ever sorted in one place.

Defined results: a null text has size 0; null is a source of its own, ordered last; documents without
words are never taken and cost nothing; rows that repeat an id are placed by id, then text, and rows equal in
both in any order, as they are alike; an empty table gives an empty result; further columns pass through
untouched, text only where it is asked for, but for those named like the operator's own, which are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import SPACES, count_words, key_of, settle, squeeze

#: Documents that one slice of a source's order holds at most, about; there are 256 slices at least.
SLICE_DOCS = 100_000
#: Ranges of finish time per histogram; two rounds leave about one in their square of the copies.
RANGES = 1024


def targets(sizes: DataFrame, weights: tuple[int, ...] = (3, 1, 2), budget: tuple[int, int] = (3, 2), most: int = 2) -> DataFrame:
    """Target words for each row of sizes(source, source_size): weights repeat over the sources in code point order.

    The budget, a fraction of all words, is shared by weight; a source over most times its size stops there, and what
    it leaves is shared again by weight among the rest, until none is above. Each round is one aggregate of one row.
    """
    above = Window.orderBy(F.col("source").asc_nulls_last())
    pool = settle(sizes.withColumn("place", F.row_number().over(above) - 1).withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (F.col("place") % len(weights)) + 1).cast("long")).drop("place"), "sources")
    total = pool.agg(F.coalesce(F.sum("source_size"), F.lit(0))).first()[0]
    num, den = budget
    full: Column = F.lit(False)  # sources that stop at their most
    left, share = num * total, pool.agg(F.sum("weight")).first()[0] or 1
    while True:
        # left / den / share is the level: target words for each unit of weight. Whole numbers decide, so no rounding does.
        now = full | (F.col("source_size") * F.lit(most * den) * F.lit(share) < F.lit(left) * F.col("weight"))
        held, weight = pool.filter(now).agg(F.coalesce(F.sum("source_size"), F.lit(0)), F.coalesce(F.sum("weight"), F.lit(0))).first()
        rest = pool.agg(F.sum("weight")).first()[0] or 0
        if (num * total - most * den * held, rest - weight) == (left, share) or rest == weight:
            full = now
            break
        left, share, full = num * total - most * den * held, rest - weight, now
    level = F.lit(float(left)) * F.col("weight") / F.lit(float(den * share))
    return pool.withColumn("target", F.when(full, (F.col("source_size") * most).cast("double")).otherwise(level))


def mix_sources(docs: DataFrame, weights: tuple[int, ...] = (3, 1, 2), budget: tuple[int, int] = (3, 2), most: int = 2, keep_text: bool = False) -> DataFrame:
    """docs(doc_id, text, source, ...) with size, source_size, target, finish (of the first copy) and taken; with keep_text also text."""
    own = ["size", "source_size", "target", "finish", "taken"]
    if keep_text:  # rows get numbers, are mixed without their texts, and meet them again by number: texts are shuffled once, and no number repeats
        whole = settle(docs.drop(*own, "__row").withColumn("__row", F.monotonically_increasing_id()), "whole")
        mixed = mix_sources(whole.select("doc_id", "text", "source", "__row"), weights, budget, most)
        return whole.join(mixed.select("__row", *own), "__row").drop("__row")
    kept = [c for c in docs.columns if c not in (*own, "doc_id", "source", "text")]
    size = count_words(squeeze(F.col("text"), SPACES))
    rows = docs.select("doc_id", "source", *kept, size.alias("size"), key_of(F.col("text")).alias("__key"), F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).alias("__order"))
    rows = settle(rows, "sized")
    n = rows.count()
    digits = 2
    while 16**digits * SLICE_DOCS < n:
        digits += 1
    rows = rows.withColumn("__slice", F.substring("__order", 1, digits))
    slices = settle(rows.groupBy("source", "__slice").agg(F.sum("size").alias("__sum")), "slices")
    goals = targets(slices.groupBy("source").agg(F.sum("__sum").alias("source_size")), weights, budget, most)
    before = Window.partitionBy("source").orderBy("__slice").rowsBetween(Window.unboundedPreceding, -1)
    starts = slices.withColumn("__start", F.coalesce(F.sum("__sum").over(before), F.lit(0))).drop("__sum")
    starts = starts.alias("a").join(goals.alias("b"), F.col("a.source").eqNullSafe(F.col("b.source"))).select("a.source", "a.__slice", "a.__start", "b.source_size", "b.target")
    inside = Window.partitionBy("source", "__slice").orderBy("__order", F.col("doc_id").asc_nulls_last(), "__key").rowsBetween(Window.unboundedPreceding, 0)
    placed = rows.withColumn("__run", F.sum("size").over(inside))
    placed = placed.alias("a").join(starts.alias("b"), F.col("a.source").eqNullSafe(F.col("b.source")) & (F.col("a.__slice") == F.col("b.__slice")))
    placed = placed.select("a.*", "b.source_size", "b.target", (F.col("b.__start") + F.col("a.__run")).alias("__words")).drop("__slice", "__run")
    placed = settle(placed, "placed")
    copies = placed.filter("size > 0").select("size", "__order", "__key", "doc_id", F.explode(F.array(*[F.struct((((F.col("__words") + F.lit(i) * F.col("source_size")).cast("double")) / F.col("target")).alias("v"), F.lit(i).alias("i")) for i in range(most)])).alias("c")).select("size", "__order", "__key", "doc_id", "c.v", "c.i")
    cut = _cut(copies, goals.agg(F.coalesce(F.sum("source_size"), F.lit(0))).first()[0] * budget[0], budget[1])
    finish = [((F.col("__words") + F.lit(i) * F.col("source_size")).cast("double")) / F.col("target") for i in range(most)]
    taken = F.lit(0).cast("long")
    for i, v in enumerate(finish):
        taken = taken + F.when((F.col("size") > 0) & _upto(cut, v, i), F.col("size")).otherwise(0)
    done = placed.withColumn("finish", F.when(F.col("target") > 0, finish[0])).withColumn("taken", taken)
    return done.drop("__order", "__key", "__words")


#: The global order of copies.
_PLACE = ("v", "__order", "__key", "doc_id", "i")


def _cut(copies: DataFrame, budget: int, den: int) -> tuple | None:
    """The place of the first copy, in the global order, with which the words taken would exceed budget / den; None: all fit."""
    low, high, used = 0.0, None, 0
    highest = copies.agg(F.max("v"), F.sum("size")).first()
    if highest[0] is None or highest[1] * den <= budget:
        return None
    high = min(float(highest[0]), 2.0) if copies.filter("v <= 2").agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0] * den > budget else float(highest[0])
    for _ in range(2):
        width = (high - low) / RANGES
        if width <= 0 or low + width == low:
            break
        cell = F.least(F.floor((F.col("v") - F.lit(low)) / F.lit(width)), F.lit(RANGES - 1))
        sums = copies.filter((F.col("v") >= low) & (F.col("v") <= high)).groupBy(cell.alias("cell")).agg(F.sum("size").alias("words"), F.min("v").alias("v0"), F.max("v").alias("v1")).orderBy("cell").collect()  # RANGES rows at most
        for x in sums:
            if (used + x["words"]) * den > budget:
                low, high = x["v0"], x["v1"]
                break
            used += x["words"]
    last = copies.filter((F.col("v") >= low) & (F.col("v") <= high))
    running = last.withColumn("sum", F.sum("size").over(Window.orderBy(*[F.col(c).asc_nulls_last() for c in _PLACE]).rowsBetween(Window.unboundedPreceding, 0)))
    over = running.filter((F.col("sum") + F.lit(used)) * den > budget).select(F.min(F.struct(*_PLACE)).alias("x")).first()["x"]
    return tuple(over) if over is not None else None


def _upto(cut: tuple | None, v: Column, i: int) -> Column:
    """Whether a document's copy i with finish time v stands before the cut."""
    if cut is None:
        return F.lit(True)
    at = dict(zip(_PLACE, cut, strict=True))
    same = F.col("__order").eqNullSafe(at["__order"]) & F.col("__key").eqNullSafe(at["__key"]) & F.col("doc_id").eqNullSafe(at["doc_id"])
    tied = (F.col("__order") < F.lit(at["__order"])) | ((F.col("__order") == F.lit(at["__order"])) & (F.col("__key") < F.lit(at["__key"]))) | (same & F.lit(i < at["i"]))
    return (v < F.lit(at["v"])) | ((v == F.lit(at["v"])) & tied)
