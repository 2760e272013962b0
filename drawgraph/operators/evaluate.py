"""Answers against truth: matches, missing and extra candidates, accuracies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import sheet_key


def last_answers(answers: DataFrame) -> DataFrame:
    """Of several answers for a sheet's candidate the last counts."""
    return answers.groupBy(sheet_key(F.col("sheet")).alias("sheet"), "candidate_id").agg(F.max_by("status", "pos").alias("actual"))


def compared(truth: DataFrame, answers: DataFrame) -> DataFrame:
    """A full join; only statuses are compared, and no status equals no status."""
    expected = truth.select("group_id", sheet_key(F.col("sheet")).alias("sheet"), "candidate_id", F.col("status").alias("expected"), F.lit(True).alias("has_truth"))
    actual = last_answers(answers).withColumn("has_answer", F.lit(True))
    both = expected.join(actual, ["sheet", "candidate_id"], "full_outer")
    kind = F.when(F.col("has_truth").isNull(), "extra").when(F.col("expected").eqNullSafe(F.col("actual")), "match").when(F.col("has_answer").isNull(), "missing").otherwise("mismatch")
    return both.select("group_id", "sheet", "candidate_id", "expected", "actual", kind.alias("kind"), F.col("has_answer").isNull().alias("unanswered"))


def accuracy(pairs: DataFrame) -> DataFrame:
    """By group and over all, from compared()."""
    known = pairs.filter("kind <> 'extra'")
    right = F.count_if(F.col("kind") == "match")
    return known.rollup("group_id").agg(F.count(F.lit(1)).alias("total"), right.alias("correct"), F.count_if("unanswered").alias("missing"), (right * 100.0 / F.greatest(F.count(F.lit(1)), F.lit(1))).alias("accuracy"), F.grouping("group_id").cast("int").alias("all_groups"))


def _begun(names: DataFrame, name: str, starts: DataFrame, start: str) -> DataFrame:
    """Pairs of a name and a start of it, by equality with each of its starts."""
    n = F.length(name)
    every = names.withColumn(start, F.explode(F.transform(F.sequence(F.least(F.lit(1), n), n), lambda k: F.left(F.col(name), k))))
    return every.join(starts, start)


def groups_of_lines(lines: DataFrame, groups: DataFrame) -> DataFrame:
    """Groups of a line by name, or by name and underscore either way; only where there is none, by beginnings either way. Lines without any stay, not configured."""
    pairs = _begun(lines, "line_id", groups, "group_id").unionByName(_begun(groups, "group_id", lines, "line_id")).distinct()
    l, g = F.col("line_id"), F.col("group_id")
    level = F.when((l == g) | l.startswith(F.concat(g, F.lit("_"))) | g.startswith(F.concat(l, F.lit("_"))), 1).when(l.startswith(g) | g.startswith(l), 2)
    found = pairs.withColumn("level", level).filter("level is not null")
    best = found.groupBy("line_id").agg(F.min("level").alias("level"))
    return lines.join(found.join(best, ["line_id", "level"]), "line_id", "left").withColumn("status", F.when(F.col("group_id").isNull(), "not_configured").otherwise("evaluated"))


def page_results(pages: DataFrame, truth: DataFrame, answers: DataFrame, keys: list[str]) -> DataFrame:
    """E01-E03, E06 for every answered page: (keys, group_id, sheet, status, total, correct, mismatches, missing, extra).

    pages(keys, group_id, sheet), truth(group_id, sheet, candidate_id, expected), answers(keys, group_id, sheet, candidate_id, actual), one answer a candidate (see last_answers). Lists are in the order of
    ids and as long as a page has candidates. A page of a group without truth is not configured, one whose sheet has none is empty; both count nothing and list nothing."""
    at = [*keys, "group_id", "sheet"]
    expected = pages.join(truth, ["group_id", "sheet"]).withColumn("has_truth", F.lit(True))
    both = expected.join(answers.withColumn("has_answer", F.lit(True)), [*at, "candidate_id"], "full_outer")
    known, told = F.col("has_truth").isNotNull(), F.col("has_answer").isNotNull()
    right = F.col("expected").eqNullSafe(F.col("actual"))
    listed = lambda c, row: F.array_sort(F.collect_list(F.when(c, row)))
    found = both.groupBy(*at).agg(F.count_if(known).alias("total"), F.count_if(known & right).alias("correct"), listed(known & ~right, F.struct("candidate_id", "expected", "actual")).alias("mismatches"), listed(known & ~told, F.col("candidate_id")).alias("missing"), listed(~known, F.col("candidate_id")).alias("extra"))
    rows = pages.join(found, at, "left").join(truth.select("group_id").distinct().withColumn("configured", F.lit(True)), "group_id", "left")
    status = F.when(F.col("total") > 0, "evaluated").when(F.col("configured"), "empty").otherwise("not_configured")
    counted = F.coalesce(F.col("total") > 0, F.lit(False))
    return rows.select(*at, status.alias("status"), *[F.when(counted, F.col(c)).otherwise(F.lit(0)).alias(c) for c in ("total", "correct")], *[F.when(counted, F.col(c)).otherwise(F.array()).alias(c) for c in ("mismatches", "missing", "extra")])


def _percent(correct: str, total: str) -> Column:
    return F.round(F.col(correct) / F.greatest(F.col(total), F.lit(1)) * 100.0, 2)


def group_results(results: DataFrame, keys: list[str]) -> DataFrame:
    """page_results by group: sums, mismatches page by page, distinct missing and extra candidates as <sheet>:<id> in order, the best status (evaluated, then empty, then not configured).

    A group is one line, so its lists are as long as its drawing."""
    keyed = lambda c: F.transform(c, lambda x: F.concat_ws(":", F.col("sheet"), x.cast("string")))
    whole = lambda c: F.array_sort(F.array_distinct(F.flatten(F.collect_list(keyed(c)))))
    pages = F.array_sort(F.collect_list(F.struct("sheet", "mismatches")))
    has = lambda s: F.bool_or(F.col("status") == s)
    out = results.groupBy(*keys, "group_id").agg(F.sum("total").alias("total"), F.sum("correct").alias("correct"), F.flatten(F.transform(pages, lambda p: F.transform(p["mismatches"], lambda m: F.struct(p["sheet"].alias("sheet"), *[m[f].alias(f) for f in ("candidate_id", "expected", "actual")])))).alias("mismatches"), whole("missing").alias("missing"), whole("extra").alias("extra"), F.when(has("evaluated"), "evaluated").when(has("empty"), "empty").otherwise("not_configured").alias("status"))
    return out.withColumns({"incorrect": F.col("total") - F.col("correct"), "accuracy": _percent("correct", "total")})


def version_results(groups: DataFrame, keys: list[str]) -> DataFrame:
    """group_results over all groups of a prompt's version; versions that nothing was expected of are left out. The groups' own rows stay in group_results, as there are as many as lines."""
    of = lambda s: F.count_if(F.col("status") == s).alias(s)
    out = groups.groupBy(*keys).agg(F.sum("total").alias("total"), F.sum("correct").alias("correct"), F.sum("incorrect").alias("incorrect"), F.count(F.lit(1)).alias("groups"), of("evaluated"), of("empty"), of("not_configured"))
    return out.filter("total > 0").withColumns({"accuracy": _percent("correct", "total"), "status": F.when(F.col("evaluated") > 0, "evaluated").otherwise("not_configured")})
