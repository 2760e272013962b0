"""op13: groups stay whole, bytes are nearly equal, slots have no gaps; differencing against a plain version of it."""

import random
import zlib

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from drawgraph.llm import sharding

DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("size", T.StringType()), T.StructField("slot", T.LongType()), T.StructField("lang", T.StringType())])


def plain(sizes, k):
    """Spread of the sums that differencing ends with, by sets of sizes."""
    parts = [[[s], *[[] for _ in range(k - 1)]] for s in sizes]
    spread = lambda p: sum(p[0]) - sum(p[-1])
    while len(parts) > 1:
        parts.sort(key=spread)
        a, b = parts.pop(), parts.pop()
        parts.append(sorted((x + y for x, y in zip(a, reversed(b), strict=True)), key=sum, reverse=True))
    return sorted(map(sum, parts[0]))


@pytest.mark.parametrize("k", [1, 2, 3, 24])
def test_difference(k):
    rnd = random.Random(k)
    for n in (1, 2, 5, 40, 300):
        sizes = [rnd.randint(1, 10**6) for _ in range(n)]
        got = sharding.difference(sizes, [0] * k)
        sums = [0] * k
        for s, j in zip(sizes, got, strict=True):
            sums[j] += s
        assert sorted(sums) == plain(sizes, k)


def test_difference_fills_what_loads_leave():
    rnd = random.Random(2)
    loads = [900_000, 0, 350_000, 10]
    sizes = [rnd.randint(1, 9_000) for _ in range(600)]
    sums = list(loads)
    for s, j in zip(sizes, sharding.difference(sizes, loads), strict=True):
        sums[j] += s
    assert max(sums) - min(sums) < 100


def make(spark, texts):
    return spark.createDataFrame([(i if i % 9 else None, t, "own", 5, "en") for i, t in enumerate(texts)], DOCS)


def check(docs, got, shards):
    assert got.columns == ["doc_id", "lang", "size", "text_crc32", "law", "shard", "slot", "grown_shard"]
    rows = got.collect()
    data = [(t or "").encode() for _, t in docs.select("doc_id", "text").collect()]
    assert sorted((len(b) + 8, zlib.crc32(b)) for b in data) == sorted((r.size, r.text_crc32) for r in rows)
    where, sums, slots = {}, [0] * shards, [[] for _ in range(shards)]
    for r in rows:
        assert where.setdefault((r.size, r.text_crc32), r.shard) == r.shard and r.law == "bytes" and r.grown_shard is None
        sums[r.shard] += r.size
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots)
    return sums


def test_shards(spark):
    rnd = random.Random(9)
    texts = ["".join(rnd.choice("abé ") for _ in range(int(rnd.paretovariate(1.1) * 20) % 3000)) for _ in range(3000)]
    texts += [texts[i] for i in range(0, 300, 3)] + [None, "", None, "x" * 20_000, "y" * 9_000] + [texts[7]] * 900
    docs = make(spark, texts)
    sums = check(docs, sharding.assign_shards(docs, shards=8, bucket=100), 8)
    assert max(sums) - min(sums) < 60
    again = {tuple(r) for r in sharding.assign_shards(docs, shards=8, bucket=100).select("size", "text_crc32", "shard").collect()}
    assert again == {tuple(r) for r in sharding.assign_shards(docs, shards=8, bucket=100).select("size", "text_crc32", "shard").collect()}


def test_large_groups_have_shards_of_their_own(spark):
    texts = ["the same long text again " * 20] * 2000 + ["another " * 50] * 900 + [f"text {i} " * (i % 40) for i in range(2000)]
    docs = make(spark, texts)
    sums = check(docs, sharding.assign_shards(docs, shards=6), 6)
    assert sums[0] == 2000 * 508 and max(sums[2:]) - min(sums[2:]) < 60  # shards 0 and 1 hold one group each


def test_few_rows_and_none(spark):
    docs = make(spark, [None, None, "a"])
    assert sorted(check(docs, sharding.assign_shards(docs, shards=4), 4)) == [0, 0, 9, 16]
    check(docs, sharding.assign_shards(docs, shards=1), 1)
    assert sharding.assign_shards(spark.createDataFrame([], DOCS)).collect() == []


def test_written_shards(spark, tmp_path):
    docs = make(spark, [f"text {i % 700} " * (i % 50) for i in range(1500)])
    back = sharding.write_shards(docs, f"file://{tmp_path}/shards", shards=5)
    assert sorted(map(str, back.select("doc_id", F.col("text"), "lang").collect())) == sorted(map(str, docs.select("doc_id", F.col("text"), "lang").collect()))
    assert back.groupBy("shard", "slot").count().filter("count > 1").isEmpty()
    assert back.groupBy("text").agg(F.countDistinct("shard").alias("n")).filter("n > 1").isEmpty()
