"""Documents into shards of nearly equal bytes by Karmarkar-Karp differencing; equal texts stay together.

Every group of equal texts starts as a partial partition: its bytes in one part, none in the others. The two
partial partitions with the largest spread (largest less smallest part) are combined again and again, the largest
part of one with the smallest of the other, until one is left.

At scale: a group is a row of 16 bytes of digest, its bytes and its rows; texts are never shuffled.
1. A group of more bytes than a fair share of what is left gets a shard of its own; there are fewer of them than shards.
2. Groups over 1/HEAVY of a fair share, or over 1/MANY of all rows, are differenced together: at most
   shards * HEAVY + MANY groups, whatever the input. They meet their rows by broadcast, so no large group is shuffled by key.
3. All other groups are dealt by digest into buckets of about BUCKET groups. Each bucket is one differencing which starts with
   the loads so far as one more partial partition, in proportion to the bucket's bytes, so that light groups fill what
   heavier ones left uneven. Buckets go in few waves, each WAVE times smaller than the one before; the last is a single
   bucket, and evens out what rounding and spreads of all others have added up to.
4. Slots number the rows of each shard by slices of the input, with the sums of the slices before added: a shard
   with a third of all rows is never in one task.

Defined results: a null text counts as the empty text; rows without an id and rows that repeat an id are put like any other,
each with a slot of its own; ties of bytes go by digest; very long texts are one row as others; an empty table gives an empty
result; with fewer groups than shards some shards stay empty; further columns pass through, those named like the operator's
own are replaced.
"""

from __future__ import annotations

from heapq import heapify, heappop, heapreplace

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import forget, settle

#: A group is differenced with the other heavy ones if it has over 1 / HEAVY of a fair share, or over 1 / MANY of all rows.
HEAVY, MANY = 512, 10_000
#: Groups that one task differences at a time, about.
BUCKET = 4096
#: Each wave of buckets but the last leaves one bucket in WAVE to the next.
WAVE = 256
#: Rows of a shard in one file, about.
FILE_ROWS = 100_000

_OWN = ("size", "text_crc32", "law", "shard", "slot", "grown_shard")


def difference(sizes: list[int], loads: list[int]) -> list[int]:
    """The part of each size. Parts are numbered as loads, what they hold already."""
    k, n = len(loads), len(sizes)
    first = sorted(range(k), key=lambda j: -loads[j])
    heap = [(loads[first[-1]] - loads[first[0]], 0, [loads[j] for j in first])]
    heap += [(-s, i + 1, [s] + [0] * (k - 1)) for i, s in enumerate(sizes)] if k > 1 else [(0, i + 1, [s]) for i, s in enumerate(sizes)]
    heapify(heap)
    made: list[tuple[int, int, list[int]]] = []  # of each combination: both that it is made of, and the place of each part before sorting
    while len(heap) > 1:
        _, a, one = heappop(heap)
        _, b, other = heap[0]
        sums = [x + y for x, y in zip(one, reversed(other), strict=True)]
        order = sorted(range(k), key=sums.__getitem__, reverse=True)
        made.append((a, b, order))
        heapreplace(heap, (sums[order[-1]] - sums[order[0]], n + len(made), [sums[i] for i in order]))
    parts: dict[int, list[int]] = {heap[0][1]: list(range(k))}
    for at in range(len(made) - 1, -1, -1):
        a, b, order = made[at]
        mine, left, right = parts.pop(n + 1 + at), [0] * k, [0] * k
        for i, place in enumerate(order):
            left[place] = right[k - 1 - place] = mine[i]
        parts[a], parts[b] = left, right
    names = [0] * k
    for place, j in enumerate(first):
        names[parts[0][place]] = j
    return [names[parts[i + 1][0]] for i in range(n)]


def _differenced(table: pa.Table, loads: list[int], total: int) -> pa.Table:
    """A bucket's groups with their part. It starts from its share of the loads."""
    table = table.sort_by([("bytes", "descending"), ("key", "ascending")])
    sizes = table.column("bytes").to_pylist()
    mine, low = sum(sizes), min(loads)
    parts = difference(sizes, [(x - low) * mine // total for x in loads])
    return pa.table({"key": table.column("key"), "part": pa.array(parts, pa.int32()), "bytes": table.column("bytes")})


def _wave(groups: DataFrame, loads: list[int], total: int) -> tuple[DataFrame, list[int]]:
    """(key, part, bytes) of groups(key, bytes, bucket), which have total bytes, and the loads with them."""

    def run(bucket: pa.Table) -> pa.Table:
        return _differenced(bucket, loads, total)

    done = settle(groups.groupBy("bucket").applyInArrow(run, "key binary, part int, bytes long"), "wave")
    more = {r["part"]: r["bytes"] for r in done.groupBy("part").agg(F.sum("bytes").alias("bytes")).collect()}  # a row for each shard
    return done, [x + more.get(j, 0) for j, x in enumerate(loads)]


def place_groups(groups: DataFrame, shards: int = 24, bucket: int = BUCKET) -> tuple[DataFrame, DataFrame]:
    """(key, shard) of the heavy ones of groups(key, bytes, rows), bounded in number, and of all others."""
    spark = groups.sparkSession
    empty = spark.createDataFrame([], "key binary, part int, bytes long")
    total, n_rows = groups.agg(F.coalesce(F.sum("bytes"), F.lit(0)), F.coalesce(F.sum("rows"), F.lit(0))).first()
    alone: list[bytearray] = []
    for g in groups.orderBy(F.desc("bytes"), "key").limit(shards - 1).collect():
        if g["bytes"] * (shards - len(alone)) <= total:
            break
        alone.append(g["key"])
        total -= g["bytes"]
    k = shards - len(alone)
    singles = spark.createDataFrame([(key, i - k) for i, key in enumerate(alone)], "key binary, part int")  # numbered from -k on, so that shard = part + k
    rest = groups.filter(~F.col("key").isin(alone)) if alone else groups
    is_heavy = (F.col("bytes") * (k * HEAVY) > F.lit(total)) | (F.col("rows") * MANY > F.lit(n_rows))
    loads, heavy = [0] * k, empty
    heavy_bytes = rest.filter(is_heavy).agg(F.sum("bytes")).first()[0]
    if heavy_bytes:
        heavy, loads = _wave(rest.filter(is_heavy).select("key", "bytes", F.lit(0).alias("bucket")), loads, heavy_bytes)
    light = rest.filter(~is_heavy)
    n_light, light_bytes = light.agg(F.count(F.lit(1)), F.coalesce(F.sum("bytes"), F.lit(0))).first()
    buckets = -(-n_light // bucket)
    light = settle(light.select("key", "bytes", F.pmod(F.xxhash64("key"), F.lit(max(buckets, 1))).alias("bucket")), "light")
    done = empty
    while buckets:
        later = -(-buckets // WAVE) if buckets > 1 else 0
        now = light.filter((F.col("bucket") >= later) & (F.col("bucket") < buckets))
        now_bytes = now.agg(F.sum("bytes")).first()[0]
        if now_bytes:
            part, loads = _wave(now, loads, now_bytes)
            done = done.unionByName(part)
        buckets = later
    shard = (F.col("part") + F.lit(len(alone))).alias("shard")
    return singles.select("key", (F.col("part") + k).alias("shard")).unionByName(heavy.select("key", shard)), done.select("key", shard)


def assign_shards(docs: DataFrame, shards: int = 24, bucket: int = BUCKET) -> DataFrame:
    """docs(text, ...) without text, with size (bytes of the text and 8), text_crc32, law ("bytes"), shard, slot and grown_shard (null)."""
    text = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    kept = [c for c in docs.columns if c not in (*_OWN, "text", "__key", "__row")]
    made = ((F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), F.unhex(F.md5(text)).alias("__key"))
    rows = settle(docs.select(*kept, *made, F.monotonically_increasing_id().alias("__row")), "sized")
    groups = settle(rows.groupBy(F.col("__key").alias("key")).agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("rows")), "groups")
    heavy, light = place_groups(groups, shards, bucket)
    heavy = F.broadcast(heavy.withColumnRenamed("key", "__key"))  # shards * (HEAVY + 1) + MANY rows at most
    placed = rows.join(heavy, "__key").unionByName(rows.join(heavy, "__key", "left_anti").join(light.withColumnRenamed("key", "__key"), "__key"))
    placed = settle(placed.drop("__key"), "placed")
    forget(rows)
    forget(groups)
    slices = F.shiftright("__row", 33)  # the task that read the row
    counts = placed.groupBy("shard", slices.alias("__slice")).agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("shard").orderBy("__slice").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("shard", "__slice", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("__start"))
    inside = Window.partitionBy("shard", "__slice").orderBy("__row")
    out = placed.withColumn("__slice", slices).withColumn("__at", F.row_number().over(inside) - 1).join(starts, ["shard", "__slice"])
    return out.select(*kept, "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("__start") + F.col("__at")).alias("slot"), F.lit(None).cast("int").alias("grown_shard"))


def write_shards(docs: DataFrame, path: str, shards: int = 24) -> DataFrame:
    """Writes docs, texts included, as Parquet under path, a folder for each shard, rows in slot order within a file; returns what was written.

    A shard is as many files as it has multiples of FILE_ROWS rows; texts are shuffled once, to where their file is written."""
    own = [c for c in docs.columns if c not in (*_OWN, "__row")]
    whole = settle(docs.select(*own, F.monotonically_increasing_id().alias("__row")), "whole")
    placed = assign_shards(whole.select("text", F.col("__row").alias("__number")), shards)
    rows = whole.join(placed.withColumnRenamed("__number", "__row"), "__row").drop("__row").withColumn("__file", F.floor(F.col("slot") / FILE_ROWS))
    rows.repartition("shard", "__file").sortWithinPartitions("shard", "slot").drop("__file").write.partitionBy("shard").parquet(path)
    forget(whole)
    return docs.sparkSession.read.parquet(path)
