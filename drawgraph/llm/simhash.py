"""Near-duplicates by SimHash fingerprints, found through covering locality-sensitive hashing.

A fingerprint is cut into segments. Each bit of a segment has a code of radius + 1 bits, and each of the
2^(radius+1) - 1 non-zero vectors gives a mask: the bits whose code has odd overlap with it. Whatever
radius bits of a segment differ, some vector is orthogonal to all their codes, so its mask covers none of
them: two fingerprints within the radius collide in that table for certain. With k segments, any pair
within k * (radius + 1) - 1 bits is within the radius in one of them.

At scale: equal fingerprints are one node, so thousands of copies are one row. Tables are grouped by
masked value; a bucket of more than BUCKET fingerprints is not compared as a whole, but dealt out again
by the value of one of several blocks of the bits its mask leaves open: a pair within the distance
agrees on one of them. That goes on, as often as needed, until buckets are small (the open bits run out
at single fingerprints), so no pair is lost and no bucket grows with the data. Buckets give a spanning
forest of their links, not all pairs. Components come from alternating star steps, each written to the
shared folder.

drop_near_duplicates() asks for an exact Jaccard similarity of shingle sets. Its candidates come from the same
method: wide fingerprints of the sets, covering masks, and buckets whose members meet where they are near in
further bits of their fingerprints. What they join, over all tables, is compared once, by the exact check: a set is
sent to one group however many tables it meets others in.

Defined results: null and empty texts have the zero fingerprint and are linked to each other like any
others; rows without an id share in links, but the smallest id of a component leaves them out (null if
none has one); rows that repeat an id stay as they are; an empty table gives an empty result; further
columns pass through, those named like the operator's own are replaced.
"""

from __future__ import annotations

import string
from collections.abc import Iterator
from functools import partial, reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from .common import forget, key_of, settle, short_batches

#: Fingerprints that one task compares with each other.
BUCKET = 4096
#: Fingerprints of sets: words, segments and their bits, bits that differ in a segment and are found for certain. At a Jaccard similarity of 0.8 a bit differs with a chance of 0.152
#: (acos(8 / 9) / pi): no table of a segment finds such a pair with a chance of 0.534, none of all segments with 0.534^21 = 2e-6; pairs that differ in up to 83 of 630 bits are found for certain.
WORDS, SEGMENTS, WIDTH, RADIUS = 10, 21, 30, 3
#: Words of a fingerprint that stand in the tables, and bits of them in which candidates may differ: 29 +- 5 at a similarity of 0.8, 96 +- 7 for sets that share nothing.
SKETCH, APART = 3, 64
#: Sets of so few shingles, whose bits are coarse, meet at every shingle too.
FEW = 10
#: Tables that are dealt at a time, so that their rows are not on disk all at once.
PASSES = (2, 15, 75, 135, 195, 255, 315)
#: Rows of tables that a task sorts, about.
TASK_ROWS = 500_000
#: Hashes that one task compares at a time, in all sets of a bucket.
SET_HASHES = 500_000
#: Bytes that part words, made spaces; A-Z lower-cased.
_TEXT_BYTES = bytes(0x20 if b == 0x20 or 0x09 <= b <= 0x0D else b + 32 if chr(b) in string.ascii_uppercase else b for b in range(256))


def shingle_hashes(text: bytes | None, size: int, seed: int) -> np.ndarray:
    """XXH64 of every run of size words, joined by spaces; of all words where there are fewer."""
    words = (text or b"").translate(_TEXT_BYTES).split(b" ")
    words = [w for w in words if w]
    if not words:
        return np.empty(0, np.uint64)
    flat = b" ".join(words)
    if len(words) <= size:
        return np.array([xxhash.xxh64_intdigest(flat, seed)], np.uint64)
    ends = np.cumsum([len(w) + 1 for w in words])
    starts = [0, *ends[: -size].tolist()]
    digest = xxhash.xxh64_intdigest
    return np.array([digest(flat[a:b], seed) for a, b in zip(starts, (ends[size - 1 :] - 1).tolist(), strict=True)], np.uint64)


def _majority(hashes: np.ndarray) -> int:
    """The bits that are set in over half of the hashes."""
    if not len(hashes):
        return 0
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 65536):
        ones += np.unpackbits(hashes[at : at + 65536].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > len(hashes)).tobytes(), "big")


_SPREAD = np.uint64(0x9E3779B97F4A7C15)


def _mixed(h: np.ndarray, word: int) -> np.ndarray:
    """Further hash words from the first, by one round of a 64-bit finaliser."""
    if not word:
        return h
    h = h + np.uint64(word * int(_SPREAD) % 2**64)
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _prints(batches: Iterator[pa.RecordBatch], shingle: int, words: int, seed: int, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = []
        for text in batch.column("text").cast(pa.binary()):
            h = shingle_hashes(text.as_py(), shingle, seed)
            found.append(b"".join(_majority(_mixed(h, k)).to_bytes(8, "big") for k in range(words)))
        yield pa.RecordBatch.from_arrays([pa.array(found, pa.binary()) if f.name == "fp" else batch.column(f.name) for f in schema], schema=schema)


def fingerprints(docs: DataFrame, shingle: int = 3, words: int = 1, seed: int = 42) -> DataFrame:
    """docs(text, ...) without text, with fp: a fingerprint of words * 64 bits, big-endian bytes."""
    fields = [f for f in docs.schema.fields if f.name not in ("text", "fp")]
    schema = T.StructType([*fields, T.StructField("fp", T.BinaryType())])
    return short_batches(docs).mapInArrow(partial(_prints, shingle=shingle, words=words, seed=seed, schema=to_arrow_schema(schema)), schema)


def covering_masks(bits: int, segments: int, radius: int, width: int | None = None) -> list[np.ndarray]:
    """For every table the bits (places in the fingerprint) that it compares. Segments have width bits, or all that there are."""
    width, codes = width or bits // segments, 2 ** (radius + 1)
    out = []
    for s in range(segments):
        code = np.arange(width) % (codes - 1) + 1  # every non-zero code in turn
        for v in range(1, codes):
            out.append(s * width + np.flatnonzero([bin(int(c) & v).count("1") & 1 for c in code]))
    return out


def _rows(fps: pa.Array, words: int) -> np.ndarray:
    return np.frombuffer(b"".join(fps.to_pylist()), ">u8").astype(np.uint64).reshape(-1, words)


def _word_masks(places: list[np.ndarray], words: int) -> np.ndarray:
    out = np.zeros((len(places), words), np.uint64)
    for t, bits in enumerate(places):
        for b in bits:
            out[t, b // 64] |= np.uint64(1) << np.uint64(63 - b % 64)
    return out


def _keys(rows: np.ndarray, mask: np.ndarray, tag: int) -> np.ndarray:
    """A 64-bit key of the masked words and the table."""
    key = np.full(len(rows), tag * int(_SPREAD) % 2**64, np.uint64)
    for w in np.flatnonzero(mask):
        key = _mixed(key ^ (rows[:, w] & mask[w]), int(w) + 1)
    return key.view(np.int64)


_DEALT = "key long, t int, path long, id long"


def _deal(batches: Iterator[pa.RecordBatch], masks: np.ndarray, words: int) -> Iterator[pa.RecordBatch]:
    """Every fingerprint's number under its key in every table."""
    for batch in batches:
        rows = _rows(batch.column("fp"), words)
        for t, mask in enumerate(masks):
            yield pa.RecordBatch.from_arrays([pa.array(_keys(rows, mask, t)), pa.array(np.full(len(rows), t, np.int32)), pa.array(np.ones(len(rows), np.int64)), batch.column("id")], ["key", "t", "path", "id"])


def open_after(bits: int, mask: np.ndarray, path: int, distance: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """Bits that a table leaves open once the blocks on the path are fixed too, and their parting into distance + 1 blocks.

    path is 1 at first, and path * (distance + 1) + b once block b is fixed."""
    steps = []
    while path > 1:
        path, b = divmod(path, distance + 1)
        steps.append(b)
    left = np.setdiff1d(np.arange(bits), mask)
    for b in reversed(steps):
        left = np.setdiff1d(left, np.array_split(left, distance + 1)[b])
    return left, np.array_split(left, distance + 1)


def _deal_again(batches: Iterator[pa.RecordBatch], bits: int, masks: list[np.ndarray], distance: int) -> Iterator[pa.RecordBatch]:
    """Members of large buckets under the key of each block of the bits still open."""
    words = bits // 64
    for batch in batches:
        rows, key = _rows(batch.column("fp"), words), batch.column("key").to_numpy().view(np.uint64)
        t, path = batch.column("t").to_numpy(), batch.column("path").to_numpy()
        for table, way in {*zip(t.tolist(), path.tolist(), strict=True)}:
            mine = np.flatnonzero((t == table) & (path == way))
            _, blocks = open_after(bits, masks[table], way, distance)
            for b, mask in enumerate(_word_masks(blocks, words)):
                fresh = _mixed(key[mine] ^ _keys(rows[mine], mask, b + 1).view(np.uint64), 3)
                yield pa.RecordBatch.from_arrays([pa.array(fresh.view(np.int64)), pa.array(t[mine]), pa.array(np.full(len(mine), way * (distance + 1) + b)), batch.column("id").take(pa.array(mine))], ["key", "t", "path", "id"])


def spanning(members: list[bytes], words: int, distance: int) -> list[tuple[int, int]]:
    """Places of links that join what links within the distance join. A member that is reached is never looked at again, so a dense bucket takes few steps."""
    out: list[tuple[int, int]] = []
    if len(members) <= 12:
        rows = [int.from_bytes(m, "big") for m in members]
        free = list(range(len(rows)))
        while free:
            wave = [free.pop()]
            while wave and free:
                at = wave.pop()
                near = [x for x in free if (rows[at] ^ rows[x]).bit_count() <= distance]
                if near:
                    out += [(at, x) for x in near]
                    wave += near
                    free = [x for x in free if x not in near]
        return out
    table = np.frombuffer(b"".join(members), ">u8").astype(np.uint64).reshape(-1, words)
    rest = np.arange(len(members))
    while len(rest):
        wave, rest = [rest[0]], rest[1:]
        while wave and len(rest):
            at = wave.pop()
            near = np.bitwise_count(table[rest] ^ table[at]).sum(axis=1, dtype=np.int32) <= distance
            if near.any():
                out += [(int(at), int(x)) for x in rest[near]]
                wave += rest[near].tolist()
                rest = rest[~near]
    return out


def _forest(batches: Iterator[pa.RecordBatch], words: int, distance: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        left, right = [], []
        for members in batch.column("fps").to_pylist():
            for x, y in spanning(members, words, distance):
                left.append(max(members[x], members[y]))
                right.append(min(members[x], members[y]))
        yield pa.RecordBatch.from_arrays([pa.array(left, pa.binary()), pa.array(right, pa.binary())], ["a", "b"])


def links(prints: DataFrame, bits: int, segments: int, radius: int, distance: int, width: int | None = None) -> DataFrame:
    """Links (a, b), a > b, between the distinct fingerprints fp: each within distance bits, and enough of them to join whatever such links join.

    Tables hold an 8-byte number for each fingerprint; fingerprints themselves meet only buckets of two and more. Should two of them
    share a number, both are looked at wherever it stands."""
    words = bits // 64
    masks = covering_masks(bits, segments, radius, width)
    nodes = settle(prints.select(F.xxhash64("fp").alias("id"), "fp"), "nodes")
    dealt = nodes.mapInArrow(partial(_deal, masks=_word_masks(masks, words), words=words), _DEALT)
    parts = []
    while True:
        dealt = settle(dealt, "dealt")
        buckets = settle(dealt.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("low"), F.max("id").alias("high")).filter("n > 1"), "buckets")
        twos = buckets.filter("n = 2").select("key", F.explode(F.array("low", "high")).alias("id"))
        more = dealt.select("key", "id").join(buckets.filter((F.col("n") > 2) & (F.col("n") <= BUCKET)).select("key"), "key", "left_semi")
        rows = settle(twos.unionByName(more), "members")
        small = rows.join(nodes, "id").groupBy("key").agg(F.collect_list("fp").alias("fps")).select("fps")
        parts.append(settle(small.mapInArrow(partial(_forest, words=words, distance=distance), "a binary, b binary").distinct(), "links"))
        if buckets.filter(F.col("n") > BUCKET).isEmpty():
            break
        large = settle(dealt.join(buckets.filter(F.col("n") > BUCKET).select("key"), "key", "left_semi").join(nodes, "id"), "large")
        kinds = [tuple(r) for r in large.select("t", "path").distinct().toLocalIterator()]  # as many as tables and ways, not as buckets
        ended = [k for k in kinds if len(open_after(bits, masks[k[0]], k[1], distance)[0]) <= distance]
        if ended:  # what is left open is within the distance for all: each is linked to the least
            is_ended = F.struct("t", "path").isin([F.struct(F.lit(t).cast("int"), F.lit(p).cast("long")) for t, p in ended])
            every = large.filter(is_ended)
            least = settle(every.groupBy("key").agg(F.min("fp").alias("b")), "least")
            parts.append(settle(every.join(least, "key").filter(F.col("fp") != F.col("b")).select(F.col("fp").alias("a"), "b").distinct(), "links"))
            large = large.filter(~is_ended)
        dealt = large.mapInArrow(partial(_deal_again, bits=bits, masks=masks, distance=distance), _DEALT)
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.distinct()


def components(pairs: DataFrame) -> DataFrame:
    """(node, root): the least node of each component, for all nodes of links (a, b), roots included. Large and small stars in turn, until every node has one link only, to a root."""
    edges = settle(pairs.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        below = F.col("b") < F.col("a")
        least = settle(both.groupBy("a").agg(F.min("b").alias("m"), F.count_if(below).alias("below"), F.bool_or(~below).alias("above")).select("a", F.least("a", "m").alias("m"), "below", "above"), "least")
        if least.agg(F.count_if(F.expr("below > 1 or (below = 1 and above)"))).first()[0] == 0:
            break
        large = settle(both.join(least.select("a", "m"), "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct(), "large")
        least_below = settle(large.groupBy("a").agg(F.min("b").alias("m")), "least")
        joined = large.join(least_below, "a")
        small = settle(joined.select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("x")).select("x.*").filter("a <> b").distinct(), "small")
        for old in (edges, least, large, least_below):
            forget(old)
        edges = small
    return least.select(F.col("a").alias("node"), F.col("m").alias("root"))


def near_duplicates(docs: DataFrame, shingle: int = 3, bits: int = 64, segments: int = 1, radius: int = 3, distance: int = 3, seed: int = 42, width: int | None = None) -> DataFrame:
    """docs(doc_id, text, ...) without text, with fp and component_id: the least doc_id that links of at most distance bits reach, its own included."""
    prints = settle(fingerprints(docs.drop("component_id"), shingle, bits // 64, seed), "prints")
    nodes = settle(prints.groupBy("fp").agg(F.min("doc_id").alias("least")), "nodes")
    joined = settle(components(links(nodes, bits, segments, radius, distance, width)), "components")
    ids = settle(nodes.join(joined, nodes["fp"] == joined["node"]).groupBy("root").agg(F.min("least").alias("id")), "ids")
    linked = settle(joined.join(ids, "root").select(F.col("node").alias("fp"), "id"), "linked")
    known = settle(nodes.join(linked, "fp", "left").select("fp", F.coalesce("id", "least").alias("component_id")), "known")
    return prints.join(known, "fp")


def majorities(hashes: np.ndarray, words: int) -> bytes:
    """The fingerprint of words * 64 bits: the bits that are set in over half of the hashes and of their further words."""
    ones = np.zeros(64 * words, np.int64)
    step = np.arange(words, dtype=np.uint64) * _SPREAD
    for at in range(0, len(hashes), 4080):
        h = hashes[at : at + 4080, None]
        wide = h + step
        wide = (wide ^ (wide >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        wide = (wide ^ (wide >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        wide ^= wide >> np.uint64(31)
        wide[:, 0] = h[:, 0]
        bits = np.unpackbits(wide.astype(">u8").view(np.uint8), axis=1)
        for k in range(0, len(bits), 255):  # sums of a byte
            ones += bits[k : k + 255].sum(axis=0, dtype=np.uint8)
    return np.packbits(ones * 2 > len(hashes)).tobytes()


def _shingle_sets(batches: Iterator[pa.RecordBatch], shingle: int, seed: int, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """What the schema asks for of each text's set of shingles: its digest fp, its fingerprint, its hashes, those of a small set."""
    make = {"size": len, "fp": lambda h: xxhash.xxh3_128_digest(h.tobytes(), seed), "hashes": lambda h: h.tobytes(), "print": lambda h: majorities(h, WORDS), "few": lambda h: h.view(np.int64)[: len(h) if len(h) <= FEW else 0]}
    for batch in batches:
        sets = [np.unique(shingle_hashes(text.as_py(), shingle, seed)) for text in batch.column("text").cast(pa.binary())]
        yield pa.RecordBatch.from_arrays([pa.array([make[f.name](h) for h in sets], f.type) if f.name in make else batch.column(f.name) for f in schema], schema=schema)


def _with_sets(docs: DataFrame, kept: list[str], made: str, shingle: int, seed: int) -> DataFrame:
    """docs(text, ...) as the columns kept and what is made of the set of shingles."""
    schema = T.StructType([*[docs.schema[c] for c in kept], *T.StructType.fromDDL(made).fields])
    return short_batches(docs).mapInArrow(partial(_shingle_sets, shingle=shingle, seed=seed, schema=to_arrow_schema(schema)), schema)


def _deal_prints(batches: Iterator[pa.RecordBatch], masks: np.ndarray, first: int) -> Iterator[pa.RecordBatch]:
    """Every fingerprint's number and first words under its key in every table; tables are numbered from first."""
    for batch in batches:
        rows = _rows(batch.column("print"), WORDS)
        fixed = [batch.column("id").to_numpy(), *rows[:, :SKETCH].view(np.int64).T]
        for at in range(0, len(masks), 8):
            keys = [_keys(rows, mask, first + t) for t, mask in enumerate(masks[at : at + 8], at)]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys)), *[pa.array(np.tile(x, len(keys))) for x in fixed]], ["key", "id", *[f"s{k}" for k in range(SKETCH)]])


def near_in_buckets(key: np.ndarray, sketch: np.ndarray, apart: int) -> np.ndarray:
    """For rows sorted by key, the place of one row of each: equal for rows of a key that steps of at most apart differing bits of sketch(row, word) join."""
    n, at = len(key), np.arange(len(key))
    root, free = at.copy(), at
    for _ in range(4):  # most near rows, of which there may be many, are near one of the first
        if not len(free):
            break
        pivot = free[np.searchsorted(key[free], key[free])]
        near = np.bitwise_count(sketch[free] ^ sketch[pivot]).sum(axis=1, dtype=np.int32) <= apart
        root[free[near]] = pivot[near]
        free = free[~near]

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = x = root[root[x]]
        return x

    starts = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1]))[:n])
    joined = np.minimum.reduceat(root, starts) == np.maximum.reduceat(root, starts) if n else np.empty(0, bool)
    left, step = at[~np.repeat(joined, np.diff(np.append(starts, n)))], 1
    while True:
        left = left[left + step < n]
        left = left[key[left] == key[left + step]]
        if not len(left):
            break
        ask = left[root[left] != root[left + step]]
        ask = ask[np.bitwise_count(sketch[ask] ^ sketch[ask + step]).sum(axis=1, dtype=np.int32) <= apart]
        for x, y in {*zip(root[ask].tolist(), root[ask + step].tolist(), strict=True)}:
            x, y = find(x), find(y)
            root[max(x, y)] = min(x, y)
        step += 1
    while (root[root] != root).any():
        root = root[root]
    return root


def _near_cells(batches: Iterator[pa.RecordBatch], apart: int) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by key, those of a bucket that are near each other: (key of their group, id, low: the id of one member, the same for all). A bucket of over BUCKET rows is one group; its rows are not held."""

    def groups(rows: np.ndarray) -> Iterator[pa.RecordBatch]:
        if not rows.shape[1]:
            return
        new = np.concatenate(([True], rows[0, 1:] != rows[0, :-1]))
        times = np.diff(np.append(np.flatnonzero(new), len(new)))[np.cumsum(new) - 1]
        large = (times > BUCKET) | (rows[0] == over)
        one = np.where(rows[0] == over, low, rows[1, np.searchsorted(rows[0], rows[0])])
        yield pa.RecordBatch.from_arrays([pa.array(rows[0, large]), pa.array(rows[1, large]), pa.array(one[large])], ["key", "id", "low"])
        rows = rows[:, (times > 1) & ~large]
        root = near_in_buckets(rows[0], rows[2:].T.view(np.uint64), apart)
        several = np.bincount(root, minlength=len(root))[root] > 1
        cell = _mixed((rows[0] ^ rows[1, root]).view(np.uint64), 1).view(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(cell[several]), pa.array(rows[1, several]), pa.array(rows[1, root[several]])], ["key", "id", "low"])

    parts: list[np.ndarray] = []
    over, low = None, 0  # the key of a large bucket that goes on, and its first id
    for batch in batches:
        parts.append(np.stack([c.to_numpy() for c in batch.columns]))
        if sum(x.shape[1] for x in parts) < 4 * BUCKET:
            continue
        rows = np.concatenate(parts, axis=1)
        last = rows[0, -1]
        cut = np.searchsorted(rows[0], last)  # the last bucket may go on
        if rows.shape[1] - cut > BUCKET or last == over:
            yield from groups(rows)
            low = low if last == over else rows[1, cut]
            over, parts = last, []
        else:
            yield from groups(rows[:, :cut])
            parts = [rows[:, cut:]]
    if parts:
        yield from groups(np.concatenate(parts, axis=1))


def near_cells(nodes: DataFrame) -> list[DataFrame]:
    """Groups (key, id, low: one member's id) of nodes(id, print, few, size) that share a table's key and are near in further bits, a table of them for each of PASSES."""
    masks = _word_masks(covering_masks(64 * WORDS, SEGMENTS, RADIUS, WIDTH), WORDS)
    prints, passes, n = nodes.select("id", "print"), [], nodes.count()
    sketch = ", ".join(f"s{k} long" for k in range(SKETCH))
    for low, high in zip((0, *PASSES), PASSES, strict=False):
        dealt = prints.mapInArrow(partial(_deal_prints, masks=masks[low:high], first=low), f"key long, id long, {sketch}")
        passes.append(settle(dealt.repartition(n * (high - low) // TASK_ROWS + 1, "key").sortWithinPartitions("key").mapInArrow(partial(_near_cells, apart=APART), "key long, id long, low long"), "cells"))
    few = nodes.select(F.explode("few").alias("key"), "id")
    shared = few.groupBy("key").agg(F.min("id").alias("low"), F.max("id").alias("high")).filter("low <> high").select("key", "low")
    passes[-1] = passes[-1].unionByName(settle(few.join(shared, "key").select("key", "id", "low"), "few"))
    return passes


def prefix_sizes(sizes: np.ndarray, similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """Of sets in one order of their elements: how many of the first ones a set meets others by, as the larger or the smaller of a pair.

    Sets of at least the similarity share many elements, so one of the first ones: the smaller one's few and the larger one's more."""
    probe = sizes - np.ceil(similarity * sizes - 1e-9) + 1
    index = sizes - np.ceil(2 * similarity / (1 + similarity) * sizes - 1e-9) + 1
    return np.minimum(probe, sizes).astype(np.int64), np.minimum(index, sizes).astype(np.int64)


class Prefixes:
    """Which of some sets can be similar: the rarest elements of each, by element."""

    def __init__(self, sizes: np.ndarray, flat: np.ndarray, similarity: float):
        owner = np.repeat(np.arange(len(sizes)), sizes)
        _, at, times = np.unique(flat, return_inverse=True, return_counts=True)
        self.elements, self.ends, self.mine = at, np.concatenate(([0], np.cumsum(sizes))), np.zeros(len(times), bool)
        order = np.lexsort((at, times[at], owner))
        at, owner = at[order], owner[order]
        rank = np.arange(len(at)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        probe, index = prefix_sizes(sizes, similarity)
        self.kinds = []
        for first in (probe, index):
            mine = rank < first[owner]
            by = np.argsort(at[mine], kind="stable")
            elements, owners = at[mine][by], owner[mine][by]
            self.kinds.append((at[mine], np.concatenate(([0], np.cumsum(first))), owners, np.searchsorted(elements, np.arange(len(times) + 1))))

    def near(self, x: int) -> np.ndarray:
        """Sets that share one of the first elements, as the larger ones and as the smaller ones."""
        out = []
        for (mine, ends, _, _), (_, _, owners, starts) in (self.kinds, self.kinds[::-1]):
            out += [owners[starts[e] : starts[e + 1]] for e in mine[ends[x] : ends[x + 1]].tolist()]
        return np.unique(np.concatenate(out)) if out else np.empty(0, np.int64)

    def shared(self, x: int, others: np.ndarray) -> np.ndarray:
        """How many elements of set x each of the others has."""
        own = self.elements[self.ends[x] : self.ends[x + 1]]
        self.mine[own] = True
        out = np.zeros(len(others), np.int64)
        for low in range(0, len(others), 1024):
            first, sizes = self.ends[others[low : low + 1024]], np.diff(self.ends)[others[low : low + 1024]]
            upto = np.cumsum(sizes)
            found = self.mine[self.elements[np.arange(upto[-1]) + np.repeat(first - upto + sizes, sizes)]]
            sums = np.concatenate(([0], np.cumsum(found)))
            out[low : low + 1024] = sums[upto] - sums[upto - sizes]
        self.mine[own] = False
        return out


def similar(sets: list[np.ndarray], groups: list, similarity: float) -> list[tuple[int, int]]:
    """Places of links, from one set to all that are reached from it, that join what pairs of sets with at least the Jaccard similarity join; sets of one group are joined already."""
    sizes = np.array([len(x) for x in sets])
    flat = np.concatenate(sets)
    _, names = np.unique(groups, return_inverse=True)
    members = np.argsort(names, kind="stable")
    first = np.searchsorted(names[members], np.arange(names.max() + 2))
    prefixes = Prefixes(sizes, flat, similarity)
    out: list[tuple[int, int]] = []
    free, left = np.ones(len(sets), bool), len(sets)
    for hub in range(len(sets)):
        if not free[hub]:
            continue
        wave = members[first[names[hub]] : first[names[hub] + 1]]
        free[wave] = False
        left -= len(wave)
        wave = wave.tolist()
        while wave and left:
            at = wave.pop()
            fits = prefixes.near(at)
            fits = fits[free[fits]]
            fits = fits[np.minimum(sizes[fits], sizes[at]) >= similarity * np.maximum(sizes[fits], sizes[at]) - 1e-9]
            shared = prefixes.shared(at, fits)
            near = fits[shared >= similarity * (sizes[fits] + sizes[at] - shared) - 1e-9]
            if len(near):
                out += [(hub, int(x)) for x in near]
                for name in np.unique(names[near]).tolist():
                    reached = members[first[name] : first[name + 1]]
                    free[reached] = False
                    left -= len(reached)
                    wave += reached.tolist()
    return out


def _similar_links(batches: Iterator[pa.RecordBatch], similarity: float) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        left, right = [], []
        for members in batch.column("members"):
            fps, roots, hashes = zip(*[(m["fp"], m["root"], np.frombuffer(m["hashes"], np.uint64)) for m in members.as_py()], strict=True)
            for x, y in similar(list(hashes), list(roots), similarity):
                left.append(max(fps[x], fps[y]))
                right.append(min(fps[x], fps[y]))
        yield pa.RecordBatch.from_arrays([pa.array(left, pa.binary()), pa.array(right, pa.binary())], ["a", "b"])


def _compared(members: DataFrame, sets: DataFrame, similarity: float, *keys: str) -> DataFrame:
    """Links (a, b) within each group of members(keys, fp, root); groups hold about SET_HASHES hashes at most."""
    groups = members.join(sets, "fp").groupBy(*keys).agg(F.collect_list(F.struct("fp", "root", "hashes")).alias("members")).select("members")
    return settle(short_batches(groups).mapInArrow(partial(_similar_links, similarity=similarity), "a binary, b binary").distinct(), "links")


def _rooted(rows: DataFrame, known: DataFrame | None) -> DataFrame:
    """rows(fp, ...) with the root that known links lead to."""
    return rows.join(known.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp")) if known else rows.withColumn("root", F.col("fp"))


def _unlike(dealt: DataFrame, key: str) -> DataFrame:
    """Groups of dealt(key, fp, root, size) that are not joined yet, those with the same members once: (key, low, weight)."""
    groups = dealt.groupBy(key).agg(F.min("root").alias("from"), F.max("root").alias("to"), F.min("fp").alias("low"), F.sum("size").alias("weight"), F.count(F.lit(1)).alias("n"), *[F.bit_xor(F.xxhash64(F.lit(k), "fp")).alias(f"x{k}") for k in (1, 2)])
    return groups.filter("`from` <> `to`").groupBy("n", "x1", "x2").agg(F.min(F.struct(key, "low", "weight")).alias("g")).select("g.*")


def prefix_components(large: DataFrame, sets: DataFrame, known: DataFrame | None, similarity: float) -> DataFrame:
    """Links (a, b) between the nodes large(fp, size), whatever their number: by the rarest hashes of each set (see Prefixes), rare among all of large.

    Similar sets share one of them, so those of one hash are compared; where they are more than a task takes, in pairs of their parts."""
    hashes = settle(sets.join(large.filter("size > 0"), "fp").select("fp", "size", F.explode(F.expr("transform(sequence(1, size), i -> substring(hashes, 8 * i - 7, 8))")).alias("hash")), "hashes")
    times = hashes.groupBy("hash").agg(F.count(F.lit(1)).alias("times"))
    size = F.col("size")
    rank = F.row_number().over(Window.partitionBy("fp").orderBy("times", "hash"))
    probe, index = [size - F.ceil(F.lit(share) * size - 1e-9) + 1 for share in (similarity, 2 * similarity / (1 + similarity))]
    first = hashes.join(times, "hash").withColumn("rank", rank).filter((F.col("rank") <= probe) & (F.col("times") > 1))
    first = settle(_rooted(first.select("fp", "size", "hash", (F.col("rank") <= index).alias("smaller")), known), "first")
    met = first.groupBy("hash").agg(F.bool_or("smaller").alias("met")).filter("met").select("hash")  # else no pair meets here
    first = first.join(met, "hash", "left_semi")
    parts = F.ceil(F.col("weight") / SET_HASHES).cast("int")
    dealt = first.join(_unlike(first, "hash").select("hash", parts.alias("parts")), "hash")
    part = F.pmod(F.xxhash64("fp"), F.col("parts")).cast("int")
    dealt = dealt.withColumn("part", part).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    return _compared(dealt.select("hash", F.least("part", "other").alias("one"), F.greatest("part", "other").alias("two"), "fp", "root"), sets, similarity, "hash", "one", "two")


def similar_components(groups: DataFrame, sets: DataFrame, similarity: float) -> DataFrame | None:
    """(node, root) of the members of groups (key, fp, size), linked where the exact Jaccard similarity of their sets(fp, hashes) is at least similarity; None without any link.

    A member stands in one group, so its set is sent once. A group of over SET_HASHES hashes is compared in parts of that size, each with the group's
    least member, which joins many copies of a text; pairs over its parts are left to prefix_components()."""
    known = parts = None

    def add(fresh: DataFrame) -> None:
        nonlocal known, parts
        if not fresh.isEmpty():
            parts = parts.unionByName(fresh) if parts else fresh
            known = settle(components(parts), "components")

    weights = settle(groups.groupBy("key").agg(F.min("fp").alias("low"), F.ceil(F.sum("size") / SET_HASHES).cast("int").alias("parts")), "weights")
    members = _rooted(groups.join(weights, "key"), None).withColumn("part", F.when(F.col("fp") == F.col("low"), F.sequence(F.lit(0), F.greatest("parts", F.lit(1)) - 1)).otherwise(F.array(F.pmod(F.xxhash64("fp"), F.col("parts")).cast("int"))))
    members = settle(members.select("key", "parts", F.explode("part").alias("part"), "fp", "root", "size"), "members")
    add(_compared(members, sets, similarity, "key", "part"))
    large = settle(members.filter("parts > 1").select("fp", "size").distinct(), "large")
    if not large.isEmpty():
        add(prefix_components(large, sets, known, similarity))
    for old in (weights, members, large):
        forget(old)
    return known


def drop_near_duplicates(docs: DataFrame, shingle: int = 5, similarity: float = 0.8, seed: int = 42) -> DataFrame:
    """docs with one document of each group of near-duplicates: the one with the least id (of several rows with it, that with the least hash of its text).

    Links are pairs whose sets of shingles have at least the exact Jaccard similarity (0.8 or more; the tables are laid out for it). Joins that read texts meet short
    tables, of the candidates and of the rows that go, so texts need no shuffle as long as these can be broadcast."""
    keyed = docs.withColumns({"__key": key_of(F.col("text")), "__id": F.coalesce(F.col("doc_id").cast("string"), F.lit(""))})
    found = settle(_with_sets(keyed.select("doc_id", "text", "__key", "__id"), ["doc_id", "__key", "__id"], "fp binary, print binary, few array<long>, size int", shingle, seed), "found")
    nodes = found.groupBy("fp").agg(F.min("__key").alias("__key"), *[F.first(c).alias(c) for c in ("print", "few", "size")])  # equal sets are one node and have equal fingerprints
    nodes = settle(nodes.withColumn("id", F.xxhash64("fp")), "nodes")
    cells = near_cells(nodes)
    near = components(reduce(DataFrame.unionByName, cells).select(F.col("id").alias("a"), F.col("low").alias("b")))  # what any tables join is compared as one group
    some = settle(nodes.join(near, F.col("id") == F.col("node")).select(F.col("root").alias("key"), "fp", "size", "__key"), "candidates")
    asked = settle(some.select("__key").distinct(), "asked")
    again = _with_sets(keyed.select("text", "__key").join(asked, "__key", "left_semi"), [], "fp binary, hashes binary", shingle, seed)
    sets = settle(again.groupBy("fp").agg(F.first("hashes").alias("hashes")), "sets")
    joined = similar_components(some.select("key", "fp", "size"), sets, similarity)
    rows = found.select("doc_id", "__id", "__key", "fp")
    rows = rows.join(joined.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp")) if joined else rows.withColumn("root", F.col("fp"))
    place = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("doc_id"), F.col("__key").alias("key"))
    firsts = settle(rows.groupBy("root").agg(F.min(place).alias("first")), "firsts")
    stay = firsts.select(F.coalesce(F.col("first.doc_id").cast("string"), F.lit("")).alias("__id"), F.col("first.key").alias("__key"))
    gone = settle(found.select("__id", "__key").distinct().join(stay, ["__id", "__key"], "left_anti"), "gone")
    out = keyed.join(gone, ["__id", "__key"], "left_anti")
    n_rows, ids = found.select(F.count(F.lit(1)), F.countDistinct("__id", "__key")).first()
    if n_rows != ids:  # rows repeat an id and its text: one of them stays, and each task sends one of those that it reads
        out = out.dropDuplicates(["__id", "__key"])
    for old in (found, nodes, *cells, near, some, asked, sets, firsts):
        forget(old)
    return out.select(*docs.columns)


def hex_of(fp: Column) -> Column:
    return F.lower(F.hex(fp))
