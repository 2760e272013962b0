"""Removal of byte strings that occurred before, by a sparse suffix array over all documents.

Of every LENGTH consecutive bytes, the suffix with the least hash of its first LEAD bytes is sampled; the
choice looks at those bytes only, so equal strings sample the same suffix at the same offset. The sampled
suffixes are range-partitioned by their leading bytes (then by hashes of more context, document and
place, so that splitters also cut through a group of equal suffixes), each bucket is sorted by multikey
quicksort, neighbours are compared, and the runs at the ends of buckets are compared across boundaries.

A suffix stands for the strings that sample it. Where all of them and their context equal those of an
earlier suffix, all are repeats; where no other suffix shares its leading bytes, none is. Only at the
edges of repeated passages do suffixes share the lead but not the whole context. Those go through two
finer rounds of the same sort: suffixes that stand for 8 strings each, with a lead of 93 bytes, and what
is still open there as single strings of 100 bytes.

At scale: what is shuffled grows with the text (about one sampled suffix in 35 bytes, and the texts, packed,
to meet the findings); buckets follow the estimated number of suffixes; no group of equal suffixes has to
be in one task.

Defined results: a null text is empty and nothing is removed from it; rows that share a doc_id are
documents in the order of their text's hash, so of two equal rows one is the earlier; rows without an id
come first; ids may be of any type that has an order (then, as with null and repeated ids, rows are numbered by a sort of ids
and hashes, and texts are written and shuffled once more); an empty table gives an empty result; further columns pass through, those named like the
operator's own are replaced.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import cache, partial, reduce

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from .common import key_of, settle, short_batches

#: Bytes of a string that must not repeat.
LENGTH = 100
#: Strings that a suffix stands for at most, by round. All of them hold its first LENGTH + 1 - strings bytes: the lead.
ROUNDS = (69, 8, 1)
LEAD = LENGTH + 1 - ROUNDS[0]
#: Bytes of text that a task looks at together; must be below 2 ** 21.
CHUNK = 1 << 19
#: Sampled suffixes in a bucket, about, and rows of the sample for each splitter.
BUCKET_ROWS, SAMPLE = 250_000, 64
_FIELDS = ("lead", "pack", "full", "doc", "pos")
_SUFFIXES = "lead long, pack long, full long, doc long, pos long"


@cache
def _powers(base: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Powers of an odd base and of its inverse modulo 2^64, and a value for each byte."""
    n = CHUNK + 2 * LENGTH + 2
    with np.errstate(over="ignore"):
        up = np.full(n, base, np.uint64)
        up[0] = 1
        down = np.full(n, pow(base, -1, 2**64), np.uint64)
        down[0] = 1
        return np.cumprod(up), np.cumprod(down), np.random.default_rng(base % 2**32).integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


_BASES = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return h ^ (h >> np.uint64(33))


class Rolling:
    """Hashes of any part of a byte string of at most CHUNK + 2 * LENGTH bytes."""

    def __init__(self, data: np.ndarray, base: int):
        up, self.down, values = _powers(base)
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(values[data] * up[: len(data)], out=self.sums[1:])

    def of(self, first: np.ndarray, end: np.ndarray) -> np.ndarray:
        return _mix((self.sums[end] - self.sums[first]) * self.down[first])


_LOW14 = np.uint64((1 << 14) - 1)


def _head(data: np.ndarray, place: np.ndarray) -> np.ndarray:
    """The first eight bytes of suffixes, as signed numbers in the order of the bytes."""
    head = np.zeros(len(place), np.uint64)
    for j in range(8):
        head = (head << np.uint64(8)) | data[place + j].astype(np.uint64)
    return (head ^ (np.uint64(1) << np.uint64(63))).view(np.int64)


def sample(data: np.ndarray, ends: np.ndarray, stops: np.ndarray | None = None, length: int = LENGTH, lead: int = LEAD) -> tuple[np.ndarray, ...]:
    """Sampled suffixes of texts that stand after one another: their places, the first and last strings that sample them, lead, pack and full.

    ends: where each text ends. stops: from where on a text's strings are left to the next chunk."""
    none = np.empty(0, np.int64)
    if len(data) < length:
        return none, none, none, none, none, none
    rolling = Rolling(data, _BASES[0])
    at = np.arange(len(data) - lead + 1)
    key = rolling.of(at, at + lead)
    low = np.uint64((1 << 21) - 1)
    key = (key & ~low) | at.astype(np.uint64)
    span = length - lead + 1
    step = 1
    while step * 2 <= span:
        key = np.minimum(key[: len(key) - step], key[step:])
        step *= 2
    key = np.minimum(key[: len(key) - (span - step)], key[span - step :])
    starts = np.concatenate(([0], ends[:-1]))
    lengths = ends - starts
    limit = np.repeat(ends if stops is None else np.minimum(ends, stops + length - 1), lengths)[: len(key)]
    strings = np.flatnonzero(np.arange(len(key)) + length <= limit)
    if not len(strings):
        return none, none, none, none, none, none
    place = (key[strings] & low).astype(np.int64)
    change = np.flatnonzero(np.concatenate(([True], place[1:] != place[:-1])))
    last = strings[np.concatenate((change[1:] - 1, [len(strings) - 1]))]
    first, place = strings[change], place[change]
    full = rolling.of(first, last + length).view(np.int64)
    head = _head(data, place)
    more = _mix(rolling.of(place, place + lead) + np.uint64(1))
    pack = (more & ~_LOW14) | ((place - first) << 7 | (place - last)).astype(np.uint64)
    return place, first, last, head, pack.view(np.int64), full


def _pieces(texts: list[bytes]) -> Iterator[tuple[list[int], list[int], list[bytes], list[int]]]:
    """Texts in lots of about CHUNK bytes: (rows, offsets in their texts, bytes, bytes that hold strings of this lot). Long texts come in overlapping pieces."""
    rows, offsets, parts, own, size = [], [], [], [], 0
    for i, text in enumerate(texts):
        for at in range(0, max(1, len(text) - LENGTH + 1), CHUNK):
            part = text[at : at + CHUNK + LENGTH - 1]
            if size and size + len(part) > CHUNK + LENGTH:
                yield rows, offsets, parts, own
                rows, offsets, parts, own, size = [], [], [], [], 0
            rows.append(i)
            offsets.append(at)
            parts.append(part)
            own.append(len(part))
            size += len(part)
    if parts:
        yield rows, offsets, parts, own


def _suffixes(batches: Iterator[pa.RecordBatch], splitters: np.ndarray | None) -> Iterator[pa.RecordBatch]:
    """Rows of _FIELDS, and with splitters also the bucket."""
    for batch in batches:
        texts = [x.as_py() or b"" for x in batch.column("text").cast(pa.binary())]
        doc = batch.column("doc").to_numpy()
        for rows, offsets, parts, _ in _pieces(texts):
            ends = np.cumsum([len(p) for p in parts])
            place, _, _, head, pack, full = sample(np.frombuffer(b"".join(parts), np.uint8), ends)
            if not len(place):
                continue
            part = np.searchsorted(ends, place, "right")
            row = np.array(rows)[part]
            pos = place - np.concatenate(([0], ends[:-1]))[part] + np.array(offsets)[part]
            columns = [head, pack, full, doc[row], pos]
            names = list(_FIELDS)
            if splitters is not None:
                columns.append(bucket_of(columns, splitters))
                names.append("bucket")
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names)


def bucket_of(columns: list[np.ndarray], splitters: np.ndarray) -> np.ndarray:
    """How many splitters (rows of all keys, sorted) stand at or before each row. Later keys count only where a splitter has the row's leading bytes."""
    out = np.searchsorted(splitters[:, 0], columns[0], "left")
    upto = np.searchsorted(splitters[:, 0], columns[0], "right")
    for i in np.unique(out[out < upto]):
        for j in range(i, len(splitters)):
            if splitters[j, 0] != splitters[i, 0]:
                break
            mine = np.flatnonzero((columns[0] == splitters[j, 0]) & (upto > j))
            equal, beyond = np.ones(len(mine), bool), np.zeros(len(mine), bool)
            for k in range(1, len(columns)):
                beyond |= equal & (columns[k][mine] > splitters[j, k])
                equal &= columns[k][mine] == splitters[j, k]
            out[mine] += beyond | equal
    return out.astype(np.int32)


def multikey_order(columns: list[np.ndarray]) -> np.ndarray:
    """Order of the rows by several keys: sorted by the first, and only rows that tie so far by the next."""
    order = np.argsort(columns[0])
    fresh = np.concatenate(([True], np.diff(columns[0][order]) != 0))
    for values in columns[1:]:
        group = np.cumsum(fresh)
        tied = ~fresh | np.concatenate((~fresh[1:], [False]))
        at = np.flatnonzero(tied)
        if not len(at):
            break
        rows = order[at]
        order[at] = rows[np.lexsort((values[rows], group[at]))]
        fresh[1:] |= values[order[1:]] != values[order[:-1]]
    return order


_FOUND = "kind int, doc long, pos long, pack long, lead long, full long, bucket int, contexts long, last boolean"


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A bucket's findings. kind 0: all strings of the suffix are repeats; 1: to be looked at string by string; 2: open until the neighbouring buckets are known.
    3: only tells what a bucket ends with. Of kinds 2 and 3: contexts is how many the lead has in this bucket."""
    whole = pa.Table.from_batches(batches) if (batches := list(batches)) else None
    if whole is None or not whole.num_rows:
        return
    names = ["kind", "doc", "pos", "pack", "lead", "full", "bucket", "contexts", "last"]
    buckets = whole.column("bucket").to_numpy()
    for b in np.unique(buckets):
        columns = [whole.column(c).to_numpy()[buckets == b] if len(np.unique(buckets)) > 1 else whole.column(c).to_numpy() for c in _FIELDS]
        order = multikey_order(columns)
        lead, pack, full, doc, pos = (c[order] for c in columns)
        first = np.ones(len(order), bool)  # of suffixes with this lead
        first[1:] = (lead[1:] != lead[:-1]) | ((pack[1:] >> 14) != (pack[:-1] >> 14))
        head = first.copy()  # of those with this whole context
        head[1:] |= (pack[1:] != pack[:-1]) | (full[1:] != full[:-1])
        group = np.cumsum(first) - 1
        contexts = np.bincount(group, head)[group].astype(np.int64)
        kind = np.where(~head, 0, np.where(contexts > 1, 1, -1))
        end = np.flatnonzero(head)[-1]
        if kind[end] == -1:
            kind[end] = 2
        kind[0] = 2
        keep = np.flatnonzero(kind >= 0)
        more = np.array([end]) if kind[end] != 2 else np.empty(0, np.int64)
        at = np.concatenate((keep, more))
        kinds = np.concatenate((kind[keep], np.full(len(more), 3)))
        yield pa.RecordBatch.from_arrays([pa.array(kinds.astype(np.int32)), pa.array(doc[at]), pa.array(pos[at]), pa.array(pack[at]), pa.array(lead[at]), pa.array(full[at]), pa.array(np.full(len(at), b, np.int32)), pa.array(contexts[at]), pa.array(at == end)], names)


def refine(data: np.ndarray, pos: np.ndarray, pack: np.ndarray, strings: int) -> list[np.ndarray]:
    """The strings of some suffixes of a text, as finer suffixes that stand for so many strings at most: lead, pack, full and pos."""
    before, after = (pack >> 7) & 127, pack & 127
    low, count = after // strings, before // strings - after // strings + 1
    of = np.repeat(np.arange(len(pos)), count)
    step = (low[of] + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)) * strings
    at = pos[of] - step
    back, ahead = np.minimum(before[of] - step, strings - 1), np.maximum(after[of] - step, 0)
    out: list[list[np.ndarray]] = [[], [], [], []]
    for base in np.unique((at - back) // CHUNK):
        mine = np.flatnonzero((at - back) // CHUNK == base)
        part = data[base * CHUNK : base * CHUNK + CHUNK + 2 * LENGTH]
        q, b, a = at[mine] - base * CHUNK, back[mine], ahead[mine]
        rolling = Rolling(part, _BASES[1])
        more = rolling.of(q, q + (LENGTH + 1 - strings))
        for column, values in zip(out, (_head(part, q), ((more & ~_LOW14) | (b << 7 | a).astype(np.uint64)).view(np.int64), _mix(rolling.of(q - b, q - a + LENGTH) + np.uint64(1)).view(np.int64), at[mine]), strict=True):
            column.append(values)
    return [np.concatenate(c) for c in out]


def _refined(batches: Iterator[pa.RecordBatch], strings: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for packed, doc, asked in zip(batch.column("packed"), batch.column("doc").to_pylist(), batch.column("asked"), strict=True):
            asked = asked.values
            lead, pack, full, pos = refine(np.frombuffer(_unpack(packed), np.uint8), asked.field("pos").to_numpy(), asked.field("pack").to_numpy(), strings)
            yield pa.RecordBatch.from_arrays([pa.array(lead), pa.array(pack), pa.array(full), pa.array(np.full(len(pos), doc)), pa.array(pos)], list(_FIELDS))


def _pack(batches: Iterator[pa.RecordBatch], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Texts as Zstandard frames, so that less is shuffled."""
    packer = zstandard.ZstdCompressor(level=1)
    for batch in batches:
        made = pa.array([packer.compress(x.as_py() or b"") for x in batch.column("text").cast(pa.binary())], pa.binary())
        yield pa.RecordBatch.from_arrays([made if f.name == "packed" else batch.column(f.name) for f in schema], schema=schema)


def _unpack(packed: pa.Scalar) -> bytes:
    return zstandard.ZstdDecompressor().decompress(packed.as_py())


def packed(docs: DataFrame) -> DataFrame:
    schema = T.StructType([f for f in docs.schema.fields if f.name not in ("text", "packed")] + [T.StructField("packed", T.BinaryType())])
    return docs.mapInArrow(partial(_pack, schema=to_arrow_schema(schema)), schema)


def number_documents(docs: DataFrame) -> DataFrame:
    """docs with doc, a number in the order of documents: the id itself where ids are whole numbers, none null and none repeated.

    Else rows are sorted by id (none first), text's hash and row number, and numbered in that order; the range partitions of the sort also split one id that many rows share."""
    if isinstance(docs.schema["doc_id"].dataType, T.IntegralType):
        doc = F.col("doc_id").cast("long")
        rows, ids = docs.select(F.count(F.lit(1)), F.countDistinct(doc)).first()
        if rows == ids:
            return docs.withColumn("doc", doc)
    row = "__row"
    while row in docs.columns:
        row += "_"
    whole = settle(docs.withColumn(row, F.monotonically_increasing_id()), "whole")
    order = whole.select(row, "doc_id", key_of(F.col("text")).alias("key")).orderBy(F.col("doc_id").asc_nulls_first(), "key", row)
    return whole.join(settle(order.select(row, F.monotonically_increasing_id().alias("doc")), "order"), row).drop(row)


def _splitters(some: DataFrame, buckets: int) -> np.ndarray:
    """Splitters between so many buckets from a sample of suffixes. They only balance the buckets; the sample's size follows their number."""
    seen = some.limit(buckets * SAMPLE * 4).toArrow()
    columns = [seen.column(c).to_numpy() for c in _FIELDS]
    if not len(columns[0]):
        return np.empty((0, len(_FIELDS)), np.int64)
    order = multikey_order(columns)
    return np.stack([c[order[(np.arange(1, buckets) * len(order)) // buckets]] for c in columns], axis=1)


def _round(rows: DataFrame, buckets: int) -> DataFrame:
    """Sort and compare rows (_FIELDS, bucket): (kind, doc, pos, pack) of suffixes whose strings are all repeats (0) or still open (1)."""
    found = settle(rows.repartitionById(buckets, "bucket").mapInArrow(_compare, _FOUND), "found")
    lead = [F.col("lead"), F.shiftright("pack", 14)]
    ends = found.filter("kind >= 2")  # two rows a bucket
    same, context = Window.partitionBy(*lead), Window.partitionBy(*lead, "pack", "full").orderBy("bucket", "last")
    ends = ends.withColumn("several", (F.max("contexts").over(same) > 1) | (F.min(F.struct("pack", "full")).over(same) != F.max(F.struct("pack", "full")).over(same)))
    ends = ends.withColumn("earlier", F.row_number().over(context) > 1).filter("kind = 2")
    ends = ends.withColumn("kind", F.when(F.col("earlier"), 0).when(F.col("several"), 1)).filter("kind is not null")
    known = found.filter("kind < 2").select("kind", "doc", "pos", "pack").unionByName(ends.select("kind", "doc", "pos", "pack"))
    return known.select("kind", "doc", "pos", "pack")


def _bucketed(batches: Iterator[pa.RecordBatch], splitters: np.ndarray) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield batch.append_column("bucket", pa.array(bucket_of([batch.column(c).to_numpy() for c in _FIELDS], splitters)))


def repeats(docs: DataFrame) -> DataFrame:
    """docs(doc, text): rows (doc, spans), the byte ranges that strings which occurred before cover, unmerged."""
    spark = docs.sparkSession
    texts = short_batches(docs).select("doc", "text")
    size = texts.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    least = int(spark.conf.get("spark.sql.shuffle.partitions"))
    buckets = max(least, size // 35 // BUCKET_ROWS + 1)
    share = min(1.0, buckets * SAMPLE * 35 * 8 / max(size, 1))  # neighbouring suffixes are of one kind, so one in eight of more documents
    some = texts.filter(F.pmod(F.xxhash64("doc"), F.lit(1_000_000)) < int(share * 1_000_000) + 1)
    splitters = _splitters(some.mapInArrow(partial(_suffixes, splitters=None), _SUFFIXES).filter(F.pmod(F.xxhash64(*_FIELDS), F.lit(8)) == 0), buckets)
    known = _round(texts.mapInArrow(partial(_suffixes, splitters=splitters), f"{_SUFFIXES}, bucket int"), buckets)
    parts = [known]
    for strings in ROUNDS[1:]:
        asked = known.filter("kind = 1").groupBy("doc").agg(F.collect_list(F.struct("pos", "pack")).alias("asked"))
        rows = settle(asked.join(packed(texts), ["doc"]).mapInArrow(partial(_refined, strings=strings), _SUFFIXES), "finer")
        n = rows.count()
        buckets = max(least, n // BUCKET_ROWS + 1)
        splitters = _splitters(rows.filter(F.pmod(F.xxhash64(*_FIELDS), F.lit(max(1, n // (buckets * SAMPLE)))) == 0), buckets)
        known = _round(rows.mapInArrow(partial(_bucketed, splitters=splitters), f"{_SUFFIXES}, bucket int"), buckets)
        parts.append(known)
    every = reduce(DataFrame.unionByName, parts).filter("kind = 0")
    start = F.col("pos") - F.shiftright("pack", 7).bitwiseAND(127)
    spans = every.select("doc", start.alias("start"), (F.col("pos") - F.col("pack").bitwiseAND(127) + LENGTH).alias("end"))
    return spans.groupBy("doc").agg(F.collect_list(F.struct("start", "end")).alias("spans"))


def _merged(spans: list[dict] | None) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted((x["start"], x["end"]) for x in spans or ()):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def _kept(data: bytes, spans: list[tuple[int, int]]) -> bytes:
    at, parts = 0, []
    for a, b in spans:
        parts.append(data[at:a])
        at = b
    return b"".join([*parts, data[at:]])


def _whole_characters(data: bytes, spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Spans without the characters that they hold only in part."""
    out = []
    for a, b in spans:
        while a < b and data[a] & 0xC0 == 0x80:
            a += 1
        while b > a and b < len(data) and data[b] & 0xC0 == 0x80:
            b -= 1
        if a < b:
            out.append((a, b))
    return out


def _measure(batches: Iterator[pa.RecordBatch], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        made: dict[str, list] = {"n_bytes": [], "n_removed": [], "n_spans": [], "kept_sha256": []}
        for text, found in zip(batch.column("packed"), batch.column("spans").to_pylist(), strict=True):
            data, spans = _unpack(text), _merged(found)
            made["n_bytes"].append(len(data))
            made["n_removed"].append(sum(b - a for a, b in spans))
            made["n_spans"].append(len(spans))
            made["kept_sha256"].append(hashlib.sha256(_kept(data, spans)).hexdigest())
        yield pa.RecordBatch.from_arrays([pa.array(made[f.name], f.type) if f.name in made else batch.column(f.name) for f in schema], schema=schema)


def _shorten(batches: Iterator[pa.RecordBatch], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts: list[str | None] = []
        for text, found, null in zip(batch.column("packed"), batch.column("spans").to_pylist(), batch.column("null_text").to_pylist(), strict=True):
            data = _unpack(text)
            texts.append(None if null else _kept(data, _whole_characters(data, _merged(found))).decode())
        yield pa.RecordBatch.from_arrays([pa.array(texts, f.type) if f.name == "text" else batch.column(f.name) for f in schema], schema=schema)


def _with_spans(docs: DataFrame) -> DataFrame:
    """docs with text packed, and the byte ranges to remove."""
    docs = number_documents(docs)
    return packed(docs.withColumn("null_text", F.col("text").isNull())).join(repeats(docs), ["doc"], "left")


_HELPERS = ("doc", "spans", "null_text", "packed")


def removal_report(docs: DataFrame) -> DataFrame:
    """docs(doc_id, text, ...) without text, with n_bytes, n_removed, n_spans and kept_sha256."""
    own = [T.StructField("n_bytes", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("n_spans", T.LongType()), T.StructField("kept_sha256", T.StringType())]
    docs = docs.drop(*_HELPERS, *[f.name for f in own])
    schema = T.StructType([f for f in docs.schema.fields if f.name != "text"] + own)
    return _with_spans(docs).mapInArrow(partial(_measure, schema=to_arrow_schema(schema)), schema)


def remove_repeats(docs: DataFrame) -> DataFrame:
    """docs with every repeated string cut out of text; a character that a cut would split stays whole."""
    schema = docs.drop(*_HELPERS).schema
    return _with_spans(docs.drop(*_HELPERS)).mapInArrow(partial(_shorten, schema=to_arrow_schema(schema)), schema)
