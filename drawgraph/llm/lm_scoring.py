"""Language-model scores by stupid backoff, with count tables partitioned by hash.

Documents are packed into batches of bounded size where they lie. A batch explodes its texts into hashed
n-grams of one to order words, combines them (an n-gram counts once for each batch, however often it stands
there, so none is hot), and asks for them by ranges of the hash. Each range sums its counts over all
batches: a partition of the n-gram count table. The sums are joined back to the batch that asked, n-gram by
n-gram, and summed per document.

The score of a word is c(n-gram) / c(its words before) for the longest n-gram that was seen, times BACKOFF
for each longer one that was not, and c(word) / words for a single word. A document's own occurrences are
taken from every count, or each text would vouch for itself; a word not seen elsewhere counts as once.
Logarithms to base 10 are summed in millionths, as whole numbers, so that the order of summing doesn't matter.

At scale: n-grams are numbers of HASH_BITS bits, sent as differences of sorted numbers (under five bytes
each); texts are shuffled once, compressed. A batch is a row, and a partition holds many batches or many
ranges, so partitions don't grow with both; a range is summed at a time. Nothing is broadcast. Batches come
from rows as they lie, so equal rows, or one very long text, cannot make one large.

Defined results: null, empty and wordless texts have no words and score 0; a document of one word has the
score of that word; rows that repeat an id or a text are documents of their own, so each vouches for the
other; an empty table gives an empty result; further columns pass through, text excepted; those named like
the operator's own are replaced.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from .common import WORD_BYTES, collect_garbage, settle, short_batches

BACKOFF = 0.4
#: Words of the longest n-gram.
ORDER = 3
#: Bits of an n-gram's number: of ten thousand million different n-grams, one in seven million shares its number with another.
HASH_BITS = 56
#: Bytes of text in a batch, n-grams that a range of the count table gets from all batches, about, and partitions of ranges at most.
BATCH_BYTES, RANGE_GRAMS, MOST_PARTITIONS = 5 * 1024 * 1024, 2_000_000, 20_000


class _Hashes(dict):
    """Hashes of words seen so far; started anew when it grows large."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 300_000:
            self.clear()
        self[word] = found = xxhash.xxh64_intdigest(word)
        return found


_hashes = _Hashes()


def _joined(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    h = a * np.uint64(0x9E3779B97F4A7C15) + (b ^ (b >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) + np.uint64(1)
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(29))


def grams(texts: list[bytes], order: int = ORDER) -> tuple[np.ndarray, list[np.ndarray], list[np.ndarray]]:
    """The document of each word; for n = 1 to order, the numbers of all n-grams and the places of their last words."""
    parts, sizes = [], []
    for text in texts:
        words = text.translate(WORD_BYTES).split()
        parts.append(np.fromiter(map(_hashes.__getitem__, words), np.uint64, len(words)))
        sizes.append(len(words))
    words = np.concatenate(parts) if parts else np.empty(0, np.uint64)
    doc = np.repeat(np.arange(len(texts), dtype=np.int32), sizes)
    drop = np.uint64(64 - HASH_BITS)
    found, places, last = [words >> drop], [np.arange(len(words))], words
    for n in range(2, order + 1):
        at = np.flatnonzero(doc[n - 1 :] == doc[: len(doc) - n + 1]) + n - 1
        before = np.zeros(len(words), np.uint64)
        before[places[-1]] = last
        last = _joined(before[at - 1], words[at])
        found.append(last >> drop)
        places.append(at)
    return doc, found, places


def _packed_numbers(x: np.ndarray) -> bytes:
    """Numbers as compressed planes of bytes: of small numbers all but the first planes are zeros."""
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(-1, 8).T).tobytes())


def _numbers(packed: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(packed), np.uint8).reshape(8, -1)
    return np.ascontiguousarray(planes.T).reshape(-1).view("<u8")


def _texts(column: pa.Array) -> list[bytes]:
    unpack = zstandard.ZstdDecompressor()
    return [unpack.decompress(x) for x in column.to_pylist()]


def _pack(batches: Iterator[pa.RecordBatch], fields: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Rows in lots of BATCH_BYTES of text, about, each lot a row."""
    packer, here, lots = zstandard.ZstdCompressor(level=1), TaskContext.get().partitionId() << 32, 0
    held: list[pa.RecordBatch] = []
    size = 0

    def lot() -> pa.RecordBatch:
        rows = pa.Table.from_batches(held, fields).combine_chunks().to_struct_array().combine_chunks()
        return pa.RecordBatch.from_arrays([pa.array([here + lots], pa.int64()), pa.ListArray.from_arrays(pa.array([0, len(rows)], pa.int32()), rows)], ["batch", "docs"])

    for batch in batches:
        texts = batch.column("text").cast(pa.binary())
        whole = pa.RecordBatch.from_arrays([pa.array([packer.compress(x.as_py() or b"") for x in texts], pa.binary()) if f.name == "packed" else batch.column(f.name) for f in fields], schema=fields)
        start = 0
        for i, x in enumerate(texts):
            size += len(x.as_buffer()) if x.is_valid else 0
            if size >= BATCH_BYTES:
                held.append(whole.slice(start, i + 1 - start))
                yield lot()
                held, size, start, lots = [], 0, i + 1, lots + 1
        if start < batch.num_rows:
            held.append(whole.slice(start))
    if held:
        yield lot()


_ASKED = "batch long, part int, words long, grams binary, counts binary"


def _ask(batches: Iterator[pa.RecordBatch], ranges: int, order: int) -> Iterator[pa.RecordBatch]:
    """What each batch asks of each range: its distinct n-grams in order, as differences, and their counts here."""
    for held in batches:
        for batch, docs in zip(held.column("batch").to_pylist(), held.column("docs"), strict=True):
            doc, found, _ = grams(_texts(docs.values.field("packed")), order)
            seen, counts = np.unique(np.concatenate(found), return_counts=True)
            cuts = np.searchsorted(seen, (np.arange(ranges + 1, dtype=object) * 2**HASH_BITS // ranges).astype(np.uint64)) if ranges > 1 else np.array([0, len(seen)])
            some = np.flatnonzero(np.diff(cuts))
            lists = [[_packed_numbers(np.diff(seen[cuts[r] : cuts[r + 1]], prepend=np.uint64(0))) for r in some], [_packed_numbers(counts[cuts[r] : cuts[r + 1]]) for r in some]]
            total = np.zeros(len(some), np.int64)
            total[:1] = len(doc)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(some), batch)), pa.array(some.astype(np.int32)), pa.array(total), *[pa.array(x, pa.binary()) for x in lists]], ["batch", "part", "words", "grams", "counts"])


def _sum(rows: list[tuple[int, int, int, bytes, bytes]]) -> pa.RecordBatch:
    """A range of the count table: sums over all batches, answered in the order in which each batch asked."""
    asked = [np.cumsum(_numbers(r[3]), dtype=np.uint64) for r in rows]
    _, at = np.unique(np.concatenate(asked), return_inverse=True)
    own = np.concatenate([_numbers(r[4]) for r in rows]).astype(np.int64)
    sums = np.bincount(at, own).astype(np.int64)[at]
    ends = np.cumsum([len(x) for x in asked])
    answers = [_packed_numbers(x) for x in np.split(sums, ends[:-1])]
    return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int32()), pa.array([r[2] for r in rows], pa.int64()), pa.array(answers, pa.binary())], ["batch", "part", "words", "totals"])


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come in order of their ranges; one range is held at a time."""
    held: list[tuple[int, int, int, bytes, bytes]] = []
    for batch in batches:
        for row in zip(*[batch.column(c).to_pylist() for c in ("batch", "part", "words", "grams", "counts")], strict=True):
            if held and held[0][1] != row[1]:
                yield _sum(held)
                held = []
            held.append(row)
    if held:
        yield _sum(held)


def _micro(x: np.ndarray) -> np.ndarray:
    return np.rint(np.log10(np.maximum(x, 1)) * 1e6).astype(np.int64)


def scores(doc: np.ndarray, found: list[np.ndarray], places: list[np.ndarray], totals: np.ndarray, docs: int, everywhere: int) -> tuple[np.ndarray, ...]:
    """Words, words whose pair, and whose longest n-gram, other documents hold, and millionths of log score of each document.

    totals: counts over all documents of the distinct n-grams, in their order."""
    n = np.bincount(doc, minlength=docs)
    flat, of = np.concatenate(found), np.concatenate([doc[p] for p in places])
    order = np.argsort(flat, kind="stable")  # keeps documents together within an n-gram
    sorted_grams, sorted_docs = flat[order], of[order]
    fresh = np.ones(len(flat), bool)
    fresh[1:] = sorted_grams[1:] != sorted_grams[:-1]
    own_first = fresh.copy()
    own_first[1:] |= sorted_docs[1:] != sorted_docs[:-1]
    starts = np.flatnonzero(own_first)
    own = np.diff(np.append(starts, len(flat)))
    elsewhere = np.empty(len(flat), np.int64)
    elsewhere[order] = np.repeat(totals[np.cumsum(fresh)[starts] - 1] - own if len(starts) else own, own)
    counts = np.split(elsewhere, np.cumsum([len(x) for x in found])[:-1])
    value = _micro(counts[0]) - _micro(everywhere - n)[doc]
    seen = [n.astype(np.int64)]
    step, context = round(np.log10(BACKOFF) * 1e6), counts[0]
    for here, at in zip(counts[1:], places[1:], strict=True):
        known = here > 0
        value[at] = np.where(known, _micro(here) - _micro(context[at - 1]), step + value[at])
        seen.append(np.bincount(doc[at], known, docs).astype(np.int64))
        context = np.zeros(len(doc), np.int64)
        context[at] = here
    out = np.zeros(docs, np.int64)
    np.add.at(out, doc, value)
    return seen[0], seen[1] if len(seen) > 1 else np.zeros(docs, np.int64), seen[-1] if len(seen) > 1 else np.zeros(docs, np.int64), out


_MADE = ("n_words", "n_seen", "n_full", "log_micro")


def _scorer(everywhere: int, order: int, schema: pa.Schema) -> Callable[[pa.Table, pa.Table], pa.Table]:
    def score(packed: pa.Table, answers: pa.Table) -> pa.Table:
        docs = pa.RecordBatch.from_struct_array(packed.column("docs").combine_chunks().flatten())
        doc, found, places = grams(_texts(docs.column("packed")), order)
        answers = answers.sort_by("part")
        totals = np.concatenate([_numbers(x) for x in answers.column("totals").to_pylist()]).astype(np.int64) if answers.num_rows else np.empty(0, np.int64)
        made = dict(zip(_MADE, scores(doc, found, places, totals, docs.num_rows, everywhere), strict=True))
        return pa.table([pa.array(made[f.name], f.type) if f.name in made else docs.column(f.name) for f in schema], schema=schema)

    return score


def score_texts(docs: DataFrame, order: int = ORDER) -> DataFrame:
    """docs(doc_id, text, ...) without text, with n_words, n_seen (words whose pair other documents hold), n_full (whose n-gram of order words), log_micro (millionths of the log10 of the score) and log_score (per word)."""
    docs = short_batches(docs).drop("packed", "log_score", *_MADE)
    size = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    least = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranges = max(least, size * order // 12 // RANGE_GRAMS + 1)
    partitions = min(ranges, max(least, MOST_PARTITIONS))
    fields = [f for f in docs.schema.fields if f.name != "text"]
    rows = T.StructType([*fields, T.StructField("packed", T.BinaryType())])
    batches = T.StructType([T.StructField("batch", T.LongType()), T.StructField("docs", T.ArrayType(rows))])
    packed = settle(docs.mapInArrow(partial(_pack, fields=to_arrow_schema(rows)), batches), "packed")
    asked = packed.mapInArrow(partial(_ask, ranges=ranges, order=order), _ASKED)
    dealt = asked.repartitionById(partitions, F.floor(F.col("part").cast("long") * partitions / ranges).cast("int")).sortWithinPartitions("part")
    answers = settle(dealt.mapInArrow(_count, "batch long, part int, words long, totals binary"), "counts")
    everywhere = answers.agg(F.coalesce(F.sum("words"), F.lit(0))).first()[0]
    collect_garbage(docs.sparkSession)
    result = T.StructType([*fields, *[T.StructField(c, T.LongType()) for c in _MADE]])
    scored = packed.groupBy("batch").cogroup(answers.select("batch", "part", "totals").groupBy("batch")).applyInArrow(_scorer(everywhere, order, to_arrow_schema(result)), result)
    return scored.withColumn("log_score", F.when(F.col("n_words") > 0, F.col("log_micro") / F.lit(1e6) / F.col("n_words")).otherwise(0.0))
