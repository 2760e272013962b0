"""Benchmark decontamination: a generalised suffix automaton of the test items, run over every training text.

The items' normalised words build one automaton. A document's words walk through it and keep, at every
word, the length of the longest item passage that ends there. A length of WINDOW or more is a window of
an item; items shorter than that count as a whole. Hit words join into spans, and spans are cut from the
text, or the document goes where they cover too much of it.

At scale: documents are only mapped. Items are split into blocks of about BLOCK_WORDS words (long items
into overlapping pieces), and one block's automaton is held at a time. Where there is more than one, each
block is a pass over the documents that writes what it found; the findings then meet the documents by id and
hash of the text, for which texts are shuffled once.

Defined results: a null text has no words, and a null or wordless item no windows; rows that share an
item_id are one item; an item without an id is called ''; rows that repeat a doc_id are judged each by
itself; a text of any length is walked through once; empty tables give empty or clean results; further columns pass through, those named like the
operator's own are replaced.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import partial, reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from .common import NON_WORD, WORD_BYTES, count_words, key_of, lower_ascii, settle, short_batches, squeeze

#: Words of a window.
WINDOW = 10
#: Words of items in one automaton, about 70 MB of Python objects at most.
BLOCK_WORDS = 100_000
#: Share of hit words from which a document goes as a whole.
MOST_COVERED = 0.5

_SPANS = T.ArrayType(T.StructType([T.StructField("first", T.LongType()), T.StructField("end", T.LongType())]))
_OWN = ("n_words", "spans", "items")


class Automaton:
    """Suffix automaton of word sequences; window: length from which an inner match counts."""

    def __init__(self, items: list[tuple[int, list[bytes]]], window: int):
        self.next: list[dict[bytes, int]] = [{}]
        self.link, self.length = [-1], [0]
        ends: list[tuple[int, int, int]] = []
        passed: dict[int, set[int]] = {}
        for item, words in items:
            last = 0
            for w in words:
                last = self._add(last, w)
                passed.setdefault(last, set()).add(item)
            ends.append((last, len(words), item))
        order = sorted(range(1, len(self.link)), key=self.length.__getitem__)
        holds = [passed.get(s, set()) for s in range(len(self.link))]
        for s in reversed(order):
            holds[self.link[s]] |= holds[s]
        #: For states of length window and more: the items that hold the window which ends there.
        self.windows: list[tuple[int, ...]] = [()] * len(self.link)
        #: Whole items shorter than a window that end in a state: (length, item), those of its suffixes included.
        self.whole: list[tuple[tuple[int, int], ...]] = [()] * len(self.link)
        for s, n, item in ends:
            if n < window:
                while self.link[s] >= 0 and self.length[self.link[s]] >= n:
                    s = self.link[s]
                self.whole[s] += ((n, item),)
        for s in order:
            up = self.link[s]
            self.whole[s] += self.whole[up]
            if self.length[s] >= window:
                self.windows[s] = self.windows[up] if self.length[up] >= window else tuple(holds[s])

    def _new(self, length: int, link: int, edges: dict[bytes, int]) -> int:
        self.next.append(edges)
        self.link.append(link)
        self.length.append(length)
        return len(self.link) - 1

    def _split(self, p: int, w: bytes, q: int) -> int:
        """The state of p's longest word sequence followed by w: q itself, or a copy of q cut to that length."""
        if self.length[p] + 1 == self.length[q]:
            return q
        copy = self._new(self.length[p] + 1, self.link[q], dict(self.next[q]))
        self.link[q] = copy
        while p >= 0 and self.next[p].get(w) == q:
            self.next[p][w] = copy
            p = self.link[p]
        return copy

    def _add(self, last: int, w: bytes) -> int:
        if w in self.next[last]:
            return self._split(last, w, self.next[last][w])
        s, p = self._new(self.length[last] + 1, 0, {}), last
        while p >= 0 and w not in self.next[p]:
            self.next[p][w] = s
            p = self.link[p]
        if p >= 0:
            self.link[s] = self._split(p, w, self.next[p][w])
        return s

    def scan(self, words: list[bytes], window: int) -> tuple[list[tuple[int, int]], set[int]]:
        """Merged spans of hit words, and the items whose windows occur."""
        spans: list[tuple[int, int]] = []
        found: set[int] = set()
        edges, link, length, whole = self.next, self.link, self.length, self.whole
        s = n = 0
        for i, w in enumerate(words):
            t = edges[s].get(w)
            if t is None:
                while t is None and s:
                    s = link[s]
                    t = edges[s].get(w)
                if t is None:
                    n = 0
                    continue
                n = length[s]
            s = t
            n += 1
            if n >= window:
                found.update(self.windows[s])
                reach = window
            else:
                reach = 0
            if whole[s]:
                for k, item in whole[s]:
                    if k <= n:
                        found.add(item)
                        reach = max(reach, k)
            if reach:
                first = i + 1 - reach
                while spans and spans[-1][1] >= first:
                    first = min(first, spans.pop()[0])
                spans.append((first, i + 1))
        return spans, found


def _pass(batches: Iterator[pa.RecordBatch], held, names: list[str], window: int, schema: pa.Schema, hits_only: bool) -> Iterator[pa.RecordBatch]:
    automaton = held.value
    for batch in batches:
        n_words, spans, items = [], [], []
        for text in batch.column("text").cast(pa.binary()):
            words = (text.as_py() or b"").translate(WORD_BYTES).split()
            hit, found = automaton.scan(words, window)
            n_words.append(len(words))
            spans.append([{"first": a, "end": b} for a, b in hit])
            items.append(sorted(names[i] for i in found))
        made = {"n_words": n_words, "spans": spans, "items": items}
        out = pa.RecordBatch.from_arrays([pa.array(made[f.name], f.type) if f.name in made else batch.column(f.name) for f in schema], schema=schema)
        yield out.filter(pa.array([bool(x) for x in spans], pa.bool_())) if hits_only else out


def blocks_of(items: DataFrame, window: int, block_words: int) -> Iterator[list[tuple[str, list[bytes]]]]:
    """The items' words, block_words at a time, about; an item over block_words comes in pieces that share window - 1 words. Equal pieces come once, so those that share an id are spread."""
    flat = squeeze(lower_ascii(F.col("text")), NON_WORD)
    rows = items.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("id"), F.split(flat, " ").alias("w"), count_words(flat).alias("n")).filter("n > 0")
    rows = rows.withColumn("at", F.explode(F.sequence(F.lit(1), F.greatest(F.lit(1), (F.col("n") - window + 1).cast("int")), F.lit(block_words))))
    rows = settle(rows.select("id", "at", F.slice("w", F.col("at"), F.lit(block_words + window - 1)).alias("w")).distinct().withColumn("size", F.size("w")), "items")
    total = rows.agg(F.sum("size")).first()[0] or 0
    count = -(-total // block_words)
    for k in range(count):
        part = rows.filter(F.pmod(F.xxhash64("id", "at", "w"), F.lit(count)) == k) if count > 1 else rows
        yield [(r["id"], [w.encode() for w in r["w"]]) for r in part.select("id", "w").toLocalIterator()]


def _automaton(block: list[tuple[str, list[bytes]]], window: int) -> tuple[Automaton, list[str]]:
    names = sorted({name for name, _ in block})
    place = {name: i for i, name in enumerate(names)}
    return Automaton([(place[name], words) for name, words in block], window), names


def _union(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Spans of several blocks made disjoint, in order."""
    for batch in batches:
        out = []
        for spans in batch.column("spans").to_pylist():
            merged: list[dict] = []
            for x in sorted(spans or (), key=lambda x: (x["first"], x["end"])):
                if merged and x["first"] <= merged[-1]["end"]:
                    merged[-1]["end"] = max(merged[-1]["end"], x["end"])
                else:
                    merged.append(x)
            out.append(merged)
        i = batch.schema.get_field_index("spans")
        yield batch.set_column(i, batch.schema.field(i), pa.array(out, batch.schema.field(i).type))


def find_overlaps(docs: DataFrame, items: DataFrame, window: int = WINDOW, keep_text: bool = True, block_words: int = BLOCK_WORDS) -> DataFrame:
    """docs(doc_id, text, ...) with n_words, spans (of hit words, from 0, disjoint and in order) and items (ids, sorted)."""
    spark = docs.sparkSession
    out = short_batches(docs).drop(*_OWN)
    words = count_words(squeeze(lower_ascii(F.col("text")), NON_WORD))
    fields = [f for f in out.schema.fields if keep_text or f.name != "text"]
    own = [T.StructField("n_words", T.LongType()), T.StructField("spans", _SPANS), T.StructField("items", T.ArrayType(T.StringType()))]
    blocks = blocks_of(items, window, block_words)
    block, more = next(blocks, None), next(blocks, None)
    if block is None:
        out = out.withColumns({"n_words": words, "spans": F.array().cast(_SPANS), "items": F.array().cast("array<string>")})
        return out if keep_text else out.drop("text")
    if more is None:
        automaton, names = _automaton(block, window)
        schema = T.StructType([*fields, *own])
        return out.mapInArrow(partial(_pass, held=spark.sparkContext.broadcast(automaton), names=names, window=window, schema=to_arrow_schema(schema), hits_only=False), schema)
    # Several blocks: one pass each, whose few findings are written before the next automaton is made. Rows equal in id and text have equal findings.
    thin = T.StructType([out.schema["doc_id"], T.StructField("__key", T.LongType()), *own[1:]])
    rows = out.select("doc_id", key_of(F.col("text")).alias("__key"), "text")
    parts = []
    while block is not None:
        automaton, names = _automaton(block, window)
        held = spark.sparkContext.broadcast(automaton)
        hits = rows.mapInArrow(partial(_pass, held=held, names=names, window=window, schema=to_arrow_schema(thin), hits_only=True), thin)
        parts.append(settle(hits.groupBy("doc_id", "__key").agg(F.first("spans").alias("spans"), F.first("items").alias("items")), "hits"))
        held.destroy()
        block, more = more, next(blocks, None)
    found = reduce(DataFrame.unionByName, parts).groupBy("doc_id", "__key").agg(F.flatten(F.collect_list("spans")).alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
    a, b = out.withColumn("__key", key_of(F.col("text"))).alias("a"), found.alias("b")
    joined = a.join(b, F.col("a.doc_id").eqNullSafe(F.col("b.doc_id")) & (F.col("a.__key") == F.col("b.__key")), "left")
    empty = {"spans": F.array().cast(_SPANS), "items": F.array().cast("array<string>")}
    joined = joined.select(*[F.col(f"a.`{f.name}`") for f in fields], count_words(squeeze(lower_ascii(F.col("a.text")), NON_WORD)).alias("n_words"), *[F.coalesce(F.col(f"b.{c}"), x).alias(c) for c, x in empty.items()])
    return joined.mapInArrow(_union, joined.schema)


def n_hit(spans: Column) -> Column:
    return F.aggregate(spans, F.lit(0).cast("long"), lambda a, x: a + x["end"] - x["first"])


_WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = []
        for text, spans in zip(batch.column("text").to_pylist(), batch.column("spans").to_pylist(), strict=True):
            if spans:
                places = [m.span() for m in _WORD.finditer(text)]
                at, left = 0, []
                for x in sorted(spans, key=lambda x: x["first"]):
                    left.append(text[at : places[x["first"]][0]])
                    at = places[x["end"] - 1][1]
                text = "".join([*left, text[at:]])
            texts.append(text)
        i = batch.schema.get_field_index("text")
        yield batch.set_column(i, batch.schema.field(i), pa.array(texts, batch.schema.field(i).type))


def decontaminate(docs: DataFrame, items: DataFrame, window: int = WINDOW, most_covered: float = MOST_COVERED) -> DataFrame:
    """docs without item passages: hit spans are cut from the texts; documents of which most_covered or more is hit are gone. Clean texts stay as they are."""
    found = find_overlaps(docs, items, window)
    left = found.filter(~((n_hit(F.col("spans")) > 0) & (n_hit(F.col("spans")) >= most_covered * F.col("n_words"))))
    return left.mapInArrow(_cut, left.schema).select(*docs.columns)
