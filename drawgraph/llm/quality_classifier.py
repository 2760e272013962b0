"""A quality classifier: logistic regression on hashed word n-grams, trained with follow-the-regularised-leader steps.

Tokens stand between spaces, and each line end is one. Features are n-grams of one to WORDS lower-cased
words, n-grams of one to SHAPES neighbouring tokens' shapes (signs as they are; runs of letters and digits
by case and length), which tell texts apart whose words were never seen, and a mark for each line that
repeats an earlier one. Counts meet in hashed slots; their roots are scaled to length one, and a score is the
logistic of one sparse dot product.

Fitted on a bounded sample of labelled rows that are not held out; every row is scored, whole and in its
place, without a shuffle; a batch of texts is hashed as arrays. Defined results: null and empty texts get
the score of the constant; labels other than 0 and 1 are ignored, and of several for one id the largest
counts; without any label all scores are 0.5; repeated rows are scored alike and count once in training; an
empty table gives an empty result; further columns pass through, those named like the operator's own are
replaced.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from .common import short_batches
from .sparse import MOST_ROWS, Leader, fit_in_a_task, held_out, training_rows

EPOCHS = 6
#: Longest n-grams of words and of shapes.
WORDS, SHAPES = 3, 3
#: Slots of the feature hash; slot 0 is the constant.
SLOTS = 2**20
#: Bytes of text that are hashed together.
LOT = 1 << 20

_RUN = re.compile(rb"[0-9A-Za-z\x80-\xff]+|[^0-9A-Za-z\x80-\xff]+")
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_SIGNS = bytes(b for b in range(128) if not bytes([b]).isalnum())


def word_of(token: bytes) -> bytes:
    """The token in lower case without the signs around it; of signs alone, the token."""
    return token.strip(_SIGNS).translate(_LOWER) or token


def shape_of(token: bytes) -> bytes:
    out = []
    for run in _RUN.findall(token):
        if not (run[0] >= 0x80 or run[:1].isalnum()):
            out.append(run)
            continue
        case = b"U" if len(run) > 1 and run == run.upper() and run != run.lower() else b"C" if run[:1].isupper() else b"d" if run.isdigit() else b"l"
        out.append(case + (b"1" if len(run) < 4 else b"2" if len(run) < 9 else b"3"))
    return b"".join(out)


class _Tokens(dict):
    """For each token 40 bits of its word's hash and 24 of its shape's; started anew when it grows large."""

    def __missing__(self, token: bytes) -> int:
        if len(self) > 300_000:
            self.clear()
        self[token] = found = (xxhash.xxh64_intdigest(word_of(token)) >> 24 << 24) | (xxhash.xxh64_intdigest(shape_of(token)) >> 40)
        return found


_tokens = _Tokens()


def _joined(h: np.ndarray, more: np.ndarray) -> np.ndarray:
    h = (h ^ (more + np.uint64(0x9E3779B97F4A7C15))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(31))


def slots_of(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The text and the slot of every feature, and for each text how many features it has and how many of its lines repeat earlier ones."""
    parts, again = [], []
    for text in texts:
        tokens = text.replace(b"\n", b" \0 ").split()
        parts.append(np.fromiter(map(_tokens.__getitem__, tokens), np.uint64, len(tokens)))
        lines = [x for x in text.split(b"\n") if x.strip()]
        again.append(len(lines) - len(set(lines)))
    doc = np.repeat(np.arange(len(texts)), [len(p) for p in parts])
    token = np.concatenate(parts) if parts else np.empty(0, np.uint64)
    docs, slots = [], []
    for first, most, tag in ((token >> np.uint64(24), WORDS, 1), (token & np.uint64(2**24 - 1), SHAPES, 2)):
        for n in range(1, most + 1):
            here = len(token) - n + 1
            if here <= 0:
                break
            h = np.full(here, tag * 16 + n, np.uint64)
            for k in range(n):
                h = _joined(h, first[k : k + here])
            whole = doc[:here] == doc[n - 1 :]
            docs.append(doc[:here][whole])
            slots.append((h[whole] % np.uint64(SLOTS - 2)).astype(np.int64) + 2)
    again = np.array(again, np.int64)
    docs.append(np.repeat(np.arange(len(texts)), again))
    slots.append(np.ones(again.sum(), np.int64))  # slot 1: repeated lines
    docs_, slots_ = np.concatenate(docs), np.concatenate(slots)
    return docs_, slots_, np.bincount(docs_, minlength=len(texts)), again


def _vectors(texts: list[bytes]) -> list[tuple[np.ndarray, np.ndarray]]:
    """Distinct slots, the constant's first, and values of each text."""
    out = []
    for text in texts:
        _, slots, size, _ = slots_of([text])
        at, n = np.unique(slots, return_counts=True)
        out.append((np.concatenate(([0], at)).astype(np.int32), np.concatenate(([1.0], np.sqrt(n) / np.sqrt(max(1, size[0])))).astype(np.float32)))
    return out


def fit(texts: list[bytes], good: np.ndarray) -> dict[int, float]:
    rows = _vectors(texts)
    leader = Leader(alpha=0.5, l1=0.05, l2=0.1, slots=SLOTS)
    for _ in range(EPOCHS):
        for (slots, x), y in zip(rows, good, strict=True):
            w = leader.weights(slots)
            leader.update(slots, (1 / (1 + np.exp(-min(max(float(w @ x), -500.0), 500.0))) - y) * x, w)
    weights = leader.weights()
    return {int(i): float(weights[i]) for i in np.flatnonzero(weights)}


def scores(texts: list[bytes], weights: np.ndarray) -> np.ndarray:
    """A vector of roots of counts has the root of their sum for its length, so only slots with a weight are looked at further."""
    doc, slots, sizes, _ = slots_of(texts)
    some = np.flatnonzero(weights[slots])
    at, n = np.unique(doc[some] * SLOTS + slots[some], return_counts=True)
    sums = np.bincount(at // SLOTS, weights[at % SLOTS] * np.sqrt(n), minlength=len(texts)) if len(at) else np.zeros(len(texts))
    return 1 / (1 + np.exp(-np.clip(weights[0] + sums / np.sqrt(np.maximum(1, sizes)), -500, 500)))


def _lots(texts: list[bytes]) -> Iterator[list[bytes]]:
    held: list[bytes] = []
    size = 0
    for text in texts:
        if held and size + len(text) > LOT:
            yield held
            held, size = [], 0
        held.append(text)
        size += len(text)
    if held:
        yield held


def _score(batches: Iterator[pa.RecordBatch], model, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    weights = np.zeros(SLOTS)
    weights[list(model.value)] = list(model.value.values())
    for batch in batches:
        texts = [x.as_py() or b"" for x in batch.column("text").cast(pa.binary())]
        found = np.concatenate([scores(lot, weights) for lot in _lots(texts)]) if texts else np.empty(0)
        yield pa.RecordBatch.from_arrays([pa.array(found, f.type) if f.name == "score" else batch.column(f.name) for f in schema], schema=schema)


def fitted(docs: DataFrame, labels: DataFrame, most: int = MOST_ROWS) -> dict[int, float]:
    """Weights by slot."""
    return fit_in_a_task(training_rows(docs, labels, "quality", most), fit)


def score_quality(docs: DataFrame, labels: DataFrame, most: int = MOST_ROWS) -> DataFrame:
    """docs(doc_id, text, ...) without text, with held_out, score (chance of label 1) and predicted."""
    model = docs.sparkSession.sparkContext.broadcast(fitted(docs, labels, most))  # as many weights as slots at most
    schema = T.StructType([f for f in docs.schema.fields if f.name not in ("text", "score", "held_out", "predicted")] + [T.StructField("score", T.DoubleType())])
    scored = short_batches(docs).mapInArrow(partial(_score, model=model, schema=to_arrow_schema(schema)), schema)
    return scored.withColumn("held_out", held_out(F.col("doc_id"))).withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
