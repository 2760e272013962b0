"""Toxicity by cumulative-link ordinal regression on hashed words and word beginnings.

Grades run from 0 (none) to GRADES - 1. P(grade <= k) is the logistic of threshold k less w.x: the weights
are shared by all thresholds, which keep their order. x holds log(1 + count) of hashed words and of
their beginnings, by which inflected and compound forms share evidence. Weights take
follow-the-regularised-leader steps, so that words without evidence stay at zero.

Labels only tell toxic from not toxic. The grade of a toxic training text follows from the sample itself:
words and beginnings found in at least LEAST_TEXTS toxic texts, and there at least LEAST_RATE of the times
they are found at all, are marks; few, several or many words with a mark make grades 1 to 3.

Fitted on a bounded sample of labelled rows that are not held out; every row is scored, in its place,
without a shuffle. Defined results: null, empty and wordless texts get the constant's severity; labels
other than 0 and 1 are ignored, and of several for one id the largest counts; without any label severity
is that of even thresholds; repeated rows are scored alike and count once in training; an empty table gives an empty result; further
columns pass through, those named like the operator's own are replaced.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from .common import WORD_BYTES, short_batches
from .sparse import MOST_ROWS, SLOTS, Known, Leader, fit_in_a_task, sigmoid, slot_of, slots_of, training_rows

GRADES = 4
#: Marks from which a toxic text has grade 2, and 3.
STEPS = (3, 6)
LEAST_TEXTS, LEAST_RATE = 8, 0.7
#: Passes over the sample at least and at most, and the updates that a small sample is passed over for.
EPOCHS, UPDATES = (4, 40), 20_000
#: Rate of the thresholds, least gap between them.
RATE, GAP = 0.02, 0.25
#: Chance of a grade above 0 from which a document counts as toxic.
CUT = 0.35

_THRESHOLD = -1  # slots -1, -2, ... of a model hold its thresholds


#: Lengths of word beginnings, in bytes.
BEGINNINGS = (4, 5, 6, 7)


def _parts(word: bytes) -> list[bytes]:
    return [word, *[word[:k] + b"-" for k in BEGINNINGS if k <= len(word)]]


def _words(text: bytes) -> Counter:
    return Counter(text.translate(WORD_BYTES).split())


def _features(words: Counter) -> Counter:
    found: Counter = Counter()
    for w, n in words.items():
        for part in _parts(w):
            found[part] += n
    return found


def grades(texts: list[bytes], toxic: np.ndarray) -> np.ndarray:
    """Grades of training texts. Words are known by their slots here, so what is held does not grow with the vocabulary."""
    seen, bad = np.zeros(SLOTS, np.int64), np.zeros(SLOTS, np.int64)
    for text, y in zip(texts, toxic, strict=True):
        slots, _ = slots_of(_features(_words(text)))
        seen[slots[1:]] += 1
        if y:
            bad[slots[1:]] += 1
    marks = set(np.flatnonzero((bad >= LEAST_TEXTS) & (bad >= LEAST_RATE * seen)).tolist())
    found = np.array([sum(n for w, n in _words(text).items() if any(slot_of(p) in marks for p in _parts(w))) if y and marks else 0 for text, y in zip(texts, toxic, strict=True)], np.int64)
    return np.where(toxic == 1, 1 + sum((found >= s).astype(np.int64) for s in STEPS), 0)


def fit(texts: list[bytes], toxic: np.ndarray) -> dict[int, float]:
    y = grades(texts, toxic) if len(texts) else toxic
    rows = []
    for t in texts:
        slots, n = slots_of(_features(_words(t)))
        rows.append((slots[1:].astype(np.int32), np.log1p(n[1:]).astype(np.float32)))
    leader = Leader(alpha=0.3, l1=5.0, l2=1.0)
    theta = np.arange(GRADES - 1, dtype=np.float64)
    for _ in range(min(max(EPOCHS[0], UPDATES // max(1, len(rows))), EPOCHS[1])):
        for (slots, x), grade in zip(rows, y, strict=True):
            w = leader.weights(slots) if len(slots) else np.empty(0)
            s = float(w @ x)
            above = sigmoid(theta[grade] - s) if grade < GRADES - 1 else 1.0
            below = sigmoid(theta[grade - 1] - s) if grade else 0.0
            mass = max(above - below, 1e-9)
            leader.update(slots, (1 - above - below) * x, w)
            if grade < GRADES - 1:
                theta[grade] += RATE * above * (1 - above) / mass
            if grade:
                theta[grade - 1] -= RATE * below * (1 - below) / mass
            for k in range(1, GRADES - 1):
                theta[k] = max(theta[k], theta[k - 1] + GAP)
    weights = leader.weights()
    weights[0] = 0.0
    return {int(i): float(weights[i]) for i in np.flatnonzero(weights)} | {_THRESHOLD - k: float(t) for k, t in enumerate(theta)}


def _score(batches: Iterator[pa.RecordBatch], model, schema: pa.Schema, cut: float) -> Iterator[pa.RecordBatch]:
    known = model.value
    theta = [known.get(_THRESHOLD - k, float(k)) for k in range(GRADES - 1)]
    weights = np.zeros(SLOTS)
    for slot, w in known.items():
        if slot > 0:
            weights[slot] = w
    weighted = Known(weights, _parts)
    for batch in batches:
        made: dict[str, list] = {"severity": [], "p_toxic": [], "grade": [], "toxic": []}
        for text in batch.column("text").cast(pa.binary()):
            s = math.fsum(weights[slot] * math.log1p(n) for slot, n in weighted.counts(_words(text.as_py() or b"")).items())
            beyond = [1 - sigmoid(t - s) for t in theta]
            made["severity"].append(sum(beyond))
            made["p_toxic"].append(beyond[0])
            made["grade"].append(sum(b >= 0.5 for b in beyond))
            made["toxic"].append(beyond[0] >= cut)
        yield pa.RecordBatch.from_arrays([pa.array(made[f.name], f.type) if f.name in made else batch.column(f.name) for f in schema], schema=schema)


def fitted(docs: DataFrame, labels: DataFrame, most: int = MOST_ROWS) -> dict[int, float]:
    """Weights by slot, and thresholds by slots below 0."""
    return fit_in_a_task(training_rows(docs, labels, "toxic", most), fit)


def score_toxicity(docs: DataFrame, labels: DataFrame, most: int = MOST_ROWS, cut: float = CUT, keep_text: bool = False) -> DataFrame:
    """docs(doc_id, text, ...) with severity (the expected grade), p_toxic (chance of a grade above 0), grade (the median) and toxic."""
    model = docs.sparkSession.sparkContext.broadcast(fitted(docs, labels, most))  # SLOTS weights at most
    own = [T.StructField("severity", T.DoubleType()), T.StructField("p_toxic", T.DoubleType()), T.StructField("grade", T.IntegerType()), T.StructField("toxic", T.BooleanType())]
    schema = T.StructType([f for f in docs.schema.fields if f.name not in {x.name for x in own} and (keep_text or f.name != "text")] + own)
    return short_batches(docs).mapInArrow(partial(_score, model=model, schema=to_arrow_schema(schema), cut=cut), schema)


def drop_toxic(docs: DataFrame, labels: DataFrame, most: int = MOST_ROWS, cut: float = CUT) -> DataFrame:
    """docs without the documents that count as toxic."""
    return score_toxicity(docs, labels, most, cut, keep_text=True).filter("not toxic").select(*docs.columns)
