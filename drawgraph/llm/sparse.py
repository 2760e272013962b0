"""Sparse text features, follow-the-regularised-leader updates and bounded training samples for the classifiers."""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Callable, Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import key_of, settle

#: Slots of the feature hash; slot 0 is the constant.
SLOTS = 2**18
#: Labelled rows that a model is fitted on at most, about. Scoring and everything else covers all rows.
MOST_ROWS = 6_000


def slot_of(token: bytes) -> int:
    return 1 + zlib.crc32(token) % (SLOTS - 1)


def slots_of(counts: Counter) -> tuple[np.ndarray, np.ndarray]:
    """Distinct slots of hashed tokens, slot 0 first, and their counts (of slot 0: 1)."""
    at = np.fromiter(map(slot_of, counts), np.int64, len(counts))
    n = np.fromiter(counts.values(), np.float64, len(counts))
    slots, where = np.unique(at, return_inverse=True)
    return np.concatenate(([0], slots)), np.concatenate(([1.0], np.bincount(where, n, len(slots)) if len(slots) else []))


class Known(dict):
    """For each word the slots of its features that have a weight, mostly none; started anew when it grows large."""

    def __init__(self, weights: np.ndarray, features: Callable[[bytes], list[bytes]]):
        self.weights, self.features = weights, features

    def __missing__(self, word: bytes) -> tuple[int, ...]:
        if len(self) > 300_000:
            self.clear()
        self[word] = found = tuple(s for s in map(slot_of, self.features(word)) if self.weights[s])
        return found

    def counts(self, words: Counter) -> dict[int, int]:
        """Counts of the weighted slots of some words."""
        out: dict[int, int] = {}
        for w, n in words.items():
            for s in self[w]:
                out[s] = out.get(s, 0) + n
        return out


class Leader:
    """FTRL-proximal with per-slot rates: weights are exact zeros until their evidence exceeds l1. Slot 0 is not regularised."""

    def __init__(self, alpha: float = 0.1, beta: float = 1.0, l1: float = 1.0, l2: float = 1.0, slots: int = SLOTS):
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2
        self.z, self.n = np.zeros(slots), np.zeros(slots)

    def weights(self, slots: np.ndarray | None = None) -> np.ndarray:
        z, n = (self.z, self.n) if slots is None else (self.z[slots], self.n[slots])
        l1 = np.full(len(z), self.l1)
        if slots is None or (len(slots) and slots[0] == 0):
            l1[0] = 0.0
        return np.where(np.abs(z) <= l1, 0.0, (np.sign(z) * l1 - z) / ((self.beta + np.sqrt(n)) / self.alpha + self.l2))

    def update(self, slots: np.ndarray, gradient: np.ndarray, weights: np.ndarray) -> None:
        n = self.n[slots]
        more = n + gradient * gradient
        self.z[slots] += gradient - (np.sqrt(more) - np.sqrt(n)) / self.alpha * weights
        self.n[slots] = more


def sigmoid(x: float) -> float:
    return 1 / (1 + math.exp(-x)) if x > -500 else 0.0


def training_rows(docs: DataFrame, labels: DataFrame, label: str, most: int = MOST_ROWS) -> DataFrame:
    """(doc_id, text, y) of labelled documents that are not held out: a document is if the CRC-32 of its id as text leaves 1 when divided by 3.

    The sample is drawn by hash, first from the labels, so that few texts are read for it, then from different rows of the documents that
    they name, as many may share an id: at most about most rows in all, however often rows repeat. No other text is shuffled."""
    known = labels.select(F.col("doc_id").alias("id"), F.col(label).cast("int").alias("y")).filter(F.col("id").isNotNull() & F.col("y").isin(0, 1) & ~held_out(F.col("id")))
    known = settle(known.groupBy("id").agg(F.max("y").alias("y")), "known")
    n = known.count()
    if n > most:
        known = known.filter(F.pmod(F.xxhash64("id"), F.lit(_PARTS)) < _PARTS * most // n)
    rows = docs.select("doc_id", "text").join(F.broadcast(known), F.col("doc_id") == F.col("id")).select("doc_id", key_of(F.col("text")).alias("key"), "text", "y")
    keys = settle(rows.select("doc_id", "key").distinct(), "keys")
    n = keys.count()
    if n > most:
        rows = rows.filter(F.pmod(F.xxhash64("key", "doc_id"), F.lit(_PARTS)) < _PARTS * most // n)
    return rows.groupBy("doc_id", "key").agg(F.first("text").alias("text"), F.first("y").alias("y")).select("doc_id", "text", "y")


_PARTS = 10**15


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def _fit(batches: Iterator[pa.RecordBatch], fit: Callable[[list[bytes], np.ndarray], dict[int, float]]) -> Iterator[pa.RecordBatch]:
    rows = sorted((r for b in batches for r in zip(b.column("doc_id").to_pylist(), b.column("text").cast(pa.binary()).to_pylist(), b.column("y").to_pylist(), strict=True)), key=lambda r: (zlib.crc32(str(r[0]).encode()), r[0], r[1] or b""))
    found = fit([r[1] or b"" for r in rows], np.array([r[2] for r in rows], np.int64))
    yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.int64()), pa.array(list(found.values()), pa.float64())], ["slot", "weight"])


def fit_in_a_task(rows: DataFrame, fit: Callable[[list[bytes], np.ndarray], dict[int, float]]) -> dict[int, float]:
    """Run fit(texts, labels) on the bounded sample in one task; at most SLOTS weights come back."""
    return {r["slot"]: r["weight"] for r in rows.repartition(1).mapInArrow(partial(_fit, fit=fit), "slot long, weight double").toLocalIterator()}
