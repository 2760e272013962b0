"""Whitening of embeddings: leading components by Chebyshev-filtered subspace iteration.

A vector entry c becomes the whole number floor(256 * c). The fit list has each different vector once. Its covariance V is
never formed: a pass over the fit list takes a narrow matrix Q to V Q, every task adding up its rows' part of it, centred before they
are multiplied. A round damps the unwanted end of the spectrum by a Chebyshev polynomial of V (DEGREE passes of its three-term
recurrence, over the interval from a Lanczos bound below to the block's smallest Ritz value), then takes QR and Rayleigh-Ritz. Rounds end
when the residuals |V q - e q| of all wanted components are certified to be within CERTIFIED of the largest eigenvalue. A block that
has not come there after ROUNDS rounds is doubled; at full width Rayleigh-Ritz is exact, so rounds always end.

At scale: vectors are shuffled once, as packed whole numbers, to find the different ones; equal vectors meet in each task first, so a vector
that a third of all rows hold is one row a task. The fit list is written to the shared folder, and a pass reads it there. A pass sends sums of
dimension * block cells from each task into a further aggregate; only the dimension * block totals come to the driver. Results are written in
one more pass over the rows.

Defined results: rows go whose vector is null or holds null or non-finite entries, and those whose vector has another number of entries
than most have (ties: the greater number; empty ones always); 256 * c beyond a long stops at its ends; rows that repeat an id or a vector each get their rows;
null ids stay; fewer dimensions than components give fewer components; a component without variance (one vector, or vectors in a plane) has a null whitened,
explained is null if there is no variance at all, and identity_error leaves such components out; deviation is null from 10^38 on; an empty table gives an empty result;
other columns are not carried, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from .common import forget, settle, short_batches

#: Passes of a filter.
DEGREE = 8
#: Filters before the block is doubled.
ROUNDS = 24
#: Lanczos steps for the lower end of the spectrum.
STEPS = 8
#: Residual, as a part of the largest eigenvalue, that certifies a component.
CERTIFIED = 1e-13
#: Variance, as a part of the largest, that counts as none.
NO_VARIANCE = 1e-12
_LONG = 2.0**63


def _whole(batch: pa.RecordBatch, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of the rows that remain, and their vectors as whole numbers."""
    lists = batch.column("embedding")
    sized = lists.is_valid().to_numpy(zero_copy_only=False) & (lists.value_lengths().fill_null(-1).to_numpy(zero_copy_only=False) == dim)
    at = np.flatnonzero(sized)
    flat = lists.take(pa.array(at)).flatten()
    v = flat.cast(pa.float64()).to_numpy(zero_copy_only=False).reshape(-1, dim)  # null entries become NaN
    good = np.isfinite(v).all(axis=1)
    with np.errstate(over="ignore"):
        v = np.floor(256 * v[good])
    x = np.where(v >= _LONG, 2**63 - 1, np.where(v < -_LONG, -(2**63), np.clip(v, -_LONG, _LONG - 1024)).astype(np.int64))
    return at[good], x


def _pack(x: np.ndarray) -> list[bytes]:
    """Each vector in the narrowest of 2, 4 and 8 bytes an entry that holds it: equal vectors are equal bytes."""
    width = np.where(((x >= -(2**15)) & (x < 2**15)).all(axis=1), 2, np.where(((x >= -(2**31)) & (x < 2**31)).all(axis=1), 4, 8))
    out: list[bytes] = [b""] * len(x)
    for w in (2, 4, 8):
        for i, row in zip(np.flatnonzero(width == w).tolist(), x[width == w].astype(f"<i{w}"), strict=True):
            out[i] = row.tobytes()
    return out


def _unpack(column: pa.Array, dim: int) -> np.ndarray:
    packed = column.to_pylist()
    parts = [np.frombuffer(b"".join(p for p in packed if len(p) == w * dim), f"<i{w}").astype(np.int64).reshape(-1, dim) for w in (2, 4, 8)]
    return np.concatenate(parts)


def _packed(batches: Iterator[pa.RecordBatch], dim: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield pa.RecordBatch.from_arrays([pa.array(_pack(_whole(batch, dim)[1]), pa.binary())], ["x"])


def _sums(batches: Iterator[pa.RecordBatch], dim: int) -> Iterator[pa.RecordBatch]:
    """Per dimension the exact sum."""
    total = [0] * dim
    for batch in batches:
        x = _unpack(batch.column("x"), dim)
        if len(x) and max(-int(x.min()), int(x.max())) * len(x) >= 2**62:
            x = x.astype(object)
        total = [a + int(b) for a, b in zip(total, x.sum(axis=0), strict=True)]
    yield pa.RecordBatch.from_arrays([pa.array(range(dim), pa.int32()), pa.array([Decimal(v) for v in total], pa.decimal128(38, 0))], ["cell", "total"])


def _squares(batches: Iterator[pa.RecordBatch], mean: np.ndarray, q: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Per dimension the sum of squares, centred."""
    part = np.zeros(len(mean))
    for batch in batches:
        part += ((_unpack(batch.column("x"), len(mean)) - mean) ** 2).sum(axis=0)
    yield _cells(part)


def _product(batches: Iterator[pa.RecordBatch], mean: np.ndarray, q: np.ndarray) -> Iterator[pa.RecordBatch]:
    """The part of X^T X Q that these rows make, X centred."""
    part = np.zeros(q.shape)
    for batch in batches:
        x = _unpack(batch.column("x"), len(mean)) - mean
        part += x.T @ (x @ q)
    yield _cells(part)


def _moments(batches: Iterator[pa.RecordBatch], mean: np.ndarray, q: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Sums of products and sums of these rows' projections."""
    part = np.zeros((q.shape[1] + 1, q.shape[1]))
    for batch in batches:
        y = (_unpack(batch.column("x"), len(mean)) - mean) @ q
        part += np.vstack([y.T @ y, y.sum(axis=0)])
    yield _cells(part)


def _cells(part: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.arange(part.size, dtype=np.int32)), pa.array(part.ravel())], ["cell", "value"])


class Fit:
    """A fit list with its exact sums, and passes over it."""

    def __init__(self, vectors: DataFrame, dim: int):
        self.dim = dim
        packed = short_batches(vectors).mapInArrow(partial(_packed, dim=dim), "x binary")
        self.rows = settle(packed.distinct(), "fit")
        self.n = self.rows.count()
        sums = self.rows.mapInArrow(partial(_sums, dim=dim), "cell int, total decimal(38,0)").groupBy("cell").agg(F.sum("total").alias("total"))
        got = {r["cell"]: int(r["total"]) for r in sums.collect()}  # a row for each dimension
        self.sums = [got.get(i, 0) for i in range(dim)]
        self.mean = np.array([s / max(self.n, 1) for s in self.sums])
        self.passes = 0
        self.trace = float(self._summed(_squares, (dim,), np.zeros(0)).sum()) if self.n else 0.0

    def _summed(self, function, shape: tuple[int, ...], q: np.ndarray) -> np.ndarray:
        cells = self.rows.mapInArrow(partial(function, mean=self.mean, q=q), "cell int, value double").groupBy("cell").agg(F.sum("value").alias("value")).collect()
        out = np.zeros(int(np.prod(shape)))
        out[[c["cell"] for c in cells]] = [c["value"] for c in cells]
        self.passes += 1
        return out.reshape(shape) / self.n

    def times(self, q: np.ndarray) -> np.ndarray:
        """V Q."""
        return self._summed(_product, q.shape, q)

    def covariance(self, q: np.ndarray) -> np.ndarray:
        """The covariance of the fit list's projections on q."""
        m = self._summed(_moments, (q.shape[1] + 1, q.shape[1]), q)
        return m[:-1] - np.outer(m[-1], m[-1])


def lowest(times, dim: int, seed: int = 11) -> float:
    """A bound below the spectrum, by Lanczos steps: the smallest Ritz value less the norm of what is left; 0 at least."""
    q = np.random.default_rng(seed).standard_normal(dim)
    basis, alpha, beta = [q / np.linalg.norm(q)], [], []
    for _ in range(min(STEPS, dim)):
        w = times(basis[-1][:, None])[:, 0]
        alpha.append(float(w @ basis[-1]))
        for b in (*basis, *basis):
            w = w - (w @ b) * b
        beta.append(float(np.linalg.norm(w)))
        if beta[-1] <= 1e-9 * max(alpha):
            break
        basis.append(w / beta[-1])
    inner = beta[: len(alpha) - 1]
    return max(0.0, float(np.linalg.eigvalsh(np.diag(alpha) + np.diag(inner, 1) + np.diag(inner, -1))[0]) - beta[-1])


def filtered(times, q: np.ndarray, low: float, high: float, top: float) -> np.ndarray:
    """A Chebyshev polynomial of V of degree DEGREE times q: what lies in [low, high] shrinks against what lies above. Scaled to 1 at top."""
    centre, half = (low + high) / 2, (high - low) / 2
    scale = sigma = half / (top - centre)
    old, new = q, (times(q) - centre * q) * (sigma / half)
    for _ in range(DEGREE - 1):
        after = 1 / (2 / scale - sigma)
        old, new = new, (times(new) - centre * new) * (2 * after / half) - old * (sigma * after)
        sigma = after
    return new


def leading(times, dim: int, wanted: int, seed: int = 7) -> tuple[np.ndarray, np.ndarray]:
    """The wanted largest eigenvalues of V, falling, and their unit eigenvectors as columns; the largest entry of each is positive."""
    width = min(dim, max(6 * wanted, wanted + 12))
    q = np.eye(dim) if width == dim else np.linalg.qr(np.random.default_rng(seed).standard_normal((dim, width)))[0]
    low, rounds = None, 0
    while True:
        vq = times(q)
        e, turn = np.linalg.eigh((q.T @ vq + vq.T @ q) / 2)
        e, turn = e[::-1], turn[:, ::-1]
        q, vq = q @ turn, vq @ turn
        residual = np.linalg.norm(vq[:, :wanted] - q[:, :wanted] * e[:wanted], axis=0)
        if width == dim or e[0] <= 0 or residual.max() <= CERTIFIED * e[0]:
            break
        rounds += 1
        if rounds % ROUNDS == 0:
            width = min(dim, 2 * width)
            more = np.random.default_rng(seed + rounds).standard_normal((dim, width - q.shape[1]))
            q = np.eye(dim) if width == dim else np.linalg.qr(np.hstack([q, more]))[0]
            continue
        low = lowest(times, dim) if low is None else low
        high = float(e[-1])
        if high <= NO_VARIANCE * e[0]:  # the block holds all variance: a plain step leaves nothing else
            q = np.linalg.qr(vq)[0]
        else:
            q = np.linalg.qr(filtered(times, q, min(low, high / 2) if low >= high else low, high, float(e[0])))[0]
    e, q = np.maximum(e[:wanted], 0.0), q[:, :wanted]
    return e, q * np.sign(q[np.abs(q).argmax(axis=0), np.arange(q.shape[1])])


def _deviations(x: np.ndarray, n: int, sums: list[int]) -> pa.Array:
    """Per row the sum over dimensions of (n * x - S)^2, exact; null from 10^38 on."""
    most = n * max(-int(x.min()), int(x.max())) + max(map(abs, sums))
    number = pa.decimal128(38, 0)
    if most * most * len(sums) < 2**63:
        d = n * x - np.array(sums, np.int64)
        return pa.array((d * d).sum(axis=1)).cast(number)
    d = n * x.astype(object) - np.array(sums, object)
    return pa.array([Decimal(v) if v < 10**38 else None for v in (d * d).sum(axis=1).tolist()], number)


def _whitened(batches: Iterator[pa.RecordBatch], n: int, sums: list[int], mean: np.ndarray, q: np.ndarray, explained: list, error: float | None, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    k = q.shape[1]
    for batch in batches:
        at, x = _whole(batch, len(sums))
        if not len(at):
            continue
        each = pa.array(np.repeat(np.arange(len(at)), k))
        y = ((x - mean) @ q).ravel()
        made = {
            "vec_id": batch.column("vec_id").take(pa.array(at)).take(each),
            "component": np.tile(np.arange(1, k + 1, dtype=np.int32), len(at)),
            "n": np.full(len(y), n),
            "deviation": _deviations(x, n, sums).take(each),
            "whitened": pa.array(y, mask=np.isnan(y)),
            "explained": pa.array(explained * len(at), pa.float64()),
            "identity_error": pa.array([error] * len(y), pa.float64()),
        }
        yield pa.RecordBatch.from_arrays([pa.array(made[f.name], f.type) if isinstance(made[f.name], np.ndarray) else made[f.name] for f in schema], schema=schema)


def whiten(table: DataFrame, components: int = 4) -> DataFrame:
    """A row for each remaining row of table(vec_id, embedding) and each of the leading components: vec_id, component, n, deviation decimal(38,0), whitened, explained, identity_error."""
    rows = table.select("vec_id", F.col("embedding").cast("array<double>").alias("embedding"))
    schema = T.StructType([rows.schema["vec_id"], *T.StructType.fromDDL("component int, n long, deviation decimal(38,0), whitened double, explained double, identity_error double").fields])
    sizes = rows.groupBy(F.size("embedding").alias("dim")).count().filter("dim > 0").orderBy(F.desc("count"), F.desc("dim")).first()
    if not sizes:
        return rows.sparkSession.createDataFrame([], schema)
    fit = Fit(rows.select("embedding"), sizes["dim"])
    if not fit.n:
        return rows.sparkSession.createDataFrame([], schema)
    e, q = leading(fit.times, fit.dim, min(components, fit.dim))
    kept = e > NO_VARIANCE * e[0]
    with np.errstate(divide="ignore", invalid="ignore"):
        scaled = np.where(kept, q / np.sqrt(e), np.nan)
    error = float(np.abs(fit.covariance(scaled[:, kept]) - np.eye(kept.sum())).max()) if kept.any() else None
    explained = [float(v / fit.trace) if fit.trace else None for v in e]
    forget(fit.rows)
    return short_batches(rows).mapInArrow(partial(_whitened, n=fit.n, sums=fit.sums, mean=fit.mean, q=scaled, explained=explained, error=error, schema=to_arrow_schema(schema)), schema)
