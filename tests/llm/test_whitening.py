"""op12 against numpy's eigenvectors of the whole covariance, on the given vectors and on awkward ones."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from drawgraph.llm import whitening

ROWS = T.StructType([T.StructField("vec_id", T.LongType()), T.StructField("embedding", T.ArrayType(T.DoubleType())), T.StructField("n", T.StringType()), T.StructField("x", T.LongType())])


def brute(vectors, k=4):
    """Of each row: deviation and whitened values; and explained."""
    x = [[math.floor(256 * c) for c in v] for v in vectors]
    fit = np.array(sorted({tuple(v) for v in x}), np.float64)
    n, sums = len(fit), [sum(c) for c in zip(*{tuple(v) for v in x}, strict=True)]
    mean = np.array([s / n for s in sums])
    cov = (fit - mean).T @ (fit - mean) / n
    e, q = np.linalg.eigh(cov)
    e, q = e[::-1][:k], q[:, ::-1][:, :k]
    return n, [sum((n * c - s) ** 2 for c, s in zip(v, sums, strict=True)) for v in x], (np.array(x, np.float64) - mean) @ q / np.sqrt(np.maximum(e, 1e-300)), e / np.trace(cov)


def compare(got, ids, vectors, tolerance=1e-7):
    n, deviations, want, explained = brute(vectors)
    by = {(r.vec_id, r.component): r for r in got}
    assert len(by) == len(got) == len(ids) * want.shape[1]
    have = np.array([[by[i, c + 1].whitened for c in range(want.shape[1])] for i in ids])
    signs = np.sign((have * want).sum(axis=0))
    assert np.abs(have - want * signs).max() < tolerance
    for i, d in zip(ids, deviations, strict=True):
        for c, share in enumerate(explained):
            r = by[i, c + 1]
            assert (r.n, r.deviation) == (n, d) and abs(r.explained / share - 1) < 1e-9 and r.identity_error < 1e-9


def test_given_vectors(spark, sf_dir):
    table = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    rows = table.collect()
    compare(whitening.whiten(table).collect(), [r.vec_id for r in rows], [r.embedding for r in rows])


def test_awkward_rows(spark):
    rnd = random.Random(4)
    good = [[rnd.gauss(0, 1 + (d < 5) * (5 - d)) for d in range(40)] for _ in range(300)]
    good += [good[5]] * 150 + [[c + 1e-6 for c in good[6]]] * 3 + [[-0.0] * 40]
    rows = [(i, v, "own", 1) for i, v in enumerate(good)]
    bad = [(900, None, "b", 1), (901, [None] * 40, "b", 1), (902, [float("nan")] + [0.0] * 39, "b", 1), (903, [float("inf")] + [0.0] * 39, "b", 1), (904, [], "b", 1), (905, [1.0, 2.0], "b", 1)]
    compare(whitening.whiten(spark.createDataFrame(rows + bad, ROWS)).collect(), [r[0] for r in rows], good)
    repeated = whitening.whiten(spark.createDataFrame([*rows, rows[0], rows[0], (None, good[9], "n", 1)], ROWS))
    assert repeated.filter("vec_id = 0").count() == 12 and repeated.filter("vec_id is null").count() == 4


def test_exact_sums_of_large_entries(spark):
    vectors = [[float(2**45 * (i % 7) + i), float(-(2**44) * i), 3.0] for i in range(20)]
    got = whitening.whiten(spark.createDataFrame([(i, v, "", 1) for i, v in enumerate(vectors)], ROWS)).collect()
    n, deviations, _, _ = brute(vectors)
    assert {(r.vec_id, int(r.deviation)) for r in got} == set(enumerate(deviations)) and max(deviations) > 2**63
    assert {r.component for r in got} == {1, 2, 3} and all((r.whitened is None) == (r.component == 3) for r in got)  # two dimensions vary


def test_no_variance_and_none(spark):
    one = whitening.whiten(spark.createDataFrame([(1, [1.0, 2.0], "", 1), (2, [1.0, 2.0], "", 1)], ROWS)).collect()
    assert [(r.n, r.deviation, r.whitened, r.explained, r.identity_error) for r in one] == [(1, 0, None, None, None)] * 4
    huge = whitening.whiten(spark.createDataFrame([(1, [1e300, 0.0], "", 1), (2, [-1e300, 0.0], "", 1)], ROWS)).collect()
    assert len(huge) == 4 and {r.component for r in huge if r.whitened is None} == {2}
    assert whitening.whiten(spark.createDataFrame([], ROWS)).collect() == []
    assert whitening.whiten(spark.createDataFrame([(1, None, "", 1), (2, [None], "", 1)], ROWS)).collect() == []


@pytest.mark.parametrize("gap", [0.0, 1e-4, 0.5])
def test_filter_on_close_and_equal_eigenvalues(gap):
    rnd = np.random.default_rng(3)
    e = np.concatenate([[9, 5, 5 - gap, 2], np.linspace(1.99, 0.5, 116)])
    turn = np.linalg.qr(rnd.standard_normal((120, 120)))[0]
    v = turn * e @ turn.T
    got, q = whitening.leading(lambda y: v @ y, 120, 4)
    assert np.abs(got - e[:4]).max() < 1e-10 and np.abs(v @ q - q * got).max() < 1e-10 and np.abs(q.T @ q - np.eye(4)).max() < 1e-12


def test_plane(spark):
    """Fewer dimensions vary than the block has columns."""
    rnd = random.Random(8)
    vectors = [[a, b, a + b, *[0.0] * 60] for a, b in ((rnd.randint(-40, 40), rnd.randint(-9, 9)) for _ in range(200))]
    got = whitening.whiten(spark.createDataFrame([(i, [float(c) for c in v], "", 1) for i, v in enumerate(vectors)], ROWS))
    assert got.filter("whitened is null").select("component").distinct().orderBy("component").collect() == [(3,), (4,)]
    assert got.agg(F.max("identity_error")).first()[0] < 1e-9
