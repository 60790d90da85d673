"""Whitening against exact fractions and by what it has to give."""

from fractions import Fraction

import numpy as np
import pytest

from dossier.llm import whitening as w
from dossier.llm.queries import QUERIES


def fractions(vectors):
    """n, sums and the exact covariance of the distinct vectors."""
    fit = sorted(set(map(tuple, vectors)))
    n, width = len(fit), len(fit[0])
    sums = [sum(v[i] for v in fit) for i in range(width)]
    mean = [Fraction(s, n) for s in sums]
    cov = [[sum((v[i] - mean[i]) * (v[j] - mean[j]) for v in fit) / n for j in range(width)] for i in range(width)]
    return n, sums, cov


def vectors_of(rows, name="embedding"):
    return [(r.vec_id, [int(np.floor(256 * np.float64(c))) for c in r[name]]) for r in rows if r[name] is not None and all(c is not None and np.isfinite(c) for c in r[name])]


def test_query_equals_exact_sums(spark, sf_dir):
    given = vectors_of(spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect())
    fit = np.array(sorted(set(tuple(x) for _, x in given)), object)
    n, sums = len(fit), fit.sum(0)
    d = n * fit - sums
    cov = np.array([[v / n**3 for v in row] for row in (d.T @ d).tolist()])
    values = np.linalg.eigvalsh(cov)[::-1]
    got = QUERIES["op12_whitened_embeddings"](spark, sf_dir).toPandas()
    assert len(got) == 4 * len(given) and set(got.n) == {n} and got.identity_error.nunique() == 1 and got.identity_error.max() < 1e-9
    by_id = dict(given)
    assert all(r.deviation == sum(int(v) ** 2 for v in n * np.array(by_id[r.vec_id], object) - sums) for r in got.itertuples())
    for c, own in got.groupby("component"):
        assert np.allclose(own.explained, values[c - 1] / np.trace(cov), rtol=1e-9)
        x = np.array([by_id[k] for k in own.vec_id], float) - (sums / n).astype(float)
        # What is whitened is a projection on a unit vector that the covariance only stretches.
        along = np.linalg.lstsq(x, own.whitened.to_numpy() * np.sqrt(values[c - 1]), rcond=None)[0]
        assert abs(np.linalg.norm(along) - 1) < 1e-6 and np.allclose(cov @ along, values[c - 1] * along, atol=1e-6 * values[0])


def test_covariance_is_exact_with_wide_entries(spark):
    """Entries so far from zero that squares of doubles would lose all digits."""
    rng = np.random.default_rng(3)
    rows = [(k, [float(v) for v in (2.0**24 + rng.integers(0, 4, 3)) / 256]) for k in range(40)]
    frame = spark.createDataFrame(rows * 2, "vec_id long, embedding array<double>")
    whitening, fit = w.fit_whitening(w.whole_vectors(frame), 3)
    n, sums, cov = fractions([[int(np.floor(256 * c)) for c in v] for _, v in rows])
    assert (whitening.n, whitening.sums.tolist()) == (n, sums) and fit.count() == n
    squares = w.square_sums(fit, n, whitening.sums)
    for i in range(3):
        assert Fraction(squares[i, i], n**3) == cov[i][i]
        for j in range(i + 1, 3):
            assert Fraction(squares[i, j] - squares[i, i] - squares[j, j], 2 * n**3) == cov[i][j]
    assert w.identity_error(fit, whitening) < 1e-9


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [0.5, 1.0], 7), (1, [0.5, 1.0], 7), (None, [1.0, -2.0], 7), (2, None, 7), (3, [nan, 1.0], 7), (4, [1.0, inf], 7), (5, [None, 1.0], 7), (6, [-0.001, 0.001], 7), (7, [-0.002, 0.002], 7)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>, component int")
    got = w.whitened_vectors(frame).collect()
    assert sorted((str(r.vec_id), r.component) for r in got) == sorted((k, c) for k in ("1", "1", "None", "6", "7") for c in (1, 2))
    assert {r.n for r in got} == {3} and all(r.whitened is not None for r in got)
    same = w.whitened_vectors(frame.filter("vec_id = 1")).collect()  # one vector: nothing varies
    assert [(r.n, r.whitened, r.explained, r.deviation) for r in same] == [(1, None, None, 0)] * 4
    assert w.whitened_vectors(frame.filter("vec_id = 2")).count() == 0
    assert w.whitened_vectors(frame.limit(0)).count() == 0
    assert w.whitened_vectors(spark.createDataFrame([(1, [])], "vec_id long, embedding array<double>")).count() == 0
    line = spark.createDataFrame([(k, [float(k), 2.0 * k]) for k in range(9)], "vec_id long, embedding array<double>")
    got = w.whitened_vectors(line).collect()  # the second component has no variance
    assert {r.component for r in got if r.whitened is None} == {2} and {r.identity_error < 1e-9 for r in got} == {True}
    with pytest.raises(ValueError):
        w.whitened_vectors(spark.createDataFrame([(1, [1.0]), (2, [1.0, 2.0])], "vec_id long, embedding array<double>"))
