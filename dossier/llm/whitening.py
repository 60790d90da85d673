"""Whitening of embeddings by their principal components, with a covariance by polarisation.

Only squares are summed: of each dimension and of the sum of each two dimensions, all centred and in whole numbers.
cov(i, j) is half of var(i + j) - var(i) - var(j), so every entry is exact up to its one rounding to double.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dossier.llm.common import cut, spread

#: Entries are kept in steps of 1 / SCALE.
SCALE = 256
COMPONENTS = 4
#: Centred entries have two limbs, so that the squares of BLOCK rows add up within 64 bits.
_LIMB, _BLOCK = 26, 512
#: Bits of a centred entry, at most.
_BITS = 2 * _LIMB - 1

_SQUARES = "i int, j int, hh decimal(38,0), hl decimal(38,0), ll decimal(38,0)"
_WHITE = "vec_id long, component int, deviation decimal(38,0), whitened double"


@dataclass(frozen=True)
class Whitening:
    """n distinct vectors with sums of their dimensions; components as columns, their variances, and the total.

    A component without variance, as all have when there is one vector, whitens nothing.
    """

    n: int
    sums: np.ndarray
    components: np.ndarray
    variances: np.ndarray
    total: float

    @property
    def usable(self) -> np.ndarray:
        most = self.variances.max(initial=0.0)
        return self.variances > len(self.sums) * np.finfo(float).eps * most

    def deviations(self, x: np.ndarray) -> np.ndarray:
        """n * x - sums, of rows of whole vectors."""
        return self.n * x - self.sums

    def __call__(self, x: np.ndarray) -> np.ndarray:
        """Whitened rows; NaN in components without variance."""
        scale = np.where(self.usable, np.sqrt(np.maximum(self.variances, 0)), np.nan)
        return (self.deviations(x) / self.n) @ self.components / scale


def whole_vectors(vectors: DataFrame, column: str = "embedding", scale: int = SCALE) -> DataFrame:
    """vec_id and x, floor(scale * entry) of each entry. Rows whose vector is null or has a null or non-finite entry go."""

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, lists = batch.column(0), batch.column(1)
            flat = lists.flatten()
            values = flat.to_numpy(zero_copy_only=False).astype(float)  # null entries are NaN
            sizes = np.diff(lists.offsets.to_numpy()) * np.asarray(lists.is_valid())
            owner = np.repeat(np.arange(len(sizes)), sizes)
            bad = np.bincount(owner[~np.isfinite(values)], minlength=len(sizes)) > 0
            kept = ~bad & np.asarray(lists.is_valid())
            scaled = np.floor(scale * values[kept[owner]])
            if len(scaled) and np.abs(scaled).max() >= 1 << _BITS:
                raise ValueError("entries are too large for exact sums")
            offsets = np.append(0, np.cumsum(sizes[kept])).astype(np.int32)
            yield pa.RecordBatch.from_arrays([ids.filter(pa.array(kept)), pa.ListArray.from_arrays(offsets, pa.array(scaled.astype(np.int64)))], names=["vec_id", "x"])

    return vectors.select(F.col("vec_id").cast("long"), F.col(column).cast("array<double>").alias("x")).mapInArrow(whole, "vec_id long, x array<long>")


def _matrix(lists: pa.Array, n: int) -> np.ndarray:
    return lists.flatten().to_numpy(zero_copy_only=False).reshape(-1, n)


def square_sums(fit: DataFrame, n: int, sums: np.ndarray) -> dict[tuple[int, int], int]:
    """Sums of (n x - sums)^2 over rows of fit (x): key (i, i) of dimension i, and (i, j) of the sum of i and j.

    A task hands on one row for each key, so what is shuffled follows dimensions and tasks, not vectors.
    """
    width = len(sums)
    keys = [(i, j) for i in range(width) for j in range(i, width)]

    def squares(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals = np.zeros((3, len(keys)), object)
        for batch in batches:
            rows = n * _matrix(batch.column(0), width) - sums
            for start in range(0, len(rows), _BLOCK):
                d = rows[start : start + _BLOCK]
                at = 0
                for i in range(width):
                    s = d[:, i:].copy()
                    s[:, 1:] += d[:, i : i + 1]
                    high, low = s >> _LIMB, s & ((1 << _LIMB) - 1)
                    for k, (a, b) in enumerate(((high, high), (high, low), (low, low))):
                        totals[k, at : at + width - i] += np.einsum("rj,rj->j", a, b).astype(object)
                    at += width - i
        i, j = zip(*keys, strict=True)
        parts = [pa.array([Decimal(int(v)) for v in row], pa.decimal128(38, 0)) for row in totals]
        yield pa.RecordBatch.from_arrays([pa.array(i, pa.int32()), pa.array(j, pa.int32()), *parts], names=["i", "j", "hh", "hl", "ll"])

    summed = fit.select("x").mapInArrow(squares, _SQUARES).groupBy("i", "j").agg(*(F.sum(c).alias(c) for c in ("hh", "hl", "ll")))
    return {(r.i, r.j): (int(r.hh) << 2 * _LIMB) + (int(r.hl) << _LIMB + 1) + int(r.ll) for r in summed.collect()}


def fit_whitening(whole: DataFrame, components: int = COMPONENTS) -> tuple[Whitening | None, DataFrame]:
    """The whitening of the distinct vectors of whole (x), and these; None where there are none, or none with entries.

    Distinct vectors are written to the shared folder; a vector that many rows have is one row of each task's before the
    shuffle. The driver gets a number for each two dimensions. Vectors of different lengths raise ValueError.
    """
    fit = cut(whole.select("x").distinct(), "whitening-fit")
    n, least, most = fit.agg(F.count("*"), F.min(F.size("x")), F.max(F.size("x"))).first()
    if not n or not most:
        return None, fit
    if least != most:
        raise ValueError(f"vectors have {least} to {most} entries")
    entry = [F.col("x")[i] for i in range(most)]
    found = fit.agg(F.greatest(*(F.max(F.abs(e)) for e in entry), F.lit(0)).alias("largest"), *(F.sum(e.cast("decimal(38,0)")).alias(f"s{i}") for i, e in enumerate(entry))).first()
    if 2 * n * found.largest >= 1 << _BITS:
        raise ValueError("entries are too large for exact sums")
    sums = np.array([int(found[f"s{i}"]) for i in range(most)], np.int64)
    squares = square_sums(fit, n, sums)
    v = np.zeros((most, most))
    for (i, j), total in squares.items():
        v[i, j] = v[j, i] = total / n**3 if i == j else (total - squares[i, i] - squares[j, j]) / (2 * n**3)
    values, vectors = np.linalg.eigh(v)
    order = np.argsort(-values, kind="stable")[:components]
    return Whitening(n, sums, vectors[:, order].copy(), values[order], sum(squares[i, i] for i in range(most)) / n**3), fit


def identity_error(fit: DataFrame, whitening: Whitening) -> float:
    """The largest entry of the whitened fit list's covariance minus the identity, over components with variance."""
    used = np.flatnonzero(whitening.usable)
    if not len(used):
        return 0.0
    keys = [(a, b) for a in range(len(used)) for b in range(-1, a + 1)]  # b = -1: the sum of a itself

    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals = np.zeros(len(keys))
        for batch in batches:
            w = whitening(_matrix(batch.column(0), len(whitening.sums)))[:, used]
            totals += [w[:, a].sum() if b < 0 else w[:, a] @ w[:, b] for a, b in keys]
        a, b = zip(*keys, strict=True)
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int32()), pa.array(b, pa.int32()), pa.array(totals)], names=["a", "b", "total"])

    mean = {(r.a, r.b): r.total / whitening.n for r in fit.select("x").mapInArrow(moments, "a int, b int, total double").groupBy("a", "b").agg(F.sum("total").alias("total")).collect()}
    return max(abs(mean[a, b] - mean[a, -1] * mean[b, -1] - (a == b)) for a, b in keys if b >= 0)


def whiten(whole: DataFrame, whitening: Whitening) -> DataFrame:
    """vec_id, component (from 1), deviation and whitened, a row per row of whole (vec_id, x) and component.

    deviation: the sum of (n x - sums)^2. whitened is null in a component without variance.
    """
    count = len(whitening.variances)

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch.column(1), len(whitening.sums))
            d = whitening.deviations(x)
            small = not len(d) or int(np.abs(d).max()) ** 2 * d.shape[1] < 1 << 63
            squares = pa.array((d * d).sum(1)) if small else pa.array([Decimal(sum(v * v for v in row)) for row in d.tolist()], pa.decimal128(38, 0))
            again = np.repeat(np.arange(len(x)), count)
            w = whitening(x).ravel()
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).take(pa.array(again)),
                    pa.array(np.tile(np.arange(1, count + 1, dtype=np.int32), len(x))),
                    squares.cast(pa.decimal128(38, 0)).take(pa.array(again)),
                    pa.array(w, mask=np.isnan(w)),
                ],
                names=["vec_id", "component", "deviation", "whitened"],
            )

    return whole.select("vec_id", "x").mapInArrow(project, _WHITE)


def whitened_vectors(vectors: DataFrame, column: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """Every row of vectors (vec_id and column) on the first components: those of whiten(), with n, explained, the
    component's share of the variance, and identity_error of the fit list.

    Null vectors and those with null or non-finite entries go; without any other, or where vectors have no entries,
    there are no rows. Repeated rows stay, and count once in the fit; other columns are ignored. Where nothing varies
    at all, explained is null. Vectors of different lengths, and entries too large for exact sums (n times twice the
    largest entry in steps reaches 2^51), raise ValueError.
    """
    spark = vectors.sparkSession
    whole = whole_vectors(vectors, column)
    whitening, fit = fit_whitening(whole, components)
    if whitening is None:
        return spark.createDataFrame([], _WHITE + ", n long, explained double, identity_error double")
    shares = whitening.variances / whitening.total if whitening.total > 0 else [None] * len(whitening.variances)
    share = F.get(F.array(*(F.lit(None if s is None else float(s)).cast("double") for s in shares)), F.col("component") - 1)
    error = identity_error(fit, whitening)
    return whiten(whole, whitening).withColumns({"n": F.lit(whitening.n).cast("long"), "explained": share, "identity_error": F.lit(float(error))})


def op12_whitened_embeddings(spark, sf_dir: str) -> DataFrame:
    """Every embedding on the first four components of the distinct ones; a deviation beyond 64 bits is null."""
    found = whitened_vectors(spread(spark.read.parquet(f"{sf_dir}/embeddings.parquet")))
    return found.select("vec_id", "component", "n", F.col("deviation").try_cast("long").alias("deviation"), "whitened", "explained", "identity_error")
