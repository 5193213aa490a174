"""Whitening of embeddings by the leading eigenvectors of their covariance, found by FEAST contour integration.

Spark does what grows with the rows: distinct lattice vectors, exact sums, the covariance of centred vectors, the check of
the whitened covariance and the projection. What reaches the driver is d sums and d x d covariances of vectors of d
entries, whatever the rows. On that matrix FEAST solves shifted systems at the nodes of a Gauss-Legendre rule on a half
circle around an interval, which projects a block of vectors onto the interval's eigenspace; Rayleigh-Ritz extracts the
components; the signs of the pivots of shifted matrices (inertia) count the eigenvalues of the interval, so that none is
missed and none is taken twice.

Edge cases: rows whose vector is null, is empty, or holds a null or non-finite entry are dropped, and so are rows whose
length isn't the commonest (ties: the longer); an empty table, and one whose vectors are all equal, give no rows, as does a
component without variance; entries beyond the range of a long are held at its ends; a deviation beyond a long is null;
repeated rows count once in the fit and each gets its rows; a null id is kept; extra columns are ignored. Eigenvalues that
agree to 1e-9 of the largest span a plane in which the choice of axes is free; it is made once for all rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mnemos.llm.common import materialise

STEPS, COMPONENTS = 256, 4
#: FEAST: nodes of the half circle, columns beyond the count of the interval, most refinements, residual to reach.
NODES, SPARE, REFINEMENTS, RESIDUAL = 12, 6, 40, 1e-14
#: Relative width to which eigenvalues are bracketed before the contour is laid through a gap.
BRACKET = 1e-3
#: A component of less than this part of the largest eigenvalue is rounding, not variance.
NO_VARIANCE = 1e-12


@dataclass(frozen=True)
class Whitening:
    """n vectors of sums S (whole numbers), falling eigenvalues, unit eigenvectors as columns, and the trace."""

    n: int
    sums: tuple[int, ...]
    values: np.ndarray
    vectors: np.ndarray
    trace: float
    identity_error: float = 0.0

    @property
    def mean(self) -> np.ndarray:
        return np.array([float(Fraction(s, self.n)) for s in self.sums])


def lattice(rows: DataFrame, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """vec_id and x = floor(256 * entry) of the rows that can be used."""
    c = F.col(vector)
    finite = F.forall(c, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))))
    x = F.transform(c, lambda v: F.floor(v.cast("double") * float(STEPS)))
    usable = rows.where(c.isNotNull() & (F.size(c) > 0) & finite).select(F.col(vec_id).alias("vec_id"), x.alias("x"))
    width = usable.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).limit(1).first()
    return usable.where(F.size("x") == (width["d"] if width else 0))


def _matrix(column: pa.Array) -> np.ndarray:
    d = len(column.flatten()) // max(1, len(column))
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), d)


def exact_sums(fit: DataFrame) -> tuple[int, list[int]]:
    """Rows and per-dimension sums as whole numbers: each task adds the halves of 32 bits, decimals add the tasks'."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, high, low = 0, 0, 0
        for b in batches:
            if b.num_rows:
                x = _matrix(b.column(0))
                n, high, low = n + len(x), high + (x >> 32).sum(axis=0), low + (x & 0xFFFFFFFF).sum(axis=0)
        if n:
            d = len(high)
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(d, dtype=np.int32)), pa.array(np.full(d, n)), pa.array(high), pa.array(low)], names=["i", "n", "high", "low"])

    wide = lambda c: F.sum(F.col(c).cast("decimal(38,0)")).alias(c)
    parts = fit.select("x").mapInArrow(run, "i int, n bigint, high bigint, low bigint")
    found = parts.groupBy("i").agg(F.sum("n").alias("n"), wide("high"), wide("low")).orderBy("i").collect()  # d rows
    return (found[0]["n"] if found else 0), [(int(r["high"]) << 32) + int(r["low"]) for r in found]


def second_moments(fit: DataFrame, mean: np.ndarray, axes: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Sum and sum of products of the vectors, centred before they are multiplied and laid on the axes if given."""
    k = len(mean) if axes is None else axes.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, gram = np.zeros(k), np.zeros((k, k))
        for b in batches:
            if b.num_rows:
                y = _matrix(b.column(0)) - mean
                y = y if axes is None else y @ axes
                total, gram = total + y.sum(axis=0), gram + y.T @ y
        both = np.vstack([total, gram])
        i, j = np.indices(both.shape, dtype=np.int32)
        yield pa.RecordBatch.from_arrays([pa.array(i.ravel()), pa.array(j.ravel()), pa.array(both.ravel())], names=["i", "j", "v"])

    parts = fit.select("x").mapInArrow(run, "i int, j int, v double").groupBy("i", "j").agg(F.sum("v").alias("v"))
    both = np.zeros((k + 1, k))
    for r in parts.collect():  # (k + 1) * k numbers
        both[r["i"], r["j"]] = r["v"]
    return both[0], (both[1:] + both[1:].T) / 2


def above(matrix: np.ndarray, shift: float) -> int:
    """Eigenvalues greater than the shift: positive pivots of the shifted matrix, by Sylvester's law of inertia."""
    scale = np.abs(matrix).max() or 1.0
    for nudge in range(40):
        a, count = matrix - (shift + nudge * 1e-15 * scale) * np.eye(len(matrix)), 0
        for i in range(len(a)):
            if abs(a[i, i]) < 1e-14 * scale * 1e-2:
                break
            count += a[i, i] > 0
            a[i + 1 :, i + 1 :] -= np.outer(a[i + 1 :, i], a[i, i + 1 :] / a[i, i])
        else:
            return int(count)
    return int((np.linalg.eigvalsh(matrix) > shift).sum())  # every nudge met a pivot of zero


def bracket(matrix: np.ndarray, k: int, top: float) -> tuple[float, float]:
    """An interval around the k-th largest eigenvalue, by bisection over inertia counts."""
    low, high = 0.0 - 1e-9 * top, top
    while high - low > BRACKET * max(abs(high), 1e-6 * top):
        mid = (low + high) / 2
        low, high = (mid, high) if above(matrix, mid) >= k else (low, mid)
    return low, high


def feast(matrix: np.ndarray, low: float, high: float, count: int) -> tuple[np.ndarray, np.ndarray]:
    """The `count` eigenvalues in (low, high), falling, and their unit eigenvectors."""
    d, scale = len(matrix), np.linalg.norm(matrix, 2)
    at, weight = np.polynomial.legendre.leggauss(NODES)
    turn = np.exp(1j * np.pi / 2 * (1 - at))
    middle, radius = (low + high) / 2, (high - low) / 2
    block = np.random.default_rng(0).standard_normal((d, min(d, count + max(SPARE, count // 2))))
    for _ in range(REFINEMENTS):
        lifted = sum(w / 2 * (radius * t * np.linalg.solve((middle + radius * t) * np.eye(d) - matrix, block)).real for t, w in zip(turn, weight))
        basis = np.linalg.qr(lifted)[0]
        ritz, mix = np.linalg.eigh(basis.T @ matrix @ basis)
        block = basis @ mix
        inside = np.flatnonzero((ritz > low) & (ritz < high))
        if len(inside) == count and np.linalg.norm(matrix @ block[:, inside] - block[:, inside] * ritz[inside], axis=0).max() <= RESIDUAL * scale * d:
            order = inside[::-1]
            return ritz[order], block[:, order] / np.linalg.norm(block[:, order], axis=0)
    raise ArithmeticError(f"FEAST found {len(inside)} of {count} eigenvalues between {low} and {high}")


def leading(matrix: np.ndarray, k: int = COMPONENTS) -> tuple[np.ndarray, np.ndarray]:
    """Up to k leading eigenvalues and eigenvectors of a covariance, none missed.

    The contour's lower end lies in the gap below the k-th eigenvalue. Where the next ones are too near for a gap, they
    come along: the interval grows until there is one, and k of what it holds are returned.
    """
    d, top = len(matrix), float(np.abs(matrix).sum(axis=1).max())
    if top <= 0:
        return np.zeros(0), np.zeros((d, 0))
    high, want = top * (1 + 1e-9), min(k, d)
    while True:
        lower = bracket(matrix, want, high)[0]
        if want == d:
            low = -0.5 * top / d
        else:
            upper = bracket(matrix, want + 1, high)[1]
            if upper >= lower:  # no gap
                want += 1
                continue
            low = (lower + upper) / 2
        values, vectors = feast(matrix, low, high, above(matrix, low))
        real = values[:k] > NO_VARIANCE * values[0]
        return values[:k][real], vectors[:, :k][:, real]


def fit_whitening(rows: DataFrame, k: int = COMPONENTS) -> Whitening | None:
    """Fits on each distinct vector of a lattice once; None where nothing varies. Reads the distinct vectors three times."""
    fit = materialise(rows.select("x").distinct(), "whitening-fit")
    n, sums = exact_sums(fit)
    if not n:
        return None
    found = Whitening(n, tuple(sums), np.zeros(0), np.zeros((0, 0)), 0.0)
    covariance = second_moments(fit, found.mean)[1] / n
    values, vectors = leading(covariance, k)
    if not len(values):
        return None
    total, products = second_moments(fit, found.mean, vectors / np.sqrt(values))
    error = np.abs(products / n - np.outer(total, total) / n**2 - np.eye(len(values))).max()
    return Whitening(n, tuple(sums), values, vectors, float(np.trace(covariance)), float(error))


def deviations(x: np.ndarray, n: int, sums: tuple[int, ...]) -> list[int | None]:
    """Sum over dimensions of (n*x - S)^2, exact; None beyond a long. Sums of floats tell which those are."""
    rough = ((float(n) * x - np.array(sums, dtype=float)) ** 2).sum(axis=1)
    with np.errstate(over="ignore"):
        fits = np.array([s & 0xFFFFFFFFFFFFFFFF for s in sums], dtype=np.uint64).view(np.int64)
        exact = ((np.int64(n) * x - fits) ** 2).sum(axis=1)  # right modulo 2^64, and so right where the sum fits
    out: list[int | None] = exact.tolist()
    for i in np.flatnonzero(rough > 2.0**62):
        whole = sum((n * int(v) - s) ** 2 for v, s in zip(x[i], sums)) if rough[i] < 2.0**64 else 1 << 63
        out[i] = whole if whole < 1 << 63 else None
    return out


def whiten(rows: DataFrame, model: Whitening | None) -> DataFrame:
    """Each row of a lattice laid on each component, in one narrow stage."""
    kind = rows.schema["vec_id"].dataType
    schema = f"vec_id {kind.simpleString()}, component int, n bigint, deviation bigint, whitened double, explained double, identity_error double"
    if model is None:
        return rows.sparkSession.createDataFrame([], schema)
    k, axes, mean = len(model.values), model.vectors / np.sqrt(model.values), model.mean

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            x = _matrix(b.column(1))
            row = np.repeat(np.arange(len(x)), k)
            away = pa.array(deviations(x, model.n, model.sums), pa.int64())
            same = lambda v: pa.array(np.full(len(row), v))
            yield pa.RecordBatch.from_arrays(
                [b.column(0).take(pa.array(row)), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(x))), same(np.int64(model.n)), away.take(pa.array(row)), pa.array(((x - mean) @ axes).ravel()), pa.array(np.tile(model.values / model.trace, len(x))), same(model.identity_error)],
                names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
            )

    return rows.select("vec_id", "x").mapInArrow(run, schema)


def whiten_embeddings(embeddings: DataFrame, k: int = COMPONENTS, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    rows = lattice(embeddings, vec_id, vector)
    return whiten(rows, fit_whitening(rows, k))
