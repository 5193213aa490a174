"""All pairs of a cell: scores of a block of cues with a block of traces, no Spark.

Sums go in index order, as the column functions sum, so scores equal theirs to the bit. A vector that is null, holds a null
or has another width than its partner gives no score.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

from mnemos.config import EPS

#: Elements of a tile: what the loops over dimensions pass through stays in the processor's cache.
TILE = 1 << 17
LOG_2PI = math.log(2 * math.pi)


def matrix(column: pa.ChunkedArray | pa.Array, fill: float = 0.0) -> tuple[np.ndarray, np.ndarray]:
    """Rows of a list column, padded by `fill`, and their widths (-1: null)."""
    a = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    width = a.value_lengths().fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
    sizes, flat = np.maximum(width, 0), a.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    out = np.full((len(width), int(sizes.max(initial=0))), fill)
    out[np.arange(out.shape[1]) < sizes[:, None]] = flat
    return out, width


def numbers(column: pa.ChunkedArray) -> np.ndarray:
    """As doubles, nulls as NaN."""
    return column.combine_chunks().to_numpy(zero_copy_only=False).astype(np.float64)


def _wide(a: np.ndarray, width: int, fill: float = 0.0) -> np.ndarray:
    return a if a.shape[1] == width else np.pad(a, ((0, 0), (0, width - a.shape[1])), constant_values=fill)


def tiles(rows: int, columns: int) -> Iterator[slice]:
    step = max(1, TILE // max(columns, 1))
    return (slice(i, min(i + step, rows)) for i in range(0, rows, step))


class Dots:
    """Dot products of rows of x and of y."""

    def __init__(self, x: pa.ChunkedArray, y: pa.ChunkedArray) -> None:
        (self.x, self.a), (y, self.b) = matrix(x), matrix(y)
        n = max(self.x.shape[1], y.shape[1])
        self.x, self.y = _wide(self.x, n), np.ascontiguousarray(_wide(y, n).T)

    def __call__(self, at: slice) -> tuple[np.ndarray, np.ndarray]:
        """Products of the rows at `at` with all of y, and which of them exist."""
        x = self.x[at]
        total, part = np.zeros((len(x), self.y.shape[1])), np.empty((len(x), self.y.shape[1]))
        for i, y in enumerate(self.y):
            total += np.multiply(x[:, i : i + 1], y, out=part)
        return total, self.there(at)

    def there(self, at: slice) -> np.ndarray:
        """Which products of the rows at `at` exist."""
        return (self.a[at, None] == self.b) & (self.a[at, None] >= 0)

    def of(self, row: np.ndarray, col: np.ndarray) -> np.ndarray:
        """Products of single pairs, summed in index order."""
        total = np.zeros(len(row))
        for i, y in enumerate(self.y):
            total += self.x[row, i] * y[col]
        return total

    def same(self, other: Dots) -> bool:
        return all(np.array_equal(a, b) for a, b in ((self.x, other.x), (self.y, other.y), (self.a, other.a), (self.b, other.b)))


class Gaussians:
    """Log densities of rows of x under means and variances; logs are the variances' summed logarithms."""

    def __init__(self, x: pa.ChunkedArray, mu: pa.ChunkedArray, var: pa.ChunkedArray, logs: np.ndarray) -> None:
        (self.x, self.a), (mu, self.b), (var, c) = matrix(x), matrix(mu), matrix(var, 1.0)
        n = max(self.x.shape[1], mu.shape[1], var.shape[1])
        self.x, self.mu, self.var = _wide(self.x, n), np.ascontiguousarray(_wide(mu, n).T), np.ascontiguousarray(np.clip(_wide(var, n, 1.0), 1e-4, 1e4).T)
        self.b, self.logs = np.where(self.b == c, self.b, -1), logs

    def __call__(self, at: slice) -> tuple[np.ndarray, np.ndarray]:
        x = self.x[at]
        total, part = np.zeros((len(x), self.mu.shape[1])), np.empty((len(x), self.mu.shape[1]))
        for i, (mu, var) in enumerate(zip(self.mu, self.var)):
            np.subtract(x[:, i : i + 1], mu, out=part)
            np.multiply(part, part, out=part)
            np.divide(part, var, out=part)
            total += part
        total = (total + self.logs + self.a[at, None] * LOG_2PI) * -0.5
        return total, (self.a[at, None] == self.b) & (self.a[at, None] >= 0)


def order_of(ids: pa.ChunkedArray) -> np.ndarray:
    """Places of the ids in ascending order."""
    return np.unique(np.array(ids.to_pylist(), dtype=object), return_inverse=True)[1] if len(ids) else np.zeros(0, dtype=np.int64)


def best(score: np.ndarray, there: np.ndarray, place: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) of the k greatest of each row: NaN before numbers before what has no score; ties by greater place."""
    value = np.where(there, np.where(np.isnan(score), np.inf, score), -np.inf)
    row, col = np.nonzero(value >= _least(value, k)[:, None])
    return _first(row, col, value[row, col], np.where(there[row, col], np.isnan(score[row, col]), -1), place, k)


class Tops:
    """The k greatest of each row while blocks of columns pass, from scores in single precision: products of vectors of length
    1 at most, of `width` entries, and a number. What is within their error of the k-th isn't told apart here."""

    def __init__(self, rows: int, k: int, width: int) -> None:
        self.k, self.top = k, np.full((rows, k), -np.inf, dtype=np.float32)  # descending
        self.margin = 4 * float(np.finfo(np.float32).eps) * (width + 8)

    def add(self, score: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, column) of all in this block that may be among the k greatest of the blocks so far."""
        least = self.top[:, -1]
        if score.shape[1] > self.k and not np.isfinite(least).all():
            least = np.maximum(least, _least(score, self.k))
        at = np.flatnonzero(score >= self._under(least)[:, None])
        row, col = np.divmod(at, score.shape[1])
        value = score.ravel()[at]
        rows, every = np.concatenate([np.repeat(np.arange(len(self.top)), self.k), row]), np.concatenate([self.top.ravel(), value])
        order = np.lexsort((-every, rows))
        place = np.arange(len(order)) - np.searchsorted(rows[order], rows[order], side="left")
        self.top = every[order[place < self.k]].reshape(self.top.shape)
        left = value >= self._under(self.top[:, -1])[row]
        return row[left], col[left]

    def _under(self, least: np.ndarray) -> np.ndarray:
        return np.where(np.isfinite(least), least - self.margin * (1 + np.abs(least)), -np.inf).astype(np.float32)


def plain(vectors: tuple[np.ndarray, np.ndarray], norms: np.ndarray) -> bool:
    """Whether vectors (see matrix) are of one width, finite, and no shorter than 1e-4 unless zero: a cosine is then their
    product over both norms."""
    x, width = vectors
    return len(x) > 0 and bool((width == width[0]).all() and width[0] >= 0 and np.isfinite(x).all() and np.isfinite(norms).all() and ((norms == 0) | (norms >= 1e-4)).all())


def unit(x: np.ndarray, norms: np.ndarray) -> np.ndarray:
    """Vectors over their norms; zero stays."""
    return x / np.where(norms > 0, norms, 1.0)[:, None]


def _least(value: np.ndarray, k: int) -> np.ndarray:
    """The k-th greatest of each row, or what is under all of them."""
    return np.partition(value, -k, axis=1)[:, -k] if k < value.shape[1] else np.full(len(value), -np.inf, dtype=value.dtype)


def _first(row: np.ndarray, col: np.ndarray, value: np.ndarray, kind: np.ndarray, place: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    order = np.lexsort((-place[col], -value, -kind.astype(np.int64), row))
    order = order[np.arange(len(order)) - np.searchsorted(row[order], row[order], side="left") < k]
    return row[order], col[order]


def cosine(dot: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return dot / np.maximum(a[:, None] * b, EPS)
