"""The vectors nearest to each of a set of cues by cosine, as matrix products over batches."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from mnemos.config import EPS

#: Cues that meet so many vectors at a time; a matrix of similarities has these rows and columns.
ROWS, COLUMNS = 256, 1024
#: Matrix products differ from sums in index order by far less; what is that close is summed anew.
MARGIN = 1e-9


def by_width(vectors: pa.Array | pa.ChunkedArray) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Positions and matrix of the vectors of each width; null and empty ones are left out."""
    if isinstance(vectors, pa.ChunkedArray):
        vectors = vectors.combine_chunks()
    sizes = vectors.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    out = {}
    for width in np.unique(sizes[sizes > 0]):
        at = np.flatnonzero(sizes == width)
        flat = vectors.take(pa.array(at)).flatten().to_numpy(zero_copy_only=False).astype(np.float64)
        out[int(width)] = (at, flat.reshape(len(at), width))
    return out


def dots(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Row by row, summed in index order, as the column functions sum."""
    total = np.zeros(len(a))
    for i in range(a.shape[1]):
        total = total + a[:, i] * b[:, i]
    return total


class Nearest:
    """Keeps k rows a cue while batches pass: the greatest scores, ties by the lesser id."""

    def __init__(self, cues: dict[int, tuple[np.ndarray, np.ndarray]], k: int) -> None:
        self.k, self.blocks, self.kept, self.waiting = k, [], {}, {}
        for width, (at, x) in cues.items():
            norms = np.sqrt(dots(x, x))
            self.blocks += [(width, at[i : i + ROWS], x[i : i + ROWS], norms[i : i + ROWS]) for i in range(0, len(at), ROWS)]
        self.least = [np.full(len(b[1]), -np.inf) for b in self.blocks]

    def add(self, ids: pa.Array, vectors: pa.Array) -> None:
        for i in range(0, len(ids), COLUMNS):
            self._add(ids.slice(i, COLUMNS), vectors.slice(i, COLUMNS))

    def _add(self, ids: pa.Array, vectors: pa.Array) -> None:
        made = {w: (at, y, np.sqrt(dots(y, y))) for w, (at, y) in by_width(vectors).items()}
        for b, (width, _, x, norms) in enumerate(self.blocks):
            if width not in made:
                continue
            at, y, sizes = made[width]
            near = x @ y.T
            near /= np.maximum(np.outer(norms, sizes), EPS)
            np.copyto(near, -np.inf, where=np.isnan(near))
            least = self.least[b]
            if self.k < len(at) and not (least > -np.inf).all():
                least = np.maximum(least, np.partition(near, -self.k, axis=1)[:, -self.k])
            row, col = np.nonzero((near >= least[:, None] - MARGIN) & (near > -np.inf))
            if len(row):
                score = dots(x[row], y[col]) / np.maximum(norms[row] * sizes[col], EPS)
                self.waiting.setdefault(b, []).append((row, ids.take(pa.array(at[col])), score))
            # few pass once k are kept: they wait until there are as many as those
            if sum(len(w[0]) for w in self.waiting.get(b, ())) >= self.k * len(x) // 2 or not (self.least[b] > -np.inf).all():
                self._merge(b)

    def _merge(self, b: int) -> None:
        found = self.waiting.pop(b, [])
        if not found:
            return
        found = [*([self.kept[b]] if b in self.kept else []), *found]
        row, ids, score = np.concatenate([f[0] for f in found]), pa.concat_arrays([f[1] for f in found]), np.concatenate([f[2] for f in found])
        order_of_ids = np.unique(np.array(ids.to_pylist()), return_inverse=True)[1]
        order = np.lexsort((order_of_ids, -score, row))
        place = np.arange(len(order)) - np.searchsorted(row[order], row[order], side="left")
        last = order[place == self.k - 1]
        self.least[b][row[last]] = score[last]
        order = order[place < self.k]
        self.kept[b] = (row[order], ids.take(pa.array(order)), score[order])

    def rows(self) -> Iterator[tuple[np.ndarray, pa.Array, np.ndarray]]:
        """Positions of cues, ids and scores, a block of cues at a time."""
        for b in list(self.waiting):
            self._merge(b)
        for b, (row, ids, score) in self.kept.items():
            yield self.blocks[b][1][row], ids, score
