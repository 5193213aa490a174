"""Quality classifier: a linear-chain conditional random field over a document's lines.

Edge cases: null and empty texts are one empty line, whose features are all zero, and are scored like any; lines weigh
their length in characters, or equally where all are empty; repeated rows are scored alike; with no labels every score is
0.5, with labels of one kind it is near that kind; rows with a null label are not learned from; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mnemos.llm.common import by_bytes, materialise
from mnemos.llm.quality_rules import labelled_sample

OWN = 12  # features of a line; with those of its neighbours and a constant there are FEATURES
FEATURES = 3 * OWN + 1
#: Features of a long text are made for so many lines at a time; sequences are padded to so many cells at most together.
LINES_AT_ONCE = 1 << 15
CELLS_AT_ONCE = 1 << 17
_SYMBOLS = {ord(c): None for c in "#*$%&|<>"}
_SPACES = {ord(c): None for c in " \t\n\r\x0b\x0c"}


@dataclass(frozen=True)
class CrfConfig:
    """max_docs and max_lines bound what is learned from, at any scale: so many labelled documents at most, by hash, that
    together have so many lines at most. Each is learned from whole; one of more than max_lines lines isn't chosen."""

    max_docs: int = 4000
    max_lines: int = 200_000
    steps: int = 150
    rate: float = 0.15
    decay: float = 1e-4
    threshold: float = 0.7


def line_features(lines: list[str], seen: set[str] | None = None) -> np.ndarray:
    """A row for each line, from the whole line: shares and log counts, all within about 0 and 1. `seen` holds the
    document's earlier lines, where these aren't its first, and takes these."""
    out = np.zeros((len(lines), OWN))
    seen = set() if seen is None else seen
    for i, line in enumerate(lines):
        w = line.split()
        n = len(w)
        if not n:
            continue
        c = len(line)
        distinct = len(set(w))
        row = out[i]
        row[0] = min(1.0, n / 20)
        row[1] = (c - len(line.translate(_SYMBOLS))) / c * 4
        row[2] = line.count("!") / n
        row[3] = min(1.0, line.count("|") / n * 2)
        row[4] = 1 - distinct / n
        row[5] = sum(map(str.__eq__, w, w[1:])) / n if distinct < n else 0.0
        row[6] = 1.0 if line.isupper() else 0.0
        row[7] = min(1.0, c / n / 12)
        row[8] = 1.0 if line[-1] in ".!?:\"'" else 0.0
        row[9] = 1.0 if line[0].isupper() else 0.0
        row[10] = 1.0 if line in seen else 0.0
        row[11] = min(1.0, distinct / 200)
        seen.add(line)
    return out


def document_features(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """(lines, FEATURES): each line's own features, those of the lines before and behind it, and 1; and line lengths."""
    lines = (text or "").split("\n")
    return with_neighbours(line_features(lines)), np.array([len(s) for s in lines], dtype=np.float64)


def with_neighbours(own: np.ndarray) -> np.ndarray:
    x = np.zeros((len(own), FEATURES))
    x[:, :OWN] = own
    x[1:, OWN : 2 * OWN] = own[:-1]
    x[:-1, 2 * OWN : 3 * OWN] = own[1:]
    x[:, -1] = 1
    return x


@dataclass(frozen=True)
class Crf:
    """A line's log odds of being good are weights . features; moves[a, b] adds to each step from label a to b."""

    weights: np.ndarray
    moves: np.ndarray

    def marginals(self, xs: list[np.ndarray]) -> list[np.ndarray]:
        return self.from_odds([x @ self.weights for x in xs])

    def from_odds(self, odds: list[np.ndarray]) -> list[np.ndarray]:
        """P(line is good) of each sequence, from its lines' own log odds."""
        order = sorted(range(len(odds)), key=lambda i: -len(odds[i]))
        sizes = np.array([len(odds[i]) for i in order], dtype=np.int64)
        out: list[np.ndarray] = [np.empty(0)] * len(odds)
        for lo, hi in _blocks(sizes):
            padded = np.zeros((hi - lo, sizes[lo]))
            for r in range(lo, hi):
                padded[r - lo, : sizes[r]] = odds[order[r]]
            good, _, _ = _forward_backward(padded, sizes[lo:hi], self.moves)
            for r in range(lo, hi):
                out[order[r]] = good[r - lo, : sizes[r]]
        return out

    def line_odds(self, lines: list[str]) -> np.ndarray:
        """A document's lines' log odds; features are made for a block of lines at a time."""
        views = self.weights[:-1].reshape(3, OWN).T  # what a line adds to its own odds, to the next line's, to the last's
        seen: set[str] = set()
        adds = np.concatenate([line_features(lines[i : i + LINES_AT_ONCE], seen) @ views for i in range(0, len(lines), LINES_AT_ONCE)])
        odds = adds[:, 0] + self.weights[-1]
        odds[1:] += adds[:-1, 1]
        odds[:-1] += adds[1:, 2]
        return odds

    def scores(self, texts: list[str | None]) -> np.ndarray:
        odds, lengths = [], []
        for t in texts:
            lines = (t or "").split("\n")
            odds.append(self.line_odds(lines))
            lengths.append(np.fromiter(map(len, lines), dtype=np.float64, count=len(lines)))
        out = np.empty(len(texts))
        for i, (p, size) in enumerate(zip(self.from_odds(odds), lengths)):
            out[i] = (p * size).sum() / size.sum() if size.sum() else p.mean()
        return np.clip(out, 0.0, 1.0)


def _blocks(sizes: np.ndarray) -> Iterator[tuple[int, int]]:
    """Runs of sequences, longest first, that are padded together: none under half of the run's longest, and at most
    CELLS_AT_ONCE cells, so one long text costs its own length only."""
    lo = 0
    while lo < len(sizes):
        fit = min(len(sizes), lo + max(1, CELLS_AT_ONCE // max(1, int(sizes[lo]))))
        hi = lo + max(1, int(np.searchsorted(-sizes[lo:fit], -(sizes[lo] / 2), side="right")))
        yield lo, hi
        lo = hi


def _forward_backward(odds: np.ndarray, sizes: np.ndarray, moves: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """P(line is good), expected number of moves a -> b over all sequences, and log partition of each sequence.

    Both directions keep normalised messages; all sequences advance together, one line at a time.
    """
    rows, width = odds.shape
    top = np.maximum(odds, 0)
    local = np.stack([np.exp(-top), np.exp(odds - top)], axis=-1)  # of bad and good, scaled
    step = np.exp(moves)
    going = [int(np.searchsorted(-sizes, -t, side="left")) for t in range(width)]  # rows with more than t lines
    alpha = np.zeros((rows, width, 2))
    scale = np.ones((rows, width))
    for t in range(width):
        k = going[t]
        a = local[:k, t] if t == 0 else (alpha[:k, t - 1] @ step) * local[:k, t]
        scale[:k, t] = a.sum(axis=1)
        alpha[:k, t] = a / scale[:k, t, None]
    beta = np.ones((rows, width, 2))
    moved = np.zeros((2, 2))
    for t in range(width - 2, -1, -1):
        k = going[t + 1]
        ahead = local[:k, t + 1] * beta[:k, t + 1] / scale[:k, t + 1, None]
        moved += np.einsum("ra,ab,rb->ab", alpha[:k, t], step, ahead)
        beta[:k, t] = ahead @ step.T
    post = alpha * beta
    good = post[..., 1] / np.maximum(post.sum(axis=-1), 1e-300)
    inside = np.arange(width) < sizes[:, None]
    return good, moved, (np.log(np.maximum(scale, 1e-300)) * inside).sum(axis=1) + (top * inside).sum(axis=1)


def fit_crf(xs: list[np.ndarray], labels: np.ndarray, config: CrfConfig = CrfConfig()) -> Crf:
    """Maximum likelihood by Adam. A document's label stands for each of its lines; sequences weigh alike by class."""
    weights, moves = np.zeros(FEATURES), np.zeros((2, 2))
    if len(set(labels)) < 2:
        weights[-1] = 0.0 if not len(xs) else 6.0 if labels[0] else -6.0
        return Crf(weights, moves)
    order = sorted(range(len(xs)), key=lambda i: -len(xs[i]))
    sizes = np.array([len(xs[i]) for i in order])
    y = np.array([labels[i] for i in order], dtype=np.float64)
    flat = np.concatenate([xs[i] for i in order])
    at = np.repeat(np.arange(len(order)), sizes)
    col = np.concatenate([np.arange(n) for n in sizes])
    seen = np.zeros((2, 2))
    seen[0, 0], seen[1, 1] = ((sizes - 1) * (1 - y)).sum(), ((sizes - 1) * y).sum()
    n = sizes.sum()
    ends = np.concatenate([[0], np.cumsum(sizes)])
    state = [np.zeros(FEATURES + 4), np.zeros(FEATURES + 4)]
    good = np.empty(n)
    for k in range(1, config.steps + 1):
        odds, moved = flat @ weights, np.zeros((2, 2))
        for lo, hi in _blocks(sizes):
            mine = slice(ends[lo], ends[hi])
            padded = np.zeros((hi - lo, sizes[lo]))
            padded[at[mine] - lo, col[mine]] = odds[mine]
            here, m, _ = _forward_backward(padded, sizes[lo:hi], moves)
            good[mine] = here[at[mine] - lo, col[mine]]
            moved += m
        grad = np.concatenate([flat.T @ (y[at] - good), (seen - moved).ravel()]) / n - config.decay * np.concatenate([weights, moves.ravel()])
        state[0] = 0.9 * state[0] + 0.1 * grad
        state[1] = 0.99 * state[1] + 0.01 * grad**2
        change = config.rate * (state[0] / (1 - 0.9**k)) / (np.sqrt(state[1] / (1 - 0.99**k)) + 1e-8)
        weights = weights + change[:FEATURES]
        moves = moves + change[FEATURES:].reshape(2, 2)
    return Crf(weights, moves)


def train(docs: DataFrame, labels: DataFrame, config: CrfConfig = CrfConfig(), doc_id: str = "doc_id", text: str = "text") -> Crf:
    """Learns from a bounded sample of labelled rows, equal texts of one label once: features are made on the executors,
    at most max_lines x OWN numbers of 32 bits reach the driver. labels holds the rows that may be learned from."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made = [line_features((t or "").split("\n")).astype("<f4").tobytes() for t in b.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(made, pa.binary()), *b.columns[1:]], names=["x", "y", "h", "n"])

    sample = labelled_sample(docs.select(doc_id, text), labels, "quality", config.max_docs, doc_id)
    t = F.coalesce(F.col(text).cast("string"), F.lit(""))
    n = F.length(t) - F.length(F.replace(t, F.lit("\n"), F.lit(""))) + 1
    once = sample.select(t.alias("t"), F.col("quality").cast("int").alias("y"), F.xxhash64(t).alias("h"), n.cast("long").alias("n")).where(F.col("n") <= config.max_lines).dropDuplicates(["h", "y"])
    made = materialise(once.mapInArrow(run, "x binary, y int, h bigint, n bigint"), "crf-lines")
    chosen, total = [], 0
    for r in made.select("h", "y", "n").orderBy("h", "y").limit(config.max_docs).collect():
        total += r["n"]
        if total > config.max_lines:
            break
        chosen.append(r["h"])
    rows = made.where(F.col("h") <= max(chosen)).collect() if chosen else []
    rows.sort(key=lambda r: (len(r["x"]), bytes(r["x"]), r["y"]))  # the same model whatever the order of rows
    xs = [with_neighbours(np.frombuffer(r["x"], dtype="<f4").reshape(-1, OWN).astype(np.float64)) for r in rows]
    return fit_crf(xs, np.array([r["y"] for r in rows]), config)


def score_documents(docs: DataFrame, model: Crf, doc_id: str = "doc_id", text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The `keep` columns (doc_id, unless given) and score, the length-weighted share of good lines; one narrow stage."""
    keep = [doc_id] if keep is None else keep

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in by_bytes(whole, 0, 4 << 20):
                yield pa.RecordBatch.from_arrays([*b.columns[1:], pa.array(model.scores(b.column(0).to_pylist()))], names=[*(f"c{i}" for i in range(len(keep))), "score"])

    kinds = "".join(f"c{i} {docs.schema[c].dataType.simpleString()}, " for i, c in enumerate(keep))
    out = docs.select(F.col(text).cast("string").alias("_text"), *(F.col(c).alias(f"c{i}") for i, c in enumerate(keep)))
    return out.mapInArrow(run, f"{kinds}score double").withColumnsRenamed({f"c{i}": c for i, c in enumerate(keep)})
