"""Token-ID output: best-fit-decreasing packing of documents into rows of a fixed number of ids.

Edge cases: null and empty texts have no tokens and no segment, and are listed in no row; a document longer than a row is
cut into whole rows and a remainder, losing nothing; repeated documents are packed each; a null id is kept; extra columns
are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mnemos.llm.common import by_bytes

ROW_TOKENS = 2048
#: Tokens packed together by a task; what it holds in memory is bounded by this, not by its partition.
WINDOW_TOKENS = 4 << 20
Segment = tuple[object, int, np.ndarray]  # doc_id, offset of its first token in the document, ids


class Capacities:
    """Segment tree over free capacities 0..top: finds the least capacity in use that is at least n, in O(log top)."""

    def __init__(self, top: int) -> None:
        self.leaves = 1 << top.bit_length()
        self.count = [0] * (2 * self.leaves)

    def add(self, capacity: int, change: int) -> None:
        i = capacity + self.leaves
        while i:
            self.count[i] += change
            i >>= 1

    def least_from(self, n: int) -> int:
        """-1 if no capacity in use is large enough."""
        i = n + self.leaves
        if self.count[i]:
            return n
        while i > 1:
            if not i & 1 and self.count[i + 1]:
                i += 1
                while i < self.leaves:
                    i = 2 * i if self.count[2 * i] else 2 * i + 1
                return i - self.leaves
            i >>= 1
        return -1


def best_fit_decreasing(lengths: list[int], row: int) -> list[list[int]]:
    """Rows of indexes: longest first, each into the fullest row that still holds it, else a new one. Ties go by index."""
    tree, rows, by_free = Capacities(row), [], {}
    for i in sorted(range(len(lengths)), key=lambda i: (-lengths[i], i)):
        free = tree.least_from(lengths[i])
        if free < 0:
            rows.append([])
            at, free = len(rows) - 1, row
        else:
            at = by_free[free].pop()
            tree.add(free, -1)
        rows[at].append(i)
        free -= lengths[i]
        if free:
            by_free.setdefault(free, []).append(at)
            tree.add(free, 1)
    return rows


def split_long(doc_id: object, ids: np.ndarray, row: int) -> list[Segment]:
    return [(doc_id, k, ids[k : k + row]) for k in range(0, len(ids), row)]


_encodings: dict[tuple[str, str], object] = {}


def encoding(path: str, pattern: str):
    """The ranks of a .tiktoken file behind the pattern that splits text, once for each worker process."""
    import base64

    import tiktoken

    if (path, pattern) not in _encodings:
        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _encodings[path, pattern] = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    return _encodings[path, pattern]


SCHEMA = "pack_id bigint, doc_ids array<{}>, starts array<bigint>, cu_seqlens array<int>, n_tokens int, input_ids binary, position_ids binary"


def _rows(segments: list[Segment], row: int, pad: int, first: int, id_type: pa.DataType) -> pa.RecordBatch:
    packs = best_fit_decreasing([len(s[2]) for s in segments], row)
    ids = np.full((len(packs), row), pad, dtype="<u2")
    positions = np.zeros((len(packs), row), dtype="<u2")
    docs, starts, cuts = [], [], []
    for r, pack in enumerate(packs):
        at, cu = 0, [0]
        for i in pack:
            n = len(segments[i][2])
            ids[r, at : at + n] = segments[i][2]
            positions[r, at : at + n] = np.arange(n)  # starts anew at each segment
            at += n
            cu.append(at)
        docs.append([segments[i][0] for i in pack])
        starts.append([segments[i][1] for i in pack])
        cuts.append(cu)
    return pa.RecordBatch.from_arrays(
        [pa.array(range(first, first + len(packs)), pa.int64()), pa.array(docs, pa.list_(id_type)), pa.array(starts, pa.list_(pa.int64())), pa.array(cuts, pa.list_(pa.int32())), pa.array([c[-1] for c in cuts], pa.int32()), pa.array([x.tobytes() for x in ids], pa.binary()), pa.array([x.tobytes() for x in positions], pa.binary())],
        names=[f.split()[0] for f in SCHEMA.split(", ")],
    )


def pack_documents(docs: DataFrame, path: str, pattern: str, pad_id: int, row: int = ROW_TOKENS, window: int = WINDOW_TOKENS, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Packed rows of the texts' ids (byte-level BPE by ranks; special strings are ordinary text): input_ids and position_ids are rows of little-endian uint16 matrices, padded with pad_id and 0.

    Segment j of a row is input_ids[cu_seqlens[j]:cu_seqlens[j + 1]] and holds the tokens of doc_ids[j] from starts[j].
    Each task encodes and packs its own documents, window by window, so nothing is shuffled; only the last row of few
    segments in a window can be poorly filled. pack_id is unique and stable for a given partitioning of the input.
    """
    if not 0 < row <= 1 << 16:
        raise ValueError("a row holds 1 to 65536 tokens: positions have 16 bits")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        e, first = encoding(path, pattern), TaskContext.get().partitionId() << 33
        if e.n_vocab > 1 << 16:
            raise ValueError("ids have 16 bits here")
        held: list[Segment] = []
        size = 0
        for whole in batches:
            id_type = whole.schema.field(0).type
            for b in by_bytes(whole, 1, 2 << 20):
                for d, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                    ids = e.encode_to_numpy(t, disallowed_special=()).astype("<u2") if t else np.empty(0, dtype="<u2")
                    held.extend(split_long(d, ids, row))
                    size += len(ids)
                    if size >= window:
                        out = _rows(held, row, pad_id, first, id_type)
                        first += out.num_rows
                        held, size = [], 0
                        yield from (out.slice(k, 512) for k in range(0, out.num_rows, 512))
        if held:
            out = _rows(held, row, pad_id, first, id_type)
            yield from (out.slice(k, 512) for k in range(0, out.num_rows, 512))

    kind = docs.schema[doc_id].dataType.simpleString()
    return docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(run, SCHEMA.format(kind))


def write_packed(packed: DataFrame, path: str) -> None:
    """Parquet files whose binary columns are matrix rows; read_matrix turns them back."""
    packed.write.parquet(path)


def read_matrix(batch: pa.RecordBatch | pa.Table, column: str, row: int = ROW_TOKENS) -> np.ndarray:
    return np.frombuffer(b"".join(batch.column(column).to_pylist()), dtype="<u2").reshape(-1, row)
