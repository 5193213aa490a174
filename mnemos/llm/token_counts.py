"""Token counts: batch encoding inside Arrow functions that returns lengths only.

Edge cases: null and empty texts have no tokens; special strings in a text are single tokens, as is the library's
default; a long text of no white space is one piece; repeated rows count alike; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mnemos.llm.common import by_bytes

#: Bytes of pieces in one call to the library.
BATCH_BYTES = 1 << 18
#: Lengths that a worker keeps; beyond that it starts anew. Only speed depends on it.
MAX_KEPT = 1_000_000
_UNSAFE = 1 << 40


class Counter:
    """Counts tokens of whole texts from the lengths of their pieces.

    A text is cut before each space that follows anything but white space: there no pattern of the pre-tokenizer and no
    special string goes on, so the pieces' lengths add up. A piece that ends in white space (two spaces in a row, say)
    isn't cut there: its text is cut in longer, safe pieces. Equal pieces are encoded once.
    """

    def __init__(self, path: str) -> None:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        self.known: dict[str, int] = {}

    def lengths(self, pieces: list[str]) -> list[int]:
        """In batches of about as many bytes each."""
        out: list[int] = []
        batch: list[str] = []
        size = 0
        for p in pieces:
            batch.append(p)
            size += len(p) + 16
            if size >= BATCH_BYTES:
                out.extend(len(x) for x in self.library.encode_batch_fast(batch, add_special_tokens=False))
                batch, size = [], 0
        if batch:
            out.extend(len(x) for x in self.library.encode_batch_fast(batch, add_special_tokens=False))
        return out

    def learn(self, pieces: set[str]) -> None:
        if len(self.known) > MAX_KEPT:
            self.known = {}
        new = pieces - self.known.keys()
        # "word." is " word" and one token more: the full stop or comma at a piece's end stands alone after a letter
        stem = {p: p[:-1] for p in new if len(p) > 2 and p[-1] in ".," and p[-2].isascii() and p[-2].isalpha()}
        whole = list({stem.get(p, p) for p in new} - self.known.keys())
        for p, n in zip(whole, self.lengths([" " + p for p in whole])):
            self.known[p] = _UNSAFE if p == "" or p[-1].isspace() else n
        for p, s in stem.items():
            self.known[p] = self.known[s] + 1

    def count(self, texts: list[str | None]) -> list[int]:
        split = [t.split(" ") if t else [] for t in texts]
        heads = [c[0] if c else "" for c in split]  # the first piece has no space before it
        self.learn(set().union(*(c[1:] for c in split)))
        get = self.known.__getitem__
        out = [n + sum(map(get, c[1:])) for n, c in zip(self.lengths(heads), split)]
        for i, n in enumerate(out):
            if n >= _UNSAFE or heads[i] and heads[i][-1].isspace():
                out[i] = sum(self.lengths(safe_pieces(texts[i])))
        return out


def safe_pieces(text: str, least: int = 1 << 14) -> list[str]:
    """Cuts of at least `least` characters, each before white space that follows anything else."""
    out, start, n = [], 0, len(text)
    while start < n:
        at = start + least
        while at < n and not (text[at].isspace() and not text[at - 1].isspace()):
            at += 1
        out.append(text[start:at])
        start = at
    return out


_counters: dict[str, Counter] = {}


def count_tokens(docs: DataFrame, path: str, limit: int = 1024, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit (n_tokens > limit) of each whole text, in one narrow stage."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if path not in _counters:
            _counters[path] = Counter(path)
        for whole in batches:
            for b in by_bytes(whole, 1):
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(_counters[path].count(b.column(1).to_pylist()), pa.int64()), pa.compute.cast(pa.compute.fill_null(pa.compute.binary_length(b.column(1)), 0), pa.int64())], names=["doc_id", "n_tokens", "n_bytes"])

    kind = docs.schema[doc_id].dataType.simpleString()
    out = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(run, f"doc_id {kind}, n_tokens bigint, n_bytes bigint")
    return out.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
