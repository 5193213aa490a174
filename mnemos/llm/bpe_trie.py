"""BPE encoding by a trie of distinct words, and decoding.

The vocabulary file is a parameter. Supported: a tokenizers JSON with a BPE model, an end-of-word suffix, NFC, white
space and lower-case normalisers, words split by a pattern, and byte-level symbols. Edge cases: null and empty texts have
no tokens; text of any length is encoded whole, in time and memory linear in it; special strings in a text, as they are
written, are single tokens, as is the library's default, and in other case they are ordinary text; repeated rows are
encoded alike; extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import gc
import json
import unicodedata
from collections import deque
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mnemos.llm.common import by_bytes

#: Estimated bytes of chunks and encodings that a worker keeps, and pairs of tokens whose fit it remembers. Only speed
#: and memory depend on them.
KEPT_BYTES = 160 << 20
MAX_PAIRS = 600_000
#: Bytes of text whose new words go into one trie, and symbols of a word at most to be put there: the tail of a longer
#: word is walked alone, as it has nothing to share.
SLICE_BYTES = 1 << 20
TRIE_DEPTH = 64
#: Characters of a chunk at most to be kept beyond its slice.
LONG_CHUNK = 256
_ODD_SPACES = "\x1c\x1d\x1e\x1f"  # white space for str.split, but not for the tokenizer


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = iter(range(256, 512))
    return [chr(b) if b in set(plain) else chr(next(rest)) for b in range(256)]


class Vocabulary:
    """Tokens, merges and the test whether two tokens may stand side by side in an encoding."""

    def __init__(self, path: str) -> None:
        import regex

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.suffix = model.get("end_of_word_suffix") or ""
        self.ids: dict[str, int] = model["vocab"]
        self.special: dict[str, int] = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.tokens = {i: t for t, i in self.ids.items()} | {i: t for t, i in self.special.items()}
        self.decimal = {i: str(i) for i in self.tokens}
        self.raw = {i: i.to_bytes(4, "little") for i in self.tokens}
        self.rank: dict[int, int] = dict.fromkeys(self.ids.values(), -1)
        self.left: dict[int, int] = {}
        self.right: dict[int, int] = {}
        self.pair: dict[tuple[int, int], int] = {}
        for r, merge in enumerate(model["merges"]):
            a, b = merge if isinstance(merge, list) else merge.split(" ")
            x, y, z = self.ids[a], self.ids[b], self.ids[a + b]
            self.pair[x, y] = r
            if self.rank[z] < 0:
                self.rank[z], self.left[z], self.right[z] = r, x, y
        self._automaton()
        self.word = regex.compile(next(p["pattern"]["Regex"] for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split"))
        self.specials = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.space = regex.compile(r"[\x09-\x0d\x20\x85\xa0  -     　]+")
        self.symbols = byte_symbols()
        self.known: dict[int, bool] = {}

    def _automaton(self) -> None:
        """States are the prefixes of tokens. Each lists the tokens that end there, longest first: those inside words and
        those at their ends."""
        self.length: dict[int, int] = {}
        goto: list[dict[str, int]] = [{}]
        inside: dict[int, int] = {}
        ending: dict[int, int] = {}
        for t, i in self.ids.items():
            at_end = bool(self.suffix) and t.endswith(self.suffix) and len(t) > len(self.suffix)
            bare = t[: -len(self.suffix)] if at_end else t
            self.length[i] = len(bare)
            s = 0
            for c in bare:
                nxt = goto[s].get(c)
                if nxt is None:
                    nxt = goto[s][c] = len(goto)
                    goto.append({})
                s = nxt
            (ending if at_end else inside)[s] = i
        if not self.suffix:
            ending = inside
        n = len(goto)
        self.goto, self.fail = goto, [0] * n
        self.inside: list[tuple[int, ...]] = [()] * n
        self.ending: list[tuple[int, ...]] = [()] * n
        todo = deque([0])
        while todo:
            s = todo.popleft()
            for c, t in goto[s].items():
                self.fail[t] = f = self.next_state(self.fail[s], c) if s else 0
                self.inside[t] = (inside[t], *self.inside[f]) if t in inside else self.inside[f]
                self.ending[t] = (ending[t], *self.ending[f]) if t in ending else self.ending[f]
                todo.append(t)

    def next_state(self, s: int, c: str) -> int:
        """The longest prefix of a token that ends with the symbol c behind state s."""
        goto, fail = self.goto, self.fail
        while True:
            t = goto[s].get(c)
            if t is not None:
                return t
            if not s:
                return 0
            s = fail[s]

    def fits(self, a: int, b: int) -> bool:
        """Whether merging the symbols of token a and token b gives just these two tokens.

        Undoes their merges, latest first. A merge across the border that comes earlier than all undone so far (at the
        same rank, the leftmost goes first) would have been made instead.
        """
        x, y, limit, rank, pair = a, b, 1 << 60, self.rank, self.pair
        while True:
            r = pair.get((x, y))
            if r is not None and r < limit:
                out = False
                break
            if rank[x] > rank[y]:
                limit, x = rank[x], self.right[x]
            elif rank[y] >= 0:
                limit, y = rank[y] + 1, self.left[y]
            else:
                out = True
                break
        if len(self.known) > MAX_PAIRS:
            self.known.clear()
        self.known[a << 32 | b] = out
        return out


class Trie:
    """Distinct words by their prefixes. A node maps a symbol to its child; the key None holds the words that end below it
    by one symbol, which is their own."""

    def __init__(self, words: Iterable[str]) -> None:
        self.root: dict = {}
        for word in words:
            node = self.root
            for c in word[: min(len(word) - 1, TRIE_DEPTH)]:
                nxt = node.get(c)
                if nxt is None:
                    nxt = node[c] = {}
                node = nxt
            if None in node:
                node[None].append(word)
            else:
                node[None] = [word]

    def encode(self, v: Vocabulary) -> dict[str, list[int]]:
        """The ids of each word, by a depth-first walk.

        The encoding of a prefix is that of a shorter prefix and one last token: the one that fits behind the shorter
        prefix's own last token. So a node needs its last token alone, found once for all words below it.
        """
        out: dict[str, list[int]] = {}
        inside, ending, length, fits, known, goto, next_state = v.inside, v.ending, v.length, v.fits, v.known, v.goto, v.next_state
        last, states = [-1], [0]  # of the prefixes on the way down: the last token, and the automaton's state

        def walk(word: str, n: int) -> None:
            """Last tokens and states of the word's prefixes beyond n symbols, but not of the whole word."""
            del last[n + 1 :], states[n + 1 :]
            s = states[n]
            for at in range(n + 1, len(word)):
                s = next_state(s, word[at - 1])
                for t in inside[s]:
                    k = at - length[t]
                    if not k or ((ok := known.get(last[k] << 32 | t)) is None and fits(last[k], t)) or ok:
                        break
                else:
                    raise ValueError(f"no encoding of {word[:at]!r}")
                states.append(s)
                last.append(t)

        stack: list[tuple[dict, int, str]] = [(self.root, 0, "")]
        while stack:
            node, n, c = stack.pop()
            if n:
                s = goto[states[n - 1]].get(c)
                if s is None:
                    s = next_state(states[n - 1], c)
                for t in inside[s]:
                    k = n - length[t]
                    if not k:
                        break
                    ok = known.get(last[k] << 32 | t)
                    if ok or (ok is None and fits(last[k], t)):
                        break
                else:
                    raise ValueError(f"no encoding of a prefix of {n} symbols that ends in {c!r}")
                if n < len(last):
                    last[n], states[n] = t, s
                else:
                    last.append(t)
                    states.append(s)
            for key, below in node.items():
                if key is not None:
                    stack.append((below, n + 1, key))
                    continue
                for word in below:
                    size = len(word)
                    if size > n + 1:
                        walk(word, n)
                    s = next_state(states[size - 1], word[-1])
                    for t in ending[s]:
                        k = size - length[t]
                        if not k or ((ok := known.get(last[k] << 32 | t)) is None and fits(last[k], t)) or ok:
                            break
                    else:
                        raise ValueError(f"no encoding of {word!r}")
                    found, at = [t], size - length[t]
                    while at:
                        t = last[at]
                        found.append(t)
                        at -= length[t]
                    found.reverse()
                    out[word] = found
        return out


class Encoder:
    """Texts to ids, chunk by chunk: no word crosses white space, so equal chunks have equal ids wherever they stand."""

    def __init__(self, path: str, forms: tuple[str, ...] = ("decimal", "text"), most: int = KEPT_BYTES) -> None:
        self.v = Vocabulary(path)
        self.most = most
        # what is kept of a chunk: its ids in decimal, its decoded text, or its ids as little-endian 32-bit integers
        self.forms = [{"decimal": (" ", self.v.decimal), "text": (" ", self.v.tokens), "packed": (b"", self.v.raw)}[f] for f in forms]
        self.kept: list[dict] = [{} for _ in forms]
        self.older: list[dict] = [{} for _ in forms]
        self.bytes = 0
        self.table = str.maketrans({chr(b): x for b, x in enumerate(self.v.symbols)})

    def chunks(self, text: str | None) -> list:
        """Normalised chunks; a special string is one of its own, told from a chunk of the same letters by its tuple."""
        if not text:
            return []
        if self.v.specials is not None and any(s in text for s in self.v.special):
            out: list = []
            for k, part in enumerate(self.v.specials.split(text)):
                out.extend([(part,)] if k % 2 else self._chunks(part))
            return out
        return self._chunks(text)

    def _chunks(self, text: str) -> list[str]:
        if not text.isascii():
            text = unicodedata.normalize("NFC", text)
            if "Σ" in text:
                text = text.replace("Σ", "σ")  # each character is lower-cased by itself
        low = text.lower()
        for c in _ODD_SPACES:
            if c in low:
                return [x for x in self.v.space.split(low) if x]
        return low.split()

    def _word(self, w: str) -> str:
        """A word in byte-level symbols; printable ASCII stands for itself."""
        return w if w.isascii() and w.isprintable() else w.encode("utf-8", "replace").decode("latin-1").translate(self.table)

    def learn(self, chunks: set) -> None:
        """Keeps the forms of chunks not seen yet; those of their words that are new too go into one trie.

        A word is a chunk of one word, so both share the same entries. What was used since the last change of generation
        is kept; when that fills half of the bytes, it becomes the older one, and what was there and not used is dropped.
        """
        v, kept, older = self.v, self.kept, self.older
        if 2 * self.bytes > self.most:
            older[:] = kept
            kept[:] = [{} for _ in kept]
            self.bytes = 0
        new = self._kept_before(chunks)
        of = {c: v.word.findall(c) for c in new if type(c) is str}
        need = self._kept_before({w for ws in of.values() for w in ws})
        symbols = {self._word(w): w for w in need}
        found: dict = Trie(symbols).encode(v)
        found.update((c, [v.special[c[0]]]) for c in new if type(c) is not str)
        for d, (between, part) in zip(kept, self.forms):
            join, get = between.join, d.__getitem__
            for s, ids in found.items():
                d[symbols.get(s, s)] = join([part[i] for i in ids]) if len(ids) > 1 else part[ids[0]]
            for c, ws in of.items():
                if len(ws) > 1:
                    d[c] = join(map(get, ws))
                elif not ws:
                    d[c] = join(())
        self.bytes += 250 * len(kept) * len(found) + sum(map(len, found)) * 4 * len(kept) + 250 * len(of)

    def _kept_before(self, chunks: set) -> list:
        """Those that aren't kept; the others are among what was used of late afterwards."""
        first, new, back = self.older[0], [], []
        for c in chunks.difference(self.kept[0]):
            (back if c in first else new).append(c)
        for d, old in zip(self.kept, self.older):
            for c in back:
                d[c] = old[c]
        self.bytes += 300 * len(back)
        return new

    def _forget_long(self, chunks: set) -> None:
        for c in [c for c in chunks if len(c) > LONG_CHUNK]:
            for d in self.kept:
                for w in (c, *self.v.word.findall(c)):
                    d.pop(w, None)

    def encode(self, texts: list[str | None]) -> Iterator[tuple]:
        """What the encoder's forms are of each text."""
        split = [self.chunks(t) for t in texts]
        every = set().union(*split)
        gc.disable()  # the caches hold no cycles; walking them again and again is most of a collection's work
        self.learn(every)
        gc.enable()
        forms = [(between.join, d.__getitem__) for d, (between, _) in zip(self.kept, self.forms)]
        try:
            for c in split:
                yield tuple(join(map(get, c)) for join, get in forms)
        finally:
            self._forget_long(every)


_encoders: dict[tuple, Encoder] = {}


def encoder(path: str, *forms: str, most: int = KEPT_BYTES) -> Encoder:
    """One for each worker process, kept between tasks."""
    if (path, forms) not in _encoders:
        _encoders[path, forms] = Encoder(path, forms, most)
    return _encoders[path, forms]


def forget(path: str, *forms: str) -> None:
    """Gives back an encoder with all that it keeps, and Arrow's unused memory: an idle worker would hold them on."""
    _encoders.pop((path, forms), None)
    gc.collect()
    pa.default_memory_pool().release_unused()


def decode(ids: list[int], v: Vocabulary) -> str:
    """Tokens joined by spaces: what the library gives for a vocabulary file without a decoder."""
    return " ".join([v.tokens[i] for i in ids if i in v.tokens])


def encode_documents(docs: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text", keep: list[str] | None = None, arrays: bool = True, lasting: bool = True) -> DataFrame:
    """The `keep` columns (doc_id, unless given) with n_tokens, ids and decoded, in one narrow stage.

    ids is an array of int, or with arrays=False the decimal ids joined by spaces. With lasting=False a worker keeps
    nothing after its task: slower, but other work on the executor has the memory.
    """
    keep = [doc_id] if keep is None else keep
    # arrays are decoded from the ids themselves: one form less to keep
    forms = ("packed",) if arrays else ("decimal", "text")

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(path, *forms)
        for whole in batches:
            for b in by_bytes(whole, 0, SLICE_BYTES):
                made = list(e.encode(b.column(0).to_pylist()))
                ids, decoded = [x[0] for x in made], [x[-1] for x in made]
                if arrays:
                    ends = np.cumsum([0, *(len(x) // 4 for x in ids)])
                    flat = np.frombuffer(b"".join(ids), dtype="<i4")
                    out = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat))
                    counts = pa.array(np.diff(ends), pa.int64())
                    decoded = [decode(flat[a:z].tolist(), e.v) for a, z in zip(ends, ends[1:])]
                else:
                    out, counts = pa.array(ids, pa.string()), pa.array([x.count(" ") + 1 if x else 0 for x in ids], pa.int64())
                yield pa.RecordBatch.from_arrays([*b.columns[1:], counts, out, pa.array(decoded, pa.string())], names=[*(f"c{i}" for i in range(len(keep))), "n_tokens", "ids", "decoded"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from encoded(batches)
        finally:
            if not lasting:
                forget(path, *forms)

    kinds = "".join(f"c{i} {docs.schema[c].dataType.simpleString()}, " for i, c in enumerate(keep))
    out = docs.select(F.col(text).cast("string").alias("_text"), *(F.col(c).alias(f"c{i}") for i, c in enumerate(keep)))
    out = out.mapInArrow(run, f"{kinds}n_tokens bigint, ids {'array<int>' if arrays else 'string'}, decoded string")
    return out.withColumnsRenamed({f"c{i}": c for i, c in enumerate(keep)})
