"""Similarity self-join of texts by the Jaccard coefficient of their word n-grams, with prefix trees.

Each distinct text becomes the set of its shingles' hashes. Shingles have one global order: by the number of texts that have
them (rare first, in bounded tables), then by hash. Two sets of the similarity share a shingle among their rarest (the prefix), so texts that
share one form a group; texts that share none with any other text leave here. Inside a group the sets stand in a trie whose
order is common shingles first: a query walks down once for all sets below a node, carrying the overlap so far, and leaves
a subtree when even all that is left of it and of the query would not reach the similarity.

Groups of any size are dealt in blocks of bounded sets. First each text meets a block of its largest group and that group's
hubs, so that a crowd of copies is one component after work linear in its size. Then only groups in which texts of several
components are left are joined whole: the texts outside of the group's largest component meet all of the group, block by
block; pairs within a component change nothing and are passed over. So components are exact, and no pair is left out.

Edge cases: null, empty and blank texts have an empty set and link with nothing, copies included; fewer words than a shingle
are one shingle; equal texts have one key of 128 bits; repeated rows and ids stay; a null id is never the least of a
component that has others; texts of any length are taken whole; extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mnemos.llm.common import by_bytes, materialise, small_batches
from mnemos.llm.components import connected_components
from mnemos.llm.simhash import shingle_set

#: Words of a shingle; similarity OVER / UNDER at least, so that whole numbers decide.
WORDS, OVER, UNDER = 5, 4, 5
#: Bits of a shingle's hash in a set, and buckets of levels (a byte each) at most: levels order, they decide nothing.
TOKEN_BITS, LEVEL_BITS = 48, 24
#: Sets of a block, and hubs of a group.
BLOCK, HUBS = 256, 4
#: Shingles that are sorted at a time in a task.
SLICE = 1 << 21
#: A sieve takes 2^SIEVE_BITS / 8 bytes (16 MB) at most.
SIEVE_BITS = 27


def text_key(text: Column) -> Column:
    """Equal texts have equal keys of 128 bits (null counts as empty)."""
    return F.unhex(F.md5(F.coalesce(text.cast("string"), F.lit(""))))


def pack(tokens: np.ndarray) -> bytes:
    """Ascending numbers of 48 bits, 6 bytes each."""
    return tokens.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6].tobytes()


def unpack(flat: np.ndarray) -> np.ndarray:
    """Bytes of packed numbers as int64."""
    out = np.zeros((len(flat) // 6, 8), dtype=np.uint8)
    out[:, :6] = flat.reshape(-1, 6)
    return out.reshape(-1).view("<i8")


def token_slices(column: pa.BinaryArray) -> Iterator[np.ndarray]:
    """The sets of a column, one after the other."""
    at = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1] if len(column) else [0]
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)
    for s, e in zip(at[:-1], at[1:]):
        yield unpack(data[s:e])


def reaches(both: int, a: int, b: int) -> bool:
    """both / (a + b - both) >= OVER / UNDER."""
    return (OVER + UNDER) * both >= OVER * (a + b)


def prefix(n: int) -> int:
    """How many of its rarest shingles a set of n must show to share one with any partner."""
    return n - (OVER * n + UNDER - 1) // UNDER + 1


class Trie:
    """Sets in one order as a radix tree, in arrays by level: each node has a run of shingles and a range of sets."""

    def __init__(self, sets: list[np.ndarray], roots: list[int]) -> None:
        sizes = np.array([len(s) for s in sets])
        _, inverse, counts = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
        rank = np.empty(len(counts), dtype=np.int64)
        rank[np.lexsort((np.arange(len(counts)), -counts))] = np.arange(len(counts))
        self.shared = int((counts > 1).sum())  # what a single set has can't meet: it counts in sizes only
        codes = [c[: np.searchsorted(c, self.shared)] for c in (np.sort(rank[c]) for c in np.split(inverse, np.cumsum(sizes)[:-1]))]
        self.order = sorted(range(len(sets)), key=lambda i: codes[i].astype(">i4").tobytes())
        self.codes, self.sizes, self.roots = [codes[i] for i in self.order], sizes[self.order], np.array(roots, dtype=np.int64)[self.order]
        self._grow()

    def _grow(self) -> None:
        codes, count = self.codes, len(self.codes)
        lcp = [0] * count
        for i in range(1, count):
            m = min(len(codes[i - 1]), len(codes[i]))
            apart = np.flatnonzero(codes[i - 1][:m] != codes[i][:m])
            lcp[i] = int(apart[0]) if len(apart) else m
        low, high, leaf, ends, runs, kids = [], [], [], [], [], []

        def children(a: int, b: int, depth: int) -> tuple[int, int]:
            """Nodes of the sets a..b that agree on `depth` shingles: sets that end there, then runs up to the next fork."""
            first = len(low)
            cuts = []
            for i in range(a, b):
                if len(codes[i]) == depth:
                    node = (i, i + 1, i, codes[i][:0], depth)
                    for to, v in zip((low, high, leaf, runs, ends), node):
                        to.append(v)
                elif not cuts or lcp[i] <= depth:
                    cuts.append(i)
            for x, y in zip(cuts, [*cuts[1:], b]):
                end = len(codes[x]) if y - x == 1 else min(lcp[x + 1 : y])
                for to, v in zip((low, high, leaf, runs, ends), (x, y, x if y - x == 1 else -1, codes[x][depth:end], end)):
                    to.append(v)
            return first, len(low)

        self.top, k = children(0, count, 0), 0
        while k < len(low):
            kids.append(children(low[k], high[k], ends[k]) if leaf[k] < 0 else (0, 0))
            k += 1
        lengths, sizes, roots = np.array([len(c) for c in codes]), self.sizes, self.roots
        self.leaf, self.high = np.array(leaf), np.array(high)
        self.kids, self.many = np.array(kids)[:, 0], np.array(kids)[:, 1] - np.array(kids)[:, 0]
        self.flat = np.concatenate(runs)
        self.end = np.cumsum([len(r) for r in runs])
        self.start = self.end - [len(r) for r in runs]
        self.last = np.array([r[-1] if len(r) else self.shared for r in runs])
        below = lambda f, of: np.array([f(of[a:b]) for a, b in zip(low, high)])
        self.rest = below(np.max, lengths) - np.array(ends)
        self.least, self.most = below(np.min, sizes), below(np.max, sizes)
        self.root_least, self.root_most = below(np.min, roots), below(np.max, roots)

    def partners(self, x: int) -> np.ndarray:
        """The later sets, in the trie's order and of other roots, that are similar to set x."""
        code, n, root = self.codes[x], int(self.sizes[x]), self.roots[x]
        own = np.zeros(self.shared + 1, dtype=bool)
        own[code] = True
        met = np.concatenate([[0], np.cumsum(own[self.flat])])
        node = np.arange(*self.top)
        overlap = np.zeros(len(node), dtype=np.int64)
        found = []
        while len(node):
            overlap = overlap + met[self.end[node]] - met[self.start[node]]
            left = len(code) - np.searchsorted(code, self.last[node], side="right")
            best = overlap + np.minimum(self.rest[node], left)
            # even all that is left on both sides doesn't reach the similarity; or other sizes, earlier sets, x's own root
            open_ = (OVER + UNDER) * best >= OVER * (n + self.least[node])
            open_ &= (UNDER * n >= OVER * self.least[node]) & (UNDER * self.most[node] >= OVER * n) & (self.high[node] > x + 1)
            open_ &= (self.root_least[node] != root) | (self.root_most[node] != root)
            node, overlap = node[open_], overlap[open_]
            done = self.leaf[node] >= 0
            sets = self.leaf[node[done]]
            found.append(sets[(sets > x) & ((OVER + UNDER) * overlap[done] >= OVER * (n + self.sizes[sets]))])
            node, overlap = node[~done], overlap[~done]
            many = self.many[node]
            first = np.repeat(self.kids[node] - (np.cumsum(many) - many), many)
            node, overlap = first + np.arange(many.sum()), np.repeat(overlap, many)
        return np.concatenate(found) if found else np.zeros(0, dtype=np.int64)


def joined(sets: list[np.ndarray], roots: list[int]) -> list[tuple[int, int]]:
    """Links (positions) whose components, with those of equal roots, are those of all similar pairs."""
    if len(set(roots)) < 2:
        return []
    trie = Trie(sets, roots)
    head = list(range(len(sets)))

    def find(i: int) -> int:
        while head[i] != i:
            head[i] = head[head[i]]
            i = head[i]
        return i

    first: dict[int, int] = {}
    for i, r in enumerate(trie.roots.tolist()):
        head[i] = find(first.setdefault(r, i))
    parts, out = len(first), []
    for x in range(len(sets)):
        for y in trie.partners(x).tolist():
            a, b = find(x), find(y)
            if a != b:
                head[b], parts = a, parts - 1
                out.append((trie.order[x], trie.order[y]))
        if parts == 1:
            break
    return out


def sieve(hashes: DataFrame) -> np.ndarray:
    """Packed bits of the hashes in the only column, 16 or more a hash up to SIEVE_BITS in all, joined by slice.

    What it lets through is met by an exact join later, so its size decides what moves, never what comes out.
    """
    bits = 1 << max(16, min(SIEVE_BITS, (16 * hashes.count()).bit_length()))
    part = min(bits, 1 << 18)

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(bits, dtype=bool)
        for b in batches:
            seen[b.column(0).to_numpy() & (bits - 1)] = True
        for k, own in enumerate(seen.reshape(-1, part)):
            if own.any():
                yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([np.packbits(own, bitorder="little").tobytes()])], names=["part", "bits"])

    def join(table: pa.Table) -> pa.Table:
        total = np.zeros(part // 8, dtype=np.uint8)
        for x in table["bits"].to_pylist():
            total |= np.frombuffer(x, np.uint8)
        return pa.table({"part": table["part"][:1], "bits": pa.array([total.tobytes()])})

    out = np.zeros(bits // 8, dtype=np.uint8)
    for r in hashes.mapInArrow(mark, "part int, bits binary").groupBy("part").applyInArrow(join, "part int, bits binary").collect():  # bits / 8 bytes in all
        out[r["part"] * part // 8 :][: part // 8] = np.frombuffer(r["bits"], np.uint8)
    return out


def passes(bits: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    at = hashes & (len(bits) * 8 - 1)
    return (bits[at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(bool)


def shingle_sets(docs: DataFrame, words: int = WORDS, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """node (a number), key, n and tokens (packed, ascending) of each distinct text with a shingle, written once. Shingles are
    told apart by 48 bits of their hash from here on; n is counted at 64.

    Texts don't move: the row of the least id stands for its text, found by a sieve over (key, id). Where ids repeat, or
    the sieve is full, equal texts are several nodes, which are similar like any others.
    """
    keyed = docs.select(text_key(F.col(text)).alias("key"), F.col(doc_id).alias("_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    name = F.xxhash64("key", F.coalesce(F.col("_id").cast("string"), F.lit("")))
    firsts = docs.sparkSession.sparkContext.broadcast(sieve(keyed.groupBy("key").agg(F.min("_id").alias("_id")).select(name)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in by_bytes(whole, 1, 2 << 20):
                b = b.filter(pa.array(passes(firsts.value, b.column(2).to_numpy())))
                sets = [shingle_set(t, words) for t in b.column(1).to_pylist()]
                tokens = pa.array([pack(np.unique(s & np.uint64((1 << TOKEN_BITS) - 1))) for s in sets], pa.binary())
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array([len(s) for s in sets], pa.int32()), tokens], names=["key", "n", "tokens"])

    sets = keyed.select("key", "text", name.alias("name")).mapInArrow(run, "key binary, n int, tokens binary")
    with small_batches(docs.sparkSession):
        return materialise(sets.where("n > 0").withColumn("node", F.monotonically_increasing_id()), "ngram-sets")


def gaps(at: np.ndarray) -> np.ndarray:
    """Ascending places as bytes: the distance from the place before less one, 255 standing for 255 that are passed over."""
    step = np.diff(at, prepend=-1) - 1
    skips = step // 255
    out = np.full(len(at) + int(skips.sum()), 255, dtype=np.uint8)
    out[np.arange(len(at)) + np.cumsum(skips)] = step % 255
    return out


def ungap(gap: np.ndarray) -> np.ndarray:
    return (np.cumsum(np.where(gap < 255, gap.astype(np.int64) + 1, 255)) - 1)[gap < 255]


@dataclass(frozen=True)
class Order:
    """What is known of the shingles that several sets have: a bit for each bucket of the leading bits that holds one, and
    the highest level there (eight steps for each doubling of the number of sets), in buckets of their own."""

    bits: np.ndarray
    level: np.ndarray

    def levels(self, tokens: np.ndarray) -> np.ndarray:
        """Level of each shingle, 0: it is in one set of all."""
        at = tokens >> (TOKEN_BITS - (len(self.bits) * 8).bit_length() + 1)
        there = self.bits[at >> 3] >> (at & 7).astype(np.uint8) & 1
        return np.where(there, self.level[tokens >> (TOKEN_BITS - len(self.level).bit_length() + 1)], 0)


def dealt(sets: Iterable[np.ndarray], width: int, parts: int) -> Iterator[pa.RecordBatch]:
    """(part, low) for each slice of shingles and part by their leading bits: the next bits up to `width`, ascending, as
    distances of four bytes, all first bytes first."""

    def put(held: list[np.ndarray]) -> pa.RecordBatch:
        tokens = np.sort(np.concatenate(held) >> (TOKEN_BITS - width))
        cuts = np.searchsorted(tokens, np.arange(parts + 1) << (width - parts.bit_length() + 1))
        full = np.flatnonzero(np.diff(cuts))
        low = [np.diff(tokens[cuts[k] : cuts[k + 1]], prepend=int(k) << (width - parts.bit_length() + 1)).astype("<u4") for k in full]
        return pa.RecordBatch.from_arrays([pa.array(full.astype(np.int32)), pa.array([x.view(np.uint8).reshape(-1, 4).T.tobytes() for x in low], pa.binary())], names=["part", "low"])

    held, size = [], 0
    for tokens in sets:
        held.append(tokens)
        size += len(tokens)
        if size >= SLICE:
            yield put(held)
            held, size = [], 0
    if size:
        yield put(held)


def undealt(low: bytes) -> np.ndarray:
    """A part's bits of dealt shingles."""
    return np.cumsum(np.ascontiguousarray(np.frombuffer(low, np.uint8).reshape(4, -1).T).view("<u4").reshape(-1), dtype=np.int64)


def shared_shingles(sets: DataFrame, total: int, order: Order | None = None) -> Order:
    """The order of `total` shingles at most: of all of each set, or, with an order, of its prefix.

    Each shingle moves once, as 3 bytes or so, to the part of its leading bits, where equal ones are counted; parts grow in
    number with the input. Shingles are told apart by 8 bits more than their number takes, so some of a single set count
    as shared: that and the bounded tables decide what moves later, never what comes out.
    """
    size = max(total, 1).bit_length()
    width, parts = min(TOKEN_BITS, max(32, size + 8)), 1 << max(6, size - 20)
    bits, levels = 1 << max(20, min(SIEVE_BITS, size + 3)), parts if order else 1 << max(20, min(LEVEL_BITS, size))
    known = None if order is None else sets.sparkSession.sparkContext.broadcast(order)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        each = (tokens for b in batches for tokens in token_slices(b.column(0)))
        yield from dealt(each if known is None else (rarest(tokens, known.value)[0] for tokens in each), width, parts)

    def count(table: pa.Table) -> pa.Table:
        part, low = table["part"][0].as_py(), width - parts.bit_length() + 1
        token, n = np.unique(np.concatenate([undealt(x) for x in table["low"].to_pylist()]), return_counts=True)
        token, n = token[n > 1], n[n > 1]
        own, level = np.zeros(bits // parts, dtype=bool), np.zeros(levels // parts, dtype=np.uint8)
        at = lambda slots: token * slots >> low
        own[at(len(own))] = True
        np.maximum.at(level, at(len(level)), np.minimum(8 * np.log2(n), 255).astype(np.uint8))
        return pa.table({"part": pa.array([part], pa.int32()), "bits": [np.packbits(own, bitorder="little").tobytes()], "level": [level.tobytes()]})

    out = Order(np.zeros(bits // 8, dtype=np.uint8), np.zeros(levels, dtype=np.uint8))
    counted = sets.select("tokens").mapInArrow(deal, "part int, low binary").groupBy("part").applyInArrow(count, "part int, bits binary, level binary")
    for r in counted.collect():  # bits / 8 + levels bytes in all
        for table, name in ((out.bits, "bits"), (out.level, "level")):
            piece = len(table) // parts
            table[r["part"] * piece :][:piece] = np.frombuffer(r[name], np.uint8)
    return out


def rarest(tokens: np.ndarray, order: Order) -> tuple[np.ndarray, np.ndarray]:
    """Shingles of a set's prefix that other sets have too, rare first, and their places in the set's order."""
    levels = order.levels(tokens)
    first = np.argsort(levels, kind="stable")[: prefix(len(tokens))]
    there = np.flatnonzero(levels[first] > 0)
    return tokens[first[there]], there


def prefix_records(sets: DataFrame, order: Order, met: Order) -> DataFrame:
    """(token, node, n, cap) for each prefix shingle of each set that several prefixes have (met); cap: how large a partner
    may be that it meets there first, with all that follows in common."""
    known = sets.sparkSession.sparkContext.broadcast((order, met.bits))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        order, bits = known.value
        found = Order(bits, np.ones(2, dtype=np.uint8))
        for b in batches:
            held, of, caps = [], [], []
            for i, tokens in enumerate(token_slices(b.column(1))):
                rare, place = rarest(tokens, order)
                there = found.levels(rare) > 0
                held.append(rare[there])
                caps.append((UNDER * len(tokens) - (OVER + UNDER) * place[there]) // OVER)
                of.append(np.full(len(held[-1]), i))
            if held:
                row = pa.array(np.concatenate(of))
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(held)), b.column(0).take(row), b.column(2).take(row), pa.array(np.concatenate(caps).astype(np.int32))], names=["token", "node", "n", "cap"])

    return sets.select("node", "tokens", "n").mapInArrow(run, "token bigint, node bigint, n int, cap int")


def _groups(records: DataFrame) -> DataFrame:
    """(token, node, size) of groups in which each text has one that it can meet there by sizes and places.

    A group is a shingle and a band of sizes: partners' sizes are within 5/4, and so in one band of 1.26 or in neighbours;
    each text stands in its own band and the next. Equal tokens stand for equal groups. Joins are merges at every size, so
    that what moves doesn't jump where a broadcast no longer fits.
    """
    band = F.floor(F.log("n") / float(np.log(1.26)))
    banded = records.select(F.explode(F.array(F.xxhash64("token", band), F.xxhash64("token", band + 1))).alias("token"), "node", "n", "cap")
    for _ in range(2):
        known = banded.groupBy("token").agg(F.count(F.lit(1)).alias("size"), F.min("n").alias("lo"), F.max("cap").alias("hi")).where("size > 1")
        banded = materialise(banded.join(known.hint("merge"), "token").where("lo <= cap and n <= hi").select("token", "node", "n", "cap"), "ngram-bands")
    return banded.join(banded.groupBy("token").agg(F.count(F.lit(1)).alias("size")).where("size > 1").hint("merge"), "token").select("token", "node", "size")


def _links(groups: DataFrame, sets: DataFrame) -> DataFrame:
    """(src, dst) by a trie for each group of groups (token, i, k, node, root): all sets of a block pass through one task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, nodes, held, roots = None, [], [], []

        def links() -> Iterator[pa.RecordBatch]:
            found = joined(held, roots) if len(held) > 1 else []
            if found:
                yield pa.RecordBatch.from_arrays([pa.array([nodes[a] for a, _ in found], pa.int64()), pa.array([nodes[b] for _, b in found], pa.int64())], names=["src", "dst"])

        for b in batches:
            keys = list(zip(*(b.column(i).to_pylist() for i in range(5))))
            for (token, i, k, node, root), tokens in zip(keys, token_slices(b.column(5))):
                if (token, i, k) != at:
                    yield from links()
                    at, nodes, held, roots = (token, i, k), [], [], []
                if not nodes or nodes[-1] != node:  # a hub may come twice
                    nodes.append(node)
                    roots.append(root)
                    held.append(tokens)
        yield from links()

    groups = materialise(groups, "ngram-groups")
    wanted = sets.sparkSession.sparkContext.broadcast(sieve(groups.select(F.xxhash64("node")).distinct()))

    def sift(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.filter(pa.array(passes(wanted.value, b.column(2).to_numpy()))).select([0, 1])

    near = sets.select("node", "tokens", F.xxhash64("node")).mapInArrow(sift, "node bigint, tokens binary")
    full = groups.join(near, "node").select("token", "i", "k", "node", "root", "tokens")
    n = int(sets.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = full.repartition(n, "token", "i", "k").sortWithinPartitions("token", "i", "k", "node")
    return materialise(dealt.mapInArrow(run, "src bigint, dst bigint"), "ngram-links")


def _first_meetings(shared: DataFrame) -> DataFrame:
    """Each node in a block of the largest of its groups, with that group's hubs: groups (token, i, k, node, root)."""
    chosen = shared.groupBy("node").agg(F.max(F.struct("size", "token")).alias("g")).select("node", "g.token")
    groups = chosen.groupBy("token").agg(F.count(F.lit(1)).alias("c"), F.array(*(F.min(F.struct(F.xxhash64("node", F.lit(h)).alias("h"), F.col("node").alias("node")))["node"] for h in range(HUBS))).alias("hubs")).where("c > 1")
    blocks = F.ceil(F.col("c") / BLOCK).cast("int")
    members = chosen.join(groups.select("token", blocks.alias("blocks")), "token").select("token", F.pmod(F.xxhash64("node"), "blocks").cast("int").alias("i"), "node")
    hubs = groups.where(blocks > 1).select("token", F.explode(F.sequence(F.lit(0), blocks - 1)).alias("i"), "hubs").select("token", "i", F.explode("hubs").alias("node"))
    return members.union(hubs).select("token", "i", F.lit(0).alias("k"), "node", F.col("node").alias("root"))


def _open_meetings(shared: DataFrame, components: DataFrame) -> DataFrame:
    """What is left to compare: groups (token, i, k, node, root) that hold texts of several components.

    Groups of the same texts are taken once. A group beyond a block is dealt: its largest component in blocks k, the other
    texts in blocks i that meet each k and, in squares (i, -j), each other.
    """
    known = shared.join(components, shared["node"] == components["node"], "left").select(shared["node"], "token", F.coalesce("component", shared["node"]).alias("root"))
    parts = known.groupBy("token", "root").agg(F.count(F.lit(1)).alias("c"), F.sum(F.xxhash64("node").cast("decimal(38,0)")).alias("h"))
    tokens = parts.groupBy("token").agg(F.max(F.struct("c", "root")).alias("top"), F.sum("c").alias("c"), F.sum("h").alias("h"), F.count(F.lit(1)).alias("roots")).where("roots > 1")
    once = tokens.groupBy("c", "h", "roots").agg(F.min(F.struct("token", "top")).alias("t")).select("t.token", F.col("t.top.root").alias("top"), "c", F.col("t.top.c").alias("top_c"))
    dealt = once.select("token", "top", (F.col("c") <= BLOCK).alias("small"), F.ceil(F.col("top_c") / BLOCK).cast("int").alias("ks"), F.ceil((F.col("c") - F.col("top_c")) / BLOCK).cast("int").alias("is"))
    met = known.join(dealt, "token")
    at = lambda n: F.pmod(F.xxhash64("node"), n).cast("int")
    all_ = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    cell = lambda i, k: F.struct(i.alias("i"), k.alias("k"))
    mine = at("is")
    outer = F.transform(all_("ks"), lambda k: cell(mine, k))
    square = F.transform(all_("is"), lambda j: cell(F.least(mine, j), -1 - F.greatest(mine, j)))
    cells = (
        F.when(F.col("small"), F.array(cell(F.lit(0), F.lit(0))))
        .when(F.col("root") == F.col("top"), F.transform(all_("is"), lambda i: cell(i, at("ks"))))
        .otherwise(F.when(F.col("is") > 1, F.concat(outer, square)).otherwise(outer))
    )
    return met.select("token", F.explode(cells).alias("x"), "node", "root").select("token", "x.i", "x.k", "node", "root")


def similar_components(sets: DataFrame, meetings: DataFrame | None = None) -> DataFrame:
    """(node, component) over the nodes of shingle_sets that link to another; component is the least node reachable.

    meetings: groups (token, node, size) in which texts meet first, instead of those of a shared rare shingle. They spare
    comparisons; what comes out is the same.
    """
    with small_batches(sets.sparkSession):
        total = int(sets.agg(F.sum("n")).first()[0] or 0)
        order = shared_shingles(sets, total)
        met = shared_shingles(sets, total, order)
        shared = materialise(_groups(materialise(prefix_records(sets, order, met), "ngram-records")), "ngram-shared")
        links = _links(_first_meetings(shared if meetings is None else meetings), sets)
        components = materialise(connected_components(links), "ngram-components")
        return connected_components(links.union(_links(_open_meetings(shared, components), sets)))


def link_documents(docs: DataFrame, words: int = WORDS, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_shingles (of its set) and component_id (least doc_id reachable over links, itself included) of each row."""
    sets = shingle_sets(docs, words, doc_id, text)
    found = similar_components(sets)
    known = sets.join(found, "node", "left").groupBy("key").agg(F.first("n").alias("n"), F.min(F.coalesce("component", "node")).alias("root"))
    rows = docs.select(F.col(doc_id).alias("doc_id"), text_key(F.col(text)).alias("key"))
    least = rows.groupBy("key").agg(F.min("doc_id").alias("least")).join(known, "key")
    roots = least.groupBy("root").agg(F.min("least").alias("component_id"))
    named = materialise(known.join(roots, "root").select("key", "n", "component_id"), "ngram-named")
    return rows.join(named, "key", "left").select("doc_id", F.coalesce("n", F.lit(0)).cast("bigint").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))
