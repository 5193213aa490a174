"""The prefix-tree join against brute force, with nulls, copies, crowds and ties."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from mnemos.llm import ngram_join

DOCS = "doc_id bigint, text string"


def brute(rows):
    """(n_shingles, component) of each row, all pairs compared."""
    sets = []
    for _, t in rows:
        w = "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "").encode().split()
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    head = list(range(len(rows)))

    def find(i):
        while head[i] != i:
            i = head[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 80 * (len(sets[i]) + len(sets[j]) - both):
                head[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    return sorted((repr(d), len(s), repr(least.get(find(i)))) for i, ((d, _), s) in enumerate(zip(rows, sets)))


def edited(words, r, rate):
    return [r.choice("xyzuvw") + str(r.random()) if r.random() < rate else w for w in words]


def corpus(seed, crowd, others):
    r = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    base, line = r.choices(vocabulary, k=70), r.choices(vocabulary, k=30)
    texts = [None, "", " \t", "one two", "ONE  two", "one two three four five", "Ü ö ä ß ç"]
    texts += [" ".join(edited(base, r, 0.015)) for _ in range(crowd)]
    texts += [" ".join(line + r.choices(vocabulary, k=r.randint(2, 40))) for _ in range(others)]
    texts += [" ".join(r.choices(vocabulary, k=r.randint(1, 90))) for _ in range(others)]
    for t in list(texts[-others:]):
        texts += [" ".join(edited(t.split(), r, r.choice([0.01, 0.03, 0.05]))) for _ in range(2)]
    texts += texts[5:40] + [texts[20].upper()]
    ids = list(range(len(texts)))
    r.shuffle(ids)
    return [(i if i % 97 else None, t) for i, t in zip(ids, texts)]


@pytest.mark.parametrize("block", [256, 8])
def test_join_against_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(ngram_join, "BLOCK", block)
    rows = corpus(block, 60, 60)
    df = spark.createDataFrame(rows, DOCS).withColumns({"key": F.lit(1), "node": F.lit(2), "token": F.lit("x"), "n": F.lit(3)}).repartition(5)
    got = sorted((repr(r[0]), r[1], repr(r[2])) for r in ngram_join.link_documents(df).collect())
    assert got == brute(rows)


def test_join_of_nothing_and_of_one(spark):
    assert ngram_join.link_documents(spark.createDataFrame([], DOCS)).count() == 0
    got = ngram_join.link_documents(spark.createDataFrame([(3, "a b"), (3, "a b"), (None, None), (5, "w " * 50_000)], DOCS)).collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, [(3, 1, 3), (3, 1, 3), (None, 0, None), (5, 1, 5)]))


@pytest.mark.parametrize("seed", range(4))
def test_trie_finds_every_partner(seed):
    r = np.random.default_rng(seed)
    base = r.choice(10_000, 60, replace=False)
    sets = [np.unique(np.concatenate([base[r.random(60) > r.choice([0.02, 0.1, 0.4])], r.choice(10_000, r.integers(0, 9))])) for _ in range(80)]
    sets += [base[:1], base[:30], np.sort(base), np.sort(base), r.choice(10**6, 5)]
    trie = ngram_join.Trie(sets, list(range(len(sets))))
    found = {frozenset((trie.order[x], trie.order[y])) for x in range(len(sets)) for y in trie.partners(x).tolist()}
    sim = lambda a, b: ngram_join.reaches(len(np.intersect1d(a, b)), len(a), len(b))
    assert found == {frozenset((i, j)) for i in range(len(sets)) for j in range(i) if sim(np.unique(sets[i]), np.unique(sets[j]))}


def test_prefixes_and_caps_lose_no_pair():
    for n in range(1, 60):
        for m in range(n, 75):
            need = next((k for k in range(1, n + 1) if ngram_join.reaches(k, n, m)), None)
            if need is None:
                continue
            # their first common shingle has `need - 1` common ones after it at least, in either set
            assert ngram_join.prefix(n) >= n - need + 1 and ngram_join.prefix(m) >= m - need + 1
            cap = lambda size, at: (5 * size - 9 * at) // 4
            assert all(cap(n, i) >= m for i in range(n - need + 1)) and all(cap(m, j) >= n for j in range(m - need + 1))
            assert int(np.floor(np.log(m) / np.log(1.26))) - int(np.floor(np.log(n) / np.log(1.26))) <= 1


def test_packed_numbers_and_gaps():
    r = np.random.default_rng(1)
    for n in (0, 1, 5, 3000):
        t = np.unique(r.integers(0, 1 << 48, n))
        assert (ngram_join.unpack(np.frombuffer(ngram_join.pack(t), np.uint8)) == t).all()
        at = np.unique(np.concatenate([r.integers(0, 1 << 16, n // 50), [0, 254, 255, 256, 65535][: n]])).astype(np.int64)
        assert (ngram_join.ungap(ngram_join.gaps(at)) == at).all()


@pytest.mark.parametrize("bits", [20, 27])
def test_shared_shingles_are_those_of_several_sets(spark, monkeypatch, bits):
    """A shingle of one set isn't shared, however many sets there are; a table of counts by bucket told them as common."""
    monkeypatch.setattr(ngram_join, "SIEVE_BITS", bits)
    monkeypatch.setattr(ngram_join, "SLICE", 3000)
    r = np.random.default_rng(bits)
    common, few = r.integers(0, 1 << 48, 40), r.integers(0, 1 << 48, 200)
    sets = [np.unique(np.concatenate([common, few[i % 100 * 2 :][:2], r.integers(0, 1 << 48, 300)])) for i in range(300)]
    df = spark.createDataFrame([(i, len(s), bytearray(ngram_join.pack(s))) for i, s in enumerate(sets)], "node bigint, n int, tokens binary").repartition(3)
    order = ngram_join.shared_shingles(df, sum(map(len, sets)))
    level = order.levels(common)
    assert (level == int(8 * np.log2(300))).all() and (order.levels(few) > 0).all() and (order.levels(few) < level[0]).all()
    single = np.concatenate([np.setdiff1d(s, np.concatenate([common, few])) for s in sets])
    assert (order.levels(single) > 0).mean() < 0.01
    # the second meeting is of prefixes: what is common everywhere stands last and meets nobody
    records = ngram_join.prefix_records(df, order, ngram_join.shared_shingles(df, sum(map(len, sets)), order))
    assert records.count() < 0.01 * len(single)


def test_dealt_shingles_come_back():
    r = np.random.default_rng(3)
    sets = [np.unique(r.integers(0, 1 << 48, n)) for n in (0, 1, 700, 40)] + [np.array([0, (1 << 48) - 1])]
    back = [(p.as_py() << 26) + ngram_join.undealt(x.as_py()) for b in ngram_join.dealt(iter(sets), 32, 64) for p, x in zip(b.column(0), b.column(1))]
    assert (np.concatenate(back) == np.sort(np.concatenate(sets) >> 16)).all()
