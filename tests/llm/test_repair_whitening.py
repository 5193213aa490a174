"""Conversation repair and whitening against plain Python, with nulls, ties, repeats, long groups and empty tables."""

import hashlib
import random
import re
import zlib
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from mnemos.llm import conversation_repair as repair
from mnemos.llm import whitening

ROWS = "conv_id bigint, turn bigint, role string, text string"


def cheapest(rows):
    """(cost, audit, turns) of rows (role, text, fault), by dynamic programming over whole edit strings."""
    want, after = ("user", "user", "assistant", "user"), {"s": 1, "u": 2, "a": 3}
    best = {0: (0, "", [])}

    def grown(states):
        for _ in range(4):
            for s, (c, e, t) in list(states.items()):
                w = want[s]
                new = (c + 2, e + "I", [*t, (w, "")])
                if after[w[0]] not in states or new[:2] < states[after[w[0]]][:2]:
                    states[after[w[0]]] = new
        return states

    for role, text, fault in rows:
        options = {}
        for s, (c, e, t) in grown(best).items():
            tries = [(s, (c + 3, e + "D", t))]
            if fault not in ("blank", "duplicate"):
                more, w = int(fault == "truncated"), want[s]
                if role[:1] == "s" and s == 0 or role[:1] == w[0]:
                    tries.append((after[role[0]], (c + more, e + "K", [*t, (role, text)])))
                tries.append((after[w[0]], (c + 2 + more, e + "R", [*t, (w, text)])))
            for to, way in tries:
                if to not in options or way[:2] < options[to][:2]:
                    options[to] = way
        best = options
    return min((v for s, v in grown(best).items() if s in (0, 3)), key=lambda v: v[:2])


def damaged(rows):
    out = []
    for conv, turn, role, text in rows:
        role, text = role if role is not None else " ", text if text is not None else " "
        k = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        text = "" if k == 1 else re.sub("[.!?]", "", text) if k == 2 else text
        out += [(conv, turn, "user" if k == 4 else role, text)] * (0 if k == 0 else 2 if k == 3 else 1)
    return out


def expected(rows):
    out = {}
    for conv in {r[0] for r in rows}:
        own = sorted((r for r in damaged([r for r in rows if r[0] == conv])), key=lambda r: (r[1] is not None, r[1] or 0, r[2]))
        faults, seen = [], set()
        for _, _, role, text in own:
            w = text.strip(" \t\n\x0b\x0c\r")
            faults.append("blank" if not w else "duplicate" if (role, text) in seen else "truncated" if w[-1] not in ".!?" else "")
            seen.add((role, text))
        turns = [r[1] for r in own if r[1] is not None]
        cost, audit, fixed = cheapest([(r[2], r[3], f) for r, f in zip(own, faults)])
        pairs = [a[2][:1] + b[2][:1] for a, b in zip(own, own[1:])]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        joined = "\n".join(f"{r}:{t}" for r, t in fixed)
        out[conv] = (gaps, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), sum(p not in ("su", "ua", "au") for p in pairs), cost, audit, hashlib.sha256(joined.encode()).hexdigest())
    return out


def conversations(seed, sizes):
    r = random.Random(seed)
    texts = ["Fine.", "Is it?", "no end", " \t", "", "Ünï cödé!", None, "So it is.", "x" * 3000 + "."]
    rows = []
    for conv, n in enumerate(sizes):
        for i in range(n):
            role = r.choice(["user", "assistant", "user", "assistant", "system", "tool", None]) if r.random() < 0.4 else ("user", "assistant")[i % 2]
            text = r.choice(texts) if r.random() < 0.5 else f"Say {r.random()}."
            rows.append((conv or None, None if r.random() < 0.05 else i + (r.random() < 0.1), role, text))
    # rows of equal turn differ in role at most, so that their order is that of turn and role
    seen, out = set(), []
    for x in rows:
        key = (x[0], x[1], "user" if x[2] is None else x[2])
        if x[1] is None or (x[0], x[1]) not in seen:
            out.append(x if x[1] is not None or key not in seen else (x[0], 10_000 + len(out), *x[2:]))
        seen |= {key, (x[0], x[1])}
    return out


@pytest.mark.parametrize("seed", range(3))
def test_search_is_the_cheapest_and_least(seed):
    r = random.Random(seed)
    for _ in range(400):
        rows = [(r.choice("sauut"), r.choice([0, 0, 0, 1, 2, 3])) for _ in range(r.choice([0, 1, 2, 3, 5, 9, 40, 70]))]
        names = {0: "", 1: "blank", 2: "duplicate", 3: "truncated"}
        cost, audit, _ = cheapest([({"s": "system", "a": "assistant", "u": "user", "t": "tool"}[i], "", names[f]) for i, f in rows])
        got = repair.plan(rows)[0]
        assert (got[0], got[1] + repair.CLOSING[got[2]]) == (cost, audit)


def test_repair_of_short_and_long_conversations(spark):
    rows = conversations(1, [3, 0, 1, 2, 5, 8, 7, 6, 4000, 8, 8, 30, 5, 2, 1])
    df = spark.createDataFrame(rows, ROWS).withColumns({"part": F.lit(7), "cost": F.lit("x"), "copies": F.lit(9)}).repartition(7)
    got = {r["conv_id"]: tuple(r)[1:] for r in repair.repair_conversations(repair.damage(df), copies="copies").collect()}
    want = expected(rows)
    assert set(got) == set(want)
    for conv in want:
        assert got[conv] == want[conv], conv


def test_repair_edge_cases(spark, monkeypatch):
    monkeypatch.setattr(repair, "SLICE_ROWS", 3)
    empty = spark.createDataFrame([], ROWS)
    assert repair.repair_conversations(repair.damage(empty), copies="copies").count() == 0
    rows = [(1, 0, "user", "Same.")] * 50 + [(2, None, None, None), (3, 0, "user", "Q?"), (3, 1, "assistant", "A."), (4, 5, "", "No role."), (5, 0, "user", "Gone.")]
    df = spark.createDataFrame(rows, ROWS).withColumn("copies", F.when(F.col("conv_id") == 5, 0).otherwise(1))
    got = {r["conv_id"]: r for r in repair.repair_conversations(df, texts=True, copies="copies").collect()}
    assert got[1]["duplicate"] == 49 and got[1]["audit"] in {"K" + "D" * 49 + "I", "D" * 50} and got[1]["cost"] == 149
    assert got[2]["blank"] == 1 and got[2]["gaps"] == 0 and got[2]["repaired"] == ""
    assert got[3]["audit"] == "KK" and got[3]["repaired"] == "user:Q?\nassistant:A."
    assert got[4]["audit"] == "D" and got[5]["audit"] == "" and got[5]["repaired_sha256"] == hashlib.sha256(b"").hexdigest()


# 13
VECTORS = "vec_id bigint, embedding array<float>, label int"


def dense(rows):
    """n, sums, eigenvalues and vectors of the distinct lattice vectors, by NumPy."""
    x = np.array(sorted({tuple(int(np.floor(256 * float(np.float32(c)))) for c in v) for v in rows}))
    s = x.sum(axis=0)
    y = x - s / len(x)
    e, u = np.linalg.eigh(y.T @ y / len(x))
    return x, s, e[::-1], u[:, ::-1]


def vectors(n, d, seed=3):
    r = np.random.default_rng(seed)
    return (r.standard_normal((n, d)) * np.linspace(1.5, 0.3, d) @ np.linalg.qr(r.standard_normal((d, d)))[0]).astype(np.float32).tolist()


@pytest.mark.parametrize("d", [1, 3, 4, 24])
def test_whitening_against_dense(spark, d):
    own = vectors(300, d)
    rows = [(i, v, 0) for i, v in enumerate(own)] + [(1000 + i, own[0], 0) for i in range(200)]
    bad = [(2000, None, 0), (2001, [None] + own[0][1:], 0), (2002, [float("nan")] * d, 0), (2003, [float("inf")] * d, 0), (2004, [], 0), (2005, [0.5] * (d + 1), 0)]
    df = spark.createDataFrame(rows + bad, VECTORS).withColumns({"x": F.lit(1), "n": F.lit(2), "component": F.lit(3)})
    got = whitening.whiten_embeddings(df).collect()
    x, s, e, u = dense(own)
    k = min(4, d)
    assert len(got) == len(rows) * k and {r["n"] for r in got} == {len(x)}
    by = {(r["vec_id"], r["component"]): r for r in got}
    for c in range(k):
        have = np.array([by[i, c + 1]["whitened"] for i in range(300)])
        lay = (np.floor(256 * np.array(own, dtype=np.float32).astype(float)) - s / len(x)) @ u[:, c] / np.sqrt(e[c])
        assert min(np.abs(have - lay).max(), np.abs(have + lay).max()) < 1e-8
        assert by[0, c + 1]["explained"] == pytest.approx(e[c] / e.sum(), rel=1e-9) and by[0, c + 1]["identity_error"] < 1e-9
        assert by[1000, c + 1]["whitened"] == by[0, c + 1]["whitened"]
    v = [int(np.floor(256 * float(c))) for c in own[7]]
    assert by[7, 1]["deviation"] == sum((len(x) * a - int(b)) ** 2 for a, b in zip(v, s))


def test_whitening_of_nothing_and_of_planes(spark):
    assert whitening.whiten_embeddings(spark.createDataFrame([], VECTORS)).count() == 0
    assert whitening.whiten_embeddings(spark.createDataFrame([(1, [0.5, 0.5], 0), (2, [0.5, 0.5], 0)], VECTORS)).count() == 0
    flat = [(i, [i / 8, i / 4, 0.0], 0) for i in range(9)]
    assert {r["component"] for r in whitening.whiten_embeddings(spark.createDataFrame(flat, VECTORS)).collect()} == {1}
    square = [(i, [float(a), float(b), float(c)], 0) for i, (a, b, c) in enumerate([(1, 0, 0), (-1, 0, 0), (0, 1, 0), (0, -1, 0), (0, 0, 1), (0, 0, -1)])]
    got = whitening.whiten_embeddings(spark.createDataFrame(square, VECTORS)).collect()
    assert {r["component"] for r in got} == {1, 2, 3} and max(r["identity_error"] for r in got) < 1e-9


@pytest.mark.parametrize("values", [[9, 5, 5, 5, 5, 5, 1], [4, 3, 2, 1, 1 - 1e-7, 0.5], [1e8, 3, 2, 1, 0.1], [5, 4, 0, 0, 0, 0]])
def test_feast_misses_none(values):
    r = np.random.default_rng(5)
    q = np.linalg.qr(r.standard_normal((len(values), len(values))))[0]
    v = (q * np.array(values, dtype=float)) @ q.T
    e, u = whitening.leading((v + v.T) / 2)
    want = [x for x in sorted(values, reverse=True)[:4] if x > 0]
    assert np.allclose(e, want, rtol=1e-10) and np.abs((v @ u) - u * e).max() < 1e-12 * max(values) * 10
    assert whitening.above(v, 4.5) == sum(x > 4.5 for x in values)


def test_deviation_is_exact_or_null():
    x = np.array([[3_000_000_000, 1], [5, 5], [2_000_000, 7]])
    sums = (10**18 * 3, -7)
    got = whitening.deviations(x, 10**9, sums)
    exact = [sum((10**9 * int(a) - s) ** 2 for a, s in zip(r, sums)) for r in x]
    assert got == [v if v < 1 << 63 else None for v in exact]
    assert float(Fraction(1, 3)) == whitening.Whitening(3, (1,), np.zeros(0), np.zeros(0), 0.0).mean[0]
