"""Cells that hold a block of the left while the right passes: few copies move, and every pair is made once."""

import math

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from mnemos.kernels import pairs
from mnemos.operators import cells, retrieve


def sides(spark, left, right):
    a = spark.createDataFrame([(k, f"c{k}{i}", [float(i)]) for k, n in left.items() for i in range(n)], "_key string, cue_id string, v array<double>")
    b = spark.createDataFrame([(k, f"t{k}{i}") for k, n in right.items() for i in range(n)], "_key string, trace_id string")
    return a, b


def every(a, b):
    assert a.num_rows <= 7 and b.num_rows <= 5 and set(a["_key"].to_pylist()) == set(b["_key"].to_pylist())
    return pa.table({"cue_id": [c for c in a["cue_id"].to_pylist() for _ in range(b.num_rows)], "trace_id": b["trace_id"].to_pylist() * a.num_rows})


@pytest.mark.parametrize("held", [8, 16384])
def test_every_pair_is_made_once(spark, monkeypatch, held):
    monkeypatch.setattr(cells, "HELD", held)
    left, right = {"x": 60, "y": 1, "": 3, "none": 4}, {"x": 33, "y": 40, "": 1, "other": 2}
    out = cells.met(*sides(spark, left, right), "cue_id", "trace_id", every, "cue_id string, trace_id string", (7, 5))
    got = [tuple(r) for r in out.collect()]
    assert sorted(got) == sorted((f"c{k}{i}", f"t{k}{j}") for k in ("x", "y", "") for i in range(left[k]) for j in range(right[k]))


def test_copies_grow_with_the_rows(spark):
    """In blocks of 7 and 5 rows a grid moved 2,000 rows as 400 copies of 1,000 and 143 of the others."""
    a, b = sides(spark, {"x": 1000}, {"x": 1000})
    one, two = cells._streams(a, b, "cue_id", "trace_id", (7, 5))
    most = cells.TASKS * spark.sparkContext.defaultParallelism
    assert one.count() + two.count() <= 1000 * (1 + most)
    assert two.select("_i", "_j").distinct().count() >= spark.sparkContext.defaultParallelism  # and all cores are busy
    few, many = sides(spark, {"x": 3}, {"x": 1000})
    assert cells._streams(few, many, "cue_id", "trace_id", (7, 5))[1].select("_i", "_j").distinct().count() >= spark.sparkContext.defaultParallelism
    assert few.agg(F.count("v")).first()[0] == 3


def test_the_greatest_of_passing_blocks():
    """Scores in single precision choose what is scored anew: the true greatest are always among it, and little else."""
    r = np.random.default_rng(4)
    x, y, rest = r.standard_normal((30, 16)), r.standard_normal((900, 16)), r.integers(1, 9, 900) * 0.1
    x, y = (pairs.unit(v, np.linalg.norm(v, axis=1)) for v in (x, y))
    y[500] = y[3]  # a tie over two blocks
    rest[500] = rest[3]
    tops, kept = pairs.Tops(30, 4, 16), {i: set() for i in range(30)}
    for j in range(0, 900, 100):
        row, col = tops.add(x.astype(np.float32) @ y[j : j + 100].T.astype(np.float32) + rest[j : j + 100].astype(np.float32))
        for a, b in zip(row.tolist(), col.tolist()):
            kept[a].add(b + j)
    score = x @ y.T + rest
    for i in range(30):
        least = np.sort(score[i])[-4]
        assert kept[i] >= set(np.flatnonzero(score[i] >= least).tolist())
    assert sum(map(len, kept.values())) < 30 * 4 * 5  # 9 blocks of four each without a memory
    assert len(pairs.Tops(2, 4, 16).add(np.zeros((2, 3), dtype=np.float32))[0]) == 6  # fewer columns than k: all


def test_candidates_by_products_are_those_by_sums(spark):
    """Many cues and traces of a session, contexts of their own and the same, ties and zero vectors; against every pair."""
    r = np.random.default_rng(6)
    v = lambda i: [0.0] * 4 if i % 50 == 7 else r.standard_normal(4).round(1).tolist()
    for same in (True, False):
        traces = []
        for i in range(300):
            z = v(i) if i % 9 else [1.0, 0.5, -0.5, 0.2]
            traces.append((f"t{i}", "a" if i % 4 else "b", z, z if same else v(i), 1.0 + i % 3, 0.1 * (i % 4), 0.2, {"prototype": float(i % 3 == 0)}, {}))
        cues = [(f"c{i}", ["a", "", "b"][i % 3], z, z if same else v(i)) for i in range(60) for z in [v(i)]]
        t = spark.createDataFrame(traces, "trace_id string, session_id string, z_mu array<double>, ctx_mu array<double>, evidence double, access_ema double, uncertainty double, role_logits map<string,double>, role_support map<string,double>")
        c = spark.createDataFrame(cues, "cue_id string, session_id string, z array<double>, context array<double>")
        got = sorted((x["cue_id"], x["trace_id"], round(x["score"], 9), x["rank"]) for x in retrieve.make_candidates(c, t, 6).collect())
        dot = lambda a, b: sum(x * y for x, y in zip(a, b))
        cosine = lambda a, b: dot(a, b) / max(math.sqrt(dot(a, a)) * math.sqrt(dot(b, b)), 1e-8)
        want = []
        for q, session, z, context in cues:
            near = {x[0] for x in sorted(traces, key=lambda x: (-round(cosine(z, x[2]), 9), x[0]))[:6]}
            blended, final = {}, {}
            for x in traces:
                if session in ("", x[1]):
                    lat, ctx, mine, mass = cosine(z, x[2]), cosine(context, x[3]), 0.25 if session else 0.0, x[7]["prototype"]
                    blended[x[0]] = round(0.65 * lat + 0.25 * ctx + 0.1 * x[4] + 0.1 * x[5] - 0.05 * x[6] + mine, 9)
                    final[x[0]] = round(0.60 * lat + 0.20 * ctx + 0.15 * x[4] - 0.10 * x[6] + 0.05 * mass + mine, 9)
                    near |= {x[0]} if mass >= 0.75 else set()
            near |= set(sorted(blended, key=lambda x: (blended[x], x), reverse=True)[:6])
            best = sorted((x for x in near if x in final), key=lambda x: (final[x], x), reverse=True)[:6]
            want += [(q, x, final[x], k + 1) for k, x in enumerate(best)]
        assert got == sorted(want)
