"""Cues that are settled together, against settle() on each."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from mnemos.kernels import settle as kernel
from mnemos.operators import readout

KINDS = ("temporal", "option", "assoc", "inhib")


def cue(r, n):
    """Biases (with ties), edges and groups of a cue with n candidates."""
    edges = [(int(r.integers(n)), int(r.integers(n)), KINDS[r.integers(4)], float(r.random() * 2 - 0.2)) for _ in range(r.integers(0, 3 * n))]
    groups = []
    for _ in range(r.integers(0, 4) if n > 2 else 0):
        m = int(r.integers(2, min(n, 12) + 1))
        groups.append((r.permutation(n)[:m].tolist(), r.random(m) * (r.random() > 0.2)))
    return np.round(r.standard_normal(n) * 2, 1), edges, groups


@pytest.mark.parametrize("n", [1, 2, 5, 17])
def test_cues_settled_together(n):
    r = np.random.default_rng(n)
    cues, active = [cue(r, n) for _ in range(40)], r.integers(1, 13, 40)
    flat = [(k, s, d, kind == "inhib", kind in ("inhib", "assoc"), w) for k, (_, edges, _) in enumerate(cues) for s, d, kind, w in edges]
    got = kernel.settle_many(np.stack([c[0] for c in cues]), np.array([f[:5] for f in flat], dtype=np.int64), np.array([f[5] for f in flat]), [c[2] for c in cues], active)
    for k, (bias, edges, groups) in enumerate(cues):
        want = kernel.settle(bias, edges, groups, kernel.SettleConfig(active=int(active[k])))
        assert got[0][k] == pytest.approx(want.activation, abs=1e-12) and ((got[0][k] > 0) == (want.activation > 0)).all()
        assert got[1][k] == want.iterations and (got[2][k], got[3][k]) == pytest.approx((want.energy, want.group_kl), abs=1e-12)


def test_workspaces_are_settled_many_at_a_time(spark, monkeypatch):
    """Cues of several sizes, some without candidates, in matrices of bounded size; no call for a cue of its own."""
    r, rows, want = np.random.default_rng(3), [], {}
    for k in range(60):
        n = int(r.integers(0, 5))
        bias, edges, groups = cue(r, n) if n else (np.zeros(0), [], [])
        name = lambda i, k=k: f"t{k}-{i}"
        given = [(name(s), name(d), kind, w) for s, d, kind, w in edges] + [("elsewhere", name(0), "assoc", 1.0)]
        rows.append((f"c{k}", [(name(i), float(b)) for i, b in enumerate(bias)] or None, given, [([name(i) for i in ids], p.tolist()) for ids, p in groups] or None, 1 + k % 3))
        if n:
            s = kernel.settle(bias, edges, groups, kernel.SettleConfig(active=1 + k % 3))
            want[f"c{k}"] = ([name(i) for i in range(n) if s.activation[i] > 0], s.activation[s.activation > 0].tolist(), s.iterations, s.energy, s.group_kl)
        else:
            want[f"c{k}"] = ([], [], 0, 0.0, 0.0)
    nested = spark.createDataFrame(rows, "cue_id string, candidates array<struct<trace_id:string,bias:double>>, edges array<struct<src:string,dst:string,kind:string,weight:double>>, groups array<struct<ids:array<string>,probs:array<double>>>, size int")
    monkeypatch.setattr(readout, "SETTLED", 64)
    got = {x["cue_id"]: tuple(x)[1:] for x in readout.settle_workspaces(nested).collect()}
    assert got.keys() == want.keys()
    for k, v in want.items():
        assert got[k][0] == v[0] and got[k][2] == v[2] and [*got[k][1], *got[k][3:]] == pytest.approx([*v[1], *v[3:]], abs=1e-9)


def test_edges_of_hot_traces_are_dealt(spark):
    """A few edges that each meet many cues are no single task's work."""
    scored = spark.range(400).select(F.concat(F.lit("c"), F.col("id") % 200).alias("cue_id"), F.concat(F.lit("t"), (F.col("id") / 200).cast("int")).alias("trace_id"), F.lit(1).alias("rank"), F.lit(0.5).alias("bias"))
    edges = spark.createDataFrame([("t0", "t1", "assoc", 1.0), ("t1", "t0", "temporal", 0.5), ("t0", "x", "assoc", 1.0)], "src string, dst string, kind string, weight double")
    nested = readout.nest_cues(scored, edges)
    assert "REPARTITION_BY_NUM" in nested._jdf.queryExecution().toString()
    assert [(len(r["candidates"]), len(r["edges"])) for r in nested.collect()] == [(2, 2)] * 200
