"""Pairs made in cells, against the column functions on every pair; blocks of one or two rows."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from mnemos.functions import costs
from mnemos.operators import cells, objective, readout, retrieve

TRACE = "trace_id string, session_id string, z_mu array<double>, z_sigma_diag array<double>, ctx_mu array<double>, ctx_sigma_diag array<double>, evidence double, stability double, uncertainty double, access_ema double, fidelity double, future_alignment_ema double, future_drift_ema double, role_logits map<string,double>, role_support map<string,double>"


def world(spark):
    r = np.random.default_rng(5)
    v = lambda: r.standard_normal(3).round(2).tolist()
    pos = lambda: (0.3 + r.random(3)).tolist()
    traces = [[f"t{i}", ["a", "a", "b", ""][i % 4], v(), pos(), v(), pos(), 1.0 + i % 3, 0.1 * (i % 5), 0.2, 0.5, 0.8, 0.1 * (i % 3), 0.2, {"prototype": float(i % 5 == 0)}, {}] for i in range(14)]
    traces[9][2:] = traces[1][2:]  # a copy, which ties
    traces[8][2] = None
    traces[4][2] = traces[4][2][:2]
    cues = [(f"c{i}", ["a", "b", "", None, "z"][i % 5], v(), v()) for i in range(10)]
    return spark.createDataFrame(traces, TRACE), spark.createDataFrame(cues, "cue_id string, session_id string, z array<double>, context array<double>")


@pytest.fixture(autouse=True)
def small(monkeypatch):
    for f in (cells.dealt, cells.met):
        monkeypatch.setattr(f, "__defaults__", ((2, 3),))
    monkeypatch.setattr(cells, "PAIRS", (1, 2))


def rows(df, *names):
    return sorted([tuple(round(x, 9) if isinstance(x, float) else x for x in r) for r in df.select(*names).collect()], key=str)


def test_mixtures_and_responsibilities(spark):
    t, c = world(spark)
    obs = c.where("session_id != ''").select("session_id", F.col("cue_id").alias("obs_id"), F.col("z").alias("x"), F.col("context").alias("c"))
    pairs = objective.responsibilities(objective.logits(obs.join(t, "session_id")))
    assert rows(objective.all_responsibilities(obs, t, "session_id"), "obs_id", "trace_id", "resp") == rows(pairs, "obs_id", "trace_id", "resp")
    assert rows(objective.closest_pairs(obs, t, "session_id", 1.0), "obs_id", "first", "second", "gap") == rows(objective.ambiguity_pairs(pairs, 1.0), "obs_id", "first", "second", "gap")
    null = obs.select("obs_id", costs.null_logprob(F.col("x"), F.col("c")).alias("n"))
    got = objective.mixtures(obs, t, "session_id", vector=True).join(null, "obs_id").withColumn("surprise", objective.mixture_surprise(F.col("n")))
    known = pairs.where("resp is not null").join(null, "obs_id").groupBy("obs_id").agg(
        F.log(F.sum(F.exp("logit")) + F.exp(F.max("n"))).alias("l"), F.sum(F.col("resp") * F.col("future_alignment_ema")).alias("fa"), *(F.sum(F.col("resp") * F.col("z_mu")[i]).alias(f"v{i}") for i in range(3))
    )
    want = known.select("obs_id", (-F.col("l")).alias("s"), "fa", F.array("v0", "v1", "v2").alias("v"))
    near = lambda r: (r[0], *np.round([r[1], r[2], *r[3]], 9))
    assert sorted(map(near, got.select("obs_id", "surprise", "future_alignment", "vector").collect())) == sorted(map(near, want.collect()))


def test_biases(spark):
    t, c = world(spark)
    c = c.withColumns({"cue": F.col("z"), "frontier": F.col("context"), "predicted": F.col("z")})
    pairs = c.where("session_id != ''").join(t.withColumnRenamed("session_id", "trace_session"), F.col("session_id") == F.col("trace_session"))
    assert rows(readout.all_biases(c, t), "cue_id", "trace_id", "bias") == rows(pairs.withColumn("bias", readout.cue_bias()), "cue_id", "trace_id", "bias")


@pytest.mark.parametrize("size", [2, 40])
def test_candidates_of_all_sources(spark, size):
    t, c = world(spark)
    active = spark.createDataFrame([("c0", "t12"), ("c2", "t3"), ("c1", "t13")], "cue_id string, trace_id string")
    edges = spark.createDataFrame([("t12", "t8"), ("t6", "t13")], "src string, dst string")
    groups = spark.createDataFrame([("g", ["t5", "t1"]), ("h", ["t10", "t2", "t3"]), ("k", ["t0", "t6"])], "group_id string, member_ids array<string>")
    got = retrieve.make_candidates(c, t, size, active, edges, groups)
    pairs = retrieve.session_scope(c, t)
    dot = lambda a, b: sum(x * y for x, y in zip(a, b)) if a and b and len(a) == len(b) else None
    cos = lambda a, b: None if dot(a, b) is None else dot(a, b) / max(np.sqrt(dot(a, a) * dot(b, b)), 1e-8)
    first = lambda s: (s is not None, s if s is not None else 0.0)
    every, cues = t.collect(), {r.cue_id: r for r in c.collect()}
    seen = {}
    for p in pairs.collect():
        lat, ctx = cos(p.z, p.z_mu), cos(p.context, p.ctx_mu)
        mine, mass = 0.25 if p.session_id != "" and p.session_id == p.trace_session else 0.0, max(p.role_logits["prototype"], 0.0)
        blend = None if lat is None else round(0.65 * lat + 0.25 * ctx + 0.1 * p.evidence + 0.1 * p.access_ema - 0.05 * p.uncertainty + mine, 9)
        final = None if lat is None else round(0.6 * lat + 0.2 * ctx + 0.15 * p.evidence - 0.1 * p.uncertainty + 0.05 * mass + mine, 9)
        seen.setdefault(p.cue_id, {})[p.trace_id] = (blend, final, mass)
    want = []
    for q, own in seen.items():
        picked = set(sorted(own, key=lambda x: (first(own[x][0]), x), reverse=True)[:size]) | {x for x in own if own[x][2] >= 0.75}
        near = sorted(((-round(s, 9), r.trace_id) for r in every if (s := cos(cues[q].z, r.z_mu)) is not None))[:size]
        picked |= {x for _, x in near}
        for a, x in [tuple(r) for r in active.collect()]:
            if a == q:
                picked |= {x} | {d for s, d in edges.collect() if s == x} | {s for s, d in edges.collect() if d == x}
        picked |= {m for g in groups.collect() if picked & set(g.member_ids) for m in g.member_ids}
        kept = sorted((x for x in picked if x in own), key=lambda x: (first(own[x][1]), x), reverse=True)[:size]
        want += [(q, x, own[x][1], n + 1) for n, x in enumerate(kept)]
    assert rows(got, "cue_id", "trace_id", "score", "rank") == sorted(want, key=str)


def test_session_scope_deals_a_hot_session_to_many_tasks(spark):
    """Pairs of one session and of cues without one, against a loop; a join on the session alone left them to a task or two."""
    cues = [(f"c{i}", "a" if i % 5 else "") for i in range(900)] + [("n", None), ("x", "none")]
    traces = [(f"t{i}", "a" if i % 3 else "") for i in range(2500)] + [("tn", None)]
    c, t = spark.createDataFrame(cues, "cue_id string, session_id string"), spark.createDataFrame(traces, "trace_id string, session_id string")
    got = retrieve.session_scope(c, t)
    assert {"session_id", "trace_session"} <= set(got.columns) and not any(x.startswith("_") for x in got.columns)
    tasks = got.select("cue_id", "trace_id", F.spark_partition_id().alias("p"))
    sizes = [r["count"] for r in tasks.groupBy("p").count().collect()]
    want = {(a, b) for a, s in cues for b, u in traces if s == "" or s is not None and s == u}
    assert sum(sizes) == len(want) and max(sizes) < 0.5 * len(want)
    assert {(r[0], r[1]) for r in tasks.collect()} == want
