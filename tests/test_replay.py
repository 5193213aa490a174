"""Group merging, replayed groups and mutations against plain loops."""

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from mnemos.operators import groups_merge, replay
from mnemos.sources.stages import Stages

GROUP = "group_id string, member_ids array<string>, alpha array<double>, ctx_mu array<array<double>>, ctx_sigma_diag array<array<double>>, pred_success_ema array<double>, temperature double, unresolved_mass double, replay_alignment_ema double, replay_tension_ema double, ambiguous_buffer array<string>, ambiguous_ctx_buffer array<array<double>>"
TRACE = "trace_id string, session_id string, z_mu array<double>, z_sigma_diag array<double>, ctx_mu array<double>, ctx_sigma_diag array<double>, evidence double, stability double, uncertainty double, fidelity double, compression_stage int, pred_loss_ema double, future_alignment_ema double, future_drift_ema double, access_ema double, last_access_ts double, anchor_reservoir array<string>, member_ids array<string>, path_signature array<string>, role_logits map<string,double>, role_support map<string,double>, role_gain_ema map<string,double>, parent_trace_id string, spawned_from_frame string"


def a_group(name, members, d=2):
    n = len(members)
    return (name, members, [1.0] * n + [0.5], [[0.1 * i] * d for i in range(n)] + [[0.0] * d], [[0.6] * d] * n + [[1.2] * d], [0.5] * (n + 1), 1.0, 0.0, 0.0, 0.0, [], [])


def a_trace(name, session, z, evidence=3.0, anchors=()):
    return (name, session, z, [0.15] * len(z), z, [0.2] * len(z), evidence, 0.2, 0.3, 1.0, 0, 0.1, 0.1, 0.1, 1.0, 1.0, list(anchors), [], [], {}, {}, {}, None, None)


@pytest.mark.parametrize("seed", range(2))
def test_merging_in_rounds_equals_the_loop(spark, seed):
    r = random.Random(seed)
    names = [f"t{i}" for i in range(14)]
    start = [("g1", ["t0", "t1"]), ("g2", ["t1", "t2", "t3"]), ("g0", ["t9", "t4"])]
    pairs = []
    for k in range(16):
        a, b = r.sample(names, 2)
        pairs.append((k, a, b, r.choice([None, *names]), r.random(), r.uniform(0, 3), r.uniform(0.4, 1)))
    want, outcomes = {g: list(m) for g, m in start}, {}
    for k, a, b, guard, ambiguity, bf, overlap in pairs:
        if guard is not None and any(guard in m for m in want.values()):
            continue
        both = sorted(g for g, m in want.items() if a in m and b in m)
        left = max(ambiguity - 0.5 * bf * overlap, 0)
        new = 0 if both else 0.05 * 0.27 + 0.03 * 0.25
        if not (bf > 0.2 and overlap > 0.55 and new + 0.25 * left < 0.25 * ambiguity):
            continue
        either = sorted(g for g, m in want.items() if a in m or b in m)
        at = both[0] if both else either[0] if either else "group_" + hashlib.sha256(f"{a}\x1f{b}\x1f{k}".encode()).hexdigest()[:32]
        if not both:
            m = want.setdefault(at, [])
            m += [t for t in (a, b) if t not in m]
        outcomes[k] = at
    df = spark.createDataFrame(pairs, "seq int, first string, second string, guard string, ambiguity double, bf double, overlap double")
    groups = spark.createDataFrame([a_group(*g) for g in start], GROUP)
    traces = spark.createDataFrame([a_trace(n, "s", [float(i), 1.0]) for i, n in enumerate(names)], TRACE)
    stages = Stages(spark, "test-merge")
    members, took = groups_merge.merge_pairs(df, groups, stages)
    got = {}
    for row in members.orderBy("group_id", "slot").collect():
        got.setdefault(row["group_id"], []).append(row["trace_id"])
    assert got == want and {x["seq"]: x["group_id"] for x in took.collect()} == outcomes
    full = {x["group_id"]: x for x in groups_merge.rebuild_groups(groups, members, traces).collect()}
    for g, m in got.items():
        assert full[g]["member_ids"] == m and len(full[g]["alpha"]) == len(full[g]["ctx_mu"]) == len(m) + 1 and full[g]["alpha"][-1] == 0.5
        old = len(dict(start).get(g, []))
        for i, t in enumerate(m[old:], old):
            assert full[g]["ctx_mu"][i] == [float(names.index(t)), 1.0] and full[g]["alpha"][i] == 1.0
