"""Action objectives against a plain loop that builds every shadow state and scores it from scratch."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from mnemos.operators import actions, objective

D = 3


def density(x, mu, var):
    v = np.clip(np.asarray(var, float), 1e-4, 1e4)
    return float(-0.5 * sum((a - b) ** 2 / s + math.log(s) + math.log(2 * math.pi) for a, b, s in zip(x, mu, v)))


def unc(t):
    return float(np.mean(np.clip(t["z_sigma_diag"], 1e-4, 16))) + 0.3 / (t["evidence"] + 1e-8) + 0.8 * t["pred_loss_ema"]


def logit(t, x, c):
    return math.log(t["evidence"] + 1e-8) + 0.75 * t["stability"] - 0.5 * t["uncertainty"] + density(c, t["ctx_mu"], t["ctx_sigma_diag"]) + density(x, t["z_mu"], t["z_sigma_diag"])


def kl(p, q):
    p, q = np.clip(p, 1e-8, 1), np.clip(q, 1e-8, 1)
    p, q = p / p.sum(), q / q.sum()
    return float((p * np.log(p / q)).sum())


def objective_of(local, obs, edges, groups, everyone, plastic, extra, drift):
    """Total of a list of traces (dicts), and mean responsibilities."""
    s = al = kls = fa = fd = tw = 0.0
    mean = {t["trace_id"]: 0.0 for t in local}
    total = sum(o["weight"] for o in obs)
    held = {g["group_id"]: g for g in groups if any(t["trace_id"] in g["member_ids"] for t in local)}
    for o in obs:
        x, c, w = o["x"], o["c"], o["weight"]
        lg = np.array([logit(t, x, c) for t in local])
        null = density(x, np.zeros(D), [1.2] * D) + density(c, np.zeros(D), [1.2] * D)
        s += w * -np.logaddexp.reduce([*lg, null])
        r = np.exp(lg - np.logaddexp.reduce(lg)) if len(lg) else lg
        resp = dict(zip((t["trace_id"] for t in local), r))
        for k, v in resp.items():
            mean[k] += w * v / total
        if o["target"] is not None:
            m = sum(v * np.array(t["z_mu"]) for v, t in zip(r, local)) if len(local) else np.zeros(D)
            al += w * -density(o["target"], m, o["target_var"] if o["target_var"] is not None else [1.0] * D) / D
            tw += w
        fa += w * sum(v * max(t["future_alignment_ema"], 0) for v, t in zip(r, local))
        fd += w * sum(v * max(t["future_drift_ema"], 0) for v, t in zip(r, local))
        shown = {t["trace_id"]: t for t in local}
        for g in held.values():
            here = [i for i, m in enumerate(g["member_ids"]) if m in resp]
            if len(here) < 2:
                continue
            score = []
            for i, m in enumerate(g["member_ids"]):
                t = shown.get(m, everyone.get(m))
                score.append(-math.inf if t is None else math.log(g["alpha"][i] + 1e-8) + density(c, g["ctx_mu"][i], [g["ctx_sigma"]] * D) + density(x, t["z_mu"], t["z_sigma_diag"]) + 0.15 * math.log(g["pred_success_ema"][i] + 1e-8))
            score.append(math.log(g["alpha"][-1] + 1e-8) + density(c, g["ctx_mu"][-1], [g["ctx_sigma"]] * D) + density(x, np.zeros(D), [1.2] * D))
            e = np.exp((np.array(score) - max(score)) / max(g["temperature"], 1e-4))
            e /= e.sum()
            p = np.array([resp[g["member_ids"][i]] for i in here])
            kls += w * (kl(np.append(p, max(1 - p.sum(), 1e-8)), np.append(e[here], e[-1])) + g["replay_tension_ema"] + 0.5 * g["unresolved_mass"])
    ids = {t["trace_id"] for t in local}
    near = [e for e in edges if e["src"] in ids or e["dst"] in ids]
    cost = {"assoc": 0.09, "temporal": 0.1, "inhib": 0.11, "option": 0.115}
    storage = extra + sum((0.35 + 0.65 * t["fidelity"]) * (1 + 0.05 * len(t["member_ids"]) + 0.05 * len(t["path_signature"])) for t in local) + sum(cost[e["kind"]] for e in near)
    storage += sum(0.25 * (1 + 0.08 * (len(g["member_ids"]) - 1)) * (1 + 0.15 * g["unresolved_mass"]) * (1 + 0.1 * g["replay_tension_ema"]) * (1 + 0.02 * 2 * len(g["ambiguous_buffer"])) for g in held.values())
    complexity = sum(math.log1p(sum(t in (e["src"], e["dst"]) for e in edges)) for t in ids) + len(held) + 0.05 * len(near)
    fidelity = sum(max(0, 1 - t["fidelity"]) * (1 + 0.25 * t["compression_stage"]) for t in local)
    role = 0.0
    for t in local:
        logits, support, gain = (max(t[k].get("prototype", 0.0), 0) for k in ("role_logits", "role_support", "role_gain_ema"))
        role += (logits - min(max(support + gain, 0), 4)) ** 2
    out = s / total + 0.05 * storage + 0.03 * complexity + 0.1 * plastic + 0.18 * (al / max(tw, 1) + 0.5 * fa / total) + 0.08 * (drift + plastic + 0.5 * fd / total) + 0.25 * kls / total + 0.05 * fidelity + 0.03 * role
    return out, mean


def bayes(a, b, x, c):
    e = a["evidence"] + b["evidence"]
    mix = lambda f: (a["evidence"] * np.array(a[f]) + b["evidence"] * np.array(b[f])) / e
    z, k = mix("z_mu"), mix("ctx_mu")
    spread = lambda s, f, m: (a["evidence"] * (np.array(a[s]) + (np.array(a[f]) - m) ** 2) + b["evidence"] * (np.array(b[s]) + (np.array(b[f]) - m) ** 2)) / e
    merged = math.log(e + 1e-8) + density(c, k, spread("ctx_sigma_diag", "ctx_mu", k)) + density(x, z, spread("z_sigma_diag", "z_mu", z))
    return np.logaddexp(logit(a, x, c), logit(b, x, c)) - merged


def choose(anchor, cands, obs, edges, groups, everyone):
    x, c = np.array(anchor["x"]), np.array(anchor["c"])
    own = {"x": x, "c": c, "weight": 1.0, "target": anchor["target"], "target_var": anchor["target_var"]}
    seen = [own, *obs]
    drift = float(np.mean((np.array(anchor["summary"]) - anchor["target"]) ** 2)) if anchor["summary"] is not None and anchor["target"] is not None else 0.0
    child = {"trace_id": "new", "z_mu": x, "ctx_mu": c, "z_sigma_diag": np.full(D, 0.4), "ctx_sigma_diag": np.full(D, 0.6), "evidence": 1.0, "stability": 0.0, "pred_loss_ema": 0.0, "fidelity": 1.0, "compression_stage": 0, "member_ids": [], "path_signature": [], "role_logits": {}, "role_support": {}, "role_gain_ema": {}, "future_alignment_ema": 0.0, "future_drift_ema": 0.0}
    child["uncertainty"] = unc(child)
    tried = [("BIRTH", None, [*cands, child], 0.0, 1.0)]
    for i, t in enumerate(cands):
        eta = 0.2 / (1 + 4 * t["stability"])
        ctx = np.array(t["ctx_mu"]) + 0.1 * (c - t["ctx_mu"])
        moved = t | {"ctx_mu": ctx, "ctx_sigma_diag": np.clip(0.9 * np.array(t["ctx_sigma_diag"]) + 0.1 * (c - ctx) ** 2, 1e-4, 16), "evidence": 0.995 * t["evidence"] + 1}
        a = moved | {"z_mu": np.array(t["z_mu"]) + eta * (x - t["z_mu"]), "z_sigma_diag": np.clip((1 - eta) * np.array(t["z_sigma_diag"]) + eta * (x - np.array(t["z_mu"])) ** 2, 1e-4, 16)}
        for m in (moved, a):
            m["uncertainty"] = unc(m)
        split = child | {"z_sigma_diag": np.minimum(0.4, 0.5 * np.array(t["z_sigma_diag"])), "ctx_mu": t["ctx_mu"], "ctx_sigma_diag": t["ctx_sigma_diag"], "fidelity": max(t["fidelity"], 0.85)}
        split["uncertainty"] = unc(split)
        put = lambda m: [*cands[:i], m, *cands[i + 1 :]]
        tried += [("ASSIMILATE", t["trace_id"], put(a), t["stability"] * float(np.mean((a["z_mu"] - np.array(t["z_mu"])) ** 2)), 0.0), ("ATTACH", t["trace_id"], put(moved), 0.0, 0.0), ("SPLIT", t["trace_id"], [*cands, split], 0.0, 1.1)]
    best = None
    for action, target, local, plastic, extra in tried:
        total, mean = objective_of(local, seen, edges, groups, everyone, plastic, extra, drift)
        top = sorted(mean.items(), key=lambda kv: -kv[1])[:2]
        pair = (None, None)
        if len(top) == 2 and top[0][1] - top[1][1] <= 0.15 and "new" not in (top[0][0], top[1][0]):
            d = -0.3 * max(0, bayes(everyone[top[0][0]], everyone[top[1][0]], x, c)) + 0.05 * 0.1 + 0.03 * 0.1
            if d < 0:
                total, pair = total + d, (top[0][0], top[1][0])
        if best is None or total < best[2] - 1e-12:
            best = (action, target, total, *pair)
    base = objective_of(cands, seen, edges, groups, everyone, 0.0, 0.0, drift)[0] if cands else 0.0
    return (*best[:3], base, *best[3:])


TRACE = "trace_id string, z_mu array<double>, z_sigma_diag array<double>, ctx_mu array<double>, ctx_sigma_diag array<double>, evidence double, stability double, uncertainty double, pred_loss_ema double, fidelity double, compression_stage int, member_ids array<string>, path_signature array<string>, role_logits map<string,double>, role_support map<string,double>, role_gain_ema map<string,double>, future_alignment_ema double, future_drift_ema double"
GROUP = "group_id string, member_ids array<string>, alpha array<double>, ctx_mu array<array<double>>, ctx_sigma double, pred_success_ema array<double>, temperature double, replay_tension_ema double, unresolved_mass double, ambiguous_buffer array<string>, ambiguous_ctx_buffer array<string>"


def world(seed, n=9):
    r = np.random.default_rng(seed)
    vec = lambda k=1.0: (k * r.standard_normal(D)).tolist()
    pos = lambda lo, hi: r.uniform(lo, hi, D).tolist()
    traces = [dict(trace_id=f"t{i}", z_mu=vec(), z_sigma_diag=pos(0.1, 0.8), ctx_mu=vec(0.5), ctx_sigma_diag=pos(0.2, 0.9), evidence=float(r.integers(1, 9)), stability=float(r.random()), uncertainty=float(r.random()), pred_loss_ema=float(r.random()), fidelity=float(r.choice([1.0, 0.8, 0.4])), compression_stage=int(r.integers(0, 3)), member_ids=["m"] * int(r.integers(0, 3)), path_signature=["p"] * int(r.integers(0, 2)), role_logits={"prototype": float(r.random())}, role_support={"prototype": float(r.random())}, role_gain_ema={"prototype": float(r.random() - 0.3)}, future_alignment_ema=float(r.random()), future_drift_ema=float(r.random())) for i in range(n)]
    traces[1] |= {k: traces[0][k] for k in ("z_mu", "ctx_mu", "z_sigma_diag", "ctx_sigma_diag", "evidence", "stability", "uncertainty")}  # an even pair
    edges = [dict(src=f"t{a}", dst=f"t{b}", kind=k) for a, b, k in [(0, 1, "temporal"), (1, 2, "option"), (3, 3, "assoc"), (4, 8, "inhib"), (5, 6, "temporal"), (0, 1, "assoc")]]
    groups = [dict(group_id="g0", member_ids=["t0", "t1", "t8"], alpha=[1.0, 2.0, 1.5, 0.5], ctx_mu=[vec(0.5) for _ in range(4)], ctx_sigma=0.6, pred_success_ema=[0.5, 0.6, 0.2, 0.1], temperature=1.3, replay_tension_ema=0.2, unresolved_mass=0.4, ambiguous_buffer=["a"], ambiguous_ctx_buffer=["a"]), dict(group_id="g1", member_ids=["t2", "t3", "gone"], alpha=[1.0, 0.2, 3.0, 0.5], ctx_mu=[vec(0.5) for _ in range(4)], ctx_sigma=0.6, pred_success_ema=[0.5, 0.9, 0.2, 0.1], temperature=0.7, replay_tension_ema=0.1, unresolved_mass=0.0, ambiguous_buffer=[], ambiguous_ctx_buffer=[])]
    anchors, pairs, obs = [], [], []
    for i in range(14):
        target = None if i % 3 == 0 else vec()
        anchors.append(dict(anchor_id=f"a{i:02}", x=vec(), c=vec(0.5), target=target, target_var=pos(0.3, 2) if i % 2 else None, summary=vec() if i % 4 else None))
        if i == 5:
            anchors[-1] |= {"x": traces[0]["z_mu"], "c": traces[0]["ctx_mu"]}
        k = [0, 1, 2, 4, 7][i % 5]
        pairs += [(f"a{i:02}", f"t{t}", j) for j, t in enumerate([0, 1] * (i == 5) or r.permutation(n)[:k].tolist())]
        obs += [dict(anchor_id=f"a{i:02}", seq=j, x=vec(), c=vec(0.5), target=vec() if j % 2 else None, target_var=None, weight=float(r.uniform(0.2, 2))) for j in range(i % 4)]
    return traces, edges, groups, anchors, pairs, obs


def frames(spark, w):
    traces, edges, groups, anchors, pairs, obs = w
    rows = lambda data, ddl: spark.createDataFrame([tuple(r[c.split(" ")[0]] for c in ddl.split(", ")) for r in data], ddl)
    return (
        rows(anchors, "anchor_id string, x array<double>, c array<double>, target array<double>, target_var array<double>, summary array<double>"), spark.createDataFrame(pairs, "anchor_id string, trace_id string, rank int"), rows(traces, TRACE),
        rows(obs, "anchor_id string, seq int, x array<double>, c array<double>, target array<double>, target_var array<double>, weight double"), rows(edges, "src string, dst string, kind string"), rows(groups, GROUP),
    )


@pytest.mark.parametrize("seed", [1, 2])
def test_actions_equal_a_loop_over_shadow_states(spark, seed):
    w = world(seed)
    traces, edges, groups, anchors, pairs, obs = w
    everyone = {t["trace_id"]: t for t in traces}
    got = {r["anchor_id"]: r for r in actions.score_actions(actions.nest_patches(*frames(spark, w))).collect()}
    assert len(got) == len(anchors)
    for a in anchors:
        cands = [everyone[t] for i, t, _ in pairs if i == a["anchor_id"]]
        want = choose(a, cands, [o for o in obs if o["anchor_id"] == a["anchor_id"]], edges, groups, everyone)
        r = got[a["anchor_id"]]
        assert (r["action"], r["trace_id"]) == want[:2]
        assert r["objective"] == pytest.approx(want[2], abs=1e-9) and r["base"] == pytest.approx(want[3], abs=1e-9)
        assert {r["inhibit_first"], r["inhibit_second"]} == {want[4], want[5]}
    assert any(r["inhibit_first"] for r in got.values()) and len({r["action"] for r in got.values()}) > 1


def test_a_group_changes_the_action(spark):
    """With its group's slice far from the responsibilities, the action that brings them together wins."""
    w = world(3)
    traces, edges, groups, anchors, pairs, obs = w
    groups = [g | {"alpha": [0.001, 50.0, 0.5, 0.5], "temperature": 0.5} for g in groups[:1]]
    pairs = [(a["anchor_id"], t, j) for a in anchors for j, t in enumerate(["t0", "t1", "t2"])]
    few = [a | {"x": (np.array(traces[0]["z_mu"]) + 0.2 * i).tolist()} for i, a in enumerate(anchors)]
    w = (traces, edges, groups, few, pairs, obs)
    an, pa_, tr, ob, ed, gr = frames(spark, w)
    with_groups = {r["anchor_id"]: (r["action"], r["trace_id"]) for r in actions.score_actions(actions.nest_patches(an, pa_, tr, ob, ed, gr)).collect()}
    without = {r["anchor_id"]: (r["action"], r["trace_id"]) for r in actions.score_actions(actions.nest_patches(an, pa_, tr, ob, ed)).collect()}
    everyone = {t["trace_id"]: t for t in traces}
    for a in few:
        want = choose(a, [everyone[t] for t in ("t0", "t1", "t2")], [o for o in obs if o["anchor_id"] == a["anchor_id"]], edges, groups, everyone)
        assert with_groups[a["anchor_id"]] == want[:2]
    assert with_groups != without


def test_far_candidates_and_nothing(spark):
    """Logits hundreds apart don't cancel, and a batch may be empty."""
    w = world(4, n=3)
    traces, edges, groups, anchors, pairs, obs = w
    for i, t in enumerate(traces):
        t["z_mu"] = [40.0 * i] * D
    w = (traces, edges, [], anchors, [(a["anchor_id"], f"t{j}", j) for a in anchors for j in range(3)], obs)
    everyone = {t["trace_id"]: t for t in traces}
    got = {r["anchor_id"]: r for r in actions.score_actions(actions.nest_patches(*frames(spark, w))).collect()}
    for a in anchors:
        want = choose(a, traces, [o for o in obs if o["anchor_id"] == a["anchor_id"]], edges, [], everyone)
        assert got[a["anchor_id"]]["objective"] == pytest.approx(want[2], abs=1e-6) and got[a["anchor_id"]]["action"] == want[0]
    an, pa_, tr, ob, ed, gr = frames(spark, w)
    assert actions.score_actions(actions.nest_patches(an.limit(0), pa_, tr, ob, ed, gr)).count() == 0
    assert {r["action"] for r in actions.score_actions(actions.nest_patches(an, pa_.limit(0), tr, ob, ed, gr)).collect()} == {"BIRTH"}


def test_patch_objective_with_edges_and_groups(spark):
    w = world(5)
    traces, edges, groups, anchors, pairs, obs = w
    an, pa_, tr, ob, ed, gr = frames(spark, w)
    everyone = {t["trace_id"]: t for t in traces}
    cands = pa_.join(tr, "trace_id").withColumnRenamed("anchor_id", "patch_id").drop("rank")
    seen = ob.select(F.col("anchor_id").alias("patch_id"), F.concat_ws("-", "anchor_id", "seq").alias("obs_id"), "x", "c", "target", "target_var", "weight")
    got = {r["patch_id"]: r for r in objective.patch_objective(cands, seen, ed, gr, tr).collect()}
    means = {(r["patch_id"], r["trace_id"]): r["resp"] for r in objective.patch_responsibilities(cands, seen).collect()}
    for a in anchors:
        local = [everyone[t] for i, t, _ in pairs if i == a["anchor_id"]]
        own = [o for o in obs if o["anchor_id"] == a["anchor_id"]]
        if local and own:
            total, mean = objective_of(local, own, edges, groups, everyone, 0.0, 0.0, 0.0)
            assert got[a["anchor_id"]]["total"] == pytest.approx(total, abs=1e-9)
            assert {t: means[a["anchor_id"], t] for t in mean} == pytest.approx(mean, abs=1e-12)
