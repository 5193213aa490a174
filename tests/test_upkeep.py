"""The maintenance cycle against a plain loop in the order of the frames, its empty form, and what a failure leaves."""

import copy
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from mnemos.config import BudgetConfig, ReplayConfig
from mnemos.kernels import folds
from mnemos.operators import replay, upkeep
from mnemos.sources.stages import Stages
from tests.test_replay import GROUP, TRACE, a_group, a_trace

EDGE = "src string, dst string, kind string, weight double, support_ema double, last_update_ts double, bf_sep_ema double, success_alpha double, success_beta double"
FRAME = "frame_id string, seq bigint, session_id string, trace_id string, anchor_id string, x array<double>, c array<double>, ts double, active_ids array<string>, activation map<string,double>, group_entropy double, loss double, next_trace_id string, next_ts double, target array<double>"
NAMES = [c.split(" ")[0] for c in TRACE.split(", ")]
LIMITS = ReplayConfig(prototype_support=3, prototype_dispersion=9.0, prototype_gain=-9.0, procedure_support=2, procedure_success=0.5, procedure_entropy=5.0, procedure_gain=-9.0)
NOW = 60.0


def world(spark, near=False):
    r = np.random.default_rng(7)
    traces = [list(a_trace(f"t{i}", "s" if i < 4 else "u", [float(np.cos(i)), float(np.sin(i))], 2.0 + i, [f"a{i}"])) for i in range(6)]
    at = {n: k for k, n in enumerate(NAMES)}
    for i, t in enumerate(traces):
        t[at["fidelity"]], t[at["compression_stage"]], t[at["access_ema"]] = [1.0, 0.6, 0.2, 0.6, 0.4, 0.2][i], [0, 1, 2, 1, 1, 2][i], 0.05
        t[at["role_support"]], t[at["role_gain_ema"]], t[at["role_logits"]] = {"prototype": 0.5 * i}, {"prototype": 0.1}, {"prototype": [0.0, 0.2, 0.1, 0.0, 0.6, 0.0][i], "episodic": 1.0}
    frames = []
    for k in range(14):
        own = ["t0", "t1", "t2", "t0", "t1", "t3", "t0", "t1", "t4", "t5", "t4", "t5", "t4", "t5"][k]
        session = "s" if own in ("t0", "t1", "t2", "t3") else "u"
        active = [own, *(t for t in (("t0", "t1", "t2") if session == "s" else ("t4", "t5")) if t != own)]
        share = {t: (0.5 if near else 0.8) if t == own else (0.5 if near else 0.2) / (len(active) - 1) for t in active}
        frames.append([f"f{k:02}", k, session, own, f"a{int(own[1])}", (np.array(traces[int(own[1])][2]) + 0.1 * r.standard_normal(2)).tolist(), r.standard_normal(2).tolist(), float(k), active, share, 0.1 * (k % 4), [0.05, 0.4, 0.1, 0.2][k % 4]])
    for k, f in enumerate(frames):
        nxt = next((g for g in frames[k + 1 :] if g[2] == f[2]), None)
        f += [nxt[3], nxt[7], nxt[5]] if nxt else [None, None, None]
    edges = [("t0", "t1", "temporal", 0.2, 0.2, 1.0, 0.0, 1.0, 1.0), ("t1", "t2", "option", 0.1, 0.1, 1.0, 0.0, 1.5, 1.0), ("t3", "t4", "assoc", 0.3, 0.2, 1.0, 0.0, 1.0, 1.0), ("t4", "t5", "temporal", 0.9, 0.5, 1.0, 0.0, 1.0, 1.0)]
    anchors = [(f"a{i}", [0.3 * i, 0.1]) for i in range(5)]
    df = {"traces": spark.createDataFrame(list(map(tuple, traces)), TRACE), "edges": spark.createDataFrame(edges, EDGE), "groups": spark.createDataFrame([a_group("g0", ["t2", "t3"])], GROUP), "frames": spark.createDataFrame(list(map(tuple, frames)), FRAME), "anchors": spark.createDataFrame(anchors, "anchor_id string, z array<double>"), "active": spark.createDataFrame([("t1", 0.5)], "trace_id string, activation double"), "hot": spark.createDataFrame([("t3",)], "trace_id string")}
    return df, [dict(zip(NAMES, copy.deepcopy(t))) for t in traces], [dict(zip([c.split(" ")[0] for c in FRAME.split(", ")], f)) for f in frames], {e[:3]: dict(zip(["weight", "support_ema", "last_update_ts", "bf_sep_ema", "success_alpha", "success_beta"], e[3:])) for e in edges}, dict(anchors)


def test_stages_equal_a_loop(spark):
    """Reconsolidation, edges, continuation, promotion, fidelity and roles, each after the one before."""
    state, traces, frames, edges, anchors = world(spark)
    stages = Stages(spark, "test-cycle")
    batch = [f for f in frames if f["next_trace_id"] is not None]
    T = {t["trace_id"]: t for t in traces}
    got = stages.keep(state["frames"].where("next_trace_id is not null"), "batch")
    # reconsolidation
    for t in T.values():
        for k in ("z_mu", "z_sigma_diag", "ctx_mu", "ctx_sigma_diag"):
            t[k] = np.array(t[k])
    for f in batch:
        total = sum(f["activation"].values())
        top = max(f["activation"], key=lambda t: (f["activation"][t], t == f["trace_id"], t))
        for t, r in f["activation"].items():
            T[t].update(folds.reconsolidate(T[t], [f | {"r": r / total, "x": np.array(f["x"]), "c": np.array(f["c"]), "anchor_id": f["anchor_id"] if t == top else None}]))
    df = stages.keep(upkeep.reconsolidated(got, state["traces"]), "t")

    def same(df, *columns):
        for row in df.collect():
            for c in columns:
                assert np.allclose(row[c], T[row["trace_id"]][c], atol=1e-12) if not isinstance(row[c], (list, dict)) or c.endswith(("mu", "diag")) else row[c] == pytest.approx(T[row["trace_id"]][c]) if isinstance(row[c], dict) else row[c] == list(T[row["trace_id"]][c]), (row["trace_id"], c)

    same(df, "evidence", "z_mu", "z_sigma_diag", "ctx_mu", "ctx_sigma_diag", "pred_loss_ema", "stability", "uncertainty", "anchor_reservoir")
    # edges
    new = {"weight": 0.0, "support_ema": 0.0, "last_update_ts": 0.0, "bf_sep_ema": 0.0, "success_alpha": 1.0, "success_beta": 1.0}

    def upsert(key, delta, ts):
        e = edges.get(key)
        if e is None:
            edges[key] = new | {"weight": delta, "support_ema": delta, "last_update_ts": ts}
        else:
            e |= {"weight": 0.95 * e["weight"] + delta, "support_ema": 0.95 * e["support_ema"] + delta, "last_update_ts": ts}
        return edges[key]

    def support(a, b):
        o, t = edges.get((a, b, "option")), edges.get((a, b, "temporal"))
        return min(max(t["weight"] if t else 0, o["success_alpha"] / (o["success_alpha"] + o["success_beta"]) if o else 0, 0), 1)

    def option(a, b, success, delta, ts):
        now, has = support(a, b), (a, b, "option") in edges
        if (0 if has else 0.05 * 0.115 + 0.03 * 0.15) + 0.08 * (1 - max(now, success)) < 0.08 * (1 - now):
            e = upsert((a, b, "option"), delta, ts)
            e |= {"success_alpha": 0.98 * e["success_alpha"] + success, "success_beta": 0.98 * e["success_beta"] + 1 - success}

    for f in batch:
        a, b = f["trace_id"], f["next_trace_id"]
        upsert((a, b, "temporal"), 0.15, f["next_ts"])
        success = 1 - min(f["loss"], 1)
        if success > 0.7:
            option(a, b, success, 0.075 * success, f["next_ts"])
        for other in f["active_ids"]:
            if other != a:
                upsert((a, other, "assoc"), 0.05, f["ts"])
    e = stages.keep(upkeep.replay_edges(got, df, state["edges"], stages), "e")

    def same_edges(e):
        rows = {(r["src"], r["dst"], r["kind"]): r for r in e.collect()}
        assert set(rows) == set(edges)
        for k, v in edges.items():
            # the last taken option's time is that of the edge's last step
            assert {c: rows[k][c] for c in v if c != "last_update_ts" or k[2] != "option"} == pytest.approx({c: x for c, x in v.items() if c != "last_update_ts" or k[2] != "option"}), k

    same_edges(e)
    # continuation
    align, drift = {}, {}
    for f in batch:
        a, b = f["trace_id"], f["next_trace_id"]
        align.setdefault(a, []).append(f["loss"])
        align.setdefault(b, []).append(f["loss"] / 2)
        drift.setdefault(a, []).append(f["group_entropy"] + 1 - support(a, b))
    for t, v in align.items():
        T[t]["future_alignment_ema"] = 0.97 * T[t]["future_alignment_ema"] + 0.03 * np.mean(v)
    for t, v in drift.items():
        T[t]["future_drift_ema"] = 0.97 * T[t]["future_drift_ema"] + 0.03 * np.mean(v)
    df, g = upkeep.continued(got, df, e, state["groups"], stages)
    same(df, "future_alignment_ema", "future_drift_ema")
    mean = np.mean([f["loss"] for f in batch if {f["trace_id"], f["next_trace_id"]} & {"t2", "t3"}])
    row = g.first()
    assert row["replay_alignment_ema"] == pytest.approx(0.03 * mean) and row["replay_tension_ema"] == 0.0
    # promotion
    cost = lambda t: 0.05 * (0.35 + 0.65 * t["fidelity"]) * (1 + 0.05 * len(t["member_ids"]) + 0.05 * len(t["path_signature"])) + 0.03 * role(t)

    def role(t):
        s = lambda m: sum(max(t[m].get(k, 0.0), 0.0) for k in ("prototype", "procedure"))
        return (s("role_logits") - min(max(s("role_support") + s("role_gain_ema"), 0), 4)) ** 2

    def step(t, name, n, gain):
        t["role_support"] = t["role_support"] | {name: 0.98 * t["role_support"].get(name, 0.0) + n}
        t["role_gain_ema"] = t["role_gain_ema"] | {name: 0.95 * t["role_gain_ema"].get(name, 0.0) + 0.05 * gain}

    def accept(t, name, place, ids):
        after = t | {place: ids, "role_logits": t["role_logits"] | {name: min(t["role_logits"].get(name, 0.0) + 0.2, 4), "episodic": max(t["role_logits"].get("episodic", 1.0) - 0.05, 0)}}
        if cost(after) < cost(t):
            t.update(after)
            return True
        return False

    sets = {}
    for f in batch:
        key = tuple(sorted(f["active_ids"][:3]))
        sets[key] = sets.get(key, 0) + 1
    promoted = set()
    for ids, n in sorted(sets.items()):
        mus = np.array([T[t]["z_mu"] for t in ids])
        far = ((mus - mus.mean(0)) ** 2).sum(1)
        gain = len(ids) - 1 - far.mean() - 0.25 * np.mean([T[t]["future_alignment_ema"] for t in ids]) - 0.1 * np.mean([T[t]["future_drift_ema"] for t in ids])
        t = T[ids[int(far.argmin())]]
        step(t, "prototype", n, gain)
        if n >= 3 and accept(t, "prototype", "member_ids", list(ids)):
            promoted.add(t["trace_id"])
    df, ids = upkeep.promote_prototypes(got, df, stages, limits=LIMITS)
    assert {r["trace_id"] for r in ids.collect()} == promoted and promoted
    same(df, "role_support", "role_gain_ema", "role_logits", "member_ids")
    pairs = {}
    for f in batch:
        pairs.setdefault((f["trace_id"], f["next_trace_id"]), []).append(1 - min(f["loss"], 1))
    plan = []
    for (a, b), s in sorted(pairs.items()):
        counts = np.array([len(v) for (x, _), v in pairs.items() if x == a], float)
        p = counts / counts.sum()
        h = -(p * np.log(p)).sum()
        gain = np.mean(s) - 0.1 * h - 0.15 * 0.5 * (T[a]["future_alignment_ema"] + T[b]["future_alignment_ema"]) - 0.05 * T[a]["future_drift_ema"]
        plan.append((a, b, len(s), np.mean(s), gain))
    promoted = set()
    for a in sorted({p[0] for p in plan}):
        own = [p for p in plan if p[0] == a]
        for _, _, n, _, gain in own:
            step(T[a], "procedure", n, gain)
        good = [p for p in own if p[2] >= 2 and p[3] >= 0.5]
        if good and accept(T[a], "procedure", "path_signature", list(good[0][:2])):
            promoted.add(a)
            option(*good[0][:2], good[0][3], 0.1 * good[0][3], NOW)
    df, e, ids = upkeep.promote_procedures(got, df, e, NOW, stages, limits=LIMITS)
    assert {r["trace_id"] for r in ids.collect()} == promoted and promoted
    same(df, "role_support", "role_gain_ema", "role_logits", "path_signature")
    same_edges(e)
    # fidelity
    newest = {}
    for f in frames:
        newest[f["anchor_id"]] = f["c"]
    back = set()
    for t in ("t1", "t3"):  # t1 is active, t3 is hot
        r = T[t]
        if (t == "t1" or r["access_ema"] >= 0.18) and r["fidelity"] < 0.999:
            z = np.array([anchors[a] for a in r["anchor_reservoir"] if a in anchors])
            c = np.array([newest[a] for a in r["anchor_reservoir"] if a in newest])
            r |= {"z_mu": z.mean(0), "z_sigma_diag": np.clip(z.var(0) + 1e-4, 1e-4, 16), "ctx_mu": c.mean(0), "ctx_sigma_diag": np.clip(c.var(0) + 1e-4, 1e-4, 16), "fidelity": min(1, r["fidelity"] + 0.15), "compression_stage": max(r["compression_stage"] - 1, 0)}
            r["uncertainty"] = folds.uncertainty(r["z_sigma_diag"], r["evidence"], r["pred_loss_ema"])
            back.add(t)
    store = lambda t: (0.35 + 0.65 * t["fidelity"]) * (1 + 0.05 * len(t["member_ids"]) + 0.05 * len(t["path_signature"]))
    mass = lambda t: max(t["role_logits"].get("prototype", 0), t["role_logits"].get("procedure", 0), 0) + 0.25 * max(t["role_support"].get("prototype", 0), t["role_support"].get("procedure", 0))
    risk = lambda t: (1 + max(NOW - t["last_access_ts"], 0)) * (t["uncertainty"] + 1) / (t["evidence"] + 1)
    use = lambda t: t["evidence"] + t["stability"] + t["access_ema"] + 0.5 * mass(t) - t["uncertainty"] - risk(t)
    cap, small = sum(map(store, T.values())) - 0.1, []
    for t in sorted((t for t in T.values() if t["trace_id"] not in ("t1", "t3") and mass(t) < 0.75), key=lambda t: use(t) / store(t)):
        if sum(map(store, T.values())) <= cap:
            break
        if t["fidelity"] > 0.15 + 1e-8:
            keep = max(1, round(len(t["anchor_reservoir"]) / 2))
            t |= {"fidelity": max(0.15, t["fidelity"] - 0.2), "compression_stage": t["compression_stage"] + 1, "anchor_reservoir": t["anchor_reservoir"][-keep:], "z_sigma_diag": np.clip(t["z_sigma_diag"] * 1.25, 1e-4, 16), "ctx_sigma_diag": np.clip(t["ctx_sigma_diag"] * 1.25, 1e-4, 16)}
            t["uncertainty"] = folds.uncertainty(t["z_sigma_diag"], t["evidence"], t["pred_loss_ema"])
            small.append(t["trace_id"])
    s = state | {"traces": df, "edges": e, "groups": g}
    df, compressed, rehydrated = upkeep.fidelity_step(s, NOW, stages, BudgetConfig(max_traces=cap, max_edges=1e9, max_groups=1e9))
    assert {r["trace_id"] for r in rehydrated.collect()} == back and {r["trace_id"] for r in compressed.collect()} == set(small)
    same(df, "fidelity", "compression_stage", "z_mu", "z_sigma_diag", "ctx_mu", "ctx_sigma_diag", "uncertainty", "anchor_reservoir")
    # roles
    demoted = set()
    for t in T.values():
        for name, place in (("prototype", "member_ids"), ("procedure", "path_signature")):
            t["role_support"] = t["role_support"] | {name: 0.98 * t["role_support"].get(name, 0.0)}
            t["role_gain_ema"] = t["role_gain_ema"] | {name: 0.95 * t["role_gain_ema"].get(name, 0.0)}
    for t in T.values():
        for name, place in (("prototype", "member_ids"), ("procedure", "path_signature")):
            if t["role_logits"].get(name, 0.0) <= 0 or (t["role_support"][name] >= 1 and t["role_gain_ema"][name] > 0):
                continue
            low = max(t["role_logits"][name] - 0.2, 0)
            after = t | {"role_logits": t["role_logits"] | {name: low, "episodic": min(t["role_logits"].get("episodic", 0.0) + 0.1, 4)}}
            after |= {place: []} if low <= 0.1 else {}
            if cost(after) <= cost(t):
                t.update(after)
                demoted.add(t["trace_id"])
    df, ids = upkeep.role_step(df, 1.0, stages)
    assert {r["trace_id"] for r in ids.collect()} == demoted
    for row in df.collect():
        t = T[row["trace_id"]]
        for c in ("role_support", "role_gain_ema", "role_logits"):
            assert {k: v for k, v in row[c].items() if v} == pytest.approx({k: v for k, v in t[c].items() if v})
        assert row["member_ids"] == t["member_ids"] and row["path_signature"] == t["path_signature"]


def test_cycle_creates_groups_and_traces(spark):
    """Even activations propose groups, and frames far from all traces ask for new ones."""
    state, *_ = world(spark, near=True)
    far = state["frames"].withColumn("x", F.when(F.col("seq") % 3 == 0, F.array(F.lit(-6.0), F.lit(7.0))).otherwise(F.col("x"))).withColumn("anchor_id", F.when(F.col("seq") % 3 == 0, F.concat(F.lit("n"), "seq")).otherwise(F.col("anchor_id")))
    done = upkeep.maintenance_cycle(state | {"frames": far}, NOW, 20, budget=BudgetConfig(max_traces=5, max_edges=8, max_groups=1))
    made = {r["trace_id"] for r in done.changed["structural"].collect()}
    assert made and len(made) <= max(1, round(12 * 0.35))
    after = {r["trace_id"]: r for r in done.tables["traces"].collect()}
    spawned = [r for r in after.values() if r["spawned_from_frame"]]
    assert {r["trace_id"] for r in spawned} == made - {r["trace_id"] for r in done.changed["pruned"].collect()}
    assert len({r["spawned_from_frame"] for r in spawned}) == len(spawned) and done.tables["groups"].count() >= 1
    for g in done.tables["groups"].collect():
        assert len(g["alpha"]) == len(g["ctx_mu"]) == len(g["ctx_sigma_diag"]) == len(g["member_ids"]) + 1
    edges = done.tables["edges"].collect()
    assert all(r["src"] in after and r["dst"] in after for r in edges)
    row = done.objective.first()
    assert math.isfinite(row["total"]) and row["churn"] > 0
    # a second cycle springs nothing from the same frames
    again = replay.replay_mutations(far.where("next_trace_id is not null"), done.tables["traces"], done.tables["edges"], done.tables["groups"], Stages(spark, "again"))[1]
    assert not {r["frame_id"] for r in again.collect()} & {r["spawned_from_frame"] for r in spawned}


def test_an_empty_batch_runs_fidelity_and_the_objective(spark):
    state, traces, *_ = world(spark)
    done = upkeep.maintenance_cycle(state | {"frames": state["frames"].limit(0)}, NOW, budget=BudgetConfig(max_traces=2.0, max_edges=1e9, max_groups=1e9))
    assert {r["trace_id"] for r in done.changed["compressed"].collect()} and done.tables["edges"].count() == 4
    assert {r["trace_id"]: r["evidence"] for r in done.tables["traces"].collect()} == {t["trace_id"]: t["evidence"] for t in traces}
    assert done.objective.count() == 1


def test_a_failed_stage_leaves_the_old_state(spark, tmp_path, monkeypatch):
    from mnemos.sources import snapshots

    state, *_ = world(spark)
    kept = {k: state[k] for k in ("traces", "edges", "groups")}
    snapshots.write_snapshot(kept, str(tmp_path / "s"), 1)
    monkeypatch.setattr(upkeep, "role_step", lambda *a, **k: (_ for _ in ()).throw(RuntimeError("lost")))
    with pytest.raises(RuntimeError, match="lost"):
        done = upkeep.maintenance_cycle(state, NOW, 20)
        snapshots.write_snapshot({k: done.tables[k] for k in kept}, str(tmp_path / "s"), 2)
    back = snapshots.read_latest_snapshot(spark, str(tmp_path / "s"))
    assert sorted(map(str, back["traces"].collect())) == sorted(map(str, state["traces"].collect()))


def test_a_batch_works_on_what_is_near_it(spark, monkeypatch):
    """Traces and groups that no frame names take no part in rounds and folds, change nothing and stay."""
    state, *_ = world(spark, near=True)
    idle = [a_trace(f"i{k}", "idle", [5.0 + k, 1.0], 3.0, [f"b{k}"]) for k in range(12)]
    pairs = [(f"i{k}", f"i{k + 1}") for k in range(11)]
    crowd = state | {
        "traces": state["traces"].unionByName(spark.createDataFrame(list(map(tuple, idle)), TRACE)),
        "groups": state["groups"].unionByName(spark.createDataFrame([a_group(f"gi{k}", list(p)) for k, p in enumerate(pairs)], GROUP)),
    }
    real, folded = replay.folds.update_groups, []
    monkeypatch.setattr(replay.folds, "update_groups", lambda g, *a: folded.append({r["group_id"] for r in g.select("group_id").collect()}) or real(g, *a))
    stages = Stages(spark, "near")
    batch = stages.keep(state["frames"].where("next_trace_id is not null"), "batch")
    groups_, traces, _ = replay.replay_groups(batch, crowd["traces"], crowd["groups"], stages)
    assert folded and not any(g.startswith("gi") for ids in folded for g in ids)
    near = {"members": "group_id", "met-groups": "group_id", "near": "trace_id"}
    for k, name in enumerate(stages.names):
        if name in near:
            rows = spark.read.parquet(f"{stages.path}/{k:03}-{name}").select(near[name]).collect()
            assert not any(r[0].startswith(("i", "gi")) for r in rows), (k, name)
    alone = replay.replay_groups(batch, state["traces"], state["groups"], Stages(spark, "alone"))
    for got, want, own, n in ((traces, alone[1], "trace_id", 12), (groups_, alone[0], "group_id", 11)):
        rows = [(r[own].startswith(("i", "gi")), str(r)) for r in got.collect()]
        assert sorted(r for idle_, r in rows if not idle_) == sorted(map(str, want.collect())) and sum(idle_ for idle_, _ in rows) == n
