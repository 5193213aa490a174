"""A turn as a whole, what a failed one leaves, frames settled anew, and frontiers of unknown sessions."""

import math
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from mnemos.config import FieldConfig
from mnemos.kernels.settle import SettleConfig, settle
from mnemos.operators import cycle, retrieve, turn
from mnemos.sources import snapshots
from mnemos.sources.stages import Stages
from tests.test_upkeep import world

CONFIG = FieldConfig(latent_dim=2)
CUES = "cue_id string, session_id string, text string, ts double"


def rows(df):
    return sorted(map(repr, df.collect()))


def near(text):
    """A vector of two dimensions by a text's length."""
    return F.array(F.cos(F.length(text).cast("double")), F.sin(F.length(text).cast("double")))


def cues(spark):
    return spark.createDataFrame([("c1", "s", "what was that", 70.0), ("c2", "u", "and now?", 71.0), ("c3", "new", "hello", 72.0), ("c4", "s", "again", 73.0)], CUES)


def test_a_turn_injects_keeps_up_reads_and_injects_answers(spark, tmp_path):
    state, *_ = world(spark)
    before = {k: rows(v) for k, v in state.items()}
    path = str(tmp_path / "versions")
    answer = lambda prompts: prompts.select("cue_id", F.concat(F.lit("```\nto "), "cue_id", F.lit("\n```")).alias("answer"))
    out = turn.respond_turn(state, cues(spark), answer, 80.0, near, path, 7, config=CONFIG)
    assert {k: rows(v) for k, v in state.items()} == before
    ids = {r["trace_id"] for r in out.state["traces"].collect()}
    links = out.links.collect()
    assert {(r["cue_id"], r["part"]) for r in links} == {(f"c{k}", p) for k in range(1, 5) for p in ("cue", "answer")}
    made = {r["anchor_id"]: r for r in out.state["frames"].collect() if r["anchor_id"].startswith("anc_")}
    assert len(made) == 8 and out.state["frames"].count() == len(before["frames"]) + 8
    for r in links:
        assert made[r["anchor_id"]]["trace_id"] == r["trace_id"]
    by = {}
    for f in out.state["frames"].collect():
        by.setdefault(f["session_id"], []).append(f)
    for log in by.values():
        log.sort(key=lambda f: (f["ts"], f["seq"]))
        assert len({f["seq"] for f in log}) == len(log)
        assert [f["next_trace_id"] for f in log] == [f["trace_id"] for f in log[1:]] + [None]
        assert all(abs(sum(f["activation"].values()) - 1) < 1e-9 for f in log if f["activation"])
    assert by["new"][0]["action"] == "BIRTH" if "action" in out.state["frames"].columns else by["new"][0]["trace_id"] in ids
    first = next(f for f in by["s"] if f["anchor_id"].startswith("anc_"))
    old = by["s"][by["s"].index(first) - 1]
    assert (old["trace_id"], first["trace_id"], "temporal") in {(e["src"], e["dst"], e["kind"]) for e in out.state["edges"].collect()} or not {old["trace_id"], first["trace_id"]} <= ids
    assert sorted(r["payload"] for r in out.answers.collect()) == ["to c1", "to c2", "to c3", "to c4"]
    assert all("ongoing_context" in r["messages"][0]["content"] for r in out.prompts.collect())
    assert out.objective.count() == 1
    back = snapshots.read_latest_snapshot(spark, path)
    assert {k: rows(v.select(*sorted(v.columns))) for k, v in back.items()} == {k: rows(v.select(*sorted(v.columns))) for k, v in out.state.items()}


@pytest.mark.parametrize("fault", ["blank", "missing", "raises", "twice", "cue"])
def test_a_failed_turn_leaves_nothing(spark, tmp_path, fault, monkeypatch):
    """The cycle and the inject, which the test above runs, are left out here."""
    state, *_ = world(spark)
    monkeypatch.setattr(turn.upkeep, "maintenance_cycle", lambda s, *_, **__: turn.upkeep.Cycle(s))
    monkeypatch.setattr(turn, "inject_batch", lambda s, a, *_: (s, a.withColumns({"x": F.col("z"), "c": F.col("z"), "trace_id": F.lit("t0")})))
    monkeypatch.setattr(turn, "settled_cues", lambda c, *_: c.select("cue_id", F.array(F.lit("t0")).alias("active_ids"), F.array(F.lit(1.0)).alias("weights"), *(F.array().cast("array<string>").alias(n) for n in ("procedures", "anchor_refs"))))
    before = {k: rows(v) for k, v in state.items()}
    path = str(tmp_path / "versions")
    snapshots.write_snapshot(state, path, 1, "start")
    asked = cues(spark)
    if fault == "cue":
        asked = asked.union(spark.createDataFrame([("c9", "s", "  ", 74.0)], CUES))

    def answer(prompts):
        if fault == "raises":
            raise RuntimeError("no model")
        out = prompts.select("cue_id", F.when((F.col("cue_id") == "c2") & F.lit(fault == "blank"), " ``` ").otherwise("yes").alias("answer"))
        return out.where("cue_id != 'c3'") if fault == "missing" else out.union(out.where("cue_id = 'c1'")) if fault == "twice" else out

    stages = Stages(spark, "failing")
    with pytest.raises(RuntimeError if fault == "raises" else turn.TurnFailed):
        turn.respond_turn(state, asked, answer, 80.0, near, path, 2, config=CONFIG, stages=stages)
    assert {k: rows(v) for k, v in state.items()} == before
    assert [r["step"] for r in snapshots.manifest(spark, path).collect()] == [1]
    assert not os.path.exists(stages.path)


def test_a_batch_without_a_past_is_born(spark):
    state, *_ = world(spark)
    none = {k: v.limit(0) for k, v in state.items()}
    a = spark.createDataFrame([("anc_1", "s", 1.0, "t", 0, [1.0, 0.0]), ("anc_2", "", 2.0, "t", 0, [0.0, 1.0])], "anchor_id string, session_id string, ts double, turn_id string, chunk_index int, z array<double>")
    s, made = turn.inject_batch(none, a, Stages(spark, "first"), 3.0, CONFIG)
    assert s["traces"].count() == 2 and {r["spawned_from_frame"] for r in s["traces"].collect()} == {"frame_1", "frame_2"}
    assert {r["frame_id"]: list(r["activation"].values()) for r in made.collect()}["frame_1"] == [1.0]
    again, _ = turn.inject_batch(none, a.repartition(3), Stages(spark, "second"), 3.0, CONFIG)
    assert rows(again["traces"]) == rows(s["traces"])
    s, made = turn.inject_batch(none, a.limit(0), Stages(spark, "empty"), 3.0, CONFIG)
    assert made.count() == 0 and s["frames"].count() == 0


def density(x, mu, var):
    return float(sum(-0.5 * ((a - b) ** 2 / v + math.log(v) + math.log(2 * math.pi)) for a, b, v in zip(x, mu, var)))


def cosine(a, b):
    return float(np.dot(a, b) / max(np.linalg.norm(a) * np.linalg.norm(b), 1e-8))


def test_frames_are_settled_anew_as_a_loop_settles_them(spark):
    state, traces, frames, edges, _ = world(spark)
    state = state | {"groups": state["groups"].limit(0)}
    got = {}
    for r in turn.settled_frames(state["frames"], state, CONFIG).collect():
        got.setdefault(r["frame_id"], {})[r["trace_id"]] = r["a"]
    want = {}
    for f in frames:
        mine = [t for t in traces if t["session_id"] == f["session_id"]]
        final = {}
        for t in mine:
            of = lambda m: max(t[m].get("prototype", 0.0), t[m].get("procedure", 0.0), 0.0)  # noqa: B023, E731
            mass = of("role_logits") + 0.25 * of("role_support")
            latent, ctx = cosine(f["x"], t["z_mu"]), cosine(f["c"], t["ctx_mu"])
            final[t["trace_id"]] = 0.60 * latent + 0.20 * ctx + 0.15 * t["evidence"] - 0.10 * t["uncertainty"] + 0.05 * mass + 0.25
            t["bias"] = math.log(t["evidence"] + 1e-8) + 0.75 * t["stability"] - 0.5 * t["uncertainty"] + 1.6 * latent + 0.2 * density(f["c"], t["ctx_mu"], t["ctx_sigma_diag"]) / 2 + 0.1 * mass + 0.08 * t["fidelity"] + 0.25
        mine.sort(key=lambda t: (final[t["trace_id"]], t["trace_id"]), reverse=True)
        at = {t["trace_id"]: k for k, t in enumerate(mine)}
        links = sorted((s, d, k, e["weight"]) for (s, d, k), e in edges.items() if s in at and d in at)
        size = min(max(len(f["active_ids"]), 1), 12)
        a = settle(np.array([t["bias"] for t in mine]), [(at[s], at[d], k, w) for s, d, k, w in links], [], SettleConfig(active=size)).activation
        want[f["frame_id"]] = {t["trace_id"]: a[k] for k, t in enumerate(mine) if a[k] > 0}
    assert {f: set(v) for f, v in got.items()} == {f: set(v) for f, v in want.items()}
    for f, v in want.items():
        assert got[f] == pytest.approx(v, abs=1e-9)
    kls = []
    for f in frames:
        names = set(f["activation"]) | set(want[f["frame_id"]])
        p, q = (np.clip([m.get(n, 0.0) for n in sorted(names)], 1e-8, 1.0) for m in (f["activation"], want[f["frame_id"]]))
        p, q = p / p.sum(), q / q.sum()
        kls.append(0.5 * float(((p - q) * np.log(p / q)).sum()))
    past = state["frames"].select("frame_id", F.explode("activation").alias("trace_id", "a"))
    settled = turn.settled_frames(state["frames"], state, CONFIG)
    none = state["traces"].limit(0)
    row = cycle.replay_objective(past, settled, state["frames"].limit(0).select(F.col("trace_id").alias("src"), F.col("next_trace_id").alias("dst")), state["edges"], state["groups"], none, none).first()
    assert row["activation_kl"] == pytest.approx(np.mean(kls), abs=1e-9)


def test_groups_change_what_frames_settle_to(spark):
    state, *_ = world(spark)
    plain = turn.settled_frames(state["frames"], state | {"groups": state["groups"].limit(0)}, CONFIG).agg(F.sum("group_kl")).first()[0]
    held = turn.settled_frames(state["frames"], state, CONFIG).agg(F.sum("group_kl")).first()[0]
    assert plain == 0.0 and held > 0.0


def test_unknown_sessions_take_the_last_frontier(spark):
    t = spark.createDataFrame([("a", [1.0, 0.0], 5.0, 0.0), ("b", [0.0, 1.0], 5.0, 1.0)], "trace_id string, z_mu array<double>, last_access_ts double, uncertainty double")
    f = spark.createDataFrame([("s", "a", 0.5), ("gone", "x", 1.0), ("", "b", 1.0)], "session_id string, trace_id string, weight double")
    ask = spark.createDataFrame([("s",), ("gone",), ("",), ("new",)], "session_id string")
    last = spark.createDataFrame([("a", 1.0), ("b", 1.0)], "trace_id string, weight double")
    got = {r["session_id"]: r["vector"] for r in retrieve.frontier_summary(f, t, 5.0, ask, last, 2).collect()}
    both = pytest.approx([1 / 3, 2 / 3])
    assert got == {"s": [1.0, 0.0], "gone": [0.0, 0.0], "": both, "new": both}
    assert {tuple(r["vector"]) for r in retrieve.frontier_summary(f.limit(0), t, 5.0, ask, None, 2).collect()} == {(0.0, 0.0)}
