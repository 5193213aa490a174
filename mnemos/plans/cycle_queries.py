"""Queries of action scoring, mutation, the cycle and answering."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from mnemos.config import BudgetConfig
from mnemos.functions import vectors as V
from mnemos.operators import cycle, replay, turn, upkeep
from mnemos.operators.graph import link_frames
from mnemos.plans import views
from mnemos.plans.graph_queries import SUPPORT, cues
from mnemos.plans.scalar_queries import r6
from mnemos.plans.state_queries import fold_traces, workspaces
from mnemos.plans.views import with_views
from mnemos.sources.stages import Stages

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def _traces(spark, sf_dir):
    """The event traces in their whole form."""
    t = fold_traces(spark, sf_dir)
    none = F.array().cast("array<string>")
    return t.withColumns({"fidelity": 1.0 - 0.2 * (F.col("evidence") % 4), "compression_stage": (F.col("evidence") % 4).cast("int"), "member_ids": none, "path_signature": none, "parent_trace_id": F.lit(None).cast("string"), "spawned_from_frame": F.lit(None).cast("string")})


def _log(spark, sf_dir, stages=None):
    """The frame log with vectors: what is seen next is the target. With stages the linked frames are written; what a frame's
    own numbers give is made where it is read."""
    w = Window.partitionBy("session_id").orderBy("ts", "seq")
    f = link_frames(views.bare_frames(spark, sf_dir)).withColumn("_next", F.lead(F.struct("group_entropy", "pred_loss")).over(w))
    f = views.with_active(f if stages is None else stages.keep(f, "log"))
    vector = lambda of: V.l2_normalize(F.array(F.col(f"{of}group_entropy"), F.col(f"{of}pred_loss"), F.lit(0.5), F.lit(0.1)))
    return f.withColumns({"x": vector(""), "c": vector(""), "loss": F.col("pred_loss"), "target": F.when(F.col("_next").isNotNull(), vector("_next."))}).drop("_next")


def _groups(traces):
    g = views.groups_of(traces)
    same = lambda v: F.transform("ctx_mu", lambda m: F.transform(m, lambda _: v))
    return g.select("group_id", "member_ids", "alpha", "ctx_mu", same(F.col("ctx_sigma")).alias("ctx_sigma_diag"), "pred_success_ema", "temperature", "unresolved_mass", F.lit(0.0).alias("replay_alignment_ema"), "replay_tension_ema", "ambiguous_buffer", F.array().cast("array<array<double>>").alias("ambiguous_ctx_buffer"))


def _state(spark, sf_dir, stages):
    """Traces, groups, edges and the log, each written once: many stages read them, and would make them anew each time."""
    t, log = stages.keep(_traces(spark, sf_dir), "event-traces"), _log(spark, sf_dir, stages)
    return {"traces": t.drop("user_id"), "groups": stages.keep(_groups(t), "event-groups"), "edges": stages.keep(views.edges_of(log), "event-edges"), "frames": log}


def mt6(spark, sf_dir):
    """Every 97th event as a replay batch, scored against its session's traces with edges and groups."""
    stages = Stages(spark, "mt6")
    s = _state(spark, sf_dir, stages)
    f = stages.keep(s["frames"].where("next_trace_id is not null and seq % 97 = 3"), "batch")
    made = replay.replay_mutations(f, s["traces"], s["edges"], s["groups"], stages)[1]
    return made.select("frame_id", "action", "trace_id", r6("delta").alias("delta"))


def mt13(spark, sf_dir):
    """A whole cycle over the log, under a budget that makes it compress and prune."""
    stages = Stages(spark, "mt13")
    state = _state(spark, sf_dir, stages)
    state["anchors"] = stages.keep(state["frames"].groupBy("anchor_id").agg(F.max_by("x", "seq").alias("z")), "anchors")
    small = BudgetConfig(max_traces=0.75 * state["traces"].count(), max_edges=0.5 * state["edges"].count(), max_groups=1e9)
    done = upkeep.maintenance_cycle(state, 1706000000.0, 10, budget=small, stages=stages)
    return done.tables["traces"].select("trace_id", r6("evidence").alias("evidence"), r6("stability").alias("stability"), r6("fidelity").alias("fidelity"), r6("future_drift_ema").alias("future_drift_ema"))


def mt5_update(spark, sf_dir):
    """A batch's groups: proposals in their order, then the updates of all its frames."""
    stages = Stages(spark, "mt5")
    t = stages.keep(_traces(spark, sf_dir), "event-traces")
    f = stages.keep(_log(spark, sf_dir).where("next_trace_id is not null and seq % 97 = 3"), "batch")
    even = F.map_from_entries(F.transform("active_ids", lambda t: F.struct(t.alias("k"), (1.0 / F.size("active_ids")).alias("v"))))
    g, _, touched = replay.replay_groups(f.withColumn("activation", even), t.drop("user_id"), _groups(t).limit(0), stages)
    return g.join(touched, "group_id").select("group_id", F.array_join("member_ids", ",").alias("members"), F.transform("alpha", lambda a: F.round(a, 6)).alias("alpha"), r6("unresolved_mass").alias("unresolved_mass"))


def rd7(spark, sf_dir):
    c = cues(spark, sf_dir).select("cue_id", "session_id", F.col("cue_id").alias("text"), F.lit(1.0).alias("ts"))
    _, events = cycle.respond_batch(c, workspaces(spark, sf_dir), c.select("cue_id", F.concat(F.lit(" answer to "), "cue_id").alias("answer")))
    return events.select("session_id", "turn_id", "source", "payload")


def mt11(spark, sf_dir):
    f = views.frames(spark, sf_dir)
    past = f.select("frame_id", F.explode("activation").alias("trace_id", "a"))
    even = f.select("frame_id", F.explode("active_ids").alias("trace_id"), (1.0 / F.size("active_ids")).alias("a"))
    steps = f.where("next_trace_id is not null").select(F.col("trace_id").alias("src"), F.col("next_trace_id").alias("dst"))
    t = views.event_traces(spark, sf_dir)
    out = cycle.replay_objective(past, even, steps, views.edges(spark, sf_dir), views.groups(spark, sf_dir), t.where("evidence < 10"), t)
    return out.select(*(r6(c).alias(c) for c in out.columns))


def mt11_settled(spark, sf_dir):
    """The divergence of every frame of the log from itself settled anew, with edges and groups, by the traces as they are."""
    f = _log(spark, sf_dir)
    t = _traces(spark, sf_dir)
    state = {"traces": t.drop("user_id"), "edges": views.edges(spark, sf_dir), "groups": _groups(t)}
    settled = Stages(spark, "mt11").keep(turn.settled_frames(f, state), "settled")
    steps = f.where("next_trace_id is not null").select(F.col("trace_id").alias("src"), F.col("next_trace_id").alias("dst"))
    t = state["traces"]
    out = cycle.replay_objective(f.select("frame_id", F.explode("activation").alias("trace_id", "a")), settled, steps, state["edges"], state["groups"], t.where("evidence < 10"), t)
    return out.select(*(r6(c).alias(c) for c in out.columns))


QUERIES |= {"mt11_settled_objective": mt11_settled, "mt5_replay_groups": mt5_update, "mt6_replay_mutations": mt6, "mt11_replay_objective": mt11, "mt13_maintenance_cycle": mt13, "rd7_respond_batch": rd7}

ORACLES["mt11_replay_objective"] = with_views(f""", a AS (SELECT frame_id, trace_id AS own, len(active_ids) AS n, unnest(active_ids) AS t FROM v_frames), b AS (SELECT frame_id, CASE WHEN t = own THEN 0.6::DOUBLE ELSE 0.4::DOUBLE / (n - 1) END AS p, 1.0::DOUBLE / n AS q FROM a),
kl AS (SELECT frame_id, sum((p - q) * (ln(p) - ln(q))) / 2 AS kl FROM b GROUP BY ALL), sp AS (SELECT src, dst, least({SUPPORT}, 1) AS s FROM v_edges GROUP BY ALL),
g AS (SELECT avg(1 - s) AS gap FROM v_frames f JOIN sp ON sp.src = f.trace_id AND sp.dst = f.next_trace_id), h AS (SELECT avg(replay_tension_ema + 0.5::DOUBLE * unresolved_mass) AS heat FROM v_groups), c AS (SELECT count(*) FILTER (evidence < 10) / count(*) AS churn FROM v_etraces), k AS (SELECT avg(kl) AS kl FROM kl)
SELECT round(kl, 6) AS activation_kl, round(gap, 6) AS transition_gap, round(heat, 6) AS group_heat, round(churn, 6) AS churn, round(kl + gap + churn, 6) AS drift FROM k, g, h, c""", "v_frames", "v_etraces", "v_edges", "v_groups")
