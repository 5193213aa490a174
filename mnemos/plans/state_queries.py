"""Queries of groups, roles, the read-out, the folds, the transition model and the snapshots."""

from __future__ import annotations

import uuid

import numpy as np
from pyspark.sql import Window
from pyspark.sql import functions as F

from mnemos.functions import vectors as V
from mnemos.functions.encode import encode_text
from mnemos.kernels.settle import entmax
from mnemos.operators import folds, groups, objective, readout, retrieve, roles
from mnemos.plans import views
from mnemos.plans.graph_queries import cues
from mnemos.plans.scalar_queries import _MASS, r6
from mnemos.plans.views import with_views
from mnemos.sources import snapshots
from mnemos.sources.stages import Stages, shared_dir

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def keep(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return keep


# pairs of traces that follow each other in a session, judged at the second one's vector
def trace_pairs(spark, sf_dir):
    t = views.traces(spark, sf_dir)
    names = ["trace_id", "evidence", "stability", "uncertainty", "z_mu", "z_sigma_diag", "ctx_mu", "ctx_sigma_diag", "last_access_ts"]
    s = F.struct(*names)
    w = Window.partitionBy("session_id").orderBy("last_access_ts")
    p = t.select(s.alias("a"), F.lead(s).over(w).alias("b")).where("b is not null")
    return p.withColumns({"x": F.col("b.z_mu"), "c": F.col("b.z_mu")})


def _even(x: str, mu: str, var: str) -> str:
    return f"(-0.5::DOUBLE * ((list_dot_product({x}, {x}) - 2 * list_dot_product({x}, {mu}) + list_dot_product({mu}, {mu})) / {var} + len({x}) * (ln({var}) + ln(2 * pi()))))"


_PAIRS = f""", o AS (SELECT *, lead(trace_id) OVER (PARTITION BY session_id ORDER BY last_access_ts) AS nxt FROM v_traces),
pp AS (SELECT a.trace_id AS ta, b.trace_id AS tb, a.z_mu AS am, b.z_mu AS x, a.evidence AS ea, b.evidence AS eb, a.z_sigma_diag[1] AS va, b.z_sigma_diag[1] AS vb, 0.75::DOUBLE * a.stability - 0.5::DOUBLE * a.uncertainty AS pa, 0.75::DOUBLE * b.stability - 0.5::DOUBLE * b.uncertainty AS pb FROM o a JOIN o b ON b.trace_id = a.nxt),
j AS (SELECT *, ln(ea + 1e-8) + pa + {_even('x', 'am', '0.6::DOUBLE')} + {_even('x', 'am', 'va')} AS l, ln(eb + 1e-8) + pb + {_even('x', 'x', '0.6::DOUBLE')} + {_even('x', 'x', 'vb')} AS r,
  unnest(range(1, len(x) + 1)) AS i FROM pp),
dims AS (SELECT ta, tb, any_value(l) AS l, any_value(r) AS r, any_value(ea) AS ea, any_value(eb) AS eb, any_value(list_dot_product(am, x) / (sqrt(list_dot_product(am, am)) * sqrt(list_dot_product(x, x)))) AS cosine,
  sum(ln(2 * pi()) + ln((ea * (va + pow(am[i] - (ea * am[i] + eb * x[i]) / (ea + eb), 2)) + eb * (vb + pow(x[i] - (ea * am[i] + eb * x[i]) / (ea + eb), 2))) / (ea + eb)) + pow(x[i] - (ea * am[i] + eb * x[i]) / (ea + eb), 2) / ((ea * (va + pow(am[i] - (ea * am[i] + eb * x[i]) / (ea + eb), 2)) + eb * (vb + pow(x[i] - (ea * am[i] + eb * x[i]) / (ea + eb), 2))) / (ea + eb))) AS qz,
  sum(ln(2 * pi()) + ln((ea * (0.6::DOUBLE + pow(am[i] - (ea * am[i] + eb * x[i]) / (ea + eb), 2)) + eb * (0.6::DOUBLE + pow(x[i] - (ea * am[i] + eb * x[i]) / (ea + eb), 2))) / (ea + eb)) + pow(x[i] - (ea * am[i] + eb * x[i]) / (ea + eb), 2) / ((ea * (0.6::DOUBLE + pow(am[i] - (ea * am[i] + eb * x[i]) / (ea + eb), 2)) + eb * (0.6::DOUBLE + pow(x[i] - (ea * am[i] + eb * x[i]) / (ea + eb), 2))) / (ea + eb))) AS qc FROM j GROUP BY ta, tb),
bf AS (SELECT ta, tb, greatest(l, r) + ln(1 + exp(-abs(l - r))) - (ln(ea + eb + 1e-8) - 0.5::DOUBLE * (qz + qc)) AS bf, 0.5::DOUBLE * (1 + cosine) AS overlap FROM dims)"""


@query("ag13_separate_pairs", with_views(_PAIRS + " SELECT ta, tb, round(bf, 6) AS bf, round(overlap, 6) AS overlap FROM bf", "v_traces"))
def ag13(spark, sf_dir):
    return groups.separate_pairs(trace_pairs(spark, sf_dir)).select(F.col("a.trace_id").alias("ta"), F.col("b.trace_id").alias("tb"), r6("bf").alias("bf"), r6("overlap").alias("overlap"))


@query("in3_inhibit_pairs", with_views(_PAIRS + " SELECT ta AS src, tb AS dst, round(0.25::DOUBLE * greatest(bf, 0), 6) AS delta, 0.05::DOUBLE * bf > 0.2 AND overlap > 0.55 AS propose FROM bf UNION ALL SELECT tb, ta, round(0.25::DOUBLE * greatest(bf, 0), 6), 0.05::DOUBLE * bf > 0.2 AND overlap > 0.55 FROM bf", "v_traces"))
def in3(spark, sf_dir):
    return groups.inhibit_pairs(groups.separate_pairs(trace_pairs(spark, sf_dir))).select("src", "dst", r6("delta").alias("delta"), "propose")


@query("in4_create_groups", with_views(" SELECT DISTINCT trace_id AS first, next_trace_id AS second FROM v_frames f WHERE trace_id < next_trace_id AND NOT EXISTS (SELECT 1 FROM v_groups g WHERE list_contains(g.member_ids, f.trace_id) AND list_contains(g.member_ids, f.next_trace_id))", "v_frames", "v_groups"))
def in4(spark, sf_dir):
    pairs = views.frames(spark, sf_dir).where("trace_id < next_trace_id").select(F.col("trace_id").alias("first"), F.col("next_trace_id").alias("second"))
    return groups.create_groups(pairs, views.groups(spark, sf_dir)).select(F.col("member_ids")[0].alias("first"), F.col("member_ids")[1].alias("second"))


@query("ag14_unresolved_clusters", with_views(""", h AS (SELECT trace_id, unnest(z) AS v, generate_subscripts(z, 1) AS i FROM (SELECT trace_id, unnest(anchor_reservoir) AS anchor_id FROM v_traces WHERE uncertainty >= 0.35) JOIN v_anchors USING (anchor_id)), s AS (SELECT trace_id, i, avg(v) AS m, var_pop(v) AS var, count(*) AS n FROM h GROUP BY ALL)
SELECT trace_id AS group_id, 'm2' AS parent, CAST(max(n) AS DOUBLE) AS evidence, round(sum(m), 6) AS mu_sum, round(sum(var + 1e-4), 6) AS var_sum, 1.0::DOUBLE AS fidelity FROM s GROUP BY trace_id HAVING max(n) >= 3 AND avg(var) <= 0.35""", "v_anchors", "v_traces"))
def ag14(spark, sf_dir):
    g = views.traces(spark, sf_dir).select(F.col("trace_id").alias("group_id"), F.col("uncertainty").alias("unresolved_mass"), F.col("anchor_reservoir").alias("ambiguous_buffer"), F.array(F.lit("m1"), F.lit("m2")).alias("member_ids"), F.array(F.lit(1.0), F.lit(2.0), F.lit(0.5)).alias("alpha"))
    out = groups.unresolved_clusters(g, views.anchors(spark, sf_dir))
    return out.select("group_id", "parent", "evidence", r6(V.vsum(F.col("z_mu"))).alias("mu_sum"), r6(V.vsum(F.col("z_sigma_diag"))).alias("var_sum"), r6("fidelity").alias("fidelity"))


_ROLE = "pow(greatest({l}, 0) - least(greatest(support + greatest(gain, 0), 0), 4), 2)"
_COST = "((0.35::DOUBLE + 0.65::DOUBLE * fidelity) * (1 + 0.05::DOUBLE * {m} + 0.05::DOUBLE * n_path))"


@query("mt9_accept_role", with_views(f", d AS (SELECT trace_id, 0.03::DOUBLE * ({_ROLE.format(l='least(logit + 0.2::DOUBLE, 4)')} - {_ROLE.format(l='logit')}) AS up, 0.03::DOUBLE * ({_ROLE.format(l='greatest(logit - 0.2::DOUBLE, 0)')} - {_ROLE.format(l='logit')}) + 0.05::DOUBLE * ({_COST.format(m='CASE WHEN logit - 0.2::DOUBLE <= 0.1 THEN 0 ELSE n_members END')} - {_COST.format(m='n_members')}) AS down FROM v_traces) SELECT trace_id, round(up, 6) AS promote_delta, up < 0 AS promoted, round(down, 6) AS decay_delta, down <= 0 AS demoted FROM d", "v_traces"))
def mt9(spark, sf_dir):
    t = roles.accept_decay(roles.accept_promotion(views.traces(spark, sf_dir)), pressure=1.0)
    return t.select("trace_id", r6("promote_delta").alias("promote_delta"), "promoted", r6("decay_delta").alias("decay_delta"), "demoted")


@query("mt5_replay_group_pairs", with_views(", g AS (SELECT unnest(member_ids) AS t FROM v_groups), a AS (SELECT frame_id, active_ids[1] AS first, active_ids[2] AS second, CASE len(active_ids) WHEN 2 THEN 0.2::DOUBLE ELSE 0.4::DOUBLE END AS gap FROM v_frames WHERE trace_id NOT IN (SELECT t FROM g)) SELECT frame_id, first, second, round(gap, 6) AS gap FROM a WHERE gap <= 0.25", "v_frames", "v_groups"))
def mt5(spark, sf_dir):
    f = views.frames(spark, sf_dir)
    member = views.groups(spark, sf_dir).select(F.explode("member_ids").alias("trace_id"))
    rows = f.join(member, "trace_id", "left_anti").select(F.col("frame_id").alias("obs_id"), F.explode("activation").alias("trace_id", "resp"))
    return objective.ambiguity_pairs(rows, 0.25).select(F.col("obs_id").alias("frame_id"), "first", "second", r6("gap").alias("gap"))


@query("io7_list_operations", "SELECT event_id AS op_id, event_type AS op_kind, json_extract_string(props, '$.k') AS k FROM events ORDER BY event_id DESC LIMIT 50")
def io7(spark, sf_dir):
    ops = views.read(spark, sf_dir, "events").select(F.col("event_id").alias("op_id"), F.col("event_type").alias("op_kind"), F.col("props").alias("payload"))
    return snapshots.list_operations(ops).select("op_id", "op_kind", F.col("payload")["k"].alias("k"))


@query("ag10_field_stats", with_views(" SELECT 'anchors' AS name, count(*) AS rows FROM v_anchors UNION ALL SELECT 'traces', count(*) FROM v_traces UNION ALL SELECT 'edges', count(*) FROM v_edges UNION ALL SELECT 'groups', count(*) FROM v_groups UNION ALL SELECT 'frames', count(*) FROM v_frames", "v_anchors", "v_traces", "v_edges", "v_groups", "v_frames"))
def ag10(spark, sf_dir):
    return snapshots.field_stats(anchors=views.anchors(spark, sf_dir), traces=views.traces(spark, sf_dir), edges=views.edges(spark, sf_dir), groups=views.groups(spark, sf_dir), frames=views.frames(spark, sf_dir))


# reading
def biased(spark, sf_dir, size: int = 8):
    near = retrieve.make_candidates(cues(spark, sf_dir), views.traces(spark, sf_dir), size)
    c = cues(spark, sf_dir).withColumnsRenamed({"z": "cue"}).withColumns({"frontier": F.col("cue"), "predicted": F.col("cue")})
    t = views.traces(spark, sf_dir).withColumnRenamed("session_id", "trace_session")
    return near.join(c, "cue_id").join(t, "trace_id").withColumn("bias", readout.cue_bias())


@query("rd1_cue_bias", with_views(f", p AS (SELECT a.anchor_id AS cue_id, a.z, t.* FROM v_anchors a JOIN v_traces t ON a.session_id = t.session_id) SELECT cue_id, trace_id, round(ln(evidence + 1e-8) + 0.75::DOUBLE * stability - 0.5::DOUBLE * uncertainty + 1.6::DOUBLE * list_dot_product(z, z_mu) / (sqrt(list_dot_product(z, z)) * sqrt(list_dot_product(z_mu, z_mu))) + 0.2::DOUBLE * {_even('z', 'ctx_mu', '0.6::DOUBLE')} / 64 + 0.1::DOUBLE * {_MASS} + 0.08::DOUBLE * fidelity + 0.25::DOUBLE, 6) AS bias FROM p", "v_anchors", "v_traces"))
def rd1(spark, sf_dir):
    c = cues(spark, sf_dir).withColumns({"cue": F.col("z"), "frontier": F.col("z"), "predicted": F.col("z")})
    return readout.all_biases(c, views.traces(spark, sf_dir)).select("cue_id", "trace_id", r6("bias").alias("bias"))


def session_candidates(spark, sf_dir):
    return views.event_traces(spark, sf_dir).select(F.col("session_id").alias("cue_id"), "trace_id")


_INSIDE = ", i AS (SELECT split_part(src, ':', 1) AS cue_id, dst AS target, src AS source, sum(weight) AS w FROM v_edges GROUP BY ALL), n AS (SELECT *, w / greatest(sum(w) OVER (PARTITION BY cue_id, target), 1) AS wn FROM i), m AS (SELECT *, sum(wn) OVER (PARTITION BY cue_id, target) AS rs FROM n), x AS (SELECT *, max(rs) OVER (PARTITION BY cue_id) AS most FROM m)"


@query("rd2_candidate_edges", with_views(_INSIDE + " SELECT cue_id, target, source, 1 AS sign, round(wn * CASE WHEN most > 0.95 THEN 0.95::DOUBLE / most ELSE 1 END, 6) AS weight FROM x", "v_edges"))
def rd2(spark, sf_dir):
    return readout.candidate_edges(session_candidates(spark, sf_dir), views.edges(spark, sf_dir)).withColumn("weight", r6("weight"))


@query("rd3_relevant_groups", with_views(" SELECT 'u' || user_id AS cue_id, group_id, array_to_string(list_sort(member_ids), ',') AS present FROM v_groups", "v_groups"))
def rd3(spark, sf_dir):
    return readout.relevant_groups(session_candidates(spark, sf_dir), views.groups(spark, sf_dir)).withColumn("present", F.array_join("present", ","))


def workspaces(spark, sf_dir):
    # written once: nest_cues reads it three times
    scored = Stages(spark, "read").keep(biased(spark, sf_dir).select("cue_id", "trace_id", "rank", "bias"), "scored")
    e = views.traces(spark, sf_dir)
    w = Window.partitionBy("session_id").orderBy("last_access_ts")
    links = e.select(F.col("trace_id").alias("src"), F.lead("trace_id").over(w).alias("dst"), F.lit("assoc").alias("kind"), F.col("uncertainty").alias("weight")).where("dst is not null")
    return readout.settle_workspaces(readout.nest_cues(scored, links))


@query("rd5_settle_workspaces")
def rd5(spark, sf_dir):
    return workspaces(spark, sf_dir).select("cue_id", "active_ids", F.transform("weights", lambda x: F.round(x, 6)).alias("weights"), "iterations", r6("energy").alias("energy"))


@query("rd6_read_workspaces")
def rd6(spark, sf_dir):
    """Text cues end to end: encoded, scored against all traces, settled, summed up."""
    c = views.read(spark, sf_dir, "conversations").where("role = 'user'").select(F.concat_ws("-", "conv_id", "turn").alias("cue_id"), F.lit("").alias("session_id"), encode_text(F.col("text"), 64).alias("z")).withColumn("context", F.col("z"))
    stages = Stages(spark, "read")
    c, t = stages.keep(c, "cues"), views.traces(spark, sf_dir)  # encoded once
    near = retrieve.make_candidates(c, t, 16).join(c.withColumnsRenamed({"z": "cue"}).withColumns({"frontier": F.col("cue"), "predicted": F.col("cue")}), "cue_id").join(t.withColumnRenamed("session_id", "trace_session"), "trace_id")
    scored = stages.keep(near.select("cue_id", "trace_id", "rank", readout.cue_bias().alias("bias")), "scored")
    none = t.select(F.col("trace_id").alias("src"), F.col("trace_id").alias("dst"), F.lit("assoc").alias("kind"), F.lit(0.0).alias("weight"))
    out = readout.settle_workspaces(readout.nest_cues(scored, none))
    return out.select("cue_id", F.size("active_ids").alias("active"), readout.render_workspace().alias("text"))


@query("sc6_entmax")
def sc6(spark, sf_dir):
    @F.pandas_udf("array<double>")
    def sparse(logits):
        return logits.map(lambda x: entmax(np.asarray(x)).round(6).tolist())

    return views.anchors(spark, sf_dir).select("anchor_id", sparse(V.vscale(F.col("z"), 8.0)).alias("probs"))


@query("sc15_render_workspace", with_views(" SELECT frame_id, 'ongoing_context:' || chr(10) || array_to_string(list_transform(active_ids, lambda t: '- trace:' || t || ' weight=0.2500'), chr(10)) || chr(10) || 'salient_episodes:' || chr(10) || array_to_string(list_transform(active_ids, lambda t: '- trace:' || t), chr(10)) || chr(10) || 'active_hypotheses:' || chr(10) || '- none' || chr(10) || 'relevant_procedures:' || chr(10) || '- none' || chr(10) || 'provenance_anchors:' || chr(10) || '- ' || anchor_id AS text FROM v_frames", "v_frames"))
def sc15(spark, sf_dir):
    f = views.frames(spark, sf_dir).withColumn("weights", F.transform("active_ids", lambda _: F.lit(0.25)))
    return f.select("frame_id", readout.render_workspace(provenance=F.array("anchor_id")).alias("text"))


@query("sc16_prompts_and_answers", "SELECT conv_id, turn, 'system' AS first_role, 'Answer briefly.' || chr(10) || chr(10) || trim(role) AS head, text AS cue, CASE WHEN turn % 3 = 2 THEN NULL ELSE regexp_replace(text, '^\\s+|\\s+$', '', 'g') END AS answer FROM conversations")
def sc16(spark, sf_dir):
    c = views.read(spark, sf_dir, "conversations")
    raw = F.when(F.col("turn") % 3 == 0, F.col("text")).when(F.col("turn") % 3 == 1, F.concat(F.lit(" ```text\n"), F.col("text"), F.lit("\n``` "))).otherwise("  \n")
    p = c.withColumns({"p": readout.build_prompts("Answer briefly.\n", F.col("role"), F.col("text")), "answer": readout.clean_response(raw)})
    return p.select("conv_id", "turn", F.col("p")[0]["role"].alias("first_role"), F.col("p")[0]["content"].alias("head"), F.col("p")[1]["content"].alias("cue"), "answer")


# folds and the transition model
def fold_traces(spark, sf_dir):
    return views.event_traces(spark, sf_dir).withColumns({"z_sigma_diag": F.array_repeat(F.lit(0.4), 4), "ctx_mu": F.col("z_mu"), "ctx_sigma_diag": F.array_repeat(F.lit(0.6), 4), "anchor_reservoir": F.array().cast("array<string>")})


def fold_steps(spark, sf_dir):
    f = views.frames(spark, sf_dir).withColumn("x", V.l2_normalize(F.array(F.col("group_entropy"), F.col("pred_loss"), F.lit(0.5), F.lit(0.1))))
    return f.select(F.explode("activation").alias("trace_id", "r"), "x", F.col("x").alias("c"), F.col("pred_loss").alias("loss"), "ts", "seq", "anchor_id")


@query("in5_update_groups")
def in5(spark, sf_dir):
    t = fold_traces(spark, sf_dir)
    g = views.groups(spark, sf_dir)
    f = fold_steps(spark, sf_dir).where("r = 0.6").withColumn("group_id", F.concat(F.lit("g"), F.substring(F.split("trace_id", ":")[0], 2, 20)))
    out = folds.update_groups(g, t, f)
    return out.select("group_id", F.transform("alpha", lambda a: F.round(a, 6)).alias("alpha"), r6("temperature").alias("temperature"), r6("unresolved_mass").alias("unresolved_mass"), F.size("ambiguous_buffer").alias("buffered"), F.transform("inflation", lambda a: F.round(a, 6)).alias("inflation"))


@query("mt3_reconsolidate")
def mt3(spark, sf_dir):
    out = folds.reconsolidate(fold_traces(spark, sf_dir), fold_steps(spark, sf_dir))
    return out.select("trace_id", r6("evidence").alias("evidence"), r6("stability").alias("stability"), r6("uncertainty").alias("uncertainty"), r6(V.vsum(F.col("z_mu"))).alias("mu_sum"), F.array_join("anchor_reservoir", ",").alias("reservoir"))


@query("in2_apply_actions")
def in2(spark, sf_dir):
    kind = F.element_at(F.array(*map(F.lit, ("ASSIMILATE", "ATTACH", "SPLIT", "BIRTH"))), (F.col("seq") % 4 + 1).cast("int"))
    d = fold_steps(spark, sf_dir).where("r = 0.6").withColumn("action", kind)
    out = folds.apply_actions(fold_traces(spark, sf_dir), d)
    return out.select("trace_id", r6("evidence").alias("evidence"), r6("access_ema").alias("access_ema"), r6(V.vsum(F.col("z_mu"))).alias("mu_sum"), r6(V.vsum(F.col("z_sigma_diag"))).alias("var_sum"))


_SUP = "least(greatest(t, CASE WHEN has THEN a / (a + b) ELSE 0 END, 0), 1)"
_TAKE = f"(s > 0.70 AND CASE WHEN has THEN 0 ELSE 0.05::DOUBLE * 0.115::DOUBLE + 0.03::DOUBLE * 0.15::DOUBLE END + 0.08::DOUBLE * (1 - greatest({_SUP}, s)) < 0.08::DOUBLE * (1 - {_SUP}))"


@query("eg4_option_edges", with_views(f""", tr AS (SELECT trace_id AS src, next_trace_id AS dst, 1 - least(pred_loss, 1) AS s, row_number() OVER (PARTITION BY trace_id, next_trace_id ORDER BY ts, seq) AS n FROM v_frames WHERE next_trace_id IS NOT NULL),
f AS (SELECT src, dst, CAST(0 AS BIGINT) AS n, weight / 4 AS t, 0.0::DOUBLE AS w, 1.0::DOUBLE AS a, 1.0::DOUBLE AS b, false AS has, 0 AS taken FROM v_edges WHERE kind = 'temporal'
UNION ALL SELECT src, dst, n, t, CASE WHEN take THEN 0.075::DOUBLE * s + CASE WHEN has THEN 0.95::DOUBLE * w ELSE 0 END ELSE w END, CASE WHEN take THEN 0.98::DOUBLE * a + s ELSE a END, CASE WHEN take THEN 0.98::DOUBLE * b + 1 - s ELSE b END, has OR take, taken + CAST(take AS INTEGER)
  FROM (SELECT f.src, f.dst, tr.n, t, w, a, b, has, taken, s, {_TAKE} AS take FROM f JOIN tr ON tr.src = f.src AND tr.dst = f.dst AND tr.n = f.n + 1)),
last AS (SELECT *, row_number() OVER (PARTITION BY src, dst ORDER BY n DESC) AS r FROM f)
SELECT src, dst, round(w + 1e-9, 6) AS weight, round(a + 1e-9, 6) AS success_alpha, round(b + 1e-9, 6) AS success_beta, taken FROM last WHERE r = 1 AND has""", "v_frames", "v_edges", recursive=True))
def eg4(spark, sf_dir):
    f = views.frames(spark, sf_dir).where("next_trace_id is not null")
    t = f.select(F.col("trace_id").alias("src"), F.col("next_trace_id").alias("dst"), (1 - F.least("pred_loss", F.lit(1.0))).alias("success"), "ts", "seq")
    out = folds.option_edges(t, views.edges(spark, sf_dir).where("kind = 'temporal'").withColumn("weight", F.col("weight") / 4))
    off_the_edge = lambda c: F.round(F.col(c) + 1e-9, 6).alias(c)
    return out.select("src", "dst", *map(off_the_edge, ("weight", "success_alpha", "success_beta")), "taken")


def transitions(spark, sf_dir):
    e = views.frames(spark, sf_dir).where("next_trace_id is not null")
    w = Window.partitionBy("session_id").orderBy("ts", "seq")
    x = F.array("group_entropy", "pred_loss", F.lit(1.0))
    return e.select("frame_id", x.alias("x"), F.lead(F.array("pred_loss", "group_entropy")).over(w).alias("y")).where("y is not null")


@query("mt1_score_transitions")
def mt1(spark, sf_dir):
    from mnemos.kernels import predictor

    return folds.score_transitions(transitions(spark, sf_dir), predictor.init(3, 8, 2, seed=1)).select("frame_id", r6("nll").alias("nll"))


@query("mt2_fit_transition_model")
def mt2(spark, sf_dir):
    rows = transitions(spark, sf_dir)
    model, _ = folds.fit_transition_model(rows, steps=5, hidden=8, rate=0.05)
    return folds.score_transitions(rows, model).select("frame_id", r6("nll").alias("nll"))


@query("io3_snapshot_round_trip")
def io3(spark, sf_dir):
    path = scratch(spark)
    state = {"traces": views.traces(spark, sf_dir), "edges": views.edges(spark, sf_dir)}
    for step in (1, 2, 3):
        snapshots.write_snapshot(state if step == 3 else {"edges": state["edges"]}, path, step, "test")
    snapshots.prune_snapshots(spark, path, keep=2)
    got = snapshots.read_latest_snapshot(spark, path, latent_dim=64)
    snapshots.export_json({"traces": got["traces"]}, f"{path}/json")
    back = spark.read.json(f"{path}/json/traces").select("trace_id", "evidence", "anchor_reservoir")
    return back.select("trace_id", "evidence", F.size("anchor_reservoir").alias("held"))


def scratch(spark) -> str:
    return f"{shared_dir(spark)}/snapshots-{uuid.uuid4().hex}"
