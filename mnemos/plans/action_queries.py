"""Queries of action scoring and of the patch objective, with edges and groups, over anchors and traces in their order.

A session's traces and anchors are numbered in time. An anchor's candidates are the traces from ai div 4 on, five at most
(equi-joins on numbers, so a long session costs as much as it has anchors); its observations are the two anchors before it,
each aiming at the one that follows. Neighbouring traces have edges, and two by two they are groups.
"""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from mnemos.operators import actions, objective, readout
from mnemos.plans import views
from mnemos.plans.scalar_queries import _STORAGE, r6
from mnemos.plans.views import with_views
from mnemos.sources.stages import Stages

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def arena(spark, sf_dir):
    """anchors, pairs, traces, observations, edges and groups."""
    turn = Window.partitionBy("session_id").orderBy("last_access_ts")
    t = views.traces(spark, sf_dir).withColumn("ti", F.row_number().over(turn))
    w = Window.partitionBy("session_id").orderBy("ts")
    a = views.anchors(spark, sf_dir).where("session_id != ''").withColumns({"ai": F.row_number().over(w), "target": F.lag("z").over(w), "following": F.lead("z").over(w)})
    at = lambda n: F.explode(F.array(*map(F.lit, n)))
    pairs = a.select("anchor_id", "session_id", at(range(5)).alias("rank"), "ai").withColumn("ti", F.floor(F.col("ai") / 4) + F.col("rank")).join(t.select("session_id", "ti", "trace_id"), ["session_id", "ti"]).select("anchor_id", "trace_id", "rank")
    before = a.select("session_id", F.col("ai").alias("_ai"), F.col("z").alias("x"), F.col("z").alias("c"), F.col("following").alias("target"))
    obs = a.select("anchor_id", "session_id", at((1, 2)).alias("seq"), "ai").withColumn("_ai", F.col("ai") - F.col("seq")).join(before, ["session_id", "_ai"]).select("anchor_id", "seq", "x", "c", "target")
    s = F.struct("trace_id", "evidence", "z_mu", "uncertainty", "future_drift_ema")
    ahead = t.select("ti", s.alias("a"), F.lead(s).over(turn).alias("b"), F.lead("trace_id", 2).over(turn).alias("third"))
    edges = ahead.where("b is not null").select(F.col("a.trace_id").alias("src"), F.col("b.trace_id").alias("dst"), F.lit("temporal").alias("kind")).union(ahead.where("third is not null and ti % 2 = 1").select("a.trace_id", "third", F.lit("assoc")))
    zeros = F.transform("a.z_mu", lambda _: F.lit(0.0))
    groups = ahead.where("b is not null and ti % 2 = 1").select(
        F.concat(F.lit("grp_"), "a.trace_id").alias("group_id"), F.array("a.trace_id", "b.trace_id").alias("member_ids"), F.array(1 + F.col("a.evidence") / 10, 1 + F.col("b.evidence") / 10, F.lit(0.5)).alias("alpha"), F.array("a.z_mu", "b.z_mu", zeros).alias("ctx_mu"), F.lit(0.6).alias("ctx_sigma"),
        F.array(F.lit(0.5), F.lit(0.6), F.lit(0.1)).alias("pred_success_ema"), F.lit(1.0).alias("temperature"), F.col("a.future_drift_ema").alias("replay_tension_ema"), F.col("a.uncertainty").alias("unresolved_mass"), F.array().cast("array<string>").alias("ambiguous_buffer"), F.array().cast("array<string>").alias("ambiguous_ctx_buffer"),
    )
    return a.select("anchor_id", "session_id", "ts", F.col("z").alias("x"), F.col("z").alias("c"), "target"), pairs, t, obs, edges, groups


def in1(spark, sf_dir):
    a, pairs, t, obs, edges, groups = arena(spark, sf_dir)
    out = actions.score_actions(actions.nest_patches(a, pairs, t, obs, edges, groups))
    return out.select("anchor_id", "action", "trace_id", r6("objective").alias("objective"), r6("base").alias("base"), F.least("inhibit_first", "inhibit_second").alias("inhibit_a"), F.greatest("inhibit_first", "inhibit_second").alias("inhibit_b"))


def ag8(spark, sf_dir):
    a, pairs, t, obs, edges, groups = arena(spark, sf_dir)
    cands = pairs.join(t, "trace_id").withColumnRenamed("anchor_id", "patch_id")
    own = a.select("anchor_id", F.lit(0).alias("seq"), "x", "c", "target").union(obs)
    seen = own.select(F.col("anchor_id").alias("patch_id"), F.concat_ws("/", "anchor_id", "seq").alias("obs_id"), "x", "c", "target")
    out = objective.patch_objective(cands, seen, edges, groups, t)
    return out.select("patch_id", *(r6(c).alias(c) for c in ("surprise", "complexity", "slow_alignment", "drift", "group_kl", "fidelity", "role", "total")))


def rd4(spark, sf_dir):
    """Workspaces of the arena's anchors settled with edges and groups, and whether the groups changed what is active."""
    a, pairs, t, _, edges, groups = arena(spark, sf_dir)
    cues = a.select(F.col("anchor_id").alias("cue_id"), "session_id", F.col("x").alias("z"), F.col("c").alias("context"))
    rows = pairs.withColumnRenamed("anchor_id", "cue_id").join(cues, "cue_id").join(t.withColumnRenamed("session_id", "trace_session"), "trace_id").withColumns({"cue": F.col("z"), "frontier": F.col("z"), "predicted": F.col("z")})
    scored = Stages(spark, "read").keep(rows.select("cue_id", "trace_id", "rank", readout.cue_bias().alias("bias")), "scored")
    links = edges.withColumn("weight", F.lit(0.4))
    settled = readout.settle_workspaces(readout.nest_cues(scored, links, readout.cue_groups(cues, scored, groups, t)))
    plain = readout.settle_workspaces(readout.nest_cues(scored, links)).select("cue_id", F.col("active_ids").alias("_ids"))
    out = readout.describe_workspaces(settled, t).join(plain, "cue_id")
    rounded = lambda c: F.transform(c, lambda v: F.round(v, 6))
    return out.select("cue_id", F.array_join("active_ids", ",").alias("active"), rounded("weights").alias("weights"), r6("group_kl").alias("group_kl"), F.size("anchor_refs").alias("refs"), rounded("summary").alias("summary"), (F.col("active_ids") != F.col("_ids")).alias("changed"))


def _g(x: str, mu: str, var: str) -> str:
    return f"(-0.5::DOUBLE * (list_sum(list_transform(list_zip({x}, {mu}, {var}), lambda q: (q[1] - q[2]) * (q[1] - q[2]) / q[3] + ln(q[3]))) + len({x}) * ln(2 * pi())))"


def _iso(x: str, var: str) -> str:
    return f"(-0.5::DOUBLE * (list_dot_product({x}, {x}) / {var}::DOUBLE + len({x}) * (ln({var}::DOUBLE) + ln(2 * pi()))))"


def _prior(e: str, s: str, u: str) -> str:
    return f"(ln({e} + 1e-8) + 0.75::DOUBLE * {s} - 0.5::DOUBLE * {u})"


_PAIR = lambda f: f"list_transform(list_zip(i.{f}, j.{f}), lambda q: (i.evidence * q[1] + j.evidence * q[2]) / (i.evidence + j.evidence))"
_SPREAD = lambda v, f: f"list_transform(list_zip(i.{v}, j.{v}, i.{f}, j.{f}), lambda q: (i.evidence * (q[1] + pow(q[3] - (i.evidence * q[3] + j.evidence * q[4]) / (i.evidence + j.evidence), 2)) + j.evidence * (q[2] + pow(q[4] - (i.evidence * q[3] + j.evidence * q[4]) / (i.evidence + j.evidence), 2))) / (i.evidence + j.evidence))"
_OWN = lambda k: f"{_prior(f'{k}.evidence', f'{k}.stability', f'{k}.uncertainty')} + {_g('i.ax', f'{k}.ctx_mu', f'{k}.ctx_sigma_diag')} + {_g('i.ax', f'{k}.z_mu', f'{k}.z_sigma_diag')}"

#: The arena, and for each candidate its copies as the actions move it.
_ARENA = f""", t AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY last_access_ts) AS ti FROM v_traces),
a AS (SELECT *, row_number() OVER w AS ai, lag(z) OVER w AS target, lead(z) OVER w AS following FROM v_anchors WHERE session_id <> '' WINDOW w AS (PARTITION BY session_id ORDER BY ts)),
p AS (SELECT a.anchor_id, a.z AS ax, j AS rank, t.* FROM a, (SELECT unnest(range(0, 5)) AS j) js, t WHERE t.session_id = a.session_id AND t.ti = a.ai // 4 + j),
o AS (SELECT anchor_id, 0 AS seq, z AS x, target FROM a UNION ALL SELECT a.anchor_id, a.ai - b.ai, b.z, b.following FROM a JOIN a b ON a.session_id = b.session_id AND b.ai BETWEEN a.ai - 2 AND a.ai - 1),
ahead AS (SELECT ti, trace_id AS ta, evidence AS ea, z_mu AS za, uncertainty AS ua, future_drift_ema AS da, lead(trace_id) OVER w AS tb, lead(evidence) OVER w AS eb, lead(z_mu) OVER w AS zb, lead(trace_id, 2) OVER w AS tc FROM t WINDOW w AS (PARTITION BY session_id ORDER BY last_access_ts)),
e AS (SELECT ta AS src, tb AS dst, 0.1::DOUBLE AS cost FROM ahead WHERE tb IS NOT NULL UNION ALL SELECT ta, tc, 0.09::DOUBLE FROM ahead WHERE tc IS NOT NULL AND ti % 2 = 1),
g AS (SELECT 'grp_' || ta AS group_id, *, da + 0.5::DOUBLE * ua AS tension, 0.25::DOUBLE * 1.08::DOUBLE * (1 + 0.15::DOUBLE * ua) * (1 + 0.1::DOUBLE * da) AS cost FROM ahead WHERE tb IS NOT NULL AND ti % 2 = 1),
deg AS (SELECT trace_id, count(*) AS d FROM (SELECT src AS trace_id FROM e UNION ALL SELECT dst FROM e) GROUP BY ALL),
pe AS (SELECT anchor_id, count(*) AS n, sum(cost) AS cost FROM (SELECT DISTINCT p.anchor_id, e.src, e.dst, e.cost FROM p JOIN e ON p.trace_id IN (e.src, e.dst)) GROUP BY ALL),
pg AS (SELECT anchor_id, count(*) AS n, sum(cost) AS cost FROM (SELECT DISTINCT p.anchor_id, g.group_id, g.cost FROM p JOIN g ON p.trace_id IN (g.ta, g.tb)) GROUP BY ALL),
fixed AS (SELECT p.anchor_id, sum({_STORAGE}) + coalesce(any_value(pe.cost), 0) + coalesce(any_value(pg.cost), 0) AS storage, sum(ln(1 + coalesce(d, 0))) + coalesce(any_value(pg.n), 0) + 0.05::DOUBLE * coalesce(any_value(pe.n), 0) AS complexity,
  sum(greatest(0, 1 - fidelity) * (1 + 0.25::DOUBLE * compression_stage)) AS fidelity, sum(pow(greatest(logit, 0) - least(greatest(support + greatest(gain, 0), 0), 4), 2)) AS role
  FROM p LEFT JOIN deg USING (trace_id) LEFT JOIN pe ON pe.anchor_id = p.anchor_id LEFT JOIN pg ON pg.anchor_id = p.anchor_id GROUP BY p.anchor_id),
m1 AS (SELECT *, 0.2::DOUBLE / (1 + 4 * stability) AS eta, list_transform(list_zip(ctx_mu, ax), lambda q: q[1] + 0.1::DOUBLE * (q[2] - q[1])) AS c1, 0.995::DOUBLE * evidence + 1 AS ev1, list_transform(z_mu, lambda q: least(0.4::DOUBLE, 0.5::DOUBLE * z_sigma_diag[1])) AS sv FROM p),
m AS (SELECT *, list_transform(list_zip(z_mu, ax), lambda q: q[1] + eta * (q[2] - q[1])) AS z1, list_transform(list_zip(z_mu, ax, z_sigma_diag), lambda q: (1 - eta) * q[3] + eta * (q[2] - q[1]) * (q[2] - q[1])) AS v1,
  list_transform(list_zip(c1, ax, ctx_sigma_diag), lambda q: 0.9::DOUBLE * q[3] + 0.1::DOUBLE * (q[2] - q[1]) * (q[2] - q[1])) AS cv1 FROM m1),
lg AS (SELECT m.anchor_id, o.seq, o.target, rank, trace_id, future_alignment_ema AS fa, future_drift_ema AS fd, z_mu, z1, ax, {_g('x', 'z_mu', 'z_sigma_diag')} AS gx, {_g('x', 'z1', 'v1')} AS g1,
  {_prior('evidence', 'stability', 'uncertainty')} + {_g('x', 'ctx_mu', 'ctx_sigma_diag')} + {_g('x', 'z_mu', 'z_sigma_diag')} AS base, {_prior('ev1', 'stability', '(list_avg(v1) + 0.3::DOUBLE / (ev1 + 1e-8) + 0.8::DOUBLE * pred_loss_ema)')} + {_g('x', 'c1', 'cv1')} + {_g('x', 'z1', 'v1')} AS la,
  {_prior('ev1', 'stability', '(list_avg(z_sigma_diag) + 0.3::DOUBLE / (ev1 + 1e-8) + 0.8::DOUBLE * pred_loss_ema)')} + {_g('x', 'c1', 'cv1')} + {_g('x', 'z_mu', 'z_sigma_diag')} AS lt,
  {_prior('1', '0', '(list_avg(sv) + 0.3::DOUBLE / (1 + 1e-8))')} + {_g('x', 'ctx_mu', 'ctx_sigma_diag')} + {_g('x', 'ax', 'sv')} AS ls, x FROM m JOIN o USING (anchor_id)),
acts AS (SELECT anchor_id, -1 AS pos, 'NONE' AS act, NULL AS t, 0.0::DOUBLE AS plastic, 0.0::DOUBLE AS extra, 0.0::DOUBLE AS xfid FROM fixed UNION ALL SELECT anchor_id, 0, 'BIRTH', NULL, 0, 2, 0 FROM a
  UNION ALL SELECT anchor_id, 1 + 3 * rank + k, CASE k WHEN 0 THEN 'ASSIMILATE' WHEN 1 THEN 'ATTACH' ELSE 'SPLIT' END, trace_id, CASE k WHEN 0 THEN stability * list_avg(list_transform(list_zip(z1, z_mu), lambda q: pow(q[1] - q[2], 2))) ELSE 0 END,
    CASE k WHEN 2 THEN 0.35::DOUBLE + 0.65::DOUBLE * greatest(fidelity, 0.85::DOUBLE) + 1.1::DOUBLE ELSE 0 END, CASE k WHEN 2 THEN 1 - greatest(fidelity, 0.85::DOUBLE) ELSE 0 END FROM m, (SELECT unnest(range(0, 3)) AS k))"""

_SCORED = f""", en AS (SELECT acts.anchor_id, pos, act, acts.t, seq, trace_id AS s, rank, CASE WHEN trace_id = t AND act = 'ASSIMILATE' THEN la WHEN trace_id = t AND act = 'ATTACH' THEN lt ELSE base END AS l, fa, fd, CASE WHEN trace_id = t AND act = 'ASSIMILATE' THEN z1 ELSE z_mu END AS zz, target, x FROM acts JOIN lg ON lg.anchor_id = acts.anchor_id
  UNION ALL SELECT anchor_id, pos, act, t, seq, NULL, 99, ls, 0, 0, ax, target, x FROM acts JOIN lg USING (anchor_id) WHERE act = 'SPLIT' AND trace_id = t
  UNION ALL SELECT acts.anchor_id, pos, act, t, seq, NULL, 99, {_prior('1', '0', '(0.4::DOUBLE + 0.3::DOUBLE / (1 + 1e-8))')} + {_g('x', 'z', 'list_transform(z, lambda q: 0.6::DOUBLE)')} + {_g('x', 'z', 'list_transform(z, lambda q: 0.4::DOUBLE)')}, 0, 0, z, o.target, x FROM acts JOIN a ON a.anchor_id = acts.anchor_id JOIN o ON o.anchor_id = acts.anchor_id WHERE act = 'BIRTH'),
sums AS (SELECT *, max(l) OVER k AS top, ln(sum(exp(l - m)) OVER k) + m AS total FROM (SELECT *, max(l) OVER (PARTITION BY anchor_id, pos, seq) AS m FROM en) WINDOW k AS (PARTITION BY anchor_id, pos, seq)),
r AS (SELECT *, exp(l - total) AS resp FROM sums),
mix AS (SELECT anchor_id, pos, seq, i, sum(resp * v) AS v, any_value(y) AS y FROM (SELECT anchor_id, pos, seq, resp, unnest(zz) AS v, unnest(target) AS y, generate_subscripts(zz, 1) AS i FROM r WHERE target IS NOT NULL) GROUP BY ALL),
loss AS (SELECT anchor_id, pos, seq, (0.5::DOUBLE * (sum(pow(y - v, 2)) + count(*) * ln(2 * pi()))) / count(*) AS loss FROM mix GROUP BY ALL),
ob AS (SELECT anchor_id, pos, seq, any_value(total) AS total, any_value(2 * {_iso('x', '1.2')}) AS nul, sum(resp * fa) AS fa, sum(resp * fd) AS fd FROM r GROUP BY ALL),
gm AS (SELECT g.*, p1.anchor_id FROM g JOIN p p1 ON p1.trace_id = g.ta JOIN p p2 ON p2.trace_id = g.tb AND p2.anchor_id = p1.anchor_id),
gs AS (SELECT gm.anchor_id, acts.pos, l1.seq, gm.group_id, gm.tension, ra.resp AS pa, rb.resp AS pb,
    ln(1 + ea / 10 + 1e-8) + {_g('l1.x', 'za', 'list_transform(za, lambda q: 0.6::DOUBLE)')} + CASE WHEN acts.act = 'ASSIMILATE' AND acts.t = ta THEN l1.g1 ELSE l1.gx END + 0.15::DOUBLE * ln(0.5::DOUBLE + 1e-8) AS sa,
    ln(1 + eb / 10 + 1e-8) + {_g('l1.x', 'zb', 'list_transform(zb, lambda q: 0.6::DOUBLE)')} + CASE WHEN acts.act = 'ASSIMILATE' AND acts.t = tb THEN l2.g1 ELSE l2.gx END + 0.15::DOUBLE * ln(0.6::DOUBLE + 1e-8) AS sb,
    ln(0.5::DOUBLE + 1e-8) + {_iso('l1.x', '0.6')} + {_iso('l1.x', '1.2')} AS sn
  FROM gm JOIN acts ON acts.anchor_id = gm.anchor_id JOIN lg l1 ON l1.anchor_id = gm.anchor_id AND l1.trace_id = ta JOIN lg l2 ON l2.anchor_id = gm.anchor_id AND l2.trace_id = tb AND l2.seq = l1.seq
  JOIN r ra ON ra.anchor_id = gm.anchor_id AND ra.pos = acts.pos AND ra.seq = l1.seq AND ra.s = ta JOIN r rb ON rb.anchor_id = gm.anchor_id AND rb.pos = acts.pos AND rb.seq = l1.seq AND rb.s = tb),
ge AS (SELECT *, exp(sa - greatest(sa, sb, sn)) AS xa, exp(sb - greatest(sa, sb, sn)) AS xb, exp(sn - greatest(sa, sb, sn)) AS xn FROM gs),
gp AS (SELECT anchor_id, pos, seq, tension, [greatest(pa, 1e-8), greatest(pb, 1e-8), greatest(1 - pa - pb, 1e-8)] AS pp, [greatest(xa / (xa + xb + xn), 1e-8), greatest(xb / (xa + xb + xn), 1e-8), greatest(xn / (xa + xb + xn), 1e-8)] AS qq FROM ge),
gk AS (SELECT anchor_id, pos, seq, sum(tension + list_sum(list_transform(list_zip(pp, qq), lambda v: v[1] / list_sum(pp) * (ln(v[1] / list_sum(pp)) - ln(v[2] / list_sum(qq)))))) AS kl FROM gp GROUP BY ALL),
av AS (SELECT anchor_id, pos, avg(-(greatest(total, nul) + ln(1 + exp(-abs(total - nul))))) AS surprise, 0.5::DOUBLE * avg(fa) + coalesce(sum(loss), 0) / greatest(count(loss), 1) AS align, 0.5::DOUBLE * avg(fd) AS fdrift, avg(coalesce(kl, 0)) AS group_kl
  FROM ob LEFT JOIN loss USING (anchor_id, pos, seq) LEFT JOIN gk USING (anchor_id, pos, seq) GROUP BY ALL),
tot AS (SELECT anchor_id, pos, act, t, surprise, coalesce(storage, 0) + extra AS storage, coalesce(complexity, 0) AS complexity, plastic, align, plastic + fdrift AS drift, group_kl, coalesce(fidelity, 0) + xfid AS fidelity, coalesce(role, 0) AS role,
  surprise + 0.05::DOUBLE * (coalesce(storage, 0) + extra) + 0.03::DOUBLE * coalesce(complexity, 0) + 0.1::DOUBLE * plastic + 0.18::DOUBLE * align + 0.08::DOUBLE * (plastic + fdrift) + 0.25::DOUBLE * group_kl + 0.05::DOUBLE * (coalesce(fidelity, 0) + xfid) + 0.03::DOUBLE * coalesce(role, 0) AS total
  FROM av JOIN acts USING (anchor_id, pos) LEFT JOIN fixed USING (anchor_id))"""

_CHOSEN = f""", mr AS (SELECT anchor_id, pos, s, rank, avg(resp) AS w FROM r WHERE pos >= 0 GROUP BY ALL), rk AS (SELECT *, row_number() OVER (PARTITION BY anchor_id, pos ORDER BY w DESC, rank) AS n FROM mr),
tops AS (SELECT anchor_id, pos, max(s) FILTER (n = 1) AS s1, max(s) FILTER (n = 2) AS s2, max(w) FILTER (n = 1) - max(w) FILTER (n = 2) AS gap FROM rk WHERE n <= 2 GROUP BY ALL HAVING count(s) = 2),
close AS (SELECT anchor_id, pos, least(s1, s2) AS s1, greatest(s1, s2) AS s2 FROM tops WHERE gap <= 0.15),
bf AS (SELECT i.anchor_id, i.trace_id AS s1, j.trace_id AS s2, ln(exp({_OWN('i')} - greatest({_OWN('i')}, {_OWN('j')})) + exp({_OWN('j')} - greatest({_OWN('i')}, {_OWN('j')}))) + greatest({_OWN('i')}, {_OWN('j')})
  - (ln(i.evidence + j.evidence + 1e-8) + {_g('i.ax', _PAIR('ctx_mu'), _SPREAD('ctx_sigma_diag', 'ctx_mu'))} + {_g('i.ax', _PAIR('z_mu'), _SPREAD('z_sigma_diag', 'z_mu'))}) AS bf FROM p i JOIN p j ON i.anchor_id = j.anchor_id AND i.trace_id < j.trace_id JOIN (SELECT DISTINCT anchor_id, s1, s2 FROM close) c ON c.anchor_id = i.anchor_id AND c.s1 = i.trace_id AND c.s2 = j.trace_id),
inh AS (SELECT anchor_id, pos, s1, s2, -0.3::DOUBLE * greatest(bf, 0) + 0.008::DOUBLE AS delta FROM close JOIN bf USING (anchor_id, s1, s2) WHERE -0.3::DOUBLE * greatest(bf, 0) + 0.008::DOUBLE < 0),
best AS (SELECT anchor_id, act, t, total + coalesce(delta, 0) AS total, s1, s2, row_number() OVER (PARTITION BY anchor_id ORDER BY total + coalesce(delta, 0), pos) AS n FROM tot LEFT JOIN inh USING (anchor_id, pos) WHERE pos >= 0)
SELECT b.anchor_id, b.act AS action, b.t AS trace_id, round(b.total, 6) AS objective, round(coalesce(z.total, 0), 6) AS base, s1 AS inhibit_a, s2 AS inhibit_b FROM best b LEFT JOIN tot z ON z.anchor_id = b.anchor_id AND z.pos = -1 WHERE n = 1"""

QUERIES |= {"rd4_project_groups": rd4, "in1_score_actions": in1, "ag8_patch_objective_groups": ag8}
ORACLES |= {
    "in1_score_actions": with_views(_ARENA + _SCORED + _CHOSEN, "v_anchors", "v_traces"),
    "ag8_patch_objective_groups": with_views(_ARENA + _SCORED + " SELECT anchor_id AS patch_id, round(surprise, 6) AS surprise, round(complexity, 6) AS complexity, round(align, 6) AS slow_alignment, round(drift, 6) AS drift, round(group_kl, 6) AS group_kl, round(fidelity, 6) AS fidelity, round(role, 6) AS role, round(total, 6) AS total FROM tot WHERE pos = -1", "v_anchors", "v_traces"),
}
