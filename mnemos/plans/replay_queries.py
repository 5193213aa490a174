"""Queries of the replay and maintenance operators."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import functions as F

from mnemos.config import REPLAY
from mnemos.functions import costs
from mnemos.functions import vectors as V
from mnemos.operators import graph, maintenance
from mnemos.plans import views
from mnemos.plans.graph_queries import SUPPORT
from mnemos.plans.objective_queries import _FRONTIER
from mnemos.plans.scalar_queries import _BUDGET_UTILITY, _FIDELITY_UTILITY, _MASS, _STORAGE, NOW, r6
from mnemos.plans.views import with_views

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
LATE = 1706000000.0


def query(name: str, sql: str | None = None):
    def keep(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return keep


@query("wn2_hot_traces", with_views(f"SELECT trace_id, round(evidence + access_ema + stability - uncertainty + {_MASS}, 6) AS score FROM v_traces ORDER BY evidence + access_ema + stability - uncertainty + {_MASS} DESC, trace_id LIMIT 16", "v_traces"))
def wn2(spark, sf_dir):
    return maintenance.hot_traces(views.traces(spark, sf_dir)).select("trace_id", r6("score").alias("score"))


@query("wn3_update_frontier", with_views(_FRONTIER + " SELECT session_id, trace_id, round(weight, 6) AS weight, CAST(row_number() OVER (PARTITION BY session_id ORDER BY weight DESC, trace_id) AS INTEGER) AS rank FROM f QUALIFY rank <= 2", "v_frames"))
def wn3(spark, sf_dir):
    return maintenance.update_frontier(views.frames(spark, sf_dir), 2).select("session_id", "trace_id", r6("weight").alias("weight"), "rank")


@query("wn4_local_frames", with_views(""", t AS (SELECT frame_id, session_id, ts, seq, unnest(list_distinct(list_filter([trace_id, next_trace_id] || active_ids, lambda x: x IS NOT NULL))) AS trace_id FROM v_frames),
n AS (SELECT session_id AS patch_id, frame_id, ts, seq, row_number() OVER (PARTITION BY session_id ORDER BY ts DESC, seq DESC) AS r FROM (SELECT DISTINCT session_id, frame_id, ts, seq FROM t WHERE trace_id = session_id || ':purchase' OR trace_id = session_id || ':error'))
SELECT patch_id, frame_id, CAST(row_number() OVER (PARTITION BY patch_id ORDER BY ts, seq) AS INTEGER) AS rank FROM n WHERE r <= 12""", "v_frames"))
def wn4(spark, sf_dir):
    f = views.frames(spark, sf_dir)
    one = f.select("session_id").distinct().select(F.col("session_id").alias("patch_id"), "session_id", F.explode(F.array(F.concat("session_id", F.lit(":purchase")), F.concat("session_id", F.lit(":error")))).alias("trace_id"))
    return maintenance.local_frames(one, f)


_PRIORITY = f""", dg AS (SELECT trace_id, count(*) AS degree FROM (SELECT unnest(list_distinct([src, dst])) AS trace_id FROM v_edges) GROUP BY 1),
pri AS (SELECT f.*, (t.pred_loss_ema + 1e-4) * pow(t.uncertainty + 1e-4, 0.8) * pow(f.group_entropy + 1e-4, 0.5) * pow(1 + coalesce(degree, 0), 0.4) * pow((1 + greatest({LATE} - t.last_access_ts, 0)) * (t.uncertainty + 1) / (t.evidence + 1) + 1e-4, 0.4) AS priority
FROM v_frames f JOIN v_etraces t USING (trace_id) LEFT JOIN dg USING (trace_id))"""


def prioritised(spark, sf_dir):
    return maintenance.replay_priority(views.frames(spark, sf_dir), views.event_traces(spark, sf_dir).drop("session_id"), views.edges(spark, sf_dir), LATE)


@query("wn6_replay_priority", with_views(_PRIORITY + " SELECT frame_id, round(priority, 6) AS priority FROM pri", "v_frames", "v_etraces", "v_edges"))
def wn6(spark, sf_dir):
    return prioritised(spark, sf_dir).select("frame_id", r6("priority").alias("priority"))


@query("wn7_sample_replay", with_views(_PRIORITY + """, k AS (SELECT frame_id, group_entropy, -ln((CAST('0x' || substr(md5('7:' || frame_id), 1, 12) AS BIGINT) + 1.0::DOUBLE) / (pow(2::DOUBLE, 48) + 1)) / priority AS key FROM pri WHERE next_trace_id IS NOT NULL),
a AS (SELECT frame_id, key FROM k ORDER BY key, frame_id LIMIT 19), b AS (SELECT frame_id, key FROM k WHERE group_entropy > 0.05 ORDER BY key, frame_id LIMIT 6), c AS (SELECT frame_id, key FROM k ORDER BY key, frame_id LIMIT 7), top AS (SELECT frame_id, key FROM k ORDER BY key, frame_id LIMIT 32),
u AS (SELECT frame_id, key, 0 AS i FROM (SELECT * FROM a UNION SELECT * FROM b UNION SELECT * FROM c) UNION ALL SELECT frame_id, key, 1 FROM top) SELECT frame_id FROM (SELECT frame_id, min(i) AS i, min(key) AS key FROM u GROUP BY ALL) ORDER BY i, key LIMIT 32""", "v_frames", "v_etraces", "v_edges"))
def wn7(spark, sf_dir):
    return maintenance.sample_replay(prioritised(spark, sf_dir), 32)


@query("wn8_degrade_fidelity", with_views(f""", a AS (SELECT *, {_STORAGE} AS cost, {_STORAGE} / (0.35::DOUBLE + 0.65::DOUBLE * fidelity) * (0.35::DOUBLE + 0.65::DOUBLE * greatest(0.15::DOUBLE, fidelity - 0.2::DOUBLE)) AS after FROM v_traces),
o AS (SELECT *, coalesce(sum(cost - after) OVER (ORDER BY {_FIDELITY_UTILITY} / cost, trace_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS freed FROM a WHERE {_MASS} < 0.75 AND fidelity > 0.15)
SELECT trace_id, round(greatest(0.15::DOUBLE, fidelity - 0.2::DOUBLE), 6) AS fidelity, compression_stage + 1 AS compression_stage, array_to_string(anchor_reservoir[-2:], ',') AS reservoir,
round(list_sum(list_transform(z_sigma_diag, lambda x: x * 1.25::DOUBLE)) / len(z_sigma_diag) + 0.3::DOUBLE / (evidence + 1e-8) + 0.8::DOUBLE * pred_loss_ema, 6) AS uncertainty FROM o WHERE (SELECT sum(cost) FROM a) - freed > 0.97::DOUBLE * (SELECT sum(cost) FROM a)""", "v_traces"))
def wn8(spark, sf_dir):
    t = views.traces(spark, sf_dir)
    cap = 0.97 * t.agg(F.sum(costs.storage_cost())).first()[0]
    return maintenance.degrade_fidelity(t, NOW, cap).select("trace_id", r6("fidelity").alias("fidelity"), "compression_stage", F.array_join("anchor_reservoir", ",").alias("reservoir"), r6("uncertainty").alias("uncertainty"))


@query("wn9_prune", with_views(f""", r AS (SELECT trace_id AS id, {_BUDGET_UTILITY} / {_STORAGE} AS s FROM v_traces WHERE {_MASS} < 0.75 AND fidelity <= 0.45), nt AS (SELECT count(*) AS n FROM v_traces), er AS (SELECT src || '>' || dst || ':' || kind AS id, (0.6::DOUBLE * support_ema + 0.3::DOUBLE * weight + 0.1::DOUBLE * bf_sep_ema) / CASE kind WHEN 'temporal' THEN 0.1::DOUBLE ELSE 0.115::DOUBLE END AS s FROM v_edges), ne AS (SELECT count(*) AS n FROM v_edges)
SELECT 'trace' AS what, id FROM (SELECT id, row_number() OVER (ORDER BY s, id) AS k FROM r) WHERE k <= least(floor((SELECT count(*) FROM r) * 0.3::DOUBLE) + 1, (SELECT n - n * 3 // 4 FROM nt))
UNION ALL SELECT 'edge', id FROM (SELECT id, row_number() OVER (ORDER BY s, id) AS k FROM er) WHERE k <= least(floor((SELECT count(*) FROM er) * 0.3::DOUBLE) + 1, (SELECT n - n // 2 FROM ne))""", "v_traces", "v_edges"))
def wn9(spark, sf_dir):
    t = views.traces(spark, sf_dir).withColumns({"score": costs.budget_utility(NOW) / costs.storage_cost(), "mass": costs.structural_role_mass()})
    e = views.edges(spark, sf_dir).withColumns({"id": F.concat("src", F.lit(">"), "dst", F.lit(":"), "kind"), "score": (0.60 * F.col("support_ema") + 0.30 * F.col("weight") + 0.10 * F.col("bf_sep_ema")) / costs.edge_storage_cost()})
    a = maintenance.prune(t, "score", "trace_id", "mass < 0.75 and fidelity <= 0.45", t.count() * 3 // 4, 1.2)
    b = maintenance.prune(e, "score", "id", "true", e.count() // 2, 1.2)
    return a.select(F.lit("trace").alias("what"), F.col("trace_id").alias("id")).union(b.select(F.lit("edge"), "id"))


@query("mt4_continuation_stats", with_views(f""", sp AS (SELECT src AS trace_id, dst AS next_trace_id, least({SUPPORT}, 1) AS support FROM v_edges GROUP BY ALL), fr AS (SELECT f.*, support FROM v_frames f LEFT JOIN sp USING (trace_id, next_trace_id)),
al AS (SELECT trace_id, CASE WHEN next_trace_id IS NULL THEN 0 ELSE pred_loss END AS v FROM fr UNION ALL SELECT next_trace_id, 0.5::DOUBLE * pred_loss FROM fr WHERE next_trace_id IS NOT NULL), a AS (SELECT trace_id, avg(greatest(v, 0)) AS al FROM al GROUP BY ALL), d AS (SELECT trace_id, avg(group_entropy + coalesce(1 - support, 0)) AS dr FROM fr GROUP BY ALL)
SELECT trace_id, round(0.97::DOUBLE * future_alignment_ema + 0.03::DOUBLE * al + 1e-9, 6) AS future_alignment_ema, round(0.97::DOUBLE * future_drift_ema + 0.03::DOUBLE * dr + 1e-9, 6) AS future_drift_ema FROM v_etraces JOIN a USING (trace_id) JOIN d USING (trace_id)""", "v_frames", "v_etraces", "v_edges"))
def mt4(spark, sf_dir):
    out = maintenance.continuation_stats(views.frames(spark, sf_dir), views.event_traces(spark, sf_dir), views.edges(spark, sf_dir))
    return out.select("trace_id", r6(F.col("future_alignment_ema") + 1e-9).alias("future_alignment_ema"), r6(F.col("future_drift_ema") + 1e-9).alias("future_drift_ema"))


@query("mt7_promote_prototypes", with_views(""", s AS (SELECT list_sort(active_ids[1:3]) AS m, count(*) AS support FROM v_frames GROUP BY ALL), l AS (SELECT m, n0 AS support, trace_id, z_mu, future_alignment_ema, future_drift_ema FROM (SELECT m, support AS n0, unnest(m) AS trace_id FROM s) JOIN v_etraces t USING (trace_id)),
x AS (SELECT m, trace_id, unnest(z_mu) AS v, generate_subscripts(z_mu, 1) AS i FROM l), c AS (SELECT m, i, avg(v) AS c FROM x GROUP BY ALL), d AS (SELECT m, trace_id, sum((v - c) * (v - c)) AS d FROM x JOIN c USING (m, i) GROUP BY ALL),
g AS (SELECT m, support, count(*) AS n, avg(d) AS dispersion, arg_min(trace_id, (d, trace_id)) AS medoid, avg(future_alignment_ema) AS fa, avg(future_drift_ema) AS fd FROM l JOIN d USING (m, trace_id) GROUP BY ALL HAVING count(*) >= 2)
SELECT array_to_string(m, ',') AS members, support, round(dispersion, 6) AS dispersion, round(n - 1 - dispersion - 0.25::DOUBLE * fa - 0.1::DOUBLE * fd, 6) AS gain, support >= 6 AND dispersion <= 0.3 AND n - 1 - dispersion - 0.25::DOUBLE * fa - 0.1::DOUBLE * fd >= 0.05 AS promoted FROM g""", "v_frames", "v_etraces"))
def mt7(spark, sf_dir):
    out = maintenance.prototype_patterns(views.frames(spark, sf_dir), views.event_traces(spark, sf_dir))
    return out.select("members", "support", r6("dispersion").alias("dispersion"), r6("gain").alias("gain"), "promoted")


@query("mt8_promote_procedures", with_views(""", s AS (SELECT trace_id AS src, next_trace_id AS dst, count(*) AS support, avg(1 - least(pred_loss, 1)) AS success FROM v_frames WHERE next_trace_id IS NOT NULL GROUP BY ALL), p AS (SELECT *, support / sum(support) OVER (PARTITION BY src) AS p FROM s),
e AS (SELECT *, -sum(p * ln(p)) OVER (PARTITION BY src) AS entropy FROM p), g AS (SELECT e.*, success - 0.1::DOUBLE * entropy - 0.075::DOUBLE * (a.future_alignment_ema + b.future_alignment_ema) - 0.05::DOUBLE * a.future_drift_ema AS gain FROM e JOIN v_etraces a ON a.trace_id = src JOIN v_etraces b ON b.trace_id = dst)
SELECT src, dst, support, round(success, 6) AS success, round(entropy, 6) AS entropy, round(gain, 6) AS gain, support >= 5 AND success >= 0.7 AND entropy <= 1.65 AND gain >= 0.05 AS promoted FROM g""", "v_frames", "v_etraces"))
def mt8(spark, sf_dir):
    out = maintenance.procedure_patterns(views.frames(spark, sf_dir), views.event_traces(spark, sf_dir), replace(REPLAY, procedure_entropy=1.65))
    return out.select("src", "dst", "support", *(r6(c).alias(c) for c in ("success", "entropy", "gain")), "promoted")


@query("mt10_role_lifecycle", with_views("SELECT trace_id, round(0.98::DOUBLE * support, 6) AS support, round(0.95::DOUBLE * gain, 6) AS gain, logit > 0 AND NOT (0.98::DOUBLE * support >= 1 AND 0.95::DOUBLE * gain > 0) AS demote FROM v_traces", "v_traces"))
def mt10(spark, sf_dir):
    out = maintenance.decay_roles(views.traces(spark, sf_dir), 1.0)
    return out.select("trace_id", r6(costs.role("role_support", "prototype")).alias("support"), r6(costs.role("role_gain_ema", "prototype")).alias("gain"), F.col("demote_prototype").alias("demote"))


@query("mt12_objective_ema", with_views(", n AS (SELECT session_id AS key, pred_loss AS v, row_number() OVER (PARTITION BY session_id ORDER BY ts, seq) AS k FROM v_frames), e AS (SELECT key, k, v AS e FROM n WHERE k = 1 UNION ALL SELECT n.key, n.k, 0.95::DOUBLE * e.e + 0.05::DOUBLE * n.v FROM e JOIN n ON n.key = e.key AND n.k = e.k + 1) SELECT key, round(arg_max(e, k), 6) AS ema FROM e GROUP BY ALL", "v_frames", recursive=True))
def mt12(spark, sf_dir):
    f = views.raw_frames(spark, sf_dir).select(F.col("session_id").alias("key"), F.col("pred_loss").alias("value"), F.struct("ts", "seq").alias("step"))
    return maintenance.objective_ema(f).select("key", r6("ema").alias("ema"))
