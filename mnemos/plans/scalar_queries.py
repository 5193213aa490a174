"""Queries of the ingest operators and the column functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from mnemos.functions import costs
from mnemos.functions import vectors as V
from mnemos.operators import ingest, objective
from mnemos.plans import views
from mnemos.plans.views import with_views

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def keep(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return keep


def r6(c):
    return F.round(c, 6)


_NORM = """SELECT ts, session_id, turn_id, lower(trim(coalesce(nullif(source, ''), nullif(role, ''), 'user'))) AS source, coalesce(nullif(payload_type, ''), 'text') AS payload_type,
  regexp_replace(coalesce(nullif(payload, ''), text, ''), '^\\s+|\\s+$', '', 'g') AS payload FROM v_events"""


@query("io1_normalize_events", with_views(_NORM, "v_events"))
def io1(spark, sf_dir):
    return ingest.normalize_events(views.events(spark, sf_dir), now=0.0).drop("meta")


@query("io2_split_valid_rejected", with_views(f", n AS ({_NORM}), j AS (SELECT *, CASE WHEN payload = '' THEN 'payload must not be empty' WHEN source NOT IN ('user', 'assistant', 'tool', 'env') THEN 'unknown source' END AS reason FROM n) SELECT session_id, turn_id, source, coalesce(reason, 'valid') AS status FROM j", "v_events"))
def io2(spark, sf_dir):
    good, bad = ingest.split_valid_rejected(ingest.normalize_events(views.events(spark, sf_dir), now=0.0))
    return good.select("session_id", "turn_id", "source", F.lit("valid").alias("status")).union(bad.select("session_id", "turn_id", "source", "reason"))


_PACKETS = """, p AS (SELECT doc_id, source, unnest(range(0, CAST(ceil(length(text) / 512.0) AS BIGINT))) AS chunk_index, text FROM documents WHERE length(text) > 0),
c AS (SELECT doc_id, source, CAST(chunk_index AS INTEGER) AS chunk_index, substr(text, CAST(chunk_index * 512 + 1 AS BIGINT), 512) AS payload FROM p)"""


def packets(spark, sf_dir):
    docs = views.read(spark, sf_dir, "documents").where("length(text) > 0")
    events = docs.select("doc_id", (F.col("doc_id") + 1.0).alias("ts"), F.col("source").alias("session_id"), F.lit("t").alias("turn_id"), F.lit("env").alias("source"), F.lit("observation").alias("payload_type"), F.col("text").alias("payload"))
    return ingest.packetize(events)


@query("sc1_packetize", "WITH " + _PACKETS[2:] + " SELECT doc_id, chunk_index, payload, greatest(1, strlen(payload) // 4) AS token_count FROM c")
def sc1(spark, sf_dir):
    return packets(spark, sf_dir).select("doc_id", "chunk_index", "payload", "token_count")


@query("sc3_to_anchors", "WITH " + _PACKETS[2:] + " SELECT doc_id, source AS session_id, CAST(doc_id + 1 AS DOUBLE) AS ts, payload AS residual_ref, 0.80::DOUBLE AS source_quality FROM c")
def sc3(spark, sf_dir):
    return ingest.to_anchors(packets(spark, sf_dir)).select("doc_id", "session_id", "ts", "residual_ref", "source_quality")


def pairs(spark, sf_dir):
    """Each anchor with the trace of the next lower vec_id."""
    a = views.anchors(spark, sf_dir).withColumn("trace_id", F.concat(F.lit("trace_"), (F.floor(F.col("ts") / 5) * 5).cast("bigint").cast("string")))
    return a.drop("session_id").join(views.traces(spark, sf_dir), "trace_id").withColumn("p", F.transform(F.slice("z", 1, 5), lambda x: F.abs(x)))


_PAIRS = ", p AS (SELECT a.anchor_id, a.z, t.*, list_transform(a.z[1:5], lambda x: abs(x)) AS p FROM v_anchors a JOIN v_traces t ON t.trace_id = 'trace_' || CAST(floor(a.ts / 5) * 5 AS BIGINT))"


def logpdf(x: str, mu: str, var: str) -> str:
    return f"(-0.5 * list_sum(list_transform(list_zip({x}, {mu}, {var}), lambda q: (q[1] - q[2]) * (q[1] - q[2]) / q[3] + ln(q[3]) + ln(2 * pi()))))"


@query("sc4_vector_functions", with_views(_PAIRS + f""" SELECT anchor_id, round(list_sum(list_transform(z, lambda x: x / sqrt(list_dot_product(z, z)))), 6) AS unit_sum, round(list_dot_product(z, z_mu) / greatest(sqrt(list_dot_product(z, z)) * sqrt(list_dot_product(z_mu, z_mu)), 1e-8), 6) AS cosine,
  round(list_sum(list_transform(list_zip(z, z_mu, z_sigma_diag), lambda q: (q[1] - q[2]) * (q[1] - q[2]) / q[3])), 6) AS mahalanobis, round({logpdf('z', 'z_mu', 'z_sigma_diag')}, 6) AS logpdf,
  round(list_sum(list_transform(z, lambda x: least(greatest(x, 0.01::DOUBLE), 0.2::DOUBLE))), 6) AS clamped FROM p""", "v_anchors", "v_traces"))
def sc4(spark, sf_dir):
    z, mu, var = F.col("z"), F.col("z_mu"), F.col("z_sigma_diag")
    return pairs(spark, sf_dir).select("anchor_id", r6(V.vsum(V.l2_normalize(z))).alias("unit_sum"), r6(V.cosine(z, mu)).alias("cosine"), r6(V.squared_mahalanobis(z, mu, var)).alias("mahalanobis"), r6(V.gaussian_logpdf(z, mu, var)).alias("logpdf"), r6(V.vsum(V.safe_variance(z, 0.01, 0.2))).alias("clamped"))


@query("sc5_probability_functions", with_views(_PAIRS + """, s AS (SELECT *, list_transform(p, lambda x: exp(x / 0.7::DOUBLE)) AS e, list_transform(p, lambda x: least(greatest(x, 1e-8), 1.0::DOUBLE)) AS c, list_transform(z_mu[1:5], lambda x: least(greatest(abs(x), 1e-8), 1.0::DOUBLE)) AS d FROM p)
SELECT anchor_id, round(e[1] / list_sum(e), 6) AS first_prob, round(ln(list_sum(list_transform(p, lambda x: exp(x)))), 6) AS lse, round(-list_sum(list_transform(c, lambda x: x / list_sum(c) * ln(x / list_sum(c)))), 6) AS entropy,
  round(list_sum(list_transform(list_zip(c, d), lambda q: q[1] / list_sum(c) * (ln(q[1] / list_sum(c)) - ln(q[2] / list_sum(d))))), 6) AS kl FROM s""", "v_anchors", "v_traces"))
def sc5(spark, sf_dir):
    p = F.col("p")
    q = F.transform(F.slice("z_mu", 1, 5), lambda x: F.abs(x))
    return pairs(spark, sf_dir).select("anchor_id", r6(V.softmax(p, 0.7)[0]).alias("first_prob"), r6(V.logsumexp(p)).alias("lse"), r6(V.entropy(p)).alias("entropy"), r6(V.safe_kl(p, q)).alias("kl"))


_UNIT = lambda x: f"list_transform({x}, lambda u: u / sqrt(list_dot_product({x}, {x})))"


@query("sc7_make_context", with_views(_PAIRS + f""", m AS (SELECT anchor_id, list_transform(list_zip({_UNIT('z')}, {_UNIT('z_mu')}), lambda q: 1.0 * q[1] + 0.35 * q[2] + 0.25 * q[1]) AS s FROM p)
SELECT anchor_id, round({_UNIT('s')}[1], 6) AS first, round(list_sum({_UNIT('s')}[1:48]), 6) AS total, CAST(48 AS INTEGER) AS dim FROM m""", "v_anchors", "v_traces"))
def sc7(spark, sf_dir):
    c = pairs(spark, sf_dir).withColumn("c", V.make_context(F.col("z"), F.col("z_mu"), F.col("z"), 48))
    return c.select("anchor_id", r6(F.col("c")[0]).alias("first"), r6(V.vsum(F.col("c"))).alias("total"), F.size("c").alias("dim"))


_MASS = "(greatest(logit, 0) + 0.25::DOUBLE * greatest(support, 0))"
_STORAGE = "((0.35::DOUBLE + 0.65::DOUBLE * least(greatest(fidelity, 0), 1)) * (1 + 0.05::DOUBLE * n_members + 0.05::DOUBLE * n_path))"


@query("sc8_trace_costs", with_views(f"SELECT trace_id, round({_MASS}, 6) AS role_mass, round(pow(greatest(logit, 0) - least(greatest(support + greatest(gain, 0), 0), 4), 2), 6) AS role_cost, round(greatest(0, 1 - fidelity) * (1 + 0.25::DOUBLE * compression_stage), 6) AS fidelity_cost, round({_STORAGE}, 6) AS storage_cost, round(greatest(future_alignment_ema, 0), 6) AS alignment_cost, round(greatest(future_drift_ema, 0), 6) AS drift_cost FROM v_traces", "v_traces"))
def sc8(spark, sf_dir):
    return views.traces(spark, sf_dir).select("trace_id", r6(costs.structural_role_mass()).alias("role_mass"), r6(costs.role_cost()).alias("role_cost"), r6(costs.fidelity_cost()).alias("fidelity_cost"), r6(costs.storage_cost()).alias("storage_cost"), r6(costs.future_alignment_cost()).alias("alignment_cost"), r6(costs.future_drift_cost()).alias("drift_cost"))


_GROUP_COST = "(0.25::DOUBLE * (1 + 0.08::DOUBLE * (len(member_ids) - 1)) * (1 + 0.15::DOUBLE * unresolved_mass) * (1 + 0.10::DOUBLE * replay_tension_ema) * (1 + 0.02::DOUBLE * 2 * n_buffer))"


@query("sc9_edge_group_costs", with_views(f"SELECT src || '>' || dst || ':' || kind AS id, round(CASE kind WHEN 'temporal' THEN 0.1 WHEN 'option' THEN 0.115 END::DOUBLE, 6) AS cost, CAST(NULL AS DOUBLE) AS tension FROM v_edges UNION ALL SELECT group_id, round({_GROUP_COST}, 6), round(greatest(replay_tension_ema, 0) + 0.5::DOUBLE * unresolved_mass, 6) FROM v_groups", "v_edges", "v_groups"))
def sc9(spark, sf_dir):
    e = views.edges(spark, sf_dir).select(F.concat("src", F.lit(">"), "dst", F.lit(":"), "kind").alias("id"), r6(costs.edge_storage_cost()).alias("cost"), F.lit(None).cast("double").alias("tension"))
    return e.union(views.groups(spark, sf_dir).select("group_id", r6(costs.group_storage_cost()), r6(costs.group_tension_cost())))


_UNC = "(list_sum(z_sigma_diag) / len(z_sigma_diag) + 0.3::DOUBLE / (evidence + 1e-8) + 0.8::DOUBLE * pred_loss_ema)"


@query("sc10_uncertainty_stability", with_views(f"SELECT trace_id, round({_UNC}, 6) AS new_uncertainty, round(least(greatest(0.95::DOUBLE * stability + 0.05::DOUBLE / (1 + exp(-(ln(evidence + 1e-8) - uncertainty - pred_loss_ema))), 0), 1), 6) AS new_stability FROM v_traces", "v_traces"))
def sc10(spark, sf_dir):
    return views.traces(spark, sf_dir).select("trace_id", r6(costs.uncertainty()).alias("new_uncertainty"), r6(costs.next_stability()).alias("new_stability"))


NOW = 1000.0
_AGE = "greatest(1000.0::DOUBLE - last_access_ts, 0)"
_RISK = f"((1 + {_AGE}) * (uncertainty + 1) / (evidence + 1))"
_BUDGET_UTILITY = f"(0.45::DOUBLE * evidence + 0.25::DOUBLE * access_ema + 0.20::DOUBLE * stability + 0.10::DOUBLE * {_MASS} + 1 / (1 + {_AGE}) - uncertainty)"
_FIDELITY_UTILITY = f"(evidence + stability + access_ema + 0.5::DOUBLE * {_MASS} - uncertainty - {_RISK})"


@query("sc11_forget_risk_utility", with_views(f"SELECT trace_id, round({_RISK}, 6) AS risk, round({_BUDGET_UTILITY}, 6) AS budget_utility, round({_FIDELITY_UTILITY}, 6) AS fidelity_utility FROM v_traces", "v_traces"))
def sc11(spark, sf_dir):
    return views.traces(spark, sf_dir).select("trace_id", r6(costs.forget_risk(NOW)).alias("risk"), r6(costs.budget_utility(NOW)).alias("budget_utility"), r6(costs.fidelity_utility(NOW)).alias("fidelity_utility"))


PRIOR = f"(ln(evidence + 1e-8) + 0.75::DOUBLE * stability - 0.5::DOUBLE * uncertainty + {logpdf('z', 'ctx_mu', 'ctx_sigma_diag')})"
NULL = "(-(list_dot_product(z, z) / 1.2::DOUBLE + len(z) * (ln(1.2::DOUBLE) + ln(2 * pi()))))"


@query("sc12_log_priors", with_views(_PAIRS + f" SELECT anchor_id, round({PRIOR}, 6) AS log_prior, round({NULL}, 6) AS null_logprob, round(-{logpdf('z', 'z_mu', 'z_sigma_diag')} / len(z), 6) AS nll FROM p", "v_anchors", "v_traces"))
def sc12(spark, sf_dir):
    z = F.col("z")
    return pairs(spark, sf_dir).select("anchor_id", r6(costs.trace_log_prior(z)).alias("log_prior"), r6(costs.null_logprob(z, z)).alias("null_logprob"), r6(costs.alignment_nll(z, F.col("z_mu"), F.col("z_sigma_diag"))).alias("nll"))


@query("sc13_combine_objective", with_views("SELECT trace_id, round(uncertainty + 0.05::DOUBLE * fidelity + 0.03::DOUBLE * evidence + 0.10::DOUBLE * stability, 6) AS local_energy, round(uncertainty + 0.05::DOUBLE * fidelity + 0.03::DOUBLE * evidence + 0.10::DOUBLE * stability + 0.18::DOUBLE * future_alignment_ema + 0.08::DOUBLE * future_drift_ema + 0.25::DOUBLE * pred_loss_ema + 0.05::DOUBLE * logit + 0.03::DOUBLE * support - gain, 6) AS total FROM v_traces", "v_traces"))
def sc13(spark, sf_dir):
    t = views.traces(spark, sf_dir).select("trace_id", F.col("uncertainty").alias("surprise"), F.col("fidelity").alias("storage"), F.col("evidence").alias("complexity"), F.col("stability").alias("plasticity"), F.col("future_alignment_ema").alias("slow_alignment"), F.col("future_drift_ema").alias("drift"), F.col("pred_loss_ema").alias("group_kl"), F.col("role_logits")["prototype"].alias("fidelity"), F.col("role_support")["prototype"].alias("role"), (-F.col("role_gain_ema")["prototype"]).alias("inhibit_bonus"))
    return objective.combine_objective(t).select("trace_id", r6("local_energy").alias("local_energy"), r6("total").alias("total"))


@query("sc14_push_reservoir", with_views("SELECT trace_id, array_to_string(list_filter(anchor_reservoir, lambda x: x <> anchor_reservoir[2])[-2:] || [anchor_reservoir[2]], ',') AS moved, array_to_string((anchor_reservoir || ['new'])[-3:], ',') AS pushed FROM v_traces", "v_traces"))
def sc14(spark, sf_dir):
    a = F.col("anchor_reservoir")
    return views.traces(spark, sf_dir).select("trace_id", F.array_join(V.push_reservoir(a, a[1], 3), ",").alias("moved"), F.array_join(V.push_reservoir(a, F.lit("new"), 3), ",").alias("pushed"))
