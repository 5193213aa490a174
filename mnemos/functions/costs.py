"""Scores and costs of traces, edges and groups as columns.

A trace has role_logits, role_support and role_gain_ema as map<string,double>; a role that isn't there counts as 0.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from mnemos.config import EDGE_KIND_COST, EPS, FIELD, FieldConfig
from mnemos.functions.vectors import clip, gaussian_logpdf, isotropic_logpdf, safe_variance, vsum

PROTOTYPE, PROCEDURE = "prototype", "procedure"


def role(column: str, name: str) -> Column:
    return F.coalesce(F.col(column)[name], F.lit(0.0))


def positive(x: Column) -> Column:
    return F.greatest(x, F.lit(0.0))


def structural_role_mass() -> Column:
    top = F.greatest(positive(role("role_logits", PROTOTYPE)), positive(role("role_logits", PROCEDURE)))
    return top + 0.25 * F.greatest(role("role_support", PROTOTYPE), role("role_support", PROCEDURE))


def role_cost() -> Column:
    active = positive(role("role_logits", PROTOTYPE)) + positive(role("role_logits", PROCEDURE))
    support = role("role_support", PROTOTYPE) + role("role_support", PROCEDURE)
    gain = positive(role("role_gain_ema", PROTOTYPE)) + positive(role("role_gain_ema", PROCEDURE))
    return F.pow(active - clip(support + gain, 0.0, 4.0), F.lit(2.0))


def fidelity_cost() -> Column:
    return positive(1.0 - F.col("fidelity")) * (1.0 + 0.25 * F.col("compression_stage"))


def storage_cost(config: FieldConfig = FIELD) -> Column:
    return config.base_trace_cost * (0.35 + 0.65 * clip(F.col("fidelity"), 0.0, 1.0)) * (1.0 + 0.05 * F.size("member_ids") + 0.05 * F.size("path_signature"))


def future_alignment_cost() -> Column:
    return positive(F.col("future_alignment_ema"))


def future_drift_cost() -> Column:
    return positive(F.col("future_drift_ema"))


def edge_storage_cost(kind: Column | None = None, config: FieldConfig = FIELD) -> Column:
    kind = F.col("kind") if kind is None else kind
    out = F.lit(None).cast("double")
    for name, factor in EDGE_KIND_COST.items():
        out = F.when(kind == name, factor).otherwise(out)
    return out * config.base_edge_cost


def group_storage_cost(config: FieldConfig = FIELD) -> Column:
    members = 1.0 + 0.08 * F.greatest(F.size("member_ids") - 1, F.lit(0))
    buffers = 1.0 + 0.02 * (F.size("ambiguous_buffer") + F.size("ambiguous_ctx_buffer"))
    return 0.25 * config.base_trace_cost * members * (1.0 + 0.15 * positive(F.col("unresolved_mass"))) * (1.0 + 0.10 * positive(F.col("replay_tension_ema"))) * buffers


def group_tension_cost() -> Column:
    return positive(F.col("replay_tension_ema")) + 0.5 * positive(F.col("unresolved_mass"))


def uncertainty(config: FieldConfig = FIELD) -> Column:
    spread = vsum(safe_variance(F.col("z_sigma_diag"), config.sigma_floor, config.sigma_ceiling)) / F.size("z_sigma_diag")
    return spread + config.kappa_evidence / (F.col("evidence") + EPS) + config.kappa_pred * F.col("pred_loss_ema")


def next_stability(config: FieldConfig = FIELD) -> Column:
    logit = F.log(F.col("evidence") + EPS) - F.col("uncertainty") - F.col("pred_loss_ema")
    return clip((1 - config.eta_stability) * F.col("stability") + config.eta_stability / (1.0 + F.exp(-logit)), 0.0, 1.0)


def forget_risk(now: float | Column) -> Column:
    age = positive(F.lit(now) - F.col("last_access_ts"))
    return (1.0 + age) * (F.col("uncertainty") + 1.0) / (F.col("evidence") + 1.0)


def budget_utility(now: float | Column) -> Column:
    """The form that pruning ranks by."""
    age = positive(F.lit(now) - F.col("last_access_ts"))
    return 0.45 * F.col("evidence") + 0.25 * F.col("access_ema") + 0.20 * F.col("stability") + 0.10 * structural_role_mass() + 1.0 / (1.0 + age) - F.col("uncertainty")


def fidelity_utility(now: float | Column) -> Column:
    """The form that compression ranks by."""
    return F.col("evidence") + F.col("stability") + F.col("access_ema") + 0.5 * structural_role_mass() - F.col("uncertainty") - forget_risk(now)


def trace_log_prior(context: Column) -> Column:
    return F.log(F.col("evidence") + EPS) + 0.75 * F.col("stability") - 0.50 * F.col("uncertainty") + gaussian_logpdf(context, F.col("ctx_mu"), F.col("ctx_sigma_diag"))


def null_logprob(x: Column, context: Column, config: FieldConfig = FIELD) -> Column:
    return isotropic_logpdf(x, config.null_sigma) + isotropic_logpdf(context, config.null_sigma)


def alignment_nll(x: Column, mu: Column, var: Column) -> Column:
    return -gaussian_logpdf(x, mu, var) / F.greatest(F.size(x), F.lit(1))


OBJECTIVE = {"storage": "lambda_storage", "complexity": "lambda_complexity", "fidelity": "lambda_fidelity", "role": "lambda_role"}
