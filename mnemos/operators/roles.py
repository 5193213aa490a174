"""Acceptance of role changes: only storage and the role cost differ before and after."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mnemos.config import FIELD, FieldConfig
from mnemos.functions import costs

STEP, TOP = 0.20, 4.0


def _role_cost(logit: Column, role: str) -> Column:
    other = costs.PROCEDURE if role == costs.PROTOTYPE else costs.PROTOTYPE
    active = costs.positive(logit) + costs.positive(costs.role("role_logits", other))
    support = costs.role("role_support", costs.PROTOTYPE) + costs.role("role_support", costs.PROCEDURE)
    gain = costs.positive(costs.role("role_gain_ema", costs.PROTOTYPE)) + costs.positive(costs.role("role_gain_ema", costs.PROCEDURE))
    return F.pow(active - costs.clip(support + gain, 0.0, 4.0), F.lit(2.0))


def _storage(members: Column, path: Column, config: FieldConfig) -> Column:
    return config.base_trace_cost * (0.35 + 0.65 * costs.clip(F.col("fidelity"), 0.0, 1.0)) * (1.0 + 0.05 * members + 0.05 * path)


def accept_promotion(traces: DataFrame, role: str = costs.PROTOTYPE, members: Column | None = None, config: FieldConfig = FIELD) -> DataFrame:
    """promote_delta of the objective if the role's logit rises by 0.20 (4 at most); promoted if it falls."""
    old = costs.role("role_logits", role)
    new = F.least(old + STEP, F.lit(TOP))
    delta = config.lambda_role * (_role_cost(new, role) - _role_cost(old, role))
    if members is not None:
        delta = delta + config.lambda_storage * (_storage(F.size(members), F.size("path_signature"), config) - _storage(F.size("member_ids"), F.size("path_signature"), config))
    return traces.withColumn("promote_delta", delta).withColumn("promoted", F.col("promote_delta") < 0)


def accept_decay(traces: DataFrame, pressure: float, role: str = costs.PROTOTYPE, config: FieldConfig = FIELD) -> DataFrame:
    """decay_delta if the logit falls by 0.20 (0 at least; at 0.1 or less members or path go); refused only if the
    objective rises while pressure is under 1.10."""
    old = costs.role("role_logits", role)
    new = F.greatest(old - STEP, F.lit(0.0))
    m, p = F.size("member_ids"), F.size("path_signature")
    gone = new <= 0.1
    after = _storage(F.when(gone, 0).otherwise(m), p, config) if role == costs.PROTOTYPE else _storage(m, F.when(gone, 0).otherwise(p), config)
    delta = config.lambda_role * (_role_cost(new, role) - _role_cost(old, role)) + config.lambda_storage * (after - _storage(m, p, config))
    return traces.withColumn("decay_delta", delta).withColumn("demoted", ~((F.col("decay_delta") > 0) & F.lit(pressure < 1.10)))
