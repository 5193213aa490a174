"""Competing traces: separation of pairs, posterior groups, and clusters that no member explains."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mnemos.config import EPS, FIELD, FieldConfig
from mnemos.functions.vectors import cosine, gaussian_logpdf, let, safe_variance, vadd, vscale, vsum


def log_joint(t: Column, x: Column, c: Column) -> Column:
    """Log prior and likelihood of trace t (a struct)."""
    prior = F.log(t["evidence"] + EPS) + 0.75 * t["stability"] - 0.50 * t["uncertainty"]
    return prior + gaussian_logpdf(c, t["ctx_mu"], t["ctx_sigma_diag"]) + gaussian_logpdf(x, t["z_mu"], t["z_sigma_diag"])


def _matched(a: Column, b: Column, mu: str, sigma: str) -> tuple[Column, Column]:
    """Mean and variance of the two as one Gaussian, weighted by evidence."""
    total = F.greatest(a["evidence"] + b["evidence"], F.lit(EPS))
    mean = vscale(vadd(vscale(a[mu], a["evidence"]), vscale(b[mu], b["evidence"])), 1.0 / total)
    off = lambda s, m: F.zip_with(s[sigma], F.zip_with(s[mu], m, lambda p, q: (p - q) * (p - q)), lambda v, d: v + d)
    var = let(mean, lambda m: vscale(vadd(vscale(off(a, m), a["evidence"]), vscale(off(b, m), b["evidence"])), 1.0 / total))
    return mean, var


def separate_pairs(pairs: DataFrame) -> DataFrame:
    """pairs (a, b: trace structs; x, c) with bf, the log Bayes factor of two traces against their merger, and overlap."""
    a, b, x, c = F.col("a"), F.col("b"), F.col("x"), F.col("c")
    mu, var = _matched(a, b, "z_mu", "z_sigma_diag")
    ctx, ctx_var = _matched(a, b, "ctx_mu", "ctx_sigma_diag")
    staged = pairs.withColumns({"_l": log_joint(a, x, c), "_r": log_joint(b, x, c), "_mu": mu, "_var": var, "_ctx": ctx, "_ctx_var": ctx_var})
    merged = F.log(F.greatest(a["evidence"] + b["evidence"], F.lit(EPS)) + EPS) + gaussian_logpdf(c, F.col("_ctx"), F.col("_ctx_var")) + gaussian_logpdf(x, F.col("_mu"), F.col("_var"))
    either = F.greatest("_l", "_r") + F.log1p(F.exp(-F.abs(F.col("_l") - F.col("_r"))))
    return staged.withColumns({"bf": either - merged, "overlap": 0.5 * (1.0 + cosine(a["ctx_mu"], b["ctx_mu"]))}).drop("_l", "_r", "_mu", "_var", "_ctx", "_ctx_var")


def inhibit_pairs(separated: DataFrame, rate: float = 0.25, decay: float = 0.95) -> DataFrame:
    """Both directions' edge touch rate * max(0, bf), bf_sep_ema after it (bf0: before), and whether to propose a group."""
    ema = decay * F.coalesce(F.col("bf0"), F.lit(0.0)) + (1 - decay) * F.col("bf") if "bf0" in separated.columns else (1 - decay) * F.col("bf")
    out = separated.withColumns({"delta": rate * F.greatest(F.lit(0.0), F.col("bf")), "bf_sep_ema": ema})
    out = out.withColumn("propose", (F.col("bf_sep_ema") > 0.2) & (F.col("overlap") > 0.55))
    ends = F.array(F.struct(F.col("a.trace_id").alias("src"), F.col("b.trace_id").alias("dst")), F.struct(F.col("b.trace_id").alias("src"), F.col("a.trace_id").alias("dst")))
    return out.withColumn("_e", F.explode(ends)).select("_e.src", "_e.dst", F.lit("inhib").alias("kind"), "delta", "bf_sep_ema", "propose")


def create_groups(pairs: DataFrame, groups: DataFrame) -> DataFrame:
    """New groups of accepted pairs (first, second) that no group holds yet: alpha 1, 1 and 0.5 for the null slot."""
    member = groups.select("group_id", F.explode("member_ids").alias("m"))
    held = pairs.join(member.select("group_id", F.col("m").alias("first")), "first").join(member.select("group_id", F.col("m").alias("second")), ["group_id", "second"]).select("first", "second")
    new = pairs.select("first", "second").distinct().join(held, ["first", "second"], "left_anti")
    return new.select(F.concat(F.lit("group_"), F.substring(F.sha2(F.concat_ws("\x1f", "first", "second"), 256), 1, 32)).alias("group_id"), F.array("first", "second").alias("member_ids"), F.array(F.lit(1.0), F.lit(1.0), F.lit(0.5)).alias("alpha"), F.lit(0.0).alias("unresolved_mass"), F.lit(1.0).alias("temperature"))


def unresolved_clusters(groups: DataFrame, anchors: DataFrame, config: FieldConfig = FIELD, trigger: float = 0.35, least: int = 3, compact: float = 0.35) -> DataFrame:
    """Traces that spring from groups' ambiguous buffers: group_id, parent, evidence, z_mu, z_sigma_diag, fidelity.

    A group spawns if its unresolved mass reaches the trigger and at least three anchors lie within a mean variance. (The
    context cohesion test compares with a null slot that stays at zero, so it is 0.5 and always passes.)
    """
    held = groups.where((F.col("unresolved_mass") >= trigger) & (F.size("ambiguous_buffer") >= least)).select("group_id", F.explode("ambiguous_buffer").alias("anchor_id"))
    parts = held.join(anchors.select("anchor_id", "z"), "anchor_id").select("group_id", F.posexplode("z").alias("i", "x"))
    stats = parts.groupBy("group_id", "i").agg(F.avg("x").alias("m"), F.var_pop("x").alias("v"), F.count(F.lit(1)).alias("n"))
    folded = stats.groupBy("group_id").agg(F.array_sort(F.collect_list(F.struct("i", "m", "v"))).alias("s"), F.max("n").alias("n"), F.avg("v").alias("spread")).where((F.col("n") >= least) & (F.col("spread") <= compact))
    n = F.size("member_ids")
    scores = F.zip_with("member_ids", F.slice("alpha", F.lit(1), n), lambda m, a: F.struct(a.alias("a"), m.alias("m")))
    top = F.array_max(F.slice("alpha", F.lit(1), n))
    parent = F.element_at(F.filter(scores, lambda s: s["a"] == top), 1)["m"]
    var = safe_variance(F.transform("s", lambda p: p["v"] + config.sigma_floor), config.sigma_floor, config.sigma_ceiling)
    return groups.join(folded, "group_id").select("group_id", parent.alias("parent"), F.col("n").cast("double").alias("evidence"), F.transform("s", lambda p: p["m"]).alias("z_mu"), var.alias("z_sigma_diag"), F.least(F.lit(1.0), 0.85 + 0.05 * F.least("n", F.lit(3))).alias("fidelity"))


def mean(a: Column) -> Column:
    return vsum(a) / F.size(a)
