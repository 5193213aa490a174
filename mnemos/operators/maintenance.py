"""Replay and maintenance over the frame log."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from mnemos.config import FIELD, REPLAY, FieldConfig, ReplayConfig
from mnemos.functions import costs
from mnemos.functions.vectors import safe_variance, vscale, vsum
from mnemos.operators import ordered
from mnemos.operators.graph import degree, transition_support
from mnemos.sources.stages import Stages


def hot_traces(traces: DataFrame, n: int = FIELD.frontier_size) -> DataFrame:
    """The n traces of most evidence + access + stability - uncertainty + role mass; ties by trace_id."""
    score = F.col("evidence") + F.col("access_ema") + F.col("stability") - F.col("uncertainty") + costs.structural_role_mass()
    return traces.withColumn("score", score).orderBy(F.desc("score"), "trace_id").limit(n)


def update_frontier(frames: DataFrame, n: int = FIELD.frontier_size) -> DataFrame:
    """(session_id, trace_id, weight): the top n by activation of each session's last frame."""
    last = Window.partitionBy("session_id").orderBy(F.desc("ts"), F.desc("seq"))
    newest = frames.withColumn("_r", F.row_number().over(last)).where("_r = 1").select("session_id", F.explode("activation").alias("trace_id", "weight"))
    w = Window.partitionBy("session_id").orderBy(F.desc("weight"), "trace_id")
    return newest.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)


def local_frames(patches: DataFrame, frames: DataFrame, limit: int = FIELD.objective_local_window) -> DataFrame:
    """(patch_id, frame_id, rank): the newest frames of the patch's session that touch one of its traces.

    patches has patch_id, session_id, trace_id (a row each). rank 1 is the oldest of those kept.
    """
    touched = F.array_distinct(F.filter(F.concat(F.array("trace_id", "next_trace_id"), "active_ids"), lambda t: t.isNotNull()))
    rows = frames.select("frame_id", "session_id", "ts", "seq", F.explode(touched).alias("trace_id"))
    hit = rows.join(patches, ["session_id", "trace_id"]).select("patch_id", "frame_id", "ts", "seq").distinct()
    newest = Window.partitionBy("patch_id").orderBy(F.desc("ts"), F.desc("seq"))
    kept = hit.withColumn("_r", F.row_number().over(newest)).where(F.col("_r") <= limit)
    oldest = Window.partitionBy("patch_id").orderBy("ts", "seq")
    return kept.withColumn("rank", F.row_number().over(oldest)).select("patch_id", "frame_id", "rank")


def replay_priority(frames: DataFrame, traces: DataFrame, edges: DataFrame, now: float, config: ReplayConfig = REPLAY) -> DataFrame:
    """frames with priority, a product of five powers; 0 where the trace is gone."""
    t = traces.select("trace_id", "pred_loss_ema", "uncertainty", "evidence", "last_access_ts").join(degree(edges), "trace_id", "left")
    rows = frames.join(t, "trace_id", "left")
    floor = lambda c: F.greatest(c, F.lit(0.0)) + 1e-4
    score = (
        F.pow(floor(F.col("pred_loss_ema")), F.lit(config.power_pred)) * F.pow(floor(F.col("uncertainty")), F.lit(config.power_uncertainty)) * F.pow(floor(F.col("group_entropy")), F.lit(config.power_group))
        * F.pow(1.0 + F.coalesce("degree", F.lit(0)), F.lit(config.power_centrality)) * F.pow(costs.forget_risk(now) + 1e-4, F.lit(config.power_forget))
    )
    return rows.withColumn("priority", F.coalesce(score, F.lit(0.0))).drop("pred_loss_ema", "uncertainty", "evidence", "last_access_ts", "degree")


def sample_replay(frames: DataFrame, batch: int = 10, seed: int = 7, trace_mix: float = 0.6, conflict_mix: float = 0.2, stages: Stages | None = None) -> DataFrame:
    """A weighted sample without replacement from frames with priority: shares from all, conflicting and linked frames.

    The frames of least -log(u) / priority are such a sample, with u drawn from a hash of (seed, frame), so each pool is
    one top-n and no draw is sequential. Repeats are dropped and made up from all frames.
    """
    whole = frames.where("next_trace_id is not null")
    hexed = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), "frame_id")), 1, 12), 16, 10).cast("double")
    key = -F.log((hexed + 1.0) / (2.0**48 + 1.0)) / F.greatest("priority", F.lit(1e-300))
    # written once: each share reads it
    stages = stages or Stages(frames.sparkSession, "sample")
    keyed = stages.keep(whole.select("frame_id", "group_entropy", key.alias("_key")), "keyed")
    n_trace, n_conflict = max(int(round(batch * trace_mix)), 1), max(int(round(batch * conflict_mix)), 0)
    top = lambda df, n: df.orderBy("_key", "frame_id").limit(n)
    first = top(keyed, n_trace).union(top(keyed.where("group_entropy > 0.05"), n_conflict)).union(top(keyed, max(batch - n_trace - n_conflict, 0))).dropDuplicates(["frame_id"])
    return top(keyed, batch).withColumn("_in", F.lit(1)).unionByName(first.withColumn("_in", F.lit(0))).groupBy("frame_id").agg(F.min("_in").alias("_in"), F.min("_key").alias("_key")).orderBy("_in", "_key").limit(batch).select("frame_id")


def continuation_stats(frames: DataFrame, traces: DataFrame, edges: DataFrame, config: FieldConfig = FIELD) -> DataFrame:
    """traces' future_alignment_ema and future_drift_ema after the batch; means of pred_loss and drift by trace.

    A frame counts for its own trace, and half for the next one. Contributions combine before the shuffle.
    """
    known = traces.select("trace_id")
    loss = F.greatest("pred_loss", F.lit(0.0))
    own = frames.join(known, "trace_id", "left_semi")
    nxt = F.when(F.col("next_trace_id").isNotNull(), loss).otherwise(0.0)
    linked = own.where("next_trace_id is not null").join(known.withColumnRenamed("trace_id", "next_trace_id"), "next_trace_id", "left_semi")
    support = transition_support(linked.select(F.col("trace_id").alias("src"), F.col("next_trace_id").alias("dst")).distinct(), edges)
    gap = own.join(support.select(F.col("src").alias("trace_id"), F.col("dst").alias("next_trace_id"), "support"), ["trace_id", "next_trace_id"], "left")
    drift = gap.groupBy("trace_id").agg(F.avg(F.greatest("group_entropy", F.lit(0.0)) + F.when(F.col("support").isNotNull(), 1.0 - F.col("support")).otherwise(0.0)).alias("drift"))
    align = own.select("trace_id", nxt.alias("v")).union(linked.select(F.col("next_trace_id"), 0.5 * loss)).groupBy("trace_id").agg(F.avg("v").alias("align"))
    d = config.continuation_decay
    ema = lambda old, new: F.when(F.col(new).isNull(), F.col(old)).otherwise(d * F.col(old) + (1 - d) * F.col(new))
    return traces.join(align, "trace_id", "left").join(drift, "trace_id", "left").select("trace_id", ema("future_alignment_ema", "align").alias("future_alignment_ema"), ema("future_drift_ema", "drift").alias("future_drift_ema"))


def prototype_patterns(frames: DataFrame, traces: DataFrame, config: ReplayConfig = REPLAY, field: FieldConfig = FIELD) -> DataFrame:
    """(members, support, dispersion, gain, medoid, promoted) for each set of the first three active traces."""
    top = F.array_sort(F.slice("active_ids", 1, 3))
    sets = frames.where(F.size("active_ids") >= 2).groupBy(top.alias("members")).agg(F.count(F.lit(1)).alias("support"))
    live = sets.select("members", "support", F.explode("members").alias("trace_id")).join(traces.select("trace_id", "z_mu", "future_alignment_ema", "future_drift_ema"), "trace_id")
    n = F.size("ms")
    g = live.groupBy("members", "support").agg(F.array_sort(F.collect_list(F.struct("trace_id", "z_mu", "future_alignment_ema", "future_drift_ema"))).alias("ms")).where(n >= 2)
    total = F.aggregate(F.slice("ms", 2, F.size("ms")), F.element_at("ms", 1)["z_mu"], lambda acc, m: F.zip_with(acc, m["z_mu"], lambda p, q: p + q))
    g = g.withColumn("center", vscale(total, 1.0 / n))
    far = F.transform("ms", lambda m: F.struct(vsum(F.zip_with(m["z_mu"], F.col("center"), lambda p, q: (p - q) * (p - q))).alias("d"), m["trace_id"].alias("trace_id")))
    g = g.withColumn("far", far).withColumn("dispersion", vsum(F.transform("far", lambda s: s["d"])) / n)
    mean = lambda f: vsum(F.transform("ms", lambda m: m[f])) / n
    gain = (n - 1) * field.base_trace_cost - F.col("dispersion") - 0.25 * mean("future_alignment_ema") - 0.10 * mean("future_drift_ema")
    g = g.withColumn("gain", gain).withColumn("medoid", F.array_min("far")["trace_id"])
    ok = (F.col("support") >= config.prototype_support) & (F.col("dispersion") <= config.prototype_dispersion) & (F.col("gain") >= config.prototype_gain)
    return g.select(F.array_join("members", ",").alias("members"), "support", "dispersion", "gain", "medoid", ok.alias("promoted"))


def procedure_patterns(frames: DataFrame, traces: DataFrame, config: ReplayConfig = REPLAY) -> DataFrame:
    """(src, dst, support, success, entropy, gain, promoted) for each step between known traces. pred_loss is the NLL."""
    step = frames.where("next_trace_id is not null").groupBy(F.col("trace_id").alias("src"), F.col("next_trace_id").alias("dst")).agg(F.count(F.lit(1)).alias("support"), F.avg(1.0 - F.least("pred_loss", F.lit(1.0))).alias("success"))
    w = Window.partitionBy("src")
    p = F.col("support") / F.sum("support").over(w)
    step = step.withColumn("_p", p).withColumn("entropy", -F.sum(F.col("_p") * F.log("_p")).over(w))
    a = traces.select(F.col("trace_id").alias("src"), F.col("future_alignment_ema").alias("fa"), F.col("future_drift_ema").alias("fd"))
    b = traces.select(F.col("trace_id").alias("dst"), F.col("future_alignment_ema").alias("fb"))
    both = step.join(a, "src").join(b, "dst")
    both = both.withColumn("gain", F.col("success") - 0.1 * F.col("entropy") - 0.15 * 0.5 * (F.col("fa") + F.col("fb")) - 0.05 * F.col("fd"))
    ok = (F.col("support") >= config.procedure_support) & (F.col("success") >= config.procedure_success) & (F.col("entropy") <= config.procedure_entropy) & (F.col("gain") >= config.procedure_gain)
    return both.select("src", "dst", "support", "success", "entropy", "gain", ok.alias("promoted"))


def decay_roles(traces: DataFrame, pressure: float, config: FieldConfig = FIELD) -> DataFrame:
    """Decayed role_support and role_gain_ema, and for each role whether it is a case for demotion."""
    scaled = lambda c, k: F.transform_values(c, lambda _, v: v * k)
    out = traces.withColumns({"role_support": scaled("role_support", config.role_support_decay), "role_gain_ema": scaled("role_gain_ema", config.role_gain_decay)})
    weak = lambda r: (costs.role("role_logits", r) > 0) & ~((costs.role("role_support", r) >= 1.0) & (costs.role("role_gain_ema", r) > 0) & (F.lit(pressure) < 1.10))
    return out.withColumns({"demote_prototype": weak(costs.PROTOTYPE), "demote_procedure": weak(costs.PROCEDURE)})


def objective_ema(series: DataFrame, decay: float = 0.95) -> DataFrame:
    """(key, ema) after all of series (key, value, step): e0 = first value, then decay * e + (1 - decay) * value, closed."""
    w = Window.partitionBy("key").orderBy(F.desc("step"))
    r = series.withColumn("_k", F.row_number().over(w) - 1).withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy("key")))
    part = F.pow(F.lit(decay), F.col("_k").cast("double")) * F.col("value") * F.when(F.col("_k") == F.col("_n") - 1, 1.0).otherwise(1.0 - decay)
    return r.groupBy("key").agg(F.sum(part).alias("ema"))


def degrade(traces: DataFrame, config: FieldConfig = FIELD) -> DataFrame:
    """One step of compression of every trace given: fidelity, stage, reservoir, variances, uncertainty."""
    keep = F.greatest(F.lit(1), F.bround(F.size("anchor_reservoir") * config.fidelity_keep_ratio).cast("int"))
    wider = lambda c: safe_variance(vscale(F.col(c), config.fidelity_sigma_inflate), config.sigma_floor, config.sigma_ceiling)
    out = traces.withColumns({
        "fidelity": F.greatest(F.lit(config.fidelity_min), F.col("fidelity") - config.fidelity_compress_step), "compression_stage": F.col("compression_stage") + 1,
        "anchor_reservoir": F.slice("anchor_reservoir", F.greatest(F.size("anchor_reservoir") - keep + 1, F.lit(1)), keep),
        "z_sigma_diag": wider("z_sigma_diag"), "ctx_sigma_diag": wider("ctx_sigma_diag"),
    })
    return out.withColumn("uncertainty", costs.uncertainty(config))


def degrade_fidelity(traces: DataFrame, now: float, cap: float, active: DataFrame | None = None, config: FieldConfig = FIELD) -> DataFrame:
    """The traces compressed, in order of utility by storage, until the trace mass is at most the cap.

    A trace is compressed while the mass freed before it leaves pressure above 1. The freed mass is a running sum over
    range partitions: sums of partitions first (one row each), then offsets, so no one task sees all traces.
    """
    able = traces.where((costs.structural_role_mass() < config.active_role_threshold) & (F.col("fidelity") > config.fidelity_min + 1e-8))
    if active is not None:
        able = able.join(active.select("trace_id"), "trace_id", "left_anti")
    cost = costs.storage_cost(config)
    after = costs.storage_cost(config) / (0.35 + 0.65 * costs.clip(F.col("fidelity"), 0.0, 1.0)) * (0.35 + 0.65 * F.greatest(F.lit(config.fidelity_min), F.col("fidelity") - config.fidelity_compress_step))
    ranked = able.withColumns({"_order": costs.fidelity_utility(now) / F.greatest(cost, F.lit(1e-8)), "_freed": cost - after})
    # written once: both readers below must see the same ranges
    ranked = Stages(traces.sparkSession, "fidelity").keep(ranked.repartitionByRange("_order", "trace_id").withColumn("_part", F.spark_partition_id()), "ranked")
    offsets = ranked.groupBy("_part").agg(F.sum("_freed").alias("_sum"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = offsets.select("_part", F.coalesce(F.sum("_sum").over(before), F.lit(0.0)).alias("_offset"))
    within = Window.partitionBy("_part").orderBy("_order", "trace_id").rowsBetween(Window.unboundedPreceding, -1)
    total = traces.agg(F.coalesce(F.sum(cost), F.lit(0.0)).alias("_total"))
    rows = ranked.withColumn("_before", F.coalesce(F.sum("_freed").over(within), F.lit(0.0))).join(F.broadcast(offsets), "_part").crossJoin(F.broadcast(total))
    return degrade(rows.where((F.col("_total") - F.col("_before") - F.col("_offset")) / cap > 1.0), config).drop("_order", "_freed", "_part", "_before", "_offset", "_total")


def prune(rows: DataFrame, score: str, key: str, removable: str, cap: int, pressure: float, prune_fraction: float = 0.10) -> DataFrame:
    """The rows to drop: the least by score, of the removable ones. None unless pressure is over 1 and rows exceed the cap."""
    n = rows.count()
    fraction = round(min(max(pressure - 1.0, 0.0) + prune_fraction, 0.5), 12)  # 1.2 - 1.0 + 0.1 is just under 0.3
    if pressure <= 1.0 or n <= cap:
        return rows.limit(0)
    able = rows.where(removable)
    return ordered.first(able, [score, key], max(min(int(able.count() * fraction) + 1, math.floor(n - cap)), 0))


def rehydrate(traces: DataFrame, anchors: DataFrame, config: FieldConfig = FIELD) -> DataFrame:
    """Mean and population variance of z over a trace's reservoir, its fidelity and stage; traces at 0.999 stay out."""
    low = traces.where("fidelity < 0.999")
    held = low.select("trace_id", F.explode("anchor_reservoir").alias("anchor_id")).join(anchors.select("anchor_id", "z"), "anchor_id").select("trace_id", F.posexplode("z").alias("i", "x"))
    stats = held.groupBy("trace_id", "i").agg(F.avg("x").alias("m"), F.var_pop("x").alias("v")).groupBy("trace_id").agg(F.array_sort(F.collect_list(F.struct("i", "m", "v"))).alias("s"))
    out = low.join(stats, "trace_id", "left")
    found = F.col("s").isNotNull()
    var = safe_variance(F.transform("s", lambda p: p["v"] + config.sigma_floor), config.sigma_floor, config.sigma_ceiling)
    return out.withColumns({
        "z_mu": F.when(found, F.transform("s", lambda p: p["m"])).otherwise(F.col("z_mu")), "z_sigma_diag": F.when(found, var).otherwise(F.col("z_sigma_diag")),
        "fidelity": F.least(F.lit(1.0), F.col("fidelity") + F.when(found, config.fidelity_expand_step).otherwise(0.5 * config.fidelity_expand_step)), "compression_stage": F.greatest(F.col("compression_stage") - 1, F.lit(0)),
    }).drop("s")
