"""The whole maintenance cycle over the state tables, in stages that are written and named.

Each stage reads what the one before wrote, so fidelity, roles, mutations, promotion, pruning and the objective see the
state as it is by then; lineage ends at each table. Nothing of the old state is touched: the caller commits the tables that
come back (see sources.snapshots), and a stage that fails leaves the old version as the last one.

State: traces, edges, groups (the whole forms, as in tests/test_replay.py), frames (the log: frame_id, seq, session_id,
trace_id, anchor_id, x, c, ts, active_ids, activation, group_entropy, loss; next_trace_id and next_ts by link_frames),
anchors (anchor_id, z), active (trace_id, activation: the workspace's), hot (trace_id).
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mnemos.config import BUDGET, FIELD, REPLAY, BudgetConfig, FieldConfig, ReplayConfig
from mnemos.functions import costs
from mnemos.functions.vectors import safe_variance
from mnemos.operators import cycle, folds, graph, groups_merge, maintenance, objective, replay, roles
from mnemos.sources.stages import Stages

#: Fixed values that results depend on.
EDGE_RATE, ASSOC_DELTA, RESTORE, PRESSURE_DEMOTE = 0.15, 0.05, 0.18, 1.10


@dataclass
class Cycle:
    """The state after a cycle, and what it did: ids by what happened to them, and one row of the objective."""

    tables: dict[str, DataFrame]
    changed: dict[str, DataFrame] = field(default_factory=dict)
    objective: DataFrame | None = None


def sample(frames: DataFrame, traces: DataFrame, edges: DataFrame, members: DataFrame, now: float, batch: int, seed: int, stages: Stages | None = None) -> DataFrame:
    """The replay batch, in the order of the log: complete frames of live traces. A frame conflicts by its entropy, or where
    its trace is in a group."""
    live = frames.where("next_trace_id is not null").join(traces.select("trace_id"), "trace_id", "left_semi")
    ranked = maintenance.replay_priority(live, traces, edges, now)
    grouped = ranked.join(members.select("trace_id", F.lit(1).alias("_g")).distinct(), "trace_id", "left")
    ranked = grouped.withColumn("group_entropy", F.when(F.col("_g").isNotNull(), F.greatest("group_entropy", F.lit(1.0))).otherwise(F.col("group_entropy"))).drop("_g")
    stages = stages or Stages(frames.sparkSession, "sample")
    return frames.join(stages.keep(maintenance.sample_replay(ranked, batch, seed, stages=stages), "sampled"), "frame_id", "left_semi")


def reconsolidated(batch: DataFrame, traces: DataFrame, config: FieldConfig = FIELD, stages: Stages | None = None) -> DataFrame:
    """Traces after the batch: each frame's activations of live traces, its own trace added with 1 if it has none there,
    normalised; the anchor goes to the trace of most (the frame's own among equals)."""
    stages = stages or Stages(traces.sparkSession, "reconsolidated")
    near = replay.batch_traces(batch, traces, stages)
    each = batch.select("frame_id", "trace_id", F.explode("activation").alias("t", "r")).where("r > 0").select("frame_id", F.col("t").alias("trace_id"), "r")
    own = batch.select("frame_id", "trace_id").join(each.select("frame_id", "trace_id"), ["frame_id", "trace_id"], "left_anti").withColumn("r", F.lit(1.0))
    parts = each.unionByName(own).join(near.select("trace_id"), "trace_id", "left_semi")
    total = parts.groupBy("frame_id").agg(F.sum("r").alias("_t")).where("_t > 1e-8")
    rows = parts.join(total, "frame_id").withColumn("r", F.col("r") / F.col("_t")).drop("_t")
    info = batch.select("frame_id", F.col("trace_id").alias("_own"), "x", "c", "loss", "ts", "seq", "anchor_id")
    rows = rows.join(info, "frame_id")
    top = rows.groupBy("frame_id").agg(F.max_by("trace_id", F.struct("r", F.col("trace_id") == F.col("_own"), F.col("trace_id"))).alias("_top"))
    steps = rows.join(top, "frame_id").withColumn("anchor_id", F.when(F.col("trace_id") == F.col("_top"), F.col("anchor_id"))).select("trace_id", "r", "x", "c", "loss", "ts", "seq", "anchor_id")
    steps = stages.keep(steps, "steps")
    touched = near.join(steps.select("trace_id").distinct(), "trace_id", "left_semi")
    return replaced(traces, stages.keep(folds.reconsolidate(touched, steps, config), "folded"))


def replaced(traces: DataFrame, rows: DataFrame) -> DataFrame:
    """traces with the columns that rows (by trace_id) bring. Rows that are written and few meet all traces without a shuffle."""
    new = [c for c in rows.columns if c != "trace_id"]
    both = traces.join(rows.select("trace_id", F.struct(*new).alias("_new")), "trace_id", "left")
    return both.select(*(F.when(F.col("_new").isNotNull(), F.col(f"_new.{c}")).otherwise(F.col(c)).alias(c) if c in new else F.col(c) for c in traces.columns))


def merged_edges(edges: DataFrame, rows: DataFrame, stages: Stages) -> DataFrame:
    """edges with rows (src, dst, kind and some columns) put over them; a new edge starts from what a new edge has. A null of
    rows leaves what the edge has."""
    keys = ["src", "dst", "kind"]
    new = [c for c in rows.columns if c not in ("src", "dst", "kind")]
    start = {"bf_sep_ema": 0.0, "success_alpha": 1.0, "success_beta": 1.0, "weight": 0.0, "support_ema": 0.0, "last_update_ts": 0.0}
    # rows are few where a batch is: written, they meet all edges without a shuffle of these
    rows = stages.keep(rows.select(*keys, F.struct(*new).alias("_new")), "edge-rows")
    known = edges.join(rows.select(*keys), keys, "left_semi").select(*keys)
    fresh = rows.join(known, keys, "left_anti").select(*keys, "_new")
    both = edges.join(rows, keys, "left").unionByName(fresh, allowMissingColumns=True)
    value = lambda c: F.coalesce(*([F.col(f"_new.{c}")] if c in new else []), F.col(c), F.lit(start[c]))
    return both.select(*(F.col(c) if c in keys else value(c).alias(c) for c in edges.columns))


def touched_edges(edges: DataFrame, deltas: DataFrame) -> DataFrame:
    """The rows of edges that touches (src, dst, kind, delta, ts, seq) change or make, of any kind but option."""
    near = edges.join(deltas.select("src", "dst", "kind").distinct(), ["src", "dst", "kind"], "left_semi")
    return graph.upsert_edges(deltas, near)


def touch(edges: DataFrame, deltas: DataFrame, stages: Stages) -> DataFrame:
    """edges after touches."""
    return merged_edges(edges, touched_edges(edges, deltas), stages)


def replay_edges(batch: DataFrame, traces: DataFrame, edges: DataFrame, stages: Stages) -> DataFrame:
    """Edges after the batch's steps between live traces: temporal +0.15, option where a success pays, and +0.05 from a
    frame's trace to each other live active one. An option is judged against its temporal edge as that step leaves it."""
    live = replay.batch_traces(batch, traces, stages).select("trace_id")
    steps = batch.where("next_trace_id is not null").join(live, "trace_id", "left_semi").join(live.select(F.col("trace_id").alias("next_trace_id")), "next_trace_id", "left_semi")
    steps = stages.keep(steps, "steps")
    at = F.coalesce("next_ts", "ts")
    ends = (F.col("trace_id").alias("src"), F.col("next_trace_id").alias("dst"))
    temporal = steps.select(*ends, F.lit("temporal").alias("kind"), F.lit(EDGE_RATE).alias("delta"), at.alias("ts"), "seq")
    active = steps.select(F.col("trace_id").alias("src"), F.explode("active_ids").alias("trace_id"), "ts", "seq").where("src != trace_id").join(live, "trace_id", "left_semi")
    assoc = active.select("src", F.col("trace_id").alias("dst"), F.lit("assoc").alias("kind"), F.lit(ASSOC_DELTA).alias("delta"), "ts", "seq")
    deltas = stages.keep(temporal.unionByName(assoc), "touches")
    near = edges.join(deltas.select("src", "dst").distinct(), ["src", "dst"], "left_semi").select(*edges.columns)
    near = stages.keep(near, "near-edges")
    options = take_options(steps.select(*ends, (1.0 - F.least("loss", F.lit(1.0))).alias("success"), at.alias("ts"), "seq"), near)
    # touches are of other kinds than options, so both are put over the edges at once
    rows = touched_edges(near, deltas).unionByName(stages.keep(options, "options"), allowMissingColumns=True)
    return stages.keep(merged_edges(edges, rows, stages), "edges")


def take_options(transitions: DataFrame, edges: DataFrame) -> DataFrame:
    """The option edges that successes change, in order, while each step also moves the temporal edge."""
    near = edges.join(transitions.select("src", "dst").distinct(), ["src", "dst"], "left_semi")
    found = folds.option_edges(transitions, near, grow=EDGE_RATE).where("taken > 0")
    last = transitions.groupBy("src", "dst").agg(F.max("ts").alias("last_update_ts"))
    old = edges.where("kind = 'option'").select("src", "dst", F.col("weight").alias("_w"), F.col("support_ema").alias("_s"))
    rows = found.join(last, ["src", "dst"]).join(old, ["src", "dst"], "left")
    support = F.col("weight") - F.pow(F.lit(FIELD.edge_decay), F.col("taken").cast("double")) * F.coalesce(F.col("_w") - F.col("_s"), F.lit(0.0))
    return rows.select("src", "dst", F.lit("option").alias("kind"), "weight", support.alias("support_ema"), "last_update_ts", "success_alpha", "success_beta")


def set_apart(pairs: DataFrame, traces: DataFrame, edges: DataFrame, groups_: DataFrame, stages: Stages, config: FieldConfig = FIELD) -> tuple[DataFrame, DataFrame]:
    """edges and groups after pairs (seq, first, second, x, c, ts): inhibiting edges both ways by 0.25 of the Bayes factor
    where that lowers the objective, its running mean, and a group where that mean and the overlap are high."""
    ends = pairs.select(F.explode(F.array("first", "second")).alias("trace_id")).distinct()
    near_traces = stages.keep(traces.join(ends, "trace_id", "left_semi").select(*traces.columns), "near")
    judged = stages.keep(replay.separated(pairs, near_traces).where(-0.30 * F.greatest("bf", F.lit(0.0)) + 0.008 < 0), "apart")
    both = judged.select("seq", "ts", "bf", F.explode(F.array(F.struct(F.col("first").alias("src"), F.col("second").alias("dst")), F.struct(F.col("second").alias("src"), F.col("first").alias("dst")))).alias("e")).select("seq", "ts", "bf", "e.src", "e.dst", F.lit("inhib").alias("kind"))
    near = stages.keep(edges.join(both.select("src", "dst", "kind").distinct(), ["src", "dst", "kind"], "left_semi").select(*edges.columns), "near-edges")
    moved = touched_edges(near, both.withColumn("delta", 0.25 * F.greatest("bf", F.lit(0.0))))
    # the running mean is the same recurrence: .95 of itself and .05 of each factor
    ema = graph.upsert_edges(both.withColumn("delta", 0.05 * F.col("bf")), near.select("src", "dst", "kind", F.col("bf_sep_ema").alias("weight"), F.lit(0.0).alias("support_ema"), "last_update_ts"))
    ema = stages.keep(ema, "separation")
    rows = moved.join(ema.select("src", "dst", "kind", F.col("weight").alias("bf_sep_ema")), ["src", "dst", "kind"])
    out = stages.keep(merged_edges(edges, rows, stages), "edges")
    mean = ema.select(F.col("src").alias("first"), F.col("dst").alias("second"), F.col("weight").alias("_ema"))
    asked = judged.join(mean, ["first", "second"]).select("seq", "first", "second", F.lit(1.0).alias("ambiguity"), F.col("_ema").alias("bf"), "overlap")
    members, _ = groups_merge.merge_pairs(asked, groups_, stages, config=config)
    return out, stages.keep(groups_merge.rebuild_groups(groups_, members, near_traces), "groups")


def continued(batch: DataFrame, traces: DataFrame, edges: DataFrame, groups_: DataFrame, stages: Stages, config: FieldConfig = FIELD) -> tuple[DataFrame, DataFrame]:
    """MT4 for traces and groups: a frame counts for the groups of its trace and of the next one, once each."""
    near = replay.batch_traces(batch, traces, stages)
    between = stages.keep(edges.join(batch.select(F.col("trace_id").alias("src"), F.col("next_trace_id").alias("dst")).distinct(), ["src", "dst"], "left_semi").select(*edges.columns), "near-edges")
    # traces that the batch doesn't name keep what they have
    stats = stages.keep(maintenance.continuation_stats(batch.withColumn("pred_loss", F.col("loss")), near, between, config), "stats")
    out = stages.keep(replaced(traces, stats), "traces")
    member = groups_.select("group_id", F.explode("member_ids").alias("trace_id")).join(near.select("trace_id"), "trace_id", "left_semi")
    ends = batch.select("frame_id", "loss", "next_trace_id", F.explode(F.array_distinct(F.filter(F.array("trace_id", "next_trace_id"), lambda t: t.isNotNull()))).alias("trace_id"))
    mine = ends.join(member, "trace_id").select("frame_id", "group_id", F.when(F.col("next_trace_id").isNotNull(), F.greatest("loss", F.lit(0.0))).otherwise(0.0).alias("v")).distinct()
    align = stages.keep(mine.groupBy("group_id").agg(F.avg("v").alias("_align")), "align")
    d, g = config.continuation_decay, config.continuation_group_decay
    tension = g * F.col("replay_tension_ema") + (1 - d) * (F.col("unresolved_mass") + F.abs(F.col("temperature") - 1.0))
    new = groups_.join(align, "group_id", "left").withColumns({"replay_alignment_ema": F.when(F.col("_align").isNull(), F.col("replay_alignment_ema")).otherwise(g * F.col("replay_alignment_ema") + (1 - d) * F.col("_align")), "replay_tension_ema": tension})
    return out, stages.keep(new.select(*groups_.columns), "groups")


def _empty() -> Column:
    return F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<double>"))


def _put(m: str, key: str, value: Column) -> Column:
    own = F.coalesce(F.col(m), _empty())
    return F.map_concat(F.map_filter(own, lambda k, _: k != key), F.create_map(F.lit(key), value))


def promote(rows: DataFrame, traces: DataFrame, role: str, stages: Stages, config: FieldConfig = FIELD) -> tuple[DataFrame, DataFrame]:
    """Traces after patterns (trace_id, support, gain, promoted, ids): support and gain by decay, all patterns of a trace in
    the order of their ids; a promoted one raises the role's logit where the objective falls. Also the ids promoted.

    A trace has few patterns in a batch; the first that is promoted decides, as a second has the same members or path.
    """
    pats = rows.groupBy("trace_id").agg(F.array_sort(F.collect_list(F.struct("ids", "support", "gain", "promoted"))).alias("_p"))
    base = traces.join(pats, "trace_id")
    fold = lambda start, d, f: F.aggregate("_p", start, lambda acc, p: d * acc + f(p))
    support = fold(costs.role("role_support", role), config.role_support_decay, lambda p: p["support"].cast("double"))
    gain = fold(costs.role("role_gain_ema", role), config.role_gain_decay, lambda p: (1 - config.role_gain_decay) * p["gain"])
    base = base.withColumns({"role_support": _put("role_support", role, support), "role_gain_ema": _put("role_gain_ema", role, gain)})
    chosen = F.get(F.filter("_p", lambda p: p["promoted"]), F.lit(0))["ids"]
    base = base.withColumn("_ids", chosen)
    path = role == costs.PROCEDURE
    judged = roles.accept_promotion(base, role, None if path else F.col("_ids"), config)
    if path:
        judged = judged.withColumn("promote_delta", F.col("promote_delta") + config.lambda_storage * 0.05 * config.base_trace_cost * (0.35 + 0.65 * costs.clip(F.col("fidelity"), 0.0, 1.0)) * (F.size("_ids") - F.size("path_signature"))).withColumn("promoted", F.col("promote_delta") < 0)
    yes = F.col("promoted") & F.col("_ids").isNotNull()
    logits = F.map_concat(F.map_filter(F.coalesce("role_logits", _empty()), lambda k, _: ~k.isin(role, "episodic")), F.create_map(F.lit(role), F.least(costs.role("role_logits", role) + roles.STEP, F.lit(roles.TOP)), F.lit("episodic"), F.greatest(F.coalesce(F.col("role_logits")["episodic"], F.lit(1.0)) - 0.05, F.lit(0.0))))
    place = "path_signature" if path else "member_ids"
    out = judged.withColumns({"_yes": F.coalesce(yes, F.lit(False))}).withColumns({"role_logits": F.when(F.col("_yes"), logits).otherwise(F.col("role_logits")), place: F.when(F.col("_yes"), F.col("_ids")).otherwise(F.col(place))})
    out = stages.keep(out.select("trace_id", "role_support", "role_gain_ema", "role_logits", place, "_yes", "_ids"), "judged")
    return replaced(traces, out.drop("_yes", "_ids")), out.where("_yes").select("trace_id", "_ids")


def promote_prototypes(batch: DataFrame, traces: DataFrame, stages: Stages, config: FieldConfig = FIELD, limits: ReplayConfig = REPLAY) -> tuple[DataFrame, DataFrame]:
    found = stages.keep(maintenance.prototype_patterns(batch, replay.batch_traces(batch, traces, stages), limits, config), "patterns")
    rows = found.select(F.col("medoid").alias("trace_id"), "support", "gain", "promoted", F.split("members", ",").alias("ids"))
    out, ids = promote(rows, traces, costs.PROTOTYPE, stages, config)
    return stages.keep(out, "traces"), stages.keep(ids.select("trace_id"), "prototypes")


def promote_procedures(batch: DataFrame, traces: DataFrame, edges: DataFrame, now: float, stages: Stages, config: FieldConfig = FIELD, limits: ReplayConfig = REPLAY) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Also edges: a promoted pair's option edge is touched by 0.10 of its success where that pays."""
    found = stages.keep(maintenance.procedure_patterns(batch.withColumn("pred_loss", F.col("loss")), replay.batch_traces(batch, traces, stages), limits), "patterns")
    rows = found.select(F.col("src").alias("trace_id"), "support", "gain", "promoted", F.array("src", "dst").alias("ids"))
    out, ids = promote(rows, traces, costs.PROCEDURE, stages, config)
    out, ids = stages.keep(out, "traces"), stages.keep(ids, "procedures")
    pairs = ids.select(F.col("_ids")[0].alias("src"), F.col("_ids")[1].alias("dst")).join(found.select("src", "dst", "success"), ["src", "dst"])
    pairs = stages.keep(pairs, "pairs")
    near = stages.keep(edges.join(pairs.select("src", "dst"), ["src", "dst"], "left_semi").select(*edges.columns), "near-edges")
    support = graph.transition_support(pairs.select("src", "dst"), near)
    old = near.where("kind = 'option'").select("src", "dst", "weight", "support_ema", "success_alpha", "success_beta", F.lit(True).alias("_is"))
    judged = pairs.join(support, ["src", "dst"]).join(old, ["src", "dst"], "left")
    pays = F.when(F.col("_is"), F.col("success") > F.col("support")).otherwise(0.05 * 0.115 + 0.03 * 0.15 + 0.08 * (1 - F.greatest("support", "success")) < 0.08 * (1 - F.col("support")))
    grown = lambda c: F.when(F.col("_is"), 0.95 * F.col(c) + 0.10 * F.col("success")).otherwise(0.10 * F.col("success"))
    beta = lambda c, v: 0.98 * F.coalesce(F.col(c), F.lit(1.0)) + v
    taken = judged.where(pays).select("src", "dst", F.lit("option").alias("kind"), grown("weight").alias("weight"), grown("support_ema").alias("support_ema"), F.lit(now).alias("last_update_ts"), beta("success_alpha", F.col("success")).alias("success_alpha"), beta("success_beta", 1 - F.col("success")).alias("success_beta"))
    return out, stages.keep(merged_edges(edges, taken, stages), "edges"), ids.select("trace_id")


def rehydrated(traces: DataFrame, anchors: DataFrame, frames: DataFrame, chosen: DataFrame, stages: Stages, config: FieldConfig = FIELD) -> tuple[DataFrame, DataFrame]:
    """Traces of `chosen` that aren't whole, with mean and variance of their reservoir's vectors and of its contexts
    (each anchor's last of frames: anchor_id, c, ts, seq), and the uncertainty after it; and their ids."""
    low = stages.keep(traces.join(chosen.select("trace_id").distinct(), "trace_id", "left_semi").where("fidelity < 0.999").select(*traces.columns), "low")
    out = maintenance.rehydrate(low, anchors, config)
    held = low.select("trace_id", F.explode("anchor_reservoir").alias("anchor_id"))
    has = held.join(anchors.select("anchor_id"), "anchor_id", "left_semi").select("trace_id").distinct().withColumn("_has", F.lit(True))
    contexts = frames.join(held.select("anchor_id").distinct(), "anchor_id", "left_semi").groupBy("anchor_id").agg(F.max_by("c", F.struct("ts", "seq")).alias("c"))
    parts = held.join(contexts, "anchor_id").select("trace_id", F.posexplode("c").alias("i", "v"))
    stats = parts.groupBy("trace_id", "i").agg(F.avg("v").alias("m"), F.var_pop("v").alias("s")).groupBy("trace_id").agg(F.array_sort(F.collect_list(F.struct("i", "m", "s"))).alias("_c"))
    both = out.join(has, "trace_id", "left").join(stats, "trace_id", "left")
    known = F.col("_has").isNotNull() & F.col("_c").isNotNull()
    var = safe_variance(F.transform("_c", lambda p: p["s"] + config.sigma_floor), config.sigma_floor, config.sigma_ceiling)
    both = both.withColumns({"ctx_mu": F.when(known, F.transform("_c", lambda p: p["m"])).otherwise(F.col("ctx_mu")), "ctx_sigma_diag": F.when(known, var).otherwise(F.col("ctx_sigma_diag"))})
    both = both.withColumn("uncertainty", F.when(F.col("_has").isNotNull(), costs.uncertainty(config)).otherwise(F.col("uncertainty")))
    both = stages.keep(both.select("trace_id", "z_mu", "z_sigma_diag", "ctx_mu", "ctx_sigma_diag", "fidelity", "compression_stage", "uncertainty"), "restored")
    return replaced(traces, both), low.select("trace_id")


def pressure_of(traces: DataFrame, edges: DataFrame, groups_: DataFrame, budget: BudgetConfig) -> float:
    return float(objective.budget_masses(traces, edges, groups_, budget).first()["pressure"])


def fidelity_step(state: dict[str, DataFrame], now: float, stages: Stages, budget: BudgetConfig = BUDGET, config: FieldConfig = FIELD) -> tuple[DataFrame, DataFrame, DataFrame]:
    """traces, and the ids compressed and rehydrated: active and hot ones first come back, then, above a pressure of 1, others
    are compressed until the traces' mass is within its cap."""
    traces, awake = state["traces"], state["active"].select("trace_id", "activation").unionByName(state["hot"].select("trace_id", F.lit(0.0).alias("activation"))).groupBy("trace_id").agg(F.max("activation").alias("activation"))
    awake = stages.keep(awake, "awake")
    chosen = awake.join(traces.select("trace_id", "access_ema"), "trace_id").where((F.col("activation") >= RESTORE) | (F.col("access_ema") >= RESTORE))
    chosen = stages.keep(chosen.select("trace_id"), "chosen")
    out, back = rehydrated(traces, state["anchors"], state["frames"], chosen, stages, config)
    out, back = stages.keep(out, "traces"), stages.keep(back, "rehydrated")
    pressure = pressure_of(out, state["edges"], state["groups"], budget)
    others = objective.budget_masses(out.limit(0), state["edges"], state["groups"], budget).first()["pressure"]
    if pressure <= 1.0:
        return out, back.limit(0), back
    # edges or groups above their own caps aren't helped by compression: it goes on to the end
    cap = budget.max_traces if others <= 1.0 else 1e-9
    small = maintenance.degrade_fidelity(out, now, cap, awake, config).select("trace_id", "fidelity", "compression_stage", "anchor_reservoir", "z_sigma_diag", "ctx_sigma_diag", "uncertainty")
    small = stages.keep(small, "compressed")
    return stages.keep(replaced(out, small), "traces"), small.select("trace_id"), back


def role_step(traces: DataFrame, pressure: float, stages: Stages, config: FieldConfig = FIELD) -> tuple[DataFrame, DataFrame]:
    """Decayed supports and gains; weak roles lose a step where allowed, prototype before procedure. Also the ids demoted."""
    out, ids = maintenance.decay_roles(traces, pressure, config), None
    for role in (costs.PROTOTYPE, costs.PROCEDURE):
        judged = roles.accept_decay(out, pressure, role, config).withColumn("_yes", F.col("demoted") & F.col(f"demote_{role}"))
        new = F.greatest(costs.role("role_logits", role) - roles.STEP, F.lit(0.0))
        logits = F.map_concat(F.map_filter(F.coalesce("role_logits", _empty()), lambda k, _: ~k.isin(role, "episodic")), F.create_map(F.lit(role), new, F.lit("episodic"), F.least(costs.role("role_logits", "episodic") + 0.5 * roles.STEP, F.lit(roles.TOP))))
        place = "member_ids" if role == costs.PROTOTYPE else "path_signature"
        out = judged.withColumns({place: F.when(F.col("_yes") & (new <= 0.1), F.array().cast("array<string>")).otherwise(F.col(place)), "role_logits": F.when(F.col("_yes"), logits).otherwise(F.col("role_logits"))}).drop("decay_delta", "demoted")
        out = stages.keep(out.withColumnRenamed("_yes", f"_{role}"), "roles")
    ids = out.where("_prototype or _procedure").select("trace_id")
    return out.select(*traces.columns), ids


def budget_step(state: dict[str, DataFrame], now: float, stages: Stages, budget: BudgetConfig = BUDGET, config: FieldConfig = FIELD) -> tuple[dict[str, DataFrame], DataFrame]:
    """traces, edges and groups without what the pressure prunes, and the ids of the traces that went; what pointed at them
    goes with them. The pressure is that of the start of the step."""
    traces, edges, groups_, active = state["traces"], state["edges"], state["groups"], state["active"].select("trace_id").distinct()
    pressure = pressure_of(traces, edges, groups_, budget)
    end = lambda c: active.select(F.col("trace_id").alias(c), F.lit(True).alias(f"_{c}"))
    scored = edges.join(end("src"), "src", "left").join(end("dst"), "dst", "left").withColumns({"_score": (0.60 * F.col("support_ema") + 0.30 * F.col("weight") + 0.10 * F.col("bf_sep_ema")) / costs.edge_storage_cost(config=config), "_key": F.concat_ws("\x1f", "src", "dst", "kind"), "_ok": F.col("_src").isNull() & F.col("_dst").isNull()})
    scored = scored.select("src", "dst", "kind", "_score", "_key", "_ok")
    gone = stages.keep(maintenance.prune(scored, "_score", "_key", "_ok", budget.max_edges, pressure, budget.prune_fraction).select("src", "dst", "kind"), "edges-gone")
    edges = edges.join(gone, ["src", "dst", "kind"], "left_anti").select(*edges.columns)
    score = 0.55 * F.col("unresolved_mass") + 0.25 * F.size("member_ids") + 0.20 * F.greatest("temperature", F.lit(0.0))
    ranked = groups_.withColumns({"_score": score / costs.group_storage_cost(config), "_ok": F.lit(True)}).select("group_id", "_score", "_ok")
    gone = stages.keep(maintenance.prune(ranked, "_score", "group_id", "_ok", budget.max_groups, pressure, budget.prune_fraction).select("group_id"), "groups-gone")
    groups_ = groups_.join(gone, "group_id", "left_anti").select(*groups_.columns)
    able = (costs.structural_role_mass() < config.active_role_threshold) & (F.col("fidelity") <= config.fidelity_prune_floor)
    judged = traces.join(active.withColumn("_a", F.lit(True)), "trace_id", "left").withColumns({"_ok": able & F.col("_a").isNull(), "_score": costs.budget_utility(now) / costs.storage_cost(config)}).select("trace_id", "_score", "_ok")
    gone = stages.keep(maintenance.prune(judged, "_score", "trace_id", "_ok", budget.max_traces, pressure, budget.prune_fraction).select("trace_id"), "traces-gone")
    traces = traces.join(gone, "trace_id", "left_anti").select(*traces.columns)
    edges = graph.drop_dangling_edges(edges, gone).select(*edges.columns)
    return {"traces": stages.keep(traces, "traces"), "edges": stages.keep(edges, "edges"), "groups": stages.keep(without_members(groups_, gone), "groups")}, gone


def without_members(groups_: DataFrame, gone: DataFrame) -> DataFrame:
    """Members that are gone leave with their places in all arrays; the null slot stays last."""
    held = groups_.select("group_id", F.posexplode("member_ids").alias("i", "trace_id")).join(gone.select("trace_id").distinct(), "trace_id").groupBy("group_id").agg(F.collect_set("i").alias("_gone"))
    cut = groups_.join(held, "group_id")
    keep = lambda c: F.filter(c, lambda _, i: ~F.array_contains("_gone", i))
    left = cut.withColumns({c: keep(c) for c in ("member_ids", "alpha", "ctx_mu", "ctx_sigma_diag", "pred_success_ema")}).select(*groups_.columns)
    return groups_.join(held.select("group_id"), "group_id", "left_anti").select(*groups_.columns).unionByName(left)


def objective_step(batch: DataFrame, state: dict[str, DataFrame], touched_groups: DataFrame | None, changed: DataFrame, settled: DataFrame | None, stages: Stages, config: FieldConfig = FIELD) -> DataFrame:
    """One row: the objective of the traces that the batch touched, over its frames, with the drift of replay.

    settled: (frame_id, trace_id, a), the frames settled anew by the state as it is now (see turn.settled_frames); without it
    no divergence is charged. Its column group_kl, if it has one, is charged as the frames' mean.
    """
    traces = state["traces"]
    named = batch.select(F.explode(F.array_distinct(F.filter(F.concat(F.array("trace_id", "next_trace_id"), "active_ids"), lambda t: t.isNotNull()))).alias("trace_id")).distinct()
    ids = stages.keep(traces.select("trace_id").join(named, "trace_id", "left_semi"), "touched")
    # what is near the touched traces: their edges, their groups, and the members of those
    edges, groups_ = stages.keep(graph.touching(state["edges"], ids), "near-edges"), stages.keep(replay.groups_of(state["groups"], ids), "near-groups")
    near = stages.keep(traces.join(ids.union(groups_.select(F.explode("member_ids"))).distinct(), "trace_id", "left_semi").select(*traces.columns), "near")
    past = batch.select("frame_id", F.explode("activation").alias("trace_id", "a"))
    live = batch.where("next_trace_id is not null").join(ids, "trace_id", "left_semi").join(ids.select(F.col("trace_id").alias("next_trace_id")), "next_trace_id", "left_semi")
    heat = state["groups"].limit(0) if touched_groups is None else state["groups"].join(touched_groups, "group_id", "left_semi")
    drift = cycle.replay_objective(past if settled is not None else past.limit(0), past.limit(0) if settled is None else settled, live.select(F.col("trace_id").alias("src"), F.col("next_trace_id").alias("dst")), edges, heat, changed, ids)
    one = lambda df: df.withColumn("patch_id", F.lit("batch"))
    seen = one(batch.select(F.col("frame_id").alias("obs_id"), "x", "c", *(["target"] if "target" in batch.columns else [])))
    local = one(near.join(ids, "trace_id", "left_semi"))
    plain = objective.patch_objective(local, seen, edges, groups_, near)
    plastic = near.join(ids, "trace_id", "left_semi").agg(F.coalesce(F.avg(F.greatest("pred_loss_ema", F.lit(0.0))), F.lit(0.0)).alias("plasticity"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    tense = F.lit(0.0)
    if settled is not None and "group_kl" in settled.columns:
        each = settled.groupBy("frame_id").agg(F.max("group_kl").alias("k"))
        drift = drift.join(batch.select("frame_id").join(each, "frame_id", "left").agg(F.coalesce(F.avg(F.coalesce("k", F.lit(0.0))), F.lit(0.0)).alias("_w")), F.lit(True), "left")
        tense = F.col("_w")
    terms = ("surprise", "storage", "complexity", "slow_alignment", "fidelity", "role")
    base = drift.withColumnRenamed("drift", "_drift").crossJoin(plastic).join(plain.select(*terms, F.col("drift").alias("_d"), F.col("group_kl").alias("_k")), F.lit(True), "left")
    row = base.select("activation_kl", "transition_gap", "group_heat", "churn", "plasticity", *(zero(c).alias(c) for c in terms), (zero("_d") + F.col("_drift")).alias("drift"), (zero("_k") + F.col("group_heat") + tense).alias("group_kl"))
    return stages.keep(objective.combine_objective(row), "objective")


def maintenance_cycle(state: dict[str, DataFrame], now: float, batch: int = 10, seed: int = 7, budget: BudgetConfig = BUDGET, config: FieldConfig = FIELD, limits: ReplayConfig = REPLAY, score: Callable[[DataFrame], DataFrame] | None = None, settle: Callable[[DataFrame, dict[str, DataFrame]], DataFrame] | None = None, stages: Stages | None = None) -> Cycle:
    """One cycle. score gives frames their `loss` (a transition model that was fitted on them, say; else the log's own);
    settle gives (frame_id, trace_id, a) of frames by the state after the cycle.

    An empty sample runs fidelity and the objective alone.
    """
    spark = state["traces"].sparkSession
    stages = stages or Stages(spark, "maintenance")
    s = dict(state)
    if "hot" not in s:
        s["hot"] = stages.keep(maintenance.hot_traces(s["traces"], config.frontier_size).select("trace_id"), "hot")
    s.setdefault("active", s["traces"].select("trace_id", F.lit(0.0).alias("activation")).limit(0))
    members = groups_merge.explode_members(s["groups"])
    frames = stages.keep(sample(s["frames"], s["traces"], s["edges"], members, now, batch, seed, stages), "batch")
    changed: dict[str, DataFrame] = {}
    if frames.isEmpty():
        s["traces"], changed["compressed"], changed["rehydrated"] = fidelity_step(s, now, stages, budget, config)
        return Cycle(s, changed, objective_step(frames, s, None, changed["compressed"], None, stages, config))
    if score is not None:
        frames = stages.keep(score(frames), "scored")
    s["traces"] = stages.keep(reconsolidated(frames, s["traces"], config, stages), "traces")
    s["groups"], s["traces"], touched = replay.replay_groups(frames, s["traces"], s["groups"], stages, config)
    before = s["traces"]
    s["traces"], made, apart = replay.replay_mutations(frames, s["traces"], s["edges"], s["groups"], stages, config=config)
    if not apart.isEmpty():
        s["edges"], s["groups"] = set_apart(apart, before, s["edges"], s["groups"], stages, config)
    if not made.isEmpty():
        s["groups"], s["traces"], again = replay.replay_groups(frames, s["traces"], s["groups"], stages, config)
        touched = touched.union(again).distinct()
    changed["structural"] = made.select(F.col("child").alias("trace_id"))
    s["edges"] = replay_edges(frames, s["traces"], s["edges"], stages)
    s["traces"], s["groups"] = continued(frames, s["traces"], s["edges"], s["groups"], stages, config)
    s["traces"], changed["prototypes"] = promote_prototypes(frames, s["traces"], stages, config, limits)
    s["traces"], s["edges"], changed["procedures"] = promote_procedures(frames, s["traces"], s["edges"], now, stages, config, limits)
    s["traces"], changed["compressed"], changed["rehydrated"] = fidelity_step(s, now, stages, budget, config)
    s["traces"], changed["demoted"] = role_step(s["traces"], pressure_of(s["traces"], s["edges"], s["groups"], budget), stages, config)
    left, changed["pruned"] = budget_step(s, now, stages, budget, config)
    s |= left
    s["hot"] = stages.keep(maintenance.hot_traces(s["traces"], config.frontier_size).select("trace_id"), "hot")
    any_ = changed["structural"].union(changed["compressed"]).union(changed["demoted"]).union(changed["pruned"]).distinct()
    row = objective_step(frames, s, touched, any_, settle(frames, s) if settle else None, stages, config)
    return Cycle(s, changed, row)
