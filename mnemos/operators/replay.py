"""What replay does to groups and traces: proposals, updates and mutations of a sampled batch.

A batch (frames in their order `seq`) has frame_id, seq, session_id, trace_id, anchor_id, x, c, ts, loss, group_entropy,
active_ids, activation; next_ts and target (the next vector) if there are any. Bayes factors and densities are of the
traces at the step's start; what is created is seen by later frames.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mnemos.config import FIELD, FieldConfig
from mnemos.functions import costs
from mnemos.functions.vectors import safe_variance
from mnemos.operators import actions, folds, graph, groups_merge, objective
from mnemos.operators.groups import separate_pairs
from mnemos.sources.stages import Stages

_PAIR = ("trace_id", "evidence", "stability", "uncertainty", "z_mu", "z_sigma_diag", "ctx_mu", "ctx_sigma_diag")


def separated(pairs: DataFrame, traces: DataFrame) -> DataFrame:
    """pairs (first, second, x, c, ...) of live traces with bf and overlap."""
    side = lambda key, name: traces.select(F.col("trace_id").alias(key), F.struct(*_PAIR).alias(name))
    return separate_pairs(pairs.join(side("first", "a"), "first").join(side("second", "b"), "second")).drop("a", "b")


def batch_traces(batch: DataFrame, traces: DataFrame, stages: Stages) -> DataFrame:
    """The live traces that a batch names, written: its steps look at these and not at all traces."""
    named = F.concat(F.array("trace_id", "next_trace_id"), F.coalesce("active_ids", F.array().cast("array<string>")), F.coalesce(F.map_keys("activation"), F.array().cast("array<string>")))
    ids = batch.select(F.explode(named).alias("trace_id")).distinct()
    return stages.keep(traces.join(ids, "trace_id", "left_semi").select(*traces.columns), "near")


def propose_groups(batch: DataFrame, traces: DataFrame, config: FieldConfig = FIELD) -> DataFrame:
    """(seq, first, second, guard, ambiguity, bf, overlap): the top two active traces of each frame where they are nearly
    even; the frame's own trace guards, as a frame whose trace has a group by then proposes nothing."""
    top = objective.ambiguity_pairs(batch.select(F.col("seq").alias("obs_id"), F.explode("activation").alias("trace_id", "resp")), config.inhibit_margin)
    rows = top.join(batch.select(F.col("seq").alias("obs_id"), F.col("trace_id").alias("guard"), "x", "c"), "obs_id").withColumnRenamed("obs_id", "seq")
    return separated(rows, traces).select("seq", "first", "second", "guard", (1.0 - F.abs("gap")).alias("ambiguity"), "bf", "overlap")


def groups_of(groups: DataFrame, ids: DataFrame) -> DataFrame:
    """Groups that hold one of ids (trace_id)."""
    held = groups.select("group_id", F.explode("member_ids").alias("trace_id")).join(ids.select("trace_id").distinct(), "trace_id", "left_semi").select("group_id").distinct()
    return groups.join(held, "group_id", "left_semi").select(*groups.columns)


def replay_groups(batch: DataFrame, traces: DataFrame, groups: DataFrame, stages: Stages, config: FieldConfig = FIELD) -> tuple[DataFrame, DataFrame, DataFrame]:
    """groups and traces after the batch's proposals and updates, and the groups touched (group_id).

    A frame updates the groups its trace is in by then, and the one its own proposal made, extended or found.
    """
    near = batch_traces(batch, traces, stages)
    members, outcomes = groups_merge.merge_pairs(propose_groups(batch, near, config), groups, stages, config=config)
    merged = stages.keep(groups_merge.rebuild_groups(groups, members, near), "groups")
    own = batch.select("seq", "trace_id").join(members.where("slot is not null"), "trace_id").where("since is null or since < seq").select("seq", "group_id")
    met = stages.keep(own.union(outcomes).distinct(), "met")
    seen = stages.keep(met.join(batch.select("seq", "x", "c", "ts", "anchor_id", "loss"), "seq"), "group-frames")
    touched = stages.keep(met.select("group_id").distinct(), "touched")
    columns = merged.columns
    # a group that no frame met stays as it is and takes no part in the fold
    mine = stages.keep(merged.join(touched, "group_id", "left_semi").select(*columns), "met-groups")
    updated = stages.keep(folds.update_groups(mine, traces, seen), "updated")
    changed = mine.select("group_id", "member_ids").join(updated, "group_id").select(*columns)
    out = stages.keep(merged.join(updated.select("group_id"), "group_id", "left_anti").select(*columns).unionByName(changed), "groups")
    # a member of several groups widens by each
    factor = mine.select("group_id", F.posexplode("member_ids").alias("i", "trace_id")).join(updated.select("group_id", F.posexplode("inflation").alias("i", "f")), ["group_id", "i"]).groupBy("trace_id").agg(F.exp(F.sum(F.log("f"))).alias("_f")).where("_f > 1")
    factor = stages.keep(factor, "factor")
    return out, stages.keep(widen(traces, factor, config), "traces"), touched


def widen(traces: DataFrame, factor: DataFrame, config: FieldConfig = FIELD) -> DataFrame:
    """Traces' variances times _f, and their uncertainty after it."""
    wide = traces.join(factor, "trace_id").withColumn("z_sigma_diag", safe_variance(F.transform("z_sigma_diag", lambda v: v * F.col("_f")), config.sigma_floor, config.sigma_ceiling)).drop("_f")
    return traces.join(factor.select("trace_id"), "trace_id", "left_anti").unionByName(wide.withColumn("uncertainty", costs.uncertainty(config)))


def _child() -> Column:
    """The id of the trace that a frame makes."""
    return F.concat(F.lit("trace_"), F.substring(F.sha2(F.concat_ws("\x1f", F.lit("replay"), "frame_id", "anchor_id"), 256), 1, 32))


def new_traces(decided: DataFrame, traces: DataFrame, config: FieldConfig = FIELD) -> DataFrame:
    """Trace rows (all columns of traces) of decisions BIRTH and SPLIT: frame_id, session_id, anchor_id, x, c, ts, action, trace_id.

    A child takes half its parent's variance (0.4 at most), its context, and 0.85 of fidelity at least.
    """
    old = traces.select(F.col("trace_id").alias("parent"), F.col("z_sigma_diag").alias("_v"), F.col("ctx_mu").alias("_c"), F.col("ctx_sigma_diag").alias("_cv"), F.col("fidelity").alias("_f"))
    rows = decided.where("action in ('BIRTH', 'SPLIT')").withColumnRenamed("trace_id", "parent").join(old, "parent", "left")
    split = F.col("action") == "SPLIT"
    clamp = lambda c: safe_variance(c, config.sigma_floor, config.sigma_ceiling)
    made = {
        "trace_id": _child(), "z_mu": F.col("x"), "z_sigma_diag": clamp(F.when(split, F.transform("_v", lambda v: F.least(F.lit(0.4), v / 2))).otherwise(F.transform("x", lambda _: F.lit(0.4)))),
        "ctx_mu": F.when(split, F.col("_c")).otherwise(F.col("c")), "ctx_sigma_diag": F.when(split, clamp(F.col("_cv"))).otherwise(F.transform("c", lambda _: F.lit(0.6))), "evidence": F.lit(1.0), "stability": F.lit(0.0), "pred_loss_ema": F.lit(0.0), "access_ema": F.lit(1.0), "last_access_ts": F.col("ts"),
        "fidelity": F.when(split, F.greatest("_f", F.lit(0.85))).otherwise(1.0), "compression_stage": F.lit(0), "anchor_reservoir": F.array("anchor_id"), "parent_trace_id": F.when(split, F.col("parent")), "spawned_from_frame": F.col("frame_id"), "session_id": F.col("session_id"),
        "member_ids": F.array(), "path_signature": F.array(), "future_alignment_ema": F.lit(0.0), "future_drift_ema": F.lit(0.0),
    }
    kinds = {f.name: f.dataType for f in traces.schema}
    out = rows.select(*(made[c].cast(kinds[c]).alias(c) for c in traces.columns if c in made), *(F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<double>")).alias(c) for c in traces.columns if c.startswith("role_")), *([F.lit(1.0).alias("uncertainty")] if "uncertainty" in traces.columns else []))
    return out.withColumn("uncertainty", costs.uncertainty(config)).select(*traces.columns)


def replay_mutations(batch: DataFrame, traces: DataFrame, edges: DataFrame | None, groups: DataFrame | None, stages: Stages, more: DataFrame | None = None, least_gain: float = 0.08, ratio: float = 0.35, config: FieldConfig = FIELD) -> tuple[DataFrame, DataFrame, DataFrame]:
    """traces with those that replay asks for, the decisions taken (frame_id, action, trace_id, child, delta), and pairs to set
    against each other (seq, first, second, x, c, ts, anchor_id, loss).

    Frames go by loss + group_entropy + membership of their anchor, the highest first. A frame is passed over if a trace
    has sprung from it or its anchor is in more than one trace. BIRTH or SPLIT needs a gain of least_gain; another action
    with a pair sets it apart from half that gain on. At most max(1, round(ratio * frames)) traces are made.

    Each creation is a candidate for the later frames of its session, and of no other, so a round scores one frame of each
    session, all sessions at once. The limit then cuts the list where it is reached: what comes after it did nothing.
    Rounds read what is near the batch (its candidates, their edges and groups), which is written before them; the whole
    tables are read for that, and the traces written once at the end.
    more: (frame_id, trace_id), candidates besides a frame's active traces and its own.
    """
    n = batch.count()
    limit = max(1, int(round(n * ratio)))
    membership = lambda t: t.select(F.explode("anchor_reservoir").alias("anchor_id")).join(batch.select("anchor_id").distinct(), "anchor_id", "left_semi").groupBy("anchor_id").agg(F.count(F.lit(1)).alias("_m"))
    held = stages.keep(membership(traces), "membership")
    sprung = traces.where("spawned_from_frame is not null").select(F.col("spawned_from_frame").alias("frame_id"))
    sprung = stages.keep(sprung.join(batch.select("frame_id"), "frame_id", "left_semi"), "sprung")
    first = batch.join(held, "anchor_id", "left").withColumn("priority", F.col("loss") + F.col("group_entropy") + F.coalesce("_m", F.lit(0))).drop("_m")
    order, turn = Window.orderBy(F.desc("priority"), "seq"), Window.partitionBy("session_id").orderBy(F.desc("priority"), "seq")
    ranked = stages.keep(first.withColumns({"place": F.row_number().over(order), "turn": F.row_number().over(turn)}), "ranked")  # a replay batch: tens of rows
    rounds = ranked.agg(F.max("turn")).first()[0] or 0
    before, taken, born_all = traces, None, None
    pairs = batch.select("frame_id", F.explode(F.array_distinct(F.concat("active_ids", F.array("trace_id")))).alias("trace_id"))
    pairs = stages.keep((pairs if more is None else pairs.union(more.select("frame_id", "trace_id"))).distinct(), "mutation-pairs")
    ids = stages.keep(pairs.select("trace_id").union(batch.select(_child())).distinct(), "near-ids")
    if edges is not None:
        edges = stages.keep(graph.touching(edges, ids), "near-edges")
    if groups is not None:
        groups = stages.keep(groups_of(groups, ids), "near-groups")
        ids = ids.union(groups.select(F.explode("member_ids"))).distinct()
    near = stages.keep(traces.join(ids, "trace_id", "left_semi").select(*traces.columns), "near-traces")
    for k in range(1, rounds + 1):
        inside = held if born_all is None else held.union(membership(born_all)).groupBy("anchor_id").agg(F.sum("_m").alias("_m"))
        now = ranked.where(F.col("turn") == k).join(inside, "anchor_id", "left").where("coalesce(_m, 0) <= 1").drop("_m")
        now = stages.keep(now.join(sprung, "frame_id", "left_anti"), "round")
        own = pairs.join(now.select("frame_id"), "frame_id", "left_semi")
        if born_all is not None:
            own = own.union(now.select("frame_id", "session_id").join(born_all.select("session_id", "trace_id"), "session_id").select("frame_id", "trace_id")).distinct()
        live = own.join(now.select("frame_id", "session_id"), "frame_id").join(near.select("trace_id", F.col("session_id").alias("_s")), "trace_id").where("session_id = '' or _s = session_id").select(F.col("frame_id").alias("anchor_id"), "trace_id")
        asked = now.select(F.col("frame_id").alias("anchor_id"), "x", "c", *(c for c in ("target", "target_var") if c in now.columns))
        scored = actions.score_actions(actions.nest_patches(asked, live, near, None, edges, groups), config).withColumnRenamed("anchor_id", "frame_id")
        decided = now.drop("trace_id").join(scored.select("frame_id", "action", "trace_id", "delta", "inhibit_first", "inhibit_second", "slow_alignment"), "frame_id")
        makes = F.col("action").isin("BIRTH", "SPLIT") & (F.col("delta") <= -least_gain)
        sets = F.col("inhibit_first").isNotNull() & (makes | (~F.col("action").isin("BIRTH", "SPLIT") & (F.col("delta") <= -0.5 * least_gain)))
        decided = stages.keep(decided.withColumns({"makes": makes, "sets": sets}).where("makes or sets"), "decided")
        born = stages.keep(new_traces(decided.where("makes"), near, config), "born")
        near = stages.keep(near.unionByName(born), "near-traces")
        born_all = born if born_all is None else born_all.unionByName(born)
        taken = decided if taken is None else taken.unionByName(decided)
        # what comes after the frame that reaches the limit does nothing, so it isn't asked
        last = taken.where("makes").orderBy("place").limit(limit).agg(F.max("place"), F.count(F.lit(1))).first()
        if last[1] == limit:
            ranked = ranked.where(F.col("place") <= last[0])
            if ranked.where(F.col("turn") > k).isEmpty():
                break
    none = batch.limit(0)
    if taken is None:
        return before, none.select("frame_id", F.lit("").alias("action"), "trace_id", F.lit("").alias("child"), F.lit(0.0).alias("delta")), none.select("seq", F.lit("").alias("first"), F.lit("").alias("second"), "x", "c", "ts", "anchor_id", "loss")
    last = taken.where("makes").orderBy("place").limit(limit).agg(F.max("place"), F.count(F.lit(1))).first()
    if last[1] == limit:  # the limit was reached there
        taken = taken.where(F.col("place") <= last[0])
    taken = stages.keep(taken, "taken")
    child = born_all.select(F.col("spawned_from_frame").alias("frame_id"), F.col("trace_id").alias("child"))
    made = stages.keep(taken.where("makes").join(child, "frame_id").select("frame_id", "action", "trace_id", "child", "delta"), "made")
    kept = before.unionByName(born_all.join(made.select(F.col("child").alias("trace_id")), "trace_id", "left_semi").select(*before.columns))
    apart = taken.where("sets").select("seq", F.col("inhibit_first").alias("first"), F.col("inhibit_second").alias("second"), "x", "c", F.greatest(F.coalesce("next_ts", "ts") if "next_ts" in taken.columns else F.col("ts"), F.col("ts")).alias("ts"), "anchor_id", F.col("slow_alignment").alias("loss"))
    return stages.keep(kept, "traces"), made, stages.keep(apart, "apart")
