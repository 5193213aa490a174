"""Posterior groups made and extended by accepted pairs, in the order of the pairs.

A pair of traces that a group holds already changes nothing; else it extends a group of either trace, the least by id; else
it makes one. What a pair does depends on the earlier pairs that touch its traces or their groups, and on no others. So
pairs go in rounds: each round takes every pair that is the earliest of all that wait at each of its traces and groups, all
of them at once, as joins and combined minima; pairs that share a trace or a group wait for the earlier one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mnemos.config import FIELD, FieldConfig
from mnemos.sources.stages import Stages

#: Fixed values that results depend on.
GROUP_COMPLEXITY, LEAST_BF, LEAST_OVERLAP, NULL_VAR = 0.25, 0.2, 0.55, 1.20
LAMBDA_STORAGE, LAMBDA_COMPLEXITY, LAMBDA_GROUP = 0.05, 0.03, 0.25
NEW_STORAGE = 0.25 * 1.08


def acceptance(ambiguity: Column, bf: Column, overlap: Column, existing: Column, config: FieldConfig = FIELD) -> Column:
    """Whether the objective falls if the pair has a group; what an existing one costs is paid either way."""
    before = LAMBDA_GROUP * F.greatest(ambiguity, F.lit(0.0))
    left = F.greatest(ambiguity - 0.5 * F.greatest(bf, F.lit(0.0)) * F.greatest(overlap, F.lit(0.0)), F.lit(0.0))
    new = LAMBDA_STORAGE * NEW_STORAGE * config.base_trace_cost + LAMBDA_COMPLEXITY * GROUP_COMPLEXITY
    return F.when(existing, LAMBDA_GROUP * left < before).otherwise(new + LAMBDA_GROUP * left < before)


def explode_members(groups: DataFrame) -> DataFrame:
    """(group_id, slot, trace_id, since): since is the seq of the pair that brought a member, null for the old ones."""
    return groups.select("group_id", F.posexplode("member_ids").alias("slot", "trace_id")).withColumn("since", F.lit(None).cast("bigint"))


def merge_pairs(pairs: DataFrame, groups: DataFrame, stages: Stages, judged: bool = True, config: FieldConfig = FIELD) -> tuple[DataFrame, DataFrame]:
    """Members (group_id, slot, trace_id, since) after all pairs, and outcomes (seq, group_id) of the pairs taken.

    pairs: seq (distinct, the order), first, second; ambiguity, bf and overlap where `judged`; guard, if there is one, is a
    trace that must be in no group when the pair's turn comes. groups: group_id, member_ids.
    """
    names = [c for c in ("guard", "ambiguity", "bf", "overlap") if c in pairs.columns]
    waiting = stages.keep(pairs.where("first != second").select(F.col("seq").cast("bigint").alias("seq"), "first", "second", *names), "pairs")
    # a group that holds no trace of a pair is met by none: it stays outside of the rounds
    asked = waiting.select(F.explode(F.array("first", "second", *(["guard"] if "guard" in names else []))).alias("trace_id")).distinct()
    every = explode_members(groups)
    near = stages.keep(every.join(asked, "trace_id", "left_semi").select("group_id").distinct(), "pair-groups")
    members, others = stages.keep(every.join(near, "group_id", "left_semi"), "members"), every.join(near, "group_id", "left_anti")
    outcomes = stages.keep(members.select(F.col("since").alias("seq"), "group_id").where("false"), "outcomes")
    while not waiting.isEmpty():
        traces = F.array(F.col("first"), F.col("second"), *([F.col("guard")] if "guard" in names else []))
        touched = waiting.select("seq", F.explode(F.array_distinct(F.filter(traces, lambda t: t.isNotNull()))).alias("trace_id"))
        held = touched.join(members.select("trace_id", "group_id"), "trace_id")
        keys = touched.select("seq", F.concat(F.lit("t"), "trace_id").alias("key")).union(held.select("seq", F.concat(F.lit("g"), "group_id"))).distinct()
        first = keys.groupBy("key").agg(F.min("seq").alias("_first"))
        turn = keys.join(first, "key").groupBy("seq").agg(F.min(F.col("_first") == F.col("seq")).alias("_mine")).where("_mine").select("seq")
        ready = stages.keep(waiting.join(turn, "seq"), "ready")
        # the groups of either trace: how many of the two each holds
        own = ready.select("seq", F.explode(F.array("first", "second")).alias("trace_id")).join(members.select("trace_id", "group_id"), "trace_id")
        own = own.groupBy("seq", "group_id").agg(F.count(F.lit(1)).alias("n"), F.first("trace_id").alias("inside"))
        best = own.groupBy("seq").agg(F.min(F.when(F.col("n") == 2, F.struct("group_id"))).alias("whole"), F.min(F.when(F.col("n") == 1, F.struct("group_id", "inside"))).alias("part"))
        out = ready.join(best, "seq", "left")
        if "guard" in names:
            grouped = ready.select("seq", F.col("guard").alias("trace_id")).join(members.select("trace_id").distinct(), "trace_id").select("seq").distinct()
            out = out.join(grouped, "seq", "left_anti")
        if judged:
            existing = F.col("whole").isNotNull()
            out = out.where((F.col("bf") > LEAST_BF) & (F.col("overlap") > LEAST_OVERLAP) & acceptance(F.col("ambiguity"), F.col("bf"), F.col("overlap"), existing, config))
        made = F.concat(F.lit("group_"), F.substring(F.sha2(F.concat_ws("\x1f", "first", "second", F.col("seq").cast("string")), 256), 1, 32))
        out = stages.keep(out.select("seq", "first", "second", "whole", "part", F.coalesce("whole.group_id", "part.group_id", made).alias("group_id")), "turns")
        fresh = F.array(F.struct(F.lit(0).alias("at"), F.col("first").alias("trace_id")), F.struct(F.lit(1).alias("at"), F.col("second").alias("trace_id")))
        joins = F.array(F.struct(F.lit(0).alias("at"), F.when(F.col("part.inside") == F.col("first"), F.col("second")).otherwise(F.col("first")).alias("trace_id")))
        added = out.where("whole is null").select("seq", "group_id", F.explode(F.when(F.col("part").isNull(), fresh).otherwise(joins)).alias("x"))
        size = members.groupBy("group_id").agg((F.max("slot") + 1).alias("_n"))
        added = added.join(size, "group_id", "left").select("group_id", (F.coalesce("_n", F.lit(0)) + F.col("x.at")).cast("int").alias("slot"), "x.trace_id", F.col("seq").alias("since"))
        members = stages.keep(members.unionByName(added), "members")
        outcomes = stages.keep(outcomes.unionByName(out.select("seq", "group_id")), "outcomes")
        waiting = stages.keep(waiting.join(ready.select("seq"), "seq", "left_anti"), "waiting")
    return members.unionByName(others), outcomes


def rebuild_groups(groups: DataFrame, members: DataFrame, traces: DataFrame) -> DataFrame:
    """groups with the members' arrays spliced, the null slot last: a new member has alpha 1, success 0.5 and its trace's
    context; a new group has a null slot of alpha 0.5, context zero, variance 1.2 and success 0.5.

    Group columns: group_id, member_ids, alpha, ctx_mu, ctx_sigma_diag, pred_success_ema, temperature, unresolved_mass,
    replay_alignment_ema, replay_tension_ema, ambiguous_buffer, ambiguous_ctx_buffer. Members are few by the budget's rule.
    """
    new = members.where("since is not null").join(traces.select("trace_id", "ctx_mu", "ctx_sigma_diag"), "trace_id")
    more = new.groupBy("group_id").agg(F.array_sort(F.collect_list(F.struct("slot", "trace_id", "ctx_mu", "ctx_sigma_diag"))).alias("m"))
    of = lambda f: F.transform("m", lambda s: s[f])
    flat = lambda v: F.transform("m", lambda _: F.lit(v))
    zero = lambda v: F.array(F.transform(F.col("m")[0]["ctx_mu"], lambda _: F.lit(v)))
    splice = lambda c, mid: F.concat(F.slice(c, F.lit(1), F.size(c) - 1), mid, F.slice(c, -1, 1))
    old = groups.join(more, "group_id", "left")
    grown = old.where("m is not null").withColumns({
        "member_ids": F.concat("member_ids", of("trace_id")), "alpha": splice("alpha", flat(1.0)), "ctx_mu": splice("ctx_mu", of("ctx_mu")), "ctx_sigma_diag": splice("ctx_sigma_diag", of("ctx_sigma_diag")), "pred_success_ema": splice("pred_success_ema", flat(0.5)),
    }).drop("m")
    born = more.join(groups.select("group_id"), "group_id", "left_anti").select(
        "group_id", of("trace_id").alias("member_ids"), F.concat(flat(1.0), F.array(F.lit(0.5))).alias("alpha"), F.concat(of("ctx_mu"), zero(0.0)).alias("ctx_mu"), F.concat(of("ctx_sigma_diag"), zero(NULL_VAR)).alias("ctx_sigma_diag"), F.concat(flat(0.5), F.array(F.lit(0.5))).alias("pred_success_ema"),
        F.lit(1.0).alias("temperature"), F.lit(0.0).alias("unresolved_mass"), F.lit(0.0).alias("replay_alignment_ema"), F.lit(0.0).alias("replay_tension_ema"), F.array().cast("array<string>").alias("ambiguous_buffer"), F.array().cast("array<array<double>>").alias("ambiguous_ctx_buffer"),
    )
    columns = born.columns
    return old.where("m is null").select(*columns).unionByName(grown.select(*columns)).unionByName(born)
