"""Answering, and the objective of a replayed batch."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mnemos.functions import costs
from mnemos.operators import graph, readout


def response_id() -> Column:
    return F.concat(F.lit("response-"), F.substring(F.sha2("cue_id", 256), 1, 32))


def respond_batch(cues: DataFrame, workspaces: DataFrame, answers: DataFrame, system: str = "Answer from the memory given.") -> tuple[DataFrame, DataFrame]:
    """Prompts out, answers in: (cue_id, messages), and the cleaned answers as assistant events linked by response_to.

    cues: cue_id, session_id, text, ts. answers: cue_id, answer (made elsewhere). A blank answer makes no event.
    """
    prompts = cues.join(workspaces, "cue_id").select("cue_id", readout.build_prompts(system, readout.render_workspace(), F.col("text")).alias("messages"))
    cleaned = answers.select("cue_id", readout.clean_response(F.col("answer")).alias("payload")).where("payload != ''")
    events = cues.join(cleaned, "cue_id").select("ts", "session_id", response_id().alias("turn_id"), F.lit("assistant").alias("source"), F.lit("text").alias("payload_type"), "payload", F.create_map(F.lit("response_to"), F.col("text")).alias("meta"))
    return prompts, events


def replay_objective(past: DataFrame, current: DataFrame, transitions: DataFrame, edges: DataFrame, groups: DataFrame, changed: DataFrame, touched: DataFrame) -> DataFrame:
    """One row: activation_kl, transition_gap, group_heat, churn and their sum as drift.

    past and current: (frame_id, trace_id, a), activations in the log and settled anew. Both are clipped to 1e-8 over the
    union of their traces and renormalised; the divergence is the mean of both directions, averaged over the frames that have
    a mass in either.
    transitions: (src, dst), a row for each step; changed and touched: trace_id.
    """
    both = past.select("frame_id", "trace_id", F.col("a").alias("p")).join(current.select("frame_id", "trace_id", F.col("a").alias("q")), ["frame_id", "trace_id"], "full_outer")
    floor = lambda c: F.least(F.greatest(F.coalesce(c, F.lit(0.0)), F.lit(1e-8)), F.lit(1.0))
    massive = both.groupBy("frame_id").agg(F.sum("p").alias("p"), F.sum("q").alias("q")).where("p > 1e-8 and q > 1e-8").select("frame_id")
    rows = both.join(massive, "frame_id", "left_semi").select("frame_id", floor("p").alias("p"), floor("q").alias("q"))
    sums = rows.groupBy("frame_id").agg(F.sum("p").alias("sp"), F.sum("q").alias("sq"))
    scaled = rows.join(sums, "frame_id").select("frame_id", (F.col("p") / F.col("sp")).alias("p"), (F.col("q") / F.col("sq")).alias("q"))
    kl = scaled.groupBy("frame_id").agg((0.5 * F.sum((F.col("p") - F.col("q")) * (F.log("p") - F.log("q")))).alias("kl"))
    support = graph.transition_support(transitions.select("src", "dst").distinct(), edges)
    gap = transitions.select("src", "dst").join(support, ["src", "dst"])
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    out = kl.agg(zero(F.avg("kl")).alias("activation_kl")).crossJoin(gap.agg(zero(F.avg(1.0 - F.col("support"))).alias("transition_gap"))).crossJoin(groups.agg(zero(F.avg(costs.group_tension_cost())).alias("group_heat")))
    out = out.crossJoin(changed.select("trace_id").distinct().agg(F.count(F.lit(1)).alias("_c"))).crossJoin(touched.select("trace_id").distinct().agg(F.count(F.lit(1)).alias("_t")))
    out = out.withColumn("churn", F.col("_c") / F.greatest("_t", F.lit(1))).drop("_c", "_t")
    return out.withColumn("drift", F.col("activation_kl") + F.col("transition_gap") + F.col("churn"))
