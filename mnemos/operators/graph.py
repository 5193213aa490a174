"""The frame log and the weighted typed edge graph."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from mnemos.config import FIELD
from mnemos.operators import ordered


def link_frames(frames: DataFrame) -> DataFrame:
    """What comes next inside a session, by (ts, seq)."""
    w = Window.partitionBy("session_id").orderBy("ts", "seq")
    return frames.withColumns({"next_trace_id": F.lead("trace_id").over(w), "next_ts": F.lead("ts").over(w), "next_anchor_id": F.lead("anchor_id").over(w)})


def neighbors(edges: DataFrame, ids: DataFrame) -> DataFrame:
    """(trace_id, neighbor), undirected, one hop."""
    both = edges.select(F.col("src").alias("trace_id"), F.col("dst").alias("neighbor")).union(edges.select(F.col("dst"), F.col("src")))
    return both.join(ids.select("trace_id").distinct(), "trace_id", "left_semi").distinct()


def degree(edges: DataFrame) -> DataFrame:
    """Edges touching a trace; a self-loop counts once."""
    return edges.select(F.explode(F.array_distinct(F.array("src", "dst"))).alias("trace_id")).groupBy("trace_id").agg(F.count(F.lit(1)).alias("degree"))


def transition_support(pairs: DataFrame, edges: DataFrame) -> DataFrame:
    """(src, dst, support): the larger of the clipped temporal weight and the option's success rate."""
    kind = lambda k: F.max(F.when(F.col("kind") == k, 1.0 * F.col("v")))
    rate = F.col("success_alpha") / F.greatest(F.col("success_alpha") + F.col("success_beta"), F.lit(1e-8))
    known = edges.where("kind in ('temporal', 'option')").select("src", "dst", "kind", F.when(F.col("kind") == "option", rate).otherwise(F.col("weight")).alias("v"))
    known = known.groupBy("src", "dst").agg(kind("temporal").alias("t"), kind("option").alias("o"))
    best = F.greatest(F.coalesce("t", F.lit(0.0)), F.coalesce("o", F.lit(0.0)))
    return pairs.join(known, ["src", "dst"], "left").select("src", "dst", F.least(F.greatest(best, F.lit(0.0)), F.lit(1.0)).alias("support"))


def upsert_edges(deltas: DataFrame, edges: DataFrame | None = None, decay: float = FIELD.edge_decay) -> DataFrame:
    """Weights after the touches (src, dst, kind, delta, ts, seq) in order: w <- decay * w + delta.

    All deltas are at least 0, so the recurrence has the closed form decay^n w0 + sum of decay^(n-k) delta_k. Only the rank
    needs order: a hot edge's touches are numbered by ranges (see ordered), and sums combine before the shuffle.
    """
    keys = ["src", "dst", "kind"]
    rows = deltas.select(*keys, F.greatest("delta", F.lit(0.0)).alias("delta"), "ts", (-F.col("ts")).alias("_t"), (-F.col("seq")).alias("_s"))
    ranked = ordered.ranked(rows, keys, ["_t", "_s"])
    part = F.pow(F.lit(decay), F.col("k").cast("double")) * F.col("delta")
    new = ranked.groupBy(*keys).agg(F.sum(part).alias("gain"), F.count(F.lit(1)).alias("n"), F.max("ts").alias("ts"))
    if edges is None:
        return new.select("src", "dst", "kind", F.col("gain").alias("weight"), F.col("gain").alias("support_ema"), F.col("ts").alias("last_update_ts"))
    old = edges.select("src", "dst", "kind", F.col("weight").alias("w0"), F.col("support_ema").alias("s0"), F.col("last_update_ts").alias("t0"))
    both = new.join(old, ["src", "dst", "kind"], "full_outer")
    kept = F.pow(F.lit(decay), F.coalesce("n", F.lit(0)).cast("double"))
    gain = F.coalesce("gain", F.lit(0.0))
    return both.select("src", "dst", "kind", (kept * F.coalesce("w0", F.lit(0.0)) + gain).alias("weight"), (kept * F.coalesce("s0", F.lit(0.0)) + gain).alias("support_ema"), F.coalesce("ts", "t0").alias("last_update_ts"))


def temporal_deltas(frames: DataFrame, delta: float = 0.10) -> DataFrame:
    """A touch for each step from a trace to the next: 0.10 on inject, 0.15 on replay."""
    return frames.where("next_trace_id is not null").select(F.col("trace_id").alias("src"), F.col("next_trace_id").alias("dst"), F.lit("temporal").alias("kind"), F.lit(delta).alias("delta"), F.col("next_ts").alias("ts"), "seq")


def assoc_deltas(frames: DataFrame, rate: float = 0.10) -> DataFrame:
    """Touches of each pair of active traces, both ways: rate * sqrt(a_i a_j). The active set is small (12 by default)."""
    one = frames.select("seq", "ts", "active_ids", "activation", F.posexplode("active_ids").alias("i", "src"))
    two = one.select("seq", "ts", "activation", "src", F.explode(F.filter("active_ids", lambda t: t != F.col("src"))).alias("dst"))
    return two.select("src", "dst", F.lit("assoc").alias("kind"), (rate * F.sqrt(F.greatest(F.col("activation")[F.col("src")] * F.col("activation")[F.col("dst")], F.lit(0.0)))).alias("delta"), "ts", "seq")


def touching(edges: DataFrame, ids: DataFrame) -> DataFrame:
    """Edges with an end among ids (trace_id)."""
    end = lambda c: ids.select(F.col("trace_id").alias(c)).distinct()
    from_ = edges.join(end("src"), "src", "left_semi").select(*edges.columns)
    to = edges.join(end("src"), "src", "left_anti").join(end("dst"), "dst", "left_semi").select(*edges.columns)
    return from_.unionByName(to)


def drop_dangling_edges(edges: DataFrame, removed: DataFrame) -> DataFrame:
    gone = removed.select("trace_id").distinct()
    return edges.join(gone.withColumnRenamed("trace_id", "src"), "src", "left_anti").join(gone.withColumnRenamed("trace_id", "dst"), "dst", "left_anti")


def drop_dangling_members(groups: DataFrame, removed: DataFrame) -> DataFrame:
    """Members that are gone leave with their place in alpha; the null slot stays last."""
    gone = removed.select(F.col("trace_id").alias("member"), F.lit(True).alias("gone")).distinct()
    rows = groups.select("group_id", F.posexplode(F.zip_with("member_ids", F.slice("alpha", 1, F.size("member_ids")), lambda m, a: F.struct(m.alias("member"), a.alias("a")))).alias("i", "x")).select("group_id", "i", "x.member", "x.a")
    kept = rows.join(gone, "member", "left").where("gone is null").groupBy("group_id").agg(F.array_sort(F.collect_list(F.struct("i", "member", "a"))).alias("m"))
    out = groups.join(kept, "group_id", "left").withColumn("m", F.coalesce("m", F.array().cast("array<struct<i:int,member:string,a:double>>")))
    return out.withColumns({"member_ids": F.col("m.member"), "alpha": F.concat(F.col("m.a"), F.slice("alpha", -1, 1))}).drop("m")
