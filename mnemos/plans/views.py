"""The given tables in the shape of the jobs' own tables, as DataFrames and as SQL of equal meaning."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from mnemos.functions.vectors import l2_normalize


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text(*parts: str | Column) -> Column:
    return F.concat(*(F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts))


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns of conversations as raw events; the role `system` is no valid source."""
    c = read(spark, sf_dir, "conversations")
    return c.select(
        (F.col("turn") + 1.0).alias("ts"), text("conv-", F.col("conv_id")).alias("session_id"), text("turn-", F.col("turn")).alias("turn_id"), F.lit(None).cast("string").alias("source"),
        F.col("role"), F.when(F.col("turn") % 2 == 0, "text").alias("payload_type"), F.when(F.col("turn") % 3 == 0, F.col("text")).alias("payload"), F.col("text"),
    )


def anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "embeddings").where("vec_id % 5 != 0")
    return e.select(
        text("anc_", F.col("vec_id")).alias("anchor_id"), F.when(F.col("vec_id") % 50 == 1, "").otherwise(text("s", F.col("label"))).alias("session_id"),
        F.col("embedding").cast("array<double>").alias("z"), F.col("vec_id").cast("double").alias("ts"),
    )


def traces(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "embeddings").where("vec_id % 5 = 0").withColumn("k", (F.col("vec_id") / 5).cast("bigint")).withColumn("z", F.col("embedding").cast("array<double>"))
    k = F.col("k")
    fill = lambda v: F.transform("z", lambda _: v)
    one = lambda v: F.create_map(F.lit("prototype"), v)
    return e.select(
        text("trace_", F.col("vec_id")).alias("trace_id"), text("s", F.col("label")).alias("session_id"), F.col("z").alias("z_mu"), F.col("z").alias("ctx_mu"),
        fill(0.2 + 0.05 * (k % 4)).alias("z_sigma_diag"), fill(F.lit(0.6)).alias("ctx_sigma_diag"), (1.0 + k % 7).alias("evidence"), ((k % 10) / 10).alias("stability"),
        (0.1 + (k % 5) / 10).alias("uncertainty"), (k % 3).cast("double").alias("access_ema"), (1.0 - 0.2 * (k % 4)).alias("fidelity"), (k % 4).alias("compression_stage"),
        ((k % 6) / 10).alias("pred_loss_ema"), ((k % 6) / 10).alias("future_alignment_ema"), ((k % 3) / 10).alias("future_drift_ema"), F.col("vec_id").cast("double").alias("last_access_ts"),
        one((k % 4) / 2).alias("role_logits"), one((k % 3).cast("double")).alias("role_support"), one((k % 5) / 10 - 0.1).alias("role_gain_ema"),
        F.slice(F.array(F.lit("m1"), F.lit("m2")), F.lit(1), (k % 3).cast("int")).alias("member_ids"), F.slice(F.array(F.lit("p1")), F.lit(1), (k % 2).cast("int")).alias("path_signature"),
        F.transform(F.sequence(F.lit(1), F.lit(4)), lambda i: text("anc_", F.col("vec_id") + i)).alias("anchor_reservoir"),
    )


def bare_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The frame log without what is active and what comes next."""
    e = read(spark, sf_dir, "events")
    session = text("u", F.col("user_id"))
    micros = F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', CAST(ts AS TIMESTAMP_NTZ))")
    return e.select(
        text("f", F.col("event_id")).alias("frame_id"), F.col("event_id").alias("seq"), text("a", F.col("event_id") % 997).alias("anchor_id"), session.alias("session_id"), text(session, ":", F.col("event_type")).alias("trace_id"),
        (micros / 1e6).alias("ts"), ((F.col("event_id") % 10) / 10).alias("group_entropy"), F.least(F.col("value") / 100, F.lit(2.0)).alias("pred_loss"),
    )


def with_active(frames: DataFrame) -> DataFrame:
    own = F.col("trace_id")
    out = frames.withColumn("active_ids", F.array_distinct(F.array(own, text(F.col("session_id"), ":click"), text(F.col("session_id"), ":view"))))
    share = 0.4 / (F.size("active_ids") - 1)
    return out.withColumn("activation", F.map_from_entries(F.transform("active_ids", lambda t: F.struct(t.alias("k"), F.when(t == own, 0.6).otherwise(share).alias("v")))))


def raw_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The frame log without what comes next."""
    return with_active(bare_frames(spark, sf_dir))


def event_traces(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "events")
    micros = F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', CAST(ts AS TIMESTAMP_NTZ))")
    g = e.groupBy("user_id", "event_type").agg(F.count(F.lit(1)).alias("n"), F.avg("value").alias("mean"), F.min("value").alias("low"), F.max("value").alias("high"), F.max(micros / 1e6).alias("last_access_ts"))
    n = F.col("n")
    return g.select(
        "user_id", text("u", F.col("user_id")).alias("session_id"), text("u", F.col("user_id"), ":", F.col("event_type")).alias("trace_id"), n.cast("double").alias("evidence"), (F.col("mean") / 100).alias("pred_loss_ema"), "last_access_ts",
        (0.1 + (n % 5) / 10).alias("uncertainty"), F.lit(0.5).alias("stability"), (n % 3).cast("double").alias("access_ema"), ((n % 6) / 10).alias("future_alignment_ema"), ((n % 3) / 10).alias("future_drift_ema"),
        l2_normalize(F.array(n.cast("double"), F.col("mean"), F.col("low"), F.col("high"))).alias("z_mu"), F.create_map(F.lit("prototype"), (n % 4) / 2).alias("role_logits"), F.create_map(F.lit("prototype"), (n % 3).cast("double")).alias("role_support"), F.create_map(F.lit("prototype"), (n % 5) / 10).alias("role_gain_ema"),
    )


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    from mnemos.operators.graph import link_frames

    # linked first, so that what is active isn't shuffled
    f, nexts = with_active(link_frames(bare_frames(spark, sf_dir))), ["next_trace_id", "next_ts", "next_anchor_id"]
    return f.select(*(c for c in f.columns if c not in nexts), *nexts)


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edges_of(frames(spark, sf_dir))


def edges_of(frames: DataFrame) -> DataFrame:
    pairs = frames.where("next_trace_id is not null").groupBy(F.col("trace_id").alias("src"), F.col("next_trace_id").alias("dst")).agg(F.count(F.lit(1)).alias("n"), F.max("next_ts").alias("last_update_ts"))
    weight = 0.1 * (1 - F.pow(F.lit(0.95), F.col("n").cast("double"))) / 0.05
    both = pairs.withColumn("kind", F.explode(F.when(F.col("n") >= 3, F.array(F.lit("temporal"), F.lit("option"))).otherwise(F.array(F.lit("temporal")))))
    return both.select("src", "dst", "kind", weight.alias("weight"), weight.alias("support_ema"), "last_update_ts", F.lit(0.0).alias("bf_sep_ema"), F.when(F.col("kind") == "option", 1 + F.col("n") / 10).otherwise(1.0).alias("success_alpha"), F.lit(1.0).alias("success_beta"))


def groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return groups_of(event_traces(spark, sf_dir).select("user_id", "trace_id", "evidence", "z_mu"))


def groups_of(t: DataFrame) -> DataFrame:
    """The groups of event traces (user_id, trace_id, evidence, z_mu)."""
    pick = lambda kind: F.max_by(F.struct("trace_id", "evidence", "z_mu"), F.when(F.col("trace_id").endswith(kind), 1))
    of = t.where(F.col("trace_id").endswith(":click") | F.col("trace_id").endswith(":purchase")).groupBy("user_id").agg(pick(":click").alias("a"), pick(":purchase").alias("b"), F.count(F.lit(1)).alias("c")).where("c = 2")
    zeros = F.array_repeat(F.lit(0.0), 4)
    return of.select(
        text("g", F.col("user_id")).alias("group_id"), "user_id", F.array("a.trace_id", "b.trace_id").alias("member_ids"), F.array(1 + F.col("a.evidence") / 10, 1 + F.col("b.evidence") / 10, F.lit(0.5)).alias("alpha"),
        F.array(F.col("a.z_mu"), F.col("b.z_mu"), zeros).alias("ctx_mu"), F.lit(0.6).alias("ctx_sigma"), F.array(F.lit(0.5), F.lit(0.6), F.lit(0.1)).alias("pred_success_ema"), ((F.col("user_id") % 5) / 10).alias("unresolved_mass"),
        F.lit(1.0).alias("temperature"), ((F.col("user_id") % 3) / 10).alias("replay_tension_ema"), F.slice(F.array(F.lit("a1"), F.lit("a2"), F.lit("a3")), F.lit(1), (F.col("user_id") % 4).cast("int")).alias("ambiguous_buffer"), F.lit(None).cast("array<string>").alias("_none"),
    ).withColumn("ambiguous_ctx_buffer", F.col("ambiguous_buffer")).drop("_none")


#: The same views for the oracles, by name.
SQL: dict[str, str] = {
    "v_events": """SELECT turn + 1.0::DOUBLE AS ts, 'conv-' || conv_id AS session_id, 'turn-' || turn AS turn_id, CAST(NULL AS VARCHAR) AS source, role,
  CASE WHEN turn % 2 = 0 THEN 'text' END AS payload_type, CASE WHEN turn % 3 = 0 THEN text END AS payload, text FROM conversations""",
    "v_anchors": """SELECT 'anc_' || vec_id AS anchor_id, CASE WHEN vec_id % 50 = 1 THEN '' ELSE 's' || label END AS session_id, CAST(embedding AS DOUBLE[]) AS z, CAST(vec_id AS DOUBLE) AS ts
  FROM embeddings WHERE vec_id % 5 <> 0""",
    "v_traces": """SELECT 'trace_' || vec_id AS trace_id, 's' || label AS session_id, z AS z_mu, z AS ctx_mu, list_transform(z, lambda x: 0.2::DOUBLE + 0.05::DOUBLE * (k % 4)) AS z_sigma_diag, list_transform(z, lambda x: 0.6::DOUBLE) AS ctx_sigma_diag,
  CAST(1 + k % 7 AS DOUBLE) AS evidence, (k % 10) / 10.0::DOUBLE AS stability, 0.1::DOUBLE + (k % 5) / 10.0::DOUBLE AS uncertainty, CAST(k % 3 AS DOUBLE) AS access_ema, 1.0::DOUBLE - 0.2::DOUBLE * (k % 4) AS fidelity, k % 4 AS compression_stage,
  (k % 6) / 10.0::DOUBLE AS pred_loss_ema, (k % 6) / 10.0::DOUBLE AS future_alignment_ema, (k % 3) / 10.0::DOUBLE AS future_drift_ema, CAST(vec_id AS DOUBLE) AS last_access_ts,
  (k % 4) / 2.0::DOUBLE AS logit, CAST(k % 3 AS DOUBLE) AS support, (k % 5) / 10.0::DOUBLE - 0.1::DOUBLE AS gain, k % 3 AS n_members, k % 2 AS n_path, list_transform([1, 2, 3, 4], lambda i: 'anc_' || (vec_id + i)) AS anchor_reservoir
  FROM (SELECT *, vec_id // 5 AS k, CAST(embedding AS DOUBLE[]) AS z FROM embeddings WHERE vec_id % 5 = 0)""",
    "v_frames": """SELECT *, lead(trace_id) OVER w AS next_trace_id, lead(ts) OVER w AS next_ts, lead(anchor_id) OVER w AS next_anchor_id FROM (
  SELECT 'f' || event_id AS frame_id, event_id AS seq, 'a' || (event_id % 997) AS anchor_id, 'u' || user_id AS session_id, 'u' || user_id || ':' || event_type AS trace_id, epoch_us(ts) / 1e6 AS ts,
    (event_id % 10) / 10.0::DOUBLE AS group_entropy, least(value / 100, 2.0::DOUBLE) AS pred_loss,
    CASE event_type WHEN 'click' THEN ['u' || user_id || ':click', 'u' || user_id || ':view'] WHEN 'view' THEN ['u' || user_id || ':view', 'u' || user_id || ':click']
      ELSE ['u' || user_id || ':' || event_type, 'u' || user_id || ':click', 'u' || user_id || ':view'] END AS active_ids FROM events) WINDOW w AS (PARTITION BY session_id ORDER BY ts, seq)""",
    "v_etraces": """SELECT user_id, 'u' || user_id AS session_id, 'u' || user_id || ':' || event_type AS trace_id, CAST(n AS DOUBLE) AS evidence, mean / 100 AS pred_loss_ema, last_access_ts, 0.1::DOUBLE + (n % 5) / 10.0::DOUBLE AS uncertainty, 0.5::DOUBLE AS stability,
  CAST(n % 3 AS DOUBLE) AS access_ema, (n % 6) / 10.0::DOUBLE AS future_alignment_ema, (n % 3) / 10.0::DOUBLE AS future_drift_ema, list_transform([n, mean, low, high], lambda x: x / sqrt(n * n + mean * mean + low * low + high * high)) AS z_mu,
  (n % 4) / 2.0::DOUBLE AS logit, CAST(n % 3 AS DOUBLE) AS support, (n % 5) / 10.0::DOUBLE AS gain
  FROM (SELECT user_id, event_type, count(*) AS n, avg(value) AS mean, min(value) AS low, max(value) AS high, max(epoch_us(ts) / 1e6) AS last_access_ts FROM events GROUP BY ALL)""",
    "v_edges": """SELECT src, dst, kind, w AS weight, w AS support_ema, last_update_ts, 0.0::DOUBLE AS bf_sep_ema, CASE kind WHEN 'option' THEN 1 + n / 10.0::DOUBLE ELSE 1.0 END AS success_alpha, 1.0::DOUBLE AS success_beta FROM (
  SELECT src, dst, n, last_update_ts, 0.1::DOUBLE * (1 - pow(0.95::DOUBLE, n)) / 0.05::DOUBLE AS w, unnest(CASE WHEN n >= 3 THEN ['temporal', 'option'] ELSE ['temporal'] END) AS kind
  FROM (SELECT trace_id AS src, next_trace_id AS dst, count(*) AS n, max(next_ts) AS last_update_ts FROM v_frames WHERE next_trace_id IS NOT NULL GROUP BY ALL))""",
    "v_groups": """SELECT 'g' || a.user_id AS group_id, a.user_id, [a.trace_id, b.trace_id] AS member_ids, [1 + a.evidence / 10, 1 + b.evidence / 10, 0.5] AS alpha, [a.z_mu, b.z_mu, [0.0, 0.0, 0.0, 0.0]] AS ctx_mu, 0.6::DOUBLE AS ctx_sigma,
  [0.5, 0.6, 0.1]::DOUBLE[] AS pred_success_ema, (a.user_id % 5) / 10.0::DOUBLE AS unresolved_mass, 1.0::DOUBLE AS temperature, (a.user_id % 3) / 10.0::DOUBLE AS replay_tension_ema, a.user_id % 4 AS n_buffer
  FROM v_etraces a JOIN v_etraces b USING (user_id) WHERE a.trace_id LIKE '%:click' AND b.trace_id LIKE '%:purchase'""",
}
_NEEDS = {"v_edges": ["v_frames"], "v_groups": ["v_etraces"]}


def with_views(body: str, *names: str, recursive: bool = False) -> str:
    """The body after the views it names; a body that starts with a comma adds CTEs of its own."""
    order = [v for v in SQL if v in {*names, *(n for x in names for n in _NEEDS.get(x, []))}]
    return f"WITH {'RECURSIVE ' if recursive else ''}" + ",\n".join(f"{v} AS ({SQL[v]})" for v in order) + "\n" + body
