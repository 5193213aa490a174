"""Queries of the joins and of the edge graph."""

from __future__ import annotations

from pyspark.sql import functions as F

from mnemos.operators import graph, retrieve
from mnemos.plans import views
from mnemos.plans.scalar_queries import _MASS, r6
from mnemos.plans.views import with_views

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def keep(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return keep


def cues(spark, sf_dir):
    return views.anchors(spark, sf_dir).select(F.col("anchor_id").alias("cue_id"), "session_id", "z", F.col("z").alias("context"))


COS = "list_dot_product({a}, {b}) / greatest(sqrt(list_dot_product({a}, {a})) * sqrt(list_dot_product({b}, {b})), 1e-8)"
_COS = COS.format(a="a.z", b="t.z_mu")


@query("jn1_topk_similar", with_views(f", s AS (SELECT a.anchor_id AS cue_id, t.trace_id, {_COS} AS score FROM v_anchors a, v_traces t) SELECT cue_id, trace_id, round(score, 6) AS score, CAST(row_number() OVER (PARTITION BY cue_id ORDER BY score DESC, trace_id) AS INTEGER) AS rank FROM s QUALIFY rank <= 5", "v_anchors", "v_traces"))
def jn1(spark, sf_dir):
    return retrieve.topk_similar(cues(spark, sf_dir), views.traces(spark, sf_dir), 5).select("cue_id", "trace_id", r6("score").alias("score"), "rank")


@query("jn2_session_scope", with_views("SELECT a.anchor_id AS cue_id, t.trace_id FROM v_anchors a JOIN v_traces t ON a.session_id = '' OR a.session_id = t.session_id", "v_anchors", "v_traces"))
def jn2(spark, sf_dir):
    return retrieve.session_scope(cues(spark, sf_dir), views.traces(spark, sf_dir)).select("cue_id", "trace_id")


@query("jn3_neighbors", with_views("SELECT DISTINCT trace_id, neighbor FROM (SELECT src AS trace_id, dst AS neighbor FROM v_edges UNION ALL SELECT dst, src FROM v_edges) WHERE trace_id LIKE '%:click'", "v_edges"))
def jn3(spark, sf_dir):
    e = views.edges(spark, sf_dir)
    return graph.neighbors(e, e.select(F.col("src").alias("trace_id")).union(e.select("dst")).where("trace_id like '%:click'"))


@query("jn4_expand_groups", with_views(", c AS (SELECT session_id AS cue_id, trace_id FROM v_etraces WHERE trace_id LIKE '%:click'), m AS (SELECT group_id, unnest(member_ids) AS trace_id FROM v_groups) SELECT cue_id, trace_id FROM c UNION SELECT c.cue_id, o.trace_id FROM c JOIN m USING (trace_id) JOIN m o USING (group_id)", "v_etraces", "v_groups"))
def jn4(spark, sf_dir):
    t = views.event_traces(spark, sf_dir)
    return retrieve.expand_groups(t.where("trace_id like '%:click'").select(F.col("session_id").alias("cue_id"), "trace_id"), views.groups(spark, sf_dir), t)


_CTX = COS.format(a="a.z", b="t.ctx_mu")


@query("jn5_make_candidates", with_views(f""", s AS (SELECT a.anchor_id AS cue_id, t.trace_id, {_COS} AS lat, {_CTX} AS ctx, {_MASS} AS mass, evidence, access_ema, uncertainty, a.session_id = '' OR a.session_id = t.session_id AS seen, CASE WHEN a.session_id = t.session_id THEN 0.25::DOUBLE ELSE 0 END AS mine FROM v_anchors a, v_traces t),
near AS (SELECT cue_id, trace_id FROM s QUALIFY row_number() OVER (PARTITION BY cue_id ORDER BY lat DESC, trace_id) <= 8),
blend AS (SELECT cue_id, trace_id, mass, row_number() OVER (PARTITION BY cue_id ORDER BY 0.65::DOUBLE * lat + 0.25::DOUBLE * ctx + 0.1::DOUBLE * evidence + 0.1::DOUBLE * access_ema - 0.05::DOUBLE * uncertainty + mine DESC, trace_id DESC) AS r FROM s WHERE seen),
picked AS (SELECT cue_id, trace_id FROM near UNION SELECT cue_id, trace_id FROM blend WHERE r <= 8 OR mass >= 0.75)
SELECT cue_id, trace_id, round(final, 6) AS score, CAST(row_number() OVER (PARTITION BY cue_id ORDER BY final DESC, trace_id DESC) AS INTEGER) AS rank
FROM (SELECT *, 0.60::DOUBLE * lat + 0.20::DOUBLE * ctx + 0.15::DOUBLE * evidence - 0.10::DOUBLE * uncertainty + 0.05::DOUBLE * mass + mine AS final FROM s WHERE seen) JOIN picked USING (cue_id, trace_id) QUALIFY rank <= 8""", "v_anchors", "v_traces"))
def jn5(spark, sf_dir):
    return retrieve.make_candidates(cues(spark, sf_dir), views.traces(spark, sf_dir), 8).select("cue_id", "trace_id", r6("score").alias("score"), "rank")


@query("jn6_degree", with_views("SELECT trace_id, count(*) AS degree FROM (SELECT unnest(list_distinct([src, dst])) AS trace_id FROM v_edges) GROUP BY 1", "v_edges"))
def jn6(spark, sf_dir):
    return graph.degree(views.edges(spark, sf_dir))


SUPPORT = "greatest(coalesce(max(weight) FILTER (kind = 'temporal'), 0), coalesce(max(success_alpha / (success_alpha + success_beta)) FILTER (kind = 'option'), 0))"


@query("jn7_transition_support", with_views(f"SELECT src, dst, round(least(greatest({SUPPORT}, 0), 1), 6) AS support FROM v_edges GROUP BY ALL", "v_edges"))
def jn7(spark, sf_dir):
    e = views.edges(spark, sf_dir)
    return graph.transition_support(e.select("src", "dst").distinct(), e).select("src", "dst", r6("support").alias("support"))


@query("jn8_anchor_contexts", with_views(", r AS (SELECT trace_id, unnest(anchor_reservoir) AS anchor_id FROM v_traces) SELECT trace_id, anchor_id, round(z[1], 6) AS first FROM r JOIN v_anchors USING (anchor_id)", "v_anchors", "v_traces"))
def jn8(spark, sf_dir):
    held = views.traces(spark, sf_dir).select("trace_id", F.explode("anchor_reservoir").alias("anchor_id"))
    return held.join(views.anchors(spark, sf_dir), "anchor_id").select("trace_id", "anchor_id", r6(F.col("z")[0]).alias("first"))


@query("jn9_drop_dangling", with_views(""" SELECT 'edge' AS what, src || '>' || dst || ':' || kind AS id, 0.0::DOUBLE AS mass FROM v_edges WHERE src NOT LIKE '%:purchase' AND dst NOT LIKE '%:purchase'
UNION ALL SELECT 'group', group_id || ':' || member_ids[1], round(alpha[1] + alpha[3], 6) FROM v_groups""", "v_edges", "v_groups"))
def jn9(spark, sf_dir):
    gone = views.event_traces(spark, sf_dir).where("trace_id like '%:purchase'").select("trace_id")
    e = graph.drop_dangling_edges(views.edges(spark, sf_dir), gone)
    g = graph.drop_dangling_members(views.groups(spark, sf_dir), gone)
    total = F.aggregate("alpha", F.lit(0.0), lambda s, x: s + x)
    return e.select(F.lit("edge").alias("what"), F.concat("src", F.lit(">"), "dst", F.lit(":"), "kind").alias("id"), F.lit(0.0).alias("mass")).union(g.select(F.lit("group"), F.concat("group_id", F.lit(":"), F.array_join("member_ids", ",")), r6(total)))


@query("wn1_link_frames", with_views("SELECT frame_id, next_trace_id, round(next_ts, 3) AS next_ts FROM v_frames", "v_frames"))
def wn1(spark, sf_dir):
    return views.frames(spark, sf_dir).select("frame_id", "next_trace_id", F.round("next_ts", 3).alias("next_ts"))


_STEP = ", d AS (SELECT trace_id AS src, next_trace_id AS dst, 'temporal' AS kind, next_ts AS ts, seq, row_number() OVER (PARTITION BY trace_id, next_trace_id ORDER BY next_ts, seq) AS k FROM v_frames WHERE next_trace_id IS NOT NULL)"


@query("eg1_upsert_edges", with_views(_STEP + ", e AS (SELECT src, dst, kind, k, 0.15::DOUBLE AS w FROM d WHERE k = 1 UNION ALL SELECT d.src, d.dst, d.kind, d.k, 0.95::DOUBLE * e.w + 0.15::DOUBLE FROM e JOIN d ON d.src = e.src AND d.dst = e.dst AND d.k = e.k + 1) SELECT src, dst, kind, round(arg_max(w, k), 6) AS weight FROM e GROUP BY ALL", "v_frames", recursive=True))
def eg1(spark, sf_dir):
    return graph.upsert_edges(graph.temporal_deltas(views.frames(spark, sf_dir), 0.15)).select("src", "dst", "kind", r6("weight").alias("weight"))


@query("eg2_temporal_deltas", with_views("SELECT trace_id AS src, next_trace_id AS dst, 'temporal' AS kind, 0.1::DOUBLE AS delta, seq FROM v_frames WHERE next_trace_id IS NOT NULL", "v_frames"))
def eg2(spark, sf_dir):
    return graph.temporal_deltas(views.frames(spark, sf_dir)).drop("ts")


@query("eg3_assoc_deltas", with_views(""", a AS (SELECT seq, trace_id, len(active_ids) AS n, unnest(active_ids) AS t FROM v_frames), b AS (SELECT seq, t, CASE WHEN t = trace_id THEN 0.6::DOUBLE ELSE 0.4::DOUBLE / (n - 1) END AS w FROM a)
SELECT x.t AS src, y.t AS dst, count(*) AS n, round(sum(0.1::DOUBLE * sqrt(x.w * y.w)), 6) AS delta FROM b x JOIN b y ON x.seq = y.seq AND x.t <> y.t GROUP BY ALL""", "v_frames"))
def eg3(spark, sf_dir):
    d = graph.assoc_deltas(views.frames(spark, sf_dir))
    return d.groupBy("src", "dst").agg(F.count(F.lit(1)).alias("n"), r6(F.sum("delta")).alias("delta"))
