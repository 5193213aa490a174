"""Queries of the inject loop."""

from __future__ import annotations

from pyspark.sql import functions as F

from mnemos.functions.encode import encode_text
from mnemos.operators import graph, ingest
from mnemos.plans import views
from mnemos.plans.state_queries import scratch
from mnemos.streaming.inject import inject_sessions, inject_stream, maintenance_trigger

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def session_anchors(spark, sf_dir, dim: int = 32):
    good, _ = ingest.split_valid_rejected(ingest.normalize_events(views.events(spark, sf_dir), now=0.0))
    p = ingest.packetize(good)
    return p.select("session_id", F.concat(F.lit("anc_"), F.substring_index("packet_id", "_", -1)).alias("anchor_id"), "ts", F.lit(0).cast("bigint").alias("seq"), "chunk_index", encode_text(F.col("payload"), dim).alias("z"))


def _as_stream(spark, rows, path: str):
    """The rows as files of a stream of two micro-batches or more, a session in one file; a task writes a small share."""
    n = max(2, int(spark.conf.get("spark.sql.shuffle.partitions")))
    rows.repartition(n, "session_id").write.parquet(path)
    return spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", n // 2).parquet(path)


def in6(spark, sf_dir):
    out = inject_sessions(session_anchors(spark, sf_dir))
    return out.select("session_id", "anchor_id", "seq", "action", "trace_id", F.round("objective", 6).alias("objective"), F.size("active_ids").alias("active"), F.round(F.aggregate("weights", F.lit(0.0), lambda s, x: s + x), 6).alias("mass"))


def in7(spark, sf_dir):
    """The turns as files of a stream, two micro-batches or more, folded with state."""
    path = scratch(spark)
    stream = _as_stream(spark, session_anchors(spark, sf_dir), f"{path}/in")
    q = inject_stream(stream).writeStream.format("parquet").option("path", f"{path}/out").option("checkpointLocation", f"{path}/state").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.parquet(f"{path}/out").select("session_id", "anchor_id", "seq", "action", "trace_id", F.round("objective", 6).alias("objective"))


def in8(spark, sf_dir):
    """Maintenance of a stream of frames: each batch's edge touches are added to a table, summed up at the end."""
    path = scratch(spark)
    stream = _as_stream(spark, views.frames(spark, sf_dir), f"{path}/in")
    q = maintenance_trigger(stream, lambda df, i: graph.temporal_deltas(df).write.mode("overwrite").parquet(f"{path}/deltas/batch={i}"), checkpoint=f"{path}/state", once=True)
    q.awaitTermination()
    out = graph.upsert_edges(spark.read.parquet(f"{path}/deltas").drop("batch"))
    return out.select("src", "dst", "kind", F.round("weight", 6).alias("weight"))


QUERIES |= {"in6_inject_sessions": in6, "in7_inject_stream": in7, "in8_maintenance_trigger": in8}
ORACLES["in8_maintenance_trigger"] = views.with_views(" SELECT src, dst, kind, round(weight, 6) AS weight FROM v_edges WHERE kind = 'temporal'", "v_edges")
