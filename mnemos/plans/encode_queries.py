"""Queries that run the text encoder."""

from __future__ import annotations

from pyspark.sql import functions as F

from mnemos.functions.encode import encode_text
from mnemos.functions.vectors import l2_normalize
from mnemos.operators import ingest, objective, retrieve
from mnemos.plans import views
from mnemos.sources.stages import Stages, spread

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def anchors(spark, sf_dir, dim: int = 128):
    good, _ = ingest.split_valid_rejected(ingest.normalize_events(spread(views.events(spark, sf_dir)), now=0.0))
    packets = ingest.packetize(good)
    return ingest.to_anchors(packets, encode_text(F.col("payload"), dim))


def sc2(spark, sf_dir):
    a = anchors(spark, sf_dir)
    return a.select("anchor_id", "session_id", F.round(F.col("z")[0], 6).alias("first"), F.round(F.aggregate("z", F.lit(0.0), lambda s, x: s + x), 6).alias("total"))


def flagship(spark, sf_dir):
    """Each turn's closest traces of its width, and the share of each in explaining it. Turns are encoded once, by all tasks."""
    a = anchors(spark, sf_dir, 64)
    t = views.traces(spark, sf_dir)
    cues = Stages(spark, "flagship").keep(a.select(F.col("anchor_id").alias("cue_id"), "z").dropDuplicates(["cue_id"]), "cues")
    near = retrieve.topk_similar(cues, t, 8)
    pairs = near.join(cues, "cue_id").join(t, "trace_id").withColumnsRenamed({"cue_id": "obs_id", "z": "x"}).withColumn("c", l2_normalize(F.col("x")))
    return objective.responsibilities(objective.logits(pairs)).select("obs_id", "trace_id", "rank", F.round("score", 6).alias("score"), F.round("resp", 6).alias("resp"))


QUERIES["sc2_encode_text"] = sc2
QUERIES["flagship_turn_traces"] = flagship
