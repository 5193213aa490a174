"""The registered queries over the given tables and their oracles."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from mnemos.plans import action_queries, cycle_queries, encode_queries, graph_queries, inject_queries, objective_queries, replay_queries, scalar_queries, state_queries

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
for _module in (scalar_queries, graph_queries, objective_queries, replay_queries, encode_queries, state_queries, inject_queries, cycle_queries, action_queries):
    QUERIES |= _module.QUERIES
    ORACLES |= _module.ORACLES


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations to packets to vectors, their closest traces, and the traces' responsibilities."""
    return encode_queries.flagship(spark, sf_dir)
