"""Connected components on DataFrames by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mnemos.llm.common import materialise

MAX_ROUNDS = 60


def _star(pairs: DataFrame, larger_only: bool) -> DataFrame:
    """Links the neighbours v of u (all v > u, or u and all v < u) to the least of u and its neighbours.

    The least neighbour is a partially aggregated minimum; it is joined back on u, where Spark can split a hot u.
    """
    least = pairs.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    if larger_only:
        linked = pairs.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        linked = pairs.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        linked = linked.union(least.select("u", F.col("m").alias("v")))
    return linked.where("u != v").distinct()


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """(node, component) for each end of an edge; component is the least node reachable.

    Nodes may be of any ordered type. Null ends, self-loops and repeated edges are ignored. Stars end in O(log^2 n)
    rounds; each round's links are a Parquet table in the shared folder, so a lost executor costs one round at most.
    No group is collected: hot nodes meet partial minima and joins that adaptive execution can split.
    """
    links = edges.select(F.col(src).alias("u"), F.col(dst).alias("v")).where("u is not null and v is not null and u != v").distinct()
    links = materialise(links, "cc-links")
    before = None
    for _ in range(MAX_ROUNDS):
        state = links.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64(F.greatest("u", "v"), F.least("u", "v")).cast("decimal(38,0)")).alias("h")).first()
        if state == before or not state["n"]:
            break
        before = state
        both = links.union(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = materialise(_star(both, True), "cc-large")
        small = large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        links = materialise(_star(small, False), "cc-small")
    else:
        raise RuntimeError(f"no fixed point after {MAX_ROUNDS} rounds")
    member = links.select(F.greatest("u", "v").alias("node"), F.least("u", "v").alias("component"))
    roots = member.select(F.col("component").alias("node"), "component").distinct()
    return member.union(roots)
