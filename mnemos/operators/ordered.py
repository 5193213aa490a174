"""Order inside a key, for keys of any size.

A key that a third of all rows share can't be sorted in one task. Its rows are dealt by range of (key, order), each part is
numbered in its task, and the parts' counts give the offsets: a segmented scan of two levels, in which no task sees more of
a key than its range. Folds that can't be composed (an accept test, a rate that hangs on the state) go through such a key in
chunks of bounded size: in each round every key's next chunk meets its state, and only the state goes on.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from mnemos.sources.stages import Stages

#: A key of more rows than this is hot: it is numbered by ranges, and folded in chunks of as many rows.
CHUNK = 100_000


def hot_keys(rows: DataFrame, keys: list[str], chunk: int | None = None) -> DataFrame:
    """Keys of more than `chunk` rows, by a combined count; at most rows / chunk of them."""
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > (chunk or CHUNK)).select(*keys)


def numbered(rows: DataFrame, keys: list[str], order: list[str], name: str = "k") -> DataFrame:
    """rows with their number from 0 inside the key, by `order` (ascending), whatever a key's size."""
    stages = Stages(rows.sparkSession, "numbered")
    dealt = stages.keep(rows.repartitionByRange(*keys, *order).withColumn("_part", F.spark_partition_id()), "dealt")
    inside = Window.partitionBy(*keys, "_part").orderBy(*order)
    counts = dealt.groupBy(*keys, "_part").agg(F.count(F.lit(1)).alias("_c"))
    before = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each part
    offsets = counts.withColumn("_before", F.coalesce(F.sum("_c").over(before), F.lit(0))).drop("_c")
    return dealt.withColumn("_r", F.row_number().over(inside) - 1).join(offsets, [*keys, "_part"]).withColumn(name, (F.col("_r") + F.col("_before")).cast("bigint")).drop("_r", "_before", "_part")


def ranked(rows: DataFrame, keys: list[str], order: list[str], name: str = "k", chunk: int | None = None) -> DataFrame:
    """numbered(), with a plain window for the keys that aren't hot."""
    hot = hot_keys(rows, keys, chunk)
    if hot.isEmpty():
        return _windowed(rows, keys, order, name)
    hot = Stages(rows.sparkSession, "hot").keep(hot, "keys")
    return _windowed(rows.join(hot, keys, "left_anti"), keys, order, name).unionByName(numbered(rows.join(hot, keys, "left_semi"), keys, order, name).select(*rows.columns, name))


def first(rows: DataFrame, order: list[str], n: int, chunk: int | None = None) -> DataFrame:
    """The first n rows by `order` (ascending, without ties). Up to a chunk they are one task's top; more are numbered by ranges."""
    if n <= (chunk or CHUNK):
        return rows.orderBy(*order).limit(n)
    return numbered(rows, [], order, "_n").where(F.col("_n") < n).select(*rows.columns)


def _windowed(rows: DataFrame, keys: list[str], order: list[str], name: str) -> DataFrame:
    return rows.select(*rows.columns, (F.row_number().over(Window.partitionBy(*keys).orderBy(*order)) - 1).cast("bigint").alias(name))


def folded(state: DataFrame, steps: DataFrame, keys: list[str], order: list[str], fold: Callable[[DataFrame, DataFrame], DataFrame], chunk: int | None = None) -> DataFrame:
    """fold(state, steps) over all steps of each key in order, a chunk at a time.

    fold gives one row a key of state with its columns; steps of keys that have no row in state are its affair. Where no
    key is hot it runs once. A hot key takes as many rounds as it has chunks; in a round, only keys that still have steps
    are folded, each over a chunk, and what comes out is written.
    """
    chunk = chunk or CHUNK
    hot = hot_keys(steps, keys, chunk)
    if hot.isEmpty():
        return fold(state, steps)
    stages = Stages(steps.sparkSession, "folded")
    hot = stages.keep(hot, "keys")
    cold = fold(state.join(hot, keys, "left_anti"), steps.join(hot, keys, "left_anti"))
    dealt = stages.keep(numbered(steps.join(hot, keys, "left_semi"), keys, order, "_k").withColumn("_chunk", F.floor(F.col("_k") / chunk)), "steps")
    now = stages.keep(state.join(hot, keys, "left_semi"), "state")
    for c in range(int(dealt.agg(F.max("_chunk")).first()[0]) + 1):
        own = dealt.where(F.col("_chunk") == c).drop("_k", "_chunk")
        open_ = stages.keep(own.select(*keys).distinct(), "open")
        moved = fold(now.join(open_, keys, "left_semi"), own)
        rest = now.join(open_, keys, "left_anti")
        now = stages.keep(rest.select(*moved.columns).unionByName(moved), "state")
    return cold.unionByName(now.select(*cold.columns))

