"""Cells of a grid inside each key: every row of one side meets every row of the other that has its key, block by block.

A key of any size is dealt: its rows fall into blocks of bounded size by a hash of their id, and cell (key, i, j) holds block i
of the left and block j of the right. So no task sees more than a block of each, and pairs are made inside a cell only. Where rows are
joined (dealt) each side is copied once for each block of the other; where a function makes the pairs (met) a task holds a large
block of the left and the right passes by, so that there are few blocks to copy for.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mnemos.sources.stages import spread

#: Rows of a block on the left and on the right.
ROWS = (1024, 2048)
#: The same where every pair is a row that comes out.
PAIRS = (256, 1024)
#: Rows of the left that a task holds while the right passes, at most, and cells for each core where blocks may be smaller.
HELD, TASKS = 16384, 4


def whole(vector: Column) -> Column:
    """The vector as doubles; null where an entry is null."""
    return F.when(~F.exists(vector, lambda v: v.isNull()), vector.cast("array<double>"))


def dealt(left: DataFrame, right: DataFrame, left_id: str, right_id: str, rows: tuple[int, int] = ROWS) -> tuple[DataFrame, DataFrame]:
    """left and right (with _key) with their places _i and _j, a row for each cell it belongs to. Keys of one side only go."""
    count = lambda df, name: df.groupBy("_key").agg(F.count(F.lit(1)).alias(name))
    blocks = lambda name, n: F.ceil(F.col(name) / n).cast("int").alias(name)
    grid = count(left, "_is").join(count(right, "_js"), "_key").select("_key", blocks("_is", rows[0]), blocks("_js", rows[1]))
    place = lambda c, n: F.pmod(F.xxhash64(c), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    a = left.join(grid, "_key").withColumn("_i", place(left_id, "_is")).withColumn("_j", every("_js")).drop("_is", "_js")
    b = right.join(grid, "_key").withColumn("_j", place(right_id, "_js")).withColumn("_i", every("_is")).drop("_is", "_js")
    return a, b


def _streams(left: DataFrame, right: DataFrame, left_id: str, right_id: str, rows: tuple[int, int]) -> tuple[DataFrame, DataFrame]:
    """dealt(), for cells that hold their left block and let the right one pass: up to HELD rows are held, so that few copies
    move. Blocks are smaller, of `rows` at least, only until there are TASKS cells for each core; then copies grow with the
    held blocks alone."""
    count = lambda df, name: df.groupBy("_key").agg(F.count(F.lit(1)).alias(name))
    grid = count(left, "_n").join(count(right, "_k"), "_key")
    total = grid.agg(F.sum(F.col("_n").cast("double") * F.col("_k")).alias("_total"))
    blocks = lambda name, n: F.ceil(F.col(name) / n)
    wanted = F.ceil(TASKS * left.sparkSession.sparkContext.defaultParallelism * F.col("_n").cast("double") * F.col("_k") / F.col("_total"))
    first = F.greatest(blocks("_n", max(HELD, rows[0])), F.least(blocks("_n", rows[0]), wanted))
    grid = grid.crossJoin(F.broadcast(total)).withColumns({"_is": first.cast("int"), "_w": wanted})
    grid = grid.select("_key", "_is", F.greatest(F.least(blocks("_k", rows[1]), F.ceil(F.col("_w") / F.col("_is"))), F.lit(1)).cast("int").alias("_js"))
    place = lambda c, n: F.pmod(F.xxhash64(c), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    a = left.join(grid, "_key").select("_key", place(left_id, "_is").alias("_i"), every("_js").alias("_j"), F.lit(0).alias("_side"), F.struct(*left.columns).alias("_left"))
    b = right.join(grid, "_key").select("_key", every("_is").alias("_i"), place(right_id, "_js").alias("_j"), F.lit(1).alias("_side"), F.struct(*right.columns).alias("_right"))
    return a, b


def met(left: DataFrame, right: DataFrame, left_id: str, right_id: str, run: Callable[..., pa.Table], schema: str, rows: tuple[int, int] = ROWS, *, remembers: bool = False) -> DataFrame:
    """run(left block, right block) of every cell, in blocks of `rows` at most. If it remembers, it also gets a dict of the left
    block's own, which stays while the cell's right passes."""
    at, names = ["_key", "_i", "_j"], [c.split()[0] for c in schema.split(", ")]

    def pairs(left: list[pa.RecordBatch], right: list[pa.RecordBatch], known: dict[int, dict]) -> Iterator[pa.RecordBatch]:
        a, b = (pa.Table.from_batches(x).combine_chunks() if x else None for x in (left, right))
        if a is not None and b is not None:
            for j in range(0, b.num_rows, rows[1]):
                for i in range(0, a.num_rows, rows[0]):
                    own = (known.setdefault(i, {}),) if remembers else ()
                    yield from run(a.slice(i, rows[0]), b.slice(j, rows[1]), *own).select(names).to_batches()

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, held, passing, known = None, [], [], {}
        for batch in batches:
            codes = [batch.column(0).dictionary_encode().indices.to_numpy(), *(batch.column(c).to_numpy() for c in (1, 2, 3))]
            cuts = [0, *(np.flatnonzero(np.logical_or.reduce([c[1:] != c[:-1] for c in codes])) + 1).tolist(), batch.num_rows] if batch.num_rows else []
            for s, e in zip(cuts, cuts[1:]):
                here, side = tuple(batch.column(c)[s].as_py() for c in range(3)), batch.column(3)[s].as_py()
                if here != cell:
                    yield from pairs(held, passing, known)
                    cell, held, passing, known = here, [], [], {}
                part = pa.RecordBatch.from_struct_array(batch.column(4 + side).slice(s, e - s))
                (passing if side else held).append(part)
                if side and sum(p.num_rows for p in passing) >= rows[1]:
                    yield from pairs(held, passing, known)
                    passing = []
        yield from pairs(held, passing, known)

    a, b = _streams(left, right, left_id, right_id, rows)
    both = a.unionByName(b, allowMissingColumns=True).select(*at, "_side", "_left", "_right")
    return spread(both, *at).sortWithinPartitions(*at, "_side").mapInArrow(stream, schema)
