"""State tables as immutable Parquet versions with a manifest, JSON export, and the operations log.

A version is a folder of its own that must not be there yet; what makes it a version is one manifest entry, a folder that
appears by a single rename after all its tables are written. So a job that dies leaves a folder without an entry, which
nobody reads and prune clears, and the last version stays what it was. Pruning takes the entry away first, also by one
rename, and the tables after it: a crash between leaves tables without an entry, never an entry without its tables.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mnemos.config import SCHEMA_VERSION

MANIFEST = "step bigint, reason string, schema_version int, created_at timestamp, tables array<string>, data string"


class Folder:
    """A folder in whatever file system its path names."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self._path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        self.path = path.rstrip("/")
        self._fs = self._path(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def at(self, name: str):
        return self._path(f"{self.path}/{name}")

    def has(self, name: str) -> bool:
        return self._fs.exists(self.at(name))

    def names(self, name: str) -> list[str]:
        return sorted(s.getPath().getName() for s in self._fs.listStatus(self.at(name))) if self.has(name) else []

    def rename(self, old: str, new: str) -> bool:
        """False if the new name is there already, or someone else was first."""
        return not self.has(new) and bool(self._fs.rename(self.at(old), self.at(new)))

    def make(self, name: str) -> None:
        self._fs.mkdirs(self.at(name))

    def drop(self, name: str) -> None:
        self._fs.delete(self.at(name), True)


def _entry(step: int) -> str:
    return f"manifest/step={step:020d}"


def write_snapshot(tables: dict[str, DataFrame], path: str, step: int, reason: str = "") -> None:
    """All tables in a new folder, then the entry. A step that is there already is refused and left as it is."""
    spark = next(iter(tables.values())).sparkSession
    folder = Folder(spark, path)
    if folder.has(_entry(step)):
        raise ValueError(f"step {step} is there already")
    data = f"data/{step}-{uuid.uuid4().hex}"
    for name, df in tables.items():
        df.write.mode("error").parquet(f"{folder.path}/{data}/{name}")
    row = spark.range(1).select(F.lit(step).cast("bigint").alias("step"), F.lit(reason).alias("reason"), F.lit(SCHEMA_VERSION).alias("schema_version"), F.current_timestamp().alias("created_at"), F.array(*map(F.lit, sorted(tables))).alias("tables"), F.lit(data).alias("data"))
    row.coalesce(1).write.mode("error").parquet(f"{folder.path}/{data}/_entry")
    folder.make("manifest")
    if not folder.rename(f"{data}/_entry", _entry(step)):
        raise ValueError(f"step {step} was written by another job")


def manifest(spark: SparkSession, path: str) -> DataFrame:
    folder = Folder(spark, path)
    found = [f"{folder.path}/manifest/{n}" for n in folder.names("manifest")]
    return spark.read.schema(MANIFEST).parquet(*found) if found else spark.createDataFrame([], MANIFEST)


def read_latest_snapshot(spark: SparkSession, path: str, latent_dim: int | None = None) -> dict[str, DataFrame]:
    """The newest version's tables. Fails on another schema version, or on traces of another width."""
    last = manifest(spark, path).orderBy(F.desc("step")).limit(1).first()
    if last is None:
        raise ValueError("no snapshot")
    if last["schema_version"] != SCHEMA_VERSION:
        raise ValueError(f"schema version {last['schema_version']}, not {SCHEMA_VERSION}")
    out = {t: spark.read.parquet(f"{path.rstrip('/')}/{last['data']}/{t}") for t in last["tables"]}
    if latent_dim is not None and "traces" in out and not out["traces"].where(F.size("z_mu") != latent_dim).isEmpty():
        raise ValueError(f"traces aren't of {latent_dim} dimensions")
    return out


def prune_snapshots(spark: SparkSession, path: str, keep: int = 256) -> list[int]:
    """Drops all but the newest `keep` versions (0 or less keeps all), and what older jobs left without an entry; the steps
    dropped. Tables newer than the last version may be a job at work, and stay."""
    if keep <= 0:
        return []
    folder = Folder(spark, path)
    rows = manifest(spark, path).orderBy(F.desc("step")).select("step", "data").collect()  # a row a version
    folder.make("dropped")
    for r in rows[keep:]:
        if folder.rename(_entry(r["step"]), f"dropped/{r['step']}-{uuid.uuid4().hex}"):
            folder.drop(r["data"])
    kept = {r["data"].split("/")[1] for r in rows[:keep]}
    last = rows[0]["step"] if rows else -1
    for name in folder.names("data"):
        if name not in kept and int(name.split("-")[0]) < last:
            folder.drop(f"data/{name}")
    folder.drop("dropped")
    return [r["step"] for r in rows[keep:]]


def export_json(tables: dict[str, DataFrame], path: str) -> None:
    for name, df in tables.items():
        df.write.mode("overwrite").json(f"{path}/{name}")


def append_operation(ops: DataFrame, path: str) -> None:
    """ops: op_id, created_at, step, op_kind, payload (JSON text)."""
    ops.write.mode("append").parquet(path)


def list_operations(ops: DataFrame, limit: int = 50, payload: str = "map<string,string>") -> DataFrame:
    """The newest first, their payload parsed."""
    return ops.orderBy(F.desc("op_id")).limit(limit).withColumn("payload", F.from_json("payload", payload))


def field_stats(**tables: DataFrame) -> DataFrame:
    """(name, rows) of each state table."""
    out = None
    for name, df in tables.items():
        one = df.agg(F.count(F.lit(1)).alias("rows")).select(F.lit(name).alias("name"), "rows")
        out = one if out is None else out.union(one)
    return out


def field_summary(traces: DataFrame, edges: DataFrame, groups: DataFrame, frames: DataFrame, anchors: DataFrame, hot: int = 16) -> DataFrame:
    """One row: rows of each table, sessions, the masses and the pressure of the budget, and the hot traces' ids."""
    from mnemos.operators import maintenance, objective

    count = lambda df, name: df.agg(F.count(F.lit(1)).alias(name))
    out = objective.budget_masses(traces, edges, groups)
    for df, name in ((traces, "traces"), (edges, "edges"), (groups, "groups"), (anchors, "anchors")):
        out = out.crossJoin(count(df, name))
    out = out.crossJoin(frames.agg(F.count(F.lit(1)).alias("frames"), F.countDistinct("session_id").alias("sessions")))
    top = maintenance.hot_traces(traces, hot).agg(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("s"), "trace_id"))).alias("h"))  # `hot` rows
    return out.crossJoin(top.select(F.transform("h", lambda x: x["trace_id"]).alias("hot_trace_ids")))
