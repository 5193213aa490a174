"""Staged tables: each step's result is written once under its name, and the whole is committed by one rename."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir, or a new local folder where everything runs in this process; a cluster without it is refused."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or _own.get(spark.sparkContext.applicationId)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = _own[spark.sparkContext.applicationId] = tempfile.mkdtemp(prefix="spark-stages-")
    return folder.rstrip("/")


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """df dealt by keys to spark.sql.shuffle.partitions tasks, for work that its bytes don't show: adaptive execution would
    put keys of few bytes and long loops into one task."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


class Stages:
    """Tables of one run. keep() cuts lineage: a lost executor costs the stage that was running, not the ones before.

    Nothing is overwritten: a run has a folder of its own, and a run that fails leaves whatever was committed before.
    """

    def __init__(self, spark: SparkSession, name: str) -> None:
        self.spark, self.path = spark, f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
        self.names: list[str] = []

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        at = f"{self.path}/{len(self.names):03}-{name}"
        self.names.append(name)
        df.write.parquet(at)
        return self.spark.read.schema(df.schema).parquet(at)
