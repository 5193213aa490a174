"""Versions: immutable, readable after a crash at any step, pruned without a gap."""

import pytest
from pyspark.sql import functions as F

from mnemos.sources import snapshots


@pytest.fixture
def tables(spark):
    return lambda n: {"traces": spark.range(n).withColumn("z_mu", F.array(F.lit(0.0), F.lit(1.0))), "edges": spark.range(n)}


def latest(spark, path):
    return {k: v.count() for k, v in snapshots.read_latest_snapshot(spark, path, 2).items()}


def test_a_version_is_never_written_twice(spark, tables, tmp_path):
    path = str(tmp_path / "s")
    with pytest.raises(ValueError, match="no snapshot"):
        snapshots.read_latest_snapshot(spark, path)
    snapshots.write_snapshot(tables(3), path, 1)
    with pytest.raises(ValueError, match="already"):
        snapshots.write_snapshot(tables(5), path, 1)
    assert latest(spark, path) == {"traces": 3, "edges": 3}
    snapshots.write_snapshot(tables(4), path, 10)
    snapshots.write_snapshot(tables(2), path, 9)  # an older step that comes late isn't the newest
    assert latest(spark, path) == {"traces": 4, "edges": 4}


@pytest.mark.parametrize("dies_at", ["tables", "entry", "rename"])
def test_a_crash_while_writing_leaves_the_last_version(spark, tables, tmp_path, monkeypatch, dies_at):
    path = str(tmp_path / "s")
    snapshots.write_snapshot(tables(3), path, 1)
    with monkeypatch.context() as m:
        if dies_at == "rename":
            m.setattr(snapshots.Folder, "rename", lambda *a: (_ for _ in ()).throw(RuntimeError("lost")))
        else:
            write = type(spark.range(1).write).parquet
            dead = "edges" if dies_at == "tables" else "_entry"
            m.setattr(type(spark.range(1).write), "parquet", lambda self, p, *a, **k: (_ for _ in ()).throw(RuntimeError("lost")) if p.endswith(dead) else write(self, p, *a, **k))
        with pytest.raises(RuntimeError, match="lost"):
            snapshots.write_snapshot(tables(9), path, 2)
    assert latest(spark, path) == {"traces": 3, "edges": 3}
    snapshots.write_snapshot(tables(5), path, 2)  # the same step can be written after all
    assert latest(spark, path) == {"traces": 5, "edges": 5}
    snapshots.write_snapshot(tables(6), path, 3)
    snapshots.prune_snapshots(spark, path, 2)
    assert len(snapshots.Folder(spark, path).names("data")) == 2  # what the dead job left is gone


def test_a_crash_while_pruning_leaves_whole_versions(spark, tables, tmp_path, monkeypatch):
    path = str(tmp_path / "s")
    for step in range(1, 6):
        snapshots.write_snapshot(tables(step), path, step)
    drop = snapshots.Folder.drop
    calls = []

    def once(self, name):
        calls.append(name)
        if len(calls) == 2:
            raise RuntimeError("lost")
        drop(self, name)

    with monkeypatch.context() as m:
        m.setattr(snapshots.Folder, "drop", once)
        with pytest.raises(RuntimeError, match="lost"):
            snapshots.prune_snapshots(spark, path, 2)
    left = [r["step"] for r in snapshots.manifest(spark, path).orderBy("step").collect()]
    assert left[-2:] == [4, 5] and latest(spark, path) == {"traces": 5, "edges": 5}
    for r in snapshots.manifest(spark, path).collect():  # every entry has its tables
        assert spark.read.parquet(f"{path}/{r['data']}/edges").count() == r["step"]
    assert set(snapshots.prune_snapshots(spark, path, 2)) == set(left[:-2])
    assert [r["step"] for r in snapshots.manifest(spark, path).orderBy("step").collect()] == [4, 5]
    assert snapshots.prune_snapshots(spark, path, 0) == [] and len(snapshots.Folder(spark, path).names("data")) == 2


def test_other_schema_and_width_are_refused(spark, tables, tmp_path, monkeypatch):
    path = str(tmp_path / "s")
    monkeypatch.setattr(snapshots, "SCHEMA_VERSION", 3)
    snapshots.write_snapshot(tables(1), path, 1)
    monkeypatch.setattr(snapshots, "SCHEMA_VERSION", 6)
    with pytest.raises(ValueError, match="schema version 3"):
        snapshots.read_latest_snapshot(spark, path)
    snapshots.write_snapshot(tables(1), path, 2)
    with pytest.raises(ValueError, match="dimensions"):
        snapshots.read_latest_snapshot(spark, path, 7)
