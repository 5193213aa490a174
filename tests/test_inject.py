"""The inject loop: invariants, and stream = batch."""

import numpy as np
import pytest

from mnemos.kernels.inject import Session
from mnemos.streaming.inject import inject_sessions, inject_stream, maintenance_trigger

SCHEMA = "session_id string, anchor_id string, ts double, seq bigint, chunk_index int, z array<double>"


def anchors(n=16):
    r = np.random.default_rng(0)
    poles = {0: [1.0, 0.0, 0.0], 1: [0.0, 1.0, 0.0]}
    return [(s, f"{s}{k}", float(k), k, 0, (np.array(poles[k % 2]) + 0.01 * r.normal(size=3)).tolist()) for s in ("a", "b", "") for k in range(n)]


def test_alternating_session():
    s = Session("a", 3)
    frames = [s.inject(a[1], np.array(a[5]), a[2]) for a in anchors() if a[0] == "a"]
    assert frames[0]["action"] == "BIRTH" and len(s.traces) >= 2
    assert all(abs(sum(f["weights"]) - 1) < 1e-9 and np.isfinite(f["objective"]) for f in frames)
    assert any(k[2] == "temporal" for k in s.edges) and all(w >= 0 for w in s.edges.values())
    again = Session.from_json(s.to_json())
    assert again.to_json() == s.to_json()


def test_batch_is_independent_of_partitions_and_order(spark):
    rows = anchors(8)
    key = lambda df: sorted((r["anchor_id"], r["action"], r["trace_id"], round(r["objective"], 9)) for r in df.collect())
    one = key(inject_sessions(spark.createDataFrame(rows, SCHEMA).coalesce(1)))
    assert one == key(inject_sessions(spark.createDataFrame(rows[::-1], SCHEMA).repartition(5))) and len(one) == 24
    assert inject_sessions(spark.createDataFrame([], SCHEMA)).count() == 0


def test_stream_equals_batch(spark, tmp_path):
    rows = anchors(8)
    src = str(tmp_path / "in")
    for part in (rows[:0] + [r for r in rows if r[2] < 4], [r for r in rows if r[2] >= 4]):
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").json(src)
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).json(src)
    q = inject_stream(stream).writeStream.format("memory").queryName("frames").option("checkpointLocation", str(tmp_path / "cp")).outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(120)
    pick = lambda df: sorted((r["session_id"], r["seq"], r["anchor_id"], r["action"], r["trace_id"]) for r in df.collect())
    assert pick(spark.table("frames")) == pick(inject_sessions(spark.createDataFrame(rows, SCHEMA)))


def test_maintenance_trigger(spark, tmp_path):
    src, seen = str(tmp_path / "in"), []
    spark.createDataFrame(anchors(3), SCHEMA).write.json(src)
    q = maintenance_trigger(spark.readStream.schema(SCHEMA).json(src), lambda df, i: seen.append(df.count()), checkpoint=str(tmp_path / "cp"), once=True)
    q.awaitTermination(60)
    assert sum(seen) == 9
    with pytest.raises(ValueError):
        maintenance_trigger(spark.readStream.schema(SCHEMA).json(src), lambda df, i: None, interval=0)
