"""Numbering and folds of hot keys: in several tasks and chunks, with the rows of one task."""

import random

import pytest
from pyspark.sql import functions as F

from mnemos.operators import folds, graph, ordered
from tests.test_replay import GROUP, TRACE, a_group, a_trace


def test_hot_keys_are_numbered_by_ranges(spark):
    rows = [("hot", i // 2, i) for i in range(3000)] + [(f"k{i % 40}", i, 0) for i in range(400)]
    random.Random(1).shuffle(rows)
    df = spark.createDataFrame(rows, "key string, ts int, seq int").repartition(6)
    got = ordered.ranked(df, ["key"], ["ts", "seq"], chunk=500)
    want = {}
    for key in {r[0] for r in rows}:
        want |= {r: i for i, r in enumerate(sorted(r for r in rows if r[0] == key))}
    assert {(r["key"], r["ts"], r["seq"]): r["k"] for r in got.collect()} == want
    hot = df.where("key = 'hot'")
    assert hot.repartitionByRange(4, "key", "ts", "seq").select(F.spark_partition_id()).distinct().count() > 1  # several tasks


@pytest.fixture
def small_chunks(monkeypatch):
    monkeypatch.setattr(ordered, "CHUNK", 7)


def both(run, monkeypatch):
    """The rows with one chunk, and with chunks of 7."""
    monkeypatch.setattr(ordered, "CHUNK", 10**9)
    whole = sorted(map(str, run().collect()))
    monkeypatch.setattr(ordered, "CHUNK", 7)
    return whole, sorted(map(str, run().collect()))


def rounded(df, *columns):
    return df.withColumns({c: F.round(c, 9) if df.schema[c].dataType.simpleString() == "double" else F.transform(c, lambda v: F.round(v, 9)) for c in columns})


def test_edges_of_hot_keys(spark, monkeypatch):
    r = random.Random(2)
    touches = [("a", "b", "temporal", r.random(), float(i // 3), i) for i in range(60)] + [("c", "d", "assoc", 0.1, 1.0, i) for i in range(3)]
    deltas = spark.createDataFrame(touches, "src string, dst string, kind string, delta double, ts double, seq int")
    edges = spark.createDataFrame([("a", "b", "temporal", 0.5, 0.4, 0.0, 0.0, 1.0, 1.0), ("a", "b", "option", 0.2, 0.1, 0.0, 0.0, 2.0, 1.0)], "src string, dst string, kind string, weight double, support_ema double, last_update_ts double, bf_sep_ema double, success_alpha double, success_beta double")
    whole, parts = both(lambda: rounded(graph.upsert_edges(deltas, edges), "weight", "support_ema"), monkeypatch)
    w = 0.5
    for *_, d, _, _ in sorted(touches[:60], key=lambda t: t[4:]):
        w = 0.95 * w + d
    assert whole == parts and f"weight={round(w, 9)}"[:16] in whole[1]
    steps = spark.createDataFrame([("a", "b", r.random(), float(i // 4), i) for i in range(80)] + [("e", "f", r.random(), 1.0, i) for i in range(30)] + [("g", "h", 0.1, 1.0, 1)], "src string, dst string, success double, ts double, seq int")
    for grow in (0.0, 0.15):
        whole, parts = both(lambda: rounded(folds.option_edges(steps, edges, grow), "weight", "success_alpha", "success_beta"), monkeypatch)
        assert whole == parts and len(whole) == 2


def test_traces_of_hot_keys(spark, monkeypatch):
    r = random.Random(3)
    traces = spark.createDataFrame([a_trace(f"t{i}", "s", [float(i), 1.0]) for i in range(4)], TRACE)
    steps = spark.createDataFrame([("t1" if i % 4 else f"t{r.randrange(3)}", r.random(), [r.random(), r.random()], [r.random(), 0.0], r.random(), float(i // 2), i, f"a{i % 13}", r.choice(["ASSIMILATE", "ATTACH", "SPLIT"])) for i in range(90)], "trace_id string, r double, x array<double>, c array<double>, loss double, ts double, seq int, anchor_id string, action string")
    vectors = ("z_mu", "z_sigma_diag", "ctx_mu", "ctx_sigma_diag")
    for f in (folds.reconsolidate, folds.apply_actions):
        whole, parts = both(lambda: rounded(f(traces, steps), *vectors, "evidence", "stability", "uncertainty"), monkeypatch)
        assert whole == parts


def test_groups_of_hot_keys(spark, monkeypatch):
    r = random.Random(4)
    traces = spark.createDataFrame([a_trace(f"t{i}", "s", [float(i), 1.0]) for i in range(4)], TRACE)
    groups = spark.createDataFrame([a_group("g", ["t0", "gone", "t1"]), a_group("h", ["t2", "t3"])], GROUP)
    seen = spark.createDataFrame([("g" if i % 5 else "h", [r.random() * 3, r.random()], [r.random(), 0.0], float(i // 2), i, f"a{i}", r.random()) for i in range(60)], "group_id string, x array<double>, c array<double>, ts double, seq int, anchor_id string, loss double")
    flat = lambda df: df.withColumns({"ctx_mu": F.flatten("ctx_mu"), "ctx_sigma_diag": F.flatten("ctx_sigma_diag")})
    whole, parts = both(lambda: rounded(flat(folds.update_groups(groups, traces, seen)).drop("ambiguous_ctx_buffer"), "alpha", "ctx_mu", "ctx_sigma_diag", "pred_success_ema", "temperature", "unresolved_mass", "replay_tension_ema", "replay_alignment_ema", "inflation"), monkeypatch)
    assert whole == parts and len(whole) == 2


def test_the_first_of_many_are_numbered_by_ranges(spark):
    """More first rows than a chunk aren't one task's top, and are the same rows."""
    rows = spark.range(1000).select(F.col("id").cast("string").alias("key"), (F.col("id") * 37 % 11).cast("double").alias("score"))
    few = ordered.first(rows, ["score", "key"], 400)
    many = ordered.first(rows, ["score", "key"], 400, chunk=50)
    assert "TakeOrdered" in few._jdf.queryExecution().toString() and "TakeOrdered" not in many._jdf.queryExecution().toString()
    assert many.columns == rows.columns and sorted(map(str, many.collect())) == sorted(map(str, few.collect()))
