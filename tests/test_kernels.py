"""The NumPy kernels and the Spark folds around them, against plain loops."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from mnemos.kernels import folds as K
from mnemos.kernels import predictor
from mnemos.kernels.settle import SettleConfig, entmax, operators, settle, top_k
from mnemos.operators import folds
from mnemos.sources import snapshots


def test_entmax_is_the_known_solution():
    r = np.random.default_rng(0)
    for _ in range(20):
        z = r.normal(size=7) * 2
        p = entmax(z)
        assert math.isclose(p.sum(), 1.0) and (p >= 0).all()
        tau = [zi / 2 - math.sqrt(pi) for zi, pi in zip(z, p) if pi > 1e-6]  # sqrt(p) = z / 2 - tau on the support
        assert max(tau) - min(tau) < 1e-5
    assert np.allclose(entmax(np.zeros(4)), 0.25) and np.allclose(top_k(np.array([0.5, 0.3, 0.2]), 2), [0.625, 0.375, 0.0])


def test_operator_norm_is_capped():
    pos, neg = operators(3, [(0, 1, "temporal", 5.0), (0, 2, "inhib", 10.0), (2, 0, "inhib", 10.0), (1, 2, "assoc", 0.5)])
    assert np.abs(pos).sum(axis=1).max() <= 0.95 + 1e-12 and np.allclose(neg, neg.T) and pos[1, 0] > 0 and pos[0, 1] == 0


def test_settled_activation_is_a_distribution():
    r = np.random.default_rng(1)
    bias = r.normal(size=20)
    edges = [(int(a), int(b), k, 0.4) for a, b in r.integers(0, 20, size=(30, 2)) for k in ("assoc", "inhib")]
    # a group's members share its mass, also one that the sparse step had left out
    s = settle(bias, edges, [([2, 5], np.array([0.6, 0.3]))], SettleConfig(active=6))
    assert abs(s.activation.sum() - 1) < 1e-9 and np.count_nonzero(s.activation) <= 6 + 1 and np.isfinite(s.energies).all() and 0.05 <= s.eta <= 0.35
    assert settle(np.array([1.0]), [], []).activation.tolist() == [1.0]


def trace(**over):
    t = {"trace_id": "t", "z_mu": np.array([1.0, 0.0]), "z_sigma_diag": np.array([0.4, 0.4]), "ctx_mu": np.array([0.5, 0.5]), "ctx_sigma_diag": np.array([0.6, 0.6]), "evidence": 2.0, "stability": 0.3, "uncertainty": 0.2, "pred_loss_ema": 0.1, "access_ema": 1.0, "last_access_ts": 0.0, "anchor_reservoir": ["a"]}
    return t | over


def test_reconsolidation_by_hand():
    x, c = np.array([0.0, 1.0]), np.array([0.2, 0.1])
    got = K.reconsolidate(trace(), [{"r": 0.5, "x": x, "c": c, "loss": 0.4, "ts": 3.0, "anchor_id": "b"}, {"r": 0.0, "x": x, "c": c, "loss": 9.0, "ts": 9.0, "anchor_id": "z"}])
    eta = 0.2 * 0.5 / (1 + 4 * 0.3)
    assert np.allclose(got["z_mu"], [1 - eta, eta])
    assert np.allclose(got["z_sigma_diag"], 0.95 * 0.4 + 0.05 * 1.0)  # against the old mean
    ctx = np.array([0.5, 0.5]) + 0.05 * (c - 0.5)
    assert np.allclose(got["ctx_mu"], ctx) and np.allclose(got["ctx_sigma_diag"], 0.95 * 0.6 + 0.05 * (c - ctx) ** 2)  # against the new one
    evidence = 0.995 * 2 + 0.5
    unc = 0.43 + 0.3 / (evidence + 1e-8) + 0.8 * (0.095 + 0.02)
    assert math.isclose(got["evidence"], evidence) and math.isclose(got["uncertainty"], unc)
    assert got["anchor_reservoir"] == ["a", "b"] and got["last_access_ts"] == 3.0


def test_folds_keep_order_and_pass_untouched_traces(spark):
    state = [trace(trace_id=i) for i in ("p", "q")]
    rows = [[v.tolist() if isinstance(v, np.ndarray) else v for v in t.values()] for t in state]
    df = spark.createDataFrame(rows, folds.TRACE)
    r = np.random.default_rng(2)
    steps = [("p", float(r.random()), r.normal(size=2).tolist(), r.normal(size=2).tolist(), 0.3, float(k // 2), k, f"a{k}") for k in range(12)]
    order = [steps[i] for i in r.permutation(12)]
    schema = "trace_id string, r double, x array<double>, c array<double>, loss double, ts double, seq int, anchor_id string"
    got = {x["trace_id"]: x for x in folds.reconsolidate(df, spark.createDataFrame(order, schema)).collect()}
    want = K.reconsolidate(state[0], [dict(zip(("trace_id", "r", "x", "c", "loss", "ts", "seq", "anchor_id"), s)) | {"x": np.array(s[2]), "c": np.array(s[3])} for s in steps])
    assert np.allclose(got["p"]["z_mu"], want["z_mu"]) and got["p"]["anchor_reservoir"] == want["anchor_reservoir"]
    assert got["q"]["evidence"] == 2.0 and len(got) == 2


def test_actions(spark):
    row = [[v.tolist() if isinstance(v, np.ndarray) else v for v in trace().values()]]
    df = spark.createDataFrame(row, folds.TRACE)
    d = [("t", "ATTACH", [0.0, 1.0], [0.2, 0.1], 1.0, 0, "b"), ("t", "SPLIT", [0.0, 1.0], [0.2, 0.1], 2.0, 1, "c"), (None, "BIRTH", [3.0, 1.0], [0.0, 0.0], 3.0, 2, "d")]
    got = folds.apply_actions(df, spark.createDataFrame(d, "trace_id string, action string, x array<double>, c array<double>, ts double, seq int, anchor_id string")).collect()
    by = {tuple(r["anchor_reservoir"]): r for r in got}
    assert by["a", "b", "c"]["z_mu"] == [1.0, 0.0] and math.isclose(by["a", "b", "c"]["evidence"], 0.995 * 2 + 1)
    assert by[("c",)]["z_sigma_diag"] == [0.2, 0.2] and by[("c",)]["ctx_mu"] == [0.5, 0.5]
    assert by[("d",)]["z_sigma_diag"] == [0.4, 0.4] and by[("d",)]["z_mu"] == [3.0, 1.0]


def test_option_edge_acceptance():
    new = K.option_edge(0.0, 1.0, 1.0, False, 0.65, [0.75, 0.9, 0.5])  # the first gains too little for a new edge
    assert new["taken"] == 1 and math.isclose(new["weight"], 0.5 * 0.15 * 0.9) and math.isclose(new["success_alpha"], 0.98 + 0.9)
    assert not K.option_edge(0.0, 1.0, 1.0, False, 0.0, [0.3])["exists"]


def test_group_update_by_hand():
    g = {"alpha": np.array([1.0, 1.0, 0.5]), "ctx_mu": np.zeros((3, 2)), "ctx_sigma_diag": np.full((3, 2), 0.6), "pred_success_ema": np.array([0.5, 0.5, 0.1]), "temperature": 1.0, "unresolved_mass": 0.2, "replay_tension_ema": 0.0, "ambiguous_buffer": []}
    mu, var, x, c = np.array([[1.0, 0.0], [-1.0, 0.0]]), np.full((2, 2), 0.3), np.array([0.9, 0.0]), np.array([0.1, 0.2])
    log = lambda v, m, s: -0.5 * (((v - m) ** 2 / s).sum() + np.log(s).sum() + 2 * math.log(2 * math.pi))
    s = [math.log(a + 1e-8) + log(c, np.zeros(2), np.full(2, 0.6)) for a in g["alpha"]]
    s = [s[0] + log(x, mu[0], var[0]) + 0.15 * math.log(0.5 + 1e-8), s[1] + log(x, mu[1], var[1]) + 0.15 * math.log(0.5 + 1e-8), s[2] + log(x, np.zeros(2), np.full(2, 1.2))]
    p = np.exp(np.array(s) - max(s))
    p /= p.sum()
    got, inflate = K.update_group(g, mu, var, x, c, "a1", True)
    assert np.allclose(got["alpha"], 0.995 * g["alpha"] + p) and math.isclose(got["unresolved_mass"], 0.95 * 0.2 + p[2])
    assert np.allclose(got["ctx_mu"][0], 0.1 * p[0] * c) and (got["ctx_mu"][2] == 0).all()
    h = -(p * np.log(p)).sum()
    assert math.isclose(got["temperature"], 1 + 0.05 * (h - 0.75 * math.log(3))) and got["ambiguous_buffer"] == (["a1"] if p[2] > 0.25 else [])
    assert np.allclose(inflate, 1 + 0.03 * p[:2] if p[2] > 0.25 else 1)


def test_gradient_by_differences():
    r = np.random.default_rng(3)
    m, x, y = predictor.init(4, 5, 3), r.normal(size=(6, 4)), r.normal(size=(6, 3))
    g, _ = predictor.gradient(m, x, y)
    for k in m:
        i = tuple(d // 2 for d in m[k].shape)
        up, down = ({a: b.copy() for a, b in m.items()} for _ in range(2))
        up[k][i] += 1e-6
        down[k][i] -= 1e-6
        assert abs((predictor.nll(up, x, y).sum() - predictor.nll(down, x, y).sum()) / 2e-6 - g[k][i]) < 1e-5


def test_loss_is_summed_over_dimensions():
    r = np.random.default_rng(5)
    m, x, y = predictor.init(4, 5, 3), r.normal(size=(6, 4)), r.normal(size=(6, 3))
    mu, log_var, _ = predictor.forward(m, x)
    for i in range(6):
        # a Gaussian's log density of each dimension, without its constant
        want = sum(0.5 * ((y[i, k] - mu[i, k]) ** 2 / np.exp(log_var[i, k]) + log_var[i, k]) for k in range(3))
        assert abs(predictor.nll(m, x, y)[i] - want) < 1e-12


def test_training_lowers_the_loss(spark):
    r = np.random.default_rng(4)
    rows = [(x.tolist(), [float(x[0] - x[1])]) for x in r.normal(size=(200, 3))]
    df = spark.createDataFrame(rows, "x array<double>, y array<double>").repartition(3)
    model, losses = folds.fit_transition_model(df, steps=30, hidden=8, rate=0.05)
    assert losses[-1] < losses[0] - 0.1
    assert folds.fit_transition_model(df.limit(0)) == ({}, [])
    assert folds.score_transitions(df, model).agg(F.avg("nll")).first()[0] < losses[0]


def test_training_equals_a_loop(spark):
    """Against plain steps over all rows at once, by finite differences of the whole loss with its drift."""
    from mnemos.kernels import predictor

    r = np.random.default_rng(5)
    x, y = r.normal(size=(60, 3)), r.normal(size=(60, 2))
    df = spark.createDataFrame([(a.tolist(), b.tolist()) for a, b in zip(x, y)], "x array<double>, y array<double>").repartition(5)
    target: dict = {}
    model, losses = folds.fit_transition_model(df, steps=4, hidden=3, rate=0.1, decay=0.5, weight_decay=0.2, target=target, target_ema=0.9)
    m = predictor.init(3, 3, 2, 0)
    t, one, two, seen = {k: v.copy() for k, v in m.items()}, {}, {}, []

    def loss(m):
        return predictor.nll(m, x, y).mean() + 0.5 * sum(((m[k] - t[k]) ** 2).mean() for k in m)

    for step in range(1, 5):
        seen.append(loss(m))
        grads = {}
        for k in m:
            g = np.zeros_like(m[k])
            for i in np.ndindex(*g.shape):
                up, down = {**m, k: m[k].copy()}, {**m, k: m[k].copy()}
                up[k][i] += 1e-6
                down[k][i] -= 1e-6
                g[i] = (loss(up) - loss(down)) / 2e-6
            grads[k] = g
        norm = np.sqrt(sum((g**2).sum() for g in grads.values()))
        for k, g in grads.items():
            g = g / max(1.0, norm) + 0.2 * m[k]
            one[k], two[k] = 0.9 * one.get(k, 0) + 0.1 * g, 0.999 * two.get(k, 0) + 0.001 * g * g
            m[k] = m[k] - 0.1 * (one[k] / (1 - 0.9**step)) / (np.sqrt(two[k] / (1 - 0.999**step)) + 1e-8)
        t = {k: 0.9 * t[k] + 0.1 * m[k] for k in m}
    assert np.allclose(losses, seen, atol=1e-6)
    for k in m:
        assert np.allclose(model[k], m[k], atol=1e-4) and np.allclose(target[k], t[k], atol=1e-4)


def test_snapshots(spark, tmp_path):
    path, t = str(tmp_path / "s"), spark.createDataFrame([("a", [1.0, 2.0])], "trace_id string, z_mu array<double>")
    for step in (1, 2, 3):
        snapshots.write_snapshot({"traces": t}, path, step)
    assert snapshots.read_latest_snapshot(spark, path, 2)["traces"].collect() == t.collect()
    with pytest.raises(ValueError):
        snapshots.read_latest_snapshot(spark, path, 3)
    assert snapshots.prune_snapshots(spark, path, 0) == [] and snapshots.prune_snapshots(spark, path, 1) == [2, 1]
    assert [r["step"] for r in snapshots.manifest(spark, path).collect()] == [3]
    row = spark.sql("select 9L step, '' reason, 3 schema_version, current_timestamp() created_at, array('traces') tables")
    row.write.mode("append").parquet(f"{path}/manifest")
    with pytest.raises(ValueError):
        snapshots.read_latest_snapshot(spark, path)


def test_nearest_by_brute_force():
    import pyarrow as pa

    from mnemos.kernels.nearest import Nearest, by_width

    r = np.random.default_rng(3)
    cues = r.integers(-2, 3, (700, 4)).astype(float).tolist() + [None, [1.0, 2.0], [0.0] * 4]
    batches = [[(f"t{b}-{i}", v) for i, v in enumerate([*r.integers(-2, 3, (n, 4)).astype(float).tolist(), None, [3.0, 1.0], [float("nan")] * 4])] for b, n in enumerate((3, 0, 90, 40))]
    best = Nearest(by_width(pa.array(cues, pa.list_(pa.float64()))), 5)
    for b in batches:
        best.add(pa.array([i for i, _ in b]), pa.array([v for _, v in b], pa.list_(pa.float64())))
    got: dict = {}
    for at, ids, score in best.rows():
        for c, i, s in zip(at.tolist(), ids.to_pylist(), score.tolist()):
            got.setdefault(c, []).append((-s, i))

    def cosine(a, b):
        dot = lambda x, y: sum((p * q for p, q in zip(x, y)), 0.0)
        return dot(a, b) / max(np.sqrt(dot(a, a)) * np.sqrt(dot(b, b)), 1e-8)

    for c, x in enumerate(cues):
        want = sorted((-cosine(x, v), i) for b in batches for i, v in b if x and v and len(v) == len(x) and v == v and not np.isnan(v).any())[:5]
        assert got.get(c, []) == want


def test_small_folds_are_dealt_to_all_tasks(spark):
    """Adaptive execution would put keys of few bytes into one task."""
    rows = spark.createDataFrame([[v.tolist() if isinstance(v, np.ndarray) else v for v in trace(trace_id=f"t{i}").values()] for i in range(40)], folds.TRACE)
    steps = spark.createDataFrame([(f"t{i}", 0.5, [0.0, 1.0], [0.2, 0.1], 0.3, 1.0, i, "a") for i in range(40)], "trace_id string, r double, x array<double>, c array<double>, loss double, ts double, seq int, anchor_id string")
    tasks = folds.reconsolidate(rows, steps).select(F.spark_partition_id().alias("p")).distinct().count()
    assert tasks == int(spark.conf.get("spark.sql.shuffle.partitions"))


def test_entmax_equals_plain_bisection():
    r = np.random.default_rng(3)
    for k in range(200):
        z = np.round(r.normal(size=r.integers(1, 40)) * [0.3, 2.0, 50.0][k % 3], 1 + 8 * (k % 2))
        z0 = z - z.max()
        low, high = z0.min() - 2.0, 0.0
        for _ in range(50):
            mid = (low + high) / 2
            low, high = (mid, high) if (np.maximum(0.5 * (z0 - mid), 0.0) ** 2.0).sum() > 1.0 else (low, mid)
        p = np.maximum(0.5 * (z0 - low), 0.0) ** 2.0
        assert (entmax(z) == p / p.sum()).all()


def test_nearest_holds_a_bounded_matrix():
    """However long a batch is, similarities are made a block of vectors at a time, with the same rows."""
    import tracemalloc

    import pyarrow as pa

    from mnemos.kernels.nearest import Nearest

    r = np.random.default_rng(4)
    cues, ids, vectors = r.normal(size=(256, 4)), np.arange(60_000), r.normal(size=(60_000, 4))
    column = pa.FixedSizeListArray.from_arrays(pa.array(vectors.ravel()), 4).cast(pa.list_(pa.float64()))
    best = Nearest({4: (np.arange(256), cues)}, 3)
    tracemalloc.start()
    best.add(pa.array(ids), column)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 40e6  # a matrix of all would have 123 MB
    (at, found, score), = best.rows()
    full = cues @ vectors.T / np.outer(np.linalg.norm(cues, axis=1), np.linalg.norm(vectors, axis=1))
    assert (found.to_numpy().reshape(256, 3) == np.argsort(-full, axis=1)[:, :3]).all()
