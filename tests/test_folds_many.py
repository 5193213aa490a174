"""Traces that are folded together, a step of all at a time, against the loops over one trace."""

import random

import numpy as np
import pytest

from mnemos.kernels import folds as kernel
from mnemos.operators import folds

STEP = "trace_id string, r double, x array<double>, c array<double>, loss double, ts double, seq int, anchor_id string, action string"


def world(r, traces=23, steps=400):
    v = lambda d: [r.random() for _ in range(d)]
    width = lambda i: (1, 2) if i % 7 == 6 else (3, 2)
    held = [["a1", "a2"], [], [f"a{i}" for i in range(11)], ["a1", "b", "b", "a2"]]
    t = [(f"t{i}", v(width(i)[0]), v(width(i)[0]), v(2), v(2), 1.0 + i, 0.5, 0.2, 0.1, 0.3, 9.0, held[i % 4]) for i in range(traces)]
    s = []
    for k in range(steps):
        i = r.choice([0, r.randrange(traces), r.randrange(5)]) if k % 40 else 99  # 99: of no trace
        s.append((f"t{i}", r.choice([0.0, -1.0, 0.4, 1.0, 3.0]), v(width(i)[0]), v(2), r.random() - 0.2, float(k // 3), k, None if k % 11 == 0 else f"a{r.randrange(15)}", r.choice(["ASSIMILATE", "ATTACH", "SPLIT"])))
    r.shuffle(t)
    return t, s


def loop(traces, steps, one):
    names, of, out = [c.split()[0] for c in STEP.split(", ")], {}, {}
    for s in sorted(steps, key=lambda s: (s[5], s[6])):
        d = dict(zip(names, s))
        of.setdefault(s[0], []).append(d | {"x": np.array(d["x"]), "c": np.array(d["c"])})
    for t in traces:
        out[t[0]] = one({c: np.array(v) if c in folds._VECTORS else v for c, v in zip(folds._COLUMNS, t)}, of.get(t[0], []))
    return out


def acted(t, steps):
    for s in steps:
        t = kernel.apply_action(t, s)
    return t


@pytest.mark.parametrize("batch", [1, 50, 1 << 16])
def test_folds_of_many_traces(spark, monkeypatch, batch):
    monkeypatch.setattr(folds, "BATCH", batch)
    traces, steps = world(random.Random(batch))
    t, s = spark.createDataFrame(traces, folds.TRACE), spark.createDataFrame(random.Random(1).sample(steps, len(steps)), STEP).repartition(3)
    for f, one in ((folds.reconsolidate, kernel.reconsolidate), (folds.apply_actions, acted)):
        done = f(t, s)
        assert "CoGroupsInPandas" not in done._jdf.queryExecution().toString()  # no call for a trace of its own
        want, rows = loop(traces, steps, one), done.where("trace_id not like 'trace_%'").collect()
        got = {r["trace_id"]: r for r in rows}
        assert got.keys() == want.keys() and len(rows) == len(traces)
        for k, w in want.items():
            for c in folds._COLUMNS[1:]:
                assert got[k][c] == (pytest.approx(np.array(w[c]).tolist(), abs=1e-9) if c != "anchor_reservoir" else list(w[c])), (k, c)


def test_wrong_widths_are_told(spark):
    traces, steps = world(random.Random(5), 9, 9)
    steps[1] = ("t0", 1.0, [1.0], [0.0, 0.0], 0.0, 1.0, 1, "a", "ATTACH")
    with pytest.raises(Exception, match="as wide"):
        folds.reconsolidate(spark.createDataFrame(traces, folds.TRACE), spark.createDataFrame(steps, STEP)).collect()
    empty = folds.reconsolidate(spark.createDataFrame([], folds.TRACE), spark.createDataFrame(steps[:1], STEP))
    assert empty.count() == 0


def test_reservoirs_after_many_pushes():
    r = random.Random(2)
    for _ in range(300):
        arr, items = [r.choice("abcdef") for _ in range(r.randrange(6))], [r.choice("abcdef") for _ in range(r.randrange(7))]
        want = arr
        for i in items:
            want = kernel.push(want, i, 3)
        assert kernel.pushed(arr, items, 3) == want
