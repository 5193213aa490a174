"""Keyed ordered folds, and the transition model, around the NumPy kernels."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mnemos.config import FIELD, FieldConfig
from mnemos.kernels import folds, pairs, predictor
from mnemos.operators import ordered
from mnemos.sources.stages import Stages, spread

TRACE = "trace_id string, z_mu array<double>, z_sigma_diag array<double>, ctx_mu array<double>, ctx_sigma_diag array<double>, evidence double, stability double, uncertainty double, pred_loss_ema double, access_ema double, last_access_ts double, anchor_reservoir array<string>"
_COLUMNS = [c.split()[0] for c in TRACE.split(", ")]
_VECTORS = ("z_mu", "z_sigma_diag", "ctx_mu", "ctx_sigma_diag")
#: Rows that a task folds together, but for a trace of more.
BATCH = 1 << 16


def _fold(traces: DataFrame, steps: DataFrame, many: Callable[[dict, dict, np.ndarray], dict], names: tuple[str, ...]) -> DataFrame:
    """Traces folded over their steps (x, c, ts, anchor_id and `names`) in (ts, seq) order. Traces are independent; the order
    inside one is the semantics. A task takes some BATCH rows of whole traces and folds them together, a step of all of them
    at a time. A trace of more steps than ordered.CHUNK is folded in chunks that hand on its state. Traces without steps pass by.
    """
    vectors, columns = ("x", "c"), ["x", "c", *names, "ts", "anchor_id"]

    def folded(rows: pa.Table) -> Iterator[pa.RecordBatch]:
        """Whole traces: a row of each trace, then its steps."""
        first = np.flatnonzero(np.diff(_codes(rows["trace_id"]), prepend=-1))
        is_state = rows["_side"].to_numpy() == 0
        first = first[is_state[first]]  # steps of no trace go
        if not len(first):
            return
        ends = np.append(np.flatnonzero(np.diff(_codes(rows["trace_id"]), prepend=-1)), rows.num_rows)
        ends = ends[np.searchsorted(ends, first, side="right")]
        t = pa.Table.from_struct_array(rows["_trace"].combine_chunks().take(pa.array(first)))
        place, mine = np.flatnonzero(~is_state), np.zeros(rows.num_rows, dtype=np.int64)
        mine[first] += 1
        mine[ends[ends < rows.num_rows]] -= 1
        place = place[np.cumsum(mine)[place] > 0]
        s = pa.Table.from_struct_array(rows["_step"].combine_chunks().take(pa.array(place)))
        at = np.append(np.searchsorted(place, first), len(place))
        (z, wide), (ctx, wide_ctx) = pairs.matrix(t["z_mu"]), pairs.matrix(t["ctx_mu"])
        var, ctx_var, (x, wide_x), (c, wide_c) = pairs.matrix(t["z_sigma_diag"])[0], pairs.matrix(t["ctx_sigma_diag"])[0], *(pairs.matrix(s[v]) for v in vectors)
        of = np.repeat(np.arange(len(first)), np.diff(at))
        if (wide < 0).any() or (wide_ctx < 0).any() or (wide_x != wide[of]).any() or (wide_c != wide_ctx[of]).any():
            raise ValueError("a step's vectors aren't as wide as its trace's")
        number = {n: pairs.numbers(t[n]) for n in _COLUMNS if n not in (*_VECTORS, "trace_id", "anchor_reservoir")}
        reservoir, given = t["anchor_reservoir"].to_pylist(), {n: pairs.numbers(s[n]) if n != "action" else s[n].to_pylist() for n in (*names, "ts")}
        anchor = s["anchor_id"].to_pylist()
        for n, k in {*zip(wide.tolist(), wide_ctx.tolist())}:
            own = np.flatnonzero((wide == n) & (wide_ctx == k))
            some = own if len(own) < len(wide) else slice(None)
            i = np.flatnonzero(np.isin(of, own)) if len(own) < len(wide) else np.arange(len(of))
            state = {"z_mu": z[some, :n], "z_sigma_diag": var[some, :n], "ctx_mu": ctx[some, :k], "ctx_sigma_diag": ctx_var[some, :k], "anchor_reservoir": [reservoir[j] for j in own]} | {m: v[some] for m, v in number.items()}
            seen = {"x": x[i, :n], "c": c[i, :k], "anchor_id": [anchor[j] for j in i]} | {m: v[i] if m != "action" else [v[j] for j in i] for m, v in given.items()}
            new = many(state, seen, np.concatenate([[0], np.cumsum(np.diff(at)[own])]))
            ids = t["trace_id"].combine_chunks().take(pa.array(own))
            out = {m: pa.FixedSizeListArray.from_arrays(pa.array(v.ravel()), v.shape[1]).cast(pa.list_(pa.float64())) if v.shape[1] else pa.array([[]] * len(v), pa.list_(pa.float64())) for m, v in new.items() if m in _VECTORS}
            out |= {m: pa.array(new[m], mask=np.isnan(new[m])) for m in number} | {"trace_id": ids, "anchor_reservoir": pa.array(new["anchor_reservoir"], pa.list_(pa.string()))}
            yield pa.RecordBatch.from_arrays([out[m] for m in _COLUMNS], names=_COLUMNS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for b in batches:
            held.append(b)
            if sum(h.num_rows for h in held) >= BATCH:
                rows = pa.Table.from_batches(held)
                cut = int(np.flatnonzero(np.diff(_codes(rows["trace_id"]), prepend=-1))[-1])  # the last trace may go on
                yield from folded(rows.slice(0, cut)) if cut else ()
                held = rows.slice(cut).combine_chunks().to_batches()
        if held:
            yield from folded(pa.Table.from_batches(held))

    def fold(state: DataFrame, part: DataFrame) -> DataFrame:
        cast = lambda c: F.col(c).cast(dict(x.split(" ", 1) for x in TRACE.split(", "))[c]).alias(c)
        step = F.struct(*(F.col(c).cast("array<double>" if c in vectors else "string" if c in ("action", "anchor_id") else "double").alias(c) for c in columns))
        left = state.select(cast("trace_id"), F.lit(0).alias("_side"), F.struct(*map(cast, _COLUMNS)).alias("_trace"))
        right = part.select(cast("trace_id"), F.lit(1).alias("_side"), "ts", "seq", step.alias("_step"))
        both = left.unionByName(right, allowMissingColumns=True).repartition(int(state.sparkSession.conf.get("spark.sql.shuffle.partitions")), "trace_id")
        dealt = both.sortWithinPartitions("trace_id", "_side", F.asc_nulls_last("ts"), F.asc_nulls_last("seq"))
        return dealt.select("trace_id", "_side", "_trace", "_step").mapInArrow(run, TRACE)

    return ordered.folded(traces.select(*_COLUMNS), steps, ["trace_id"], ["ts", "seq"], fold)


def _codes(ids: pa.ChunkedArray) -> np.ndarray:
    """Equal ids that follow each other have equal numbers, and others don't."""
    return ids.combine_chunks().dictionary_encode("encode").indices.to_numpy()


def reconsolidate(traces: DataFrame, steps: DataFrame, config: FieldConfig = FIELD) -> DataFrame:
    """steps: trace_id, r, x, c, loss, ts, seq, anchor_id."""
    return _fold(traces, steps, lambda t, s, at: folds.reconsolidate_many(t, s, at, config), ("r", "loss"))


def apply_actions(traces: DataFrame, decisions: DataFrame, config: FieldConfig = FIELD) -> DataFrame:
    """decisions: trace_id (null for BIRTH), action, x, c, ts, seq, anchor_id. Folded traces, and new ones of BIRTH/SPLIT.

    A child of SPLIT takes half its parent's variance (0.4 at most) and the parent's context as it was at batch start.
    """
    kept = _fold(traces, decisions.where("action != 'BIRTH'"), lambda t, s, at: folds.apply_actions_many(t, s, at, config), ("action",))
    old = traces.select("trace_id", F.col("z_sigma_diag").alias("pz"), F.col("ctx_mu").alias("pc"), F.col("ctx_sigma_diag").alias("ps"))
    new = decisions.where("action in ('BIRTH', 'SPLIT')").join(old, "trace_id", "left")
    split = F.col("action") == "SPLIT"
    born = new.select(
        F.concat(F.lit("trace_"), F.substring(F.sha2(F.concat_ws(":", F.col("anchor_id"), F.col("seq").cast("string")), 256), 1, 32)).alias("trace_id"), F.col("x").alias("z_mu"),
        F.when(split, F.transform("pz", lambda v: F.least(F.lit(0.4), v / 2))).otherwise(F.transform("x", lambda _: F.lit(0.4))).alias("z_sigma_diag"), F.when(split, F.col("pc")).otherwise(F.col("c")).alias("ctx_mu"),
        F.when(split, F.col("ps")).otherwise(F.transform("c", lambda _: F.lit(0.6))).alias("ctx_sigma_diag"), F.lit(1.0).alias("evidence"), F.lit(0.0).alias("stability"), F.lit(1.0).alias("uncertainty"), F.lit(0.0).alias("pred_loss_ema"), F.lit(1.0).alias("access_ema"), F.col("ts").alias("last_access_ts"), F.array("anchor_id").alias("anchor_reservoir"),
    )
    return kept.unionByName(born)


OPTION = "src string, dst string, t double, weight double, success_alpha double, success_beta double, taken int, has boolean"


def option_edges(transitions: DataFrame, edges: DataFrame, grow: float = 0.0) -> DataFrame:
    """(src, dst, weight, success_alpha, success_beta, taken) after transitions (src, dst, success, ts, seq) in order.

    Whether a success is taken depends on the edge so far, so it is a fold by edge over two numbers a transition: a hot
    edge goes in chunks that hand on six numbers (see ordered). grow: what each step adds to the temporal edge.
    """
    kind = lambda k, c: F.max(F.when(F.col("kind") == k, F.col(c)))
    old = edges.groupBy("src", "dst").agg(kind("temporal", "weight").alias("t"), kind("option", "weight").alias("w"), kind("option", "success_alpha").alias("a"), kind("option", "success_beta").alias("b"))
    zero = lambda c, v: F.coalesce(F.col(c), F.lit(v)).alias
    start = transitions.select("src", "dst").distinct().join(old, ["src", "dst"], "left").select("src", "dst", zero("t", 0.0)("t"), zero("w", 0.0)("weight"), zero("a", 1.0)("success_alpha"), zero("b", 1.0)("success_beta"), F.lit(0).alias("taken"), F.col("w").isNotNull().alias("has"))
    names = [c.split()[0] for c in OPTION.split(", ")]

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for df in parts:
            out = []
            for r in df.itertuples(index=False):
                e = folds.option_edge(r.weight, r.success_alpha, r.success_beta, r.has, r.t, [x["success"] for x in r.s], grow=grow)
                n = len(r.s)
                t = 0.95**n * r.t + grow * (1 - 0.95**n) / 0.05 if grow else r.t
                out.append((r.src, r.dst, t, e["weight"], e["success_alpha"], e["success_beta"], r.taken + e["taken"], e["exists"]))
            yield pd.DataFrame(out, columns=names)

    def fold(state: DataFrame, part: DataFrame) -> DataFrame:
        chunk = part.groupBy("src", "dst").agg(F.array_sort(F.collect_list(F.struct("ts", "seq", "success"))).alias("s"))
        return spread(state.join(chunk, ["src", "dst"]).select(*names, "s"), "src", "dst").mapInPandas(run, OPTION)

    done = ordered.folded(start, transitions, ["src", "dst"], ["ts", "seq"], fold)
    return done.where("has").select("src", "dst", "weight", "success_alpha", "success_beta", "taken")


def _xy(b: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    take = lambda i: np.array(b.column(i).to_pylist(), dtype=np.float64).reshape(b.num_rows, -1)
    return take(0), take(1)


def score_transitions(rows: DataFrame, model: dict[str, np.ndarray], x: str = "x", y: str = "y") -> DataFrame:
    """rows with nll, the model's loss of y given x (both arrays); the weights are small and shared by broadcast."""
    shared = rows.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def score(xs: pd.Series, ys: pd.Series) -> pd.Series:
        return pd.Series(predictor.nll(shared.value, np.stack(xs.to_list()).astype(float), np.stack(ys.to_list()).astype(float))) if len(xs) else pd.Series([], dtype=float)

    return rows.withColumn("nll", score(F.col(x), F.col(y)))


def _summed(rows: DataFrame, model: dict[str, np.ndarray], parts: int) -> tuple[np.ndarray, float, int]:
    """Gradients, loss and rows of all rows: summed by task, then by `parts` groups of tasks, which reach the driver."""
    names, shared = list(model), rows.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, loss, n = None, 0.0, 0
        for b in batches:
            if b.num_rows:
                g, s = predictor.gradient(shared.value, *_xy(b))
                total = g if total is None else {k: total[k] + g[k] for k in names}
                loss, n = loss + s, n + b.num_rows
        if total is not None:
            flat = np.concatenate([total[k].ravel() for k in names])
            yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId() % parts], pa.int32()), pa.array([flat.tolist()], pa.list_(pa.float64())), pa.array([loss]), pa.array([n], pa.int64())], names=["part", "g", "loss", "n"])

    def add(table: pa.Table) -> pa.Table:
        g = np.sum(np.array(table["g"].to_pylist()), axis=0)
        return pa.table({"g": pa.array([g.tolist()], pa.list_(pa.float64())), "loss": [sum(table["loss"].to_pylist())], "n": pa.array([sum(table["n"].to_pylist())], pa.int64())})

    found = rows.mapInArrow(run, "part int, g array<double>, loss double, n bigint").groupBy("part").applyInArrow(add, "g array<double>, loss double, n bigint").collect()
    shared.unpersist()
    return np.sum([p["g"] for p in found], axis=0), sum(p["loss"] for p in found), sum(p["n"] for p in found)


def fit_transition_model(rows: DataFrame, steps: int = 20, hidden: int = 16, rate: float = 3e-3, decay: float = 1e-5, x: str = "x", y: str = "y", seed: int = 0, target_ema: float = 0.995, weight_decay: float = 1e-5, start: dict[str, np.ndarray] | None = None, target: dict[str, np.ndarray] | None = None, parts: int = 16) -> tuple[dict[str, np.ndarray], list[float]]:
    """The model and the loss before each step (negative log likelihood and `decay` times the drift from the target).

    The source is read once and written; each step sums gradients over it in two levels, so the driver sees `parts` vectors
    of the model's size. The drift is the mean squared distance of each weight table from the target copy, which follows
    the model by target_ema; the gradient is clipped to norm 1, and Adam with weight decay takes the step. target is changed in place.
    """
    first = rows.select(F.size(x).alias("i"), F.size(y).alias("o")).first()
    if first is None:
        return {}, []
    pairs = Stages(rows.sparkSession, "fit").keep(rows.select(F.col(x).cast("array<double>").alias("x"), F.col(y).cast("array<double>").alias("y")), "pairs")
    m = predictor.init(first["i"], hidden, first["o"], seed) if start is None else dict(start)
    follow = {} if target is None else target
    for k in m:
        follow.setdefault(k, m[k].copy())
    one, two, losses = {k: np.zeros_like(v) for k, v in m.items()}, {k: np.zeros_like(v) for k, v in m.items()}, []
    for t in range(1, steps + 1):
        flat, loss, n = _summed(pairs, m, parts)
        losses.append(loss / n + decay * sum(float(((m[k] - follow[k]) ** 2).mean()) for k in m))
        at, grads = 0, {}
        for k in m:
            grads[k] = flat[at : at + m[k].size].reshape(m[k].shape) / n + decay * 2 * (m[k] - follow[k]) / m[k].size
            at += m[k].size
        norm = np.sqrt(sum(float((g**2).sum()) for g in grads.values()))
        new = {}
        for k, g in grads.items():
            g = g / max(1.0, norm) + weight_decay * m[k]
            one[k], two[k] = 0.9 * one[k] + 0.1 * g, 0.999 * two[k] + 0.001 * g * g
            new[k] = m[k] - rate * (one[k] / (1 - 0.9**t)) / (np.sqrt(two[k] / (1 - 0.999**t)) + 1e-8)
        m = new
        for k in m:
            follow[k] = target_ema * follow[k] + (1 - target_ema) * m[k]
    return m, losses


GROUP = "group_id string, alpha array<double>, ctx_mu array<array<double>>, pred_success_ema array<double>, temperature double, unresolved_mass double, replay_tension_ema double, ambiguous_buffer array<string>, inflation array<double>"
#: What a group of the whole form has besides.
GROUP_MORE = "ctx_sigma_diag array<array<double>>, replay_alignment_ema double, ambiguous_ctx_buffer array<array<double>>"


def update_groups(groups: DataFrame, traces: DataFrame, observations: DataFrame) -> DataFrame:
    """Groups folded over their observations (group_id, x, c, ts, seq, anchor_id; loss if there is one) in order, and each
    member's inflation.

    groups has member_ids, alpha, ctx_mu, ctx_sigma (one variance), pred_success_ema, temperature, unresolved_mass,
    replay_tension_ema, ambiguous_buffer; or, in the whole form, ctx_sigma_diag, replay_alignment_ema and
    ambiguous_ctx_buffer, which then come back too. Members' means and variances are those at batch start; a member that
    is gone keeps its place and has no mass. A group of more observations than ordered.CHUNK is folded in chunks.
    """
    whole = "ctx_sigma_diag" in groups.columns
    schema = f"{GROUP}, {GROUP_MORE}" if whole else GROUP
    columns = [c.split()[0] for c in schema.split(", ")]
    more = [c.split()[0] for c in GROUP_MORE.split(", ")] if whole else ["ctx_sigma"]
    names = ["group_id", "alpha", "ctx_mu", "pred_success_ema", "temperature", "unresolved_mass", "replay_tension_ema", "ambiguous_buffer", *more]
    member = groups.select("group_id", F.posexplode("member_ids").alias("i", "trace_id")).join(traces.select("trace_id", "z_mu", "z_sigma_diag"), "trace_id")
    held = member.groupBy("group_id").agg(F.array_sort(F.collect_list(F.struct("i", "z_mu", "z_sigma_diag"))).alias("m"))
    left = groups.select(*names).join(held.select("group_id", F.col("m.i").alias("at"), F.col("m.z_mu").alias("mu"), F.col("m.z_sigma_diag").alias("var")), "group_id")
    left = left.withColumn("inflation", F.transform(F.slice("alpha", F.lit(1), F.size("alpha") - 1), lambda _: F.lit(1.0)))
    held_columns = left.columns

    def run(key: tuple, g: pd.DataFrame, steps: pd.DataFrame) -> pd.DataFrame:
        if not len(g):
            return pd.DataFrame(columns=held_columns)
        r = g.iloc[0]
        at, mu, var = np.asarray(r["at"]), np.stack(list(r["mu"])), np.stack(list(r["var"]))
        slots = np.append(at, len(r["alpha"]) - 1)  # live members and the null slot
        take = lambda c: np.stack(list(r[c])).astype(float)[slots]
        state = {n: np.asarray(r[n], dtype=np.float64)[slots] for n in ("alpha", "pred_success_ema")} | {n: float(r[n]) for n in ("temperature", "unresolved_mass", "replay_tension_ema")}
        state |= {"ctx_mu": take("ctx_mu"), "ambiguous_buffer": list(r["ambiguous_buffer"])}
        state["ctx_sigma_diag"] = take("ctx_sigma_diag") if whole else np.full_like(state["ctx_mu"], r["ctx_sigma"])
        if whole:
            state |= {"replay_alignment_ema": float(r["replay_alignment_ema"]), "ambiguous_ctx_buffer": [list(v) for v in r["ambiguous_ctx_buffer"]]}
        inflation = np.asarray(r["inflation"], dtype=np.float64).copy()
        grown = inflation[at]
        for s in steps.sort_values(["ts", "seq"], kind="stable").to_dict("records"):
            loss = float(s["loss"]) if s.get("loss") is not None else None
            state, factor = folds.update_group(state, mu, var, np.asarray(s["x"], float), np.asarray(s["c"], float), s["anchor_id"], True, loss)
            grown = grown * factor

        def back(c: str, old) -> list:
            out = [list(v) if np.ndim(v) else float(v) for v in old]
            for i, v in zip(slots, np.asarray(state[c])):
                out[i] = v.tolist()
            return out

        inflation[at] = grown
        row = {c: r[c] for c in held_columns} | {"inflation": inflation.tolist(), **{c: state[c] for c in ("temperature", "unresolved_mass", "replay_tension_ema", "ambiguous_buffer")}, **{c: back(c, r[c]) for c in ("alpha", "ctx_mu", "pred_success_ema")}}
        if whole:
            row |= {"ctx_sigma_diag": back("ctx_sigma_diag", r["ctx_sigma_diag"]), "replay_alignment_ema": state["replay_alignment_ema"], "ambiguous_ctx_buffer": state["ambiguous_ctx_buffer"]}
        return pd.DataFrame([[row[c] for c in held_columns]], columns=held_columns)

    def fold(state: DataFrame, part: DataFrame) -> DataFrame:
        return spread(state, "group_id").groupBy("group_id").cogroup(spread(part, "group_id").groupBy("group_id")).applyInPandas(run, left.schema)

    return ordered.folded(left, observations, ["group_id"], ["ts", "seq"], fold).select(*columns)
