"""Actions on a batch of anchors, scored against the state at batch start."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mnemos.config import FIELD, FieldConfig
from mnemos.functions import costs
from mnemos.kernels import actions as kernel
from mnemos.sources.stages import spread

DECISION = "anchor_id string, action string, trace_id string, objective double, base double, delta double, inhibit_first string, inhibit_second string, candidates int, slow_alignment double"
_VECTORS = ("z_mu", "z_sigma_diag", "ctx_mu", "ctx_sigma_diag")
_NUMBERS = ("evidence", "stability", "uncertainty", "pred_loss_ema", "fidelity", "_storage", "_fidelity", "_role", "_alignment", "_drift")


def _or(df: DataFrame, name: str, otherwise: Column) -> Column:
    return F.col(name) if name in df.columns else otherwise


def patch_edges(patches: DataFrame, edges: DataFrame) -> DataFrame:
    """(patch_id, edges, edge_cost, degrees): edges with an end in the patch, what they cost, and the sum of log1p of the
    degrees of its traces. patches: patch_id, trace_id.

    An edge with both ends inside is seen from either and counted once: it counts by half from each.
    """
    ends = edges.select("kind", F.col("src").alias("trace_id"), F.col("dst").alias("other")).union(edges.select("kind", "dst", "src").where("src != dst"))
    met = patches.select("patch_id", "trace_id").join(ends, "trace_id").join(patches.select("patch_id", F.col("trace_id").alias("other"), F.lit(1).alias("_in")), ["patch_id", "other"], "left")
    part = F.when(F.col("_in").isNotNull() & (F.col("other") != F.col("trace_id")), 0.5).otherwise(1.0)
    per = met.groupBy("patch_id", "trace_id").agg(F.count(F.lit(1)).alias("d"), F.sum(part).alias("n"), F.sum(part * costs.edge_storage_cost()).alias("cost"))
    return per.groupBy("patch_id").agg(F.sum("n").alias("edges"), F.sum("cost").alias("edge_cost"), F.sum(F.log1p("d")).alias("degrees"))


def patch_groups(patches: DataFrame, groups: DataFrame, traces: DataFrame) -> DataFrame:
    """(patch_id, group_count, group_cost, held): groups that a trace of the patch is in, what they cost, and for each its
    arrays with its members' means and variances (null where a member is gone)."""
    member = groups.select("group_id", F.posexplode("member_ids").alias("i", "trace_id"))
    touched = patches.select("patch_id", "trace_id").join(member.select("group_id", "trace_id"), "trace_id").select("patch_id", "group_id").distinct()
    needed = member.join(touched.select("group_id").distinct(), "group_id", "left_semi").join(traces.select("trace_id", "z_mu", "z_sigma_diag"), "trace_id", "left")
    members = needed.groupBy("group_id").agg(F.array_sort(F.collect_list(F.struct("i", "trace_id", "z_mu", "z_sigma_diag"))).alias("members"))
    sigma = F.col("ctx_sigma_diag") if "ctx_sigma_diag" in groups.columns else F.transform("ctx_mu", lambda m: F.transform(m, lambda _: F.col("ctx_sigma")))
    arrays = groups.select("group_id", "alpha", "ctx_mu", sigma.alias("ctx_var"), F.col("pred_success_ema").alias("success"), "temperature", costs.group_tension_cost().alias("tension"), costs.group_storage_cost().alias("cost"))
    whole = touched.join(arrays.join(members, "group_id"), "group_id")
    return whole.groupBy("patch_id").agg(F.count(F.lit(1)).alias("group_count"), F.sum("cost").alias("group_cost"), F.array_sort(F.collect_list(F.struct("group_id", "alpha", "ctx_mu", "ctx_var", "success", "temperature", "tension", "members"))).alias("held"))


def nest_patches(anchors: DataFrame, pairs: DataFrame, traces: DataFrame, observations: DataFrame | None = None, edges: DataFrame | None = None, groups: DataFrame | None = None) -> DataFrame:
    """One row for each anchor with its candidates, its observations, and what edges and groups charge, as columns.

    anchors: anchor_id, x, c; target and target_var (the prediction) and summary (the workspace's) if there are any. pairs:
    anchor_id, trace_id, and rank if the candidates have an order. observations: anchor_id, seq, x, c; target, target_var
    and weight if there are any. An anchor has 64 candidates and 12 observations at most, so its row is bounded; each input
    is joined once by its key and grouped once by anchor, and actions are never exploded into rows.
    """
    none = F.lit(None).cast("array<double>")
    cand = traces.select("trace_id", *_VECTORS, *_NUMBERS[:5], costs.storage_cost().alias("_storage"), costs.fidelity_cost().alias("_fidelity"), costs.role_cost().alias("_role"), costs.future_alignment_cost().alias("_alignment"), costs.future_drift_cost().alias("_drift"))
    rank = _or(pairs, "rank", F.lit(0)).alias("rank")
    held = pairs.select("anchor_id", "trace_id", rank).join(cand, "trace_id").groupBy("anchor_id").agg(F.array_sort(F.collect_list(F.struct("rank", "trace_id", *_VECTORS, *_NUMBERS))).alias("candidates"))
    out = anchors.select("anchor_id", "x", "c", _or(anchors, "target", none).alias("target"), _or(anchors, "target_var", none).alias("target_var"), _or(anchors, "summary", none).alias("summary")).join(held, "anchor_id", "left")
    if observations is not None:
        o = F.struct("seq", "x", "c", _or(observations, "target", none).alias("target"), _or(observations, "target_var", none).alias("target_var"), _or(observations, "weight", F.lit(1.0)).alias("weight"))
        out = out.join(observations.groupBy("anchor_id").agg(F.array_sort(F.collect_list(o)).alias("observations")), "anchor_id", "left")
    patches = pairs.select(F.col("anchor_id").alias("patch_id"), "trace_id").join(traces.select("trace_id"), "trace_id", "left_semi")
    if edges is not None:
        out = out.join(patch_edges(patches, edges).withColumnRenamed("patch_id", "anchor_id"), "anchor_id", "left")
    if groups is not None:
        out = out.join(patch_groups(patches, groups, traces).withColumnRenamed("patch_id", "anchor_id"), "anchor_id", "left")
    return out


def _rows(nested: pa.ListArray, field: str) -> np.ndarray:
    return nested.flatten().field(field).to_numpy(zero_copy_only=False).astype(float)


def _matrix(values: pa.ListArray) -> np.ndarray:
    flat = values.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(values), len(flat) // max(1, len(values)))


def _group(g: dict, place: dict[str, int], d: int) -> dict:
    members = g["members"]
    fill = lambda c: np.array([m[c] if m[c] is not None else [1.0] * d for m in members], dtype=float)
    return {
        "alpha": np.array(g["alpha"]), "ctx_mu": np.array(g["ctx_mu"]), "ctx_var": np.array(g["ctx_var"]), "success": np.array(g["success"]), "temperature": g["temperature"], "tension": g["tension"],
        "live": np.array([m["z_mu"] is not None for m in members]), "z": fill("z_mu"), "var": fill("z_sigma_diag"), "at": np.array([place.get(m["trace_id"], -1) for m in members]),
    }


def _patches(b: pa.RecordBatch) -> Iterator[tuple[str, list[str], kernel.Patch]]:
    """The patches of a batch; all candidates' vectors are one array, of which each patch is a slice."""
    names = b.schema.names
    ids, x, c = b.column(0).to_pylist(), _matrix(b.column(1)), _matrix(b.column(2))
    d = x.shape[1]
    cands = b.column(names.index("candidates"))
    at = cands.offsets.to_numpy() - (cands.offsets[0].as_py() if len(cands) else 0)
    sizes = np.where(cands.is_null().to_numpy(zero_copy_only=False), 0, np.diff(at))
    flat = cands.flatten()
    trace_ids = flat.field("trace_id").to_pylist()
    vectors = [_matrix(flat.field(v)) if len(flat) else np.zeros((0, d)) for v in _VECTORS]
    numbers = [_rows(cands, v) for v in _NUMBERS]
    start = np.concatenate([[0], np.cumsum(sizes)])
    optional = {k: b.column(names.index(k)).to_pylist() for k in ("target", "target_var", "summary", "observations", "edges", "edge_cost", "degrees", "group_count", "group_cost", "held") if k in names}
    get = lambda k, i: optional[k][i] if k in optional else None
    for i, anchor in enumerate(ids):
        s = slice(start[i], start[i + 1])
        own = {"x": x[i], "c": c[i], "target": get("target", i), "target_var": get("target_var", i), "weight": 1.0}
        seen = [own, *(get("observations", i) or [])]
        target = [o["target"] for o in seen]
        drift = float(np.mean((np.array(get("summary", i)) - np.array(own["target"])) ** 2)) if get("summary", i) is not None and own["target"] is not None else 0.0
        place = {t: k for k, t in enumerate(trace_ids[s])}
        yield anchor, trace_ids[s], kernel.Patch(
            *(v[s] for v in vectors), *(v[s] for v in numbers), x=np.array([o["x"] for o in seen], dtype=float), c=np.array([o["c"] for o in seen], dtype=float), weight=np.array([1.0 if o["weight"] is None else o["weight"] for o in seen]),
            target=np.array([np.zeros(d) if t is None else t for t in target], dtype=float), target_var=np.array([np.ones(d) if o["target_var"] is None else o["target_var"] for o in seen], dtype=float), has_target=np.array([t is not None for t in target]),
            extra_storage=(get("edge_cost", i) or 0.0) + (get("group_cost", i) or 0.0), extra_complexity=(get("degrees", i) or 0.0) + (get("group_count", i) or 0) + 0.05 * (get("edges", i) or 0.0), extra_drift=drift, groups=tuple(_group(g, place, d) for g in get("held", i) or []),
        )


def score_actions(nested: DataFrame, config: FieldConfig = FIELD) -> DataFrame:
    """The action of least objective for each row of nest_patches, the first of equals in the order BIRTH, then ASSIMILATE,
    ATTACH and SPLIT of each candidate. delta is against no action; without candidates it is BIRTH, whose base is 0.
    inhibit_first and inhibit_second: two traces that it would also set against each other."""
    names = [k.split()[0] for k in DECISION.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for anchor, ids, patch in _patches(b) if b.num_rows else ():
                s = kernel.Scores(patch, config)
                a = s.best()
                first, second = (ids[k] for k in s.pairs[a]) if s.pairs[a] else (None, None)
                base = s.base or 0.0
                kind = kernel.KINDS[(a - 1) % 3] if a else "BIRTH"
                out.append((anchor, kind, ids[(a - 1) // 3] if a else None, float(s.totals[a]), base, float(s.totals[a]) - base, first, second, len(ids), float(s.terms[a, 4])))
            yield pa.RecordBatch.from_pylist([dict(zip(names, r)) for r in out], schema=_schema())

    def _schema() -> pa.Schema:
        kinds = {"string": pa.string(), "double": pa.float64(), "int": pa.int32()}
        return pa.schema([(k.split()[0], kinds[k.split()[1]]) for k in DECISION.split(", ")])

    return spread(nested.withColumn("anchor_id", F.col("anchor_id").cast("string")), "anchor_id").mapInArrow(run, DECISION)
