"""Reading: bias, edges and groups among candidates, the settled workspace, and its text."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mnemos.config import EPS, FIELD, FieldConfig
from mnemos.functions import costs
from mnemos.functions.vectors import cosine, gaussian_logpdf, norm, safe_variance, vsum
from mnemos.kernels import pairs
from mnemos.kernels.settle import SettleConfig, settle_many
from mnemos.operators import cells
from mnemos.operators.objective import posterior_slice
from mnemos.operators.retrieve import weighted_mean
from mnemos.sources.stages import spread

#: Numbers of the matrices of cues that are settled at a time, at most (but for a single cue).
SETTLED = 1 << 20

def cue_bias() -> Column:
    """Of a row with cue, frontier, predicted, context, session_id and a trace's columns (its session: trace_session)."""
    prior = F.log(F.col("evidence") + EPS) + 0.75 * F.col("stability") - 0.50 * F.col("uncertainty")
    near = cosine(F.col("cue"), F.col("z_mu")) + 0.35 * cosine(F.col("frontier"), F.col("z_mu")) + 0.25 * cosine(F.col("predicted"), F.col("z_mu"))
    ctx = gaussian_logpdf(F.col("context"), F.col("ctx_mu"), F.col("ctx_sigma_diag")) / F.greatest(F.size("ctx_mu"), F.lit(1))
    mine = F.when((F.col("session_id") != "") & (F.col("trace_session") == F.col("session_id")), 0.25).otherwise(0.0)
    return prior + near + 0.20 * ctx + 0.10 * costs.structural_role_mass() + 0.08 * F.col("fidelity") + mine


def all_biases(cues: DataFrame, traces: DataFrame) -> DataFrame:
    """(cue_id, trace_id, bias): cue_bias() of every pair of a cue with a session and a trace of that session.

    cues: cue_id, session_id, cue, frontier, predicted, context. The pairs are the result; they are made cell by cell and not
    moved.
    """
    kinds = [cues.schema["cue_id"].dataType.simpleString(), traces.schema["trace_id"].dataType.simpleString()]
    names = ("cue", "frontier", "predicted")

    def run(a: pa.Table, b: pa.Table) -> pa.Table:
        n, k = a.num_rows, b.num_rows
        out, there = np.zeros((n, k)), np.zeros((n, k), dtype=bool)
        if n and k:
            dots = [pairs.Dots(a[c], b["z_mu"]) for c in names]
            norms, size = [pairs.numbers(a[f"_{c}"]) for c in names], np.maximum(pairs.numbers(b["_size"]), 1)
            context = pairs.Gaussians(a["context"], b["ctx_mu"], b["ctx_sigma_diag"], pairs.numbers(b["_ctx_logs"]))
            prior, mu, mass, fidelity = (pairs.numbers(b[c]) for c in ("_prior", "_mu", "_mass", "fidelity"))
            known = ~(b["_prior"].combine_chunks().is_null().to_numpy(zero_copy_only=False) | b["fidelity"].combine_chunks().is_null().to_numpy(zero_copy_only=False))
            for at in pairs.tiles(n, k):
                found = [d(at) for d in dots]
                one, two, three = (pairs.cosine(d, m[at], mu) for (d, _), m in zip(found, norms))
                ctx, ok = context(at)
                out[at] = prior + (one + 0.35 * two + 0.25 * three) + 0.20 * (ctx / size) + 0.10 * mass + 0.08 * fidelity + 0.25
                there[at] = ok & known & np.logical_and.reduce([d for _, d in found])
        row, col = np.repeat(np.arange(n), k), np.tile(np.arange(k), n)
        return pa.table({"cue_id": a["cue_id"].combine_chunks().take(pa.array(row)), "trace_id": b["trace_id"].combine_chunks().take(pa.array(col)), "bias": pa.array(out.ravel(), mask=~there.ravel())})

    vector = lambda c: cells.whole(F.col(c)).alias(c)
    left = cues.where("session_id != ''").select(F.col("session_id").alias("_key"), "cue_id", *(vector(c) for c in (*names, "context")), *(norm(F.col(c)).alias(f"_{c}") for c in names))
    right = traces.select(
        F.col("session_id").alias("_key"), "trace_id", *(vector(c) for c in ("z_mu", "ctx_mu", "ctx_sigma_diag")), norm(F.col("z_mu")).alias("_mu"), F.size("ctx_mu").alias("_size"), "fidelity", costs.structural_role_mass().alias("_mass"),
        vsum(F.transform(safe_variance(F.col("ctx_sigma_diag")), lambda v: F.log(v))).alias("_ctx_logs"), (F.log(F.col("evidence") + EPS) + 0.75 * F.col("stability") - 0.50 * F.col("uncertainty")).alias("_prior"),
    )
    return cells.met(left, right, "cue_id", "trace_id", run, f"cue_id {kinds[0]}, trace_id {kinds[1]}, bias double", cells.PAIRS)


def candidate_edges(candidates: DataFrame, edges: DataFrame) -> DataFrame:
    """(cue_id, target, source, sign, weight) among a cue's candidates: inhib and assoc both ways, rows normalised, and
    each cue's operator under the norm cap of 0.95."""
    inside = edges.select("src", "dst", "kind", F.greatest("weight", F.lit(0.0)).alias("w")).join(candidates.select("cue_id", F.col("trace_id").alias("src")), "src").join(candidates.select("cue_id", F.col("trace_id").alias("dst")), ["cue_id", "dst"])
    one = F.struct(F.col("dst").alias("target"), F.col("src").alias("source"))
    other = F.struct(F.col("src").alias("target"), F.col("dst").alias("source"))
    ways = F.explode(F.when(F.col("kind").isin("inhib", "assoc"), F.array(one, other)).otherwise(F.array(one)))
    sums = inside.select("cue_id", F.when(F.col("kind") == "inhib", -1).otherwise(1).alias("sign"), "w", ways.alias("e")).groupBy("cue_id", "sign", "e.target", "e.source").agg(F.sum("w").alias("w"))
    row = sums.withColumn("w", F.col("w") / F.greatest(F.sum("w").over(Window.partitionBy("cue_id", "sign", "target")), F.lit(1.0)))
    row = row.withColumn("_row", F.sum("w").over(Window.partitionBy("cue_id", "sign", "target")))
    most = F.max("_row").over(Window.partitionBy("cue_id", "sign"))
    return row.withColumn("weight", F.col("w") * F.when(most > 0.95, 0.95 / most).otherwise(1.0)).select("cue_id", "target", "source", "sign", "weight")


def relevant_groups(candidates: DataFrame, groups: DataFrame) -> DataFrame:
    """(cue_id, group_id, present): groups with two members or more among a cue's candidates."""
    member = groups.select("group_id", F.explode("member_ids").alias("trace_id"))
    return candidates.select("cue_id", "trace_id").join(member, "trace_id").groupBy("cue_id", "group_id").agg(F.array_sort(F.collect_set("trace_id")).alias("present")).where(F.size("present") >= 2)


def settle_workspaces(nested: DataFrame, config: SettleConfig = SettleConfig()) -> DataFrame:
    """nested: a row for each cue with candidates (array of struct<trace_id, bias>, ranked), edges (array of struct<src,
    dst, kind, weight>) and groups (array of struct<ids, probs>). Gives active_ids, weights, iterations, energy and
    group_kl. A column `size` (int) is the number of traces that a cue's workspace holds at most. Cues are independent;
    they are dealt evenly, as settling takes longer than moving them, and those of as many candidates are settled together."""
    sized = "size" in nested.columns

    def settled(b: pa.RecordBatch, n: int, rows: np.ndarray, flat: dict) -> Iterator[tuple[int, list[str], list[float], int, float, float]]:
        """Cues of n candidates each, all at a time."""
        bias = flat["bias"][flat["at"][rows][:, None] + np.arange(n)]
        edges, weight, groups = [], [], []
        for k, i in enumerate(rows.tolist()):
            s, e = flat["at"][i], flat["edge_at"][i : i + 2]
            place = dict(zip(flat["ids"][s : s + n], range(n)))
            for j in range(*e.tolist()):
                src, dst, kind = place.get(flat["src"][j]), place.get(flat["dst"][j]), flat["kind"][j]
                if src is not None and dst is not None:
                    edges.append((k, src, dst, kind == "inhib", kind in ("inhib", "assoc")))
                    weight.append(flat["weight"][j])
            groups.append([([place[t] for t in g["ids"]], np.asarray(g["probs"], dtype=np.float64)) for g in flat["groups"][i] or []])
        active = b.column(4).to_numpy()[rows] if sized else None
        a, steps, energy, kl = settle_many(bias, np.array(edges, dtype=np.int64).reshape(-1, 5), np.array(weight, dtype=np.float64), groups, active, config)
        for k, i in enumerate(rows.tolist()):
            there, s = np.flatnonzero(a[k] > 0), flat["at"][i]
            yield i, [flat["ids"][s + j] for j in there.tolist()], a[k, there].tolist(), int(steps[k]), float(energy[k]), float(kl[k])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, kinds = ("cue_id", "active_ids", "weights", "iterations", "energy", "group_kl"), (pa.string(), pa.list_(pa.string()), pa.list_(pa.float64()), pa.int32(), pa.float64(), pa.float64())
        starts = lambda c: np.concatenate([[0], np.cumsum(c.value_lengths().fill_null(0).to_numpy())]).astype(np.int64)
        for b in batches:
            candidates, edges = b.column(1).flatten(), b.column(2).flatten()
            if candidates.field("bias").null_count:
                raise ValueError("a candidate has no bias")
            flat = {"at": starts(b.column(1)), "edge_at": starts(b.column(2)), "ids": candidates.field("trace_id").to_pylist(), "bias": candidates.field("bias").to_numpy(zero_copy_only=False).astype(np.float64), "groups": b.column(3).to_pylist()}
            flat |= {c: edges.field(c).to_pylist() for c in ("src", "dst", "kind", "weight")}
            sizes = np.diff(flat["at"])
            found = {i: (i, [], [], 0, 0.0, 0.0) for i in np.flatnonzero(sizes == 0).tolist()}
            for n in np.unique(sizes[sizes > 0]).tolist():
                rows = np.flatnonzero(sizes == n)
                for part in np.array_split(rows, -(-len(rows) * n * n // SETTLED)):
                    found |= {r[0]: r for r in settled(b, n, part, flat)}
            out = [found[i] for i in range(b.num_rows)]
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array([r[k] for r in out], t) for k, t in enumerate(kinds) if k)], names=names)

    rows = nested.select(F.col("cue_id").cast("string").alias("cue_id"), "candidates", "edges", "groups", *(["size"] if sized else []))
    return spread(rows, "cue_id").mapInArrow(run, "cue_id string, active_ids array<string>, weights array<double>, iterations int, energy double, group_kl double")


def cue_groups(cues: DataFrame, scored: DataFrame, groups: DataFrame, traces: DataFrame) -> DataFrame:
    """(cue_id, groups): the groups with two members or more among a cue's candidates, each with those members and their
    probabilities at the cue (array of struct<ids, probs>), by the best rank of a member.

    cues has cue_id, z, context. Members outside of the candidates take their share of the slice and are left out then.
    """
    held = relevant_groups(scored, groups)
    sigma = groups if "ctx_sigma" in groups.columns else groups.withColumn("ctx_sigma", F.col("ctx_sigma_diag")[0][0])
    seen = held.select("cue_id", "group_id").join(cues.select("cue_id", F.col("z").alias("x"), F.col("context").alias("c")), "cue_id")
    slices = posterior_slice(sigma, traces, seen.select(F.col("cue_id").alias("obs_id"), "group_id", "x", "c"))
    rows = slices.select(F.col("obs_id").alias("cue_id"), "group_id", "slot", F.col("member_id").alias("trace_id"), "prob").join(scored.select("cue_id", "trace_id", "rank"), ["cue_id", "trace_id"])
    one = rows.groupBy("cue_id", "group_id").agg(F.array_sort(F.collect_list(F.struct("slot", "trace_id", "prob"))).alias("m"), F.min("rank").alias("rank"))
    pick = lambda f: F.transform("m", lambda s: s[f])
    every = one.groupBy("cue_id").agg(F.array_sort(F.collect_list(F.struct("rank", "group_id", pick("trace_id").alias("ids"), pick("prob").alias("probs")))).alias("g"))
    return every.select("cue_id", F.transform("g", lambda s: F.struct(s["ids"].alias("ids"), s["probs"].alias("probs"))).alias("groups"))


def nest_cues(scored: DataFrame, edges: DataFrame, groups: DataFrame | None = None) -> DataFrame:
    """The nested rows of settle_workspaces from scored (cue_id, trace_id, rank, bias), the edge table and cue_groups.

    A cue has at most 64 candidates, so its rows, the edges among them and their groups are bounded.
    """
    best = scored.groupBy("cue_id").agg(F.array_sort(F.collect_list(F.struct("rank", "trace_id", "bias"))).alias("c"))
    # few bytes of edges meet many cues: dealt by their source, so that it isn't one task's work
    inside = spread(edges.select("src", "dst", "kind", "weight"), "src").join(scored.select("cue_id", F.col("trace_id").alias("src")), "src").join(scored.select("cue_id", F.col("trace_id").alias("dst")), ["cue_id", "dst"])
    links = inside.groupBy("cue_id").agg(F.array_sort(F.collect_list(F.struct("src", "dst", "kind", "weight"))).alias("edges"))
    out = best.join(links, "cue_id", "left").select("cue_id", F.transform("c", lambda s: F.struct(s["trace_id"].alias("trace_id"), s["bias"].alias("bias"))).alias("candidates"), "edges")
    if groups is not None:
        return out.join(groups, "cue_id", "left")
    return out.withColumn("groups", F.array().cast("array<struct<ids:array<string>,probs:array<double>>>"))


def describe_workspaces(settled: DataFrame, traces: DataFrame, config: FieldConfig = FIELD) -> DataFrame:
    """settled with procedures (active traces of that role), anchor_refs (their reservoirs, in order) and summary (their mean
    by weight); a workspace of nothing has empty ones."""
    each = settled.select("cue_id", F.posexplode(F.arrays_zip("active_ids", "weights")).alias("i", "a")).select("cue_id", "i", F.col("a.active_ids").alias("trace_id"), F.col("a.weights").alias("w"))
    known = each.join(traces.select("trace_id", "z_mu", "anchor_reservoir", (costs.role("role_logits", costs.PROCEDURE) >= config.active_role_threshold).alias("_p")), "trace_id")
    one = known.groupBy("cue_id").agg(F.array_sort(F.collect_list(F.struct("i", "trace_id", "_p", "anchor_reservoir"))).alias("a"))
    mean = weighted_mean(known, ["cue_id"], "z_mu", "w").withColumnRenamed("vector", "summary")
    named = F.transform(F.filter("a", lambda s: s["_p"]), lambda s: s["trace_id"])
    refs = F.flatten(F.transform("a", lambda s: F.slice(s["anchor_reservoir"], F.greatest(F.size(s["anchor_reservoir"]) - config.reservoir_size + 1, F.lit(1)), config.reservoir_size)))
    none = F.array().cast("array<string>")
    found = one.select("cue_id", named.alias("procedures"), refs.alias("anchor_refs")).join(mean, "cue_id", "left")
    return settled.join(found, "cue_id", "left").withColumns({"procedures": F.coalesce("procedures", none), "anchor_refs": F.coalesce("anchor_refs", none), "summary": F.coalesce("summary", F.array().cast("array<double>"))})


def to_payload(columns: tuple[str, ...] = ("active_ids", "weights", "procedures", "anchor_refs", "summary", "iterations", "energy", "group_kl")) -> Column:
    """A described workspace as JSON text, arrays kept nested."""
    return F.to_json(F.struct(*columns))


def _section(title: str, entries: Column) -> Column:
    lines = F.array_join(F.transform(entries, lambda e: F.concat(F.lit("- "), e)), "\n")
    return F.concat(F.lit(f"{title}:\n"), F.when(F.size(entries) > 0, lines).otherwise("- none"))


def render_workspace(active: str = "active_ids", weights: str = "weights", hypotheses: Column | None = None, procedures: Column | None = None, provenance: Column | None = None) -> Column:
    """Five ordered sections as text; weights with four decimals; a section of nothing says "- none"."""
    none = F.array().cast("array<string>")
    named = lambda a: F.transform(a, lambda t: F.concat(F.lit("trace:"), t))
    ongoing = F.zip_with(active, weights, lambda t, w: F.format_string("trace:%s weight=%.4f", t, w))
    parts = [("ongoing_context", ongoing), ("salient_episodes", named(F.slice(active, 1, 8))), ("active_hypotheses", none if hypotheses is None else hypotheses), ("relevant_procedures", none if procedures is None else named(procedures)), ("provenance_anchors", none if provenance is None else provenance)]
    return F.concat_ws("\n", *(_section(t, e) for t, e in parts))


def build_prompts(system: str, workspace: Column, cue: Column) -> Column:
    """Messages (role, content): the system prompt with the workspace, then the cue."""
    head = F.concat(F.lit(system.rstrip() + "\n\n"), F.trim(workspace))
    return F.array(F.struct(F.lit("system").alias("role"), head.alias("content")), F.struct(F.lit("user").alias("role"), cue.alias("content")))


def clean_response(raw: Column) -> Column:
    """Trimmed, without a surrounding code fence; null where nothing is left (for the quarantine)."""
    text = F.regexp_replace(raw, r"^\s+|\s+$", "")
    inner = F.regexp_replace(text, r"(?s)^[^\n]*\n", "")
    bare = F.regexp_replace(F.when(F.locate("```", inner) > 0, F.regexp_replace(inner, r"(?s)```(?!.*```).*$", "")).otherwise(inner), r"^\s+|\s+$", "")
    out = F.when(text.startswith("```"), bare).otherwise(text)
    return F.when(text != "", out)
