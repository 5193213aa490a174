"""Candidate retrieval for cues."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from mnemos.config import EPS, FIELD, FieldConfig
from mnemos.functions import costs
from mnemos.functions.vectors import norm, vdot
from mnemos.kernels import pairs
from mnemos.kernels.nearest import Nearest, by_width
from mnemos.operators import cells
from mnemos.sources.stages import Stages, spread

#: Bytes of vectors in a block of cues, and of traces: a cell of the grid holds one of each at a time.
BLOCK_BYTES = 32 << 20


def _blocks(rows: DataFrame, vector: str) -> int:
    """Into how many hash blocks of bounded bytes the rows fall."""
    size = rows.agg(F.sum(F.coalesce(F.size(vector), F.lit(0)) * 8 + 64)).first()[0] or 0
    return 1 + int(size) // BLOCK_BYTES


def session_scope(cues: DataFrame, traces: DataFrame) -> DataFrame:
    """Pairs (cue, trace) a cue may see: its own session's traces, or all where its session is empty.

    Both sides meet in cells of bounded blocks (see operators.cells), whatever the size of a session; cues without one are a
    stated query set, whose key all traces have. Every pair is a row, so there are as many rows as pairs.
    """
    left, right = _sessions(cues, traces.withColumn("trace_session", F.col("session_id")))
    at = ["_key", "_i", "_j"]
    a, b = cells.dealt(left, right.drop("session_id"), "cue_id", "trace_id", cells.PAIRS)
    return spread(a, *at).join(spread(b, *at), at).drop(*at)


def topk_similar(cues: DataFrame, traces: DataFrame, k: int = FIELD.candidate_size) -> DataFrame:
    """(cue_id, trace_id, score, rank): exact cosine top-k among all traces, ties by trace_id ascending.

    Both sides are dealt to a grid of blocks by key, nothing passes the driver: cell (i, j) gets block i of the cues and
    block j of the traces, multiplies them as matrices, and keeps k rows a cue, which a window merges. Blocks are of bounded
    bytes; the side of fewer bytes is copied the more. A null vector, and one whose score is no number, is like nothing;
    vectors meet those of their own width.
    """
    cues, traces = cues.select("cue_id", "z"), traces.select("trace_id", "z_mu")
    cue_type, trace_type = cues.schema["cue_id"].dataType.simpleString(), traces.schema["trace_id"].dataType.simpleString()
    wide = int(cues.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows, columns = _blocks(cues, "z"), _blocks(traces, "z_mu")
    rows = max(rows, wide // columns)  # cells enough to keep the tasks busy
    block = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = cues.select(block("cue_id", rows).alias("i"), every(columns).alias("j"), F.lit(0).alias("side"), "cue_id", F.lit(None).cast(trace_type).alias("trace_id"), F.col("z").cast("array<double>").alias("v"))
    right = traces.select(every(rows).alias("i"), block("trace_id", columns).alias("j"), F.lit(1), F.lit(None).cast(cue_type), "trace_id", F.col("z_mu").cast("array<double>"))
    dealt = left.union(right).repartition(rows * columns, "i", "j").sortWithinPartitions("i", "j", "side")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, held, best, ids = None, [], None, None

        def found() -> Iterator[pa.RecordBatch]:
            for at, traces_, score in best.rows() if best else ():
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(at)), traces_, pa.array(score)], names=["cue_id", "trace_id", "score"])

        for b in batches:
            keys = np.stack([b.column(c).to_numpy() for c in range(3)], axis=1)
            cuts = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1).tolist(), b.num_rows] if b.num_rows else []
            for s, e in zip(cuts, cuts[1:]):
                i, j, side = keys[s].tolist()
                part = b.slice(s, e - s)
                if (i, j) != cell:
                    yield from found()
                    cell, held, best = (i, j), [], None
                if side == 0:
                    held.append(part.select([3, 5]))
                elif held:
                    if best is None:  # the cell's cues are all there
                        known = pa.Table.from_batches(held)
                        ids, best = known.column(0).combine_chunks(), Nearest(by_width(known.column(1)), k)
                    best.add(part.column(4), part.column(5))
        yield from found()

    scored = dealt.mapInArrow(run, f"cue_id {cue_type}, trace_id {trace_type}, score double")
    w = Window.partitionBy("cue_id").orderBy(F.desc("score"), "trace_id")
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def expand_groups(candidates: DataFrame, groups: DataFrame, traces: DataFrame) -> DataFrame:
    """(cue_id, trace_id): the candidates and all live members of the groups they belong to."""
    member = groups.select("group_id", F.explode("member_ids").alias("trace_id"))
    other = member.withColumnRenamed("trace_id", "other")
    more = candidates.select("cue_id", "trace_id").join(member, "trace_id").join(other, "group_id").select("cue_id", F.col("other").alias("trace_id"))
    live = more.join(traces.select("trace_id"), "trace_id", "left_semi").select("cue_id", "trace_id")
    return candidates.select("cue_id", "trace_id").union(live).distinct()


def _sessions(cues: DataFrame, traces: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both sides with _key, under which a cue meets the traces that it may see (see session_scope)."""
    named = traces.where("session_id != ''").withColumn("_key", F.col("session_id"))
    return cues.where("session_id is not null").withColumn("_key", F.col("session_id")), named.unionByName(traces.withColumn("_key", F.lit("")))


def _scores() -> tuple[Column, Column]:
    """The blended and the final score of a pair with the cosines _latent and _ctx."""
    mine = F.when((F.col("session_id") != "") & (F.col("trace_session") == F.col("session_id")), 0.25).otherwise(0.0)
    blended = 0.65 * F.col("_latent") + 0.25 * F.col("_ctx") + 0.1 * F.col("evidence") + 0.1 * F.col("access_ema") - 0.05 * F.col("uncertainty") + mine
    final = 0.60 * F.col("_latent") + 0.20 * F.col("_ctx") + 0.15 * F.col("evidence") - 0.10 * F.col("uncertainty") + 0.05 * F.col("_mass") + mine
    return blended, final


def _seen_best(cues: DataFrame, traces: DataFrame, size: int) -> DataFrame:
    """(cue_id, trace_id, blended, final, by_blend): of each cell of a session's cues and traces the top by the blended score
    (by_blend), and the top by the final one of the traces that are candidates anyway (_always). A cell sends on 2 * size
    rows a cue for its first block of traces, and then only what is above the best so far."""

    def score(lat: np.ndarray, ctx: np.ndarray, evidence: np.ndarray, access: np.ndarray, unsure: np.ndarray, mass: np.ndarray, mine: float) -> tuple[np.ndarray, np.ndarray]:
        return 0.65 * lat + 0.25 * ctx + 0.1 * evidence + 0.1 * access - 0.05 * unsure + mine, 0.60 * lat + 0.20 * ctx + 0.15 * evidence - 0.10 * unsure + 0.05 * mass + mine

    def run(left: pa.Table, right: pa.Table, state: dict) -> pa.Table:
        if not right.num_rows:
            return empty
        names = ("evidence", "access_ema", "uncertainty", "_mass")
        latent, context = pairs.Dots(left["z"], right["z_mu"]), pairs.Dots(left["context"], right["ctx_mu"])
        norm_of = {c: pairs.numbers(t[c]) for t, c in ((left, "_nz"), (left, "_nc"), (right, "_nm"), (right, "_nx"))}
        number = {c: pairs.numbers(right[c]) for c in names}
        known = ~(right["evidence"].is_null().to_numpy() | right["uncertainty"].is_null().to_numpy())
        ranked = known & ~right["access_ema"].is_null().to_numpy()
        always = np.flatnonzero(right["_always"].combine_chunks().to_numpy(zero_copy_only=False).astype(bool))
        mine = 0.25 if left.num_rows and left["_key"][0].as_py() != "" else 0.0
        one = context.same(latent)  # the context is the vector itself

        def cosines(row: np.ndarray, col: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            dot = latent.of(row, col)
            return tuple(d / np.maximum(norm_of[n][row] * norm_of[m][col], EPS) for d, n, m in ((dot, "_nz", "_nm"), (dot if one else context.of(row, col), "_nc", "_nx")))

        def told(row: np.ndarray, col: np.ndarray, by_blend: bool) -> pa.Table:
            blended, final = score(*cosines(row, col), *(number[c][col] for c in names), mine)
            wide = (latent.a[row] == latent.b[col]) & (latent.a[row] >= 0) & (context.a[row] == context.b[col]) & (context.a[row] >= 0)
            return pa.table({
                "cue_id": left["cue_id"].combine_chunks().take(pa.array(row)), "trace_id": right["trace_id"].combine_chunks().take(pa.array(col)),
                "blended": pa.array(blended, mask=~(wide & ranked[col])), "final": pa.array(final, mask=~(wide & known[col])), "by_blend": pa.array(np.full(len(row), by_blend)),
            })

        sides = ((latent, "_nz", "_nm", 0.65, 0.60), (context, "_nc", "_nx", 0.25, 0.20))
        held = "tops" in state or right.num_rows > size
        if held and ranked.all() and all(np.isfinite(v).all() for v in number.values()) and all(pairs.plain((d.x, d.a), norm_of[n]) and pairs.plain((d.y.T, d.b), norm_of[m]) and d.a[0] == d.b[0] for d, n, m, *_ in sides):
            # both scores are matrix products and a number for each trace; what may be among the best is scored anew
            sides = ((*sides[0][:3], 0.90, 0.80),) if one else sides
            single = lambda vectors: np.concatenate(vectors, axis=1).astype(np.float32)
            x = [single([w[k] * pairs.unit(d.x, norm_of[n]) for d, n, _, *w in sides]) for k in (0, 1)]
            y = single([pairs.unit(d.y.T, norm_of[m]) for d, _, m, *_ in sides])
            rest = [v.astype(np.float32) for v in score(0.0, 0.0, *(number[c] for c in names), mine)]
            tops = state.setdefault("tops", [pairs.Tops(left.num_rows, size, y.shape[1]) for _ in range(2)])
            out = [told(*tops[0].add(x[0] @ y.T + rest[0]), True)]
            if len(always):
                row, col = tops[1].add(x[1] @ y[always].T + rest[1][always])
                out.append(told(row, always[col], False))
            return pa.concat_tables(out)
        place, out = pairs.order_of(right["trace_id"]), []
        for at in pairs.tiles(left.num_rows, right.num_rows):
            (lat, a), (ctx, b) = latent(at), context(at)
            lat, ctx, there = pairs.cosine(lat, norm_of["_nz"][at], norm_of["_nm"]), pairs.cosine(ctx, norm_of["_nc"][at], norm_of["_nx"]), a & b
            blended, final = score(lat, ctx, *(number[c] for c in names), mine)
            row, col = pairs.best(blended, there & ranked, place, size)
            out.append(told(row + at.start, col, True))
            if len(always):
                row, col = pairs.best(final[:, always], (there & known)[:, always], place[always], size)
                out.append(told(row + at.start, always[col], False))
        return pa.concat_tables(out) if out else empty

    kinds = {c: df.schema[c].dataType for df, c in ((cues, "cue_id"), (traces, "trace_id"))}
    empty = pa.schema([(c, to_arrow_type(t)) for c, t in kinds.items()] + [("blended", pa.float64()), ("final", pa.float64()), ("by_blend", pa.bool_())]).empty_table()
    vector = lambda c: cells.whole(F.col(c)).alias(c)
    left, right = _sessions(cues.select("cue_id", "session_id", vector("z"), vector("context"), "_nz", "_nc"), traces.select("trace_id", "session_id", vector("z_mu"), vector("ctx_mu"), "evidence", "access_ema", "uncertainty", "_mass", "_nm", "_nx", "_always", "_always_free"))
    right = right.withColumn("_always", F.when(F.col("_key") == "", F.col("_always_free")).otherwise(F.col("_always"))).drop("_always_free")
    schema = ", ".join([*(f"{c} {t.simpleString()}" for c, t in kinds.items()), "blended double, final double, by_blend boolean"])
    return cells.met(left.drop("session_id"), right.drop("session_id"), "cue_id", "trace_id", run, schema, remembers=True)


def make_candidates(cues: DataFrame, traces: DataFrame, size: int = FIELD.candidate_size, active: DataFrame | None = None, edges: DataFrame | None = None, groups: DataFrame | None = None, config: FieldConfig = FIELD) -> DataFrame:
    """(cue_id, trace_id, score, rank): the candidates of each cue, ties by trace_id descending.

    Sources: active (cue_id, trace_id: workspace and frontier) and their neighbours, the top by cosine, the top by a
    blended score, structural traces; then their groups. All are rescored; the top `size` stay. cues has cue_id,
    session_id, z, context.

    Pairs live in cells only (see _seen_best). A cue that may see `size` traces at most has them all by the blended score, so
    the other sources are asked for the cues that may see more.
    """
    cues = cues.select("cue_id", "session_id", "z", "context")
    # norms are made once a row, not once a pair
    own = cues.withColumns({"_nz": norm(F.col("z")), "_nc": norm(F.col("context"))})
    known = traces.select("trace_id", "session_id", "z_mu", "ctx_mu", "evidence", "access_ema", "uncertainty", costs.structural_role_mass().alias("_mass")).withColumns({"_nm": norm(F.col("z_mu")), "_nx": norm(F.col("ctx_mu"))})
    always = F.coalesce(F.col("_mass") >= config.active_role_threshold, F.lit(False))
    if groups is None:
        held = known.withColumns({"_always": always, "_always_free": always})
    else:
        # who shares a group with a structural trace is a candidate of all that see both: those of one session, and ''
        member = groups.select("group_id", F.explode("member_ids").alias("trace_id")).join(known.select("trace_id", "session_id", always.alias("_s")), "trace_id")
        near = member.where("_s").select("group_id", F.col("session_id").alias("_of")).distinct()
        mates = member.join(near, "group_id").groupBy("trace_id").agg(F.max(F.coalesce(F.col("_of") == F.col("session_id"), F.lit(False))).alias("_mate"))
        held = known.join(mates, "trace_id", "left").withColumns({"_always": always | F.coalesce("_mate", F.lit(False)), "_always_free": always | F.col("_mate").isNotNull()}).drop("_mate")
    best = _seen_best(own, held, size)
    # written once: several steps read it, and pairs are dear
    of_kind = Window.partitionBy("cue_id", "by_blend").orderBy(F.desc(F.when(F.col("by_blend"), F.col("blended")).otherwise(F.col("final"))), F.desc("trace_id"))
    best = best.withColumn("_r", F.row_number().over(of_kind)).where(F.col("_r") <= size).select("cue_id", "trace_id", "final", "by_blend")
    best = Stages(cues.sparkSession, "near").keep(best, "best")
    blend, out = best.where("by_blend"), best.select("cue_id", "trace_id", "final")

    left, right = _sessions(cues.select("cue_id", "session_id"), traces.select("trace_id", "session_id"))
    wide = right.groupBy("_key").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > size).select("_key")
    asked = left.join(wide, "_key", "left_semi").select("cue_id")
    if not asked.isEmpty():
        asking = cues.join(asked, "cue_id", "left_semi")
        picked = topk_similar(asking, traces, size).select("cue_id", "trace_id")
        if active is not None:
            active = active.select("cue_id", "trace_id").join(asked, "cue_id", "left_semi")
            picked = picked.union(active)
            if edges is not None:
                both = edges.select(F.col("src").alias("trace_id"), F.col("dst").alias("o")).union(edges.select("dst", "src"))
                picked = picked.union(active.join(both, "trace_id").select("cue_id", F.col("o").alias("trace_id")))
        if groups is not None:
            # the structural traces' groups are in already
            picked = expand_groups(picked.union(blend.select("cue_id", "trace_id").join(asked, "cue_id", "left_semi")).distinct(), groups, traces)
        scored = picked.distinct().join(own, "cue_id").join(known.withColumnRenamed("session_id", "trace_session"), "trace_id").where("session_id = '' or session_id = trace_session")
        cosine = lambda a, b, n, m: vdot(F.col(a), F.col(b)) / F.greatest(F.col(n) * F.col(m), F.lit(EPS))
        scored = scored.withColumns({"_latent": cosine("z", "z_mu", "_nz", "_nm"), "_ctx": cosine("context", "ctx_mu", "_nc", "_nx")})
        out = out.union(scored.select("cue_id", "trace_id", _scores()[1]))
    w = Window.partitionBy("cue_id").orderBy(F.desc("final"), F.desc("trace_id"))
    return out.dropDuplicates(["cue_id", "trace_id"]).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= size).select("cue_id", "trace_id", F.col("final").alias("score"), "rank")


def frontier_summary(frontier: DataFrame, traces: DataFrame, now: float, sessions: DataFrame | None = None, latest: DataFrame | None = None, dim: int = FIELD.latent_dim) -> DataFrame:
    """(session_id, vector): traces of a frontier by weight * exp(-age / 10) * (1 + uncertainty).

    With sessions (session_id) a row for each of them: one without a frontier, and the empty one, takes the summary of
    `latest` (trace_id, weight: the frontier of the last workspace of all), or zeros where that has no live trace either. A
    frontier whose traces are all gone gives zeros.
    """

    def summed(rows: DataFrame) -> DataFrame:
        age = F.greatest(F.lit(now) - F.col("last_access_ts"), F.lit(0.0))
        live = rows.join(traces.select("trace_id", "z_mu", "last_access_ts", "uncertainty"), "trace_id").withColumn("w", F.col("weight") * F.exp(-age / 10.0) * (1.0 + F.col("uncertainty")))
        return weighted_mean(live, ["session_id"], "z_mu", "w")

    own = summed(frontier)
    if sessions is None:
        return own
    asked = sessions.select("session_id").distinct()
    known = frontier.where("session_id != ''").select("session_id", F.lit(True).alias("_known")).distinct()
    zeros = F.array_repeat(F.lit(0.0), dim)
    out = asked.join(known, "session_id", "left").join(own.where("session_id != ''").withColumnRenamed("vector", "_own"), "session_id", "left")
    if latest is None:
        return out.select("session_id", F.coalesce("_own", zeros).alias("vector"))
    # one row: the mean of at most frontier_size traces
    last = summed(latest.select(F.lit("").alias("session_id"), "trace_id", "weight")).agg(F.first("vector").alias("_last"))
    out = out.join(F.broadcast(last), F.lit(True), "left")
    return out.select("session_id", F.coalesce(F.when(F.col("_known"), F.coalesce("_own", zeros)).otherwise(F.col("_last")), zeros).alias("vector"))


def weighted_mean(rows: DataFrame, keys: list[str], vector: str, weight: str) -> DataFrame:
    """Grouped vector mean (column `vector`); the plain mean where the weights sum to 1e-8 at most.

    Positions are exploded and summed map-side, so a hot group sends one row a position and partition.
    """
    parts = rows.select(*keys, F.col(weight).alias("_w"), F.posexplode(vector).alias("_i", "_x"))
    sums = parts.groupBy(*keys, "_i").agg(F.sum(F.col("_w") * F.col("_x")).alias("_wx"), F.sum("_w").alias("_sw"), F.avg("_x").alias("_m"))
    value = F.when(F.col("_sw") <= 1e-8, F.col("_m")).otherwise(F.col("_wx") / F.col("_sw"))
    out = sums.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("_i", value.alias("_v")))).alias("_a"))
    return out.select(*keys, F.transform("_a", lambda s: s["_v"]).alias("vector"))
