"""A turn of many sessions at once: cues are injected, the state is kept up, read and answered, the answers are injected.

All that a turn makes are staged tables of its own. The state it starts from is never written to, and the new one is entered
as a snapshot by one rename at the end; so a turn that fails at any step, or in which one cue gets no answer, leaves nothing.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mnemos.config import BUDGET, FIELD, BudgetConfig, FieldConfig
from mnemos.functions.encode import encode_text
from mnemos.functions.vectors import make_context
from mnemos.operators import actions, cycle, folds, graph, ingest, maintenance, ordered, readout, replay, retrieve, upkeep
from mnemos.sources import snapshots
from mnemos.sources.stages import Stages

_NONE = "array<string>"


class TurnFailed(ValueError):
    """What a turn was given can't be taken as a whole; nothing of it was kept."""


@dataclass
class Turn:
    """The state after a turn, the workspaces that were read, prompts (cue_id, messages), answers (cue_id, payload) and links
    (cue_id, anchor_id, trace_id, part: of the cue or of its answer)."""

    state: dict[str, DataFrame]
    workspaces: DataFrame
    prompts: DataFrame
    answers: DataFrame
    links: DataFrame
    objective: DataFrame | None = None


def _nested(scored: DataFrame, cues: DataFrame, edges: DataFrame, groups: DataFrame, traces: DataFrame) -> DataFrame:
    return readout.nest_cues(scored, edges, readout.cue_groups(cues, scored, groups, traces))


def settled_cues(cues: DataFrame, state: dict[str, DataFrame], size: int = FIELD.candidate_size, active: DataFrame | None = None, config: FieldConfig = FIELD) -> DataFrame:
    """RD6: the described workspace of each cue, with edges and groups of the state.

    cues: cue_id, session_id, z, context; frontier and predicted if there are any (else the cue stands for them); `size`, how
    many traces its workspace holds at most. active: (cue_id, trace_id), what was active before, which are candidates too.
    """
    traces = state["traces"]
    near = retrieve.make_candidates(cues.select("cue_id", "session_id", "z", "context"), traces, size, active, state["edges"], state["groups"], config)
    named = cues.withColumn("cue", F.col("z")).withColumns({c: F.col(c) if c in cues.columns else F.col("z") for c in ("frontier", "predicted")})
    rows = near.select("cue_id", "trace_id", "rank").join(named.select("cue_id", "session_id", "cue", "context", "frontier", "predicted"), "cue_id").join(traces.withColumnRenamed("session_id", "trace_session"), "trace_id")
    scored = Stages(traces.sparkSession, "cues").keep(rows.select("cue_id", "trace_id", "rank", readout.cue_bias().alias("bias")), "scored")
    nested = cues.select("cue_id", *(["size"] if "size" in cues.columns else [])).join(_nested(scored, cues, state["edges"], state["groups"], traces), "cue_id", "left")
    return readout.describe_workspaces(readout.settle_workspaces(nested), traces, config)


def settled_frames(frames: DataFrame, state: dict[str, DataFrame], config: FieldConfig = FIELD) -> DataFrame:
    """(frame_id, trace_id, a, group_kl): frames of the log settled anew by the state as it is now.

    frames: frame_id, session_id, x, c, active_ids; frontier_vec and workspace_vec if the log holds them. A workspace holds as
    many traces as the frame had, workspace_size at most. state["active"] (trace_id) are candidates of their session's frames.
    """
    size = F.least(F.greatest(F.size("active_ids"), F.lit(1)), F.lit(config.workspace_size)).alias("size")
    seen = {"frontier": "frontier_vec", "predicted": "workspace_vec"}
    cues = frames.select(F.col("frame_id").alias("cue_id"), "session_id", F.col("x").alias("z"), F.col("c").alias("context"), size, *(F.col(v).alias(k) for k, v in seen.items() if v in frames.columns))
    active = None
    if "active" in state:
        own = state["active"].select("trace_id").join(state["traces"].select("trace_id", "session_id"), "trace_id")
        active = cues.select("cue_id", "session_id").join(own, "session_id").select("cue_id", "trace_id")
    out = settled_cues(cues, state, config.candidate_size, active, config)
    return out.select(F.col("cue_id").alias("frame_id"), F.explode(F.arrays_zip("active_ids", "weights")).alias("a"), "group_kl").select("frame_id", F.col("a.active_ids").alias("trace_id"), F.col("a.weights").alias("a"), "group_kl")


def _last_active(frames: DataFrame) -> DataFrame:
    """The last frame of each session: an aggregate, so a long session is combined before it moves."""
    last = F.max_by(F.struct("ts", "seq", "frame_id", "trace_id", "anchor_id", "active_ids", "activation"), F.struct("ts", "seq"))
    return frames.groupBy("session_id").agg(last.alias("l")).select("session_id", "l.*")


def anchored(events: DataFrame, encode: Callable[[Column], Column], stages: Stages, now: float | None = None, config: FieldConfig = FIELD) -> DataFrame:
    """Anchors of events, in packets, with their vectors. TurnFailed if one event is invalid."""
    valid, rejected = ingest.split_valid_rejected(stages.keep(ingest.normalize_events(events, now), "events"))
    bad = rejected.select("reason", "turn_id").limit(1).collect()
    if bad:
        raise TurnFailed(f"{bad[0]['turn_id']}: {bad[0]['reason']}")
    packets = ingest.packetize(valid, config.packet_chars)
    rows = packets.select("session_id", "ts", "turn_id", "source", F.concat(F.lit("anc_"), F.substring_index("packet_id", "_", -1)).alias("anchor_id"), "chunk_index", encode(F.col("payload")).alias("z"))
    return stages.keep(rows.dropDuplicates(["anchor_id"]), "anchors")


def inject_batch(state: dict[str, DataFrame], anchors: DataFrame, stages: Stages, now: float, config: FieldConfig = FIELD) -> tuple[dict[str, DataFrame], DataFrame]:
    """The state after a batch of anchors (anchor_id, session_id, ts, chunk_index, z), and the frames that it added.

    state: traces, edges, groups, frames, anchors. Every anchor is scored against the state at the start of the batch; what
    the decisions do to a trace, an edge or a group is folded in order (ts, seq). Nothing is predicted here, so the score has
    no target. What each step makes is one table, written once.
    """
    s = dict(state)
    dim = config.latent_dim
    last = stages.keep(_last_active(s["frames"]), "last")
    frontier = maintenance.update_frontier(last)
    newest = last.orderBy(F.desc("ts"), F.desc("seq"), "session_id").limit(1).select(F.explode("activation").alias("trace_id", "weight"))
    vectors = retrieve.frontier_summary(frontier, s["traces"], now, anchors.select("session_id"), newest, dim)
    place = ordered.ranked(anchors, ["session_id"], ["ts", "turn_id", "chunk_index", "anchor_id"], "_k")
    a = place.join(vectors, "session_id").join(last.select("session_id", F.col("seq").alias("_seq")), "session_id", "left")
    context = make_context(F.col("z"), F.col("vector"), F.array_repeat(F.lit(0.0), dim), dim, config)
    a = a.select("anchor_id", "session_id", "ts", (F.coalesce("_seq", F.lit(-1)) + 1 + F.col("_k")).cast("bigint").alias("seq"), F.col("z").alias("x"), context.alias("c"), F.col("vector").alias("frontier_vec"))
    a = stages.keep(a, "anchored")

    cues = a.select(F.col("anchor_id").alias("cue_id"), "session_id", F.col("x").alias("z"), F.col("c").alias("context"))
    active = cues.select("cue_id", "session_id").join(last.select("session_id", F.explode("active_ids").alias("trace_id")), "session_id").select("cue_id", "trace_id")
    near = retrieve.make_candidates(cues, s["traces"], config.candidate_size, active, s["edges"], s["groups"], config)
    pairs = stages.keep(near.select(F.col("cue_id").alias("anchor_id"), "trace_id", "rank"), "candidates")
    scored = actions.score_actions(actions.nest_patches(a.select("anchor_id", "x", "c"), pairs, s["traces"], None, s["edges"], s["groups"]), config)
    decided = a.join(scored, "anchor_id").withColumn("frame_id", F.concat(F.lit("frame_"), F.substring_index("anchor_id", "_", -1))).withColumn("loss", F.greatest("slow_alignment", F.lit(0.0)))
    decided = stages.keep(decided, "decided")

    born = stages.keep(replay.new_traces(decided, s["traces"], config), "born")
    before = s["traces"]
    moved = folds.apply_actions(before, decided.select("trace_id", "action", "x", "c", "ts", "seq", "anchor_id"), config).join(before.select("trace_id"), "trace_id", "left_semi")
    touched = decided.where("trace_id is not null").select("trace_id").distinct()
    s["traces"] = stages.keep(upkeep.replaced(before, moved.join(touched, "trace_id", "left_semi")).unionByName(born), "traces")

    child = born.select(F.col("spawned_from_frame").alias("frame_id"), F.col("trace_id").alias("_child"))
    rows = decided.join(child, "frame_id", "left").withColumn("trace_id", F.coalesce("_child", "trace_id")).drop("_child")
    apart = rows.where("inhibit_first is not null").select("seq", F.col("inhibit_first").alias("first"), F.col("inhibit_second").alias("second"), "x", "c", "ts", "anchor_id", "loss")
    apart = stages.keep(apart, "inhibit")
    if not apart.isEmpty():
        s["edges"], s["groups"] = upkeep.set_apart(apart, before, s["edges"], s["groups"], stages, config)
    member = s["groups"].select("group_id", F.explode("member_ids").alias("trace_id"))
    seen = stages.keep(rows.join(member, "trace_id").select("group_id", "x", "c", "ts", "seq", "anchor_id", "loss"), "group-steps")
    if not seen.isEmpty():
        new = folds.update_groups(s["groups"].join(seen.select("group_id").distinct(), "group_id", "left_semi"), s["traces"], seen)
        fresh = [c for c in new.columns if c in s["groups"].columns and c != "group_id"]
        held = s["groups"].join(new.select("group_id", F.struct(*fresh).alias("_new")), "group_id", "left")
        s["groups"] = stages.keep(held.select(*(F.when(F.col("_new").isNotNull(), F.col(f"_new.{c}")).otherwise(F.col(c)).alias(c) if c in fresh else F.col(c) for c in s["groups"].columns)), "groups")

    # the workspace after each anchor is settled by the state after the batch
    shown = settled_cues(cues.join(a.select(F.col("anchor_id").alias("cue_id"), F.col("frontier_vec").alias("frontier")), "cue_id"), s, config.candidate_size, None, config)
    empty = F.array().cast(_NONE)
    spaces = shown.select(F.col("cue_id").alias("anchor_id"), F.coalesce("active_ids", empty).alias("active_ids"), F.map_from_arrays(F.coalesce("active_ids", empty), F.coalesce("weights", F.array().cast("array<double>"))).alias("activation"))
    kinds = {f.name: f.dataType for f in s["frames"].schema}
    made = rows.join(spaces, "anchor_id").withColumns({"group_entropy": F.lit(0.0), "pred_loss": F.col("loss")})
    made = stages.keep(made.select(*((F.col(c) if c in made.columns else F.lit(None)).cast(t).alias(c) for c, t in kinds.items())), "frames")
    # a session's old last frame is linked to its first new one
    tail = last.select("session_id", "frame_id", "trace_id", "anchor_id", "ts", "seq").join(made.select("session_id").distinct(), "session_id", "left_semi")
    chain = graph.link_frames(tail.unionByName(made.select(*tail.columns)))
    steps = graph.temporal_deltas(chain).unionByName(graph.assoc_deltas(made.where("size(active_ids) > 1")))
    s["edges"] = stages.keep(upkeep.touch(s["edges"], stages.keep(steps, "touches"), stages), "edges")
    s["frames"] = stages.keep(relinked(s["frames"], made, chain), "log")
    s["anchors"] = stages.keep(s["anchors"].unionByName(a.select("anchor_id", F.col("x").alias("z")).join(s["anchors"], "anchor_id", "left_anti")), "all-anchors")
    return s, made


def relinked(frames: DataFrame, made: DataFrame, chain: DataFrame) -> DataFrame:
    """The log with the new frames, and what comes next put right for the frames of `chain`."""
    nexts = [c for c in ("next_trace_id", "next_ts", "next_anchor_id") if c in frames.columns]
    both = frames.unionByName(made)
    if not nexts:
        return both
    new = chain.select("frame_id", F.struct(*nexts).alias("_next"))
    joined = both.join(new, "frame_id", "left")
    return joined.select(*(F.when(F.col("_next").isNotNull(), F.col(f"_next.{c}")).otherwise(F.col(c)).alias(c) if c in nexts else F.col(c) for c in frames.columns))


def respond_turn(
    state: dict[str, DataFrame], cues: DataFrame, answer: Callable[[DataFrame], DataFrame], now: float, encode: Callable[[Column], Column] | None = None, path: str | None = None, step: int = 0,
    system: str = "Answer from the memory given.", batch: int = 10, budget: BudgetConfig = BUDGET, config: FieldConfig = FIELD, stages: Stages | None = None,
) -> Turn:
    """RD7: one turn of a batch of cues (cue_id, session_id, text, ts), each a user's event and a question.

    answer takes the prompts (cue_id, messages) and gives (cue_id, answer). TurnFailed if a cue is blank or named twice, if an
    answer is blank after cleaning, missing, or one too many; whatever else fails is raised as it is. With `path` the state
    after the turn is written there as version `step`. A failed turn writes no version, and its staged tables are removed;
    `state` is what it was in any case.
    """
    spark = state["traces"].sparkSession
    stages = stages or Stages(spark, "turn")
    try:
        return _turn(state, cues, answer, now, encode or (lambda c: encode_text(c, config.latent_dim)), path, step, system, batch, budget, config, stages)
    except Exception:
        snapshots.Folder(spark, stages.path).drop("")
        raise


def _turn(state, cues, answer, now, encode, path, step, system, batch, budget, config, stages) -> Turn:
    cues = stages.keep(cues.select(F.col("cue_id").cast("string").alias("cue_id"), F.coalesce("session_id", F.lit("")).alias("session_id"), "text", F.col("ts").cast("double").alias("ts")), "cues")
    twice = cues.groupBy("cue_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1 or cue_id is null").limit(1).collect()
    if twice:
        raise TurnFailed(f"cue {twice[0]['cue_id']} isn't one cue")
    said = cues.select("session_id", F.col("cue_id").alias("turn_id"), F.lit("user").alias("source"), F.lit("text").alias("payload_type"), F.col("text").alias("payload"), "ts")
    asked = anchored(said, encode, stages, now, config)
    s, heard = inject_batch(state, asked, stages, now, config)
    kept = upkeep.maintenance_cycle(s, now, batch, budget=budget, config=config, settle=lambda f, t: stages.keep(settled_frames(f, t, config), "resettled"), stages=stages)
    s = {k: kept.tables[k] for k in state}

    mine = asked.select("anchor_id", F.col("turn_id").alias("cue_id"), "chunk_index")
    first = mine.where("chunk_index = 0").join(heard.select("anchor_id", "session_id", "x", "c"), "anchor_id")
    shown = settled_cues(first.select("cue_id", "session_id", F.col("x").alias("z"), F.col("c").alias("context")), s, config.candidate_size, None, config)
    shown = stages.keep(shown, "workspaces")
    text = readout.render_workspace(procedures=F.col("procedures"), provenance=F.col("anchor_refs"))
    prompts = stages.keep(cues.join(shown, "cue_id").select("cue_id", readout.build_prompts(system, text, F.col("text")).alias("messages")), "prompts")

    given = stages.keep(answer(prompts).select(F.col("cue_id").cast("string").alias("cue_id"), readout.clean_response(F.col("answer")).alias("payload")), "answers")
    count = given.groupBy("cue_id").agg(F.count(F.lit(1)).alias("n"), F.min(F.coalesce(F.length("payload"), F.lit(0))).alias("chars"))
    bad = cues.select("cue_id", F.lit(True).alias("_asked")).join(count, "cue_id", "full_outer").where("_asked is null or n is null or n > 1 or chars = 0").orderBy("cue_id").limit(1).collect()
    if bad:
        raise TurnFailed(f"cue {bad[0]['cue_id']} has no answer, or more than one")
    events = cycle.respond_batch(cues, shown.select("cue_id", "active_ids", "weights"), given.withColumnRenamed("payload", "answer"), system)[1]
    named = cues.select("cue_id", cycle.response_id().alias("turn_id"))
    replies = anchored(events, encode, stages, now, config)
    s, told = inject_batch(s, replies, stages, now, config)
    link = lambda m, f, part: m.join(f.select("anchor_id", "trace_id"), "anchor_id").select("cue_id", "anchor_id", "trace_id", F.lit(part).alias("part"))
    back = replies.select("anchor_id", "turn_id", "session_id").join(named.join(cues.select("cue_id", "session_id"), "cue_id"), ["turn_id", "session_id"]).select("anchor_id", "cue_id")
    links = stages.keep(link(mine, heard, "cue").unionByName(link(back, told, "answer")), "links")
    if path is not None:
        snapshots.write_snapshot(s, path, step, "respond")
    return Turn(s, shown, prompts, given, links, kept.objective)
