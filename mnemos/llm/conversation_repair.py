"""Repair of conversation structure by iterative-deepening A*.

A conversation's rows are edited at least cost until the initials of their roles read `(s?(ua)+)?`: Keep costs 0, Rerole (to
the role that fits) 2, Delete 3, Insert (an empty turn) 2, and a truncated row that stays costs 1. Rows are searched in
blocks: a depth-first search tries edits in ASCII order (D, I, K, R) under a growing bound, cuts what forced costs rule
out, and keeps for each failed state the cost it is now known to need. The first path that is accepted under the least
bound is the cheapest, and the least in ASCII order of these. Blocks are stitched by their costs to go, from the last to
the first, so the choice in each is that of the whole.

Rows are dealt by range of (conversation, turn, role, text) with a tie-breaker, so a conversation of any length is spread
over tasks and no row of it is gathered: only what crosses a border between tasks (two conversations a task, or the pieces
of a long one) goes a second way, in which pieces exchange first occurrences, 4 x 4 costs and the states at their ends.

Edge cases: null roles and texts count as one space, a null conversation is one of its own; null turns come first; rows of
equal turn come by role, text; equal rows are duplicates; a role without initial (an empty one) can't be kept; an empty
table gives no rows; a conversation of which no row is present gives zeros, an empty audit and the hash of the empty
text; texts of any length are compared by 128 bits and streamed; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mnemos.llm.common import SPACES, materialise

KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 2, 3, 2, 1
NONE, BLANK, DUPLICATE, CUT = range(4)
INF = 1 << 40
#: States: nothing yet, after system, after user, after assistant. What each takes next, and the state after a role.
START, SYSTEM, USER, ASSISTANT = range(4)
WANTED = ("user", "user", "assistant", "user")
AFTER = {"s": SYSTEM, "u": USER, "a": ASSISTANT}
#: The cost, and the edits, by which a state at the end of a conversation becomes an accepted one.
AT_END, CLOSING = (0, 4, 2, 0), ("", "II", "I", "")
LEGAL = ("su", "ua", "au")
#: Rows of a search, and rows and characters of a slice of a piece that crosses a border.
BLOCK, SLICE_ROWS, SLICE_CHARS = 32, 1000, 1 << 20
_FORCED = (0, DELETE, DELETE, TRUNCATED)


def takes(state: int, initial: str) -> bool:
    return initial == "s" and state == START or initial != "" and initial == WANTED[state][0]


def search(rows: list[tuple[str, int]], start: int, ends: tuple[int, ...]) -> tuple[int, str, int]:
    """Cost, edits and last state of the cheapest way through rows of (initial, fault), the state after them costing `ends`.

    Edits end with the last row. `need` is the transposition table: costs that a state is known to need, of which the
    forced ones of the rows ahead are the first bound; a failed visit raises it.
    """
    n = len(rows)
    forced = [min(ends)] * (n + 1)
    for i in range(n - 1, -1, -1):
        forced[i] = forced[i + 1] + _FORCED[rows[i][1]]
    need: dict[tuple[int, int], int] = {}
    path: list[str] = []

    def visit(i: int, state: int, left: int) -> int:
        """Last state + 1, negated, if accepted within `left` (edits are then in path), else the cost needed."""
        if i == n:
            return -1 - state if ends[state] <= left else ends[state]
        known = need.get((i, state), forced[i])
        if known > left:
            return known
        initial, fault = rows[i]
        most = INF
        for edit in "DIKR" if fault in (NONE, CUT) else "DI":
            if edit == "D":
                cost, j, to = DELETE, i + 1, state
            elif edit == "I":
                cost, j, to = INSERT, i, AFTER[WANTED[state][0]]
            elif edit == "K":
                if not takes(state, initial):
                    continue
                cost, j, to = KEEP + (fault == CUT), i + 1, AFTER[initial]
            else:
                cost, j, to = REROLE + (fault == CUT), i + 1, AFTER[WANTED[state][0]]
            path.append(edit)
            found = visit(j, to, left - cost) if cost <= left else cost + (forced[j] if j < n else ends[to])
            if found < 0:
                return found
            path.pop()
            most = min(most, found + cost if cost <= left else found)
        need[i, state] = max(most, left + 1)
        return need[i, state]

    bound, enough = forced[0], DELETE * n + 2 * INSERT + max((e for e in ends if e < INF), default=0)
    while bound <= enough:  # beyond, no edits lead there
        found = visit(0, start, bound)
        if found < 0:
            return bound, "".join(path), -1 - found
        bound = found
    return INF, "", start


def plan(rows: list[tuple[str, int]], ends: tuple[int, ...] = AT_END, starts: tuple[int, ...] = (START,)) -> dict[int, tuple[int, str, int]]:
    """The cheapest way through any number of rows for each start, in blocks from the last to the first."""
    blocks = [rows[i : i + BLOCK] for i in range(0, len(rows), BLOCK)]
    ways: list[dict[int, tuple[int, str, int]]] = []
    for k in range(len(blocks) - 1, -1, -1):
        ways.append({s: search(blocks[k], s, ends) for s in (range(4) if k else starts)})
        ends = tuple(ways[-1].get(s, (INF,))[0] for s in range(4))
    ways.reverse()
    out = {}
    for s in starts:
        edits, state = [], s
        for way in ways:
            edits.append(way[state][1])
            state = way[state][2]
        out[s] = (ways[0][s][0] if ways else ends[s], "".join(edits), state)
    return out


def apply_edits(edits: str, roles: list[str], texts: list[str], state: int = START) -> tuple[list[tuple[str, str]], int]:
    """The repaired (role, text) turns and the state after them."""
    out, i = [], 0
    for e in edits:
        if e == "D":
            i += 1
            continue
        role, text = (WANTED[state], "") if e == "I" else (roles[i] if e == "K" else WANTED[state], texts[i])
        i += e != "I"
        out.append((role, text))
        state = AFTER[role[0]]
    return out, state


def fault_of(text: str) -> int:
    words = text.strip(SPACES)
    return BLANK if not words else NONE if words[-1] in ".!?" else CUT


def _key(role: str, text: str) -> bytes:
    return hashlib.blake2b(f"{len(role)}:{role}{text}".encode(), digest_size=16).digest()


class Tally:
    """What is counted along the rows of a conversation in order."""

    def __init__(self) -> None:
        self.faults = [0, 0, 0, 0]
        self.illegal = self.turns = 0
        self.least = self.last_turn = self.last_initial = None

    def add(self, turn: int | None, initial: str, fault: int) -> None:
        self.faults[fault] += 1
        self.illegal += self.last_initial is not None and self.last_initial + initial not in LEGAL
        self.last_initial = initial
        if turn is not None:
            self.turns += turn != self.last_turn
            self.least = turn if self.least is None else self.least
            self.last_turn = turn

    def columns(self) -> dict:
        gaps = 0 if self.least is None else self.last_turn - self.least + 1 - self.turns
        return {"gaps": gaps, "blank": self.faults[BLANK], "duplicate": self.faults[DUPLICATE], "truncated": self.faults[CUT], "illegal": self.illegal}


def _hash(turns: list[tuple[str, str]], digest, first: bool) -> bool:
    for role, text in turns:
        digest.update(f"{'' if first else chr(10)}{role}:{text}".encode())
        first = False
    return first


_SUMMARY = "gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint, audit string, repaired_sha256 string"
_SLICE = "part int, slice int, turns array<bigint>, roles array<string>, texts array<string>, faults array<int>, keys array<binary>"


def _schema(kind: str, texts: bool) -> str:
    return f"conv_id {kind}, {_SUMMARY}" + ", repaired string" * texts


def _whole(conv_id, rows: list[tuple], texts: bool) -> dict:
    """A conversation that lies in one task: rows of (turn, role, text, fault) in order."""
    tally = Tally()
    for turn, role, _, fault in rows:
        tally.add(turn, role[:1], fault)
    cost, edits, state = plan([(role[:1], fault) for _, role, _, fault in rows])[START]
    turns, _ = apply_edits(edits + CLOSING[state], [r[1] for r in rows], [r[2] for r in rows])
    joined = "\n".join(f"{role}:{text}" for role, text in turns)
    return {"conv_id": conv_id, **tally.columns(), "cost": cost, "audit": edits + CLOSING[state], "repaired_sha256": hashlib.sha256(joined.encode()).hexdigest()} | ({"repaired": joined} if texts else {})


def _runs(batches: Iterator[pa.RecordBatch], key: tuple[int, ...]) -> Iterator[tuple[tuple, Iterator[list]]]:
    """Consecutive rows of equal key columns; the rows of a run are read as they come."""
    rows = (list(r) for b in batches for r in zip(*(c.to_pylist() for c in b.columns)))
    row = next(rows, None)
    while row is not None:
        at, pending = tuple(row[i] for i in key), row

        def run() -> Iterator[list]:
            nonlocal pending, row
            while pending is not None and tuple(pending[i] for i in key) == at:
                yield pending
                pending = next(rows, None)
            row = pending

        held = run()
        yield at, held
        for _ in held:
            pass


def _settled(rows: Iterator[list]) -> Iterator[tuple]:
    """(turn, role, text, fault, key) of each present row of a run, faults as the run alone shows them."""
    seen: set[bytes] = set()
    for _, turn, role, text, copies in rows:
        for _ in range(copies):
            fault, key = fault_of(text), b""
            if fault != BLANK:
                key = _key(role, text)
                fault = DUPLICATE if key in seen else fault
                seen.add(key)
            yield turn, role, text, fault, key


def _first_way(kind: str, texts: bool, arrow_schema: pa.Schema):
    names = arrow_schema.names

    def batch(rows: list[dict]) -> pa.RecordBatch:
        return pa.RecordBatch.from_pylist([{c: r.get(c) for c in names} for r in rows], schema=arrow_schema)

    def sliced(conv_id, rows: Iterator[tuple], part: int) -> Iterator[dict]:
        held, chars, k = [], 0, 0
        for r in rows:
            held.append(r)
            chars += len(r[2])
            if len(held) >= SLICE_ROWS or chars >= SLICE_CHARS:
                yield _slice(conv_id, held, part, k)
                held, chars, k = [], 0, k + 1
        if held or not k:
            yield _slice(conv_id, held, part, k)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The first and the last conversation of a task may go on elsewhere and leave in slices; others are repaired."""
        part = TaskContext.get().partitionId()
        waiting, waiting_id, first, done = None, None, True, []
        for (conv_id,), rows in _runs(batches, (0,)):
            if waiting is not None:
                done.append(_whole(waiting_id, waiting, texts))
                waiting = None
            if first:
                first = False
                for s in sliced(conv_id, _settled(rows), part):
                    yield batch([s])
                continue
            # held until the next conversation shows that it isn't the last; a long one may be: it leaves in slices then
            held, rest = [], _settled(rows)
            for r in rest:
                held.append(r)
                if len(held) >= SLICE_ROWS:
                    break
            else:
                waiting, waiting_id = [r[:4] for r in held], conv_id
                keys = [r[4] for r in held]
                if len(done) >= 500:
                    yield batch(done)
                    done = []
                continue

            def chained(held=held, rest=rest):
                yield from held
                yield from rest

            for s in sliced(conv_id, chained(), part):
                yield batch([s])
        if waiting is not None:
            yield batch([_slice(waiting_id, [(*r, k) for r, k in zip(waiting, keys)], part, 0)])
        if done:
            yield batch(done)

    return run


def _slice(conv_id, rows: list[tuple], part: int, k: int) -> dict:
    turn, role, text, fault, key = zip(*rows) if rows else ((), (), (), (), ())
    return {"conv_id": conv_id, "part": part, "slice": k, "turns": list(turn), "roles": list(role), "texts": list(text), "faults": list(fault), "keys": list(key)}


def _faults(faults: list[int], late: list[int] | None) -> list[int]:
    for i in late or ():
        faults[i] = DUPLICATE
    return faults


def _costs(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    """(ck, part, costs): what it costs to go from each state through a piece to each state."""
    for (ck, part), slices in _runs(batches, (0, 1)):
        rows = [(role[:1], fault) for *_, roles, faults, late in slices for role, fault in zip(roles, _faults(faults, late))]
        ways = [plan(rows, tuple(0 if t == end else INF for t in range(4)), (0, 1, 2, 3)) for end in range(4)]
        yield {"ck": ck, "part": part, "costs": [ways[t][s][0] for s in range(4) for t in range(4)]}


def _ends(pieces: pd.DataFrame) -> pd.DataFrame:
    """The costs to go at the end of each piece of a conversation: 16 numbers a piece, a piece a task at most."""
    pieces = pieces.sort_values("part")
    go, out = np.array(AT_END), []
    for costs in reversed(pieces["costs"].tolist()):
        out.append(go.tolist())
        go = np.minimum(INF, (np.array(costs).reshape(4, 4) + go).min(axis=1))
    return pd.DataFrame({"ck": pieces["ck"], "part": pieces["part"], "ends": out[::-1]})


def _ways(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    """(ck, part, costs, audits, exits) of a piece for each state before it, given the costs to go after it."""
    for (ck, part), slices in _runs(batches, (0, 1)):
        rows, ends = [], None
        for *_, roles, faults, late, ends in slices:
            rows += [(role[:1], fault) for role, fault in zip(roles, _faults(faults, late))]
        ways = plan(rows, tuple(ends), (0, 1, 2, 3))
        yield {"ck": ck, "part": part, "costs": [ways[s][0] for s in range(4)], "audits": [ways[s][1] for s in range(4)], "exits": [ways[s][2] for s in range(4)]}


def _entries(pieces: pd.DataFrame) -> pd.DataFrame:
    pieces = pieces.sort_values("part")
    state, out = START, []
    for exits in pieces["exits"].tolist():
        out.append(state)
        state = exits[state]
    return pd.DataFrame({"ck": pieces["ck"], "part": pieces["part"], "entry": out})


def _join_pieces(texts: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        """A conversation's slices in order; the audit is kept, texts are hashed as they come."""
        for _, slices in _runs(batches, (0,)):
            tally, digest, first, audit, kept, cost = Tally(), hashlib.sha256(), True, [], [], None
            edits, at, now, state = "", 0, None, START
            for _, part, _, conv_id, turns, roles, words, faults, late, entry, piece_cost, way in slices:
                if part != now:
                    now, edits, at = part, way[entry], 0
                    audit.append(edits)
                    cost = piece_cost[entry] if cost is None else cost
                faults = _faults(faults, late)
                for t, r, f in zip(turns, roles, faults):
                    tally.add(t, r[:1], f)
                # a slice takes the edits up to its last row
                end, left = at, len(roles)
                while left:
                    left -= edits[end] != "I"
                    end += 1
                fixed, state = apply_edits(edits[at:end], roles, words, state)
                at, first = end, _hash(fixed, digest, first)
                kept += fixed if texts else []
            fixed, _ = apply_edits(CLOSING[state], [], [], state)
            _hash(fixed, digest, first)
            audit.append(CLOSING[state])
            out = {"conv_id": conv_id, **tally.columns(), "cost": cost, "audit": "".join(audit), "repaired_sha256": digest.hexdigest()}
            yield out | ({"repaired": "\n".join(f"{r}:{t}" for r, t in kept + fixed)} if texts else {})

    return run


def _as_batches(run, schema: pa.Schema):
    def batches(given: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in run(given):
            yield pa.RecordBatch.from_pylist([row], schema=schema)

    return batches


def repair_conversations(rows: DataFrame, texts: bool = False, copies: str | None = None) -> DataFrame:
    """One row for each conv_id of rows (conv_id, turn, role, text): its faults, the cost and edits of its cheapest repair, the
    repaired turns' hash, and with `texts` the repaired turns themselves.

    copies: a column of how often a row stands there (0: it only names the conversation).
    """
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    spark = rows.sparkSession
    kind = rows.schema["conv_id"].dataType.simpleString()
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    given = rows.select("conv_id", F.col("turn").cast("bigint").alias("turn"), text("role").alias("role"), text("text").alias("text"), (F.col(copies).cast("int") if copies else F.lit(1)).alias("copies"))
    order = ["conv_id", "turn", "role", F.substring("text", 1, 32), F.xxhash64("text")]
    salted = given.withColumn("salt", F.monotonically_increasing_id())
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = salted.repartitionByRange(n, *order, "salt").sortWithinPartitions(*order, "salt").drop("salt")
    first = StructType.fromDDL(f"{_schema(kind, texts)}, {_SLICE}")
    repaired = materialise(dealt.mapInArrow(_first_way(kind, texts, to_arrow_schema(first)), first), "repair-first")
    done = repaired.where("part is null").select(*StructType.fromDDL(_schema(kind, texts)).names)
    # pieces: conversations at the borders of tasks
    ck = F.concat(F.when(F.col("conv_id").isNull(), "n").otherwise("v"), F.coalesce(F.col("conv_id").cast("string"), F.lit("")))
    pieces = repaired.where("part is not null").select(ck.alias("ck"), "conv_id", "part", "slice", "turns", "roles", "texts", "faults", "keys")
    said = pieces.select("ck", "part", "slice", F.posexplode(F.arrays_zip("faults", "keys")).alias("at", "x")).where(F.col("x.faults").isin(NONE, CUT)).select("ck", "part", "slice", "at", F.col("x.keys").alias("key"))
    before = said.groupBy("ck", "key").agg(F.min("part").alias("first"), F.max("part").alias("last")).where("first < last").drop("last")
    late = said.join(before, ["ck", "key"]).where("part > first").groupBy("ck", "part", "slice").agg(F.collect_list("at").alias("late"))
    pieces = materialise(pieces.join(late, ["ck", "part", "slice"], "left"), "repair-pieces")

    def in_order(df: DataFrame, *by: str) -> DataFrame:
        return df.repartition(n, *by).sortWithinPartitions("ck", "part", "slice")

    def staged(df: DataFrame, run, schema: str) -> DataFrame:
        return df.mapInArrow(_as_batches(run, to_arrow_schema(StructType.fromDDL(schema))), schema)

    bare = pieces.select("ck", "part", "slice", "roles", "faults", "late")
    costs = staged(in_order(bare, "ck", "part"), _costs, "ck string, part int, costs array<bigint>")
    ends = costs.groupBy("ck").applyInPandas(_ends, "ck string, part int, ends array<bigint>")
    ways = staged(in_order(bare.join(ends, ["ck", "part"]), "ck", "part"), _ways, "ck string, part int, costs array<bigint>, audits array<string>, exits array<int>")
    ways = materialise(ways, "repair-ways")
    entries = ways.select("ck", "part", "exits").groupBy("ck").applyInPandas(_entries, "ck string, part int, entry int")
    chosen = ways.join(entries, ["ck", "part"]).select("ck", "part", "entry", F.col("costs").alias("piece_costs"), "audits")
    whole = pieces.join(chosen, ["ck", "part"]).select("ck", "part", "slice", "conv_id", "turns", "roles", "texts", "faults", "late", "entry", "piece_costs", "audits")
    return done.union(staged(in_order(whole, "ck"), _join_pieces(texts), _schema(kind, texts)))


def damage(rows: DataFrame) -> DataFrame:
    """Damages rows by crc32 of conv_id:turn modulo 20: 0 drops a row (copies 0), 1 empties its text, 2 takes its ends of
    sentences, 3 repeats it (copies 2), 4 makes it the user's. Nulls count as one space."""
    said = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    k = F.crc32(F.concat(said("conv_id"), F.lit(":"), said("turn")).cast("binary")) % 20
    text = F.when(k == 1, "").when(k == 2, F.regexp_replace(said("text"), "[.!?]", "")).otherwise(said("text"))
    return rows.select("conv_id", "turn", F.when(k == 4, "user").otherwise(said("role")).alias("role"), text.alias("text"), F.when(k == 0, 0).when(k == 3, 2).otherwise(1).alias("copies"))
