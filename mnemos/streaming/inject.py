"""Sessions folded in time order, as a batch and as a stateful stream; and periodic maintenance of a stream."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from mnemos.kernels.inject import Session
from mnemos.sources.stages import spread

FRAME = "session_id string, anchor_id string, seq bigint, ts double, action string, trace_id string, objective double, active_ids array<string>, weights array<double>"
_COLUMNS = [c.split()[0] for c in FRAME.split(", ")]
NEEDS = ("session_id", "anchor_id", "ts", "seq", "chunk_index", "z")


def _run(session: Session, rows: pd.DataFrame) -> pd.DataFrame:
    ordered = rows.sort_values(["ts", "seq", "chunk_index", "anchor_id"], kind="stable")
    out = [session.inject(a, np.asarray(z, dtype=np.float64), float(ts)) for a, z, ts in zip(ordered["anchor_id"], ordered["z"], ordered["ts"])]
    return pd.DataFrame(out, columns=_COLUMNS)


def inject_sessions(anchors: DataFrame) -> DataFrame:
    """A frame for each anchor (NEEDS): one shuffle by session, then the loop in order inside it.

    The order inside a session is the semantics, so a session is the unit of work; sessions never see each other's
    traces. An empty session_id is a session of its own.
    """

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        return _run(Session(str(key[0]), len(rows["z"].iloc[0])), rows)

    return spread(anchors.select(*NEEDS), "session_id").groupBy("session_id").applyInPandas(run, FRAME)


def inject_stream(anchors: DataFrame) -> DataFrame:
    """The same over a stream: each micro-batch is sorted within itself, late events are folded at arrival.

    A session's state (traces, edges, frontier, last frames) is kept as text in the state store.
    """

    def run(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(parts))
        session = Session.from_json(state.get[0]) if state.exists else Session(str(key[0]), len(rows["z"].iloc[0]))
        out = _run(session, rows)
        state.update((session.to_json(),))
        yield out

    return anchors.select(*NEEDS).groupBy("session_id").applyInPandasWithState(run, FRAME, "state string", "append", GroupStateTimeout.NoTimeout)


def maintenance_trigger(frames: DataFrame, maintain: Callable[[DataFrame, int], Any], interval: float = 5.0, checkpoint: str | None = None, once: bool = False) -> StreamingQuery:
    """Calls maintain(batch, batch_id) on the frames that came in, every `interval` seconds (or once over what is there)."""
    if interval <= 0:
        raise ValueError("the interval must be over 0")
    out = frames.writeStream.foreachBatch(lambda df, i: maintain(df, i))
    out = out.trigger(availableNow=True) if once else out.trigger(processingTime=f"{interval} seconds")
    return (out.option("checkpointLocation", checkpoint) if checkpoint else out).start()
