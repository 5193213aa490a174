"""From raw events to packets and anchors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mnemos.config import FIELD, PAYLOAD_TYPES, SOURCES


def _given(df: DataFrame, *names: str) -> Column:
    """The first of the columns that is there and not empty."""
    parts = [F.when(F.col(n).cast("string") != "", F.col(n).cast("string")) for n in names if n in df.columns]
    return F.coalesce(*parts) if parts else F.lit(None).cast("string")


def normalize_events(df: DataFrame, now: float | None = None) -> DataFrame:
    """ts, session_id, turn_id, source, payload_type, payload, meta. Alias columns: text, role, metadata.

    A ts of 0 or null is `now` (or the time of the query). A missing turn id is drawn from the row's content.
    """
    ts = F.col("ts").cast("double") if "ts" in df.columns else F.lit(None).cast("double")
    now_col = F.lit(now) if now is not None else F.unix_micros(F.current_timestamp()) / 1e6
    session, payload = F.coalesce(_given(df, "session_id"), F.lit("")), F.coalesce(_given(df, "payload", "text"), F.lit(""))
    meta = next((F.col(c) for c in ("meta", "metadata") if c in df.columns), F.lit(None).cast("map<string,string>"))
    return df.select(
        F.coalesce(F.when(ts != 0, ts), now_col).alias("ts"), session.alias("session_id"),
        F.coalesce(_given(df, "turn_id"), F.concat(F.lit("turn-"), F.substring(F.sha2(F.concat_ws("\x1f", session, payload), 256), 1, 10))).alias("turn_id"),
        F.lower(F.trim(F.coalesce(_given(df, "source", "role"), F.lit("user")))).alias("source"), F.lower(F.trim(F.coalesce(_given(df, "payload_type"), F.lit("text")))).alias("payload_type"),
        F.regexp_replace(payload, r"^\s+|\s+$", "").alias("payload"), meta.alias("meta"),
    )


def reject_reason() -> Column:
    return (
        F.when(F.col("payload").isNull() | (F.col("payload") == ""), "payload must not be empty")
        .when(~F.col("source").isin(*SOURCES), "unknown source")
        .when(~F.col("payload_type").isin(*PAYLOAD_TYPES), "unknown payload type")
    )


def split_valid_rejected(events: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Valid events, and rejected ones with a reason; each from one narrow pass."""
    judged = events.withColumn("reason", reject_reason())
    return judged.where("reason is null").drop("reason"), judged.where("reason is not null")


def packetize(events: DataFrame, max_chars: int = FIELD.packet_chars) -> DataFrame:
    """A row for each chunk of max(64, max_chars) characters, with chunk_index and token_count (UTF-8 bytes div 4)."""
    size = max(64, max_chars)
    starts = F.sequence(F.lit(0), F.floor((F.length("payload") - 1) / size).cast("int"))
    out = events.select("*", F.posexplode(F.transform(starts, lambda i: F.substring(F.col("payload"), i * size + 1, F.lit(size)))).alias("chunk_index", "chunk"))
    out = out.drop("payload").withColumnRenamed("chunk", "payload").withColumn("token_count", F.greatest(F.lit(1), F.floor(F.octet_length("payload") / 4).cast("int")))
    key = F.sha2(F.concat_ws("\x1f", "session_id", "turn_id", F.col("ts").cast("string"), F.col("chunk_index").cast("string"), "payload"), 256)
    return out.withColumn("packet_id", F.concat(F.lit("pkt_"), F.substring(key, 1, 32)))


def source_quality() -> Column:
    return F.when(F.col("source").isin("user", "assistant"), 0.95).otherwise(0.80)


def to_anchors(packets: DataFrame, z: Column | None = None) -> DataFrame:
    """Anchors of packets; z is the packet's vector, where an encoder is given."""
    out = packets.withColumn("anchor_id", F.concat(F.lit("anc_"), F.substring_index("packet_id", "_", -1))).withColumn("source_quality", source_quality())
    out = out if z is None else out.withColumn("z", z)
    return out.withColumnRenamed("payload", "residual_ref").drop("chunk_index", "token_count", "payload_type")
