"""Streaming operators over event rows; each works on a batch and, with the same result for closed windows, on a stream."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def with_time(events: DataFrame, delay: str = "10 minutes") -> DataFrame:
    """Event time as a timestamp, with a watermark (no effect on a batch)."""
    return events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", delay)


def rate_windows(events: DataFrame, width: str, most: int) -> DataFrame:
    """``(user_id, start, n)`` of fixed windows in which a user has more than ``most`` events."""
    g = events.groupBy("user_id", F.window("ts", width).alias("w")).agg(F.count("*").alias("n"))
    return g.where(F.col("n") > most).select("user_id", F.unix_seconds("w.start").alias("start"), "n")


def sessions(events: DataFrame, gap: str) -> DataFrame:
    """``(user_id, start, n)`` of a user's events without a gap as long as ``gap``."""
    g = events.groupBy("user_id", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("n"))
    return g.select("user_id", F.unix_micros("w.start").alias("start"), "n")


def once_per_key(events: DataFrame, key: str) -> DataFrame:
    """One row per key: the first to arrive within the watermark on a stream, any on a batch."""
    return events.dropDuplicatesWithinWatermark([key]) if events.isStreaming else events.dropDuplicates([key])


def last_seen(events: DataFrame) -> DataFrame:
    """``(user_id, last)``: newest event time per user; an update-mode aggregate on a stream."""
    return events.groupBy("user_id").agg(F.max("ts").alias("last"))


def fan_out(events: DataFrame, subscriptions: DataFrame) -> DataFrame:
    """Each event once per subscriber of its type: a stream-static join."""
    return events.join(subscriptions, "event_type")


def fan_out_totals(events: DataFrame, subscriptions: DataFrame) -> DataFrame:
    """``(subscriber, n_events, last_event)``: what :func:`fan_out` would deliver, from one row per type and not one per delivery."""
    totals = events.groupBy("event_type").agg(F.count("*").alias("n_events"), F.max("event_id").alias("last_event"))
    return subscriptions.join(totals, "event_type").groupBy("subscriber").agg(F.sum("n_events").alias("n_events"), F.max("last_event").alias("last_event"))


def _frames(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Digest of the texts of each session; of the open one only the running digest is held."""
    at, n, digest = None, 0, None

    def row() -> list[tuple]:
        return [(at, n, digest.hexdigest())] if digest is not None else []

    for pdf in batches:
        out: list[tuple] = []
        for session, content in zip(pdf["session_id"], pdf["content"]):
            if digest is None or session != at:
                out += row()
                at, n, digest = session, 0, hashlib.md5(usedforsecurity=False)
            n += 1
            digest.update(content.encode())
        yield pd.DataFrame(out, columns=["session_id", "n_frames", "text_hash"])
    yield pd.DataFrame(row(), columns=["session_id", "n_frames", "text_hash"])


def assembled(frames: DataFrame) -> DataFrame:
    """``frames(session_id, created_at, id, content)`` -> ``(session_id, n_frames, text_hash)``: each session's texts in order, as a digest.

    Sorted partitions are streamed, so that a session of any length needs no more memory than a batch. Contents must not be null.
    """
    placed = frames.repartition("session_id").sortWithinPartitions("session_id", "created_at", "id")
    return placed.select("session_id", "content").mapInPandas(_frames, "session_id string, n_frames long, text_hash string")


_DROP = "user_id long, event_id long, place int"


def _places(most: int, width_ms: int):
    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        seen = state.get[0] if state.exists else 0
        rows = []
        for pdf in batches:
            for event in pdf.sort_values(["ts", "event_id"])["event_id"]:
                seen += 1
                if seen > most:
                    rows.append((key[0], int(event), seen))
        state.update((seen,))
        state.setTimeoutTimestamp(max(int(key[1]) * 1000 + width_ms, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame(rows, columns=["user_id", "event_id", "place"])

    return step


def stream_drops(events: DataFrame, width_s: int, most: int) -> DataFrame:
    """Events beyond the first ``most`` of a user in a fixed window, in order of arrival; state per user and window, removed when it closes."""
    keyed = events.withColumn("start", (F.floor(F.unix_seconds("ts") / width_s) * width_s).cast("bigint"))
    return keyed.groupBy("user_id", "start").applyInPandasWithState(_places(most, width_s * 1000), _DROP, "n int", "append", GroupStateTimeout.EventTimeTimeout)


def _changes(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    last = state.get[0] if state.exists else None
    rows = []
    for pdf in batches:
        for event, kind in pdf.sort_values(["ts", "event_id"])[["event_id", "event_type"]].itertuples(index=False):
            if kind != last:
                rows.append((key[0], int(event), last, kind))
                last = kind
    state.update((last,))
    yield pd.DataFrame(rows, columns=["user_id", "event_id", "before", "after"])


def stream_changes(events: DataFrame) -> DataFrame:
    """Events at which a user's status differs from the one before: the last status is the state."""
    return events.groupBy("user_id").applyInPandasWithState(_changes, "user_id long, event_id long, before string, after string", "last string", "append", GroupStateTimeout.NoTimeout)
