"""Rebuilding conversations from message rows with keyed streaming state.

Message rows form one stream in the order of their arrival. State is kept by session
(sessions share a key in small shards, so that not every one costs a call): the newest version of
each message is buffered, late arrivals included, until the event-time watermark passes
the session's last event by the timeout; then the session is put in order, validated
and emitted, and its state is dropped. So the state holds the sessions that are open, not the table. A bounded replay
reads the rows in slices of arrival time and ends with a row beyond all timeouts.

Nothing is lost to the watermark: a verdict says how many rows it saw. A session whose rows
are more (some were later than the watermark, or came after it had closed) is a correction: it is judged again from
all its rows. So is a session with more rows than ``hot``, which no key's state could hold. Both are range-sorted
by session and time, checked per partition, and the partitions' summaries (first role, last role,
alternation) are joined in order.
"""

from __future__ import annotations

import math
import pickle
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.window import Window

from docspark.work import Work

#: Rows of one session from which it is not held in state but sorted by ranges.
HOT = 20_000
#: Quiet time that closes a session, and how far rows may be out of order before they are late.
TIMEOUT_S, DELAY_S = 1800, 3600
#: Rows of a shard: sessions share keyed state in shards of about so many rows.
SHARD_ROWS = 1_000
#: Slices a replay has at least and at most, rows of a slice, and of a file.
SLICES, SLICE_ROWS, FILE_ROWS = (4, 64), 1_000_000, 250_000

ARRIVAL = "shard int, session_id string, id string, role string, content string, blank boolean, deleted boolean, created_at timestamp, updated_at timestamp, cleared_at timestamp, event_time timestamp"
_ARRIVAL = [c.split()[0] for c in ARRIVAL.split(", ")]
OUT = "session_id string, kind string, position long, id string, role string, content string, created_at timestamp, n_rows long, n_messages long, reason string"
_OUT = [c.split()[0] for c in OUT.split(", ")]
_FAR = pd.Timestamp("1970-01-01")
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"

REASONS = ("empty", "unknown role", "blank content", "no exchange", "does not start with user", "does not alternate", "does not end with assistant")


def judge(messages: list[tuple[str | None, bool]]) -> str | None:
    """Why ordered ``(role, blank)`` are no valid conversation; None if they are."""
    if not messages:
        return "empty"
    if any(r is None for r, _ in messages):
        return "unknown role"
    if any(b for _, b in messages):
        return "blank content"
    talk = [r for r, _ in messages if r != "system"]
    if not talk:
        return "no exchange"
    if talk[0] != "user":
        return "does not start with user"
    if any(x == y for x, y in zip(talk, talk[1:])):
        return "does not alternate"
    return None if talk[-1] == "assistant" else "does not end with assistant"


def _none(x):
    return None if x is None or x is pd.NaT or x != x else x


def _closed(session: str, seen: dict, cleared, n_rows: int) -> list[tuple]:
    """The rows of a session that closes: its verdict, and its messages in order if it is kept."""
    live = []
    for key, (_, created, role, content, blank, deleted) in seen.items():
        if not deleted and (cleared is None or (created is not None and created > cleared)):
            live.append((created or _FAR, key, created, role, content, blank))
    live.sort(key=lambda x: x[:2])
    reason = judge([(x[3], x[5]) for x in live])
    rows = [(session, "verdict", None, None, None, None, None, n_rows, len(live), reason)]
    if reason is None:
        rows += [(session, "message", n, k, role, content, created, None, None, None) for n, (_, k, created, role, content, _) in enumerate(live)]
    return rows


def _assemble(timeout_ms: int):
    """One shard of sessions: ``held`` maps a session to its buffered versions, its clearing, its last event (ms) and its number of rows."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = pickle.loads(state.get[0]) if state.exists else {}
        if state.hasTimedOut:
            now = state.getCurrentWatermarkMs()
            rows = []
            for s in [s for s, (_, _, last, _) in held.items() if last + timeout_ms <= now]:
                seen, cleared, _, n = held.pop(s)
                rows += _closed(s, seen, cleared, n)
            if rows:
                yield pd.DataFrame(rows, columns=_OUT)
        else:
            for pdf in batches:
                for session, mid, role, content, blank, deleted, created, updated, clear, event in zip(*(pdf[c] for c in ("session_id", "id", "role", "content", "blank", "deleted", "created_at", "updated_at", "cleared_at", "event_time"))):
                    if session is None:
                        return
                    mine = held.setdefault(session, [{}, _none(clear), 0, 0])
                    mine[2] = max(mine[2], int(event.value // 1_000_000))
                    mine[3] += 1
                    stamp = _none(updated) or _FAR
                    seen = mine[0]
                    if mid not in seen or stamp > seen[mid][0]:
                        seen[mid] = (stamp, _none(created), _none(role), _none(content), bool(blank), bool(deleted))
        if held:
            state.update((pickle.dumps(held),))
            state.setTimeoutTimestamp(max(min(last for _, _, last, _ in held.values()) + timeout_ms, state.getCurrentWatermarkMs() + 1))
        elif state.exists:
            state.remove()

    return step


def clean_role(role: Column, aliases: DataFrame, rows: DataFrame, name: str = "role") -> DataFrame:
    """``rows`` with its column ``name`` replaced by the role its cleaned spelling stands for, or null."""
    known = F.broadcast(aliases.select(F.col("alias").alias("_alias"), F.col("role").alias("_role")))  # a fixed table of spellings
    bare = F.regexp_replace(F.lower(F.regexp_replace(role, r"^[ \t\r\n]+|[ \t\r\n]+$", "")), r"^[ \t\r\n]+|[ \t\r\n]+$", "")
    return rows.withColumn("_bare", bare).join(known, F.col("_bare") == F.col("_alias"), "left").withColumn(name, F.col("_role")).drop("_alias", "_role", "_bare")


def is_blank(content: Column) -> Column:
    """Null, empty, or nothing but white space and characters that show nothing."""
    return content.isNull() | content.rlike("^(?U:[\\s\\x{00A0}\\x{200B}-\\x{200D}\\x{2060}\\x{FEFF}])*$")


def arrivals(messages: DataFrame, sessions: DataFrame, aliases: DataFrame, hot: int = HOT) -> DataFrame:
    """Message rows with clean roles, the session's ``cleared_at``, when they happened and when they arrived, and whether their session is ``hot``."""
    given = F.coalesce("id", F.concat(F.lit("?"), F.xxhash64("created_at", "role", "content").cast("string")))
    own = messages.where("session_id is not null").select("session_id", given.alias("id"), "role", "content", F.col("deleted_at").isNotNull().alias("deleted"), *[F.col(c).cast("timestamp").alias(c) for c in ("created_at", "updated_at")])
    large = own.groupBy("session_id").agg(F.count("*").alias("n")).where(F.col("n") > hot).select("session_id", F.lit(True).alias("hot"))
    cleared = sessions.where("id is not null and cleared_at is not null").groupBy(F.col("id").alias("session_id")).agg(F.max(F.col("cleared_at").cast("timestamp")).alias("cleared_at"))
    rows = clean_role(F.col("role"), aliases, own).join(large, "session_id", "left").join(cleared, "session_id", "left")
    return rows.select(
        *("session_id", "id", "role", "content"),
        is_blank(F.col("content")).alias("blank"),
        *("deleted", "created_at", "updated_at", "cleared_at"),
        F.col("created_at").alias("event_time"),
        F.coalesce("updated_at", "created_at").alias("arrived"),
        F.coalesce("hot", F.lit(False)).alias("hot"),
    )


def _stream(spark: SparkSession, feed: str, sink: str, stated: str, delay_s: int, timeout_s: int, files: int, progress: list | None) -> None:
    """Runs the stateful query over what ``feed`` holds, ``files`` files a batch; state is in RocksDB."""
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key, None)
    spark.conf.set(key, _ROCKS)
    try:
        stream = spark.readStream.schema(ARRIVAL).option("maxFilesPerTrigger", files).parquet(feed)
        emitted = (
            stream.withWatermark("event_time", f"{delay_s} seconds")
            .groupBy("shard")
            .applyInPandasWithState(_assemble(timeout_s * 1000), OUT, "held binary", "append", GroupStateTimeout.EventTimeTimeout)
        )
        query = emitted.writeStream.format("parquet").option("path", sink).option("checkpointLocation", stated).outputMode("append").trigger(availableNow=True).start()
        query.awaitTermination()
        if progress is not None:
            progress += query.recentProgress
    finally:
        if before is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, before)


def rebuild(
    messages: DataFrame, sessions: DataFrame, aliases: DataFrame, work: Work, hot: int = HOT, delay_s: int = DELAY_S, timeout_s: int = TIMEOUT_S, slices: int | None = None, progress: list | None = None
) -> tuple[DataFrame, DataFrame]:
    """``(verdicts, conversation)``: ``(session_id, n_messages, reason)`` of every session id in either table, and the ordered messages ``(session_id, position, id, role, content, created_at)`` of those kept (``reason`` null).

    Newest version per message id; without deleted messages and those not later than the
    session's ``cleared_at``; order by creation, then id. A row arrives when it was last written (``updated_at``) and
    happened when it was created. ``delay_s`` is the watermark's delay, ``timeout_s`` the quiet time that closes a
    session; both decide when a session is first judged, never the result. Null ids of messages count as one message per
    distinct row, null creation as the earliest time (dropped where the session was cleared), null session ids are left out.
    Empty tables give empty results. ``progress`` receives the reports of the streaming batches.
    """
    spark = work.spark
    log = work.table(arrivals(messages, sessions, aliases, hot), "arrivals")
    low, high, n = log.agg(F.min("event_time"), F.max("event_time"), F.count("*")).first()
    epoch = F.lit("1970-01-02 00:00:00").cast("timestamp")
    first = F.lit(low).cast("timestamp") if low is not None else epoch
    shard = F.pmod(F.xxhash64(F.lit("shard"), "session_id"), F.lit(max(1, n // SHARD_ROWS))).cast("int")
    at = F.coalesce(F.unix_micros("arrived"), F.lit(-(1 << 62)))
    ready = log.where("not hot").withColumn("event_time", F.coalesce("event_time", first)).withColumn("shard", shard).withColumn("at", at)
    feed, stated, sink = work.path("feed"), work.path("state"), work.path("emitted")
    slices = slices or min(SLICES[1], max(SLICES[0], n // SLICE_ROWS))
    files = math.ceil(max(1, n) / slices / FILE_ROWS)
    cuts = ready.agg(F.percentile_approx("at", [k / slices for k in range(1, slices)], 10_000)).first()[0] if slices > 1 else None
    bounds = [None, *sorted(set(cuts or [])), None]
    for since, until in zip(bounds, bounds[1:]):
        part = ready if since is None else ready.where(F.col("at") > since)
        part = part if until is None else part.where(F.col("at") <= until)
        part.select(*_ARRIVAL).coalesce(files).write.mode("append").parquet(feed)
    # the end of the replay
    past = (F.lit(high).cast("timestamp") if high is not None else epoch) + F.make_dt_interval(secs=F.lit(2 * (delay_s + timeout_s) + 60))
    end = spark.range(1).select(F.lit(-1).alias("shard"), past.alias("event_time"))
    end.select(*[F.col(c) if c in end.columns else F.lit(None).cast(t).alias(c) for c, t in (x.split() for x in ARRIVAL.split(", "))]).coalesce(1).write.mode("append").parquet(feed)
    _stream(spark, feed, sink, stated, delay_s, timeout_s, files, progress)

    out = spark.read.schema(OUT).parquet(sink)
    sizes = log.groupBy("session_id").agg(F.count("*").alias("n"), F.bool_or("hot").alias("hot"))
    judged = out.where("kind = 'verdict'").groupBy("session_id").agg(F.count("*").alias("closings"), F.max("n_rows").alias("n_rows"), F.max_by("n_messages", "n_rows").alias("n_messages"), F.max_by("reason", "n_rows").alias("reason"))
    every = work.table(sizes.join(judged, "session_id", "left").withColumn("whole", F.coalesce((F.col("closings") == 1) & (F.col("n_rows") == F.col("n")), F.lit(False))), "judged")
    whole = every.where("whole")
    verdicts = whole.select("session_id", "n_messages", "reason")
    told = out.where("kind = 'message'").join(whole.where("reason is null").select("session_id"), "session_id", "left_semi").select("session_id", "position", "id", "role", "content", "created_at")
    again = every.where("not whole").select("session_id")
    more_verdicts, more_told = _by_ranges(log.join(again, "session_id", "left_semi"), again, work)
    unused = sessions.where("id is not null").select(F.col("id").alias("session_id")).distinct().join(sizes.select("session_id"), "session_id", "left_anti")
    unused = unused.select("session_id", F.lit(0).cast("long").alias("n_messages"), F.lit(REASONS[0]).alias("reason"))
    return verdicts.unionByName(more_verdicts).unionByName(unused), told.unionByName(more_told)


_SEGMENT = "session_id string, kind string, segment int, position long, id string, role string, content string, created_at timestamp, n long, first_role string, last_role string, alternates boolean, known boolean, filled boolean"


def _segments(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Messages with their position in the partition, and one summary per session and partition."""
    names = [c.split()[0] for c in _SEGMENT.split(", ")]
    held: dict = {}
    for pdf in batches:
        rows = []
        for session, segment, mid, role, content, blank, created in zip(*(pdf[c] for c in ("session_id", "segment", "id", "role", "content", "blank", "created_at"))):
            s = held.setdefault(session, [segment, 0, None, None, True, True, True])
            role = _none(role)
            rows.append((session, "message", segment, s[1], mid, role, content, created, None, None, None, None, None, None))
            s[1] += 1
            s[5] &= role is not None
            s[6] &= not blank
            if role is not None and role != "system":
                s[4] &= role != s[3]
                s[2], s[3] = s[2] or role, role
        yield pd.DataFrame(rows, columns=names)
    yield pd.DataFrame([(k, "segment", s[0], None, None, None, None, None, *s[1:]) for k, s in held.items()], columns=names)


def _by_ranges(rows: DataFrame, ids: DataFrame, work: Work) -> tuple[DataFrame, DataFrame]:
    """Verdicts and messages of the sessions ``ids`` from all their ``rows``."""
    keep = ["role", "content", "blank", "deleted", "created_at", "cleared_at"]
    newest = rows.groupBy("session_id", "id").agg(F.max_by(F.struct(*keep), F.coalesce(F.unix_micros("updated_at"), F.lit(0))).alias("m")).select("session_id", "id", "m.*")
    live = newest.where("not deleted and (cleared_at is null or created_at > cleared_at)")
    parts = live.repartitionByRange(F.col("session_id"), F.col("created_at").asc_nulls_first(), F.col("id"))
    parts = parts.sortWithinPartitions(F.col("session_id"), F.col("created_at").asc_nulls_first(), F.col("id")).withColumn("segment", F.spark_partition_id())
    cut = work.table(parts.select("session_id", "segment", "id", "role", "content", "blank", "created_at").mapInPandas(_segments, _SEGMENT), "sorted")
    before = Window.partitionBy("session_id").orderBy("segment")  # as many rows as a session has range partitions
    talk = Window.partitionBy("session_id").orderBy("segment").rowsBetween(Window.unboundedPreceding, -1)
    seg = cut.where("kind = 'segment'").withColumn("offset", F.sum("n").over(before) - F.col("n")).withColumn("previous", F.last("last_role", ignorenulls=True).over(talk))
    one = seg.groupBy("session_id").agg(
        F.sum("n").alias("n_messages"),
        F.min("known").alias("known"),
        F.min("filled").alias("filled"),
        F.min(F.col("alternates") & F.coalesce(F.col("previous") != F.col("first_role"), F.lit(True))).alias("alternates"),
        F.min_by("first_role", F.when(F.col("first_role").isNotNull(), F.col("segment"))).alias("first_role"),
        F.max_by("last_role", F.when(F.col("last_role").isNotNull(), F.col("segment"))).alias("last_role"),
    )
    empty, role, blank, none, start, turns, finish = REASONS
    reason = (
        F.when(F.coalesce("n_messages", F.lit(0)) == 0, empty)
        .when(~F.col("known"), role)
        .when(~F.col("filled"), blank)
        .when(F.col("first_role").isNull(), none)
        .when(F.col("first_role") != "user", start)
        .when(~F.col("alternates"), turns)
        .when(F.col("last_role") != "assistant", finish)
    )
    verdicts = ids.join(one, "session_id", "left").select("session_id", F.coalesce("n_messages", F.lit(0)).alias("n_messages"), reason.alias("reason"))
    kept = verdicts.where("reason is null").select("session_id")
    told = cut.where("kind = 'message'").join(seg.select("session_id", "segment", "offset"), ["session_id", "segment"]).join(kept, "session_id", "left_semi")
    return verdicts, told.select("session_id", (F.col("position") + F.col("offset")).alias("position"), "id", "role", "content", "created_at")
