"""Batch twins of the streaming operators, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from docspark.plans import registry
from docspark.plans.library import _LIVE, live_messages
from docspark.sources.tables import table
from docspark.streaming import limits

QUERIES: dict = {}
SQL: dict[str, str] = {}
query = registry(QUERIES, SQL)


def _events(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))


@query("SELECT user_id, epoch(time_bucket(INTERVAL 1 HOUR, ts))::BIGINT AS start, count(*) AS n FROM events GROUP BY 1, 2 HAVING count(*) > 1")
def rate_limit_windows(spark: SparkSession, d: str) -> DataFrame:
    return limits.rate_windows(_events(spark, d), "1 hour", 1)


@query("SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id, date_trunc('day', ts) ORDER BY ts, event_id) AS place FROM events QUALIFY place > 3")
def rate_limit_drops(spark: SparkSession, d: str) -> DataFrame:
    """Events beyond a user's first three of a day."""
    w = Window.partitionBy("user_id", F.date_trunc("day", "ts")).orderBy("ts", "event_id")
    return _events(spark, d).select("user_id", "event_id", F.row_number().over(w).alias("place")).where("place > 3")


@query("WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w >= INTERVAL 5 HOUR OR lag(ts) OVER w IS NULL THEN 1 ELSE 0 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts) AS k FROM g) SELECT user_id, epoch_us(min(ts)) AS start, count(*) AS n FROM s GROUP BY user_id, k")
def user_sessions(spark: SparkSession, d: str) -> DataFrame:
    return limits.sessions(_events(spark, d), "5 hours")


@query("SELECT user_id, event_id, coalesce(before, '') AS before, event_type AS after FROM (SELECT *, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM events) WHERE before IS NULL OR before <> event_type")
def status_transitions(spark: SparkSession, d: str) -> DataFrame:
    before = F.lag("event_type").over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    rows = _events(spark, d).select("user_id", "event_id", before.alias("before"), F.col("event_type").alias("after"))
    return rows.where("before is null or before <> after").withColumn("before", F.coalesce("before", F.lit("")))


@query(f"WITH {_LIVE} SELECT session_id, count(*) AS n_frames, md5(string_agg(coalesce(content, ''), '' ORDER BY created_at, id)) AS text_hash FROM live GROUP BY 1")
def frame_assembly(spark: SparkSession, d: str) -> DataFrame:
    """The frames of a session put together in order."""
    rows = live_messages(spark, d).select("session_id", "created_at", "id", F.coalesce("content", F.lit("")).alias("content"))
    return limits.assembled(rows)


@query("SELECT session_id, count(DISTINCT id) AS n_messages, count(*) AS n_rows FROM chat_messages WHERE id IS NOT NULL GROUP BY 1")
def client_dedup(spark: SparkSession, d: str) -> DataFrame:
    """Messages that come twice counted once."""
    m = table(spark, d, "chat_messages").where("id is not null").select("session_id", "id")
    rows = m.groupBy("session_id").agg(F.count("*").alias("n_rows"))
    return limits.once_per_key(m, "id").groupBy("session_id").agg(F.count("*").alias("n_messages")).join(rows, "session_id").select("session_id", "n_messages", "n_rows")


@query("SELECT user_id, epoch_us(max(ts)) AS last FROM events GROUP BY 1")
def last_seen(spark: SparkSession, d: str) -> DataFrame:
    return limits.last_seen(_events(spark, d)).withColumn("last", F.unix_micros("last"))


@query("""WITH g AS (SELECT *, lag(ts) OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS before FROM events)
SELECT user_id, event_type, event_id AS holder, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS lease FROM g WHERE before IS NULL OR ts - before >= INTERVAL 6 HOUR""")
def job_locks(spark: SparkSession, d: str) -> DataFrame:
    """Who takes a lock: the first row of each key, and after six quiet hours, when the lock has expired, the next one."""
    order = Window.partitionBy("user_id", "event_type").orderBy("ts", "event_id")
    rows = _events(spark, d).select("user_id", "event_type", "event_id", "ts", F.lag("ts").over(order).alias("before"))
    taken = rows.where(F.col("before").isNull() | (F.col("ts") - F.expr("interval 6 hours") >= F.col("before")))
    return taken.select("user_id", "event_type", F.col("event_id").alias("holder"), F.row_number().over(order).alias("lease"))


@query("SELECT epoch(time_bucket(INTERVAL 5 MINUTE, ts))::BIGINT AS start, count(*) AS n, count(DISTINCT user_id) AS n_users, round(sum(value), 4) AS value FROM events GROUP BY 1")
def stats_5min(spark: SparkSession, d: str) -> DataFrame:
    w = _events(spark, d).groupBy(F.window("ts", "5 minutes").alias("w")).agg(F.count("*").alias("n"), F.count_distinct("user_id").alias("n_users"), F.round(F.sum("value"), 4).alias("value"))
    return w.select(F.unix_seconds("w.start").alias("start"), "n", "n_users", "value")


@query("SELECT s.user_id AS subscriber, count(*) AS n_events, max(e.event_id) AS last_event FROM events e JOIN (SELECT user_id, arg_max(event_type, (ts, event_id)) AS event_type FROM events GROUP BY 1) s ON s.event_type = e.event_type GROUP BY 1")
def fan_out(spark: SparkSession, d: str) -> DataFrame:
    """Events delivered to each user, who listens to the type of their latest event."""
    e = _events(spark, d)
    subs = e.groupBy("user_id").agg(F.max_by("event_type", F.struct("ts", "event_id")).alias("event_type")).withColumnRenamed("user_id", "subscriber")
    return limits.fan_out_totals(e, subs)
