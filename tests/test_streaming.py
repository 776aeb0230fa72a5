import os
import time

import pytest
from pyspark.sql import functions as F

from docspark.sources.tables import table
from docspark.streaming import limits

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


@pytest.fixture()
def feed(spark, tmp_path):
    e = table(spark, DATA, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    at = str(tmp_path / "feed")
    for day in (1, 9, 17, 25):  # files arrive in order of event time
        e.where((F.dayofmonth("ts") >= day) & (F.dayofmonth("ts") < day + 8)).coalesce(1).sortWithinPartitions("ts").write.mode("append").parquet(at)
        time.sleep(0.05)
    return e, spark.readStream.schema(e.schema).option("maxFilesPerTrigger", 1).parquet(at)


def drain(spark, df, name, mode, tmp_path):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.table(name)


def test_closed_windows_equal_the_batch(spark, feed, tmp_path):
    batch, stream = feed
    got = drain(spark, limits.rate_windows(limits.with_time(stream, "1 minute"), "1 day", 1), "windows", "append", tmp_path)
    got = {tuple(r) for r in got.collect()}
    want = {tuple(r) for r in limits.rate_windows(batch, "1 day", 1).collect()}
    last = max(s for _, s, _ in want)
    assert got <= want and {x for x in want if x[1] < last} <= got


def test_closed_sessions_equal_the_batch(spark, feed, tmp_path):
    batch, stream = feed
    got = {tuple(r) for r in drain(spark, limits.sessions(limits.with_time(stream, "1 minute"), "5 hours"), "gaps", "append", tmp_path).collect()}
    want = {tuple(r) for r in limits.sessions(batch, "5 hours").collect()}
    assert got <= want and len(want - got) <= 20


def test_drops_equal_the_batch(spark, feed, tmp_path):
    batch, stream = feed
    got = drain(spark, limits.stream_drops(limits.with_time(stream, "2 days"), 86400, 1), "drops", "append", tmp_path)
    from pyspark.sql.window import Window

    w = Window.partitionBy("user_id", F.date_trunc("day", "ts")).orderBy("ts", "event_id")
    want = batch.select("user_id", "event_id", F.row_number().over(w).alias("place")).where("place > 1")
    assert {tuple(r) for r in got.collect()} == {tuple(r) for r in want.collect()}


def test_changes_equal_the_batch(spark, feed, tmp_path):
    from docspark.plans.streams import QUERIES

    _, stream = feed
    got = {(r.user_id, r.event_id) for r in drain(spark, limits.stream_changes(stream), "changes", "append", tmp_path).collect()}
    assert got == {(r.user_id, r.event_id) for r in QUERIES["status_transitions"](spark, DATA).collect()}


def test_repeats_and_last_seen(spark, feed, tmp_path):
    batch, stream = feed
    twice = limits.with_time(stream.unionByName(stream), "60 days")
    assert drain(spark, limits.once_per_key(twice, "event_id").select("event_id"), "once", "append", tmp_path).count() == batch.count()
    got = drain(spark, limits.last_seen(stream), "seen", "complete", tmp_path)
    assert {tuple(r) for r in got.collect()} == {tuple(r) for r in limits.last_seen(batch).collect()}
