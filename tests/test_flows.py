"""Streaming flows against plain Python, over several files and arrivals."""

import datetime as dt
import random

from lakefolio.plans import registry
from lakefolio.streaming import flows

DATA = "/root/testdata/sf0.001"


def locks(rows, limit, seconds):
    out, by_user = [], {}
    for user, at in rows:
        by_user.setdefault(user, []).append(at)
    for user, times in by_user.items():
        start, count = None, 0
        for at in sorted(times):
            if start is None or at >= start + dt.timedelta(seconds=seconds):
                start, count = at, 0
            count += 1
            if count == limit:
                out.append((user, start, at))
    return sorted(out, key=str)


def test_throttle_on_table(spark):
    events = spark.read.parquet(f"{DATA}/events.parquet").filter("event_type = 'error'").select("user_id", "ts")
    want = locks([(r.user_id, r.ts) for r in events.collect()], 3, 86_400)
    got = registry.QUERIES["stream_throttle"](spark, DATA).collect()
    assert sorted(((r.user_id, r.start.replace(tzinfo=None), r.locked_at.replace(tzinfo=None)) for r in got), key=str) == want


def test_throttle_keeps_state_between_files(spark, tmp_path):
    rng, begin = random.Random(3), dt.datetime(2024, 1, 1)
    rows = sorted([(rng.choice([1, 2, None]), begin + dt.timedelta(seconds=rng.randrange(20_000))) for _ in range(200)], key=lambda r: r[1])
    for n in range(4):  # later files hold later failures
        spark.createDataFrame(rows[50 * n : 50 * n + 50], "user_id long, ts timestamp").coalesce(1).write.mode("append").parquet(f"{tmp_path}/t.parquet")
    stream = spark.readStream.schema("user_id long, ts timestamp").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/t.parquet")
    got = flows.drain(flows.throttle(stream, "user_id", "ts")).collect()
    assert sorted(((r.user_id, r.start, r.locked_at) for r in got), key=str) == locks(rows, 5, 900)


def test_empty_table(spark, tmp_path):
    spark.createDataFrame([], "user_id long, ts timestamp").write.parquet(f"{tmp_path}/t.parquet")
    stream = flows.source(spark, f"{tmp_path}/t.parquet")
    assert flows.drain(flows.throttle(stream, "user_id", "ts")).count() == 0


def test_throttle_state_ends_with_the_window(spark, tmp_path):
    """A window that the watermark has passed leaves no state behind."""
    begin = dt.datetime(2024, 1, 1)
    for n in range(3):  # one file a day
        rows = [(1 + n, begin + dt.timedelta(days=n, seconds=60 * k)) for k in range(6)]
        spark.createDataFrame(rows, "user_id long, ts timestamp").coalesce(1).write.mode("append").parquet(f"{tmp_path}/t.parquet")
    stream = spark.readStream.schema("user_id long, ts timestamp").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/t.parquet")
    run = flows.throttle(stream, "user_id", "ts").writeStream.format("memory").queryName("locks").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start()
    run.awaitTermination()
    assert spark.table("locks").count() == 3
    assert run.lastProgress["stateOperators"][0]["numRowsTotal"] <= 1


def test_path_with_a_slash_at_its_end(spark, tmp_path):
    spark.range(3).write.parquet(f"{tmp_path}/b/t.parquet")
    assert flows.drain(flows.source(spark, f"{tmp_path}/b/t.parquet/")).count() == 3
