"""Queries that run as streams over a table's files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..streaming import flows
from .book import query


def _events(spark: SparkSession, folder: str) -> DataFrame:
    rows = flows.source(spark, f"{folder}/events.parquet")
    return rows.withColumn("ts", F.col("ts").cast("timestamp_ltz"))


@query("SELECT DISTINCT event_id, user_id, event_type FROM events")
def stream_register_once(spark: SparkSession, folder: str) -> DataFrame:
    """Every event is delivered twice and registered once."""
    twice = _events(spark, folder).withColumn("delivery", F.explode(F.array(F.lit(1), F.lit(2))))
    return flows.drain(flows.once(twice, ["event_id"], "ts")).select("event_id", "user_id", "event_type")


@query("""
WITH s AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) <= INTERVAL 10 MINUTE THEN 0 ELSE 1 END AS fresh FROM events),
  b AS (SELECT user_id, ts, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts) AS batch FROM s)
SELECT user_id, min(ts) AS start, max(ts) AS "end", count(*) AS n FROM b GROUP BY user_id, batch""")
def stream_batches(spark: SparkSession, folder: str) -> DataFrame:
    whole = flows.ended(_events(spark, folder), "ts")
    out = flows.drain(flows.batches(whole, "user_id", "ts")).filter(F.col("start") < F.lit(flows.END))
    return out.select("user_id", *(F.col(c).cast("timestamp_ntz").alias(c) for c in ("start", "end")), "n")


@query()
def stream_throttle(spark: SparkSession, folder: str) -> DataFrame:
    """Users locked after three errors within a day of the first."""
    errors = _events(spark, folder).filter("event_type = 'error'").select("user_id", "ts")
    return flows.drain(flows.throttle(errors, "user_id", "ts", limit=3, seconds=86_400))
