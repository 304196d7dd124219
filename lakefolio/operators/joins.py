"""Joins by time and range."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T


def previous(events: DataFrame, key: str, time: str, success: Column, failure: Column) -> DataFrame:
    """For every success: the previous one of its key, and the failures between.

    One window instead of a self-join: failures are counted along the key's
    time line and the counts of neighbouring successes are subtracted.
    """
    order = Window.partitionBy(key).orderBy(time, "event_id")
    failed = F.sum(failure.cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0))
    at = events.withColumn("failed", failed).filter(success)
    return at.select(
        "event_id", key, time, F.lag(time).over(order).alias("previous"),
        (F.col("failed") - F.coalesce(F.lag("failed").over(order), F.lit(0))).alias("failures"),
    )


def near_in_time(left: DataFrame, right: DataFrame, key: str, time: str, minutes: int) -> DataFrame:
    """Rows of `left` with a row of `right` of their key within `minutes`.

    Times are cut into buckets of that length, so that the join has an equality
    on key and bucket and a row meets three buckets only.
    """
    bucket = F.floor(F.unix_timestamp(time) / (60 * minutes))
    other = right.select(F.col(key), F.col(time).alias("other_time"), F.explode(F.array(bucket - 1, bucket, bucket + 1)).alias("bucket"))
    apart = F.abs(F.unix_micros(F.col(time)) - F.unix_micros("other_time")) <= 60_000_000 * minutes
    rows = left.withColumn("bucket", bucket).alias("l")
    on = (F.col(f"l.{key}") == F.col(f"r.{key}")) & (F.col("l.bucket") == F.col("r.bucket")) & apart
    return rows.join(other.alias("r"), on, "left_semi").drop("bucket")


def in_ranges(rows: DataFrame, ip: str, ranges: list[tuple[str, int]]) -> DataFrame:
    """Adds `allowed`: the address is in one of the listed networks. The list is
    a setting; it becomes an expression."""
    number, allowed = T.ip_number(F.col(ip)), F.lit(False)
    for network, bits in ranges:
        low = sum(int(p) * 256 ** (3 - i) for i, p in enumerate(network.split(".")))
        allowed = allowed | number.between(low, low + 2 ** (32 - bits) - 1)
    return rows.withColumn("allowed", allowed)


def contained_passages(docs: DataFrame, passages: DataFrame, words: int = 8) -> DataFrame:
    """(doc_id, item_id, shared): documents that share word n-grams with passages.

    N-grams are hashed to 64 bits and made once a document or passage, repeats
    folded. Words are a column of their own, since a lambda would cut the text
    anew for every place. The join is left to the optimizer: it broadcasts the
    passages' side only where it measures it as small.
    """

    def grams(rows: DataFrame, key: str) -> DataFrame:
        w = F.col("w")
        starts = F.when(F.size(w) >= words, F.sequence(F.lit(1), F.size(w) - words + 1))
        hashed = F.array_distinct(F.transform(starts, lambda i: F.xxhash64(F.slice(w, i, words))))
        return rows.select(key, T.words(F.col("text")).alias("w")).select(key, F.explode(hashed).alias("gram"))

    return grams(docs, "doc_id").join(grams(passages, "item_id").distinct(), "gram").groupBy("doc_id", "item_id").agg(F.count("*").alias("shared"))
