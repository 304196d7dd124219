"""Lookups in which no key is hot."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .settled import settle


#: Rows of one part of a table that is dealt for its size.
PART_ROWS = 500_000


def parts_of(rows: int) -> int:
    """Parts to deal so many rows to, so that a task's memory does not grow with them."""
    return max(SparkSession.active().sparkContext.defaultParallelism, -(-rows // PART_ROWS))


def hot_keys(counted: DataFrame, total: int) -> DataFrame:
    """The rows of `counted` whose `copies` make a key hot: more than a
    hundred-thousandth of `total` rows, and 1,000 at least. There are fewer than
    100,000 of them however many rows there are."""
    return counted.filter(F.col("copies") > max(1000, total // 100_000))


def lookup(rows: DataFrame, table: DataFrame, key: str, hot: DataFrame | None = None) -> DataFrame:
    """Inner join with a `table` that has each key once. Hot keys (see `hot_keys`)
    are broadcast, and only the other keys meet in a shuffle. `hot` (the key
    column alone) is for callers that have counted already."""
    if hot is None:
        hot = settle(hot_keys(rows.groupBy(key).agg(F.count("*").alias("copies")), rows.count()).select(key))
        if hot.isEmpty():
            return rows.join(table, key)
    few = table.join(F.broadcast(hot), key)
    return rows.join(F.broadcast(few), key).unionByName(rows.join(F.broadcast(hot), key, "left_anti").join(table, key))


def dealt(rows: DataFrame, table: DataFrame, keys: list[str]) -> DataFrame:
    """Inner join of many with many in which no key of `rows` is hot: rows of a hot
    key (see `hot_keys`) are dealt in parts, and each part meets a copy of what
    `table` has for the key."""
    total = rows.count()
    hot = hot_keys(rows.groupBy(*keys).agg(F.count("*").alias("copies")), total)
    hot = settle(hot.select(*keys, F.ceil(F.col("copies") / max(1000, total // 100_000)).cast("int").alias("parts")))
    if hot.isEmpty():
        return rows.join(table, keys)
    parts = F.coalesce("parts", F.lit(1))
    part = F.pmod(F.xxhash64(*rows.columns), parts).cast("int")
    left = rows.join(F.broadcast(hot), keys, "left").withColumn("part", part).drop("parts")
    right = table.join(F.broadcast(hot), keys, "left").withColumn("part", F.explode(F.sequence(F.lit(0), parts - 1))).drop("parts")
    return left.join(right, [*keys, "part"]).drop("part")
