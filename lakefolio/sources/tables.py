"""Scans of the archive's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Tables of long texts, whose rows cost far more to work on than to move.
TEXTS = ("documents", "pages")


def scan(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A Parquet table; filters and column choices reach the scan."""
    table = spark.read.parquet(f"{folder}/{name}.parquet")
    return spread(table) if name in TEXTS else table


def spread(table: DataFrame) -> DataFrame:
    """The rows dealt to all cores, where a table has fewer parts than would keep
    them busy: a small file is one row group, thus one task. Larger tables are
    read as they lie, without a shuffle; columns and filters reach the scan."""
    cores = table.sparkSession.sparkContext.defaultParallelism
    parts = table.select(F.lit(1)).rdd.getNumPartitions()
    return table.repartition(cores) if parts < 2 * cores else table
