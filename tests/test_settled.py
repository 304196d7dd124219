"""What rows that are computed once leave on disk."""

import os
import time

from pyspark.sql import functions as F

from lakefolio.operators.settled import drop, freed, settle, stored


def shuffled(spark):
    """Shuffle files on this machine's disk."""
    names = spark.sparkContext._jsc.sc().env().blockManager().diskBlockManager().getAllFiles().mkString("\n").split("\n")
    return sum("shuffle_" in name and name.endswith(".data") for name in names)


def gone(spark, most):
    """Whether there are `most` shuffle files or fewer; they go in the background."""
    for _ in range(50):
        if shuffled(spark) <= most:
            return True
        time.sleep(0.1)


def test_shuffle_files_go_when_rows_are_settled(spark):
    """They stayed until the driver collected its garbage, those of all steps of a query at once."""
    rows = spark.range(100_000).groupBy((F.col("id") % 1000).alias("k")).agg(F.count("*").alias("n"))
    few = rows.join(spark.range(5000).select((F.col("id") % 10).alias("k")).distinct(), "k").orderBy("k")
    before = shuffled(spark)
    kept = settle(few)
    assert [tuple(r) for r in kept.collect()] == [(k, 100) for k in range(10)] == [tuple(r) for r in few.collect()]
    other = shuffled(spark)  # those of the collected query stay
    again = settle(few)
    assert other > before and gone(spark, other) and again.count() == 10


def test_shuffle_files_go_when_rows_are_written(spark, tmp_path):
    before = shuffled(spark)
    with freed(spark):
        spark.range(1000).repartition(3, "id").write.parquet(f"{tmp_path}/rows")
    assert gone(spark, before) and spark.read.parquet(f"{tmp_path}/rows").count() == 1000


def test_tables_are_dropped(spark):
    rows = spark.range(30).selectExpr("id", "named_struct('a', id % 2, 'b', ARRAY(id)) AS s", "CAST(NULL AS STRING) AS t")
    for make in (settle, stored):
        kept = make(rows)
        assert kept.dtypes == rows.dtypes and sorted(kept.collect()) == sorted(rows.collect())
        folder = kept.inputFiles()[0].rpartition("/")[0] if make is stored else kept._jdf.queryExecution().logical().rdd().getCheckpointFile().get()
        folder = folder.replace("file:", "").replace("///", "/")
        assert os.path.isdir(folder)
        drop(kept)
        assert not os.path.exists(folder)
        assert make(rows.limit(0)).count() == 0
