"""Rows computed once, and the folder they are written to."""

from __future__ import annotations

import tempfile
from collections.abc import Iterator
from contextlib import contextmanager
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession

#: Spark's switch by which the shuffle files of a query go when it has run.
_FREED = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def freed(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of the queries that are made and run inside go at their end,
    in place of when the driver happens to collect its garbage."""
    before = spark.conf.get(_FREED, "false")
    spark.conf.set(_FREED, "true")
    try:
        yield
    finally:
        spark.conf.set(_FREED, before)


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir.

    Only a local session, whose tasks run in the driver, gets a folder of its
    own where that is unset; elsewhere every machine would have its own.
    """
    context = spark.sparkContext
    named = context.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
    if named:
        return named
    if not context.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all machines share")
    return tempfile.mkdtemp(prefix="shared-")


def _shared(spark: SparkSession) -> str:
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_folder(spark))
    return context.getCheckpointDir()


def settle(df: DataFrame) -> DataFrame:
    """`df` computed once, in the folder of spark.checkpoint.dir; cuts its lineage.
    The shuffle files that it took are gone afterwards."""
    _shared(df.sparkSession)
    with freed(df.sparkSession):
        return df.select("*").checkpoint(eager=True)  # a query of its own, so that no other's files go


def stored(df: DataFrame) -> DataFrame:
    """As `settle`, but in Parquet files, which hold rows of a few numbers in a
    small part of a checkpoint's bytes. They stay until `drop`."""
    path = f"{_shared(df.sparkSession).rstrip('/')}/{uuid4().hex}"
    with freed(df.sparkSession):
        df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop(*tables: DataFrame) -> None:
    """Deletes the files of tables from `settle` and `stored` that nothing reads any more."""
    for table in tables:
        spark, plan = table.sparkSession, table._jdf.queryExecution().logical()
        files = [plan.rdd().getCheckpointFile().get()] if plan.nodeName() == "LogicalRDD" else [f.rpartition("/")[0] for f in table.inputFiles()[:1]]
        for file in files:
            path = spark._jvm.org.apache.hadoop.fs.Path(file)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
