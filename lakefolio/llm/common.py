"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.settled import settle, shared_folder
from ..operators.skew import hot_keys, lookup

__all__ = ["BATCH_BYTES", "SPACE", "WORD", "bounded_batches", "held_out", "hot_keys", "lookup", "settle", "shared_folder", "table", "trimmed"]

#: ASCII white space: a word is a run of anything else.
SPACE = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"
#: Bytes of an Arrow batch between the JVM and Python; a longer row is one batch.
BATCH_BYTES = 4 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def trimmed(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """`run` over a task's batches, after which the Python worker gives back the
    memory that Arrow's pool and the allocator hold free. Workers outlive tasks."""

    def and_trim(batches: Iterator) -> Iterator:
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            try:
                ctypes.CDLL(None).malloc_trim(0)
            except (AttributeError, OSError):  # another libc
                pass

    return and_trim


def bounded_batches(spark: SparkSession) -> None:
    """Let the session send texts to Python in Arrow batches of few bytes.

    Rows differ in size by orders of magnitude; a bound in rows alone would let a
    task hold as many long texts as it allows short ones, in both processes.
    """
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)


def held_out(doc_id="doc_id"):
    """True for the third of the documents that no model may learn from.

    A null id belongs to no fold and is treated as held out.
    """
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 3 == 1, F.lit(True))
