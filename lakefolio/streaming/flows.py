"""Structured Streaming flows: registration once, batches with a bounded wait, throttling."""

from __future__ import annotations

import re
from collections.abc import Iterator
from uuid import uuid4

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.settled import shared_folder

#: Later than any row: what closes the windows of a stream that has ended.
END = "2200-01-01"


def source(spark: SparkSession, path: str, batch: str | None = None) -> DataFrame:
    """A Parquet table, one file or a folder of them, as a stream of its files.

    batch: bytes of the files of a micro-batch ("1g"), for streams whose files
    come in the order of time; without it, what is there is one micro-batch, and
    no row of a table in another order is late.

    A stream takes a single file only as a pattern, so the last letter is one;
    signs of patterns in the path stand for themselves.
    """
    path = path.rstrip("/")
    pattern = re.sub(r"([\[\]{}*?\\])", r"\\\1", path[:-1]) + f"[{path[-1]}]"
    reader = spark.readStream.schema(spark.read.parquet(path).schema)
    return (reader.option("maxBytesPerTrigger", batch) if batch else reader).parquet(pattern)


def ended(stream: DataFrame, time: str) -> DataFrame:
    """The stream and one more row, null but for a time after all others, which
    moves the watermark past every open window. A table that is read to its end
    has no later rows to do that."""
    spark = stream.sparkSession
    last = f"{shared_folder(spark).rstrip('/')}/{uuid4().hex}"
    fields = [F.lit(END if f.name == time else None).cast(f.dataType).alias(f.name) for f in stream.schema.fields]
    spark.range(1, numPartitions=1).select(*fields).write.parquet(last)
    return stream.unionByName(spark.readStream.schema(stream.schema).parquet(last))


def drain(stream: DataFrame) -> DataFrame:
    """Runs what is there through the stream and returns what it wrote.

    State and output lie in the folder of spark.checkpoint.dir; the file sink
    commits each batch once.
    """
    spark = stream.sparkSession
    folder = f"{shared_folder(spark).rstrip('/')}/{uuid4().hex}"
    writer = stream.writeStream.outputMode("append").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True)
    writer.format("parquet").option("path", f"{folder}/rows").start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{folder}/rows")


def once(events: DataFrame, key: list[str], time: str, wait: str = "1 hour") -> DataFrame:
    """Deliveries that repeat a key within `wait` are dropped, the state with it."""
    return events.withWatermark(time, wait).dropDuplicatesWithinWatermark(key)


def batches(events: DataFrame, key: str, time: str, gap: str = "10 minutes", wait: str = "20 minutes") -> DataFrame:
    """(key, start, end, n): rows closer than `gap` form a batch, which comes out,
    and leaves the state, once the watermark has passed it. See `ended`."""
    window = F.session_window(time, gap)
    out = events.withWatermark(time, wait).groupBy(key, window.alias("batch")).agg(F.count("*").alias("n"), F.max(time).alias("end"))
    return out.select(key, F.col("batch.start").alias("start"), "end", "n")


def throttle(failures: DataFrame, key: str, time: str, limit: int = 5, seconds: int = 900, wait: str = "1 hour") -> DataFrame:
    """(key, start, locked_at): windows that reach `limit` failures.

    A window starts with the first failure after the one before ran out, which is
    not what a tumbling window does. Failures of a key are counted in time order
    within a micro-batch, whose files bound what a key holds: eight bytes a
    failure. The state is one small row a key, removed when the watermark passes
    the window's end; failures older than the watermark are not counted. A null
    key is a key.
    """
    kind = dict(failures.dtypes)[key]

    def run(keys: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        start, count = state.get if state.exists else (0, 0)
        passed, found = state.getCurrentWatermarkMs(), []
        micros = np.sort(np.concatenate([f["micros"].to_numpy() for f in frames]))
        for at in micros[micros >= passed * 1000].tolist():
            if count == 0 or at >= start + seconds * 1_000_000:
                start, count = at, 0
            count += 1
            if count == limit:
                found.append((keys[0], start, at))
        end = start // 1000 + seconds * 1000
        if count and end > passed:
            state.update((start, count))
            state.setTimeoutTimestamp(end)
        elif state.exists:
            state.remove()
        yield pd.DataFrame(found, columns=[key, "start", "locked_at"])

    rows = failures.withColumn(time, F.col(time).cast("timestamp_ltz")).withWatermark(time, wait).select(key, time, F.unix_micros(time).alias("micros"))
    schema = f"`{key}` {kind}, start long, locked_at long"
    out = rows.groupBy(key).applyInPandasWithState(run, schema, "start long, count long", "append", GroupStateTimeout.EventTimeTimeout)
    return out.select(key, *(F.timestamp_micros(c).alias(c) for c in ("start", "locked_at")))
