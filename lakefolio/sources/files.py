"""Intake of files: what they are, what they hash to, and registration once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T

# The first bytes of the formats that are taken, in hexadecimal digits.
MAGIC = {"png": "89504E470D0A1A0A", "jpeg": "FFD8FF", "tiff": "49492A00", "tiff-be": "4D4D002A", "bmp": "424D", "gif": "47494638"}
PDF = "255044462D"
MAX_PARTS, MAX_BYTES = 500, 200 << 20


def files(spark: SparkSession, folder: str, pattern: str = "*") -> DataFrame:
    """(path, modificationTime, length, content) of a folder's files.

    The scan leaves empty files out, which intake would reject.
    """
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(folder)


def content_type(content: Column) -> Column:
    """The format by its bytes, never by its name; null for others.

    A PDF may have up to 1,024 bytes before its mark.
    """
    head = F.substring(content, 1, 1024)
    start = F.hex(F.substring(content, 1, 16))
    out = F.when(F.contains(head, F.lit(bytes.fromhex(PDF))), "pdf")
    for name, magic in MAGIC.items():
        out = out.when(start.startswith(magic), name.split("-")[0])
    return out.when(start.startswith("52494646") & (F.substring(start, 17, 8) == "57454250"), "webp")


def parts(rows: DataFrame, key: bytes) -> DataFrame:
    """Adds `kind` and `digest`, the keyed hash of the content; empty files and
    unknown formats have a null kind."""
    block = key.ljust(64, b"\0")
    inner, outer = (F.lit(bytes(b ^ pad for b in block)) for pad in (0x36, 0x5C))
    digest = F.sha2(F.concat(outer, F.unhex(F.sha2(F.concat(inner, F.col("content")), 256))), 256)
    return rows.withColumns({"kind": F.when(F.col("length") > 0, content_type(F.col("content"))), "digest": digest})


def scans(pages: DataFrame, scan_id: str, position: str, key: bytes, newest: str) -> DataFrame:
    """(scan_id, parts, missing, complete, scan_hash) of pages sent one by one.

    pages: scan_id, position, kind, digest and a time. A page sent again replaces
    the earlier one (ties by digest). A scan is complete when no position from 1
    to its last is missing and it has at most `MAX_PARTS` pages.
    """
    order = Window.partitionBy(scan_id, position).orderBy(F.desc(newest), F.desc("digest"))
    last = pages.filter(F.col(position) >= 1).withColumn("_place", F.row_number().over(order)).filter("_place = 1")
    count = last.groupBy(scan_id).agg(F.count("*").alias("parts"), F.max(position).cast("int").alias("high"), F.array_sort(F.collect_list(F.struct(F.col(position).cast("int").alias("position"), F.concat_ws(":", "kind", "digest").alias("part")))).alias("every"))
    missing = F.array_except(F.sequence(F.lit(1), F.col("high")), F.transform("every", lambda x: x["position"]))
    text = F.concat_ws("|", F.lit("scan parts"), F.array_join(F.transform("every", lambda x: x["part"]), "|"))
    return count.select(scan_id, "parts", missing.alias("missing"), ((F.size(missing) == 0) & (F.col("parts") <= MAX_PARTS)).alias("complete"), T.keyed_hash(text, key).alias("scan_hash"))


def register(new: DataFrame, known: DataFrame, digest: str = "digest", first: str = "path") -> DataFrame:
    """The rows of `new` whose digest is not `known`, one a digest, the smallest `first`."""
    fresh = new.join(known.select(digest).distinct(), digest, "left_anti")
    order = Window.partitionBy(digest).orderBy(first)
    return fresh.withColumn("_place", F.row_number().over(order)).filter("_place = 1").drop("_place")
