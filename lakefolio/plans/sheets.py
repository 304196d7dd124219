"""Queries over scanned sheets: word cells with trembling places, in no order."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import layout
from ..sources.tables import scan
from .book import query

#: Words on a sheet's line, and the word from which every third line is a second column.
WORDS, SECOND = 8, 4
#: The sheet's words, eight a line; `line` and `place` are what a scan has lost.
_WORDS_SQL = f"""w AS (SELECT doc_id, unnest(words) AS word, generate_subscripts(words, 1) - 1 AS n FROM (SELECT doc_id, list_filter(regexp_split_to_array(text, '[ \\t\\n\\x0B\\f\\r]+'), lambda x: x <> '') AS words FROM documents)),
  p AS (SELECT doc_id, word, n, CAST(n // {WORDS} AS INTEGER) AS line, CAST(CASE WHEN (n // {WORDS}) % 3 = 0 AND n % {WORDS} >= {SECOND} THEN 1 ELSE 0 END AS INTEGER) AS segment FROM w)"""


def cells(spark: SparkSession, folder: str) -> DataFrame:
    """A document as the cells of one sheet: lines are 20 apart and tremble by 2
    up or down; every third line has two columns."""
    words = F.filter(F.split("text", r"[ \t\n\x0B\f\r]+"), lambda w: w != "")
    rows = scan(spark, folder, "documents").select("doc_id", F.posexplode(words).alias("n", "text"))
    line, place = F.floor(F.col("n") / WORDS), F.col("n") % WORDS
    apart = F.when((line % 3 == 0) & (place >= SECOND), 500).otherwise(0)
    tremble = F.pmod(F.xxhash64("doc_id", "n"), F.lit(5)) - 2
    x0, y0 = place * 400 + apart, line * 20 + tremble
    return rows.select("doc_id", "text", x0.alias("x0"), (x0 + 390).alias("x1"), y0.alias("y0"), (y0 + 10).alias("y1"), F.lit(0.9).alias("confidence"))


@query(f"""WITH {_WORDS_SQL} SELECT doc_id, line, segment, string_agg(word, ' ' ORDER BY n) AS text FROM p GROUP BY ALL""")
def sheet_lines(spark: SparkSession, folder: str) -> DataFrame:
    """All lines of all sheets, put together from their cells."""
    return layout.lines_of_cells(cells(spark, folder), ["doc_id"]).select("doc_id", "line", "segment", "text")


@query(f"""
WITH {_WORDS_SQL}, s AS (SELECT doc_id, line, segment, string_agg(word, ' ' ORDER BY n) AS text FROM p GROUP BY ALL)
SELECT doc_id, md5(string_agg(text, chr(10) ORDER BY segment, line)) AS digest FROM s GROUP BY 1""")
def sheet_texts(spark: SparkSession, folder: str) -> DataFrame:
    """The sheets' texts, column after column."""
    lines = layout.lines_of_cells(cells(spark, folder), ["doc_id"])
    return layout.reading_order(lines, ["doc_id"]).select("doc_id", F.md5("text").alias("digest"))


@query(f"""
WITH {_WORDS_SQL}, s AS (SELECT doc_id, line, segment, string_agg(word, ' ' ORDER BY n) AS text FROM p GROUP BY ALL)
SELECT doc_id, place, text FROM (SELECT doc_id, text, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY line, segment) AS INTEGER) AS place FROM s) WHERE place <= 12""")
def sheet_heads(spark: SparkSession, folder: str) -> DataFrame:
    """The first lines of every sheet."""
    lines = layout.lines_of_cells(cells(spark, folder), ["doc_id"])
    return layout.first_lines(lines, ["doc_id"]).select("doc_id", "place", "text")
