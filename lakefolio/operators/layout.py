"""Lines of text from the word cells of a scanned page.

Cells come in any order and their baselines tremble. A page's cells are swept from
top to bottom: a cell joins the open row while its centre is near the mean of the
row's centres, else it opens the next; that mean runs along, so it is a fold over
the page's cells and not a window. Rows are then read from left to right and cut
where a gap is wide for the height of the letters beside it: columns.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import fsum

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Distances of centres within a row: at least, and as a share of a cell's height.
NEAR, NEAR_HEIGHTS = 2.5, 0.6
#: Gaps between columns: at least, and as a share of the larger height beside.
GAP, GAP_HEIGHTS = 18.0, 2.2
#: Short segments that were read less surely than this are dust.
SURE, SHORT = 0.35, 4

LINES = "line int, segment int, text string, x0 double, y0 double, x1 double, y1 double, confidence double"


def rows_of(page: np.ndarray, centre: np.ndarray, height: np.ndarray) -> np.ndarray:
    """The row number in its page of every cell, for cells in order of page and centre."""
    out, at, row, total, n = np.empty(len(centre), np.int64), None, -1, 0.0, 0
    for i, (p, c, h) in enumerate(zip(page.tolist(), centre.tolist(), height.tolist())):
        if p != at:
            at, row, total, n = p, 0, c, 1
        elif abs(c - total / n) <= max(NEAR, h * NEAR_HEIGHTS):
            total, n = total + c, n + 1
        else:
            row, total, n = row + 1, c, 1
        out[i] = row
    return out


def _in_order(page: np.ndarray, centre: np.ndarray, x0: np.ndarray, text: list[str]) -> np.ndarray:
    """Cells by page, centre, left edge and text; texts are compared for ties alone."""
    order = np.lexsort((x0, centre, page))
    p, c, x = page[order], centre[order], x0[order]
    tied = np.flatnonzero((p[1:] == p[:-1]) & (c[1:] == c[:-1]) & (x[1:] == x[:-1]))
    for run in np.split(tied, np.flatnonzero(np.diff(tied) > 1) + 1) if len(tied) else ():
        some = slice(run[0], run[-1] + 2)
        order[some] = sorted(order[some].tolist(), key=text.__getitem__)
    return order


def _changes(cells: pa.Table, keys: int) -> np.ndarray:
    """Where another page begins behind the first cell; the keys are the first columns."""
    new = np.zeros(max(cells.num_rows - 1, 0), bool)
    for at in range(keys):
        codes = cells.column(at).combine_chunks().dictionary_encode(null_encoding="encode").indices.to_numpy()
        new |= codes[1:] != codes[:-1]
    return np.flatnonzero(new) + 1


def _lines(cells: pa.Table, keys: int) -> pa.Table:
    """The lines of whole pages, whose cells lie together."""
    page = np.zeros(cells.num_rows, np.int64)
    page[_changes(cells, keys)] = 1
    page = np.cumsum(page)
    text = [" ".join(t.split()) for t in cells.column("text").to_pylist()]
    order = np.flatnonzero(np.fromiter(map(bool, text), bool, len(text)))
    x0, y0, x1, y1, sure = (cells.column(c).to_numpy() for c in ("x0", "y0", "x1", "y1", "confidence"))
    centre, height = (y0 + y1) / 2, y1 - y0
    order = order[_in_order(page[order], centre[order], x0[order], [text[i] for i in order.tolist()])]
    line = rows_of(page[order], centre[order], height[order])
    across = np.lexsort((x0[order], line, page[order]))  # stable: of cells at one place the higher first
    line, order = line[across], order[across]
    page, x0, y0, x1, y1, sure, height = (a[order] for a in (page, x0, y0, x1, y1, sure, height))
    tall = np.maximum(np.maximum(height[1:], height[:-1]), 1.0)
    first = np.ones(len(order), bool)
    first[1:] = (page[1:] != page[:-1]) | (line[1:] != line[:-1])
    cut = np.zeros(len(order), bool)
    cut[1:] = ~first[1:] & (x0[1:] - x1[:-1] > np.maximum(GAP, tall * GAP_HEIGHTS))
    cuts = np.cumsum(cut)
    segment = cuts - cuts[np.maximum.accumulate(np.where(first, np.arange(len(order)), 0))]
    starts = np.flatnonzero(first | cut)
    spans = list(zip(starts.tolist(), [*starts[1:].tolist(), len(order)]))
    said, surely, some = [text[i] for i in order.tolist()], sure.tolist(), len(order) > 0
    out = {
        "line": line[starts].astype(np.int32), "segment": segment[starts].astype(np.int32), "text": [" ".join(said[a:b]) for a, b in spans],
        "x0": np.minimum.reduceat(x0, starts) if some else x0, "y0": np.minimum.reduceat(y0, starts) if some else y0, "x1": np.maximum.reduceat(x1, starts) if some else x1, "y1": np.maximum.reduceat(y1, starts) if some else y1,
        "confidence": [fsum(surely[a:b]) / (b - a) for a, b in spans],
    }
    kept = [i for i, (t, c) in enumerate(zip(out["text"], out["confidence"])) if c >= SURE or len(t) > SHORT]
    types = [pa.int32(), pa.int32(), pa.string(), *[pa.float64()] * 5]
    lines = pa.table([pa.array(v, t) for v, t in zip(out.values(), types)], names=list(out))
    of = cells.select(list(range(keys))).take(pa.array(order[starts]))
    return pa.table([*of.columns, *lines.columns], names=[*of.column_names, *lines.column_names]).take(pa.array(kept, pa.int64()))


def lines_of_cells(cells: DataFrame, keys: list[str]) -> DataFrame:
    """(*keys, line, segment, text, x0, y0, x1, y1, confidence) of cells (*keys,
    text, x0, y0, x1, y1, confidence), y growing downwards, a page for each value
    of the keys. Cells come sorted by page, and a batch of many pages is worked on
    at once; a task holds that and its open page.

    Cells without text or with a null place are left out, and white space inside
    is one blank; a null confidence is a sure one. Lines count from 0, segments
    from the left. Other columns are ignored; null keys are keys.
    """
    kinds, many = dict(cells.dtypes), len(keys)
    places = ["x0", "y0", "x1", "y1"]
    rows = cells.select(*keys, "text", *(F.col(c).cast("double").alias(c) for c in places), F.coalesce(F.col("confidence").cast("double"), F.lit(1.0)).alias("confidence"))
    rows = rows.dropna(subset=["text", *places])

    def of_pages(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []
        for batch in batches:
            table = pa.Table.from_batches([batch])
            last = held[-1].slice(held[-1].num_rows - 1) if held else table.slice(0, 0)
            begins = _changes(pa.concat_tables([last, table]), many) - last.num_rows
            if len(begins):
                yield from _lines(pa.concat_tables([*held, table.slice(0, begins[-1])]), many).to_batches()
                held, table = [], table.slice(begins[-1])
            if table.num_rows:
                held.append(table)
        if held:
            yield from _lines(pa.concat_tables(held), many).to_batches()

    return rows.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(of_pages, ", ".join(f"`{k}` {kinds[k]}" for k in keys) + ", " + LINES)


def reading_order(lines: DataFrame, keys: list[str]) -> DataFrame:
    """(*keys, text): a page's text, columns apart: the segments of one column,
    line by line, before those of the next."""
    ordered = F.array_sort(F.collect_list(F.struct("segment", "line", "text")))
    return lines.groupBy(*keys).agg(F.array_join(F.transform(ordered, lambda x: x["text"]), "\n").alias("text"))


def first_lines(lines: DataFrame, keys: list[str], most: int = 12) -> DataFrame:
    """The top `most` segments of every page, from the top and the left."""
    order = Window.partitionBy(*keys).orderBy("line", "segment")
    return lines.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= most)


def repeated(lines: DataFrame, document: str, page: str, least: int = 2) -> DataFrame:
    """(document, text, pages): segments that stand on `least` pages of a document
    or more at about the same height: running heads and feet."""
    high = F.round(F.col("y0") / 20).cast("long")
    return lines.groupBy(document, "text", high.alias("high")).agg(F.count_distinct(page).alias("pages")).filter(F.col("pages") >= least).select(document, "text", "high", "pages")
