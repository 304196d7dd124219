"""Vector best-fit packing of tokenised documents into training sequences.

A sequence has three capacities: tokens, documents and attention cost (the sum
of squared piece lengths). Pieces are taken by decreasing length; among the
open sequences where a piece fits under every capacity, the one chosen has the
largest weighted dot product of demand and residual (`rule="dot"`) or leaves the
smallest weighted residual norm (`rule="norm"`). A piece that fits nowhere opens
a sequence. Pieces as long as the capacity are sequences by themselves and never
take part; of the rest a document has at most one, so dealing the documents to
groups of about `group_rows` bounds what a task packs, and the loss is a
sequence or two a group.
"""

from __future__ import annotations

import zlib
from array import array
from collections.abc import Iterator
from functools import cache
from math import ceil

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, settle, trimmed
from .words import KEPT, Cutter, WordEncoder, byte_letters, in_slices

_PIECES = "id string, piece int, start long, length long, ids_crc32 long"


@cache
def _library_encoder(path: str, kept: int = KEPT) -> WordEncoder:
    from tokenizers import Tokenizer

    cutter, tokenize = Cutter(path), Tokenizer.from_file(path).model.tokenize
    letters = byte_letters()
    ascii_letters = {c for c in letters if c.isascii()}

    def encode(parts: list[str]) -> list[bytes]:
        """The library's BPE of pre-tokens, whose bytes it takes as letters."""
        out = []
        for part in parts:
            if not ascii_letters.issuperset(part):
                part = "".join([letters[b] for b in part.encode("utf-8", "surrogatepass")])
            out.append(array("I", [t.id for t in tokenize(part)]).tobytes())
        return out

    return WordEncoder(cutter, encode, kept)


def pieces(docs: DataFrame, tokenizer: str, capacity: int = 2048, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text", kept: int = KEPT) -> DataFrame:
    """(id, piece, start, length, ids_crc32) of every document's pieces.

    A document is its ids and `end_id`; only one longer than `capacity` is cut.
    Null texts are empty: one piece that holds `end_id` alone. A worker keeps the
    ids of about `kept` words: fewer take less memory and more time.
    """
    bounded_batches(docs.sparkSession)
    tail = np.array([end_id], "<u4").tobytes()
    kind = pa.schema([("id", pa.string()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _library_encoder(tokenizer, kept)
        for docs, texts in in_slices(batches):
            rows = []
            for doc, ids in zip(docs, encoder.texts(texts)):
                ids += tail
                for n, low in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[low : low + 4 * capacity]
                    rows.append((doc, n, low // 4, len(part) // 4, zlib.crc32(part)))
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), kind)], schema=kind)

    texts = docs.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).alias("text"))
    out = texts.mapInArrow(trimmed(run), _PIECES)
    return out.select(F.col("id").cast(docs.schema[id_col].dataType).alias(id_col), "piece", "start", "length", "ids_crc32")


def best_fit(lengths: np.ndarray, capacity: int, max_docs: int, max_cost: int, weights: tuple[float, float, float], rule: str) -> np.ndarray:
    """The bin of each piece; lengths must not increase. A piece that breaks a
    capacity alone still gets a bin of its own."""
    caps, scale = np.array([capacity, max_docs, max_cost], np.int64), np.array(weights, float)
    free, name = np.empty((1024, 3), np.int64), np.empty(1024, np.int64)
    used, bins, out = 0, 0, np.empty(len(lengths), np.int64)
    for i, length in enumerate(lengths):
        need = np.array([length, 1, length * length], np.int64)
        now = free[:used]
        fits = np.flatnonzero((now >= need).all(axis=1))
        if len(fits):
            rest, share = now[fits] / caps, need / caps
            value = rest @ (scale * share) if rule == "dot" else -(((rest - share) ** 2) @ scale)
            at = fits[value.argmax()]
        else:
            if used == len(free):
                free, name = np.concatenate([free, np.empty_like(free)]), np.concatenate([name, np.empty_like(name)])
            at = used
            free[at], name[at] = caps, bins
            used, bins = used + 1, bins + 1
        out[i] = name[at]
        free[at] -= need
        if (free[at, :2] < 1).any() or free[at, 2] < 1:  # nothing more fits
            used -= 1
            free[at], name[at] = free[used], name[used]
    return out


def pack(rows: DataFrame, groups: int, capacity: int = 2048, max_docs: int = 2048, max_cost: int = 2048**2, weights: tuple[float, float, float] = (1.0, 1e-3, 1e-3), rule: str = "norm", id_col: str = "doc_id") -> DataFrame:
    """Adds `sequence_id` and `offset` to rows of `pieces`.

    Offsets have no gaps from 0. Repeated rows are pieces of their own. Equal
    lengths are taken by id and piece.
    """
    if rule not in ("dot", "norm"):
        raise ValueError(f"unknown rule {rule!r}")
    rows = settle(rows)
    full = rows.filter(F.col("length") >= capacity).withColumns({"sequence_id": F.monotonically_increasing_id(), "offset": F.lit(0).cast("long")})
    group = F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(groups))
    rest = rows.filter(F.col("length") < capacity).withColumn("group", group)

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["length", id_col, "piece"], ascending=[False, True, True], kind="stable").reset_index(drop=True)
        bins = best_fit(frame["length"].to_numpy(), capacity, max_docs, max_cost, weights, rule)
        frame["sequence_id"] = -1 - ((frame["group"].to_numpy(np.int64) << 32) + bins)
        frame["offset"] = frame.groupby("sequence_id")["length"].cumsum() - frame["length"]
        return frame.drop(columns="group")

    kind = rows.schema[id_col].dataType.simpleString()
    schema = f"`{id_col}` {kind}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
    return full.unionByName(rest.groupBy("group").applyInPandas(run, schema))


def pack_documents(docs: DataFrame, tokenizer: str, capacity: int = 2048, group_rows: int = 32768, id_col: str = "doc_id", kept: int = KEPT, **options) -> DataFrame:
    """Tokenises and packs whole documents; see `pieces` and `pack`. An empty
    table gives an empty result; columns beside id and text are ignored."""
    groups = max(1, ceil(docs.count() / group_rows))
    return pack(pieces(docs, tokenizer, capacity, id_col=id_col, kept=kept), groups, capacity, id_col=id_col, **options)
