"""BPE encoding by a segment tree over adjacent pair ranks, and decoding.

A word's symbols are the leaves of a segment tree; leaf i holds the rank of the
pair of symbol i and its right neighbour, and a node the smallest (rank, place)
below it. The root is the leftmost merge of the lowest rank. A merge changes
three leaves, each by a point update in logarithmic time, until the root holds
no mergeable pair. Words of one tree size are encoded together: the trees are
rows of one array per level and every step is done for all of them.
"""

from __future__ import annotations

import hashlib
from array import array
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, trimmed
from .words import Cutter, WordEncoder, byte_letters, in_slices, specification

_NONE = np.int64(1) << 60


class Bpe:
    """A vocabulary file with byte-level symbols, a suffix at the end of words,
    NFC and lower-casing before, and special tokens that are found verbatim."""

    def __init__(self, path: str):
        self.cutter = Cutter(path)
        model = specification(path)["model"]
        vocab, suffix = model["vocab"], model["end_of_word_suffix"] or ""
        self.names = {i: t for t, i in {**vocab, **self.cutter.special}.items()}
        letters = byte_letters()
        self.inner = np.array([vocab[c] for c in letters], np.int64)
        self.last = np.array([vocab[c + suffix] for c in letters], np.int64)
        pairs = [(vocab[a], vocab[b], vocab[a + b]) for a, b in model["merges"]]
        self.merged = np.array([p[2] for p in pairs], np.int64)
        self.ranks = {(a, b): rank for rank, (a, b, _) in reversed(list(enumerate(pairs)))}
        codes = np.array([(a << 32) | b for a, b in self.ranks], np.int64)
        order = codes.argsort()
        self.codes, self.code_ranks = codes[order], np.array(list(self.ranks.values()), np.int64)[order]

    def rank_of(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        code = (a << 32) | b
        at = np.minimum(np.searchsorted(self.codes, code), len(self.codes) - 1)
        return np.where(self.codes[at] == code, self.code_ranks[at], _NONE)

    def encode_parts(self, parts: list[str]) -> list[bytes]:
        raw = [p.encode("utf-8", "surrogatepass") for p in parts]
        out: list[bytes] = [b""] * len(raw)
        sizes = np.array([len(r) for r in raw], np.int64)
        wide = np.maximum(2, 1 << np.ceil(np.log2(np.maximum(sizes, 1))).astype(np.int64))
        for width in np.unique(wide):
            at = np.flatnonzero(wide == width)
            step = max(1, (1 << 20) // int(width))
            for low in range(0, len(at), step):
                some = at[low : low + step]
                if width > 1024:
                    for i in some:
                        out[i] = self._one(raw[i])
                else:
                    for i, ids in zip(some, self._many([raw[i] for i in some], int(width))):
                        out[i] = ids
        return out

    def _many(self, raw: list[bytes], width: int) -> list[bytes]:
        rows, sizes = np.arange(len(raw)), np.array([len(r) for r in raw], np.int64)
        filled = np.frombuffer(b"".join([r.ljust(width, b"\0") for r in raw]), np.uint8).reshape(-1, width)
        symbol = self.inner[filled]
        symbol[rows, sizes - 1] = self.last[filled[rows, sizes - 1]]
        place = np.arange(width)
        alive = place < sizes[:, None]
        after, before = np.tile(place + 1, (len(raw), 1)), np.tile(place - 1, (len(raw), 1))
        rank = self.rank_of(symbol[:, :-1], symbol[:, 1:])
        leaves = np.full((len(raw), width), _NONE)
        leaves[:, :-1] = np.where((rank < _NONE) & alive[:, 1:], rank * width + place[:-1], _NONE)
        levels = [leaves]
        while levels[-1].shape[1] > 1:
            levels.append(np.minimum(levels[-1][:, 0::2], levels[-1][:, 1::2]))

        def update(row: np.ndarray, at: np.ndarray, value: np.ndarray) -> None:
            levels[0][row, at] = value
            for below, level in zip(levels, levels[1:]):
                at = at >> 1
                level[row, at] = np.minimum(below[row, 2 * at], below[row, 2 * at + 1])

        row = rows
        while True:
            best = levels[-1][row, 0]
            row, best = row[best < _NONE], best[best < _NONE]
            if not len(row):
                break
            rank, at = best // width, best % width
            gone = after[row, at]
            nearest = after[row, gone]
            new = self.merged[rank]
            symbol[row, at] = new
            alive[row, gone] = False
            after[row, at] = nearest
            inside = nearest < sizes[row]
            before[row[inside], nearest[inside]] = at[inside]
            update(row, gone, np.full(len(row), _NONE))
            right = np.full(len(row), _NONE)
            found = self.rank_of(new[inside], symbol[row[inside], nearest[inside]])
            right[inside] = np.where(found < _NONE, found * width + at[inside], _NONE)
            update(row, at, right)
            has = before[row, at] >= 0
            some, left = row[has], before[row, at][has]
            found = self.rank_of(symbol[some, left], new[has])
            update(some, left, np.where(found < _NONE, found * width + left, _NONE))
        flat, ends = symbol[alive].astype("<u4").tobytes(), 4 * np.cumsum(alive.sum(axis=1))
        return [flat[a:b] for a, b in zip([0, *ends[:-1].tolist()], ends.tolist())]

    def _one(self, raw: bytes) -> bytes:
        """The same tree for one long word, in flat arrays of 64 bits."""
        n = len(raw)
        width = 1 << (n - 1).bit_length()
        letters = np.frombuffer(raw, np.uint8)
        start = np.append(self.inner[letters[:-1]], self.last[letters[-1]])
        leaves = np.full(width, _NONE)
        rank = self.rank_of(start[:-1], start[1:])
        leaves[: n - 1] = np.where(rank < _NONE, rank * width + np.arange(n - 1), _NONE)
        levels = [leaves]
        while len(levels[-1]) > 1:
            levels.append(np.minimum(levels[-1][0::2], levels[-1][1::2]))
        tree = array("q", np.concatenate([[0], *levels[::-1]]).tobytes())
        symbol, after, before = (array("q", x.tobytes()) for x in (start, np.arange(1, n + 1), np.arange(-1, n - 1)))
        none, merged, ranks = int(_NONE), array("q", self.merged.tobytes()), self.ranks

        def update(i: int, value: int) -> None:
            """Sets leaf i; stops where a node keeps its value."""
            i += width
            tree[i] = value
            while i > 1:
                i >>= 1
                low, high = tree[2 * i], tree[2 * i + 1]
                low = low if low < high else high
                if tree[i] == low:
                    break
                tree[i] = low

        def leaf(i: int) -> int:
            rank = ranks.get((symbol[i], symbol[after[i]])) if after[i] < n else None
            return none if rank is None else rank * width + i

        while tree[1] < none:
            rank, i = divmod(tree[1], width)
            gone = after[i]
            symbol[i], after[i] = merged[rank], after[gone]
            if after[i] < n:
                before[after[i]] = i
            symbol[gone] = -1
            update(gone, none)
            update(i, leaf(i))
            if before[i] >= 0:
                update(before[i], leaf(before[i]))
        out = np.frombuffer(symbol, np.int64)
        return out[out >= 0].astype("<u4").tobytes()

    def decode(self, ids: bytes) -> str:
        """The ids' strings with spaces between; unknown ids are left out."""
        names = self.names
        return " ".join([names[i] for i in np.frombuffer(ids, "<u4").tolist() if i in names])


@cache
def _encoder(path: str) -> tuple[Bpe, WordEncoder]:
    bpe = Bpe(path)
    return bpe, WordEncoder(bpe.cutter, bpe.encode_parts)


def encode(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_tokens, ids): `ids` as little-endian unsigned 32-bit integers.

    A null or empty text has no ids. Rows stay as they are, repeated ones too.
    """
    return _run(docs, vocabulary, id_col, text_col, "n_tokens long, ids binary", lambda bpe, ids: (len(ids) // 4, ids))


def digests(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_tokens, ids_sha256, decoded_sha256) of encoding and decoding again."""

    def row(bpe: Bpe, ids: bytes):
        decoded = bpe.decode(ids).encode("utf-8", "surrogatepass")
        return len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(decoded).hexdigest()

    return _run(docs, vocabulary, id_col, text_col, "n_tokens long, ids_sha256 string, decoded_sha256 string", row)


def _run(docs: DataFrame, vocabulary: str, id_col: str, text_col: str, schema: str, row) -> DataFrame:
    bounded_batches(docs.sparkSession)
    names = [part.split()[0] for part in schema.split(", ")]
    types = {"long": pa.int64(), "binary": pa.binary(), "string": pa.string()}
    kind = pa.schema([("id", pa.string()), *((n, types[part.split()[1]]) for n, part in zip(names, schema.split(", ")))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe, encoder = _encoder(vocabulary)
        for docs, texts in in_slices(batches):
            rows = [row(bpe, ids) for ids in encoder.texts(texts)]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip((docs, *zip(*rows)), kind)], schema=kind)

    texts = docs.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).alias("text"))
    out = texts.mapInArrow(trimmed(run), f"id string, {schema}")
    return out.select(F.col("id").cast(docs.schema[id_col].dataType).alias(id_col), *names)
