"""SimHash near-duplicate classes through pivot distance tables.

Fingerprints are points of the 64-bit Hamming cube. The table of a fingerprint
is its distances to 56 reference fingerprints: eight base pivots, and for each
base pivot its six variants with one block of bits flipped. By the triangle
inequality two fingerprints at distance r differ by at most r in every
coordinate, so a pair whose largest coordinate difference exceeds r is discarded
without looking at the fingerprints; survivors are verified exactly.

All pairs are never enumerated to apply that test. The difference between the
distances to a pivot and to its variant is the distance inside one block, and
two fingerprints with at most three differing bits agree on three of the six
blocks, so all block coordinates of those blocks are equal. The 20 choices of
three blocks give 20 exact join keys (which pairs meet is thus a choice of equal
blocks, read off the table): every link shares one, and a random pair shares one
with a probability of about 20 / 2^31. The table of fingerprints that share a
key is computed where they meet, once a key, and all 56 coordinates are tested.

Copies of a fingerprint are folded into one row first. A key shared by more
than `RUN` distinct fingerprints is cut into chunks, and pairs of chunks are
compared in separate tasks, so no group is ever held whole; links are emitted
as spanning forests, never as all pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate, combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.graph import components
from .common import hot_keys, lookup, settle, trimmed

#: Largest number of fingerprints of one key that are compared in one step.
RUN = 4096
MAX_BITS = 3
_BLOCKS = (11, 11, 11, 11, 10, 10)


def _pivots(count: int = 8) -> list[int]:
    """Reference fingerprints: hashes of the numbers from 0."""
    return [xxhash.xxh64_intdigest(str(i).encode(), 7) for i in range(count)]


def _masks() -> list[int]:
    ends = list(accumulate(_BLOCKS))
    return [((1 << size) - 1) << (end - size) for size, end in zip(_BLOCKS, ends)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def fingerprint(text: str | None, shingle: int = 3) -> bytes:
    """Eight big-endian bytes; zero for a text without words."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return bytes(8)
    joined = b" ".join(words)
    if len(words) < shingle:
        return xxhash.xxh64_digest(joined, 42)
    starts = [0, *accumulate(len(w) + 1 for w in words)]
    digest, ones, n = xxhash.xxh64_digest, np.zeros(64, np.int64), len(words) - shingle + 1
    for low in range(0, n, 1 << 15):
        high = min(n, low + (1 << 15))
        hashes = b"".join([digest(joined[a : b - 1], 42) for a, b in zip(starts[low:high], starts[low + shingle : high + shingle])])
        ones += np.unpackbits(np.frombuffer(hashes, np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int32)
    return np.packbits(2 * ones > n).tobytes()


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3) -> DataFrame:
    """(id, fp): the fingerprint as a signed long. Null texts have no words."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            values = b"".join([fingerprint(t, shingle) for t in frame["text"]])
            yield pd.DataFrame({"id": frame["id"], "fp": np.frombuffer(values, ">i8").astype("int64")})

    rows = docs.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).alias("text"))
    out = rows.mapInPandas(trimmed(run), "id string, fp long")
    return out.select(F.col("id").cast(docs.schema[id_col].dataType).alias(id_col), "fp")


def pivot_table(points: DataFrame) -> DataFrame:
    """Adds to distinct `fp` rows `block0`..`block5`: for each block its eight
    coordinates, the distances to the base pivots inside the block, in four bits
    each."""
    fp, bases = F.col("fp"), _pivots()

    def distance(p: int):
        return F.bit_count(fp.bitwiseXOR(F.lit(_signed(p)))).cast("long")

    to_base = [distance(p) for p in bases]
    blocks = []
    for i, (mask, size) in enumerate(zip(_masks(), _BLOCKS)):
        code = F.lit(0).cast("long")
        for r, p in enumerate(bases):
            inside = F.shiftright(to_base[r] - distance(p ^ mask) + size, 1)
            code = code.bitwiseOR(F.shiftleft(inside, 4 * r))
        blocks.append(code.alias(f"block{i}"))
    return points.select("fp", *blocks)


def coordinates(fp: np.ndarray) -> np.ndarray:
    """The distances to all 56 reference fingerprints, the base pivots first."""
    bases = _pivots()
    pivots = np.array(bases + [p ^ mask for p in bases for mask in _masks()], np.uint64)
    return np.bitwise_count(fp.view(np.uint64)[:, None] ^ pivots)


def _compare(fp: np.ndarray, coords: np.ndarray, left: np.ndarray, right: np.ndarray, bits: int) -> np.ndarray:
    """Which of the index pairs link: coordinates first, then the bits."""
    keep = np.ones(len(left), bool)
    for some in (slice(0, 8), slice(8, None)):
        a, b = coords[left[keep], some], coords[right[keep], some]
        keep[keep] = (np.abs(a.astype(np.int8) - b.astype(np.int8)) <= bits).all(axis=1)
    keep[keep] = np.bitwise_count(fp[left[keep]] ^ fp[right[keep]]) <= bits
    return keep


def _forest(a: np.ndarray, b: np.ndarray) -> pd.DataFrame:
    """Each linked fingerprint with the smallest one it is joined to."""
    nodes, flat = np.unique(np.concatenate([a, b]), return_inverse=True)
    left, right = flat[: len(a)], flat[len(a) :]
    label = np.arange(len(nodes))
    while True:
        before = label.copy()
        low = np.minimum(label[left], label[right])
        np.minimum.at(label, left, low)
        np.minimum.at(label, right, low)
        label = label[label]
        if (label == before).all():
            break
    far = label != np.arange(len(nodes))
    return pd.DataFrame({"a": nodes[label[far]], "b": nodes[far]})


def _dense(fp: np.ndarray, coords: np.ndarray, rows: np.ndarray, cols: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Links between two sets of positions, a block of rows at a time."""
    left, right = [], []
    for low in range(0, len(rows), 64):
        some = rows[low : low + 64]
        i, j = np.repeat(some, len(cols)), np.tile(cols, len(some))
        keep = _compare(fp, coords, i, j, bits) & (fp[i] != fp[j])
        left.append(i[keep])
        right.append(j[keep])
    return np.concatenate(left), np.concatenate(right)


_SCAN = "hot boolean, key long, chunk int, a long, b long"  # of hot rows, a is the fingerprint


def _scan(bits: int, run: int):
    """Reads rows sorted by key; yields links, and the rows of keys that are too
    large to compare here, numbered by chunk."""

    def links(key: np.ndarray, fp: np.ndarray) -> pd.DataFrame:
        edge = np.flatnonzero(np.r_[True, key[1:] != key[:-1], True])
        shared = np.repeat(np.diff(edge) > 1, np.diff(edge))
        key, fp, left, right = key[shared], np.ascontiguousarray(fp[shared]), [], []
        coords = coordinates(fp)
        edge = np.flatnonzero(np.r_[True, key[1:] != key[:-1], True]) if len(key) else np.zeros(1, int)
        size = np.diff(edge)
        order = np.repeat(size, size)
        small = np.flatnonzero((order > 1) & (order <= 64))
        for step in range(1, int(order[small].max()) if len(small) else 0):
            i = small[(small + step) < len(key)]
            i = i[key[i] == key[i + step]]
            if not len(i):
                break
            keep = _compare(fp, coords, i, i + step, bits)
            left.append(i[keep])
            right.append(i[keep] + step)
        for at in np.flatnonzero(size > 64):
            span = np.arange(edge[at], edge[at + 1])
            i, j = _dense(fp, coords, span, span, bits)
            left.append(i)
            right.append(j)
        if not left:
            return pd.DataFrame({"a": np.empty(0, np.int64), "b": np.empty(0, np.int64)})
        return _forest(fp[np.concatenate(left)], fp[np.concatenate(right)])

    def hot_rows(key, fp, chunk: int) -> pd.DataFrame:
        return pd.DataFrame({"hot": True, "key": key, "chunk": chunk, "a": fp, "b": fp})

    def scan(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rest, hot, chunk = None, None, 0
        for frame in frames:
            key, fp = frame["key"].to_numpy(), frame["fp"].to_numpy()
            if rest is not None:
                key, fp = (np.concatenate(x) for x in zip(rest, (key, fp)))
            while True:
                if hot is not None:  # the rows of a large key go on
                    n = int(np.searchsorted(key, hot, side="right"))
                    whole = n // run * run if n == len(key) else n
                    for low in range(0, whole, run):
                        yield hot_rows(key[low : low + run][: whole - low], fp[low : low + run][: whole - low], chunk)
                        chunk += 1
                    key, fp = key[whole:], fp[whole:]
                    if n != whole or not len(key):
                        break
                    hot = None
                edge = np.flatnonzero(np.r_[True, key[1:] != key[:-1], True])
                big = np.flatnonzero(np.diff(edge) > run)
                stop = edge[big[0]] if len(big) else edge[-2]
                if stop:
                    found = links(key[:stop], fp[:stop])
                    yield found.assign(hot=False, key=0, chunk=0)[["hot", "key", "chunk", "a", "b"]]
                    key, fp = key[stop:], fp[stop:]
                if not len(big):
                    break
                hot, chunk = key[0], 0
            rest = (key, fp)
        if rest is not None and len(rest[0]):
            key, fp = rest
            if hot is not None:
                yield hot_rows(key, fp, chunk)
            else:
                yield links(key, fp).assign(hot=False, key=0, chunk=0)[["hot", "key", "chunk", "a", "b"]]

    return scan


def _chunk_pairs(hot: DataFrame, bits: int) -> DataFrame:
    """Links inside keys that were cut into chunks: one group per chunk pair."""
    last = hot.groupBy("key").agg(F.max("chunk").alias("last"))
    other = F.explode(F.sequence(F.lit(0), F.col("last")))
    spread = lookup(hot, last, "key").select("key", "chunk", F.col("a").alias("fp"), other.alias("other"))
    spread = spread.withColumns({"low": F.least("chunk", "other"), "high": F.greatest("chunk", "other")})

    def compare(frame: pd.DataFrame) -> pd.DataFrame:
        fp = frame["fp"].to_numpy()
        coords = coordinates(fp)
        first = frame["chunk"].to_numpy() == frame["low"].to_numpy()
        same = frame["low"].iloc[0] == frame["high"].iloc[0]
        rows = np.flatnonzero(first)
        i, j = _dense(fp, coords, rows, rows if same else np.flatnonzero(~first), bits)
        return _forest(fp[i], fp[j])

    return spread.groupBy("key", "low", "high").applyInPandas(compare, "a long, b long")


def links(points: DataFrame, bits: int = MAX_BITS, run: int = RUN) -> DataFrame:
    """(a, b): a spanning forest of the links between distinct fingerprints."""
    if not 0 <= bits <= MAX_BITS:
        raise ValueError("six blocks find links of at most three bits")
    keys = [F.xxhash64(F.lit(n), *(F.col(f"block{i}") for i in trio)) for n, trio in enumerate(combinations(range(6), 3))]
    rows = pivot_table(points).select(F.explode(F.array(*keys)).alias("key"), "fp")
    scanned = settle(rows.repartition("key").sortWithinPartitions("key").mapInPandas(_scan(bits, run), _SCAN))
    found = scanned.filter(~F.col("hot")).select("a", "b")
    hot = scanned.filter("hot")
    if not hot.isEmpty():
        found = found.unionByName(_chunk_pairs(hot, bits))
    return found.distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, bits: int = MAX_BITS) -> DataFrame:
    """One row per input row: id, fingerprint (16 hex digits), component_id.

    `component_id` is the smallest id reachable over links of at most `bits`
    differing bits. Null and empty texts have fingerprint zero and link like any
    other; repeated rows stay repeated; a null id keeps its row and is never a
    component's id unless the class has no other. Other columns are ignored.
    An empty table gives an empty result.
    """
    prints = settle(fingerprints(docs, id_col, text_col, shingle))
    points = settle(prints.groupBy("fp").agg(F.min(id_col).alias("least"), F.count("*").alias("copies")))
    found = settle(links(points.select("fp"), bits))
    if found.isEmpty():
        classes = points.select("fp", F.col("least").alias("component_id"))
    else:
        roots = components(found)
        linked = points.join(roots, points.fp == roots.node)
        least = linked.groupBy("root").agg(F.min("least").alias("component_id"))
        of_linked = lookup(roots, least, "root").select(F.col("node").alias("fp"), "component_id")
        classes = points.join(of_linked, "fp", "left").select("fp", F.coalesce("component_id", "least").alias("component_id"))
    hexed = F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint")
    hot = settle(hot_keys(points, prints.count()).select("fp"))
    return lookup(prints, classes, "fp", hot).select(id_col, hexed, "component_id")
