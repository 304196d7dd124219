"""Pairs of labels that are nearly equal, by a join: no dictionary is too large.

The ratio of two labels is 200 * common / (both lengths), `common` the longest
common subsequence, so a ratio of `least` bounds the letters that a pair loses and
gains. The longer label is cut into pieces, more of them than half of those
letters: in one piece there is one such letter at most. So a piece, or all of it
but a letter, is in the shorter label, not far from its place, or with one letter
more inside. Pieces meet such parts by their hashes; pairs are compared where they
meet, first by their letters, then in Arrow batches, and only equal enough ones
are moved again.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache
from math import floor
from zlib import crc32

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.tables import spread
from .settled import settle


def ratio(a: str, b: str) -> float:
    """100 * (1 - insertions and deletions / both lengths), by the longest common subsequence."""
    if not a or not b:
        return 100.0 if a == b else 0.0
    masks: dict[str, int] = {}
    for i, c in enumerate(a):
        masks[c] = masks.get(c, 0) | 1 << i
    full = (1 << len(a)) - 1
    row = full
    for c in b:  # zeros mark the longest common subsequence so far
        both = row & masks.get(c, 0)
        row = ((row + both) | (row - both)) & full
    common = len(a) - row.bit_count()
    return 200.0 * common / (len(a) + len(b))


def edits(n: int, m: int, least: float) -> int:
    """Letters that labels of n and m letters lose and gain at most; below n - m: no such pair."""
    most = floor((1 - least / 100) * (n + m) + 1e-9)
    return most - (most - (n - m)) % 2


class Rules:
    """How labels are cut for a ratio of `least`; places are counted from 0."""

    def __init__(self, least: float):
        self.least, self.loss = least, 1 - least / 100
        self.spans, self.shorts, self.parts = cache(self._spans), cache(self._shorts), cache(self._parts)
        # Labels of `long` letters and more have pieces of one size, anywhere.
        most = min(64, floor(1 / self.loss + 1e-9)) if self.loss > 1e-9 else 64
        self.size = most - max(1, most // 8)
        self.long = 1 << 62
        if self.size >= 3:
            sure = floor(2 / (1 / self.size - self.loss)) + 2
            fits = lambda n: n // self.size > max(edits(n, m, least) for m in self.shorts(n)) // 2
            self.long = 1 + max((n for n in range(1, sure + 1) if not fits(n)), default=0)

    def _shorts(self, n: int) -> list[int]:
        """Lengths of labels of n letters or fewer that one of n letters can be close to."""
        return [m for m in range(max(1, floor(n * self.least / (200 - self.least)) - 1), n + 1) if edits(n, m, self.least) >= n - m]

    def longs(self, m: int) -> range:
        """Lengths of m letters or more that one of m letters can be close to, and some more."""
        return range(m, floor(m * (200 - self.least) / self.least + 1e-6) + 2)

    def _spans(self, n: int) -> list[tuple[int, int]]:
        """(place, letters) of the pieces; none where they would be too short to tell anything."""
        most = max(edits(n, m, self.least) for m in self.shorts(n))
        k = most // 2 + 1
        if n >= self.long:
            return [(p, self.size) for p in range(0, n - self.size + 1, self.size)]
        return [(j * n // k, (j + 1) * n // k - j * n // k) for j in range(k)] if most == 0 or n // k >= 3 else []

    def pieces(self, label: str) -> set[int]:
        """The hashes that the longer label of a pair has."""
        n, out = len(label), set()
        for j, (p, size) in enumerate(self.spans(n)):
            tag, piece = "" if n >= self.long else f"{n} {j} ", label[p : p + size]
            out.add(crc32(f"{tag}{piece}".encode()))
            if n > 1:
                out.update(crc32(f"{tag}{piece[:i]}{piece[i + 1 :]}".encode()) for i in range(size))
        return out or {crc32(f"{n} all".encode())}

    def _parts(self, m: int) -> tuple[list[tuple[str, int, int, bool]], list[int]]:
        """What the shorter label of a pair is looked at for: (tag, from, to, whole)
        with the parts to be taken as they are, or without a letter inside; and the
        lengths of which all labels are met."""
        out, every = [], []
        for n in self.longs(m):
            if n >= self.long:
                for size in (self.size - 1, self.size, self.size + 1):
                    out += [("", s, s + size, size <= self.size) for s in range(m - size + 1)]
                break
            if (most := edits(n, m, self.least)) < n - m:
                continue
            if not self.spans(n):
                every.append(n)
            for j, (p, size) in enumerate(self.spans(n)):
                for more in (0, -1, 1):
                    for shift in range(-most, most + 1):
                        s = p + shift
                        if abs(shift) + abs(m - n - shift - more) + abs(more) <= most and 0 <= s and s + size + more <= m:
                            out.append((f"{n} {j} ", s, s + size + more, more < 1))
        return out, every

    def seen(self, label: str) -> set[int]:
        """The hashes that the shorter label of a pair has."""
        parts, every = self.parts(len(label))
        out = {crc32(f"{n} all".encode()) for n in every}
        for tag, low, high, whole in parts:
            part = label[low:high]
            if whole:
                out.add(crc32(f"{tag}{part}".encode()))
            else:
                out.update(crc32(f"{tag}{part[:i]}{part[i + 1 :]}".encode()) for i in range(1, len(part) - 1))
        return out


def _letters(label: str) -> int:
    """A bit for every kind of letter that a label has, and one for those it has twice."""
    once = twice = 0
    for c in label:
        bit = 1 << ord(c) % 31
        twice |= once & bit
        once |= bit
    return once | twice << 31


def _hashed(labels: DataFrame, least: float, longer: bool, name: str) -> DataFrame:
    """(key, label, letters), named after `name`, for every hash of every label."""
    rules: list[Rules] = []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rules[:] = rules or [Rules(least)]
        of = rules[0].pieces if longer else rules[0].seen
        for batch in batches:
            for start in range(0, len(batch), 500):
                keys, labels, letters = [], [], []
                for label in batch.column(0).slice(start, 500).to_pylist():
                    found = of(label)
                    keys += found
                    labels += [label] * len(found)
                    letters += [_letters(label)] * len(found)
                yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(labels, pa.string()), pa.array(letters, pa.int64())], names=["key", name, f"{name}_letters"])

    return labels.select("label").mapInArrow(run, f"key long, {name} string, {name}_letters long")


def _met(longer: DataFrame, shorter: DataFrame, least: float, equal: bool) -> DataFrame:
    """(long, short, ratio): the close pairs of a label and one that is no longer,
    or shorter unless `equal`."""
    n, m = F.length("long"), F.length("short")
    most = F.floor((1 - least / 100) * (n + m) + 1e-9)
    lost = lambda a, b: 2 * F.bit_count(F.col(f"{a}_letters").bitwiseAND(F.bitwise_not(f"{b}_letters")))
    near = (n >= m if equal else n > m) & (most >= n - m) & (lost("long", "short") <= most + n - m) & (lost("short", "long") <= most - n + m)
    pairs = _hashed(longer, least, True, "long").join(_hashed(shorter, least, False, "short").hint("merge"), "key").filter(near).select("long", "short")

    def compared(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            frame["ratio"] = [ratio(x, y) for x, y in zip(frame["long"], frame["short"])]
            yield frame[frame["ratio"] >= least]

    return pairs.mapInPandas(compared, "long string, short string, ratio double").distinct()


def close(left: DataFrame, right: DataFrame, least: float) -> DataFrame:
    """(label, other, ratio): the pairs of labels of both tables (label) with a
    ratio of `least` or more. Labels are taken once; null and empty ones have no
    partner. `least` is over 0 and at most 100. For one table with itself, pass
    it twice: pairs are then looked for once."""
    if not 0 < least <= 100:
        raise ValueError("a ratio is over 0 and at most 100")
    once = lambda t: spread(settle(t.select("label").filter("label <> ''").distinct()))
    a = once(left)
    b = a if right is left else once(right)
    as_is, turned = ("long AS label", "short AS other", "ratio"), ("short AS label", "long AS other", "ratio")
    if b is a:
        pairs = settle(_met(a, a, least, True))
        # of two labels of one length each is the longer one once
        return pairs.selectExpr(*as_is).unionByName(pairs.filter(F.length("long") > F.length("short")).selectExpr(*turned))
    return _met(a, b, least, True).selectExpr(*as_is).unionByName(_met(b, a, least, False).selectExpr(*turned))
