"""Language identification by a bit-sliced Bloom filter of n-grams.

A slot of the filter is a bitmask in words of up to 64 bits; an n-gram has
`HASHES` slots, and the AND of their masks returns every language that contains
it. Each language has two bits: one for all n-grams of its texts, however rare,
and one for those that make up at least `SHARE` of its n-grams. A text's n-grams
are counted by bit (popcounts over its masks), each count is corrected for the
filter's false positives of that bit, a language's evidence is the sum of its
two, and the largest wins.

N-grams are three code points around a letter, lower-cased, with anything but
letters as a space, packed into 63 bits. Counting and building are Spark jobs:
tasks send each n-gram and language once with its count, masks are ORed by slot,
and what reaches the driver is the filter in stretches of slots. Its size is at
most `FILTER_BYTES`, by its number of slots alone: more n-grams than that holds
well raise the false positives, which are measured and corrected.
"""

from __future__ import annotations

import sys
import unicodedata
from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import settle, trimmed

UNKNOWN = "und"
#: The share of a language's n-grams from which an n-gram is common in it.
SHARE = 2e-5
HASHES = 4
#: Bytes of a filter at most.
FILTER_BYTES = 1 << 26
#: Slots of one stretch of the filter.
_STRETCH = 1 << 16
#: N-grams of one piece of a long text; pieces are added up.
_PIECE = 1 << 20

_SPACE = 32


@cache
def _letters() -> np.ndarray:
    """For each code point its lower-case letter, or a space."""
    out = np.full(sys.maxunicode + 1, _SPACE, np.int32)
    for code in range(sys.maxunicode + 1):
        letter = chr(code)
        if unicodedata.category(letter)[0] == "L":
            low = letter.lower()
            out[code] = ord(low) if len(low) == 1 else code
    return out


def _codes(text: str | None) -> np.ndarray:
    raw = np.frombuffer(f" {text or ''} ".encode("utf-32-le", "surrogatepass"), "<u4")
    return _letters()[raw]


def _grams(codes: np.ndarray) -> np.ndarray:
    """Packed n-grams, repeats included."""
    at = np.flatnonzero(codes[1:-1] != _SPACE) + 1
    wide = codes.astype(np.int64)
    return (wide[at - 1] << 42) | (wide[at] << 21) | wide[at + 1]


def _in_pieces(text: str | None) -> Iterator[np.ndarray]:
    codes = _codes(text)
    for low in range(0, len(codes) - 2, _PIECE):
        yield _grams(codes[low : low + _PIECE + 2])


def _mixed(x: np.ndarray) -> np.ndarray:
    """A finaliser of 64-bit hashes: shifts and odd multipliers."""
    x = x.astype(np.uint64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _slots(grams: np.ndarray, size: int, hashes: int) -> Iterator[np.ndarray]:
    mixed, last = _mixed(grams), np.uint64(size - 1)
    step = (mixed >> np.uint64(32)) | np.uint64(1)
    for n in range(hashes):
        yield (mixed + np.uint64(n) * step) & last


def _words(bits: int) -> list[type]:
    """The integer types that hold masks of `bits` bits, 64 to a word."""
    sizes = [min(64, bits - low) for low in range(0, bits or 1, 64)]
    return [next(k for k, most in ((np.uint8, 8), (np.uint16, 16), (np.uint32, 32), (np.uint64, 64)) if n <= most) for n in sizes]


def slots_for(grams: int, bits: int, hashes: int = HASHES) -> int:
    """A power of two: twice as many slots as `hashes` of every n-gram take, as
    far as `FILTER_BYTES` goes."""
    most = FILTER_BYTES // sum(np.dtype(k).itemsize for k in _words(bits))
    return 1 << min((max(1024, 2 * hashes * grams) - 1).bit_length(), max(10, most.bit_length() - 1))


class BitFilter:
    """masks: for every 64 bits an array with a mask a slot. false: for each bit
    the chance that an n-gram without it passes."""

    def __init__(self, bits: int, masks: list[np.ndarray], hashes: int = HASHES):
        self.bits, self.masks, self.hashes = bits, masks, hashes
        self.slots = len(masks[0])
        self.false = np.array([self._has(self.masks[i // 64], i % 64).mean() for i in range(bits)]) ** hashes

    @staticmethod
    def of(grams: np.ndarray, owners: np.ndarray, bits: int, hashes: int = HASHES) -> BitFilter:
        """The filter of n-grams with one bit each; repeated n-grams may have more."""
        size, masks = slots_for(len(grams), bits, hashes), []
        for low, kind in zip(range(0, bits or 1, 64), _words(bits)):
            mine = (owners >= low) & (owners < low + 64)
            masks.append(np.zeros(size, kind))
            for slot in _slots(grams[mine], size, hashes):
                np.bitwise_or.at(masks[-1], slot, kind(1) << (owners[mine] - low).astype(kind))
        return BitFilter(bits, masks, hashes)

    @staticmethod
    def _has(masks: np.ndarray, bit: int) -> np.ndarray:
        return ((masks >> masks.dtype.type(bit)) & masks.dtype.type(1)) == 1

    def counts(self, grams: np.ndarray) -> np.ndarray:
        """N-grams with each bit, without the expected false positives."""
        slots, hits = list(_slots(grams, self.slots, self.hashes)), []
        for word, low in zip(self.masks, range(0, self.bits or 1, 64)):
            masks, n = word[slots[0]], min(64, self.bits - low)
            for slot in slots[1:]:
                masks &= word[slot]
            if masks.dtype == np.uint8:
                found = np.bincount(masks, minlength=256)
                hits += [found[self._has(np.arange(256, dtype=np.uint8), i)].sum() for i in range(n)]
            else:
                hits += [np.count_nonzero(self._has(masks, i)) for i in range(n)]
        hits = np.array(hits, float)
        return np.maximum(0.0, hits - len(grams) * self.false) / np.maximum(1e-12, 1 - self.false)


class LanguageFilter:
    """languages by name; bit i of the filter is for all n-grams of language i,
    bit n + i for its common ones."""

    def __init__(self, languages: list[str], bits: BitFilter | None):
        self.languages, self.bits = languages, bits

    def predict(self, text: str | None) -> tuple[str, float]:
        """The language and its share of the two best languages' evidence: `und`
        for a text without letters or a filter without languages; 0.0 with the
        first language where no n-gram is known."""
        n, letters = len(self.languages), 0
        evidence = np.zeros(n)
        for grams in _in_pieces(text):
            letters += len(grams)
            if n and len(grams):
                evidence += self.bits.counts(grams).reshape(2, n).sum(axis=0)
        if not letters or not n:
            return UNKNOWN, 0.0
        order = np.argsort(-evidence, kind="stable")
        best = evidence[order[0]]
        if best <= 0:
            return self.languages[0], 0.0
        rest = evidence[order[1]] if n > 1 else 0.0
        return self.languages[order[0]], float(min(1.0, (best - rest) / best * 0.5 + 0.5))


def gram_counts(docs: DataFrame, lang_col: str = "lang", text_col: str = "text") -> DataFrame:
    """(lang, gram, n): how often each language's texts hold each n-gram."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: dict[str, tuple[np.ndarray, np.ndarray]] = {}

        def add(lang: str, grams: list[np.ndarray]) -> None:
            new, n = np.unique(np.concatenate(grams), return_counts=True)
            if lang in seen:
                new, back = np.unique(np.concatenate([seen[lang][0], new]), return_inverse=True)
                n = np.bincount(back, np.concatenate([seen[lang][1], n])).astype(np.int64)
            seen[lang] = (new, n)

        def out(lang: str) -> pd.DataFrame:
            grams, n = seen.pop(lang)
            return pd.DataFrame({"lang": lang, "gram": grams, "n": n})

        for frame in frames:
            for lang, texts in frame.groupby("lang")["text"]:
                waiting, size = [], 0
                for text in texts:
                    for grams in _in_pieces(text):
                        waiting.append(grams)
                        size += len(grams)
                        if size > 2 * _PIECE:
                            add(lang, waiting)
                            waiting, size = [], 0
                if waiting:
                    add(lang, waiting)
                if lang in seen and len(seen[lang][0]) > _PIECE:
                    yield out(lang)
            if len(seen) > 64:
                for lang in list(seen):
                    yield out(lang)
        for lang in list(seen):
            yield out(lang)

    rows = docs.filter(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"))
    counted = rows.mapInPandas(trimmed(run), "lang string, gram long, n long")
    return counted.groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def fit(docs: DataFrame, lang_col: str = "lang", text_col: str = "text", share: float = SHARE) -> LanguageFilter:
    """A filter of all n-grams and languages of `docs`; languages whose texts
    have no letter are none. The driver gets the names and the filter's bytes."""
    counted = settle(gram_counts(docs, lang_col, text_col))
    totals = counted.groupBy("lang").agg(F.sum("n").alias("total")).orderBy("lang").collect()
    languages = [r.lang for r in totals]
    if not languages:
        return LanguageFilter([], None)
    bits, n = 2 * len(languages), len(languages)
    kinds, size = _words(bits), slots_for(counted.select("gram").distinct().count(), bits)
    known = docs.sparkSession.createDataFrame([(r.lang, i, share * r.total) for i, r in enumerate(totals)], "lang string, own int, least double")
    owned = counted.join(F.broadcast(known), "lang")
    bit = F.explode(F.when(F.col("n") >= F.col("least"), F.array("own", F.col("own") + n)).otherwise(F.array("own"))).alias("bit")
    one = F.expr("shiftleft(1L, CAST(bit % 64 AS INT))")  # the sign bit is bit 63
    masks = owned.select("gram", bit).groupBy("gram", F.expr("bit div 64").cast("int").alias("word")).agg(F.bit_or(one).alias("mask"))

    def place(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for slot in _slots(frame["gram"].to_numpy(np.int64), size, HASHES):
                yield pd.DataFrame({"word": frame["word"], "slot": slot.astype(np.int64), "mask": frame["mask"]})

    def stretch(frame: pd.DataFrame) -> pd.DataFrame:
        word, number = int(frame["word"].iloc[0]), int(frame["stretch"].iloc[0])
        part = np.zeros(min(_STRETCH, size), kinds[word])
        part[frame["slot"].to_numpy() % _STRETCH] = frame["mask"].to_numpy(np.int64).view(np.uint64).astype(kinds[word])
        return pd.DataFrame({"word": [word], "stretch": [number], "masks": [part.tobytes()]})

    placed = masks.mapInPandas(place, "word int, slot long, mask long").groupBy("word", "slot").agg(F.bit_or("mask").alias("mask"))
    parts = placed.withColumn("stretch", F.expr(f"slot div {_STRETCH}").cast("int")).groupBy("word", "stretch").applyInPandas(stretch, "word int, stretch int, masks binary")
    out = [np.zeros(size, kind) for kind in kinds]
    for row in parts.toLocalIterator():
        low = row.stretch * _STRETCH
        out[row.word][low : low + _STRETCH] = np.frombuffer(row.masks, kinds[row.word])
    return LanguageFilter(languages, BitFilter(bits, out))


def predict(docs: DataFrame, model: LanguageFilter, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, lang_pred, score) of every row; `und` only for texts that are null or
    have no letter. Ties, and texts of unknown n-grams (score 0), go to the first
    name. Repeated rows stay repeated."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # FILTER_BYTES at most

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = [shared.value.predict(text) for text in frame["text"]]
            names, scores = zip(*rows) if rows else ((), ())
            yield pd.DataFrame({"id": frame["id"], "lang_pred": pd.Series(names, dtype=object), "score": pd.Series(scores, dtype=float)})

    rows = docs.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).alias("text"))
    out = rows.mapInPandas(trimmed(run), "id string, lang_pred string, score double")
    return out.select(F.col("id").cast(docs.schema[id_col].dataType).alias(id_col), "lang_pred", "score")
