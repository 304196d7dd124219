"""Toxicity: a factorization machine over hashed terms.

A text's terms are its words in lower case and their beginnings, and each of them
again for every level of frequency that it reaches in the text, all hashed to
buckets. The machine scores a bias, a weight a bucket, and for every pair of
buckets the inner product of their factor vectors, so terms that are harmless
alone and not together get what sums of weights cannot give. Pairs, whose number
grows with the square of a text's words, count less in texts of many words. A lasso penalty on the
weights and a group penalty on the factor vectors leave few buckets alive, so
long clean texts gather no noise.

It is fitted by proximal gradient steps on a bounded sample of labelled rows, as
many of either label as there are up to half of it. Scores are meant for the
sample's shares of labels: a rarer label 1 is not held against a text.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import bounded_batches, settle, trimmed

#: Labelled rows that training reads at most, half of either label: those with the smallest hashes.
SAMPLE = 12_000
#: Terms of the sample's rows together, at most.
TERMS = 1 << 24
BUCKETS = 1 << 20
#: Letters of the beginnings that are terms beside the whole words.
BEGINNINGS = (4, 5, 6, 7)
#: Levels of frequency: at least so many occurrences, and so many a word of the text.
LEVELS = ((2, 0.01), (2, 0.02), (3, 0.01), (3, 0.03))
#: Distinct words of a text from which pairs count half.
PAIR_WORDS = 32
#: Words whose buckets a worker keeps.
KEPT_WORDS = 100_000

_WORD = re.compile(r"[^\W\d_]+")


def held_out(doc_id: str = "doc_id") -> Column:
    """True for the fifth of the documents that the model may not learn from. A
    null id belongs to no fold and is held out."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 5 == 0, F.lit(True))


def buckets(word: str) -> list[int]:
    """Of a lower-case word and its beginnings."""
    raw = [word, *(f"{word[:n]}-" for n in BEGINNINGS if len(word) > n)]
    return [zlib.crc32(t.encode("utf-8", "surrogatepass")) & (BUCKETS - 1) for t in raw]


def at_level(found: np.ndarray, level: int) -> np.ndarray:
    """The buckets of terms that reach a level, from their own."""
    return (found * 0x9E3779B1 + (level + 1) * 0x85EBCA6B >> 7) & (BUCKETS - 1)


def words(text: str | None) -> Counter[str]:
    return Counter(_WORD.findall((text or "").lower()))


def terms(said: Counter[str], bases: Callable[[str], Iterable[int]] = buckets) -> np.ndarray:
    """The distinct buckets of a text's words, at all levels, sorted."""
    counts: dict[int, int] = {}
    for word, n in said.items():
        for base in bases(word):
            counts[base] = counts.get(base, 0) + n
    base, n = np.fromiter(counts, np.int64, len(counts)), np.fromiter(counts.values(), np.int64, len(counts))
    size = said.total()
    return np.unique(np.concatenate([base, *(at_level(base[(n >= least) & (n >= share * size)], k) for k, (least, share) in enumerate(LEVELS))]))


def pair_share(distinct: int | np.ndarray) -> float | np.ndarray:
    """What a pair counts in a text of so many distinct words."""
    return 1 / (1 + distinct / PAIR_WORDS)


def _renumbered(rows: list[np.ndarray], kept: np.ndarray, size: int) -> list[np.ndarray]:
    """Rows of the numbers below `size`, without what isn't `kept`, counted anew."""
    column = np.full(size, -1, np.int32)
    column[kept] = np.arange(len(kept))
    return [(c := column[r])[c >= 0] for r in rows]


class Machine:
    """bias; for the bucket of column c a weight weights[c] and factors[c];
    columns maps buckets to columns, and all others to -1."""

    def __init__(self, bias: float, live: np.ndarray, weights: np.ndarray, factors: np.ndarray):
        self.bias, self.weights, self.factors = bias, weights, factors
        self.columns = np.full(BUCKETS, -1, np.int32)
        self.columns[live] = np.arange(len(live), dtype=np.int32)
        every = np.arange(BUCKETS)
        self.used = self.columns >= 0
        for level in range(len(LEVELS)):
            self.used |= self.columns[at_level(every, level)] >= 0
        self.known: dict[str, tuple[int, ...]] = {}

    @staticmethod
    def fit(
        rows: list[np.ndarray], distinct: np.ndarray, labels: np.ndarray, factors: int = 8, epochs: int = 12, batch: int = 512,
        rate: float = 0.2, lasso: float = 3e-4, group: float = 2e-3, least: int = 8, seed: int = 7,
    ) -> Machine:
        """rows: buckets of each text; distinct: its distinct words. Buckets of fewer than `least` texts
        take no part. Without both labels the score is the share of ones, 0.5
        without rows."""
        if not len(labels) or labels.min() == labels.max():
            share = (labels.sum() + 1) / (len(labels) + 2)
            return Machine(float(np.log(share / (1 - share))), np.empty(0, int), np.empty(0), np.empty((0, factors)))
        live = np.flatnonzero(np.bincount(np.concatenate(rows), minlength=BUCKETS) >= least)
        rng, m = np.random.default_rng(seed), len(live)
        w, v = np.zeros(m, np.float32), rng.normal(0, 0.01, (m, factors)).astype(np.float32)
        share = labels.mean()
        bias, seen_b, seen_w, seen_v = float(np.log(share / (1 - share))), 1e-8, np.zeros(m, np.float32), np.zeros(m, np.float32)
        rows, share = _renumbered(rows, live, BUCKETS), pair_share(distinct)
        for epoch in range(epochs):
            order = rng.permutation(len(rows))
            for low in range(0, len(order), batch):
                some = order[low : low + batch]
                sizes = np.array([len(rows[i]) for i in some])
                at, doc = np.concatenate([rows[i] for i in some]), np.repeat(np.arange(len(some)), sizes)
                picked, z = v[at], np.full(len(some), bias)
                total = np.stack([np.bincount(doc, picked[:, k], len(some)) for k in range(factors)], axis=1)
                z += np.bincount(doc, w[at], len(some)) + 0.5 * share[some] * ((total**2).sum(axis=1) - np.bincount(doc, (picked**2).sum(axis=1), len(some)))
                error = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - labels[some]) / len(some)
                each = error[doc]
                gb, gw = float(error.sum()), np.bincount(at, each, len(w))
                pull = (each * share[some][doc])[:, None] * (total[doc] - picked)
                gv = np.stack([np.bincount(at, pull[:, k], len(w)) for k in range(factors)], axis=1)
                seen_b, seen_w, seen_v = seen_b + gb * gb, seen_w + gw**2, seen_v + (gv**2).mean(axis=1)
                bias -= rate * gb / np.sqrt(seen_b)
                step_w, step_v = rate / np.sqrt(seen_w + 1e-6), 0.2 * rate / np.sqrt(seen_v + 1e-6)
                w = w - step_w * gw
                w = np.sign(w) * np.maximum(0, np.abs(w) - step_w * lasso)
                v = v - step_v[:, None] * gv
                v *= np.maximum(0, 1 - step_v * group / np.maximum(np.sqrt((v**2).sum(axis=1)), 1e-12))[:, None]
            alive = np.flatnonzero((w != 0) | (v != 0).any(axis=1))
            if epoch and len(alive) < len(w):  # what two epochs leave at zero stays there
                rows = _renumbered(rows, alive, len(w))
                live, w, v, seen_w, seen_v = live[alive], w[alive], v[alive], seen_w[alive], seen_v[alive]
        return Machine(bias, live, w, v)

    def _bases(self, word: str) -> tuple[int, ...]:
        """A word's buckets, without those that the machine knows at no level."""
        if (mine := self.known.get(word)) is None:
            mine = tuple(b for b in buckets(word) if self.used[b])
            if len(self.known) >= KEPT_WORDS:
                self.known.clear()
            if len(word) < 64:
                self.known[word] = mine
        return mine

    def score(self, text: str | None) -> float:
        """The probability of the label 1."""
        said = words(text)
        of = self.columns[terms(said, self._bases)]
        z = self.bias
        if len(of := of[of >= 0]):
            v = self.factors[of]
            z += float(self.weights[of].sum() + 0.5 * pair_share(len(said)) * (v.sum(axis=0) ** 2 - (v**2).sum(axis=0)).sum())
        return float(1 / (1 + np.exp(-np.clip(z, -500, 500))))


def _terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        said = [words(t) for t in batch.column("text").to_pylist()]
        rows = [terms(w) for w in said]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("label"), pa.array([len(w) for w in said], pa.int64()), pa.array([len(r) for r in rows], pa.int64()), pa.array(rows, pa.list_(pa.int32()))], names=["doc_id", "label", "words", "size", "terms"])


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, terms: int = TERMS) -> Machine:
    """A machine from the labelled documents that are not held out; null labels
    and ids take no part."""
    usable = labels.filter(F.col("toxic").isin(0, 1) & ~held_out()).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("label"))
    halves = [usable.filter(F.col("label") == label).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample // 2) for label in (0, 1)]
    chosen = halves[0].unionByName(halves[1])  # `sample` rows of 12 bytes
    texts = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("doc_id", "label", "text")
    rows = settle(texts.mapInArrow(trimmed(_terms), "doc_id long, label int, words long, size long, terms array<int>"))
    # A repeated id may bring any number of rows: as many as both bounds hold.
    few = rows.withColumn("h", F.xxhash64("doc_id", "terms")).orderBy("h", "doc_id", "label").limit(sample)
    before = Window.orderBy("h", "doc_id", "label").rowsBetween(Window.unboundedPreceding, 0)  # `sample` rows
    found = few.withColumn("sum", F.sum("size").over(before)).filter(F.col("sum") <= terms).select("label", "words", "terms").toArrow()
    y, values = found.column("label").to_numpy().astype(float), found.column("terms").combine_chunks()
    if not len(y):
        return Machine.fit([], y, y)
    edges, flat = values.offsets.to_numpy(), values.values.to_numpy()
    return Machine.fit([flat[a:b] for a, b in zip(edges[:-1], edges[1:])], found.column("words").to_numpy(), y)


def classify(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, threshold: float = 0.5) -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row of `docs`.

    Null and empty texts are scored by the bias alone. Labels, language, source
    and id are no inputs of a score; other columns are ignored. Repeated rows
    stay repeated; a label of a repeated id counts for each of its texts. Empty
    labels give every text the same score, empty documents no rows.
    """
    bounded_batches(docs.sparkSession)
    model = train(docs, labels, sample)

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [model.score(t) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(found, pa.float64())], names=["doc_id", "held_out", "score"])

    rows = docs.select("doc_id", held_out().alias("held_out"), "text")
    out = rows.mapInArrow(trimmed(scored), f"doc_id {dict(docs.dtypes)['doc_id']}, held_out boolean, score double")
    return out.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
