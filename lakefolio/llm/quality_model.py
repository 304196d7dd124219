"""Quality classifier: a sparse ensemble of rules over text statistics.

Shallow trees are grown on resampled labelled rows; every path from a root is a
conjunction of comparisons of statistics. A logistic regression with a lasso
penalty gives the rules weights, most of them zero, and what is left is compiled
into Spark column expressions, so scoring never leaves the JVM.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import textstats as T
from .common import held_out

#: Labelled rows that training reads at most: those with the smallest hashes.
SAMPLE = 12_000
FEATURES = ("n_words", "word_size", "symbols", "bars", "marks", "upper", "letters", "digits", "distinct", "dup_lines", "line_words")


def statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The features of every whole text; zero where a text is null or empty."""
    text = F.col("text")
    share = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    rows = docs.select(F.col(id_col), F.col(text_col).alias("text"))
    # small letters and blanks are most of a text and are no sign, mark, digit or capital: those are looked for in what is left
    rows = rows.withColumns({"words": T.words(text), "lines": T.lines(text), "rest": F.regexp_replace("text", "[a-z ]+", "")})
    rest, chars = F.col("rest"), F.length(F.array_join("words", "")).cast("long")
    counted = rows.select(
        id_col,
        F.size("words").alias("n"),
        F.size("lines").alias("l"),
        chars.alias("c"),
        F.size(F.array_distinct("words")).alias("d"),
        T.repeats(F.col("lines")).alias("r"),
        T.count(rest, T.SYMBOLS).alias("s"),
        T.count(rest, r"[|]").alias("b"),
        T.count(rest, r"[!?]").alias("m"),
        T.count(rest, r"\p{Lu}").alias("u"),
        (chars - T.kept_chars(rest, r"[\p{L}\x20\x09-\x0D]+")).alias("a"),
        T.count(rest, r"[0-9]").alias("g"),
    )
    n, c = F.col("n"), F.col("c")
    values = {
        "n_words": n.cast("double"), "word_size": share(c, n), "symbols": share(F.col("s"), n), "bars": share(F.col("b"), n),
        "marks": share(F.col("m"), n), "upper": share(F.col("u"), F.col("a")), "letters": share(F.col("a"), c), "digits": share(F.col("g"), c),
        "distinct": share(F.col("d"), n), "dup_lines": share(F.col("r"), F.col("l")), "line_words": share(n, F.col("l")),
    }
    return counted.select(id_col, *(values[f].alias(f) for f in FEATURES))


@dataclass(frozen=True)
class Rule:
    """All of (feature, above, threshold): feature > threshold, or <= where not above."""

    parts: tuple[tuple[int, bool, float], ...]

    def holds(self, x: np.ndarray) -> np.ndarray:
        out = np.ones(len(x), bool)
        for feature, above, at in self.parts:
            out &= (x[:, feature] > at) == above
        return out

    def column(self) -> Column:
        out = F.lit(True)
        for feature, above, at in self.parts:
            out = out & ((F.col(FEATURES[feature]) > at) if above else (F.col(FEATURES[feature]) <= at))
        return out


def _grow(x: np.ndarray, y: np.ndarray, rng: np.random.Generator, depth: int, path: tuple, out: list[Rule]) -> None:
    """Adds the paths of a tree that splits by Gini impurity on random features."""
    if depth == 0 or len(y) < 20 or y.min() == y.max():
        return
    best = None
    for feature in rng.choice(x.shape[1], max(2, x.shape[1] // 2), replace=False):
        for at in np.unique(np.quantile(x[:, feature], np.linspace(0.02, 0.98, 25))):
            left = x[:, feature] <= at
            n = left.sum()
            if n < 5 or n > len(y) - 5:
                continue
            p, q = y[left].mean(), y[~left].mean()
            impurity = n * p * (1 - p) + (len(y) - n) * q * (1 - q)
            if best is None or impurity < best[0]:
                best = (impurity, int(feature), float(at), left)
    if best is None:
        return
    _, feature, at, left = best
    for above, rows in ((False, left), (True, ~left)):
        longer = (*path, (feature, above, at))
        out.append(Rule(longer))
        _grow(x[rows], y[rows], rng, depth - 1, longer, out)


def _lasso(z: np.ndarray, y: np.ndarray, penalty: float, rounds: int = 400) -> tuple[np.ndarray, float]:
    """Logistic weights by accelerated proximal gradient; the intercept is free."""
    n, m = z.shape
    z = np.hstack([z, np.ones((n, 1), z.dtype)])
    step = 4.0 * n / max(1.0, float(np.linalg.norm(z, 2) ** 2))
    w = v = np.zeros(m + 1)
    t = 1.0
    for _ in range(rounds):
        grad = z.T @ (1 / (1 + np.exp(-np.clip(z @ v, -30, 30))) - y) / n
        u = v - step * grad
        u[:m] = np.sign(u[:m]) * np.maximum(0, np.abs(u[:m]) - step * penalty)
        s = (1 + np.sqrt(1 + 4 * t * t)) / 2
        v = u + (t - 1) / s * (u - w)
        w, t = u, s
    return w[:m], float(w[m])


class RuleEnsemble:
    def __init__(self, rules: list[Rule], weights: list[float], intercept: float):
        self.rules, self.weights, self.intercept = rules, weights, intercept

    @staticmethod
    def fit(x: np.ndarray, y: np.ndarray, trees: int = 30, depth: int = 3, penalty: float = 2e-3, seed: int = 11) -> RuleEnsemble:
        """Without both labels the score is the share of ones, 0.5 without rows."""
        if not len(y) or y.min() == y.max():
            share = (y.sum() + 1) / (len(y) + 2)
            return RuleEnsemble([], [], float(np.log(share / (1 - share))))
        rng, found = np.random.default_rng(seed), []
        for _ in range(trees):
            rows = rng.integers(0, len(y), min(len(y), 3000))
            _grow(x[rows], y[rows], rng, depth, (), found)
        rules, seen = [], set()
        for rule in dict.fromkeys(found):
            hit = rule.holds(x)
            if (key := hit.tobytes()) not in seen and 0 < hit.sum() < len(y):
                seen.add(key)
                rules.append(rule)
        z = np.stack([r.holds(x) for r in rules], axis=1).astype(np.float32)
        weights, intercept = _lasso(z, y, penalty)
        kept = [i for i in np.argsort(-np.abs(weights)) if weights[i]]
        return RuleEnsemble([rules[i] for i in kept], [float(weights[i]) for i in kept], intercept)

    def score(self) -> Column:
        total = F.lit(self.intercept)
        for rule, weight in zip(self.rules, self.weights):
            total = total + F.when(rule.column(), weight).otherwise(0.0)
        return 1 / (1 + F.exp(-total))


def training_rows(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> tuple[np.ndarray, np.ndarray]:
    """Statistics and labels of at most `sample` labelled documents that are not
    held out; null labels and ids take no part."""
    usable = labels.filter(F.col("quality").isNotNull() & ~held_out()).select("doc_id", F.col("quality").cast("int").alias("quality"))
    chosen = usable.orderBy(F.xxhash64("doc_id"), "doc_id", "quality").limit(sample)
    texts = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")  # `sample` rows of 12 bytes
    stats = statistics(texts.select(F.struct("doc_id", "quality").alias("doc_id"), "text"))
    rows = stats.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample).collect()
    x = np.array([[r[f] for f in FEATURES] for r in rows], float).reshape(len(rows), len(FEATURES))
    return x, np.array([r.doc_id.quality for r in rows], float)


def classify(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, threshold: float = 0.5) -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row of `docs`.

    Null and empty texts are scored by their zero statistics. Labels, language,
    source and id are no inputs of a score; other columns are ignored. Repeated
    rows stay repeated. Without usable labels every score is the same.
    """
    model = RuleEnsemble.fit(*training_rows(docs, labels, sample))
    scored = statistics(docs).withColumn("score", model.score())
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
