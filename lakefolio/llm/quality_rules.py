"""Quality rules by weak supervision, in DataFrame operations only.

Each rule votes good (1), bad (-1) or abstains (0). Expectation-maximisation
estimates the share of good documents and every rule's accuracies from the
votes alone, and a document is kept by its posterior probability instead of by
passing all rules. A document's votes matter only as a pattern, of which there
are at most 3^rules whatever the number of documents: Spark counts the patterns,
the driver iterates over the counts, and the posterior is a sum of columns.
"""

from __future__ import annotations

from math import exp, log

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import textstats as T
from .common import settle

BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
_MORE = ("upper_chars", "letter_chars", "n_lines", "n_distinct")


def statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Counts over the whole text; a null text counts as empty. Columns beside
    id and text are ignored; repeated rows stay repeated."""
    text = F.col("text")
    rows = docs.select(F.col(id_col), F.col(text_col).alias("text")).withColumns({"words": T.words(text), "lines": T.lines(text)})
    return rows.select(
        id_col,
        F.size("words").cast("long").alias("n_words"),
        T.word_chars(text).alias("word_chars"),
        T.count(text, T.SYMBOLS).alias("n_symbols"),
        T.repeats(F.col("lines")).alias("n_dup_lines"),
        T.repeat_words(F.col("words")).alias("n_repeat_words"),
        T.count(text, r"\p{Lu}").alias("upper_chars"),
        T.count(text, r"\p{L}").alias("letter_chars"),
        F.size("lines").cast("long").alias("n_lines"),
        F.size(F.array_distinct("words")).cast("long").alias("n_distinct"),
    )


def rules() -> dict[str, Column]:
    """Votes over `statistics`. Five rules know a kind of junk and vote bad or
    abstain; three know what prose looks like and vote good or abstain, or bad
    where it is plainly missing."""
    n, letters, symbols = F.col("n_words"), F.col("letter_chars"), F.col("n_symbols")
    mostly_upper = 2 * F.col("upper_chars") > letters
    bad = {
        "symbols": symbols > 0.2 * n,
        "upper": mostly_upper & (n >= 5),
        "repeats": F.col("n_repeat_words") > 0.3 * n,
        "lines": F.col("n_dup_lines") > 0.3 * F.col("n_lines"),
        "length": n < 20,
    }
    prose = (symbols <= 0.02 * n) & (10 * F.col("upper_chars") <= letters)
    out = {name: F.when(rule, -1).otherwise(0) for name, rule in bad.items()}
    out["prose"] = F.when(prose & (n >= 20), 1).otherwise(0)
    out["letters"] = F.when(letters < 0.7 * F.col("word_chars"), -1).when(letters >= 0.88 * F.col("word_chars"), 1).otherwise(0)
    out["variety"] = F.when((n < 2000) & (n >= 20) & (F.col("n_distinct") < 0.3 * n), -1).when((n >= 20) & (F.col("n_distinct") >= 0.6 * n), 1).otherwise(0)
    return out


class LabelModel:
    """prior: share of good documents. tables[rule][vote]: its probabilities in
    good and in bad documents."""

    def __init__(self, prior: float, tables: list[dict[int, tuple[float, float]]]):
        self.prior, self.tables = prior, tables

    def log_odds(self, votes: tuple[int, ...]) -> float:
        return log(self.prior / (1 - self.prior)) + sum(log(t[v][0] / t[v][1]) for t, v in zip(self.tables, votes) if v)

    @staticmethod
    def fit(patterns: list[tuple[tuple[int, ...], int]], rounds: int = 50) -> LabelModel:
        """EM from a vote in which a rule against counts more than one in favour. An accuracy is smoothed by one vote either
        way and a vote never speaks against its own meaning, so that the good
        class stays the one that the rules call good."""
        size = len(patterns[0][0]) if patterns else 0
        posterior = [1 / (1 + exp(-sum(2.0 * v if v > 0 else 8.0 * v for v in votes))) for votes, _ in patterns]
        model = LabelModel(0.8, [{1: (0.5, 0.5), -1: (0.5, 0.5)}] * size)
        for _ in range(rounds):
            good = sum(p * n for p, (_, n) in zip(posterior, patterns))
            total = sum(n for _, n in patterns)
            tables = []
            for rule in range(size):
                table = {}
                for vote in (1, -1):
                    in_good = (1 + sum(p * n for p, (v, n) in zip(posterior, patterns) if v[rule] == vote)) / (good + 3)
                    in_bad = (1 + sum((1 - p) * n for p, (v, n) in zip(posterior, patterns) if v[rule] == vote)) / (total - good + 3)
                    middle = (in_good + in_bad) / 2
                    table[vote] = (max(in_good, middle), min(in_bad, middle)) if vote == 1 else (min(in_good, middle), max(in_bad, middle))
                tables.append(table)
            model = LabelModel(min(0.999, max(0.001, (good + 1) / (total + 2))), tables)
            posterior = [1 / (1 + exp(-max(-500.0, min(500.0, model.log_odds(v))))) for v, _ in patterns]
        return model

    def posterior(self, votes: list[Column]) -> Column:
        odds = F.lit(log(self.prior / (1 - self.prior)))
        for vote, table in zip(votes, self.tables):
            weights = {v: log(a / b) for v, (a, b) in table.items()}
            odds = odds + F.when(vote == 1, weights[1]).when(vote == -1, weights[-1]).otherwise(0.0)
        return 1 / (1 + F.exp(-odds))


def vote_patterns(stats: DataFrame) -> list[tuple[tuple[int, ...], int]]:
    """At most 3^rules rows, whatever the input."""
    votes = rules()
    counted = stats.select(*(v.alias(k) for k, v in votes.items())).groupBy(*votes).count().collect()
    return sorted((tuple(row[k] for k in votes), row["count"]) for row in counted)


def base_failed() -> Column:
    return (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))


def judge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """One row per input row: the base counts, base_failed, probability, kept.

    `kept` is false where the base fails, else whether the posterior probability
    of good quality is at least `threshold`. Empty and null texts have no words
    and fail. An empty table gives an empty result.
    """
    stats = settle(statistics(docs, id_col, text_col))
    model = LabelModel.fit(vote_patterns(stats))
    probability = model.posterior(list(rules().values())) if model.tables else F.lit(0.5)
    judged = stats.withColumns({"base_failed": base_failed(), "probability": probability})
    kept = ~F.col("base_failed") & (F.col("probability") >= threshold)
    return judged.select(id_col, *BASE, "base_failed", kept.alias("kept"), "probability")
