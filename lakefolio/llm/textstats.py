"""Statistics of whole texts as Spark column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .common import SPACE, WORD

SYMBOLS = "[#*$%&|<>]"


def count(text: Column, pattern: str) -> Column:
    """Matches of a pattern; zero in a null text."""
    return F.coalesce(F.regexp_count(text, F.lit(pattern)), F.lit(0)).cast("long")


def kept_chars(text: Column, others: str) -> Column:
    """The characters outside a class, by the pattern of runs of that class; zero in
    a null text. Equal to `count` of the class's complement, but works a run at a time."""
    return F.coalesce(F.length(F.regexp_replace(text, others, "")), F.lit(0)).cast("long")


def words(text: Column) -> Column:
    """The words in order; none in a null text."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACE), lambda w: w != "")


def lines(text: Column) -> Column:
    """Lines that hold a word."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), "\n"), lambda line: line.rlike(WORD))


def word_chars(text: Column) -> Column:
    return F.coalesce(F.length(text), F.lit(0)).cast("long") - count(text, SPACE)


def repeats(items: Column) -> Column:
    """Items equal to an earlier one."""
    return (F.size(items) - F.size(F.array_distinct(items))).cast("long")


def repeat_words(words: Column, window: int = 8) -> Column:
    """Words inside windows of `window` words that occur at least twice.

    Windows are hashed to 64 bits. Texts without a repeated window, nearly all,
    stop at the comparison of counts; of the others the window hashes are sorted
    with their places, so the work is n log n whatever repeats.
    """

    def covered(places: Column) -> Column:
        start = F.struct(F.lit(-window).alias("last"), F.lit(0).alias("n"))
        step = lambda seen, p: F.struct(p.alias("last"), (seen["n"] + F.least(F.lit(window), p - seen["last"])).alias("n"))
        return F.aggregate(F.sort_array(places), start, step, lambda seen: seen["n"])

    def twice(ordered: Column) -> Column:
        same = lambda x, i: F.coalesce(F.get(ordered, i - 1)["h"] == x["h"], F.lit(False)) | F.coalesce(F.get(ordered, i + 1)["h"] == x["h"], F.lit(False))
        return F.transform(F.filter(ordered, same), lambda x: x["p"])

    def let(value: Column, body) -> Column:
        """body(value) with the value computed once."""
        return F.get(F.transform(F.array(value), body), F.lit(0))

    def of_hashes(hashes: Column) -> Column:
        ordered = F.sort_array(F.transform(hashes, lambda h, p: F.struct(h.alias("h"), p.alias("p"))))
        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0)).otherwise(covered(let(ordered, twice)))

    def of_words(some: Column) -> Column:
        singles = F.transform(some, lambda w: F.xxhash64(w))
        return let(let(let(let(singles, _join(1)), _join(2)), _join(4)), of_hashes)

    def _join(step: int):
        return lambda h: F.transform(F.sequence(F.lit(0), F.size(h) - step - 1), lambda i: F.xxhash64(F.get(h, i), F.get(h, i + step)))

    if window != 8:
        raise ValueError("windows are joined by doubling: eight words")
    return F.when(F.size(words) < window + 1, F.lit(0)).otherwise(let(words, of_words)).cast("long")
