"""Excerpts around hits in folded text, cut from the text as it was written.

Folding spells some letters out, so places in the folded text are not places in
the text. A mask of the folded text's length has a mark wherever a letter of it
is not the first of what one letter became: the place in the text is the place in
the folded text less the marks up to it. All of that is column expressions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import FOLDS

# Letters that a compatibility form spells out.
LIGATURES = {"ﬀ": "ff", "ﬁ": "fi", "ﬂ": "fl", "ﬃ": "ffi", "ﬄ": "ffl", "ĳ": "ij", "ŉ": "ʼn", "ǳ": "dz", "ǉ": "lj", "ǌ": "nj"}
SPELLED = {**FOLDS, **LIGATURES}
_MARK, _LETTER = "\x02", r"[\p{L}\p{N}]"
#: Letters before the first hit, and half of those behind its start.
CONTEXT = 90


def small(text: Column) -> Column:
    """Lower case, letter for letter."""
    return F.lower(F.translate(text, f"İ{_MARK}", "i "))


def folded(text: Column) -> Column:
    """Lower case with umlauts and ligatures spelled out."""
    out = small(text)
    for letter, spelled in SPELLED.items():
        out = F.replace(out, F.lit(letter), F.lit(spelled))
    return out


def mask(text: Column) -> Column:
    """A mark for every letter of `folded` that is not the first of its own."""
    out = small(text)
    for letter, spelled in SPELLED.items():
        out = F.replace(out, F.lit(letter), F.lit(spelled[0] + _MARK * (len(spelled) - 1)))
    return out


def place_of(marked: Column, at: Column) -> Column:
    """The place in the text (from 1) of a place in the folded text, by its mask."""
    before = F.substr(marked, F.lit(1), at)
    return at - (F.length(before) - F.length(F.replace(before, F.lit(_MARK), F.lit(""))))


def first_hit(text: Column, needles: list[list[str]]) -> Column:
    """The place in the text of the first hit; null if there is none.

    needles: for each word its folded forms; the longest that occurs counts. The
    text is folded once for all of them, and the mask is of the text up to the
    hit: folding makes no text shorter.
    """
    every = [sorted((n for n in some if len(n) >= 2), key=lambda n: (-len(n), n)) for some in needles]
    if not any(every):
        return F.lit(None).cast("int")

    def first(whole: Column) -> Column:
        return F.array_min(F.array_compact(F.array(*(F.coalesce(*(F.nullif(F.instr(whole, n), F.lit(0)) for n in some)) for some in every if some))))

    at = F.transform(F.array(folded(text)), first)
    return F.get(F.transform(at, lambda p: F.when(p.isNotNull(), place_of(mask(F.substr(text, F.lit(1), p)), p))), F.lit(0))


def hits(rows: DataFrame, text: str, needles: list[list[str]], name: str) -> DataFrame:
    """The rows of which the text has a hit, with its place, worked out once a row:
    a filter by the place would work it out again."""
    found = F.array_compact(F.array(first_hit(F.col(text), needles)))
    return rows.select("*", F.explode(found).alias(name))


def window(text: Column, hit: Column) -> Column:
    """(start, raw): what is shown, as it is written: `CONTEXT` letters before the
    hit and twice as many from it on; the text's beginning without a hit."""
    start = F.greatest(F.coalesce(hit, F.lit(1)) - CONTEXT, F.lit(1))
    length = F.when(hit.isNull(), 2 * CONTEXT).otherwise(hit - start + 2 * CONTEXT)
    return F.struct(start.alias("start"), F.substr(text, start, length).alias("raw"))


def highlights(raw: Column, needles: list[list[str]]) -> Column:
    """The words hit in a window, as written, each to its end, in order of place."""
    whole, marked = folded(raw), mask(raw)

    def of(some: list[str]) -> Column:
        out = F.array().cast("array<struct<at:int,hit:string>>")
        for needle in sorted((n for n in some if len(n) >= 2), key=lambda n: (len(n), n)):
            pattern = rf"\Q{needle}\E{_LETTER}*"
            parts, hits = F.split(whole, pattern, -1), F.regexp_extract_all(whole, F.lit(pattern), F.lit(0))
            spans = F.transform(hits, lambda h, i: F.struct(_sum(parts, i + 1, hits, i).alias("from"), F.length(h).alias("n")))
            found = F.transform(spans, lambda s: F.struct(place_of(marked, s["from"] + 1).cast("int").alias("at"), F.substr(raw, place_of(marked, s["from"] + 1), place_of(marked, s["from"] + s["n"]) - place_of(marked, s["from"] + 1) + 1).alias("hit")))
            out = F.when(whole.contains(needle), found).otherwise(out)
        return out

    return F.transform(F.array_sort(F.array_distinct(F.concat(*map(of, needles)))), lambda x: x["hit"]) if needles else F.array().cast("array<string>")


def _sum(parts: Column, upto: Column, hits: Column, before: Column) -> Column:
    """The letters of the first `upto` parts and the first `before` hits."""
    total = lambda some, n: F.aggregate(F.slice(some, F.lit(1), n), F.lit(0), lambda s, x: s + F.length(x))
    return total(parts, upto) + total(hits, before)


def shown(text: Column, part: Column) -> Column:
    """The window with white space as single blanks, and dots where text is left out."""
    plain = F.regexp_replace(part["raw"], r"[\s ]+", " ")
    left = F.when(part["start"] > 1, F.lit("… ")).otherwise(F.lit(""))
    right = F.when(part["start"] + F.length(part["raw"]) - 1 < F.length(text), F.lit(" …")).otherwise(F.lit(""))
    return F.concat(left, F.trim(plain), right)
