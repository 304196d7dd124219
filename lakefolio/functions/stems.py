"""Stems of German and English words, by the published suffix-stripping rules
(Snowball). A stem is computed once a distinct word, in Arrow batches."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import FOLDS

# The algorithms' letters, suffixes and exceptions.
_VOWELS = {"en": "aeiouy", "de": "aeiouyäöü"}
_LI, _DOUBLE = "cdeghkmnrt", ("bb", "dd", "ff", "gg", "mm", "nn", "pp", "rr", "tt")
_WHOLE = {
    "skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl", "gently": "gentl", "ugly": "ugli",
    "early": "earli", "only": "onli", "singly": "singl", "sky": "sky", "news": "news", "howe": "howe", "atlas": "atlas", "cosmos": "cosmos", "bias": "bias", "andes": "andes",
}
_KEPT = frozenset("inning outing canning herring earring proceed exceed succeed".split())
_SECOND = {
    "ational": "ate", "fulness": "ful", "iveness": "ive", "ization": "ize", "ousness": "ous", "biliti": "ble", "lessli": "less", "tional": "tion",
    "alism": "al", "aliti": "al", "ation": "ate", "entli": "ent", "fulli": "ful", "iviti": "ive", "ousli": "ous", "abli": "able", "alli": "al",
    "anci": "ance", "ator": "ate", "enci": "ence", "izer": "ize", "bli": "ble", "ogi": "og", "li": "",
}
_THIRD = {"ational": "ate", "tional": "tion", "alize": "al", "ative": "", "icate": "ic", "iciti": "ic", "ical": "ic", "ness": "", "ful": ""}
_FOURTH = ("ement", "able", "ance", "ence", "ible", "ment", "ant", "ate", "ent", "ion", "ism", "iti", "ive", "ize", "ous", "al", "er", "ic")


_BORDERS = {vowels: re.compile(f"[{vowels}][^{vowels}]") for vowels in _VOWELS.values()}


def _region(word: str, start: int, vowels: str) -> int:
    """Behind the first other letter that follows a vowel, from `start` on."""
    m = _BORDERS[vowels].search(word, start)
    return m.end() if m else len(word)


def _ending(word: str, endings) -> str:
    """The longest of the endings that the word has, or "". They come longest first."""
    for ending in endings:
        if word.endswith(ending):
            return ending
    return ""


def _short(word: str) -> bool:
    """Whether the word ends with a short syllable."""
    return bool(re.search(r"[^aeiouy][aeiouy][^aeiouywxY]$|^[aeiouy][^aeiouy]$", word))


def english(word: str) -> str:
    if len(word) < 3 or word in _WHOLE:
        return _WHOLE.get(word, word)
    word = re.sub(r"(^|(?<=[aeiouy]))y", "Y", word)
    start = next((len(p) for p in ("gener", "commun", "arsen") if word.startswith(p)), 0)
    one = start or _region(word, 0, "aeiouy")
    two = _region(word, one, "aeiouy")
    # Plurals.
    if word.endswith("sses"):
        word = word[:-2]
    elif word.endswith(("ied", "ies")):
        word = word[:-2] if len(word) > 4 else word[:-1]
    elif word.endswith("s") and not word.endswith(("us", "ss")) and re.search("[aeiouy]", word[:-2]):
        word = word[:-1]
    if word in _KEPT:
        return word
    # Past and progress.
    if ending := _ending(word, ("eedly", "eed")):
        if len(word) - len(ending) >= one:
            word = word[: -len(ending)] + "ee"
    elif (ending := _ending(word, ("ingly", "edly", "ing", "ed"))) and re.search("[aeiouy]", word[: -len(ending)]):
        word = word[: -len(ending)]
        if word.endswith(("at", "bl", "iz")):
            word += "e"
        elif word.endswith(_DOUBLE):
            word = word[:-1]
        elif len(word) <= one and _short(word):
            word += "e"
    if re.search(r".[^aeiouy][yY]$", word):
        word = word[:-1] + "i"
    # Suffixes of suffixes.
    if (ending := _ending(word, _SECOND)) and len(word) - len(ending) >= one:
        before = word[: -len(ending)]
        if (ending != "ogi" or before.endswith("l")) and (ending != "li" or before[-1:] in _LI and before):
            word = before + _SECOND[ending]
    if (ending := _ending(word, _THIRD)) and len(word) - len(ending) >= one and (ending != "ative" or len(word) - 5 >= two):
        word = word[: -len(ending)] + _THIRD[ending]
    if (ending := _ending(word, _FOURTH)) and len(word) - len(ending) >= two and (ending != "ion" or word[-4:-3] in ("s", "t")):
        word = word[: -len(ending)]
    if word.endswith("e") and (len(word) - 1 >= two or (len(word) - 1 >= one and not _short(word[:-1]))) or word.endswith("ll") and len(word) - 1 >= two:
        word = word[:-1]
    return word.replace("Y", "y")


def german(word: str) -> str:
    vowels = _VOWELS["de"]
    word = word.replace("ß", "ss")
    word = re.sub(rf"(?<=[{vowels}])[uy](?=[{vowels}])", lambda m: m.group().upper(), word)
    one = _region(word, 0, vowels)
    two, one = _region(word, one, vowels), max(3, one)
    cut = lambda ending: len(word) - len(ending)
    ending = _ending(word, ("ern", "em", "er", "en", "es", "e", "s"))
    if ending and cut(ending) >= one and (ending != "s" or word[-2:-1] in tuple("bdfghklmnrt")):
        word = word[: cut(ending)]
        if ending in ("e", "en", "es") and word.endswith("niss"):
            word = word[:-1]
    ending = _ending(word, ("est", "en", "er", "st"))
    if ending and cut(ending) >= one and (ending != "st" or (len(word) >= 6 and word[-3] in "bdfghklmnt")):
        word = word[: cut(ending)]
    ending = _ending(word, ("isch", "lich", "heit", "keit", "end", "ung", "ig", "ik"))
    if ending and cut(ending) >= two:
        before = word[: cut(ending)]
        if ending not in ("ig", "ik", "isch") or not before.endswith("e"):
            word = before
            if ending in ("end", "ung") and word.endswith("ig") and len(word) - 2 >= two and word[-3:-2] != "e":
                word = word[:-2]
            elif ending in ("lich", "heit") and word.endswith(("er", "en")) and len(word) - 2 >= one:
                word = word[:-2]
            elif ending == "keit" and (more := _ending(word, ("lich", "ig"))) and cut(more) >= two:
                word = word[: cut(more)]
    return word.translate(str.maketrans("äöüUY", "aouuy"))


def stems(word: str) -> list[str]:
    """The folded stems in both languages, of two letters or more, sorted."""
    fold = str.maketrans(FOLDS)
    return sorted({s for s in (german(word).translate(fold), english(word).translate(fold)) if len(s) >= 2})


def stems_of(word: Column) -> Column:
    """`stems` as a column, for a table that has each word once."""

    @F.pandas_udf("array<string>")
    def of_batch(words: pd.Series) -> pd.Series:
        return words.map(lambda w: stems(w) if w else [])

    return of_batch(word)
