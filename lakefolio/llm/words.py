"""Encoding whole texts word by word.

The tokenizer drops white space and never joins across it, so a text's ids are
those of its words (cut at spaces and newlines) one after another; a word's ids
are those of its pre-tokens. Both come back often; their ids are kept, up to a
bounded number, for later batches.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex

#: Words, and pre-tokens, whose ids a Python worker keeps.
KEPT = 128_000
#: Characters of text that are encoded together.
BATCH_CHARS = 1_000_000


def byte_letters() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letters, spare = {}, 256
    for byte in range(256):
        letters[byte] = chr(byte if byte in plain else spare)
        spare += byte not in plain
    return [letters[b] for b in range(256)]


def specification(path: str) -> dict:
    with open(path, encoding="utf-8") as file:
        return json.load(file)


#: Letters and signs whose lower case, normal form and category are the same in
#: all Unicode tables and do not depend on neighbours: ASCII, Latin, Greek without
#: sigma, Cyrillic, kana, ideographs and Hangul syllables. A test holds every one
#: of them against the library; words with others are cut by the library itself.
STABLE = "\\x00-\\x7f\u00a1-\u00ac\u00ae-\u012f\u0132-\u0148\u014a-\u017e\u0391-\u03a1\u03a4-\u03a9\u03b1-\u03c1\u03c3-\u03c9\u0401-\u044f\u0451-\u045f\u2010-\u2027\u2030-\u205e\u20a0-\u20bf\u3041-\u3096\u30a1-\u30fa\u4e00-\u9fd5\uac00-\ud7a3"


class Cutter:
    """Special tokens verbatim, then normal form, lower case and pre-tokens, as
    the tokenizer file says. The library does it, word by word; words of stable
    letters only are cut here, by the file's own pattern."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        file = specification(path)
        model = {**file["model"], "vocab": {}, "merges": []}  # the rules of cutting need no vocabulary
        library = Tokenizer.from_str(json.dumps({**file, "model": model, "added_tokens": []}))
        self.special = {t["content"]: t["id"] for t in file["added_tokens"]}
        self.found = regex.compile("|".join(map(regex.escape, self.special))) if self.special else None
        self.separators, self.odd = regex.compile(r"[\x1c-\x1f]"), regex.compile(f"[^{STABLE}]")
        pattern = next(p["pattern"]["Regex"] for p in file["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.split = regex.compile(pattern)
        self.normalise, self.pre_tokenise = library.normalizer.normalize_str, library.pre_tokenizer.pre_tokenize_str

    def words(self, text: str) -> list[str]:
        """The text cut at white space, or at some of it where Python's idea of
        white space is wider; in lower case where that can be done at once."""
        if "<|" not in text and (text.isascii() or not self.odd.search(text)):
            text = text.lower()
        return text.replace("\n", " ").split(" ") if self.separators.search(text) else text.split()

    def parts(self, word: str) -> list[str | int]:
        """Pre-tokens; special tokens as their ids."""
        if word.isascii():
            if word.isalpha():
                return [word.lower()]
            if word[:-1].isalpha() and word[-1] in ".,":
                return [word[:-1].lower(), word[-1]]
        if self.found and "<" in word and (found := self.found.search(word)):
            return [*self.parts(word[: found.start()]), self.special[found.group()], *self.parts(word[found.end() :])]
        if self.odd.search(word):
            word = self.normalise(word)
            return [word[a:b] for _, (a, b) in self.pre_tokenise(word)]
        return self.split.findall(word.lower())


class WordEncoder:
    """encode: ids of each of a list of pre-tokens, as little-endian 32-bit integers."""

    def __init__(self, cutter: Cutter, encode: Callable[[list[str]], list[bytes]], kept: int = KEPT):
        self.cutter, self.encode, self.kept = cutter, encode, kept
        self.words: dict[str, bytes] = {"": b""}
        self.parts: dict[str | int, bytes] = {i: np.array([i], "<u4").tobytes() for i in cutter.special.values()}

    def texts(self, texts: Iterable[str | None]) -> Iterator[bytes]:
        some, chars = [], 0
        for text in texts:
            some.append(self.cutter.words(text or ""))
            chars += len(text or "")
            if chars > BATCH_CHARS:
                yield from self._batch(some)
                some, chars = [], 0
        yield from self._batch(some)

    def _batch(self, some: list[list[str]]) -> Iterator[bytes]:
        new = list(set().union(*some).difference(self.words))
        cut = [[w] if w.isascii() and w.isalpha() and w.islower() else self.cutter.parts(w) for w in new]
        parts = list(set().union(*cut).difference(self.parts))
        self.parts.update(zip(parts, self.encode(parts)))
        ids = self.parts.__getitem__
        self.words.update(zip(new, [ids(p[0]) if len(p) == 1 else b"".join(map(ids, p)) for p in cut]))
        for text in some:
            yield b"".join(map(self.words.__getitem__, text))
        for known, added in ((self.words, new), (self.parts, parts)):
            if len(known) > self.kept:
                for key in added:
                    del known[key]


def in_slices(batches: Iterator[pa.RecordBatch], rows: int = 500) -> Iterator[tuple[list, list]]:
    """(ids, texts) of a few rows at a time, so that few texts are Python strings."""
    for batch in batches:
        for low in range(0, batch.num_rows, rows):
            part = batch.slice(low, rows)
            yield part.column(0).to_pylist(), part.column(1).to_pylist()
