"""Full-text search with BM25 over words, prefixes and compound tails.

A query reads the text once: matches are counted inside each row by patterns and
written (a few numbers a document); the document frequencies and the average
length are one aggregate row of those, and ranking is a top-k; no posting is
shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from .settled import settle

K1, B = 1.2, 0.6
# The weights of a whole word, a compound tail and a prefix.
WEIGHTS = {"W": 1.0, "X": 0.7, "P": 0.5}


#: Terms that a task counts before it hands them on, and documents that are counted at once.
TERMS, SLICE = 500_000, 500
_FOLDED, _STOPPED = str.maketrans(T.FOLDS), frozenset(T.STOP_WORDS)

_LETTER = r"[\p{L}\p{N}]"
_START, _END = rf"(?<!{_LETTER})", rf"(?!{_LETTER})"


def matches(text: Column, query: str) -> dict[str, Column]:
    """How many words of 2 to 40 letters match as a whole, as a tail and as a
    prefix. `text` is in small letters; texts without the query's letters are
    passed over."""
    n, word = len(query), rf"\Q{query}\E"
    kinds = {"W": rf"{_START}{word}{_END}"} if 2 <= n <= 40 else {}
    if 4 <= n <= 37:
        kinds["X"] = rf"{_START}{_LETTER}{{{max(8 - n, 3)},{40 - n}}}{word}{_END}"
    if 3 <= n <= 15:
        kinds["P"] = rf"{_START}{word}{_LETTER}{{1,{40 - n}}}{_END}"
    return {kind: F.when(text.contains(query), F.regexp_count(text, F.lit(pattern))).otherwise(0) for kind, pattern in kinds.items()}


def search(docs: DataFrame, query: list[str], candidates: Column | None = None, limit: int = 50) -> DataFrame:
    """(doc_id, score, total): the best documents that match every query word.

    Frequencies are counted over the candidates, lengths over all documents.
    """
    low = docs.select("doc_id", F.coalesce(F.lower("text"), F.lit("")).alias("low"), (candidates if candidates is not None else F.lit(True)).alias("candidate"))
    terms = {f"{kind}{i}": tf for i, q in enumerate(query) for kind, tf in matches(F.col("low"), q).items()}
    length = F.regexp_count("low", F.lit(rf"{_LETTER}{{2,}}+")) - F.regexp_count("low", F.lit(rf"{_LETTER}{{41,}}+"))
    rows = settle(low.select("doc_id", "candidate", F.greatest(length, F.lit(1)).alias("len"), *(tf.alias(k) for k, tf in terms.items())))
    hit = {i: F.expr(" OR ".join(f"{k} > 0" for k in terms if k[1:] == str(i))) for i in range(len(query))}
    stats = rows.agg(
        F.count("*").alias("n"), F.avg("len").alias("avglen"), *(F.count_if(hit[i] & F.col("candidate")).alias(f"df{i}") for i in hit)
    )
    norm = K1 * (1 - B + B * F.col("len") / F.col("avglen"))
    score = F.lit(0.0)
    for i in hit:
        best = F.greatest(F.lit(0.0), *(WEIGHTS[k[0]] * F.col(k) * (K1 + 1) / (F.col(k) + norm) for k in terms if k[1:] == str(i)))
        score = score + best * F.log(1 + (F.col("n") - F.col(f"df{i}") + 0.5) / (F.col(f"df{i}") + 0.5))
    every = F.col("candidate")
    for test in hit.values():
        every = every & test
    found = rows.filter(every).crossJoin(F.broadcast(stats)).select("doc_id", F.round(score, 6).alias("score"))
    total = found.agg(F.count("*").alias("total"))
    return found.orderBy(F.desc("score"), F.desc("doc_id")).limit(limit).crossJoin(F.broadcast(total))


def _dealt(docs: DataFrame) -> DataFrame:
    """(doc_id, text) dealt by document, so that all that is counted in one later
    is where it is: a text is smaller than its words or terms."""
    return docs.select("doc_id", "text").repartition("doc_id")


def word_terms(docs: DataFrame) -> DataFrame:
    """(doc_id, kind, term, tf): whole words, proper prefixes and compound tails."""
    counted = _dealt(docs).select("doc_id", F.explode(T.words("text")).alias("w")).groupBy("doc_id", "w").agg(F.count("*").alias("tf"))
    plain = ~F.col("w").isin(*T.STOP_WORDS) & ~F.col("w").rlike("^[0-9]+$")
    n = F.length("w")
    prefixes = F.when(plain & (n > 3), F.transform(F.sequence(F.lit(3), F.least(F.lit(15), n - 1)), lambda i: F.struct(F.lit("P").alias("kind"), F.substr("w", F.lit(1), i).alias("term"))))
    tails = F.when(plain & (n >= 8), F.transform(F.sequence(F.lit(4), n - 3), lambda i: F.struct(F.lit("X").alias("kind"), F.substr("w", i).alias("term"))))
    none = F.array().cast("array<struct<kind:string,term:string>>")
    every = F.concat(F.array(F.struct(F.lit("W").alias("kind"), T.fold(F.col("w")).alias("term"))), F.coalesce(prefixes, none), F.coalesce(tails, none))
    return counted.select("doc_id", "tf", F.explode(every).alias("t")).groupBy("doc_id", "t.kind", "t.term").agg(F.sum("tf").alias("tf"))


def _terms_of(word: str) -> list[tuple[str, str]]:
    """(kind, term) of a word, as in `word_terms`."""
    n, out = len(word), [("W", word.translate(_FOLDED))]
    if word not in _STOPPED and not (word.isascii() and word.isdigit()):
        out += [("P", word[:i]) for i in range(3, min(15, n - 1) + 1)]
        out += [("X", word[i:]) for i in range(3, n - 3)] if n >= 8 else []
    return out


def term_frequencies(docs: DataFrame) -> DataFrame:
    """(kind, term, df, cf): the documents with a term of `word_terms`, and how often they have it.

    Terms are made once a distinct word of a task and counted there, where a
    document lies; a task holds `TERMS` of them. A repeated id is one document of
    all its rows; only then texts are brought together.
    """
    docs = docs.select("doc_id", "text")
    if not docs.groupBy("doc_id").agg(F.count("*").alias("n")).filter("n > 1").isEmpty():
        docs = docs.groupBy("doc_id").agg(F.array_join(F.collect_list("text"), " ").alias("text"))

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, np.ndarray] = {}
        number: dict[tuple[str, str], int] = {}
        df, cf = np.zeros(TERMS, np.int64), np.zeros(TERMS, np.int64)

        def held() -> pa.RecordBatch:
            names, n = list(number), len(number)
            columns = [pa.array([k for k, _ in names], pa.string()), pa.array([t for _, t in names], pa.string()), pa.array(df[:n]), pa.array(cf[:n])]
            return pa.RecordBatch.from_arrays(columns, names=["kind", "term", "df", "cf"])

        for batch in batches:
            for low in range(0, len(batch), SLICE):
                lists = batch.column(0).slice(low, SLICE)
                said = pa.array(lists.flatten()).dictionary_encode()
                words = said.dictionary.to_pylist()
                if not words:
                    continue
                for w in words:
                    if w not in known:
                        known[w] = np.fromiter((number.setdefault(t, len(number)) for t in _terms_of(w)), np.int64)
                if len(number) > len(df):
                    more = np.zeros(len(number), np.int64)
                    df, cf = np.concatenate([df, more]), np.concatenate([cf, more])
                of = [known[w] for w in words]
                sizes, ids = np.fromiter(map(len, of), np.int64, len(of)), np.concatenate(of)
                rows = np.repeat(np.arange(len(lists)), np.diff(lists.offsets.to_numpy()))
                pairs, times = np.unique(rows * len(words) + said.indices.to_numpy(), return_counts=True)
                row, word = np.divmod(pairs, len(words))
                many, starts = sizes[word], np.cumsum(sizes) - sizes
                at = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many) + np.repeat(starts[word], many)
                terms = ids[at]
                cf += np.bincount(terms, np.repeat(times, many), len(cf)).astype(np.int64)
                once = np.sort(np.repeat(row, many) * len(df) + terms)
                df += np.bincount(once[np.diff(once, prepend=-1) > 0] % len(df), minlength=len(df))
                if len(number) > TERMS:
                    yield held()
                    known.clear(), number.clear()
                    df[:], cf[:] = 0, 0
        if number:
            yield held()

    words = docs.select(F.coalesce(T.words(F.col("text")), F.array().cast("array<string>")).alias("words"))
    rows = words.mapInArrow(counted, "kind string, term string, df long, cf long")
    return rows.groupBy("kind", "term").agg(F.sum("df").alias("df"), F.sum("cf").alias("cf"))


def signature(docs: DataFrame, top: int = 300) -> DataFrame:
    """(doc_id, place, term, tf): the most frequent words of each document."""
    counted = _dealt(docs).select("doc_id", F.explode(T.words("text")).alias("term")).filter(~F.col("term").isin(*T.STOP_WORDS))
    counted = counted.groupBy("doc_id", "term").agg(F.count("*").alias("tf"))
    order = Window.partitionBy("doc_id").orderBy(F.desc("tf"), "term")
    return counted.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= top)


def snippet(docs: DataFrame, word: str, around: int = 30) -> DataFrame:
    """(doc_id, place, snippet) of the first mention."""
    place = F.instr(F.lower("text"), word)
    cut = F.substr("text", F.greatest(place - around, F.lit(1)), F.lit(2 * around + len(word)))
    return docs.select("doc_id", place.alias("place"), F.replace(cut, F.lit("\n"), F.lit(" ")).alias("snippet")).filter("place > 0")
