"""A stored posting index: written once, replaced document by document.

A posting is (doc_id, version, field, term, tf), the term a keyed hash of its word.
What a word is asked for by are keyed hashes of a kind and text: W the folded word, S its
stems, P its beginnings of 3 to 15 letters, X the tails of words of 8 letters or
more. Those lie apart as (asked, term), once a distinct word, so a document's
posting is not repeated for each of them. Postings lie in `BUCKETS` folders by their
term and are sorted by it inside a file, the others likewise, so a query reads the
folders, and there the row groups, of what it asks for and of the words of that.

Documents are replaced by appending: their rows of statistics and their postings
carry a version, and a query joins the postings of its terms with the latest
versions, whose lengths it needs anyway. `compacted` writes the live postings anew.
"""

from __future__ import annotations

import hashlib
import hmac
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import stems as S
from ..functions import text as T
from .search import B, K1
from .settled import freed, settle

BUCKETS = 64
#: Words of a query's terms up to which their postings are found by a filter as well as by the join.
NAMED = 2_000
# Weights of fields and of kinds of terms; a stem that is a tail counts less.
FIELDS = {"title": 2.0, "meta": 1.5, "content": 1.0}
KINDS = {"W": 1.0, "S": 0.9, "X": 0.7, "P": 0.5}
STEM_TAIL = 0.9
#: Query words at most.
MAX_WORDS = 12
_MOST_TF = 32_767
#: Words whose stems a task keeps, and those of a batch.
KNOWN_STEMS = 200_000
#: Words whose terms are made at once.
WORDS = 2_000
_COMMON = frozenset(T.COMMON_WORDS)


def field_words(docs: DataFrame, key: bytes) -> DataFrame:
    """(doc_id, field, word, tf) of docs (doc_id, title, content, meta): a word of a
    field, hashed, and its count, without a shuffle. field: its place in `FIELDS`."""
    names = list(FIELDS)

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, int] = {}  # as many as a task has words
        hashed = _hasher(key)
        for batch in batches:
            for at, name in enumerate(names):
                lists = batch.column(name)
                said = pa.array(lists.flatten()).dictionary_encode()
                words = said.dictionary.to_pylist()
                for w in words:
                    if w not in known:
                        known[w] = hashed("V", w)
                rows = np.repeat(np.arange(len(lists)), np.diff(lists.offsets.to_numpy()))
                pairs, times = np.unique(rows * max(1, len(words)) + said.indices.to_numpy(), return_counts=True)
                hashes = np.fromiter((known[w] for w in words), np.int64, len(words))
                ids = batch.column("doc_id").take(pa.array(pairs // max(1, len(words))))
                columns = [ids, pa.array(np.full(len(pairs), at, np.int8)), pa.array(hashes[pairs % max(1, len(words))]), pa.array(times.astype(np.int32))]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "field", "word", "tf"])

    none = F.array().cast("array<string>")
    words = docs.select("doc_id", *(F.coalesce(T.words(F.col(c)), none).alias(c) for c in names))
    return words.mapInArrow(counted, f"doc_id {dict(docs.dtypes)['doc_id']}, field tinyint, word long, tf int")


def hash_of(kind: str, value: str, key: bytes) -> int:
    """The hash of one term, for queries."""
    return int.from_bytes(hmac.new(key, f"{kind}\0{value}".encode(), hashlib.sha256).digest()[:8], "big", signed=True)


def _hasher(key: bytes) -> Callable[[str, str], int]:
    """`hash_of` for many terms: the key is worked in once."""
    block = (hashlib.sha256(key).digest() if len(key) > 64 else key).ljust(64, b"\0")
    inner, outer = (hashlib.sha256(bytes(b ^ pad for b in block)) for pad in (0x36, 0x5C))

    def hashed(kind: str, value: str) -> int:
        first, then = inner.copy(), outer.copy()
        first.update(f"{kind}\0{value}".encode())
        then.update(first.digest())
        return int.from_bytes(then.digest()[:8], "big", signed=True)

    return hashed


def _word_terms(word: str, folded: str, kinds: str) -> set[tuple[str, str]]:
    """What a word is asked for by: (kind, text)."""
    n, out = len(folded), {("W", folded)} if "W" in kinds else set()
    if "S" in kinds:
        out.update(("S", s) for s in S.stems(word))
    if word not in _COMMON and folded not in _COMMON and not (folded.isascii() and folded.isdigit()):
        if "P" in kinds:
            out.update(("P", folded[:i]) for i in range(3, min(15, n - 1) + 1))
        if "X" in kinds and n >= 8:
            out.update(("X", folded[i:]) for i in range(3, n - 3))
    return out


def dictionary(words: DataFrame, key: bytes, kinds: str = "WSPX") -> DataFrame:
    """(word, term, terms) for the distinct words of a table: term is the word's
    own hash, terms have kind and hash. Made in Arrow batches of words that are
    distinct already; a condition on columns would be put before that, where
    every word of every document is one of its own."""

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashed = _hasher(key)
        for batch in batches:
            for low in range(0, len(batch), WORDS):
                words = batch.column(0).slice(low, WORDS)
                named = [_word_terms(w, f, kinds) for w, f in zip(words.to_pylist(), batch.column(1).slice(low, WORDS).to_pylist())]
                own = np.fromiter((hashed("V", w) for w in words.to_pylist()), np.int64, len(words))
                ends = np.cumsum([0, *map(len, named)])
                hashes = pa.array(np.fromiter((hashed(k, v) for some in named for k, v in some), np.int64, ends[-1]))
                terms = pa.StructArray.from_arrays([pa.array([k for some in named for k, _ in some], pa.string()), hashes], names=["kind", "term"])
                yield pa.RecordBatch.from_arrays([words, pa.array(own), pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), terms)], names=["word", "term", "terms"])

    known = words.select("word").filter("word IS NOT NULL").distinct().select("word", T.fold(F.col("word")).alias("folded"))
    return known.mapInArrow(made, "word string, term long, terms array<struct<kind:string,term:long>>")


def write(docs: DataFrame, folder: str, key: bytes, version: int = 0, kinds: str = "WSPX", files: int = 1) -> None:
    """Adds documents (doc_id, title, content, meta) to the index in `folder`.

    Documents that it has already are replaced if `version` is larger than
    theirs. Null fields have no words; documents without words have a length of
    one; a repeated id is one document of all its rows. `files`: files a bucket.
    """
    with freed(docs.sparkSession):
        part = F.pmod(F.xxhash64("doc_id"), F.lit(files))
        rows = field_words(docs, key).repartition(_bucket("word"), part)
        name = F.element_at(F.array(*map(F.lit, FIELDS)), F.col("field") + 1)
        rows = rows.select("doc_id", F.lit(version).alias("version"), name.alias("field"), F.col("word").alias("term"), "tf", _bucket("word").alias("bucket"))
        rows.sortWithinPartitions("bucket", "term").write.mode("append").partitionBy("bucket").parquet(f"{folder}/postings")
        none = F.array().cast("array<string>")
        of = {name: F.coalesce(T.words(F.col(name)), none) for name in FIELDS}
        said = docs.select(F.explode(F.array_distinct(F.concat(*of.values()))).alias("word"))
        _write_terms(dictionary(said, key, kinds).select("term", F.explode("terms.term").alias("asked")), folder)
        lengths = docs.groupBy("doc_id").agg(F.sum(F.size(of["title"]) + F.size(of["content"])).alias("length"))
        lengths.select("doc_id", F.lit(version).alias("version"), F.greatest("length", F.lit(1)).cast("long").alias("length")).write.mode("append").parquet(f"{folder}/stats")


def _bucket(column: str) -> Column:
    return F.pmod(column, F.lit(BUCKETS)).cast("int")


def _write_terms(terms: DataFrame, folder: str) -> None:
    """Writes (asked, term), in which no row is twice."""
    rows = terms.select("asked", "term", _bucket("asked").alias("bucket"))
    rows.repartition("bucket").sortWithinPartitions("bucket", "asked").write.mode("append").partitionBy("bucket").parquet(f"{folder}/terms")


def remove(ids: DataFrame, folder: str, version: int) -> None:
    """Takes the documents of (doc_id) out of the index."""
    ids.select("doc_id").distinct().select("doc_id", F.lit(version).alias("version"), F.lit(None).cast("long").alias("length")).write.mode("append").parquet(f"{folder}/stats")


def statistics(spark: SparkSession, folder: str) -> DataFrame:
    """(doc_id, version, length) of the documents in the index."""
    rows = spark.read.parquet(f"{folder}/stats")
    return rows.groupBy("doc_id").agg(F.max("version").alias("version"), F.max_by("length", "version").alias("length")).filter("length IS NOT NULL")


def _in(rows: DataFrame, column: str, some: list[int]) -> DataFrame:
    """The stored rows of some values: their buckets are read, no others."""
    return rows.filter(F.col("bucket").isin(sorted({x % BUCKETS for x in some})) & F.col(column).isin(some))


def postings(spark: SparkSession, folder: str, terms: list[int]) -> DataFrame:
    """(doc_id, version, field, term, tf): the stored postings of some terms, a row a word of a term."""
    words = settle(_in(spark.read.parquet(f"{folder}/terms"), "asked", terms).select("asked", "term").distinct())
    rows = spark.read.parquet(f"{folder}/postings")
    named = [r.term for r in words.select("term").distinct().limit(NAMED + 1).collect()]
    if len(named) <= NAMED:
        rows, words = _in(rows, "term", named), F.broadcast(words)
    return rows.join(words, "term").select("doc_id", "version", "field", F.col("asked").alias("term"), "tf")


def compacted(spark: SparkSession, folder: str, to: str) -> None:
    """Writes the live postings, their words' terms and statistics of an index to another folder."""
    stats = settle(statistics(spark, folder))
    live = spark.read.parquet(f"{folder}/postings").join(stats.select("doc_id", "version"), ["doc_id", "version"], "left_semi")
    live = live.select("doc_id", "version", "field", "term", "tf", "bucket")
    live.repartition("bucket").sortWithinPartitions("bucket", "term").write.partitionBy("bucket").parquet(f"{to}/postings")
    words = spark.read.parquet(f"{to}/postings").select("term").distinct()
    _write_terms(spark.read.parquet(f"{folder}/terms").join(words, "term", "left_semi").select("asked", "term").distinct(), to)
    stats.write.parquet(f"{to}/stats")


def query_words(query: str) -> list[str]:
    """The distinct words of a query, common ones only where there are no others."""
    said = list(dict.fromkeys(w for w in _runs(query) if 2 <= len(w) <= 40))
    return ([w for w in said if _folded(w) not in T.COMMON_WORDS] or said)[:MAX_WORDS]


def _runs(text: str) -> list[str]:
    return "".join(c if c.isalnum() else " " for c in text.lower()).split()


def _folded(word: str) -> str:
    return word.translate(str.maketrans(T.FOLDS))


def query_terms(word: str, kinds: str = "WSPX") -> dict[tuple[str, str], float]:
    """What a query word may match, with the weight of the match."""
    folded, out = _folded(word), {}
    for s in S.stems(word) if "S" in kinds else ():
        out["S", s] = KINDS["S"]
        if len(s) >= 4:
            out["X", s] = KINDS["X"] * STEM_TAIL
    out |= {("W", folded): KINDS["W"], ("P", folded): KINDS["P"]}
    if len(folded) >= 4:
        out["X", folded] = KINDS["X"]
    return {t: w for t, w in out.items() if t[0] in kinds}


def search(spark: SparkSession, folder: str, query: str, key: bytes, candidates: DataFrame | None = None, limit: int = 50, offset: int = 0, kinds: str = "WSPX") -> DataFrame:
    """(doc_id, score, total): the best documents that match every query word.

    A word's score is its best match over kinds and fields; document frequencies
    are counted over the candidates (doc_id), lengths over all documents. Ties go
    to the larger id. A query without words gives no rows.
    """
    asked = [(hash_of(*t, key), i, w) for i, word in enumerate(query_words(query)) for t, w in query_terms(word, kinds).items()]
    words = 1 + max((i for _, i, _ in asked), default=-1)
    stats = statistics(spark, folder)
    held = F.broadcast(stats.agg(F.count("*").alias("n"), F.avg("length").alias("avglen")))
    found = postings(spark, folder, [t for t, _, _ in asked])
    if candidates is not None:
        found = found.join(candidates.select("doc_id").distinct(), "doc_id", "left_semi")
    found = found.groupBy("doc_id", "version", "field", "term").agg(F.least(F.sum("tf"), F.lit(_MOST_TF)).cast("int").alias("tf"))
    q = F.broadcast(spark.createDataFrame(asked, "term long, qi int, w double"))  # a few terms a word
    weight = F.lit(0.0)
    for name, w in FIELDS.items():
        weight = F.when(F.col("field") == name, w).otherwise(weight)
    norm = K1 * (1 - B + B * F.col("length") / F.col("avglen"))
    rows = found.join(q, "term").join(stats, ["doc_id", "version"]).crossJoin(held)  # one row
    best = rows.groupBy("doc_id", "qi").agg(F.max(F.col("w") * weight * F.col("tf") * (K1 + 1) / (F.col("tf") + norm)).alias("s"), F.first("n").alias("n"))
    best = settle(best)
    seen = F.broadcast(best.groupBy("qi").agg(F.count("*").alias("df")))  # a row a query word
    scored = best.join(seen, "qi").groupBy("doc_id").agg(F.sum(F.col("s") * F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))).alias("score"), F.count("*").alias("words"))
    every = scored.filter(F.col("words") == words).select("doc_id", F.round("score", 6).alias("score"))
    total = every.agg(F.count("*").alias("total"))
    return every.orderBy(F.desc("score"), F.desc("doc_id")).offset(offset).limit(limit).crossJoin(F.broadcast(total))


def signatures(docs: DataFrame, top: int = 300) -> DataFrame:
    """(doc_id, place, stem, tf): the most frequent stems of (doc_id, content).

    Words are counted, stemmed and ranked where a document lies: only its `top`
    stems leave a task, and nothing but ids is shuffled. A repeated id is one
    document of all its rows; only then texts are brought together.
    """
    counts = docs.groupBy("doc_id").agg(F.count("*").alias("n"))
    if not counts.filter("n > 1").isEmpty():
        docs = docs.groupBy("doc_id").agg(F.array_join(F.collect_list("content"), " ").alias("content"))

    def ranked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, list[str]] = {}
        for batch in batches:
            lists = batch.column("words")
            said = pa.array(lists.flatten()).dictionary_encode()
            words = said.dictionary.to_pylist()
            rows = np.repeat(np.arange(len(lists)), np.diff(lists.offsets.to_numpy()))
            pairs, times = np.unique(rows * max(1, len(words)) + said.indices.to_numpy(), return_counts=True)
            if len(known) > KNOWN_STEMS:
                known.clear()
            for w in words:
                if w not in known:
                    known[w] = S.stems(w)
            names = sorted({s for w in words for s in known[w]})
            number = {s: i for i, s in enumerate(names)}
            of = [np.fromiter((number[known[w][n]] if len(known[w]) > n else -1 for w in words), np.int64, len(words)) for n in (0, 1)]  # two stems at most
            row, word = np.divmod(pairs, max(1, len(words)))
            stem, row, times = np.concatenate([x[word] for x in of]), np.tile(row, 2), np.tile(times, 2)
            keys, back = np.unique((row * max(1, len(names)) + stem)[stem >= 0], return_inverse=True)
            tf = np.bincount(back, times[stem >= 0], len(keys)).astype(np.int64)
            row, stem = np.divmod(keys, max(1, len(names)))
            order = np.lexsort((stem, -tf, row))
            row, stem, tf = row[order], stem[order], tf[order]
            place = np.arange(len(row)) - np.searchsorted(row, row) + 1
            kept = place <= top
            columns = [batch.column("doc_id").take(pa.array(row[kept])), pa.array(place[kept].astype(np.int32)), pa.array(names, pa.string()).take(pa.array(stem[kept])), pa.array(tf[kept])]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "place", "stem", "tf"])

    words = docs.select("doc_id", F.coalesce(T.words(F.col("content")), F.array().cast("array<string>")).alias("words"))
    return words.mapInArrow(ranked, f"doc_id {dict(docs.dtypes)['doc_id']}, place int, stem string, tf bigint")
