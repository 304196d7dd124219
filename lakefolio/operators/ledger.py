"""Jobs, alterations, findings and lists of the archive's ledger."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from .settled import settle
from .skew import parts_of


def stage_limit(stage: Column, pages: Column, base: float = 600, a_page: float = 60, model: float = 300) -> Column:
    """Seconds that a stage may take: stages that go page by page get more for
    every page after the first, analysis at least the model's time and 120."""
    by_page = base + a_page * F.greatest(F.lit(0), F.coalesce(pages, F.lit(0)) - 1)
    return F.when(stage == "analyze", float(max(base, model + 120))).when(stage.isin("enhance", "ocr"), by_page).otherwise(F.lit(float(base)))


def queue_rows(jobs: DataFrame, now: Column, stages: dict[str, Sequence[str]]) -> DataFrame:
    """Adds (step, steps, outcome, seconds) to jobs of (kind, stage, state,
    last_error, started_at, finished_at): the stage's place among its kind's,
    and how long the job ran, until now while it is running."""
    place, steps = F.lit(0), F.lit(0)
    for kind, names in stages.items():
        at = F.array_position(F.array(*map(F.lit, names)), F.col("stage")).cast("int")
        place, steps = F.when(F.col("kind") == kind, at).otherwise(place), F.when(F.col("kind") == kind, len(names)).otherwise(steps)
    state = F.col("state")
    outcome = F.when(state == "done", "done").when(state == "failed", F.when(F.col("last_error") == "Cancelled", "cancelled").otherwise("failed")).otherwise("")
    end = F.coalesce("finished_at", F.when(state == "running", now))
    seconds = F.round((F.unix_micros(end.cast("timestamp_ltz")) - F.unix_micros(F.col("started_at").cast("timestamp_ltz"))) / 1e6, 1)
    return jobs.withColumns({"step": F.coalesce(place, F.lit(0)), "steps": steps, "outcome": outcome, "seconds": seconds})


def clamped(settings: Column, defaults: dict[str, tuple[float, float, float]]) -> Column:
    """A struct of (default, low, high) settings from a map of strings: what is no
    number is the default, what is out of range its end."""
    def one(name: str, default: float, low: float, high: float) -> Column:
        return F.greatest(F.lit(low), F.least(F.lit(high), F.coalesce(settings[name].try_cast("double"), F.lit(default)))).alias(name)

    return F.struct(*(one(name, *limits) for name, limits in defaults.items()))


def lineage(alterations: DataFrame) -> DataFrame:
    """(document, alteration, role): every alteration that names a document among
    its sources, results or retired ones. One pass: arrays are exploded where
    they lie and never searched."""
    roles = F.array(*(F.struct(F.lit(role).alias("role"), F.col(role).alias("documents")) for role in ("sources", "results", "retired")))
    rows = alterations.select("alteration", F.explode(roles).alias("r")).select("alteration", "r.role", F.explode("r.documents").alias("document"))
    return rows.distinct()


def undoable(alterations: DataFrame, docs: DataFrame) -> DataFrame:
    """(alteration, undoable, why): an alteration can be undone if it was not,
    all it made is active and none of what it retired came back.

    alterations: (alteration, kind, sources, results, retired, undone_at); docs:
    (document, deleted_at). What a restoration made is all of its results.
    """
    made = F.when(F.col("kind") == "restore", F.col("results")).otherwise(F.array_except("results", "sources"))
    back = F.when(F.col("kind") == "restore", F.array().cast(alterations.schema["retired"].dataType)).otherwise(F.array_distinct("retired"))
    rows = alterations.select("alteration", "kind", "undone_at", F.array_distinct(made).alias("made"), back.alias("back"))
    named = rows.select("alteration", F.explode("made").alias("document"), F.lit(True).alias("new")).union(rows.select("alteration", F.explode("back"), F.lit(False)))
    joined = named.join(docs.withColumn("there", F.lit(True)), "document", "left")
    gone = F.col("deleted_at").isNotNull() | F.col("there").isNull()
    found = joined.groupBy("alteration").agg(F.count_if(F.col("new") & gone).alias("lost"), F.count_if(~F.col("new") & ~gone).alias("restored"))
    why = (
        F.when(F.col("undone_at").isNotNull(), "undone").when(F.col("kind") == "edit", "edit").when(F.coalesce("lost", F.lit(0)) > 0, "lost").when(F.coalesce("restored", F.lit(0)) > 0, "restored").otherwise("")
    )
    return rows.join(found, "alteration", "left").select("alteration", (why == "").alias("undoable"), why.alias("why"))


def restorable(trashed: DataFrame, active: DataFrame) -> DataFrame:
    """(document, restorable): trashed documents of (document, content_hash) that
    no active one, nor another of them, equals."""
    twice = trashed.groupBy("content_hash").agg((F.count("*") > 1).alias("twice"))
    there = active.select("content_hash").distinct().withColumn("there", F.lit(True))
    rows = trashed.join(twice, "content_hash").join(there, "content_hash", "left")
    return rows.select("document", (~F.col("twice") & F.col("there").isNull()).alias("restorable"))


def findings_united(findings: Sequence[DataFrame]) -> DataFrame:
    """(kind, documents, action): findings that say the same, of one kind, about
    the same documents in any order, with the same action, count once; the order
    of the documents kept is the smallest."""
    every = findings[0]
    for more in findings[1:]:
        every = every.unionByName(more)
    key = (F.col("kind"), F.array_sort("documents").alias("same"), F.coalesce("action", F.lit("")).alias("what"))
    return every.groupBy(*key).agg(F.min("documents").alias("documents"), F.min("action").alias("action")).select("kind", "documents", "action")


def composed(sources: Column, outputs: Column) -> Column:
    """The action that makes documents of pages: JSON of sources and outputs, an
    array of arrays of (document, page)."""
    pages = F.transform(outputs, lambda output: F.struct(output.alias("pages"), F.lit("").alias("title")))
    return F.to_json(F.struct(F.lit("compose").alias("type"), sources.alias("sources"), pages.alias("outputs")))


def open_findings(findings: DataFrame, decisions: DataFrame) -> DataFrame:
    """Findings (task, finding, verdict) not dropped, and not decided yet."""
    return findings.filter(F.coalesce("verdict", F.lit("")) != "drop").join(decisions.select("task", "finding"), ["task", "finding"], "left_anti")


def ranked_tags(uses: DataFrame, own: DataFrame, most: int = 80) -> DataFrame:
    """(doc_id, place, tag): a document's own tags first, then the most used, by
    name; `most` of them. uses: (tag, n), all tags; own: (doc_id, tag).

    The tags that are no document's own are the same for all documents: the
    `most` first of them are enough, however many there are."""
    own, used = settle(own.select("doc_id", "tag")), uses.orderBy(F.desc("n"), "tag").limit(most)
    mine = own.join(uses, "tag").select("doc_id", "tag", "n", F.lit(0).alias("rank"))
    rest = own.select("doc_id").distinct().crossJoin(F.broadcast(used)).select("doc_id", "tag", "n", F.lit(1).alias("rank"))
    # one shuffle, by document: what is its own counts as that, and the rest is ranked where it lies
    rows = mine.union(rest).repartition(parts_of(own.count()), "doc_id").groupBy("doc_id", "tag").agg(F.max("n").alias("n"), F.min("rank").alias("rank"))
    order = Window.partitionBy("doc_id").orderBy("rank", F.desc("n"), "tag")
    return rows.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= most).select("doc_id", "place", "tag")


def series_list(series: DataFrame, docs: DataFrame) -> DataFrame:
    """(series, active, latest): members that are not deleted, and the latest
    date of all; suggested series without active members are hidden."""
    counts = docs.groupBy("series").agg(F.count_if(F.col("deleted_at").isNull()).alias("active"), F.max("day").alias("latest"))
    rows = series.join(counts, "series", "left").withColumn("active", F.coalesce("active", F.lit(0)))
    return rows.filter(~F.col("suggested") | (F.col("active") > 0)).select("series", "active", "latest")


def year_folders(docs: DataFrame, existing: DataFrame, least: int = 3) -> DataFrame:
    """(doc_id, target, year): the year folder that a document goes to, if any.

    docs: (doc_id, target, new, year, recurring), `new` for a folder that is yet
    to be made; existing: (target, year), folders of years that are there. A new
    folder is split with `least` documents or more, of two years or mostly
    recurring; another where it has year folders already.
    """
    stats = docs.groupBy("target").agg(
        F.count("*").alias("n"), F.count_distinct("year").alias("years"), (2 * F.count_if("recurring") >= F.count("*")).alias("mostly"), F.first("new").alias("fresh")
    )
    habit = existing.select("target").distinct().withColumn("habit", F.lit(True))
    split = F.when(F.col("fresh"), (F.col("n") >= least) & ((F.col("years") >= 2) | F.col("mostly"))).otherwise(F.coalesce("habit", F.lit(False))) & (F.col("years") > 0)
    rule = stats.join(habit, "target", "left").select("target", split.alias("split"))
    return docs.join(rule, "target").select("doc_id", "target", F.when(F.col("split"), F.col("year")).alias("year"))


# What names of secret settings hold or end with, and ends of names that are none after all.
SECRET_PARTS = ("secret", "password", "passwd", "token", "api_key", "master_key", "private")
SECRET_END = "_key"
OPEN_ENDS = ("_file", "_hashers", "_validators")


def tells_secret(name: Column) -> Column:
    """Whether a setting's name is one of a secret, in any case of letters: it
    holds a word for one or ends like a key, and is no path and no rule."""
    low = F.lower(name)
    any_of = lambda some, test: F.exists(F.array(*map(F.lit, some)), lambda part: test(low, part))
    return (any_of(SECRET_PARTS, F.contains) | low.endswith(SECRET_END)) & ~any_of(OPEN_ENDS, F.endswith)


def shown_setting(name: Column, value: Column) -> Column:
    """What a list of settings shows: a secret by its length alone, or as empty."""
    length = F.length(F.coalesce(value, F.lit("")))
    hidden = F.when(length == 0, F.lit("empty")).otherwise(F.format_string("set (%d chars)", length))
    return F.when(tells_secret(name), hidden).otherwise(value)


def hamming(a: Column, b: Column) -> Column:
    """Bits in which two hashes of 64 hexadecimal digits differ."""
    word = lambda x, i: F.conv(F.substring(x, 1 + 8 * i, 8), 16, 10).cast("long")
    return sum(F.bit_count(word(a, i).bitwiseXOR(word(b, i))) for i in range(8))


def clean_names(names: Column) -> Column:
    """Folder names trimmed; null if one is empty or holds a slash."""
    trimmed = F.transform(names, lambda n: F.trim(n))
    return F.when(F.exists(trimmed, lambda n: (n == "") | n.contains("/") | n.contains("\\")), F.lit(None)).otherwise(trimmed)


def sender_entry(text: Column) -> Column:
    """An address or an @domain in small letters, null if it is neither."""
    low = F.lower(F.trim(text))
    return F.when(low.rlike(r"^[^@\s]*@[a-z0-9-]+(\.[a-z0-9-]+)+$"), low)


def accented_spellings(docs: DataFrame) -> DataFrame:
    """(doc_id, text, plain, spelled) of docs (doc_id, text) that mostly spell a
    word with accents: such words without and with them, sorted by `plain`.

    A word's spelling is its most frequent one (ties: the first) in its document,
    in small letters. Words are counted where a document lies; a repeated id is one
    document of all its rows, and only then texts are brought together. Null texts
    and ids give no row.
    """
    docs = docs.filter("doc_id IS NOT NULL AND text IS NOT NULL").select("doc_id", "text")
    once = docs.groupBy("doc_id").agg(F.count("*").alias("n")).filter("n > 1").isEmpty()
    texts = docs if once else docs.groupBy("doc_id").agg(F.array_join(F.collect_list("text"), " ").alias("text"))
    marks = str.maketrans(T.ACCENTED, T.PLAIN)

    def spelled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("words")
            said = pa.array(lists.flatten()).dictionary_encode()
            words = said.dictionary.to_pylist()
            plain = [w if w.isascii() else w.translate(marks) for w in words]
            names = sorted({p for p, w in zip(plain, words) if p != w})
            number = {p: i for i, p in enumerate(names)}
            # a plain word that no word of the batch spells with accents is nothing to look at
            of = np.fromiter((number.get(p, -1) for p in plain), np.int64, len(words))
            place = np.empty(len(words), np.int64)
            place[sorted(range(len(words)), key=words.__getitem__)] = np.arange(len(words))
            rows, at = np.repeat(np.arange(len(lists)), np.diff(lists.offsets.to_numpy())), said.indices.to_numpy()
            some = of[at] >= 0
            pairs, n = np.unique(rows[some] * max(1, len(words)) + at[some], return_counts=True)
            row, word = np.divmod(pairs, max(1, len(words)))
            order = np.lexsort((place[word], -n, of[word], row))
            row, word = row[order], word[order]
            first = np.ones(len(row), bool)
            first[1:] = (row[1:] != row[:-1]) | (of[word][1:] != of[word][:-1])
            marked = np.fromiter((p != w for p, w in zip(plain, words)), bool, len(words))
            row, word = row[first & marked[word]], word[first & marked[word]]
            held, starts = np.unique(row, return_index=True)
            ends = pa.array(np.append(starts, len(row)).astype(np.int32))
            known = [pa.ListArray.from_arrays(ends, pa.array(x, pa.string()).take(pa.array(y))) for x, y in ((names, of[word]), (words, word))]
            columns = [batch.column(c).take(pa.array(held)) for c in ("doc_id", "text")] + known
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "text", "plain", "spelled"])

    runs = F.regexp_extract_all(F.col("text"), F.lit(r"([\p{L}\p{N}_]+)"), 1)
    said = texts.select("doc_id", "text", F.transform(runs, lambda w: F.lower(w)).alias("words"))
    found = said.mapInArrow(spelled, f"doc_id {dict(docs.dtypes)['doc_id']}, text string, plain array<string>, spelled array<string>")
    return found if once else docs.join(found.drop("text"), "doc_id")


def restored_diacritics(text: Column, plain: Column, spelled: Column) -> Column:
    """The text with words without accents replaced by the spelling at the same
    place of `spelled`, in the word's own case. plain, spelled: arrays of small
    words, without and with accents."""
    def put(word: Column) -> Column:
        at = F.array_position(plain, F.lower(word)).cast("int")
        new = F.get(spelled, at - 1)
        cased = F.when((F.upper(word) == word) & (F.length(word) > 1), F.upper(new)).when(F.upper(F.substring(word, 1, 1)) == F.substring(word, 1, 1), F.concat(F.upper(F.substring(new, 1, 1)), F.substr(new, F.lit(2)))).otherwise(new)
        return F.when(at > 0, cased).otherwise(word)

    return F.array_join(F.transform(F.split(text, " "), put), " ")
