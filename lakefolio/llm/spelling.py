"""Spelling variants: near words by tries and Levenshtein automata.

The words of a corpus are counted, dealt out by ranges and sorted. Slices of the
sorted words become compact tries, a byte a node for its letter and an integer
for its first child. Tries are broadcast, as many at once as `BROADCAST_BYTES`
hold and in as many rounds as that takes, and each word's distance-one automaton
is intersected with every trie depth-first. A word's states after a prefix are
the node spelt without an error and those spelt with one; sorted words share the
states of their common prefixes, and a prefix without states ends all its words.
Only the number of near words and the best of them leave a task.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import settle, trimmed

LETTERS = r"A-Za-zÀ-ÿ"
#: Words of a trie.
SHARD_WORDS = 1 << 16
#: Words that a task intersects with the tries.
TASK_WORDS = 1 << 15
#: Bytes of the tries that are broadcast at once.
BROADCAST_BYTES = 1 << 26


class Trie:
    """Nodes in breadth-first order: the children of node x are the nodes
    start[x] + 1 to start[x + 1], and node v is entered by the letter labels[v - 1].
    rank[v] is the place, among the sorted words, of the word that ends in v, or -1."""

    def __init__(self, words: list[bytes], counts: np.ndarray):
        """words: sorted and distinct, in Latin-1."""
        ends = np.cumsum([len(w) for w in words], dtype=np.int64)
        text, size = np.frombuffer(b"".join(words), np.uint8), np.diff(ends, prepend=0)
        begin = ends - size
        # At each depth: the words that go on, whether they share all letters so far with the word before, and their node.
        live, same, node = np.arange(len(words)), np.ones(len(words), bool), np.zeros(len(words), np.int64)
        rank, labels, starts, last, depth = [np.full(1, -1, np.int32)], [], [], 0, 0
        if len(words) and not size[0]:
            rank[0][0] = 0
        same[:1] = False
        first = np.zeros(1, np.int64)  # the nodes of this depth
        while True:
            live = live[size[live] > depth]
            letter = text[begin[live] + depth]
            before = np.concatenate([[-1], live[:-1]])
            tied = same[live] & (before == live - 1)
            tied[1:] &= letter[1:] == letter[:-1]
            tied[:1] = False
            parents = node[live][~tied]
            # Children in front of each node of this depth.
            starts.append(last + np.searchsorted(parents, first, side="left"))
            if not len(live):
                break
            new = last + np.cumsum(~tied)
            labels.append(letter[~tied])
            # A word with this depth's end is the one without further letters: the first of its node.
            marks = np.full(int((~tied).sum()), -1, np.int32)
            done = size[live] == depth + 1
            marks[new[done] - last - 1] = live[done]
            rank.append(marks)
            node[live], same[:] = new, False
            same[live] = tied
            first = np.arange(last + 1, new[-1] + 1)
            last, depth = int(new[-1]), depth + 1
        self.labels = np.concatenate(labels).tobytes() if labels else b""
        self.start = np.append(np.concatenate(starts), last).astype(np.int32)
        self.rank = np.concatenate(rank)
        self.counts, self.ends, self.text = np.asarray(counts, np.int64), ends, text.tobytes()

    def __len__(self) -> int:
        return len(self.ends)

    @property
    def nbytes(self) -> int:
        return len(self.labels) + len(self.text) + sum(x.nbytes for x in (self.start, self.rank, self.counts, self.ends))

    def word(self, rank: int) -> bytes:
        return self.text[self.ends[rank - 1] if rank else 0 : self.ends[rank]]

    def near(self, words: list[bytes], shared: list[int]) -> Iterator[tuple[int, int, int, int]]:
        """(i, number of near words, largest count of one, the first word of that
        count) for the words of a sorted list that have a near one. shared: the
        letters that each has in common with the one before it."""
        labels, start, rank, counts = self.labels, memoryview(self.start), memoryview(self.rank), memoryview(self.counts)
        find = labels.find
        # states[d]: the exact node after d letters, or -1, and the nodes with one error.
        states: list[tuple[int, set[int]]] = [(0, set())]
        dead = 1 << 62
        for at, common in enumerate(shared):
            if common >= dead:
                continue
            word, dead = words[at], 1 << 62
            del states[common + 1 :]
            for depth in range(len(states) - 1, len(word)):
                letter, (exact, off) = word[depth], states[-1]
                after = set()
                for x in off:
                    if (p := find(letter, start[x], start[x + 1])) >= 0:
                        after.add(p + 1)
                on = -1
                if exact >= 0:
                    after.add(exact)  # the word has a letter too many
                    for child in range(start[exact] + 1, start[exact + 1] + 1):
                        if labels[child - 1] == letter:
                            on = child
                        else:
                            after.add(child)  # it has another letter
                        if (p := find(letter, start[child], start[child + 1])) >= 0:
                            after.add(p + 1)  # it lacks a letter
                if on < 0 and not after:
                    dead = depth + 1
                    break
                states.append((on, after))
            if dead < 1 << 62:
                continue
            exact, ends = states[-1]
            if exact >= 0 and start[exact] < start[exact + 1]:
                ends = ends.union(range(start[exact] + 1, start[exact + 1] + 1))
            n = best = 0
            form = -1
            for x in ends:
                if (r := rank[x]) >= 0:
                    n += 1
                    if (c := counts[r]) > best or c == best and r < form:
                        best, form = c, r
            if n:
                yield at, n, best, form


def shared_letters(words: list[bytes]) -> list[int]:
    """How many first letters each word shares with the one before it."""
    out, before = [], b""
    for word in words:
        common, most = 0, min(len(before), len(word))
        while common < most and before[common] == word[common]:
            common += 1
        out.append(common)
        before = word
    return out


def _tries(shard_words: int):
    """Slices of a task's sorted words as tries."""

    def packed(words: list[str], counts: list[int]) -> pa.RecordBatch:
        trie = Trie([w.encode("latin-1") for w in words], np.array(counts))
        return pa.RecordBatch.from_arrays([pa.array([words[0]]), pa.array([trie.nbytes]), pa.array([pickle.dumps(trie, protocol=5)], pa.binary())], names=["first", "bytes", "trie"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words: list[str] = []
        counts: list[int] = []
        for batch in batches:
            words += batch.column("word").to_pylist()
            counts += batch.column("n").to_pylist()
            while len(words) >= shard_words:
                yield packed(words[:shard_words], counts[:shard_words])
                del words[:shard_words], counts[:shard_words]
        if words:
            yield packed(words, counts)

    return trimmed(run)


def _intersected(tries):
    """(word, n, n_near, form_n, form) of sorted words with the broadcast tries."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = [w.encode("latin-1") for w in batch.column("word").to_pylist()]
            shared = shared_letters(words)
            n, best, form = np.zeros(len(words), np.int64), np.zeros(len(words), np.int64), [None] * len(words)
            for trie in tries.value:
                for at, more, count, rank in trie.near(words, shared):
                    n[at] += more
                    if count > best[at] or count == best[at] and trie.word(rank) < form[at]:
                        best[at], form[at] = count, trie.word(rank)
            forms = pa.array([f if f is None else f.decode("latin-1") for f in form], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column("word"), batch.column("n"), pa.array(n), pa.array(best), forms], names=["word", "n", "n_near", "form_n", "form"])

    return trimmed(run)


def _lowered(run: Column) -> Column:
    """A-Z alone in lower case."""
    big = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.when(F.octet_length(run) == F.length(run), F.lower(run)).otherwise(F.translate(run, big, big.lower()))


def counted_words(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", letters: int = 5, least: int = 3, every: int = 97) -> DataFrame:
    """(word, n): runs of letters of all texts, with misspellings planted.

    Where `every` divides the hash of an id and a run, one letter of the run is
    left out. Words have `letters` code points and `least` occurrences at least.
    Null texts have no runs; runs of a row with a null id stay as they are.
    """
    runs = F.explode(F.regexp_extract_all(F.col(text_col), F.lit(f"[{LETTERS}]{{{letters},}}"), F.lit(0)))  # a shorter run never grows
    rows = docs.select(F.col(id_col).cast("string").alias("id"), runs.alias("run")).select("id", _lowered(F.col("run")).alias("run"))
    h = F.crc32(F.concat("id", F.lit(":"), F.col("run")))
    place = (h % F.length("run")).cast("int")
    cut = F.concat(F.substring(F.col("run"), F.lit(1), place), F.substr(F.col("run"), place + 2))
    words = rows.select(F.when(F.coalesce(h % every == 0, F.lit(False)), cut).otherwise(F.col("run")).alias("word"))
    return words.groupBy("word").agg(F.count("*").alias("n")).filter((F.col("n") >= least) & (F.length("word") >= letters))


def near_words(words: DataFrame, shard_words: int = SHARD_WORDS, task_words: int = TASK_WORDS, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """(word, n, n_near, form_n, form): how many words of the table are one
    inserted, deleted or replaced letter away, and the one with the largest n
    (ties: the first in code-point order), null and 0 where there are none.

    `words` has distinct words of letters up to U+00FF with their counts n. Empty
    tables give no rows; empty words are words.
    """
    spark = words.sparkSession
    words = settle(words.select("word", F.col("n").cast("long").alias("n")))
    dealt = lambda size: words.repartitionByRange(max(1, -(-total // size)), "word").sortWithinPartitions("word")
    total = words.count()
    shards = settle(dealt(shard_words).mapInArrow(_tries(shard_words), "first string, bytes long, trie binary"))
    asked = settle(dealt(task_words))
    rounds, held = [[]], 0
    for r in shards.select("first", "bytes").orderBy("first").collect():  # a row for `shard_words` words
        if held and held + r.bytes > broadcast_bytes:
            rounds.append([])
            held = 0
        rounds[-1].append(r.first)
        held += r.bytes
    out = None
    for some in rounds:
        chosen = shards.filter(F.col("first").between(some[0], some[-1])) if some else shards.limit(0)
        tries = spark.sparkContext.broadcast([pickle.loads(r.trie) for r in chosen.orderBy("first").select("trie").collect()])
        found = asked.mapInArrow(_intersected(tries), "word string, n long, n_near long, form_n long, form string")
        out = found if out is None else out.unionByName(found)
    if len(rounds) > 1:
        first = F.min_by("form", F.struct(-F.col("form_n"), F.col("form").isNull(), "form"))
        out = out.groupBy("word").agg(F.first("n").alias("n"), F.sum("n_near").alias("n_near"), F.max("form_n").alias("form_n"), first.alias("form"))
    return out


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) for the rows (word, form): the last form after following all.

    A form has at least twice its word's occurrences, so chains end; each round
    doubles the forms followed and is written to the shared folder.
    """
    known = settle(forms.select("word", F.col("form").alias("root")))
    while True:
        above = known.select(F.col("word").alias("root"), F.col("root").alias("top"))
        moved = settle(known.join(above, "root", "left").select("word", F.coalesce("top", "root").alias("root"), F.col("top").isNotNull().alias("moved")))
        known = moved.select("word", "root")
        if moved.filter("moved").isEmpty():
            return known


def group_variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", times: int = 2, **sizes: int) -> DataFrame:
    """(word, form, root, n, n_near, form_n) for every word of `counted_words`.

    form: its near word with the largest n where that is at least `times` its own;
    root: the last word after following forms. Other columns are ignored.
    """
    near = near_words(counted_words(docs, id_col, text_col), **sizes)
    good = F.col("form_n") >= times * F.col("n")
    held = settle(near.select("word", "n", "n_near", *(F.when(good, F.col(c)).alias(c) for c in ("form", "form_n"))))
    found = held.join(roots(held.filter("form is not null")), "word", "left")
    return found.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
