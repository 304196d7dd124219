"""Known names in texts: one automaton over all of them, headers before bodies.

Folded words are joined by blanks, so a name with a blank on either side is found
at word bounds only. The names become automata of at most `SHARD_CHARS`
characters each, which are broadcast one after the other; texts are read once for
each. Only the best name of a text leaves a task.
"""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from .settled import settle

#: Lines at the top of a text that are its header.
HEADER_LINES = 25
#: Characters of the names that are broadcast at once.
SHARD_CHARS = 8_000_000
#: Scores of a name in the header and elsewhere.
IN_HEADER, IN_BODY = 3, 1


def folded_words(text: Column) -> Column:
    """The folded words of a text with a blank before and after each."""
    said = F.array_join(F.transform(T.words(F.coalesce(text, F.lit(""))), T.fold), " ")
    return F.concat(F.lit(" "), said, F.lit(" "))


def known_names(docs: DataFrame, names: DataFrame, header_only: bool = False, header_lines: int = HEADER_LINES, shard_chars: int = SHARD_CHARS) -> DataFrame:
    """(doc_id, entry, name, score) of docs (doc_id, text): the best known name.

    names: (entry, name), names and aliases alike. Names in the first lines win
    over those elsewhere, then longer names, then the smaller entry. Names of
    fewer than three folded signs are not looked for; documents without a known
    name, and null texts, give no row; a repeated id is a document for each row.
    """
    needles = names.select("entry", "name", F.trim(folded_words(F.col("name"))).alias("needle")).filter(F.length("needle") >= 3)
    # Of one needle: the longest name, then the smallest entry.
    best = F.struct(-F.length("name"), "entry", "name")
    needles = needles.groupBy("needle").agg(F.min(best).alias("b")).select("needle", F.col("b.entry").alias("entry"), F.col("b.name").alias("name"))
    chars = needles.agg(F.sum(F.length("needle") + F.length("name"))).first()[0] or 0
    shards = -(-chars // shard_chars) or 1
    needles = settle(needles.withColumn("shard", F.pmod(F.xxhash64("needle"), F.lit(shards))))
    kind = dict(names.dtypes)["entry"]
    header = F.array_join(F.slice(F.split("text", "\n"), 1, header_lines), "\n")
    columns = {"header": folded_words(header)} | ({} if header_only else {"body": folded_words(F.col("text"))})
    texts = docs.filter("text IS NOT NULL").select("doc_id", *(c.alias(n) for n, c in columns.items()))
    context, id_kind, out = docs.sparkSession.sparkContext, dict(docs.dtypes)["doc_id"], None
    for shard in range(shards):
        rows = needles.filter(F.col("shard") == shard).select("needle", "entry", "name").collect()  # `shard_chars` characters or little more
        held = context.broadcast([(f" {r.needle} ", r.entry, r.name) for r in rows])

        def run(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            automaton = ahocorasick.Automaton()
            for needle, entry, name in held.value:
                automaton.add_word(needle, (-len(name), entry, name))
            automaton.make_automaton()
            for batch in batches:
                found = []
                for i, *parts in zip(*(c.to_pylist() for c in batch.columns)):
                    for score, part in zip((IN_HEADER, IN_BODY), parts):
                        if len(automaton) and (best := min((x for _, x in automaton.iter(part)), default=None)):
                            found.append((i, best[1], best[2], score))
                            break
                columns = list(zip(*found)) or [()] * 4
                yield pa.RecordBatch.from_arrays([pa.array(columns[0], batch.schema.field(0).type), pa.array(columns[1], entry_type), pa.array(columns[2], pa.string()), pa.array(columns[3], pa.int32())], names=["doc_id", "entry", "name", "score"])

        entry_type = {"bigint": pa.int64(), "int": pa.int32()}.get(kind, pa.string())
        if shards > 1:  # rows of one id are told apart
            texts = texts if "row" in texts.columns else settle(texts.withColumn("row", F.monotonically_increasing_id()))
            keyed = texts.select(F.struct("doc_id", "row").alias("doc_id"), *columns)
            part = keyed.mapInArrow(run, f"doc_id struct<doc_id:{id_kind},row:bigint>, entry {kind}, name string, score int")
        else:
            part = texts.mapInArrow(run, f"doc_id {id_kind}, entry {kind}, name string, score int")
        out = part if out is None else out.unionByName(part)
    if shards == 1:
        return out
    first = F.min(F.struct(-F.col("score"), -F.length("name"), "entry", "name", "score").alias("x")).alias("b")
    return out.groupBy("doc_id").agg(first).select("doc_id.doc_id", "b.entry", "b.name", "b.score")
