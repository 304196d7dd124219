"""Known names and close labels against nested loops."""

import random

import pytest
from pyspark.sql import functions as F

from lakefolio.operators import closeness, matching, senders
from lakefolio.plans import registry

DATA = "/root/testdata/sf0.001"


def all_pairs(left, right, least):
    return {(a, b) for a in left for b in right if a and b and closeness.ratio(a, b) >= least}


@pytest.mark.parametrize("least", [95, 90, 88, 75, 50])
def test_close_labels_of_all_lengths(spark, least):
    rng = random.Random(least)
    letters = "abcde" if least > 60 else "abcdefghij"
    left = {"".join(rng.choice(letters) for _ in range(rng.randint(0, 14))) for _ in range(150)}
    right = set()
    for a in left:
        b = list(a)
        for _ in range(rng.randint(0, 4)):
            at = rng.randint(0, len(b))
            if rng.random() < 0.5:
                b.insert(at, rng.choice(letters))
            elif b:
                b.pop(min(at, len(b) - 1))
        right.add("".join(b))
    frame = lambda some: spark.createDataFrame([(x,) for x in some] + [(None,)], "label string")
    got = closeness.close(frame(left), frame(right), least).collect()
    assert len(got) == len({(r.label, r.other) for r in got})
    assert {(r.label, r.other) for r in got} == all_pairs(left, right, least)


def test_close_labels_of_two_large_tables(spark):
    rng, parts = random.Random(4), ["steuer", "bescheid", "rechnung", "miete", "strom", "gas", "wasser", "versicher", "ung", "amt", "kasse", "vertrag", "2019", "haus"]
    spelled = lambda: "".join(rng.sample(parts, 3))
    left, right = {spelled() for _ in range(1500)}, {spelled()[:-1] + rng.choice("aex") for _ in range(1500)}
    frame = lambda some: spark.createDataFrame([(x,) for x in some], "label string")
    got = {(r.label, r.other) for r in closeness.close(frame(left), frame(right), 90).collect()}
    sizes = {a: len(a) for a in left | right}
    want = {(a, b) for a in left for b in right if 2 * min(sizes[a], sizes[b]) >= 0.9 * (sizes[a] + sizes[b]) and closeness.ratio(a, b) >= 90}
    assert got == want and len(want) > 500


def test_a_dictionary_of_any_size(spark):
    rows = spark.range(20_001).select(F.format_string("entry %06d", "id").alias("entry")).withColumns({"name": F.col("entry"), "how": F.lit("name")})
    names = spark.createDataFrame([("Entry 000007",), ("ENTRY-000008",), ("entrry 000009",), ("nothing",), (None,)], "n string")
    got = {r.n: (r.match, r.how) for r in matching.lookup(names, "n", rows, least=95).collect()}
    assert got == {"Entry 000007": ("entry 000007", "name"), "ENTRY-000008": ("entry 000008", "folded"), "entrry 000009": ("entry 000009", "near"), "nothing": (None, None), None: (None, None)}


def test_query_of_close_labels(spark):
    from lakefolio.functions import text as T
    from lakefolio.sources.tables import scan

    label = T.label(F.regexp_extract("text", r"^\s*(\S+\s+\S+\s+\S+)", 1))
    labels = {r[0] for r in scan(spark, DATA, "documents").select(label).collect()}
    got = {(r.label, r.other) for r in registry.QUERIES["close_labels"](spark, DATA).collect()}
    assert got == {(a, b) for a, b in all_pairs(labels, labels, 88) if a < b}


def test_known_names_in_one_shard_and_many(spark):
    rows = [(1, "Stadtwerke Köln GmbH\nRechnung"), (2, "x\n" * 30 + "die STADTWERKE KOELN schreiben"), (3, "Stadtwerke Kölner"), (4, None), (5, ""), (6, "Amt\nStadtwerke Köln und Allianz"), (6, "Allianz"), (7, "ab")]
    docs = spark.createDataFrame([(i, t, "n") for i, t in rows], "doc_id long, text string, name string")
    names = spark.createDataFrame([(1, "Stadtwerke Köln"), (1, "Stadtwerke Köln GmbH"), (2, "stadtwerke koeln"), (3, "Allianz"), (4, "ab"), (5, None)], "entry long, name string")
    want = [(1, 1, "Stadtwerke Köln GmbH", 3), (2, 2, "stadtwerke koeln", 1), (6, 2, "stadtwerke koeln", 3), (6, 3, "Allianz", 3)]
    for chars in (8_000_000, 20, 1):
        assert sorted(tuple(r) for r in senders.known_names(docs, names, shard_chars=chars).collect()) == want
    header = senders.known_names(docs, names, header_only=True).collect()
    assert sorted(r.doc_id for r in header) == [1, 6, 6]
    assert senders.known_names(docs, names.limit(0)).count() == 0 and senders.known_names(docs.limit(0), names).count() == 0


def test_known_names_are_a_nested_loop(spark):
    """1,500 names on all documents."""
    from lakefolio.sources.tables import scan

    docs = scan(spark, DATA, "documents").select("doc_id", "text")
    words = docs.select(F.explode(F.regexp_extract_all("text", F.lit(r"\w+ \w+"), F.lit(0))).alias("name")).groupBy("name").agg(F.count("*").alias("n"))
    names = words.orderBy(F.desc("n"), "name").limit(1500).select(F.xxhash64("name").alias("entry"), "name").collect()
    table = spark.createDataFrame(names)
    folded = {r.name: r.f.strip() for r in table.select("name", senders.folded_words(F.col("name")).alias("f")).collect()}
    head = F.array_join(F.slice(F.split("text", "\n"), 1, 25), "\n")
    want = {}
    for r in docs.select("doc_id", senders.folded_words(head).alias("h"), senders.folded_words(F.col("text")).alias("b")).collect():
        hits = [(-(3 if f" {folded[n.name]} " in r.h else 1), -len(n.name), n.entry, n.name) for n in names if len(folded[n.name]) >= 3 and f" {folded[n.name]} " in r.b]
        if hits:
            score, _, entry, name = min(hits)
            want[r.doc_id] = (entry, name, -score)
    got = {r.doc_id: (r.entry, r.name, r.score) for r in senders.known_names(docs, table).collect()}
    # Names with one folded spelling are one needle: the longest, then the smallest entry.
    assert got == want and len(want) > 100
