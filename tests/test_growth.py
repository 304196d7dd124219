"""What work grows with: things that were once worked out again for every part."""

import math
import random
import time

from pyspark.sql import functions as F

from lakefolio.functions import dates, snippets
from lakefolio.operators import bayes, closeness, desk, layout, ledger, placing, postings, review, search, skew
from lakefolio.plans import ledger as ledger_plans


def test_a_letter_of_many_dates(spark):
    """The text was matched and cut again for every date in it, and once more for every month."""
    text = "1. Mai 2001, Mai 2002\n" * 300
    rows = spark.createDataFrame([(text,)], "text string")
    start = time.monotonic()
    found = rows.select(dates.dates(F.col("text"), F.lit("2002-01-01").cast("date")).alias("d")).first().d
    assert [(d["at"], d["whole"]) for d in found] == [(22 * i + at, whole) for i in range(300) for at, whole in ((0, True), (13, False))]
    assert time.monotonic() - start < 20


def test_a_level_meets_its_own_folders(spark, monkeypatch):
    """Every level met what is known of all folders, however deep they lie."""
    folders = spark.createDataFrame([(i, i // 2 if i > 1 else None, f"F{i}") for i in range(1, 64)], "folder_id long, parent_id long, name string")
    docs = spark.createDataFrame([(i, i, i, "a", "k", ["w"], None, f"g{i}") for i in range(32, 64)], "doc long, folder_id long, series long, sender string, kind string, words array<string>, clues array<string>, group string")
    met, whole = [], placing.dealt
    monkeypatch.setattr(placing, "dealt", lambda rows, table, keys: (met.append(table.count()), whole(rows, table, keys))[1])
    found = placing.placed(docs, folders, docs)
    assert {(r["group"], r["folder_id"], r["levels"]) for r in found.collect()} == {(f"g{i}", i, 6) for i in range(32, 64)}
    known = placing.profiles(folders, docs).filter("what <> 'kind'").count()
    assert sum(met[1:]) == known  # the first is of spellings


def test_many_sheets_are_one_batch(spark):
    """Every sheet was a data frame of its own, some 10 ms of work each."""
    rows = spark.range(120_000).selectExpr("CAST(id DIV 3 AS INT) AS page", "CONCAT('w', id) AS text", "id % 3 * 20.0 AS x0", "id % 3 * 20.0 + 9 AS x1", "0.0 AS y0", "9.0 AS y1", "0.35 AS confidence").repartition(4)
    layout.lines_of_cells(rows.limit(10), ["page"]).count()
    start = time.monotonic()
    found = {r.page: r.text for r in layout.lines_of_cells(rows, ["page"]).collect()}
    assert found == {p: f"w{3 * p} w{3 * p + 1} w{3 * p + 2}" for p in range(40_000)}
    assert time.monotonic() - start < 15


def test_a_sheet_over_several_batches(spark):
    size = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    rows = [(page, f"w{i:02}", i * 100.0, 0.0, i * 100.0 + 95, 9.0, None) for page in (2**60 + 1, 2**60 + 2, None) for i in range(25)]
    df = spark.createDataFrame(rows, "page long, text string, x0 double, y0 double, x1 double, y1 double, confidence double").repartition(3)
    found = {r.page: r.text for r in layout.lines_of_cells(df, ["page"]).collect()}
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
    assert found == dict.fromkeys((2**60 + 1, 2**60 + 2, None), " ".join(f"w{i:02}" for i in range(25)))


def test_a_posting_is_stored_once(spark, tmp_path):
    """It was stored for each beginning and tail of its word."""
    docs = spark.range(50).selectExpr("id AS doc_id", "'Lizenzvereinbarung' AS title", "'Lizenzvereinbarung und Lizenzvertrag' AS content", "CAST(NULL AS STRING) AS meta")
    postings.write(docs, str(tmp_path), b"k")
    assert spark.read.parquet(f"{tmp_path}/postings").count() == 50 * 4
    for query, n in (("lizenzver", 50), ("vertrag", 50), ("barung", 50), ("mietvertrag", 0)):
        assert postings.search(spark, str(tmp_path), query, b"k").count() == n


def test_terms_are_made_once_a_distinct_word(spark, tmp_path, monkeypatch):
    """They were made for every word of every document, of which only those with terms were to be kept."""
    docs = spark.range(40).selectExpr("id AS doc_id", "'Häuser und Häuser' AS title", "CONCAT('häuser 2024 w', id) AS content", "'' AS meta")
    plans, whole = [], postings._write_terms
    monkeypatch.setattr(postings, "_write_terms", lambda terms, folder: (plans.append(terms._jdf.queryExecution().optimizedPlan().toString()), whole(terms, folder))[1])
    postings.write(docs, str(tmp_path), b"k")
    below = plans[0][plans[0].index("MapInArrow") :]
    assert "Aggregate" in below and "sha2" not in plans[0] and "stems" not in below
    rows = [tuple(r) for r in spark.read.parquet(f"{tmp_path}/terms").select("asked", "term").collect()]
    assert len(rows) == len(set(rows)) and (postings.hash_of("P", "hae", b"k"), postings.hash_of("V", "häuser", b"k")) in rows
    assert postings._hasher(b"x" * 70)("W", "ä") == postings.hash_of("W", "ä", b"x" * 70)


def test_terms_of_many_words_are_joined(spark, tmp_path, monkeypatch):
    """Words of a query's terms are not collected beyond a bound."""
    docs = spark.range(40).selectExpr("id AS doc_id", "CAST(NULL AS STRING) AS title", "CONCAT('lizenz', id, ' lizenz') AS content", "'' AS meta")
    postings.write(docs, str(tmp_path), b"k")
    want = postings.search(spark, str(tmp_path), "lizenz", b"k").collect()
    monkeypatch.setattr(postings, "NAMED", 5)
    assert len(want) == 40 and postings.search(spark, str(tmp_path), "lizenz", b"k").collect() == want


def test_an_alias_of_many_senders(spark):
    """Every reader of a spelling met every owner of it: here 900 million pairs."""
    senders = spark.range(30_000).selectExpr("id AS sender", "CONCAT('n', id) AS name", "ARRAY('Same') AS aliases")
    read = spark.range(30_000).selectExpr("id AS sender", "EXPLODE(ARRAY('SAME', CONCAT('own ', id), CONCAT('N', id))) AS spelling")
    start = time.monotonic()
    found = {r.sender: r.aliases for r in desk.learned_aliases(senders, read).collect()}
    assert time.monotonic() - start < 60
    assert found == {i: sorted(["Same", f"own {i}", f"N{i}"]) for i in range(30_000)}


def test_texts_are_dealt_once(spark):
    """Words and terms of a document, which are larger than its text, were shuffled two times over."""
    docs = spark.createDataFrame([(1, "Lizenz Lizenzvertrag"), (2, None)], "doc_id long, text string")
    for found in (search.word_terms(docs), search.signature(docs)):
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange hashpartitioning(doc_id") == 1 and plan.count("Exchange hashpartitioning") == 1
    assert {(r.kind, r.term, r.tf) for r in search.word_terms(docs).filter("kind = 'W'").collect()} == {("W", "lizenz", 1), ("W", "lizenzvertrag", 1)}


def test_terms_are_counted_where_documents_lie(spark, monkeypatch):
    """Every term of every document was a row, to be counted in its document first."""
    rows = [(1, "Fuß fuss Lizenz Lizenzvertrag 12345678 the"), (2, None), (3, "Mietvertrag " * 3 + "Lizenz"), (4, ""), (None, "Lizenzen"), (5, "lizenz x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    twice = docs.unionByName(spark.createDataFrame([(1, "Lizenz"), (None, "vertrag")], "doc_id long, text string"))
    for some in (docs, twice):
        want = {(r.kind, r.term, r.df, r.cf) for r in search.word_terms(some).groupBy("kind", "term").agg(F.count("*").alias("df"), F.sum("tf").alias("cf")).collect()}
        for most in (3, 500_000):
            monkeypatch.setattr(search, "TERMS", most)
            monkeypatch.setattr(search, "SLICE", 2)
            got = [tuple(r) for r in search.term_frequencies(some).collect()]
            assert len(got) == len(want) and set(got) == want
    plan = search.term_frequencies(docs)._jdf.queryExecution().executedPlan().toString()
    assert plan.index("Exchange hashpartitioning(kind") < plan.index("MapInArrow") and "Generate" not in plan


def test_labels_of_common_letters(spark):
    """Labels met by their rarest pairs of letters, of which there are few kinds: here some 170 million pairs."""
    rng = random.Random(7)
    spelled = ["".join(rng.choice("abcdefghijkl") for _ in range(12)) for _ in range(30_000)]
    planted = [a[:5] + "xy" + a[6:] for a in spelled[:50]] + [a[1:] for a in spelled[50:100]]
    labels = spark.createDataFrame([(a,) for a in spelled + planted], "label string").repartition(4)
    start = time.monotonic()
    found = {(r.label, r.other) for r in closeness.close(labels, labels, 88).collect()}
    assert time.monotonic() - start < 60
    assert {(b, a) for a, b in found} == found and all(closeness.ratio(a, b) >= 88 for a, b in found)
    assert set(zip(spelled[:100], planted)) <= found and {(a, a) for a in spelled + planted} <= found


def test_a_sketch_is_made_once(spark):
    """Words and sketches of a document were worked out for both pairs it is in."""
    from lakefolio.plans import registry

    plan = registry.QUERIES["sketch_similarity"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "regexp_extract_all" not in plan and plan.count("Scan ExistingRDD") == 2


def test_a_text_is_folded_once(spark):
    """It was folded for every needle, and all of that again for the filter."""
    docs = spark.createDataFrame([("ä" * 5 + "Lizenz",), ("nichts",), (None,)], "text string")
    found = snippets.hits(docs, "text", [["lizenz"], ["xx", "yy"], ["zenz"]], "hit")
    assert [r.hit for r in found.collect()] == [6]
    assert found._jdf.queryExecution().optimizedPlan().toString().count("lower(") == 3  # one of them the text, two the part up to the hit


def test_words_of_labelled_documents_only(spark, monkeypatch):
    """Words of all documents were shuffled to meet the labels, in place of texts."""
    docs = spark.createDataFrame([(1, "a1 b1"), (2, "a1 a1"), (3, "c1")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, "x"), (2, "x")], "doc_id long, label string")
    plans, whole = [], bayes.settle
    monkeypatch.setattr(bayes, "settle", lambda df: (plans.append(df._jdf.queryExecution().optimizedPlan().toString()), whole(df))[1])
    assert {tuple(r) for r in bayes.fit(docs, labels)[0].collect()} == {("x", "a1", 2), ("x", "b1", 1)}
    assert plans[0].index("Generate") < plans[0].index("Join")


def test_signatures_where_documents_lie(spark):
    """Words are not shuffled to be stemmed; rows of one id are one document."""
    rows = spark.createDataFrame([(1, "Licenses licensed, licenses"), (2, None), (3, "häuser " * 3 + "10 a")], "doc_id long, content string")
    got = postings.signatures(rows)
    assert "Exchange" not in got._jdf.queryExecution().executedPlan().toString()
    of = {i: [(r.place, r.stem, r.tf) for r in sorted(got.collect()) if r.doc_id == i] for i in (1, 2, 3)}
    assert of[1][0][2] == 3 and of[2] == [] and of[3][-1] == (len(of[3]), "10", 1)
    twice = rows.unionByName(spark.createDataFrame([(1, "licensed"), (None, "word")], "doc_id long, content string"))
    more = postings.signatures(twice, top=1).collect()
    assert sorted((r.doc_id or 0, r.tf) for r in more) == [(0, 1), (1, 4), (3, 3)]


def test_spellings_where_documents_lie(spark):
    """Words are not shuffled to be counted; rows of one id are one document."""
    rows = spark.createDataFrame([(1, "für fur für Über"), (2, "uber fur"), (3, None), (None, "für"), (4, "é e é e")], "doc_id long, text string")
    got = ledger.accented_spellings(rows)
    assert "Exchange" not in got._jdf.queryExecution().executedPlan().toString()
    assert {r.doc_id: (r.plain, r.spelled) for r in got.collect()} == {1: (["fur", "uber"], ["für", "über"])}
    more = ledger.accented_spellings(rows.unionByName(spark.createDataFrame([(2, "über für für"), (2, "über")], "doc_id long, text string"))).collect()
    assert sorted((r.doc_id, r.text) for r in more) == [(1, "für fur für Über"), (2, "uber fur"), (2, "über"), (2, "über für für")]
    assert all(r.spelled == ["für", "über"] for r in more)


def test_overlap_of_whole_sets(spark):
    """Pairs meet arrays: a word is not moved for every pair, and none is lost."""
    sets = {1: ["a", "b", "c"], 2: ["b", "c", "d"], 3: [], 4: None, 5: ["e"]}
    rows = spark.createDataFrame(list(sets.items()), "item long, words array<string>")
    pairs = [(1, 2), (2, 3), (3, 4), (1, 5), (2, 1)]
    got = {(r.a, r.b): r.overlap for r in review.overlap_by_rarity(rows, spark.createDataFrame(pairs, "a long, b long"), "item").collect()}
    df = {w: sum(w in (s or []) for s in sets.values()) for w in "abcde"}
    weight = lambda words: sum(math.log1p(3 / (1 + df[w])) for w in words)
    for a, b in pairs:
        either = set(sets[a] or []) | set(sets[b] or [])
        assert abs(got[a, b] - (weight(set(sets[a] or []) & set(sets[b] or [])) / weight(either) if either else 0)) < 1e-12
    assert len(got) == len(pairs)


def test_parts_by_rows(spark, monkeypatch):
    """Twelve tasks held all lines, however many there were."""
    monkeypatch.setattr(skew, "PART_ROWS", 100)
    assert skew.parts_of(10_000) == 100
    lines = spark.range(5000).select((F.col("id") % 7).alias("folder_id"), (F.col("id") % 50).cast("string").alias("tag"))
    folders = spark.range(7).select(F.col("id").alias("folder_id"), F.when(F.col("id") > 0, F.lit(0)).cast("long").alias("parent_id"))
    got = review.profile(folders, lines, "tag")
    assert "REPARTITION_BY_NUM, [plan_id" in (plan := got._jdf.queryExecution().executedPlan().toString()) and ", 200), REPARTITION_BY_NUM" in plan and ", 50), REPARTITION_BY_NUM" in plan
    assert {(r.tag, r.n) for r in got.collect() if r.folder_id == 0} == {("0", 100), ("1", 100), ("10", 100)}
    own = lines.withColumnRenamed("folder_id", "doc_id").distinct()
    ranked = ledger.ranked_tags(lines.groupBy("tag").agg(F.count("*").alias("n")), own, most=60)
    assert "REPARTITION_BY_NUM" in ranked._jdf.queryExecution().executedPlan().toString()
    assert ranked.count() == 7 * 50 and {r.tag for r in ranked.filter("place = 1").collect()} == {"0"}
    alterations = ledger_plans._alterations(spark, "/root/testdata/sf0.001")
    assert "REPARTITION_BY_NUM" in alterations._jdf.queryExecution().executedPlan().toString()
