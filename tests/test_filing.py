"""Folders to be made, walked to, folded back, wished and moved to."""

from pyspark.sql import functions as F

from lakefolio.operators import filing

FOLDERS = [(1, None, "Work"), (2, 1, "Pay"), (3, 2, "Old"), (4, None, "Home"), (5, 4, "work"), (6, 1, "pay"), (7, 3, "Tax"), (8, 4, None)]
SCHEMA = "folder_id long, parent_id long, name string"
TARGETS = "id long, anchor long, names array<string>, rank int"


def tuples(df, *columns):
    return {tuple(r) for r in df.select(*columns).collect()}


def targets(spark, rows):
    return spark.createDataFrame([(*r, 1) for r in rows], TARGETS)


def test_walked(spark):
    folders = spark.createDataFrame(FOLDERS, SCHEMA)
    rows = [(1, None, ["WORK", " pay ", "2024"]), (2, 4, ["Work"]), (3, None, ["New", "Pay"]), (4, 2, []), (5, 2, None), (6, None, ["", "home", None]), (7, None, [str(n) for n in range(12)]), (None, 1, ["x"])]
    found = {i: (a, tuple(n)) for i, a, n in ((r["id"], r["anchor"], r["names"]) for r in filing.walked(targets(spark, rows), folders).collect())}
    assert found == {1: (2, ("2024",)), 2: (5, ()), 3: (None, ("New", "Pay")), 4: (2, ()), 5: (2, ()), 6: (4, ()), 7: (None, tuple(str(n) for n in range(10)))}


def test_overlay_and_back(spark):
    folders = spark.createDataFrame(FOLDERS, SCHEMA)
    rows = [(1, None, ["New", "a", "b"]), (2, None, ["new", "A"]), (3, 1, ["x"]), (4, 1, ["Pay"]), (5, None, []), (6, 1, ["X", "y"])]
    overlay, places = filing.overlaid(targets(spark, rows), folders)
    made = tuples(overlay.filter("folder_id < 0"), "folder_id", "parent_id", "name")
    assert made == {(-1, None, "New"), (-2, 1, "X"), (-3, -1, "a"), (-4, -2, "y"), (-5, -3, "b")}
    at = dict(tuples(places, "id", "folder_id"))
    assert at == {1: -5, 2: -3, 3: -2, 4: 2, 5: None, 6: -4}
    back = {r["id"]: (r["anchor"], r["names"]) for r in filing.real(places, overlay).collect()}
    assert back == {1: (None, ["New", "a", "b"]), 2: (None, ["New", "a"]), 3: (1, ["X"]), 4: (2, []), 5: (None, []), 6: (1, ["X", "y"])}
    # proposed folders are walked into like real ones
    again = filing.walked(targets(spark, [(1, 1, ["x", "Y", "z"])]), overlay.select("folder_id", "parent_id", "name"))
    assert [tuple(r) for r in again.collect()] == [(1, -4, ["z"])]


def test_shallowest_and_moves(spark):
    folders = spark.createDataFrame(FOLDERS, SCHEMA)
    wishes = spark.createDataFrame([(None, "pay"), (1, "PAY"), (4, "pay"), (None, "work"), (4, "work"), (2, "Tax"), (None, "tax")], "base long, name string")
    found = filing.shallowest(wishes, folders)
    assert tuples(found, "base", "name", "folder_id") == {(None, "pay", 2), (1, "PAY", 2), (4, "pay", None), (None, "work", 1), (4, "work", 5), (2, "Tax", 7), (None, "tax", 7)}
    docs = spark.createDataFrame([(1, 1), (2, 4), (3, None), (4, 3), (5, 2), (6, 99)], "id long, folder_id long")
    places = spark.createDataFrame([(1, 7), (2, 7), (3, 7), (4, 1), (5, 2), (6, 1), (7, 1)], "id long, folder_id long")
    assert tuples(filing.downwards(docs, places, folders), "id", "old", "new") == {(1, 1, 7), (3, None, 7)}


def test_wished(spark):
    folders = spark.createDataFrame(FOLDERS, SCHEMA)
    docs = spark.createDataFrame([(1, None, "pay slip"), (2, 4, "pay slip"), (3, 2, "tax"), (4, 1, "other"), (5, 1, None), (None, 1, "pay")], "id long, folder_id long, title string")
    title = F.col("title")
    found = filing.wished(docs, [(title.contains("pay"), "Pay"), (title.contains("slip") | title.contains("tax"), "Tax")], folders)
    assert {(r["id"], r["rule"], r["anchor"], tuple(r["names"])) for r in found.collect()} == {(1, 0, 2, ()), (2, 0, 4, ("Pay",)), (3, 1, 7, ())}


def test_numbers_over_many_partitions(spark):
    rows = spark.range(0, 10_000, 1, 7).selectExpr("pmod(id * 7919, 10000) AS k")
    found = filing.numbered(rows, ["k"], "n")
    assert found.filter("n <> k + 1").isEmpty() and found.count() == 10_000


def test_empty(spark):
    none, folders = targets(spark, []), spark.createDataFrame([], SCHEMA)
    overlay, places = filing.overlaid(none, folders)
    assert overlay.collect() == [] and places.collect() == [] and filing.real(places, overlay).collect() == []
