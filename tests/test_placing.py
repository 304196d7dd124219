"""Placing groups in folders against a loop over the tree, with near names and nulls."""

import random

from lakefolio.operators import placing, skew
from lakefolio.operators.closeness import ratio

FOLDERS = [(1, None, "Arbeit"), (2, None, "Wohnung 2024"), (3, 1, "Verträge"), (4, 1, "Lohn"), (5, 2, "Strom Gas"), (6, 3, "alt"), (7, None, None), (8, 4, "Lohn")]
FOLDER_SCHEMA = "folder_id long, parent_id long, name string"
DOC_SCHEMA = "doc long, folder_id long, series long, sender string, kind string, words array<string>, clues array<string>, group string"


def plain(groups, filed, base):
    parent = {f: p for f, p, _ in FOLDERS}
    inside = {f: [] for f in parent}
    for d in filed:
        f = d[1]
        while f in parent:
            inside[f].append(d)
            f = parent[f]
    names = {f: {w for w in (n or "").lower().split() if w.isalpha() and len(w) >= 3} for f, _, n in FOLDERS}
    near = lambda a, b: a == b or (min(len(a), len(b)) >= 4 and ratio(a, b) >= 85)

    def points(docs, f):
        there, n, total = inside[f], len(docs), 0.0
        for i, weight in ((2, 3.0), (3, 1.5), (4, 0.5)):
            known = {d[i] for d in there} - {None}
            total += weight * sum(d[i] in known for d in docs) / n
        words = lambda some: [w for d in some for w in set(d[5] or []) - {None}]
        own = {w for w in words(docs) if 2 * words(docs).count(w) >= n}
        usual = {w for w in words(there) if words(there).count(w) >= 0.3 * len(there)}
        total += 2 * len(own & usual) / len(own) if own else 0
        clues = own | (set(min(docs)[6] or []) - {None})
        return round(total + 2 * any(near(a, b) for a in clues for b in names[f]), 9)

    out = {}
    for g in {d[7] for d in groups} - {None}:
        docs = [d for d in groups if d[7] == g]
        at, score, level = base.get(g), None, 0
        while True:
            best = min(((-points(docs, f), f) for f, p in parent.items() if p == at), default=(0, None))
            if -best[0] < 2:
                break
            at, score, level = best[1], -best[0], level + 1
        out[g] = (at, score, level)
    return out


def test_against_a_loop(spark):
    rng = random.Random(8)
    words = ["vertrag", "verträge", "lohn", "strom", "gas", "miete", "wohnung", "arbeit", "alt", None]

    def doc(n, group=None):
        return (n, rng.choice([1, 2, 3, 4, 5, 6, None, 99]), rng.choice([None, None, 1, 2, 3]), rng.choice(["a", "b", "c", None]), rng.choice(["k", "l", None]), rng.choice([None, rng.choices(words, k=3)]), rng.choice([None, ["vertraege"], ["lohnn", None]]), group)

    filed = [doc(n) for n in range(12)]
    groups = [doc(100 + n, rng.choice([*"abcdefghijkl", None])) for n in range(30)]
    base = {"a": 1, "b": 3}
    frames = (spark.createDataFrame(groups, DOC_SCHEMA), spark.createDataFrame(FOLDERS, FOLDER_SCHEMA), spark.createDataFrame(filed, DOC_SCHEMA))
    found = placing.placed(*frames, spark.createDataFrame(list(base.items()), "group string, folder_id long"))
    want = plain(groups, filed, base)
    assert {r["group"]: (r["folder_id"], r["points"], r["levels"]) for r in found.collect()} == want
    assert len({level for _, _, level in want.values()}) >= 3


def test_no_folders_and_no_groups(spark):
    none, docs = spark.createDataFrame([], DOC_SCHEMA), spark.createDataFrame([(1, None, None, None, None, None, None, "g")], DOC_SCHEMA)
    assert [tuple(r) for r in placing.placed(docs, spark.createDataFrame([], FOLDER_SCHEMA), none).collect()] == [("g", None, None, 0)]
    assert placing.placed(none, spark.createDataFrame(FOLDERS, FOLDER_SCHEMA), docs).collect() == []


def test_a_hot_key_is_dealt(spark):
    rows = spark.range(5000).selectExpr("id", "IF(id % 3 = 0, id, -1) AS k")
    table = spark.createDataFrame([(-1, "x"), (-1, "y"), (3, "z")], "k long, v string")
    found = skew.dealt(rows, table, ["k"])
    assert sorted(found.columns) == ["id", "k", "v"]
    assert {r["v"]: r["n"] for r in found.groupBy("v").count().withColumnRenamed("count", "n").collect()} == {"x": 3333, "y": 3333, "z": 1}


def test_what_nobody_asks_for_goes_no_deeper(spark, monkeypatch):
    """What every folder is known by was made for all levels at once, asked for or not."""
    folders = spark.createDataFrame([(i, i // 2 if i > 1 else None, f"F{i}") for i in range(1, 64)], FOLDER_SCHEMA)
    filed = spark.createDataFrame([(i, i, i, f"s{i}", "k", None, None, None) for i in range(32, 64)], DOC_SCHEMA)
    groups = spark.createDataFrame([(1, None, 40, None, None, None, None, "g")], DOC_SCHEMA)
    kept, whole = [], placing.stored
    monkeypatch.setattr(placing, "stored", lambda df: (out := whole(df), kept.append((out.columns, out.count())))[0])
    assert [tuple(r) for r in placing.placed(groups, folders, filed).collect()] == [("g", 40, 3.0, 6)]
    assert [n for columns, n in kept if "inside" in columns] == [1] * 6 + [0]
