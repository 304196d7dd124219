"""Groups of documents put into a tree of folders, level by level.

A folder is described by the documents in it and below it. A group fits it by the
share of its documents whose series (3), sender (1.5) and kind (0.5) the folder
knows, by the share of the group's words that are usual there (2), and if one of
its words is in the folder's name or nearly so (2). Every group goes down from its
base into the subfolder that fits best as long as that has 2 points, and no tree
is in the driver. What is known of the folders that groups can go into is worked
out level by level, from what is known of the folders below them: of that only
goes on what a group asks for there, so there is less on every level, and never
more than a level of it on disk.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import closeness, tree
from .settled import drop, settle, stored
from .skew import dealt

#: Points of a group all of whose documents, words or name match.
POINTS = {"series": 3.0, "sender": 1.5, "kind": 0.5, "word": 2.0, "name": 2.0}
#: Points from which a group belongs in a folder.
FITS = 2.0
#: Share of a folder's documents that have a word usual there.
USUAL = 0.3
#: Letters and ratio from which two words that differ mean the same.
LETTERS, RATIO = 4, 85


def _parent(parent: Column) -> Column:
    """Null parents as a value of their own, so that the top level is joined like any other."""
    return F.when(parent.isNull(), "top").otherwise(F.concat(F.lit("in "), parent.cast("string")))


def _spot(folder: Column) -> Column:
    """The place from which the folders right below `folder`, null for the top, are looked at."""
    return F.xxhash64(_parent(folder)).alias("spot")


def _facts(docs: DataFrame, of: list[str]) -> DataFrame:
    """(of, what, value, n): documents by series, sender, kind and word, nulls left out."""
    plain = [F.struct(F.lit(c).alias("what"), F.col(c).cast("string").alias("value")) for c in ("series", "sender", "kind")]
    words = F.transform(F.array_distinct(F.coalesce("words", F.array().cast("array<string>"))), lambda w: F.struct(F.lit("word").alias("what"), w.alias("value")))
    rows = docs.select(*of, F.explode(F.concat(F.array(*plain), words)).alias("f")).filter("f.value IS NOT NULL")
    return rows.groupBy(*of, "f.what", "f.value").agg(F.count("*").alias("n"))


def _totals(filed: DataFrame, up: DataFrame) -> DataFrame:
    """(folder_id, total): documents in folders or below them."""
    own = filed.groupBy("folder_id").agg(F.count("*").alias("n"))
    return own.join(up, "folder_id").groupBy(F.col("ancestor_id").alias("folder_id")).agg(F.sum("n").alias("total"))


def _names(folders: DataFrame) -> DataFrame:
    return folders.select("folder_id", F.lit("name").alias("what"), F.explode(F.array_distinct(name_words(F.col("name")))).alias("value"))


def profiles(folders: DataFrame, filed: DataFrame) -> DataFrame:
    """(parent, depth, folder_id, what, value): what a folder of (folder_id, parent_id,
    name) is known by, from the documents (folder_id, series, sender, kind, words)
    in it or below it; words only if three tenths of those have them, and the
    words of its name. `placed` works out the part of this that it needs."""
    up = tree.closure(folders.select("folder_id", "parent_id"))
    totals = _totals(filed, up)
    known = _facts(filed, ["folder_id"]).join(up, "folder_id").groupBy(F.col("ancestor_id").alias("folder_id"), "what", "value").agg(F.sum("n").alias("n"))
    known = known.join(totals, "folder_id").filter((F.col("what") != "word") | (F.col("n") >= USUAL * F.col("total"))).select("folder_id", "what", "value")
    depths = up.groupBy("folder_id").agg(F.max("distance").alias("depth"))
    parents = folders.select("folder_id", _parent(F.col("parent_id")).alias("parent")).join(depths, "folder_id")
    return known.unionByName(_names(folders)).join(parents, "folder_id").select("parent", "depth", "folder_id", "what", "value")


def name_words(name: Column) -> Column:
    """Words of letters alone, three at least, in lower case."""
    return F.filter(F.split(F.lower(name), r"[^\p{L}\p{N}]+"), lambda w: w.rlike(r"^\p{L}{3,}$"))


def asked(groups: DataFrame) -> DataFrame:
    """(group, what, value, points): what groups of (group, doc, series, sender,
    kind, words, clues) are matched by. A group's words are those of half of its
    documents, and they and the clues of its first document may match a name."""
    sizes = groups.groupBy("group").agg(F.count("*").alias("size"), F.min_by("clues", F.struct("doc", "clues")).alias("clues"))
    facts = stored(_facts(groups, ["group"]).join(sizes.select("group", "size"), "group"))
    words = facts.filter((F.col("what") == "word") & (2 * F.col("n") >= F.col("size")))
    many = words.groupBy("group").agg(F.count("*").alias("many"))
    points = F.element_at(F.create_map(*(F.lit(x) for item in POINTS.items() for x in item)), F.col("what"))
    plain = facts.filter("what <> 'word'").select("group", "what", "value", (points * F.col("n") / F.col("size")).alias("points"))
    common = words.join(many, "group").select("group", "what", "value", (points / F.col("many")).alias("points"))
    clues = sizes.select("group", F.explode("clues").alias("value")).union(words.select("group", "value")).filter("value IS NOT NULL").distinct()
    return plain.unionByName(common).unionByName(clues.select("group", F.lit("name").alias("what"), "value", F.lit(POINTS["name"]).alias("points")))


def _spelled(wanted: DataFrame, names: DataFrame) -> DataFrame:
    """The same with every word that a name may match in the spellings that names have."""
    mine = wanted.filter("what = 'name'")
    labels = lambda t: t.filter("what = 'name'").select(F.col("value").alias("label")).filter(F.length("label") >= LETTERS)
    near = closeness.close(labels(wanted), labels(names), RATIO).filter("label <> other").select(F.col("label").alias("value"), "other")
    also = dealt(mine, near, ["value"]).select("group", "what", F.col("other").alias("value"), "points")
    return wanted.unionByName(also).distinct()


def placed(groups: DataFrame, folders: DataFrame, filed: DataFrame, base: DataFrame | None = None) -> DataFrame:
    """(group, folder_id, points, levels): where each group ends, with its points
    there and the levels it went down; a group that fits nowhere stays at its base
    with no points.

    base: (group, folder_id); without it, and for groups it does not name, the top
    level. Of folders that fit equally the smallest id is taken. Rows without a
    group are left out.
    """
    kind = folders.schema["folder_id"].dataType
    groups = groups.filter(F.col("group").isNotNull())
    folders, filed = folders.filter("folder_id IS NOT NULL"), filed.filter("folder_id IS NOT NULL")
    fact = F.xxhash64("what", "value").alias("fact")
    up = tree.closure(folders.select("folder_id", "parent_id"))
    totals = stored(_totals(filed, up))
    names = _names(folders)
    nodes = folders.select(F.col("folder_id").alias("inside"), _spot(F.col("parent_id")))
    wanted = stored(_spelled(asked(groups), names).select("group", "what", fact, "points"))
    # (folder_id, what, fact, n): what is known of folders by their own documents, from the second level on with the spot it is asked at
    facts = whole = stored(_facts(filed, ["folder_id"]).select("folder_id", "what", fact, F.when(F.col("what") == "word", F.col("n")).otherwise(0).alias("n")))
    start = groups.select("group").distinct()
    start = start.join(base.select("group", "folder_id"), "group", "left") if base is not None else start.withColumn("folder_id", F.lit(None).cast(kind))
    at = stored(start.select("group", "folder_id", F.lit(None).cast("double").alias("points"), F.lit(0).alias("levels")))
    ends = [at]
    while True:
        spots = at.select("group", _spot(F.col("folder_id")))
        inner = nodes.join(spots.select("spot").distinct(), "spot")
        here = stored(spots.join(wanted, "group"))
        asks, kinds_asked = here.filter("what <> 'kind'"), here.filter("what = 'kind'").select("group", "fact", F.col("points").alias("more"))
        below = up.join(inner, F.col("ancestor_id") == F.col("inside")).select("folder_id", "inside", "spot")
        rows = facts.join(below, ["folder_id", "spot"] if "spot" in facts.columns else ["folder_id"])
        rows = stored(rows.join(here.select("spot", "fact").distinct(), ["spot", "fact"], "left_semi").select("folder_id", "inside", "spot", "what", "fact", "n"))
        drop(whole)
        facts, whole = rows.select("folder_id", _spot(F.col("inside")), "what", "fact", "n"), rows
        plain = rows.filter("what IN ('series', 'sender')").select("spot", "fact", "inside").distinct()
        words = rows.filter("what = 'word'").groupBy("spot", "fact", "inside").agg(F.sum("n").alias("n")).join(totals.withColumnRenamed("folder_id", "inside"), "inside").filter(F.col("n") >= USUAL * F.col("total"))
        called = names.select(F.col("folder_id").alias("inside"), fact).join(inner, "inside").select("spot", "fact", "inside")
        there = plain.unionByName(words.select("spot", "fact", "inside")).unionByName(called).withColumnRenamed("inside", "folder_id")
        met = dealt(asks, there, ["spot", "fact"]).groupBy("group", "folder_id", "what").agg(F.sum("points").alias("sum"), F.max("points").alias("most"))
        met = met.groupBy("group", "folder_id").agg(F.sum(F.when(F.col("what") == "name", F.col("most")).otherwise(F.col("sum"))).alias("points"))
        # a kind alone opens no folder, so it is asked of those that it can still open or raise
        near = stored(met.filter(F.col("points") >= FITS - POINTS["kind"] - 1e-9))
        kinds = rows.filter("what = 'kind'").select(F.col("inside").alias("folder_id"), "fact").distinct()
        kind_points = near.select("group", "folder_id").join(kinds_asked, "group").join(kinds, ["folder_id", "fact"]).groupBy("group", "folder_id").agg(F.sum("more").alias("more"))
        scored = near.join(kind_points, ["group", "folder_id"], "left").withColumn("points", F.round(F.col("points") + F.coalesce("more", F.lit(0.0)), 9)).filter(F.col("points") >= FITS)
        best = scored.groupBy("group").agg(F.min_by(F.struct("folder_id", "points"), F.struct(-F.col("points"), "folder_id")).alias("b"))
        at = stored(best.select("group", "b.folder_id", "b.points", F.lit(len(ends)).alias("levels")))
        drop(here, near)
        if at.isEmpty():
            break
        ends.append(at)
    deepest = reduce(DataFrame.unionByName, ends).groupBy("group").agg(F.max_by(F.struct("folder_id", "points"), "levels").alias("b"), F.max("levels").alias("levels"))
    found = settle(deepest.select("group", "b.folder_id", "b.points", "levels"))
    drop(up, totals, wanted, whole, at, *ends)
    return found
