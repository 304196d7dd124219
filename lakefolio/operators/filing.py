"""Where documents are to go: wished folders, folders yet to be made, moves.

A target is a folder that exists (null: the top level) and names below it. Names
are compared in lower case without blanks around them. Folders that targets would
make get ids below zero and can be used in a tree like any other until they are
folded back into a target.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import tree
from .settled import settle
from .skew import lookup


def _within(folder: Column) -> Column:
    """A key for what lies in a folder, the top level having one, too."""
    return F.when(folder.isNull(), "top").otherwise(F.concat(F.lit("in "), folder.cast("string")))


def _same(name: Column) -> Column:
    return F.lower(F.trim(name))


def numbered(rows: DataFrame, order: list[str], number: str) -> DataFrame:
    """Adds consecutive numbers from 1 in the order of columns that tell all rows
    apart. Rows are sorted by ranges; the driver sees one count a range."""
    ranged = settle(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id()))
    counts, before, starts = sorted(tuple(r) for r in ranged.groupBy(F.shiftright("_at", 33)).count().collect()), 0, []
    for range_number, n in counts:
        starts.append((range_number, before))
        before += n
    first = rows.sparkSession.createDataFrame(starts, "_range long, _before long")
    placed = ranged.withColumn("_range", F.shiftright("_at", 33)).join(F.broadcast(first), "_range")
    return placed.withColumn(number, F.col("_before") + F.col("_at") % (1 << 33) + 1).drop("_at", "_range", "_before")


def walked(targets: DataFrame, folders: DataFrame, levels: int = 10) -> DataFrame:
    """(id, anchor, names): targets (id, anchor, names) with the names that exist
    by now walked down; of two folders with one name in one place the smaller id
    counts. Names that are empty are left out, and those beyond `levels`."""
    named = F.slice(F.filter(F.coalesce("names", F.array().cast("array<string>")), lambda n: F.trim(n) != ""), 1, levels)
    below = folders.select("folder_id", _within(F.col("parent_id")).alias("place"), _same(F.col("name")).alias("label"))
    below = settle(below.filter("label <> '' AND folder_id IS NOT NULL").groupBy("place", "label").agg(F.min("folder_id").alias("folder_id")))
    at = settle(targets.filter("id IS NOT NULL").select("id", "anchor", F.transform(named, lambda n: F.trim(n)).alias("names")))
    done = None
    while True:
        # many targets ask for the same step
        ahead = at.withColumn("step", F.struct(_within(F.col("anchor")).alias("place"), _same(F.get("names", F.lit(0))).alias("label")))
        steps = below.select(F.struct("place", "label").alias("step"), F.col("folder_id").alias("next"))
        went = settle(lookup(ahead.filter(F.size("names") > 0), steps, "step").select("id", F.col("next").alias("anchor"), F.slice("names", F.lit(2), F.greatest(F.size("names") - 1, F.lit(0))).alias("names")))
        stay = at.join(went.select("id"), "id", "left_anti")
        done = stay if done is None else done.unionByName(stay)
        if went.isEmpty():
            return done
        at = went


def overlaid(targets: DataFrame, folders: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The folders (folder_id, parent_id, name, anchor, names) with those that the
    targets would make, and the targets as (id, folder_id).

    Every folder to be made is made once, written as in the first spelling of its path,
    numbered from -1 downwards by depth, place and name. `anchor` and `names` lead
    to it from a folder that exists.
    """
    rest = settle(walked(targets, folders))
    lower = F.transform("names", lambda n: _same(n))
    steps = rest.filter(F.size("names") > 0).select("anchor", "names", lower.alias("labels"), F.explode(F.sequence(F.lit(1), F.size("names"))).alias("depth"))
    made = steps.groupBy("anchor", "depth", F.slice("labels", F.lit(1), F.col("depth")).alias("path")).agg(F.min(F.slice("names", F.lit(1), F.col("depth"))).alias("names"))
    made = settle(numbered(made, ["depth", "anchor", "path"], "number").select((-F.col("number")).alias("folder_id"), "anchor", "depth", "path", "names"))
    key = F.struct(_within(F.col("anchor")).alias("place"), F.col("path"))
    parents = made.select(key.alias("above"), F.col("folder_id").alias("parent_id"))
    above = F.struct(_within(F.col("anchor")).alias("place"), F.slice("path", F.lit(1), F.col("depth") - 1).alias("path"))
    deeper = made.filter("depth > 1").withColumn("above", above).join(parents, "above")
    columns = ["folder_id", "parent_id", F.element_at("names", -1).alias("name"), "anchor", "names"]
    new = made.filter("depth = 1").withColumn("parent_id", F.col("anchor")).select(*columns).unionByName(deeper.select(*columns))
    old = folders.select("folder_id", "parent_id", "name", F.col("folder_id").alias("anchor"), F.array().cast("array<string>").alias("names"))
    ends = lookup(rest.filter(F.size("names") > 0).withColumn("end", F.struct(_within(F.col("anchor")).alias("place"), lower.alias("path"))), made.select(key.alias("end"), "folder_id"), "end").select("id", "folder_id")
    return old.unionByName(new), rest.filter(F.size("names") == 0).select("id", F.col("anchor").alias("folder_id")).unionByName(ends)


def real(placed: DataFrame, overlay: DataFrame) -> DataFrame:
    """(id, anchor, names): places (id, folder_id) in an overlay as targets again."""
    there = lookup(placed.filter("folder_id IS NOT NULL"), overlay.select("folder_id", "anchor", "names"), "folder_id").select("id", "anchor", "names")
    top = placed.filter("folder_id IS NULL").select("id", F.col("folder_id").alias("anchor"), F.array().cast("array<string>").alias("names"))
    return there.unionByName(top)


def shallowest(wishes: DataFrame, folders: DataFrame) -> DataFrame:
    """(base, name, folder_id): for every wish (base, name) the folder of that name
    nearest to its base, at any depth below it; ties to the smallest id, null if
    there is none. A null base is the top level."""
    up = settle(tree.closure(folders.select("folder_id", "parent_id").filter("folder_id IS NOT NULL")))
    named = folders.select("folder_id", _same(F.col("name")).alias("label"))
    roots = folders.filter("parent_id IS NULL").select(F.col("folder_id").alias("ancestor_id"))
    under = up.filter("distance > 0").select("folder_id", "distance", _within(F.col("ancestor_id")).alias("place")).unionByName(up.join(roots, "ancestor_id").select("folder_id", (F.col("distance") + 1).alias("distance"), F.lit("top").alias("place")))
    nearest = under.join(named, "folder_id").groupBy("place", "label").agg(F.min_by("folder_id", F.struct("distance", "folder_id")).alias("folder_id"))
    asked = wishes.select("base", "name").distinct().withColumns({"place": _within(F.col("base")), "label": _same(F.col("name"))})
    return asked.join(nearest, ["place", "label"], "left").select("base", "name", "folder_id")


def wished(docs: DataFrame, rules: list[tuple[Column, str]], folders: DataFrame) -> DataFrame:
    """(id, rule, anchor, names): the first rule whose condition holds takes a
    document of (id, folder_id, ...): into the nearest folder of its name below
    the document's own, or into one to be made there. `rule` counts from 0;
    documents that no rule takes are left out."""
    first = F.coalesce(*(F.when(holds, F.lit(n)) for n, (holds, _) in enumerate(rules)))
    names = F.array(*(F.lit(name) for _, name in rules))
    taken = settle(docs.filter("id IS NOT NULL").select("id", F.col("folder_id").alias("base"), first.alias("rule")).filter("rule IS NOT NULL").withColumn("name", F.get(names, F.col("rule"))))
    found = settle(shallowest(taken, folders).select(F.struct(_within(F.col("base")).alias("place"), "name").alias("wish"), "folder_id"))
    rows = lookup(taken.withColumn("wish", F.struct(_within(F.col("base")).alias("place"), "name")), found, "wish")
    none = F.array().cast("array<string>")
    return rows.select("id", "rule", F.coalesce("folder_id", "base").alias("anchor"), F.when(F.col("folder_id").isNull(), F.array("name")).otherwise(none).alias("names"))


def downwards(docs: DataFrame, places: DataFrame, overlay: DataFrame) -> DataFrame:
    """(id, old, new): the moves of documents (id, folder_id) to places (id,
    folder_id) that lead downwards: into a folder below the document's own, or
    from the top level into any."""
    up = tree.closure(overlay.select("folder_id", "parent_id")).filter("distance > 0").select(F.struct(F.col("ancestor_id").alias("old"), F.col("folder_id").alias("new")).alias("way"))
    moves = settle(docs.select("id", F.col("folder_id").alias("old")).join(places.select("id", F.col("folder_id").alias("new")), "id").filter("new IS NOT NULL"))
    below = lookup(moves.filter("old IS NOT NULL").withColumn("way", F.struct("old", "new")), up, "way").select("id", "old", "new")
    return moves.filter("old IS NULL").select("id", "old", "new").unionByName(below)
