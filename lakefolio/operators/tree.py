"""Folder trees: closure, paths and rolled-up counts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .settled import drop, settle


def closure(folders: DataFrame) -> DataFrame:
    """(folder_id, ancestor_id, distance) with every folder its own ancestor.

    One join a level, until a level is empty. A cycle is walked until it comes
    back to the ancestor that was last marked; levels 1, 2, 4, 8 and so on mark.
    """
    parents = folders.select(F.col("folder_id").alias("ancestor_id"), "parent_id")
    level = folders.select("folder_id", F.col("folder_id").alias("ancestor_id"), F.lit(0).alias("distance"), F.col("folder_id").alias("mark"))
    out, distance, levels = level.drop("mark"), 0, []
    while True:
        distance += 1
        up = level.join(parents, "ancestor_id").filter("parent_id IS NOT NULL AND parent_id <> mark")
        mark = F.col("parent_id" if distance & (distance - 1) == 0 else "mark").alias("mark")
        level = settle(up.select("folder_id", F.col("parent_id").alias("ancestor_id"), F.lit(distance).alias("distance"), mark))
        levels.append(level)
        if level.isEmpty():
            found = settle(out.groupBy("folder_id", "ancestor_id").agg(F.min("distance").alias("distance")))
            drop(*levels)
            return found
        out = out.unionByName(level.drop("mark"))


def paths(folders: DataFrame) -> DataFrame:
    """(folder_id, path, depth): names from the root, joined by " / "."""
    up = closure(folders).join(folders.select(F.col("folder_id").alias("ancestor_id"), "name"), "ancestor_id")
    parts = F.reverse(F.transform(F.array_sort(F.collect_list(F.struct("distance", "name"))), lambda x: x["name"]))
    return up.groupBy("folder_id").agg(F.array_join(parts, " / ").alias("path"), F.count("*").alias("depth"))


def rollup(folders: DataFrame, items: DataFrame) -> DataFrame:
    """(folder_id, own, total): items of a folder, and of all below it."""
    own = items.groupBy("folder_id").agg(F.count("*").alias("own"))
    below = closure(folders).join(own, "folder_id").groupBy(F.col("ancestor_id").alias("folder_id")).agg(F.sum("own").alias("total"))
    out = folders.select("folder_id").join(own, "folder_id", "left").join(below, "folder_id", "left")
    return out.select("folder_id", F.coalesce("own", F.lit(0)).alias("own"), F.coalesce("total", F.lit(0)).alias("total"))
