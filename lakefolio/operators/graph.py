"""Connected components of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .settled import settle
from .skew import hot_keys, lookup


def components(links: DataFrame) -> DataFrame:
    """(node, root): for every node of `links` (a, b) the smallest node it reaches.

    Minimum label propagation with pointer jumping: labels travel one link a
    round and twice as far by the jump, each round is written to the shared
    checkpoint folder, and nothing but whether labels changed reaches the driver.
    Hubs, and roots of very large components, are looked up without a shuffle.
    """
    both = settle(links.select("a", "b").union(links.select("b", "a")).distinct())
    hubs = settle(hot_keys(both.groupBy(F.col("a").alias("b")).agg(F.count("*").alias("copies")), both.count()).select("b"))
    labels = settle(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("root")))
    while True:
        heard = lookup(both, labels.withColumnRenamed("node", "b"), "b", hubs).groupBy(F.col("a").alias("node")).agg(F.min("root").alias("heard"))
        nearer = settle(labels.join(heard, "node").select("node", F.col("root").alias("old"), F.least("root", "heard").alias("root")))
        above = labels.select(F.col("node").alias("root"), F.col("root").alias("top"))
        jumped = settle(lookup(nearer, above, "root").select("node", "old", F.least("root", "top").alias("root")))
        labels = jumped.select("node", "root")
        if jumped.filter("old <> root").isEmpty():
            return labels
