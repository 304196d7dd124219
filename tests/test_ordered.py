"""Facets and medians of many values."""

import statistics

from pyspark.sql import functions as F

from lakefolio.operators import ordered


def test_median(spark):
    for n in (0, 1, 2, 7, 1000):
        rows = spark.range(n).select(F.pmod(F.col("id") * 7919, F.lit(613)).alias("x")).unionByName(spark.range(3).select(F.lit(None).cast("long").alias("x")))
        want = statistics.median([i * 7919 % 613 for i in range(n)]) if n else None
        assert [tuple(r) for r in ordered.median(rows, F.col("x")).collect()] == [(n, want)]


def test_facet(spark):
    rows = spark.range(3000).select(F.when(F.col("id") % 5 > 0, F.floor(F.sqrt("id")).cast("string")).alias("v"))
    counts = {(r.v or "None"): r["count"] for r in rows.groupBy("v").count().collect()}
    for most in (1, 3, 10, len(counts) - 1, len(counts), 500):
        order = sorted(counts, key=lambda v: (-counts[v], v))
        keep = order if len(order) <= most else order[: most - 1]
        want = {v: counts[v] for v in keep} | ({"Other": sum(counts[v] for v in order[len(keep) :])} if len(order) > most else {})
        out = ordered.facet(rows, F.col("v"), most)
        assert {r.value: r.n for r in out.collect()} == want
        plan = out._jdf.queryExecution().optimizedPlan().toString()
        assert "GlobalLimit" in plan[plan.rindex("Window ") :]  # the windows are over the top values only
