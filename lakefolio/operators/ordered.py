"""Windows over ordered rows: stacks, gaps, cadence, numbering, sessions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .settled import settle


def stack(rows: DataFrame, pile: str, order: list[Column], sheets: Column) -> DataFrame:
    """Adds place (from the top), of, sheets_above and sheets_below."""
    above = Window.partitionBy(pile).orderBy(*order)
    whole, before = Window.partitionBy(pile), above.rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("sheets", sheets)
    return rows.withColumns({
        "place": F.row_number().over(above),
        "of": F.count("*").over(whole),
        "sheets_above": F.coalesce(F.sum("sheets").over(before), F.lit(0)),
        "sheets_below": F.sum("sheets").over(whole) - F.sum("sheets").over(above.rowsBetween(Window.unboundedPreceding, 0)),
    })


def cadence(rows: DataFrame, key: str, date: str) -> DataFrame:
    """(key, dates, median_gap, cadence) from the gaps between distinct dates."""
    days = rows.select(key, F.to_date(date).alias("day")).distinct()
    gap = F.datediff("day", F.lag("day").over(Window.partitionBy(key).orderBy("day")))
    gaps = days.withColumn("gap", gap).groupBy(key).agg(F.count("*").alias("dates"), F.percentile("gap", 0.5).alias("median_gap"))
    m = F.col("median_gap")
    name = F.when(m.between(25, 35), "monthly").when(m.between(80, 100), "quarterly").when(m.between(330, 400), "yearly").otherwise("irregular")
    return gaps.withColumn("cadence", name)


def missing_months(rows: DataFrame, key: str, date: str, most: int = 24) -> DataFrame:
    """(key, month): calendar months between the first and last date without a
    row; the first `most` of each key."""
    months = rows.select(key, F.trunc(date, "month").alias("month")).distinct()
    span = months.groupBy(key).agg(F.min("month").alias("low"), F.max("month").alias("high"))
    every = span.select(key, F.explode(F.sequence("low", "high", F.expr("interval 1 month"))).alias("month"))
    gone = every.join(months, [key, "month"], "left_anti")
    order = Window.partitionBy(key).orderBy("month")
    return gone.withColumn("n", F.row_number().over(order)).filter(F.col("n") <= most).drop("n")


def batches(rows: DataFrame, key: str, time: str, minutes: int) -> DataFrame:
    """(key, batch, start, end, n): rows less than `minutes` apart belong together."""
    order = Window.partitionBy(key).orderBy(time)
    fresh = F.coalesce(F.col(time) - F.lag(time).over(order) >= F.expr(f"interval {minutes} minutes"), F.lit(True))
    marked = rows.withColumn("batch", F.sum(fresh.cast("int")).over(order))
    return marked.groupBy(key, "batch").agg(F.min(time).alias("start"), F.max(time).alias("end"), F.count("*").alias("n"))


def numbered(rows: DataFrame, title: str, order: str) -> DataFrame:
    """Adds `numbered`: the title, with (k) where it occurs more than once."""
    every = Window.partitionBy(title)
    place = F.row_number().over(every.orderBy(order))
    name = F.when(F.count("*").over(every) > 1, F.concat(title, F.lit(" ("), place.cast("string"), F.lit(")"))).otherwise(F.col(title))
    return rows.withColumn("numbered", name)


def facet(rows: DataFrame, value: Column, most: int = 10, missing: str = "None") -> DataFrame:
    """(value, n): counts; beyond `most` values the rarest are one `Other`."""
    counted = rows.groupBy(F.coalesce(value.cast("string"), F.lit(missing)).alias("value")).agg(F.count("*").alias("n"))
    top = counted.orderBy(F.desc("n"), "value").limit(most + 1)  # the windows are over these few
    place, values = F.row_number().over(Window.orderBy(F.desc("n"), "value")), F.count("*").over(Window.partitionBy())
    kept = top.withColumns({"place": place, "values": values}).filter((F.col("values") <= most) | (F.col("place") < most))
    named = counted.join(F.broadcast(kept.select("value", F.lit(True).alias("kept"))), "value", "left")
    return named.groupBy(F.when(F.col("kept"), F.col("value")).otherwise("Other").alias("value")).agg(F.sum("n").alias("n"))


def median(rows: DataFrame, value: Column) -> DataFrame:
    """(n, median) of the values that are not null, in one row. Sorted by ranges;
    only the middle rows and a count for each range come to the driver."""
    values = rows.select(value.cast("double").alias("value")).filter("value IS NOT NULL")
    by_range = settle(values.repartitionByRange("value").sortWithinPartitions("value").withColumn("at", F.monotonically_increasing_id()))
    counts = sorted(tuple(r) for r in by_range.groupBy(F.shiftright("at", 33)).count().collect())
    n, before, middle = sum(c for _, c in counts), 0, []
    for number, c in counts:
        middle += [(number << 33) + k - before for k in sorted({(n - 1) // 2, n // 2}) if before <= k < before + c]
        before += c
    return by_range.filter(F.col("at").isin(middle)).agg(F.lit(n).alias("n"), F.avg("value").alias("median"))
