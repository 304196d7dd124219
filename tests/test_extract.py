"""Facts from small texts."""

from pyspark.sql import functions as F

from lakefolio.functions import extract as E


def facts(spark, text):
    t = F.col("text")
    return spark.createDataFrame([(text,)], "text string").select(
        E.dates(t).alias("dates"), E.amounts(t).alias("amounts"), E.total(t).cast("string").alias("total"), E.references(t).alias("refs"),
        E.page_marks(t).alias("marks"), E.ibans(t).alias("ibans"), E.plates(t).alias("plates"),
    ).first()


def test_invoice(spark):
    row = facts(spark, "Rechnung Nr. 2026-0042 vom 14.3.2026, Stand 2026-02-01\nPosten 1.234,50\nSumme 98,40\nSeite 2 von 3\nDE89 3704 0044 0532 0130 00\nB-AB 123")
    assert row.dates == ["2026-03-14", "2026-02-01"]
    assert [str(a) for a in row.amounts] == ["1234.50", "98.40"] and row.total == "98.40"
    assert row.refs == ["rechnung=2026-0042"]
    assert [(m.page, m.of) for m in row.marks] == [(2, 3)]
    assert row.ibans == ["DE89370400440532013000"] and row.plates == ["B-AB 123"]


def test_nothing_to_find(spark):
    row = facts(spark, "31.02.2026, 1949-12-31, Seite 4 von 3, DE88 3704 0044 0532 0130 00")
    assert row.dates == [] and row.amounts == [] and row.total is None and row.marks == [] and row.ibans == []
    empty = facts(spark, "")
    assert empty.dates == [] and empty.refs == [] and empty.plates == []


def test_null_text(spark):
    row = facts(spark, None)
    assert row.dates is None and row.total is None and row.ibans is None
