"""Facts in a text as column expressions: dates, amounts, references, page marks, IBANs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import iban_rest

# Patterns of facts.
DATE = r"(?:^|[^0-9A-Za-z])([0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{1,2}\.[0-9]{1,2}\.[0-9]{4})"
AMOUNT = r"(?:^|[^0-9.,])([0-9]{1,3}(?:\.[0-9]{3})+,[0-9]{2}|[0-9]+,[0-9]{2}|[0-9]+\.[0-9]{2})(?:[^0-9.,/-]|[.,](?:[^0-9]|$)|$)"
TOTAL = r"(?i)(total|summe|gesamt|betrag|amount due)"
REFERENCE = r"(?i)(invoice|order|customer|reference|rechnung|kunde|vertrag|id)[a-z]*(?: no| nr)?[.:#]* *([0-9][0-9/-]{3,20})"
PAGE_MARK = r"(?i)(?:seite|blatt|page) +([0-9]{1,3}) *(?:von|of|/|aus) *([0-9]{1,3})"
IBAN = r"([A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,30})"
PLATE = r"(?:^|[^A-Z0-9-])([A-Z]{1,3}-[A-Z]{1,2} [0-9]{1,4})(?:[^0-9]|$)"


def dates(text: Column) -> Column:
    """Valid dates from 1950 on, in text order, as ISO strings; repeats stay."""

    def iso(found: Column) -> Column:
        part = F.split(found, r"\.")
        german = F.concat_ws("-", F.get(part, 2), F.lpad(F.get(part, 1), 2, "0"), F.lpad(F.get(part, 0), 2, "0"))
        return F.when(found.contains("."), german).otherwise(found)

    every = F.transform(F.regexp_extract_all(text, F.lit(DATE), 1), iso)
    return F.filter(every, lambda d: (d >= "1950-01-01") & d.try_cast("date").isNotNull())


def amounts(text: Column) -> Column:
    """Amounts as decimals, with comma or point before the cents."""

    def number(found: Column) -> Column:
        plain = F.when(found.contains(","), F.replace(F.replace(found, F.lit("."), F.lit("")), F.lit(","), F.lit("."))).otherwise(found)
        return plain.try_cast("decimal(18,2)")

    return F.filter(F.transform(F.regexp_extract_all(text, F.lit(AMOUNT), 1), number), lambda x: x.isNotNull())


def total(text: Column) -> Column:
    """The largest amount on lines that speak of a total, else the largest."""
    lines = F.filter(F.split(text, "\n"), lambda line: line.rlike(TOTAL))
    return F.coalesce(F.array_max(F.flatten(F.transform(lines, amounts))), F.array_max(amounts(text)))


def references(text: Column, most: int = 10) -> Column:
    """`label=value` pairs: the first value of each label, at most `most`."""
    labels = F.transform(F.regexp_extract_all(text, F.lit(REFERENCE), 1), F.lower)
    values = F.regexp_extract_all(text, F.lit(REFERENCE), 2)
    first = F.transform(F.array_distinct(labels), lambda name: F.concat_ws("=", name, F.element_at(values, F.array_position(labels, name).cast("int"))))
    return F.slice(first, 1, most)


def page_marks(text: Column) -> Column:
    """(page, of) of marks such as `page 2 of 3` that make sense."""
    pages = F.transform(F.regexp_extract_all(text, F.lit(PAGE_MARK), 1), lambda x: x.cast("int"))
    of = F.transform(F.regexp_extract_all(text, F.lit(PAGE_MARK), 2), lambda x: x.cast("int"))
    marks = F.zip_with(pages, of, lambda p, o: F.struct(p.alias("page"), o.alias("of")))
    return F.filter(marks, lambda m: (m["page"] >= 1) & (m["page"] <= m["of"]) & (m["of"] <= 200))


def ibans(text: Column) -> Column:
    """Distinct account numbers whose check digits hold, blanks removed."""
    plain = F.transform(F.regexp_extract_all(text, F.lit(IBAN), 1), lambda x: F.replace(x, F.lit(" "), F.lit("")))
    return F.filter(F.array_distinct(plain), lambda x: F.length(x).between(15, 34) & (iban_rest(x) == 1))


def plates(text: Column, most: int = 5) -> Column:
    """Distinct licence plates in text order."""
    return F.slice(F.array_distinct(F.regexp_extract_all(text, F.lit(PLATE), 1)), 1, most)
