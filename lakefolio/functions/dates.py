"""Dates of five forms with their places in a text, and the date of a document."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Names of months in German and English, with their short forms.
MONTHS = {
    "januar": 1, "jänner": 1, "jan": 1, "februar": 2, "feb": 2, "märz": 3, "maerz": 3, "mär": 3, "mrz": 3, "april": 4, "apr": 4, "mai": 5, "juni": 6, "jun": 6, "juli": 7, "jul": 7,
    "august": 8, "aug": 8, "september": 9, "sep": 9, "sept": 9, "oktober": 10, "okt": 10, "november": 11, "nov": 11, "dezember": 12, "dez": 12,
    "january": 1, "february": 2, "march": 3, "mar": 3, "may": 5, "june": 6, "july": 7, "october": 10, "oct": 10, "december": 12, "dec": 12,
}
_MONTH = "|".join(sorted(MONTHS, key=lambda m: (-len(m), m)))
#: Form to (pattern, places of year, month and day among its groups; 0: the first of the month).
FORMS = {
    "dmy": (r"(?<![0-9A-Za-z_])([0-9]{1,2})[./-]([0-9]{1,2})[./-]([0-9]{4}|[0-9]{2})(?![0-9A-Za-z_])", 3, 2, 1),
    "ymd": (r"(?<![0-9A-Za-z_])([0-9]{4})-([0-9]{2})-([0-9]{2})(?![0-9A-Za-z_])", 1, 2, 3),
    "d_month_y": (rf"(?i)(?<![0-9A-Za-z_])([0-9]{{1,2}})\.?\s+({_MONTH})\.?\s+([0-9]{{4}})(?![0-9A-Za-z_])", 3, 2, 1),
    "month_d_y": (rf"(?i)(?<![\p{{L}}0-9_])({_MONTH})\.?\s+([0-9]{{1,2}}),?\s+([0-9]{{4}})(?![0-9A-Za-z_])", 3, 1, 2),
    "month_y": (rf"(?i)(?<![\p{{L}}0-9_])({_MONTH})\.?\s+([0-9]{{4}})(?![0-9A-Za-z_])", 2, 1, 0),
}
# Words near a date that speak for it or against it.
HINTS = "(?i)(datum|date|vom|dated|rechnungsdatum|invoice date|ausstellungsdatum|bescheid vom|erstellt am|stand)"
PERIODS = "(?i)(zeitraum|abrechnungszeitraum|leistungszeitraum|period|monat)"
OTHER_DAYS = r"(?i)(geb\.|geboren|geburt|birth|fällig|due|bis zum|zahlbar)"
BOUNDS = r"(?i)(^|[^\p{L}\p{N}_])(ab|bis|from|until)\s*$"
PLACE = r"[A-ZÄÖÜ][a-zäöüß]+,\s*(den|im|am)?\s*$"
FIRST, AHEAD, SOON = "1950-01-01", 400, 30
_KIND = "array<struct<at:int,day:date,whole:boolean,end:int>>"


def _with(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body` of a value that is worked out once: an expression named in a lambda is
    worked out again in every call, and one named several times as often."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _found(text: Column, form: str, today: Column) -> Column:
    """(at, day, whole, end) of one form's matches; at from 0."""
    pattern, year, month, day = FORMS[form]
    total = lambda some, n: F.aggregate(F.slice(some, F.lit(1), n), F.lit(0), lambda s, x: s + F.length(x))
    named = F.create_map(*(F.lit(x) for item in MONTHS.items() for x in item))

    def one(hit: Column, at: Column) -> Column:
        group = lambda n: F.regexp_extract(hit, pattern, n)
        m = F.try_element_at(named, F.lower(group(month))) if "month" in form else group(month).cast("int")
        y = _with(group(year).cast("int"), lambda y: F.when(y >= 100, y).when(y < 70, y + 2000).otherwise(y + 1900))
        d = group(day).cast("int") if day else F.lit(1)
        whole = F.format_string("%04d-%02d-%02d", y, m, d).try_cast("date")
        return _with(at, lambda at: F.struct(at.alias("at"), whole.alias("day"), F.lit(day > 0).alias("whole"), (at + F.length(hit)).alias("end")))

    def placed(hits: Column) -> Column:
        cut = _with(F.split(text, pattern, -1), lambda parts: F.transform(hits, lambda hit, i: one(hit, total(parts, i + 1) + total(hits, i))))
        return F.when(F.size(hits) > 0, cut).otherwise(F.array().cast(_KIND))

    every = _with(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), placed)
    return F.filter(every, lambda x: x["day"].isNotNull() & (x["day"] >= F.lit(FIRST).cast("date")) & (x["day"] <= F.date_add(today, AHEAD)))


def dates(text: Column, today: Column) -> Column:
    """(at, day, whole, end) of all plausible dates in text order: from 1950 to
    `AHEAD` days after today. A month and year inside another date are none of
    their own. whole: whether a day is named. Null and empty texts have none."""

    def both(text: Column) -> Column:
        days = F.concat(*(_found(text, form, today) for form in FORMS if form != "month_y"))
        return _with(days, lambda days: F.concat(days, F.filter(_found(text, "month_y", today), lambda m: ~F.exists(days, lambda d: (d["at"] <= m["at"]) & (m["at"] < d["end"])))))

    return F.array_sort(_with(F.coalesce(text, F.lit("")), both)).cast(_KIND)


def scored(text: Column, date: Column, today: Column) -> Column:
    """How much speaks for a date of `dates` as the document's own."""
    at, length = date["at"], F.greatest(F.length(text), F.lit(1))
    before = F.substr(text, F.greatest(at - 40, F.lit(0)) + 1, F.least(at, F.lit(40)))
    lead = F.substring_index(F.substr(text, F.lit(1), at), "\n", -1)
    line = F.concat(lead, F.substring_index(F.substr(text, at + 1), "\n", 1))
    points = lambda test, n: F.when(test, F.lit(float(n))).otherwise(0.0)
    return (
        points(before.rlike(HINTS) | line.rlike(HINTS), 3)
        + points(before.rlike(PERIODS), -1)
        + points(before.rlike(OTHER_DAYS), -2)
        + points(before.rlike(BOUNDS), -1)
        + points(at < length * 0.25, 2)
        + points(lead.rlike(PLACE), 2)
        + points(~date["whole"], -1.5)
        + points(date["day"] > F.date_add(today, SOON), -3)
        - at / length
    )


def document_date(text: Column, found: Column, today: Column) -> Column:
    """The date with most points, the first of equals; null without dates."""
    marked = F.transform(found, lambda d: F.struct(scored(text, d, today).alias("score"), (-d["at"]).alias("first"), d["day"].alias("day")))
    return F.array_max(marked)["day"]
