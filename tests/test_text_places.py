"""Snippets and dates against loops over letters and matches."""

import datetime
import re

from pyspark.sql import functions as F

from lakefolio.functions import dates, letters, snippets

TEXTS = [
    None, "", "kein Treffer", "Die Straße und die STRASSE, süße Äpfel: Gruß", "ﬁnale ﬂuß ﬃ oﬃce Öffnung " + "x " * 200 + "Übergröße", "äöü" * 200 + " Fußweg " + "ß" * 300, "a\x02ß\x02Straße \n\n  zwei", "İstanbul STRAẞE straße",
    "Straßenbahn strasse " * 3,
]


def plain_fold(text):
    out, places = [], []
    for i, c in enumerate(text):
        low = {"İ": "i", "\x02": " "}.get(c, c.lower())
        for x in snippets.SPELLED.get(low, low):
            out.append(x)
            places.append(i + 1)
    return "".join(out), places


def test_places_and_snippets_are_of_the_text(spark):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "i int, text string").repartition(3)
    for needles in ([["strasse", "strass"]], [["gruss"], ["fuss"]], [["ffi"]], [["nirgends"], ["zwei"]], [["uebergroess"]]):
        hit = snippets.first_hit(F.col("text"), needles)
        rows = df.select("i", "text", snippets.folded(F.col("text")).alias("f"), hit.alias("hit")).withColumn("w", snippets.window(F.col("text"), F.col("hit")))
        rows = rows.select("*", snippets.shown(F.col("text"), F.col("w")).alias("shown"), snippets.highlights(F.col("w.raw"), needles).alias("marks"))
        for r in rows.collect():
            if r.text is None:
                assert r.hit is None and r.shown is None
                continue
            whole, places = plain_fold(r.text)
            assert r.f == whole
            at = [whole.find(next((n for n in sorted(some, key=len, reverse=True) if n in whole), "\0")) for some in needles]
            at = [x for x in at if x >= 0]
            assert r.hit == (places[min(at)] if at else None)
            start = max(1, (r.hit or 1) - 90)
            raw = r.text[start - 1 :][: (r.hit - start + 180) if r.hit else 180]
            assert (r.w.start, r.w.raw) == (start, raw) and raw in r.text
            core = re.sub(r"\s+", " ", raw).strip(" ")
            assert r.shown == ("… " if start > 1 else "") + core + (" …" if start - 1 + len(raw) < len(r.text) else "")
            small, own = plain_fold(raw)
            want = set()
            for some in needles:
                needle = next((n for n in sorted(some, key=len, reverse=True) if n in small), None)
                for m in re.finditer(re.escape(needle) + r"[^\W_]*", small) if needle else ():
                    want.add((own[m.start()], raw[own[m.start()] - 1 : own[m.end() - 1]]))
            assert r.marks == [h for _, h in sorted(want)]


TODAY = datetime.date(2026, 3, 1)
LETTERS = [
    None, "", "nichts", "Berlin, den 12.03.2025\nRechnung vom 3. März 2024, fällig bis 01.04.24", "born 1/2/1980, dated March 5, 2021; period 2020-01-01 until 2020-12-31", "Hamburg, im November 2025",
    "31.02.2020 und 99.99.9999, 12.12.2090, 01.01.1949", "im Mai 2019 und 4. Mai 2019 und Mai 4, 2019", "Zeitraum 01.01.70 bis 31.12.69\n\n\n" + "x" * 200 + "\nStand: 2022-02-02", "Text 5 Sept. 2018 x 5.9.2018", "v1.2.2020 a1.2.2020 1.2.2020a 1.2.20201",
]


def plain_dates(text):
    out, taken = [], []
    for form, (pattern, year, month, day) in dates.FORMS.items():
        for m in re.finditer(pattern.replace(r"\p{L}", "a-zA-ZäöüÄÖÜß"), text):
            if form == "month_y" and any(a <= m.start() < b for a, b in taken):
                continue
            y, mo = int(m[year]), dates.MONTHS[m[month].lower()] if "month" in form else int(m[month])
            y += 0 if y >= 100 else 2000 if y < 70 else 1900
            try:
                d = datetime.date(y, mo, int(m[day]) if day else 1)
            except ValueError:
                continue
            if datetime.date(1950, 1, 1) <= d <= TODAY + datetime.timedelta(400):
                out.append((m.start(), d, day > 0))
                taken.append(m.span())
    return sorted(out)


def plain_pick(text):
    best = None
    for at, d, whole in plain_dates(text):
        before, start = text[max(0, at - 40) : at], text.rfind("\n", 0, at) + 1
        line = text[start : text.find("\n", at) if "\n" in text[at:] else len(text)]
        score = 3.0 * bool(re.search(dates.HINTS, before) or re.search(dates.HINTS, line)) - bool(re.search(dates.PERIODS, before)) - 2 * bool(re.search(dates.OTHER_DAYS, before))
        score -= bool(re.search(r"(?i)(^|[\W])(ab|bis|from|until)\s*$", before))
        score += 2 * (at < len(text) * 0.25) + 2 * bool(re.search(dates.PLACE, text[start:at])) - 1.5 * (not whole) - 3 * (d > TODAY + datetime.timedelta(30)) - at / len(text)
        best = max(best or (score, -at, d), (score, -at, d))
    return best and best[2]


def test_dates_of_five_forms_and_the_document_date(spark):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(LETTERS)], "i int, text string")
    today = F.lit(TODAY)
    rows = df.withColumn("found", dates.dates(F.col("text"), today)).withColumn("date", dates.document_date(F.col("text"), F.col("found"), today)).collect()
    for r in rows:
        assert [(d.at, d.day, d.whole) for d in r.found] == plain_dates(r.text or ""), r.text
        assert r.date == plain_pick(r.text or ""), r.text
    assert {r.date for r in rows if r.i == 3} == {datetime.date(2025, 3, 12)} and len(rows[7].found) == 3


def test_senders_and_subjects(spark):
    rows = [
        ("Muster GmbH · Weg 1 · 12345 Stadt\nHerr X", "Muster GmbH", None), ("12 · x · 12345 Stadt\nDas Bundesverwaltungsamt\nBetreff: Ihr  Antrag\nx", "Das Bundesverwaltungsamt", "Ihr Antrag"),
        ("Hallo\n\n  Landratsamt Kreis   Raum 5\nRechnung Nr. 5", "Landratsamt Kreis", "Rechnung Nr. 5"), ("SUBJECT :abc\nRe: the offer\n", None, "the offer"), ("Rechnungen\nStadt 12345", None, None),
        (None, None, None), ("", None, None), ("Agentur X\n" * 25 + "Y AG", None, None), ("Familienkasse\r\nBescheid vom 1.1.", "Familienkasse", "Bescheid vom 1.1."), ("x" * 91 + " GmbH", None, None),
    ]
    df = spark.createDataFrame([(i, t) for i, (t, _, _) in enumerate(rows)], "i int, text string")
    for r in df.select("i", letters.sender(F.col("text")).alias("s"), letters.subject(F.col("text")).alias("b")).collect():
        assert (r.s, r.b) == rows[r.i][1:], rows[r.i]
