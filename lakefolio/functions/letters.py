"""Who wrote a letter and what about, by rules, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Ends of names of organisations, and of compounds that name one.
FORMS = ("GmbH", "AG", "SE", "KG", "KGaA", "OHG", r"e\.\s?V\.", "eG", "mbH", "UG", "GbR", "Inc", "Ltd", "LLC", "plc", r"S\.A\.", r"B\.V\.")
BODIES = (
    "Versicherung", "Versicherungen", "Bank", "Sparkasse", "Volksbank", "Stadtwerke", "Finanzamt", "Krankenkasse", "Universität", "Hochschule", "Landratsamt", "Rathaus", "Stadt", "Gemeinde",
    "Bundesagentur", "Deutsche Rentenversicherung", "AOK", "Techniker", "Barmer", "Telekom", "Vodafone", "Amt", "Behörde", "Ministerium", "Jobcenter", "Polizei", "Landkreis", "Stiftung", "Klinikum",
)
COMPOUNDS = ("amt", "gericht", "kasse", "versicherung", "agentur", "behörde", "ministerium")
SUBJECTS = ("betreff", r"betr\.", "subject", "re", "ihr zeichen")
KINDS = (
    "rechnung", "invoice", "gehaltsabrechnung", "entgeltabrechnung", "lohnabrechnung", "kontoauszug", "beitragsrechnung", "bescheid", "mahnung", "kündigung", "vertrag", "police",
    "versicherungsschein", "jahresabrechnung", "abrechnung", "statement", "bestätigung", "mitteilung",
)

_END = r"($|[^0-9A-Za-zÄÖÜäöüß_])"
_START = r"(^|[^0-9A-Za-zÄÖÜäöüß_])"
#: A line that names an organisation; "Gesamtbehörde" and the like are sums, not offices.
ORGANISATION = rf"{_START}({'|'.join((*FORMS, *BODIES))}){_END}"
COMPOUND = rf"{_START}[A-ZÄÖÜ][a-zäöüß]+({'|'.join(COMPOUNDS)}){_END}"
POSTCODE = r"(^|[^0-9A-Za-z_])[0-9]{5}\s+[A-ZÄÖÜ][a-zäöüß]+"
PARTED = r"\s+[·•|]\s+|\s+-\s+|\s{3,}"
SUBJECT = rf"(?im)^\s*({'|'.join(SUBJECTS)})\s*:\s*(.{{4,120}})$"
KIND = rf"(?i)^({'|'.join(KINDS)}){_END}"


def lines(text: Column, most: int) -> Column:
    """The first lines that hold something, trimmed."""
    every = F.transform(F.split(F.coalesce(text, F.lit("")), r"\r\n|\r|\n"), lambda x: F.regexp_replace(x, r"^\s+|\s+$", ""))
    return F.slice(F.filter(every, lambda x: x != ""), 1, most)


def _first_part(line: Column) -> Column:
    return F.regexp_replace(F.get(F.split(line, PARTED), F.lit(0)), r"^[ ,]+|[ ,]+$", "")


def sender(text: Column) -> Column:
    """The name in a return address (parted by dots, with a postcode) among the
    first 30 lines, else in the first of 20 lines that names an organisation."""
    top = lines(text, 30)
    address = F.transform(F.filter(top, lambda x: x.rlike(POSTCODE) & x.rlike(PARTED)), _first_part)
    address = F.filter(address, lambda x: F.length(x).between(3, 80) & ~x.rlike("^[0-9]"))
    named = F.filter(F.slice(top, 1, 20), lambda x: (F.length(x) <= 90) & (x.rlike(ORGANISATION) | x.rlike(COMPOUND)))
    named = F.filter(F.transform(named, _first_part), lambda x: (F.length(x) >= 3) & ~x.rlike("[0-9]{5}"))
    return F.coalesce(F.get(address, F.lit(0)), F.get(named, F.lit(0)))


def subject(text: Column) -> Column:
    """What follows `Betreff:` and the like, else the first of 40 lines that
    begins with a kind of letter; at most 120 letters on one line."""
    said = F.nullif(F.regexp_extract(F.coalesce(text, F.lit("")), SUBJECT, 2), F.lit(""))
    kind = F.get(F.filter(lines(text, 40), lambda x: F.length(x).between(6, 90) & x.rlike(KIND)), F.lit(0))
    return F.substr(F.trim(F.regexp_replace(F.coalesce(said, kind), r"\s+", " ")), F.lit(1), F.lit(120))
