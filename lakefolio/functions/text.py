"""Text functions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# German letters and their two-letter spellings.
FOLDS = {"ä": "ae", "ö": "oe", "ü": "ue", "ß": "ss", "æ": "ae", "ø": "oe", "å": "aa"}
# Words too common to search for, in four languages.
STOP_WORDS = (
    "the", "and", "of", "to", "in", "is", "it", "that", "for", "with", "as", "was", "on", "are", "be", "by", "this", "from", "or", "an",
    "der", "die", "und", "das", "den", "von", "zu", "mit", "im", "ist", "für", "auf", "ein", "eine", "nicht", "des", "dem",
    "de", "la", "le", "et", "les", "en", "un", "une", "du", "que", "el", "los", "las", "por", "para", "con",
)
# Words of which an index has neither prefixes nor tails, and that a query leaves out.
COMMON_WORDS = (
    "der die das und oder ein eine einer eines einem einen ist sind war wird werden wurde mit von vom zu zum zur im in an am auf aus bei fuer für nicht auch als wie es sie er wir ihr ich du sich dem den des "
    "so dass daß nach ueber über unter vor bis durch ohne gegen um noch nur sehr hier dort ja nein kein keine mehr ihre ihrer "
    "the a an and or of to in on for with by at from as is are was were be been this that these those it its not your you we our they their he she his her i me my"
).split()


def fold(text: Column) -> Column:
    """Lower case with umlauts and ligatures spelled out."""
    out = F.lower(text)
    for letter, spelled in FOLDS.items():
        out = F.replace(out, F.lit(letter), F.lit(spelled))
    return out


#: Letters with marks, and the letters without.
ACCENTED = "àáâãäåçèéêëìíîïñòóôõöùúûüýÿāăąćčďēęěğīįńňōőřśşšťūůűźżž"
PLAIN = "aaaaaaceeeeiiiinooooouuuuyyaaaccdeeegiinnoorssstuuuzzz"


def without_accents(text: Column) -> Column:
    """Small letters without their marks, one for one."""
    return F.translate(text, ACCENTED, PLAIN)


def words(text: Column) -> Column:
    """Runs of 2 to 40 letters and digits, in lower case."""
    runs = F.regexp_extract_all(F.lower(text), F.lit(r"([\p{L}\p{N}]+)"), 1)
    return F.filter(runs, lambda w: F.length(w).between(2, 40))


def label(text: Column) -> Column:
    """Folded, with nothing but a-z and 0-9: names that mean the same are equal."""
    return F.regexp_replace(fold(text), "[^a-z0-9]", "")


def keyed_hash(text: Column, key: bytes) -> Column:
    """HMAC-SHA256 in hexadecimal digits."""
    block = key.ljust(64, b"\0")
    inner, outer = (F.lit(bytes(b ^ pad for b in block)) for pad in (0x36, 0x5C))
    return F.sha2(F.concat(outer, F.unhex(F.sha2(F.concat(inner, F.encode(text, "UTF-8")), 256))), 256)


def term_hash(kind: str, value: Column, key: bytes) -> Column:
    """First eight bytes of the keyed hash of kind, NUL and value, as a signed long."""
    return F.conv(F.substring(keyed_hash(F.concat(F.lit(kind + "\0"), value), key), 1, 16), 16, -10).cast("long")


def number_tokens(text: Column) -> Column:
    """Runs of digits with single . , / : - inside."""
    return F.regexp_extract_all(text, F.lit(r"([0-9]+(?:[.,/:-][0-9]+)*)"), 1)


def redact(text: Column) -> Column:
    """Secrets after their names, and e-mail addresses, masked."""
    out = F.regexp_replace(text, r'(?i)(token|password|secret)(\s*[=:]\s*)"?[A-Za-z0-9_-]{8,}"?', "$1$2***")
    return F.regexp_replace(out, r"[A-Za-z0-9._-]+@[A-Za-z0-9.-]+\.[a-z]{2,}", "***")


def html_text(markup: Column) -> Column:
    """Blocks to lines, cells to two blanks, other markup gone, blanks collapsed."""
    out = F.regexp_replace(markup, r"(?is)<(script|style|title)[^>]*>.*?</(script|style|title)>", "")
    out = F.regexp_replace(out, r"(?i)</?(p|div|br|li|ul|h[1-6]|tr|table|article|footer|nav)[^>]*>", "\n")
    out = F.regexp_replace(out, r"(?i)</td[^>]*>", "  ")
    out = F.regexp_replace(out, r"(?s)<[^>]*>", "")
    for name, letter in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&amp;", "&")):
        out = F.replace(out, F.lit(name), F.lit(letter))
    return F.trim(F.regexp_replace(F.regexp_replace(out, r"[ \t]+", " "), r" ?\n[\n ]*", "\n"))


def path_parts(path: Column, levels: int = 10) -> Column:
    """A folder path cut at slashes of either kind, trimmed, at most `levels` deep."""
    parts = F.transform(F.split(F.replace(path, F.lit("\\"), F.lit("/")), "/"), lambda p: F.trim(p))
    return F.slice(F.filter(parts, lambda p: p != ""), 1, levels)


def ip_number(ip: Column) -> Column:
    """A dotted quad as a number, for range comparisons."""
    parts = F.split(ip, r"\.")
    return sum(F.get(parts, i).cast("long") * 256 ** (3 - i) for i in range(4))


def iban_rest(iban: Column) -> Column:
    """Remainder by 97 of the rearranged number, digit by digit (it has up to 68)."""
    moved = F.concat(F.substr(iban, F.lit(5)), F.substring(iban, 1, 4))
    digits = F.transform(F.split(moved, ""), lambda c: F.when(c.rlike("[A-Z]"), (F.ascii(c) - 55).cast("string")).otherwise(c))
    return F.aggregate(F.split(F.array_join(digits, ""), ""), F.lit(0).cast("long"), lambda rest, d: (rest * 10 + F.coalesce(d.try_cast("long"), F.lit(0))) % 97)
