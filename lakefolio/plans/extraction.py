"""Facts extracted from documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import extract as E
from ..sources.tables import scan
from .book import query


def _all(pattern: str, group: int = 1, text: str = "text") -> str:
    return f"regexp_extract_all({text}, '{pattern}', {group})"


#: A letter an order, with facts of every kind.
_LETTERS = """letters AS (SELECT o_orderkey AS doc_id, 'Rechnung Nr. ' || (o_orderkey + 100000) || ' vom ' || strftime(o_orderdate, '%d.%m.%Y') || ', Stand ' || strftime(o_orderdate, '%Y-%m-%d')
  || chr(10) || 'Posten 1.' || lpad(CAST(o_custkey % 1000 AS VARCHAR), 3, '0') || ',50' || chr(10) || CASE WHEN o_orderkey % 2 = 0 THEN 'Summe ' ELSE 'Porto ' END || (o_orderkey % 1000) || '.05'
  || chr(10) || 'Seite ' || (o_orderkey % 5) || ' von 3' || chr(10) || 'DE' || lpad(CAST(o_orderkey % 100 AS VARCHAR), 2, '0') || lpad(CAST(o_custkey * 7919 AS VARCHAR), 18, '0') AS text FROM orders)"""


def _letters(spark: SparkSession, folder: str) -> DataFrame:
    key, customer, day = F.col("o_orderkey"), F.col("o_custkey"), F.col("o_orderdate")
    text = F.concat(
        F.lit("Rechnung Nr. "), key + 100000, F.lit(" vom "), F.date_format(day, "dd.MM.yyyy"), F.lit(", Stand "), F.date_format(day, "yyyy-MM-dd"),
        F.lit("\nPosten 1."), F.lpad((customer % 1000).cast("string"), 3, "0"), F.lit(",50\n"), F.when(key % 2 == 0, "Summe ").otherwise("Porto "), key % 1000, F.lit(".05"),
        F.lit("\nSeite "), key % 5, F.lit(" von 3\nDE"), F.lpad((key % 100).cast("string"), 2, "0"), F.lpad((customer * 7919).cast("string"), 18, "0"),
    )
    return scan(spark, folder, "orders").select(key.alias("doc_id"), text.alias("text"))


_ISO = f"""list_transform({_all(E.DATE)}, lambda d: CASE WHEN contains(d, '.') THEN split_part(d, '.', 3) || '-' || lpad(split_part(d, '.', 2), 2, '0') || '-' || lpad(split_part(d, '.', 1), 2, '0') ELSE d END)"""


@query(f"""
WITH {_LETTERS}, f AS (SELECT doc_id, list_filter({_ISO}, lambda d: d >= '1950-01-01' AND TRY_CAST(d AS DATE) IS NOT NULL) AS found FROM letters)
SELECT doc_id, array_to_string(found, ' ') AS dates, list_min(found) AS earliest FROM f WHERE len(found) > 0""")
def found_dates(spark: SparkSession, folder: str) -> DataFrame:
    rows = _letters(spark, folder).select("doc_id", E.dates(F.col("text")).alias("found")).filter(F.size("found") > 0)
    return rows.select("doc_id", F.array_join("found", " ").alias("dates"), F.array_min("found").alias("earliest"))


def _amounts(text: str) -> str:
    plain = "CASE WHEN contains(x, ',') THEN replace(replace(x, '.', ''), ',', '.') ELSE x END"
    return f"list_filter(list_transform({_all(E.AMOUNT, 1, text)}, lambda x: TRY_CAST({plain} AS DECIMAL(18,2))), lambda x: x IS NOT NULL)"


@query(f"""
WITH {_LETTERS}, l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM letters),
  t AS (SELECT doc_id, max(list_max({_amounts("line")})) AS total FROM l WHERE regexp_matches(line, '{E.TOTAL}') GROUP BY 1),
  a AS (SELECT doc_id, {_amounts("text")} AS every FROM letters)
SELECT a.doc_id, len(every) AS n, CAST(coalesce(t.total, list_max(every)) AS DOUBLE) AS total FROM a LEFT JOIN t USING (doc_id) WHERE len(every) > 0""")
def found_amounts(spark: SparkSession, folder: str) -> DataFrame:
    text = F.col("text")
    rows = _letters(spark, folder).select("doc_id", F.size(E.amounts(text)).cast("long").alias("n"), E.total(text).cast("double").alias("total"))
    return rows.filter("n > 0")


@query(f"""
WITH {_LETTERS}, r AS (SELECT doc_id, list_transform({_all(E.REFERENCE, 1)}, lambda x: lower(x)) AS labels, {_all(E.REFERENCE, 2)} AS found FROM letters),
  o AS (SELECT doc_id, labels, found, list_filter(generate_series(1, len(labels)), lambda i: list_position(labels, labels[i]) = i) AS firsts FROM r WHERE len(labels) > 0)
SELECT doc_id, array_to_string(list_transform(firsts[1:10], lambda i: labels[i] || '=' || found[i]), ' ') AS refs FROM o""")
def found_references(spark: SparkSession, folder: str) -> DataFrame:
    rows = _letters(spark, folder).select("doc_id", E.references(F.col("text")).alias("r")).filter(F.size("r") > 0)
    return rows.select("doc_id", F.array_join("r", " ").alias("refs"))


@query(f"""
WITH {_LETTERS}, m AS (SELECT doc_id, list_transform(list_zip({_all(E.PAGE_MARK, 1)}, {_all(E.PAGE_MARK, 2)}), lambda x: [CAST(x[1] AS INTEGER), CAST(x[2] AS INTEGER)]) AS marks FROM letters)
SELECT doc_id, len(list_filter(marks, lambda m: m[1] >= 1 AND m[1] <= m[2] AND m[2] <= 200)) AS n_marks FROM m""")
def found_page_marks(spark: SparkSession, folder: str) -> DataFrame:
    return _letters(spark, folder).select("doc_id", F.size(E.page_marks(F.col("text"))).cast("long").alias("n_marks"))


_VALUE = "CASE WHEN c BETWEEN 'A' AND 'Z' THEN CAST(ascii(c) - 55 AS BIGINT) ELSE CAST(c AS BIGINT) END"


@query(f"""
WITH {_LETTERS}, f AS (SELECT DISTINCT doc_id, replace(unnest({_all(E.IBAN)}), ' ', '') AS iban FROM letters),
  c AS (SELECT doc_id, iban, list_transform(string_split(substring(iban, 5) || substring(iban, 1, 4), ''), lambda c: {_VALUE}) AS v FROM f WHERE length(iban) BETWEEN 15 AND 34)
SELECT doc_id, iban FROM c WHERE list_reduce(v, lambda a, d: (a * (CASE WHEN d > 9 THEN 100 ELSE 10 END) + d) % 97) = 1""")
def found_ibans(spark: SparkSession, folder: str) -> DataFrame:
    return _letters(spark, folder).select("doc_id", F.explode(E.ibans(F.col("text"))).alias("iban"))


# Words that speak for a kind of document.
KINDS = {"contact": ("mail", "phone", "call", "address"), "license": ("licen", "copyright", "permission"), "secret": ("token", "password", "key"), "web": ("http", "www", "click")}


def _starts(words: str, prefixes: tuple[str, ...]) -> str:
    return f"len(list_filter({words}, lambda w: " + " OR ".join(f"starts_with(w, '{p}')" for p in prefixes) + "))"


_HEAD, _BODY = (f"regexp_extract_all(lower({t}), '[\\p{{L}}\\p{{N}}]+')" for t in ("substring(text, 1, 200)", "text"))


@query(f"""
WITH w AS (SELECT doc_id, {_HEAD} AS head, {_BODY} AS body FROM documents),
  s AS ({" UNION ALL ".join(f"SELECT doc_id, '{k}' AS kind, 2 * {_starts('head', p)} + {_starts('body', p)} AS score FROM w" for k, p in KINDS.items())})
SELECT doc_id, kind, score FROM s WHERE score >= 2 QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, kind DESC) = 1""")
def kind_by_keywords(spark: SparkSession, folder: str) -> DataFrame:
    """Words in the head of a document count three times; ties go to the later name."""
    text, runs = F.col("text"), F.lit(r"([\p{L}\p{N}]+)")
    head, body = F.regexp_extract_all(F.lower(F.substring(text, 1, 200)), runs, 1), F.regexp_extract_all(F.lower(text), runs, 1)

    def hits(words, prefixes: tuple[str, ...]):
        return F.size(F.filter(words, lambda w: w.rlike("^(" + "|".join(prefixes) + ")"))).cast("long")

    rows = scan(spark, folder, "documents").select("doc_id", head.alias("head"), body.alias("body"))
    scores = [F.struct((2 * hits(F.col("head"), p) + hits(F.col("body"), p)).alias("score"), F.lit(k).alias("kind")) for k, p in KINDS.items()]
    best = rows.select("doc_id", F.array_max(F.array(*scores)).alias("best"))
    return best.select("doc_id", "best.kind", "best.score").filter("score >= 2")
