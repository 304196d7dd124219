"""Queries by the posting index, known senders and close names."""

from __future__ import annotations

from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import dates, letters, snippets
from ..functions import text as T
from ..operators import closeness, postings, search, senders
from ..operators.settled import shared_folder
from ..sources.tables import scan, spread
from .book import query
from .content import KEY, _folded

QUERY = "Licen en"
#: Documents of this source are replaced after the index was written.
REPLACED = "src3"


def fields(docs: DataFrame) -> DataFrame:
    """Documents as (doc_id, title, content, meta): the first line, the text, language and source."""
    return docs.select("doc_id", F.substring_index("text", "\n", 1).alias("title"), F.col("text").alias("content"), F.concat_ws(" ", "lang", "source").alias("meta"))


def _words(column: str) -> str:
    return rf"list_filter(regexp_extract_all(lower({column}), '[\p{{L}}\p{{N}}]+'), lambda w: length(w) BETWEEN 2 AND 40)"


def _indexed_sql(query: str, docs: str) -> str:
    """The ranking by its definition, over all words of all documents."""
    common = ", ".join(f"'{w}'" for w in T.COMMON_WORDS)
    plain = f"word NOT IN ({common}) AND folded NOT IN ({common}) AND NOT regexp_full_match(folded, '[0-9]+')"
    hits = []
    for i, q in enumerate(postings.query_words(query)):
        hits.append(f"SELECT *, {i} AS qi, 1.0 AS wt FROM w WHERE folded = '{q}'")
        hits.append(f"SELECT *, {i}, 0.5 FROM w WHERE starts_with(folded, '{q}') AND length(folded) > {len(q)} AND {3 <= len(q) <= 15} AND {plain}")
        hits.append(f"SELECT *, {i}, 0.7 FROM w WHERE ends_with(folded, '{q}') AND length(folded) >= {max(8, len(q) + 3)} AND {len(q) >= 4} AND {plain}")
    return f"""
WITH d AS ({docs}),
  f AS (SELECT doc_id, 'title' AS field, 2.0 AS fw, split_part(text, chr(10), 1) AS t FROM d UNION ALL SELECT doc_id, 'content', 1.0, text FROM d
    UNION ALL SELECT doc_id, 'meta', 1.5, concat_ws(' ', lang, source) FROM d),
  e AS (SELECT doc_id, field, fw, unnest({_words("t")}) AS word FROM f),
  w AS (SELECT doc_id, field, fw, word, {_folded("word")} AS folded, count(*) AS tf FROM e GROUP BY ALL),
  l AS (SELECT d.doc_id, greatest(coalesce(n, 1), 1) AS length FROM d LEFT JOIN (SELECT doc_id, sum(tf) AS n FROM w WHERE field <> 'meta' GROUP BY 1) USING (doc_id)),
  s AS (SELECT count(*) AS n, avg(length) AS avglen FROM l),
  h AS (SELECT doc_id, field, fw, qi, wt, least(sum(tf), 32767) AS tf FROM ({" UNION ALL ".join(hits)}) GROUP BY ALL),
  m AS (SELECT doc_id, qi, max(wt * fw * tf * {search.K1 + 1} / (tf + {search.K1} * (1 - {search.B} + {search.B} * length / avglen))) AS s FROM h JOIN l USING (doc_id), s GROUP BY 1, 2),
  df AS (SELECT qi, count(*) AS df FROM m GROUP BY 1),
  r AS (SELECT doc_id, round(sum(m.s * ln(1 + (n - df + 0.5) / (df + 0.5))), 6) AS score FROM m JOIN df USING (qi), s GROUP BY 1 HAVING count(*) = {len(postings.query_words(query))})
SELECT doc_id, score, (SELECT count(*) FROM r) AS total FROM r ORDER BY score DESC, doc_id DESC LIMIT 50"""


def _folder(spark: SparkSession) -> str:
    return f"{shared_folder(spark).rstrip('/')}/{uuid4().hex}"


@query(_indexed_sql(QUERY, "SELECT doc_id, text, lang, source FROM documents"))
def search_indexed(spark: SparkSession, folder: str) -> DataFrame:
    """An index of words, prefixes and tails of all documents, and a query of it."""
    index = _folder(spark)
    postings.write(fields(scan(spark, folder, "documents")), index, KEY, kinds="WPX")
    return postings.search(spark, index, QUERY, KEY, kinds="WPX")


@query(_indexed_sql(QUERY, f"SELECT doc_id, CASE WHEN source = '{REPLACED}' THEN 'Licence renewed' || chr(10) || text ELSE text END AS text, lang, source FROM documents WHERE lang <> 'fr'"))
def search_replaced(spark: SparkSession, folder: str) -> DataFrame:
    """The same after one source's documents were replaced and one language's taken out."""
    docs, index = scan(spark, folder, "documents"), _folder(spark)
    postings.write(fields(docs), index, KEY, kinds="WPX")
    changed = docs.filter(F.col("source") == REPLACED).withColumn("text", F.concat(F.lit("Licence renewed\n"), "text"))
    postings.write(fields(changed), index, KEY, version=1, kinds="WPX")
    postings.remove(docs.filter("lang = 'fr'"), index, version=2)
    return postings.search(spark, index, QUERY, KEY, kinds="WPX")


@query()
def search_stemmed(spark: SparkSession, folder: str) -> DataFrame:
    """With stems, too: "licenses" finds "Licensed" and "license". A test has the brute force."""
    index = _folder(spark)
    postings.write(fields(scan(spark, folder, "documents")), index, KEY)
    return postings.search(spark, index, "licenses versions", KEY)


@query()
def signature_stems(spark: SparkSession, folder: str) -> DataFrame:
    """The 300 most frequent stems of every document. A test has the brute force."""
    return postings.signatures(fields(scan(spark, folder, "documents")))


def _spaced(column: str) -> str:
    return f"' ' || array_to_string(list_transform({_words(column)}, lambda w: {_folded('w')}), ' ') || ' '"


@query(f"""
WITH n AS (SELECT min(doc_id) AS entry, name FROM (SELECT doc_id, regexp_extract(text, '^\\s*(\\S+\\s+\\S+)', 1) AS name FROM documents) WHERE name <> '' GROUP BY name),
  k AS (SELECT entry, name, {_spaced("name")} AS needle FROM n),
  d AS (SELECT doc_id, {_spaced("array_to_string(list_slice(string_split(text, chr(10)), 1, 25), chr(10))")} AS header, {_spaced("text")} AS body FROM documents WHERE text IS NOT NULL),
  h AS (SELECT doc_id, entry, name, CASE WHEN contains(header, needle) THEN 3 ELSE 1 END AS score FROM d, k WHERE length(trim(needle)) >= 3 AND contains(body, needle))
SELECT doc_id, entry, name, score FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, length(name) DESC, entry, name) AS place FROM h) WHERE place = 1""")
def known_senders(spark: SparkSession, folder: str) -> DataFrame:
    """Who wrote a document: the first two words of all documents are the known
    names, and each document is searched for all of them."""
    docs = scan(spark, folder, "documents").select("doc_id", "text")
    names = docs.select("doc_id", F.regexp_extract("text", r"^\s*(\S+\s+\S+)", 1).alias("name")).filter("name <> ''")
    return senders.known_names(docs, names.groupBy("name").agg(F.min("doc_id").alias("entry")))


@query()
def close_labels(spark: SparkSession, folder: str) -> DataFrame:
    """First words of documents that are nearly equal. A test has the brute force."""
    label = T.label(F.regexp_extract("text", r"^\s*(\S+\s+\S+\s+\S+)", 1))
    labels = scan(spark, folder, "documents").select(label.alias("label"))
    return closeness.close(labels, labels, 88).filter("label < other")


NEEDLES = [["licens"], ["uebe", "ueb"], ["mitg"]]


def _spelled_sql(column: str, marks: bool) -> str:
    out = f"lower(translate({column}, 'İ' || chr(2), 'i '))"
    for letter, spelled in snippets.SPELLED.items():
        out = f"replace({out}, '{letter}', '{spelled[0]}' || repeat(chr(2), {len(spelled) - 1}))" if marks else f"replace({out}, '{letter}', '{spelled}')"
    return out


def _first_sql() -> str:
    words = [f"coalesce({', '.join(f"nullif(strpos(f, '{n}'), 0)" for n in some)})" for some in NEEDLES]
    return f"list_min(list_filter([{', '.join(words)}], lambda p: p IS NOT NULL))"


@query(f"""
WITH f AS (SELECT doc_id, text, {_spelled_sql("text", False)} AS f, {_spelled_sql("text", True)} AS m FROM documents WHERE text IS NOT NULL),
  p AS (SELECT doc_id, text, m, {_first_sql()} AS p FROM f),
  h AS (SELECT doc_id, text, p - len(list_filter(string_split(substring(m, 1, p), ''), lambda c: c = chr(2))) AS hit FROM p WHERE p IS NOT NULL),
  w AS (SELECT doc_id, text, hit, greatest(hit - 90, 1) AS start FROM h),
  r AS (SELECT *, substring(text, start, hit - start + 180) AS raw FROM w)
SELECT doc_id, CAST(hit AS INTEGER) AS hit, CASE WHEN start > 1 THEN '… ' ELSE '' END || trim(regexp_replace(raw, '[ \t\n\x0B\f\r ]+', ' ', 'g')) || CASE WHEN start + length(raw) - 1 < length(text) THEN ' …' ELSE '' END AS shown FROM r""")
def snippets_folded(spark: SparkSession, folder: str) -> DataFrame:
    """Excerpts around the first hit of any of three folded words, as the text has them."""
    text = F.col("text")
    rows = snippets.hits(scan(spark, folder, "documents").select("doc_id", "text"), "text", NEEDLES, "hit")
    return rows.withColumn("w", snippets.window(text, F.col("hit"))).select("doc_id", F.col("hit").cast("int").alias("hit"), snippets.shown(text, F.col("w")).alias("shown"))


#: The day on which letters are read.
TODAY = "2002-01-01"
_MONTH_NAMES = ("Januar", "February", "März", "April", "Mai", "June", "Juli", "Aug.", "Sept.", "Oktober", "November", "Dez.")
#: Dates in every form, with words near them for and against, from an order's columns.
_SAID = (
    ("'Zeitraum ' || strftime(o_orderdate - INTERVAL 40 DAY, '%d.%m.%y') || ' bis ' || strftime(o_orderdate - INTERVAL 10 DAY, '%d/%m/%Y')", 7),
    ("'Hamburg, im ' || mon || ' ' || strftime(o_orderdate, '%Y')", 5),
    ("'Stand: ' || strftime(o_orderdate, '%Y-%m-%d')", 3),
    ("'Ihr Schreiben vom ' || day(o_orderdate) || '. ' || mon || ' ' || strftime(o_orderdate, '%Y')", 4),
    ("'due ' || mon || ' ' || day(o_orderdate) || ', ' || (year(o_orderdate) + 1)", 2),
    ("'31.02.' || strftime(o_orderdate, '%Y')", 6),
)


def _date_forms_sql() -> str:
    """(doc_id, pos, day, whole, stop) of all matches, by places of split and found parts."""
    of = {"month": "map_extract(months, lower({}))[1]", "plain": "CAST({} AS INTEGER)"}
    union = []
    for form, (pattern, y, m, d) in dates.FORMS.items():
        pattern = pattern.replace("(?<![0-9A-Za-z_])", r"\b").replace(r"(?<![\p{L}0-9_])", r"\b").replace("(?![0-9A-Za-z_])", r"\b")
        part = lambda n: f"regexp_extract(hit, '{pattern}', {n})"
        month = of["month" if "month" in form else "plain"].format(part(m))
        year = f"CASE WHEN length({part(y)}) > 2 THEN CAST({part(y)} AS INTEGER) WHEN CAST({part(y)} AS INTEGER) < 70 THEN 2000 + CAST({part(y)} AS INTEGER) ELSE 1900 + CAST({part(y)} AS INTEGER) END"
        whole = f"TRY_CAST(format('{{:04d}}-{{:02d}}-{{:02d}}', {year}, {month}, {f'CAST({part(d)} AS INTEGER)' if d else '1'}) AS DATE)"
        places = f"list_sum(list_transform(parts[:i], lambda x: length(x))) + coalesce(list_sum(list_transform(hits[:i - 1], lambda x: length(x))), 0)"
        union.append(f"""SELECT doc_id, CAST({places} AS INTEGER) AS pos, {whole} AS day, {d > 0} AS whole, CAST({places} AS INTEGER) + length(hit) AS stop FROM (SELECT doc_id, parts, hits, i, hits[i] AS hit, months FROM
  (SELECT doc_id, string_split_regex(text, '{pattern}') AS parts, regexp_extract_all(text, '{pattern}') AS hits, months, unnest(generate_series(1, len(regexp_extract_all(text, '{pattern}')))) AS i FROM letters, names))""")
    return " UNION ALL ".join(union)


_MONTHS_SQL = "MAP {" + ", ".join(f"'{k}': {v}" for k, v in dates.MONTHS.items()) + "}"
_LINES_SQL = ", ".join(f"CASE WHEN o_orderkey % {n} = 0 THEN {line} END" for line, n in _SAID)
_LETTERS_SQL = f"""names AS (SELECT {_MONTHS_SQL} AS months), letters AS (SELECT o_orderkey AS doc_id, concat_ws(chr(10), 'Bestellung ' || o_custkey, {_LINES_SQL}, repeat('Text ', 20)) AS text
  FROM (SELECT *, ['{"', '".join(_MONTH_NAMES)}'][month(o_orderdate)] AS mon FROM orders))"""


def _date_letters(spark: SparkSession, folder: str) -> DataFrame:
    day, key = F.col("o_orderdate"), F.col("o_orderkey")
    mon, year, number = F.element_at(F.array(*map(F.lit, _MONTH_NAMES)), F.month(day)), F.date_format(day, "yyyy"), F.dayofmonth(day)
    lines = (
        F.concat(F.lit("Zeitraum "), F.date_format(F.date_sub(day, 40), "dd.MM.yy"), F.lit(" bis "), F.date_format(F.date_sub(day, 10), "dd/MM/yyyy")), F.concat(F.lit("Hamburg, im "), mon, F.lit(" "), year),
        F.concat(F.lit("Stand: "), F.date_format(day, "yyyy-MM-dd")), F.concat(F.lit("Ihr Schreiben vom "), number, F.lit(". "), mon, F.lit(" "), year),
        F.concat(F.lit("due "), mon, F.lit(" "), number, F.lit(", "), F.year(day) + 1), F.concat(F.lit("31.02."), year),
    )
    said = [F.when(key % n == 0, line) for line, (_, n) in zip(lines, _SAID)]
    return spread(scan(spark, folder, "orders")).select(key.alias("doc_id"), F.concat_ws("\n", F.concat(F.lit("Bestellung "), "o_custkey"), *said, F.repeat(F.lit("Text "), 20)).alias("text"))


@query(f"""
WITH {_LETTERS_SQL}, f AS ({_date_forms_sql()}),
  ok AS (SELECT * FROM f WHERE day BETWEEN DATE '1950-01-01' AND DATE '{TODAY}' + 400),
  d AS (SELECT * FROM ok WHERE whole OR NOT EXISTS (SELECT 1 FROM ok o WHERE o.doc_id = ok.doc_id AND o.whole AND o.pos <= ok.pos AND ok.pos < o.stop)),
  c AS (SELECT doc_id, pos, day, whole, length(text) AS n, substring(text, greatest(pos - 40, 0) + 1, least(pos, 40)) AS before, list_last(string_split(substring(text, 1, pos), chr(10))) AS lead,
    list_last(string_split(substring(text, 1, pos), chr(10))) || split_part(substring(text, pos + 1), chr(10), 1) AS line FROM d JOIN letters USING (doc_id)),
  s AS (SELECT doc_id, pos, day, 3.0 * CAST(regexp_matches(before, '{dates.HINTS}') OR regexp_matches(line, '{dates.HINTS}') AS INTEGER) - CAST(regexp_matches(before, '{dates.PERIODS}') AS INTEGER)
    - 2 * CAST(regexp_matches(before, '{dates.OTHER_DAYS}') AS INTEGER) - CAST(regexp_matches(before, '{dates.BOUNDS}') AS INTEGER) + 2 * CAST(pos < n * 0.25 AS INTEGER)
    + 2 * CAST(regexp_matches(lead, '{dates.PLACE}') AS INTEGER) - 1.5 * CAST(NOT whole AS INTEGER) - 3 * CAST(day > DATE '{TODAY}' + 30 AS INTEGER) - pos / n AS score FROM c)
SELECT doc_id, count(*) AS n_dates, max_by(day, {{'score': score, 'first': -pos, 'day': day}}) AS document_date FROM s GROUP BY 1""")
def document_dates(spark: SparkSession, folder: str) -> DataFrame:
    """Letters made of orders' columns: all their dates, and the one that is the letter's own."""
    text, today = F.col("text"), F.lit(TODAY).cast("date")
    # exploded, so that the filter below is not put before what it is about, which would then be worked out twice
    rows = _date_letters(spark, folder).select("doc_id", "text", F.explode(F.array(dates.dates(text, today))).alias("found")).filter(F.size("found") > 0)
    return rows.select("doc_id", F.size("found").cast("long").alias("n_dates"), dates.document_date(text, F.col("found"), today).alias("document_date"))


_HEADS = ("'Stadtwerke Nr. ' || c_nationkey || ' GmbH · Weg ' || o_orderkey || ' · ' || (10000 + c_custkey) || ' Köln'", "'An ' || c_name", "'Finanzamt ' || c_mktsegment || '   Zimmer ' || c_nationkey", "'  Amtsgericht  ' || c_nationkey")
_TAILS = ("'Betreff:  ' || c_mktsegment || '   vom ' || o_orderkey", "'Rechnung über ' || o_orderpriority", "'Rechnungswesen ' || o_orderkey", "'Re: ' || c_name")
_MAIL_SQL = f"""m AS (SELECT o_orderkey AS doc_id, ({_HEADS[0]}) AS h0, ({_HEADS[1]}) AS h1, ({_HEADS[2]}) AS h2, ({_HEADS[3]}) AS h3, ({_TAILS[0]}) AS t0, ({_TAILS[1]}) AS t1, ({_TAILS[2]}) AS t2, ({_TAILS[3]}) AS t3 FROM orders JOIN customer ON o_custkey = c_custkey),
  l AS (SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN h0 WHEN 1 THEN h1 WHEN 2 THEN h2 ELSE h3 END || chr(10) || 'x' || chr(10) || CASE doc_id // 4 % 4 WHEN 0 THEN t0 WHEN 1 THEN t1 WHEN 2 THEN t2 ELSE t3 END || chr(10) || 'Ende' AS text FROM m)"""


def _mail(spark: SparkSession, folder: str) -> DataFrame:
    """Letters of an order and its customer, with four kinds of heads and of subjects."""
    rows = scan(spark, folder, "orders").join(scan(spark, folder, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    heads = (
        F.concat(F.lit("Stadtwerke Nr. "), "c_nationkey", F.lit(" GmbH · Weg "), "o_orderkey", F.lit(" · "), F.col("c_custkey") + 10000, F.lit(" Köln")), F.concat(F.lit("An "), "c_name"),
        F.concat(F.lit("Finanzamt "), "c_mktsegment", F.lit("   Zimmer "), "c_nationkey"), F.concat(F.lit("  Amtsgericht  "), "c_nationkey"),
    )
    tails = (F.concat(F.lit("Betreff:  "), "c_mktsegment", F.lit("   vom "), "o_orderkey"), F.concat(F.lit("Rechnung über "), "o_orderpriority"), F.concat(F.lit("Rechnungswesen "), "o_orderkey"), F.concat(F.lit("Re: "), "c_name"))
    key = F.col("o_orderkey")
    of = lambda some, n: F.get(F.array(*some), (n % 4).cast("int"))
    return rows.select(key.alias("doc_id"), F.concat_ws("\n", of(heads, key), F.lit("x"), of(tails, F.floor(key / 4)), F.lit("Ende")).alias("text"))


_LINES = "list_filter(list_transform(string_split(text, chr(10)), lambda x: regexp_replace(x, '^\\s+|\\s+$', '', 'g')), lambda x: x <> '')"
_PART = f"regexp_replace(string_split_regex(x, '{letters.PARTED}')[1], '^[ ,]+|[ ,]+$', '', 'g')"


@query(f"""
WITH {_MAIL_SQL}, s AS (SELECT doc_id, text, {_LINES} AS ls FROM l),
  f AS (SELECT doc_id,
    list_filter(list_transform(list_filter(ls[1:30], lambda x: regexp_matches(x, '{letters.POSTCODE}') AND regexp_matches(x, '{letters.PARTED}')), lambda x: {_PART}), lambda x: length(x) BETWEEN 3 AND 80 AND NOT regexp_matches(x, '^[0-9]')) AS address,
    list_filter(list_transform(list_filter(ls[1:20], lambda x: length(x) <= 90 AND (regexp_matches(x, '{letters.ORGANISATION}') OR regexp_matches(x, '{letters.COMPOUND}'))), lambda x: {_PART}), lambda x: length(x) >= 3 AND NOT regexp_matches(x, '[0-9]{{5}}')) AS named,
    nullif(regexp_extract(text, '{letters.SUBJECT}', 2), '') AS said, list_filter(ls[1:40], lambda x: length(x) BETWEEN 6 AND 90 AND regexp_matches(x, '{letters.KIND}')) AS kinds FROM s)
SELECT doc_id, coalesce(address[1], named[1]) AS sender, substring(trim(regexp_replace(coalesce(said, kinds[1]), '\\s+', ' ', 'g')), 1, 120) AS subject FROM f""")
def letter_heads(spark: SparkSession, folder: str) -> DataFrame:
    """Senders and subjects by rules."""
    return _mail(spark, folder).select("doc_id", letters.sender(F.col("text")).alias("sender"), letters.subject(F.col("text")).alias("subject"))
