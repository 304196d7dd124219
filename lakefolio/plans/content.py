"""Queries over documents and pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import bayes, joins, search
from ..sources.tables import scan
from .book import query

KEY = b"archive search key"
_WORDS = r"list_filter(regexp_extract_all(lower(text), '[\p{L}\p{N}]+'), lambda w: length(w) BETWEEN 2 AND 40)"
_STOP = "(" + ", ".join(f"'{w}'" for w in T.STOP_WORDS) + ")"


def _bm25_sql(words: list[str], where: str) -> str:
    """The definition of the ranking, with matches counted by list filters."""
    counts, hits, best = [], [], []
    for i, q in enumerate(words):
        kinds = {
            "W": f"w = '{q}'",
            "X": f"ends_with(w, '{q}') AND length(w) >= {max(8, len(q) + 3)}",
            "P": f"starts_with(w, '{q}') AND length(w) > {len(q)}",
        }
        kinds = {k: v for k, v in kinds.items() if k == "W" or (k == "X" and len(q) >= 4) or (k == "P" and 3 <= len(q) <= 15)}
        counts += [f"len(list_filter(words, lambda w: {test})) AS {k}{i}" for k, test in kinds.items()]
        hits.append("(" + " OR ".join(f"{k}{i} > 0" for k in kinds) + ")")
        tf = [f"{search.WEIGHTS[k]} * {k}{i} * {search.K1 + 1} / ({k}{i} + {search.K1} * (1 - {search.B} + {search.B} * len / avglen))" for k in kinds]
        best.append(f"greatest(0, {', '.join(tf)}) * ln(1 + (n - df{i} + 0.5) / (df{i} + 0.5))")
    dfs = ", ".join(f"count(*) FILTER (candidate AND {h}) AS df{i}" for i, h in enumerate(hits))
    return f"""
WITH d AS (SELECT doc_id, {_WORDS} AS words, {where} AS candidate FROM documents),
  c AS (SELECT doc_id, candidate, greatest(len(words), 1) AS len, {", ".join(counts)} FROM d),
  s AS (SELECT count(*) AS n, avg(len) AS avglen, {dfs} FROM c),
  f AS (SELECT doc_id, round({" + ".join(best)}, 6) AS score FROM c, s WHERE candidate AND {" AND ".join(hits)})
SELECT doc_id, score, (SELECT count(*) FROM f) AS total FROM f ORDER BY score DESC, doc_id DESC LIMIT 50"""


@query(_bm25_sql(["tion", "ering"], "true"))
def search_bm25(spark: SparkSession, folder: str) -> DataFrame:
    return search.search(scan(spark, folder, "documents"), ["tion", "ering"])


@query(_bm25_sql(["schein", "be"], "lang = 'de'"))
def search_filtered(spark: SparkSession, folder: str) -> DataFrame:
    return search.search(scan(spark, folder, "documents"), ["schein", "be"], F.col("lang") == "de")


def _folded(column: str) -> str:
    for letter, spelled in T.FOLDS.items():
        column = f"replace({column}, '{letter}', '{spelled}')"
    return column


@query(f"""
WITH w AS (SELECT doc_id, w, count(*) AS tf FROM (SELECT doc_id, unnest({_WORDS}) AS w FROM documents) GROUP BY 1, 2),
  t AS (SELECT doc_id, 'W' AS kind, {_folded("w")} AS term, tf FROM w
    UNION ALL SELECT doc_id, 'P', substring(w, 1, CAST(i AS BIGINT)), tf FROM (SELECT doc_id, w, tf, unnest(generate_series(3, least(15, length(w) - 1))) AS i FROM w WHERE length(w) > 3 AND w NOT IN {_STOP} AND NOT regexp_full_match(w, '[0-9]+'))
    UNION ALL SELECT doc_id, 'X', substring(w, CAST(i AS BIGINT)), tf FROM (SELECT doc_id, w, tf, unnest(generate_series(4, length(w) - 3)) AS i FROM w WHERE length(w) >= 8 AND w NOT IN {_STOP} AND NOT regexp_full_match(w, '[0-9]+')))
SELECT kind, term, count(DISTINCT doc_id) AS df, CAST(sum(tf) AS BIGINT) AS cf FROM t GROUP BY 1, 2""")
def term_stats(spark: SparkSession, folder: str) -> DataFrame:
    return search.term_frequencies(scan(spark, folder, "documents"))


def _hmac_sql(message: str) -> str:
    block = KEY.ljust(64, b"\0")
    inner, outer = (bytes(b ^ pad for b in block).hex() for pad in (0x36, 0x5C))
    return f"sha256(unhex('{outer}' || sha256(unhex('{inner}' || hex({message})))))"


@query(f"""
WITH w AS (SELECT DISTINCT doc_id, {_folded("w")} AS term FROM (SELECT doc_id, unnest({_WORDS}) AS w FROM documents))
SELECT doc_id, {_hmac_sql("encode('W' || chr(0) || term)")} AS hash FROM w""")
def blind_postings(spark: SparkSession, folder: str) -> DataFrame:
    words = scan(spark, folder, "documents").select("doc_id", F.explode(F.array_distinct(F.transform(T.words("text"), T.fold))).alias("term"))
    return words.select("doc_id", T.keyed_hash(F.concat(F.lit("W\0"), "term"), KEY).alias("hash"))


@query(f"""
WITH c AS (SELECT doc_id, w AS term, count(*) AS tf FROM (SELECT doc_id, unnest({_WORDS}) AS w FROM documents) WHERE w NOT IN {_STOP} GROUP BY 1, 2)
SELECT * FROM (SELECT doc_id, term, tf, row_number() OVER (PARTITION BY doc_id ORDER BY tf DESC, term) AS place FROM c) WHERE place <= 300""")
def signature_top(spark: SparkSession, folder: str) -> DataFrame:
    return search.signature(scan(spark, folder, "documents"))


@query("""
SELECT doc_id, CAST(strpos(lower(text), 'license') AS INTEGER) AS place,
  replace(substring(text, greatest(strpos(lower(text), 'license') - 30, 1), 67), chr(10), ' ') AS snippet FROM documents WHERE strpos(lower(text), 'license') > 0""")
def snippets(spark: SparkSession, folder: str) -> DataFrame:
    return search.snippet(scan(spark, folder, "documents"), "license")


@query("SELECT md5(text) AS digest, min(doc_id) AS kept, count(*) - 1 AS dropped FROM documents GROUP BY text HAVING count(*) > 1")
def exact_dedupe(spark: SparkSession, folder: str) -> DataFrame:
    copies = scan(spark, folder, "documents").groupBy(F.md5("text").alias("digest")).agg(F.min("doc_id").alias("kept"), (F.count("*") - 1).alias("dropped"))
    return copies.filter("dropped > 0")


@query(f"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents), b AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
  dg AS (SELECT DISTINCT doc_id, array_to_string(list_slice(w, CAST(i AS BIGINT), CAST(i AS BIGINT) + 7), ' ') AS gram FROM (SELECT doc_id, w, unnest(generate_series(1, len(w) - 7)) AS i FROM d WHERE len(w) >= 8)),
  bg AS (SELECT DISTINCT item_id, array_to_string(list_slice(w, CAST(i AS BIGINT), CAST(i AS BIGINT) + 7), ' ') AS gram FROM (SELECT item_id, w, unnest(generate_series(1, len(w) - 7)) AS i FROM b WHERE len(w) >= 8))
SELECT doc_id, item_id, count(*) AS shared FROM dg JOIN bg USING (gram) GROUP BY 1, 2""")
def benchmark_overlap(spark: SparkSession, folder: str) -> DataFrame:
    return joins.contained_passages(scan(spark, folder, "documents"), scan(spark, folder, "benchmark"))


def _labels(spark: SparkSession, folder: str) -> DataFrame:
    return scan(spark, folder, "labels").select("doc_id", F.col("quality").alias("label"))


_FEATURES = f"f AS (SELECT DISTINCT doc_id, w FROM (SELECT doc_id, unnest({_WORDS}) AS w FROM documents))"


@query(f"WITH {_FEATURES} SELECT quality AS class, w AS word, count(*) AS n FROM f JOIN labels USING (doc_id) GROUP BY 1, 2")
def nb_train(spark: SparkSession, folder: str) -> DataFrame:
    return bayes.fit(scan(spark, folder, "documents"), _labels(spark, folder))[0]


@query(f"""
WITH {_FEATURES}, c AS (SELECT quality AS class, w, count(*) AS n FROM f JOIN labels USING (doc_id) GROUP BY 1, 2),
  k AS (SELECT quality AS class, count(*) AS docs FROM labels GROUP BY 1 HAVING count(*) >= 2),
  s AS (SELECT class, docs / sum(docs) OVER () AS share, (SELECT sum(n) FROM c WHERE c.class = k.class) AS tokens, (SELECT count(DISTINCT w) FROM c) AS v FROM k),
  p AS (SELECT doc_id, s.class, ln(any_value(share)) + sum(ln((coalesce(c.n, 0) + 0.5) / (tokens + 0.5 * (v + 1)))) AS score
        FROM f CROSS JOIN s LEFT JOIN c ON c.w = f.w AND c.class = s.class GROUP BY 1, 2)
SELECT doc_id, max_by(class, score) AS class, round(max(score), 4) AS score FROM p GROUP BY 1""")
def nb_predict(spark: SparkSession, folder: str) -> DataFrame:
    docs = scan(spark, folder, "documents")
    return bayes.predict(docs, *bayes.fit(docs, _labels(spark, folder)))


@query(r"""
SELECT doc_id, md5(regexp_replace(regexp_replace(text, '(?i)(token|password|secret)(\s*[=:]\s*)"?[A-Za-z0-9_-]{8,}"?', '\1\2***', 'g'), '[A-Za-z0-9._-]+@[A-Za-z0-9.-]+\.[a-z]{2,}', '***', 'g')) AS digest FROM documents""")
def redact_tokens(spark: SparkSession, folder: str) -> DataFrame:
    return scan(spark, folder, "documents").select("doc_id", F.md5(T.redact(F.col("text"))).alias("digest"))


@query(r"""
SELECT doc_id, array_to_string(regexp_extract_all(text, '[0-9]+(?:[.,/:-][0-9]+)*'), ' ') AS numbers FROM documents WHERE regexp_matches(text, '[0-9]')""")
def number_tokens(spark: SparkSession, folder: str) -> DataFrame:
    docs = scan(spark, folder, "documents").filter(F.col("text").rlike("[0-9]"))
    return docs.select("doc_id", F.array_join(T.number_tokens(F.col("text")), " ").alias("numbers"))


@query(r"""
SELECT doc_id, length(trim(text)) < 40 AS unread, NOT regexp_matches(text, '[0-9]{4}') AS no_year, NOT contains(text, '@') AS no_sender FROM documents""")
def missing_info(spark: SparkSession, folder: str) -> DataFrame:
    text = F.col("text")
    return scan(spark, folder, "documents").select("doc_id", (F.length(F.trim(text)) < 40).alias("unread"), (~text.rlike("[0-9]{4}")).alias("no_year"), (~text.contains("@")).alias("no_sender"))


@query(r"""
WITH i AS (SELECT DISTINCT doc_id, unnest(regexp_extract_all(text, '\b[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\b')) AS ip FROM documents),
  n AS (SELECT doc_id, ip, list_aggregate(list_transform(string_split(ip, '.'), lambda x, k: CAST(x AS BIGINT) * CAST(pow(256, 4 - k) AS BIGINT)), 'sum') AS number FROM i)
SELECT doc_id, ip, number BETWEEN 0 AND 1073741823 OR number BETWEEN 3221225472 AND 3238002687 AS allowed FROM n""")
def ip_allow_list(spark: SparkSession, folder: str) -> DataFrame:
    found = F.regexp_extract_all("text", F.lit(r"\b([0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3})\b"), 1)
    rows = scan(spark, folder, "documents").select("doc_id", F.explode(F.array_distinct(found)).alias("ip"))
    return joins.in_ranges(rows, "ip", [("0.0.0.0", 2), ("192.0.0.0", 8)])


@query(f"""
WITH d AS (SELECT doc_id, list_distinct({_WORDS}) AS w FROM documents), p AS (SELECT a.doc_id, a.w AS x, b.w AS y FROM d a JOIN d b ON b.doc_id = a.doc_id + 1),
  c AS (SELECT doc_id, len(list_intersect(x, y)) AS shared, len(x) AS nx, len(y) AS ny FROM p)
SELECT doc_id, CAST(shared AS INTEGER) AS shared, round(CASE WHEN nx + ny > shared THEN shared / (nx + ny - shared) ELSE 0 END, 6) AS jaccard FROM c""")
def neighbour_jaccard(spark: SparkSession, folder: str) -> DataFrame:
    words = scan(spark, folder, "documents").select("doc_id", F.array_distinct(T.words(F.col("text"))).alias("w"))
    pairs = words.alias("a").join(words.alias("b"), F.expr("b.doc_id = a.doc_id + 1"))
    shared, whole = F.size(F.array_intersect("a.w", "b.w")), F.size("a.w") + F.size("b.w")
    return pairs.select("a.doc_id", shared.alias("shared"), F.round(F.when(whole > shared, shared / (whole - shared)).otherwise(0.0), 6).alias("jaccard"))


@query(r"""
WITH a AS (SELECT page_id, regexp_replace(html, '(?is)<(script|style|title)[^>]*>.*?</(script|style|title)>', '', 'g') AS t FROM pages),
  b AS (SELECT page_id, regexp_replace(t, '(?i)</?(p|div|br|li|ul|h[1-6]|tr|table|article|footer|nav)[^>]*>', chr(10), 'g') AS t FROM a),
  c AS (SELECT page_id, regexp_replace(regexp_replace(t, '(?i)</td[^>]*>', '  ', 'g'), '(?s)<[^>]*>', '', 'g') AS t FROM b),
  d AS (SELECT page_id, replace(replace(replace(replace(t, '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&amp;', '&') AS t FROM c)
SELECT page_id, md5(trim(regexp_replace(regexp_replace(t, '[ \t]+', ' ', 'g'), ' ?\n[\n ]*', chr(10), 'g'), ' ')) AS digest FROM d""")
def html_text(spark: SparkSession, folder: str) -> DataFrame:
    return scan(spark, folder, "pages").select("page_id", F.md5(T.html_text(F.col("html"))).alias("digest"))


@query(r"""
SELECT page_id, array_to_string(list_slice(list_filter(list_transform(string_split(url, '/'), lambda p: trim(p)), lambda p: p <> ''), 1, 10), ' / ') AS path FROM pages""")
def folder_paths_from_text(spark: SparkSession, folder: str) -> DataFrame:
    return scan(spark, folder, "pages").select("page_id", F.array_join(T.path_parts(F.col("url")), " / ").alias("path"))
