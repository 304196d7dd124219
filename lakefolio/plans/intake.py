"""Scan sessions, rules and names, on the structured tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import labels, matching
from ..sources import files
from ..sources.tables import scan
from .book import ORACLE_SQL, query
from .content import KEY, _folded, _hmac_sql


@query(f"""
WITH p AS (SELECT l_suppkey, l_linenumber AS position, md5(CAST(l_orderkey AS VARCHAR)) AS digest, row_number() OVER (PARTITION BY l_suppkey, l_linenumber ORDER BY l_shipdate DESC, md5(CAST(l_orderkey AS VARCHAR)) DESC) AS place FROM lineitem WHERE l_partkey % 17 = 0),
  s AS (SELECT l_suppkey, count(*) AS parts, list(position) AS seen, max(position) AS high, 'scan parts|' || string_agg('pdf:' || digest, '|' ORDER BY position) AS message FROM p WHERE place = 1 GROUP BY 1)
SELECT l_suppkey, parts, array_to_string(list_filter(generate_series(1, high), lambda x: NOT list_contains(seen, x)), ',') AS missing,
  len(list_filter(generate_series(1, high), lambda x: NOT list_contains(seen, x))) = 0 AS complete, {_hmac_sql("encode(message)")} AS scan_hash FROM s""")
def scan_sessions(spark: SparkSession, folder: str) -> DataFrame:
    """Lines of some parts as pages that a supplier's scanner sends."""
    return _scans(scan(spark, folder, "lineitem").filter("l_partkey % 17 = 0"))


@query(ORACLE_SQL["scan_sessions"].replace(" WHERE l_partkey % 17 = 0", ""))
def scan_sessions_whole(spark: SparkSession, folder: str) -> DataFrame:
    """Lines of all parts."""
    return _scans(scan(spark, folder, "lineitem"))


def _scans(lines: DataFrame) -> DataFrame:
    pages = lines.select("l_suppkey", F.col("l_linenumber").alias("position"), F.lit("pdf").alias("kind"), F.md5(F.col("l_orderkey").cast("string")).alias("digest"), "l_shipdate")
    return files.scans(pages, "l_suppkey", "position", KEY, "l_shipdate").withColumn("missing", F.array_join("missing", ","))


RULES = [("license", "legal"), ("click here", "advert"), ("@", "contact"), ("für", "german"), ("http", "web")]


@query(f"""
WITH f AS (SELECT doc_id, {_folded("lower(text)")} AS t FROM documents)
SELECT doc_id, CASE {" ".join(f"WHEN contains(t, {_folded(f"'{p}'")}) THEN '{v}'" for p, v in reversed(RULES))} END AS label FROM f""")
def last_rule(spark: SparkSession, folder: str) -> DataFrame:
    return scan(spark, folder, "documents").select("doc_id", matching.last_rule(F.col("text"), RULES).alias("label"))


_MONTH = "[" + ", ".join(f"'{m}'" for m in labels.MONTHS) + "]"


@query(f"""
SELECT o_orderkey, 'Order ' || year(o_orderdate) || ' ' || ({_MONTH})[month(o_orderdate)] || ' ' || strftime(o_orderdate, '%d') AS title FROM orders""")
def filled_titles(spark: SparkSession, folder: str) -> DataFrame:
    return scan(spark, folder, "orders").select("o_orderkey", labels.fill_pattern("Order YYYY MMMM DD", F.col("o_orderdate")).alias("title"))


@query("""
WITH p AS (SELECT l_suppkey, l_orderkey, l_linenumber, l_partkey, l_quantity, l_extendedprice, CASE WHEN l_returnflag <> 'N' THEN l_linenumber END AS page, CASE WHEN l_returnflag <> 'N' THEN l_orderkey % 3 END AS total FROM lineitem),
  b AS (SELECT *, lag(page IGNORE NULLS) OVER w AS last_page, lag(total IGNORE NULLS) OVER w AS last_total FROM p WINDOW w AS (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey, l_quantity, l_extendedprice)),
  s AS (SELECT l_suppkey, sum(CASE WHEN total <> last_total OR page <= last_page THEN 1 ELSE 0 END) OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey, l_quantity, l_extendedprice) AS segment FROM b)
SELECT l_suppkey, CAST(segment AS BIGINT) AS segment, count(*) AS pages FROM s GROUP BY 1, 2""")
def page_segments(spark: SparkSession, folder: str) -> DataFrame:
    marked = F.col("l_returnflag") != "N"
    order = [F.col(c) for c in ("l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_extendedprice")]
    rows = scan(spark, folder, "lineitem").withColumns({"page": F.when(marked, F.col("l_linenumber")), "total": F.when(marked, F.col("l_orderkey") % 3)})
    return labels.segments(rows, "l_suppkey", order, "page", "total").groupBy("l_suppkey", "segment").agg(F.count("*").alias("pages"))


@query("SELECT l_linenumber, CAST(least(3600, 30 * pow(2, l_linenumber - 1)) AS BIGINT) AS wait, count(*) AS n FROM lineitem GROUP BY 1, 2")
def back_off(spark: SparkSession, folder: str) -> DataFrame:
    return scan(spark, folder, "lineitem").groupBy("l_linenumber", labels.back_off(F.col("l_linenumber")).alias("wait")).agg(F.count("*").alias("n"))


@query("""
SELECT p_brand, p_type, count(*) AS n, CAST(sum(greatest(1, coalesce(nullif(p_size % 4, 0), nullif(p_size % 3, 0), 1))) AS BIGINT) AS sheets FROM part GROUP BY 1, 2 ORDER BY n DESC, p_brand, p_type LIMIT 80""")
def sheets_by_place(spark: SparkSession, folder: str) -> DataFrame:
    size = F.col("p_size")
    sheets = F.greatest(F.lit(1), F.coalesce(F.nullif(size % 4, F.lit(0)), F.nullif(size % 3, F.lit(0)), F.lit(1)))
    counts = scan(spark, folder, "part").groupBy("p_brand", "p_type").agg(F.count("*").alias("n"), F.sum(sheets).alias("sheets"))
    return counts.orderBy(F.desc("n"), "p_brand", "p_type").limit(80)


@query(r"""
WITH w AS (SELECT doc_id, text, list_filter(regexp_split_to_array(text, '[ \t\n]+'), lambda w: w <> '') AS w FROM documents)
SELECT doc_id, len(w) > 0 AND len(list_filter(w, lambda x: regexp_full_match(x, '[\p{L}]{2,}[.,;:]?') OR regexp_full_match(x, '[0-9.,:/-]+'))) >= 0.75 * len(w) AND len(list_filter(w, lambda x: regexp_matches(x, '\p{L}{3}'))) > 0 AS plausible,
  md5(CASE WHEN length(text) <= 400 THEN text ELSE substring(text, 1, 300) || chr(10) || '[…]' || chr(10) || right(text, 100) END) AS excerpt FROM w""")
def plausible_words(spark: SparkSession, folder: str) -> DataFrame:
    words = F.filter(F.split("text", "[ \t\n]+"), lambda w: w != "")
    rows = scan(spark, folder, "documents").select("doc_id", "text", words.alias("w"))
    return rows.select("doc_id", labels.plausible(F.col("w")).alias("plausible"), F.md5(labels.excerpt(F.col("text"), 400)).alias("excerpt"))


@query()
def tag_lookup(spark: SparkSession, folder: str) -> DataFrame:
    """Nation names in other spellings, looked up among the nations."""
    nations = scan(spark, folder, "nation").select("n_nationkey", "n_name")
    spelled = F.explode(F.array(F.lower("n_name"), F.concat("n_name", F.lit("-")), F.concat("n_name", F.lit("s")), F.reverse("n_name")))
    dictionary = nations.select(F.col("n_name").alias("entry"), F.col("n_name").alias("name"), F.lit("name").alias("how"))
    return matching.lookup(nations.select("n_nationkey", spelled.alias("spelled")), "spelled", dictionary)
