"""Checks and profiles of an archive, on the structured tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import review
from ..operators.settled import settle
from ..sources.tables import scan
from .archive import _ALL_FOLDERS, _FOLDERS, _folders
from .book import ORACLE_SQL, query
from .content import _WORDS


@query("""
SELECT o_custkey, CAST(date_trunc('month', o_orderdate) AS DATE) AS month, o_orderstatus, count(*) AS n, first(o_orderkey ORDER BY o_totalprice DESC, o_orderdate, o_orderkey) AS kept
FROM orders WHERE o_custkey IS NOT NULL AND o_orderdate IS NOT NULL AND o_orderstatus IS NOT NULL GROUP BY 1, 2, 3 HAVING count(*) > 1""")
def equal_facts(spark: SparkSession, folder: str) -> DataFrame:
    orders = scan(spark, folder, "orders").withColumn("month", F.trunc("o_orderdate", "month"))
    return review.equal_facts(orders, ["o_custkey", "month", "o_orderstatus"], "o_orderkey", [-F.col("o_totalprice"), F.col("o_orderdate"), F.col("o_orderkey")])


@query("""
WITH r AS (SELECT l_partkey || '/' || l_suppkey AS reference, l_orderkey AS item, l_returnflag || l_linestatus AS kind FROM lineitem),
  g AS (SELECT reference, count(DISTINCT item) AS items, list_sort(list(DISTINCT item)) AS members FROM r GROUP BY 1 HAVING count(DISTINCT item) BETWEEN 2 AND 20 AND count(DISTINCT kind) >= 2)
SELECT min(reference) AS reference, items FROM g GROUP BY members, items""")
def shared_references(spark: SparkSession, folder: str) -> DataFrame:
    return review.shared_references(scan(spark, folder, "lineitem"), F.concat_ws("/", "l_partkey", "l_suppkey"), "l_orderkey", F.concat("l_returnflag", "l_linestatus"))


@query("""
WITH n AS (SELECT event_id, user_id, ts, event_type, lead(event_id) OVER w AS next_id, lead(ts) OVER w AS next_ts, lead(event_type) OVER w AS next_type FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))
SELECT event_id, next_id FROM n WHERE next_ts - ts <= INTERVAL 20 MINUTE AND event_type <> next_type""")
def continuation_pairs(spark: SparkSession, folder: str) -> DataFrame:
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    after = {f"next_{c}": F.lead(c).over(w) for c in ("event_id", "ts", "event_type")}
    near = (F.col("next_ts") - F.col("ts") <= F.expr("interval 20 minutes")) & (F.col("event_type") != F.col("next_event_type"))
    return scan(spark, folder, "events").select("event_id", "user_id", "ts", "event_type").withColumns(after).filter(near).select("event_id", F.col("next_event_id").alias("next_id"))


@query("""
WITH s AS (SELECT event_id, user_id, ts, event_type, sum(CASE WHEN event_type = 'signup' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS visit FROM events)
SELECT user_id, CAST(visit AS BIGINT) AS visit, event_id, place FROM (SELECT *, row_number() OVER (PARTITION BY user_id, visit ORDER BY ts DESC, event_id DESC) AS place FROM s WHERE event_type <> 'signup') WHERE visit > 0 AND place <= 5""")
def visit_actions(spark: SparkSession, folder: str) -> DataFrame:
    """The newest actions after each sign-in."""
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    visits = scan(spark, folder, "events").select("event_id", "user_id", "ts", "event_type").withColumn("visit", F.sum((F.col("event_type") == "signup").cast("int")).over(order))
    newest = Window.partitionBy("user_id", "visit").orderBy(F.desc("ts"), F.desc("event_id"))
    actions = visits.filter("visit > 0 AND event_type <> 'signup'").withColumn("place", F.row_number().over(newest))
    return actions.filter("place <= 5").select("user_id", "visit", "event_id", "place")


_DISTINCT = f"w AS (SELECT DISTINCT doc_id, w FROM (SELECT doc_id, unnest({_WORDS}) AS w FROM documents))"


@query(f"""
WITH {_DISTINCT}, n AS (SELECT count(DISTINCT doc_id) AS n FROM w), r AS (SELECT w, ln(1 + n / (1 + count(*))) AS rarity FROM w, n GROUP BY w, n),
  t AS (SELECT doc_id, sum(rarity) AS whole FROM w JOIN r USING (w) GROUP BY 1),
  s AS (SELECT x.doc_id AS a, sum(rarity) AS shared FROM w x JOIN w y ON y.doc_id = x.doc_id + 1 AND y.w = x.w JOIN r ON r.w = x.w GROUP BY 1),
  p AS (SELECT d.doc_id AS a, e.doc_id AS b, coalesce(s.shared, 0) AS shared, coalesce(ta.whole, 0) + coalesce(tb.whole, 0) - coalesce(s.shared, 0) AS either
    FROM documents d JOIN documents e ON e.doc_id = d.doc_id + 1 LEFT JOIN s ON s.a = d.doc_id LEFT JOIN t ta ON ta.doc_id = d.doc_id LEFT JOIN t tb ON tb.doc_id = e.doc_id)
SELECT a, b, round(CASE WHEN either > 0 THEN shared / either ELSE 0 END, 4) AS overlap FROM p""")
def overlap_by_rarity(spark: SparkSession, folder: str) -> DataFrame:
    docs = scan(spark, folder, "documents")
    sets = docs.select("doc_id", F.array_distinct(T.words(F.col("text"))).alias("words"))
    ids = docs.select(F.col("doc_id").alias("a"))
    pairs = ids.join(ids.select((F.col("a") - 1).alias("a"), F.col("a").alias("b")), "a")
    return review.overlap_by_rarity(sets, pairs, "doc_id").withColumn("overlap", F.round("overlap", 4))


@query(f"""
WITH u AS (SELECT doc_id, unnest(ws) AS w, generate_subscripts(ws, 1) AS i FROM (SELECT doc_id, {_WORDS} AS ws FROM documents)),
  l AS (SELECT doc_id, w, lead(w, 1) OVER o AS x, lead(w, 2) OVER o AS y, lead(w, 3) OVER o AS z FROM u WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
  g AS (SELECT DISTINCT doc_id, md5(w || ' ' || x || ' ' || y || ' ' || z) AS h FROM l WHERE z IS NOT NULL),
  s AS (SELECT doc_id, list(h ORDER BY h) AS k FROM (SELECT * FROM g QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY h) <= 96) GROUP BY 1),
  k AS (SELECT doc_id, coalesce(k, CAST([] AS VARCHAR[])) AS k FROM documents LEFT JOIN s USING (doc_id)),
  p AS (SELECT x.doc_id, x.k AS a, y.k AS b, list_sort(list_distinct(list_concat(x.k, y.k)))[1:96] AS u FROM k x JOIN k y ON y.doc_id = x.doc_id + 1)
SELECT doc_id, len(a) AS hashes, round(CASE WHEN len(u) > 0 THEN len(list_filter(u, lambda h: list_contains(a, h) AND list_contains(b, h))) / len(u) ELSE 0 END, 6) AS same FROM p""")
def sketch_similarity(spark: SparkSession, folder: str) -> DataFrame:
    words = scan(spark, folder, "documents").select("doc_id", T.words(F.col("text")).alias("w"))
    sketches = settle(words.select("doc_id", review.sketch(F.col("w")).alias("k")))
    pairs = sketches.withColumnRenamed("k", "a").join(sketches.select((F.col("doc_id") - 1).alias("doc_id"), F.col("k").alias("b")), "doc_id")
    return pairs.select("doc_id", F.size("a").cast("long").alias("hashes"), F.round(review.sketch_similarity(F.col("a"), F.col("b")), 6).alias("same"))


@query(f"""
WITH RECURSIVE f AS ({_FOLDERS}), c AS (SELECT folder_id, folder_id AS up FROM f UNION ALL SELECT c.folder_id, f.parent_id FROM c JOIN f ON f.folder_id = c.up WHERE f.parent_id IS NOT NULL),
  n AS (SELECT c.up AS folder_id, l_suppkey AS supplier, count(*) AS n FROM lineitem JOIN c ON c.folder_id = l_partkey GROUP BY 1, 2)
SELECT folder_id, supplier, n, place FROM (SELECT *, row_number() OVER (PARTITION BY folder_id ORDER BY n DESC, supplier) AS place FROM n) WHERE place <= 3""")
def folder_profile(spark: SparkSession, folder: str) -> DataFrame:
    items = scan(spark, folder, "lineitem").select(F.col("l_partkey").alias("folder_id"), F.col("l_suppkey").alias("supplier"))
    return review.profile(_folders(spark, folder), items, "supplier")


@query(ORACLE_SQL["folder_profile"].replace(_FOLDERS, _ALL_FOLDERS))
def folder_profile_whole(spark: SparkSession, folder: str) -> DataFrame:
    items = scan(spark, folder, "lineitem").select(F.col("l_partkey").alias("folder_id"), F.col("l_suppkey").alias("supplier"))
    return review.profile(_folders(spark, folder, whole=True), items, "supplier")


@query(f"""
WITH w AS (SELECT DISTINCT source, doc_id, w FROM (SELECT source, doc_id, unnest({_WORDS}) AS w FROM documents)), n AS (SELECT source, count(*) AS docs FROM documents GROUP BY 1)
SELECT source, w AS word, count(*) AS n, docs FROM w JOIN n USING (source) GROUP BY 1, 2, docs HAVING count(*) >= 0.3 * docs""")
def typical_words(spark: SparkSession, folder: str) -> DataFrame:
    """Words in three tenths of a source's documents or more."""
    docs = scan(spark, folder, "documents").filter("source IS NOT NULL")
    counts = docs.select("source", F.explode(F.array_distinct(T.words(F.col("text")))).alias("word")).groupBy("source", "word").agg(F.count("*").alias("n"))
    return counts.join(docs.groupBy("source").agg(F.count("*").alias("docs")), "source").filter(F.col("n") >= 0.3 * F.col("docs")).select("source", "word", "n", "docs")


@query("""
WITH q AS (SELECT l_partkey, l_quantity, count(*) AS n FROM lineitem GROUP BY 1, 2), m AS (SELECT l_partkey, l_quantity AS usual FROM q QUALIFY row_number() OVER (PARTITION BY l_partkey ORDER BY n DESC, l_quantity) = 1),
  s AS (SELECT l_partkey, list(DISTINCT l_linenumber) AS seen FROM lineitem GROUP BY 1)
SELECT l_partkey, usual, array_to_string(list_filter(generate_series(1, 7), lambda x: NOT list_contains(seen, x)), ',') AS missing FROM m JOIN s USING (l_partkey)""")
def mode_and_missing(spark: SparkSession, folder: str) -> DataFrame:
    """The commonest total and the numbers 1 to 7 that never came."""
    rows = scan(spark, folder, "lineitem").groupBy("l_partkey").agg(F.mode("l_quantity", True).alias("usual"), F.collect_set(F.col("l_linenumber").cast("int")).alias("seen"))
    return rows.select("l_partkey", "usual", F.array_join(F.array_except(F.sequence(F.lit(1), F.lit(7)), "seen"), ",").alias("missing"))


@query("""
WITH m AS (SELECT DISTINCT o_custkey, CAST(year(o_orderdate) * 12 + month(o_orderdate) - 1 AS INTEGER) AS m FROM orders),
  g AS (SELECT o_custkey, m, m - lag(m) OVER (PARTITION BY o_custkey ORDER BY m) AS gap FROM m),
  r AS (SELECT o_custkey, list(m) AS seen, min(m) AS low, max(m) AS high, median(gap) AS step FROM g GROUP BY 1),
  x AS (SELECT o_custkey, CAST(step AS INTEGER) AS step, seen, list_filter(generate_series(low, high, CAST(step AS INTEGER)), lambda y: NOT list_contains(seen, CAST(y AS INTEGER))) AS missing FROM r WHERE len(seen) >= 3 AND step IN (1, 3))
SELECT o_custkey, step, array_to_string(missing, ',') AS missing FROM x WHERE len(missing) BETWEEN 1 AND least(6, len(seen))""")
def regular_gaps(spark: SparkSession, folder: str) -> DataFrame:
    return review.regular_gaps(scan(spark, folder, "orders"), "o_custkey", "o_orderdate").withColumn("missing", F.array_join("missing", ","))


@query("""
SELECT a.s_suppkey, array_to_string(list_filter([CASE WHEN a.s_nationkey IS DISTINCT FROM b.s_nationkey THEN 'nation' END, CASE WHEN a.s_acctbal > 0 IS DISTINCT FROM b.s_acctbal > 0 THEN 'credit' END], lambda x: x IS NOT NULL), ',') AS fields
FROM supplier a JOIN supplier b ON b.s_suppkey = a.s_suppkey + 1""")
def snapshot_diff(spark: SparkSession, folder: str) -> DataFrame:
    rows = scan(spark, folder, "supplier").select("s_suppkey", F.struct(F.col("s_nationkey").alias("nation"), (F.col("s_acctbal") > 0).alias("credit")).alias("old"))
    pairs = rows.join(rows.select((F.col("s_suppkey") - 1).alias("s_suppkey"), F.col("old").alias("new")), "s_suppkey")
    names = ["nation", "credit"]
    return pairs.select("s_suppkey", F.array_join(review.changed(names, [F.col(f"old.{n}") for n in names], [F.col(f"new.{n}") for n in names]), ",").alias("fields"))


@query("""
SELECT DISTINCT l_orderkey, CASE WHEN p_brand = 'Brand#1' THEN 'Brand#2' ELSE p_brand END AS tag FROM lineitem JOIN part ON p_partkey = l_partkey""")
def tag_merge(spark: SparkSession, folder: str) -> DataFrame:
    """One tag becomes another; pairs that exist already are dropped."""
    tags = scan(spark, folder, "part").select("p_partkey", F.when(F.col("p_brand") == "Brand#1", "Brand#2").otherwise(F.col("p_brand")).alias("tag"))
    return scan(spark, folder, "lineitem").join(tags, F.col("l_partkey") == F.col("p_partkey")).select("l_orderkey", "tag").distinct()


@query("""
WITH c AS (SELECT o_orderpriority, count(*) AS queued FROM orders WHERE o_orderstatus = 'O' GROUP BY 1)
SELECT o_orderkey, o_orderpriority, queued FROM (SELECT * FROM orders WHERE o_orderstatus = 'O' ORDER BY o_orderpriority, o_orderdate, o_orderkey LIMIT 20) JOIN c USING (o_orderpriority)""")
def queue_head(spark: SparkSession, folder: str) -> DataFrame:
    queued = scan(spark, folder, "orders").filter("o_orderstatus = 'O'")
    head = queued.orderBy("o_orderpriority", "o_orderdate", "o_orderkey").limit(20).select("o_orderkey", "o_orderpriority")
    return head.join(queued.groupBy("o_orderpriority").agg(F.count("*").alias("queued")), "o_orderpriority").select("o_orderkey", "o_orderpriority", "queued")
