"""Queries over the archive's structured tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import joins, ordered, tree
from ..sources.tables import scan
from .book import ORACLE_SQL, query


@query("""
SELECT count(*) AS total, count(*) FILTER (o_orderstatus = 'O') AS open, count(*) FILTER (o_orderstatus = 'F') AS done,
  count(*) FILTER (o_orderpriority = '1-URGENT' AND o_orderstatus <> 'F') AS urgent_not_done, count(DISTINCT o_custkey) AS customers,
  round(sum(o_totalprice), 2) AS amount, CAST(min(o_orderdate) AS DATE) AS first_day FROM orders""")
def overview_counts(spark: SparkSession, folder: str) -> DataFrame:
    status = F.col("o_orderstatus")
    return scan(spark, folder, "orders").agg(
        F.count("*").alias("total"), F.count_if(status == "O").alias("open"), F.count_if(status == "F").alias("done"),
        F.count_if((F.col("o_orderpriority") == "1-URGENT") & (status != "F")).alias("urgent_not_done"),
        F.count_distinct("o_custkey").alias("customers"), F.round(F.sum("o_totalprice"), 2).alias("amount"), F.to_date(F.min("o_orderdate")).alias("first_day"),
    )


@query("""
WITH m AS (SELECT date_trunc('month', o_orderdate) AS month, count(*) AS n FROM orders GROUP BY 1),
  top AS (SELECT max(month) AS high FROM m)
SELECT CAST(s.month AS DATE) AS month, coalesce(m.n, 0) AS n
FROM (SELECT unnest(generate_series(high - INTERVAL 11 MONTH, high, INTERVAL 1 MONTH)) AS month FROM top) s LEFT JOIN m ON m.month = s.month""")
def months_zero_filled(spark: SparkSession, folder: str) -> DataFrame:
    counted = scan(spark, folder, "orders").groupBy(F.trunc("o_orderdate", "month").alias("month")).agg(F.count("*").alias("n"))
    high = counted.agg(F.max("month").alias("high"))
    every = high.select(F.explode(F.sequence(F.add_months("high", -11), "high", F.expr("interval 1 month"))).alias("month"))
    return every.join(counted, "month", "left").select("month", F.coalesce("n", F.lit(0)).alias("n"))


@query("""
WITH c AS (SELECT CAST(o_custkey % 23 AS VARCHAR) AS value, count(*) AS n FROM orders GROUP BY 1),
  r AS (SELECT value, n, row_number() OVER (ORDER BY n DESC, value) AS place, count(*) OVER () AS many FROM c)
SELECT CASE WHEN many > 10 AND place >= 10 THEN 'Other' ELSE value END AS value, CAST(sum(n) AS BIGINT) AS n FROM r GROUP BY 1""")
def facets_other(spark: SparkSession, folder: str) -> DataFrame:
    return ordered.facet(scan(spark, folder, "orders"), F.col("o_custkey") % 23)


@query("""
SELECT p_brand, count(l_partkey) AS lines, coalesce(round(sum(l_quantity), 2), 0) AS quantity FROM part LEFT JOIN lineitem ON l_partkey = p_partkey GROUP BY p_brand""")
def facet_zero_rows(spark: SparkSession, folder: str) -> DataFrame:
    sums = scan(spark, folder, "lineitem").groupBy("l_partkey").agg(F.count("*").alias("lines"), F.sum("l_quantity").alias("quantity"))
    joined = scan(spark, folder, "part").join(sums, F.col("p_partkey") == F.col("l_partkey"), "left").groupBy("p_brand")
    return joined.agg(F.coalesce(F.sum("lines"), F.lit(0)).alias("lines"), F.coalesce(F.round(F.sum("quantity"), 2), F.lit(0.0)).alias("quantity"))


@query("""
WITH f AS (SELECT user_id, min(ts) FILTER (event_type = 'signup') AS signed, min(ts) FILTER (event_type = 'purchase') AS bought FROM events GROUP BY 1)
SELECT count(*) AS users, count(bought) AS buyers,
  round(median(date_diff('microsecond', signed, bought) / 1e6) FILTER (bought > signed), 3) AS median_s FROM f""")
def latency_first_event(spark: SparkSession, folder: str) -> DataFrame:
    kind = F.col("event_type")
    first = scan(spark, folder, "events").groupBy("user_id").agg(
        F.min(F.when(kind == "signup", F.col("ts"))).alias("signed"), F.min(F.when(kind == "purchase", F.col("ts"))).alias("bought")
    )
    took = F.when(F.col("bought") > F.col("signed"), (F.unix_micros(F.col("bought").cast("timestamp_ltz")) - F.unix_micros(F.col("signed").cast("timestamp_ltz"))) / 1e6)
    counts = first.agg(F.count("*").alias("users"), F.count("bought").alias("buyers"))
    return counts.crossJoin(ordered.median(first, took).select(F.round("median", 3).alias("median_s")))


@query("""
SELECT event_type, count(*) AS n, round(avg(value), 6) AS mean_value, round(avg(CAST(json_extract_string(props, '$.k') AS INTEGER)), 6) AS mean_k
FROM events GROUP BY 1""")
def stage_mean(spark: SparkSession, folder: str) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("int")
    return scan(spark, folder, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.round(F.avg("value"), 6).alias("mean_value"), F.round(F.avg(k), 6).alias("mean_k"))


@query("""
WITH t AS (SELECT count(*) AS total FROM orders WHERE o_orderstatus = 'O')
SELECT o_orderkey, o_orderdate, total FROM orders, t WHERE o_orderstatus = 'O' ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 25 OFFSET 50""")
def page_offset(spark: SparkSession, folder: str) -> DataFrame:
    """A page and the total; the page is a top-k, not a full sort."""
    rows = scan(spark, folder, "orders").filter("o_orderstatus = 'O'")
    page = rows.select("o_orderkey", "o_orderdate").orderBy(F.desc("o_orderdate"), F.desc("o_orderkey")).offset(50).limit(25)
    return page.crossJoin(F.broadcast(rows.agg(F.count("*").alias("total"))))


@query("SELECT event_id, ts, event_type FROM events WHERE event_id < 5000 ORDER BY event_id DESC LIMIT 500")
def keyset_page(spark: SparkSession, folder: str) -> DataFrame:
    return scan(spark, folder, "events").filter("event_id < 5000").select("event_id", "ts", "event_type").orderBy(F.desc("event_id")).limit(500)


@query("""
SELECT o_custkey, o_orderkey, place FROM (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS place FROM orders) WHERE place <= 6""")
def newest_per_key(spark: SparkSession, folder: str) -> DataFrame:
    order = Window.partitionBy("o_custkey").orderBy(F.desc("o_orderdate"), F.desc("o_orderkey"))
    return scan(spark, folder, "orders").withColumn("place", F.row_number().over(order)).filter("place <= 6").select("o_custkey", "o_orderkey", "place")


@query("""
SELECT l_orderkey, l_linenumber, l_quantity AS sheets, row_number() OVER w AS place, count(*) OVER (PARTITION BY l_orderkey) AS "of",
  coalesce(sum(l_quantity) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS sheets_above,
  sum(l_quantity) OVER (PARTITION BY l_orderkey) - sum(l_quantity) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS sheets_below
FROM lineitem WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_shipdate DESC, l_linenumber DESC, l_partkey DESC, l_quantity DESC, l_extendedprice DESC)""")
def stack_position(spark: SparkSession, folder: str) -> DataFrame:
    order = [F.desc(c) for c in ("l_shipdate", "l_linenumber", "l_partkey", "l_quantity", "l_extendedprice")]
    out = ordered.stack(scan(spark, folder, "lineitem"), "l_orderkey", order, F.col("l_quantity"))
    return out.select("l_orderkey", "l_linenumber", "sheets", "place", "of", "sheets_above", "sheets_below")


@query("""
WITH d AS (SELECT DISTINCT o_custkey, CAST(o_orderdate AS DATE) AS day FROM orders),
  g AS (SELECT o_custkey, day - lag(day) OVER (PARTITION BY o_custkey ORDER BY day) AS gap FROM d),
  m AS (SELECT o_custkey, count(*) AS dates, median(gap) AS median_gap FROM g GROUP BY 1)
SELECT *, CASE WHEN median_gap BETWEEN 25 AND 35 THEN 'monthly' WHEN median_gap BETWEEN 80 AND 100 THEN 'quarterly'
  WHEN median_gap BETWEEN 330 AND 400 THEN 'yearly' ELSE 'irregular' END AS cadence FROM m""")
def cadence(spark: SparkSession, folder: str) -> DataFrame:
    return ordered.cadence(scan(spark, folder, "orders"), "o_custkey", "o_orderdate")


@query("""
WITH m AS (SELECT DISTINCT o_custkey, date_trunc('month', o_orderdate) AS month FROM orders),
  s AS (SELECT o_custkey, unnest(generate_series(min(month), max(month), INTERVAL 1 MONTH)) AS month FROM m GROUP BY 1),
  g AS (SELECT s.o_custkey, s.month, row_number() OVER (PARTITION BY s.o_custkey ORDER BY s.month) AS n FROM s
        WHERE NOT EXISTS (SELECT 1 FROM m WHERE m.o_custkey = s.o_custkey AND m.month = s.month))
SELECT o_custkey, CAST(month AS DATE) AS month FROM g WHERE n <= 24""")
def missing_periods(spark: SparkSession, folder: str) -> DataFrame:
    return ordered.missing_months(scan(spark, folder, "orders"), "o_custkey", "o_orderdate")


@query("""
WITH s AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 10 MINUTE THEN 0 ELSE 1 END AS fresh FROM events),
  b AS (SELECT user_id, ts, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts) AS batch FROM s)
SELECT user_id, CAST(batch AS BIGINT) AS batch, min(ts) AS start, max(ts) AS "end", count(*) AS n FROM b GROUP BY 1, 2""")
def session_batches(spark: SparkSession, folder: str) -> DataFrame:
    return ordered.batches(scan(spark, folder, "events"), "user_id", "ts", 10)


@query("""
SELECT p_partkey, CASE WHEN count(*) OVER (PARTITION BY p_name) > 1
  THEN p_name || ' (' || CAST(row_number() OVER (PARTITION BY p_name ORDER BY p_partkey) AS VARCHAR) || ')' ELSE p_name END AS numbered FROM part""")
def duplicate_numbering(spark: SparkSession, folder: str) -> DataFrame:
    return ordered.numbered(scan(spark, folder, "part"), "p_name", "p_partkey").select("p_partkey", "numbered")


@query("""
WITH a AS (SELECT event_id, user_id, ts, event_type, sum(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS failed FROM events)
SELECT event_id, user_id, ts, lag(ts) OVER w AS previous, CAST(failed - coalesce(lag(failed) OVER w, 0) AS BIGINT) AS failures
FROM a WHERE event_type = 'signup' WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)""")
def previous_success(spark: SparkSession, folder: str) -> DataFrame:
    kind = F.col("event_type")
    return joins.previous(scan(spark, folder, "events"), "user_id", "ts", kind == "signup", kind == "error")


@query("""
SELECT event_id, user_id, ts FROM events a WHERE event_type = 'purchase' AND EXISTS (SELECT 1 FROM events b
  WHERE b.event_type = 'view' AND b.user_id = a.user_id AND abs(date_diff('microsecond', a.ts, b.ts)) <= 3600000000)""")
def near_in_time(spark: SparkSession, folder: str) -> DataFrame:
    events = scan(spark, folder, "events").select("event_id", "user_id", F.col("ts").cast("timestamp_ltz").alias("ts"), "event_type")
    out = joins.near_in_time(events.filter("event_type = 'purchase'"), events.filter("event_type = 'view'"), "user_id", "ts", 60)
    return out.select("event_id", "user_id", F.col("ts").cast("timestamp_ntz").alias("ts"))


@query("SELECT c_custkey, c_name FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)")
def without_orders(spark: SparkSession, folder: str) -> DataFrame:
    return scan(spark, folder, "customer").join(scan(spark, folder, "orders"), F.col("c_custkey") == F.col("o_custkey"), "left_anti").select("c_custkey", "c_name")


@query("""
SELECT s_suppkey, s_name, n_name, r_name FROM supplier LEFT JOIN nation ON n_nationkey = s_nationkey LEFT JOIN region ON r_regionkey = n_regionkey""")
def lookups(spark: SparkSession, folder: str) -> DataFrame:
    out = scan(spark, folder, "supplier").join(scan(spark, folder, "nation"), F.col("s_nationkey") == F.col("n_nationkey"), "left")
    return out.join(scan(spark, folder, "region"), F.col("n_regionkey") == F.col("r_regionkey"), "left").select("s_suppkey", "s_name", "n_name", "r_name")


@query("""
SELECT DISTINCT o_orderkey FROM orders JOIN lineitem ON l_orderkey = o_orderkey JOIN part ON p_partkey = l_partkey WHERE p_type = 'ECONOMY' AND p_size > 40""")
def tag_filter(spark: SparkSession, folder: str) -> DataFrame:
    """Items with any of the wanted tags: semi-joins instead of a join and DISTINCT."""
    wanted = scan(spark, folder, "part").filter("p_type = 'ECONOMY' AND p_size > 40").select("p_partkey")
    lines = scan(spark, folder, "lineitem").join(wanted, F.col("l_partkey") == F.col("p_partkey"), "left_semi").select("l_orderkey")
    return scan(spark, folder, "orders").join(lines, F.col("o_orderkey") == F.col("l_orderkey"), "left_semi").select("o_orderkey")


@query("""
WITH t AS (SELECT l_orderkey, list_sort(list(DISTINCT l_returnflag)) AS was, list_sort(list(DISTINCT l_linestatus)) AS now FROM lineitem GROUP BY 1)
SELECT l_orderkey, array_to_string(list_sort(list_filter(was, lambda x: NOT list_contains(now, x))), ',') AS removed,
  array_to_string(list_sort(list_filter(now, lambda x: NOT list_contains(was, x))), ',') AS added,
  array_to_string(list_sort(list_filter(now, lambda x: list_contains(was, x))), ',') AS kept FROM t""")
def tag_diff(spark: SparkSession, folder: str) -> DataFrame:
    tags = scan(spark, folder, "lineitem").groupBy("l_orderkey").agg(F.collect_set("l_returnflag").alias("was"), F.collect_set("l_linestatus").alias("now"))
    joined = lambda x: F.array_join(F.sort_array(x), ",")
    return tags.select("l_orderkey", joined(F.array_except("was", "now")).alias("removed"), joined(F.array_except("now", "was")).alias("added"), joined(F.array_intersect("now", "was")).alias("kept"))


@query("""
(SELECT o_custkey AS key, 'both' AS part FROM orders WHERE o_orderstatus = 'O' INTERSECT SELECT o_custkey, 'both' FROM orders WHERE o_orderstatus = 'F')
UNION ALL (SELECT o_custkey, 'open only' FROM orders WHERE o_orderstatus = 'O' EXCEPT SELECT o_custkey, 'open only' FROM orders WHERE o_orderstatus = 'F')""")
def set_operations(spark: SparkSession, folder: str) -> DataFrame:
    orders = scan(spark, folder, "orders")
    of = lambda status: orders.filter(F.col("o_orderstatus") == status).select(F.col("o_custkey").alias("key"))
    both, only = of("O").intersect(of("F")), of("O").subtract(of("F"))
    return both.withColumn("part", F.lit("both")).unionByName(only.withColumn("part", F.lit("open only")))


_FOLDERS = "SELECT p_partkey AS folder_id, CASE WHEN p_partkey > 0 THEN p_partkey // 4 END AS parent_id, p_name AS name FROM part WHERE p_partkey < 300"


#: The same over the whole table.
_ALL_FOLDERS = _FOLDERS.removesuffix(" WHERE p_partkey < 300")


def _folders(spark: SparkSession, folder: str, whole: bool = False) -> DataFrame:
    """The first parts as a tree, or all: folder n lies in folder n / 4."""
    part = scan(spark, folder, "part")
    part = part if whole else part.filter("p_partkey < 300")
    return part.select(F.col("p_partkey").alias("folder_id"), F.when(F.col("p_partkey") > 0, F.floor(F.col("p_partkey") / 4)).alias("parent_id"), F.col("p_name").alias("name"))


@query(f"""
WITH RECURSIVE f AS ({_FOLDERS}), p AS (SELECT folder_id, name AS path, 1 AS depth FROM f WHERE parent_id IS NULL
  UNION ALL SELECT f.folder_id, p.path || ' / ' || f.name, p.depth + 1 FROM f JOIN p ON f.parent_id = p.folder_id)
SELECT folder_id, path, CAST(depth AS BIGINT) AS depth FROM p""")
def folder_paths(spark: SparkSession, folder: str) -> DataFrame:
    return tree.paths(_folders(spark, folder))


@query(f"""
WITH RECURSIVE f AS ({_FOLDERS}), c AS (SELECT folder_id, folder_id AS up FROM f UNION ALL SELECT c.folder_id, f.parent_id FROM c JOIN f ON f.folder_id = c.up WHERE f.parent_id IS NOT NULL),
  o AS (SELECT l_partkey AS folder_id, count(*) AS n FROM lineitem GROUP BY 1)
SELECT f.folder_id, coalesce(max(o.n), 0) AS own, coalesce(max(t.total), 0) AS total FROM f LEFT JOIN o ON o.folder_id = f.folder_id
  LEFT JOIN (SELECT up, CAST(sum(n) AS BIGINT) AS total FROM c JOIN o ON o.folder_id = c.folder_id GROUP BY 1) t ON t.up = f.folder_id GROUP BY 1""")
def tree_totals(spark: SparkSession, folder: str) -> DataFrame:
    lines = scan(spark, folder, "lineitem").select(F.col("l_partkey").alias("folder_id"))
    return tree.rollup(_folders(spark, folder), lines)


@query(f"""
WITH RECURSIVE f AS ({_FOLDERS}), s AS (SELECT folder_id FROM f WHERE folder_id = 5 UNION ALL SELECT f.folder_id FROM f JOIN s ON f.parent_id = s.folder_id)
SELECT folder_id FROM s""")
def folder_subtree(spark: SparkSession, folder: str) -> DataFrame:
    return tree.closure(_folders(spark, folder)).filter("ancestor_id = 5").select("folder_id")


@query(ORACLE_SQL["folder_paths"].replace(_FOLDERS, _ALL_FOLDERS))
def folder_paths_whole(spark: SparkSession, folder: str) -> DataFrame:
    return tree.paths(_folders(spark, folder, whole=True))


@query(ORACLE_SQL["tree_totals"].replace(_FOLDERS, _ALL_FOLDERS))
def tree_totals_whole(spark: SparkSession, folder: str) -> DataFrame:
    lines = scan(spark, folder, "lineitem").select(F.col("l_partkey").alias("folder_id"))
    return tree.rollup(_folders(spark, folder, whole=True), lines)


@query(ORACLE_SQL["folder_subtree"].replace(_FOLDERS, _ALL_FOLDERS))
def folder_subtree_whole(spark: SparkSession, folder: str) -> DataFrame:
    return tree.closure(_folders(spark, folder, whole=True)).filter("ancestor_id = 5").select("folder_id")


@query("""
SELECT event_type, count(*) FILTER (ts < (SELECT max(ts) FROM events) - INTERVAL 7 DAY) AS expired, count(*) FILTER (ts >= (SELECT max(ts) FROM events) - INTERVAL 7 DAY) AS kept FROM events GROUP BY 1""")
def retention(spark: SparkSession, folder: str) -> DataFrame:
    events = scan(spark, folder, "events")
    limit = events.agg((F.max("ts") - F.expr("interval 7 days")).alias("limit"))
    old = F.col("ts") < F.col("limit")
    return events.crossJoin(F.broadcast(limit)).groupBy("event_type").agg(F.count_if(old).alias("expired"), F.count_if(~old).alias("kept"))


@query("""
SELECT o_orderkey, CASE o_orderpriority WHEN '1-URGENT' THEN CAST(year(o_orderdate) AS VARCHAR) WHEN '2-HIGH' THEN 'Q' || quarter(o_orderdate) || ' ' || year(o_orderdate)
  WHEN '3-MEDIUM' THEN strftime(o_orderdate, '%B %Y') ELSE strftime(o_orderdate, '%Y-%m-%d') END AS period, CAST(year(o_orderdate) * 12 + month(o_orderdate) - 1 AS BIGINT) AS month_index FROM orders""")
def period_labels(spark: SparkSession, folder: str) -> DataFrame:
    day, kind = F.col("o_orderdate"), F.col("o_orderpriority")
    label = (
        F.when(kind == "1-URGENT", F.date_format(day, "yyyy")).when(kind == "2-HIGH", F.concat(F.lit("Q"), F.quarter(day), F.lit(" "), F.year(day)))
        .when(kind == "3-MEDIUM", F.date_format(day, "MMMM yyyy")).otherwise(F.date_format(day, "yyyy-MM-dd"))
    )
    return scan(spark, folder, "orders").select("o_orderkey", label.alias("period"), (F.year(day) * 12 + F.month(day) - 1).cast("long").alias("month_index"))


@query("SELECT p_partkey, regexp_replace(replace(replace(lower(p_brand || ' ' || p_name), 'ä', 'ae'), 'ß', 'ss'), '[^a-z0-9]', '', 'g') AS label FROM part")
def folded_labels(spark: SparkSession, folder: str) -> DataFrame:
    return scan(spark, folder, "part").select("p_partkey", T.label(F.concat_ws(" ", "p_brand", "p_name")).alias("label"))


@query("""
WITH b AS (SELECT c_custkey, lpad(CAST(c_custkey * 7919 AS VARCHAR), 18, '0') AS body FROM customer)
SELECT c_custkey, CAST(CAST(body || '131468' AS HUGEINT) % 97 AS BIGINT) AS rest FROM b""")
def iban_remainder(spark: SparkSession, folder: str) -> DataFrame:
    iban = F.concat(F.lit("DE68"), F.lpad((F.col("c_custkey") * 7919).cast("string"), 18, "0"))
    return scan(spark, folder, "customer").select("c_custkey", T.iban_rest(iban).alias("rest"))


@query("""
WITH k AS (SELECT event_type, user_id, CAST(value * 100 AS BIGINT) AS cents, min(event_id) AS event_id, count(*) AS copies FROM events GROUP BY 1, 2, 3)
SELECT event_id, copies FROM k""")
def register_once(spark: SparkSession, folder: str) -> DataFrame:
    """One row a content key, the first; how many came."""
    key = F.xxhash64("event_type", "user_id", F.round(F.col("value") * 100).cast("long"))
    return scan(spark, folder, "events").groupBy(key).agg(F.min("event_id").alias("event_id"), F.count("*").alias("copies")).select("event_id", "copies")
