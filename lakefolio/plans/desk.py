"""The desk's queries. Orders stand for documents: the customer is the sender,
the priority the kind, the clerk's status the status; lines stand for pages and
parts for what they are about."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import desk
from ..sources.tables import scan
from .book import query

_DOCS = """docs AS (SELECT o_orderkey AS doc_id, CASE WHEN o_orderpriority <> '5-LOW' THEN o_custkey % 25 END AS folder, o_orderpriority AS kind, o_custkey AS sender,
  CASE WHEN o_custkey % 3 = 0 THEN o_custkey END AS series, CASE o_orderstatus WHEN 'O' THEN 'new' WHEN 'F' THEN 'done' ELSE 'todo' END AS status, o_totalprice > 200000 AS important,
  CASE WHEN o_orderkey % 4 <> 0 THEN o_orderdate END AS read_at, o_orderdate + to_days(CAST(o_orderkey % 5 AS INTEGER)) AS uploaded_at, CASE WHEN o_orderkey % 11 <> 0 THEN o_orderdate END AS day,
  CASE WHEN o_orderkey % 13 = 0 THEN o_orderdate END AS deleted_at FROM orders)"""
_TAGS = "tags AS (SELECT DISTINCT l_orderkey AS doc_id, CASE WHEN p_size % 2 = 0 THEN upper(p_brand) ELSE p_brand END AS tag FROM lineitem JOIN part ON p_partkey = l_partkey)"


def _docs(spark: SparkSession, folder: str) -> DataFrame:
    key, day, status = F.col("o_orderkey"), F.col("o_orderdate"), F.col("o_orderstatus")
    return scan(spark, folder, "orders").select(
        key.alias("doc_id"), F.when(F.col("o_orderpriority") != "5-LOW", F.col("o_custkey") % 25).alias("folder"), F.col("o_orderpriority").alias("kind"), F.col("o_custkey").alias("sender"),
        F.when(F.col("o_custkey") % 3 == 0, F.col("o_custkey")).alias("series"), F.when(status == "O", "new").when(status == "F", "done").otherwise("todo").alias("status"),
        (F.col("o_totalprice") > 200000).alias("important"), F.when(key % 4 != 0, day).alias("read_at"), (day + F.make_dt_interval((key % 5).cast("int"))).alias("uploaded_at"),
        F.when(key % 11 != 0, day).alias("day"), F.when(key % 13 == 0, day).alias("deleted_at"),
    )


def _tags(spark: SparkSession, folder: str) -> DataFrame:
    parts = scan(spark, folder, "part").select("p_partkey", F.when(F.col("p_size") % 2 == 0, F.upper("p_brand")).otherwise(F.col("p_brand")).alias("tag"))
    return scan(spark, folder, "lineitem").join(parts, F.col("l_partkey") == F.col("p_partkey")).select(F.col("l_orderkey").alias("doc_id"), "tag").distinct()


_LISTED = "SELECT doc_id FROM docs WHERE deleted_at IS NULL AND kind IN ('1-URGENT', '2-HIGH') AND status IN ('new', 'todo') AND important AND CAST(day AS DATE) BETWEEN DATE '1996-01-01' AND DATE '2020-12-31'"


@query(f"""
WITH {_DOCS}, {_TAGS}, r AS (SELECT * FROM docs WHERE doc_id IN ({_LISTED})), p AS (SELECT *, row_number() OVER (ORDER BY day DESC NULLS LAST, doc_id DESC) AS place, count(*) OVER () AS total FROM r),
  t AS (SELECT doc_id, array_to_string(list(tag ORDER BY lower(tag), tag), ', ') AS tags FROM tags GROUP BY 1)
SELECT place, total, doc_id, sender, tags FROM p LEFT JOIN t USING (doc_id) WHERE place BETWEEN 41 AND 80""")
def filtered_list(spark: SparkSession, folder: str) -> DataFrame:
    """Second page of forty: urgent, open, important, dated from 1996 on."""
    some = desk.Filters(kinds=("1-URGENT", "2-HIGH"), status=("new", "todo"), important=True, date_from=date(1996, 1, 1), date_to=date(2020, 12, 31), sort="-date", page=2, page_size=40)
    out = some.listed(_docs(spark, folder), _tags(spark, folder))
    return out.select(F.col("place").cast("long"), "total", "doc_id", "sender", F.array_join("tags", ", ").alias("tags"))


@query(f"""
WITH {_DOCS}, {_TAGS}, r AS (SELECT * FROM docs WHERE deleted_at IS NULL AND folder IS NULL AND read_at IS NULL AND doc_id IN (SELECT doc_id FROM tags WHERE tag = 'Brand#1') AND doc_id IN (SELECT doc_id FROM tags WHERE tag = 'BRAND#3'))
SELECT doc_id, row_number() OVER (ORDER BY uploaded_at, doc_id) AS place, count(*) OVER () AS total FROM r QUALIFY place <= 100""")
def unfiled_with_tags(spark: SparkSession, folder: str) -> DataFrame:
    """Unfiled and unread, with both of two tags, oldest upload first."""
    some = desk.Filters(unfiled=True, unread=True, tags=("Brand#1", "BRAND#3"), sort="uploaded", page_size=100)
    return some.listed(_docs(spark, folder), _tags(spark, folder)).select("doc_id", F.col("place").cast("long"), "total")


@query(f"""
WITH {_DOCS}, up AS (SELECT n_nationkey AS folder, n_regionkey + 100 AS up FROM nation UNION SELECT n_nationkey, n_nationkey FROM nation)
SELECT doc_id, folder, day FROM docs WHERE deleted_at IS NULL AND folder IN (SELECT folder FROM up WHERE up = 101) AND doc_id NOT IN (1, 2, 3, 7, 32, 33, 34, 35)""")
def scope_of_folder(spark: SparkSession, folder: str) -> DataFrame:
    """A region's folder with the nations below it, without some documents."""
    nations = scan(spark, folder, "nation").select(F.col("n_nationkey").alias("folder"), (F.col("n_regionkey") + 100).alias("up"))
    closure = nations.union(nations.select("folder", F.col("folder").alias("up")))
    out = desk.scope(_docs(spark, folder), closure, folder=101, excluded=(1, 2, 3, 7, 32, 33, 34, 35))
    return out.orderBy(F.asc_nulls_last("day"), "uploaded_at", "doc_id").select("doc_id", "folder", "day")


@query("""
WITH p AS (SELECT l_orderkey AS doc_id, list(struct_pack(number := n, ink := CAST(l_discount AS DOUBLE), chars := CASE WHEN l_tax < 0.03 THEN 0 ELSE CAST(l_quantity AS INTEGER) END) ORDER BY n) AS pages FROM
    (SELECT *, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) AS INTEGER) AS n FROM lineitem) GROUP BY 1),
  s AS (SELECT doc_id, CAST(len(pages) AS INTEGER) AS count, list_transform(list_filter(pages, lambda p: p.ink < 0.0001 AND p.chars = 0), lambda p: p.number) AS blank,
    CASE WHEN doc_id % 7 = 0 THEN list_reverse(CAST(generate_series(0, len(pages)) AS INTEGER[])) END AS stored FROM p),
  v AS (SELECT doc_id, count, blank, CASE WHEN stored IS NOT NULL THEN list_filter(stored, lambda n: n BETWEEN 1 AND count) WHEN len(blank) < count THEN list_filter(CAST(generate_series(1, count) AS INTEGER[]), lambda n: NOT list_contains(blank, n)) ELSE CAST(generate_series(1, count) AS INTEGER[]) END AS shown FROM s)
SELECT doc_id, CAST(len(blank) AS INTEGER) AS blanks, array_to_string(shown, ',') AS shown, shown <> CAST(generate_series(1, count) AS INTEGER[]) AS enhanced FROM v""")
def page_views(spark: SparkSession, folder: str) -> DataFrame:
    """Blank pages by ink and text, stored orders, the pages shown."""
    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")
    chars = F.when(F.col("l_tax") < 0.03, 0).otherwise(F.col("l_quantity").cast("int")).alias("chars")
    lines = scan(spark, folder, "lineitem").select(F.col("l_orderkey").alias("doc_id"), F.struct(F.row_number().over(order).alias("number"), F.col("l_discount").cast("double").alias("ink"), chars).alias("page"))
    rows = lines.groupBy("doc_id").agg(F.collect_list("page").alias("pages"))
    rows = rows.select("doc_id", F.size("pages").alias("count"), desk.blank_pages(F.col("pages")).alias("blank"), F.lit(None).alias("pages"))
    stored = F.when(F.col("doc_id") % 7 == 0, F.reverse(F.sequence(F.lit(0), F.col("count"))))
    shown = desk.visible_pages(F.col("pages"), F.col("count"), stored, F.col("blank"))
    views = rows.select("doc_id", F.size("blank").alias("blanks"), shown.alias("shown"), "count")
    return views.select("doc_id", "blanks", F.array_join("shown", ",").alias("shown"), (F.col("shown") != F.sequence(F.lit(1), F.col("count"))).alias("enhanced"))


@query("""
WITH m AS (SELECT c_custkey AS sender, min(c_custkey) OVER (PARTITION BY c_nationkey, c_mktsegment) AS target, c_name AS name, upper(c_name) AS alias FROM customer),
  a AS (SELECT target, list_distinct(flatten(list([name, alias]) FILTER (sender <> target))) AS taken FROM m GROUP BY 1), d AS (SELECT target, count(*) AS docs FROM orders JOIN m ON sender = o_custkey GROUP BY 1)
SELECT m.sender, coalesce(docs, 0) AS docs, array_to_string(list_sort(list_distinct(list_concat([m.alias], coalesce(taken, CAST([] AS VARCHAR[]))))), ',') AS aliases FROM m JOIN a ON a.target = m.sender LEFT JOIN d ON d.target = m.sender WHERE m.sender = m.target""")
def senders_merged(spark: SparkSession, folder: str) -> DataFrame:
    """Customers of one nation and segment become the first of them."""
    rows = scan(spark, folder, "customer").select(F.col("c_custkey").alias("sender"), F.col("c_name").alias("name"), F.array(F.upper("c_name")).alias("aliases"), "c_nationkey", "c_mktsegment")
    first = rows.groupBy("c_nationkey", "c_mktsegment").agg(F.min("sender").alias("target"))
    merges = rows.join(first, ["c_nationkey", "c_mktsegment"]).filter("sender <> target").select("sender", "target")
    senders, docs = desk.merge_senders(rows.select("sender", "name", "aliases"), scan(spark, folder, "orders").select("o_orderkey", F.col("o_custkey").alias("sender")), merges)
    counts = docs.groupBy("sender").agg(F.count("*").alias("docs"))
    return senders.join(counts, "sender", "left").select("sender", F.coalesce("docs", F.lit(0)).alias("docs"), F.array_join("aliases", ",").alias("aliases"))


@query("""
WITH s AS (SELECT c_custkey AS sender, c_name AS name, c_mktsegment || ' ' || (c_custkey % 40) AS alias FROM customer), r AS (SELECT DISTINCT o_custkey AS sender, upper(c_mktsegment) || ' ' || (o_orderkey % 90) AS spelling FROM orders JOIN customer ON c_custkey = o_custkey),
  o AS (SELECT sender AS owner, lower(name) AS low FROM s WHERE sender IN (SELECT sender FROM r) UNION SELECT sender, lower(alias) FROM s WHERE sender IN (SELECT sender FROM r)),
  f AS (SELECT sender, list(spelling) AS more FROM r WHERE NOT EXISTS (SELECT 1 FROM o WHERE o.low = lower(r.spelling) AND o.owner <> r.sender) GROUP BY 1)
SELECT sender, array_to_string(list_sort(list_distinct(list_concat([alias], coalesce(more, CAST([] AS VARCHAR[])))))[1:30], ',') AS aliases FROM s LEFT JOIN f USING (sender)""")
def aliases_learned(spark: SparkSession, folder: str) -> DataFrame:
    """Spellings read on a sender's documents, unless another sender owns them."""
    customers = scan(spark, folder, "customer")
    senders = customers.select(F.col("c_custkey").alias("sender"), F.col("c_name").alias("name"), F.array(F.concat_ws(" ", "c_mktsegment", F.col("c_custkey") % 40)).alias("aliases"))
    read = scan(spark, folder, "orders").join(customers, F.col("c_custkey") == F.col("o_custkey")).select(F.col("o_custkey").alias("sender"), F.concat_ws(" ", F.upper("c_mktsegment"), F.col("o_orderkey") % 90).alias("spelling"))
    return desk.learned_aliases(senders, read).select("sender", F.array_join("aliases", ",").alias("aliases"))


@query("""
SELECT s_suppkey, CASE WHEN s_suppkey % 3 = 0 THEN s_nationkey ELSE s_nationkey + 100 END AS nation, CASE WHEN s_suppkey % 5 = 0 THEN s_name ELSE 'new ' || s_name END AS name, s_suppkey % 3 = 0 AS edited FROM supplier""")
def provenance(spark: SparkSession, folder: str) -> DataFrame:
    """Only what no user or scanner has set is written anew."""
    key = F.col("s_suppkey")
    sources = F.create_map(F.lit("nation"), F.when(key % 3 == 0, "user").otherwise("auto"), F.lit("name"), F.when(key % 5 == 0, "scanner").otherwise("auto"), F.lit("tags_removed"), F.lit("user"))
    patch = F.create_map(F.lit("nation"), (F.col("s_nationkey") + 100).cast("string"), F.lit("name"), F.concat(F.lit("new "), "s_name"))
    rows = scan(spark, folder, "supplier").select("s_suppkey", "s_nationkey", "s_name", sources.alias("sources"), desk.patched(sources, patch).alias("patch"))
    nation = F.coalesce(F.col("patch")["nation"].cast("long"), F.col("s_nationkey").cast("long"))
    return rows.select("s_suppkey", nation.alias("nation"), F.coalesce(F.col("patch")["name"], "s_name").alias("name"), desk.user_edited(F.col("sources")).alias("edited"))


_TITLE = "CASE p_size % 6 WHEN 0 THEN 'Scan ' || p_partkey WHEN 1 THEN '2024-01-' || p_size WHEN 2 THEN 'untitled' WHEN 3 THEN p_name WHEN 4 THEN p_brand || ' – ' || p_name ELSE 'from ' || p_brand || ' ' || p_type END"


@query(rf"""
WITH t AS (SELECT p_partkey, p_brand, {_TITLE} AS title FROM part), c AS (SELECT *, regexp_replace(trim(regexp_replace(replace(title, p_brand, ''), '\s{{2,}}', ' ', 'g'), ' -–—:,|/'), '(?i)^(von|vom|der|des|from)\s+|\s+(von|vom|der|des|from)$', '', 'g') AS bare FROM t)
SELECT p_partkey, title, regexp_matches(title, '(?i)^\s*(scan|scanned|dokument|document|img|image|bild|datei|file|unbenannt|untitled|neu|new|seite|page|brief|letter|[0-9][0-9\s._-]*)\b[\s0-9._-]*$') AS generic,
  CASE WHEN length(bare) >= 6 THEN bare ELSE title END AS bare FROM c""")
def title_checks(spark: SparkSession, folder: str) -> DataFrame:
    """Titles that say nothing; titles without the sender's name."""
    size, key = F.col("p_size") % 6, F.col("p_partkey")
    title = (
        F.when(size == 0, F.concat(F.lit("Scan "), key)).when(size == 1, F.concat(F.lit("2024-01-"), "p_size")).when(size == 2, "untitled").when(size == 3, F.col("p_name"))
        .when(size == 4, F.concat("p_brand", F.lit(" – "), "p_name")).otherwise(F.concat(F.lit("from "), "p_brand", F.lit(" "), "p_type"))
    )
    rows = scan(spark, folder, "part").select("p_partkey", "p_brand", title.alias("title"))
    return rows.select("p_partkey", "title", desk.generic_title(F.col("title")).alias("generic"), desk.without_sender(F.col("title"), F.col("p_brand")).alias("bare"))


@query("""
SELECT DISTINCT p_brand, p_type, p_brand || ' – ' || CASE WHEN p_type LIKE '%s' THEN p_type WHEN p_type LIKE '%y' THEN substring(p_type, 1, length(p_type) - 1) || 'ies' ELSE p_type || 's' END AS name FROM part""")
def series_names(spark: SparkSession, folder: str) -> DataFrame:
    return scan(spark, folder, "part").select("p_brand", "p_type", desk.series_name(F.col("p_brand"), F.col("p_type")).alias("name")).distinct()


_SERIES = """d AS (SELECT o_orderkey AS doc_id, o_custkey AS series, o_orderdate AS up, strftime(o_orderdate, '%Y-%m') AS period, o_orderkey % 4 = 1 AS by_user,
  CASE o_orderkey % 3 WHEN 0 THEN 'Bill ' || strftime(o_orderdate, '%Y-%m') WHEN 1 THEN 'Statement of ' || year(o_orderdate) ELSE 'Letter' END AS title FROM orders)"""


@query(f"""
WITH {_SERIES}, n AS (SELECT *, row_number() OVER (PARTITION BY series ORDER BY up DESC, doc_id DESC) AS n FROM d), s AS (SELECT series, list(struct_pack(doc := doc_id, title := title, by_user := by_user, period := period) ORDER BY n) AS s FROM n WHERE n <= 11 GROUP BY 1),
  o AS (SELECT d.*, list_filter(s, lambda x: x.doc <> doc_id)[1:10] AS others FROM d JOIN s USING (series)),
  l AS (SELECT doc_id, title, period, list_filter(list_transform(list_filter(others, lambda x: x.by_user), lambda x: CASE WHEN contains(x.title, x.period) THEN replace(x.title, x.period, period) WHEN regexp_matches(x.title, '[0-9]{{4}}') THEN regexp_replace(x.title, '[0-9]{{4}}', period) END), lambda t: t IS NOT NULL)[1] AS learned FROM o)
SELECT doc_id, coalesce(learned, CASE WHEN length(title) >= 7 THEN title || ' – ' || 'Clerk' ELSE 'Order Clerk ' || period END) AS title FROM l""")
def generated_titles(spark: SparkSession, folder: str) -> DataFrame:
    """Titles learned from what a user called the latest of a series."""
    key, day = F.col("o_orderkey"), F.col("o_orderdate")
    title = F.when(key % 3 == 0, F.concat(F.lit("Bill "), F.date_format(day, "yyyy-MM"))).when(key % 3 == 1, F.concat(F.lit("Statement of "), F.year(day))).otherwise("Letter")
    docs = scan(spark, folder, "orders").select(key.alias("doc_id"), F.col("o_custkey").alias("series"), day.alias("uploaded_at"), title.alias("title"), (key % 4 == 1).alias("by_user"), F.date_format(day, "yyyy-MM").alias("period"))
    rows = docs.join(desk.learned_titles(docs), "doc_id", "left")
    subject = F.when(F.length("title") >= 7, F.col("title"))
    return rows.select("doc_id", desk.generated_title(F.col("learned"), subject, F.lit("Clerk"), F.lit("Order"), F.col("period")).alias("title"))


_HEADED = "h AS (SELECT p_partkey AS doc_id, CASE WHEN p_size % 10 = 0 THEN p_size END AS series, CASE WHEN p_size % 4 <> 0 THEN p_brand END AS sender, CASE WHEN p_size % 3 <> 0 THEN p_type END AS kind, CASE WHEN p_partkey % 9 <> 0 THEN lower(split_part(p_name, ' ', 1)) END AS head FROM part)"


@query(f"""
WITH {_HEADED}, b AS (SELECT *, CASE WHEN series IS NULL AND sender IS NOT NULL THEN 'p|' || sender || '|' || coalesce(kind, '') END AS base FROM h),
  n AS (SELECT *, CASE WHEN base IS NOT NULL AND head IS NOT NULL THEN count(*) OVER (PARTITION BY base, head) ELSE 0 END AS n FROM b), g AS (SELECT base, count(DISTINCT head) AS heads FROM n WHERE n >= 2 GROUP BY 1)
SELECT doc_id, CASE WHEN series IS NOT NULL THEN 's|' || series WHEN n.base IS NOT NULL THEN n.base || '|' || CASE WHEN coalesce(heads, 0) >= 2 AND n >= 2 THEN head ELSE '' END WHEN head IS NOT NULL THEN 'h|' || head ELSE 'd|' || doc_id END AS "group" FROM n LEFT JOIN g ON g.base = n.base""")
def filing_groups(spark: SparkSession, folder: str) -> DataFrame:
    size, key = F.col("p_size"), F.col("p_partkey")
    docs = scan(spark, folder, "part").select(
        key.alias("doc_id"), F.when(size % 10 == 0, size).alias("series"), F.when(size % 4 != 0, F.col("p_brand")).alias("sender"), F.when(size % 3 != 0, F.col("p_type")).alias("kind"),
        F.when(key % 9 != 0, F.lower(F.split_part("p_name", F.lit(" "), F.lit(1)))).alias("head"),
    )
    return desk.grouped_for_filing(docs)


@query("""
WITH w AS (SELECT DISTINCT p_brand || p_type AS grp, p_partkey, unnest(string_split(lower(p_name), ' ')) AS word FROM part), n AS (SELECT p_brand || p_type AS grp, count(*) AS items FROM part GROUP BY 1)
SELECT grp, word, count(*) AS n FROM w JOIN n USING (grp) GROUP BY grp, word, items HAVING count(*) >= greatest(1, ceil(items / 2))""")
def group_top_words(spark: SparkSession, folder: str) -> DataFrame:
    rows = scan(spark, folder, "part").select(F.concat("p_brand", "p_type").alias("grp"), "p_partkey", F.explode(F.split(F.lower("p_name"), " ")).alias("word"))
    return desk.top_words(rows, "grp", "p_partkey", "word")
