"""Folders that groups of documents belong in."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import filing, placing
from ..operators.settled import settle
from ..sources.tables import scan
from .archive import _ALL_FOLDERS, _folders
from .book import query

#: Lines of fewer pieces are not filed yet.
FEW = 5
_LINES = f"""l AS (SELECT l_partkey AS folder_id, l_orderkey * 10 + l_linenumber AS doc, CAST(o_custkey AS VARCHAR) AS series, CAST(l_suppkey AS VARCHAR) AS sender, l_returnflag || l_linestatus AS kind,
    string_split(p_name, ' ') AS words, lower(p_type) AS clue, l_suppkey || '/' || l_returnflag || '/' || l_linenumber AS grp, l_quantity < {FEW} AS fresh FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN part ON p_partkey = l_partkey)"""


def _lines(spark: SparkSession, folder: str) -> DataFrame:
    """Lines as documents in the folders of their parts."""
    part = scan(spark, folder, "part").select(F.col("p_partkey").alias("l_partkey"), F.split("p_name", " ").alias("words"), F.array(F.lower("p_type")).alias("clues"))
    orders = scan(spark, folder, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").cast("string").alias("series"))
    rows = scan(spark, folder, "lineitem").join(orders, "l_orderkey").join(part, "l_partkey")
    return rows.select(
        F.col("l_partkey").alias("folder_id"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("doc"), "series", F.col("l_suppkey").cast("string").alias("sender"), F.concat("l_returnflag", "l_linestatus").alias("kind"),
        "words", "clues", F.concat_ws("/", "l_suppkey", "l_returnflag", "l_linenumber").alias("group"), (F.col("l_quantity") < FEW).alias("fresh"),
    )


@query(f"""
WITH RECURSIVE f AS ({_ALL_FOLDERS}), {_LINES}, up AS (SELECT folder_id, folder_id AS a FROM f UNION ALL SELECT up.folder_id, f.parent_id FROM up JOIN f ON f.folder_id = up.a WHERE f.parent_id IS NOT NULL),
  own AS (SELECT a AS folder_id, l.* EXCLUDE (folder_id) FROM l JOIN up USING (folder_id) WHERE NOT fresh), tot AS (SELECT folder_id, count(*) AS total FROM own GROUP BY 1),
  w AS (SELECT folder_id, 'word' AS what, value FROM (SELECT folder_id, doc, unnest(list_distinct(words)) AS value FROM own) JOIN tot USING (folder_id) GROUP BY folder_id, value, total HAVING count(*) >= 0.3 * total),
  k AS (SELECT DISTINCT folder_id, 'series' AS what, series AS value FROM own UNION SELECT folder_id, 'sender', sender FROM own UNION SELECT folder_id, 'kind', kind FROM own UNION SELECT * FROM w UNION SELECT folder_id, 'name', unnest(string_split(lower(name), ' ')) FROM f),
  g AS (SELECT * FROM l WHERE fresh), n AS (SELECT grp, count(*) AS n, arg_min(clue, (doc, clue)) AS clue FROM g GROUP BY 1),
  gw AS (SELECT grp, value, n, clue FROM (SELECT grp, doc, unnest(list_distinct(words)) AS value FROM g) JOIN n USING (grp) GROUP BY grp, value, n, clue HAVING 2 * count(*) >= n),
  q AS (SELECT grp, 'series' AS what, series AS value, 3.0 * count(*) / n AS points FROM g JOIN n USING (grp) GROUP BY grp, series, n UNION ALL SELECT grp, 'sender', sender, 1.5 * count(*) / n FROM g JOIN n USING (grp) GROUP BY grp, sender, n
    UNION ALL SELECT grp, 'kind', kind, 0.5 * count(*) / n FROM g JOIN n USING (grp) GROUP BY grp, kind, n UNION ALL SELECT grp, 'word', value, 2.0 / count(*) OVER (PARTITION BY grp) FROM gw
    UNION ALL SELECT DISTINCT grp, 'name', value, 2.0 FROM (SELECT grp, value FROM gw UNION SELECT grp, clue FROM n)),
  s AS (SELECT grp, folder_id, round(coalesce(sum(points) FILTER (what <> 'name'), 0) + coalesce(max(points) FILTER (what = 'name'), 0), 9) AS points FROM q JOIN k USING (what, value) GROUP BY 1, 2),
  b AS (SELECT grp, coalesce(parent_id, -1) AS parent, folder_id, points FROM s JOIN f USING (folder_id) WHERE points >= 2 QUALIFY row_number() OVER (PARTITION BY grp, parent_id ORDER BY points DESC, folder_id) = 1),
  p AS (SELECT grp, CAST(-1 AS BIGINT) AS folder_id, CAST(NULL AS DOUBLE) AS points, 0 AS levels FROM n UNION ALL SELECT p.grp, b.folder_id, CAST(b.points AS DOUBLE), levels + 1 FROM p JOIN b ON b.grp = p.grp AND b.parent = p.folder_id)
SELECT grp AS "group", nullif(folder_id, -1) AS folder_id, round(points, 6) AS points, levels FROM p QUALIFY row_number() OVER (PARTITION BY grp ORDER BY levels DESC) = 1""")
def groups_placed(spark: SparkSession, folder: str) -> DataFrame:
    """Lines of few pieces, by supplier, flag and number, put among the folders of all parts."""
    lines = _lines(spark, folder)
    found = placing.placed(lines.filter("fresh"), _folders(spark, folder, whole=True), lines.filter("NOT fresh"))
    return found.withColumn("points", F.round("points", 6))


#: Priorities of orders, and the folder that orders of them are wished into.
WISHES = [("1-URGENT", "Red Widget"), ("2-HIGH", "Small Parts"), ("5-LOW", "hot gear")]
_RULE = " ".join(f"WHEN o_orderpriority = '{kind}' THEN {n}" for n, (kind, _) in enumerate(WISHES))
_NAME = f"['{"', '".join(name for _, name in WISHES)}'][rule + 1]"
#: An order lies in the folder of a quarter of its customer's number, every ninth customer's at the top level.
_FILED = f"d AS (SELECT o_orderkey AS id, CASE WHEN o_custkey % 9 > 0 THEN o_custkey // 4 END AS base, CASE {_RULE} END AS rule FROM orders)"


@query(f"""
WITH RECURSIVE f AS ({_ALL_FOLDERS}), {_FILED}, t AS (SELECT *, {_NAME} AS name FROM d WHERE rule IS NOT NULL),
  up AS (SELECT folder_id, folder_id AS a, 0 AS distance FROM f UNION ALL SELECT up.folder_id, f.parent_id, distance + 1 FROM up JOIN f ON f.folder_id = up.a WHERE f.parent_id IS NOT NULL),
  pl AS (SELECT folder_id, distance, a FROM up WHERE distance > 0 UNION ALL SELECT up.folder_id, distance + 1, -1 FROM up JOIN f ON f.folder_id = up.a WHERE f.parent_id IS NULL),
  ne AS (SELECT a, lower(name) AS label, first(folder_id ORDER BY distance, folder_id) AS found FROM pl JOIN f USING (folder_id) GROUP BY 1, 2),
  w AS (SELECT id, base, rule, name, found FROM t LEFT JOIN ne ON ne.a = coalesce(base, -1) AND ne.label = lower(name)),
  mk AS (SELECT base, name, -row_number() OVER (ORDER BY base NULLS FIRST, lower(name)) AS made FROM (SELECT DISTINCT base, name FROM w WHERE found IS NULL))
SELECT id, rule, w.base AS old, coalesce(found, made) AS new, CASE WHEN found IS NULL THEN w.base ELSE found END AS anchor, CASE WHEN found IS NULL THEN w.name ELSE '' END AS names
FROM w LEFT JOIN mk ON mk.base IS NOT DISTINCT FROM w.base AND mk.name = w.name AND found IS NULL""")
def wishes_filed(spark: SparkSession, folder: str) -> DataFrame:
    """Orders moved by wishes into the nearest folders of a name, or into new ones, as far as that leads downwards."""
    customer = F.col("o_custkey")
    docs = scan(spark, folder, "orders").select(F.col("o_orderkey").alias("id"), F.when(customer % 9 > 0, F.floor(customer / 4)).alias("folder_id"), "o_orderpriority")
    folders = _folders(spark, folder, whole=True)
    wishes = settle(filing.wished(docs, [(F.col("o_orderpriority") == kind, name) for kind, name in WISHES], folders))
    overlay, places = filing.overlaid(wishes, folders)
    overlay, places = settle(overlay), settle(places)
    moves = filing.downwards(docs, places, overlay)
    targets = filing.real(moves.select("id", F.col("new").alias("folder_id")), overlay)
    return moves.join(targets, "id").join(wishes.select("id", "rule"), "id").select("id", "rule", "old", "new", "anchor", F.array_join("names", " / ").alias("names"))
