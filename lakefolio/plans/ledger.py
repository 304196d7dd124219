"""Jobs, alterations, findings and lists. Orders stand for jobs and alterations,
their lines' parts for the documents that they name."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import ledger
from ..operators.skew import parts_of
from ..sources.tables import scan
from .book import query

_STAGES = {"intake": ("assemble", "sanitize", "enhance"), "process": ("ocr", "analyze", "index")}


@query("""
WITH j AS (SELECT o_orderkey AS job, CASE WHEN o_orderkey % 3 = 0 THEN 'intake' WHEN o_orderkey % 3 = 1 THEN 'process' ELSE 'index' END AS kind, ['assemble', 'sanitize', 'enhance', 'ocr', 'analyze', 'index'][1 + o_custkey % 6] AS stage,
    CASE o_orderstatus WHEN 'O' THEN 'running' WHEN 'F' THEN 'done' ELSE 'failed' END AS state, o_orderkey % 2 = 0 AS cancelled, CAST(o_orderkey % 9 AS INTEGER) AS pages, o_orderdate AS started_at FROM orders),
  e AS (SELECT *, CASE WHEN state <> 'running' THEN started_at + to_seconds(CAST(job % 977 AS INTEGER)) WHEN state = 'running' THEN TIMESTAMP '2025-01-01' END AS stop FROM j)
SELECT job, CAST(coalesce(CASE kind WHEN 'intake' THEN list_position(['assemble', 'sanitize', 'enhance'], stage) WHEN 'process' THEN list_position(['ocr', 'analyze', 'index'], stage) ELSE 0 END, 0) AS INTEGER) AS step, CASE WHEN kind = 'index' THEN 0 ELSE 3 END AS steps,
  CASE state WHEN 'done' THEN 'done' WHEN 'failed' THEN CASE WHEN cancelled THEN 'cancelled' ELSE 'failed' END ELSE '' END AS outcome, round(epoch_us(stop) / 1e6 - epoch_us(started_at) / 1e6, 1) AS seconds,
  CAST(CASE stage WHEN 'analyze' THEN greatest(600, 300 + 120) WHEN 'enhance' THEN 600 + 60 * greatest(0, pages - 1) WHEN 'ocr' THEN 600 + 60 * greatest(0, pages - 1) ELSE 600 END AS DOUBLE) AS allowed FROM e""")
def job_queue(spark: SparkSession, folder: str) -> DataFrame:
    key, status = F.col("o_orderkey"), F.col("o_orderstatus")
    stage = F.get(F.array(*map(F.lit, ("assemble", "sanitize", "enhance", "ocr", "analyze", "index"))), (F.col("o_custkey") % 6).cast("int"))
    state = F.when(status == "O", "running").when(status == "F", "done").otherwise("failed")
    jobs = scan(spark, folder, "orders").select(
        key.alias("job"), F.when(key % 3 == 0, "intake").when(key % 3 == 1, "process").otherwise("index").alias("kind"), stage.alias("stage"), state.alias("state"),
        F.when(key % 2 == 0, "Cancelled").otherwise("Broken").alias("last_error"), (key % 9).cast("int").alias("pages"), F.col("o_orderdate").alias("started_at"),
        F.when(state != "running", F.col("o_orderdate") + F.make_dt_interval(secs=(key % 977).cast("decimal(18,6)"))).alias("finished_at"),
    )
    rows = ledger.queue_rows(jobs, F.lit("2025-01-01").cast(jobs.schema["started_at"].dataType), _STAGES)
    return rows.select("job", "step", "steps", "outcome", "seconds", ledger.stage_limit(F.col("stage"), F.col("pages")).cast("double").alias("allowed"))


@query("""
WITH s AS (SELECT event_id, CASE event_id % 4 WHEN 0 THEN NULL WHEN 1 THEN 'x' ELSE CAST(value AS VARCHAR) END AS raw FROM events)
SELECT event_id, greatest(0.5, least(20, coalesce(TRY_CAST(raw AS DOUBLE), 5))) AS angle, 1.0 AS paper FROM s""")
def settings_clamped(spark: SparkSession, folder: str) -> DataFrame:
    key = F.col("event_id") % 4
    raw = F.create_map(F.lit("angle"), F.when(key == 0, None).when(key == 1, "x").otherwise(F.col("value").cast("string")))
    out = ledger.clamped(F.col("m"), {"angle": (5.0, 0.5, 20.0), "paper": (3.0, 0.0, 1.0)})
    return scan(spark, folder, "events").select("event_id", raw.alias("m")).select("event_id", out.alias("s")).select("event_id", "s.*")


_ALTERATIONS = """x AS (SELECT l_orderkey AS alteration, list(DISTINCT l_partkey ORDER BY l_partkey) AS docs FROM lineitem GROUP BY 1),
  a AS (SELECT alteration, ['compose', 'edit', 'restore', 'compose'][1 + alteration % 4] AS kind, docs[1:2] AS sources, docs[2:4] AS results, docs[5:6] AS retired, alteration % 10 = 0 AS undone FROM x)"""
_TRASH = "d AS (SELECT p_partkey AS document, p_size % 12 = 0 AS deleted FROM part WHERE p_partkey % 50 <> 0)"


def _alterations(spark: SparkSession, folder: str) -> DataFrame:
    key = F.col("alteration")
    lines = scan(spark, folder, "lineitem").select("l_orderkey", "l_partkey")
    rows = lines.repartition(parts_of(lines.count()), "l_orderkey").groupBy(F.col("l_orderkey").alias("alteration")).agg(F.array_sort(F.collect_set("l_partkey")).alias("docs"))
    kinds = F.get(F.array(*map(F.lit, ("compose", "edit", "restore", "compose"))), (key % 4).cast("int"))
    return rows.select(key, kinds.alias("kind"), *(F.slice("docs", low, n).alias(name) for name, low, n in (("sources", 1, 2), ("results", 2, 3), ("retired", 5, 2))), F.when(key % 10 == 0, F.lit("2024-01-01")).alias("undone_at"))


@query(f"""
WITH {_ALTERATIONS}, r AS (SELECT alteration, 'sources' AS role, unnest(sources) AS document FROM a UNION ALL SELECT alteration, 'results', unnest(results) FROM a UNION ALL SELECT alteration, 'retired', unnest(retired) FROM a)
SELECT document, role, count(*) AS n, min(alteration) AS first, max(alteration) AS last FROM r GROUP BY 1, 2""")
def replacement_lineage(spark: SparkSession, folder: str) -> DataFrame:
    rows = ledger.lineage(_alterations(spark, folder))
    return rows.groupBy("document", "role").agg(F.count("*").alias("n"), F.min("alteration").alias("first"), F.max("alteration").alias("last"))


@query(f"""
WITH {_ALTERATIONS}, {_TRASH}, m AS (SELECT alteration, kind, undone, CASE WHEN kind = 'restore' THEN results ELSE list_filter(results, lambda x: NOT list_contains(sources, x)) END AS made, CASE WHEN kind = 'restore' THEN [] ELSE retired END AS back FROM a),
  n AS (SELECT alteration, true AS new, unnest(made) AS document FROM m UNION ALL SELECT alteration, false, unnest(back) FROM m),
  c AS (SELECT alteration, count(*) FILTER (new AND coalesce(deleted, true)) AS lost, count(*) FILTER (NOT new AND NOT coalesce(deleted, true)) AS restored FROM n LEFT JOIN d USING (document) GROUP BY 1),
  w AS (SELECT alteration, CASE WHEN undone THEN 'undone' WHEN kind = 'edit' THEN 'edit' WHEN coalesce(lost, 0) > 0 THEN 'lost' WHEN coalesce(restored, 0) > 0 THEN 'restored' ELSE '' END AS why FROM m LEFT JOIN c USING (alteration))
SELECT alteration, why = '' AS undoable, why FROM w""")
def undo_check(spark: SparkSession, folder: str) -> DataFrame:
    docs = scan(spark, folder, "part").filter("p_partkey % 50 <> 0").select(F.col("p_partkey").alias("document"), F.when(F.col("p_size") % 12 == 0, "x").alias("deleted_at"))
    return ledger.undoable(_alterations(spark, folder), docs)


@query("""
WITH p AS (SELECT p_partkey AS document, md5(p_name || p_brand) AS content_hash, p_size % 3 = 0 AS trashed FROM part)
SELECT document, count(*) OVER (PARTITION BY content_hash) = 1 AND content_hash NOT IN (SELECT content_hash FROM p WHERE NOT trashed) AS restorable FROM p WHERE trashed""")
def restore_check(spark: SparkSession, folder: str) -> DataFrame:
    parts = scan(spark, folder, "part").select(F.col("p_partkey").alias("document"), F.md5(F.concat("p_name", "p_brand")).alias("content_hash"), (F.col("p_size") % 3 == 0).alias("trashed"))
    return ledger.restorable(parts.filter("trashed"), parts.filter("NOT trashed"))


@query("""
WITH p AS (SELECT l_orderkey AS a, l_partkey, l_linenumber FROM lineitem), f AS (
  SELECT 'twice' AS kind, [CAST(a AS VARCHAR), CAST(l_partkey AS VARCHAR)] AS documents, CAST(NULL AS VARCHAR) AS action FROM p
  UNION ALL SELECT 'twice', [CAST(l_partkey AS VARCHAR), CAST(a AS VARCHAR)], NULL FROM p WHERE a % 2 = 0
  UNION ALL SELECT 'split', [CAST(a AS VARCHAR)], '{"type":"compose","sources":["' || a || '"],"outputs":[{"pages":[{"document":"' || a || '","page":' || l_linenumber || '}],"title":""}]}' FROM p)
SELECT kind, array_to_string(min(documents), '+') AS documents, min(action) AS action, count(*) > 0 AS kept FROM f GROUP BY kind, list_sort(documents), coalesce(action, '')""")
def findings_once(spark: SparkSession, folder: str) -> DataFrame:
    """Findings of three checks; the same said twice counts once."""
    a, b = F.col("l_orderkey").cast("string"), F.col("l_partkey").cast("string")
    lines, none = scan(spark, folder, "lineitem"), F.lit(None).cast("string").alias("action")
    page = F.array(F.array(F.struct(a.alias("document"), F.col("l_linenumber").alias("page"))))
    twice = lines.select(F.lit("twice").alias("kind"), F.array(a, b).alias("documents"), none)
    again = lines.filter("l_orderkey % 2 = 0").select(F.lit("twice").alias("kind"), F.array(b, a).alias("documents"), none)
    split = lines.select(F.lit("split").alias("kind"), F.array(a).alias("documents"), ledger.composed(F.array(a), page).alias("action"))
    return ledger.findings_united([twice, again, split]).select("kind", F.array_join("documents", "+").alias("documents"), "action", F.lit(True).alias("kept"))


@query("""
WITH f AS (SELECT l_orderkey AS task, l_linenumber AS finding, CASE l_returnflag WHEN 'R' THEN 'drop' WHEN 'A' THEN 'keep' END AS verdict FROM lineitem), d AS (SELECT l_orderkey AS task, l_linenumber AS finding FROM lineitem WHERE l_partkey % 3 = 0)
SELECT task, count(*) AS open FROM f WHERE coalesce(verdict, '') <> 'drop' AND NOT EXISTS (SELECT 1 FROM d WHERE d.task = f.task AND d.finding = f.finding) GROUP BY 1""")
def open_findings(spark: SparkSession, folder: str) -> DataFrame:
    flag, task, finding = F.col("l_returnflag"), F.col("l_orderkey").alias("task"), F.col("l_linenumber").alias("finding")
    lines = scan(spark, folder, "lineitem")
    found = lines.select(task, finding, F.when(flag == "R", "drop").when(flag == "A", "keep").alias("verdict"))
    return ledger.open_findings(found, lines.filter("l_partkey % 3 = 0").select(task, finding)).groupBy("task").agg(F.count("*").alias("open"))


@query("""
WITH own AS (SELECT DISTINCT l_suppkey AS doc_id, p_brand || '/' || p_type AS tag FROM lineitem JOIN part ON p_partkey = l_partkey), u AS (SELECT tag, count(*) AS n FROM own GROUP BY 1), i AS (SELECT DISTINCT doc_id FROM own),
  r AS (SELECT i.doc_id, u.tag, u.n, CASE WHEN o.tag IS NULL THEN 1 ELSE 0 END AS rank FROM i CROSS JOIN u LEFT JOIN own o ON o.doc_id = i.doc_id AND o.tag = u.tag)
SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY rank, n DESC, tag) AS place, tag FROM r QUALIFY place <= 80""")
def tag_ranking(spark: SparkSession, folder: str) -> DataFrame:
    parts = scan(spark, folder, "part").select("p_partkey", F.concat_ws("/", "p_brand", "p_type").alias("tag"))
    own = scan(spark, folder, "lineitem").join(parts, F.col("l_partkey") == F.col("p_partkey")).select(F.col("l_suppkey").alias("doc_id"), "tag").distinct()
    return ledger.ranked_tags(own.groupBy("tag").agg(F.count("*").alias("n")), own)


@query("""
WITH d AS (SELECT o_custkey AS series, o_orderdate AS day, o_orderstatus <> 'F' AS active FROM orders), c AS (SELECT series, count(*) FILTER (active) AS active, max(day) AS latest FROM d GROUP BY 1)
SELECT c_custkey AS series, coalesce(active, 0) AS active, latest FROM customer LEFT JOIN c ON series = c_custkey WHERE NOT c_custkey % 2 = 0 OR coalesce(active, 0) > 0""")
def series_overview(spark: SparkSession, folder: str) -> DataFrame:
    docs = scan(spark, folder, "orders").select(F.col("o_custkey").alias("series"), F.col("o_orderdate").alias("day"), F.when(F.col("o_orderstatus") == "F", "x").alias("deleted_at"))
    series = scan(spark, folder, "customer").select(F.col("c_custkey").alias("series"), (F.col("c_custkey") % 2 == 0).alias("suggested"))
    return ledger.series_list(series, docs)


@query("""
WITH d AS (SELECT o_orderkey AS doc_id, o_custkey AS target, o_custkey % 4 <> 0 AS new, CASE WHEN o_orderkey % 8 <> 0 THEN year(o_orderdate) END AS year, o_orderpriority < '3' AS recurring FROM orders),
  e AS (SELECT DISTINCT c_custkey AS target FROM customer WHERE c_custkey % 8 = 0),
  s AS (SELECT target, CASE WHEN any_value(new) THEN count(*) >= 3 AND (count(DISTINCT year) >= 2 OR 2 * count(*) FILTER (recurring) >= count(*)) ELSE any_value(target IN (SELECT target FROM e)) END AND count(DISTINCT year) > 0 AS split FROM d GROUP BY 1)
SELECT doc_id, target, CASE WHEN split THEN year END AS year FROM d JOIN s USING (target)""")
def year_split(spark: SparkSession, folder: str) -> DataFrame:
    docs = scan(spark, folder, "orders").select(
        F.col("o_orderkey").alias("doc_id"), F.col("o_custkey").alias("target"), (F.col("o_custkey") % 4 != 0).alias("new"), F.when(F.col("o_orderkey") % 8 != 0, F.year("o_orderdate").cast("long")).alias("year"), (F.col("o_orderpriority") < "3").alias("recurring")
    )
    existing = scan(spark, folder, "customer").filter("c_custkey % 8 = 0").select(F.col("c_custkey").alias("target"), F.lit(1996).alias("year"))
    return ledger.year_folders(docs, existing)


_NAME = "['API_KEY', 'user', 'db_password', 'TOKEN_FILE', 'signing_key', 'keyboard', 'PASSWORD_HASHERS', 'private_note'][CAST(1 + event_id % 8 AS INTEGER)]"


@query(f"""
WITH s AS (SELECT event_id, {_NAME} AS name, CASE WHEN event_id % 5 <> 0 THEN event_type ELSE '' END AS value FROM events),
  u AS (SELECT *, upper(name) AS u FROM s), k AS (SELECT *, (contains(u, 'SECRET') OR contains(u, 'PASSWORD') OR contains(u, 'TOKEN') OR contains(u, 'API_KEY') OR contains(u, 'PRIVATE') OR ends_with(u, '_KEY')) AND NOT (ends_with(u, '_FILE') OR ends_with(u, '_HASHERS')) AS secret FROM u)
SELECT event_id, name, CASE WHEN secret AND value = '' THEN 'empty' WHEN secret THEN 'set (' || length(value) || ' chars)' ELSE value END AS shown FROM k""")
def settings_shown(spark: SparkSession, folder: str) -> DataFrame:
    names = F.array(*map(F.lit, ("API_KEY", "user", "db_password", "TOKEN_FILE", "signing_key", "keyboard", "PASSWORD_HASHERS", "private_note")))
    rows = scan(spark, folder, "events").select("event_id", F.get(names, (F.col("event_id") % 8).cast("int")).alias("name"), F.when(F.col("event_id") % 5 != 0, F.col("event_type")).otherwise("").alias("value"))
    return rows.select("event_id", "name", ledger.shown_setting(F.col("name"), F.col("value")).alias("shown"))


@query("""
WITH h AS (SELECT doc_id, sha256(coalesce(text, '')) AS a, sha256('x' || coalesce(text, '')) AS b FROM documents)
SELECT doc_id, CAST(list_sum(list_transform(range(64), lambda i: bit_count(xor(CAST(strpos('0123456789abcdef', a[i + 1]) - 1 AS UTINYINT), CAST(strpos('0123456789abcdef', b[i + 1]) - 1 AS UTINYINT))))) AS INTEGER) AS bits FROM h""")
def hash_distance(spark: SparkSession, folder: str) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    rows = scan(spark, folder, "documents").select("doc_id", F.sha2(text, 256).alias("a"), F.sha2(F.concat(F.lit("x"), text), 256).alias("b"))
    return rows.select("doc_id", ledger.hamming(F.col("a"), F.col("b")).cast("int").alias("bits"))


@query("""
WITH n AS (SELECT p_partkey, p_size, CASE WHEN p_size % 5 = 0 THEN ' ' || p_brand || ' /' || p_type || '/ x\\y' WHEN p_size % 7 = 0 THEN p_brand || '//' || p_type ELSE p_brand || ' / ' || p_type END AS path, CASE p_size % 4 WHEN 0 THEN 'Post@Mail.example.COM ' WHEN 1 THEN '@Firm.example' WHEN 2 THEN 'nobody' ELSE 'a b@c.de' END AS entry FROM part),
  t AS (SELECT *, list_transform(string_split(path, '/'), lambda x: trim(x)) AS names FROM n)
SELECT p_partkey, CASE WHEN len(list_filter(names, lambda x: x = '' OR contains(x, chr(92)))) = 0 THEN array_to_string(names, '|') END AS names, CASE p_size % 4 WHEN 0 THEN 'post@mail.example.com' WHEN 1 THEN '@firm.example' END AS entry FROM t""")
def clean_entries(spark: SparkSession, folder: str) -> DataFrame:
    size, kind, brand = F.col("p_size"), F.col("p_type"), F.col("p_brand")
    path = F.when(size % 5 == 0, F.concat(F.lit(" "), brand, F.lit(" /"), kind, F.lit("/ x\\y"))).when(size % 7 == 0, F.concat(brand, F.lit("//"), kind)).otherwise(F.concat(brand, F.lit(" / "), kind))
    entry = F.when(size % 4 == 0, "Post@Mail.example.COM ").when(size % 4 == 1, "@Firm.example").when(size % 4 == 2, "nobody").otherwise("a b@c.de")
    return scan(spark, folder, "part").select("p_partkey", F.array_join(ledger.clean_names(F.split(path, "/")), "|").alias("names"), ledger.sender_entry(entry).alias("entry"))


@query(r"""
WITH w AS (SELECT doc_id, lower(unnest(regexp_extract_all(text, '[\p{L}\p{N}_]+'))) AS w FROM documents), p AS (SELECT doc_id, w, strip_accents(w) AS plain, count(*) AS n FROM w GROUP BY 1, 2),
  b AS (SELECT doc_id, plain, w FROM p QUALIFY row_number() OVER (PARTITION BY doc_id, plain ORDER BY n DESC, w) = 1), s AS (SELECT doc_id, list(plain ORDER BY plain) AS plain, list(w ORDER BY plain) AS spelled FROM b WHERE w <> plain GROUP BY 1),
  t AS (SELECT doc_id, string_split(text, ' ') AS words, plain, spelled FROM documents JOIN s USING (doc_id))
SELECT doc_id, len(list_filter(words, lambda x: list_position(plain, lower(x)) > 0)) AS restored, len(plain) AS known FROM t""")
def diacritics_restored(spark: SparkSession, folder: str) -> DataFrame:
    """Words without accents that their document mostly spells with them."""
    docs = ledger.accented_spellings(scan(spark, folder, "documents"))
    rows = docs.select("doc_id", "plain", "text", ledger.restored_diacritics(F.col("text"), F.col("plain"), F.col("spelled")).alias("new"))
    changed = F.zip_with(F.split("text", " "), F.split("new", " "), lambda a, b: a != b)
    return rows.select("doc_id", F.size(F.filter(changed, lambda x: x)).cast("long").alias("restored"), F.size("plain").cast("long").alias("known"))


@query("""
WITH d AS (SELECT o_orderkey AS doc_id, o_orderdate AS day FROM orders WHERE o_orderstatus = 'F')
SELECT doc_id, total, 'trash' AS list FROM (SELECT doc_id, count(*) OVER () AS total FROM d ORDER BY day DESC, doc_id DESC LIMIT 500)
UNION ALL SELECT doc_id, total, 'selected' FROM (SELECT o_orderkey AS doc_id, count(*) OVER () AS total FROM orders WHERE o_orderstatus <> 'F' ORDER BY o_orderkey LIMIT 500)
UNION ALL SELECT doc_id, total, 'unfiled' FROM (SELECT o_orderkey AS doc_id, count(*) OVER () AS total FROM orders WHERE o_orderstatus = 'O' AND o_orderpriority = '5-LOW' ORDER BY o_orderdate, o_orderkey LIMIT 200)""")
def capped_lists(spark: SparkSession, folder: str) -> DataFrame:
    """Lists that end by definition, with the whole number beside."""
    orders = scan(spark, folder, "orders").select(F.col("o_orderkey").alias("doc_id"), F.col("o_orderdate").alias("day"), "o_orderstatus", "o_orderpriority")

    def first(rows: DataFrame, most: int, name: str, *order) -> DataFrame:
        total = rows.agg(F.count("*").alias("total"))
        return rows.orderBy(*order).limit(most).crossJoin(F.broadcast(total)).select("doc_id", "total", F.lit(name).alias("list"))

    trash = first(orders.filter("o_orderstatus = 'F'"), 500, "trash", F.desc("day"), F.desc("doc_id"))
    chosen = first(orders.filter("o_orderstatus <> 'F'"), 500, "selected", "doc_id")
    return trash.unionByName(chosen).unionByName(first(orders.filter("o_orderstatus = 'O' AND o_orderpriority = '5-LOW'"), 200, "unfiled", "day", "doc_id"))


@query("""
WITH p AS (SELECT o_orderkey AS doc_id, CASE WHEN o_custkey % 4 <> 0 THEN o_custkey % 25 END AS folder, o_orderdate AS up FROM orders WHERE o_orderstatus = 'O' AND o_orderpriority <> '5-LOW')
SELECT coalesce(CAST(folder AS VARCHAR), 'No folder') AS folder, count(*) AS pending, min(up) AS oldest, round(count(*) * 0.1, 1) AS mm FROM p GROUP BY 1""")
def paper_pending(spark: SparkSession, folder: str) -> DataFrame:
    """Paper that is nowhere yet, by folder, those without one last."""
    paper = scan(spark, folder, "orders").filter("o_orderstatus = 'O' AND o_orderpriority <> '5-LOW'")
    rows = paper.groupBy(F.when(F.col("o_custkey") % 4 != 0, F.col("o_custkey") % 25).alias("at")).agg(F.count("*").alias("pending"), F.min("o_orderdate").alias("oldest"))
    return rows.orderBy(F.asc_nulls_last("at")).select(F.coalesce(F.col("at").cast("string"), F.lit("No folder")).alias("folder"), "pending", "oldest", F.round(F.col("pending") * 0.1, 1).alias("mm"))
