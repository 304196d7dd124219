"""A training-data pipeline of five stages over `documents`.

Every stage but the last returns the columns of `documents`; each works on all
rows that the stage before it kept. A verdict is tied to a row by its id and a
hash of its text, so rows that repeat an id, or have none, are judged by their
own text; equal rows have equal verdicts. Null and empty texts fail the quality
rules; an empty table gives no rows; other columns go through unchanged.
"""

from __future__ import annotations

from uuid import uuid4

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lakefolio.llm import language, packing, pii, quality_rules, queries, simhash
from lakefolio.llm.common import bounded_batches, held_out, settle, shared_folder

#: A language is certain enough at this score; 0.5 is two languages at a tie.
LANGUAGE_SCORE = 0.51
#: Keys (about 50 bytes each) that are broadcast at most; more meet in a shuffle.
BROADCAST_KEYS = 500_000
#: Words a worker keeps while packing, fewer than by default: it has other stages' memory too.
KEPT_WORDS = 32_000


def _key() -> Column:
    """Sorts as the id does, rows without one last."""
    number = F.lpad(F.coalesce((F.col("doc_id").cast("decimal(20,0)") + F.lit(str(1 << 63)).cast("decimal(20,0)")).cast("string"), F.lit("~")), 20, "0")
    return F.concat_ws("|", number, F.xxhash64("text").cast("string"))


def _keep(docs: DataFrame, keys: DataFrame) -> DataFrame:
    """The rows of `docs` whose key is one of `keys`."""
    keys = settle(keys.select("doc_key").distinct())
    few = keys.count() <= BROADCAST_KEYS
    kept = docs.withColumn("doc_key", _key()).join(F.broadcast(keys) if few else keys, "doc_key", "left_semi")
    return kept.select(docs.columns)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps what the weakly supervised rules keep."""
    judged = quality_rules.judge(docs.withColumn("doc_key", _key()), id_col="doc_key")
    return _keep(docs, judged.filter("kept"))


def languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents in no certain language of the corpus."""
    bounded_batches(spark)
    model = language.fit(docs.filter(~held_out()))
    found = language.predict(docs.withColumn("doc_key", _key()), model, id_col="doc_key")
    return _keep(docs, found.filter((F.col("lang_pred") != language.UNKNOWN) & (F.col("score") >= LANGUAGE_SCORE)))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps of each class the document with the smallest id, once."""
    bounded_batches(spark)
    classes = settle(simhash.near_duplicates(docs.withColumn("doc_key", _key()), id_col="doc_key"))
    first = classes.filter("doc_key = component_id").groupBy("doc_key").count()
    kept = _keep(docs, first)
    if first.filter("count > 1").isEmpty():
        return kept
    return kept.withColumn("doc_key", _key()).dropDuplicates(["doc_key"]).select(docs.columns)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Surrogates for personal data; n_chars is that of the new text."""
    bounded_batches(spark)
    out = pii.pseudonymise(docs, queries.DEMO_KEY, spans_col="_pii_spans")
    return out.drop("_pii_spans").withColumn("n_chars", F.length("text").cast("long")).select(docs.columns)


def sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' pieces and their places in training sequences."""
    return packing.pack_documents(docs, queries.tokenizer(), kept=KEPT_WORDS)


STAGES = [
    ("quality_rules", quality),
    ("language_id", languages),
    ("near_duplicates", near_duplicates),
    ("personal_data", personal_data),
    ("packing", sequences),
]

#: Expectation-maximisation and fingerprints are beyond SQL; tests/llm compare
#: every stage with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages; what one returns is written as Parquet for the next, in the
    folder of spark.checkpoint.dir."""
    folder, docs = f"{shared_folder(spark).rstrip('/')}/{uuid4().hex}", spark.read.parquet(f"{sf_dir}/documents.parquet")
    for number, (name, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{number}_{name}")
        docs = spark.read.parquet(f"{folder}/{number}_{name}")
    return docs
