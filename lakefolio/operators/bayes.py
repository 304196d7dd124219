"""Naive Bayes over the sets of words of labelled documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from .settled import settle

ALPHA = 0.5


def fit(docs: DataFrame, labels: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Counts by (class, word), and by class: documents, tokens, vocabulary, share.
    Classes of one document are dropped; their words stay in the vocabulary."""
    labelled = docs.select("doc_id", "text").join(labels.select("doc_id", F.col("label").alias("class")), "doc_id")
    seen = labelled.select("class", F.explode(F.array_distinct(T.words(F.col("text")))).alias("word"))
    counts = settle(seen.groupBy("class", "word").agg(F.count("*").alias("n")))
    sizes = labels.groupBy(F.col("label").alias("class")).agg(F.count("*").alias("docs")).filter("docs >= 2")
    tokens = counts.groupBy("class").agg(F.sum("n").alias("tokens"))
    vocabulary = counts.agg(F.countDistinct("word").alias("vocabulary"))
    share = F.col("docs") / F.sum("docs").over(Window.partitionBy())
    classes = sizes.join(tokens, "class").crossJoin(F.broadcast(vocabulary)).withColumn("share", share)
    return counts, settle(classes)


#: Classes that are broadcast at most.
BROADCAST_CLASSES = 100_000
#: (class, word) weights that are broadcast at most; more meet their words in a shuffle.
BROADCAST_WEIGHTS = 2_000_000


def lookup_words(words: DataFrame, weights: DataFrame) -> DataFrame:
    """(doc_id, class, more) of the words that have weights."""
    rows = words.select("doc_id", F.explode("words").alias("word"))
    few = weights.count() <= BROADCAST_WEIGHTS
    return rows.join(F.broadcast(weights) if few else weights, "word").select("doc_id", "class", "more")


def predict(docs: DataFrame, counts: DataFrame, classes: DataFrame) -> DataFrame:
    """(doc_id, class, score): the likeliest class of every document with words.

    A class that none of a document's words is in scores by its share and the
    number of words alone, so the best of those is found once a number of words.
    Documents meet only the classes that their words are in: such a class's score
    is above what it would be without them, so the larger of both is the best.
    """
    words = docs.select("doc_id", F.array_distinct(T.words(F.col("text"))).alias("words")).filter(F.size("words") > 0)
    weight = lambda n: F.log((n + ALPHA) / (F.col("tokens") + ALPHA * (F.col("vocabulary") + 1)))
    few = F.broadcast(classes) if classes.count() <= BROADCAST_CLASSES else classes
    weights = counts.join(few, "class").select("class", "word", (weight(F.col("n")) - weight(F.lit(0))).alias("more"))
    known = lookup_words(words, weights).groupBy("doc_id", "class").agg(F.sum("more").alias("more"))
    sizes = settle(words.select("doc_id", F.size("words").alias("words")))  # texts are not cut again for each use
    base = F.log("share") + F.col("words") * weight(F.lit(0))
    unmet = sizes.select("words").distinct().crossJoin(few).select("words", "class", base.alias("score"))
    unmet = unmet.groupBy("words").agg(F.max(F.struct("score", "class")).alias("best"))
    met = known.join(sizes, "doc_id").join(few, "class").select("doc_id", F.struct((base + F.col("more")).alias("score"), "class").alias("best"))
    either = met.groupBy("doc_id").agg(F.max("best").alias("best")).unionByName(sizes.join(unmet, "words").select("doc_id", "best"))
    return either.groupBy("doc_id").agg(F.max("best").alias("best")).select("doc_id", "best.class", F.round("best.score", 4).alias("score"))


