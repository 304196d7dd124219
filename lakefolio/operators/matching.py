"""Matching names and phrases with a dictionary."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from . import closeness
from .closeness import ratio

__all__ = ["last_rule", "lookup", "ratio"]


def lookup(names: DataFrame, column: str, dictionary: dict[str, list[str]] | DataFrame, least: float = 90, letters: int = 4) -> DataFrame:
    """Adds `match` and `how`: the entry that a name means.

    dictionary: a table (entry, name, how), how "name" or "alias", of any size;
    or a setting, entry to aliases. In this order: the name itself without regard
    to case, an alias, equal folded labels, and the highest ratio of `least` or
    more of folded labels of `letters` or more; ties go to the smaller entry.
    Ratios are joined for, once a distinct name that nothing else matched. No
    match: nulls.
    """
    table = dictionary
    if isinstance(dictionary, dict):
        pairs = [(e, n, how) for e, aliases in dictionary.items() for n, how in [(e, "name"), *((a, "alias") for a in aliases)]]
        table = names.sparkSession.createDataFrame(pairs, "entry string, name string, how string")
    table = table.select("entry", "name", "how")
    rank = F.struct((F.col("how") != "name").alias("late"), F.col("entry"))
    exact = table.groupBy(F.lower("name").alias("_lower")).agg(F.min_by("entry", rank).alias("_exact"), F.min_by("how", rank).alias("_how"))
    folded = table.select("entry", T.label(F.col("name")).alias("_label")).filter("_label <> ''").groupBy("_label").agg(F.min("entry").alias("_folded"))
    known = names.withColumns({"_lower": F.lower(column), "_label": T.label(F.col(column))})
    joined = known.join(exact, "_lower", "left").join(folded, "_label", "left")
    loose = joined.filter("_exact IS NULL AND _folded IS NULL").select(F.col("_label").alias("label"))
    long = F.length("label") >= letters
    pairs = closeness.close(loose.filter(long), folded.select(F.col("_label").alias("label")).filter(long), least)
    near = pairs.join(folded.withColumnRenamed("_label", "other"), "other").groupBy(F.col("label").alias("_label")).agg(F.min_by("_folded", F.struct(-F.col("ratio"), "_folded")).alias("_near"))
    out = joined.join(near, "_label", "left")
    how = F.when(F.col("_exact").isNotNull(), F.col("_how")).when(F.col("_folded").isNotNull(), "folded").when(F.col("_near").isNotNull(), "near")
    return out.withColumns({"match": F.coalesce("_exact", "_folded", "_near"), "how": how}).drop("_lower", "_label", "_exact", "_how", "_folded", "_near")


def last_rule(text: Column, rules: list[tuple[str, str]]) -> Column:
    """What the last of (phrase, value) says whose folded phrase is in the folded
    text; null if none. The rules are a setting and become one expression."""
    folded, out = T.fold(text), F.lit(None).cast("string")
    for phrase, value in rules:
        out = F.when(folded.contains(T.fold(F.lit(phrase))), value).otherwise(out)
    return out
