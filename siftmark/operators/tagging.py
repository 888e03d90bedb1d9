"""Phrase dictionaries: tagging by n-gram joins, alias votes and structural votes."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siftmark.functions.text import C, ngrams

from .ranking import micro


def alias_table(texts: DataFrame, key: str, label: str, text: str, least: int, size: int = 2) -> DataFrame:
    """label, phrase, weight: phrases of `size` words in `least` or more texts of a label, weighted by that number."""
    grams = ngrams(texts, [key, label], text, size)
    return grams.groupBy(label, F.col("gram").alias("phrase")).agg(F.count(F.lit(1)).alias("weight")).where(F.col("weight") >= least)


def hits(requests: DataFrame, terms: DataFrame, key: str, text: str, sizes: tuple[int, ...] = (2,), phrase: str = "phrase") -> DataFrame:
    """key and the columns of terms for each term that occurs in a request: an equi-join on word n-grams, one for each length
    that the dictionary has, never a test of every pair."""
    grams = reduce(DataFrame.unionByName, (ngrams(requests, [key], text, n) for n in sizes))
    return grams.join(terms, F.col("gram") == F.col(phrase)).drop("gram")


def tags(found: DataFrame, key: str, label: str) -> DataFrame:
    return found.select(key, label).distinct()


def span(table: DataFrame, cue: list[str], label: str) -> DataFrame:
    """cue columns and n_labels: for how many labels a cue stands."""
    return table.groupBy(*cue).agg(F.countDistinct(label).alias("n_labels"))


#: Weights of the kinds of structural cues.  The weights in use elsewhere aren't published; these are a choice.
KIND_WEIGHTS = {"pair": 3, "noun": 2, "verb": 1}


def cues(texts: DataFrame, keys: list[str], text: str) -> DataFrame:
    """keys, kind, cue.  Stand-ins that need no parser: a pair is two words side by side, a noun a content word of eight
    letters or more, a verb one of five to seven."""
    words = C.rows(texts, keys, text, distinct=True).withColumnRenamed("lemma", "cue")
    kind = F.when(F.length("cue") >= 8, "noun").when(F.length("cue") >= 5, "verb")
    pairs = ngrams(texts, keys, text, 2).select(*keys, F.lit("pair").alias("kind"), F.col("gram").alias("cue"))
    return words.select(*keys, kind.alias("kind"), "cue").where("kind IS NOT NULL").unionByName(pairs)


def associations(texts: DataFrame, key: str, label: str, text: str, least: int = 2) -> DataFrame:
    """kind, cue, label, n, share: how often a cue comes with a label, and the label's weighted share of the cue in
    millionths; cues of fewer than `least` texts are left out."""
    n = cues(texts, [key, label], text).groupBy("kind", "cue", label).agg(F.count(F.lit(1)).alias("n"))
    total = F.sum("n").over(Window.partitionBy("kind", "cue"))
    weight = F.coalesce(*(F.when(F.col("kind") == k, F.lit(w)) for k, w in KIND_WEIGHTS.items()))
    return n.withColumn("__total", total).where(F.col("__total") >= least).withColumn("share", micro(weight * F.col("n") / F.col("__total"))).drop("__total")


def structural_hits(requests: DataFrame, table: DataFrame, key: str, text: str) -> DataFrame:
    """key, kind, cue, label, n, share: one join for all kinds of cues."""
    return cues(requests, [key], text).join(table, ["kind", "cue"])


def micro_scores(predicted: DataFrame, gold: DataFrame, key: str, label: str) -> DataFrame:
    """One row: tp, n_predicted, n_gold, missed, precision, recall, f1 over label sets given as rows."""
    both = predicted.select(key, label, F.lit(1).alias("__p")).join(gold.select(key, label, F.lit(1).alias("__g")), [key, label], "full")
    n = both.agg(
        F.count_if(F.col("__p").isNotNull() & F.col("__g").isNotNull()).alias("tp"), F.count("__p").alias("n_predicted"), F.count("__g").alias("n_gold"),
        F.count_if(F.col("__p").isNull()).alias("missed"),
    )
    ratio = lambda a, b: F.coalesce(F.round(F.try_divide(a, b), 4), F.lit(0.0))
    return n.withColumns({
        "precision": ratio(F.col("tp"), F.col("n_predicted")), "recall": ratio(F.col("tp"), F.col("n_gold")), "f1": ratio(2 * F.col("tp"), F.col("n_predicted") + F.col("n_gold")),
    })


def any_correct(predicted: DataFrame, gold: DataFrame, key: str, label: str) -> DataFrame:
    """One row: n, n_right, any_correct: keys of gold with at least one right tag."""
    right = gold.select(key, label).join(predicted.select(key, label), [key, label], "left_semi").select(key).distinct().withColumn("__r", F.lit(1))
    n = gold.select(key).distinct().join(right, key, "left").agg(F.count(F.lit(1)).alias("n"), F.count("__r").alias("n_right"))
    return n.withColumn("any_correct", F.coalesce(F.round(F.try_divide("n_right", "n"), 4), F.lit(0.0)))
