"""Constraints: their detection in requests and the predicates they put on catalog rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The thresholds of two constraints, and what a predicted task and a met soft constraint add to a score.
EDGE_PARAMETERS, LONG_CONTEXT = 1_000_000_000, 32_768
TASK_BONUS, SOFT_BONUS = 0.15, 0.05

#: Constraint, hardness, surface forms.
LEXICON = (
    ("open_source", "hard", ("open source", "open-source", "opensource", "open weight", "open-weight", "free", "self host", "self-host", "on premise", "on-premise", "on prem")),
    ("edge", "hard", ("edge", "on device", "on-device", "mobile", "small", "tiny", "lightweight", "laptop", "raspberry pi", "low resource", "low-resource")),
    ("long_context", "hard", ("long context", "long-context", "large context", "long document", "long-document", "big context")),
    ("multilingual", "soft", ("multilingual", "many languages", "multiple languages", "cross lingual", "cross-lingual")),
    ("fast", "soft", ("fast", "low latency", "low-latency", "realtime", "real time", "real-time", "quick", "speedy", "responsive")),
)


def lexicon(spark: SparkSession, entries: tuple = LEXICON) -> DataFrame:
    """name, hardness, surface: a dimension of fixed size."""
    rows = F.array(*(F.struct(F.lit(n).alias("name"), F.lit(h).alias("hardness"), F.lit(s).alias("surface")) for n, h, surfaces in entries for s in surfaces))
    return spark.range(1).select(F.inline(rows))


def detect(requests: DataFrame, entries: DataFrame, key: str, text: str, lemma_text: str) -> DataFrame:
    """key, name, hardness of each constraint that a request names.

    A surface of several words is looked up in the lower-cased text, one of a single word in the joined lemmas, both padded
    by spaces: punctuation at a surface's side hides it, and a hyphenated single word can't be found among split lemmas."""
    within = lambda x: F.contains(F.concat(F.lit(" "), x, F.lit(" ")), F.concat(F.lit(" "), F.col("surface"), F.lit(" ")))
    found = F.when(F.contains(F.col("surface"), F.lit(" ")), within(F.lower(F.col(text)))).otherwise(within(F.col(lemma_text)))
    return requests.crossJoin(F.broadcast(entries)).where(found).select(key, "name", "hardness").distinct()


def satisfied(name: Column) -> Column:
    """Whether a catalog row meets a constraint, never null: an unknown value fails, an unknown constraint passes."""
    yes = lambda c: F.coalesce(c, F.lit(False))
    return (
        F.when(name == "open_source", yes(F.col("open_source")))
        .when(name == "edge", yes(F.col("deployable") & (F.col("parameters") <= EDGE_PARAMETERS)))
        .when(name == "long_context", yes(F.col("context_window") >= LONG_CONTEXT))
        .when(name == "multilingual", yes(F.array_contains("specialties", "multilingual")))
        .when(name == "fast", yes(F.col("deployable")))
        .otherwise(F.lit(True))
    )


def all_satisfied(names: Column) -> Column:
    """Whether a catalog row meets every constraint of an array of names."""
    return F.forall(names, satisfied)


def asked(requests: DataFrame, named: DataFrame, q: str) -> DataFrame:
    """q, hard, soft: the constraints that each request names, as arrays; empty for one that names none."""
    kind = lambda h: F.coalesce(F.array_sort(F.collect_set(F.when(F.col("hardness") == h, F.col("name")))), F.array().cast("array<string>")).alias(h)
    return requests.select(q).join(named, q, "left").groupBy(q).agg(kind("hard"), kind("soft"))


def hybrid_pick(
    candidates: DataFrame, catalog: DataFrame, dense: DataFrame | Callable[[DataFrame], DataFrame], wants: DataFrame, predicted: DataFrame, q: str, key: str, k: int = 5, popular: bool = False,
    task_bonus: float = TASK_BONUS, soft_bonus: float = SOFT_BONUS, filter_first: bool = False, sparse_k: int = 200,
) -> DataFrame:
    """q, key, task, score, rank: sparse candidates, hard constraints, then dense score and bonuses; at most k rows a query.

    wants(q, hard, soft), as `asked` gives it: every request is held to its own constraints.  candidates(q, key, rank) is cut to
    sparse_k *before* the hard constraints, which may starve it, as the semantics ask; filter_first puts the constraints
    first.  dense(q, key, dense) lacks pairs without a vector: 0; it may be a function that adds the column to the candidates,
    which then costs nothing for other pairs.  predicted(q, task) adds task_bonus, each met soft constraint soft_bonus.
    popular breaks ties by likes before the key."""
    from .ranking import top_k

    if filter_first:
        fit = candidates.drop("rank").join(wants, q).join(catalog, key).where(all_satisfied(F.col("hard")))
        rows = top_k(fit, q, "sparse", sparse_k, key).drop("sparse", "rank")
    else:
        rows = candidates.where(F.col("rank") <= sparse_k).select(q, key).join(wants, q).join(catalog, key).where(all_satisfied(F.col("hard")))
    rows = dense(rows) if callable(dense) else rows.join(dense, [q, key], "left")
    rows = rows.join(predicted.select(q, "task", F.lit(task_bonus).alias("__bonus")), [q, "task"], "left")
    bonus = F.lit(soft_bonus) * F.size(F.filter("soft", satisfied))
    scored = rows.withColumn("score", F.round(F.coalesce("dense", F.lit(0.0)) + F.coalesce("__bonus", F.lit(0.0)) + bonus, 4))
    scored = scored.withColumn("__likes", -F.coalesce("likes", F.lit(0)) if popular else F.lit(0))
    return top_k(scored, q, "score", k, "__likes", key).select(q, key, "task", "score", "rank")


def or_abstained(picked: DataFrame, requests: DataFrame, q: str, key: str) -> DataFrame:
    """picked, and for each request without an answer one row of nulls; abstained tells them."""
    return requests.select(q).join(picked, q, "left").withColumn("abstained", F.col(key).isNull())
