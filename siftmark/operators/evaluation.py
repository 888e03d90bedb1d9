"""Metrics over predictions and gold lists, and the audits that look for leaks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ranking import small

DOMINATION, RARE_DF, FAIL_RATE, ECHO_THRESHOLD = 0.5, 4, 0.60, 0.20


def rate(hits: Column, n: Column, digits: int = 4) -> Column:
    return F.coalesce(F.round(F.try_divide(hits, n), digits), F.lit(0.0))


def top1_exact(pred: Column, gold: Column) -> Column:
    return F.coalesce(pred == F.get(gold, 0), F.lit(False))


def in_list(pred: Column, gold: Column) -> Column:
    return F.coalesce(F.array_contains(gold, pred), F.lit(False))


def in_list_at(preds: Column, gold: Column, k: int) -> Column:
    return F.coalesce(F.arrays_overlap(F.slice(preds, 1, k), gold), F.lit(False)) if k > 0 else F.lit(False)


def far_bucket(pred: Column, pred_bucket: Column, gold: Column, gold_bucket: Column, benign: Column) -> Column:
    """A miss in another bucket than the first gold label's, unless the two buckets are a benign pair."""
    return ~in_list(pred, gold) & (pred_bucket != gold_bucket) & ~benign


def covered(found: Column, expected: Column) -> Column:
    """A facet is covered if nothing is expected or something expected is there."""
    return (F.size(expected) == 0) | F.coalesce(F.arrays_overlap(found, expected), F.lit(False))


def percentile_rows(means: DataFrame, value: str, low: float = 0.025, high: float = 0.975) -> DataFrame:
    """low, high: the values at the places int(low * R) and min(int(high * R), R - 1) of R sorted values (R is a setting)."""
    ordered = means.agg(F.array_sort(F.collect_list(value)).alias("__v"))
    at = lambda p: F.least((F.size("__v") * F.lit(p)).cast("int"), F.size("__v") - 1)
    return ordered.select(F.round(F.get("__v", at(low)), 4).alias("low"), F.round(F.get("__v", at(high)), 4).alias("high"))


def poisson_steps(most: int = 9) -> list[float]:
    """Cumulative probabilities of 0, 1, ... of a Poisson draw of mean 1."""
    out, p, total = [], 0.36787944117144233, 0.0
    for k in range(most):
        total += p
        out.append(total)
        p /= k + 1
    return out


#: Parts that a label's rows are dealt into for draws.
DRAW_PARTS = 64


def draws(choices: DataFrame, rows: DataFrame, q: str, label: str, key: str, value: str, seeds: list[int]) -> DataFrame:
    """q, seed, value: of the rows whose label is among a query's choices(q, label), each pair once, the one whose digest of (seed,
    query, key) is least, ties by key: a random draw that any engine repeats.

    Where all rows of a query's labels have one value, that is what is drawn, whichever row it is: no digest is needed.  Else
    every row has its digest, and the least of a part of a label's rows is found inside the row that holds the part."""
    kinds = rows.groupBy(label).agg(F.collect_set(F.struct(value)).alias("__values"))  # a taxonomy
    pools = choices.join(kinds, label).groupBy(q).agg(F.collect_list(F.struct(label, "__values")).alias("__pool"))
    pools = pools.withColumn("__values", F.array_distinct(F.flatten("__pool.__values")))
    seed = F.explode(F.lit(seeds)).alias("seed")
    sure = pools.where(F.size("__values") == 1).select(q, seed, F.get("__values", 0)[value].alias(value))
    parts = rows.groupBy(label, F.pmod(F.xxhash64(key), F.lit(DRAW_PARTS)).alias("__part")).agg(F.collect_list(F.struct(key, value)).alias("__rows"))
    mixed = pools.where(F.size("__values") > 1).select(q, F.explode(F.col("__pool")[label]).alias(label)).join(parts, label)

    def least(s: int) -> Column:
        digest = lambda r: F.md5(F.concat_ws(":", F.lit(str(s)), F.col(q).cast("string"), r[key].cast("string")).cast("binary"))
        return F.struct(F.lit(s).alias("seed"), F.array_min(F.transform("__rows", lambda r: F.struct(digest(r).alias("h"), r[key].alias("key"), r[value].alias("value")))).alias("least"))

    each = mixed.select(q, F.inline(F.array(*(least(s) for s in seeds)))).groupBy(q, "seed").agg(F.min("least")["value"].alias(value))
    return sure.unionByName(each)


def bootstrap(hits: DataFrame, resamples: int = 1000, seed: int = 1234, hit: str = "hit") -> DataFrame:
    """low, high: 95 % interval of the mean of 0/1 outcomes.

    Poisson bootstrap: each outcome enters each resample as often as a Poisson(1) draw of its own says, so partial counts of
    all resamples add up in one pass and nothing is drawn across partitions.  Draws are digests of (seed, resample, row key)."""
    digest = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("__i").cast("string"), F.col("key").cast("string")).cast("binary"))
    u = (F.conv(F.substring(digest, 1, 13), 16, 10).cast("long") + F.lit(0.5)) / F.lit(float(2**52))
    draw = sum((F.when(F.col("__u") >= c, 1).otherwise(0) for c in poisson_steps()), F.lit(0))
    each = hits.withColumn("__i", F.explode(F.sequence(F.lit(0), F.lit(resamples - 1)))).withColumn("__u", u).withColumn("__w", draw)
    means = each.groupBy("__i").agg(F.try_divide(F.sum(F.col("__w") * F.col(hit)), F.sum("__w")).alias("mean"))
    return percentile_rows(means.where("mean IS NOT NULL"), "mean")


def bootstrap_n(hits: DataFrame, resamples: int = 1000, seed: int = 1234, hit: str = "hit") -> DataFrame:
    """low, high: 95 % interval of the mean of 0/1 outcomes over resamples of n of the n outcomes.

    A draw with replacement is right with the odds hits / n, so a resample needs the two counts and n draws, not the rows.
    Draws are digests of (seed, resample, number of the draw), made where they are used."""
    size = hits.agg(F.count(F.lit(1)).alias("__n"), F.coalesce(F.sum(hit), F.lit(0)).alias("__hits"))  # one row
    each = hits.sparkSession.range(resamples).withColumnRenamed("id", "__i").crossJoin(F.broadcast(size.where("__n > 0")))
    each = each.withColumn("__j", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("__n") - 1)))
    digest = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("__i").cast("string"), F.col("__j").cast("string")).cast("binary"))
    u = (F.conv(F.substring(digest, 1, 13), 16, 10).cast("long") + F.lit(0.5)) / F.lit(float(2**52))
    return percentile_rows(each.groupBy("__i").agg(F.avg((u * F.col("__n") < F.col("__hits")).cast("int")).alias("mean")), "mean")


def jaccard(a: Column, b: Column) -> Column:
    """0 where both are empty."""
    return F.coalesce(F.try_divide(F.size(F.array_intersect(a, b)), F.size(F.array_union(a, b))), F.lit(0.0))


def by_origin(found: DataFrame, labels: DataFrame, cue: str, label: str) -> DataFrame:
    """origin, n: cues that hold a label as a word come from the labels' surfaces, others from elsewhere.  An equi-join on words."""
    words = found.select(cue).distinct().select(cue, F.explode(F.split(cue, " ")).alias(label))
    named = words.join(labels.select(label).distinct(), label, "left_semi").select(cue).distinct().withColumn("__l", F.lit("label"))
    return found.join(named, cue, "left").groupBy(F.coalesce("__l", F.lit("other")).alias("origin")).agg(F.count(F.lit(1)).alias("n"))


def dominating(contributions: DataFrame, q: str, cue: str, value: str) -> DataFrame:
    """q, cue, value, total, n: of what makes up a score, the greatest part (ties: the last cue), the sum and the number."""
    return contributions.groupBy(q).agg(
        F.max(F.struct(F.col(value).alias("value"), F.col(cue).alias("cue"))).alias("__top"), F.sum(value).alias("total"), F.count(F.lit(1)).alias("n")
    ).select(q, F.col("__top.cue").alias("cue"), F.col("__top.value").alias("value"), "total", "n")


def echo_report(correct: DataFrame, decomposed: DataFrame, rare: Column, q: str) -> DataFrame:
    """One row of an echo audit: how many correct answers hang on one cue (half of the score or more), and on a rare one."""
    rows = correct.join(decomposed, q, "left").withColumn("dominated", F.coalesce((F.col("total") > 0) & (2 * F.col("value") >= F.col("total")), F.lit(False)))
    n = rows.agg(
        F.count(F.lit(1)).alias("n_correct"), F.count_if("dominated").alias("n_dominated"), F.count_if(F.col("dominated") & F.coalesce(rare, F.lit(False))).alias("n_echo"),
        F.coalesce(F.sum("n"), F.lit(0)).alias("__parts"), F.coalesce(F.floor(F.median(F.coalesce("n", F.lit(0)))), F.lit(0)).cast("long").alias("median_parts"),
    )
    echo = rate(F.col("n_echo"), F.col("n_correct"))
    return n.select("n_correct", "n_dominated", "n_echo", echo.alias("echo_rate"), rate(F.col("__parts"), F.col("n_correct")).alias("mean_parts"), "median_parts", (echo > FAIL_RATE).alias("fail"))


def memorised(prompts: DataFrame, prompt: str, gold: str, order: str) -> DataFrame:
    """prompts with the gold of the last row of equal text: what an exact-lookup predictor answers."""
    last = prompts.groupBy(F.col(prompt).alias("__p")).agg(F.max_by(gold, order).alias("answer"))
    return prompts.join(last, F.col(prompt) == F.col("__p")).drop("__p")


def provenance(cues: DataFrame, allowed: DataFrame, cue: str, lemmas: str) -> DataFrame:
    """cue, offends: a cue offends if it has lemmas and not all are allowed; one without lemmas passes."""
    missing = cues.select(cue, F.explode(lemmas).alias("lemma")).join(allowed, "lemma", "left_anti").select(cue).distinct()
    return cues.select(cue).distinct().join(missing.withColumn("__m", F.lit(True)), cue, "left").select(cue, F.coalesce("__m", F.lit(False)).alias("offends"))


def bindings(cues: DataFrame, prompts: DataFrame, cue: str, q: str, text: str) -> DataFrame:
    """cue, q: a cue(cue, lemmas) binds a prompt(q, text, lemmas) whose text holds it or that shares a lemma with it.

    The second half is an equi-join on lemmas; only the first tests every pair, against a dictionary that each task holds if it is small."""
    shared = cues.select(cue, F.explode("lemmas").alias("lemma")).join(prompts.select(q, F.explode("lemmas").alias("lemma")), "lemma").select(cue, q)
    held = prompts.select(q, F.lower(text).alias("__t")).join(small(cues.select(cue)), F.contains("__t", F.lower(cue))).select(cue, q)
    return shared.unionByName(held).distinct()


def cue_echo(bound: DataFrame, prompts: DataFrame, correct: DataFrame, cue: str, q: str) -> DataFrame:
    """One row: how many right answers fall on prompts that a cue binds which binds no other prompt."""
    alone = bound.groupBy(cue).agg(F.count(F.lit(1)).alias("__n"), F.min(q).alias(q)).where("__n = 1").select(q).distinct()
    rows = prompts.select(q).join(correct.select(q, F.lit(True).alias("__ok")), q, "left").join(alone.withColumn("__alone", F.lit(True)), q, "left")
    n = rows.agg(
        F.count(F.lit(1)).alias("n_prompts"), F.count("__ok").alias("n_correct"), F.count_if(F.col("__ok") & F.coalesce("__alone", F.lit(False))).alias("n_coincident"), F.count("__alone").alias("n_unique_prompts"),
    )
    return n.withColumn("fraction", rate(F.col("n_coincident"), F.col("n_correct")))


def concentration(counts: DataFrame, label: str, n: str) -> DataFrame:
    """label, n, rank, share, cumulative: labels by size, the share of all rows and the running share."""
    w = Window.orderBy(F.desc(n), label)  # labels, not rows: a taxonomy
    total = F.sum(n).over(Window.partitionBy(F.lit(1)))
    return counts.select(label, n, F.row_number().over(w).alias("rank"), F.round(F.col(n) / total, 6).alias("share"), F.round(F.sum(n).over(w.rowsBetween(Window.unboundedPreceding, 0)) / total, 6).alias("cumulative"))
