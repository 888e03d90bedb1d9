"""Index statistics, label rankers, fusion and top-k, all on long tables.

Scores built from logarithms are whole numbers of millionths: their sums are exact, so neither the order of rows nor the
number of partitions can flip a rank.  Every order ends in a unique key."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MICRO = 1_000_000
RRF_K = 60


#: Rows up to which a side of a join that has no key goes to every task.
SMALL_ROWS = 20_000


def small(side: DataFrame, most: int = SMALL_ROWS) -> DataFrame:
    """side marked for broadcast if it has `most` rows at most, counted no further than that; a larger one is left to Spark,
    which then pairs partitions of both sides."""
    return F.broadcast(side) if side.limit(most + 1).count() <= most else side


def micro(x: Column) -> Column:
    return F.round(x * MICRO).cast("long")


def from_micro(x: Column) -> Column:
    return F.round(x / F.lit(float(MICRO)), 6)


def document_frequency(postings: DataFrame, key: str, lemma: str = "lemma") -> DataFrame:
    """lemma, df, idf: idf = ln(N / df) in millionths, N the number of keys in postings(key, lemma), each pair once."""
    total = postings.agg(F.countDistinct(key).alias("__n"))  # one row
    per = postings.groupBy(lemma).agg(F.count(F.lit(1)).alias("df"))
    return per.crossJoin(F.broadcast(total)).select(lemma, "df", micro(F.ln(F.col("__n") / F.col("df"))).alias("idf"))


def top_k(scores: DataFrame, by: str | list[str], score: str, k: int | None, *ties: str, rank: str = "rank") -> DataFrame:
    """scores with a 1-based rank within `by`, highest score first, ties by the columns given; the first k rows if k.
    Spark cuts each partition to k rows before the exchange."""
    w = Window.partitionBy(by).orderBy(F.desc(score), *ties)
    out = scores.withColumn(rank, F.row_number().over(w))
    return out.where(F.col(rank) <= k) if k else out


def sparse_scores(queries: DataFrame, postings: DataFrame, idf: DataFrame, q: str, key: str) -> DataFrame:
    """q, key, score: the summed idf of the lemmas that a query shares with a row.  Lemmas of every row are left out of the
    index before the join, so it never probes them."""
    weighted = idf.where("idf > 0").select("lemma", "idf")
    return queries.join(weighted, "lemma").join(postings, "lemma").groupBy(q, key).agg(F.sum("idf").alias("score"))


def label_statistics(lemma_sets: DataFrame, label: str, labels: DataFrame) -> DataFrame:
    """lemma, label, tf, idf: tf counts the texts of a label that hold a lemma, idf = ln(number of labels / labels that have
    the lemma), the first being the size of the dimension `labels`, not of what was seen."""
    tf = lemma_sets.groupBy("lemma", label).agg(F.count(F.lit(1)).alias("tf"))
    size = labels.agg(F.count(F.lit(1)).alias("__n"))  # one row
    spread = tf.withColumn("__df", F.count(F.lit(1)).over(Window.partitionBy("lemma")))
    return spread.crossJoin(F.broadcast(size)).select("lemma", label, "tf", micro(F.ln(F.col("__n") / F.col("__df"))).alias("idf"))


def label_scores(lemmas: DataFrame, stats: DataFrame, q: str, label: str, weight: Column | None = None) -> DataFrame:
    """q, label, score: over the query's lemmas, a row each time one occurs, the sum of tf * idf (or of `weight`).
    Occurrences go to the join as they are: counting them first would cost an exchange of its own."""
    w = F.col("tf") * F.col("idf") if weight is None else weight
    return lemmas.join(stats.where("idf > 0"), "lemma").groupBy(q, label).agg(F.sum(w).alias("score"))


def dense(scores: DataFrame, queries: DataFrame, labels: DataFrame, q: str, label: str) -> DataFrame:
    """A row for every query and label, 0 where there is no score.  The labels are a taxonomy, not data: they go to every task
    as one array."""
    every = labels.agg(F.array_sort(F.collect_set(label)).alias("__labels"))
    grid = queries.select(q).crossJoin(F.broadcast(every)).select(q, F.explode("__labels").alias(label))
    return grid.join(scores, [q, label], "left").withColumn("score", F.coalesce("score", F.lit(0).cast(scores.schema["score"].dataType)))


def normalised(scores: DataFrame, by: list[str], score: str = "score", out: str = "norm") -> DataFrame:
    """score / the greatest of its group; 0 for all of a group whose greatest isn't above 0."""
    most = F.max(score).over(Window.partitionBy(*by))
    return scores.withColumn(out, F.when(most > 0, F.col(score) / most).otherwise(F.lit(0.0)))


def signals(**tables: DataFrame) -> DataFrame:
    """The long table (q, label, score, signal) of named score tables of the same columns."""
    return reduce(DataFrame.unionByName, (t.withColumn("signal", F.lit(name)) for name, t in sorted(tables.items())))


def fuse(table: DataFrame, q: str, label: str, weights: dict[str, float] | None = None, op: str = "sum", digits: int = 6) -> DataFrame:
    """q, label, score.  op `sum`: weighted sum of max-normalised scores.  op `rrf`: sum of w / (60 + zero-based rank) over the
    signals where the score is above 0.  A signal without a weight counts 1, one with weight 0 not at all.  Sums are rounded
    so that their order doesn't depend on how the rows were dealt."""
    weight = F.lit(1.0)
    for name, w in (weights or {}).items():
        weight = F.when(F.col("signal") == name, F.lit(float(w))).otherwise(weight)
    if op == "sum":
        part = normalised(table, [q, "signal"]).withColumn("__part", weight * F.col("norm"))
    elif op == "rrf":
        ranked = top_k(table, [q, "signal"], "score", None, label, rank="__r").where("score > 0")
        part = ranked.withColumn("__part", weight / (F.lit(RRF_K) + F.col("__r") - 1))
    else:
        raise ValueError(f"op must be sum or rrf, not {op}")
    return part.groupBy(q, label).agg(F.round(F.sum("__part"), digits).alias("score"))


def with_bucket_bonus(task_scores: DataFrame, bucket_scores: DataFrame, task_bucket: DataFrame, q: str, alpha: float = 1.0) -> DataFrame:
    """q, task, score: norm(task) + alpha * norm(bucket of the task)."""
    tasks = normalised(task_scores, [q], out="__t").join(task_bucket, "task")
    buckets = normalised(bucket_scores, [q], out="__b").select(q, "bucket", "__b")
    return tasks.join(buckets, [q, "bucket"]).select(q, "task", F.round(F.col("__t") + F.lit(alpha) * F.col("__b"), 6).alias("score"))


def inherited(bucket_scores: DataFrame, task_bucket: DataFrame, q: str) -> DataFrame:
    """q, task, score: each task has the score of its bucket."""
    return bucket_scores.join(task_bucket, "bucket").select(q, "task", "score")


def best(scores: DataFrame, q: str, label: str, score: str = "score") -> DataFrame:
    """The first label of each query by (score descending, label)."""
    return scores.groupBy(q).agg(F.min(F.struct((-F.col(score)).alias("__s"), F.col(label))).alias("__b")).select(q, F.col(f"__b.{label}").alias(label), (-F.col("__b.__s")).alias(score))


def cosine_scores(bags: DataFrame, stats: DataFrame, q: str, label: str) -> DataFrame:
    """q, label, score: cosine of count * idf vectors of a query and of a label's document; rows with a shared lemma only."""
    idf = stats.select("lemma", "idf").distinct().where("idf > 0")
    a = bags.join(idf, "lemma").select(q, "lemma", (F.col("n") * F.col("idf") / MICRO).alias("x"))
    b = stats.where("idf > 0").select(label, "lemma", (F.col("tf") * F.col("idf") / MICRO).alias("y"))
    size = lambda t, k, c: t.groupBy(k).agg(F.sqrt(F.sum(F.col(c) * F.col(c))).alias(f"__{c}"))
    joined = a.join(b, "lemma").groupBy(q, label).agg(F.sum(F.col("x") * F.col("y")).alias("__dot"))
    return joined.join(size(a, q, "x"), q).join(size(b, label, "y"), label).select(q, label, F.round(F.try_divide("__dot", F.col("__x") * F.col("__y")), 6).alias("score"))
