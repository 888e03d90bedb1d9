"""Random draws from the pools of labels: digests are made only where they decide something."""

from __future__ import annotations

import hashlib
import random

from pyspark.sql import functions as F

from siftmark.operators import evaluation as ev

SEEDS = [1, 2, 3]


def plain(choices, rows):
    out = set()
    for q in {q for q, _ in choices}:
        pool = [(k, v) for k, t, v in rows if (q, t) in set(choices)]
        for s in SEEDS:
            if pool:
                out.add((q, s, min((hashlib.md5(f"{s}:{q}:{k}".encode()).hexdigest(), k, v) for k, v in pool)[2]))
    return out


def frames(spark, choices, rows):
    return spark.createDataFrame(choices, "q long, task string"), spark.createDataFrame(rows, "doc_id long, task string, bucket string")


def test_draws_equal_a_plain_version(spark):
    r = random.Random(5)
    rows = [(k, t, {"a": "x", "b": "x", "c": "y"}.get(t) or r.choice("xyz")) for k in range(-40, 160) for t in [r.choice("abcd")]]
    choices = [(q, t) for q in range(30) for t in r.sample("abcde", 2)]
    got = ev.draws(*frames(spark, choices, rows), "q", "task", "doc_id", "bucket", SEEDS)
    assert got.columns == ["q", "seed", "bucket"]
    assert {tuple(x) for x in got.collect()} == plain(choices, rows) and got.count() == len(plain(choices, rows))


def test_a_pool_of_one_value_needs_no_digest(spark):
    """3,000 queries that all choose two labels of 20,000 rows: 300 million digests, were they made."""
    rows = spark.range(40_000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 2 == 0, "a").otherwise("b").alias("task"), F.lit("x").alias("bucket"))
    choices = spark.range(3_000).select(F.col("id").alias("q"), F.explode(F.array(F.lit("a"), F.lit("b"))).alias("task"))
    got = ev.draws(choices, rows, "q", "task", "doc_id", "bucket", SEEDS)
    assert got.groupBy("bucket").count().collect() == [("x", 9_000)]
