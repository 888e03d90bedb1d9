"""Golden cases worked out by hand, and laws that must hold for any scores."""

from __future__ import annotations

import math

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from siftmark.operators import ranking as rk

A = [(0, "x", 0.9), (0, "y", 0.5), (0, "z", 0.0)]
B = [(0, "x", 0.0), (0, "y", 0.8), (0, "z", 0.4)]
SCHEMA = "q int, task string, score double"


def table(spark, **named):
    return rk.signals(**{n: spark.createDataFrame(r, SCHEMA) for n, r in named.items()})


def result(df):
    return {r["task"]: r["score"] for r in df.collect()}


def test_reciprocal_ranks(spark):
    got = result(rk.fuse(table(spark, a=A, b=B), "q", "task", op="rrf"))
    assert got == {"x": 0.016667, "y": 0.03306, "z": 0.016393}


def test_score_sum_with_weights(spark):
    got = result(rk.fuse(table(spark, a=A, b=B), "q", "task", {"b": 0.5}))
    assert got == pytest.approx({"x": 1.0, "y": 1.055556, "z": 0.25})


def test_max_norm_of_zeros(spark):
    got = rk.normalised(spark.createDataFrame([(0, "a", 0.0), (0, "b", 0.0)], SCHEMA), ["q"])
    assert [r["norm"] for r in got.collect()] == [0.0, 0.0]


def test_unknown_operation(spark):
    with pytest.raises(ValueError):
        rk.fuse(table(spark, a=A), "q", "task", op="max")


def test_idf(spark):
    rows = [(i, w) for i in range(4) for w, df in (("a", 1), ("b", 2), ("c", 3), ("d", 4)) if i < df]
    got = {r["lemma"]: r["idf"] for r in rk.document_frequency(spark.createDataFrame(rows, "k int, lemma string"), "k").collect()}
    assert got == {"a": 1386294, "b": 693147, "c": 287682, "d": 0}


def test_lemmas_of_every_row_are_ignored(spark):
    postings = spark.createDataFrame([(1, "all"), (2, "all"), (2, "own")], "k int, lemma string")
    idf = rk.document_frequency(postings, "k")
    got = rk.sparse_scores(spark.createDataFrame([(0, "all"), (0, "own")], "q int, lemma string"), postings, idf, "q", "k").collect()
    assert [(r["k"], r["score"]) for r in got] == [(2, 693147)]


def test_dense_gives_every_label_and_breaks_ties_by_name(spark):
    queries, labels = spark.createDataFrame([(0,), (1,)], "q int"), spark.createDataFrame([("b",), ("a",), ("c",)], "task string")
    scores = spark.createDataFrame([(0, "c", 5)], "q int, task string, score bigint")
    full = rk.dense(scores, queries, labels, "q", "task")
    assert full.count() == 6
    assert {r["q"]: r["task"] for r in rk.best(full, "q", "task").collect()} == {0: "c", 1: "a"}


scores_of = st.lists(st.tuples(st.integers(0, 2), st.sampled_from("abcde"), st.floats(0, 100)), min_size=1, max_size=25, unique_by=lambda r: r[:2])
few = settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])


@few
@given(scores_of, scores_of)
def test_fusion_does_not_depend_on_the_order_of_rows_and_norms_lie_between_0_and_1(spark, a, b):
    one = sorted(map(tuple, rk.fuse(table(spark, s=a, t=b), "q", "task").collect()))
    two = sorted(map(tuple, rk.fuse(table(spark, s=a[::-1], t=b[::-1]).repartition(3), "q", "task").collect()))
    assert one == two
    norms = [r["norm"] for r in rk.normalised(table(spark, s=a), ["q"]).collect()]
    assert all(0 <= n <= 1 for n in norms)


@few
@given(scores_of)
def test_top_k_is_a_prefix_of_top_k_plus_1(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA)
    keep = lambda k: {tuple(r) for r in rk.top_k(df, "q", "score", k, "task").collect()}
    assert keep(2) <= keep(3)


def test_cosine_of_equal_bags_is_1(spark):
    stats = spark.createDataFrame([("l", "a", 2, 1_000_000), ("l2", "a", 1, 2_000_000), ("l3", "b", 1, 1_000_000)], "lemma string, task string, tf bigint, idf bigint")
    bags = spark.createDataFrame([(0, "l", 2), (0, "l2", 1)], "q int, lemma string, n bigint")
    assert result(rk.cosine_scores(bags, stats, "q", "task")) == {"a": 1.0}


def test_micro_is_exact():
    assert math.log(14) == pytest.approx(2.639057, abs=1e-6)


def test_bucket_bonus(spark):
    tasks = spark.createDataFrame([(0, "x", 2.0), (0, "y", 1.0)], SCHEMA)
    buckets = spark.createDataFrame([(0, "A", 0.0), (0, "B", 4.0)], "q int, bucket string, score double")
    dim = spark.createDataFrame([("x", "A"), ("y", "B")], "task string, bucket string")
    assert result(rk.with_bucket_bonus(tasks, buckets, dim, "q")) == {"x": 1.0, "y": 1.5}
    assert result(rk.inherited(buckets, dim, "q")) == {"x": 0.0, "y": 4.0}
    assert rk.best(tasks, "q", "task").where(F.col("task") == "x").count() == 1
