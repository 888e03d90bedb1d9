"""Phrase similarity by blocks: what a block gives is bounded, and a query of many phrases is dealt."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pytest

from siftmark.operators import vector as vc


def plain(a, b):
    unit = lambda v: np.asarray(v) / np.sqrt(np.dot(v, v))
    of = lambda rows: {k: [unit(v) for i, v in rows if i == k and any(v)] for k in {i for i, _ in rows}}
    best = lambda x, ys: int(np.rint(max(x @ y for y in ys) * 1e6))
    return sorted((q, c, round(sum(best(x, ys) for x in xs) / len(xs) / 1e6, 4)) for q, xs in of(a).items() for c, ys in of(b).items() if xs and ys)


@pytest.mark.parametrize("keys, phrases, rows", [(1_024, 8_192, 50_000), (2, 8_192, 50_000), (3, 4, 9)])
def test_blocks_of_any_size_give_the_same_means(spark, monkeypatch, keys, phrases, rows):
    r = np.random.default_rng(3)
    vectors = r.integers(-2, 3, (90, 3)).astype(float).tolist()
    a = [(i % 4 if i < 20 else 9, v) for i, v in enumerate(vectors[:40])] + [(1, vectors[1])] * 3 + [(77, [0.0, 0.0, 0.0])]
    b = [(i % 7, v) for i, v in enumerate(vectors[30:])]
    monkeypatch.setattr(vc, "KEYS", keys)
    monkeypatch.setattr(vc, "QUERY_BLOCK", phrases)
    monkeypatch.setattr(vc, "CORPUS_BLOCK", rows)
    frame = lambda x, k: spark.createDataFrame(x, f"{k} long, vector array<double>")
    got, want = sorted(map(tuple, vc.max_mean(frame(a, "q"), frame(b, "c"), "q", "c").collect())), plain(a, b)
    assert [x[:2] for x in got] == [x[:2] for x in want] and [x[2] for x in got] == pytest.approx([x[2] for x in want], abs=1e-4)


def test_a_block_gives_a_row_for_each_pair_and_not_for_each_phrase():
    a = pd.DataFrame({"q": [5, 2, 5, 5], "__q": [[1.0, 0.0], [0.0, 1.0], [0.0, 2.0], [3.0, 4.0]], "__w": [1, 2, 1, 1]})
    b = pd.DataFrame({"c": [8, 7, 8], "v": [[1.0, 0.0], [0.6, 0.8], [0.0, 1.0]]})
    got = vc._of_pairs(a, b, "q", "c", "v")
    assert [tuple(map(int, x)) for x in got.itertuples(index=False)] == [(2, 7, 1_600_000, 2), (2, 8, 2_000_000, 2), (5, 7, 2_400_000, 3), (5, 8, 2_800_000, 3)]


def test_phrases_are_not_exchanged_after_their_product(spark):
    rows = spark.createDataFrame([(i, [1.0, float(i)]) for i in range(6)], "c long, vector array<double>")
    plan = vc.max_mean(rows.withColumnRenamed("c", "q"), rows, "q", "c")._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate" not in plan[: plan.index("FlatMapCoGroups")]
