"""Block-wise sparse retrieval against the join that makes a row for every pair."""

from __future__ import annotations

import random

import numpy as np
import pyarrow as pa
import pytest

from siftmark.operators import ranking as rk
from siftmark.operators import sparse as sp


def tables(spark):
    r = random.Random(7)
    lemmas = [f"l{i}" for i in range(30)]
    rows = [(d, w) for d in range(80) for w in {"most", *r.choices(lemmas, range(1, 31), k=4)} if w != "most" or d % 9]
    asked = [(q, w) for q in range(-5, 12) for w in {"most", "unheard", *r.choices(lemmas, k=q % 6)} if q != 3]
    rows += [r for r in rows if r[0] == 11]  # a row that is there twice counts twice, as in a join
    return spark.createDataFrame(asked, "q long, lemma string"), spark.createDataFrame(rows, "k long, lemma string")


@pytest.mark.parametrize("blocks", [(16_384, 25_000), (5, 13), (1, 80)])
def test_the_best_rows_are_those_of_all_pairs(spark, monkeypatch, blocks):
    asked, rows = tables(spark)
    idf = rk.document_frequency(rows, "k")
    want = rk.top_k(rk.sparse_scores(asked, rows, idf, "q", "k"), "q", "score", 4, "k").collect()
    monkeypatch.setattr(sp, "QUERY_BLOCK", blocks[0])
    monkeypatch.setattr(sp, "ROW_BLOCK", blocks[1])
    got = sp.sparse_nearest(asked, rows, idf, "q", "k", 4, (17, 80))
    assert got.columns == ["q", "k", "score", "rank"]
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want)) and len(want) > 40


def test_pairs_never_leave_a_block(spark):
    """The join of queries and postings on lemmas, a row for each pair and lemma, is gone from the plan."""
    asked, rows = tables(spark)
    plan = sp.sparse_nearest(asked, rows, rk.document_frequency(rows, "k"), "q", "k", 4, (17, 80))._jdf.queryExecution().optimizedPlan().toString()
    assert "FlatMapCoGroups" in plan and "sum(" not in plan


@pytest.mark.parametrize("dense, part", [(10**6, 10**6), (1, 7), (0, 100)])
def test_a_block_by_matrices_or_lists(monkeypatch, dense, part):
    monkeypatch.setattr(sp, "DENSE", dense)
    monkeypatch.setattr(sp, "PART", part)
    asked = pa.table({"lemma": ["a", "b", "x"], "idf": [5, 3, 9], "queries": [[7, 1], [1], [1]]})
    held = pa.table({"lemma": ["b", "c", "a"], "rows": [[4, 2, 9], [2], [9, 3]]})
    got = list(zip(*(x.tolist() for x in sp.best_of_block(asked, held, 2)), strict=True))
    assert got == [(1, 9, 8), (1, 3, 5), (7, 3, 5), (7, 9, 5)]
    none = sp.best_of_block(asked, held.slice(1, 1), 2)
    assert [len(x) for x in none] == [0, 0, 0] and all(isinstance(x, np.ndarray) for x in none)
