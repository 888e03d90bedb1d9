"""op2 at other thresholds than the query's, against all pairs."""

from __future__ import annotations

import random

import pytest

from siftmark.llm import op2_near_dedup as op2

from . import plain


def copies():
    """Pairs of 200 words that share 0.76 to 0.91 of their shingles, each pair of words of its own."""
    r, rows = random.Random(8), []
    for k in range(80):
        base = [f"p{k}w{r.randrange(10**6)}" for _ in range(200)]
        tail = [f"p{k}x{j}" for j in range(10 + k % 20)]
        rows += [(2 * k, " ".join(base)), (2 * k + 1, " ".join(base[: -len(tail)] + tail))]
    return rows


def test_bands_follow_the_threshold():
    assert op2.bands_for(85) == op2.BANDS
    for percent in (50, 70, 80, 85, 95):
        assert (1 - (percent / 100) ** op2.ROWS) ** op2.bands_for(percent) <= op2.MISS


@pytest.mark.parametrize("percent", [80, 85, 100])
def test_components_at_a_threshold_equal_exact_ones(spark, documents, percent):
    rows = copies() + [(1000 + r["doc_id"], r["text"]) for r in documents.collect()]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    want = plain.components(rows, percent)
    assert {r["doc_id"]: r["component_id"] for r in op2.near_duplicates(df, percent=percent).collect()} == want
    assert sorted(r["doc_id"] for r in op2.near_dedup(df, percent=percent).collect()) == sorted(i for i, c in want.items() if i == c)
