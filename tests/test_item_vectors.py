"""Benchmark items of any number have their vectors."""

from __future__ import annotations

import shutil

import duckdb
import pytest

from siftmark.plans import catalogue

from .test_catalogue import plain


@pytest.mark.parametrize("name", ["hybrid_pick", "prefilter_mode", "tiebreak_delta"])
def test_items_from_200_on_have_vectors(spark, sf_dir, tmp_path, name):
    """Items numbered from 190 on, against the SQL."""
    con = duckdb.connect()
    for t in ("documents", "embeddings", "labels"):
        shutil.copy(f"{sf_dir}/{t}.parquet", tmp_path)
    con.execute(f"COPY (SELECT * REPLACE (item_id + 190 AS item_id) FROM '{sf_dir}/benchmark.parquet') TO '{tmp_path}/benchmark.parquet'")
    for t in ("documents", "embeddings", "labels", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet'")
    q = con.execute(catalogue.ORACLES[name])
    names = [d[0] for d in q.description]
    want = sorted(tuple(map(plain, r)) for r in q.fetchall())
    assert want == sorted(tuple(plain(r[c]) for c in names) for r in catalogue.QUERIES[name](spark, str(tmp_path)).collect())
