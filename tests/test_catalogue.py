"""Every registered query against its SQL on DuckDB."""

from __future__ import annotations

import math
import os

import duckdb
import pytest

from siftmark.plans import catalogue


def plain(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return "null"
    if isinstance(v, float):
        return repr(round(v, 9) + 0.0)
    if isinstance(v, (list, tuple)):
        return str([plain(x) for x in v])
    return str(v)


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for f in os.listdir(sf_dir):
        con.execute(f"CREATE VIEW {f[:-8]} AS SELECT * FROM '{sf_dir}/{f}'")
    return con


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query_equals_its_sql(spark, duck, sf_dir, name):
    rows = catalogue.QUERIES[name](spark, sf_dir)
    got = sorted(tuple(plain(r[c]) for c in sorted(rows.columns)) for r in rows.collect())
    assert got
    if name in catalogue.ORACLES:
        q = duck.execute(catalogue.ORACLES[name])
        names = [d[0] for d in q.description]
        assert sorted(names) == sorted(rows.columns)
        want = sorted(tuple(plain(r[names.index(c)]) for c in sorted(names)) for r in q.fetchall())
        assert got == want


def test_runs_twice_alike_whatever_the_partitions(spark, sf_dir):
    def run(n):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        return sorted(map(tuple, catalogue.QUERIES["score_sum_fusion"](spark, sf_dir).collect()))

    try:
        assert run(2) == run(7) == run(7)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", 4)


def test_filters_and_columns_reach_the_scan(spark, sf_dir):
    plan = catalogue.QUERIES["semi_subset"](spark, sf_dir)._jdf.queryExecution().toString()
    assert "PushedFilters: [IsNotNull(quality), EqualTo(quality,1)" in plan
    assert "ReadSchema: struct<doc_id:bigint,lang:string>" in plan
