"""The k best rows of many queries by summed idf of shared lemmas, without a row for every pair that shares one.

Queries and postings are dealt into blocks, and a task holds the postings of a pair of blocks by lemma: it adds up the scores of
one query over all rows of its block at a time and keeps the k best.  Results are exact."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .ranking import top_k

#: Texts of a block of queries and of the rows, and numbers of a part of their product: what bounds a task's memory.
QUERY_BLOCK, ROW_BLOCK, PART = 16_384, 25_000, 1_500_000
#: Lemmas that one row of a block in so many has are added up as a product of matrices, as long as these have CELLS numbers at most.
DENSE, CELLS = 16, 5_000_000


def _lists(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """All values of a column of lists, and where each list starts (with the end of the last)."""
    x = column.combine_chunks()
    x = pa.concat_arrays(x.chunks) if isinstance(x, pa.ChunkedArray) else x
    sizes = pc.list_value_length(x).to_numpy(zero_copy_only=False)
    return x.flatten().to_numpy(zero_copy_only=False), np.concatenate(([0], np.cumsum(sizes)))


def best_of_block(asked: pa.Table, held: pa.Table, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """query, row, score of the k best rows of a block for each query, ties by row.  asked(lemma, idf, queries), held(lemma, rows)."""
    at = pc.index_in(held["lemma"], value_set=asked["lemma"].combine_chunks())
    held, at = held.filter(pc.is_valid(at)), pc.drop_null(at).to_numpy()
    (qs, q_start), (rows, start) = _lists(asked["queries"]), _lists(held["rows"])
    row_at, row_keys = pd.factorize(rows, sort=True)
    n, df, idf = len(row_keys), np.diff(start), asked["idf"].to_numpy()[at].astype(np.float64)
    # (query, posting list) pairs in the order of queries
    many = np.diff(q_start)[at]
    lists = np.repeat(np.arange(len(at)), many)
    asking = qs[np.repeat(q_start[:-1][at], many) + (np.arange(len(lists)) - np.repeat(np.cumsum(many) - many, many))]
    q_at, q_keys = pd.factorize(asking, sort=True)
    order = np.argsort(q_at, kind="stable")
    lists, first = lists[order], np.searchsorted(q_at[order], np.arange(len(q_keys) + 1))
    full = np.flatnonzero(df * DENSE > n)
    full = full[np.argsort(-df[full], kind="stable")][: CELLS // max(n, 1)]
    column = np.full(len(df), -1)
    column[full] = np.arange(len(full))
    matrix = np.zeros((len(full), n))
    for c, j in enumerate(full):
        matrix[c] = np.bincount(row_at[start[j] : start[j + 1]], minlength=n)
    out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    step = max(1, PART // max(n, 1))
    for low in range(0, len(q_keys), step):
        high = min(low + step, len(q_keys))
        weights = np.zeros((high - low, len(full)))
        for i in range(low, high):
            mine = lists[first[i] : first[i + 1]]
            mine = mine[column[mine] >= 0]
            np.add.at(weights[i - low], column[mine], idf[mine])
        scores = weights @ matrix  # whole numbers far below 2^53: sums are exact in any order
        for i in range(low, high):
            s, mine = scores[i - low], lists[first[i] : first[i + 1]]
            for j in mine[column[mine] < 0]:
                np.add.at(s, row_at[start[j] : start[j + 1]], idf[j])
            least = np.partition(s, n - k)[n - k] if n > k else 0
            hit = np.flatnonzero((s >= least) & (s > 0))
            hit = hit[np.argsort(-s[hit], kind="stable")][:k]
            out.append((np.full(len(hit), q_keys[i]), row_keys[hit], s[hit].astype(np.int64)))
    return tuple(np.concatenate(x) if out else np.array([], np.int64) for x in (zip(*out) if out else ((), (), ())))


def sparse_nearest(queries: DataFrame, postings: DataFrame, idf: DataFrame, q: str, key: str, k: int, sizes: tuple[int, int]) -> DataFrame:
    """q, key, score, rank: the k best rows of each query by the summed idf of the lemmas that both have, ties by key; rows without a
    common lemma of an idf above 0 are no answer.  A pair of a key and a lemma counts as often as queries(q, lemma)
    and postings(key, lemma) have it; keys are long and not null.  sizes: how many queries and rows there are; it says how they are dealt, not what comes out."""
    m = max(1, -(-sizes[1] // ROW_BLOCK))
    n = max(1, -(-sizes[0] // QUERY_BLOCK), -(-2 * queries.sparkSession.sparkContext.defaultParallelism // m))
    block = lambda c, of: F.pmod(F.xxhash64(c), F.lit(of)).cast("int")
    every = lambda of: F.explode(F.sequence(F.lit(0), F.lit(of - 1)))
    known = queries.join(idf.where("idf > 0").select("lemma", "idf"), "lemma")
    asked = known.groupBy("lemma", "idf", block(q, n).alias("__a")).agg(F.collect_list(q).alias("queries"))
    # by lemma and block from the start: a lemma that most rows have is dealt over its blocks
    held = postings.groupBy("lemma", block(key, m).alias("__b")).agg(F.collect_list(key).alias("rows")).join(known.select("lemma").distinct(), "lemma", "left_semi")

    def of_pair(a: pa.Table, b: pa.Table) -> pa.Table:
        found = best_of_block(a, b, k) if a.num_rows and b.num_rows else (np.array([], np.int64),) * 3
        return pa.table(dict(zip(("q", "key", "score"), found, strict=True)))

    left, right = asked.withColumn("__b", every(m)), held.withColumn("__a", every(n))
    found = left.groupBy("__a", "__b").cogroup(right.groupBy("__a", "__b")).applyInArrow(of_pair, "q long, key long, score long")
    return top_k(found.select(F.col("q").alias(q), F.col("key").alias(key), "score"), q, "score", k, key)
