"""Nearest neighbours, votes, centroids and phrase similarity over vector columns.

Both sides of a search are dealt into blocks of bounded size, and each pair of blocks is one product of matrices.  A block
gives the k best of each of its queries, so nothing like all pairs is ever exchanged; results are exact."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftmark.functions.vectors import mean_vector, norm

from .ranking import MICRO, top_k

#: Rows of a block of queries and of the corpus: a task holds one of each, and their product a part at a time.
QUERY_BLOCK, CORPUS_BLOCK, PART = 8_192, 50_000, 256
#: Where a block gives a row for each pair: queries and candidates of a block, and numbers of a part of its product.
KEYS, CELLS = 1_024, 2_000_000


def _units(vectors: pd.Series) -> np.ndarray:
    """Rows of length 1; a vector without length stays as it is, so that all its cosines are 0."""
    x = np.stack([np.asarray(v, np.float64) for v in vectors])
    size = np.sqrt((x * x).sum(1, keepdims=True))
    return np.divide(x, size, out=np.zeros_like(x), where=size > 0)


def _by_blocks(
    queries: DataFrame, corpus: DataFrame, q: str | list[str], key: str, of_block: Callable[[pd.DataFrame, pd.DataFrame], pd.DataFrame], schema: str, blocks: tuple[int, int] | None = None
) -> DataFrame:
    """of_block(queries, corpus) of every pair of blocks.  Two counts say how many blocks there are, if `blocks` doesn't."""
    many = lambda df, size: max(1, -(-df.count() // size))
    n, m = blocks or (many(queries, QUERY_BLOCK), many(corpus, CORPUS_BLOCK))
    every = lambda k: F.explode(F.sequence(F.lit(0), F.lit(k - 1)))
    left = queries.withColumn("__a", F.pmod(F.xxhash64(*([q] if isinstance(q, str) else q)), F.lit(n)).cast("int")).withColumn("__b", every(m))
    right = corpus.withColumn("__b", F.pmod(F.xxhash64(key), F.lit(m)).cast("int")).withColumn("__a", every(n))

    def of_group(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if not len(a) or not len(b):
            return pd.DataFrame({c.split("`")[1]: [] for c in schema.split(", ")})
        return of_block(a, b)

    return left.groupBy("__a", "__b").cogroup(right.groupBy("__a", "__b")).applyInPandas(of_group, schema)


def _typed(df: DataFrame, columns: list[str]) -> str:
    return ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in columns)


def similarities(queries: DataFrame, corpus: DataFrame, q: str, key: str, vector: str = "vector", k: int | None = None, match: tuple[str, str] | None = None, apart: bool = False) -> DataFrame:
    """q, key, sim (millionths of the cosine) and the other columns of corpus: of each query the k best of every block and what
    ties with them, or all rows if k is None (for a corpus as small as a taxonomy).

    match: a column of queries and one of corpus that must be equal, where the first isn't null.  apart: a row whose key is the
    query's own isn't an answer.  Rows without a vector take no part."""
    asked = queries.where(F.col(vector).isNotNull()).select(q, F.col(vector).alias("__q"), *((F.col(match[0]).alias("__m"),) if match else ()))
    rows, others = corpus.where(F.col(vector).isNotNull()), [c for c in corpus.columns if c not in (vector, key)]

    def of_block(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        x, y, keys, out = _units(a["__q"]), _units(b[vector]), b[key].to_numpy(), []
        labels = b[match[1]].to_numpy() if match else None
        for at in range(0, len(a), PART):
            sims = np.rint(x[at : at + PART] @ y.T * MICRO).astype(np.int64)
            for i, s in enumerate(sims, at):
                fits = np.ones(len(s), bool)
                if match and not pd.isna(a["__m"].iloc[i]):
                    fits &= labels == a["__m"].iloc[i]
                if apart:
                    fits &= keys != a[q].iloc[i]
                hit = np.flatnonzero(fits)
                if k is not None and len(hit) > k:
                    hit = hit[s[hit] >= np.partition(s[hit], len(hit) - k)[len(hit) - k]]
                out.append(b.iloc[hit][[key, *others]].assign(**{q: a[q].iloc[i], "sim": s[hit]}))
        return pd.concat(out)[[q, key, *others, "sim"]]

    return _by_blocks(asked, rows, q, key, of_block, f"{_typed(queries, [q])}, {_typed(corpus, [key, *others])}, `sim` bigint")


def nearest(queries: DataFrame, corpus: DataFrame, q: str, key: str, k: int, vector: str = "vector", match: tuple[str, str] | None = None, apart: bool = False) -> DataFrame:
    """The k nearest rows of each query, ties by key: unlike a partial sort, the same ones every time."""
    return top_k(similarities(queries, corpus, q, key, vector, k, match, apart), q, "sim", k, key)


def vote(neighbours: DataFrame, q: str, label: str) -> DataFrame:
    """q, label, score: the summed similarity of a label's neighbours."""
    return neighbours.groupBy(q, label).agg(F.sum("sim").alias("score"))


def centroids(corpus: DataFrame, label: str, vector: str = "vector") -> DataFrame:
    return mean_vector(corpus, [label], vector)


def _of_pairs(a: pd.DataFrame, b: pd.DataFrame, q: str, c: str, vector: str) -> pd.DataFrame:
    """q, c, __s, __n: over the phrases of each query in a block, the sum of the greatest cosines with each candidate, and the
    phrases' number.  The product of matrices is made a part of CELLS numbers at a time."""
    a, b = a.sort_values(q), b.sort_values(c)
    x, y, weights = _units(a["__q"]), _units(b[vector]), a["__w"].to_numpy()
    q_at, q_keys = pd.factorize(a[q])
    keys = b[c].to_numpy()
    starts = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
    sums = np.zeros((len(q_keys), len(starts)), np.int64)
    step = max(1, CELLS // len(y))
    for at in range(0, len(x), step):
        most = np.rint(np.maximum.reduceat(x[at : at + step] @ y.T, starts, axis=1) * MICRO).astype(np.int64) * weights[at : at + step, None]
        mine = q_at[at : at + step]
        first = np.flatnonzero(np.concatenate(([True], mine[1:] != mine[:-1])))
        sums[mine[first]] += np.add.reduceat(most, first, axis=0)
    n = np.bincount(q_at, weights, len(q_keys)).astype(np.int64)
    return pd.DataFrame({q: np.repeat(np.asarray(q_keys), len(starts)), c: np.tile(keys[starts], len(q_keys)), "__s": sums.ravel(), "__n": np.repeat(n, len(starts))})


def max_mean(queries: DataFrame, candidates: DataFrame, q: str, c: str, vector: str = "vector") -> DataFrame:
    """q, c, score: the mean over a query's phrases (one row each) of the greatest cosine with a candidate's phrases.
    A phrase without length takes no part; a side without phrases has no row.

    A query's phrases share a block, and so do a candidate's: a block gives a row for each pair, and no pair of phrases is exchanged.
    Blocks hold KEYS queries and KEYS candidates at most, as dealt by hash, since what a block gives grows with their product.
    Only if a query has more than QUERY_BLOCK different phrases are queries dealt over several blocks, and their sums added up."""
    # equal phrases of a query have equal greatest cosines: their number is kept as a weight
    left = queries.where(norm(F.col(vector)) > 0).groupBy(q, F.col(vector).alias("__q")).agg(F.count(F.lit(1)).alias("__w"))
    right = candidates.where(norm(F.col(vector)) > 0).select(c, vector)
    sizes = lambda df, key: df.groupBy(key).agg(F.count(F.lit(1)).alias("n")).agg(F.count("n"), F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.max("n"), F.lit(0))).first()
    (n_q, phrases, most), (n_c, rows, _) = sizes(left, q), sizes(right, c)
    blocks = max(1, -(-n_q // KEYS), -(-phrases // QUERY_BLOCK)), max(1, -(-n_c // KEYS), -(-rows // CORPUS_BLOCK))
    left = left.withColumn("__part", F.pmod(F.xxhash64("__q"), F.lit(-(-most // QUERY_BLOCK))) if most > QUERY_BLOCK else F.lit(0).cast("bigint"))
    schema = f"{_typed(queries, [q])}, {_typed(candidates, [c])}, `__s` bigint, `__n` bigint"
    sums = _by_blocks(left, right, [q, "__part"], c, lambda a, b: _of_pairs(a, b, q, c, vector), schema, blocks)
    if most > QUERY_BLOCK:
        sums = sums.groupBy(q, c).agg(F.sum("__s").alias("__s"), F.sum("__n").alias("__n"))
    return sums.select(q, c, F.round(F.col("__s") / F.col("__n") / 1e6, 4).alias("score"))
