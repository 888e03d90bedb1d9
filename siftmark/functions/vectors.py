"""Vector arithmetic on ARRAY<FLOAT> columns, accumulated in double precision."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(dot(v, v))


def cosine(a: Column, b: Column) -> Column:
    """0 where either side has no length."""
    return F.coalesce(F.try_divide(dot(a, b), norm(a) * norm(b)), F.lit(0.0))


def unit(v: Column, epsilon: float = 1e-8) -> Column:
    """v / (|v| + epsilon): a vector without length stays as it is; a self-cosine is a little under 1."""
    return F.transform(v, lambda x: x.cast("double") / (norm(v) + F.lit(epsilon)))


def mean_vector(df: DataFrame, keys: list[str], vector: str, out: str = "vector") -> DataFrame:
    """keys, out: the mean of a group's vectors.  Dimensions are averaged as rows, so a group is never held whole."""
    each = df.select(*keys, F.posexplode(vector).alias("__d", "__x"))
    mean = each.groupBy(*keys, "__d").agg(F.avg(F.col("__x").cast("double")).alias("__m"))
    dims = mean.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("__d", "__m"))).alias("__v"))
    return dims.select(*keys, F.transform("__v", lambda x: x["__m"]).alias(out))


def usable(df: DataFrame, vector: str) -> DataFrame:
    return df.where(norm(F.col(vector)) > 0)
