"""Connected components of an edge table, and groups dealt out in bounded blocks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise, salted, shared_dir

#: Neighbours of a node are dealt over so many tasks where they join with its least one: the hub of a star has very many.
SALTS = 8


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """node, root for every node of edges(a, b): root is the least node of its component.

    Alternating large-star and small-star steps: each node's neighbours move to its least neighbour.  A step aggregates
    before its exchange and joins on the node, never lists a node's neighbours in one place, and halves the depth.  Each
    round is written to the shared folder, so lineage stays short; only two sums go to the driver."""
    folders = [shared_dir(edges.sparkSession) for _ in range(2)]  # a round reads one and replaces the other
    edges = materialise(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), folders[0])
    seen = None
    for k in range(1, most_rounds + 1):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        dealt = both.where("v > u").withColumn("salt", F.pmod(F.xxhash64("v"), F.lit(SALTS)).cast("int"))
        # merged, not broadcast: salts make a table that is small by its files a large one
        met = dealt.join(salted(least, SALTS).hint("merge"), ["u", "salt"])
        large = met.select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        down = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(down, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        edges = materialise(small.unionByName(down.select("u", F.col("m").alias("v"))).distinct(), folders[k % 2])
        state = tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first())
        if state == seen:
            break
        seen = state
    else:
        raise RuntimeError(f"components have not settled in {most_rounds} rounds")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def in_blocks(rows: DataFrame, group: str, node: str, size: str, block: int) -> DataFrame:
    """rows with lo and hi: groups whose column `size` (rows, or what they weigh) is up to `block` stay whole as (0, 0); a
    larger one is cut by hash into k blocks, and each pair of blocks becomes a group of its own, so every pair of rows still
    meets somewhere and the groups are about two blocks at most."""
    k = F.ceil(F.col(size) / block).cast("long")
    cut = rows.withColumn("__b", F.pmod(F.xxhash64(node), k)).withColumn("__o", F.explode(F.when(k > 1, F.sequence(F.lit(0).cast("long"), k - 1)).otherwise(F.array(F.lit(0).cast("long")))))
    return cut.select("*", F.least("__b", "__o").alias("lo"), F.greatest("__b", "__o").alias("hi")).drop("__b", "__o")


def whole_groups(batches: Iterator[pd.DataFrame], keys: list[str]) -> Iterator[pd.DataFrame]:
    """Runs of equal keys of a sorted stream, each whole though batches end anywhere."""
    held: list[pd.DataFrame] = []
    for pdf in batches:
        if not len(pdf):
            continue
        k = [pdf[c].to_numpy() for c in keys]
        cuts = np.flatnonzero(np.logical_or.reduce([c[1:] != c[:-1] for c in k])) + 1
        parts = [pdf.iloc[a:b] for a, b in zip([0, *cuts], [*cuts, len(pdf)], strict=True)]
        if held and all(held[0][c].iloc[0] == v[0] for c, v in zip(keys, k, strict=True)):
            held.append(parts.pop(0))
        for part in parts:
            if held:
                yield pd.concat(held) if len(held) > 1 else held[0]
            held = [part]
    if held:
        yield pd.concat(held) if len(held) > 1 else held[0]
