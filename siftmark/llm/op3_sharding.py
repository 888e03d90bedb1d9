"""Sharding by a hierarchical weighted hash tree: region, rack and shard are drawn level by level."""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import column, dense_rank_within, documents, unpacked_row, whole_row


class Node(NamedTuple):
    """A subtree.  A leaf has a shard number and a weight of its own; else the weight is the sum of the children's."""

    name: str
    children: tuple["Node", ...] = ()
    shard: int = -1
    own_weight: int = 1

    @property
    def weight(self) -> int:
        return sum(c.weight for c in self.children) if self.children else self.own_weight


#: The tree in production: regions of racks of shards, all of weight 1.
REGIONS, RACKS, SHARDS_PER_RACK = 3, 2, 4
#: Slices in which a shard's rows are numbered; the offsets of all slices are SLICES * shards rows.
SLICES = 1024


def tree(shards: int) -> Node:
    """The first 24 shards fill three regions; each shard after them opens a region of its own.

    A new region changes no other subtree's weight, so one more shard takes rows only into itself.
    """
    regions: dict[str, dict[str, list[Node]]] = {}
    per_region = RACKS * SHARDS_PER_RACK
    for s in range(shards):
        in_base = s < REGIONS * per_region
        region = f"region{s // per_region}" if in_base else f"region{REGIONS + s - REGIONS * per_region}"
        rack = f"rack{s % per_region // SHARDS_PER_RACK}" if in_base else "rack0"
        regions.setdefault(region, {}).setdefault(rack, []).append(Node(f"shard{s}", shard=s))
    return Node("root", tuple(Node(r, tuple(Node(k, tuple(leaves)) for k, leaves in racks.items())) for r, racks in regions.items()))


def draw(key: Column, path: str, weight: int) -> Column:
    """An exponential draw of rate `weight`, fixed by key and path: the least draw wins with odds in proportion to weight.
    It depends on the node's own path and weight only, so rows move only to or from subtrees whose weight changes."""
    unit = (F.shiftrightunsigned(F.xxhash64(key, F.lit(path)), 11).cast("double") + 0.5) / F.lit(float(2**53))
    return -F.log(unit) / F.lit(float(weight))


def _winner(key: Column, children: list[tuple[int, Node, str]]) -> Column:
    """Number of the child that wins the draw."""
    if len(children) == 1:
        return F.lit(children[0][0])
    return F.array_min(F.array(*(F.struct(draw(key, path, c.weight).alias("d"), F.lit(i).alias("i")) for i, c, path in children)))["i"]


def place_of(key: Column, root: Node) -> list[Callable[[Column], Column]]:
    """The levels of a descent as projections: the number of the child drawn at each, then the leaf's place."""
    numbers = iter(range(1_000_000))
    level, steps = [(next(numbers), root, "")], []
    while any(n.children for _, n, _ in level):
        below, cases = [], []
        for i, node, path in level:
            children = [(next(numbers), c, f"{path}/{c.name}") for c in node.children if c.weight > 0]
            if children:
                cases.append((i, _winner(key, children)))
            below += children or [(i, node, path)]

        def step(at: Column, cases: list = cases) -> Column:
            out = F
            for i, winner in cases:
                out = out.when(at == i, winner)
            return out.otherwise(at)

        steps.append(step)
        level = below
    leaves = [(i, [*path.split("/")[1:], "", ""], n.shard) for i, n, path in level]
    place = F.map_from_arrays(F.lit([i for i, _, _ in leaves]), F.array(*(F.struct(F.lit(p[0]).alias("region"), F.lit(p[1]).alias("rack"), F.lit(s).alias("shard")) for _, p, s in leaves)))
    return [*steps, lambda at: F.element_at(place, at)]


def assign(df: DataFrame, root: Node, key_col: str = "doc_id", out: str = "place") -> DataFrame:
    """df with the column `out`: struct(region, rack, shard).  Projections only: no exchange, no state.

    Level by level, each row draws among the children of the node that it has come to.  A null key is a key like any
    other; equal keys, and so repeated rows, go to the same shard.  An existing column `out` is replaced; columns may have
    any names.  An empty table gives no rows."""
    at = df.select(whole_row(df).alias("row"), column(key_col).alias("key"), F.lit(0).alias("at"))
    for step in place_of(F.col("key"), root):
        at = at.select("row", "key", step(F.col("at")).alias("at"))
    return at.select(*unpacked_row("row", [c for c in df.columns if c != out]), F.col("at").alias(out))


def write_sharded(df: DataFrame, root: Node, path: str, key_col: str = "doc_id") -> None:
    """Write df as region=/rack=/shard= folders; a shard of any size is written by as many tasks as hold its rows.  Columns of
    df that are named region, rack or shard give way to those of the folders."""
    out = assign(df, root, key_col, "__place")
    kept = [c for c in df.columns if c not in ("region", "rack", "shard", "__place")]
    out.select(*(column(c) for c in kept), "__place.region", "__place.rack", "__place.shard").write.partitionBy("region", "rack", "shard").parquet(path)


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents over 24 shards under the law `key`, with the shard that 25 would give.

    Null text: size 8 and the CRC of no bytes (0).  slot numbers a shard's rows from 0 without gaps, by slice of the
    key's hash (of the text's CRC where the key is null) and then by doc_id, CRC and size; equal rows take neighbouring slots."""
    text, key = F.coalesce(F.col("text"), F.lit("")), F.col("doc_id")
    rows = documents(spark, sf_dir).select("doc_id", (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    rows = assign(assign(rows, tree(24), out="place"), tree(25), out="grown")
    rows = rows.select(
        "doc_id", "size", "text_crc32", F.lit("key").alias("law"), "place.shard", F.col("grown.shard").alias("grown_shard"), "place.region", "place.rack"
    )
    part = F.shiftrightunsigned(F.xxhash64(F.coalesce(key, F.col("text_crc32")), F.lit("slot")), 54)  # without an id, by text
    placed = dense_rank_within(rows, "shard", ["doc_id", "text_crc32", "size"], part, "slot")
    return placed.select("doc_id", "size", "text_crc32", "law", F.col("shard").cast("int"), "slot", F.col("grown_shard").cast("int"), "region", "rack")


QUERIES = {"op3_sharding": op3_sharding}
#: SQL has no CRC-32 and no 64-bit hash in common with Spark: tests hold the query against a plain version.
ORACLES: dict[str, str] = {}
