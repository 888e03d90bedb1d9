"""Mixing sources to target weights by Pfair scheduling: earliest deadline first over released blocks."""

from __future__ import annotations

from math import ceil
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import column, dense_rank_within, documents, unpacked_row, whole_row

#: Target weights of the production mixture, in parts.  Every source that isn't named, and the null source, shares REST.
TARGETS = {f"src{i}": 1 + i % 5 for i in range(20)}
REST, REST_PARTS = "*", 2
#: Documents in a block.
BLOCK = 32
#: The parts of a table may sum to so much: the schedule of a period has that many slots.
MOST_PARTS = 100_000


class Piece(NamedTuple):
    """How a pool's blocks first..last fall on slots while the set of pools that have blocks left stays the same."""

    pool: str
    first: int
    last: int
    slot: int
    period: int
    offsets: list[int]


def period_of(parts: dict[str, int]) -> dict[str, list[int]]:
    """Slots of one period (the sum of the parts) for each pool.

    Block j of a pool of weight w is released at floor(j / w) and due at ceil((j + 1) / w).  In each slot the released
    block that is due first runs; ties go to the larger weight, then to the name.  Weights sum to 1, so all blocks meet
    their windows, and after any number of slots each pool is less than one block from its share."""
    total = sum(parts.values())
    if not 0 < total <= MOST_PARTS:
        raise ValueError(f"parts must sum to 1..{MOST_PARTS}")
    slots: dict[str, list[int]] = {p: [] for p in parts}
    for t in range(total):
        ready = [(ceil((len(slots[p]) + 1) * total / n), -n, p) for p, n in parts.items() if len(slots[p]) < n and len(slots[p]) * total // n <= t]
        slots[min(ready)[2]].append(t)
    return slots


def schedule(blocks: dict[str, int], parts: dict[str, int]) -> list[Piece]:
    """Pieces for all blocks.  When a pool runs out, the others go on with the same parts among themselves, from a new
    start; so no block is dropped and none repeated, and within a phase every pool keeps its share."""
    left = {p: n for p, n in blocks.items() if n > 0}
    done, start, out = dict.fromkeys(left, 0), 0, []
    while left:
        total = sum(parts[p] for p in left)
        slots = period_of({p: parts[p] for p in left})
        end = min((n - 1) // len(slots[p]) * total + slots[p][(n - 1) % len(slots[p])] for p, n in left.items()) + 1
        for p in list(left):
            used = end // total * len(slots[p]) + sum(s < end % total for s in slots[p])
            if used:
                out.append(Piece(p, done[p], done[p] + used - 1, start, total, slots[p]))
            done[p] += used
            left[p] -= used
            if not left[p]:
                del left[p]
        start += end
    return out


def _pool(source: Column, targets: dict[str, int]) -> Column:
    return F.when(source.isin(*targets), source).otherwise(F.lit(REST)) if targets else F.lit(REST)


def placed(docs: DataFrame, targets: dict[str, int] | None = None, rest: int = REST_PARTS, block: int = BLOCK, id_col: str = "doc_id", source_col: str = "source") -> DataFrame:
    """row (the whole row of docs), pool, block, slot, within and position (0, 1, ...: the order of the mixture).

    Within a source, documents stand in the order of the MD5 of their id, which the id alone decides; rows without an id
    come after the others, by a hash of the row.  Rows of equal id stand side by side.  Nothing is dropped or repeated.  A
    null source is in the rest; an empty table gives no rows.  What goes through the driver is a count for each named source;
    tasks hold slices of a source, never a source."""
    targets = TARGETS if targets is None else targets
    if rest < 1 or min(targets.values(), default=0) < 0:
        raise ValueError("parts are whole numbers, of the rest at least 1: its documents must go somewhere")
    parts = {**{k: v for k, v in targets.items() if v > 0}, REST: rest}
    named = {k: v for k, v in targets.items() if v > 0}
    pooled = docs.select(whole_row(docs).alias("row"), column(id_col).alias("id"), _pool(column(source_col), named).alias("pool"))
    counts = {r[0]: r[1] for r in pooled.groupBy("pool").count().collect()}  # one row for each named source at most
    pieces = schedule({p: -(-n // block) for p, n in counts.items()}, parts)
    key = F.when(F.col("id").isNotNull(), F.md5(F.col("id").cast("string").cast("binary"))).otherwise(F.concat(F.lit("z"), F.lpad(F.hex(F.xxhash64("row")), 16, "0")))
    ranked = dense_rank_within(pooled.withColumn("key", key), "pool", ["key", "id"], F.substring("key", 1, 3), "k")
    ranked = ranked.withColumns({"block": F.floor(F.col("k") / block).cast("long"), "within": (F.col("k") % block).cast("int")})
    # Position: blocks are full but for the last of each pool, which lacks a known number at a known slot.
    at = {p.pool: p for p in pieces}  # the last piece of each pool
    short = []
    for pool, n in counts.items():
        if n % block:
            j = at[pool].last - at[pool].first
            short.append((at[pool].slot + j // len(at[pool].offsets) * at[pool].period + at[pool].offsets[j % len(at[pool].offsets)], block - n % block))
    names = ("row", "pool", "block", "slot", "within", "position")
    if not pieces:
        return ranked.withColumns({"slot": F.lit(None).cast("long"), "position": F.lit(None).cast("long")}).select(*names)
    table = [
        F.struct(F.lit(p.pool).alias("p"), F.lit(p.first).cast("long").alias("first"), F.lit(p.last).cast("long").alias("last"), F.lit(p.slot).cast("long").alias("start"), F.lit(p.period).cast("long").alias("period"), F.lit(p.offsets).alias("offsets"))
        for p in pieces
    ]
    # At most (targets + 1) squared rows, whose offsets sum to the parts for each phase: bounded by the weights, not the data.
    plan = docs.sparkSession.range(1).select(F.inline(F.array(*table)))
    met = ranked.join(F.broadcast(plan), (F.col("pool") == F.col("p")) & F.col("block").between(F.col("first"), F.col("last")))
    j, n = F.col("block") - F.col("first"), F.size("offsets")
    slot = F.col("start") + F.floor(j / n).cast("long") * F.col("period") + F.get(F.col("offsets"), (j % n).cast("int"))
    lacking = F.lit(0).cast("long")
    for s, d in short:
        lacking = lacking + F.when(F.col("slot") > s, F.lit(d)).otherwise(F.lit(0))
    return met.withColumn("slot", slot).withColumn("position", F.col("slot") * block + F.col("within") - lacking).select(*names)


def mix(docs: DataFrame, targets: dict[str, int] | None = None, **options) -> DataFrame:
    """docs with __pool, __block, __slot, __within and __position, as `placed` gives them; columns of docs that have these
    names are replaced."""
    names = ("pool", "block", "slot", "within", "position")
    kept = [c for c in docs.columns if c not in {f"__{n}" for n in names}]
    return placed(docs, targets, **options).select(*unpacked_row("row", kept), *(F.col(n).alias(f"__{n}") for n in names))


def mixed(docs: DataFrame, **options) -> DataFrame:
    """docs with the same columns, in the order of the mixture: sorted by range over the files that are written.  Repeated rows
    and rows without an id all stay; columns go along whatever their names."""
    return placed(docs, **options).orderBy("position").select(*unpacked_row("row", docs.columns))


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The place of every document in the production mixture.  Null sources are in the rest; repeated rows have places side by
    side."""
    out = placed(documents(spark, sf_dir).select("doc_id", "source"))
    return out.select("row.doc_id", "row.source", "pool", *(F.col(c).cast("long").alias(c) for c in ("block", "within", "slot", "position")))


def _oracle() -> str:
    """The schedule as a simulation, slot by slot, over a list of pools: p, n (parts), rest and done (blocks), j (blocks since the
    set of pools last changed, which is t slots ago)."""
    named = ", ".join(f"'{p}'" for p in TARGETS)
    parts = " ".join(f"WHEN '{p}' THEN {n}" for p, n in TARGETS.items())
    return f"""
WITH RECURSIVE pooled AS (SELECT doc_id, source, CASE WHEN source IN ({named}) THEN source ELSE '{REST}' END AS pool FROM documents),
ranked AS (SELECT *, (k // {BLOCK})::BIGINT AS block, (k % {BLOCK})::BIGINT AS within FROM (
  SELECT *, row_number() OVER (PARTITION BY pool ORDER BY md5(coalesce(doc_id::VARCHAR, '')), doc_id) - 1 AS k FROM pooled)),
start AS (SELECT list({{'p': pool, 'n': parts, 'rest': rest, 'done': 0::BIGINT, 'j': 0::BIGINT}}) AS s FROM (
  SELECT pool, (CASE pool {parts} ELSE {REST_PARTS} END)::BIGINT AS parts, count(DISTINCT block)::BIGINT AS rest FROM ranked GROUP BY pool)),
run AS (
  SELECT 0::BIGINT AS next, 0::BIGINT AS t, s, NULL::VARCHAR AS pool, NULL::BIGINT AS block FROM start
  UNION ALL
  SELECT next + 1, CASE WHEN ends THEN 0 ELSE t + 1 END, list_transform(s, lambda x: {{'p': x.p, 'n': x.n, 'rest': x.rest - (x.p = c)::BIGINT, 'done': x.done + (x.p = c)::BIGINT, 'j': CASE WHEN ends THEN 0 ELSE x.j + (x.p = c)::BIGINT END}}),
    c, list_filter(s, lambda x: x.p = c)[1].done
  FROM (SELECT *, list_filter(s, lambda x: x.p = c)[1].rest = 1 AS ends FROM (
    SELECT *, list_min(list_transform(list_filter(alive, lambda x: x.j * total // x.n <= t), lambda x: {{'due': ((x.j + 1) * total + x.n - 1) // x.n, 'less': -x.n, 'p': x.p}})).p AS c FROM (
      SELECT *, list_sum(list_transform(alive, lambda x: x.n))::BIGINT AS total FROM (SELECT *, list_filter(s, lambda x: x.rest > 0) AS alive FROM run) WHERE len(alive) > 0)))),
slots AS (SELECT next - 1 AS slot, pool, block FROM run WHERE pool IS NOT NULL),
starts AS (SELECT *, (sum(n) OVER (ORDER BY slot) - n)::BIGINT AS first FROM (SELECT slot, pool, block, count(*) AS n FROM ranked JOIN slots USING (pool, block) GROUP BY ALL))
SELECT doc_id, source, pool, block, within, slot, first + within AS position FROM ranked JOIN starts USING (pool, block)"""


QUERIES = {"op8_mixing": op8_mixing}
ORACLES = {"op8_mixing": _oracle()}
