"""Near-dedup: banded MinHash candidates, verified by odd sketches and confirmed on full shingle sets."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import lru_cache
from math import ceil, log, log1p
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WordHashes, column, documents, frugal, likely, materialise, mix64, unpacked_row, whole_row
from .components import components, in_blocks, whole_groups

SHINGLE = 5
#: Linked: 100 * intersection >= percent * union.  PERCENT is the value of the query; STAGE_PERCENT that of near_dedup, as of
#: all stages on word shingles.
PERCENT, STAGE_PERCENT = 85, 80
#: Rows of a band, and the bands at PERCENT: a pair at the threshold shares none with odds (1 - 0.85 ** ROWS) ** BANDS = 8e-7.
BANDS, ROWS = 24, 5
#: Those odds bound the bands at every threshold.
MISS = 8e-7
#: Bits of the odd sketch of a text's samples.
BITS = 512
#: Candidates go on if the sketch puts their similarity at the threshold less this or more: six standard deviations.
SKETCH_MARGIN = 0.2
#: Rows of a bucket, and shingles of a candidate component, that one task compares; larger groups go by pairs of blocks.
SKETCH_BLOCK, TEXT_BLOCK = 20_000, 3_000_000

_STEP = np.uint64(0x9E3779B97F4A7C15)


class Family(NamedTuple):
    """Numbers that make the samples of a text and the hashes of its bands."""

    xor: np.ndarray
    odd: np.ndarray
    band: np.ndarray


@lru_cache
def family(bands: int = BANDS) -> Family:
    rng = np.random.default_rng(20_240)
    draw = lambda *shape: rng.integers(0, 2**64, shape, dtype=np.uint64)
    return Family(draw(bands * ROWS), draw(bands * ROWS) | np.uint64(1), draw(bands, ROWS) | np.uint64(1))


def bands_for(percent: int) -> int:
    """The fewest bands by which a pair at the threshold is missed with odds of MISS at most: 24 at 85, 36 at 80."""
    return max(1, ceil(log(MISS) / log1p(-((percent / 100) ** ROWS)))) if percent < 100 else 1


def shingles(text: str, hashes: WordHashes, size: int = SHINGLE) -> np.ndarray:
    """Sorted distinct 64-bit hashes of a text's shingles; A-Z in lower case, words between ASCII white space."""
    h = hashes(text.encode().lower().split())  # bytes: only ASCII letters and spaces count
    n = min(size, len(h))
    if not n:
        return h
    s = np.full(len(h) - n + 1, n, np.uint64)
    for k in range(n):
        s = s * _STEP + h[k : len(h) - n + 1 + k]
    return np.unique(mix64(s))


def minhashes(s: np.ndarray, bands: int = BANDS) -> np.ndarray:
    xor, odd, _ = family(bands)
    least = np.full(len(odd), np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(s), 1024):
        np.minimum(least, ((s[None, i : i + 1024] ^ xor[:, None]) * odd[:, None]).min(1), out=least)
    return least


def odd_sketch(least: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Parity bitmap: each sample (its number and value) flips one bit, so samples that two sets share cancel in the XOR."""
    at = mix64(least + np.arange(1, len(least) + 1, dtype=np.uint64) * _STEP) % np.uint64(bits)
    return np.packbits((np.bincount(at.astype(np.int64), minlength=bits) & 1).astype(np.uint8))


def similarity(differing_bits: np.ndarray, samples: int = BANDS * ROWS, bits: int = BITS) -> np.ndarray:
    """Jaccard similarity from the population count of the XOR of two odd sketches."""
    share = np.minimum(2 * differing_bits / bits, 1 - 1 / bits)
    return 1 + bits * np.log1p(-share) / (4 * samples)


SIGNATURE = "doc_id long, node long, n_shingles long, set_key string, bands array<long>, sketch binary"


def _signatures(bands: int) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    def signatures(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import hashlib

        hashes, names, weights = WordHashes(), [c.split()[0] for c in SIGNATURE.split(", ")], family(bands).band
        for pdf in batches:
            rows = []
            for doc_id, node, text in zip(pdf["doc_id"], pdf["node"], pdf["t"], strict=True):
                s = shingles(text, hashes)
                if len(s):
                    least = minhashes(s, bands)
                    keys = mix64((least.reshape(bands, ROWS) * weights).sum(1) + np.arange(bands, dtype=np.uint64) * _STEP).view(np.int64)
                    rows.append((doc_id, node, len(s), hashlib.md5(s.tobytes()).hexdigest(), keys, odd_sketch(least).tobytes()))
                else:
                    rows.append((doc_id, node, 0, None, None, None))
            yield pd.DataFrame(rows, columns=names)

    return signatures


def _spread(n: int, near: Callable[[int, np.ndarray], np.ndarray]) -> np.ndarray:
    """Number of each item's component, where near(i, others) says which of the others are linked with i.
    An item is compared only with those that have no component yet."""
    of, free = np.full(n, -1), np.arange(n)
    while len(free):
        root, free = free[0], free[1:]
        of[root], queue = root, [root]
        while queue and len(free):
            x = queue.pop()
            hit = near(x, free)
            new, free = free[hit], free[~hit]
            of[new] = root
            queue += new.tolist()
    return of


def _sketch_edges(bands: int, floor: float) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """Edges that span what the sketches join within a bucket (or a pair of blocks of one)."""

    def edges(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in whole_groups(batches, ["bucket", "lo", "hi"]):
            nodes = pdf["node"].to_numpy()
            sketch = np.frombuffer(b"".join(pdf["sketch"]), np.uint64).reshape(len(pdf), -1)
            of = _spread(len(pdf), lambda x, rest: similarity(np.bitwise_count(sketch[rest] ^ sketch[x]).sum(1, dtype=np.int64), bands * ROWS) >= floor)  # noqa: B023
            other = of != np.arange(len(pdf))
            if other.any():
                yield pd.DataFrame({"a": nodes[other], "b": nodes[of[other]]})

    return edges


def _joined(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Many small frames as few larger ones."""
    held, rows = [], 0
    for pdf in batches:
        held.append(pdf)
        rows += len(pdf)
        if rows >= 5_000:
            yield pd.concat(held)
            held, rows = [], 0
    if held:
        yield pd.concat(held)


def linked(a: int, b: np.ndarray, both: np.ndarray, percent: int = PERCENT) -> np.ndarray:
    return 100 * both >= percent * (a + b - both)


def _confirmed(percent: int) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """Edges that span the exact links among the texts of a candidate component (or a pair of blocks of one)."""

    def confirmed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hashes = WordHashes()
        for pdf in whole_groups(batches, ["root", "lo", "hi"]):
            pdf = pdf.drop_duplicates("node")
            nodes, sets = pdf["node"].to_numpy(), [shingles(t, hashes) for t in pdf["t"]]
            size = np.array([len(s) for s in sets])
            # Postings of each shingle: intersections of one set with all others are counted at once.
            owner = np.repeat(np.arange(len(sets)), size)
            _, code = np.unique(np.concatenate(sets), return_inverse=True)
            order = np.argsort(code, kind="stable")
            postings, ends = owner[order], np.cumsum(np.bincount(code))
            starts = np.concatenate(([0], ends[:-1]))
            first = np.concatenate(([0], np.cumsum(size)))

            def near(x: int, rest: np.ndarray) -> np.ndarray:
                c = code[first[x] : first[x + 1]]  # noqa: B023
                lengths = ends[c] - starts[c]  # noqa: B023
                at = np.repeat(starts[c] - np.concatenate(([0], np.cumsum(lengths)[:-1])), lengths) + np.arange(lengths.sum())  # noqa: B023
                both = np.bincount(postings[at], minlength=len(sets))[rest]  # noqa: B023
                return linked(size[x], size[rest], both, percent)  # noqa: B023

            of = _spread(len(sets), near)
            other = of != np.arange(len(sets))
            if other.any():
                yield pd.DataFrame({"a": nodes[other], "b": nodes[of[other]]})

    return confirmed


def _dealt(rows: DataFrame, keys: list[str]) -> DataFrame:
    return rows.repartition(*keys).sortWithinPartitions(*keys)


def _node(id_col: str, text_col: str) -> Column:
    """Rows of equal id and text are one node."""
    return F.xxhash64(column(id_col).cast("long"), F.xxhash64(F.coalesce(column(text_col), F.lit(""))))


def _classes(docs: DataFrame, id_col: str, text_col: str, percent: int) -> tuple[DataFrame, DataFrame]:
    """What stands in each row (doc_id, node, n_shingles, set_key), and for each set_key its class's least: struct(none (no id),
    doc_id, node), which is one node also where ids are null or stand twice."""
    bands = bands_for(percent)
    read = docs.select(column(id_col).cast("long").alias("doc_id"), F.coalesce(column(text_col), F.lit("")).alias("t"), _node(id_col, text_col).alias("node"))
    signed = materialise(read.mapInPandas(frugal(_signatures(bands)), SIGNATURE))
    low = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "node"))
    heads = signed.where("n_shingles > 0").groupBy("set_key").agg(low.alias("low")).withColumn("head", F.col("low.node"))
    reps = signed.join(heads.select("set_key", "head"), "set_key").where("node = head").select("node", "n_shingles", "bands", "sketch").dropDuplicates(["node"])
    met = reps.select("node", F.explode("bands").alias("bucket"))
    full = met.groupBy("bucket").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
    shared = met.join(full, "bucket").join(reps.select("node", "sketch"), "node")
    blocks = _dealt(in_blocks(shared, "bucket", "node", "size", SKETCH_BLOCK), ["bucket", "lo", "hi"])
    near = components(blocks.mapInPandas(frugal(lambda b: _joined(_sketch_edges(bands, percent / 100 - SKETCH_MARGIN)(b))), "a long, b long"))
    weighed = near.join(reps.select("node", "n_shingles"), "node")
    sized = near.join(weighed.groupBy("root").agg(F.sum("n_shingles").alias("size")), "root")
    # A text that stands in many rows is fetched once: rows of a node meet in their own tasks before the exchange.
    once = likely(read.select("node", "t"), near).groupBy("node").agg(F.first("t").alias("t"))
    texts = in_blocks(once.join(sized, "node"), "root", "node", "size", TEXT_BLOCK)
    links = components(_dealt(texts, ["root", "lo", "hi"]).mapInPandas(frugal(lambda b: _joined(_confirmed(percent)(b))), "a long, b long"))
    # Classes are settled among distinct sets; rows meet them once, by set.
    classed = heads.join(links.withColumnRenamed("node", "head"), "head", "left").withColumn("class", F.coalesce("root", "head"))
    least = classed.groupBy("class").agg(F.min("low").alias("least"))
    return signed.select("doc_id", "node", "n_shingles", "set_key"), classed.join(least, "class").select("set_key", "least")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = PERCENT) -> DataFrame:
    """doc_id, node, n_shingles, component_id and kept for every row.

    1. One pass makes each text's shingle set, MinHash samples, band hashes and odd sketch; sets that are equal become
       one node before anything else, so copies, however many, cost one row.
    2. Nodes meet in band buckets.  Inside a bucket odd sketches decide who goes on, and only edges that span the joined
       nodes come out, never pairs: a bucket of m nodes gives less than m edges.
    3. Texts of the candidate components are fetched and compared on full sets.  Only confirmed links count; a text is
       compared with every text of its candidate component that isn't yet in one class with it.
    4. Components of confirmed links; component_id is the least doc_id in one.
    Groups beyond a block's size are compared by pairs of blocks: exact, in bounded memory, at a cost that grows with the
    square of the number of blocks.

    Texts are linked at a similarity of `percent` or more; bands and the sketches' floor follow it.

    Null or wordless texts have no shingles and are linked with nothing.  Rows of equal id and text are one node and get
    equal results.  Null ids count as larger than all others; a class of null ids alone has a null component_id and all its
    rows are kept here, where the id decides.  An empty table gives no rows.  Nodes and shingles are 64-bit hashes."""
    signed, of_set = _classes(docs, id_col, text_col, percent)
    out = signed.join(of_set, "set_key", "left")
    component = F.when(F.col("n_shingles") > 0, F.col("least.doc_id")).otherwise(F.col("doc_id"))
    return out.select("doc_id", "node", "n_shingles", component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))


def near_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = STAGE_PERCENT) -> DataFrame:
    """One row of docs for each class of near duplicates: that of the least doc_id, null ids last.  Where several rows have
    that id and text, one of them stays; so no exact copy is left, of null ids neither.  Texts without a word are linked with
    nothing: of those only rows that are equal in id and text become one.  All columns go along, whatever their names; an
    empty table gives no rows."""
    signed, of_set = _classes(docs, id_col, text_col, percent)
    gone = signed.where("n_shingles > 0").join(of_set, "set_key").where("node != least.node").select("node").distinct()
    rows = docs.select(_node(id_col, text_col).alias("node"), whole_row(docs).alias("row")).groupBy("node").agg(F.first("row").alias("row"))
    return rows.join(gone, "node", "left_anti").select(*unpacked_row("row", docs.columns))


def op2_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The class of every document at a similarity of 0.85; empty and null texts stand alone, repeated rows are of one class."""
    return near_duplicates(documents(spark, sf_dir)).drop("node")


QUERIES = {"op2_near_dedup": op2_near_dedup}
#: Hashing in bands isn't SQL: tests hold the components against exact comparison of all pairs.
ORACLES: dict[str, str] = {}
