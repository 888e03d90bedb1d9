"""Helpers shared by the training-data operators."""

from __future__ import annotations

import contextlib
import gc
import itertools
import os
import tempfile
import time
import zipfile
from collections.abc import Callable, Iterator
from pathlib import Path

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: A run of the six ASCII white-space characters separates words (Java and RE2 syntax).
SPACE_RUN = r"[\x20\x09-\x0D]+"
_serial = itertools.count()
_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package to the Python workers, once for each application, unless they find it where the driver does:
    beside the working folder, on PYTHONPATH, or installed."""
    root, app = Path(__file__).resolve().parents[2], spark.sparkContext.applicationId
    found = {Path(p).resolve() for p in os.environ.get("PYTHONPATH", "").split(os.pathsep) if p}
    if spark.sparkContext.master.split("[")[0] == "local":  # workers start where the driver did
        found.add(Path.cwd())
    if app in _shipped or root in found or root.name in ("site-packages", "dist-packages"):
        return
    archive = Path(tempfile.mkdtemp()) / "siftmark.zip"  # the driver serves it to the executors
    with zipfile.ZipFile(archive, "w") as z:
        for f in sorted((root / "siftmark").rglob("*.py")):
            z.write(f, f.relative_to(root))
    spark.sparkContext.addPyFile(str(archive))
    _shipped.add(app)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def words_of(text: Column) -> Column:
    """Words of a text as an array; a null text has none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE_RUN), "")


def shared_dir(spark: SparkSession) -> str:
    """A fresh folder that driver and executors share, in the session's spark.checkpoint.dir.  Where that is unset, a local
    folder takes its place if the master is local, as in tests; on a cluster nothing can, so it is an error."""
    sc = spark.sparkContext
    base = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not base:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = tempfile.mkdtemp(prefix="siftmark-")
        sc.setCheckpointDir(base)
    return f"{base.rstrip('/')}/siftmark-{sc.applicationId}-{next(_serial)}"


def materialise(df: DataFrame, path: str | None = None) -> DataFrame:
    """Write df to the shared folder and read it back: lineage is cut and a lost executor costs nothing.  A path that is
    given again is replaced, so a loop that alternates between two never keeps more than two tables."""
    path = path or shared_dir(df.sparkSession)
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def quoted(name: str) -> str:
    """A column's name as Spark's parser reads it: names may hold dots, spaces and backquotes."""
    return "`" + name.replace("`", "``") + "`"


def column(name: str) -> Column:
    return F.col(quoted(name))


def whole_row(docs: DataFrame) -> Column:
    """All columns as one struct.  Operators that hand rows on carry this beside columns of their own, so that no name of
    the table can clash with theirs."""
    return F.struct(*(column(c) for c in docs.columns))


def unpacked_row(row: str, names: list[str], **replaced: Column) -> list[Column]:
    """The columns of a whole_row again, some of them replaced."""
    return [replaced[c].alias(c) if c in replaced else F.col(row).getItem(c).alias(c) for c in names]


def salted(few: DataFrame, salts: int, salt: str = "salt") -> DataFrame:
    """`few` once for each salt: joined on key and salt, rows of a hot key are dealt over so many tasks."""
    return few.withColumn(salt, F.explode(F.lit(list(range(salts)))))


def maybe(rows: DataFrame, nodes: DataFrame, out: str) -> DataFrame:
    """rows with `out`: whether their `node` may be among `nodes`; false is certain.  By a filter of 2 ** 23 bits, broadcast
    as at most 2 ** 17 rows of 64 bits.  Its size is fixed; where it fills up it only says true more often."""
    word, bit = F.pmod("node", F.lit(1 << 17)), F.expr("CAST(shiftrightunsigned(node, 17) & 63 AS INT)")
    bits = nodes.select(word.alias("__word"), bit.alias("__bit")).groupBy("__word").agg(F.bit_or(F.expr("shiftleft(1L, __bit)")).alias("__bits"))
    met = F.expr("coalesce(shiftright(__bits, CAST(shiftrightunsigned(node, 17) & 63 AS INT)) & 1 = 1, false)")
    return rows.join(F.broadcast(bits), word == F.col("__word"), "left").withColumn(out, met).drop("__word", "__bits")


def likely(rows: DataFrame, nodes: DataFrame) -> DataFrame:
    """The rows whose `node` may be among `nodes`, by a filter of fixed size: where it fills up it only lets more rows
    through to the join that follows."""
    return maybe(rows, nodes, "__met").where("__met").drop("__met")


def release_shuffles(spark: SparkSession) -> None:
    """Let Spark's cleaner delete the shuffle files of steps that are done: it does once the driver has collected the
    frames that nothing refers to any more, which otherwise may be long after."""
    for _ in range(2):  # the second pass finds what the first has let go of on the other side
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        time.sleep(0.5)  # the cleaner works beside us


def give_back() -> None:
    """Return what is free to the system: Python workers are kept for later tasks, and what they hold counts as the executor's."""
    import ctypes

    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # other C libraries do without
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def frugal(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """A function over a partition's batches that leaves its worker small when it is done."""

    def wrapped(batches: Iterator) -> Iterator:
        try:
            yield from run(batches)
        finally:
            gc.collect()
            give_back()

    return wrapped


def dense_rank_within(df: DataFrame, group: str, order: list[str], part: Column, out: str) -> DataFrame:
    """Number rows 0, 1, ... within `group` without bringing a group into one task.

    `part` cuts each group into slices that follow `order` (slice first, then order inside it), so a hot
    group spreads over as many tasks as it has slices.  Slice sizes are counted first and turned into offsets;
    the offsets join on the same keys that the row numbers are dealt by, so rows are shuffled once.  Neither `group`
    nor `part` may be null.
    """
    sliced = df.withColumn("__part", part)
    sizes = sliced.groupBy(group, "__part").agg(F.count(F.lit(1)).alias("__n"))
    before = Window.partitionBy(group).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(
        F.col(group).alias("__g"), F.col("__part").alias("__p"), F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__offset")
    )
    inside = Window.partitionBy(group, "__part").orderBy(*order)
    ranked = sliced.withColumn("__r", F.row_number().over(inside) - 1)
    joined = ranked.join(offsets, (F.col(group) == F.col("__g")) & (F.col("__part") == F.col("__p")))
    return joined.withColumn(out, (F.col("__r") + F.col("__offset")).cast("long")).drop("__part", "__r", "__offset", "__g", "__p")


class WordHashes:
    """64-bit hashes of words (bytes), remembered for the words seen; the memory is bounded by `most` words."""

    def __init__(self, most: int = 200_000):
        import xxhash

        self._digest, self._most, self._known = xxhash.xxh3_64_intdigest, most, {}

    def __call__(self, words: list[bytes]) -> np.ndarray:
        known, digest = self._known, self._digest
        if len(known) > self._most:
            known.clear()
        out = []
        for w in words:
            h = known.get(w)
            if h is None:
                h = known[w] = digest(w)
            out.append(h)
        return np.array(out, dtype=np.uint64)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every input bit (splitmix64's finaliser)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))
