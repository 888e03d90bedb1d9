"""Quality rules: a threshold table compiled into one projection of built-in functions."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SPACE_RUN, column, documents, unpacked_row, whole_row, words_of


class Rule(NamedTuple):
    """Holds when 100 * value <relation> percent * base.  Integers only: no verdict hangs on a rounding."""

    name: str
    value: str
    relation: str
    percent: int
    base: str


#: Frequent function words of the four languages of the corpus.
STOP_WORDS = (
    "the of and to in a is that it for on was be with as by this are or at from "
    "der die und zu den das ist von auf des ein eine nicht mit dem sich "
    "de la le les et un une du en que il est pour dans "
    "el los las se por con para una es y"
).split()
SYMBOLS = "#*$%&|<>"

#: The production table.  A document passes if every rule holds.
RULES = (
    Rule("too_few_words", "n_words", ">=", 5000, "one"),
    Rule("too_many_words", "n_words", "<=", 100_000_000, "one"),
    Rule("short_words", "word_chars", ">=", 250, "n_words"),
    Rule("long_words", "word_chars", "<=", 1200, "n_words"),
    Rule("symbols", "n_symbols", "<=", 10, "n_words"),
    Rule("few_stop_words", "n_stop_words", ">=", 200, "one"),
    Rule("repeated_lines", "n_dup_lines", "<=", 45, "n_lines"),
    Rule("bullet_lines", "n_bullet_lines", "<=", 90, "n_lines"),
    Rule("ellipsis_lines", "n_ellipsis_lines", "<=", 30, "n_lines"),
)


def _stop_forms() -> list[str]:
    return sorted({f for w in STOP_WORDS for f in (w, w.capitalize())})


def _repeat_words(words: Column, hashes: Column) -> Column:
    """Positions covered by a 3-word window that occurs at least twice, from windows sorted by hash: one n log n sort."""
    n = F.size(hashes)
    later, earlier = F.slice(hashes, F.lit(2), n), F.concat(F.array(F.struct(F.lit(None).cast("long").alias("h"), F.lit(-1).alias("i"))), hashes)
    pairs = F.arrays_zip(hashes.alias("x"), earlier.alias("e"), later.alias("l"))
    marked = F.filter(pairs, lambda p: (p["x"]["h"] == p["e"]["h"]) | (p["x"]["h"] == p["l"]["h"]))
    return F.sort_array(F.transform(marked, lambda p: p["x"]["i"]))


def measures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", carry: bool = False) -> DataFrame:
    """One row per document with every count the table may name; with carry, the whole row goes along as struct __row.

    A null text is an empty one: all counts are 0.  Repeated rows give repeated results; other columns of docs are
    ignored, whatever their names.  Three narrow projections, no exchange: each array is made once and dropped.
    """
    text = F.coalesce(column(text_col), F.lit(""))
    row = ["__row"] if carry else []
    base = docs.select(column(id_col).alias("doc_id"), text.alias("t"), *(whole_row(docs).alias(c) for c in row))
    cut = base.select("doc_id", "t", *row, words_of(F.col("t")).alias("w"), F.filter(F.split("t", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")).alias("lines"))
    n = F.size("w")
    # xxhash64 chains its arguments, so ("a","bc") and ("ab","c") differ.
    windows = F.transform(
        F.slice(F.col("w"), F.lit(1), F.greatest(n - 2, F.lit(0))),
        lambda x, i: F.struct(F.xxhash64(x, F.get(F.col("w"), i + 1), F.get(F.col("w"), i + 2)).alias("h"), i.alias("i")),
    )
    counted = cut.select(
        "doc_id",
        n.cast("long").alias("n_words"),
        F.length(F.regexp_replace("t", SPACE_RUN, "")).cast("long").alias("word_chars"),
        (F.length("t") - F.length(F.translate("t", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.size("lines").cast("long").alias("n_lines"),
        F.size(F.array_intersect("w", F.lit(_stop_forms()))).cast("long").alias("n_stop_words"),
        F.size(F.filter("lines", lambda x: x.rlike(r"^[\x20\x09]*[-*•]"))).cast("long").alias("n_bullet_lines"),
        F.size(F.filter("lines", lambda x: x.rlike(r"(\.\.\.|…)[\x20\x09\r]*$"))).cast("long").alias("n_ellipsis_lines"),
        F.sort_array(windows).alias("s"),
        *row,
    )
    placed = counted.withColumn("s", _repeat_words(F.col("s"), F.col("s")))
    gaps = F.zip_with(F.col("s"), F.slice(F.col("s"), F.lit(2), F.greatest(F.size("s"), F.lit(1))), lambda a, b: F.least(F.lit(3), F.coalesce(b - a, F.lit(3))))
    done = placed.withColumn("n_repeat_words", F.aggregate(gaps, F.lit(0).cast("long"), lambda acc, x: acc + x)).drop("s")
    # A filter on a verdict must not be pushed below the arrays, where each lambda would make them anew for every word:
    # a projection that isn't deterministic to the optimizer stops it.
    return done.withColumn("n_words", F.when(F.spark_partition_id() >= 0, F.col("n_words")))


def compile_rules(rules: tuple[Rule, ...]) -> Column:
    """The names of the rules that fail, comma-joined in table order; empty if all hold."""
    value = lambda c: F.lit(1).cast("long") if c == "one" else F.col(c)
    failed = []
    for r in rules:
        left, right = F.lit(100) * value(r.value), F.lit(r.percent).cast("long") * value(r.base)
        failed.append(F.when(~(left >= right if r.relation == ">=" else left <= right), F.lit(r.name)))
    return F.concat_ws(",", *failed)


def quality_rules(docs: DataFrame, rules: tuple[Rule, ...] = RULES, id_col: str = "doc_id", text_col: str = "text", carry: bool = False) -> DataFrame:
    """doc_id, the counts, base_failed, failed_rules and kept.

    base_failed: fewer than 50 words, or over half of the words stand in repeated 3-word windows.  kept: not
    base_failed and no rule of the table fails.  Null or empty text: 0 words, base_failed.  Empty table: no rows.
    """
    m = measures(docs, id_col, text_col, carry)
    bad = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return m.withColumns({"base_failed": bad, "failed_rules": compile_rules(rules)}).withColumn("kept", ~F.col("base_failed") & (F.col("failed_rules") == ""))


def passing(docs: DataFrame, rules: tuple[Rule, ...] = RULES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs that the table keeps, with the columns of docs whatever their names; no join and no exchange.  Null
    and empty texts are rejected; repeated rows stay as often as they stand."""
    return quality_rules(docs, rules, id_col, text_col, carry=True).where("kept").select(*unpacked_row("__row", docs.columns))


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and verdict of every document under the production table; a null text counts as empty and is rejected."""
    return quality_rules(documents(spark, sf_dir))


def _oracle() -> str:
    words = r"list_filter(regexp_split_to_array(t, '[\x20\x09-\x0D]+'), lambda x: x <> '')"
    lines = r"list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]'))"
    value = lambda c: "1" if c == "one" else c
    failed = ", ".join(f"CASE WHEN NOT (100 * {value(r.value)} {r.relation} {r.percent} * {value(r.base)}) THEN '{r.name}' END" for r in RULES)
    stops = ", ".join(f"'{w}'" for w in _stop_forms())
    return rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
a AS (SELECT doc_id, t, {words} AS w, {lines} AS ls FROM d),
win AS (SELECT doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM a)),
twice AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS n FROM win) WHERE n > 1),
rep AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM twice, (SELECT unnest([0, 1, 2]) AS k) GROUP BY doc_id),
m AS (SELECT a.doc_id, len(w) AS n_words, length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g')) AS word_chars,
  length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols, len(ls) - len(list_distinct(ls)) AS n_dup_lines,
  len(ls) AS n_lines, len(list_distinct(list_filter(w, lambda x: list_contains([{stops}], x)))) AS n_stop_words,
  len(list_filter(ls, lambda x: regexp_matches(x, '^[\x20\x09]*[-*•]'))) AS n_bullet_lines,
  len(list_filter(ls, lambda x: regexp_matches(x, '(\.\.\.|…)[\x20\x09\r]*$'))) AS n_ellipsis_lines,
  coalesce(rep.n, 0) AS n_repeat_words FROM a LEFT JOIN rep USING (doc_id)),
v AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed, concat_ws(',', {failed}) AS failed_rules FROM m)
SELECT *, NOT base_failed AND failed_rules = '' AS kept FROM v"""


QUERIES = {"op9_quality_rules": op9_quality_rules}
ORACLES = {"op9_quality_rules": _oracle()}
