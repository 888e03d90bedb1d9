"""Text analysis as column expressions: analyzers, caps, key phrases.

The default analyzer is pure SQL: lower-cased letter runs.  A lemma is then a surface form; an analyzer that knows
lemmas and parts of speech can be put in its place where one is installed (see `Analyzer`)."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Function words that no analyzer keeps.
STOP_WORDS = (
    "the of and to in a is that it for on was be with as by this are or at from not but have has an "
    "der die und zu den das ist von auf des ein eine nicht mit dem sich im "
    "de la le les et un une du en que il est pour dans aux "
    "el los las se por con para una es y del al"
).split()
#: White space that is stripped, as most languages define it; Spark's trim strips spaces alone.
BLANKS = " \t\n\r\f"


class Analyzer(NamedTuple):
    """Lemmas are the matches of a pattern in the lower-cased text that pass a test."""

    pattern: str
    keep: Callable[[Column], Column]

    def runs(self, text: Column) -> Column:
        return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(self.pattern), F.lit(0))

    def bag(self, text: Column) -> Column:
        """All lemmas as an array, duplicates kept."""
        return F.filter(self.runs(text), self.keep)

    def set(self, text: Column) -> Column:
        """Distinct lemmas as an array, in the order of their first occurrence."""
        return F.filter(F.array_distinct(self.runs(text)), self.keep)

    def rows(self, df: DataFrame, keys: list[str], text: str, distinct: bool = False) -> DataFrame:
        """keys and lemma, a row for each lemma of a text (each once if distinct).  No exchange: duplicates go inside the row,
        and the test runs on rows, in generated code."""
        runs = self.runs(F.col(text))
        return df.select(*keys, F.explode(F.array_distinct(runs) if distinct else runs).alias("lemma")).where(self.keep(F.col("lemma")))


LETTERS, LETTERS_OR_DIGITS = r"\p{L}+", r"[\p{L}\p{N}]+"

#: Without stop words (A; A' is the same per phrase, as a set).
A = Analyzer(LETTERS, lambda x: ~x.isin(STOP_WORDS))
#: Of three letters or more, without stop words (C; E, whose rule is unknown, is taken to be the same).
C = Analyzer(LETTERS, lambda x: (F.length(x) >= 3) & ~x.isin(STOP_WORDS))
#: With numbers, without stop words (D).
D = Analyzer(LETTERS_OR_DIGITS, lambda x: ~x.isin(STOP_WORDS))


def analyzer_b(has_vector: Callable[[Column], Column]) -> Analyzer:
    """C for words that have a vector (B)."""
    return Analyzer(LETTERS, lambda x: C.keep(x) & has_vector(x))


def whitespace_set(text: Column) -> Column:
    """Distinct lower-cased tokens between white space."""
    return F.array_distinct(F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), r"\s+"), ""))


def strip(text: Column) -> Column:
    return F.btrim(text, F.lit(BLANKS))


def first_sentences(text: Column, most: int = 30) -> Column:
    """The text up to the end of its `most`-th sentence; a text without a sentence end stays whole."""
    return F.array_join(F.slice(F.split(text, r"(?<=[.!?])\s+"), 1, most), " ")


def head(text: Column, chars: int = 20_000) -> Column:
    return F.substring(text, 1, chars)


def descriptive(card: Column, short: Column) -> Column:
    """The card text unless it is blank, else the short description; the value isn't trimmed."""
    return F.when(strip(card) != "", card).otherwise(short)


def repaired(summary: Column, card: Column) -> Column:
    """The card text where the summary only echoes "<name> is a <task> model"."""
    return F.when(F.lower(summary).like("%is a %model%") & card.isNotNull(), card).otherwise(summary)


def clean_chunk(*parts: Column) -> Column:
    """Non-empty parts joined by a space."""
    return F.concat_ws(" ", *(F.when(strip(p) != "", p) for p in parts))


def counts(df: DataFrame, key: str, text: str, analyzer: Analyzer = C) -> DataFrame:
    """key, lemma, n: how often a text holds a lemma."""
    return analyzer.rows(df, [key], text).groupBy(key, "lemma").agg(F.count(F.lit(1)).alias("n"))


def key_phrases(df: DataFrame, key: str, text: str, most: int = 40) -> DataFrame:
    """key, phrase, ord: the first `most` distinct content runs of a text, in order and in their own case.

    A run is a longest series of alphabetic tokens that aren't stop words; any other token ends it.  (Content words stand
    in for nouns and adjectives, which the SQL analyzer can't tell.)  Duplicates by lower case: the first stands."""
    token = df.select(F.col(key), F.posexplode(F.regexp_extract_all(F.col(text), F.lit(r"\p{L}+|[^\p{L}\s]"), F.lit(0))).alias("pos", "token"))
    content = F.col("token").rlike(r"^\p{L}+$") & ~F.lower("token").isin(STOP_WORDS)
    by_pos = Window.partitionBy(key).orderBy("pos")
    marked = token.withColumn("content", content).withColumn("island", F.sum(F.when(F.col("content"), 0).otherwise(1)).over(by_pos))
    runs = marked.where("content").groupBy(key, "island").agg(F.min("pos").alias("pos"), F.array_sort(F.collect_list(F.struct("pos", "token"))).alias("run"))
    phrases = runs.select(key, "pos", F.array_join(F.transform("run", lambda x: x["token"]), " ").alias("phrase"))
    first = phrases.groupBy(key, F.lower("phrase").alias("folded")).agg(F.min(F.struct("pos", "phrase")).alias("first"))
    ranked = first.select(key, "first.pos", "first.phrase", F.row_number().over(Window.partitionBy(key).orderBy("first.pos")).alias("ord"))
    return ranked.where(F.col("ord") <= most).select(key, "phrase", "ord")


def ngrams(df: DataFrame, keys: list[str], text: str, size: int) -> DataFrame:
    """keys, gram: distinct runs of `size` lower-cased letter tokens of each row."""
    cut = df.select(*keys, A.runs(F.col(text)).alias("w"))
    # slices side by side: no lambda looks the array up
    parts = [F.slice("w", F.lit(k + 1), F.greatest(F.size("w") - size + 1, F.lit(0))) for k in range(size)]
    return cut.select(*keys, F.explode(F.array_distinct(F.transform(F.arrays_zip(*(p.alias(f"g{k}") for k, p in enumerate(parts))), lambda x: F.concat_ws(" ", *(x[f"g{k}"] for k in range(size))))) ).alias("gram"))


def task_phrases(aliases: DataFrame, hypotheses: DataFrame, signals: DataFrame) -> DataFrame:
    """task, phrase, kind: all phrases that describe a task, from three tables (task, phrase); each phrase is counted on its own."""
    kinds = (("alias", aliases), ("hypothesis", hypotheses), ("signal", signals))
    return reduce(DataFrame.unionByName, (t.select("task", "phrase", F.lit(k).alias("kind")) for k, t in kinds))


def task_documents(rows: DataFrame, task: str, parts: list[str], descriptions: DataFrame | None = None) -> DataFrame:
    """task, text in long form: the clean chunk of every row of a task, and the task's own description.  The text of a task
    stays spread over rows: whoever counts its lemmas needs no row that holds them all."""
    out = rows.select(F.col(task).alias("task"), clean_chunk(*(F.col(c) for c in parts)).alias("text"))
    return out if descriptions is None else out.unionByName(descriptions.select("task", "text"))
