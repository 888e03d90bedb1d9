"""The driver tables in the roles of catalog, requests and vectors; the registry of queries; the SQL that queries share."""

from __future__ import annotations

from collections.abc import Callable
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftmark.functions.text import STOP_WORDS, A, C
from siftmark.operators import ranking as rk

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(oracle: str | None = None) -> Callable:
    """Register a function of Data under its name; integers come out as long and floats as double."""

    def put(f: Callable[[Data], DataFrame]) -> Callable:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            out = f(Data(spark, sf_dir))
            wide = {"int": "long", "smallint": "long", "float": "double"}
            return out.withColumns({c: F.col(c).cast(wide[t]) for c, t in out.dtypes if t in wide})

        QUERIES[f.__name__] = run
        if oracle:
            ORACLES[f.__name__] = oracle
        return f

    return put


class Data:
    """Catalog rows are documents with doc_id % 7 <> 0, requests those with doc_id % 7 = 0 (7 shares no factor with the 20
    sources); a row's task is its language and source, its bucket the language."""

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self.spark, self.sf_dir = spark, sf_dir

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    @cached_property
    def docs(self) -> DataFrame:
        return self.table("documents").withColumns({"bucket": F.col("lang"), "task": F.concat_ws("-", "lang", "source")})

    @cached_property
    def catalog(self) -> DataFrame:
        return self.docs.where("doc_id % 7 <> 0")

    @cached_property
    def prompts(self) -> DataFrame:
        return self.docs.where("doc_id % 7 = 0")

    @cached_property
    def tasks(self) -> DataFrame:
        return self.catalog.select("task", "bucket").distinct()

    @cached_property
    def buckets(self) -> DataFrame:
        return self.catalog.select("bucket").distinct()

    @cached_property
    def lemmas(self) -> DataFrame:
        """doc_id, lemma: each lemma of each document once."""
        return C.rows(self.docs, ["doc_id"], "text", distinct=True)

    @cached_property
    def prompt_lemmas(self) -> DataFrame:
        return C.rows(self.prompts, ["doc_id"], "text", distinct=True)

    @cached_property
    def prompt_words(self) -> DataFrame:
        """doc_id, lemma: a row each time a request has a lemma, short ones too: what the gate and the flat ranker ask with."""
        return A.rows(self.prompts, ["doc_id"], "text")

    @cached_property
    def catalog_lemmas(self) -> DataFrame:
        return C.rows(self.catalog, ["doc_id", "task", "bucket"], "text", distinct=True)

    @cached_property
    def item_lemmas(self) -> DataFrame:
        return C.rows(self.table("benchmark"), ["item_id"], "text", distinct=True)

    @cached_property
    def task_stats(self) -> DataFrame:
        return rk.label_statistics(self.catalog_lemmas, "task", self.tasks)

    @cached_property
    def catalog_words(self) -> DataFrame:
        return A.rows(self.catalog, ["doc_id", "task", "bucket"], "text", distinct=True)

    @cached_property
    def word_stats(self) -> DataFrame:
        return rk.label_statistics(self.catalog_words, "task", self.tasks)

    @cached_property
    def bucket_stats(self) -> DataFrame:
        return rk.label_statistics(self.catalog_words, "bucket", self.buckets)

    @cached_property
    def flat(self) -> DataFrame:
        return rk.dense(rk.label_scores(self.prompt_words, self.word_stats, "doc_id", "task"), self.prompts, self.tasks, "doc_id", "task")

    @cached_property
    def gate(self) -> DataFrame:
        return rk.dense(rk.label_scores(self.prompt_words, self.bucket_stats, "doc_id", "bucket"), self.prompts, self.buckets, "doc_id", "bucket")

    @cached_property
    def lexical(self) -> DataFrame:
        return rk.dense(rk.label_scores(self.prompt_lemmas, self.task_stats, "doc_id", "task", F.col("idf")), self.prompts, self.tasks, "doc_id", "task")

    @cached_property
    def bonus(self) -> DataFrame:
        return rk.inherited(self.gate, self.tasks, "doc_id")

    @cached_property
    def signals(self) -> DataFrame:
        return rk.signals(flat_tfidf=self.flat, lexical_idf=self.lexical, bucket_bonus=self.bonus)

    @cached_property
    def gold(self) -> DataFrame:
        return self.prompts.select("doc_id", F.col("task").alias("gold"), F.col("bucket").alias("gold_bucket"))

    @cached_property
    def predicted(self) -> DataFrame:
        """doc_id, task, bucket, gold, gold_bucket: the flat ranker's first label beside the gold one."""
        return rk.best(self.flat, "doc_id", "task").join(self.tasks, "task").join(self.gold, "doc_id")

    @cached_property
    def vectors(self) -> DataFrame:
        return self.table("embeddings").select("vec_id", F.col("embedding").alias("vector"), "label")

    @cached_property
    def vector_queries(self) -> DataFrame:
        """The stated query set: every row whose id is divisible by 50.  It is asked of all rows."""
        return self.vectors.where("vec_id % 50 = 0").select(F.col("vec_id").alias("q"), "vector", F.col("label").alias("q_label"))


STOPS = ", ".join(f"'{w}'" for w in STOP_WORDS)
BENIGN = ("en", "fr")


def _lemma_sql(key: str, source: str, least: int = 3) -> str:
    return rf"SELECT {key}, lemma, count(*) AS n FROM (SELECT {key}, unnest(regexp_extract_all(lower(text), '\p{{L}}+')) AS lemma FROM {source}) WHERE length(lemma) >= {least} AND lemma NOT IN ({STOPS}) GROUP BY ALL"


def _stats_sql(label: str, dimension: str, lemmas: str) -> str:
    return f"SELECT lemma, {label}, count(*) AS tf, CAST(round(ln((SELECT count(*) FROM {dimension}) / count(*) OVER (PARTITION BY lemma)) * 1e6) AS BIGINT) AS idf FROM {lemmas} GROUP BY lemma, {label}"


def _dense_sql(label: str, dimension: str, lemmas: str, stats: str, weight: str) -> str:
    return f"""SELECT p.doc_id, t.{label}, coalesce(s.score, 0) AS score FROM p CROSS JOIN (SELECT DISTINCT {label} FROM {dimension}) t
  LEFT JOIN (SELECT doc_id, {label}, CAST(sum({weight}) AS BIGINT) AS score FROM {lemmas} JOIN {stats} USING (lemma) WHERE idf > 0 GROUP BY ALL) s ON s.doc_id = p.doc_id AND s.{label} = t.{label}"""


def _best_sql(table: str, label: str) -> str:
    return f"SELECT doc_id, {label}, score FROM {table} QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, {label}) = 1"


#: Named parts of the SQL: what they need, and their text.
PARTS: dict[str, tuple[str, str]] = {
    "d": ("", "SELECT *, lang AS bucket, lang || '-' || source AS task FROM documents"),
    "c": ("d", "SELECT * FROM d WHERE doc_id % 7 <> 0"),
    "p": ("d", "SELECT * FROM d WHERE doc_id % 7 = 0"),
    "tasks": ("c", "SELECT DISTINCT task, bucket FROM c"),
    "buckets": ("c", "SELECT DISTINCT bucket FROM c"),
    "lem": ("", _lemma_sql("doc_id", "documents")),
    "bl": ("", _lemma_sql("item_id", "benchmark")),
    "cl": ("c lem", "SELECT lem.*, task, bucket FROM lem JOIN c USING (doc_id)"),
    "pl": ("p lem", "SELECT lem.* FROM lem JOIN p USING (doc_id)"),
    "words": ("", _lemma_sql("doc_id", "documents", 1)),
    "cw": ("c words", "SELECT words.*, task, bucket FROM words JOIN c USING (doc_id)"),
    "pw": ("p words", "SELECT words.* FROM words JOIN p USING (doc_id)"),
    "idf": ("lem", "SELECT lemma, count(*) AS df, CAST(round(ln((SELECT count(DISTINCT doc_id) FROM lem) / count(*)) * 1e6) AS BIGINT) AS idf FROM lem GROUP BY lemma"),
    "tst": ("cl tasks", _stats_sql("task", "tasks", "cl")),
    "wst": ("cw tasks", _stats_sql("task", "tasks", "cw")),
    "bst": ("cw buckets", _stats_sql("bucket", "buckets", "cw")),
    "flat": ("p pw wst tasks", _dense_sql("task", "tasks", "pw", "wst", "n * tf * idf")),
    "lexical": ("p pl tst tasks", _dense_sql("task", "tasks", "pl", "tst", "idf")),
    "gate": ("p pw bst buckets", _dense_sql("bucket", "buckets", "pw", "bst", "n * tf * idf")),
    "bonus": ("gate tasks", "SELECT doc_id, task, score FROM gate JOIN tasks USING (bucket)"),
    "gold": ("p", "SELECT doc_id, task AS gold, bucket AS gold_bucket FROM p"),
    "best_flat": ("flat", _best_sql("flat", "task")),
    "best_gate": ("gate", _best_sql("gate", "bucket")),
    "predicted": ("best_flat tasks gold", "SELECT doc_id, task, bucket, gold, gold_bucket FROM best_flat JOIN tasks USING (task) JOIN gold USING (doc_id)"),
    "signals": ("flat lexical bonus", "SELECT doc_id, task, score, 'flat_tfidf' AS signal FROM flat UNION ALL SELECT doc_id, task, score, 'lexical_idf' FROM lexical UNION ALL SELECT doc_id, task, score, 'bucket_bonus' FROM bonus"),
    "normed": ("signals", "SELECT *, CASE WHEN max(score) OVER w > 0 THEN score / max(score) OVER w ELSE 0 END AS norm FROM signals WINDOW w AS (PARTITION BY doc_id, signal)"),
    "fused": ("normed", "SELECT doc_id, task, round(sum(norm * CASE signal WHEN 'bucket_bonus' THEN 0.5::DOUBLE ELSE 1.0::DOUBLE END), 6) AS score FROM normed GROUP BY ALL"),
    "e": ("", "SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS v, label FROM embeddings"),
    "sims": ("e", "SELECT a.vec_id AS q, a.label AS q_label, b.vec_id, b.label, CAST(round(list_cosine_similarity(a.v, b.v) * 1e6) AS BIGINT) AS sim FROM e a, e b WHERE a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id"),
    "near": ("sims", "SELECT *, row_number() OVER (PARTITION BY q ORDER BY sim DESC, vec_id) AS rank FROM sims"),
}


def sql(select: str, needs: str = "") -> str:
    """select with the parts that it needs, and what those need, as common table expressions."""
    order: list[str] = []

    def visit(name: str) -> None:
        for n in PARTS[name][0].split():
            visit(n)
        if name not in order:
            order.append(name)

    for n in needs.split():
        visit(n)
    ctes = ",\n".join(f"{n} AS ({PARTS[n][1]})" for n in order)
    return f"WITH {ctes}\n{select}" if ctes else select
