"""Queries of the sources and text functions that the other queries use no part of, over the driver tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftmark.functions import text as tx
from siftmark.functions.vectors import dot, unit
from siftmark.sources import catalog as src

from .base import STOPS, Data, query, sql

# --- sources --------------------------------------------------------------------------------------------------------


def raw_models(x: Data) -> DataFrame:
    """Documents in the shape of the raw catalog: every fifth has no list of labels, every fourth no card but blanks."""
    has = lambda n, c: F.when(F.col("doc_id") % n != 0, c)
    return x.docs.select(
        F.col("doc_id").cast("string").alias("id"),
        F.when(F.col("doc_id") % 5 == 0, F.col("task")).otherwise(F.to_json(F.array("task", F.lit(" "), "lang"))).alias("task_type"),
        F.col("lang").alias("pipeline_tag"),
        has(3, F.col("source")).alias("short_description"),
        F.to_json(F.struct(F.when(F.col("doc_id") % 4 == 0, " \n ").otherwise(F.col("text")).alias("card_text"))).alias("payload_json"),
        F.to_json(F.array("source")).alias("domains"),
        F.lit("[]").alias("specialties"),
        F.lit(None).cast("string").alias("capability_families"),
        has(3, (F.col("doc_id") % 2).cast("int")).alias("open_source"),
        (F.col("doc_id") % 4).cast("int").alias("deployable"),
        has(2, F.col("n_chars")).alias("parameters"),
        F.lit(None).cast("bigint").alias("context_window"),
        has(2, F.col("n_chars")).alias("likes"),
        F.col("n_chars").alias("downloads"),
        F.when(F.col("doc_id") % 2 == 0, "1").when(F.col("doc_id") % 3 == 0, "yes").alias("proprietary"),
    )


_TASKS0 = "CASE WHEN doc_id % 5 <> 0 THEN task END"


@query(sql(f"""SELECT CAST(doc_id AS VARCHAR) AS id, {_TASKS0} AS task0, CASE WHEN doc_id % 5 = 0 THEN 0 ELSE 2 END AS n_tasks, CASE WHEN doc_id % 3 <> 0 THEN source ELSE '' END AS short_description,
  doc_id % 3 <> 0 AND doc_id % 2 <> 0 AS open_source, doc_id % 4 <> 0 AS deployable, CASE WHEN doc_id % 2 <> 0 THEN n_chars ELSE 0 END AS likes, doc_id % 2 = 0 AS proprietary,
  length(CASE WHEN doc_id % 4 <> 0 AND trim(text, ' \t\n\r\f') <> '' THEN text WHEN doc_id % 3 <> 0 THEN source ELSE '' END) AS n_text FROM d""".replace(r"\t\n\r\f", "\t\n\r\f"), "d"))
def typed_catalog_scan(x: Data) -> DataFrame:
    """Raw rows as typed ones: lists parsed, flags as booleans, gaps filled."""
    rows = src.clean_models(raw_models(x))
    return rows.select("id", "task0", F.size("task_types").alias("n_tasks"), "short_description", "open_source", "deployable", "likes", "proprietary", F.length("text").alias("n_text"))


@query(sql("SELECT CAST(doc_id AS VARCHAR) AS id, [source] AS domains, n_chars AS downloads FROM d", "d"))
def column_list_scan(x: Data) -> DataFrame:
    """Some columns of the typed catalog; no other is read from the files."""
    return src.clean_models(raw_models(x)).select("id", "domains", "downloads")


@query(sql(f"SELECT DISTINCT {_TASKS0} AS label FROM d WHERE doc_id % 5 <> 0", "d"))
def distinct_labels(x: Data) -> DataFrame:
    return src.labels(src.clean_models(raw_models(x)))


@query("SELECT n_name AS label, n_name || ' region ' || n_regionkey AS text FROM nation WHERE n_nationkey % 3 <> 0")
def json_descriptions(x: Data) -> DataFrame:
    """A JSON text for each nation, with a name that starts with an underscore and an entry that isn't an object."""
    entry = F.to_json(F.struct(F.col("n_name").alias("label"), F.concat(F.lit("region "), F.col("n_regionkey").cast("string")).alias("description")))
    named = F.concat(F.lit('{"_meta": '), entry, F.lit(', "'), F.col("n_name"), F.lit('": '), F.when(F.col("n_nationkey") % 3 == 0, F.lit('"none"')).otherwise(entry), F.lit("}"))
    return src.described(x.table("nation").select(named.alias("value")))


@query("SELECT * FROM (VALUES ('topic', 'law', 0), ('topic', 'civil', 1), ('topic', 'trade', 2), ('topic', 'sea', 3), ('topic', 'fish', 4)) t(facet, term, ord)")
def vocabulary_harvest(x: Data) -> DataFrame:
    """Names and texts of a configured vocabulary, one container deep, stripped, the first of equals."""
    return src.dictionary(x.spark, {"law": ["civil", " trade "], "sea": {"fish": "law"}, "  ": ("civil",)}, "topic")


@query(sql("SELECT doc_id, CASE WHEN doc_id % 3 <> 0 THEN task END AS task, CASE WHEN doc_id % 3 <> 0 THEN source END AS domain, CASE WHEN doc_id % 3 <> 0 THEN doc_id % 2 = 0 END AS dataset_provided FROM d", "d"))
def holdout_answers(x: Data) -> DataFrame:
    """The JSON object that ends an answer's prose; two of three answers have one, after another in braces."""
    answer = F.to_json(F.struct("task", F.col("source").alias("domain"), (F.col("doc_id") % 2 == 0).alias("dataset_provided")))
    output = F.when(F.col("doc_id") % 3 == 0, "none known").otherwise(F.concat(F.lit("Of {these} I take "), answer, F.lit(" as it is.")))
    rows = src.holdout(x.docs.select("doc_id", F.col("lang").alias("instruction"), output.alias("output")))
    return rows.select("doc_id", "answer.task", "answer.domain", "answer.dataset_provided")


_TYPED = ("translate this letter", "  ", "the voice of the sea")


@query(sql(f"SELECT ord, lemma, CAST(count(doc_id) AS BIGINT) AS df FROM (VALUES (0, 'translate'), (0, 'letter'), (2, 'voice'), (2, 'sea')) t(ord, lemma) LEFT JOIN lem USING (lemma) GROUP BY ALL", "lem"))
def typed_requests(x: Data) -> DataFrame:
    """Requests typed by hand go the way of a batch: their lemmas against the index."""
    asked = tx.C.rows(src.prompt_rows(x.spark, list(_TYPED)), ["ord"], "prompt", distinct=True)
    held = x.lemmas.join(F.broadcast(asked.select("lemma").distinct()), "lemma", "left_semi").groupBy("lemma").agg(F.count(F.lit(1)).alias("df"))
    return asked.join(held, "lemma", "left").select("ord", "lemma", F.coalesce("df", F.lit(0)).alias("df"))


@query("SELECT vec_id, len(embedding) AS dims, round(list_sum(list_transform(embedding, lambda y: pow(y::DOUBLE / (sqrt(list_dot_product(list_transform(embedding, lambda z: z::DOUBLE), list_transform(embedding, lambda z: z::DOUBLE))) + 1e-8::DOUBLE), 2))), 6) AS self_cosine FROM embeddings")
def unit_vectors(x: Data) -> DataFrame:
    """Vectors brought to length one."""
    u = x.vectors.select("vec_id", F.size("vector").alias("dims"), unit(F.col("vector")).alias("u"))
    return u.select("vec_id", "dims", F.round(dot(F.col("u"), F.col("u")), 6).alias("self_cosine"))


# --- analyzers ------------------------------------------------------------------------------------------------------


def _runs_sql(pattern: str, keep: str) -> str:
    return rf"SELECT doc_id, lemma FROM (SELECT doc_id, unnest(regexp_extract_all(lower(text), '{pattern}')) AS lemma FROM documents) WHERE {keep}"


_A, _D = _runs_sql(r"\p{L}+", f"lemma NOT IN ({STOPS})"), _runs_sql(r"[\p{L}\p{N}]+", f"lemma NOT IN ({STOPS})")
_B = _runs_sql(r"\p{L}+", f"length(lemma) BETWEEN 3 AND 6 AND lemma NOT IN ({STOPS})")


def _sizes(x: Data, lemmas: Column) -> DataFrame:
    return x.docs.select("doc_id", F.size(lemmas).alias("n"))


@query(f"SELECT doc_id, CAST(count(lemma) AS BIGINT) AS n FROM documents LEFT JOIN ({_A}) USING (doc_id) GROUP BY doc_id")
def analyzer_bag(x: Data) -> DataFrame:
    return _sizes(x, tx.A.bag(F.col("text")))


@query(f"SELECT lemma, count(*) AS n FROM ({_A}) GROUP BY lemma")
def analyzer_bag_counts(x: Data) -> DataFrame:
    return tx.A.rows(x.docs, [], "text").groupBy("lemma").agg(F.count(F.lit(1)).alias("n"))


@query(f"SELECT doc_id, CAST(count(DISTINCT lemma) AS BIGINT) AS n FROM documents LEFT JOIN ({_B}) USING (doc_id) GROUP BY doc_id")
def analyzer_with_vectors(x: Data) -> DataFrame:
    """Words that have a vector; those of six letters at most stand in for them."""
    return _sizes(x, tx.analyzer_b(lambda w: F.length(w) <= 6).set(F.col("text")))


@query(f"SELECT lemma, count(DISTINCT doc_id) AS df FROM ({_D}) GROUP BY lemma")
def analyzer_numbers(x: Data) -> DataFrame:
    return tx.D.rows(x.docs, ["doc_id"], "text", distinct=True).groupBy("lemma").agg(F.count(F.lit(1)).alias("df"))


# --- caps, choices, task documents ----------------------------------------------------------------------------------


def _digest(x: Data, text: Column) -> DataFrame:
    out = x.docs.select("doc_id", text.alias("t"))
    return out.select("doc_id", F.length("t").alias("n"), F.md5(F.encode("t", "UTF-8")).alias("digest"))


@query(r"SELECT doc_id, length(t) AS n, md5(t) AS digest FROM (SELECT doc_id, array_to_string(string_split(regexp_replace(text, '([.!?])[ \t\n\v\f\r]+', '\1' || chr(1), 'g'), chr(1))[1:30], ' ') AS t FROM documents)")
def sentence_cap(x: Data) -> DataFrame:
    return _digest(x, tx.first_sentences(F.col("text")))


@query("SELECT doc_id, length(t) AS n, md5(t) AS digest FROM (SELECT doc_id, substr(text, 1, 20000) AS t FROM documents)")
def char_cap(x: Data) -> DataFrame:
    return _digest(x, tx.head(F.col("text")))


@query("SELECT doc_id, length(t) AS n, md5(t) AS digest FROM (SELECT doc_id, CASE WHEN doc_id % 4 = 0 OR trim(text, ' \t\n\r\f') = '' THEN source ELSE text END AS t FROM documents)")
def descriptive_text(x: Data) -> DataFrame:
    card = F.when(F.col("doc_id") % 4 == 0, " \n\t").otherwise(F.col("text"))
    return _digest(x, tx.descriptive(card, F.col("source")))


@query("""SELECT doc_id, length(t) AS n, md5(t) AS digest FROM (
  SELECT doc_id, concat_ws(' ', lang, CASE WHEN doc_id % 3 <> 0 THEN source END, CASE WHEN trim(substr(text, 1, 40), ' \t\n\r\f') <> '' THEN substr(text, 1, 40) END) AS t FROM documents)""")
def supervision_chunk(x: Data) -> DataFrame:
    """Non-empty parts of a row as one text; null and blank parts leave no space."""
    source = F.when(F.col("doc_id") % 3 != 0, F.col("source")).when(F.col("doc_id") % 2 == 0, " ")
    return _digest(x, tx.clean_chunk(F.col("lang"), source, F.substring("text", 1, 40)))


def _part_phrases(x: Data) -> DataFrame:
    part = x.table("part")
    phrases = lambda c: part.select(F.col("p_brand").alias("task"), F.col(c).alias("phrase")).distinct()
    return tx.task_phrases(phrases("p_name"), phrases("p_type"), phrases("p_brand"))


_PHRASES = " UNION ALL ".join(f"SELECT DISTINCT p_brand AS task, {c} AS phrase, '{k}' AS kind FROM part" for c, k in (("p_name", "alias"), ("p_type", "hypothesis"), ("p_brand", "signal")))


@query(f"SELECT task, kind, count(*) AS n, CAST(sum(length(phrase)) AS BIGINT) AS chars FROM ({_PHRASES}) GROUP BY ALL")
def task_document_text(x: Data) -> DataFrame:
    """All phrases that describe a task (a brand of parts): aliases, hypotheses and signals."""
    return _part_phrases(x).groupBy("task", "kind").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("phrase")).alias("chars"))


@query(rf"SELECT task, lemma, count(*) AS tf FROM (SELECT DISTINCT task, kind, phrase, lemma FROM (SELECT *, unnest(regexp_extract_all(lower(phrase), '\p{{L}}+')) AS lemma FROM ({_PHRASES})) WHERE lemma NOT IN ({STOPS})) GROUP BY ALL")
def phrase_lemmas(x: Data) -> DataFrame:
    """In how many phrases of a task a lemma stands."""
    return tx.A.rows(_part_phrases(x), ["task"], "phrase", distinct=True).groupBy("task", "lemma").agg(F.count(F.lit(1)).alias("tf"))


@query(sql(rf"""SELECT task, lemma, count(*) AS n FROM (SELECT task, unnest(regexp_extract_all(lower(t), '\p{{L}}+')) AS lemma FROM (
  SELECT task, source || ' ' || substr(text, 1, 200) AS t FROM c UNION ALL SELECT task, 'all of ' || bucket FROM tasks)) WHERE length(lemma) >= 3 AND lemma NOT IN ({STOPS}) GROUP BY ALL""", "c tasks"))
def task_documents(x: Data) -> DataFrame:
    """Lemma counts of each task's document: its rows' chunks (here the source and the text's beginning) and its description."""
    rows = x.catalog.select("task", "source", F.substring("text", 1, 200).alias("summary"))
    more = x.tasks.select("task", F.concat(F.lit("all of "), "bucket").alias("text"))
    docs = tx.task_documents(rows, "task", ["source", "summary"], more)
    return tx.counts(docs, "task", "text")
