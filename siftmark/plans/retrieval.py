"""Retrieval, label ranking, fusion and vector queries over the driver tables."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftmark.functions.labels import family
from siftmark.functions.text import C, counts, key_phrases, repaired, strip, whitespace_set
from siftmark.functions.vectors import cosine as cosine_of
from siftmark.operators import constraints as cs
from siftmark.operators import ranking as rk
from siftmark.operators import vector as vc

from .base import PARTS, Data, query, sql

# --- index and sparse retrieval -------------------------------------------------------------------------------------

PARTS["sparse"] = ("bl idf lem", "SELECT item_id, doc_id, CAST(sum(idf) AS BIGINT) AS s FROM bl JOIN idf USING (lemma) JOIN lem USING (lemma) WHERE idf > 0 GROUP BY ALL")
PARTS["sparse_ranked"] = ("sparse", "SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY s DESC, doc_id) AS rank FROM sparse")


def sparse(x: Data, k: int | None) -> DataFrame:
    found = rk.sparse_scores(x.item_lemmas, x.lemmas, rk.document_frequency(x.lemmas, "doc_id"), "item_id", "doc_id")
    return rk.top_k(found, "item_id", "score", k, "doc_id")


@query(sql("SELECT item_id, doc_id, round(s / 1e6, 6) AS score, rank FROM sparse_ranked WHERE rank <= 10", "sparse_ranked"))
def sparse_retrieve(x: Data) -> DataFrame:
    return sparse(x, 10).withColumn("score", rk.from_micro(F.col("score")))


@query(sql("SELECT lemma, df, round(idf / 1e6, 6) AS idf FROM idf", "idf"))
def doc_frequency_idf(x: Data) -> DataFrame:
    return rk.document_frequency(x.lemmas, "doc_id").withColumn("idf", rk.from_micro(F.col("idf")))


@query(r"SELECT token, count(*) AS df FROM (SELECT DISTINCT doc_id, unnest(regexp_split_to_array(lower(text), '\s+')) AS token FROM documents) WHERE token <> '' GROUP BY token")
def token_document_frequency(x: Data) -> DataFrame:
    return x.docs.select(F.explode(whitespace_set(F.col("text"))).alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("df"))


@query(sql("SELECT lemma, bucket, tf, round(idf / 1e6, 6) AS idf FROM bst", "bst"))
def lemma_bucket_stats(x: Data) -> DataFrame:
    return x.bucket_stats.withColumn("idf", rk.from_micro(F.col("idf")))


# --- label rankers --------------------------------------------------------------------------------------------------


@query(sql("SELECT doc_id, bucket, round(score / 1e6, 6) AS score, gold_bucket FROM best_gate JOIN gold USING (doc_id)", "best_gate gold"))
def bucket_gate(x: Data) -> DataFrame:
    return rk.best(x.gate, "doc_id", "bucket").join(x.gold, "doc_id").select("doc_id", "bucket", rk.from_micro(F.col("score")).alias("score"), "gold_bucket")


@query(sql("SELECT doc_id, task, round(score / 1e6, 6) AS score, rank FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, task) AS rank FROM flat) WHERE rank <= 5", "flat"))
def flat_task_rank(x: Data) -> DataFrame:
    return rk.top_k(x.flat, "doc_id", "score", 5, "task").withColumn("score", rk.from_micro(F.col("score")))


def _within(x: Data, chosen: DataFrame) -> DataFrame:
    """The best task of each request inside the bucket chosen for it."""
    return rk.best(x.flat.join(x.tasks, "task").join(chosen, ["doc_id", "bucket"], "left_semi"), "doc_id", "task").select("doc_id", "task")


@query(sql("SELECT f.doc_id, f.task FROM flat f JOIN tasks USING (task) JOIN best_gate g ON g.doc_id = f.doc_id AND g.bucket = tasks.bucket QUALIFY row_number() OVER (PARTITION BY f.doc_id ORDER BY f.score DESC, f.task) = 1", "flat tasks best_gate"))
def hierarchical_rank(x: Data) -> DataFrame:
    return _within(x, rk.best(x.gate, "doc_id", "bucket"))


@query(sql("SELECT f.doc_id, f.task, f.task = gold AS hit FROM flat f JOIN tasks USING (task) JOIN gold g ON g.doc_id = f.doc_id AND g.gold_bucket = tasks.bucket QUALIFY row_number() OVER (PARTITION BY f.doc_id ORDER BY f.score DESC, f.task) = 1", "flat tasks gold"))
def oracle_gate(x: Data) -> DataFrame:
    return _within(x, x.gold.select("doc_id", F.col("gold_bucket").alias("bucket"))).join(x.gold, "doc_id").select("doc_id", "task", (F.col("task") == F.col("gold")).alias("hit"))


PARTS["soft"] = ("flat gate tasks", """SELECT doc_id, task, round(t + b, 6) AS score FROM (SELECT doc_id, task, bucket, CASE WHEN max(score) OVER w > 0 THEN score / max(score) OVER w ELSE 0 END AS t FROM flat JOIN tasks USING (task) WINDOW w AS (PARTITION BY doc_id))
  JOIN (SELECT doc_id, bucket, CASE WHEN max(score) OVER w > 0 THEN score / max(score) OVER w ELSE 0 END AS b FROM gate WINDOW w AS (PARTITION BY doc_id)) USING (doc_id, bucket)""")


def soft(x: Data) -> DataFrame:
    return rk.with_bucket_bonus(x.flat, x.gate, x.tasks, "doc_id")


@query(sql("SELECT doc_id, task, score FROM soft QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, task) = 1", "soft"))
def soft_bonus_rank(x: Data) -> DataFrame:
    return rk.best(soft(x), "doc_id", "task")


@query(sql("SELECT doc_id, CAST(count_if(abs(s - t) >= 1e-6) AS BIGINT) AS changed, max(s) AS best FROM (SELECT doc_id, soft.score AS s, CASE WHEN max(flat.score) OVER w > 0 THEN round(flat.score / max(flat.score) OVER w, 6) ELSE 0 END AS t FROM soft JOIN flat USING (doc_id, task) WINDOW w AS (PARTITION BY doc_id)) GROUP BY doc_id", "soft flat"))
def bucket_bonus_effect(x: Data) -> DataFrame:
    flat = rk.normalised(x.flat, ["doc_id"], out="t").select("doc_id", "task", F.round("t", 6).alias("t"))
    return soft(x).join(flat, ["doc_id", "task"]).groupBy("doc_id").agg(F.count_if(F.abs(F.col("score") - F.col("t")) >= 1e-6).alias("changed"), F.max("score").alias("best"))


@query(sql("""SELECT doc_id, task, score, rank FROM (SELECT doc_id, task, score, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, task) AS rank FROM (
  SELECT doc_id, task, round(sum(1.0::DOUBLE / (60 + r - 1)), 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, signal ORDER BY score DESC, task) AS r FROM signals) WHERE score > 0 GROUP BY ALL)) WHERE rank <= 3""", "signals"))
def rrf_fusion(x: Data) -> DataFrame:
    return rk.top_k(rk.fuse(x.signals, "doc_id", "task", op="rrf"), "doc_id", "score", 3, "task")


BEST = {"bucket_bonus": 0.5}


@query(sql("SELECT doc_id, task, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, task) AS rank FROM fused) WHERE rank <= 3", "fused"))
def score_sum_fusion(x: Data) -> DataFrame:
    """The best ensemble: flat tf-idf 1, lexical idf 1, bucket bonus 0.5."""
    return rk.top_k(rk.fuse(x.signals, "doc_id", "task", BEST), "doc_id", "score", 3, "task")


NAMES = ("bucket_bonus", "flat_tfidf", "lexical_idf")
SETS = [c for n in (1, 2, 3) for c in combinations(NAMES, n)]


@query(sql("SELECT name, count(*) AS n, CAST(count_if(task = gold) AS BIGINT) AS hits FROM (" + " UNION ALL ".join(
    f"SELECT '{'+'.join(s)}' AS name, doc_id, task FROM (SELECT doc_id, task, round(sum(norm), 6) AS score FROM normed WHERE signal IN ({', '.join(map(repr, s))}) GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, task) = 1" for s in SETS
) + ") JOIN gold USING (doc_id) GROUP BY name", "normed gold"))
def pairwise_ablation(x: Data) -> DataFrame:
    """Every set of signals at once: each signal's rows go to the sets that hold it, over one table of signals."""
    sets = F.array(*(F.struct(F.lit("+".join(s)).alias("name"), F.lit(list(s)).alias("members")) for s in SETS))
    normed = rk.normalised(x.signals, ["doc_id", "signal"])
    each = normed.select("doc_id", "task", "norm", F.explode(F.filter(sets, lambda s: F.array_contains(s["members"], F.col("signal")))).alias("s"))
    fused = each.groupBy("s.name", "doc_id", "task").agg(F.round(F.sum("norm"), 6).alias("score"))
    top = fused.groupBy("name", "doc_id").agg(F.min(F.struct((-F.col("score")).alias("s"), "task"))["task"].alias("task"))
    return top.join(x.gold, "doc_id").groupBy("name").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("task") == F.col("gold")).alias("hits"))


@query(sql("""SELECT doc_id, task, score FROM (SELECT doc_id, task, round(coalesce(max(CASE WHEN signal = 'flat_tfidf' THEN norm END), 0) * 2 + coalesce(max(CASE WHEN signal = 'lexical_idf' THEN norm END), 0), 6) AS score FROM normed GROUP BY ALL)
  QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, task) = 1""", "normed"))
def weighted_blend(x: Data) -> DataFrame:
    """Two systems blended 2 : 1."""
    two = x.signals.where("signal <> 'bucket_bonus'")
    return rk.best(rk.fuse(two, "doc_id", "task", {"flat_tfidf": 2.0}), "doc_id", "task")


@query(sql("""SELECT doc_id, task, score FROM (SELECT doc_id, task, round(norm + 0.1::DOUBLE * prior, 6) AS score FROM normed JOIN (SELECT task, count(*) / (SELECT count(*) FROM c) AS prior FROM c GROUP BY task) USING (task) WHERE signal = 'flat_tfidf')
  QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, task) = 1""", "normed c"))
def prior_signal(x: Data) -> DataFrame:
    """The share of a label in the catalog as one more signal, with weight 0.1."""
    total = x.catalog.agg(F.count(F.lit(1)).alias("total"))
    prior = x.catalog.groupBy("task").agg(F.count(F.lit(1)).alias("n")).crossJoin(F.broadcast(total)).select("task", (F.col("n") / F.col("total")).alias("prior"))
    scored = rk.normalised(x.flat, ["doc_id"]).join(prior, "task")
    return rk.best(scored.select("doc_id", "task", F.round(F.col("norm") + F.lit(0.1) * F.col("prior"), 6).alias("score")), "doc_id", "task")


@query(sql("""SELECT doc_id, task FROM (SELECT f.doc_id, f.task, -rank + CASE WHEN s.task IS NULL THEN 0 ELSE 0.25 END AS score FROM (SELECT doc_id, task, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, task) AS rank FROM flat) f
  LEFT JOIN (SELECT DISTINCT doc_id, task FROM pl JOIN (SELECT lemma, task FROM tst WHERE length(lemma) >= 9) USING (lemma)) s ON s.doc_id = f.doc_id AND s.task = f.task) QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, task) = 1""", "flat pl tst"))
def term_boost(x: Data) -> DataFrame:
    """A quarter of a place for labels that share a long term with the request."""
    shared = x.prompt_lemmas.where("length(lemma) >= 9").join(x.task_stats, "lemma").select("doc_id", "task").distinct().withColumn("boost", F.lit(0.25))
    placed = rk.top_k(x.flat, "doc_id", "score", None, "task").join(shared, ["doc_id", "task"], "left")
    return rk.best(placed.select("doc_id", "task", (-F.col("rank") + F.coalesce("boost", F.lit(0.0))).alias("score")), "doc_id", "task").select("doc_id", "task")


PARTS["cosine"] = ("pl tst", """SELECT a.doc_id, b.task, round(sum(x * y) / (any_value(nx) * any_value(ny)), 6) AS score
  FROM (SELECT *, sqrt(sum(x * x) OVER (PARTITION BY doc_id)) AS nx FROM (SELECT doc_id, lemma, n * idf / 1e6 AS x FROM pl JOIN (SELECT DISTINCT lemma, idf FROM tst) USING (lemma) WHERE idf > 0)) a
  JOIN (SELECT *, sqrt(sum(y * y) OVER (PARTITION BY task)) AS ny FROM (SELECT task, lemma, tf * idf / 1e6 AS y FROM tst WHERE idf > 0)) b ON a.lemma = b.lemma GROUP BY ALL""")
PARTS["best_cosine"] = ("cosine", "SELECT doc_id, task, score FROM cosine QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, task) = 1")


def cosine(x: Data) -> DataFrame:
    return rk.cosine_scores(counts(x.prompts, "doc_id", "text"), x.task_stats, "doc_id", "task")


@query(sql("SELECT p.doc_id, b.task, score, b.task IS NULL AS abstained FROM p LEFT JOIN best_cosine b ON p.doc_id = b.doc_id", "p best_cosine"))
def idf_cosine_rank(x: Data) -> DataFrame:
    """The first label by idf cosine; a request without a shared lemma abstains."""
    return x.prompts.select("doc_id").join(rk.best(cosine(x), "doc_id", "task"), "doc_id", "left").withColumn("abstained", F.col("task").isNull())


@query(sql("SELECT doc_id, round(s1 - s2, 6) AS margin, s1 - s2 < 0.01::DOUBLE AS abstains FROM (SELECT doc_id, score AS s1, lead(score) OVER w AS s2, row_number() OVER w AS r FROM cosine WINDOW w AS (PARTITION BY doc_id ORDER BY score DESC, task)) WHERE r = 1", "cosine"))
def margin_abstain(x: Data) -> DataFrame:
    """Distance between the first and the second label; a small one abstains."""
    two = rk.top_k(cosine(x), "doc_id", "score", 2, "task").groupBy("doc_id").agg(F.max("score").alias("s1"), F.max(F.when(F.col("rank") == 2, F.col("score"))).alias("s2"))
    return two.select("doc_id", F.round(F.col("s1") - F.col("s2"), 6).alias("margin"), (F.col("s1") - F.col("s2") < 0.01).alias("abstains"))


@query(sql("""SELECT doc_id, direct.task AS direct, staged.task AS staged, direct.task = staged.task AS same FROM best_cosine direct JOIN (
  SELECT doc_id, task FROM cosine JOIN tasks USING (task) WHERE (doc_id, bucket) IN (SELECT doc_id, bucket FROM gate QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, bucket) <= 2)
  QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, task) = 1) staged USING (doc_id)""", "best_cosine cosine tasks gate"))
def two_stage_vs_direct(x: Data) -> DataFrame:
    """The best label overall against the best one inside the two best buckets."""
    scores = cosine(x)
    inside = scores.join(x.tasks, "task").join(rk.top_k(x.gate, "doc_id", "score", 2, "bucket"), ["doc_id", "bucket"], "left_semi")
    direct = rk.best(scores, "doc_id", "task").select("doc_id", F.col("task").alias("direct"))
    return direct.join(rk.best(inside, "doc_id", "task").select("doc_id", F.col("task").alias("staged")), "doc_id").withColumn("same", F.col("direct") == F.col("staged"))


# --- vectors --------------------------------------------------------------------------------------------------------


@query(sql("SELECT q, vec_id, round(sim / 1e6, 6) AS sim, rank FROM near WHERE rank <= 10", "near"))
def knn_topk(x: Data) -> DataFrame:
    return vc.nearest(x.vector_queries, x.vectors, "q", "vec_id", 10, apart=True).select("q", "vec_id", F.round(F.col("sim") / 1e6, 6).alias("sim"), "rank")


@query(sql("SELECT q, label, round(score / 1e6, 4) AS score FROM (SELECT q, label, CAST(sum(sim) AS BIGINT) AS score FROM near WHERE rank <= 50 GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY q ORDER BY score DESC, label) = 1", "near"))
def knn_vote(x: Data) -> DataFrame:
    votes = vc.vote(vc.nearest(x.vector_queries, x.vectors, "q", "vec_id", 50, apart=True), "q", "label")
    return rk.best(votes, "q", "label").select("q", "label", F.round(F.col("score") / 1e6, 4).alias("score"))


PARTS["cents"] = ("e", "SELECT label, list(m ORDER BY i) AS v FROM (SELECT label, i, avg(x) AS m FROM (SELECT label, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM e) GROUP BY ALL) GROUP BY label")


@query(sql("SELECT q, label, score FROM (SELECT vec_id AS q, cents.label, round(list_cosine_similarity(e.v, cents.v), 4) AS score FROM e, cents WHERE vec_id % 50 = 0) QUALIFY row_number() OVER (PARTITION BY q ORDER BY score DESC, label) = 1", "e cents"))
def centroid_rank(x: Data) -> DataFrame:
    found = vc.similarities(x.vector_queries, vc.centroids(x.vectors, "label"), "q", "label")
    return rk.best(found.select("q", "label", F.round(F.col("sim") / 1e6, 4).alias("score")), "q", "label")


@query(sql("SELECT count(*) AS n, CAST(count_if(q = vec_id) AS BIGINT) AS hits FROM (SELECT a.vec_id AS q, b.vec_id FROM e a, e b WHERE a.vec_id % 50 = 0 QUALIFY row_number() OVER (PARTITION BY a.vec_id ORDER BY round(list_cosine_similarity(a.v, b.v) * 1e6) DESC, b.vec_id) = 1)", "e"))
def self_retrieval(x: Data) -> DataFrame:
    """Does a row find itself first?"""
    return vc.nearest(x.vector_queries, x.vectors, "q", "vec_id", 1).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("q") == F.col("vec_id")).alias("hits"))


@query(sql("""SELECT q, c, round(sum(m) / count(*) / 1e6, 4) AS score FROM (SELECT a.vec_id, a.vec_id // 10 AS q, b.vec_id // 10 AS c, max(CAST(round(list_cosine_similarity(a.v, b.v) * 1e6) AS BIGINT)) AS m
  FROM e a, e b WHERE a.vec_id // 10 % 5 = 0 AND a.vec_id // 10 <> b.vec_id // 10 GROUP BY ALL) GROUP BY q, c""", "e"))
def max_mean_similarity(x: Data) -> DataFrame:
    """Vectors in tens as the phrases of a request or of a row; the tens that hold an id divisible by 50 ask all others."""
    tens = x.vectors.select(F.floor(F.col("vec_id") / 10).alias("c"), "vector")
    return vc.max_mean(tens.where("c % 5 = 0").withColumnRenamed("c", "q"), tens, "q", "c").where("q <> c")


PARTS["db_votes"] = ("e d", """SELECT doc_id, task, CAST(sum(sim) AS BIGINT) AS score FROM (SELECT a.vec_id AS doc_id, d.task, CAST(round(list_cosine_similarity(a.v, b.v) * 1e6) AS BIGINT) AS sim
  FROM e a JOIN e b ON a.vec_id % 7 = 0 AND b.vec_id % 7 <> 0 JOIN d ON d.doc_id = b.vec_id QUALIFY row_number() OVER (PARTITION BY a.vec_id ORDER BY sim DESC, b.vec_id) <= 50) GROUP BY ALL""")
PARTS["db_all"] = ("db_votes lexical bonus", """SELECT l.doc_id, l.task, coalesce(v.score, 0) AS score, 'knn' AS signal FROM lexical l JOIN (SELECT DISTINCT doc_id FROM db_votes) USING (doc_id) LEFT JOIN db_votes v ON v.doc_id = l.doc_id AND v.task = l.task
  UNION ALL SELECT doc_id, task, score, 'lexical' FROM lexical JOIN (SELECT DISTINCT doc_id FROM db_votes) USING (doc_id)
  UNION ALL SELECT doc_id, task, score, 'affinity' FROM bonus JOIN (SELECT DISTINCT doc_id FROM db_votes) USING (doc_id)""")


@query(sql("""SELECT doc_id, task, score FROM (SELECT doc_id, task, round(sum(norm * CASE signal WHEN 'affinity' THEN 0.5::DOUBLE ELSE 1.0::DOUBLE END), 6) AS score
  FROM (SELECT *, CASE WHEN max(score) OVER w > 0 THEN score / max(score) OVER w ELSE 0 END AS norm FROM db_all WINDOW w AS (PARTITION BY doc_id, signal)) GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, task) = 1""", "db_all"))
def db_three_signal_fusion(x: Data) -> DataFrame:
    """Votes of the 50 nearest rows, lexical overlap and half the bucket's affinity, each normalised by its greatest.
    Vectors stand for the documents of the same number; every request that has one is answered."""
    queries = x.vectors.where("vec_id % 7 = 0").select(F.col("vec_id").alias("doc_id"), "vector").join(x.prompts.select("doc_id"), "doc_id", "left_semi")
    corpus = x.vectors.where("vec_id % 7 <> 0").join(x.docs.select(F.col("doc_id").alias("vec_id"), "task"), "vec_id").select("vec_id", "task", "vector")
    votes = vc.vote(vc.nearest(queries, corpus, "doc_id", "vec_id", 50), "doc_id", "task")
    asked = votes.select("doc_id").distinct()
    own = lambda t: t.join(asked, "doc_id", "left_semi")
    table = rk.signals(knn=rk.dense(votes, asked, x.tasks, "doc_id", "task"), lexical=own(x.lexical), affinity=own(x.bonus))
    return rk.best(rk.fuse(table, "doc_id", "task", {"affinity": 0.5}), "doc_id", "task")


# --- constraints and the hybrid retriever ---------------------------------------------------------------------------

WORDS = (("open_source", "hard", ("the and", "that")), ("edge", "hard", ("with", "und der")), ("fast", "soft", ("para", "dans les", "this")))


@query("SELECT DISTINCT doc_id, name, hardness FROM (SELECT doc_id, lower(text) AS t, array_to_string(regexp_extract_all(lower(text), '\\p{L}+'), ' ') AS l FROM documents), (VALUES " + ", ".join(
    f"('{n}', '{h}', '{s}')" for n, h, ss in WORDS for s in ss
) + ") AS w(name, hardness, surface) WHERE contains(' ' || CASE WHEN contains(surface, ' ') THEN t ELSE l END || ' ', ' ' || surface || ' ')")
def constraint_detect(x: Data) -> DataFrame:
    """Constraints named in texts, with surfaces that the corpus has."""
    read = x.docs.select("doc_id", "text", F.array_join(C.runs(F.col("text")), " ").alias("l"))
    return cs.detect(read, cs.lexicon(x.spark, WORDS), "doc_id", "text", "l")


def catalog_rows(x: Data) -> DataFrame:
    """Documents as catalog rows: labels cover some, so attributes are null for the rest."""
    rows = x.docs.join(x.table("labels"), "doc_id", "left")
    return rows.select(
        "doc_id", "task", (F.col("quality") == 1).alias("open_source"), (F.col("toxic") == 0).alias("deployable"), F.col("n_chars").alias("parameters"), (F.col("n_chars") * 8).alias("context_window"),
        F.array(F.when(F.col("lang") == "fr", "multilingual").otherwise(F.col("lang"))).alias("specialties"), F.length("source").cast("long").alias("likes"),
    )


PARTS["rows"] = ("d", "SELECT d.doc_id, task, quality = 1 AS open_source, toxic = 0 AS deployable, n_chars AS parameters, n_chars * 8 AS context_window, CASE lang WHEN 'fr' THEN 'multilingual' ELSE lang END AS specialty, length(source) AS likes FROM d LEFT JOIN labels USING (doc_id)")
_OK = {"open_source": "coalesce(open_source, false)", "edge": "coalesce(deployable AND parameters <= 1000000000, false)", "long_context": "coalesce(context_window >= 32768, false)", "multilingual": "specialty = 'multilingual'", "fast": "coalesce(deployable, false)"}


@query(sql("SELECT doc_id, " + ", ".join(f"{v} AS {k}" for k, v in _OK.items()) + ", true AS unheard_of FROM rows", "rows"))
def constraint_filter(x: Data) -> DataFrame:
    return catalog_rows(x).select("doc_id", *(cs.satisfied(F.lit(n)).alias(n) for n in (*_OK, "unheard_of")))


def picks(x: Data, **options) -> DataFrame:
    """Hybrid retrieval of benchmark items, each under the constraints that it names; an item's vector is the embedding of the
    same number, so is a document's."""
    found = sparse(x, None if options.get("filter_first") else 200).withColumnRenamed("score", "sparse")
    requests = x.table("benchmark")
    vectors = x.vectors.select("vec_id", "vector")
    items = vectors.join(requests.select(F.col("item_id").alias("vec_id")), "vec_id", "left_semi").select(F.col("vec_id").alias("item_id"), F.col("vector").alias("__q"))

    def dense(rows: DataFrame) -> DataFrame:
        both = rows.join(items, "item_id", "left").join(vectors.withColumnRenamed("vec_id", "doc_id"), "doc_id", "left")
        return both.withColumn("dense", F.round(rk.micro(cosine_of(F.col("__q"), F.col("vector"))) / 1e6, 4)).drop("__q", "vector")

    stats = rk.label_statistics(C.rows(x.docs, ["doc_id", "task"], "text", distinct=True), "task", x.docs.select("task").distinct())
    predicted = rk.top_k(rk.label_scores(C.rows(requests, ["item_id"], "text"), stats, "item_id", "task"), "item_id", "score", 2, "task")
    named = cs.detect(requests.select("item_id", "text", F.array_join(C.runs(F.col("text")), " ").alias("l")), cs.lexicon(x.spark, WORDS), "item_id", "text", "l")
    return cs.hybrid_pick(found, catalog_rows(x), dense, cs.asked(requests.select("item_id"), named, "item_id"), predicted, "item_id", "doc_id", **options)


PARTS["dl"] = ("d lem", "SELECT lem.*, task FROM lem JOIN d USING (doc_id)")
PARTS["item_tasks"] = ("bl dl d", """SELECT item_id, task FROM (SELECT item_id, task, sum(n * tf * idf) AS s FROM bl JOIN (SELECT lemma, task, count(*) AS tf, CAST(round(ln((SELECT count(DISTINCT task) FROM d) / count(*) OVER (PARTITION BY lemma)) * 1e6) AS BIGINT) AS idf FROM dl GROUP BY lemma, task) USING (lemma) WHERE idf > 0 GROUP BY ALL)
  QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY s DESC, task) <= 2""")


PARTS["asked"] = ("", """SELECT item_id, coalesce(list(name) FILTER (hardness = 'hard'), []) AS hard, coalesce(list(name) FILTER (hardness = 'soft'), []) AS soft FROM benchmark LEFT JOIN (
  SELECT DISTINCT item_id, name, hardness FROM (SELECT item_id, lower(text) AS t, array_to_string(regexp_extract_all(lower(text), '\\p{L}+'), ' ') AS l FROM benchmark), (VALUES """ + ", ".join(
    f"('{n}', '{h}', '{s}')" for n, h, ss in WORDS for s in ss
) + """) AS w(name, hardness, surface) WHERE contains(' ' || CASE WHEN contains(surface, ' ') THEN t ELSE l END || ' ', ' ' || surface || ' ')) USING (item_id) GROUP BY item_id""")
#: The hard constraints of item a hold for a row; how many of its soft ones do.
_HARD = " AND ".join(f"(NOT list_contains(asked.hard, '{n}') OR {ok})" for n, ok in _OK.items())
_SOFT = " + ".join(f"(list_contains(asked.soft, '{n}') AND {ok})::INT" for n, ok in _OK.items())


def _pick_sql(cut: str, order: str, k: int = 5) -> str:
    return f"""SELECT item_id, doc_id, task, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, {order}doc_id) AS rank FROM (
  SELECT s.item_id, s.doc_id, rows.task, likes, round(coalesce(round(CAST(round(list_cosine_similarity(a.v, b.v) * 1e6) AS BIGINT) / 1e6, 4), 0) + CASE WHEN i.task IS NULL THEN 0.0::DOUBLE ELSE 0.15::DOUBLE END
    + 0.05::DOUBLE * ({_SOFT}), 4) AS score
  FROM ({cut}) s JOIN rows ON rows.doc_id = s.doc_id JOIN asked ON asked.item_id = s.item_id LEFT JOIN e a ON a.vec_id = s.item_id LEFT JOIN e b ON b.vec_id = s.doc_id
  LEFT JOIN item_tasks i ON i.item_id = s.item_id AND i.task = rows.task WHERE {_HARD})) WHERE rank <= {k}"""


_CUT = "SELECT item_id, doc_id FROM sparse_ranked WHERE rank <= 200"
_NEEDS = "sparse_ranked rows e item_tasks asked"


@query(sql(f"SELECT b.item_id, doc_id, task, score, rank, doc_id IS NULL AS abstained FROM benchmark b LEFT JOIN ({_pick_sql(_CUT, '')}) p ON p.item_id = b.item_id", _NEEDS))
def hybrid_pick(x: Data) -> DataFrame:
    """The five best rows of each item; an item for which nothing is left has one row that says so."""
    return cs.or_abstained(picks(x), x.table("benchmark").select("item_id"), "item_id", "doc_id")


@query(sql(_pick_sql(f"SELECT item_id, doc_id FROM sparse JOIN rows USING (doc_id) JOIN asked USING (item_id) WHERE {_HARD} QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY s DESC, doc_id) <= 200", ""), _NEEDS))
def prefilter_mode(x: Data) -> DataFrame:
    """The same with the hard constraints before the sparse cut."""
    return picks(x, filter_first=True)


@query(sql(f"SELECT count(*) AS n, CAST(count_if(off.doc_id IS DISTINCT FROM pop.doc_id) AS BIGINT) AS changed FROM ({_pick_sql(_CUT, '', 50)}) off FULL JOIN ({_pick_sql(_CUT, '-likes, ', 50)}) pop USING (item_id, rank)", _NEEDS))
def tiebreak_delta(x: Data) -> DataFrame:
    """Places among the first 50 that change when ties go by popularity."""
    off, pop = picks(x, k=50).select("item_id", "rank", F.col("doc_id").alias("a")), picks(x, k=50, popular=True).select("item_id", "rank", F.col("doc_id").alias("b"))
    return off.join(pop, ["item_id", "rank"], "full").agg(F.count(F.lit(1)).alias("n"), F.count_if(~F.col("a").eqNullSafe(F.col("b"))).alias("changed"))


# --- catalog scans and lookups --------------------------------------------------------------------------------------


@query(r"SELECT doc_id, n_chars FROM documents WHERE trim(text, ' ' || chr(9) || chr(10) || chr(13) || chr(12)) <> '' QUALIFY row_number() OVER (PARTITION BY lower(trim(text, ' ' || chr(9) || chr(10) || chr(13) || chr(12))) ORDER BY doc_id) = 1")
def dedup_descriptive(x: Data) -> DataFrame:
    """The first row of each text by case and outer space; blank ones go.  Keys are aggregated, never sorted whole."""
    keyed = x.docs.select("doc_id", "n_chars", F.lower(strip(F.col("text"))).alias("k")).where("k <> ''")
    return keyed.groupBy(F.sha2("k", 256)).agg(F.min(F.struct("doc_id", "n_chars")).alias("r")).select("r.doc_id", "r.n_chars")


_RUNS = r"""SELECT doc_id, phrase, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS ord FROM (SELECT doc_id, min(pos) AS pos, arg_min(phrase, pos) AS phrase FROM (
  SELECT doc_id, island, min(i) AS pos, string_agg(tok, ' ' ORDER BY i) AS phrase FROM (SELECT *, sum(CASE WHEN ok THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY i) AS island FROM (
    SELECT *, regexp_matches(tok, '^\p{L}+$') AND lower(tok) NOT IN (STOPS) AS ok FROM (SELECT doc_id, unnest(toks) AS tok, generate_subscripts(toks, 1) AS i FROM (SELECT doc_id, regexp_extract_all(text, '\p{L}+|[^\p{L}\s]') AS toks FROM documents)))) WHERE ok GROUP BY doc_id, island)
  GROUP BY doc_id, lower(phrase))"""


def _stops() -> str:
    from .base import STOPS

    return STOPS


@query(f"SELECT * FROM ({_RUNS.replace('STOPS', _stops())}) WHERE ord <= 40")
def phrase_chunks(x: Data) -> DataFrame:
    return key_phrases(x.docs, "doc_id", "text")


@query(sql("""SELECT q, n.vec_id AS doc_id, n.rank, CASE WHEN d.doc_id % 3 > 0 THEN 'https://catalog/' || d.doc_id END AS url, substr(trim(d.text, ' ' || chr(9) || chr(10) || chr(13) || chr(12)), 1, 160) AS description FROM (
  SELECT q, vec_id, row_number() OVER (PARTITION BY q ORDER BY sim DESC, vec_id) AS rank FROM (SELECT *, count_if(label = q_label AND q // 50 % 2 = 0) OVER (PARTITION BY q) AS m FROM sims) WHERE m = 0 OR label = q_label) n JOIN d ON d.doc_id = n.vec_id WHERE n.rank <= 3""", "sims d"))
def task_filter_fallback(x: Data) -> DataFrame:
    """The three nearest rows of the wanted label, or of all where no other row has it (every second query wants one that isn't
    there); then one join for their link, which rows of the third kind don't have, and a short description."""
    sizes = x.vectors.groupBy("label").agg(F.count(F.lit(1)).alias("n"))  # a taxonomy
    asked = x.vector_queries.join(sizes, F.col("q_label") == F.col("label"))
    wanted = asked.select("q", "vector", F.when((F.floor(F.col("q") / 50) % 2 == 0) & (F.col("n") > 1), F.col("q_label")).alias("want"))
    top = vc.nearest(wanted, x.vectors, "q", "vec_id", 3, match=("want", "label"), apart=True)
    rows = x.docs.select(
        F.col("doc_id").alias("vec_id"), F.when(F.col("doc_id") % 3 > 0, F.concat(F.lit("https://catalog/"), F.col("doc_id").cast("string"))).alias("url"),
        F.substring(strip(F.col("text")), 1, 160).alias("description"),
    )
    return top.join(rows, "vec_id").select("q", F.col("vec_id").alias("doc_id"), "rank", "url", "description")


@query("""SELECT task, p_partkey, domain_match, downloads, likes, rank FROM (SELECT *, row_number() OVER (PARTITION BY task ORDER BY domain_match DESC, coalesce(downloads, 0) DESC, coalesce(likes, 0) DESC, p_partkey) AS rank FROM (
  SELECT p_type AS task, p_partkey, p_brand IN ('Brand#11', 'Brand#22') AS domain_match, downloads, likes FROM part LEFT JOIN (SELECT l_partkey, CAST(sum(l_quantity) AS BIGINT) AS downloads, count(*) AS likes FROM lineitem GROUP BY 1) ON l_partkey = p_partkey)) WHERE rank <= 5""")
def popularity_lookup(x: Data) -> DataFrame:
    """For each task the five most popular rows, those of a wanted domain first."""
    use = x.table("lineitem").groupBy("l_partkey").agg(F.sum("l_quantity").cast("long").alias("downloads"), F.count(F.lit(1)).alias("likes"))
    rows = x.table("part").join(use, F.col("p_partkey") == F.col("l_partkey"), "left").select(F.col("p_type").alias("task"), "p_partkey", F.arrays_overlap(F.array("p_brand"), F.lit(["Brand#11", "Brand#22"])).alias("domain_match"), "downloads", "likes")
    zero = rows.withColumns({"__d": -F.coalesce("downloads", F.lit(0)), "__l": -F.coalesce("likes", F.lit(0)), "__m": F.col("domain_match").cast("int")})
    return rk.top_k(zero, "task", "__m", 5, "__d", "__l", "p_partkey").drop("__d", "__l", "__m")


@query(sql("SELECT item_id, s.doc_id, quality, toxic, n_chars FROM sparse_ranked s LEFT JOIN labels USING (doc_id) LEFT JOIN documents d ON d.doc_id = s.doc_id WHERE rank <= 3", "sparse_ranked"))
def enrich_left_join(x: Data) -> DataFrame:
    """All results get their attributes in one join; a row without labels keeps its base fields."""
    return sparse(x, 3).join(x.table("labels"), "doc_id", "left").join(x.docs.select("doc_id", "n_chars"), "doc_id", "left").select("item_id", "doc_id", "quality", "toxic", "n_chars")


@query("SELECT doc_id, lang FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)")
def semi_subset(x: Data) -> DataFrame:
    return x.docs.join(x.table("labels").where("quality = 1"), "doc_id", "left_semi").select("doc_id", "lang")


@query(r"SELECT doc_id, CASE WHEN lower(substr(text, 1, 60)) LIKE '%is a %model%' THEN 'card' ELSE 'summary' END AS source, length(CASE WHEN lower(substr(text, 1, 60)) LIKE '%is a %model%' THEN text ELSE substr(text, 1, 60) END) AS n FROM documents UNION ALL SELECT -item_id - 1, 'card', length(text) FROM benchmark")
def weak_text_repair(x: Data) -> DataFrame:
    """Summaries that only echo a name give way to the card; benchmark items stand in as such."""
    docs = x.docs.select("doc_id", F.substring("text", 1, 60).alias("summary"), F.col("text").alias("card"))
    items = x.table("benchmark").select((-F.col("item_id") - 1).alias("doc_id"), F.concat(F.lit("Item "), F.col("item_id").cast("string"), F.lit(" is a fine model")).alias("summary"), F.col("text").alias("card"))
    out = docs.unionByName(items).withColumn("t", repaired(F.col("summary"), F.col("card")))
    return out.select("doc_id", F.when(F.col("t") == F.col("summary"), "summary").otherwise("card").alias("source"), F.length("t").alias("n"))


#: The labels of the taxonomy.
LABELS = (
    "any-to-any audio-classification audio-text-to-text audio-to-audio automatic-speech-recognition depth-estimation document-question-answering feature-extraction fill-mask graph-ml "
    "image-classification image-feature-extraction image-segmentation image-text-to-image image-text-to-text image-text-to-video image-to-3d image-to-image image-to-text image-to-video "
    "keypoint-detection mask-generation multimodal-chat-completion multiple-choice object-detection question-answering reinforcement-learning robotics sentence-similarity summarization "
    "table-question-answering tabular-classification tabular-regression text-classification text-generation text-ranking text-retrieval text-to-3d text-to-audio text-to-image "
    "text-to-speech text-to-video text2text-generation time-series-forecasting token-classification translation unconditional-image-generation video-classification video-text-to-text "
    "video-to-video visual-document-retrieval visual-question-answering voice-activity-detection zero-shot-classification zero-shot-image-classification zero-shot-object-detection"
).split()


@query("""WITH l AS (SELECT unnest([LABELS]) AS label), m AS (SELECT label, regexp_matches(label, 'text|question|answering')::INT + regexp_matches(label, 'image|visual')::INT + contains(label, 'audio')::INT + contains(label, 'video')::INT AS k FROM l)
SELECT label, CASE WHEN k > 1 THEN 'multimodal' WHEN regexp_matches(label, 'audio|speech|voice') THEN 'audio' WHEN contains(label, 'video') THEN 'video' WHEN contains(label, '3d') THEN '3d' WHEN regexp_matches(label, 'image|visual') THEN 'image'
  WHEN regexp_matches(label, 'tabular|series|graph') THEN 'tabular' WHEN regexp_matches(label, 'text|token|translation|summarization|sentence|question|fill|ranking|retrieval|classification|choice|answering') THEN 'text'
  WHEN regexp_matches(label, 'depth|mask|keypoint|object|segmentation') THEN 'image' ELSE 'other' END AS family FROM m""".replace("LABELS", ", ".join(map(repr, LABELS))))
def label_family(x: Data) -> DataFrame:
    return x.spark.range(1).select(F.explode(F.lit(LABELS)).alias("label")).withColumn("family", family(F.col("label")))


@query("SELECT event_type, count(*) AS n, CAST(count_if(json_extract_string(props, '$.k') IN ('1', '2', '3')) AS BIGINT) AS hits FROM events GROUP BY event_type")
def json_list_filter(x: Data) -> DataFrame:
    """Rows whose JSON list meets the wanted values; anything that isn't a list is an empty one."""
    from siftmark.functions.labels import json_strings, overlaps

    listed = F.concat(F.lit("["), F.get_json_object("props", "$.k"), F.lit(', " "]'))
    return x.table("events").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.count_if(overlaps(json_strings(listed), F.lit(["1", "2", "3"]))).alias("hits"))


@query("SELECT event_type, CAST(sum(CAST(json_extract(props, '$.k') AS BIGINT)) AS BIGINT) AS total, max(CAST(json_extract(props, '$.k') AS BIGINT)) AS most FROM events GROUP BY event_type")
def json_props(x: Data) -> DataFrame:
    k = F.from_json("props", "struct<k:bigint>")["k"]
    return x.table("events").groupBy("event_type").agg(F.sum(k).alias("total"), F.max(k).alias("most"))
