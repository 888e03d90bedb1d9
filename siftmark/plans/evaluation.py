"""Tagging, metric, audit and profiling queries over the driver tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftmark.functions.text import C, whitespace_set
from siftmark.operators import evaluation as ev
from siftmark.operators import ranking as rk
from siftmark.operators import tagging as tg
from siftmark.operators import vector as vc
from siftmark.operators.sparse import sparse_nearest

from .base import PARTS, Data, query, sql
from .retrieval import cosine

LEAST = 3
_RATE = "coalesce(round({0} / nullif({1}, 0), 4), 0)"


def _rate(hits: str, n: str) -> str:
    return _RATE.format(f"({hits})::DOUBLE", n)


# --- dictionaries ---------------------------------------------------------------------------------------------------

_GRAMS = r"SELECT DISTINCT doc_id, w[i] || ' ' || w[i + 1] AS gram FROM (SELECT doc_id, w, unnest(range(1, len(w))) AS i FROM (SELECT doc_id, regexp_extract_all(lower(text), '\p{L}+') AS w FROM documents))"
PARTS["grams"] = ("", _GRAMS)
PARTS["alias"] = ("grams c", f"SELECT bucket, gram AS phrase, count(*) AS weight FROM grams JOIN c USING (doc_id) GROUP BY ALL HAVING count(*) >= {LEAST}")
PARTS["alias_hits"] = ("grams alias p", "SELECT g.doc_id, a.bucket, a.phrase, a.weight FROM grams g JOIN p USING (doc_id) JOIN alias a ON a.phrase = g.gram")
PARTS["alias_scores"] = ("alias_hits", "SELECT doc_id, bucket, CAST(sum(weight) AS BIGINT) AS score FROM alias_hits GROUP BY ALL")
PARTS["best_alias"] = ("alias_scores", "SELECT * FROM alias_scores QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, bucket) = 1")
PARTS["cues"] = ("grams lem", "SELECT doc_id, CASE WHEN length(lemma) >= 8 THEN 'noun' ELSE 'verb' END AS kind, lemma AS cue FROM lem WHERE length(lemma) >= 5 UNION ALL SELECT doc_id, 'pair', gram FROM grams")
PARTS["assoc"] = ("cues c", """SELECT kind, cue, bucket, n, CAST(round(CASE kind WHEN 'pair' THEN 3 WHEN 'noun' THEN 2 ELSE 1 END * n / total * 1e6) AS BIGINT) AS share FROM (
  SELECT *, sum(n) OVER (PARTITION BY kind, cue) AS total FROM (SELECT kind, cue, bucket, count(*) AS n FROM cues JOIN c USING (doc_id) GROUP BY ALL)) WHERE total >= 2""")
PARTS["struct_hits"] = ("cues assoc p", "SELECT cues.doc_id, kind, cue, assoc.bucket, n, share FROM cues JOIN p USING (doc_id) JOIN assoc USING (kind, cue)")
PARTS["struct_scores"] = ("struct_hits", "SELECT doc_id, bucket, CAST(sum(share) AS BIGINT) AS score FROM struct_hits GROUP BY ALL")
PARTS["best_struct"] = ("struct_scores", "SELECT * FROM struct_scores QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, bucket) = 1")


def aliases(x: Data) -> DataFrame:
    return tg.alias_table(x.catalog, "doc_id", "bucket", "text", LEAST)


def alias_hits(x: Data) -> DataFrame:
    return tg.hits(x.prompts.select("doc_id", "text"), aliases(x), "doc_id", "text")


def alias_scores(x: Data) -> DataFrame:
    return alias_hits(x).groupBy("doc_id", "bucket").agg(F.sum("weight").alias("score"))


def struct_hits(x: Data) -> DataFrame:
    return tg.structural_hits(x.prompts.select("doc_id", "text"), tg.associations(x.catalog, "doc_id", "bucket", "text"), "doc_id", "text")


def struct_scores(x: Data) -> DataFrame:
    return struct_hits(x).groupBy("doc_id", "bucket").agg(F.sum("share").alias("score"))


@query(sql("SELECT DISTINCT doc_id, bucket FROM alias_hits", "alias_hits"))
def phrase_dictionary_tag(x: Data) -> DataFrame:
    return tg.tags(alias_hits(x), "doc_id", "bucket")


@query(sql(f"""SELECT tp, n_predicted, n_gold, n_gold - tp AS missed, {_rate('tp', 'n_predicted')} AS precision, {_rate('tp', 'n_gold')} AS recall, {_rate('2 * tp', '(n_predicted + n_gold)')} AS f1 FROM (
  SELECT (SELECT count(*) FROM (SELECT doc_id, bucket FROM alias_hits INTERSECT SELECT doc_id, bucket FROM p)) AS tp, (SELECT count(DISTINCT (doc_id, bucket)) FROM alias_hits) AS n_predicted, (SELECT count(*) FROM p) AS n_gold)""", "alias_hits p"))
def tag_micro_f1(x: Data) -> DataFrame:
    """Micro precision and recall of the tags; `missed` is how many gold tags the dictionary can't reach."""
    return tg.micro_scores(tg.tags(alias_hits(x), "doc_id", "bucket"), x.prompts.select("doc_id", "bucket"), "doc_id", "bucket")


@query(sql("SELECT doc_id, bucket, score FROM best_alias", "best_alias"))
def alias_vote(x: Data) -> DataFrame:
    return rk.best(alias_scores(x), "doc_id", "bucket")


@query(sql("SELECT doc_id, bucket, round(score / 1e6, 6) AS score FROM best_struct", "best_struct"))
def structural_vote(x: Data) -> DataFrame:
    return rk.best(struct_scores(x), "doc_id", "bucket").withColumn("score", rk.from_micro(F.col("score")))


# --- metrics --------------------------------------------------------------------------------------------------------

PARTS["preds"] = ("flat", "SELECT doc_id, list(task ORDER BY score DESC, task) AS preds FROM flat GROUP BY doc_id")
PARTS["golds"] = ("p d", "SELECT p.doc_id, CASE WHEN p.doc_id % 2 = 0 THEN [task, lang || '-src0'] ELSE [task] END AS gold, bucket FROM p")


def golds(x: Data) -> DataFrame:
    """Gold lists: the task, and for even ids a second one that is right as well."""
    second = F.when(F.col("doc_id") % 2 == 0, F.array("task", F.concat("lang", F.lit("-src0")))).otherwise(F.array("task"))
    return x.prompts.select("doc_id", second.alias("gold"), F.col("bucket").alias("gold_bucket"))


def rankings(x: Data) -> DataFrame:
    ordered = F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("s"), "task")))
    return x.flat.groupBy("doc_id").agg(F.transform(ordered, lambda r: r["task"]).alias("preds"))


def judged(x: Data) -> DataFrame:
    return rankings(x).join(golds(x), "doc_id").withColumn("pred", F.get("preds", 0))


@query(sql(f"SELECT count(*) AS n, sum(a)::BIGINT AS top1_exact, sum(b)::BIGINT AS top1_in_list, sum(c3)::BIGINT AS in_list_at_3, {_rate('sum(a)', 'count(*)')} AS exact_rate FROM (SELECT (preds[1] = gold[1])::INT AS a, list_contains(gold, preds[1])::INT AS b, list_has_any(preds[1:3], gold)::INT AS c3 FROM preds JOIN golds USING (doc_id))", "preds golds"))
def accuracy_at_k(x: Data) -> DataFrame:
    n = judged(x).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(ev.top1_exact(F.col("pred"), F.col("gold"))).alias("top1_exact"), F.count_if(ev.in_list(F.col("pred"), F.col("gold"))).alias("top1_in_list"),
        F.count_if(ev.in_list_at(F.col("preds"), F.col("gold"), 3)).alias("in_list_at_3"),
    )
    return n.withColumn("exact_rate", ev.rate(F.col("top1_exact"), F.col("n")))


@query(sql(f"SELECT k, count(*) AS n, CAST(count_if(list_has_any(preds[1:k], gold)) AS BIGINT) AS hits, {_rate('count_if(list_has_any(preds[1:k], gold))', 'count(*)')} AS rate FROM preds JOIN golds USING (doc_id), (SELECT unnest([1, 3, 5, 10, 12]) AS k) GROUP BY k", "preds golds"))
def topk_curve(x: Data) -> DataFrame:
    each = judged(x).select("gold", "preds", F.explode(F.lit([1, 3, 5, 10, 12])).alias("k"))
    hit = F.coalesce(F.arrays_overlap(F.slice("preds", F.lit(1), F.col("k")), F.col("gold")), F.lit(False))
    return each.groupBy("k").agg(F.count(F.lit(1)).alias("n"), F.count_if(hit).alias("hits")).withColumn("rate", ev.rate(F.col("hits"), F.col("n")))


_BENIGN = "((gold_bucket = 'en' AND {0} = 'fr') OR (gold_bucket = 'fr' AND {0} = 'en'))"


@query(sql(f"""SELECT count(*) AS n, CAST(count_if(NOT list_contains(gold, preds[1]) AND t.bucket <> gold_bucket AND NOT {_BENIGN.format('t.bucket')}) AS BIGINT) AS far_ensemble,
  CAST(count_if(g.bucket <> gold_bucket AND NOT {_BENIGN.format('g.bucket')}) AS BIGINT) AS far_gate, CAST(count_if(NOT list_contains(list_transform(gold, lambda y: string_split(y, '-')[2]), string_split(preds[1], '-')[2])) AS BIGINT) AS far_family
  FROM preds JOIN (SELECT doc_id, gold, bucket AS gold_bucket FROM golds) USING (doc_id) JOIN tasks t ON t.task = preds[1] JOIN best_gate g USING (doc_id)""", "preds golds tasks best_gate"))
def far_errors(x: Data) -> DataFrame:
    """Three kinds of far errors: the label's bucket, the gate's bucket, and the label's family (here its source)."""
    benign = lambda b: ((F.col("gold_bucket") == "en") & (b == "fr")) | ((F.col("gold_bucket") == "fr") & (b == "en"))
    rows = judged(x).join(x.tasks.withColumnRenamed("task", "pred"), "pred").join(rk.best(x.gate, "doc_id", "bucket").select("doc_id", F.col("bucket").alias("gated")), "doc_id")
    fam = lambda t: F.get(F.split(t, "-"), 1)
    return rows.agg(
        F.count(F.lit(1)).alias("n"), F.count_if(ev.far_bucket(F.col("pred"), F.col("bucket"), F.col("gold"), F.col("gold_bucket"), benign(F.col("bucket")))).alias("far_ensemble"),
        F.count_if((F.col("gated") != F.col("gold_bucket")) & ~benign(F.col("gated"))).alias("far_gate"), F.count_if(~F.array_contains(F.transform("gold", fam), fam(F.col("pred")))).alias("far_family"),
    )


@query(sql(f"SELECT (SELECT count(*) FROM tasks) AS n_labels, n, majority, hits, {_rate('hits', 'n')} AS majority_rate, round(1 / (SELECT count(*) FROM tasks), 6) AS random_rate FROM (SELECT count(*) AS n, m.task AS majority, CAST(count_if(list_contains(gold, m.task)) AS BIGINT) AS hits FROM golds, (SELECT task FROM c GROUP BY task ORDER BY count(*) DESC, task LIMIT 1) m GROUP BY m.task)", "tasks golds c"))
def baselines(x: Data) -> DataFrame:
    """What a random label and the most frequent one would get."""
    majority = x.catalog.groupBy("task").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "task").limit(1).select(F.col("task").alias("majority"))
    size = x.tasks.agg(F.count(F.lit(1)).alias("n_labels"))
    got = golds(x).crossJoin(F.broadcast(majority)).groupBy("majority").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.array_contains("gold", F.col("majority"))).alias("hits"))
    return got.crossJoin(F.broadcast(size)).select("n_labels", "n", "majority", "hits", ev.rate(F.col("hits"), F.col("n")).alias("majority_rate"), F.round(F.lit(1.0) / F.col("n_labels"), 6).alias("random_rate"))


@query(sql(f"""SELECT count(*) AS n, {_rate('avg(fold_hits * 1.0 / fold_n)', '1')} AS mean, round(stddev_pop(fold_hits * 1.0 / fold_n), 4) AS sd, CAST(sum(fold_hits) AS BIGINT) AS hits FROM (SELECT doc_id % 3 AS fold, count(*) AS fold_n, count_if(bucket = gold_bucket) AS fold_hits FROM predicted GROUP BY 1)""", "predicted"))
def kfold_stability(x: Data) -> DataFrame:
    """Accuracy of the bucket in three folds by id: mean and population deviation."""
    folds = x.predicted.groupBy(F.pmod("doc_id", F.lit(3)).alias("fold")).agg(F.count(F.lit(1)).alias("fn"), F.count_if(F.col("bucket") == F.col("gold_bucket")).alias("fh"))
    share = F.col("fh") / F.col("fn")
    return folds.agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(share), 4).alias("mean"), F.round(F.stddev_pop(share), 4).alias("sd"), F.sum("fh").alias("hits"))


@query(sql("SELECT 'task' AS mapping, count(*) AS n, CAST(count_if(task = gold) AS BIGINT) AS hits FROM predicted UNION ALL SELECT 'bucket', count(*), CAST(count_if(bucket = gold_bucket) AS BIGINT) FROM predicted UNION ALL SELECT 'source', count(*), CAST(count_if(string_split(task, '-')[2] = string_split(gold, '-')[2]) AS BIGINT) FROM predicted", "predicted"))
def mapping_variants(x: Data) -> DataFrame:
    """Accuracy under three mappings of the labels: as they are, to buckets, to sources."""
    source = lambda c: F.get(F.split(c, "-"), 1)
    pairs = {"task": (F.col("task"), F.col("gold")), "bucket": (F.col("bucket"), F.col("gold_bucket")), "source": (source(F.col("task")), source(F.col("gold")))}
    each = x.predicted.select(F.explode(F.array(*(F.struct(F.lit(n).alias("mapping"), (a == b).alias("hit")) for n, (a, b) in pairs.items()))).alias("m"))
    return each.groupBy("m.mapping").agg(F.count(F.lit(1)).alias("n"), F.count_if("m.hit").alias("hits"))


@query(sql("SELECT gold, task, n FROM (SELECT gold, task, count(*) AS n FROM predicted WHERE gold <> task GROUP BY ALL) ORDER BY n DESC, gold, task LIMIT 12", "predicted"))
def confusion_top(x: Data) -> DataFrame:
    return x.predicted.where("gold <> task").groupBy("gold", "task").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "gold", "task").limit(12)


@query(sql(f"SELECT gold, n, hits, {_rate('hits', 'n')} AS recall FROM (SELECT gold, count(*) AS n, CAST(count_if(task = gold) AS BIGINT) AS hits FROM predicted GROUP BY gold) ORDER BY recall, gold LIMIT 15", "predicted"))
def worst_recall(x: Data) -> DataFrame:
    n = x.predicted.groupBy("gold").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("task") == F.col("gold")).alias("hits"))
    return n.withColumn("recall", ev.rate(F.col("hits"), F.col("n"))).orderBy("recall", "gold").limit(15)


@query(sql("""SELECT a, b, count(*) AS n, CAST(sum(j) AS BIGINT) AS shared FROM (SELECT f.doc_id, f.t[1] = gold AS a, k.t[1] = gold AS b, len(list_intersect(f.t, k.t)) AS j FROM (SELECT doc_id, list(task ORDER BY score DESC, task)[1:3] AS t FROM flat GROUP BY 1) f
  JOIN (SELECT doc_id, list(task ORDER BY score DESC, task)[1:3] AS t FROM cosine GROUP BY 1) k USING (doc_id) JOIN gold USING (doc_id)) GROUP BY a, b""", "flat cosine gold"))
def contingency_systems(x: Data) -> DataFrame:
    """Two rankers side by side: who is right, and how many of their first three labels they share."""
    three = lambda t, n: rk.top_k(t, "doc_id", "score", 3, "task").groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("rank", "task"))).alias(n)).select("doc_id", F.transform(n, lambda r: r["task"]).alias(n))
    rows = three(x.flat, "f").join(three(cosine(x), "k"), "doc_id").join(x.gold, "doc_id")
    return rows.groupBy((F.get("f", 0) == F.col("gold")).alias("a"), (F.get("k", 0) == F.col("gold")).alias("b")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.size(F.array_intersect("f", "k"))).alias("shared"))


PARTS["ask"] = ("p", "SELECT doc_id, CASE WHEN doc_id % 13 = 0 THEN [] ELSE [task] END AS tasks, CASE WHEN doc_id % 3 = 0 THEN [] ELSE [source] END AS domains, [lang] AS specialties, doc_id % 2 = 0 AS hard FROM p")
PARTS["found"] = ("pl idf lem c rows", """SELECT q, doc_id, rank FROM (SELECT q, doc_id, row_number() OVER (PARTITION BY q ORDER BY s DESC, doc_id) AS rank, hard, open_source FROM (
    SELECT *, row_number() OVER (PARTITION BY q ORDER BY s DESC, doc_id) AS r FROM (SELECT pl.doc_id AS q, lem.doc_id, CAST(sum(idf) AS BIGINT) AS s FROM pl JOIN idf USING (lemma) JOIN lem USING (lemma) JOIN c ON c.doc_id = lem.doc_id WHERE idf > 0 GROUP BY ALL))
  JOIN rows USING (doc_id) JOIN (SELECT doc_id AS q, doc_id % 2 = 0 AS hard FROM p) USING (q) WHERE r <= 200 AND (NOT hard OR coalesce(open_source, false))) WHERE rank <= 5""")


@query(sql(f"""WITH v AS (SELECT ask.doc_id AS q, found.rank, ask.hard, found.doc_id IS NOT NULL AS got, list_contains(tasks, d.task) AS t, len(domains) = 0 OR list_contains(domains, d.source) AS dm, list_contains(specialties, d.lang) AS sp FROM ask LEFT JOIN found ON found.q = ask.doc_id LEFT JOIN d ON d.doc_id = found.doc_id WHERE len(tasks) > 0),
o AS (SELECT q, bool_or(got) AS got, bool_or(hard) AS hard, coalesce(bool_or(rank = 1 AND t AND dm AND sp), false) AS s1, coalesce(bool_or(t AND dm AND sp), false) AS sk, coalesce(bool_or(rank = 1 AND t), false) AS t1, coalesce(bool_or(rank = 1 AND dm), false) AS d1, coalesce(bool_or(rank = 1 AND sp), false) AS p1 FROM v GROUP BY q)
SELECT count(*) AS n, (SELECT count(*) FROM ask WHERE len(tasks) = 0) AS n_skipped, CAST(count_if(got) AS BIGINT) AS covered, CAST(count_if(s1) AS BIGINT) AS sat1, CAST(count_if(sk) AS BIGINT) AS satk, CAST(count_if(t1) AS BIGINT) AS task_hits, CAST(count_if(d1) AS BIGINT) AS domain_hits, CAST(count_if(p1) AS BIGINT) AS specialty_hits,
  CAST(count_if(hard) AS BIGINT) AS constrained_n, {_rate('count_if(s1)', 'count(*)')} AS satisfy_at_1, {_rate('count_if(t1)', 'count_if(got)')} AS task_rate, {_rate('count_if(hard AND s1)', 'count_if(hard)')} AS constrained_rate FROM o""", "ask found d").replace("\nWITH v", ",\nv", 1))
def satisfy_metrics(x: Data) -> DataFrame:
    """Coverage metrics of retrieval under a constraint that half of the requests have; requests without a gold task are
    counted and not scored."""
    from siftmark.operators.constraints import satisfied

    from .retrieval import catalog_rows

    empty = F.array().cast("array<string>")
    ask = x.prompts.select(
        F.col("doc_id").alias("q"), F.when(F.col("doc_id") % 13 == 0, empty).otherwise(F.array("task")).alias("tasks"), F.when(F.col("doc_id") % 3 == 0, empty).otherwise(F.array("source")).alias("domains"),
        F.array("lang").alias("specialties"), (F.col("doc_id") % 2 == 0).alias("hard"),
    )
    rows = catalog_rows(x).select("doc_id", satisfied(F.lit("open_source")).alias("open"), "task").join(x.catalog.select("doc_id", "source", "lang"), "doc_id")
    idf = rk.document_frequency(x.lemmas, "doc_id")
    postings, sizes = C.rows(x.catalog, ["doc_id"], "text", distinct=True), (x.prompts.count(), x.catalog.count())
    found = sparse_nearest(x.prompt_lemmas.withColumnRenamed("doc_id", "q"), postings, idf, "q", "doc_id", 200, sizes)
    cut = found.drop("rank").join(rows, "doc_id").join(ask.select("q", "hard"), "q").where("NOT hard OR open")
    top = rk.top_k(cut, "q", "score", 5, "doc_id").select("q", "doc_id", "task", "source", "lang", "rank")
    v = ask.join(top, "q", "left").where(F.size("tasks") > 0)
    one = F.col("rank") == 1
    t, d, p = F.array_contains("tasks", F.col("task")), ev.covered(F.array("source"), F.col("domains")), ev.covered(F.array("lang"), F.col("specialties"))
    any_of = lambda c: F.coalesce(F.bool_or(c), F.lit(False))
    o = v.groupBy("q", "hard").agg(any_of(F.col("doc_id").isNotNull()).alias("got"), any_of(one & t & d & p).alias("s1"), any_of(F.col("doc_id").isNotNull() & t & d & p).alias("sk"), any_of(one & t).alias("t1"), any_of(one & d).alias("d1"), any_of(one & p).alias("p1"))
    n = o.agg(
        F.count(F.lit(1)).alias("n"), F.count_if("got").alias("covered"), F.count_if("s1").alias("sat1"), F.count_if("sk").alias("satk"), F.count_if("t1").alias("task_hits"), F.count_if("d1").alias("domain_hits"),
        F.count_if("p1").alias("specialty_hits"), F.count_if("hard").alias("constrained_n"), F.count_if(F.col("hard") & F.col("s1")).alias("__c"),
    )
    skipped = ask.agg(F.count_if(F.size("tasks") == 0).alias("n_skipped"))
    return n.crossJoin(F.broadcast(skipped)).withColumns({
        "satisfy_at_1": ev.rate(F.col("sat1"), F.col("n")), "task_rate": ev.rate(F.col("task_hits"), F.col("covered")), "constrained_rate": ev.rate(F.col("__c"), F.col("constrained_n")),
    }).drop("__c")


_POISSON = " + ".join(f"(u >= {c!r}::DOUBLE)::INT" for c in ev.poisson_steps())


@query(sql(f"""SELECT round(list_sort(list(mean))[1 + floor(count(*) * 0.025)::INT], 4) AS low, round(list_sort(list(mean))[1 + least(floor(count(*) * 0.975)::INT, count(*) - 1)], 4) AS high FROM (
  SELECT i, sum(w * hit)::DOUBLE / sum(w) AS mean FROM (SELECT i, hit, {_POISSON} AS w FROM (
    SELECT i, (bucket = gold_bucket)::INT AS hit, (('0x' || substr(md5('1234:' || i || ':' || doc_id), 1, 13))::BIGINT + 0.5::DOUBLE) / 4503599627370496::DOUBLE AS u
    FROM predicted, (SELECT unnest(range(1000)) AS i))) GROUP BY i HAVING sum(w) > 0)""", "predicted"))
def bootstrap_ci(x: Data) -> DataFrame:
    """95 % interval of the bucket's accuracy over 1000 resamples."""
    return ev.bootstrap(x.predicted.select(F.col("doc_id").alias("key"), (F.col("bucket") == F.col("gold_bucket")).cast("int").alias("hit")))


@query(sql("""SELECT count(*) AS n_seeds, round(avg(r), 4) AS rate FROM (SELECT seeds.seed, avg(coalesce(drawn.bucket = gold_bucket, false)::INT) AS r FROM gold CROSS JOIN (SELECT unnest([1, 2, 3, 4, 5]) AS seed) seeds
  LEFT JOIN (SELECT q, seed, arg_min(bucket, (md5(seed || ':' || q || ':' || doc_id), doc_id)) AS bucket FROM (
    SELECT doc_id AS q, task FROM flat QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, task) <= 2) t JOIN c USING (task) CROSS JOIN (SELECT unnest([1, 2, 3, 4, 5]) AS seed) GROUP BY q, seed) drawn
  ON drawn.q = gold.doc_id AND drawn.seed = seeds.seed GROUP BY seeds.seed) AS s(seed, r)""", "gold flat c"))
def random_baseline(x: Data) -> DataFrame:
    """A random catalog row of the two best labels' pools, five seeds: how often its bucket is right.  Draws are digests of seed,
    request and row, so any engine draws the same."""
    two = rk.top_k(x.flat, "doc_id", "score", 2, "task").select(F.col("doc_id").alias("q"), "task")
    drawn = ev.draws(two, x.catalog.select("doc_id", "task", "bucket"), "q", "task", "doc_id", "bucket", [1, 2, 3, 4, 5])
    asked = x.gold.select(F.col("doc_id").alias("q"), "gold_bucket").withColumn("seed", F.explode(F.lit([1, 2, 3, 4, 5])))
    rates = asked.join(drawn, ["q", "seed"], "left").groupBy("seed").agg(F.avg(F.coalesce(F.col("bucket") == F.col("gold_bucket"), F.lit(False)).cast("int")).alias("r"))
    return rates.agg(F.count(F.lit(1)).alias("n_seeds"), F.round(F.avg("r"), 4).alias("rate"))


# --- audits ---------------------------------------------------------------------------------------------------------


def _echo_sql(correct: str, parts: str, rare: str) -> str:
    """parts: doc_id, cue, value."""
    return f"""SELECT n_correct, n_dominated, n_echo, {_rate('n_echo', 'n_correct')} AS echo_rate, {_rate('parts', 'n_correct')} AS mean_parts, median_parts, {_rate('n_echo', 'n_correct')} > 0.6 AS fail FROM (
  SELECT count(*) AS n_correct, CAST(count_if(coalesce(total > 0 AND 2 * v >= total, false)) AS BIGINT) AS n_dominated, CAST(count_if(coalesce(total > 0 AND 2 * v >= total, false) AND coalesce({rare}, false)) AS BIGINT) AS n_echo,
    CAST(coalesce(sum(k), 0) AS BIGINT) AS parts, CAST(coalesce(floor(median(coalesce(k, 0))), 0) AS BIGINT) AS median_parts
  FROM ({correct}) a LEFT JOIN (SELECT doc_id, max(value) AS v, max_by(cue, (value, cue)) AS cue, sum(value) AS total, count(*) AS k FROM ({parts}) GROUP BY doc_id) b USING (doc_id) LEFT JOIN ({rare_table(rare)}) r ON r.cue = b.cue)"""


def rare_table(rare: str) -> str:
    if "n_labels" not in rare:
        return "SELECT NULL::VARCHAR AS cue"
    return "SELECT phrase AS cue, count(DISTINCT bucket) AS n_labels FROM alias GROUP BY phrase" if "alias" in rare else "SELECT kind || ':' || cue AS cue, count(DISTINCT bucket) AS n_labels FROM assoc GROUP BY 1"


PARTS["lex_correct"] = ("lexical gold", "SELECT doc_id, task FROM lexical JOIN gold USING (doc_id) WHERE true QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, task) = 1")
_LEX_RIGHT = "SELECT l.doc_id FROM lex_correct l JOIN tasks USING (task) JOIN gold g ON g.doc_id = l.doc_id WHERE bucket = gold_bucket"
_LEX_PARTS = "SELECT l.doc_id, lemma AS cue, idf AS value FROM lex_correct l JOIN pl ON pl.doc_id = l.doc_id JOIN tst USING (lemma, task) WHERE idf > 0"


@query(sql(_echo_sql(_LEX_RIGHT, _LEX_PARTS, "v >= CAST(round(ln((SELECT count(*) FROM tasks) / 4.0::DOUBLE) * 1e6) AS BIGINT)"), "lex_correct tasks gold pl tst"))
def lexical_echo_audit(x: Data) -> DataFrame:
    """Among requests whose bucket the lexical ranker finds: does one lemma make up half of the score, and is it rare?"""
    best = rk.best(x.lexical, "doc_id", "task").select("doc_id", "task")
    right = best.join(x.tasks, "task").join(x.gold, "doc_id").where("bucket = gold_bucket").select("doc_id")
    parts = x.prompt_lemmas.join(best, "doc_id").join(x.task_stats.where("idf > 0"), ["lemma", "task"]).select("doc_id", "lemma", "idf")
    size = x.tasks.agg(rk.micro(F.ln(F.count(F.lit(1)) / F.lit(float(ev.RARE_DF)))).alias("__high"))
    found = ev.dominating(parts, "doc_id", "lemma", "idf").crossJoin(F.broadcast(size))
    return ev.echo_report(right, found, F.col("value") >= F.col("__high"), "doc_id")


_ALIAS_RIGHT = "SELECT b.doc_id FROM best_alias b JOIN gold USING (doc_id) WHERE bucket = gold_bucket"


@query(sql(_echo_sql(_ALIAS_RIGHT, "SELECT h.doc_id, phrase AS cue, weight AS value FROM alias_hits h JOIN best_alias b ON b.doc_id = h.doc_id AND b.bucket = h.bucket", "n_labels /*alias*/ <= 2"), "best_alias alias_hits alias gold"))
def alias_echo_audit(x: Data) -> DataFrame:
    table, hits, best = aliases(x), alias_hits(x), rk.best(alias_scores(x), "doc_id", "bucket").select("doc_id", "bucket")
    right = best.join(x.gold, "doc_id").where("bucket = gold_bucket").select("doc_id")
    found = ev.dominating(hits.join(best, ["doc_id", "bucket"]), "doc_id", "phrase", "weight")
    return ev.echo_report(right, found.join(tg.span(table, ["phrase"], "bucket"), F.col("cue") == F.col("phrase"), "left").drop("phrase"), F.col("n_labels") <= 2, "doc_id")


_STRUCT_RIGHT = "SELECT b.doc_id FROM best_struct b JOIN gold USING (doc_id) WHERE bucket = gold_bucket"


@query(sql(_echo_sql(_STRUCT_RIGHT, "SELECT h.doc_id, kind || ':' || cue AS cue, share AS value FROM struct_hits h JOIN best_struct b ON b.doc_id = h.doc_id AND b.bucket = h.bucket", "n_labels <= 2"), "best_struct struct_hits assoc gold"))
def structural_echo_audit(x: Data) -> DataFrame:
    hits, best = struct_hits(x), rk.best(struct_scores(x), "doc_id", "bucket").select("doc_id", "bucket")
    right = best.join(x.gold, "doc_id").where("bucket = gold_bucket").select("doc_id")
    named = hits.join(best, ["doc_id", "bucket"]).select("doc_id", F.concat_ws(":", "kind", "cue").alias("name"), "share")
    table = tg.associations(x.catalog, "doc_id", "bucket", "text").select(F.concat_ws(":", "kind", "cue").alias("name"), "bucket")
    found = ev.dominating(named, "doc_id", "name", "share").join(tg.span(table, ["name"], "bucket"), F.col("cue") == F.col("name"), "left").drop("name")
    return ev.echo_report(right, found, F.col("n_labels") <= 2, "doc_id")


PARTS["three"] = ("gate alias_scores struct_scores", """SELECT doc_id, bucket, signal, row_number() OVER (PARTITION BY doc_id, signal ORDER BY score DESC, bucket) AS r FROM (SELECT doc_id, bucket, score, 'lexical' AS signal FROM gate UNION ALL SELECT doc_id, bucket, score, 'alias' FROM alias_scores
  UNION ALL SELECT doc_id, bucket, score, 'structural' FROM struct_scores) WHERE score > 0""")


@query(sql(f"""SELECT count(*) AS n_correct, CAST(count_if(2 * most >= total) AS BIGINT) AS n_degenerate, {_rate('count_if(2 * most >= total)', 'count(*)')} AS rate, {_rate('sum(k)', 'count(*)')} AS mean_components FROM (
  SELECT doc_id, bucket, round(sum(1.0::DOUBLE / (60 + r - 1)), 6) AS total, round(max(1.0::DOUBLE / (60 + r - 1)), 6) AS most, count(*) AS k FROM three GROUP BY doc_id, bucket QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY total DESC, bucket) = 1) JOIN gold USING (doc_id) WHERE bucket = gold_bucket""", "three gold"))
def blend_degenerate_audit(x: Data) -> DataFrame:
    """Among right answers of a blend of three rankers by reciprocal ranks: does one ranker alone make up half of the score?"""
    table = rk.signals(lexical=x.gate, alias=alias_scores(x), structural=struct_scores(x)).where("score > 0")
    part = F.lit(1.0) / (F.lit(rk.RRF_K) + F.col("r") - 1)
    blend = rk.top_k(table, ["doc_id", "signal"], "score", None, "bucket", rank="r").groupBy("doc_id", "bucket").agg(F.round(F.sum(part), 6).alias("total"), F.round(F.max(part), 6).alias("most"), F.count(F.lit(1)).alias("k"))
    win = rk.top_k(blend, "doc_id", "total", 1, "bucket").join(x.gold, "doc_id").where("bucket = gold_bucket")
    n = win.agg(F.count(F.lit(1)).alias("n_correct"), F.count_if(2 * F.col("most") >= F.col("total")).alias("n_degenerate"), F.sum("k").alias("__k"))
    return n.select("n_correct", "n_degenerate", ev.rate(F.col("n_degenerate"), F.col("n_correct")).alias("rate"), ev.rate(F.col("__k"), F.col("n_correct")).alias("mean_components"))


PARTS["tok"] = ("", r"SELECT DISTINCT doc_id, unnest(regexp_split_to_array(lower(text), '\s+')) AS token FROM documents")


CLOSE = 0.20
PARTS["rare_pairs"] = ("tok", "SELECT DISTINCT a.doc_id AS q, b.doc_id AS vec_id FROM tok a JOIN tok b USING (token) WHERE a.doc_id % 50 = 0 AND token <> '' AND token IN (SELECT token FROM tok GROUP BY token HAVING count(*) <= 4)")
PARTS["by_centroid"] = ("e cents", "SELECT vec_id AS q, cents.label AS pred FROM e, cents WHERE vec_id % 50 = 0 QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY CAST(round(list_cosine_similarity(e.v, cents.v) * 1e6) AS BIGINT) DESC, cents.label) = 1")


def _degenerate_sql(matched: str) -> str:
    """matched: q, q_label, pred, vec_id, sim."""
    close = f"sim >= {round(CLOSE * 1e6)}"
    return f"""SELECT count(*) AS n, CAST(count_if(ok) AS BIGINT) AS n_correct, CAST(count_if(ok AND {close}) AS BIGINT) AS n_near, CAST(count_if(ok AND {close} AND r.q IS NOT NULL) AS BIGINT) AS n_degenerate, {_rate(f'count_if(ok AND {close} AND r.q IS NOT NULL)', 'count_if(ok)')} AS rate
  FROM (SELECT *, pred = q_label AS ok FROM ({matched})) m LEFT JOIN rare_pairs r ON r.q = m.q AND r.vec_id = m.vec_id"""


@query(sql(_degenerate_sql("SELECT q, q_label, label AS pred, vec_id, sim FROM near WHERE rank = 1"), "near rare_pairs"))
def vector_degenerate_audit(x: Data) -> DataFrame:
    """Nearest-row arm: right answers whose nearest row is close and shares a token of four texts or fewer.  (No two vectors of
    the corpus are near duplicates, so the threshold of 0.98 is lowered here; unit tests plant some.)"""
    top = vc.nearest(x.vector_queries.drop("q_label"), x.vectors, "q", "vec_id", 1, apart=True)
    return vector_degenerate(x, top.withColumnRenamed("label", "pred"), CLOSE)


@query(sql(_degenerate_sql("SELECT near.q, q_label, pred, vec_id, sim FROM near JOIN by_centroid c ON c.q = near.q AND c.pred = near.label QUALIFY row_number() OVER (PARTITION BY near.q ORDER BY sim DESC, vec_id) = 1"), "near rare_pairs by_centroid"))
def centroid_degenerate_audit(x: Data) -> DataFrame:
    """Centroid arm: the nearest member of the label whose centroid is nearest."""
    best = rk.best(vc.similarities(x.vector_queries, vc.centroids(x.vectors, "label"), "q", "label"), "q", "label", "sim").select("q", F.col("label").alias("pred"))
    asked = x.vector_queries.select("q", "vector").join(best, "q")
    members = vc.nearest(asked, x.vectors, "q", "vec_id", 1, match=("pred", "label"), apart=True)
    return vector_degenerate(x, members.withColumnRenamed("label", "pred"), CLOSE)


def vector_degenerate(x: Data, matched: DataFrame, threshold: float) -> DataFrame:
    """matched: q, pred, vec_id, sim."""
    tokens = x.docs.select("doc_id", F.explode(whitespace_set(F.col("text"))).alias("token"))
    rare = tokens.groupBy("token").agg(F.count(F.lit(1)).alias("df")).where(F.col("df") <= ev.RARE_DF)
    own = tokens.join(rare.select("token"), "token", "left_semi")
    top = matched.select("q", "pred", "vec_id", "sim").join(x.vector_queries.select("q", "q_label"), "q")
    shared = top.select("q", "vec_id").join(own.select(F.col("doc_id").alias("q"), "token"), "q").join(own.select(F.col("doc_id").alias("vec_id"), "token"), ["vec_id", "token"], "left_semi").select("q").distinct()
    rows = top.join(shared.withColumn("rare", F.lit(True)), "q", "left")
    ok = F.col("pred") == F.col("q_label")
    close = ok & (F.col("sim") >= F.lit(round(threshold * rk.MICRO)))
    n = rows.agg(F.count(F.lit(1)).alias("n"), F.count_if(ok).alias("n_correct"), F.count_if(close).alias("n_near"), F.count_if(close & F.coalesce("rare", F.lit(False))).alias("n_degenerate"))
    return n.withColumn("rate", ev.rate(F.col("n_degenerate"), F.col("n_correct")))


_HTML = r"regexp_replace(html, '<[^>]*>', ' ', 'g')"
PARTS["allowed"] = ("c", rf"SELECT DISTINCT lemma FROM (SELECT unnest(regexp_extract_all(lower(t), '\p{{L}}+')) AS lemma FROM (SELECT text AS t FROM c UNION ALL SELECT {_HTML} FROM pages)) WHERE length(lemma) >= 3 AND lemma NOT IN (SELECT unnest(stops) FROM stopped)")


def _with_stops(text: str) -> str:
    from .base import STOPS

    return text.replace("NOT IN (SELECT unnest(stops) FROM stopped)", f"NOT IN ({STOPS})")


PARTS["allowed"] = ("c", _with_stops(PARTS["allowed"][1]))


def allowed(x: Data) -> DataFrame:
    """Lemmas of all clean text: the catalog's and the pages'."""
    clean = x.catalog.select("text").unionByName(x.table("pages").select(F.regexp_replace("html", "<[^>]*>", " ").alias("text")))
    return C.rows(clean, [], "text").distinct()


@query(sql("SELECT lemma FROM allowed", "allowed"))
def allowed_vocab(x: Data) -> DataFrame:
    return allowed(x)


PARTS["offends"] = ("bl allowed", "SELECT item_id, EXISTS (SELECT 1 FROM bl WHERE bl.item_id = benchmark.item_id AND lemma NOT IN (SELECT lemma FROM allowed)) AS offends FROM benchmark")


@query(sql("SELECT item_id, offends FROM offends", "offends"))
def provenance_gate(x: Data) -> DataFrame:
    """Benchmark items as cues: one offends if a lemma of its isn't in the clean text."""
    cues = x.table("benchmark").select("item_id", C.set(F.col("text")).alias("lemmas"))
    return ev.provenance(cues, allowed(x), "item_id", "lemmas")


@query(sql("SELECT count(*) AS n_cues, CAST(count_if(offends) AS BIGINT) AS n_offending, CASE WHEN count_if(offends) > 0 THEN 'FAIL' ELSE 'PASS' END AS verdict FROM offends", "offends"))
def leak_verdict(x: Data) -> DataFrame:
    return provenance_gate(x).agg(F.count(F.lit(1)).alias("n_cues"), F.count_if("offends").alias("n_offending")).withColumn("verdict", F.when(F.col("n_offending") > 0, "FAIL").otherwise("PASS"))


PARTS["bound"] = ("bl lem", """SELECT item_id, d.doc_id FROM (SELECT item_id, lower(text) AS t FROM benchmark) b JOIN (SELECT doc_id, lower(text) AS t FROM documents) d ON contains(d.t, b.t)
  UNION SELECT item_id, lem.doc_id FROM bl JOIN lem USING (lemma) WHERE lemma IN (SELECT lemma FROM lem GROUP BY lemma HAVING count(*) <= 2)""")


@query(sql("SELECT item_id, min(doc_id) AS doc_id, count(*) AS n, count(*) = 1 AS is_unique FROM bound GROUP BY item_id", "bound"))
def cue_echo(x: Data) -> DataFrame:
    """Documents that a benchmark item binds: they hold it, or share a rare lemma with it.  The stated set of items goes to
    every task for the first test; the second is an equi-join on lemmas."""
    items = rk.small(x.table("benchmark").select("item_id", F.lower("text").alias("t")))
    held = x.docs.select("doc_id", F.lower("text").alias("d")).join(items, F.contains("d", "t")).select("item_id", "doc_id")
    rare = x.lemmas.groupBy("lemma").agg(F.count(F.lit(1)).alias("df")).where("df <= 2").select("lemma")
    shared = x.item_lemmas.join(x.lemmas.join(rare, "lemma", "left_semi"), "lemma").select("item_id", "doc_id")
    bound = held.unionByName(shared).distinct()
    return bound.groupBy("item_id").agg(F.min("doc_id").alias("doc_id"), F.count(F.lit(1)).alias("n")).withColumn("is_unique", F.col("n") == 1)


PARTS["lone"] = ("bl pl p", """SELECT DISTINCT q FROM (SELECT cue, min(q) AS q FROM (SELECT c.lemma AS cue, pl.doc_id AS q FROM (SELECT DISTINCT lemma FROM bl) c JOIN pl USING (lemma) UNION SELECT c.lemma, p.doc_id FROM (SELECT DISTINCT lemma FROM bl) c JOIN p ON contains(lower(p.text), c.lemma)) GROUP BY cue HAVING count(*) = 1)""")


@query(sql(f"""SELECT (SELECT count(*) FROM p) AS n_prompts, count(*) AS n_correct, CAST(count_if(doc_id IN (SELECT q FROM lone)) AS BIGINT) AS n_coincident, (SELECT count(*) FROM lone) AS n_unique_prompts, {_rate('count_if(doc_id IN (SELECT q FROM lone))', 'count(*)')} AS fraction FROM predicted WHERE bucket = gold_bucket""", "predicted lone p"))
def cue_echo_fraction(x: Data) -> DataFrame:
    """Right buckets on requests that a word of the benchmark binds which binds no other request."""
    cues = x.item_lemmas.select(F.col("lemma").alias("cue")).distinct().withColumn("lemmas", F.array("cue"))
    prompts = x.prompts.select(F.col("doc_id").alias("q"), "text", C.set(F.col("text")).alias("lemmas"))
    right = x.predicted.where("bucket = gold_bucket").select(F.col("doc_id").alias("q"))
    return ev.cue_echo(ev.bindings(cues, prompts, "cue", "q", "text"), prompts, right, "cue", "q")


@query(sql("SELECT count(*) AS n, CAST(count_if(answer = task) AS BIGINT) AS hits FROM (SELECT task, last_value(task) OVER (PARTITION BY text ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS answer FROM d)", "d"))
def memorization_probe(x: Data) -> DataFrame:
    """An exact-lookup predictor misses only texts that stand twice with another label."""
    keyed = x.docs.select(F.sha2("text", 256).alias("k"), "task", "doc_id")
    return ev.memorised(keyed, "k", "task", "doc_id").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("answer") == F.col("task")).alias("hits"))


@query(sql("SELECT md5(lower(trim(text))) AS k, count(*) AS n, count(DISTINCT task) AS n_gold FROM d GROUP BY 1 HAVING count(*) > 1", "d"))
def duplicate_ambiguity(x: Data) -> DataFrame:
    """Texts that stand more than once, and with how many labels."""
    return x.docs.groupBy(F.md5(F.lower(F.trim("text")).cast("binary")).alias("k")).agg(F.count(F.lit(1)).alias("n"), F.countDistinct("task").alias("n_gold")).where("n > 1")


# --- profiles -------------------------------------------------------------------------------------------------------


@query(sql(f"SELECT task, count(*) AS n, {_rate('count(quality)', 'count(*)')} AS quality_filled, {_rate('count_if(toxic = 0)', 'count(*)')} AS clean, {_rate('count_if(trim(text) <> {0})', 'count(*)')} AS text_filled FROM d LEFT JOIN labels USING (doc_id) GROUP BY task".replace("{0}", "''"), "d"))
def catalog_fill_rates(x: Data) -> DataFrame:
    n = F.count(F.lit(1))
    rows = x.docs.join(x.table("labels"), "doc_id", "left").groupBy("task")
    return rows.agg(n.alias("n"), ev.rate(F.count("quality"), n).alias("quality_filled"), ev.rate(F.count_if(F.col("toxic") == 0), n).alias("clean"), ev.rate(F.count_if(F.trim("text") != ""), n).alias("text_filled"))


PARTS["sizes"] = ("d", "SELECT task, count(*) AS n FROM d GROUP BY task")


@query(sql("SELECT max(n) AS most, min(n) AS least, round(max(n) / sum(n), 6) AS top_share, round(sum((2 * r - k - 1) * n) / (any_value(k) * sum(n)), 6) AS gini FROM (SELECT n, row_number() OVER (ORDER BY n, task) AS r, count(*) OVER () AS k FROM sizes)", "sizes"))
def label_imbalance(x: Data) -> DataFrame:
    from pyspark.sql import Window

    sizes = x.docs.groupBy("task").agg(F.count(F.lit(1)).alias("n"))
    ranked = sizes.withColumns({"r": F.row_number().over(Window.orderBy("n", "task")), "k": F.count(F.lit(1)).over(Window.partitionBy(F.lit(1)))})  # labels, not rows
    return ranked.agg(
        F.max("n").alias("most"), F.min("n").alias("least"), F.round(F.max("n") / F.sum("n"), 6).alias("top_share"), F.round(F.sum((2 * F.col("r") - F.col("k") - 1) * F.col("n")) / (F.max("k") * F.sum("n")), 6).alias("gini")
    )


@query(sql("SELECT task, n, row_number() OVER w AS rank, round(n / (SELECT sum(n) FROM sizes), 6) AS share, round(sum(n) OVER w / (SELECT sum(n) FROM sizes), 6) AS cumulative FROM sizes WINDOW w AS (ORDER BY n DESC, task ROWS UNBOUNDED PRECEDING)", "sizes"))
def cumulative_coverage(x: Data) -> DataFrame:
    return ev.concentration(x.docs.groupBy("task").agg(F.count(F.lit(1)).alias("n")), "task", "n")


@query(sql("SELECT value, count(*) AS n FROM (SELECT unnest([lang, source, CASE WHEN n_chars > 2000 THEN 'long' END]) AS value FROM d) WHERE value IS NOT NULL GROUP BY value", "d"))
def multivalue_counts(x: Data) -> DataFrame:
    values = F.array_compact(F.array("lang", "source", F.when(F.col("n_chars") > 2000, "long")))
    return x.docs.select(F.explode(values).alias("value")).groupBy("value").agg(F.count(F.lit(1)).alias("n"))


@query(sql("SELECT task, 'missing' AS side FROM (SELECT task FROM d WHERE doc_id >= 100 EXCEPT SELECT task FROM d WHERE doc_id < 100) UNION ALL SELECT task, 'extra' FROM (SELECT task FROM d WHERE doc_id < 100 EXCEPT SELECT task FROM d WHERE doc_id >= 100)", "d"))
def bucket_coverage_except(x: Data) -> DataFrame:
    """Labels on one side of a split of the catalog only; a complete dimension gives no rows."""
    a, b = x.docs.where("doc_id < 100").select("task"), x.docs.where("doc_id >= 100").select("task")
    return b.distinct().subtract(a).withColumn("side", F.lit("missing")).unionByName(a.distinct().subtract(b).withColumn("side", F.lit("extra")))
