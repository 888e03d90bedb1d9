"""Queries of the report parts of metrics and audits, over the driver tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftmark.operators import evaluation as ev
from siftmark.operators import ranking as rk
from siftmark.operators import tagging as tg
from siftmark.sources import sinks

from . import evaluation as base
from .base import BENIGN, PARTS, Data, query, sql
from .evaluation import _rate
from .retrieval import BEST, SETS, cosine, oracle_gate

# --- ablation, folds, intervals, overlaps ---------------------------------------------------------------------------

_SET_ROWS = " UNION ALL ".join(
    f"SELECT '{'+'.join(s)}' AS name, doc_id, task FROM (SELECT doc_id, task, round(sum(norm), 6) AS score FROM normed WHERE signal IN ({', '.join(map(repr, s))}) GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, task) = 1"
    for s in SETS
)


@query(sql(f"""SELECT name, count(*) AS n, CAST(count_if(task = gold) AS BIGINT) AS hits, {_rate('count_if(task = gold)', 'count(*)')} AS rate FROM ({_SET_ROWS}
  UNION ALL SELECT 'best', doc_id, task FROM fused QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, task) = 1
  UNION ALL SELECT 'oracle', f.doc_id, f.task FROM flat f JOIN tasks USING (task) JOIN gold g ON g.doc_id = f.doc_id AND g.gold_bucket = tasks.bucket QUALIFY row_number() OVER (PARTITION BY f.doc_id ORDER BY f.score DESC, f.task) = 1)
  JOIN gold USING (doc_id) GROUP BY name""", "normed fused flat tasks gold"))
def ablation_table(x: Data) -> DataFrame:
    """Every set of signals, the best weights, and the flat ranker inside the right bucket."""
    from .retrieval import pairwise_ablation

    best = rk.best(rk.fuse(x.signals, "doc_id", "task", BEST), "doc_id", "task").join(x.gold, "doc_id")
    more = best.select(F.lit("best").alias("name"), (F.col("task") == F.col("gold")).alias("hit")).unionByName(oracle_gate(x).select(F.lit("oracle").alias("name"), "hit"))
    out = pairwise_ablation(x).unionByName(more.groupBy("name").agg(F.count(F.lit(1)).alias("n"), F.count_if("hit").alias("hits")))
    return out.withColumn("rate", ev.rate(F.col("hits"), F.col("n")))


_FAR = f"bucket <> gold_bucket AND NOT (bucket IN {BENIGN} AND gold_bucket IN {BENIGN})"


@query(sql(f"""SELECT count(*) AS folds, {_rate('avg(hits * 1.0 / n)', '1')} AS top1_mean, round(stddev_pop(hits * 1.0 / n), 4) AS top1_sd, {_rate('avg(far * 1.0 / n)', '1')} AS far_mean, round(stddev_pop(far * 1.0 / n), 4) AS far_sd
  FROM (SELECT doc_id % 3 AS fold, count(*) AS n, count_if(task = gold) AS hits, count_if(task <> gold AND {_FAR}) AS far FROM predicted GROUP BY 1)""", "predicted"))
def kfold_far(x: Data) -> DataFrame:
    """First labels that are right and far errors, in three folds by id: means and population deviations."""
    benign = F.col("bucket").isin(*BENIGN) & F.col("gold_bucket").isin(*BENIGN)
    far = ev.far_bucket(F.col("task"), F.col("bucket"), F.array("gold"), F.col("gold_bucket"), benign)
    folds = x.predicted.groupBy(F.pmod("doc_id", F.lit(3)).alias("fold")).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("task") == F.col("gold")).alias("hits"), F.count_if(far).alias("far"))
    hits, missed = F.col("hits") / F.col("n"), F.col("far") / F.col("n")
    each = [f(c, n) for c, n in ((hits, "top1"), (missed, "far")) for f in (lambda c, n: F.round(F.avg(c), 4).alias(f"{n}_mean"), lambda c, n: F.round(F.stddev_pop(c), 4).alias(f"{n}_sd"))]
    return folds.agg(F.count(F.lit(1)).alias("folds"), *each)


@query(sql("""SELECT round(list_sort(list(mean))[1 + floor(count(*) * 0.025)::INT], 4) AS low, round(list_sort(list(mean))[1 + least(floor(count(*) * 0.975)::INT, count(*) - 1)], 4) AS high FROM (
  SELECT i, avg((u * n < hits)::INT) AS mean FROM (SELECT i, n, hits, (('0x' || substr(md5('1234:' || i || ':' || j), 1, 13))::BIGINT + 0.5::DOUBLE) / 4503599627370496::DOUBLE AS u
    FROM (SELECT count(*) AS n, count_if(task = gold) AS hits, unnest(range(count(*))) AS j FROM predicted), (SELECT unnest(range(1000)) AS i)) GROUP BY i)""", "predicted"))
def bootstrap_n_of_n(x: Data) -> DataFrame:
    """95 % interval of the share of right first labels over 1000 resamples of as many outcomes as there are."""
    return ev.bootstrap_n(x.predicted.select((F.col("task") == F.col("gold")).cast("int").alias("hit")))


@query(sql(f"""SELECT count(*) AS n, round(avg(j / u), 4) AS jaccard, count_if(b) AS second_right, {_rate('count_if(a AND b)', 'count_if(b)')} AS right_given_right, {_rate('count_if(a AND NOT b)', 'count_if(NOT b)')} AS right_given_wrong
  FROM (SELECT f.t[1] = gold AS a, k.t[1] = gold AS b, len(list_intersect(f.t, k.t)) AS j, len(list_distinct(list_concat(f.t, k.t))) AS u FROM (SELECT doc_id, list(task ORDER BY score DESC, task)[1:3] AS t FROM flat GROUP BY 1) f
  JOIN (SELECT doc_id, list(task ORDER BY score DESC, task)[1:3] AS t FROM cosine GROUP BY 1) k USING (doc_id) JOIN gold USING (doc_id))""", "flat cosine gold"))
def ranking_overlap(x: Data) -> DataFrame:
    """Two rankers: the mean Jaccard similarity of their first three labels, and how often one is right where the other is or isn't."""
    three = lambda t, n: rk.top_k(t, "doc_id", "score", 3, "task").groupBy("doc_id").agg(F.collect_list("task").alias(n), F.min_by("task", "rank").alias(f"{n}1"))
    rows = three(x.flat, "f").join(three(cosine(x), "k"), "doc_id").join(x.gold, "doc_id").withColumns({"a": F.col("f1") == F.col("gold"), "b": F.col("k1") == F.col("gold")})
    n = rows.agg(
        F.count(F.lit(1)).alias("n"), F.round(F.avg(ev.jaccard(F.col("f"), F.col("k"))), 4).alias("jaccard"), F.count_if("b").alias("second_right"),
        F.count_if(F.col("a") & F.col("b")).alias("__both"), F.count_if(F.col("a") & ~F.col("b")).alias("__first"),
    )
    return n.select("n", "jaccard", "second_right", ev.rate(F.col("__both"), F.col("second_right")).alias("right_given_right"), ev.rate(F.col("__first"), F.col("n") - F.col("second_right")).alias("right_given_wrong"))


@query(sql(f"SELECT count(*) AS n, CAST(count_if(hit) AS BIGINT) AS n_right, {_rate('count_if(hit)', 'count(*)')} AS any_correct FROM (SELECT p.doc_id, coalesce(bool_or(h.bucket = p.bucket), false) AS hit FROM p LEFT JOIN alias_hits h USING (doc_id) GROUP BY p.doc_id)", "p alias_hits"))
def tag_any_correct(x: Data) -> DataFrame:
    """Requests with at least one right tag."""
    return tg.any_correct(tg.tags(base.alias_hits(x), "doc_id", "bucket"), x.prompts.select("doc_id", "bucket"), "doc_id", "bucket")


# --- audit reports --------------------------------------------------------------------------------------------------

PARTS["alias_found"] = ("best_alias alias_hits alias gold", f"""SELECT a.doc_id, b.cue, coalesce(total > 0 AND 2 * v >= total AND n_labels <= 2, false) AS echo FROM ({base._ALIAS_RIGHT}) a
  LEFT JOIN (SELECT doc_id, max(weight) AS v, max_by(phrase, (weight, phrase)) AS cue, sum(weight) AS total FROM (SELECT h.* FROM alias_hits h JOIN best_alias b ON b.doc_id = h.doc_id AND b.bucket = h.bucket) GROUP BY doc_id) b USING (doc_id)
  LEFT JOIN (SELECT phrase, count(DISTINCT bucket) AS n_labels FROM alias GROUP BY phrase) r ON r.phrase = b.cue""")


@query(sql("""SELECT CASE WHEN EXISTS (SELECT 1 FROM tasks WHERE list_contains(string_split(cue, ' '), tasks.bucket)) THEN 'label' ELSE 'other' END AS origin, count(*) AS n FROM alias_found WHERE echo GROUP BY 1""", "alias_found tasks"))
def alias_echo_origin(x: Data) -> DataFrame:
    """Right answers that hang on one rare alias, by whether the alias is a label's own surface."""
    table, best = base.aliases(x), rk.best(base.alias_scores(x), "doc_id", "bucket").select("doc_id", "bucket")
    right = best.join(x.gold, "doc_id").where("bucket = gold_bucket").select("doc_id")
    found = ev.dominating(base.alias_hits(x).join(best, ["doc_id", "bucket"]), "doc_id", "phrase", "weight").join(right, "doc_id", "left_semi").where("total > 0 AND 2 * value >= total")
    rare = tg.span(table, ["phrase"], "bucket").where("n_labels <= 2").select(F.col("phrase").alias("cue"))
    return ev.by_origin(found.join(rare, "cue", "left_semi"), x.buckets, "cue", "bucket")


@query(sql("SELECT row_number() OVER (ORDER BY item_id) AS place, item_id FROM offends WHERE offends", "offends"))
def offending_cues(x: Data) -> DataFrame:
    """The cues that the provenance gate refuses, in order.  They are a part of a stated set of items."""
    from pyspark.sql import Window

    return base.provenance_gate(x).where("offends").select(F.row_number().over(Window.orderBy("item_id")).alias("place"), "item_id")


PARTS["echo_rate"] = ("alias_found", f"SELECT {_rate('count_if(echo)', 'count(*)')} AS echo_rate FROM alias_found")
_VERDICT = "SELECT count(*) AS n_cues, CAST(count_if(offends) AS BIGINT) AS n_offending, CASE WHEN count_if(offends) > 0 THEN 'FAIL' ELSE 'PASS' END AS verdict, (SELECT echo_rate FROM echo_rate) AS echo_rate, (SELECT echo_rate FROM echo_rate) > 0.2 AS echo_high FROM offends"


@query(sql(_VERDICT, "offends echo_rate"))
def leak_report(x: Data) -> DataFrame:
    """The verdict, which hangs on provenance alone, and beside it the echo rate and whether it is above its threshold."""
    echo = base.alias_echo_audit(x).select("echo_rate")
    return base.leak_verdict(x).crossJoin(F.broadcast(echo)).withColumn("echo_high", F.col("echo_rate") > ev.ECHO_THRESHOLD)


# --- sinks ----------------------------------------------------------------------------------------------------------


@query(sql(f"""SELECT 'gate' AS exp_id, 'flat' AS predictor, '{{"extra":{{"seed":"1234","set":"documents"}},"metrics":{{"hits":' || count_if(task = gold) || ',"n":' || count(*) || '}}}}' AS json FROM predicted""", "predicted"))
def metrics_record(x: Data) -> DataFrame:
    n = x.predicted.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("task") == F.col("gold")).alias("hits"))
    return sinks.record(n, "gate", "flat", {"set": "documents", "seed": "1234"})


@query(sql("""SELECT '{"rows":{"n":' || (SELECT count(*) FROM documents) || ',"sources":' || (SELECT count(DISTINCT source) FROM documents) || '},"labels":{"quality":' || (SELECT count_if(quality = 1) FROM labels) || '}}' AS json"""))
def audit_sections(x: Data) -> DataFrame:
    """One JSON text with a section for each of two tables."""
    rows = x.docs.agg(F.count(F.lit(1)).alias("n"), F.countDistinct("source").alias("sources"))
    return sinks.sections(rows=rows, labels=x.table("labels").agg(F.count_if(F.col("quality") == 1).alias("quality")))


@query(sql("SELECT lang, count(*) AS n, printf('%.2f%%', round(count(*) / (SELECT count(*) FROM documents), 4) * 100) AS share FROM documents GROUP BY lang"))
def percent_report(x: Data) -> DataFrame:
    total = x.docs.agg(F.count(F.lit(1)).alias("total"))
    n = x.docs.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).crossJoin(F.broadcast(total))
    return sinks.report(n.select("lang", "n", F.round(F.col("n") / F.col("total"), 4).alias("share")), ["share"])
