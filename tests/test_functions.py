"""Text, vector and label functions, constraints, sources, sinks, audits and the request stream."""

from __future__ import annotations

import json
import math

import pytest
from pyspark.sql import functions as F

from siftmark.functions import labels as lb
from siftmark.functions import text as tx
from siftmark.functions import vectors as vf
from siftmark.operators import constraints as cs
from siftmark.operators import evaluation as ev
from siftmark.operators import ranking as rk
from siftmark.operators import tagging as tg
from siftmark.operators import vector as vc
from siftmark.plans.retrieval import LABELS
from siftmark.sources import catalog, sinks
from siftmark.streaming.requests import serve


def one(spark, expr, **cols):
    return spark.createDataFrame([tuple(cols.values())], list(cols)).select(expr.alias("x")).first()["x"] if cols else spark.range(1).select(expr.alias("x")).first()["x"]


TEXT = "The Tiny tiny models of 2024, ON-device; los modelos pequeños!"


@pytest.mark.parametrize("lemmas, want", [
    (tx.A.bag, ["tiny", "tiny", "models", "device", "modelos", "pequeños"]), (tx.C.bag, ["tiny", "tiny", "models", "device", "modelos", "pequeños"]),
    (tx.C.set, ["tiny", "models", "device", "modelos", "pequeños"]), (tx.D.set, ["tiny", "models", "2024", "device", "modelos", "pequeños"]),
    (tx.analyzer_b(lambda x: x.startswith("m")).set, ["models", "modelos"]),
])
def test_analyzers(spark, lemmas, want):
    assert one(spark, lemmas(F.col("t")), t=TEXT) == want


def test_short_lemmas_differ_between_a_and_c(spark):
    assert one(spark, tx.A.bag(F.col("t")), t="ab abc") == ["ab", "abc"]
    assert one(spark, tx.C.bag(F.col("t")), t="ab abc") == ["abc"]


def test_rows_of_lemmas_need_no_exchange(spark):
    df = spark.createDataFrame([(1, "one two two"), (2, None)], "k int, t string")
    rows = tx.C.rows(df, ["k"], "t", distinct=True)
    assert sorted(tuple(r) for r in rows.collect()) == [(1, "one"), (1, "two")]
    assert "Exchange" not in rows._jdf.queryExecution().executedPlan().toString()
    assert sorted(tuple(r) for r in tx.counts(df, "k", "t").collect()) == [(1, "one", 1), (1, "two", 2)]


def test_caps_and_choices(spark):
    assert one(spark, tx.first_sentences(F.col("t"), 2), t="A b. C d! E f?") == "A b. C d!"
    assert one(spark, tx.first_sentences(F.col("t"), 2), t="no end") == "no end"
    assert one(spark, tx.head(F.col("t"), 3), t="abcdef") == "abc"
    assert one(spark, tx.descriptive(F.col("c"), F.col("s")), c=" \n", s="short") == "short"
    assert one(spark, tx.descriptive(F.col("c"), F.col("s")), c=" card ", s="short") == " card "
    assert one(spark, tx.clean_chunk(F.col("a"), F.col("b"), F.col("c")), a="x", b=" ", c="y") == "x y"
    assert one(spark, tx.repaired(F.col("s"), F.col("c")), s="Foo is a great model", c="card") == "card"
    assert one(spark, tx.whitespace_set(F.col("t")), t=" A a\tb ") == ["a", "b"]


def test_key_phrases(spark):
    df = spark.createDataFrame([(1, "Deep models of Speech data. deep models, fast"), (2, ""), (3, None)], "k int, t string")
    got = [(r["k"], r["phrase"], r["ord"]) for r in tx.key_phrases(df, "k", "t").orderBy("ord").collect()]
    assert got == [(1, "Deep models", 1), (1, "Speech data", 2), (1, "fast", 3)]
    assert tx.key_phrases(df, "k", "t", 1).count() == 1


def test_ngrams_of_short_texts(spark):
    df = spark.createDataFrame([(1, "one two three two three"), (2, "one"), (3, None)], "k int, t string")
    assert sorted(r["gram"] for r in tx.ngrams(df, ["k"], "t", 2).collect()) == ["one two", "three two", "two three"]


FAMILIES = {
    "3d": "image-to-3d text-to-3d", "audio": "audio-classification audio-to-audio automatic-speech-recognition text-to-speech voice-activity-detection", "video": "video-classification video-to-video",
    "tabular": "graph-ml tabular-classification tabular-regression time-series-forecasting", "other": "any-to-any feature-extraction multimodal-chat-completion reinforcement-learning robotics",
    "multimodal": "audio-text-to-text image-text-to-image image-text-to-text image-text-to-video image-to-text image-to-video text-to-audio text-to-image text-to-video video-text-to-text visual-question-answering",
    "image": "depth-estimation image-classification image-feature-extraction image-segmentation image-to-image keypoint-detection mask-generation object-detection unconditional-image-generation visual-document-retrieval zero-shot-image-classification zero-shot-object-detection",
}


def test_families_of_all_labels(spark):
    want = {label: f for f, names in FAMILIES.items() for label in names.split()}
    rows = spark.createDataFrame([(x,) for x in LABELS], "l string").select("l", lb.family(F.col("l")).alias("f")).collect()
    assert len(rows) == 56
    assert all(r["f"] == want.get(r["l"], "text") for r in rows)


def test_json_lists(spark):
    rows = spark.createDataFrame([('["a", 1, " "]',), ('{"a": 1}',), ("[broken",), (None,)], "j string")
    assert [r[0] for r in rows.select(lb.json_strings(F.col("j"))).collect()] == [["a", "1"], [], [], []]
    assert rows.limit(1).select(lb.json_strings_only(F.col("j"))).first()[0] == ["a", " "]


def test_vectors(spark):
    v = lambda *x: F.array(*map(F.lit, x)).cast("array<float>")
    assert one(spark, vf.cosine(v(1.0, 0.0), v(0.6, 0.8))) == pytest.approx(0.6)
    assert one(spark, vf.cosine(v(0.0, 0.0), v(1.0, 0.0))) == 0.0
    assert 0.999 < one(spark, vf.dot(vf.unit(v(3.0, 4.0)), vf.unit(v(3.0, 4.0)))) < 1
    corpus = spark.createDataFrame([("a", [1.0, 0.0]), ("a", [0.0, 1.0]), ("b", [2.0, 2.0])], "l string, vector array<float>")
    assert {r["l"]: r["vector"] for r in vc.centroids(corpus, "l").collect()} == {"a": [0.5, 0.5], "b": [2.0, 2.0]}
    assert vf.usable(spark.createDataFrame([([0.0],), ([1.0],)], "v array<float>"), "v").count() == 1


def test_max_mean_similarity(spark):
    p = spark.createDataFrame([(0, [1.0, 0.0]), (0, [0.0, 1.0])], "q int, vector array<float>")
    m = spark.createDataFrame([(7, [1.0, 0.0]), (7, [0.6, 0.8]), (8, [0.0, 0.0])], "c int, vector array<float>")
    assert [tuple(r) for r in vc.max_mean(p, m, "q", "c").collect()] == [(0, 7, 0.9)]


def test_planted_near_duplicate_vectors(spark):
    q = spark.createDataFrame([(0, [1.0, 0.0])], "q int, vector array<float>")
    rows = spark.createDataFrame([(1, [0.99, 0.05]), (2, [0.0, 1.0])], "vec_id int, vector array<float>")
    top = vc.nearest(q, rows, "q", "vec_id", 1).first()
    assert top["vec_id"] == 1 and top["sim"] >= 980_000


ROWS = "id int, open_source boolean, deployable boolean, parameters bigint, context_window bigint, specialties array<string>, task string, likes bigint"


def test_constraints(spark):
    rows = spark.createDataFrame([
        (1, True, True, 1_000_000_000, 32_768, ["multilingual"], "t", 1), (2, False, True, 1_000_000_001, 32_767, ["en"], "t", 2), (3, None, None, None, None, None, "u", None),
    ], ROWS)
    names = ["open_source", "edge", "long_context", "multilingual", "fast", "unheard"]
    got = {r["id"]: r[1:] for r in rows.select("id", *(cs.satisfied(F.lit(n)) for n in names)).collect()}
    assert got == {1: (True,) * 6, 2: (False, False, False, False, True, True), 3: (False, False, False, False, False, True)}


def test_constraint_detection(spark):
    asks = spark.createDataFrame([(1, "a Low Latency and free model", "low latency free model"), (2, "open-source!", "open source"), (3, "on device", "device")], "k int, t string, l string")
    got = sorted(tuple(r) for r in cs.detect(asks, cs.lexicon(spark), "k", "t", "l").collect())
    assert got == [(1, "fast", "soft"), (1, "open_source", "hard"), (3, "edge", "hard")]


def test_hybrid_pick_filters_after_the_cut_and_may_starve(spark):
    rows = spark.createDataFrame([(i, i > 1, True, 1, 1, [], "t", i) for i in range(4)], ROWS)
    cand = spark.createDataFrame([(0, i, 10 - i, i + 1) for i in range(4)], "q int, id int, sparse bigint, rank int")
    none = spark.createDataFrame([], "q int, id int, dense double")
    guess = spark.createDataFrame([(0, "t")], "q int, task string")
    wants = spark.createDataFrame([(0, ["open_source"], ["fast"])], "q int, hard array<string>, soft array<string>")
    pick = lambda **o: [(r["id"], r["score"]) for r in cs.hybrid_pick(cand, rows, none, wants, guess, "q", "id", **o).orderBy("rank").collect()]
    assert pick() == [(2, 0.2), (3, 0.2)]
    assert pick(popular=True) == [(3, 0.2), (2, 0.2)]
    assert pick(sparse_k=2) == []
    assert pick(sparse_k=2, filter_first=True) == [(2, 0.2), (3, 0.2)]


def test_every_request_is_held_to_its_own_constraints(spark):
    rows = spark.createDataFrame([(i, i > 1, i % 2 == 1, 1, 1, [], "t", i) for i in range(4)], ROWS)
    cand = spark.createDataFrame([(q, i, 10 - i, i + 1) for q in range(4) for i in range(4)], "q int, id int, sparse bigint, rank int")
    requests = spark.createDataFrame([(q,) for q in range(5)], "q int")
    named = spark.createDataFrame([(0, "open_source", "hard"), (1, "fast", "soft"), (2, "open_source", "hard"), (2, "edge", "hard"), (3, "long_context", "hard")], "q int, name string, hardness string")
    none, guess = spark.createDataFrame([], "q int, id int, dense double"), spark.createDataFrame([], "q int, task string")
    wants = cs.asked(requests, named, "q")
    assert {r["q"]: (r["hard"], r["soft"]) for r in wants.collect()} == {0: (["open_source"], []), 1: ([], ["fast"]), 2: (["edge", "open_source"], []), 3: (["long_context"], []), 4: ([], [])}
    got = cs.or_abstained(cs.hybrid_pick(cand, rows, none, wants, guess, "q", "id", k=2), requests, "q", "id").orderBy("q", "rank").collect()
    assert [(r["q"], r["id"], r["abstained"]) for r in got] == [(0, 2, False), (0, 3, False), (1, 1, False), (1, 3, False), (2, 3, False), (3, None, True), (4, None, True)]


def test_blocks_of_any_size_give_the_same_neighbours(spark, monkeypatch):
    import random

    r = random.Random(4)
    rows = spark.createDataFrame([(i, [r.choice([-1.0, 0.0, 1.0]) for _ in range(3)], i % 3) for i in range(120)], "vec_id bigint, vector array<float>, label int")
    q = rows.where("vec_id % 10 = 0").select(F.col("vec_id").alias("q"), "vector", F.when(F.col("vec_id") % 20 == 0, F.col("label")).alias("want"))
    find = lambda **o: sorted((x["q"], x["vec_id"], x["label"], x["sim"], x["rank"]) for x in vc.nearest(q, rows, "q", "vec_id", 4, **o).collect())
    options = ({}, {"apart": True}, {"match": ("want", "label"), "apart": True})
    whole, phrases = [find(**o) for o in options], lambda: sorted(map(tuple, vc.max_mean(q.select("q", "vector"), rows.select((F.col("vec_id") % 7).alias("c"), "vector"), "q", "c").collect()))
    means = phrases()
    assert all(a != b for a, b, *_ in whole[1]) and len(whole[0]) == 48
    for one, two in ((5, 17), (1, 40)):
        monkeypatch.setattr(vc, "QUERY_BLOCK", one)
        monkeypatch.setattr(vc, "CORPUS_BLOCK", two)
        assert [find(**o) for o in options] == whole and phrases() == means
    assert find() == sorted(
        (a["q"], b["vec_id"], b["label"], b["sim"], n + 1)
        for a in q.collect()
        for n, b in enumerate(sorted(({"vec_id": b["vec_id"], "label": b["label"], "sim": cos(a["vector"], b["vector"])} for b in rows.collect()), key=lambda b: (-b["sim"], b["vec_id"]))[:4])
    )


def cos(a, b):
    n = math.sqrt(sum(x * x for x in a) * sum(x * x for x in b))
    return round(sum(x * y for x, y in zip(a, b, strict=True)) / n * 1e6) if n else 0


def test_metric_predicates(spark):
    gold = F.array(F.lit("a"), F.lit("b"))
    assert one(spark, ev.in_list_at(F.array(F.lit("b")), gold, 0)) is False
    assert one(spark, ev.in_list_at(F.array(F.lit("c"), F.lit("b")), gold, 2)) is True
    assert one(spark, ev.top1_exact(F.lit("b"), gold)) is False and one(spark, ev.in_list(F.lit("b"), gold)) is True
    assert one(spark, ev.in_list(F.lit(None).cast("string"), gold)) is False
    assert one(spark, ev.covered(F.array(F.lit("x")), F.array().cast("array<string>"))) is True
    far = lambda pred, pb, benign=False: one(spark, ev.far_bucket(F.lit(pred), F.lit(pb), gold, F.lit("A"), F.lit(benign)))
    assert [far("b", "B"), far("c", "B"), far("c", "B", True), far("c", "A")] == [False, True, False, False]


def test_percentiles_and_bootstrap(spark):
    r = ev.percentile_rows(spark.range(1000).select(F.col("id").cast("double").alias("v")), "v").first()
    assert (r["low"], r["high"]) == (25.0, 975.0)
    hits = spark.range(200).select(F.col("id").alias("key"), (F.col("id") % 2).alias("hit"))
    r = ev.bootstrap(hits, 300).first()
    assert 0.40 < r["low"] < 0.48 < 0.52 < r["high"] < 0.60
    assert ev.bootstrap(hits, 50).first() == ev.bootstrap(hits.repartition(5), 50).first()


def test_provenance_and_memorizer(spark):
    cues = spark.createDataFrame([("the of", []), ("known word", ["known", "word"]), ("secret word", ["secret", "word"])], "cue string, lemmas array<string>")
    ok = spark.createDataFrame([("known",), ("word",)], "lemma string")
    assert {r["cue"]: r["offends"] for r in ev.provenance(cues, ok, "cue", "lemmas").collect()} == {"the of": False, "known word": False, "secret word": True}
    prompts = spark.createDataFrame([("p", "a", 1), ("p", "b", 2), ("q", "c", 3)], "prompt string, gold string, ord int")
    assert sorted(tuple(r)[1:] for r in ev.memorised(prompts, "prompt", "gold", "ord").select("prompt", "gold", "answer").collect()) == [("a", "b"), ("b", "b"), ("c", "c")]


def test_echo_report_of_planted_leak(spark):
    right = spark.createDataFrame([(1,), (2,)], "q int")
    parts = spark.createDataFrame([(1, "rare", 90), (1, "x", 10), (2, "x", 10), (2, "y", 10), (2, "z", 10)], "q int, cue string, value bigint")
    r = ev.echo_report(right, ev.dominating(parts, "q", "cue", "value"), F.col("value") >= 50, "q").first()
    assert (r["n_correct"], r["n_dominated"], r["n_echo"], r["echo_rate"], r["fail"], r["median_parts"]) == (2, 1, 1, 0.5, False, 2)


def test_dictionary_tags_need_whole_words(spark):
    asks = spark.createDataFrame([(1, "fast machine translation now"), (2, "machine translations"), (3, None)], "k int, t string")
    terms = spark.createDataFrame([("mt", "machine translation"), ("mt", "fast machine"), ("x", "now")], "label string, phrase string")
    found = tg.hits(asks, terms, "k", "t", (1, 2))
    assert sorted(map(tuple, tg.tags(found, "k", "label").collect())) == [(1, "mt"), (1, "x")]


def test_models_are_cleaned(spark, tmp_path):
    raw = spark.createDataFrame([
        ("m2", '["t", "u"]', "tag", "short", '{"card_text": "card"}', '["d", 1, " "]', "{}", "[bad", 1, None, None, 5, None, 3, "0"),
        ("m1", '["t"]', None, "short", '{"card_text": " "}', None, '["s"]', None, 0, 1, 7, None, 2, 3, "yes"),
    ], catalog.MODELS)
    raw.write.parquet(str(tmp_path / "m"))
    rows = {r["id"]: r for r in catalog.load_models(spark, str(tmp_path / "m")).collect()}
    a, b = rows["m2"], rows["m1"]
    assert (a["task0"], a["task_types"], a["text"], a["domains"], a["specialties"], a["capability_families"]) == ("t", ["t", "u"], "card", ["d", "1"], [], [])
    assert (a["open_source"], a["deployable"], a["parameters"], a["likes"], a["proprietary"]) == (True, False, None, 0, False)
    assert (b["text"], b["specialties"], b["proprietary"]) == ("short", ["s"], False)
    models = catalog.load_models(spark, str(tmp_path / "m"))
    assert [r["id"] for r in catalog.lookup(models, "t", []).collect()] == ["m1", "m2"]
    assert [r["id"] for r in catalog.lookup(models, "t", ["d"]).collect()] == ["m2", "m1"]
    assert [r["label"] for r in catalog.labels(models).collect()] == ["t"]
    assert catalog.link(models, "u/").where("id = 'm1'").first()["url"] == "u/m1"


def test_json_documents_and_dictionaries(spark, tmp_path):
    path = tmp_path / "d.json"
    path.write_text(json.dumps({"_meta": {"label": "x"}, "a": {"label": "A", "description": "first"}, "b": "text"}))
    assert [tuple(r) for r in catalog.descriptions(spark, str(path)).collect()] == [("a", "A first")]
    terms = catalog.dictionary(spark, {"k": [" v ", "v"], "j": {"n": "m"}, "deep": [["no"]]}, "domain")
    assert [r["term"] for r in terms.orderBy("ord").collect()] == ["k", "v", "j", "n", "m", "deep"]


def test_holdout_and_prompts(spark):
    rows = spark.createDataFrame([("i", 'prose {x} then {"task": "t", "classes": null}'), ("i", "no object")], "instruction string, output string")
    got = [r["answer"] for r in catalog.holdout(rows).collect()]
    assert got[0]["task"] == "t" and got[1] is None
    assert catalog.prompt_rows(spark, ["a", "  "]).count() == 1


def test_cached_table_is_built_once(spark, tmp_path):
    calls = []

    def build():
        calls.append(1)
        return spark.range(3)

    path = str(tmp_path / "c")
    assert catalog.cached(spark, path, build).count() == catalog.cached(spark, path, build).count() == 3
    assert calls == [1]


def test_sinks(spark, tmp_path):
    m = spark.createDataFrame([(0.5, 3)], "rate double, n int")
    r = sinks.record(m, "e1", "p", {"k": "v"}).first()
    assert json.loads(r["json"]) == {"extra": {"k": "v"}, "metrics": {"n": 3, "rate": 0.5}}
    path = str(tmp_path / "s")
    kv = lambda v: spark.createDataFrame([("k", v)], "key string, value string")
    for section, v in (("a", "1"), ("b", "2"), ("a", "3")):
        sinks.merge_section(path, section, kv(v))
    assert sorted(tuple(r) for r in spark.read.json(path).select("section", "value").collect()) == [("a", "3"), ("b", "2")]
    assert json.loads(sinks.sections(x=m, y=m).first()["json"]) == {"x": {"rate": 0.5, "n": 3}, "y": {"rate": 0.5, "n": 3}}
    assert sinks.report(m, ["rate"]).first()["rate"] == "50.00%"
    sinks.write_json(m, str(tmp_path / "j"))
    assert spark.read.json(str(tmp_path / "j")).count() == 1


def test_request_stream_gives_what_the_batch_gives(spark, tmp_path):
    postings = spark.createDataFrame([(1, "speech"), (2, "image"), (3, "other")], "row int, lemma string")
    idf = rk.document_frequency(postings, "row")
    source = tmp_path / "in"
    spark.createDataFrame([(0, "speech please"), (1, "image speech")], "id int, text string").write.parquet(str(source))
    out = {}
    stream = serve(spark.readStream.schema("id int, text string").parquet(str(source)), postings, idf, lambda df, n: out.__setitem__(n, sorted((r["id"], r["row"]) for r in df.collect())), str(tmp_path / "cp"))
    stream.processAllAvailable()
    stream.stop()
    assert out[0] == [(0, 1), (1, 1), (1, 2)]


def test_task_documents(spark):
    one_row = lambda p: spark.createDataFrame([("t", p)], "task string, phrase string")
    got = tx.task_phrases(one_row("alias"), one_row("hyp"), one_row("sig")).collect()
    assert sorted((r["kind"], r["phrase"]) for r in got) == [("alias", "alias"), ("hypothesis", "hyp"), ("signal", "sig")]
    rows = spark.createDataFrame([("t", "short", " "), ("t", "", "dom")], "task0 string, d string, s string")
    about = spark.createDataFrame([("t", "about t")], "task string, text string")
    assert sorted(r["text"] for r in tx.task_documents(rows, "task0", ["d", "s"], about).collect()) == ["about t", "dom", "short"]


def test_tables_with_fixed_schemas(spark, tmp_path):
    spark.createDataFrame([(1, "p", ["t"], [], [], None, None)], catalog.PROMPTS).write.parquet(str(tmp_path / "p"))
    assert catalog.load_prompts(spark, str(tmp_path / "p")).first()["expected_task_type"] == ["t"]
    spark.createDataFrame([("a", "t", [1.0])], "id string, task string, vector array<float>").write.parquet(str(tmp_path / "v"))
    assert catalog.vectors(spark, str(tmp_path / "v")).columns == ["id", "task", "vector"]


def test_cue_echo(spark):
    cues = spark.createDataFrame([("alpha", ["alpha"]), ("beta", ["beta"]), ("pha x", ["pha"])], "cue string, lemmas array<string>")
    prompts = spark.createDataFrame([(1, "Alpha x", ["alpha"]), (2, "beta", ["beta"]), (3, "betas beta", ["betas", "beta"])], "q int, text string, lemmas array<string>")
    bound = ev.bindings(cues, prompts, "cue", "q", "text")
    assert sorted(map(tuple, bound.collect())) == [("alpha", 1), ("beta", 2), ("beta", 3), ("pha x", 1)]
    r = ev.cue_echo(bound, prompts, spark.createDataFrame([(1,), (2,)], "q int"), "cue", "q").first()
    assert tuple(r) == (3, 2, 1, 1, 0.5)


def test_a_large_side_is_not_broadcast(spark):
    q = spark.createDataFrame([(i, [1.0, float(i)]) for i in range(5)], "q int, vector array<float>")
    hinted = lambda df: "ResolvedHint" in df._jdf.queryExecution().analyzed().toString()
    assert hinted(rk.small(q, 5)) and not hinted(rk.small(q, 4))
