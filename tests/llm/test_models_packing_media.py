"""op1, op5, op6 and op7."""

from __future__ import annotations

import hashlib
import json
import math
import zlib
from collections import Counter

import numpy as np
import pandas as pd
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from siftmark.llm import op1_quality_classifier as op1
from siftmark.llm import op5_lm_scoring as op5
from siftmark.llm import op6_packing as op6
from siftmark.llm import op7_audio as op7
from siftmark.llm.common import WordHashes

from . import plain

# --- weak labels ----------------------------------------------------------------------------------------------------


def test_label_model_finds_the_accuracies():
    r = np.random.default_rng(1)
    truth = r.random(40_000) < 0.7
    right = [0.95, 0.85, 0.7, 0.6]
    codes = np.zeros(len(truth), int)
    for p in right:
        vote = np.where(r.random(len(truth)) < p, truth, ~truth) + 1
        codes = 3 * codes + np.where(r.random(len(truth)) < 0.3, 0, vote)
    known, counts = np.unique(codes, return_counts=True)
    post, found, prior = op1.label_model(known, counts, 4)
    assert abs(prior - 0.7) < 0.03
    assert np.allclose(found.mean(1), right, atol=0.04)
    assert ((post[np.searchsorted(known, codes)] > 0.5) == truth).mean() > 0.9


def test_scorer_learns_a_telling_word_in_long_texts():
    r = np.random.default_rng(2)
    rows, y = [], []
    for i in range(600):
        bad = i % 5 == 0
        rows.append(np.unique(np.concatenate((r.integers(0, 5000, 300), [200_000 + i % 3] if bad else []))).astype(np.int64))
        y.append(float(bad))
    w, bias = op1.fit(rows, np.array(y), np.ones(600))
    assert ((np.array([w[x].sum() for x in rows]) + bias > 0) == np.array(y, bool)).mean() > 0.97


def test_classifier_on_labels_that_it_has_not_seen(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    model, report = op1.train(docs, labels.where("doc_id % 3 <> 0"))
    got = op1.classify(docs, model).join(labels.where("doc_id % 3 = 0"), "doc_id").collect()
    clean = [r["kept"] for r in got if r["quality"] and not r["toxic"]]
    junk = [r["kept"] for r in got if not r["quality"]]
    assert sum(clean) / len(clean) > 0.97 and sum(junk) / len(junk) < 0.2
    assert min(report["quality"]["right"]["stop_words"][1], report["quality"]["right"]["label"][1]) > 0.95
    insulted = spark.createDataFrame([(1, "You are a stupid idiot and a pathetic loser, you worthless scum of the earth and that is it.")], "doc_id int, text string")
    assert op1.classify(insulted, model).first()["p_toxic"] > 0.5


def test_classifier_of_odd_tables(odd, nothing):
    model, _ = op1.train(odd, None)
    got = op1.classify(odd, model)
    assert got.count() == odd.count() and not [r for r in got.collect() if r["p_quality"] is None or math.isnan(r["p_quality"])]
    empty, _ = op1.train(nothing, None)
    assert op1.classify(nothing, empty).count() == 0 and op1.classify(odd, empty).count() == odd.count()


def test_without_labels_prose_stays_and_insults_go(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    model, _ = op1.train(docs, None)
    got = op1.classify(docs, model).join(labels.where("quality = 1 AND toxic = 0"), "doc_id").collect()
    assert sum(r["kept"] for r in got) / len(got) > 0.97
    texts = ["You are a stupid idiot and a pathetic loser, you worthless scum of the earth and that is it.", "It is on the table with the book that was in the garden of the house, and the sun is out."]
    out = op1.classify(spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string"), model).orderBy("doc_id").collect()
    assert out[0]["p_toxic"] > 0.5 > out[1]["p_toxic"]


def test_an_aspect_of_one_class_gives_the_prior():
    w, bias = op1.fit_aspect([np.array([1, 2]), np.array([2, 3])], np.array([0.1, 0.2]), 0.05)
    assert not w.any() and bias == pytest.approx(math.log(0.05 / 0.95))


def test_the_sample_is_bounded(spark):
    rows = [(None, f"text {i % 900}") for i in range(4000)] + [(7, "the same")] * 3000 + [(i, "a longer text of several words " * 3) for i in range(1000)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(5)
    for most in (40, 500):
        got = op1.sample(docs, docs.count(), most).collect()
        assert 0 < len(got) <= most and len({r["place"] for r in got}) == len(got)
    few = op1.sample(docs, docs.count(), 5000, features=2000).collect()
    assert 0 < sum(r["n"] for r in few) <= 2000 and len(op1.sample(docs, docs.count(), 10**6).collect()) == 1901


def plain_em(votes, rounds=100):
    """EM over single rows of votes (0 abstains, 1 no, 2 yes), not over patterns: each row's posterior of yes."""
    votes = np.array(votes)
    cast = (votes > 0).sum(1)
    post = np.where(cast > 0, (votes == 2).sum(1) / np.maximum(cast, 1), 0.5)
    for _ in range(rounds):
        prior, odds = (post.sum() + 1) / (len(post) + 2), np.zeros(len(post))
        for k in range(votes.shape[1]):
            yes, no = votes[:, k] == 2, votes[:, k] == 1
            hit, miss = (post[yes].sum() + 2) / (post[yes | no].sum() + 3), ((1 - post)[no].sum() + 2) / ((1 - post)[yes | no].sum() + 3)
            odds[yes] += math.log(hit / (1 - miss))
            odds[no] += math.log((1 - hit) / miss)
        post = 1 / (1 + np.exp(-(odds + math.log(prior / (1 - prior)))))
    return post


def test_query_equals_plain_em_and_scorer(spark, sf_dir, documents):
    docs = {r["doc_id"]: r["text"] for r in documents.collect()}
    table = {r["doc_id"]: (r["quality"] + 1, r["toxic"] + 1) for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    order = [r["doc_id"] for r in documents.select("doc_id", F.pmod(F.xxhash64("doc_id", F.xxhash64("text")), F.lit(10**15)).alias("p")).orderBy("p").collect()]
    seen = {i: op1.profile(docs[i]) for i in order}
    memory, score = {}, {}
    rows = [op1.features_of(*seen[i], memory) for i in order]
    for k, aspect in enumerate(op1.ASPECTS):
        votes = [[f(seen[i][0]) for f in aspect.values()] + [table.get(i, (0, 0))[k]] for i in order]
        post = plain_em(votes)
        use = [any(v) if k == 0 else v[-1] > 0 or 2 in v[:-1] for v in votes]
        at = [n for n, u in enumerate(use) if u]
        w, bias = op1.fit([rows[n] for n in at], post[at], np.abs(2 * post[at] - 1))
        score[k] = {i: 1 / (1 + math.exp(-max(-30, min(30, float(w[r].sum()) + bias)))) for i, r in zip(order, rows, strict=True)}
    for r in op1.op1_quality_classifier(spark, sf_dir).collect():
        assert r["p_quality"] == pytest.approx(score[0][r["doc_id"]], abs=1e-3) and r["p_toxic"] == pytest.approx(score[1][r["doc_id"]], abs=1e-3)
        assert r["kept"] == (r["p_quality"] >= 0.5 and r["p_toxic"] < 0.5)


def test_repeated_labels_make_no_rows(spark):
    docs = spark.createDataFrame([(1, "text")], "doc_id bigint, text string")
    labels = spark.createDataFrame([(1, 1, 0), (1, 0, 0), (None, 1, 1)], "doc_id bigint, quality int, toxic int")
    assert [(r["quality_label"], r["toxic_label"]) for r in op1.weak_labels(docs, labels).collect()] == [(op1.NO, op1.NO)]


# --- language model -------------------------------------------------------------------------------------------------


def test_base_scores_equal_a_plain_model(spark, documents):
    texts = {r["doc_id"]: plain.words(plain.lower(r["text"])) + [""] for r in documents.collect()}
    fold = lambda i: zlib.crc32(str(i).encode()) % 5
    count = Counter(w for i, t in texts.items() if fold(i) != 1 for w in t)
    n, v = sum(count.values()), len(count)
    got = op5.score_corpus(documents).collect()
    assert len(got) == len(texts)
    for r in got:
        t = texts[r["doc_id"]]
        assert r["base_score"] == pytest.approx(sum(math.log10((count[w] + 0.5) / (n + 0.5 * (v + 1))) for w in t))
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (fold(r["doc_id"]) == 1, len(t), sum(w in count for w in t), n)
    held = [r for r in got if r["held_out"]]
    assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held)  # the model beats the base where it hasn't learned


def test_scores_equal_a_plain_interpolation(spark, documents, monkeypatch):
    weights = np.array([[0, 0.6, 0.4]] + [[0.5, 0.3, 0.2]] * (op5.BUCKETS - 1))
    monkeypatch.setattr(op5, "learn_weights", lambda evidence: weights)
    monkeypatch.setattr(op5, "CHUNK_BYTES", 50_000)  # many chunks and servers
    monkeypatch.setattr(op5, "SERVER_BYTES", 20_000)
    texts = {r["doc_id"]: plain.words(plain.lower(r["text"])) + [""] for r in documents.collect()}
    train = [t for i, t in texts.items() if zlib.crc32(str(i).encode()) % 5 != 1]
    one, two = Counter(w for t in train for w in t), Counter(p for t in train for p in zip(["", *t], t, strict=False))
    n, v = sum(one.values()), len(one)
    for r in op5.score_corpus(documents).collect():
        want = 0.0
        for u, w in zip(["", *texts[r["doc_id"]]], texts[r["doc_id"]], strict=False):
            a, b, c = weights[1 if one[u] else 0]
            want += math.log10((a * two[u, w] / one[u] if one[u] else 0) + b * one[w] / n + c / (v + 1))
        assert r["score"] == pytest.approx(want)


def test_weights_are_learned_and_make_a_distribution():
    r = np.random.default_rng(0)
    rows = []
    for bucket, lam in ((2, 0.2), (6, 0.8)):
        for _ in range(3000):
            pair = r.random() < lam
            rows.append((bucket, 64 if pair else 0, 40 if r.random() < 0.9 else 0, 1))
    w = op5.learn_weights(pd.DataFrame(rows, columns=["bucket", "pair", "word", "n"]))
    assert np.allclose(w.sum(1), 1) and (w[1:] > 0).all() and w[0, 0] == 0
    assert abs(w[2, 0] - 0.2) < 0.05 and abs(w[6, 0] - 0.8) < 0.05 and np.allclose(w[9], w[6])


def test_a_chunk_sends_no_more_rows_than_keys():
    pdf = pd.DataFrame({"t": ["a b a", "c"], "fold": [0, 0]})
    t = op5.tokens_of(pdf["t"].tolist(), WordHashes())
    few, many = (op5._send((7,), pdf, n) for n in (1, 10**7))
    assert len(few) == 2 and len(many) <= len(t.pair_keys) + len(t.word_keys)
    for sent, n in ((few, 1), (many, 10**7)):
        assert sent["server"].is_monotonic_increasing and sent["server"].is_unique and sent["tokens"].sum() == 6
        keys = [op5._unpack(b).cumsum() for b in sent["keys"]]
        split = int((sent["server"] < n).sum())
        assert np.concatenate(keys[:split]).tolist() == t.pair_keys.tolist() and np.concatenate(keys[split:]).tolist() == t.word_keys.tolist()


def test_packing_of_numbers():
    x = np.array([0, 1, 255, 256, 2**63, 2**64 - 1], np.uint64)
    assert (op5._unpack(op5._pack(x)) == x).all()
    assert len(op5._unpack(op5._pack(x[:0]))) == 0


def test_tokens_of_a_chunk():
    t = op5.tokens_of(["a b a", "", "A"], WordHashes())
    assert t.lengths.tolist() == [4, 1, 2] and len(t.word_keys) == 3 and len(t.pair_keys) == 5  # >a ab ba a> >>
    assert (t.context[t.starts] == t.word[3]).all()


def test_scoring_of_odd_tables(odd, nothing):
    got = op5.score_corpus(odd).collect()
    assert len(got) == odd.count() and all(r["score"] <= 0 and not math.isnan(r["score"]) for r in got)
    assert {r["n_tokens"] for r in got if r["doc_id"] in (3, 4, 5)} == {1}
    assert op5.score_corpus(nothing).count() == 0


def test_evidence_is_held_out_with_its_copies(spark, monkeypatch):
    """A text that stands ten times lends no evidence to itself: its words are unknown to the counts that weights are learned on."""
    seen = []
    monkeypatch.setattr(op5, "learn_weights", lambda e: (seen.append(e), np.full((op5.BUCKETS, 3), 1 / 3))[1])
    dev = next(t for t in (" ".join(f"q{i}x{k}" for k in range(30)) for i in range(200)) if spark.range(1).select((F.pmod(F.xxhash64(F.lit(t)), F.lit(op5.DEV)) == 0).alias("d")).first()["d"])
    rows = [(i, dev) for i in range(10)] + [(100 + i, f"other words {i % 7} of text") for i in range(60)]
    op5.score_corpus(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    copies = sum(zlib.crc32(str(i).encode()) % 5 != 1 for i in range(10))
    assert seen[0][(seen[0]["pair"] == 0) & (seen[0]["word"] == 0)]["n"].sum() >= 29 * copies


# --- packing --------------------------------------------------------------------------------------------------------


@settings(max_examples=80, deadline=None)
@given(st.lists(st.integers(1, 30), max_size=60))
def test_tree_finds_the_first_bin_that_fits(lengths):
    assert list(zip(*op6.first_fit_decreasing(lengths, 30), strict=True)) == plain.first_fit(lengths, 30)


def test_ids_are_those_of_the_tokenizer(documents):
    exact = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    quick = op6.encoder()
    texts = [r["text"] for r in documents.collect()] + ["", "a<|endoftext|>b", "漢字 🙂 ﬁ x\x85y\xa0z", "\x1c \x1f", "".join(map(chr, range(256))), "don't  we'LL\n\n x"]
    for t in texts:
        assert quick(t).tolist() == exact.encode(t, add_special_tokens=False).ids


def test_every_id_lies_in_one_piece_and_sequences_fit(spark, documents):
    places = op6.pack(documents, group=40)
    rows = places.collect()
    encode = op6.encoder()
    by_doc, by_seq = {}, {}
    for r in rows:
        by_doc.setdefault(r["doc_id"], []).append(r)
        by_seq.setdefault(r["sequence_id"], []).append(r)
    for d in documents.collect():
        ids = np.append(encode(d["text"]), 0).astype("<u4")
        at = 0
        for p in sorted(by_doc[d["doc_id"]], key=lambda r: r["start"]):
            assert p["start"] == at and p["doc_tokens"] == len(ids)
            assert p["ids_crc32"] == zlib.crc32(ids[at : at + p["length"]].tobytes())
            at += p["length"]
        assert at == len(ids)
    for s in by_seq.values():
        at = 0
        for p in sorted(s, key=lambda r: r["offset"]):
            assert p["offset"] == at
            at += p["length"]
        assert at <= 1024
    total = sum(r["length"] for r in rows)
    assert total / (len(by_seq) * 1024) > 0.9  # 200 documents in 5 groups: the last sequence of each isn't full
    laid = {r["sequence_id"]: r for r in op6.sequences(documents, places).collect()}
    assert set(laid) == set(by_seq)
    one = next(iter(by_seq.values()))
    d = documents.where(f"doc_id = {one[0]['doc_id']}").first()
    ids = np.append(encode(d["text"]), 0)[one[0]["start"] :][: one[0]["length"]]
    got = laid[one[0]["sequence_id"]]["input_ids"]
    assert got[one[0]["offset"] :][: len(ids)] == ids.tolist()
    assert all(len(r["input_ids"]) == 1024 or r["n_tokens"] == len(r["input_ids"]) and r["n_tokens"] & (r["n_tokens"] - 1) == 0 for r in laid.values())


@settings(max_examples=400, deadline=None)
@given(st.text(st.characters(max_codepoint=255), max_size=80) | st.text(st.sampled_from(" \n\t'sS1aé\xa0<|."), max_size=200))
def test_ids_of_latin_1_texts_are_those_of_the_tokenizer(text):
    assert op6.encoder()(text).tolist() == op6.encoder(ranks=None)(text).tolist()


def test_sequences_of_repeated_rows_and_null_ids(odd):
    places = op6.pack(odd, group=50)
    laid = op6.sequences(odd, places).collect()
    assert sum(r["n_tokens"] for r in laid) == sum(r["length"] for r in places.collect())
    assert len({r["sequence_id"] for r in laid}) == len(laid)


def test_packing_of_odd_tables(odd, nothing):
    got = op6.pack(odd).collect()
    assert Counter(r["doc_id"] for r in got if r["start"] == 0) == Counter(r["doc_id"] for r in odd.collect())
    assert {r["length"] for r in got if r["doc_id"] in (3, 4)} == {1}
    assert op6.pack(nothing).count() == 0


# --- audio ----------------------------------------------------------------------------------------------------------


def test_samples_come_back(spark, documents):
    for r in op7.encode_media(documents).join(documents, "doc_id").collect():
        raw = r["text"].encode()
        back = op7.decode_wav(r["media"])
        assert back[: len(raw)] == raw and not any(back[len(raw) :]) and len(back) % 64 == 0 and len(back) - len(raw) < 64


def test_digest_columns(spark, sf_dir, documents):
    texts = {r["doc_id"]: r["text"] for r in documents.collect()}
    got = op7.op7_audio(spark, sf_dir).collect()
    for r in got:
        raw = texts[r["doc_id"]].encode()
        payload = raw.ljust(max(64, -(-len(raw) // 64) * 64), b"\0")
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"]) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest())
        assert r["tail_crc32"] == zlib.crc32(payload[-64:]) and r["media_bytes"] == len(op7.encode_wav(payload)) and r["media_sha256"] == hashlib.sha256(op7.encode_wav(payload)).hexdigest()
    same = {}
    for r in got:
        same.setdefault(texts[r["doc_id"]], set()).add(r["feature"])
    assert all(len(x) == 1 for x in same.values()) and len({r["feature"] for r in got}) > 100


def test_resampling_equals_a_direct_filter():
    x = np.random.default_rng(0).standard_normal(500).astype(np.float32)
    up, down = 5, 8
    width = op7.HALF * max(up, down)
    t = np.arange(-width, width + 1)
    h = np.sinc(t / max(up, down)) / max(up, down) * np.hanning(2 * width + 3)[1:-1] * up
    full = np.convolve(np.concatenate([np.concatenate(([v], np.zeros(up - 1))) for v in x]), h)[width:]
    want = full[: len(x) * up : down]
    assert np.allclose(op7.resample(x)[: len(want)], want, atol=1e-4)


@pytest.mark.parametrize("hertz", [300, 1000, 3000])
def test_tones_peak_in_their_band(hertz):
    x = np.sin(2 * np.pi * hertz * np.arange(16_000) / op7.RATE_IN).astype(np.float32)
    y = op7.resample(x)
    assert abs(len(y) - 10_000) <= 1
    mels, _ = op7.log_mel(y)
    assert mels.mean(0).argmax() == (op7._mel()[round(hertz * op7.FFT / op7.RATE_OUT)]).argmax()
    high = np.sin(2 * np.pi * 7000 * np.arange(16_000) / op7.RATE_IN).astype(np.float32)  # above what the new rate holds
    assert np.abs(op7.resample(high)[200:-200]).max() < 0.1


def test_segments_have_hysteresis():
    e = np.array([0, 0, 5, 0.5, 0.5, 5, 0, 0, 0.5, 0, 0, 0])
    assert op7.segments(e, 1.0, 0.25) == [(2, 6)]
    assert op7.segments(np.zeros(4)) == []
    assert op7.segments(np.array([9.0, 0, 0, 0, 9.0])) == [(0, 1), (4, 5)]


def test_tensors_have_fixed_shape_and_spans(spark, documents):
    pdf = op7.audio_features(op7.encode_media(documents.limit(5))).toPandas()
    table = op7.tensor_table(pdf)
    assert table.schema.field("tensor").type.shape == [op7.PATCH, op7.MELS]
    assert table.num_rows == sum(-(-n // op7.PATCH) for n in pdf["n_frames"])
    ends = {}
    for i, a, b in zip(table["doc_id"].to_pylist(), table["start_ms"].to_pylist(), table["end_ms"].to_pylist(), strict=True):
        assert a % 640 == 0 and 0 < b - a <= 640
        ends[i] = max(b, ends.get(i, 0))
    assert ends == {i: -(-n * 1000 // op7.RATE_IN) for i, n in zip(pdf["doc_id"], pdf["payload_bytes"], strict=True)}  # with the sound
    assert op7.tensor_table(pdf.iloc[:0]).num_rows == 0


def test_query_equals_a_plain_version(spark, sf_dir, documents):
    """The whole feature string, from tensors that were stored and read again."""
    texts = {r["doc_id"]: r["text"] for r in documents.collect()}
    for r in op7.op7_audio(spark, sf_dir).collect():
        raw = texts[r["doc_id"]].encode()
        payload = raw.ljust(max(64, -(-len(raw) // 64) * 64), b"\0")
        mels, energy = op7.log_mel(op7.resample((np.frombuffer(payload, np.uint8).astype(np.float32) - 128) / 128))
        fixed = np.concatenate([mels, np.full((-len(mels) % op7.PATCH, op7.MELS), np.log(np.float32(1e-6)), np.float32)])
        got = json.loads(r["feature"])
        assert got["mel_crc32"] == zlib.crc32(fixed.astype("<f4").tobytes()) and got["n_frames"] == len(mels)
        assert got["segments"] == [{"start_ms": 10 * a, "end_ms": 10 * b} for a, b in op7.segments(energy)]
        assert got["end_ms"] == -(-len(payload) * 1000 // op7.RATE_IN) and np.allclose(got["mean_mel"], mels.mean(0), atol=0.006)


def test_cells_hold_tensors_of_any_number():
    for n in (1, 64, 65, 200):
        mels = np.random.default_rng(n).standard_normal((n, op7.MELS)).astype(np.float32)
        back = op7.mel_of(op7.pack_tensors(mels, n * 160))
        assert back.shape == (-(-n // op7.PATCH), op7.PATCH, op7.MELS) and (back.reshape(-1, op7.MELS)[:n] == mels).all()


def test_audio_of_odd_tables(odd, nothing):
    got = op7.audio_features(op7.encode_media(odd)).collect()
    assert len(got) == odd.count() and all(r["payload_bytes"] == 64 for r in got if r["doc_id"] in (3, 4, 5))
    assert op7.audio_features(op7.encode_media(nothing)).count() == 0
