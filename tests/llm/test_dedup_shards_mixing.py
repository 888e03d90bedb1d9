"""op2, op3 and op8."""

from __future__ import annotations

import random
from collections import Counter
from math import log

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from siftmark.llm import op2_near_dedup as op2
from siftmark.llm import op3_sharding as op3
from siftmark.llm import op8_mixing as op8
from siftmark.llm.common import WordHashes
from siftmark.llm.components import components

from . import plain


def near_copies(seed=3, n=60):
    """Copies of one text with a few words changed, exact copies, a chain, and others."""
    r = random.Random(seed)
    base = [f"w{r.randrange(10**6)}" for _ in range(150)]
    rows = []
    for i in range(n):
        w = base[:]
        for _ in range(r.choice([0, 0, 1, 1, 2, 3, 5])):
            w[r.randrange(150)] = f"x{r.randrange(10**6)}"
        rows.append((1000 - i, " ".join(w).title() if i % 7 == 0 else " ".join(w)))
    chain = [f"c{k}" for k in range(200)]
    rows += [(2000 + k, " ".join(chain[4 * k : 4 * k + 120])) for k in range(15)]
    return rows + [(3000, "a b"), (3001, "A  b"), (3002, ""), (3003, None), (3004, "a b c")]


def check(spark, rows):
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = op2.near_duplicates(df).collect()
    assert {r["doc_id"]: r["component_id"] for r in got} == plain.components(rows)
    sets = {i: plain.shingles(t) for i, t in rows}
    assert all(r["n_shingles"] == len(sets[r["doc_id"]]) and r["kept"] == (r["doc_id"] == r["component_id"]) for r in got)


def test_components_equal_exact_ones(spark, documents):
    check(spark, [(r["doc_id"], r["text"]) for r in documents.collect()])


def test_near_copies(spark):
    check(spark, near_copies())


def test_blocks_lose_no_link(spark, monkeypatch):
    monkeypatch.setattr(op2, "SKETCH_BLOCK", 7)
    monkeypatch.setattr(op2, "TEXT_BLOCK", 700)  # shingles: about five texts
    check(spark, near_copies(5))


def test_near_dedup_of_odd_tables(odd, nothing):
    got = {(r["doc_id"], r["n_shingles"], r["component_id"]) for r in op2.near_duplicates(odd).collect()}
    assert {(3, 0, 3), (4, 0, 4), (5, 0, 5), (8, 1, 7), (None, 0, None)} <= got and op2.near_duplicates(odd).count() == odd.count()
    kept = op2.near_dedup(odd)
    assert kept.columns == odd.columns
    ids = Counter(r["doc_id"] for r in kept.collect())
    assert not ids[2] and not ids[8] and ids[7] == 2 and ids[1] == ids[3] == ids[4] == ids[5] == 1
    texts = Counter((r["doc_id"], r["text"]) for r in kept.collect())
    assert set(texts.values()) == {1} and ids[None] == 3  # no exact copy is left, of null ids neither
    assert op2.near_duplicates(nothing).count() == 0


def test_near_copies_without_ids_become_one(spark):
    words = [f"w{i}" for i in range(100)]
    rows = [(None, " ".join(words)), (None, " ".join([*words, "x"])), (None, " ".join([*words, "x"])), (5, "other text"), (None, "one"), (None, "one")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert sorted((r["doc_id"] or 0, r["text"][:5]) for r in op2.near_dedup(df).collect()) == [(0, "one"), (0, "w0 w1"), (5, "other")]
    df = df.unionByName(spark.createDataFrame([(9, " ".join(["y", *words]))], df.schema))
    assert sorted((r["doc_id"] or 0, r["text"][:5]) for r in op2.near_dedup(df).collect()) == [(0, "one"), (5, "other"), (9, "y w0 ")]


def test_sketches_estimate_similarity():
    h = WordHashes()
    base = [f"t{i}" for i in range(2000)]
    for changed in (0, 20, 60, 100):
        other = base[:]
        for k in range(changed):
            other[k * 20] = f"u{k}"
        a, b = (op2.shingles(" ".join(w), h) for w in (base, other))
        true = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
        differ = np.unpackbits(op2.odd_sketch(op2.minhashes(a)) ^ op2.odd_sketch(op2.minhashes(b))).sum()
        assert abs(op2.similarity(np.array([differ]))[0] - true) < 0.15


def test_shingles_are_those_of_a_plain_version():
    for t in ("A b c D e f", "one two", "É é a b c d", "x y a b c d e", "a a a a a a a", ""):
        assert len(op2.shingles(t, WordHashes())) == len(plain.shingles(t))


def test_components_of_paths_and_stars(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, k) for k in range(101, 120)] + [(7, 7)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "a int, b int")).collect()}
    assert got == {**dict.fromkeys(range(41), 0), **dict.fromkeys(range(100, 120), 100)}
    assert components(spark.createDataFrame([], "a int, b int")).count() == 0


# --- shards -------------------------------------------------------------------------------------------------------


def draw(key, path, weight):
    seed = 42 if key is None else xxhash.xxh64_intdigest(key.to_bytes(8, "little", signed=True), seed=42)
    h = xxhash.xxh64_intdigest(path.encode(), seed=seed)
    return -log(((h >> 11) + 0.5) / 2**53) / weight


def place(key, node, path=""):
    while node.children:
        _, node, path = min((draw(key, f"{path}/{c.name}", c.weight), c, f"{path}/{c.name}") for c in node.children)
    return node.shard


def test_places_equal_a_plain_descent(spark, sf_dir):
    got = op3.op3_sharding(spark, sf_dir).collect()
    assert all(r["shard"] == place(r["doc_id"], op3.tree(24)) and r["grown_shard"] == place(r["doc_id"], op3.tree(25)) for r in got)


@pytest.mark.parametrize("n", [24, 25, 30])
def test_one_more_shard_takes_rows_only_into_itself(n):
    for key in range(4000):
        a, b = place(key, op3.tree(n)), place(key, op3.tree(n + 1))
        assert a == b or b == n


def test_weights_are_met_and_movement_is_confined():
    leaf = lambda s, w=1: op3.Node(f"shard{s}", shard=s, own_weight=w)
    old = op3.Node("root", (op3.Node("r0", (op3.Node("k0", (leaf(0), leaf(1))), op3.Node("k1", (leaf(2),)))), op3.Node("r1", (op3.Node("k0", (leaf(3), leaf(4, 3))),))))
    new = op3.Node("root", (old.children[0], op3.Node("r1", (op3.Node("k0", (leaf(3), leaf(4, 5))),))))
    n = Counter(place(k, old) for k in range(20_000))
    assert all(abs(n[s] / 20_000 - w / 7) < 0.02 for s, w in {0: 1, 1: 1, 2: 1, 3: 1, 4: 3}.items())
    moved = Counter((place(k, old) in (3, 4), place(k, new) in (3, 4)) for k in range(20_000) if place(k, old) != place(k, new))
    assert not moved[True, False] and not moved[False, False]


def test_shards_of_documents(spark, sf_dir, documents):
    got = op3.op3_sharding(spark, sf_dir).collect()
    sizes = {r["doc_id"]: len(r["text"].encode()) + 8 for r in documents.collect()}
    assert {r["doc_id"]: r["size"] for r in got} == sizes
    for s in range(24):
        slots = sorted(r["slot"] for r in got if r["shard"] == s)
        assert slots == list(range(len(slots)))


def test_shards_of_odd_tables(spark, odd, nothing, tmp_path):
    assert op3.assign(odd, op3.tree(24)).count() == odd.count()
    op3.write_sharded(odd.drop("shard"), op3.tree(24), str(tmp_path / "s"))
    assert spark.read.parquet(str(tmp_path / "s")).count() == odd.count()
    assert op3.assign(nothing, op3.tree(24)).count() == 0


# --- mixing -------------------------------------------------------------------------------------------------------

parts_of = st.dictionaries(st.sampled_from("abcdefg"), st.integers(1, 12), min_size=1)


@settings(max_examples=60, deadline=None)
@given(parts_of)
def test_blocks_meet_their_windows(parts):
    total = sum(parts.values())
    slots = op8.period_of(parts)
    assert sorted(s for x in slots.values() for s in x) == list(range(total))
    for p, n in parts.items():
        for j, s in enumerate(slots[p]):
            assert j * total // n <= s < -(-(j + 1) * total // n)
        for t in range(total + 1):  # less than one block from the share, at any time
            assert abs(sum(s < t for s in slots[p]) - t * n / total) < 1


@settings(max_examples=40, deadline=None)
@given(parts_of, st.dictionaries(st.sampled_from("abcdefg"), st.integers(0, 40)))
def test_schedule_places_every_block_once(parts, blocks):
    blocks = {p: n for p, n in blocks.items() if p in parts}
    taken = {}
    for p in op8.schedule(blocks, parts):
        for j in range(p.first, p.last + 1):
            k = j - p.first
            taken[p.slot + k // len(p.offsets) * p.period + p.offsets[k % len(p.offsets)]] = (p.pool, j)
    assert sorted(taken) == list(range(sum(blocks.values())))
    assert sorted(taken.values()) == sorted((p, j) for p, n in blocks.items() for j in range(n))
    for p in blocks:
        order = [taken[s][1] for s in sorted(taken) if taken[s][0] == p]
        assert order == sorted(order)


def test_mixture_holds_its_weights_until_a_source_ends(spark):
    rows = [(i, "a" if i % 3 else "b") for i in range(3000)]
    df = spark.createDataFrame(rows, "doc_id bigint, source string")
    got = op8.mix(df, {"a": 1, "b": 2}, block=10).orderBy("__position").collect()
    assert [r["__position"] for r in got] == list(range(3000))
    for upto in range(10, 1500, 10):
        b = sum(r["source"] == "b" for r in got[:upto])
        assert abs(b - upto * 2 / 3) < 10


def test_mixing_of_odd_tables(odd, nothing):
    got = op8.mixed(odd, block=2)
    assert got.columns == odd.columns and got.count() == odd.count()
    assert sorted(r["__position"] for r in op8.mix(odd, block=2).collect()) == list(range(odd.count()))
    assert op8.mixed(nothing).count() == 0
    with pytest.raises(ValueError):
        op8.period_of({"a": op8.MOST_PARTS + 1})
    with pytest.raises(ValueError):
        op8.mix(odd, {"src0": 1}, rest=0)


def test_mixing_without_python(spark, sf_dir):
    plan = op8.op8_mixing(spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Cartesian" not in plan
