"""The mixture's order as it reaches the packed sequences."""

from __future__ import annotations

from collections import Counter, defaultdict

import pytest

import corpus_pipeline
from siftmark.llm import op6_packing as op6
from siftmark.llm import op8_mixing as op8

from . import plain

GROUP = op6.GROUP


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, "word " * (i * 7919 % 40) + "end", "src0" if i % 9 == 0 else "src4") for i in range(2 * GROUP + 2000)]
    return spark.createDataFrame(rows, "doc_id bigint, text string, source string")


def test_sequences_hold_the_sources_in_their_shares(spark, sf_dir, docs):
    mixed = corpus_pipeline.mixing(spark, docs, sf_dir)
    packed = [r for r in corpus_pipeline.packing(spark, mixed, sf_dir).collect() if r["start"] == 0]
    source = {r["doc_id"]: r["source"] for r in docs.collect()}
    position = {r["doc_id"]: r["__position"] for r in op8.mix(docs).collect()}
    groups = defaultdict(list)
    for r in packed:
        groups[r["sequence_id"] >> 32].append(r["doc_id"])
    assert sorted(groups) == [0, 1, 2] and sorted(i for g in groups.values() for i in g) == sorted(source)
    for g, ids in groups.items():
        assert sorted(position[i] for i in ids) == list(range(g * GROUP, min((g + 1) * GROUP, len(source))))
    # one part to five; src0 has 1,133 documents, enough for the first group
    n = Counter(source[i] for i in groups[0])
    assert abs(n["src0"] - GROUP / 6) < op8.BLOCK and abs(n["src4"] - GROUP * 5 / 6) < op8.BLOCK


def test_ranges_are_packed_as_by_a_plain_first_fit(spark, documents):
    placed = op8.mix(op6.cut_documents(documents, ["source"]), block=4)
    position = {r["doc_id"]: r["__position"] for r in placed.collect()}
    got, old = op6.pack_ranges(placed, "__position", group=50).collect(), op6.pack(documents).collect()
    names = [c.split()[0] for c in op6.PIECES.split(", ")]
    assert sorted(tuple(r[c] for c in names) for r in got) == sorted(tuple(r[c] for c in names) for r in old)
    groups, least = defaultdict(list), {}
    for r in got:
        groups[r["sequence_id"] >> 32].append(r)
        least[r["sequence_id"]] = min(position[r["doc_id"]], least.get(r["sequence_id"], 10**9))
    for g, rows in groups.items():
        rows.sort(key=lambda r: (position[r["doc_id"]], r["start"]))
        assert {position[r["doc_id"]] // 50 for r in rows} == {g}
        want = plain.first_fit([r["length"] for r in rows], op6.LENGTH)
        number = {b: n for n, b in enumerate(dict.fromkeys(b for b, _ in want))}
        assert [(r["sequence_id"] - (g << 32), r["offset"]) for r in rows] == [(number[b], o) for b, o in want]
    assert [least[s] for s in sorted(least)] == sorted(least.values())
