"""Near copies against the Jaccard similarity of all pairs."""

import random

import pytest

from patronage.llm import near
from tests.llm.test_simhash import groups, partition_of


def shingle_set(text, words=5):
    parts = text.lower().split()
    return {tuple(parts[i:i + words]) for i in range(max(1, len(parts) - words + 1))} if parts else set()


def jaccard(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def corpus(seed):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(300)]
    texts = []
    for _ in range(12):
        base = rng.choices(words, k=rng.choice([3, 12, 40, 120, 400]))
        for _ in range(10):
            copy = list(base)
            for _ in range(rng.randint(0, max(1, len(copy) // 25))):
                copy[rng.randrange(len(copy))] = rng.choice(words)
            texts.append(" ".join(copy[rng.randint(0, len(copy) // 20):]))
    return list(enumerate([*texts, "", " \n", None, texts[0].upper()]))


@pytest.mark.parametrize("chunk", [2048, 3])
def test_against_jaccard_of_all_pairs(spark, docs_frame, monkeypatch, chunk):
    monkeypatch.setattr(near.candidates, "__defaults__", (chunk,))
    rows = corpus(chunk)
    own = {d: shingle_set(t or "") for d, t in rows}
    ids = sorted(own)
    close = [(a, b) for a in ids for b in ids if a < b and jaccard(own[a], own[b]) >= 0.8]
    want = groups(close, ids)
    from patronage.llm.simhash import fingerprint
    texts = dict(rows)
    far = [(a, b) for a, b in close if (fingerprint(texts[a] or "") ^ fingerprint(texts[b] or "")).bit_count() > 3]
    assert far  # three bits of 64 miss these
    docs = docs_frame(rows)
    got = {r["doc_id"]: r["component"] for r in near.near_copies(docs).collect()}
    assert partition_of(got) == partition_of(want)
    assert {r["doc_id"] for r in near.deduplicate(docs).collect()} == set(want.values())


def test_edge_documents(edge, empty):
    assert sorted((r["doc_id"] for r in near.deduplicate(edge).collect()), key=lambda d: (d is None, d or 0)) == [1, 2, 5, 6, 8, 9, None]
    assert near.deduplicate(edge).columns == edge.columns
    assert near.deduplicate(empty).count() == 0


def test_copies_without_ids_are_one_group(docs_frame):
    rows = [(None, "one two three four five six"), (None, "one two three four five six"), (None, "alone in this table of rows"), (None, "alone in this table of rows"),
            (4, "one two three four five six"), (4, "one two three four five six")]
    got = sorted(((r["doc_id"], r["text"]) for r in near.deduplicate(docs_frame(rows)).collect()), key=str)
    assert got == [(4, "one two three four five six"), (None, "alone in this table of rows")]
