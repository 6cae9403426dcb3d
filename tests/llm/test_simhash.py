import random

import numpy as np
import pytest
import xxhash

from patronage.llm import simhash
from patronage.llm.common import read
from patronage.llm.graph import components


def slow_fingerprint(text, words=3):
    parts = []
    for w in "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text).replace("\t", " ").replace("\n", " ").replace("\x0b", " ").replace("\x0c", " ").replace("\r", " ").split(" "):
        if w:
            parts.append(w)
    if not parts:
        return 0
    shingles = [" ".join(parts[i:i + words]) for i in range(max(1, len(parts) - words + 1))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


@pytest.mark.parametrize("text", ["", " \n", "One", "one TWO", "a b c", "a b c d É É é x y z a b c", "\x85 nbsp\xa0stays \x1c one", "w " * 500])
def test_fingerprint(text):
    assert simhash.fingerprint(text) & (2**64 - 1) == slow_fingerprint(text)


def groups(links, nodes):
    up = {n: n for n in nodes}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in links:
        a, b = root(a), root(b)
        up[max(a, b)] = min(a, b)
    return {n: root(n) for n in nodes}


def partition_of(labels):
    out = {}
    for node, label in labels.items():
        out.setdefault(label, set()).add(node)
    return sorted(sorted(g) for g in out.values())


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_components(spark, seed):
    rng = random.Random(seed)
    links = [(rng.randint(0, 60), rng.randint(0, 60)) for _ in range(45)] + [(100 + i, 101 + i) for i in range(30)] + [(200, i) for i in range(201, 240)] + [(7, 7)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    nodes = {x for a, b in links if a != b for x in (a, b)}
    want = groups([(a, b) for a, b in links if a != b], nodes)
    assert set(got) == nodes and partition_of(got) == partition_of(want)
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


@pytest.mark.parametrize("chunk, pivots", [(2048, 16), (4, 3)])
def test_links_against_all_pairs(spark, chunk, pivots):
    rng = random.Random(chunk)
    centres = [rng.getrandbits(64) for _ in range(12)] + [0]
    values = set(centres)
    for c in centres:
        for _ in range(25):
            v = c
            for b in rng.sample(range(64), rng.randint(1, 5)):
                v ^= 1 << b
            values.add(v)
    fps = np.array(sorted(values), dtype=np.uint64)
    signed = fps.view(np.int64).tolist()
    distinct = spark.createDataFrame([(v, 0) for v in signed], "fp long, least long")
    close = [(signed[i], signed[j]) for i in range(len(fps)) for j in range(i) if np.bitwise_count(fps[i] ^ fps[j]) <= 3]
    found = [(r["a"], r["b"]) for r in simhash.links(distinct, chunk=chunk, n_pivots=pivots).collect()]
    real = set(close) | {(b, a) for a, b in close}
    assert set(found) <= real
    assert partition_of(groups(found, signed)) == partition_of(groups(close, signed))


def test_edge_documents(edge, empty):
    got = {(r["doc_id"], r["fingerprint"], r["component_id"]) for r in simhash.near_groups(edge).collect()}
    by_id = {d: (f, c) for d, f, c in got}
    assert simhash.near_groups(edge).count() == 12
    assert by_id[2] == by_id[3] == by_id[4] == by_id[10] == ("0" * 16, 2)
    assert by_id[1] == by_id[7] and by_id[7][1] == 1
    assert by_id[None][1] is None
    assert simhash.near_groups(empty).count() == 0


def test_whole_table_against_all_pairs(spark):
    docs = read(spark, "/root/testdata/sf0.001", "documents")
    got = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in simhash.near_groups(docs).collect()}
    fps = {r["doc_id"]: slow_fingerprint(r["text"] or "") for r in docs.collect()}
    ids = sorted(fps)
    want = groups([(a, b) for a in ids for b in ids if a < b and (fps[a] ^ fps[b]).bit_count() <= 3], ids)
    assert got == {d: (f"{fps[d]:016x}", want[d]) for d in ids}
