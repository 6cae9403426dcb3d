"""Vector searches against brute force."""

import numpy as np
import pytest

from patronage.llm import ann, topk, vectors
from patronage.llm.common import read

SF = "/root/testdata/sf0.01"
ODD = [(50, [1.0, 0.5, 0.25]), (1, [1.0, 0.5, 0.25]), (2, [1.0, 0.5, 0.25]), (3, None), (4, []), (5, [0.0, 0.0, 0.0]), (6, [1.0, None, 2.0]),
       (7, [float("nan"), 1.0, 1.0]), (8, [float("inf"), 1.0, 1.0]), (None, [1.0, 1.0, 1.0]), (9, [-1.0, 0.5, 3.0]), (9, [-1.0, 0.5, 3.0]),
       (10, [1.0, 2.0]), (100, [1.0, 1.0]), (150, [5.0])]


def frame(spark, rows):
    return spark.createDataFrame([(i, x, 0, "q", 1.5) for i, x in rows], "vec_id long, embedding array<double>, label int, x string, score double")


def usable(rows, zero):
    out = {}
    for i, x in rows:
        if i is not None and x and all(v is not None and np.isfinite(v) for v in x) and (zero or any(x)):
            out[i] = x
    return out


def slow(rows, score, zero, k=5):
    own = usable(rows, zero)
    out = []
    for q in own:
        if q % 50 == 0:
            found = sorted(((-score(own[q], own[v]), v) for v in own if v != q and len(own[v]) == len(own[q])))[:k]
            out += [(q, n, v, -s) for n, (s, v) in enumerate(found, 1)]
    return sorted(out)


def product(a, b):
    return sum(int(np.floor(256 * x)) * int(np.floor(256 * y)) for x, y in zip(a, b))


def cosine(a, b):
    a, b = np.array(a), np.array(b)
    return float(a @ b / np.linalg.norm(a) / np.linalg.norm(b))


def test_odd_vectors(spark):
    table = frame(spark, ODD)
    assert sorted(tuple(r) for r in topk.top_products(table).collect()) == slow(ODD, product, True)
    got, want = sorted(tuple(r) for r in ann.neighbours(table).collect()), slow(ODD, cosine, False)
    assert [g[:3] for g in got] == [w[:3] for w in want]
    assert np.allclose([g[3] for g in got], [w[3] for w in want], atol=1e-15)
    none = frame(spark, [])
    assert topk.top_products(none).count() == ann.neighbours(none).count() == 0


def test_products_beyond_doubles(spark):
    rows = [(50, [3.0e10, 1.0, -2.0]), (1, [1.0e3, 1.0, 1.0]), (2, [1.0e3, 1.0, 1.00390625]), (3, [-1.0e3, 7.0, 1.0])]
    assert sorted(tuple(r) for r in topk.top_products(frame(spark, rows)).collect()) == slow(rows, product, True)


@pytest.mark.parametrize("shape", ["flat", "clustered", "copies"])
def test_dual_tree_is_exact(shape):
    rng = np.random.default_rng(1)
    x = rng.integers(-300, 300, (600, 8)).astype(float)
    if shape == "clustered":
        x = (x[rng.integers(0, 6, 600)] * 10 + rng.integers(-9, 9, (600, 8))).astype(float)
    if shape == "copies":
        x[100:500] = x[0]
    q, ids, query_ids = x[:120] * 2, np.arange(600) * 3 + 1, np.arange(120) * 3 + 1
    got = topk.search(query_ids, q, ids, x, 5)
    products = (q @ x.T).astype(int)
    want = []
    for i in range(120):
        order = [j for j in np.lexsort((ids, -products[i])) if ids[j] != query_ids[i]][:5]
        want += [(query_ids[i], ids[j], products[i, j]) for j in order]
    assert list(zip(*(c.tolist() for c in got))) == want


def test_cover_tree_covers():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(500, 5)) * rng.choice([0.01, 1, 50], 500)[:, None]
    seen = []

    def walk(node):
        assert (np.linalg.norm(x[node.points] - node.centre, axis=1) <= node.radius * (1 + 1e-9) + 1e-12).all()
        for c in node.children:
            walk(c)
        if not node.children:
            seen.extend(node.points.tolist())

    walk(topk.cover_tree(x))
    assert sorted(seen) == list(range(500))


def test_trees_skip_pairs():
    rng = np.random.default_rng(3)
    x = (rng.integers(-5, 5, (2000, 6)) + np.repeat(rng.integers(-500, 500, (20, 6)), 100, axis=0)).astype(float)
    best = topk.Best(x[::50], np.arange(0, 2000, 50), x, np.arange(2000), 5)
    pairs = []
    real = best.see
    best.see = lambda rows, points: (pairs.append(len(rows) * len(points)), real(rows, points))
    topk.dual_search(topk.cover_tree(x[::50]), [topk.cover_tree(x)], best)
    assert sum(pairs) < 0.5 * 40 * 2000


def test_recall_and_blocks(spark, monkeypatch):
    table = read(spark, SF, "embeddings")
    rows = [(r["vec_id"], r["embedding"]) for r in table.collect()]
    want = slow(rows, cosine, False)
    for block, queries in ((2048, 2048), (100, 4)):
        monkeypatch.setattr(vectors, "BLOCK", block)
        monkeypatch.setattr(vectors, "QUERIES", queries)
        got = [tuple(r) for r in ann.neighbours(table).collect()]
        exact = {(q, v): s for q, _, v, s in want}
        hits = [(q, v) for q, _, v, _ in got if (q, v) in exact]
        assert len(got) == len(want) and len(hits) >= 0.9 * len(want)
        assert sorted((q, n) for q, n, _, _ in got) == sorted((q, n) for q, n, _, _ in want)
        assert sorted(tuple(r) for r in topk.top_products(table).collect()) == slow(rows, product, True)


def test_cosine_of_extreme_lengths(spark):
    rows = [(50, [1e200, 1e200]), (1, [1e-200, 0.0]), (2, [3.0, 3.0])]
    got = sorted(tuple(r) for r in ann.neighbours(frame(spark, rows)).collect())
    assert [g[:3] for g in got] == [(50, 1, 2), (50, 2, 1)]
    assert np.allclose([g[3] for g in got], [1.0, 0.5**0.5])


def nodes(node):
    return 1 + sum(nodes(c) for c in node.children)


def test_even_points_are_not_split_to_the_last():
    """No centre is near many points here: a node for each of them would prune nothing and cost more than the products."""
    x = np.random.default_rng(4).normal(size=(4000, 64)) * 32
    assert nodes(topk.cover_tree(x)) < 4000 / 16
    assert nodes(topk.cover_tree(np.eye(3000))) < 3000 / 16


def test_products_are_few():
    rng = np.random.default_rng(5)
    x = np.floor(rng.normal(size=(8000, 64)) * 32)
    best = topk.Best(x[::50], np.arange(0, 8000, 50), x, np.arange(8000), 5)
    sizes = []
    real = best.products
    best.products = lambda rows, points: (sizes.append(len(rows) * len(points)), real(rows, points))[1]
    topk.dual_search(topk.cover_tree(x[::50]), [topk.cover_tree(x)], best)
    assert len(sizes) < 200 and sum(sizes) < 1.2 * 160 * 8000


@pytest.mark.parametrize("shape", ["flat", "ties", "one place", "outliers"])
def test_small_steps_are_exact(shape, monkeypatch):
    for name, value in {"LEAF": 8, "CHILDREN": 3, "AT_ONCE": 16, "ROWS": 7, "FIRST": 9}.items():
        monkeypatch.setattr(topk, name, value)
    rng = np.random.default_rng(6)
    x = {"flat": rng.integers(-90, 90, (500, 6)), "ties": rng.integers(0, 2, (500, 3)), "one place": np.full((500, 3), 7),
         "outliers": rng.integers(-3, 3, (500, 4)) * 2 ** rng.integers(0, 30, (500, 1))}[shape].astype(float)
    ids = rng.permutation(250).repeat(2)  # ids come twice and in no order
    query_ids = ids[:60]
    got = topk.search(query_ids, x[:60], ids, x, 5)
    products = (x[:60] @ x.T).astype(int)
    want = []
    for i in range(60):
        order = [j for j in np.lexsort((ids, -products[i])) if ids[j] != query_ids[i]][:5]
        want += [(query_ids[i], ids[j], products[i, j]) for j in order]
    assert list(zip(*(c.tolist() for c in got))) == want


def test_blocks_by_size(spark, monkeypatch):
    """Blocks grow with the table, so queries and vectors are sent to few others; several blocks of either give the same."""
    table = read(spark, SF, "embeddings")
    wide = spark.range(30_000).selectExpr("id as vec_id", "array_repeat(0.5d, 64) as x")
    assert vectors.by_size(wide, wide.where("vec_id % 50 = 0")) == (15, 1)  # 15 blocks of `BLOCK`, for idle cores
    monkeypatch.setattr(vectors, "GROUPS", 0)
    assert vectors.by_size(wide, wide.where("vec_id % 50 = 0")) == (1, 1)
    rows = [(r["vec_id"], r["embedding"]) for r in table.collect()]
    monkeypatch.setattr(vectors, "BYTES", 100 * 64 * 8)
    monkeypatch.setattr(topk, "query_set", lambda usable, every: usable.where("vec_id % 2 = 0"))
    got = {tuple(r) for r in topk.top_products(table).collect()}
    assert len(got) == 250 * 5 and got >= set(slow(rows, product, True))
