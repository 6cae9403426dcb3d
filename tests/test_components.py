"""Components grown batch by batch against a full rebuild."""

import random

import pytest
from pyspark.sql import functions as F

from patronage.operators import identity as idn
from patronage.streaming import components as grown
from tests.test_streaming import stream

EDGES = "tenant_id long, u long, v long"
PAIRS = "tenant_id long, node long, key string"


def union_find(edges):
    """(tenant, node) -> lowest node of its component."""
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for t, u, v in edges:
        a, b = sorted((root((t, u)), root((t, v))))
        parent[b] = a
    return {x: root(x)[1] for x in list(parent)}


def rows(df):
    got = [((r.tenant_id, r.node), r.component) for r in df.collect()]
    assert len(got) == len(dict(got))
    return dict(got)


def test_random_batches_equal_a_rebuild(spark, tmp_path):
    rng = random.Random(5)
    edges = [(rng.randrange(2), rng.randrange(150), rng.randrange(150)) for _ in range(120)]
    path = f"{tmp_path}/store"
    for batch in range(3):
        part = edges[batch * 40:batch * 40 + 40]
        grown.add_edges(spark.createDataFrame(part + part[:3], EDGES), path, batch)
        assert rows(grown.components(spark, path)) == union_find(edges[:batch * 40 + 40])


def test_chains_repeats_and_falling_names(spark, tmp_path):
    path, add = f"{tmp_path}/store", lambda batch, *edges: grown.add_edges(spark.createDataFrame(list(edges), EDGES), path, batch)
    steps = [[(1, 90, 91), (1, 80, 81), (1, 70, 70)], [(1, 91, 81)], [(1, 80, 60), (None, 1, 2), (1, None, 3)], [(1, 60, 50), (2, 90, 91)], [(1, 91, 70)]]
    done = []
    for batch, step in enumerate(steps):
        add(batch, *step)
        add(batch, *step)  # a batch run twice changes nothing
        done += [e for e in step if None not in e]
        assert rows(grown.components(spark, path)) == union_find(done)
    grown.compact(spark, path, f"{tmp_path}/small")
    assert rows(grown.components(spark, f"{tmp_path}/small")) == union_find(done)
    grown.add_edges(spark.createDataFrame([(1, 70, 5), (1, 6, 7)], EDGES), f"{tmp_path}/small", 1)
    assert rows(grown.components(spark, f"{tmp_path}/small")) == union_find(done + [(1, 70, 5), (1, 6, 7)])


def test_an_empty_batch_and_an_empty_store(spark, tmp_path):
    path = f"{tmp_path}/store"
    assert grown.components(spark, path).count() == 0
    grown.add_edges(spark.createDataFrame([], EDGES), path, 0)
    assert grown.components(spark, path).count() == 0


@pytest.mark.parametrize("shared", [True, False])
def test_a_batch_opens_its_own_buckets_only_and_rounds_see_names(spark, tmp_path, monkeypatch, shared):
    path = f"{tmp_path}/store"
    star = spark.range(1, 3000).select(F.lit(1).cast("long").alias("tenant_id"), F.col("id").alias("u"), F.lit(0).cast("long").alias("v"))
    grown.add_edges(star, path, 0)
    entered, opened = [], []
    real, near = grown.connected_components, grown._near
    monkeypatch.setattr(grown, "connected_components", lambda e: entered.append(e.count()) or real(e))

    def spy(keys, at, name, batch):
        found = near(keys, at, name, batch)
        plan = found._jdf.queryExecution().executedPlan().toString()
        if name == grown.NODES:  # of the others there is no file yet
            assert "PartitionFilters: [" in plan and "bucket#" in plan.split("PartitionFilters: [")[1].split("]")[0]
        files = [r[0] for r in found.select(F.input_file_name()).distinct().collect()]
        opened.append((name, len({f.split("bucket=")[1].split("/")[0] for f in files})))
        return found

    monkeypatch.setattr(grown, "_near", spy)
    node = 1500 if shared else 5001
    grown.add_edges(spark.createDataFrame([(1, 5000, node), (1, 7, 8), (1, 9, 10)] if shared else [(1, 5000, node)], EDGES), path, 1)
    assert entered == [1]  # of the star of 3,000 only its name, of links inside it nothing
    assert opened and all(n <= 6 for _, n in opened)
    assert rows(grown.components(spark, path))[(1, 5000)] == (0 if shared else 5000)


def test_streamed_keys_equal_the_batch_operator(spark, tmp_path):
    rng = random.Random(9)
    batches = [[(t, n, f"k{rng.randrange(60)}") for t in (1, 2) for n in rng.sample(range(100), 25)] for _ in range(3)]
    batches[2] += [(1, 500 + i, "hot") for i in range(40)] + [(1, 999, None)]
    out = grown.stream_components(stream(spark, tmp_path, PAIRS, *batches), f"{tmp_path}/store", f"{tmp_path}/ckpt")
    every = spark.createDataFrame([r for b in batches for r in b if r[2]], PAIRS)
    whole = idn.connected_components(idn.star_edges(every))
    want = rows(every.select("tenant_id", "node").distinct().join(whole, ["tenant_id", "node"], "left").select(
        "tenant_id", "node", F.coalesce("component", "node").alias("component")))
    assert rows(out) == want
