import numpy as np
import pandas as pd
import pytest
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from patronage.models import boosting, churn

NAMES = ("a", "b", "c")
SMALL = boosting.Trees(rounds=3, depth=2, bins=8)


def customers(tenant, n, seed, noise=1.0):
    """Labels that depend on two of three features, and not as a sum of them."""
    rng = np.random.default_rng(seed)
    a, b, c = rng.normal(size=n), rng.integers(0, 5, n).astype(float), rng.random(n).round(2)
    pull = 1.5 * a * np.where(b > 2, 1, -1) + (c > 0.7) + noise * rng.logistic(size=n) * 0.5
    return pd.DataFrame({"tenant_id": tenant, "customer_id": np.arange(n), "a": a, "b": b, "c": c, "label": (pull > 0).astype(float)})


def plain(table, spec):
    """The same trees for one tenant, grown one after the other over whole columns."""
    x, y = table[list(NAMES)].to_numpy(), table["label"].to_numpy()
    bins = np.zeros(x.shape, int)
    for f in range(x.shape[1]):
        below = (x[:, f][None, :] < x[:, f][:, None]).sum(axis=1)
        of_value = below * spec.bins // len(x)
        bins[:, f] = np.searchsorted(np.unique(of_value), of_value)
    margin = np.full(len(x), np.log((y.sum() + 0.5) / ((1 - y).sum() + 0.5)))
    for _ in range(spec.rounds):
        p = 1 / (1 + np.exp(-margin))
        g, h = p - y, p * (1 - p)
        nodes, step = [np.arange(len(x))], np.zeros(len(x))
        for level in range(spec.depth):
            following = []
            for rows in nodes:
                worth = lambda r: g[r].sum() ** 2 / (h[r].sum() + spec.ridge)
                best = None
                for f in range(x.shape[1]):
                    for cut in np.unique(bins[rows, f]):
                        left, right = rows[bins[rows, f] <= cut], rows[bins[rows, f] > cut]
                        if min(len(left), len(right)) < spec.least:
                            continue
                        gain = worth(left) + worth(right) - worth(rows)
                        if gain > 0 and (best is None or gain > best[0] + 1e-9):
                            best = gain, left, right
                following += [rows] if best is None else [best[1], best[2]]
            nodes = following
        for rows in nodes:
            step[rows] = -g[rows].sum() / (h[rows].sum() + spec.ridge) * spec.rate
        margin = margin + step
    return 1 / (1 + np.exp(-margin))


def scored(spark, table, spec, parts=4):
    rows = spark.createDataFrame(table).repartition(parts)
    return boosting.score(rows, boosting.fit(rows, NAMES, "label", spec), NAMES, spec)


def test_as_grown_one_by_one_in_tasks_and_by_passes(spark, monkeypatch):
    tables = {t: customers(t, n, t) for t, n in ((1, 300), (2, 61), (3, 15))}
    tables[4] = customers(4, 25, 9).assign(label=1.0)
    together = pd.concat(list(tables.values())).sample(frac=1, random_state=3)
    one = scored(spark, together, SMALL).toPandas().sort_values(["tenant_id", "customer_id"])
    for tenant, table in tables.items():
        assert one.loc[one.tenant_id == tenant, "score"].to_numpy() == pytest.approx(plain(table, SMALL), abs=1e-6)
    monkeypatch.setattr(boosting, "TOGETHER", 60)  # two tenants by passes, two in tasks
    two = scored(spark, together.sample(frac=1, random_state=4), SMALL, parts=7).toPandas().sort_values(["tenant_id", "customer_id"])
    assert one["score"].to_numpy() == pytest.approx(two["score"].to_numpy(), abs=1e-12)


def test_a_joined_model_gives_the_same(spark, monkeypatch):
    monkeypatch.setattr(boosting, "TOGETHER", 0)
    table = pd.concat([customers(1, 80, 1), customers(2, 60, 2)])
    spec = boosting.Trees(rounds=1, depth=2, bins=8)
    spread = [tuple(r) for r in scored(spark, table, spec).orderBy("tenant_id", "customer_id").collect()]
    monkeypatch.setattr(boosting, "BROADCAST_TENANTS", 1)
    assert spread == [tuple(r) for r in scored(spark, table, spec).orderBy("tenant_id", "customer_id").collect()]


def test_nulls_strange_numbers_and_empty_tables(spark):
    schema = "tenant_id long, customer_id long, a double, b double, c double, label double, score string"
    rows = [(1, i, None if i % 4 == 0 else float(i), float("nan"), None, float(i % 4 == 0), "x") for i in range(60)]
    rows += [(None, 1, 1.0, 1.0, 1.0, 1.0, "x"), (1, 99, 1.0, 1.0, 1.0, None, "x"), (2, 1, float("inf"), 1.0, 1.0, 0.0, "x")]
    given = spark.createDataFrame(rows, schema)
    out = boosting.score(given.drop("score"), boosting.fit(given, NAMES, "label", SMALL), NAMES, SMALL).collect()
    assert len(out) == 62 and all(0 < r.score < 1 for r in out)  # the row without a tenant has no ensemble
    by = {r.customer_id: r.score for r in out if r.tenant_id == 1}
    assert by[0] > by[3]  # what is not given is the smallest value
    empty = given.where("false")
    assert boosting.score(empty.drop("score"), boosting.fit(empty, NAMES, "label", SMALL), NAMES, SMALL).count() == 0


def test_ranks_as_well_as_separate_fits(spark):
    spec = boosting.Trees()
    train = pd.concat([customers(t, 700, 10 + t, noise=2.0) for t in (1, 2)])
    judge = spark.createDataFrame(pd.concat([customers(t, 1500, 20 + t, noise=2.0) for t in (1, 2)]))
    model = boosting.fit(spark.createDataFrame(train), NAMES, "label", spec)
    ours = {r.tenant_id: r.auc for r in churn.ranked_auc(boosting.score(judge, model, NAMES, spec)).collect()}
    wide = VectorAssembler(inputCols=list(NAMES), outputCol="features")
    for tenant in (1, 2):
        fitted = GBTClassifier(maxIter=10, maxDepth=3, seed=0).fit(wide.transform(spark.createDataFrame(train[train.tenant_id == tenant])))
        theirs = fitted.transform(wide.transform(judge.where(F.col("tenant_id") == tenant)))
        auc = churn.ranked_auc(theirs.select("tenant_id", "label", vector_to_array("probability")[1].alias("score"))).first().auc
        assert ours[tenant] > max(0.7, auc - 0.02)


def test_size_estimates_do_not_multiply_up(spark, monkeypatch):
    """Each level joins the tree of the level before twice; were its estimated size kept, its digits would double with every level."""
    monkeypatch.setattr(boosting, "TOGETHER", 0)
    real, kept = boosting._by_levels, []
    monkeypatch.setattr(boosting, "_by_levels", lambda *given: kept.append(real(*given)) or kept[0])
    boosting.fit(spark.createDataFrame(customers(1, 80, 1)), NAMES, "label", boosting.Trees(rounds=3, depth=3, bins=8))
    sizes = [tree._jdf.queryExecution().optimizedPlan().stats().sizeInBytes() for tree in kept[0]]
    assert len(sizes) == 3 and max(sizes).bit_length() < 200
