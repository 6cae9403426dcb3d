"""The forms that survive hot keys must give what the plain forms give."""

import random
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from patronage.operators import scale
from patronage.operators.attribution import last_click, latest_before
from patronage.operators.orders import order_index, valid_orders
from patronage.plans.score_inputs import sends_after_revoke


@pytest.fixture(scope="module")
def skewed(spark):
    """One key holds more than a third of the rows."""
    rnd = random.Random(5)
    start = datetime(2024, 1, 1)
    rows = [(0 if rnd.random() < 0.4 else rnd.randrange(1, 40), start + timedelta(minutes=rnd.randrange(60 * 24 * 9)), i,
             rnd.randrange(100)) for i in range(1500)]
    return spark.createDataFrame(rows, "k long, t timestamp_ntz, id long, v long")


def test_running_equals_plain_window(skewed):
    w = Window.partitionBy("k").orderBy("t", "id").rowsBetween(Window.unboundedPreceding, 0)
    plain = skewed.select("*", F.sum("v").over(w).alias("s"), F.max(F.struct("v", "id")).over(w).alias("m"))
    split = scale.running(skewed, ["k"], F.date_trunc("hour", F.col("t")), ["t", "id"], sums={"s": F.col("v")},
                          peaks={"m": F.struct("v", "id")})
    assert sorted(split.collect()) == sorted(plain.collect())


def test_one_customer_is_spread_over_tasks(skewed, spark):
    """Rows of the hot key lie in many partitions, before and after the window."""
    numbered = scale.running(skewed, ["k"], F.date_trunc("hour", F.col("t")), ["t", "id"], sums={"s": F.col("v")})
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        where = [r.n for r in numbered.where("k = 0").groupBy(F.spark_partition_id().alias("p")).agg(F.count("*").alias("n")).collect()]
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert len(where) >= 4 and max(where) < 0.5 * sum(where)


@pytest.fixture()
def small_pieces(monkeypatch):
    """Pieces of a few rows, and few buckets that may be cut."""
    for name, value in {"SAMPLE": 4, "KEEP": 64, "CROWDED": 8, "PIECES": 16, "CUT": 8}.items():
        monkeypatch.setattr(scale, name, value)


def test_one_instant_is_spread_over_tasks(spark, small_pieces):
    """All rows of the hot key at one instant: they lie in several partitions before the window and are numbered right."""
    at = datetime(2025, 3, 1, 10)
    rows = [(0, at, i, i % 7) for i in range(2000)] + [(1 + i % 300, at + timedelta(minutes=i), i, 1) for i in range(900)]
    df = spark.createDataFrame(rows, "k long, t timestamp_ntz, id long, v long").repartition(5)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        out = scale.running(df, ["k"], F.date_trunc("hour", F.col("t")), ["t", "id"], sums={"nth": F.lit(1), "s": F.col("v")})
        held = [r.n for r in out.where("k = 0").groupBy(F.spark_partition_id()).agg(F.count("nth").alias("n")).collect()]
        got = {r.id: (r.nth, r.s) for r in out.where("k = 0").collect()}
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert len(held) == 4 and max(held) < 1200  # the session has four shuffle partitions
    assert got == {i: (i + 1, sum(j % 7 for j in range(i + 1))) for i in range(2000)}
    bucketed = df.withColumns({"__bucket": F.date_trunc("hour", F.col("t")), "__place": F.struct("t", "id")})
    cuts = scale._cuts(bucketed, ["k", "__bucket"]).collect()
    assert [r.k for r in cuts] == [0] and 8 <= len(cuts[0]["__cuts"]) <= 15


def test_pieces_change_no_result(skewed, small_pieces):
    test_running_equals_plain_window(skewed)


def test_a_burst_of_clicks_and_orders_at_one_instant(spark, small_pieces):
    """Asks of an instant see every fact of that instant, whichever piece holds it."""
    at = datetime(2025, 3, 1, 10)
    asks = spark.createDataFrame([(1, i, at + timedelta(seconds=i // 300)) for i in range(900)], "k long, a long, t timestamp_ntz")
    facts = spark.createDataFrame([(1, i, at + timedelta(seconds=i // 200)) for i in range(600)], "k long, f long, u timestamp_ntz")
    got = latest_before(asks, facts, ["k"], "t", "u", [F.col("f")], "last")
    assert {(r.a, r.last.f) for r in got.collect()} == {(i, 200 * (i // 300 + 1) - 1) for i in range(900)}


def test_orders_of_one_customer_are_split(spark):
    """The key that numbers counted orders is never null: null keys would find no carry."""
    start = datetime(2024, 1, 1)
    rows = [(1, 7 if i % 3 else None, i, start + timedelta(hours=i // 2), None, None) for i in range(300)]
    orders = spark.createDataFrame(
        rows, "tenant_id long, customer_id long, order_id long, placed_at timestamp_ntz, cancelled_at timestamp_ntz, customer_order_index int")
    got = {r.order_id: r.oi for r in valid_orders(orders).collect()}
    mine = [i for i in range(300) if i % 3]
    assert [got[i] for i in mine] == list(range(1, len(mine) + 1))
    assert {got[i] for i in range(0, 300, 3)} == {1}
    plan = valid_orders(orders)._jdf.queryExecution().executedPlan().toString()
    assert "__bucket" in plan


def test_building_starts_no_job(tables, spark):
    def jobs():
        return spark.sparkContext._jsc.sc().dagScheduler().nextJobId()

    orders, messages, consent = tables.fact_orders, tables.fact_messages, tables.fact_consent
    before = jobs()
    valid = valid_orders(orders)
    for df in (valid, order_index(tables.order_headers), last_click(valid, messages), sends_after_revoke(messages, consent)):
        assert df.columns
    assert jobs() == before


def test_ranks_equal_percent_rank(skewed):
    w = Window.partitionBy("k").orderBy("v")
    plain = {(r.k, r.v): r.p for r in skewed.select("k", "v", F.percent_rank().over(w).alias("p")).distinct().collect()}
    ranked = scale.ranked_values(skewed, ["k"], "v").collect()
    assert len(ranked) == len(plain)
    for r in ranked:
        assert plain[r.k, r.v] == pytest.approx(r.below / (r.total - 1) if r.total > 1 else 0.0)


@pytest.mark.parametrize("q", [0.0, 0.5, 0.99, 1.0])
def test_quantile_equals_numpy(spark, q):
    values = [float(x) for x in np.random.default_rng(3).normal(0, 1000, 501)]
    df = spark.createDataFrame([(i % 3, v) for i, v in enumerate(values)], "g long, v double")
    got = {r.g: r.x for r in scale.quantile(scale.ranked_values(df, ["g"], "v"), ["g"], "v", q, "x").collect()}
    for g in range(3):
        assert got[g] == pytest.approx(np.quantile(values[g::3], q))


def test_executors_need_no_package():
    """Functions that run in tasks are pickled whole, not by module name."""
    import pickletools

    from pyspark import cloudpickle

    from patronage.models import fitting, numeric

    for fn in (numeric.orders_while_alive, fitting.advance):
        names = {arg for op, arg, _ in pickletools.genops(cloudpickle.dumps(fn)) if op.name in ("GLOBAL", "SHORT_BINUNICODE")}
        assert "CodeType" in names or "code" in names or "_make_function" in names
