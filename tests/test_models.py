import math
from datetime import datetime, timedelta
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from patronage.functions import churn_band
from patronage.models import churn, fitting, lifetime
from patronage.models.numeric import (
    buying_by_count, buying_by_count_slopes, buying_by_history, buying_by_history_slopes, gammas, log_gamma, orders_while_alive,
    value_by_count, value_by_count_slopes, value_by_mean, value_by_mean_slopes,
)

SUMMARY = "tenant_id long, customer_id long, n_orders long, x long, t_x double, age double, mean_value double"


def population(n=2000, r=0.6, alpha=8.0, a=0.9, b=2.2, seed=1):
    """Buyers simulated from the model's own story, ages 40 to 104 weeks."""
    rng = np.random.default_rng(seed)
    rows = []
    for i in range(n):
        age = rng.uniform(40, 104)
        rate, drop = rng.gamma(r, 1 / alpha), rng.beta(a, b)
        t, x, last = 0.0, 0, 0.0
        while True:
            t += rng.exponential(1 / rate)
            if t > age:
                break
            x, last = x + 1, t
            if rng.random() < drop:
                break
        rows.append((1, i, x + 1, x, last, age, 100.0))
    return rows


def test_bgnbd_recovers_its_parameters(spark):
    fitted = lifetime.fit_bgnbd(spark.createDataFrame(population(), SUMMARY)).first()
    assert fitted.r == pytest.approx(0.6, rel=0.30)
    assert fitted.alpha == pytest.approx(8.0, rel=0.35)
    assert fitted.a / (fitted.a + fitted.b) == pytest.approx(0.9 / 3.1, abs=0.08)


def test_gamma_gamma_recovers_the_mean(spark):
    rng = np.random.default_rng(2)
    p, q, v = 6.0, 4.0, 15.0
    rows = []
    for i in range(1500):
        n = int(rng.integers(2, 12))
        scale = rng.gamma(q, 1 / v)
        rows.append((1, i, n, n - 1, 1.0, 2.0, float(np.mean(rng.gamma(p, 1 / scale, n)))))
    g = lifetime.fit_gamma_gamma(spark.createDataFrame(rows, SUMMARY)).first()
    assert g.p * g.v / (g.q - 1) == pytest.approx(p * v / (q - 1), rel=0.1)


def test_too_few_repeaters_are_skipped(spark):
    rows = [(1, i, 2, 1, 3.0, 9.0, 10.0) for i in range(9)] + [(2, i, 1, 0, 0.0, 9.0, 10.0) for i in range(50)]
    assert lifetime.enough_repeaters(spark.createDataFrame(rows, SUMMARY)).count() == 0


def test_recent_regular_beats_lapsed_single_repeat(spark):
    args = [F.col(c) for c in ("x", "t_x", "age")] + [F.lit(v) for v in (0.6, 8.0, 0.9, 2.2)]
    df = spark.createDataFrame([(9, 51.0, 52.0), (1, 6.0, 78.0), (0, 0.0, 30.0)], "x long, t_x double, age double")
    rows = df.select("x", lifetime.p_alive(*args).alias("p"), lifetime.expected_orders(*args, 90 / 7).alias("e")).collect()
    got = {r.x: r for r in rows}
    assert got[9].p > got[1].p and got[9].e > got[1].e and got[0].p == 1.0


def test_value_shrinks_to_the_population(spark):
    df = spark.createDataFrame([(0.0, 999.0), (50.0, 100.0)], "n double, m double")
    v = lifetime.expected_value(F.col("n"), F.col("m"), F.lit(6.0), F.lit(4.0), F.lit(15.0))
    prior, many = (r[0] for r in df.select(v).collect())
    assert prior == pytest.approx(30.0) and many == pytest.approx(100.0, rel=0.05)


def test_expected_orders_against_closed_forms():
    # p ~ Beta(a, b); with s = 1 the mean of w / (1 + p w), with s = -1 formally -w
    w = np.array([1e-3, 0.5, 5.0, 1e4])
    one = np.ones_like(w)
    assert orders_while_alive(one, one, one, w) == pytest.approx(np.log1p(w), rel=1e-10)  # uniform p
    # nobody lapses when b is huge: s w orders; a tiny and a large: a sure thing
    assert orders_while_alive(1e-6 * one, 1e6 * one, 2.5 * one, w) == pytest.approx(2.5 * w, rel=1e-6)
    assert orders_while_alive(1e7 * one, 1e-3 * one, 2 * one, w) == pytest.approx(1 - (1 + w) ** -2.0, rel=1e-6)


def test_expected_orders_against_a_fine_sum():
    rng = np.random.default_rng(4)
    for a, b, s, w in [(0.8, 2.4, 0.55, 9.0), (3.0, 40.0, 12.5, 0.7), (0.05, 0.3, 0.2, 900.0), (250.0, 900.0, 30.0, 5.0)]:
        p = rng.beta(a, b, 400_000)
        p = np.maximum(p, 1e-300)
        got = orders_while_alive(*(np.array([v]) for v in (a, b, s, w)))[0]
        assert got == pytest.approx(np.mean(-np.expm1(-s * np.log1p(p * w)) / p), rel=0.02)


def test_log_gamma(spark):
    z = [1e-6, 0.01, 0.5, 1.0, 2.0, 7.3, 31.0, 1e3, 1e8]
    rows = spark.createDataFrame([(v,) for v in z], "z double").select("z", log_gamma(F.col("z")).alias("g")).collect()
    assert [r.g for r in rows] == pytest.approx([math.lgamma(r.z) for r in rows], rel=1e-12, abs=1e-12)


def test_gamma_function_and_its_slopes():
    z = np.array([1e-4, 0.3, 1.0, 2.5, 9.0, 400.0, 1e6])
    value, first, second = gammas(z)
    assert value == pytest.approx([math.lgamma(v) for v in z], rel=1e-12, abs=1e-12)
    k = np.arange(200_000)
    for v, d, t in zip(z, first, second):
        assert d == pytest.approx(math.log(v) - np.sum(1.0 / (v + k) - np.log1p(1.0 / (v + k))) - 0.5 / (v + 200_000), rel=1e-8, abs=1e-9)
        assert t == pytest.approx(np.sum(1.0 / (v + k) ** 2) + 1.0 / (v + 199_999.5), rel=1e-8)


@pytest.mark.parametrize("model", ["buying", "value"])
def test_slopes_against_differences(spark, model):
    rng = np.random.default_rng(7)
    names = lifetime.BGNBD if model == "buying" else lifetime.GAMMA
    if model == "buying":
        rows = [(1, float(x), float(t), float(t + rng.uniform(0, 40)), 1.0) for x, t in ((0, 0), (1, 3.5), (4, 20.0), (30, 90.0), (0, 0))]
        df = spark.createDataFrame(rows, "tenant_id long, x double, t_x double, age double, n double")
        x, t_x, age = F.col("x"), F.col("t_x"), F.col("age")
        pairs = [(lambda r, alpha, a, b: buying_by_count(x, r, a, b), ["x"], buying_by_count_slopes),
                 (lambda r, alpha, a, b: buying_by_history(x, t_x, age, r, alpha, a, b), ["x", "t_x", "age"], buying_by_history_slopes)]
    else:
        df = spark.createDataFrame([(1, float(n), float(rng.gamma(2.0)) + 0.01, 1.0) for n in (2, 3, 9, 50)], "tenant_id long, orders double, m double, n double")
        n, m = F.col("orders"), F.col("m")
        pairs = [(lambda p, q, v: value_by_count(n, p, q), ["orders"], value_by_count_slopes),
                 (lambda p, q, v: value_by_mean(n, m, p, q, v), ["orders", "m"], value_by_mean_slopes)]
    k, h = len(names), 1e-3
    for at in (np.zeros(k), rng.normal(size=k)):
        eye = np.eye(k) * h
        shifts = [np.zeros(k)] + [s * eye[i] + t * eye[j] for i in range(k) for j in range(i + 1) for s in (1, -1) for t in (1, -1)] + [s * eye[i] for i in range(k) for s in (1, -1)]
        points = spark.createDataFrame([(1, [(at + d).tolist() for d in shifts])], "tenant_id long, points array<array<double>>")
        point = spark.createDataFrame([(1, at.tolist())], "tenant_id long, point array<double>")
        for plain, inputs, slopes in pairs:
            ll = {r.trial: r.ll for r in fitting.summed(df, points, plain, names).collect()}
            found = fitting.total_slopes(names, fitting.summed_slopes(df, point, inputs, slopes, names)).first()
            got = [fitting.exact(found.limbs[i:i + 3]) for i in range(0, len(found.limbs), 3)]
            assert found.bad == 0 and got[0] == pytest.approx(ll[0], rel=1e-9)
            single = len(shifts) - 2 * k
            assert got[1:k + 1] == pytest.approx([(ll[single + 2 * i] - ll[single + 2 * i + 1]) / (2 * h) for i in range(k)], rel=1e-4, abs=1e-5)
            cross = [(ll[1 + 4 * c] - ll[2 + 4 * c] - ll[3 + 4 * c] + ll[4 + 4 * c]) / (4 * h * h) for c in range(k * (k + 1) // 2)]
            assert got[k + 1:] == pytest.approx(cross, rel=1e-3, abs=1e-3)


def test_exact_sums_do_not_depend_on_the_order(spark):
    rng = np.random.default_rng(3)
    values = np.concatenate([rng.normal(size=3000) * 10.0 ** rng.integers(-6, 9, 3000), [1e15, -1e15, 0.1]]).tolist()
    want = float(sum(Fraction(v).limit_denominator(1 << 60) for v in values))
    seen = set()
    for parts in (1, 7, 64):
        df = spark.createDataFrame([(v,) for v in rng.permutation(values).tolist()], "v double").repartition(parts)
        seen.add(df.agg(fitting.exact_sum(F.col("v"))).first()[0])
    assert len(seen) == 1 and seen.pop() == pytest.approx(want, abs=1e-6)


def test_every_tenant_is_reported(spark):
    rows = population(300) + [(2, i, 2, 1, 3.0, 9.0, 10.0) for i in range(9)] + [(3, i, 1, 0, 0.0, 9.0, 10.0) for i in range(5)]
    summary = spark.createDataFrame(rows, SUMMARY)
    buying = lifetime.fit_bgnbd(summary).withColumn("converged", F.lit(True))
    stalled = buying.withColumn("converged", F.lit(False))
    status = {r.tenant_id: r for r in lifetime.model_status(summary, buying, buying).collect()}
    assert [(t, s.status, s.customers) for t, s in sorted(status.items())] == [(1, "scored", 300), (2, "skipped", 9), (3, "skipped", 5)]
    assert status[2].reason == "fewer than 10 repeat buyers"
    assert "purchase model" in {r.tenant_id: r.reason for r in lifetime.model_status(summary, stalled, buying).collect()}[1]


def test_passes_do_not_depend_on_the_other_tenants(spark):
    alone = lifetime.fit_bgnbd(spark.createDataFrame(population(300), SUMMARY)).first()
    others = [(t, *r[1:]) for t in (2, 3) for r in population(300, seed=t)]
    beside = lifetime.fit_bgnbd(spark.createDataFrame(population(300) + others, SUMMARY)).where("tenant_id = 1").first()
    assert alone.converged and beside.converged and abs(alone.passes - beside.passes) <= 2
    assert (alone.r, alone.b) == pytest.approx((beside.r, beside.b), rel=1e-4)


@pytest.mark.parametrize("p,want", [(0.1, "high"), (0.35, "medium"), (0.64, "medium"), (0.65, "low"), (0.9, "low")])
def test_band_edges(spark, p, want):
    assert spark.range(1).select(churn_band(F.lit(p))).first()[0] == want


CUT = datetime(2025, 6, 1)


def features(spark, later):
    """Features at the cutoff; `later` adds rows and timestamps on or after it."""
    day = lambda n: CUT + timedelta(days=n)
    orders = [(1, 1, 7, day(-100), None, 1000, 100, 900), (1, 2, 7, day(-10), None, 3000, 0, 3000)]
    items = [(1, 1, 5), (1, 2, 6)]
    ships = [(1, 1, True, day(-95), None, day(-90)), (1, 2, False, day(-9), None, None)]
    tickets = [(1, 7, day(-5))]
    messages = [(1, 7, day(-20), day(-19), None), (1, 7, day(-3), None, None)]
    if later:
        orders += [(1, 3, 7, CUT, None, 9999, 9, 9)]
        items += [(1, 3, 8)]
        ships += [(1, 3, True, day(1), None, day(2))]
        tickets += [(1, 7, day(4))]
        messages[1] = (1, 7, day(-3), day(1), day(2))
        messages += [(1, 7, CUT, day(1), day(1))]
    at = spark.createDataFrame([(1, CUT)], "tenant_id long, cutoff timestamp_ntz")
    make = spark.createDataFrame
    orders = make(orders, "tenant_id long, order_id long, customer_id long, placed_at timestamp_ntz, cancelled_at timestamp_ntz, "
                          "total_paise long, discount_paise long, subtotal_paise long")
    got = churn.churn_features(
        at, orders, make(items, "tenant_id long, order_id long, product_id long"),
        make([(1, 5, "balm"), (1, 6, None), (1, 8, "oil")], "tenant_id long, product_id long, product_type string"),
        make(ships, "tenant_id long, order_id long, rto boolean, shipped_at timestamp_ntz, delivered_at timestamp_ntz, rto_at timestamp_ntz"),
        make(tickets, "tenant_id long, customer_id long, opened_at timestamp_ntz"),
        make(messages, "tenant_id long, customer_id long, sent_at timestamp_ntz, opened_at timestamp_ntz, clicked_at timestamp_ntz"))
    return got.first().asDict(), churn.churn_labels(at, orders).first()


def test_nothing_after_the_cutoff_leaks(spark):
    before, label = features(spark, later=False)
    after, stayed = features(spark, later=True)
    assert before == after
    assert (before["frequency"], before["category_breadth"], before["rto_flag"], before["ticket_flag"]) == (2.0, 2.0, 1.0, 1.0)
    assert (before["open_rate"], before["click_rate"]) == (0.5, 0.0) and before["discount_share"] == pytest.approx(100 / 3900)
    assert (label.churned, stayed.churned) == (1, 0)


def test_ranked_auc(spark):
    rows = [(1, 0.9, 1.0), (1, 0.8, 0.0), (1, 0.8, 1.0), (1, 0.1, 0.0), (2, 0.5, 1.0), (2, 0.5, 0.0), (3, 0.7, 1.0)]
    got = {r.tenant_id: r.auc for r in churn.ranked_auc(spark.createDataFrame(rows, "tenant_id long, score double, label double")).collect()}
    assert got == {1: 0.875, 2: 0.5, 3: None}


def test_fits_are_the_same_under_any_partitioning(spark):
    rows = population(400) + [(2, *r[1:]) for r in population(300, seed=5)]
    rng = np.random.default_rng(0)
    at = {4: [0.3, 1.7, -0.2, 0.4], 3: [0.5, 0.9, -0.3]}
    points = {k: spark.createDataFrame([(1, p), (2, p[::-1])], "tenant_id long, point array<double>") for k, p in at.items()}
    before, sums, fits = spark.conf.get("spark.sql.shuffle.partitions"), set(), set()
    try:
        for parts in (1, 7, 64):
            spark.conf.set("spark.sql.shuffle.partitions", str(parts))
            summary = spark.createDataFrame([rows[i] for i in rng.permutation(len(rows))], SUMMARY).repartition(parts)
            summary = summary.withColumn("mean_value", F.col("mean_value") * (1 + F.col("customer_id") % 7 / 3.0))
            repeat, unit = lifetime.scaled_values(summary)
            told = [lifetime.bgnbd_slopes(summary)(points[4]), lifetime.gamma_gamma_slopes(repeat)(points[3]), unit]
            sums.add(str([sorted(map(tuple, df.collect())) for df in told]))
            if parts < 64:
                fits.add(str(sorted(map(tuple, lifetime.fit_bgnbd(summary).collect()))))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert len(sums) == len(fits) == 1


def test_whole_run_is_repeatable(spark, tables):
    one = lifetime.run_models(tables.order_headers, "2026-01-01 00:00:00").orderBy("tenant_id", "customer_id").collect()
    two = lifetime.run_models(tables.order_headers, "2026-01-01 00:00:00").orderBy("tenant_id", "customer_id").collect()
    assert [(r.customer_id, r.churn_band, r.ltv_12m_paise) for r in one] == [(r.customer_id, r.churn_band, r.ltv_12m_paise) for r in two]
    assert all(0.0 <= r.p_alive <= 1.0 and r.ltv_12m_paise >= 0 for r in one)


def test_limbs_keep_small_negative_terms():
    """Sums of negative terms are as fine as those of positive ones; rounded more coarsely, a fit of some hundred rows could stall."""
    values = -np.random.default_rng(5).random(400) * 100
    got = fitting.exact([int(p.sum()) for p in fitting.limbs(values)])
    assert abs(got - math.fsum(values)) < 400 * 2.0 ** -41


def test_exact_sum_keeps_small_negative_terms(spark):
    values = (-np.random.default_rng(6).random(400) * 100).tolist()
    got = spark.createDataFrame([(v,) for v in values], "v double").agg(fitting.exact_sum(F.col("v")).alias("s")).first().s
    assert abs(got - math.fsum(values)) < 400 * 2.0 ** -41
