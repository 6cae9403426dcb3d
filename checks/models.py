"""Queries and SQL of the predictive models; fixed parameters where a fit has no SQL."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from checks.marts import r6
from patronage.functions import churn_band
from patronage.models import boosting, churn, lifetime
from patronage.session import settle, work_path
from patronage.sources import sinks

R, ALPHA, A, B = 0.55, 10.0, 0.8, 2.4
P, Q, V = 5.0, 3.5, 4e7


def _args():
    """History columns and the fixed parameters."""
    return [F.col(c) for c in ("x", "t_x", "age")] + [F.lit(v) for v in (R, ALPHA, A, B)]


def _expected(t):
    s = lifetime.bgnbd_summary(t.order_headers)
    return s.withColumns({
        "expected_orders_90d": lifetime.expected_orders(*_args(), 90 / 7),
        "expected_12m": lifetime.expected_orders(*_args(), 365 / 7),
    })


def _ltv(t):
    df = _expected(t).withColumns({"p": F.lit(P), "q": F.lit(Q), "v": F.lit(V)})
    return lifetime.ltv_12m(df).select("tenant_id", "customer_id", "ltv_12m_paise")


def _features(t):
    return churn.churn_features(
        churn.cutoffs(t.order_headers, 1), t.fact_orders, t.fact_order_items, t.products, t.fact_shipments,
        t.fact_tickets, t.fact_messages)


def _upserted(t):
    """Yesterday's and today's rows stored, then today's once more."""
    path = work_path(t.spark, "predictions")
    rows = t.predictions.drop("total_spent_paise")
    first = t.predictions.agg(F.min("scored_on")).first()[0]
    sinks.write_predictions(rows.withColumn("p_alive", F.lit(9.0)), path)
    sinks.write_predictions(rows.where(F.col("scored_on") == F.lit(first)), path)
    sinks.write_predictions(rows.where(F.col("scored_on") != F.lit(first)), path)
    return sinks.read_table(t.spark, path, rows)


TRIALS = ((0.55, 10.0, 0.8, 2.4), (1.7, 0.4, 3.0, 0.9), (0.05, 80.0, 12.0, 30.0))
VALUE_TRIALS = ((5.0, 3.5, 1.4), (0.6, 12.0, 0.3), (40.0, 1.1, 9.0))


def _at(frame, trials):
    points = F.array(*[F.array(*[F.log(F.lit(v)) for v in p]) for p in trials])
    return frame.select("tenant_id").distinct().withColumn("points", points)


def _bgnbd_loglik(t):
    s = lifetime.bgnbd_summary(t.order_headers)
    return lifetime.bgnbd_loglik(s)(_at(s, TRIALS)).withColumn("ll", F.round("ll", 4))


def _value_loglik(t):
    repeat, _ = lifetime.scaled_values(lifetime.bgnbd_summary(t.order_headers))
    return lifetime.gamma_gamma_loglik(repeat)(_at(repeat, VALUE_TRIALS)).withColumn("ll", F.round("ll", 4))


def _fit_check(summary, fitted, names, loglik):
    """What a right fit must say, without its parameters: they have no SQL."""
    have = summary.groupBy("tenant_id").agg(F.count(F.lit(1)).alias("customers"), F.count_if(F.col("x") > 0).alias("repeaters"))
    best = lifetime.no_better_nearby(fitted, names, loglik)
    return have.join(fitted.select("tenant_id", "converged"), "tenant_id").join(best, "tenant_id")


def _bgnbd_fit(t):
    s = settle(lifetime.bgnbd_summary(t.order_headers))
    return _fit_check(s, settle(lifetime.fit_bgnbd(s)), lifetime.BGNBD, lifetime.bgnbd_loglik(s))


def _gamma_fit(t):
    s = settle(lifetime.bgnbd_summary(t.order_headers))
    repeat, unit = lifetime.scaled_values(s)
    fitted = settle(lifetime.fit_gamma_gamma(s)).join(unit, "tenant_id").withColumn("v", F.col("v") / F.col("unit"))
    return _fit_check(s, fitted, lifetime.GAMMA, lifetime.gamma_gamma_loglik(repeat))


def _run_models(t):
    """Scored customers per tenant, and how many of their predictions are missing, out of range, or in a band their chance does not give."""
    p = lifetime.run_models(t.order_headers, "2001-08-12 04:00:00")
    missing = F.col("p_alive").isNull() | F.col("expected_orders_90d").isNull() | F.col("ltv_12m_paise").isNull()
    odd = ~F.col("p_alive").between(0.0, 1.0) | (F.col("expected_orders_90d") < 0) | (F.col("ltv_12m_paise") < 0)
    return p.groupBy("tenant_id").agg(
        F.count(F.lit(1)).alias("customers"), F.count_if(missing).alias("missing"), F.count_if(odd).alias("out_of_range"),
        F.count_if(F.col("churn_band") != churn_band(F.col("p_alive"))).alias("wrong_band"))


def _shadow(t):
    """Label counts and eligibility; every judged customer has a chance as score, and the AUC that the ranks give is that of the pairs."""
    have, scored = churn.shadow_scores(churn.shadow_sets(t))
    # pairs of one label each, counted per distinct score instead of by ranks
    each = scored.groupBy("tenant_id", "score").agg(F.sum("label").alias("ones"), F.count_if(F.col("label") == 0).alias("zeros"))
    below = F.sum("zeros").over(Window.partitionBy("tenant_id").orderBy("score")) - F.col("zeros") / 2
    pairs = each.select("*", (F.col("ones") * below).alias("won")).groupBy("tenant_id").agg(
        (F.sum("won") / (F.sum("ones") * F.sum("zeros"))).alias("by_pairs"))
    judged = scored.groupBy("tenant_id").agg(F.count_if(F.col("score").between(0.0, 1.0)).alias("scored"))
    told = have.join(churn.ranked_auc(scored), "tenant_id", "left").join(pairs, "tenant_id", "left").join(judged, "tenant_id", "left")
    return told.select("tenant_id", F.col("train_n").alias("trained_on"), F.col("judge_n").alias("judged_on"), "eligible", F.coalesce("scored", F.lit(0)).alias("scored"),
                       F.coalesce(F.abs(F.col("auc") - F.col("by_pairs")) < 1e-9, ~F.col("eligible")).alias("auc_fits"))


def _labelled(t):
    """Features and labels one horizon back."""
    return settle(r6(_features(t)).join(churn.churn_labels(churn.cutoffs(t.order_headers, 1), t.order_headers), ["tenant_id", "customer_id"]))


def _first_cut(t):
    """The root of the first tree of every tenant: where it cuts and the values on either side."""
    rows = _labelled(t)
    stump = boosting.Trees(rounds=1, depth=1)
    tree = F.col("trees")[0]
    cut = tree["splits"][F.lit(1)]
    return r6(boosting.fit(rows, churn.FEATURES, "churned", stump).select(
        "tenant_id", F.col("base"), cut["feature"].alias("feature"), F.col("cuts")[cut["feature"]][cut["bin"] - 1].alias("goes_right_from"),
        tree["leaves"][F.lit(2)].alias("left_value"), tree["leaves"][F.lit(3)].alias("right_value")))


def _auc_of_recency(t):
    """How well the weeks since the last order alone rank the customers."""
    return r6(churn.ranked_auc(_labelled(t).select("tenant_id", F.col("recency_weeks").alias("score"), F.col("churned").alias("label"))))


def _bgnbd_sql():
    parts = []
    for i, (r, alpha, a, b) in enumerate(TRIALS):
        r, alpha, a, b = (f"{v}::DOUBLE" for v in (r, alpha, a, b))
        lapsed = f"({a} / ({b} + x - 1)) * pow(1 / ({alpha} + t_x), {r} + x)"
        parts.append(f"""SELECT tenant_id, {i} AS trial, round(sum(lgamma({r} + x) - lgamma({r}) + {r} * ln({alpha}) + lgamma({a} + {b}) + lgamma({b} + x)
            - lgamma({b}) - lgamma({a} + {b} + x) + ln(pow(1 / ({alpha} + age), {r} + x) + CASE WHEN x > 0 THEN {lapsed} ELSE 0 END)), 4) AS ll
            FROM v_life GROUP BY tenant_id""")
    return " UNION ALL ".join(parts)


def _value_sql():
    parts = []
    for i, (p, q, v) in enumerate(VALUE_TRIALS):
        p, q, v = (f"{c}::DOUBLE" for c in (p, q, v))
        parts.append(f"""SELECT tenant_id, {i} AS trial, round(sum(lgamma({p} * n + {q}) - lgamma({p} * n) - lgamma({q}) - ln(m)
            + {q} * ln({v} / ({v} + n * m)) + {p} * n * ln(n * m / ({v} + n * m))), 4) AS ll FROM v_scaled GROUP BY tenant_id""")
    return " UNION ALL ".join(parts)


HYP = ("list_sum(list_transform(range(0, 1200), lambda k: exp(lgamma({a} + k) - lgamma({a}) + lgamma({b} + k) - lgamma({b}) "
       "- lgamma({c} + k) + lgamma({c}) - lgamma(k + 1.0) + k * ln({z}))))")


def _hyp(weeks):
    z = f"({weeks}::DOUBLE / ({ALPHA} + age + {weeks}::DOUBLE))"
    return (f"greatest(0, ({A} + {B} + x - 1) / ({A} - 1) * (1 - pow(1 - {z}, {R} + x) * "
            + HYP.format(a=f"({R} + x)", b=f"({B} + x)", c=f"({A} + {B} + x - 1)", z=z) + ") * alive)")


VIEWS = {
    "v_life": """
        SELECT v.tenant_id, customer_id, count(*) AS n_orders, count(*) - 1 AS x,
               date_diff('second', min(placed_at), max(placed_at)) / 604800 AS t_x,
               date_diff('second', min(placed_at), any_value(top)) / 604800 AS age,
               greatest(CAST(sum(total_paise) AS BIGINT) / count(*), 1) AS mean_value
        FROM v_valid v JOIN (SELECT tenant_id, max(placed_at) AS top FROM v_valid WHERE customer_id IS NOT NULL GROUP BY ALL) c
          ON c.tenant_id = v.tenant_id
        WHERE customer_id IS NOT NULL GROUP BY v.tenant_id, customer_id""",
    "v_alive": f"""
        SELECT *, CASE WHEN x = 0 THEN 1 ELSE 1 / (1 + {A} / ({B} + x - 1) * pow(({ALPHA} + age) / ({ALPHA} + t_x), {R} + x)) END AS alive
        FROM v_life""",
    "v_expected": f"SELECT *, {_hyp('90.0 / 7')} AS expected_orders_90d, {_hyp('365.0 / 7')} AS expected_12m FROM v_alive",
    "v_scaled": """
        SELECT tenant_id, n_orders AS n, mean_value / greatest(avg(mean_value) OVER (PARTITION BY tenant_id), 1e-9) AS m FROM v_life WHERE x > 0""",
    "v_repeaters": "SELECT tenant_id, count(*) AS customers, count(*) FILTER (x > 0) AS repeaters FROM v_life GROUP BY ALL",
    "v_cut": """
        SELECT tenant_id, max(placed_at) - INTERVAL 182 DAY AS cutoff FROM v_valid WHERE customer_id IS NOT NULL GROUP BY ALL""",
    "v_shadow": """
        SELECT tenant_id, horizons, count(*) AS n, count(DISTINCT gone) AS kinds FROM (
          SELECT v.tenant_id, customer_id, horizons,
                 count(*) FILTER (placed_at >= c.at AND placed_at <= c.at + INTERVAL 182 DAY) = 0 AS gone
          FROM v_valid v JOIN (SELECT tenant_id, horizons, max(placed_at) - to_days(182 * horizons) AS at
                               FROM v_valid, (VALUES (1), (2)) h(horizons) WHERE customer_id IS NOT NULL GROUP BY tenant_id, horizons) c ON c.tenant_id = v.tenant_id
          WHERE customer_id IS NOT NULL GROUP BY v.tenant_id, customer_id, horizons HAVING count(*) FILTER (placed_at < c.at) > 1)
        GROUP BY tenant_id, horizons""",
    "v_past": """
        SELECT v.*, cutoff FROM v_valid v JOIN v_cut c ON c.tenant_id = v.tenant_id
        WHERE customer_id IS NOT NULL AND placed_at < cutoff""",
}

QUERIES = {
    "bgnbd_summary": lambda t: r6(lifetime.bgnbd_summary(t.order_headers)),
    "bgnbd_loglik": _bgnbd_loglik,
    "bgnbd_fit": _bgnbd_fit,
    "bgnbd_p_alive": lambda t: r6(lifetime.bgnbd_summary(t.order_headers).select(
        "tenant_id", "customer_id", lifetime.p_alive(*_args()).alias("p_alive"))),
    "bgnbd_expected_orders": lambda t: r6(_expected(t).select(
        "tenant_id", "customer_id", "expected_orders_90d", "expected_12m")),
    "gamma_gamma_loglik": _value_loglik,
    "gamma_gamma_fit": _gamma_fit,
    "gamma_gamma_value": lambda t: lifetime.bgnbd_summary(t.order_headers).select(
        "tenant_id", "customer_id", F.round(lifetime.expected_value(
            F.col("n_orders"), F.col("mean_value"), F.lit(P), F.lit(Q), F.lit(V)), 4).alias("expected_value")),
    "ltv_12m": _ltv,
    "independence_check": lambda t: r6(lifetime.independence(lifetime.bgnbd_summary(t.order_headers))),
    "churn_bands": lambda t: lifetime.bgnbd_summary(t.order_headers).groupBy(
        "tenant_id", churn_band(lifetime.p_alive(*_args())).alias("churn_band")).agg(F.count(F.lit(1)).alias("customers")),
    "churn_features": lambda t: r6(_features(t)),
    "churn_labels": lambda t: churn.churn_labels(churn.cutoffs(t.order_headers, 1), t.order_headers),
    "churn_shadow_model": _shadow,
    "churn_first_cut": _first_cut,
    "churn_auc_of_recency": _auc_of_recency,
    "predictions_upsert": _upserted,
    "ml_report": lambda t: lifetime.ml_report(t.predictions),
    "run_models": _run_models,
    "model_status": lambda t: lifetime.model_status(*lifetime.fit_models(t.order_headers)),
}

SQL = {
    "bgnbd_summary": """SELECT * REPLACE (round(t_x, 6) AS t_x, round(age, 6) AS age, round(mean_value, 6) AS mean_value) FROM v_life""",
    "bgnbd_p_alive": "SELECT tenant_id, customer_id, round(alive, 6) AS p_alive FROM v_alive",
    "bgnbd_expected_orders": """SELECT tenant_id, customer_id, round(expected_orders_90d, 6) AS expected_orders_90d,
        round(expected_12m, 6) AS expected_12m FROM v_expected""",
    "gamma_gamma_value": f"""SELECT tenant_id, customer_id, round({P} * ({V} + n_orders * mean_value) / ({P} * n_orders + {Q} - 1), 4) AS expected_value
        FROM v_life""",
    "ltv_12m": f"""
        SELECT tenant_id, customer_id, CAST(round_even(least(ltv, quantile_cont(ltv, 0.99) OVER (PARTITION BY tenant_id)), 0) AS BIGINT) AS ltv_12m_paise
        FROM (SELECT *, expected_12m * pow(1.1::DOUBLE, -0.5) * CASE WHEN n_orders > 1
                THEN {P} * ({V} + n_orders * mean_value) / ({P} * n_orders + {Q} - 1) ELSE {P} * {V} / ({Q} - 1) END AS ltv FROM v_expected)""",
    "independence_check": """
        SELECT tenant_id, round(corr(n_orders, mean_value), 6) AS correlation, count(*) AS repeaters,
               abs(corr(n_orders, mean_value)) > 0.3 AS strained FROM v_life WHERE x > 0 GROUP BY ALL""",
    "churn_bands": """
        SELECT tenant_id, CASE WHEN alive >= 0.65 THEN 'low' WHEN alive >= 0.35 THEN 'medium' ELSE 'high' END AS churn_band,
               count(*) AS customers FROM v_alive GROUP BY ALL""",
    "churn_features": """
        SELECT b.tenant_id, b.customer_id, round(date_diff('second', last_at, cutoff) / 604800, 6) AS recency_weeks,
               CAST(n AS DOUBLE) AS frequency, round(spent / n, 6) AS monetary_paise,
               round(date_diff('second', first_at, cutoff) / 604800, 6) AS tenure_weeks,
               CAST(coalesce(kinds, 0) AS DOUBLE) AS category_breadth, round(CASE WHEN gross = 0 THEN 0 ELSE off / gross END, 6) AS discount_share,
               CAST(EXISTS (SELECT 1 FROM t_shipments s JOIN t_heads h ON h.order_id = s.order_id
                            WHERE rto AND h.customer_id = b.customer_id AND coalesce(rto_at, delivered_at, shipped_at) < cutoff) AS DOUBLE) AS rto_flag,
               CAST(EXISTS (SELECT 1 FROM t_tickets k WHERE k.customer_id = b.customer_id AND opened_at < cutoff) AS DOUBLE) AS ticket_flag,
               round(coalesce(opens / sends, 0), 6) AS open_rate, round(coalesce(clicks / sends, 0), 6) AS click_rate
        FROM (SELECT tenant_id, customer_id, any_value(cutoff) AS cutoff, min(placed_at) AS first_at, max(placed_at) AS last_at, count(*) AS n,
                     CAST(sum(total_paise) AS BIGINT) AS spent, CAST(sum(discount_paise) AS BIGINT) AS off,
                     CAST(sum(subtotal_paise) AS BIGINT) AS gross FROM v_past GROUP BY tenant_id, customer_id) b
        LEFT JOIN (SELECT p.customer_id, count(DISTINCT coalesce(product_type, 'unknown')) AS kinds
                   FROM v_past p JOIN t_items i ON i.order_id = p.order_id
                   LEFT JOIN t_products d ON d.tenant_id = i.tenant_id AND d.product_id = i.product_id GROUP BY ALL) k ON k.customer_id = b.customer_id
        LEFT JOIN (SELECT customer_id, count(*) AS sends, count(*) FILTER (opened_at < cutoff) AS opens, count(*) FILTER (clicked_at < cutoff) AS clicks
                   FROM t_messages m JOIN v_cut c ON c.tenant_id = m.tenant_id WHERE sent_at < cutoff GROUP BY ALL) m ON m.customer_id = b.customer_id""",
    "churn_labels": """
        SELECT tenant_id, customer_id, CAST(CASE WHEN count(*) FILTER (placed_at >= cutoff AND placed_at <= cutoff + INTERVAL 182 DAY) = 0 THEN 1 ELSE 0 END AS INTEGER)
                 AS churned
        FROM (SELECT v.*, cutoff FROM v_valid v JOIN v_cut c ON c.tenant_id = v.tenant_id WHERE customer_id IS NOT NULL)
        GROUP BY tenant_id, customer_id HAVING count(*) FILTER (placed_at < cutoff) > 1""",
    "predictions_upsert": "SELECT * FROM t_predictions",
    "ml_report": """
        SELECT tenant_id, model_version, scored_on, count(*) AS customers_scored, count(*) FILTER (churn_band = 'high') AS band_high,
               count(*) FILTER (churn_band = 'medium') AS band_medium, count(*) FILTER (churn_band = 'low') AS band_low
        FROM t_predictions GROUP BY ALL""",
    "bgnbd_loglik": _bgnbd_sql(),
    "gamma_gamma_loglik": _value_sql(),
    "bgnbd_fit": "SELECT *, true AS converged, true AS optimal FROM v_repeaters WHERE repeaters >= 10",
    "gamma_gamma_fit": "SELECT *, true AS converged, true AS optimal FROM v_repeaters WHERE repeaters >= 10",
    "run_models": """
        SELECT tenant_id, customers, CAST(0 AS BIGINT) AS missing, CAST(0 AS BIGINT) AS out_of_range, CAST(0 AS BIGINT) AS wrong_band
        FROM v_repeaters WHERE repeaters >= 10""",
    "model_status": """
        SELECT *, CASE WHEN repeaters < 10 THEN 'skipped' ELSE 'scored' END AS status,
               CASE WHEN repeaters < 10 THEN 'fewer than 10 repeat buyers' END AS reason FROM v_repeaters""",
    "churn_shadow_model": """
        SELECT coalesce(a.tenant_id, b.tenant_id) AS tenant_id, coalesce(a.n, 0) AS trained_on, coalesce(b.n, 0) AS judged_on,
               coalesce(a.n >= 30 AND b.n >= 30 AND a.kinds = 2 AND b.kinds = 2, false) AS eligible,
               CASE WHEN a.n >= 30 AND b.n >= 30 AND a.kinds = 2 AND b.kinds = 2 THEN b.n ELSE 0 END AS scored, true AS auc_fits
        FROM (SELECT * FROM v_shadow WHERE horizons = 2) a FULL JOIN (SELECT * FROM v_shadow WHERE horizons = 1) b ON a.tenant_id = b.tenant_id""",
}
VIEWS["v_features"], VIEWS["v_labels"] = SQL["churn_features"], SQL["churn_labels"]
VIEWS["v_labelled"] = "SELECT f.*, CAST(l.churned AS DOUBLE) AS y FROM v_features f JOIN v_labels l ON l.tenant_id = f.tenant_id AND l.customer_id = f.customer_id"
SQL["churn_auc_of_recency"] = """
        SELECT tenant_id, round((sum(place * y) - sum(y) * (sum(y) + 1) / 2) / nullif(sum(y) * (count(*) - sum(y)), 0), 6) AS auc
        FROM (SELECT tenant_id, y, rank() OVER (PARTITION BY tenant_id ORDER BY recency_weeks)
                     + (count(*) OVER (PARTITION BY tenant_id, recency_weeks) - 1) / 2 AS place FROM v_labelled) GROUP BY tenant_id"""
# Every row of the first tree has the same gradient but for its label, so counts of rows and labels are all that a cut needs.
VIEWS.update({
    "v_first_whole": """
        SELECT tenant_id, count(*) AS n, sum(y) AS ones, (sum(y) + 0.5::DOUBLE) / (count(*) + 1) AS p FROM v_labelled GROUP BY ALL""",
    "v_first_long": f"""
        SELECT tenant_id, y, unnest([{", ".join(churn.FEATURES)}]) AS value, unnest(range(0, {len(churn.FEATURES)})) AS feature FROM v_labelled""",
    "v_first_binned": """
        SELECT *, ((rank() OVER (PARTITION BY tenant_id, feature ORDER BY value) - 1) * 32) // count(*) OVER (PARTITION BY tenant_id, feature) AS bin FROM v_first_long""",
    "v_first_cells": """
        SELECT tenant_id, feature, bin, min(value) AS first_value, count(*) AS n, sum(y) AS ones FROM v_first_binned GROUP BY ALL""",
    "v_first_cuts": """
        SELECT c.tenant_id, feature, bin, p, w.n AS n, w.ones AS ones, sum(c.n) OVER upto AS nl, sum(c.ones) OVER upto AS ol,
                        lead(first_value) OVER (PARTITION BY c.tenant_id, feature ORDER BY bin) AS next_value
                 FROM v_first_cells c JOIN v_first_whole w ON w.tenant_id = c.tenant_id WINDOW upto AS (PARTITION BY c.tenant_id, feature ORDER BY bin)""",
    "v_first_sides": """
        SELECT *, nl * p - ol AS gl, (n - nl) * p - (ones - ol) AS gr, nl * p * (1 - p) + 1 AS hl, (n - nl) * p * (1 - p) + 1 AS hr,
                         n * p - ones AS g, n * p * (1 - p) + 1 AS h FROM v_first_cuts""",
    "v_first_best": """
        SELECT *, row_number() OVER (PARTITION BY tenant_id ORDER BY round(gl * gl / hl + gr * gr / hr, 7) DESC, feature, bin) AS place FROM v_first_sides
                 WHERE nl >= 10 AND n - nl >= 10 AND gl * gl / hl + gr * gr / hr > g * g / h""",
})
SQL["churn_first_cut"] = """
        SELECT w.tenant_id, round(ln(w.p / (1 - w.p)), 6) AS base, CAST(feature AS INTEGER) AS feature, next_value AS goes_right_from,
               round(CASE WHEN place IS NULL THEN -(w.n * w.p - w.ones) / (w.n * w.p * (1 - w.p) + 1) ELSE -gl / hl END * 0.4::DOUBLE, 6) AS left_value,
               round(CASE WHEN place IS NULL THEN -(w.n * w.p - w.ones) / (w.n * w.p * (1 - w.p) + 1) ELSE -gr / hr END * 0.4::DOUBLE, 6) AS right_value
        FROM v_first_whole w LEFT JOIN v_first_best b ON b.tenant_id = w.tenant_id AND place = 1"""
