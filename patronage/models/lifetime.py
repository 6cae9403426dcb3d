"""Buying and value of customers: BG/NBD, Gamma-Gamma and twelve-month value.

Fader, Hardie and Lee (2005) for the purchase process, Fader and Hardie (2013)
for order value. Times are weeks: `x` repeat orders, `t_x` first to last order,
`age` first order to the tenant's newest.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from patronage.functions import churn_band
from patronage.models.fitting import LOG_HIGH, LOG_LOW, PENALTY, STEP, exact_sum, fit, stencil, summed, summed_slopes, total, total_slopes
from patronage.models.numeric import (
    buying_by_count, buying_by_count_slopes, buying_by_history, buying_by_history_slopes, lapse_log_odds, orders_while_alive, value_by_count,
    value_by_count_slopes, value_by_mean, value_by_mean_slopes,
)
from patronage.operators.orders import CUSTOMER
from patronage.operators.scale import quantile, ranked_values
from patronage.session import settle

VERSION = "bgnbd-0.1+palive-bands-0.1"
MIN_REPEATERS = 10
WEEK = 7.0 * 86400.0
DISCOUNT_12M = 1.10 ** -0.5
CAP_QUANTILE = 0.99
# Where the fits start, in logs.
BGNBD_START = np.zeros(4)
GAMMA_START = np.log([1.0, 2.0, 1.0])
BGNBD = ["r", "alpha", "a", "b"]
GAMMA = ["p", "q", "v"]


def _weeks(start: Column, end: Column) -> Column:
    return F.timestamp_diff("MICROSECOND", start, end) / F.lit(1e6) / F.lit(WEEK)


def bgnbd_summary(orders: DataFrame) -> DataFrame:
    """Per customer: orders, repeats, recency and age in weeks, mean order value (at least 1)."""
    valid = orders.where(
        F.col("customer_id").isNotNull() & F.col("cancelled_at").isNull() & F.col("placed_at").isNotNull()
    )
    clock = valid.groupBy("tenant_id").agg(F.max("placed_at").alias("as_of"))
    return (
        valid.groupBy(*CUSTOMER)
        .agg(
            F.count(F.lit(1)).alias("n_orders"),
            F.min("placed_at").alias("first_at"),
            F.max("placed_at").alias("last_at"),
            F.sum("total_paise").alias("spent"),
        )
        .join(clock, "tenant_id")
        .select(
            *CUSTOMER, "n_orders", (F.col("n_orders") - 1).alias("x"),
            _weeks(F.col("first_at"), F.col("last_at")).alias("t_x"),
            _weeks(F.col("first_at"), F.col("as_of")).alias("age"),
            F.greatest(F.col("spent") / F.col("n_orders"), F.lit(1.0)).alias("mean_value"),
        )
    )


# ------------------------------------------------------------------ BG/NBD


def enough_repeaters(summary: DataFrame) -> DataFrame:
    """Tenants with the ten repeat buyers a fit needs; the others are skipped."""
    return (
        summary.groupBy("tenant_id").agg(F.count_if(F.col("x") > 0).alias("repeaters"))
        .where(F.col("repeaters") >= MIN_REPEATERS).select("tenant_id")
    )


def _histories(summary: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows per history, and per number of repeats with how many have it: what depends on that alone is evaluated once per number."""
    rows = settle(summary.select("tenant_id", F.col("x").cast("double").alias("x"), "t_x", "age", F.lit(1.0).alias("n")))
    return rows, settle(rows.groupBy("tenant_id", "x").agg(F.sum("n").alias("n")))


def bgnbd_slopes(summary: DataFrame):
    """Exact sums of the log-likelihood and its derivatives at one point (logs of r, alpha, a, b) per tenant."""
    rows, counts = _histories(summary)
    return lambda points: total_slopes(
        BGNBD, summed_slopes(counts, points, ["x"], buying_by_count_slopes, BGNBD), summed_slopes(rows, points, ["x", "t_x", "age"], buying_by_history_slopes, BGNBD))


def bgnbd_loglik(summary: DataFrame):
    """Summed log-likelihood of trial vectors (logs of r, alpha, a, b) per tenant."""
    rows, counts = _histories(summary)
    x, t_x, age = F.col("x"), F.col("t_x"), F.col("age")

    def evaluate(points: DataFrame) -> DataFrame:
        return total(
            summed(counts, points, lambda r, alpha, a, b: buying_by_count(x, r, a, b), BGNBD),
            summed(rows, points, lambda r, alpha, a, b: buying_by_history(x, t_x, age, r, alpha, a, b), BGNBD),
        )

    return evaluate


def fit_bgnbd(summary: DataFrame) -> DataFrame:
    """(r, alpha, a, b) per tenant with enough repeaters, beside log_likelihood, passes and converged."""
    tenants = enough_repeaters(summary)
    return fit(tenants, BGNBD_START, bgnbd_slopes(summary.join(tenants, "tenant_id", "left_semi")), BGNBD)


def p_alive(x: Column, t_x: Column, age: Column, r: Column, alpha: Column, a: Column, b: Column) -> Column:
    """Probability of still buying; 1 for a customer with a single order."""
    return F.when(x <= 0, 1.0).otherwise(1.0 / (1.0 + F.exp(lapse_log_odds(x, t_x, age, r, alpha, a, b))))


def expected_orders(
    x: Column, t_x: Column, age: Column, r: Column, alpha: Column, a: Column, b: Column, weeks: float
) -> Column:
    """Expected orders in the next `weeks`: those of a customer who is alive, times the chance of that.

    Alive, the chance of lapsing after an order is Beta(a, b + x) and the rate Gamma(r + x, alpha + age).
    """
    @F.pandas_udf("double")
    def ahead(a: pd.Series, b: pd.Series, s: pd.Series, w: pd.Series) -> pd.Series:
        return pd.Series(orders_while_alive(*(c.to_numpy(dtype=float) for c in (a, b, s, w))))

    return ahead(a * F.lit(1.0), b + x, r + x, F.lit(float(weeks)) / (alpha + age)) * p_alive(x, t_x, age, r, alpha, a, b)


# ------------------------------------------------------------------ Gamma-Gamma


def _values(repeat: DataFrame) -> tuple[DataFrame, DataFrame]:
    rows = settle(repeat.select("tenant_id", F.col("n_orders").cast("double").alias("orders"), "scaled", F.lit(1.0).alias("n")))
    return rows, settle(rows.groupBy("tenant_id", "orders").agg(F.sum("n").alias("n")))


def gamma_gamma_slopes(repeat: DataFrame):
    """Exact sums of the log-likelihood and its derivatives at one point (logs of p, q, v) per tenant; `repeat` has n_orders and scaled."""
    rows, counts = _values(repeat)
    return lambda points: total_slopes(
        GAMMA, summed_slopes(counts, points, ["orders"], value_by_count_slopes, GAMMA), summed_slopes(rows, points, ["orders", "scaled"], value_by_mean_slopes, GAMMA))


def gamma_gamma_loglik(repeat: DataFrame):
    """Summed log-likelihood of trial vectors (logs of p, q, v) per tenant; `repeat` has n_orders and scaled."""
    rows, counts = _values(repeat)
    n, m = F.col("orders"), F.col("scaled")

    def evaluate(points: DataFrame) -> DataFrame:
        return total(
            summed(counts, points, lambda p, q, v: value_by_count(n, p, q), GAMMA),
            summed(rows, points, lambda p, q, v: value_by_mean(n, m, p, q, v), GAMMA),
        )

    return evaluate


def fit_gamma_gamma(summary: DataFrame) -> DataFrame:
    """(p, q, v) per tenant over repeat buyers, beside log_likelihood, passes and converged; fitted in units of the mean value."""
    tenants = enough_repeaters(summary)
    repeat, unit = scaled_values(summary.join(tenants, "tenant_id", "left_semi"))
    params = fit(tenants, GAMMA_START, gamma_gamma_slopes(repeat), GAMMA)
    return params.join(unit, "tenant_id").select("tenant_id", "p", "q", (F.col("v") * F.col("unit")).alias("v"), "log_likelihood", "passes", "converged")


def scaled_values(summary: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Repeat buyers with their mean value in units of the tenant's, and those units."""
    repeat = summary.where("x > 0")
    unit = repeat.groupBy("tenant_id").agg(F.greatest(exact_sum(F.col("mean_value")) / F.count("mean_value"), F.lit(1e-9)).alias("unit"))
    return repeat.join(unit, "tenant_id").withColumn("scaled", F.col("mean_value") / F.col("unit")), unit


def no_better_nearby(fitted: DataFrame, names: list[str], loglik, reach: float = 0.05) -> DataFrame:
    """(tenant_id, optimal): whether no vector of a fixed stencil around the fit has a higher penalised likelihood."""
    k = len(names)
    shifts = stencil(np.zeros(k)) / STEP * reach
    inside = lambda c: F.greatest(F.least(c, F.lit(LOG_HIGH)), F.lit(LOG_LOW))
    point = lambda shift: F.array(*[inside(F.log(n) + F.lit(float(d))) for n, d in zip(names, shift)])
    points = fitted.select("tenant_id", F.array(*[point(s) for s in shifts]).alias("points"))
    penalty = sum((F.exp(F.col("point")[i]) * F.exp(F.col("point")[i]) for i in range(k)), F.lit(0.0)) * PENALTY
    paid = points.select("tenant_id", F.posexplode("points").alias("trial", "point")).select("tenant_id", "trial", penalty.alias("paid"))
    value = loglik(points).join(paid, ["tenant_id", "trial"]).select("tenant_id", "trial", (F.col("ll") - F.col("paid")).alias("value"))
    own = F.max(F.when(F.col("trial") == 0, F.col("value")))
    slack = F.abs(own) * 1e-9  # fitted parameters are rounded
    return value.groupBy("tenant_id").agg((own + slack >= F.max("value")).alias("optimal"))


def expected_value(n: Column, m: Column, p: Column, q: Column, v: Column) -> Column:
    """Expected order value: the observed mean pulled towards the population's."""
    return p * (v + n * m) / (p * n + q - 1.0)


def independence(summary: DataFrame) -> DataFrame:
    """Correlation of order count and mean value among repeat buyers, and whether it strains the model."""
    corr = F.when(F.count(F.lit(1)) > 2, F.corr(F.col("n_orders").cast("double"), F.col("mean_value")))
    return summary.where("x > 0").groupBy("tenant_id").agg(
        F.coalesce(corr, F.lit(0.0)).alias("correlation"), F.count(F.lit(1)).alias("repeaters")
    ).withColumn("strained", F.abs("correlation") > 0.3)


# ------------------------------------------------------------------ predictions


def ltv_12m(df: DataFrame) -> DataFrame:
    """Add `ltv_12m_paise` to rows with `expected_12m`, the summary and p, q, v.

    Single buyers get the population's mean order value. Where q <= 1 that mean
    does not exist and the observed means are used. Capped per tenant at the
    99th percentile.
    """
    fine = F.col("q") > 1.0
    weighted = df.where("x > 0").groupBy("tenant_id").agg(
        (exact_sum(F.col("mean_value") * F.col("n_orders")) / F.sum("n_orders")).alias("plain_mean")
    )
    prior = F.when(fine, F.col("p") * F.col("v") / (F.col("q") - 1.0)).otherwise(F.col("plain_mean"))
    own = F.when(
        fine, expected_value(F.col("n_orders"), F.col("mean_value"), F.col("p"), F.col("q"), F.col("v"))
    ).otherwise(F.col("mean_value"))
    valued = df.join(weighted, "tenant_id", "left").withColumn(
        "ltv",
        F.col("expected_12m") * F.when(F.col("n_orders") >= 2, own).otherwise(prior) * F.lit(DISCOUNT_12M),
    ).drop("plain_mean")
    cap = quantile(ranked_values(valued, ["tenant_id"], "ltv"), ["tenant_id"], "ltv", CAP_QUANTILE, "cap")
    return (
        valued.join(cap, "tenant_id")
        .withColumn("ltv_12m_paise", F.bround(F.least("ltv", "cap")).cast("long"))
        .drop("ltv", "cap")
    )


def predict(summary: DataFrame, buying: DataFrame, value: DataFrame, scored_at: str) -> DataFrame:
    """A prediction per customer of every tenant both of whose fits converged."""
    params = buying.where("converged").select("tenant_id", *BGNBD).join(value.where("converged").select("tenant_id", *GAMMA), "tenant_id")
    args = [F.col(c) for c in ("x", "t_x", "age", *BGNBD)]
    rows = summary.join(params, "tenant_id").withColumns({
        "p_alive": p_alive(*args),
        "expected_orders_90d": expected_orders(*args, 90.0 / 7.0),
        "expected_12m": expected_orders(*args, 365.0 / 7.0),
    })
    at = F.lit(scored_at).cast("timestamp_ntz")
    return ltv_12m(settle(rows)).select(
        *CUSTOMER, "p_alive", "expected_orders_90d", "ltv_12m_paise",
        churn_band(F.col("p_alive")).alias("churn_band"), F.lit(VERSION).alias("model_version"),
        at.alias("scored_at"), F.to_date(at).alias("scored_on"),
    )


def model_status(summary: DataFrame, buying: DataFrame, value: DataFrame) -> DataFrame:
    """What became of every tenant with a customer: scored, or skipped and why.

    Columns: tenant_id, customers, repeaters, status (`scored` or `skipped`), reason (null when scored).
    """
    have = summary.groupBy("tenant_id").agg(F.count(F.lit(1)).alias("customers"), F.count_if(F.col("x") > 0).alias("repeaters"))
    fits = buying.select("tenant_id", F.col("converged").alias("buys")).join(
        value.select("tenant_id", F.col("converged").alias("values")), "tenant_id", "full")
    reason = (
        F.when(F.col("repeaters") < MIN_REPEATERS, F.lit(f"fewer than {MIN_REPEATERS} repeat buyers"))
        .when(~F.coalesce("buys", F.lit(False)), F.lit("purchase model did not converge"))
        .when(~F.coalesce("values", F.lit(False)), F.lit("value model did not converge"))
    )
    return have.join(fits, "tenant_id", "left").select(
        "tenant_id", "customers", "repeaters", F.when(reason.isNull(), "scored").otherwise("skipped").alias("status"), reason.alias("reason"))


def fit_models(orders: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Summary and both fits, settled."""
    summary = settle(bgnbd_summary(orders))
    return summary, settle(fit_bgnbd(summary)), settle(fit_gamma_gamma(summary))


def run_models(orders: DataFrame, scored_at: str) -> DataFrame:
    """Fit both models and score every customer; `model_status` tells which tenants were skipped."""
    return predict(*fit_models(orders), scored_at)


def ml_report(predictions: DataFrame) -> DataFrame:
    return predictions.groupBy("tenant_id", "model_version", "scored_on").agg(
        F.count(F.lit(1)).alias("customers_scored"),
        *[F.count_if(F.col("churn_band") == b).alias(f"band_{b}") for b in ("high", "medium", "low")],
    )
