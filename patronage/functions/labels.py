"""Labels a customer carries: segment, lifecycle stage, risk band, score band."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The names and the boundaries of segments, stages and bands in this module.


def rfm_segment(r: Column, f: Column) -> Column:
    """Ten segments from the recency and frequency quintiles; first match wins."""
    return (
        F.when((r >= 4) & (f >= 4), "champions")
        .when((r >= 3) & (f >= 4), "loyal")
        .when((r == 1) & (f >= 4), "cant_lose")
        .when((r <= 2) & (f >= 3), "at_risk")
        .when((r >= 4) & f.between(2, 3), "potential_loyalist")
        .when((r >= 4) & (f == 1), "new")
        .when((r == 3) & (f <= 2), "promising")
        .when((r == 3) & (f == 3), "needs_attention")
        .when((r == 2) & (f <= 2), "about_to_sleep")
        .otherwise("hibernating")
    )


def lifecycle_now(orders: Column, days_since_last: Column) -> Column:
    """Stage of a live customer. Four orders keep one loyal until day 120."""
    return (
        F.when((orders >= 4) & (days_since_last < 120), "loyal")
        .when((days_since_last < 90) & (orders >= 2), "active")
        .when(days_since_last < 90, "new")
        .when(days_since_last <= 180, "slipping")
        .when(days_since_last <= 365, "dormant")
        .otherwise("lost")
    )


def lifecycle_at_month_end(orders_so_far: Column, days_since_last: Column) -> Column:
    """The same ladder read at a month's last day; unknown days count as recent."""
    return F.when(
        days_since_last.isNull(),
        F.when(orders_so_far >= 4, "loyal").when(orders_so_far >= 2, "active").otherwise("new"),
    ).otherwise(lifecycle_now(orders_so_far, days_since_last))


def churn_band(p_alive: Column) -> Column:
    return F.when(p_alive < 0.35, "high").when(p_alive < 0.65, "medium").otherwise("low")


def score_band(value: Column) -> Column:
    """0-40, 40-70 and 70-100 of a health score."""
    return F.when(value < 40, "leaking").when(value < 70, "building").otherwise("compounding")
