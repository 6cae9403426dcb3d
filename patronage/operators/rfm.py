"""Recency, frequency and monetary quintiles with tie-aware ranks."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from patronage.functions import day_gap, rfm_segment
from patronage.operators.orders import CUSTOMER
from patronage.operators.scale import ranked_values


MEASURES = ("r", "f", "m")


def quintile_cuts(base: DataFrame) -> DataFrame:
    """Per tenant and measure, the lowest value that reaches quintile 2, 3, 4 and 5.

    A quintile is 1 + floor(5 * percent rank), at most 5; the percent rank counts
    strictly lower values, so equal values share a quintile. Recency counts
    backwards, so that more is better for all three measures. Columns `r2`..`m5`.
    """
    listed = F.array(*[F.struct(F.lit(m).alias("measure"), F.col(m).cast("long").alias("value")) for m in MEASURES])
    values = base.select("tenant_id", F.explode(listed).alias("v")).select("tenant_id", "v.*")
    q = F.when(F.col("total") == 1, F.lit(1)).otherwise(
        F.least(F.lit(5), 1 + F.floor(5 * F.col("below") / (F.col("total") - 1)))
    )
    return (
        ranked_values(values, ["tenant_id", "measure"], "value")
        .withColumn("q", q)
        .groupBy("tenant_id")
        .agg(*[
            F.min(F.when((F.col("measure") == m) & (F.col("q") >= k), F.col("value"))).alias(f"{m}{k}")
            for m in MEASURES for k in (2, 3, 4, 5)
        ])
    )


def _quintile(measure: str) -> Column:
    reached = [F.coalesce((F.col(measure) >= F.col(f"{measure}{k}")).cast("int"), F.lit(0)) for k in (2, 3, 4, 5)]
    return reduce(lambda a, b: a + b, reached, F.lit(1)).cast("int")


def rfm_scored(orders: DataFrame) -> DataFrame:
    """Customer grain: recency days, frequency, monetary value and their quintiles.

    Ranking needs four cut values per tenant and measure and nothing else, so
    customers are never sorted and never joined to their ranks.
    """
    valid = orders.where(F.col("cancelled_at").isNull())
    clock = valid.groupBy("tenant_id").agg(F.to_date(F.max("placed_at")).alias("as_of"))
    base = (
        valid.where(F.col("customer_id").isNotNull())
        .groupBy(*CUSTOMER)
        .agg(
            F.max("placed_at").alias("last_at"),
            F.count(F.lit(1)).cast("int").alias("f"),
            F.sum("total_paise").alias("m"),
        )
        .join(clock, "tenant_id")
        .withColumn("recency_days", day_gap(F.col("last_at"), F.col("as_of")))
        .withColumn("r", -F.col("recency_days"))
    )
    return base.join(quintile_cuts(base), "tenant_id").select(
        *CUSTOMER, "recency_days", F.col("f").alias("frequency"), F.col("m").alias("monetary_paise"), "as_of",
        *[_quintile(m).alias(f"{m}_quintile") for m in MEASURES],
    )


def rfm_current(orders: DataFrame, dim_customers: DataFrame) -> DataFrame:
    """The segment mart: one row per customer with a valid order and a live record."""
    return (
        rfm_scored(orders)
        .withColumn("rfm_segment", rfm_segment(F.col("r_quintile"), F.col("f_quintile")))
        .join(dim_customers.select(*CUSTOMER, "lifecycle_stage", "whatsapp_opted_in"), CUSTOMER)
        .select(
            "tenant_id", "customer_id", "recency_days", "frequency", "monetary_paise",
            "r_quintile", "f_quintile", "m_quintile", "rfm_segment", "lifecycle_stage",
            "whatsapp_opted_in", "as_of",
        )
    )
