"""Four ways revenue leaks away, and their monthly union."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from patronage.functions import month_gap, month_of
from patronage.operators.orders import CUSTOMER, share
from patronage.operators.retention import rto_orders

SETTLED = ("paid", "partially_refunded", "refunded")
ORDER = ["tenant_id", "order_id"]
MONTH = ["tenant_id", "month"]


def leak_rto_cod(orders: DataFrame, shipments: DataFrame) -> DataFrame:
    """Cash-on-delivery orders that came back: full value, in the month they did."""
    cod = orders.where("cod").select(*ORDER, "placed_at", "total_paise")
    return (
        rto_orders(shipments).join(cod, ORDER)
        .groupBy("tenant_id", month_of(F.coalesce("rto_at", "shipped_at", "placed_at")).alias("month"))
        .agg(F.sum("total_paise").alias("amount_paise"), F.count(F.lit(1)).alias("orders_affected"))
    )


def leak_failed_payments(payments: DataFrame, orders: DataFrame) -> DataFrame:
    """Orders that were never paid lose their largest failed attempt.

    Booked in the month of the last attempt. A failed attempt with no order at
    all counts by itself.
    """
    failed = payments.where("status = 'failed'")
    captured = payments.where("status = 'captured'").select(*ORDER)
    open_orders = orders.where(~F.col("financial_status").isin(*SETTLED)).select(*ORDER)
    unpaid = (
        failed.where(F.col("order_id").isNotNull())
        .groupBy(*ORDER)
        .agg(F.max("amount_paise").alias("lost"), F.max("occurred_at").alias("at"))
        .join(open_orders, ORDER, "left_semi")
        .join(captured, ORDER, "left_anti")
        .select("tenant_id", "lost", "at")
    )
    loose = failed.where(F.col("order_id").isNull()).select(
        "tenant_id", F.col("amount_paise").alias("lost"), F.col("occurred_at").alias("at")
    )
    return (
        unpaid.unionByName(loose)
        .groupBy("tenant_id", month_of("at").alias("month"))
        .agg(F.sum("lost").alias("amount_paise"), F.count(F.lit(1)).alias("orders_affected"))
    )


def leak_discount_abuse(orders: DataFrame) -> DataFrame:
    """Discount beyond 30% of the subtotal, in whole paise."""
    excess = F.expr("discount_paise - (subtotal_paise * 3) div 10")
    return (
        orders.where(F.col("cancelled_at").isNull() & (F.col("subtotal_paise") > 0))
        .withColumn("excess", excess)
        .where("excess > 0")
        .groupBy("tenant_id", month_of("placed_at").alias("month"))
        .agg(F.sum("excess").alias("amount_paise"), F.count(F.lit(1)).alias("orders_affected"))
    )


def leak_preventable_churn(retention: DataFrame) -> DataFrame:
    """Repeat customers slipping away, each once, at their monthly run rate.

    Booked in a customer's latest slipping month; the rate is lifetime revenue
    over the months since acquisition, both ends counted.
    """
    slipping = retention.where((F.col("lifecycle_stage") == "slipping") & (F.col("cumulative_orders") >= 2))
    latest = slipping.groupBy(*CUSTOMER).agg(
        F.max(F.struct("month", "cumulative_revenue_paise", "acquisition_month")).alias("s")
    )
    months = month_gap(F.col("s.acquisition_month"), F.col("s.month")) + 1
    rate = latest.select(
        "tenant_id", F.col("s.month").alias("month"),
        F.col("s.cumulative_revenue_paise").alias("revenue"), months.alias("months"),
    )
    return rate.groupBy(*MONTH).agg(
        F.sum(F.expr("revenue div months")).alias("amount_paise"),
        F.lit(0).cast("long").alias("orders_affected"),
    )


def monthly_revenue(orders: DataFrame) -> DataFrame:
    return (
        orders.where(F.col("cancelled_at").isNull())
        .groupBy("tenant_id", month_of("placed_at").alias("month"))
        .agg(F.sum("total_paise").alias("revenue"))
    )


def leak_facts(
    orders: DataFrame, payments: DataFrame, shipments: DataFrame, retention: DataFrame
) -> DataFrame:
    """All leaks by month and type with their share of the month's revenue."""
    parts = {
        "rto_cod": leak_rto_cod(orders, shipments),
        "failed_payments": leak_failed_payments(payments, orders),
        "discount_abuse": leak_discount_abuse(orders),
        "preventable_churn": leak_preventable_churn(retention),
    }
    every = None
    for name, part in parts.items():
        named = part.withColumn("leak_type", F.lit(name))
        every = named if every is None else every.unionByName(named)
    return (
        every.where("amount_paise > 0")
        .join(monthly_revenue(orders), MONTH, "left")
        .select(
            "tenant_id", "month", "leak_type", "amount_paise",
            F.col("orders_affected").cast("int").alias("orders_affected"),
            share(F.col("amount_paise"), F.coalesce("revenue", F.lit(0))).alias("revenue_share"),
        )
    )
