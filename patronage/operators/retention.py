"""Cohorts and the customer-by-month history."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from patronage.functions import day_gap, lifecycle_at_month_end, month_gap, month_of
from patronage.operators.orders import CUSTOMER

def customer_months(valid: DataFrame) -> DataFrame:
    """Orders and revenue per customer and month, with the customer's first month.

    Guests come as customer null, one row per tenant and month, born null. The
    window sees customer-months, so at most one row per month of history.
    """
    months = valid.groupBy(*CUSTOMER, month_of("placed_at").alias("month")).agg(
        F.count(F.lit(1)).alias("n"),
        F.sum("total_paise").alias("revenue"),
        F.sum(F.when(F.col("oi") > 1, F.col("total_paise")).otherwise(0)).alias("repeat"),
        F.sum("discount_paise").alias("discount"),
    )
    born = F.min("month").over(Window.partitionBy(*CUSTOMER))
    return months.withColumn("born", F.when(F.col("customer_id").isNotNull(), born))


def cohort_retention(valid: DataFrame) -> DataFrame:
    """Cohort month by months since: who came back, and what repeats brought in.

    Only cells with an order exist. Orders collapse to customer-months first, so
    distinct customers are plain row counts, and a cohort's size is its month-0
    cell: everybody orders in the month they are born in.
    """
    cells = (
        customer_months(valid).where(F.col("customer_id").isNotNull())
        .groupBy("tenant_id", F.col("born").alias("cohort_month"),
                 month_gap(F.col("born"), F.col("month")).alias("months_since"))
        .agg(
            F.count(F.lit(1)).alias("active_customers"),
            F.sum("n").alias("n"),
            F.sum("repeat").alias("repeat_revenue_paise"),
        )
    )
    first = F.when(F.col("months_since") == 0, F.col("active_customers"))
    size = F.max(first).over(Window.partitionBy("tenant_id", "cohort_month"))
    return cells.withColumn("cohort_size", size).select(
        "tenant_id",
        "cohort_month",
        "months_since",
        F.col("cohort_size").cast("int").alias("cohort_size"),
        F.col("active_customers").cast("int").alias("active_customers"),
        (F.col("active_customers") / F.col("cohort_size")).alias("retention_rate"),
        "repeat_revenue_paise",
        (F.col("n") / F.col("active_customers")).alias("avg_orders_per_active"),
    )


def rto_orders(shipments: DataFrame) -> DataFrame:
    """One row per order that was returned to origin, however often it was shipped."""
    return (
        shipments.where("rto")
        .groupBy("tenant_id", "order_id")
        .agg(F.min("rto_at").alias("rto_at"), F.min("shipped_at").alias("shipped_at"))
    )


def retention_changes(
    orders: DataFrame, shipments: DataFrame, refunds: DataFrame, refund_fallback: bool = False
) -> DataFrame:
    """The months in which something happened to a customer, with running totals and `last`, the month before the next one."""
    owner = orders.select("tenant_id", "order_id", "customer_id", "placed_at")
    known = orders.where(F.col("cancelled_at").isNull() & F.col("customer_id").isNotNull())
    newest = known.groupBy("tenant_id").agg(F.trunc(F.to_date(F.max("placed_at")), "MM").alias("max_month"))
    sold = known.select(
        *CUSTOMER, month_of("placed_at").alias("month"), F.lit(1).alias("n"), F.col("total_paise").alias("revenue"),
        "placed_at",
    )
    returned = (
        rto_orders(shipments)
        .join(owner.where(F.col("customer_id").isNotNull()), ["tenant_id", "order_id"])
        .select(*CUSTOMER, month_of(F.coalesce("rto_at", "shipped_at", "placed_at")).alias("month"),
                F.lit(1).alias("rto_n"))
    )
    if refund_fallback:
        refunds = (
            refunds.withColumnRenamed("customer_id", "stated")
            .join(owner.select("tenant_id", "order_id", "customer_id"), ["tenant_id", "order_id"], "left")
            .withColumn("customer_id", F.coalesce("stated", "customer_id"))
        )
    paid_back = refunds.where(F.col("customer_id").isNotNull()).select(
        *CUSTOMER, month_of("processed_at").alias("month"), F.col("amount_paise").alias("refund_amt")
    )
    zero = lambda c: F.coalesce(F.sum(c), F.lit(0)).alias(c)
    busy = (
        sold.unionByName(returned, allowMissingColumns=True).unionByName(paid_back, allowMissingColumns=True)
        .groupBy(*CUSTOMER, "month")
        .agg(zero("n"), zero("revenue"), F.max("placed_at").alias("last_at"), zero("rto_n"), zero("refund_amt"))
    )
    line = Window.partitionBy(*CUSTOMER).orderBy("month")
    so_far = line.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    running = busy.select(
        "*",
        F.sum("n").over(so_far).alias("cum_n"),
        F.sum("revenue").over(so_far).alias("cum_revenue"),
        F.max("last_at").over(so_far).alias("last_order_at"),
        F.min(F.when(F.col("n") > 0, F.col("month"))).over(so_far).alias("acquisition_month"),
        F.lead("month").over(line).alias("next_month"),
    )
    last = F.least(F.add_months("next_month", -1), F.col("max_month"))
    return (
        running.where("cum_n > 0").join(newest, "tenant_id").where("month <= max_month").withColumn("last", last)
        .drop("last_at", "next_month", "max_month")
    )


def stretched(changes: DataFrame) -> DataFrame:
    """A row per customer and month out of `retention_changes`: each is repeated up to its `last` month, without a shuffle."""
    history = (
        changes
        .select("*", F.posexplode(F.sequence("month", "last", F.expr("INTERVAL 1 MONTH"))).alias("ahead", "at_month"))
        .withColumn("days", day_gap(F.col("last_order_at"), F.last_day("at_month")))
    )
    own = lambda c: F.when(F.col("ahead") == 0, F.col(c)).otherwise(0)
    return history.select(
        "tenant_id",
        "customer_id",
        F.col("at_month").alias("month"),
        own("n").cast("int").alias("orders_in_month"),
        own("revenue").alias("revenue_in_month_paise"),
        F.col("cum_n").cast("int").alias("cumulative_orders"),
        F.col("cum_revenue").alias("cumulative_revenue_paise"),
        lifecycle_at_month_end(F.col("cum_n"), F.col("days")).alias("lifecycle_stage"),
        F.col("days").alias("days_since_last_order"),
        (own("n") > 0).alias("is_active"),
        own("rto_n").cast("int").alias("rto_orders_in_month"),
        own("refund_amt").alias("refund_paise_in_month"),
        "acquisition_month",
    )


def retention_facts(
    orders: DataFrame, shipments: DataFrame, refunds: DataFrame, refund_fallback: bool = False
) -> DataFrame:
    """Every customer and month from acquisition to the tenant's newest month.

    Monthly and cumulative orders and revenue, the stage at month end, returns
    and refunds. Orders, returns and refunds collapse together to months in
    which something happened; running totals are taken over those, and each is
    then stretched to the month before the next, so the long spine is neither
    joined nor sorted. A refund without a customer is left out unless
    `refund_fallback` lets it take its order's.
    """
    return stretched(retention_changes(orders, shipments, refunds, refund_fallback))
