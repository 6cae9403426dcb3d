"""Orders as the marts see them, and what a customer's orders add up to."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from patronage.functions import lifecycle_now, whole_days
from patronage.operators.scale import running

CUSTOMER = ["tenant_id", "customer_id"]


def _numbered(orders: DataFrame, counted: Column) -> DataFrame:
    """Add `nth`, a counted order's place in its customer's history.

    Every order that is not counted is a group of its own, so guests neither
    need a pass of their own nor meet in one huge group. Counted orders share the
    value -1, not null, so that the buckets of a customer find each other.
    """
    alone = orders.withColumn("__alone", F.when(counted, F.lit(-1).cast("long")).otherwise(F.col("order_id")))
    return running(
        alone,
        [*CUSTOMER, "__alone"],
        F.date_trunc("hour", F.col("placed_at")),
        ["placed_at", "order_id"],
        sums={"nth": F.lit(1)},
    ).drop("__alone")


def numbered_orders(orders: DataFrame, indexed: bool = False) -> DataFrame:
    """All orders, cancelled ones included, with the `oi` that `valid_orders` gives the others."""
    if indexed:
        return orders.withColumn(
            "oi", F.when(F.col("customer_id").isNull(), F.coalesce("customer_order_index", F.lit(1)))
            .otherwise(F.col("customer_order_index")).cast("int")
        ).drop("customer_order_index")
    return (
        _numbered(orders, F.col("customer_id").isNotNull() & F.col("cancelled_at").isNull())
        .withColumn("oi", F.coalesce("customer_order_index", "nth").cast("int"))
        .drop("nth", "customer_order_index")
    )


def valid_orders(orders: DataFrame, indexed: bool = False) -> DataFrame:
    """Orders that were not cancelled, with `oi`, the order's place in its customer's history.

    A stored index wins; else the place is counted; a guest order is always a
    first. With `indexed` the caller states that every known customer's valid
    order carries its index, and nothing has to be counted.
    """
    return numbered_orders(orders.where(F.col("cancelled_at").isNull()), indexed)


def order_index(orders: DataFrame) -> DataFrame:
    """The index each order should store: 1.. per customer, null if cancelled or guest."""
    counted = F.col("cancelled_at").isNull() & F.col("customer_id").isNotNull()
    return (
        _numbered(orders.drop("customer_order_index"), counted)
        .withColumn("customer_order_index", F.when(counted, F.col("nth")).cast("int"))
        .drop("nth")
    )


def data_clock(orders: DataFrame) -> DataFrame:
    """Newest order time per tenant, cancelled and guest orders included."""
    return orders.groupBy("tenant_id").agg(F.max("placed_at").alias("as_of"))


def customer_stats(orders: DataFrame) -> DataFrame:
    """Counts, spend, first and last order and live stage of every customer that ordered.

    Cancelled orders count for nothing: a customer with only those is reset to
    zero and 'new'. Days are complete days before the tenant's newest order.
    """
    ok = F.col("cancelled_at").isNull()
    per = (
        orders.where(F.col("customer_id").isNotNull())
        .groupBy(*CUSTOMER)
        .agg(
            F.count(F.when(ok, 1)).cast("int").alias("orders_count"),
            F.coalesce(F.sum(F.when(ok, F.col("total_paise"))), F.lit(0)).alias("total_spent_paise"),
            F.min(F.when(ok, F.col("placed_at"))).alias("first_order_at"),
            F.max(F.when(ok, F.col("placed_at"))).alias("last_order_at"),
        )
    )
    days = whole_days(F.col("last_order_at"), F.col("as_of"))
    return per.join(data_clock(orders), "tenant_id").select(
        *CUSTOMER,
        "orders_count",
        "total_spent_paise",
        "first_order_at",
        "last_order_at",
        F.when(F.col("orders_count") == 0, "new")
        .otherwise(lifecycle_now(F.col("orders_count"), days))
        .alias("lifecycle_stage"),
    )


def share(part: Column, whole: Column) -> Column:
    """part / whole as a double, 0 when the whole is 0."""
    return F.when(whole == 0, F.lit(0.0)).otherwise(part / whole.cast("double"))
