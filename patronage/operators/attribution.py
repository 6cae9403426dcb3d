"""Which message gets the credit for an order, and other as-of questions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from patronage.operators.scale import running

CLICK_DAYS = 7


def latest_before(
    asks: DataFrame, facts: DataFrame, keys: list[str], ask_at: str, fact_at: str,
    payload: list[Column], name: str,
) -> DataFrame:
    """As-of join: each ask gets the newest fact of its key at or before it.

    `payload` fields order facts of the same instant, highest wins, and come
    back in the struct `name` behind its `at` field. One pass over both sides
    together: no pairs are formed, and every key is cut by the hour, a crowded hour further.
    Rows of one instant are told apart by a hash, facts before asks.
    """
    entry = F.struct(F.col(fact_at).alias("at"), *payload)
    left = asks.select(
        *[F.col(k) for k in keys], F.col(ask_at).alias("__t"), F.lit(1).alias("__ask"),
        F.struct(*[F.col(c) for c in asks.columns]).alias("__row"),
    )
    right = facts.select(
        *[F.col(k) for k in keys], F.col(fact_at).alias("__t"), F.lit(0).alias("__ask"),
        entry.alias("__fact"),
    )
    both = left.unionByName(right, allowMissingColumns=True)
    seen = running(
        both.withColumn("__tie", F.xxhash64("__row", "__fact")), keys, F.date_trunc("hour", F.col("__t")), ["__t", "__ask", "__tie"],
        peaks={"__latest": F.col("__fact")},
    )
    return seen.where("__ask = 1").select("__row.*", F.col("__latest").alias(name))


def last_click(valid: DataFrame, messages: DataFrame, days: int = CLICK_DAYS, by_channel: bool = False) -> DataFrame:
    """Orders with the click they are credited to: the customer's last within `days`.

    Two clicks at the same instant: the higher campaign id wins. With
    `by_channel` an order may be credited once on each channel; without it
    clicks that belong to no campaign are left out.
    """
    orders = valid.where(F.col("customer_id").isNotNull()).select(
        "tenant_id", "customer_id", "order_id", "placed_at", "total_paise"
    )
    clicks = messages.where(F.col("clicked_at").isNotNull() & F.col("customer_id").isNotNull())
    keys = ["tenant_id", "customer_id"]
    if by_channel:
        keys.append("channel")
        channels = clicks.select("tenant_id", "customer_id", "channel").distinct()
        orders = orders.join(channels, ["tenant_id", "customer_id"])
    else:
        clicks = clicks.where(F.col("campaign_id").isNotNull())
        orders = orders.join(clicks.select(*keys).distinct(), keys, "left_semi")
    credited = latest_before(
        orders, clicks, keys, "placed_at", "clicked_at",
        [F.coalesce("campaign_id", F.lit(-1)).alias("campaign_id"), F.col("message_id")], "click",
    )
    fresh = F.col("click.at") >= F.col("placed_at") - F.make_dt_interval(F.lit(days))
    return credited.where(fresh).select(
        "tenant_id", "order_id", "customer_id", "placed_at", "total_paise",
        *(["channel"] if by_channel else [F.col("click.campaign_id").alias("campaign_id")]),
        F.col("click.at").alias("clicked_at"),
    )
