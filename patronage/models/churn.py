"""A churn classifier kept as a shadow: measured every run, never used for bands."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from patronage.models import boosting
from patronage.models.lifetime import WEEK
from patronage.operators.orders import CUSTOMER
from patronage.operators.scale import ranked_values
from patronage.session import settle

# Fixed values.
FEATURES = (
    "recency_weeks", "frequency", "monetary_paise", "tenure_weeks", "category_breadth",
    "discount_share", "rto_flag", "ticket_flag", "open_rate", "click_rate",
)
HORIZON_DAYS = 182
AUC_FLOOR = 0.65
MIN_LABELLED = 30


def cutoffs(orders: DataFrame, horizons: int) -> DataFrame:
    """The time per tenant that lies `horizons` label windows before its newest known order."""
    known = orders.where(F.col("customer_id").isNotNull() & F.col("cancelled_at").isNull())
    return known.groupBy("tenant_id").agg(
        (F.max("placed_at") - F.make_dt_interval(F.lit(horizons * HORIZON_DAYS))).alias("cutoff")
    )


def _weeks(start: Column, end: Column) -> Column:
    return F.timestamp_diff("MICROSECOND", start, end) / F.lit(1e6) / F.lit(WEEK)


def churn_features(
    at: DataFrame, orders: DataFrame, items: DataFrame, products: DataFrame, shipments: DataFrame,
    tickets: DataFrame, messages: DataFrame,
) -> DataFrame:
    """Ten features per customer with an order before the cutoff.

    Every row and every later timestamp of a row must lie before the cutoff to
    count: a message sent before it but opened after counts as not opened.
    """
    cut = at
    known = orders.where(F.col("customer_id").isNotNull())
    past = (
        known.where(F.col("cancelled_at").isNull()).join(cut, "tenant_id")
        .where(F.col("placed_at") < F.col("cutoff"))
    )
    base = past.groupBy(*CUSTOMER).agg(
        F.max("cutoff").alias("cutoff"), F.min("placed_at").alias("first_at"), F.max("placed_at").alias("last_at"),
        F.count(F.lit(1)).alias("n"), F.sum("total_paise").alias("spent"),
        F.sum(F.coalesce("discount_paise", F.lit(0))).alias("off"),
        F.sum(F.coalesce("subtotal_paise", F.lit(0))).alias("gross"),
    )
    order_key = ["tenant_id", "order_id"]
    # Orders and products have a row per key, so their sides of a partition are small and even: they are
    # hashed, and the many items stream past them and are not sorted.
    kinds = (
        items.select(*order_key, "product_id").join(past.select(*order_key, "customer_id").hint("shuffle_hash"), order_key)
        .join(products.select("tenant_id", "product_id", "product_type").hint("shuffle_hash"), ["tenant_id", "product_id"], "left")
        .select(*CUSTOMER, F.coalesce("product_type", F.lit("unknown")).alias("kind")).distinct()
        .groupBy(*CUSTOMER).agg(F.count(F.lit(1)).alias("kinds"))
    )
    returned = (
        shipments.where("rto").join(known.select(*order_key, "customer_id"), order_key).join(cut, "tenant_id")
        .where(F.coalesce("rto_at", "delivered_at", "shipped_at") < F.col("cutoff"))
        .groupBy(*CUSTOMER).agg(F.lit(1.0).alias("rto"))
    )
    asked = (
        tickets.where(F.col("customer_id").isNotNull()).join(cut, "tenant_id")
        .where(F.col("opened_at") < F.col("cutoff")).groupBy(*CUSTOMER).agg(F.lit(1.0).alias("ticket"))
    )
    before = lambda c: F.count_if(F.coalesce(F.col(c) < F.col("cutoff"), F.lit(False)))
    mail = (
        messages.where(F.col("customer_id").isNotNull()).join(cut, "tenant_id")
        .where(F.col("sent_at") < F.col("cutoff")).groupBy(*CUSTOMER)
        .agg(F.count(F.lit(1)).alias("sends"), before("opened_at").alias("opens"), before("clicked_at").alias("clicks"))
    )
    out = base
    for part in (kinds, returned, asked, mail):
        out = out.join(part.hint("shuffle_hash"), CUSTOMER, "left")
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    return out.select(
        *CUSTOMER,
        _weeks(F.col("last_at"), F.col("cutoff")).alias("recency_weeks"),
        F.col("n").cast("double").alias("frequency"),
        (F.col("spent") / F.col("n")).alias("monetary_paise"),
        _weeks(F.col("first_at"), F.col("cutoff")).alias("tenure_weeks"),
        zero(F.col("kinds").cast("double")).alias("category_breadth"),
        F.when(F.col("gross") != 0, F.col("off") / F.col("gross")).otherwise(0.0).alias("discount_share"),
        zero("rto").alias("rto_flag"),
        zero("ticket").alias("ticket_flag"),
        zero(F.col("opens") / F.col("sends")).alias("open_rate"),
        zero(F.col("clicks") / F.col("sends")).alias("click_rate"),
    )


def churn_labels(at: DataFrame, orders: DataFrame, horizon: int = HORIZON_DAYS) -> DataFrame:
    """1 when a customer with two or more orders before the cutoff places none within the horizon.

    An order exactly at the cutoff is an order after it.
    """
    placed, cut = F.col("placed_at"), F.col("cutoff")
    end = cut + F.make_dt_interval(F.lit(horizon))
    return (
        orders.where(F.col("customer_id").isNotNull() & F.col("cancelled_at").isNull())
        .join(at, "tenant_id").groupBy(*CUSTOMER)
        .agg(F.count_if(placed < cut).alias("before"), F.count_if((placed >= cut) & (placed <= end)).alias("after"))
        .where("before >= 2")
        .select(*CUSTOMER, F.when(F.col("after") > 0, 0).otherwise(1).alias("churned"))
    )


def ranked_auc(scored: DataFrame) -> DataFrame:
    """AUC per tenant from scores and labels by mean ranks, ties included; null without both labels."""
    ranks = ranked_values(scored, ["tenant_id"], "score").withColumn("rank", (F.col("below") + F.col("upto") + 1) / 2)
    placed = scored.groupBy("tenant_id", "score").agg(F.sum("label").alias("ones"), F.count(F.lit(1)).alias("n"))
    sums = placed.join(ranks, ["tenant_id", "score"]).groupBy("tenant_id").agg(
        F.sum(F.col("rank") * F.col("ones")).alias("won"), F.sum("ones").alias("p"), F.sum(F.col("n") - F.col("ones")).alias("q"))
    pairs = F.col("p") * F.col("q")
    return sums.select("tenant_id", F.when(pairs > 0, (F.col("won") - F.col("p") * (F.col("p") + 1) / 2) / pairs).alias("auc"))


def shadow_sets(tables: object) -> dict[str, DataFrame]:
    """Labelled customers with their features: `train` two horizons back, `judge` one."""
    orders = tables.fact_orders
    sets = {}
    for name, horizons in (("train", 2), ("judge", 1)):
        at = cutoffs(orders, horizons)
        features = churn_features(
            at, orders, tables.fact_order_items, tables.products, tables.fact_shipments,
            tables.fact_tickets, tables.fact_messages,
        )
        rows = features.join(churn_labels(at, orders), CUSTOMER)
        sets[name] = settle(rows.select(*CUSTOMER, *FEATURES, F.col("churned").cast("double").alias("label")))
    return sets


def shadow_scores(sets: dict[str, DataFrame], spec: boosting.Trees = boosting.Trees()) -> tuple[DataFrame, DataFrame]:
    """Label counts per tenant with `eligible`, and the judged customers of eligible tenants with label and score.

    All tenants' trees grow in the same passes; see `boosting`.
    """
    sizes = {
        name: df.groupBy("tenant_id").agg(F.count(F.lit(1)).alias(f"{name}_n"), F.count_distinct("label").alias(f"{name}_kinds"))
        for name, df in sets.items()
    }
    have = sizes["train"].join(sizes["judge"], "tenant_id", "full").na.fill(0)
    enough = F.lit(True)
    for name in sets:
        enough = enough & (F.col(f"{name}_n") >= MIN_LABELLED) & (F.col(f"{name}_kinds") == 2)
    have = settle(have.withColumn("eligible", enough))
    chosen = have.where("eligible").select("tenant_id")
    model = boosting.fit(sets["train"].join(chosen, "tenant_id", "left_semi"), FEATURES, "label", spec)
    scored = boosting.score(sets["judge"], model, FEATURES, spec)
    return have, settle(scored.select(*CUSTOMER, "label", "score"))


def churn_shadow(tables: object, spec: boosting.Trees = boosting.Trees()) -> DataFrame:
    """AUC per tenant: trained two horizons back, judged on the last one.

    A tenant with fewer than 30 labelled customers, or only one class, at either end is reported without an AUC.
    """
    have, scored = shadow_scores(shadow_sets(tables), spec)
    return have.join(ranked_auc(scored), "tenant_id", "left").select(
        "tenant_id", F.col("train_n").alias("trained_on"), F.col("judge_n").alias("judged_on"), "auc", (F.col("auc") >= AUC_FLOOR).alias("above_floor"))
