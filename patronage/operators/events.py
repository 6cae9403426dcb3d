"""Canonical events with deterministic ids, the closed vocabulary, and the PII-free tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from patronage.functions import whole_days

COLUMNS = [
    "event_id", "tenant_id", "event_name", "customer_id", "order_id", "message_id", "occurred_at", "source",
    "external_id", "amount_paise", "properties",
]

# Event name, category and the properties every event must carry.
VOCABULARY = {
    "customer_created": ("commerce", ("source_customer_id", "accepts_marketing")),
    "order_placed": ("commerce", ("order_id", "total_paise", "currency", "cod", "discount_paise", "customer_order_index")),
    "order_cancelled": ("commerce", ("order_id", "reason")),
    "order_fulfilled": ("logistics", ("order_id", "courier")),
    "order_delivered": ("logistics", ("order_id", "days_in_transit")),
    "order_rto": ("logistics", ("order_id", "cod", "courier")),
    "payment_captured": ("payment", ("order_id", "amount_paise", "gateway", "method")),
    "payment_failed": ("payment", ("order_id", "amount_paise", "failure_reason")),
    "order_refunded": ("payment", ("refund_id", "order_id", "amount_paise", "refund_type")),
    "message_sent": ("messaging", ("message_id", "campaign_id", "channel")),
    "message_delivered": ("messaging", ("message_id", "channel")),
    "message_opened": ("messaging", ("message_id", "channel")),
    "message_clicked": ("messaging", ("message_id", "channel")),
    "message_bounced": ("messaging", ("message_id", "channel")),
    "channel_opted_in": ("messaging", ("channel", "method")),
    "channel_opted_out": ("messaging", ("channel", "reason")),
    "ticket_opened": ("voice", ("ticket_id", "channel", "category")),
    "ticket_resolved": ("voice", ("ticket_id", "hours_to_resolve", "csat_score")),
    "review_submitted": ("voice", ("review_id", "product_id", "rating")),
    "nps_submitted": ("voice", ("nps_response_id", "score", "channel")),
    "experiment_concluded": ("experiment", ("experiment_id", "score_target", "decision", "lift_pct")),
}

# Names no exported table may have: contact data and free text.
PRIVATE = (
    "email", "phone", "primary_email", "primary_phone", "first_name", "last_name", "phone_number", "subject",
    "body", "comment", "hypothesis", "payload", "identity_value", "shipping_address", "billing_address",
)


def event_id(tenant: Column, source: Column, external: Column, name: Column) -> Column:
    """sha-256 of the four parts joined by bars."""
    parts = [F.coalesce(c.cast("string"), F.lit("")) for c in (tenant, source, external, name)]
    return F.sha2(F.concat_ws("|", *parts), 256)


def with_event_id(events: DataFrame) -> DataFrame:
    """Add the id and keep one row per id: the last written, by time and then content.

    The greatest struct is found by sorting, in a first step inside the task that made the rows. So they are dealt out by id
    before: a task then sorts its share of the ids, however many events the rows of one file split unfold into.
    """
    named = events.withColumn(
        "event_id", event_id(F.col("tenant_id"), F.col("source"), F.col("external_id"), F.col("event_name"))
    )
    rest = [c for c in COLUMNS if c not in ("event_id", "occurred_at")]
    return named.repartition("event_id").groupBy("event_id").agg(F.max(F.struct("occurred_at", *rest)).alias("e")).select(
        "event_id", "e.*").select(*COLUMNS)


def _event(
    df: DataFrame, name: str, at: str | Column, props: dict[str, Column | str], *, external: str = "external_id",
    source: str | Column = "source", order: bool = False, message: bool = False, customer: str | None = "customer_id",
    amount: str | None = None,
) -> DataFrame:
    """Events of one name; rows without a time have none."""
    long = lambda c: F.col(c).cast("long") if c else F.lit(None).cast("long")
    when = F.col(at) if isinstance(at, str) else at
    fields = F.struct(*[(F.col(v) if isinstance(v, str) else v).alias(k) for k, v in props.items()])
    return df.where(when.isNotNull()).select(
        "tenant_id", F.lit(name).alias("event_name"), long(customer).alias("customer_id"),
        long("order_id" if order else None).alias("order_id"),
        long("message_id" if message else None).alias("message_id"), when.alias("occurred_at"),
        (F.col(source) if isinstance(source, str) else source).alias("source"),
        F.col(external).cast("string").alias("external_id"), long(amount).alias("amount_paise"),
        F.to_json(fields, {"ignoreNullFields": "false"}).alias("properties"),
    )


def _all(*parts: DataFrame) -> DataFrame:
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def _or(column: str, word: str) -> Column:
    return F.coalesce(F.when(F.col(column) != "", F.col(column)), F.lit(word))


def _with_order(df: DataFrame, orders: DataFrame) -> DataFrame:
    """Rows with their order's customer, value and COD flag."""
    look = orders.select(
        "tenant_id", "order_id", F.col("customer_id").alias("order_customer"), F.col("total_paise").alias("order_total"),
        F.col("cod").alias("order_cod"),
    )
    return df.join(look, ["tenant_id", "order_id"], "left")


def events_commerce(customers: DataFrame, orders: DataFrame) -> DataFrame:
    live = customers.where(F.col("merged_into_customer_id").isNull())
    return _all(
        _event(live, "customer_created", "created_at",
               {"source_customer_id": "external_id", "accepts_marketing": "accepts_email_marketing"}),
        _event(orders, "order_placed", "placed_at",
               {"order_id": "order_id", "total_paise": "total_paise", "currency": "currency", "cod": "cod",
                "discount_paise": "discount_paise", "customer_order_index": "customer_order_index"},
               order=True, amount="total_paise"),
        _event(orders, "order_cancelled", "cancelled_at", {"order_id": "order_id", "reason": F.lit("unknown")}, order=True),
    )


def events_logistics(shipments: DataFrame, orders: DataFrame) -> DataFrame:
    """Shipped, delivered and returned; a return without a date takes the delivery's, then the shipping's."""
    s = _with_order(shipments, orders)
    days = F.coalesce(whole_days(F.col("shipped_at"), F.col("delivered_at")), F.lit(0))
    courier = _or("courier", "unknown")
    own = {"order": True, "customer": "order_customer"}
    return _all(
        _event(s, "order_fulfilled", "shipped_at", {"order_id": "order_id", "courier": courier}, **own),
        _event(s, "order_delivered", "delivered_at", {"order_id": "order_id", "days_in_transit": days}, **own),
        _event(s.where("rto"), "order_rto", F.coalesce("rto_at", "delivered_at", "shipped_at"),
               {"order_id": "order_id", "cod": F.coalesce("order_cod", F.lit(False)), "courier": courier},
               amount="order_total", **own),
    )


def events_payment(payments: DataFrame, refunds: DataFrame, orders: DataFrame) -> DataFrame:
    p = _with_order(payments, orders)
    r = _with_order(refunds, orders).withColumn("payer", F.coalesce("customer_id", "order_customer"))
    own = {"order": True, "customer": "order_customer", "amount": "amount_paise"}
    return _all(
        _event(p.where("status = 'captured'"), "payment_captured", "occurred_at",
               {"order_id": "order_id", "amount_paise": "amount_paise", "gateway": _or("gateway", "unknown"),
                "method": "method"}, **own),
        _event(p.where("status = 'failed'"), "payment_failed", "occurred_at",
               {"order_id": "order_id", "amount_paise": "amount_paise", "failure_reason": _or("failure_reason", "unknown")},
               **own),
        _event(r, "order_refunded", "processed_at",
               {"refund_id": "refund_id", "order_id": "order_id", "amount_paise": "amount_paise", "refund_type": "refund_type"},
               order=True, customer="payer", amount="amount_paise"),
    )


def events_messaging(messages: DataFrame, consent: DataFrame) -> DataFrame:
    """A message becomes an event per step it reached, unpivoted in one pass."""
    steps = {
        "message_sent": "sent_at", "message_delivered": "delivered_at", "message_opened": "opened_at",
        "message_clicked": "clicked_at", "message_bounced": "bounced_at",
    }
    listed = F.array(*[F.struct(F.lit(n).alias("event_name"), F.col(c).alias("occurred_at")) for n, c in steps.items()])
    sent = F.to_json(F.struct("message_id", "campaign_id", "channel"), {"ignoreNullFields": "false"})
    later = F.to_json(F.struct("message_id", "channel"), {"ignoreNullFields": "false"})
    moved = messages.select("*", F.explode(listed).alias("s")).where(F.col("s.occurred_at").isNotNull()).select(
        "tenant_id", "s.event_name", "customer_id", F.lit(None).cast("long").alias("order_id"), "message_id",
        "s.occurred_at", "source", F.col("external_id").cast("string").alias("external_id"),
        F.lit(None).cast("long").alias("amount_paise"),
        F.when(F.col("s.event_name") == "message_sent", sent).otherwise(later).alias("properties"),
    )
    said = consent.withColumn(
        "external_id", F.coalesce(F.when(F.col("external_id") != "", F.col("external_id")),
                                  F.concat(F.lit("consent-"), F.col("consent_id"))))
    return _all(
        moved,
        _event(said.where("action = 'granted'"), "channel_opted_in", "occurred_at",
               {"channel": "channel", "method": _or("method", "unknown")}),
        _event(said.where("action is null or action <> 'granted'"), "channel_opted_out", "occurred_at",
               {"channel": "channel", "reason": _or("method", "unsubscribe")}),
    )


def events_voice(tickets: DataFrame, reviews: DataFrame, nps: DataFrame) -> DataFrame:
    hours = F.timestamp_diff("MICROSECOND", F.col("opened_at"), F.col("resolved_at")) / F.lit(1e6) / 3600.0
    return _all(
        _event(tickets, "ticket_opened", "opened_at",
               {"ticket_id": "ticket_id", "channel": "channel", "category": _or("category", "other")}, order=True),
        _event(tickets, "ticket_resolved", "resolved_at",
               {"ticket_id": "ticket_id", "hours_to_resolve": hours, "csat_score": "csat"}, order=True),
        _event(reviews, "review_submitted", "submitted_at",
               {"review_id": "review_id", "product_id": "product_id", "rating": "rating"}, order=True),
        _event(nps, "nps_submitted", "responded_at",
               {"nps_response_id": "nps_id", "score": "score", "channel": "channel"}),
    )


def events_experiment(experiments: DataFrame, house_source: str = "internal") -> DataFrame:
    """Concluded experiments; the name is the external id, `house_source` names the system itself."""
    return _event(
        experiments.where("status = 'concluded'"), "experiment_concluded", "concluded_at",
        {"experiment_id": "experiment_id", "score_target": "score_target", "decision": _or("decision", "undecided"),
         "lift_pct": "lift_pct"},
        external="name", source=F.lit(house_source), customer=None,
    )


# ------------------------------------------------------------------ vocabulary


def vocabulary(spark: SparkSession) -> DataFrame:
    rows = [(n, c, list(p)) for n, (c, p) in VOCABULARY.items()]
    return spark.createDataFrame(rows, "event_name string, category string, required array<string>")


def unknown_events(events: DataFrame) -> DataFrame:
    """Event names outside the vocabulary, with how many rows carry them."""
    return (
        events.where(~F.col("event_name").isin(*VOCABULARY)).groupBy("tenant_id", "event_name")
        .agg(F.count(F.lit(1)).alias("rows"))
    )


def missing_properties(events: DataFrame) -> DataFrame:
    """Required properties that events lack, counted per name and property."""
    required = F.create_map(*[x for n, (_, p) in VOCABULARY.items() for x in (F.lit(n), F.array(*map(F.lit, p)))])
    have = F.coalesce(F.json_object_keys("properties"), F.array().cast("array<string>"))
    lacking = F.array_except(F.coalesce(required[F.col("event_name")], F.array().cast("array<string>")), have)
    return (
        events.select("tenant_id", "event_name", F.explode(lacking).alias("property"))
        .groupBy("tenant_id", "event_name", "property").agg(F.count(F.lit(1)).alias("rows"))
    )


# ------------------------------------------------------------------ dimensions and facts

# The columns that leave the core, per table.
EXPORTED = {
    "dim_customers": "tenant_id customer_id lifecycle_stage first_order_at last_order_at orders_count total_spent_paise "
                     "accepts_email_marketing whatsapp_opted_in sms_opted_in created_at",
    "dim_products": "tenant_id product_id title product_type vendor status",
    "dim_variants": "tenant_id variant_id product_id sku price_paise cost_paise",
    "fact_orders": "tenant_id order_id customer_id placed_at cancelled_at fulfilled_at delivered_at financial_status "
                   "fulfillment_status cod subtotal_paise discount_paise shipping_paise tax_paise total_paise "
                   "customer_order_index discount_codes",
    "fact_order_items": "tenant_id order_item_id order_id product_id variant_id sku quantity unit_price_paise "
                        "discount_paise unit_cost_paise",
    "fact_refunds": "tenant_id refund_id order_id customer_id amount_paise refund_type processed_at",
    "fact_payments": "tenant_id payment_id order_id method status amount_paise failure_reason occurred_at",
    "fact_shipments": "tenant_id shipment_id order_id status rto shipped_at delivered_at rto_at",
    "dim_campaigns": "tenant_id campaign_id name campaign_type channel started_at external_id",
    "fact_messages": "tenant_id message_id campaign_id customer_id channel sent_at delivered_at opened_at clicked_at "
                     "bounced_at unsubscribed_at",
    "fact_consent": "tenant_id consent_id customer_id channel action occurred_at",
    "fact_tickets": "tenant_id ticket_id customer_id order_id channel category status opened_at first_response_at "
                    "resolved_at csat",
    "fact_reviews": "tenant_id review_id customer_id order_id product_id rating verified submitted_at",
    "fact_nps": "tenant_id nps_id customer_id score channel responded_at",
    "fact_experiments": "tenant_id experiment_id name score_target status started_at concluded_at sample_size lift_pct "
                        "significant decision",
}


def assert_no_pii(df: DataFrame, table: str) -> DataFrame:
    """Fail when a table has a column that is not on its export list, or one known to be private; else hand it on."""
    listed = set(EXPORTED[table].split())
    leaking = [c for c in df.columns if c not in listed or c.lower() in PRIVATE]
    if leaking:
        raise ValueError(f"columns of {table} may not be exported: {leaking}")
    return df


def export_dims_facts(core: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """The fifteen PII-free tables; merged customers stay behind."""
    out = {}
    for name, columns in EXPORTED.items():
        df = core[name]
        if name == "dim_customers" and "merged_into_customer_id" in df.columns:
            df = df.where(F.col("merged_into_customer_id").isNull())
        out[name] = assert_no_pii(df.select(*columns.split()), name)
    return out


