"""Hand-made tenants; the tests state what must come of them, worked out by hand."""

from datetime import datetime, timedelta
from types import SimpleNamespace

from pyspark.sql import functions as F

from patronage.operators.orders import customer_stats

ORDER = (
    "tenant_id long, order_id long, customer_id long, placed_at timestamp_ntz, cancelled_at timestamp_ntz, "
    "fulfilled_at timestamp_ntz, delivered_at timestamp_ntz, financial_status string, fulfillment_status string, "
    "cod boolean, subtotal_paise long, discount_paise long, shipping_paise long, tax_paise long, total_paise long, "
    "customer_order_index int, discount_codes string"
)
SHIPMENT = ("tenant_id long, shipment_id long, order_id long, status string, rto boolean, shipped_at timestamp_ntz, "
            "delivered_at timestamp_ntz, rto_at timestamp_ntz")
PAYMENT = ("tenant_id long, payment_id long, order_id long, method string, status string, amount_paise long, "
           "failure_reason string, occurred_at timestamp_ntz")
REFUND = ("tenant_id long, refund_id long, order_id long, customer_id long, amount_paise long, refund_type string, "
          "processed_at timestamp_ntz")
CAMPAIGN = ("tenant_id long, campaign_id long, name string, campaign_type string, channel string, "
            "started_at timestamp_ntz, external_id string")
MESSAGE = ("tenant_id long, message_id long, campaign_id long, customer_id long, channel string, sent_at timestamp_ntz, "
           "delivered_at timestamp_ntz, opened_at timestamp_ntz, clicked_at timestamp_ntz, bounced_at timestamp_ntz, "
           "unsubscribed_at timestamp_ntz")
CONSENT = ("tenant_id long, consent_id long, customer_id long, channel string, action string, occurred_at timestamp_ntz")
TICKET = ("tenant_id long, ticket_id long, customer_id long, order_id long, channel string, category string, "
          "status string, opened_at timestamp_ntz, first_response_at timestamp_ntz, resolved_at timestamp_ntz, csat int")
REVIEW = ("tenant_id long, review_id long, customer_id long, order_id long, product_id long, rating int, "
          "verified boolean, submitted_at timestamp_ntz")
NPS = "tenant_id long, nps_id long, customer_id long, score int, channel string, responded_at timestamp_ntz"
EXPERIMENT = ("tenant_id long, experiment_id long, name string, score_target string, status string, "
              "started_at timestamp_ntz, concluded_at timestamp_ntz, sample_size int, lift_pct double, "
              "significant boolean, decision string, hypothesis string")
RUN = ("tenant_id long, run_id long, score string, value double, computed_at timestamp_ntz, definition_version string")


def at(text):
    return datetime.fromisoformat(f"2026-{text}") if len(text) <= 5 else datetime.fromisoformat(text)


def order(i, customer, day, total, index=None, status="paid", cod=False, subtotal=None, discount=0, tenant=1,
          cancelled=None):
    return (tenant, i, customer, at(day), cancelled, None, None, status, "fulfilled", cod,
            total if subtotal is None else subtotal, discount, 0, 0, total, index, None)


def tenant_tables(spark, orders, people, shipments=(), payments=(), refunds=(), campaigns=(), messages=(), consent=(),
                  tickets=(), reviews=(), nps=(), experiments=()):
    """The tables the marts read. `people`: (tenant, id, email opt-in, whatsapp opt-in)."""
    make = lambda rows, schema: spark.createDataFrame(list(rows), schema)
    fact_orders = make(orders, ORDER)
    base = make(people, "tenant_id long, customer_id long, accepts_email_marketing boolean, whatsapp_opted_in boolean")
    stats = customer_stats(fact_orders)
    dim = base.join(stats, ["tenant_id", "customer_id"], "left").withColumns({
        "orders_count": F.coalesce("orders_count", F.lit(0)), "lifecycle_stage": F.coalesce("lifecycle_stage", F.lit("new")),
        "sms_opted_in": F.lit(False), "created_at": F.lit(datetime(2025, 1, 1)).cast("timestamp_ntz")})
    return SimpleNamespace(
        spark=spark, tenants=base.select("tenant_id").distinct(), fact_orders=fact_orders, order_headers=fact_orders,
        dim_customers=dim, fact_shipments=make(shipments, SHIPMENT), fact_payments=make(payments, PAYMENT),
        fact_refunds=make(refunds, REFUND), dim_campaigns=make(campaigns, CAMPAIGN), fact_messages=make(messages, MESSAGE),
        fact_consent=make(consent, CONSENT), fact_tickets=make(tickets, TICKET), fact_reviews=make(reviews, REVIEW),
        fact_nps=make(nps, NPS), fact_experiments=make(experiments, EXPERIMENT), experiments=make(experiments, EXPERIMENT))


def retail(spark, tenant=1, shift=0):
    """Nine customers and eighteen orders over five months."""
    bought = {  # customer: (day, rupees) per order
        1: (("01-03", 2400), ("02-21", 600), ("03-30", 1800), ("05-28", 750)),
        2: (("01-28", 500),),
        3: (("02-02", 3100), ("03-27", 450), ("04-16", 450)),
        4: (("02-14", 998),),
        5: (("03-25", 200),),
        6: (("03-11", 1500), ("04-01", 250), ("05-02", 250), ("05-30", 1300)),
        7: (("04-20", 640),),
        8: (("05-15", 720),),
        9: (("01-06", 880), ("01-19", 880)),
    }
    special = {5: {"cod": True}, 7: {"status": "pending"}, 8: {"subtotal": 120000, "discount": 48000}}
    rows, last = [], {}
    for customer, orders in bought.items():
        for index, (day, rupees) in enumerate(orders, 1):
            last[customer] = len(rows) + 1 + shift
            rows.append(order(last[customer], customer + shift, day, rupees * 100, index, tenant=tenant, **special.get(customer, {})))
    return tenant_tables(
        spark, rows, [(tenant, c + shift, False, False) for c in bought],
        shipments=[(tenant, 1 + shift, last[5], "rto_received", True, at("03-28"), None, at("04-04"))],
        payments=[(tenant, 1 + shift, last[7], "card", "failed", 64000, "insufficient funds", at("04-20")),
                  (tenant, 2 + shift, last[8], "card", "captured", 72000, None, at("05-15"))])


def experience(spark):
    """Three customers in June: four parcels, four tickets, messages on two channels, three experiments."""
    later = lambda day, hours: at(day) + timedelta(hours=hours)

    def sent(i, campaign, customer, channel, day, delivered=None, opened=None, clicked=None, bounced=None):
        return (1, i, campaign, customer, channel, at(day), *[at(d) if d else None for d in (delivered, opened, clicked, bounced)], None)

    welcome, sale, news = 20, 21, 22
    return tenant_tables(
        spark,
        [order(11, 1, "06-03", 120000, 1), order(12, 2, "06-10", 45000, 1), order(13, 2, "06-24", 30000, 2),
         order(14, 3, "05-20", 80000, 1, status="pending", cod=True)],
        [(1, 1, True, True), (1, 2, True, True), (1, 3, False, False)],
        shipments=[(1, 1, 11, "delivered", False, at("06-04"), at("06-08"), None), (1, 2, 12, "delivered", False, at("06-11"), at("06-13"), None),
                   (1, 3, 13, "delivered", False, at("06-25"), at("06-30"), None), (1, 4, 14, "rto_received", True, at("05-22"), None, at("06-02"))],
        campaigns=[(1, welcome, "hello there", "flow", "email", at("02-01"), "KLF-01"),  # the id that stands for the welcome flow
                   (1, sale, "june sale", "campaign", "email", at("05-30"), "sale-june"),
                   (1, news, "order news", "campaign", "whatsapp", at("05-30"), "news-7")],
        messages=[sent(1, welcome, 1, "email", "06-02", "06-02", "06-02", "06-02"), sent(2, sale, 2, "email", "06-01", "06-01", "06-01", "06-01"),
                  sent(3, news, 2, "whatsapp", "06-20", "06-20", "06-21", "06-22"), sent(4, news, 1, "whatsapp", "06-20", "06-20"),
                  sent(5, news, 3, "whatsapp", "06-20", "06-20", "06-20"), sent(6, news, 3, "whatsapp", "06-21", bounced="06-21"),
                  sent(7, news, 1, "whatsapp", "06-23", "06-23")],
        consent=[(1, 1, 1, "whatsapp", "granted", at("03-01")), (1, 2, 2, "whatsapp", "granted", at("03-04")), (1, 3, 2, "email", "granted", at("03-04"))],
        tickets=[(1, i, who, None, "chat", "delivery", "resolved", at(day), None, later(day, hours), csat)
                 for i, (who, day, hours, csat) in enumerate(((1, "06-09", 6, 5), (1, "06-12", 12, 2), (2, "06-14", 18, None), (3, "06-15", 120, 3)), 1)],
        reviews=[(1, 1, 1, 11, 1, 3, True, at("06-12")), (1, 2, 2, 12, 1, 5, True, at("06-18")), (1, 3, 2, 13, 2, 4, False, at("06-21"))],
        nps=[(1, i, 1 + i % 2, score, "email", at("06-25")) for i, score in enumerate((10, 9, 9, 6, 8), 1)],
        experiments=[(1, 1, "free returns", "flow", "concluded", at("02-03"), at("02-17"), 900, -1.5, False, "dropped", "why not"),
                     (1, 2, "bundles", "gravity", "running", at("05-21"), None, None, None, None, None, None),
                     (1, 3, "cards", "pulse", "draft", None, None, None, None, None, None, None)])
