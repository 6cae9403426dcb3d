import json
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from patronage.functions import money, parse_time, to_paise
from patronage.sources import crm, landing, shop, sinks

RAW = "tenant_id long, source string, resource string, external_id string, seq long, payload string"


def raw(spark, *records):
    """(source, resource, payload) in landing order."""
    return spark.createDataFrame(
        [(1, s, r, str(p["id"]), i, json.dumps(p)) for i, (s, r, p) in enumerate(records, 1)], RAW)


def look(spark, name, **ids):
    return spark.createDataFrame([(1, k, v, None) for k, v in ids.items()],
                                 f"tenant_id long, external_id string, {name} long, customer_id long")


# An order of our own making. Worked out by hand: two candles at 312.50 and one wick trimmer at 175.25 make 800.25; less 60.20
# off, plus 39.90 for shipping and 81.15 tax, that is 861.10. Of it 300.10 + 45.00 = 345.10 went back.
ORDER = {
    "id": 70412, "name": "#KB-412", "created_at": "2024-11-18T21:45:30+05:30", "cancelled_at": None, "financial_status": "paid",
    "fulfillment_status": None, "subtotal_price": "800.25", "total_discounts": "60.20", "total_tax": "81.15",
    "total_price": "861.10", "total_shipping_price_set": {"shop_money": {"amount": "39.90"}},
    "payment_gateway_names": ["Cash on Delivery (COD)"], "customer": {"id": 8830}, "discount_codes": [{"code": "DIWALI"}, {"code": "WARM5"}],
    "line_items": [{"product_id": 64, "variant_id": 640, "sku": "CANDLE-L", "quantity": 2, "price": "312.50", "total_discount": "1.75"},
                   {"product_id": 77, "variant_id": None, "sku": "TRIM", "price": "175.25"}],
    "refunds": [{"id": 905, "created_at": "2024-11-25T06:00:00Z", "note": "RTO ",
                 "transactions": [{"amount": "300.10", "gateway": "netbanking"}, {"amount": "45.00", "gateway": "upi"}]}],
    "fulfillments": [{"created_at": "2024-11-20T09:30:00Z"}],
}


@pytest.mark.parametrize("text,paise", [("499.00", 49900), ("49.995", 5000), ("-0.005", -1), ("0", 0), ("", 0), (None, 0)])
def test_rupees(spark, text, paise):
    assert spark.createDataFrame([(text,)], "x string").select(to_paise(F.col("x"))).first()[0] == paise


def test_whole_paise_win(spark):
    df = spark.createDataFrame([("7", "99.00"), (None, "99.00")], "p string, r string")
    assert [r[0] for r in df.select(money(F.col("p"), F.col("r"))).collect()] == [7, 9900]


@pytest.mark.parametrize("text,want", [
    ("2025-01-05T10:00:00+05:30", datetime(2025, 1, 5, 4, 30)), ("2025-01-05T10:00:00Z", datetime(2025, 1, 5, 10)),
    ("2025-01-05T10:00:00", datetime(2025, 1, 5, 10)), ("1736071200", datetime(2025, 1, 5, 10)), ("", None), (None, None)])
def test_times(spark, text, want):
    assert spark.createDataFrame([(text,)], "x string").select(parse_time(F.col("x"))).first()[0] == want


def test_order_header(spark):
    got = shop.map_orders(raw(spark, ("shopify", "orders", ORDER)), look(spark, "order_id").select(
        "tenant_id", "external_id", "customer_id").unionByName(spark.createDataFrame([(1, "8830", 7)], "tenant_id long, external_id string, customer_id long"))).first()
    assert (got.subtotal_paise, got.discount_paise, got.shipping_paise, got.tax_paise, got.total_paise) == (
        80025, 6020, 3990, 8115, 86110)
    assert got.placed_at == datetime(2024, 11, 18, 16, 15, 30) and got.fulfilled_at == datetime(2024, 11, 20, 9, 30)
    assert got.cod and got.customer_id == 7 and got.discount_codes == "DIWALI,WARM5"
    assert (got.fulfillment_status, got.currency, got.order_number) == ("unfulfilled", "INR", "#KB-412")


def test_last_payload_wins_and_guests_keep_their_customer(spark):
    sent_again = {**ORDER, "customer": None, "financial_status": "refunded"}
    empty = spark.createDataFrame([], "tenant_id long, external_id string, customer_id long")
    mapped = shop.map_orders(raw(spark, ("shopify", "orders", ORDER), ("shopify", "orders", sent_again)), empty)
    assert [(r.financial_status, r.customer_id) for r in mapped.collect()] == [("refunded", None)]
    attached = mapped.withColumn("customer_id", F.lit(42).cast("long"))
    assert [r.customer_id for r in shop.keep_attached(attached, mapped).collect()] == [42]


def test_items_and_refunds(spark):
    records = raw(spark, ("shopify", "orders", ORDER))
    orders = look(spark, "order_id", **{"70412": 1})
    products = spark.createDataFrame([(1, "64", 100)], "tenant_id long, external_id string, product_id long")
    variants = spark.createDataFrame([(1, "640", 110, 14325)], "tenant_id long, external_id string, variant_id long, cost_paise long")
    items = {r.sku: r for r in shop.map_order_items(records, orders, products, variants).collect()}
    candle, trimmer = items["CANDLE-L"], items["TRIM"]
    assert (candle.product_id, candle.variant_id, candle.unit_cost_paise, candle.quantity) == (100, 110, 14325, 2)
    assert (candle.unit_price_paise, candle.discount_paise) == (31250, 175)
    assert (trimmer.product_id, trimmer.variant_id, trimmer.quantity) == (None, None, 1)
    refund = shop.map_refunds(records, orders).first()
    assert (refund.amount_paise, refund.refund_type, refund.gateway, refund.order_id) == (34510, "rto", "netbanking", 1)


def test_partial_customers_do_not_reset_fields(spark):
    whole = {"id": 8830, "email": " Meera.K@Mail.TEST", "phone": "90040 71825", "accepts_marketing": True, "created_at": "2024-08-02T00:00:00Z"}
    customers, pii, handles = shop.map_customers(raw(
        spark, ("shopify", "customers", whole), ("shopify", "orders", {**ORDER, "customer": {"id": 8830, "first_name": "Meera"}})))
    assert customers.first().accepts_email_marketing is True
    row = pii.first()
    assert (row.primary_email, row.primary_phone, row.first_name) == ("meera.k@mail.test", "+919004071825", "Meera")
    assert {r.identity_type for r in handles.collect()} == {"shopify_customer_id", "phone", "email"}


def test_catalogue(spark):
    product = {"id": 64, "title": "Soy candle", "variants": [
        {"id": 640, "sku": "CANDLE-L", "price": "312.50", "compare_at_price": "355.00", "cost": "143.25"}, {"external_id": "refill", "price_paise": 9925}]}
    products, variants = shop.map_catalog(raw(spark, ("shopify", "products", product)))
    assert (products.first().title, products.first().status) == ("Soy candle", "active")
    got = {r.external_id: (r.price_paise, r.compare_at_price_paise, r.cost_paise) for r in variants.collect()}
    assert got == {"640": (31250, 35500, 14325), "refill": (9925, None, None)}


def test_payments_and_shipments(spark):
    records = raw(
        spark, ("razorpay", "payments", {"id": "pay_K1", "amount": 86110, "status": "captured", "method": "card", "created_at": 1731946530,
                                         "notes": {"shopify_order_id": "70412"}}),
        ("razorpay", "payments", {"id": "pay_K2", "amount": 1200, "status": "failed", "error_description": "bank timed out"}),
        ("shiprocket", "shipments", {"id": "awb7", "order_id": "70412", "status": "rto initiated", "shipped_date": "2024-11-20T00:00:00Z"}),
        ("shiprocket", "shipments", {"id": "awb8", "order_id": "unknown order", "status": "DELIVERED"}),
        ("shiprocket", "shipments", {"id": "awb9", "order_id": "70412", "status": "who knows"}))
    orders = look(spark, "order_id", **{"70412": 1})
    pay = {r.external_id: r for r in shop.map_payments(records, orders).collect()}
    assert (pay["pay_K1"].order_id, pay["pay_K1"].amount_paise, pay["pay_K1"].occurred_at) == (1, 86110, datetime(2024, 11, 18, 16, 15, 30))
    assert (pay["pay_K2"].order_id, pay["pay_K2"].failure_reason) == (None, "bank timed out")
    ship = {r.external_id: (r.status, r.rto) for r in shop.map_shipments(records, orders).collect()}
    assert ship == {"awb7": ("rto_initiated", True), "awb9": ("pending", False)}


def test_profiles_chain_to_the_first_record(spark):
    """The second record finds the first by phone, the third finds the second by e-mail: one customer."""
    def consent(i, pid, phone=None, email=None, ext=None):
        return ("klaviyo", "consent", {"id": i, "profile": {"id": pid, "phone": phone, "email": email}, "external_id": ext,
                                       "channel": "email", "occurred_at": "2025-01-01T00:00:00Z"})

    records = raw(spark, consent(1, "a", phone="9876500001"), consent(2, "b", phone="9876500001", email="b@x.com"),
                  consent(3, "c", email="b@x.com"), consent(4, "d", email="known@x.com"), consent(5, "e", ext="C9"), consent(6, "d"))
    known = spark.createDataFrame([(1, "email", "known@x.com", 50), (1, "shopify_customer_id", "C9", 51)],
                                  "tenant_id long, identity_type string, identity_value string, customer_id long")
    linked = crm.link_profiles(crm.profiles(records, "klaviyo", "consent"), known)
    got = {r.external_id: (r.customer_id, r.minted_external_id) for r in linked.collect()}
    assert got == {"1": (None, "a"), "2": (None, "a"), "3": (None, "a"), "4": (50, None), "5": (51, None), "6": (50, None)}
    assert [r.external_id for r in crm.minted_customers(linked).collect()] == ["a"]


def test_messages_go_by_their_profile_first(spark):
    """A known profile decides, whatever else the message carries; an unseen one is looked up by every key."""
    def message(source, i, pid=None, phone=None, email=None):
        profile = {"id": pid, "phone": phone, "email": email} if pid else None
        return (source, "messages", {"id": i, "profile": profile, "phone_number": phone, "email": email, "sent_at": "2025-03-01T08:00:00Z"})

    known = spark.createDataFrame(
        [(1, "klaviyo_profile_id", "kp-a", 100), (1, "phone", "+919812300045", 200), (1, "email", "lata@shop.test", 300)],
        "tenant_id long, identity_type string, identity_value string, customer_id long")
    mail = raw(spark, message("klaviyo", "m1", "kp-a", phone="98123 00045"), message("klaviyo", "m2", email="lata@shop.test"),
               message("klaviyo", "m3", "kp-b", email="lata@shop.test"), message("klaviyo", "m4", "kp-c"), message("klaviyo", "m5", "kp-c"))
    got = {r.external_id: (r.customer_id, r.minted_external_id) for r in crm.link_profiles(crm.profiles(mail, "klaviyo", "messages"), known).collect()}
    assert got == {"m1": (100, None), "m2": (None, None), "m3": (300, None), "m4": (None, "kp-c"), "m5": (None, "kp-c")}
    linked = crm.link_profiles(crm.profiles(mail, "klaviyo", "messages"), known)
    assert [r.external_id for r in crm.minted_customers(linked).collect()] == ["kp-c"]

    chat = raw(spark, message("interakt", "w1", "ip-x", phone="98123 00045"), message("interakt", "w2"),
               message("interakt", "w3", "ip-x", phone="98123 99999"), message("interakt", "w4", phone="98123 99999"))
    got = {r.external_id: (r.customer_id, r.minted_external_id) for r in crm.link_profiles(crm.profiles(chat, "interakt", "messages"), known).collect()}
    # w3 knows its profile, so its new number is not taken in, and w4 with that number is somebody new
    assert got == {"w1": (200, None), "w2": (None, "w2"), "w3": (200, None), "w4": (None, "w4")}


def test_whatsapp_funnel_words(spark):
    records = raw(spark, ("interakt", "messages", {"id": "m1", "profile": {"id": "p"}, "sent_at": "2025-01-01T00:00:00Z",
                                                   "read_at": "2025-01-02T00:00:00Z", "failed_at": "2025-01-03T00:00:00Z",
                                                   "unsubscribed_at": "2025-01-04T00:00:00Z"}))
    links = spark.createDataFrame([(1, "m1", 9)], "tenant_id long, external_id string, customer_id long")
    campaigns = spark.createDataFrame([], "tenant_id long, external_id string, campaign_id long")
    m = crm.map_messages(records, "interakt", links, campaigns).first()
    assert (m.channel, m.opened_at, m.bounced_at, m.unsubscribed_at, m.customer_id) == (
        "whatsapp", datetime(2025, 1, 2), datetime(2025, 1, 3), None, 9)


def test_later_revocation_wins_over_sources(spark):
    ledger = spark.createDataFrame(
        [(1, 1, 7, "email", "granted", datetime(2025, 1, 1)), (1, 2, 7, "email", "revoked", datetime(2025, 3, 1)),
         (1, 3, 7, "whatsapp", "revoked", datetime(2025, 1, 1)), (1, 4, 7, "whatsapp", "granted", datetime(2025, 1, 1))],
        "tenant_id long, consent_id long, customer_id long, channel string, action string, occurred_at timestamp_ntz")
    f = crm.consent_flags(ledger).first()
    assert (f.accepts_email_marketing, f.whatsapp_opted_in, f.sms_opted_in) == (False, True, None)


def test_landing_twice_lands_nothing_new(spark):
    records = raw(spark, *[("shopify", "orders", {**ORDER, "id": i}) for i in (1, 2, 3, 3)])
    landed = landing.land_raw(records, records.limit(0))
    assert landed.count() == 3
    assert landing.land_raw(records, landed).count() == 0


def test_new_ids_are_dense_and_stable(spark):
    known = spark.createDataFrame([(1, "a", 10)], "tenant_id long, external_id string, id long")
    rows = spark.createDataFrame([(1, k) for k in "abcdefgh"], "tenant_id long, external_id string")
    got = {r.external_id: r.id for r in landing.assign_ids(known, rows, ["tenant_id", "external_id"], "id").collect()}
    assert got["a"] == 10 and sorted(got.values()) == list(range(10, 18))
    shuffled = rows.orderBy(F.desc("external_id"))
    assert got == {r.external_id: r.id for r in landing.assign_ids(known, shuffled, ["tenant_id", "external_id"], "id").collect()}


def test_prediction_days_replace_and_append(spark, tmp_path):
    path = str(tmp_path / "p")
    make = lambda day, p: spark.createDataFrame([(1, 5, p, day)], "tenant_id long, customer_id long, p_alive double, scored_on string") \
        .withColumn("scored_on", F.to_date("scored_on"))
    for day, p in (("2026-01-01", 0.1), ("2026-01-02", 0.2), ("2026-01-02", 0.3)):
        sinks.write_predictions(make(day, p), path)
    assert sorted(r.p_alive for r in sinks.read_table(spark, path, make("2026-01-01", 0.0)).collect()) == [0.1, 0.3]


def test_upsert_query_keeps_products_of_one_number_apart(spark):
    """Beyond a million products a new one's number is that of an old one; the two go by different external ids."""
    from types import SimpleNamespace

    from checks import ingest

    products = spark.createDataFrame([(1, 50, "a", "x"), (1, 1000050, "b", "y")], "tenant_id long, product_id long, title string, vendor string")
    got = sorted(tuple(r) for r in ingest._upsert(SimpleNamespace(products=products)).collect())
    assert got == [(1, 50, "a", "x", 0), (1, 1000050, "v2", "x", 2), (1, 1000050, "v2", "y", 2), (1, 2000050, "v2", "y", 2)]
