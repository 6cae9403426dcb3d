"""Landed payloads derived from the tables, in the spellings sources really use.

Every record is one JSON text per table row. Even keys use the whole-paise and
seeded field names, odd keys the public-API ones, and times come with `Z`, with
an offset, or with neither, so that the mappers meet every spelling.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from patronage.sources.tables import Tables

STAMP = "\"yyyy-MM-dd'T'HH:mm:ss\""


def _iso(ts: str, key: str) -> str:
    return (
        f"case {key} % 3 when 0 then concat(date_format(timestampadd(MINUTE, 330, {ts}), {STAMP}), '+05:30') "
        f"when 1 then concat(date_format({ts}, {STAMP}), 'Z') else date_format({ts}, {STAMP}) end"
    )


def _rupees(paise: str) -> str:
    return f"concat({paise} div 100, '.', lpad(cast({paise} % 100 as string), 2, '0'))"


def _even(key: str, value: str) -> str:
    return f"if({key} % 2 = 0, {value}, null)"


def _odd(key: str, value: str) -> str:
    return f"if({key} % 2 = 1, {value}, null)"


def _record(df: DataFrame, source: str, resource: str, ext: str, seq: str, fields: dict[str, str]) -> DataFrame:
    body = ", ".join(f"'{k}', {v}" for k, v in fields.items())
    return df.selectExpr(
        "tenant_id", f"'{source}' as source", f"'{resource}' as resource", f"{ext} as external_id",
        f"cast({seq} as bigint) as seq", f"to_json(named_struct('id', {ext}, {body})) as payload",
    )


class Payloads:
    """Raw records of each stream over one set of tables."""

    def __init__(self, tables: Tables) -> None:
        self.t = tables

    def customers(self) -> DataFrame:
        rows = self.t.customers.join(self.t.customer_pii, ["tenant_id", "customer_id"])
        k = "customer_id"
        return _record(rows, "shopify", "customers", "external_id", k, {
            "email": "primary_email", "phone": "primary_phone", "first_name": "first_name", "last_name": "last_name",
            "accepts_marketing": f"if({k} % 5 = 1, null, accepts_email_marketing)", "created_at": _iso("created_at", k),
        })

    def products(self) -> DataFrame:
        k, v = "product_id", "(product_id * 10 + {})"
        sides = ", ".join(
            f"named_struct('id', {_odd(k, f'concat(chr(86), {v.format(s)})')}, "
            f"'external_id', {_even(k, f'concat(chr(86), {v.format(s)})')}, 'sku', concat('SKU-', {v.format(s)}), "
            f"'price_paise', {_even(k, f'price + {s} * 1000')}, 'price', {_odd(k, _rupees(f'(price + {s} * 1000)'))}, "
            f"'compare_at_price', if({k} % 4 = 0, {_rupees('(price + 5000)')}, null), "
            f"'cost_paise', {_even(k, f'({v.format(s)} % 900) * 100')}, "
            f"'cost', {_odd(k, _rupees(f'(({v.format(s)} % 900) * 100)'))})"
            for s in (0, 1)
        )
        price = self.t.read("part").selectExpr("p_partkey as product_id", "cast(round(p_retailprice * 100) as bigint) as price")
        return _record(
            self.t.products.join(price, "product_id"), "shopify", "products", "concat('P', product_id)", k,
            {"title": "title", "product_type": "product_type", "vendor": "vendor",
             "status": "nullif(status, 'active')", "variants": f"array({sides})"},
        )

    def orders(self) -> DataFrame:
        k, o = "order_id", self.t.fact_orders.join(
            self.t.order_headers.select("tenant_id", "order_id", "buyer_id"), ["tenant_id", "order_id"])
        money = {}
        for paise, rupees in (("subtotal", "subtotal_price"), ("discount", "total_discounts"), ("tax", "total_tax"),
                              ("total", "total_price")):
            money[f"{paise}_paise"] = _even(k, f"{paise}_paise")
            money[rupees] = _odd(k, _rupees(f"{paise}_paise"))
        item = (
            f"named_struct('product_id', {_odd(k, 'concat(chr(80), ({k} * 7 + n) % 500)')}, "
            f"'product_external_id', {_even(k, 'concat(chr(80), ({k} * 7 + n) % 500)')}, "
            f"'variant_id', concat(chr(86), (({{k}} * 7 + n) % 500) * 10 + n % 2), 'sku', concat('S', n), 'quantity', n + 1, "
            f"'unit_price_paise', {_even(k, '(({k} + n) % 900) * 1000 + 99')}, "
            f"'price', {_odd(k, _rupees('((({k} + n) % 900) * 1000 + 99)'))}, 'discount_paise', n * 50)"
        ).replace("{k}", k)
        half = "(total_paise div 2)"
        refund = (
            f"named_struct('id', concat('R', {k} * 3), 'refund_type', {_even(k, 'hint')}, 'note', {_odd(k, 'hint')}, "
            f"'amount_paise', {_even(k, half)}, 'processed_at', {_even(k, _iso('timestampadd(DAY, 20, placed_at)', k))}, "
            f"'created_at', {_odd(k, _iso('timestampadd(DAY, 20, placed_at)', k))}, 'transactions', "
            f"array(named_struct('amount', {_rupees(f'({half} - 100)')}, 'gateway', 'upi'), "
            f"named_struct('amount', '1.00', 'gateway', 'wallet')))"
        )
        o = o.withColumn("hint", F.expr(
            "case (order_id div 14) % 5 when 0 then 'return' when 1 then 'rto' when 2 then ' Goodwill ' "
            "when 3 then 'payment_failure' else 'changed my mind' end"))
        tail = "lpad(cast(buyer_id % 1450 as string), 9, '0')"
        guest = "customer_id is null"
        return _record(o, "shopify", "orders", "concat('O', order_id)", k, {
            "name": "concat('#', order_id)", "created_at": _iso("placed_at", k), "cancelled_at": _iso("cancelled_at", k),
            "financial_status": "financial_status",
            "fulfillment_status": "nullif(fulfillment_status, 'unfulfilled')",
            "cod": _even(k, "cod"),
            "payment_gateway_names": _odd(k, "array(if(cod, 'Cash on Delivery (COD)', 'upi'))"),
            **money,
            "shipping_paise": _even(k, "shipping_paise"),
            "total_shipping_price": f"if({k} % 4 = 1, {_rupees('shipping_paise')}, null)",
            "total_shipping_price_set":
                f"if({k} % 4 = 3, named_struct('shop_money', named_struct('amount', {_rupees('shipping_paise')})), null)",
            "customer": "if(customer_id is null, null, named_struct('id', concat('C', customer_id)))",
            "phone": f"if({guest} and {k} % 4 = 0, concat('0', '9', {tail}), null)",
            "shipping_address": f"if({guest} and {k} % 4 = 2, named_struct('phone', concat('9', {tail})), null)",
            "email": f"if({guest} and {k} % 4 = 1, concat(' USER', buyer_id % 1400, '@EXAMPLE.com'), null)",
            "contact_email": f"if({guest} and {k} % 4 = 2, concat('user', buyer_id % 1400, '@example.com'), null)",
            "discount_codes": _even(k, "split(discount_codes, ',')"),
            "fulfillments": "if(fulfilled_at is null, null, array(named_struct('created_at', "
                            + _iso("fulfilled_at", k) + ")))",
            "line_items": f"transform(sequence(1, cast(1 + {k} % 4 as int)), n -> {item})",
            "refunds": f"if({k} % 14 = 0, array({refund}), null)",
        })

    def payments(self) -> DataFrame:
        k = "payment_id"
        return _record(self.t.fact_payments, "razorpay", "payments", "concat('pay_', payment_id)", k, {
            "amount_paise": _even(k, "amount_paise"), "amount": _odd(k, "amount_paise"), "status": "status", "method": "method",
            "failure_reason": _even(k, "failure_reason"), "error_description": _odd(k, "failure_reason"),
            "order_external_id": _even(k, "concat('O', order_id)"),
            "notes": _odd(k, "named_struct('shopify_order_id', concat('O', order_id))"),
            "created_at": f"if({k} % 2 = 1, cast(unix_seconds(cast(occurred_at as timestamp)) as string), "
                          f"{_iso('occurred_at', k)})",
        })

    def shipments(self) -> DataFrame:
        k = "shipment_id"
        rows = self.t.fact_shipments.selectExpr("*", "concat('O', order_id) as order_ext")
        lost = self.t.fact_shipments.where("order_id % 77 = 0").selectExpr(
            *[c for c in self.t.fact_shipments.columns if c != "shipment_id"], "-shipment_id - 1 as shipment_id",
            "'O-unknown' as order_ext").select(*rows.columns)
        pick = lambda names, col: {names[0]: _even(k, _iso(col, k)), names[1]: _odd(k, _iso(col, k))}
        return _record(rows.unionByName(lost), "shiprocket", "shipments", "concat('s', shipment_id)", k, {
            "order_external_id": _even(k, "order_ext"), "order_id": _odd(k, "order_ext"), "courier": "concat('cr', order_id % 3)",
            "status": "case status when 'delivered' then if(shipment_id % 2 = 0, 'DELIVERED', 'Delivered') "
                      "when 'in_transit' then if(shipment_id % 2 = 0, 'in_transit', 'IN TRANSIT') "
                      "else if(shipment_id % 2 = 0, 'RTO DELIVERED', 'rto_received') end",
            "rto": _even(k, "rto"),
            **pick(("shipped_at", "shipped_date"), "shipped_at"), **pick(("delivered_at", "delivered_date"), "delivered_at"),
            **pick(("rto_at", "rto_delivered_date"), "rto_at"),
        })

    def campaigns(self, source: str) -> DataFrame:
        whatsapp = source == "interakt"
        rows = self.t.dim_campaigns.where("channel = 'whatsapp'" if whatsapp else "channel <> 'whatsapp'")
        k = "campaign_id"
        return _record(rows, source, "campaigns", "concat('cmp', campaign_id)", k, {
            "name": "name", "campaign_type": _even(k, "campaign_type"), "type": _odd(k, "campaign_type"),
            "channel": "nullif(channel, 'whatsapp')" if whatsapp else "nullif(channel, 'email')",
            "started_at": _even(k, _iso("started_at", k)),
            "created_at_utc" if whatsapp else "send_time": _odd(k, _iso("started_at", k)),
        })

    def _profiled(self, rows: DataFrame) -> DataFrame:
        """Rows with the profile fields of their customer; some lack a phone, some share a guest address."""
        pii = self.t.customer_pii.selectExpr("tenant_id", "customer_id as person", "primary_phone", "primary_email")
        return rows.join(pii, ["tenant_id", "person"], "left").selectExpr(
            "*",
            "if(person % 3 = 0, concat('C', person), null) as shop_id",
            "if(person % 10 = 7, null, primary_phone) as profile_phone",
            "case when person % 20 = 7 then concat('guest', person % 60, '@x.com') else primary_email end as profile_email",
        )

    def consent(self, source: str) -> DataFrame:
        whatsapp = source == "interakt"
        rows = self.t.fact_consent.where("channel = 'whatsapp'" if whatsapp else "channel <> 'whatsapp'")
        rows = self._profiled(rows.withColumn("person", F.col("customer_id")))
        k = "consent_id"
        return _record(rows, source, "consent", "concat('con', consent_id)", k, {
            "profile": "named_struct('id', concat('kp', person), 'phone', profile_phone, 'email', profile_email)",
            "external_id": "shop_id", "channel": "nullif(channel, 'whatsapp')" if whatsapp else "channel",
            "action": "nullif(action, 'granted')", "occurred_at": _iso("occurred_at", k),
        })

    def messages(self, source: str) -> DataFrame:
        whatsapp = source == "interakt"
        rows = self.t.fact_messages.where("channel = 'whatsapp'" if whatsapp else "channel <> 'whatsapp'")
        # Events lie packed in few small files: dealt out while narrow, so that not one task writes and parses the text of a whole file.
        rows = rows.repartition("message_id")
        k = "message_id"
        return _record(rows, source, "messages", "concat('m', message_id)", k, {
            "campaign_id": "concat('cmp', campaign_id)",
            "profile": "if(customer_id is null, null, named_struct('id', concat('kp', customer_id)))",
            "channel": "nullif(channel, 'whatsapp')" if whatsapp else "nullif(channel, 'email')",
            "sent_at": _iso("sent_at", k), "delivered_at": _iso("delivered_at", k),
            "read_at" if whatsapp else "opened_at": _iso("opened_at", k), "clicked_at": _iso("clicked_at", k),
            "failed_at" if whatsapp else "bounced_at": _iso("bounced_at", k), "unsubscribed_at": _iso("unsubscribed_at", k),
        })

    def tickets(self) -> DataFrame:
        pii = self.t.customer_pii.selectExpr("tenant_id", "customer_id", "primary_phone", "primary_email")
        rows = self.t.fact_tickets.join(pii, ["tenant_id", "customer_id"], "left")
        k = "ticket_id"
        return _record(rows, "gorgias", "tickets", "concat('tk', ticket_id)", k, {
            "order_external_id": "concat('O', order_id)",
            "customer": "if(ticket_id % 3 = 0 and customer_id is not null, named_struct('external_id', concat('C', customer_id)), null)",
            "phone": "if(ticket_id % 3 = 1, primary_phone, null)", "email": "if(ticket_id % 3 <> 0, primary_email, null)",
            "channel": "nullif(channel, 'email')", "subject": "concat('about ', order_id)", "category": "category",
            "status": "nullif(status, 'open')", "opened_at": _even(k, _iso("opened_at", k)),
            "created_datetime": _odd(k, _iso("opened_at", k)), "first_response_at": _iso("first_response_at", k),
            "resolved_at": _even(k, _iso("resolved_at", k)), "closed_datetime": _odd(k, _iso("resolved_at", k)), "csat": "csat",
        })

    def reviews(self) -> DataFrame:
        pii = self.t.customer_pii.selectExpr("tenant_id", "customer_id", "primary_email")
        rows = self.t.fact_reviews.join(pii, ["tenant_id", "customer_id"], "left")
        k = "review_id"
        return _record(rows, "judgeme", "reviews", "concat('rv', review_id)", k, {
            "order_external_id": "concat('O', order_id)", "product_external_id": "concat('P', product_id)",
            "reviewer": "named_struct('external_id', if(review_id % 2 = 0, concat('C', customer_id), null), 'email', primary_email)",
            "rating": "rating", "title": "concat('t', review_id)",
            "verified": "case when review_id % 3 = 0 then if(verified, 'buyer', 'nothing') "
                        "else cast(verified as string) end",
            "submitted_at": _even(k, _iso("submitted_at", k)), "created_at": _odd(k, _iso("submitted_at", k)),
        })

    # -------------------------------------------------------------- lookups

    def order_lookup(self) -> DataFrame:
        return self.t.order_headers.selectExpr("tenant_id", "concat('O', order_id) as external_id", "order_id", "customer_id")

    def customer_lookup(self) -> DataFrame:
        return self.t.customers.select("tenant_id", "external_id", "customer_id")

    def product_lookup(self) -> DataFrame:
        return self.t.products.selectExpr("tenant_id", "concat('P', product_id) as external_id", "product_id")

    def variant_lookup(self) -> DataFrame:
        return self.t.variants.selectExpr("tenant_id", "concat('V', variant_id) as external_id", "variant_id", "cost_paise")

    def campaign_lookup(self) -> DataFrame:
        return self.t.dim_campaigns.selectExpr("tenant_id", "concat('cmp', campaign_id) as external_id", "campaign_id")
