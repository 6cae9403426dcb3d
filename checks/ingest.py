"""Queries and SQL of landing, mapping and the data-quality profile."""

import functools

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from checks.marts import r6
from patronage.operators import identity
from patronage.session import settle, work_path
from patronage.sources import crm, landing, shop, sinks
from patronage.sources.payloads import Payloads

SYNCED = "2001-08-11 02:00:00"


def handles(t):
    """Identity handles of the shop's customers, first claimant first."""
    p = Payloads(t)
    _, _, found = shop.map_customers(p.customers())
    found = found.join(p.customer_lookup(), ["tenant_id", "external_id"])
    claims = found.withColumn("order", F.struct("pass", "seq")).select(
        "tenant_id", "identity_type", "identity_value", "customer_id", "source", "order")
    return identity.claim_handles(claims, claims.limit(0))


def linked(t, source="klaviyo"):
    p = Payloads(t)
    return crm.link_profiles(crm.profiles(p.consent(source), source, "consent"), handles(t))


def consent_links(t, source):
    return linked(t, source).select("tenant_id", "external_id", "customer_id")


def message_links(t, source, claimed):
    """Customers of message records, through the profile ids that consent brought in and the handles `claimed` by shop customers."""
    owners = t.customers.select("tenant_id", F.lit(crm.PROFILE_KEY[source]).alias("identity_type"),
                                F.concat(F.lit("kp"), "customer_id").alias("identity_value"), "customer_id")
    known = settle(claimed.select(*owners.columns).unionByName(owners))
    return crm.link_profiles(crm.profiles(Payloads(t).messages(source), source, "messages"), known).select("tenant_id", "external_id", "customer_id")


def _messages(t):
    p, claimed = Payloads(t), settle(handles(t))  # once for both sources
    return functools.reduce(DataFrame.unionByName, [
        crm.map_messages(p.messages(source), source, message_links(t, source, claimed), p.campaign_lookup()) for source in ("klaviyo", "interakt")])


def _state(raw):
    return raw.where("tenant_id < 5").groupBy("tenant_id", "source", "resource").agg(
        F.expr("cast(max(seq) div 2 as string)").alias("cursor"),
        F.lit("2001-08-01 02:00:00").cast("timestamp_ntz").alias("last_synced_at"))


def _land(t):
    raw = Payloads(t).payments()
    again = raw.selectExpr("tenant_id", "source", "resource", "external_id", "seq + 1000000000000 as seq", "'{}' as payload")
    return landing.land_raw(raw.unionByName(again), raw.where("seq % 3 = 0")).select(
        "tenant_id", "source", "resource", "external_id", "seq", (F.length("payload") > 2).alias("whole"))


def _read_since(t):
    raw = Payloads(t).payments()
    return landing.read_since(raw, _state(raw)).select("tenant_id", "external_id", "seq")


def _cursors(t):
    raw = Payloads(t).payments()
    state = _state(raw)
    return landing.advance(state, landing.read_since(raw, state), SYNCED)


def _upsert(t):
    """Products by external id: a third sent again twice, and new ones under ids of their own, whose product numbers may be those of others."""
    current = t.products.select("tenant_id", F.concat(F.lit("P"), "product_id").alias("external_id"), "product_id", "title", "vendor")
    some = current.where("product_id % 3 = 0")
    fresh = current.where("product_id % 50 = 0").withColumns({
        "external_id": F.concat(F.lit("N"), "product_id"), "product_id": F.col("product_id") + 1000000})
    incoming = some.unionByName(fresh).select(
        "tenant_id", "external_id", "product_id", F.explode(F.array(F.lit(1), F.lit(2))).alias("seq"), "vendor").withColumn(
        "title", F.concat(F.lit("v"), "seq")).select(*current.columns, "seq")
    return landing.upsert(current.withColumn("seq", F.lit(0)), incoming, ["tenant_id", "external_id"], "seq").drop("external_id")


def _ids(t):
    known = t.customers.where("customer_id % 2 = 0").select("tenant_id", "external_id", "customer_id")
    rows = t.customers.select("tenant_id", "external_id", F.col("customer_id").alias("true_id"))
    out = landing.assign_ids(known, rows, ["tenant_id", "external_id"], "customer_id")
    old = F.col("true_id") % 2 == 0
    return out.agg(
        F.count(F.lit(1)).alias("n"), F.count_distinct("customer_id").alias("ids"), F.max("customer_id").alias("top"),
        F.count_if(old & (F.col("customer_id") != F.col("true_id"))).alias("moved"),
        F.min(F.when(~old, F.col("customer_id"))).alias("first_new"))


def _sync_report(t):
    raw = Payloads(t).payments()
    return landing.sync_report(raw.unionByName(raw.where("seq % 2 = 0")), raw.where("seq % 3 = 0"))


def _bad_words(t):
    """All seven vocabularies, each with a word that does not belong."""
    orders = t.order_headers.selectExpr(
        "tenant_id", "if(order_id % 101 = 0, 'PAID', financial_status) as financial_status",
        "if(order_id % 103 = 0, 'lost', 'fulfilled') as fulfillment_status")
    swap = lambda df, column, word, other: df.withColumn(column, F.expr(f"if({column} = '{word}', '{other}', {column})"))
    out = landing.validate_enums(orders, "orders")
    for name, df in (
        ("shipments", swap(t.fact_shipments, "status", "delivered", "arrived")),
        ("payments", swap(t.fact_payments, "method", "card", "CARD")),
        ("refunds", swap(t.fact_refunds, "refund_type", "return", "sent back")),
        ("consent", swap(t.fact_consent, "action", "revoked", "denied")),
        ("customers", swap(t.dim_customers, "lifecycle_stage", "loyal", "faithful")),
        ("experiments", swap(t.experiments, "status", "concluded", "over")),
    ):
        out = out.unionByName(landing.validate_enums(df, name))
    return out


def _items(t):
    p = Payloads(t)
    return shop.map_order_items(p.orders(), p.order_lookup(), p.product_lookup(), p.variant_lookup()).drop("title")


def _replace_items(t):
    items = t.fact_order_items.select("tenant_id", "order_id", "order_item_id", "quantity")
    sent = items.where("order_id % 2 = 0 and order_item_id % 2 = 0").withColumn("quantity", F.lit(-1))
    return shop.replace_items(items, sent)


def _fulfilment(t):
    orders = t.fact_orders.withColumn("fulfilled_at", F.expr("if(order_id % 2 = 0, null, fulfilled_at)"))
    return shop.order_fulfilment(orders, t.fact_shipments.withColumn("seq", F.col("shipment_id"))).select(
        "tenant_id", "order_id", "fulfilled_at", "delivered_at", "fulfillment_status")


def _write_replace(t):
    """All tenants stored; then tenants 1 to 3 rebuilt, of which 3 comes out empty."""
    path = work_path(t.spark, "payments")
    rows = t.fact_payments.select("tenant_id", "payment_id", "amount_paise")
    sinks.write_replace(rows, path, t.tenants)
    again = rows.where("tenant_id in (1, 2)").withColumn("amount_paise", F.lit(1).cast("long"))
    sinks.write_replace(again, path, t.tenants.where("tenant_id <= 3"))
    return sinks.read_table(t.spark, path, rows)


def _freshness(t):
    p = Payloads(t)
    raw = p.payments().unionByName(p.tickets())
    empty = _state(raw).limit(0)
    return landing.source_freshness(landing.advance(empty, raw, SYNCED), t.score_runs)


def _flags(t):
    return crm.apply_flags(t.customers, crm.consent_flags(t.fact_consent)).select(
        "tenant_id", "customer_id", "accepts_email_marketing", "whatsapp_opted_in", "sms_opted_in")


def _merged_core(t):
    """Customers in chains of four that were merged into the first of them."""
    return t.customers.select(
        ((F.expr("customer_id div 4")) % 5 + 1).alias("tenant_id"), "customer_id", "source", "external_id",
        F.when(F.col("customer_id") % 4 != 0, F.col("customer_id") - 1).alias("merged_into_customer_id"))


def _link_nps(t):
    core = _merged_core(t)
    nps = core.where("customer_id % 3 = 0").selectExpr(
        "tenant_id", "customer_id * 2 + 1 as nps_id", "if(customer_id % 2 = 0, null, 7L) as customer_id",
        "if(customer_id % 5 = 0, 'C-none', external_id) as customer_external_id")
    return crm.link_nps(nps, core, identity.canonical_ids(core))


P = Payloads
QUERIES = {
    "land_raw": _land,
    "incremental_pages": _read_since,
    "cursor_advance": _cursors,
    "upsert_by_external_id": _upsert,
    "assign_ids": _ids,
    "map_customers": lambda t: shop.map_customers(P(t).customers())[0],
    "map_customer_pii": lambda t: shop.map_customers(P(t).customers())[1],
    "map_products": lambda t: shop.map_catalog(P(t).products())[0],
    "map_products_variants": lambda t: shop.map_catalog(P(t).products())[1].drop("title"),
    "map_orders": lambda t: shop.map_orders(P(t).orders(), P(t).customer_lookup()),
    "map_order_items": _items,
    "replace_order_items": _replace_items,
    "map_refunds": lambda t: shop.map_refunds(P(t).orders(), P(t).order_lookup()),
    "validate_enums": _bad_words,
    "map_payments": lambda t: shop.map_payments(P(t).payments(), P(t).order_lookup()),
    "map_shipments": lambda t: shop.map_shipments(P(t).shipments(), P(t).order_lookup()),
    "apply_shipment_status": _fulfilment,
    "map_campaigns": lambda t: crm.map_campaigns(P(t).campaigns("klaviyo"), "klaviyo").unionByName(
        crm.map_campaigns(P(t).campaigns("interakt"), "interakt")).drop("subject", "ended_at"),
    "link_profiles": lambda t: linked(t).select(
        "tenant_id", "external_id", "customer_id", "minted_external_id"),
    "minted_customers": lambda t: crm.minted_customers(linked(t)),
    "map_consent": lambda t: crm.map_consent(
        P(t).consent("interakt"), "interakt", consent_links(t, "interakt"), P(t).consent("interakt").where("seq % 4 = 0")),
    "consent_flags": _flags,
    "map_messages": _messages,
    "map_tickets": lambda t: crm.map_tickets(P(t).tickets(), handles(t), P(t).order_lookup()),
    "map_reviews": lambda t: crm.map_reviews(P(t).reviews(), handles(t), P(t).order_lookup(), P(t).product_lookup()).drop("body"),
    "link_nps": _link_nps,
    "write_tenant_replace": _write_replace,
    "source_freshness": _freshness,
    "sync_report": _sync_report,
    "data_quality_profile": lambda t: r6(landing.quality_profile(t.order_headers, t.fact_shipments, t.fact_order_items)),
}

VIEWS = {
    "v_pay_state": "SELECT tenant_id, max(payment_id) // 2 AS cursor FROM t_payments WHERE tenant_id < 5 GROUP BY ALL",
    "v_phone_owner": "SELECT tenant_id, clean_phone, min(customer_id) AS owner FROM t_pii WHERE clean_phone IS NOT NULL GROUP BY ALL",
    "v_email_owner": "SELECT tenant_id, clean_email, min(customer_id) AS owner FROM t_pii WHERE clean_email IS NOT NULL GROUP BY ALL",
    "v_linked": """
        SELECT c.tenant_id, consent_id, channel, c.customer_id AS person, occurred_at,
               CASE WHEN c.customer_id % 3 = 0 THEN c.customer_id
                    WHEN c.customer_id % 10 <> 7 AND p.clean_phone IS NOT NULL THEN f.owner
                    WHEN c.customer_id % 20 = 7 THEN NULL ELSE e.owner END AS owner
        FROM t_consent c JOIN t_pii p ON p.customer_id = c.customer_id
        LEFT JOIN v_phone_owner f ON f.tenant_id = c.tenant_id AND f.clean_phone = p.clean_phone
        LEFT JOIN v_email_owner e ON e.tenant_id = c.tenant_id AND e.clean_email = p.clean_email""",
}

CHAIN = "(k // 4) % 5 + 1"

SQL = {
    "land_raw": """
        SELECT tenant_id, 'razorpay' AS source, 'payments' AS resource, 'pay_' || payment_id AS external_id, payment_id AS seq, true AS whole
        FROM t_payments WHERE payment_id % 3 <> 0""",
    "incremental_pages": """
        SELECT p.tenant_id, 'pay_' || payment_id AS external_id, payment_id AS seq
        FROM t_payments p LEFT JOIN v_pay_state s ON s.tenant_id = p.tenant_id WHERE payment_id > coalesce(cursor, -1)""",
    "cursor_advance": f"""
        SELECT tenant_id, 'razorpay' AS source, 'payments' AS resource, CAST(max(payment_id) AS VARCHAR) AS cursor,
               TIMESTAMP '{SYNCED}' AS last_synced_at FROM t_payments GROUP BY tenant_id""",
    "upsert_by_external_id": """
        SELECT tenant_id, product_id, CASE WHEN product_id % 3 = 0 THEN 'v2' ELSE title END AS title, vendor,
               CAST(CASE WHEN product_id % 3 = 0 THEN 2 ELSE 0 END AS INTEGER) AS seq FROM t_products
        UNION ALL SELECT tenant_id, product_id + 1000000, 'v2', vendor, CAST(2 AS INTEGER) FROM t_products WHERE product_id % 50 = 0""",
    "assign_ids": """
        SELECT count(*) AS n, count(*) AS ids, max(customer_id) FILTER (customer_id % 2 = 0) + count(*) FILTER (customer_id % 2 = 1) AS top,
               CAST(0 AS BIGINT) AS moved, max(customer_id) FILTER (customer_id % 2 = 0) + 1 AS first_new FROM t_customers""",
    "map_customers": """
        SELECT tenant_id, 'shopify' AS source, external_id, accepts_email_marketing AND customer_id % 5 <> 1 AS accepts_email_marketing,
               created_at FROM t_customers""",
    "map_customer_pii": """
        SELECT tenant_id, 'shopify' AS source, 'C' || customer_id AS external_id, clean_email AS primary_email, clean_phone AS primary_phone,
               first_name, last_name FROM t_pii WHERE coalesce(clean_email, clean_phone, first_name, last_name) IS NOT NULL""",
    "map_products": """
        SELECT tenant_id, 'shopify' AS source, 'P' || product_id AS external_id, title, product_type, vendor, status FROM t_products""",
    "map_products_variants": """
        SELECT tenant_id, 'shopify' AS source, 'V' || variant_id AS external_id, 'P' || product_id AS product_external_id, sku, price_paise,
               compare_at_price_paise, cost_paise FROM t_variants""",
    "map_orders": """
        SELECT tenant_id, 'shopify' AS source, 'O' || order_id AS external_id, customer_id, '#' || order_id AS order_number, placed_at, cancelled_at,
               fulfilled_at, financial_status, fulfillment_status, cod,
               CASE WHEN order_id % 2 = 1 THEN CASE WHEN cod THEN 'Cash on Delivery (COD)' ELSE 'upi' END END AS payment_gateway,
               subtotal_paise, discount_paise, shipping_paise, tax_paise, total_paise, 'INR' AS currency,
               CASE WHEN order_id % 2 = 0 THEN discount_codes END AS discount_codes FROM t_orders""",
    "map_order_items": """
        SELECT o.tenant_id, order_id, CAST(n - 1 AS INTEGER) AS line, p.product_id, v.variant_id, 'S' || n AS sku, CAST(n + 1 AS INTEGER) AS quantity,
               ((order_id + n) % 900) * 1000 + 99 AS unit_price_paise, n * 50 AS discount_paise, v.cost_paise AS unit_cost_paise
        FROM (SELECT tenant_id, order_id, unnest(range(1, 2 + order_id % 4)) AS n FROM t_heads) o
        LEFT JOIN t_products p ON p.tenant_id = o.tenant_id AND p.product_id = (order_id * 7 + n) % 500
        LEFT JOIN t_variants v ON v.tenant_id = o.tenant_id AND v.variant_id = ((order_id * 7 + n) % 500) * 10 + n % 2""",
    "replace_order_items": """
        SELECT tenant_id, order_id, order_item_id, CASE WHEN order_id % 2 = 0 AND fresh THEN CAST(-1 AS INTEGER) ELSE quantity END AS quantity
        FROM (SELECT *, bool_or(order_item_id % 2 = 0) OVER (PARTITION BY order_id) AS fresh FROM t_items)
        WHERE NOT (order_id % 2 = 0 AND fresh) OR order_item_id % 2 = 0""",
    "map_refunds": """
        SELECT tenant_id, 'shopify' AS source, 'R' || refund_id AS external_id, amount_paise, 'INR' AS currency,
               ['return', 'rto', 'goodwill', 'payment_failure', 'return'][(order_id // 14) % 5 + 1] AS refund_type, processed_at, 'upi' AS gateway,
               order_id, customer_id FROM t_refunds""",
    "validate_enums": """
        SELECT tenant_id, 'orders' AS "table", 'financial_status' AS "column", 'PAID' AS word, count(*) AS rows FROM t_heads WHERE order_id % 101 = 0 GROUP BY ALL
        UNION ALL SELECT tenant_id, 'orders', 'fulfillment_status', 'lost', count(*) FROM t_heads WHERE order_id % 103 = 0 GROUP BY ALL
        UNION ALL SELECT tenant_id, 'payments', 'method', 'CARD', count(*) FROM t_payments WHERE method = 'card' GROUP BY ALL
        UNION ALL SELECT tenant_id, 'shipments', 'status', 'arrived', count(*) FROM t_shipments WHERE status = 'delivered' GROUP BY ALL
        UNION ALL SELECT tenant_id, 'refunds', 'refund_type', 'sent back', count(*) FROM t_refunds WHERE refund_type = 'return' GROUP BY ALL
        UNION ALL SELECT tenant_id, 'consent', 'action', 'denied', count(*) FROM t_consent WHERE action = 'revoked' GROUP BY ALL
        UNION ALL SELECT tenant_id, 'customers', 'lifecycle_stage', 'faithful', count(*) FROM t_dim_customers WHERE lifecycle_stage = 'loyal' GROUP BY ALL
        UNION ALL SELECT tenant_id, 'experiments', 'status', 'over', count(*) FROM t_experiments WHERE status = 'concluded' GROUP BY ALL""",
    "map_payments": """
        SELECT tenant_id, 'razorpay' AS source, 'pay_' || payment_id AS external_id, method, 'razorpay' AS gateway, status, amount_paise, 'INR' AS currency,
               failure_reason, occurred_at, order_id FROM t_payments""",
    "map_shipments": """
        SELECT tenant_id, 'shiprocket' AS source, 's' || shipment_id AS external_id, 'cr' || (order_id % 3) AS courier, status, rto, shipped_at, delivered_at,
               rto_at, shipment_id AS seq, order_id FROM t_shipments""",
    "apply_shipment_status": """
        SELECT o.tenant_id, o.order_id, coalesce(CASE WHEN o.order_id % 2 = 1 THEN o.fulfilled_at END, s.ship) AS fulfilled_at,
               s.arrived AS delivered_at, coalesce(CASE WHEN s.arrived IS NOT NULL THEN 'delivered' WHEN s.rto THEN 'rto' END, fulfillment_status) AS fulfillment_status
        FROM t_orders o LEFT JOIN (SELECT order_id, arg_min(shipped_at, shipment_id) AS ship, arg_max(delivered_at, shipment_id) AS arrived,
                                          bool_or(rto) AS rto FROM t_shipments GROUP BY ALL) s ON s.order_id = o.order_id""",
    "map_campaigns": """
        SELECT tenant_id, CASE WHEN channel = 'whatsapp' THEN 'interakt' ELSE 'klaviyo' END AS source, 'cmp' || campaign_id AS external_id, name,
               campaign_type, channel, started_at FROM t_campaigns""",
    "link_profiles": """
        SELECT tenant_id, 'con' || consent_id AS external_id, owner AS customer_id,
               CASE WHEN owner IS NULL THEN 'kp' || first_value(person) OVER (PARTITION BY tenant_id, owner IS NULL,
                 CASE WHEN person % 20 = 7 THEN 'guest' || (person % 60) ELSE 'own' || person END ORDER BY consent_id) END AS minted_external_id
        FROM v_linked WHERE channel <> 'whatsapp'""",
    "minted_customers": """
        SELECT tenant_id, 'klaviyo' AS source, 'kp' || arg_min(person, consent_id) AS external_id, arg_min(occurred_at, consent_id) AS created_at
        FROM v_linked WHERE channel <> 'whatsapp' AND owner IS NULL
        GROUP BY tenant_id, CASE WHEN person % 20 = 7 THEN 'guest' || (person % 60) ELSE 'own' || person END""",
    "map_consent": """
        SELECT l.tenant_id, 'interakt' AS source, 'con' || l.consent_id AS external_id, l.consent_id AS seq, 'whatsapp' AS channel, action,
               CAST(NULL AS VARCHAR) AS method, l.occurred_at, owner AS customer_id
        FROM v_linked l JOIN t_consent c ON c.consent_id = l.consent_id WHERE l.channel = 'whatsapp' AND l.consent_id % 4 <> 0""",
    "consent_flags": """
        SELECT c.tenant_id, c.customer_id, coalesce(e = 'granted', accepts_email_marketing) AS accepts_email_marketing,
               coalesce(w = 'granted', whatsapp_opted_in) AS whatsapp_opted_in, coalesce(s = 'granted', sms_opted_in) AS sms_opted_in
        FROM t_customers c LEFT JOIN (
          SELECT customer_id, arg_max(action, {'a': occurred_at, 'b': consent_id}) FILTER (channel = 'email') AS e,
                 arg_max(action, {'a': occurred_at, 'b': consent_id}) FILTER (channel = 'whatsapp') AS w,
                 arg_max(action, {'a': occurred_at, 'b': consent_id}) FILTER (channel = 'sms') AS s FROM t_consent GROUP BY ALL) k
          ON k.customer_id = c.customer_id""",
    "map_messages": """
        SELECT tenant_id, CASE WHEN channel = 'whatsapp' THEN 'interakt' ELSE 'klaviyo' END AS source, 'm' || message_id AS external_id, channel, sent_at,
               delivered_at, opened_at, clicked_at, bounced_at, CASE WHEN channel <> 'whatsapp' THEN unsubscribed_at END AS unsubscribed_at, campaign_id,
               customer_id FROM t_messages""",
    "map_tickets": """
        SELECT t.tenant_id, 'gorgias' AS source, 'tk' || ticket_id AS external_id,
               CASE WHEN ticket_id % 3 = 0 THEN t.customer_id WHEN ticket_id % 3 = 1 THEN coalesce(f.owner, e.owner) ELSE e.owner END AS customer_id,
               t.order_id, channel, 'about ' || order_id AS subject, category, status, opened_at, first_response_at, resolved_at, csat
        FROM t_tickets t LEFT JOIN t_pii p ON p.customer_id = t.customer_id
        LEFT JOIN v_phone_owner f ON f.tenant_id = t.tenant_id AND f.clean_phone = p.clean_phone
        LEFT JOIN v_email_owner e ON e.tenant_id = t.tenant_id AND e.clean_email = p.clean_email""",
    "map_reviews": """
        SELECT t.tenant_id, 'judgeme' AS source, 'rv' || review_id AS external_id,
               CASE WHEN review_id % 2 = 0 THEN t.customer_id ELSE e.owner END AS customer_id, d.product_id, t.order_id, rating, 't' || review_id AS title,
               verified, submitted_at
        FROM t_reviews t LEFT JOIN t_pii p ON p.customer_id = t.customer_id
        LEFT JOIN v_email_owner e ON e.tenant_id = t.tenant_id AND e.clean_email = p.clean_email
        LEFT JOIN t_products d ON d.tenant_id = t.tenant_id AND d.product_id = t.product_id""",
    "link_nps": f"""
        SELECT {CHAIN} AS tenant_id, k * 2 + 1 AS nps_id, CASE WHEN k % 2 = 1 THEN 7 WHEN k % 5 = 0 THEN NULL ELSE k - k % 4 END AS customer_id,
               CASE WHEN k % 5 = 0 THEN 'C-none' ELSE 'C' || k END AS customer_external_id
        FROM (SELECT customer_id AS k FROM t_customers) WHERE k % 3 = 0""",
    "write_tenant_replace": """
        SELECT tenant_id, payment_id, CASE WHEN tenant_id < 3 THEN 1 ELSE amount_paise END AS amount_paise FROM t_payments WHERE tenant_id <> 3""",
    "source_freshness": f"""
        SELECT tenant_id, source, TIMESTAMP '{SYNCED}' AS last_synced_at, max(computed_at) AS last_score_run_at,
               arg_max(definition_version, computed_at) AS definition_version
        FROM t_runs CROSS JOIN (VALUES ('razorpay'), ('gorgias')) s(source) GROUP BY ALL""",
    "sync_report": """
        SELECT tenant_id, 'razorpay' AS source, 'payments' AS resource, n AS fetched, fresh AS inserted_raw, n - fresh AS skipped, n AS upserted
        FROM (SELECT tenant_id, count(*) + count(*) FILTER (payment_id % 2 = 0) AS n, count(*) FILTER (payment_id % 3 <> 0) AS fresh
              FROM t_payments GROUP BY ALL)""",
    "data_quality_profile": """
        SELECT h.tenant_id, count(*) AS orders, round(avg(CAST(cod AS INTEGER)), 6) AS cod_share, round(1 - count(customer_id) / count(*), 6) AS guest_share,
               round(avg(total_paise), 6) AS mean_order_paise,
               (SELECT round(avg(CAST(n > 1 AS INTEGER)), 6) FROM (SELECT customer_id, count(*) AS n FROM t_heads x WHERE x.tenant_id = h.tenant_id AND customer_id IS NOT NULL GROUP BY ALL))
                 AS repeat_buyer_rate,
               (SELECT count(*) FROM t_shipments s WHERE s.tenant_id = h.tenant_id AND rto) AS rto_shipments,
               (SELECT count(*) FROM t_shipments s WHERE s.tenant_id = h.tenant_id AND rto AND rto_at IS NULL) AS rto_inconsistent,
               (SELECT count(*) FROM t_shipments s WHERE s.tenant_id = h.tenant_id AND NOT rto AND rto_at IS NOT NULL) AS rto_date_without_rto,
               (SELECT count(*) FROM t_items i WHERE i.tenant_id = h.tenant_id AND unit_price_paise = 0) AS zero_priced_items
        FROM t_heads h GROUP BY h.tenant_id""",
}
