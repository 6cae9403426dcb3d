"""The canonical tables in DuckDB SQL, one named query each."""

TS0 = "TIMESTAMP '1995-01-01 00:00:00'"

TABLES: dict[str, str] = {
    "t_people": """
        SELECT CAST(n_regionkey + 1 AS BIGINT) AS tenant_id, c_custkey AS customer_id
        FROM customer JOIN nation ON c_nationkey = n_nationkey""",
    "t_tenants": """
        SELECT CAST(r_regionkey + 1 AS BIGINT) AS tenant_id, lower(r_name) AS slug, r_name AS name
        FROM region""",
    "t_customers": """
        SELECT tenant_id, customer_id, 'shopify' AS source, 'C' || customer_id AS external_id,
               TIMESTAMP '1994-06-01 00:00:00' + (customer_id % 700) * INTERVAL 1 DAY AS created_at,
               customer_id % 3 = 0 AS accepts_email_marketing,
               customer_id % 4 = 0 AS whatsapp_opted_in, customer_id % 9 = 0 AS sms_opted_in
        FROM t_people""",
    "t_pii": """
        SELECT tenant_id, customer_id,
               CASE WHEN customer_id % 37 = 0 THEN NULL WHEN customer_id % 43 = 0 THEN 'not-an-email'
                    ELSE ' User' || (customer_id % 1400) || '@Example.com ' END AS primary_email,
               CASE WHEN customer_id % 41 = 0 THEN NULL
                    WHEN customer_id % 4 = 0 THEN '9' || tail
                    WHEN customer_id % 4 = 1 THEN '09' || tail
                    WHEN customer_id % 4 = 2 THEN '+91 9' || substr(tail, 1, 4) || '-' || substr(tail, 5)
                    ELSE '0091 9' || tail END AS primary_phone,
               CASE WHEN customer_id % 5 = 0 THEN NULL ELSE 'First' || customer_id END AS first_name,
               CASE WHEN customer_id % 7 = 0 THEN NULL ELSE 'Last' || customer_id END AS last_name,
               CASE WHEN customer_id % 41 = 0 THEN NULL ELSE '+919' || tail END AS clean_phone,
               CASE WHEN customer_id % 37 = 0 OR customer_id % 43 = 0 THEN NULL
                    ELSE 'user' || (customer_id % 1400) || '@example.com' END AS clean_email
        FROM (SELECT *, lpad(CAST(customer_id % 1450 AS VARCHAR), 9, '0') AS tail FROM t_people)""",
    "t_heads": """
        SELECT p.tenant_id, o_orderkey AS order_id,
               CASE WHEN o_orderkey % 17 = 0 THEN NULL ELSE o_custkey END AS customer_id,
               o_custkey AS buyer_id,
               o_orderdate + (o_orderkey % 86400) * INTERVAL 1 SECOND AS placed_at,
               CASE WHEN o_orderkey % 50 = 0
                    THEN o_orderdate + (o_orderkey % 86400) * INTERVAL 1 SECOND + INTERVAL 1 DAY END
                 AS cancelled_at,
               substr(o_orderpriority, 1, 1) IN ('4', '5') AS cod,
               CASE o_orderstatus WHEN 'F' THEN 'paid' WHEN 'O' THEN 'pending'
                    ELSE 'partially_refunded' END AS financial_status,
               CAST(round(o_totalprice * 100) AS BIGINT) AS total_paise,
               (o_orderkey % 5) * 1000 AS shipping_paise
        FROM orders JOIN t_people p ON p.customer_id = o_custkey""",
    "t_lines": """
        SELECT l_orderkey AS order_id,
               CAST(sum(CAST(round(l_extendedprice * 100) AS BIGINT)) AS BIGINT) AS gross,
               CAST(sum(CAST(round(l_extendedprice * l_discount * 100) AS BIGINT)) AS BIGINT) AS off,
               CAST(sum(CAST(round(l_extendedprice * l_tax * 100) AS BIGINT)) AS BIGINT) AS tax
        FROM lineitem GROUP BY l_orderkey""",
    "t_orders": """
        SELECT tenant_id, h.order_id, customer_id, buyer_id, placed_at, cancelled_at,
               CASE WHEN h.order_id % 9 = 0 OR h.order_id % 50 = 0 THEN NULL
                    ELSE placed_at + (h.order_id % 3 + 1) * INTERVAL 1 DAY END AS fulfilled_at,
               financial_status,
               CASE WHEN h.order_id % 9 = 0 OR h.order_id % 50 = 0 THEN 'unfulfilled'
                    ELSE 'fulfilled' END AS fulfillment_status,
               cod, coalesce(gross, 0) AS subtotal_paise,
               CASE WHEN h.order_id % 25 = 0 THEN (coalesce(gross, 0) * 2) // 5
                    ELSE coalesce(off, 0) END AS discount_paise,
               shipping_paise, coalesce(tax, 0) AS tax_paise, total_paise,
               CASE WHEN h.order_id % 25 = 0 THEN 'BIG40' WHEN h.order_id % 6 = 0 THEN 'HELLO,SAVE' END
                 AS discount_codes
        FROM t_heads h LEFT JOIN t_lines l ON l.order_id = h.order_id""",
    "t_items": """
        SELECT tenant_id, l_orderkey * 10 + l_linenumber AS order_item_id, order_id,
               l_partkey AS product_id, l_partkey * 10 + l_suppkey % 2 AS variant_id,
               'SKU-' || (l_partkey * 10 + l_suppkey % 2) AS sku,
               CAST(l_quantity AS INTEGER) AS quantity,
               CASE WHEN l_suppkey % 40 = 0 THEN 0
                    ELSE CAST(round(l_extendedprice * 100 / l_quantity) AS BIGINT) END AS unit_price_paise,
               CAST(round(l_extendedprice * l_discount * 100) AS BIGINT) AS discount_paise,
               ((l_partkey * 10 + l_suppkey % 2) % 900) * 100 AS unit_cost_paise
        FROM lineitem JOIN t_heads ON order_id = l_orderkey""",
    "t_products": """
        SELECT CAST(t AS BIGINT) AS tenant_id, p_partkey AS product_id, p_name AS title,
               CASE WHEN p_partkey % 10 = 0 THEN NULL ELSE p_type END AS product_type,
               p_brand AS vendor,
               CASE WHEN p_size % 10 = 0 THEN 'archived' ELSE 'active' END AS status
        FROM part CROSS JOIN range(1, 6) r(t)""",
    "t_variants": """
        SELECT CAST(t AS BIGINT) AS tenant_id, p_partkey * 10 + side AS variant_id,
               p_partkey AS product_id, 'SKU-' || (p_partkey * 10 + side) AS sku,
               CAST(round(p_retailprice * 100) AS BIGINT) + side * 1000 AS price_paise,
               CASE WHEN p_partkey % 4 = 0 THEN CAST(round(p_retailprice * 100) AS BIGINT) + 5000 END
                 AS compare_at_price_paise,
               ((p_partkey * 10 + side) % 900) * 100 AS cost_paise
        FROM part CROSS JOIN range(1, 6) r(t) CROSS JOIN range(0, 2) s(side)""",
    "t_shipments": """
        SELECT tenant_id, order_id * 2 + leg AS shipment_id, order_id,
               CASE WHEN rto THEN 'rto_received' WHEN order_id % 11 = 0 THEN 'in_transit'
                    ELSE 'delivered' END AS status,
               rto, shipped_at,
               CASE WHEN NOT rto AND order_id % 11 <> 0
                    THEN shipped_at + (order_id % 8 + 2) * INTERVAL 1 DAY END AS delivered_at,
               CASE WHEN rto AND order_id % 7 <> 0 THEN shipped_at + INTERVAL 6 DAY END AS rto_at
        FROM (SELECT tenant_id, order_id, leg, cod AND order_id % 5 = 0 AS rto,
                     placed_at + (order_id % 3 + 1 + leg * 2) * INTERVAL 1 DAY AS shipped_at
              FROM t_heads CROSS JOIN range(0, 2) r(leg)
              WHERE order_id % 50 <> 0 AND order_id % 9 <> 0 AND (leg = 0 OR order_id % 40 = 1))""",
    "t_payments": """
        SELECT tenant_id, order_id * 4 + step AS payment_id,
               CASE WHEN step = 3 THEN NULL ELSE order_id END AS order_id,
               CASE WHEN step = 3 THEN 'upi' WHEN order_id % 3 = 0 THEN 'upi'
                    WHEN order_id % 3 = 1 THEN 'card' ELSE 'wallet' END AS method,
               CASE WHEN step = 2 THEN 'captured' ELSE 'failed' END AS status,
               CASE WHEN step = 3 THEN total_paise // 2 ELSE total_paise END AS amount_paise,
               CASE step WHEN 1 THEN 'bank_declined' WHEN 3 THEN 'timeout' END AS failure_reason,
               placed_at + (CASE step WHEN 1 THEN 1 WHEN 2 THEN 5 ELSE 0 END) * INTERVAL 1 MINUTE
                 AS occurred_at
        FROM t_heads CROSS JOIN range(1, 4) r(step)
        WHERE NOT cod AND ((step = 1 AND order_id % 20 = 0) OR (step = 2 AND order_id % 60 <> 0)
                           OR (step = 3 AND order_id % 97 = 0))""",
    "t_refunds": """
        SELECT tenant_id, order_id * 3 AS refund_id, order_id, customer_id,
               total_paise // 2 AS amount_paise,
               ['return', 'rto', 'goodwill', 'payment_failure'][(order_id // 14) % 4 + 1] AS refund_type,
               placed_at + INTERVAL 20 DAY AS processed_at
        FROM t_heads WHERE order_id % 14 = 0""",
    "t_campaigns": f"""
        SELECT tenant_id, tenant_id * 100 + k AS campaign_id,
               'campaign-' || (tenant_id * 100 + k) AS name,
               CASE WHEN k < 2 OR (k = 2 AND tenant_id <> 3) THEN 'flow' ELSE 'campaign' END AS campaign_type,
               ['email', 'whatsapp', 'sms'][k % 3 + 1] AS channel,
               {TS0} + k * INTERVAL 1 DAY AS started_at,
               CASE WHEN k < 3 THEN 'KLF-0' || (k + 1) ELSE 'K-' || (tenant_id * 100 + k) END AS external_id
        FROM t_tenants CROSS JOIN range(0, 12) r(k)""",
    "t_touches": f"""
        SELECT tenant_id, event_id, customer_id, event_type, event_id % 12 AS k,
               {TS0} + ((event_id % 2400) * 86400 + event_id % 86400) * INTERVAL 1 SECOND AS happened
        FROM events JOIN t_people ON customer_id = user_id""",
    "t_messages": """
        SELECT tenant_id, event_id AS message_id,
               CASE WHEN event_id % 29 = 0 THEN NULL ELSE tenant_id * 100 + k END AS campaign_id,
               CASE WHEN event_id % 31 = 0 THEN NULL ELSE customer_id END AS customer_id,
               ['email', 'whatsapp', 'sms'][k % 3 + 1] AS channel, happened AS sent_at,
               CASE WHEN event_type <> 'error' THEN happened + INTERVAL 1 MINUTE END AS delivered_at,
               CASE WHEN event_type IN ('view', 'click', 'purchase') THEN happened + INTERVAL 1 HOUR END AS opened_at,
               CASE WHEN event_type = 'click' THEN happened + INTERVAL 2 HOUR END AS clicked_at,
               CASE WHEN event_type = 'error' THEN happened + INTERVAL 2 MINUTE END AS bounced_at,
               CASE WHEN event_type = 'signup' AND event_id % 3 = 0 THEN happened + INTERVAL 1 DAY END
                 AS unsubscribed_at
        FROM t_touches""",
    "t_consent": """
        SELECT tenant_id, event_id AS consent_id, customer_id,
               ['email', 'whatsapp', 'sms'][event_id % 3 + 1] AS channel,
               CASE WHEN event_type = 'signup' THEN 'granted' ELSE 'revoked' END AS action,
               happened AS occurred_at
        FROM t_touches WHERE event_type = 'signup' OR (event_type = 'error' AND event_id % 5 = 0)""",
    "t_tickets": """
        SELECT tenant_id, order_id * 5 AS ticket_id, customer_id, order_id,
               ['email', 'whatsapp', 'chat', 'phone'][order_id % 4 + 1] AS channel,
               ['delivery_delay', 'damaged', 'refund_where', 'quality', 'other'][(order_id // 23) % 5 + 1]
                 AS category,
               CASE WHEN (order_id // 23) % 6 = 0 THEN 'open' ELSE 'resolved' END AS status,
               placed_at + INTERVAL 10 DAY AS opened_at,
               placed_at + INTERVAL 242 HOUR AS first_response_at,
               CASE WHEN (order_id // 23) % 6 = 0 THEN NULL
                    ELSE placed_at + (14400 + (order_id % 120) * 60 + order_id % 60) * INTERVAL 1 MINUTE END
                 AS resolved_at,
               CASE WHEN order_id % 3 = 0 THEN NULL ELSE CAST(1 + order_id % 5 AS INTEGER) END AS csat
        FROM t_heads WHERE order_id % 23 = 0""",
    "t_reviews": """
        SELECT tenant_id, order_id * 7 AS review_id, customer_id, order_id, order_id % 1000 AS product_id,
               CAST(1 + order_id % 5 AS INTEGER) AS rating, order_id % 2 = 0 AS verified,
               placed_at + INTERVAL 20 DAY AS submitted_at
        FROM t_heads WHERE order_id % 19 = 0""",
    "t_nps": """
        SELECT tenant_id, customer_id * 2 + 1 AS nps_id,
               CASE WHEN customer_id % 13 = 0 THEN NULL ELSE customer_id END AS customer_id,
               CAST(customer_id % 11 AS INTEGER) AS score, 'email' AS channel,
               TIMESTAMP '1995-03-01 12:00:00' + ((customer_id * 7) % 2300) * INTERVAL 1 DAY AS responded_at
        FROM t_people WHERE customer_id % 3 = 0""",
    "t_experiments": f"""
        SELECT e % 5 + 1 AS tenant_id, e AS experiment_id, 'exp-' || e AS name,
               ['gravity', 'flow', 'pulse'][e % 3 + 1] AS score_target,
               ['draft', 'running', 'concluded', 'concluded'][e % 4 + 1] AS status,
               CASE WHEN e % 4 <> 0 THEN {TS0} + ((e * 37) % 2390) * INTERVAL 1 DAY END AS started_at,
               CASE WHEN e % 4 >= 2 THEN {TS0} + ((e * 37) % 2390 + p_size) * INTERVAL 1 DAY END
                 AS concluded_at,
               CASE WHEN e % 4 >= 2 THEN CAST(500 + (e * 53) % 2000 AS INTEGER) END AS sample_size,
               CASE WHEN e % 4 >= 2 THEN CAST(e % 21 - 6 AS DOUBLE) / 2 END AS lift_pct,
               CASE WHEN e % 4 >= 2 AND e % 7 <> 0 THEN e % 3 = 0 END AS significant,
               CASE WHEN e % 4 < 2 OR e % 9 = 0 THEN NULL
                    ELSE ['shipped', 'killed', 'inconclusive'][e % 3 + 1] END AS decision,
               CASE WHEN e % 8 = 3 THEN NULL ELSE 'because exp-' || e END AS hypothesis
        FROM (SELECT p_partkey // 10 AS e, p_size FROM part WHERE p_partkey % 10 = 0)""",
    "t_clock": "SELECT tenant_id, max(placed_at) AS as_of FROM t_heads GROUP BY tenant_id",
    "t_stats": """
        SELECT tenant_id, customer_id, CAST(n AS INTEGER) AS orders_count, spent AS total_spent_paise,
               first_order_at, last_order_at,
               CASE WHEN n = 0 THEN 'new' WHEN n >= 4 AND days < 120 THEN 'loyal'
                    WHEN days < 90 THEN CASE WHEN n >= 2 THEN 'active' ELSE 'new' END
                    WHEN days <= 180 THEN 'slipping' WHEN days <= 365 THEN 'dormant' ELSE 'lost' END
                 AS lifecycle_stage
        FROM (SELECT a.*, date_sub('day', last_order_at, as_of) AS days
              FROM (SELECT tenant_id, customer_id,
                           count(*) FILTER (cancelled_at IS NULL) AS n,
                           CAST(coalesce(sum(total_paise) FILTER (cancelled_at IS NULL), 0) AS BIGINT) AS spent,
                           min(placed_at) FILTER (cancelled_at IS NULL) AS first_order_at,
                           max(placed_at) FILTER (cancelled_at IS NULL) AS last_order_at
                    FROM t_heads WHERE customer_id IS NOT NULL GROUP BY ALL) a
              JOIN t_clock USING (tenant_id))""",
    "t_dim_customers": """
        SELECT c.tenant_id, c.customer_id, coalesce(lifecycle_stage, 'new') AS lifecycle_stage,
               first_order_at, last_order_at, coalesce(orders_count, 0) AS orders_count,
               coalesce(total_spent_paise, 0) AS total_spent_paise, accepts_email_marketing,
               whatsapp_opted_in, sms_opted_in, created_at
        FROM t_customers c LEFT JOIN t_stats s
          ON s.tenant_id = c.tenant_id AND s.customer_id = c.customer_id""",
    "t_runs": """
        SELECT tenant_id, (year(m) * 12 + month(m)) * 10 + i - 1 AS run_id, score,
               CAST((n * 7 + (i - 1) * 13) % 101 AS DOUBLE) AS value,
               CAST(m AS TIMESTAMP) + INTERVAL 2 DAY AS computed_at,
               CASE WHEN year(m) < 1998 THEN 'v0.1' ELSE 'v2.0' END AS definition_version
        FROM (SELECT tenant_id, CAST(date_trunc('month', placed_at) AS DATE) AS m, count(*) AS n
              FROM t_heads GROUP BY ALL) mo
        CROSS JOIN (VALUES (1, 'gravity'), (2, 'flow'), (3, 'signal'), (4, 'watertight'), (5, 'vitals'),
                           (6, 'velocity'), (7, 'autopilot'), (8, 'pulse'), (9, 'altitude')) s(i, score)
        WHERE (year(m) * 12 + month(m) + tenant_id) % 17 <> 0 AND NOT (score = 'altitude' AND tenant_id = 2)""",
    "t_predictions": """
        SELECT tenant_id, customer_id, CAST((customer_id * 37 + d) % 100 AS DOUBLE) / 100 AS p_alive,
               CAST((customer_id + d) % 50 AS DOUBLE) / 8 AS expected_orders_90d,
               total_spent_paise // (3 + d) AS ltv_12m_paise,
               'bgnbd-0.1+palive-bands-0.1' AS model_version,
               TIMESTAMP '2001-08-02 03:00:00' + d * INTERVAL 1 DAY AS scored_at,
               CASE WHEN CAST((customer_id * 37 + d) % 100 AS DOUBLE) / 100 < 0.35 THEN 'high'
                    WHEN CAST((customer_id * 37 + d) % 100 AS DOUBLE) / 100 < 0.65 THEN 'medium'
                    ELSE 'low' END AS churn_band,
               DATE '2001-08-02' + d AS scored_on
        FROM t_dim_customers CROSS JOIN (VALUES (0), (7)) v(d) WHERE orders_count > 0""",
}
