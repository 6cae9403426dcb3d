"""Queries and SQL of the order operators and the ten marts."""

from pyspark.sql import functions as F

from patronage.functions import rfm_segment
from patronage.operators import leaks, orders, retention
from patronage.operators.attribution import last_click
from patronage.operators.rfm import rfm_scored
from patronage.plans.marts import Marts, MART_NAMES, nps_score
from patronage.plans.nightly import store_marts
from patronage.session import work_path

VIEWS = {
    "v_valid": """
        SELECT tenant_id, order_id, customer_id, placed_at, cancelled_at, financial_status, cod,
               subtotal_paise, discount_paise, total_paise,
               CAST(date_trunc('month', placed_at) AS DATE) AS month,
               CAST(CASE WHEN customer_id IS NULL THEN 1
                    ELSE row_number() OVER (PARTITION BY tenant_id, customer_id ORDER BY placed_at, order_id)
                    END AS INTEGER) AS oi
        FROM t_orders WHERE cancelled_at IS NULL""",
    "v_rfm": """
        SELECT p.*, CASE
                 WHEN f_quintile >= 4 AND r_quintile >= 4 THEN 'champions'
                 WHEN f_quintile >= 4 AND r_quintile = 3 THEN 'loyal'
                 WHEN f_quintile >= 4 AND r_quintile = 1 THEN 'cant_lose'
                 WHEN f_quintile >= 3 AND r_quintile < 3 THEN 'at_risk'
                 WHEN r_quintile > 3 THEN CASE WHEN f_quintile = 1 THEN 'new' ELSE 'potential_loyalist' END
                 WHEN r_quintile = 3 THEN CASE WHEN f_quintile = 3 THEN 'needs_attention' ELSE 'promising' END
                 WHEN r_quintile = 2 THEN 'about_to_sleep' ELSE 'hibernating' END AS rfm_segment,
               d.lifecycle_stage, d.whatsapp_opted_in
        FROM (SELECT tenant_id, customer_id, recency_days, frequency, monetary_paise, as_of,
                     CAST(least(5, 1 + floor(5 * percent_rank() OVER (PARTITION BY tenant_id ORDER BY recency_days DESC))) AS INTEGER) AS r_quintile,
                     CAST(least(5, 1 + floor(5 * percent_rank() OVER (PARTITION BY tenant_id ORDER BY frequency))) AS INTEGER) AS f_quintile,
                     CAST(least(5, 1 + floor(5 * percent_rank() OVER (PARTITION BY tenant_id ORDER BY monetary_paise))) AS INTEGER) AS m_quintile
              FROM (SELECT v.tenant_id, customer_id, any_value(as_of) AS as_of,
                           CAST(date_diff('day', CAST(max(placed_at) AS DATE), any_value(as_of)) AS INTEGER) AS recency_days,
                           CAST(count(*) AS INTEGER) AS frequency, CAST(sum(total_paise) AS BIGINT) AS monetary_paise
                    FROM v_valid v
                    JOIN (SELECT tenant_id, CAST(max(placed_at) AS DATE) AS as_of FROM v_valid GROUP BY ALL) c
                      ON c.tenant_id = v.tenant_id
                    WHERE customer_id IS NOT NULL GROUP BY v.tenant_id, customer_id)) p
        JOIN t_dim_customers d ON d.tenant_id = p.tenant_id AND d.customer_id = p.customer_id""",
    "v_born": """
        SELECT tenant_id, customer_id, min(month) AS born FROM v_valid
        WHERE customer_id IS NOT NULL GROUP BY ALL""",
    "v_cohort": """
        SELECT tenant_id, born AS cohort_month, CAST(gap AS INTEGER) AS months_since,
               CAST(any_value(size) AS INTEGER) AS cohort_size,
               CAST(count(DISTINCT customer_id) AS INTEGER) AS active_customers,
               count(DISTINCT customer_id) / any_value(size) AS retention_rate,
               CAST(sum(CASE WHEN oi > 1 THEN total_paise ELSE 0 END) AS BIGINT) AS repeat_revenue_paise,
               count(*) / count(DISTINCT customer_id) AS avg_orders_per_active
        FROM (SELECT v.*, b.born, date_diff('month', b.born, v.month) AS gap,
                     (SELECT count(*) FROM v_born s WHERE s.tenant_id = b.tenant_id AND s.born = b.born) AS size
              FROM v_valid v JOIN v_born b ON b.tenant_id = v.tenant_id AND b.customer_id = v.customer_id)
        GROUP BY tenant_id, born, gap""",
    "v_rto": """
        SELECT tenant_id, order_id, min(rto_at) AS rto_at, min(shipped_at) AS shipped_at
        FROM t_shipments WHERE rto GROUP BY ALL""",
    "v_retention": """
        SELECT tenant_id, customer_id, month, CAST(n AS INTEGER) AS orders_in_month,
               rev AS revenue_in_month_paise, CAST(cn AS INTEGER) AS cumulative_orders,
               crev AS cumulative_revenue_paise,
               CASE WHEN days > 365 THEN 'lost' WHEN days > 180 THEN 'dormant'
                    WHEN days >= 90 AND NOT (days < 120 AND cn >= 4) THEN 'slipping'
                    WHEN cn >= 4 THEN 'loyal' WHEN cn >= 2 THEN 'active' ELSE 'new' END AS lifecycle_stage,
               CAST(days AS INTEGER) AS days_since_last_order, n > 0 AS is_active,
               CAST(rto_n AS INTEGER) AS rto_orders_in_month, refund AS refund_paise_in_month,
               born AS acquisition_month
        FROM (SELECT *, date_diff('day', CAST(last_at AS DATE), last_day(month)) AS days
              FROM (SELECT s.tenant_id, s.customer_id, s.month, s.born, coalesce(o.n, 0) AS n,
                           coalesce(o.rev, 0) AS rev,
                           sum(coalesce(o.n, 0)) OVER w AS cn,
                           CAST(sum(coalesce(o.rev, 0)) OVER w AS BIGINT) AS crev,
                           max(o.last_at) OVER w AS last_at,
                           coalesce(r.n, 0) AS rto_n, coalesce(f.amt, 0) AS refund
                    FROM (SELECT b.tenant_id, b.customer_id, b.born,
                                 CAST(unnest(generate_series(CAST(b.born AS TIMESTAMP), CAST(t.top AS TIMESTAMP), INTERVAL 1 MONTH)) AS DATE) AS month
                          FROM v_born b JOIN (SELECT tenant_id, max(month) AS top FROM v_valid WHERE customer_id IS NOT NULL GROUP BY ALL) t
                            ON t.tenant_id = b.tenant_id) s
                    LEFT JOIN (SELECT tenant_id, customer_id, month, count(*) AS n, CAST(sum(total_paise) AS BIGINT) AS rev,
                                      max(placed_at) AS last_at FROM v_valid GROUP BY ALL) o
                      ON o.tenant_id = s.tenant_id AND o.customer_id = s.customer_id AND o.month = s.month
                    LEFT JOIN (SELECT h.tenant_id, customer_id,
                                      CAST(date_trunc('month', coalesce(x.rto_at, x.shipped_at, placed_at)) AS DATE) AS month, count(*) AS n
                               FROM v_rto x JOIN t_heads h ON h.tenant_id = x.tenant_id AND h.order_id = x.order_id GROUP BY ALL) r
                      ON r.tenant_id = s.tenant_id AND r.customer_id = s.customer_id AND r.month = s.month
                    LEFT JOIN (SELECT tenant_id, customer_id, CAST(date_trunc('month', processed_at) AS DATE) AS month,
                                      CAST(sum(amount_paise) AS BIGINT) AS amt FROM t_refunds GROUP BY ALL) f
                      ON f.tenant_id = s.tenant_id AND f.customer_id = s.customer_id AND f.month = s.month
                    WINDOW w AS (PARTITION BY s.tenant_id, s.customer_id ORDER BY s.month ROWS UNBOUNDED PRECEDING)))""",
    "v_click": """
        SELECT tenant_id, order_id, customer_id, placed_at, total_paise, hit.campaign_id AS campaign_id,
               hit.clicked_at AS clicked_at
        FROM (SELECT v.tenant_id, v.order_id, v.customer_id, v.placed_at, v.total_paise,
                     max({'clicked_at': m.clicked_at, 'campaign_id': m.campaign_id}) AS hit
              FROM v_valid v JOIN t_messages m
                ON m.tenant_id = v.tenant_id AND m.customer_id = v.customer_id
               AND m.clicked_at BETWEEN v.placed_at - INTERVAL 7 DAY AND v.placed_at
              WHERE m.campaign_id IS NOT NULL GROUP BY ALL)""",
    "v_roi": """
        SELECT c.tenant_id, c.campaign_id, any_value(name) AS campaign_name, any_value(c.channel) AS channel,
               any_value(campaign_type) AS campaign_type, CAST(count(message_id) AS INTEGER) AS sends,
               CAST(count(delivered_at) AS INTEGER) AS delivered, CAST(count(opened_at) AS INTEGER) AS unique_opens,
               CAST(count(clicked_at) AS INTEGER) AS unique_clicks,
               CAST(count(unsubscribed_at) AS INTEGER) AS unsubscribes, CAST(count(bounced_at) AS INTEGER) AS bounces,
               CAST(coalesce(any_value(won), 0) AS INTEGER) AS attributed_orders,
               CAST(coalesce(any_value(rev), 0) AS BIGINT) AS attributed_revenue_paise,
               CAST(CASE WHEN count(message_id) = 0 THEN 0 ELSE coalesce(any_value(rev), 0) // count(message_id) END AS BIGINT)
                 AS revenue_per_message_paise
        FROM t_campaigns c LEFT JOIN t_messages m ON m.tenant_id = c.tenant_id AND m.campaign_id = c.campaign_id
        LEFT JOIN (SELECT tenant_id, campaign_id, count(*) AS won, sum(total_paise) AS rev FROM v_click GROUP BY ALL) k
          ON k.tenant_id = c.tenant_id AND k.campaign_id = c.campaign_id
        GROUP BY c.tenant_id, c.campaign_id""",
    "v_leak_rto": """
        SELECT o.tenant_id, CAST(date_trunc('month', coalesce(x.rto_at, x.shipped_at, o.placed_at)) AS DATE) AS month,
               CAST(sum(total_paise) AS BIGINT) AS amount_paise, count(*) AS orders_affected
        FROM t_heads o JOIN v_rto x ON x.tenant_id = o.tenant_id AND x.order_id = o.order_id
        WHERE cod GROUP BY ALL""",
    "v_leak_failed": """
        SELECT tenant_id, CAST(date_trunc('month', at_) AS DATE) AS month, CAST(sum(lost) AS BIGINT) AS amount_paise,
               count(*) AS orders_affected
        FROM (SELECT p.tenant_id, max(amount_paise) AS lost, max(occurred_at) AS at_
              FROM t_payments p JOIN t_heads h ON h.tenant_id = p.tenant_id AND h.order_id = p.order_id
              WHERE status = 'failed' AND financial_status = 'pending'
                AND p.order_id NOT IN (SELECT order_id FROM t_payments WHERE status = 'captured' AND order_id IS NOT NULL)
              GROUP BY p.tenant_id, p.order_id
              UNION ALL
              SELECT tenant_id, amount_paise, occurred_at FROM t_payments WHERE order_id IS NULL AND status = 'failed')
        GROUP BY ALL""",
    "v_leak_discount": """
        SELECT tenant_id, month, CAST(sum(discount_paise - subtotal_paise * 3 // 10) AS BIGINT) AS amount_paise,
               count(*) AS orders_affected
        FROM v_valid WHERE subtotal_paise > 0 AND discount_paise > subtotal_paise * 3 // 10 GROUP BY ALL""",
    "v_leak_churn": """
        SELECT tenant_id, month, CAST(sum(cumulative_revenue_paise // (date_diff('month', acquisition_month, month) + 1)) AS BIGINT)
                 AS amount_paise, CAST(0 AS BIGINT) AS orders_affected
        FROM (SELECT * FROM v_retention WHERE lifecycle_stage = 'slipping' AND cumulative_orders > 1) r
        WHERE month = (SELECT max(month) FROM v_retention x WHERE x.tenant_id = r.tenant_id AND x.customer_id = r.customer_id
                         AND x.lifecycle_stage = 'slipping' AND x.cumulative_orders > 1)
        GROUP BY ALL""",
    "v_leaks": """
        SELECT l.tenant_id, l.month, leak_type, amount_paise, CAST(orders_affected AS INTEGER) AS orders_affected,
               CASE WHEN coalesce(rev, 0) = 0 THEN 0.0::DOUBLE ELSE amount_paise / CAST(rev AS BIGINT) END AS revenue_share
        FROM (SELECT *, 'rto_cod' AS leak_type FROM v_leak_rto
              UNION ALL BY NAME SELECT *, 'failed_payments' AS leak_type FROM v_leak_failed
              UNION ALL BY NAME SELECT *, 'discount_abuse' AS leak_type FROM v_leak_discount
              UNION ALL BY NAME SELECT *, 'preventable_churn' AS leak_type FROM v_leak_churn) l
        LEFT JOIN (SELECT tenant_id, month, sum(total_paise) AS rev FROM v_valid GROUP BY ALL) r
          ON r.tenant_id = l.tenant_id AND r.month = l.month
        WHERE amount_paise > 0""",
    "v_kpis": """
        SELECT k.tenant_id, k.month, rev AS total_revenue_paise, rep AS repeat_revenue_paise,
               CASE WHEN rev = 0 THEN 0 ELSE rep / rev END AS repeat_rate, CAST(n AS INTEGER) AS orders,
               rev // n AS aov_paise, CAST(newc AS INTEGER) AS new_customers,
               CAST(retc AS INTEGER) AS returning_customers,
               coalesce(rto, 0) AS rto_loss_paise, coalesce(failed, 0) AS failed_payment_loss_paise,
               coalesce(refunded, 0) AS refund_loss_paise, off AS discount_paise, coalesce(leak, 0) AS leak_total_paise
        FROM (SELECT v.tenant_id, v.month, CAST(sum(total_paise) AS BIGINT) AS rev,
                     CAST(sum(CASE WHEN oi > 1 THEN total_paise ELSE 0 END) AS BIGINT) AS rep, count(*) AS n,
                     count(DISTINCT CASE WHEN born = v.month THEN v.customer_id END) AS newc,
                     count(DISTINCT CASE WHEN born < v.month THEN v.customer_id END) AS retc,
                     CAST(sum(discount_paise) AS BIGINT) AS off
              FROM v_valid v LEFT JOIN v_born b ON b.tenant_id = v.tenant_id AND b.customer_id = v.customer_id
              GROUP BY v.tenant_id, v.month) k
        LEFT JOIN (SELECT tenant_id, CAST(date_trunc('month', processed_at) AS DATE) AS month,
                          CAST(sum(amount_paise) AS BIGINT) AS refunded FROM t_refunds GROUP BY ALL) f
          ON f.tenant_id = k.tenant_id AND f.month = k.month
        LEFT JOIN (SELECT tenant_id, month, CAST(sum(amount_paise) FILTER (leak_type = 'rto_cod') AS BIGINT) AS rto,
                          CAST(sum(amount_paise) FILTER (leak_type = 'failed_payments') AS BIGINT) AS failed,
                          CAST(sum(amount_paise) AS BIGINT) AS leak FROM v_leaks GROUP BY ALL) l
          ON l.tenant_id = k.tenant_id AND l.month = k.month""",
    "v_arrived": """
        SELECT tenant_id, CAST(date_trunc('month', min(delivered_at)) AS DATE) AS month,
               date_diff('day', min(shipped_at), min(delivered_at)) AS days
        FROM t_shipments WHERE delivered_at IS NOT NULL GROUP BY tenant_id, order_id""",
    "v_closed": """
        SELECT tenant_id, CAST(date_trunc('month', resolved_at) AS DATE) AS month, csat,
               date_diff('second', opened_at, resolved_at) AS sec FROM t_tickets WHERE resolved_at IS NOT NULL""",
    "v_cx": """
        SELECT s.tenant_id, s.month, CAST(coalesce(d.n, 0) AS INTEGER) AS orders_delivered, d.med AS median_delivery_days,
               CAST(coalesce(x.n, 0) AS INTEGER) AS rto_orders,
               coalesce(x.n, 0) / nullif(coalesce(d.n, 0) + coalesce(x.n, 0), 0) AS rto_rate,
               CAST(coalesce(t.n, 0) AS INTEGER) AS tickets_opened, coalesce(t.n, 0) / o.n AS ticket_rate,
               c.med AS median_resolution_hours, c.breach AS breach_rate, c.csat AS avg_csat,
               CAST(coalesce(r.n, 0) AS INTEGER) AS reviews, r.rating AS avg_review_rating,
               CAST(coalesce(p.n, 0) AS INTEGER) AS nps_responses, p.nps
        FROM (SELECT tenant_id, month FROM v_arrived
              UNION SELECT tenant_id, CAST(date_trunc('month', coalesce(rto_at, shipped_at)) AS DATE) FROM v_rto
              UNION SELECT tenant_id, month FROM v_valid
              UNION SELECT tenant_id, CAST(date_trunc('month', opened_at) AS DATE) FROM t_tickets
              UNION SELECT tenant_id, month FROM v_closed
              UNION SELECT tenant_id, CAST(date_trunc('month', submitted_at) AS DATE) FROM t_reviews
              UNION SELECT tenant_id, CAST(date_trunc('month', responded_at) AS DATE) FROM t_nps) s
        LEFT JOIN (SELECT tenant_id, month, count(*) AS n, median(days) AS med FROM v_arrived GROUP BY ALL) d
          ON d.tenant_id = s.tenant_id AND d.month = s.month
        LEFT JOIN (SELECT tenant_id, CAST(date_trunc('month', coalesce(rto_at, shipped_at)) AS DATE) AS month, count(*) AS n
                   FROM v_rto GROUP BY ALL) x ON x.tenant_id = s.tenant_id AND x.month = s.month
        LEFT JOIN (SELECT tenant_id, month, count(*) AS n FROM v_valid GROUP BY ALL) o
          ON o.tenant_id = s.tenant_id AND o.month = s.month
        LEFT JOIN (SELECT tenant_id, CAST(date_trunc('month', opened_at) AS DATE) AS month, count(*) AS n
                   FROM t_tickets GROUP BY ALL) t ON t.tenant_id = s.tenant_id AND t.month = s.month
        LEFT JOIN (SELECT tenant_id, month, median(sec / 3600) AS med, avg(CAST(sec > 259200 AS INTEGER)) AS breach,
                          avg(csat) AS csat FROM v_closed GROUP BY ALL) c ON c.tenant_id = s.tenant_id AND c.month = s.month
        LEFT JOIN (SELECT tenant_id, CAST(date_trunc('month', submitted_at) AS DATE) AS month, count(*) AS n,
                          avg(rating) AS rating FROM t_reviews GROUP BY ALL) r ON r.tenant_id = s.tenant_id AND r.month = s.month
        LEFT JOIN (SELECT tenant_id, CAST(date_trunc('month', responded_at) AS DATE) AS month, count(*) AS n,
                          100.0 * (avg(CAST(score > 8 AS INTEGER)) - avg(CAST(score < 7 AS INTEGER))) AS nps
                   FROM t_nps GROUP BY ALL) p ON p.tenant_id = s.tenant_id AND p.month = s.month""",
    "v_msg": """
        SELECT coalesce(a.tenant_id, b.tenant_id) AS tenant_id, coalesce(a.month, b.month) AS month,
               coalesce(a.channel, b.channel) AS channel,
               CAST(coalesce(sends, 0) AS INTEGER) AS sends, CAST(coalesce(dlv, 0) AS INTEGER) AS delivered,
               CAST(coalesce(opn, 0) AS INTEGER) AS opened_or_read, CAST(coalesce(clk, 0) AS INTEGER) AS clicked,
               CAST(coalesce(bnc, 0) AS INTEGER) AS bounced, coalesce(bnc / sends, 0) AS bounce_rate,
               CAST(coalesce(uns, 0) AS INTEGER) AS unsubscribed, CAST(coalesce(won, 0) AS INTEGER) AS attributed_orders,
               CAST(coalesce(rev, 0) AS BIGINT) AS attributed_revenue_paise,
               CAST(CASE WHEN coalesce(dlv, 0) = 0 THEN 0 ELSE coalesce(rev, 0) // dlv END AS BIGINT) AS revenue_per_message_paise
        FROM (SELECT tenant_id, CAST(date_trunc('month', sent_at) AS DATE) AS month, channel, count(*) AS sends,
                     count(delivered_at) AS dlv, count(opened_at) AS opn, count(clicked_at) AS clk, count(bounced_at) AS bnc,
                     count(unsubscribed_at) AS uns FROM t_messages GROUP BY ALL) a
        FULL JOIN (SELECT tenant_id, month, channel, count(*) AS won, sum(total_paise) AS rev
                   FROM (SELECT DISTINCT v.tenant_id, v.order_id, v.month, m.channel, v.total_paise
                         FROM v_valid v JOIN t_messages m ON m.tenant_id = v.tenant_id AND m.customer_id = v.customer_id
                          AND m.clicked_at <= v.placed_at AND m.clicked_at + INTERVAL 7 DAY >= v.placed_at)
                   GROUP BY ALL) b
          ON b.tenant_id = a.tenant_id AND b.month = a.month AND b.channel = a.channel""",
    "v_moments": """
        SELECT * FROM (VALUES (0, 'welcome', 'KLF-01'), (1, 'post_purchase', 'KLF-02'), (2, 'winback', 'KLF-03'),
                              (3, 'replenishment', NULL), (4, 'cod_confirmation', NULL), (5, 'abandoned_checkout', NULL))
                      m(ordinal, moment, ext)""",
    "v_auto": """
        SELECT t.tenant_id, moment, r.campaign_id IS NOT NULL AS covered, r.campaign_id,
               coalesce(sends, 0) AS sends, coalesce(attributed_orders, 0) AS attributed_orders,
               coalesce(attributed_revenue_paise, 0) AS attributed_revenue_paise,
               CASE WHEN total = 0 THEN 0.0::DOUBLE ELSE coalesce(attributed_revenue_paise, 0) / total END AS automated_revenue_share
        FROM t_tenants t CROSS JOIN v_moments
        LEFT JOIN (SELECT v_roi.*, external_id FROM v_roi
                   JOIN t_campaigns c ON c.tenant_id = v_roi.tenant_id AND c.campaign_id = v_roi.campaign_id
                   WHERE c.campaign_type = 'flow') r ON r.tenant_id = t.tenant_id AND r.external_id = ext
        LEFT JOIN (SELECT tenant_id, CAST(sum(attributed_revenue_paise) AS BIGINT) AS total FROM v_roi GROUP BY ALL) s
          ON s.tenant_id = t.tenant_id""",
    "v_exp": """
        SELECT tenant_id, experiment_id, name, score_target, status, decision, started_at, concluded_at,
               CAST(date_trunc('month', started_at) AS DATE) AS started_month, sample_size, lift_pct, significant,
               CAST(date_diff('day', started_at, concluded_at) AS INTEGER) AS days_to_decision
        FROM t_experiments""",
}


def r6(df):
    """Doubles that were averaged or divided, at six decimals."""
    return df.select(*[F.round(c, 6).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def sql6(view: str, doubles: str) -> str:
    swaps = ", ".join(f"round({d}, 6) AS {d}" for d in doubles.split())
    return f"SELECT * REPLACE ({swaps}) FROM {view}"


def _stats_sql() -> str:
    return ("SELECT tenant_id, customer_id, orders_count, total_spent_paise, first_order_at, last_order_at, "
            "lifecycle_stage FROM t_stats")


VALID_COLS = ["tenant_id", "order_id", "customer_id", "placed_at", "total_paise", "subtotal_paise",
              "discount_paise", "cod", "financial_status", "oi"]

def _build_marts(t):
    """All marts stored, then read back: rows and total of a money or count column per tenant and mart."""
    out = None
    for name, df in store_marts(t, work_path(t.spark, "marts")).items():
        total = F.sum(CHECKSUM[name]).cast("long") if name in CHECKSUM else F.lit(0).cast("long")
        part = df.groupBy("tenant_id").agg(F.count(F.lit(1)).alias("rows"), total.alias("total"), F.lit(name).alias("mart"))
        out = part if out is None else out.unionByName(part)
    return out


CHECKSUM = {
    "rfm_current": "monetary_paise", "cohort_retention": "repeat_revenue_paise", "retention_facts": "cumulative_revenue_paise",
    "campaign_roi": "attributed_revenue_paise", "leak_facts": "amount_paise", "executive_kpis": "total_revenue_paise",
    "cx_facts": "tickets_opened", "messaging_facts": "attributed_revenue_paise", "automation_facts": "attributed_revenue_paise",
}
MART_VIEW = {
    "rfm_current": "v_rfm", "cohort_retention": "v_cohort", "retention_facts": "v_retention", "campaign_roi": "v_roi",
    "leak_facts": "v_leaks", "executive_kpis": "v_kpis", "cx_facts": "v_cx", "messaging_facts": "v_msg",
    "automation_facts": "v_auto", "experiment_facts": "v_exp",
}

QUERIES = {
    "build_marts": _build_marts,
    "valid_orders": lambda t: Marts(t).valid.select(*VALID_COLS),
    "order_index": lambda t: orders.order_index(t.order_headers).select(
        "tenant_id", "order_id", "customer_order_index"),
    "recompute_customer_stats": lambda t: orders.customer_stats(t.order_headers),
    "rfm_segment": lambda t: rfm_scored(t.order_headers).withColumn(
        "rfm_segment", rfm_segment(F.col("r_quintile"), F.col("f_quintile"))).groupBy(
        "tenant_id", "r_quintile", "f_quintile", "rfm_segment").agg(F.count(F.lit(1)).alias("customers")),
    "lifecycle_stage": lambda t: Marts(t).retention_facts.groupBy("tenant_id", "month", "lifecycle_stage").agg(
        F.count(F.lit(1)).alias("customers")),
    "last_click_attribution": lambda t: last_click(Marts(t).valid, t.fact_messages),
    "leak_rto_cod": lambda t: leaks.leak_rto_cod(t.order_headers, t.fact_shipments),
    "leak_failed_payments": lambda t: leaks.leak_failed_payments(t.fact_payments, t.order_headers),
    "leak_discount_abuse": lambda t: leaks.leak_discount_abuse(t.fact_orders),
    "leak_preventable_churn": lambda t: leaks.leak_preventable_churn(Marts(t).retention_facts),
    "nps_score": lambda t: r6(t.fact_nps.groupBy("tenant_id").agg(nps_score(F.col("score")).alias("nps"))),
    "retention_refund_fallback": lambda t: retention.retention_facts(
        t.order_headers, t.fact_shipments, t.fact_refunds.withColumn("customer_id", F.lit(None).cast("long")),
        refund_fallback=True),
    **{name: (lambda n: lambda t: r6(getattr(Marts(t), n)))(name) for name in MART_NAMES},
}

SQL = {
    "build_marts": " UNION ALL ".join(
        f"SELECT tenant_id, count(*) AS rows, CAST({f'sum({CHECKSUM[n]})' if n in CHECKSUM else '0'} AS BIGINT) AS total, "
        f"'{n}' AS mart FROM {v} GROUP BY tenant_id" for n, v in MART_VIEW.items()),
    "valid_orders": f"SELECT {', '.join(VALID_COLS)} FROM v_valid",
    "order_index": """
        SELECT h.tenant_id, h.order_id, CASE WHEN h.customer_id IS NULL THEN NULL ELSE oi END AS customer_order_index
        FROM t_heads h LEFT JOIN v_valid v ON v.tenant_id = h.tenant_id AND v.order_id = h.order_id""",
    "recompute_customer_stats": _stats_sql(),
    "rfm_segment": "SELECT tenant_id, r_quintile, f_quintile, rfm_segment, count(*) AS customers FROM v_rfm GROUP BY ALL",
    "lifecycle_stage": "SELECT tenant_id, month, lifecycle_stage, count(*) AS customers FROM v_retention GROUP BY ALL",
    "last_click_attribution": "SELECT * FROM v_click",
    "leak_rto_cod": "SELECT * FROM v_leak_rto",
    "leak_failed_payments": "SELECT * FROM v_leak_failed",
    "leak_discount_abuse": "SELECT * FROM v_leak_discount",
    "leak_preventable_churn": "SELECT * FROM v_leak_churn",
    "nps_score": """SELECT tenant_id, round(100.0 * (count(*) FILTER (score > 8) - count(*) FILTER (score < 7)) / count(*), 6) AS nps
        FROM t_nps GROUP BY ALL""",
    "retention_refund_fallback": "SELECT * FROM v_retention",
    "rfm_current": "SELECT * FROM v_rfm",
    "cohort_retention": sql6("v_cohort", "retention_rate avg_orders_per_active"),
    "retention_facts": "SELECT * FROM v_retention",
    "campaign_roi": "SELECT * FROM v_roi",
    "leak_facts": sql6("v_leaks", "revenue_share"),
    "executive_kpis": sql6("v_kpis", "repeat_rate"),
    "cx_facts": sql6("v_cx", "median_delivery_days rto_rate ticket_rate median_resolution_hours breach_rate "
                     "avg_csat avg_review_rating nps"),
    "messaging_facts": sql6("v_msg", "bounce_rate"),
    "automation_facts": sql6("v_auto", "automated_revenue_share"),
    "experiment_facts": "SELECT * FROM v_exp",
}
