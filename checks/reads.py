"""Queries and SQL of the typed reads."""

from pyspark.sql import functions as F

from checks.marts import r6
from patronage.functions import score_band
from patronage.plans import reads
from patronage.plans.marts import Marts

VIEWS = {
    "v_top": "SELECT tenant_id, max(placed_at) AS as_of, max(month) AS top FROM v_valid GROUP BY ALL",
    "v_last_runs": """
        SELECT tenant_id, score, value, computed_at, definition_version
        FROM (SELECT *, row_number() OVER (PARTITION BY tenant_id, score ORDER BY computed_at DESC, run_id DESC) AS rn FROM t_runs)
        WHERE rn = 1""",
    "v_kpi12": """
        SELECT k.* FROM v_kpis k JOIN v_top t ON t.tenant_id = k.tenant_id AND date_diff('month', k.month, top) < 12""",
    "v_leak12": """
        SELECT k.* FROM v_leaks k JOIN v_top t ON t.tenant_id = k.tenant_id AND date_diff('month', k.month, top) < 12""",
    "v_cadence": """
        SELECT tenant_id, started_month AS month, count(*) AS experiments FROM v_exp
        WHERE status <> 'draft' AND started_month IS NOT NULL GROUP BY ALL""",
    "v_newpred": """
        SELECT * FROM t_predictions p WHERE scored_at = (SELECT max(scored_at) FROM t_predictions q WHERE q.tenant_id = p.tenant_id)""",
}

SCORES = ["gravity", "flow", "signal", "watertight", "vitals", "velocity", "autopilot", "pulse", "altitude"]

QUERIES = {
    "overview_kpis": lambda t: (lambda m: r6(reads.overview_kpis(
        m.base("executive_kpis"), m.rfm_current, m.leak_facts, m.orders, t.score_runs, t.tenants)))(Marts(t)),
    "cohort_matrix": lambda t: r6(reads.cohort_matrix(Marts(t).cohort_retention).select(
        "tenant_id", "cohort_month", "cohort_size", F.size("cells").alias("cells"),
        F.posexplode("cells").alias("place", "cell")).select(
        "tenant_id", "cohort_month", "cohort_size", "cells", "place", "cell.*")),
    "cohort_heatmap": lambda t: r6(reads.cohort_heatmap(Marts(t).cohort_retention)),
    "cohort_heatmap_revenue": lambda t: r6(reads.cohort_heatmap(Marts(t).cohort_retention, "revenue")),
    "rfm_segments": lambda t: reads.rfm_segments(Marts(t).rfm_current),
    "rfm_grid": lambda t: reads.rfm_grid(Marts(t).rfm_current),
    "revenue_monthly": lambda t: r6(reads.revenue_monthly(Marts(t).executive_kpis)),
    "revenue_totals": lambda t: reads.revenue_totals(Marts(t).executive_kpis),
    "campaign_roi_read": lambda t: reads.campaign_roi_read(Marts(t).campaign_roi),
    "leaks_summary": lambda t: (lambda m: r6(reads.leaks_summary(m.leak_facts, m.executive_kpis, m.orders)))(Marts(t)),
    "leaks_monthly": lambda t: (lambda m: reads.leaks_monthly(m.leak_facts, m.orders))(Marts(t)),
    "cohort_pivot": lambda t: r6(reads.cohort_pivot(Marts(t).cohort_retention, 3)),
    "customers_after": lambda t: (lambda m: reads.customers_after(m.rfm_current, m.dim_customers, AFTER[0], AFTER[1]))(Marts(t)),
    "customers_page": lambda t: (lambda m: reads.customers_page(m.rfm_current, m.dim_customers, page=2))(Marts(t)),
    "customers_page_segment": lambda t: (lambda m: reads.customers_page(
        m.rfm_current, m.dim_customers, segment="champions", page_size=500))(Marts(t)),
    "customer_detail": lambda t: r6(reads.customer_detail(t, Marts(t).rfm_current)),
    "customer_timeline": lambda t: reads.customer_timeline(t.order_headers, t.fact_tickets, t.fact_reviews, t.fact_nps),
    "scores_latest": lambda t: reads.scores_latest(t.score_runs, t.tenants),
    "score_history": lambda t: reads.score_history(t.score_runs, "gravity"),
    "score_band": lambda t: t.score_runs.groupBy("tenant_id", "score", score_band(F.col("value")).alias("band")).agg(
        F.count(F.lit(1)).alias("runs")),
    "scores_by_stage": lambda t: reads.scores_by_stage(t.score_runs),
    "cx_summary": lambda t: r6(reads.cx_summary(Marts(t).cx_facts)),
    "latest_cx_month": lambda t: r6(reads.latest_cx_month(Marts(t).cx_facts)),
    "messaging_summary": lambda t: r6(reads.messaging_summary(Marts(t).messaging_facts)),
    "channel_rollup": lambda t: reads.channel_rollup(Marts(t).messaging_facts),
    "automation_summary": lambda t: r6(reads.automation_summary(Marts(t).automation_facts)),
    "experiments_list": lambda t: reads.experiments_list(t.experiments),
    "experiment_cadence": lambda t: reads.experiment_cadence(Marts(t).experiment_facts),
    "cadence_gap_fill": lambda t: reads.cadence_gap_fill(reads.experiment_cadence(Marts(t).experiment_facts)),
    "experiment_outcomes": lambda t: reads.experiment_outcomes(t.experiments),
    "predictions_summary": lambda t: r6(reads.predictions_summary(t.predictions)),
    "predictions_top_risk": lambda t: r6(reads.predictions_top_risk(
        t.predictions, t.dim_customers, Marts(t).rfm_current, page_size=20)),
    "customer_prediction": lambda t: reads.customer_prediction(t.predictions),
    "tenants_list": lambda t: reads.tenants_list(t.tenants),
    "tenant_lookup": lambda t: reads.tenant_lookup(t.tenants, "2").unionByName(reads.tenant_lookup(t.tenants, "asia")).unionByName(
        reads.tenant_lookup(t.tenants, "nowhere")),
}

CX6 = ("round(median_delivery_days, 6) AS median_delivery_days, round(rto_rate, 6) AS rto_rate, "
       "round(ticket_rate, 6) AS ticket_rate, round(median_resolution_hours, 6) AS median_resolution_hours, "
       "round(breach_rate, 6) AS breach_rate, round(avg_csat, 6) AS avg_csat, "
       "round(avg_review_rating, 6) AS avg_review_rating, round(nps, 6) AS nps")
HEAT = """
    SELECT g.tenant_id, g.cohort_month, cohort_size, CAST(g.m AS INTEGER) AS months_since, round(value, 6) AS value,
           CASE WHEN value IS NOT NULL THEN round(least(1.0, value / greatest(1e-9, coalesce(peak, 0))), 6) END AS intensity
    FROM (SELECT tenant_id, cohort_month, any_value(cohort_size) AS cohort_size,
                 unnest(range(0, (SELECT max(months_since) + 1 FROM v_cohort x WHERE x.tenant_id = c.tenant_id))) AS m
          FROM v_cohort c GROUP BY tenant_id, cohort_month) g
    LEFT JOIN (SELECT tenant_id, cohort_month, months_since, CAST({v} AS DOUBLE) AS value FROM v_cohort) v
      ON v.tenant_id = g.tenant_id AND v.cohort_month = g.cohort_month AND v.months_since = g.m
    LEFT JOIN (SELECT tenant_id, CAST(max({v}) AS DOUBLE) AS peak FROM v_cohort WHERE months_since > 0 GROUP BY ALL) p
      ON p.tenant_id = g.tenant_id"""
AFTER = ("1998-03-01 00:00:00", 40)
PAGE = """
    SELECT * EXCLUDE (place) FROM (
      SELECT r.tenant_id, r.customer_id, r.rfm_segment, recency_days, d.lifecycle_stage, orders_count, total_spent_paise,
             first_order_at, last_order_at, d.whatsapp_opted_in, count(*) OVER (PARTITION BY r.tenant_id) AS total,
             row_number() OVER (PARTITION BY r.tenant_id ORDER BY last_order_at DESC NULLS LAST, r.customer_id) AS place
      FROM v_rfm r JOIN t_dim_customers d ON d.tenant_id = r.tenant_id AND d.customer_id = r.customer_id WHERE {where})
    WHERE place BETWEEN {lo} AND {hi}"""

SQL = {
    "overview_kpis": f"""
        SELECT t.tenant_id, as_of, CAST(12 AS INTEGER) AS window_months, coalesce(rev, 0) AS total_revenue_paise,
               coalesce(rep, 0) AS repeat_revenue_paise, round(coalesce(rep / nullif(rev, 0), 0), 6) AS repeat_rate,
               coalesce(n, 0) AS orders, coalesce(people, 0) AS customers, coalesce(fresh, 0) AS new_customers_last_month,
               coalesce(rev // nullif(n, 0), 0) AS aov_paise, coalesce(leak, 0) AS leak_total_paise,
               {', '.join(f"(SELECT value FROM v_last_runs r WHERE r.tenant_id = t.tenant_id AND score = '{s}') AS score_{s}" for s in SCORES)},
               CAST(NULL AS DOUBLE) AS score_composite
        FROM t_tenants t LEFT JOIN v_top c ON c.tenant_id = t.tenant_id
        LEFT JOIN (SELECT tenant_id, CAST(sum(total_revenue_paise) AS BIGINT) AS rev, CAST(sum(repeat_revenue_paise) AS BIGINT) AS rep,
                          CAST(sum(orders) AS BIGINT) AS n, arg_max(new_customers, month) AS fresh FROM v_kpi12 GROUP BY ALL) k
          ON k.tenant_id = t.tenant_id
        LEFT JOIN (SELECT tenant_id, count(*) AS people FROM v_rfm GROUP BY ALL) p ON p.tenant_id = t.tenant_id
        LEFT JOIN (SELECT tenant_id, CAST(sum(amount_paise) AS BIGINT) AS leak FROM v_leak12 GROUP BY ALL) l ON l.tenant_id = t.tenant_id""",
    "cohort_matrix": """
        SELECT tenant_id, cohort_month, cohort_size, CAST(count(*) OVER (PARTITION BY tenant_id, cohort_month) AS INTEGER) AS cells,
               CAST(row_number() OVER (PARTITION BY tenant_id, cohort_month ORDER BY months_since) - 1 AS INTEGER) AS place,
               months_since, active_customers, round(retention_rate, 6) AS retention_rate, repeat_revenue_paise FROM v_cohort""",
    "cohort_heatmap": HEAT.format(v="retention_rate"),
    "cohort_heatmap_revenue": HEAT.format(v="repeat_revenue_paise"),
    "rfm_segments": """
        SELECT tenant_id, rfm_segment AS segment, max(as_of) AS as_of, count(*) AS customers,
               CAST(sum(monetary_paise) AS BIGINT) AS revenue_paise, CAST(round(avg(recency_days)) AS BIGINT) AS avg_recency_days,
               round(avg(frequency), 1) AS avg_frequency, CAST(avg(monetary_paise) AS BIGINT) AS avg_monetary_paise
        FROM v_rfm GROUP BY ALL""",
    "rfm_grid": """
        SELECT tenant_id, r_quintile, f_quintile, count(*) AS customers, CAST(sum(monetary_paise) AS BIGINT) AS revenue_paise
        FROM v_rfm GROUP BY ALL""",
    "revenue_monthly": """
        SELECT tenant_id, month, total_revenue_paise AS revenue_paise, repeat_revenue_paise, orders, new_customers,
               returning_customers, round(repeat_rate, 6) AS repeat_rate, aov_paise FROM v_kpis""",
    "revenue_totals": """
        SELECT tenant_id, CAST(sum(total_paise) AS BIGINT) AS revenue_paise,
               CAST(sum(total_paise) FILTER (oi > 1) AS BIGINT) AS repeat_revenue_paise FROM v_valid GROUP BY ALL""",
    "campaign_roi_read": "SELECT * FROM v_roi",
    "leaks_summary": """
        SELECT l.tenant_id, leak_type, amt AS amount_paise, n AS orders_affected, round(amt / rev, 6) AS revenue_share,
               CAST(12 AS INTEGER) AS window_months, CAST(sum(amt) OVER w AS BIGINT) AS total_paise,
               CAST(sum(amt) OVER w AS BIGINT) AS annualized_paise, round(CAST(sum(amt) OVER w AS BIGINT) / rev, 6) AS total_revenue_share
        FROM (SELECT tenant_id, leak_type, CAST(sum(amount_paise) AS BIGINT) AS amt, CAST(sum(orders_affected) AS BIGINT) AS n
              FROM v_leak12 GROUP BY ALL) l
        JOIN (SELECT tenant_id, CAST(sum(total_revenue_paise) AS BIGINT) AS rev FROM v_kpi12 GROUP BY ALL) k ON k.tenant_id = l.tenant_id
        WINDOW w AS (PARTITION BY l.tenant_id)""",
    "leaks_monthly": "SELECT tenant_id, month, leak_type, amount_paise FROM v_leak12",
    "customers_page": PAGE.format(where="true", lo=51, hi=100),
    "customers_page_segment": PAGE.format(where="r.rfm_segment = 'champions'", lo=1, hi=200),
    "customer_detail": """
        SELECT d.tenant_id, d.customer_id, nullif(concat_ws(' ', first_name, last_name), '') AS name,
               primary_email AS email, primary_phone AS phone, d.lifecycle_stage, rfm_segment, orders_count, total_spent_paise,
               first_order_at, last_order_at, accepts_email_marketing AS consent_email, d.whatsapp_opted_in AS consent_whatsapp,
               sms_opted_in AS consent_sms, round(p_alive, 6) AS p_alive, round(expected_orders_90d, 6) AS expected_orders_90d,
               ltv_12m_paise, churn_band, model_version, scored_at
        FROM t_dim_customers d JOIN t_pii i ON i.customer_id = d.customer_id
        LEFT JOIN v_rfm r ON r.customer_id = d.customer_id LEFT JOIN v_newpred p ON p.customer_id = d.customer_id""",
    "customer_timeline": """
        SELECT tenant_id, customer_id, 'order' AS kind, placed_at AS "at", order_id AS ref_id, financial_status AS label,
               total_paise AS number FROM t_heads WHERE customer_id IS NOT NULL
        UNION ALL SELECT tenant_id, customer_id, 'ticket', opened_at, ticket_id, category, CAST(csat AS BIGINT) FROM t_tickets WHERE customer_id IS NOT NULL
        UNION ALL SELECT tenant_id, customer_id, 'review', submitted_at, review_id, NULL, CAST(rating AS BIGINT) FROM t_reviews WHERE customer_id IS NOT NULL
        UNION ALL SELECT tenant_id, customer_id, 'nps', responded_at, nps_id, NULL, CAST(score AS BIGINT) FROM t_nps WHERE customer_id IS NOT NULL""",
    "scores_latest": """
        SELECT t.tenant_id, s.score, value, CASE WHEN r.score IS NOT NULL THEN 'computed'
                 WHEN s.i > 4 AND s.i < 10 THEN 'phase_2' ELSE 'pending' END AS status,
               (SELECT max(x.computed_at) FROM t_runs x WHERE x.tenant_id = t.tenant_id) AS computed_at,
               (SELECT definition_version FROM v_last_runs y WHERE y.tenant_id = t.tenant_id AND y.score = 'gravity') AS definition_version
        FROM t_tenants t CROSS JOIN (VALUES (1, 'gravity'), (2, 'flow'), (3, 'signal'), (4, 'watertight'), (5, 'vitals'), (6, 'velocity'),
                                            (7, 'autopilot'), (8, 'pulse'), (9, 'altitude'), (10, 'composite')) s(i, score)
        LEFT JOIN v_last_runs r ON r.tenant_id = t.tenant_id AND r.score = s.score""",
    "score_history": "SELECT tenant_id, computed_at, run_id, value, definition_version FROM t_runs WHERE score = 'gravity'",
    "score_band": """
        SELECT tenant_id, score, CASE WHEN value >= 70 THEN 'compounding' WHEN value >= 40 THEN 'building' ELSE 'leaking' END AS band,
               count(*) AS runs FROM t_runs GROUP BY ALL""",
    "scores_by_stage": """
        SELECT tenant_id, stage, l.score, value, CASE WHEN value >= 70 THEN 'compounding' WHEN value >= 40 THEN 'building' ELSE 'leaking' END AS band
        FROM v_last_runs l JOIN (VALUES ('signal', 'Decode'), ('altitude', 'Decode'), ('vitals', 'Design'), ('autopilot', 'Design'),
          ('velocity', 'Drive'), ('flow', 'Drive'), ('gravity', 'Compound'), ('watertight', 'Compound'), ('pulse', 'Compound')) s(score, stage)
          ON s.score = l.score""",
    "cx_summary": f"SELECT * REPLACE ({CX6}) FROM v_cx",
    "latest_cx_month": f"""SELECT * REPLACE ({CX6}) FROM v_cx c
        WHERE month = (SELECT max(month) FROM v_cx x WHERE x.tenant_id = c.tenant_id)""",
    "messaging_summary": """
        SELECT tenant_id, CAST(sum(sends) AS BIGINT) AS sends, round(sum(opened_or_read) / sum(delivered), 6) AS read_rate,
               round(sum(clicked) / sum(delivered), 6) AS reply_rate, CAST(sum(attributed_revenue_paise) AS BIGINT) AS attributed_revenue_paise,
               CAST(sum(attributed_revenue_paise) // sum(delivered) AS BIGINT) AS revenue_per_conversation_paise
        FROM v_msg m WHERE channel = 'whatsapp'
          AND date_diff('month', month, (SELECT max(month) FROM v_msg x WHERE x.tenant_id = m.tenant_id)) < 12 GROUP BY ALL""",
    "channel_rollup": """
        SELECT tenant_id, channel, CAST(sum(sends) AS BIGINT) AS sends, CAST(sum(delivered) AS BIGINT) AS delivered,
               CAST(sum(opened_or_read) AS BIGINT) AS opened_or_read, CAST(sum(clicked) AS BIGINT) AS clicked,
               CAST(sum(bounced) AS BIGINT) AS bounced, CAST(sum(attributed_orders) AS BIGINT) AS attributed_orders,
               CAST(sum(attributed_revenue_paise) AS BIGINT) AS attributed_revenue_paise FROM v_msg GROUP BY ALL""",
    "automation_summary": """
        SELECT a.* REPLACE (round(automated_revenue_share, 6) AS automated_revenue_share), ordinal
        FROM v_auto a JOIN v_moments m ON m.moment = a.moment""",
    "experiments_list": """
        SELECT tenant_id, experiment_id, name, hypothesis, score_target, status, started_at, concluded_at, sample_size, lift_pct,
               significant, decision FROM t_experiments""",
    "experiment_cadence": "SELECT * FROM v_cadence",
    "cadence_gap_fill": """
        SELECT s.tenant_id, s.month, coalesce(experiments, 0) AS experiments
        FROM (SELECT tenant_id, CAST(unnest(generate_series(CAST(min(month) AS TIMESTAMP), CAST(max(month) AS TIMESTAMP), INTERVAL 1 MONTH)) AS DATE) AS month
              FROM v_cadence GROUP BY tenant_id) s
        LEFT JOIN v_cadence c ON c.tenant_id = s.tenant_id AND c.month = s.month""",
    "experiment_outcomes": """
        SELECT tenant_id, count(*) FILTER (status = 'draft') AS draft, count(*) FILTER (status = 'running') AS running,
               count(*) FILTER (status = 'concluded') AS concluded, count(*) FILTER (status = 'concluded' AND decision = 'shipped') AS shipped,
               count(*) FILTER (status = 'concluded' AND decision = 'killed') AS killed FROM t_experiments GROUP BY ALL""",
    "predictions_summary": f"""
        SELECT tenant_id, model_version, max(scored_at) AS scored_at, count(*) AS customers_scored,
               count(*) FILTER (churn_band = 'high') AS band_high, count(*) FILTER (churn_band = 'medium') AS band_medium,
               count(*) FILTER (churn_band = 'low') AS band_low, round(sum(expected_orders_90d), 6) AS expected_orders_90d_total,
               CAST(coalesce(sum(ltv_12m_paise) FILTER (churn_band = 'high'), 0) AS BIGINT) AS at_risk_ltv_paise,
               {', '.join(f"(list_sort(list(ltv_12m_paise)))[({i} * count(*)) // 10 + 1] AS ltv_decile_{i}" for i in range(10))}
        FROM v_newpred GROUP BY tenant_id, model_version""",
    "predictions_top_risk": """
        SELECT * EXCLUDE (place) REPLACE (round(p_alive, 6) AS p_alive, round(expected_orders_90d, 6) AS expected_orders_90d)
        FROM (SELECT p.tenant_id, p.customer_id, p_alive, expected_orders_90d, ltv_12m_paise, churn_band, d.lifecycle_stage,
                     d.orders_count, d.total_spent_paise, rfm_segment, count(*) OVER (PARTITION BY p.tenant_id) AS total,
                     row_number() OVER (PARTITION BY p.tenant_id ORDER BY ltv_12m_paise DESC, p.customer_id) AS place
              FROM v_newpred p LEFT JOIN t_dim_customers d ON d.customer_id = p.customer_id
              LEFT JOIN v_rfm r ON r.customer_id = p.customer_id WHERE churn_band = 'high') WHERE place <= 20""",
    "customer_prediction": """
        SELECT tenant_id, customer_id, scored_at, p_alive, expected_orders_90d, ltv_12m_paise, churn_band, model_version FROM v_newpred""",
    "tenants_list": "SELECT * FROM t_tenants",
    "tenant_lookup": "SELECT * FROM t_tenants WHERE tenant_id = 2 OR slug = 'asia'",
    "cohort_pivot": f"SELECT tenant_id, cohort_month, cohort_size, {', '.join(f'max(value) FILTER (months_since = {m}) AS \"{m}\"' for m in range(4))} "
                    f"FROM ({HEAT.format(v='retention_rate')}) GROUP BY tenant_id, cohort_month, cohort_size",
    "customers_after": f"""
        SELECT * EXCLUDE (place) FROM (
          SELECT r.tenant_id, r.customer_id, r.rfm_segment, recency_days, d.lifecycle_stage, orders_count, total_spent_paise,
                 first_order_at, last_order_at, d.whatsapp_opted_in, total,
                 row_number() OVER (PARTITION BY r.tenant_id ORDER BY last_order_at DESC NULLS LAST, r.customer_id) AS place
          FROM v_rfm r JOIN t_dim_customers d ON d.tenant_id = r.tenant_id AND d.customer_id = r.customer_id
          JOIN (SELECT tenant_id, count(*) AS total FROM v_rfm GROUP BY ALL) n ON n.tenant_id = r.tenant_id
          WHERE last_order_at < TIMESTAMP '{AFTER[0]}' OR (last_order_at = TIMESTAMP '{AFTER[0]}' AND r.customer_id > {AFTER[1]}) OR last_order_at IS NULL)
        WHERE place <= 50""",
}
