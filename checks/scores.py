"""Queries and SQL of the score inputs, the nine scores and the composite."""

from datetime import datetime

from pyspark.sql import functions as F

from checks.marts import r6
from patronage.functions import linear
from patronage.plans import score_inputs as si
from patronage.plans import scores
from patronage.plans.marts import Marts

RUN_AT = datetime(2001, 8, 12, 4, 0, 0)


def _inputs(t, reuse=False):
    return si.ScoreInputs(t, Marts(t, reuse=reuse), RUN_AT)


def _tenants(t):
    """The tenants, and one that has no orders."""
    return t.tenants.select("tenant_id").unionByName(t.tenants.selectExpr("max(tenant_id) + 94 as tenant_id"))


def _score(name, *inputs):
    def build(t):
        have = _inputs(t)
        df = getattr(have, name)
        if name == "altitude":
            df = df.join(scores.scored(have.signal, "signal").select("tenant_id", "signal"), "tenant_id", "left")
        parts = [f"{name}_{p.name}" for p in scores.parts_of(name)]
        return scores.scored(df, name).select("tenant_id", name, *parts)

    return build


def lin(x, worst, best):
    return f"greatest(0.0, least(100.0, (({x}) - ({worst}::DOUBLE)) / ({best}::DOUBLE - ({worst}::DOUBLE)) * 100.0))"


def score_sql(name, source, parts, extra=""):
    """parts: component -> (weight, sub-score SQL)."""
    total = " + ".join(f"{c} * {w}" for c, (w, _) in parts.items())
    outs = ", ".join(f"round_even({c}, 1) AS {name}_{c}" for c in parts)
    subs = ", ".join(f"CAST({sub} AS DOUBLE) AS {c}" for c, (_, sub) in parts.items())
    return (f"SELECT tenant_id, round_even(({total}) / 100.0, 1) AS {name}, {outs} "
            f"FROM (SELECT tenant_id, {subs} FROM {source})")


def nz(x):
    return f"coalesce({x}, 0)"


VIEWS = {
    "v_pair": """
        SELECT v.tenant_id, customer_id, min(placed_at) AS first_at, min(placed_at) FILTER (oi = 2) AS second_at
        FROM v_valid v WHERE customer_id IS NOT NULL GROUP BY ALL""",
    "v_kpi_year": """
        SELECT k.* FROM v_kpis k WHERE date_diff('month', month, (SELECT max(month) FROM v_kpis x WHERE x.tenant_id = k.tenant_id)) <= 11""",
    "v_in_gravity": """
        SELECT c.tenant_id,
               (SELECT avg(CASE WHEN second_at <= first_at + INTERVAL 90 DAY THEN 1 ELSE 0 END) FROM v_pair p
                WHERE p.tenant_id = c.tenant_id AND first_at <= as_of - INTERVAL 90 DAY) AS repeat_rate_90d,
               (SELECT median(date_diff('day', first_at, second_at)) FROM v_pair p WHERE p.tenant_id = c.tenant_id AND second_at IS NOT NULL)
                 AS median_repurchase_days,
               (SELECT avg(retention_rate) FROM v_cohort h WHERE h.tenant_id = c.tenant_id AND months_since = 3) AS avg_m3_retention,
               (SELECT CAST(sum(repeat_revenue_paise) AS BIGINT) / CAST(sum(total_revenue_paise) AS BIGINT) FROM v_kpi_year k WHERE k.tenant_id = c.tenant_id)
                 AS repeat_revenue_share
        FROM t_clock c""",
    "v_ends": """
        SELECT a.tenant_id, a.customer_id, a.lifecycle_stage AS then_, b.lifecycle_stage AS now_
        FROM (SELECT tenant_id, max(month) AS top FROM v_retention GROUP BY ALL) t
        JOIN v_retention a ON a.tenant_id = t.tenant_id AND a.month = t.top - INTERVAL 3 MONTH
        JOIN v_retention b ON b.tenant_id = t.tenant_id AND b.month = t.top AND b.customer_id = a.customer_id""",
    "v_in_flow": """
        SELECT c.tenant_id,
               (SELECT avg(CAST(lifecycle_stage IN ('active', 'loyal') AS INTEGER)) FROM t_dim_customers d
                WHERE d.tenant_id = c.tenant_id AND orders_count > 0) AS healthy_stage_share,
               (SELECT avg(CAST(orders_count > 1 AS INTEGER)) FROM t_dim_customers d WHERE d.tenant_id = c.tenant_id
                AND first_order_at >= as_of - INTERVAL 180 DAY AND first_order_at <= as_of - INTERVAL 90 DAY) AS new_to_active_rate,
               (SELECT avg(CAST(now_ IN ('dormant', 'lost') AS INTEGER)) FROM v_ends e WHERE e.tenant_id = c.tenant_id AND then_ = 'slipping')
                 AS slipping_to_dormant_rate,
               (SELECT avg(CAST(now_ IN ('new', 'active', 'loyal') AS INTEGER)) FROM v_ends e WHERE e.tenant_id = c.tenant_id AND then_ = 'dormant')
                 AS reactivation_rate
        FROM t_clock c""",
    "v_in_signal": """
        SELECT c.tenant_id,
               (SELECT count(customer_id) / count(*) FROM t_heads h WHERE h.tenant_id = c.tenant_id) AS identity_resolution_rate,
               (SELECT count(*) FILTER (clean_phone IS NOT NULL AND clean_email IS NOT NULL) / count(*) FROM t_pii p
                WHERE p.tenant_id = c.tenant_id) AS field_completeness,
               (SELECT avg(CAST(order_id IN (SELECT order_id FROM t_payments WHERE status = 'captured') AS INTEGER)) FROM t_heads h
                WHERE h.tenant_id = c.tenant_id AND NOT cod AND financial_status <> 'pending') AS payment_match_rate,
               (SELECT CAST(date_diff('month', min(placed_at), max(placed_at)) + 1 AS DOUBLE) FROM t_heads h WHERE h.tenant_id = c.tenant_id)
                 AS history_months
        FROM t_clock c""",
    "v_in_watertight": """
        SELECT c.tenant_id, CAST((SELECT sum(total_revenue_paise) FROM v_kpi_year k WHERE k.tenant_id = c.tenant_id) AS BIGINT) AS gross_revenue_paise,
               CAST(coalesce(sum(amount_paise) FILTER (leak_type = 'preventable_churn'), 0) AS BIGINT) AS leak_preventable_churn_paise,
               CAST(coalesce(sum(amount_paise) FILTER (leak_type = 'rto_cod'), 0) AS BIGINT) AS leak_rto_cod_paise,
               CAST(coalesce(sum(amount_paise) FILTER (leak_type = 'failed_payments'), 0) AS BIGINT) AS leak_failed_payments_paise,
               CAST(coalesce(sum(amount_paise) FILTER (leak_type = 'discount_abuse'), 0) AS BIGINT) AS leak_discount_abuse_paise
        FROM t_clock c LEFT JOIN v_leaks l ON l.tenant_id = c.tenant_id
         AND month >= (SELECT max(month) FROM v_kpis k WHERE k.tenant_id = c.tenant_id) - INTERVAL 11 MONTH
        GROUP BY c.tenant_id""",
    "v_backed": """
        SELECT tenant_id, avg(CAST(coalesce(action, '') = 'granted' AS INTEGER)) AS consent_backed_share
        FROM (SELECT d.tenant_id, (SELECT arg_max(action, {'a': occurred_at, 'b': consent_id}) FROM t_consent f
                                   WHERE f.tenant_id = d.tenant_id AND f.customer_id = d.customer_id AND f.channel = d.ch) AS action
              FROM (SELECT tenant_id, customer_id, unnest(list_filter([CASE WHEN accepts_email_marketing THEN 'email' END,
                      CASE WHEN whatsapp_opted_in THEN 'whatsapp' END, CASE WHEN sms_opted_in THEN 'sms' END], lambda x: x IS NOT NULL)) AS ch
                    FROM t_dim_customers) d)
        GROUP BY ALL""",
    "v_revoked": """
        SELECT tenant_id, count(*) AS sends_after_revoke
        FROM (SELECT m.tenant_id, m.message_id, arg_max(action, {'a': occurred_at, 'b': consent_id}) AS said
              FROM t_messages m JOIN t_consent c ON c.customer_id = m.customer_id AND c.channel = m.channel AND c.occurred_at <= m.sent_at
              GROUP BY ALL)
        WHERE said = 'revoked' GROUP BY ALL""",
    "v_flows": """
        SELECT c.tenant_id, count(*) AS flows_total,
               count(*) FILTER ((SELECT max(sent_at) FROM t_messages m WHERE m.campaign_id = c.campaign_id) >=
                                (SELECT max(sent_at) FROM t_messages m WHERE m.tenant_id = c.tenant_id) - INTERVAL 60 DAY) AS flows_active_60d
        FROM t_campaigns c WHERE campaign_type = 'flow' GROUP BY c.tenant_id""",
    "v_in_vitals": """
        SELECT t.tenant_id, email_bounce_rate, email_unsub_rate, whatsapp_fail_rate,
               (SELECT avg(CAST(whatsapp_opted_in AS INTEGER)) FROM t_dim_customers d WHERE d.tenant_id = t.tenant_id) AS whatsapp_optin_share,
               (SELECT consent_backed_share FROM v_backed b WHERE b.tenant_id = t.tenant_id) AS consent_backed_share,
               coalesce((SELECT sends_after_revoke FROM v_revoked b WHERE b.tenant_id = t.tenant_id), 0) AS sends_after_revoke,
               (SELECT count(*) FROM t_messages m WHERE m.tenant_id = t.tenant_id) AS total_sends, flows_total, flows_active_60d
        FROM t_tenants t JOIN v_flows f ON f.tenant_id = t.tenant_id
        LEFT JOIN (SELECT tenant_id,
                 CAST(sum(bounced) FILTER (channel = 'email') AS BIGINT) / CAST(sum(sends) FILTER (channel = 'email') AS BIGINT) AS email_bounce_rate,
                 CAST(sum(unsubscribed) FILTER (channel = 'email') AS BIGINT) / CAST(sum(sends) FILTER (channel = 'email') AS BIGINT) AS email_unsub_rate,
                 CAST(sum(bounced) FILTER (channel = 'whatsapp') AS BIGINT) / CAST(sum(sends) FILTER (channel = 'whatsapp') AS BIGINT) AS whatsapp_fail_rate
              FROM v_msg m WHERE date_diff('month', month, (SELECT max(month) FROM v_msg x WHERE x.tenant_id = m.tenant_id)) < 6
              GROUP BY tenant_id) r ON r.tenant_id = t.tenant_id""",
    "v_in_velocity": """
        SELECT tenant_id, count(*) FILTER (status <> 'draft' AND date_diff('month', started_month, top) < 6) AS starts_6mo,
               count(*) FILTER (status = 'concluded') AS concluded,
               count(*) FILTER (status = 'concluded' AND significant IS NOT NULL AND sample_size >= 1000) AS concluded_valid,
               count(*) FILTER (status = 'concluded' AND decision IN ('shipped', 'killed')) AS concluded_decided
        FROM (SELECT *, max(started_month) OVER (PARTITION BY tenant_id) AS top FROM v_exp) GROUP BY ALL""",
    "v_in_autopilot": """
        SELECT a.tenant_id, count(*) AS moments_total, count(*) FILTER (covered) AS moments_covered,
               sum(CASE WHEN covered THEN automated_revenue_share ELSE 0 END) AS automated_revenue_share,
               list_sort(list(moment) FILTER (covered)) AS covered_moments,
               (SELECT CAST(sum(attributed_revenue_paise) // nullif(sum(sends), 0) AS BIGINT) FROM v_roi r WHERE r.tenant_id = a.tenant_id AND campaign_type = 'flow')
                 AS flow_revenue_per_send_paise,
               (SELECT CAST(sum(attributed_revenue_paise) // nullif(sum(sends), 0) AS BIGINT) FROM v_roi r WHERE r.tenant_id = a.tenant_id AND campaign_type = 'campaign')
                 AS campaign_revenue_per_send_paise
        FROM v_auto a GROUP BY a.tenant_id""",
    "v_in_pulse": """
        SELECT tenant_id, median(median_delivery_days) FILTER (ago < 6) AS median_delivery_days,
               CAST(sum(rto_orders) FILTER (ago < 6) AS BIGINT) / CAST(sum(rto_orders + orders_delivered) FILTER (ago < 6) AS BIGINT) AS rto_rate,
               avg(median_resolution_hours) FILTER (ago < 6) AS median_resolution_hours, avg(breach_rate) FILTER (ago < 6) AS breach_rate,
               avg(avg_csat) FILTER (ago < 6) AS avg_csat,
               sum(avg_review_rating * reviews) FILTER (ago < 6) / nullif(sum(reviews) FILTER (ago < 6), 0) AS avg_review_rating,
               sum(nps * nps_responses) FILTER (ago < 6) / nullif(sum(nps_responses) FILTER (ago < 6), 0) AS nps,
               sum(avg_review_rating * reviews) FILTER (ago BETWEEN 6 AND 11) / nullif(sum(reviews) FILTER (ago BETWEEN 6 AND 11), 0)
                 AS avg_review_rating_prev_6mo
        FROM (SELECT *, date_diff('month', month, max(month) OVER (PARTITION BY tenant_id)) AS ago FROM v_cx) GROUP BY ALL""",
    "v_streak": """
        SELECT tenant_id, count(*) AS monthly_run_streak
        FROM (SELECT tenant_id, ym + row_number() OVER (PARTITION BY tenant_id ORDER BY ym DESC) AS island,
                     max(ym) OVER (PARTITION BY tenant_id) + 1 AS head
              FROM (SELECT DISTINCT tenant_id, year(computed_at) * 12 + month(computed_at) AS ym FROM t_runs))
        WHERE island = head GROUP BY ALL""",
    "v_in_altitude": """
        SELECT c.tenant_id, coalesce(rows_, 0) AS predictions_rows,
               coalesce(fresh, false) AS predictions_fresh, EXISTS (SELECT 1 FROM v_rfm r WHERE r.tenant_id = c.tenant_id) AS marts_built,
               coalesce(monthly_run_streak, 0) AS monthly_run_streak, monthly_run_streak IS NOT NULL AS scores_ever_run,
               (SELECT count(*) FROM t_experiments e WHERE e.tenant_id = c.tenant_id AND status = 'concluded' AND concluded_at >= as_of - INTERVAL 180 DAY)
                 AS concluded_6mo,
               (SELECT count(*) FROM t_experiments e WHERE e.tenant_id = c.tenant_id AND status = 'concluded' AND decision = 'shipped') AS winners_shipped,
               (SELECT avg(CAST(hypothesis IS NOT NULL AND decision IS NOT NULL AS INTEGER)) FROM t_experiments e
                WHERE e.tenant_id = c.tenant_id AND status = 'concluded') AS decided_share,
               starts_6mo AS cadence_starts_6mo, flows_total, flows_active_60d
        FROM t_clock c
        LEFT JOIN (SELECT tenant_id, count(*) AS rows_, date_diff('day', max(scored_on), DATE '2001-08-12') <= 7 AS fresh
                   FROM t_predictions GROUP BY ALL) p ON p.tenant_id = c.tenant_id
        LEFT JOIN v_streak s ON s.tenant_id = c.tenant_id LEFT JOIN v_in_velocity v ON v.tenant_id = c.tenant_id
        LEFT JOIN v_flows f ON f.tenant_id = c.tenant_id""",
}

RATES = {
    "gravity": "repeat_rate_90d median_repurchase_days avg_m3_retention repeat_revenue_share",
    "flow": "healthy_stage_share new_to_active_rate slipping_to_dormant_rate reactivation_rate",
    "signal": "identity_resolution_rate field_completeness payment_match_rate history_months",
    "watertight": "",
    "vitals": "email_bounce_rate email_unsub_rate whatsapp_fail_rate whatsapp_optin_share consent_backed_share",
    "velocity": "",
    "autopilot": "automated_revenue_share",
    "pulse": "median_delivery_days rto_rate median_resolution_hours breach_rate avg_csat avg_review_rating nps avg_review_rating_prev_6mo",
    "altitude": "decided_share",
}


def _w(kind, p90):
    share = f"leak_{kind}_paise / nullif(gross_revenue_paise, 0)"
    return f"100.0 * (1.0 - least(coalesce({share}, 0), {p90}::DOUBLE) / {p90}::DOUBLE)"


def _maybe(col, worst, best, empty="0"):
    return f"CASE WHEN {col} IS NULL THEN {empty} ELSE {lin(col, worst, best)} END"


_OPT = lin("whatsapp_optin_share", 0.05, 0.45)
_DONE = "coalesce(100.0 * {} / nullif(concluded, 0), 0)"


def _mean(*subs):
    return f"coalesce(list_avg(list_filter([{', '.join(subs)}], lambda x: x IS NOT NULL)), 0)"


COMPONENTS = {
    "gravity": {
        "repeat_rate_90d": (40, lin(nz("repeat_rate_90d"), 0.05, 0.35)),
        "repurchase_latency": (25, _maybe("median_repurchase_days", 120, 40)),
        "cohort_decay": (25, lin(nz("avg_m3_retention"), 0.04, 0.25)),
        "repeat_revenue_share": (10, lin(nz("repeat_revenue_share"), 0.10, 0.45)),
    },
    "flow": {
        "stage_distribution": (35, lin(nz("healthy_stage_share"), 0.08, 0.40)),
        "new_to_active_velocity": (30, lin(nz("new_to_active_rate"), 0.05, 0.30)),
        "slipping_to_dormant_leak": (25, _maybe("slipping_to_dormant_rate", 0.95, 0.50, "100")),
        "reactivation_rate": (10, _maybe("reactivation_rate", 0, 0.12, "100")),
    },
    "signal": {
        "identity_resolution_rate": (35, lin(nz("identity_resolution_rate"), 0.60, 0.98)),
        "field_completeness": (25, lin(nz("field_completeness"), 0.50, 1.0)),
        "cross_source_reconciliation": (25, lin(nz("payment_match_rate"), 0.70, 0.99)),
        "history_depth": (15, lin(nz("history_months"), 0, 18)),
    },
    "watertight": {
        "preventable_churn": (40, _w("preventable_churn", 0.08)),
        "rto_cod": (30, _w("rto_cod", 0.06)),
        "failed_payments": (15, _w("failed_payments", 0.02)),
        "discount_abuse": (15, _w("discount_abuse", 0.03)),
    },
    "vitals": {
        "deliverability": (30, f"CASE WHEN email_bounce_rate IS NULL THEN 0 ELSE 0.7::DOUBLE * {lin('email_bounce_rate', 0.05, 0.005)} "
                               f"+ 0.3::DOUBLE * {lin(nz('email_unsub_rate'), 0.02, 0.001)} END"),
        "whatsapp_optin": (25, f"0.7::DOUBLE * {_OPT} + 0.3::DOUBLE * CASE WHEN whatsapp_fail_rate IS NULL THEN {_OPT} "
                               f"ELSE {lin('whatsapp_fail_rate', 0.10, 0.01)} END"),
        "list_hygiene_consent": (25, f"0.5 * {_maybe('consent_backed_share', 0.40, 0.95)} + 0.5 * "
                                     f"{lin(nz('sends_after_revoke / nullif(total_sends, 0)'), 0.01, 0.0)}"),
        "flow_integrity": (20, "coalesce(100.0 * flows_active_60d / nullif(flows_total, 0), 0)"),
    },
    "velocity": {
        "cadence": (35, lin("starts_6mo / 6", 0, 2)),
        "validity": (35, _DONE.format("concluded_valid")),
        "follow_through": (30, _DONE.format("concluded_decided")),
    },
    "autopilot": {
        "moment_coverage": (50, " + ".join(f"CASE WHEN list_contains(covered_moments, '{m}') THEN {w} ELSE 0 END" for m, w in {
            "welcome": 25, "winback": 20, "post_purchase": 15, "replenishment": 15, "cod_confirmation": 15,
            "abandoned_checkout": 10}.items())),
        "automated_revenue_share": (30, _maybe("automated_revenue_share", 0.05, 0.50)),
        "flow_performance": (20, "CASE WHEN coalesce(flow_revenue_per_send_paise, 0) = 0 THEN 0 "
                                 "WHEN coalesce(campaign_revenue_per_send_paise, 0) = 0 THEN 100 ELSE "
                                 + lin("flow_revenue_per_send_paise / campaign_revenue_per_send_paise", 1, 3) + " END"),
    },
    "pulse": {
        "delivery_speed": (30, _maybe("median_delivery_days", 11, 5)),
        "rto_ndr": (30, _maybe("rto_rate", 0.20, 0.03)),
        "support": (20, _mean(_maybe("median_resolution_hours", 72, 12, "NULL"), _maybe("breach_rate", 0.30, 0, "NULL"),
                              _maybe("avg_csat", 3.0, 4.8, "NULL"))),
        "reviews_nps": (20, _mean(_maybe("avg_review_rating", 3.2, 4.6, "NULL"), _maybe("nps", -20, 70, "NULL"))),
    },
    "altitude": {
        "maturity_position": (40, f"{_maybe('signal', 40, 70)} / 4 + CASE WHEN marts_built THEN 25 ELSE 0 END "
                                  "+ CASE WHEN predictions_rows = 0 THEN 0 WHEN predictions_fresh THEN 25 ELSE 12.5 END "
                                  "+ 12.5 * least(concluded_6mo / 6, 1) + 12.5 * least(winners_shipped / 3, 1)"),
        "decision_hygiene": (30, "coalesce(100 * decided_share, 0)"),
        "capability": (20, f"0.5 * {lin('cadence_starts_6mo / 6', 0, 2)} + 50 * coalesce(flows_active_60d / nullif(flows_total, 0), 0)"),
        "executive_engagement": (10, lin("monthly_run_streak", 0, 6)),
    },
}

for _name, _parts in COMPONENTS.items():
    _source = f"v_in_{_name}"
    if _name == "altitude":
        _source = "(SELECT a.*, s.signal FROM v_in_altitude a LEFT JOIN v_score_signal s ON s.tenant_id = a.tenant_id)"
    VIEWS[f"v_score_{_name}"] = score_sql(_name, _source, _parts)

_ALL = " ".join(f"LEFT JOIN v_score_{n} ON v_score_{n}.tenant_id = t.tenant_id" for n in COMPONENTS)
_W = {"gravity": 20, "flow": 12, "signal": 12, "watertight": 12, "vitals": 10, "velocity": 10, "pulse": 10, "autopilot": 8,
      "altitude": 6}
# A tenant without orders: watertight 100, the rest 0 or skipped.
VIEWS["v_all_scores"] = f"""
    SELECT t.tenant_id, {', '.join(_W)} FROM t_tenants t {_ALL}
    UNION ALL BY NAME SELECT max(tenant_id) + 94 AS tenant_id, 0.0::DOUBLE AS gravity, 0.0::DOUBLE AS flow, 0.0::DOUBLE AS signal,
      100.0::DOUBLE AS watertight FROM t_tenants"""

QUERIES = {
    "linear_score": lambda t: r6(t.order_headers.select(
        "tenant_id", "order_id", linear(F.col("total_paise").cast("double"), 5e6, 4e7).alias("up"),
        linear(F.col("total_paise").cast("double"), 4e7, 5e6).alias("down"))),
    "repeat_rate_90d": lambda t: r6(si.repeat_rate_90d(t.indexed_orders)),
    "median_repurchase_days": lambda t: r6(si.median_repurchase_days(t.indexed_orders)),
    "m3_retention": lambda t: r6(si.m3_retention(Marts(t).cohort_retention)),
    "repeat_revenue_share": lambda t: r6(si.repeat_revenue_share(Marts(t).executive_kpis)),
    "healthy_stage_share": lambda t: r6(si.healthy_share(t.dim_customers)),
    "new_to_active_rate": lambda t: r6(si.new_to_active(t.dim_customers, t.order_headers)),
    "stage_transition_rate": lambda t: (lambda r: r6(si.stage_transition(r, "slipping", ("dormant", "lost"), "slipping_to_dormant_rate").join(
        si.stage_transition(r, "dormant", ("new", "active", "loyal"), "reactivation_rate"), "tenant_id", "full")))(Marts(t).retention_facts),
    "identity_rate": lambda t: r6(si.identity_rate(t.order_headers)),
    "field_completeness": lambda t: r6(si.field_completeness(t.customers, t.clean_pii)),
    "payment_match_rate": lambda t: r6(si.payment_match_rate(t.order_headers, t.fact_payments)),
    "history_months": lambda t: si.history_months(t.order_headers),
    "consent_backed_share": lambda t: r6(si.consent_backed_share(t.dim_customers, t.fact_consent)),
    "sends_after_revoke": lambda t: si.sends_after_revoke(t.fact_messages, t.fact_consent),
    "flow_activity": lambda t: si.flow_activity(t.dim_campaigns, t.fact_messages),
    "monthly_run_streak": lambda t: si.monthly_run_streak(t.score_runs),
    **{f"{n}_inputs": (lambda n: lambda t: r6(getattr(_inputs(t), n)))(n) for n in COMPONENTS},
    **{f"score_{n}": _score(n) for n in COMPONENTS},
    "score_composite": lambda t: scores.all_scores(_inputs(t, reuse=True).all(_tenants(t))).select(
        "tenant_id", *_W, "composite", "coverage", F.array_join("missing", ",").alias("missing")),
    "score_runs_append": lambda t: scores.score_runs(
        scores.all_scores(_inputs(t, reuse=True).all(_tenants(t))), "2001-08-12 04:00:00").select(
        "tenant_id", "score", "value", "computed_at", "definition_version",
        F.length("inputs_hash").alias("hash_length"), (F.length("components") > 2).alias("has_components")),
    "score_components": lambda t: scores.score_components(scores.all_scores(_inputs(t, reuse=True).all(_tenants(t)))).select(
        "tenant_id", "score", "component", "weight", "sub_score"),
    "no_orders_defaults": lambda t: r6(_inputs(t).first_phase(_tenants(t))),
}


def _inputs_sql(n):
    if not RATES[n]:
        return f"SELECT * FROM v_in_{n}"
    return f"SELECT * REPLACE ({', '.join(f'round({c}, 6) AS {c}' for c in RATES[n].split())}) FROM v_in_{n}"


def _one(n, *cols):
    return f"SELECT tenant_id, {', '.join(f'round({c}, 6) AS {c}' for c in cols)} FROM v_in_{n}"


_TOTAL = " + ".join(f"coalesce({n} * {w}, 0)" for n, w in _W.items())
_WEIGHT = " + ".join(f"CASE WHEN {n} IS NULL THEN 0 ELSE {w} END" for n, w in _W.items())
_KNOWN = " + ".join(f"CASE WHEN {n} IS NULL THEN 0 ELSE 1 END" for n in _W)
_MISSING = "concat_ws(',', " + ", ".join(f"CASE WHEN {n} IS NULL THEN '{n}' END" for n in _W) + ")"
_COMPOSITE = f"round_even(({_TOTAL}) / ({_WEIGHT}), 1)"
_LONG = " UNION ALL ".join(
    f"SELECT tenant_id, '{n}' AS score, '{c}' AS component, CAST({w} AS INTEGER) AS weight, {n}_{c} AS sub_score FROM v_score_{n}"
    for n, parts in COMPONENTS.items() for c, (w, _) in parts.items()
) + " UNION ALL " + " UNION ALL ".join(
    f"SELECT (SELECT max(tenant_id) + 94 FROM t_tenants), '{n}', '{c}', CAST({w} AS INTEGER), "
    f"{'100.0' if n == 'watertight' else '0.0'}::DOUBLE"
    for n in ("gravity", "flow", "signal", "watertight") for c, (w, _) in COMPONENTS[n].items()
)

SQL = {
    "linear_score": """
        SELECT tenant_id, order_id, round(least(100, greatest(0, (total_paise - 5e6) / 35e6 * 100)), 6) AS up,
               round(least(100, greatest(0, (4e7 - total_paise) / 35e6 * 100)), 6) AS down FROM t_heads""",
    "repeat_rate_90d": _one("gravity", "repeat_rate_90d"),
    "median_repurchase_days": _one("gravity", "median_repurchase_days"),
    "m3_retention": _one("gravity", "avg_m3_retention"),
    "repeat_revenue_share": _one("gravity", "repeat_revenue_share"),
    "healthy_stage_share": _one("flow", "healthy_stage_share"),
    "new_to_active_rate": _one("flow", "new_to_active_rate") + " WHERE new_to_active_rate IS NOT NULL",
    "stage_transition_rate": _one("flow", "slipping_to_dormant_rate", "reactivation_rate"),
    "identity_rate": _one("signal", "identity_resolution_rate"),
    "field_completeness": _one("signal", "field_completeness"),
    "payment_match_rate": _one("signal", "payment_match_rate"),
    "history_months": _one("signal", "history_months"),
    "consent_backed_share": "SELECT tenant_id, round(consent_backed_share, 6) AS consent_backed_share FROM v_backed",
    "sends_after_revoke": "SELECT * FROM v_revoked",
    "flow_activity": "SELECT * FROM v_flows",
    "monthly_run_streak": "SELECT * FROM v_streak",
    **{f"{n}_inputs": _inputs_sql(n) for n in COMPONENTS},
    **{f"score_{n}": f"SELECT * FROM v_score_{n}" for n in COMPONENTS},
    "score_composite": f"""
        SELECT *, {_COMPOSITE} AS composite, ({_KNOWN}) || '/9' AS coverage, {_MISSING} AS missing FROM v_all_scores""",
    "score_runs_append": f"""
        SELECT tenant_id, score, value, TIMESTAMP '2001-08-12 04:00:00' AS computed_at, 'v2.0' AS definition_version,
               CAST(64 AS INTEGER) AS hash_length, true AS has_components
        FROM (UNPIVOT (SELECT *, {_COMPOSITE} AS composite FROM v_all_scores)
              ON {', '.join(_W)}, composite INTO NAME score VALUE value)""",
    "score_components": _LONG,
    "no_orders_defaults": f"""
        SELECT tenant_id, true AS has_orders, {', '.join(f'round({c}, 6) AS {c}' if c in si.STAY_NULL else f'round(coalesce({c}, 0), 6) AS {c}' for n in ('gravity', 'flow', 'signal') for c in RATES[n].split())},
               gross_revenue_paise, leak_preventable_churn_paise, leak_rto_cod_paise, leak_failed_payments_paise, leak_discount_abuse_paise
        FROM v_in_gravity JOIN v_in_flow USING (tenant_id) JOIN v_in_signal USING (tenant_id) JOIN v_in_watertight USING (tenant_id)
        UNION ALL SELECT max(tenant_id) + 94, false, 0, NULL, 0, 0, 0, 0, 1, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0 FROM t_tenants""",
}
