"""Queries and SQL of the event export, the PII-free tables and the streaming jobs."""

from pyspark.sql import functions as F

from patronage.operators import events as ev
from patronage.session import work_path
from patronage.sources import crm
from patronage.streaming import jobs


def _named(df, source, prefix, key):
    return df.withColumns({"source": F.lit(source), "external_id": F.concat(F.lit(prefix), F.col(key))})


def _orders(t):
    return _named(t.fact_orders, "shopify", "O", "order_id").withColumn("currency", F.lit("INR"))


def commerce(t):
    return ev.events_commerce(t.customers, _orders(t))


def logistics(t):
    ships = _named(t.fact_shipments, "shiprocket", "s", "shipment_id").withColumn(
        "courier", F.expr("if(order_id % 3 = 0, null, concat('cr', order_id % 3))"))
    return ev.events_logistics(ships, _orders(t))


def payment(t):
    pays = _named(t.fact_payments, "razorpay", "pay_", "payment_id").withColumn("gateway", F.lit("razorpay"))
    refunds = _named(t.fact_refunds, "shopify", "R", "refund_id").withColumn(
        "customer_id", F.expr("if(order_id % 4 = 0, null, customer_id)"))
    return ev.events_payment(pays, refunds, _orders(t))


def messaging(t):
    said = t.fact_consent.withColumns({
        "source": F.lit("klaviyo"), "method": F.lit(None).cast("string"),
        "external_id": F.expr("if(consent_id % 2 = 0, null, concat('con', consent_id))")})
    return ev.events_messaging(_named(t.fact_messages, "klaviyo", "m", "message_id"), said)


def voice(t):
    return ev.events_voice(_named(t.fact_tickets, "gorgias", "tk", "ticket_id"),
                           _named(t.fact_reviews, "judgeme", "rv", "review_id"), _named(t.fact_nps, "internal", "n", "nps_id"))


def experiment(t):
    return ev.events_experiment(t.fact_experiments)


def everything(t):
    out = commerce(t)
    for part in (logistics(t), payment(t), messaging(t), voice(t), experiment(t)):
        out = out.unionByName(part)
    return out


def _ids(t):
    """All orders' events twice, the second time a day later: the later one stays."""
    once = commerce(t)
    again = once.withColumn("occurred_at", F.expr("timestampadd(DAY, 1, occurred_at)"))
    return ev.with_event_id(once.unionByName(again)).drop("properties")


def _vocabulary(t):
    renamed = commerce(t).withColumn("event_name", F.expr(
        "if(event_name = 'order_cancelled' and order_id % 100 = 0, 'order_voided', event_name)"))
    bare = renamed.withColumn("properties", F.expr("if(event_name = 'order_cancelled', '{\"order_id\": 1}', properties)"))
    lacking = ev.missing_properties(bare).select("tenant_id", "event_name", "property", "rows")
    return ev.unknown_events(bare).select("tenant_id", "event_name", F.lit(None).cast("string").alias("property"), "rows").unionByName(lacking)


def _core(t):
    return {**{n: getattr(t, n) for n in ev.EXPORTED if n.startswith("fact_")}, "dim_customers": t.dim_customers,
            "dim_products": t.products, "dim_variants": t.variants, "dim_campaigns": t.dim_campaigns}


def _dims_facts(t):
    out = None
    for name, df in ev.export_dims_facts(_core(t)).items():
        part = df.groupBy("tenant_id").agg(F.count(F.lit(1)).alias("rows"), F.lit(len(df.columns)).alias("columns"),
                                           F.lit(name).alias("table_name"))
        out = part if out is None else out.unionByName(part)
    return out


def _guarded(t):
    """Every exported table passes the guard; a private or unlisted column in any of them does not."""
    out = ev.export_dims_facts(_core(t))
    for name, df in out.items():
        for extra in ("email", "note_nobody_listed"):
            try:
                ev.assert_no_pii(df.withColumn(extra, F.lit("x")), name)
            except ValueError:
                continue
            raise AssertionError(f"{name} lets {extra} through")
    return out["dim_customers"]


# Table behind each exported one in the statements.
EXPORT_SQL = {"dim_customers": "t_dim_customers", "dim_products": "t_products", "dim_variants": "t_variants", "dim_campaigns": "t_campaigns",
              "fact_orders": "t_orders", "fact_order_items": "t_items", "fact_shipments": "t_shipments", "fact_payments": "t_payments",
              "fact_refunds": "t_refunds", "fact_messages": "t_messages", "fact_consent": "t_consent", "fact_tickets": "t_tickets",
              "fact_reviews": "t_reviews", "fact_nps": "t_nps", "fact_experiments": "t_experiments"}


def _files(t, df, label, repartition=4):
    path = work_path(t.spark, label)
    df.repartition(repartition).write.parquet(path)
    return t.spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 2).parquet(path), path


def _stream_land(t):
    raw = t.fact_payments.selectExpr(
        "tenant_id", "'razorpay' as source", "'payments' as resource", "concat('pay_', payment_id) as external_id",
        "payment_id as seq", "to_json(struct(amount_paise)) as payload")
    stream, _ = _files(t, raw.unionByName(raw.where("seq % 3 = 0")), "stream-raw")
    done = jobs.stream_land_raw(stream, work_path(t.spark, "landed"), work_path(t.spark, "ckpt-landed"))
    return done.select("tenant_id", "external_id", "seq", "payload")


def _stream_dedup(t):
    rows = ev.with_event_id(payment(t)).select("event_id", "tenant_id", "event_name", "occurred_at")
    stream, _ = _files(t, rows.unionByName(rows.where("tenant_id % 2 = 0")), "stream-events", 6)
    return jobs.stream_event_dedup(stream, work_path(t.spark, "unique"), work_path(t.spark, "ckpt-unique"))


def _stream_consent(t):
    stream, _ = _files(t, t.fact_consent, "stream-consent")
    state = jobs.stream_consent_state(stream, work_path(t.spark, "consent"), work_path(t.spark, "ckpt-consent"))
    return jobs.consent_flags_of(state)


QUERIES = {
    "events_commerce": commerce,
    "events_logistics": logistics,
    "events_payment": payment,
    "events_messaging": messaging,
    "events_voice": lambda t: voice(t).withColumn("properties", F.when(
        F.col("event_name") != "ticket_resolved", F.col("properties")).otherwise(
        F.regexp_replace("properties", r'"hours_to_resolve":[0-9.]+,', ""))),
    "events_experiment": experiment,
    "event_id": _ids,
    "event_vocabulary": _vocabulary,
    "export_events": lambda t: ev.with_event_id(everything(t)).groupBy("tenant_id", "event_name").agg(
        F.count(F.lit(1)).alias("rows"), F.min("event_id").alias("low"), F.max("occurred_at").alias("newest")),
    "dims_facts": _dims_facts,
    "pii_guard": _guarded,
    "consent_flags_batch": lambda t: crm.consent_flags(t.fact_consent),
    "stream_land_raw": _stream_land,
    "stream_event_dedup": _stream_dedup,
    "stream_consent_state": _stream_consent,
}

NO = "CAST(NULL AS BIGINT)"
VIEWS = {
    "v_ev_commerce": f"""
        SELECT tenant_id, 'customer_created' AS event_name, customer_id, {NO} AS order_id, {NO} AS message_id, created_at AS occurred_at, source, external_id,
               {NO} AS amount_paise, CAST(to_json({{'source_customer_id': external_id, 'accepts_marketing': accepts_email_marketing}}) AS VARCHAR) AS properties FROM t_customers
        UNION ALL SELECT tenant_id, 'order_placed', customer_id, order_id, {NO}, placed_at, 'shopify', 'O' || order_id, total_paise,
               CAST(to_json({{'order_id': order_id, 'total_paise': total_paise, 'currency': 'INR', 'cod': cod, 'discount_paise': discount_paise, 'customer_order_index': NULL}}) AS VARCHAR)
        FROM t_orders
        UNION ALL SELECT tenant_id, 'order_cancelled', customer_id, order_id, {NO}, cancelled_at, 'shopify', 'O' || order_id, {NO},
               CAST(to_json({{'order_id': order_id, 'reason': 'unknown'}}) AS VARCHAR) FROM t_orders WHERE cancelled_at IS NOT NULL""",
    "v_shipped": """
        SELECT s.*, h.customer_id AS cust, h.total_paise, h.cod AS hcod, CASE WHEN s.order_id % 3 = 0 THEN 'unknown' ELSE 'cr' || (s.order_id % 3) END AS courier
        FROM t_shipments s JOIN t_heads h ON h.order_id = s.order_id""",
    "v_ev_logistics": f"""
        SELECT tenant_id, 'order_fulfilled' AS event_name, cust AS customer_id, order_id, {NO} AS message_id, shipped_at AS occurred_at, 'shiprocket' AS source,
               's' || shipment_id AS external_id, {NO} AS amount_paise, CAST(to_json({{'order_id': order_id, 'courier': courier}}) AS VARCHAR) AS properties FROM v_shipped
        UNION ALL SELECT tenant_id, 'order_delivered', cust, order_id, {NO}, delivered_at, 'shiprocket', 's' || shipment_id, {NO},
               CAST(to_json({{'order_id': order_id, 'days_in_transit': date_sub('day', shipped_at, delivered_at)}}) AS VARCHAR) FROM v_shipped WHERE delivered_at IS NOT NULL
        UNION ALL SELECT tenant_id, 'order_rto', cust, order_id, {NO}, coalesce(rto_at, shipped_at), 'shiprocket', 's' || shipment_id, total_paise,
               CAST(to_json({{'order_id': order_id, 'cod': hcod, 'courier': courier}}) AS VARCHAR) FROM v_shipped WHERE rto""",
    "v_ev_payment": f"""
        SELECT p.tenant_id, 'payment_captured' AS event_name, h.customer_id, p.order_id, {NO} AS message_id, occurred_at, 'razorpay' AS source, 'pay_' || payment_id AS external_id,
               amount_paise, CAST(to_json({{'order_id': p.order_id, 'amount_paise': amount_paise, 'gateway': 'razorpay', 'method': method}}) AS VARCHAR) AS properties
        FROM t_payments p JOIN t_heads h ON h.order_id = p.order_id WHERE status = 'captured'
        UNION ALL SELECT p.tenant_id, 'payment_failed', h.customer_id, p.order_id, {NO}, occurred_at, 'razorpay', 'pay_' || payment_id, amount_paise,
               CAST(to_json({{'order_id': p.order_id, 'amount_paise': amount_paise, 'failure_reason': failure_reason}}) AS VARCHAR)
        FROM t_payments p LEFT JOIN t_heads h ON h.order_id = p.order_id WHERE status = 'failed'
        UNION ALL SELECT tenant_id, 'order_refunded', customer_id, order_id, {NO}, processed_at, 'shopify', 'R' || refund_id, amount_paise,
               CAST(to_json({{'refund_id': refund_id, 'order_id': order_id, 'amount_paise': amount_paise, 'refund_type': refund_type}}) AS VARCHAR) FROM t_refunds""",
    "v_ev_messaging": f"""
        SELECT tenant_id, event_name, customer_id, {NO} AS order_id, message_id, occurred_at, 'klaviyo' AS source, 'm' || message_id AS external_id, {NO} AS amount_paise,
               CASE WHEN event_name = 'message_sent' THEN CAST(to_json({{'message_id': message_id, 'campaign_id': campaign_id, 'channel': channel}}) AS VARCHAR)
                    ELSE CAST(to_json({{'message_id': message_id, 'channel': channel}}) AS VARCHAR) END AS properties
        FROM (SELECT *, 'message_sent' AS event_name, sent_at AS occurred_at FROM t_messages
              UNION ALL SELECT *, 'message_delivered', delivered_at FROM t_messages UNION ALL SELECT *, 'message_opened', opened_at FROM t_messages
              UNION ALL SELECT *, 'message_clicked', clicked_at FROM t_messages UNION ALL SELECT *, 'message_bounced', bounced_at FROM t_messages)
        WHERE occurred_at IS NOT NULL
        UNION ALL SELECT tenant_id, CASE WHEN action = 'granted' THEN 'channel_opted_in' ELSE 'channel_opted_out' END, customer_id, NULL, NULL, occurred_at, 'klaviyo',
               CASE WHEN consent_id % 2 = 0 THEN 'consent-' ELSE 'con' END || consent_id, NULL,
               CASE WHEN action = 'granted' THEN CAST(to_json({{'channel': channel, 'method': 'unknown'}}) AS VARCHAR)
                    ELSE CAST(to_json({{'channel': channel, 'reason': 'unsubscribe'}}) AS VARCHAR) END FROM t_consent""",
    "v_ev_voice": f"""
        SELECT tenant_id, 'ticket_opened' AS event_name, customer_id, order_id, {NO} AS message_id, opened_at AS occurred_at, 'gorgias' AS source, 'tk' || ticket_id AS external_id,
               {NO} AS amount_paise, CAST(to_json({{'ticket_id': ticket_id, 'channel': channel, 'category': category}}) AS VARCHAR) AS properties FROM t_tickets
        UNION ALL SELECT tenant_id, 'ticket_resolved', customer_id, order_id, {NO}, resolved_at, 'gorgias', 'tk' || ticket_id, {NO},
               CAST(to_json({{'ticket_id': ticket_id, 'csat_score': csat}}) AS VARCHAR) FROM t_tickets WHERE resolved_at IS NOT NULL
        UNION ALL SELECT tenant_id, 'review_submitted', customer_id, order_id, {NO}, submitted_at, 'judgeme', 'rv' || review_id, {NO},
               CAST(to_json({{'review_id': review_id, 'product_id': product_id, 'rating': rating}}) AS VARCHAR) FROM t_reviews
        UNION ALL SELECT tenant_id, 'nps_submitted', customer_id, {NO}, {NO}, responded_at, 'internal', 'n' || nps_id, {NO},
               CAST(to_json({{'nps_response_id': nps_id, 'score': score, 'channel': channel}}) AS VARCHAR) FROM t_nps""",
    "v_ev_experiment": f"""
        SELECT tenant_id, 'experiment_concluded' AS event_name, {NO} AS customer_id, {NO} AS order_id, {NO} AS message_id, concluded_at AS occurred_at,
               'internal' AS source, name AS external_id, {NO} AS amount_paise, CAST(to_json({{'experiment_id': experiment_id, 'score_target': score_target,
               'decision': coalesce(decision, 'undecided'), 'lift_pct': lift_pct}}) AS VARCHAR) AS properties FROM t_experiments WHERE status = 'concluded'""",
    "v_ev_all": " UNION ALL ".join(f"SELECT * FROM v_ev_{n}" for n in "commerce logistics payment messaging voice experiment".split()),
}
SHA = "sha256(tenant_id || '|' || source || '|' || external_id || '|' || event_name)"
TABLE_OF = {"dim_customers": "t_dim_customers", "dim_products": "t_products", "dim_variants": "t_variants", "fact_orders": "t_orders",
            "fact_order_items": "t_items", "fact_refunds": "t_refunds", "fact_payments": "t_payments", "fact_shipments": "t_shipments",
            "dim_campaigns": "t_campaigns", "fact_messages": "t_messages", "fact_consent": "t_consent", "fact_tickets": "t_tickets",
            "fact_reviews": "t_reviews", "fact_nps": "t_nps", "fact_experiments": "t_experiments"}
FLAGS = """
    SELECT tenant_id, customer_id,
           (arg_max(action, {'a': occurred_at, 'b': consent_id}) FILTER (channel = 'email')) = 'granted' AS accepts_email_marketing,
           (arg_max(action, {'a': occurred_at, 'b': consent_id}) FILTER (channel = 'whatsapp')) = 'granted' AS whatsapp_opted_in,
           (arg_max(action, {'a': occurred_at, 'b': consent_id}) FILTER (channel = 'sms')) = 'granted' AS sms_opted_in
    FROM t_consent GROUP BY ALL"""

SQL = {
    **{f"events_{n}": f"SELECT * FROM v_ev_{n}" for n in "commerce logistics payment messaging voice experiment".split()},
    "event_id": f"""SELECT {SHA} AS event_id, * EXCLUDE (properties) REPLACE (occurred_at + INTERVAL 1 DAY AS occurred_at) FROM v_ev_commerce""",
    "event_vocabulary": """
        SELECT tenant_id, 'order_voided' AS event_name, CAST(NULL AS VARCHAR) AS property, count(*) AS rows FROM t_heads WHERE order_id % 100 = 0 GROUP BY ALL
        UNION ALL SELECT tenant_id, 'order_cancelled', 'reason', count(*) FROM t_heads WHERE order_id % 50 = 0 AND order_id % 100 <> 0 GROUP BY ALL""",
    "export_events": f"""
        SELECT tenant_id, event_name, count(DISTINCT {SHA}) AS rows, min({SHA}) AS low, max(occurred_at) AS newest FROM v_ev_all GROUP BY ALL""",
    "dims_facts": " UNION ALL ".join(
        f"SELECT tenant_id, count(*) AS rows, CAST({len(ev.EXPORTED[n].split())} AS INTEGER) AS columns, '{n}' AS table_name FROM {v} GROUP BY tenant_id"
        for n, v in TABLE_OF.items()),
    "pii_guard": "SELECT * FROM t_dim_customers",
    "consent_flags_batch": FLAGS,
    "stream_land_raw": """
        SELECT tenant_id, 'pay_' || payment_id AS external_id, payment_id AS seq, '{"amount_paise":' || amount_paise || '}' AS payload FROM t_payments""",
    "stream_event_dedup": f"SELECT {SHA} AS event_id, tenant_id, event_name, occurred_at FROM v_ev_payment",
    "stream_consent_state": FLAGS,
}

# Of orders, the two columns that later steps fill are compared where those steps are.
LATER = {"fact_orders": ("delivered_at", "customer_order_index")}
for _name in EXPORT_SQL:
    QUERIES[f"export_{_name}"] = (lambda n: lambda t: ev.export_dims_facts(_core(t))[n].drop(*LATER.get(n, ())))(_name)
    SQL[f"export_{_name}"] = f"SELECT {', '.join(c for c in ev.EXPORTED[_name].split() if c not in LATER.get(_name, ()))} FROM {EXPORT_SQL[_name]}"
