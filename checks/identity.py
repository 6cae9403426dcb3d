"""Queries and SQL of identity resolution."""

from functools import cached_property

from pyspark.sql import functions as F

from checks.ingest import _merged_core, handles
from checks.marts import r6
from patronage.functions import normalize_email, normalize_phone
from patronage.operators import identity as idn
from patronage.session import settle, work_path
from patronage.sources.payloads import Payloads
from patronage.streaming import components as growing


class Case:
    """One resolution over the whole tables, its steps made on demand and stored, as `resolve` does."""

    def __init__(self, t):
        self.t = t
        self.raw = Payloads(t).orders()
        self.customers = t.customers.join(
            t.dim_customers.select("tenant_id", "customer_id", "first_order_at"), ["tenant_id", "customer_id"])
        self.orders = t.order_headers.withColumns({
            "source": F.lit("shopify"), "external_id": F.concat(F.lit("O"), "order_id")})

    @cached_property
    def keys(self):
        return settle(idn.identity_keys(handles(self.t), self.t.customer_pii, self.customers))

    @cached_property
    def guests(self):
        return settle(idn.guest_order_keys(self.orders, self.raw))

    @cached_property
    def components(self):
        return settle(idn.customer_components(self.keys, self.guests))

    @cached_property
    def chosen(self):
        return settle(idn.survivors(self.components, self.customers))


def _components(t):
    return _sized(Case(t).components)


def _grown(t):
    """All keys in three batches, and then the components of the store."""
    c = Case(t)
    pairs = settle(idn.nodes(c.keys, c.guests))
    path = work_path(t.spark, "components")
    for batch in range(3):
        growing.add_pairs(pairs.where(F.expr("node div 2 % 3") == batch), path, batch)
    return _sized(idn.as_members(growing.components(t.spark, path)))


def _sized(c):
    # A component's name is an internal node number; the oldest id tells components apart just as well.
    low = c.groupBy("tenant_id", "component").agg(
        F.min(F.when(F.col("kind") == "customer", F.col("id"))).alias("low_customer"), F.count(F.lit(1)).alias("size"))
    return c.where("kind = 'customer'").join(low, ["tenant_id", "component"]).select(
        "tenant_id", F.col("id").alias("customer_id"), "low_customer", "size")


def _edges(t):
    c = Case(t)
    return idn.merge_edges(c.chosen, c.keys)


def _attach(t):
    c = Case(t)
    return idn.attach_guests(c.guests, c.components, c.chosen)


def _report(t):
    c = Case(t)
    return r6(idn.resolve_report(
        t.tenants, c.customers, idn.merge_edges(c.chosen, c.keys), c.orders, idn.attach_guests(c.guests, c.components, c.chosen)))


def _resolve(t):
    """Orders and customers per tenant after the whole step."""
    c = Case(t)
    done = idn.resolve(
        {"customers": c.customers, "pii": t.clean_pii, "identities": handles(t), "orders": c.orders,
         "refunds": t.fact_refunds}, c.raw, t.tenants)
    return done["orders"].select("tenant_id", "order_id", "customer_id")


def _claims(t):
    pii = t.clean_pii
    offers = pii.select("tenant_id", "customer_id", F.explode(F.array(
        F.struct(F.lit("phone").alias("identity_type"), F.col("primary_phone").alias("identity_value")),
        F.struct(F.lit("email").alias("identity_type"), F.col("primary_email").alias("identity_value")))).alias("h"))
    offers = offers.select("tenant_id", "h.*", "customer_id", F.col("customer_id").alias("order")).where(
        "identity_value is not null")
    held = offers.where("customer_id % 5 = 0 and identity_type = 'phone'")
    return idn.claim_handles(offers, held)


QUERIES = {
    "normalize_phone": lambda t: t.customer_pii.select(
        "tenant_id", "customer_id", normalize_phone(F.col("primary_phone")).alias("phone")),
    "normalize_email": lambda t: t.customer_pii.select(
        "tenant_id", "customer_id", normalize_email(F.col("primary_email")).alias("email")),
    "identity_keys": lambda t: Case(t).keys,
    "guest_order_keys": lambda t: Case(t).guests,
    "connected_components": _components,
    "grow_components": _grown,
    "choose_survivor": lambda t: Case(t).chosen.select("tenant_id", "customer_id", "survivor_id"),
    "merge_edges": _edges,
    "repoint_children": lambda t: idn.repoint(
        t.fact_refunds.select("tenant_id", "refund_id", "customer_id"), idn.canonical_map(Case(t).chosen)),
    "pii_survivorship": lambda t: idn.survive_pii(t.clean_pii, Case(t).chosen),
    "optin_or": lambda t: idn.merge_flags(t.customers, idn.canonical_map(Case(t).chosen)),
    "attach_guest_orders": _attach,
    "resolve_report": _report,
    "resolve": _resolve,
    "follow_merge_pointers": lambda t: idn.canonical_ids(_merged_core(t)),
    "claim_handle": _claims,
}

VIEWS = {
    "v_guest_keys": """
        SELECT h.tenant_id, order_id, 'phone' AS identity_type, clean AS value
        FROM t_heads h JOIN (SELECT customer_id, '+919' || lpad(CAST(customer_id % 1450 AS VARCHAR), 9, '0') AS clean FROM t_people) p
          ON p.customer_id = buyer_id WHERE h.customer_id IS NULL AND order_id % 2 = 0
        UNION ALL SELECT tenant_id, order_id, 'email', 'user' || (buyer_id % 1400) || '@example.com'
        FROM t_heads WHERE customer_id IS NULL AND order_id % 4 IN (1, 2)""",
    "v_keys": """
        SELECT tenant_id, customer_id, 'shopify_customer_id' AS identity_type, external_id AS value FROM t_customers
        UNION ALL SELECT tenant_id, customer_id, 'phone', clean_phone FROM t_pii WHERE clean_phone IS NOT NULL
        UNION ALL SELECT tenant_id, customer_id, 'email', clean_email FROM t_pii WHERE clean_email IS NOT NULL""",
    "v_holders": """
        SELECT tenant_id, identity_type || ':' || value AS k, customer_id * 2 AS node FROM v_keys
        UNION ALL SELECT tenant_id, identity_type || ':' || value, order_id * 2 + 1 FROM v_guest_keys""",
    "v_links": """
        SELECT DISTINCT a.tenant_id, a.node AS u, b.node AS v FROM v_holders a JOIN v_holders b ON a.tenant_id = b.tenant_id AND a.k = b.k""",
    "v_reach": """
        SELECT tenant_id, u AS node, u AS seen FROM v_links
        UNION SELECT r.tenant_id, r.node, l.v FROM v_reach r JOIN v_links l ON l.tenant_id = r.tenant_id AND l.u = r.seen""",
    "v_comp": "SELECT tenant_id, node, min(seen) AS component FROM v_reach GROUP BY ALL",
    "v_chosen": """
        SELECT c.tenant_id, component, d.customer_id, row_number() OVER w AS place, first_value(d.customer_id) OVER w AS survivor_id
        FROM v_comp c JOIN t_dim_customers d ON d.tenant_id = c.tenant_id AND d.customer_id * 2 = c.node
        WINDOW w AS (PARTITION BY c.tenant_id, component ORDER BY first_order_at IS NULL, first_order_at, created_at, d.customer_id)""",
    "v_edges": """
        SELECT a.tenant_id, a.survivor_id, a.customer_id AS absorbed_id, coalesce(
                 (SELECT arg_min(k.identity_type, CASE k.identity_type WHEN 'shopify_customer_id' THEN 0 WHEN 'phone' THEN 1 ELSE 2 END)
                  FROM v_keys k JOIN v_keys o ON o.tenant_id = k.tenant_id AND o.identity_type = k.identity_type AND o.value = k.value
                  JOIN v_chosen b ON b.customer_id = o.customer_id AND b.component = a.component AND b.place < a.place
                  WHERE k.customer_id = a.customer_id), 'phone') AS merge_key
        FROM v_chosen a WHERE place > 1""",
    "v_attached": """
        SELECT DISTINCT c.tenant_id, (node - 1) // 2 AS order_id, survivor_id AS customer_id
        FROM v_comp c JOIN v_chosen s ON s.tenant_id = c.tenant_id AND s.component = c.component WHERE node % 2 = 1""",
}


def _survive(field):
    return f"arg_min({field}, coalesce(place, 0)) FILTER ({field} IS NOT NULL) AS {{}}"


COMPONENTS = """
        SELECT c.tenant_id, node // 2 AS customer_id, low_customer, size FROM v_comp c
        JOIN (SELECT tenant_id, component, min(CASE WHEN node % 2 = 0 THEN node // 2 END) AS low_customer, count(*) AS size FROM v_comp GROUP BY ALL) s
          ON s.tenant_id = c.tenant_id AND s.component = c.component WHERE node % 2 = 0"""
SQL = {
    "normalize_phone": "SELECT tenant_id, customer_id, clean_phone AS phone FROM t_pii",
    "normalize_email": "SELECT tenant_id, customer_id, clean_email AS email FROM t_pii",
    "identity_keys": "SELECT * FROM v_keys",
    "guest_order_keys": "SELECT * FROM v_guest_keys",
    "connected_components": COMPONENTS,
    "grow_components": COMPONENTS,
    "choose_survivor": "SELECT tenant_id, customer_id, survivor_id FROM v_chosen",
    "merge_edges": "SELECT * FROM v_edges",
    "repoint_children": """
        SELECT r.tenant_id, refund_id, coalesce(survivor_id, r.customer_id) AS customer_id
        FROM t_refunds r LEFT JOIN v_chosen c ON c.customer_id = r.customer_id""",
    "pii_survivorship": f"""
        SELECT p.tenant_id, coalesce(survivor_id, p.customer_id) AS customer_id, {_survive('clean_email').format('primary_email')},
               {_survive('clean_phone').format('primary_phone')}, {_survive('first_name').format('first_name')},
               {_survive('last_name').format('last_name')}
        FROM t_pii p LEFT JOIN v_chosen c ON c.customer_id = p.customer_id GROUP BY ALL""",
    "optin_or": """
        SELECT p.tenant_id, coalesce(survivor_id, p.customer_id) AS customer_id, bool_or(accepts_email_marketing) AS accepts_email_marketing,
               bool_or(whatsapp_opted_in) AS whatsapp_opted_in, bool_or(sms_opted_in) AS sms_opted_in
        FROM t_customers p LEFT JOIN v_chosen c ON c.customer_id = p.customer_id GROUP BY ALL""",
    "attach_guest_orders": "SELECT * FROM v_attached",
    "resolve_report": """
        SELECT tenant_id, people AS customers_before, people - merges AS customers_after, merges, orders_attached,
               guests - orders_attached AS unresolved_orders, round(1 - (guests - orders_attached) / n, 6) AS match_rate
        FROM (SELECT t.tenant_id, (SELECT count(*) FROM t_customers x WHERE x.tenant_id = t.tenant_id) AS people,
                     (SELECT count(*) FROM v_edges x WHERE x.tenant_id = t.tenant_id) AS merges,
                     (SELECT count(*) FROM v_attached x WHERE x.tenant_id = t.tenant_id) AS orders_attached,
                     (SELECT count(*) FROM t_heads x WHERE x.tenant_id = t.tenant_id) AS n,
                     (SELECT count(*) FROM t_heads x WHERE x.tenant_id = t.tenant_id AND customer_id IS NULL) AS guests FROM t_tenants t)""",
    "resolve": """
        SELECT h.tenant_id, h.order_id, coalesce(c.survivor_id, h.customer_id, a.customer_id) AS customer_id
        FROM t_heads h LEFT JOIN v_chosen c ON c.customer_id = h.customer_id LEFT JOIN v_attached a ON a.order_id = h.order_id""",
    "follow_merge_pointers": """
        SELECT (customer_id // 4) % 5 + 1 AS tenant_id, customer_id, customer_id - customer_id % 4 AS canonical_id FROM t_customers""",
    "claim_handle": """
        SELECT tenant_id, 'email' AS identity_type, clean_email AS identity_value, min(customer_id) AS customer_id FROM t_pii
        WHERE clean_email IS NOT NULL GROUP BY ALL
        UNION ALL SELECT tenant_id, 'phone', clean_phone, min(customer_id) FROM t_pii WHERE clean_phone IS NOT NULL
        GROUP BY tenant_id, clean_phone HAVING NOT bool_or(customer_id % 5 = 0)""",
}
