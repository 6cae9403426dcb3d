"""Who is who: match keys, connected components, merges and what follows from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from patronage.functions import normalize_email, normalize_phone
from patronage.session import settle

# Identity types that can merge customers, strongest first.
PRECEDENCE = ("shopify_customer_id", "phone", "email")
TENANT = "tenant_id"


def _rank(kind: Column) -> Column:
    out = F.lit(len(PRECEDENCE))
    for i, name in reversed(list(enumerate(PRECEDENCE))):
        out = F.when(kind == name, i).otherwise(out)
    return out


# ------------------------------------------------------------------ keys


def claim_handles(handles: DataFrame, existing: DataFrame) -> DataFrame:
    """New handles: the first claimant of (tenant, type, value) keeps it.

    A handle that is taken stays where it is: that is what merges customers
    later. `handles` comes with an `order` struct or column to tell who was first.
    """
    key = [TENANT, "identity_type", "identity_value"]
    rest = [c for c in handles.columns if c not in (*key, "order")]
    first = handles.groupBy(*key).agg(F.min_by(F.struct(*rest), F.col("order")).alias("r"))
    return first.join(existing.select(*key), key, "left_anti").select(*key, "r.*")


def identity_keys(identities: DataFrame, pii: DataFrame, customers: DataFrame) -> DataFrame:
    """Edges customer - key over handles and contact data of live customers."""
    kind, value = F.col("identity_type"), F.col("identity_value")
    clean = F.when(kind == "phone", normalize_phone(value)).when(kind == "email", normalize_email(value)).otherwise(value)
    held = identities.where(kind.isin(*PRECEDENCE)).select(TENANT, "customer_id", "identity_type", clean.alias("value"))
    copies = pii.select(TENANT, "customer_id", F.explode(F.array(
        F.struct(F.lit("phone").alias("identity_type"), normalize_phone(F.col("primary_phone")).alias("value")),
        F.struct(F.lit("email").alias("identity_type"), normalize_email(F.col("primary_email")).alias("value")),
    )).alias("k")).select(TENANT, "customer_id", "k.*")
    live = customers.where(F.col("merged_into_customer_id").isNull()).select(TENANT, "customer_id")
    return (
        held.unionByName(copies).where(F.coalesce("value", F.lit("")) != "")
        .join(live, [TENANT, "customer_id"], "left_semi").distinct()
    )


GUEST = (
    "phone string, email string, contact_email string, shipping_address struct<phone: string>, "
    "billing_address struct<phone: string>"
)


def guest_order_keys(orders: DataFrame, raw: DataFrame) -> DataFrame:
    """Contact keys of orders without a customer, read from their landed payloads."""
    guests = orders.where(F.col("customer_id").isNull()).select(TENANT, "source", "external_id", "order_id")
    payloads = raw.where(F.col("resource") == "orders").select(TENANT, "source", "external_id", "payload")
    # Join first: only guests' payloads are worth parsing.
    found = guests.join(payloads, [TENANT, "source", "external_id"]).select(
        TENANT, "order_id", F.from_json("payload", GUEST).alias("p")
    )
    first = lambda *cols: F.coalesce(*[F.when(c != "", c) for c in cols])
    p = F.col("p")
    phone = normalize_phone(first(p["phone"], p["shipping_address"]["phone"], p["billing_address"]["phone"]))
    email = normalize_email(first(p["email"], p["contact_email"]))
    pairs = F.array(
        F.struct(F.lit("phone").alias("identity_type"), phone.alias("value")),
        F.struct(F.lit("email").alias("identity_type"), email.alias("value")),
    )
    return (
        found.select(TENANT, "order_id", F.explode(pairs).alias("k")).select(TENANT, "order_id", "k.*")
        .where(F.col("value").isNotNull())
    )


# ------------------------------------------------------------------ components


def nodes(keys: DataFrame, guest_keys: DataFrame | None) -> DataFrame:
    """(node, key) pairs: a customer is an even node number, a guest order an odd one."""
    key = F.concat_ws(":", "identity_type", "value")
    pairs = keys.select(TENANT, (F.col("customer_id") * 2).alias("node"), key.alias("key"))
    if guest_keys is not None:
        pairs = pairs.unionByName(
            guest_keys.select(TENANT, (F.col("order_id") * 2 + 1).alias("node"), key.alias("key"))
        )
    return pairs


def star_edges(pairs: DataFrame) -> DataFrame:
    """Every node linked to the lowest node that holds one of its keys.

    A key shared by n nodes gives n links, not n * n pairs. Keys with a single
    holder cannot merge anything and drop out here.
    """
    low = pairs.groupBy(TENANT, "key").agg(F.min("node").alias("low"), F.max("node").alias("high")).where("low <> high")
    return (
        pairs.join(low, [TENANT, "key"]).where("node <> low")
        .select(TENANT, F.col("node").alias("u"), F.col("low").alias("v")).distinct()
    )


def connected_components(edges: DataFrame) -> DataFrame:
    """(tenant_id, node, component) for all nodes on an edge; component is its lowest node.

    First every node moves to the lowest node it sees, and the links between these are all that is
    left for the rounds: a hub's neighbours take no part in them. The lowest node of a component is
    seen by its neighbours, so it is among them.
    """
    now = settle(_downward(edges))
    both = now.unionByName(now.select(TENANT, F.col("v").alias("u"), F.col("u").alias("v")))
    low = settle(both.groupBy(TENANT, F.col("u").alias("node")).agg(F.least(F.min("v"), F.col("u")).alias("home")))
    side = lambda end: low.select(TENANT, F.col("node").alias(end), F.col("home").alias(f"home_{end}"))
    between = now.join(side("u"), [TENANT, "u"]).join(side("v"), [TENANT, "v"]).where("home_u <> home_v")
    joined = _star_rounds(between.select(TENANT, F.col("home_u").alias("u"), F.col("home_v").alias("v")))
    return low.join(joined.withColumnRenamed("node", "home"), [TENANT, "home"], "left").select(
        TENANT, "node", F.coalesce("component", "home").alias("component"))


def _downward(edges: DataFrame) -> DataFrame:
    return edges.select(TENANT, F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()


def _star_rounds(edges: DataFrame) -> DataFrame:
    """(tenant_id, node, component) by the large-star and small-star steps of Kiveris et al. (2014).

    Each step is a minimum per node and a join back to it, so a hub's neighbours are
    spread over tasks by AQE's skew split rather than collected. Rounds are
    checkpointed; the loop ends when a round changes nothing.
    """
    now = settle(_downward(edges))
    mark = None
    while True:
        both = now.unionByName(now.select(TENANT, F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy(TENANT, "u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        # large star: neighbours above a node move to the lowest node it sees
        large = (
            both.where("v > u").join(low, [TENANT, "u"]).where("v <> m")
            .select(TENANT, F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        )
        # small star: a node and its lower neighbours move to the lowest of them
        least = large.groupBy(TENANT, "u").agg(F.min("v").alias("m"))
        small = (
            large.join(least, [TENANT, "u"]).where("v <> m")
            .select(TENANT, F.col("v").alias("u"), F.col("m").alias("v"))
            .unionByName(least.select(TENANT, "u", F.col("m").alias("v"))).distinct()
        )
        after = settle(small)
        # Same count and same two hash sums: the links are the same.
        was, mark = mark, _mark(after)
        now = after
        if mark == was:
            break
    roots = now.groupBy(TENANT, "v").agg(F.lit(1)).select(TENANT, F.col("v").alias("node"), F.col("v").alias("component"))
    return now.select(TENANT, F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)


def _mark(links: DataFrame) -> tuple:
    hashed = F.xxhash64(TENANT, "u", "v").cast("decimal(20,0)")
    row = links.agg(F.count(F.lit(1)), F.sum(hashed), F.sum(F.hash(TENANT, "u", "v").cast("long"))).first()
    return tuple(row)


def customer_components(keys: DataFrame, guest_keys: DataFrame | None = None) -> DataFrame:
    """Component of every customer that holds a key; guest orders bridge, and get one too.

    Columns: tenant_id, kind (`customer` or `guest`), id, component.
    """
    pairs = settle(nodes(keys, guest_keys))
    grouped = connected_components(star_edges(pairs))
    alone = pairs.select(TENANT, "node").distinct().join(grouped, [TENANT, "node"], "left")
    return as_members(alone.withColumn("component", F.coalesce("component", "node")))


def as_members(found: DataFrame) -> DataFrame:
    """Node numbers of (tenant_id, node, component) as customers and guest orders: tenant_id, kind, id, component."""
    return found.select(
        TENANT, F.when(F.col("node") % 2 == 0, "customer").otherwise("guest").alias("kind"),
        F.expr("(node - node % 2) div 2").alias("id"), "component",
    )


# ------------------------------------------------------------------ merging


def age() -> Column:
    """Orders customers oldest first: any order before none, then earliest order, record and id."""
    return F.struct(
        F.col("first_order_at").isNull().alias("no_order"), F.col("first_order_at").alias("first_order"),
        F.col("created_at").alias("created"), F.col("customer_id").alias("id"),
    )


def survivors(components: DataFrame, customers: DataFrame) -> DataFrame:
    """Per component the oldest customer, and every other one as absorbed.

    Columns: tenant_id, component, customer_id, survivor_id, age.
    """
    people = components.where("kind = 'customer'").select(TENANT, "component", F.col("id").alias("customer_id"))
    dated = people.join(
        customers.select(TENANT, "customer_id", "first_order_at", "created_at"), [TENANT, "customer_id"]
    ).withColumn("age", age())
    oldest = dated.groupBy(TENANT, "component").agg(F.min("age").alias("old"))
    return dated.join(oldest, [TENANT, "component"]).select(
        TENANT, "component", "customer_id", F.col("old.id").alias("survivor_id"), "age"
    )


def canonical_map(chosen: DataFrame) -> DataFrame:
    """absorbed -> survivor, absorbed customers only."""
    return chosen.where("customer_id <> survivor_id").select(TENANT, "customer_id", "survivor_id")


def merge_edges(chosen: DataFrame, keys: DataFrame) -> DataFrame:
    """Audit row per absorbed customer with the strongest key type it shared.

    Customers join oldest first, so a key counts as shared when an older
    customer of the component holds it too. Without one the link came over a
    guest order, and the row says phone.
    """
    held = keys.join(chosen.select(TENANT, "customer_id", "component", "age"), [TENANT, "customer_id"])
    holder = held.groupBy(TENANT, "component", "identity_type", "value").agg(F.min("age").alias("first_age"))
    shared = (
        held.join(holder, [TENANT, "component", "identity_type", "value"]).where("first_age < age")
        .groupBy(TENANT, "customer_id").agg(F.min(_rank(F.col("identity_type"))).alias("rank"))
    )
    name = F.when(F.col("rank") == 0, PRECEDENCE[0]).when(F.col("rank") == 2, PRECEDENCE[2]).otherwise("phone")
    return canonical_map(chosen).join(shared, [TENANT, "customer_id"], "left").select(
        TENANT, "survivor_id", F.col("customer_id").alias("absorbed_id"), name.alias("merge_key")
    )


def repoint(df: DataFrame, canonical: DataFrame) -> DataFrame:
    """Rewrite customer_id to the survivor's."""
    return (
        df.join(canonical, [TENANT, "customer_id"], "left")
        .withColumn("customer_id", F.coalesce("survivor_id", "customer_id")).select(*df.columns)
    )


def survive_pii(pii: DataFrame, chosen: DataFrame) -> DataFrame:
    """Contact data per survivor: its own values, gaps filled from the absorbed, oldest first."""
    fields = ("primary_email", "primary_phone", "first_name", "last_name")
    own = pii.join(chosen.select(TENANT, "customer_id", "survivor_id", "age"), [TENANT, "customer_id"], "left")
    filled = own.groupBy(TENANT, F.coalesce("survivor_id", "customer_id").alias("customer_id")).agg(
        *[F.min_by(c, F.when(F.col(c).isNotNull(), F.coalesce("age", _no_age()))).alias(c) for c in fields]
    )
    return filled


def _no_age() -> Column:
    return F.struct(
        F.lit(False).alias("no_order"), F.lit(None).cast("timestamp_ntz").alias("first_order"),
        F.lit(None).cast("timestamp_ntz").alias("created"), F.lit(0).cast("long").alias("id"),
    )


def merge_flags(customers: DataFrame, canonical: DataFrame) -> DataFrame:
    """Opt-in flags of the live customers: set when any merged one had them set."""
    flags = ("accepts_email_marketing", "whatsapp_opted_in", "sms_opted_in")
    return repoint(customers.select(TENANT, "customer_id", *flags), canonical).groupBy(TENANT, "customer_id").agg(
        *[F.bool_or(f).alias(f) for f in flags]
    )


def attach_guests(guest_keys: DataFrame, components: DataFrame, chosen: DataFrame) -> DataFrame:
    """Guest orders and the survivor of the component their contact keys lead to.

    A guest order is a node of the same graph, so both its keys lie in one
    component; one that holds no customer stays unresolved.
    """
    owner = chosen.where("customer_id = survivor_id").select(TENANT, "component", "survivor_id")
    return (
        components.where("kind = 'guest'").join(owner, [TENANT, "component"])
        .select(TENANT, F.col("id").alias("order_id"), F.col("survivor_id").alias("customer_id"))
    )


def resolve_report(
    tenants: DataFrame, customers: DataFrame, edges: DataFrame, orders: DataFrame, attached: DataFrame
) -> DataFrame:
    """Customers before and after, merges, orders attached and unresolved, match rate."""
    count = lambda df, name: df.groupBy(TENANT).agg(F.count(F.lit(1)).alias(name))
    live = customers.where(F.col("merged_into_customer_id").isNull())
    known = orders.join(attached.select(TENANT, "order_id", F.lit(1).alias("got")), [TENANT, "order_id"], "left")
    lost = known.where(F.col("customer_id").isNull() & F.col("got").isNull())
    out = tenants.select(TENANT)
    for part in (
        count(live, "customers_before"), count(edges, "merges"), count(attached, "orders_attached"),
        count(lost, "unresolved_orders"), count(orders, "n"),
    ):
        out = out.join(part, TENANT, "left")
    out = out.na.fill(0)
    rate = F.when(F.col("n") == 0, F.lit(1.0)).otherwise(1 - F.col("unresolved_orders") / F.col("n"))
    return out.select(
        TENANT, "customers_before", (F.col("customers_before") - F.col("merges")).alias("customers_after"),
        "merges", "orders_attached", "unresolved_orders", rate.alias("match_rate"),
    )


def follow_pointers(df: DataFrame, key: str, parent: str) -> DataFrame:
    """Where each chain of pointers ends: rows (tenant_id, key, root).

    Pointer jumping halves every chain per round; `parent` is null, or the row itself, at an end, and a
    parent that is no row of its own is an end as well. Rows whose end is known take no part in further
    rounds. The rows still open must become fewer; where they do not, the pointers run in a circle.
    """
    step = settle(df.select(TENANT, key, F.nullif(F.col(parent), F.col(key)).alias("root")))
    done = settle(step.where("root is null").select(TENANT, key, F.col(key).alias("root")))
    open_ = step.where("root is not null")
    left = open_.count()
    while left:
        ends = done.select(TENANT, F.col(key).alias("root"), F.col("root").alias("end"), F.lit(True).alias("known"))
        hops = open_.select(TENANT, F.col(key).alias("root"), F.col("root").alias("end"), F.lit(False).alias("known"))
        moved = settle(open_.join(ends.unionByName(hops), [TENANT, "root"], "left").select(
            TENANT, key, F.coalesce("end", "root").alias("root"), F.coalesce("known", F.lit(True)).alias("known")))
        done = done.unionByName(moved.where("known").drop("known"))
        open_ = moved.where("not known").drop("known")
        before, left = left, open_.count()
        if left == before:
            raise ValueError(f"{left} pointers run in a circle")
    return done


def canonical_ids(customers: DataFrame) -> DataFrame:
    """Live customer behind each customer id, along the merge pointers."""
    return follow_pointers(customers, "customer_id", "merged_into_customer_id").withColumnRenamed("root", "canonical_id")


def resolve(core: dict[str, DataFrame], raw: DataFrame, tenants: DataFrame) -> dict[str, DataFrame]:
    """The whole step: keys, components, survivors, and every table repointed.

    `core` needs customers (with first_order_at and created_at), pii, identities
    and orders; refunds, messages, consent and further child tables with a
    customer_id are repointed when given.
    """
    customers, orders = core["customers"], core["orders"]
    keys = settle(identity_keys(core["identities"], core["pii"], customers))
    guests = settle(guest_order_keys(orders, raw))
    components = settle(customer_components(keys, guests))
    chosen = settle(survivors(components, customers))
    canonical = canonical_map(chosen)
    edges = merge_edges(chosen, keys)
    attached = attach_guests(guests, components, chosen)
    flags = merge_flags(customers, canonical)
    out = {
        name: repoint(df, canonical) for name, df in core.items() if name not in ("customers", "pii", "orders")
    }
    found = attached.withColumnRenamed("customer_id", "found")
    joined = repoint(orders, canonical).join(found, [TENANT, "order_id"], "left")
    out["orders"] = joined.withColumn("customer_id", F.coalesce("customer_id", "found")).select(*orders.columns)
    merged = canonical.withColumnRenamed("survivor_id", "into")
    plain = [c for c in customers.columns if c not in ("accepts_email_marketing", "whatsapp_opted_in", "sms_opted_in")]
    out["customers"] = (
        customers.select(*plain).join(merged, [TENANT, "customer_id"], "left")
        .withColumn("merged_into_customer_id", F.coalesce("merged_into_customer_id", "into")).drop("into")
        .join(flags, [TENANT, "customer_id"], "left")
        .na.fill(False, ["accepts_email_marketing", "whatsapp_opted_in", "sms_opted_in"])
    )
    out["pii"] = survive_pii(core["pii"], chosen)
    out["edges"] = edges
    out["report"] = resolve_report(tenants, customers, edges, orders, attached)
    return out
