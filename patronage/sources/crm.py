"""Messaging, helpdesk and review payloads to typed rows, linked to customers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from patronage.functions import normalize_email, normalize_phone, parse_time
from patronage.operators.identity import follow_pointers
from patronage.session import settle
from patronage.sources.shop import KEY, filled, latest, parsed

# Default channel and profile handle of each messaging source.
CHANNEL = {"klaviyo": "email", "interakt": "whatsapp"}
PROFILE_KEY = {"klaviyo": "klaviyo_profile_id", "interakt": "interakt_profile_id"}
FLAG_CHANNELS = {"email": "accepts_email_marketing", "whatsapp": "whatsapp_opted_in", "sms": "sms_opted_in"}

CAMPAIGN = (
    "id string, name string, campaign_type string, type string, channel string, subject string, "
    "started_at string, send_time string, created_at_utc string, ended_at string, end_time string"
)
PROFILE = "profile struct<id: string, phone: string, email: string>, profile_id string, phone_number string, email string, " \
          "external_id string"
CONSENT = f"id string, {PROFILE}, channel string, action string, method string, occurred_at string"
MESSAGE = (
    f"id string, campaign_id string, {PROFILE}, channel string, occurred_at string, sent_at string, delivered_at string, "
    "opened_at string, read_at string, clicked_at string, bounced_at string, failed_at string, unsubscribed_at string"
)
TICKET = (
    "id string, order_external_id string, customer struct<external_id: string>, email string, phone string, "
    "channel string, subject string, category string, status string, opened_at string, created_datetime string, "
    "first_response_at string, resolved_at string, closed_datetime string, csat string"
)
REVIEW = (
    "id string, order_external_id string, product_external_id string, "
    "reviewer struct<external_id: string, email: string, phone: string>, rating string, title string, body string, "
    "verified string, submitted_at string, created_at string"
)


def map_campaigns(raw: DataFrame, source: str) -> DataFrame:
    p = F.col("p")
    starts = p["send_time"] if source == "klaviyo" else p["created_at_utc"]
    ends = filled(p["ended_at"], p["end_time"]) if source == "klaviyo" else p["ended_at"]
    return latest(parsed(raw, source, "campaigns", CAMPAIGN)).select(
        *KEY, F.coalesce(p["name"], F.lit("")).alias("name"),
        F.coalesce(filled(p["campaign_type"], p["type"]), F.lit("campaign")).alias("campaign_type"),
        F.coalesce(p["channel"], F.lit(CHANNEL[source])).alias("channel"), p["subject"].alias("subject"),
        parse_time(filled(p["started_at"], starts)).alias("started_at"), parse_time(ends).alias("ended_at"),
    )


# ------------------------------------------------------------------ linking


def _candidates(*pairs: tuple[str, Column]) -> Column:
    """Keys to look a customer up by, strongest first."""
    return F.array(*[
        F.struct(F.lit(i).alias("rank"), F.lit(kind).alias("identity_type"), F.when(value != "", value).alias("identity_value"))
        for i, (kind, value) in enumerate(pairs)
    ])


def profiles(raw: DataFrame, source: str, resource: str) -> DataFrame:
    """Profile behind each record: its id and the keys it can be found by, strongest first.

    A message is looked up by its profile id before anything else; the other keys count only
    where that profile is unseen. Consent goes by shop id, phone and e-mail first. `linkable` is false for an
    e-mail message without a profile, which belongs to nobody; a WhatsApp message always has a sender.
    """
    p = F.col("p")
    rows = parsed(raw, source, resource, CONSENT if resource == "consent" else MESSAGE)
    pid = F.coalesce(filled(p["profile"]["id"], p["profile_id"]), p["id"])
    phone = normalize_phone(filled(p["profile"]["phone"], p["phone_number"]))
    email = normalize_email(filled(p["profile"]["email"], p["email"]))
    seen = p["occurred_at"] if resource == "consent" else p["sent_at"]
    has_profile = filled(p["profile"]["id"], p["profile_id"]).isNotNull()
    named = (PROFILE_KEY[source], F.when(has_profile, pid) if resource == "messages" else pid)
    order = [("shopify_customer_id", p["external_id"]), ("phone", phone), ("email", email)]
    order = [named, *order] if resource == "messages" else [*order, named]
    return rows.select(
        "tenant_id", "source", "external_id", "seq", pid.alias("profile_id"), parse_time(seen).alias("seen_at"),
        _candidates(*order).alias("keys"), phone.alias("phone"), email.alias("email"), has_profile.alias("has_profile"),
        (has_profile | F.lit(resource == "consent" or source == "interakt")).alias("linkable"),
        F.lit(resource == "messages").alias("profile_first"),
    )


def link_profiles(found: DataFrame, identities: DataFrame, canonical: DataFrame | None = None) -> DataFrame:
    """Customer of each record: an existing one, or one to be minted.

    A record is found by its strongest key that is known: to the identity table,
    or from an earlier record, which claimed phone, e-mail and profile id for
    its own customer. So every record points to an existing customer, to an
    earlier record, or to nothing, and chains of pointers are followed to their
    end. A record pointing to nothing mints a customer under its profile id.

    Adds `customer_id` (null when minted), `minted_external_id` and
    `minted_source`. `canonical` maps merged customers to live ones. Records that are not
    linkable get neither a customer nor a minted one, and claim nothing.
    """
    found = settle(found)  # parsed once; the steps below read it many times
    if "linkable" in found.columns:
        nobody = found.where("not linkable").select(
            "*", F.lit(None).cast("long").alias("customer_id"), F.lit(None).cast("string").alias("minted_external_id"),
            F.lit(None).cast("string").alias("minted_source")).drop("linkable")
        return link_profiles(found.where("linkable").drop("linkable"), identities, canonical).unionByName(nobody)
    at = ["tenant_id", "seq"]
    handle = ["tenant_id", "identity_type", "identity_value"]
    keys = found.select(*at, F.explode("keys").alias("k")).select(*at, "k.*").where(F.col("identity_value").isNotNull())
    claiming = keys
    if "profile_first" in found.columns:
        # A message whose profile is known already is not looked up further, and its other handles are not taken in.
        first = found.where("profile_first").select(*at)
        own = keys.where(F.col("identity_type").isin(*PROFILE_KEY.values())).join(first, at)
        seen_first = own.groupBy(*handle).agg(F.min("seq").alias("opened"))
        known = own.join(seen_first, handle).join(identities.select(*handle, F.lit(True).alias("stored")).distinct(), handle, "left")
        claiming = keys.join(known.where("stored or opened < seq").select(*at), at, "left_anti")
    claimed = (
        claiming.where(F.col("identity_type") != "shopify_customer_id")
        .groupBy(*handle).agg(F.min("seq").alias("first_seq"))
    )
    owned = (
        keys.join(identities.select(*handle, "customer_id"), handle, "left").join(claimed, handle, "left")
        .withColumn("earlier", F.when(F.col("first_seq") < F.col("seq"), F.col("first_seq")))
        .where(F.col("customer_id").isNotNull() | F.col("earlier").isNotNull())
        .groupBy(*at).agg(F.min(F.struct("rank", "customer_id", "earlier")).alias("o"))
    )
    step = found.select(*at, "profile_id", "source").join(owned, at, "left").select(
        *at, "profile_id", "source", F.col("o.customer_id").alias("owner"),
        F.when(F.col("o.customer_id").isNull(), F.col("o.earlier")).alias("parent"),
    )
    ends = follow_pointers(step, "seq", "parent")
    tips = step.select("tenant_id", F.col("seq").alias("root"), F.col("owner").alias("customer_id"),
                       F.col("profile_id").alias("tip_profile"), F.col("source").alias("tip_source"))
    linked = ends.join(tips, ["tenant_id", "root"]).drop("root")
    if canonical is not None:
        linked = linked.join(canonical.select("tenant_id", "customer_id", "canonical_id"), ["tenant_id", "customer_id"], "left")
        linked = linked.withColumn("customer_id", F.coalesce("canonical_id", "customer_id")).drop("canonical_id")
    minted = F.col("customer_id").isNull()
    return found.join(linked, at).select(
        *found.columns, "customer_id",
        F.when(minted, F.col("tip_profile")).alias("minted_external_id"),
        F.when(minted, F.col("tip_source")).alias("minted_source"),
    )


def minted_customers(linked: DataFrame) -> DataFrame:
    """Customers to create, dated by the first record of each."""
    return (
        linked.where(F.col("customer_id").isNull() & F.col("minted_external_id").isNotNull())
        .groupBy("tenant_id", F.col("minted_source").alias("source"), F.col("minted_external_id").alias("external_id"))
        .agg(F.min_by("seen_at", "seq").alias("created_at"))
    )


def profile_handles(linked: DataFrame, source: str) -> DataFrame:
    """Handles the linked profiles bring along, in arrival order, ready for `claim_handles`."""
    keys = F.explode(F.filter("keys", lambda k: (k["identity_type"] != "shopify_customer_id") & k["identity_value"].isNotNull()))
    return linked.where(F.col("customer_id").isNotNull()).select(
        "tenant_id", "customer_id", F.col("seq").alias("order"), keys.alias("k")
    ).select("tenant_id", "customer_id", "order", "k.identity_type", "k.identity_value", F.lit(source).alias("source"))


def fill_pii(pii: DataFrame, linked: DataFrame) -> DataFrame:
    """Contact data with gaps filled from profiles; what a shop customer has stays."""
    gaps = linked.where(F.col("customer_id").isNotNull()).groupBy("tenant_id", "customer_id").agg(
        F.min_by("email", F.when(F.col("email").isNotNull(), F.col("seq"))).alias("e"),
        F.min_by("phone", F.when(F.col("phone").isNotNull(), F.col("seq"))).alias("p"),
    ).where(F.coalesce("e", "p").isNotNull())
    return pii.join(gaps, ["tenant_id", "customer_id"], "full").withColumns({
        "primary_email": F.coalesce("primary_email", "e"), "primary_phone": F.coalesce("primary_phone", "p"),
    }).select(*pii.columns)


# ------------------------------------------------------------------ consent


def map_consent(raw: DataFrame, source: str, links: DataFrame, ledger: DataFrame) -> DataFrame:
    """Ledger rows to append; `links` gives the customer of each record by tenant_id, external_id."""
    p = F.col("p")
    rows = parsed(raw, source, "consent", CONSENT).select(
        *KEY, "seq", F.coalesce(p["channel"], F.lit(CHANNEL[source])).alias("channel"),
        F.coalesce(p["action"], F.lit("granted")).alias("action"), p["method"].alias("method"),
        parse_time(p["occurred_at"]).alias("occurred_at"),
    )
    first = rows.groupBy(*KEY).agg(
        F.min_by(F.struct("seq", "channel", "action", "method", "occurred_at"), "seq").alias("r")
    ).select(*KEY, "r.*")
    return first.join(ledger.select(*KEY), KEY, "left_anti").join(
        links.select("tenant_id", "external_id", "customer_id"), ["tenant_id", "external_id"], "left"
    )


def consent_flags(ledger: DataFrame) -> DataFrame:
    """Current opt-in state per customer: the last action per channel, over all sources.

    A channel without any action stays null, which leaves the customer's flag alone.
    """
    def last(channel: str) -> Column:
        mine = F.when(F.col("channel") == channel, F.struct("occurred_at", "consent_id"))
        return F.max_by(F.col("action") == "granted", mine)

    return ledger.groupBy("tenant_id", "customer_id").agg(
        *[last(channel).alias(flag) for channel, flag in FLAG_CHANNELS.items()]
    )


def apply_flags(customers: DataFrame, flags: DataFrame) -> DataFrame:
    new = flags.select("tenant_id", "customer_id", *[F.col(f).alias(f"__{f}") for f in FLAG_CHANNELS.values()])
    return customers.join(new, ["tenant_id", "customer_id"], "left").withColumns(
        {f: F.coalesce(f"__{f}", f) for f in FLAG_CHANNELS.values()}
    ).select(*customers.columns)


# ------------------------------------------------------------------ messages


def map_messages(raw: DataFrame, source: str, links: DataFrame, campaigns: DataFrame) -> DataFrame:
    """One row per message and recipient, in one funnel vocabulary for all channels.

    An e-mail without a profile stays without a customer; a WhatsApp message
    always has one. WhatsApp opt-outs arrive as consent, never as unsubscribes.
    `links` gives customers by tenant_id, external_id; `campaigns` campaign ids
    by tenant_id, external_id.
    """
    p = F.col("p")
    whatsapp = source == "interakt"
    time = lambda *c: parse_time(filled(*c))
    rows = latest(parsed(raw, source, "messages", MESSAGE)).select(
        *KEY, p["campaign_id"].alias("campaign_ext"),
        (F.lit(whatsapp) | filled(p["profile"]["id"], p["profile_id"]).isNotNull()).alias("linkable"),
        F.coalesce(p["channel"], F.lit(CHANNEL[source])).alias("channel"),
        time(p["sent_at"]).alias("sent_at"), time(p["delivered_at"]).alias("delivered_at"),
        (time(p["read_at"], p["opened_at"]) if whatsapp else time(p["opened_at"])).alias("opened_at"),
        time(p["clicked_at"]).alias("clicked_at"),
        (time(p["failed_at"], p["bounced_at"]) if whatsapp else time(p["bounced_at"])).alias("bounced_at"),
        (F.lit(None).cast("timestamp_ntz") if whatsapp else time(p["unsubscribed_at"])).alias("unsubscribed_at"),
    )
    known = campaigns.select("tenant_id", F.col("external_id").alias("campaign_ext"), "campaign_id")
    return (
        rows.join(known, ["tenant_id", "campaign_ext"], "left")
        .join(links.select("tenant_id", "external_id", "customer_id"), ["tenant_id", "external_id"], "left")
        .withColumn("customer_id", F.when(F.col("linkable"), F.col("customer_id")))
        .drop("campaign_ext", "linkable")
    )


# ------------------------------------------------------------------ voice


def find_customers(rows: DataFrame, identities: DataFrame, canonical: DataFrame | None = None) -> DataFrame:
    """Add the customer of the strongest known key in `keys`; nobody is ever minted."""
    at = ["tenant_id", "external_id"]
    hits = (
        rows.select(*at, F.explode("keys").alias("k")).select(*at, "k.*").where(F.col("identity_value").isNotNull())
        .join(identities.select("tenant_id", "identity_type", "identity_value", "customer_id"),
              ["tenant_id", "identity_type", "identity_value"])
        .groupBy(*at).agg(F.min_by("customer_id", "rank").alias("customer_id"))
    )
    if canonical is not None:
        hits = hits.join(canonical.select("tenant_id", "customer_id", "canonical_id"), ["tenant_id", "customer_id"], "left")
        hits = hits.select(*at, F.coalesce("canonical_id", "customer_id").alias("customer_id"))
    return rows.join(hits, at, "left").drop("keys")


def _order_of(rows: DataFrame, orders: DataFrame) -> DataFrame:
    look = orders.select("tenant_id", F.col("external_id").alias("order_ext"), "order_id")
    return rows.join(look, ["tenant_id", "order_ext"], "left").drop("order_ext")


def map_tickets(
    raw: DataFrame, identities: DataFrame, orders: DataFrame, canonical: DataFrame | None = None
) -> DataFrame:
    p = F.col("p")
    rows = latest(parsed(raw, "gorgias", "tickets", TICKET)).select(
        *KEY, p["order_external_id"].alias("order_ext"),
        _candidates(("shopify_customer_id", p["customer"]["external_id"]), ("phone", normalize_phone(p["phone"])),
                    ("email", normalize_email(p["email"]))).alias("keys"),
        F.coalesce(p["channel"], F.lit("email")).alias("channel"), p["subject"].alias("subject"),
        p["category"].alias("category"), F.coalesce(p["status"], F.lit("open")).alias("status"),
        parse_time(filled(p["opened_at"], p["created_datetime"])).alias("opened_at"),
        parse_time(p["first_response_at"]).alias("first_response_at"),
        parse_time(filled(p["resolved_at"], p["closed_datetime"])).alias("resolved_at"),
        p["csat"].try_cast("int").alias("csat"),
    )
    return _order_of(find_customers(rows, identities, canonical), orders)


def map_reviews(
    raw: DataFrame, identities: DataFrame, orders: DataFrame, products: DataFrame, canonical: DataFrame | None = None
) -> DataFrame:
    """Reviews; `verified` is a flag, or the word buyer."""
    p = F.col("p")
    rows = latest(parsed(raw, "judgeme", "reviews", REVIEW)).select(
        *KEY, p["order_external_id"].alias("order_ext"), p["product_external_id"].alias("product_ext"),
        _candidates(("shopify_customer_id", p["reviewer"]["external_id"]), ("phone", normalize_phone(p["reviewer"]["phone"])),
                    ("email", normalize_email(p["reviewer"]["email"]))).alias("keys"),
        F.coalesce(p["rating"].try_cast("int"), F.lit(0)).alias("rating"), p["title"].alias("title"), p["body"].alias("body"),
        F.coalesce(F.lower(p["verified"]).isin("true", "buyer"), F.lit(True)).alias("verified"),
        parse_time(filled(p["submitted_at"], p["created_at"])).alias("submitted_at"),
    )
    look = products.select("tenant_id", F.col("external_id").alias("product_ext"), "product_id")
    linked = find_customers(rows, identities, canonical).join(look, ["tenant_id", "product_ext"], "left").drop("product_ext")
    return _order_of(linked, orders)


def link_nps(nps: DataFrame, customers: DataFrame, canonical: DataFrame) -> DataFrame:
    """Fill an empty customer by its shop id, following merges; rows that have one stay."""
    live = customers.where("source = 'shopify'").join(canonical, ["tenant_id", "customer_id"]).select(
        "tenant_id", F.col("external_id").alias("customer_external_id"), F.col("canonical_id").alias("__found")
    )
    return nps.join(live, ["tenant_id", "customer_external_id"], "left").withColumn(
        "customer_id", F.coalesce("customer_id", "__found")
    ).select(*nps.columns)
