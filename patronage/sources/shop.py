"""Shop, payment and courier payloads to typed rows.

Each mapper takes landed records (`tenant_id source resource external_id seq
payload`) and lookups from external to internal ids. The whole-paise spelling
of a field wins over the public-API one. Rows stay keyed by external id;
`landing.upsert` merges them and `landing.assign_ids` numbers them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from patronage.functions import money, normalize_email, normalize_phone, parse_time, to_paise

KEY = ["tenant_id", "source", "external_id"]

# Words that mark a gateway as cash on delivery, refund types,
# and the courier's spellings of a shipment status.
COD_MARKERS = ("cod", "cash on delivery", "cash_on_delivery")
REFUND_TYPES = ("return", "rto", "goodwill", "payment_failure")
SHIP_STATUS = {
    "PICKUP SCHEDULED": "pending",
    "PICKUP_SCHEDULED": "pending",
    "PENDING": "pending",
    "IN TRANSIT": "in_transit",
    "IN_TRANSIT": "in_transit",
    "DELIVERED": "delivered",
    "RTO INITIATED": "rto_initiated",
    "RTO_INITIATED": "rto_initiated",
    "RTO DELIVERED": "rto_received",
    "RTO_DELIVERED": "rto_received",
    "RTO RECEIVED": "rto_received",
    "RTO_RECEIVED": "rto_received",
    "LOST": "lost",
}

CUSTOMER = "id string, email string, phone string, first_name string, last_name string, " \
           "accepts_marketing string, created_at string"
PRODUCT = (
    "id string, title string, product_type string, vendor string, status string, created_at string, "
    "variants array<struct<id string, external_id string, sku string, title string, price string, price_paise string, "
    "compare_at_price string, compare_at_price_paise string, cost string, cost_paise string>>"
)
ORDER = (
    "id string, name string, order_number string, created_at string, cancelled_at string, financial_status string, "
    "fulfillment_status string, currency string, cod string, gateway string, payment_gateway string, "
    "payment_gateway_names array<string>, subtotal_price string, subtotal_paise string, total_discounts string, "
    "discount_paise string, total_tax string, tax_paise string, total_price string, total_paise string, "
    "shipping_paise string, total_shipping_price string, "
    "total_shipping_price_set struct<shop_money: struct<amount: string>>, "
    f"customer struct<{CUSTOMER.replace(' string', ': string')}>, discount_codes array<string>, "
    "fulfillments array<struct<created_at: string>>, "
    "line_items array<struct<product_id: string, product_external_id: string, variant_id: string, "
    "variant_external_id: string, sku: string, title: string, quantity: string, price: string, "
    "unit_price_paise: string, total_discount: string, discount_paise: string>>, "
    "refunds array<struct<id: string, created_at: string, processed_at: string, refund_type: string, note: string, "
    "amount_paise: string, transactions: array<struct<amount: string, gateway: string>>>>"
)
PAYMENT = (
    "id string, amount string, amount_paise string, status string, method string, currency string, "
    "error_description string, failure_reason string, created_at string, order_external_id string, "
    "notes struct<shopify_order_id: string>"
)
SHIPMENT = (
    "id string, order_id string, order_external_id string, courier string, status string, rto string, "
    "shipped_at string, shipped_date string, delivered_at string, delivered_date string, rto_at string, "
    "rto_delivered_date string"
)


def filled(*columns: Column) -> Column:
    """First of the texts that is neither null nor empty."""
    return F.coalesce(*[F.when(c != "", c) for c in columns])


def parsed(raw: DataFrame, source: str, resource: str, schema: str) -> DataFrame:
    return raw.where((F.col("source") == source) & (F.col("resource") == resource)).select(
        *KEY, "seq", F.from_json("payload", schema).alias("p")
    )


def latest(rows: DataFrame, keys: list[str] = KEY) -> DataFrame:
    """Last payload of each key wins.

    The newest of structs is found by sorting, in a first step inside the task that made the rows. So they are dealt out before, by key and
    sequence: a task then sorts a partition of bounded size, however many rows a small file unfolds into, and a key sent very often is spread.
    """
    rest = [c for c in rows.columns if c not in keys]
    return rows.repartition(*keys, "seq").groupBy(*keys).agg(F.max_by(F.struct(*rest), F.col("seq")).alias("r")).select(*keys, "r.*")


# ------------------------------------------------------------------ customers


def customer_records(raw: DataFrame) -> DataFrame:
    """Customer objects, whole ones and those embedded in orders, in landing order."""
    def fields(p: Column) -> list[Column]:
        return [
            F.lower(p["accepts_marketing"]).eqNullSafe("true").alias("accepts"),
            p["accepts_marketing"].isNotNull().alias("says_marketing"),
            parse_time(p["created_at"]).alias("created_at"),
            normalize_email(p["email"]).alias("primary_email"), normalize_phone(p["phone"]).alias("primary_phone"),
            filled(p["first_name"]).alias("first_name"), filled(p["last_name"]).alias("last_name"),
        ]

    whole = parsed(raw, "shopify", "customers", CUSTOMER)
    inside = parsed(raw, "shopify", "orders", ORDER).where(F.col("p.customer.id").isNotNull())
    return whole.select(*KEY, F.lit(0).alias("pass"), "seq", *fields(F.col("p"))).unionByName(
        inside.select(
            "tenant_id", "source", F.col("p.customer.id").alias("external_id"), F.lit(1).alias("pass"), "seq",
            *fields(F.col("p.customer")),
        )
    )


def map_customers(raw: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(customers, contact data, handles) keyed by external id.

    Customers sync before orders. The last value given wins per field; a field a
    partial object does not carry leaves the earlier value alone.
    """
    records = customer_records(raw)

    def last(column: str, given: Column | None = None) -> Column:
        given = F.col(column).isNotNull() if given is None else given
        return F.max_by(F.when(given, F.col(column)), F.when(given, F.struct("pass", "seq"))).alias(column)

    merged = records.groupBy(*KEY).agg(
        last("accepts", F.col("says_marketing")), last("created_at"), last("primary_email"), last("primary_phone"),
        last("first_name"), last("last_name"),
    )
    customers = merged.select(
        *KEY, F.coalesce("accepts", F.lit(False)).alias("accepts_email_marketing"), "created_at"
    )
    contact = ["primary_email", "primary_phone", "first_name", "last_name"]
    pii = merged.select(*KEY, *contact).where(F.coalesce(*contact).isNotNull())
    handle = lambda kind, value: F.struct(F.lit(kind).alias("identity_type"), value.alias("identity_value"))
    handles = (
        records.select(*KEY, "pass", "seq", F.explode(F.array(
            handle("shopify_customer_id", F.col("external_id")), handle("phone", F.col("primary_phone")),
            handle("email", F.col("primary_email")),
        )).alias("h"))
        .select(*KEY, "pass", "seq", "h.*").where(F.col("identity_value").isNotNull())
    )
    return customers, pii, handles


# ------------------------------------------------------------------ catalogue


def map_catalog(raw: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(products, variants); a variant goes by `id`, or by `external_id` where seeded so."""
    rows = latest(parsed(raw, "shopify", "products", PRODUCT))
    p = F.col("p")
    products = rows.select(
        *KEY, F.coalesce(p["title"], F.lit("")).alias("title"), p["product_type"].alias("product_type"),
        p["vendor"].alias("vendor"), F.coalesce(p["status"], F.lit("active")).alias("status"),
    )
    v = F.col("v")

    def optional(paise: str, rupees: str) -> Column:
        return F.when(filled(v[paise], v[rupees]).isNotNull(), money(v[paise], v[rupees]))

    variants = rows.select("tenant_id", "source", F.col("external_id").alias("product_external_id"),
                           F.explode(p["variants"]).alias("v")).select(
        "tenant_id", "source", F.coalesce(v["id"], v["external_id"]).alias("external_id"), "product_external_id",
        v["sku"].alias("sku"), v["title"].alias("title"),
        money(v["price_paise"], v["price"]).alias("price_paise"),
        optional("compare_at_price_paise", "compare_at_price").alias("compare_at_price_paise"),
        optional("cost_paise", "cost").alias("cost_paise"),
    )
    return products, variants


# ------------------------------------------------------------------ orders


def _is_cod(p: Column) -> Column:
    names = F.concat(
        F.coalesce(p["payment_gateway_names"], F.array().cast("array<string>")),
        F.array_compact(F.array(filled(p["gateway"]), filled(p["payment_gateway"]))),
    )
    marked = F.exists(names, lambda n: n.isNotNull() & F.lower(n).rlike("|".join(COD_MARKERS)))
    return F.when(p["cod"].isNotNull(), F.lower(p["cod"]) == "true").otherwise(marked)


def _code(text: Column) -> Column:
    """A discount code that is plain text, or an object with a `code`."""
    return F.when(text.startswith("{"), F.coalesce(F.get_json_object(text, "$.code"), F.lit(""))).otherwise(text)


def map_orders(raw: DataFrame, customers: DataFrame) -> DataFrame:
    """Order headers. `customers` looks up tenant_id, external_id -> customer_id; none means guest."""
    p = F.col("p")
    codes = F.array_join(F.transform(F.coalesce(p["discount_codes"], F.array().cast("array<string>")), _code), ",")
    names = F.when(F.size(p["payment_gateway_names"]) > 0, F.get(p["payment_gateway_names"], F.lit(0)))
    shipping = F.coalesce(
        p["shipping_paise"].cast("long"),
        to_paise(filled(p["total_shipping_price"], p["total_shipping_price_set"]["shop_money"]["amount"])),
    )
    rows = latest(parsed(raw, "shopify", "orders", ORDER)).select(
        *KEY, p["customer"]["id"].alias("customer_external_id"),
        F.coalesce(filled(p["name"], p["order_number"]), F.lit("")).alias("order_number"),
        parse_time(p["created_at"]).alias("placed_at"), parse_time(p["cancelled_at"]).alias("cancelled_at"),
        parse_time(F.get(p["fulfillments"], F.lit(0))["created_at"]).alias("fulfilled_at"),
        F.coalesce(filled(p["financial_status"]), F.lit("pending")).alias("financial_status"),
        F.coalesce(filled(p["fulfillment_status"]), F.lit("unfulfilled")).alias("fulfillment_status"),
        _is_cod(p).alias("cod"),
        F.coalesce(names, filled(p["gateway"], p["payment_gateway"])).alias("payment_gateway"),
        money(p["subtotal_paise"], p["subtotal_price"]).alias("subtotal_paise"),
        money(p["discount_paise"], p["total_discounts"]).alias("discount_paise"),
        shipping.alias("shipping_paise"), money(p["tax_paise"], p["total_tax"]).alias("tax_paise"),
        money(p["total_paise"], p["total_price"]).alias("total_paise"),
        F.coalesce(p["currency"], F.lit("INR")).alias("currency"), filled(codes).alias("discount_codes"),
    )
    known = customers.select("tenant_id", F.col("external_id").alias("customer_external_id"), "customer_id")
    return rows.join(known, ["tenant_id", "customer_external_id"], "left").drop("customer_external_id")


def keep_attached(current: DataFrame, mapped: DataFrame) -> DataFrame:
    """A guest payload sent again must not drop the customer resolution has found."""
    had = current.select(*KEY, F.col("customer_id").alias("__had"))
    return mapped.join(had, KEY, "left").withColumn("customer_id", F.coalesce("customer_id", "__had")).drop("__had")


def map_order_items(raw: DataFrame, orders: DataFrame, products: DataFrame, variants: DataFrame) -> DataFrame:
    """Line items of the last payload of each order; the variant's cost is kept as it is now.

    Lookups: orders (tenant_id, external_id, order_id), products (.., product_id),
    variants (.., variant_id, cost_paise). A catalogue grows with tenants and parts and may look small to the
    planner, so neither it nor the orders go through the driver as a broadcast.
    """
    orders, products, variants = (lookup.hint("merge") for lookup in (orders, products, variants))
    i = F.col("i")
    lines = latest(parsed(raw, "shopify", "orders", ORDER)).select(
        "tenant_id", "external_id", F.posexplode("p.line_items").alias("line", "i")
    ).select(
        "tenant_id", "external_id", "line",
        F.coalesce(filled(i["product_id"]), i["product_external_id"]).alias("p_ext"),
        F.coalesce(filled(i["variant_id"]), i["variant_external_id"]).alias("v_ext"),
        i["sku"].alias("sku"), i["title"].alias("title"), F.coalesce(i["quantity"].cast("int"), F.lit(1)).alias("quantity"),
        money(i["unit_price_paise"], i["price"]).alias("unit_price_paise"),
        money(i["discount_paise"], i["total_discount"]).alias("discount_paise"),
    )
    return (
        lines.join(orders.select("tenant_id", "external_id", "order_id"), ["tenant_id", "external_id"])
        .join(products.select("tenant_id", F.col("external_id").alias("p_ext"), "product_id"), ["tenant_id", "p_ext"], "left")
        .join(variants.select("tenant_id", F.col("external_id").alias("v_ext"), "variant_id",
                              F.col("cost_paise").alias("unit_cost_paise")), ["tenant_id", "v_ext"], "left")
        .select("tenant_id", "order_id", "line", "product_id", "variant_id", "sku", "title", "quantity",
                "unit_price_paise", "discount_paise", "unit_cost_paise")
    )


def replace_items(current: DataFrame, mapped: DataFrame) -> DataFrame:
    """Items of a re-sent order are replaced as a whole."""
    sent = mapped.select("tenant_id", "order_id").distinct()
    return current.join(sent, ["tenant_id", "order_id"], "left_anti").unionByName(mapped)


def map_refunds(raw: DataFrame, orders: DataFrame) -> DataFrame:
    """Refunds inside orders: given paise, or the transactions added up; an unknown hint is a return.

    `orders` looks up tenant_id, external_id -> order_id, customer_id.
    """
    r = F.col("r")
    hint = F.lower(F.trim(F.coalesce(filled(r["refund_type"], r["note"]), F.lit(""))))
    paid = F.aggregate(
        F.coalesce(r["transactions"], F.array().cast("array<struct<amount:string,gateway:string>>")),
        F.lit(0).cast("long"), lambda total, t: total + to_paise(t["amount"]),
    )
    rows = latest(parsed(raw, "shopify", "orders", ORDER)).select(
        "tenant_id", "source", F.col("external_id").alias("order_ext"), "seq", F.col("p.currency").alias("cur"),
        F.explode("p.refunds").alias("r"),
    ).select(
        "tenant_id", "source", r["id"].alias("external_id"), "seq", "order_ext",
        F.coalesce(r["amount_paise"].cast("long"), paid).alias("amount_paise"),
        F.coalesce("cur", F.lit("INR")).alias("currency"),
        F.when(hint.isin(*REFUND_TYPES), hint).otherwise("return").alias("refund_type"),
        parse_time(filled(r["processed_at"], r["created_at"])).alias("processed_at"),
        F.get(r["transactions"], F.lit(0))["gateway"].alias("gateway"),
    )
    look = orders.select("tenant_id", F.col("external_id").alias("order_ext"), "order_id", "customer_id")
    return latest(rows).join(look, ["tenant_id", "order_ext"]).drop("order_ext", "seq")


# ------------------------------------------------------------------ payments, shipments


def map_payments(raw: DataFrame, orders: DataFrame) -> DataFrame:
    """Payments; one whose order is unknown stays without."""
    p = F.col("p")
    rows = latest(parsed(raw, "razorpay", "payments", PAYMENT)).select(
        *KEY, F.coalesce(filled(p["order_external_id"]), p["notes"]["shopify_order_id"]).alias("order_ext"),
        F.coalesce(p["method"], F.lit("upi")).alias("method"), F.lit("razorpay").alias("gateway"),
        F.coalesce(p["status"], F.lit("created")).alias("status"),
        F.coalesce(p["amount_paise"], p["amount"], F.lit("0")).cast("long").alias("amount_paise"),
        F.coalesce(p["currency"], F.lit("INR")).alias("currency"),
        filled(p["failure_reason"], p["error_description"]).alias("failure_reason"),
        parse_time(p["created_at"]).alias("occurred_at"),
    )
    look = orders.select("tenant_id", F.col("external_id").alias("order_ext"), "order_id")
    return rows.join(look, ["tenant_id", "order_ext"], "left").drop("order_ext")


def map_shipments(raw: DataFrame, orders: DataFrame) -> DataFrame:
    """Shipments of known orders; orphans are dropped. An unknown status word means pending."""
    p = F.col("p")
    words = F.create_map(*[F.lit(x) for pair in SHIP_STATUS.items() for x in pair])
    status = F.coalesce(words[F.upper(p["status"])], F.lit("pending"))
    rows = latest(parsed(raw, "shiprocket", "shipments", SHIPMENT)).select(
        *KEY, F.coalesce(filled(p["order_external_id"]), p["order_id"]).alias("order_ext"), p["courier"].alias("courier"),
        status.alias("status"), (F.lower(p["rto"]).eqNullSafe("true") | status.startswith("rto")).alias("rto"),
        parse_time(filled(p["shipped_at"], p["shipped_date"])).alias("shipped_at"),
        parse_time(filled(p["delivered_at"], p["delivered_date"])).alias("delivered_at"),
        parse_time(filled(p["rto_at"], p["rto_delivered_date"])).alias("rto_at"), "seq",
    )
    look = orders.select("tenant_id", F.col("external_id").alias("order_ext"), "order_id")
    return rows.join(look, ["tenant_id", "order_ext"]).drop("order_ext")


def order_fulfilment(orders: DataFrame, shipments: DataFrame) -> DataFrame:
    """Orders with what their shipments say; `seq` orders the shipments of one order.

    The first known shipping time fills an empty `fulfilled_at`; the last
    delivery or return decides the status.
    """
    done = F.when(F.col("status") == "delivered", "delivered").when(F.col("rto"), "rto")
    moved = shipments.groupBy("tenant_id", "order_id").agg(
        F.min_by("shipped_at", F.when(F.col("shipped_at").isNotNull(), F.col("seq"))).alias("first_ship"),
        F.max_by(done, F.when(done.isNotNull(), F.col("seq"))).alias("ended"),
        F.max_by("delivered_at", F.when(
            (F.col("status") == "delivered") & F.col("delivered_at").isNotNull(), F.col("seq"))).alias("arrived"),
    )
    return (
        orders.join(moved, ["tenant_id", "order_id"], "left")
        .withColumns({
            "fulfilled_at": F.coalesce("fulfilled_at", "first_ship"),
            "delivered_at": F.coalesce("arrived", "delivered_at"),
            "fulfillment_status": F.coalesce("ended", "fulfillment_status"),
        })
        .drop("first_ship", "ended", "arrived")
    )
