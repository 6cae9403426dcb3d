"""The engine's tables, derived from the retail tables in one folder.

The folder holds `region nation customer part orders lineitem events` as
Parquet. Every tenant is a region, and every expression here is plain
arithmetic on keys, so that a second engine can derive the same rows.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from patronage.functions import normalize_email, normalize_phone
from patronage.operators.orders import customer_stats, order_index
from patronage.session import configure

EPOCH = "timestamp_ntz'1995-01-01 00:00:00'"


class Tables:
    """Canonical core, dimension and fact tables over one data folder."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark = configure(spark)
        self.path = path.rstrip("/")

    def read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/{name}.parquet")

    # ------------------------------------------------------------ tenants, people

    @cached_property
    def tenants(self) -> DataFrame:
        return self.read("region").selectExpr(
            "cast(r_regionkey + 1 as bigint) as tenant_id",
            "lower(r_name) as slug",
            "r_name as name",
        )

    @cached_property
    def _people(self) -> DataFrame:
        """Customer key and tenant; nation has one row per country."""
        nation = self.read("nation").selectExpr(
            "n_nationkey", "cast(n_regionkey + 1 as bigint) as tenant_id"
        )
        return (
            self.read("customer")
            .join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
            .select("tenant_id", F.col("c_custkey").alias("customer_id"))
        )

    @cached_property
    def customers(self) -> DataFrame:
        return self._people.selectExpr(
            "tenant_id",
            "customer_id",
            "'shopify' as source",
            "concat('C', customer_id) as external_id",
            "timestampadd(DAY, cast(customer_id % 700 as int), timestamp_ntz'1994-06-01 00:00:00') as created_at",
            "customer_id % 3 = 0 as accepts_email_marketing",
            "customer_id % 4 = 0 as whatsapp_opted_in",
            "customer_id % 9 = 0 as sms_opted_in",
            "cast(null as bigint) as merged_into_customer_id",
        )

    @cached_property
    def customer_pii(self) -> DataFrame:
        tail = "lpad(cast(customer_id % 1450 as string), 9, '0')"
        return self._people.selectExpr(
            "tenant_id",
            "customer_id",
            "case when customer_id % 37 = 0 then null "
            "when customer_id % 43 = 0 then 'not-an-email' "
            "else concat(' User', customer_id % 1400, '@Example.com ') end as primary_email",
            f"case when customer_id % 41 = 0 then null when customer_id % 4 = 0 then concat('9', {tail}) "
            f"when customer_id % 4 = 1 then concat('09', {tail}) "
            f"when customer_id % 4 = 2 then concat('+91 9', substr({tail}, 1, 4), '-', substr({tail}, 5)) "
            f"else concat('0091 9', {tail}) end as primary_phone",
            "case when customer_id % 5 = 0 then null else concat('First', customer_id) end as first_name",
            "case when customer_id % 7 = 0 then null else concat('Last', customer_id) end as last_name",
        )

    @cached_property
    def clean_pii(self) -> DataFrame:
        """Contact data as the mappers store it."""
        return self.customer_pii.withColumns({
            "primary_email": normalize_email(F.col("primary_email")),
            "primary_phone": normalize_phone(F.col("primary_phone")),
        })

    # ------------------------------------------------------------ orders and items

    @cached_property
    def order_headers(self) -> DataFrame:
        """Orders without the amounts that need their line items."""
        return (
            self.read("orders")
            .join(self._people, F.col("o_custkey") == F.col("customer_id"))
            .selectExpr(
                "tenant_id",
                "o_orderkey as order_id",
                "case when o_orderkey % 17 = 0 then null else o_custkey end as customer_id",
                "o_custkey as buyer_id",
                "timestampadd(SECOND, cast(o_orderkey % 86400 as int), o_orderdate) as placed_at",
                "o_orderkey % 50 = 0 as cancelled",
                "substr(o_orderpriority, 1, 1) in ('4', '5') as cod",
                "case o_orderstatus when 'F' then 'paid' when 'O' then 'pending' "
                "else 'partially_refunded' end as financial_status",
                "cast(round(o_totalprice * 100) as bigint) as total_paise",
                "o_orderkey",
            )
            .selectExpr(
                "tenant_id",
                "order_id",
                "customer_id",
                "buyer_id",
                "placed_at",
                "case when cancelled then timestampadd(DAY, 1, placed_at) end as cancelled_at",
                "financial_status",
                "cod",
                "total_paise",
                "(order_id % 5) * 1000 as shipping_paise",
                "cast(null as int) as customer_order_index",
            )
        )

    @cached_property
    def indexed_orders(self) -> DataFrame:
        """Order headers with the stored index filled in."""
        return order_index(self.order_headers)

    @cached_property
    def line_totals(self) -> DataFrame:
        return (
            self.read("lineitem")
            .selectExpr(
                "l_orderkey as order_id",
                "cast(round(l_extendedprice * 100) as bigint) as gross",
                "cast(round(l_extendedprice * l_discount * 100) as bigint) as off",
                "cast(round(l_extendedprice * l_tax * 100) as bigint) as tax",
            )
            .groupBy("order_id")
            .agg(F.sum("gross").alias("gross"), F.sum("off").alias("off"), F.sum("tax").alias("tax"))
        )

    @cached_property
    def fact_orders(self) -> DataFrame:
        return (
            self.order_headers.join(self.line_totals, "order_id", "left")
            .selectExpr(
                "tenant_id",
                "order_id",
                "customer_id",
                "placed_at",
                "cancelled_at",
                "case when order_id % 9 = 0 or order_id % 50 = 0 then null "
                "else timestampadd(DAY, cast(order_id % 3 + 1 as int), placed_at) end as fulfilled_at",
                "cast(null as timestamp_ntz) as delivered_at",
                "financial_status",
                "case when order_id % 9 = 0 or order_id % 50 = 0 then 'unfulfilled' "
                "else 'fulfilled' end as fulfillment_status",
                "cod",
                "coalesce(gross, 0) as subtotal_paise",
                "case when order_id % 25 = 0 then (coalesce(gross, 0) * 2) div 5 "
                "else coalesce(off, 0) end as discount_paise",
                "shipping_paise",
                "coalesce(tax, 0) as tax_paise",
                "total_paise",
                "customer_order_index",
                "case when order_id % 25 = 0 then 'BIG40' when order_id % 6 = 0 then 'HELLO,SAVE' end "
                "as discount_codes",
            )
        )

    @cached_property
    def fact_order_items(self) -> DataFrame:
        items = self.read("lineitem").selectExpr(
            "l_orderkey as order_id",
            "l_orderkey * 10 + l_linenumber as order_item_id",
            "l_partkey as product_id",
            "l_partkey * 10 + l_suppkey % 2 as variant_id",
            "cast(l_quantity as int) as quantity",
            "case when l_suppkey % 40 = 0 then 0L "
            "else cast(round(l_extendedprice * 100 / l_quantity) as bigint) end as unit_price_paise",
            "cast(round(l_extendedprice * l_discount * 100) as bigint) as discount_paise",
        )
        return items.join(self.order_headers.select("tenant_id", "order_id"), "order_id").selectExpr(
            "tenant_id",
            "order_item_id",
            "order_id",
            "product_id",
            "variant_id",
            "concat('SKU-', variant_id) as sku",
            "quantity",
            "unit_price_paise",
            "discount_paise",
            "(variant_id % 900) * 100 as unit_cost_paise",
        )

    @cached_property
    def products(self) -> DataFrame:
        """One catalogue shared by all tenants: a row per tenant and part."""
        return self.read("part").selectExpr(
            "explode(sequence(1L, 5L)) as tenant_id",
            "p_partkey as product_id",
            "p_name as title",
            "case when p_partkey % 10 = 0 then null else p_type end as product_type",
            "p_brand as vendor",
            "case when p_size % 10 = 0 then 'archived' else 'active' end as status",
        )

    @cached_property
    def variants(self) -> DataFrame:
        return self.read("part").selectExpr(
            "explode(sequence(1L, 5L)) as tenant_id", "p_partkey", "p_retailprice"
        ).selectExpr(
            "tenant_id",
            "explode(sequence(0L, 1L)) as side",
            "p_partkey as product_id",
            "cast(round(p_retailprice * 100) as bigint) as price",
        ).selectExpr(
            "tenant_id",
            "product_id * 10 + side as variant_id",
            "product_id",
            "concat('SKU-', product_id * 10 + side) as sku",
            "price + side * 1000 as price_paise",
            "case when product_id % 4 = 0 then price + 5000 end as compare_at_price_paise",
            "((product_id * 10 + side) % 900) * 100 as cost_paise",
        )

    # ------------------------------------------------------------ logistics, money

    @cached_property
    def fact_shipments(self) -> DataFrame:
        shipped = self.order_headers.where("order_id % 50 <> 0 and order_id % 9 <> 0").selectExpr(
            "tenant_id",
            "order_id",
            "explode(if(order_id % 40 = 1, array(0, 1), array(0))) as leg",
            "cod and order_id % 5 = 0 as rto",
            "timestampadd(DAY, cast(order_id % 3 + 1 as int), placed_at) as first_ship",
        ).withColumn("shipped_at", F.expr("timestampadd(DAY, leg * 2, first_ship)"))
        return shipped.selectExpr(
            "tenant_id",
            "order_id * 2 + leg as shipment_id",
            "order_id",
            "case when rto then 'rto_received' when order_id % 11 = 0 then 'in_transit' "
            "else 'delivered' end as status",
            "rto",
            "shipped_at",
            "case when not rto and order_id % 11 <> 0 "
            "then timestampadd(DAY, cast(order_id % 8 + 2 as int), shipped_at) end as delivered_at",
            "case when rto and order_id % 7 <> 0 then timestampadd(DAY, 6, shipped_at) end as rto_at",
        )

    @cached_property
    def fact_payments(self) -> DataFrame:
        prepaid = self.order_headers.where("not cod")
        linked = prepaid.selectExpr(
            "tenant_id",
            "order_id",
            "total_paise",
            "placed_at",
            "explode(array_compact(array(if(order_id % 20 = 0, 1, null), "
            "if(order_id % 60 <> 0, 2, null)))) as step",
        ).selectExpr(
            "tenant_id",
            "order_id * 4 + step as payment_id",
            "order_id",
            "case order_id % 3 when 0 then 'upi' when 1 then 'card' else 'wallet' end as method",
            "if(step = 1, 'failed', 'captured') as status",
            "total_paise as amount_paise",
            "if(step = 1, 'bank_declined', null) as failure_reason",
            "timestampadd(MINUTE, if(step = 1, 1, 5), placed_at) as occurred_at",
        )
        loose = prepaid.where("order_id % 97 = 0").selectExpr(
            "tenant_id",
            "order_id * 4 + 3 as payment_id",
            "cast(null as bigint) as order_id",
            "'upi' as method",
            "'failed' as status",
            "total_paise div 2 as amount_paise",
            "'timeout' as failure_reason",
            "placed_at as occurred_at",
        )
        return linked.unionByName(loose)

    @cached_property
    def fact_refunds(self) -> DataFrame:
        return self.order_headers.where("order_id % 14 = 0").selectExpr(
            "tenant_id",
            "order_id * 3 as refund_id",
            "order_id",
            "customer_id",
            "total_paise div 2 as amount_paise",
            "case (order_id div 14) % 4 when 0 then 'return' when 1 then 'rto' "
            "when 2 then 'goodwill' else 'payment_failure' end as refund_type",
            "timestampadd(DAY, 20, placed_at) as processed_at",
        )

    # ------------------------------------------------------------ messaging, consent

    @cached_property
    def dim_campaigns(self) -> DataFrame:
        return self.tenants.selectExpr("tenant_id", "explode(sequence(0L, 11L)) as k").selectExpr(
            "tenant_id",
            "tenant_id * 100 + k as campaign_id",
            "concat('campaign-', tenant_id * 100 + k) as name",
            "case when k < 2 or (k = 2 and tenant_id <> 3) then 'flow' else 'campaign' end as campaign_type",
            "case k % 3 when 0 then 'email' when 1 then 'whatsapp' else 'sms' end as channel",
            f"timestampadd(DAY, cast(k as int), {EPOCH}) as started_at",
            "case when k < 3 then concat('KLF-0', k + 1) else concat('K-', tenant_id * 100 + k) end "
            "as external_id",
        )

    @cached_property
    def _touches(self) -> DataFrame:
        """Event rows with the customer and tenant behind the user."""
        return (
            self.read("events")
            .join(self._people, F.col("user_id") == F.col("customer_id"))
            .selectExpr(
                "tenant_id",
                "event_id",
                "customer_id",
                "event_type",
                "event_id % 12 as k",
                f"timestampadd(SECOND, cast((event_id % 2400) * 86400 + event_id % 86400 as int), {EPOCH}) "
                "as at",
            )
        )

    @cached_property
    def fact_messages(self) -> DataFrame:
        return self._touches.selectExpr(
            "tenant_id",
            "event_id as message_id",
            "case when event_id % 29 = 0 then null else tenant_id * 100 + k end as campaign_id",
            "case when event_id % 31 = 0 then null else customer_id end as customer_id",
            "case k % 3 when 0 then 'email' when 1 then 'whatsapp' else 'sms' end as channel",
            "at as sent_at",
            "case when event_type <> 'error' then timestampadd(MINUTE, 1, at) end as delivered_at",
            "case when event_type in ('view', 'click', 'purchase') then timestampadd(HOUR, 1, at) end "
            "as opened_at",
            "case when event_type = 'click' then timestampadd(HOUR, 2, at) end as clicked_at",
            "case when event_type = 'error' then timestampadd(MINUTE, 2, at) end as bounced_at",
            "case when event_type = 'signup' and event_id % 3 = 0 then timestampadd(DAY, 1, at) end "
            "as unsubscribed_at",
        )

    @cached_property
    def fact_consent(self) -> DataFrame:
        return self._touches.where(
            "event_type = 'signup' or (event_type = 'error' and event_id % 5 = 0)"
        ).selectExpr(
            "tenant_id",
            "event_id as consent_id",
            "customer_id",
            "case event_id % 3 when 0 then 'email' when 1 then 'whatsapp' else 'sms' end as channel",
            "case when event_type = 'signup' then 'granted' else 'revoked' end as action",
            "at as occurred_at",
        )

    # ------------------------------------------------------------ voice, experiments

    @cached_property
    def fact_tickets(self) -> DataFrame:
        return self.order_headers.where("order_id % 23 = 0").selectExpr(
            "tenant_id",
            "order_id * 5 as ticket_id",
            "customer_id",
            "order_id",
            "case order_id % 4 when 0 then 'email' when 1 then 'whatsapp' when 2 then 'chat' "
            "else 'phone' end as channel",
            "case (order_id div 23) % 5 when 0 then 'delivery_delay' when 1 then 'damaged' "
            "when 2 then 'refund_where' when 3 then 'quality' else 'other' end as category",
            "case when (order_id div 23) % 6 = 0 then 'open' else 'resolved' end as status",
            "timestampadd(DAY, 10, placed_at) as opened_at",
            "timestampadd(HOUR, 242, placed_at) as first_response_at",
            "case when (order_id div 23) % 6 = 0 then null else "
            "timestampadd(MINUTE, cast(14400 + (order_id % 120) * 60 + order_id % 60 as int), placed_at) "
            "end as resolved_at",
            "case when order_id % 3 = 0 then null else cast(1 + order_id % 5 as int) end as csat",
        )

    @cached_property
    def fact_reviews(self) -> DataFrame:
        return self.order_headers.where("order_id % 19 = 0").selectExpr(
            "tenant_id",
            "order_id * 7 as review_id",
            "customer_id",
            "order_id",
            "order_id % 1000 as product_id",
            "cast(1 + order_id % 5 as int) as rating",
            "order_id % 2 = 0 as verified",
            "timestampadd(DAY, 20, placed_at) as submitted_at",
        )

    @cached_property
    def fact_nps(self) -> DataFrame:
        return self._people.where("customer_id % 3 = 0").selectExpr(
            "tenant_id",
            "customer_id * 2 + 1 as nps_id",
            "case when customer_id % 13 = 0 then null else customer_id end as customer_id",
            "cast(customer_id % 11 as int) as score",
            "'email' as channel",
            "timestampadd(DAY, cast((customer_id * 7) % 2300 as int), timestamp_ntz'1995-03-01 12:00:00') "
            "as responded_at",
        )

    @cached_property
    def fact_experiments(self) -> DataFrame:
        return self.read("part").where("p_partkey % 10 = 0").selectExpr(
            "p_partkey div 10 as e", "p_size"
        ).selectExpr(
            "e % 5 + 1 as tenant_id",
            "e as experiment_id",
            "concat('exp-', e) as name",
            "case e % 3 when 0 then 'gravity' when 1 then 'flow' else 'pulse' end as score_target",
            "case e % 4 when 0 then 'draft' when 1 then 'running' else 'concluded' end as status",
            "case when e % 4 <> 0 then timestampadd(DAY, cast((e * 37) % 2390 as int), "
            f"{EPOCH}) end as started_at",
            "case when e % 4 >= 2 then timestampadd(DAY, cast((e * 37) % 2390 + p_size as int), "
            f"{EPOCH}) end as concluded_at",
            "case when e % 4 >= 2 then cast(500 + (e * 53) % 2000 as int) end as sample_size",
            "case when e % 4 >= 2 then cast(e % 21 - 6 as double) / 2 end as lift_pct",
            "case when e % 4 >= 2 and e % 7 <> 0 then e % 3 = 0 end as significant",
            "case when e % 4 < 2 or e % 9 = 0 then null when e % 3 = 0 then 'shipped' "
            "when e % 3 = 1 then 'killed' else 'inconclusive' end as decision",
        )

    @cached_property
    def experiments(self) -> DataFrame:
        """The system of record, with the free text the mirror leaves out."""
        return self.fact_experiments.withColumn(
            "hypothesis",
            F.expr("case when experiment_id % 8 = 3 then null else concat('because ', name) end"),
        )

    # ------------------------------------------------------------ derived dimension

    @cached_property
    def dim_customers(self) -> DataFrame:
        stats = customer_stats(self.order_headers)
        return (
            self.customers.where("merged_into_customer_id is null")
            .join(stats, ["tenant_id", "customer_id"], "left")
            .selectExpr(
                "tenant_id",
                "customer_id",
                "coalesce(lifecycle_stage, 'new') as lifecycle_stage",
                "first_order_at",
                "last_order_at",
                "coalesce(orders_count, 0) as orders_count",
                "coalesce(total_spent_paise, 0L) as total_spent_paise",
                "accepts_email_marketing",
                "whatsapp_opted_in",
                "sms_opted_in",
                "created_at",
            )
        )

    # ------------------------------------------------------------ ledgers

    @cached_property
    def score_runs(self) -> DataFrame:
        """A run ledger that grows with the order history: every month, nine scores."""
        names = ("gravity", "flow", "signal", "watertight", "vitals", "velocity",
                 "autopilot", "pulse", "altitude")
        listed = ", ".join(f"'{n}'" for n in names)
        monthly = (
            self.order_headers.groupBy("tenant_id", F.trunc(F.to_date("placed_at"), "MM").alias("m"))
            .agg(F.count(F.lit(1)).alias("n"))
            .where("(year(m) * 12 + month(m) + tenant_id) % 17 <> 0")
        )
        return monthly.selectExpr(
            "tenant_id", "m", "n", f"posexplode(array({listed})) as (i, score)"
        ).where("not (score = 'altitude' and tenant_id = 2)").selectExpr(
            "tenant_id",
            "(year(m) * 12 + month(m)) * 10L + i as run_id",
            "score",
            "cast((n * 7 + i * 13) % 101 as double) as value",
            "cast(timestampadd(DAY, 2, cast(m as timestamp_ntz)) as timestamp_ntz) as computed_at",
            "if(year(m) < 1998, 'v0.1', 'v2.0') as definition_version",
        )

    @cached_property
    def predictions(self) -> DataFrame:
        """Two scoring days per customer that has ordered."""
        return self.dim_customers.where("orders_count > 0").selectExpr(
            "tenant_id",
            "customer_id",
            "total_spent_paise",
            "explode(array(0, 7)) as d",
        ).selectExpr(
            "tenant_id",
            "customer_id",
            "cast((customer_id * 37 + d) % 100 as double) / 100 as p_alive",
            "cast((customer_id + d) % 50 as double) / 8 as expected_orders_90d",
            "(total_spent_paise div (3 + d)) as ltv_12m_paise",
            "'bgnbd-0.1+palive-bands-0.1' as model_version",
            "timestampadd(DAY, d, timestamp_ntz'2001-08-02 03:00:00') as scored_at",
        ).selectExpr(
            "*",
            "case when p_alive < 0.35 then 'high' when p_alive < 0.65 then 'medium' else 'low' end "
            "as churn_band",
            "cast(scored_at as date) as scored_on",
        )
