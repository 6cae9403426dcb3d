"""The ten marts, and the order in which they build on one another."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from patronage.functions import day_gap, month_of, seconds_between
from patronage.operators.attribution import last_click
from patronage.operators.leaks import leak_facts
from patronage.operators.orders import numbered_orders, share, valid_orders
from patronage.operators.retention import cohort_retention, customer_months, retention_changes, rto_orders, stretched
from patronage.operators.rfm import rfm_current
from patronage.operators.scale import beside, median_of
from patronage.session import settle

MONTH = ["tenant_id", "month"]
BREACH_HOURS = 72

# Lifecycle moments in their canonical order and the flow that
# covers each (by external id); the last three have none.
MOMENTS = (
    ("welcome", "KLF-01"),
    ("post_purchase", "KLF-02"),
    ("winback", "KLF-03"),
    ("replenishment", None),
    ("cod_confirmation", None),
    ("abandoned_checkout", None),
)


def _zero(name: str, kind: str = "int") -> Column:
    return F.coalesce(F.col(name), F.lit(0)).cast(kind).alias(name)


def executive_kpis(valid: DataFrame, refunds: DataFrame, leaks: DataFrame) -> DataFrame:
    """Revenue, repeat share, customers and losses of every month with a valid order."""
    month = customer_months(valid).groupBy(*MONTH).agg(
        F.sum("revenue").alias("total_revenue_paise"),
        F.sum("repeat").alias("repeat_revenue_paise"),
        F.sum("n").alias("n"),
        F.sum("discount").alias("discount_paise"),
        F.count_if(F.coalesce(F.col("born") == F.col("month"), F.lit(False))).alias("new_customers"),
        F.count_if(F.coalesce(F.col("born") < F.col("month"), F.lit(False))).alias("returning_customers"),
    )
    refunded = refunds.groupBy("tenant_id", month_of("processed_at").alias("month")).agg(
        F.sum("amount_paise").alias("refund_loss_paise")
    )

    def of(kind: str) -> Column:
        return F.sum(F.when(F.col("leak_type") == kind, F.col("amount_paise")))

    lost = leaks.groupBy(*MONTH).agg(
        of("rto_cod").alias("rto_loss_paise"),
        of("failed_payments").alias("failed_payment_loss_paise"),
        F.sum("amount_paise").alias("leak_total_paise"),
    )
    return (
        beside(MONTH, month, refunded, lost).where(F.col("n").isNotNull())
        .select(
            "tenant_id", "month", "total_revenue_paise", "repeat_revenue_paise",
            share(F.col("repeat_revenue_paise"), F.col("total_revenue_paise")).alias("repeat_rate"),
            F.col("n").cast("int").alias("orders"),
            F.expr("total_revenue_paise div n").alias("aov_paise"),
            _zero("new_customers"), _zero("returning_customers"),
            _zero("rto_loss_paise", "long"), _zero("failed_payment_loss_paise", "long"),
            _zero("refund_loss_paise", "long"), _zero("discount_paise", "long"),
            _zero("leak_total_paise", "long"),
        )
    )


def campaign_roi(campaigns: DataFrame, messages: DataFrame, valid: DataFrame) -> DataFrame:
    """Funnel and credited revenue per campaign; a message row counts once per step."""
    funnel = (
        messages.where(F.col("campaign_id").isNotNull())
        .groupBy("tenant_id", "campaign_id")
        .agg(
            F.count(F.lit(1)).alias("sends"),
            F.count("delivered_at").alias("delivered"),
            F.count("opened_at").alias("unique_opens"),
            F.count("clicked_at").alias("unique_clicks"),
            F.count("unsubscribed_at").alias("unsubscribes"),
            F.count("bounced_at").alias("bounces"),
        )
    )
    credit = last_click(valid, messages).groupBy("tenant_id", "campaign_id").agg(
        F.count(F.lit(1)).alias("attributed_orders"),
        F.sum("total_paise").alias("attributed_revenue_paise"),
    )
    key = ["tenant_id", "campaign_id"]
    return (
        campaigns.select(*key, F.col("name").alias("campaign_name"), "channel", "campaign_type")
        .join(funnel, key, "left").join(credit, key, "left")
        .select(
            *key, "campaign_name", "channel", "campaign_type",
            _zero("sends"), _zero("delivered"), _zero("unique_opens"), _zero("unique_clicks"),
            _zero("unsubscribes"), _zero("bounces"), _zero("attributed_orders"),
            _zero("attributed_revenue_paise", "long"),
            F.coalesce(
                F.expr("attributed_revenue_paise div nullif(sends, 0)"), F.lit(0)
            ).cast("long").alias("revenue_per_message_paise"),
        )
    )


def messaging_facts(messages: DataFrame, valid: DataFrame) -> DataFrame:
    """Funnel and credited revenue per month and channel.

    Sends fall in their own month, revenue in the order's. An order can be
    credited on several channels, so either side may lack the other's month.
    """
    key = ["tenant_id", "month", "channel"]
    funnel = messages.groupBy("tenant_id", month_of("sent_at").alias("month"), "channel").agg(
        F.count(F.lit(1)).alias("sends"),
        F.count("delivered_at").alias("delivered"),
        F.count("opened_at").alias("opened_or_read"),
        F.count("clicked_at").alias("clicked"),
        F.count("bounced_at").alias("bounced"),
        F.count("unsubscribed_at").alias("unsubscribed"),
    )
    credit = (
        last_click(valid, messages, by_channel=True)
        .groupBy("tenant_id", month_of("placed_at").alias("month"), "channel")
        .agg(
            F.count(F.lit(1)).alias("attributed_orders"),
            F.sum("total_paise").alias("attributed_revenue_paise"),
        )
    )
    return funnel.join(credit, key, "full").select(
        *key, _zero("sends"), _zero("delivered"), _zero("opened_or_read"), _zero("clicked"),
        _zero("bounced"),
        share(F.coalesce("bounced", F.lit(0)), F.coalesce("sends", F.lit(0))).alias("bounce_rate"),
        _zero("unsubscribed"), _zero("attributed_orders"), _zero("attributed_revenue_paise", "long"),
        F.coalesce(
            F.expr("attributed_revenue_paise div nullif(delivered, 0)"), F.lit(0)
        ).cast("long").alias("revenue_per_message_paise"),
    )


def with_moments(tenants: DataFrame) -> DataFrame:
    """A row per tenant and lifecycle moment, in canonical order."""
    listed = F.array(*[F.struct(F.lit(m).alias("moment"), F.lit(e).alias("ext")) for m, e in MOMENTS])
    return tenants.select("tenant_id", F.posexplode(listed).alias("ordinal", "m")).select(
        "tenant_id", "ordinal", "m.moment", "m.ext"
    )


def automation_facts(roi: DataFrame, campaigns: DataFrame, tenants: DataFrame) -> DataFrame:
    """Six lifecycle moments per tenant, the flow covering each, and its revenue share."""
    flows = campaigns.where("campaign_type = 'flow'").select(
        "tenant_id", "campaign_id", F.col("external_id").alias("ext")
    )
    total = roi.groupBy("tenant_id").agg(F.sum("attributed_revenue_paise").alias("all_revenue"))
    numbers = roi.select(
        "tenant_id", "campaign_id", "sends", "attributed_orders", "attributed_revenue_paise"
    )
    return (
        with_moments(tenants).join(flows, ["tenant_id", "ext"], "left")
        .join(numbers, ["tenant_id", "campaign_id"], "left")
        .join(total, "tenant_id", "left")
        .select(
            "tenant_id", "moment", F.col("campaign_id").isNotNull().alias("covered"), "campaign_id",
            _zero("sends"), _zero("attributed_orders"), _zero("attributed_revenue_paise", "long"),
            share(
                F.coalesce("attributed_revenue_paise", F.lit(0)), F.coalesce("all_revenue", F.lit(0))
            ).alias("automated_revenue_share"),
        )
    )


def nps_score(score: Column) -> Column:
    """Aggregate: 100 * (share of 9 and 10 - share of 0 to 6)."""
    return 100.0 * (
        F.avg(F.when(score >= 9, 1.0).otherwise(0.0)) - F.avg(F.when(score <= 6, 1.0).otherwise(0.0))
    )


def cx_facts(
    shipments: DataFrame, orders: DataFrame, tickets: DataFrame, reviews: DataFrame, nps: DataFrame
) -> DataFrame:
    """Delivery, returns, support, reviews and NPS of every month with any of them."""
    arrived = (
        shipments.where(F.col("delivered_at").isNotNull())
        .groupBy("tenant_id", "order_id")
        .agg(F.min("shipped_at").alias("shipped_at"), F.min("delivered_at").alias("delivered_at"))
        .select("tenant_id", month_of("delivered_at").alias("month"),
                day_gap(F.col("shipped_at"), F.col("delivered_at")).alias("days"))
    )
    # Transit days take few distinct values, so the built-in median's value
    # counts stay small.
    delivered = arrived.groupBy(*MONTH).agg(
        F.count(F.lit(1)).alias("orders_delivered"), F.median("days").alias("median_delivery_days")
    )
    returned = (
        rto_orders(shipments)
        .groupBy("tenant_id", month_of(F.coalesce("rto_at", "shipped_at")).alias("month"))
        .agg(F.count(F.lit(1)).alias("rto_orders"))
    )
    placed = (
        orders.where(F.col("cancelled_at").isNull())
        .groupBy("tenant_id", month_of("placed_at").alias("month")).agg(F.count(F.lit(1)).alias("placed"))
    )
    opened = tickets.groupBy("tenant_id", month_of("opened_at").alias("month")).agg(
        F.count(F.lit(1)).alias("tickets_opened")
    )
    closed = tickets.where(F.col("resolved_at").isNotNull()).select(
        "tenant_id", month_of("resolved_at").alias("month"), "csat",
        seconds_between(F.col("opened_at"), F.col("resolved_at")).alias("seconds"),
    )
    quality = closed.groupBy(*MONTH).agg(
        F.avg(F.when(F.col("seconds") > BREACH_HOURS * 3600, 1.0).otherwise(0.0)).alias("breach_rate"),
        F.avg("csat").alias("avg_csat"),
    )
    speed = median_of(closed, MONTH, "seconds", "median_seconds")
    rated = reviews.groupBy("tenant_id", month_of("submitted_at").alias("month")).agg(
        F.count(F.lit(1)).alias("reviews"), F.avg("rating").alias("avg_review_rating")
    )
    asked = nps.groupBy("tenant_id", month_of("responded_at").alias("month")).agg(
        F.count(F.lit(1)).alias("nps_responses"), nps_score(F.col("score")).alias("nps")
    )
    out = beside(MONTH, delivered, returned, placed, opened, quality, speed, rated, asked)
    ends = F.coalesce("orders_delivered", F.lit(0)) + F.coalesce("rto_orders", F.lit(0))
    return out.where(F.col("month").isNotNull()).select(
        *MONTH, _zero("orders_delivered"), "median_delivery_days", _zero("rto_orders"),
        F.when(ends > 0, F.coalesce("rto_orders", F.lit(0)) / ends).alias("rto_rate"),
        _zero("tickets_opened"),
        F.when(F.col("placed") > 0, F.coalesce("tickets_opened", F.lit(0)) / F.col("placed"))
        .alias("ticket_rate"),
        (F.col("median_seconds") / 3600.0).alias("median_resolution_hours"),
        "breach_rate", "avg_csat", _zero("reviews"), "avg_review_rating", _zero("nps_responses"), "nps",
    )


def experiment_facts(experiments: DataFrame) -> DataFrame:
    return experiments.select(
        "tenant_id", "experiment_id", "name", "score_target", "status", "decision",
        "started_at", "concluded_at", month_of("started_at").alias("started_month"),
        "sample_size", "lift_pct", "significant",
        day_gap(F.col("started_at"), F.col("concluded_at")).alias("days_to_decision"),
    )


VALID_COLUMNS = (
    "tenant_id", "order_id", "customer_id", "placed_at", "total_paise", "subtotal_paise", "discount_paise", "cod",
    "financial_status", "oi",
)
# Of all orders, cancelled ones too: what marts and score inputs read.
ORDER_COLUMNS = (*VALID_COLUMNS[:-1], "cancelled_at")


@dataclass
class Marts:
    """All marts over one set of tables, each built once and only when asked for.

    `tables` is anything with the fact and dimension tables as attributes.
    With `reuse` what several marts share is checkpointed, which a nightly run
    wants: the numbered orders and the messages (only the columns marts read), the
    months that change a customer's history, and the marts that others build on.
    """

    tables: object
    indexed: bool = False
    reuse: bool = False
    _made: dict = field(default_factory=dict)
    _bases: set = field(default_factory=set)

    def _get(self, name: str, build, shared: bool = False) -> DataFrame:
        if name not in self._made:
            df = build()
            self._made[name] = settle(df) if shared and self.reuse else df
        return self._made[name]

    def base(self, name: str) -> DataFrame:
        """A small mart that others build on, stored once also without `reuse`, so that no plan holds what made it again and again."""
        df = getattr(self, name)
        if not self.reuse and name not in self._bases:
            self._made[name] = settle(df)
            self._bases.add(name)
        return self._made[name]

    @property
    def orders(self) -> DataFrame:
        def build() -> DataFrame:
            all_orders = self.tables.fact_orders
            if not self.reuse:
                return all_orders
            return numbered_orders(all_orders.select(*ORDER_COLUMNS, "customer_order_index"), self.indexed)

        return self._get("orders", build, shared=True)

    @property
    def messages(self) -> DataFrame:
        return self._get("messages", lambda: self.tables.fact_messages, shared=True)

    @property
    def valid(self) -> DataFrame:
        def build() -> DataFrame:
            if self.reuse:
                return self.orders.where(F.col("cancelled_at").isNull())
            return valid_orders(self.orders, self.indexed)

        return self._get("valid", lambda: build().select(*VALID_COLUMNS))

    @property
    def dim_customers(self) -> DataFrame:
        return self._get("dim_customers", lambda: self.tables.dim_customers, shared=True)

    @property
    def rfm_current(self) -> DataFrame:
        return self._get("rfm_current", lambda: rfm_current(self.orders, self.dim_customers))

    @property
    def cohort_retention(self) -> DataFrame:
        return self._get("cohort_retention", lambda: cohort_retention(self.valid))

    @property
    def retention_facts(self) -> DataFrame:
        t = self.tables
        return self._get("retention_facts", lambda: stretched(self._get(
            "retention_changes", lambda: retention_changes(self.orders, t.fact_shipments, t.fact_refunds), shared=True,
        )))

    @property
    def campaign_roi(self) -> DataFrame:
        t = self.tables
        return self._get(
            "campaign_roi", lambda: campaign_roi(t.dim_campaigns, self.messages, self.valid), shared=True
        )

    @property
    def leak_facts(self) -> DataFrame:
        t = self.tables
        return self._get(
            "leak_facts",
            lambda: leak_facts(self.orders, t.fact_payments, t.fact_shipments, self.retention_facts),
            shared=True,
        )

    @property
    def executive_kpis(self) -> DataFrame:
        return self._get(
            "executive_kpis",
            lambda: executive_kpis(self.valid, self.tables.fact_refunds, self.base("leak_facts")),
            shared=True,
        )

    @property
    def cx_facts(self) -> DataFrame:
        t = self.tables
        return self._get(
            "cx_facts",
            lambda: cx_facts(t.fact_shipments, self.orders, t.fact_tickets, t.fact_reviews, t.fact_nps),
            shared=True,
        )

    @property
    def messaging_facts(self) -> DataFrame:
        return self._get(
            "messaging_facts", lambda: messaging_facts(self.messages, self.valid), shared=True
        )

    @property
    def automation_facts(self) -> DataFrame:
        return self._get(
            "automation_facts", lambda: automation_facts(
                self.campaign_roi, self.tables.dim_campaigns, self.tables.tenants
            ),
        )

    @property
    def experiment_facts(self) -> DataFrame:
        return self._get("experiment_facts", lambda: experiment_facts(self.tables.fact_experiments))


# Build order: leaks need retention, KPIs need leaks, automation needs ROI.
MART_NAMES = (
    "rfm_current", "cohort_retention", "retention_facts", "campaign_roi", "leak_facts",
    "executive_kpis", "cx_facts", "messaging_facts", "automation_facts", "experiment_facts",
)


def build_marts(tables: object, indexed: bool = False, reuse: bool = True) -> dict[str, DataFrame]:
    marts = Marts(tables, indexed=indexed, reuse=reuse)
    return {name: getattr(marts, name) for name in MART_NAMES}
