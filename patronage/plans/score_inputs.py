"""What the nine health scores are computed from, one row per tenant.

All windows hang on the data: the newest KPI month, the newest message month,
the newest order. Only run metadata (prediction freshness) looks at the day the
scores are computed.
"""

from __future__ import annotations

from datetime import datetime
from functools import cached_property

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from patronage.functions import day_gap, month_gap, month_of
from patronage.operators.attribution import latest_before
from patronage.operators.leaks import SETTLED
from patronage.operators.orders import CUSTOMER, data_clock
from patronage.operators.scale import beside
from patronage.session import settle

TENANT = "tenant_id"
LEAK_TYPES = ("preventable_churn", "rto_cod", "failed_payments", "discount_abuse")
SAMPLE_MIN = 1000


def _rate(condition: Column) -> Column:
    """Aggregate: share of rows for which the condition holds."""
    return F.avg(F.when(condition, 1.0).otherwise(0.0))


def _days_before(ts: Column, days: int) -> Column:
    return ts - F.make_dt_interval(F.lit(days))


# ------------------------------------------------------------------ gravity


def _first_and_second(orders: DataFrame) -> DataFrame:
    """First valid order and the one stored as the customer's second."""
    return (
        orders.where(F.col("customer_id").isNotNull() & F.col("cancelled_at").isNull())
        .groupBy(*CUSTOMER)
        .agg(
            F.min("placed_at").alias("first_at"),
            F.min(F.when(F.col("customer_order_index") == 2, F.col("placed_at"))).alias("second_at"),
        )
    )


def repeat_rate_90d(orders: DataFrame, pairs: DataFrame | None = None) -> DataFrame:
    """Share of customers, first seen 90 days ago or earlier, who reordered within 90 days; `pairs` are their first two orders, if at hand."""
    within = F.col("second_at") <= F.col("first_at") + F.make_dt_interval(F.lit(90))
    return (
        (_first_and_second(orders) if pairs is None else pairs).join(data_clock(orders), TENANT)
        .where(F.col("first_at") <= _days_before(F.col("as_of"), 90))
        .groupBy(TENANT).agg(_rate(F.coalesce(within, F.lit(False))).alias("repeat_rate_90d"))
    )


def median_repurchase_days(orders: DataFrame, pairs: DataFrame | None = None) -> DataFrame:
    """Median days to the second order; days take few values, so the median stays small."""
    return (
        (_first_and_second(orders) if pairs is None else pairs).where(F.col("second_at").isNotNull())
        .groupBy(TENANT)
        .agg(F.median(day_gap(F.col("first_at"), F.col("second_at"))).alias("median_repurchase_days"))
    )


def m3_retention(cohort: DataFrame) -> DataFrame:
    """Mean of the month-3 cells; a cohort nobody came back to has none and does not count."""
    return cohort.where("months_since = 3").groupBy(TENANT).agg(
        F.avg("retention_rate").alias("avg_m3_retention")
    )


def _last_year(df: DataFrame, kpis: DataFrame) -> DataFrame:
    top = kpis.groupBy(TENANT).agg(F.max("month").alias("top_month"))
    return df.join(top, TENANT).where(F.col("month") >= F.add_months("top_month", -11))


def repeat_revenue_share(kpis: DataFrame) -> DataFrame:
    return _last_year(kpis, kpis).groupBy(TENANT).agg(
        F.expr("sum(repeat_revenue_paise) / nullif(sum(total_revenue_paise), 0)").alias("repeat_revenue_share")
    )


# ------------------------------------------------------------------ flow


def healthy_share(dim: DataFrame) -> DataFrame:
    return dim.where("orders_count > 0").groupBy(TENANT).agg(
        _rate(F.col("lifecycle_stage").isin("active", "loyal")).alias("healthy_stage_share")
    )


def new_to_active(dim: DataFrame, orders: DataFrame) -> DataFrame:
    """Share with a second order among customers acquired 180 to 90 days ago."""
    clock = data_clock(orders)
    between = F.col("first_order_at").between(_days_before(F.col("as_of"), 180), _days_before(F.col("as_of"), 90))
    return dim.join(clock, TENANT).where(between).groupBy(TENANT).agg(
        _rate(F.col("orders_count") >= 2).alias("new_to_active_rate")
    )


def stage_ends(retention: DataFrame) -> DataFrame:
    """Every customer's stage three months before the newest month, and in it."""
    top = retention.groupBy(TENANT).agg(F.max("month").alias("top_month"))
    ends = retention.select(*CUSTOMER, "month", "lifecycle_stage").join(top, TENANT)
    # Both ends come out of one aggregation: no self-join of the history.
    return (
        ends.where(F.col("month").isin(F.col("top_month"), F.add_months("top_month", -3)))
        .groupBy(*CUSTOMER)
        .agg(
            F.max(F.when(F.col("month") == F.col("top_month"), F.col("lifecycle_stage"))).alias("now"),
            F.max(F.when(F.col("month") < F.col("top_month"), F.col("lifecycle_stage"))).alias("then"),
        )
    )


def stage_transition(
    retention: DataFrame, source: str, target: tuple[str, ...], name: str, ends: DataFrame | None = None
) -> DataFrame:
    """Of the customers in `source` three months before the newest month, the share now in `target`; `ends` are their stages, if at hand."""
    both = stage_ends(retention) if ends is None else ends
    return both.where((F.col("then") == source) & F.col("now").isNotNull()).groupBy(TENANT).agg(
        _rate(F.col("now").isin(*target)).alias(name)
    )


# ------------------------------------------------------------------ signal


def identity_rate(orders: DataFrame) -> DataFrame:
    return orders.groupBy(TENANT).agg(_rate(F.col("customer_id").isNotNull()).alias("identity_resolution_rate"))


def field_completeness(customers: DataFrame, pii: DataFrame) -> DataFrame:
    """Share of live customers with both a phone and an e-mail on file."""
    live = customers.where(F.col("merged_into_customer_id").isNull()).select(*CUSTOMER)
    full = pii.where(F.col("primary_phone").isNotNull() & F.col("primary_email").isNotNull())
    return (
        live.join(full.select(*CUSTOMER, F.lit(1).alias("full")), CUSTOMER, "left")
        .groupBy(TENANT).agg(_rate(F.col("full") == 1).alias("field_completeness"))
    )


def payment_match_rate(orders: DataFrame, payments: DataFrame) -> DataFrame:
    """Share of prepaid settled orders that have a captured payment."""
    key = [TENANT, "order_id"]
    paid = payments.where("status = 'captured' and order_id is not null").groupBy(*key).agg(F.lit(1).alias("got"))
    due = orders.where(~F.col("cod") & F.col("financial_status").isin(*SETTLED)).select(*key)
    return due.join(paid, key, "left").groupBy(TENANT).agg(_rate(F.col("got") == 1).alias("payment_match_rate"))


def history_months(orders: DataFrame) -> DataFrame:
    return orders.groupBy(TENANT).agg(
        (month_gap(F.min("placed_at"), F.max("placed_at")) + 1).cast("double").alias("history_months")
    )


# ------------------------------------------------------------------ watertight


def watertight_inputs(kpis: DataFrame, leaks: DataFrame) -> DataFrame:
    """Gross revenue and leak per type over the twelve newest KPI months."""
    gross = _last_year(kpis, kpis).groupBy(TENANT).agg(F.sum("total_revenue_paise").alias("gross_revenue_paise"))
    lost = _last_year(leaks, kpis).groupBy(TENANT).agg(
        *[F.coalesce(F.sum(F.when(F.col("leak_type") == k, F.col("amount_paise"))), F.lit(0)).alias(f"leak_{k}_paise")
          for k in LEAK_TYPES]
    )
    return gross.join(lost, TENANT, "left").na.fill(0)


# ------------------------------------------------------------------ vitals


def consent_backed_share(dim: DataFrame, consent: DataFrame) -> DataFrame:
    """Of all opt-in flags set, the share whose last consent action is a grant."""
    flags = F.array(
        F.when(F.col("accepts_email_marketing"), F.lit("email")),
        F.when(F.col("whatsapp_opted_in"), F.lit("whatsapp")),
        F.when(F.col("sms_opted_in"), F.lit("sms")),
    )
    key = [*CUSTOMER, "channel"]
    set_flags = dim.select(*CUSTOMER, F.explode(F.array_compact(flags)).alias("channel"))
    last = consent.groupBy(*key).agg(
        F.max(F.struct("occurred_at", "consent_id", "action"))["action"].alias("action")
    )
    return set_flags.join(last, key, "left").groupBy(TENANT).agg(
        _rate(F.coalesce(F.col("action") == "granted", F.lit(False))).alias("consent_backed_share")
    )


def sends_after_revoke(messages: DataFrame, consent: DataFrame) -> DataFrame:
    """Messages sent while the last consent action on their channel was a revocation."""
    key = [*CUSTOMER, "channel"]
    sends = messages.where(F.col("customer_id").isNotNull() & F.col("sent_at").isNotNull()).select(
        *key, "message_id", "sent_at"
    )
    acted = consent.select(*key).distinct()
    state = latest_before(
        sends.join(acted, key, "left_semi"), consent, key, "sent_at", "occurred_at",
        [F.col("consent_id"), F.col("action")], "said",
    )
    return state.where("said.action = 'revoked'").groupBy(TENANT).agg(
        F.count(F.lit(1)).alias("sends_after_revoke")
    )


def flow_activity(campaigns: DataFrame, messages: DataFrame) -> DataFrame:
    """Flows, and those that sent within 60 days of the tenant's last send."""
    key = [TENANT, "campaign_id"]
    last = messages.groupBy(*key).agg(F.max("sent_at").alias("last_send"))
    clock = messages.groupBy(TENANT).agg(F.max("sent_at").alias("clock"))
    recent = F.col("last_send") >= _days_before(F.col("clock"), 60)
    return (
        campaigns.where("campaign_type = 'flow'").select(*key).join(last, key, "left").join(clock, TENANT, "left")
        .groupBy(TENANT)
        .agg(F.count(F.lit(1)).alias("flows_total"), F.count_if(F.coalesce(recent, F.lit(False))).alias("flows_active_60d"))
    )


def vitals_inputs(
    messaging: DataFrame, dim: DataFrame, consent: DataFrame, messages: DataFrame, campaigns: DataFrame
) -> DataFrame:
    top = messaging.groupBy(TENANT).agg(F.max("month").alias("top_month"))

    def over(channel: str, part: str) -> Column:
        mine = F.col("channel") == channel
        sends = F.sum(F.when(mine, F.col("sends")))
        return F.sum(F.when(mine, F.col(part))) / F.when(sends != 0, sends)

    rates = (
        messaging.join(top, TENANT).where(F.col("month") > F.add_months("top_month", -6))
        .groupBy(TENANT)
        .agg(
            over("email", "bounced").alias("email_bounce_rate"),
            over("email", "unsubscribed").alias("email_unsub_rate"),
            over("whatsapp", "bounced").alias("whatsapp_fail_rate"),
        )
    )
    people = dim.groupBy(TENANT).agg(_rate(F.col("whatsapp_opted_in")).alias("whatsapp_optin_share"))
    total = messages.groupBy(TENANT).agg(F.count(F.lit(1)).alias("total_sends"))
    out = beside(
        [TENANT], people, rates, consent_backed_share(dim, consent), sends_after_revoke(messages, consent), total,
        flow_activity(campaigns, messages),
    )
    return out.na.fill(0, ["sends_after_revoke", "total_sends", "flows_total", "flows_active_60d"]).na.fill(
        0.0, ["whatsapp_optin_share"]
    )


# ------------------------------------------------------------------ velocity, autopilot, pulse


def velocity_inputs(facts: DataFrame) -> DataFrame:
    """Starts in the six newest start months; concluded, valid and decided of all time."""
    top = facts.groupBy(TENANT).agg(F.max("started_month").alias("top_month"))
    recent = F.col("started_month") > F.add_months("top_month", -6)
    ended = F.col("status") == "concluded"
    valid = F.col("significant").isNotNull() & (F.col("sample_size") >= SAMPLE_MIN)
    count = lambda c: F.count_if(F.coalesce(c, F.lit(False)))
    return facts.join(top, TENANT).groupBy(TENANT).agg(
        count((F.col("status") != "draft") & recent).alias("starts_6mo"),
        count(ended).alias("concluded"),
        count(ended & valid).alias("concluded_valid"),
        count(ended & F.col("decision").isin("shipped", "killed")).alias("concluded_decided"),
    )


def autopilot_inputs(automation: DataFrame, roi: DataFrame) -> DataFrame:
    moments = automation.groupBy(TENANT).agg(
        F.count(F.lit(1)).alias("moments_total"),
        F.count_if("covered").alias("moments_covered"),
        F.sum(F.when(F.col("covered"), F.col("automated_revenue_share")).otherwise(0.0)).alias("automated_revenue_share"),
        F.array_sort(F.collect_set(F.when(F.col("covered"), F.col("moment")))).alias("covered_moments"),
    )

    def per_send(kind: str) -> Column:
        mine = F.col("campaign_type") == kind
        return F.struct(
            F.sum(F.when(mine, F.col("attributed_revenue_paise"))).alias("rev"),
            F.sum(F.when(mine, F.col("sends"))).alias("n"),
        )

    earned = roi.groupBy(TENANT).agg(per_send("flow").alias("fl"), per_send("campaign").alias("ca")).select(
        TENANT,
        F.expr("fl.rev div nullif(fl.n, 0)").alias("flow_revenue_per_send_paise"),
        F.expr("ca.rev div nullif(ca.n, 0)").alias("campaign_revenue_per_send_paise"),
    )
    return moments.join(earned, TENANT, "left")


def pulse_inputs(cx: DataFrame) -> DataFrame:
    """Six newest experience months; ratings and NPS weighted by volume, CSAT and breaches by month."""
    top = cx.groupBy(TENANT).agg(F.max("month").alias("top_month"))
    at = cx.join(top, TENANT).where(F.col("month") > F.add_months("top_month", -12)).withColumn(
        "recent", F.col("month") > F.add_months("top_month", -6)
    )
    now, before = F.col("recent"), ~F.col("recent")

    def weighted(value: str, by: str, when: Column) -> Column:
        weight = F.sum(F.when(when, F.col(by)))
        return F.sum(F.when(when, F.col(value) * F.col(by))) / F.when(weight != 0, weight)

    ends = F.sum(F.when(now, F.col("orders_delivered") + F.col("rto_orders")))
    # Six monthly values per tenant: the built-in median is small here.
    return at.groupBy(TENANT).agg(
        F.median(F.when(now, F.col("median_delivery_days"))).alias("median_delivery_days"),
        (F.sum(F.when(now, F.col("rto_orders"))) / F.when(ends != 0, ends)).alias("rto_rate"),
        F.avg(F.when(now, F.col("median_resolution_hours"))).alias("median_resolution_hours"),
        F.avg(F.when(now, F.col("breach_rate"))).alias("breach_rate"),
        F.avg(F.when(now, F.col("avg_csat"))).alias("avg_csat"),
        weighted("avg_review_rating", "reviews", now).alias("avg_review_rating"),
        weighted("nps", "nps_responses", now).alias("nps"),
        weighted("avg_review_rating", "reviews", before).alias("avg_review_rating_prev_6mo"),
    )


# ------------------------------------------------------------------ altitude


def monthly_run_streak(runs: DataFrame) -> DataFrame:
    """Consecutive months with a run, counted back from the newest."""
    months = runs.groupBy(TENANT, month_of("computed_at").alias("month")).agg(F.count(F.lit(1)))
    index = F.year("month") * 12 + F.month("month")
    back = F.row_number().over(Window.partitionBy(TENANT).orderBy(F.desc("month")))
    newest = F.max(index).over(Window.partitionBy(TENANT))
    return (
        months.select(TENANT, (index + back).alias("island"), (newest + 1).alias("first_island"))
        .where("island = first_island")
        .groupBy(TENANT).agg(F.count(F.lit(1)).alias("monthly_run_streak"))
    )


def altitude_inputs(
    predictions: DataFrame, runs: DataFrame, rfm: DataFrame, orders: DataFrame, experiments: DataFrame,
    velocity: DataFrame, vitals: DataFrame, run_at: datetime,
) -> DataFrame:
    """How far the tenant's own use of the system has come, as of `run_at`."""
    age = F.datediff(F.lit(run_at.date()), F.max("scored_on"))
    scored = predictions.groupBy(TENANT).agg(
        F.count(F.lit(1)).alias("predictions_rows"), (age <= 7).alias("predictions_fresh")
    )
    built = rfm.groupBy(TENANT).agg(F.lit(True).alias("marts_built"))
    ended = F.col("status") == "concluded"
    count = lambda c: F.count_if(F.coalesce(c, F.lit(False)))
    told = (F.coalesce("hypothesis", F.lit("")) != "") & (F.coalesce("decision", F.lit("")) != "")
    tried = (
        experiments.join(data_clock(orders), TENANT, "left").groupBy(TENANT)
        .agg(
            count(ended & (F.col("concluded_at") >= _days_before(F.col("as_of"), 180))).alias("concluded_6mo"),
            count(ended & (F.col("decision") == "shipped")).alias("winners_shipped"),
            F.avg(F.when(ended, F.when(told, 1.0).otherwise(0.0))).alias("decided_share"),
        )
    )
    out = _beside(
        data_clock(orders).select(TENANT), scored, built, monthly_run_streak(runs), tried,
        velocity.select(TENANT, F.col("starts_6mo").alias("cadence_starts_6mo")),
        vitals.select(TENANT, "flows_total", "flows_active_60d"),
    )
    counts = ["predictions_rows", "concluded_6mo", "winners_shipped", "monthly_run_streak", "cadence_starts_6mo",
              "flows_total", "flows_active_60d"]
    return (
        out.withColumn("scores_ever_run", F.col("monthly_run_streak").isNotNull())
        .na.fill(0, counts).na.fill(False, ["predictions_fresh", "marts_built"])
    )


# ------------------------------------------------------------------ all of them

# What a tenant without a single order is scored on.
NO_ORDERS = {
    "gravity": {"repeat_rate_90d": 0.0, "median_repurchase_days": None, "avg_m3_retention": 0.0,
                "repeat_revenue_share": 0.0},
    "flow": {"healthy_stage_share": 0.0, "new_to_active_rate": 0.0, "slipping_to_dormant_rate": 1.0,
             "reactivation_rate": 0.0},
    "signal": {"identity_resolution_rate": 0.0, "field_completeness": 0.0, "payment_match_rate": 0.0,
               "history_months": 0.0},
    "watertight": {"gross_revenue_paise": 0, **{f"leak_{k}_paise": 0 for k in LEAK_TYPES}},
}
# Rates that stay unknown, instead of zero, when there is nothing to rate.
STAY_NULL = ("median_repurchase_days", "slipping_to_dormant_rate", "reactivation_rate")


def with_defaults(tenants: DataFrame, inputs: DataFrame) -> DataFrame:
    """All tenants; one without orders gets the worst case and `has_orders` false."""
    joined = tenants.select(TENANT).join(inputs, TENANT, "left")
    has = F.coalesce("has_orders", F.lit(False))
    filled = {}
    for group in NO_ORDERS.values():
        for name, worst in group.items():
            kind = "long" if name.endswith("_paise") else "double"
            empty = F.lit(worst).cast(kind)
            present = F.col(name) if name in STAY_NULL else F.coalesce(F.col(name), F.lit(0).cast(kind))
            filled[name] = F.when(has, present).otherwise(empty)
    return joined.withColumns({**filled, "has_orders": has})


def _beside(first: DataFrame, *parts: DataFrame) -> DataFrame:
    """The tenants of `first` with the columns of all parts."""
    here = first.withColumn("__here", F.lit(True))
    return beside([TENANT], here, *parts).where("__here").drop("__here")


class ScoreInputs:
    """Inputs of each score from one set of tables and marts.

    `run_at` is when the scores are computed; only prediction freshness reads it.
    """

    def __init__(self, tables: object, marts: object, run_at: datetime) -> None:
        self.tables, self.marts, self.run_at = tables, marts, run_at

    @cached_property
    def tenants(self) -> DataFrame:
        return self.newest.select(TENANT)

    @cached_property
    def newest(self) -> DataFrame:
        """The tenants' newest order times, a row each, in place of the orders where a step reads nothing but its clock off them."""
        return settle(data_clock(self.marts.orders).withColumnRenamed("as_of", "placed_at"))

    @cached_property
    def gravity(self) -> DataFrame:
        pairs = settle(_first_and_second(self._indexed))
        return _beside(
            self.tenants, repeat_rate_90d(self.newest, pairs), median_repurchase_days(self.newest, pairs),
            m3_retention(self.marts.cohort_retention), repeat_revenue_share(self.marts.base("executive_kpis")),
        )

    @property
    def _indexed(self) -> DataFrame:
        """Orders with the index each stores; the marts have numbered them already where they keep what they share."""
        if getattr(self.marts, "reuse", False):
            return self.marts.orders.withColumnRenamed("oi", "customer_order_index")
        return self.tables.indexed_orders

    @cached_property
    def flow(self) -> DataFrame:
        dim, retention = self.marts.dim_customers, self.marts.retention_facts
        ends = settle(stage_ends(retention))
        return _beside(
            self.tenants, healthy_share(dim), new_to_active(dim, self.newest),
            stage_transition(retention, "slipping", ("dormant", "lost"), "slipping_to_dormant_rate", ends),
            stage_transition(retention, "dormant", ("new", "active", "loyal"), "reactivation_rate", ends),
        )

    @cached_property
    def signal(self) -> DataFrame:
        t, orders = self.tables, self.marts.orders
        return _beside(
            self.tenants, identity_rate(orders), field_completeness(t.customers, t.clean_pii),
            payment_match_rate(orders, t.fact_payments), history_months(orders),
        )

    @cached_property
    def watertight(self) -> DataFrame:
        return _beside(self.tenants, watertight_inputs(self.marts.base("executive_kpis"), self.marts.base("leak_facts")))

    @cached_property
    def vitals(self) -> DataFrame:
        t = self.tables
        return vitals_inputs(
            self.marts.messaging_facts, self.marts.dim_customers, t.fact_consent, self.marts.messages, t.dim_campaigns
        )

    @cached_property
    def velocity(self) -> DataFrame:
        return velocity_inputs(self.marts.experiment_facts)

    @cached_property
    def autopilot(self) -> DataFrame:
        return autopilot_inputs(self.marts.automation_facts, self.marts.campaign_roi)

    @cached_property
    def pulse(self) -> DataFrame:
        return pulse_inputs(self.marts.cx_facts)

    @cached_property
    def altitude(self) -> DataFrame:
        t = self.tables
        return altitude_inputs(
            t.predictions, t.score_runs, self.marts.rfm_current, self.newest, t.experiments,
            self.velocity, self.vitals, self.run_at,
        )

    def first_phase(self, tenants: DataFrame) -> DataFrame:
        """Gravity, flow, signal and watertight of all tenants, defaults filled in.

        Each score's inputs are a row per tenant and stored by themselves, so that none of the plans holds more than one score.
        """
        own = _beside(self.tenants.withColumn("has_orders", F.lit(True)),
                      *[settle(part) for part in (self.gravity, self.flow, self.signal, self.watertight)])
        return with_defaults(tenants, own)

    def all(self, tenants: DataFrame) -> DataFrame:
        """Inputs of all nine scores, each stored before the next is built: altitude is built on the stored vitals and velocity."""
        first = self.first_phase(tenants)
        for name in ("vitals", "velocity", "autopilot", "pulse", "altitude"):
            setattr(self, name, settle(getattr(self, name)))
        return _beside(
            first, self.vitals, self.velocity, self.autopilot, self.pulse,
            self.altitude.drop("flows_total", "flows_active_60d"),
        )
