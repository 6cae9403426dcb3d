"""Typed reads over the marts and ledgers; every result is a DataFrame.

Reads that end in a page keep the best rows per tenant with a row number that
Spark applies before the shuffle, so a page costs its own size per task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from patronage.functions import month_of, score_band
from patronage.operators.orders import CUSTOMER, share
from patronage.operators.scale import beside, ranked_values, value_at
from patronage.plans.marts import MOMENTS

WINDOW_MONTHS = 12
PAGE_MAX = 200  # largest page unless the caller says otherwise

# The nine scores in display order, those of the second phase,
# and the stage each belongs to; also the column names of every result in this module.
SCORE_NAMES = ("gravity", "flow", "signal", "watertight", "vitals", "velocity", "autopilot", "pulse", "altitude")
SECOND_PHASE = ("vitals", "velocity", "autopilot", "pulse", "altitude")
STAGES = {
    "Decode": ("signal", "altitude"),
    "Design": ("vitals", "autopilot"),
    "Drive": ("velocity", "flow"),
    "Compound": ("gravity", "watertight", "pulse"),
}
COMPOSITE = "composite"
COMPOSITE_PARTIAL = "composite_partial"


def clamp_page(page: int, page_size: int, page_max: int = PAGE_MAX) -> tuple[int, int]:
    """A page's number and size within bounds; a size beyond `page_max` is cut to it."""
    return max(1, page), max(1, min(page_size, page_max))


def _paged(df: DataFrame, order: list[Column], page: int, page_size: int, page_max: int = PAGE_MAX) -> DataFrame:
    page, page_size = clamp_page(page, page_size, page_max)
    place = F.row_number().over(Window.partitionBy("tenant_id").orderBy(*order))
    return (
        df.withColumn("__place", place)
        .where(F.col("__place") <= page * page_size)
        .where(F.col("__place") > (page - 1) * page_size)
        .drop("__place")
    )


def newest_month(orders: DataFrame) -> DataFrame:
    """As-of time and month per tenant, from valid orders."""
    return (
        orders.where(F.col("cancelled_at").isNull()).groupBy("tenant_id")
        .agg(F.max("placed_at").alias("as_of"))
        .withColumn("top_month", month_of("as_of"))
    )


def _within(df: DataFrame, clock: DataFrame, months: int) -> DataFrame:
    recent = F.col("month") > F.add_months("top_month", -months)
    return df.join(clock.select("tenant_id", "top_month"), "tenant_id").where(recent)


# ------------------------------------------------------------------ scores


def latest_runs(runs: DataFrame) -> DataFrame:
    """Newest run per tenant and score."""
    rest = [c for c in runs.columns if c not in ("tenant_id", "score", "computed_at", "run_id")]
    newest = F.max(F.struct("computed_at", "run_id", *rest)).alias("r")
    return runs.groupBy("tenant_id", "score").agg(newest).select("tenant_id", "score", "r.*")


def scores_latest(runs: DataFrame, tenants: DataFrame) -> DataFrame:
    """Nine scores and the composite per tenant, with value, status and version.

    The partial composite stands in only where a full one was never written.
    """
    last = latest_runs(runs)
    first = runs.groupBy("tenant_id").agg(F.min(F.struct("computed_at", "run_id", "score")).alias("f"))
    facts = (
        last.join(first.select("tenant_id", F.col("f.score").alias("first_score")), "tenant_id")
        .groupBy("tenant_id")
        .agg(
            F.max("computed_at").alias("computed_at"),
            F.max(F.when(F.col("score") == COMPOSITE, 1).otherwise(0)).alias("full"),
            F.max(F.when(F.col("score") == COMPOSITE_PARTIAL, 1).otherwise(0)).alias("part"),
            F.max(F.when(F.col("score") == COMPOSITE, F.col("definition_version"))).alias("v_full"),
            F.max(F.when(F.col("score") == COMPOSITE_PARTIAL, F.col("definition_version"))).alias("v_part"),
            F.max(F.when(F.col("score") == F.col("first_score"), F.col("definition_version"))).alias("v_first"),
        )
        .withColumn("use_part", (F.col("full") == 0) & (F.col("part") == 1))
    )
    listed = F.array(*[F.lit(n) for n in SCORE_NAMES], F.lit(COMPOSITE))
    named = (
        tenants.select("tenant_id").join(facts, "tenant_id", "left")
        .select(
            "tenant_id", F.col("computed_at").alias("run_at"),
            F.coalesce(F.when(F.col("use_part"), F.col("v_part")), "v_full", "v_first", F.lit("v0.1"))
            .alias("definition_version"),
            "use_part", F.explode(listed).alias("score"),
        )
        .withColumn(
            "score",
            F.when((F.col("score") == COMPOSITE) & F.coalesce("use_part", F.lit(False)), COMPOSITE_PARTIAL)
            .otherwise(F.col("score")),
        )
    )
    extra = [c for c in ("components",) if c in runs.columns]
    status = (
        F.when(F.col("found"), "computed")
        .when(F.col("score").isin(*SECOND_PHASE), "phase_2").otherwise("pending")
    )
    found = last.select("tenant_id", "score", "value", *extra, F.lit(True).alias("found"))
    return named.join(found, ["tenant_id", "score"], "left").select(
        "tenant_id", "score", "value", status.alias("status"),
        F.col("run_at").alias("computed_at"), "definition_version", *extra,
    )


def score_history(runs: DataFrame, score: str) -> DataFrame:
    return (
        runs.where(F.col("score") == score)
        .select("tenant_id", "computed_at", "run_id", "value", "definition_version")
        .orderBy("tenant_id", "computed_at", "run_id")
    )


def scores_by_stage(runs: DataFrame) -> DataFrame:
    """Latest scores with the stage each belongs to and the band its value is in."""
    stage = F.create_map(*[F.lit(x) for s, names in STAGES.items() for n in names for x in (n, s)])
    return (
        latest_runs(runs).where(F.col("score").isin(*SCORE_NAMES))
        .select("tenant_id", stage[F.col("score")].alias("stage"), "score", "value",
                score_band(F.col("value")).alias("band"))
    )


# ------------------------------------------------------------------ overview


def overview_kpis(
    kpis: DataFrame, rfm: DataFrame, leaks: DataFrame, orders: DataFrame, runs: DataFrame, tenants: DataFrame
) -> DataFrame:
    """The trailing-twelve-month headline of every tenant, with its latest scores."""
    clock = newest_month(orders)
    year = _within(kpis, clock, WINDOW_MONTHS).groupBy("tenant_id").agg(
        F.sum("total_revenue_paise").alias("total_revenue_paise"),
        F.sum("repeat_revenue_paise").alias("repeat_revenue_paise"),
        F.sum("orders").alias("orders"),
    )
    newest = kpis.groupBy("tenant_id").agg(
        F.max(F.struct("month", "new_customers"))["new_customers"].alias("new_customers_last_month")
    )
    people = rfm.groupBy("tenant_id").agg(F.count(F.lit(1)).alias("customers"))
    lost = _within(leaks, clock, WINDOW_MONTHS).groupBy("tenant_id").agg(
        F.sum("amount_paise").alias("leak_total_paise")
    )
    scores = (
        latest_runs(runs).groupBy("tenant_id").pivot("score", [*SCORE_NAMES, COMPOSITE]).agg(F.max("value"))
    )
    scores = scores.select("tenant_id", *[F.col(n).alias(f"score_{n}") for n in (*SCORE_NAMES, COMPOSITE)])
    here = tenants.select("tenant_id", F.lit(True).alias("here"))
    out = beside(["tenant_id"], here, clock.select("tenant_id", "as_of"), year, newest, people, lost, scores).where("here")
    number = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return out.select(
        "tenant_id", "as_of", F.lit(WINDOW_MONTHS).alias("window_months"),
        number("total_revenue_paise"), number("repeat_revenue_paise"),
        share(F.coalesce("repeat_revenue_paise", F.lit(0)), F.coalesce("total_revenue_paise", F.lit(0)))
        .alias("repeat_rate"),
        number("orders"), number("customers"), number("new_customers_last_month"),
        F.coalesce(F.expr("total_revenue_paise div nullif(orders, 0)"), F.lit(0)).alias("aov_paise"),
        number("leak_total_paise"),
        *[f"score_{n}" for n in (*SCORE_NAMES, COMPOSITE)],
    )


# ------------------------------------------------------------------ cohorts, segments


def cohort_matrix(cohort: DataFrame) -> DataFrame:
    """One row per cohort with its cells in month order; a cohort has a cell per month."""
    cell = F.struct("months_since", "active_customers", "retention_rate", "repeat_revenue_paise")
    return cohort.groupBy("tenant_id", "cohort_month", "cohort_size").agg(
        F.array_sort(F.collect_list(cell)).alias("cells")
    )


def cohort_heatmap(cohort: DataFrame, mode: str = "customers") -> DataFrame:
    """Every cohort against months 0..max, empty cells null, shaded by the tenant's peak after month 0."""
    value = F.col("retention_rate" if mode == "customers" else "repeat_revenue_paise").cast("double")
    cells = cohort.select("tenant_id", "cohort_month", "cohort_size", "months_since", value.alias("value"))
    span = cells.groupBy("tenant_id").agg(
        F.max("months_since").alias("last"),
        F.max(F.when(F.col("months_since") >= 1, F.col("value"))).alias("peak"),
    )
    grid = (
        cells.groupBy("tenant_id", "cohort_month", "cohort_size").agg(F.count(F.lit(1)))
        .join(span, "tenant_id")
        .select("tenant_id", "cohort_month", "cohort_size", "peak",
                F.explode(F.sequence(F.lit(0), F.col("last"))).alias("months_since"))
    )
    peak = F.greatest(F.lit(1e-9), F.coalesce("peak", F.lit(0.0)))
    return (
        grid.join(cells.drop("cohort_size"), ["tenant_id", "cohort_month", "months_since"], "left")
        .select("tenant_id", "cohort_month", "cohort_size", "months_since", "value",
                F.when(F.col("value").isNotNull(), F.least(F.lit(1.0), F.col("value") / peak)).alias("intensity"))
    )


def cohort_pivot(cohort: DataFrame, months: int, mode: str = "customers") -> DataFrame:
    """The same grid with a column per month 0..months."""
    grid = cohort_heatmap(cohort, mode)
    return grid.groupBy("tenant_id", "cohort_month", "cohort_size").pivot(
        "months_since", list(range(months + 1))
    ).agg(F.max("value"))


def rfm_segments(rfm: DataFrame) -> DataFrame:
    return (
        rfm.groupBy("tenant_id", F.col("rfm_segment").alias("segment"))
        .agg(
            F.max("as_of").alias("as_of"),
            F.count(F.lit(1)).alias("customers"),
            F.sum("monetary_paise").alias("revenue_paise"),
            F.round(F.avg("recency_days")).cast("long").alias("avg_recency_days"),
            F.round(F.avg("frequency"), 1).alias("avg_frequency"),
            F.bround(F.avg("monetary_paise")).cast("long").alias("avg_monetary_paise"),
        )
        .orderBy("tenant_id", F.desc("revenue_paise"))
    )


def rfm_grid(rfm: DataFrame) -> DataFrame:
    return (
        rfm.groupBy("tenant_id", "r_quintile", "f_quintile")
        .agg(F.count(F.lit(1)).alias("customers"), F.sum("monetary_paise").alias("revenue_paise"))
        .orderBy("tenant_id", F.desc("r_quintile"), F.desc("f_quintile"))
    )


# ------------------------------------------------------------------ revenue, campaigns, leaks


def revenue_monthly(kpis: DataFrame) -> DataFrame:
    return kpis.select(
        "tenant_id", "month", F.col("total_revenue_paise").alias("revenue_paise"), "repeat_revenue_paise",
        "orders", "new_customers", "returning_customers", "repeat_rate", "aov_paise",
    ).orderBy("tenant_id", "month")


def revenue_totals(kpis: DataFrame) -> DataFrame:
    return kpis.groupBy("tenant_id").agg(
        F.sum("total_revenue_paise").alias("revenue_paise"),
        F.sum("repeat_revenue_paise").alias("repeat_revenue_paise"),
    )


def campaign_roi_read(roi: DataFrame) -> DataFrame:
    return roi.orderBy("tenant_id", F.desc("attributed_revenue_paise"), "campaign_id")


def leaks_monthly(leaks: DataFrame, orders: DataFrame) -> DataFrame:
    return (
        _within(leaks, newest_month(orders), WINDOW_MONTHS)
        .select("tenant_id", "month", "leak_type", "amount_paise")
        .orderBy("tenant_id", "month", "leak_type")
    )


def leaks_summary(leaks: DataFrame, kpis: DataFrame, orders: DataFrame) -> DataFrame:
    """Twelve months of leaks by type with shares of revenue and the tenant's total."""
    clock = newest_month(orders)
    by_type = _within(leaks, clock, WINDOW_MONTHS).groupBy("tenant_id", "leak_type").agg(
        F.sum("amount_paise").alias("amount_paise"), F.sum("orders_affected").alias("orders_affected")
    )
    revenue = _within(kpis, clock, WINDOW_MONTHS).groupBy("tenant_id").agg(
        F.sum("total_revenue_paise").alias("revenue")
    )
    total = by_type.groupBy("tenant_id").agg(F.sum("amount_paise").alias("total_paise"))
    gross = F.coalesce("revenue", F.lit(0))
    return (
        by_type.join(total, "tenant_id").join(revenue, "tenant_id", "left")
        .select(
            "tenant_id", "leak_type", "amount_paise", "orders_affected",
            share(F.col("amount_paise"), gross).alias("revenue_share"),
            F.lit(WINDOW_MONTHS).alias("window_months"), "total_paise",
            F.col("total_paise").alias("annualized_paise"),
            share(F.col("total_paise"), gross).alias("total_revenue_share"),
        )
        .orderBy("tenant_id", F.desc("amount_paise"))
    )


# ------------------------------------------------------------------ customers


def customers_page(
    rfm: DataFrame, dim: DataFrame, segment: str | None = None, page: int = 1, page_size: int = 50, page_max: int = PAGE_MAX
) -> DataFrame:
    """One page per tenant, latest buyers first, with the total behind it; at most `page_max` rows."""
    chosen = rfm if segment is None else rfm.where(F.col("rfm_segment") == segment)
    total = chosen.groupBy("tenant_id").agg(F.count(F.lit(1)).alias("total"))
    rows = chosen.select(*CUSTOMER, "rfm_segment", "recency_days").join(
        dim.select(*CUSTOMER, "lifecycle_stage", "orders_count", "total_spent_paise",
                   "first_order_at", "last_order_at", "whatsapp_opted_in"), CUSTOMER)
    cut = _paged(rows, [F.col("last_order_at").desc_nulls_last(), F.col("customer_id")], page, page_size, page_max)
    return cut.join(total, "tenant_id")


def customers_after(
    rfm: DataFrame, dim: DataFrame, last_order_at: str, customer_id: int, segment: str | None = None,
    page_size: int = 50,
) -> DataFrame:
    """The page after a given row; costs the same however deep it lies."""
    at = F.lit(last_order_at).cast("timestamp_ntz")
    later = dim.where(
        (F.col("last_order_at") < at)
        | ((F.col("last_order_at") == at) & (F.col("customer_id") > customer_id))
        | F.col("last_order_at").isNull()
    )
    return customers_page(rfm, later, segment, 1, page_size)


def customer_detail(core: object, rfm: DataFrame) -> DataFrame:
    """Profile of every customer, the one read that carries contact data.

    Filter it by tenant and customer for a single profile; the filter reaches
    every scan. The customer's orders, tickets, reviews and answers are the rows
    of `customer_timeline`, and are never packed into one row.
    """
    name = F.concat_ws(" ", "first_name", "last_name")
    prediction = customer_prediction(core.predictions)
    return (
        core.dim_customers.join(core.customer_pii, CUSTOMER, "left")
        .join(rfm.select(*CUSTOMER, "rfm_segment"), CUSTOMER, "left")
        .join(prediction, CUSTOMER, "left")
        .select(
            *CUSTOMER, F.when(name != "", name).alias("name"),
            F.col("primary_email").alias("email"), F.col("primary_phone").alias("phone"),
            "lifecycle_stage", "rfm_segment", "orders_count", "total_spent_paise",
            "first_order_at", "last_order_at",
            F.col("accepts_email_marketing").alias("consent_email"),
            F.col("whatsapp_opted_in").alias("consent_whatsapp"),
            F.col("sms_opted_in").alias("consent_sms"),
            "p_alive", "expected_orders_90d", "ltv_12m_paise", "churn_band", "model_version", "scored_at",
        )
    )


def customer_timeline(orders: DataFrame, tickets: DataFrame, reviews: DataFrame, nps: DataFrame) -> DataFrame:
    """Orders, tickets, reviews and NPS answers of known customers as one list."""

    def entry(df: DataFrame, kind: str, at: str, key: str, label: Column, number: Column) -> DataFrame:
        return df.where(F.col("customer_id").isNotNull() & F.col(at).isNotNull()).select(
            *CUSTOMER, F.lit(kind).alias("kind"), F.col(at).alias("at"), F.col(key).alias("ref_id"),
            label.alias("label"), number.cast("long").alias("number"),
        )

    none = F.lit(None).cast("string")
    return (
        entry(orders, "order", "placed_at", "order_id", F.col("financial_status"), F.col("total_paise"))
        .unionByName(entry(tickets, "ticket", "opened_at", "ticket_id", F.col("category"), F.col("csat")))
        .unionByName(entry(reviews, "review", "submitted_at", "review_id", none, F.col("rating")))
        .unionByName(entry(nps, "nps", "responded_at", "nps_id", none, F.col("score")))
    )


# ------------------------------------------------------------------ experience, messaging


def cx_summary(cx: DataFrame) -> DataFrame:
    return cx.orderBy("tenant_id", "month")


def latest_cx_month(cx: DataFrame) -> DataFrame:
    rest = [c for c in cx.columns if c not in ("tenant_id", "month")]
    return cx.groupBy("tenant_id").agg(F.max(F.struct("month", *rest)).alias("r")).select("tenant_id", "r.*")


def messaging_summary(messaging: DataFrame) -> DataFrame:
    """Twelve months of WhatsApp: sends, read and reply rate, revenue per conversation."""
    clock = messaging.groupBy("tenant_id").agg(F.max("month").alias("top_month"))
    year = _within(messaging.where("channel = 'whatsapp'"), clock, WINDOW_MONTHS).groupBy("tenant_id").agg(
        *[F.sum(c).alias(c) for c in ("sends", "delivered", "opened_or_read", "clicked", "attributed_revenue_paise")]
    )
    got = lambda c: F.coalesce(c, F.lit(0))
    return clock.join(year, "tenant_id", "left").select(
        "tenant_id", got("sends").alias("sends"),
        share(got("opened_or_read"), got("delivered")).alias("read_rate"),
        share(got("clicked"), got("delivered")).alias("reply_rate"),
        got("attributed_revenue_paise").alias("attributed_revenue_paise"),
        F.coalesce(F.expr("attributed_revenue_paise div nullif(delivered, 0)"), F.lit(0))
        .alias("revenue_per_conversation_paise"),
    )


def channel_rollup(messaging: DataFrame) -> DataFrame:
    summed = ("sends", "delivered", "opened_or_read", "clicked", "bounced", "attributed_orders",
              "attributed_revenue_paise")
    return messaging.groupBy("tenant_id", "channel").agg(*[F.sum(c).alias(c) for c in summed]).orderBy(
        "tenant_id", F.desc("attributed_revenue_paise")
    )


def automation_summary(automation: DataFrame) -> DataFrame:
    place = F.create_map(*[F.lit(x) for i, (m, _) in enumerate(MOMENTS) for x in (m, i)])
    return automation.withColumn("ordinal", place[F.col("moment")]).orderBy("tenant_id", "ordinal")


# ------------------------------------------------------------------ experiments


def experiments_list(experiments: DataFrame) -> DataFrame:
    return experiments.select(
        "tenant_id", "experiment_id", "name", "hypothesis", "score_target", "status", "started_at",
        "concluded_at", "sample_size", "lift_pct", "significant", "decision",
    ).orderBy("tenant_id", F.col("started_at").desc_nulls_last(), F.desc("experiment_id"))


def experiment_cadence(facts: DataFrame) -> DataFrame:
    return (
        facts.where(F.col("started_month").isNotNull() & (F.col("status") != "draft"))
        .groupBy("tenant_id", F.col("started_month").alias("month"))
        .agg(F.count(F.lit(1)).alias("experiments")).orderBy("tenant_id", "month")
    )


def cadence_gap_fill(cadence: DataFrame) -> DataFrame:
    """The same series with a zero for every month in between."""
    span = cadence.groupBy("tenant_id").agg(F.min("month").alias("lo"), F.max("month").alias("hi"))
    spine = span.select("tenant_id", F.explode(F.sequence("lo", "hi", F.expr("INTERVAL 1 MONTH"))).alias("month"))
    return spine.join(cadence, ["tenant_id", "month"], "left").select(
        "tenant_id", "month", F.coalesce("experiments", F.lit(0)).alias("experiments")
    )


def experiment_outcomes(experiments: DataFrame) -> DataFrame:
    ended = F.col("status") == "concluded"
    return experiments.groupBy("tenant_id").agg(
        *[F.count_if(F.col("status") == s).alias(s) for s in ("draft", "running", "concluded")],
        F.count_if(ended & (F.col("decision") == "shipped")).alias("shipped"),
        F.count_if(ended & (F.col("decision") == "killed")).alias("killed"),
    )


# ------------------------------------------------------------------ predictions


def latest_predictions(predictions: DataFrame) -> DataFrame:
    """Rows of each tenant's newest scoring run: its version and its day."""
    newest = predictions.groupBy("tenant_id").agg(
        F.max(F.struct("scored_at", "model_version", "scored_on")).alias("n")
    ).select("tenant_id", "n.model_version", "n.scored_on")
    return predictions.join(newest, ["tenant_id", "model_version", "scored_on"])


def predictions_summary(predictions: DataFrame) -> DataFrame:
    """Band counts, expected orders, value deciles and value at risk of the newest run."""
    rows = latest_predictions(predictions)
    high = F.col("churn_band") == "high"
    main = rows.groupBy("tenant_id", "model_version").agg(
        F.max("scored_at").alias("scored_at"),
        F.count(F.lit(1)).alias("customers_scored"),
        *[F.count_if(F.col("churn_band") == b).alias(f"band_{b}") for b in ("high", "medium", "low")],
        F.sum("expected_orders_90d").alias("expected_orders_90d_total"),
        F.coalesce(F.sum(F.when(high, F.col("ltv_12m_paise"))), F.lit(0)).alias("at_risk_ltv_paise"),
    )
    deciles = ranked_values(rows, ["tenant_id"], "ltv_12m_paise").groupBy("tenant_id").agg(
        *[value_at("ltv_12m_paise", F.expr(f"({i} * total) div 10")).alias(f"ltv_decile_{i}") for i in range(10)]
    )
    return main.join(deciles, "tenant_id")


def predictions_top_risk(
    predictions: DataFrame, dim: DataFrame, rfm: DataFrame, page: int = 1, page_size: int = 50
) -> DataFrame:
    """A page per tenant of high-risk customers, most valuable first."""
    high = latest_predictions(predictions).where("churn_band = 'high'")
    total = high.groupBy("tenant_id").agg(F.count(F.lit(1)).alias("total"))
    rows = high.select(*CUSTOMER, "p_alive", "expected_orders_90d", "ltv_12m_paise", "churn_band")
    cut = _paged(rows, [F.col("ltv_12m_paise").desc(), F.col("customer_id")], page, page_size)
    return (
        cut.join(dim.select(*CUSTOMER, "lifecycle_stage", "orders_count", "total_spent_paise"), CUSTOMER, "left")
        .join(rfm.select(*CUSTOMER, "rfm_segment"), CUSTOMER, "left")
        .join(total, "tenant_id")
    )


def customer_prediction(predictions: DataFrame) -> DataFrame:
    """Newest prediction per customer."""
    fields = ("scored_at", "p_alive", "expected_orders_90d", "ltv_12m_paise", "churn_band", "model_version")
    return predictions.groupBy(*CUSTOMER).agg(F.max(F.struct(*fields)).alias("p")).select(*CUSTOMER, "p.*")


# ------------------------------------------------------------------ tenants


def tenants_list(tenants: DataFrame) -> DataFrame:
    return tenants.orderBy("tenant_id")


def tenant_lookup(tenants: DataFrame, ref: str | int) -> DataFrame:
    """By id when the reference is a number, else by slug."""
    text = str(ref)
    if text.isdigit():
        return tenants.where(F.col("tenant_id") == int(text))
    return tenants.where(F.col("slug") == text)
