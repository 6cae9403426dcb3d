"""Nine 0-100 health scores and their composite, as columns on a tenant row.

A score is a list of components: a weight, a 0-100 curve over one input, the
raw input itself and a sentence that explains it.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from patronage.functions import clamp, linear, mean_observed, py_round
from patronage.plans.marts import MOMENTS
from patronage.plans.reads import COMPOSITE, SCORE_NAMES, SECOND_PHASE

VERSION = "v2.0"

# Weight, worst and best of every component, and the weights of
# the nine scores in the composite.
GRAVITY = {
    "repeat_rate_90d": (40, 0.05, 0.35),
    "repurchase_latency": (25, 120.0, 40.0),
    "cohort_decay": (25, 0.04, 0.25),
    "repeat_revenue_share": (10, 0.10, 0.45),
}
FLOW = {
    "stage_distribution": (35, 0.08, 0.40),
    "new_to_active_velocity": (30, 0.05, 0.30),
    "slipping_to_dormant_leak": (25, 0.95, 0.50),
    "reactivation_rate": (10, 0.0, 0.12),
}
SIGNAL = {
    "identity_resolution_rate": (35, 0.60, 0.98),
    "field_completeness": (25, 0.50, 1.0),
    "cross_source_reconciliation": (25, 0.70, 0.99),
    "history_depth": (15, 0.0, 18.0),
}
WATERTIGHT = {  # weight and the 90th-percentile share of revenue
    "preventable_churn": (40, 0.08),
    "rto_cod": (30, 0.06),
    "failed_payments": (15, 0.02),
    "discount_abuse": (15, 0.03),
}
VITALS_WEIGHTS = {"deliverability": 30, "whatsapp_optin": 25, "list_hygiene_consent": 25, "flow_integrity": 20}
VITALS_BOUNDS = {
    "email_bounce": (0.05, 0.005),
    "email_unsub": (0.02, 0.001),
    "whatsapp_optin": (0.05, 0.45),
    "whatsapp_fail": (0.10, 0.01),
    "consent_backed": (0.40, 0.95),
    "revoke_violation": (0.01, 0.0),
}
VELOCITY_WEIGHTS = {"cadence": 35, "validity": 35, "follow_through": 30}
MONTHLY_STARTS = 2.0
AUTOPILOT_WEIGHTS = {"moment_coverage": 50, "automated_revenue_share": 30, "flow_performance": 20}
MOMENT_WEIGHTS = {
    "welcome": 25, "winback": 20, "post_purchase": 15, "replenishment": 15, "cod_confirmation": 15,
    "abandoned_checkout": 10,
}
AUTOPILOT_BOUNDS = {"share": (0.05, 0.50), "ratio": (1.0, 3.0)}
PULSE_WEIGHTS = {"delivery_speed": 30, "rto_ndr": 30, "support": 20, "reviews_nps": 20}
PULSE_BOUNDS = {
    "delivery": (11.0, 5.0), "rto": (0.20, 0.03), "resolution": (72.0, 12.0), "breach": (0.30, 0.0),
    "csat": (3.0, 4.8), "rating": (3.2, 4.6), "nps": (-20.0, 70.0),
}
ALTITUDE_WEIGHTS = {"maturity_position": 40, "decision_hygiene": 30, "capability": 20, "executive_engagement": 10}
SIGNAL_FLOOR, SIGNAL_FULL = 40.0, 70.0
CONCLUDED_FULL, WINNERS_FULL, STREAK_FULL = 6, 3, 6.0
COMPOSITE_WEIGHTS = {
    "gravity": 20, "flow": 12, "signal": 12, "watertight": 12, "vitals": 10, "velocity": 10, "pulse": 10,
    "autopilot": 8, "altitude": 6,
}


@dataclass(frozen=True)
class Part:
    """One component of a score."""

    name: str
    weight: int
    sub: Column
    raw: Column
    note: Column


def _value(parts: list[Part]) -> Column:
    total = reduce(lambda a, b: a + b, [p.sub * float(p.weight) for p in parts])
    return py_round(total / 100.0)


def _num(column: str) -> Column:
    return F.coalesce(F.col(column), F.lit(0)).cast("double")


def _pct(value: Column, digits: int = 1) -> Column:
    return F.concat(F.format_string(f"%.{digits}f", F.coalesce(value, F.lit(0.0)) * 100.0), F.lit("%"))


def _note(what: Column, weight: int, *more: str) -> Column:
    return F.concat(what, F.lit("".join(f", {m}" for m in more) + f" (weight {weight}%)"))


def _simple(spec: dict, sources: dict, text: dict, missing: dict) -> list[Part]:
    """Components that are one curve over one input; `missing` gives the sub-score of a null."""
    parts = []
    for name, (weight, worst, best) in spec.items():
        raw = F.col(sources[name]).cast("double")
        if name in missing:
            sub = F.when(raw.isNull(), F.lit(missing[name])).otherwise(linear(raw, worst, best))
        else:
            sub = linear(F.coalesce(raw, F.lit(0.0)), worst, best)
        said = F.when(raw.isNull(), F.lit(f"{text[name]}: nothing observed")).otherwise(
            F.concat(F.lit(f"{text[name]}: "), F.format_string("%.4g", raw))
        )
        parts.append(Part(name, weight, sub, raw, _note(said, weight, f"0 at {worst:g}", f"100 at {best:g}")))
    return parts


def gravity_parts() -> list[Part]:
    return _simple(
        GRAVITY,
        {"repeat_rate_90d": "repeat_rate_90d", "repurchase_latency": "median_repurchase_days",
         "cohort_decay": "avg_m3_retention", "repeat_revenue_share": "repeat_revenue_share"},
        {"repeat_rate_90d": "share of customers back within 90 days",
         "repurchase_latency": "median days to a second order", "cohort_decay": "month-3 retention",
         "repeat_revenue_share": "repeat share of a year's revenue"},
        {"repurchase_latency": 0.0},
    )


def flow_parts() -> list[Part]:
    return _simple(
        FLOW,
        {"stage_distribution": "healthy_stage_share", "new_to_active_velocity": "new_to_active_rate",
         "slipping_to_dormant_leak": "slipping_to_dormant_rate", "reactivation_rate": "reactivation_rate"},
        {"stage_distribution": "share of buyers active or loyal",
         "new_to_active_velocity": "second orders among those acquired 3-6 months ago",
         "slipping_to_dormant_leak": "slipping customers lost within 3 months",
         "reactivation_rate": "dormant customers back within 3 months"},
        {"slipping_to_dormant_leak": 100.0, "reactivation_rate": 100.0},
    )


def signal_parts() -> list[Part]:
    return _simple(
        SIGNAL,
        {"identity_resolution_rate": "identity_resolution_rate", "field_completeness": "field_completeness",
         "cross_source_reconciliation": "payment_match_rate", "history_depth": "history_months"},
        {"identity_resolution_rate": "orders with a known customer",
         "field_completeness": "customers with phone and e-mail",
         "cross_source_reconciliation": "prepaid orders with a captured payment",
         "history_depth": "months of history"},
        {},
    )


def watertight_parts() -> list[Part]:
    parts = []
    gross = F.col("gross_revenue_paise")
    for name, (weight, p90) in WATERTIGHT.items():
        amount = _num(f"leak_{name}_paise")
        lost = F.when(gross > 0, amount / gross).otherwise(0.0)
        sub = clamp(100.0 * (1.0 - F.least(lost, F.lit(p90)) / p90))
        said = F.concat(_pct(lost, 2), F.lit(f" of a year's revenue lost to {name}"))
        parts.append(Part(name, weight, sub, amount, _note(said, weight, f"0 at {p90:g}")))
    return parts


def vitals_parts() -> list[Part]:
    bound = VITALS_BOUNDS
    bounce, unsub = F.col("email_bounce_rate"), F.coalesce("email_unsub_rate", F.lit(0.0))
    optin, fail = _num("whatsapp_optin_share"), F.col("whatsapp_fail_rate")
    backed = F.col("consent_backed_share")
    violations, sends = _num("sends_after_revoke"), _num("total_sends")
    flows, live = _num("flows_total"), _num("flows_active_60d")
    deliver = F.when(bounce.isNull(), F.lit(0.0)).otherwise(
        0.7 * linear(bounce, *bound["email_bounce"]) + 0.3 * linear(unsub, *bound["email_unsub"])
    )
    opt = linear(optin, *bound["whatsapp_optin"])
    whatsapp = 0.7 * opt + 0.3 * F.when(fail.isNull(), opt).otherwise(linear(fail, *bound["whatsapp_fail"]))
    grant = F.when(backed.isNull(), F.lit(0.0)).otherwise(linear(backed, *bound["consent_backed"]))
    breach = F.when(sends > 0, violations / sends).otherwise(0.0)
    hygiene = 0.5 * grant + 0.5 * linear(breach, *bound["revoke_violation"])
    running = F.when(flows > 0, live / flows)
    w = VITALS_WEIGHTS
    return [
        Part("deliverability", w["deliverability"], deliver, bounce,
             _note(F.concat(F.lit("e-mail bounces "), _pct(bounce, 2), F.lit(", unsubscribes "), _pct(unsub, 2)), 30)),
        Part("whatsapp_optin", w["whatsapp_optin"], whatsapp, optin,
             _note(F.concat(F.lit("WhatsApp opt-in "), _pct(optin), F.lit(", failed sends "), _pct(fail)), 25)),
        Part("list_hygiene_consent", w["list_hygiene_consent"], hygiene, backed,
             _note(F.concat(F.lit("flags backed by a grant "), _pct(backed), F.lit(", sends after revocation "),
                            violations.cast("long").cast("string")), 25)),
        Part("flow_integrity", w["flow_integrity"], F.coalesce(100.0 * live / F.when(flows > 0, flows), F.lit(0.0)),
             running, _note(F.concat(F.lit("flows that sent lately "), _pct(running, 0)), 20)),
    ]


def velocity_parts() -> list[Part]:
    per_month = _num("starts_6mo") / 6.0
    done = F.when(_num("concluded") > 0, _num("concluded"))
    w = VELOCITY_WEIGHTS

    def of_done(column: str) -> Column:
        return F.coalesce(clamp(100.0 * _num(column) / done), F.lit(0.0))

    return [
        Part("cadence", w["cadence"], linear(per_month, 0.0, MONTHLY_STARTS), per_month,
             _note(F.concat(F.format_string("%.2f", per_month), F.lit(" experiments started a month")), 35)),
        Part("validity", w["validity"], of_done("concluded_valid"), _num("concluded_valid") / done,
             _note(F.concat(F.lit("conclusions with significance and sample "), _pct(_num("concluded_valid") / done)), 35)),
        Part("follow_through", w["follow_through"], of_done("concluded_decided"), _num("concluded_decided") / done,
             _note(F.concat(F.lit("conclusions shipped or killed "), _pct(_num("concluded_decided") / done)), 30)),
    ]


def autopilot_parts() -> list[Part]:
    covered = F.col("covered_moments")
    coverage = reduce(
        lambda a, b: a + b,
        [F.when(F.array_contains(covered, m), float(v)).otherwise(0.0) for m, v in MOMENT_WEIGHTS.items()],
    )
    share = F.col("automated_revenue_share")
    flow, blast = _num("flow_revenue_per_send_paise"), _num("campaign_revenue_per_send_paise")
    ratio = F.when((flow != 0) & (blast != 0), flow / F.when(blast != 0, blast))
    perform = F.when(flow == 0, F.lit(0.0)).when(blast == 0, F.lit(100.0)).otherwise(
        linear(ratio, *AUTOPILOT_BOUNDS["ratio"])
    )
    w = AUTOPILOT_WEIGHTS
    return [
        Part("moment_coverage", w["moment_coverage"], coverage, F.size(covered).cast("double"),
             _note(F.concat(F.size(covered).cast("string"), F.lit(f" of {len(MOMENTS)} moments covered: "),
                            F.array_join(covered, ", ")), 50)),
        Part("automated_revenue_share", w["automated_revenue_share"],
             F.when(share.isNull(), F.lit(0.0)).otherwise(linear(share, *AUTOPILOT_BOUNDS["share"])), share,
             _note(F.concat(F.lit("flows earn "), _pct(share), F.lit(" of credited revenue")), 30)),
        Part("flow_performance", w["flow_performance"], perform, ratio,
             _note(F.concat(F.lit("flow over campaign revenue per send: "),
                            F.coalesce(F.format_string("%.2f", ratio), F.lit("not comparable"))), 20)),
    ]


def pulse_parts() -> list[Part]:
    def curve(column: str, bound: str) -> Column:
        return F.when(F.col(column).isNotNull(), linear(F.col(column), *PULSE_BOUNDS[bound]))

    def said(text: str, column: str) -> Column:
        return F.concat(F.lit(f"{text} "), F.coalesce(F.format_string("%.4g", F.col(column)), F.lit("not observed")))

    w = PULSE_WEIGHTS
    return [
        Part("delivery_speed", w["delivery_speed"], F.coalesce(curve("median_delivery_days", "delivery"), F.lit(0.0)),
             F.col("median_delivery_days"), _note(said("median days in transit", "median_delivery_days"), 30)),
        Part("rto_ndr", w["rto_ndr"], F.coalesce(curve("rto_rate", "rto"), F.lit(0.0)), F.col("rto_rate"),
             _note(said("returned-to-origin share", "rto_rate"), 30)),
        Part("support", w["support"],
             mean_observed(curve("median_resolution_hours", "resolution"), curve("breach_rate", "breach"),
                           curve("avg_csat", "csat")),
             F.col("median_resolution_hours"),
             _note(F.concat_ws(", ", said("hours to resolve", "median_resolution_hours"),
                               said("breach share", "breach_rate"), said("CSAT", "avg_csat")), 20)),
        Part("reviews_nps", w["reviews_nps"], mean_observed(curve("avg_review_rating", "rating"), curve("nps", "nps")),
             F.col("avg_review_rating"),
             _note(F.concat_ws(", ", said("review rating", "avg_review_rating"), said("NPS", "nps")), 20)),
    ]


def altitude_parts(signal: Column) -> list[Part]:
    """`signal` is the signal score of the same run, null when it was skipped."""
    trust = F.coalesce(25.0 * linear(signal, SIGNAL_FLOOR, SIGNAL_FULL) / 100.0, F.lit(0.0))
    trust = F.when(signal.isNull(), F.lit(0.0)).otherwise(trust)
    report = F.when(F.col("marts_built"), 25.0).otherwise(0.0)
    some = _num("predictions_rows") > 0
    predict = F.when(some & F.col("predictions_fresh"), 25.0).when(some, 12.5).otherwise(0.0)
    compound = 12.5 * F.least(_num("concluded_6mo") / CONCLUDED_FULL, F.lit(1.0)) + 12.5 * F.least(
        _num("winners_shipped") / WINNERS_FULL, F.lit(1.0)
    )
    ladder = trust + report + predict + compound
    cadence = _num("cadence_starts_6mo") / 6.0
    flows = _num("flows_total")
    live = F.coalesce(_num("flows_active_60d") / F.when(flows > 0, flows), F.lit(0.0))
    decided = F.col("decided_share")
    streak = _num("monthly_run_streak")
    w = ALTITUDE_WEIGHTS
    return [
        Part("maturity_position", w["maturity_position"], ladder, ladder,
             _note(F.format_string("rungs of 25: data %.1f, reporting %.1f, predictive %.1f, compounding %.1f",
                                   trust, report, predict, compound), 40)),
        Part("decision_hygiene", w["decision_hygiene"], F.coalesce(100.0 * decided, F.lit(0.0)), decided,
             _note(F.concat(F.lit("conclusions with hypothesis and decision "), _pct(decided, 0)), 30)),
        Part("capability", w["capability"], 0.5 * linear(cadence, 0.0, MONTHLY_STARTS) + 0.5 * (100.0 * live), cadence,
             _note(F.concat(F.format_string("%.2f", cadence), F.lit(" experiments a month, flows sending "), _pct(live, 0)), 20)),
        Part("executive_engagement", w["executive_engagement"], linear(streak, 0.0, STREAK_FULL), streak,
             _note(F.concat(streak.cast("long").cast("string"), F.lit(" months in a row with a run")), 10)),
    ]


PARTS = {
    "gravity": gravity_parts, "flow": flow_parts, "signal": signal_parts, "watertight": watertight_parts,
    "vitals": vitals_parts, "velocity": velocity_parts, "autopilot": autopilot_parts, "pulse": pulse_parts,
}


def parts_of(score: str, signal: Column | None = None) -> list[Part]:
    if score == "altitude":
        return altitude_parts(F.col("signal") if signal is None else signal)
    return PARTS[score]()


def scored(df: DataFrame, score: str) -> DataFrame:
    """Add the score's value under its own name, and each component as `<score>_<component>`."""
    parts = parts_of(score)
    return df.withColumns(
        {score: _value(parts), **{f"{score}_{p.name}": py_round(p.sub) for p in parts}}
    )


def composite_value() -> Column:
    """Weighted mean of the scores that exist; 0 when none does."""
    weight = reduce(
        lambda a, b: a + b,
        [F.when(F.col(n).isNotNull(), float(w)).otherwise(0.0) for n, w in COMPOSITE_WEIGHTS.items()],
    )
    total = reduce(
        lambda a, b: a + b, [F.coalesce(F.col(n) * float(w), F.lit(0.0)) for n, w in COMPOSITE_WEIGHTS.items()]
    )
    return F.coalesce(py_round(clamp(total / F.when(weight > 0, weight))), F.lit(0.0))


def composite(df: DataFrame) -> DataFrame:
    """Add composite, coverage `k/9` and the list of missing scores."""
    absent = F.array_compact(F.array(*[F.when(F.col(n).isNull(), F.lit(n)) for n in COMPOSITE_WEIGHTS]))
    return df.withColumns({
        COMPOSITE: composite_value(),
        "missing": absent,
        "coverage": F.concat((F.lit(len(COMPOSITE_WEIGHTS)) - F.size(absent)).cast("string"),
                             F.lit(f"/{len(COMPOSITE_WEIGHTS)}")),
    })


# Inputs each score is hashed over, so that equal inputs mean an equal hash.
INPUTS = {
    "gravity": ("avg_m3_retention", "median_repurchase_days", "repeat_rate_90d", "repeat_revenue_share"),
    "flow": ("healthy_stage_share", "new_to_active_rate", "reactivation_rate", "slipping_to_dormant_rate"),
    "signal": ("field_completeness", "history_months", "identity_resolution_rate", "payment_match_rate"),
    "watertight": ("gross_revenue_paise", *sorted(f"leak_{k}_paise" for k in WATERTIGHT)),
    "vitals": ("consent_backed_share", "email_bounce_rate", "email_unsub_rate", "flows_active_60d", "flows_total",
               "sends_after_revoke", "total_sends", "whatsapp_fail_rate", "whatsapp_optin_share"),
    "velocity": ("concluded", "concluded_decided", "concluded_valid", "starts_6mo"),
    "autopilot": ("automated_revenue_share", "campaign_revenue_per_send_paise", "covered_moments",
                  "flow_revenue_per_send_paise", "moments_covered", "moments_total"),
    "pulse": ("avg_csat", "avg_review_rating", "avg_review_rating_prev_6mo", "breach_rate", "median_delivery_days",
              "median_resolution_hours", "nps", "rto_rate"),
    "altitude": ("cadence_starts_6mo", "concluded_6mo", "decided_share", "flows_active_60d", "flows_total",
                 "marts_built", "monthly_run_streak", "predictions_fresh", "predictions_rows", "signal",
                 "winners_shipped"),
}


def all_scores(inputs: DataFrame) -> DataFrame:
    """Every score and the composite; the second phase is skipped where there are no orders."""
    df = inputs
    for name in SCORE_NAMES:
        value = _value(parts_of(name))
        known = F.col("has_orders") if name in SECOND_PHASE else F.lit(True)
        df = df.withColumn(name, F.when(known, value))
    return composite(df)


def score_components(df: DataFrame) -> DataFrame:
    """Long form: sub-score, raw input and note of every component of every computed score."""
    rows = F.array(*[
        F.when(F.col(name).isNotNull(), F.struct(
            F.lit(name).alias("score"), F.lit(p.name).alias("component"), F.lit(p.weight).alias("weight"),
            py_round(p.sub).alias("sub_score"), p.raw.cast("double").alias("raw"), p.note.alias("note"),
        ))
        for name in SCORE_NAMES for p in parts_of(name)
    ])
    return df.select("tenant_id", F.explode(F.array_compact(rows)).alias("c")).select("tenant_id", "c.*")


def score_runs(df: DataFrame, computed_at: str) -> DataFrame:
    """Rows to append to the run ledger: one per computed score, and the composite."""

    def hashed(columns: tuple[str, ...]) -> Column:
        return F.sha2(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}), 256)

    def detail(name: str) -> Column:
        return F.to_json(F.map_from_arrays(
            F.array(*[F.lit(p.name) for p in parts_of(name)]),
            F.array(*[F.struct(py_round(p.sub).alias("sub_score"), p.raw.cast("double").alias("raw"),
                               p.note.alias("note")) for p in parts_of(name)]),
        ))

    runs = [
        F.when(F.col(n).isNotNull(), F.struct(
            F.lit(n).alias("score"), F.col(n).alias("value"), hashed(INPUTS[n]).alias("inputs_hash"),
            detail(n).alias("components"),
        ))
        for n in SCORE_NAMES
    ]
    runs.append(F.struct(
        F.lit(COMPOSITE).alias("score"), F.col(COMPOSITE).alias("value"),
        hashed(SCORE_NAMES).alias("inputs_hash"),
        F.to_json(F.struct("coverage", "missing")).alias("components"),
    ))
    return df.select("tenant_id", F.explode(F.array_compact(F.array(*runs))).alias("r")).select(
        "tenant_id", "r.score", "r.value", F.lit(computed_at).cast("timestamp_ntz").alias("computed_at"),
        F.lit(VERSION).alias("definition_version"), "r.inputs_hash", "r.components",
    )
