import pytest
from pyspark.sql import functions as F

from patronage.functions import linear, score_band
from patronage.plans import scores
from patronage.plans.score_inputs import NO_ORDERS, monthly_run_streak
from tests import fixtures as fx

# Raw inputs half-way between worst and best of every curve.
MIDDLE = {
    "gravity": {"repeat_rate_90d": 0.20, "median_repurchase_days": 80.0, "avg_m3_retention": 0.145, "repeat_revenue_share": 0.275},
    "flow": {"healthy_stage_share": 0.24, "new_to_active_rate": 0.175, "slipping_to_dormant_rate": 0.725, "reactivation_rate": 0.06},
    "signal": {"identity_resolution_rate": 0.79, "field_completeness": 0.75, "payment_match_rate": 0.845, "history_months": 9.0},
    "watertight": {"gross_revenue_paise": 1000000, "leak_preventable_churn_paise": 40000, "leak_rto_cod_paise": 30000,
                   "leak_failed_payments_paise": 10000, "leak_discount_abuse_paise": 15000},
    "vitals": {"email_bounce_rate": 0.0275, "email_unsub_rate": 0.0105, "whatsapp_optin_share": 0.25, "whatsapp_fail_rate": 0.055,
               "consent_backed_share": 0.675, "sends_after_revoke": 5, "total_sends": 1000, "flows_total": 4, "flows_active_60d": 2},
    "velocity": {"starts_6mo": 6, "concluded": 4, "concluded_valid": 2, "concluded_decided": 2},
    "pulse": {"median_delivery_days": 8.0, "rto_rate": 0.115, "median_resolution_hours": 42.0, "breach_rate": 0.15, "avg_csat": 3.9,
              "avg_review_rating": 3.9, "nps": 25.0, "avg_review_rating_prev_6mo": 3.9},
}


def frame(spark, values):
    kinds = {float: "double", int: "long", bool: "boolean", type(None): "double"}
    cols = [F.array(*[F.lit(x) for x in v]).cast("array<string>").alias(k) if isinstance(v, list)
            else F.lit(v).cast(kinds[type(v)]).alias(k) for k, v in values.items()]
    return spark.range(1).select(F.lit(1).cast("long").alias("tenant_id"), *cols)


def value(spark, name, **inputs):
    return scores.scored(frame(spark, inputs), name).first()[name]


@pytest.mark.parametrize("raw,worst,best,want", [
    (0.2, 0.05, 0.35, 50.0), (0.0, 0.05, 0.35, 0.0), (1.0, 0.05, 0.35, 100.0), (80, 120, 40, 50.0), (200, 120, 40, 0.0), (1, 2, 2, 100.0)])
def test_linear(spark, raw, worst, best, want):
    assert spark.range(1).select(linear(F.lit(float(raw)), worst, best)).first()[0] == pytest.approx(want)


@pytest.mark.parametrize("name", sorted(MIDDLE))
def test_middle_is_fifty(spark, name):
    assert value(spark, name, **MIDDLE[name]) == pytest.approx(50.0)


def test_watertight_cap_and_no_revenue(spark):
    leak = {**MIDDLE["watertight"], **{k: 0 for k in MIDDLE["watertight"] if k.startswith("leak")}}
    assert value(spark, "watertight", **{**leak, "leak_rto_cod_paise": 10**9}) == 70.0
    assert value(spark, "watertight", **{**leak, "gross_revenue_paise": 0}) == 100.0


def test_unknown_rates(spark):
    assert value(spark, "flow", **{**MIDDLE["flow"], "slipping_to_dormant_rate": None, "reactivation_rate": None}) == 67.5
    assert value(spark, "gravity", **{**MIDDLE["gravity"], "median_repurchase_days": None}) == 37.5
    assert value(spark, "pulse", **{k: None for k in MIDDLE["pulse"]}) == 0.0
    assert value(spark, "velocity", starts_6mo=12, concluded=0, concluded_valid=0, concluded_decided=0) == 35.0


def test_autopilot(spark):
    have = {"automated_revenue_share": 0.275, "flow_revenue_per_send_paise": 200, "campaign_revenue_per_send_paise": 100,
            "covered_moments": ["welcome", "winback", "post_purchase"]}
    assert value(spark, "autopilot", **have) == 55.0
    assert value(spark, "autopilot", **{**have, "campaign_revenue_per_send_paise": 0}) == 65.0
    assert value(spark, "autopilot", **{**have, "flow_revenue_per_send_paise": 0}) == 45.0


def test_altitude(spark):
    have = {"signal": 70.0, "marts_built": True, "predictions_rows": 10, "predictions_fresh": False, "concluded_6mo": 3,
            "winners_shipped": 0, "decided_share": 0.5, "cadence_starts_6mo": 6, "flows_total": 2, "flows_active_60d": 1,
            "monthly_run_streak": 3}
    # ladder 25 + 25 + 12.5 + 6.25, decisions 50, capability 50, streak 50
    assert value(spark, "altitude", **have) == pytest.approx(57.5)
    assert value(spark, "altitude", **{**have, "signal": None}) == pytest.approx(47.5)


def composite(spark, **values):
    full = {n: values.get(n) for n in scores.COMPOSITE_WEIGHTS}
    return scores.composite(frame(spark, full)).first()


def test_composite(spark):
    four = composite(spark, gravity=80.0, flow=60.0, signal=70.0, watertight=40.0)
    assert four.composite == pytest.approx(round((80 * 20 + 60 * 12 + 70 * 12 + 40 * 12) / 56, 1)) and four.coverage == "4/9"
    nine = composite(spark, gravity=80.0, **{n: 60.0 for n in scores.COMPOSITE_WEIGHTS if n != "gravity"})
    assert (nine.composite, nine.coverage, nine.missing) == (64.0, "9/9", [])
    none = composite(spark)
    assert (none.composite, none.coverage, len(none.missing)) == (0.0, "0/9", 9)


def test_weights_add_up():
    assert sum(scores.COMPOSITE_WEIGHTS.values()) == 100
    for spec in (scores.VITALS_WEIGHTS, scores.VELOCITY_WEIGHTS, scores.AUTOPILOT_WEIGHTS, scores.PULSE_WEIGHTS,
                 scores.ALTITUDE_WEIGHTS, scores.MOMENT_WEIGHTS):
        assert sum(spec.values()) == 100
    for spec in (scores.GRAVITY, scores.FLOW, scores.SIGNAL, scores.WATERTIGHT):
        assert sum(v[0] for v in spec.values()) == 100


def test_hash_follows_inputs(spark):
    base = {"has_orders": False}
    for n in ("gravity", "flow", "signal", "watertight"):
        base.update(NO_ORDERS[n])
    for n in ("vitals", "velocity", "pulse"):
        base.update(MIDDLE[n])
    base.update({"automated_revenue_share": 0.1, "flow_revenue_per_send_paise": 1, "campaign_revenue_per_send_paise": 1,
                 "covered_moments": ["welcome"], "moments_covered": 1, "moments_total": 6, "marts_built": True,
                 "predictions_rows": 0, "predictions_fresh": False, "concluded_6mo": 0, "winners_shipped": 0,
                 "decided_share": 0.0, "cadence_starts_6mo": 0, "monthly_run_streak": 0})

    def runs(values):
        return {r.score: r for r in scores.score_runs(scores.all_scores(frame(spark, values)), "2026-01-01 00:00:00").collect()}

    one, same, other = runs(base), runs(base), runs({**base, "repeat_rate_90d": 0.3})
    assert set(one) == {"gravity", "flow", "signal", "watertight", "composite"}
    assert all(one[s].inputs_hash == same[s].inputs_hash for s in one)
    assert one["gravity"].inputs_hash != other["gravity"].inputs_hash and one["flow"].inputs_hash == other["flow"].inputs_hash


def test_streak_breaks_at_a_gap(spark):
    runs = spark.createDataFrame([(1, i, "gravity", 1.0, fx.at(f"2026-{m:02d}-03"), "v") for i, m in enumerate((1, 2, 4, 5, 5, 6))], fx.RUN)
    assert monthly_run_streak(runs).first().monthly_run_streak == 3


def test_bands(spark):
    df = spark.createDataFrame([(v,) for v in (0.0, 39.9, 40.0, 69.9, 70.0)], "v double")
    assert [r[0] for r in df.select(score_band(F.col("v"))).collect()] == ["leaking", "leaking", "building", "building", "compounding"]
