"""No plan may hold the tables behind a score or a read again and again: the driver keeps every plan whole."""

import pytest

from checks import registry

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["gravity_inputs", "score_gravity", "no_orders_defaults", "overview_kpis"])
def test_scans_of_one_plan(spark, name):
    plan = registry.queries()[name](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Relation [") <= 40, name


def test_catalogue_is_not_broadcast(spark):
    """Exploded per tenant, it is many times what the planner takes it for."""
    plan = registry.queries()["map_order_items"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert not [line for line in plan.splitlines() if "BroadcastHashJoin" in line and ("p_ext" in line or "v_ext" in line)]


def test_payloads_are_dealt_out_before_the_newest_is_sorted_out(spark):
    plan = registry.queries()["map_products"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert "RepartitionByExpression" in plan


def test_events_are_dealt_out_before_the_last_written_is_sorted_out(spark):
    """No sort in the tasks that make the events: the first sorting step comes after the exchange."""
    plan = registry.queries()["export_events"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert "RepartitionByExpression [event_id" in plan


@pytest.mark.parametrize("name", ["score_components"])
def test_scores_read_stored_inputs(spark, name):
    """What the scores are computed from is stored score by score: the last plan reads the list of tenants and none of the large tables."""
    plan = registry.queries()[name](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert "Relation [o_" not in plan and "Relation [event_id" not in plan and "Relation [c_custkey" not in plan


def test_messages_are_dealt_out_before_their_text_is_made(spark):
    """The exchange lies below the step that makes the JSON text, so a small file of events is not written and parsed in one task."""
    from patronage.sources.payloads import Payloads
    from patronage.sources.tables import Tables

    plan = Payloads(Tables(spark, SF)).messages("klaviyo")._jdf.queryExecution().optimizedPlan().toString()
    assert "RepartitionByExpression" in plan and plan.index("payload#") < plan.index("RepartitionByExpression")


def test_items_are_not_sorted_for_churn_features(spark):
    """Six joins of the features hash the side with a row per key; the items and the customers stream past."""
    plan = registry.queries()["churn_features"](spark, SF)._jdf.queryExecution().sparkPlan().toString()
    assert plan.count("ShuffledHashJoin") >= 6
