"""The registered queries against DuckDB on the smallest tables, and the driver contract."""

import pytest

from checks import registry
from checks.run import compare, connect
from tests.conftest import SF

QUICK = [
    "valid_orders", "recompute_customer_stats", "rfm_current", "cohort_retention", "retention_facts", "executive_kpis", "leak_facts",
    "campaign_roi", "messaging_facts", "cx_facts", "automation_facts", "leaks_summary", "customers_page", "predictions_summary",
    "scores_latest", "sends_after_revoke", "score_pulse", "bgnbd_expected_orders", "ltv_12m", "churn_features", "map_orders",
    "link_profiles", "merge_edges", "resolve_report", "export_events", "dims_facts", "stream_land_raw", "stream_event_dedup",
    "stream_consent_state", "write_tenant_replace", "predictions_upsert",
]


@pytest.fixture(scope="module")
def duck():
    return connect(SF)


@pytest.mark.parametrize("name", QUICK)
def test_query_matches_sql(spark, duck, name):
    assert compare(registry.queries()[name](spark, SF), duck, registry.oracle_sql()[name]) is None


def test_every_statement_has_a_query():
    assert set(registry.oracle_sql()) <= set(registry.queries())


def test_entry_has_rows(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).limit(1).count() == 1


def test_imports_need_no_session():
    import subprocess
    import sys
    from pathlib import Path

    code = "import __spark_entry__ as e; assert len(e.queries()) > 150 and len(e.oracle_sql()) > 150"
    subprocess.run([sys.executable, "-c", code], check=True, cwd=Path(__file__).resolve().parents[1], timeout=120)
