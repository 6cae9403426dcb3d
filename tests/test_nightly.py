from datetime import datetime

from patronage.plans.nightly import nightly
from patronage.plans.scores import COMPOSITE_WEIGHTS
from patronage.sources import sinks
from patronage.sources.tables import Tables
from tests.conftest import SF


def test_nightly_stores_marts_predictions_and_runs(spark, tmp_path):
    path = str(tmp_path)
    runs = nightly(Tables(spark, SF), path, datetime(2001, 8, 12, 4))
    rows = runs.collect()
    assert {r.score for r in rows} == {*COMPOSITE_WEIGHTS, "composite"}
    assert all(0 <= r.value <= 100 for r in rows)
    stored = {n: spark.read.parquet(f"{path}/{n}").count() for n in ("marts/executive_kpis", "predictions", "churn_shadow", "score_runs")}
    assert all(stored.values()) and stored["score_runs"] == len(rows)
    sinks.append_runs(spark.createDataFrame(rows, runs.schema), f"{path}/score_runs")
    assert spark.read.parquet(f"{path}/score_runs").count() == 2 * len(rows)
