"""The nightly order over synced tables: marts, predictions, the shadow classifier's AUC, scores, all stored per tenant."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from patronage.models.churn import churn_shadow
from patronage.models.lifetime import run_models
from patronage.plans.marts import MART_NAMES, build_marts
from patronage.plans.score_inputs import ScoreInputs
from patronage.plans.scores import all_scores, score_runs
from patronage.sources import sinks


def store_marts(tables: object, path: str, indexed: bool = False) -> dict[str, DataFrame]:
    """Build and replace all marts of the tenants at hand; returns the stored tables."""
    built = build_marts(tables, indexed=indexed)
    for name in MART_NAMES:
        sinks.write_replace(built[name], f"{path}/{name}", tables.tenants)
    return {name: sinks.read_table(tables.spark, f"{path}/{name}", df) for name, df in built.items()}


class Stored:
    """Stored marts in place of built ones, for the steps after them."""

    def __init__(self, tables: object, marts: dict[str, DataFrame]) -> None:
        self.orders, self.dim_customers, self.messages = tables.fact_orders, tables.dim_customers, tables.fact_messages
        for name, df in marts.items():
            setattr(self, name, df)


def nightly(tables: object, path: str, run_at: datetime, indexed: bool = False) -> DataFrame:
    """Marts, then predictions, then scores, which read both. Returns the score runs appended."""
    marts = Stored(tables, store_marts(tables, f"{path}/marts", indexed))
    stamp = f"{run_at:%Y-%m-%d %H:%M:%S}"
    predicted = run_models(tables.fact_orders, stamp)
    sinks.write_predictions(predicted, f"{path}/predictions")
    sinks.write_replace(churn_shadow(tables), f"{path}/churn_shadow", tables.tenants)
    tables.predictions = sinks.read_table(tables.spark, f"{path}/predictions", predicted)
    inputs = ScoreInputs(tables, marts, run_at)
    runs = score_runs(all_scores(inputs.all(tables.tenants)), stamp)
    sinks.append_runs(runs, f"{path}/score_runs")
    return sinks.read_table(tables.spark, f"{path}/score_runs", runs).where(
        F.col("computed_at") == F.lit(stamp).cast("timestamp_ntz")
    )
