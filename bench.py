"""Times the headline queries over $BENCH_SF_DIR on local[$BENCH_CPUS].

Every query runs whole into a sink that discards its rows. Prints one JSON line.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from checks import registry  # noqa: E402
from patronage.session import local_session  # noqa: E402

HEADLINE = (
    "valid_orders", "rfm_current", "cohort_retention", "retention_facts", "campaign_roi", "leak_facts",
    "executive_kpis", "cx_facts", "messaging_facts", "automation_facts", "last_click_attribution",
    "sends_after_revoke", "overview_kpis", "predictions_summary", "customers_page", "map_orders",
    "link_profiles", "connected_components", "resolve", "export_events", "bgnbd_summary", "ltv_12m",
    "churn_features", "score_composite", "stream_land_raw",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    only = sys.argv[1:] or HEADLINE
    spark = local_session(cpus)
    queries = registry.queries()

    def run(name: str) -> float:
        start = time.time()
        queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        return time.time() - start

    run("valid_orders")  # starts the JVM's compiler and the file cache
    times = {}
    for name in only:
        times[name] = round(run(name), 3)
        print(f"{name} {times[name]}", file=sys.stderr, flush=True)
    print(json.dumps({
        "metric": "headline_total_seconds", "value": round(sum(times.values()), 3), "unit": "sec",
        "queries": times, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
    }))


if __name__ == "__main__":
    main()
