"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line.

every month with the seven before it.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from driftlens.operators import drift, profile  # noqa: E402
from driftlens.plans import roles  # noqa: E402
from driftlens.plans.registry import QUERIES  # noqa: E402
from driftlens.session import build_session  # noqa: E402
from driftlens.staging import stage  # noqa: E402

HEADLINES = (
    "profile_numeric",
    "profile_categorical",
    "topk_values",
    "approximate_profile",
    "fingerprint_daily",
    "drift_report",
    "drift_trend",
    "drift_class",
    "sync_check",
    "risk_forecast",
    "lineage_edges",
    "blast_radius",
    "stale_literals",
    "mart_by_stage",
    "coverage_summary",
    "sync_changes",
    "incident_state",
    "impact_running",
    "stream_daily_drift",
)


def month_check(spark, folder):
    fps = stage(profile.fingerprint_loads([roles.lineitem_by_month(spark, folder)]), "fingerprints")
    return drift.compare(drift.rolling_members(fps))


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    cpus = os.environ.get("BENCH_CPUS") or str(os.cpu_count() or 8)
    spark = build_session(
        "driftlens-bench",
        master=f"local[{cpus}]",
        shuffle_partitions=int(cpus),
        extra={
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
            "spark.driver.memory": os.environ.get("BENCH_DRIVER_MEMORY", "12g"),
        },
    )
    spark.sparkContext.setLogLevel("ERROR")

    def run(query) -> float:
        start = time.perf_counter()
        query(spark, folder).write.format("noop").mode("overwrite").save()
        return round(time.perf_counter() - start, 3)

    wanted = sys.argv[1:]
    chosen = {"month_check": month_check, **{n: QUERIES[n] for n in HEADLINES}}
    if wanted:
        chosen = {n: chosen.get(n) or QUERIES[n] for n in wanted}
    run(QUERIES["stage_totals"])  # starts the session's scan and shuffle machinery
    times = {name: run(query) for name, query in chosen.items()}
    print(
        json.dumps(
            {
                "metric": "total wall time of the headline queries",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": os.path.basename(folder).removeprefix("sf"),
                "cpus": int(cpus),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
