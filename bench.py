"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import time

from nearpass.plans import catalog, registry  # noqa: F401
from nearpass.session import build_session

HEADLINE = (
    "c4_drop_jumps", "c9_rolling_median", "r1_one_second_grid", "g3_flight_phase", "j1_pair_seconds", "p1_tier_evaluation",
    "p4_encounters", "w2_per_second_counts", "j4_window_exposure", "w10_minute_bins", "j2_encounter_counts", "j8_landing_controls",
    "e2_event_table", "a5_outcomes", "st2_day_bootstrap_ratio", "m5_change_summary", "b6_score_windows", "v1_sensitivity_sweep",
    "ag_order_flags",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = build_session(f"local[{os.environ.get('BENCH_CPUS', '8')}]", "bench")
    registry.QUERIES["ag_order_flags"](spark, sf_dir).collect()  # start-up
    times = {}
    for name in HEADLINE:
        t = time.time()
        registry.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - t, 3)
    print(json.dumps({
        "metric": "headline_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times,
        "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
    }))
    spark.stop()


if __name__ == "__main__":
    main()
