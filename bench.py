"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import time

from voltloom.catalog import CATALOG
from voltloom.session import local_session

HEADLINE = (
    "agg_summarize_batteries", "win_rolling_stats", "rsk_guardian_report", "seg_segment_phases",
    "seg_window_charge", "soh_current_field_soh", "win_targets_horizon", "soh_rul_error_table",
    "val_leave_group_out_cells", "val_cohort_coverage", "fn_wire_decode", "jn_signal_dictionary_join",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(os.environ.get("BENCH_CPUS", "8"))
    spark.range(1).count()
    seconds = {}
    for name in HEADLINE:
        start = time.perf_counter()
        CATALOG.builds[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
    print(json.dumps({"metric": "headline_total", "value": round(sum(seconds.values()), 3), "unit": "sec",
                      "queries": seconds, "sf": sf_dir.rsplit("sf", 1)[-1]}))


if __name__ == "__main__":
    main()
