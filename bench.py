"""Headline queries at BENCH_SF_DIR on local[BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from chronotrace.plans.catalog import QUERIES  # noqa: E402
from chronotrace.session import local_session  # noqa: E402

HEADLINE = [
    "recording_report", "j05_interval_overlap", "j06_nearest_boundary", "j07_coverage", "j10_trace_totals_on_edges", "j11_frame_energy_on_edges", "j16_time_probe", "j17_time_bins",
    "a25_entity_rollup", "a34_energy_percentiles", "a07_frame_auc", "a39_signal_fusion", "w13_hysteresis", "w14_merge_intervals", "w16_peak_and_burst", "w17_discordance_alerts",
    "w20_gaussian_smoothing", "w23_ramp_scores", "w29_adaptive_sampling", "w32_localisation", "g01_decayed_similarity_graph", "g02_local_window_graph", "g03_propagation", "g04_segmentation",
    "st01_entity_tracker", "st03_trigger_gateway", "st04_silent_heartbeats", "st06_adaptive_threshold", "f11_json_in_text", "f16_template_alignment",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(os.environ.get("BENCH_CPUS", "8"), "bench")
    names = sys.argv[1:] or HEADLINE
    QUERIES["t05_top_records"](spark, sf_dir).write.format("noop").mode("overwrite").save()  # warm-up
    times = {}
    for name in names:
        t = time.time()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - t, 3)
    print(json.dumps({"metric": "headline_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": Path(sf_dir).name.removeprefix("sf")}))


if __name__ == "__main__":
    main()
