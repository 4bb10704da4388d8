"""Time the headline queries and print one JSON line.

``BENCH_SF_DIR`` (default /root/testdata/sf0.1), ``BENCH_CPUS`` (default 8) and
``BENCH_QUERIES`` (a regular expression, default: the headline list) control the run.
"""

from __future__ import annotations

import json
import os
import re
import time

HEADLINE = [
    "s1_catalog_scan",
    "s10_wide_export",
    "s14_specimen_summary",
    "a1_window_stats",
    "a4_polar_stats",
    "a6_ring_areas",
    "a13_filled_grid",
    "a16_dark_pixels",
    "a17_pane_intensity",
    "a20_norm_count_centres",
    "a24_crack_surface_simple",
    "a31_specimen_stress",
    "f17_area_filter",
    "g9_ellipse_axes",
    "g13_all_properties",
    "h3_cdf",
    "h4_share_curve",
    "h7_mode",
    "c12_similarity_bundle",
    "j4_close_pairs",
    "j5_nearest_30",
    "j8_symmetric_neighbours",
    "p4_centred_l",
    "p7_break_parameters",
    "p8_quadrat_test",
    "l1_layer_create",
    "l6_layer_lookup",
    "w7_moving_mean",
    "w10_motion",
    "w11_wiener",
    "w12_lowpass",
    "w13_spaced_peaks",
    "w15_full_spectrum",
    "w19_crack_kinematics",
    "m6_remaining_energy",
    "r6_lines_per_thickness",
]


def main() -> None:
    from craquelure import plans
    from craquelure.session import local_session

    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    pattern = os.environ.get("BENCH_QUERIES")
    spark = local_session(cpus, shuffle_partitions=int(cpus) if cpus.isdigit() else 8, memory="16g")
    queries = plans.queries()
    names = [n for n in queries if re.search(pattern, n)] if pattern else HEADLINE
    # one untimed query starts the JVM parts, the Python workers and the file cache
    queries["x5_parallel_map"](spark, folder).write.format("noop").mode("overwrite").save()
    times = {}
    for name in names:
        start = time.perf_counter()
        queries[name](spark, folder).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
        spark.catalog.clearCache()
    spark.stop()
    scale = re.search(r"sf([0-9.]+)", folder)
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": float(scale.group(1)) if scale else folder,
            }
        )
    )


if __name__ == "__main__":
    main()
