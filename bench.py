"""Wall time of the headline queries; prints one JSON line.

BENCH_SF_DIR names the tables, BENCH_CPUS the local cores. Every query runs to a no-op
sink, once to warm up and then BENCH_RUNS times; the median counts.
"""

import json
import os
import statistics
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from motes.plans import catalog  # noqa: E402
from motes.session import local_session  # noqa: E402

HEADLINE = [
    "flagship_best_even_views",
    "r3_equalised_rank",
    "r4_equalised_rank_by_half",
    "r1_best_n",
    "r5_checkpoints",
    "r11_best_count",
    "r7_number_in_runs",
    "r8_history_fixed",
    "a8_difference_statistics",
    "a10_angle_histogram",
    "a11_robust_statistics",
    "a14_best_per_voxel",
    "a22_ring_correlation",
    "a27_equalise_amplitudes",
    "a28_scatter_add",
    "a29_pair_scores",
    "a31_structural_score",
    "a34_best_class",
    "f7_random_halves",
    "f9_outlier_fence",
    "j1_lineitem_optics",
    "j6_back_map",
    "j7_update_columns",
    "j8_override_rows",
    "j12_match_rounded",
    "j17_nearest_view",
    "j19_most_similar",
    "j20_targets_against_maps",
    "s1_read_loop",
    "t3_pair_steps",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", str(os.cpu_count() or 1))
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    names = sys.argv[1:] or HEADLINE
    spark = local_session(cpus, "motes-bench")
    spark.conf.set("spark.sql.shuffle.partitions", cpus if cpus.isdigit() else "8")
    seconds = {}
    for name in names:
        times = []
        for i in range(runs + 1):
            start = time.perf_counter()
            catalog.PLANS[name](spark, folder).write.format("noop").mode("overwrite").save()
            if i:
                times.append(time.perf_counter() - start)
        seconds[name] = round(statistics.median(times), 3)
    line = {
        "metric": "total median wall time of headline queries",
        "value": round(sum(seconds.values()), 3),
        "unit": "sec",
        "queries": seconds,
        "sf": folder.rstrip("/").rsplit("sf", 1)[-1],
    }
    print(json.dumps(line))


if __name__ == "__main__":
    main()
