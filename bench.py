"""Time the headline queries; prints one JSON line.

BENCH_SF_DIR  folder of parquet tables (default /root/testdata/sf0.1)
BENCH_CPUS    local cores (default 8)
BENCH_RUNS    timed runs per query after one warm-up; the median is reported (default 3)
BENCH_QUERIES comma-separated names; ``all`` for every registered query
"""

from __future__ import annotations

import json
import os
import statistics
import time

HEADLINE = [
    "cell_stats",
    "cell_stats_by_day",
    "duplicate_mask",
    "membership_flag",
    "rank_by_frequency",
    "one_way_fit",
    "coef_summary",
    "anova_ancova",
    "anova_factorial",
    "gram_ols_cubic",
    "pairwise_contrasts",
    "letter_groups_many_levels",
    "response_report",
    "stage_window_raw",
    "smooth_line",
    "curve_residuals",
    "logistic_fit_full",
    "segmented_fit",
    "growth_rate_report",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "3"))

    from trialframe.catalog import QUERIES
    from trialframe.session import local_session

    chosen = os.environ.get("BENCH_QUERIES", "")
    names = list(QUERIES) if chosen == "all" else chosen.split(",") if chosen else HEADLINE
    spark = local_session(cpus)
    spark.sparkContext.setLogLevel("ERROR")

    def run(name: str) -> float:
        start = time.perf_counter()
        QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        return time.perf_counter() - start

    seconds = {}
    for name in names:
        run(name)
        seconds[name] = round(statistics.median(run(name) for _ in range(runs)), 3)
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
                "cpus": cpus,
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
