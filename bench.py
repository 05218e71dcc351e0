"""Times headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import statistics
import time

from almanac.plans.catalogue import QUERIES
from almanac.session import build_session

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
REPEATS = int(os.environ.get("BENCH_REPEATS", "3"))
ONLY = os.environ.get("BENCH_ONLY", "")  # a comma list of names, or "all"

HEADLINE = [
    "t08_site_rollup", "t04_keyword_hits", "t05_keyword_spans", "t06_context_windows", "t07_fixed_chunks", "t10_full_text_or",
    "t11_max_similarity", "t13_hybrid_filter", "t16_budgeted_text", "t18_keyword_hit_rate", "f20_page_text", "f21_internal_links",
    "j01_label_chain", "j07_first_match_fill", "j12_point_in_region", "j14_knn_graph", "a03_category_matrix", "a05_outliers",
    "a09_two_party_share", "a12_group_table", "w01_winner_by_votes", "w05_average_rank", "l05_cohort_sample", "x02_kruskal",
    "x06_dunn", "x09_correlation", "x12_lees_l", "e03_label_kappa", "e07_set_agreement", "m09_roc_auc", "s11_upsert",
]


#: Operators of many jobs, timed once after a warm-up and left out of the headline sum.
LONG = ["j06_greedy_nearest_pairs", "m01_kmeans_sweep", "x14_permutation_test", "r03_rolling_site_totals"]


def main() -> None:
    spark = build_session(f"local[{CPUS}]", "almanac-bench", int(CPUS))
    spark.sparkContext.setLogLevel("ERROR")
    names = [*HEADLINE, *LONG] if not ONLY else (list(QUERIES) if ONLY == "all" else ONLY.split(","))
    times: dict[str, float] = {}
    for name in names:
        runs = []
        for i in range(2 if name in LONG else REPEATS + 1):  # the first run warms up
            start = time.perf_counter()
            QUERIES[name](spark, SF_DIR).write.format("noop").mode("overwrite").save()
            if i or REPEATS == 0:
                runs.append(time.perf_counter() - start)
        times[name] = round(statistics.median(runs), 3)
    total = round(sum(t for name, t in times.items() if name not in LONG), 3)
    sf = os.path.basename(SF_DIR.rstrip("/")).removeprefix("sf")
    print(json.dumps({"metric": "headline_total_seconds", "value": total, "unit": "sec", "queries": times, "sf": sf}), flush=True)
    spark.stop()


if __name__ == "__main__":
    main()
