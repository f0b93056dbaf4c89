"""Runs the headline queries warm and prints one JSON line. BENCH_SF_DIR, BENCH_CPUS and BENCH_RUNS set it up."""

from __future__ import annotations

import json
import os
import statistics
import time

from millrace.plans import registry
from millrace.session import local_session

QUERIES = ["engagement_daily_articles", "engagement_daily_dims", "engagement_window_dims", "engagement_open_rate_rank", "engagement_trending", "text_page_urls", "gate_eligibility", "ingest_duplicate_groups", "ingest_merge_articles", "related_articles", "classify_section", "rank_default_lists", "rank_personal_scores", "parts_fitment"]


def main() -> None:
    sf_dir, cpus, runs = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), int(os.environ.get("BENCH_CPUS", "8")), int(os.environ.get("BENCH_RUNS", "3"))
    spark = local_session(cpus)
    found = registry.queries()
    times = {}
    for name in (q for q in QUERIES if q in found):
        took = []
        for _ in range(runs + 1):  # the first run warms up
            began = time.time()
            found[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            took.append(time.time() - began)
        times[name] = round(statistics.median(took[1:]), 3)
    print(json.dumps({"metric": "sum of median query seconds, warm", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": sf_dir.rsplit("sf", 1)[-1]}))


if __name__ == "__main__":
    main()
