"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line with the seconds per query,
the median of $BENCH_RUNS runs after one warm-up."""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

from marginalia.plans.queries import ALL
from marginalia.plans.session import build

HEADLINES = [
    "A2_frontmatter", "A4_markup", "P4_natural_lines", "G1_tag_statistics", "J2_outgoing_links", "J3_exact_references", "J7_unlinked_mentions", "J8_link_candidates",
    "W1_paragraphs", "C1_locate", "C5_tag_terms", "C4_tag_suggestions", "C10_work_keys", "G6_comparison_matrix", "K1_literature_notes", "A7_pages_to_markdown",
    "W3_hash_cleaning", "J9_link_rewriting", "W5_flatten_plan", "P6_feed_filter", "G15_comment_rollup", "R1_change_windows", "E1_nearest_vectors",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = os.environ.get("BENCH_CPUS", str(os.cpu_count() or 4))
    runs = int(os.environ.get("BENCH_RUNS", "1"))
    wanted = sys.argv[1:] or HEADLINES
    spark = build("bench", cores=cores, shuffle=max(8, int(cores)))
    seconds: dict[str, float] = {}
    for name in wanted:
        times = []
        for _ in range(runs + 1):
            start = time.perf_counter()
            ALL[name].run(spark, sf_dir).write.format("noop").mode("overwrite").save()
            times.append(time.perf_counter() - start)
        seconds[name] = round(statistics.median(times[1:]), 3)
        print(name, seconds[name], "first", round(times[0], 2), file=sys.stderr, flush=True)
    print(json.dumps({"metric": "total_seconds", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")}))


if __name__ == "__main__":
    main()
