"""Warm wall-clock of the headline queries; prints one JSON line.

Environment: BENCH_SF_DIR (tables), BENCH_CPUS (local threads), BENCH_RUNS (timed runs per
query, the median counts), BENCH_QUERIES (comma separated names instead of the headline
list, or ``all``).
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from citestat.plans.catalog import QUERIES  # noqa: E402
from citestat.session import local_session  # noqa: E402

HEADLINE = [
    "A1_citations_per_article", "A2_venue_totals", "A4_citation_histogram", "A13_profile_by_venue",
    "A14_four_profiles", "A20_journal_overlap", "A22_matched_by_venue", "A28_kendall_by_venue",
    "A30_preferred_names", "A33_issn_census", "F5_normalize_title", "F26_levenshtein_similarity",
    "J10_journal_master", "P4_venue_filter", "P6_cited_in_set", "W2_duplicate_report", "W3_keep_first_twice",
    "W6_distinct_pairs", "L2_doi_stage", "L3_title_year_stage", "L9_master_of_all_stages", "L13_enriched_references",
    "L18_leader_deduplication", "N1_jats_articles", "N6_tei_references", "N9_parsed_references", "G3_degrees",
    "G4_pagerank", "G6_weak_components", "G7_core_numbers",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    runs = int(os.environ.get("BENCH_RUNS", "1"))
    chosen = os.environ.get("BENCH_QUERIES", "")
    names = list(QUERIES) if chosen == "all" else [n for n in chosen.split(",") if n] or HEADLINE
    spark = local_session(cpus, shuffle_partitions=cpus)
    seconds: dict[str, float] = {}
    for name in names:
        def run() -> float:
            start = time.perf_counter()
            QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            return time.perf_counter() - start

        run()
        seconds[name] = round(statistics.median(run() for _ in range(runs)), 3)
        print(f"{name} {seconds[name]}", file=sys.stderr)
    spark.stop()
    print(
        json.dumps(
            {
                "metric": "total_warm_seconds", "value": round(sum(seconds.values()), 3), "unit": "sec",
                "queries": seconds, "sf": Path(sf_dir).name.removeprefix("sf"), "cpus": cpus, "runs": runs,
            }
        )
    )


if __name__ == "__main__":
    main()
