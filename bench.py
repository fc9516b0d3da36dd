"""Benchmark the headline queries.

Runs each query to completion with the no-op sink (every column computed,
nothing collected) on ``local[$BENCH_CPUS]`` against ``$BENCH_SF_DIR``; one
warm-up pass, then the median of ``$BENCH_RUNS`` timed passes. Prints one JSON
line: {"metric", "value" (sum of medians), "unit", "queries", "sf", ...}.
"""

from __future__ import annotations

import json
import os
import re
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pagesift.plans.queries import QUERIES  # noqa: E402
from pagesift.session import build_session  # noqa: E402

HEADLINE = ["listing_run", "site_run", "clean_text", "clean_text_exact", "page_links", "unique_links",
            "chunks", "fingerprints", "first_seen", "insert_if_absent", "early_stop",
            "run_summary", "merge_enrichment", "document_text", "parse_replies", "job_state",
            "keyed_replace", "file_manifest", "prompts", "enrich_run", "model_extract",
            "fallback_links", "rule_extract", "run_log", "stream_dedupe", "full_run"]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    names = [n for n in (sys.argv[1:] or HEADLINE) if n in QUERIES]
    parts = int(os.environ.get("BENCH_SHUFFLE_PARTITIONS", "0")) or \
        max(8, int(cpus) * 2 if cpus.isdigit() else 16)
    spark = build_session(f"local[{cpus}]", app="pagesift-bench", shuffle_partitions=parts)

    def run(name: str) -> float:
        t = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        return time.perf_counter() - t

    for n in names:  # warm-up: JIT, Python workers, file listing
        run(n)
    times = {n: [] for n in names}
    for _ in range(runs):
        for n in names:
            times[n].append(run(n))
    med = {n: round(statistics.median(v), 3) for n, v in times.items()}
    m = re.search(r"sf([0-9.]+)", sf_dir)
    print(json.dumps({
        "metric": "headline_queries_total_median",
        "value": round(sum(med.values()), 3),
        "unit": "sec",
        "queries": med,
        "sf": float(m.group(1)) if m else sf_dir,
        "cpus": cpus,
        "runs": runs,
        "spark": spark.version,
    }))


if __name__ == "__main__":
    main()
