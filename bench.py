"""Benchmark: run the headline jobs at $BENCH_SF_DIR on local[$BENCH_CPUS] and
print one JSON line. Each job is forced end to end with a no-op sink (no
collect), timed after one warm-up job; a job's seconds are the median of $BENCH_RUNS runs
(3). ``rows_per_s`` divides the rows of the table that a job reads (times the levels it
masks them at) by its seconds: prompts per second."""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from minimus.plans import catalog  # noqa: E402
from minimus.session import get_spark  # noqa: E402

HEADLINE = [
    "simplify_history",     # O50 (grade C, as-of window)
    "response_routing",     # O12 + O04
    "pii_findings",         # O26
    "mask_pii",             # O42 at three levels
    "typo_corrections",     # O21
    "simplify_chain",       # O46 + O47/O48
    "minimize_prompts",     # O49
    "level_sweep",          # O51
    "minimization_report",  # O28
    "noisy_knn",            # O22
]

#: Table that a job reads, and how often each row counts (levels); documents once otherwise.
READS = {"simplify_history": ("conversations", 1), "response_routing": ("conversations", 1),
         "minimize_prompts": ("conversations", 1), "noisy_knn": ("embeddings", 1),
         "mask_pii": ("documents", 3), "level_sweep": ("documents", 3),
         "minimization_report": ("documents", 3)}


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = sys.argv[1:] or HEADLINE
    parts = int(os.environ.get("BENCH_SHUFFLE_PARTITIONS", cpus))
    spark = get_spark(f"local[{cpus}]", app="minimus-bench", shuffle_partitions=parts)
    catalog.load_all()
    q = catalog.QUERIES
    q["clean_text"](spark, sf_dir).write.format("noop").mode("overwrite").save()  # warm-up
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    rows = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet").count()
            for t in ("documents", "conversations", "embeddings")}
    times, rates = {}, {}
    for name in names:
        took = []
        for _ in range(runs):
            t0 = time.perf_counter()
            q[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            took.append(time.perf_counter() - t0)
        times[name] = round(statistics.median(took), 3)
        table, times_read = READS.get(name, ("documents", 1))
        rates[name] = round(rows[table] * times_read / times[name], 1)
    sf = os.path.basename(sf_dir.rstrip("/")).replace("sf", "")
    print(json.dumps({"metric": "total_headline_seconds", "value": round(sum(times.values()), 3),
                      "unit": "sec", "queries": times, "rows_per_s": rates, "runs": runs,
                      "sf": sf, "cpus": int(cpus)}))


if __name__ == "__main__":
    main()
