"""Benchmark the headline queries; prints ONE JSON line.

    BENCH_SF_DIR=/root/testdata/sf0.1 BENCH_CPUS=8 python bench.py

Per query: one warm-up, then the median of ``BENCH_RUNS`` timed runs.  Each
run executes the whole plan through the ``noop`` sink (no collect to the
driver).  ``collect`` is the collection step: classification and commit fold
written as Parquet to the shared folder (forced fresh on every run).
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from histofold.plans.context import context  # noqa: E402
from histofold.plans.queries import QUERIES  # noqa: E402
from histofold.session import get_spark  # noqa: E402

HEADLINE = [
    "commit_fold", "pac_frequency", "commit_size_medians", "maintainer_share", "code_change_sizes",
    "corpus_medians", "repo_fold", "inspection_rows", "seeded_sample", "cochange_transactions",
    "association_rules", "cochange_grid", "coverage_summary", "resolve_revision", "suffix_lookup",
    "scan_commit_history", "write_results_roundtrip", "cochange_totals", "share_histogram", "boxplot_summary",
    "collect_job",
]


def run(df) -> None:
    df.write.format("noop").mode("overwrite").save()


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    names = os.environ.get("BENCH_QUERIES")
    names = names.split(",") if names else HEADLINE
    spark = get_spark(f"local[{cpus}]", shuffle_partitions=2 * cpus,
                      extra={"spark.driver.memory": os.environ.get("BENCH_DRIVER_MEMORY", "16g")})
    ctx = context(spark, sf_dir)
    ctx.materialize(force=True)  # warm-up
    samples = []
    for _ in range(runs):
        t0 = time.perf_counter()
        ctx.materialize(force=True)
        samples.append(time.perf_counter() - t0)
    times: dict[str, float] = {"collect": round(statistics.median(samples), 3)}
    for name in names:
        fn = QUERIES[name]
        run(fn(spark, sf_dir))  # warm-up
        samples = []
        for _ in range(runs):
            t = time.perf_counter()
            run(fn(spark, sf_dir))
            samples.append(time.perf_counter() - t)
        times[name] = round(statistics.median(samples), 3)
    sf = os.path.basename(sf_dir.rstrip("/")).replace("sf", "")
    print(json.dumps({
        "metric": "sum_of_median_query_sec", "value": round(sum(times.values()), 3), "unit": "sec",
        "queries": times, "sf": sf, "cpus": cpus, "runs": runs,
        "config": {"shuffle_partitions": 2 * cpus, "aqe": True, "spark": spark.version},
    }))
    spark.stop()


if __name__ == "__main__":
    main()
