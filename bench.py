"""Benchmark the headline queries.

Runs each query on ``$BENCH_SF_DIR`` (default /root/testdata/sf0.1) with
``local[$BENCH_CPUS]``: one warm-up, then the median of ``$BENCH_RUNS``
timed runs. Each run executes the full plan into the ``noop`` sink (no
driver collect). Prints one JSON line.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "a03_top_english_terms",
    "p09_ratio",
    "j02_suffix_join",
    "a08_histogram",
    "a09_ecdf",
    "t05_tokenize",
    "v14_encoder_features",
    "w09_skipgram",
    "c02_context",
    "c04_window_pairs",
    "e07_nearest",
    "g01_topics",
]
# Iterative jobs run once (no warm-up): each run is 20 NMF iterations.
SINGLE_RUN = {"g01_topics"}


def main() -> None:
    from wordlake.plans import QUERIES
    from wordlake.session import build_session

    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    names = [n for n in (sys.argv[1:] or HEADLINE) if n in QUERIES]
    spark = build_session()
    times: dict[str, float] = {}
    rows: dict[str, int] = {}
    for name in names:
        build = QUERIES[name].build
        n_runs = 1 if name in SINGLE_RUN else runs
        if name not in SINGLE_RUN:
            build(spark, sf_dir).write.format("noop").mode("overwrite").save()  # warm-up
        samples = []
        for _ in range(n_runs):
            t0 = time.perf_counter()
            build(spark, sf_dir).write.format("noop").mode("overwrite").save()
            samples.append(time.perf_counter() - t0)
        times[name] = round(statistics.median(samples), 3)
        rows[name] = -1 if name in SINGLE_RUN else build(spark, sf_dir).count()
        print(f"# {name}: {times[name]}s rows={rows[name]}", file=sys.stderr, flush=True)
    sf = sf_dir.rsplit("sf", 1)[-1]
    out = {"metric": "headline_total_median_sec", "value": round(sum(times.values()), 3), "unit": "sec",
           "queries": times, "rows": rows, "sf": sf,
           "cpus": int(os.environ.get("BENCH_CPUS", "8")), "runs": runs,
           "shuffle_partitions": int(spark.conf.get("spark.sql.shuffle.partitions"))}
    print(json.dumps(out))
    spark.stop()


if __name__ == "__main__":
    main()
