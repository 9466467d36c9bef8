"""Time the headline queries: one JSON line on stdout.

A query is run up to three times, as long as its runs take less than 6 seconds together; its figure is
the median. BENCH_SF_DIR names the tables (default /root/testdata/sf0.1), BENCH_CPUS the local cores
(default 8), BENCH_QUERIES a comma-separated list of queries or ``all``.
"""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path
from statistics import median

sys.path.insert(0, str(Path(__file__).resolve().parent))

from tidewatch.plans import QUERIES  # noqa: E402
from tidewatch.session import local_session  # noqa: E402

HEADLINE = [
    "profile",
    "pearson_matrix",
    "dedup_keep_first",
    "duplicate_count",
    "cap_trim",
    "make_blocks",
    "pooled_blocks",
    "stratified_split",
    "train_rows",
    "client_rows",
    "scaler_fit",
    "scale_apply",
    "scaler_combine",
    "mutual_info",
    "runs",
    "segments",
    "train_windows",
    "split_train_windows",
    "latency_windows",
    "macro_metrics",
    "spearman",
    "average_precision",
    "nearest_rank_pct",
    "fedavg",
    "metadata_decode",
    "device_windows",
    "replay_accept",
    "cloud_accept",
    "e2e_counts",
    "device_windows_stream",
    "detection_run",
    "federated_rounds",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = os.environ.get("BENCH_CPUS", "8")
    chosen = os.environ.get("BENCH_QUERIES", "")
    names = list(QUERIES) if chosen == "all" else chosen.split(",") if chosen else HEADLINE
    spark = local_session(cores)
    spark.sparkContext.setLogLevel("OFF")
    # The session and its Python workers are up before the clock runs.
    regions = spark.read.parquet(f"{folder}/region.parquet").select("r_name")
    regions.mapInArrow(lambda batches: batches, "r_name string").count()
    timings = {}
    for name in names:
        runs = []
        while len(runs) < 3 and sum(runs) < 6:
            started = time.perf_counter()
            QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
            runs.append(time.perf_counter() - started)
            spark.catalog.clearCache()
        timings[name] = round(median(runs), 3)
    print(
        json.dumps(
            {
                "metric": "total_query_seconds",
                "value": round(sum(timings.values()), 3),
                "unit": "sec",
                "queries": timings,
                "sf": Path(folder).name.removeprefix("sf"),
            }
        )
    )


if __name__ == "__main__":
    main()
