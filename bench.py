"""Times the headline queries and prints one JSON line.

Each query runs twice in one warm session and the faster run counts. Reads
BENCH_SF_DIR and BENCH_CPUS.
"""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from rollcall.plans import queries as registry  # noqa: E402
from rollcall.session import local_session  # noqa: E402

HEADLINE = [
    "topk_cosine", "topk_batch", "topk_every_vector", "topk_filtered", "ann_lsh", "search_candidates", "extract_contacts",
    "normalize_phone", "normalize_skills", "hash_encode", "duplicate_phones", "merge_last_wins",
    "merge_full", "merge_by_email", "pending_files", "batch_status", "batch_finished",
    "archive_entries", "archive_limits", "parse_json_records", "seed_candidates", "stream_ingest",
    "stream_status", "stream_retry",
]
RUNS = 2


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    spark = local_session(cpus, "rollcall-bench")
    registered = registry.registered()
    seconds = {}
    for name in HEADLINE:
        best = None
        for _ in range(RUNS):
            started = time.perf_counter()
            registered[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            taken = time.perf_counter() - started
            best = taken if best is None else min(best, taken)
        seconds[name] = round(best, 3)
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet").count()
    writes = spark.read.parquet(f"{sf_dir}/customer.parquet").count()
    print(
        json.dumps(
            {
                "metric": "total_headline_seconds",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": sf_dir.rstrip("/").rsplit("sf", 1)[-1],
                "cpus": cpus,
                "runs": RUNS,
                "batch_search_ms_per_query": round(1000 * seconds["topk_every_vector"] / vectors, 3),
                "merge_rows_per_second": round(writes / seconds["merge_full"]),
                "ingest_rows_per_second": round(writes / seconds["stream_ingest"]),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
