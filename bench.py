"""Time the headline queries; prints one JSON line.

All queries are run once to warm up, then each three times; the median counts. A run
ends when the whole result has been written to a ``noop`` sink.
"""

from __future__ import annotations

import json
import os
import statistics
import time

from runloom.session import build_session
from workloads.queries import registered

HEADLINE = [
    "latest_run",
    "latest_run_by_rank",
    "iteration_label",
    "facets",
    "side_by_side",
    "flows_wide",
    "image_lookup",
    "corpus_from_entries",
    "insert_if_absent",
    "import_corpus",
    "run_log_append",
    "request_fanout",
    "prompt_similarity",
    "extract_script",
    "report_parse",
    "response_text",
    "chunk_running",
    "chat_history",
    "first_pass_log",
    "backfeed_results",
    "completion_map",
    "first_pass_completed",
    "stream_latest",
    "stream_responses",
    "stream_insert",
]


def seconds(spark, name: str, sf: str) -> float:
    begin = time.perf_counter()
    registered()[name](spark, sf).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - begin


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(
        "bench",
        **{
            "spark.master": f"local[{cpus}]",
            "spark.sql.shuffle.partitions": cpus,
            "spark.driver.memory": "16g",
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    timings = {}
    for name in HEADLINE:
        seconds(spark, name, sf)
    for name in HEADLINE:
        timings[name] = round(statistics.median(seconds(spark, name, sf) for _ in range(3)), 3)
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(timings.values()), 3),
                "unit": "sec",
                "queries": timings,
                "sf": sf,
            }
        )
    )


if __name__ == "__main__":
    main()
