"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

ROOT = os.path.dirname(os.path.abspath(__file__))
sys.path.insert(0, ROOT)

from tablesense import catalogue  # noqa: E402
from tablesense.session import build_session  # noqa: E402

HEADLINE = (
    "foreign_key_candidates", "value_overlaps", "key_discovery", "lineitem_key_discovery", "dependencies", "basic_stats", "numeric_distribution",
    "histograms", "column_types", "column_labels", "cleaned_orders", "clean_report", "dates_parsed", "currency_parsed", "deduplicated_first",
    "rows_numbered", "tables_merged", "reference_counts", "published_types", "duplicate_rows", "nearest_neighbours", "lexical_scores", "trigram_vectors",
    "run_metrics", "run_latency", "column_drift", "latest_events", "star_join_answer", "table_types", "event_spacing",
)


def main() -> None:
    path = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    only = [q for q in os.environ.get("BENCH_QUERIES", "").split(",") if q] or HEADLINE
    spark = build_session("bench")
    catalogue.load_all()
    spark.range(1000).selectExpr("sum(id)").collect()  # start the JVM's workers before timing
    seconds = {}
    for name in only:
        start = time.perf_counter()
        catalogue.QUERIES[name](spark, path).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
        print(f"{name:28s} {seconds[name]:8.2f}", file=sys.stderr, flush=True)
    print(json.dumps({
        "metric": "total wall seconds of headline queries", "value": round(sum(seconds.values()), 3), "unit": "sec",
        "queries": seconds, "sf": os.path.basename(path.rstrip("/")).removeprefix("sf"),
    }))
    spark.stop()


if __name__ == "__main__":
    main()
