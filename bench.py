"""Time the headline queries and print one JSON line.

BENCH_SF_DIR names the table folder, BENCH_CPUS the local cores.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from tabscry.queries import QUERIES  # noqa: E402
from tabscry.session import build_session  # noqa: E402

HEADLINE = [
    "scan_nulls",
    "column_profile",
    "wide_profile",
    "distribution",
    "correlations",
    "periodicity",
    "numeric_flags",
    "column_types",
    "histogram",
    "time_series_multi",
    "mean_over_top",
    "scan_conflicts",
    "conflict_rows",
    "iqr_outliers",
    "quality_report",
    "fill_forward",
    "fill_group_median",
    "repair_conflict_median",
    "repair_conflict_mode",
    "repair_plan",
    "repair_audit",
    "call_batches",
    "sample_systematic",
    "classify_keywords",
    "group_terms",
    "summarize_rows",
    "summarize_groups",
    "text_jaccard",
    "redact_pii",
    "parse_pages",
    "semantic_join",
    "stream_quality",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(
        "bench", f"local[{cpus}]", spark__sql__shuffle__partitions=cpus, spark__ui__enabled="false", spark__driver__memory="16g"
    )
    spark.sparkContext.setLogLevel("ERROR")
    spark.read.parquet(f"{sf_dir}/lineitem.parquet").groupBy("l_returnflag").count().collect()
    chosen = sys.argv[1:] or HEADLINE
    took: dict[str, float] = {}
    for name in chosen:
        start = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        took[name] = round(time.perf_counter() - start, 3)
        print(f"{took[name]:8.2f} {name}", file=sys.stderr, flush=True)
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(took.values()), 3),
                "unit": "sec",
                "queries": took,
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
