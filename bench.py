"""Headline queries, warm, on ``local[$BENCH_CPUS]`` over ``$BENCH_SF_DIR``; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from riskspark.session import build_session  # noqa: E402
from workload import all_queries  # noqa: E402

HEADLINE = (
    "scan_all_rules", "r1_scan_literals", "r4_scan_regex", "r13_extract_links", "r14_classify_links", "r16_scan_secrets",
    "x2_scan_needles", "f18_classify_scope", "r17_scan_commands", "a5_evaluate_policy", "a6_explain_rules",
    "a10_fingerprint", "a13_snapshot_usage", "j3_match_approval", "j4_lookup_scan_result", "j5_diff_reports",
    "j9_resolve_targets", "g1_reach_levels", "w2_cap_findings", "w6_verify_chain", "assess_verdicts",
    "a18_assemble_report",
)


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = [n for n in os.environ.get("BENCH_QUERIES", "").split(",") if n] or list(HEADLINE)
    spark = build_session(
        "riskspark-bench",
        master=f"local[{cpus}]",
        **{
            "spark.sql.shuffle.partitions": str(max(int(cpus), 8)),
            "spark.driver.memory": "16g",
            "spark.driver.host": "127.0.0.1",
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
        },
    )
    spark.sparkContext.setLogLevel("OFF")
    queries = all_queries()[0]
    # Derived input tables are written before anything is timed.
    queries["p1_critical_files"](spark, folder).write.format("noop").mode("overwrite").save()
    queries["f1_split_segments"](spark, folder).write.format("noop").mode("overwrite").save()
    times: dict[str, float] = {}
    for name in names:
        begun = time.perf_counter()
        queries[name](spark, folder).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - begun, 3)
    print(
        json.dumps(
            {
                "metric": "headline_query_seconds", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times,
                "sf": folder.rstrip("/").rsplit("sf", 1)[-1], "cpus": int(cpus),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
