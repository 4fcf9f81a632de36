"""Times the headline queries and prints one JSON line.

BENCH_SF_DIR   folder of the tables (default /root/testdata/sf0.1)
BENCH_CPUS     local cores (default: all)
BENCH_QUERIES  comma-separated names, or 'all', instead of the headline list
"""

from __future__ import annotations

import json
import os
import re
import sys
import time

HEADLINE = [
    "a6_pass_at_k", "a11_model_comparison", "a9_most_retrieved_tools", "a13_recall_at_k", "a14_solver_performance", "a16_question_statistics",
    "a18_run_summary", "a24_tool_set_loss", "a26_token_estimates", "a30_merged_library", "j1_tool_targets", "j3_covered_tools",
    "j5_questions_with_results", "j9_similarity_top5", "j9_similarity_in_blocks", "j14_selected_problems", "j16_applied_assignments",
    "h1_edges_after_operations", "w2_even_chunks", "w3_successes_in_first_k", "w5_last_wrong_calls", "p13_request_table", "p19_numbered_functions",
    "p20_analysis_transcripts", "q1_schema_errors", "q2_schema_budgets", "q3_repaired_schemas", "q4_signature_parameters", "q5_syntax_errors",
    "q6_tool_blocks", "q8_scored_choices", "s2_json_lines", "s9_cluster_shapes", "s10_extracted_tools", "s13_tool_set_fingerprints", "s14_stored_blocks",
    "x9_report_indicators", "r1_running_totals",
]


def main() -> None:
    from toolmill.plans import QUERIES
    from toolmill.session import build_session

    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "*")
    wanted = os.environ.get("BENCH_QUERIES")
    names = list(QUERIES) if wanted == "all" else wanted.split(",") if wanted else HEADLINE
    partitions = int(cpus) if cpus.isdigit() else os.cpu_count()
    spark = build_session("toolmill-bench", master=f"local[{cpus}]", partitions=partitions)
    spark.sparkContext.setLogLevel("ERROR")
    QUERIES["a11_model_comparison"](spark, folder).write.format("noop").mode("overwrite").save()  # starts the JVM code paths

    seconds = {}
    for name in names:
        start = time.perf_counter()
        QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
        print(f"{name} {seconds[name]}", file=sys.stderr, flush=True)
    scale = re.search(r"sf([0-9.]+)", folder)
    print(json.dumps({
        "metric": "total_query_seconds", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds,
        "sf": float(scale.group(1)) if scale else None, "cpus": cpus,
    }))
    spark.stop()


if __name__ == "__main__":
    main()
