"""Time the headline queries: one JSON line."""

import json
import os
import time

from evidmill.plans import registry
from evidmill.session import build_session

HEADLINE = (
    "A1_cache_status_counts", "A2_cache_metrics", "A3_cache_legs", "A4_cold_warm", "A6_A8_A9_label_rollup", "A7_evidence_mix",
    "A10_ordered_refs", "A12_run_history", "A13_packet_counts", "A17_remote_metrics", "C1_C2_C3_C4_C6_compare", "C5_J6_status_deltas",
    "T1_event_stream", "T3_chapter_members", "T4_chapters", "T6_hourly_histogram", "G7_graph_summary", "G3_G4_run_attribution",
    "V1_V2_V3_V4_J7_J8_verdicts", "V6_J9_change_evidence", "E1_E2_targets", "E3_actions", "E6_E7_S2_cache_events",
    "E9_E10_E11_F3_build_facts", "R1_R2_R5_R6_R7_findings", "R8_json_findings", "R8_json_rewrite", "G5_card_partition", "W2_streamed_chapters", "D3_D4_verdicts", "K5_A23_J16_report", "A14_blocks",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", str(os.cpu_count() or 8))
    spark = build_session(
        "bench", f"local[{cpus}]",
        **{"spark.sql.shuffle.partitions": cpus, "spark.driver.memory": "16g", "spark.ui.showConsoleProgress": "false",
           "spark.log.level": "ERROR"},
    )
    queries, times = registry.queries(), {}
    registry.queries()["A11_run_group_index"](spark, sf_dir).write.format("noop").mode("overwrite").save()  # JVM warm-up
    for name in HEADLINE:
        begin = time.perf_counter()
        queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - begin, 3)
    print(json.dumps({
        "metric": "total_headline_seconds", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times,
        "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
    }))


if __name__ == "__main__":
    main()
