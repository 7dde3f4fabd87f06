"""Time the headline queries at ``$BENCH_SF_DIR`` on ``local[$BENCH_CPUS]``; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from evigraph.plans import catalog  # noqa: E402
from evigraph.plans.inputs import Inputs  # noqa: E402
from evigraph.session import build_session  # noqa: E402

HEADLINE = (
    # graph build and text
    "src5_duplicate_flag", "src10_html_blocks", "g1_chunk_offsets", "g2_chunk_rows", "g4_heuristic_entities", "g5_sentence_relations",
    "g6_entities", "g7_relations", "x6_redact_documents",
    # predicates, joins, measures
    "f4_supported_relations", "f5_supported_entities", "j1_citations", "j9_endpoint_resolution", "ag5_ag6_node_metrics",
    "ag7_community_stats", "ag10_graph_digest",
    # graph queries
    "q2_entity_search", "q3_neighbours", "q7_graph_summary", "q8_explorer_nodes", "l4_all_relation_pages",
    "q4_bounded_walk", "q5_shortest_paths", "q13_evidence_traversal", "q17_garbage", "q15_communities",
    # experience store
    "ag12_ag13_patterns", "am5_am6_search", "am11_supersession_chains", "am13_confidence_feedback", "am23_idempotent_create",
    # code, evaluation, streaming
    "cg5_j10_code_relations", "ev2_retrieval_report", "st4_running_patterns",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = sys.argv[1:] or HEADLINE
    spark = build_session("bench", f"local[{cpus}]", **{
        "spark.sql.shuffle.partitions": cpus, "spark.driver.memory": os.environ.get("BENCH_MEMORY", "16g"),
        "spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    Inputs(spark, sf_dir).lineitem.write.format("noop").mode("overwrite").save()  # starts the JVM's caches
    seconds: dict[str, float] = {}
    for name in names:
        start = time.perf_counter()
        catalog.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
        print(f"{name} {seconds[name]}", file=sys.stderr, flush=True)
    print(json.dumps({
        "metric": "headline_total", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds,
        "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"), "cpus": int(cpus)}))
    spark.stop()


if __name__ == "__main__":
    main()
