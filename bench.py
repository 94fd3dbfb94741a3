"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import importlib.util
import json
import os
import sys
import time

ROOT = os.path.dirname(os.path.abspath(__file__))
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = ROOT + os.pathsep + os.environ.get("PYTHONPATH", "")

HEADLINE = [
    "monthly_trend", "revenue_by_supplier", "delayed_by_supplier_region", "top_products", "status_distribution", "revenue_by_region", "priority_breakdown",
    "known_values", "tag_documents", "bm25_terms", "index_terms", "bm25_topk", "vector_topk", "hybrid_weighted", "hybrid_rrf", "simple_rerank", "chunk_documents", "html_text",
    "record_triples", "graph_edges", "order_graph", "graph_bfs2", "feedback_stats", "training_triples", "daily_trend", "keyword_top20", "adjust_weights",
    "overlap_grade", "faithfulness_coverage", "metric_summary", "log_entries", "rate_window_60s", "classify_queries", "plan_specialists",
    "multi_hop", "corrective_retrieval", "answer_question", "evaluation_run", "graph_context", "graph_question_nodes", "experiment_means", "feedback_analysis", "visual_topk", "text_question_topk",
    "corrective_batch", "log_files", "csv_files", "stream_limiter", "graph_reach", "embedding_cache_runs", "metric_summary",
]
CORPUS = ["op1_toxicity", "op2_url_graph", "op3_sharding", "op4_topk_search", "op5_minhash_dedup", "op6_mixing", "op7_packing", "op8_suffix_dedup", "op9_line_dedup", "op10_fingerprints", "op11_prefix_trie", "op12_filter_audit", "op13_chat_format"]


def main() -> None:
    from pyspark.sql import SparkSession

    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", str(os.cpu_count() or 4))
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("bench")
        .config("spark.driver.memory", os.environ.get("BENCH_MEMORY", "6g"))
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    from tessera import catalogue

    found = dict(catalogue.QUERIES)
    names = list(HEADLINE)
    if importlib.util.find_spec("tessera.llm"):
        corpus = importlib.import_module("tessera.llm.queries")
        found |= corpus.QUERIES
        names += [n for n in CORPUS if n in found]
    spark.range(1000).selectExpr("sum(id)").collect()  # JVM and codegen are warm before the clock starts
    took = {}
    for name in names:
        start = time.perf_counter()
        found[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        took[name] = round(time.perf_counter() - start, 3)
    print(json.dumps({"metric": "total_seconds", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": sf_dir.rstrip("/").rsplit("sf", 1)[-1]}))


if __name__ == "__main__":
    main()
