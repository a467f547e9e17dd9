"""Time the headline queries: one JSON line on stdout.

BENCH_SF_DIR picks the tables, BENCH_CPUS the cores of the local session. Each query runs to a full write to the
no-op sink; one small warm-up starts the JVM and the Python workers.
"""

from __future__ import annotations

import json
import os
import sys
import time

from runlore.queries import QUERIES
from runlore.session import get_spark

HEADLINE = [
    "redact_sensitive",
    "sliding_window_chunks",
    "sentence_chunks",
    "section_chunks",
    "chunks_by_type",
    "ticket_documents",
    "wiki_documents",
    "language_detection",
    "embedding_cache_split",
    "embedded_chunks",
    "incremental_add",
    "vector_topk",
    "vector_topk_grid",
    "vector_topk_post_filter",
    "vector_topk_pre_filter",
    "vector_topk_centroid_cells",
    "vector_topk_projection_cells",
    "bm25_topk",
    "reranked_candidates",
    "lexical_retrieval",
    "dense_retrieval",
    "incident_prompts",
    "incident_diagnoses",
    "evaluation_metrics",
    "request_metrics",
    "stream_request_metrics",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = get_spark("runlore-bench", master=f"local[{cpus}]", shuffle_partitions=int(cpus) if cpus.isdigit() else 8)
    spark.sparkContext.setLogLevel("ERROR")
    QUERIES["vector_topk"](spark, sf_dir).limit(1).collect()
    times = {}
    for name in sys.argv[1:] or HEADLINE:
        started = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - started, 3)
        print(f"{name} {times[name]}", file=sys.stderr, flush=True)
    print(json.dumps({
        "metric": "headline queries, total wall time",
        "value": round(sum(times.values()), 3),
        "unit": "sec",
        "queries": times,
        "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
    }))


if __name__ == "__main__":
    main()
