"""Times the headline queries over BENCH_SF_DIR on local[BENCH_CPUS] and prints one
JSON line; every query is run to its last row once, after a small warm-up."""

import importlib
import json
import os
import tempfile
import time

from pyspark.sql import SparkSession

CORE = ("text_normalize", "chunk_ids", "recursive_chunks", "sentence_split", "bm25_topk", "hybrid_fusion", "hybrid_search", "vector_topk", "retrieval_metrics", "manifest_diff", "scd2_versions", "rate_limit_window_counts", "graph_merge", "graph_neighbors", "story_search", "user_stats")


def main() -> None:
    sf, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("bench")
        .config("spark.sql.shuffle.partitions", cpus).config("spark.driver.memory", "8g").config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC").config("spark.ui.showConsoleProgress", "false")
        .config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="bench-")).getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    queries = importlib.import_module("__spark_entry__").queries()
    # the first query of each numbered problem, and the core's headline queries
    numbered: dict[str, str] = {}
    for name in queries:
        head = name.split("_")[0]
        if head[:1] == "p" and head[1:].isdigit():
            numbered.setdefault(head, name)
    names = [n for n in [*CORE, *numbered.values()] if n in queries]
    run = lambda n: queries[n](spark, sf).write.format("noop").mode("overwrite").save()
    run(names[0])
    times = {}
    for n in names:
        t = time.time()
        run(n)
        times[n] = round(time.time() - t, 3)
        spark.catalog.clearCache()
    print(json.dumps({"metric": "total_query_seconds", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": sf.rstrip("/").rsplit("sf", 1)[-1]}))


if __name__ == "__main__":
    main()
