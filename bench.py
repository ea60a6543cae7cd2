"""Times the headline queries and prints one JSON line."""

import json
import os
import time

from pyspark.sql import SparkSession

from lorewell.plans import registry

HEADLINE = (
    "bm25_search", "dense_topk_cosine", "rrf_hybrid", "doc_recall", "doc_chunk_rank", "document_list_stats", "chunk_documents", "md5_dedup", "tenant_usage", "directory_descendants",
    "golden_eval", "golden_match", "index_build_dedup", "linear_hits", "attach_sources",
)


def main() -> None:
    sf_dir, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("bench").config("spark.sql.shuffle.partitions", cpus).config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    spark.range(1000).selectExpr("sum(id)").collect()
    times = {}
    for name in HEADLINE:
        runs = []
        for _ in range(2):
            start = time.time()
            registry.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            runs.append(time.time() - start)
        times[name] = round(min(runs), 3)
    print(json.dumps({"metric": "total warm time of the headline queries", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": sf_dir.rstrip("/").rsplit("sf", 1)[-1]}))


if __name__ == "__main__":
    main()
