"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line.

Every query runs once to the end with its whole result written to the no-op sink.  Names given
on the command line select queries.  The given tables are one file of one row group each, which one
task reads whatever the plan; before the clock starts they are written again in several files, as a
table of any size has them.  BENCH_FILES=1 leaves them as they are.
"""

from __future__ import annotations

import glob
import json
import os
import sys
import tempfile
import time

from pyspark.sql import SparkSession

HEADLINE = [
    "semantic_chunks", "pack_paragraphs", "paragraph_chunks", "process_documents", "key_terms", "filter_noncontent", "dedup_questions",
    "index_build", "bm25", "keyword_search", "knn", "knn_all_queries", "hybrid_search", "rerank",
    "rag_context", "multi_hop", "parse_mcq", "best_of_n", "format_chatml", "train_valid_split",
    "early_stopping", "grade_quiz", "study_progress",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("bench")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "16g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="spark-", dir="/tmp"))
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    from lectern.plans import catalog, search_queries
    from lectern.sources.tables import read_table

    files, given = int(os.environ.get("BENCH_FILES", 4 * int(cpus))), folder
    if files > 1:
        folder = f"{spark.conf.get('spark.checkpoint.dir')}/tables"
        for path in sorted(glob.glob(f"{given}/*.parquet")):
            name = os.path.basename(path)
            spark.read.parquet(path).repartition(files).write.parquet(f"{folder}/{name}")
    read_table(spark, folder, "documents").count()  # start the executors before the clock
    times: dict[str, float] = {}
    names = sys.argv[1:] or HEADLINE
    for name in names:
        start = time.perf_counter()
        if name == "index_build":
            search_queries._INDEXES[(spark.sparkContext.applicationId, folder)] = search_queries.build_index(spark, folder)
        else:
            catalog.QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
        print(f"{name} {times[name]}", file=sys.stderr, flush=True)
    print(json.dumps({
        "metric": "total_wall_clock", "value": round(sum(times.values()), 3), "unit": "sec",
        "queries": times, "files": files, "sf": given.rstrip("/").rsplit("sf", 1)[-1],
    }))
    spark.stop()


if __name__ == "__main__":
    main()
