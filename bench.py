"""Headline queries, timed.  Prints one JSON line.

``BENCH_SF_DIR`` names the folder of tables, ``BENCH_CPUS`` the local cores.
Every query runs ``BENCH_RUNS`` times after one warm-up; the median counts.
Build steps (index, postings) are timed apart from the searches that use them.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import DataFrame, SparkSession

from doclake.operators import dedup, fragments, quality, search
from doclake.plans.registry import QUERIES
from doclake.plans.views import TABLES, Views
from doclake.session import new_shared_path, remove_stored
from doclake.sources import index as index_store

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
RUNS = int(os.environ.get("BENCH_RUNS", "2"))

REGISTERED = [
    "assemble_pages", "plain_texts", "split_sections", "fragments_of_markdown", "fragments_of_pages",
    "viewer_fragments", "document_noise", "catalog_documents", "category_counts", "duplicate_groups",
    "duplicate_delete_plan", "sanitize_names", "search_terms", "fragment_page", "replace_documents",
]


def session() -> SparkSession:
    spark = (
        SparkSession.builder.master(f"local[{CPUS}]")
        .appName("doclake-bench")
        .config("spark.sql.shuffle.partitions", CPUS)
        .config("spark.sql.files.minPartitionNum", CPUS)
        .config("spark.sql.files.openCostInBytes", "65536")
        .config("spark.sql.adaptive.coalescePartitions.minPartitionSize", "65536")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "16g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def run(df: DataFrame) -> None:
    df.write.format("noop").mode("overwrite").save()


def timed(action) -> float:
    action()
    times = []
    for _ in range(RUNS):
        start = time.perf_counter()
        action()
        times.append(time.perf_counter() - start)
    return round(statistics.median(times), 3)


def dealt_tables(spark: SparkSession) -> str:
    """The tables in as many files as there are cores, as large tables are stored.

    A given table of this size is one row group, which is one task.
    """
    path = new_shared_path(spark, "tables")
    for name in TABLES:
        rows = spark.read.parquet(f"{SF_DIR}/{name}.parquet")
        rows.repartition(int(CPUS)).write.parquet(f"{path}/{name}.parquet")
    return path


def main() -> None:
    spark = session()
    tables = dealt_tables(spark)
    views = Views(spark, tables)
    results: dict[str, float] = {}

    for name in REGISTERED:
        results[name] = timed(lambda: run(QUERIES[name](spark, tables)))
        remove_stored(spark)

    pages = views.page_texts()
    path = new_shared_path(spark, "bench")
    results["build_index"] = timed(
        lambda: index_store.write_index(fragments.fragments_from_pages(pages), f"{path}/rows")
    )
    index = index_store.read_index(spark, f"{path}/rows")
    results["build_postings"] = timed(lambda: index_store.write_postings(index, path))
    posted, vocab = index_store.read_postings(spark, path)
    results["scanned_documents"] = timed(lambda: run(quality.scanned_documents(index)))

    many = views.search_requests()
    few = many.where("query_id < 1000")
    for label, requests in (("12", few), ("200", many)):
        results[f"search_scan_{label}"] = timed(lambda: run(search.search(index, requests, vocab)))
        results[f"search_postings_{label}"] = timed(
            lambda: run(search.search_stored(index, requests, posted, vocab))
        )
    results["search_one"] = timed(lambda: search.search_one(index, "of the", 10).collect())
    results["purge_index"] = timed(lambda: run(dedup.purge(index, dedup.delete_plan(views.library_files()))))

    remove_stored(spark)
    print(
        json.dumps(
            {
                "metric": "sum of median query times",
                "value": round(sum(results.values()), 3),
                "unit": "sec",
                "queries": results,
                "sf": os.path.basename(SF_DIR.rstrip("/")).removeprefix("sf"),
                "cpus": CPUS,
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
