"""Time the headline queries: one JSON line with the median of three warm runs of each."""

import json
import os
import time
from statistics import median

from pyspark.sql import SparkSession

from graphloom import queries

HEADLINE = ("n2_blast_radius", "g12_dependents_top50", "n5_pagerank", "n8_components", "d1_snapshot_diff", "j1_route_join", "f1_routes", "a1_merge_facts")


def main() -> None:
    sf_dir, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = SparkSession.builder.master(f"local[{cpus}]").config("spark.sql.shuffle.partitions", cpus).config("spark.driver.memory", "8g").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    took = {}
    for name in HEADLINE:
        runs = []
        for i in range(3):
            t = time.time()
            queries.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            runs.append(time.time() - t)
        took[name] = round(median(runs), 3)
    print(json.dumps({"metric": "total seconds of the headline graph queries", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": sf_dir.rsplit("sf", 1)[-1]}))


if __name__ == "__main__":
    main()
