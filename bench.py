"""Times the headline queries over whole tables; prints one line of JSON.

BENCH_SF_DIR: the tables (sf0.1 by default); BENCH_CPUS: threads (8). A query's rows are all made and thrown away. One
untimed run of the first query starts the JVM and the code generator; each query is timed once after it.
"""

import json
import os
import sys
import time
from pathlib import Path

from pyspark.sql import SparkSession

from lingmill.queries import QUERIES

HEADLINES = [
    "f1_ngrams_1", "f1_ngrams_2", "f1_ngrams_3", "f1_ngrams_1_by_document", "r1_occurrence_filter", "r3_pmi_filter",
    "f6_weighted_lexicon", "a2_pearson_with_p", "r6_tf_idf", "r7_standardise",
]


def main() -> None:
    sf, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .config("spark.sql.shuffle.partitions", str(max(8, int(cpus))))
        .config("spark.sql.files.maxPartitionBytes", "4m")  # else a file of a few MB is one task
        .config("spark.sql.files.openCostInBytes", "64k")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    run = lambda name: QUERIES[name](spark, sf).write.format("noop").mode("overwrite").save()
    run(HEADLINES[0])
    took, failed = {}, {}
    for name in HEADLINES:
        began = time.perf_counter()
        try:
            run(name)
        except Exception as e:  # the others' times still count
            failed[name] = str(e)[:200]
            continue
        took[name] = round(time.perf_counter() - began, 3)
        print(name, took[name], file=sys.stderr, flush=True)
    out = {"metric": "headline_queries_total", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": Path(sf).name.removeprefix("sf")}
    print(json.dumps(out | ({"failed": failed} if failed else {})))
    spark.stop()


if __name__ == "__main__":
    main()
