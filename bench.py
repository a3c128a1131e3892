"""Times the headline queries at $BENCH_SF_DIR and prints one JSON line."""

import json
import os
import time

from pyspark.sql import SparkSession

from larkspur import queries

NAMES = ["ret_bm25_top20", "ret_fused_top10", "vec_two_pass", "dup_exact_hash", "note_utility_action", "gra_edges", "prof_columns", "lib_rubric_whole", "lib_triage_whole", "ver_conformal", "chg_diff_plan", "que_retry_circuit", "txt_head_tail"]


def main() -> None:
    sf, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = SparkSession.builder.master(f"local[{cpus}]").config("spark.sql.shuffle.partitions", cpus).config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC").config("spark.driver.memory", "8g").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    spark.range(1000).selectExpr("sum(id)").collect()
    took = {}
    for name in NAMES:
        begun = time.time()
        queries.queries()[name](spark, sf).write.format("noop").mode("overwrite").save()
        took[name] = round(time.time() - begun, 3)
    print(json.dumps({"metric": "headline queries", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": sf}))


if __name__ == "__main__":
    main()
