"""Times the headline queries, each run twice: the first time is cold, the second counts. Prints one JSON line."""

from __future__ import annotations

import json
import os
import tempfile
import time

from pyspark.sql import SparkSession

from roadloom.plans import registry

HEADLINE = ["g1_quality_mix", "q1_w2_w3_imputed_motion", "b13_time_features", "w4_missing_runs", "w6_look_ahead", "g19_threshold", "m2_product_circuit", "r5_degrees", "g21_level_transitions", "j1_j2_candidates", "j5_j6_j7_j8_road_matches", "g7_u2_u3_validation", "x3_rank_biserial"]


def main() -> None:
    sf_dir, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.checkpoint.dir", f"file://{tempfile.mkdtemp(prefix='bench-')}")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    cold, took = {}, {}
    for name in HEADLINE:
        for times in (cold, took):
            began = time.time()
            registry.queries()[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            times[name] = round(time.time() - began, 3)
    print(json.dumps({"metric": "headline queries, total", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "cold": cold, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")}))


if __name__ == "__main__":
    main()
