"""Times the headline queries and prints one JSON line."""

from __future__ import annotations

import json
import os
import time

from pyspark.sql import SparkSession

from lethe.plans import catalogue

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
HEADLINE = ("email_discover", "email_mapping_hash", "email_scrub", "bearer_scrub", "ipv4_discover", "ipv4_subnets", "ipv4_scrub", "domain_extract",
            "keyword_scrub", "counts_by_category", "verify_ip_allowlist", "full_chain_scrub", "verify_after_scrub")


def main() -> None:
    spark = (SparkSession.builder.master(f"local[{CPUS}]").appName("lethe-bench").config("spark.sql.shuffle.partitions", CPUS)
             .config("spark.driver.memory", "8g").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
             .config("spark.sql.files.maxPartitionBytes", "4m").getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    spark.read.parquet(f"{SF_DIR}/documents.parquet").write.format("noop").mode("overwrite").save()
    seconds = {}
    for name in HEADLINE:
        began = time.time()
        catalogue.QUERIES[name](spark, SF_DIR).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.time() - began, 3)
    print(json.dumps({"metric": "total wall time", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds,
                      "sf": float(SF_DIR.rstrip("/").rpartition("sf")[2] or 0)}))


if __name__ == "__main__":
    main()
