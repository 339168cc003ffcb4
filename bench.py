"""Times the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one line of JSON.

``duckdb`` has the seconds that DuckDB takes with as many threads for the SQL of the
"""

from __future__ import annotations

import glob
import json
import os
import sys
import time
from pathlib import Path

import duckdb
from pyspark.sql import SparkSession

from wellframe.plans import queries as core

HEADLINES = [
    "profile_build_median", "reference_robust_z", "feature_qc", "location_scale_correction", "impute_group_median", "scale_robust", "object_trim_q95", "corr_matrix_pearson",
    "key_candidate_report", "metadata_left_join", "drift_statistics", "knn_topk", "silhouette_exact", "centroid_scores", "replicate_summary", "two_sample_statistics",
]
#: Queries whose SQL would take minutes: all pairs of a table.
SLOW_SQL = {"replicate_summary"}


def duckdb_times(sf: str, cpus: str) -> dict[str, float]:
    con = duckdb.connect(config={"threads": int(cpus)})
    con.execute("SET TimeZone='UTC'")
    for path in glob.glob(f"{sf}/*.parquet"):
        con.execute(f"CREATE VIEW {Path(path).stem} AS SELECT * FROM read_parquet('{path}')")
    sql, out = core.oracle_sql(), {}
    for name in HEADLINES:
        if name in sql and name not in SLOW_SQL:
            began = time.perf_counter()
            con.execute(sql[name]).fetchall()
            out[name] = round(time.perf_counter() - began, 3)
    return out


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").config("spark.sql.shuffle.partitions", cpus).config("spark.sql.session.timeZone", "UTC").config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    runs, times = core.queries(), {}
    for name in HEADLINES:
        for _ in range(2):  # the first compiles
            began = time.perf_counter()
            runs[name](spark, sf).write.format("noop").mode("overwrite").save()
            times[name] = round(time.perf_counter() - began, 3)
    spark.stop()
    print(json.dumps({"metric": "headline queries, total of second runs", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "duckdb": duckdb_times(sf, cpus), "sf": sf}))
    sys.stdout.flush()


if __name__ == "__main__":
    main()
