"""Times the headline queries once each in a warm session; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

from pyspark.sql import SparkSession

HEADLINE = [
    "describe_by_type", "ttest_welch", "ttest_paired", "anova_one", "anova_two", "levene", "chi2_indep", "corr_pearson", "corr_spearman",
    "mann_whitney", "kruskal", "friedman", "tukey", "ols_price", "ridge_price", "logistic_quality", "poisson_qty", "pca_lineitem", "manova",
    "km_qty", "logrank_qty", "weibull_value", "gage_rr", "icc", "acf_hourly", "anomaly_hourly", "adf_hourly", "psi_halves", "adwin",
    "eprocess_gauss", "conformal", "bh", "auto_compare",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    from quillon.queries import QUERIES

    QUERIES["ttest_welch"](spark, sf_dir).collect()  # warm the session
    times, failed = {}, {}
    for name in HEADLINE:
        began = time.time()
        try:
            QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        except Exception as error:  # one query's failure is reported beside the others' times
            failed[name] = f"{type(error).__name__}: {error}"[:300]
            print(f"{name}: failed, {failed[name]}", file=sys.stderr, flush=True)
            continue
        times[name] = round(time.time() - began, 3)
        print(f"{name}: {times[name]} s", file=sys.stderr, flush=True)
    print(json.dumps({"metric": "headline queries, total wall time", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "failed": failed, "sf": os.path.basename(sf_dir.rstrip("/"))}))
    spark.stop()


if __name__ == "__main__":
    main()
