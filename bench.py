"""Benchmark of the headline queries.

Runs each query over the whole tables of ``$BENCH_SF_DIR`` (default
/root/testdata/sf0.1) on ``local[$BENCH_CPUS]`` and prints one JSON line.
Each query is executed to completion through the ``noop`` sink (all rows
computed, nothing collected to the driver). Each query runs twice and the
second (warm: JVM, code generation and Python workers ready) run is
reported; cached data is cleared before every run, so no result is reused.
The cold times are printed in ``cold``.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "match_best",              # flagship: band join + date window + arg-max, one row per invoice
    "argmax_best",             # competing candidates (orders x lineitem, tolerance 5.00)
    "extract_invoice_fields",  # document text -> sections -> fields
    "harmonise_statements",    # column detection + harmonisation of four layouts
    "src_csv_sniff",           # delimited statements with separator sniffing
    "src_statement_lines",     # statement text lines -> transactions
    "summary_counts",          # match + both flag joins + one aggregation
    "summary_invoices",        # whole flow: documents + statement lines -> flagged invoices
]


def main():
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    from ledgermatch.session import get_spark
    from ledgermatch.plans.registry import QUERIES
    spark = get_spark(f"local[{cpus}]", int(cpus) * 2, app_name="ledgermatch-bench",
                      extra={"spark.driver.memory": os.environ.get("BENCH_DRIVER_MEMORY", "16g")})
    # warm-up: JVM, parquet reader, codegen caches
    QUERIES["pred_date_window"](spark, sf_dir).write.format("noop").mode("overwrite").save()
    times, cold = {}, {}
    for name in HEADLINE:
        for run in range(2):
            spark.catalog.clearCache()
            t0 = time.time()
            QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            (cold if run == 0 else times)[name] = round(time.time() - t0, 3)
    spark.catalog.clearCache()
    sf = os.path.basename(sf_dir.rstrip("/")).replace("sf", "")
    print(json.dumps({"metric": "headline_total", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": sf, "cold": cold}))


if __name__ == "__main__":
    main()
