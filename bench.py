"""Headline queries on $BENCH_SF_DIR with local[$BENCH_CPUS]; prints one JSON line. Warm, median of three."""

from __future__ import annotations

import json
import os
import statistics
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from vitalgrain.plans import catalog  # noqa: E402
from vitalgrain.session import get_session  # noqa: E402
from vitalgrain.sources import fhir, synthetic  # noqa: E402

HEADLINES = (
    "tool03_conditions_by_name", "agg02_conditions_by_demographics", "agg03_conditions_by_month", "agg06_financial_by_patient", "agg09_financial_by_month", "agg10_drug_classes_l2",
    "tool01_search_patients", "tool02_timeline", "tool05_medication_history", "join04_enrich_medications", "join06_patient_summary", "agg14_checkpoint_stats", "agg24_performance_report",
    "win01_keep_first", "win03_requests_in_window", "agg16_duplicate_groups", "pipe08_lookup_unwind", "pipe10_facet", "stub24_visit_reasons", "stub34_payment_patterns", "dq03_reference_findings", "stm02_rate_limit_batch",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = get_session(f"local[{cpus}]", int(cpus) if cpus.isdigit() else 8)
    queries, took = catalog.queries(), {}
    for name in HEADLINES:
        runs = []
        for _ in range(4):  # the first warms up
            began = time.perf_counter()
            queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            runs.append(time.perf_counter() - began)
        took[name] = round(statistics.median(runs[1:]), 4)
    with tempfile.TemporaryDirectory() as at:  # bundles of 100 patients, scanned, transformed and written: twelve tables
        synthetic.write_bundles(f"{at}/in")
        runs = []
        for i in range(3):
            began = time.perf_counter()
            resources = fhir.ingest(fhir.scan(spark, [f"{at}/in"]), f"{at}/{i}/raw")  # each transform reads its own type
            for name, df in fhir.transform(resources).items():
                df.write.parquet(f"{at}/{i}/{name}")
            runs.append(time.perf_counter() - began)
        took["etl_100_patients"] = round(min(runs[1:]), 4)
    print(json.dumps({"metric": "total_query_seconds", "value": round(sum(took.values()), 4), "unit": "sec", "queries": took, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")}))
    spark.stop()


if __name__ == "__main__":
    main()
