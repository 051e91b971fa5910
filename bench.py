"""Time the headline queries and print one JSON line.

``BENCH_SF_DIR`` (default ``/root/testdata/sf0.1``) and ``BENCH_CPUS`` (default 8) choose input and
cores. Each query is timed to a full ``noop`` write. ``prepare`` is the cost of parsing the articles
into the interim, feature and split tables that later queries read.
"""

from __future__ import annotations

import json
import os
import time

from gradeworks.operators.metrics import throughput
from gradeworks.plans import bindings as b
from gradeworks.plans import models
from gradeworks.plans.catalog import QUERIES
from gradeworks.session import build_session

HEADLINE = ["flagship_quality_by_split", "T18_clean_text", "T22_clean_record", "F34_feature_registry",
            "F38_stratified_split", "F39_temporal_holdout", "B1_resolve_label", "B6_revision_counts",
            "B13_assemble_record", "B16_grade_date", "J9_dedupe_first", "E1_feature_stats",
            "E3_mutual_information", "E4_spearman_label", "P3_softmax", "V8_all_metrics", "V10_ece",
            "V14_results_table", "V9_bootstrap_ci", "K2_spearman_proxies", "K5_review_buckets",
            "M2_logreg", "M4_random_forest", "M3_boosted_catboost", "M22_batch_score",
            "S1_stream_ingest_dedupe"]

SCORERS = {"logreg": None, "random_forest": None, "catboost": None}


def inference_cost(spark, sf: str, kind: str, params: dict | None) -> float:
    """Seconds per 1000 rows to score every article, second run."""
    table = b.model_table(spark, sf)
    scored = models.model(spark, sf, kind, params).score(table)
    rows = table.count()
    return min(throughput(scored, rows) for _ in range(2))


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session("bench", f"local[{cpus}]", int(cpus))
    spark.sparkContext.setLogLevel("ERROR")
    times: dict[str, float] = {}

    def timed(name: str, run) -> None:
        start = time.monotonic()
        run()
        times[name] = round(time.monotonic() - start, 3)

    spark.range(1000).selectExpr("sum(id)").collect()
    timed("prepare", lambda: b.model_table(spark, sf).count())
    for name in HEADLINE:
        timed(name, lambda: QUERIES[name](spark, sf).write.format("noop").mode("overwrite").save())
    per_1k = {kind: round(inference_cost(spark, sf, kind, params), 5) for kind, params in SCORERS.items()}
    print(json.dumps({"metric": "headline_total", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "infer_s_per_1k": per_1k, "sf": sf}))
    spark.stop()


if __name__ == "__main__":
    main()
