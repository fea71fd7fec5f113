"""Time the headline queries; prints one JSON line."""

from __future__ import annotations

import json
import os
import time

from sitewise import build_session
from sitewise.catalog import queries

# Stand for the published stages: dataset build, interval and lift joins, association with
# bootstrap, grid cross-validation, transfer, nested validation, pooling and enrichment.
HEADLINE = [
    "site_dataset", "points_in_intervals", "interval_overlaps", "coordinate_lift", "lift_round_trip", "replicate_outer_join",
    "column_profiles", "representative_rows", "representative_ranking", "exact_group_quantiles", "rank_correlations",
    "clustered_regression", "association_analysis", "bootstrap_coefficient_difference", "paired_error_bootstrap",
    "inverse_variance_pooling", "kmer_profile_by_language", "joint_groups", "grouped_cv_ridge_grid", "block_comparison_cv",
    "frozen_model_transfer", "nested_cross_validation", "conditional_dependence", "keyed_enrichment",
    "held_out_evaluation", "boosted_tree_grid", "block_permutation_importance", "greedy_matched_controls",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = [n for n in os.environ.get("BENCH_QUERIES", "").split(",") if n] or HEADLINE
    spark = build_session("bench", f"local[{cpus}]", int(cpus), **{
        "spark.driver.memory": os.environ.get("BENCH_MEMORY", "16g"), "spark.ui.enabled": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    table = queries()
    spark.read.parquet(f"{folder}/nation.parquet").count()
    seconds = {}
    for name in names:
        start = time.time()
        table[name](spark, folder).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.time() - start, 3)
    print(json.dumps({"metric": "headline_total", "value": round(sum(seconds.values()), 3), "unit": "sec",
                      "queries": seconds, "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf")}))


if __name__ == "__main__":
    main()
