"""A sample of checked queries against their SQL, plus invariants of the site dataset."""

import os

import duckdb
import pandas as pd
import pytest
from pyspark.sql import functions as F

from sitewise import catalog
from sitewise.catalog.registry import Tables
from sitewise.operators.quality import leakage_audit, population_invariants, table_equivalence
from sitewise.plans import prediction as P

FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SAMPLE = [
    "site_dataset", "replicate_outer_join", "points_in_intervals", "interval_overlaps", "coordinate_lift", "lift_round_trip", "spliced_interval_features",
    "annotation_projection", "representative_ranking", "running_totals_skewed_key", "exact_group_quantiles", "rank_correlations", "joint_groups",
    "group_split", "fdr_adjustment", "clustered_regression", "bootstrap_coefficient_difference", "sign_flip_test", "wilcoxon_signed_rank",
    "column_profiles", "low_cardinality_counts", "flank_eligibility_rows", "eligible_control_positions", "offset_yields",
    "nearest_matched_controls", "calibration_table", "inverse_variance_pooling", "gate_evaluation", "table_equivalence", "encoder_statistics",
]

pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="test tables are not here")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{FOLDER}/{t}.parquet'")
    return con


def canonical(pdf: pd.DataFrame) -> list:
    def text(v):
        return "~" if pd.isna(v) else repr(float(v)) if isinstance(v, float) else str(v)

    return sorted(tuple(text(v) for v in r) for r in pdf[sorted(pdf.columns)].itertuples(index=False))


def test_every_sql_belongs_to_a_query():
    assert set(catalog.oracle_sql()) <= set(catalog.queries()) and set(SAMPLE) <= set(catalog.oracle_sql())


@pytest.mark.parametrize("name", SAMPLE)
def test_query_equals_its_sql(spark, duck, name):
    got = catalog.queries()[name](spark, FOLDER).toPandas()
    want = duck.execute(catalog.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert canonical(got) == canonical(want)


def test_site_dataset_invariants_and_rerun(spark):
    run = catalog.queries()["site_dataset"]
    a, b = run(spark, FOLDER), run(spark, FOLDER)
    inv = population_invariants(a.withColumn("id", F.concat_ws(":", "pos", "strand")), "id", {
        "included_needs_window": (F.col("included"), F.col("main_window_valid")),
        "included_has_no_reason": (F.col("included"), F.col("exclusion_reason") == "")})
    assert inv.agg(F.sum("violations")).first()[0] == 0
    same = table_equivalence(a, b, ["pos", "strand"], ["combined_ratio", "signal_mean"], ["exclusion_reason"]).first()
    assert same.equivalent and same.max_abs_difference == 0


def test_document_split_leaks_nothing(spark):
    d = Tables(spark, FOLDER)("documents").select("doc_id", F.floor(F.col("doc_id") / 4).cast("string").alias("node"), F.sha2("text", 256).alias("key"))
    rows = leakage_audit(P.assign_groups(d, "node", "key", 0.2, 3), "split", ["node", "key", "joint_group"]).collect()
    assert {r.variable: r.overlap for r in rows} == {"node": 0, "key": 0, "joint_group": 0}
