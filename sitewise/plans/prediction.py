"""Grouped split, cross-validated ridge grid, held-out evaluation and transfer."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitewise.operators.encoding import FeatureSpec
from sitewise.operators.groups import group_split, joint_groups
from sitewise.operators.joins import overlap_flags
from sitewise.operators.linear import complete_rows, rows_frame
from sitewise.operators.models import Prepared, RidgeModel, add_predictions, evaluate, final_fit, frozen_rows, grid_cv, prepare
from sitewise.operators.quality import leakage_audit
from sitewise.operators.resample import paired_error_bootstrap, percentile_interval

# Nested feature blocks of the model ladder (C common, X sequence, P predicted, R measured).
MODEL_BLOCKS = {"M0": ("C",), "M1": ("C", "X"), "M2": ("C", "X", "P"), "M3": ("C", "X", "R"), "M4": ("C", "X", "P", "R")}
MODEL_BLOCKS_WITH_R = {**MODEL_BLOCKS, "M0R": ("C", "R")}
CONTRASTS = [("M0", "M1"), ("M1", "M2"), ("M1", "M3"), ("M2", "M4")]


def assign_groups(df: DataFrame, node: str, shared: str, test_fraction: float, seed: int) -> DataFrame:
    """Rows with ``joint_group`` and ``split``; linked rows never part."""
    grouped = joint_groups(df, node, shared)
    split = group_split(grouped, "joint_group", test_fraction, seed).select("joint_group", "split")
    return grouped.join(split, "joint_group")


def train_and_test(df: DataFrame, spec: FeatureSpec, y: str, models: dict[str, Sequence[str]], alphas: Sequence[float], folds: int,
                   replicates: int, seed: int, audit: Sequence[str] = (), reject_boundary: bool = True):
    """Select on development rows, fit, predict the test rows, bootstrap the contrasts.

    A best penalty on the edge of its grid is refused unless the caller says otherwise.

    Returns result tables, the fitted models and the prepared development data.
    """
    spark = df.sparkSession
    dev, test = df.where("split = 'development'"), df.where("split = 'test'")
    prep = prepare(dev, spec, [y], "joint_group", folds)
    rows, picked = grid_cv(prep, models, alphas, reject_boundary=reject_boundary)
    fitted = [final_fit(prep, m, models[m], picked[m]["alpha"]) for m in models]
    tested = add_predictions(frozen_rows(test, prep), fitted)
    names = list(models)
    contrasts = [(a, b) for a, b in CONTRASTS if a in models and b in models] or [(names[0], n) for n in names[1:]]
    boot = contrast_intervals(tested, y, names, contrasts, replicates, seed)
    out = {"cv": rows_frame(spark, rows), "test_metrics": evaluate(tested, y, names), "contrasts": boot,
           "leakage": leakage_audit(df, "split", ["joint_group", *audit])}
    return out, fitted, prep


def contrast_intervals(rows: DataFrame, y: str, names: Sequence[str], contrasts: Sequence[tuple[str, str]], replicates: int, seed: int,
                       group: str = "joint_group") -> DataFrame:
    """Point estimate and percentile interval per contrast, over rows with the outcome and all predictions."""
    rows = complete_rows(rows, [F.col(y), *[F.col(f"prediction_{n}") for n in names]])
    reps = paired_error_bootstrap(rows, group, y, [f"prediction_{n}" for n in names],
                                  [(f"prediction_{a}", f"prediction_{b}") for a, b in contrasts], replicates, seed)
    ci = percentile_interval(reps, ["comparison"], "delta_mae")
    points = rows.agg(*[
        F.avg(F.abs(F.col(y) - F.col(f"prediction_{a}")) - F.abs(F.col(y) - F.col(f"prediction_{b}"))).alias(f"prediction_{b}_vs_prediction_{a}")
        for a, b in contrasts])
    long = points.select(F.explode(F.array(*[F.struct(F.lit(c).alias("comparison"), F.col(c).alias("delta_mae")) for c in points.columns])).alias("r")).select("r.*")
    return long.join(ci, "comparison").withColumn("comparison", F.replace("comparison", F.lit("prediction_"), F.lit("")))


def cohort_intervals(rows: DataFrame, cohorts: dict[str, Column], y: str, names: Sequence[str], contrasts: Sequence[tuple[str, str]], replicates: int,
                     seed: int, group: str = "joint_group") -> DataFrame:
    """``cohort`` and the columns of :func:`contrast_intervals` for every cohort of rows, the same draws in each."""
    parts = [contrast_intervals(rows.where(where), y, names, contrasts, replicates, seed, group).withColumn("cohort", F.lit(c)) for c, where in cohorts.items()]
    return reduce(DataFrame.unionByName, parts)


def transfer(external: DataFrame, development: DataFrame, prep: Prepared, fitted: Sequence[RidgeModel], y: str,
             overlap: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """Frozen models on another dataset: metrics of all rows and of rows sharing nothing with development, and the rows.

    The rows carry ``strict`` for :func:`cohort_intervals` (see :func:`transfer_contrasts`).
    """
    flagged = overlap_flags(external, {"dev": development}, list(overlap))
    shares = reduce(lambda a, b: a | b, [F.coalesce(F.col(f"dev_{c}_overlap"), F.lit(False)) for c in overlap])
    rows = add_predictions(frozen_rows(flagged.withColumn("strict", ~shares), prep), fitted)
    cohorts = rows.withColumn("cohort", F.explode(F.array_compact(F.array(F.lit("all"), F.when(F.col("strict"), F.lit("strict"))))))
    return evaluate(cohorts, y, [m.name for m in fitted], ["cohort"]), rows


def transfer_contrasts(rows: DataFrame, fitted: Sequence[RidgeModel], y: str, replicates: int, seed: int, group: str = "joint_group") -> DataFrame:
    """Bootstrap intervals of the ladder's contrasts per cohort of transferred rows."""
    names = [m.name for m in fitted]
    contrasts = [(a, b) for a, b in CONTRASTS if a in names and b in names] or [(names[0], n) for n in names[1:]]
    return cohort_intervals(rows, {"all": F.lit(True), "strict": F.col("strict")}, y, names, contrasts, replicates, seed, group)
