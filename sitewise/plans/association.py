"""Clustered association of an outcome with a predictor, with its sensitivity set."""

from __future__ import annotations

from dataclasses import dataclass, field, replace

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitewise.operators import inference as N
from sitewise.operators.linear import Design, association_row, complete_rows, gram_names, rows_frame, solve_ols, unpack_gram
from sitewise.operators.resample import bootstrap_fit, percentile_interval
from sitewise.operators.variants import Variant, variant_fits
from sitewise.session import checkpointed


@dataclass(frozen=True)
class AssociationParams:
    outcome: str
    predictor: str
    cluster: str
    continuous: dict[str, Column] = field(default_factory=dict)
    flagged: tuple[str, ...] = ()
    categorical: tuple[str, ...] = ()
    replicates: int = 1000
    seed: int = 1
    stratum: str | None = None
    variants: tuple[Variant, ...] = ()


def primary_design(df: DataFrame, p: AssociationParams, predictor: str | None = None, stats=None, levels=None) -> Design:
    return N.association_design(df, predictor or p.predictor, p.continuous, p.flagged, p.categorical, stats=stats, levels=levels)


def coefficient_bootstrap(df: DataFrame, designs: dict[str, Design], outcome: str, predictors: dict[str, str], cluster: str,
                          replicates: int, seed: int, weights: str = "poisson", scale: dict[str, float] | None = None) -> DataFrame:
    """Cluster bootstrap of one coefficient per design, the same draws for all: ``rep`` and one column per design.

    Per-cluster cross products are formed once; a replicate only adds them up and
    solves. With two designs the difference of their columns is a paired contrast.
    Rows that lack a value of any design or the outcome take no part in any of them.
    """
    df = complete_rows(df, [F.col(outcome), *[c for d in designs.values() for c in d.columns]])
    scale = scale or {}
    named: dict[str, Column] = {}
    sums: list[str] = []
    where: dict[str, list[str]] = {}
    for name, d in designs.items():
        cols = [*d.columns, F.col(outcome)]
        named |= {f"{name}_{i}": c.cast("double") for i, c in enumerate(cols)}
        where[name] = [f"{name}_{i}_{j}" for i, j in gram_names(len(cols))]
        sums += [f"sum({name}_{i} * {name}_{j}) AS {name}_{i}_{j}" for i, j in gram_names(len(cols))]
    order = [k for keys in where.values() for k in keys]
    per_cluster = df.select(F.col(cluster).alias("_cluster"), *[c.alias(n) for n, c in named.items()]) \
        .groupBy("_cluster").agg(*[F.expr(e) for e in sums])
    spots = {n: [order.index(k) for k in keys] for n, keys in where.items()}
    sizes = {n: len(d.names) for n, d in designs.items()}
    at = {n: designs[n].names.index(predictors[n]) for n in designs}

    def solve(values):
        # The first sum of a design counts the rows drawn; a replicate may have drawn none.
        return {n: solve_ols(unpack_gram(values[spots[n]], sizes[n] + 1), sizes[n])[0][at[n]] * scale.get(n, 1.0) if values[spots[n][0]] else np.nan for n in spots}

    return bootstrap_fit(per_cluster, "_cluster", order, solve, list(designs), replicates, seed, weights)


PRIMARY = "primary"


def run_association(df: DataFrame, p: AssociationParams) -> dict[str, DataFrame]:
    """Primary fit, bootstrap interval, sensitivity family, diagnostics and strata as result tables.

    The covariates are evaluated once into a narrow table that all later passes read. The
    primary fit and the sensitivity family come from one pair of passes; the family's
    p-values are adjusted together, without the primary one.
    """
    spark = df.sparkSession
    design = primary_design(df, p)
    named = {f"_d{i}": c.cast("double") for i, c in enumerate(design.columns[2:])}
    used = dict.fromkeys(n for v in p.variants for n in (v.outcome, v.predictor))
    kept = dict.fromkeys([p.cluster, p.outcome, p.predictor, *used, *([p.stratum] if p.stratum else [])])
    flags = {f"_p{i}": F.coalesce(v.where, F.lit(False)) for i, v in enumerate(p.variants) if v.where is not None}
    weights = {f"_v{i}": v.weight for i, v in enumerate(p.variants) if v.weight is not None}
    rows = checkpointed(df.select(*kept, *[c.alias(n) for n, c in (named | flags | weights).items()]))
    covariates = Design([design.names[0], *design.names[2:]], [F.lit(1.0), *[F.col(n) for n in named]])
    family = [replace(v, where=F.col(f"_p{i}") if v.where is not None else None, weight=F.col(f"_v{i}") if v.weight is not None else None)
              for i, v in enumerate(p.variants)]
    fits = variant_fits(rows, covariates, [Variant(PRIMARY, p.outcome, p.predictor), *family], p.cluster)
    row, fit = association_row(PRIMARY, rows, fits[0].fit, p.predictor, fits[0].predictor_sd, outcome=p.outcome), fits[0].fit
    reps = coefficient_bootstrap(rows, {"beta": fit.design}, p.outcome, {"beta": p.predictor}, p.cluster, p.replicates, p.seed)
    ci = percentile_interval(reps, [], "beta").first()
    row |= {"bootstrap_ci95_low": ci["ci_low"], "bootstrap_ci95_high": ci["ci_high"], "bootstrap_replicates": ci["replicates"]}
    diag = N.residual_diagnostics(rows, fit, F.col(p.outcome).cast("double"))
    spline, curve = N.spline_sensitivity(rows, fit.design, p.predictor, p.outcome, p.cluster)
    out = {
        "primary": rows_frame(spark, [row]), "coefficients": rows_frame(spark, fit.coefficient_rows()),
        "diagnostics": rows_frame(spark, [{"metric": k, "value": float(v)} for k, v in (diag | spline).items()]),
        "spline_curve": rows_frame(spark, curve),
    }
    if family:
        out["sensitivity"] = rows_frame(spark, N.family_rows(rows, fits[1:]))
    if p.stratum:
        strata = N.stratified_fits(rows, p.stratum, fit.design, p.outcome, p.predictor, p.cluster)
        if strata:
            out["strata"] = rows_frame(spark, strata)
    return out
