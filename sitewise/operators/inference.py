"""Adjusted p-values, rank and sign tests, and association families."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitewise.operators.linear import (
    Design, Fit, association_row, chi2_sf, complete_rows, fit_ols, fit_ols_by, gram, key_table, normal_p, solve_ols, wald_joint,
)
from sitewise.operators.ordering import average_ranks, medians, on_keys, quantile_array, running
from sitewise.operators.variants import VariantFit


def bh_adjust(df: DataFrame, families: Sequence[str], p: str, ids: Sequence[str], name: str = "q_value") -> DataFrame:
    """Benjamini-Hochberg within families: p*m/rank, running minimum from the top, capped at 1."""
    keys = list(families)
    sizes = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_m"))
    sized = df.alias("l").join(sizes.alias("r"), on_keys("l", "r", keys)).select("l.*", "r._m") if keys else df.withColumn("_m", sizes.scalar())
    ranked = running(sized, keys, [F.col(p), *ids], {"_rank": ("sum", F.lit(1).cast("long"))})
    raw = ranked.withColumn("_raw", F.col(p) * F.col("_m") / F.col("_rank"))
    low = running(raw, keys, [F.col("_rank").desc()], {"_min": ("min", F.col("_raw"))})
    return low.withColumn(name, F.least(F.col("_min"), F.lit(1.0))).drop("_m", "_rank", "_raw", "_min")


def bh_list(p_values: Sequence[float]) -> list[float]:
    """BH for the few p-values of one result table."""
    p = np.asarray(p_values, dtype=float)
    order = np.argsort(-p, kind="stable")
    rank = np.arange(len(p), 0, -1)
    out = np.empty(len(p))
    out[order] = np.minimum(1.0, np.minimum.accumulate(p[order] * len(p) / rank))
    return out.tolist()


def wilcoxon_signed_rank(df: DataFrame, value: str, keys: Sequence[str] = ()) -> DataFrame:
    """Signed-rank statistic with average ranks, zeros dropped, tie-corrected normal z."""
    keys = list(keys)
    nz = df.where(F.col(value) != 0).select(*keys, F.abs(value).alias("_a"), (F.col(value) > 0).alias("_pos"))
    per_value = nz.groupBy(*keys, "_a").agg(F.count_if("_pos").alias("_p"), F.count_if(~F.col("_pos")).alias("_q"))
    ranks = average_ranks(per_value, keys, "_a", "_rank", F.col("_p") + F.col("_q"))
    j = per_value.alias("l").join(ranks.alias("r"), on_keys("l", "r", [*keys, "_a"])).select("l.*", "r._rank", "r.ties")
    t = F.col("ties").cast("double")
    s = j.groupBy(*keys).agg(
        F.sum("ties").alias("n"), F.sum(F.col("_p") * F.col("_rank")).alias("w_plus"),
        F.sum(F.col("_q") * F.col("_rank")).alias("w_minus"), F.sum(t * t * t - t).alias("_ties"))
    n = F.col("n").cast("double")
    var = n * (n + 1) * (2 * n + 1) / 24 - F.col("_ties") / 48
    stat = F.least("w_plus", "w_minus")
    return s.select(*keys, "n", "w_plus", "w_minus", stat.alias("statistic"),
                    F.try_divide(stat - n * (n + 1) / 4, F.sqrt(var)).alias("z"))


def binomial_sign_test(df: DataFrame, value: str) -> dict:
    """Exact two-sided sign test, zeros excluded. Only the two counts leave the cluster."""
    row = df.agg(F.count_if(F.col(value) < 0).alias("lower"), F.count_if(F.col(value) != 0).alias("n")).first()
    k, n = row["lower"], row["n"]
    return {"n": n, "lower": k, "fraction_lower": k / n if n else math.nan, "exact_binomial_p": binomial_two_sided(k, n)}


def binomial_two_sided(k: int, n: int) -> float:
    """P of a count at least as far from n/2 as ``k`` under p = 1/2."""
    if n == 0 or 2 * k == n:
        return 1.0
    tail = min(k, n - k)
    log_half = n * math.log(0.5)
    top = math.lgamma(n + 1)
    total, i = 0.0, tail
    while i >= 0:
        term = math.exp(top - math.lgamma(i + 1) - math.lgamma(n - i + 1) + log_half)
        total += term
        if term < total * 1e-18:
            break
        i -= 1
    return min(1.0, 2 * total)


def levels_of(df: DataFrame, columns: Sequence[str], missing: str | None = None, most: int | None = None) -> dict[str, list[str]]:
    """Sorted levels of categorical columns: as many as the design gets dummy columns.

    ``most`` is the caller's bound on them; it is tested by a distinct count.
    """
    out = {}
    for c in columns:
        col = F.col(c).cast("string")
        col = F.coalesce(col, F.lit(missing)) if missing is not None else col
        if most is not None and df.agg(F.count_distinct(col).alias("n")).first()["n"] > most:
            raise ValueError(f"{c} has more than {most} levels")
        found = [r["v"] for r in df.select(col.alias("v")).distinct().collect()]
        out[c] = sorted(v for v in found if v is not None)
    return out


def design_stats(df: DataFrame, continuous: dict[str, Column], ddof: int = 1) -> dict[str, tuple[float, float, float]]:
    """Median, mean and sd (after filling with the median) of each covariate."""
    if not continuous:
        return {}
    named = df.select(*[c.cast("double").alias(n) for n, c in continuous.items()])
    found = {r["variable"]: r["median"] for r in medians(named, [], list(continuous)).collect()}
    middle = {n: float(found.get(n) or 0.0) for n in continuous}
    sd = F.stddev_samp if ddof == 1 else F.stddev_pop
    row = named.agg(*[x for n in continuous for x in (
        F.avg(F.coalesce(n, F.lit(middle[n]))).alias(f"{n}__m"), sd(F.coalesce(n, F.lit(middle[n]))).alias(f"{n}__s"))]).first()
    return {n: (middle[n], float(row[f"{n}__m"] or 0.0), float(row[f"{n}__s"]) if row[f"{n}__s"] else 1.0) for n in continuous}


def association_design(df: DataFrame, predictor: str, continuous: dict[str, Column], flagged: Sequence[str] = (),
                       categorical: Sequence[str] = (), ddof: int = 1, extra: Sequence[str] = (),
                       stats: dict | None = None, levels: dict | None = None) -> Design:
    """Intercept, predictor, z-scored covariates, missing flags, drop-first dummies.

    Pass ``stats`` and ``levels`` of a reference population to keep its scaling.
    """
    stats = stats or design_stats(df, continuous, ddof)
    levels = levels or levels_of(df, categorical)
    names, cols = ["Intercept", predictor], [F.lit(1.0), F.col(predictor).cast("double")]
    for e in extra:
        names.append(e)
        cols.append(F.col(e).cast("double"))
    for n, c in continuous.items():
        med, mean, sd = stats[n]
        names.append(f"z_{n}")
        cols.append((F.coalesce(c.cast("double"), F.lit(med)) - mean) / sd)
        if n in flagged:
            names.append(f"missing_{n}")
            cols.append(c.isNull().cast("double"))
    for c, found in levels.items():
        for level in found[1:]:
            names.append(f"{c}={level}")
            cols.append(F.coalesce((F.col(c).cast("string") == level).cast("double"), F.lit(0.0)))
    return Design(names, cols)


def sample_sd(df: DataFrame, column: str) -> float:
    return float(df.agg(F.stddev_samp(column)).first()[0])


def associate(name: str, df: DataFrame, design: Design, outcome: str, predictor: str, cluster: str,
              weights: Column | None = None, z: float = 1.959963984540054, **extra) -> tuple[dict, Fit]:
    """One association; the predictor's scale is its spread over the rows of the fit."""
    y = F.col(outcome).cast("double")
    df = complete_rows(df, [*design.columns, y, *([weights] if weights is not None else [])])
    fit = fit_ols(df, design, y, cluster, weights)
    return association_row(name, df, fit, predictor, sample_sd(df, predictor), z, outcome=outcome, **extra), fit


def family_rows(df: DataFrame, fits: Sequence[VariantFit]) -> list[dict]:
    """Result rows of a family of variants, their p-values adjusted together."""
    rows = [association_row(f.variant.name, df, f.fit, f.variant.predictor, f.predictor_sd, outcome=f.variant.outcome) for f in fits]
    for row, q in zip(rows, bh_list([r["p_value"] for r in rows])):
        row["q_value"] = q
    return rows


def stratified_fits(df: DataFrame, stratum: str, design: Design, outcome: str, predictor: str, cluster: str,
                    min_rows: int = 200, min_clusters: int = 100) -> list[dict]:
    """One fit per large enough stratum, adjusted as one family.

    Rows are complete rows of the design and the outcome throughout: in the sizes, the
    fits and the scale of the predictor. A stratum without any is not fitted.
    """
    y = F.col(outcome).cast("double")
    whole = complete_rows(df, [*design.columns, y])
    # A null cluster counts as one; a null stratum is a stratum.
    sizes = whole.groupBy(stratum).agg(F.count(F.lit(1)).alias("n"), (F.count_distinct(cluster) + F.max(F.col(cluster).isNull().cast("int"))).alias("g"),
                                       F.stddev_samp(predictor).alias("sd"))
    use = sizes.where((F.col("n") >= min_rows) & (F.col("g") >= min_clusters)).orderBy(stratum).collect()
    if not use:
        return []
    keep = key_table(df.sparkSession, f"_stratum {df.schema[stratum].dataType.simpleString()}", [(r[stratum],) for r in use])
    part = whole.join(keep, F.col(stratum).eqNullSafe(F.col("_stratum")), "left_semi")
    fits = fit_ols_by(part, stratum, design, y, cluster)
    rows = [association_row(f"{stratum}_{r[stratum]}", part, fits[r[stratum]], predictor, r["sd"]) for r in use]
    for row, q in zip(rows, bh_list([r["p_value"] for r in rows])):
        row["q_value"] = q
    return rows


def outcome_refits(df: DataFrame, design: Design, outcomes: Sequence[str], predictor: str, cluster: str) -> list[dict]:
    """Same design, several responses: one cross-product pass for all of them."""
    rows = []
    stacked = df.withColumn("_o", F.explode(F.array(*[
        F.struct(F.lit(i).alias("i"), F.col(o).cast("double").alias("y")) for i, o in enumerate(outcomes)])))
    # Each response keeps the rows that are complete for it.
    part = complete_rows(stacked.select("*", F.col("_o.i").alias("_i"), F.col("_o.y").alias("_y")), [*design.columns, F.col("_y")])
    fits = fit_ols_by(part, "_i", design, F.col("_y"), cluster)
    spread = {r["_i"]: r["sd"] for r in part.groupBy("_i").agg(F.stddev_samp(predictor).alias("sd")).collect()}
    for i, o in enumerate(outcomes):
        rows.append(association_row(o, df, fits[i], predictor, spread[i], outcome=o))
    return rows


def predictor_grid(df: DataFrame, predictors: Sequence[str], outcome: str, cluster: str, adjustments: dict[str, dict],
                   **labels) -> list[dict]:
    """Predictors x adjustment levels, BH within each level.

    All levels and predictors share one cross-product pass over the union of
    columns; each fit solves a sub-matrix. ``adjustments`` maps a level to the
    ``Design`` of its covariates (predictor left out).
    """
    union: dict[str, Column] = {"Intercept": F.lit(1.0)}
    for design in adjustments.values():
        union.update(zip(design.names, design.columns))
    for x in predictors:
        union[x] = F.col(x).cast("double")
    names, y = list(union), F.col(outcome).cast("double")
    df = complete_rows(df, [*union.values(), y])  # one population for the whole grid, so its fits can be compared
    g = gram(df, [*union.values(), y])[None]
    where = {n: i for i, n in enumerate(names)}
    sds = df.agg(*[F.stddev_samp(x).alias(x) for x in predictors]).first()
    rows = []
    for level, design in adjustments.items():
        part = []
        for x in predictors:
            used = ["Intercept", x, *[n for n in design.names if n not in ("Intercept", x)]]
            idx = [*[where[n] for n in used], len(names)]
            fit = fit_ols(df, Design(used, [union[n] for n in used]), y, cluster, cross=g[np.ix_(idx, idx)])
            part.append(association_row(level, df, fit, x, sds[x], 1.96, **labels))
        for row, q in zip(part, bh_list([r["p_value"] for r in part])):
            row["q_value"] = q
        rows += part
    return rows


def residual_diagnostics(df: DataFrame, fit: Fit, y: Column, low: float = 0.0, high: float = 1.0) -> dict:
    """Moments of residuals, heteroscedasticity and functional-form tests, range counts, AIC."""
    work = complete_rows(df, [*fit.design.columns, y]).select(*[c.cast("double").alias(f"_x{i}") for i, c in enumerate(fit.design.columns)],
                     fit.fitted().alias("_f"), y.alias("_y")).withColumn("_e", F.col("_y") - F.col("_f"))
    m = work.agg(F.avg("_e").alias("e1")).first()["e1"]
    d = F.col("_e") - F.lit(m)
    row = work.agg(
        F.avg(d * d).alias("m2"), F.avg(d * d * d).alias("m3"), F.avg(d * d * d * d).alias("m4"),
        F.count_if(F.col("_f") < low).alias("below"), F.count_if(F.col("_f") > high).alias("above")).first()
    p = len(fit.names)
    xs = [F.col(f"_x{i}") for i in range(p)]
    n = fit.n
    # Lagrange multiplier form: n * R2 of squared residuals on the design.
    _, _, sse, sst = solve_ols(gram(work, [*xs, F.col("_e") * F.col("_e")])[None], p)
    lm = n * (1 - sse / sst) if sst else math.nan
    _, _, sse2, _ = solve_ols(gram(work, [*xs, F.col("_f") * F.col("_f"), F.col("_y")])[None], p + 1)
    f_stat = (fit.sse - sse2) / (sse2 / (n - p - 1)) if sse2 > 0 else math.nan
    return {
        "n": n, "clusters": fit.clusters, "r_squared": fit.r2, "adjusted_r_squared": 1 - (1 - fit.r2) * (n - 1) / (n - p),
        "residual_skewness": row["m3"] / row["m2"] ** 1.5, "residual_excess_kurtosis": row["m4"] / row["m2"] ** 2 - 3,
        "breusch_pagan_lm": lm, "breusch_pagan_p": chi2_sf(lm, p - 1), "reset_f": f_stat,
        "reset_p": f_sf_one(f_stat, n - p - 1), "predictions_below": row["below"], "predictions_above": row["above"],
        "aic": fit.aic,
    }


def f_sf_one(f: float, df2: int) -> float:
    """Upper tail of F(1, df2): twice the t tail, through the incomplete beta fraction."""
    if not f > 0:
        return 1.0
    x = df2 / (df2 + f)
    return _beta_inc(df2 / 2, 0.5, x)


def _beta_inc(a: float, b: float, x: float) -> float:
    if x <= 0 or x >= 1:
        return 0.0 if x <= 0 else 1.0
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))
    if x > (a + 1) / (a + b + 2):
        return 1 - _beta_inc(b, a, 1 - x)
    c, d = 1.0, 1 / max(1 - (a + b) * x / (a + 1), 1e-300)
    h = d
    for m in range(1, 5000):
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)),
                    -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 / (1 + num * d or 1e-300)
            c = 1 + num / c
            h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return front * h / a


def spline_basis(df: DataFrame, x: str, knots: int = 4) -> tuple[list[str], list[Column], np.ndarray, np.ndarray]:
    """Natural cubic spline columns centred on their means, knots at equal quantiles.

    Four knots give three columns and span the same space as any other natural
    cubic basis with those knots, so fits, curves and joint tests agree.
    """
    probs = [i / (knots - 1) for i in range(knots)]
    t = np.asarray(df.select(quantile_array(df, x, probs).alias("q")).first()["q"], dtype=float)
    cols = spline_columns(F.col(x).cast("double"), t)
    means = df.agg(*[F.avg(c).alias(f"m{i}") for i, c in enumerate(cols)]).first()
    centre = np.array([means[i] for i in range(len(cols))])
    return [f"spline_{x}_{i + 1}" for i in range(len(cols))], [c - F.lit(float(m)) for c, m in zip(cols, centre)], t, centre


def spline_columns(x: Column, t: np.ndarray) -> list[Column]:
    """Linear term and truncated-power natural cubic terms for knots ``t``, scaled by the range."""
    span = float(t[-1] - t[0]) or 1.0

    def cube(at: float) -> Column:
        d = F.greatest((x - F.lit(float(at))) / span, F.lit(0.0))
        return d * d * d

    last, before = float(t[-1]), float(t[-2])

    def term(k: float) -> Column:
        return (cube(k) - cube(last)) / ((last - k) / span) - (cube(before) - cube(last)) / ((last - before) / span)

    return [(x - F.lit(float(t[0]))) / span, *[term(float(k)) for k in t[:-2]]]


def spline_sensitivity(df: DataFrame, design: Design, predictor: str, outcome: str, cluster: str,
                       points: int = 140) -> tuple[dict, list[dict]]:
    """Replace the linear predictor by a spline: joint Wald test and the adjusted curve with its band."""
    df = complete_rows(df, [*design.columns, F.col(outcome)])
    names, cols, t, centre = spline_basis(df, predictor)
    base = design.without([predictor])
    full = Design([*base.names, *names], [*base.columns, *cols])
    fit = fit_ols(df, full, F.col(outcome).cast("double"), cluster)
    stat, dof = wald_joint(fit, [n for n in names if n in fit.names])
    ends = df.select(quantile_array(df, predictor, [0.01, 0.99]).alias("q")).first()["q"]
    grid = np.linspace(ends[0], ends[1], points)
    means = df.agg(*[F.avg(c).alias(f"m{i}") for i, c in enumerate(fit.design.columns)]).first()
    rows = np.repeat(np.array([[float(v) for v in means]]), points, axis=0)
    basis = _spline_values(grid, t) - centre
    for i, n in enumerate(names):
        if n in fit.names:
            rows[:, fit.names.index(n)] = basis[:, i]
    mean = rows @ fit.beta
    se = np.sqrt(np.einsum("ij,jk,ik->i", rows, fit.cov, rows))
    curve = [{"x": float(a), "adjusted": float(b), "ci95_low": float(b - 1.96 * s), "ci95_high": float(b + 1.96 * s)}
             for a, b, s in zip(grid, mean, se)]
    summary = {"spline_r_squared": fit.r2, "wald_chi2": stat, "wald_df": dof, "wald_p": chi2_sf(stat, dof),
               "spline_aic": fit.aic, "sites": fit.n, "clusters": fit.clusters}
    return summary, curve


def _spline_values(x: np.ndarray, t: np.ndarray) -> np.ndarray:
    span = (t[-1] - t[0]) or 1.0

    def cube(at):
        return np.maximum((x - at) / span, 0) ** 3

    def term(k):
        return (cube(k) - cube(t[-1])) / ((t[-1] - k) / span) - (cube(t[-2]) - cube(t[-1])) / ((t[-1] - t[-2]) / span)

    return np.column_stack([(x - t[0]) / span, *[term(k) for k in t[:-2]]])


def influence_summary(df: DataFrame, fit: Fit, y: Column) -> dict:
    """Largest Cook's distance, how many exceed 4/n, and the design rank."""
    p, n = len(fit.names), fit.n
    s2 = fit.sse / (n - p)
    x = F.array(*[c.cast("double") for c in fit.design.columns])
    work = df.select(x.alias("_x"), (y - fit.fitted()).alias("_e"))
    leverage = None
    for i in range(p):
        row = F.array(*[F.lit(float(v)) for v in fit.bread[i]])
        dot = F.aggregate(F.zip_with(row, F.col("_x"), lambda a, b: a * b), F.lit(0.0), lambda acc, v: acc + v)
        term = F.get(F.col("_x"), F.lit(i)) * dot
        leverage = term if leverage is None else leverage + term
    work = work.withColumn("_h", leverage)
    cook = F.col("_e") * F.col("_e") * F.col("_h") / (p * s2 * (1 - F.col("_h")) * (1 - F.col("_h")))
    row = work.agg(F.max(cook).alias("m"), F.count_if(cook > 4.0 / n).alias("k")).first()
    return {"max_cooks_distance": row["m"], "influential_cooks_gt_4_over_n": row["k"],
            "design_rank": int(np.linalg.matrix_rank(fit.bread)), "design_columns": p}


def paired_endpoints(df: DataFrame, row_id: str, endpoints: Sequence[str], replicates: int, seed: int) -> list[dict]:
    """Shift endpoints of paired differences: location, interval, rank and sign tests, BH over endpoints."""
    from sitewise.operators.resample import bootstrap_median, percentile_interval, sign_flip_test

    middle = {r["variable"]: r["median"] for r in medians(df, [], endpoints).collect()}
    rows = []
    for i, e in enumerate(endpoints):
        part = df.where(F.col(e).isNotNull())
        row = part.agg(F.count(e).alias("n"), F.avg(e).alias("mean"), F.stddev_samp(e).alias("sd")).first()
        w = wilcoxon_signed_rank(part, e).first()
        ci = percentile_interval(bootstrap_median(part, e, replicates, seed + i), [], "estimate").first()
        flip = sign_flip_test(part, row_id, F.col(e), replicates, seed + 100 + i).first()
        rows.append({
            "endpoint": e, "n": row["n"], "paired_median_shift": middle[e], "bootstrap_ci95_low": ci["ci_low"],
            "bootstrap_ci95_high": ci["ci_high"], "paired_mean_shift": row["mean"], "paired_sd": row["sd"],
            "wilcoxon_statistic": w["statistic"], "wilcoxon_z": w["z"], "p_value": normal_p(w["z"]),
            "sign_flip_mean_p": flip["p_value"]})
    for row, q in zip(rows, bh_list([r["p_value"] for r in rows])):
        row["q_value_bh"] = q
        row["ci_excludes_zero"] = not row["bootstrap_ci95_low"] <= 0 <= row["bootstrap_ci95_high"]
    return rows
