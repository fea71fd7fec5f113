"""Least squares from sufficient statistics.

The data is read once for the cross-product matrix; only that p x p matrix
reaches the driver. Cluster-robust covariance reads it once more for per-cluster
score sums.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.ml.functions import array_to_vector
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Z95 = 1.959963984540054


def normal_p(z: float) -> float:
    return math.erfc(abs(z) / math.sqrt(2))


def gram_names(p: int) -> list[tuple[int, int]]:
    return [(i, j) for i in range(p) for j in range(i, p)]


def unpack_gram(values, p: int) -> np.ndarray:
    out = np.zeros((p, p))
    for (i, j), v in zip(gram_names(p), values):
        out[i, j] = out[j, i] = v if v is not None else 0.0
    return out


def complete_rows(df: DataFrame, columns: Sequence[Column]) -> DataFrame:
    """Rows without a null in any of the columns: the one rule for missing values in fits."""
    return df.where(reduce(lambda a, b: a & b, [c.isNotNull() for c in columns]))


def gram(df: DataFrame, columns: Sequence[Column], by: str | None = None) -> dict:
    """Cross products of ``columns`` over complete rows, per value of ``by`` (a small set) or under ``None``."""
    p = len(columns)
    feats = complete_rows(df, columns).select(*([by] if by else []), F.array(*[c.cast("double") for c in columns]).alias("_x"))
    found = gram_arrays(feats, "_x", p, by)
    return found if by or found else {None: np.zeros((p, p))}


def gram_arrays(df: DataFrame, features: str, p: int, by: str | None = None) -> dict:
    """As :func:`gram` for an array column: one partial matrix per task, summed row by row."""
    key_type = df.schema[by].dataType.simpleString() if by else "int"

    def partial(batches):
        sums: dict = {}
        for pdf in batches:
            x = np.vstack(pdf[features].to_numpy()) if len(pdf) else np.zeros((0, p))
            x = x.astype(float)
            keys = pdf[by].to_numpy() if by else np.zeros(len(pdf), dtype=int)
            for k in pd.unique(keys):
                part = x[pd.isna(keys) if pd.isna(k) else keys == k]
                k = None if pd.isna(k) else k
                sums[k] = sums.get(k, 0) + part.T @ part
        for k, m in sums.items():
            yield pd.DataFrame({"_k": [k] * p, "_i": range(p), "_row": list(m)})

    cols = df.select(*([by] if by else []), features)
    parts = cols.mapInPandas(partial, f"_k {key_type}, _i int, _row array<double>")
    # Vector sums combine before the shuffle, so the number of tasks does not matter.
    rows = parts.groupBy("_k", "_i").agg(Summarizer.sum(array_to_vector("_row")).alias("_row")).collect()
    out: dict = {}
    for r in rows:
        out.setdefault(r["_k"] if by else None, np.zeros((p, p)))[r["_i"]] = r["_row"].toArray()
    return out


# Fixed value: a table of keys is sent to every task if it has at most this many rows.
LOOKUP_ROWS = 20_000


def key_table(spark, schema: str, rows: Sequence[tuple]) -> DataFrame:
    """The keys a caller has at hand as a table to join with.

    The planner does not know how small it is, and a shuffle by a few keys would put the
    whole data into as few tasks.
    """
    table = spark.createDataFrame(rows, schema)
    return F.broadcast(table) if len(rows) <= LOOKUP_ROWS else table


@dataclass
class Design:
    """Named design columns; the first is the intercept."""

    names: list[str]
    columns: list[Column]
    predictor_sd: dict[str, float] = field(default_factory=dict)

    def without(self, names: Sequence[str]) -> "Design":
        keep = [i for i, n in enumerate(self.names) if n not in set(names)]
        return Design([self.names[i] for i in keep], [self.columns[i] for i in keep], self.predictor_sd)


@dataclass
class Fit:
    names: list[str]
    beta: np.ndarray
    cov: np.ndarray
    n: int
    clusters: int
    r2: float
    sse: float
    bread: np.ndarray
    design: Design

    def term(self, name: str) -> tuple[float, float]:
        i = self.names.index(name)
        return float(self.beta[i]), float(math.sqrt(self.cov[i, i]))

    def fitted(self) -> Column:
        terms = [F.lit(float(b)) * c for b, c in zip(self.beta, self.design.columns)]
        return sum(terms[1:], terms[0])

    @property
    def aic(self) -> float:
        return self.n * (math.log(2 * math.pi * self.sse / self.n) + 1) + 2 * len(self.names)

    def coefficient_rows(self, z: float = Z95) -> list[dict]:
        out = []
        for i, name in enumerate(self.names):
            b, se = float(self.beta[i]), float(math.sqrt(max(self.cov[i, i], 0.0)))
            out.append({"term": name, "estimate": b, "cluster_se": se, "ci95_low": b - z * se,
                        "ci95_high": b + z * se, "z": b / se if se else math.nan,
                        "p_value": normal_p(b / se) if se else math.nan})
        return out


def constant_terms(g: np.ndarray, names: Sequence[str]) -> list[str]:
    """Columns other than the intercept that do not vary."""
    n = g[0, 0]
    out = []
    for i, name in enumerate(names):
        if i and n * g[i, i] - g[0, i] ** 2 <= 1e-12 * max(n * g[i, i], 1e-300):
            out.append(name)
    return out


def solve_ols(g: np.ndarray, p: int) -> tuple[np.ndarray, np.ndarray, float, float]:
    """Coefficients, bread, SSE and centred total from a Gram of ``[X, y]`` with X's first column 1."""
    xtx, xty, yty = g[:p, :p], g[:p, p], g[p, p]
    scale = np.sqrt(np.maximum(np.diag(xtx), 1e-300))
    bread = np.linalg.pinv(xtx / np.outer(scale, scale), rcond=1e-12) / np.outer(scale, scale)
    beta = bread @ xty
    sse = float(yty - 2 * beta @ xty + beta @ xtx @ beta)
    sst = float(yty - g[0, p] ** 2 / g[0, 0])
    return beta, bread, sse, sst


def fit_ols(df: DataFrame, design: Design, y: Column, cluster: str, weights: Column | None = None,
            drop_constant: bool = True, cross: np.ndarray | None = None) -> Fit:
    """OLS or WLS with cluster-robust covariance (finite-cluster correction, normal inference).

    Rows with a null in the design, the response or the weight take no part; ``Fit.n`` is
    the number of rows that do. ``cross`` is the Gram of ``[X, y]`` over the same rows if a
    caller already has it. A null cluster is a cluster.
    """
    root = F.sqrt(weights) if weights is not None else F.lit(1.0)
    df = complete_rows(df, [*design.columns, y, root])
    if cross is None:
        cross = gram(df, [root * c for c in [*design.columns, y]])[None]
    design, cross = _varying(design, cross) if drop_constant else (design, cross)
    beta, bread, sse, sst = solve_ols(cross, len(design.names))
    score = (weights if weights is not None else F.lit(1.0)) * (y - _dot(beta, design.columns))
    meat, n, g = _meats(df, design.columns, score, cluster)[None]
    return _robust(design, beta, bread, sse, sst, meat, n, g)


def fit_ols_by(df: DataFrame, by: str, design: Design, y: Column, cluster: str) -> dict:
    """One OLS fit per value of ``by`` (a small set): two passes over the data for all of them."""
    df = complete_rows(df, [*design.columns, y])
    solved = {}
    for key, cross in gram(df, [*design.columns, y], by).items():
        own, cross = _varying(design, cross)
        solved[key] = (own, *solve_ols(cross, len(own.names)))
    every = {k: dict(zip(own.names, beta)) for k, (own, beta, *_) in solved.items()}
    kind = df.schema[by].dataType.simpleString()
    table = key_table(df.sparkSession, f"_key {kind}, _beta array<double>", [(k, [float(b.get(n, 0.0)) for n in design.names]) for k, b in every.items()])
    joined = df.join(table, F.col(by).eqNullSafe(F.col("_key")))
    fitted = sum((F.get("_beta", i) * c for i, c in enumerate(design.columns)), F.lit(0.0))
    meats = _meats(joined, design.columns, y - fitted, cluster, by)
    out = {}
    for key, (own, beta, bread, sse, sst) in solved.items():
        meat, n, g = meats[key]
        at = [design.names.index(x) for x in own.names]
        out[key] = _robust(own, beta, bread, sse, sst, meat[np.ix_(at, at)], n, g)
    return out


def _varying(design: Design, cross: np.ndarray) -> tuple[Design, np.ndarray]:
    gone = constant_terms(cross, design.names)
    keep = [*[i for i, n in enumerate(design.names) if n not in gone], len(design.names)]
    return design.without(gone), cross[np.ix_(keep, keep)]


def _dot(beta: np.ndarray, columns: Sequence[Column]) -> Column:
    return sum((F.lit(float(b)) * c for b, c in zip(beta, columns)), F.lit(0.0))


def _robust(design, beta, bread, sse, sst, meat, n, g) -> Fit:
    p = len(design.names)
    cov = bread @ meat @ bread * (g / (g - 1)) * ((n - 1) / (n - p)) if g > 1 and n > p else bread * math.nan
    return Fit(design.names, beta, cov, n, g, 1 - sse / sst if sst else math.nan, sse, bread, design)


def _meats(df: DataFrame, columns: Sequence[Column], score: Column, cluster: str, by: str | None = None) -> dict:
    """Per value of ``by``: sum over clusters of the outer product of their score sums, rows, clusters."""
    p, keys = len(columns), [by] if by else []
    base = df.select(*keys, F.col(cluster).alias("_cl"), score.alias("_e"), *[c.cast("double").alias(f"_x{i}") for i, c in enumerate(columns)])
    scores = base.groupBy(*keys, "_cl").agg(F.count(F.lit(1)).alias("_n"), *[F.expr(f"sum(_x{i} * _e) AS _s{i}") for i in range(p)])
    vec = scores.select(*keys, F.array(*[f"_s{i}" for i in range(p)], F.lit(1.0), F.sqrt(F.col("_n").cast("double"))).alias("_x"))
    full = gram_arrays(vec, "_x", p + 2, by) or ({} if by else {None: np.zeros((p + 2, p + 2))})
    return {k: (m[:p, :p], round(m[p + 1, p + 1]), round(m[p, p])) for k, m in full.items()}


def association_row(name: str, df: DataFrame, fit: Fit, predictor: str, sd: float, z: float = Z95, **extra) -> dict:
    """The result row of one association: raw and per-SD effect with interval."""
    beta, se = fit.term(predictor)
    return {
        "analysis": name, "predictor": predictor, "sites": fit.n, "clusters": fit.clusters, "beta_raw": beta,
        "se_cluster": se, "ci95_low_raw": beta - z * se, "ci95_high_raw": beta + z * se, "z": beta / se,
        "p_value": normal_p(beta / se), "predictor_sd": sd, "beta_per_sd": beta * sd, "se_per_sd": se * sd,
        "ci95_low_per_sd": (beta - z * se) * sd, "ci95_high_per_sd": (beta + z * se) * sd, "r_squared": fit.r2, **extra,
    }


def wald_joint(fit: Fit, names: Sequence[str]) -> tuple[float, int]:
    """Joint Wald chi-square of several terms and its degrees of freedom."""
    idx = [fit.names.index(n) for n in names]
    b, v = fit.beta[idx], fit.cov[np.ix_(idx, idx)]
    return float(b @ np.linalg.solve(v, b)), len(idx)


def chi2_sf(x: float, df: int) -> float:
    """Upper tail of chi-square by the regularised incomplete gamma series / continued fraction."""
    a, t = df / 2.0, x / 2.0
    if t <= 0:
        return 1.0
    log_front = a * math.log(t) - t - math.lgamma(a)
    if t < a + 1:
        term = total = 1.0 / a
        k = a
        while abs(term) > abs(total) * 1e-16:
            k += 1
            term *= t / k
            total += term
        return max(0.0, 1.0 - total * math.exp(log_front))
    b, c = t + 1 - a, 1e300
    d = 1 / b
    h = d
    for i in range(1, 10_000):
        an = -i * (i - a)
        b += 2
        d = 1 / (an * d + b)
        c = b + an / c
        step = d * c
        h *= step
        if abs(step - 1) < 1e-15:
            break
    return math.exp(log_front) * h


def rows_frame(spark, rows: Sequence[dict]) -> DataFrame:
    """A small result table; its header is the union of keys in first-seen order."""
    if not rows:
        raise ValueError("refusing to build an empty result table")
    names = list(dict.fromkeys(k for r in rows for k in r))
    kinds = {}
    for n in names:
        seen = [r[n] for r in rows if r.get(n) is not None]
        if any(isinstance(v, str) for v in seen):
            kinds[n] = "string"
        elif seen and all(isinstance(v, (bool, np.bool_)) for v in seen):
            kinds[n] = "boolean"
        elif seen and all(isinstance(v, (int, np.integer)) and not isinstance(v, bool) for v in seen):
            kinds[n] = "bigint"
        else:
            kinds[n] = "double"
    cast = {"string": str, "boolean": bool, "bigint": int, "double": float}
    data = [tuple(None if r.get(n) is None else cast[kinds[n]](r[n]) for n in names) for r in rows]
    return spark.createDataFrame(data, ", ".join(f"`{n}` {k}" for n, k in kinds.items()))
