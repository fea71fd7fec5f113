"""A family of fits over overlapping populations from cross products keyed by membership.

Each row gets a bit mask of the variants whose population it belongs to and for which all
its values are there. One pass sums cross products of the union of all columns per mask;
a variant's matrix is the sum over the masks that hold its bit, cut to its own columns. A
second pass adds up each cluster's scores for all variants together. So the number of
passes over the data does not depend on the number of variants, and a variant that another
one contains costs nothing more.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.ml.functions import array_to_vector
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitewise.operators.linear import Design, Fit, _dot, _robust, _varying, solve_ols
from sitewise.session import checkpointed

MOST_VARIANTS = 60  # bits of a mask


@dataclass(frozen=True)
class Variant:
    """A population (``where``; all rows if none), outcome, predictor and weight (equal if none)."""

    name: str
    outcome: str
    predictor: str
    where: Column | None = None
    weight: Column | None = None


@dataclass
class VariantFit:
    variant: Variant
    fit: Fit
    predictor_sd: float


def _places(covariates: Design, variants: Sequence[Variant]):
    """All distinct columns, and the positions of each variant's design and outcome among them."""
    columns, at = list(covariates.columns), {}
    for name in dict.fromkeys(n for v in variants for n in (v.predictor, v.outcome)):
        at[name] = len(columns)
        columns.append(F.col(name).cast("double"))
    own = range(1, len(covariates.columns))
    return columns, [([0, at[v.predictor], *own], at[v.outcome]) for v in variants]


def variant_fits(df: DataFrame, covariates: Design, variants: Sequence[Variant], cluster: str) -> list[VariantFit]:
    """Cluster-robust fits of all variants: outcome on intercept, predictor and covariates.

    A row takes part in a variant if it lies in its population and has its outcome,
    predictor, covariates and weight. A null cluster is a cluster. The scale of the
    predictor is its standard deviation over the rows of the fit.
    """
    if len(variants) > MOST_VARIANTS:
        raise ValueError(f"at most {MOST_VARIANTS} variants share one mask")
    columns, places = _places(covariates, variants)
    weights = [v.weight for v in variants if v.weight is not None]
    scheme, seen = [], 0
    for v in variants:
        seen += v.weight is not None
        scheme.append(seen if v.weight is not None else 0)
    bits = []
    for i, (v, (design, y)) in enumerate(zip(variants, places)):
        needed = [columns[j].isNotNull() for j in (*design, y)] + ([v.weight.isNotNull()] if v.weight is not None else [])
        inside = reduce(lambda a, b: a & b, needed + ([F.coalesce(v.where, F.lit(False))] if v.where is not None else []))
        bits.append(F.when(inside, F.lit(1 << i)).otherwise(F.lit(0)).cast("long"))
    rows = df.select(F.col(cluster).alias("_cl"), reduce(lambda a, b: a + b, bits).alias("_m"),
                     F.array(*[F.coalesce(c.cast("double"), F.lit(0.0)) for c in columns]).alias("_x"),
                     F.array(F.lit(1.0), *[F.coalesce(w.cast("double"), F.lit(0.0)) for w in weights]).alias("_w")).where("_m <> 0")
    rows = checkpointed(rows)
    grams = _masked_grams(rows, scheme, len(columns))
    p = len(columns)
    solved = []
    for i, (v, (design, y)) in enumerate(zip(variants, places)):
        plain, own = (sum((g for (s, m), g in grams.items() if s == k and m >> i & 1), np.zeros((p, p))) for k in (0, scheme[i]))
        keep = [*design, y]
        if not plain[0, 0]:
            raise ValueError(f"{v.name}: no complete row")
        names = [covariates.names[0], v.predictor, *covariates.names[1:]]
        full = Design(names, [columns[j] for j in design])
        kept, cross = _varying(full, own[np.ix_(keep, keep)])
        if v.predictor not in kept.names:
            raise ValueError(f"{v.name}: the predictor does not vary")
        n, sx, sxx = plain[0, 0], plain[0, design[1]], plain[design[1], design[1]]
        sd = float(np.sqrt(max(sxx - sx * sx / n, 0.0) / (n - 1))) if n > 1 else float("nan")
        where = [design[names.index(x)] for x in kept.names]
        solved.append((kept, where, y, sd, *solve_ols(cross, len(kept.names))))
    meats = _masked_meats(rows, [(where, y, beta, scheme[i]) for i, (_, where, y, _, beta, *_) in enumerate(solved)])
    out = []
    for v, (kept, _, _, sd, beta, bread, sse, sst), (meat, n, g) in zip(variants, solved, meats):
        out.append(VariantFit(v, _robust(kept, beta, bread, sse, sst, meat, n, g), sd))
    return out


def _masked_grams(rows: DataFrame, scheme: Sequence[int], p: int) -> dict[tuple[int, int], np.ndarray]:
    """Cross products per weight scheme and mask; as many as there are populations met in the data."""
    schemes = sorted({0, *scheme})

    def partial(batches):
        sums: dict = {}
        for pdf in batches:
            if not len(pdf):
                continue
            x, w, masks = np.vstack(pdf["_x"].to_numpy()), np.vstack(pdf["_w"].to_numpy()), pdf["_m"].to_numpy()
            for m in np.unique(masks):
                own = x[masks == m]
                for s in schemes:
                    if s == 0 or any(m >> i & 1 for i, k in enumerate(scheme) if k == s):
                        sums[s, int(m)] = sums.get((s, int(m)), 0) + (own * w[masks == m, s][:, None]).T @ own
        for (s, m), g in sums.items():
            yield pd.DataFrame({"_s": s, "_m": m, "_i": range(p), "_row": list(g)})

    parts = rows.mapInPandas(partial, "_s int, _m long, _i int, _row array<double>")
    out: dict = {}
    for r in parts.groupBy("_s", "_m", "_i").agg(Summarizer.sum(array_to_vector("_row")).alias("_row")).collect():
        out.setdefault((r["_s"], r["_m"]), np.zeros((p, p)))[r["_i"]] = r["_row"].toArray()
    return out


def _masked_meats(rows: DataFrame, solved: Sequence[tuple]) -> list[tuple[np.ndarray, int, int]]:
    """Per variant the summed outer products of its clusters' scores, its rows and its clusters."""
    sizes = [len(where) for where, *_ in solved]
    starts = np.cumsum([0, *[s + 1 for s in sizes]])
    here = [F.col("_m").bitwiseAND(F.lit(1 << i).cast("long")) != 0 for i in range(len(solved))]
    errors = [F.get("_w", F.lit(s)) * (F.get("_x", F.lit(y)) - _dot(beta, [F.get("_x", F.lit(j)) for j in where])) for where, y, beta, s in solved]
    scored = rows.select("_cl", "_m", "_x", *[F.when(h, e).otherwise(F.lit(0.0)).alias(f"_e{i}") for i, (h, e) in enumerate(zip(here, errors))])
    # Plain sums keep a row of numbers per cluster; an aggregate of vectors sorts all rows of a task once it meets more than a few clusters.
    sums = []
    for i, (where, *_) in enumerate(solved):
        sums += [F.sum(F.get("_x", F.lit(j)) * F.col(f"_e{i}")) for j in where] + [F.count_if(here[i]).cast("double")]
    per_cluster = scored.groupBy("_cl").agg(*[c.alias(f"_v{k}") for k, c in enumerate(sums)]).select(F.array(*[f"_v{k}" for k in range(len(sums))]).alias("_v"))

    def partial(batches):
        sums = [np.zeros((s + 2, s + 2)) for s in sizes]
        for pdf in batches:
            if not len(pdf):
                continue
            v = np.vstack(pdf["_v"].to_numpy())
            for i, s in enumerate(sizes):
                part, n = v[:, starts[i]:starts[i] + s], v[:, starts[i + 1] - 1]
                sums[i][:s, :s] += part.T @ part
                sums[i][s, s] += n.sum()
                sums[i][s + 1, s + 1] += np.count_nonzero(n)
        for i, s in enumerate(sums):
            yield pd.DataFrame({"_i": i, "_j": range(len(s)), "_row": list(s)})

    parts = per_cluster.mapInPandas(partial, "_i int, _j int, _row array<double>")
    out = [np.zeros((s + 2, s + 2)) for s in sizes]
    for r in parts.groupBy("_i", "_j").agg(Summarizer.sum(array_to_vector("_row")).alias("_row")).collect():
        out[r["_i"]][r["_j"]] = r["_row"].toArray()
    return [(m[:s, :s], round(m[s, s]), round(m[s + 1, s + 1])) for m, s in zip(out, sizes)]
