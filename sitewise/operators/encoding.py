"""Fold-fitted feature encoding as a linear map over raw columns.

Median filling and scaling are linear in the raw columns once a numeric feature
is held as (value or 0, missing flag). So an encoder is a small matrix, the data
only needs its raw cross products, and an encoder can be refitted for any fold
without another pass over the data and without seeing that fold.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import asdict, dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitewise.functions.sequences import BASES, kmer_fractions, kmer_names, position_one_hot
from sitewise.operators.inference import levels_of
from sitewise.operators.ordering import running


@dataclass(frozen=True)
class FeatureSpec:
    """What goes into the raw feature vector.

    ``numeric`` maps names to columns, ``flagged`` numerics also emit a missing
    flag, ``arrays`` maps a block name to (array column, element names), and
    ``sequence`` adds k-mer fractions (and a one-hot of ``one_hot_width`` letters).
    """

    numeric: dict[str, Column] = field(default_factory=dict)
    flagged: Sequence[str] = ()
    categorical: Sequence[str] = ()
    sequence: str | None = None
    one_hot_width: int = 0
    dense: dict[str, dict[str, Column]] = field(default_factory=dict)
    arrays: dict[str, tuple[Column, Sequence[str]]] = field(default_factory=dict)
    masked: Sequence[str] = ()


@dataclass
class RawLayout:
    """Names of the raw columns and how the encoder treats each of them."""

    names: list[str]
    kinds: list[str]
    blocks: list[str]
    pair: list[int]

    def index(self, blocks: Sequence[str]) -> list[int]:
        return [i for i, b in enumerate(self.blocks) if b in blocks]


def raw_features(df: DataFrame, spec: FeatureSpec, name: str = "raw", levels: dict | None = None) -> tuple[DataFrame, RawLayout, dict]:
    """Add the raw feature array. Returns the frame, its layout and the category levels."""
    levels = levels if levels is not None else levels_of(df, spec.categorical, "missing")
    parts: list[Column] = []
    layout = RawLayout([], [], [], [])

    def add(label, kind, block, pair=-1):
        layout.names.append(label)
        layout.kinds.append(kind)
        layout.blocks.append(block)
        layout.pair.append(pair)

    def add_numeric(label, col, block, flag):
        x = F.when(~F.isnan(col.cast("double")), col.cast("double"))
        at = len(layout.names)
        add(f"{block}:{label}", "value", block, at + 1)
        add(f"{block}:missing_{label}", "flag" if flag else "fill", block)
        return [F.coalesce(x, F.lit(0.0)), x.isNull().cast("double")]

    scalars: list[Column] = []
    for n, c in spec.numeric.items():
        scalars += add_numeric(n, c, "C", n in spec.flagged)
    for c, found in levels.items():
        for level in found:
            add(f"C:{c}={level}", "indicator", "C")
            scalars.append((F.coalesce(F.col(c).cast("string"), F.lit("missing")) == level).cast("double"))
    for block, cols in spec.dense.items():
        for n, c in cols.items():
            scalars += add_numeric(n, c, block, block in spec.masked)
    if scalars:
        parts.append(F.array(*scalars))
    if spec.sequence:
        seq = F.upper(F.col(spec.sequence))
        if spec.one_hot_width:
            parts.append(position_one_hot(seq, spec.one_hot_width))
            for i in range(spec.one_hot_width):
                for b in BASES:
                    add(f"X:pos{i - spec.one_hot_width // 2:+04d}_{b}", "indicator", "X")
        parts.append(kmer_fractions(3)(seq))
        for k in kmer_names(3):
            add(f"X:3mer_{k}", "scaled", "X")
    for block, (col, names) in spec.arrays.items():
        flag = block in spec.masked
        parts.append(F.flatten(F.transform(col, lambda v: F.array(
            F.coalesce(v.cast("double"), F.lit(0.0)), v.isNull().cast("double")))))
        for n in names:
            at = len(layout.names)
            add(f"{block}:{n}", "value", block, at + 1)
            add(f"{block}:missing_{n}", "flag" if flag else "fill", block)
    return df.withColumn(name, F.concat(*parts)), layout, levels


@dataclass
class Encoder:
    """A fitted encoder: ``encoded = raw @ weights + offset``."""

    names: list[str]
    weights: np.ndarray
    offset: np.ndarray
    medians: dict[str, float]

    def apply(self, rows: DataFrame, raw: str, key: str) -> DataFrame:
        """Encoded values in long form: key, feature, value."""
        terms = []
        for i, name in enumerate(self.names):
            used = np.flatnonzero(self.weights[:, i])
            value = F.lit(float(self.offset[i]))
            for j in used:
                value = value + F.lit(float(self.weights[j, i])) * F.get(raw, F.lit(int(j)))
            terms.append(F.struct(F.lit(name).alias("feature"), value.alias("value")))
        return rows.select(key, F.explode(F.array(*terms)).alias("_e")).select(key, "_e.*")

    def state(self, layout: RawLayout, levels: dict, clip: tuple[float, float] = (0.0, 1.0), **extra) -> dict:
        return {"features": self.names, "weights": self.weights.tolist(), "offset": self.offset.tolist(),
                "medians": self.medians, "layout": asdict(layout), "levels": levels, "clip": list(clip), **extra}


def fit_encoder(cross: np.ndarray, layout: RawLayout, medians: dict[str, float], use: Sequence[int] | None = None) -> Encoder:
    """Fit from the training rows' cross products of ``[1, raw...]``.

    Population sd (ddof 0), all category levels kept, a constant column keeps scale 1.
    """
    use = list(range(len(layout.names))) if use is None else list(use)
    n = cross[0, 0]
    total, square = cross[0, 1:] / n, np.diag(cross)[1:] / n
    names, cols, offset = [], [], []
    raw_size = len(layout.names)

    def put(label, pairs, shift):
        col = np.zeros(raw_size)
        for i, w in pairs:
            col[i] = w
        names.append(label)
        cols.append(col)
        offset.append(shift)

    for i in use:
        kind = layout.kinds[i]
        if kind == "value":
            j, med = layout.pair[i], medians.get(layout.names[i], 0.0)
            mean = total[i] + med * total[j]
            second = square[i] + med * med * total[j]
            sd = float(np.sqrt(max(second - mean * mean, 0.0)))
            sd = sd if sd > 1e-12 * max(1.0, abs(mean)) else 1.0
            put(layout.names[i], [(i, 1 / sd), (j, med / sd)], -mean / sd)
        elif kind == "scaled":
            sd = float(np.sqrt(max(square[i] - total[i] ** 2, 0.0)))
            sd = sd if sd > 1e-12 else 1.0
            put(layout.names[i], [(i, 1 / sd)], -total[i] / sd)
        elif kind in ("flag", "indicator"):
            put(layout.names[i], [(i, 1.0)], 0.0)
    return Encoder(names, np.array(cols).T.reshape(raw_size, len(names)), np.array(offset), medians)


def fold_medians(df: DataFrame, columns: dict[str, Column], fold: str, folds: Sequence[int]) -> dict[int, dict[str, float]]:
    """Exact median of each column over the rows outside each fold, and over all rows under 0."""
    return set_medians(df, columns, fold, folds, {0: (), **{f: (f,) for f in folds}})


def set_medians(df: DataFrame, columns: dict[str, Column], fold: str, folds: Sequence[int], left_out: dict) -> dict:
    """Exact median of each column per key of ``left_out``, over the rows outside its folds.

    Counts per distinct value and fold are accumulated once; any set of folds is left
    out by subtraction.
    """
    if not columns:
        return {k: {} for k in left_out}
    pairs = F.array(*[F.struct(F.lit(n).alias("variable"), c.cast("double").alias("value")) for n, c in columns.items()])
    long = df.select(F.col(fold).alias("_f"), F.explode(pairs).alias("kv")).select("_f", "kv.*") \
        .where(F.col("value").isNotNull() & ~F.isnan("value"))
    counts = long.groupBy("variable", "value").agg(F.count(F.lit(1)).alias("c0"), *[F.count_if(F.col("_f") == f).alias(f"c{f}") for f in folds])
    every = [0, *folds]
    upto = running(counts, ["variable"], ["value"], {f"u{f}": ("sum", F.col(f"c{f}")) for f in every})
    sizes = counts.groupBy("variable").agg(*[F.sum(f"c{f}").alias(f"n{f}") for f in every])
    j = upto.join(sizes, "variable")
    aggs = []
    for i, gone in enumerate(left_out.values()):
        cum, size = (sum((-F.col(f"{n}{f}") for f in gone), F.col(f"{n}0")) for n in "un")
        h = (size - 1) * F.lit(0.5)
        low = F.min(F.when(cum > F.floor(h), F.col("value")))
        high = F.min(F.when(cum > F.ceil(h), F.col("value")))
        aggs.append(((low + high) / 2).alias(f"m{i}"))
    out: dict = {k: {} for k in left_out}
    for r in j.groupBy("variable").agg(*aggs).collect():
        for i, k in enumerate(left_out):
            out[k][r["variable"]] = float(r[f"m{i}"]) if r[f"m{i}"] is not None else 0.0
    return out
