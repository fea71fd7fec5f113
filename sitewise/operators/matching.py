"""Matched controls within one vector: same letter, far enough away, used once."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sitewise.functions.binding import let
from sitewise.functions.vectors import flank_mean
from sitewise.operators.ordering import on_keys, running


def eligible_positions(values: Column, letters: Column, excluded: Column, flank: int, min_fraction: float) -> Column:
    """Positions whose two full flanks are measured well enough and that are not excluded,
    as an array of ``(pos, letter)``.
    """
    need = math.ceil(flank * min_fraction)

    @F.pandas_udf(T.ArrayType(T.StructType([T.StructField("pos", T.IntegerType()), T.StructField("letter", T.StringType())])))
    def fitting(measured: pd.Series, text: pd.Series, taken: pd.Series) -> pd.Series:
        return pd.Series([_fitting(m, t, x, flank, need) for m, t, x in zip(measured, text, taken)], dtype=object)

    return fitting(F.transform(values, lambda v: v.isNotNull()), letters, excluded)


def _fitting(measured, text, taken, flank: int, need: int) -> list[dict]:
    """Both flanks of every position from one prefix sum; nothing without values or a list of exclusions."""
    if measured is None or taken is None or len(measured) < 2 * flank + 1:
        return []
    total = np.concatenate([[0], np.asarray(measured, bool).cumsum()])
    at = np.arange(flank + 1, len(measured) - flank + 1)
    ok = (total[at - 1] - total[at - flank - 1] >= need) & (total[at + flank] - total[at] >= need)
    ok &= ~np.isin(at, [x for x in taken if x is not None])
    return [{"pos": int(i), "letter": text[i - 1] if text is not None and i <= len(text) else None} for i in at[ok]]


def eligibility(df: DataFrame, key: list[str], order: str, valid: Column, flank: int, min_fraction: float,
                excluded: Column) -> DataFrame:
    """Row form of the same test for long tables with one dense position per row.

    Counts of a flank are differences of running counts, which range-partition, so no
    key is held in one task. Positions of a key follow each other without a gap; a
    missing ``valid`` is not valid.
    """
    need = math.ceil(flank * min_fraction)
    base = df.select(*key, order, F.coalesce(valid.cast("int"), F.lit(0)).alias("_v"))
    total = running(base, key, [order], {"_t": ("sum", F.col("_v"))})
    # Each running count goes to the four positions that look it up; no row meets its flank.
    at = F.col(order)
    looked = F.inline(F.array(*[F.struct((at + move).alias("_o"), F.lit(role).alias("_role")) for role, move in enumerate((0, 1, flank + 1, -flank))]))
    here, before, far, ahead = (F.max(F.when(F.col("_role") == role, F.col("_t"))) for role in range(4))
    counts = total.select(*key, "_t", looked).groupBy(*key, F.col("_o").alias(order)).agg(
        here.alias("_here"), (F.coalesce(before, F.lit(0)) - F.coalesce(far, F.lit(0))).alias("valid_left"), ahead.alias("_ahead")).where("_here is not null")
    bounds = base.groupBy(*key).agg(F.min(order).alias("_lo"), F.max(order).alias("_hi"), F.sum("_v").alias("_all"))
    inside = (F.col(order) - flank >= F.col("_lo")) & (F.col(order) + flank <= F.col("_hi"))
    out = df.alias("d").join(counts.alias("c"), on_keys("d", "c", [*key, order])).select("d.*", "c.valid_left", "c._here", "c._ahead")
    out = out.alias("d").join(bounds.alias("b"), on_keys("d", "b", key)).select("d.*", "b._lo", "b._hi", "b._all")
    out = out.withColumn("valid_right", F.coalesce("_ahead", "_all") - F.col("_here"))
    return out.withColumn("eligible", inside & (F.col("valid_left") >= need) & (F.col("valid_right") >= need) & ~excluded) \
        .drop("_lo", "_hi", "_all", "_here", "_ahead")


PAIR = T.StructType([
    T.StructField("site_pos", T.IntegerType()), T.StructField("control_pos", T.IntegerType()),
    T.StructField("letter", T.StringType())])


def match_greedy(df: DataFrame, tid: str, values: str, letters: str, sites: str, flank: int, min_fraction: float,
                 min_distance: int) -> DataFrame:
    """One unused control per site, sites taken in position order.

    Each row is one vector with the array of its site positions, so the choice
    stays inside a row: its state is bounded by the vector's length and the
    vectors spread over all tasks.
    """
    prepared = df.select(tid, letters, F.array_sort(F.array_distinct(sites)).alias("_s"),
                         eligible_positions(F.col(values), F.col(letters), F.col(sites), flank, min_fraction).alias("_c"))
    plain = prepared.select(tid, letters, "_s", F.col("_c.pos").alias("_cp"), F.col("_c.letter").alias("_cl"))

    @F.pandas_udf(T.ArrayType(PAIR))
    def pairs(text: pd.Series, site: pd.Series, pos: pd.Series, letter: pd.Series) -> pd.Series:
        return pd.Series([_match_row(t, s, p, q, min_distance) for t, s, p, q in zip(text, site, pos, letter)])

    return plain.select(tid, F.explode(pairs(letters, "_s", "_cp", "_cl")).alias("m")) \
        .select(tid, "m.*", F.abs(F.col("m.site_pos") - F.col("m.control_pos")).alias("distance"))


def _match_row(text, sites, positions, letters, min_distance):
    """The rule as array operations: every candidate gets its key, masked ones drop out, the least key wins.

    The key of a candidate is its rank outward from the site among candidates of the
    letter (both sides count alike), then distance, then position.
    """
    positions, letters = np.asarray(positions, dtype=np.int64), np.asarray(letters, dtype=object)
    order = np.argsort(positions, kind="stable")
    free = np.ones(len(order), dtype=bool)
    out = []
    for site in sites:
        same = order[letters[order] == text[site - 1]]
        away = positions[same] - site
        before = int((away < 0).sum())
        outward = np.where(away < 0, before - 1 - np.arange(len(same)), np.arange(len(same)) - before)
        open_ = np.flatnonzero(free[same] & (np.abs(away) >= min_distance))
        if len(open_):
            best = open_[np.lexsort((away[open_], np.abs(away)[open_], outward[open_]))[0]]
            free[same[best]] = False
            out.append({"site_pos": int(site), "control_pos": int(positions[same[best]]), "letter": text[site - 1]})
    return out


def match_nearest(df: DataFrame, tid: str, values: str, letters: str, sites: str, flank: int, min_fraction: float,
                  min_distance: int) -> DataFrame:
    """Nearest eligible control of each site, controls may repeat; all inside the row."""
    controls = eligible_positions(F.col(values), F.col(letters), F.col(sites), flank, min_fraction)
    rows = df.select(tid, letters, controls.alias("_c"), F.explode(sites).alias("site_pos")) \
        .withColumn("letter", F.substring(F.col(letters), F.col("site_pos"), F.lit(1)))
    site = F.named_struct(F.lit("letter"), F.col("letter"), F.lit("pos"), F.col("site_pos"))
    best = let(site, lambda s: F.array_min(F.transform(
        F.filter("_c", lambda c: (c["letter"] == s["letter"]) & (F.abs(c["pos"] - s["pos"]) >= min_distance)),
        lambda c: F.named_struct(F.lit("distance"), F.abs(c["pos"] - s["pos"]), F.lit("control_pos"), c["pos"]))))
    return rows.select(tid, "site_pos", "letter", best.alias("b")).where("b is not null") \
        .select(tid, "site_pos", F.col("b.control_pos"), "letter", F.col("b.distance"))


def pair_differences(pairs: DataFrame, vectors: DataFrame, tid: str, values: str, flank: int) -> DataFrame:
    """Flank means at site and control and their difference."""
    j = pairs.join(vectors.select(tid, F.col(values).alias("_vals")), tid)
    site, control = (flank_mean(F.col("_vals"), F.col(c), flank, None) for c in ("site_pos", "control_pos"))
    return j.withColumns({"site_mean": site, "control_mean": control}) \
        .withColumn("difference", F.col("site_mean") - F.col("control_mean")).drop("_vals")

