"""Ranking, sampling, set counts and reshaping."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sitewise.operators.intervals import first_hit_per
from sitewise.operators.ordering import on_keys, positions
from sitewise.session import checkpointed


def rank_candidates(df: DataFrame, key: Sequence[str], order: Sequence[Column | str], rank: str = "rank",
                    first: str = "representative", size: str = "group_size") -> DataFrame:
    """Rank all candidates of each key, flag the first, and add the group size."""
    ranked = positions(df, key, order, rank)
    sizes = df.groupBy(*key).agg(F.count(F.lit(1)).alias(size))
    sized = ranked.alias("l").join(sizes.alias("r"), on_keys("l", "r", key)).select("l.*", f"r.{size}")
    return sized.withColumn(first, F.col(rank) == 1)


def representative(df: DataFrame, key: Sequence[str], order: Sequence[Column], size: str = "group_size") -> DataFrame:
    """Only the best candidate of each key and the group size, as one combining aggregate."""
    rest = [c for c in df.columns if c not in key]
    best = F.min_by(F.struct(*rest), F.struct(*[o.alias(f"_o{i}") for i, o in enumerate(order)]))
    return df.groupBy(*key).agg(best.alias("_b"), F.count(F.lit(1)).alias(size)).select(*key, "_b.*", size)


def keep_first(df: DataFrame, key: Sequence[str], order: Sequence[str]) -> DataFrame:
    """One row per key: the first by ``order``."""
    return first_hit_per(df, list(key), list(order))


def stratified_sample(df: DataFrame, strata: Sequence[str], order: Sequence[str], per_stratum: int) -> DataFrame:
    """The first rows of each stratum by ``order``.

    The rank filter is pushed below the shuffle by the planner, so each task
    sends at most ``per_stratum`` rows of a stratum.
    """
    w = Window.partitionBy(*strata).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= per_stratum).drop("_rn")


def sample_with_fill(df: DataFrame, strata: Sequence[str], order: Sequence[str], per_stratum: int, total: int,
                     failed: Column, max_failures: int = 6) -> DataFrame:
    """Per-stratum first rows, topped up to ``total`` with other good rows, then failures.

    Adds ``fill``: 1 stratum rows, 2 extra rows, 3 failures. The stratum rows are never cut.
    ``order`` tells rows apart; nulls in it equal each other. Rows whose ``failed`` is null
    are neither good nor failures.
    """
    good, bad = df.where(~failed), df.where(failed)
    base = checkpointed(stratified_sample(good, strata, order, per_stratum))
    room = max(0, total - base.count())
    taken = base.select(*[F.col(c).alias(f"_t{i}") for i, c in enumerate(order)])
    same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_t{i}")) for i, c in enumerate(order)])
    extra = checkpointed(good.join(taken, same, "left_anti").orderBy(*order).limit(room))
    fails = bad.orderBy(*order).limit(min(max_failures, room - extra.count()))
    return base.withColumn("fill", F.lit(1)).unionByName(extra.withColumn("fill", F.lit(2))).unionByName(fails.withColumn("fill", F.lit(3)))


def count_order(df: DataFrame, by: str, count: str = "count") -> DataFrame:
    """Group counts, largest first, ties by name."""
    return df.groupBy(by).agg(F.count(F.lit(1)).alias(count)).orderBy(F.col(count).desc(), F.col(by))


def best_of(df: DataFrame, keys: Sequence[str], metric: str, tiebreak: str, grid: str | None = None) -> DataFrame:
    """Smallest metric per key, ties by ``tiebreak``; ``on_edge`` says if ``grid`` is at its end."""
    grid = grid or tiebreak
    cols = [c for c in df.columns if c not in keys]
    picked = df.groupBy(*keys).agg(
        F.min_by(F.struct(*cols), F.struct(metric, tiebreak)).alias("_b"),
        F.min(grid).alias("_lo"), F.max(grid).alias("_hi"))
    return picked.select(*keys, "_b.*", F.col(f"_b.{grid}").isin(F.col("_lo"), F.col("_hi")).alias("on_edge"))


def set_algebra_counts(a: DataFrame, b: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Sizes of both key sets, their union, intersection and differences; one shuffle of distinct keys."""
    tagged = a.select(*keys, F.lit(1).alias("_t")).unionAll(b.select(*keys, F.lit(2).alias("_t")))
    per_key = tagged.groupBy(*keys).agg(F.bool_or(F.col("_t") == 1).alias("_a"), F.bool_or(F.col("_t") == 2).alias("_b"))
    x, y = F.col("_a"), F.col("_b")
    return per_key.agg(
        F.count_if(x).alias("first"), F.count_if(y).alias("second"), F.count(F.lit(1)).alias("either"),
        F.count_if(x & y).alias("both"), F.count_if(x & ~y).alias("first_only"), F.count_if(~x & y).alias("second_only"))


def to_long(df: DataFrame, ids: Sequence[str], columns: Sequence[str], name: str = "model", value: str = "prediction") -> DataFrame:
    return df.unpivot(list(ids), list(columns), name, value)


def to_wide(df: DataFrame, ids: Sequence[str], name: str, value: str, names: Sequence[str]) -> DataFrame:
    """Long rows back to one column per name; the names are given, so nothing is scanned to find them."""
    return df.groupBy(*ids).pivot(name, list(names)).agg(F.first(value))
