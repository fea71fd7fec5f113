"""Running totals, ranks and quantiles that never put one group in one task.

A window over a key sorts the whole key in one task. Here rows are range
partitioned on (key, order) instead, so a key that holds a third of all rows is
spread over many tasks; each task runs over its own piece and adds what the
pieces before it contributed.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sitewise.session import checkpointed, tasks_for

_COMBINE = {"sum": F.sum, "min": F.min, "max": F.max}


def _as_col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def on_keys(left: str, right: str, keys: Sequence[str]) -> Column:
    """Null-safe equality of the keys of two aliased frames; true without keys."""
    if not keys:
        return F.lit(True)
    terms = [F.col(f"{left}.{k}").eqNullSafe(F.col(f"{right}.{k}")) for k in keys]
    return reduce(lambda a, b: a & b, terms)


def running(df: DataFrame, keys: Sequence[str], order: Sequence, totals: dict[str, tuple[str, Column]]) -> DataFrame:
    """Add running aggregates within ``keys`` in ``order``, this row included.

    ``totals`` maps an output name to ``("sum" | "min" | "max", column)``.
    ``order`` must be total within a key for the result to be determined.
    """
    keys = list(keys)
    order = [_as_col(c) for c in order]
    inputs = {f"_in_{n}": c for n, (_, c) in totals.items()}
    # The part number is used by two branches below, so it has to be written once.
    parts = checkpointed(
        df.withColumns(inputs)
        .repartitionByRange(*[F.col(k) for k in keys], *order)
        .withColumn("_part", F.spark_partition_id())
    )
    within = Window.partitionBy("_part", *keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    local = parts.withColumns({n: _COMBINE[how](f"_in_{n}").over(within) for n, (how, _) in totals.items()})
    before = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    pieces = (
        parts.groupBy(*keys, "_part")
        .agg(*[_COMBINE[how](f"_in_{n}").alias(f"_in_{n}") for n, (how, _) in totals.items()])
        .select(*keys, "_part",
                *[_COMBINE[how](f"_in_{n}").over(before).alias(f"_before_{n}") for n, (how, _) in totals.items()])
    )
    joined = local.alias("l").join(pieces.alias("p"), on_keys("l", "p", [*keys, "_part"]))
    out = []
    for n, (how, _) in totals.items():
        mine, earlier = F.col(f"l.{n}"), F.col(f"p._before_{n}")
        if how == "sum":
            value = F.when(mine.isNull(), earlier).otherwise(mine + F.coalesce(earlier, F.lit(0)))
        else:
            value = (F.least if how == "min" else F.greatest)(mine, earlier)
        out.append(value.alias(n))
    return joined.select(*[F.col(f"l.{c}") for c in df.columns if c not in totals], *out)


def positions(df: DataFrame, keys: Sequence[str], order: Sequence, name: str = "position") -> DataFrame:
    """1-based row number within ``keys``."""
    return running(df, keys, order, {name: ("sum", F.lit(1).cast("long"))})


def value_counts(df: DataFrame, keys: Sequence[str], value: str, weight: Column | None = None) -> DataFrame:
    """Distinct non-null values with their counts; combines before it shuffles."""
    count = F.count(F.lit(1)) if weight is None else F.sum(weight)
    return df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(count.alias("_n"))


def average_ranks(df: DataFrame, keys: Sequence[str], value: str, name: str = "avg_rank",
                  weight: Column | None = None) -> DataFrame:
    """Average rank of every distinct value within ``keys`` (ties share it)."""
    counts = value_counts(df, keys, value, weight)
    ranked = running(counts, keys, [value], {"_upto": ("sum", F.col("_n"))})
    return ranked.select(*keys, value, (F.col("_upto") - (F.col("_n") - 1) / 2).alias(name), F.col("_n").alias("ties"))


def quantiles(df: DataFrame, keys: Sequence[str], value: str, probs: dict[str, float],
              weight: Column | None = None) -> DataFrame:
    """Exact interpolated quantiles per key, one row per key.

    ``probs`` maps output names to probabilities. Works on distinct values with
    counts; no group is held in memory. ``weight`` is an integer frequency. The pieces are as
    many as the distinct values need, so what is sorted of one does not grow with the data.
    """
    keys = list(keys)
    # Fixed before it is dealt: the hash table of the counts and the buffer of the next shuffle would stand in one task.
    counts = checkpointed(value_counts(df, keys, value, weight).where("_n > 0").withColumnRenamed(value, "_value"))
    parts = checkpointed(
        counts.repartitionByRange(tasks_for(counts), *[F.col(k) for k in keys], F.col("_value")).withColumn("_part", F.spark_partition_id()))
    # Totals per piece tell which piece holds each wanted rank; only those pieces are sorted.
    whole = Window.partitionBy(*keys)
    upto = F.sum("_c").over(whole.orderBy("_part"))
    pieces = parts.groupBy(*keys, "_part").agg(F.sum("_n").alias("_c")).select(
        *keys, "_part", "_c", (upto - F.col("_c")).alias("_before"), F.sum("_c").over(whole).alias("_size"))
    wanted = []
    for i, p in enumerate(probs.values()):
        h = (F.col("_size") - 1) * F.lit(float(p))
        wanted += [F.struct(F.lit(2 * i + j).alias("i"), (f(h) + 1).cast("long").alias("rank"))
                   for j, f in enumerate((F.floor, F.ceil))]
    targets = pieces.withColumn("_w", F.explode(F.array(*wanted))).where(
        (F.col("_w.rank") > F.col("_before")) & (F.col("_w.rank") <= F.col("_before") + F.col("_c"))) \
        .groupBy(*keys, "_part", "_before", "_size").agg(F.collect_list("_w").alias("_w"))
    near = parts.alias("p").join(targets.alias("t"), on_keys("p", "t", [*keys, "_part"])) \
        .select(*[F.col(f"p.{k}") for k in keys], "p._value", "p._n", "p._part", "t._before", "t._size", "t._w")
    within = Window.partitionBy(*keys, "_part").orderBy("_value").rowsBetween(Window.unboundedPreceding, 0)
    ranked = near.withColumn("_upto", F.col("_before") + F.sum("_n").over(within))

    def here(w: Column) -> Column:
        return (w["rank"] <= F.col("_upto")) & (w["rank"] > F.col("_upto") - F.col("_n"))

    hits = ranked.select(*keys, "_value", "_size", F.explode(F.transform(F.filter("_w", here), lambda w: w["i"])).alias("_i"))
    aggs = []
    for i, (name, p) in enumerate(probs.items()):
        h = F.max((F.col("_size") - 1) * F.lit(float(p)))
        low, high = (F.min(F.when(F.col("_i") == at, F.col("_value"))) for at in (2 * i, 2 * i + 1))
        aggs.append((low + (high - low) * (h - F.floor(h))).alias(name))
    return hits.groupBy(*keys).agg(*aggs)


def quantile_array(df: DataFrame, value: str, probs: Sequence[float]) -> Column:
    """Exact quantiles of a whole column as one array literal for use in another plan.

    The number of quantiles is fixed by the caller, so the row brought to the
    driver does not grow with the data.
    """
    names = {f"q{i}": p for i, p in enumerate(probs)}
    row = quantiles(df, [], value, names).first()
    if row is None:
        raise ValueError(f"no values in {value}")
    return F.array(*[F.lit(float(row[n])) for n in names])


def medians(df: DataFrame, keys: Sequence[str], values: Sequence[str]) -> DataFrame:
    """Exact medians of several columns in long form: keys, variable, median."""
    long = df.select(*keys, F.explode(F.array(*[
        F.struct(F.lit(v).alias("variable"), F.col(v).cast("double").alias("value")) for v in values
    ])).alias("_kv")).select(*keys, "_kv.variable", "_kv.value")
    return quantiles(long, [*keys, "variable"], "value", {"median": 0.5})


def spearman_frame(df: DataFrame, keys: Sequence[str], x: str, y: str) -> DataFrame:
    """Rank correlation per key from average ranks of distinct pairs."""
    keys = list(keys)
    pairs = (
        df.where(F.col(x).isNotNull() & F.col(y).isNotNull())
        .groupBy(*keys, F.col(x).alias("_x"), F.col(y).alias("_y"))
        .agg(F.count(F.lit(1)).alias("_c"))
    )
    pairs = checkpointed(pairs)
    rx = average_ranks(pairs, keys, "_x", "_rx", F.col("_c"))
    ry = average_ranks(pairs, keys, "_y", "_ry", F.col("_c"))
    ranked = (
        pairs.alias("p")
        .join(rx.alias("a"), on_keys("p", "a", [*keys, "_x"]))
        .join(ry.alias("b"), on_keys("p", "b", [*keys, "_y"]))
        .select(*[F.col(f"p.{k}") for k in keys], "p._c", "a._rx", "b._ry")
    )
    c, a, b = F.col("_c"), F.col("_rx"), F.col("_ry")
    sums = ranked.groupBy(*keys).agg(
        F.sum(c).alias("n"), F.sum(c * a).alias("_sa"), F.sum(c * b).alias("_sb"),
        F.sum(c * a * a).alias("_saa"), F.sum(c * b * b).alias("_sbb"), F.sum(c * a * b).alias("_sab"),
    )
    n = F.col("n")
    cov = F.col("_sab") - F.col("_sa") * F.col("_sb") / n
    va = F.col("_saa") - F.col("_sa") * F.col("_sa") / n
    vb = F.col("_sbb") - F.col("_sb") * F.col("_sb") / n
    return sums.select(*keys, "n", F.try_divide(cov, F.sqrt(va * vb)).alias("spearman"))
