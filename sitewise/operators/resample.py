"""Bootstrap and sign-flip tests from per-group sums and hashed draws.

Rows are reduced to one row of sums per group first. Replicates are then one matrix
product per batch of groups: hashed weights (replicates x groups) times sums (groups x
columns). A task adds its products up and hands over one partial matrix, so no group is
repeated per replicate and the replicate is a key only where the partial matrices merge.

One rule for missing values: rows that lack any value a statistic needs take no part, in
its sums, counts or groups. A null group is a group.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitewise.functions.hashing import hash32
from sitewise.operators.ordering import positions, running
from sitewise.session import checkpointed

CELLS = 1 << 19  # of the weight matrix at once
_STEP, _FIRST, _SECOND = np.uint32(2654435769), np.uint32(2246822507), np.uint32(3266489909)


def draw_words(seed: int, *parts) -> list[Column]:
    """Two 32-bit words per row from the MD5 of seed and parts, from which all its replicates are drawn."""
    text = F.concat_ws("|", F.lit(str(seed)), *[F.coalesce(F.col(p).cast("string") if isinstance(p, str) else p.cast("string"), F.lit("~")) for p in parts])
    digest = F.md5(text)
    return [F.conv(F.substring(digest, at, 8), 16, 10).cast("long") for at in (1, 9)]


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint32(16))) * _FIRST
    x = (x ^ (x >> np.uint32(13))) * _SECOND
    return x ^ (x >> np.uint32(16))


def draw_matrix(high: np.ndarray, low: np.ndarray, replicates: np.ndarray) -> np.ndarray:
    """Uniform 32-bit numbers, one row per replicate and one column per pair of words."""
    with np.errstate(over="ignore"):
        steps = replicates.astype(np.uint32)[:, None] * _STEP
        return _mixed(high.astype(np.uint32)[None, :] ^ _mixed(low.astype(np.uint32)[None, :] + steps))


def poisson_cumulative(mean: float) -> tuple[int, np.ndarray]:
    """The first count of a window that holds the distribution, and the cumulative probabilities from there."""
    spread = 12 * math.sqrt(mean) + 20
    first = max(0, math.floor(mean - spread))
    k = np.arange(first, math.ceil(mean + spread) + 1)
    log_factorial = np.array([math.lgamma(v + 1.0) for v in k.tolist()])
    return first, np.exp(-mean + k * math.log(mean) - log_factorial).cumsum()


_ONE = poisson_cumulative(1.0)[1][:13]
_WEIGHTS: dict[str, Callable[[np.ndarray], np.ndarray]] = {
    "poisson": lambda h: np.searchsorted(_ONE, h / 4294967296.0, side="right").astype(float),
    "sign": lambda h: 1.0 - 2.0 * (h & np.uint32(1)),
}


def replicate_sums(df: DataFrame, key: Sequence[str], values: Sequence[Column] | Column, replicates: int, seed: int, draw: str = "poisson",
                   by: str | None = None) -> DataFrame:
    """``[by], rep, sums``: per replicate the weighted totals of ``values`` over the rows of ``df``.

    ``values`` are columns or one array column of equal length in every row. A row's weights
    depend on the seed and on ``key`` alone. ``by`` splits the totals over a small set of
    keys. Null values count as zero.
    """
    words = draw_words(seed, *key)
    array = values if isinstance(values, Column) else F.array(*[F.coalesce(v.cast("double"), F.lit(0.0)) for v in values])
    rows = df.select(*([by] if by else []), words[0].alias("_high"), words[1].alias("_low"), array.alias("_x"))
    kind = df.schema[by].dataType.simpleString() if by else None
    number, step = np.arange(replicates), max(1, CELLS // replicates)

    def partial(batches):
        totals: dict = {}
        for pdf in batches:
            if not len(pdf):
                continue
            x, high, low = np.vstack(pdf["_x"].to_numpy()), pdf["_high"].to_numpy(), pdf["_low"].to_numpy()
            keys = [None if pd.isna(k) else k for k in pdf[by]] if by else [None] * len(pdf)
            for k in dict.fromkeys(keys):
                own = np.flatnonzero([q == k if k is not None else q is None for q in keys]) if by else np.arange(len(pdf))
                acc = totals.setdefault(k, np.zeros((replicates, x.shape[1])))
                for at in range(0, len(own), step):
                    some = own[at:at + step]
                    acc += _WEIGHTS[draw](draw_matrix(high[some], low[some], number)) @ x[some]
        for k, acc in totals.items():
            out = pd.DataFrame({"rep": number, "sums": list(acc)})
            if by:
                out.insert(0, by, [k] * replicates)
            yield out

    schema = (f"`{by}` {kind}, " if by else "") + "rep int, sums array<double>"
    merged = rows.mapInPandas(partial, schema).groupBy(*([by] if by else []), "rep").agg(Summarizer.sum(array_to_vector("sums")).alias("_v"))
    return merged.select(*([by] if by else []), "rep", vector_to_array("_v").alias("sums"))


def with_values(df: DataFrame, columns: Sequence[Column]) -> DataFrame:
    """Rows in which none of the columns is null."""
    return df.where(reduce(lambda a, b: a & b, [c.isNotNull() for c in columns])) if columns else df


def group_sums(df: DataFrame, group: str, sums: dict[str, Column]) -> DataFrame:
    """One row per group with the named sums."""
    return df.groupBy(group).agg(*[F.sum(c).alias(n) for n, c in sums.items()])


def numbered(groups: DataFrame, group: str) -> DataFrame:
    """Add ``_g``: 0-based index of the groups in key order."""
    return checkpointed(positions(groups, [], [group], "_g").withColumn("_g", F.col("_g") - 1))


DRAWS_PER_TASK = 1 << 20


def draw_counts(groups: DataFrame, replicates: int, seed: int) -> DataFrame:
    """``rep, _g, weight``: draws with replacement of as many groups as there are.

    ``groups`` carries ``_g``; draw i of replicate r picks ``hash(seed, r, i) mod G``.
    """
    total = groups.agg(F.count(F.lit(1)).alias("n")).first()["n"]
    # Groups are few bytes and may lie in one partition, but each becomes as many rows as there are replicates.
    spread = groups.select("_g").repartition(max(1, -(-total * replicates // DRAWS_PER_TASK)))
    draws = spread.select("_g", F.explode(F.sequence(F.lit(0), F.lit(replicates - 1))).alias("rep"))
    return draws.select("rep", (hash32(F.lit(seed), F.col("rep"), F.col("_g")) % F.lit(max(total, 1))).alias("_g")) \
        .groupBy("rep", "_g").agg(F.count(F.lit(1)).alias("weight"))


def bootstrap_sums(groups: DataFrame, group: str, sums: Sequence[str], replicates: int, seed: int,
                   weights: str = "poisson") -> DataFrame:
    """Weighted totals of ``sums`` per replicate.

    ``poisson`` draws each group's count on its own, inside the matrix product.
    ``multinomial`` draws exactly as many groups as there are; that needs an index
    and a join of groups x replicates rows.
    """
    if weights == "poisson":
        totals = replicate_sums(groups, [group], [F.col(f"`{s}`") for s in sums], replicates, seed)
        return totals.select("rep", *[F.get("sums", i).alias(s) for i, s in enumerate(sums)])
    indexed = numbered(groups, group)
    w = draw_counts(indexed, replicates, seed).join(indexed, "_g")
    return w.groupBy("rep").agg(*[F.expr(f"sum(weight * `{s}`) AS `{s}`") for s in sums])


def percentile_interval(replicates: DataFrame, keys: Sequence[str], stat: str, alpha: float = 0.05) -> DataFrame:
    """Percentile interval of a statistic over replicates.

    A group here is one replicate set of fixed size, so the built-in exact percentile fits.
    """
    return replicates.groupBy(*keys).agg(
        F.count(stat).alias("replicates"),
        F.percentile(stat, F.lit(alpha / 2)).alias("ci_low"),
        F.percentile(stat, F.lit(1 - alpha / 2)).alias("ci_high"),
    )


def bootstrap_ratio(df: DataFrame, group: str, numerator: Column, denominator: Column, replicates: int, seed: int,
                    weights: str = "poisson") -> DataFrame:
    """Cluster bootstrap of a ratio of sums over rows with both parts, one row per replicate."""
    sums = group_sums(with_values(df, [numerator, denominator]), group, {"_num": numerator, "_den": denominator})
    reps = bootstrap_sums(sums, group, ["_num", "_den"], replicates, seed, weights)
    return reps.select("rep", F.try_divide("_num", "_den").alias("estimate"))


def paired_error_bootstrap(df: DataFrame, group: str, y: str, models: Sequence[str],
                           contrasts: Sequence[tuple[str, str]], replicates: int, seed: int,
                           weights: str = "poisson") -> DataFrame:
    """Group bootstrap of the drop in mean absolute error, shared draws for every contrast.

    Rows without the outcome or without one of the predictions take no part in any contrast.
    """
    df = with_values(df, [F.col(y), *[F.col(m) for m in models]])
    sums = {f"_e{i}": F.abs(F.col(y) - F.col(m)) for i, m in enumerate(models)} | {"_n": F.lit(1.0)}
    reps = bootstrap_sums(group_sums(df, group, sums), group, list(sums), replicates, seed, weights)
    index = {m: i for i, m in enumerate(models)}
    rows = F.array(*[
        F.struct(F.lit(f"{a}_vs_{b}").alias("comparison"),
                 F.try_divide(F.col(f"_e{index[b]}") - F.col(f"_e{index[a]}"), F.col("_n")).alias("delta_mae"))
        for b, a in contrasts])
    return reps.select("rep", F.explode(rows).alias("r")).select("rep", "r.*")


ROWS_PER_PIECE = 50_000


def bootstrap_median(df: DataFrame, value: str, replicates: int, seed: int) -> DataFrame:
    """Row bootstrap of the median with Poisson counts: ``rep, estimate``, null where a replicate drew nothing.

    Works on distinct values with counts: the sum of ``n`` rows' Poisson(1) counts is one
    Poisson(n) count. Only values in a bracket around the median, seven standard errors wide,
    are drawn one by one; what lies below and above is one count each. The bracket
    holds a number of values that grows with the root of the rows. They are cut into sorted
    pieces; totals per piece and replicate tell which piece holds a replicate's middle
    ranks, and only there the counts are drawn again and summed up. Should a replicate's
    median lie outside, the bracket is widened and all are drawn anew.
    """
    spark, number = df.sparkSession, np.arange(replicates)
    counts = df.where(F.col(value).isNotNull()).groupBy(F.col(value).cast("double").alias("_v")).agg(F.count(F.lit(1)).alias("_n"))
    hist = checkpointed(running(counts, [], ["_v"], {"_upto": ("sum", F.col("_n"))}))
    rows = hist.agg(F.max("_upto").alias("n")).first()["n"]
    if not rows:
        return spark.createDataFrame([(r, None) for r in range(replicates)], "rep int, estimate double")
    reach = 3.5 / math.sqrt(rows)
    while True:
        low, high = max(0.0, 0.5 - reach), min(1.0, 0.5 + reach)
        first, last = math.floor((rows - 1) * low) + 1, math.ceil((rows - 1) * high) + 1
        ends = hist.agg(*[F.min(F.when(F.col("_upto") >= rank, F.col("_v"))).alias(n) for n, rank in (("low", first), ("high", last))]).first()
        place = F.when(F.col("_v") < ends["low"], 0).when(F.col("_v") > ends["high"], 2).otherwise(1)
        mass = {r["p"]: r["n"] for r in hist.groupBy(place.alias("p")).agg(F.sum("_n").alias("n")).collect()}
        outside = [_single_counts(spark, seed, name, mass.get(p, 0), number) for name, p in (("below", 0), ("above", 2))]
        found = _middle_values(hist.where(place == 1), outside[0], outside[1], replicates, seed)
        if found is not None or (low, high) == (0.0, 1.0):
            return found
        reach *= 4


def _single_counts(spark, seed: int, name: str, mean: int, number: np.ndarray) -> np.ndarray:
    if not mean:
        return np.zeros(len(number), np.int64)
    words = spark.range(1).select(*[w.alias(f"w{i}") for i, w in enumerate(draw_words(seed, F.lit(name)))]).first()
    first, upto = poisson_cumulative(mean)
    uniform = draw_matrix(np.array([words["w0"]]), np.array([words["w1"]]), number)[:, 0] / 4294967296.0
    return first + np.searchsorted(upto, uniform, side="right")


def _counts(high: np.ndarray, low: np.ndarray, means: np.ndarray, number: np.ndarray) -> np.ndarray:
    """Poisson counts, one row per replicate, of values that occur ``means`` times."""
    uniform = draw_matrix(high, low, number) / 4294967296.0
    out = np.empty(uniform.shape, np.int64)
    for mean in np.unique(means):
        first, upto = poisson_cumulative(float(mean))
        at = np.flatnonzero(means == mean)
        out[:, at] = first + np.searchsorted(upto, uniform[:, at], side="right")
    return out


def _middle_values(inside: DataFrame, below: np.ndarray, above: np.ndarray, replicates: int, seed: int) -> DataFrame | None:
    """``rep, estimate`` from the values of the bracket, or none if a middle rank lies outside it."""
    spark, number = inside.sparkSession, np.arange(replicates)
    indexed = positions(inside, [], ["_v"], "_i")
    words = draw_words(seed, F.col("_i"))
    placed = indexed.select("_v", "_n", words[0].alias("_high"), words[1].alias("_low"), F.floor((F.col("_i") - 1) / ROWS_PER_PIECE).alias("_piece"))
    parts = checkpointed(placed.repartition(max(1, placed.count() // ROWS_PER_PIECE), "_piece"))

    def pieces(batches):
        held = [pdf for pdf in batches if len(pdf)]
        for piece, rows in (pd.concat(held) if held else pd.DataFrame({"_piece": []})).groupby("_piece"):
            yield int(piece), rows.sort_values("_v")

    def chunks(rows):
        step = max(1, CELLS // replicates)
        for at in range(0, len(rows), step):
            some = rows.iloc[at:at + step]
            yield some["_v"].to_numpy(), _counts(some["_high"].to_numpy(), some["_low"].to_numpy(), some["_n"].to_numpy(), number)

    def totals(batches):
        for piece, rows in pieces(batches):
            yield pd.DataFrame({"piece": [piece], "total": [sum(c.sum(1) for _, c in chunks(rows))]})

    # One number per piece and replicate; pieces grow with the root of the rows.
    summed = {r["piece"]: np.array(r["total"]) for r in parts.mapInPandas(totals, "piece long, total array<long>").collect()}
    order = sorted(summed)
    upto = below + np.cumsum([np.zeros(replicates, np.int64), *[summed[p] for p in order]], axis=0)
    size = upto[-1] + above
    ranks = np.stack([(size - 1) // 2 + 1, size // 2 + 1])
    drew = size > 0
    if (drew & ((ranks[0] <= below) | (ranks[1] > upto[-1]))).any():
        return None
    starts = dict(zip(order, upto))

    def middles(batches):
        for piece, rows in pieces(batches):
            done, out = starts[piece].copy(), np.full((2, replicates), np.nan)
            for values, counts in chunks(rows):
                reached = done[:, None] + counts.cumsum(1)
                for side in (0, 1):
                    here = np.flatnonzero(drew & (ranks[side] > done) & (ranks[side] <= reached[:, -1]))
                    out[side, here] = values[(reached[here] < ranks[side, here][:, None]).sum(1)]
                done = reached[:, -1]
            side, rep = np.nonzero(~np.isnan(out))
            yield pd.DataFrame({"rep": rep, "side": side, "v": out[side, rep]})

    hits = parts.mapInPandas(middles, "rep int, side int, v double").groupBy("rep").agg(
        *[F.max(F.when(F.col("side") == i, F.col("v"))).alias(f"_{i}") for i in (0, 1)])
    every = spark.range(replicates).select(F.col("id").cast("int").alias("rep"))
    return every.join(hits, "rep", "left").select("rep", (F.col("_0") + (F.col("_1") - F.col("_0")) * 0.5).alias("estimate"))


def sign_flip(groups: DataFrame, group: str, total: str, denominator: Column, replicates: int, seed: int) -> DataFrame:
    """Null replicates: each group's sum gets a hashed sign. ``rep, null_mean``."""
    flipped = replicate_sums(groups, [group], [F.col(total)], replicates, seed, "sign")
    return flipped.select("rep", F.try_divide(F.get("sums", 0), denominator).alias("null_mean"))


def sign_flip_test(df: DataFrame, group: str, value: Column, replicates: int, seed: int) -> DataFrame:
    """Two-sided sign-flip test of a mean with whole groups flipped, over rows with a value.

    The comparison allows for the last digits lost by summing in another order.
    """
    sums = checkpointed(group_sums(with_values(df, [value]), group, {"_s": value, "_n": F.lit(1.0)}))
    n = sums.agg(F.sum("_n").alias("n")).scalar()
    observed = sums.agg(F.try_divide(F.sum("_s"), F.sum("_n")).alias("m"))
    null = sign_flip(sums, group, "_s", n, replicates, seed)
    limit = F.abs(observed.scalar()) * (1 - 1e-12)
    hits = null.agg(F.count_if(F.abs(F.col("null_mean")) >= limit).alias("exceed"), F.count(F.lit(1)).alias("replicates"))
    return hits.select(
        observed.scalar().alias("mean"), "exceed", "replicates",
        ((F.col("exceed") + 1) / (F.col("replicates") + 1)).alias("p_value"))


def bootstrap_fit(groups: DataFrame, group: str, gram: Sequence[str], solve: Callable[[np.ndarray], dict[str, float]],
                  outputs: Sequence[str], replicates: int, seed: int, weights: str = "poisson") -> DataFrame:
    """Refit per replicate from weighted sums of per-group sufficient statistics.

    ``solve`` turns one replicate's sums (in the order of ``gram``) into named numbers.
    """
    reps = bootstrap_sums(groups, group, gram, replicates, seed, weights)
    names, outs = list(gram), list(outputs)

    def run(batches):
        for pdf in batches:
            rows = [solve(v) for v in pdf[names].to_numpy(dtype=float)]
            out = pd.DataFrame(rows, columns=outs)
            out.insert(0, "rep", pdf["rep"].to_numpy())
            yield out

    schema = "rep int, " + ", ".join(f"`{o}` double" for o in outs)
    return reps.mapInPandas(run, schema)
