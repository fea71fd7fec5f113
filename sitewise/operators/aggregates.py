"""Profiles, funnels, balance, agreement, calibration and pooling."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sitewise.functions.scalars import MISSING_TOKENS, bin_left_closed, bin_right_closed, lenient_double
from sitewise.functions.vectors import valid_count
from sitewise.operators.ordering import on_keys, quantile_array, quantiles, spearman_frame
from sitewise.operators.resample import replicate_sums
from sitewise.session import checkpointed

# Fixed value: value counts are kept for columns with at most this many values.
LOW_CARDINALITY = 31


def _long(df: DataFrame, keys: Sequence[str], columns: Sequence[str], cast: str = "double",
          name: str = "variable", value: str = "value") -> DataFrame:
    pairs = F.array(*[F.struct(F.lit(c).alias(name), F.col(c).cast(cast).alias(value)) for c in columns])
    return df.select(*keys, F.explode(pairs).alias("_kv")).select(*keys, f"_kv.{name}", f"_kv.{value}")


def column_profile(df: DataFrame, columns: Sequence[str], tokens: Sequence[str] = MISSING_TOKENS) -> DataFrame:
    """Rows, missing, numeric count, minimum and maximum of each column; one aggregate of one row."""
    def profile(c: str) -> Column:
        text = F.col(c).cast("string")
        missing = text.isNull() | text.isin(*tokens)
        number = F.when(~missing, lenient_double(text))
        return F.struct(
            F.lit(c).alias("column"),
            F.count(F.lit(1)).alias("rows"),
            F.count_if(missing).alias("missing"),
            F.round(F.avg(missing.cast("int")), 8).alias("missing_fraction"),
            F.count(number).alias("numeric"),
            F.min(number).alias("minimum"),
            F.max(number).alias("maximum"),
        )

    return df.agg(F.array(*[profile(c) for c in columns]).alias("_c")).select(F.inline("_c"))


_COUNTED = (T.IntegralType, T.FractionalType, T.StringType, T.BooleanType, T.DateType, T.TimestampType)


def _few_values(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    """Counts of each column's values in a task; a column with more than ``most`` gives one row without a count."""
    found: list[dict] | None = None
    schema: pa.Schema | None = None
    for batch in batches:
        schema = batch.schema
        found = [{} for _ in schema] if found is None else found
        for column, counts in zip(batch.columns, found):
            if len(counts) > most:
                continue
            for pair in pc.value_counts(column).to_pylist():
                value = pair["values"]
                if value is not None:
                    value = math.nan if value != value else value  # one object, found by identity
                    counts[value] = counts.get(value, 0) + pair["counts"]
    rows = [(i, v, n) for i, counts in enumerate(found or ()) for v, n in (counts.items() if len(counts) <= most else ((None, None),))]
    if rows:
        at, values, counts = zip(*rows)
        columns = [pa.array([v if k == i else None for k, v in zip(at, values)], field.type) for i, field in enumerate(schema)]
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(counts, pa.int64()), *columns], ["_at", "_n", *schema.names])


def low_cardinality_counts(df: DataFrame, columns: Sequence[str], limit: int = LOW_CARDINALITY,
                           tokens: Sequence[str] = MISSING_TOKENS) -> DataFrame:
    """Value counts of the columns with at most ``limit`` distinct values.

    One scan: a task keeps the values of a column, typed as they are, until they are too
    many, and hands on a few counts or the mark that they were.
    """
    typed = df.select(*[(F.col(c) if isinstance(df.schema[c].dataType, _COUNTED) else F.col(c).cast("string")).alias(f"v{i}") for i, c in enumerate(columns)])
    most = limit + len(tokens)  # the missing-value tokens do not count
    schema = T.StructType([T.StructField("_at", T.IntegerType()), T.StructField("_n", T.LongType()), *[T.StructField(f.name, f.dataType) for f in typed.schema]])
    parts = typed.mapInArrow(lambda b: _few_values(b, most), schema)
    text = F.coalesce(*[F.col(f"v{i}").cast("string") for i in range(len(columns))])
    counts = parts.select(F.get(F.array(*[F.lit(c) for c in columns]), F.col("_at")).alias("column"), text.alias("value"), "_n") \
        .where(F.col("value").isNull() | ~F.col("value").isin(*tokens)).groupBy("column", "value").agg(F.sum("_n").alias("count"))
    # A row without a value is the mark.
    counts = checkpointed(counts)
    narrow = counts.groupBy("column").agg(F.count(F.lit(1)).alias("_d"), F.count_if(F.col("value").isNull()).alias("_over")).where((F.col("_d") <= limit) & (F.col("_over") == 0))
    return counts.join(narrow.select("column"), "column", "left_semi")


def vector_profile(df: DataFrame, tid: str = "tid", length: str = "length", values: str = "values") -> DataFrame:
    size, valid = F.size(values), valid_count(F.col(values))
    versioned = F.contains(F.col(tid).cast("string"), F.lit("."))
    return df.agg(
        F.count(F.lit(1)).alias("rows"),
        F.count_if(size != F.col(length)).alias("length_mismatch_rows"),
        F.sum(size.cast("long")).alias("elements"),
        F.sum(valid.cast("long")).alias("valid_elements"),
        F.round(F.try_divide(F.sum(valid.cast("long")), F.sum(size.cast("long"))), 8).alias("valid_fraction"),
        F.count_if(versioned).alias("versioned_ids"),
        F.count_if(~versioned).alias("unversioned_ids"),
    )


def counter(df: DataFrame, by: Sequence[str]) -> DataFrame:
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias("count"))


def funnel(df: DataFrame, stages: Sequence[tuple[str, Column]], digits: int = 8) -> DataFrame:
    """Ordered stages with counts and the fraction kept from the stage before; one pass."""
    one = df.agg(*[F.count_if(F.coalesce(cond, F.lit(False))).alias(f"_s{i}") for i, (_, cond) in enumerate(stages)])
    rows = F.array(*[
        F.struct(F.lit(i + 1).alias("step"), F.lit(name).alias("stage"), F.col(f"_s{i}").alias("count"),
                 (F.round(F.try_divide(F.col(f"_s{i}"), F.col(f"_s{i - 1}")), digits) if i
                  else F.lit(None).cast("double")).alias("retained_from_previous"))
        for i, (name, _) in enumerate(stages)
    ])
    return one.select(F.explode(rows).alias("r")).select("r.*")


def reason_counts(df: DataFrame, reason: Column, kept: str = "retained") -> DataFrame:
    """Rows per exclusive drop reason; an empty reason means kept."""
    named = F.when(reason == "", kept).otherwise(reason)
    return df.groupBy(named.alias("reason")).agg(F.count(F.lit(1)).alias("count"))


def grouped_summary(df: DataFrame, by: Sequence[str], value: str, distinct: dict[str, str]) -> DataFrame:
    """Rows, distinct counts, mean and sample sd per group."""
    return df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("sites"),
        *[F.count_distinct(c).alias(name) for name, c in distinct.items()],
        F.avg(value).alias("mean"), F.stddev_samp(value).alias("sd"),
    )


def replicate_agreement(df: DataFrame, a: str, b: str, depth: str, unit: str,
                        thresholds: Sequence[float] = ()) -> DataFrame:
    """Agreement of two replicates: all rows, per depth quartile, above each depth threshold."""
    edges = quantile_array(df, depth, [0, 0.25, 0.5, 0.75, 1.0])
    quartile = F.concat(F.lit("depth_Q"), bin_right_closed(F.col(depth), edges).cast("string"))
    labels = [F.lit("all"), quartile] + [
        F.when(F.col(depth) >= t, F.lit(f"depth_ge_{t}")) for t in thresholds
    ]
    long = df.select(F.col(a).alias("_a"), F.col(b).alias("_b"), F.col(depth).alias("_d"), F.col(unit).alias("_u"),
                     F.explode(F.array_compact(F.array(*labels))).alias("subset"))
    diff = F.col("_a") - F.col("_b")
    base = long.groupBy("subset").agg(
        F.count(F.lit(1)).alias("sites"), F.count_distinct("_u").alias("units"),
        F.min("_d").alias("depth_min"), F.avg(F.abs(diff)).alias("mae"),
        F.sqrt(F.avg(diff * diff)).alias("rmse"), F.corr("_a", "_b").alias("pearson"),
        F.avg(diff).alias("mean_difference"),
    )
    rho = spearman_frame(long, ["subset"], "_a", "_b").select("subset", "spearman")
    middle = quantiles(long, ["subset"], "_d", {"depth_median": 0.5})
    return base.join(rho, "subset").join(middle, "subset")


def numeric_balance(df: DataFrame, group: str, levels: tuple[str, str], metrics: Sequence[str],
                    pooling: str = "weighted") -> DataFrame:
    """Standardised mean difference of each metric between two groups.

    ``pooling="weighted"`` pools variances by ``n-1``; ``"average"`` halves their sum.
    """
    long = _long(df.where(F.col(group).isin(*levels)), [group], metrics, name="metric")
    a, b = F.col(group) == levels[0], F.col(group) == levels[1]

    def pick(fn, cond, name):
        return fn(F.when(cond, F.col("value"))).alias(name)

    w = long.groupBy("metric").agg(
        pick(F.count, a, "n_a"), pick(F.count, b, "n_b"), pick(F.avg, a, "mean_a"), pick(F.avg, b, "mean_b"),
        pick(F.var_samp, a, "var_a"), pick(F.var_samp, b, "var_b"),
        F.count_if(a & F.col("value").isNull()).alias("missing_a"),
        F.count_if(b & F.col("value").isNull()).alias("missing_b"),
    )
    if pooling == "weighted":
        pooled = F.sqrt(((F.col("n_a") - 1) * F.col("var_a") + (F.col("n_b") - 1) * F.col("var_b"))
                        / F.greatest(F.col("n_a") + F.col("n_b") - 2, F.lit(1)))
    else:
        pooled = F.sqrt((F.col("var_a") + F.col("var_b")) / 2)
    return w.select(
        "metric", "n_a", "n_b", "missing_a", "missing_b", "mean_a", "mean_b",
        F.sqrt("var_a").alias("sd_a"), F.sqrt("var_b").alias("sd_b"),
        F.when(pooled > 0, (F.col("mean_a") - F.col("mean_b")) / pooled).alias("smd"),
    )


def categorical_balance(df: DataFrame, group: str, levels: tuple[str, str], columns: Sequence[str],
                        missing: str = "<missing>") -> DataFrame:
    """Per level: counts, proportions in both groups and their standardised difference."""
    long = _long(df.where(F.col(group).isin(*levels)), [group], columns, "string", "variable", "level") \
        .withColumn("level", F.coalesce("level", F.lit(missing)))
    a, b = F.col(group) == levels[0], F.col(group) == levels[1]
    counts = long.groupBy("variable", "level").agg(F.count_if(a).alias("n_a"), F.count_if(b).alias("n_b"))
    totals = df.agg(F.count_if(a).alias("ta"), F.count_if(b).alias("tb"))
    pa = F.try_divide(F.col("n_a"), totals.select("ta").scalar())
    pb = F.try_divide(F.col("n_b"), totals.select("tb").scalar())
    out = counts.withColumns({"p_a": pa, "p_b": pb})
    pooled = F.sqrt((F.col("p_a") * (1 - F.col("p_a")) + F.col("p_b") * (1 - F.col("p_b"))) / 2)
    return out.withColumn("smd", F.when(pooled > 0, (F.col("p_a") - F.col("p_b")) / pooled))


def quantile_edges(df: DataFrame, column: str, bins: int, duplicates: str = "raise") -> Column:
    """Edges of ``bins`` equal-count bins; equal edges raise or are dropped."""
    edges = quantile_array(df, column, [i / bins for i in range(bins + 1)])
    if duplicates == "drop":
        return F.array_distinct(edges)
    return F.when(F.size(F.array_distinct(edges)) == bins + 1, edges).otherwise(
        F.raise_error(F.lit(f"bin edges of {column} are not unique")))


def quantile_bin(df: DataFrame, column: str, bins: int, name: str = "bin", duplicates: str = "raise") -> DataFrame:
    """Equal-count bins: right-closed, the lowest value included."""
    return df.withColumn(name, bin_right_closed(F.col(column), quantile_edges(df, column, bins, duplicates)))


def binned_trend(df: DataFrame, x: str, y: str, unit: str, bins: int = 20) -> DataFrame:
    binned = quantile_bin(df, x, bins, "bin", "drop")
    base = binned.groupBy("bin").agg(
        F.count(F.lit(1)).alias("sites"), F.count_distinct(unit).alias("units"),
        F.avg(x).alias("x_mean"), F.avg(y).alias("y_mean"), F.min(x).alias("x_min"), F.max(x).alias("x_max"),
    )
    return base.join(quantiles(binned, ["bin"], y, {"y_median": 0.5}), "bin")


def positional_profile(df: DataFrame, by: str, window: str, half: int, unit: str) -> DataFrame:
    """Mean, valid sites and valid units per group and relative position."""
    long = df.select(by, unit, F.posexplode(window).alias("_i", "_x")).where(F.col("_x").isNotNull())
    return long.groupBy(by, (F.col("_i") - half).alias("relative_position")).agg(
        F.avg("_x").alias("mean"), F.count(F.lit(1)).alias("valid_sites"),
        F.count_distinct(unit).alias("valid_units"),
    )


def profile_band(df: DataFrame, by: str, window: str, half: int, unit: str, replicates: int, seed: int,
                 alpha: float = 0.05) -> DataFrame:
    """Pointwise percentile band of the positional mean, units drawn with Poisson counts within each group.

    Rows become one array of sums and counts per (group, unit) before any replicate is formed;
    a null element counts nowhere.
    """
    long = df.select(by, unit, F.posexplode(window).alias("_i", "_x")).where(F.col("_x").isNotNull())
    each = long.groupBy(by, unit, "_i").agg(F.sum("_x").alias("_s"), F.count(F.lit(1)).cast("double").alias("_c"))
    placed = each.groupBy(by, unit).agg(F.map_from_entries(F.collect_list(F.struct("_i", F.struct("_s", "_c")))).alias("_at"))
    at, wide = F.sequence(F.lit(0), F.lit(2 * half)), 2 * half + 1

    def dense(name):
        return F.transform(at, lambda i: F.coalesce(F.col("_at")[i][name], F.lit(0.0)))

    totals = replicate_sums(placed, [by, unit], F.concat(dense("_s"), dense("_c")), replicates, seed, by=by)
    means = totals.select(by, F.posexplode(F.transform(at, lambda i: F.try_divide(F.get("sums", i), F.get("sums", i + wide)))).alias("_i", "_m"))
    return means.where("_m is not null").groupBy(by, (F.col("_i") - half).alias("relative_position")).agg(
        F.percentile("_m", F.lit(alpha / 2)).alias("ci_low"), F.percentile("_m", F.lit(1 - alpha / 2)).alias("ci_high"))


def isoform_means(df: DataFrame, site: str, value: str, weight: str, floor: float = 1e-12) -> DataFrame:
    """Equal-weight and coverage-weight mean per site."""
    w = F.greatest(F.coalesce(F.col(weight).cast("double"), F.lit(floor)), F.lit(floor))
    return df.where(F.col(value).isNotNull()).groupBy(site).agg(
        F.count(F.lit(1)).alias("rows"), F.avg(value).alias("equal_mean"),
        (F.sum(F.col(value) * w) / F.sum(w)).alias("weighted_mean"),
    )


def regression_metrics(df: DataFrame, keys: Sequence[str], y: str, prediction: str,
                       spearman: bool = True) -> DataFrame:
    """MAE, RMSE, R2 and (optionally) rank correlation per group, all over rows with both values."""
    df = df.where(F.col(y).isNotNull() & F.col(prediction).isNotNull())
    e, yc = F.col(prediction) - F.col(y), F.col(y)
    base = df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.avg(F.abs(e)).alias("mae"), F.sqrt(F.avg(e * e)).alias("rmse"),
        (1 - F.try_divide(F.sum(e * e), F.var_pop(yc) * F.count(yc))).alias("r2"),
    )
    if not spearman:
        return base
    rho = spearman_frame(df, keys, y, prediction)
    if keys:
        return base.alias("l").join(rho.alias("r"), on_keys("l", "r", keys), "left").select("l.*", "r.spearman")
    return base.withColumn("spearman", rho.select("spearman").scalar())


def error_diagnostics(df: DataFrame, keys: Sequence[str], y: str, prediction: str) -> DataFrame:
    """Signed and absolute error, prediction distribution and clip counts per group."""
    p, e = F.col(prediction), F.col(prediction) - F.col(y)
    work = df.withColumn("_abs", F.abs(e))
    base = work.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("sites"), F.avg(e).alias("mean_signed_error"),
        F.avg(y).alias("observed_mean"), F.stddev_pop(y).alias("observed_sd"),
        F.avg(p).alias("prediction_mean"), F.stddev_pop(p).alias("prediction_sd"),
        F.min(p).alias("prediction_min"), F.max(p).alias("prediction_max"),
        F.count_if(p == 0).alias("at_clip_0_count"), F.count_if(p == 1).alias("at_clip_1_count"),
        F.avg(((p == 0) | (p == 1)).cast("double")).alias("at_either_clip_fraction"),
    )
    errors = quantiles(work, keys, "_abs", {"median_absolute_error": 0.5, "p90_absolute_error": 0.9})
    spread = quantiles(work, keys, prediction, {"prediction_q05": 0.05, "prediction_median": 0.5,
                                                "prediction_q95": 0.95})
    for frame in (errors, spread):
        new = [c for c in frame.columns if c not in keys]
        if keys:
            base = base.alias("l").join(frame.alias("r"), on_keys("l", "r", keys), "left").select("l.*", *[f"r.{c}" for c in new])
        else:
            base = base.withColumn("_f", frame.select(F.struct(*new)).scalar()).select(*base.columns, "_f.*")
    return base


def calibration_table(df: DataFrame, keys: Sequence[str], y: str, prediction: str,
                      edges: Sequence[float]) -> DataFrame:
    """Mean prediction and outcome per fixed bin; empty bins stay in the table.

    ``edges`` come from training labels; the outer bins are unbounded.
    """
    inner = F.array(*[F.lit(float(e)) for e in edges[1:-1]])
    binned = df.withColumn("bin_index", bin_left_closed(F.col(prediction), inner))
    stats = binned.groupBy(*keys, "bin_index").agg(
        F.count(F.lit(1)).alias("bin_count"), F.avg(prediction).alias("mean_prediction"),
        F.avg(y).alias("mean_observed"), F.avg(F.col(prediction) - F.col(y)).alias("mean_signed_error"),
    )
    bins = F.explode(F.sequence(F.lit(1), F.lit(len(edges) - 1))).alias("bin_index")
    spine = df.select(*keys).distinct().select(*keys, bins) if keys else df.sparkSession.range(1).select(bins)
    lows = F.array(*[F.lit(float(e)) for e in edges])
    new = [f"r.{c}" for c in stats.columns if c not in (*keys, "bin_index")]
    return spine.alias("l").join(stats.alias("r"), on_keys("l", "r", [*keys, "bin_index"]), "left").select("l.*", *new).withColumns({
        "bin_count": F.coalesce("bin_count", F.lit(0)),
        "edge_low": F.get(lows, F.col("bin_index") - 1), "edge_high": F.get(lows, F.col("bin_index")),
    })


def inverse_variance_pool(df: DataFrame, effect: str, se: str) -> DataFrame:
    """Fixed-effect and DerSimonian-Laird pooling of study rows, one row per model.

    One pass sums what both models need, with effects measured from a value among them
    so that the heterogeneity sum does not cancel; one more, with the between-study
    variance known, sums the random-effect weights.
    """
    studies = df.select(F.col(effect).alias("_e"), F.col(se).alias("_s")).where("_e is not null and _s is not null")
    origin = F.lit(studies.agg(F.min("_e").alias("o")).first()["o"]).cast("double")
    e, w = F.col("_e") - origin, 1 / (F.col("_s") * F.col("_s"))
    sums = studies.agg(
        F.count(F.lit(1)).alias("k"), F.sum(w).alias("sw"), F.sum(w * w).alias("sww"), F.sum(w * e).alias("swe"), F.sum(w * e * e).alias("swee"))
    q, more = F.col("swee") - F.col("swe") * F.col("swe") / F.col("sw"), F.col("sw") - F.col("sww") / F.col("sw")
    first = sums.withColumns({"Q": F.greatest(q, F.lit(0.0)), "Q_df": F.col("k") - 1, "_c": more})
    excess = F.col("Q") - F.col("Q_df")
    first = checkpointed(first.select(
        "Q", "Q_df", F.when(F.col("Q") > 0, F.greatest(F.lit(0.0), excess / F.col("Q") * 100)).otherwise(0.0).alias("I2_percent"),
        F.when(F.col("_c") > 0, F.greatest(F.lit(0.0), excess / F.col("_c"))).otherwise(0.0).alias("tau2"),
        (origin + F.col("swe") / F.col("sw")).alias("_fixed"), F.sqrt(1 / F.col("sw")).alias("_fixed_se")))
    wr = 1 / (F.col("_s") * F.col("_s") + F.lit(first.first()["tau2"]))
    random = studies.agg(F.struct((F.sum(wr * F.col("_e")) / F.sum(wr)).alias("_random"), F.sqrt(1 / F.sum(wr)).alias("_random_se"))).scalar()
    models = F.array(*[F.struct(F.lit(n).alias("model"), F.col(f"_{m}").alias("estimate"), F.col(f"_{m}_se").alias("standard_error"))
                       for n, m in (("fixed_effect", "fixed"), ("random_effect_DL", "random"))])
    est, s = F.col("estimate"), F.col("standard_error")
    het = ["Q", "Q_df", "I2_percent", "tau2"]
    both = first.withColumn("_r", random).select(*first.columns, "_r.*")
    return both.select(F.inline(models), *het).select("model", "estimate", "standard_error", *het).withColumns({
        "ci95_low": est - 1.96 * s, "ci95_high": est + 1.96 * s, "z": est / s})


def overlap_crosstab(df: DataFrame, flags: tuple[str, str]) -> DataFrame:
    a, b = (F.col(f) for f in flags)
    return df.agg(
        F.count(F.lit(1)).alias("rows"), F.count_if(a).alias("first"), F.count_if(b).alias("second"),
        F.count_if(a & b).alias("both"), F.count_if(a | b).alias("either"), F.count_if(~a & ~b).alias("neither"),
    )


def unseen_levels(train: DataFrame, other: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Rows of ``other`` whose level never occurs in ``train``, per column."""
    seen = _long(train, [], columns, "string", "variable", "level").distinct()
    return (
        _long(other, [], columns, "string", "variable", "level")
        .groupBy("variable", "level").agg(F.count(F.lit(1)).alias("_n"))
        .join(seen.withColumn("_seen", F.lit(True)), ["variable", "level"], "left")
        .groupBy("variable").agg(
            F.sum(F.when(F.col("_seen").isNull(), F.col("_n")).otherwise(0)).alias("unseen_rows"),
            F.count_if(F.col("_seen").isNull()).alias("unseen_levels"))
    )


def ratio_stability(df: DataFrame, keys: Sequence[str], count: str, minimum: float) -> DataFrame:
    """Smallest over largest count across variants, and whether it reaches ``minimum``."""
    ratio = F.coalesce(F.try_divide(F.min(count), F.max(count)), F.lit(0.0))
    return df.groupBy(*keys).agg(ratio.alias("stability_ratio"), (ratio >= minimum).alias("stability_pass"))


def delta_table(df: DataFrame, keys: Sequence[str], variant: str, metric: str,
                comparisons: Sequence[tuple[str, str]]) -> DataFrame:
    """Metric of the baseline minus the augmented variant for each named comparison."""
    wide = df.groupBy(*keys).pivot(variant, sorted({v for pair in comparisons for v in pair})).agg(F.first(metric))
    rows = F.array(*[
        F.struct(F.lit(f"{aug}_vs_{base}").alias("comparison"), F.lit(base).alias("baseline"),
                 F.lit(aug).alias("augmented"), (F.col(base) - F.col(aug)).alias("delta"))
        for base, aug in comparisons
    ])
    return wide.select(*keys, F.explode(rows).alias("r")).select(*keys, "r.*")


def coverage_summary(df: DataFrame, site: str, coverage: str, valid: str, centre: str) -> DataFrame:
    """Valid windows at row and site level, and mean and exact median coverage."""
    ok = F.col(valid)
    sites, good = F.count_distinct(site), F.count_distinct(F.when(ok, F.col(site)))
    middle = quantiles(df, [], coverage, {"median_coverage": 0.5})
    whole = df.agg(
        F.count(F.lit(1)).alias("rows"), sites.alias("sites"), good.alias("valid_sites"),
        F.round(F.try_divide(good, sites), 8).alias("site_valid_fraction"),
        F.count_if(ok).alias("valid_rows"), F.round(F.avg(ok.cast("double")), 8).alias("row_valid_fraction"),
        F.count(centre).alias("centre_available_rows"), F.round(F.avg(coverage), 8).alias("mean_coverage"),
    )
    return whole.withColumn("median_coverage", F.round(middle.select("median_coverage").scalar(), 8))


def field_audit(df: DataFrame, fields: Sequence[str]) -> DataFrame:
    """Minimum, median, maximum and missing count of each field."""
    long = _long(df, [], fields, name="field")
    base = long.groupBy("field").agg(
        F.min("value").alias("minimum"), F.max("value").alias("maximum"),
        F.count_if(F.col("value").isNull()).alias("missing"))
    return base.join(quantiles(long, ["field"], "value", {"median": 0.5}), "field", "left")


LOW_N_ROLE = "DESCRIPTIVE_ONLY_LOW_N"


def low_n_description(df: DataFrame, x: str, y: str, keys: Sequence[str] = ()) -> DataFrame:
    """Medians and rank correlation of sets too small for inference, which says so: ``[keys], n, analysis_role, ...``.

    The medians are over the values that each column has, the correlation over rows with both.
    """
    keys = list(keys)
    sizes = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    parts = [quantiles(df, keys, c, {f"median_{c}": 0.5}) for c in (x, y)]
    parts.append(spearman_frame(df, keys, x, y).withColumnRenamed("n", "_pairs").withColumnRenamed("spearman", "spearman_rho").drop("_pairs"))
    out = sizes
    for part in parts:
        names = [c for c in part.columns if c not in keys]
        out = out.alias("l").join(part.alias("r"), on_keys("l", "r", keys), "left").select("l.*", *[f"r.{c}" for c in names])
    return out.withColumns({"analysis_role": F.lit(LOW_N_ROLE), "inferential_p_value_reported": F.lit(False)})


def group_size(df: DataFrame, by: Sequence[str], name: str = "group_size", many: bool = False) -> DataFrame:
    """Group size on every row: a combined count joined back, not a window over the group.

    With ``many`` groups, which grow with the data, a task keeps the sizes of its groups in a
    hash table and its rows pass by; a merge join would sort all rows of a task.
    """
    sizes = df.groupBy(*by).agg(F.count(F.lit(1)).alias(name))
    sizes = sizes.hint("shuffle_hash") if many else sizes
    return df.alias("l").join(sizes.alias("r"), on_keys("l", "r", by)).select("l.*", f"r.{name}")

