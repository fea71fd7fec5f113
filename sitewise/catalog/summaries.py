"""Profiles, funnels, balance, agreement, calibration and pooling."""

from pyspark.sql import functions as F

from sitewise.catalog.registry import query
from sitewise.catalog.standins import POISSON_COUNT, REPLICATES_SQL, VECTORS_SQL, draws_sql, r6, replicates, vectors
from sitewise.functions.vectors import flank_coverage, main_window_valid, window_vector
from sitewise.operators import aggregates as A
from sitewise.operators.ordering import quantiles, spearman_frame

_COLS = ["l_quantity", "l_extendedprice", "l_returnflag", "l_tax", "l_linenumber"]


@query("column_profiles", "SELECT * FROM (" + " UNION ALL ".join(f"""
SELECT '{c}' AS "column", CAST(count(*) AS BIGINT) AS rows, CAST(sum(CASE WHEN v IS NULL OR v = '' THEN 1 ELSE 0 END) AS BIGINT) AS missing,
  round(avg(CASE WHEN v IS NULL OR v = '' THEN 1 ELSE 0 END), 8) AS missing_fraction, CAST(count(try_cast(v AS DOUBLE)) AS BIGINT) AS numeric,
  round(min(try_cast(v AS DOUBLE)), 6) AS minimum, round(max(try_cast(v AS DOUBLE)), 6) AS maximum
FROM (SELECT CASE WHEN '{c}' = 'l_tax' AND l_tax = 0 THEN NULL ELSE CAST({c} AS VARCHAR) END AS v FROM lineitem)""" for c in _COLS) + ")")
def _(t):
    df = t("lineitem").withColumn("l_tax", F.when(F.col("l_tax") != 0, F.col("l_tax")))
    p = A.column_profile(df, _COLS)
    return p.withColumns({"minimum": r6(F.col("minimum")), "maximum": r6(F.col("maximum"))})


@query("low_cardinality_counts", " UNION ALL ".join(f"""
SELECT '{c}' AS "column", CAST({c} AS VARCHAR) AS value, CAST(count(*) AS BIGINT) AS count FROM lineitem GROUP BY {c}
""" for c in ("l_returnflag", "l_linestatus", "l_linenumber")))
def _(t):
    return A.low_cardinality_counts(t("lineitem"), ["l_returnflag", "l_linestatus", "l_linenumber", "l_partkey", "l_extendedprice"])


@query("category_counters", """
SELECT lang, source, CAST(count(*) AS BIGINT) AS count FROM documents GROUP BY lang, source""")
def _(t):
    return A.counter(t("documents"), ["lang", "source"])


@query("attrition_funnel", f"""
WITH {REPLICATES_SQL}, j AS (SELECT r1.k IS NOT NULL AS a, r2.k IS NOT NULL AS b, coalesce(r1.ag, 0) + coalesce(r2.ag, 0) AS ag FROM r1 FULL OUTER JOIN r2 ON r1.k = r2.k),
c AS (SELECT count(*) AS s1, count(*) FILTER (b) AS s2, count(*) FILTER (a AND b) AS s3, count(*) FILTER (a AND b AND ag > 250) AS s4 FROM j)
SELECT CAST(1 AS BIGINT) AS step, 'union' AS stage, CAST(s1 AS BIGINT) AS count, -1.0::DOUBLE AS retained FROM c
UNION ALL SELECT 2, 'second', s2, round(s2 / s1, 8) FROM c UNION ALL SELECT 3, 'both', s3, round(s3 / s2, 8) FROM c UNION ALL SELECT 4, 'deep', s4, round(s4 / s3, 8) FROM c""")
def _(t):
    from sitewise.operators.joins import replicate_outer_join

    j = replicate_outer_join(*replicates(t), ["k"], ["agcov"], check=False)
    both = F.col("detected_both_replicates")
    deep = F.coalesce("agcov_rep1", F.lit(0)) + F.coalesce("agcov_rep2", F.lit(0)) > 250
    f = A.funnel(j, [("union", F.lit(True)), ("second", F.col("detected_rep2")), ("both", both), ("deep", both & deep)])
    return f.select(F.col("step").cast("long").alias("step"), "stage", "count", F.coalesce("retained_from_previous", F.lit(-1.0)).alias("retained"))


@query("grouped_summary", """
SELECT l_returnflag, CAST(count(*) AS BIGINT) AS sites, CAST(count(DISTINCT l_partkey) AS BIGINT) AS parts, CAST(count(DISTINCT l_suppkey) AS BIGINT) AS suppliers,
  round(avg(l_extendedprice), 4) AS mean, round(stddev_samp(l_extendedprice), 4) AS sd FROM lineitem GROUP BY l_returnflag""")
def _(t):
    s = A.grouped_summary(t("lineitem"), ["l_returnflag"], "l_extendedprice", {"parts": "l_partkey", "suppliers": "l_suppkey"})
    return s.withColumns({"mean": r6(F.col("mean"), 4), "sd": r6(F.col("sd"), 4)})


@query("exact_group_quantiles", """
SELECT l_suppkey % 7 AS g, round(median(l_extendedprice), 4) AS q50, round(quantile_cont(l_extendedprice, 0.9), 4) AS q90, round(quantile_cont(l_extendedprice, 0.05), 4) AS q05
FROM lineitem GROUP BY 1""")
def _(t):
    x = t("lineitem").select((F.col("l_suppkey") % 7).alias("g"), "l_extendedprice")
    q = quantiles(x, ["g"], "l_extendedprice", {"q50": 0.5, "q90": 0.9, "q05": 0.05})
    return q.select("g", *[r6(F.col(c), 4).alias(c) for c in ("q50", "q90", "q05")])


@query("rank_correlations", """
WITH r AS (SELECT l_returnflag AS g, l_quantity AS x, l_extendedprice AS y,
  rank() OVER (PARTITION BY l_returnflag ORDER BY l_quantity) + (count(*) OVER (PARTITION BY l_returnflag, l_quantity) - 1) / 2 AS rx,
  rank() OVER (PARTITION BY l_returnflag ORDER BY l_extendedprice) + (count(*) OVER (PARTITION BY l_returnflag, l_extendedprice) - 1) / 2 AS ry FROM lineitem)
SELECT g, CAST(count(*) AS BIGINT) AS n, round(corr(rx, ry), 6) AS spearman, round(corr(x, y), 6) AS pearson FROM r GROUP BY g""")
def _(t):
    x = t("lineitem").select(F.col("l_returnflag").alias("g"), "l_quantity", "l_extendedprice")
    s = spearman_frame(x, ["g"], "l_quantity", "l_extendedprice")
    p = x.groupBy("g").agg(r6(F.corr("l_quantity", "l_extendedprice")).alias("pearson"))
    return s.join(p, "g").select("g", "n", r6(F.col("spearman")).alias("spearman"), "pearson")


@query("replicate_agreement", """
WITH b AS (SELECT l_discount AS a, l_tax * 1.2 AS b, l_quantity AS d, l_suppkey AS u FROM lineitem), e AS (SELECT quantile_cont(d, [0, 0.25, 0.5, 0.75, 1.0]) AS q FROM b),
s AS (SELECT b.*, unnest(list_filter(['all', 'depth_Q' || (len(list_filter(q[2:4], lambda x: x < d)) + 1), CASE WHEN d >= 30 THEN 'depth_ge_30' END, CASE WHEN d >= 45 THEN 'depth_ge_45' END], lambda z: z IS NOT NULL)) AS subset FROM b, e),
r AS (SELECT *, rank() OVER (PARTITION BY subset ORDER BY a) + (count(*) OVER (PARTITION BY subset, a) - 1) / 2 AS ra,
  rank() OVER (PARTITION BY subset ORDER BY b) + (count(*) OVER (PARTITION BY subset, b) - 1) / 2 AS rb FROM s)
SELECT subset, CAST(count(*) AS BIGINT) AS sites, CAST(count(DISTINCT u) AS BIGINT) AS units, min(d) AS depth_min, round(median(d), 6) AS depth_median, round(avg(abs(a - b)), 6) AS mae,
  round(sqrt(avg((a - b) * (a - b))), 6) AS rmse, round(corr(a, b), 6) AS pearson, round(corr(ra, rb), 6) AS spearman, round(avg(a - b), 6) AS mean_difference FROM r GROUP BY subset""")
def _(t):
    b = t("lineitem").select(F.col("l_discount").alias("a"), (F.col("l_tax") * 1.2).alias("b"), F.col("l_quantity").alias("d"), F.col("l_suppkey").alias("u"))
    g = A.replicate_agreement(b, "a", "b", "d", "u", [30, 45])
    return g.withColumns({c: r6(F.col(c)) for c in ("depth_median", "mae", "rmse", "pearson", "spearman", "mean_difference")})


def _sd(where, v):
    return f"var_samp({v}) FILTER ({where})"


@query("numeric_balance", " UNION ALL ".join(f"""
SELECT '{m}' AS metric, CAST(count({m}) FILTER (l_returnflag = 'A') AS BIGINT) AS n_a, CAST(count({m}) FILTER (l_returnflag = 'R') AS BIGINT) AS n_b,
  round(avg({m}) FILTER (l_returnflag = 'A'), 4) AS mean_a, round(avg({m}) FILTER (l_returnflag = 'R'), 4) AS mean_b,
  round((avg({m}) FILTER (l_returnflag = 'A') - avg({m}) FILTER (l_returnflag = 'R')) / sqrt(((count({m}) FILTER (l_returnflag = 'A') - 1) * var_samp({m}) FILTER (l_returnflag = 'A')
    + (count({m}) FILTER (l_returnflag = 'R') - 1) * var_samp({m}) FILTER (l_returnflag = 'R')) / (count({m}) FILTER (l_returnflag IN ('A', 'R')) - 2)), 6) AS smd,
  round((avg({m}) FILTER (l_returnflag = 'A') - avg({m}) FILTER (l_returnflag = 'R')) / sqrt((var_samp({m}) FILTER (l_returnflag = 'A') + var_samp({m}) FILTER (l_returnflag = 'R')) / 2), 6) AS smd_average
FROM lineitem""" for m in ("l_quantity", "l_extendedprice", "l_discount")))
def _(t):
    metrics = ["l_quantity", "l_extendedprice", "l_discount"]
    w = A.numeric_balance(t("lineitem"), "l_returnflag", ("A", "R"), metrics)
    v = A.numeric_balance(t("lineitem"), "l_returnflag", ("A", "R"), metrics, "average").select("metric", r6(F.col("smd")).alias("smd_average"))
    return w.join(v, "metric").select("metric", "n_a", "n_b", r6(F.col("mean_a"), 4).alias("mean_a"), r6(F.col("mean_b"), 4).alias("mean_b"), r6(F.col("smd")).alias("smd"), "smd_average")


@query("categorical_balance", """
WITH c AS (SELECT o_orderpriority AS level, count(*) FILTER (o_orderstatus = 'F') AS n_a, count(*) FILTER (o_orderstatus = 'P') AS n_b FROM orders WHERE o_orderstatus IN ('F', 'P') GROUP BY 1),
p AS (SELECT *, n_a / sum(n_a) OVER () AS pa, n_b / sum(n_b) OVER () AS pb FROM c)
SELECT level, CAST(n_a AS BIGINT) AS n_a, CAST(n_b AS BIGINT) AS n_b, round(pa, 6) AS p_a, round(pb, 6) AS p_b, round((pa - pb) / sqrt((pa * (1 - pa) + pb * (1 - pb)) / 2), 6) AS smd FROM p""")
def _(t):
    b = A.categorical_balance(t("orders"), "o_orderstatus", ("F", "P"), ["o_orderpriority"])
    return b.select("level", "n_a", "n_b", *[r6(F.col(c)).alias(c) for c in ("p_a", "p_b", "smd")])


@query("binned_trend", """
WITH e AS (SELECT quantile_cont(o_totalprice, [0, 0.05, 0.1, 0.15, 0.2, 0.25, 0.3, 0.35, 0.4, 0.45, 0.5, 0.55, 0.6, 0.65, 0.7, 0.75, 0.8, 0.85, 0.9, 0.95, 1.0]) AS q FROM orders)
SELECT CAST(bin AS BIGINT) AS bin, CAST(count(*) AS BIGINT) AS sites, CAST(count(DISTINCT o_custkey) AS BIGINT) AS units, round(avg(o_totalprice), 3) AS x_mean, round(avg(y), 4) AS y_mean,
  round(median(y), 4) AS y_median, min(o_totalprice) AS x_min, max(o_totalprice) AS x_max
FROM (SELECT *, o_custkey % 113 AS y, len(list_filter(q[2:20], lambda x: x < o_totalprice)) + 1 AS bin FROM orders, e) GROUP BY bin""")
def _(t):
    o = t("orders").withColumn("y", F.col("o_custkey") % 113)
    b = A.binned_trend(o, "o_totalprice", "y", "o_custkey", 20)
    return b.select(F.col("bin").cast("long").alias("bin"), "sites", "units", r6(F.col("x_mean"), 3).alias("x_mean"), r6(F.col("y_mean"), 4).alias("y_mean"), r6(F.col("y_median"), 4).alias("y_median"), "x_min", "x_max")


_QUARTILES = f"""
WITH {VECTORS_SQL}, o AS (SELECT vec_id, sum(x) AS y FROM (SELECT vec_id, unnest(embedding)::DOUBLE AS x FROM embeddings) GROUP BY vec_id),
e AS (SELECT quantile_cont(y, [0, 0.25, 0.5, 0.75, 1.0]) AS q FROM o), b AS (SELECT vec_id, len(list_filter(q[2:4], lambda x: x < y)) + 1 AS quartile FROM o, e)"""


def _quartile_windows(t):
    y = F.aggregate(F.transform("embedding", lambda x: x.cast("double")), F.lit(0.0), lambda s, x: s + x)
    binned = A.quantile_bin(t("embeddings").select("vec_id", y.alias("y")), "y", 4, "quartile").select("vec_id", F.col("quartile").cast("long").alias("quartile"))
    return vectors(t).join(binned, "vec_id").select("quartile", "label", window_vector(F.col("values"), F.col("c"), 20, 12).alias("w"))


@query("positional_profile", _QUARTILES + """
SELECT CAST(quartile AS BIGINT) AS quartile, CAST(p - c AS BIGINT) AS relative_position, round(avg(v), 7) AS mean, CAST(count(v) AS BIGINT) AS valid_sites, CAST(count(DISTINCT label) AS BIGINT) AS valid_units
FROM vl JOIN b USING (vec_id) WHERE v IS NOT NULL AND p - c BETWEEN -20 AND 20 GROUP BY ALL""")
def _(t):
    p = A.positional_profile(_quartile_windows(t), "quartile", "w", 20, "label")
    return p.select("quartile", F.col("relative_position").cast("long").alias("relative_position"), r6(F.col("mean"), 7).alias("mean"), "valid_sites", "valid_units")


@query("positional_profile_band", _QUARTILES + """,
s AS (SELECT quartile, label, p - c AS rel, sum(v) AS s, count(v) AS n FROM vl JOIN b USING (vec_id) WHERE v IS NOT NULL AND p - c BETWEEN -20 AND 20 GROUP BY ALL),
u AS (SELECT DISTINCT quartile, label FROM s), """ + draws_sql("dr", "u", 8, "quartile || '|' || label", 500) + f""",
m AS (SELECT quartile, rel, rep, sum(c * s) / nullif(sum(c * n), 0) AS m FROM (SELECT quartile, label, rep, {POISSON_COUNT} AS c FROM dr) JOIN s USING (quartile, label) GROUP BY quartile, rel, rep)
SELECT CAST(quartile AS BIGINT) AS quartile, CAST(rel AS BIGINT) AS relative_position, round(quantile_cont(m, 0.025), 7) AS ci_low, round(quantile_cont(m, 0.975), 7) AS ci_high FROM m GROUP BY quartile, rel""")
def _(t):
    p = A.profile_band(_quartile_windows(t), "quartile", "w", 20, "label", 500, 8)
    return p.select("quartile", F.col("relative_position").cast("long").alias("relative_position"), r6(F.col("ci_low"), 7).alias("ci_low"), r6(F.col("ci_high"), 7).alias("ci_high"))


@query("isoform_weighted_means", """
WITH x AS (SELECT l_orderkey, ln(l_extendedprice) AS y, ln(1 + l_discount * 10) AS w FROM lineitem)
SELECT CAST(l_orderkey AS BIGINT) AS site, CAST(count(*) AS BIGINT) AS rows, round(avg(y), 6) AS equal_mean, round(sum(y * greatest(w, 1e-12)) / sum(greatest(w, 1e-12)), 6) AS weighted_mean FROM x GROUP BY l_orderkey""")
def _(t):
    x = t("lineitem").select("l_orderkey", F.ln("l_extendedprice").alias("y"), F.log1p(F.col("l_discount") * 10).alias("w"))
    m = A.isoform_means(x, "l_orderkey", "y", "w")
    return m.select(F.col("l_orderkey").alias("site"), "rows", r6(F.col("equal_mean")).alias("equal_mean"), r6(F.col("weighted_mean")).alias("weighted_mean"))


_PRED = "least(1.0, greatest(0.0, 0.6 * l_quantity / 50 + 0.3 * l_discount * 10 - 0.05))"


def _predicted(t):
    from sitewise.functions.scalars import clip

    return t("lineitem").select("l_returnflag", (F.col("l_quantity") / 50).alias("y"),
                                clip(0.6 * F.col("l_quantity") / 50 + 0.3 * F.col("l_discount") * 10 - 0.05).alias("p"))


@query("regression_metrics", f"""
WITH x AS (SELECT l_returnflag, l_quantity / 50 AS y, {_PRED} AS p FROM lineitem),
r AS (SELECT *, rank() OVER (PARTITION BY l_returnflag ORDER BY y) + (count(*) OVER (PARTITION BY l_returnflag, y) - 1) / 2 AS ry,
  rank() OVER (PARTITION BY l_returnflag ORDER BY round(p, 12)) + (count(*) OVER (PARTITION BY l_returnflag, round(p, 12)) - 1) / 2 AS rp FROM x)
SELECT l_returnflag, CAST(count(*) AS BIGINT) AS n, round(avg(abs(p - y)), 6) AS mae, round(sqrt(avg((p - y) * (p - y))), 6) AS rmse,
  round(1 - sum((p - y) * (p - y)) / (var_pop(y) * count(*)), 6) AS r2, round(corr(ry, rp), 6) AS spearman FROM r GROUP BY l_returnflag""")
def _(t):
    x = _predicted(t).withColumn("p", F.round("p", 12))
    m = A.regression_metrics(x, ["l_returnflag"], "y", "p")
    return m.select("l_returnflag", "n", *[r6(F.col(c)).alias(c) for c in ("mae", "rmse", "r2", "spearman")])


@query("error_diagnostics", f"""
WITH x AS (SELECT l_returnflag, l_quantity / 50 AS y, {_PRED} AS p FROM lineitem)
SELECT l_returnflag, CAST(count(*) AS BIGINT) AS sites, round(avg(p - y), 6) AS mean_signed_error, round(median(abs(p - y)), 6) AS median_absolute_error, round(quantile_cont(abs(p - y), 0.9), 6) AS p90_absolute_error,
  round(stddev_pop(y), 6) AS observed_sd, round(quantile_cont(p, 0.05), 6) AS prediction_q05, round(median(p), 6) AS prediction_median, round(quantile_cont(p, 0.95), 6) AS prediction_q95,
  CAST(count(*) FILTER (p = 0) AS BIGINT) AS at_clip_0_count, CAST(count(*) FILTER (p = 1) AS BIGINT) AS at_clip_1_count FROM x GROUP BY l_returnflag""")
def _(t):
    d = A.error_diagnostics(_predicted(t), ["l_returnflag"], "y", "p")
    cols = ["mean_signed_error", "median_absolute_error", "p90_absolute_error", "observed_sd", "prediction_q05", "prediction_median", "prediction_q95"]
    return d.select("l_returnflag", "sites", *[r6(F.col(c)).alias(c) for c in cols], "at_clip_0_count", "at_clip_1_count")


@query("calibration_table", f"""
WITH x AS (SELECT l_returnflag, l_quantity / 50 AS y, {_PRED} AS p FROM lineitem),
s AS (SELECT l_returnflag, bin_index FROM (SELECT DISTINCT l_returnflag FROM x), range(1, 8) r(bin_index)),
b AS (SELECT l_returnflag, len(list_filter([0.1, 0.3, 0.5, 0.7, 0.9, 1.5], lambda e: e <= p)) + 1 AS bin_index, y, p FROM x)
SELECT s.l_returnflag, CAST(s.bin_index AS BIGINT) AS bin_index, CAST(count(y) AS BIGINT) AS bin_count, round(coalesce(avg(p), -1), 6) AS mean_prediction,
  round(coalesce(avg(y), -1), 6) AS mean_observed, round(coalesce(avg(p - y), -1), 6) AS mean_signed_error
FROM s LEFT JOIN b ON b.l_returnflag = s.l_returnflag AND b.bin_index = s.bin_index GROUP BY ALL""")
def _(t):
    c = A.calibration_table(_predicted(t), ["l_returnflag"], "y", "p", [0.0, 0.1, 0.3, 0.5, 0.7, 0.9, 1.5, 2.0])
    return c.select("l_returnflag", F.col("bin_index").cast("long").alias("bin_index"), F.col("bin_count").cast("long").alias("bin_count"),
                    *[r6(F.coalesce(x, F.lit(-1.0))).alias(x) for x in ("mean_prediction", "mean_observed", "mean_signed_error")])


@query("inverse_variance_pooling", """
WITH s AS (SELECT l_suppkey, avg(l_discount) AS e, stddev_samp(l_discount) / sqrt(count(*)) AS se FROM lineitem GROUP BY l_suppkey),
f AS (SELECT count(*) AS k, sum(1 / (se * se)) AS sw, sum(1 / (se * se * se * se)) AS sww, sum(e / (se * se)) / sum(1 / (se * se)) AS fixed FROM s),
q AS (SELECT k, sw, fixed, sum((e - fixed) * (e - fixed) / (se * se)) AS q, any_value(sw - sww / sw) AS c FROM s, f GROUP BY k, sw, fixed),
h AS (SELECT *, greatest(0.0, (q - (k - 1)) / c) AS tau2 FROM q), r AS (SELECT sum(e / (se * se + tau2)) / sum(1 / (se * se + tau2)) AS est, sqrt(1 / sum(1 / (se * se + tau2))) AS ser FROM s, h)
SELECT 'fixed_effect' AS model, round(fixed, 7) AS estimate, round(sqrt(1 / sw), 7) AS standard_error, round(fixed / sqrt(1 / sw), 4) AS z, round(q, 4) AS q, round(tau2, 8) AS tau2, round(greatest(0, (q - (k - 1)) / q * 100), 4) AS i2 FROM h
UNION ALL SELECT 'random_effect_DL', round(est, 7), round(ser, 7), round(est / ser, 4), round(q, 4), round(tau2, 8), round(greatest(0, (q - (k - 1)) / q * 100), 4) FROM r, h""")
def _(t):
    s = t("lineitem").groupBy("l_suppkey").agg(F.avg("l_discount").alias("e"), (F.stddev_samp("l_discount") / F.sqrt(F.count(F.lit(1)))).alias("se"))
    p = A.inverse_variance_pool(s, "e", "se")
    return p.select("model", r6(F.col("estimate"), 7).alias("estimate"), r6(F.col("standard_error"), 7).alias("standard_error"), r6(F.col("z"), 4).alias("z"),
                    r6(F.col("Q"), 4).alias("q"), r6(F.col("tau2"), 8).alias("tau2"), r6(F.col("I2_percent"), 4).alias("i2"))


@query("overlap_crosstab", """
SELECT CAST(count(*) AS BIGINT) AS rows, CAST(count(*) FILTER (l_quantity > 25) AS BIGINT) AS first, CAST(count(*) FILTER (l_tax > 0.04) AS BIGINT) AS second,
  CAST(count(*) FILTER (l_quantity > 25 AND l_tax > 0.04) AS BIGINT) AS both, CAST(count(*) FILTER (l_quantity > 25 OR l_tax > 0.04) AS BIGINT) AS either,
  CAST(count(*) FILTER (NOT l_quantity > 25 AND NOT l_tax > 0.04) AS BIGINT) AS neither FROM lineitem""")
def _(t):
    return A.overlap_crosstab(t("lineitem").select((F.col("l_quantity") > 25).alias("a"), (F.col("l_tax") > 0.04).alias("b")), ("a", "b"))


@query("unseen_levels", """
WITH tr AS (SELECT DISTINCT CAST(l_partkey AS VARCHAR) AS v FROM lineitem WHERE l_shipdate < TIMESTAMP '1995-06-01'), ts AS (SELECT DISTINCT CAST(l_suppkey AS VARCHAR) AS v FROM lineitem WHERE l_shipdate < TIMESTAMP '1995-06-01')
SELECT 'l_partkey' AS variable, CAST(count(*) FILTER (CAST(l_partkey AS VARCHAR) NOT IN (SELECT v FROM tr)) AS BIGINT) AS unseen_rows,
  CAST(count(DISTINCT CASE WHEN CAST(l_partkey AS VARCHAR) NOT IN (SELECT v FROM tr) THEN l_partkey END) AS BIGINT) AS unseen_levels FROM lineitem WHERE l_shipdate >= TIMESTAMP '1995-06-01'
UNION ALL SELECT 'l_suppkey', CAST(count(*) FILTER (CAST(l_suppkey AS VARCHAR) NOT IN (SELECT v FROM ts)) AS BIGINT),
  CAST(count(DISTINCT CASE WHEN CAST(l_suppkey AS VARCHAR) NOT IN (SELECT v FROM ts) THEN l_suppkey END) AS BIGINT) FROM lineitem WHERE l_shipdate >= TIMESTAMP '1995-06-01'""")
def _(t):
    early = F.col("l_shipdate") < F.lit("1995-06-01").cast("timestamp")
    return A.unseen_levels(t("lineitem").where(early), t("lineitem").where(~early), ["l_partkey", "l_suppkey"])


@query("ratio_stability", """
SELECT l_suppkey % 10 AS track, round(min(n) / max(n), 8) AS stability_ratio, min(n) / max(n) >= 0.95 AS stability_pass
FROM (SELECT l_suppkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY l_suppkey % 10, l_linenumber, l_suppkey) GROUP BY 1""")
def _(t):
    v = t("lineitem").groupBy((F.col("l_suppkey") % 10).alias("track"), "l_linenumber", "l_suppkey").agg(F.count(F.lit(1)).alias("n"))
    s = A.ratio_stability(v, ["track"], "n", 0.95)
    return s.withColumn("stability_ratio", r6(F.col("stability_ratio"), 8))


@query("metric_deltas", """
WITH m AS (SELECT o_orderpriority AS g, o_orderstatus AS s, avg(o_totalprice) AS v FROM orders GROUP BY 1, 2)
SELECT a.g, a.s || '_vs_' || b.s AS comparison, round(b.v - a.v, 4) AS delta FROM m a JOIN m b ON a.g = b.g WHERE (b.s, a.s) IN (('F', 'O'), ('F', 'P'), ('O', 'P'))""")
def _(t):
    m = t("orders").groupBy(F.col("o_orderpriority").alias("g"), F.col("o_orderstatus").alias("s")).agg(F.avg("o_totalprice").alias("v"))
    return A.delta_table(m, ["g"], "s", "v", [("F", "O"), ("F", "P"), ("O", "P")]).select("g", "comparison", r6(F.col("delta"), 4).alias("delta"))


@query("coverage_summary", f"""
WITH {VECTORS_SQL}, s AS (SELECT vec_id, any_value(label) AS label, any_value(c) AS c, max(v) FILTER (p = c) AS centre, count(v) FILTER (p BETWEEN c - 10 AND c - 1) AS lc, count(v) FILTER (p BETWEEN c + 1 AND c + 10) AS rc FROM vl GROUP BY vec_id),
q AS (SELECT *, c > 10 AND c <= 54 AND lc >= 7 AND rc >= 7 AS ok, CASE WHEN c > 10 AND c <= 54 THEN (lc + rc) / 20 END AS cov FROM s)
SELECT CAST(count(*) AS BIGINT) AS rows, CAST(count(DISTINCT label) AS BIGINT) AS sites, CAST(count(DISTINCT CASE WHEN ok THEN label END) AS BIGINT) AS valid_sites,
  round(count(DISTINCT CASE WHEN ok THEN label END) / count(DISTINCT label), 8) AS site_valid_fraction, CAST(count(*) FILTER (ok) AS BIGINT) AS valid_rows, round(avg(ok::INT), 8) AS row_valid_fraction,
  CAST(count(centre) AS BIGINT) AS centre_available_rows, round(avg(cov), 8) AS mean_coverage, round(median(cov), 8) AS median_coverage FROM q""")
def _(t):
    v, c = F.col("values"), F.col("c").cast("int")
    x = vectors(t).select("label", main_window_valid(v, c, 10, 0.7).alias("ok"), flank_coverage(v, c, 10)[2].alias("cov"), F.get(v, c - 1).alias("centre"))
    return A.coverage_summary(x, "label", "cov", "ok", "centre")


@query("field_audit", " UNION ALL ".join(f"""
SELECT '{f}' AS field, round(min(v), 6) AS minimum, round(median(v), 6) AS median, round(max(v), 6) AS maximum, CAST(sum(CASE WHEN v IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS missing
FROM (SELECT CASE WHEN {f} > {cut} THEN {f} END AS v FROM orders o JOIN customer c ON o_custkey = c_custkey)""" for f, cut in (("o_totalprice", 5000), ("c_acctbal", 0))))
def _(t):
    j = t("orders").join(t("customer"), F.col("o_custkey") == F.col("c_custkey"))
    x = j.select(*[F.when(F.col(f) > cut, F.col(f)).alias(f) for f, cut in (("o_totalprice", 5000), ("c_acctbal", 0))])
    a = A.field_audit(x, ["o_totalprice", "c_acctbal"])
    return a.select("field", *[r6(F.col(c)).alias(c) for c in ("minimum", "median", "maximum")], "missing")


@query("low_n_description", """
WITH v AS (SELECT s_nationkey % 5 AS k, s_acctbal AS x, CASE WHEN s_suppkey % 7 > 0 THEN s_suppkey * s_suppkey % 1009 / 10 END AS y FROM supplier),
b AS (SELECT * FROM v WHERE x IS NOT NULL AND y IS NOT NULL),
r AS (SELECT k, rank() OVER (PARTITION BY k ORDER BY x) + (count(*) OVER (PARTITION BY k, x) - 1) / 2 AS rx, rank() OVER (PARTITION BY k ORDER BY y) + (count(*) OVER (PARTITION BY k, y) - 1) / 2 AS ry FROM b),
c AS (SELECT k, corr(rx, ry) AS rho FROM r GROUP BY k)
SELECT CAST(v.k AS BIGINT) AS k, CAST(count(*) AS BIGINT) AS n, round(median(x), 6) AS median_x, round(median(y), 6) AS median_y, round(any_value(rho), 6) AS spearman_rho,
       'DESCRIPTIVE_ONLY_LOW_N' AS analysis_role, false AS inferential_p_value_reported FROM v JOIN c ON v.k = c.k GROUP BY v.k""")
def _(t):
    v = t("supplier").select((F.col("s_nationkey") % 5).cast("long").alias("k"), F.col("s_acctbal").alias("x"),
                             F.when(F.col("s_suppkey") % 7 > 0, F.col("s_suppkey") * F.col("s_suppkey") % 1009 / 10).alias("y"))
    d = A.low_n_description(v, "x", "y", ["k"])
    return d.select("k", "n", *[r6(F.col(c)).alias(c) for c in ("median_x", "median_y", "spearman_rho")], "analysis_role", "inferential_p_value_reported")
