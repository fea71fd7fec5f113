"""Clustered regression, resampling, rank tests and their families."""

from pyspark.sql import functions as F

from sitewise.catalog.registry import query
from sitewise.catalog.standins import POISSON_COUNT, draws_sql, median_sql, r6
from sitewise.operators import inference as N
from sitewise.operators import resample as B
from sitewise.operators.aggregates import group_size
from sitewise.operators.linear import Design, fit_ols, rows_frame
from sitewise.operators.models import baseline_predictions
from sitewise.operators.ordering import spearman_frame
from sitewise.operators.variants import Variant, variant_fits
from sitewise.plans.association import AssociationParams, coefficient_bootstrap, run_association

# Outcome, predictor and covariates used throughout: scaled price on quantity, clusters are suppliers.
_D = "d AS (SELECT l_suppkey AS g, l_extendedprice / 100000 AS y, l_quantity / 50 AS x, l_discount AS z, l_returnflag AS s FROM lineitem)"


# Draws of the published analyses.
_REPS, _MEAN_REPS, _ERROR_REPS, _MEDIAN_REPS, _FLIPS = 500, 1000, 2000, 5000, 10_000


def _frame(t):
    return t("lineitem").select(F.col("l_suppkey").alias("g"), (F.col("l_extendedprice") / 100000).alias("y"), (F.col("l_quantity") / 50).alias("x"),
                                F.col("l_discount").alias("z"), F.col("l_tax").alias("w"), F.col("l_returnflag").alias("s"),
                                F.col("l_linestatus").alias("ls"), F.when(F.col("l_tax") > 0, F.log1p(F.col("l_tax") * 100)).alias("q"))


def _line(*names):
    return Design(["Intercept", *names], [F.lit(1.0), *[F.col(n) for n in names]])


_FIT = """
f AS (SELECT count(*) AS n, regr_slope(y, x) AS b, regr_intercept(y, x) AS a, avg(x) AS mx, regr_sxx(y, x) AS sxx, regr_r2(y, x) AS r2, stddev_samp(x) AS sd FROM d),
sc AS (SELECT g, sum((x - mx) * (y - a - b * x)) AS s FROM d, f GROUP BY g), m AS (SELECT sum(s * s) AS m, count(*) AS k FROM sc),
se AS (SELECT *, sqrt(m / (sxx * sxx) * k / (k - 1) * (n - 1) / (n - 2)) AS se FROM f, m)"""


@query("clustered_regression", f"""
WITH {_D}, {_FIT} SELECT CAST(n AS BIGINT) AS sites, CAST(k AS BIGINT) AS clusters, round(b, 7) AS beta_raw, round(se, 7) AS se_cluster, round(b / se, 4) AS z, round(b * sd, 7) AS beta_per_sd, round(r2, 7) AS r_squared FROM se""")
def _(t):
    df = _frame(t)
    row, _ = N.associate("primary", df, _line("x"), "y", "x", "g")
    out = rows_frame(t.spark, [row])
    return out.select("sites", "clusters", *[r6(F.col(c), d).alias(c) for c, d in (("beta_raw", 7), ("se_cluster", 7), ("z", 4), ("beta_per_sd", 7), ("r_squared", 7))])


@query("equal_cluster_weight_regression", f"""
WITH {_D}, w AS (SELECT *, 1 / count(*) OVER (PARTITION BY g) AS w FROM d), s AS (SELECT sum(w) AS sw, sum(w * x) / sum(w) AS mx, sum(w * y) / sum(w) AS my, count(*) AS n FROM w),
b AS (SELECT any_value(n) AS n, any_value(mx) AS mx, any_value(my) AS my, sum(w * (x - mx) * (y - my)) / sum(w * (x - mx) * (x - mx)) AS b, sum(w * (x - mx) * (x - mx)) AS sxx FROM w, s),
sc AS (SELECT g, sum(w * (x - mx) * (y - my - b * (x - mx))) AS s FROM w, b GROUP BY g), m AS (SELECT sum(s * s) AS m, count(*) AS k FROM sc)
SELECT round(b, 7) AS beta_raw, round(sqrt(m / (sxx * sxx) * k / (k - 1) * (n - 1) / (n - 2)), 7) AS se_cluster FROM b, m""")
def _(t):
    df = group_size(_frame(t), ["g"], "n_g", many=True)
    row, _ = N.associate("equal_weight", df, _line("x"), "y", "x", "g", 1 / F.col("n_g"))
    return rows_frame(t.spark, [row]).select(r6(F.col("beta_raw"), 7).alias("beta_raw"), r6(F.col("se_cluster"), 7).alias("se_cluster"))


@query("design_statistics", " UNION ALL ".join(f"""
SELECT '{n}' AS variable, round(m, 6) AS median, round(avg(coalesce(v, m)), 8) AS mean, round(stddev_samp(coalesce(v, m)), 8) AS sd
FROM (SELECT {e} AS v, median({e}) OVER () AS m FROM lineitem) GROUP BY m""" for n, e in (("z", "l_discount"), ("q", "CASE WHEN l_tax > 0 THEN ln(1 + l_tax * 100) END"))))
def _(t):
    st = N.design_stats(_frame(t), {"z": F.col("z"), "q": F.col("q")})
    rows = [{"variable": n, "median": m, "mean": a, "sd": s} for n, (m, a, s) in st.items()]
    return rows_frame(t.spark, rows).select("variable", r6(F.col("median")).alias("median"), r6(F.col("mean"), 8).alias("mean"), r6(F.col("sd"), 8).alias("sd"))


@query("adjusted_regression_design")
def _(t):
    df = _frame(t)
    design = N.association_design(df, "x", {"z": F.col("z"), "q": F.col("q")}, ["q"], ["s", "ls"])
    return rows_frame(t.spark, fit_ols(df, design, F.col("y"), "g").coefficient_rows())


def _erfc_tail(z):
    """Two-sided normal p-value by Simpson's rule."""
    return (f"greatest(0, 1 - 2 * abs({z}) / 6000 / sqrt(2 * pi()) * (SELECT sum(CASE WHEN i = 0 OR i = 2000 THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END "
            f"* exp(-0.5 * (abs({z}) * i / 2000) ** 2)) FROM range(2001) r(i)))")


# Populations, outcomes, predictors and weights of the seven variants over line items.
_VARIANTS = (
    ("exclude_centre", "l_discount >= 0.02", "y", "x2", "1"), ("complete_coverage", "l_linenumber <= 3 AND l_tax > 0.01", "y", "x", "1"), ("replicate_1", "true", "y1", "x", "1"),
    ("replicate_2", "true", "y2", "x", "1"), ("equal_weight_per_cluster", "true", "y", "x", "w"), ("single_isoform", "l_linenumber = 1", "y", "x", "1"),
    ("canonical", "l_returnflag <> 'N'", "y", "x", "1"))
_VARIANT_ROWS = """
d0 AS (SELECT *, l_suppkey AS g, CASE WHEN l_orderkey % 9 > 0 THEN l_discount * 10 + (l_partkey % 13) / 13.0::DOUBLE END AS y, CASE WHEN l_orderkey % 5 > 0 THEN l_discount * 10 + (l_partkey % 11) / 11.0::DOUBLE END AS y1,
  l_tax * 10 + (l_partkey % 7) / 70.0::DOUBLE AS y2, l_quantity / 50 AS x, CASE WHEN l_orderkey % 3 > 0 THEN (l_quantity + l_linenumber) / 50 END AS x2, l_extendedprice / 100000 AS z FROM lineitem),
d AS (SELECT *, 1.0::DOUBLE / count(*) OVER (PARTITION BY g) AS w FROM d0)"""


def _variant_frame(t):
    def share(m):
        return (F.col("l_partkey") % m) / F.lit(float(m))

    df = t("lineitem").select(
        F.col("l_suppkey").alias("g"), F.when(F.col("l_orderkey") % 9 > 0, F.col("l_discount") * 10 + share(13)).alias("y"),
        F.when(F.col("l_orderkey") % 5 > 0, F.col("l_discount") * 10 + share(11)).alias("y1"), (F.col("l_tax") * 10 + share(7) / 10).alias("y2"), (F.col("l_quantity") / 50).alias("x"),
        F.when(F.col("l_orderkey") % 3 > 0, (F.col("l_quantity") + F.col("l_linenumber")) / 50).alias("x2"), (F.col("l_extendedprice") / 100000).alias("z"), "l_discount", "l_tax",
        "l_linenumber", "l_returnflag")
    return group_size(df, ["g"], "n_g", many=True)


def _variants():
    return tuple(Variant(n, y, x, None if where == "true" else F.expr(where), 1 / F.col("n_g") if w == "w" else None) for n, where, y, x, w in _VARIANTS)


_VARIANT_SQL = f"""
WITH {_VARIANT_ROWS}, v AS ({" UNION ALL ".join(f"SELECT {i} AS i, '{n}' AS analysis, g, {x} AS x, {y} AS y, z, {w} AS w FROM d WHERE {where} AND {x} IS NOT NULL AND {y} IS NOT NULL" for i, (n, where, y, x, w) in enumerate(_VARIANTS))}),
m AS (SELECT i, any_value(analysis) AS analysis, count(*) AS n, stddev_samp(x) AS sd, sum(w) AS sw, sum(w * x) / sum(w) AS mx, sum(w * y) / sum(w) AS my, sum(w * z) / sum(w) AS mz FROM v GROUP BY i),
c AS (SELECT v.i, sum(w * (z - mz) * (z - mz)) AS zz, sum(w * (z - mz) * (x - mx)) AS zx, sum(w * (z - mz) * (y - my)) AS zy FROM v JOIN m USING (i) GROUP BY v.i),
r AS (SELECT v.i, g, w, x - mx - zx / zz * (z - mz) AS r, y - my - zy / zz * (z - mz) AS q FROM v JOIN m USING (i) JOIN c USING (i)),
b AS (SELECT i, sum(w * r * q) / sum(w * r * r) AS b, sum(w * r * r) AS rr FROM r GROUP BY i),
sc AS (SELECT r.i, g, sum(w * r * (q - b * r)) AS s FROM r JOIN b USING (i) GROUP BY r.i, g), k AS (SELECT i, count(*) AS k, sum(s * s) AS s FROM sc GROUP BY i),
e AS (SELECT m.i, analysis, n, k, b, sqrt(s / (rr * rr) * k / (k - 1) * (n - 1) / (n - 3)) AS se, b * sd AS per_sd FROM m JOIN b USING (i) JOIN k USING (i)),
p AS (SELECT *, {_erfc_tail("b / se")} AS p FROM e)"""


@query("association_variants", f"""{_VARIANT_SQL}, a AS (SELECT *, row_number() OVER (ORDER BY p DESC) AS back, count(*) OVER () AS fits FROM p),
q AS (SELECT *, least(1.0, min(p * fits / (fits - back + 1)) OVER (ORDER BY back)) AS q FROM a)
SELECT analysis, CAST(n AS BIGINT) AS sites, CAST(k AS BIGINT) AS clusters, round(b, 7) AS beta_raw, round(se, 7) AS se_cluster, round(b / se, 4) AS z, round(per_sd, 7) AS beta_per_sd,
       round(p, 7) AS p_value, round(q, 7) AS q_value FROM q""")
def _(t):
    fits = variant_fits(_variant_frame(t), _line("z"), _variants(), "g")
    rows = rows_frame(t.spark, N.family_rows(t("lineitem"), fits))
    return rows.select("analysis", "sites", "clusters", *[r6(F.col(c), 4 if c == "z" else 7).alias(c) for c in ("beta_raw", "se_cluster", "z", "beta_per_sd", "p_value", "q_value")])


@query("association_analysis")
def _(t):
    df = _variant_frame(t).withColumns({"q": F.when(F.col("l_tax") > 0, F.log1p(F.col("l_tax") * 100)), "s": F.col("l_returnflag"), "ls": F.col("l_linenumber") % 2})
    p = AssociationParams("y", "x", "g", {"z": F.col("z"), "q": F.col("q")}, ("q",), ("s",), _MEAN_REPS, 11, "ls", _variants())
    out = run_association(df, p)
    return out["sensitivity"].unionByName(out["primary"], allowMissingColumns=True)


@query("outcome_refits", f"""
WITH {_D} SELECT 'y' AS outcome, round(regr_slope(y, x), 7) AS beta_raw, round(regr_r2(y, x), 7) AS r_squared FROM d
UNION ALL SELECT 'z', round(regr_slope(z, x), 7), round(regr_r2(z, x), 7) FROM d UNION ALL SELECT 'w', round(regr_slope(l_tax, l_quantity / 50), 7), round(regr_r2(l_tax, l_quantity / 50), 7) FROM lineitem""")
def _(t):
    rows = N.outcome_refits(_frame(t), _line("x"), ["y", "z", "w"], "x", "g")
    return rows_frame(t.spark, rows).select("outcome", r6(F.col("beta_raw"), 7).alias("beta_raw"), r6(F.col("r_squared"), 7).alias("r_squared"))


def _two(x, z="l_tax"):
    c = f"covar_pop({x}, y) * var_pop({z}) - covar_pop({z}, y) * covar_pop({x}, {z})"
    return f"round(({c}) / (var_pop({x}) * var_pop({z}) - covar_pop({x}, {z}) * covar_pop({x}, {z})), 7)"


@query("predictor_grid", "WITH e AS (SELECT *, l_extendedprice / 100000 AS y, l_quantity / 50 AS x, l_discount AS z FROM lineitem) " + " UNION ALL ".join(
    f"SELECT 'unadjusted' AS analysis, '{p}' AS predictor, round(regr_slope(y, {p}), 7) AS beta_raw FROM e UNION ALL SELECT 'adjusted', '{p}', {_two(p)} FROM e" for p in ("x", "z")))
def _(t):
    rows = N.predictor_grid(_frame(t), ["x", "z"], "y", "g", {"unadjusted": _line(), "adjusted": _line("w")})
    return rows_frame(t.spark, rows).select("analysis", "predictor", r6(F.col("beta_raw"), 7).alias("beta_raw"))


@query("stratified_fits", f"""
WITH {_D} SELECT 's_' || s AS analysis, CAST(count(*) AS BIGINT) AS sites, round(regr_slope(y, x), 7) AS beta_raw, round(regr_slope(y, x) * stddev_samp(x), 7) AS beta_per_sd FROM d GROUP BY s HAVING count(*) >= 200 AND count(DISTINCT g) >= 5""")
def _(t):
    rows = N.stratified_fits(_frame(t), "s", _line("x"), "y", "x", "g", 200, 5)
    return rows_frame(t.spark, rows).select("analysis", "sites", r6(F.col("beta_raw"), 7).alias("beta_raw"), r6(F.col("beta_per_sd"), 7).alias("beta_per_sd"))


@query("residual_moments", f"""
WITH {_D}, f AS (SELECT regr_slope(y, x) AS b, regr_intercept(y, x) AS a FROM d), e AS (SELECT y - a - b * x AS e, a + b * x AS p FROM d, f), m AS (SELECT avg(e) AS m FROM e),
c AS (SELECT avg((e - m) * (e - m)) AS m2, avg((e - m) ** 3) AS m3, avg((e - m) ** 4) AS m4, count(*) FILTER (p < 0) AS below, count(*) FILTER (p > 1) AS above FROM e, m)
SELECT round(m3 / m2 ** 1.5, 6) AS skewness, round(m4 / (m2 * m2) - 3, 6) AS excess_kurtosis, CAST(below AS BIGINT) AS below, CAST(above AS BIGINT) AS above FROM c""")
def _(t):
    df = _frame(t)
    fit = fit_ols(df, _line("x"), F.col("y"), "g")
    d = N.residual_diagnostics(df, fit, F.col("y"))
    row = {"skewness": d["residual_skewness"], "excess_kurtosis": d["residual_excess_kurtosis"], "below": d["predictions_below"], "above": d["predictions_above"]}
    return rows_frame(t.spark, [row]).select(r6(F.col("skewness")).alias("skewness"), r6(F.col("excess_kurtosis")).alias("excess_kurtosis"), "below", "above")


@query("influence_summary", f"""
WITH {_D}, f AS (SELECT count(*) AS n, regr_slope(y, x) AS b, regr_intercept(y, x) AS a, avg(x) AS mx, regr_sxx(y, x) AS sxx FROM d),
e AS (SELECT n, y - a - b * x AS e, 1.0 / n + (x - mx) * (x - mx) / sxx AS h FROM d, f), s AS (SELECT sum(e * e) / (any_value(n) - 2) AS s2 FROM e),
c AS (SELECT n, e * e * h / (2 * s2 * (1 - h) * (1 - h)) AS c FROM e, s)
SELECT round(max(c), 8) AS max_cooks_distance, CAST(count(*) FILTER (c > 4.0 / n) AS BIGINT) AS influential FROM c""")
def _(t):
    df = _frame(t)
    i = N.influence_summary(df, fit_ols(df, _line("x"), F.col("y"), "g"), F.col("y"))
    return rows_frame(t.spark, [i]).select(r6(F.col("max_cooks_distance"), 8).alias("max_cooks_distance"), F.col("influential_cooks_gt_4_over_n").alias("influential"))


@query("spline_sensitivity")
def _(t):
    df = _frame(t)
    _, curve = N.spline_sensitivity(df, _line("x", "z"), "x", "y", "g", 50)
    return rows_frame(t.spark, curve)


@query("cluster_bootstrap_means", f"""
WITH {_D}, gs AS (SELECT g, sum(y) AS num, count(*) AS den FROM d GROUP BY g),
k AS (SELECT *, row_number() OVER (ORDER BY g) - 1 AS i, count(*) OVER () AS n FROM gs),
dr AS (SELECT rep, ('0x' || substr(md5('5|' || rep || '|' || i), 1, 8))::BIGINT % n AS pick FROM k, range({_MEAN_REPS}) r(rep)),
w AS (SELECT dr.rep, k.* FROM dr JOIN k ON k.i = dr.pick)
SELECT CAST(rep AS BIGINT) AS rep, round(sum(num) / sum(den), 7) AS estimate FROM w GROUP BY rep""")
def _(t):
    b = B.bootstrap_ratio(_frame(t), "g", F.col("y"), F.lit(1.0), _MEAN_REPS, 5, "multinomial")
    return b.select(F.col("rep").cast("long").alias("rep"), r6(F.col("estimate"), 7).alias("estimate"))


_RATIO = f"WITH {_D}, gs AS (SELECT g, sum(y) AS num, count(*) AS den FROM d GROUP BY g), {draws_sql('dr', 'gs', 5, 'g', _ERROR_REPS)}, w AS (SELECT rep, num, den, {POISSON_COUNT} AS c FROM dr)"


@query("poisson_bootstrap_means", f"{_RATIO} SELECT CAST(rep AS BIGINT) AS rep, round(sum(c * num) / sum(c * den), 7) AS estimate FROM w GROUP BY rep")
def _(t):
    b = B.bootstrap_ratio(_frame(t), "g", F.col("y"), F.lit(1.0), _ERROR_REPS, 5)
    return b.select(F.col("rep").cast("long").alias("rep"), r6(F.col("estimate"), 7).alias("estimate"))


# One outcome in five is missing and one cluster has no key: the rule is that rows without a value take no part and a null key is a cluster.
_GAPS = "d AS (SELECT nullif(l_suppkey, 3) AS g, CASE WHEN l_orderkey % 5 > 0 THEN l_extendedprice / 100000 END AS y, CASE WHEN l_linenumber % 4 > 0 THEN l_quantity / 50 END AS x FROM lineitem)"


def _gapped(t):
    return t("lineitem").select(F.nullif("l_suppkey", F.lit(3)).alias("g"), F.when(F.col("l_orderkey") % 5 > 0, F.col("l_extendedprice") / 100000).alias("y"),
                                F.when(F.col("l_linenumber") % 4 > 0, F.col("l_quantity") / 50).alias("x"))


@query("bootstrap_slope_with_gaps", f"""
WITH {_GAPS}, gs AS (SELECT coalesce(g::VARCHAR, '~') AS g, count(*) AS k0, sum(x) AS sx, sum(y) AS sy, sum(x * x) AS sxx, sum(x * y) AS sxy FROM d WHERE x IS NOT NULL AND y IS NOT NULL GROUP BY 1),
{draws_sql("dr", "gs", 21, "g", _MEAN_REPS)}, w AS (SELECT rep, k0, sx, sy, sxx, sxy, {POISSON_COUNT} AS c FROM dr)
SELECT CAST(rep AS BIGINT) AS rep, round((sum(c * sxy) - sum(c * sx) * sum(c * sy) / sum(c * k0)) / (sum(c * sxx) - sum(c * sx) * sum(c * sx) / sum(c * k0)), 6) AS beta FROM w GROUP BY rep""")
def _(t):
    r = coefficient_bootstrap(_gapped(t), {"b": _line("x")}, "y", {"b": "x"}, "g", _MEAN_REPS, 21)
    return r.select(F.col("rep").cast("long").alias("rep"), r6(F.col("b")).alias("beta"))


@query("sign_flip_with_gaps", f"""
WITH {_GAPS}, v AS (SELECT coalesce(g::VARCHAR, '~') AS g, y - x - 0.02 AS e FROM d), gs AS (SELECT g, sum(e) AS s, count(*) AS n FROM v WHERE e IS NOT NULL GROUP BY g),
o AS (SELECT sum(s) / sum(n) AS m, sum(n) AS n FROM gs), {draws_sql("dr", "gs", 23, "g", _MEAN_REPS)}, r AS (SELECT rep, sum(CASE WHEN h & 1 = 0 THEN s ELSE -s END) AS t FROM dr GROUP BY rep)
SELECT round(any_value(m), 7) AS mean, CAST(count(*) FILTER (abs(t / n) >= abs(m) * (1 - 1e-12)) AS BIGINT) AS exceed, CAST(count(*) AS BIGINT) AS replicates FROM r, o""")
def _(t):
    s = B.sign_flip_test(_gapped(t), "g", F.col("y") - F.col("x") - 0.02, _MEAN_REPS, 23)
    return s.select(r6(F.col("mean"), 7).alias("mean"), "exceed", "replicates")


@query("paired_errors_with_gaps", f"""
WITH {_GAPS}, gs AS (SELECT coalesce(g::VARCHAR, '~') AS g, sum(abs(y - 0.5)) AS e0, sum(abs(y - x)) AS e1, count(*) AS n1 FROM d WHERE x IS NOT NULL AND y IS NOT NULL GROUP BY 1),
{draws_sql("dr", "gs", 25, "g", _MEAN_REPS)}, w AS (SELECT rep, e0, e1, n1, {POISSON_COUNT} AS c FROM dr)
SELECT CAST(rep AS BIGINT) AS rep, 'x_vs_m0' AS comparison, round((sum(c * e0) - sum(c * e1)) / sum(c * n1), 7) AS delta_mae FROM w GROUP BY rep""")
def _(t):
    b = B.paired_error_bootstrap(_gapped(t).withColumn("m0", F.lit(0.5)), "g", "y", ["m0", "x"], [("m0", "x")], _MEAN_REPS, 25)
    return b.select(F.col("rep").cast("long").alias("rep"), "comparison", r6(F.col("delta_mae"), 7).alias("delta_mae"))


@query("bootstrap_percentile_interval", f"""{_RATIO}, e AS (SELECT rep, sum(c * num) / sum(c * den) AS e FROM w GROUP BY rep)
SELECT CAST(count(*) AS BIGINT) AS replicates, round(quantile_cont(e, 0.025), 7) AS ci_low, round(quantile_cont(e, 0.975), 7) AS ci_high FROM e""")
def _(t):
    ci = B.percentile_interval(B.bootstrap_ratio(_frame(t), "g", F.col("y"), F.lit(1.0), _ERROR_REPS, 5), [], "estimate")
    return ci.select("replicates", r6(F.col("ci_low"), 7).alias("ci_low"), r6(F.col("ci_high"), 7).alias("ci_high"))


_GRAM = "count(*) AS k0, sum(x) AS sx, sum(z) AS sz, sum(y) AS sy, sum(x * x) AS sxx, sum(z * z) AS szz, sum(x * y) AS sxy, sum(z * y) AS szy"


@query("bootstrap_coefficient_difference", f"""
WITH {_D}, gs AS (SELECT g, {_GRAM} FROM d GROUP BY g), {draws_sql("dr", "gs", 9, "g", _REPS)}, w AS (SELECT *, {POISSON_COUNT} AS c FROM dr),
s AS (SELECT rep, sum(c * k0) AS k, sum(c * sx) AS sx, sum(c * sz) AS sz, sum(c * sy) AS sy, sum(c * sxx) AS sxx, sum(c * szz) AS szz, sum(c * sxy) AS sxy, sum(c * szy) AS szy FROM w GROUP BY rep),
b AS (SELECT rep, (sxy - sx * sy / k) / (sxx - sx * sx / k) AS bx, (szy - sz * sy / k) / (szz - sz * sz / k) AS bz FROM s)
SELECT CAST(rep AS BIGINT) AS rep, round(bx, 6) AS beta_x, round(bx - bz, 6) AS difference FROM b""")
def _(t):
    r = coefficient_bootstrap(_frame(t), {"bx": _line("x"), "bz": _line("z")}, "y", {"bx": "x", "bz": "z"}, "g", _REPS, 9)
    return r.select(F.col("rep").cast("long").alias("rep"), r6(F.col("bx")).alias("beta_x"), r6(F.col("bx") - F.col("bz")).alias("difference"))


@query("paired_error_bootstrap", f"""
WITH {_D}, gs AS (SELECT g, sum(abs(y - 0.5)) AS e0, sum(abs(y - x)) AS e1, sum(abs(y - (0.3 + z))) AS e2, count(*) AS n1 FROM d GROUP BY g), {draws_sql("dr", "gs", 3, "g", _ERROR_REPS)},
w AS (SELECT rep, sum(c * e0) AS e0, sum(c * e1) AS e1, sum(c * e2) AS e2, sum(c * n1) AS n1 FROM (SELECT *, {POISSON_COUNT} AS c FROM dr) GROUP BY rep)
SELECT CAST(rep AS BIGINT) AS rep, 'm1_vs_m0' AS comparison, round((e0 - e1) / n1, 7) AS delta_mae FROM w UNION ALL SELECT CAST(rep AS BIGINT), 'm2_vs_m0', round((e0 - e2) / n1, 7) FROM w""")
def _(t):
    df = _frame(t).withColumns({"m0": F.lit(0.5), "m1": F.col("x"), "m2": 0.3 + F.col("z")})
    b = B.paired_error_bootstrap(df, "g", "y", ["m0", "m1", "m2"], [("m0", "m1"), ("m0", "m2")], _ERROR_REPS, 3)
    return b.select(F.col("rep").cast("long").alias("rep"), "comparison", r6(F.col("delta_mae"), 7).alias("delta_mae"))


@query("sign_flip_test", f"""
WITH {_D}, gs AS (SELECT g, sum(y - x - 0.02) AS s, count(*) AS n FROM d GROUP BY g), o AS (SELECT sum(s) / sum(n) AS m, sum(n) AS n FROM gs),
{draws_sql("dr", "gs", 17, "g", _FLIPS)}, r AS (SELECT rep, sum(CASE WHEN h & 1 = 0 THEN s ELSE -s END) AS t FROM dr GROUP BY rep)
SELECT round(any_value(m), 7) AS mean, CAST(count(*) FILTER (abs(t / n) >= abs(m) * (1 - 1e-12)) AS BIGINT) AS exceed, CAST(count(*) AS BIGINT) AS replicates,
  round((count(*) FILTER (abs(t / n) >= abs(m) * (1 - 1e-12)) + 1) / (count(*) + 1), 8) AS p_value FROM r, o""")
def _(t):
    s = B.sign_flip_test(_frame(t), "g", F.col("y") - F.col("x") - 0.02, _FLIPS, 17)
    return s.select(r6(F.col("mean"), 7).alias("mean"), "exceed", "replicates", r6(F.col("p_value"), 8).alias("p_value"))


@query("bootstrap_median", f"""
WITH ev AS (SELECT value::DOUBLE AS v FROM events WHERE value IS NOT NULL), {median_sql("ev", 4, _MEDIAN_REPS)}
SELECT CAST(rep AS BIGINT) AS rep, round(estimate, 6) AS estimate FROM med""")
def _(t):
    b = B.bootstrap_median(t("events"), "value", _MEDIAN_REPS, 4)
    return b.select(F.col("rep").cast("long").alias("rep"), r6(F.col("estimate")).alias("estimate"))


_WILCOXON = """
n AS (SELECT e, d, abs(d) AS a FROM v WHERE d <> 0), r AS (SELECT e, d, a, rank() OVER (PARTITION BY e ORDER BY a) + (count(*) OVER (PARTITION BY e, a) - 1) / 2 AS rk FROM n),
ti AS (SELECT e, sum(c * c * c - c) AS t FROM (SELECT e, a, CAST(count(*) AS DOUBLE) AS c FROM n GROUP BY e, a) GROUP BY e),
wx AS (SELECT e, count(*) AS n, sum(CASE WHEN d > 0 THEN rk ELSE 0 END) AS wp, sum(CASE WHEN d < 0 THEN rk ELSE 0 END) AS wm FROM r GROUP BY e),
z AS (SELECT wx.*, least(wp, wm) AS s, (least(wp, wm) - CAST(n AS DOUBLE) * (n + 1) / 4) / sqrt(CAST(n AS DOUBLE) * (n + 1) * (2 * n + 1) / 24 - t / 48) AS z FROM wx JOIN ti ON wx.e = ti.e)"""


@query("wilcoxon_signed_rank", f"""
WITH v AS (SELECT event_type AS e, CAST(floor((round(value * 100) - 4500 - (user_id % 10) * 100) / 10) AS DOUBLE) AS d FROM events), {_WILCOXON}
SELECT e AS event_type, CAST(n AS BIGINT) AS n, round(wp, 2) AS w_plus, round(wm, 2) AS w_minus, round(s, 2) AS statistic, round(z, 6) AS z FROM z""")
def _(t):
    v = t("events").select("event_type", F.floor((F.round(F.col("value") * 100) - 4500 - (F.col("user_id") % 10) * 100) / 10).cast("double").alias("d"))
    w = N.wilcoxon_signed_rank(v, "d", ["event_type"])
    return w.select("event_type", "n", *[r6(F.col(c), 2).alias(c) for c in ("w_plus", "w_minus", "statistic")], r6(F.col("z")).alias("z"))


@query("binomial_sign_test", """
SELECT CAST(count(*) FILTER (value <> 50) AS BIGINT) AS n, CAST(count(*) FILTER (value < 50) AS BIGINT) AS lower, round(count(*) FILTER (value < 50) / count(*) FILTER (value <> 50), 8) AS fraction_lower FROM events""")
def _(t):
    row = N.binomial_sign_test(t("events").withColumn("d", F.col("value") - 50), "d")
    return rows_frame(t.spark, [row]).select("n", "lower", r6(F.col("fraction_lower"), 8).alias("fraction_lower"))


@query("paired_shift_endpoints", f"""
WITH p AS (SELECT l_partkey AS k, avg(l_quantity) FILTER (l_returnflag = 'R') - avg(l_quantity) FILTER (l_returnflag = 'A') AS dq, avg(l_discount) FILTER (l_returnflag = 'R') - avg(l_discount) FILTER (l_returnflag = 'A') AS dd FROM lineitem GROUP BY 1),
v AS (SELECT 'dq' AS e, round(dq, 6) AS d FROM p WHERE dq IS NOT NULL UNION ALL SELECT 'dd', round(dd, 6) FROM p WHERE dd IS NOT NULL), {_WILCOXON},
m AS (SELECT e, count(*) AS n, median(d) AS md, avg(d) AS mn, stddev_samp(d) AS sd FROM v GROUP BY e),
v0 AS (SELECT d AS v FROM v WHERE e = 'dq'), v1 AS (SELECT d AS v FROM v WHERE e = 'dd'), {median_sql("v0", 5, _MEDIAN_REPS, "m0")}, {median_sql("v1", 6, _MEDIAN_REPS, "m1")},
ci AS (SELECT 'dq' AS e, quantile_cont(estimate, 0.025) AS lo, quantile_cont(estimate, 0.975) AS hi FROM m0med UNION ALL SELECT 'dd', quantile_cont(estimate, 0.025), quantile_cont(estimate, 0.975) FROM m1med),
k0 AS (SELECT k, round(dq, 6) AS s FROM p WHERE dq IS NOT NULL), k1 AS (SELECT k, round(dd, 6) AS s FROM p WHERE dd IS NOT NULL), {draws_sql("f0", "k0", 105, "k", _MEDIAN_REPS)}, {draws_sql("f1", "k1", 106, "k", _MEDIAN_REPS)},
fr AS (SELECT 'dq' AS e, rep, sum(CASE WHEN h & 1 = 0 THEN s ELSE -s END) AS t FROM f0 GROUP BY rep UNION ALL SELECT 'dd', rep, sum(CASE WHEN h & 1 = 0 THEN s ELSE -s END) FROM f1 GROUP BY rep),
fp AS (SELECT fr.e, (count(*) FILTER (abs(t / n) >= abs(mn) * (1 - 1e-12)) + 1) / (count(*) + 1) AS p FROM fr JOIN m USING (e) GROUP BY fr.e)
SELECT m.e AS endpoint, CAST(m.n AS BIGINT) AS n, round(md, 6) AS paired_median_shift, round(mn, 6) AS paired_mean_shift, round(sd, 6) AS paired_sd, round(s, 2) AS wilcoxon_statistic,
       round(z, 6) AS wilcoxon_z, round(lo, 6) AS bootstrap_ci95_low, round(hi, 6) AS bootstrap_ci95_high, NOT (lo <= 0 AND 0 <= hi) AS ci_excludes_zero, round(fp.p, 8) AS sign_flip_mean_p
FROM m JOIN z ON m.e = z.e JOIN ci ON ci.e = m.e JOIN fp ON fp.e = m.e""")
def _(t):
    def arm(c, f):
        return F.avg(F.when(F.col("l_returnflag") == f, F.col(c)))

    p = t("lineitem").groupBy(F.col("l_partkey").alias("k")).agg(
        F.round(arm("l_quantity", "R") - arm("l_quantity", "A"), 6).alias("dq"), F.round(arm("l_discount", "R") - arm("l_discount", "A"), 6).alias("dd"))
    rows = N.paired_endpoints(p, "k", ["dq", "dd"], _MEDIAN_REPS, 5)
    return rows_frame(t.spark, rows).select("endpoint", "n", *[r6(F.col(c)).alias(c) for c in ("paired_median_shift", "paired_mean_shift", "paired_sd", "wilcoxon_z", "bootstrap_ci95_low", "bootstrap_ci95_high")],
                                            r6(F.col("wilcoxon_statistic"), 2).alias("wilcoxon_statistic"), "ci_excludes_zero", r6(F.col("sign_flip_mean_p"), 8).alias("sign_flip_mean_p"))


@query("isoform_estimands", """
WITH v AS (SELECT l_orderkey AS k, l_discount AS w, l_quantity AS x, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS rk, count(*) OVER (PARTITION BY l_orderkey) AS n FROM lineitem)
SELECT 'deterministic_representative' AS estimand, CAST(count(*) AS BIGINT) AS sites, round(avg(x), 6) AS mean FROM v WHERE rk = 1 UNION ALL SELECT 'single_isoform_sites', CAST(count(*) AS BIGINT), round(avg(x), 6) FROM v WHERE n = 1
UNION ALL SELECT 'isoform_equal_weight', CAST(count(*) AS BIGINT), round(avg(m), 6) FROM (SELECT k, avg(x) AS m FROM v GROUP BY k)
UNION ALL SELECT 'coverage_weight', CAST(count(*) AS BIGINT), round(avg(m), 6) FROM (SELECT k, sum(x * greatest(w, 1e-12)) / sum(greatest(w, 1e-12)) AS m FROM v GROUP BY k)""")
def _(t):
    from sitewise.operators.aggregates import isoform_means
    from sitewise.operators.windows import representative
    from sitewise.sources.writers import concat_rows

    li = t("lineitem")
    rep = representative(li, ["l_orderkey"], [F.col(c) for c in ("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")]) \
        .select("l_orderkey", F.col("l_quantity").alias("x"), "group_size")
    means = isoform_means(li, "l_orderkey", "l_quantity", "l_discount")
    x = concat_rows([rep.select("x"), rep.where("group_size = 1").select("x"), means.select(F.col("equal_mean").alias("x")), means.select(F.col("weighted_mean").alias("x"))],
                    "estimand", ["deterministic_representative", "single_isoform_sites", "isoform_equal_weight", "coverage_weight"])
    return x.groupBy("estimand").agg(F.count(F.lit(1)).alias("sites"), r6(F.avg("x")).alias("mean"))


@query("cross_technology_comparison", f"""
WITH {_D}, r AS (SELECT rank() OVER (ORDER BY y) + (count(*) OVER (PARTITION BY y) - 1) / 2 AS ry, rank() OVER (ORDER BY z) + (count(*) OVER (PARTITION BY z) - 1) / 2 AS rz FROM d), c AS (SELECT round(corr(ry, rz), 6) AS rho FROM r)
SELECT 'y' AS outcome, round(regr_slope(y, x), 7) AS beta_raw, any_value(rho) AS outcome_spearman FROM d, c UNION ALL SELECT 'z', round(regr_slope(z, x), 7), any_value(rho) FROM d, c""")
def _(t):
    df = _frame(t)
    rho = spearman_frame(df, [], "y", "z").select("spearman").scalar()
    rows = rows_frame(t.spark, N.outcome_refits(df, _line("x"), ["y", "z"], "x", "g"))
    return rows.select("outcome", r6(F.col("beta_raw"), 7).alias("beta_raw"), r6(rho).alias("outcome_spearman"))


@query("constant_baselines", """
WITH d AS (SELECT l_returnflag AS f, l_quantity / 50 AS y FROM lineitem), m AS (SELECT median(y) FILTER (f = 'A') AS a, median(y) FILTER (f <> 'A') AS b FROM d)
SELECT CAST(count(*) AS BIGINT) AS n, round(any_value(a), 6) AS train_median, round(any_value(b), 6) AS oracle_median, round(avg(abs(y - a)), 6) AS mae_train, round(avg(abs(y - b)), 6) AS mae_oracle FROM d, m WHERE f <> 'A'""")
def _(t):
    d = t("lineitem").select(F.col("l_returnflag").alias("f"), (F.col("l_quantity") / 50).alias("y"))
    b = baseline_predictions(d.where("f = 'A'"), d.where("f <> 'A'"), "y")
    return b.agg(F.count(F.lit(1)).alias("n"), r6(F.max("prediction_train_median")).alias("train_median"), r6(F.max("prediction_oracle_median")).alias("oracle_median"),
                 r6(F.avg(F.abs(F.col("y") - F.col("prediction_train_median")))).alias("mae_train"), r6(F.avg(F.abs(F.col("y") - F.col("prediction_oracle_median")))).alias("mae_oracle"))
