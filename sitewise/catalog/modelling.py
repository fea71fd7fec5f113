"""Encoders, grouped validation, transfer and importance over whole texts."""

from pyspark.sql import functions as F

from sitewise.catalog.registry import query
from sitewise.catalog.standins import POISSON_COUNT, VECTORS_SQL, draws_sql, r6, vectors
from sitewise.functions.sequences import to_acgt
from sitewise.functions.vectors import valid_mean
from sitewise.operators import models as M
from sitewise.operators.encoding import FeatureSpec, fit_encoder, raw_features
from sitewise.operators.groups import joint_groups
from sitewise.operators.linear import gram_arrays, rows_frame
from sitewise.operators.ordering import medians
from sitewise.plans import prediction as P
from sitewise.session import checkpointed

# Penalty grids of the published analyses.
ALPHAS = [0.01, 0.1, 1.0, 10.0, 30.0, 100.0, 300.0, 1000.0, 3000.0]
NESTED_ALPHAS = [0.1, 1.0, 10.0, 100.0]
LADDER = P.MODEL_BLOCKS
ELEMENTS = 64


def _letters(c):
    return F.length(F.regexp_replace("text", f"[^{c}]", "")) / F.greatest(F.length("text"), F.lit(1))


def _frame(t):
    """One row per document: letter shares as outcomes, text and vector features, a joint group."""
    n = t("embeddings").agg(F.count(F.lit(1)).alias("n")).scalar()
    d = t("documents").select(
        "doc_id", "lang", F.col("n_chars").cast("double").alias("n_chars"), F.concat(F.lit("n"), F.floor(F.col("doc_id") / 4).cast("string")).alias("node"),
        F.sha2("text", 256).alias("text_key"), to_acgt(F.col("text")).alias("seq"), (_letters("e") * 4).alias("y"), (_letters("a") * 4).alias("y2"),
        F.when(F.col("doc_id") % 7 != 0, F.log1p(F.col("n_chars"))).alias("size"), (F.col("doc_id") % n).alias("vec_id"))
    v = t("embeddings").select("vec_id", F.transform("embedding", lambda x: F.when(x > -0.1, x.cast("double"))).alias("v"))
    return d.join(v, "vec_id").withColumns({"v_mean": valid_mean("v", None), "profile": F.col("v"), "guess": F.log1p(F.length(F.regexp_replace("seq", "[AT]", "")))})


def _grouped(t):
    return checkpointed(joint_groups(_frame(t), "node", "text_key"))


def _spec(**kw):
    return FeatureSpec(numeric={"size": F.col("size")}, flagged=("size",), categorical=("lang",), sequence="seq",
                       dense={"P": {"guess": F.col("guess")}, "R": {"v_mean": F.col("v_mean")}}, **kw)


@query("encoder_statistics", """
WITH x AS (SELECT l_quantity / 50 AS q, CASE WHEN l_tax > 0 THEN l_tax END AS w FROM lineitem), m AS (SELECT median(q) AS mq, median(w) AS mw FROM x)
SELECT 'C:q' AS feature, round(1 / stddev_pop(coalesce(q, mq)), 6) AS weight, round(-avg(coalesce(q, mq)) / stddev_pop(coalesce(q, mq)), 6) AS shift FROM x, m
UNION ALL SELECT 'C:w', round(1 / stddev_pop(coalesce(w, mw)), 6), round(-avg(coalesce(w, mw)) / stddev_pop(coalesce(w, mw)), 6) FROM x, m""")
def _(t):
    x = t("lineitem").select((F.col("l_quantity") / 50).alias("q"), F.when(F.col("l_tax") > 0, F.col("l_tax")).alias("w"))
    spec = FeatureSpec(numeric={"q": F.col("q"), "w": F.col("w")})
    rows, layout, _ = raw_features(x, spec)
    p = len(layout.names)
    cross = gram_arrays(rows.select(F.concat(F.array(F.lit(1.0)), "raw").alias("_v")), "_v", p + 1)[None]
    med = {f"C:{r['variable']}": r["median"] for r in medians(x, [], ["q", "w"]).collect()}
    enc = fit_encoder(cross, layout, med)
    out = [{"feature": n, "weight": float(enc.weights[layout.names.index(n), i]), "shift": float(enc.offset[i])} for i, n in enumerate(enc.names)]
    return rows_frame(t.spark, out).select("feature", r6(F.col("weight")).alias("weight"), r6(F.col("shift")).alias("shift"))


@query("masked_block_scaler", f"""
WITH {VECTORS_SQL}, m AS (SELECT p, median(v) AS md FROM vl GROUP BY p), f AS (SELECT vec_id, vl.p, v, coalesce(v, md) AS x FROM vl JOIN m ON m.p = vl.p),
s AS (SELECT p, avg(x) AS a, stddev_pop(x) AS sd FROM f GROUP BY p)
SELECT CAST(vec_id AS BIGINT) AS vec_id, 'R:p' || (f.p - 1) AS feature, round((x - a) / sd, 6) AS value FROM f JOIN s ON s.p = f.p
UNION ALL SELECT CAST(vec_id AS BIGINT), 'R:missing_p' || (p - 1), CASE WHEN v IS NULL THEN 1.0 ELSE 0.0 END FROM f""")
def _(t):
    block = vectors(t).select("vec_id", F.col("values").alias("r"))
    names = [f"p{i}" for i in range(ELEMENTS)]
    rows, layout, _ = raw_features(block, FeatureSpec(arrays={"R": (F.col("r"), names)}, masked=("R",)))
    cross = gram_arrays(rows.select(F.concat(F.array(F.lit(1.0)), "raw").alias("_v")), "_v", len(layout.names) + 1)[None]
    wide = block.select(*[F.get("r", F.lit(i)).alias(n) for i, n in enumerate(names)])
    enc = fit_encoder(cross, layout, {f"R:{r['variable']}": r["median"] for r in medians(wide, [], names).collect()})
    return enc.apply(rows, "raw", "vec_id").withColumn("value", r6(F.col("value")))


@query("grouped_cv_ridge_grid")
def _(t):
    rows, _ = M.grid_cv(M.prepare(_grouped(t), _spec(), ["y"], "joint_group", 5), LADDER, ALPHAS)
    return rows_frame(t.spark, rows)


@query("block_comparison_cv")
def _(t):
    names = [f"p{i}" for i in range(ELEMENTS)]
    spec = FeatureSpec(
        numeric={"size": F.col("size")}, flagged=("size",), categorical=("lang",), sequence="seq",
        dense={"R_core": {"v_mean": F.col("v_mean")},
               "R_directional": {"up": valid_mean(F.slice("v", 1, ELEMENTS // 2), None), "down": valid_mean(F.slice("v", ELEMENTS // 2 + 1, ELEMENTS // 2), None)}},
        arrays={"R_profile": (F.col("profile"), names)}, masked=("R_profile",))
    models = {"R_none": ("C", "X"), **{b: ("C", "X", b) for b in ("R_core", "R_directional", "R_profile")}}
    _, picked = M.grid_cv(M.prepare(_grouped(t), spec, ["y"], "joint_group", 5), models, ALPHAS, label="block")
    base = picked["R_none"]["mae"]
    return rows_frame(t.spark, [{"block": b, "alpha": r["alpha"], "mae": r["mae"], "delta_mae": base - r["mae"]} for b, r in picked.items()])


@query("held_out_evaluation")
def _(t):
    df = P.assign_groups(_frame(t), "node", "text_key", 0.2, 42)
    out, _, _ = P.train_and_test(checkpointed(df), _spec(), "y", LADDER, ALPHAS, 5, 2000, 7, ["text_key"], reject_boundary=False)
    return out["test_metrics"].withColumn("leaks", out["leakage"].agg(F.sum("overlap").alias("n")).scalar())


@query("frozen_model_transfer")
def _(t):
    df = _grouped(t).withColumn("other", F.col("lang").isin("de", "es"))
    dev = df.where("not other")
    prep = M.prepare(dev, _spec(), ["y"], "joint_group", 5)
    fitted = [M.final_fit(prep, m, LADDER[m], 10.0) for m in LADDER]
    metrics, rows = P.transfer(df.where("other"), dev, prep, fitted, "y", ["node", "text_key"])
    boot = P.transfer_contrasts(checkpointed(rows.select("joint_group", "strict", "y", *[f"prediction_{m}" for m in LADDER])), fitted, "y", 2000, 7)
    return metrics.unionByName(boot, allowMissingColumns=True)


@query("nested_cross_validation")
def _(t):
    rows, _ = M.nested_cv(_grouped(t), _spec(), "y", "joint_group", LADDER, NESTED_ALPHAS, 5, 3, "doc_id")
    return rows_frame(t.spark, rows)


@query("conditional_dependence")
def _(t):
    prep = M.prepare(_grouped(t), _spec(), ["y", "y2"], "joint_group", 5)
    row, _ = M.conditional_dependence(prep, ("C", "X"), 100.0, "node", "joint_group", 5000, 3)
    return rows_frame(t.spark, [row])


@query("boosted_tree_grid")
def _(t):
    prep = M.prepare(_grouped(t), _spec(), ["y"], "joint_group", 3)
    rows, _ = M.boosted_cv(prep, ("C", "R"), [{"maxDepth": 2, "maxIter": 5, "stepSize": 0.1}, {"maxDepth": 3, "maxIter": 5, "stepSize": 0.1}], 1)
    return rows_frame(t.spark, rows)


@query("block_permutation_importance")
def _(t):
    prep = M.prepare(_grouped(t), _spec(), ["y"], "joint_group", 3)
    return rows_frame(t.spark, M.permutation_importance(prep, LADDER, "M4", 10.0, "doc_id", 20, 5))


@query("scenario_model_grid")
def _(t):
    scenarios = {"full": _spec(), "drop_size": FeatureSpec(categorical=("lang",), sequence="seq", dense={"P": {"guess": F.col("guess")}, "R": {"v_mean": F.col("v_mean")}})}
    return rows_frame(t.spark, M.scenario_grid(_grouped(t), scenarios, P.MODEL_BLOCKS_WITH_R, "y", "joint_group", 4, ALPHAS))


# One-feature models have closed forms, so SQL can follow the same protocol to the digit.
_ONE = """
d AS (SELECT l_suppkey AS g, l_returnflag AS s, l_quantity / 50 AS x, least(1.0, l_extendedprice / 100000) AS y, l_discount * 10 AS y2, CASE WHEN l_tax > 0.005 THEN l_tax * 10 END AS w FROM lineitem)"""
_FOLDS = """
fs AS (SELECT g, row_number() OVER (ORDER BY count(*) DESC, g) - 1 AS i FROM d GROUP BY g),
f AS (SELECT d.*, CASE WHEN (i // 5) % 2 = 0 THEN i % 5 ELSE 4 - i % 5 END + 1 AS fold FROM d JOIN fs USING (g))"""


def _one(t):
    return t("lineitem").select(
        F.col("l_suppkey").alias("g"), F.col("l_returnflag").alias("s"), (F.col("l_quantity") / 50).alias("x"), F.least(F.lit(1.0), F.col("l_extendedprice") / 100000).alias("y"),
        (F.col("l_discount") * 10).alias("y2"), F.when(F.col("l_tax") > 0.005, F.col("l_tax") * 10).alias("w"))


def _one_prep(t, feature, responses):
    from sitewise.operators.groups import snake_folds

    df = _one(t)
    table = checkpointed(snake_folds(df, "g", 5).select("g", "fold"))
    return M.prepare(df, FeatureSpec(numeric={feature: F.col(feature)}), responses, "g", 5, fold_table=table)


@query("ridge_cv_closed_form", f"""
WITH {_ONE}, {_FOLDS}, a AS (SELECT unnest([1.0, 1000.0, 100000.0]) AS alpha),
md AS (SELECT h.fold, median(f.w) AS md FROM (SELECT DISTINCT fold FROM f) h JOIN f ON f.fold <> h.fold GROUP BY h.fold),
st AS (SELECT md.fold, any_value(md) AS md, count(*) AS n, avg(coalesce(w, md)) AS mx, stddev_pop(coalesce(w, md)) AS sd, avg(y) AS my, covar_pop(coalesce(w, md), y) AS cv FROM md JOIN f ON f.fold <> md.fold GROUP BY md.fold)
SELECT alpha, CAST(f.fold AS BIGINT) AS fold, CAST(count(*) AS BIGINT) AS n, round(avg(abs(y - least(1.0, greatest(0.0, my + n * cv / sd / (n + alpha) * (coalesce(w, md) - mx) / sd)))), 7) AS mae
FROM f JOIN st ON st.fold = f.fold CROSS JOIN a GROUP BY alpha, f.fold""")
def _(t):
    rows, _ = M.grid_cv(_one_prep(t, "w", ["y"]), {"M": ("C",)}, [1.0, 1000.0, 100000.0])
    out = rows_frame(t.spark, [r for r in rows if r["fold"] != "mean"])
    return out.select("alpha", F.col("fold").cast("long").alias("fold"), "n", r6(F.col("mae"), 7).alias("mae"))


@query("cross_fitted_residual_products", f"""
WITH {_ONE}, {_FOLDS}, st AS (SELECT h.fold, count(*) AS n, avg(x) AS mx, stddev_pop(x) AS sd, avg(y) AS my, covar_pop(x, y) AS cv, avg(y2) AS my2, covar_pop(x, y2) AS cv2 FROM (SELECT DISTINCT fold FROM f) h JOIN f ON f.fold <> h.fold GROUP BY h.fold),
r AS (SELECT g, y - (my + n * cv / sd / (n + 10.0) * (x - mx) / sd) AS a, y2 - (my2 + n * cv2 / sd / (n + 10.0) * (x - mx) / sd) AS b FROM f JOIN st ON st.fold = f.fold),
m AS (SELECT avg(a * b) AS m, count(*) AS n, corr(a, b) AS r FROM r), s AS (SELECT g, sum(a * b - m) AS s FROM r, m GROUP BY g), v AS (SELECT sum(s * s) AS v, count(*) AS k FROM s)
SELECT CAST(n AS BIGINT) AS sites, CAST(k AS BIGINT) AS clusters, round(m, 8) AS mean_residual_product, round(sqrt(v / (n * n) * k / (k - 1) * (n - 1) / (n - 1)), 8) AS cluster_se, round(r, 7) AS residual_correlation FROM m, v""")
def _(t):
    row, _ = M.conditional_dependence(_one_prep(t, "x", ["y", "y2"]), ("C",), 10.0, "g", "g", 20, 1)
    return rows_frame(t.spark, [row]).select("sites", "clusters", r6(F.col("mean_residual_product"), 8).alias("mean_residual_product"), r6(F.col("cluster_se"), 8).alias("cluster_se"),
                                             r6(F.col("residual_correlation"), 7).alias("residual_correlation"))


@query("frozen_transfer_closed_form", f"""
WITH {_ONE}, m AS (SELECT median(w) AS md FROM d WHERE s = 'A'), st AS (SELECT any_value(md) AS md, count(*) AS n, avg(coalesce(w, md)) AS mx, stddev_pop(coalesce(w, md)) AS sd, avg(y) AS my, covar_pop(coalesce(w, md), y) AS cv FROM d, m WHERE s = 'A'),
p AS (SELECT s, y, least(1.0, greatest(0.0, my + n * cv / sd / (n + 50.0) * (coalesce(w, md) - mx) / sd)) AS p FROM d, st WHERE s <> 'A')
SELECT s, CAST(count(*) AS BIGINT) AS n, round(avg(abs(y - p)), 7) AS mae, round(sqrt(avg((y - p) * (y - p))), 7) AS rmse, round(1 - sum((y - p) * (y - p)) / (var_pop(y) * count(*)), 6) AS r2 FROM p GROUP BY s""")
def _(t):
    df = _one(t)
    prep = M.prepare(df.where("s = 'A'"), FeatureSpec(numeric={"w": F.col("w")}), ["y"], "g", 5)
    model = M.final_fit(prep, "M0", ("C",), 50.0)
    scored = M.add_predictions(M.frozen_rows(df.where("s <> 'A'"), prep), [model])
    from sitewise.operators.aggregates import regression_metrics

    m = regression_metrics(scored, ["s"], "y", "prediction_M0", spearman=False)
    return m.select("s", "n", r6(F.col("mae"), 7).alias("mae"), r6(F.col("rmse"), 7).alias("rmse"), r6(F.col("r2")).alias("r2"))


def _snake(place, folds):
    return f"CASE WHEN ({place} // {folds}) % 2 = 0 THEN {place} % {folds} ELSE {folds - 1} - {place} % {folds} END + 1"


@query("nested_choice_closed_form", f"""
WITH {_ONE}, fs AS (SELECT g, count(*) AS c, row_number() OVER (ORDER BY count(*) DESC, g) - 1 AS p FROM d GROUP BY g), fo AS (SELECT g, c, {_snake("p", 5)} AS o FROM fs),
fi AS (SELECT g, o, row_number() OVER (PARTITION BY o ORDER BY c DESC, g) - 1 AS q FROM fo), f AS (SELECT d.*, o, {_snake("q", 3)} AS j FROM d JOIN fi USING (g)),
t AS (SELECT a.range AS f, b.range AS i FROM range(1, 6) a, range(0, 4) b), a AS (SELECT unnest([0.1, 1000.0, 20000.0, 100000.0])::DOUBLE AS alpha),
md AS (SELECT t.f, t.i, median(w) AS md FROM t JOIN f ON o <> t.f AND (t.i = 0 OR j <> t.i) GROUP BY t.f, t.i),
st AS (SELECT md.f, md.i, any_value(md) AS md, count(*) AS n, avg(coalesce(w, md)) AS mx, stddev_pop(coalesce(w, md)) AS sd, avg(y) AS my, covar_pop(coalesce(w, md), y) AS cv
  FROM md JOIN f ON o <> md.f AND (md.i = 0 OR j <> md.i) GROUP BY md.f, md.i),
p AS (SELECT st.f, st.i, alpha, abs(y - least(1.0, greatest(0.0, my + n * cv / sd / (n + alpha) * (coalesce(w, md) - mx) / sd))) AS e
  FROM st JOIN f ON (st.i > 0 AND o <> st.f AND j = st.i) OR (st.i = 0 AND o = st.f) CROSS JOIN a),
m AS (SELECT f, i, alpha, avg(e) AS mae, count(*) AS n FROM p GROUP BY f, i, alpha),
c AS (SELECT f, arg_min(alpha, {{'m': mae, 'a': alpha}}) AS alpha FROM (SELECT f, alpha, avg(mae) AS mae FROM m WHERE i > 0 GROUP BY f, alpha) GROUP BY f)
SELECT CAST(m.f AS VARCHAR) AS outer_fold, m.alpha AS selected_alpha, CAST(n AS BIGINT) AS n, round(mae, 7) AS mae FROM m JOIN c ON m.f = c.f AND m.alpha = c.alpha WHERE i = 0""")
def _(t):
    df = _one(t).withColumn("id", F.monotonically_increasing_id())
    rows, _ = M.nested_cv(df, FeatureSpec(numeric={"w": F.col("w")}), "y", "g", {"M": ("C",)}, [0.1, 1000.0, 20000.0, 100000.0], 5, 3, "id", spearman=False)
    return rows_frame(t.spark, [r for r in rows if r["row_type"] == "outer_fold"]).select("outer_fold", "selected_alpha", "n", r6(F.col("mae"), 7).alias("mae"))


@query("transfer_contrast_intervals", f"""
WITH {_ONE}, e AS (SELECT g, s <> 'N' AS strict, abs(y - 0.4) - abs(y - (0.2 + 0.5 * x)) AS d, y FROM d WHERE s <> 'A'),
co AS (SELECT 'all' AS cohort, g, sum(d) AS d, count(*) AS n FROM e GROUP BY g UNION ALL SELECT 'strict', g, sum(d), count(*) FROM e WHERE strict GROUP BY g),
{draws_sql("dr", "co", 7, "g", 2000)}, r AS (SELECT cohort, rep, sum(c * d) / sum(c * n) AS b FROM (SELECT *, {POISSON_COUNT} AS c FROM dr) GROUP BY cohort, rep),
ci AS (SELECT cohort, count(*) AS k, quantile_cont(b, 0.025) AS lo, quantile_cont(b, 0.975) AS hi FROM r GROUP BY cohort)
SELECT cohort, 'm1_vs_m0' AS comparison, round(any_value(p), 7) AS delta_mae, CAST(any_value(k) AS BIGINT) AS replicates, round(any_value(lo), 7) AS ci_low, round(any_value(hi), 7) AS ci_high
FROM ci JOIN (SELECT cohort, sum(d) / sum(n) AS p FROM co GROUP BY cohort) USING (cohort) GROUP BY cohort""")
def _(t):
    rows = _one(t).where("s <> 'A'").select("g", "y", (F.col("s") != "N").alias("strict"), F.lit(0.4).alias("prediction_m0"), (0.2 + 0.5 * F.col("x")).alias("prediction_m1"))
    b = P.cohort_intervals(rows, {"all": F.lit(True), "strict": F.col("strict")}, "y", ["m0", "m1"], [("m0", "m1")], 2000, 7, "g")
    return b.select("cohort", "comparison", r6(F.col("delta_mae"), 7).alias("delta_mae"), "replicates", r6(F.col("ci_low"), 7).alias("ci_low"), r6(F.col("ci_high"), 7).alias("ci_high"))


@query("partial_score_permutation", f"""
WITH e AS (SELECT event_id, event_id % 3 + 1 AS fold, value / 100 AS s0, (user_id % 50) / 100 AS s1, (value + event_id % 40) / 150 AS y, ('0x' || substr(md5('9|' || event_id), 1, 8))::BIGINT AS h FROM events),
o AS (SELECT *, row_number() OVER (PARTITION BY fold ORDER BY h, event_id) - 1 AS place, count(*) OVER (PARTITION BY fold) AS n FROM e),
r AS (SELECT range AS repeat, ('0x' || substr(md5('9|shift|' || range), 1, 8))::BIGINT AS step FROM range(20)),
m AS (SELECT o.fold, repeat, (place + 1 + step % (n - 1)) % n AS place, s0 AS m0, s1 AS m1 FROM o, r),
j AS (SELECT m.fold, repeat, y, s0, s1, m0, m1 FROM m JOIN o ON m.fold = o.fold AND m.place = o.place),
b AS (SELECT fold, repeat, -1 AS block, y, s0 + s1 AS p FROM j UNION ALL SELECT fold, repeat, 0, y, m0 + s1 FROM j UNION ALL SELECT fold, repeat, 1, y, s0 + m1 FROM j)
SELECT CAST(fold AS BIGINT) AS fold, CAST(repeat AS BIGINT) AS repeat, CAST(block AS BIGINT) AS block, CAST(count(*) AS BIGINT) AS n, round(avg(abs(y - least(1.0, greatest(0.0, p)))), 7) AS mae FROM b GROUP BY ALL""")
def _(t):
    e = t("events").select("event_id", (F.col("event_id") % 3 + 1).alias("fold"), ((F.col("value") + F.col("event_id") % 40) / 150).alias("y"),
                           F.array(F.col("value") / 100, (F.col("user_id") % 50) / 100).alias("s"))
    m = M.shifted_errors(e, "fold", "event_id", "y", "s", 20, 9)
    return m.select("fold", F.col("repeat").cast("long").alias("repeat"), F.col("block").cast("long").alias("block"), "n", r6(F.col("sae") / F.col("n"), 7).alias("mae"))


@query("block_shuffle_preserves_margins", """
SELECT CAST(event_id % 3 + 1 AS BIGINT) AS fold, CAST(count(*) AS BIGINT) AS n, round(sum(value), 2) AS total, round(max(value), 2) AS highest FROM events GROUP BY 1""")
def _(t):
    e = t("events").select("event_id", (F.col("event_id") % 3 + 1).alias("fold"), F.array(F.col("value"), F.col("user_id").cast("double")).alias("raw"))
    s = M.permuted_block(e, "raw", "fold", "event_id", [0], 9)
    return s.groupBy("fold").agg(F.count(F.lit(1)).alias("n"), r6(F.sum(F.get("raw", F.lit(0))), 2).alias("total"), r6(F.max(F.get("raw", F.lit(0))), 2).alias("highest"))
