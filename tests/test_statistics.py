import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from sitewise.operators import aggregates as A
from sitewise.operators import inference as N
from sitewise.operators import linear as L
from sitewise.operators import resample as B
from sitewise.plans.association import coefficient_bootstrap


@pytest.fixture(scope="module")
def frame(spark):
    rng = np.random.default_rng(7)
    n = 600
    g = rng.integers(0, 40, n)
    x, z = rng.normal(size=n), rng.exponential(size=n)
    s = np.array(["a", "b", "c"])[rng.integers(0, 3, n)]
    y = 0.5 + 0.3 * x - 0.1 * z + 0.2 * (s == "b") + 0.3 * rng.normal(size=40)[g] + rng.normal(size=n) * 0.5
    z = np.where(rng.random(n) < 0.1, np.nan, z)
    pdf = pd.DataFrame({"i": range(n), "g": g, "x": x, "z": z, "s": s, "y": y})
    return pdf, spark.createDataFrame(pdf).withColumn("z", F.when(~F.isnan("z"), F.col("z")))


def dense_design(pdf):
    med = pdf.z.median()
    f = pdf.z.fillna(med)
    return np.column_stack([np.ones(len(pdf)), pdf.x, (f - f.mean()) / f.std(ddof=1), pdf.z.isna(), pdf.s == "b", pdf.s == "c"]).astype(float)


def dense_fit(x, y, g, w=None):
    w = np.ones(len(y)) if w is None else w
    bread = np.linalg.inv(x.T @ (x * w[:, None]))
    beta = bread @ (x.T @ (w * y))
    e = w * (y - x @ beta)
    scores = np.array([(x * e[:, None])[g == k].sum(0) for k in np.unique(g)])
    n, p, c = len(y), x.shape[1], len(scores)
    return beta, np.sqrt(np.diag(bread @ (scores.T @ scores) @ bread * c / (c - 1) * (n - 1) / (n - p)))


def test_clustered_fit_matches_dense_algebra(frame):
    pdf, df = frame
    d = N.association_design(df, "x", {"z": F.col("z")}, ["z"], ["s"])
    fit = L.fit_ols(df, d, F.col("y"), "g")
    beta, se = dense_fit(dense_design(pdf), pdf.y.to_numpy(), pdf.g.to_numpy())
    assert d.names == ["Intercept", "x", "z_z", "missing_z", "s=b", "s=c"]
    assert np.allclose(fit.beta, beta) and np.allclose(np.sqrt(np.diag(fit.cov)), se)
    w = 1 + (pdf.i % 3)
    fit = L.fit_ols(df, d, F.col("y"), "g", weights=1 + F.col("i") % 3)
    beta, se = dense_fit(dense_design(pdf), pdf.y.to_numpy(), pdf.g.to_numpy(), w.to_numpy(float))
    assert np.allclose(fit.beta, beta) and np.allclose(np.sqrt(np.diag(fit.cov)), se)


def test_fits_use_complete_rows(spark):
    rng = np.random.default_rng(9)
    rows = [(i, float(x), None if i % 5 == 0 else float(2 * x + 1 + e), None if i % 7 == 0 else float(e), f"g{i % 40}")
            for i, (x, e) in enumerate(zip(rng.normal(size=400), rng.normal(size=400) / 50))]
    pdf = pd.DataFrame(rows, columns=["i", "x", "y", "y2", "g"])
    df = spark.createDataFrame(rows, "i int, x double, y double, y2 double, g string")
    design = L.Design(["Intercept", "x"], [F.lit(1.0), F.col("x")])
    for response in ("y", "y2"):
        part = pdf[pdf[response].notna()]
        beta, se = dense_fit(np.column_stack([np.ones(len(part)), part.x]), part[response].to_numpy(), part.g.to_numpy())
        fit = L.fit_ols(df, design, F.col(response), "g")
        assert fit.n == len(part) and np.allclose(fit.beta, beta) and np.allclose(np.sqrt(np.diag(fit.cov)), se)
        again = next(r for r in N.outcome_refits(df, design, ["y", "y2"], "x", "g") if r["outcome"] == response)
        assert (again["sites"], again["clusters"]) == (len(part), part.g.nunique()) and np.allclose([again["beta_raw"], again["se_cluster"]], [beta[1], se[1]])


def test_strata_in_one_pass_match_single_fits(frame):
    pdf, df = frame
    design = N.association_design(df, "x", {"z": F.col("z")}, ["z"])
    rows = N.stratified_fits(df, "s", design, "y", "x", "g", 2, 2)
    assert len(rows) == pdf.s.nunique()
    for r in rows:
        fit = L.fit_ols(df.where(F.col("s") == r["analysis"].removeprefix("s_")), design, F.col("y"), "g")
        assert np.allclose([r["beta_raw"], r["se_cluster"], r["sites"]], [*fit.term("x"), fit.n])


def test_null_keys_stay(spark):
    from sitewise.operators import aggregates as A
    from sitewise.operators import windows as W
    df = spark.createDataFrame([("a", 1.0, 0.1), (None, 2.0, 0.04), (None, 3.0, 0.02), ("a", 0.5, None)], "k string, v double, p double")
    assert {(r.k, r["rank"], r.group_size) for r in W.rank_candidates(df, ["k"], ["v"]).collect()} == {("a", 1, 2), ("a", 2, 2), (None, 1, 2), (None, 2, 2)}
    assert sorted(r.group_size for r in A.group_size(df, ["k"]).collect()) == [2, 2, 2, 2]
    some = df.where("p is not null")
    assert {r.v: round(r.q_value, 6) for r in N.bh_adjust(some, ["k"], "p", ["v"]).collect()} == {1.0: 0.1, 2.0: 0.04, 3.0: 0.04}
    assert {r.k: r.n for r in N.wilcoxon_signed_rank(df, "v", ["k"]).collect()} == {"a": 2, None: 2}
    both = {r.k: (r.n, r.mae, r.spearman) for r in A.regression_metrics(df, ["k"], "v", "p").collect()}
    assert both["a"][:2] == (1, 0.9) and both[None][0] == 2 and both[None][2] == pytest.approx(-1.0)
    assert {r.k for r in A.error_diagnostics(some, ["k"], "v", "p").collect()} == {"a", None}
    assert A.error_diagnostics(some, [], "v", "p").count() == 1
    assert sum(r.bin_count for r in A.calibration_table(some, ["k"], "v", "p", [0.0, 0.03, 1.0]).collect()) == 3


def test_constant_columns_are_dropped_and_all_null_stays_finite(frame):
    _, df = frame
    df = df.withColumns({"c": F.lit(2.0), "void": F.lit(None).cast("double")})
    d = N.association_design(df, "x", {"c": F.col("c"), "void": F.col("void")}, ["void"])
    fit = L.fit_ols(df, d, F.col("y"), "g")
    assert fit.names == ["Intercept", "x"] and np.isfinite(fit.beta).all()


def test_spline_and_influence_match_dense_algebra(frame):
    pdf, df = frame
    d = L.Design(["Intercept", "x"], [F.lit(1.0), F.col("x")])
    summary, curve = N.spline_sensitivity(df, d, "x", "y", "g", 20)
    t = np.quantile(pdf.x, [0, 1 / 3, 2 / 3, 1])
    basis = N._spline_values(pdf.x.to_numpy(), t)
    x = np.column_stack([np.ones(len(pdf)), basis])
    beta, *_ = np.linalg.lstsq(x, pdf.y, rcond=None)
    e = pdf.y - x @ beta
    assert summary["spline_r_squared"] == pytest.approx(1 - (e**2).sum() / ((pdf.y - pdf.y.mean()) ** 2).sum())
    at = np.linspace(*np.quantile(pdf.x, [0.01, 0.99]), 20)
    want = np.column_stack([np.ones(20), N._spline_values(at, t)]) @ beta
    assert np.allclose([c["adjusted"] for c in curve], want)
    x = np.column_stack([np.ones(len(pdf)), pdf.x])
    beta, *_ = np.linalg.lstsq(x, pdf.y, rcond=None)
    h = np.einsum("ij,jk,ik->i", x, np.linalg.inv(x.T @ x), x)
    e = (pdf.y - x @ beta).to_numpy()
    cook = e**2 * h / (2 * (e @ e / (len(e) - 2)) * (1 - h) ** 2)
    got = N.influence_summary(df, L.fit_ols(df, d, F.col("y"), "g"), F.col("y"))
    assert got["max_cooks_distance"] == pytest.approx(cook.max()) and got["influential_cooks_gt_4_over_n"] == (cook > 4 / len(e)).sum()
    assert got["design_rank"] == 2


def test_tail_probabilities():
    assert L.normal_p(1.959963984540054) == pytest.approx(0.05)
    assert L.chi2_sf(3.841458820694124, 1) == pytest.approx(0.05) and L.chi2_sf(7.814727903251179, 3) == pytest.approx(0.05)
    assert L.chi2_sf(0.5, 3) == pytest.approx(0.9188914116) and L.chi2_sf(40, 3) == pytest.approx(1.0655e-8, rel=1e-3)
    assert N.f_sf_one(4.0, 10**6) == pytest.approx(L.normal_p(2.0), rel=1e-4)
    assert N.f_sf_one(4.964602744, 10) == pytest.approx(0.05, rel=1e-6)
    assert N.binomial_two_sided(2, 10) == pytest.approx(112 / 1024) and N.binomial_two_sided(5, 10) == 1.0


def test_bh_list_and_frame_agree(spark):
    p = [0.04, 0.001, 0.03]
    assert N.bh_list(p) == pytest.approx([0.04, 0.003, 0.04])
    df = spark.createDataFrame(list(enumerate(p)), "i int, p double")
    got = {r.i: r.q_value for r in N.bh_adjust(df, [], "p", ["i"]).collect()}
    assert [got[i] for i in range(3)] == pytest.approx(N.bh_list(p))


def test_constant_vector_interval_and_sign_flip_power(spark):
    df = spark.createDataFrame([(i, 0.25) for i in range(30)], "i int, v double")
    ci = B.percentile_interval(B.bootstrap_median(df, "v", 30, 1), [], "estimate").first()
    assert (ci.ci_low, ci.ci_high) == (0.25, 0.25)
    df = spark.createDataFrame([(i, float(v)) for i, v in enumerate(np.linspace(0.5, 1.5, 80))], "i int, v double")
    assert B.sign_flip_test(df, "i", F.col("v"), 500, 1).first().p_value < 0.01


def test_coefficient_bootstrap_matches_refits(spark, frame):
    pdf, df = frame
    d = L.Design(["Intercept", "x"], [F.lit(1.0), F.col("x")])
    got = coefficient_bootstrap(df, {"b": d}, "y", {"b": "x"}, "g", 8, 2, "multinomial").toPandas().set_index("rep").b
    draws = B.draw_counts(B.numbered(B.group_sums(df, "g", {"n": F.lit(1)}), "g"), 8, 2).toPandas()
    groups = np.sort(pdf.g.unique())
    for rep, part in draws.groupby("rep"):
        w = dict(zip(groups[part._g], part.weight))
        weight = pdf.g.map(lambda k: w.get(k, 0)).to_numpy(float)
        x = np.column_stack([np.ones(len(pdf)), pdf.x])
        beta = np.linalg.solve(x.T @ (x * weight[:, None]), x.T @ (weight * pdf.y.to_numpy()))
        assert got[rep] == pytest.approx(beta[1])
        assert part.weight.sum() == len(groups)


def plain_draws(seed, key, replicates):
    """Uniform 32-bit numbers of one key, word by word."""
    import hashlib

    def mixed(x):
        x = (x ^ (x >> 16)) * 2246822507 % 2**32
        x = (x ^ (x >> 13)) * 3266489909 % 2**32
        return x ^ (x >> 16)

    digest = hashlib.md5(f"{seed}|{key}".encode()).hexdigest()
    high, low = int(digest[:8], 16), int(digest[8:16], 16)
    return [mixed(high ^ mixed((low + r * 2654435769) % 2**32)) for r in range(replicates)]


def plain_poisson(mean, uniform):
    k, upto = 0, math.exp(-mean)
    term = upto
    while uniform >= upto and k < 1000:
        k += 1
        term *= mean / k
        upto += term
    return k


def test_kernel_weights_follow_the_draws(spark):
    rows = [(None if i == 7 else i, float(i), "a" if i % 3 else None) for i in range(600)]
    df = spark.createDataFrame(rows, "g int, v double, part string").repartition(5)
    got = {(r.part, r.rep): r.sums for r in B.replicate_sums(df, ["g"], [F.col("v"), F.lit(1.0)], 40, 6, by="part").collect()}
    want = {}
    for g, v, part in rows:
        for rep, h in enumerate(plain_draws(6, "~" if g is None else g, 40)):
            w = plain_poisson(1.0, h / 2**32)
            sums = want.setdefault((part, rep), [0.0, 0.0])
            sums[0] += w * v
            sums[1] += w
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k]) for k in want)
    plan = B.bootstrap_sums(df, "g", ["v"], 40, 6)._jdf.queryExecution().toString()
    assert "Generate" not in plan and "Join" not in plan


@pytest.mark.parametrize("values", [[1.0], [1.0, 2.0], [float(v % 7) for v in range(200)], [float(v * v % 1009) for v in range(900)], [None, 3.0, 3.0, None, 8.0]])
def test_median_bootstrap_equals_plain_counts(spark, values, monkeypatch):
    monkeypatch.setattr(B, "ROWS_PER_PIECE", 13)
    got = B.bootstrap_median(spark.createDataFrame([(v,) for v in values], "v double"), "v", 60, 3).toPandas().sort_values("rep").estimate.tolist()
    held = sorted(v for v in values if v is not None)
    n, reach = len(held), 3.5 / math.sqrt(len(held))
    lo, hi = held[math.floor((n - 1) * max(0.0, 0.5 - reach))], held[math.ceil((n - 1) * min(1.0, 0.5 + reach))]
    inside = sorted({v for v in held if lo <= v <= hi})
    masses = [(v, held.count(v), str(i)) for i, v in enumerate(inside, 1)] + [(v, m, name) for v, m, name in (
        (-math.inf, sum(x < lo for x in held), "below"), (math.inf, sum(x > hi for x in held), "above")) if m]
    draws = [(v, m, plain_draws(3, name, 60)) for v, m, name in sorted(masses)]
    for rep in range(60):
        drawn = [v for v, m, h in draws for _ in range(plain_poisson(float(m), h[rep] / 2**32))]
        want = np.median(drawn) if drawn else math.nan
        assert got[rep] == pytest.approx(want, nan_ok=True)


def test_missing_values_take_no_part_in_resampling(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=900)
    rows = [(int(i % 30), float(a), None if i % 5 == 0 else float(2 * a + 1 + 0.01 * e), float(a) if i % 7 else None) for i, (a, e) in enumerate(zip(x, rng.normal(size=900)))]
    df = spark.createDataFrame(rows, "g int, x double, y double, p double")
    d = L.Design(["Intercept", "x"], [F.lit(1.0), F.col("x")])
    b = coefficient_bootstrap(df, {"b": d}, "y", {"b": "x"}, "g", 200, 2).toPandas().b
    assert b.mean() == pytest.approx(2, abs=0.01) and b.std() < 0.01
    assert b.mean() == pytest.approx(L.fit_ols(df, d, F.col("y"), "g").term("x")[0], abs=0.005)
    flip = B.sign_flip_test(df, "g", F.col("y"), 100, 2).first()
    assert flip.mean == pytest.approx(np.mean([r[2] for r in rows if r[2] is not None]))
    deltas = B.paired_error_bootstrap(df.withColumn("m", F.lit(0.0)), "g", "y", ["m", "p"], [("m", "p")], 300, 2).toPandas().delta_mae
    both = [(y, p) for _, _, y, p in rows if y is not None and p is not None]
    assert deltas.mean() == pytest.approx(np.mean([abs(y) - abs(y - p) for y, p in both]), abs=0.05)


def test_pooling_two_studies(spark):
    df = spark.createDataFrame([(0.02, 0.005), (0.008, 0.002)], "e double, s double")
    rows = {r.model: r for r in A.inverse_variance_pool(df, "e", "s").collect()}
    w = np.array([1 / 0.005**2, 1 / 0.002**2])
    fixed = (w * [0.02, 0.008]).sum() / w.sum()
    q = (w * (np.array([0.02, 0.008]) - fixed) ** 2).sum()
    assert rows["fixed_effect"].estimate == pytest.approx(fixed) and rows["fixed_effect"].Q == pytest.approx(q)
    tau2 = max(0, (q - 1) / (w.sum() - (w**2).sum() / w.sum()))
    wr = 1 / (1 / w + tau2)
    assert rows["random_effect_DL"].estimate == pytest.approx((wr * [0.02, 0.008]).sum() / wr.sum())
    assert rows["random_effect_DL"].standard_error == pytest.approx(math.sqrt(1 / wr.sum()))


def test_calibration_keeps_empty_bins(spark):
    df = spark.createDataFrame([(0.1, 0.05), (0.9, 0.95)], "y double, p double")
    rows = {r.bin_index: r for r in A.calibration_table(df, [], "y", "p", [0.0, 0.25, 0.5, 1.0]).collect()}
    assert [rows[i].bin_count for i in (1, 2, 3)] == [1, 0, 1] and rows[2].mean_prediction is None
