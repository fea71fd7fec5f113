import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from sitewise.operators import matching as X
from sitewise.operators import models as M
from sitewise.operators.encoding import FeatureSpec
from sitewise.operators.enrich import KEY, batches_of, committed, compact, enrich_distinct
from sitewise.operators.groups import group_folds
from sitewise.plans import prediction as P


@pytest.fixture(scope="module")
def frame(spark):
    rng = np.random.default_rng(11)
    n = 160
    seq = ["".join(rng.choice(list("ACGT"), 21)) for _ in range(n)]
    a = rng.normal(size=n)
    pdf = pd.DataFrame({"i": range(n), "gene": [f"g{k}" for k in rng.integers(0, 30, n)], "seq": seq, "a": a,
                        "b": np.where(rng.random(n) < 0.2, np.nan, rng.exponential(size=n)), "c": np.array(["u", "v", "w"])[rng.integers(0, 3, n)],
                        "r": rng.normal(size=n), "void": np.nan})
    pdf["y"] = np.clip(0.5 + 0.1 * a + 0.05 * pdf.r + 0.1 * rng.normal(size=n), 0.1, 0.9)
    df = spark.createDataFrame(pdf).withColumns({c: F.when(~F.isnan(c), F.col(c)) for c in ("b", "void")})
    return pdf, df


def spec():
    return FeatureSpec(numeric={"a": F.col("a"), "b": F.col("b"), "void": F.col("void")}, flagged=("b",), categorical=("c",), sequence="seq",
                       dense={"R": {"r": F.col("r")}})


def dense_encode(train, rows, blocks):
    from itertools import product

    cols = []
    for n in ("a", "b", "void"):
        med = train[n].median()
        med = 0.0 if np.isnan(med) else med
        t, x = train[n].fillna(med), rows[n].fillna(med)
        cols.append((x - t.mean()) / (t.std(ddof=0) or 1.0))
        if n == "b":
            cols.append(rows[n].isna().astype(float))
    cols += [(rows.c == k).astype(float) for k in sorted(train.c.unique())]
    if "X" in blocks:
        for k in ("".join(p) for p in product("ACGT", repeat=3)):
            def f(s):
                return sum(s[j:j + 3] == k for j in range(len(s) - 2)) / (len(s) - 2)
            t, x = train.seq.map(f), rows.seq.map(f)
            cols.append((x - t.mean()) / (t.std(ddof=0) or 1.0))
    if "R" in blocks:
        cols.append((rows.r - train.r.mean()) / train.r.std(ddof=0))
    return np.column_stack(cols)


def dense_ridge(x, y, alpha):
    xc, yc = x - x.mean(0), y - y.mean()
    b = np.linalg.solve(xc.T @ xc + alpha * np.eye(x.shape[1]), xc.T @ yc)
    return y.mean() - x.mean(0) @ b, b


def test_grid_cv_matches_refitting_every_fold(frame):
    pdf, df = frame
    models = {"M0": ("C",), "M3": ("C", "X", "R")}
    prep = M.prepare(df, spec(), ["y"], "gene", 4)
    rows, picked = M.grid_cv(prep, models, [0.5, 5.0, 50.0])
    fold = pdf.gene.map({r.gene: r.fold for r in group_folds(df, "gene", 4).collect()})
    got = {(r["model"], r["alpha"], r["fold"]): r["mae"] for r in rows}
    for m, blocks in models.items():
        for alpha in (0.5, 5.0, 50.0):
            for f in range(1, 5):
                train, valid = pdf[fold != f], pdf[fold == f]
                b0, b = dense_ridge(dense_encode(train, train, blocks), train.y.to_numpy(), alpha)
                pred = np.clip(b0 + dense_encode(train, valid, blocks) @ b, 0, 1)
                assert got[(m, alpha, str(f))] == pytest.approx(np.abs(pred - valid.y).mean(), rel=1e-7)
    assert picked["M0"]["alpha"] == min((r for r in rows if r["model"] == "M0" and r["fold"] == "mean"), key=lambda r: (r["mae"], r["alpha"]))["alpha"]
    with pytest.raises(M.BoundaryError):
        M.select_best([{"model": "m", "alpha": a, "mae": a} for a in (1.0, 2.0)], True)


def test_frozen_model_treats_unseen_levels_as_zero(spark, frame):
    pdf, df = frame
    prep = M.prepare(df.where("c <> 'w'"), spec(), ["y"], "gene", 3)
    model = M.final_fit(prep, "M0", ("C",), 2.0)
    got = M.add_predictions(M.frozen_rows(df, prep), [model]).select("i", "prediction_M0", model.predict(F.col("raw")).alias("p")).toPandas().sort_values("i")
    train = pdf[pdf.c != "w"]
    b0, b = dense_ridge(dense_encode(train, train, ("C",)), train.y.to_numpy(), 2.0)
    want = np.clip(b0 + dense_encode(train, pdf, ("C",)) @ b, 0, 1)
    assert np.allclose(got.prediction_M0, want) and np.allclose(got.p, want)


def test_end_to_end_split_fit_predict(frame):
    _, df = frame
    grouped = P.assign_groups(df, "gene", "seq", 0.25, 3)
    with pytest.raises(M.BoundaryError):
        P.train_and_test(grouped, spec(), "y", {"M0": ("C",)}, [1.0, 10.0], 3, 50, 1)
    out, fitted, prep = P.train_and_test(grouped, spec(), "y", {"M0": ("C",), "M1": ("C", "X")}, [1.0, 10.0], 3, 50, 1, ["gene", "seq"], reject_boundary=False)
    assert out["leakage"].agg(F.sum("overlap")).first()[0] == 0
    assert {r.model for r in out["test_metrics"].collect()} == {"M0", "M1"}
    row = out["contrasts"].first()
    assert row.comparison == "M1_vs_M0" and row.ci_low <= row.delta_mae <= row.ci_high
    metrics, rows = P.transfer(df, grouped.where("split = 'development'"), prep, fitted, "y", ["gene", "seq"])
    assert rows.where("prediction_M0 < 0 or prediction_M0 > 1").count() == 0
    n = {r.cohort: r.n for r in metrics.where("model = 'M0'").collect()}
    assert n["all"] == 160 and n["strict"] < 160
    boot = {r.cohort: r for r in P.transfer_contrasts(rows.withColumn("g", F.col("gene")), fitted, "y", 200, 3, "g").collect()}
    assert set(boot) == {"all", "strict"} and all(r.ci_low <= r.ci_high for r in boot.values()) and boot["all"].replicates == 200


def test_missing_responses_and_groups(frame):
    pdf, df = frame
    gapped = df.withColumn("y", F.when(F.col("i") % 5 > 0, F.col("y"))).withColumn("gene", F.nullif("gene", F.lit(pdf.gene.iloc[0])))
    prep = M.prepare(gapped, spec(), ["y"], "gene", 4)
    assert prep.df.count() == gapped.where("y is not null").count() and prep.df.where("gene is null").select("fold").distinct().count() == 1
    rows, _ = M.grid_cv(prep, {"M0": ("C",)}, [1.0, 2.0])
    assert sum(r["n"] for r in rows if r["fold"] == "mean" and r["alpha"] == 1.0) == prep.df.count()


def test_nested_choice_matches_refitting(frame):
    pdf, df = frame
    alphas, models = [0.5, 5.0, 50.0], {"M0": ("C",), "M3": ("C", "X", "R")}
    rows, oof = M.nested_cv(df, spec(), "y", "gene", models, alphas, 3, 2, "i")
    cells = {r.gene: (r.outer_fold, r.inner_fold) for r in M.nested_cells(df, "gene", 3, 2).collect()}
    o, j = pdf.gene.map(lambda g: cells[g][0]), pdf.gene.map(lambda g: cells[g][1])

    def fitted(train, valid, blocks, alpha):
        b0, b = dense_ridge(dense_encode(train, train, blocks), train.y.to_numpy(), alpha)
        return np.clip(b0 + dense_encode(train, valid, blocks) @ b, 0, 1)

    got = {(r["model"], r["outer_fold"]): r for r in rows}
    for m, blocks in models.items():
        for f in (1, 2, 3):
            def inner(alpha):
                return np.mean([np.abs(fitted(pdf[(o != f) & (j != i)], pdf[(o != f) & (j == i)], blocks, alpha) - pdf[(o != f) & (j == i)].y).mean() for i in (1, 2)])
            best = min(alphas, key=lambda a: (inner(a), a))
            pred = fitted(pdf[o != f], pdf[o == f], blocks, best)
            assert got[m, str(f)]["selected_alpha"] == best and got[m, str(f)]["mae"] == pytest.approx(np.abs(pred - pdf[o == f].y).mean(), rel=1e-7)
    assert oof.count() == len(models) * len(pdf)


def test_importance_moves_one_number_per_block(frame):
    pdf, df = frame
    prep = M.prepare(df, spec(), ["y"], "gene", 3)
    out = {r["feature_block"]: r for r in M.permutation_importance(prep, {"M3": ("C", "X", "R")}, "M3", 1.0, "i", 20, 4)}
    assert set(out) == {"C", "X", "R"} and all(r["fold_repeat_estimates"] == 60 for r in out.values())


def test_permuted_block_keeps_the_block_values_of_each_fold(spark, frame):
    _, df = frame
    prep = M.prepare(df, spec(), ["y"], "gene", 3)
    use = prep.layout.index(["R"])
    a = prep.df.select("fold", "i", F.get("raw", F.lit(use[0])).alias("r"), F.get("raw", F.lit(0)).alias("z")).toPandas().sort_values("i")
    shuffled = M.permuted_block(prep.df.select("i", "raw", "fold"), "raw", "fold", "i", use, 4)
    b = shuffled.select("fold", "i", F.get("raw", F.lit(use[0])).alias("r"), F.get("raw", F.lit(0)).alias("z")).toPandas().sort_values("i")
    assert (a.z.to_numpy() == b.z.to_numpy()).all() and (a.r.to_numpy() != b.r.to_numpy()).any()
    for f in (1, 2, 3):
        assert sorted(a[a.fold == f].r) == sorted(b[b.fold == f].r)


def test_greedy_matching_against_brute_force(spark):
    rng = np.random.default_rng(2)
    rows = []
    for t in range(12):
        n = 80
        v = [None if rng.random() < 0.15 else float(x) for x in rng.normal(size=n)]
        rows.append((t, v, "".join(rng.choice(list("ACGT"), n)), sorted(int(p) for p in rng.choice(np.arange(4, n - 3), 9, replace=False))))
    df = spark.createDataFrame(rows, "t int, v array<double>, s string, p array<int>")
    got = {(r.t, r.site_pos): r.control_pos for r in X.match_greedy(df, "t", "v", "s", "p", 3, 0.7, 6).collect()}
    want = {}
    for t, v, s, sites in rows:
        ok = [p for p in range(4, len(v) - 2) if p not in sites and sum(x is not None for x in v[p - 4:p - 1]) >= 3 and sum(x is not None for x in v[p:p + 3]) >= 3]
        used = set()
        for site in sites:
            pool = [p for p in ok if s[p - 1] == s[site - 1]]
            below, above = [p for p in pool if p < site][::-1], [p for p in pool if p >= site]
            order = []
            for k in range(max(len(below), len(above))):
                order += sorted([q[k] for q in (below, above) if k < len(q)], key=lambda p: (abs(p - site), p))
            pick = next((p for p in order if abs(p - site) >= 6 and p not in used), None)
            if pick is not None:
                used.add(pick)
                want[(t, site)] = pick
    assert got == want and len({(t, c) for (t, _), c in got.items()}) == len(got)


def test_enrichment_resumes_without_recomputing(spark, tmp_path):
    calls = spark.sparkContext.accumulator(0)

    def compute(keys):
        def run(batches):
            for pdf in batches:
                calls.add(len(pdf))
                yield pd.DataFrame({KEY: pdf[KEY], "n": pdf["content"].str.len()})

        return keys.mapInPandas(run, f"{KEY} string, n long")

    df = spark.createDataFrame([(i, s) for i, s in enumerate(["aa", "b", "aa", "cccc", "dd"])], "i int, s string")
    store = f"{tmp_path}/store"
    assert [r.n for r in enrich_distinct(df, F.col("s"), compute, store).orderBy("i").collect()] == [2, 1, 2, 4, 2]
    assert calls.value == 4
    enrich_distinct(df, F.col("s"), compute, store).count()
    assert calls.value == 4


def test_enrichment_keeps_finished_batches_after_a_failure(spark, tmp_path):
    calls, broken = spark.sparkContext.accumulator(0), []

    def compute(keys):
        if len(broken) == 2:
            broken.append(1)
            raise OSError("third batch")
        broken.append(1)

        def run(batches):
            for pdf in batches:
                calls.add(len(pdf))
                yield pd.DataFrame({KEY: pdf[KEY], "n": pdf["content"].str.len()})

        return keys.mapInPandas(run, f"{KEY} string, n long")

    df = spark.createDataFrame([(i, "s" * (i % 40)) for i in range(120)], "i int, s string")
    store = f"{tmp_path}/store"
    with pytest.raises(OSError):
        enrich_distinct(df, F.col("s"), compute, store, batches=4)
    done = committed(spark, store).count()
    assert done == calls.value > 0
    assert [r.n for r in enrich_distinct(df, F.col("s"), compute, store, batches=4).orderBy("i").collect()] == [i % 40 for i in range(120)]
    assert calls.value == 40 and committed(spark, store).count() == 40 == committed(spark, store).select(KEY).distinct().count()
    # A batch that was written but never entered the log does not count.
    committed(spark, store).write.parquet(f"{store}/batch-lost")
    assert compact(spark, store) == 40 and committed(spark, store).count() == 40
    assert [p.name for p in (tmp_path / "store").glob("batch-*")] == [batches_of(spark, store)[0]]
