import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from sitewise.operators import groups as G
from sitewise.operators import joins as J
from sitewise.operators import ordering as O


@pytest.fixture(scope="module")
def skewed(spark):
    """One key holds most rows; values repeat; one value is missing."""
    rng = np.random.default_rng(3)
    n = 3000
    pdf = pd.DataFrame({"k": np.where(rng.random(n) < 0.7, 0, rng.integers(1, 40, n)), "x": rng.integers(0, 50, n) / 4.0,
                        "y": rng.normal(size=n).round(1), "i": np.arange(n)})
    return pdf, spark.createDataFrame(pdf).withColumn("x", F.when(F.col("i") != 5, F.col("x")))


def test_running_and_positions(skewed):
    pdf, df = skewed
    got = O.running(df.drop("x"), ["k"], ["y", "i"], {"t": ("sum", F.col("i")), "m": ("min", F.col("i")), "n": ("sum", F.lit(1))}).toPandas()
    want = pdf.sort_values(["k", "y", "i"])
    g = want.groupby("k")["i"]
    want = want.assign(t=g.cumsum(), m=g.cummin(), n=g.cumcount() + 1)
    both = got.merge(want, on="i", suffixes=("", "_w"))
    assert len(both) == len(pdf)
    for c in ("t", "m", "n"):
        assert (both[c] == both[f"{c}_w"]).all()


def test_quantiles_exact(skewed):
    pdf, df = skewed
    part = pdf[pdf.i != 5]
    got = O.quantiles(df, ["k"], "x", {"a": 0.1, "b": 0.5, "c": 1.0}).toPandas().set_index("k")
    want = part.groupby("k")["x"].quantile([0.1, 0.5, 1.0]).unstack()
    assert np.allclose(got.loc[want.index, ["a", "b", "c"]], want)
    one = O.quantiles(df, [], "x", {"m": 0.37}).first().m
    assert one == pytest.approx(part.x.quantile(0.37))


def test_weighted_quantile_repeats_values(spark):
    df = spark.createDataFrame([(1.0, 3), (2.0, 0), (5.0, 2)], "x double, w int")
    assert O.quantiles(df, [], "x", {"m": 0.5}, weight=F.col("w")).first().m == 1.0
    assert O.quantiles(df, [], "x", {"m": 0.625}, weight=F.col("w")).first().m == pytest.approx(3.0)


def test_spearman_with_ties(skewed):
    pdf, df = skewed
    part = pdf[pdf.i != 5]
    assert O.spearman_frame(df, [], "x", "y").first().spearman == pytest.approx(part[["x", "y"]].corr("spearman").iloc[0, 1])
    got = {r.k: r.spearman for r in O.spearman_frame(df.where("k < 3"), ["k"], "x", "y").collect()}
    for k in (0, 1, 2):
        assert got[k] == pytest.approx(part[part.k == k][["x", "y"]].corr("spearman").iloc[0, 1])


def test_components_match_union_find(spark):
    rng = np.random.default_rng(1)
    rows = [(f"n{rng.integers(0, 300):03d}", int(rng.integers(0, 260))) for _ in range(400)]
    rows += [(f"n{i:03d}", 999) for i in range(100, 160)] + [("p%03d" % i, 5000 + i // 2) for i in range(80)] + [("p%03d" % (i + 1), 5000 + i // 2) for i in range(80)]
    parent: dict = {}

    def find(a):
        parent.setdefault(a, a)
        while parent[a] != a:
            a = parent[a]
        return a

    first: dict = {}
    for n, v in rows:
        a, b = find(n), find(first.setdefault(v, n))
        parent[max(a, b)] = min(a, b)
    df = spark.createDataFrame(rows, "node string, v int")
    got = {r.node: r.component for r in G.connected_components(df, G.shared_value_edges(df, "node", "v")).collect()}
    assert got == {n: find(n) for n, _ in rows}


def test_joint_groups_keep_missing_nodes_together(spark):
    df = spark.createDataFrame([(1, None, "a"), (2, None, "b"), (3, "g", "b"), (4, "h", "c")], "i int, gene string, seq string")
    got = {r.i: r.joint_group for r in G.joint_groups(df, "gene", "seq").collect()}
    assert got[1] == got[2] == got[3] == "G00001" and got[4] == "G00002"


def test_folds_and_split_never_part_a_group(spark):
    rng = np.random.default_rng(5)
    df = spark.createDataFrame([(int(g),) for g in rng.zipf(1.5, 2000) % 60], "g int")
    f = G.group_folds(df, "g", 5).toPandas()
    assert f.g.is_unique and set(f.fold) == {1, 2, 3, 4, 5}
    load = f.groupby("fold")["size"].sum()
    assert load.max() - load.min() <= f["size"].max()
    s = G.snake_folds(df, "g", 5).toPandas()
    assert s.g.is_unique and s["size"].sum() == 2000
    nulls = df.unionAll(spark.createDataFrame([(None,)] * 9, "g int"))
    assert G.with_folds(nulls, "g", 5).count() == 2009
    with pytest.raises(ValueError):
        G.group_folds(df.where("g < 2"), "g", 5)
    split = G.group_split(df, "g", 0.2, 1).toPandas()
    test = split[split.split == "test"]["size"].sum()
    assert abs(test - 400) <= split["size"].max()


def test_join_contracts(spark):
    a = spark.createDataFrame([(1, "x"), (1, "y")], "k int, v string")
    b = spark.createDataFrame([(1, 2.0)], "k int, w double")
    assert J.checked_join(a, b, ["k"], validate="many_to_one").count() == 2
    with pytest.raises(J.ContractError):
        J.checked_join(a, b, ["k"])
    with pytest.raises(J.ContractError):
        J.replicate_outer_join(a, a, ["k"], ["v"])


@pytest.mark.parametrize("folds", [1, 2, 3, 5])
def test_runs_of_equal_sizes_are_dealt_like_single_groups(folds):
    rng = np.random.default_rng(folds)
    for _ in range(200):
        sizes = sorted(rng.integers(1, rng.integers(2, 60), rng.integers(1, 80)).tolist(), reverse=True)
        counts = [(s, sizes.count(s)) for s in sorted(set(sizes), reverse=True)]
        load, want = [0] * folds, []
        for s in sizes:
            f = min(range(folds), key=lambda k: (load[k], k))
            load[f] += s
            want.append(f + 1)
        phases, got = G._phases(counts, folds), []
        for s, many in counts:
            for i in range(many):
                first, turn = [(a, t) for size, a, t in phases if size == s and a <= i][-1]
                got.append(turn[(i - first) % len(turn)])
        assert got == want


def test_largest_to_lightest_deal(spark):
    rows = [(f"g{i % 23}" if i % 23 else None,) for i in range(400)] + [("one",), ("two",)]
    out = G.lightest_folds(spark.createDataFrame(rows, "g string"), "g", 4).collect()
    assert len(out) == 25 and sum(r["size"] for r in out) == len(rows)
    load = [sum(r["size"] for r in out if r.fold == f) for f in (1, 2, 3, 4)]
    assert max(load) - min(load) <= max(r["size"] for r in out)
    assert G.lightest_folds(spark.createDataFrame([], "g string"), "g", 4).collect() == []
