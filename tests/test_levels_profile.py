"""Intervals of any length, profiles in one scan and flank counts by prefix sums, against plain Python."""

import random

from pyspark.sql import functions as F

from sitewise.operators.aggregates import column_profile, low_cardinality_counts
from sitewise.operators.intervals import interval_overlap, point_in_interval
from sitewise.operators.matching import eligibility, eligible_positions

AXIS = 1 << 40


def _intervals(rng, n, name):
    rows = [(f"{name}{i}", rng.choice("xy"), s := rng.randrange(1, 200_000), s + rng.choice([0, 9, 300, 20_000, 150_000, 3_000_000])) for i in range(n)]
    return [*rows, (f"{name}all", "x", 1, AXIS), (f"{name}none", None, 1, 5)]


def test_intervals_of_every_length_meet_once(spark):
    rng = random.Random(1)
    a, b = _intervals(rng, 60, "a"), _intervals(rng, 60, "b")
    left = spark.createDataFrame(a, "a string, chrom string, s long, e long")
    right = spark.createDataFrame(b, "b string, chrom string, s2 long, e2 long")
    found = interval_overlap(left, right, ["chrom"], ("s", "e"), ("s2", "e2"), 1024).select("a", "b").collect()
    assert sorted(map(tuple, found)) == sorted((x[0], y[0]) for x in a for y in b if x[1] and x[1] == y[1] and x[2] <= y[3] and y[2] <= x[3])


def test_points_meet_intervals_of_every_length(spark):
    rng = random.Random(2)
    a = [(i, rng.choice("xyz"), rng.randrange(1, 400_000)) for i in range(80)] + [(900, "x", AXIS), (901, "x", AXIS + 1), (7, "z", 3)]
    b = [r for r in _intervals(rng, 40, "b")]
    points = spark.createDataFrame(a, "p long, chrom string, pos long")
    spans = spark.createDataFrame(b, "b string, chrom string, start long, end long")
    pairs = sorted((x[0], y[0]) for x in a for y in b if x[1] == y[1] and y[2] <= x[2] <= y[3])
    found = point_in_interval(points, spans, ["chrom"], bin_size=1024)
    assert sorted((r["p"], r["b"]) for r in found.collect()) == pairs
    hit = [r for r in a if any(r[1] == y[1] and y[2] <= r[2] <= y[3] for y in b)]
    semi = point_in_interval(points, spans, ["chrom"], bin_size=1024, how="left_semi")
    anti = point_in_interval(points, spans, ["chrom"], bin_size=1024, how="left_anti")
    assert sorted(map(tuple, semi.collect())) == sorted(hit)
    assert sorted(map(tuple, anti.collect())) == sorted(r for r in a if r not in hit)
    assert point_in_interval(points, spans.limit(0), ["chrom"]).isEmpty()


def test_profile_counts_values_of_narrow_columns_only(spark):
    rows = [(i % 3 if i % 7 else None, float("nan") if i % 5 == 0 else 0.5, f"v{i}", "NA" if i % 2 else "yes") for i in range(200)]
    df = spark.createDataFrame(rows, "k int, x double, wide string, t string").repartition(5)
    names = ["k", "x", "wide", "t"]
    found = {(r["column"], r["value"]): r["count"] for r in low_cardinality_counts(df, names, 3).collect()}
    plain = {}
    for k, x, _, t in rows:
        for at in (("k", None if k is None else str(k)), ("x", None if x != x else "0.5"), ("t", None if t == "NA" else t)):
            if at[1] is not None:
                plain[at] = plain.get(at, 0) + 1
    assert found == plain
    assert low_cardinality_counts(df, names, 2).select("column").distinct().count() == 2
    assert low_cardinality_counts(df.limit(0), names).isEmpty()
    profile = {r["column"]: r for r in column_profile(df, names).collect()}
    assert (profile["k"]["missing"], profile["x"]["numeric"], profile["t"]["missing"], profile["wide"]["rows"]) == (29, 160, 100, 200)
    assert column_profile(df.limit(0), ["k"]).first()["rows"] == 0


def test_flank_counts_match_counting(spark):
    rng = random.Random(3)
    flags = {key: [rng.random() < 0.7 for _ in range(n)] for key, n in (("a", 90), (None, 31), ("short", 4))}
    df = spark.createDataFrame([(k, i + 1, v) for k, f in flags.items() for i, v in enumerate(f)], "k string, pos long, v boolean")
    got = {(r["k"], r["pos"]): (r["valid_left"], r["valid_right"], r["eligible"]) for r in eligibility(df, ["k"], "pos", F.col("v"), 5, 0.7, F.col("pos") % 9 == 0).collect()}
    for k, f in flags.items():
        for p in range(1, len(f) + 1):
            left, right = sum(f[max(0, p - 6):p - 1]), sum(f[p:p + 5])
            assert got[k, p] == (left, right, 5 < p <= len(f) - 5 and left >= 4 and right >= 4 and p % 9 != 0)
    assert len(got) == df.count()
    arrays = spark.createDataFrame([(1, [1.0 if v else None for v in flags["a"]], "ACGT" * 30, [9, 20]), (2, None, "A", [1]), (3, [1.0] * 4, "ACGT", [])], "id long, v array<double>, s string, x array<int>")
    rows = {r["id"]: [tuple(e) for e in r["e"]] for r in arrays.select("id", eligible_positions(F.col("v"), F.col("s"), F.col("x"), 5, 0.7).alias("e")).collect()}
    f = flags["a"]
    assert rows == {1: [(p, "ACGT"[(p - 1) % 4]) for p in range(6, 86) if p not in (9, 20) and sum(f[p - 6:p - 1]) >= 4 and sum(f[p:p + 5]) >= 4], 2: [], 3: []}
