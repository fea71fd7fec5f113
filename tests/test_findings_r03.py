"""Ties, wide labels and bounded steps that larger tables brought to light."""

import hashlib
import tracemalloc
from collections import Counter

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from sitewise import catalog, session
from sitewise.functions import vectors as V
from sitewise.functions.sequences import kmer_fractions, kmer_names
from sitewise.operators import aggregates as A
from sitewise.operators import inference as N
from sitewise.operators import intervals as I
from sitewise.operators import linear as L
from sitewise.operators import ordering
from sitewise.operators import resample as R
from sitewise.operators.lift import classify_lift, lift, round_trip
from sitewise.operators.variants import Variant, variant_fits
from sitewise.plans import dataset as D


def both(spark, folder, name):
    """Rows of a query and of its SQL over the parquet files in ``folder``."""
    con = duckdb.connect()
    for path in folder.iterdir():
        con.execute(f"create view {path.stem} as select * from '{path}'")
    want = con.execute(catalog.oracle_sql()[name]).df()
    got = catalog.queries()[name](spark, str(folder)).toPandas()[list(want.columns)]
    return sorted(got.itertuples(index=False, name=None)), sorted(want.itertuples(index=False, name=None))


# Hundredths whose mean is exactly 5.1; as doubles, the first list adds up to just above and the second to just below.
TIES = [[1, 3, 10, 9, 7, 6, 2, 8, 5, 1, 4, 1, 10, 6, 1, 7, 8, 4, 1, 8], [5, 10, 8, 3, 1, 4, 0, 4, 9, 3, 8, 1, 6, 5, 6, 1, 9, 8, 8, 3]]


@pytest.mark.parametrize("name", ["gate_evaluation", "overall_gate_status"])
def test_a_mean_on_the_gate_does_not_depend_on_row_order(spark, tmp_path, name):
    # Supplier 7 passes; the others sit on the limit and must not.
    rows = [(14 + 7 * i, x / 100) for i, v in enumerate(TIES) for x in v] + [(7, 0.05)] * 3
    pd.DataFrame(rows, columns=["l_suppkey", "l_discount"]).to_parquet(tmp_path / "lineitem.parquet")
    got, want = both(spark, tmp_path, name)
    assert got == want
    assert got == ([("g14", "FAIL"), ("g21", "FAIL"), ("g7", "PASS")] if name == "gate_evaluation" else [(3, 2, "FAIL")])


@pytest.mark.parametrize("name", ["joint_groups", "joint_group_split"])
def test_labels_beyond_five_digits_stay_apart(spark, tmp_path, name):
    n = 100_001
    pd.DataFrame({"doc_id": [4 * i for i in range(n)], "text": [f"t{i}" for i in range(n)]}).to_parquet(tmp_path / "documents.parquet")
    got, want = both(spark, tmp_path, name)
    assert got == want and len({r[-1 if name == "joint_groups" else 0] for r in got}) == n


def test_kmer_counts_need_memory_for_a_block_not_for_a_batch():
    letters = "ACGTTGCAN" * 500
    texts = pd.Series([letters[i % 7:i % 4400] for i in range(4000)] + [None, "", "AC"])
    fractions = kmer_fractions(3).func
    tracemalloc.start()
    got = fractions(texts)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    # One pass over all 8.8 million letters took some 350 MB.
    assert peak < 60e6
    names = kmer_names(3)
    for i in (0, 9, 1234, 3999, 4000, 4001, 4002):
        seq = texts[i] or ""
        pieces = [seq[j:j + 3] for j in range(len(seq) - 2)]
        assert list(got[i]) == [pieces.count(k) / max(len(pieces), 1) for k in names]


def test_masks_count_measured_positions(spark):
    rows = [(i, [None if (j * 7 + i) % 5 < 2 else 1.0 for j in range(n)]) for i, n in enumerate((0, 1, 31, 32, 33, 64, 100))]
    df = spark.createDataFrame(rows, "id int, v array<double>").withColumn("m", V.measured_mask(F.col("v")))
    got = df.select("id", "v", F.expr("sequence(0, size(v))").alias("at"), "m").withColumn("k", F.explode("at")) \
        .select("v", "k", V.measured_upto(F.col("m"), F.col("k")).alias("n")).collect()
    assert len(got) == sum(len(v) + 1 for _, v in rows) and all(r.n == sum(x is not None for x in r.v[:r.k]) for r in got)


@pytest.mark.parametrize("disjoint", [True, False])
def test_narrow_candidates_rank_and_choose_like_wide_ones(spark, disjoint):
    genes = ["a", "b", "", "c"]
    sites = spark.createDataFrame(
        [("1", p, s, "a;c" if p % 2 else "", p % 3 > 0, 1.0 + p, 2.0, 3.0, 4.0 + p) for p in range(1, 90, 3) for s in "+-"],
        "chrom string, pos long, strand string, genes string, detected_both_replicates boolean, acov_rep1 double, acov_rep2 double, agcov_rep1 double, agcov_rep2 double")
    spans = [(t, 1 + t % 7, 40 + t * 3 % 50) for t in range(24)] + ([] if disjoint else [(t, 20, 30 + t) for t in range(0, 24, 3)])
    exons = spark.createDataFrame([("1", a, b, "+" if t % 2 else "-", t, genes[t % 4], 1 + 5 * (a == 20)) for t, a, b in spans],
                                  "chrom string, start long, end long, strand string, tid long, gene_name string, tx_start long")
    vectors = spark.createDataFrame([(t, [None if (i * i + t // 4) % 4 == 0 else i / 7 for i in range(20 + t * 5)]) for t in range(24) if t != 11],
                                    "tid long, values array<double>")
    params = D.DatasetParams(flank=4, display=9, bin_size=64, disjoint_exons=disjoint)
    wide = D.map_sites(sites, exons, vectors, params)
    ranks = [*D.KEY, "tid", "isoform_rank", "isoform_count", "representative_isoform"]
    old = D.isoform_table(wide).select(ranks).collect()
    assert sorted(D.isoform_ranks(D.candidates(sites, exons, vectors, params)).select(ranks).collect()) == sorted(old) and len(old) > 300
    table = D.site_table(wide, params)
    best = D.site_table(D.best_sites(sites, exons, vectors, params), params)
    assert sorted(map(str, best.select(table.columns).collect())) == sorted(map(str, table.collect()))


def test_isoform_ranks_shuffle_no_vectors(spark, tmp_path):
    sites = spark.createDataFrame([("1", 5, "+", "a")], "chrom string, pos long, strand string, genes string")
    exons = spark.createDataFrame([("1", 1, 9, "+", 1, "a", 1)], "chrom string, start long, end long, strand string, tid long, gene_name string, tx_start long")
    vectors = spark.createDataFrame([(1, [1.0] * 9)], "tid long, values array<double>")
    found = D.candidates(sites, exons, vectors, D.DatasetParams(flank=2, display=3))
    assert found.columns == [*D.KEY, "tid", "_order"] and found.first()._order == 0


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_pieces_of_an_interval_meet_in_one_shuffle(spark):
    peaks = spark.createDataFrame([("a", "1", "+", 3, 30), ("b", "1", "+", 0, 4), ("c", "1", "-", 0, 90)], "peak string, chrom string, strand string, start0 long, end0 long")
    # The third exon repeats the second: its piece counts once.
    exons = spark.createDataFrame([("1", 1, 9, "+", 1, 1), ("1", 20, 25, "+", 1, 10), ("1", 20, 25, "+", 1, 10), ("1", 50, 59, "-", 2, 1)],
                                  "chrom string, start long, end long, strand string, tid long, tx_start long")
    vectors = spark.createDataFrame([(1, [float(i) if i != 12 else None for i in range(1, 16)]), (2, [1.0] * 10)], "tid long, values array<double>")
    out = I.spliced_interval_features(peaks, exons, vectors, "peak", 2)
    got = {r.peak: (r.tid, r.peak_tx_start, r.peak_tx_end, r.peak_exonic_nt, r.peak_valid_count, r.peak_mean) for r in out.collect()}
    inner = [4, 5, 6, 7, 8, 9, 10, 11, 13, 14, 15]
    assert got == {"a": (1, 4, 15, 12, 11, round(sum(inner) / 11, 8)), "b": (1, 1, 4, 4, 4, 2.5), "c": (2, 1, 10, 10, 10, 1.0)}
    assert plan_of(out).split("== Initial Plan ==")[0].count("Exchange hashpartitioning(peak#") == 1


def test_draws_of_few_groups_are_spread_over_tasks(spark, monkeypatch):
    monkeypatch.setattr(R, "DRAWS_PER_TASK", 50)
    groups = spark.range(10).coalesce(1).withColumnRenamed("id", "_g")
    counts = R.draw_counts(groups, 20, 5)
    assert "RoundRobinPartitioning(4)" in plan_of(counts)
    want = Counter((r, int(hashlib.md5(f"5|{r}|{i}".encode()).hexdigest()[:8], 16) % 10) for r in range(20) for i in range(10))
    assert {(r.rep, r["_g"]): r.weight for r in counts.collect()} == want


def test_only_hits_of_overlapping_exons_are_shuffled(spark):
    points = spark.createDataFrame([("1", p, "+") for p in (3, 8, 8, 22, 40)], "chrom string, pos long, strand string")
    exons = spark.createDataFrame([("1", 1, 9, "+", 1, 1), ("1", 20, 29, "+", 1, 10), ("1", 1, 9, "+", 2, 30), ("1", 5, 25, "+", 2, 7), ("1", 40, 40, "+", 2, 50)],
                                  "chrom string, start long, end long, strand string, tid long, tx_start long")
    hits = I.map_to_transcripts(points, exons, ["chrom", "pos", "strand"])
    # Of transcript 2, position 8 lies in two exons and takes the one that starts at 7; a repeated point counts once.
    assert sorted((r.tid, r.pos, r.tx_start, r.tx_pos) for r in hits.collect()) == [
        (1, 3, 1, 3), (1, 8, 1, 8), (1, 22, 10, 12), (2, 3, 30, 32), (2, 8, 7, 10), (2, 22, 7, 24), (2, 40, 50, 50)]
    assert "Union" in plan_of(hits)


def images(points, blocks):
    """Targets of each point with their best score, in plain Python."""
    out = {}
    for c, p, s in points:
        for sc, ss, se, tc, ts, te, strand, score in blocks:
            if c == sc and ss < p <= se:
                at = ts + p - ss if strand == "+" else te - (p - 1 - ss)
                key = (tc, at, s if strand == "+" else {"-": "+"}.get(s, "-"))
                out.setdefault((c, p, s), {})
                out[c, p, s][key] = max(score, out[c, p, s].get(key, 0))
    return out


@pytest.mark.parametrize("width", [16, 64])  # blocks at one level, at two
def test_lifts_are_dealt_into_tasks_by_rows(spark, monkeypatch, width):
    monkeypatch.setattr(session, "ROWS_PER_TASK", 20)
    blocks = [(f"c{i % 2}", 40 * i, 40 * i + 30 + i % 3 * 30, f"c{(i + 1) % 2}", 35 * i, 35 * i + 30 + i % 3 * 30, "+-"[i % 2], 5 + i % 4) for i in range(12)]
    blocks += [(*b[:-1], 1) for b in blocks[:6]]  # repeated blocks with a lower score
    points = [(f"c{p % 2}", p, s) for p in range(1, 500, 4) for s in "+-"]
    key = ["chrom", "pos", "strand"]
    b = spark.createDataFrame(blocks, "source_chrom string, source_start long, source_end long, target_chrom string, target_start long, target_end long, target_strand string, score int")
    df = spark.createDataFrame([*points, ("c1", 41, None)], "chrom string, pos long, strand string")
    there = images(points, blocks)
    back = {p for p, found in there.items() if any(p in images([t], [(tc, ts, te, sc, ss, se, st, n) for sc, ss, se, tc, ts, te, st, n in blocks]).get(t, {}) for t in found)}
    tasks = session.tasks_for(df)
    assert tasks == 13  # 251 rows, where the session has 4 partitions
    out = round_trip(df, b, key, width)
    # No gathering of images; every shuffle, those of the interval joins too, goes by the rows.
    plan = plan_of(out)
    assert "Aggregate" not in plan and "Broadcast" not in plan and plan.count("Exchange hashpartitioning(") == plan.count(", 13), ") == 6
    assert sorted(tuple(r) for r in out.collect()) == sorted(back) and 20 < len(back) < len(points)
    lifted = lift(df.where("strand is not null"), b, key, "forward", width, tasks)
    plan = plan_of(classify_lift(df, lifted, key))
    assert "Broadcast" not in plan and plan.count("Exchange hashpartitioning(") == plan.count(", 13), ")
    assert {(*r[:3], *r[3:6], r.score) for r in lifted.collect()} == {(*p, *t, n) for p, found in there.items() for t, n in found.items()}


def test_strata_are_not_shuffled_by_their_few_keys(spark, monkeypatch):
    rows = [("ab"[i % 3] if i % 3 < 2 else None, i % 7, float(i * i % 11), float(i * 5 % 13) + i % 3) for i in range(120)]
    df = spark.createDataFrame(rows, "s string, g int, x double, y double")
    design, plans, meats = L.Design(["Intercept", "x"], [F.lit(1.0), F.col("x")]), [], L._meats
    monkeypatch.setattr(L, "_meats", lambda df, *a: plans.append(plan_of(df)) or meats(df, *a))
    got = {r["analysis"]: (r["sites"], r["clusters"], round(r["beta_raw"], 9)) for r in N.stratified_fits(df, "s", design, "y", "x", "g", 2, 2)}
    # Both joins, with the strata that are fitted and with their coefficients, leave the rows where they are.
    assert len(plans) == 1 and "Exchange hashpartitioning" not in plans[0] and plans[0].count("BroadcastHashJoin") == 2
    for s in ("a", "b", None):
        part = [r for r in rows if r[0] == s]
        slope = np.polyfit([r[2] for r in part], [r[3] for r in part], 1)[0]
        assert got[f"s_{s}"] == (40, 7, round(slope, 9))


def test_pieces_of_quantiles_follow_the_distinct_values(spark, monkeypatch):
    monkeypatch.setattr(session, "ROWS_PER_TASK", 20)
    pieces, kept = [], ordering.checkpointed
    monkeypatch.setattr(ordering, "checkpointed", lambda df: pieces.extend([df.rdd.getNumPartitions()] if "_part" in df.columns else []) or kept(df))
    rows = [("ab"[i % 2] if i % 5 else None, float(i * i % 331) / 7) for i in range(600)]
    got = ordering.quantiles(spark.createDataFrame(rows, "g string, v double"), ["g"], "v", {"q50": 0.5, "q90": 0.9}).collect()
    # Of some 300 distinct pairs, 20 to a piece; the session has 4 partitions.
    assert len(pieces) == 1 and pieces[0] > 8
    for r in got:
        assert np.allclose([r.q50, r.q90], np.quantile([v for g, v in rows if g == r.g], [0.5, 0.9]))
    assert len(got) == 3


def test_sums_of_many_clusters_are_not_sorted(spark, monkeypatch):
    rows = [(i % 401 if i % 7 else None, float(i * i % 11) if i % 13 else None, float(i * 5 % 17) + i % 3, float(i * 3 % 7), i % 4, 1.0 + i % 5) for i in range(2000)]
    df = spark.createDataFrame(rows, "g int, x double, y double, z double, k int, w double")
    plans, kind = [], type(df)
    through = kind.mapInPandas
    monkeypatch.setattr(kind, "mapInPandas", lambda df, *a: plans.append(plan_of(df)) or through(df, *a))
    family = [Variant("all", "y", "x"), Variant("some", "y", "x", F.col("k") > 0, F.col("w")), Variant("turned", "z", "y", F.col("k") < 3)]
    fits = variant_fits(df, L.Design(["Intercept", "z"], [F.lit(1.0), F.col("z")]), family[:2], "g") + variant_fits(df, L.Design(["Intercept"], [F.lit(1.0)]), family[2:], "g")
    # An aggregate of objects sorts all rows of a task once it has met 128 clusters.
    summed = [p for p in plans if "Aggregate" in p]
    assert len(summed) == 2 and not any("ObjectHashAggregate" in p or "SortAggregate" in p for p in summed)
    whole = pd.DataFrame(rows, columns=["g", "x", "y", "z", "k", "w"])
    for f, part, design, y, weighted in ((fits[0], whole, ["x", "z"], "y", False), (fits[1], whole[whole.k > 0], ["x", "z"], "y", True), (fits[2], whole[whole.k < 3], ["y"], "z", False)):
        part = part.dropna(subset=[*design, y])
        x, w = np.column_stack([np.ones(len(part)), part[design]]), part.w.to_numpy() if weighted else np.ones(len(part))
        bread = np.linalg.inv(x.T * w @ x)
        beta = bread @ (x.T * w @ part[y].to_numpy())
        scores = pd.DataFrame(x * (w * (part[y].to_numpy() - x @ beta))[:, None]).groupby(part.g.fillna(-1).to_numpy()).sum().to_numpy()
        n, g = len(part), len(scores)
        cov = bread @ scores.T @ scores @ bread * g / (g - 1) * (n - 1) / (n - x.shape[1])
        assert (f.fit.n, f.fit.clusters) == (n, g) and np.allclose(f.fit.beta, beta) and np.allclose(f.fit.cov, cov)


def test_sizes_of_many_groups_are_joined_without_a_sort(spark):
    df = spark.createDataFrame([(i % 301 if i % 7 else None, i) for i in range(1000)], "g int, v int")
    out = A.group_size(df, ["g"], "n", many=True)
    plan = plan_of(out)
    assert "ShuffledHashJoin" in plan and "SortMergeJoin" not in plan and "Sort [" not in plan
    want = Counter(i % 301 if i % 7 else None for i in range(1000))
    assert sorted((r.v, r.n) for r in out.collect()) == [(i, want[i % 301 if i % 7 else None]) for i in range(1000)]
