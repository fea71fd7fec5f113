import math

import pytest
from pyspark.sql import functions as F

from sitewise.functions import scalars as S
from sitewise.functions import sequences as Q
from sitewise.functions import vectors as V


def one(spark, schema, row, **cols):
    return spark.createDataFrame([row], schema).select(*[c.alias(n) for n, c in cols.items()]).first().asDict()


def test_transcript_arithmetic_both_strands(spark):
    exons = [("+", 100, 109, 1), ("+", 200, 209, 11), ("-", 200, 209, 1), ("-", 100, 109, 11)]
    df = spark.createDataFrame(exons, "strand string, s long, e long, t long")
    pos = S.tx_to_genome(F.col("s"), F.col("e"), F.col("strand"), F.col("t"), F.lit(12))
    got = {r.strand: r.g for r in df.where("t = 11").select("strand", pos.alias("g")).collect()}
    assert got == {"+": 201, "-": 108}
    back = S.genome_to_tx(F.col("s"), F.col("e"), F.col("strand"), F.col("t"), F.col("g"))
    rows = df.where("t = 11").withColumn("g", pos).select(back.alias("b")).collect()
    assert [r.b for r in rows] == [12, 12]


def test_flank_coverage_ignores_the_centre(spark):
    values = [float(i) for i in range(1, 22)]
    values[10] = None
    cov = V.flank_coverage(F.col("v"), F.lit(11), 10)
    got = one(spark, "v array<double>", (values,), l=cov[0], r=cov[1], b=cov[2], m=V.flank_mean(F.col("v"), F.lit(11), 10))
    assert (got["l"], got["r"], got["b"]) == (1.0, 1.0, 1.0)
    assert got["m"] == 11.0


def test_incomplete_flank_is_null_or_zero(spark):
    df = ([1.0, None, 3.0, 4.0, 5.0],)
    a = V.flank_coverage(F.col("v"), F.lit(2), 3)
    z = V.flank_coverage_zero(F.col("v"), F.lit(2), 3)
    got = one(spark, "v array<double>", df, a0=a[0], a1=a[1], a2=a[2], z0=z[0], z1=z[1], z2=z[2])
    assert got["a0"] is None and got["a1"] == 1.0 and got["a2"] is None
    assert (got["z0"], got["z1"], got["z2"]) == (0.0, 1.0, 0.5)


def test_window_vector_pads_with_null(spark):
    w = V.window_vector(F.col("v"), F.lit(1), 2)
    got = one(spark, "v array<double>", ([0.1234567, None, 3.0],), w=w, m=V.mask_of(w))
    assert got["w"] == [None, None, 0.123457, None, 3.0]
    assert got["m"] == [0, 0, 1, 0, 1]


def test_probability_features_far_region_and_entropy(spark):
    p = [0.5] * 201
    f = V.probability_features(F.col("p"), 100)
    got = one(spark, "p array<double>", (p,), **f)
    assert got["mean_pairing_state_entropy"] == pytest.approx(math.log(2))
    assert got["predicted_unpaired_mean_far"] == 0.5
    p = [0.0] * 50 + [1.0] * 40 + [0.0] * 21 + [1.0] * 40 + [0.0] * 50
    got = one(spark, "p array<double>", (p,), **f)
    assert got["predicted_unpaired_mean_far"] == 0.0 and got["predicted_unpaired_mean_flank"] == 1.0


@pytest.mark.parametrize("motif,want", [("GGACT", "GGACT"), ("CGACT", "non_DRACH"), ("GGAC", "window_unavailable"), ("", "window_unavailable")])
def test_motif_class(spark, motif, want):
    assert one(spark, "m string", (motif,), c=Q.motif_class(F.col("m")))["c"] == want


def test_kmers_overlap_and_skip_unknown_letters(spark):
    seqs = ["AAAA", "ACGNACG", "AC", "", None, "acg"]
    df = spark.createDataFrame([(i, s) for i, s in enumerate(seqs)], "i int, s string")
    names = Q.kmer_names()
    got = {r.i: dict(zip(names, r.v)) for r in df.select("i", Q.kmer_fractions()("s").alias("v")).collect()}
    assert got[0]["AAA"] == 1.0
    assert got[1]["ACG"] == pytest.approx(2 / 5) and sum(got[1].values()) == pytest.approx(2 / 5)
    assert sum(got[2].values()) == sum(got[3].values()) == sum(got[4].values()) == 0
    assert got[5]["ACG"] == 1.0
    rows = df.where("i in (0, 2, 3)").select("i", Q.kmers(F.col("s")).alias("k")).collect()
    assert {r.i: r.k for r in rows} == {0: ["AAA", "AAA"], 2: [], 3: []}


def test_sequence_window_edges(spark):
    cols = {f"w{p}": Q.seq_window(F.col("s"), F.lit(p), 2) for p in (2, 3, 5, 6)}
    got = one(spark, "s string", ("ABCDEFG",), **cols)
    assert got == {"w2": "", "w3": "ABCDE", "w5": "CDEFG", "w6": ""}


def test_missing_tokens_and_casts(spark):
    rows = [(x,) for x in ["", "NA", "-999", "1.5", "x", "NaN", None]]
    df = spark.createDataFrame(rows, "x string").select(S.lenient_double(S.null_tokens(F.col("x"))).alias("y"))
    assert [r.y for r in df.collect()] == [None, None, None, 1.5, None, None, None]


def test_right_and_left_closed_bins(spark):
    edges = F.array(*[F.lit(float(e)) for e in (0, 1, 2, 3)])
    df = spark.createDataFrame([(float(x),) for x in (0, 1, 1.5, 3, 4)], "x double")
    got = df.select(S.bin_right_closed(F.col("x"), edges).alias("r"), S.bin_left_closed(F.col("x"), F.array(F.lit(1.0), F.lit(2.0))).alias("l")).collect()
    assert [r.r for r in got] == [1, 1, 2, 3, None]
    assert [r.l for r in got] == [1, 2, 2, 3, 3]


def test_backfill_creates_only_what_is_absent(spark):
    df = spark.createDataFrame([(1, 2, 10, 20, "chr1", 5, "+", "ELSE", "G1", "E1", "kept")],
                               "acov_rep1 int, acov_rep2 int, agcov_rep1 int, agcov_rep2 int, chrom string, pos int, strand string, "
                               "genes string, transcript_gene_name string, transcript_gene_id string, site_id string")
    row = S.backfill(df, S.site_derivations()).first()
    assert row.combined_ratio == pytest.approx(0.1) and row.site_id == "kept" and row.analysis_gene == "G1"


def test_json_array_of_wrong_length_raises(spark):
    df = spark.createDataFrame([("[1,2,null]",)], "a string")
    assert df.select(V.parse_array_json(F.col("a"), 3).alias("a")).first().a == [1.0, 2.0, None]
    with pytest.raises(Exception, match="expected 4"):
        df.select(V.parse_array_json(F.col("a"), 4).alias("a")).collect()
