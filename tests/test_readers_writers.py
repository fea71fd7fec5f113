import gzip
import io
import tarfile
from datetime import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from sitewise.functions.sequences import base_at
from sitewise.operators import quality as K
from sitewise.operators.lift import classify_lift, lift, round_trip
from sitewise.sources import readers as R
from sitewise.sources import writers as W


def gz(path, text):
    with gzip.open(path, "wt") as f:
        f.write(text)
    return str(path)


def test_site_table(spark, tmp_path):
    head = "Chr\tSites\tStrand\tGene\tTranscript\tNonCR\tAGcov\tAcov\tGenecov\tRatio\tNormeRatio\tPvalue\tP_adjust\tSample\n"
    p = gz(tmp_path / "s.tsv.gz", head + "1\t10\t+\tELSE\tT\t0.1\t20\t5\tNA\t0.25\t0.225\t0.01\t0.02\tA\n")
    row = R.site_keys(R.read_site_table(spark, p)).first()
    assert (row.chrom, row.pos, row.strand, row.AGcov, row.Genecov) == ("chr1", 10, "+", 20, None)


def test_signal_vectors_plain_archive_and_selected(spark, tmp_path):
    text = "T1.1\t3\t5.5\t0.5\tNULL\t-999\nT2\t2\t*\t1\t2\nT3\t4\t1\tNA\tNA\tNA\n"
    p = gz(tmp_path / "v.txt.gz", text)
    rows = {r.tid: r for r in R.read_signal_vectors(spark, p).withColumn("a", R.abundance_value(F.col("abundance"))).collect()}
    assert rows["T1.1"]["values"] == [0.5, None, None] and rows["T2"].a is None and rows["T1.1"].a == 5.5
    with tarfile.open(tmp_path / "a.tar", "w") as tar:
        data = gzip.compress(text.encode())
        info = tarfile.TarInfo("m.gz")
        info.size = len(data)
        tar.addfile(info, io.BytesIO(data))
    assert R.read_archive_member(spark, str(tmp_path / "a.tar"), "m.gz").count() == 3
    ids = spark.createDataFrame([("T2",)], "tid string")
    assert [r.tid for r in R.read_selected_vectors(spark, p, ids).collect()] == ["T2"]
    with pytest.raises(Exception, match="length mismatch"):
        R.read_selected_vectors(spark, p, spark.createDataFrame([("T3",)], "tid string")).collect()


def test_annotation_and_fasta(spark, tmp_path):
    gtf = ("#!x\n1\ts\texon\t10\t20\t.\t+\t.\tgene_id \"G\"; transcript_id \"T\"; transcript_version \"2\"; exon_number \"1\"; gene_name \"N\";\n"
           "1\ts\tCDS\t12\t14\t.\t+\t.\tgene_id \"G\"; transcript_id \"T\";\n")
    p = gz(tmp_path / "a.gtf.gz", gtf)
    row = R.read_annotation(spark, p, versioned=True).first()
    assert (row.chrom, row.start, row.end, row.tid, row.gene_name, row.exon_number) == ("chr1", 10, 20, "T.2", "N", 1)
    assert R.read_annotation(spark, p, ("CDS",)).count() == 1
    fa = gz(tmp_path / "f.fa.gz", ">n1 some text\nacgt\nNNA\n>n2\nTT\n")
    rows = {r.name: r.seq for r in R.read_fasta(spark, fa).collect()}
    assert rows == {"n1": "ACGTNNA", "n2": "TT"}
    df = R.read_fasta(spark, fa).where("name = 'n1'").select(base_at(F.col("seq"), F.lit(7)).alias("b"), base_at(F.col("seq"), F.lit(8)).alias("z"))
    assert tuple(df.first()) == ("A", None)


CHAIN = """chain 100 chr1 1000 + 10 60 chr2 500 + 100 155 1
20 5 10
25

chain 90 chr1 1000 + 200 230 chr3 400 - 50 80 2
30

chain 80 chr1 1000 + 15 25 chr4 400 + 0 10 3
10
"""


def test_chain_blocks_and_lift(spark, tmp_path):
    b = R.read_chain_blocks(spark, gz(tmp_path / "c.chain.gz", CHAIN))
    spans = sorted((r.source_start, r.source_end, r.target_chrom, r.target_start, r.target_end) for r in b.collect())
    assert spans == [(10, 30, "chr2", 100, 120), (15, 25, "chr4", 0, 10), (35, 60, "chr2", 130, 155), (200, 230, "chr3", 320, 350)]
    pts = spark.createDataFrame([("chr1", 11, "+"), ("chr1", 33, "+"), ("chr1", 20, "+"), ("chr1", 201, "+")], "chrom string, pos long, strand string")
    key = ["chrom", "pos", "strand"]
    got = {r.pos: (r.mapping_status, r.lifted_chrom, r.lifted_pos, r.lifted_strand) for r in classify_lift(pts, lift(pts, b, key), key).collect()}
    assert got == {11: ("unique", "chr2", 101, "+"), 33: ("unmapped", None, None, None), 20: ("ambiguous", None, None, None), 201: ("unique", "chr3", 350, "-")}
    assert {r.pos for r in round_trip(pts, b, key).collect()} == {11, 20, 201}


def test_bed_peaks_points_loci(spark, tmp_path):
    bed = tmp_path / "b.bed"
    bed.write_text("chr1\t1\t2\tr\t10\t+\t50\n")
    assert R.read_bed(spark, str(bed)).first().fraction == 0.5
    bed.write_text("chr1\t1\t3\tr\t10\t+\t50\n")
    with pytest.raises(K.GateError, match="single_base"):
        R.read_bed(spark, str(bed))
    peaks = tmp_path / "p.tsv"
    peaks.write_text("chr\tchromStart\tchromEnd\tname\tstrand\tlg.fdr\tfold_enrchment\n1\t5\t9\ta\t+\t1\t2\n")
    row = R.read_peaks(spark, str(peaks)).first()
    assert (row.peak_id, row.interval_width) == ("chr1:5-9:+", 4)
    pts = tmp_path / "t.tsv"
    pts.write_text("1\t7\t7\tx\t.\t-\n")
    assert R.read_point_track(spark, str(pts)).first().pos == 7
    with pytest.raises(Exception, match="unparseable"):
        R.parse_locus_strings(spark.createDataFrame([("chr1:5:G:+",)], "Loci string")).collect()


def test_writers(spark, tmp_path):
    df = spark.createDataFrame([(1, [1.0, None])], "a int, v array<double>")
    W.write_table(df, f"{tmp_path}/out")
    with pytest.raises(Exception, match="(?i)exists"):
        W.write_table(df, f"{tmp_path}/out")
    W.write_compressed(df, f"{tmp_path}/gz")
    back = R.read_result_table(spark, f"{tmp_path}/gz", "a int, v string", ["v"])
    assert R.with_array_column(back, "v", 2).first().v == [1.0, None]
    with pytest.raises(ValueError, match="empty"):
        W.write_table(df.where("a > 5"), f"{tmp_path}/none", allow_empty=False)
    W.append_rows(df, f"{tmp_path}/store")
    W.append_rows(df, f"{tmp_path}/store")
    assert spark.read.parquet(f"{tmp_path}/store").count() == 2
    now = datetime(2026, 1, 1)
    row = W.run_status(spark, "s", "PASS", now, now, {"rows": 3}, {"k": 1}).first()
    assert row.rows == 3 and row.parameters == '{"k": 1}'
    K.require_pass(W.run_status(spark, "s", "PASS", now, now, {}, {}))
    with pytest.raises(K.GateError):
        K.require_pass(W.run_status(spark, "s", "FAIL", now, now, {}, {}))


def test_tree_digest_matches_plain_hashing(spark):
    import hashlib

    def sha(text):
        return hashlib.sha256(text.encode()).hexdigest()

    ids = ["b", "a", "c", None, "a"] + [f"x{i}" for i in range(300)]
    leaves = {}
    for d in sorted(sha("~null" if i is None else i) for i in ids):
        leaves.setdefault(d[:1], []).append(d + "\n")
    root = sha("".join(f"{p} {sha(''.join(ds))}\n" for p, ds in sorted(leaves.items())))
    df = spark.createDataFrame([(i,) for i in ids], "id string")
    assert K.ordered_set_digest(df, "id", 1) == K.ordered_set_digest(df.orderBy(F.desc("id")), "id", 1) == root
    assert K.ordered_set_digest(df, "id", 1) != K.ordered_set_digest(df.distinct(), "id", 1)


def test_fasta_records_start_at_lines_and_bad_numbers_fail(spark, tmp_path):
    (tmp_path / "s.fa").write_text(">t1 gene a->b len=3\nAC\ngt\n>t2\nNN\n")
    got = {r["name"]: r["seq"] for r in R.read_fasta(spark, str(tmp_path / "s.fa")).collect()}
    assert got == {"t1": "ACGT", "t2": "NN"}
    lines = spark.createDataFrame([("t\t3\t*\t0.5\tabc\t0.2",)], "value string")
    with pytest.raises(Exception, match="CAST_INVALID_INPUT"):
        R.parse_signal_lines(lines).collect()


def test_schema_contract(spark):
    df = spark.range(1)
    K.schema_contract(df, ["id"], exact=True)
    with pytest.raises(K.GateError):
        K.schema_contract(df, ["id", "x"])


def test_model_bundle_round_trip(spark, tmp_path):
    from sitewise.operators.models import RidgeModel

    state = {"layout": {"names": ["C:a", "C:missing_a"]}, "features": ["C:a"]}
    W.write_model_bundle(spark, f"{tmp_path}/m", RidgeModel("M0", 1.0, 0.5, np.array([2.0, 1.0]), ["C:a"]), state, "digest")
    model, back, digest = W.read_model_bundle(spark, f"{tmp_path}/m")
    assert model.coef.tolist() == [2.0, 1.0] and back == state and digest == "digest"
