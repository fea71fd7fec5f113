import random

from sitewise.operators import intervals as I

EXON = "chrom string, start long, end long, strand string, tid long, tx_start long"
PEAK = "peak string, chrom string, strand string, start0 long, end0 long"


def test_pairs_come_by_right_interval_and_left_position(spark):
    rnd = random.Random(3)
    left = [(i, s, s + rnd.randrange(40)) for i, s in enumerate(rnd.sample(range(1, 5000), 300))]
    right = [(t, s, s + rnd.randrange(400)) for t, s in enumerate(rnd.sample(range(1, 5000), 20))]
    a = spark.createDataFrame([("1", *r) for r in left], "chrom string, a long, s long, e long")
    b = spark.createDataFrame([("1", *r) for r in right], "chrom string, b long, s2 long, e2 long")
    got = I.interval_overlap(a, b, ["chrom"], ("s", "e"), ("s2", "e2")).collect()
    assert sorted((r.a, r.b) for r in got) == sorted((i, t) for i, s, e in left for t, s2, e2 in right if s <= e2 and e >= s2)
    runs = [r.b for r, before in zip(got, [None, *got]) if before is None or r.b != before.b]
    assert len(runs) == len(set(runs)) == len({r.b for r in got})
    assert all(x.s <= y.s for x, y in zip(got, got[1:]) if x.b == y.b)


def test_intervals_beyond_the_other_side_are_not_shuffled(spark):
    left = spark.createDataFrame([(i, 10 * i, 10 * i + 3) for i in range(1000)], "a long, s long, e long")
    right = spark.createDataFrame([(1, 5003, 5020), (2, None, 9), (3, 9, None)], "b long, s2 long, e2 long")
    near = I._within(left, "s", "e", I._extent(right, "s2", "e2", 1024))
    assert sorted(r.a for r in near.collect()) == [500, 501, 502]
    assert sorted(map(tuple, I.interval_overlap(left, right, [], ("s", "e"), ("s2", "e2"), 1024).select("a", "b").collect())) == [(500, 1), (501, 1), (502, 1)]
    assert I.interval_overlap(left, right.where("b = 3"), [], ("s", "e"), ("s2", "e2"), 1024).count() == 0


def by_hand(peaks, exons, vectors):
    covered = {}
    for key, chrom, strand, s, e in peaks:
        for c, start, end, st, tid, tx in exons:
            lo, hi = max(s + 1, start), min(e, end)
            if (chrom, strand) == (c, st) and s + 1 <= end and e >= start:
                a, b = ((lo, hi) if strand == "+" else (start + end - hi, start + end - lo))
                covered.setdefault((key, tid), set()).update(tx + x - start for x in range(a, b + 1))
    return {(k, t, min(p), max(p), len(p), sum(x <= len(v) and v[x - 1] is not None for x in p))
            for (k, t), p in covered.items() if (v := vectors.get(t)) is not None}


def spliced(spark, peaks, exons, vectors):
    out = I.spliced_interval_features(spark.createDataFrame(peaks, PEAK), spark.createDataFrame(exons, EXON),
                                      spark.createDataFrame(list(vectors.items()), "tid long, values array<double>"), "peak", 2)
    rows = out.select("peak", "tid", "peak_tx_start", "peak_tx_end", "peak_exonic_nt", "peak_valid_count")
    got = [tuple(r) for r in rows.collect()]
    assert len(got) == len(set(got))
    return set(got), rows._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0].count("Exchange hashpartitioning(peak#")


def test_pairs_of_one_exon_are_not_shuffled(spark):
    peaks = [(f"p{i}", "1", "+-"[i % 2], 7 * i, 7 * i + 12) for i in range(60)]
    exons = [("1", 1 + 9 * t, 30 + 9 * t + t % 7, "+-"[t // 2 % 2], t, 1) for t in range(40)]
    vectors = {t: [None if i % (t + 2) == 0 else 1.0 for i in range(25)] for t in range(40)}
    got, shuffles = spliced(spark, peaks, exons, vectors)
    assert got == by_hand(peaks, exons, vectors) and len(got) > 100
    assert shuffles == 0


def test_pieces_of_several_exons_and_of_repeated_keys_meet(spark):
    # Transcript 1 has an exon inside another and a neighbour, 2 lies on both strands; p1 is the key of three peaks, two of them equal.
    exons = [("1", 1, 40, "+", 1, 1), ("1", 5, 9, "+", 1, 41), ("1", 60, 80, "+", 1, 46), ("1", 60, 80, "+", 1, 46), ("1", 1, 30, "-", 2, 1),
             ("1", 90, 99, "+", 2, 31), ("1", 20, 70, "+", 3, 1)]
    peaks = [("p0", "1", "+", 20, 30), ("p1", "1", "+", 2, 6), ("p1", "1", "+", 65, 95), ("p1", "1", "+", 65, 95), ("p2", "1", "+", 35, 64),
             ("p3", "1", "-", 0, 99), ("p4", "1", "+", 41, 59), ("p5", "1", "+", 0, 200)]
    vectors = {t: [None if i % 4 == t else 1.0 for i in range(70)] for t in (1, 2, 3)}
    got, shuffles = spliced(spark, peaks, exons, vectors)
    assert got == by_hand(peaks, exons, vectors) and len(got) > 8
    assert shuffles == 1


def test_an_exon_brings_its_stretch_of_the_vector(spark):
    # The second exons start at 101 of 130 or beyond the vector's end; flanks reach into what other exons cover.
    exons = [e for t in range(4) for e in (("1", 1, 100, "+-"[t % 2], t, 1), ("1", 301, 350, "+-"[t % 2], t, 101 + 20 * t))]
    vectors = {t: [None if i % (t + 2) == 0 else float(i) for i in range(1, 131)] for t in range(4)}
    peaks = [(f"p{s}{strand}", "1", strand, s, s + 6) for s in (0, 2, 47, 93, 96, 298, 300, 303, 325, 344, 348) for strand in "+-"]
    out = I.spliced_interval_features(spark.createDataFrame(peaks, PEAK), spark.createDataFrame(exons, EXON),
                                      spark.createDataFrame(list(vectors.items()), "tid long, values array<double>"), "peak", 4)
    got = out.collect()
    assert {(r.peak, r.tid, r.peak_tx_start, r.peak_tx_end, r.peak_exonic_nt, r.peak_valid_count) for r in got} == by_hand(peaks, exons, vectors)
    for r in got:
        v = vectors[r.tid]
        up, down = v[max(r.peak_tx_start - 5, 0):r.peak_tx_start - 1], v[r.peak_tx_end:r.peak_tx_end + 4]
        valid = [[x for x in side if x is not None] for side in (up, down)]
        assert r.coverage_upstream == (len(valid[0]) / 4 if r.peak_tx_start > 4 else None)
        assert r.coverage_downstream == (len(valid[1]) / 4 if r.peak_tx_end + 4 <= 130 else None)
        assert [r.mean_upstream, r.mean_downstream] == [round(sum(x) / len(x), 8) if x else None for x in valid]
