"""Key joins, interval joins and coordinate lifts."""

from pyspark.sql import functions as F

from sitewise.catalog.registry import query
from sitewise.catalog.standins import (
    BLOCKS_SQL, EXONS_SQL, LIFT_POINTS_SQL, POINTS_SQL, PRICE_BIN, REPLICATES_SQL, SEQUENCES_SQL, VECTORS_SQL,
    blocks, exons, lift_points, points, r6, replicates, sequences, vectors,
)
from sitewise.functions.scalars import pooled_ratio
from sitewise.functions.vectors import flank_coverage_zero, flank_mean
from sitewise.operators import intervals as I
from sitewise.operators import joins as J
from sitewise.operators.lift import classify_lift, lift, round_trip
from sitewise.operators.windows import set_algebra_counts
from sitewise.session import checkpointed, tasks_for

_BOTH = f"""
WITH {REPLICATES_SQL}, j AS (SELECT coalesce(r1.k, r2.k) AS k, r1.k IS NOT NULL AS in1, r2.k IS NOT NULL AS in2,
   r1.ag AS ag1, r2.ag AS ag2, r1.a AS a1, r2.a AS a2, r1.gene AS gene1, r2.gene AS gene2 FROM r1 FULL OUTER JOIN r2 ON r1.k = r2.k)"""


@query("replicate_outer_join", _BOTH + """
SELECT CAST(k AS BIGINT) AS k, in1 AS detected_rep1, in2 AS detected_rep2, in1 AND in2 AS detected_both_replicates,
  array_to_string(list_sort(list_distinct(list_filter([gene1, gene2], lambda g: g IS NOT NULL AND g <> 'ELSE'))), ';') AS genes,
  round((coalesce(a1, 0) + coalesce(a2, 0)) / (coalesce(ag1, 0) + coalesce(ag2, 0)), 6) AS combined_ratio FROM j""")
def _(t):
    a, b = replicates(t)
    j = J.replicate_outer_join(a, b, ["k"], ["agcov", "acov"], "gene")
    ratio = pooled_ratio([F.col("acov_rep1"), F.col("acov_rep2")], [F.col("agcov_rep1"), F.col("agcov_rep2")], 6)
    return j.select("k", "detected_rep1", "detected_rep2", "detected_both_replicates", "genes", r6(ratio).alias("combined_ratio"))


@query("points_in_intervals", f"""
WITH {EXONS_SQL}, {POINTS_SQL}
SELECT CAST(tid AS BIGINT) AS tid, CAST(pos AS BIGINT) AS pos, p.strand, CAST(1 + CASE WHEN p.strand = '+' THEN pos - s ELSE e - pos END AS BIGINT) AS tx_pos
FROM points p JOIN exons x ON p.strand = x.strand AND pos BETWEEN s AND e""")
def _(t):
    hits = I.map_to_transcripts(points(t), exons(t), ["chrom", "pos", "strand"], bin_size=PRICE_BIN)
    return hits.select("tid", "pos", "strand", "tx_pos")


@query("interval_overlaps", f"""
WITH {EXONS_SQL}, pk AS (SELECT DISTINCT CAST(floor(o_totalprice) AS BIGINT) AS s0, CAST(floor(o_totalprice) AS BIGINT) + 40 + o_custkey % 30 AS e0,
  CASE WHEN o_orderkey % 2 = 0 THEN '+' ELSE '-' END AS strand FROM orders)
SELECT CAST(s0 AS BIGINT) AS s0, CAST(e0 AS BIGINT) AS e0, pk.strand, CAST(tid AS BIGINT) AS tid
FROM pk JOIN exons x ON pk.strand = x.strand AND s0 <= e AND e0 >= s""")
def _(t):
    s0 = F.floor("o_totalprice").cast("long")
    pk = t("orders").select(F.lit("chr1").alias("chrom"), s0.alias("s0"), (s0 + 40 + F.col("o_custkey") % 30).alias("e0"),
                            F.when(F.col("o_orderkey") % 2 == 0, "+").otherwise("-").alias("strand")).distinct()
    return I.interval_overlap(pk, exons(t), ["chrom", "strand"], ("s0", "e0"), ("start", "end"), PRICE_BIN) \
        .select("s0", "e0", "strand", "tid")


_LIFT = f"""
{BLOCKS_SQL}, {LIFT_POINTS_SQL},
m AS (SELECT DISTINCT chrom, pos, lp.strand, tc, CASE WHEN b.strand = '+' THEN ts + (pos - 1 - ss) + 1 ELSE te - (pos - 1 - ss) END AS tp,
  CASE WHEN b.strand = '+' THEN lp.strand WHEN lp.strand = '-' THEN '+' ELSE '-' END AS tstrand, score
  FROM lp JOIN blocks b ON lp.chrom = b.sc AND pos - 1 >= ss AND pos - 1 < se),
u AS (SELECT chrom, pos, strand, tc, tp, tstrand, max(score) AS score FROM m GROUP BY ALL)"""
_KEY = ["chrom", "pos", "strand"]


@query("coordinate_lift", f"""
WITH {_LIFT}, c AS (SELECT chrom, pos, strand, count(*) AS n, min(tc) AS tc, min(tp) AS tp, min(tstrand) AS ts FROM u GROUP BY chrom, pos, strand)
SELECT lp.chrom, CAST(lp.pos AS BIGINT) AS pos, lp.strand, CAST(coalesce(n, 0) AS BIGINT) AS mapping_count,
  CASE WHEN n IS NULL THEN 'unmapped' WHEN n = 1 THEN 'unique' ELSE 'ambiguous' END AS mapping_status,
  coalesce(CASE WHEN n = 1 THEN tc || ':' || tp || ':' || ts END, '') AS target
FROM lp LEFT JOIN c ON lp.chrom = c.chrom AND lp.pos = c.pos AND lp.strand = c.strand""")
def _(t):
    p = checkpointed(lift_points(t))
    c = classify_lift(p, lift(p, blocks(t), _KEY, "forward", PRICE_BIN, tasks_for(p)), _KEY)
    target = F.when(F.col("lifted_pos").isNull(), "").otherwise(F.concat_ws(":", "lifted_chrom", F.col("lifted_pos").cast("string"), "lifted_strand"))
    return c.select("chrom", "pos", "strand", F.col("mapping_count").cast("long").alias("mapping_count"), "mapping_status", target.alias("target"))


@query("lift_round_trip", f"""
WITH {_LIFT}, back AS (SELECT DISTINCT u.chrom, u.pos, u.strand FROM u JOIN blocks b ON u.tc = b.tc AND u.tp - 1 >= b.ts AND u.tp - 1 < b.te
  AND b.sc = u.chrom AND u.pos = b.ss + CASE WHEN b.strand = '+' THEN u.tp - 1 - b.ts ELSE b.te - 1 - (u.tp - 1) END + 1
  AND u.strand = CASE WHEN b.strand = '+' THEN u.tstrand WHEN u.tstrand = '-' THEN '+' ELSE '-' END)
SELECT chrom, strand, CAST(count(*) AS BIGINT) AS n FROM back GROUP BY chrom, strand""")
def _(t):
    return round_trip(lift_points(t), blocks(t), _KEY, PRICE_BIN).groupBy("chrom", "strand").agg(F.count(F.lit(1)).alias("n"))


@query("contract_join", """
SELECT n_name, CAST(count(*) AS BIGINT) AS customers, round(sum(c_acctbal), 2) AS balance FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name""")
def _(t):
    j = J.checked_join(t("customer").withColumnRenamed("c_nationkey", "k"), t("nation").withColumnRenamed("n_nationkey", "k"), ["k"], validate="many_to_one")
    return j.groupBy("n_name").agg(F.count(F.lit(1)).alias("customers"), r6(F.sum("c_acctbal"), 2).alias("balance"))


@query("wanted_id_semi_join", f"""
WITH {EXONS_SQL}, {POINTS_SQL}
SELECT CAST(tid AS BIGINT) AS tid, gene FROM exons x WHERE EXISTS (SELECT 1 FROM points p WHERE p.strand = x.strand AND pos BETWEEN s AND e)""")
def _(t):
    hits = I.point_in_interval(points(t), exons(t), ["chrom", "strand"], bin_size=PRICE_BIN).select("tid").distinct()
    return J.semi_join(exons(t), hits, ["tid"]).select("tid", F.col("gene_name").alias("gene"))


@query("overlap_exclusion", """
WITH dev AS (SELECT DISTINCT o_custkey, CAST(o_orderdate AS DATE) AS d FROM orders WHERE o_orderkey % 4 = 0)
SELECT CAST(o_orderkey AS BIGINT) AS o_orderkey FROM orders WHERE o_orderkey % 4 <> 0
  AND o_custkey NOT IN (SELECT o_custkey FROM dev) AND CAST(o_orderdate AS DATE) NOT IN (SELECT d FROM dev)""")
def _(t):
    o = t("orders").select("o_orderkey", "o_custkey", F.to_date("o_orderdate").alias("d"))
    return J.exclude_overlap(o.where("o_orderkey % 4 <> 0"), o.where("o_orderkey % 4 = 0"), ["o_custkey", "d"]).select("o_orderkey")


@query("cohort_overlap_flags", """
SELECT a, b, c, CAST(count(*) AS BIGINT) AS n FROM (SELECT doc_id,
  sha256(text) IN (SELECT sha256(text) FROM documents WHERE doc_id % 3 = 0) AS a, source IN (SELECT source FROM documents WHERE doc_id % 3 = 0 AND lang = 'en') AS b,
  sha256(text) IN (SELECT sha256(text) FROM documents WHERE doc_id % 3 = 0 AND lang = 'en') AS c FROM documents WHERE doc_id % 3 <> 0) GROUP BY a, b, c""")
def _(t):
    d = t("documents").select("doc_id", "lang", "source", F.sha2("text", 256).alias("key"))
    dev = d.where("doc_id % 3 = 0")
    x = J.overlap_flags(d.where("doc_id % 3 <> 0"), {"dev": dev.select("key")}, ["key"])
    x = J.overlap_flags(x, {"en": dev.where("lang = 'en'").select("key", "source")}, ["source", "key"])
    return x.groupBy(F.col("dev_key_overlap").alias("a"), F.col("en_source_overlap").alias("b"), F.col("en_key_overlap").alias("c")) \
        .agg(F.count(F.lit(1)).alias("n"))


@query("cohort_nesting_violations", """
SELECT CAST(sum(CASE WHEN l_quantity > 40 AND NOT (l_quantity > 20) THEN 1 ELSE 0 END) AS BIGINT) AS violations,
       CAST(sum(CASE WHEN l_quantity > 40 AND NOT (l_discount > 0.02) THEN 1 ELSE 0 END) AS BIGINT) AS broken FROM lineitem""")
def _(t):
    x = t("lineitem").select((F.col("l_quantity") > 40).alias("strict"), (F.col("l_quantity") > 20).alias("wide"), (F.col("l_discount") > 0.02).alias("other"))
    return J.nesting_violations(x, "strict", "wide").withColumn("broken", J.nesting_violations(x, "strict", "other").scalar())


@query("outer_join_indicator", """
SELECT CASE WHEN a.k IS NULL THEN 'right_only' WHEN b.k IS NULL THEN 'left_only' ELSE 'both' END AS side,
  coalesce(a.p IS NOT DISTINCT FROM b.p, false) AS equal, CAST(count(*) AS BIGINT) AS n
FROM (SELECT o_orderkey AS k, o_orderpriority AS p FROM orders WHERE o_orderkey % 3 <> 0) a
FULL OUTER JOIN (SELECT o_orderkey AS k, CASE WHEN o_orderkey % 10 = 0 THEN 'x' ELSE o_orderpriority END AS p FROM orders WHERE o_orderkey % 5 <> 0) b ON a.k = b.k
GROUP BY 1, 2""")
def _(t):
    o = t("orders").select(F.col("o_orderkey").alias("k"), F.col("o_orderpriority").alias("p"))
    b = o.where("k % 5 <> 0").withColumn("p", F.when(F.col("k") % 10 == 0, "x").otherwise(F.col("p")))
    j = J.outer_with_indicator(o.where("k % 3 <> 0"), b, ["k"], ["p"])
    return j.groupBy(F.col("_merge").alias("side"), F.col("p_equal").alias("equal")).agg(F.count(F.lit(1)).alias("n"))


@query("reference_base_lookup", f"""
WITH {SEQUENCES_SQL}, w AS (SELECT DISTINCT l_partkey AS doc_id, l_suppkey * 11 + l_linenumber AS pos FROM lineitem)
SELECT CAST(w.doc_id AS VARCHAR) AS chrom, CAST(pos AS BIGINT) AS pos, substring(seq, pos, 1) AS base FROM w JOIN seqs ON w.doc_id = seqs.doc_id WHERE pos BETWEEN 1 AND length(seq)""")
def _(t):
    w = t("lineitem").select(F.col("l_partkey").cast("string").alias("chrom"), (F.col("l_suppkey") * 11 + F.col("l_linenumber")).alias("pos"))
    named = sequences(t).select(F.col("doc_id").cast("string").alias("chrom"), "seq")
    return I.reference_bases(w, named, chunk=256).select("chrom", "pos", "base")


_LEN = """
ann AS (SELECT l_partkey AS tid, CAST(sum(l_linenumber) AS BIGINT) AS n FROM lineitem WHERE l_partkey % 10 <> 3 GROUP BY l_partkey),
sq AS (SELECT p_partkey AS tid, length(p_name) AS n FROM part WHERE p_partkey % 7 <> 2),
vec AS (SELECT p_partkey AS tid, CASE WHEN p_partkey % 3 = 0 THEN (SELECT n FROM ann WHERE ann.tid = p_partkey) ELSE length(p_name) END AS length FROM part)"""


@query("length_agreement_reasons", f"""
WITH {_LEN} SELECT reason, CAST(count(*) AS BIGINT) AS count FROM (SELECT CASE WHEN a.n IS NULL THEN 'no_annotation' WHEN s.n IS NULL THEN 'no_sequence'
  WHEN s.n <> v.length THEN 'sequence_length_mismatch' WHEN a.n <> v.length THEN 'annotation_length_mismatch' ELSE 'retained' END AS reason
  FROM vec v LEFT JOIN ann a ON a.tid = v.tid LEFT JOIN sq s ON s.tid = v.tid) GROUP BY reason""")
def _(t):
    from sitewise.operators.aggregates import reason_counts

    vec, ann, sq = _lengths(t)
    return reason_counts(J.length_agreement(vec, ann, sq), F.col("reason"))


def _lengths(t):
    part = t("part").select(F.col("p_partkey").alias("tid"), F.col("p_name").alias("seq"))
    ann = t("lineitem").where("l_partkey % 10 <> 3").select(
        F.col("l_partkey").alias("tid"), F.lit(1).cast("long").alias("start"), F.col("l_linenumber").cast("long").alias("end"))
    total = ann.groupBy("tid").agg(F.sum("end").alias("n"))
    vec = part.join(total, "tid", "left").select("tid", F.when(F.col("tid") % 3 == 0, F.col("n")).otherwise(F.length("seq")).alias("length"))
    return vec, ann, part.where("tid % 7 <> 2")


@query("reference_compatibility", """
WITH tg AS (SELECT 'T' || p_partkey || '.' || (p_partkey % 3) AS tid, 'T' || p_partkey AS base, p_size * 3 AS length FROM part),
ft AS (SELECT 'T' || l_partkey || '.' || (l_suppkey % 3) AS tid, 'T' || l_partkey AS base, l_linenumber AS w FROM lineitem WHERE l_partkey % 6 <> 1),
f AS (SELECT tid, sum(w) AS n FROM ft GROUP BY tid), b AS (SELECT base, sum(w) AS n FROM ft GROUP BY base)
SELECT CAST(count(*) AS BIGINT) AS targets, CAST(count(f.n) AS BIGINT) AS found, CAST(sum(CASE WHEN f.n = length THEN 1 ELSE 0 END) AS BIGINT) AS length_exact,
  CAST(sum(CASE WHEN f.n <> length THEN 1 ELSE 0 END) AS BIGINT) AS length_mismatch, CAST(sum(CASE WHEN f.n IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS missing,
  CAST(count(b.n) AS BIGINT) AS base_found, CAST(sum(CASE WHEN b.n = length THEN 1 ELSE 0 END) AS BIGINT) AS base_length_exact
FROM tg LEFT JOIN f ON f.tid = tg.tid LEFT JOIN b ON b.base = tg.base""")
def _(t):
    def vid(k, v):
        return F.concat(F.lit("T"), F.col(k).cast("string"), F.lit("."), (F.col(v) % 3).cast("string"))

    tg = t("part").select(vid("p_partkey", "p_partkey").alias("tid"), (F.col("p_size") * 3).alias("length"))
    ft = t("lineitem").where("l_partkey % 6 <> 1").select(vid("l_partkey", "l_suppkey").alias("tid"), F.lit(1).alias("start"), F.col("l_linenumber").alias("end"))
    return J.reference_compatibility(tg, ft)


@query("alias_join_with_fallback", """
WITH ref AS (SELECT 'T' || (p_partkey // 2) || '.' || (p_partkey % 2) AS tid, 'T' || (p_partkey // 2) AS base, p_brand AS v FROM part WHERE p_partkey % 5 <> 0),
fb AS (SELECT base, arg_min(v, tid) AS v FROM ref GROUP BY base), x AS (SELECT DISTINCT 'T' || (l_partkey // 2) || '.' || (l_suppkey % 3) AS tid, 'T' || (l_partkey // 2) AS base FROM lineitem)
SELECT x.tid, coalesce(ref.v, fb.v, '') AS v, CASE WHEN ref.v IS NOT NULL THEN 'exact' WHEN fb.v IS NOT NULL THEN 'unversioned' ELSE 'missing' END AS id_match
FROM x LEFT JOIN ref ON ref.tid = x.tid LEFT JOIN fb ON fb.base = x.base""")
def _(t):
    def vid(k, v):
        return F.concat(F.lit("T"), F.floor(F.col(k) / 2).cast("string"), F.lit("."), v.cast("string")).alias("tid")

    ref = t("part").where("p_partkey % 5 <> 0").select(vid("p_partkey", F.col("p_partkey") % 2), F.col("p_brand").alias("v"))
    x = t("lineitem").select(vid("l_partkey", F.col("l_suppkey") % 3)).distinct()
    return J.alias_join(x, ref, "tid", ["v"]).select("tid", F.coalesce("v", F.lit("")).alias("v"), "id_match")


@query("offset_yields", f"""
WITH {EXONS_SQL}, {POINTS_SQL} SELECT CAST(o AS BIGINT) AS shift, CAST(count(DISTINCT (pos, strand)) AS BIGINT) AS mapped_records FROM (
  SELECT o, pos + o AS pos, strand FROM points, (VALUES (-1), (0), (1)) v(o)) q WHERE EXISTS (SELECT 1 FROM exons x WHERE x.strand = q.strand AND q.pos BETWEEN s AND e) GROUP BY o""")
def _(t):
    p = points(t).withColumn("site", F.concat_ws(":", F.col("pos").cast("string"), "strand"))
    return I.offset_yields(p, exons(t), [-1, 0, 1], ["site"], bin_size=PRICE_BIN).select(F.col("offset").cast("long").alias("shift"), "mapped_records")


_COND = f"""
WITH {VECTORS_SQL}, s AS (SELECT vec_id, any_value(c) AS c, count(v) FILTER (p BETWEEN c - 10 AND c - 1) AS lc, count(v) FILTER (p BETWEEN c + 1 AND c + 10) AS rc,
  avg(v) FILTER (p BETWEEN c - 10 AND c + 10 AND p <> c) AS m FROM vl GROUP BY vec_id),
q AS (SELECT vec_id, m, c > 10 AND c <= 54 AND lc >= 7 AND rc >= 7 AS ok FROM s),
a AS (SELECT vec_id // 2 AS k, m, ok FROM q WHERE vec_id % 2 = 0 AND vec_id % 14 <> 0), b AS (SELECT vec_id // 2 AS k, m, ok FROM q WHERE vec_id % 2 = 1 AND vec_id % 9 <> 1)"""


def _conditions(t):
    v, c = F.col("values"), F.col("c").cast("int")
    left, right, _ = flank_coverage_zero(v, c, 10)
    q = vectors(t).select("vec_id", flank_mean(v, c, 10, None).alias("m"), ((left >= 0.7) & (right >= 0.7)).alias("ok"))
    q = q.withColumn("k", F.floor(F.col("vec_id") / 2))
    return q.where("vec_id % 2 = 0 and vec_id % 14 <> 0"), q.where("vec_id % 2 = 1 and vec_id % 9 <> 1")


@query("paired_conditions", _COND + """
SELECT CAST(a.k AS BIGINT) AS k, round(a.m - b.m, 6) AS delta, round((a.m + b.m) / 2, 6) AS mean FROM a JOIN b ON a.k = b.k WHERE a.ok AND b.ok""")
def _(t):
    a, b = _conditions(t)
    return J.paired_conditions(a, b, ["k"], "ok", ["m"]).select("k", r6(F.col("m_delta")).alias("delta"), r6(F.col("m_mean")).alias("mean"))


@query("paired_condition_failures", _COND + """, w AS (SELECT DISTINCT vec_id // 2 AS k FROM embeddings)
SELECT CAST(count(*) AS BIGINT) AS wanted, CAST(sum(CASE WHEN a.k IS NULL OR b.k IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS missing_either,
  CAST(sum(CASE WHEN b.k IS NOT NULL AND NOT a.ok THEN 1 ELSE 0 END) AS BIGINT) AS invalid_a, CAST(sum(CASE WHEN a.k IS NOT NULL AND NOT b.ok THEN 1 ELSE 0 END) AS BIGINT) AS invalid_b,
  CAST(sum(CASE WHEN a.ok AND b.ok THEN 1 ELSE 0 END) AS BIGINT) AS paired FROM w LEFT JOIN a ON a.k = w.k LEFT JOIN b ON b.k = w.k""")
def _(t):
    a, b = _conditions(t)
    return J.paired_condition_failures(t("embeddings").select(F.floor(F.col("vec_id") / 2).alias("k")).distinct(), a, b, ["k"], "ok")


@query("paired_arm_attrition", """
WITH c AS (SELECT l_partkey AS k, avg(l_quantity) AS v FROM lineitem WHERE l_returnflag = 'A' AND l_linenumber < 3 GROUP BY 1),
tr AS (SELECT l_partkey AS k, avg(l_quantity) AS v FROM lineitem WHERE l_returnflag = 'R' AND l_linenumber < 3 GROUP BY 1)
SELECT CAST(count(c.k) AS BIGINT) AS control_rows, CAST(count(tr.k) AS BIGINT) AS treatment_rows, CAST(sum(CASE WHEN c.k IS NOT NULL AND tr.k IS NOT NULL THEN 1 ELSE 0 END) AS BIGINT) AS paired_rows,
  CAST(sum(CASE WHEN tr.k IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS control_only, CAST(sum(CASE WHEN c.k IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS treatment_only,
  CAST(sum(CASE WHEN tr.v - c.v <> 0 THEN 1 ELSE 0 END) AS BIGINT) AS finite_pairs FROM c FULL OUTER JOIN tr ON c.k = tr.k""")
def _(t):
    def arm(flag, name):
        return t("lineitem").where((F.col("l_returnflag") == flag) & (F.col("l_linenumber") < 3)).groupBy(F.col("l_partkey").alias("k")).agg(F.avg("l_quantity").alias(name))

    return J.paired_arm_attrition(arm("A", "c"), arm("R", "t"), "k", F.coalesce(F.col("t") - F.col("c") != 0, F.lit(False)))


@query("manifest_differences", """
WITH e AS (SELECT doc_id, sha256(text) AS d, n_chars AS s FROM documents WHERE doc_id % 13 <> 0),
o AS (SELECT doc_id, sha256(CASE WHEN doc_id % 17 = 0 THEN text || 'x' ELSE text END) AS d, n_chars + CASE WHEN doc_id % 19 = 0 THEN 1 ELSE 0 END AS s FROM documents WHERE doc_id % 11 <> 0)
SELECT CAST(coalesce(e.doc_id, o.doc_id) AS BIGINT) AS doc_id, CASE WHEN o.doc_id IS NULL THEN 'missing' WHEN e.doc_id IS NULL THEN 'unexpected' WHEN e.d <> o.d THEN 'hash_changed' ELSE 'size_changed' END AS problem
FROM e FULL OUTER JOIN o ON e.doc_id = o.doc_id WHERE o.doc_id IS NULL OR e.doc_id IS NULL OR e.d <> o.d OR e.s <> o.s""")
def _(t):
    d = t("documents")
    text = F.when(F.col("doc_id") % 17 == 0, F.concat("text", F.lit("x"))).otherwise(F.col("text"))
    e = d.where("doc_id % 13 <> 0").select("doc_id", F.sha2("text", 256).alias("sha256"), F.col("n_chars").alias("bytes"))
    o = d.where("doc_id % 11 <> 0").select("doc_id", F.sha2(text, 256).alias("sha256"), (F.col("n_chars") + F.when(F.col("doc_id") % 19 == 0, 1).otherwise(0)).alias("bytes"))
    return J.manifest_diff(e, o, "doc_id")


@query("annotation_projection", """
WITH ns AS (SELECT DISTINCT l_partkey AS tid, l_linenumber * 1000 + l_partkey * l_linenumber % 300 AS s, l_linenumber * 1000 + l_partkey * l_linenumber % 300 + 20 + (l_partkey + l_linenumber) % 40 AS e FROM lineitem),
tx AS (SELECT tid, s, e, CASE WHEN tid % 2 = 0 THEN '+' ELSE '-' END AS strand,
  sum(e - s + 1) OVER (PARTITION BY tid ORDER BY CASE WHEN tid % 2 = 0 THEN s ELSE -s END ROWS UNBOUNDED PRECEDING) - (e - s) AS tx0 FROM ns),
ft AS (SELECT tid, CASE WHEN s % 3 = 0 THEN 'stop_codon' ELSE 'CDS' END AS f, unnest([s + 2, e - 3]) AS g FROM ns WHERE s % 2 = 0),
pr AS (SELECT ft.tid, f, min(tx0 + CASE WHEN strand = '+' THEN g - s ELSE e - g END) AS p FROM ft JOIN tx ON ft.tid = tx.tid AND g BETWEEN s AND e GROUP BY ft.tid, f, g)
SELECT CAST(tid AS BIGINT) AS tid, CAST(coalesce(min(p) FILTER (f = 'CDS'), -1) AS BIGINT) AS cds_start_tx, CAST(coalesce(max(p) FILTER (f = 'CDS'), -1) AS BIGINT) AS cds_end_tx,
  CAST(coalesce(min(p) FILTER (f = 'stop_codon'), -1) AS BIGINT) AS stop_codon_start_tx FROM pr GROUP BY tid""")
def _(t):
    ex = _exon_chains(t)
    offs = I.with_tx_offsets(ex)
    f = F.when(F.col("start") % 3 == 0, "stop_codon").otherwise("CDS")
    ft = ex.where("start % 2 = 0").select("tid", f.alias("feature"), (F.col("start") + 2).alias("start"), (F.col("end") - 3).alias("end"))
    return I.project_annotation(ft, offs).select("tid", *[F.coalesce(c, F.lit(-1)).cast("long").alias(c) for c in ("cds_start_tx", "cds_end_tx", "stop_codon_start_tx")])


def _exon_chains(t):
    """Exon chains per part that cannot overlap: one exon per line number."""
    k, n = F.col("l_partkey"), F.col("l_linenumber")
    start = n * 1000 + k * n % 300
    return t("lineitem").select(
        k.alias("tid"), start.cast("long").alias("start"), (start + 20 + (k + n) % 40).cast("long").alias("end"),
        F.when(k % 2 == 0, "+").otherwise("-").alias("strand"), F.lit("chr1").alias("chrom")).distinct()


@query("spliced_interval_features", f"""
WITH {EXONS_SQL}, pk AS (SELECT DISTINCT CAST(floor(o_totalprice) AS BIGINT) AS s0, CAST(floor(o_totalprice) AS BIGINT) + 5 + o_custkey % 12 AS e0,
  CASE WHEN o_orderkey % 2 = 0 THEN '+' ELSE '-' END AS strand FROM orders),
hit AS (SELECT s0, e0, pk.strand, tid, greatest(s0 + 1, s) AS lo, least(e0, e) AS hi, s, e FROM pk JOIN exons x ON pk.strand = x.strand AND s0 + 1 <= e AND e0 >= s),
txp AS (SELECT DISTINCT s0, e0, strand, tid, unnest(range(least(a, b), greatest(a, b) + 1)) AS p FROM (
  SELECT *, 1 + CASE WHEN strand = '+' THEN lo - s ELSE e - lo END AS a, 1 + CASE WHEN strand = '+' THEN hi - s ELSE e - hi END AS b FROM hit)),
v AS (SELECT p_partkey AS tid, unnest(range(1, 65)) AS p, unnest(list_transform(embedding, lambda x: CASE WHEN x::DOUBLE > -0.1::DOUBLE THEN x::DOUBLE END)) AS v FROM part JOIN embeddings ON vec_id = p_partkey % 500),
sp AS (SELECT s0, e0, strand, tid, min(p) AS f, max(p) AS l, count(*) AS nt FROM txp GROUP BY ALL),
pv AS (SELECT txp.s0, txp.e0, txp.strand, txp.tid, count(v) AS ok, avg(v) AS m FROM txp LEFT JOIN v ON v.tid = txp.tid AND v.p = txp.p GROUP BY ALL),
fl AS (SELECT sp.s0, sp.e0, sp.strand, sp.tid, count(v) FILTER (v.p < f) AS u, count(v) FILTER (v.p > l) AS d FROM sp LEFT JOIN v ON v.tid = sp.tid AND v.p BETWEEN f - 5 AND l + 5 AND (v.p < f OR v.p > l) GROUP BY ALL)
SELECT CAST(s0 AS BIGINT) AS s0, CAST(e0 AS BIGINT) AS e0, strand, CAST(tid AS BIGINT) AS tid, CAST(f AS BIGINT) AS first_pos, CAST(l AS BIGINT) AS last_pos, CAST(nt AS BIGINT) AS nt,
  CAST(ok AS BIGINT) AS valid_count, round(m, 8) AS mean, round(CASE WHEN f > 5 THEN u / 5 END, 6) AS cov_up, round(CASE WHEN l + 5 <= 64 THEN d / 5 END, 6) AS cov_down
FROM sp JOIN pv USING (s0, e0, strand, tid) JOIN fl USING (s0, e0, strand, tid)""")
def _(t):
    s0 = F.floor("o_totalprice").cast("long")
    pk = t("orders").select(F.lit("chr1").alias("chrom"), s0.alias("start0"), (s0 + 5 + F.col("o_custkey") % 12).alias("end0"),
                            F.when(F.col("o_orderkey") % 2 == 0, "+").otherwise("-").alias("strand")).distinct()
    pk = pk.withColumn("peak", F.struct(F.col("start0").alias("s0"), F.col("end0").alias("e0"), "strand"))
    vec = t("part").select(F.col("p_partkey").alias("tid"), (F.col("p_partkey") % 500).alias("vec_id")).join(vectors(t), "vec_id")
    out = I.spliced_interval_features(pk, exons(t), vec, "peak", 5, 0.7, 0.7, PRICE_BIN)
    return out.select(
        "peak.s0", "peak.e0", "peak.strand", "tid",
        F.col("peak_tx_start").alias("first_pos"), F.col("peak_tx_end").alias("last_pos"), F.col("peak_exonic_nt").alias("nt"),
        F.col("peak_valid_count").cast("long").alias("valid_count"), r6(F.col("peak_mean"), 8).alias("mean"),
        r6(F.col("coverage_upstream")).alias("cov_up"), r6(F.col("coverage_downstream")).alias("cov_down"))


@query("duplicate_keys", """
SELECT CAST(l_orderkey AS BIGINT) AS l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber, CAST(count(*) AS BIGINT) AS count FROM lineitem GROUP BY ALL HAVING count(*) > 1""")
def _(t):
    return J.duplicate_keys(t("lineitem").withColumn("l_linenumber", F.col("l_linenumber").cast("long")), ["l_orderkey", "l_linenumber"])


@query("key_set_algebra", """
WITH a AS (SELECT DISTINCT l_partkey AS k FROM lineitem WHERE l_returnflag = 'A' AND l_quantity > 40), b AS (SELECT DISTINCT l_partkey AS k FROM lineitem WHERE l_returnflag = 'R' AND l_quantity > 40)
SELECT CAST((SELECT count(*) FROM a) AS BIGINT) AS first, CAST((SELECT count(*) FROM b) AS BIGINT) AS second, CAST((SELECT count(*) FROM (SELECT k FROM a UNION SELECT k FROM b)) AS BIGINT) AS either,
  CAST((SELECT count(*) FROM (SELECT k FROM a INTERSECT SELECT k FROM b)) AS BIGINT) AS both, CAST((SELECT count(*) FROM (SELECT k FROM a EXCEPT SELECT k FROM b)) AS BIGINT) AS first_only,
  CAST((SELECT count(*) FROM (SELECT k FROM b EXCEPT SELECT k FROM a)) AS BIGINT) AS second_only""")
def _(t):
    li = t("lineitem").where("l_quantity > 40")
    return set_algebra_counts(li.where("l_returnflag = 'A'"), li.where("l_returnflag = 'R'"), ["l_partkey"])
