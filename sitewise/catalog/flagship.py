"""The site dataset end to end."""

from pyspark.sql import functions as F

from sitewise.catalog.registry import query
from sitewise.catalog.standins import EXONS_SQL, PRICE_BIN, exons, r6, unit_price_cents, vectors
from sitewise.plans import dataset as D
from sitewise.session import checkpointed

_PARAMS = D.DatasetParams(flank=10, display=50, min_fraction=0.7, bin_size=PRICE_BIN, disjoint_exons=True)

_SITES = f"""
WITH {EXONS_SQL},
rp AS (SELECT l_linestatus AS st, CAST(round(l_extendedprice / l_quantity * 100) AS BIGINT) AS pos, CASE WHEN l_partkey % 2 = 0 THEN '+' ELSE '-' END AS strand,
  CAST(sum(l_quantity) AS BIGINT) AS ag, round(sum(l_quantity * l_discount), 4) AS a, 'Brand#' || min(l_partkey % 25) AS gene FROM lineitem GROUP BY ALL),
j AS (SELECT coalesce(x.pos, y.pos) AS pos, coalesce(x.strand, y.strand) AS strand, x.pos IS NOT NULL AS d1, y.pos IS NOT NULL AS d2, coalesce(x.a, 0) + coalesce(y.a, 0) AS a,
  coalesce(x.ag, 0) + coalesce(y.ag, 0) AS ag, list_filter([x.gene, y.gene], lambda g: g IS NOT NULL) AS genes
  FROM (SELECT * FROM rp WHERE st = 'O') x FULL OUTER JOIN (SELECT * FROM rp WHERE st = 'F') y ON x.pos = y.pos AND x.strand = y.strand),
h AS (SELECT j.*, tid, gene, 1 + CASE WHEN j.strand = '+' THEN pos - s ELSE e - pos END AS tp FROM j JOIN exons ex ON ex.strand = j.strand AND pos BETWEEN s AND e),
v AS (SELECT vec_id, p + 64 * r AS p, v FROM (SELECT vec_id, unnest(range(1, 65)) AS p, unnest(list_transform(embedding, lambda x: CASE WHEN x::DOUBLE > -0.1::DOUBLE THEN x::DOUBLE END)) AS v FROM embeddings), range(0, 8) z(r)),
f AS (SELECT h.pos, h.strand, tid, any_value(tp) AS tp, any_value(gene) AS gene, count(v) FILTER (p BETWEEN tp - 10 AND tp - 1) AS lc, count(v) FILTER (p BETWEEN tp + 1 AND tp + 10) AS rc,
  avg(v) FILTER (p BETWEEN tp - 10 AND tp + 10 AND p <> tp) AS m, count(v) FILTER (p BETWEEN tp - 50 AND tp + 50) AS n101
  FROM h LEFT JOIN v ON v.vec_id = tid % (SELECT count(*) FROM embeddings) AND p BETWEEN tp - 50 AND tp + 50 GROUP BY h.pos, h.strand, tid),
g AS (SELECT f.*, tp > 10 AND tp + 10 <= 512 AND lc >= 7 AND rc >= 7 AS ok, list_contains(genes, gene) AS gm, d1, d2, a, ag FROM f JOIN j ON f.pos = j.pos AND f.strand = j.strand),
k AS (SELECT *, row_number() OVER (PARTITION BY pos, strand ORDER BY CASE WHEN ok THEN 0 ELSE 1 END, n101 DESC, CASE WHEN gm THEN 0 ELSE 1 END, tid) AS rn, count(*) OVER (PARTITION BY pos, strand) AS n FROM g),
site AS (SELECT *, CASE WHEN NOT (d1 AND d2) THEN 'not_detected_in_both_replicates' WHEN NOT ok THEN 'insufficient_flank_coverage' ELSE '' END AS reason FROM k WHERE rn = 1)"""


def _union(t):
    agg = t("lineitem").groupBy(
        "l_linestatus", unit_price_cents().alias("pos"), F.when(F.col("l_partkey") % 2 == 0, "+").otherwise("-").alias("strand")).agg(
        F.sum("l_quantity").cast("long").alias("agcov"), F.round(F.sum(F.col("l_quantity") * F.col("l_discount")), 4).alias("acov"),
        F.concat(F.lit("Brand#"), F.min(F.col("l_partkey") % 25).cast("string")).alias("gene")).withColumn("chrom", F.lit("chr1"))
    # Keys come out of a group-by, so the uniqueness check would only repeat it.
    return D.replicate_union(agg.where("l_linestatus = 'O'"), agg.where("l_linestatus = 'F'"), ["agcov", "acov"], "gene", check=False)


def _sites(t):
    """The replicate union, written once as two joins read it, and its site table."""
    union = checkpointed(_union(t))
    return union, checkpointed(D.site_table(D.best_sites(union, exons(t), _vectors(t), _PARAMS), _PARAMS))


def _vectors(t):
    n = t("embeddings").agg(F.count(F.lit(1)).alias("n")).scalar()
    long = D.with_masks(vectors(t).select("vec_id", F.flatten(F.array_repeat("values", 8)).alias("values")))
    return t("part").select(F.col("p_partkey").alias("tid"), (F.col("p_partkey") % n).alias("vec_id")).join(long, "vec_id").select("tid", "values", "size", "mask")


@query("site_dataset", _SITES + """
SELECT CAST(pos AS BIGINT) AS pos, strand, CAST(tid AS BIGINT) AS tid, CAST(tp AS BIGINT) AS tx_pos, CAST(n AS BIGINT) AS isoform_count, round(a / ag, 6) AS combined_ratio, round(m, 8) AS signal_mean,
  CAST(n101 AS BIGINT) AS valid_count, ok AS main_window_valid, reason AS exclusion_reason, reason = '' AS included FROM site""")
def site_dataset(t):
    _, sites = _sites(t)
    return sites.select(
        "pos", "strand", "tid", "tx_pos", "isoform_count", r6(F.col("combined_ratio")).alias("combined_ratio"), r6(F.col("signal_mean_flank"), 8).alias("signal_mean"),
        F.col("valid_count_display").cast("long").alias("valid_count"), "main_window_valid", F.col("main_exclusion_reason").alias("exclusion_reason"),
        F.col("main_analysis_included").alias("included"))


@query("site_windows", _SITES + """
SELECT CAST(x.pos AS BIGINT) AS pos, x.strand, CAST(count(v) AS BIGINT) AS measured, round(coalesce(sum(round(v, 6) * (p - tp + 51)), 0), 3) AS weighted
FROM site x LEFT JOIN v ON v.vec_id = tid % (SELECT count(*) FROM embeddings) AND p BETWEEN tp - 50 AND tp + 50 WHERE reason = '' GROUP BY x.pos, x.strand""")
def _(t):
    _, sites = _sites(t)
    w = D.add_windows(sites.where("main_analysis_included"), _vectors(t), D.DatasetParams(flank=10, display=50))
    moment = F.aggregate(F.transform("signal_window", lambda x, i: F.coalesce(x, F.lit(0.0)) * (i + 1)), F.lit(0.0), lambda a, x: a + x)
    measured = F.aggregate("signal_mask", F.lit(0).cast("long"), lambda a, x: a + x)
    return w.select("pos", "strand", measured.alias("measured"), r6(moment, 3).alias("weighted"))


@query("site_isoform_table", _SITES + """
SELECT CAST(pos AS BIGINT) AS pos, strand, CAST(tid AS BIGINT) AS tid, CAST(rn AS BIGINT) AS isoform_rank, CAST(n AS BIGINT) AS isoform_count, rn = 1 AS representative FROM k""")
def _(t):
    return D.isoform_ranks(D.candidates(_union(t), exons(t), _vectors(t), _PARAMS)).select("pos", "strand", "tid", "isoform_rank", "isoform_count", F.col("representative_isoform").alias("representative"))


@query("site_attrition", _SITES + """, c AS (SELECT (SELECT count(*) FROM j) AS s1, count(*) AS s2, count(*) FILTER (d1 AND d2) AS s3, count(*) FILTER (reason = '') AS s4 FROM site)
SELECT CAST(1 AS BIGINT) AS step, 'replicate_union' AS stage, CAST(s1 AS BIGINT) AS count FROM c UNION ALL SELECT 2, 'matched_to_transcript', s2 FROM c
UNION ALL SELECT 3, 'detected_in_both', s3 FROM c UNION ALL SELECT 4, 'main_dataset', s4 FROM c UNION ALL SELECT 5, 'model_ready', s4 FROM c""")
def _(t):
    union, sites = _sites(t)
    return D.attrition(union, sites).select(F.col("step").cast("long").alias("step"), "stage", "count")
