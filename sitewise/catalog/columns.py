"""Scalar, sequence and text-table column functions."""

from pyspark.sql import functions as F

from sitewise.catalog.registry import query
from sitewise.catalog.standins import SEQUENCES_SQL, r6, sequences
from sitewise.functions import scalars as S
from sitewise.functions import sequences as Q
from sitewise.functions.hashing import content_key
from sitewise.operators.aggregates import quantile_bin, reason_counts
from sitewise.sources.readers import locus_mirror_mismatches, parse_locus_strings


@query("normalised_chromosomes", """
SELECT name, CAST(count(*) AS BIGINT) AS n FROM (
  SELECT CASE WHEN raw LIKE 'chr%' THEN raw WHEN raw = 'MT' THEN 'chrM' ELSE 'chr' || raw END AS name FROM (
    SELECT trim(CASE WHEN p_partkey % 4 = 0 THEN 'MT' WHEN p_partkey % 4 = 1 THEN 'chr' || (p_partkey % 23)
                     ELSE ' ' || (p_partkey % 23) || ' ' END) AS raw FROM part)) GROUP BY name""")
def _(t):
    k = F.col("p_partkey")
    raw = F.when(k % 4 == 0, "MT").when(k % 4 == 1, F.concat(F.lit("chr"), (k % 23).cast("string"))) \
        .otherwise(F.concat(F.lit(" "), (k % 23).cast("string"), F.lit(" ")))
    return t("part").select(S.norm_chr(raw).alias("name")).groupBy("name").agg(F.count(F.lit(1)).alias("n"))


@query("missing_tokens_and_lenient_numbers", """
WITH x AS (SELECT l_returnflag AS flag, CASE l_linenumber WHEN 1 THEN '' WHEN 2 THEN 'NA' WHEN 3 THEN '-999'
                  WHEN 4 THEN 'abc' WHEN 5 THEN '.' ELSE CAST(CAST(l_quantity AS BIGINT) AS VARCHAR) END AS raw,
                  CASE WHEN l_linenumber % 2 = 0 THEN 'True' ELSE 'False' END AS ok FROM lineitem)
SELECT flag, CAST(count(*) AS BIGINT) AS n,
       CAST(sum(CASE WHEN raw IN ('', 'NULL', 'NA', 'N/A', 'NaN', 'nan', '.', '-999') THEN 1 ELSE 0 END) AS BIGINT) AS missing,
       CAST(count(CASE WHEN raw NOT IN ('', 'NULL', 'NA', 'N/A', 'NaN', 'nan', '.', '-999') THEN try_cast(raw AS DOUBLE) END) AS BIGINT) AS numeric_n,
       round(sum(CASE WHEN raw NOT IN ('', 'NULL', 'NA', 'N/A', 'NaN', 'nan', '.', '-999') THEN try_cast(raw AS DOUBLE) END), 4) AS total,
       CAST(sum(CASE WHEN ok = 'True' THEN 1 ELSE 0 END) AS BIGINT) AS flagged
FROM x GROUP BY flag""")
def _(t):
    n = F.col("l_linenumber")
    raw = F.when(n == 1, "").when(n == 2, "NA").when(n == 3, "-999").when(n == 4, "abc").when(n == 5, ".") \
        .otherwise(F.col("l_quantity").cast("long").cast("string"))
    ok = F.when(n % 2 == 0, "True").otherwise("False")
    x = t("lineitem").select(F.col("l_returnflag").alias("flag"), S.null_tokens(raw).alias("v"), S.is_true_text(ok).alias("ok"))
    num = S.lenient_double(F.col("v"))
    return x.groupBy("flag").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("v").isNull()).alias("missing"), F.count(num).alias("numeric_n"),
        F.round(F.sum(num), 4).alias("total"), F.count_if("ok").alias("flagged"))


@query("site_ids_and_versions", """
SELECT CAST(o_orderkey AS BIGINT) AS o_orderkey,
       o_orderstatus || ':' || o_custkey || ':' || left(o_orderpriority, 1) AS site_id,
       'T' || o_orderkey || CASE WHEN o_orderkey % 3 = 0 THEN '' ELSE '.' || (o_orderkey % 3) END AS versioned,
       'T' || o_orderkey AS bare FROM orders""")
def _(t):
    k = F.col("o_orderkey")
    tid = F.concat(F.lit("T"), k.cast("string"))
    versioned = S.with_version(tid, F.when(k % 3 == 0, "").otherwise((k % 3).cast("string")))
    return t("orders").select(
        "o_orderkey", S.site_id("o_orderstatus", "o_custkey", F.left("o_orderpriority", F.lit(1))).alias("site_id"),
        versioned.alias("versioned"), S.strip_version(versioned).alias("bare"))


@query("transcript_genome_arithmetic", """
WITH x AS (SELECT p_partkey AS k, p_partkey * 100 AS s, p_partkey * 100 + p_size - 1 AS e,
                  CASE WHEN p_partkey % 2 = 0 THEN '+' ELSE '-' END AS strand, p_partkey % 9 + 1 AS tx0,
                  p_partkey % p_size AS d FROM part)
SELECT CAST(k AS BIGINT) AS k, CAST(CASE WHEN strand = '+' THEN s + d ELSE e - d END AS BIGINT) AS genome_pos,
       CAST(tx0 + d AS BIGINT) AS tx_pos FROM x""")
def _(t):
    k, size = F.col("p_partkey"), F.col("p_size")
    x = t("part").select(
        k.alias("k"), (k * 100).alias("s"), (k * 100 + size - 1).alias("e"),
        F.when(k % 2 == 0, "+").otherwise("-").alias("strand"), (k % 9 + 1).alias("tx0"), (k % size).alias("d"))
    x = x.withColumn("genome_pos", S.tx_to_genome(F.col("s"), F.col("e"), F.col("strand"), F.col("tx0"), F.col("tx0") + F.col("d")))
    back = S.genome_to_tx(F.col("s"), F.col("e"), F.col("strand"), F.col("tx0"), F.col("genome_pos"))
    return x.select("k", "genome_pos", back.alias("tx_pos"))


@query("sequence_windows_and_motifs", f"""
WITH {SEQUENCES_SQL}, c AS (SELECT doc_id, seq, length(seq) AS n, doc_id * 7 % greatest(length(seq), 1) + 1 AS pos FROM seqs),
w AS (SELECT *, CASE WHEN pos > 100 AND pos <= n - 100 THEN substring(seq, pos - 100, 201) ELSE '' END AS w201,
             CASE WHEN pos > 10 AND pos <= n - 10 THEN substring(seq, pos - 10, 21) ELSE '' END AS w21,
             CASE WHEN pos > 2 AND pos <= n - 2 THEN substring(seq, pos - 2, 5) ELSE '' END AS m5 FROM c)
SELECT CAST(doc_id AS BIGINT) AS doc_id, CAST(length(w201) AS BIGINT) AS n201, sha256(w201) AS key201, m5 AS motif,
       CASE WHEN length(m5) <> 5 THEN 'window_unavailable'
            WHEN regexp_matches(m5, '^[AGT][AG]AC[ACT]$') THEN m5 ELSE 'non_DRACH' END AS motif_class,
       round(CASE WHEN length(w21) > 0 THEN length(regexp_replace(w21, '[^GC]', '', 'g')) / length(w21) END, 6) AS gc,
       regexp_matches(replace(upper(w21), 'U', 'T'), '^[ACGT]+$') AS acgt_only
FROM w""")
def _(t):
    pos = F.col("doc_id") * 7 % F.greatest(F.length("seq"), F.lit(1)) + 1
    x = sequences(t).withColumn("pos", pos.cast("int"))
    seq, p = F.col("seq"), F.col("pos")
    x = x.select("doc_id", Q.seq_window(seq, p, 100).alias("w201"), Q.seq_window(seq, p, 10).alias("w21"),
                 Q.seq_window(seq, p, 2).alias("motif"))
    return x.select(
        "doc_id", F.length("w201").cast("long").alias("n201"), content_key(F.col("w201")).alias("key201"), "motif",
        Q.motif_class(F.col("motif")).alias("motif_class"), r6(Q.gc_fraction(F.col("w21"))).alias("gc"),
        Q.is_acgt(Q.normalise_sequence(F.col("w21"))).alias("acgt_only"))


@query("kmer_profile_by_language", f"""
WITH {SEQUENCES_SQL}, k AS (SELECT doc_id, lang, length(seq) - 2 AS d, substring(seq, i, 3) AS kmer
  FROM (SELECT doc_id, lang, seq, unnest(range(1, length(seq) - 1)) AS i FROM seqs WHERE length(seq) >= 3)),
f AS (SELECT doc_id, lang, kmer, count(*) / greatest(min(d), 1) AS f FROM k GROUP BY doc_id, lang, kmer)
SELECT lang, kmer, CAST(count(*) AS BIGINT) AS docs, round(sum(f), 6) AS total_fraction FROM f GROUP BY lang, kmer""")
def _(t):
    vec = sequences(t).select("lang", Q.kmer_fractions(3)("seq").alias("v"))
    names = F.array(*[F.lit(k) for k in Q.kmer_names(3)])
    long = vec.select("lang", F.posexplode("v").alias("i", "f")).where("f > 0")
    return long.groupBy("lang", F.get(names, F.col("i")).alias("kmer")).agg(
        F.count(F.lit(1)).alias("docs"), r6(F.sum("f")).alias("total_fraction"))


@query("kmer_counts_whole_text", f"""
WITH {SEQUENCES_SQL} SELECT kmer, CAST(count(*) AS BIGINT) AS n FROM (
  SELECT substring(seq, i, 3) AS kmer FROM (SELECT seq, unnest(range(1, length(seq) - 1)) AS i FROM seqs WHERE length(seq) >= 3))
GROUP BY kmer""")
def _(t):
    return sequences(t).select(F.explode(Q.kmers(F.col("seq"), 3)).alias("kmer")).groupBy("kmer").agg(F.count(F.lit(1)).alias("n"))


@query("position_one_hot_totals", f"""
WITH {SEQUENCES_SQL} SELECT CAST(i - 1 AS BIGINT) AS position, b AS base, CAST(sum(CASE WHEN substring(seq, i, 1) = b THEN 1 ELSE 0 END) AS BIGINT) AS n
FROM seqs, range(1, 22) r(i), (VALUES ('A'), ('C'), ('G'), ('T')) v(b) GROUP BY i, b""")
def _(t):
    hot = sequences(t).select(F.posexplode(Q.position_one_hot(F.col("seq"), 21)).alias("i", "x"))
    base = F.get(F.array(*[F.lit(b) for b in Q.BASES]), F.col("i") % 4)
    return hot.groupBy(F.floor(F.col("i") / 4).alias("position"), base.alias("base")).agg(F.sum("x").cast("long").alias("n"))


@query("sequence_letter_totals", f"""
WITH {SEQUENCES_SQL} SELECT source, substring(seq, i, 1) AS base, CAST(count(*) AS BIGINT) AS n
FROM (SELECT source, seq, unnest(range(1, length(seq) + 1)) AS i FROM seqs) GROUP BY source, base""")
def _(t):
    letters = sequences(t).select("source", F.explode(Q.kmers(F.col("seq"), 1)).alias("base"))
    return letters.groupBy("source", "base").agg(F.count(F.lit(1)).alias("n"))


@query("content_keys", """
SELECT CAST(doc_id AS BIGINT) AS doc_id, sha256(text) AS key FROM documents""")
def _(t):
    return t("documents").select("doc_id", content_key(F.col("text")).alias("key"))


@query("region_and_anchor_columns", """
SELECT CAST(o_orderkey AS BIGINT) AS o_orderkey,
  CASE WHEN cds0 IS NULL OR cds1 IS NULL THEN 'noncoding_or_CDS_unavailable' WHEN pos < cds0 THEN '5UTR'
       WHEN pos <= cds1 THEN 'CDS' ELSE '3UTR' END AS region,
  round(pos / len, 8) AS position_fraction, CAST(pos - cds0 AS DOUBLE) AS anchor_distance
FROM (SELECT o_orderkey, o_custkey % 400 AS pos, CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE o_orderkey % 150 END AS cds0,
             CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE o_orderkey % 150 + 120 END AS cds1, 400 + o_orderkey % 90 AS len FROM orders)""")
def _(t):
    k = F.col("o_orderkey")
    x = t("orders").select(
        "o_orderkey", (F.col("o_custkey") % 400).alias("pos"), F.when(k % 5 != 0, k % 150).alias("cds0"),
        F.when(k % 5 != 0, k % 150 + 120).alias("cds1"), (400 + k % 90).alias("len"))
    return x.select("o_orderkey", S.region_class(F.col("pos"), F.col("cds0"), F.col("cds1")).alias("region"),
                    S.position_fraction(F.col("pos"), F.col("len")).alias("position_fraction"),
                    S.anchor_distance(F.col("pos"), F.col("cds0")).cast("double").alias("anchor_distance"))


@query("log_covariates_and_clip", """
SELECT l_returnflag, round(sum(ln(1 + l_quantity)), 4) AS log1p_total, round(sum(log2(l_extendedprice)), 4) AS log2_total,
       round(sum(greatest(0.0, least(1.0, l_extendedprice / 100000 - 0.2))), 4) AS clipped_total,
       CAST(sum(CASE WHEN l_extendedprice / 100000 - 0.2 <= 0 THEN 1 ELSE 0 END) AS BIGINT) AS at_zero
FROM lineitem GROUP BY l_returnflag""")
def _(t):
    c = S.clip(F.col("l_extendedprice") / 100000 - 0.2)
    return t("lineitem").groupBy("l_returnflag").agg(
        r6(F.sum(F.log1p("l_quantity")), 4).alias("log1p_total"), r6(F.sum(F.log2("l_extendedprice")), 4).alias("log2_total"),
        r6(F.sum(c), 4).alias("clipped_total"), F.count_if(c == 0).alias("at_zero"))


@query("analysis_gene_priority", """
WITH x AS (SELECT p_partkey AS k,
    CASE p_partkey % 4 WHEN 0 THEN 'ELSE' WHEN 1 THEN p_brand || ';' || p_type WHEN 2 THEN 'ELSE;' || p_type ELSE '' END AS genes,
    CASE WHEN p_partkey % 3 = 0 THEN '' ELSE p_brand END AS name, 'ID' || p_partkey AS gid FROM part)
SELECT CAST(k AS BIGINT) AS k, (name <> '' AND list_contains(string_split(genes, ';'), name)) AS matches,
  CASE WHEN name <> '' AND list_contains(kept, name) THEN name WHEN len(kept) > 0 THEN kept[1] WHEN name <> '' THEN name ELSE gid END AS gene,
  CASE WHEN name <> '' AND list_contains(kept, name) THEN 'submitted_gene_matching_transcript' WHEN len(kept) > 0 THEN 'submitted_gene'
       WHEN name <> '' THEN 'annotation_gene_name' ELSE 'annotation_gene_id' END AS gene_source
FROM (SELECT *, list_filter(string_split(genes, ';'), lambda g: g <> '' AND g <> 'ELSE') AS kept FROM x)""")
def _(t):
    k = F.col("p_partkey")
    genes = F.when(k % 4 == 0, "ELSE").when(k % 4 == 1, F.concat_ws(";", "p_brand", "p_type")) \
        .when(k % 4 == 2, F.concat(F.lit("ELSE;"), "p_type")).otherwise("")
    x = t("part").select(k.alias("k"), genes.alias("genes"), F.when(k % 3 == 0, "").otherwise(F.col("p_brand")).alias("name"),
                         F.concat(F.lit("ID"), k.cast("string")).alias("gid"))
    gene, source = S.analysis_gene(F.col("genes"), F.col("name"), F.col("gid"))
    return x.select("k", S.list_contains(F.col("genes"), F.col("name")).alias("matches"), gene.alias("gene"), source.alias("gene_source"))


@query("edge_distances", """
WITH x AS (SELECT o_orderkey AS k, o_custkey % 300 AS pos, CASE WHEN o_orderkey % 6 = 0 THEN [] ELSE
    [o_orderkey % 50, o_orderkey % 50 + 1, 120 + o_orderkey % 60, 121 + o_orderkey % 60] END AS edges FROM orders)
SELECT CAST(k AS BIGINT) AS k, CAST(list_min(list_transform(edges, lambda e: abs(pos - e))) AS DOUBLE) AS distance,
       len(list_filter(edges, lambda e: abs(pos - e) <= 2)) > 0 AS boundary FROM x""")
def _(t):
    k = F.col("o_orderkey")
    edges = F.when(k % 6 != 0, F.array(k % 50, k % 50 + 1, 120 + k % 60, 121 + k % 60)).otherwise(F.array().cast("array<bigint>"))
    x = t("orders").select(k.alias("k"), (F.col("o_custkey") % 300).alias("pos"), edges.alias("edges"))
    return x.select("k", S.nearest_edge_distance(F.col("pos"), F.col("edges")).cast("double").alias("distance"),
                    S.near_edge(F.col("pos"), F.col("edges")).alias("boundary"))


@query("identity_checks", """
SELECT l_linestatus, CAST(count(*) AS BIGINT) AS n,
  CAST(sum(CASE WHEN abs(stored - round(num / l_quantity, 5)) > 5e-6 THEN 1 ELSE 0 END) AS BIGINT) AS ratio_bad,
  CAST(sum(CASE WHEN abs(prod - stored * (1 - l_tax)) > 1e-10 THEN 1 ELSE 0 END) AS BIGINT) AS product_bad
FROM (SELECT *, floor(l_quantity * l_discount) AS num,
        round(floor(l_quantity * l_discount) / l_quantity, 5) + CASE WHEN l_partkey % 11 = 0 THEN 0.01 ELSE 0 END AS stored,
        (round(floor(l_quantity * l_discount) / l_quantity, 5) + CASE WHEN l_partkey % 11 = 0 THEN 0.01 ELSE 0 END) * (1 - l_tax)
          + CASE WHEN l_suppkey % 7 = 0 THEN 1e-6 ELSE 0 END AS prod FROM lineitem) GROUP BY l_linestatus""")
def _(t):
    num = F.floor(F.col("l_quantity") * F.col("l_discount")).cast("double")
    stored = F.round(num / F.col("l_quantity"), 5) + F.when(F.col("l_partkey") % 11 == 0, 0.01).otherwise(0.0)
    x = t("lineitem").withColumns({"num": num, "stored": stored}).withColumn(
        "prod", F.col("stored") * (1 - F.col("l_tax")) + F.when(F.col("l_suppkey") % 7 == 0, 1e-6).otherwise(0.0))
    return x.groupBy("l_linestatus").agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(S.ratio_mismatch(F.col("stored"), F.col("num"), F.col("l_quantity"))).alias("ratio_bad"),
        F.count_if(S.product_mismatch(F.col("prod"), F.col("stored"), 1 - F.col("l_tax"))).alias("product_bad"))


@query("exclusion_reasons", """
SELECT CASE WHEN reason = '' THEN 'retained' ELSE reason END AS reason, CAST(count(*) AS BIGINT) AS count FROM (
  SELECT CASE WHEN l_partkey % 50 = 0 THEN 'prespecified' WHEN l_linestatus = 'F' AND l_tax < 0.02 THEN 'not_in_both'
              WHEN l_quantity < 10 THEN 'low_coverage' ELSE '' END AS reason FROM lineitem) GROUP BY 1""")
def _(t):
    reason = S.reason_cascade([
        (F.col("l_partkey") % 50 == 0, "prespecified"),
        ((F.col("l_linestatus") == "F") & (F.col("l_tax") < 0.02), "not_in_both"),
        (F.col("l_quantity") < 10, "low_coverage")])
    return reason_counts(t("lineitem"), reason)


@query("expected_base_check", f"""
WITH {SEQUENCES_SQL}
SELECT lang, CAST(count(*) AS BIGINT) AS n, CAST(sum(CASE WHEN base = want THEN 1 ELSE 0 END) AS BIGINT) AS ok FROM (
  SELECT lang, CASE WHEN doc_id % 2 = 0 THEN 'A' ELSE 'T' END AS want,
         CASE WHEN doc_id % 97 + 1 <= length(seq) THEN substring(seq, doc_id % 97 + 1, 1) END AS base FROM seqs) GROUP BY lang""")
def _(t):
    strand = F.when(F.col("doc_id") % 2 == 0, "+").otherwise("-")
    base = Q.base_at(F.col("seq"), (F.col("doc_id") % 97 + 1).cast("int"))
    return sequences(t).groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.count_if(S.expected_base_ok(strand, base)).alias("ok"))


@query("delta_columns", """
SELECT o_orderpriority, round(sum(o_totalprice - prev), 2) AS delta, round(avg((o_totalprice + prev) / 2), 4) AS mean
FROM (SELECT *, o_custkey * 100.0 AS prev FROM orders) GROUP BY o_orderpriority""")
def _(t):
    prev = F.col("o_custkey") * 100.0
    return t("orders").groupBy("o_orderpriority").agg(
        r6(F.sum(S.delta(F.col("o_totalprice"), prev)), 2).alias("delta"), r6(F.avg((F.col("o_totalprice") + prev) / 2), 4).alias("mean"))


@query("url_syntax", """
SELECT ok, CAST(count(*) AS BIGINT) AS n FROM (
  SELECT regexp_matches(lower(u), '^https?://[^/?#]+') AS ok FROM (
    SELECT CASE page_id % 5 WHEN 0 THEN replace(url, '://', ':/') WHEN 1 THEN 'ftp' || substring(url, 5) ELSE url END AS u FROM pages)) GROUP BY ok""")
def _(t):
    k = F.col("page_id") % 5
    u = F.when(k == 0, F.replace("url", F.lit("://"), F.lit(":/"))).when(k == 1, F.concat(F.lit("ftp"), F.substring(F.col("url"), F.lit(5), F.length("url")))).otherwise(F.col("url"))
    return t("pages").groupBy(S.is_http_url(u).alias("ok")).agg(F.count(F.lit(1)).alias("n"))


@query("quantile_bins", """
WITH e AS (SELECT quantile_cont(o_totalprice, [0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1.0]) AS q FROM orders)
SELECT CAST(bin AS BIGINT) AS bin, CAST(count(*) AS BIGINT) AS n, round(min(o_totalprice), 4) AS low, round(max(o_totalprice), 4) AS high
FROM (SELECT o_totalprice, len(list_filter(q[2:10], lambda x: x < o_totalprice)) + 1 AS bin FROM orders, e) GROUP BY bin""")
def _(t):
    return quantile_bin(t("orders"), "o_totalprice", 10).groupBy(F.col("bin").cast("long").alias("bin")).agg(
        F.count(F.lit(1)).alias("n"), r6(F.min("o_totalprice"), 4).alias("low"), r6(F.max("o_totalprice"), 4).alias("high"))


@query("fixed_edge_bins", """
SELECT CAST(bin AS BIGINT) AS bin, CAST(count(*) AS BIGINT) AS n, round(sum(l_extendedprice), 2) AS total
FROM (SELECT *, len(list_filter([10, 20, 30, 40], lambda e: e <= l_quantity)) + 1 AS bin FROM lineitem) GROUP BY bin""")
def _(t):
    edges = F.array(*[F.lit(float(e)) for e in (10, 20, 30, 40)])
    return t("lineitem").groupBy(S.bin_left_closed(F.col("l_quantity"), edges).cast("long").alias("bin")).agg(
        F.count(F.lit(1)).alias("n"), r6(F.sum("l_extendedprice"), 2).alias("total"))


@query("parsed_locus_strings", """
SELECT 'chr' || (l_suppkey % 22) AS chrom, CAST(l_partkey AS BIGINT) AS pos, CASE WHEN l_tax > 0.04 THEN '+' ELSE '-' END AS strand,
       round((l_discount + l_tax + l_quantity) / 3, 6) AS mean_rate FROM lineitem""")
def _(t):
    strand = F.when(F.col("l_tax") > 0.04, "+").otherwise("-")
    x = t("lineitem").withColumn("Loci", F.concat_ws(
        ":", F.concat(F.lit("chr"), (F.col("l_suppkey") % 22).cast("string")), F.col("l_partkey").cast("string"), F.lit("C"), strand))
    return parse_locus_strings(x).select("chrom", "pos", "strand",
                                         r6((F.col("l_discount") + F.col("l_tax") + F.col("l_quantity")) / 3).alias("mean_rate"))


@query("locus_mirror_mismatches", """
SELECT CAST(sum(CASE WHEN l_linenumber = 7 OR l_suppkey % 10 = 3 THEN 1 ELSE 0 END) AS BIGINT) AS mismatches FROM lineitem""")
def _(t):
    strand = F.when(F.col("l_tax") > 0.04, "+").otherwise("-")
    chrom = F.concat(F.lit("chr"), (F.col("l_suppkey") % 22).cast("string"))
    x = t("lineitem").withColumns({
        "Loci": F.concat_ws(":", chrom, F.col("l_partkey").cast("string"), F.lit("C"), strand),
        "mirror_chrom": F.when(F.col("l_suppkey") % 10 == 3, F.lit("chrX")).otherwise(chrom),
        "mirror_start": F.col("l_partkey") - F.when(F.col("l_linenumber") == 7, 2).otherwise(1),
        "mirror_end": F.col("l_partkey"), "mirror_strand": strand})
    return locus_mirror_mismatches(parse_locus_strings(x), "mirror_chrom", "mirror_start", "mirror_end", "mirror_strand")
