"""Domain-shaped frames built from the general test tables.

Each stand-in comes with the SQL that builds the same rows, so a check compares
the operator and not the stand-in.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitewise.functions.sequences import to_acgt

MISSING_BELOW = -0.1

VECTORS_SQL = """
vl AS (
  SELECT vec_id, label, vec_id % 64 + 1 AS c, p, CASE WHEN x > -0.1::DOUBLE THEN x END AS v
  FROM (SELECT vec_id, label, unnest(range(1, len(embedding) + 1)) AS p, unnest(embedding)::DOUBLE AS x FROM embeddings)
)"""


def vectors(t) -> DataFrame:
    """Embeddings as signal vectors: low values are unmeasured, the centre runs over the vector."""
    return t("embeddings").select(
        "vec_id", F.col("label").cast("long").alias("label"), (F.col("vec_id") % 64 + 1).alias("c"),
        F.transform("embedding", lambda x: F.when(x.cast("double") > MISSING_BELOW, x.cast("double"))).alias("values"))


SEQUENCES_SQL = """
seqs AS (
  SELECT doc_id, lang, source,
         regexp_replace(translate(lower(text), 'abcdefghijklmnopqrstuvwxyz', 'ACGTACGTACGTACGTACGTACGTAC'), '[^ACGT]', '', 'g') AS seq
  FROM documents
)"""


def sequences(t) -> DataFrame:
    return t("documents").select("doc_id", "lang", "source", to_acgt(F.col("text")).alias("seq"))


# Intervals come from parts, in integer cents; points are unit prices of order lines.
EXONS_SQL = """
exons AS (
  SELECT p_partkey AS tid, CASE WHEN p_partkey % 2 = 0 THEN '+' ELSE '-' END AS strand, p_brand AS gene,
         CAST(round(p_retailprice * 100) AS BIGINT) AS s, CAST(round(p_retailprice * 100) AS BIGINT) + p_size * 10 - 1 AS e
  FROM part
)"""
POINTS_SQL = """
points AS (
  SELECT DISTINCT CAST(round(l_extendedprice / l_quantity * 100) AS BIGINT) AS pos,
         CASE WHEN l_partkey % 2 = 0 THEN '+' ELSE '-' END AS strand
  FROM lineitem
)"""
PRICE_BIN = 1024


def exons(t) -> DataFrame:
    start = F.round(F.col("p_retailprice") * 100).cast("long")
    return t("part").select(
        F.lit("chr1").alias("chrom"), start.alias("start"), (start + F.col("p_size") * 10 - 1).alias("end"),
        F.when(F.col("p_partkey") % 2 == 0, "+").otherwise("-").alias("strand"), F.col("p_partkey").alias("tid"),
        F.col("p_brand").alias("gene_name"), F.lit(1).cast("long").alias("tx_start"))


def unit_price_cents() -> Column:
    return F.round(F.col("l_extendedprice") / F.col("l_quantity") * 100).cast("long")


def points(t) -> DataFrame:
    return t("lineitem").select(
        F.lit("chr1").alias("chrom"), unit_price_cents().alias("pos"),
        F.when(F.col("l_partkey") % 2 == 0, "+").otherwise("-").alias("strand")).distinct()


BLOCKS_SQL = """
blocks AS (
  SELECT 'chr' || (k % 5) AS sc, k * 1000 AS ss, k * 1000 + 800 + (k % 7) * 100 AS se,
         'chr' || ((k + 2) % 5) AS tc, k * 1000 + (k % 13) * 50000 AS ts,
         k * 1000 + (k % 13) * 50000 + 800 + (k % 7) * 100 AS te,
         CASE WHEN k % 2 = 0 THEN '+' ELSE '-' END AS strand, 1000 + k % 17 AS score
  FROM (SELECT p_partkey AS k FROM part)
)"""


def blocks(t) -> DataFrame:
    k = F.col("p_partkey")
    width = 800 + (k % 7) * 100
    to = k * 1000 + (k % 13) * 50000
    return t("part").select(
        F.concat(F.lit("chr"), (k % 5).cast("string")).alias("source_chrom"), (k * 1000).alias("source_start"),
        (k * 1000 + width).alias("source_end"), F.concat(F.lit("chr"), ((k + 2) % 5).cast("string")).alias("target_chrom"),
        to.alias("target_start"), (to + width).alias("target_end"), F.lit(10**9).cast("long").alias("target_size"),
        F.when(k % 2 == 0, "+").otherwise("-").alias("target_strand"), (1000 + k % 17).alias("score"), k.alias("chain_id"))


LIFT_POINTS_SQL = """
lp AS (
  SELECT DISTINCT 'chr' || (l_partkey % 5) AS chrom, l_partkey * 1000 + l_suppkey * 37 % 1400 + 1 AS pos,
         CASE WHEN l_linenumber % 2 = 0 THEN '+' ELSE '-' END AS strand
  FROM lineitem
)"""


def lift_points(t) -> DataFrame:
    return t("lineitem").select(
        F.concat(F.lit("chr"), (F.col("l_partkey") % 5).cast("string")).alias("chrom"),
        (F.col("l_partkey") * 1000 + F.col("l_suppkey") * 37 % 1400 + 1).alias("pos"),
        F.when(F.col("l_linenumber") % 2 == 0, "+").otherwise("-").alias("strand")).distinct()


# Replicates: order lines by status and ship date, one row per part.
REPLICATES_SQL = """
r1 AS (SELECT l_partkey AS k, CAST(sum(l_quantity) AS BIGINT) AS ag, round(sum(l_quantity * l_discount), 4) AS a,
              CASE WHEN l_partkey % 9 = 0 THEN 'ELSE' ELSE 'g' || (l_partkey % 7) END AS gene
       FROM lineitem WHERE l_linestatus = 'O' AND l_shipdate < TIMESTAMP '1996-01-01' GROUP BY l_partkey),
r2 AS (SELECT l_partkey AS k, CAST(sum(l_quantity) AS BIGINT) AS ag, round(sum(l_quantity * l_discount), 4) AS a,
              CASE WHEN l_partkey % 4 = 0 THEN 'ELSE' ELSE 'g' || (l_partkey % 11) END AS gene
       FROM lineitem WHERE l_linestatus = 'F' AND l_shipdate >= TIMESTAMP '1996-01-01' GROUP BY l_partkey)"""


def replicates(t) -> tuple[DataFrame, DataFrame]:
    li = t("lineitem")
    early = F.col("l_shipdate") < F.lit("1996-01-01").cast("timestamp")

    def rep(df, every, mod):
        gene = F.when(F.col("k") % every == 0, "ELSE").otherwise(F.concat(F.lit("g"), (F.col("k") % mod).cast("string")))
        return df.groupBy(F.col("l_partkey").alias("k")).agg(
            F.sum("l_quantity").cast("long").alias("agcov"),
            F.round(F.sum(F.col("l_quantity") * F.col("l_discount")), 4).alias("acov")).withColumn("gene", gene)

    return rep(li.where((F.col("l_linestatus") == "O") & early), 9, 7), \
        rep(li.where((F.col("l_linestatus") == "F") & ~early), 4, 11)


def r6(col: Column, digits: int = 6) -> Column:
    """Rounded for comparison; adding zero turns -0.0 into 0.0."""
    return F.round(col.cast("double"), digits) + F.lit(0.0)


def _step(x: str, shift: int, factor: int) -> str:
    return f"(xor({x}, {x} >> {shift}) * {factor}::UBIGINT) % 4294967296::UBIGINT"


def draws_sql(name: str, source: str, seed: int, key: str, replicates: int) -> str:
    """CTE ``name``: every row of ``source`` per replicate ``rep`` with its uniform 32-bit number ``h``."""
    words = ", ".join(f"('0x' || substr(md5('{seed}|' || {key}), {at}, 8))::UBIGINT AS {n}" for at, n in ((1, "hi"), (9, "lo")))
    return f"""
{name} AS (
  SELECT *, (lo + rep::UBIGINT * 2654435769::UBIGINT) % 4294967296::UBIGINT AS a0, {_step("a0", 16, 2246822507)} AS a1, {_step("a1", 13, 3266489909)} AS a2,
         xor(hi, xor(a2, a2 >> 16)) AS b0, {_step("b0", 16, 2246822507)} AS b1, {_step("b1", 13, 3266489909)} AS b2, xor(b2, b2 >> 16) AS h
  FROM (SELECT *, {words} FROM {source}), range({replicates}) r(rep))"""


# The distribution function of a Poisson count of mean 1 at 0 to 12.
POISSON_ONE = "[0.36787944117144233, 0.7357588823428847, 0.9196986029286058, 0.9810118431238462, 0.9963401531726563, 0.9994058151824183, 0.9999167588507119, 0.9999897508033253, 0.9999988747974021, 0.9999998885745217, 0.9999999899522336, 0.9999999991684075, 0.9999999999364221]"
POISSON_COUNT = f"len(list_filter({POISSON_ONE}, lambda q: h / 4294967296.0 >= q))"


def median_sql(source: str, seed: int, replicates: int, p: str = "") -> str:
    """CTEs up to ``{p}med (rep, estimate)``: the bootstrap of the median of ``v`` in table ``source``."""
    return f"""
{p}hi0 AS (SELECT v, count(*) AS n FROM {source} GROUP BY v), {p}tot AS (SELECT sum(n) AS t, 3.5 / sqrt(sum(n)::DOUBLE) AS r FROM {p}hi0),
{p}rk AS (SELECT v, row_number() OVER (ORDER BY v) - 1 AS k FROM {source}),
{p}cut AS (
  SELECT any_value(lo) AS lo, any_value(hi) AS hi FROM (
    SELECT (SELECT v FROM {p}rk, {p}tot WHERE k = floor((t - 1) * greatest(0.0, 0.5 - r))) AS lo,
           (SELECT v FROM {p}rk, {p}tot WHERE k = ceil((t - 1) * least(1.0, 0.5 + r))) AS hi)),
{p}ins AS (SELECT v, n, row_number() OVER (ORDER BY v)::VARCHAR AS name FROM {p}hi0, {p}cut WHERE v BETWEEN lo AND hi),
{p}src AS (
  SELECT v, n, name FROM {p}ins UNION ALL SELECT CASE name WHEN 'below' THEN -1e300 ELSE 1e300 END, n, name FROM (
    SELECT CASE WHEN v < lo THEN 'below' ELSE 'above' END AS name, sum(n) AS n FROM {p}hi0, {p}cut WHERE v < lo OR v > hi GROUP BY 1)),
{p}pmf AS (
  SELECT n, k, sum(exp(-n::DOUBLE + k * ln(n::DOUBLE) - lgamma(k + 1.0::DOUBLE))) OVER (PARTITION BY n ORDER BY k) AS upto
  FROM (SELECT DISTINCT n, unnest(range(greatest(0, floor(n - 12 * sqrt(n) - 20))::BIGINT, ceil(n + 12 * sqrt(n) + 20)::BIGINT + 1)) AS k FROM {p}src)),
{draws_sql(p + "dr", p + "src", seed, "name", replicates)},
{p}cn AS (
  SELECT d.rep, d.v, coalesce(c.k + 1, greatest(0, floor(d.n - 12 * sqrt(d.n) - 20)))::BIGINT AS c
  FROM (SELECT rep, v, n, h / 4294967296.0::DOUBLE AS u FROM {p}dr) d ASOF LEFT JOIN {p}pmf c ON d.n = c.n AND d.u >= c.upto),
{p}cum AS (SELECT rep, v, sum(c) OVER (PARTITION BY rep ORDER BY v) AS upto, sum(c) OVER (PARTITION BY rep) AS w FROM {p}cn),
{p}med AS (
  SELECT rep, (min(v) FILTER (upto >= (w - 1) // 2 + 1) + min(v) FILTER (upto >= w // 2 + 1)) / 2 AS estimate FROM {p}cum WHERE w > 0 GROUP BY rep)"""
