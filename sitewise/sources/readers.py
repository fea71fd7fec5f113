"""Text formats to typed frames. Missing values are NULL from here on, never NaN."""

from __future__ import annotations

import gzip
import io
import tarfile
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sitewise.functions.scalars import MISSING_TOKENS, norm_chr, null_tokens, with_version
from sitewise.functions.vectors import parse_array_json
from sitewise.operators.quality import require_constraints, schema_contract

# The columns of one replicate's site table.
SITE_SCHEMA = T.StructType([
    T.StructField("Chr", T.StringType()), T.StructField("Sites", T.LongType()),
    T.StructField("Strand", T.StringType()), T.StructField("Gene", T.StringType()),
    T.StructField("Transcript", T.StringType()), T.StructField("NonCR", T.DoubleType()),
    T.StructField("AGcov", T.LongType()), T.StructField("Acov", T.LongType()),
    T.StructField("Genecov", T.DoubleType()), T.StructField("Ratio", T.DoubleType()),
    T.StructField("NormeRatio", T.DoubleType()), T.StructField("Pvalue", T.DoubleType()),
    T.StructField("P_adjust", T.DoubleType()), T.StructField("Sample", T.StringType()),
])


def read_site_table(spark: SparkSession, path, schema: T.StructType = SITE_SCHEMA) -> DataFrame:
    """Tab-separated site table with a header; every column is read as text, then typed."""
    text = T.StructType([T.StructField(f.name, T.StringType()) for f in schema])
    raw = spark.read.csv(path, sep="\t", header=True, schema=text, enforceSchema=False)
    return raw.select(*[null_tokens(F.trim(f.name)).cast(f.dataType).alias(f.name) for f in schema])


def site_keys(df: DataFrame) -> DataFrame:
    """Normalised ``chrom, pos, strand`` in front of the other columns."""
    return df.select(norm_chr(F.col("Chr")).alias("chrom"), F.col("Sites").alias("pos"), F.col("Strand").alias("strand"),
                     *[c for c in df.columns if c not in ("Chr", "Sites", "Strand")])


def parse_signal_lines(lines: DataFrame, col: str = "value", tokens: Sequence[str] = MISSING_TOKENS) -> DataFrame:
    """``id, length, abundance, v1..vN`` lines to ``tid, length, abundance, values``.

    Only the missing-value tokens become NULL; any other text that is no number fails (ANSI casts).
    """
    f = F.split(F.regexp_replace(col, "[\r\n]+$", ""), "\t")
    values = F.transform(F.slice(f, F.lit(4), F.greatest(F.size(f) - 3, F.lit(0))),
                         lambda x: null_tokens(x, tokens).cast("float"))
    values = F.transform(values, lambda x: F.when(~F.isnan(x), x))
    return lines.where(F.length(F.trim(col)) > 0).select(
        F.get(f, F.lit(0)).alias("tid"), F.get(f, F.lit(1)).cast("int").alias("length"),
        F.get(f, F.lit(2)).alias("abundance"), values.alias("values"))


def read_signal_vectors(spark: SparkSession, path, tokens: Sequence[str] = MISSING_TOKENS) -> DataFrame:
    return parse_signal_lines(spark.read.text(path), tokens=tokens)


def abundance_value(col: Column) -> Column:
    """Abundance as a number; ``*`` means not available."""
    return null_tokens(col, (*MISSING_TOKENS, "*")).try_cast("double")


def read_archive_member(spark: SparkSession, path: str, member: str, tokens: Sequence[str] = MISSING_TOKENS) -> DataFrame:
    """Signal vectors in a gzip member of a TAR, unpacked line by line in the task that holds the archive."""
    def expand(batches: Iterator[pd.DataFrame]):
        for pdf in batches:
            for content in pdf["content"]:
                with tarfile.open(fileobj=io.BytesIO(content)) as archive:
                    raw = archive.extractfile(member)
                    with gzip.GzipFile(fileobj=raw) as nested, io.TextIOWrapper(nested, encoding="utf-8") as text:
                        chunk = []
                        for line in text:
                            chunk.append(line)
                            if len(chunk) == 256:
                                yield pd.DataFrame({"value": chunk})
                                chunk = []
                        if chunk:
                            yield pd.DataFrame({"value": chunk})

    files = spark.read.format("binaryFile").load(path).select("content")
    return parse_signal_lines(files.mapInPandas(expand, "value string"), tokens=tokens)


def select_vectors(vectors: DataFrame, ids: DataFrame, on: str = "tid") -> DataFrame:
    """Only the wanted ids; a vector whose length differs from its declaration raises."""
    kept = vectors.join(ids.select(on).distinct(), on, "left_semi")
    same = F.size("values") == F.col("length")
    return kept.withColumn("values", F.when(same, F.col("values")).otherwise(
        F.raise_error(F.concat(F.lit("length mismatch for "), F.col(on).cast("string")))))


def read_selected_vectors(spark: SparkSession, path, ids: DataFrame, on: str = "tid") -> DataFrame:
    """The id is compared before a line is split into values."""
    lines = spark.read.text(path).withColumn(on, F.substring_index("value", "\t", 1))
    wanted = lines.join(ids.select(on).distinct(), on, "left_semi")
    return select_vectors(parse_signal_lines(wanted), ids, on)


def attribute(col: Column, key: str) -> Column:
    """Value of ``key "value";`` in an attribute list; NULL when absent."""
    pattern = rf'(?:^|\s){key} "([^"]*)";'
    return F.when(col.rlike(pattern), F.regexp_extract(col, pattern, 1))


def read_annotation(spark: SparkSession, path, features: Sequence[str] = ("exon",), versioned: bool = False) -> DataFrame:
    """Nine-column annotation: 1-based closed features with their ids."""
    names = ["chrom", "source", "feature", "start", "end", "score", "strand", "frame", "attributes"]
    schema = T.StructType([T.StructField(n, T.StringType()) for n in names])
    raw = spark.read.csv(path, sep="\t", comment="#", schema=schema, quote="")
    a = F.col("attributes")
    tid = attribute(a, "transcript_id")
    if versioned:
        tid = with_version(tid, attribute(a, "transcript_version"))
    return raw.where(F.col("feature").isin(*features) & a.isNotNull()).select(
        norm_chr(F.col("chrom")).alias("chrom"), F.col("feature"), F.col("start").cast("long").alias("start"),
        F.col("end").cast("long").alias("end"), "strand", tid.alias("tid"),
        F.coalesce(attribute(a, "gene_id"), F.lit("")).alias("gene_id"),
        F.coalesce(attribute(a, "gene_name"), F.lit("")).alias("gene_name"),
        F.coalesce(attribute(a, "exon_number").try_cast("int"), F.lit(0)).alias("exon_number"),
    ).where(F.col("tid").isNotNull() & (F.col("tid") != ""))


def read_fasta(spark: SparkSession, path) -> DataFrame:
    """``name, seq``: first token of the header, letters joined and upper-cased."""
    # A record starts with ">" at the start of a line; elsewhere it belongs to a description.
    # Only the first record of a file still has its own ">".
    rec = spark.read.text(path, lineSep="\n>").where(F.length(F.trim("value")) > 0) \
        .select(F.regexp_replace("value", "^\\s*>", "").alias("value"))
    head = F.substring_index("value", "\n", 1)
    body = F.substring(F.col("value"), F.length(head) + 2, F.length("value"))
    return rec.select(F.split(F.trim(head), r"\s+", 2)[0].alias("name"),
                      F.upper(F.regexp_replace(body, r"\s", "")).alias("seq"))


def read_chain_blocks(spark: SparkSession, path) -> DataFrame:
    """Chain records to absolute 0-based half-open blocks; reverse targets are flipped."""
    rec = spark.read.text(path, lineSep="chain ").where(F.length(F.trim("value")) > 0)
    body = F.regexp_replace("value", "\r", "")
    lines = F.filter(F.split(F.split(body, "\n\n", 2)[0], "\n"), lambda x: F.trim(x) != "")
    h = F.split(F.trim(F.get(lines, F.lit(0))), r"\s+")
    sizes = F.transform(F.slice(lines, F.lit(2), F.greatest(F.size(lines) - 1, F.lit(0))),
                        lambda x: F.transform(F.split(F.trim(x), r"\s+"), lambda v: v.cast("long")))
    parsed = rec.select(h.alias("h"), F.posexplode(sizes).alias("i", "s")).where(F.size("h") >= 12)
    # One record is one input row, so the running offsets of a record fit where the record did.
    before = Window.partitionBy("h").orderBy("i").rowsBetween(Window.unboundedPreceding, -1)
    zero = F.lit(0).cast("long")
    n = F.get("s", F.lit(0))
    gap_a, gap_b = (F.coalesce(F.get("s", F.lit(i)), zero) for i in (1, 2))
    blocks = parsed.select("h", F.struct(
        F.coalesce(F.sum(n + gap_a).over(before), zero).alias("a"),
        F.coalesce(F.sum(n + gap_b).over(before), zero).alias("b"), n.alias("n")).alias("k"))

    def field(i, kind="long"):
        return F.get(F.col("h"), F.lit(i)).cast(kind)

    source = field(4) + F.col("k.a")
    at, size = field(9) + F.col("k.b"), field(7)
    target = F.when(field(8, "string") == "+", at).otherwise(size - (at + F.col("k.n")))
    return blocks.select(
        norm_chr(field(1, "string")).alias("source_chrom"), source.alias("source_start"),
        (source + F.col("k.n")).alias("source_end"), norm_chr(field(6, "string")).alias("target_chrom"),
        target.alias("target_start"), (target + F.col("k.n")).alias("target_end"), size.alias("target_size"),
        field(8, "string").alias("target_strand"), field(0).alias("score"), field(11).alias("chain_id"))


def read_bed(spark: SparkSession, path) -> DataFrame:
    """Single-base stranded intervals with two percentages; every contract is checked."""
    schema = "chrom string, start0 long, end1 long, record string, pct_a double, strand string, pct_b double"
    df = spark.read.csv(path, sep="\t", schema=schema)
    df = require_constraints(df, {
        "single_base": F.col("end1") - F.col("start0") == 1,
        "strand": F.col("strand").isin("+", "-"),
        "pct_a_range": F.col("pct_a").between(0, 100),
        "pct_b_range": F.col("pct_b").between(0, 100),
    })
    from sitewise.operators.joins import require_unique

    require_unique(df, ["chrom", "start0", "end1", "strand"], "bed")
    return df.withColumn("fraction", F.col("pct_b") / 100)


def read_peaks(spark: SparkSession, path) -> DataFrame:
    """Interval table with a header; 0-based half-open, never empty."""
    raw = spark.read.csv(path, sep="\t", header=True)
    # Header names of the interval table.
    schema_contract(raw, ["chr", "chromStart", "chromEnd", "name", "strand", "lg.fdr", "fold_enrchment"])
    df = raw.select(
        norm_chr(F.col("chr")).alias("chrom"), F.col("chromStart").cast("long").alias("start0"),
        F.col("chromEnd").cast("long").alias("end0"), "name", "strand",
        F.col("`lg.fdr`").cast("double").alias("lg_fdr"), F.col("fold_enrchment").cast("double").alias("fold_enrichment"))
    df = require_constraints(df, {"positive_width": F.col("end0") > F.col("start0")})
    return df.withColumns({
        "interval_width": F.col("end0") - F.col("start0"),
        "peak_id": F.concat(F.col("chrom"), F.lit(":"), F.col("start0"), F.lit("-"), F.col("end0"), F.lit(":"), F.col("strand")),
    })


def read_point_track(spark: SparkSession, path) -> DataFrame:
    """Six-column points whose start equals their end; positions are 1-based."""
    df = spark.read.csv(path, sep="\t", schema="chrom string, start long, end long, name string, score string, strand string")
    df = require_constraints(df, {"point": F.col("start") == F.col("end"), "strand": F.col("strand").isin("+", "-")})
    return df.select(norm_chr(F.col("chrom")).alias("chrom"), F.col("start").alias("pos"), "strand", "name", "score")


def parse_locus_strings(df: DataFrame, col: str = "Loci", base: str = "C") -> DataFrame:
    """``chr:pos:base:strand`` text to columns; unparseable text raises."""
    pattern = rf"^(chr[^:]+):(\d+):{base}:([+-])$"
    c = F.col(col)
    checked = F.when(c.rlike(pattern), c).otherwise(
        F.raise_error(F.concat(F.lit("unparseable locus: "), F.coalesce(c, F.lit("NULL")))))
    return df.withColumns({
        "chrom": F.regexp_extract(checked, pattern, 1), "pos": F.regexp_extract(checked, pattern, 2).cast("long"),
        "strand": F.regexp_extract(checked, pattern, 3)})


def locus_mirror_mismatches(df: DataFrame, chrom: str, start: str, end: str, strand: str) -> DataFrame:
    """Rows whose parsed locus disagrees with the 0-based mirror columns."""
    same = (norm_chr(F.col(chrom)) == norm_chr(F.col("chrom"))) & (F.col(start) + 1 == F.col("pos")) \
        & (F.col(end) == F.col("pos")) & (F.col(strand) == F.col("strand"))
    return df.agg(F.count_if(F.col(chrom).isNotNull() & ~F.coalesce(same, F.lit(False))).alias("mismatches"))



def read_result_table(spark: SparkSession, path, schema: str, columns: Sequence[str] | None = None) -> DataFrame:
    """CSV (plain or gzip) with a header, explicit types, only the columns asked for."""
    df = spark.read.csv(path, header=True, schema=schema, enforceSchema=False)
    return df.select(*columns) if columns else df


def with_array_column(df: DataFrame, col: str, n: int) -> DataFrame:
    """Replace a JSON text column by its array, asserting its length."""
    return df.withColumn(col, parse_array_json(F.col(col), n))
