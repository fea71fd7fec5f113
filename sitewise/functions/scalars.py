"""Scalar column functions for site tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitewise.functions.binding import let

# The texts that mean "not measured" in input files.
MISSING_TOKENS = ("", "NULL", "NA", "N/A", "NaN", "nan", ".", "-999")
# The list used where the empty text is a value of its own.
MISSING_TOKENS_KEEP_EMPTY = MISSING_TOKENS[1:]
# Fixed value: the label of a row with no annotated gene.
UNANNOTATED = "ELSE"


def norm_chr(col: Column) -> Column:
    """Chromosome names with the ``chr`` prefix; the mitochondrion is ``chrM``."""
    s = F.trim(col)
    return F.when(s.startswith("chr"), s).when(s == "MT", F.lit("chrM")).otherwise(F.concat(F.lit("chr"), s))


def null_tokens(col: Column, tokens: Sequence[str] = MISSING_TOKENS) -> Column:
    return F.when(~col.isin(*tokens), col)


def lenient_double(col: Column) -> Column:
    """Numeric value, NULL where the text is not a finite number."""
    x = col.try_cast("double")
    return F.when(~F.isnan(x), x)


def is_true_text(col: Column) -> Column:
    return F.coalesce(col.cast("string") == "True", F.lit(False))


def site_id(*cols) -> Column:
    return F.concat_ws(":", *[F.col(c) if isinstance(c, str) else c for c in cols])


def with_version(identifier: Column, version: Column) -> Column:
    present = version.isNotNull() & (version != "")
    return F.when(present, F.concat(identifier, F.lit("."), version)).otherwise(identifier)


def strip_version(identifier: Column) -> Column:
    return F.substring_index(identifier, ".", 1)


def tx_to_genome(start: Column, end: Column, strand: Column, tx_start: Column, tx_pos: Column) -> Column:
    """Genome position of a transcript position that falls in this exon."""
    offset = tx_pos - tx_start
    return F.when(strand == "+", start + offset).otherwise(end - offset)


def genome_to_tx(start: Column, end: Column, strand: Column, tx_start: Column, pos: Column) -> Column:
    """Transcript position of a genome position that falls in this exon."""
    return tx_start + F.when(strand == "+", pos - start).otherwise(end - pos)


def region_class(pos: Column, cds_start: Column, cds_end: Column) -> Column:
    return (
        F.when(cds_start.isNull() | cds_end.isNull(), "noncoding_or_CDS_unavailable")
        .when(pos < cds_start, "5UTR")
        .when(pos <= cds_end, "CDS")
        .otherwise("3UTR")
    )


def list_contains(delimited: Column, item: Column, sep: str = ";") -> Column:
    """Is ``item`` a non-empty member of a delimited list?"""
    hit = F.array_contains(F.split(delimited, sep), item)
    return F.coalesce(hit & (item != ""), F.lit(False))


def priority_label(rules: Sequence[tuple[Column, Column, str]]) -> tuple[Column, Column]:
    """First rule whose condition holds, as ``(value, source)``.

    ``rules`` holds (condition, value, source name) in order of priority.
    """
    value = source = None
    for condition, candidate, name in rules:
        if value is None:
            value, source = F.when(condition, candidate), F.when(condition, F.lit(name))
        else:
            value, source = value.when(condition, candidate), source.when(condition, F.lit(name))
    return value, source


def analysis_gene(submitted: Column, transcript_gene: Column, gene_id: Column) -> tuple[Column, Column]:
    """Gene for clustering: submitted label first, then the annotation."""
    names = F.filter(F.split(F.coalesce(submitted, F.lit("")), ";"),
                     lambda g: (g != "") & (g != UNANNOTATED))
    named = F.coalesce(transcript_gene, F.lit("")) != ""
    return priority_label([
        (named & F.array_contains(names, transcript_gene), transcript_gene, "submitted_gene_matching_transcript"),
        (F.size(names) > 0, F.get(names, F.lit(0)), "submitted_gene"),
        (named, transcript_gene, "annotation_gene_name"),
        (F.lit(True), gene_id, "annotation_gene_id"),
    ])


def pooled_ratio(numerators: Sequence[Column], denominators: Sequence[Column], digits: int = 8) -> Column:
    """Sum of numerators over sum of denominators across the replicates present."""
    zero = F.lit(0)
    num = sum((F.coalesce(c, zero) for c in numerators[1:]), F.coalesce(numerators[0], zero))
    den = sum((F.coalesce(c, zero) for c in denominators[1:]), F.coalesce(denominators[0], zero))
    return F.round(F.try_divide(num, den), digits)


def clip(col: Column, low: float = 0.0, high: float = 1.0) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), col))


def nearest_edge_distance(pos: Column, edges: Column) -> Column:
    """Smallest distance to any edge; NULL when there is none."""
    return let(pos, lambda p: F.array_min(F.transform(edges, lambda e: F.abs(p - e))))


def near_edge(pos: Column, edges: Column, distance: int = 2) -> Column:
    return let(pos, lambda p: F.coalesce(F.exists(edges, lambda e: F.abs(p - e) <= distance), F.lit(False)))


def ratio_mismatch(observed: Column, numerator: Column, denominator: Column,
                   digits: int = 5, tolerance: float = 5e-6) -> Column:
    """True where a stored ratio differs from its recomputation (or cannot be recomputed)."""
    return F.coalesce(F.abs(observed - F.round(F.try_divide(numerator, denominator), digits)) > tolerance, F.lit(True))


def product_mismatch(observed: Column, left: Column, right: Column, tolerance: float = 1e-10) -> Column:
    return F.coalesce(F.abs(observed - left * right) > tolerance, F.lit(True))


def reason_cascade(rules: Sequence[tuple[Column, str]], default: str = "") -> Column:
    """Name of the first failing rule."""
    expr = None
    for condition, name in rules:
        hit = F.coalesce(condition, F.lit(False))
        expr = F.when(hit, name) if expr is None else expr.when(hit, name)
    return expr.otherwise(default)


def expected_base(strand: Column) -> Column:
    # The centre base on each strand.
    return F.when(strand == "+", "A").otherwise("T")


def expected_base_ok(strand: Column, observed: Column) -> Column:
    return F.coalesce(observed == expected_base(strand), F.lit(False))


def backfill(df: DataFrame, derivations: dict[str, Column]) -> DataFrame:
    """Add each derived column only where the table does not have it yet."""
    for name, expr in derivations.items():
        if name not in df.columns:
            df = df.withColumn(name, expr)
    return df


def site_derivations() -> dict[str, Column]:
    """The derived columns of a two-replicate site table, in dependency order."""
    gene = F.when(F.col("genes") != UNANNOTATED, F.col("genes"))
    return {
        "combined_agcov": F.col("agcov_rep1") + F.col("agcov_rep2"),
        "combined_acov": F.col("acov_rep1") + F.col("acov_rep2"),
        "combined_ratio": F.try_divide(F.col("combined_acov"), F.col("combined_agcov")),
        "site_id": site_id("chrom", F.col("pos"), "strand"),
        "analysis_gene": F.coalesce(gene, F.col("transcript_gene_name"), F.col("transcript_gene_id")),
    }


def delta(treatment: Column, control: Column) -> Column:
    return treatment - control


def is_http_url(col: Column) -> Column:
    scheme = F.lower(F.try_parse_url(col, F.lit("PROTOCOL")))
    host = F.try_parse_url(col, F.lit("HOST"))
    return F.coalesce(scheme.isin("http", "https") & (host != ""), F.lit(False))


def bin_right_closed(x: Column, edges: Column) -> Column:
    """1-based bin of ``x`` over sorted edges; bins are (low, high], the first takes its low edge."""
    last = F.size(edges) - 1
    inner = F.slice(edges, F.lit(2), F.greatest(last - 1, F.lit(0)))
    outside = (x < F.get(edges, F.lit(0))) | (x > F.get(edges, last))
    return F.when(~outside, let(x, lambda v: F.size(F.filter(inner, lambda e: e < v))) + 1)


def bin_left_closed(x: Column, inner_edges: Column) -> Column:
    """1-based bin of ``x``; bins are [low, high) and the outer ones are unbounded."""
    return F.when(x.isNotNull(), let(x, lambda v: F.size(F.filter(inner_edges, lambda e: e <= v))) + 1)


def position_fraction(pos: Column, length: Column) -> Column:
    return F.round(F.try_divide(pos, length), 8)


def anchor_distance(pos: Column, anchor: Column) -> Column:
    return pos - anchor
