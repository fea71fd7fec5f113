"""Key joins with contracts, presence flags and counted reasons."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitewise.functions.scalars import UNANNOTATED, reason_cascade, strip_version


class ContractError(ValueError):
    """A table breaks the cardinality or completeness a join relies on."""


def duplicate_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys that occur more than once, with their counts."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("count")).where("count > 1")


def require_unique(df: DataFrame, keys: Sequence[str], what: str = "table") -> DataFrame:
    bad = duplicate_keys(df, keys).limit(1).collect()
    if bad:
        raise ContractError(f"duplicate key in {what}: {bad[0].asDict()}")
    return df


def checked_join(left: DataFrame, right: DataFrame, on: Sequence[str], how: str = "inner",
                 validate: str = "one_to_one") -> DataFrame:
    """Join after checking key uniqueness on the sides the contract names."""
    if validate in ("one_to_one", "one_to_many"):
        require_unique(left, on, "left side")
    if validate in ("one_to_one", "many_to_one"):
        require_unique(right, on, "right side")
    return left.join(right, list(on), how)


def replicate_outer_join(rep1: DataFrame, rep2: DataFrame, keys: Sequence[str], values: Sequence[str],
                         label: str | None = None, check: bool = True) -> DataFrame:
    """Union of two replicates' keys: presence flags, suffixed values, merged labels.

    Labels are distinct, sorted, joined by ``;`` and leave out the unannotated mark.
    """
    if check:
        require_unique(rep1, keys, "replicate 1")
        require_unique(rep2, keys, "replicate 2")
    carried = [*values, *([label] if label else [])]

    def tagged(df: DataFrame, i: int) -> DataFrame:
        return df.select(*keys, F.lit(True).alias(f"_in{i}"), *[F.col(c).alias(f"{c}_rep{i}") for c in carried])

    joined = tagged(rep1, 1).join(tagged(rep2, 2), list(keys), "full_outer")
    out = joined.withColumns({f"detected_rep{i}": F.coalesce(F.col(f"_in{i}"), F.lit(False)) for i in (1, 2)})
    out = out.withColumn("detected_both_replicates", F.col("detected_rep1") & F.col("detected_rep2"))
    if label:
        found = F.array_compact(F.array(f"{label}_rep1", f"{label}_rep2"))
        kept = F.array_sort(F.array_distinct(F.filter(found, lambda g: g != UNANNOTATED)))
        out = out.withColumn("genes", F.array_join(kept, ";")).drop(f"{label}_rep1", f"{label}_rep2")
    return out.drop("_in1", "_in2")


def semi_join(df: DataFrame, wanted: DataFrame, on: Sequence[str]) -> DataFrame:
    """Rows whose key is wanted."""
    return df.join(wanted.select(*on), list(on), "left_semi")


def overlap_flags(df: DataFrame, references: dict[str, DataFrame], columns: Sequence[str]) -> DataFrame:
    """``<reference>_<column>_overlap`` flags: does the value occur in the reference set?

    Each reference is reduced to its distinct values before the join.
    """
    for name, ref in references.items():
        for c in columns:
            flag = f"{name}_{c}_overlap"
            keys = ref.where(F.col(c).isNotNull()).select(c).distinct().withColumn("_hit", F.lit(True))
            df = df.join(keys, c, "left").withColumn(flag, F.coalesce("_hit", F.lit(False))).drop("_hit")
    return df


def exclude_overlap(df: DataFrame, development: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Drop a row if any of ``columns`` has a value seen in the development set."""
    for c in columns:
        seen = development.where(F.col(c).isNotNull()).select(c).distinct()
        df = df.join(seen, c, "left_anti")
    return df


def nesting_violations(df: DataFrame, inner: str, outer: str) -> DataFrame:
    """How many rows are in the inner cohort but not in the outer one (must be 0)."""
    return df.agg(F.count_if(F.col(inner) & ~F.col(outer)).alias("violations"))


def outer_with_indicator(left: DataFrame, right: DataFrame, on: Sequence[str],
                         compare: Sequence[str] = ()) -> DataFrame:
    """Full outer join with ``_merge`` and one ``<column>_equal`` flag per compared column."""
    a = left.select(*on, F.lit(1).alias("_l"), *[F.col(c).alias(f"{c}_left") for c in compare])
    b = right.select(*on, F.lit(1).alias("_r"), *[F.col(c).alias(f"{c}_right") for c in compare])
    out = a.join(b, list(on), "full_outer").withColumn(
        "_merge",
        F.when(F.col("_l").isNull(), "right_only").when(F.col("_r").isNull(), "left_only").otherwise("both"),
    )
    return out.withColumns(
        {f"{c}_equal": F.col(f"{c}_left").eqNullSafe(F.col(f"{c}_right")) for c in compare}
    ).drop("_l", "_r")


def length_agreement(vectors: DataFrame, annotation: DataFrame, sequences: DataFrame, on: str = "tid") -> DataFrame:
    """Per vector id: does its length agree with the annotation and the sequence?

    ``vectors`` has ``length``, ``annotation`` has exon rows with ``start``/``end``,
    ``sequences`` has ``seq``. Adds ``reason`` (empty when eligible).
    """
    exon = annotation.groupBy(on).agg(F.sum(F.col("end") - F.col("start") + 1).alias("exon_length"))
    seqs = sequences.select(on, F.length("seq").alias("sequence_length"))
    joined = vectors.join(exon, on, "left").join(seqs, on, "left")
    return joined.withColumn("reason", reason_cascade([
        (F.col("exon_length").isNull(), "no_annotation"),
        (F.col("sequence_length").isNull(), "no_sequence"),
        (F.col("sequence_length") != F.col("length"), "sequence_length_mismatch"),
        (F.col("exon_length") != F.col("length"), "annotation_length_mismatch"),
    ]))


def reference_compatibility(targets: DataFrame, features: DataFrame, on: str = "tid") -> DataFrame:
    """Counts of found / exact / mismatched / missing targets against one annotation.

    ``targets`` has ``length``; ``features`` has exon rows. The ``base_`` counts
    ignore the version suffix of the id.
    """
    width = F.sum(F.col("end") - F.col("start") + 1)
    full = features.groupBy(on).agg(width.alias("_len"))
    base = features.groupBy(strip_version(F.col(on)).alias("_base")).agg(width.alias("_base_len"))
    joined = (
        targets.withColumn("_base", strip_version(F.col(on)))
        .join(full, on, "left").join(base, "_base", "left")
    )
    hit, exact = F.col("_len").isNotNull(), F.col("_len") == F.col("length")
    return joined.agg(
        F.count(F.lit(1)).alias("targets"),
        F.count_if(hit).alias("found"),
        F.count_if(exact).alias("length_exact"),
        F.count_if(hit & ~exact).alias("length_mismatch"),
        F.count_if(~hit).alias("missing"),
        F.count_if(F.col("_base_len").isNotNull()).alias("base_found"),
        F.count_if(F.col("_base_len") == F.col("length")).alias("base_length_exact"),
    )


def alias_join(df: DataFrame, reference: DataFrame, on: str, values: Sequence[str]) -> DataFrame:
    """Left join by the exact id, else by the id without its version.

    Where several versions share the bare id, the smallest full id answers for it.
    """
    exact = reference.select(on, F.struct(*values).alias("_exact"))
    bare = (
        reference.select(strip_version(F.col(on)).alias("_bare"), F.struct(on, *values).alias("_v"))
        .groupBy("_bare").agg(F.min_by("_v", F.col(f"_v.{on}")).alias("_fallback"))
    )
    joined = (
        df.withColumn("_bare", strip_version(F.col(on)))
        .join(exact, on, "left").join(bare, "_bare", "left")
    )
    picked = {v: F.coalesce(F.col(f"_exact.{v}"), F.col(f"_fallback.{v}")) for v in values}
    source = F.when(F.col("_exact").isNotNull(), "exact").when(F.col("_fallback").isNotNull(), "unversioned")
    return joined.withColumns({**picked, "id_match": source.otherwise("missing")}).drop("_bare", "_exact", "_fallback")


def paired_conditions(a: DataFrame, b: DataFrame, on: Sequence[str], valid: str, values: Sequence[str],
                      names: tuple[str, str] = ("a", "b")) -> DataFrame:
    """Same key in two conditions, both valid: suffixed values, differences, averages."""
    left = a.select(*on, F.col(valid).alias("_va"), *[F.col(v).alias(f"{v}_{names[0]}") for v in values])
    right = b.select(*on, F.col(valid).alias("_vb"), *[F.col(v).alias(f"{v}_{names[1]}") for v in values])
    both = left.join(right, list(on)).where(F.col("_va") & F.col("_vb")).drop("_va", "_vb")
    return both.withColumns(
        {f"{v}_delta": F.col(f"{v}_{names[0]}") - F.col(f"{v}_{names[1]}") for v in values}
        | {f"{v}_mean": (F.col(f"{v}_{names[0]}") + F.col(f"{v}_{names[1]}")) / 2 for v in values}
    )


def paired_condition_failures(wanted: DataFrame, a: DataFrame, b: DataFrame, on: Sequence[str],
                              valid: str) -> DataFrame:
    """Non-exclusive failure counts of a paired-condition join over the wanted keys."""
    j = (
        wanted.select(*on)
        .join(a.select(*on, F.col(valid).alias("_va")), list(on), "left")
        .join(b.select(*on, F.col(valid).alias("_vb")), list(on), "left")
    )
    present = F.col("_va").isNotNull() & F.col("_vb").isNotNull()
    return j.agg(
        F.count(F.lit(1)).alias("wanted"),
        F.count_if(~present).alias("missing_either"),
        F.count_if(present & ~F.col("_va")).alias("invalid_a"),
        F.count_if(present & ~F.col("_vb")).alias("invalid_b"),
        F.count_if(present & F.col("_va") & F.col("_vb")).alias("paired"),
    )


def paired_arm_attrition(control: DataFrame, treatment: DataFrame, on: str, finite: Column | None = None) -> DataFrame:
    """Row counts of a paired-arm join: both, one side only, finite pairs."""
    c = control.select(on, F.lit(1).alias("_c"), *[x for x in control.columns if x != on])
    t = treatment.select(on, F.lit(1).alias("_t"), *[x for x in treatment.columns if x != on])
    j = c.join(t, on, "full_outer")
    both = F.col("_c").isNotNull() & F.col("_t").isNotNull()
    return j.agg(
        F.count("_c").alias("control_rows"),
        F.count("_t").alias("treatment_rows"),
        F.count_if(both).alias("paired_rows"),
        F.count_if(F.col("_t").isNull()).alias("control_only"),
        F.count_if(F.col("_c").isNull()).alias("treatment_only"),
        F.count_if(both & (finite if finite is not None else F.lit(True))).alias("finite_pairs"),
    )


def manifest_diff(expected: DataFrame, observed: DataFrame, key: str = "path", digest: str = "sha256",
                  size: str = "bytes") -> DataFrame:
    """Entries that are missing, unexpected, or changed in content or size."""
    e = expected.select(key, F.col(digest).alias("_ed"), F.col(size).alias("_es"), F.lit(1).alias("_e"))
    o = observed.select(key, F.col(digest).alias("_od"), F.col(size).alias("_os"), F.lit(1).alias("_o"))
    j = e.join(o, key, "full_outer").withColumn("problem", reason_cascade([
        (F.col("_o").isNull(), "missing"),
        (F.col("_e").isNull(), "unexpected"),
        (~F.col("_ed").eqNullSafe(F.col("_od")), "hash_changed"),
        (~F.col("_es").eqNullSafe(F.col("_os")), "size_changed"),
    ]))
    return j.where("problem <> ''").select(key, "problem")
