"""The corpus pipeline: stages that each take and return documents, written as Parquet between stages.

Order: quality rules, language identification, near-duplicate removal, mixing to target
weights, packing. All but the last return the columns of the documents they were given,
extra ones included: rows travel as one struct beside the columns a stage works on, so
no name of theirs can clash with a stage's own. An empty table passes through every
stage. What a stage does with nulls, empty texts and repeated rows is said in the module
of its operator.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sitewise.llm import language_id, mixing, near_dup, packing, quality_rules
from sitewise.llm.catalog import word_encoder
from sitewise.llm.common import scratch_folder


def _rows(docs: DataFrame, *used: str) -> DataFrame:
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), *used)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep, with cutoffs fitted on the labels.

    Counts are taken twice, once beside the labels and once beside the whole row: cheaper than
    shuffling texts to join a verdict, and rows that share a doc_id are each judged alone.
    """
    cutoffs = quality_rules.fit_cutoffs(quality_rules.checkpointed_metrics(docs), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    measured = quality_rules.with_metrics(_rows(docs, "lang", "text"), "text").drop("text")
    # Not a filter: it would be pushed below the counts and take them once more for each use.
    return quality_rules.verdict(measured, cutoffs).select(F.inline(F.when(F.col("kept"), F.array("_row"))))


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is not rejected, by a model of the documents that are not held out."""
    model = language_id.fit(docs.select("doc_id", "lang", "text"))
    return language_id.classify(_rows(docs, "text"), "text", model).where("not _language.rejected").select("_row.*")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates (five-word shingles, similarity 0.8) the document with the smallest id.

    Repeated rows of one id leave one row; rows without an id all stay.
    """
    kept = near_dup.near_duplicates(docs.select("doc_id", "text")).where("kept and doc_id is not null").select("doc_id").distinct()
    rows = _rows(docs, "doc_id")
    one = rows.join(kept, "doc_id").dropDuplicates(["doc_id"])
    return one.select("_row.*").unionAll(rows.where("doc_id is null").select("_row.*"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated towards square-root source weights and globally shuffled."""
    mass = mixing.source_mass(docs)
    rates = mixing.repetition_rates(mass, mixing.tempered_targets(mass))
    return mixing.mix(_rows(docs, "doc_id", "source"), rates).select("_row.*")


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every piece of every document with its place in a sequence of 4096 tokens."""
    return packing.pack(packing.pieces(docs.select("doc_id", "text"), word_encoder))


STAGES = [("quality", quality), ("language", language), ("near_duplicates", near_duplicates), ("mix", mix), ("pack", pack)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each stage's rows are written to the shared folder and read back."""
    folder = scratch_folder(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return docs
