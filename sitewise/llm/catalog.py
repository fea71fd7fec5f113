"""Checked queries of the operators: each over its whole table, with SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sitewise.llm import (fill_middle, importance, language_id, licences, mixing, near_dup, packing, quality_rules, shard_table, sql, syncmers, token_groups,
                          token_scan, warc, word_ids)
from sitewise.llm.common import scratch_folder

END_OF_DOCUMENT = 50_256
SHARDS = [f"shard-{i:03d}" for i in range(256)]


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def op1_shard_table(spark: SparkSession, folder: str) -> DataFrame:
    """Every document's slot and shard among 256."""
    docs = _table(spark, folder, "documents").select("doc_id")
    return shard_table.place(docs, "doc_id", SHARDS, shard_table.fill_table(SHARDS))


def op2_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    """Counts of every whole text and the verdict of the cutoffs fitted on ``labels``."""
    docs = _table(spark, folder, "documents").select("doc_id", "lang", "text")
    measured = quality_rules.checkpointed_metrics(docs)
    cutoffs = quality_rules.fit_cutoffs(measured, _table(spark, folder, "labels"))
    return quality_rules.verdict(measured, cutoffs).select("doc_id", *quality_rules.BASE, "n_upper", "n_lines", "base_failed", "kept")


def byte_pair_encoder():
    """The public byte-level vocabulary; opened inside tasks."""
    import public_tokenizers

    return token_scan.byte_pair_encoder(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op3_separator_scan(spark: SparkSession, folder: str) -> DataFrame:
    """Token counts of every document, found in flat token files of all documents."""
    files = scratch_folder(spark, "tokens")
    written = token_scan.write_tokens(_table(spark, folder, "documents"), files, byte_pair_encoder, END_OF_DOCUMENT)
    counted = token_scan.scan(written.select("file", "bytes").distinct(), files, END_OF_DOCUMENT)
    return written.join(counted, ["file", "ordinal"]).select("doc_id", "n_tokens")


def op4_language_centroids(spark: SparkSession, folder: str) -> DataFrame:
    """The language of every whole text, learned from the documents that are not held out."""
    docs = _table(spark, folder, "documents").select("doc_id", "lang", "text")
    said = language_id.classify(docs.select("doc_id", "text"), "text", language_id.fit(docs))
    return said.select("doc_id", language_id.held_out(F.col("doc_id")).alias("held_out"), "_language.*")


def word_encoder():
    """The public word-piece vocabulary; opened inside tasks."""
    import public_tokenizers

    return word_ids.word_ids(public_tokenizers.path("word_bpe_49k.json")).many


def op5_best_fit(spark: SparkSession, folder: str) -> DataFrame:
    """All documents packed into sequences of 4096 tokens."""
    return packing.pack(packing.pieces(_table(spark, folder, "documents"), word_encoder))


def op6_poisson_mix(spark: SparkSession, folder: str) -> DataFrame:
    """Documents repeated towards square-root source weights and globally shuffled, whole rows."""
    docs = _table(spark, folder, "documents").select("doc_id", "text", "lang", "source", "n_chars")
    mass = mixing.source_mass(docs)
    mixed = mixing.mix(docs, mixing.repetition_rates(mass, mixing.tempered_targets(mass)))
    return mixed.select(*docs.columns, F.col("_copy").alias("copy"), F.col("_order").alias("shuffle_key"))


def op7_licence_dice(spark: SparkSession, folder: str) -> DataFrame:
    """Licence notices in every whole text."""
    return licences.scan(_table(spark, folder, "documents"))


def op8_closed_syncmers(spark: SparkSession, folder: str) -> DataFrame:
    """Fingerprints of every whole text and of its edit with the next document's text."""
    return syncmers.fingerprints_with_neighbours(_table(spark, folder, "documents").select("doc_id", "text"))


def op9_lsh_forest(spark: SparkSession, folder: str) -> DataFrame:
    """Near-duplicate groups on two-word shingles at a similarity of 0.8."""
    return near_dup.near_duplicates(_table(spark, folder, "documents").select("doc_id", "text"), near_dup.NearDupParams(words=2))


def op10_warc_round_trip(spark: SparkSession, folder: str) -> DataFrame:
    """Every page written to archives and read back."""
    archives = scratch_folder(spark, "warc")
    written = warc.write_archives(_table(spark, folder, "pages"), archives)
    return warc.read_archives(written, archives).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op11_fenwick_fim(spark: SparkSession, folder: str) -> DataFrame:
    """Every whole text cut at lines into a fill-in-the-middle form, and rebuilt from it."""
    made = fill_middle.transform(_table(spark, folder, "documents"))
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"),
                       F.sha2(fill_middle.restored(F.col("output"), F.col("form")), 256).alias("restored_sha256"))


def op12_crc_resampling(spark: SparkSession, folder: str) -> DataFrame:
    """Documents weighed towards the benchmark texts, and the draw of the highest scores."""
    drawn = importance.resample(_table(spark, folder, "documents"), _table(spark, folder, "benchmark"))
    return drawn.select("doc_id", "n_features", "weight", "score", "rank")


def op13_token_group_join(spark: SparkSession, folder: str) -> DataFrame:
    """Components of documents whose four-word shingles reach a similarity of 0.85."""
    return token_groups.join(_table(spark, folder, "documents"))


_QUERIES = {f.__name__: f for f in (
    op1_shard_table, op2_quality_rules, op3_separator_scan, op4_language_centroids, op5_best_fit, op6_poisson_mix, op7_licence_dice,
    op8_closed_syncmers, op9_lsh_forest, op10_warc_round_trip, op11_fenwick_fim, op12_crc_resampling, op13_token_group_join)}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return {name: getattr(sql, name) for name in _QUERIES if hasattr(sql, name)}
