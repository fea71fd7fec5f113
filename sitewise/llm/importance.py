"""Importance resampling of documents towards a target text, with hashed word n-grams.

Features are all runs of one to three consecutive words. A feature's bucket is the CRC-32
of its bytes modulo the number of buckets. Buckets of the corpus and of the target are
counted over every text; the log ratio of the two smoothed shares is a bucket's gain, and
a document's weight is the sum of its features' gains. A Gumbel number from a hash of the
id makes the draw of the highest scores a sample without replacement.

CRCs are computed for many features at once. A task numbers the words of a chunk of
texts, writes features as codes of word numbers and keeps the distinct ones. These are
grouped by their length in bytes; each group is a two-dimensional array of bytes whose
columns update all CRCs of the group together, and the buckets are scattered back to the
places where the features stood. Chunks bound memory: a long text passes in slices, of
which each takes over the last words of the one before.

Texts are read twice, to count and to weigh, and are never shuffled. What is shuffled are
bucket counts (at most one row per bucket and task) and one narrow row per document for
the ranking, which range-partitions and so puts no key in one task. The gains, one number
per bucket, are the only thing that reaches the driver; ``buckets`` bounds it.

Words are runs of ASCII letters and digits and of any code point above 127, A-Z
lower-cased. Null and empty texts have no features and weight 0. A null id is hashed as
the empty string and ranks after other ids of its score. Repeated rows are rows of their
own, all of them ranked. An empty target or corpus counts as zero everywhere. Only
``doc_id`` and ``text`` are read, so other columns cannot clash.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sitewise.operators.ordering import positions
from sitewise.session import checkpointed

_WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
_BETWEEN = re.compile(rb"[^0-9A-Za-z\x80-\xff]")
SLICE_BYTES = 4 << 20
CHUNK_WORDS = 1 << 19
WIDE = 1 << 10  # bytes from which a feature is long enough to have its CRC taken by itself


@dataclass(frozen=True)
class ImportanceParams:
    longest_run: int = 3
    buckets: int = 10_000
    least_words: int = 20
    percent: int = 5
    seed: int = 42


def _crc_table() -> np.ndarray:
    crc = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        crc = np.where(crc & 1, (crc >> np.uint32(1)) ^ np.uint32(0xEDB88320), crc >> np.uint32(1)).astype(np.uint32)
    return crc


_TABLE = _crc_table()


def crc32_of_rows(matrix: np.ndarray) -> np.ndarray:
    """CRC-32 of every row of a two-dimensional array of bytes, one column after the other."""
    if matrix.shape[1] >= WIDE:
        return np.fromiter((zlib.crc32(row.tobytes()) for row in matrix), np.uint32, len(matrix))
    crc = np.full(len(matrix), 0xFFFFFFFF, np.uint32)
    for column in np.ascontiguousarray(matrix.T):
        crc = _TABLE[(crc ^ column) & np.uint32(0xFF)] ^ (crc >> np.uint32(8))
    return ~crc


def _slices(text: bytes) -> Iterator[bytes]:
    """``text`` in pieces that end between words."""
    at = 0
    while len(text) - at > SLICE_BYTES:
        gap = _BETWEEN.search(text, at + SLICE_BYTES)
        if not gap:
            break
        yield text[at:gap.end()]
        at = gap.end()
    yield text[at:] if at else text


@dataclass
class _Chunk:
    """Words of some pieces of texts; ``old`` words stand before a slice only to complete its runs."""

    words: list[bytes]
    doc: list[int]
    many: list[int]
    old: list[int]


def _chunks(texts: list[bytes | None], run: int) -> Iterator[_Chunk]:
    chunk = _Chunk([], [], [], [])
    for i, text in enumerate(texts):
        before: list[bytes] = []
        for piece in _slices((text or b"").lower()):
            words = _WORD.findall(piece)
            chunk.words += before
            chunk.words += words
            chunk.doc.append(i)
            chunk.many.append(len(before) + len(words))
            chunk.old.append(len(before))
            before = (before + words)[-(run - 1):] if run > 1 else []
            if len(chunk.words) >= CHUNK_WORDS:
                yield chunk
                chunk = _Chunk([], [], [], [])
    if chunk.doc:
        yield chunk


def _bytes_of(starts: np.ndarray, lengths: np.ndarray, pool: np.ndarray) -> np.ndarray:
    """The bytes of all given stretches of ``pool``, one after the other."""
    ends = lengths.cumsum()
    return pool[np.repeat(starts - (ends - lengths), lengths) + np.arange(ends[-1] if len(ends) else 0)]


def _buckets_of(runs: np.ndarray, offset: np.ndarray, length: np.ndarray, pool: np.ndarray, buckets: int) -> np.ndarray:
    """Buckets of distinct runs of words, given as word numbers (one column per word)."""
    width = runs.shape[1]
    sizes = length[runs].sum(1) + width - 1
    out = np.zeros(len(runs), np.int64)
    order = np.argsort(sizes, kind="stable")
    edges = np.flatnonzero(np.r_[True, np.diff(sizes[order]) > 0, True]) if len(order) else []
    for a, b in zip(edges[:-1], edges[1:]):
        rows = order[a:b]
        # Every word but the last is taken with the blank that follows it in the pool.
        take = length[runs[rows]] + (np.arange(width) < width - 1)
        flat = _bytes_of(offset[runs[rows]].ravel(), take.ravel(), pool)
        out[rows] = crc32_of_rows(flat.reshape(len(rows), -1)) % np.uint32(buckets)
    return out


def bucketed(texts: list[bytes | None], params: ImportanceParams) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Per chunk: the text and bucket of every feature, and texts with their new words."""
    for chunk in _chunks(texts, params.longest_run):
        known: dict[bytes, int] = {}
        ids = np.fromiter((known.setdefault(w, len(known)) for w in chunk.words), np.int64, len(chunk.words))
        many, old, doc = np.array(chunk.many), np.array(chunk.old), np.array(chunk.doc)
        piece = np.repeat(np.arange(len(many)), many)
        within = np.arange(len(ids)) - np.repeat(many.cumsum() - many, many)
        length = np.fromiter(map(len, known), np.int64, len(known))
        offset = (length + 1).cumsum() - length - 1
        pool = np.frombuffer(b" ".join(known) + b" ", np.uint8)
        where, found, code = [], [], ids
        for width in range(1, params.longest_run + 1):
            if width > 1:
                code = code[:-1] * len(known) + ids[width - 1:]
            # A run ends at a new word and starts in the same piece.
            last = np.arange(width - 1, len(ids))
            last = last[(within[last] >= width - 1) & (within[last] >= old[piece[last]])]
            if not len(last):
                continue
            distinct, back = np.unique(code[last - width + 1], return_inverse=True)
            runs = np.empty((len(distinct), width), np.int64)
            rest = distinct
            for at in range(width - 1, -1, -1):
                rest, runs[:, at] = np.divmod(rest, len(known))
            where.append(doc[piece[last]])
            found.append(_buckets_of(runs, offset, length, pool, params.buckets)[back])
        none = np.zeros(0, np.int64)
        yield np.concatenate(where or [none]), np.concatenate(found or [none]), doc, many - old


def _counted(batches: Iterator[pd.DataFrame], params: ImportanceParams) -> Iterator[pd.DataFrame]:
    total = np.zeros(params.buckets, np.int64)
    for batch in batches:
        for _, bucket, _, _ in bucketed(batch["text"].tolist(), params):
            total += np.bincount(bucket, minlength=params.buckets)
    bucket = np.flatnonzero(total)
    yield pd.DataFrame({"bucket": bucket.astype(np.int32), "n": total[bucket]})


def bucket_counts(texts: DataFrame, params: ImportanceParams = ImportanceParams()) -> DataFrame:
    """``bucket, n``: how many features of all texts fall in each bucket that has any."""
    rows = texts.select(F.col("text").cast("binary").alias("text"))
    return rows.mapInPandas(lambda b: _counted(b, params), "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(corpus: DataFrame, target: DataFrame, params: ImportanceParams = ImportanceParams()) -> np.ndarray:
    """Every bucket's gain from the two tables of ``bucket_counts``, a thousand times its log ratio."""
    s, t = np.zeros(params.buckets, np.int64), np.zeros(params.buckets, np.int64)
    both = corpus.select("bucket", "n", F.lit(0).alias("side")).unionAll(target.select("bucket", "n", F.lit(1).alias("side")))
    for row in both.collect():  # two rows per bucket at most
        (t if row["side"] else s)[row["bucket"]] = row["n"]
    ratio = ((t + 1.0) * (float(s.sum()) + params.buckets)) / ((s + 1.0) * (float(t.sum()) + params.buckets))
    return np.floor(1000 * np.log(ratio)).astype(np.int64)


def _weighed(batches: Iterator[pd.DataFrame], gain: np.ndarray, params: ImportanceParams) -> Iterator[pd.DataFrame]:
    for batch in batches:
        n, words, weight = (np.zeros(len(batch), np.int64) for _ in range(3))
        for where, bucket, doc, new in bucketed(batch["text"].tolist(), params):
            n += np.bincount(where, minlength=len(batch))
            np.add.at(words, doc, new)
            # Sums of whole numbers far below 2 ** 53 are exact in doubles.
            weight += np.bincount(where, gain[bucket], len(batch)).astype(np.int64)
        yield pd.DataFrame({"doc_id": batch["doc_id"].astype("Int64"), "n_words": words, "n_features": n, "weight": weight})


def weights(docs: DataFrame, gain: np.ndarray, params: ImportanceParams = ImportanceParams()) -> DataFrame:
    """``doc_id, n_words, n_features, weight`` of every row of ``docs`` (``doc_id``, ``text``)."""
    rows = docs.select(F.col("doc_id").cast("decimal(20,0)").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    return rows.mapInPandas(lambda b: _weighed(b, gain, params), "doc_id long, n_words long, n_features long, weight long")


def resample(docs: DataFrame, target: DataFrame, params: ImportanceParams = ImportanceParams()) -> DataFrame:
    """``doc_id, n_words, n_features, weight, score, rank`` of every row of ``docs``; ``rank`` is null where it is not drawn."""
    gain = gains(bucket_counts(docs, params), bucket_counts(target, params), params)
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{params.seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("long")
    gumbel = F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296)))
    # One fixed copy: the ranking reads it more than once, and row numbers part what is equal.
    scored = checkpointed(weights(docs, gain, params).withColumn("score", F.col("weight") + gumbel)
                          .withColumn("_row", F.monotonically_increasing_id()).withColumn("_short", F.col("n_words") < params.least_words))
    drawn = params.percent * scored.where("not _short").count() // 100
    ranked = positions(scored, [], ["_short", F.col("score").desc(), F.col("doc_id").asc_nulls_last(), "_row"], "_at")
    return ranked.select("doc_id", "n_words", "n_features", "weight", "score", F.when(F.col("_at") <= drawn, F.col("_at")).alias("rank"))
