"""Token counts of flat token files that have no index, by a separator scan.

A token file is nothing but ids of a fixed width, one document after the other, each
closed by an end-of-document id. A file is cut into blocks of a fixed number of ids;
tasks read blocks on their own and find the separators of a block in one vectorised
comparison. What a block cannot know, how many documents closed before it and where the
last one did, comes from a prefix scan over block totals: first inside stretches of
``STRETCH`` blocks, then over the stretches, so that a file of any length spreads over
tasks. A document that runs over many blocks costs nothing more.

Ids after the last separator are a document that is not ended (``ended`` false). An empty
file has no document. Two separators in a row close an empty document. A file whose size
is no multiple of the width is refused.

``write_tokens`` makes such files from texts, one or more per task, and returns which
document went where; null text is empty and becomes a lone separator. Repeated rows are
written again.
"""

from __future__ import annotations

from base64 import b64decode
from collections.abc import Callable, Iterator
from functools import cache

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sitewise.llm.common import SharedFiles
from sitewise.session import checkpointed

STRETCH = 1024
BLOCK_IDS = 1 << 20
FILE_BYTES = 256 << 20


@cache
def byte_pair_encoder(path: str, pattern: str) -> Callable[[str], list[int]]:
    """Ordinary ids of a ranks file; one encoder per worker."""
    import tiktoken

    ranks = {b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}).encode_ordinary


def _written(batches: Iterator[pd.DataFrame], folder: str, encode: Callable[[], Callable], separator: int, width: str, file_bytes: int) -> Iterator[pd.DataFrame]:
    files, part, number, encoder = SharedFiles(folder), TaskContext.get().partitionId(), 0, encode()
    rows = ((i, t) for batch in batches for i, t in zip(batch["doc_id"], batch["text"]))
    row = next(rows, None)
    while row is not None:
        name, size, ids = f"part-{part:06d}-{number:04d}.ids", 0, []
        with files.write(name) as out:
            while row is not None and size < file_bytes:
                data = np.array([*encoder(row[1] or ""), separator], width).tobytes()
                out.write(data)
                size += len(data)
                ids.append(row[0])
                row = next(rows, None)
        number += 1
        yield pd.DataFrame({"file": name, "bytes": size, "ordinal": range(len(ids)), "doc_id": ids}).astype({"doc_id": "Int64"})


def write_tokens(docs: DataFrame, folder: str, encode: Callable[[], Callable], separator: int, width: str = "<u2", file_bytes: int = FILE_BYTES) -> DataFrame:
    """Write ``doc_id, text`` as token files and return ``file, bytes, ordinal, doc_id`` per document.

    ``encode()`` makes the encoder inside a task. A file is whole once it has its name, and a
    task that runs again writes it anew with the same bytes.
    """
    rows = docs.select(F.col("doc_id").cast("decimal(20,0)").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    return checkpointed(rows.mapInPandas(lambda b: _written(b, folder, encode, separator, width, file_bytes), "file string, bytes long, ordinal long, doc_id long"))


def list_token_files(spark: SparkSession, folder: str, pattern: str = "*.ids") -> DataFrame:
    """``file, bytes`` of a folder's token files; their contents are not read."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(folder)
    return found.select(F.regexp_extract("path", r"[^/]+$", 0).alias("file"), F.col("length").alias("bytes"))


def _scanned(batches: Iterator[pd.DataFrame], folder: str, separator: int, width: str, block_ids: int) -> Iterator[pd.DataFrame]:
    files, each = SharedFiles(folder), np.dtype(width).itemsize
    for batch in batches:
        for name, block in zip(batch["file"], batch["block"]):
            with files.read(name) as stream:
                stream.seek(int(block) * block_ids * each)
                ids = np.frombuffer(stream.read(block_ids * each), width)
            ends = np.flatnonzero(ids == separator).astype(np.int32)
            yield pd.DataFrame({"file": [name], "block": [block], "ids": [len(ids)], "ends": [ends]})


def scan(files: DataFrame, folder: str, separator: int, width: str = "<u2", block_ids: int = BLOCK_IDS) -> DataFrame:
    """``file, ordinal, start, n_tokens, ended`` of every document in the named files (``file, bytes``)."""
    each = np.dtype(width).itemsize
    whole = F.when(F.col("bytes") % each == 0, F.col("bytes") / each).otherwise(F.raise_error(F.lit("a token file of broken length"))).cast("long")
    sized = files.select("file", whole.alias("n")).where("n > 0")
    blocks = sized.select("file", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / block_ids))).alias("block"))
    found = checkpointed(blocks.repartition("file", "block").mapInPandas(
        lambda b: _scanned(b, folder, separator, width, block_ids), "file string, block long, ids int, ends array<int>"))
    last = F.when(F.size("ends") > 0, F.col("block") * block_ids + F.element_at("ends", -1))
    totals = found.select("file", "block", F.floor(F.col("block") / STRETCH).alias("stretch"), "ids", F.size("ends").cast("long").alias("n"), last.alias("last"))
    earlier = Window.partitionBy("file", "stretch").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    inside = totals.select("file", "block", "stretch", F.sum("n").over(earlier).alias("_n"), F.max("last").over(earlier).alias("_last"))
    before = Window.partitionBy("file").orderBy("stretch").rowsBetween(Window.unboundedPreceding, -1)
    stretches = totals.groupBy("file", "stretch").agg(F.sum("n").alias("n"), F.max("last").alias("last")) \
        .select("file", "stretch", F.sum("n").over(before).alias("_n0"), F.max("last").over(before).alias("_last0"))
    carry = inside.join(stretches, ["file", "stretch"]).select(
        "file", "block", (F.coalesce("_n", F.lit(0)) + F.coalesce("_n0", F.lit(0))).alias("_before"), F.coalesce("_last", "_last0", F.lit(-1)).alias("_prev"))
    base = F.col("block") * block_ids

    def document(end, i):
        start = F.when(i == 0, F.col("_prev")).otherwise(base + F.get("ends", i - 1)) + 1
        return F.struct((F.col("_before") + i).alias("ordinal"), start.alias("start"), (base + end - start).alias("n_tokens"), F.lit(True).alias("ended"))

    closed = found.select("file", "block", "ends").join(carry, ["file", "block"]).select("file", F.inline(F.transform("ends", document)))
    tails = totals.groupBy("file").agg(F.sum("ids").alias("ids"), F.sum("n").alias("ordinal"), (F.coalesce(F.max("last"), F.lit(-1)) + 1).alias("start")) \
        .where("start < ids").select("file", "ordinal", "start", (F.col("ids") - F.col("start")).alias("n_tokens"), F.lit(False).alias("ended"))
    return closed.unionAll(tails)
