"""Packing documents into sequences of a fixed length by bulk-synchronous best fit.

A document becomes token ids closed by an end id; only one longer than a sequence is cut.
Pieces are packed in rounds. A round takes the pieces of at least half the largest
remaining length (of an eighth, when the round before left none without a place) and
all gaps, and range-sorts both by falling size, gaps before pieces of their size. In that
order a gap opens a bracket and a piece closes one, so a piece is matched with the
smallest gap before it that no other piece has taken: its successor in size. Depths come
from running sums inside the parts plus the parts' totals. On one depth gaps and pieces
alternate, which settles conflicts by rank; a depth holds at most two rows per distinct
size, so no depth is large however many pieces are alike. A gap of several times the
largest piece takes part as that many gaps. Then gaps shrink, the largest pieces without
a place open sequences (each longer than half a sequence, and otherwise ``opened`` of
what their tokens would fill), and the next round starts. Rounds grow with the logarithm
of the sequence length, not with the number of documents.

Only sums per part and counts per length (at most one per token of a sequence) reach the
driver. A sequence's number is the row number of the piece that opened it.

Null text is empty and gives a piece of one token. Repeated rows are pieces of their own.
No rows: an empty result.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from math import ceil

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sitewise.session import checkpointed

PIECE = "doc_id long, piece int, start long, length long, ids_crc32 long"


@dataclass(frozen=True)
class PackParams:
    capacity: int = 4096
    end_id: int = 1
    opened: float = 0.8
    rows_per_part: int = 50_000


def _cut(batches: Iterator[pd.DataFrame], encoder: Callable[[], Callable], params: PackParams) -> Iterator[pd.DataFrame]:
    encode, end, step = encoder(), np.array([params.end_id], "<u4").tobytes(), 4 * params.capacity
    for batch in batches:
        rows = []
        for doc_id, ids in zip(batch["doc_id"], encode([t if isinstance(t, str) else "" for t in batch["text"]])):
            ids += end
            for i, at in enumerate(range(0, len(ids), step)):
                part = ids[at:at + step]
                rows.append((doc_id, i, at // 4, len(part) // 4, zlib.crc32(part)))
        yield pd.DataFrame(rows, columns=["doc_id", "piece", "start", "length", "ids_crc32"]).astype({"doc_id": "Int64"})


def pieces(docs: DataFrame, encoder: Callable[[], Callable], params: PackParams = PackParams()) -> DataFrame:
    """Every document's pieces; ``encoder()`` makes, inside a task, a function from texts to little-endian 32-bit ids."""
    rows = docs.select(F.col("doc_id").cast("decimal(20,0)").alias("doc_id"), "text")
    return rows.mapInPandas(lambda b: _cut(b, encoder, params), PIECE)


def _depths(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    part, depth, at = TaskContext.get().partitionId(), 0, 0
    for batch in batches:
        running = depth + np.where(batch["kind"].to_numpy() == 0, 1, -1).cumsum()
        yield batch.assign(part=part, at=range(at, at + len(batch)), depth=running)
        depth, at = int(running[-1]), at + len(batch)


def _sweep(gaps: DataFrame, wanted: DataFrame, params: PackParams, rows: int) -> DataFrame:
    """``pid, len, bin`` of every wanted piece, ``bin`` null where no gap is left for it."""
    both = gaps.select("size", F.lit(0).alias("kind"), F.col("bin").alias("id")).unionAll(wanted.select(F.col("len").alias("size"), F.lit(1).alias("kind"), F.col("pid").alias("id")))
    order = [F.col("size").desc(), F.col("kind"), F.col("id")]
    ordered = both.repartitionByRange(max(1, rows // params.rows_per_part), *order).sortWithinPartitions(*order)
    # Merging here would part the sorted run, so this copy keeps its partitions.
    swept = checkpointed(ordered.mapInPandas(_depths, "size int, kind int, id long, part int, at long, depth long"))
    totals = {r["part"]: r["t"] for r in swept.groupBy("part").agg(F.sum(1 - 2 * F.col("kind")).alias("t")).collect()}
    before, base = 0, []
    for part in sorted(totals):
        base += [F.lit(part), F.lit(before)]
        before += totals[part]
    depth = F.col("depth") + F.element_at(F.create_map(*base), F.col("part"))
    level = Window.partitionBy("level").orderBy("part", "at")
    met = swept.withColumn("level", depth + F.col("kind")).select(
        "kind", "id", "size", F.lag("kind").over(level).alias("_kind"), F.lag("id").over(level).alias("_id"))
    return met.where("kind = 1").select(F.col("id").alias("pid"), F.col("size").alias("len"), F.when(F.col("_kind") == 0, F.col("_id")).alias("bin"))


def _openers(unmatched: DataFrame, params: PackParams) -> tuple[DataFrame, int]:
    """The pieces that open a sequence, and how many pieces had no place."""
    counts = sorted(((r["len"], r["n"]) for r in unmatched.groupBy("len").agg(F.count(F.lit(1)).alias("n")).collect()), reverse=True)
    total = sum(n for _, n in counts)
    many = max(1, sum(n for s, n in counts if 2 * s > params.capacity), ceil(params.opened * sum(s * n for s, n in counts) / params.capacity))
    least, left, of = params.capacity + 1, many, 1
    for size, n in counts:
        if left <= 0:
            break
        least, of = size, n
        if n > left:
            break
        left -= n
    # Of the last length as many as are left, told by a hash, and one at least.
    some = F.pmod(F.xxhash64("pid"), F.lit(of)) < max(0, left)
    first = unmatched.where(F.col("len") == least).agg(F.min("pid").alias("p")).first()["p"] if total else None
    whole = left <= 0 or of <= left
    return unmatched.where((F.col("len") > least) | ((F.col("len") == least) & (F.lit(whole) | some | (F.col("pid") == F.lit(first))))), total


def pack(cut: DataFrame, params: PackParams = PackParams()) -> DataFrame:
    """``cut`` (see ``pieces``) with ``sequence_id`` and ``offset``."""
    cut = checkpointed(cut.withColumn("pid", F.monotonically_increasing_id()))
    short = cut.where(F.col("length") < params.capacity).select("pid", F.col("length").cast("int").alias("len"))
    every = short.count()
    left, opened = checkpointed(short, every), 0
    placed = [cut.where(F.col("length") == params.capacity).select("pid", F.col("pid").alias("bin"), F.lit(0).alias("offset"))]
    bins, share = left.select(F.col("pid").alias("bin"), F.col("len").alias("free")).where("false"), 2
    while True:
        now = left.agg(F.count(F.lit(1)).alias("n"), F.max("len").alias("most"), F.min("len").alias("least")).first()
        if not now["n"]:
            break
        most, floor = now["most"], -(-now["most"] // share)
        ways = F.greatest(F.lit(1), F.floor(F.col("free") / most).cast("int"))
        gaps = bins.where(F.col("free") >= now["least"]).select("bin", "free", ways.alias("q"), F.explode(F.sequence(F.lit(1), ways)).alias("i")) \
            .select("bin", F.when(F.col("i") < F.col("q"), F.lit(most)).otherwise(F.col("free") - (F.col("q") - 1) * most).cast("int").alias("size"))
        matched = checkpointed(_sweep(gaps, left.where(F.col("len") >= floor), params, now["n"]), now["n"])
        opening, without = _openers(matched.where("bin is null"), params)
        opening = checkpointed(opening.select("pid", "len"), without)
        opened += without
        taken = matched.where("bin is not null")
        ahead = F.sum("len").over(Window.partitionBy("bin").orderBy("pid").rowsBetween(Window.unboundedPreceding, 0))
        put = taken.select("pid", "bin", "len", (ahead - F.col("len")).alias("_ahead")).join(bins, "bin") \
            .select("pid", "bin", (params.capacity - F.col("free") + F.col("_ahead")).cast("int").alias("offset"))
        placed += [checkpointed(put, now["n"]), opening.select("pid", F.col("pid").alias("bin"), F.lit(0).alias("offset"))]
        used = taken.groupBy("bin").agg(F.sum("len").cast("int").alias("_used"))
        bins = checkpointed(bins.join(used, "bin", "left").select("bin", (F.col("free") - F.coalesce("_used", F.lit(0))).alias("free")).where("free > 0")
                            .unionAll(opening.select(F.col("pid").alias("bin"), (params.capacity - F.col("len")).alias("free"))), min(opened, every))
        left = checkpointed(left.where(F.col("len") < floor).unionAll(matched.where("bin is null").select("pid", "len").join(opening.select("pid"), "pid", "left_anti")), now["n"])
        share = 2 if without else 8
    everywhere = placed[0]
    for some in placed[1:]:
        everywhere = everywhere.unionAll(some)
    return cut.join(everywhere, "pid").select(*[c for c in cut.columns if c != "pid"], F.col("bin").alias("sequence_id"), F.col("offset").cast("long").alias("offset"))
