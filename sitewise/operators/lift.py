"""Coordinate lift through aligned blocks, in both directions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sitewise.operators.intervals import BIN, point_in_interval
from sitewise.session import checkpointed, tasks_for


def _flip(strand):
    return F.when(strand == "-", "+").otherwise("-")


def _images(points: DataFrame, blocks: DataFrame, direction: str, bin_size: int, tasks: int | None) -> DataFrame:
    """The target of each point in each block that holds it; a target that several blocks give stands several times."""
    here, there = ("source", "target") if direction == "forward" else ("target", "source")
    spans = blocks.select(
        F.col(f"{here}_chrom").alias("chrom"),
        (F.col(f"{here}_start") + 1).alias("_start"), F.col(f"{here}_end").alias("_end"),
        F.col(f"{there}_chrom").alias("lifted_chrom"), F.col(f"{there}_start").alias("_to_start"),
        F.col(f"{there}_end").alias("_to_end"), "target_strand", F.col("score"),
    )
    hits = point_in_interval(points, spans, ["chrom"], "pos", "_start", "_end", bin_size, tasks=tasks)
    offset = F.col("pos") - F.col("_start")
    plus = F.col("target_strand") == "+"
    return hits.withColumns({
        "lifted_pos": F.when(plus, F.col("_to_start") + offset + 1).otherwise(F.col("_to_end") - offset),
        "lifted_strand": F.when(plus, F.col("strand")).otherwise(_flip(F.col("strand"))),
    })


def lift(points: DataFrame, blocks: DataFrame, key: Sequence[str], direction: str = "forward",
         bin_size: int = BIN, tasks: int | None = None) -> DataFrame:
    """All distinct targets of each 1-based ``(chrom, pos, strand)``.

    ``blocks`` holds 0-based half-open source and target spans. Adds
    ``lifted_chrom, lifted_pos, lifted_strand, score``; where several blocks give
    one target its best score stands. ``tasks`` deals points by bin and targets by ``key``
    into so many tasks, however many the session has.
    """
    cols = [c for c in points.columns if c not in key]
    images = _images(points, blocks, direction, bin_size, tasks)
    return (images.repartition(tasks, *key) if tasks else images) \
        .groupBy(*key, *cols, "lifted_chrom", "lifted_pos", "lifted_strand").agg(F.max("score").alias("score"))


def classify_lift(points: DataFrame, lifted: DataFrame, key: Sequence[str]) -> DataFrame:
    """One row per point: ``unmapped``, ``ambiguous`` or ``unique`` with its target."""
    target = F.struct("lifted_chrom", "lifted_pos", "lifted_strand", "score")
    best = lifted.groupBy(*key).agg(
        F.count(F.lit(1)).alias("mapping_count"),
        F.min_by(target, F.struct(-F.col("score"), F.col("lifted_chrom"), F.col("lifted_pos"), F.col("lifted_strand")))
        .alias("_t"),
    )
    j = points.join(best, list(key), "left")
    one = F.col("mapping_count") == 1
    status = F.when(F.col("mapping_count").isNull(), "unmapped").when(one, "unique").otherwise("ambiguous")
    return j.select(
        *points.columns, F.coalesce("mapping_count", F.lit(0)).alias("mapping_count"), status.alias("mapping_status"),
        *[F.when(one, F.col(f"_t.{c}")).alias(c) for c in ("lifted_chrom", "lifted_pos", "lifted_strand", "score")],
    )


def round_trip(points: DataFrame, blocks: DataFrame, key: Sequence[str], bin_size: int = BIN) -> DataFrame:
    """Points whose forward image maps back onto themselves.

    Images that repeat are not gathered: the last join asks only whether there is one.
    """
    key, points = list(key), checkpointed(points)
    tasks = tasks_for(points)
    there = _images(points.select(*key, *[c for c in ("chrom", "pos", "strand") if c not in key]), blocks, "forward", bin_size, tasks)
    origin = {c: f"_origin_{c}" for c in ("chrom", "pos", "strand")}
    image = there.select(
        *[F.col(k).alias(f"_key_{k}") for k in key],
        *[F.col(c).alias(o) for c, o in origin.items()],
        F.col("lifted_chrom").alias("chrom"), F.col("lifted_pos").alias("pos"), F.col("lifted_strand").alias("strand"),
    )
    back = _images(image, blocks, "reverse", bin_size, tasks)
    # Compared as one struct: an equality of chromosomes alone would become a key of the join above and deal its rows once more.
    same = F.struct("lifted_chrom", "lifted_pos", "lifted_strand") == F.struct(*origin.values())
    good = back.where(same & F.col(origin["strand"]).isNotNull()).select(*[F.col(f"_key_{k}").alias(k) for k in key])
    return points.repartition(tasks, *key).join(good.repartition(tasks, *key), key, "left_semi")
