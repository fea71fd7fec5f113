"""Interval joins: points and intervals meet in bins of the interval's level.

Joining on chromosome and strand alone would leave a few huge keys with every
pair to test. An interval is placed at the level whose bins are at least as long as
itself, each level's eight times the last one's, so it lies in one bin or two however
long it is. A point looks into one bin of every level that occurs. The join has an
equality on level and bin, so only near pairs are tested. A hot bin is split by AQE's
skew join, as both sides shuffle on the key.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sitewise.functions.binding import let
from sitewise.functions.scalars import genome_to_tx
from sitewise.functions.vectors import valid_count, valid_mean
from sitewise.operators.ordering import running
from sitewise.session import checkpointed

# Fixed value: width of an index bin in bases.
BIN = 16384


# Fixed value: powers of two by which the bins of a level are wider than those of the level below.
_STEP = 3


def _level(start: Column, end: Column, width: int) -> Column:
    """The lowest level whose bins are as long as the closed interval."""
    top = (62 - width.bit_length()) // _STEP
    longer = [(end - start >= F.lit(width << _STEP * k)).cast("int") for k in range(top)]
    return reduce(lambda a, b: a + b, longer)


def _bin(pos: Column, level: Column, width: int) -> Column:
    return F.floor((pos - 1) / (F.lit(width).cast("long") * F.call_function("shiftleft", F.lit(1).cast("long"), level * _STEP))).cast("long")


def _occurring(level: DataFrame) -> list[int]:
    """Levels in a one-column frame; some twenty at most."""
    return sorted(r[0] for r in level.distinct().collect() if r[0] is not None)


def point_in_interval(points: DataFrame, intervals: DataFrame, on: Sequence[str], pos: str = "pos",
                      start: str = "start", end: str = "end", bin_size: int = BIN,
                      how: str = "inner", tasks: int | None = None) -> DataFrame:
    """Every (point, interval) with equal ``on`` and ``start <= pos <= end``, or the points with or without one.

    ``how`` is ``inner``, ``left_semi`` or ``left_anti``. Where intervals are as many as points
    and bins hold few of them, ``tasks`` deals both by bin into so many tasks: the planner
    sees only the bytes of a compressed file and would send millions of intervals to every task.
    """
    if how not in ("inner", "left_semi", "left_anti"):
        raise ValueError(f"unknown join {how}")
    placed = intervals.withColumn("_level", _level(F.col(start), F.col(end), bin_size))
    levels = _occurring(placed.select("_level")) or [0]
    if how != "inner" and len(levels) > 1:
        # A point stands in several rows below, so the rows that hit are named first.
        rows = checkpointed(points.withColumn("_row", F.monotonically_increasing_id()))
        hits = point_in_interval(rows, intervals.select(*on, start, end), on, pos, start, end, bin_size, tasks=tasks).select("_row").distinct()
        return rows.join(hits, "_row", how).drop("_row")
    each = F.lit(levels[0]) if len(levels) == 1 else F.explode(F.array(*[F.lit(k) for k in levels]))
    p = points.withColumn("_level", each).withColumn("_bin", _bin(F.col(pos), F.col("_level"), bin_size))
    ends = F.array_distinct(F.array(*[_bin(F.col(c), F.col("_level"), bin_size) for c in (start, end)]))
    i = placed.withColumn("_bin", F.explode(ends))
    if tasks:
        # The only level is a constant, which is no key of the join.
        dealt = [*on, "_bin", *(["_level"] if len(levels) > 1 else [])]
        p, i = (df.repartition(tasks, *dealt).hint("merge") for df in (p, i))
    p, i = p.alias("p"), i.alias("i")
    keys = [F.col(f"p.{c}") == F.col(f"i.{c}") for c in [*on, "_level", "_bin"]]
    inside = F.col(f"p.{pos}").between(F.col(f"i.{start}"), F.col(f"i.{end}"))
    cond = reduce(lambda a, b: a & b, [*keys, inside])
    if how != "inner":
        return p.join(i, cond, how).drop("_level", "_bin")
    carried = [c for c in intervals.columns if c not in on]
    return p.join(i, cond, how).select(
        *[F.col(f"p.{c}") for c in points.columns], *[F.col(f"i.{c}") for c in carried]
    )


def _extent(df: DataFrame, start: str, end: str, width: int) -> tuple[list[int], int | None, int | None]:
    """Levels that occur, smallest start and largest end."""
    found = df.groupBy(_level(F.col(start), F.col(end), width).alias("_own")).agg(F.min(start).alias("lo"), F.max(end).alias("hi")).collect()
    levels = [r for r in found if r["_own"] is not None]
    return sorted(r["_own"] for r in levels), min((r["lo"] for r in levels), default=None), max((r["hi"] for r in levels), default=None)


def _within(df: DataFrame, start: str, end: str, extent: tuple[list[int], int | None, int | None]) -> DataFrame:
    """Intervals that lie in the extent of the other side; the others overlap nothing there."""
    levels, lo, hi = extent
    return df.where((F.col(start) <= F.lit(hi)) & (F.col(end) >= F.lit(lo)) if levels else F.lit(False))


def interval_overlap(left: DataFrame, right: DataFrame, on: Sequence[str], left_span: tuple[str, str],
                     right_span: tuple[str, str], bin_size: int = BIN) -> DataFrame:
    """Every overlapping pair of closed intervals with equal ``on``, exactly once.

    An interval stands at its own level and at the higher ones that occur on the other
    side. A pair meets at the higher of its two levels, in the first bin that both
    share there, which makes a later de-duplication unnecessary.

    Pairs grow with both tables, so nothing that follows the join should shuffle them. They come one
    right interval after the other, each with its left ones by position, which a column
    format stores in a small part of what the same pairs take the other way round.
    """
    extent = _extent(right, *right_span, bin_size)
    near = checkpointed(_within(left, *left_span, extent).orderBy(*on, *left_span))
    return _overlap(near, right, on, left_span, right_span, bin_size, extent)


def _overlap(left: DataFrame, right: DataFrame, on: Sequence[str], left_span: tuple[str, str], right_span: tuple[str, str],
             bin_size: int, right_extent: tuple[list[int], int | None, int | None]) -> DataFrame:
    """The pairs of :func:`interval_overlap`. ``left`` is a fixed copy by position."""
    ls, le = left_span
    rs, re = right_span
    left_extent = _extent(left, ls, le, bin_size)
    right = _within(right, rs, re, left_extent)

    def binned(df: DataFrame, s: str, e: str, others: list[int]) -> DataFrame:
        higher = F.filter(F.array(*[F.lit(k) for k in others]).cast("array<int>"), lambda k: k > F.col("_own"))
        first, last = (_bin(F.col(c), F.col("_level"), bin_size) for c in (s, e))
        return df.withColumn("_own", _level(F.col(s), F.col(e), bin_size)) \
            .withColumn("_level", F.explode(F.concat(F.array("_own"), higher))).withColumn("_first", first) \
            .withColumn("_bin", F.explode(F.array_distinct(F.array(F.col("_first"), last))))

    a, b = binned(left, ls, le, right_extent[0]).alias("a"), binned(right, rs, re, left_extent[0]).alias("b")
    cond = (F.col("a._bin") == F.col("b._bin")) & (F.col("a._level") == F.col("b._level")) \
        & (F.col(f"a.{ls}") <= F.col(f"b.{re}")) & (F.col(f"a.{le}") >= F.col(f"b.{rs}")) \
        & (F.col("a._level") == F.greatest(F.col("a._own"), F.col("b._own"))) \
        & (F.col("a._bin") == F.greatest(F.col("a._first"), F.col("b._first")))
    for c in on:
        cond = cond & (F.col(f"a.{c}") == F.col(f"b.{c}"))
    carried = [c for c in right.columns if c not in on]
    # The rows of the first side pass one by one, those of the second are held per key.
    return b.join(a.hint("merge"), cond).select(*[F.col(f"a.{c}") for c in left.columns], *[F.col(f"b.{c}") for c in carried])


def first_hit_per(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """One row per ``keys``: the smallest by ``order``. An aggregate, so it combines before the shuffle."""
    rest = [c for c in df.columns if c not in keys]
    best = F.min_by(F.struct(*rest), F.struct(*order)).alias("_best")
    return df.groupBy(*keys).agg(best).select(*keys, "_best.*").select(*df.columns)


def with_tx_offsets(exons: DataFrame, tid: str = "tid") -> DataFrame:
    """Add ``tx_start``/``tx_end``: cumulative exon lengths in transcript order."""
    forward = F.when(F.col("strand") == "+", F.col("start")).otherwise(-F.col("start"))
    tie = F.when(F.col("strand") == "+", F.col("end")).otherwise(-F.col("end"))
    length = F.col("end") - F.col("start") + 1
    ordered = exons.withColumns({"_o1": forward, "_o2": tie})
    total = running(ordered, [tid], ["_o1", "_o2"], {"tx_end": ("sum", length)})
    return total.withColumn("tx_start", F.col("tx_end") - length + 1).drop("_o1", "_o2")


def map_to_transcripts(points: DataFrame, exons: DataFrame, point_keys: Sequence[str], pos: str = "pos",
                       bin_size: int = BIN, disjoint_exons: bool = False) -> DataFrame:
    """Points to transcript positions, one hit per (point, transcript).

    A point can hit two exons only of a transcript whose exons overlap; only the hits of
    such transcripts are shuffled to find the first. Where exons are known not to overlap
    and points not to repeat, ``disjoint_exons`` saves looking for them.
    """
    on = ["chrom", "strand"]
    if disjoint_exons:
        hits = point_in_interval(points, exons, on, pos, bin_size=bin_size)
    else:
        points = points.dropDuplicates([*point_keys])
        transcript = Window.partitionBy(*on, "tid")
        reached = F.max("end").over(transcript.orderBy("start", "end").rowsBetween(Window.unboundedPreceding, -1))
        marked = checkpointed(exons.withColumn("_over", F.coalesce(F.col("start") <= reached, F.lit(False)))
                              .withColumn("_over", F.max("_over").over(transcript)))
        single, over = (point_in_interval(points, marked.where(w).drop("_over"), on, pos, bin_size=bin_size) for w in ("not _over", "_over"))
        # The rest of a transcript may lie on another chromosome or strand, but a point hits only there where it lies.
        hits = single.unionByName(first_hit_per(over, [*point_keys, "tid"], ["tx_start"]))
    return hits.withColumn(
        "tx_pos", genome_to_tx(F.col("start"), F.col("end"), F.col("strand"), F.col("tx_start"), F.col(pos)))


def offset_yields(points: DataFrame, exons: DataFrame, offsets: Sequence[int], point_key: Sequence[str],
                  pos: str = "pos", bin_size: int = BIN) -> DataFrame:
    """How many points hit an exon when shifted by each offset."""
    shifted = points.withColumn("offset", F.explode(F.array(*[F.lit(o) for o in offsets]))) \
        .withColumn(pos, F.col(pos) + F.col("offset"))
    hits = point_in_interval(shifted, exons, ["chrom", "strand"], pos, bin_size=bin_size, how="left_semi")
    return hits.groupBy("offset").agg(F.count_distinct(*point_key).alias("mapped_records"))


def project_annotation(features: DataFrame, exons: DataFrame) -> DataFrame:
    """Transcript span of coding features: both ends through the exon that holds them.

    ``features`` has ``tid, feature ('CDS' | 'stop_codon'), start, end``.
    """
    ends = features.select("tid", "feature", F.explode(F.array("start", "end")).alias("gpos"))
    e = exons.select("tid", F.col("start").alias("e_start"), F.col("end").alias("e_end"), "strand", "tx_start")
    hit = ends.join(e, "tid").where(F.col("gpos").between(F.col("e_start"), F.col("e_end")))
    first = hit.groupBy("tid", "feature", "gpos").agg(
        F.min_by(F.struct("e_start", "e_end", "strand", "tx_start"), F.col("tx_start")).alias("x"))
    tx = first.select("tid", "feature", genome_to_tx(
        F.col("x.e_start"), F.col("x.e_end"), F.col("x.strand"), F.col("x.tx_start"), F.col("gpos")).alias("tx"))
    cds, stop = F.col("feature") == "CDS", F.col("feature") == "stop_codon"
    return tx.groupBy("tid").agg(
        F.min(F.when(cds, F.col("tx"))).alias("cds_start_tx"),
        F.max(F.when(cds, F.col("tx"))).alias("cds_end_tx"),
        F.min(F.when(stop, F.col("tx"))).alias("stop_codon_start_tx"),
    )


def spliced_interval_features(peaks: DataFrame, exons: DataFrame, vectors: DataFrame, peak_key: str,
                              flank: int = 10, min_side: float = 0.7, min_peak: float = 0.7,
                              bin_size: int = BIN) -> DataFrame:
    """Signal over the exonic part of each interval, per transcript.

    ``peaks`` holds 0-based half-open spans ``start0, end0``. Overlapping exon
    pieces of one transcript are disjoint in transcript coordinates, so sums over
    the pieces are sums over the union of covered positions.

    Pairs grow with both tables. An exon brings its stretch of its transcript's vector to the interval join, and a pair
    is shuffled only where its peak reaches another exon of the transcript or its key is that of several peaks.
    """
    on, span_p, span_e = ["chrom", "strand"], ("p_start", "p_end"), ("start", "end")
    chain = Window.partitionBy("tid", *on).orderBy("start", "end")
    placed = checkpointed(exons.select("tid", *on, "start", "end", "tx_start").repartition("tid").withColumns({
        "_before": F.max("end").over(chain.rowsBetween(Window.unboundedPreceding, -1)), "_after": F.lead("start").over(chain)}))
    extent = _extent(placed, *span_e, bin_size)
    closed = _within(peaks.select(peak_key, *on, (F.col("start0") + 1).alias("p_start"), F.col("end0").alias("p_end")), *span_p, extent)
    closed = checkpointed(closed.withColumn("_many", F.count(F.lit(1)).over(Window.partitionBy(peak_key)) > 1).orderBy(*on, *span_p))
    lo, hi = F.greatest("p_start", "start"), F.least("p_end", "end")
    a = genome_to_tx(F.col("start"), F.col("end"), F.col("strand"), F.col("tx_start"), lo)
    b = genome_to_tx(F.col("start"), F.col("end"), F.col("strand"), F.col("tx_start"), hi)
    piece = F.struct(F.least(a, b).alias("t_lo"), F.greatest(a, b).alias("t_hi"))
    signal = vectors.select("tid", "values").withColumns({"_n": F.size("values"), "_skipped": F.lit(0).cast("long")})
    far = F.col("tx_start") + F.col("end") - F.col("start")
    skipped = F.greatest(F.least(F.col("tx_start"), far) - flank - 1, F.lit(0))
    length = F.greatest(F.least(F.greatest(F.col("tx_start"), far) + flank, F.col("_n")) - F.col("_skipped"), F.lit(0))
    brought = placed.join(signal, "tid").withColumn("_skipped", skipped) \
        .withColumn("values", F.slice("values", (F.col("_skipped") + 1).cast("int"), length.cast("int")))
    reaches = F.coalesce(F.col("_before") >= F.col("p_start"), F.lit(False)) | F.coalesce(F.col("_after") <= F.col("p_end"), F.lit(False))

    def pairs(left: DataFrame, right: DataFrame, known: tuple[list[int], int | None, int | None]) -> DataFrame:
        return _overlap(left, right, on, span_p, span_e, bin_size, known)

    once, several = closed.where("not _many"), placed.where("_before IS NOT NULL OR _after IS NOT NULL")
    alone = pairs(once, brought, extent).where(~reaches).select(peak_key, "tid", F.array(piece).alias("_pieces"), "values", "_n", "_skipped")
    shared = pairs(once, several, _extent(several, *span_e, bin_size)).where(reaches).unionByName(pairs(closed.where("_many"), placed, extent))
    # The set drops repeated pieces, so a pair's pieces meet in one shuffle; what follows from them is worked out after the join.
    shared = shared.groupBy(peak_key, "tid").agg(F.collect_set(piece).alias("_pieces")).join(signal, "tid")
    j = alone.unionByName(shared).withColumns({
        "_pieces": F.array_sort("_pieces"), "peak_tx_start": F.array_min("_pieces.t_lo"), "peak_tx_end": F.array_max("_pieces.t_hi"),
        "peak_exonic_nt": F.aggregate("_pieces", F.lit(0).cast("long"), lambda s, p: s + p["t_hi"] - p["t_lo"] + 1)})
    n = F.col("_n")

    def span(lo: Column, hi: Column) -> Column:
        first = F.greatest(lo, F.lit(1))
        return F.slice("values", (first - F.col("_skipped")).cast("int"), F.greatest(F.least(hi, n) - first + 1, F.lit(0)).cast("int"))

    covered = F.flatten(F.transform("_pieces", lambda p: span(p["t_lo"], p["t_hi"])))
    up = span(F.col("peak_tx_start") - flank, F.col("peak_tx_start") - 1)
    down = span(F.col("peak_tx_end") + 1, F.col("peak_tx_end") + flank)
    out = j.select(
        peak_key, "tid", "peak_tx_start", "peak_tx_end", "peak_exonic_nt",
        valid_count(covered).alias("peak_valid_count"),
        valid_mean(covered).alias("peak_mean"),
        F.when(F.col("peak_tx_start") > flank, valid_count(up) / flank).alias("coverage_upstream"),
        F.when(F.col("peak_tx_end") + flank <= n, valid_count(down) / flank).alias("coverage_downstream"),
        valid_mean(up).alias("mean_upstream"), valid_mean(down).alias("mean_downstream"),
    )
    return out.withColumns({
        "peak_valid_fraction": F.round(F.col("peak_valid_count") / F.col("peak_exonic_nt"), 8),
        "main_window_valid": F.coalesce(
            (F.col("coverage_upstream") >= min_side) & (F.col("coverage_downstream") >= min_side)
            & (F.col("peak_valid_count") / F.col("peak_exonic_nt") >= min_peak), F.lit(False)),
    })


def reference_bases(positions: DataFrame, sequences: DataFrame, chunk: int = 1 << 16) -> DataFrame:
    """Letter at each wanted 1-based ``(chrom, pos)``; positions outside are dropped.

    Long sequences are cut into chunks, so a chromosome is many rows and the
    lookup is an equi-join on (chrom, chunk).
    """
    pieces = sequences.select("chrom", F.posexplode(let(F.col("seq"), lambda s: F.transform(
        F.sequence(F.lit(0), F.greatest(F.ceil(F.length(s) / chunk).cast("int") - 1, F.lit(0))),
        lambda i: F.substring(s, i * chunk + 1, F.lit(chunk))))).alias("_chunk", "_text"))
    wanted = positions.select("chrom", "pos").distinct() \
        .withColumn("_chunk", F.floor((F.col("pos") - 1) / chunk).cast("int"))
    at = ((F.col("pos") - 1) % chunk + 1).cast("int")
    return wanted.join(pieces, ["chrom", "_chunk"]).where(F.length("_text") >= at) \
        .select("chrom", "pos", F.substring(F.col("_text"), at, F.lit(1)).alias("base"))
