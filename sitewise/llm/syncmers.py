"""Document fingerprints from closed syncmers.

A k-mer of code points is a closed syncmer when the smallest of its inner s-mers (by a
hash, the first of equals) stands at its first or its last place. Whether a k-mer is one
depends on nothing but itself, so an edit elsewhere in the text never changes the
anchors around it. A fingerprint keeps, of all distinct anchors of the whole text, the
``size`` with the smallest hashes, each with its first position, written in hex as
8 digits of hash and 8 of position. Fewer anchors are all kept.

The likeness of two fingerprints takes the ``size`` smallest hashes of their union (the
usual bottom-k estimate of the share of common anchors); an anchor that both hold counts
only if its displacement agrees with the displacement most common anchors have, to
within ``slack`` code points or half of the text in between, whichever is larger. It is
1 for equal fingerprints.

A text of fewer than ``short`` code points also gives its anchors for ``short_k`` and
``short_s``, which an edit of a few words leaves; one that has no anchor at all uses the
hash of the whole text. Null text is empty; an
empty text has an empty fingerprint, and two empty fingerprints have the likeness 1.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SLICE = 1 << 18


@dataclass(frozen=True)
class SyncmerParams:
    k: int = 16
    s: int = 5
    size: int = 128
    slack: int = 64
    short: int = 128
    short_k: int = 4
    short_s: int = 2


def _mix(h: np.ndarray) -> np.ndarray:
    h ^= h >> np.uint32(16)
    h *= np.uint32(0x7FEB352D)
    h ^= h >> np.uint32(15)
    h *= np.uint32(0x846CA68B)
    h ^= h >> np.uint32(16)
    return h


def _window(values: np.ndarray, width: int) -> np.ndarray:
    """Polynomial hash of every run of ``width`` values, modulo 2**32, by doubling."""
    base = 0x01000193
    power, have, out = base, 1, values
    parts, rest, at = None, width, 0
    while rest:
        if rest & 1:
            piece = out[at:]
            if parts is None:
                parts = piece
            else:
                n = min(len(parts), len(piece))
                parts = parts[:n] * np.uint32(power) + piece[:n]
            at += have
        rest >>= 1
        if rest:
            out = out[:-have] * np.uint32(power) + out[have:] if len(out) > have else out[:0]
            have, power = have * 2, power * power & 0xFFFFFFFF
    return parts[:max(0, len(values) - width + 1)]


def _running_min(values: np.ndarray, width: int) -> np.ndarray:
    have, out = 1, values
    while have * 2 <= width:
        out = np.minimum(out[:-have], out[have:])
        have *= 2
    return out if have == width else np.minimum(out[:len(values) - width + 1], out[width - have:])


def anchors(points: np.ndarray, k: int, s: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and positions of all closed syncmers of at least ``k`` code points."""
    small = _mix(_window(points, s))
    inner = k - s + 1
    least = _running_min(small, inner)
    at = np.flatnonzero((small[:len(least)] == least) | (small[inner - 1:] == least))
    return _mix(_window(points, k)[at]), at


def sketch(text: str, params: SyncmerParams) -> tuple[np.ndarray, np.ndarray]:
    """The smallest distinct anchor hashes in order, and their first positions."""
    if not text:
        return np.zeros(0, np.uint32), np.zeros(0, np.int64)
    if len(text) < params.short:
        return _short(text, params)
    hashes, places = np.zeros(0, np.uint32), np.zeros(0, np.int64)
    for at in range(0, len(text) - params.k + 1, SLICE):
        points = np.frombuffer(text[at:at + SLICE + params.k - 1].encode("utf-32-le", "surrogatepass"), np.uint32)
        h, p = anchors(points, params.k, params.s)
        if len(h) > 8 * params.size:  # only the smallest can stay
            few = np.argpartition(h, 4 * params.size)[:4 * params.size]
            if len(np.unique(h[few])) >= params.size:
                few.sort()
                h, p = h[few], p[few]
        hashes, places = np.concatenate((hashes, h)), np.concatenate((places, p + at))
        hashes, first = np.unique(hashes, return_index=True)
        hashes, places = hashes[:params.size], places[first[:params.size]]
    return (hashes, places) if len(hashes) else _whole(text)


def _short(text: str, params: SyncmerParams) -> tuple[np.ndarray, np.ndarray]:
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    found = [anchors(points, k, s) for k, s in ((params.k, params.s), (params.short_k, params.short_s)) if len(text) >= k]
    hashes, first = np.unique(np.concatenate([h for h, _ in found]), return_index=True) if found else (np.zeros(0, np.uint32), np.zeros(0, np.int64))
    if not len(hashes):
        return _whole(text)
    return hashes[:params.size], np.concatenate([p for _, p in found])[first[:params.size]]


def _whole(text: str) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(hashlib.sha256(text.encode("utf-8", "surrogatepass")).digest()[:4], np.uint32), np.zeros(1, np.int64)


def written(hashes: np.ndarray, places: np.ndarray) -> str:
    return np.stack((hashes, places), 1).astype(">u4").tobytes().hex()


def read(fingerprint: str) -> tuple[np.ndarray, np.ndarray]:
    pairs = np.frombuffer(bytes.fromhex(fingerprint), ">u4").reshape(-1, 2)
    return pairs[:, 0].astype(np.uint32), pairs[:, 1].astype(np.int64)


def likeness(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray], params: SyncmerParams) -> float:
    (ha, pa), (hb, pb) = a, b
    if not len(ha) or not len(hb):
        return float(len(ha) == len(hb))
    union = np.union1d(ha, hb)[:params.size]
    both, ia, ib = np.intersect1d(ha, hb, assume_unique=True, return_indices=True)
    inside = both <= union[-1]
    if not inside.any():
        return 0.0
    shift = pb[ib[inside]] - pa[ia[inside]]
    spread = np.maximum(params.slack, np.maximum(pa[ia[inside]], pb[ib[inside]]) / 2)
    return float((np.abs(shift - np.median(shift)) <= spread).sum() / len(union))


def fingerprint(text: str | None, params: SyncmerParams = SyncmerParams()) -> str:
    return written(*sketch(text or "", params))


def edited(text: str, following: str) -> str:
    """The last half of ``text`` replaced by as many code points of ``following``, or all it has."""
    half = len(text) // 2
    return text[:len(text) - half] + following[:half]


def _rows(batches: Iterator[pd.DataFrame], params: SyncmerParams) -> Iterator[pd.DataFrame]:
    """Over rows in order: a row is finished when the next one of its run has come."""
    held = None  # run, doc_id, text, sketch
    for batch in batches:
        out = []
        for run, ahead, doc_id, text in zip(batch["_run"], batch["_ahead"], batch["doc_id"], batch["text"]):
            text = text if isinstance(text, str) else ""
            own = sketch(text, params)
            if held and held[0] == run:
                out.append(_finished(held, text, own, params))
            # Rows lent by the next run only finish the last own row; the first of them in order is the neighbour.
            held = None if ahead else (run, doc_id, text, own)
        if out:
            yield pd.DataFrame(out, columns=["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"])


def _finished(held: tuple, following: str, theirs: tuple, params: SyncmerParams) -> tuple:
    _, doc_id, text, own = held
    changed = edited(text, following)
    now = sketch(changed, params)
    return (doc_id, len(text), hashlib.sha256(changed.encode("utf-8", "surrogatepass")).hexdigest(), written(*own), written(*now),
            likeness(own, now, params), likeness(own, theirs, params))


def fingerprints_with_neighbours(docs: DataFrame, params: SyncmerParams = SyncmerParams(), run_rows: int = 1500) -> DataFrame:
    """Fingerprints of every text and of its edit with the next text in descending ``doc_id``.

    Rows are dealt into runs of neighbouring ids by bounds taken from quantiles of the ids;
    texts are shuffled once. The first row of each run is also lent to the run before it,
    and the very first to the last run. Null ids come last; rows of one id are ordered by
    text, null text first. A single row is its own neighbour.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    rows = docs.count()
    runs = max(1, min(2000, -(-rows // run_rows)))
    bounds = sorted(set(docs.approxQuantile("doc_id", [i / runs for i in range(1, runs)], 0.2 / runs)), reverse=True) if runs > 1 else []
    # Run 0 has the largest ids; an id equal to a bound belongs to the run after it.
    run = F.when(F.col("doc_id").isNull(), len(bounds))
    run = run.otherwise(F.aggregate(F.array(*[F.lit(int(b)) for b in bounds]), F.lit(0), lambda n, b: n + (F.col("doc_id") <= b).cast("int"))) if bounds else F.lit(0)
    named = docs.withColumn("_run", run)
    first = {r["_run"]: r["top"] for r in named.groupBy("_run").agg(F.max("doc_id").alias("top")).collect()}
    present = sorted(first)
    lent = F.create_map(*[F.lit(x) for i, r in enumerate(present) for x in (r, present[i - 1])]) if present else None
    if lent is None:
        return _described(named.withColumn("_ahead", F.lit(0)), params, 1)
    top = F.create_map(*[F.lit(x) for r in present for x in (r, first[r])]) if any(v is not None for v in first.values()) else F.create_map(F.lit(-1), F.lit(0))
    heads = F.element_at(top, F.col("_run"))
    copies = F.when(F.col("doc_id").eqNullSafe(heads), F.array(
        F.struct(F.col("_run").alias("_run"), F.lit(0).alias("_ahead")),
        F.struct(F.element_at(lent, F.col("_run")).alias("_run"), F.lit(1).alias("_ahead")))).otherwise(
        F.array(F.struct(F.col("_run").alias("_run"), F.lit(0).alias("_ahead"))))
    dealt = named.select("doc_id", "text", F.explode(copies).alias("_c")).select("doc_id", "text", "_c._run", "_c._ahead")
    return _described(dealt, params, len(present))


def _described(dealt: DataFrame, params: SyncmerParams, runs: int) -> DataFrame:
    ordered = dealt.repartitionById(runs, F.col("_run")).sortWithinPartitions("_run", "_ahead", F.col("doc_id").desc_nulls_last(), "text")
    return ordered.select("_run", "_ahead", "doc_id", "text").mapInPandas(
        lambda batches: _rows(batches, params),
        "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
