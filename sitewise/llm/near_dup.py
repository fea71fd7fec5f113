"""Near-duplicate groups by an LSH forest over MinHash signatures.

Each document becomes the set of its distinct word shingles. Documents with equal sets
form a class. A class has several *trees*: each tree is the list of all classes sorted by
a few MinHash values of its own. In sorted order the neighbours of a class are those with
the longest common prefix, so looking at the ``window`` rows before it adapts the depth to
the region: where few share a short prefix all of them are met, where many do only those
of longer prefixes. Prefixes of at least ``least_depth`` values count. A 256-bit sketch
travels with each row, and a pair whose sketches differ more than a pair at the threshold
would (six standard deviations) is not a candidate.

A region, the rows of a tree with a common prefix of ``least_depth``, may hold more rows
than a window sees. There a row takes only its nearest neighbours, and the region as a
whole is handed on: any two of its classes are candidates, too.

Candidates are confirmed on full sets, in groups: ``token_groups.link_classes`` puts
classes with common candidates into groups of bounded size, counts intersections as
products of small 0/1 matrices, and between groups opens only those that could still join
two components. So pairs inside a group are never made, a single link to one member of a
large group is found like any other, and what grows with the square of a region's size is
its number of groups. Groups of duplicates are connected components.

Rows are range partitioned by whole sort keys, so no prefix or group, however many
share it, meets in one task. The rows at both ends of each part are matched once more
across the boundary.

Two documents at the threshold share a prefix of ``d`` values in one of ``t`` trees with
probability ``1 - (1 - 0.8 ** d) ** t``: 0.9999994 for 20 trees and depth 3, in full
regions too.

Words are runs of bytes other than the six ASCII blanks, A-Z lower-cased. A text with
fewer words than a shingle is one shingle; null or empty text has none and is linked with
nothing, as is a row without an id, whose component is null. Repeated rows share their
group. Rows that share a ``doc_id`` but not their text are linked by their own texts each.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sitewise.llm.shingles import chunks, shingle_sets
from sitewise.llm.token_groups import JoinParams, _roots, link_classes, named_components
from sitewise.session import checkpointed

PIECES = 8  # MinHash values in a tree's key, 16 bits of each
BITS = 256
CHUNK = 2048
IN_FULL = 2  # neighbours before a row that it takes in a full region


@dataclass(frozen=True)
class NearDupParams:
    words: int = 5
    similarity: float = 0.8
    trees: int = 20
    least_depth: int = 3
    window: int = 16
    rows_per_part: int = 100_000

    @property
    def most_differing(self) -> int:
        p = (1 - self.similarity) / 2
        return int(BITS * p + 6 * (BITS * p * (1 - p)) ** 0.5)

    @property
    def region_shift(self) -> int:
        """Bits of a key's first long that are not part of the least prefix."""
        return 16 * (4 - self.least_depth)


def _multipliers() -> tuple[np.ndarray, np.ndarray]:
    raw = np.random.default_rng(20240501).integers(0, 1 << 32, (2, BITS), np.uint64).astype(np.uint32)
    return raw[0] | np.uint32(1), raw[1]


def signature(shingles: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    h, least = shingles.astype(np.uint32), np.full(len(a), 0xFFFFFFFF, np.uint32)
    for at in range(0, len(h), CHUNK):
        least = np.minimum(least, (h[at:at + CHUNK] * a[:, None] + b[:, None]).min(1))
    least ^= least >> np.uint32(16)
    least *= np.uint32(0x7FEB352D)
    return least ^ (least >> np.uint32(15))


def _signed(batches: Iterator[pd.DataFrame], params: NearDupParams) -> Iterator[pd.DataFrame]:
    (a, b), used = _multipliers(), params.trees * PIECES
    shifts = np.array([48, 32, 16, 0], np.uint64)
    for batch in batches:
        texts = batch["text"].tolist()
        for start, end in chunks(texts):
            out = []
            for s in shingle_sets(texts[start:end], params.words):
                if not len(s):
                    out.append((0, None, None, None, None))
                    continue
                whole = np.frombuffer(hashlib.blake2b(s.tobytes(), digest_size=16).digest(), np.int64)
                v = signature(s, a, b)
                pieces = (v[:used].astype(np.uint64) & np.uint64(0xFFFF)).reshape(-1, 4)
                keys = (pieces << shifts).sum(1, dtype=np.uint64).view(np.int64)
                bits = np.packbits(v >> np.uint32(31)).view(np.int64)
                out.append((len(s), int(whole[0]), int(whole[1]), keys, bits))
            frame = pd.DataFrame(out, columns=["n_shingles", "_c0", "_c1", "_keys", "_bits"], dtype=object)
            frame[["n_shingles", "_c0", "_c1"]] = frame[["n_shingles", "_c0", "_c1"]].astype("Int64")
            yield pd.concat([batch[["doc_id"]].iloc[start:end].astype("Int64").reset_index(drop=True), frame], axis=1)


def signatures(docs: DataFrame, params: NearDupParams) -> DataFrame:
    """``doc_id, n_shingles``, the class (two longs), tree keys and sketch of every document."""
    return docs.select(F.col("doc_id").cast("decimal(20,0)").alias("doc_id"), F.col("text").cast("binary").alias("text")).mapInPandas(
        lambda batches: _signed(batches, params), "doc_id long, n_shingles long, _c0 long, _c1 long, _keys array<long>, _bits array<long>")


_ROW = ["tree", "k0", "k1", "id", "b0", "b1", "b2", "b3"]
_ORDER = ["a", "b", "differ", "part", "head", *_ROW]
_FOUND = "a long, b long, differ int, part int, head boolean, " + ", ".join(f"{c} {'int' if c == 'tree' else 'long'}" for c in _ROW)


def _pairs(rows: pd.DataFrame, first_new: int, params: NearDupParams) -> pd.DataFrame:
    """Candidates among sorted rows, of which at least the later one is at or after ``first_new``.

    Rows that are candidates of each other, directly or through others, are returned as one
    set: a row per member, ``a`` the first of them, ``b`` the member, ``differ`` the tree. Rows
    of a region that is seen to be full take only their nearest neighbours.
    """
    tree, k0 = rows["tree"].to_numpy(np.int64), rows["k0"].to_numpy(np.int64).view(np.uint64)
    region = k0 >> np.uint64(params.region_shift)
    ids, bits = rows["id"].to_numpy(np.int64), rows[["b0", "b1", "b2", "b3"]].to_numpy(np.int64).view(np.uint64)
    found = []
    turns = np.flatnonzero(np.r_[True, (tree[1:] != tree[:-1]) | (region[1:] != region[:-1]), True])
    reach = np.where(np.repeat(np.diff(turns), np.diff(turns)) > params.window + 1, IN_FULL, params.window)
    for step in range(1, min(params.window, len(rows) - 1) + 1):
        at = np.flatnonzero((region[step:] == region[:-step]) & (tree[step:] == tree[:-step]))
        if not len(at):
            break
        at = at[(at + step >= first_new) & (reach[at] >= step)]
        apart = np.bitwise_count(bits[at] ^ bits[at + step]).sum(1, dtype=np.int32)
        near = (apart <= params.most_differing) & (ids[at] != ids[at + step])
        found.append((at[near], at[near] + step))
    x, y = (np.concatenate([np.zeros(0, np.int64), *side]) for side in (zip(*found) if found else ((), ())))
    member = np.unique(np.concatenate([x, y]))
    return pd.DataFrame({"a": ids[_roots(len(rows), x, y)[member]], "b": ids[member], "differ": tree[member]})


def _runs(batch: pd.DataFrame, params: NearDupParams) -> pd.DataFrame:
    """Rows (``k1``) of each region (``tree, k0``) that a window does not see whole, or that may go on in another batch."""
    tree, region = batch["tree"].to_numpy(np.int64), batch["k0"].to_numpy(np.int64).view(np.uint64) >> np.uint64(params.region_shift)
    starts = np.flatnonzero(np.r_[True, (tree[1:] != tree[:-1]) | (region[1:] != region[:-1])])
    length = np.diff(np.r_[starts, len(batch)])
    wanted = length > params.window + 1
    wanted[[0, -1]] = True
    return pd.DataFrame({"tree": tree[starts], "k0": region[starts].view(np.int64), "k1": length})[wanted]


def _swept(batches: Iterator[pd.DataFrame], params: NearDupParams) -> Iterator[pd.DataFrame]:
    part, tail, head_left = TaskContext.get().partitionId(), None, params.window
    for batch in batches:
        if not len(batch):
            continue
        yield _runs(batch, params).assign(a=0, b=0, differ=0, part=-2, head=False, id=0, b0=0, b1=0, b2=0, b3=0)[_ORDER]
        if head_left:
            head = batch.head(head_left)
            head_left -= len(head)
            yield _ends(head, part, True)
        rows = batch if tail is None else pd.concat([tail, batch], ignore_index=True)
        found = _pairs(rows, 0 if tail is None else len(tail), params)
        yield found.assign(part=-1, head=False, **{c: 0 for c in _ROW})[_ORDER]
        tail = rows.tail(params.window).reset_index(drop=True)
    if tail is not None:
        yield _ends(tail, part, False)


def _ends(rows: pd.DataFrame, part: int, head: bool) -> pd.DataFrame:
    return rows.assign(a=0, b=0, differ=0, part=part, head=head)[_ORDER]


def _across(rows: pd.DataFrame, params: NearDupParams) -> pd.DataFrame:
    before, after = rows[~rows["head"]].sort_values(_ROW[:4]), rows[rows["head"]].sort_values(_ROW[:4])
    return _pairs(pd.concat([before, after], ignore_index=True), len(before), params)[["a", "b", "differ"]]


def _tree_rows(classes: DataFrame, params: NearDupParams, *more: str) -> DataFrame:
    return classes.select("id", "_bits", *more, F.posexplode(F.transform(
        F.sequence(F.lit(0), F.lit(params.trees - 1)), lambda t: F.struct(F.get("_keys", 2 * t).alias("k0"), F.get("_keys", 2 * t + 1).alias("k1")))).alias("tree", "_k")) \
        .select("tree", "_k.k0", "_k.k1", "id", *[F.get("_bits", i).alias(f"b{i}") for i in range(4)], *more)


def candidates(classes: DataFrame, params: NearDupParams) -> tuple[DataFrame, DataFrame]:
    """Sets of candidates, ``tree, a, b`` with ``a`` their first and ``b`` each member's ``id``; and the full regions, ``tree, region``.

    A full region has more rows than a window sees from each of them.
    """
    rows = _tree_rows(classes, params)
    parts = max(1, classes.count() * params.trees // params.rows_per_part)
    # Unsigned order is not needed: any order in which equal prefixes stand together will do.
    ordered = rows.repartitionByRange(parts, "tree", "k0", "k1", "id").sortWithinPartitions("tree", "k0", "k1", "id")
    swept = checkpointed(ordered.mapInPandas(lambda batches: _swept(batches, params), _FOUND))
    # One number per part, as many as there are tasks.
    present = sorted(r["part"] for r in swept.where("part >= 0").select("part").distinct().collect())
    pairs = swept.where("part = -1").select("a", "b", "differ")
    full = swept.where("part = -2").groupBy("tree", F.col("k0").alias("region")).agg(F.sum("k1").alias("_n")).where(F.col("_n") > params.window + 1)
    if len(present) > 1:
        before = F.create_map(*[F.lit(x) for p, q in zip(present, present[1:]) for x in (q, p)])
        ends = swept.where("part >= 0").withColumn("part", F.when(F.col("head"), F.try_element_at(before, F.col("part"))).otherwise(F.col("part")))
        pairs = pairs.unionAll(ends.where("part is not null").select("part", "head", *_ROW).groupBy("part").applyInPandas(
            lambda rows: _across(rows, params), "a long, b long, differ int"))
    return pairs.select(F.col("differ").alias("tree"), "a", "b").distinct(), full.select("tree", "region")


def near_duplicates(docs: DataFrame, params: NearDupParams = NearDupParams()) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` for every row of ``docs`` (``doc_id``, ``text``)."""
    signed = checkpointed(signatures(docs, params))
    one = signed.where("doc_id is not null and _c0 is not null").groupBy("_c0", "_c1").agg(F.min(F.struct("doc_id", "_keys", "_bits", "n_shingles")).alias("_m"))
    classes = checkpointed(one.select("_c0", "_c1", F.monotonically_increasing_id().alias("id"), F.col("_m.doc_id").alias("_least"), "_m._keys", "_m._bits",
                                      F.col("_m.n_shingles").alias("_n")))
    near, full = candidates(classes, params)
    near = near.select(F.xxhash64(F.lit("near"), "tree", "a").alias("print"), F.col("b").alias("cid"))
    placed = classes.select(F.col("id").alias("cid"), F.posexplode(F.transform(
        F.sequence(F.lit(0), F.lit(params.trees - 1)), lambda t: F.shiftrightunsigned(F.get("_keys", 2 * t), params.region_shift))).alias("tree", "region"))
    whole = placed.join(full, ["tree", "region"]).select(F.xxhash64(F.lit("region"), "tree", "region").alias("print"), "cid")
    held = checkpointed(near.unionAll(whole))
    narrow = classes.select("_c0", "_c1", F.col("id").alias("cid"), "_least", F.get("_keys", 0).alias("_m1"), F.get("_keys", 1).alias("_m2"), "_n")
    linked = link_classes(docs, narrow, held, JoinParams(words=params.words, percent=round(100 * params.similarity), rows_per_part=params.rows_per_part))
    named = named_components(signed, narrow, linked)
    return named.withColumn("kept", F.col("doc_id").isNull() | (F.col("component_id") == F.col("doc_id")))
