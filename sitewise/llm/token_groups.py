"""Exact Jaccard join of shingle sets with a token-group matrix.

Documents with equal sets form a class. Classes that may have a partner are partitioned
into groups of similar sets, and a group is stored with the union of its members' tokens:
a row of the token-group matrix. A set that reaches the similarity ``t`` with a member of
a group has at least ``t`` times its own size in common with the group's union, so one
look at the union bounds the overlap with all members. Only groups that reach the bound
are opened, and their members' intersections are counted as one product of two small
0/1 matrices.

*Which classes may have a partner.* Sizes fall in levels that grow by ``1 / t``, so two
linked sets lie in one level or in neighbouring ones. For a level, two linked sets differ
in at most ``d`` tokens. Tokens are dealt by hash into ``d + 1`` segments and one or two
more; each token that differs spoils one segment, so at least the others are alike. A
class has a fingerprint per segment that is not empty, in the scheme of its own level and,
if it is small enough to have partners there, of the one below. Should so many of its segments be empty that the alike ones could all
be, the tokens of its prefix (the smallest hashes, one of which linked sets share) are
fingerprints too; its partner is then in the same case. So linked sets share a fingerprint
always, while a passage that many documents have in common makes none by itself.

*Groups.* Each class that shares a fingerprint takes the smallest class it shares one with
as its hub, and that one's hub in turn. Classes are range-sorted by hub and two MinHash
values, and neighbours with one hub become a group, up to ``members`` classes or
``tokens`` tokens. A larger family spreads over many groups and tasks. Links inside a
group are found where it is built.

*Between groups.* A pair of groups is a candidate when they share a fingerprint; the queries
are those members of one group that hold it. First each group meets only the smallest
group of every fingerprint, which joins a family of close copies in steps linear in its
groups. Then, with components known, every pair of groups that shares a fingerprint whose
holders are not all of one component meets. No pair of documents is ever a row; rows of
this step grow with the square of the number of *groups* of a family that does not hang
together, 1 / members ** 2 of its pairs.

Words are runs of bytes other than the six ASCII blanks, A-Z lower-cased. A text with
fewer words than a shingle is one shingle; null or empty text has none and is linked with
nothing, as is a row without an id, whose component is null. Tokens are 64-bit hashes of
shingles. Rows that share a ``doc_id`` are linked by their own texts each, and then by
their id in so far as a component's name is its smallest id. Repeated rows share their
class. A text of any length is one row; its set is held in one task. No rows: no rows.
Only ``doc_id`` and ``text`` are read, so other columns cannot clash.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitewise.llm.shingles import chunks, mix, shingle_sets
from sitewise.operators.groups import connected_components
from sitewise.session import checkpointed

_SMALL_LEVEL = 64
BROADCAST_PRINTS = 2_000_000
"""Fingerprints that several classes hold are broadcast, 8 bytes each, only if they are counted to be no more."""
BROADCAST_CLASSES = 100_000
"""Classes that may have a partner, and pairs of groups, are broadcast, 40 bytes each, only if they are counted to be no more."""
_GOLDEN = 0x9E3779B97F4A7C15
_MASK = (1 << 64) - 1


@dataclass(frozen=True)
class JoinParams:
    words: int = 4
    percent: int = 85
    members: int = 256  # at most; a mask has that many bits
    tokens: int = 1 << 15
    rows_per_part: int = 100_000


@cache
def _levels(percent: int) -> np.ndarray:
    """Smallest sizes of the levels."""
    found = [1]
    while found[-1] < 1 << 40:
        found.append(100 * found[-1] // percent + 1)
    return np.array(found, np.int64)


def _schemes(percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Per level: how many tokens the smaller of two linked sets lets them differ in, and the number of segments (none if 0)."""
    first = _levels(percent)
    differ = (100 - percent) * (first[1:] - 1) // percent
    return differ, np.where(differ > 0, differ + np.where(first[:-1] < _SMALL_LEVEL, 2, 4 + 15 * differ // 100), 0)


def _salted(tokens: np.ndarray, salt: int) -> np.ndarray:
    return mix(tokens ^ np.uint64(salt * _GOLDEN & _MASK))


def fingerprints(sets: list[np.ndarray], percent: int) -> list[np.ndarray]:
    """Fingerprints of sorted sets, of which any two linked sets that are not equal share one."""
    sizes = np.array([len(s) for s in sets], np.int64)
    flat = np.concatenate([np.zeros(0, np.uint64), *sets])
    first, (differ, segments) = _levels(percent), _schemes(percent)
    own = np.searchsorted(first, sizes, side="right") - 1
    place, value = _salted(flat, 1) >> np.uint64(32), _salted(flat, 2)
    of_set, found, owner = np.repeat(np.arange(len(sets)), sizes), [], []
    # A set has partners in the level below only if its size times the similarity is below its level.
    for level, here in ((own, sizes > 0), (own - 1, (own > 0) & (percent * sizes <= 100 * (first[np.maximum(own, 0)] - 1)))):
        k = np.where(here, segments[np.maximum(level, 0)], 0)
        start = k.cumsum() - k
        used = np.repeat(k > 0, sizes)
        whose = of_set[used]
        segment = (place[used] * k[whose].astype(np.uint64)) >> np.uint64(32)
        at = start[whose] + segment.astype(np.int64)
        sums = np.zeros(k.sum(), np.uint64)
        np.add.at(sums, at, value[used])
        least = np.where(first[np.maximum(level, 0)] < _SMALL_LEVEL, 1, 2)
        full = np.bincount(at, minlength=len(sums)) >= np.repeat(least, k)
        set_of, number = np.repeat(np.arange(len(sets)), k), np.arange(len(sums)) - np.repeat(start, k)
        salt = mix(np.repeat(level, k).astype(np.uint64) * np.uint64(_GOLDEN) + number.astype(np.uint64))
        found.append(mix(sums ^ salt)[full])
        owner.append(set_of[full])
        # Alike segments could all be short: the prefix stands in for them.
        short = k - np.bincount(set_of[full], minlength=len(sets))
        for i in np.flatnonzero((k > 0) & (short >= k - differ[np.maximum(level, 0)])):
            prefix = int(sizes[i]) - -(-percent * int(sizes[i]) // 100) + 1
            found.append(_salted(sets[i][:prefix], 1003 + int(level[i])))
            owner.append(np.full(prefix, i))
    prints, owners = np.concatenate(found), np.concatenate(owner)
    order = np.argsort(owners, kind="stable")
    return np.split(prints[order], np.bincount(owners, minlength=len(sets)).cumsum()[:-1]) if len(sets) else []


_SIGNED = "doc_id long, n_shingles long, _c0 long, _c1 long, _m1 long, _m2 long"


def _digest(tokens: np.ndarray) -> np.ndarray:
    return np.frombuffer(hashlib.blake2b(tokens.tobytes(), digest_size=16).digest(), np.int64)


def _signed(batches: Iterator[pd.DataFrame], params: JoinParams) -> Iterator[pd.DataFrame]:
    for batch in batches:
        texts = batch["text"].tolist()
        for start, end in chunks(texts):
            sets = shingle_sets(texts[start:end], params.words)
            full = np.flatnonzero([len(s) > 0 for s in sets])
            frame = pd.DataFrame({"doc_id": batch["doc_id"].iloc[start:end].astype("Int64").to_numpy(), "n_shingles": [len(s) for s in sets]})
            begins = np.cumsum([0, *[len(sets[i]) for i in full]])[:-1]
            flat = np.concatenate([np.zeros(0, np.uint64), *sets])
            whole = np.array([_digest(sets[i]) for i in full]).reshape(-1, 2)
            columns = [whole[:, 0], whole[:, 1]] + [np.minimum.reduceat(_salted(flat, salt), begins).view(np.int64) if len(full) else [] for salt in (-1, -2)]
            for name, values in zip(("_c0", "_c1", "_m1", "_m2"), columns):
                frame[name] = pd.Series(values, index=full, dtype="Int64")
            yield frame


def _binary(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("decimal(20,0)").alias("doc_id"), F.col("text").cast("binary").alias("text"))


def signatures(docs: DataFrame, params: JoinParams) -> DataFrame:
    """Set size, class (two longs) and two MinHash values of every row; null without a set."""
    return _binary(docs).mapInPandas(lambda b: _signed(b, params), _SIGNED)


def _printed(batches: Iterator[pd.DataFrame], params: JoinParams) -> Iterator[pd.DataFrame]:
    for batch in batches:
        texts = batch["text"].tolist()
        for start, end in chunks(texts):
            sets = [s for s in shingle_sets(texts[start:end], params.words) if len(s)]
            prints = fingerprints(sets, params.percent)
            yield pd.DataFrame({"_c0": [int(_digest(s)[0]) for s in sets], "_prints": [p.view(np.int64) for p in prints]})


def printed(docs: DataFrame, params: JoinParams) -> DataFrame:
    """``_c0, print``: one long of the class and a fingerprint of every row with an id."""
    rows = _binary(docs).where("doc_id is not null and text is not null").select("text")
    return rows.mapInPandas(lambda b: _printed(b, params), "_c0 long, _prints array<long>").select("_c0", F.explode("_prints").alias("print"))


def _dealt(batches: Iterator[pd.DataFrame], params: JoinParams) -> Iterator[pd.DataFrame]:
    """Group of each class in sorted order; a group is named by its first class."""
    name, value, members, tokens = None, None, 0, 0
    for batch in batches:
        groups = []
        for cid, hub, n in zip(batch["cid"], batch["hub"], batch["_n"]):
            if name is None or hub != value or members >= params.members or tokens + n > params.tokens:
                name, value, members, tokens = cid, hub, 0, 0
            members, tokens = members + 1, tokens + n
            groups.append(name)
        yield batch.assign(g=groups)[["cid", "g", "_c0", "_c1", "_least"]]


def _sets(batches: Iterator[pd.DataFrame], params: JoinParams) -> Iterator[pd.DataFrame]:
    """The sets of the wanted classes, each once in a task; what it remembers grows with the classes that it has read."""
    seen: set[int] = set()
    for batch in batches:
        texts = batch["text"].tolist()
        for start, end in chunks(texts):
            rows, part = [], batch.iloc[start:end]
            for s, g, cid, c0, c1 in zip(shingle_sets(texts[start:end], params.words), part["g"], part["cid"], part["_c0"], part["_c1"]):
                # Rows that share an id may hold other texts than the class's.
                if cid not in seen and tuple(_digest(s)) == (c0, c1):
                    seen.add(cid)
                    rows.append((g, cid, s.tobytes()))
            yield pd.DataFrame(rows, columns=["g", "cid", "tokens"])


@dataclass
class Block:
    """A group: its row of the matrix, the sorted union of tokens, and where each member's tokens stand in it."""

    cids: np.ndarray
    ends: np.ndarray
    places: np.ndarray
    union: np.ndarray

    @property
    def sizes(self) -> np.ndarray:
        return np.diff(self.ends, prepend=0)

    @property
    def owners(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.cids)), self.sizes)


def _matrix(block: Block, column: np.ndarray, many: int, kept: np.ndarray) -> np.ndarray:
    """0/1 rows of the ``kept`` members over ``many`` columns; ``column`` is a union token's column or -1."""
    row = np.full(len(block.cids), -1)
    row[kept] = np.arange(len(kept))
    at, whose = column[block.places], row[block.owners]
    here = (at >= 0) & (whose >= 0)
    out = np.zeros((len(kept), many), np.float32)  # counts below 2 ** 24 are exact
    out[whose[here], at[here]] = 1
    return out


def _overlap(block: Block, shared: np.ndarray) -> np.ndarray:
    """How many tokens of each member lie in the other union: the bound of its intersection with any set there."""
    return np.bincount(block.owners, shared[block.places], len(block.cids)).astype(np.int64)


COLUMNS = 1 << 16


def linked_members(x: Block, y: Block, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions of all linked members of two groups; groups that miss the bound are not opened."""
    none = np.zeros(0, np.int64)
    shared, in_x, in_y = np.intersect1d(x.union, y.union, assume_unique=True, return_indices=True)
    columns = []
    for block, at in ((x, in_x), (y, in_y)):
        column = np.full(len(block.union), -1)
        column[at] = np.arange(len(shared))
        columns.append(column)
    queries = np.flatnonzero(100 * _overlap(x, columns[0] >= 0) >= percent * x.sizes)
    if not len(queries):
        return none, none
    targets = np.flatnonzero(100 * _overlap(y, columns[1] >= 0) >= percent * y.sizes)
    if not len(targets):
        return none, none
    both = np.zeros((len(queries), len(targets)), np.int64)
    for at in range(0, len(shared), COLUMNS):
        some = [np.where((c >= at) & (c < at + COLUMNS), c - at, -1) for c in columns]
        many = min(COLUMNS, len(shared) - at)
        both += (_matrix(x, some[0], many, queries) @ _matrix(y, some[1], many, targets).T).astype(np.int64)
    either = x.sizes[queries][:, None] + y.sizes[targets][None, :] - both
    a, b = np.nonzero((both > 0) & (100 * both >= percent * either))
    return queries[a], targets[b]


def _roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest position of each of ``n`` members' components."""
    low = np.arange(n)
    while True:
        now = low.copy()
        np.minimum.at(now, a, low[b])
        np.minimum.at(now, b, low[a])
        now = now[now]
        if (now == low).all():
            return low
        low = now


_HELD = ["cids", "roots", "ends", "places", "matrix_row"]
_BLOCK = "g long, cids array<long>, roots array<long>, ends array<int>, places binary, matrix_row binary"


def _places_type(union: int) -> type:
    return np.uint16 if union <= 1 << 16 else np.uint32


def _blocks(batches: Iterator[pd.DataFrame], params: JoinParams) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for g, members in zip(batch["g"], batch["members"]):
            sets = {int(m["cid"]): np.frombuffer(m["tokens"], np.uint64) for m in members}  # repeated rows give one
            cids = np.array(sorted(sets), np.int64)
            union, places = np.unique(np.concatenate([sets[int(c)] for c in cids]), return_inverse=True)
            block = Block(cids, np.array([len(sets[int(c)]) for c in cids]).cumsum(), places, union)
            roots = cids
            if len(cids) > 1:
                roots = cids[_roots(len(cids), *linked_members(block, block, params.percent))]
            yield pd.DataFrame({"g": [g], "cids": [cids], "roots": [roots], "ends": [block.ends.astype(np.int32)],
                                "places": [places.astype(_places_type(len(union))).tobytes()], "matrix_row": [union.tobytes()]})


_MASKS = [f"m{i}" for i in range(4)]


def _block(roots, ends, places, matrix_row) -> Block:
    union = np.frombuffer(matrix_row, np.uint64)
    return Block(np.asarray(roots), np.asarray(ends, np.int64), np.frombuffer(places, _places_type(len(union))), union)


def _queried(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The queries of each pair: of a group's members those with a bit in the masks."""
    for batch in batches:
        rows = []
        for row in batch.itertuples(index=False):
            block = _block(row.roots, row.ends, row.places, row.matrix_row)
            bits = np.unpackbits(np.array([row.m0, row.m1, row.m2, row.m3], "<i8").view(np.uint8), bitorder="little")[:len(block.cids)] > 0
            sizes = block.sizes
            rows.append((row.h, block.cids[bits], sizes[bits].cumsum().astype(np.int32), block.union[block.places[np.repeat(bits, sizes)]].tobytes()))
        yield pd.DataFrame(rows, columns=["h", "q_roots", "q_ends", "q_tokens"])


def _opened(batches: Iterator[pd.DataFrame], params: JoinParams) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for row in batch.itertuples(index=False):
            union, places = np.unique(np.frombuffer(row.q_tokens, np.uint64), return_inverse=True)
            x, y = Block(np.asarray(row.q_roots), np.asarray(row.q_ends, np.int64), places, union), _block(row.roots, row.ends, row.places, row.matrix_row)
            a, b = linked_members(x, y, params.percent)
            # Members of one root are connected already: one link per pair of roots is enough.
            pairs = np.unique(np.stack([x.cids[a], y.cids[b]], 1), axis=0)
            yield pd.DataFrame({"u": pairs[:, 0], "v": pairs[:, 1]})


def links_between(pairs: DataFrame, blocks: DataFrame, params: JoinParams) -> DataFrame:
    """``u, v``: linked roots of the queries of group ``g`` (masks ``m0`` to ``m3``) and the members of group ``h``."""
    held = blocks.select("g", "roots", "ends", "places", "matrix_row")
    few = F.broadcast if pairs.count() <= BROADCAST_CLASSES else lambda table: table
    queries = held.join(few(pairs), "g").mapInPandas(_queried, "h long, q_roots array<long>, q_ends array<int>, q_tokens binary")
    targets = held.withColumnRenamed("g", "h").join(few(pairs.select("h").distinct()), "h", "left_semi")
    rows = queries.join(targets, "h")
    return checkpointed(rows.mapInPandas(lambda b: _opened(b, params), "u long, v long").distinct())


def _mixed(held: DataFrame, label: DataFrame) -> DataFrame:
    """Fingerprints that several groups and several components hold: with each group's range of components and holders.

    Fingerprints held by the same groups are taken together as one; a family's groups have
    most of theirs in common. Should two different sets of groups hash alike, they are
    taken together too, which only makes more pairs.
    """
    each = held.join(label, "root").groupBy("print", "g").agg(
        F.min("component").alias("lo"), F.max("component").alias("hi"),
        *[F.bit_or(F.when(F.floor(F.col("pos") / 64) == i, F.expr("shiftleft(1L, pos % 64)")).otherwise(F.lit(0))).alias(m) for i, m in enumerate(_MASKS)])
    several = each.groupBy("print").agg(F.min("g").alias("_g0"), F.max("g").alias("_g1"), F.min("lo").alias("_lo"), F.max("hi").alias("_hi"),
                                        F.xxhash64(F.bit_xor(F.xxhash64("g")), F.count(F.lit(1))).alias("_same")) \
        .where("_g0 < _g1 and _lo < _hi").select("print", "_same", F.col("_g0").alias("first"))
    together = each.join(several, "print").groupBy(F.col("_same").alias("print"), "g").agg(
        F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.min("first").alias("first"), *[F.bit_or(m).alias(m) for m in _MASKS])
    return checkpointed(together)


_OTHER = [f"w{i}" for i in range(4)]


def _together(mixed: DataFrame, on: Column) -> DataFrame:
    """``g, h`` of groups that share a fingerprint and meet ``on``, with masks ``m`` and ``w`` of the holders in each."""
    x, y = mixed.alias("x"), mixed.alias("y")
    pairs = x.join(y, (F.col("x.print") == F.col("y.print")) & (F.col("x.g") > F.col("y.g")) & on)
    return checkpointed(pairs.groupBy(F.col("x.g").alias("g"), F.col("y.g").alias("h")).agg(
        *[F.bit_or(f"x.{m}").alias(m) for m in _MASKS], *[F.bit_or(f"y.{m}").alias(w) for m, w in zip(_MASKS, _OTHER)]))


def _queries_of(pairs: DataFrame) -> DataFrame:
    """``g, h, m0`` to ``m3``: the side with fewer holders asks."""
    many, other = (sum((F.bit_count(c) for c in names[1:]), F.bit_count(names[0])) for names in (_MASKS, _OTHER))
    swap = other < many
    return pairs.select(F.when(swap, F.col("h")).otherwise(F.col("g")).alias("g"), F.when(swap, F.col("g")).otherwise(F.col("h")).alias("h"),
                        *[F.when(swap, F.col(w)).otherwise(F.col(m)).alias(m) for m, w in zip(_MASKS, _OTHER)])


def grouped_blocks(docs: DataFrame, classes: DataFrame, held: DataFrame, params: JoinParams) -> DataFrame:
    """The classes in ``held`` in groups of similar sets, each a block of the matrix with links inside it found."""
    lowest = held.groupBy("print").agg(F.min("cid").alias("low"))
    hubs = checkpointed(held.join(lowest, "print").groupBy("cid").agg(F.min("low").alias("hub")))
    hubs = hubs.join(hubs.select(F.col("cid").alias("hub"), F.col("hub").alias("_next")), "hub").select("cid", F.col("_next").alias("hub"))
    likely = checkpointed(classes.join(hubs, "cid"))
    many = likely.count()
    order = ["hub", "_m1", "_m2", "cid"]
    sorted_rows = likely.repartitionByRange(max(1, many // params.rows_per_part), *order).sortWithinPartitions(*order)
    dealt = checkpointed(sorted_rows.mapInPandas(lambda b: _dealt(b, params), "cid long, g long, _c0 long, _c1 long, _least long"))
    wanted = dealt.withColumnRenamed("_least", "doc_id")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    found = texts.join(F.broadcast(wanted) if many <= BROADCAST_CLASSES else wanted, "doc_id").drop("doc_id")
    sets = found.mapInPandas(lambda b: _sets(b, params), "g long, cid long, tokens binary")
    grouped = sets.groupBy("g").agg(F.collect_list(F.struct("cid", "tokens")).alias("members"))
    return checkpointed(grouped.mapInPandas(lambda b: _blocks(b, params), _BLOCK))


def link_classes(docs: DataFrame, classes: DataFrame, held: DataFrame, params: JoinParams) -> DataFrame:
    """``cid, component`` of all classes in ``held`` (``print, cid``): components of links among classes that share a print.

    ``classes`` has ``cid``, its digest ``_c0, _c1``, the smallest id ``_least`` of its rows
    in ``docs``, two values ``_m1, _m2`` that tend to agree for similar sets, and its size ``_n``.
    Any two classes that share a print end up in one component if their sets are linked.
    """
    blocks = grouped_blocks(docs, classes, held, params)
    root = checkpointed(blocks.select("g", F.posexplode(F.arrays_zip(F.col("cids").alias("cid"), F.col("roots").alias("root"))).alias("pos", "_z"))
                        .select("g", "pos", "_z.cid", "_z.root"))
    held = checkpointed(held.join(root, "cid").select("print", "g", "pos", "root"))
    label = root.select("root", F.col("root").alias("component")).distinct()
    # Each group with the first group of its fingerprints, then whatever could still join two components.
    near = _together(_mixed(held, label), F.col("y.g") == F.col("x.first"))
    links = links_between(_queries_of(near), blocks, params)
    nodes = label.select(F.col("root").alias("node"))
    label = checkpointed(connected_components(nodes, links).withColumnRenamed("node", "root"))
    apart = ~((F.col("x.lo") == F.col("y.hi")) & (F.col("x.hi") == F.col("y.lo")))
    far = _together(_mixed(held, label), apart)
    # Pairs of groups all of whose holders have met need not meet again.
    met = near.select("g", "h", *[F.col(c).alias(f"_{c}") for c in (*_MASKS, *_OTHER)])
    new = " | ".join(f"({c} & ~coalesce(_{c}, 0L))" for c in (*_MASKS, *_OTHER))
    far = checkpointed(far.join(met, ["g", "h"], "left").where(f"({new}) <> 0").select(*far.columns))
    if not far.isEmpty():
        more = links_between(_queries_of(far), blocks, params)
        label = checkpointed(connected_components(nodes, links.unionAll(more)).withColumnRenamed("node", "root"))
    return root.join(label, "root").select("cid", "component")


def named_components(signed: DataFrame, classes: DataFrame, components: DataFrame) -> DataFrame:
    """Rows of ``signed`` (``doc_id, n_shingles, _c0, _c1``) with ``component_id``, the smallest id of their component."""
    of_class = classes.join(components, "cid", "left").withColumn("component", F.coalesce("component", "cid"))
    least = of_class.groupBy("component").agg(F.min("_least").alias("component_id"))
    named = of_class.join(least, "component").select("_c0", "_c1", "component_id")
    found = signed.select("doc_id", "n_shingles", "_c0", "_c1").join(named, ["_c0", "_c1"], "left")
    return found.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id")).alias("component_id"))


def shared_prints(docs: DataFrame, classes: DataFrame, params: JoinParams) -> DataFrame:
    """``print, cid`` of every fingerprint that several classes hold.

    One of the class's two longs tells classes apart here, so that the many unique
    fingerprints travel light. They are made twice: cheaper than keeping them.
    """
    shared = checkpointed(printed(docs, params).groupBy("print").agg(F.min("_c0").alias("_lo"), F.max("_c0").alias("_hi")).where("_lo < _hi").select("print"))
    few = F.broadcast if shared.count() <= BROADCAST_PRINTS else lambda table: table
    entries = printed(docs, params).join(few(shared), "print").distinct()
    return checkpointed(entries.join(classes.select("_c0", "cid"), "_c0").select("print", "cid"))


def join(docs: DataFrame, params: JoinParams = JoinParams()) -> DataFrame:
    """``doc_id, n_shingles, component_id`` of every row of ``docs`` (``doc_id``, ``text``)."""
    signed = checkpointed(signatures(docs, params))
    with_set = signed.where("doc_id is not null and _c0 is not null")
    classes = checkpointed(with_set.groupBy("_c0", "_c1").agg(F.min("doc_id").alias("_least"), F.min("_m1").alias("_m1"), F.min("_m2").alias("_m2"),
                                                             F.max("n_shingles").alias("_n")).withColumn("cid", F.monotonically_increasing_id()))
    return named_components(signed, classes, link_classes(docs, classes, shared_prints(docs, classes, params), params))
