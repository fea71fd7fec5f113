"""Sharding by a permutation-filled lookup table (consistent hashing with even load).

Every shard walks its own permutation of the slots of a prime-sized table, and shards
take turns: each turn a shard claims the first slot of its walk that is still free. The
table is filled once on the driver; its size is a parameter, so broadcasting it is
bounded however large the data are. Placing a row is one hash and one lookup. When a
shard leaves, its slots are refilled and few others move.

A weighted shard takes that many turns a round. A key with many rows would follow its
one slot; ``place`` can spread named keys over several virtual keys by a second column.
A null key has a slot like any other value. No row moves for placement.
"""

from __future__ import annotations

import hashlib
from collections.abc import Mapping, Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

TABLE_SIZE = 65_537
"""Slots; a prime at least a hundred times the number of shards keeps loads within a percent or so."""


def _walk(shard: str, size: int) -> tuple[int, int]:
    digest = hashlib.sha256(shard.encode()).digest()
    return int.from_bytes(digest[:8], "big") % size, int.from_bytes(digest[8:16], "big") % (size - 1) + 1


def is_prime(n: int) -> bool:
    return n > 1 and all(n % d for d in range(2, int(n**0.5) + 1))


def fill_table(shards: Sequence[str], size: int = TABLE_SIZE, weights: Mapping[str, int] | None = None) -> np.ndarray:
    """For every slot the index of its shard in ``shards``."""
    if len(set(shards)) != len(shards) or not shards:
        raise ValueError("shards must be distinct, and at least one")
    if not is_prime(size) or size < len(shards):
        raise ValueError(f"the table size must be a prime of at least {len(shards)}")
    walks = [(first + step * np.arange(size, dtype=np.int64)) % size for first, step in (_walk(s, size) for s in shards)]
    turns = [max(1, int((weights or {}).get(s, 1))) for s in shards]
    at, table, free = [0] * len(shards), np.full(size, -1, np.int32), size
    while True:
        for i, walk in enumerate(walks):
            for _ in range(turns[i]):
                while table[walk[at[i]]] >= 0:
                    at[i] += 1
                table[walk[at[i]]] = i
                free -= 1
                if not free:
                    return table


def table_frame(spark: SparkSession, shards: Sequence[str], table: np.ndarray) -> DataFrame:
    """``_slot, shard``: one row per slot."""
    return spark.createDataFrame([(i, shards[s]) for i, s in enumerate(table.tolist())], "_slot int, shard string")


def slot_of(key: Column, size: int) -> Column:
    """The slot of a key: the first 52 bits of its MD5 modulo the table size; a null hashes as ``~``."""
    digest = F.md5(F.coalesce(key.cast("string"), F.lit("~")))
    return (F.conv(F.substring(digest, 1, 13), 16, 10).cast("long") % F.lit(size)).cast("int")


def place(df: DataFrame, key: str, shards: Sequence[str], table: np.ndarray, hot: Mapping[str, int] | None = None, spread_by: str | None = None) -> DataFrame:
    """Add ``slot`` and ``shard``. ``hot`` names key values and over how many virtual keys each is spread by ``spread_by``."""
    value = F.col(key).cast("string")
    if hot:
        ways = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in hot.items() for x in kv]), value), F.lit(1))
        part = F.pmod(F.xxhash64(spread_by), ways)
        value = F.when(ways > 1, F.concat_ws("#", value, part.cast("string"))).otherwise(value)
    slots = F.broadcast(table_frame(df.sparkSession, shards, table))
    placed = df.withColumn("slot", slot_of(value, len(table)))
    return placed.join(slots, placed["slot"] == slots["_slot"], "left").drop("_slot")


def write_shards(placed: DataFrame, folder: str, files_per_shard: int = 8) -> None:
    """Parquet with a folder per shard, each shard dealt over several tasks by slot."""
    dealt = placed.repartition("shard", F.col("slot") % files_per_shard)
    dealt.write.mode("overwrite").partitionBy("shard").parquet(folder)
