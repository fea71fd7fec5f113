"""What the operators of this subpackage share: joins to small tables, shared folders, file access in tasks."""

from __future__ import annotations

import os
import uuid
from collections.abc import Sequence
from functools import reduce
from urllib.parse import urlsplit

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sitewise.session import checkpointed, ensure_checkpoint_dir

BROADCAST_ROWS = 20_000
"""A lookup table is sent to every executor only when it is counted to hold at most this many rows."""


def lookup_join(big: DataFrame, small: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Left join of ``big`` to a table with one row per key; null keys match each other.

    The table is written and counted first. Up to ``BROADCAST_ROWS`` rows it is
    broadcast, so a key with a third of all rows stays spread out; above that both
    sides are shuffled and adaptive execution splits the partitions of hot keys.
    """
    small = checkpointed(small)
    renamed = small.select(*[F.col(k).alias(f"_key_{i}") for i, k in enumerate(keys)], *[c for c in small.columns if c not in keys])
    if small.count() <= BROADCAST_ROWS:
        renamed = F.broadcast(renamed)
    on = reduce(lambda a, b: a & b, [big[k].eqNullSafe(renamed[f"_key_{i}"]) for i, k in enumerate(keys)])
    return big.join(renamed, on, "left").drop(*[f"_key_{i}" for i in range(len(keys))])


def scratch_folder(spark: SparkSession, name: str) -> str:
    """A new folder under the shared checkpoint folder, named so that no two runs meet."""
    return f"{ensure_checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"


class SharedFiles:
    """Files of a shared folder, opened inside tasks: local or mounted paths directly, other stores through Arrow."""

    def __init__(self, folder: str):
        parts = urlsplit(folder)
        self.local = parts.scheme in ("", "file")
        if self.local:
            self.root = parts.path
        else:
            from pyarrow import fs

            self.store, self.root = fs.FileSystem.from_uri(folder)

    def read(self, name: str):
        path = f"{self.root}/{name}"
        return open(path, "rb") if self.local else self.store.open_input_file(path)

    def write(self, name: str):
        """A file that appears under its name only when it is closed without an error.

        A task that dies leaves nothing under the name, and a task that runs again
        puts the same bytes there.
        """
        return _Replacing(self, name)


class _Replacing:
    def __init__(self, files: SharedFiles, name: str):
        self.files, self.path = files, f"{files.root}/{name}"
        self.own = f"{self.path}.{uuid.uuid4().hex}.part"

    def __enter__(self):
        if self.files.local:
            os.makedirs(os.path.dirname(self.path), exist_ok=True)
            self.out = open(self.own, "wb")
        else:
            self.files.store.create_dir(os.path.dirname(self.path), recursive=True)
            self.out = self.files.store.open_output_stream(self.own)
        return self.out

    def __exit__(self, kind, *_):
        self.out.close()
        if self.files.local:
            os.unlink(self.own) if kind else os.replace(self.own, self.path)
        elif kind:
            self.files.store.delete_file(self.own)
        else:
            self.files.store.move(self.own, self.path)
