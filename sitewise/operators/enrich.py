"""Compute once per distinct content key, keep the results, join them back.

The store is a folder of batches and a log. A batch is written to a folder of its own and
counts only once a new version of the log names it; a version is a small file that lists
the live batches and appears whole under its number. So a job that fails loses the batch
it was in and nothing before it, a folder that was left behind is never read, and a batch
that is tried again cannot put its keys there twice. One writer at a time: a second one
fails on the number of its version.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sitewise.functions.hashing import content_key
from sitewise.session import checkpointed

KEY = "content_sha256"


def distinct_keys(df: DataFrame, content: Column, name: str = "content") -> DataFrame:
    """Distinct contents with their SHA-256 key."""
    return df.select(content.alias(name)).where(F.col(name).isNotNull()).distinct() \
        .withColumn(KEY, content_key(F.col(name)))


class _Log:
    """Versions of the list of live batches, through the store's own file system."""

    def __init__(self, spark: SparkSession, store: str):
        self.path = spark._jvm.org.apache.hadoop.fs.Path
        self.root = f"{store}/_log"
        self.fs = self.path(store).getFileSystem(spark._jsc.hadoopConfiguration())

    def _versions(self) -> list[int]:
        if not self.fs.exists(self.path(self.root)):
            return []
        names = [f.getPath().getName() for f in self.fs.listStatus(self.path(self.root))]
        return sorted(int(n) for n in names if n.isdigit())

    def read(self) -> tuple[int, list[str]]:
        found = self._versions()
        if not found:
            return 0, []
        stream = self.fs.open(self.path(f"{self.root}/{found[-1]:09d}"))
        text = bytes(stream.readAllBytes()).decode()
        stream.close()
        return found[-1], text.split()

    def write(self, version: int, batches: list[str]) -> None:
        part, final = self.path(f"{self.root}/{uuid.uuid4().hex}.part"), self.path(f"{self.root}/{version:09d}")
        stream = self.fs.create(part, False)
        stream.write(bytearray("\n".join(batches).encode()))
        stream.close()
        if self.fs.exists(final) or not self.fs.rename(part, final):
            self.fs.delete(part, False)
            raise RuntimeError(f"another writer has made version {version} of the store")

    def remove(self, name: str) -> None:
        self.fs.delete(self.path(name), True)

    def folders(self, store: str) -> list[str]:
        return [f.getPath().getName() for f in self.fs.listStatus(self.path(store)) if f.getPath().getName().startswith("batch-")]


def batches_of(spark: SparkSession, store: str) -> list[str]:
    """Names of the live batches."""
    return _Log(spark, store).read()[1]


def committed(spark: SparkSession, store: str) -> DataFrame | None:
    """All finished rows of the store, or None before its first batch."""
    live = batches_of(spark, store)
    return spark.read.parquet(*[f"{store}/{b}" for b in live]) if live else None


def append_batch(rows: DataFrame, store: str) -> None:
    """Write one batch and enter it in the log."""
    log, name = _Log(rows.sparkSession, store), f"batch-{uuid.uuid4().hex}"
    rows.write.parquet(f"{store}/{name}")
    version, live = log.read()
    log.write(version + 1, [*live, name])


def compact(spark: SparkSession, store: str) -> int:
    """Rewrite all live batches as one and remove the others, left-behind ones too; returns the number of rows."""
    log, name = _Log(spark, store), f"batch-{uuid.uuid4().hex}"
    version, live = log.read()
    if not live:
        return 0
    committed(spark, store).write.parquet(f"{store}/{name}")
    log.write(version + 1, [name])
    for old in log.folders(store):
        if old != name:
            log.remove(f"{store}/{old}")
    return spark.read.parquet(f"{store}/{name}").count()


def enrich_distinct(df: DataFrame, content: Column, compute: Callable[[DataFrame], DataFrame], store: str, batches: int = 1) -> DataFrame:
    """Add the columns ``compute`` derives from each distinct content.

    ``compute`` gets ``content, content_sha256`` rows and returns ``content_sha256`` plus
    result columns (``mapInPandas`` fits). Missing keys are dealt over ``batches`` by their
    hash and each batch is committed to ``store`` when it is done, so a rerun, also after
    a failure half way, computes only what is missing. The result is joined back
    many-to-one after a completeness check. Null contents have no key and no result.
    """
    spark = df.sparkSession
    wanted = distinct_keys(df, content)
    known = committed(spark, store)
    missing = checkpointed(wanted if known is None else wanted.join(known.select(KEY), KEY, "left_anti"))
    for i in range(batches):
        part = missing.where(F.pmod(F.xxhash64(KEY), F.lit(batches)) == i) if batches > 1 else missing
        if not part.isEmpty():
            append_batch(compute(part), store)
    results = committed(spark, store)
    if results is None:  # nothing but null contents: the columns of a result over no key
        results = compute(missing)
    results = results.join(wanted.select(KEY), KEY, "left_semi")
    gaps = wanted.select(KEY).join(results.select(KEY), KEY, "left_anti").count()
    repeated = results.groupBy(KEY).count().where("count > 1").limit(1).count()
    if gaps or repeated:
        raise RuntimeError(f"enrichment incomplete: {gaps} keys without a result, {repeated} repeated")
    return df.withColumn(KEY, content_key(content)).join(results, KEY, "left")
