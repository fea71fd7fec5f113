"""Session settings and lineage cutting."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "sitewise", master: str | None = None,
                  shuffle_partitions: int | None = None, **conf: str) -> SparkSession:
    """A session with the settings the operators are tuned for.

    On a cluster leave ``master`` and ``shuffle_partitions`` unset: AQE coalesces
    from whatever upper bound the cluster configures.
    """
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .config("spark.ui.showConsoleProgress", "false")
    )
    if master:
        builder = builder.master(master)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    for key, value in conf.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder; a temporary one is only made in local mode."""
    context = spark.sparkContext
    current = context.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
        configured = tempfile.mkdtemp(prefix="sitewise-checkpoint-")
    context.setCheckpointDir(configured)
    return configured


ROWS_PER_FILE = 25_000

# Fixed value: rows of a task where several sorts and hash tables stand in one task.
ROWS_PER_TASK = 200_000


def checkpointed(df: DataFrame, rows: int | None = None) -> DataFrame:
    """Write ``df`` to the checkpoint folder and read it from there.

    Used where a plan must see one fixed copy of its input twice (range
    partitions whose ids are joined back) and to cut the lineage of loops. Given how many
    narrow ``rows`` there are about, partitions are merged to that many rows each, so that
    the rounds of a loop do not write a file per shuffle partition for a few rows.
    """
    ensure_checkpoint_dir(df.sparkSession)
    return (df if rows is None else df.coalesce(max(1, rows // ROWS_PER_FILE))).checkpoint(eager=True)


def tasks_for(df: DataFrame) -> int:
    """Into how many tasks the rows of ``df`` are best dealt. They are counted, so ``df`` should be a fixed copy.

    The session's number of shuffle partitions does not follow the data, so what a task holds
    would grow with it.
    """
    usual = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(usual, -(-df.count() // ROWS_PER_TASK))
