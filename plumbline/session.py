"""Session helpers: local defaults, reliable checkpoints and size-checked broadcasts."""

from __future__ import annotations

import tempfile

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BROADCAST_ROWS = 200_000
"""Largest row count :func:`broadcast_if_small` ships to every executor."""
BROADCAST_BYTES = 64 * 2**20
"""Largest size (as JSON text, an upper bound for numbers) it ships."""


def local_session(cpus: int | str = "*", partitions: int = 8, app: str = "plumbline") -> SparkSession:
    """A local session for tests and the benchmark; a cluster brings its own."""
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "12g")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the shared folder of ``spark.checkpoint.dir``; only a local session without one gets
    a temporary folder (a cluster's executors could not read it)."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is not None:
        return
    shared = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if shared:
        sc.setCheckpointDir(shared)
    elif sc.master.startswith("local"):
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="plumbline-checkpoint-"))
    else:
        raise RuntimeError("set spark.checkpoint.dir to a folder every executor can read")


def checkpoint(df: DataFrame) -> DataFrame:
    """``df`` written to the checkpoint folder: its lineage is cut and its row order, partition
    numbers and generated ids stay fixed when an executor is lost."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def row_bytes(df: DataFrame) -> Column:
    """Length of a row as JSON text."""
    return F.length(F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns])))


def broadcast_if_small(df: DataFrame, max_rows: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` with a broadcast hint when it has at most ``max_rows`` rows and
    :data:`BROADCAST_BYTES`, else unhinted, so the planner (and AQE's skew handling) picks a
    shuffled join. Pass checkpointed or cached tables: the check reads up to ``max_rows`` rows."""
    probe = df.limit(max_rows + 1)
    rows, size = probe.agg(F.count(F.lit(1)), F.coalesce(F.sum(row_bytes(df)), F.lit(0))).first()
    return F.broadcast(df) if rows <= max_rows and size <= BROADCAST_BYTES else df


def lookup(df: DataFrame) -> DataFrame:
    """An aggregated table to join facts with by a possibly skewed key (a benchmark, a system, a
    prior key): computed once, counted, and broadcast when small so the facts are not shuffled by
    that key; otherwise left to a shuffled join with AQE's skew handling."""
    return broadcast_if_small(checkpoint(df))


def cached(df: DataFrame) -> DataFrame:
    """``df`` kept on the executors (recomputed from its lineage when one is lost)."""
    return df.persist(StorageLevel.MEMORY_AND_DISK)
