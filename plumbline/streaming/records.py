"""Streaming over the answer log: ingestion, the latest record per item, live progress.

The log grows by appended rows; an answered item is never asked again, and a success beats any
error whatever the arrival order. That rule is associative, so each micro-batch is reduced to one
row per item before it meets earlier results.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import StreamingQueryException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from plumbline.operators.records import RECORD_KEYS, latest_records
from plumbline.sources.readers import CORRUPT, RECORD_SCHEMA
from plumbline.sources.writers import _exists


def records_stream(spark: SparkSession, path: str, max_files: int | None = None) -> DataFrame:
    """The growing folder of JSON-lines records as a stream; torn lines are dropped."""
    reader = spark.readStream.schema(f"{RECORD_SCHEMA}, {CORRUPT} string").option(
        "columnNameOfCorruptRecord", CORRUPT
    )
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    rows = reader.json(path)
    return rows.where(F.col(CORRUPT).isNull() & F.col("item_id").isNotNull()).drop(CORRUPT)


def ingest(stream: DataFrame, out: str, checkpoint: str, partition_by: Sequence[str] = ()) -> StreamingQuery:
    """Append the stream to a Parquet table exactly once (file sink plus checkpoint)."""
    writer = stream.writeStream.format("parquet").option("path", out).option(
        "checkpointLocation", checkpoint
    ).trigger(availableNow=True)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    return writer.start()


LEVEL_RUNS = 8
"""Increments of one level that are merged into one of the next."""


def keep_latest(
    stream: DataFrame, table: str, checkpoint: str, keys: Sequence[str] = RECORD_KEYS, level_runs: int = LEVEL_RUNS
) -> StreamingQuery:
    """Write each micro-batch's latest record and failed spend per item as one increment, and keep the
    increments few.

    Increments lie in levels, ``level=<l>/first=<batch>/last=<batch>``. When ``level_runs`` of a level
    are there, they become one of the next level: a record is rewritten once per level, so a batch's
    work grows with the logarithm of the history at most, and there are at most ``level_runs`` increments
    a level to read. An increment is named by the batches it holds and replaced when a batch or a merge
    is replayed; increments that a wider one covers do not count (:func:`increments`), whether or not a
    crash kept them from being deleted. So a lost driver or executor never counts a row twice.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        if any(first <= batch_id <= last for level, first, last, _ in increments(spark, table) if level):
            return  # a replay of a batch that was merged already
        latest = latest_records(batch, keys)
        failed = batch.groupBy(*keys).agg(
            F.coalesce(F.sum(F.when(~F.col("ok"), F.col("cost_usd"))), F.lit(0.0)).alias("failed_usd")
        )
        latest.join(failed, list(keys)).write.mode("overwrite").parquet(f"{table}/level=0/first={batch_id}/last={batch_id}")
        merge_levels(spark, table, keys, level_runs)

    return (
        stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start()
    )


def _folders(spark: SparkSession, path: str, name: str) -> list[tuple[int, str]]:
    """(value, path) of the partition folders ``<name>=<value>`` below ``path``."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(at):
        return []
    names = [s.getPath().getName() for s in fs.listStatus(at)]
    return sorted((int(n.split("=")[1]), f"{path}/{n}") for n in names if n.startswith(f"{name}="))


def increments(spark: SparkSession, table: str) -> list[tuple[int, int, int, str]]:
    """(level, first batch, last batch, path) of the increments that count, oldest first: those written
    whole that no increment of a higher level covers. There are some for each level, so this is a list."""
    found = []
    for level, folder in reversed(_folders(spark, table, "level")):
        for first, low in _folders(spark, folder, "first"):
            for last, path in _folders(spark, low, "last"):
                covered = any(f <= first and last <= t for _, f, t, _ in found)
                if not covered and _exists(spark, f"{path}/_SUCCESS"):
                    found.append((level, first, last, path))
    return sorted(found, key=lambda x: x[1])


def merge_levels(spark: SparkSession, table: str, keys: Sequence[str] = RECORD_KEYS, level_runs: int = LEVEL_RUNS) -> None:
    """Merges every level that has ``level_runs`` increments into one of the next."""
    level = 0
    while True:
        runs = [r for r in increments(spark, table) if r[0] == level]
        if len(runs) < level_runs:
            if not any(r[0] > level for r in increments(spark, table)):
                return
            level += 1
            continue
        first, last = runs[0][1], runs[-1][2]
        _combined(spark.read.parquet(*[r[3] for r in runs]), keys).write.mode("overwrite").parquet(f"{table}/level={level + 1}/first={first}/last={last}")
        for _, _, _, path in runs:  # covered from here on
            _delete(spark, path)
        level += 1


def _delete(spark: SparkSession, path: str) -> None:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def _combined(parts: DataFrame, keys: Sequence[str]) -> DataFrame:
    payload = F.struct(*[c for c in parts.columns if c not in (*keys, "n_attempts", "failed_usd")])
    merged = parts.groupBy(*keys).agg(
        F.max_by(payload, F.struct(F.col("ok").cast("int"), F.col("line_no"))).alias("_r"),
        F.sum("n_attempts").alias("n_attempts"), F.sum("failed_usd").alias("failed_usd"),
    )
    return merged.select(*keys, "_r.*", "n_attempts", "failed_usd")


def merged_latest(spark: SparkSession, table: str, keys: Sequence[str] = RECORD_KEYS) -> DataFrame:
    """The latest record per item over the increments that count, with attempts and failed spend
    added."""
    paths = [r[3] for r in increments(spark, table)]
    if not paths:
        raise ValueError(f"{table} has no increments")
    return _combined(spark.read.parquet(*paths), keys)


def compact(spark: SparkSession, table: str, target: str, keys: Sequence[str] = RECORD_KEYS) -> None:
    """Fold the increments into one, for a fresh table to continue from (of batch -1, before any)."""
    merged_latest(spark, table, keys).write.mode("overwrite").parquet(f"{target}/level=0/first=-1/last=-1")


def _progress(rows: DataFrame, window: str) -> DataFrame:
    return (
        rows.groupBy(F.window("ts", window), "system_id")
        .agg(
            F.count(F.lit(1)).alias("n_called"), F.count_if(~F.col("ok")).alias("n_errors"),
            F.count_if(F.coalesce("cached", F.lit(False))).alias("n_cache_hits"),
            F.sum("cost_usd").alias("spent_usd"),
        )
        .select(F.col("window.start").alias("window_start"), "system_id", "n_called", "n_errors", "n_cache_hits", "spent_usd")
    )


def live_progress(stream: DataFrame, window: str = "1 hour", delay: str = "10 minutes") -> DataFrame:
    """Answered, errors, cache hits and spend per system and event-time window, for sinks that need
    windows to be final: a window closes ``delay`` after its end, and what comes later is lost.
    :func:`keep_progress` loses nothing."""
    return _progress(stream.withWatermark("ts", delay), window)


def keep_progress(stream: DataFrame, table: str, checkpoint: str, window: str = "1 hour") -> StreamingQuery:
    """Write each micro-batch's counts per system and window as one increment (replaced when the batch
    is replayed). Open windows and rows of any lateness are in :func:`merged_progress` at once."""

    def write(batch: DataFrame, batch_id: int) -> None:
        _progress(batch, window).write.mode("overwrite").parquet(f"{table}/batch={batch_id}")

    return (
        stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start()
    )


def merged_progress(spark: SparkSession, table: str) -> DataFrame:
    """The increments added up."""
    counts = ("n_called", "n_errors", "n_cache_hits", "spent_usd")
    return spark.read.parquet(table).groupBy("window_start", "system_id").agg(*[F.sum(c).alias(c) for c in counts])


BUDGET_SPENT = "the budget is spent"


def watch_budget(stream: DataFrame, budget_usd: float, spent_path: str, checkpoint: str) -> StreamingQuery:
    """Record each micro-batch's spend under ``spent_path``, one row per batch, replaced on replay. The
    batch that reaches the budget ends the query (:data:`BUDGET_SPENT`), so no later batch is read;
    :func:`within_budget` waits for either end."""

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.agg(F.coalesce(F.sum("cost_usd"), F.lit(0.0)).alias("spent_usd")).withColumn(
            "budget_usd", F.lit(budget_usd)
        ).write.mode("overwrite").parquet(f"{spent_path}/batch={batch_id}")
        if over_budget(batch.sparkSession, spent_path).first()["stop"]:
            raise RuntimeError(BUDGET_SPENT)

    return (
        stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start()
    )


def within_budget(query: StreamingQuery) -> bool:
    """Wait for a query of :func:`watch_budget`; False when the budget ended it."""
    try:
        query.awaitTermination()
    except StreamingQueryException as error:
        if BUDGET_SPENT not in str(error):
            raise
        return False
    return True


def over_budget(spark: SparkSession, spent_path: str) -> DataFrame:
    """(spent_usd, budget_usd, stop)."""
    return spark.read.parquet(spent_path).agg(
        F.sum("spent_usd").alias("spent_usd"), F.max("budget_usd").alias("budget_usd")
    ).withColumn("stop", F.col("spent_usd") >= F.col("budget_usd"))
