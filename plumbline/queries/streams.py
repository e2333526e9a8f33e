"""Streaming queries: each drains the given events table as a stream and reads back its result.

Outputs go to a fresh folder under the session's checkpoint directory.
"""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from plumbline.queries import derived as D
from plumbline.queries.records_area import LATEST
from plumbline.queries.registry import n, query, r
from plumbline.session import ensure_checkpoint_dir
from plumbline.streaming import records as S


def scratch(spark) -> str:
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/stream-{uuid.uuid4().hex}"


def log_stream(spark, sf):
    """The records view over a stream of the events file."""
    schema = D.table(spark, sf, "events").schema
    events = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf)
    e = events
    ok = F.col("event_type") != "error"
    return e.select(
        F.concat(F.lit("s"), (F.col("event_id") % 3).cast("string")).alias("system_id"),
        F.concat(F.lit("b"), (F.col("user_id") % 4).cast("string")).alias("benchmark"),
        F.concat_ws("-", F.col("user_id").cast("string"), F.date_format("ts", "yyyy-MM-dd")).alias("item_id"),
        F.col("event_id").alias("line_no"), F.col("ts").cast("timestamp").alias("ts"), ok.alias("ok"),
        F.col("value").alias("latency_ms"), (F.col("event_type") == "view").alias("cached"),
        F.when(F.col("event_type") == "view", 0.0).otherwise(F.col("value") * 1e-4).alias("cost_usd"),
    )


@query("ingested_records", f"SELECT system_id, {n('count(*)', 'n')}, {r('sum(latency_ms)', 'latency_ms')} FROM records GROUP BY 1", ("records",))
def ingested_records(spark, sf):
    """The log ingested exactly once into a Parquet table."""
    base = scratch(spark)
    S.ingest(log_stream(spark, sf), f"{base}/out", f"{base}/state").awaitTermination()
    out = spark.read.parquet(f"{base}/out")
    return out.groupBy("system_id").agg(F.count(F.lit(1)).alias("n"), F.sum("latency_ms").alias("latency_ms"))


@query(
    "streamed_latest_records",
    f"""WITH l AS ({LATEST}), f AS (SELECT system_id, benchmark, item_id, sum(cost_usd) FILTER (WHERE NOT ok) AS failed FROM records GROUP BY 1, 2, 3)
    SELECT system_id, benchmark, item_id, line_no, ok, {n('n_attempts', 'n_attempts')}, {r('coalesce(failed, 0)', 'failed_usd')} FROM l JOIN f USING (system_id, benchmark, item_id)""",
    ("records",),
)
def streamed_latest_records(spark, sf):
    """The latest record per item kept from a stream: a success beats any error."""
    base = scratch(spark)
    S.keep_latest(log_stream(spark, sf), f"{base}/latest", f"{base}/state").awaitTermination()
    return S.merged_latest(spark, f"{base}/latest").select(
        "system_id", "benchmark", "item_id", "line_no", "ok", "n_attempts", "failed_usd"
    )


@query(
    "streamed_progress",
    f"""SELECT strftime(time_bucket(INTERVAL '1 day', ts), '%Y-%m-%d') AS day, system_id, {n('count(*)', 'n_called')}, {n('count(*) FILTER (WHERE NOT ok)', 'n_errors')}, {n('count(*) FILTER (WHERE cached)', 'n_cache_hits')}, {r('sum(cost_usd)', 'spent_usd')}
    FROM records GROUP BY 1, 2""",
    ("records",),
)
def streamed_progress(spark, sf):
    """Calls, errors, cache hits and spend per day: every window, open ones and late rows included."""
    base = scratch(spark)
    S.keep_progress(log_stream(spark, sf), f"{base}/out", f"{base}/state", "1 day").awaitTermination()
    out = S.merged_progress(spark, f"{base}/out")
    return out.select(F.date_format("window_start", "yyyy-MM-dd").alias("day"), "system_id", "n_called", "n_errors", "n_cache_hits", "spent_usd")


@query("budget_watch", f"SELECT {r('sum(cost_usd)', 'spent_usd')}, {r('0.5', 'budget_usd')}, sum(cost_usd) >= 0.5 AS stop FROM records", ("records",))
def budget_watch(spark, sf):
    """Running spend against a budget."""
    base = scratch(spark)
    S.within_budget(S.watch_budget(log_stream(spark, sf), 0.5, f"{base}/spent", f"{base}/state"))
    return S.over_budget(spark, f"{base}/spent")
