"""The append-only answer log: latest records, work left, spend, content-addressed dedupe."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.session import broadcast_if_small

RECORD_KEYS = ("system_id", "benchmark", "item_id")


def latest_records(log: DataFrame, keys: Sequence[str] = RECORD_KEYS) -> DataFrame:
    """One record per item: the last success, or the last failure of an item that never
    succeeded. A running maximum, so a hot item costs one value per task."""
    payload = F.struct("ok", "line_no", *[c for c in log.columns if c not in (*keys, "ok", "line_no")])
    newest = log.groupBy(*keys).agg(
        F.max_by(payload, F.struct(F.col("ok").cast("int"), F.col("line_no"))).alias("_r"),
        F.count(F.lit(1)).alias("n_attempts"),
    )
    return newest.select(*keys, "_r.*", "n_attempts")


def with_total_spend(log: DataFrame, keys: Sequence[str] = RECORD_KEYS) -> DataFrame:
    """Latest record per item whose ``cost_usd`` adds what its failed attempts were billed."""
    latest = latest_records(log, keys)
    failed = log.where(~F.col("ok")).groupBy(*keys).agg(F.sum("cost_usd").alias("_failed"))
    own = F.coalesce("cost_usd", F.lit(0.0))
    return (
        latest.join(failed, list(keys), "left")
        .withColumn("cost_usd", F.when(F.col("ok"), own + F.coalesce("_failed", F.lit(0.0))).otherwise(F.col("_failed")))
        .drop("_failed")
    )


def to_answer(items: DataFrame, latest: DataFrame, keys: Sequence[str] = ("benchmark", "item_id")) -> DataFrame:
    """Items never answered or whose last attempt failed."""
    return items.join(latest.where("ok").select(*keys), list(keys), "left_anti")


def foreign_records(latest: DataFrame, items: DataFrame, keys: Sequence[str] = ("benchmark", "item_id")) -> DataFrame:
    """Records of items outside the split."""
    return latest.join(items.select(*keys), list(keys), "left_anti")


def answered_items(items: DataFrame, latest: DataFrame, keys: Sequence[str] = ("benchmark", "item_id")) -> DataFrame:
    """Items joined with their successful records; unanswered ones are dropped."""
    fields = [c for c in latest.columns if c not in items.columns or c in keys]
    return items.join(latest.where("ok").select(*fields), list(keys))


def run_counts(latest: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Items, successes, failures, cache hits and spend per run."""
    return latest.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_items"), F.count_if("ok").alias("n_ok"),
        F.count_if(~F.col("ok")).alias("n_errors"),
        F.count_if(F.coalesce(F.col("ok") & F.col("cached"), F.lit(False))).alias("n_cached"),
        F.coalesce(F.sum("cost_usd"), F.lit(0.0)).alias("spent_usd"),
    )


def complete_benchmarks(
    latest: DataFrame, expected: DataFrame, declared: DataFrame | None = None
) -> DataFrame:
    """(system_id, benchmark, complete): every expected item tried, and every failed one declared
    unanswered. ``expected``: benchmark, n_items; ``declared``: benchmark, item_id."""
    failed = latest.where(~F.col("ok"))
    if declared is not None:
        failed = failed.join(declared, ["benchmark", "item_id"], "left_anti")
    undeclared = failed.groupBy("system_id", "benchmark").agg(F.count(F.lit(1)).alias("n_undeclared"))
    tried = latest.groupBy("system_id", "benchmark").agg(F.count(F.lit(1)).alias("n_tried"))
    return (
        tried.join(undeclared, ["system_id", "benchmark"], "left")
        .join(expected, "benchmark")
        .select(
            "system_id", "benchmark", "n_tried", F.coalesce("n_undeclared", F.lit(0)).alias("n_undeclared"),
            ((F.col("n_tried") == F.col("n_items")) & F.col("n_undeclared").isNull()).alias("complete"),
        )
    )


def protocol_violations(latest: DataFrame, declared: DataFrame | None = None) -> DataFrame:
    """Records that break the protocol: a failed item that is not declared, or an answer that took
    other than exactly one call (``n_calls``)."""
    rows = latest if declared is None else latest.join(
        declared, ["benchmark", "item_id"], "left_anti"
    ).unionByName(latest.where("ok").join(declared, ["benchmark", "item_id"], "left_semi"))
    reason = F.when(~F.col("ok"), "unanswered").when(F.coalesce(F.col("n_calls"), F.lit(0)) != 1, "calls")
    return rows.withColumn("reason", reason).where(F.col("reason").isNotNull())


def protocol_breaches(latest: DataFrame, items: DataFrame, settings: DataFrame, declared: DataFrame | None = None) -> DataFrame:
    """(system_id, benchmark, reason, n) of every way a run breaks the protocol: split items without a
    record (``missing``), records outside the split (``foreign``), failures that are not declared
    (``unanswered``), answers that took other than one call (``calls``), and a benchmark run with other
    settings than most of the system's (``settings``; n is how many settings differ).

    ``items``: benchmark, item_id of the split. ``settings``: system_id, benchmark, name, value, one row
    for each setting of a run. Settings shared by the most benchmarks count as the system's (ties: the
    first value in order).
    """
    keys = ["benchmark", "item_id"]
    systems = latest.select("system_id").distinct()
    # Every system is asked every item of the split: its runs are few, and checked before a broadcast.
    tried = latest.groupBy("system_id", "benchmark").agg(F.count(F.lit(1)).alias("n_records"))
    inside = latest.join(items.select(*keys), keys, "left_semi").groupBy("system_id", "benchmark").agg(F.count(F.lit(1)).alias("n_inside"))
    size = items.groupBy("benchmark").agg(F.count(F.lit(1)).alias("n_items"))
    asked = size.join(broadcast_if_small(systems.withColumn("_all", F.lit(1))), F.lit(1) == F.col("_all")).drop("_all")
    counts = asked.join(tried, ["system_id", "benchmark"], "full").join(inside, ["system_id", "benchmark"], "left")
    known = F.coalesce("n_inside", F.lit(0))
    parts = [
        counts.select("system_id", "benchmark", F.lit("missing").alias("reason"), (F.coalesce("n_items", F.lit(0)) - known).alias("n")),
        counts.select("system_id", "benchmark", F.lit("foreign").alias("reason"), (F.coalesce("n_records", F.lit(0)) - known).alias("n")),
        protocol_violations(latest, declared).groupBy("system_id", "benchmark", "reason").agg(F.count(F.lit(1)).alias("n")),
    ]
    shared = settings.groupBy("system_id", "name", "value").agg(F.count(F.lit(1)).alias("_k"))
    usual = shared.groupBy("system_id", "name").agg(F.min_by("value", F.struct((-F.col("_k")).alias("k"), F.coalesce("value", F.lit("")).alias("v"))).alias("_usual"))
    differing = settings.join(usual, ["system_id", "name"]).where(~F.col("value").eqNullSafe(F.col("_usual")))
    parts.append(differing.groupBy("system_id", "benchmark").agg(F.count(F.lit(1)).alias("n")).select("system_id", "benchmark", F.lit("settings").alias("reason"), "n"))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out.where("n > 0")


def answer_type_error(asked: Column, answered: Column) -> Column:
    """Error struct of an answer whose type is not the question's, NULL when it matches."""
    return F.when(
        ~answered.eqNullSafe(asked),
        F.struct(
            F.lit("AnswerMismatch").alias("type"),
            F.concat(F.lit("expected a "), asked, F.lit(" answer, got "), F.coalesce(answered, F.lit("none"))).alias("message"),
        ),
    )


# --- content-addressed responses -------------------------------------------------------------------


def cache_key(model: Column, request: Column) -> Column:
    """Hash of the model and the request text as received (key order is part of it)."""
    return F.sha2(F.concat(model, F.lit("\n"), request), 256)


def first_responses(responses: DataFrame, order: Sequence[str] = ("created",)) -> DataFrame:
    """One response per (model, request): the first stored wins."""
    keyed = responses.withColumn("key", cache_key(F.col("model"), F.col("request")))
    payload = F.struct(*[c for c in responses.columns if c not in ("request",)])
    first = keyed.groupBy("key").agg(
        F.min_by(payload, F.struct(*order)).alias("_r"), F.count(F.lit(1)).alias("n_seen")
    )
    return first.select("key", "_r.*", "n_seen")


def cache_lookup(requests: DataFrame, store: DataFrame) -> DataFrame:
    """Requests with their stored response, NULL on a miss."""
    keyed = requests.withColumn("key", cache_key(F.col("model"), F.col("request")))
    stored = store.select("key", F.col("response").alias("stored_response"))
    return keyed.join(stored, "key", "left").withColumn("hit", F.col("stored_response").isNotNull())


def duplicate_ids(rows: DataFrame, keys: Sequence[str], place: str) -> DataFrame:
    """Ids that occur more than once: count, first and second place."""
    return (
        rows.groupBy(*keys)
        .agg(F.count(F.lit(1)).alias("n"), F.min(place).alias("first_at"), F.max(place).alias("last_at"))
        .where("n > 1")
    )
