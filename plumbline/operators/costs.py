"""Prices, usage and item costs as column expressions and grouped aggregates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.session import lookup

PER_MTOK = 1e-6
MISMATCH_TOLERANCE = 0.01
DEFAULT_GPU_WATTS = 410.0
DEFAULT_USD_PER_WH = 0.00027
ESTIMATE_OVERHEAD_TOKENS = 512
ESTIMATE_BYTES_PER_TOKEN = 2

PRICE_SCHEMA = (
    "price_id string, input_usd double, output_usd double, cached_usd double, write_usd double, "
    "multiplier double, long_threshold long, long_input double, long_output double"
)


def token_cost(
    usage_input: Column, usage_output: Column, cached: Column, written: Column
) -> Column:
    """$ of one request under the price columns of :data:`PRICE_SCHEMA` on the same row. Cached and
    cache-write tokens are part of the input tokens; without own rates they pay the input rate; a
    request above the long-context threshold pays the multipliers for all of it."""
    long = F.coalesce(usage_input > F.col("long_threshold"), F.lit(False))
    hit, wrote = F.coalesce(cached, F.lit(0)), F.coalesce(written, F.lit(0))
    input_usd = (
        (usage_input - hit - wrote) * F.col("input_usd")
        + hit * F.coalesce("cached_usd", "input_usd")
        + wrote * F.coalesce("write_usd", "input_usd")
    )
    output_usd = usage_output * F.col("output_usd")
    return (
        (
            input_usd * F.when(long, F.coalesce("long_input", F.lit(1.0))).otherwise(1.0)
            + output_usd * F.when(long, F.coalesce("long_output", F.lit(1.0))).otherwise(1.0)
        )
        * F.coalesce("multiplier", F.lit(1.0))
        * PER_MTOK
    )


def record_usage(df: DataFrame) -> DataFrame:
    """Usage columns with cached tokens from the usage's extra fields, else the diagnostics, and
    ``usage_ok``: counts are non-negative and cached plus written tokens fit in the input."""
    cached = F.coalesce("cached_tokens", "diag_cached_tokens")
    ok = (
        (F.col("input_tokens") >= 0) & (F.col("output_tokens") >= 0)
        & (F.coalesce(cached, F.lit(0)) >= 0)
        & (F.coalesce(cached, F.lit(0)) + F.coalesce("cache_write_tokens", F.lit(0)) <= F.col("input_tokens"))
    )
    return df.withColumn("cached_tokens", cached).withColumn("usage_ok", ok)


def item_costs(records: DataFrame, prices: DataFrame) -> DataFrame:
    """Records (with usage and ``price_id``) plus table_usd, item_usd, billed and price_mismatch.

    A recorded charge of a billed call is the cost; a response-cache hit costs the table price; an
    item without usage 0, and an unpriced system NULL. ``prices`` is a dimension table.
    """
    priced = records.join(prices, "price_id", "left")
    has_price = F.col("input_usd").isNotNull()
    table = F.when(
        F.col("input_tokens").isNotNull() & has_price,
        token_cost(F.col("input_tokens"), F.col("output_tokens"), F.col("cached_tokens"), F.col("cache_write_tokens")),
    )
    billed = F.col("cost_usd").isNotNull() & ~F.coalesce("cached", F.lit(False))
    off = F.abs(F.col("cost_usd") - F.col("table_usd")) > MISMATCH_TOLERANCE * F.abs("table_usd")
    return (
        priced.withColumn("table_usd", table)
        .withColumn("billed", billed)
        .withColumn(
            "item_usd",
            F.when(F.col("billed"), F.col("cost_usd"))
            .when(F.col("table_usd").isNotNull(), F.col("table_usd"))
            .when(has_price, F.lit(0.0)),
        )
        .withColumn("price_mismatch", F.col("billed") & F.coalesce(off, F.lit(False)))
    )


def allocate(
    rows: DataFrame, totals: DataFrame, groups: Sequence[str], weight: str, total: str, share: str = "share"
) -> DataFrame:
    """``total`` of each group split over its rows in proportion to ``weight``; an unknown weight
    counts as the mean of the known ones, all-zero weights split equally. Sums are aggregated and
    joined back, so a group is never gathered."""
    groups = list(groups)
    sums = rows.groupBy(*groups).agg(
        F.sum(weight).alias("_known"), F.count(weight).alias("_n_known"), F.count(F.lit(1)).alias("_n")
    )
    filled = F.coalesce(F.col(weight).cast("double"), F.coalesce(F.try_divide("_known", "_n_known"), F.lit(1.0)))
    mean = F.coalesce(F.try_divide("_known", "_n_known"), F.lit(1.0))
    norm = F.coalesce("_known", F.lit(0.0)) + (F.col("_n") - F.col("_n_known")) * mean
    placed = rows.join(lookup(sums.join(totals, groups)), groups)
    value = F.when(norm > 0, F.col(total) * filled / norm).otherwise(F.col(total) / F.col("_n"))
    return placed.withColumn(share, value).drop("_known", "_n_known", "_n", total)


# --- invocations -----------------------------------------------------------------------------------


def seconds_between(start: Column, end: Column) -> Column:
    return (F.unix_micros(end) - F.unix_micros(start)) / 1e6


def timed() -> Column:
    """Invocations whose wall time measures the system: finished, called something, not a pure
    replay of the response cache."""
    return F.col("finished").isNotNull() & (F.col("n_called") > 0) & (F.col("n_cache_hits") < F.col("n_called"))


def throughput(invocations: DataFrame, groups: Sequence[str]) -> DataFrame:
    """Items sent per second of summed wall time over the timed invocations; with ``concurrency``, also
    the different in-flight limits they ran at."""
    seconds = seconds_between(F.col("started"), F.col("finished"))
    return (
        invocations.where(timed())
        .groupBy(*groups)
        .agg(
            F.sum(F.col("n_called") - F.col("n_cache_hits")).alias("throughput_items"),
            F.sum(seconds).alias("wall_seconds"),
            *([F.sort_array(F.collect_set("concurrency")).alias("in_flight")] if "concurrency" in invocations.columns else []),
        )
        .withColumn("items_per_second", F.try_divide("throughput_items", "wall_seconds"))
    )


def machine_seconds(invocations: DataFrame, groups: Sequence[str]) -> DataFrame:
    """Summed wall time of the finished invocations, NULL when none finished."""
    span = F.when(F.col("finished").isNotNull(), seconds_between(F.col("started"), F.col("finished")))
    return invocations.groupBy(*groups).agg(F.sum(span).alias("gpu_seconds"))


def machine_rate(usd_per_hour: float | None = None, watts: float = DEFAULT_GPU_WATTS, usd_per_wh: float = DEFAULT_USD_PER_WH) -> float:
    """$/hour: an explicit rate, else board power times electricity price."""
    return usd_per_hour if usd_per_hour is not None else watts * usd_per_wh


def machine_cost(seconds: Column, usd_per_hour: float) -> Column:
    return seconds / 3600.0 * usd_per_hour


# --- usage statistics --------------------------------------------------------------------------------


def usage_stats(costed: DataFrame, groups: Sequence[str] = ("system_id", "benchmark")) -> DataFrame:
    """Token, cost and error statistics per benchmark and pooled (benchmark NULL) in one pass."""
    head, last = list(groups[:-1]), groups[-1]
    sets = costed.groupingSets([[*head, last], head], *head, last)
    has_usage = F.col("input_tokens").isNotNull()
    return sets.agg(
        F.count(F.lit(1)).alias("n_items"),
        F.count_if("ok").alias("n_ok"),
        F.count_if(has_usage).alias("n_usage"),
        F.sum("input_tokens").alias("input_tokens"),
        F.sum("output_tokens").alias("output_tokens"),
        F.sum("cached_tokens").alias("cached_tokens"),
        F.count("cached_tokens").alias("n_cached_reported"),
        F.when(F.count("item_usd") == F.count(F.lit(1)), F.sum("item_usd")).alias("cost_usd"),
        F.coalesce(F.sum("cost_usd"), F.lit(0.0)).alias("spent_usd"),
        F.count_if("billed").alias("n_billed"),
        F.coalesce(F.sum(F.when(F.col("billed"), F.col("table_usd"))), F.lit(0.0)).alias("billed_table_usd"),
        F.count_if("price_mismatch").alias("n_price_mismatch"),
        F.count_if(F.coalesce("cached", F.lit(False))).alias("n_response_cache_hits"),
        F.count_if(F.coalesce("correct", F.lit(False))).alias("n_correct"),
        *([F.sum("backend_calls").alias("backend_calls"), F.count("backend_calls").alias("n_diagnostics")] if "backend_calls" in costed.columns else []),
    )


def with_ratios(stats: DataFrame) -> DataFrame:
    """Mean tokens and unit costs; NULL where undefined."""
    return stats.withColumns(
        {
            "mean_input_tokens": F.try_divide("input_tokens", "n_usage"),
            "mean_output_tokens": F.try_divide("output_tokens", "n_usage"),
            "mean_cached_tokens": F.try_divide("cached_tokens", "n_cached_reported"),
            "cost_per_1k_items": F.try_divide("cost_usd", "n_items") * 1000.0,
            "cost_per_correct": F.try_divide("cost_usd", "n_correct"),
            **({"calls_per_item": F.try_divide("backend_calls", "n_diagnostics")} if "backend_calls" in stats.columns else {}),
        }
    )


# --- snapshots and estimates -----------------------------------------------------------------------


def eligible_endpoints(endpoints: DataFrame, required: Sequence[str], providers: Sequence[str] = ()) -> DataFrame:
    """Endpoints supporting every required parameter, of the named providers (tag or tag/...)."""
    needed = F.array(*[F.lit(p) for p in required])
    ok = F.size(F.array_except(needed, F.coalesce("supported", F.array().cast("array<string>")))) == 0
    if providers:
        named = F.array(*[F.lit(p) for p in providers])
        ok = ok & F.exists(named, lambda p: (F.col("tag") == p) | F.startswith(F.col("tag"), F.concat(p, F.lit("/"))))
    return endpoints.where(ok)


def snapshot_price(endpoints: DataFrame, groups: Sequence[str]) -> DataFrame:
    """Highest rate per 1M tokens over endpoints and their time-of-day overrides (fields an
    override omits keep the endpoint's); a tier without cache rates bills them as input.

    ``endpoints``: groups, pricing STRUCT<prompt, completion, cache_read, cache_write> (strings)
    and overrides ARRAY of the same struct.
    """
    fields = ("prompt", "completion", "cache_read", "cache_write")
    tiers = F.concat(
        F.array("pricing"),
        F.transform(
            F.coalesce("overrides", F.array().cast("array<struct<prompt:string,completion:string,cache_read:string,cache_write:string>>")),
            lambda o: F.struct(*[F.coalesce(o[f], F.col("pricing")[f]).alias(f) for f in fields]),
        ),
    )
    tier = endpoints.select(*groups, F.explode(tiers).alias("t"))
    rate = {f: F.col(f"t.{f}").cast("decimal(38,18)") for f in fields}
    per = F.lit(1_000_000).cast("decimal(38,18)")

    def top(column: Column) -> Column:
        return (F.max(column) * per).cast("double")

    return tier.groupBy(*groups).agg(
        top(rate["prompt"]).alias("input_usd"), top(rate["completion"]).alias("output_usd"),
        top(F.coalesce(rate["cache_read"], rate["prompt"])).alias("cached_usd"),
        top(F.coalesce(rate["cache_write"], rate["prompt"])).alias("write_usd"),
    )


def estimate_input_tokens(request: Column) -> Column:
    """Pessimistic token estimate of a request text."""
    return ESTIMATE_OVERHEAD_TOKENS + F.ceil(F.octet_length(request) / ESTIMATE_BYTES_PER_TOKEN)
