"""Prices, item costs, throughput and usage statistics."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbline.operators import alignment as A
from plumbline.operators import costs as K
from plumbline.operators import records as R
from plumbline.operators import summaries as S
from plumbline.operators.frontier import capacity_ceiling
from plumbline.queries import derived as D
from plumbline.queries.records_area import LATEST, latest
from plumbline.queries.registry import n, query, r

# A price dimension: id, input, output, cached, write, multiplier, threshold, long multipliers.
PRICES = [
    ("en", 0.10, 0.50, 0.01, 0.125, 1.0, 800, 2.0, 1.5),
    ("de", 0.20, 0.00, None, None, 0.5, None, None, None),
    ("fr", 0.05, 0.25, 0.02, None, None, 400, 3.0, None),
]
_PRICES = """prices(price_id, input_usd, output_usd, cached_usd, write_usd, multiplier, long_threshold, long_input, long_output) AS (VALUES
  ('en', 0.10::DOUBLE, 0.50::DOUBLE, 0.01::DOUBLE, 0.125::DOUBLE, 1.0::DOUBLE, 800, 2.0::DOUBLE, 1.5::DOUBLE), ('de', 0.20, 0.00, NULL, NULL, 0.5, NULL, NULL, NULL), ('fr', 0.05, 0.25, 0.02, NULL, NULL, 400, 3.0, NULL))"""
_COST = """(((input_tokens - coalesce(cached_tokens, 0) - coalesce(cache_write_tokens, 0)) * input_usd + coalesce(cached_tokens, 0) * coalesce(cached_usd, input_usd)
    + coalesce(cache_write_tokens, 0) * coalesce(write_usd, input_usd)) * CASE WHEN input_tokens > long_threshold THEN coalesce(long_input, 1) ELSE 1 END
  + output_tokens * output_usd * CASE WHEN input_tokens > long_threshold THEN coalesce(long_output, 1) ELSE 1 END) * coalesce(multiplier, 1)"""


def prices(spark):
    return spark.createDataFrame(PRICES, K.PRICE_SCHEMA)


@query(
    "token_costs",
    f"WITH {_PRICES} SELECT item_id, price_id, {r(_COST, 'usd_per_million')} FROM usage JOIN prices USING (price_id)", ("usage",),
)
def token_costs(spark, sf):
    """Cost of every document's request under tiered token prices, in millionths of a dollar."""
    u = D.usage(spark, sf).join(prices(spark), "price_id")
    cost = K.token_cost(F.col("input_tokens"), F.col("output_tokens"), F.col("cached_tokens"), F.col("cache_write_tokens"))
    return u.select("item_id", "price_id", (cost / K.PER_MTOK).alias("usd_per_million"))


@query(
    "usage_validation",
    f"""SELECT price_id, {n('count(*)', 'n')}, {n('count(*) FILTER (WHERE coalesce(c, 0) <= input_tokens)', 'n_ok')}, {n('sum(c)', 'cached')} FROM (
      SELECT price_id, input_tokens, CASE WHEN item_id::BIGINT % 3 = 0 THEN cached_tokens WHEN item_id::BIGINT % 3 = 1 THEN input_tokens + 1 END AS c FROM usage) GROUP BY 1""",
    ("usage",),
)
def usage_validation(spark, sf):
    """Cached tokens from the usage, else the diagnostics, and whether the counts are coherent."""
    i = F.col("item_id").cast("bigint") % 3
    u = D.usage(spark, sf).withColumn("diag_cached_tokens", F.when(i == 1, F.col("input_tokens") + 1)).withColumn(
        "cached_tokens", F.when(i == 0, F.col("cached_tokens"))
    )
    return K.record_usage(u).groupBy("price_id").agg(
        F.count(F.lit(1)).alias("n"), F.count_if("usage_ok").alias("n_ok"), F.sum("cached_tokens").alias("cached")
    )


def priced_records(spark, sf):
    rows = D.records(spark, sf).withColumn("price_id", F.when(F.col("system_id") == "s0", "en").when(F.col("system_id") == "s1", "fr"))
    rows = rows.withColumn("cache_write_tokens", F.lit(0).cast("bigint"))
    return K.item_costs(rows, prices(spark))


_ITEM_COSTS = f"""costed AS (SELECT *, coalesce(price_mismatch_, false) AS price_mismatch FROM (
  SELECT *, CASE WHEN billed THEN cost_usd WHEN table_usd IS NOT NULL THEN table_usd WHEN input_usd IS NOT NULL THEN 0 END AS item_usd,
    billed AND abs(cost_usd - table_usd) > 0.01 * abs(table_usd) AS price_mismatch_ FROM (
    SELECT *, NOT cached AS billed, CASE WHEN input_tokens IS NOT NULL THEN {_COST} * 1e-6 END AS table_usd FROM (
      SELECT r.*, 0 AS cache_write_tokens, p.* FROM records r LEFT JOIN prices p ON p.price_id = CASE r.system_id WHEN 's0' THEN 'en' WHEN 's1' THEN 'fr' END))))"""


@query(
    "item_costs",
    f"WITH {_PRICES}, {_ITEM_COSTS} SELECT line_no, {r('item_usd * 1e6', 'item_micro_usd')}, {r('table_usd * 1e6', 'table_micro_usd')}, billed, price_mismatch FROM costed", ("records",),
)
def item_costs(spark, sf):
    """Recorded charges, table prices of cache hits, and charges off the table by more than 1%."""
    return priced_records(spark, sf).select(
        "line_no", (F.col("item_usd") * 1e6).alias("item_micro_usd"), (F.col("table_usd") * 1e6).alias("table_micro_usd"), "billed", "price_mismatch"
    )


_STATS = """count(*) AS n_items, count(*) FILTER (WHERE ok) AS n_ok, count(input_tokens) AS n_usage, sum(input_tokens) AS input_tokens, sum(output_tokens) AS output_tokens,
  sum(cached_tokens) AS cached_tokens, count(cached_tokens) AS n_cached, CASE WHEN count(item_usd) = count(*) THEN sum(item_usd) END AS cost_usd, sum(cost_usd) AS spent_usd,
  count(*) FILTER (WHERE billed) AS n_billed, coalesce(sum(table_usd) FILTER (WHERE billed), 0) AS billed_table_usd, count(*) FILTER (WHERE price_mismatch) AS n_price_mismatch,
  count(*) FILTER (WHERE cached) AS n_hits, count(*) FILTER (WHERE ok AND latency_ms < 60) AS n_correct,
  sum(1 + line_no % 3) FILTER (WHERE ok) AS calls, count(*) FILTER (WHERE ok) AS n_calls"""


@query(
    "usage_statistics",
    f"""WITH {_PRICES}, {_ITEM_COSTS}, s AS (SELECT system_id, benchmark, {_STATS} FROM costed GROUP BY GROUPING SETS ((system_id, benchmark), (system_id)))
    SELECT system_id, benchmark, {n('n_items', 'n_items')}, {n('n_ok', 'n_ok')}, {n('n_correct', 'n_correct')}, {n('n_usage', 'n_usage')}, {n('input_tokens', 'input_tokens')}, {n('output_tokens', 'output_tokens')},
      {n('n_billed', 'n_billed')}, {n('n_price_mismatch', 'n_price_mismatch')}, {n('n_hits', 'n_response_cache_hits')}, {r('cost_usd', 'cost_usd')}, {r('spent_usd', 'spent_usd')}, {r('billed_table_usd', 'billed_table_usd')},
      {r('input_tokens / n_usage', 'mean_input_tokens')}, {r('output_tokens / n_usage', 'mean_output_tokens')}, {r('cached_tokens / n_cached', 'mean_cached_tokens')},
      {r('cost_usd / n_items * 1000', 'cost_per_1k_items')}, {r('cost_usd / nullif(n_correct, 0)', 'cost_per_correct')}, {n('calls', 'backend_calls')}, {n('n_calls', 'n_diagnostics')}, {r('calls / n_calls', 'calls_per_item')} FROM s""",
    ("records",),
)
def usage_statistics(spark, sf):
    """Token, cost and error statistics per benchmark and pooled, with unit costs."""
    rows = priced_records(spark, sf).withColumn("correct", F.col("ok") & (F.col("latency_ms") < 60))
    rows = rows.withColumn("backend_calls", F.when(F.col("ok"), 1 + F.col("line_no") % 3))
    return K.with_ratios(K.usage_stats(rows)).drop("cached_tokens", "n_cached_reported")


@query(
    "pooled_subset",
    f"""SELECT system_id, {n('count(*)', 'n_items')}, {r('quantile_cont(latency_ms, 0.5) FILTER (WHERE ok)', 'latency_p50_ms')}, {r('quantile_cont(latency_ms, 0.95) FILTER (WHERE ok)', 'latency_p95_ms')} FROM records
    WHERE benchmark IN ('b0', 'b2') GROUP BY 1""",
    ("records",),
)
def pooled_subset(spark, sf):
    """A run pooled over two of its benchmarks."""
    rows = S.drop_excluded(D.records(spark, sf), ["b0", "b2"])
    counts = rows.groupBy("system_id").agg(F.count(F.lit(1)).alias("n_items"))
    return counts.join(S.latency_percentiles(rows.where("ok"), ["system_id"]), "system_id")


_TIMED = "finished IS NOT NULL AND n_called > 0 AND n_cache_hits < n_called"


@query(
    "throughput",
    f"""SELECT system_id, {n('sum(n_called - n_cache_hits)', 'throughput_items')}, {r('sum(epoch_us(finished) - epoch_us(started)) / 1e6', 'wall_seconds')},
      {r('sum(n_called - n_cache_hits) / (sum(epoch_us(finished) - epoch_us(started)) / 1e6)', 'items_per_second')},
      array_to_string(list_sort(list_distinct(list(8 * (1 + right(day, 1)::INTEGER % 3)))), '/') AS in_flight FROM invocations WHERE {_TIMED} GROUP BY 1""",
    ("invocations",),
)
def throughput(spark, sf):
    """Items per second of the timed invocations, and the in-flight limits they ran at."""
    calls = D.invocations(spark, sf).withColumn("concurrency", 8 * (1 + F.substring("day", 10, 1).cast("int") % 3))
    out = K.throughput(calls, ["system_id"])
    return out.withColumn("in_flight", F.array_join(F.transform("in_flight", lambda c: c.cast("string")), "/"))


@query(
    "timed_invocations",
    f"SELECT system_id, day, {n('n_called', 'n_called')}, {n('n_cache_hits', 'n_cache_hits')} FROM invocations WHERE {_TIMED}", ("invocations",),
)
def timed_invocations(spark, sf):
    return D.invocations(spark, sf).where(K.timed()).select("system_id", "day", "n_called", "n_cache_hits")


@query(
    "machine_time_cost",
    f"""SELECT system_id, {r('sum(epoch_us(finished) - epoch_us(started)) / 1e6', 'gpu_seconds')}, {r('sum(epoch_us(finished) - epoch_us(started)) / 1e6 / 3600 * (410 * 0.00027)', 'cost_usd')} FROM invocations GROUP BY 1""",
    ("invocations",),
)
def machine_time_cost(spark, sf):
    """Machine time of the finished invocations at the electricity estimate."""
    s = K.machine_seconds(D.invocations(spark, sf), ["system_id"])
    return s.withColumn("cost_usd", K.machine_cost(F.col("gpu_seconds"), K.machine_rate()))


@query(
    "allocated_machine_time",
    f"""WITH t AS (SELECT 's' || (row_number() OVER (ORDER BY system_id) - 1) % 3 AS system_id, sum(epoch_us(finished) - epoch_us(started)) / 1e6 AS total FROM invocations WHERE system_id <> 'error' GROUP BY invocations.system_id),
    tt AS (SELECT system_id, sum(total) AS total FROM t GROUP BY 1),
    w AS (SELECT *, input_tokens + output_tokens AS weight FROM records),
    f AS (SELECT *, coalesce(weight::DOUBLE, avg(weight) OVER (PARTITION BY system_id), 1) AS filled FROM w)
    SELECT line_no, {r('total * filled / sum(filled) OVER (PARTITION BY system_id)', 'share')} FROM f JOIN tt USING (system_id)""",
    ("records", "invocations"),
)
def allocated_machine_time(spark, sf):
    """Each system's machine time split over its items by tokens; items without usage get the mean
    weight."""
    from plumbline.operators.ranking import with_rank

    per = K.machine_seconds(D.invocations(spark, sf).where("system_id <> 'error'"), ["system_id"])
    named = with_rank(per, [], ["system_id"], "place", "_n").select(
        F.concat(F.lit("s"), ((F.col("place") - 1) % 3).cast("string")).alias("system_id"), "gpu_seconds"
    )
    totals = named.groupBy("system_id").agg(F.sum("gpu_seconds").alias("total"))
    rows = D.records(spark, sf).withColumn("weight", F.col("input_tokens") + F.col("output_tokens"))
    return K.allocate(rows, totals, ["system_id"], "weight", "total").select("line_no", "share")


@query(
    "price_resolution",
    f"""SELECT s_name AS system_id, CASE s_suppkey % 5 WHEN 0 THEN 'en' WHEN 1 THEN 'snap' WHEN 3 THEN 'local-gpu' WHEN 4 THEN 'fr' END AS resolved,
      CASE s_suppkey % 5 WHEN 0 THEN 'price_id' WHEN 1 THEN 'snapshot' WHEN 2 THEN 'none' WHEN 3 THEN 'machine_time' ELSE 'model' END AS source FROM supplier""",
)
def price_resolution(spark, sf):
    """Which price applies to a system and where it comes from."""
    k = F.col("s_suppkey") % 5
    systems = D.table(spark, sf, "supplier").select(
        F.col("s_name").alias("system_id"), F.when(k == 0, "en").when(k.isin(1, 2), "xx").alias("price_id"),
        F.when(k == 1, "snap").alias("token_price_id"), F.when(k == 3, "emulator").otherwise("api").alias("kind"),
        F.when(k == 4, "fr").alias("model"),
    )
    return A.price_of(systems, prices(spark))


@query(
    "eligible_endpoints",
    "SELECT s_name AS endpoint, 'p' || (s_nationkey % 4) || CASE WHEN s_suppkey % 2 = 0 THEN '/fp8' ELSE '' END AS tag FROM supplier WHERE s_suppkey % 3 <> 0 AND s_nationkey % 4 IN (1, 2)",
)
def eligible_endpoints(spark, sf):
    """Endpoints that report logprobs, of two providers."""
    s = D.table(spark, sf, "supplier")
    tag = F.concat(F.lit("p"), (F.col("s_nationkey") % 4).cast("string"), F.when(F.col("s_suppkey") % 2 == 0, "/fp8").otherwise(""))
    supported = F.when(F.col("s_suppkey") % 3 == 0, F.array(F.lit("logprobs"))).otherwise(F.array(*[F.lit(x) for x in ("top_logprobs", "logprobs", "seed")]))
    endpoints = s.select(F.col("s_name").alias("endpoint"), tag.alias("tag"), supported.alias("supported"))
    return K.eligible_endpoints(endpoints, ["logprobs", "top_logprobs"], ["p1", "p2"]).select("endpoint", "tag")


@query(
    "price_snapshot",
    f"""WITH e AS (SELECT n_name AS model, s_suppkey, s_suppkey::DOUBLE / 1e9 AS prompt FROM supplier JOIN nation ON s_nationkey = n_nationkey),
    t AS (SELECT model, prompt, prompt * 3 AS completion, CASE WHEN s_suppkey % 2 = 0 THEN prompt / 10 ELSE prompt END AS rd, prompt AS wr FROM e
      UNION ALL SELECT model, prompt * 2, prompt * 3, CASE WHEN s_suppkey % 2 = 0 THEN prompt / 10 ELSE prompt * 2 END, prompt * 2 FROM e WHERE s_suppkey % 4 = 1)
    SELECT model, {r('max(prompt) * 1e6', 'input_usd')}, {r('max(completion) * 1e6', 'output_usd')}, {r('max(rd) * 1e6', 'cached_usd')}, {r('max(wr) * 1e6', 'write_usd')} FROM t GROUP BY 1""",
)
def price_snapshot(spark, sf):
    """Highest rates of a model over endpoints and their time-of-day overrides."""
    s = D.table(spark, sf, "supplier").join(D.table(spark, sf, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    k = F.col("s_suppkey").cast("decimal(20,0)")
    nano = F.lit("0.000000001").cast("decimal(12,10)")

    def usd(times):
        return (k * nano * F.lit(times).cast("decimal(4,1)")).cast("string")

    none = F.lit(None).cast("string")
    pricing = F.struct(
        usd(1).alias("prompt"), usd(3).alias("completion"), F.when(F.col("s_suppkey") % 2 == 0, usd(0.1)).alias("cache_read"), none.alias("cache_write")
    )
    override = F.struct(usd(2).alias("prompt"), none.alias("completion"), none.alias("cache_read"), none.alias("cache_write"))
    endpoints = s.select(
        F.col("n_name").alias("model"), pricing.alias("pricing"), F.when(F.col("s_suppkey") % 4 == 1, F.array(override)).alias("overrides")
    )
    return K.snapshot_price(endpoints, ["model"])


@query(
    "estimated_tokens",
    f"SELECT conv_id, {n('sum(512 + ceil(strlen(text) / 2))', 'estimated')} FROM conversations GROUP BY 1",
)
def estimated_tokens(spark, sf):
    """Pessimistic token estimate of every request from its bytes."""
    c = D.table(spark, sf, "conversations")
    return c.groupBy("conv_id").agg(F.sum(K.estimate_input_tokens(F.col("text"))).alias("estimated"))


@query(
    "capacity_ceilings",
    f"""WITH s AS (SELECT user_id % 50 AS system, avg(value) AS latency, count(*) / 10.0 AS tokens FROM events GROUP BY 1),
    c AS (SELECT system, unnest([{{'qps': 1000 / tokens, 'why': 'tokens'}}, {{'qps': CASE WHEN system % 3 <> 0 THEN 12.5::DOUBLE END, 'why': 'requests'}}, {{'qps': 16 * 1000.0 / latency / 20, 'why': 'in flight'}}]) AS x FROM s)
    SELECT system::BIGINT AS system, {r('min(x.qps)', 'qps')}, arg_min(x.why, x.qps) AS why FROM c WHERE x.qps IS NOT NULL GROUP BY 1""",
)
def capacity_ceilings(spark, sf):
    """The least of several limits of every service, and which one binds."""
    s = D.table(spark, sf, "events").groupBy((F.col("user_id") % 50).alias("system")).agg(
        F.avg("value").alias("latency"), (F.count(F.lit(1)) / 10.0).alias("tokens")
    )
    qps, why = capacity_ceiling(
        [
            (1000 / F.col("tokens"), F.lit("tokens")),
            (F.when(F.col("system") % 3 != 0, F.lit(12.5)), F.lit("requests")),
            (16 * 1000.0 / F.col("latency") / 20, F.lit("in flight")),
        ]
    )
    return s.select("system", qps.alias("qps"), why.alias("why"))


@query(
    "run_summary",
    f"""WITH l AS ({LATEST})
    SELECT system_id, benchmark, {n('count(*)', 'n_items')}, {n('count(*) FILTER (WHERE NOT ok)', 'n_errors')}, {n('count(*) FILTER (WHERE ok AND cached)', 'n_cached')}, {r('sum(cost_usd)', 'spent_usd')},
      {r('quantile_cont(latency_ms, 0.5) FILTER (WHERE ok)', 'latency_p50_ms')}, {r('quantile_cont(latency_ms, 0.95) FILTER (WHERE ok)', 'latency_p95_ms')} FROM l GROUP BY 1, 2""",
    ("records",),
)
def run_summary(spark, sf):
    """Errors, cache hits, spend and latency percentiles of every run."""
    rows = latest(spark, sf)
    counts = R.run_counts(rows, ["system_id", "benchmark"]).drop("n_ok")
    return counts.join(S.latency_percentiles(rows.where("ok"), ["system_id", "benchmark"]), ["system_id", "benchmark"], "left")
