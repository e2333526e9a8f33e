"""Answer-log queries: latest records, work left, alignment, diffs, dedupe, logged payloads."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from plumbline.operators import alignment as A
from plumbline.operators import records as R
from plumbline.functions import vectors as V
from plumbline.queries import derived as D
from plumbline.queries.registry import n, query, r
from plumbline.session import ensure_checkpoint_dir
from plumbline.sources import chatlog, writers

LATEST = """SELECT system_id, benchmark, item_id, arg_max(line_no, (ok::INTEGER, line_no)) AS line_no, arg_max(ok, (ok::INTEGER, line_no)) AS ok,
  arg_max(latency_ms, (ok::INTEGER, line_no)) AS latency_ms, arg_max(cost_usd, (ok::INTEGER, line_no)) AS cost_usd, arg_max(cached, (ok::INTEGER, line_no)) AS cached, count(*) AS n_attempts
  FROM records GROUP BY 1, 2, 3"""


def latest(spark, sf):
    return R.latest_records(D.records(spark, sf))


def expected_items(spark, sf):
    """Items of the split: every user and day of January seen by system s0, and some never tried."""
    e = D.table(spark, sf, "events")
    return e.select(
        F.concat(F.lit("b"), (F.col("user_id") % 4).cast("string")).alias("benchmark"),
        F.concat_ws("-", F.col("user_id").cast("string"), F.date_format("ts", "yyyy-MM-dd")).alias("item_id"),
    ).distinct()


_ITEMS = "SELECT DISTINCT 'b' || (user_id % 4) AS benchmark, user_id || '-' || strftime(ts, '%Y-%m-%d') AS item_id FROM events"


@query(
    "latest_records",
    f"SELECT system_id, benchmark, item_id, line_no, ok, {r('latency_ms', 'latency_ms')}, {r('cost_usd', 'cost_usd')}, cached, n_attempts FROM ({LATEST})", ("records",),
)
def latest_records(spark, sf):
    return latest(spark, sf).select(
        "system_id", "benchmark", "item_id", "line_no", "ok", "latency_ms", "cost_usd", "cached", "n_attempts"
    )


@query(
    "run_counts",
    f"""SELECT system_id, benchmark, {n('count(*)', 'n_items')}, {n('count(*) FILTER (WHERE ok)', 'n_ok')}, {n('count(*) FILTER (WHERE NOT ok)', 'n_errors')},
      {n('count(*) FILTER (WHERE ok AND cached)', 'n_cached')}, {r('sum(cost_usd)', 'spent_usd')} FROM ({LATEST}) GROUP BY 1, 2""",
    ("records",),
)
def run_counts(spark, sf):
    return R.run_counts(latest(spark, sf), ["system_id", "benchmark"])


@query(
    "total_spend",
    f"""WITH l AS ({LATEST}), f AS (SELECT system_id, benchmark, item_id, sum(cost_usd) AS failed FROM records WHERE NOT ok GROUP BY 1, 2, 3)
    SELECT system_id, benchmark, {r('sum(CASE WHEN ok THEN cost_usd + coalesce(failed, 0) ELSE failed END)', 'spent_usd')} FROM l LEFT JOIN f USING (system_id, benchmark, item_id) GROUP BY 1, 2""",
    ("records",),
)
def total_spend(spark, sf):
    """Spend of the recorded items, what their failed attempts were billed included."""
    return R.with_total_spend(D.records(spark, sf)).groupBy("system_id", "benchmark").agg(F.sum("cost_usd").alias("spent_usd"))


@query(
    "answered_and_failed",
    f"SELECT system_id, ok, {n('count(*)', 'n')}, {r('avg(latency_ms)', 'latency_ms')} FROM ({LATEST}) GROUP BY 1, 2", ("records",),
)
def answered_and_failed(spark, sf):
    return latest(spark, sf).groupBy("system_id", "ok").agg(F.count(F.lit(1)).alias("n"), F.avg("latency_ms").alias("latency_ms"))


@query(
    "items_to_answer",
    f"SELECT i.benchmark, i.item_id FROM ({_ITEMS}) i WHERE NOT EXISTS (SELECT 1 FROM records r WHERE r.system_id = 's0' AND r.ok AND r.item_id = i.item_id AND r.benchmark = i.benchmark)", ("records",),
)
def items_to_answer(spark, sf):
    """Items system s0 never answered or last failed."""
    return R.to_answer(expected_items(spark, sf), latest(spark, sf).where("system_id = 's0'"))


@query(
    "foreign_records",
    f"SELECT benchmark, item_id FROM ({LATEST}) WHERE system_id = 's1' AND item_id NOT LIKE '%-2024-01-0%'", ("records",),
)
def foreign_records(spark, sf):
    """Records of items outside a split that covers the first nine days."""
    split = expected_items(spark, sf).where(F.col("item_id").like("%-2024-01-0%"))
    return R.foreign_records(latest(spark, sf).where("system_id = 's1'"), split).select("benchmark", "item_id")


@query(
    "answered_items",
    f"SELECT benchmark, item_id, line_no, {r('latency_ms', 'latency_ms')} FROM ({LATEST}) WHERE system_id = 's2' AND ok", ("records",),
)
def answered_items(spark, sf):
    """Items of the split with their successful record."""
    joined = R.answered_items(expected_items(spark, sf), latest(spark, sf).where("system_id = 's2'"))
    return joined.select("benchmark", "item_id", "line_no", "latency_ms")


@query(
    "complete_benchmarks",
    f"""WITH l AS ({LATEST}), e AS (SELECT benchmark, count(*) AS n_items FROM ({_ITEMS}) GROUP BY 1)
    SELECT system_id, benchmark, {n('count(*)', 'n_tried')}, {n("count(*) FILTER (WHERE NOT ok AND split_part(item_id, '-', 1)::BIGINT % 2 = 1)", 'n_undeclared')},
      count(*) = any_value(n_items) AND count(*) FILTER (WHERE NOT ok AND split_part(item_id, '-', 1)::BIGINT % 2 = 1) = 0 AS complete
    FROM l JOIN e USING (benchmark) GROUP BY 1, 2""",
    ("records",),
)
def complete_benchmarks(spark, sf):
    """Which runs are complete when failures of even users are declared."""
    items = expected_items(spark, sf)
    expected = items.groupBy("benchmark").agg(F.count(F.lit(1)).alias("n_items"))
    declared = items.where(F.split("item_id", "-")[0].cast("bigint") % 2 == 0)
    return R.complete_benchmarks(latest(spark, sf), expected, declared)


@query(
    "protocol_violations",
    f"""SELECT system_id, benchmark, reason, {n('count(*)', 'n')} FROM (
      SELECT *, CASE WHEN NOT ok THEN 'unanswered' WHEN n_attempts <> 1 THEN 'calls' END AS reason FROM ({LATEST})) WHERE reason IS NOT NULL GROUP BY 1, 2, 3""",
    ("records",),
)
def protocol_violations(spark, sf):
    """Records that were not answered in exactly one call."""
    rows = latest(spark, sf).withColumnRenamed("n_attempts", "n_calls")
    return R.protocol_violations(rows).groupBy("system_id", "benchmark", "reason").agg(F.count(F.lit(1)).alias("n"))


@query(
    "duplicate_ids",
    f"SELECT sha256(text) AS id, {n('count(*)', 'n')}, {n('min(doc_id)', 'first_at')}, {n('max(doc_id)', 'last_at')} FROM documents GROUP BY 1 HAVING count(*) > 1",
)
def duplicate_ids(spark, sf):
    """Documents whose content hash occurs more than once."""
    d = D.table(spark, sf, "documents").select(F.sha2("text", 256).alias("id"), "doc_id")
    return R.duplicate_ids(d, ["id"], "doc_id")


@query(
    "cached_responses",
    f"SELECT sha256(model || chr(10) || request) AS key, arg_min(response, created) AS response, {n('min(created)', 'created')}, {n('count(*)', 'n_seen')} FROM responses GROUP BY 1", ("responses",),
)
def cached_responses(spark, sf):
    """The first stored response of every (model, request)."""
    return R.first_responses(D.responses(spark, sf)).select("key", "response", "created", "n_seen")


@query(
    "cache_hits",
    f"""WITH s AS (SELECT sha256(model || chr(10) || request) AS key, arg_min(response, created) AS response FROM responses WHERE created % 2000 < 1000 GROUP BY 1)
    SELECT model, {n('count(*)', 'n')}, {n('count(s.key)', 'n_hits')} FROM responses q LEFT JOIN s ON s.key = sha256(q.model || chr(10) || q.request) GROUP BY 1""",
    ("responses",),
)
def cache_hits(spark, sf):
    """Requests answered from a store of half the conversations."""
    q = D.responses(spark, sf)
    store = R.first_responses(q.where("created % 2000 < 1000"))
    return R.cache_lookup(q.drop("response"), store).groupBy("model").agg(F.count(F.lit(1)).alias("n"), F.count_if("hit").alias("n_hits"))


# --- alignment -------------------------------------------------------------------------------------


def partial_systems(spark, sf):
    """Three systems with different gaps; system c disagrees on some gold."""
    p = D.preds(spark, sf).select("system", "benchmark", "item_id", "keys", "gold_idx")
    i = F.col("item_id").cast("bigint")
    third = p.where("system = 'a'").withColumn("system", F.lit("c")).withColumn(
        "gold_idx", F.when(i % 50 == 0, (F.col("gold_idx") + 1) % 10).otherwise(F.col("gold_idx"))
    )
    return (
        p.where((F.col("system") == "b") | (i % 5 != 0))
        .unionByName(third.where((i % 7 != 0) & (F.col("benchmark") != "b3")))
    )


_PARTIAL = """partial AS (
  SELECT system, benchmark, item_id, gold_idx FROM preds WHERE system = 'b' OR item_id::BIGINT % 5 <> 0
  UNION ALL SELECT 'c', benchmark, item_id, CASE WHEN item_id::BIGINT % 50 = 0 THEN (gold_idx + 1) % 10 ELSE gold_idx END FROM preds
  WHERE system = 'a' AND item_id::BIGINT % 7 <> 0 AND benchmark <> 'b3')"""


@query(
    "aligned_systems",
    f"""WITH {_PARTIAL}, ok AS (SELECT benchmark, item_id FROM partial GROUP BY 1, 2 HAVING count(*) = 3 AND count(DISTINCT gold_idx) = 1)
    SELECT system, benchmark, item_id FROM partial JOIN ok USING (benchmark, item_id) WHERE benchmark <> 'b3'""",
    ("preds",),
)
def aligned_systems(spark, sf):
    """Rows of items every system answered, in benchmarks every system has."""
    return A.align(partial_systems(spark, sf), 3, disagreeing="leave out").select("system", "benchmark", "item_id")


@query(
    "disagreeing_items",
    f"WITH {_PARTIAL} SELECT benchmark, item_id FROM partial GROUP BY 1, 2 HAVING count(DISTINCT system) = 2 AND count(DISTINCT gold_idx) > 1", ("preds",),
)
def disagreeing_items(spark, sf):
    """Items two systems answered with different gold."""
    return A.shared_items(partial_systems(spark, sf), 2).where("disagrees").select("benchmark", "item_id")


@query(
    "alignment_left_out",
    f"""WITH {_PARTIAL} SELECT benchmark, {n('count(*)', 'n_any')}, {n('count(*) FILTER (WHERE c = 3)', 'n_all')}, {n('count(*) FILTER (WHERE c < 3)', 'n_left_out')} FROM (
      SELECT benchmark, item_id, count(*) AS c FROM partial GROUP BY 1, 2) GROUP BY 1""",
    ("preds",),
)
def alignment_left_out(spark, sf):
    return A.left_out(partial_systems(spark, sf), 3)


@query(
    "one_sided_items",
    f"""WITH {_PARTIAL}, a AS (SELECT * FROM partial WHERE system = 'a'), c AS (SELECT * FROM partial WHERE system = 'c')
    SELECT coalesce(a.benchmark, c.benchmark) AS benchmark, coalesce(a.item_id, c.item_id) AS item_id, CASE WHEN a.item_id IS NULL THEN 'a' ELSE 'b' END AS side
    FROM a FULL JOIN c ON a.item_id = c.item_id WHERE (a.item_id IS NULL OR c.item_id IS NULL) AND NOT (c.item_id IS NULL AND a.benchmark = 'b3')""",
    ("preds",),
)
def one_sided_items(spark, sf):
    """Items only one of two systems answered that are not declared unanswered."""
    p = partial_systems(spark, sf)
    declared = D.preds(spark, sf).where("system = 'a' AND benchmark = 'b3'").select("benchmark", "item_id", F.lit("b").alias("side"))
    return A.one_sided(p.where("system = 'a'"), p.where("system = 'c'"), declared)


@query(
    "field_differences",
    f"""SELECT s_name AS name, s_nationkey::VARCHAR AS recorded, n.n_regionkey::VARCHAR AS current FROM supplier LEFT JOIN nation n ON s_nationkey = n_nationkey AND s_suppkey % 10 <> 3
    WHERE s_nationkey::VARCHAR IS DISTINCT FROM n.n_regionkey::VARCHAR""",
)
def field_differences(spark, sf):
    """Fields whose recorded and current values differ or are missing on one side."""
    s = D.table(spark, sf, "supplier")
    nation = D.table(spark, sf, "nation")
    recorded = s.select(F.col("s_name").alias("name"), F.col("s_nationkey").cast("string").alias("value"))
    current = s.where("s_suppkey % 10 <> 3").join(nation, F.col("s_nationkey") == F.col("n_nationkey")).select(
        F.col("s_name").alias("name"), F.col("n_regionkey").cast("string").alias("value")
    )
    return A.field_differences(recorded, current)


@query(
    "data_diff",
    f"""WITH o AS (SELECT l_suppkey AS k, avg(l_discount) AS discount, avg(l_tax) AS tax FROM lineitem GROUP BY 1),
    t AS (SELECT k, round(discount, 3) AS discount, round(tax, 3) AS tax FROM o WHERE k % 25 <> 7),
    lo AS (SELECT k, 'discount' AS metric, discount AS ours FROM o UNION ALL SELECT k, 'tax', tax FROM o),
    lt AS (SELECT k, 'discount' AS metric, discount AS theirs FROM t UNION ALL SELECT k, 'tax', tax FROM t)
    SELECT k, metric, {r('ours', 'ours')}, {r('theirs', 'theirs')} FROM lo LEFT JOIN lt USING (k, metric) WHERE theirs IS NULL OR abs(ours - theirs) > 0.0004""",
)
def data_diff(spark, sf):
    """Recomputed aggregates against recorded ones within a tolerance."""
    li = D.table(spark, sf, "lineitem")
    ours = li.groupBy(F.col("l_suppkey").alias("k")).agg(F.avg("l_discount").alias("discount"), F.avg("l_tax").alias("tax"))
    theirs = ours.where("k % 25 <> 7").select("k", F.round("discount", 3).alias("discount"), F.round("tax", 3).alias("tax"))
    return A.data_diff(ours, theirs, ["k"], ["discount", "tax"], 0.0004)


@query(
    "recording_join",
    f"""WITH e AS (SELECT event_type, user_id, strftime(ts, '%Y-%m-%d') AS day, sum(value) AS v FROM events GROUP BY 1, 2, 3)
    SELECT a.day, {n('count(*)', 'n')}, {r('avg(abs(a.v - b.v))', 'mean_delta')} FROM e a JOIN e b ON a.user_id = b.user_id AND a.day = b.day
      WHERE a.event_type = 'click' AND b.event_type = 'view' GROUP BY 1""",
)
def recording_join(spark, sf):
    """Two recordings joined on several keys."""
    e = D.table(spark, sf, "events").groupBy("event_type", "user_id", F.date_format("ts", "yyyy-MM-dd").alias("day")).agg(F.sum("value").alias("v"))
    a = e.where("event_type = 'click'").drop("event_type")
    b = e.where("event_type = 'view'").select("user_id", "day", F.col("v").alias("w"))
    return a.join(b, ["user_id", "day"]).groupBy("day").agg(
        F.count(F.lit(1)).alias("n"), F.avg(F.abs(F.col("v") - F.col("w"))).alias("mean_delta")
    )


@query(
    "paired_items",
    f"""SELECT a.benchmark, a.item_id, a.correct AS correct_a, b.correct AS correct_b, {r('a.nll', 'nll_a')}, {r('b.nll', 'nll_b')} FROM scored_choice a JOIN scored_choice b
      ON a.item_id = b.item_id AND a.benchmark = b.benchmark AND a.system = 'a' AND b.system = 'b' WHERE a.item_id::BIGINT % 5 <> 0""",
    ("scored_choice",),
)
def paired_items(spark, sf):
    """Items both systems answered, side by side."""
    from plumbline.functions.scores import with_scores

    s = with_scores(D.preds(spark, sf)).where((F.col("system") == "b") | (F.col("item_id").cast("bigint") % 5 != 0))
    return A.pair_systems(s, "a", "b", ["correct", "nll"])


_SETTING = "CASE WHEN system_id = 's1' AND benchmark = 'b2' THEN 'hot' ELSE 'cold' END"


@query(
    "protocol_breaches",
    f"""WITH l AS ({LATEST}), items AS (SELECT benchmark, item_id FROM ({_ITEMS}) WHERE item_id LIKE '%-2024-01-0%' OR item_id LIKE '%-2024-01-1%'), sz AS (SELECT benchmark, count(*) AS k FROM items GROUP BY 1),
    c AS (SELECT s.system_id, sz.benchmark, sz.k, (SELECT count(*) FROM l JOIN items i ON i.benchmark = l.benchmark AND i.item_id = l.item_id WHERE l.system_id = s.system_id AND l.benchmark = sz.benchmark) AS inside,
      (SELECT count(*) FROM l WHERE l.system_id = s.system_id AND l.benchmark = sz.benchmark) AS recs FROM (SELECT DISTINCT system_id FROM l) s, sz),
    u AS (SELECT system_id, benchmark, 'missing' AS reason, k - inside AS n FROM c UNION ALL SELECT system_id, benchmark, 'foreign', recs - inside FROM c
      UNION ALL SELECT system_id, benchmark, CASE WHEN NOT ok THEN 'unanswered' WHEN n_attempts <> 1 THEN 'calls' END AS reason, count(*) FROM l GROUP BY 1, 2, 3
      UNION ALL SELECT DISTINCT system_id, benchmark, 'settings', 1 FROM l WHERE system_id = 's1' AND benchmark = 'b2')
    SELECT system_id, benchmark, reason, {n('n', 'n')} FROM u WHERE reason IS NOT NULL AND n > 0""",
    ("records",),
)
def protocol_breaches(spark, sf):
    """Every way the runs break the protocol of a split of nineteen days: missing and foreign items,
    failures, repeated calls, and a benchmark that was run with another setting."""
    rows = latest(spark, sf).withColumnRenamed("n_attempts", "n_calls")
    split = expected_items(spark, sf).where(F.col("item_id").like("%-2024-01-0%") | F.col("item_id").like("%-2024-01-1%"))
    runs = rows.select("system_id", "benchmark").distinct()
    odd = (F.col("system_id") == "s1") & (F.col("benchmark") == "b2")
    settings = runs.select("system_id", "benchmark", F.lit("sampling").alias("name"), F.when(odd, "hot").otherwise("cold").alias("value"))
    settings = settings.unionByName(runs.select("system_id", "benchmark", F.lit("top_k").alias("name"), F.lit("20").alias("value")))
    return R.protocol_breaches(rows, split, settings)


# --- manifests -------------------------------------------------------------------------------------


def manifest_runs(spark, sf):
    """What each system's runs look like after their invocations of even, then of all days."""
    calls = D.invocations(spark, sf).withColumn("even", F.substring("day", 10, 1).cast("int") % 2 == 0)
    call = F.struct(
        F.col("started").alias("started_at"), F.col("finished").alias("finished_at"), F.when(F.col("finished").isNull(), "running").otherwise("finished").alias("status"),
        F.col("concurrency").cast("int").alias("concurrency"), F.col("n_called").cast("bigint").alias("n_called"), F.lit(0).cast("bigint").alias("n_errors"),
        F.col("n_cache_hits").cast("bigint").alias("n_cache_hits"), F.lit(0.0).alias("spent_usd"),
    )
    both = calls.withColumn("writer", F.explode(F.when(F.col("even"), F.array(F.lit("even"), F.lit("all"))).otherwise(F.array(F.lit("all")))))
    runs = both.groupBy("writer", "system_id").agg(F.sort_array(F.collect_list(call)).alias("invocations"), F.sum("n_called").cast("bigint").alias("n_items"))
    return runs.select(
        "writer", "system_id", F.lit("b0.holdout").alias("run_key"), F.lit("b0").alias("benchmark"), F.lit("holdout").alias("split"), F.lit("complete").alias("status"),
        "n_items", F.col("n_items").alias("n_ok"), F.lit(0).cast("bigint").alias("n_errors"), F.lit(0.0).alias("spent_usd"), "invocations",
    )


@query(
    "committed_manifest",
    f"""SELECT system_id, 'b0.holdout' AS run_key, {n('sum(n_called)', 'n_items')}, {n('count(*)', 'n_invocations')}, {n('count(*) FILTER (WHERE finished IS NOT NULL)', 'n_finished')}, {n('sum(n_called)', 'n_called')}, {n('2', 'version')} FROM invocations GROUP BY 1""",
    ("invocations",),
)
def committed_manifest(spark, sf):
    """A manifest that two writers published to and one of them again: every invocation once."""
    ensure_checkpoint_dir(spark)
    folder = f"{spark.sparkContext.getCheckpointDir()}/manifest-{uuid.uuid4().hex}"
    runs = manifest_runs(spark, sf)
    for writer in ("even", "all", "even"):
        version = writers.commit_manifest(runs.where(F.col("writer") == writer), folder)
    held = writers.read_manifest(spark, folder)
    total = lambda f: F.aggregate("invocations", F.lit(0).cast("bigint"), lambda a, i: a + i[f])
    return held.select(
        "system_id", "run_key", "n_items", F.size("invocations").alias("n_invocations"), F.size(F.filter("invocations", lambda i: i["finished_at"].isNotNull())).alias("n_finished"),
        total("n_called").alias("n_called"), F.lit(version).cast("bigint").alias("version"),
    )


# --- logged payloads -------------------------------------------------------------------------------


def payloads(spark, sf):
    """Chat-completion replies as logged JSON."""
    topk = D.token_topk(spark, sf)
    listed = topk.groupBy("request_id").agg(
        F.sort_array(F.collect_list(F.struct("rank", "token", "logprob"))).alias("t")
    )
    top = F.transform("t", lambda x: F.struct(x["token"].alias("token"), x["logprob"].alias("logprob")))
    i = F.col("request_id").cast("bigint")
    first = F.struct(F.get(top, F.lit(0))["token"].alias("token"), F.get(top, F.lit(0))["logprob"].alias("logprob"), top.alias("top_logprobs"))
    body = F.struct(
        F.array(F.struct(F.lit("stop").alias("finish_reason"), F.struct(F.array(first).alias("content")).alias("logprobs"))).alias("choices"),
        F.struct(
            (i + 20).alias("prompt_tokens"), F.lit(1).alias("completion_tokens"),
            F.struct((i % 10).alias("cached_tokens")).alias("prompt_tokens_details"),
            F.struct(F.when(i % 4 == 0, i % 3).alias("reasoning_tokens")).alias("completion_tokens_details"),
        ).alias("usage"),
    )
    return listed.select("request_id", F.to_json(body).alias("payload"))


@query("payload_topk", f"SELECT request_id, rank::BIGINT AS rank, token, {r('logprob', 'logprob')} FROM token_topk", ("token_topk",))
def payload_topk(spark, sf):
    """First-token alternatives read back from logged replies."""
    return chatlog.first_token_topk(payloads(spark, sf))


@query(
    "payload_usage",
    f"""SELECT vec_id::VARCHAR AS request_id, {n('vec_id + 20', 'input_tokens')}, 1::BIGINT AS output_tokens, {n('vec_id % 10', 'cached_tokens')}, 0::BIGINT AS cache_write_tokens,
      {n('CASE WHEN vec_id % 4 = 0 THEN vec_id % 3 END', 'reasoning_tokens')} FROM embeddings""",
)
def payload_usage(spark, sf):
    return chatlog.usage_rows(payloads(spark, sf))


_LINES = """SELECT 'run' || (user_id % 10) AS file, event_id AS line_no, CASE event_type
    WHEN 'click' THEN 'vllm-1  | INFO 01-02 03:04:05 [model.py:1] Model loading took ' || value || ' GiB memory and ' || (user_id % 50) || ' seconds'
    WHEN 'view' THEN 'vllm-1  | INFO 01-02 03:04:05 [kv.py:2] GPU KV cache size: ' || (event_id // 1000) || ',' || lpad((event_id % 1000)::VARCHAR, 3, '0') || ' tokens'
    WHEN 'error' THEN 'vllm-1  | WARNING 01-02 03:04:05 [core.py:3] slow step ' || (user_id % 3)
    ELSE 'vllm-1  | "GET / HTTP/1.1" 200' END AS value FROM events"""


def server_lines(spark, sf):
    e = D.table(spark, sf, "events")
    head = "vllm-1  | INFO 01-02 03:04:05 "
    text = (
        F.when(F.col("event_type") == "click", F.concat(F.lit(head + "[model.py:1] Model loading took "), F.col("value").cast("string"), F.lit(" GiB memory and "), (F.col("user_id") % 50).cast("string"), F.lit(" seconds")))
        .when(F.col("event_type") == "view", F.concat(F.lit(head + "[kv.py:2] GPU KV cache size: "), F.floor(F.col("event_id") / 1000).cast("string"), F.lit(","), F.lpad((F.col("event_id") % 1000).cast("string"), 3, "0"), F.lit(" tokens")))
        .when(F.col("event_type") == "error", F.concat(F.lit("vllm-1  | WARNING 01-02 03:04:05 [core.py:3] slow step "), (F.col("user_id") % 3).cast("string")))
        .otherwise('vllm-1  | "GET / HTTP/1.1" 200')
    )
    return e.select(F.concat(F.lit("run"), (F.col("user_id") % 10).cast("string")).alias("file"), F.col("event_id").alias("line_no"), text.alias("value"))


def kernel_log(spark, sf):
    """Server lines with commands and kernel messages."""
    e = D.table(spark, sf, "events")
    head = "vllm-1  | (EngineCore pid=7) INFO 01-02 03:04:05 [linear.py:9] "
    text = (
        F.when(F.col("event_type") == "click", F.concat(F.lit(head + "Using Marlin kernel for layer "), (F.col("user_id") % 40).cast("string")))
        .when(F.col("event_type") == "view", F.concat(F.lit("vllm-1  | vllm serve m --quantization awq --port "), F.col("event_id").cast("string")))
        .when(F.col("event_type") == "error", F.concat(F.lit("vllm-1  | INFO 01-02 03:04:05 [core.py:5] Initializing a V1 LLM engine (v1) with config: quantization=fp"), (F.col("event_id") % 9).cast("string"), F.lit(", seed=0")))
        .otherwise("vllm-1  | nothing to see")
    )
    return e.select(F.concat(F.lit("run"), (F.col("user_id") % 10).cast("string")).alias("file"), F.col("event_id").alias("line_no"), text.alias("value"))


@query(
    "server_log_texts",
    """SELECT 'run' || (user_id % 10) AS file, arg_min('vllm serve m --quantization awq --port ' || event_id, event_id) FILTER (WHERE event_type = 'view') AS serve_command,
      arg_min('fp' || (event_id % 9), event_id) FILTER (WHERE event_type = 'error') AS quantization FROM events GROUP BY 1""",
)
def server_log_texts(spark, sf):
    """The first serve command and quantization that each server log states."""
    return chatlog.log_texts(kernel_log(spark, sf))


@query(
    "server_log_kernels",
    f"""WITH f AS (SELECT 'run' || (user_id % 10) AS file, 'Using Marlin kernel for layer ' || (user_id % 40) AS message, min(event_id) AS first_at FROM events WHERE event_type = 'click' GROUP BY 1, 2)
    SELECT file, {n('k', 'rank')}, message FROM (SELECT *, row_number() OVER (PARTITION BY file ORDER BY first_at) AS k FROM f) WHERE k <= 25""",
)
def server_log_kernels(spark, sf):
    """The first different kernel messages of every server log, in order."""
    return chatlog.kernel_lines(kernel_log(spark, sf))


@query(
    "server_log_facts",
    f"""WITH l AS ({_LINES})
    SELECT file, {r("arg_min(TRY_CAST(regexp_extract(value, 'Model loading took ([0-9.]+) GiB memory', 1) AS DOUBLE), line_no) FILTER (WHERE value LIKE '%Model loading took%')", 'weights_gib')},
      {r("arg_min(TRY_CAST(regexp_extract(value, 'GiB memory and ([0-9.]+) seconds', 1) AS DOUBLE), line_no) FILTER (WHERE value LIKE '%Model loading took%')", 'load_seconds')},
      {r("arg_min(TRY_CAST(replace(regexp_extract(value, 'cache size: ([0-9,]+) tokens', 1), ',', '') AS DOUBLE), line_no) FILTER (WHERE value LIKE '%cache size%')", 'kv_cache_tokens')} FROM l GROUP BY 1""",
)
def server_log_facts(spark, sf):
    """The first memory, load-time and cache facts of every server log."""
    wanted = {k: chatlog.LOG_FACTS[k] for k in ("weights_gib", "load_seconds", "kv_cache_tokens")}
    return chatlog.log_facts(server_lines(spark, sf), wanted)


@query(
    "server_log_warnings",
    f"SELECT file, 'WARNING' AS level, 'slow step ' || right(value, 1) AS message, {n('count(*)', 'n')} FROM ({_LINES}) WHERE value LIKE '%WARNING%' GROUP BY 1, 2, 3",
)
def server_log_warnings(spark, sf):
    return chatlog.log_warnings(server_lines(spark, sf))


def structured_payloads(spark, sf):
    """Structured replies ``{"answer":"<letter>"}`` whose value starts a token of its own, follows a
    token that ends in the quote, or never comes."""
    p = D.preds(spark, sf)
    i = F.col("item_id").cast("bigint")
    lp = lambda x: F.round(F.ln(F.greatest(x, F.lit(1e-6))), 9)
    value = F.get("keys", F.col("choice_idx"))
    chosen = lp(F.get("probs", F.col("choice_idx")))
    alone = F.transform("keys", lambda k, j: F.struct(k.alias("token"), lp(F.get("probs", j)).alias("logprob")))
    merged = F.transform("keys", lambda k, j: F.struct(F.concat(F.lit('":"'), k).alias("token"), lp(F.get("probs", j)).alias("logprob")))

    def token(text, logprob, top):
        return F.struct(text.alias("token"), logprob.alias("logprob"), top.alias("top_logprobs"))

    def only(text):
        return token(F.lit(text), F.lit(0.0), F.array(F.struct(F.lit(text).alias("token"), F.lit(0.0).alias("logprob"))))

    split = F.array(only('{"'), only("answer"), only('":"'), token(value, chosen, alone), only('"}'))
    joined = F.array(only('{"'), only("answer"), token(F.concat(F.lit('":"'), value), chosen, merged), only('"}'))
    stuck = F.array(only("\n"), only("\n"))
    content = F.when(i % 10 == 9, stuck).when(i % 2 == 0, split).otherwise(joined)
    usage = F.struct((i % 50 + 100).alias("prompt_tokens"), F.size(content).alias("completion_tokens"))
    body = F.struct(F.array(F.struct(F.struct(content.alias("content")).alias("logprobs"))).alias("choices"), usage.alias("usage"))
    request = F.concat_ws(":", "system", "item_id").alias("request_id")
    return p.select(request, "system", "benchmark", "item_id", F.to_json(body).alias("payload"), F.col("keys").alias("values"))


@query(
    "structured_replies",
    f"""WITH p AS (SELECT system, item_id, unnest(keys) AS value, unnest(list_transform(probs, lambda x: round(ln(greatest(x, 1e-6)), 9))) AS lp, unnest(range(0, 10)) AS pos, choice_idx FROM preds),
    t AS (SELECT *, ln(sum(exp(lp)) OVER (PARTITION BY system, item_id)) AS total FROM p)
    SELECT system || ':' || item_id AS request_id, value, {r('least(lp - CASE WHEN item_id::BIGINT % 2 = 1 THEN total ELSE 0 END, 0)', 'logprob')}, pos = choice_idx AS sampled, NULL::VARCHAR AS failure FROM t WHERE item_id::BIGINT % 10 <> 9
    UNION ALL SELECT system || ':' || item_id, NULL, NULL, NULL, 'stuck' FROM preds WHERE item_id::BIGINT % 10 = 9""",
    ("preds",),
)
def structured_replies(spark, sf):
    """Distributions over the allowed values read where a structured reply's value starts."""
    return chatlog.structured_reads(structured_payloads(spark, sf))


@query(
    "structured_profile",
    f"""WITH p AS (SELECT system, benchmark, item_id, probs, item_id::BIGINT AS i, list_transform(probs, lambda x: greatest(x, 1e-6)) AS q FROM preds),
    e AS (SELECT *, list_reduce(q, lambda a, y: a + y) AS total, i % 10 <> 9 AS ok, list_position(q, list_max(q)) AS top,
      CASE WHEN i % 4 = 3 THEN NULL WHEN i % 4 = 2 THEN 1 + i % 10 ELSE list_position(probs, list_max(probs)) END AS was FROM p),
    b AS (SELECT system, benchmark, CASE WHEN i % 2 = 0 THEN 3 ELSE 2 END AS tok, count(*) AS k FROM e WHERE ok GROUP BY 1, 2, 3)
    SELECT system, benchmark, {n('count(*)', 'n')}, {n('count(*) FILTER (WHERE ok)', 'n_read')},
      {r('avg(CASE WHEN i % 2 = 1 THEN 1 ELSE total END) FILTER (WHERE ok)', 'mass_mean')}, {r('min(CASE WHEN i % 2 = 1 THEN 1 ELSE total END) FILTER (WHERE ok)', 'mass_min')},
      {r('avg(0) FILTER (WHERE ok)', 'missing_per_item')}, {n('count(*) FILTER (WHERE ok AND i % 2 = 1)', 'n_merged')},
      {n('count(*) FILTER (WHERE ok AND was IS NOT NULL)', 'n_compared')}, {n('count(*) FILTER (WHERE ok AND was = top)', 'n_agree')},
      {r('1000 * avg((i % 50 + 100) * 1e-6 + (CASE WHEN i % 2 = 0 THEN 5 ELSE 4 END) * 4e-6) FILTER (WHERE ok)', 'usd_per_1k_items')},
      {r('avg(CASE WHEN i % 2 = 0 THEN 5 ELSE 4 END) FILTER (WHERE ok)', 'completion_mean')},
      CASE WHEN count(*) FILTER (WHERE NOT ok) > 0 THEN 'stuck=' || count(*) FILTER (WHERE NOT ok) END AS failures,
      (SELECT string_agg(tok || '=' || k, ',' ORDER BY tok) FROM b WHERE b.system = e.system AND b.benchmark = e.benchmark) AS value_positions
    FROM e GROUP BY system, benchmark""",
    ("preds",),
)
def structured_profile(spark, sf):
    """Replies read, failures by reason, label mass, the token a value starts in, agreement with an
    older read of the same request and cost, per system and benchmark."""
    p = structured_payloads(spark, sf)
    reads = chatlog.structured_reads(p)
    i = F.col("item_id").cast("bigint")
    older = D.preds(spark, sf).where(i % 4 != 3).select(
        F.concat_ws(":", "system", "item_id").alias("request_id"), F.when(i % 4 == 2, F.get("keys", (i % 10).cast("int"))).otherwise(F.get("keys", V.argmax(F.col("probs")))).alias("value")
    )
    usage = chatlog.usage_rows(p)
    costs = usage.select("request_id", "output_tokens", (F.col("input_tokens") * 1e-6 + F.col("output_tokens") * 4e-6).alias("cost_usd"))
    profile = chatlog.structured_profile(
        reads, p.select("request_id", "system", "benchmark"), F.lit(10), ["system", "benchmark"], chatlog.value_positions(p), older, costs
    )
    return profile.withColumnRenamed("completion_tokens_mean", "completion_mean").drop("completion_tokens_min", "completion_tokens_max")
