"""Views of the evaluation data model derived from the given tables.

Each view exists twice: a DataFrame here and the same SELECT in :data:`SQL`, so every query has an
input its SQL twin can rebuild. Probabilities are rounded to six decimals on both sides.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.functions import vectors as V
from plumbline.functions.questions import letter

PRIORITY_WEIGHTS = (32.0, 16.0, 8.0, 4.0, 2.0)
"""Score-view probability weight by distance from the mode."""
POSITION_PRIOR = (0.19, 0.07, 0.13, 0.05, 0.11, 0.09, 0.1, 0.08, 0.12, 0.06)
"""Position bias multiplied into the presentations view."""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """Rows of an input read in few pieces dealt over the shuffle partitions (a small file has one row
    group, so one task would do all the work); inputs in as many pieces, or four for each core, stay as
    they are read."""
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    enough = min(parts, 4 * df.sparkSession.sparkContext.defaultParallelism)
    return df.repartition(parts) if df.rdd.getNumPartitions() < enough else df


def _rounded(p):
    return F.transform(p, lambda x: F.round(x, 6))


def preds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two systems answering ten-way questions; two items per question."""
    e = table(spark, sf_dir, "embeddings")
    systems = F.array(
        F.struct(F.lit("a").alias("system"), F.lit(0).alias("offset"), F.lit(1.5).alias("bonus")),
        F.struct(F.lit("b").alias("system"), F.lit(10).alias("offset"), F.lit(0.8).alias("bonus")),
    )
    logits = F.transform(
        F.slice("embedding", F.col("s.offset") + 1, F.lit(10)),
        lambda x, k: 8.0 * x.cast("double") + F.when(k == F.col("label"), F.col("s.bonus")).otherwise(0.0),
    )
    question = F.floor(F.col("vec_id") / 2)
    return (
        e.withColumn("s", F.explode(systems))
        .withColumn("probs", _rounded(V.softmax(logits)))
        .select(
            F.col("s.system").alias("system"),
            F.concat(F.lit("b"), (question % 4).cast("string")).alias("benchmark"),
            F.col("vec_id").cast("string").alias("item_id"),
            question.cast("string").alias("question_id"),
            (question % 3).cast("string").alias("stratum"),
            F.lit("choice").alias("qtype"),
            F.transform(F.sequence(F.lit(0), F.lit(9)), lambda i: letter(i)).alias("keys"),
            "probs",
            F.col("label").alias("gold_idx"),
            V.argmax(F.col("probs")).alias("choice_idx"),
            F.lit(None).cast("double").alias("score"),
            F.lit(9).alias("idk_idx"),
        )
    )


def noul_preds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Yes/no answers with many ties and exact zeros, one per line item."""
    li = spread(
        table(spark, sf_dir, "lineitem").select(
            "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_discount", "l_returnflag", "l_linestatus"
        )
    )
    p = F.round(F.col("l_discount") * 10, 1)
    return li.select(
        F.lit("n").alias("system"),
        F.col("l_linestatus").alias("benchmark"),
        F.concat_ws("-", "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber").alias("item_id"),
        F.col("l_orderkey").cast("string").alias("question_id"),
        (F.col("l_orderkey") % 5).cast("string").alias("stratum"),
        F.lit("noul").alias("qtype"),
        F.array(F.lit("true"), F.lit("false")).alias("keys"),
        F.array(p, F.lit(1.0) - p).alias("probs"),
        F.when(F.col("l_returnflag") == "R", 0).otherwise(1).alias("gold_idx"),
        F.lit(None).cast("int").alias("choice_idx"),
        F.lit(None).cast("double").alias("score"),
        F.lit(None).cast("int").alias("idk_idx"),
    )


def score_preds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five-level answers, one per order."""
    o = table(spark, sf_dir, "orders")
    mode = (F.col("o_custkey") % 5).cast("int")
    weights = F.array(*[F.lit(w) for w in PRIORITY_WEIGHTS])
    raw = F.transform(F.sequence(F.lit(0), F.lit(4)), lambda i: F.get(weights, F.abs(i - mode)))
    return (
        o.withColumn("probs", _rounded(V.normalize(raw)))
        .select(
            F.lit("s").alias("system"),
            F.col("o_orderstatus").alias("benchmark"),
            F.col("o_orderkey").cast("string").alias("item_id"),
            F.col("o_orderkey").cast("string").alias("question_id"),
            (F.col("o_custkey") % 3).cast("string").alias("stratum"),
            F.lit("score").alias("qtype"),
            F.transform(F.sequence(F.lit(0), F.lit(4)), lambda i: i.cast("string")).alias("keys"),
            "probs",
            (F.substring("o_orderpriority", 1, 1).cast("int") - 1).alias("gold_idx"),
            F.lit(None).cast("int").alias("choice_idx"),
            F.round(V.vsum(F.transform("probs", lambda x, i: x * i)), 6).alias("score"),
            F.lit(None).cast("int").alias("idk_idx"),
        )
    )


def all_preds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (
        preds(spark, sf_dir)
        .unionByName(noul_preds(spark, sf_dir))
        .unionByName(score_preds(spark, sf_dir))
    )


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Append-only answer log with several attempts per item."""
    e = table(spark, sf_dir, "events")
    ok = F.col("event_type") != "error"
    return e.select(
        F.concat(F.lit("s"), (F.col("event_id") % 3).cast("string")).alias("system_id"),
        F.concat(F.lit("b"), (F.col("user_id") % 4).cast("string")).alias("benchmark"),
        F.concat_ws("-", F.col("user_id").cast("string"), F.date_format("ts", "yyyy-MM-dd")).alias("item_id"),
        F.col("event_id").alias("line_no"),
        F.col("ts").cast("timestamp").alias("ts"),
        ok.alias("ok"),
        F.when(~ok, F.lit("TimeoutError")).alias("error_type"),
        F.col("value").alias("latency_ms"),
        (F.col("event_type") == "view").alias("cached"),
        F.when(F.col("event_type") == "view", 0.0).otherwise(F.col("value") * 1e-4).alias("cost_usd"),
        F.when(ok, F.ceil("value").cast("bigint")).alias("input_tokens"),
        F.when(ok, F.lit(1).cast("bigint")).alias("output_tokens"),
        F.when(ok, F.floor(F.col("value") / 3).cast("bigint")).alias("cached_tokens"),
    )


def invocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Run invocations: one per event type and day; the last day's are unfinished."""
    e = table(spark, sf_dir, "events")
    day = F.date_format("ts", "yyyy-MM-dd")
    return (
        e.groupBy(F.col("event_type").alias("system_id"), day.alias("day"))
        .agg(
            F.min("ts").cast("timestamp").alias("started"),
            F.max("ts").cast("timestamp").alias("last"),
            F.count(F.lit(1)).alias("n_called"),
            F.count_if(F.col("value") < 10).alias("n_cache_hits"),
        )
        .withColumn("finished", F.when(F.col("day") < "2024-01-29", F.col("last")))
        .withColumn("concurrency", F.lit(16))
        .drop("last")
    )


def usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token usage per answered document."""
    d = table(spark, sf_dir, "documents")
    tokens = F.ceil(F.col("n_chars") / 4).cast("bigint")
    return d.select(
        F.col("doc_id").cast("string").alias("item_id"),
        F.col("lang").alias("price_id"),
        tokens.alias("input_tokens"),
        F.lit(1).cast("bigint").alias("output_tokens"),
        F.least(F.col("n_chars") % 100, tokens).cast("bigint").alias("cached_tokens"),
        F.lit(0).cast("bigint").alias("cache_write_tokens"),
    )


def token_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Logged top-15 next-token logprobs per request, as rows."""
    e = table(spark, sf_dir, "embeddings")
    z = F.transform("embedding", lambda x: 8.0 * x.cast("double"))
    listed = F.sort_array(
        F.transform(
            V.log_softmax(z),
            lambda lp, i: F.struct((-F.round(lp, 9)).alias("neg"), i.alias("dim")),
        )
    )
    ranked = e.select(F.col("vec_id").cast("string").alias("request_id"), F.posexplode(F.slice(listed, 1, 15)))
    label = letter((F.col("col.dim") % 10).cast("int"))
    bare = F.col("col.dim") % 20 < 10
    return ranked.select(
        "request_id",
        (F.col("pos") + 1).alias("rank"),
        F.when(bare, label).otherwise(F.concat(F.lit(" "), label)).alias("token"),
        (-F.col("col.neg")).alias("logprob"),
    )


def presentations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All ten cyclic presentations of both systems' answers, each under a position prior of its own."""
    prior = F.array(*[F.lit(x) for x in POSITION_PRIOR])
    turned = F.when(F.col("system") == "a", 0).otherwise(3)
    shown = preds(spark, sf_dir).withColumn("shift", F.explode(F.sequence(F.lit(0), F.lit(9))))
    order = F.transform(F.sequence(F.lit(0), F.lit(9)), lambda i: ((i + F.col("shift")) % 10).cast("int"))
    weighted = F.transform(
        F.col("order"),
        lambda j, i: F.greatest(F.get("probs", j), F.lit(1e-6)) * F.get(prior, (i + turned) % 10),
    )
    return (
        shown.withColumn("order", order)
        .withColumn("shown_probs", V.normalize(weighted))
        .select(
            "system", "benchmark", "item_id", "question_id", "stratum", "gold_idx", "shift", "order",
            "shown_probs",
            F.concat(F.lit("choice:10:"), (F.col("item_id").cast("bigint") % 2).cast("string")).alias("prior_key"),
        )
    )


def mcq_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Multiple-choice source rows: four options per part."""
    p = table(spark, sf_dir, "part")
    return p.select(
        F.col("p_partkey").cast("string").alias("question_id"),
        F.concat(F.lit("Which value describes part "), F.col("p_partkey").cast("string"), F.lit("?")).alias("question"),
        F.array("p_brand", "p_type", "p_name", F.concat(F.lit("size "), F.col("p_size").cast("string"))).alias("options"),
        (F.col("p_partkey") % 4).cast("int").alias("gold_index"),
        F.col("p_brand").alias("subject"),
    )


def responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answered requests: repeated texts are repeated requests."""
    c = table(spark, sf_dir, "conversations")
    return c.select(
        F.col("role").alias("model"),
        F.col("text").alias("request"),
        (F.col("conv_id") * 1000 + F.col("turn")).alias("created"),
        F.concat_ws(":", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("response"),
    )


def candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One candidate system per supplier with speed, quality and calibration error."""
    li = table(spark, sf_dir, "lineitem")
    s = table(spark, sf_dir, "supplier")
    stats = li.groupBy("l_suppkey").agg(
        (F.count(F.lit(1)) / 100.0).alias("qps"),
        F.round(F.avg("l_discount"), 9).alias("quality"),
        F.round(F.stddev("l_tax"), 9).alias("ece"),
        F.round(F.avg("l_quantity") / 50.0, 9).alias("nll"),
    )
    return stats.join(s, stats.l_suppkey == s.s_suppkey).select(
        F.col("s_name").alias("name"),
        F.when(F.col("s_nationkey") < 9, "small").when(F.col("s_nationkey") < 17, "moe").otherwise("large").alias("size_class"),
        "qps", "quality", "ece", "nll",
    )


# --- the same views in SQL -----------------------------------------------------------------------

_SUM = "list_reduce({0}, lambda a, x: a + x)"

SQL: dict[str, str] = {
    "preds": """
  SELECT system, 'b' || ((vec_id // 2) % 4) AS benchmark, vec_id::VARCHAR AS item_id,
         (vec_id // 2)::VARCHAR AS question_id, ((vec_id // 2) % 3)::VARCHAR AS stratum,
         'choice' AS qtype, list_transform(range(0, 10), lambda i: chr((65 + i)::INTEGER)) AS keys,
         probs, label AS gold_idx, (list_position(probs, list_max(probs)) - 1)::INTEGER AS choice_idx,
         NULL::DOUBLE AS score, 9 AS idk_idx
  FROM (
    SELECT system, vec_id, label,
           list_transform(e, lambda x: round(x / list_reduce(e, lambda a, y: a + y), 6)) AS probs
    FROM (
      SELECT system, vec_id, label, list_transform(z, lambda x: exp(x - list_max(z))) AS e
      FROM (
        SELECT s.system, vec_id, label,
               list_transform(range(1, 11), lambda k: 8.0::DOUBLE * embedding[k + s.off]::DOUBLE
                 + CASE WHEN k - 1 = label THEN s.bonus ELSE 0.0 END) AS z
        FROM embeddings, (VALUES ('a', 0, 1.5::DOUBLE), ('b', 10, 0.8::DOUBLE)) AS s(system, off, bonus))))
""",
    "noul_preds": """
  SELECT 'n' AS system, l_linestatus AS benchmark,
         concat_ws('-', l_orderkey, l_partkey, l_suppkey, l_linenumber) AS item_id,
         l_orderkey::VARCHAR AS question_id, (l_orderkey % 5)::VARCHAR AS stratum, 'noul' AS qtype,
         ['true', 'false'] AS keys,
         [round(l_discount * 10, 1), 1.0::DOUBLE - round(l_discount * 10, 1)] AS probs,
         CASE WHEN l_returnflag = 'R' THEN 0 ELSE 1 END AS gold_idx, NULL::INTEGER AS choice_idx,
         NULL::DOUBLE AS score, NULL::INTEGER AS idk_idx
  FROM lineitem
""",
    "score_preds": """
  SELECT 's' AS system, o_orderstatus AS benchmark, o_orderkey::VARCHAR AS item_id,
         o_orderkey::VARCHAR AS question_id, (o_custkey % 3)::VARCHAR AS stratum, 'score' AS qtype,
         ['0', '1', '2', '3', '4'] AS keys, probs,
         substr(o_orderpriority, 1, 1)::INTEGER - 1 AS gold_idx, NULL::INTEGER AS choice_idx,
         round(list_reduce(list_transform(probs, lambda x, i: x * (i - 1)), lambda a, x: a + x), 6) AS score,
         NULL::INTEGER AS idk_idx
  FROM (
    SELECT *, list_transform(w, lambda x: round(x / list_reduce(w, lambda a, y: a + y), 6)) AS probs
    FROM (
      SELECT *, list_transform(range(0, 5), lambda i:
               ([32.0, 16.0, 8.0, 4.0, 2.0]::DOUBLE[])[1 + abs(i - o_custkey % 5)]) AS w
      FROM orders))
""",
    "records": """
  SELECT 's' || (event_id % 3) AS system_id, 'b' || (user_id % 4) AS benchmark,
         user_id || '-' || strftime(ts, '%Y-%m-%d') AS item_id, event_id AS line_no, ts,
         event_type <> 'error' AS ok,
         CASE WHEN event_type = 'error' THEN 'TimeoutError' END AS error_type, value AS latency_ms,
         event_type = 'view' AS cached,
         CASE WHEN event_type = 'view' THEN 0.0 ELSE value * 1e-4 END::DOUBLE AS cost_usd,
         CASE WHEN event_type <> 'error' THEN ceil(value)::BIGINT END AS input_tokens,
         CASE WHEN event_type <> 'error' THEN 1::BIGINT END AS output_tokens,
         CASE WHEN event_type <> 'error' THEN floor(value / 3)::BIGINT END AS cached_tokens
  FROM events
""",
    "invocations": """
  SELECT system_id, day, started, n_called, n_cache_hits, 16 AS concurrency,
         CASE WHEN day < '2024-01-29' THEN last END AS finished
  FROM (
    SELECT event_type AS system_id, strftime(ts, '%Y-%m-%d') AS day, min(ts) AS started,
           max(ts) AS last, count(*) AS n_called, count(*) FILTER (WHERE value < 10) AS n_cache_hits
    FROM events GROUP BY 1, 2)
""",
    "usage": """
  SELECT doc_id::VARCHAR AS item_id, lang AS price_id, ceil(n_chars / 4)::BIGINT AS input_tokens,
         1::BIGINT AS output_tokens, least(n_chars % 100, ceil(n_chars / 4)::BIGINT) AS cached_tokens,
         0::BIGINT AS cache_write_tokens
  FROM documents
""",
    "token_topk": """
  SELECT request_id, rank, CASE WHEN dim % 20 < 10 THEN label ELSE ' ' || label END AS token,
         logprob
  FROM (
    SELECT vec_id::VARCHAR AS request_id, dim, chr((65 + dim % 10)::INTEGER) AS label, round(z - lse, 9) AS logprob,
           row_number() OVER (PARTITION BY vec_id ORDER BY round(z - lse, 9) DESC, dim) AS rank
    FROM (
      SELECT vec_id, unnest(range(0, 64)) AS dim, unnest(list_transform(embedding, lambda x: 8.0::DOUBLE * x::DOUBLE)) AS z,
             8.0::DOUBLE * list_max(embedding)::DOUBLE + ln(list_reduce(list_transform(embedding,
               lambda x: exp(8.0::DOUBLE * x::DOUBLE - 8.0::DOUBLE * list_max(embedding)::DOUBLE)), lambda a, y: a + y)) AS lse
      FROM embeddings))
  WHERE rank <= 15
""",
    "presentations": """
  SELECT system, benchmark, item_id, question_id, stratum, gold_idx, shift, ord,
         list_transform(w, lambda x: x / list_reduce(w, lambda a, y: a + y)) AS shown_probs,
         'choice:10:' || (item_id::BIGINT % 2) AS prior_key
  FROM (
    SELECT *, list_transform(range(0, 10), lambda i: greatest(probs[1 + ord[i + 1]], 1e-6)
             * ([0.19, 0.07, 0.13, 0.05, 0.11, 0.09, 0.1, 0.08, 0.12, 0.06]::DOUBLE[])[1 + (i + CASE system WHEN 'a' THEN 0 ELSE 3 END) % 10]) AS w
    FROM (
      SELECT p.*, s.shift, list_transform(range(0, 10), lambda i: (i + s.shift) % 10) AS ord
      FROM preds p, (SELECT unnest(range(0, 10)) AS shift) s))
""",
    "mcq_rows": """
  SELECT p_partkey::VARCHAR AS question_id, 'Which value describes part ' || p_partkey || '?' AS question,
         [p_brand, p_type, p_name, 'size ' || p_size] AS options, (p_partkey % 4)::INTEGER AS gold_index,
         p_brand AS subject
  FROM part
""",
    "responses": """
  SELECT role AS model, text AS request, conv_id * 1000 + turn AS created, conv_id || ':' || turn AS response
  FROM conversations
""",
    "candidates": """
  SELECT s_name AS name, CASE WHEN s_nationkey < 9 THEN 'small' WHEN s_nationkey < 17 THEN 'moe' ELSE 'large' END AS size_class,
         qps, quality, ece, nll
  FROM (SELECT l_suppkey, count(*) / 100.0::DOUBLE AS qps, round(avg(l_discount), 9) AS quality,
               round(stddev(l_tax), 9) AS ece, round(avg(l_quantity) / 50.0, 9) AS nll
        FROM lineitem GROUP BY 1) JOIN supplier ON l_suppkey = s_suppkey
""",
}
SQL["all_preds"] = "SELECT * FROM preds UNION ALL BY NAME SELECT * FROM noul_preds UNION ALL BY NAME SELECT * FROM score_preds"

_PROBS = """CASE WHEN qtype = 'noul' OR list_sum(probs) <= 0 THEN probs
         ELSE list_transform(probs, lambda x: x / list_reduce(probs, lambda a, y: a + y)) END"""


def scored_sql(source: str) -> str:
    """Per-answer scores of a prediction view (the twin of ``with_scores``)."""
    return f"""
  SELECT *, predicted = gold_idx AS correct, -ln(least(1.0, greatest(p_gold, 1e-6))) AS nll,
         CASE WHEN qtype = 'noul' THEN 2 * (1 - p_gold) * (1 - p_gold)
              ELSE list_reduce(list_transform(p, lambda x: x * x), lambda a, y: a + y) - 2 * p_gold + 1 END AS brier,
         coalesce(p[predicted + 1], 0) AS confidence,
         coalesce(qtype = 'choice' AND choice_idx = idk_idx, false) AS abstained,
         CASE WHEN qtype = 'score' THEN abs(score - gold_idx) END AS abs_error,
         CASE WHEN qtype = 'score' THEN abs(predicted - gold_idx) <= 1 END AS within_one
  FROM (
    SELECT *, coalesce(p[gold_idx + 1], 0) AS p_gold,
           CASE WHEN qtype = 'noul' THEN CASE WHEN p[1] >= 0.5 THEN 0 ELSE 1 END
                WHEN qtype = 'score' THEN (list_position(p, list_max(p)) - 1)::INTEGER
                ELSE choice_idx END AS predicted
    FROM (SELECT *, {_PROBS} AS p FROM {source}))
"""


def item_metrics_sql(source: str, probs: str = "probs") -> str:
    """The twin of ``with_item_metrics``."""
    return f"""
  SELECT *, list_position({probs}, list_max({probs})) - 1 = gold_idx AS correct, list_max({probs}) AS confidence,
         -ln(least(1.0, greatest(p_gold, 1e-6))) AS nll,
         list_reduce(list_transform({probs}, lambda x: x * x), lambda a, y: a + y) - 2 * p_gold + 1 AS brier
  FROM (SELECT *, coalesce({probs}[gold_idx + 1], 0) AS p_gold FROM {source})
"""


SQL["scored"] = scored_sql("all_preds")
SQL["scored_choice"] = scored_sql("preds")
SQL["metrics"] = item_metrics_sql("(SELECT * REPLACE (list_transform(probs, lambda x: x / list_reduce(probs, lambda a, y: a + y)) AS probs) FROM preds)")

DEPENDS = {
    "presentations": ["preds"],
    "all_preds": ["preds", "noul_preds", "score_preds"],
    "scored": ["preds", "noul_preds", "score_preds", "all_preds"],
    "scored_choice": ["preds"],
    "metrics": ["preds"],
}


def with_views(body: str, *views: str) -> str:
    """``body`` preceded by the CTEs of ``views`` and of the views they read."""
    needed: list[str] = []
    for view in views:
        for name in [*DEPENDS.get(view, []), view]:
            if name not in needed:
                needed.append(name)
    ctes = ", ".join(f"{name} AS MATERIALIZED ({SQL[name].strip()})" for name in needed)
    head = f"WITH {ctes}" if ctes else ""
    stripped = body.strip()
    if stripped[:5].upper() == "WITH ":
        return f"{head}, {stripped[5:]}" if head else stripped
    return f"{head} {stripped}"
