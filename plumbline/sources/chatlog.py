"""Logged chat-completion payloads and server logs as tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.functions import vectors as V
from plumbline.operators.logprobs import MASKED_LOGPROB, clean_logprob
from plumbline.operators.ranking import top_n_per_group
from plumbline.session import checkpoint
from plumbline.sources.readers import line_order

PAYLOAD_SCHEMA = (
    "choices array<struct<finish_reason:string,message:struct<content:string>,logprobs:struct<content:array<"
    "struct<token:string,logprob:double,top_logprobs:array<struct<token:string,logprob:double>>>>>>>, "
    "usage struct<prompt_tokens:bigint,completion_tokens:bigint,"
    "prompt_tokens_details:struct<cached_tokens:bigint,cache_write_tokens:bigint>,"
    "completion_tokens_details:struct<reasoning_tokens:bigint>>"
)


def parsed(payloads: DataFrame, column: str = "payload") -> DataFrame:
    return payloads.withColumn("_p", F.from_json(column, PAYLOAD_SCHEMA))


def first_token_topk(payloads: DataFrame, key: str = "request_id") -> DataFrame:
    """(key, rank, token, logprob): the first generated token's listed alternatives, likeliest
    first (equal logprobs keep the listed order)."""
    first = F.try_element_at(F.get(F.col("_p.choices"), F.lit(0))["logprobs"]["content"], F.lit(1))
    listed = F.transform(
        first["top_logprobs"],
        lambda t, i: F.struct((-clean_logprob(t["logprob"])).alias("neg"), i.alias("i"), t["token"].alias("token")),
    )
    rows = parsed(payloads).select(key, F.posexplode(F.array_sort(listed)))
    return rows.select(key, (F.col("pos") + 1).alias("rank"), "col.token", (-F.col("col.neg")).alias("logprob"))


def usage_rows(payloads: DataFrame, key: str = "request_id") -> DataFrame:
    """(key, input_tokens, output_tokens, cached_tokens, cache_write_tokens, reasoning_tokens)."""
    u = F.col("_p.usage")
    details = u["prompt_tokens_details"]
    return parsed(payloads).select(
        key, u["prompt_tokens"].alias("input_tokens"), u["completion_tokens"].alias("output_tokens"),
        details["cached_tokens"].alias("cached_tokens"),
        F.coalesce(details["cache_write_tokens"], F.lit(0).cast("bigint")).alias("cache_write_tokens"),
        u["completion_tokens_details"]["reasoning_tokens"].alias("reasoning_tokens"),
    )


# --- structured replies ----------------------------------------------------------------------------

# Everything before a structured reply's value, and how far two reports of one logprob may differ:
# fixed values.
VALUE_OPENING = r'\s*\{?\s*"?answer"?\s*:\s*"?'
SAME_LOGPROB = 1e-3



def _floored(lp: Column) -> Column:
    return F.when(lp <= MASKED_LOGPROB, F.lit(float("-inf"))).otherwise(F.least(lp, F.lit(0.0)))


def _listed(token: Column) -> Column:
    """Alternatives listed at a token, their logprobs cleaned (none: an empty array)."""
    held = F.transform(token["top_logprobs"], lambda t: F.struct(t["token"].alias("token"), _floored(t["logprob"]).alias("lp")))
    return F.coalesce(held, F.expr("cast(array() as array<struct<token: string, lp: double>>)"))


def _lists_itself(token: Column) -> Column:
    """Whether a token's list has the token with its own logprob; if not, the list is stale."""
    own = _floored(token["logprob"])
    same = lambda t: (t["token"] == token["token"]) & ((t["lp"] == own) | (F.abs(t["lp"] - own) <= SAME_LOGPROB))
    return F.exists(_listed(token), same)


def _value_of(piece: Column) -> Column:
    """The first allowed value that ``piece`` begins. A piece may break off within the value, and the
    closing quote may follow the whole value only."""
    head = F.substring_index(piece, '"', 1)
    open_ended = ~F.contains(piece, F.lit('"'))
    return F.get(F.filter("values", lambda v: (head != "") & F.startswith(v, head) & ((head == v) | open_ended)), F.lit(0))


def _lps(entries: Column) -> Column:
    return F.transform(entries, lambda e: e["lp"])


def structured_reads(payloads: DataFrame) -> DataFrame:
    """(request_id, value, logprob, sampled, failure): the distribution over the allowed values of
    logged structured replies, one row per value found, or one row naming why it cannot be read.

    The reply's text opens with fixed characters; the token in which they end (and the next one, when
    they end with that token) lists how the value could have gone on. ``payloads``: request_id,
    payload (JSON text), values ARRAY<STRING>.
    """
    reply = parsed(payloads.select("request_id", "payload", "values")).select(
        "request_id", "values", F.col("_p.choices")[0]["logprobs"]["content"].alias("content")
    )
    empty = F.coalesce(F.size("content"), F.lit(0)) <= 0
    lengths = F.transform("content", lambda t: F.length(t["token"]))
    opening = F.length(F.regexp_extract(F.array_join(F.transform("content", lambda t: t["token"]), ""), "^" + VALUE_OPENING, 0))
    placed = reply.withColumns({"opening": opening, "ends": F.transform(lengths, lambda n, i: F.aggregate(F.slice(lengths, 1, i + 1), F.lit(0), lambda x, y: x + y))})
    # The token that holds the opening's last character.
    at = F.size(F.filter("ends", lambda e: e < F.col("opening")))
    placed = placed.withColumns({"here": F.get("content", at), "next": F.get("content", at + 1), "end": F.get("ends", at)})
    inside = F.length("here.token") - (F.col("end") - F.col("opening"))
    placed = placed.withColumn("prefix", F.left("here.token", inside))
    rest = lambda token: F.substring(token, F.length("prefix") + 1, F.length(token))
    going = F.filter(_listed(F.col("here")), lambda t: (t["lp"] > float("-inf")) & F.startswith(t["token"], F.col("prefix")))
    placed = placed.withColumn("first", F.transform(going, lambda t: F.struct(_value_of(rest(t["token"])).alias("value"), (rest(t["token"]) == "").alias("bare"), t["lp"].alias("lp"))))
    placed = placed.withColumns({
        "starts": F.filter("first", lambda e: e["bare"] | e["value"].isNotNull()),
        "undecided": V.logsumexp(_lps(F.filter("first", lambda e: e["bare"]))),
        "split": F.col("here.token") == F.col("prefix"),
    })
    later = F.filter(_listed(F.col("next")), lambda t: t["lp"] > float("-inf"))
    later = F.transform(later, lambda t: F.struct(_value_of(t["token"]).alias("value"), F.lit(False).alias("bare"), (F.col("undecided") + t["lp"]).alias("lp")))
    none = F.slice("first", 1, 0)
    placed = placed.withColumns({
        "found": F.filter(F.concat("first", F.when(F.col("split"), later).otherwise(none)), lambda e: e["value"].isNotNull()),
        "scale": V.logsumexp(_lps(F.col("starts"))),
        "sampled": _value_of(F.when(F.col("split"), F.col("next.token")).otherwise(rest(F.col("here.token")))),
    })
    failure = (
        F.when(empty, "empty reply")
        .when((F.col("opening") == 0) | F.col("here").isNull(), "stuck")
        .when(~_lists_itself(F.col("here")), "stale list")
        .when(F.size("starts") == 0, "value not allowed")
        .when(F.col("split") & F.col("next").isNull(), "stuck")
        .when(F.col("split") & ~_lists_itself(F.col("next")), "stale list")
        .when(F.col("sampled").isNull(), "value not allowed")
    )

    def entry(v: Column) -> Column:
        lps = _lps(F.filter("found", lambda e: e["value"] == v))
        return F.struct(v.alias("value"), F.least(V.logsumexp(lps) - F.col("scale"), F.lit(0.0)).alias("logprob"), (v == F.col("sampled")).alias("sampled"), F.lit(None).cast("string").alias("failure"))

    read = F.transform(F.array_distinct(F.transform("found", lambda e: e["value"])), entry)
    failed = F.array(F.struct(F.lit(None).cast("string").alias("value"), F.lit(None).cast("double").alias("logprob"), F.lit(None).cast("boolean").alias("sampled"), F.col("failure")))
    return placed.withColumn("failure", failure).select("request_id", F.inline(F.when(F.col("failure").isNotNull(), failed).otherwise(read)))


def value_positions(payloads: DataFrame) -> DataFrame:
    """(request_id, value_token, merged): the 0-based token of a structured reply in which its value
    starts (NULL if the opening never ends) and whether that token also ends the opening."""
    reply = parsed(payloads.select("request_id", "payload")).select("request_id", F.col("_p.choices")[0]["logprobs"]["content"].alias("content"))
    texts = F.transform("content", lambda t: t["token"])
    opening = F.length(F.regexp_extract(F.array_join(texts, ""), "^" + VALUE_OPENING, 0))
    lengths = F.transform("content", lambda t: F.length(t["token"]))
    ends = F.transform(lengths, lambda n, i: F.aggregate(F.slice(lengths, 1, i + 1), F.lit(0), lambda x, y: x + y))
    placed = reply.withColumns({"opening": opening, "ends": ends})
    at = F.size(F.filter("ends", lambda e: e <= F.col("opening")))  # tokens that lie wholly in the opening
    found = (F.col("opening") > 0) & (at < F.size("content"))
    before = F.when(at > 0, F.get("ends", at - 1)).otherwise(0)
    return placed.select("request_id", F.when(found, at).alias("value_token"), F.when(found, before < F.col("opening")).alias("merged"))


def structured_profile(
    reads: DataFrame, keys: DataFrame, n_labels: Column, groups: Sequence[str] = ("benchmark",), positions: DataFrame | None = None,
    older: DataFrame | None = None, costs: DataFrame | None = None,
) -> DataFrame:
    """Per group: replies, failures by reason, label mass and missing labels. ``keys``: request_id and
    the ``groups`` columns. Further figures of replies that were read: with :func:`value_positions`, in
    which tokens values start (``token=count``, by token) and how often the token also ends the opening;
    with ``older`` (request_id, value: an earlier read's likeliest label) how many were compared and
    agree on the likeliest value; with ``costs`` (request_id, output_tokens, cost_usd) tokens and the
    cost of a thousand."""
    groups = list(groups)
    likeliest = F.min_by("value", F.struct((-F.col("logprob")).alias("p"), F.col("value").alias("v")))
    per = reads.groupBy("request_id").agg(
        F.max("failure").alias("failure"), F.count("value").alias("n_values"), F.sum(F.exp("logprob")).alias("mass"), likeliest.alias("likeliest"),
    )
    # What is parsed is kept: each aggregate would parse the replies again, and a filter on what was read
    # would be pushed into the parsing and evaluated for every token.
    joined = checkpoint(keys.join(per, "request_id"))
    ok = F.col("failure").isNull()

    def counted(rows: DataFrame, what: str, name: str) -> DataFrame:
        """Counts of each value of ``what`` as one text per group, by value."""
        each = rows.groupBy(*groups, what).agg(F.count(F.lit(1)).alias("_k"))
        listed = F.transform(F.sort_array(F.collect_list(F.struct(what, "_k"))), lambda x: F.concat_ws("=", x[what].cast("string"), x["_k"].cast("string")))
        return each.groupBy(*groups).agg(F.array_join(listed, ",").alias(name))

    more, texts = [], [counted(joined.where(~ok), "failure", "failures")]
    if positions is not None:
        joined = joined.join(checkpoint(positions), "request_id", "left")
        more.append(F.count_if(ok & F.col("merged")).alias("n_merged"))
        texts.append(counted(joined.where(ok & F.col("value_token").isNotNull()), "value_token", "value_positions"))
    if older is not None:
        joined = joined.join(older.select("request_id", F.col("value").alias("_older")), "request_id", "left")
        more += [F.count_if(ok & F.col("_older").isNotNull()).alias("n_compared"), F.count_if(ok & (F.col("_older") == F.col("likeliest"))).alias("n_agree")]
    if costs is not None:
        joined = joined.join(costs.select("request_id", "output_tokens", "cost_usd"), "request_id", "left")
        more.append((F.avg(F.when(ok, F.col("cost_usd"))) * 1000.0).alias("usd_per_1k_items"))
        more += [f(F.when(ok, F.col("output_tokens"))).alias(f"completion_tokens_{k}") for k, f in (("mean", F.avg), ("min", F.min), ("max", F.max))]
    stats = joined.groupBy(*groups).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(ok).alias("n_read"),
        F.avg(F.when(ok, F.col("mass"))).alias("mass_mean"), F.min(F.when(ok, F.col("mass"))).alias("mass_min"),
        F.avg(F.when(ok, n_labels - F.col("n_values"))).alias("missing_per_item"), *more,
    )
    for text in texts:
        stats = stats.join(text, groups, "left")
    return stats


# --- server logs -----------------------------------------------------------------------------------

# Facts of a model server's log, by the pattern of the line that states them: fixed values.
LOG_FACTS = {
    "weights_gib": r"Model loading took ([\d.]+) GiB memory",
    "load_seconds": r"Model loading took [\d.]+ GiB memory and ([\d.]+) seconds",
    "kv_cache_gib": r"Available KV cache memory: ([\d.]+) GiB",
    "kv_cache_tokens": r"GPU KV cache size: ([\d,]+) tokens",
    "attention_block_size": r"Setting attention block size to (\d+) tokens",
}


LOG_TEXTS = {
    "serve_command": r"^(vllm serve .*)$",
    "quantization": r"^Initializing a V1 LLM engine .*\bquantization=([\w-]+)",
}
KERNEL_LINE = r"(?i)marlin|machete|cutlass|exllama|fp8|awq|wna16|w8a8|w4a16|quantiz|LinearKernel|kernel for"
NOT_KERNEL_LINE = ("vllm serve", "Initializing a V1 LLM engine", "non-default args")
LINE_HEAD = r"^\S+\s+\|\s(?:\(\w+ pid=\d+\)\s)?(?:(?:DEBUG|INFO|WARNING|ERROR|CRITICAL) \d\d-\d\d [\d:]+ \[[^\]]+\] )?"
KERNEL_LINES, KERNEL_CHARS = 25, 400
"""A log's kernel lines: the first so many different ones, cut to so many characters."""


def log_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, line_no, value) without HTTP access lines; ``line_no`` orders the lines of a file however
    the scan is split."""
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), line_order().alias("line_no"), "value")
    return lines.where(~F.col("value").contains('"GET /') & ~F.col("value").contains('"POST /'))


def _message() -> Column:
    """A line without the container's, process's and logger's heads."""
    return F.trim(F.regexp_replace("value", LINE_HEAD, ""))


def log_facts(lines: DataFrame, patterns: dict[str, str] | None = None) -> DataFrame:
    """Per file, the first number each pattern finds."""
    aggs = []
    for name, pattern in (patterns or LOG_FACTS).items():
        found = F.nullif(F.regexp_extract("value", pattern, 1), F.lit(""))
        number = F.replace(found, F.lit(","), F.lit("")).cast("double")
        aggs.append(F.min_by(number, F.when(found.isNotNull(), F.col("line_no"))).alias(name))
    return lines.groupBy("file").agg(*aggs)


def log_texts(lines: DataFrame, patterns: dict[str, str] | None = None) -> DataFrame:
    """Per file, the first text each pattern finds in a line's message (NULL if none does)."""
    messages = lines.withColumn("_message", _message())
    aggs = []
    for name, pattern in (patterns or LOG_TEXTS).items():
        found = F.nullif(F.regexp_extract("_message", pattern, 1), F.lit(""))
        aggs.append(F.min_by(found, F.when(found.isNotNull(), F.col("line_no"))).alias(name))
    return messages.groupBy("file").agg(*aggs)


def kernel_lines(lines: DataFrame) -> DataFrame:
    """(file, rank, message): the different messages about kernels and quantization in the order of
    their first lines. Repetitions are aggregated away before anything is ranked."""
    messages = lines.select("file", "line_no", _message().alias("message")).where(F.col("message").rlike(KERNEL_LINE))
    for head in NOT_KERNEL_LINE:
        messages = messages.where(~F.col("message").startswith(head))
    firsts = messages.groupBy("file", "message").agg(F.min("line_no").alias("line_no"))
    ranked = top_n_per_group(firsts, ["file"], ["line_no"], KERNEL_LINES)
    return ranked.select("file", "rank", F.left("message", F.lit(KERNEL_CHARS)).alias("message"))


def log_warnings(lines: DataFrame) -> DataFrame:
    """Distinct warning and error messages per file with their counts."""
    level = F.regexp_extract("value", r"\b(WARNING|ERROR)\b", 1)
    message = F.trim(F.regexp_replace("value", r"^.*?\b(?:WARNING|ERROR)\b( \d\d-\d\d [\d:]+ \[[^\]]+\])?", ""))
    return (
        lines.withColumn("level", level).where("level <> ''")
        .groupBy("file", "level", message.alias("message")).agg(F.count(F.lit(1)).alias("n"))
    )
