"""Label probabilities from logged next-token logprobs.

Input tables: ``topk`` (request_id, rank, token, logprob), one row per listed token, and a small
label dimension (scheme, pos, label, surface). Reads are relational: surfaces match by an equality
join, variants merge by a grouped logsumexp, missing labels are the unmatched side of a left join.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from plumbline.functions import vectors as V
from plumbline.session import broadcast_if_small, lookup

LOW_MASS = 0.5
LEFTOVER_FLOOR = 2.0**-23
MASKED_LOGPROB = -9999.0
POSITIVE_TOLERANCE = 1e-3
SURFACE_PREFIXES = ("", " ")
DECORATIONS = "*()[].:_`'\"- \n\t"


def log_sum(values: str | Column) -> Column:
    """Aggregate: stable ``ln(sum(exp(values)))``, ``-Infinity`` when every value is, NULL without
    values. Groups are the entries of one request (a top-k list, a question's labels), so gathering
    them is bounded."""
    held = F.collect_list(values)
    return F.when(F.size(held) > 0, V.logsumexp(held))


def label_dimension(spark: SparkSession, scheme: str, n_labels: int) -> DataFrame:
    """(scheme, pos, label, surface) of a fixed scheme: at most 676 labels times two surfaces."""
    from plumbline.functions.questions import NOUL_LABELS, code, letter

    capacity = {"letters": 52, "digits": 10, "yes_no": 2, "codes": 676}[scheme]
    if n_labels > capacity:
        raise ValueError(f"{scheme!r} has {capacity} labels; the question needs {n_labels}")
    pos = spark.range(n_labels).select(F.col("id").cast("int").alias("pos"))
    label = {
        "letters": letter(F.col("pos")),
        "digits": F.col("pos").cast("string"),
        "yes_no": F.get(F.array(*[F.lit(x) for x in NOUL_LABELS]), F.col("pos")),
        "codes": code(F.col("pos")),
    }[scheme]
    prefixes = F.array(*[F.lit(p) for p in SURFACE_PREFIXES])
    return pos.withColumn("label", label).select(
        F.lit(scheme).alias("scheme"), "pos", "label",
        F.explode(F.transform(prefixes, lambda p: F.concat(p, F.col("label")))).alias("surface"),
    )


def clean_logprob(lp: Column) -> Column:
    """Masked logprobs become ``-Infinity``, tiny positive ones 0, anything else positive NULL."""
    return (
        F.when(F.isnan(lp) | (lp > POSITIVE_TOLERANCE), F.lit(None))
        .when(lp <= MASKED_LOGPROB, F.lit(V.NEG_INF))
        .otherwise(F.least(lp, F.lit(0.0)))
    )


def observed_surfaces(topk: DataFrame, labels: DataFrame) -> DataFrame:
    """(request_id, label, pos, surface, logprob): listed surfaces of labels, duplicates added."""
    small = broadcast_if_small(labels)
    return (
        topk.where(F.col("logprob") > V.NEG_INF)
        .join(small, F.col("token") == F.col("surface"))
        .groupBy("request_id", "pos", "label", "surface")
        .agg(log_sum("logprob").alias("logprob"))
    )


def merge_variants(surfaces: DataFrame) -> DataFrame:
    """(request_id, pos, label, logprob): bare and space-prefixed surfaces added."""
    return surfaces.groupBy("request_id", "pos", "label").agg(log_sum("logprob").alias("logprob"))


def renormalized(scores: Column) -> Column:
    """Log-probabilities of an array of scores; ``+Infinity`` entries share all the mass, NULL
    when nothing has any."""
    infinite = F.size(F.filter(scores, lambda x: x == float("inf")))
    shared = F.transform(
        scores, lambda x: F.when(x == float("inf"), -F.ln(infinite.cast("double"))).otherwise(F.lit(V.NEG_INF))
    )
    return F.when(infinite > 0, shared).otherwise(V.log_normalize(scores))


def upper_bounds(topk: DataFrame, leftover: bool = False, masked: bool = False) -> DataFrame:
    """(request_id, bound): what an unlisted label can have at most: the smallest listed logprob,
    capped by the mass the list leaves over (``leftover``), or that mass alone (``masked``)."""
    finite = topk.where(F.col("logprob") > V.NEG_INF)
    left = F.ln(F.greatest(1.0 - F.sum(F.exp("logprob")), F.lit(LEFTOVER_FLOOR)))
    bound = left if masked else (F.least(F.min("logprob"), left) if leftover else F.min("logprob"))
    return finite.groupBy("request_id").agg(bound.alias("bound"))


def first_token_read(
    topk: DataFrame, labels: DataFrame, leftover: bool = False, masked: bool = False, raw_mode: bool = True
) -> DataFrame:
    """One row per request and label: raw and renormalised logprob, whether it was missing (its
    raw value is then the upper bound), observed mass and the low-mass warning."""
    merged = merge_variants(observed_surfaces(topk, labels))
    requests = upper_bounds(topk, leftover, masked)
    # The labels of a fixed scheme (at most 676) become one array, exploded per request.
    names = sorted({(row["pos"], row["label"]) for row in labels.select("pos", "label").collect()})
    listed = F.array(*[F.struct(F.lit(p).alias("pos"), F.lit(n).alias("label")) for p, n in names])
    grid = requests.select("request_id", "bound", F.inline(listed))
    filled = grid.join(merged, ["request_id", "pos", "label"], "left").withColumns(
        {
            "missing": F.col("logprob").isNull(),
            "raw": F.coalesce("logprob", "bound"),
        }
    )
    per_request = filled.groupBy("request_id").agg(
        log_sum("raw").alias("_total"),
        F.least(F.lit(1.0), F.coalesce(F.sum(F.exp("logprob")), F.lit(0.0))).alias("observed_mass"),
        F.max("missing").alias("truncated"),
    )
    return filled.join(per_request, "request_id").select(
        "request_id", "pos", "label", "raw", (F.col("raw") - F.col("_total")).alias("logprob"),
        "missing", "observed_mass", "truncated",
        (F.lit(raw_mode) & (F.col("observed_mass") < LOW_MASS)).alias("low_mass"),
    )


def pack_read(read: DataFrame) -> DataFrame:
    """(request_id, keys, raw, logprobs, missing, observed_mass, truncated): arrays in label order."""
    packed = read.groupBy("request_id").agg(
        F.sort_array(F.collect_list(F.struct("pos", "label", "raw", "logprob", "missing"))).alias("_l"),
        F.first("observed_mass").alias("observed_mass"), F.first("truncated").alias("truncated"),
    )
    return packed.select(
        "request_id",
        F.transform("_l", lambda x: x["label"]).alias("keys"),
        F.transform("_l", lambda x: x["raw"]).alias("raw"),
        F.transform("_l", lambda x: x["logprob"]).alias("logprobs"),
        F.transform(F.filter("_l", lambda x: x["missing"]), lambda x: x["label"]).alias("missing"),
        "observed_mass", "truncated",
    )


def echo_rescale(
    read: DataFrame, observed: DataFrame, echo: DataFrame
) -> DataFrame:
    """Missing labels of a constrained read filled from recorded echo scores.

    Echo scores are unconstrained; the likeliest observed surface, echo-scored too, gives the
    offset between the two scales. Without an anchor or with one at ``-Infinity`` the upper bound
    stays. ``echo``: request_id, surface, label, logprob.
    """
    anchor = observed.groupBy("request_id").agg(
        F.max_by(F.struct("surface", "logprob"), F.struct("logprob", "surface")).alias("a")
    )
    offsets = (
        anchor.join(echo.select("request_id", F.col("surface").alias("_s"), F.col("logprob").alias("_e")),
                    "request_id")
        .where((F.col("a.surface") == F.col("_s")) & (F.col("_e") > V.NEG_INF))
        .select("request_id", (F.col("_e") - F.col("a.logprob")).alias("offset"))
    )
    totals = echo.groupBy("request_id", "label").agg(log_sum("logprob").alias("echo"))
    joined = read.join(offsets, "request_id", "left").join(totals, ["request_id", "label"], "left")
    usable = F.col("missing") & F.col("offset").isNotNull() & F.col("echo").isNotNull()
    filled = joined.withColumn("raw", F.when(usable, F.col("echo") - F.col("offset")).otherwise(F.col("raw")))
    total = filled.groupBy("request_id").agg(log_sum("raw").alias("_t"))
    return filled.join(total, "request_id").select(
        "request_id", "pos", "label", "raw", (F.col("raw") - F.col("_t")).alias("logprob"), "missing",
        F.when(usable, "echo").when(F.col("missing"), "upper_bound").alias("policy"),
    )


# --- sequence scores -----------------------------------------------------------------------------


def sequence_scores(sequences: DataFrame, mode: str = "sum", null: DataFrame | None = None) -> DataFrame:
    """(request_id, label, score) of echo-scored continuations ``token_logprobs``: total logprob,
    mean per token, or difference to the content-free state's total (``pmi``; ``null`` has one row
    per label, or per question_id and label where both tables name questions)."""
    total = V.vsum(F.col("token_logprobs"))
    scored = sequences.where(F.size("token_logprobs") > 0).withColumn("total", total)
    if mode == "sum":
        return scored.select("request_id", "label", F.col("total").alias("score"))
    if mode == "mean":
        return scored.select("request_id", "label", (F.col("total") / F.size("token_logprobs")).alias("score"))
    if mode != "pmi":
        raise ValueError(f"unknown mode {mode!r}")
    on = [k for k in ("question_id", "label") if k in sequences.columns and k in null.columns]
    repeated = F.raise_error(F.concat(F.lit("several content-free scores of "), F.concat_ws(" / ", *on))).cast("double")
    totals = null.select(*on, V.vsum(F.col("token_logprobs")).alias("_null"))
    base = totals.groupBy(*on).agg(F.max("_null").alias("_null"), F.count(F.lit(1)).alias("_n"))
    base = lookup(base.select(*on, F.when(F.col("_n") == 1, F.col("_null")).otherwise(repeated).alias("_null")))
    pmi = (
        F.when(F.col("total") == V.NEG_INF, F.lit(V.NEG_INF))
        .when(F.col("_null") == V.NEG_INF, F.lit(float("inf")))
        .otherwise(F.col("total") - F.col("_null"))
    )
    # A label without a content-free score has no PMI: it stays, with NULL.
    return scored.join(base, on, "left").select("request_id", "label", pmi.alias("score"))


# --- token trie ----------------------------------------------------------------------------------


STEP_SLICES = 64
"""Slices that the requests of one label set are dealt to."""


def trie_read(
    labels: DataFrame, branches: DataFrame, tau: float = 1e-4
) -> DataFrame:
    """(request_id, label, raw, logprob, pruned, missing): chain-rule label logprobs over recorded
    trie reads, and the same renormalised over the request's labels.

    ``labels``: label, path ARRAY<token text>, and question_id where questions differ (``branches``
    then has it too). ``branches``: request_id, node (text so far), child (token text), logprob read
    at that decision point, ends (a label ends at the node). Children are renormalised at a node;
    where a label ends while longer ones go on, the end gets the mass the children leave. A point
    with one way on decides nothing and counts as 1. Below a decision point that was reached with
    less than ``tau``, or was not read, every label gets that point's probability (``pruned``); a
    child that a read does not list gets at most the least listed probability and what the list
    leaves over (``missing``). Both are upper bounds.
    """
    asked = ["question_id"] if "question_id" in labels.columns else []
    at_node = branches.groupBy("request_id", "node").agg(
        log_sum("logprob").alias("_total"), F.min("logprob").alias("_least"), F.max("ends").alias("_ends")
    )
    left = F.ln(F.greatest(1.0 - F.exp("_total"), F.lit(LEFTOVER_FLOOR)))
    reads = at_node.withColumn("_bound", F.least("_least", left))
    end = F.when(F.col("_total") >= 0, F.lit(V.NEG_INF)).otherwise(F.log1p(-F.exp("_total")))
    child = F.when(F.col("_ends") & (F.col("_total") < 0), F.col("logprob")).otherwise(
        F.col("logprob") - F.col("_total")
    )
    children = branches.join(reads, ["request_id", "node"]).select("request_id", "node", "child", child.alias("cond"))
    ends = reads.where("_ends").select("request_id", "node", F.lit("").alias("child"), end.alias("cond"))
    conditionals = children.unionByName(ends)
    # A label's steps: (text before token i, token i), plus its end.
    step = F.transform(
        "path",
        lambda t, i: F.struct(
            F.array_join(F.slice("path", F.lit(1), i), "").alias("node"), t.alias("child"), i.alias("depth")
        ),
    )
    last = F.array(
        F.struct(F.array_join("path", "").alias("node"), F.lit("").alias("child"), F.size("path").alias("depth"))
    )
    steps = labels.select(*asked, "label", F.explode(F.concat(step, last)).alias("s")).select(
        *asked, "label", "s.node", "s.child", "s.depth"
    )
    ways = steps.groupBy(*asked, "node").agg((F.count_distinct("child") == 1).alias("_only"))
    # Every request walks all steps of its labels. The steps are there once for each slice of the
    # requests, so neither one label set nor one question's requests meet under a single key.
    slices = F.explode(F.sequence(F.lit(0), F.lit(STEP_SLICES - 1))).alias("_slice")
    steps = steps.join(ways, [*asked, "node"]).select("*", slices)
    requests = branches.select("request_id", *asked).distinct().withColumn("_slice", F.pmod(F.xxhash64("request_id"), F.lit(STEP_SLICES)).cast("int"))
    grid = requests.join(lookup(steps), [*asked, "_slice"]).drop("_slice")
    walked = grid.join(conditionals, ["request_id", "node", "child"], "left").join(
        reads.select("request_id", "node", "_bound"), ["request_id", "node"], "left"
    )
    cond = F.when(F.col("_only"), F.lit(0.0)).otherwise(F.coalesce("cond", "_bound"))
    unlisted = ~F.col("_only") & F.col("cond").isNull() & F.col("_bound").isNotNull()
    walked = walked.withColumns({"_cond": F.coalesce(cond, F.lit(0.0)), "_unread": cond.isNull(), "_unlisted": unlisted})
    earlier = Window.partitionBy("request_id", "label").orderBy("depth").rowsBetween(Window.unboundedPreceding, -1)
    walked = walked.withColumn("before", F.coalesce(F.sum("_cond").over(earlier), F.lit(0.0)))
    limit = math.log(tau) if tau > 0 else V.NEG_INF
    cut = ~F.col("_only") & (F.col("before") > V.NEG_INF) & ((F.col("before") < limit) | F.col("_unread"))
    walked = walked.withColumn("_cut", cut)
    first_cut = F.min(F.when(F.col("_cut"), F.col("depth")))
    per_label = walked.groupBy("request_id", "label").agg(
        F.coalesce(F.min_by("before", F.when(F.col("_cut"), F.col("depth"))), F.sum("_cond")).alias("raw"),
        F.max("_cut").alias("pruned"),
        (F.min(F.when(F.col("_unlisted"), F.col("depth"))) < F.coalesce(first_cut, F.lit(2**30))).alias("missing"),
    ).withColumn("missing", F.coalesce("missing", F.lit(False)))
    total = per_label.groupBy("request_id").agg(log_sum("raw").alias("_t"))
    return per_label.join(total, "request_id").select(
        "request_id", "label", "raw", F.when(F.col("_t") > V.NEG_INF, F.col("raw") - F.col("_t")).alias("logprob"), "pruned", "missing"
    )


# --- surfaces ------------------------------------------------------------------------------------


def surface_class(token: Column, label: Column) -> Column:
    """``bare``, ``space`` or ``decorated`` writing of a label, NULL otherwise."""
    return (
        F.when(token == label, "bare")
        .when(token == F.concat(F.lit(" "), label), "space")
        .when(F.btrim(token, F.lit(DECORATIONS)) == label, "decorated")
    )


def surface_profile(topk: DataFrame, labels: DataFrame, keys: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """How labels are written, per ``keys`` group: (mass statistics, most frequent other tokens)."""
    from plumbline.operators.ranking import exact_quantiles, top_n_per_group

    keys = list(keys)
    names = broadcast_if_small(labels.select("pos", "label").distinct())
    core = F.btrim(F.col("token"), F.lit(DECORATIONS))
    matched = topk.join(names, core == F.col("label"), "left").withColumn(
        "cls", surface_class(F.col("token"), F.col("label"))
    )
    n_labels = labels.select("label").distinct().count()
    p = F.exp("logprob")
    per_item = matched.groupBy(*keys, "request_id").agg(
        *[F.coalesce(F.sum(F.when(F.col("cls") == c, p)), F.lit(0.0)).alias(c) for c in ("bare", "space", "decorated")],
        (F.lit(n_labels) - F.count_distinct(F.when(F.col("cls").isin("bare", "space"), F.col("label")))).alias("n_missing"),
    ).withColumn("observed", F.col("bare") + F.col("space"))
    stats = per_item.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"),
        *[F.avg(c).alias(f"mean_{c}") for c in ("bare", "space", "decorated")],
        F.avg("observed").alias("observed_mean"), F.min("observed").alias("observed_min"),
        F.avg("n_missing").alias("mean_missing"), F.count_if(F.col("n_missing") > 0).alias("items_with_missing"),
    )
    low = exact_quantiles(per_item, keys, "observed", {"observed_p05": 0.05}, "nearest")
    others = matched.where(F.col("cls").isNull()).groupBy(*keys, "token").agg(F.count(F.lit(1)).alias("n"))
    frequent = top_n_per_group(others, keys, [F.col("n").desc(), F.col("token")], 8)
    return stats.join(low, keys), frequent


def capacity(labels: DataFrame, top_k: int, variants: int = 2) -> DataFrame:
    """Per scheme: labels, distinct first tokens a constraint over its surfaces allows, and
    whether every competing surface fits one top-k list."""
    prefixes = labels.select(
        "scheme", "label",
        F.explode(F.transform(F.sequence(F.lit(1), F.length("surface")), lambda n: F.substring(F.col("surface"), F.lit(1), n))).alias("prefix"),
    )
    return prefixes.groupBy("scheme").agg(
        F.count_distinct("label").alias("n_labels"), F.count_distinct("prefix").alias("n_first_tokens")
    ).withColumn("fits", F.col("n_labels") * variants <= top_k)


def select_strategy(
    n_labels: Column, top_k: Column, structured: Column, prefill: Column, echo: Column
) -> Column:
    """The recorded read to use for a question: constrained or plain first token while every
    surface fits the top-k, else echo, else the trie; NULL when nothing applies. ``n_labels`` is
    NULL above the letter capacity."""
    fits = n_labels * F.when(prefill, 2).otherwise(1) <= top_k
    return (
        F.when(fits & structured, "constrained")
        .when(fits, "first_token")
        .when(~prefill, F.lit(None))
        .when(echo, "echo")
        .otherwise("trie")
    )


STRATEGIES: dict[str, Callable[..., DataFrame]] = {
    "first_token": first_token_read,
    "echo": sequence_scores,
    "trie": trie_read,
}
"""Scoring reads by name; add transforms over logged tables here."""
