"""Per-answer scores, validation and distances."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbline.functions import confidence as conf
from plumbline.functions import vectors as V
from plumbline.functions.scores import with_item_metrics, with_scores
from plumbline.operators import alignment as A
from plumbline.operators.records import answer_type_error
from plumbline.queries import derived as D
from plumbline.queries.registry import n, query, r
from plumbline.sources.readers import answer_vector, gold_index, valid_answer


def normalised(spark, sf):
    """System predictions renormalised, ready for item metrics."""
    return D.preds(spark, sf).withColumn("probs", V.normalize("probs"))


@query(
    "item_scores",
    f"""SELECT system, benchmark, item_id, correct, {r('p_gold', 'p_gold')}, {r('nll', 'nll')}, {r('brier', 'brier')},
    {r('confidence', 'confidence')}, abstained, {r('abs_error', 'abs_error')}, within_one FROM scored""",
    ("scored",),
)
def item_scores(spark, sf):
    return with_scores(D.all_preds(spark, sf)).select(
        "system", "benchmark", "item_id", "correct", "p_gold", "nll", "brier", "confidence",
        "abstained", "abs_error", "within_one",
    )


@query(
    "item_metrics",
    f"""SELECT system, item_id, correct, {r('confidence', 'confidence')}, {r('nll', 'nll')}, {r('brier', 'brier')}
    FROM metrics""",
    ("metrics",),
)
def item_metrics(spark, sf):
    return with_item_metrics(normalised(spark, sf)).select("system", "item_id", "correct", "confidence", "nll", "brier")


@query(
    "renormalized_probabilities",
    f"""SELECT system, item_id, pos, {r('p / list_reduce(probs, lambda a, y: a + y)', 'p')} FROM (
      SELECT system, item_id, probs, unnest(probs) AS p, unnest(range(0, len(probs))) AS pos FROM preds)""",
    ("preds",),
)
def renormalized_probabilities(spark, sf):
    p = D.preds(spark, sf)
    return p.select("system", "item_id", F.posexplode(V.normalize("probs")).alias("pos", "p"))


@query(
    "calibration_logits",
    f"""SELECT system, item_id, pos, {r('ln(greatest(1e-4, least(1.0, p)))', 'logit')},
      {r('ln(greatest(1e-4, least(1.0, p))) - ln(list_reduce(list_transform(probs, lambda x: greatest(1e-4, least(1.0, x))), lambda a, y: a + y))', 'log_softmax')}
    FROM (SELECT system, item_id, probs, unnest(probs) AS p, unnest(range(0, len(probs))) AS pos FROM preds)""",
    ("preds",),
)
def calibration_logits(spark, sf):
    z = V.probs_to_logits(F.col("probs"))
    p = D.preds(spark, sf)
    return p.select("system", "item_id", F.posexplode(F.arrays_zip(z.alias("z"), V.log_softmax(z).alias("l")))).select(
        "system", "item_id", "pos", F.col("col.z").alias("logit"), F.col("col.l").alias("log_softmax")
    )


@query(
    "paired_divergence",
    f"""SELECT benchmark, item_id,
      {r('greatest(0, list_reduce(list_transform(pa, lambda x, i: (x + 1e-12) / (1 + 10 * 1e-12) * (ln((x + 1e-12) / (1 + 10 * 1e-12)) - ln((pb[i] + 1e-12) / (1 + 10 * 1e-12)))), lambda s, y: s + y))', 'kl')},
      {r('0.5 * list_reduce(list_transform(pa, lambda x, i: abs(x - pb[i])), lambda s, y: s + y)', 'tv')}
    FROM (SELECT a.benchmark, a.item_id, a.probs AS pa, b.probs AS pb FROM metrics a JOIN metrics b
          ON a.item_id = b.item_id AND a.system = 'a' AND b.system = 'b')""",
    ("metrics",),
)
def paired_divergence(spark, sf):
    pairs = A.pair_systems(normalised(spark, sf), "a", "b", ["probs"])
    return pairs.select(
        "benchmark", "item_id",
        V.kl_divergence(F.col("probs_a"), F.col("probs_b")).alias("kl"),
        V.total_variation(F.col("probs_a"), F.col("probs_b")).alias("tv"),
    )


@query(
    "answer_drift",
    f"""WITH samples AS (
      SELECT conv_id::VARCHAR AS conv, turn AS sample, role AS outcome, least(1.0, length(text) / 4000.0) AS p FROM conversations),
    n AS (SELECT conv, count(DISTINCT sample) AS n_samples FROM samples GROUP BY 1),
    per AS (SELECT conv, outcome, max(p) AS hi, CASE WHEN count(DISTINCT sample) < any_value(n_samples) THEN 0 ELSE min(p) END AS lo
            FROM samples JOIN n USING (conv) GROUP BY 1, 2)
    SELECT conv, {n('any_value(n_samples)', 'n_samples')}, {r('max(hi - lo)', 'max_abs_delta')} FROM per JOIN n USING (conv) GROUP BY 1""",
)
def answer_drift(spark, sf):
    c = D.table(spark, sf, "conversations")
    samples = c.select(
        F.col("conv_id").cast("string").alias("conv"), F.col("turn").alias("sample"), F.col("role").alias("outcome"),
        F.least(F.lit(1.0), F.length("text") / 4000.0).alias("p"),
    )
    return A.drift(samples, ["conv"])


@query(
    "repeat_stability",
    f"""WITH base AS (SELECT system, benchmark, item_id, probs, len(probs) k FROM metrics),
    shaken AS (
      SELECT system, benchmark, item_id, s AS sample, probs AS ref,
             list_transform(probs, lambda x: (1 - 0.01 * s * (item_id::BIGINT % 7)) * x + 0.01 * s * (item_id::BIGINT % 7) / 10.0) AS p
      FROM base, (SELECT unnest([1, 2, 3]) AS s)),
    rows AS (
      SELECT system, benchmark, 0.5 * list_reduce(list_transform(ref, lambda x, i: abs(x - p[i])), lambda a, y: a + y) AS tv,
             list_position(ref, list_max(ref)) <> list_position(p, list_max(p)) AS flip
      FROM shaken)
    SELECT system, benchmark, {n('count(*)', 'samples')}, {r('avg(tv)', 'tv_mean')}, {r('max(tv)', 'tv_max')},
      {r('avg((tv = 0)::INTEGER)', 'share_zero')}, {r('avg((tv < 0.01)::INTEGER)', 'share_below_001')},
      {n('count(*) FILTER (WHERE flip)', 'argmax_flips')}, {r('quantile_disc(tv, 0.95)', 'tv_p95')}
    FROM rows GROUP BY 1, 2""",
    ("metrics",),
)
def repeat_stability(spark, sf):
    base = normalised(spark, sf).select("system", "benchmark", "item_id", "probs")
    shaken = base.withColumn("sample", F.explode(F.array(*[F.lit(s) for s in (1, 2, 3)])))
    w = 0.01 * F.col("sample") * (F.col("item_id").cast("bigint") % 7)
    shaken = shaken.withColumn("probs", F.transform("probs", lambda x: (1 - w) * x + w / 10.0))
    return A.repeat_stability(shaken, base, ["system", "benchmark"])


# --- validation ------------------------------------------------------------------------------------


@query(
    "probability_validation",
    f"""SELECT lang, {n('count(*)', 'rows')}, {n('count(*) FILTER (WHERE p1 <= 1 AND p2 >= 0 AND p1 + p2 > 0)', 'valid')} FROM (
      SELECT lang, n_chars / 4000.0 AS p1, CASE WHEN n_chars % 5 = 0 THEN -0.1 ELSE greatest(0, 1 - n_chars / 4000.0) END AS p2 FROM documents)
    GROUP BY 1""",
)
def probability_validation(spark, sf):
    d = D.table(spark, sf, "documents")
    p1 = F.col("n_chars") / 4000.0
    p2 = F.when(F.col("n_chars") % 5 == 0, -0.1).otherwise(F.greatest(F.lit(0.0), 1 - p1))
    return d.groupBy("lang").agg(
        F.count(F.lit(1)).alias("rows"), F.count_if(V.valid_probs(F.array(p1, p2))).alias("valid")
    )


@query(
    "answer_validation",
    f"""SELECT benchmark, {n('count(*)', 'n')}, {n("count(*) FILTER (WHERE item_id::BIGINT % 9 <> 0)", 'n_valid')} FROM preds GROUP BY 1""",
    ("preds",),
)
def answer_validation(spark, sf):
    """Logged answers whose choice is not one of their keys are found."""
    p = D.preds(spark, sf)
    broken = F.col("item_id").cast("bigint") % 9 == 0
    answer = F.struct(
        F.lit("choice").alias("type"),
        F.when(broken, F.lit("?")).otherwise(F.get("keys", F.col("choice_idx"))).alias("choice"),
        F.lit(None).cast("double").alias("score"), F.lit(None).cast("double").alias("noul"),
        F.lit(None).cast("map<string,string>").alias("legend"),
        F.map_from_arrays("keys", "probs").alias("probabilities"),
    )
    return p.withColumn("answer", answer).groupBy("benchmark").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(valid_answer(F.col("answer"), F.col("keys"))).alias("n_valid")
    )


@query(
    "answer_vectors",
    f"""SELECT system, item_id, {n('gold_idx', 'gold')}, {r('probs[gold_idx + 1]', 'p_gold')}, {r('list_reduce(probs, lambda a, y: a + y)', 'total')} FROM all_preds""",
    ("all_preds",),
)
def answer_vectors(spark, sf):
    """Answers as logged (map of probabilities or P(yes)) put back in key order, with the gold index
    recovered from the gold's text."""
    p = D.all_preds(spark, sf)
    noul = F.col("qtype") == "noul"
    answer = F.struct(
        F.col("qtype").alias("type"), F.get("probs", F.lit(0)).alias("noul"),
        F.when(~noul, F.map_from_arrays("keys", "probs")).alias("probabilities"),
    )
    gold = F.when(F.col("qtype") == "score", F.col("gold_idx").cast("string")).otherwise(F.get("keys", F.col("gold_idx")))
    vector = p.withColumn("_v", answer_vector(answer, F.col("keys"))).withColumn(
        "gold", gold_index(F.col("qtype"), gold, F.col("keys"))
    )
    return vector.select("system", "item_id", "gold", V.at(F.col("_v"), F.col("gold")).alias("p_gold"), V.vsum(F.col("_v")).alias("total"))


@query(
    "answer_type_mismatch",
    f"""SELECT system, {n('count(*)', 'n')}, {n("count(*) FILTER (WHERE qtype <> CASE WHEN gold_idx = 1 THEN 'noul' ELSE 'choice' END)", 'n_mismatch')} FROM all_preds GROUP BY 1""",
    ("all_preds",),
)
def answer_type_mismatch(spark, sf):
    answered = F.when(F.col("gold_idx") == 1, "noul").otherwise("choice")
    error = answer_type_error(F.col("qtype"), answered)
    return D.all_preds(spark, sf).groupBy("system").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(error["type"] == "AnswerMismatch").alias("n_mismatch")
    )


# --- confidence ------------------------------------------------------------------------------------

_CONF = {
    "peak_linear": "greatest(0, least(1, (k * list_max(p) - 1) / (k - 1)))",
    "max_prob": "greatest(0, least(1, list_max(p)))",
    "margin": "greatest(0, least(1, list_reverse_sort(p)[1] - list_reverse_sort(p)[2]))",
    "one_minus_norm_entropy": "greatest(0, least(1, 1 + list_reduce(list_transform(p, lambda x: CASE WHEN x > 0 THEN x * ln(x) ELSE 0 END), lambda a, y: a + y) / ln(k)))",
    "mode_distance": """greatest(0, least(1, 1 - CASE WHEN qtype = 'score'
        THEN list_reduce(list_transform(p, lambda x, i: x * abs(i - list_position(p, list_max(p)))), lambda a, y: a + y)
          / CASE WHEN k % 2 = 0 THEN k / 4.0 ELSE (k * k - 1) / (4.0 * k) END
        ELSE (1 - list_max(p)) / ((k - 1) / k) END))""",
}


@query(
    "confidence_functions",
    "SELECT system, item_id, " + ", ".join(r(v, k) for k, v in _CONF.items())
    + " FROM (SELECT system, item_id, qtype, list_transform(probs, lambda x: x / list_reduce(probs, lambda a, y: a + y)) AS p, len(probs)::DOUBLE AS k FROM all_preds WHERE qtype <> 'noul')",
    ("all_preds",),
)
def confidence_functions(spark, sf):
    p = D.all_preds(spark, sf).where("qtype <> 'noul'").withColumn("p", V.normalize("probs"))
    ordinal = F.col("qtype") == "score"
    return p.select(
        "system", "item_id", *[fn(F.col("p"), ordinal).alias(name) for name, fn in conf.CONFIDENCE_FUNCTIONS.items()]
    )


@query(
    "assembled_answers",
    f"""SELECT system, item_id, list_position(p, list_max(p))::BIGINT - 1 AS choice,
      {r("round_even(" + _CONF['mode_distance'] + " / 0.01, 0) * 0.01", 'confidence')},
      {r("CASE WHEN qtype = 'score' THEN round_even(list_reduce(list_transform(p, lambda x, i: (i - 1) * x), lambda a, y: a + y) / 0.01, 0) * 0.01 END", 'score')},
      {r("round_even(p[1] / 0.01, 0) * 0.01", 'first_probability')}
    FROM (SELECT system, item_id, qtype, list_transform(probs, lambda x: x / list_reduce(probs, lambda a, y: a + y)) AS p, len(probs)::DOUBLE AS k FROM all_preds WHERE qtype <> 'noul')""",
    ("all_preds",),
)
def assembled_answers(spark, sf):
    """Answers assembled from calibrated probabilities: first maximum, expected level, confidence,
    all rounded to hundredths with halves to even."""
    p = D.all_preds(spark, sf).where("qtype <> 'noul'").withColumn("p", V.normalize("probs"))
    ordinal = F.col("qtype") == "score"
    expected = V.vsum(F.transform("p", lambda x, i: x * i))
    return p.select(
        "system", "item_id", V.argmax(F.col("p")).alias("choice"),
        V.round_to_step(conf.mode_distance(F.col("p"), ordinal), 0.01, 1.0).alias("confidence"),
        F.when(ordinal, V.round_to_step(expected, 0.01, 4.0)).alias("score"),
        V.round_to_step(F.get("p", F.lit(0)), 0.01, 1.0).alias("first_probability"),
    )
