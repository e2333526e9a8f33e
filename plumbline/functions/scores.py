"""Per-answer scores as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions import vectors as V


def nll(p_gold: Column, clip: float = V.NLL_CLIP) -> Column:
    return -F.ln(F.least(F.lit(1.0), F.greatest(p_gold, F.lit(clip))))


def brier(p: Column, p_gold: Column) -> Column:
    """``sum_k (p_k - [k = gold])^2``; a gold key outside the vector adds 1."""
    squares = F.aggregate(p, F.lit(0.0), lambda acc, x: acc + x * x)
    return squares - 2.0 * p_gold + 1.0


def with_scores(df: DataFrame) -> DataFrame:
    """Score answers by question type.

    Needs ``qtype`` (choice / score / noul), ``probs`` (key order; yes-no: [P(yes), P(no)]),
    ``gold_idx``, ``choice_idx`` (the returned choice), ``score`` (expected level) and ``idk_idx``.
    Adds correct, p_gold, nll, brier, confidence, abstained, abs_error, within_one. Choice answers
    are judged by the returned choice, levels by the most likely level, yes-no at 0.5. An answer
    without a choice is wrong; without gold nothing is scored (correct, p_gold, nll and brier are
    NULL), so every measure leaves the same rows out.
    """
    asked = F.col("gold_idx").isNotNull()
    is_noul, is_score = F.col("qtype") == "noul", F.col("qtype") == "score"
    yes = F.get("probs", F.lit(0))
    probs = F.when(is_noul, F.col("probs")).otherwise(V.normalize(F.col("probs")))
    predicted = (
        F.when(is_noul, F.when(yes >= 0.5, 0).otherwise(1))
        .when(is_score, V.argmax(F.col("_probs")))
        .otherwise(F.col("choice_idx"))
    )
    return (
        df.withColumn("_probs", probs)
        .withColumn("_predicted", predicted)
        .withColumn("p_gold", F.when(asked, V.at(F.col("_probs"), F.col("gold_idx"))))
        .withColumns(
            {
                "correct": F.when(asked, F.coalesce(F.col("_predicted") == F.col("gold_idx"), F.lit(False))),
                "nll": F.when(asked, nll(F.col("p_gold"))),
                "brier": F.when(~asked, F.lit(None)).when(
                    is_noul, 2.0 * (1.0 - F.col("p_gold")) * (1.0 - F.col("p_gold"))
                ).otherwise(brier(F.col("_probs"), F.col("p_gold"))),
                "confidence": V.at(F.col("_probs"), F.col("_predicted")),
                "abstained": F.coalesce(
                    (F.col("qtype") == "choice") & (F.col("choice_idx") == F.col("idk_idx")),
                    F.lit(False),
                ),
                "abs_error": F.when(is_score, F.abs(F.col("score") - F.col("gold_idx"))),
                "within_one": F.when(is_score, F.abs(F.col("_predicted") - F.col("gold_idx")) <= 1),
            }
        )
        .drop("_probs", "_predicted")
    )


def with_item_metrics(df: DataFrame, probs: str = "probs", gold: str = "gold_idx") -> DataFrame:
    """correct, confidence, nll and brier of a probability vector used as given; the prediction
    is its first maximum."""
    p, g = F.col(probs), F.col(gold)
    return df.withColumn("p_gold", V.at(p, g)).withColumns(
        {
            "correct": V.argmax(p) == g,
            "confidence": F.array_max(p),
            "nll": nll(F.col("p_gold")),
            "brier": brier(p, F.col("p_gold")),
        }
    )
