"""Fitting and judging confidence functions against reported confidences."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.functions import vectors as V
from plumbline.functions.confidence import CONFIDENCE_FUNCTIONS
from plumbline.session import broadcast_if_small, cached, checkpoint

STEP = 0.01
GAMMA_MIN, GAMMA_MAX = 0.2, 5.0


def confidence_samples(answers: DataFrame) -> DataFrame:
    """(benchmark, kind, probs, reported) of choice and score answers with some mass."""
    return answers.where(F.col("qtype").isin("choice", "score") & (V.vsum(F.col("probs")) > 0)).select(
        "benchmark", F.col("qtype").alias("kind"), V.normalize("probs").alias("probs"),
        F.col("confidence").alias("reported"),
    )


def evaluate_confidence(samples: DataFrame, candidates: Sequence[str]) -> DataFrame:
    """Per candidate one row per (kind, k), per kind and overall: mean absolute error, exact share,
    share within 0.01 and bias of the prediction rounded to hundredths."""
    ordinal = F.col("kind") == "score"
    errors = F.array(
        *[
            F.struct(
                F.lit(name).alias("candidate"),
                (F.col("reported") - V.round_to_step(CONFIDENCE_FUNCTIONS[name](F.col("probs"), ordinal), STEP)).alias("err"),
            )
            for name in candidates
        ]
    )
    rows = samples.select("kind", F.size("probs").alias("k"), F.inline(errors))
    size = F.abs("err")
    return (
        rows.groupingSets([["candidate", "kind", "k"], ["candidate", "kind"], ["candidate"]], "candidate", "kind", "k")
        .agg(
            F.count(F.lit(1)).alias("n"), F.avg(size).alias("mae"),
            F.avg((size < STEP / 2).cast("double")).alias("exact"),
            F.avg((size < STEP * 1.5).cast("double")).alias("within_001"), F.avg("err").alias("bias"),
        )
        .withColumn("kind", F.coalesce("kind", F.lit("all")))
    )


def fit_power(samples: DataFrame, base: str, rounds: int = 5, points: int = 25) -> DataFrame:
    """(kind, gamma): the exponent in [0.2, 5] minimising the squared error of ``base ** gamma``.

    Each round sums the error on a grid of log-gammas for both kinds at once and narrows the
    bracket to the neighbours of the best point; a parabola through them finishes.
    """
    x = CONFIDENCE_FUNCTIONS[base](F.col("probs"), F.col("kind") == "score")
    rows = cached(samples.select("kind", x.alias("x"), "reported"))
    bracket = checkpoint(
        rows.select("kind").distinct().withColumns(
            {"low": F.ln(F.lit(GAMMA_MIN)), "high": F.ln(F.lit(GAMMA_MAX))}
        )
    )
    for _ in range(rounds):
        grid = F.transform(
            F.sequence(F.lit(0), F.lit(points - 1)),
            lambda i: F.struct(i.alias("i"), (F.col("low") + (F.col("high") - F.col("low")) * i / (points - 1)).alias("g")),
        )
        tried = rows.join(broadcast_if_small(bracket), "kind").select(
            "kind", "low", "high", "x", "reported", F.inline(grid)
        )
        err = F.pow(F.col("x"), F.exp("g")) - F.col("reported")
        loss = tried.groupBy("kind", "low", "high", "i").agg(F.avg(err * err).alias("loss"), F.first("g").alias("g"))
        best = loss.groupBy("kind", "low", "high").agg(
            F.min_by("g", F.struct("loss", "i")).alias("g"),
        )
        step = (F.col("high") - F.col("low")) / (points - 1)
        bracket = checkpoint(
            best.select(
                "kind", F.greatest(F.col("low"), F.col("g") - step).alias("low"),
                F.least(F.col("high"), F.col("g") + step).alias("high"),
            )
        )
    rows.unpersist()
    return bracket.select("kind", F.exp((F.col("low") + F.col("high")) / 2).alias("gamma"))
