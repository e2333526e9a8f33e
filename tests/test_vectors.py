from __future__ import annotations

import math

import pytest
from pyspark.sql import functions as F

from plumbline.functions import confidence as conf
from plumbline.functions import vectors as V
from plumbline.functions.scores import brier, nll, with_scores


def one(spark, **columns):
    row = spark.range(1).select(*[c.alias(n) for n, c in columns.items()]).first()
    return row.asDict()


def arr(*xs):
    return F.array(*[F.lit(float(x)) for x in xs])


def test_nll_is_clipped(spark):
    got = one(spark, a=nll(F.lit(1.0)), b=nll(F.lit(0.5)), c=nll(F.lit(0.0)))
    assert got["a"] == pytest.approx(0) and got["b"] == pytest.approx(math.log(2))
    assert got["c"] == pytest.approx(-math.log(1e-6))


def test_brier_and_absent_gold(spark):
    got = one(spark, a=brier(arr(0.7, 0.2, 0.1), F.lit(0.7)), b=brier(arr(0.2, 0.5, 0.3), F.lit(0.3)), c=brier(arr(1.0, 0.0), F.lit(0.0)))
    assert got["a"] == pytest.approx(0.14) and got["b"] == pytest.approx(0.78) and got["c"] == pytest.approx(2.0)


def test_divergences(spark):
    got = one(
        spark, kl=V.kl_divergence(arr(1, 0), arr(0, 1)), same=V.kl_divergence(arr(0.3, 0.7), arr(0.3, 0.7)),
        tv=V.total_variation(arr(1, 0), arr(0, 1)),
    )
    assert got["kl"] == pytest.approx(-math.log(1e-12), rel=1e-6) and got["same"] == 0 and got["tv"] == 1


def test_log_space_with_zero_probability(spark):
    inf = float("-inf")
    got = one(
        spark, s=V.softmax(arr(0, inf)), l=V.logsumexp(arr(inf, inf)), e=V.logsumexp(F.array().cast("array<double>")),
        n=V.log_normalize(arr(inf, inf)), big=V.softmax(arr(1000, 1000)),
    )
    assert got["s"] == [1.0, 0.0] and got["l"] == inf and got["e"] == inf and got["n"] is None and got["big"] == [0.5, 0.5]


def test_first_maximum_wins_ties(spark):
    assert one(spark, i=V.argmax(arr(0.2, 0.4, 0.4)))["i"] == 1


def test_top_label_is_never_demoted(spark):
    got = one(
        spark, raised=V.with_top_label(arr(0.5, 0.3, 0.2), F.lit(0.9)), floor=V.with_top_label(arr(0.5, 0.3, 0.2), F.lit(0.0)),
        alone=V.with_top_label(arr(1.0, 0.0, 0.0), F.lit(0.4)),
    )
    assert got["raised"] == pytest.approx([0.9, 0.06, 0.04])
    assert got["floor"] == pytest.approx([0.375, 0.375, 0.25])
    assert got["alone"] == pytest.approx([0.4, 0.3, 0.3])


def test_rounding_to_a_step_goes_to_even(spark):
    got = one(spark, a=V.round_to_step(F.lit(0.125), 0.01), b=V.round_to_step(F.lit(0.135), 0.01), c=V.round_to_step(F.lit(1.2), 0.01, 1.0))
    assert got["a"] == 0.12 and got["b"] in (0.13, 0.14) and got["c"] == 1.0


def test_confidence_endpoints(spark):
    for name, fn in conf.CONFIDENCE_FUNCTIONS.items():
        got = one(spark, hot=fn(arr(0, 1, 0, 0), F.lit(False)), flat=fn(arr(0.25, 0.25, 0.25, 0.25), F.lit(False)))
        assert got["hot"] == pytest.approx(1.0), name
        assert got["flat"] == pytest.approx(0.25 if name == "max_prob" else 0.0, abs=1e-12), name
    levels = one(spark, near=conf.mode_distance(arr(0.0, 0.6, 0.4), F.lit(True)), far=conf.mode_distance(arr(0.4, 0.0, 0.6), F.lit(True)))
    assert levels["near"] > levels["far"]


def test_scores_by_question_type(spark):
    rows = [
        ("choice", [0.2, 0.2], 1, 1, None, 1), ("choice", [0.0, 0.0], 0, 0, None, None),
        ("score", [0.1, 0.6, 0.3], 2, None, 1.2, None), ("noul", [0.5, 0.5], 0, None, None, None),
    ]
    df = spark.createDataFrame(rows, "qtype string, probs array<double>, gold_idx int, choice_idx int, score double, idk_idx int")
    choice, empty, score, noul = with_scores(df).collect()
    assert choice["correct"] and choice["p_gold"] == 0.5 and choice["abstained"]
    assert empty["correct"] and empty["p_gold"] == 0 and empty["brier"] == pytest.approx(1.0)
    assert not score["correct"] and score["within_one"] and score["abs_error"] == pytest.approx(0.8)
    assert noul["correct"] and noul["brier"] == pytest.approx(0.5) and noul["abs_error"] is None


def test_validation(spark):
    nan = float("nan")
    got = one(
        spark, ok=V.valid_probs(arr(0.4, 0.6)), big=V.valid_probs(arr(0.4, 1.6)), nan=V.valid_probs(arr(nan, 0.5)), empty=V.valid_probs(arr(0, 0)),
        single=V.valid_probs(arr(1)), logits=V.valid_logits(arr(0, float("-inf"))), floored=V.valid_logits(arr(float("-inf"), float("-inf"))),
    )
    assert got == {"ok": True, "big": False, "nan": False, "empty": False, "single": False, "logits": True, "floored": False}
