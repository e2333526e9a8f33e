"""Probability and log-probability vectors as ARRAY<DOUBLE> column expressions.

``-Infinity`` is a zero-probability entry, NULL is "not observed". Sub-expressions used more than
once inside a lambda are bound with :func:`let`, because a lambda body is evaluated per element.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

PROB_FLOOR = 1e-4
"""Probability floor before logarithms are taken for calibration."""
LOGIT_BOUND = 30.0
"""Bound on log-odds features."""
NLL_CLIP = 1e-6
"""Smallest gold probability the log loss uses."""
KL_SMOOTHING = 1e-12

NEG_INF = float("-inf")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` evaluated once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def vsum(v: Column) -> Column:
    """Left-to-right sum of a DOUBLE array (0 when empty)."""
    return F.aggregate(v, F.lit(0.0), lambda acc, x: acc + x)


def dot(a: Column, b: Column) -> Column:
    return vsum(F.zip_with(a, b, lambda x, y: x * y))


def normalize(p: Column | str) -> Column:
    """``p`` divided by its sum; an all-zero vector stays zero."""
    p = F.col(p) if isinstance(p, str) else p
    return let(vsum(p), lambda s: F.when(s > 0, F.transform(p, lambda x: x / s)).otherwise(p))


def logsumexp(z: Column) -> Column:
    """Stable ``ln(sum(exp(z)))``; ``-Infinity`` for an empty or all ``-Infinity`` array."""
    peak = F.coalesce(F.array_max(z), F.lit(NEG_INF))
    return let(
        peak,
        lambda m: F.when(m == NEG_INF, NEG_INF).otherwise(
            m + F.ln(F.aggregate(z, F.lit(0.0), lambda acc, x: acc + F.exp(x - m)))
        ),
    )


def is_logprob_vector(z: Column) -> Column:
    """Neither NaN nor ``+Infinity`` occurs."""
    return F.forall(z, lambda x: ~F.isnan(x) & (x < float("inf")))


def log_normalize(z: Column) -> Column:
    """``z - logsumexp(z)``; NULL when no entry is finite."""
    return let(
        logsumexp(z),
        lambda s: F.when(s > NEG_INF, F.transform(z, lambda x: x - s)),
    )


def softmax(z: Column) -> Column:
    return let(
        F.array_max(z),
        lambda m: let(
            F.transform(z, lambda x: F.exp(x - m)),
            lambda e: let(vsum(e), lambda s: F.transform(e, lambda x: x / s)),
        ),
    )


def centered(z: Column) -> Column:
    """Shifted so the largest entry is 0."""
    return let(F.array_max(z), lambda m: F.transform(z, lambda x: x - m))


def log_softmax(z: Column) -> Column:
    return let(logsumexp(z), lambda s: F.transform(z, lambda x: x - s))


def probs_to_logits(p: Column, floor: float = PROB_FLOOR) -> Column:
    """``ln(clip(p, floor, 1))``: finite logits from probabilities that may hold exact zeros."""
    return F.transform(p, lambda x: F.ln(F.greatest(F.lit(floor), F.least(F.lit(1.0), x))))


def argmax(p: Column) -> Column:
    """0-based index of the first maximum."""
    return (F.array_position(p, F.array_max(p)) - 1).cast("int")


def at(p: Column, index: Column) -> Column:
    """Entry ``index`` (0-based), 0 outside the array."""
    return F.coalesce(F.get(p, index), F.lit(0.0))


def valid_probs(p: Column, tolerance: float = 1e-9) -> Column:
    """At least two finite entries in [0, 1] and some mass."""
    inside = F.forall(p, lambda x: ~F.isnan(x) & (x >= 0.0) & (x <= 1.0 + tolerance))
    return (F.size(p) >= 2) & inside & (vsum(p) > 0)


def valid_logits(z: Column) -> Column:
    """At least two entries, no NaN or ``+Infinity``, one finite."""
    return (F.size(z) >= 2) & is_logprob_vector(z) & F.exists(z, lambda x: x > NEG_INF)


def in_key_order(keys: Column, by_key: Column) -> Column:
    """The values of a MAP in the order of ``keys``, 0 for an absent key."""
    return F.transform(keys, lambda k: F.coalesce(F.try_element_at(by_key, k), F.lit(0.0)))


def yes_no(p_yes: Column) -> Column:
    return F.array(p_yes, F.lit(1.0) - p_yes)


# --- top label ---------------------------------------------------------------------------------


def top_label_logit(p: Column) -> Column:
    """Log-odds of the top entry against the sum of the others, within +-30."""

    def odds(index: Column) -> Column:
        top = F.get(p, index)
        rest = F.aggregate(
            F.transform(p, lambda x, i: F.when(i == index, 0.0).otherwise(x)),
            F.lit(0.0),
            lambda acc, x: acc + x,
        )
        return F.when(rest <= 0, F.lit(LOGIT_BOUND)).otherwise(
            F.greatest(
                F.lit(-LOGIT_BOUND), F.least(F.lit(LOGIT_BOUND), F.ln(top) - F.ln(rest))
            )
        )

    return let(argmax(p), odds)


def with_top_label(p: Column, confidence: Column) -> Column:
    """The top entry set to ``confidence`` and the others rescaled to share the rest.

    The top entry is never demoted: ``confidence`` is raised to ``second / (second + rest)`` when
    it is lower (``1 / K`` when the others hold nothing, which then share equally).
    """
    size = F.size(p)

    def build(index: Column) -> Column:
        others = F.transform(p, lambda x, i: F.when(i == index, F.lit(0.0)).otherwise(x))

        def spread(o: Column) -> Column:
            rest = vsum(o)
            second = F.array_max(o)

            def fill(r: Column) -> Column:
                floor = F.when(r > 0, second / (second + r)).otherwise(F.lit(1.0) / size)

                def place(c: Column) -> Column:
                    share = F.when(r > 0, F.lit(1.0) / r)
                    return let(
                        share,
                        lambda s: F.transform(
                            o,
                            lambda x, i: F.when(i == index, c)
                            .when(s.isNull(), (1.0 - c) / (size - 1))
                            .otherwise(x * s * (1.0 - c)),
                        ),
                    )

                clipped = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.greatest(confidence, floor)))
                return let(clipped, place)

            return let(rest, fill)

        return let(others, spread)

    return let(argmax(p), build)


# --- distances ---------------------------------------------------------------------------------


def kl_divergence(p: Column, q: Column, eps: float = KL_SMOOTHING) -> Column:
    """KL(p || q) in nats after adding ``eps`` to both vectors, never negative."""
    scale = 1.0 + F.size(p) * F.lit(eps)

    def term(x: Column, y: Column) -> Column:
        a = (F.greatest(x, F.lit(0.0)) + eps) / scale
        b = (F.greatest(y, F.lit(0.0)) + eps) / scale
        return a * (F.ln(a) - F.ln(b))

    return F.greatest(F.lit(0.0), vsum(F.zip_with(p, q, term)))


def total_variation(p: Column, q: Column) -> Column:
    return 0.5 * vsum(F.zip_with(p, q, lambda x, y: F.abs(x - y)))


def round_to_step(x: Column, step: float, upper: float | None = None) -> Column:
    """``x`` to the nearest multiple of ``step``, halves to the even multiple, within
    [0, ``upper``] when a bound is given."""
    value = F.round(F.rint(x / step) * step, 12)
    if upper is None:
        return value
    return F.greatest(F.lit(0.0), F.least(F.lit(float(upper)), value))
