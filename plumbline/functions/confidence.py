"""Confidence functions: one number in [0, 1] from a probability vector.

A confidence function takes the probabilities in key order and a BOOLEAN column telling whether
the keys are ordered levels. Register more with :func:`confidence_function`.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from plumbline.functions import vectors as V

ConfidenceFunction = Callable[[Column, Column], Column]
CONFIDENCE_FUNCTIONS: dict[str, ConfidenceFunction] = {}


def confidence_function(name: str) -> Callable[[ConfidenceFunction], ConfidenceFunction]:
    def register(fn: ConfidenceFunction) -> ConfidenceFunction:
        if name in CONFIDENCE_FUNCTIONS:
            raise ValueError(f"confidence function {name!r} is already registered")
        CONFIDENCE_FUNCTIONS[name] = fn
        return fn

    return register


def unit(x: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))


@confidence_function("peak_linear")
def peak_linear(p: Column, ordinal: Column) -> Column:
    """0 for a uniform vector, 1 for one-hot, linear in the largest entry."""
    k = F.size(p)
    return unit((k * F.array_max(p) - 1.0) / (k - 1))


@confidence_function("max_prob")
def max_prob(p: Column, ordinal: Column) -> Column:
    return unit(F.array_max(p))


@confidence_function("margin")
def margin(p: Column, ordinal: Column) -> Column:
    """Gap between the two largest entries."""
    return unit(V.let(F.sort_array(p, asc=False), lambda s: F.get(s, F.lit(0)) - F.get(s, F.lit(1))))


@confidence_function("one_minus_norm_entropy")
def one_minus_norm_entropy(p: Column, ordinal: Column) -> Column:
    plogp = F.aggregate(
        p, F.lit(0.0), lambda acc, x: acc + F.when(x > 0, x * F.ln(x)).otherwise(F.lit(0.0))
    )
    return unit(1.0 + plogp / F.ln(F.size(p).cast("double")))


def uniform_spread(k: Column, ordinal: Column) -> Column:
    """Smallest expected distance of a uniform answer from one key: 0/1 distance, or level
    distance for ordered keys."""
    k = k.cast("double")
    levels = F.when(k % 2 == 0, k / 4.0).otherwise((k * k - 1.0) / (4.0 * k))
    return F.when(ordinal, levels).otherwise((k - 1.0) / k)


@confidence_function("mode_distance")
def mode_distance(p: Column, ordinal: Column) -> Column:
    """1 minus the expected distance from the first mode, relative to :func:`uniform_spread`."""
    levels = V.let(
        V.argmax(p), lambda m: V.vsum(F.transform(p, lambda x, i: x * F.abs(i - m)))
    )
    spread = F.when(ordinal, levels).otherwise(1.0 - F.array_max(p))
    return unit(1.0 - spread / uniform_spread(F.size(p), ordinal))
