"""Pairing and aligning systems on shared items, and checking that they agree on what was asked."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.session import cached, lookup

ITEM = ("benchmark", "item_id")


def pair_systems(
    scored: DataFrame, a: str, b: str, values: Sequence[str], item: Sequence[str] = ITEM
) -> DataFrame:
    """Items both systems answered, with ``<value>_a`` and ``<value>_b``: one grouped pass over
    the table instead of a self-join."""
    sides = {}
    for name, system in (("a", a), ("b", b)):
        mine = F.col("system") == system
        sides[f"n_{name}"] = F.count_if(mine)
        for v in values:
            sides[f"{v}_{name}"] = F.max(F.when(mine, F.col(v)))
    paired = (
        scored.where(F.col("system").isin(a, b))
        .groupBy(*item)
        .agg(*[c.alias(n) for n, c in sides.items()])
    )
    return paired.where((F.col("n_a") > 0) & (F.col("n_b") > 0)).drop("n_a", "n_b")


def shared_items(scored: DataFrame, n_systems: int) -> DataFrame:
    """(benchmark, item_id, disagrees): items every one of ``n_systems`` answered, flagged when
    systems recorded different keys or gold."""
    asked = F.struct(F.array_join("keys", "\x1f").alias("keys"), "gold_idx")
    return (
        scored.groupBy(*ITEM)
        .agg(
            F.count_distinct("system").alias("_n"),
            (F.min(asked) != F.max(asked)).alias("disagrees"),
        )
        .where(F.col("_n") == n_systems)
        .select(*ITEM, "disagrees")
    )


def align(scored: DataFrame, n_systems: int, disagreeing: str = "raise") -> DataFrame:
    """Rows of items every system answered, in benchmarks every system has. Items whose keys or gold
    the systems recorded differently are an error (``raise``) or, where a caller reports them by
    :func:`shared_items`, left out (``leave out``)."""
    have_all = (
        scored.select("benchmark", "system").distinct().groupBy("benchmark").count()
        .where(F.col("count") == n_systems).select("benchmark")
    )
    shared = shared_items(scored, n_systems)
    if disagreeing == "raise":
        shared = cached(shared)
        first = shared.where("disagrees").select(*ITEM).head(5)
        if first:
            shared.unpersist()
            raise ValueError(f"systems disagree on keys or gold of {[tuple(r) for r in first]}")
    elif disagreeing != "leave out":
        raise ValueError(f"disagreeing is 'raise' or 'leave out', not {disagreeing!r}")
    kept = shared.where(~F.col("disagrees")).select(*ITEM)
    return scored.join(lookup(have_all), "benchmark", "left_semi").join(kept, list(ITEM), "left_semi")


def left_out(scored: DataFrame, n_systems: int) -> DataFrame:
    """Per benchmark: items answered by some system, by all of them, and left out by alignment."""
    per_item = scored.groupBy(*ITEM).agg(F.count_distinct("system").alias("_n"))
    return per_item.groupBy("benchmark").agg(
        F.count(F.lit(1)).alias("n_any"),
        F.count_if(F.col("_n") == n_systems).alias("n_all"),
        F.count_if(F.col("_n") < n_systems).alias("n_left_out"),
    )


def field_differences(recorded: DataFrame, current: DataFrame, ignore: Sequence[str] = ()) -> DataFrame:
    """Fields (name, value) that differ between two descriptions, missing ones included."""
    a = recorded.select("name", F.col("value").alias("recorded"))
    b = current.select("name", F.col("value").alias("current"))
    both = a.join(b, "name", "full_outer")
    return both.where(
        ~F.col("recorded").eqNullSafe(F.col("current")) & ~F.col("name").isin(list(ignore) or [""])
    )


def one_sided(
    a: DataFrame, b: DataFrame, declared: DataFrame | None = None, item: Sequence[str] = ITEM
) -> DataFrame:
    """Items only one side answered that are not declared unanswered by the other: any row here
    makes a pairing invalid. ``declared``: item columns plus ``side``."""
    left = a.select(*item).withColumn("_a", F.lit(True))
    right = b.select(*item).withColumn("_b", F.lit(True))
    single = (
        left.join(right, list(item), "full_outer")
        .where(F.col("_a").isNull() | F.col("_b").isNull())
        .select(*item, F.when(F.col("_a").isNull(), "a").otherwise("b").alias("side"))
    )
    return single if declared is None else single.join(declared, [*item, "side"], "left_anti")


def data_diff(
    ours: DataFrame, theirs: DataFrame, keys: Sequence[str], values: Sequence[str], tolerance: float
) -> DataFrame:
    """(keys, metric, ours, theirs) where values differ by more than ``tolerance`` or one side
    lacks the row."""

    def long(df: DataFrame, name: str) -> DataFrame:
        pairs = F.array(*[F.struct(F.lit(v).alias("metric"), F.col(v).cast("double").alias(name)) for v in values])
        return df.select(*keys, F.inline(pairs))

    both = long(ours, "ours").join(long(theirs, "theirs"), [*keys, "metric"], "full_outer")
    close = F.abs(F.col("ours") - F.col("theirs")) <= tolerance
    same_null = F.col("ours").isNull() & F.col("theirs").isNull()
    return both.where(~F.coalesce(close, same_null))


def price_of(systems: DataFrame, prices: DataFrame) -> DataFrame:
    """Systems with their price id and where it came from: the named price, the snapshot recorded
    with the run, machine time for local kinds, or the model's price.

    ``systems``: system_id, price_id, token_price_id (recorded snapshot), kind, model.
    """
    known = prices.select(F.col("price_id").alias("_known"))
    by_id = systems.join(known, systems.price_id == F.col("_known"), "left").withColumnRenamed("_known", "_by_id")
    by_model = by_id.join(known, by_id.model == F.col("_known"), "left")
    named = F.col("price_id").isNotNull()
    return by_model.select(
        "system_id",
        F.when(named, F.coalesce("_by_id", "token_price_id"))
        .when(F.col("kind").isin("emulator", "clm"), "local-gpu")
        .otherwise(F.col("_known")).alias("resolved"),
        F.when(named & F.col("_by_id").isNotNull(), "price_id")
        .when(named & F.col("token_price_id").isNotNull(), "snapshot")
        .when(named, "none")
        .when(F.col("kind").isin("emulator", "clm"), "machine_time")
        .when(F.col("_known").isNotNull(), "model")
        .otherwise("none").alias("source"),
    )


def paired_distribution_summary(pairs: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Agreement, KL (mean, median, p95, max), TV and |dp(gold)| of paired answers ``probs_a``,
    ``probs_b``, ``gold_idx``; with MAPs ``raw_a`` and ``raw_b`` also the :func:`raw_comparison`."""
    from plumbline.functions import vectors as V
    from plumbline.operators.ranking import exact_quantiles

    keys = list(keys)
    rows = pairs.select(
        *keys,
        V.kl_divergence(F.col("probs_a"), F.col("probs_b")).alias("kl"),
        V.total_variation(F.col("probs_a"), F.col("probs_b")).alias("tv"),
        (V.argmax(F.col("probs_a")) == V.argmax(F.col("probs_b"))).cast("double").alias("agree"),
        F.abs(V.at(F.col("probs_b"), F.col("gold_idx")) - V.at(F.col("probs_a"), F.col("gold_idx"))).alias("dp"),
    )
    means = rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.avg("agree").alias("agreement"), F.avg("kl").alias("kl_mean"),
        F.max("kl").alias("kl_max"), F.avg("tv").alias("tv_mean"), F.avg("dp").alias("abs_d_p_gold"),
    )
    out = means.join(exact_quantiles(rows, keys, "kl", {"kl_median": 0.5, "kl_p95": 0.95}), keys)
    return out.join(raw_comparison(pairs, keys), keys) if {"raw_a", "raw_b"} <= set(pairs.columns) else out


def raw_comparison(pairs: DataFrame, keys: Sequence[str], a: str = "raw_a", b: str = "raw_b") -> DataFrame:
    """Two reads' raw label logprobs, MAPs that list some labels each, merged label by label: per group
    the mean absolute difference where both are finite, and how many labels are finite in both, listed
    by one side only, or listed by both with a non-finite one (``n_nonfinite`` is all that are not
    finite in both). ``d_mass`` and ``abs_d_mass``: mean difference of the listed probability."""
    from plumbline.functions import vectors as V

    def finite(x: Column) -> Column:
        return x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))

    def mass(name: str) -> Column:
        return V.vsum(F.transform(F.filter(F.map_values(name), lambda x: ~F.isnan(x) & (x < float("inf"))), lambda x: F.exp(x)))

    labels = F.array_distinct(F.concat(F.map_keys(a), F.map_keys(b)))
    merged = F.transform(labels, lambda k: F.struct(F.try_element_at(a, k).alias("x"), F.try_element_at(b, k).alias("y"), F.array_contains(F.map_keys(a), k).alias("in_a"), F.array_contains(F.map_keys(b), k).alias("in_b")))
    both = lambda m: finite(m["x"]) & finite(m["y"])
    one = lambda m: m["in_a"] != m["in_b"]
    rows = pairs.withColumn("_m", merged).select(
        *keys,
        F.size(F.filter("_m", both)).alias("_finite"), F.size(F.filter("_m", one)).alias("_one"),
        F.size(F.filter("_m", lambda m: ~one(m) & ~both(m))).alias("_other"),
        V.vsum(F.transform(F.filter("_m", both), lambda m: F.abs(m["y"] - m["x"]))).alias("_sum"), (mass(b) - mass(a)).alias("_d"),
    )
    return rows.groupBy(*keys).agg(
        F.try_divide(F.sum("_sum"), F.sum("_finite")).alias("raw_mae"), F.sum("_finite").alias("n_finite"), F.sum("_one").alias("n_one_sided"),
        F.sum("_other").alias("n_infinite"), F.sum(F.col("_one") + F.col("_other")).alias("n_nonfinite"), F.avg("_d").alias("d_mass"), F.avg(F.abs("_d")).alias("abs_d_mass"),
    )


def answer_deltas(pairs: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Per-type deltas of paired answers (``qtype``, ``probs_a/b``, ``score_a/b``). Choices agree if the
    returned ones (``choice_a/b``) are the same; without those columns, if the likeliest are."""
    from plumbline.functions import vectors as V

    tv = V.total_variation(F.col("probs_a"), F.col("probs_b"))
    returned = {"choice_a", "choice_b"} <= set(pairs.columns)
    same = F.col("choice_a").eqNullSafe(F.col("choice_b")) if returned else V.argmax(F.col("probs_a")) == V.argmax(F.col("probs_b"))
    d_score = F.abs(F.col("score_b") - F.col("score_a"))
    d_noul = F.abs(F.get("probs_b", F.lit(0)) - F.get("probs_a", F.lit(0)))

    def when(kind: str, value: Column) -> Column:
        return F.when(F.col("qtype") == kind, value)

    return pairs.groupBy(*keys).agg(
        F.count_if(F.col("qtype") == "choice").alias("choice_n"),
        F.avg(when("choice", same.cast("double"))).alias("choice_agreement"),
        F.avg(when("choice", tv)).alias("choice_tv_mean"), F.max(when("choice", tv)).alias("choice_tv_max"),
        F.count_if(F.col("qtype") == "score").alias("score_n"),
        F.avg(when("score", d_score)).alias("score_mean"), F.max(when("score", d_score)).alias("score_max"),
        F.count_if(F.col("qtype") == "noul").alias("noul_n"),
        F.avg(when("noul", d_noul)).alias("noul_mean"), F.max(when("noul", d_noul)).alias("noul_max"),
    )


def grid_share(df: DataFrame, keys: Sequence[str], raw: str, step: float, tolerance: float = 2e-3) -> DataFrame:
    """Share of rows whose finite logprobs differ by multiples of ``step``."""
    from plumbline.functions import vectors as V

    finite = F.filter(raw, lambda x: (x > V.NEG_INF) & ~F.isnan(x))

    def on_grid(v: Column) -> Column:
        return F.forall(
            v, lambda x: F.abs((x - F.get(v, F.lit(0))) / step - F.rint((x - F.get(v, F.lit(0))) / step)) * step < tolerance
        )

    return df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.avg(V.let(finite, on_grid).cast("double")).alias("grid_share")
    )


def drift(samples: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Largest spread (max - min) of any outcome's probability over repeated answers.

    ``samples``: keys, sample, outcome, p. An outcome missing from a sample counts as 0 there.
    """
    keys = list(keys)
    n = samples.groupBy(*keys).agg(F.count_distinct("sample").alias("n_samples"))
    per = samples.groupBy(*keys, "outcome").agg(
        F.max("p").alias("_max"), F.min("p").alias("_min"), F.count_distinct("sample").alias("_seen")
    )
    spread = F.col("_max") - F.when(F.col("_seen") < F.col("n_samples"), F.least(F.lit(0.0), F.col("_min"))).otherwise(F.col("_min"))
    return per.join(n, keys).groupBy(*keys).agg(
        F.max("n_samples").alias("n_samples"), F.round(F.max(spread), 12).alias("max_abs_delta")
    )


def repeat_stability(samples: DataFrame, reference: DataFrame, keys: Sequence[str]) -> DataFrame:
    """TV of repeated answers to their reference: mean, nearest-rank p95, max, share of zeros and
    below 0.01, argmax flips. ``samples``: keys, item_id, sample, probs; ``reference``: keys,
    item_id, probs."""
    from plumbline.functions import vectors as V
    from plumbline.operators.ranking import exact_quantiles

    keys = list(keys)
    base = reference.select(*keys, "item_id", F.col("probs").alias("_ref"))
    rows = samples.join(base, [*keys, "item_id"]).select(
        *keys, V.total_variation(F.col("_ref"), F.col("probs")).alias("tv"),
        (V.argmax(F.col("_ref")) != V.argmax(F.col("probs"))).alias("flip"),
    )
    stats = rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("samples"), F.avg("tv").alias("tv_mean"), F.max("tv").alias("tv_max"),
        F.avg((F.col("tv") == 0).cast("double")).alias("share_zero"),
        F.avg((F.col("tv") < 0.01).cast("double")).alias("share_below_001"),
        F.count_if("flip").alias("argmax_flips"),
    )
    return stats.join(exact_quantiles(rows, keys, "tv", {"tv_p95": 0.95}, "nearest"), keys)
