"""Aggregates of per-item scores: accuracy, calibration error, reliability, summaries, macros."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.operators.ranking import equal_mass_bins, equal_mass_sums, exact_quantiles, with_prefix_sums
from plumbline.functions.hashing import tie_key
from plumbline.session import cached, checkpoint

# Known benchmarks in display order, and those left out of summaries unless named: fixed values.
BENCHMARK_ORDER = (
    "gpqa_diamond_idk", "lexam_en_idk", "mmlu_pro", "arc_challenge", "ag_news", "banking77",
    "clinc150", "boolq", "sst5",
)
EXCLUDED_BENCHMARKS = ("yelp_stars",)
DEFAULT_BINS = 10
SUMMARY_COLUMNS = (
    "item_id", "correct", "abstained", "p_gold", "nll", "brier", "abs_error", "within_one", "confidence", "idk_idx",
)
"""What summaries read of scored answers."""
MANY = 1 << 21
"""More scored answers than that are not sorted by confidence."""


def as_double(c: str | Column) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("double")


def drop_excluded(df: DataFrame, named: Sequence[str] | None = None) -> DataFrame:
    """Only the named benchmarks, or every one that is not excluded by default."""
    if named is not None:
        return df.where(F.col("benchmark").isin(list(named)))
    return df.where(~F.col("benchmark").isin(list(EXCLUDED_BENCHMARKS)))


def display_order(benchmark: Column) -> list[Column]:
    """Sort keys: known benchmarks in their order, then the others by name."""
    known = F.array(*[F.lit(b) for b in BENCHMARK_ORDER])
    place = F.array_position(known, benchmark)
    return [F.when(place == 0, len(BENCHMARK_ORDER) + 1).otherwise(place), benchmark]


# --- calibration error -------------------------------------------------------------------------


def reliability(
    df: DataFrame, groups: Sequence[str], bins: int = DEFAULT_BINS, conf: str = "confidence",
    correct: str = "correct", item: str = "item_id",
) -> DataFrame:
    """Equal-mass reliability bins per group: n, low, high, mean confidence, accuracy."""
    narrow = df.select(*groups, item, F.col(conf).alias("_conf"), as_double(correct).alias("_hit"))
    binned = equal_mass_bins(narrow, groups, "_conf", item, bins)
    return binned.groupBy(*groups, "bin").agg(
        F.count(F.lit(1)).alias("n"),
        F.min("_conf").alias("confidence_low"),
        F.max("_conf").alias("confidence_high"),
        F.avg("_conf").alias("mean_confidence"),
        F.avg("_hit").alias("accuracy"),
    )


def reliability_of_many(
    df: DataFrame, groups: Sequence[str], bins: int = DEFAULT_BINS, conf: str = "confidence",
    correct: str = "correct", item: str = "item_id",
) -> DataFrame:
    """:func:`reliability` of rows that are cheap to read again and too many to sort."""
    sums = equal_mass_sums(df, groups, conf, item, as_double(correct), bins)
    return sums.select(
        *groups, "bin", "n", F.col("low").alias("confidence_low"), F.col("high").alias("confidence_high"),
        F.try_divide("sum_value", "n_value").alias("mean_confidence"), F.try_divide("sum_hit", "n_hit").alias("accuracy"),
    )


def gap_over_bins(bins: DataFrame, groups: Sequence[str], name: str = "ece") -> DataFrame:
    """``sum_b n_b / n * |accuracy_b - confidence_b|`` of reliability bins."""
    gap = F.col("n") * F.abs(F.col("accuracy") - F.col("mean_confidence"))
    return bins.groupBy(*groups).agg((F.sum(gap) / F.sum("n")).alias(name))


def ece_equal_mass(
    df: DataFrame, groups: Sequence[str], bins: int = DEFAULT_BINS, conf: str = "confidence",
    correct: str = "correct", item: str = "item_id",
) -> DataFrame:
    return gap_over_bins(reliability(df, groups, bins, conf, correct, item), groups)


def width_bin(conf: Column, bins: int) -> Column:
    """Equal-width bin of a confidence; 1.0 falls in the last bin."""
    clipped = F.greatest(F.lit(0.0), F.least(F.lit(1.0), conf))
    return F.least(F.floor(clipped * bins), F.lit(bins - 1)).cast("int")


def reliability_equal_width(
    df: DataFrame, groups: Sequence[str], bins: int = DEFAULT_BINS, conf: str = "confidence",
    correct: str = "correct", min_items: int = 1,
) -> DataFrame:
    """Equal-width reliability bins holding at least ``min_items`` rows."""
    return (
        df.groupBy(*groups, width_bin(F.col(conf), bins).alias("bin"))
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.avg(conf).alias("mean_confidence"),
            F.avg(as_double(correct)).alias("accuracy"),
        )
        .where(F.col("n") >= min_items)
        .withColumns({"low": F.col("bin") / bins, "high": (F.col("bin") + 1) / bins})
    )


def ece_equal_width(
    df: DataFrame, groups: Sequence[str], bins: int = DEFAULT_BINS, conf: str = "confidence",
    correct: str = "correct",
) -> DataFrame:
    return gap_over_bins(reliability_equal_width(df, groups, bins, conf, correct), groups)


def weighted_ece(
    df: DataFrame, groups: Sequence[str], weight: str, bins: int = DEFAULT_BINS,
    conf: str = "confidence", correct: str = "correct", item: str = "item_id",
) -> DataFrame:
    """Equal-mass calibration error of the sample holding each item ``weight`` times.

    Bins cut the expanded sample; an item whose copies straddle an edge counts on both sides in
    proportion, so no row is ever expanded.
    """
    rows = df.where(F.col(weight) > 0).select(
        *groups, tie_key(F.col(item)).alias("_tie"),
        F.col(conf).alias("_conf"), as_double(correct).alias("_hit"),
        F.col(weight).cast("bigint").alias("_w"),
    )
    placed = with_prefix_sums(rows, groups, ["_conf", "_tie"], ["_w"])
    base, extra = F.floor(F.col("total__w") / bins), F.col("total__w") % bins
    edges = F.transform(
        F.sequence(F.lit(0), F.lit(bins - 1)),
        lambda b: F.struct(
            b.alias("bin"),
            (base * b + F.least(b.cast("bigint"), extra)).alias("low"),
            (base * (b + 1) + F.least((b + 1).cast("bigint"), extra)).alias("high"),
        ),
    )
    start, end = F.col("cum__w") - F.col("_w"), F.col("cum__w")
    parts = placed.withColumn("_edge", F.explode(F.filter(edges, lambda e: (e["low"] < end) & (e["high"] > start))))
    overlap = F.least(end, F.col("_edge.high")) - F.greatest(start, F.col("_edge.low"))
    per_bin = parts.withColumn("_o", overlap.cast("double")).groupBy(*groups, "_edge.bin").agg(
        F.sum(F.col("_o") * F.col("_hit")).alias("_h"),
        F.sum(F.col("_o") * F.col("_conf")).alias("_c"),
        F.sum("_o").alias("_n"),
    )
    return per_bin.groupBy(*groups).agg((F.sum(F.abs(F.col("_h") - F.col("_c"))) / F.sum("_n")).alias("ece"))


# --- summaries -----------------------------------------------------------------------------------


def score_summary(df: DataFrame, groups: Sequence[str]) -> DataFrame:
    """n, accuracy, IDK rate, mean p(gold), NLL, Brier, MAE and within-one per group; the last
    three of a type that does not apply are NULL."""
    return df.groupBy(*groups).agg(
        F.count(F.lit(1)).alias("n"),
        F.avg(as_double("correct")).alias("accuracy"),
        F.when(F.max("idk_idx").isNotNull(), F.avg(as_double("abstained"))).alias("idk_rate"),
        F.avg("p_gold").alias("mean_p_gold"),
        F.avg("nll").alias("nll"),
        F.avg("brier").alias("brier"),
        F.avg("abs_error").alias("mae"),
        F.avg(as_double("within_one")).alias("within_one"),
    )


def benchmark_summary(df: DataFrame, groups: Sequence[str] = ("system", "benchmark"), bins: int = DEFAULT_BINS) -> DataFrame:
    """:func:`score_summary` plus the equal-mass calibration error."""
    groups = list(groups)
    scores = cached(df.select(*groups, *SUMMARY_COLUMNS))
    summary = summary_of(scores, groups, bins)
    scores.unpersist()
    return summary


def summary_of(scores: DataFrame, groups: Sequence[str], bins: int = DEFAULT_BINS) -> DataFrame:
    """:func:`benchmark_summary` of scores that are cached, or cheap to read more than once."""
    binned = reliability_of_many if scores.count() > MANY else reliability
    return checkpoint(score_summary(scores, groups).join(gap_over_bins(binned(scores, groups, bins), groups), list(groups)))


def macro_average(
    per_benchmark: DataFrame, groups: Sequence[str], metrics: Sequence[str]
) -> DataFrame:
    """Mean of per-benchmark metrics, each benchmark weighing the same."""
    return per_benchmark.groupBy(*groups).agg(
        F.count(F.lit(1)).alias("n_benchmarks"), *[F.avg(m).alias(m) for m in metrics]
    )


def with_macro_row(
    per_benchmark: DataFrame, groups: Sequence[str], metrics: Sequence[str], label: str = "macro"
) -> DataFrame:
    """Per-benchmark rows plus one macro row per group."""
    macro = macro_average(per_benchmark, groups, metrics).withColumn("benchmark", F.lit(label))
    columns = [*groups, "benchmark", *metrics]
    return per_benchmark.select(*columns).unionByName(macro.select(*columns))


def latency_percentiles(df: DataFrame, groups: Sequence[str], latency: str = "latency_ms") -> DataFrame:
    return exact_quantiles(df, groups, latency, {"latency_p50_ms": 0.5, "latency_p95_ms": 0.95})


def absolute_metrics(df: DataFrame, groups: Sequence[str]) -> DataFrame:
    """Accuracy overall and over answered items, IDK rate, both calibration errors, mean
    confidence of choice answers."""
    groups = list(groups)
    base = df.groupBy(*groups).agg(
        F.count(F.lit(1)).alias("n"),
        F.avg(as_double("correct")).alias("accuracy"),
        F.avg(F.when(~F.col("abstained"), as_double("correct"))).alias("answered_accuracy"),
        F.avg(as_double("abstained")).alias("idk_rate"),
        F.avg("p_gold").alias("p_gold"),
        F.avg("nll").alias("nll"),
        F.avg("brier").alias("brier"),
        F.avg("confidence").alias("mean_confidence"),
    )
    mass = ece_equal_mass(df, groups).withColumnRenamed("ece", "ece_mass")
    width = ece_equal_width(df, groups).withColumnRenamed("ece", "ece_width")
    return base.join(mass, groups).join(width, groups)


def confidence_shares(
    df: DataFrame, groups: Sequence[str], bins: int = 10, conf: str = "confidence"
) -> DataFrame:
    """Share of rows per equal-width confidence bin, with the group's mean confidence."""
    counts = df.groupBy(*groups, width_bin(F.col(conf), bins).alias("bin")).agg(
        F.count(F.lit(1)).alias("n"), F.sum(conf).alias("_c")
    )
    totals = counts.groupBy(*groups).agg(
        F.sum("n").alias("_all"), (F.sum("_c") / F.sum("n")).alias("mean_confidence")
    )
    return counts.join(totals, list(groups)).select(
        *groups, "bin", "n", (F.col("n") / F.col("_all")).alias("share"), "mean_confidence"
    )


def rounding_floor_check(
    df: DataFrame, groups: Sequence[str], floor: float = 0.005, clip: float = 1e-6
) -> DataFrame:
    """How rounded probabilities inflate the log loss: items whose gold key got exactly nothing,
    and the macro NLL with every p(gold) floored."""
    cap = -F.ln(F.lit(floor))
    per = df.groupBy(*groups, "benchmark").agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(F.col("nll") >= -F.ln(F.lit(clip)) - 1e-12).alias("n_gold_zero"),
        F.avg(F.least(F.col("nll"), cap)).alias("nll_floored"),
        F.avg("nll").alias("nll"),
    )
    return per.groupBy(*groups).agg(
        F.sum("n").alias("n"),
        F.sum("n_gold_zero").alias("n_gold_zero"),
        F.avg("nll").alias("macro_nll"),
        F.avg("nll_floored").alias("macro_nll_floored"),
    )


def best_arms(
    estimates: DataFrame, groups: Sequence[str], metrics: dict[str, bool], arm: str = "arm",
    position: str = "arm_position",
) -> DataFrame:
    """Per group and metric the best arm (``True``: higher is better), the first on ties."""
    picks = []
    for metric, higher in metrics.items():
        value = F.col(metric) if not higher else -F.col(metric)
        picks.append(F.min_by(arm, F.struct(value, F.col(position))).alias(f"best_{metric}"))
    return estimates.groupBy(*groups).agg(*picks)


def parameter_summary(fits: DataFrame, groups: Sequence[str], value: str = "temperature") -> DataFrame:
    """Mean and range of a fitted parameter over folds, fallback fits left out."""
    return (
        fits.where(~F.col("fallback"))
        .groupBy(*groups)
        .agg(
            F.count(F.lit(1)).alias("n_folds"),
            F.avg(value).alias(f"mean_{value}"),
            F.min(value).alias(f"min_{value}"),
            F.max(value).alias(f"max_{value}"),
        )
    )


def as_returned(df: DataFrame, groups: Sequence[str]) -> DataFrame:
    """Metrics of unnormalised answers, and the calibration error of the reported confidence
    (judged by the returned choice, levels by their mode; NULL where none is reported)."""
    groups = list(groups)
    base = df.groupBy(*groups).agg(
        F.avg("nll").alias("nll"), F.avg("brier").alias("brier"),
        F.count("reported_confidence").alias("n_confidence"),
    )
    rated = df.where(F.col("reported_confidence").isNotNull()).withColumn(
        "_rated", F.coalesce(F.col("choice_idx") == F.col("gold_idx"), F.col("correct"))
    )
    own = ece_equal_mass(rated, groups, conf="reported_confidence", correct="_rated").withColumnRenamed(
        "ece", "ece_confidence"
    )
    return base.join(ece_equal_mass(df, groups), groups).join(own, groups, "left")
