"""Whole analyses over recorded answers: run summaries, pairwise comparisons, usage statistics and
the cross-fitted calibration study. Each composes the operators; nothing row-level reaches the driver.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.functions import vectors as V
from plumbline.functions.scores import with_item_metrics, with_scores
from plumbline.operators import alignment as A
from plumbline.operators import bootstrap as B
from plumbline.operators import calibration as C
from plumbline.operators import costs as K
from plumbline.operators import crossfit as X
from plumbline.operators import debias as P
from plumbline.operators import records as R
from plumbline.operators import summaries as S
from plumbline.session import cached, checkpoint
from plumbline.sources.writers import interval_text, markdown_table, write_study

METRICS = ("accuracy", "nll", "brier")
CLUSTER = ("benchmark", "question_id")
MACRO = "macro"


def summarize(
    answers: DataFrame, latest: DataFrame | None = None, n_resamples: int = B.DEFAULT_RESAMPLES, seed: int = 0
) -> DataFrame:
    """Per system and benchmark, and a macro row: scores with accuracy intervals, and (with
    ``latest`` records: system, benchmark, ok, cached, cost_usd, latency_ms) errors, cache hits,
    spend and latency percentiles."""
    keys = ["system", "benchmark"]
    scored = cached(with_scores(answers).select(*keys, *S.SUMMARY_COLUMNS))
    items = ["benchmark", "item_id"]
    values = scored.select(*keys, "item_id", F.col("correct").cast("double").alias("accuracy"), "nll", "brier")
    # Benchmarks and macro averages share their resamples, and what is drawn of them.
    strata, means = B.strata_and_means(values, keys, items, METRICS, n_resamples, seed)
    intervals = B.bounds(strata, means, keys, ["accuracy"]).select(
        *keys, F.col("low_accuracy").alias("accuracy_low"), F.col("high_accuracy").alias("accuracy_high")
    )
    out = S.summary_of(scored, keys).join(intervals, keys)
    if latest is not None:
        counts = R.run_counts(latest, keys).select(*keys, "n_items", "n_errors", "n_cached", "spent_usd")
        out = out.join(counts, keys, "left").join(S.latency_percentiles(latest.where("ok"), keys), keys, "left")
    macro = B.macro_ends(strata, means, ["system"], METRICS)
    totals = [c for c in ("n", "n_items", "n_errors", "n_cached", "spent_usd") if c in out.columns]
    summed = out.groupBy("system").agg(*[F.sum(c).alias(c) for c in totals])
    macro_row = macro.join(summed, "system").select(
        "system", F.lit(MACRO).alias("benchmark"), *totals, "accuracy", "nll", "brier",
        F.col("low_accuracy").alias("accuracy_low"), F.col("high_accuracy").alias("accuracy_high"),
    )
    table = checkpoint(out.unionByName(macro_row, allowMissingColumns=True))
    scored.unpersist()
    return table


def summary_markdown(summary: DataFrame) -> str:
    columns = [
        ("system", "System", ""), ("benchmark", "Benchmark", ""), ("n", "n", ""), ("accuracy", "Accuracy", ".4f"),
        ("accuracy_low", "low", ".4f"), ("accuracy_high", "high", ".4f"), ("idk_rate", "IDK rate", ".3f"),
        ("nll", "NLL", ".3f"), ("brier", "Brier", ".3f"), ("ece", "ECE", ".3f"), ("mae", "MAE", ".3f"), ("within_one", "Within-1", ".3f"),
    ]
    order = ["system", (F.col("benchmark") == MACRO).cast("int"), *S.display_order(F.col("benchmark"))]
    return markdown_table(summary, [c for c in columns if c[0] in summary.columns], order)


def compare(
    answers: DataFrame, a: str, b: str, n_resamples: int = B.DEFAULT_RESAMPLES, seed: int = 0,
    benchmarks: Sequence[str] | None = None,
) -> DataFrame:
    """``a - b`` on the items both answered (of ``benchmarks`` if given): accuracy, NLL and Brier
    differences with intervals and the exact McNemar test per benchmark, and their macro averages."""
    if benchmarks is not None:
        answers = answers.where(F.col("benchmark").isin(list(benchmarks)))
    conflicts = A.shared_items(answers.where(F.col("system").isin(a, b)), 2).where("disagrees")
    if conflicts.limit(1).count():
        raise ValueError("the runs disagree on keys or gold of shared items")
    pairs = A.pair_systems(with_scores(answers), a, b, ["correct", "nll", "brier"])
    d = cached(
        pairs.select(
            "benchmark", "item_id", F.col("correct_a").cast("double").alias("accuracy_a"),
            F.col("correct_b").cast("double").alias("accuracy_b"), "correct_a", "correct_b",
            (F.col("correct_a").cast("double") - F.col("correct_b").cast("double")).alias("d_accuracy"),
            (F.col("nll_a") - F.col("nll_b")).alias("d_nll"), (F.col("brier_a") - F.col("brier_b")).alias("d_brier"),
        )
    )
    values, items = ["d_accuracy", "d_nll", "d_brier"], ["benchmark", "item_id"]
    sums = checkpoint(B.cluster_sums(d, ["benchmark"], items, values))
    means = checkpoint(B.replicate_means(B.resampled_sums(sums, ["benchmark"], items, values, n_resamples, seed), values))
    moments = checkpoint(B.stratum_moments(sums, ["benchmark"], values))
    points = d.groupBy("benchmark").agg(
        F.count(F.lit(1)).alias("n"), *[F.avg(v).alias(v) for v in ("accuracy_a", "accuracy_b", *values)]
    )
    per = (
        points.join(B.bounds(moments, means, ["benchmark"], values).drop("n_clusters"), "benchmark")
        .join(B.mcnemar(d, ["benchmark"], "correct_a", "correct_b"), "benchmark")
    )
    whole = lambda df: df.withColumn("_all", F.lit(1))
    macro_bounds = B.bounds(
        B.macro_moments(whole(moments), ["_all"], values), B.macro_replicates(whole(means), ["_all"], values), ["_all"], values
    ).drop("n_clusters")
    macro = (
        points.agg(F.lit(1).alias("_all"), F.sum("n").alias("n"), *[F.avg(v).alias(v) for v in ("accuracy_a", "accuracy_b", *values)])
        .join(macro_bounds, "_all").drop("_all").withColumn("benchmark", F.lit(MACRO))
    )
    out = checkpoint(per.unionByName(macro, allowMissingColumns=True))
    d.unpersist()
    return out.withColumns({f"{v}_excludes_zero": B.excludes_zero(F.col(f"low_{v}"), F.col(f"high_{v}")) for v in values})


def run_statistics(
    records: DataFrame, prices: DataFrame, invocations: DataFrame, usd_per_hour: float | None = None
) -> DataFrame:
    """Token, latency, throughput and cost statistics per benchmark and pooled (benchmark NULL).

    ``records``: latest records with usage, ``price_id`` and ``correct``; ``invocations`` carry
    system_id and benchmark. The pooled accuracy is the macro average.
    """
    keys = ["system_id", "benchmark"]
    costed = cached(K.item_costs(records, prices))
    stats = K.with_ratios(K.usage_stats(costed, keys))
    accuracy = costed.where("ok").groupBy(*keys).agg(F.avg(S.as_double("correct")).alias("accuracy"))
    pooled = accuracy.groupBy("system_id").agg(F.avg("accuracy").alias("accuracy")).withColumn("benchmark", F.lit(None).cast("string"))
    accuracies = accuracy.unionByName(pooled)
    timings = K.throughput(invocations, keys).unionByName(
        K.throughput(invocations, ["system_id"]).withColumn("benchmark", F.lit(None).cast("string"))
    )
    machine = K.machine_seconds(invocations, keys).unionByName(
        K.machine_seconds(invocations, ["system_id"]).withColumn("benchmark", F.lit(None).cast("string"))
    ).withColumns({"machine_usd": K.machine_cost(F.col("gpu_seconds"), K.machine_rate(usd_per_hour)), "gpu_hours": F.col("gpu_seconds") / 3600.0})
    latency = S.latency_percentiles(costed.where("ok"), keys).unionByName(
        S.latency_percentiles(costed.where("ok"), ["system_id"]).withColumn("benchmark", F.lit(None).cast("string"))
    )
    for other in (accuracies, timings, machine, latency):
        named = other.withColumnRenamed("system_id", "_s").withColumnRenamed("benchmark", "_b")
        same = (F.col("system_id") == F.col("_s")) & F.col("benchmark").eqNullSafe(F.col("_b"))
        stats = stats.join(named, same, "left").drop("_s", "_b")
    table = checkpoint(stats)
    costed.unpersist()
    return table


def comparison_markdown(comparison: DataFrame) -> str:
    """:func:`compare` as a table: one row per benchmark, the macro average last."""
    rows = comparison.select(
        "benchmark", "n", "accuracy_a", "accuracy_b",
        *[interval_text(F.col(f"d_{m}"), F.col(f"low_d_{m}"), F.col(f"high_d_{m}"), signed=True).alias(m) for m in METRICS],
        F.when(F.col("only_a").isNotNull(), F.concat_ws("/", F.col("only_a").cast("string"), F.col("only_b").cast("string"))).alias("discordant"), "p_value",
    )
    columns = [
        ("benchmark", "Benchmark", ""), ("n", "Items", ",d"), ("accuracy_a", "Acc. A", ".4f"), ("accuracy_b", "Acc. B", ".4f"), ("accuracy", "Δ accuracy", ""),
        ("nll", "Δ NLL", ""), ("brier", "Δ Brier", ""), ("discordant", "only A/B", ""), ("p_value", "McNemar p", ".4f"),
    ]
    return markdown_table(rows, columns, [(F.col("benchmark") == MACRO).cast("int"), *S.display_order(F.col("benchmark"))])


def statistics_markdown(statistics: DataFrame) -> str:
    """:func:`run_statistics` as a table: one row per system and benchmark, the pooled row (all
    benchmarks) last."""
    rows = statistics.withColumn("_pooled", F.col("benchmark").isNull()).withColumn("benchmark", F.coalesce("benchmark", F.lit("all, macro acc.")))
    if "in_flight" in rows.columns:
        rows = rows.withColumn("in_flight", F.array_join(F.transform("in_flight", lambda c: c.cast("string")), "/"))
    columns = [
        ("system_id", "System", ""), ("benchmark", "Benchmark", ""), ("n_items", "Items", ",d"), ("accuracy", "Acc.", ".4f"), ("mean_input_tokens", "In tok/item", ",.1f"),
        ("mean_output_tokens", "Out tok/item", ",.1f"), ("input_tokens", "In tok total", ",d"), ("output_tokens", "Out tok total", ",d"), ("mean_cached_tokens", "Cached tok/item", ",.1f"),
        ("calls_per_item", "Calls/item", ".2f"), ("latency_p50_ms", "p50 ms", ",.0f"), ("latency_p95_ms", "p95 ms", ",.0f"), ("items_per_second", "q/s", ".2f"), ("in_flight", "In flight", ""),
        ("gpu_hours", "GPU-h", ".2f"), ("cost_usd", "Cost $", ".2f"), ("cost_per_1k_items", "$ / 1k items", ".3f"), ("cost_per_correct", "$ / correct", ".5f"),
    ]
    return markdown_table(rows, [c for c in columns if c[0] in rows.columns], ["system_id", "_pooled", *S.display_order(F.col("benchmark"))])


@dataclass
class Study:
    """Tables of a calibration study."""

    predictions: DataFrame
    """system, arm, benchmark, item_id, question_id, gold_idx, probs; cached until unpersisted"""
    estimates: DataFrame
    """system, arm, benchmark (macro included): accuracy, nll, brier, ece, intervals"""
    deltas: DataFrame
    """system, arm, benchmark, against: differences with intervals"""
    reliability: DataFrame
    fits: DataFrame

    def write(self, path: str) -> None:
        write_study(self.predictions, self.estimates, self.fits, path)
        self.deltas.write.mode("overwrite").json(f"{path}/deltas")
        self.reliability.write.mode("overwrite").json(f"{path}/reliability")


def calibration_study(
    items: DataFrame,
    arms: Sequence[str] = X.DEFAULT_ARMS,
    debias: Sequence[str] = (),
    shown: DataFrame | None = None,
    reference: str | None = None,
    n_folds: int = C.DEFAULT_FOLDS,
    min_group: int = C.MIN_GROUP,
    n_resamples: int = B.DEFAULT_RESAMPLES,
    bins: int = S.DEFAULT_BINS,
    seed: int = 0,
) -> Study:
    """Systems x calibrator arms x benchmarks on shared items.

    ``items``: system, benchmark, item_id, question_id, stratum, signature, keys, probs, gold_idx
    (and prior_key, free for debiased systems, named ``<system>+<method>``; ``shown`` holds the
    permuted presentations of pride). Items not answered by every system are left out; folds keep a
    question together; every series shares its resamples. Systems that disagree on an item's keys or
    gold are an error. Debiased systems are also compared with the same system undebiased.
    """
    n_systems = items.select("system").distinct().count()
    aligned = A.align(items, n_systems, disagreeing="raise").withColumn("probs", V.normalize("probs"))
    folds = C.assign_folds(aligned, n_folds, seed)
    base = cached(aligned.join(folds, [*CLUSTER, "stratum"]))
    systems = base
    for method in debias:
        raw = base.withColumnRenamed("probs", "raw")
        changed = P.debias_offline(raw, method, shown, n_folds).withColumnRenamed("debiased", "probs")
        renamed = changed.withColumn("system", F.concat_ws("+", "system", F.lit(method)))
        systems = systems.unionByName(renamed.select(*systems.columns))
    calibrated, fits = X.crossfit(systems, arms, n_folds=n_folds, min_group=min_group)
    carried = ["system", "arm", "benchmark", "item_id", "question_id", "gold_idx", "probs"]
    predictions = cached(
        systems.withColumn("arm", F.lit(X.RAW)).select(*carried).unionByName(calibrated.select(*carried))
    )
    series = ["system", "arm", "benchmark"]
    scored = cached(
        with_item_metrics(predictions).select(
            *series, "item_id", "question_id", "confidence", "correct",
            F.col("correct").cast("double").alias("accuracy"), "nll", "brier",
        )
    )
    reliability = checkpoint(S.reliability(scored, series, bins))
    points = scored.groupBy(*series).agg(F.count(F.lit(1)).alias("n"), *[F.avg(m).alias(m) for m in METRICS]).join(
        S.gap_over_bins(reliability, series), series
    )
    macro_points = points.groupBy("system", "arm").agg(
        F.sum("n").alias("n"), *[F.avg(m).alias(m) for m in (*METRICS, "ece")]
    ).withColumn("benchmark", F.lit(MACRO))
    all_points = checkpoint(points.unionByName(macro_points))
    sums = checkpoint(B.cluster_sums(scored, series, CLUSTER, METRICS))
    means = B.replicate_means(B.resampled_sums(sums, series, CLUSTER, METRICS, n_resamples, seed), METRICS)
    errors = B.ece_replicates(scored, series, CLUSTER, n_resamples, bins, seed).withColumnRenamed("ece", "m_ece")
    means = checkpoint(means.join(errors, [*series, "r"], "left"))
    every = (*METRICS, "ece")
    macro_means = B.macro_replicates(means, ["system", "arm"], every).withColumn("benchmark", F.lit(MACRO))
    kept = ["system", "arm", "benchmark", "r", *[f"m_{m}" for m in every]]
    replicates = checkpoint(means.select(*kept).unionByName(macro_means.select(*kept)))
    estimates = all_points.join(_ends(replicates, sums, ["system", "arm"]), series)
    deltas = _deltas(replicates, sums, all_points, X.RAW, "arm", ["system"], "raw")
    if reference is not None:
        deltas = deltas.unionByName(_deltas(replicates, sums, all_points, reference, "system", ["arm"], "reference"))
    for method in debias:
        plain = F.regexp_replace("system", f"\\+{method}$", "")
        sided = lambda df, p=plain: df.withColumn("variant", F.when(F.col("system") == p, "plain").otherwise("debiased")).withColumn("system", p)
        undebiased = _deltas(sided(replicates), sided(sums), sided(all_points), "plain", "variant", ["system", "arm"], "undebiased")
        deltas = deltas.unionByName(undebiased.withColumn("system", F.concat_ws("+", "system", F.lit(method))).select(*deltas.columns))
    scored.unpersist()
    base.unpersist()
    return Study(predictions, estimates, deltas, reliability, fits)


def _ends(replicates: DataFrame, sums: DataFrame, groups: Sequence[str], paired: tuple[str, str] | None = None) -> DataFrame:
    """Intervals per (groups, benchmark), macro included: BCa for means, with leave-one-cluster-out
    means of each benchmark (``paired``: of differences to the base series), percentiles for the
    calibration error, which is no mean."""
    each = [*groups, "benchmark"]
    if paired is not None:
        varied, base = paired
        sums = B.paired_sums(sums, [g for g in each if g != varied], varied, base, CLUSTER, METRICS)
    strata = B.stratum_moments(sums, each, METRICS)
    macro = B.macro_moments(strata, groups, METRICS).withColumn("benchmark", F.lit(MACRO))
    moments = strata.unionByName(macro)
    return B.bounds(moments, replicates, each, METRICS).join(B.percentile_intervals(replicates, each, ["ece"]), each)


def _deltas(
    replicates: DataFrame, sums: DataFrame, points: DataFrame, base: str, varied: str, fixed: Sequence[str], against: str
) -> DataFrame:
    """Series minus the ``base`` value of ``varied`` with intervals on shared resamples."""
    metrics = (*METRICS, "ece")
    groups = [*fixed, varied]
    keys = [*fixed, "benchmark", varied]
    drawn = B.replicate_deltas(replicates, [*fixed, "benchmark"], varied, base, metrics)
    ends = _ends(drawn, sums, groups, (varied, base))
    ref = points.where(F.col(varied) == base).select(*fixed, "benchmark", *[F.col(m).alias(f"_{m}") for m in metrics])
    own = points.where(F.col(varied) != base).join(ref, [*fixed, "benchmark"]).select(
        *keys, *[(F.col(m) - F.col(f"_{m}")).alias(f"d_{m}") for m in metrics]
    )
    flags = {f"{m}_excludes_zero": B.excludes_zero(F.col(f"low_{m}"), F.col(f"high_{m}")) for m in metrics}
    return own.join(ends, keys).withColumns(flags).withColumn("against", F.lit(against))


def view_summary(study: Study, benchmarks: Sequence[str], stats: DataFrame | None = None) -> DataFrame:
    """Macro quality of every (system, arm) over a subset of benchmarks; with per-benchmark run
    statistics also the pooled speed and unit cost."""
    chosen = study.estimates.where(F.col("benchmark").isin(list(benchmarks)))
    quality = chosen.groupBy("system", "arm").agg(
        F.sum("n").alias("n"), *[F.avg(m).alias(m) for m in (*METRICS, "ece")]
    )
    if stats is None:
        return quality
    pooled = stats.where(F.col("benchmark").isin(list(benchmarks))).groupBy(F.col("system_id").alias("system")).agg(
        F.try_divide(F.sum("throughput_items"), F.sum("wall_seconds")).alias("qps"),
        (F.try_divide(F.sum("cost_usd"), F.sum("n_items")) * 1000.0).alias("cost_per_1k_items"),
        F.try_divide(F.sum("input_tokens"), F.sum("n_usage")).alias("tokens_in"),
    )
    return quality.join(pooled, "system", "left")
