"""Deterministic splits and samples: a row's place depends on its keys, never on load order."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions.hashing import hash_uniform, keyed_hash
from plumbline.operators.ranking import top_n_per_group, with_rank
from plumbline.session import broadcast_if_small, checkpoint

SCREEN_SIZE = 300


def question_id(metadata_id: Column, item_id: Column) -> Column:
    """The dataset's own question id, else the item id."""
    return F.coalesce(metadata_id, item_id)


def stratum(stratum_col: Column, subject: Column) -> Column:
    return F.coalesce(stratum_col, subject, F.lit(""))


def split_halves(items: DataFrame, seed: int | str = 0) -> DataFrame:
    """Items with ``half`` (select / holdout) and ``stratum_rank``.

    Each benchmark's items are ordered by stratum, hashed within it, and alternate between the
    halves; the alternation carries on between strata, so strata and benchmark halve exactly.
    """
    hashed = items.withColumn("_hash", keyed_hash(seed, F.col("benchmark"), F.col("question_id")))
    ranked = with_rank(hashed, ["benchmark"], ["stratum", "_hash", "question_id"], "_rank", "_size")
    return ranked.withColumn(
        "half", F.when(F.col("_rank") % 2 == 1, "select").otherwise("holdout")
    ).withColumnRenamed("_rank", "place").drop("_size", "_hash")


def screen_quotas(counts: DataFrame, size: int = SCREEN_SIZE, seed: int | str = 0) -> DataFrame:
    """(benchmark, stratum, n) -> quota: proportional shares of ``size`` by largest remainder,
    ties by hash; all of a benchmark that is not larger than ``size``."""
    totals = counts.groupBy("benchmark").agg(F.sum("n").alias("_total"))
    shares = counts.join(totals, "benchmark").withColumns(
        {
            "_floor": F.floor(F.col("n") * size / F.col("_total")),
            "_rest": -(F.col("n") * size % F.col("_total")),
            "_hash": keyed_hash(seed, F.col("benchmark"), F.col("stratum")),
        }
    )
    given = shares.groupBy("benchmark").agg(F.sum("_floor").alias("_given"))
    ranked = with_rank(shares.join(given, "benchmark"), ["benchmark"], ["_rest", "_hash", "stratum"], "_rank", "_strata")
    extra = (F.col("_rank") <= size - F.col("_given")).cast("int")
    return ranked.select(
        "benchmark", "stratum", "n",
        F.when(F.col("_total") <= size, F.col("n")).otherwise(F.col("_floor") + extra).alias("quota"),
    )


def screen_split(items: DataFrame, size: int = SCREEN_SIZE, seed: int | str = 0) -> DataFrame:
    """At most ``size`` items of each benchmark's select half, strata in proportion."""
    select = split_halves(items, seed).where("half = 'select'")
    hashed = select.withColumn("_hash", keyed_hash(seed, F.col("benchmark"), F.col("question_id")))
    ranked = with_rank(hashed, ["benchmark", "stratum"], ["_hash", "question_id"], "_place", "_n")
    counts = checkpoint(
        ranked.groupBy("benchmark", "stratum").agg(F.count(F.lit(1)).alias("n"))
    )
    quotas = checkpoint(screen_quotas(counts, size, seed).drop("n"))
    return (
        ranked.join(broadcast_if_small(quotas), ["benchmark", "stratum"])
        .where(F.col("_place") <= F.col("quota"))
        .drop("_hash", "_place", "_n", "quota")
    )


def capped_sample(rows: DataFrame, groups: Sequence[str], row_id: str, n: int, seed: int | str = 0) -> DataFrame:
    """The ``n`` rows of each group with the smallest seeded hash."""
    hashed = rows.withColumn("_hash", keyed_hash(seed, F.col(row_id)))
    return top_n_per_group(hashed, groups, ["_hash", row_id], n, rank="_rank").drop("_hash", "_rank")


def fraction_by_hash(rows: DataFrame, alpha: float, *keys: Column | str, seed: int | str = 0) -> DataFrame:
    """Rows whose keyed hash falls below ``alpha``: a row decides alone, in any order."""
    return rows.where(hash_uniform(keyed_hash(seed, *keys)) < alpha)


def fraction_exact(rows: DataFrame, fraction: float, row_id: str, seed: int | str = 0) -> DataFrame:
    """Exactly ``ceil(fraction * n)`` rows, those with the smallest hash."""
    hashed = rows.withColumn("_hash", keyed_hash(seed, F.col(row_id)))
    ranked = with_rank(hashed, [], ["_hash", row_id], "_rank", "_size")
    return ranked.where(F.col("_rank") <= F.ceil(F.lit(fraction) * F.col("_size"))).drop("_hash", "_rank", "_size")


def first_n(rows: DataFrame, order: Sequence[str], n: int) -> DataFrame:
    """The first ``n`` rows in dataset order."""
    return rows.orderBy(*order).limit(n)


def round_robin(rows: DataFrame, group: str, order: Sequence[str], n: int) -> DataFrame:
    """``n`` rows taken one group after the other: every group's first row before any second."""
    picked = top_n_per_group(rows, [group], list(order), n, rank="turn")
    return picked.orderBy("turn", group).limit(n)
