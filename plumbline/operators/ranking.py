"""Exact ranks, prefix sums, bins and quantiles of groups of any size.

A window without a selective partition key sorts its whole group in one task. Here rows are
range-partitioned on (group, order) instead, so one huge group spreads over all partitions; each
partition's row counts (at most one per partition and group) give the offset that turns a local
position into a global rank.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.functions.hashing import tie_key
from plumbline.session import broadcast_if_small, cached, checkpoint, lookup


def sorted_once(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``df`` range-partitioned and sorted on ``keys``, with its partition number and position
    fixed by a checkpoint."""
    return checkpoint(
        df.repartitionByRange(*[F.col(k) for k in keys])
        .sortWithinPartitions(*keys)
        .withColumn("_part", F.spark_partition_id())
        .withColumn("_pos", F.monotonically_increasing_id())
    )


def _offsets(runs: DataFrame, groups: Sequence[str], counts: dict[str, str]) -> DataFrame:
    """Per (group, partition): totals of earlier partitions (``_before_*``) and of the group."""
    ordered = Window.partitionBy(*groups).orderBy("_part")
    earlier = ordered.rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*groups)
    extra: dict[str, Column] = {}
    for source, name in counts.items():
        extra[f"_before_{name}"] = F.coalesce(F.sum(source).over(earlier), F.lit(0))
        extra[f"_all_{name}"] = F.sum(source).over(whole)
    return runs.withColumns(extra)


def with_rank(
    df: DataFrame,
    groups: Sequence[str],
    order: Sequence[str],
    rank: str = "rank",
    size: str = "group_size",
) -> DataFrame:
    """``df`` with the 1-based rank of each row in its group and the group's size. ``order``
    must end in a unique key; group columns must not be NULL."""
    groups = list(groups)
    if not groups:
        return with_rank(df.withColumn("_all", F.lit(1)), ["_all"], order, rank, size).drop("_all")
    placed = sorted_once(df, [*groups, *order])
    runs = placed.groupBy(*groups, "_part").agg(
        F.count(F.lit(1)).alias("_n"), F.min("_pos").alias("_first")
    )
    offsets = _offsets(runs, groups, {"_n": "n"}).select(
        *groups, "_part", "_first", "_before_n", F.col("_all_n").alias(size)
    )
    return (
        placed.join(lookup(offsets), [*groups, "_part"])
        .withColumn(rank, F.col("_before_n") + F.col("_pos") - F.col("_first") + 1)
        .drop("_part", "_pos", "_first", "_before_n")
    )


def with_prefix_sums(
    df: DataFrame, groups: Sequence[str], order: Sequence[str], values: Sequence[str]
) -> DataFrame:
    """``df`` with, for each value column v, ``cum_v`` (inclusive running sum in order) and
    ``total_v`` (group sum)."""
    groups = list(groups)
    placed = sorted_once(df, [*groups, *order])
    runs = placed.groupBy(*groups, "_part").agg(*[F.sum(v).alias(f"_s_{v}") for v in values])
    offsets = _offsets(runs, groups, {f"_s_{v}": v for v in values}).drop(
        *[f"_s_{v}" for v in values]
    )
    local = Window.partitionBy("_part", *groups).orderBy("_pos").rowsBetween(
        Window.unboundedPreceding, Window.currentRow
    )
    out = placed.withColumns({f"_c_{v}": F.sum(v).over(local) for v in values}).join(
        lookup(offsets), [*groups, "_part"]
    )
    for v in values:
        out = out.withColumn(f"cum_{v}", F.col(f"_c_{v}") + F.col(f"_before_{v}")).withColumnRenamed(
            f"_all_{v}", f"total_{v}"
        )
    return out.drop("_part", "_pos", *[f"_c_{v}" for v in values], *[f"_before_{v}" for v in values])


def split_bin(rank: Column, size: Column, bins: int) -> Column:
    """0-based bin of a 1-based rank when ``size`` rows are cut into ``bins`` contiguous bins
    whose sizes differ by at most one (larger bins first)."""
    base, extra = F.floor(size / bins), size % bins
    zero = rank - 1
    head = extra * (base + 1)
    return (
        F.when(zero < head, F.floor(zero / (base + 1)))
        .otherwise(extra + F.floor((zero - head) / F.greatest(base, F.lit(1))))
        .cast("int")
    )


def equal_mass_bins(
    df: DataFrame, groups: Sequence[str], value: str, item: str, bins: int, bin_name: str = "bin"
) -> DataFrame:
    """Rows (less ``item``) with their equal-mass bin by ``value``; ties follow the hash of
    ``item``."""
    ranked = with_rank(
        df.withColumn("_tie", tie_key(F.col(item))).drop(item), groups, [value, "_tie"], "_rank", "_size"
    )
    return ranked.withColumn(bin_name, split_bin(F.col("_rank"), F.col("_size"), bins)).drop(
        "_rank", "_size", "_tie"
    )


CELLS, TIE_DIGITS = 4096, 3
"""Cells that :func:`equal_mass_sums` cuts a group or cell into: by value, or by as many hex digits of an
item's hash where all values are equal."""
SORTED_ROWS = 1 << 18
"""Rows of cut cells that it sorts rather than cutting them once more."""
MOST_CUTS = 4


def equal_mass_sums(
    df: DataFrame, groups: Sequence[str], value: str, item: str, hit: Column, bins: int
) -> DataFrame:
    """(groups, bin): rows ``n``, ``low`` and ``high`` value, and number and sum of values (``n_value``,
    ``sum_value``) and of ``hit``: the rows of :func:`equal_mass_bins`, added up without sorting them all.

    Rows are counted in cells that follow one another in order. A cell that lies within a bin is added
    up as it is; one that an edge of a bin cuts (one for each edge) is cut into cells itself, by value
    or, where all its values are equal, by the hash of ``item``. Rows are sorted where few are left, or
    where cutting does not leave fewer."""
    groups = list(groups)
    v = F.col("_v")
    rows = df.select(*groups, F.col(item).cast("string").alias("_item"), F.col(value).cast("double").alias("_v"), hit.cast("double").alias("_hit"))
    told = {
        "n": F.count(F.lit(1)), "low": F.min(v), "high": F.max(v), "n_value": F.count(v), "sum_value": F.sum(v),
        "n_hit": F.count("_hit"), "sum_hit": F.sum("_hit"),
    }
    added = [c.alias(k) for k, c in told.items()]
    last = F.lit(CELLS - 1).cast("bigint")
    within = lambda share: F.least(last, F.greatest(F.lit(0).cast("bigint"), F.floor(share * CELLS)))
    cell = F.when(v.isNull(), F.lit(-1).cast("bigint")).when(F.isnan(v), last + 1).otherwise(within(v))
    keys, place, left, parts = groups, ["_size", "_start", "_digits"], None, []
    same = F.coalesce(F.col("_low") == F.col("_high"), F.lit(True))
    for cuts in range(MOST_CUTS + 1):
        celled = rows.withColumn("_cell", cell)
        found = celled.groupBy(*keys, "_cell").agg(*added)
        if cuts:
            used = F.col("_digits") + F.when(same, TIE_DIGITS).otherwise(0)
            found = found.join(F.broadcast(cut.withColumn("_digits", used).select("_id", *groups, *place)), "_id")
        else:
            found = found.withColumns({"_size": F.sum("n").over(Window.partitionBy(*groups)), "_start": F.lit(0).cast("bigint"), "_digits": F.lit(0)})
        # At most CELLS + 2 rows for each group or cut cell.
        earlier = Window.partitionBy(*keys).orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)
        found = found.withColumn("_start", F.col("_start") + F.coalesce(F.sum("n").over(earlier), F.lit(0)))
        ends = [split_bin(F.col("_start") + k, F.col("_size"), bins) for k in (F.lit(1), F.col("n"))]
        found = checkpoint(found.withColumns({"bin": ends[0], "_last": ends[1]}))
        parts.append(found.where("bin = _last").select(*groups, "bin", *told))
        # At most a cell for each edge of each group.
        cut = found.where("bin < _last").select(
            *(groups if not cuts else ["_id", *groups]), "_cell", "n", "_size", "_start", "_digits", F.col("low").alias("_low"), F.col("high").alias("_high"),
            F.row_number().over(Window.orderBy(*keys, "_cell")).alias("_next"),
        )
        cut = checkpoint(cut)
        n = cut.agg(F.sum("n")).first()[0]
        if n is None:
            break
        to = cut.select(*keys, "_cell", "_next", *place, "_low", "_high")
        own = celled if not cuts else celled.drop(*place, "_low", "_high")
        rows = own.join(broadcast_if_small(to), [*keys, "_cell"]).select(
            F.col("_next").alias("_id"), *groups, "_item", "_v", "_hit", *place, "_low", "_high"
        )
        if n <= SORTED_ROWS or n == left or cuts == MOST_CUTS:
            held = cached(rows.withColumn("_tie", tie_key(F.col("_item"))).drop("_item", "_low", "_high", "_digits"))
            ranked = with_rank(held, ["_id"], ["_v", "_tie"], "_rank", "_of")
            binned = ranked.withColumn("bin", split_bin(F.col("_start") + F.col("_rank"), F.col("_size"), bins))
            parts.append(checkpoint(binned.groupBy(*groups, "bin").agg(*added)))
            held.unpersist()
            break
        left, keys = n, ["_id"]
        cut = cut.drop("_id").withColumnRenamed("_next", "_id")
        digits = F.conv(F.substring(F.sha2("_item", 256), F.col("_digits") + 1, F.lit(TIE_DIGITS)), 16, 10).cast("bigint")
        share = F.coalesce(F.try_divide(v - F.col("_low"), F.col("_high") - F.col("_low")), F.lit(0.0))
        cell = F.when(same, F.coalesce(digits, F.lit(0).cast("bigint"))).otherwise(within(share))
    sums = {k: F.min(k) if k == "low" else F.max(k) if k == "high" else F.sum(k) for k in told}
    return reduce(DataFrame.unionByName, parts).groupBy(*groups, "bin").agg(*[c.alias(k) for k, c in sums.items()])


def exact_quantiles(
    df: DataFrame,
    groups: Sequence[str],
    value: str,
    probs: dict[str, float],
    method: str = "linear",
) -> DataFrame:
    """Per group one column per entry of ``probs`` (name -> level) with the exact quantile of
    ``value`` (NULLs left out): ``linear`` interpolates between the neighbouring order
    statistics, ``nearest`` takes the smallest value whose cumulative share reaches the level."""
    groups = list(groups)
    rows = df.where(F.col(value).isNotNull()).select(*groups, value)
    if not groups:
        rows, groups = rows.withColumn("_all", F.lit(1)), ["_all"]
    # One row per different value, so ties of any number are one row of the sort.
    counts = rows.groupBy(*groups, value).agg(F.count(F.lit(1)).alias("_n"))
    ranked = with_prefix_sums(counts, groups, [value], ["_n"])
    size, last = F.col("total__n"), F.col("cum__n")
    holds = lambda rank: (rank > last - F.col("_n")) & (rank <= last)
    out = []
    for name, level in probs.items():
        if method == "linear":
            at = (size - 1) * F.lit(level)
            low = F.floor(at) + 1
            part = at - F.floor(at)
            share = F.when(holds(low), 1 - part).otherwise(F.lit(0.0)) + F.when(holds(F.least(low + 1, size)), part).otherwise(F.lit(0.0))
            out.append(F.sum(F.when(share > 0, F.col(value) * share)).alias(name))
        else:
            target = F.greatest(F.lit(1), F.ceil(F.round(size * F.lit(level), 9)))
            out.append(F.max(F.when(holds(target), F.col(value))).alias(name))
    return ranked.groupBy(*groups).agg(*out).drop("_all")


SLICES, SLICE_ROWS = 64, 1_000_000


def hash_slices(df: DataFrame) -> int:
    """Slices that hold about :data:`SLICE_ROWS` rows of ``df`` each, :data:`SLICES` at least."""
    return max(SLICES, df.count() // SLICE_ROWS + 1)


def top_n_per_group(
    df: DataFrame, groups: Sequence[str], order: Sequence[str | Column], n: int, salts: int | None = None,
    rank: str = "rank",
) -> DataFrame:
    """The first ``n`` rows of each group in ``order`` with their rank. Groups are first cut to
    ``n`` rows per hash slice (as many slices as :func:`hash_slices` says), so no task sorts more than
    a slice or ``salts * n`` rows."""
    groups = list(groups)
    salts = salts or hash_slices(df)
    sliced = df.withColumn("_slice", F.pmod(F.xxhash64(*df.columns), F.lit(salts)))
    local = Window.partitionBy(*groups, "_slice").orderBy(*order)
    final = Window.partitionBy(*groups).orderBy(*order)
    return (
        sliced.withColumn("_local", F.row_number().over(local))
        .where(F.col("_local") <= n)
        .withColumn(rank, F.row_number().over(final))
        .where(F.col(rank) <= n)
        .drop("_slice", "_local")
    )
