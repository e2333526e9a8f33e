"""Paired inference at scale: Poisson cluster bootstrap, BCa and percentile intervals, McNemar.

Every cluster gets weight ``w(cluster, r) ~ Poisson(1)`` in replicate ``r``, a pure function of the
two, so all systems and arms share their resamples without any table of draws. Tasks keep one
running sum per (group, replicate) and ship only those, however many rows they read. Where clusters
are many, only part of their weights is drawn one by one, see :func:`strided_sums`.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from functools import reduce
from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.functions.hashing import hash_int, keyed_hash, tie_key
from plumbline.operators.ranking import sorted_once
from plumbline.session import checkpoint, lookup

MODULUS = 2**31 - 1
"""Weights come from ``(a + r * b) mod MODULUS`` with ``a``, ``b`` hashed from the cluster:
independent between clusters, pairwise independent between replicates."""
DEFAULT_RESAMPLES = 10_000
BCA_MIN_CLUSTERS = 500
TASK_CLUSTERS, LEAST_CLUSTERS, MOST_CLUSTERS = 1 << 16, 1 << 12, 1 << 20
"""Rows of cluster sums whose weights a task draws; fewer, down to the second, where cores would idle,
and more, up to the third, where there are :data:`TASKS_A_CORE` tasks for each core (every task ships a
row for each group and replicate)."""
TASKS_A_CORE, PIECES = 4, 8
"""Tasks for each core, and pieces of a task whose rows are added up by cluster one after another."""
HELD_CLUSTERS = 1 << 19
"""Rows of cluster sums that a task takes at once."""
MOST_SUMS = 1 << 24
"""Running sums (of all groups and replicates) that a task holds, but for one group's."""
STRIDE_CLUSTERS, STRIDE_RESAMPLES = 1 << 14, 1 << 10
"""Least clusters and replicates for :func:`strided_sums`."""
STRIDE_LANES = 1 << 10
"""Clusters of one stride whose changes of weight are found at once."""
DRAWN = 1 << 16
"""Weights drawn at once."""
CHANGE_COST = 10.0
"""What finding one change of a weight costs next to drawing one weight."""
POISSON_STEPS = tuple(
    int(MODULUS * sum(math.exp(-1.0) / math.factorial(i) for i in range(k + 1))) for k in range(10)
)
"""Cumulative Poisson(1) probabilities scaled to the modulus: weight = number of steps <= u."""


def with_seeds(df: DataFrame, cluster: Sequence[str], seed: int | str = 0) -> DataFrame:
    """Adds the two hashed integers that decide a cluster's weights."""
    digest = keyed_hash(seed, *[F.col(c) for c in cluster])
    return (
        df.withColumn("_h", digest)
        .withColumn("_a", hash_int(F.col("_h"), 1) % MODULUS)
        .withColumn("_b", hash_int(F.col("_h"), 16) % MODULUS)
        .drop("_h")
    )


def replicate_weights(a: np.ndarray, b: np.ndarray, first: int, count: int) -> np.ndarray:
    """``(count, n)`` weights of ``n`` clusters in replicates ``first .. first + count - 1``."""
    modulus = np.uint32(MODULUS)
    grid, spare = np.empty((2, count, a.shape[0]), dtype=np.uint32)
    grid[0], step = (a + first * b) % MODULUS, (b % MODULUS).astype(np.uint32)
    done = 1
    while done < count:  # the replicates at hand, all moved on by as many
        now = grid[done : 2 * done]
        less = spare[: len(now)]
        np.add(grid[: len(now)], step, out=now)
        np.minimum(now, np.subtract(now, modulus, out=less), out=now)  # below the modulus the difference wraps to a large value
        done += len(now)
        step = step + step
        step = np.minimum(step, step - modulus)
    weights, reached = np.zeros(grid.shape, dtype=np.int8), np.empty(grid.shape, dtype=bool)
    place = grid.view(np.int32)
    for bound in POISSON_STEPS:
        np.greater_equal(place, np.int32(bound), out=reached)
        weights += reached.view(np.int8)
    return weights.astype(np.float64)


def _strides(b: np.ndarray, n: int, most: float) -> tuple[np.ndarray, ...]:
    """For every step ``b`` the stride of replicates, ``most`` at most, after which ``r * b`` comes back to
    nearly the same place, at the least cost for ``n`` replicates: a convergent's denominator q, how far
    off it is, to which side, and denominator and distance of the convergent after it."""
    q, off = np.ones(len(b)), b.astype(np.float64)
    q_before, off_before, side = np.zeros(len(b)), np.full(len(b), float(MODULUS)), 1.0
    best, out = np.full(len(b), np.inf), [np.zeros(len(b)) for _ in range(5)]
    a_change = CHANGE_COST * (len(POISSON_STEPS) + 1) * n / MODULUS
    while True:
        on = off > 0  # else the place is met exactly
        times = np.floor(off_before / np.where(on, off, 1.0))
        q_next = np.where(on, q_before + times * q, float(MODULUS))
        off_next = np.where(on, off_before - times * off, 0.0)
        cost = q + a_change * off
        better = (cost < best) & (q <= most)
        np.copyto(best, cost, where=better)
        for held, now in zip(out, (q, off, side * on, q_next, off_next), strict=True):
            np.copyto(held, now, where=better)
        if not (q_next < np.minimum(best, most)).any():
            return tuple(out)
        q_before, off_before, q, off, side = q, off, q_next, off_next, -side


def _changes(a: np.ndarray, q: int, off: np.ndarray, side: np.ndarray, q_next: np.ndarray, off_next: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Replicates from ``q`` on, one row each (``n`` where there is none), in which a cluster has another
    weight than ``q`` replicates before, per Poisson step and for the end of the modulus; and by how much.

    In ``q`` replicates a cluster moves by ``off`` to one ``side``, so a step is crossed where the cluster
    lies less than ``off`` beyond it. Visits of a stretch as long as that are numbered by j: each is
    ``q_next``, or ``q_next + q``, replicates after the one before and ``off_next`` to the other side,
    modulo the stretch. All figures are integers below 2**53, and so are exact."""
    marks = np.array([*POISSON_STEPS, 0], dtype=np.float64)[:, None]
    moved = side * q
    place = a - (marks - np.where(side < 0, off, 0.0))
    place = place + np.where(place < 0, float(MODULUS), 0.0)
    place = place - np.where(place >= MODULUS, float(MODULUS), 0.0)
    length, shift = np.where(off > 0, off, 1.0), side * off_next
    j = np.floor((off * q + moved * place - np.where(side > 0, q * off, 0.0)) / MODULUS)
    for _ in range(2):  # the first visit from replicate q on
        j += j * q_next - moved * np.floor((place - j * shift) / length) < q
    most = np.minimum((n - 1 - q) // q_next + 1, (n - q) * off // MODULUS + 2).max()
    visits = np.arange(max(most, 0.0))[:, None, None]
    at = (place - j * shift) - visits * shift
    at /= length
    np.floor(at, out=at)
    at *= -moved
    at += j * q_next
    at += visits * q_next
    np.minimum(at, float(n), out=at)
    jumps = np.ones(len(marks))
    jumps[-1] = -len(POISSON_STEPS)
    return at.astype(np.intp), jumps[:, None] * side


def strided_sums(a: np.ndarray, b: np.ndarray, x: np.ndarray, n: int) -> np.ndarray:
    """``(n, columns)`` sums of ``x`` weighted by :func:`replicate_weights`, the same integers times the
    same figures, without drawing each of the ``n`` weights of a cluster.

    ``a + r * b`` comes back to nearly the same place after a stride of q replicates. So the weight in
    replicate r is that of replicate ``r - q`` but for few changes, where the place has moved across a
    Poisson step. The first q weights are drawn, the changes are added up by replicate, and running sums
    along the stride give the rest: about sqrt(n) figures a cluster in place of n."""
    # Every stride has running sums of its own, so fewer are used where clusters are few.
    most = max(1.0, min(7.0 * n**0.5, 3.0 * len(b) ** 0.5, n))
    q, off, side, q_next, off_next = _strides(b, n, most)
    order = np.argsort(q, kind="stable")
    q, off, side, q_next, off_next, a, b = (v[order] for v in (q, off, side, q_next, off_next, a, b))
    x = np.ascontiguousarray(x[order].T)
    out = np.zeros((len(x), n))
    firsts = np.flatnonzero(np.diff(q, prepend=0.0))
    for first, last in zip(firsts, [*firsts[1:], len(q)], strict=True):
        stride = int(q[first])
        sums = np.zeros((len(x), -(-n // stride) * stride))
        for i in range(first, last, STRIDE_LANES):
            rows = slice(i, min(i + STRIDE_LANES, last))
            at, jumps = _changes(a[rows].astype(np.float64), stride, off[rows], side[rows], q_next[rows], off_next[rows], n)
            for k, value in enumerate(x[:, rows]):
                sums[k, :n] += np.bincount(at.ravel(), np.broadcast_to(jumps * value, at.shape).ravel(), n + 1)[:n]
            block = max(1, DRAWN // at.shape[-1])
            for r in range(0, stride, block):
                size = min(block, stride - r)
                sums[:, r : r + size] += x[:, rows] @ replicate_weights(a[rows], b[rows], r, size).T
        sums = sums.reshape(len(x), -1, stride)
        for turn in range(1, sums.shape[1]):
            sums[:, turn] += sums[:, turn - 1]
        out += sums.reshape(len(x), -1)[:, :n]
    return out.T


def weighted_sums(a: np.ndarray, b: np.ndarray, x: np.ndarray, n: int) -> np.ndarray:
    """``(n, columns)`` sums of ``x`` over clusters, weighted as in each of ``n`` replicates."""
    if len(a) >= STRIDE_CLUSTERS and n >= STRIDE_RESAMPLES:
        return strided_sums(a, b, x, n)
    out = np.zeros((n, x.shape[1]))
    block_rows, block_reps = 2048, 64
    for i in range(0, len(a), block_rows):
        rows = slice(i, i + block_rows)
        for r in range(0, n, block_reps):
            size = min(block_reps, n - r)
            out[r : r + size] += replicate_weights(a[rows], b[rows], r, size) @ x[rows]
    return out


def bootstrap_sums(
    df: DataFrame,
    groups: Sequence[str],
    cluster: Sequence[str],
    values: Sequence[str],
    n_resamples: int = DEFAULT_RESAMPLES,
    seed: int | str = 0,
) -> DataFrame:
    """(groups, r) -> weighted sums ``s_<value>`` and weighted size ``w`` of every replicate.

    Rows are first added up per cluster. Weights depend on ``cluster`` only, so the series of a
    cluster (group columns that are not part of it: systems, arms) are packed side by side and one
    draw of weights serves them all.
    """
    return resampled_sums(checkpoint(cluster_sums(df, groups, cluster, values)), groups, cluster, values, n_resamples, seed)


def draw_tasks(totals: DataFrame) -> int:
    """Tasks that draw the weights of as many rows as there are in all groups, however few bytes those are:
    every cluster costs weights of all replicates."""
    n = totals.agg(F.coalesce(F.sum("_size"), F.lit(0))).first()[0]
    cores = totals.sparkSession.sparkContext.defaultParallelism
    return max(n // MOST_CLUSTERS, min(max(n // TASK_CLUSTERS, min(cores, n // LEAST_CLUSTERS)), TASKS_A_CORE * cores)) + 1


def group_totals(rows: DataFrame, groups: Sequence[str], values: Sequence[str]) -> DataFrame:
    """Per group of rows its number ``_g``, rows ``_size`` and sums ``_sum_<value>``, as a lookup."""
    sums = [F.sum(F.col(v).cast("double")).alias(f"_sum_{v}") for v in values]
    return _numbered(rows.groupBy(*groups).agg(F.count(F.lit(1)).alias("_size"), *sums), groups)


def _numbered(totals: DataFrame, groups: Sequence[str]) -> DataFrame:
    # One row per group.
    return lookup(totals.withColumn("_g", F.row_number().over(Window.orderBy(*groups)) - 1))


def _with_totals(df: DataFrame, totals: DataFrame, groups: Sequence[str]) -> DataFrame:
    """``df`` with the columns of its group (NULL is a group too)."""
    named = totals.select(*[c for c in totals.columns if c not in groups], *[F.col(g).alias(f"_of_{g}") for g in groups])
    same = reduce(lambda x, y: x & y, [F.col(g).eqNullSafe(F.col(f"_of_{g}")) for g in groups])
    return df.join(named, same).drop(*[f"_of_{g}" for g in groups])


def _away(values: Sequence[str]) -> list[Column]:
    """How far the mean without a cluster lies from the group's; moments about that keep the cubes free
    of cancellation. NULL where there is no other cluster."""
    rest = F.col("_size") - F.col("_n")
    return [(F.try_divide(F.col(f"_sum_{v}") - F.col(f"_s_{v}"), rest) - F.col(f"_sum_{v}") / F.col("_size")).alias(f"_d_{v}") for v in values]


def resampled_sums(
    sums: DataFrame,
    groups: Sequence[str],
    cluster: Sequence[str],
    values: Sequence[str],
    n_resamples: int = DEFAULT_RESAMPLES,
    seed: int | str = 0,
    totals: DataFrame | None = None,
) -> DataFrame:
    """:func:`bootstrap_sums` from the :func:`cluster_sums` of the rows, which are checkpointed and dealt
    to :func:`draw_tasks`. With the :func:`group_totals` of the rows they are read once as they are dealt
    (by cluster, in more pieces than tasks), and rows of replicates -4 to -1 tell :func:`told_moments` what it needs."""
    groups, values, cluster = list(groups), list(values), list(cluster)
    if not groups:
        return resampled_sums(sums.withColumn("_all", F.lit(1)), ["_all"], cluster, values, n_resamples, seed, totals).drop("_all")
    columns = ["w", *[f"s_{v}" for v in values]]
    told_too = totals is not None
    if not told_too:
        totals = _numbered(sums.groupBy(*groups).agg(F.count(F.lit(1)).alias("_size")), groups)
    tasks = draw_tasks(totals)
    if not told_too:
        sums = sums.repartition(tasks, *cluster)
    away, away_names = _away(values) if told_too else [], [f"_d_{v}" for v in values]
    n_groups, width = totals.count(), len(columns)
    per_cluster = _with_totals(with_seeds(sums, cluster, seed), totals, groups).select(
        F.col("_g"), "_a", "_b", F.col("_n").cast("double").alias("w"), *[F.col(f"_s_{v}").alias(f"s_{v}") for v in values], *away
    ).coalesce(tasks)
    schema = T.StructType(
        [T.StructField("_g", T.IntegerType()), T.StructField("r", T.IntegerType())] + [T.StructField(c, T.DoubleType()) for c in columns]
    )

    def told(g: int, first: int, sums: np.ndarray) -> pd.DataFrame:
        out = pd.DataFrame(sums, columns=columns)
        out.insert(0, "r", np.arange(first, first + len(sums), dtype=np.int32))
        out.insert(0, "_g", np.int32(g))
        return out

    def alike(g: np.ndarray, a: np.ndarray, b: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Groups (of several series) and row numbers of clusters that have rows in the same groups: one
        draw of their weights serves all series."""
        order = np.argsort(a * MODULUS + b)
        a, b = a[order], b[order]
        first = np.flatnonzero(np.append(True, (a[1:] != a[:-1]) | (b[1:] != b[:-1])))
        size = np.diff(first, append=len(order))
        for n in np.unique(size):
            at = order[first[size == n][:, None] + np.arange(n)]
            at = np.take_along_axis(at, np.argsort(g[at], axis=1), axis=1) if n > 1 else at
            name = g[at[:, 0]]
            for k in range(1, n):
                name = np.unique(name * n_groups + g[at[:, k]], return_inverse=True)[1]
            place = np.argsort(name, kind="stable")
            for part in np.split(place, np.flatnonzero(np.diff(name[place])) + 1):
                yield g[at[part[0]]], at[part]

    def add_powers(powers: np.ndarray, g: np.ndarray, d: np.ndarray) -> None:
        known = ~np.isnan(d)
        d, power = np.where(known, d, 0.0), known.astype(np.float64)
        for k in range(4):
            powers[:, k, 0] += np.bincount(g, minlength=n_groups)
            for i in range(d.shape[1]):
                powers[:, k, i + 1] += np.bincount(g, power[:, i], n_groups)
            power *= d

    def taken(batches: Iterator[pd.DataFrame], powers: np.ndarray) -> Iterator[tuple[np.ndarray, ...]]:
        """Groups, seeds and figures of many rows."""
        held, n = ([], [], [], []), 0
        whole = lambda: tuple(np.concatenate([parts.pop(0) for _ in range(len(parts))]) for parts in held)
        for pdf in batches:
            if told_too:
                add_powers(powers, pdf["_g"].to_numpy(), pdf[away_names].to_numpy(np.float64))
            kinds = (("_g", np.int32), ("_a", np.int32), ("_b", np.int32), (columns, np.float64))
            for parts, (name, kind) in zip(held, kinds, strict=True):
                parts.append(pdf[name].to_numpy(kind))
            n += len(pdf)
            if n >= HELD_CLUSTERS:
                yield whole()
                n = 0
        if n:
            yield whole()

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        np.empty(31 << 20, np.int8)  # freed at once: from then on the allocator keeps blocks up to that size
        totals: dict[int, np.ndarray] = {}
        powers = np.zeros((n_groups, 4, width))
        for g, a, b, x in taken(batches, powers):
            g, a, b = (v.astype(np.int64) for v in (g, a, b))
            for series, at in alike(g, a, b):
                drawn = weighted_sums(a[at[:, 0]], b[at[:, 0]], x[at].reshape(len(at), -1), n_resamples)
                for i, k in enumerate(series):
                    if k not in totals:
                        # Sums add up however they are cut, so a task passes on what it holds and goes on.
                        if totals and (len(totals) + 1) * n_resamples * width > MOST_SUMS:
                            yield from (told(k, 0, acc) for k, acc in totals.items())
                            totals = {}
                        totals[k] = np.zeros((n_resamples, width))
                    totals[k] += drawn[:, i * width : (i + 1) * width]
        yield from (told(k, 0, acc) for k, acc in totals.items())
        yield from (told(k, -4, powers[k]) for k in np.flatnonzero(powers[:, 0, 0]))

    partials = per_cluster.mapInPandas(partial, schema).groupBy("_g", "r").agg(*[F.sum(c).alias(c) for c in columns])
    return partials.join(totals.select("_g", *groups), "_g").select(*groups, "r", *columns)


def strata_and_means(
    df: DataFrame,
    groups: Sequence[str],
    cluster: Sequence[str],
    values: Sequence[str],
    n_resamples: int = DEFAULT_RESAMPLES,
    seed: int | str = 0,
) -> tuple[DataFrame, DataFrame]:
    """:func:`stratum_moments` and :func:`replicate_means` of rows (cached: they are added up by group, and
    then dealt by cluster), whose cluster sums are made and read once and never written."""
    totals = group_totals(df, groups, values)
    sums = cluster_sums(df.repartition(PIECES * draw_tasks(totals), *cluster), groups, cluster, values)
    drawn = checkpoint(resampled_sums(sums, groups, cluster, values, n_resamples, seed, totals))
    return checkpoint(told_moments(drawn, totals, groups, values)), replicate_means(drawn.where("r >= 0"), values)


def replicate_means(sums: DataFrame, values: Sequence[str]) -> DataFrame:
    """Replicate means ``m_<value>``; a replicate that drew no cluster is NULL."""
    return sums.withColumns({f"m_{v}": F.try_divide(f"s_{v}", "w") for v in values})


def percentile_intervals(
    replicates: DataFrame, groups: Sequence[str], values: Sequence[str], level: float = 0.95
) -> DataFrame:
    """``low_<value>``/``high_<value>`` over replicates. A group holds ``n_resamples`` rows, a
    constant, so the exact aggregate is bounded."""
    alpha = (1.0 - level) / 2.0
    both = F.array(F.lit(alpha), F.lit(1.0 - alpha))
    ends = replicates.groupBy(*groups).agg(*[F.percentile(F.col(f"m_{v}"), both).alias(f"_q_{v}") for v in values])
    named = [F.col(f"_q_{v}")[k].alias(f"{end}_{v}") for v in values for k, end in enumerate(("low", "high"))]
    return ends.select(*groups, *named)


def bootstrap_intervals(
    df: DataFrame,
    groups: Sequence[str],
    cluster: Sequence[str],
    values: Sequence[str],
    n_resamples: int = DEFAULT_RESAMPLES,
    seed: int | str = 0,
    level: float = 0.95,
) -> DataFrame:
    """Mean of each value with its interval per group: BCa from :data:`BCA_MIN_CLUSTERS` clusters,
    percentile below."""
    groups = list(groups)
    if not groups:
        whole = df.withColumn("_all", F.lit(1))
        return bootstrap_intervals(whole, ["_all"], cluster, values, n_resamples, seed, level).drop("_all")
    sums = checkpoint(cluster_sums(df, groups, cluster, values))
    means = replicate_means(resampled_sums(sums, groups, cluster, values, n_resamples, seed), values)
    ends = bounds(stratum_moments(sums, groups, values), means, groups, values, level)
    points = df.groupBy(*groups).agg(
        F.count(F.lit(1)).alias("n"), *[F.avg(F.col(v).cast("double")).alias(v) for v in values]
    )
    return points.join(ends.drop("n_clusters", "method"), groups)


def excludes_zero(low: Column, high: Column) -> Column:
    return (low > 0) | (high < 0)


# --- BCa -----------------------------------------------------------------------------------------


def cluster_sums(df: DataFrame, keys: Sequence[str], cluster: Sequence[str], values: Sequence[str]) -> DataFrame:
    """Per key and cluster: rows ``_n`` and sums ``_s_<value>``."""
    both = list(dict.fromkeys([*keys, *cluster]))
    return df.groupBy(*both).agg(F.count(F.lit(1)).alias("_n"), *[F.sum(F.col(v).cast("double")).alias(f"_s_{v}") for v in values])


def paired_sums(
    sums: DataFrame, fixed: Sequence[str], varied: str, base: str, cluster: Sequence[str], values: Sequence[str]
) -> DataFrame:
    """:func:`cluster_sums` of every series of ``varied`` less those of the series ``base`` in the same
    cluster (all series have the same rows of a cluster). A cluster's series meet in one window, which
    holds one row for each of them."""
    own = Window.partitionBy(*dict.fromkeys([*fixed, *cluster]))
    is_base = F.col(varied) == base
    less = {f"_s_{v}": F.col(f"_s_{v}") - F.max(F.when(is_base, F.col(f"_s_{v}"))).over(own) for v in values}
    return sums.withColumns(less).where(~is_base)


def stratum_moments(sums: DataFrame, groups: Sequence[str], values: Sequence[str]) -> DataFrame:
    """Per group of :func:`cluster_sums`: n_clusters and for each value its mean (``estimate_<v>``) and
    the sums of squares and cubes of how far the mean of the leave-one-cluster-out means lies above
    each of them (``second_<v>``, ``third_<v>``)."""
    groups = list(groups)
    totals = sums.groupBy(*groups).agg(
        F.count(F.lit(1)).alias("n_clusters"), F.sum("_n").alias("_size"), *[F.sum(f"_s_{v}").alias(f"_sum_{v}") for v in values]
    )
    powers = [F.avg(F.pow(f"_d_{v}", F.lit(k))).alias(f"_m{k}_{v}") for v in values for k in (1, 2, 3)]
    firsts = [F.first(F.col(f"_sum_{v}") / F.col("_size")).alias(f"estimate_{v}") for v in values]
    away = sums.join(lookup(totals), groups).select("*", *_away(values))
    return _central(away.groupBy(*groups).agg(F.first("n_clusters").alias("n_clusters"), *firsts, *powers), groups, values)


def told_moments(drawn: DataFrame, totals: DataFrame, groups: Sequence[str], values: Sequence[str]) -> DataFrame:
    """:func:`stratum_moments` from the rows below replicate 0 that :func:`resampled_sums` tells of groups
    with ``totals``: powers 0 to 3 of how far each cluster is away, added up."""
    power = F.col("r") + 4
    of = lambda k, c: F.max(F.when(power == k, F.col(c)))
    means = [F.try_divide(of(k, f"s_{v}"), of(0, f"s_{v}")).alias(f"_m{k}_{v}") for v in values for k in (1, 2, 3)]
    told = drawn.where("r < 0").groupBy(*groups).agg(F.max("w").cast("bigint").alias("n_clusters"), *means)
    estimates = [(F.col(f"_sum_{v}") / F.col("_size")).alias(f"estimate_{v}") for v in values]
    return _central(_with_totals(told, totals, groups).select("*", *estimates), groups, values)


def _central(moments: DataFrame, groups: Sequence[str], values: Sequence[str]) -> DataFrame:
    out = []
    for v in values:
        m1, m2, m3 = (F.coalesce(F.col(f"_m{k}_{v}"), F.lit(0.0)) for k in (1, 2, 3))
        out += [
            F.col(f"estimate_{v}"),
            (F.col("n_clusters") * F.greatest(m2 - m1 * m1, F.lit(0.0))).alias(f"second_{v}"),
            (F.col("n_clusters") * -(m3 - 3 * m1 * m2 + 2 * m1 * m1 * m1)).alias(f"third_{v}"),
        ]
    return moments.select(*groups, "n_clusters", *out)


def macro_moments(moments: DataFrame, groups: Sequence[str], values: Sequence[str]) -> DataFrame:
    """:func:`stratum_moments` of the average over strata (benchmarks). Leaving out a cluster moves
    its own stratum only, by a share of one in the number of strata k: squares add up over k^2, cubes
    over k^3."""
    k = F.count(F.lit(1)).cast("double")
    columns = []
    for v in values:
        columns += [F.avg(f"estimate_{v}").alias(f"estimate_{v}"), (F.sum(f"second_{v}") / (k * k)).alias(f"second_{v}"), (F.sum(f"third_{v}") / (k * k * k)).alias(f"third_{v}")]
    return moments.groupBy(*groups).agg(F.sum("n_clusters").alias("n_clusters"), *columns)


def acceleration(second: Column, third: Column) -> Column:
    scale = 6.0 * F.pow(second, F.lit(1.5))
    return F.when(scale > 0, third / scale).otherwise(F.lit(0.0))


def jackknife_moments(
    df: DataFrame, groups: Sequence[str], cluster: Sequence[str], value: str
) -> DataFrame:
    """Per group: number of clusters, mean, and the acceleration from leave-one-cluster-out means."""
    return jackknifed(stratum_moments(checkpoint(cluster_sums(df, groups, cluster, [value])), groups, [value]), groups, value)


def jackknifed(moments: DataFrame, groups: Sequence[str], value: str) -> DataFrame:
    return moments.select(
        *groups, "n_clusters", F.col(f"estimate_{value}").alias("estimate"), acceleration(F.col(f"second_{value}"), F.col(f"third_{value}")).alias("acceleration")
    )


def _bca_levels(fraction: pd.Series, n: pd.Series, accel: pd.Series, alpha: float) -> pd.DataFrame:
    normal = NormalDist()
    rows = []
    for f, b, a in zip(fraction, n, accel, strict=True):
        z0 = normal.inv_cdf(min(max(f, 0.5 / b), 1.0 - 0.5 / b))
        ends = []
        for z in (normal.inv_cdf(alpha), normal.inv_cdf(1.0 - alpha)):
            ends.append(normal.cdf(z0 + (z0 + z) / (1.0 - a * (z0 + z))))
        rows.append(ends)
    return pd.DataFrame(rows, columns=["low", "high"])


def _array_quantile(values: Column, level: Column) -> Column:
    """Linear quantile of a sorted array."""
    at = (F.size(values) - 1) * level
    low = F.floor(at).cast("int")
    high = F.least(low + 1, F.size(values) - 1)
    part = at - low
    return F.get(values, low) * (1 - part) + F.get(values, high) * part


def bounds(
    moments: DataFrame,
    means: DataFrame,
    groups: Sequence[str],
    values: Sequence[str],
    level: float = 0.95,
    min_clusters: int = BCA_MIN_CLUSTERS,
) -> DataFrame:
    """(groups, n_clusters, method, low_<value>, high_<value>) from :func:`stratum_moments` (or
    :func:`macro_moments`) and the replicates ``m_<value>``: bias-corrected accelerated intervals for
    groups with at least ``min_clusters`` clusters, percentile intervals otherwise; replicates without
    spread give the estimate."""
    groups = list(groups)
    keys = [*groups, "metric"]
    alpha = (1.0 - level) / 2.0
    each = [
        F.struct(F.lit(v).alias("metric"), F.col(f"estimate_{v}").alias("estimate"), acceleration(F.col(f"second_{v}"), F.col(f"third_{v}")).alias("acceleration"))
        for v in values
    ]
    points = moments.select(*groups, "n_clusters", F.inline(F.array(*each)))
    drawn = means.select(*groups, F.inline(F.array(*[F.struct(F.lit(v).alias("metric"), F.col(f"m_{v}").alias("m")) for v in values])))
    # At most n_resamples values per group and metric: a constant bound.
    drawn = drawn.groupBy(*keys).agg(F.sort_array(F.collect_list("m")).alias("_boot"))

    @F.pandas_udf("low double, high double")
    def levels(fraction: pd.Series, n: pd.Series, accel: pd.Series) -> pd.DataFrame:
        return _bca_levels(fraction, n, accel, alpha)

    below = F.size(F.filter("_boot", lambda x: x < F.col("estimate"))) / F.size("_boot")
    joined = points.join(drawn, keys).where(F.size("_boot") > 0).withColumn("_fraction", below)
    use_bca = F.col("n_clusters") >= min_clusters
    joined = joined.withColumn("_levels", levels("_fraction", F.size("_boot").cast("double"), "acceleration"))
    at = {"low": F.when(use_bca, F.col("_levels.low")).otherwise(F.lit(alpha)), "high": F.when(use_bca, F.col("_levels.high")).otherwise(F.lit(1.0 - alpha))}
    flat = F.array_max("_boot") == F.array_min("_boot")
    ends = joined.withColumns({k: F.when(flat, F.col("estimate")).otherwise(_array_quantile(F.col("_boot"), v)) for k, v in at.items()})
    named = [F.max(F.when(F.col("metric") == v, F.col(k))).alias(f"{k}_{v}") for v in values for k in ("low", "high")]
    return ends.groupBy(*groups).agg(
        F.max("n_clusters").alias("n_clusters"), F.when(F.max("n_clusters") >= min_clusters, "bca").otherwise("percentile").alias("method"), *named
    )


def bca_intervals(
    df: DataFrame,
    groups: Sequence[str],
    cluster: Sequence[str],
    value: str,
    n_resamples: int = DEFAULT_RESAMPLES,
    seed: int | str = 0,
    level: float = 0.95,
    min_clusters: int = BCA_MIN_CLUSTERS,
) -> DataFrame:
    """Mean of ``value`` per group with the interval of :func:`bounds`, its method and the
    acceleration."""
    sums = checkpoint(cluster_sums(df, groups, cluster, [value]))
    means = replicate_means(resampled_sums(sums, groups, cluster, [value], n_resamples, seed), [value])
    moments = checkpoint(stratum_moments(sums, groups, [value]))
    ends = bounds(moments, means, groups, [value], level, min_clusters)
    return ends.join(jackknifed(moments, groups, value).drop("n_clusters"), list(groups)).select(
        *groups, "estimate", F.col(f"low_{value}").alias("low"), F.col(f"high_{value}").alias("high"), "n_clusters", "method", "acceleration"
    )


# --- macro and deltas ----------------------------------------------------------------------------


def macro_replicates(
    means: DataFrame, groups: Sequence[str], values: Sequence[str]
) -> DataFrame:
    """Replicates averaged over benchmarks (each benchmark weighs the same)."""
    return means.groupBy(*groups, "r").agg(*[F.avg(f"m_{v}").alias(f"m_{v}") for v in values])


def macro_intervals(
    df: DataFrame,
    groups: Sequence[str],
    cluster: Sequence[str],
    values: Sequence[str],
    n_resamples: int = DEFAULT_RESAMPLES,
    seed: int | str = 0,
    level: float = 0.95,
    min_clusters: int = BCA_MIN_CLUSTERS,
) -> DataFrame:
    """Equal-weight mean over benchmarks with a stratified interval: BCa from ``min_clusters`` clusters
    in all, percentile below."""
    groups = list(groups)
    if not groups:
        whole = df.withColumn("_all", F.lit(1))
        return macro_intervals(whole, ["_all"], cluster, values, n_resamples, seed, level, min_clusters).drop("_all")
    each = [*groups, "benchmark"]
    sums = checkpoint(cluster_sums(df, each, cluster, values))
    means = replicate_means(resampled_sums(sums, each, cluster, values, n_resamples, seed), values)
    return macro_ends(checkpoint(stratum_moments(sums, each, values)), means, groups, values, level, min_clusters)


def macro_ends(
    strata: DataFrame,
    means: DataFrame,
    groups: Sequence[str],
    values: Sequence[str],
    level: float = 0.95,
    min_clusters: int = BCA_MIN_CLUSTERS,
) -> DataFrame:
    """:func:`macro_intervals` from the :func:`stratum_moments` and replicates of the benchmarks."""
    macro = macro_replicates(means, groups, values)
    ends = bounds(macro_moments(strata, groups, values), macro, groups, values, level, min_clusters).drop("n_clusters", "method")
    points = strata.groupBy(*groups).agg(F.count(F.lit(1)).alias("n_benchmarks"), *[F.avg(f"estimate_{v}").alias(v) for v in values])
    return points.join(ends, groups)


def replicate_deltas(
    means: DataFrame, keys: Sequence[str], series: str, minus: str, values: Sequence[str]
) -> DataFrame:
    """Replicates of every series minus the series ``minus`` on shared resamples."""
    base = means.where(F.col(series) == minus).select(
        *keys, "r", *[F.col(f"m_{v}").alias(f"_b_{v}") for v in values]
    )
    return (
        means.where(F.col(series) != minus)
        .join(base, [*keys, "r"])
        .withColumns({f"m_{v}": F.col(f"m_{v}") - F.col(f"_b_{v}") for v in values})
        .drop(*[f"_b_{v}" for v in values])
    )


# --- exact test ----------------------------------------------------------------------------------


@F.pandas_udf(T.DoubleType())
def _mcnemar_p(only_a: pd.Series, only_b: pd.Series) -> pd.Series:
    out = []
    for a, b in zip(only_a, only_b, strict=True):
        n, k = int(a + b), int(min(a, b))
        if n == 0:
            out.append(1.0)
            continue
        # Terms fall off within a few standard deviations below k, so the sum stays short.
        i = np.arange(k, max(-1, k - int(40 * math.sqrt(n)) - 100), -1, dtype=np.float64)
        top = math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1) - n * math.log(2.0)
        falls = np.concatenate([[0.0], np.cumsum(np.log(i[:-1] / (n - i[:-1] + 1.0)))])
        out.append(min(1.0, 2.0 * math.exp(top) * float(np.exp(falls).sum())))
    return pd.Series(out)


def mcnemar(pairs: DataFrame, groups: Sequence[str], a: str, b: str) -> DataFrame:
    """Discordant counts and the exact two-sided p-value per group (one vectorised evaluation per
    group row, after the counts are aggregated)."""
    left, right = F.col(a).cast("boolean"), F.col(b).cast("boolean")
    counts = pairs.groupBy(*groups).agg(
        F.count_if(left & ~right).alias("only_a"), F.count_if(~left & right).alias("only_b")
    )
    return counts.withColumn("p_value", _mcnemar_p("only_a", "only_b"))


# --- calibration error per replicate -----------------------------------------------------------------


CHUNK_ROWS, CHUNK_REPLICATES = 1024, 256
"""Rows and replicates whose weights a task draws at once."""


def _weight_blocks(a: np.ndarray, b: np.ndarray, n_resamples: int) -> Iterator[tuple[slice, np.ndarray]]:
    for r in range(0, n_resamples, CHUNK_REPLICATES):
        size = min(CHUNK_REPLICATES, n_resamples - r)
        yield slice(r, r + size), replicate_weights(a, b, r, size)


def _sums_up_to(w: np.ndarray, value: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """(replicate, edge, column) sums of ``value`` over each replicate's copies before each edge."""
    size, n = w.shape
    reach = np.cumsum(w, axis=1)
    apart = 2.0 ** np.ceil(np.log2(reach.max() + 2.0)) * np.arange(size)[:, None]  # rows one after another
    at = np.searchsorted((reach + apart).ravel(), (edges + apart).ravel(), side="right").reshape(edges.shape) - n * np.arange(size)[:, None]
    row = np.arange(size)[:, None]
    before = np.concatenate([np.zeros((size, 1)), reach], axis=1)[row, at]
    out = np.empty((*edges.shape, value.shape[1]))
    inside = np.minimum(at, n - 1)
    for k in range(value.shape[1]):
        run = np.concatenate([np.zeros((size, 1)), np.cumsum(w * value[:, k], axis=1)], axis=1)
        out[:, :, k] = run[row, at] + np.where(at < n, edges - before, 0.0) * value[inside, k]
    return out


class _Bins:
    """Per replicate and bin: the weight of a range's rows, and their weighted confidence and hits.
    Rows come in order and in chunks. A chunk that lies within one bin adds its totals there; only in
    the replicates whose bin edges fall inside it are its rows divided."""

    def __init__(self, before: np.ndarray, total: np.ndarray, bins: int):
        base, extra = np.divmod(total, bins)
        k = np.arange(1, bins + 1)
        self.upper = base[:, None] * k + np.minimum(k, extra[:, None])  # where each bin ends
        self.at, self.bins = before.copy(), bins
        self.sums = np.zeros((len(before), bins, 3))

    def add(self, conf: np.ndarray, hit: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
        value = np.stack([conf, hit, np.ones(len(conf))], axis=1)
        for rows, w in _weight_blocks(a, b, len(self.at)):
            totals = w @ value
            start = self.at[rows]
            end = start + totals[:, 2]
            upper = self.upper[rows]
            first = np.minimum((upper <= start[:, None]).sum(axis=1), self.bins - 1)
            whole = end <= upper[np.arange(len(upper)), first]
            sums = self.sums[rows]
            sums[np.flatnonzero(whole), first[whole]] += totals[whole]
            cut = np.flatnonzero(~whole)
            if len(cut):
                edges = np.clip(upper[cut] - start[cut, None], 0.0, totals[cut, 2:])
                sums[cut] += np.diff(_sums_up_to(w[cut], value, edges), axis=1, prepend=0.0)
            self.at[rows] = end


def ece_replicates(
    df: DataFrame,
    groups: Sequence[str],
    cluster: Sequence[str],
    n_resamples: int = DEFAULT_RESAMPLES,
    bins: int = 10,
    seed: int | str = 0,
    conf: str = "confidence",
    correct: str = "correct",
    item: str = "item_id",
) -> DataFrame:
    """(groups, r, ece): equal-mass calibration error of every replicate's expanded sample.

    Rows are range-sorted by confidence once for all replicates. Each range reports its weight per
    replicate; running totals over the ranges say where in the expanded sample a range begins. Then
    ranges are read once more, behind a row with those totals, and add up their share of each bin.
    Items are never expanded; a task holds :data:`CHUNK_ROWS` rows and one figure per replicate and
    bin, whatever the length of its range.
    """
    groups = list(groups)
    rows = with_seeds(df, cluster, seed).select(
        *groups, F.col(conf).cast("double").alias("_conf"), F.col(correct).cast("double").alias("_hit"),
        tie_key(F.col(item)).alias("_tie"), "_a", "_b",
    )
    placed = sorted_once(rows, [*groups, "_conf", "_tie"])
    place = [*groups, "_part"]

    def chunks(batches: Iterator[pd.DataFrame]) -> Iterator[tuple[tuple, pd.DataFrame]]:
        for pdf in batches:
            for key, part in pdf.groupby(place, sort=False, dropna=False):
                for i in range(0, len(part), CHUNK_ROWS):
                    yield key, part.iloc[i : i + CHUNK_ROWS]

    def keyed(key: tuple, columns: dict, names: Sequence[str]) -> pd.DataFrame:
        out = pd.DataFrame(columns)
        for i, (name, value) in enumerate(zip(names, key, strict=False)):
            out.insert(i, name, value)
        return out

    def range_weights(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, total = None, np.zeros(n_resamples)
        name = np.arange(n_resamples, dtype=np.int32)
        for key, part in chunks(batches):
            if now is not None and key != now:
                yield keyed(now, {"r": name, "w": total}, place)
                total = np.zeros(n_resamples)
            now = key
            for rows, w in _weight_blocks(part["_a"].to_numpy(np.int64), part["_b"].to_numpy(np.int64), n_resamples):
                total[rows] += w.sum(axis=1)
        if now is not None:
            yield keyed(now, {"r": name, "w": total}, place)

    fields = [placed.schema[c] for c in place]
    weights = placed.mapInPandas(range_weights, T.StructType([*fields, T.StructField("r", T.IntegerType()), T.StructField("w", T.DoubleType())]))
    weights = weights.groupBy(*place, "r").agg(F.sum("w").alias("w"))
    earlier = Window.partitionBy(*groups, "r").orderBy("_part")  # one row per range
    offsets = weights.withColumns(
        {
            "before": F.coalesce(F.sum("w").over(earlier.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)),
            "total": F.sum("w").over(Window.partitionBy(*groups, "r")),
        }
    )
    # One row per range, with n_resamples figures.
    of_range = offsets.groupBy(*place).agg(F.sort_array(F.collect_list(F.struct("r", "before", "total"))).alias("_o"))
    ahead = of_range.select(
        *place, F.lit(-1).cast("bigint").alias("_pos"),
        *[F.lit(None).cast(t).alias(c) for c, t in (("_conf", "double"), ("_hit", "double"), ("_a", "bigint"), ("_b", "bigint"))],
        F.transform("_o", lambda o: o["before"]).alias("_before"), F.transform("_o", lambda o: o["total"]).alias("_total"),
    )
    none = F.lit(None).cast("array<double>")
    items = placed.select(*place, "_pos", "_conf", "_hit", "_a", "_b", none.alias("_before"), none.alias("_total"))

    def range_bins(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, held = None, None

        def told() -> pd.DataFrame:
            r, k = np.nonzero(held.sums[:, :, 2])
            c, h, w = held.sums[r, k].T
            return keyed(now, {"r": r.astype(np.int32), "bin": k.astype(np.int32), "c": c, "h": h, "w": w}, groups)

        for key, part in chunks(batches):
            if key != now:
                if now is not None:
                    yield told()
                now, held = key, _Bins(np.asarray(part["_before"].iloc[0], float), np.asarray(part["_total"].iloc[0], float), bins)
                part = part.iloc[1:]
            if len(part):
                held.add(part["_conf"].to_numpy(), part["_hit"].to_numpy(), part["_a"].to_numpy(np.int64), part["_b"].to_numpy(np.int64))
        if now is not None:
            yield told()

    sums_schema = T.StructType(
        [placed.schema[c] for c in groups]
        + [T.StructField("r", T.IntegerType()), T.StructField("bin", T.IntegerType())]
        + [T.StructField(c, T.DoubleType()) for c in ("c", "h", "w")]
    )
    streamed = items.unionByName(ahead).repartition(*place).sortWithinPartitions(*place, "_pos")
    per_bin = streamed.mapInPandas(range_bins, sums_schema).groupBy(*groups, "r", "bin").agg(*[F.sum(x).alias(x) for x in ("c", "h", "w")])
    return per_bin.groupBy(*groups, "r").agg((F.sum(F.abs(F.col("h") - F.col("c"))) / F.sum("w")).alias("ece"))
