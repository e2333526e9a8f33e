"""Speed-quality frontiers, steps along them, tiers and rankings of candidate systems."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.operators.ranking import hash_slices

TIERS = (0.0, 5.0, 10.0, 20.0, 30.0, 50.0)


def _not_beaten(df: DataFrame, x: Column, y: Column, name: str, *partition: str) -> DataFrame:
    """Rows with a better ``y`` than every row of better ``x`` in their partition."""
    window = Window.partitionBy(*partition).orderBy(x.desc(), y.desc(), F.col(name))
    before = window.rowsBetween(Window.unboundedPreceding, -1)
    best = F.max(y).over(before)
    return df.withColumn("_best", best).where(F.col("_best").isNull() | (y > F.col("_best"))).drop("_best")


def frontier(
    points: DataFrame, x: str, y: str, name: str = "name", groups: Sequence[str] = (),
    higher_is_better: bool = True, x_higher_is_better: bool = True,
) -> DataFrame:
    """Points no other point beats on both axes. Hash slices of bounded size are reduced to their own
    frontiers first; only those few survivors are compared with each other."""
    sx = F.col(x) if x_higher_is_better else -F.col(x)
    sy = F.col(y) if higher_is_better else -F.col(y)
    sliced = points.withColumn("_slice", F.pmod(F.xxhash64(name), F.lit(hash_slices(points))))
    local = _not_beaten(sliced, sx, sy, name, *groups, "_slice").drop("_slice")
    return _not_beaten(local.withColumn("_one", F.lit(1)), sx, sy, name, *groups, "_one").drop("_one")


def frontier_steps(front: DataFrame, x: str, y: str, name: str = "name") -> DataFrame:
    """Consecutive frontier points, slowest first: the speed-up and the quality given up."""
    order = Window.partitionBy(F.lit(1)).orderBy(F.col(x), F.col(name))  # frontier points only
    return (
        front.withColumns(
            {
                "to_name": F.lead(name).over(order), "_x": F.lead(x).over(order), "_y": F.lead(y).over(order),
            }
        )
        .where(F.col("to_name").isNotNull())
        .select(F.col(name).alias("from_name"), "to_name", (F.col("_x") / F.col(x)).alias("speedup"), (F.col("_y") - F.col(y)).alias("delta"))
    )


def frontier_vertices(front: DataFrame, x: str, y: str, name: str = "name") -> DataFrame:
    """(seq, x, y): corners of the step line through the frontier, by rising x."""
    order = Window.partitionBy(F.lit(1)).orderBy(F.col(x), F.col(name))
    rows = front.withColumns({"_i": F.row_number().over(order), "_next": F.lead(y).over(order)})
    corner = F.array(
        F.struct((F.col("_i") * 2 - 1).alias("seq"), F.col(x).alias("x"), F.col(y).alias("y")),
        F.struct((F.col("_i") * 2).alias("seq"), F.col(x).alias("x"), F.col("_next").alias("y")),
    )
    return rows.select(F.inline(corner)).where(F.col("y").isNotNull())


def best_per_tier(
    points: DataFrame, x: str, y: str, name: str = "name", tiers: Sequence[float] = TIERS
) -> DataFrame:
    """Per minimum speed: how many candidates reach it and the best of them (last name on ties)."""
    reached = F.filter(F.array(*[F.lit(t) for t in tiers]), lambda t: F.col(x) >= t)
    return (
        points.withColumn("min_qps", F.explode(reached))
        .groupBy("min_qps")
        .agg(
            F.count(F.lit(1)).alias("n_candidates"),
            F.max_by(name, F.struct(y, name)).alias("best"),
            F.max(y).alias(f"best_{y}"),
        )
    )


def best_by_role(points: DataFrame, role: str, y: str, name: str = "name") -> DataFrame:
    """The best candidate of each role (last name on ties)."""
    return points.groupBy(role).agg(
        F.max_by(name, F.struct(y, name)).alias("best"), F.max(y).alias(f"best_{y}")
    )


def rank_runs(points: DataFrame, accuracy: str, nll: str, name: str = "name") -> DataFrame:
    """Runs ranked by accuracy, then lower NLL, then name."""
    from plumbline.operators.ranking import with_rank

    keyed = points.withColumn("_a", -F.col(accuracy))
    return with_rank(keyed, [], ["_a", nll, name], "place", "_n").drop("_a", "_n")


def capacity_ceiling(limits: Sequence[tuple[Column, Column]]) -> tuple[Column, Column]:
    """The least of several limits (NULL ones do not apply) and the reason that binds."""
    caps = F.array(*[F.struct(value.alias("qps"), why.alias("why")) for value, why in limits])
    least = F.array_min(F.filter(caps, lambda c: c["qps"].isNotNull()))
    return least["qps"], least["why"]
