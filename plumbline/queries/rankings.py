"""Frontiers, tiers and rankings of candidate systems."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbline.operators import frontier as W
from plumbline.operators import summaries as S
from plumbline.queries import derived as D
from plumbline.queries.registry import n, query, r

_FRONT = """SELECT * FROM (SELECT *, max(quality) OVER (ORDER BY qps DESC, quality DESC, name ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS best FROM candidates) WHERE best IS NULL OR quality > best"""


@query("speed_quality_frontier", f"SELECT name, {r('qps', 'qps')}, {r('quality', 'quality')} FROM ({_FRONT})", ("candidates",))
def speed_quality_frontier(spark, sf):
    return W.frontier(D.candidates(spark, sf), "qps", "quality").select("name", "qps", "quality")


@query(
    "low_error_frontier",
    f"""SELECT size_class, name, {r('nll', 'nll')}, {r('ece', 'ece')} FROM (SELECT *, max(-ece) OVER (PARTITION BY size_class ORDER BY nll, ece, name ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS best FROM candidates) WHERE best IS NULL OR -ece > best""",
    ("candidates",),
)
def low_error_frontier(spark, sf):
    """Per size class, candidates not beaten on two errors (lower is better on both axes)."""
    front = W.frontier(D.candidates(spark, sf), "nll", "ece", groups=["size_class"], higher_is_better=False, x_higher_is_better=False)
    return front.select("size_class", "name", "nll", "ece")


@query(
    "frontier_steps",
    f"""WITH f AS ({_FRONT}), s AS (SELECT name AS from_name, lead(name) OVER w AS to_name, lead(qps) OVER w / qps AS speedup, lead(quality) OVER w - quality AS delta FROM f WINDOW w AS (ORDER BY qps, name))
    SELECT from_name, to_name, {r('speedup', 'speedup')}, {r('delta', 'delta')} FROM s WHERE to_name IS NOT NULL""",
    ("candidates",),
)
def frontier_steps(spark, sf):
    return W.frontier_steps(W.frontier(D.candidates(spark, sf), "qps", "quality"), "qps", "quality")


@query(
    "frontier_vertices",
    f"""WITH f AS ({_FRONT}), i AS (SELECT *, row_number() OVER (ORDER BY qps, name) AS i, lead(quality) OVER (ORDER BY qps, name) AS nxt FROM f)
    SELECT {n('2 * i - 1', 'seq')}, {r('qps', 'x')}, {r('quality', 'y')} FROM i UNION ALL SELECT {n('2 * i', 'seq')}, {r('qps', 'x')}, {r('nxt', 'y')} FROM i WHERE nxt IS NOT NULL""",
    ("candidates",),
)
def frontier_vertices(spark, sf):
    return W.frontier_vertices(W.frontier(D.candidates(spark, sf), "qps", "quality"), "qps", "quality")


@query(
    "best_per_tier",
    f"""SELECT {r('t', 'min_qps')}, {n('count(*)', 'n_candidates')}, arg_max(name, (quality, name)) AS best, {r('max(quality)', 'best_quality')} FROM candidates, (SELECT unnest([0.0, 5.0, 5.8, 6.0, 6.4]) AS t) WHERE qps >= t GROUP BY t""",
    ("candidates",),
)
def best_per_tier(spark, sf):
    return W.best_per_tier(D.candidates(spark, sf), "qps", "quality", tiers=(0.0, 5.0, 5.8, 6.0, 6.4))


@query(
    "best_by_role",
    f"SELECT size_class, arg_max(name, (quality, name)) AS best, {r('max(quality)', 'best_quality')} FROM candidates GROUP BY 1", ("candidates",),
)
def best_by_role(spark, sf):
    return W.best_by_role(D.candidates(spark, sf), "size_class", "quality")


@query(
    "ranked_runs",
    f"SELECT name, {n('row_number() OVER (ORDER BY quality DESC, nll, name)', 'place')}, {r('quality', 'quality')}, {r('nll', 'nll')} FROM candidates", ("candidates",),
)
def ranked_runs(spark, sf):
    return W.rank_runs(D.candidates(spark, sf), "quality", "nll").select("name", "place", "quality", "nll")


@query(
    "best_arms",
    f"SELECT size_class, arg_max(name, (quality, -len(name), name)) AS best_quality, arg_min(name, (ece, name)) AS best_ece FROM candidates GROUP BY 1".replace("(quality, -len(name), name)", "quality"),
    ("candidates",),
)
def best_arms(spark, sf):
    """The best candidate of every class by each metric, the first on ties."""
    c = D.candidates(spark, sf).withColumnRenamed("name", "arm").withColumn("arm_position", F.col("arm"))
    return S.best_arms(c, ["size_class"], {"quality": True, "ece": False})


@query(
    "benchmark_sets",
    f"""SELECT 'shared' AS what, {n('count(*)', 'n')} FROM (SELECT c_custkey FROM customer WHERE c_nationkey < 15 INTERSECT SELECT o_custkey FROM orders)
    UNION ALL SELECT 'left out', {n('count(*)', 'n')} FROM (SELECT c_custkey FROM customer WHERE c_nationkey < 15 EXCEPT SELECT o_custkey FROM orders)
    UNION ALL SELECT 'any', {n('count(*)', 'n')} FROM (SELECT c_custkey FROM customer WHERE c_nationkey < 15 UNION SELECT o_custkey FROM orders)""",
)
def benchmark_sets(spark, sf):
    """Shared, left-out and combined ids of two runs."""
    a = D.table(spark, sf, "customer").where("c_nationkey < 15").select(F.col("c_custkey").alias("id"))
    b = D.table(spark, sf, "orders").select(F.col("o_custkey").alias("id"))
    parts = [("shared", a.intersect(b)), ("left out", a.distinct().join(b, "id", "left_anti")), ("any", a.union(b).distinct())]
    out = None
    for name, ids in parts:
        row = ids.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("what"), "n")
        out = row if out is None else out.unionByName(row)
    return out
