from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.operators import bootstrap as B


def test_weights_are_poisson_and_independent():
    rng = np.random.default_rng(0)
    a, b = rng.integers(0, B.MODULUS, 4000), rng.integers(0, B.MODULUS, 4000)
    w = B.replicate_weights(a, b, 0, 200)
    assert w.mean() == pytest.approx(1.0, abs=0.01) and w.var() == pytest.approx(1.0, abs=0.02)
    assert abs(np.corrcoef(w)[np.triu_indices(200, 1)]).max() < 0.1
    assert (B.replicate_weights(a, b, 57, 3) == w[57:60]).all()


def paired(spark, n=2000):
    rng = np.random.default_rng(1)
    rows = [("b", f"q{i // 2}", f"i{i}", float(rng.normal(0.1, 1.0))) for i in range(n)]
    return spark.createDataFrame(rows, "benchmark string, question_id string, item_id string, d double")


def test_interval_matches_the_normal_one(spark):
    df = paired(spark)
    got = B.bootstrap_intervals(df, ["benchmark"], ["benchmark", "item_id"], ["d"], 2000).first()
    x = df.toPandas()["d"]
    half = 1.96 * x.std() / np.sqrt(len(x))
    assert got["d"] == pytest.approx(x.mean())
    assert got["high_d"] - got["low_d"] == pytest.approx(2 * half, rel=0.08)


def test_opposite_pairs_in_a_cluster_cancel(spark):
    rows = [("b", f"q{i // 2}", 1.0 if i % 2 else -1.0) for i in range(80)]
    df = spark.createDataFrame(rows, "benchmark string, question_id string, d double")
    got = B.bootstrap_intervals(df, ["benchmark"], ["benchmark", "question_id"], ["d"], 300).first()
    assert got["low_d"] == 0 and got["high_d"] == 0
    assert B.bca_intervals(df, ["benchmark"], ["benchmark", "question_id"], "d", 300).first()["low"] == 0


def test_series_share_their_resamples(spark):
    df = paired(spark, 400).withColumn("system", F.explode(F.array(F.lit("x"), F.lit("y"))))
    df = df.withColumn("d", F.when(F.col("system") == "y", F.col("d") + 1).otherwise(F.col("d")))
    means = B.replicate_means(B.bootstrap_sums(df, ["system", "benchmark"], ["benchmark", "question_id"], ["d"], 100), ["d"])
    deltas = B.replicate_deltas(means, ["benchmark"], "system", "x", ["d"]).select("m_d").toPandas()["m_d"]
    assert np.allclose(deltas, 1.0)


def test_bca_reduces_to_percentile_below_the_threshold(spark):
    df = paired(spark, 300)
    low = B.bca_intervals(df, ["benchmark"], ["benchmark", "question_id"], "d", 400).first()
    pct = B.bootstrap_intervals(df, ["benchmark"], ["benchmark", "question_id"], ["d"], 400).first()
    assert low["method"] == "percentile" and low["low"] == pytest.approx(pct["low_d"]) and low["high"] == pytest.approx(pct["high_d"])
    bca = B.bca_intervals(df, ["benchmark"], ["benchmark", "question_id"], "d", 400, min_clusters=10).first()
    assert bca["method"] == "bca" and bca["low"] < bca["estimate"] < bca["high"]


def test_bca_is_the_default_from_500_clusters(spark):
    small, large = paired(spark, 499), paired(spark, 500)
    run = lambda df: B.bootstrap_intervals(df, ["benchmark"], ["benchmark", "item_id"], ["d"], 400).first()
    direct = B.bca_intervals(large, ["benchmark"], ["benchmark", "item_id"], "d", 400, min_clusters=10).first()
    got = run(large)
    assert direct["n_clusters"] >= 500 and (got["low_d"], got["high_d"]) == (direct["low"], direct["high"])
    percentile = B.bca_intervals(small, ["benchmark"], ["benchmark", "item_id"], "d", 400, min_clusters=10**9).first()
    few = run(small.limit(499))
    assert percentile["method"] == "percentile" and few["low_d"] <= few["d"] <= few["high_d"]


@pytest.mark.parametrize(("a", "b", "p"), [(1, 5, 14 / 64), (3, 3, 1.0), (0, 0, 1.0), (0, 10, 2 / 1024)])
def test_mcnemar(spark, a, b, p):
    rows = [("g", True, False)] * a + [("g", False, True)] * b + [("g", True, True)] * 4
    df = spark.createDataFrame(rows, "g string, x boolean, y boolean")
    got = B.mcnemar(df, ["g"], "x", "y").first()
    assert (got["only_a"], got["only_b"]) == (a, b) and got["p_value"] == pytest.approx(p)


def test_mcnemar_with_many_pairs(spark):
    df = spark.createDataFrame([(5_000_000, 5_004_000)], "only_a long, only_b long")
    p = df.select(B._mcnemar_p("only_a", "only_b").alias("p")).first()["p"]
    from statistics import NormalDist

    z = (4000 - 1) / np.sqrt(10_004_000)
    assert p == pytest.approx(2 * NormalDist().cdf(-z), rel=1e-3)


def test_draws_are_dealt_by_clusters_and_rows_read_once(spark, monkeypatch, capsys):
    df = spark.range(400).select(
        F.lit("a").alias("system"), F.lit("x").alias("benchmark"), F.col("id").cast("string").alias("question_id"), (F.col("id") % 3).alias("d")
    )
    groups, cluster = ["system", "benchmark"], ["benchmark", "question_id"]
    read = lambda: [(r["r"], r["w"], r["s_d"]) for r in B.bootstrap_sums(df, groups, cluster, ["d"], 20).orderBy("r").collect()]
    whole = read()
    monkeypatch.setattr(B, "TASK_CLUSTERS", 30)
    B.bootstrap_sums(df, groups, cluster, ["d"], 20).explain()
    assert "REPARTITION_BY_NUM" in capsys.readouterr().out and read() == whole
    calls, own = [], B.cluster_sums
    monkeypatch.setattr(B, "cluster_sums", lambda *a: calls.append(a) or own(*a))
    assert B.bca_intervals(df, groups, cluster, "d", 20).count() == 1 and len(calls) == 1


@pytest.mark.parametrize(("n", "resamples"), [(3000, 10_000), (500, 37), (500, 1), (2000, 997)])
def test_strided_sums_are_those_of_drawn_weights(n, resamples):
    rng = np.random.default_rng(2)
    a, b = rng.integers(0, B.MODULUS, n), rng.integers(0, B.MODULUS, n)
    b[:8] = [0, 1, 2, B.MODULUS - 1, B.MODULUS // 2, B.MODULUS // 3, B.POISSON_STEPS[0], B.POISSON_STEPS[-1]]
    a[6:11] = [0, B.MODULUS - 1, B.POISSON_STEPS[0], B.POISSON_STEPS[0] - 1, B.POISSON_STEPS[-1]]
    x = np.column_stack([rng.integers(1, 9, n), rng.normal(size=n)]).astype(float)
    want = np.concatenate([B.replicate_weights(a, b, r, min(100, resamples - r)) @ x for r in range(0, resamples, 100)])
    got = B.strided_sums(a, b, x, resamples)
    assert (got[:, 0] == want[:, 0]).all() and np.allclose(got, want, rtol=0, atol=1e-9)


def test_few_weights_are_drawn_where_clusters_are_many(monkeypatch):
    rng = np.random.default_rng(3)
    n = B.STRIDE_CLUSTERS
    drawn, own = [], B.replicate_weights
    monkeypatch.setattr(B, "replicate_weights", lambda a, b, r, size: drawn.append(len(a) * size) or own(a, b, r, size))
    sums = B.weighted_sums(rng.integers(0, B.MODULUS, n), rng.integers(0, B.MODULUS, n), np.ones((n, 1)), B.DEFAULT_RESAMPLES)
    assert sum(drawn) < n * B.DEFAULT_RESAMPLES / 10
    assert sums.mean() == pytest.approx(n, rel=1e-3) and sums.var() == pytest.approx(n, rel=0.1)


def test_moments_and_means_of_rows_read_once(spark, monkeypatch):
    rows = [(s, f"b{i % 2}" if i % 7 else None, f"i{i // 2}", float(i % 5), None if i % 11 == 0 else float(i)) for i in range(300) for s in "xy"]
    df = spark.createDataFrame([*rows, ("z", "b0", "lone", 1.0, 2.0)], "system string, benchmark string, item_id string, u double, v double")
    groups, cluster, values = ["system", "benchmark"], ["benchmark", "item_id"], ["u", "v"]
    told = lambda d: {(r["system"], r["benchmark"]): r.asDict() for r in d.collect()}
    whole = B.bootstrap_sums(df.drop("v"), groups, cluster, ["u"], 30)
    strata = told(B.stratum_moments(B.cluster_sums(df, groups, cluster, values), groups, values))
    written, own = [], B.checkpoint
    monkeypatch.setattr(B, "checkpoint", lambda d: written.append(d.columns) or own(d))
    moments, means = B.strata_and_means(df, groups, cluster, values, 30)
    assert not any("item_id" in columns for columns in written)
    got = told(moments)
    assert set(got) == {*strata, ("x", None), ("y", None)}
    for key, row in strata.items():
        assert [got[key][c] for c in row if c not in groups] == pytest.approx([row[c] for c in row if c not in groups], rel=1e-9, abs=1e-15)
    read = lambda d: sorted(((str(r["system"]), str(r["benchmark"]), r["r"]), r["w"], r["s_u"]) for r in d.collect())
    assert read(means) == read(whole) and len(read(whole)) == 7 * 30
