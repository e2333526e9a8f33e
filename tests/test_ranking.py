from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.operators import ranking as R
from plumbline.operators import sampling as P
from plumbline.operators import summaries as S


@pytest.fixture(scope="module")
def skewed(spark):
    """A group with most rows, mostly one value, beside two small ones."""
    rng = np.random.default_rng(3)
    rows = []
    for i in range(3000):
        group = "hot" if i % 10 else ("a" if i % 20 else "b")
        value = 0.5 if i % 3 else float(rng.uniform())
        rows.append((group, f"i{i}", value, int(rng.uniform() < value)))
    return spark.createDataFrame(rows, "g string, item string, v double, hit int").repartition(7)


def test_rank_equals_sorting(skewed):
    ranked = R.with_rank(skewed, ["g"], ["v", "item"]).toPandas()
    expected = skewed.toPandas().sort_values(["g", "v", "item"])
    for g, part in expected.groupby("g"):
        ours = ranked[ranked.g == g].sort_values("rank")
        assert ours["rank"].tolist() == list(range(1, len(part) + 1))
        assert ours["item"].tolist() == part["item"].tolist()
        assert set(ours["group_size"]) == {len(part)}


def test_rank_without_groups(skewed):
    ranked = R.with_rank(skewed, [], ["v", "item"]).toPandas().sort_values("rank")
    assert ranked["rank"].tolist() == list(range(1, 3001)) and ranked["v"].is_monotonic_increasing


def test_prefix_sums(skewed):
    got = R.with_prefix_sums(skewed, ["g"], ["v", "item"], ["hit"]).toPandas().sort_values(["g", "v", "item"])
    assert (got.groupby("g")["hit"].cumsum() == got["cum_hit"]).all()
    assert (got.groupby("g")["hit"].transform("sum") == got["total_hit"]).all()


@pytest.mark.parametrize("bins", [1, 7, 10, 64])
def test_bins_match_array_split(spark, bins):
    n = 23
    df = spark.range(1, n + 1).select(F.col("id").alias("rank")).withColumn("b", R.split_bin(F.col("rank"), F.lit(n), bins))
    sizes = [len(x) for x in np.array_split(np.arange(n), bins) if len(x)]
    assert [r["count"] for r in df.groupBy("b").count().orderBy("b").collect()] == sizes


def test_quantiles_match_numpy(skewed):
    got = {r["g"]: r for r in R.exact_quantiles(skewed, ["g"], "v", {"p05": 0.05, "p50": 0.5, "p95": 0.95}).collect()}
    nearest = {r["g"]: r for r in R.exact_quantiles(skewed, ["g"], "v", {"q": 0.3}, "nearest").collect()}
    for g, part in skewed.toPandas().groupby("g"):
        for name, q in (("p05", 0.05), ("p50", 0.5), ("p95", 0.95)):
            assert got[g][name] == pytest.approx(np.quantile(part["v"], q), abs=1e-12)
        assert nearest[g]["q"] == np.quantile(part["v"], 0.3, method="inverted_cdf")


def test_top_n(skewed):
    got = R.top_n_per_group(skewed, ["g"], ["v", "item"], 5, salts=4).toPandas()
    for g, part in skewed.toPandas().groupby("g"):
        assert got[got.g == g].sort_values("rank")["item"].tolist() == part.sort_values(["v", "item"])["item"].head(5).tolist()


def test_ece_hand_cases(spark):
    rows = [(0.95, 1), (0.95, 0), (0.65, 1), (0.62, 1), (0.15, 0)]
    df = spark.createDataFrame([("x", f"i{k}", c, h) for k, (c, h) in enumerate(rows)], "g string, item_id string, confidence double, correct int")
    width = S.ece_equal_width(df, ["g"]).first()["ece"]
    assert width == pytest.approx((2 * 0.45 + 2 * 0.365 + 0.15) / 5)
    mass = spark.createDataFrame(
        [("x", f"i{k}", c, h) for k, (c, h) in enumerate([(0.1, 0), (0.2, 0), (0.3, 1), (0.8, 1), (0.9, 1)])], "g string, item_id string, confidence double, correct int"
    )
    bins = S.reliability(mass, ["g"], bins=2).orderBy("bin").collect()
    assert [b["n"] for b in bins] == [3, 2]
    assert S.ece_equal_mass(mass, ["g"], bins=2).first()["ece"] == pytest.approx((3 * abs(1 / 3 - 0.2) + 2 * abs(1 - 0.85)) / 5)


def test_weighted_ece_is_the_expanded_samples(spark, skewed):
    weighted = skewed.withColumn("w", F.pmod(F.xxhash64("item"), F.lit(4)))
    ours = {r["g"]: r["ece"] for r in S.weighted_ece(weighted, ["g"], "w", conf="v", correct="hit", item="item").collect()}
    from plumbline.functions.hashing import tie_key

    pdf = weighted.withColumn("tie", tie_key(F.col("item"))).toPandas()
    for g, part in pdf.groupby("g"):
        part = part.sort_values(["v", "tie"])
        conf, hit = np.repeat(part["v"].to_numpy(), part["w"]), np.repeat(part["hit"].to_numpy(), part["w"])
        want = sum(abs(hit[i].sum() - conf[i].sum()) for i in np.array_split(np.arange(len(conf)), 10)) / len(conf)
        assert ours[g] == pytest.approx(want, abs=1e-9)


def test_halves_are_exact_and_order_free(spark):
    rows = [("m", f"q{i}", f"s{i % 3}") for i in range(37)]
    df = spark.createDataFrame(rows, "benchmark string, question_id string, stratum string")
    half = {r["question_id"]: r["half"] for r in P.split_halves(df).collect()}
    again = {r["question_id"]: r["half"] for r in P.split_halves(df.orderBy(F.rand(1))).collect()}
    assert half == again
    assert abs(sum(h == "select" for h in half.values()) * 2 - 37) <= 1
    for s in range(3):
        own = [half[f"q{i}"] for i in range(37) if i % 3 == s]
        assert abs(own.count("select") * 2 - len(own)) <= 1


def test_screen_has_the_asked_size(spark):
    rows = [("m", f"q{i}", f"s{min(i % 7, 3)}") for i in range(400)]
    df = spark.createDataFrame(rows, "benchmark string, question_id string, stratum string")
    assert P.screen_split(df, 41).count() == 41
    assert P.screen_split(df, 1000).count() == P.split_halves(df).where("half = 'select'").count()


@pytest.mark.parametrize(("cells", "digits", "sorted_rows", "cuts"), [(4096, 3, 1 << 18, 4), (16, 1, 20, 4), (16, 1, 0, 6), (16, 1, 20, 1)])
def test_bins_added_up_in_cells_are_those_of_sorted_rows(spark, monkeypatch, cells, digits, sorted_rows, cuts):
    odd = (None, float("nan"), float("inf"), float("-inf"), 0.5, -3.0, 7.0, 0.25)
    rows = [("few", "x", 0.5, True), ("few", "y", 0.6, False)]
    for i in range(900):
        hit = bool(i * 7919 % 5 < 2)
        rows += [
            ("ties", f"i{i}", i % 4 / 4, hit), ("spread", f"i{i}", (i * 0.6180339887) % 1, hit), ("one", f"i{i}", 0.7, hit),
            ("high", f"i{i}", 1.0 if i % 3 else 1 - i * 1e-9, hit), ("odd", f"i{i}", odd[i % 8], None if i % 5 == 0 else hit),
            ("unnamed", None if i % 4 == 0 else f"i{i}", 0.7 if i % 2 else None, i % 4 == 0),
        ]
    df = spark.createDataFrame(rows, "g string, item_id string, confidence double, correct boolean").cache()
    names = ["g", "bin", "n", "confidence_low", "confidence_high", "mean_confidence", "accuracy"]
    told = lambda d: {(r["g"], r["bin"]): [r[c] for c in names[2:]] for r in d.collect()}
    want = told(S.reliability(df, ["g"], 7))
    for name, value in (("CELLS", cells), ("TIE_DIGITS", digits), ("SORTED_ROWS", sorted_rows), ("MOST_CUTS", cuts)):
        monkeypatch.setattr(R, name, value)
    got = told(S.reliability_of_many(df, ["g"], 7))
    assert set(got) == set(want) and len(want) == 6 * 7 + 2
    for key, row in want.items():
        assert [x is None for x in got[key]] == [x is None for x in row]
        assert [x for x in got[key] if x is not None] == pytest.approx([x for x in row if x is not None], rel=1e-12, nan_ok=True)


def test_many_scores_are_summarized_without_sorting_them_all(spark, monkeypatch):
    df = spark.range(3000).select(
        F.lit("a").alias("system"), F.lit("x").alias("benchmark"), F.col("id").cast("string").alias("item_id"), (F.col("id") % 3 == 0).alias("correct"),
        F.lit(False).alias("abstained"), *[(F.col("id") % 100 / 100).alias(c) for c in ("p_gold", "nll", "brier", "confidence")],
        F.lit(None).cast("double").alias("abs_error"), F.lit(None).cast("boolean").alias("within_one"), F.lit(None).cast("int").alias("idk_idx"),
    )
    told = lambda: [S.benchmark_summary(df).first()[c] for c in ("n", "accuracy", "nll", "ece")]
    want = told()
    placed, own = [], R.sorted_once
    monkeypatch.setattr(R, "sorted_once", lambda d, keys: placed.append(d.count()) or own(d, keys))
    monkeypatch.setattr(S, "MANY", 1000, raising=False)
    assert told() == pytest.approx(want)
    assert sum(placed) < 1000
