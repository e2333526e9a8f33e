from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.operators import calibration as C
from plumbline.operators import crossfit as X


def simulated(spark, n=3000, k=4, temperature=2.0, bias=None, seed=5):
    """Answers whose true distribution is softmax(z / T + bias)."""
    rng = np.random.default_rng(seed)
    z = rng.normal(0, 2, (n, k))
    s = z / temperature + (0 if bias is None else np.asarray(bias))
    p = np.exp(s - s.max(1, keepdims=True))
    p /= p.sum(1, keepdims=True)
    gold = (p.cumsum(1) < rng.uniform(size=(n, 1))).sum(1).clip(0, k - 1)
    q = np.exp(z - z.max(1, keepdims=True))
    q /= q.sum(1, keepdims=True)
    rows = [("s", f"b{i % 2}", f"sig{i % 3}", f"i{i}", f"q{i}", i % 5, q[i].tolist(), int(gold[i])) for i in range(n)]
    schema = "system string, benchmark string, signature string, item_id string, question_id string, fold int, probs array<double>, gold_idx int"
    return spark.createDataFrame(rows, schema).repartition(4), z - z.max(1, keepdims=True), gold


def nll(z, gold, t):
    s = z / t
    return np.mean(np.log(np.exp(s).sum(1)) - s[np.arange(len(z)), gold])


def test_temperature_is_the_out_of_fold_optimum(spark):
    items, _, _ = simulated(spark)
    rows = C.training_rows(items, ["system"])
    fits = {r["target"]: r for r in C.fit_temperature(rows, ["system"]).collect()}
    pdf = rows.toPandas()
    z, gold, fold = np.stack(pdf["z"]), pdf["gold_idx"].to_numpy(), pdf["fold"].to_numpy()
    assert set(fits) == {0, 1, 2, 3, 4}
    for f, fit in fits.items():
        used = fold != f
        assert fit["n_train"] == used.sum()
        t = fit["temperature"]
        assert t == pytest.approx(2.0, rel=0.12)
        best = nll(z[used], gold[used], t)
        assert best <= min(nll(z[used], gold[used], t * 1.003), nll(z[used], gold[used], t / 1.003))


def test_rows_without_an_optimum_stop(spark):
    rows = [("s", 0, [0.0, -1.0], 0)] * 40
    df = spark.createDataFrame(rows, "system string, fold int, z array<double>, gold_idx int")
    assert C.T_MIN <= C.fit_temperature(df, ["system"], None).first()["temperature"] < 0.1
    wrong = df.withColumn("gold_idx", F.lit(1))
    assert C.fit_temperature(wrong, ["system"], None).first()["temperature"] == pytest.approx(C.T_MAX, rel=1e-6)


def test_no_row_trains_its_own_fold(spark):
    items, _, _ = simulated(spark, 600)
    rows = C.training_rows(items, ["system"])
    changed = rows.withColumn("gold_idx", F.when(F.col("fold") == 2, (F.col("gold_idx") + 1) % 4).otherwise(F.col("gold_idx")))
    for fit in (C.fit_temperature, C.fit_platt):
        before = {r["target"]: r for r in fit(rows, ["system"]).collect()}
        after = {r["target"]: r for r in fit(changed, ["system"]).collect()}
        value = "temperature" if fit is C.fit_temperature else "a"
        assert before[2][value] == pytest.approx(after[2][value], rel=1e-6)
        assert before[0][value] != pytest.approx(after[0][value], rel=1e-3)


def test_vector_recovers_a_key_bias(spark):
    bias = [0.8, -0.2, -0.6, 0.0]
    items, _, _ = simulated(spark, 6000, bias=bias)
    got = C.fit_vector(C.training_rows(items, ["system"]), ["system"], None).first()
    assert got["temperature"] == pytest.approx(2.0, rel=0.1)
    assert np.allclose(got["bias"], bias, atol=0.15) and sum(got["bias"]) == pytest.approx(0, abs=1e-9)


def test_platt_gradient_vanishes(spark):
    items, _, _ = simulated(spark, 1500, k=2)
    rows = C.training_rows(items, ["system"])
    fit = C.fit_platt(rows, ["system"], None).first()
    pdf = rows.toPandas()
    z = np.stack(pdf["z"])
    s, hit = np.clip(z[:, 0] - z[:, 1], -30, 30), pdf["gold_idx"].to_numpy() == 0
    n, pos = len(hit), hit.sum()
    target = np.where(hit, (pos + 1) / (pos + 2), 1 / (n - pos + 2))
    g = 1 / (1 + np.exp(-(fit["a"] * s + fit["b"]))) - target
    assert abs((g * s).mean()) < 1e-6 and abs(g.mean()) < 1e-6


def brute_isotonic(x, y):
    xs, inverse, counts = np.unique(x, return_inverse=True, return_counts=True)
    m = np.bincount(inverse, weights=y) / counts
    blocks = []
    for v, w in zip(m, counts, strict=True):
        blocks.append([v, w, 1])
        while len(blocks) > 1 and blocks[-2][0] > blocks[-1][0]:
            b, a = blocks.pop(), blocks.pop()
            blocks.append([(a[0] * a[1] + b[0] * b[1]) / (a[1] + b[1]), a[1] + b[1], a[2] + b[2]])
    return xs, np.repeat([b[0] for b in blocks], [b[2] for b in blocks])


def test_isotonic_matches_pooling_and_interpolation(spark):
    items, _, _ = simulated(spark, 1200)
    items = items.withColumn("probs", F.transform("probs", lambda x: F.round(x, 2) + 0.001))
    rows = C.training_rows(items, ["system"])
    blocks = C.fit_isotonic(rows, ["system"])
    top = C._top_rows(rows, ["system"]).toPandas()
    lookup = C.isotonic_lookup(blocks, ["system"])
    conf = spark.createDataFrame([(float(x),) for x in np.linspace(0.26, 0.999, 60)], "conf double").withColumn("cell", C._cell(F.col("conf")))
    for f in range(2):
        own = top[top.fold != f]
        xs, fitted = brute_isotonic(own["conf"].to_numpy(), own["hit"].to_numpy())
        got = conf.join(lookup.where(F.col("target") == f), "cell").withColumn("v", C.isotonic_value(F.col("conf"), F.col("segments"))).toPandas()
        assert len(got) == 60
        assert np.allclose(got["v"], np.interp(got["conf"], xs, fitted), atol=1e-9)


def test_histogram_edges_are_data_values(spark):
    items, _, _ = simulated(spark, 900)
    items = items.withColumn("probs", F.transform("probs", lambda x: F.round(x, 1) + 0.001))
    rows = C.training_rows(items, ["system"])
    fit = C.fit_histogram(rows, ["system"], None).first()
    top = C._top_rows(rows, ["system"]).toPandas()
    edges = np.unique(np.quantile(top["conf"], np.arange(1, 10) / 10, method="inverted_cdf"))
    edges = edges[edges < top["conf"].max()]
    assert np.allclose(fit["edges"], edges, atol=0)
    bins = np.searchsorted(edges, top["conf"], side="left")
    assert np.allclose(fit["values"], [top["hit"][bins == b].mean() for b in range(len(edges) + 1)])


def test_arms_cover_every_item_once_and_fall_back(spark):
    items, _, _ = simulated(spark, 600)
    rare = F.when(F.col("item_id").isin("i1", "i2", "i3", "i4", "i10"), "rare").otherwise(F.col("signature"))
    items = items.withColumn("signature", rare)
    predictions, fits = X.crossfit(items)
    counts = predictions.groupBy("arm").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("item_id").alias("d"), F.max(F.abs(F.aggregate("probs", F.lit(0.0), lambda a, x: a + x) - 1)).alias("off"))
    got = {r["arm"]: r for r in counts.collect()}
    assert set(got) == set(X.DEFAULT_ARMS)
    assert all(r["n"] == r["d"] == 600 and r["off"] < 1e-9 for r in got.values())
    rare_fits = fits.where("grp = 'rare' AND arm = 'platt@signature'").collect()
    assert rare_fits and all(r["fallback"] and r["temperature"] is not None for r in rare_fits)
    both = predictions.where("item_id = 'i1'").toPandas().set_index("arm")["probs"]
    assert np.allclose(both["platt@signature"], both["temperature@global"])


def test_fold_assignment_keeps_questions_together(spark):
    rows = [("m", f"q{q}", f"s{q % 3}", f"q{q}:{p}") for q in range(22) for p in range(2)]
    df = spark.createDataFrame(rows, "benchmark string, question_id string, stratum string, item_id string")
    folds = {r["question_id"]: r["fold"] for r in C.assign_folds(df).collect()}
    assert len(folds) == 22 and folds == {r["question_id"]: r["fold"] for r in C.assign_folds(df.orderBy(F.rand(2))).collect()}
    sizes = np.bincount(list(folds.values()), minlength=5)
    assert sizes.max() - sizes.min() <= 1


def test_unknown_arms_are_refused():
    assert X.read_arms(["platt", "vector@benchmark"]) == [("platt", "global"), ("vector", "benchmark")]
    for name in ("magic@global", "platt@planet"):
        with pytest.raises(ValueError, match="no such arms"):
            X.read_arms([name])


def test_vector_scaling_over_unequal_numbers_of_keys(spark):
    rng = np.random.default_rng(3)
    rows = []
    for i in range(300):
        k = 3 if i % 2 else 5
        p = rng.dirichlet(np.ones(k))
        rows.append(("s", f"b{i % 2}", f"k{k}", f"i{i}", f"q{i}", i % 5, p.tolist(), int(rng.choice(k, p=p))))
    items = spark.createDataFrame(rows, "system string, benchmark string, signature string, item_id string, question_id string, fold int, probs array<double>, gold_idx int")
    got, _ = X.crossfit(items, ["vector@global", "vector@signature"])
    out = got.collect()
    assert len(out) == 600
    for r in out:
        assert len(r["probs"]) == (3 if int(r["item_id"][1:]) % 2 else 5) and abs(sum(r["probs"]) - 1) < 1e-9 and all(x is not None for x in r["probs"])
