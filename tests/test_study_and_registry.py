"""Intervals of means, macro averages and paired differences, replicate calibration errors, registries."""

from __future__ import annotations

import math
from statistics import NormalDist

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.functions import vectors as V
from plumbline.operators import bootstrap as B
from plumbline.operators import calibration as C
from plumbline.operators import crossfit as X
from plumbline.plans import study as P

CLUSTER = ["benchmark", "question_id"]


def drawn(seed, n, benchmarks=2, systems=("a", "b")):
    rng = np.random.default_rng(seed)
    rows = []
    for i in range(n):
        for s in systems:
            rows.append((s, f"b{i % benchmarks}", f"q{i // 3}", f"i{i}", float(rng.normal(0.2 if s == "a" else 0.0, 1.0 + (i % 5))), bool(rng.random() < 0.6), float(np.round(rng.random(), 2))))
    return rows


SCHEMA = "system string, benchmark string, question_id string, item_id string, x double, correct boolean, confidence double"


def plain_moments(values, clusters):
    sums, sizes = {}, {}
    for v, c in zip(values, clusters):
        sums[c] = sums.get(c, 0.0) + v
        sizes[c] = sizes.get(c, 0) + 1
    s, m = np.array(list(sums.values())), np.array(list(sizes.values()), float)
    jack = (s.sum() - s) / (m.sum() - m)
    away = jack.mean() - jack
    return len(s), s.sum() / m.sum(), (away**2).sum(), (away**3).sum()


def plain_bca(boot, estimate, second, third, alpha=0.025):
    normal, b = NormalDist(), len(boot)
    z0 = normal.inv_cdf(min(max(float(np.mean(boot < estimate)), 0.5 / b), 1 - 0.5 / b))
    a = third / (6 * second**1.5) if second > 0 else 0.0
    return [np.quantile(boot, normal.cdf(z0 + (z0 + z) / (1 - a * (z0 + z)))) for z in (normal.inv_cdf(alpha), normal.inv_cdf(1 - alpha))]


def test_paired_and_macro_ends_are_those_of_plain_code(spark):
    rows = drawn(3, 240)
    df = spark.createDataFrame(rows, SCHEMA)
    groups = ["system", "benchmark"]
    means = B.replicate_means(B.bootstrap_sums(df, groups, CLUSTER, ["x"], 300), ["x"]).cache()
    strata = B.stratum_moments(B.paired_sums(B.cluster_sums(df, groups, CLUSTER, ["x"]), ["benchmark"], "system", "a", CLUSTER, ["x"]), groups, ["x"])
    moments = strata.unionByName(B.macro_moments(strata, ["system"], ["x"]).withColumn("benchmark", F.lit("macro")))
    deltas = B.replicate_deltas(means, ["benchmark"], "system", "a", ["x"])
    both = deltas.select(*groups, "r", "m_x").unionByName(B.macro_replicates(deltas, ["system"], ["x"]).withColumn("benchmark", F.lit("macro")).select(*groups, "r", "m_x"))
    got = {r["benchmark"]: r for r in B.bounds(moments, both, groups, ["x"], min_clusters=10).collect()}
    boots = {b: np.array([r["m_x"] for r in both.where(F.col("benchmark") == b).orderBy("r").collect()]) for b in got}
    per = {}
    for b in ("b0", "b1"):
        own = [(r[4], r[2]) for r in rows if r[0] == "b" and r[1] == b]
        base = [r[4] for r in rows if r[0] == "a" and r[1] == b]
        per[b] = plain_moments([v - w for (v, _), w in zip(own, base)], [q for _, q in own])
    per["macro"] = (sum(p[0] for p in per.values()), np.mean([p[1] for p in per.values()]), sum(p[2] for p in per.values()) / 4, sum(p[3] for p in per.values()) / 8)
    for b, (k, estimate, second, third) in per.items():
        assert got[b]["n_clusters"] == k and got[b]["method"] == "bca"
        assert [got[b]["low_x"], got[b]["high_x"]] == pytest.approx(plain_bca(boots[b], estimate, second, third), abs=1e-9)


def test_a_lone_cluster_has_no_spread(spark):
    df = spark.createDataFrame([("a", "b0", "q", "i", 1.0, True, 0.5), ("a", "b0", "q", "j", 3.0, True, 0.5)], SCHEMA)
    got = B.stratum_moments(B.cluster_sums(df, ["system", "benchmark"], CLUSTER, ["x"]), ["system", "benchmark"], ["x"]).first()
    assert (got["n_clusters"], got["estimate_x"], got["second_x"], got["third_x"]) == (1, 2.0, 0.0, 0.0)


def plain_ece(conf, hit, weights, bins):
    """Equal-mass error of a sample that holds item i weights[i] times, expanded."""
    c, h = np.repeat(conf, weights), np.repeat(hit, weights)
    total = sum(abs(h[p].sum() - c[p].sum()) for p in np.array_split(np.arange(len(c)), bins) if len(p))
    return total / len(c)


@pytest.mark.parametrize("chunk", [1024, 7])
def test_replicate_calibration_errors_of_streamed_ranges(spark, monkeypatch, chunk):
    monkeypatch.setattr(B, "CHUNK_ROWS", chunk)
    df = spark.createDataFrame(drawn(5, 160, 1, ("a",)), SCHEMA)
    got = {r["r"]: r["ece"] for r in B.ece_replicates(df, ["system", "benchmark"], CLUSTER, 40, bins=7).collect()}
    from plumbline.functions.hashing import tie_key

    rows = B.with_seeds(df, CLUSTER, 0).withColumn("_tie", tie_key(F.col("item_id"))).orderBy("confidence", "_tie").collect()
    conf, hit = np.array([r["confidence"] for r in rows]), np.array([float(r["correct"]) for r in rows])
    w = B.replicate_weights(np.array([r["_a"] for r in rows]), np.array([r["_b"] for r in rows]), 0, 40).astype(int)
    assert got == pytest.approx({r: plain_ece(conf, hit, w[r], 7) for r in range(40)})


def study_rows(spark, n=180):
    rng = np.random.default_rng(8)
    rows = []
    for i in range(n):
        for s, sharp in (("a", 1.0), ("b", 2.0)):
            z = rng.normal(size=3) + 1.2 * np.eye(3)[i % 3]
            p = np.exp(sharp * z)
            rows.append((s, f"b{i % 2}", f"i{i}", f"q{i // 2}", str(i % 2), "choice:3:x", ["A", "B", "C"], (p / p.sum()).tolist(), i % 3))
    schema = "system string, benchmark string, item_id string, question_id string, stratum string, signature string, keys array<string>, probs array<double>, gold_idx int"
    return spark.createDataFrame(rows, schema)


def test_study_has_ends_for_every_metric(spark):
    study = P.calibration_study(study_rows(spark), ["temperature@global"], reference="a", n_resamples=120)
    estimates = study.estimates.collect()
    assert {(r["system"], r["arm"], r["benchmark"]) for r in estimates} == {(s, a, b) for s in "ab" for a in ("raw", "temperature@global") for b in ("b0", "b1", "macro")}
    for r in estimates:
        assert r["low_ece"] <= r["high_ece"] and r["method"] == "percentile"
        assert all(r[f"low_{m}"] <= r[m] <= r[f"high_{m}"] for m in ("accuracy", "nll", "brier"))
    deltas = study.deltas.collect()
    assert {(r["against"], r["system"], r["arm"]) for r in deltas} == {("raw", "a", "temperature@global"), ("raw", "b", "temperature@global"), ("reference", "b", "raw"), ("reference", "b", "temperature@global")}
    # Temperature does not change answers, so its accuracy difference has no spread.
    assert all(r["low_accuracy"] == r["high_accuracy"] == 0 and not r["accuracy_excludes_zero"] for r in deltas if r["against"] == "raw")
    assert all(r["low_ece"] <= r["high_ece"] for r in deltas)
    assert {r["converged"] for r in study.fits.collect()} == {True}


def test_comparison_of_some_benchmarks_and_its_table(spark):
    from plumbline.queries.derived import preds

    answers = preds(spark, "/root/testdata/sf0.001")
    got = P.compare(answers, "a", "b", 50, benchmarks=["b0", "b1"])
    assert {r["benchmark"] for r in got.collect()} == {"b0", "b1", "macro"}
    lines = P.comparison_markdown(got).splitlines()
    assert lines[0].startswith("| Benchmark | Items |") and [x.split(" | ")[0] for x in lines[2:]] == ["| b0", "| b1", "| macro"]


def test_unsettled_fits_are_marked(spark):
    start = spark.createDataFrame([("x", 1.0)], "k string, moved double")
    with pytest.warns(UserWarning, match="1 of 1 fits"):
        state = C._iterate(start, lambda s, small: s, 2, 1e-6)
    assert state.first()["converged"] is False


def fitted(spark, name, rows):
    df = spark.createDataFrame(rows, "signature string, probs array<double>, gold_idx int")
    return X.fit_registry(df, "api", "m", "t", name, min_group=5)


def test_a_registry_of_five_calibrators(spark):
    rng = np.random.default_rng(4)
    vectors = [(rng.dirichlet([1.0, 1.0, 1.0])).tolist() for _ in range(60)]
    rows = {k: [(k, p, int(np.argmax(p)) if i % 3 else (int(np.argmax(p)) + 1) % 3) for i, p in enumerate(vectors)] for k in ("temperature", "vector", "platt", "isotonic", "histogram")}
    exact, general = [], None
    for name, own in rows.items():
        fit, general = fitted(spark, name, own)
        exact.append(fit)
    entries, segments = X.registry_tables(exact)
    requests = [("api", "m", "t", k, p) for k in rows for p in vectors[:9]] + [("api", "m", "t", "other", vectors[0]), ("api", "n", "t", "other", [0.2, 0.2, 0.4])]
    schema = "backend string, model string, template_id string, signature string, probs array<double>"
    out = X.apply_registry(spark.createDataFrame(requests, schema), entries, segments, general).collect()
    assert len(out) == len(requests)
    assert {r["calibrator"] for r in out} == {f"{k}:exact" for k in rows} | {"temperature:temperature_fallback", "identity:identity"}
    assert [r["calibrated"] for r in out if r["calibrator"] == "identity:identity"] == [pytest.approx([0.25, 0.25, 0.5])]
    for name in rows:
        # The same as the calibrator applied by itself to its own signature's rows.
        calibrator = X.CALIBRATORS[name]
        fit = exact[list(rows).index(name)].drop("backend", "model", "template_id", "name")
        own = spark.createDataFrame([(name, p) for p in vectors[:9]], "signature string, probs array<double>").withColumn("z", V.centered(V.probs_to_logits(F.col("probs"))))
        want = sorted(tuple(np.round(r["p"], 9)) for r in calibrator.join(own, fit, ["signature"]).select(calibrator.transform(F.col("z")).alias("p")).collect())
        got = sorted(tuple(np.round(r["calibrated"], 9)) for r in out if r["calibrator"] == f"{name}:exact")
        assert got == want and all(math.isclose(sum(p), 1.0, abs_tol=1e-6) for p in got)


def test_a_key_is_registered_once(spark):
    fit, _ = fitted(spark, "temperature", [("s", [0.5, 0.3, 0.2], 0)] * 10)
    with pytest.raises(ValueError, match="more than once"):
        X.registry_tables([fit, fit])
    with pytest.raises(ValueError, match="column 'z'"):
        X.apply_registry(spark.createDataFrame([("x", 1.0)], "backend string, z double"), fit, fit, fit)


def test_sums_that_a_task_passes_on_early_add_up(spark, monkeypatch):
    df = spark.createDataFrame(drawn(6, 90, 5), SCHEMA)
    read = lambda: sorted(tuple(r) for r in B.bootstrap_sums(df, ["system", "benchmark"], CLUSTER, ["x"], 20).select("system", "benchmark", "r", F.round("s_x", 9), "w").collect())
    whole = read()
    monkeypatch.setattr(B, "MOST_SUMS", 1)
    assert read() == whole and len(whole) == 2 * 5 * 20


def test_statistics_as_a_table(spark):
    from plumbline.operators import records as R
    from plumbline.queries import derived as D
    from plumbline.queries.costs_area import prices

    sf = "/root/testdata/sf0.001"
    latest = R.latest_records(D.records(spark, sf)).withColumns(
        {"price_id": F.lit("en"), "cache_write_tokens": F.lit(0).cast("bigint"), "correct": F.col("ok"), "backend_calls": F.lit(2)}
    )
    calls = D.invocations(spark, sf).withColumn("benchmark", F.concat(F.lit("b"), (F.dayofmonth("started") % 4).cast("string")))
    calls = calls.withColumn("system_id", F.concat(F.lit("s"), (F.length("system_id") % 3).cast("string")))
    lines = P.statistics_markdown(P.run_statistics(latest, prices(spark), calls)).splitlines()
    head = [c.strip() for c in lines[0].strip("| ").split("|")]
    assert {"Calls/item", "GPU-h", "In flight", "$ / 1k items"} <= set(head)
    cells = [[c.strip() for c in line.strip().strip("|").split("|")] for line in lines[2:]]
    by = {(r[0], r[1]): dict(zip(head, r)) for r in cells}
    assert [r[1] for r in cells if r[0] == "s0"] == ["b0", "b1", "b2", "b3", "all, macro acc."]
    assert by["s0", "b1"]["Calls/item"] == "2.00" and by["s0", "b1"]["In flight"] == "16" and float(by["s0", "b1"]["GPU-h"]) > 0


def test_a_summary_draws_its_resamples_once(spark, monkeypatch):
    from plumbline.queries import derived

    calls, own = [], B.resampled_sums
    monkeypatch.setattr(B, "resampled_sums", lambda *a: calls.append(a) or own(*a))
    got = P.summarize(derived.preds(spark, "/root/testdata/sf0.001"), n_resamples=20).collect()
    assert len(calls) == 1 and {r["benchmark"] for r in got} == {"b0", "b1", "b2", "b3", "macro"}
