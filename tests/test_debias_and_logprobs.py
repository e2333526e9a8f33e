from __future__ import annotations

import json
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.functions import questions as Q
from plumbline.operators import debias as D
from plumbline.operators import logprobs as L
from plumbline.sources.chatlog import structured_profile, structured_reads, value_positions


def presented(spark, prior, n=40, k=4, seed=0):
    rng = np.random.default_rng(seed)
    rows = []
    for i in range(n):
        content = rng.dirichlet(np.ones(k))
        for s in range(k):
            order = [(p + s) % k for p in range(k)]
            p = np.array([content[o] * prior[j] for j, o in enumerate(order)])
            rows.append((f"i{i}", "key", order, (p / p.sum()).tolist(), [True] * k))
    return spark.createDataFrame(rows, "item_id string, prior_key string, order array<int>, shown_probs array<double>, free array<boolean>")


def test_pride_recovers_the_position_prior(spark):
    prior = [0.4, 0.1, 0.3, 0.2]
    got = D.pride_priors(presented(spark, prior), ["item_id", "prior_key"]).first()
    assert np.allclose(got["prior"], prior) and got["n"] == 40


def test_dividing_by_the_prior_recovers_content(spark):
    prior = [0.4, 0.1, 0.3, 0.2]
    shown = presented(spark, prior, 5)
    own = shown.where("order[0] = 0").withColumn("probs", F.col("shown_probs"))
    priors = D.pride_priors(shown, ["item_id", "prior_key"])
    debiased = D.make_debiaser("pride").apply(own, priors).select("item_id", "debiased").toPandas().set_index("item_id")["debiased"]
    content = np.random.default_rng(0)
    for i in range(5):
        assert np.allclose(debiased[f"i{i}"], content.dirichlet(np.ones(4)))


def test_fixed_options_keep_their_weight(spark):
    row = spark.range(1).select(
        D.divide_by_prior(F.array(*[F.lit(x) for x in (0.5, 0.3, 0.2)]), F.array(F.lit(0.5), F.lit(0.5)), F.array(F.lit(True), F.lit(True), F.lit(False))).alias("p")
    ).first()
    assert np.allclose(row["p"], [0.5, 0.3, 0.2])


def test_debiaser_options():
    assert D.make_debiaser("permutation", max_options="all").max_options is None
    assert D.make_debiaser("pride", alpha="0.1", seed=4) == D.PermutedPrior(alpha=0.1, seed=4)
    assert D.make_debiaser("contextual", content_free="N/A|none").content_free == ("N/A", "none")
    with pytest.raises(ValueError, match="bad parameter"):
        D.make_debiaser("permutation", speed=9)
    with pytest.raises(ValueError, match="unknown debiaser"):
        D.make_debiaser("magic")


@pytest.mark.parametrize("method", ["batch", "pride"])
def test_a_system_is_debiased_alone(spark, method):
    """Another system, or the same item ids in another benchmark, changes nothing."""
    shown = presented(spark, [0.4, 0.1, 0.3, 0.2]).withColumns({"system": F.lit("a"), "benchmark": F.lit("x")})
    other = presented(spark, [0.1, 0.2, 0.3, 0.4], seed=1).withColumns({"system": F.lit("b"), "benchmark": F.lit("x")})
    both = shown.unionByName(other).unionByName(other.withColumn("benchmark", F.lit("y")))

    def items(df):
        fold = F.substring("item_id", 2, 9).cast("int") % 5
        return df.where("order[0] = 0").withColumns({"raw": F.col("shown_probs"), "fold": fold})

    def got(df):
        out = D.debias_offline(items(df), method, df.where("item_id <> 'i3' or order[0] <> 1"), min_batch=1)
        return {r["item_id"]: r["debiased"] for r in out.where("system = 'a'").collect()}, out.count()

    (alone, n), (together, m) = got(shown), got(both)
    assert n == 40 and m == 120 and alone.keys() == together.keys()
    assert all(np.allclose(alone[k], together[k]) for k in alone)
    raw = {r["item_id"]: r["shown_probs"] for r in shown.where("order[0] = 0").collect()}
    assert not np.allclose(together["i5"], raw["i5"])


def test_orders_and_presentations(spark):
    free = F.array(F.lit(True), F.lit(True), F.lit(True), F.lit(False))
    row = spark.range(1).select(
        Q.cyclic_shifts(free).alias("all"), Q.cyclic_shifts(free, 2).alias("two"), Q.shifted_order(free, F.lit(1)).alias("one"),
        Q.present(Q.named_options(F.array(F.lit("x"), F.lit("y"))), F.array(F.lit(1), F.lit(0))).alias("named"),
        Q.present(Q.lettered_options(F.array(F.lit("x"), F.lit("y"))), F.array(F.lit(1), F.lit(0))).alias("lettered"),
        Q.random_orders(free, 4, F.lit("s"), F.lit("q")).alias("random"),
    ).first()
    assert row["all"] == [0, 1, 2] and row["two"] == [0, 2] and row["one"] == [1, 2, 0, 3]
    assert [o["key"] for o in row["named"]] == ["y", "x"]
    assert [(o["key"], o["text"]) for o in row["lettered"]] == [("A", "y"), ("B", "x")]
    assert row["random"][0] == [0, 1, 2, 3] and len({tuple(o) for o in row["random"]}) == 4 and all(o[3] == 3 for o in row["random"])


def test_random_orders_are_all_different(spark):
    for size, n, want in ((6, 720, 720), (6, 1000, 720), (5, 7, 7), (1, 3, 1), (0, 2, 1), (20, 50, 50)):
        free = F.array_repeat(F.lit(True), size) if size else F.array(F.lit(False))
        orders = spark.range(2).select(Q.random_orders(free, n, F.lit("seed"), F.col("id")).alias("o")).collect()
        for r in orders:
            assert len({tuple(o) for o in r["o"]}) == len(r["o"]) == want and all(sorted(o) == list(range(len(o))) for o in r["o"])
            assert list(r["o"][0]) == list(range(len(r["o"][0])))
        assert size < 6 or n > 100 or orders[0]["o"] != orders[1]["o"]


def test_random_orders_move_every_position(spark):
    for size in (19, 32, 77):
        free = F.array_append(F.array_repeat(F.lit(True), size), F.lit(False))
        orders = [list(o) for o in spark.range(1).select(Q.random_orders(free, 12, F.lit("seed"), F.col("id")).alias("o")).first()["o"]]
        assert len({tuple(o) for o in orders}) == 12 and all(sorted(o) == list(range(size + 1)) and o[size] == size for o in orders)
        assert orders[0] == list(range(size + 1)) and all(any(o[i] != i for o in orders) for i in range(size))


def topk(spark, rows):
    return spark.createDataFrame([("r", i + 1, t, float(lp)) for i, (t, lp) in enumerate(rows)], "request_id string, rank int, token string, logprob double")


def test_first_token_read_merges_and_bounds(spark):
    rows = [("A", math.log(0.5)), (" A", math.log(0.2)), ("the", math.log(0.1)), ("B", float("-inf"))]
    labels = L.label_dimension(spark, "letters", 3)
    got = {r["label"]: r for r in L.first_token_read(topk(spark, rows), labels).collect()}
    assert got["A"]["raw"] == pytest.approx(math.log(0.7)) and not got["A"]["missing"]
    assert got["B"]["missing"] and got["B"]["raw"] == pytest.approx(math.log(0.1)) and got["A"]["observed_mass"] == pytest.approx(0.7)
    assert sum(math.exp(r["logprob"]) for r in got.values()) == pytest.approx(1)
    left = {r["label"]: r for r in L.first_token_read(topk(spark, [("A", math.log(0.98)), (" A", math.log(0.01))]), labels, leftover=True).collect()}
    assert left["B"]["raw"] == pytest.approx(math.log(0.01))
    full = {r["label"]: r for r in L.first_token_read(topk(spark, [("A", 0.0)]), labels, leftover=True).collect()}
    assert full["C"]["raw"] == pytest.approx(math.log(2.0**-23))


def test_infinite_scores_take_all_the_mass(spark):
    inf = float("inf")
    row = spark.range(1).select(
        L.renormalized(F.array(F.lit(inf), F.lit(0.0), F.lit(inf))).alias("a"), L.renormalized(F.array(F.lit(-inf), F.lit(-inf))).alias("b"),
        L.clean_logprob(F.lit(-1e38)).alias("c"), L.clean_logprob(F.lit(1e-6)).alias("d"), L.clean_logprob(F.lit(0.5)).alias("e"),
    ).first()
    assert row["a"] == [pytest.approx(-math.log(2)), -inf, pytest.approx(-math.log(2))] and row["b"] is None
    assert row["c"] == -inf and row["d"] == 0.0 and row["e"] is None


def test_trie_probabilities_sum_to_one(spark):
    labels = spark.createDataFrame([(" a", [" a"]), (" ab", [" a", "b"]), (" c", [" c"])], "label string, path array<string>")
    branches = spark.createDataFrame(
        [("r", "", " a", math.log(0.6), False), ("r", "", " c", math.log(0.2), False), ("r", " a", "b", math.log(0.3), True)],
        "request_id string, node string, child string, logprob double, ends boolean",
    )
    got = {r["label"]: math.exp(r["raw"]) for r in L.trie_read(labels, branches).collect()}
    assert got == {" a": pytest.approx(0.75 * 0.7), " ab": pytest.approx(0.75 * 0.3), " c": pytest.approx(0.25)}
    pruned = {r["label"]: r for r in L.trie_read(labels, branches, tau=0.8).collect()}
    assert pruned[" a"]["pruned"] and math.exp(pruned[" ab"]["raw"]) == pytest.approx(0.75)


def test_trie_of_a_real_log(spark):
    """A pruned subtree has no rows, a child may be unlisted, and questions have labels of their own."""
    labels = spark.createDataFrame(
        [("p", " a", [" a"]), ("p", " ab", [" a", "b"]), ("p", " c", [" c"]), ("p", " d", [" d"]), ("q", " x", [" x"]), ("q", " y", [" y"])],
        "question_id string, label string, path array<string>",
    )
    branches = spark.createDataFrame(
        [("r", "p", "", " a", math.log(0.05), False), ("r", "p", "", " c", math.log(0.75), False), ("s", "q", "", " x", math.log(0.5), False)],
        "request_id string, question_id string, node string, child string, logprob double, ends boolean",
    )
    got = {(r["request_id"], r["label"]): r for r in L.trie_read(labels, branches, tau=0.5).collect()}
    assert set(got) == {("r", " a"), ("r", " ab"), ("r", " c"), ("r", " d"), ("s", " x"), ("s", " y")}
    raw = {k: math.exp(r["raw"]) for k, r in got.items()}
    assert raw["r", " a"] == raw["r", " ab"] == pytest.approx(0.05 / 0.8) and got["r", " a"]["pruned"] and got["r", " ab"]["pruned"]
    assert raw["r", " d"] == pytest.approx(0.05) and got["r", " d"]["missing"] and not got["r", " c"]["missing"]
    assert raw["s", " x"] == pytest.approx(1.0) and raw["s", " y"] == pytest.approx(0.5) and got["s", " y"]["missing"]
    for request in "rs":
        assert sum(math.exp(r["logprob"]) for k, r in got.items() if k[0] == request) == pytest.approx(1.0)


def test_scores_far_below_the_range_of_exp(spark):
    s = spark.createDataFrame([("r", "x", [-800.0]), ("r", "y", [-400.0, -401.0])], "request_id string, label string, token_logprobs array<double>")
    total = L.sequence_scores(s).agg(L.log_sum("score").alias("t")).first()["t"]
    assert total == pytest.approx(-800 + math.log(1 + math.exp(-1)))
    null = spark.createDataFrame([("p", "x", [-1.0]), ("q", "x", [-2.0])], "question_id string, label string, token_logprobs array<double>")
    asked = spark.createDataFrame([("r", "p", "x", [-3.0]), ("s", "q", "x", [-3.0]), ("s", "q", "z", [-3.0])], "request_id string, question_id string, label string, token_logprobs array<double>")
    got = {(r["request_id"], r["label"]): r["score"] for r in L.sequence_scores(asked, "pmi", null).collect()}
    assert got == {("r", "x"): -2.0, ("s", "x"): -1.0, ("s", "z"): None}
    with pytest.raises(Exception, match="several content-free scores"):
        L.sequence_scores(asked.drop("question_id"), "pmi", null).collect()


def token(text, lp, top):
    return {"token": text, "logprob": lp, "top_logprobs": [{"token": t, "logprob": x} for t, x in top]}


def test_structured_reply_paths(spark):
    only = lambda t: token(t, 0.0, [(t, 0.0)])
    half, low = math.log(0.5), math.log(0.25)
    replies = {
        "split": [only('{"answer'), token('":"', half, [('":"', half), ('":"A', low)]), token("B", math.log(0.8), [("B", math.log(0.8)), ("A", math.log(0.2))])],
        "joined": [only('{"answer":'), token(' "B"', half, [(' "B"', half), (' "A', low), (' "', low)])],
        "stuck": [only("\n")],
        "short": [only('{"answer":"')],
        "stale": [only('{"answer":"'), token("B", math.log(0.8), [("A", math.log(0.2))])],
        "other": [only('{"answer":"'), token("Z", 0.0, [("Z", 0.0)])],
        "empty": [],
    }
    rows = [(k, json.dumps({"choices": [{"logprobs": {"content": c}}]}), ["A", "B"]) for k, c in replies.items()]
    reads = structured_reads(spark.createDataFrame(rows, "request_id string, payload string, values array<string>")).collect()
    found = {(r["request_id"], r["value"]): r for r in reads if r["failure"] is None}
    assert {(r["request_id"], r["failure"]) for r in reads if r["failure"]} == {
        ("stuck", "stuck"), ("short", "stuck"), ("stale", "stale list"), ("other", "value not allowed"), ("empty", "empty reply")
    }
    p = {k: math.exp(r["logprob"]) for k, r in found.items()}
    assert p["split", "A"] == pytest.approx((0.25 + 0.5 * 0.2) / 0.75) and p["split", "B"] == pytest.approx(0.4 / 0.75)
    assert p["joined", "A"] == pytest.approx(0.25) and p["joined", "B"] == pytest.approx(0.5)
    assert found["split", "B"]["sampled"] and found["joined", "B"]["sampled"] and not found["split", "A"]["sampled"]


def test_structured_profile_parses_replies_once(spark, capsys):
    only = lambda t: token(t, 0.0, [(t, 0.0)])
    replies = {"r1": [only('{"answer":"'), only("A")], "r2": [only('{"answer'), only('":"B')], "r3": [only("\n")]}
    rows = [(k, "g", json.dumps({"choices": [{"logprobs": {"content": c}}]}), ["A", "B"]) for k, c in replies.items()]
    payloads = spark.createDataFrame(rows, "request_id string, benchmark string, payload string, values array<string>")
    older = spark.createDataFrame([("r1", "A"), ("r2", "A"), ("r2", "B")], "request_id string, value string")
    profile = structured_profile(structured_reads(payloads), payloads.select("request_id", "benchmark"), F.lit(2), positions=value_positions(payloads), older=older)
    profile.explain("extended")
    assert "from_json" not in capsys.readouterr().out
    got = profile.first()
    # An older log that repeats a request counts in what is compared, not in positions and failures.
    assert (got["value_positions"], got["failures"], got["n"], got["n_merged"], got["n_compared"], got["n_agree"]) == ("1=2", "stuck=1", 4, 2, 3, 2)


def test_presentations_are_dealt_out_by_their_number(spark, monkeypatch):
    monkeypatch.setattr(D, "DEALT_ROWS", 40, raising=False)
    shown = presented(spark, [0.4, 0.1, 0.3, 0.2])
    items = shown.select("item_id", "prior_key", "free", F.lit(0).alias("fold"), F.col("shown_probs").alias("raw")).dropDuplicates(["item_id"])
    half = shown.where("cast(substr(item_id, 2) as int) % 2 = 0")
    for out, n in ((D.debias_offline(items, "pride", half), 40), (D.average_presentations(shown, ["item_id"]), 40), (D.full_cycles(shown, ["item_id"]), 40), (D.item_priors(shown, ["item_id"]), 160)):
        parts = [r["n"] for r in out.groupBy(F.spark_partition_id()).agg(F.count(F.lit(1)).alias("n")).collect()]
        assert len(parts) >= 3 and sum(parts) == n
