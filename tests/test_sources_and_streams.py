from __future__ import annotations

import os
import hashlib
import json

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.operators import crossfit as X
from plumbline.operators import frontier as W
from plumbline.operators import records as R
from plumbline.sources import datasets as ds
from plumbline.sources import readers as rd
from plumbline.sources import writers as wr
from plumbline.streaming import records as ST


def record(item, ok=True, cost=1.0, ts="2026-01-01T00:00:00Z", p=0.7):
    out = {"item_id": item, "question_type": "noul", "gold": "true", "latency_ms": 5.0, "cost_usd": cost, "cached": False, "ts": ts}
    return out | ({"answer": {"type": "noul", "noul": p}} if ok else {"error": {"type": "TimeoutError", "message": "slow"}})


def write_lines(path, rows, tail=""):
    path.write_text("".join(json.dumps(r) + "\n" for r in rows) + tail, encoding="utf-8")


def test_records_log_keeps_the_last_success_and_skips_torn_lines(spark, tmp_path):
    run = tmp_path / "run"
    run.mkdir()
    write_lines(run / "boolq.select.jsonl", [record("i1"), record("i1", ok=False), record("i2", ok=False, cost=2.0), record("i2", cost=3.0)], tail='{"item_id": "i3", "ans')
    write_lines(run / "yelp_stars.select.jsonl", [record("y1")])
    write_lines(run / "boolq.holdout.jsonl", [record("h1")])
    log = rd.records_log(spark, str(run), "select").withColumn("system_id", F.lit("s"))
    latest = {r["item_id"]: r for r in R.latest_records(log.select("system_id", "benchmark", "item_id", "ok", "line_no", "cost_usd")).collect()}
    assert set(latest) == {"i1", "i2"} and all(r["ok"] for r in latest.values())
    spend = {r["item_id"]: r["cost_usd"] for r in R.with_total_spend(log.select("system_id", "benchmark", "item_id", "ok", "line_no", "cost_usd")).collect()}
    assert spend == {"i1": 2.0, "i2": 5.0}
    assert {r["benchmark"] for r in rd.records_log(spark, str(run), "select", ["yelp_stars"]).collect()} == {"yelp_stars"}


def test_compacted_records_replace_only_their_partition(spark, tmp_path):
    path = str(tmp_path / "table")
    rows = spark.createDataFrame([("s", "b1", "select", "i", 1.0), ("s", "b2", "select", "j", 2.0)], "system_id string, benchmark string, split string, item_id string, v double")
    wr.write_records(rows, path)
    wr.write_records(rows.where("benchmark = 'b2'").withColumn("v", F.lit(9.0)), path)
    assert {r["benchmark"]: r["v"] for r in spark.read.parquet(path).collect()} == {"b1": 1.0, "b2": 9.0}


def test_jsonl_and_parquet_scans(spark, tmp_path):
    f = tmp_path / "x.jsonl"
    f.write_text('{"text": "a", "label": 1}\n\nnot json\n{"text": "b"}\n', encoding="utf-8")
    schema = T.StructType([T.StructField("text", T.StringType()), T.StructField("label", T.IntegerType())])
    good, bad = rd.jsonl_records(spark, str(f), schema, ["text", "label"])
    assert [r["text"] for r in good.collect()] == ["a"]
    assert sorted(r["reason"] for r in bad.collect()) == ["missing keys", "not JSON"]
    good.write.parquet(str(tmp_path / "p"))
    with pytest.raises(rd.SourceError, match="missing columns"):
        rd.parquet_records(spark, str(tmp_path / "p"), ["text", "nope"])


def test_csv_cells_may_span_lines(spark, tmp_path):
    f = tmp_path / "x.csv"
    f.write_text('﻿id,question,answer\n1," two\nlines ",yes\n2,,no\n', encoding="utf-8")
    good, bad = rd.csv_records(spark, str(f), ["id", "question", "answer"])
    assert [r["question"] for r in good.collect()] == ["two\nlines"]
    assert [r["_empty"] for r in bad.collect()] == [["question"]]


def test_pinned_files(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes(b"hello")
    (tmp_path / "b.txt").write_bytes(b"world")
    sha, blob = hashlib.sha256(b"hello").hexdigest(), hashlib.sha1(b"blob 5\0world").hexdigest()
    digests = rd.file_digests(spark, str(tmp_path))
    pins = lambda rows: spark.createDataFrame(rows, "name string, sha256 string, git_blob_sha1 string")
    assert rd.pin_mismatches(digests, pins([("a.txt", sha, None), ("b.txt", None, blob)])).count() == 0
    assert {r["name"] for r in rd.pin_mismatches(digests, pins([("a.txt", blob, None), ("c.txt", None, blob)])).collect()} == {"a.txt", "c.txt"}


def test_manifest(spark, tmp_path):
    call = {"started_at": "2026-01-01T00:00:00Z", "finished_at": "2026-01-01T00:01:40Z", "concurrency": 4, "n_called": 33, "n_cache_hits": 3}
    run = {"benchmark": "b", "split": "select", "status": "complete", "n_items": 33, "n_ok": 33, "n_errors": 0, "spent_usd": 0.5, "invocations": [call, call]}
    (tmp_path / "manifest.json").write_text(json.dumps({"system_id": "s", "runs": {"b.select": run}}, indent=2))
    runs, calls = rd.manifest_tables(spark, str(tmp_path / "manifest.json"))
    assert rd.manifest_totals(runs).first()["n_items"] == 33 and calls.count() == 2
    from plumbline.operators.costs import throughput

    assert throughput(calls, ["system_id"]).first()["items_per_second"] == pytest.approx(60 / 200)


def test_frozen_split_detects_changes(spark, tmp_path):
    items = spark.createDataFrame([("i1", 1), ("i2", 2)], "item_id string, gold int")
    path = str(tmp_path)
    assert wr.freeze_split(items, path, "b", "select", 0).count() == 2
    assert wr.freeze_split(items.limit(0), path, "b", "select", 0).count() == 2
    with pytest.raises(ValueError, match="requested"):
        wr.freeze_split(items, path, "b", "select", 1)
    items.withColumn("gold", F.lit(7)).write.mode("overwrite").parquet(f"{path}/b.select.items")
    with pytest.raises(ValueError, match="modified"):
        wr.freeze_split(items, path, "b", "select", 0)


def test_digest_ignores_order_but_not_multiplicity(spark):
    rows = [(i, f"x{i % 5}") for i in range(50)]
    df = spark.createDataFrame(rows, "a int, b string")
    digest = lambda d: wr.table_digest(d).first()["digest"]
    assert digest(df) == digest(df.orderBy(F.rand(3)).repartition(5))
    assert digest(df) != digest(df.union(df.limit(1)))


def test_parameters_round_trip(spark, tmp_path):
    table = spark.createDataFrame([("k", [0.25, 0.75], None), ("l", [1.0], 3)], "key string, prior array<double>, n int")
    wr.save_parameters(table, str(tmp_path / "p"))
    again = wr.load_parameters(spark, str(tmp_path / "p"), "key string, prior array<double>, n int")
    assert sorted(map(tuple, again.collect()), key=str) == sorted(map(tuple, table.collect()), key=str)


def test_custom_files_and_registry(spark, tmp_path):
    f = tmp_path / "mine.jsonl"
    f.write_text('{"text": "a", "gold": "yes", "id": "1"}\n{"text": "b", "gold": "perhaps", "id": "2"}\n')
    fields = {"state": "text", "gold": "gold", "id": "id", "instructions": F.lit("Is it?")}
    items, rejected = ds.custom_file(spark, "mine", str(f), "noul", fields)
    assert [(r["item_id"], r["gold"]) for r in items.collect()] == [("mine:1", "true")]
    assert [(r["item_id"], r["problem"]) for r in rejected.collect()] == [("mine:2", "gold")]
    with pytest.raises(ds.SourceError, match="need"):
        ds.custom_file(spark, "mine", str(f), "choice", fields)
    rows = spark.createDataFrame([("x", "A", "1"), ("y", "B", "1"), ("z", "C", None), (None, "A", "4"), ("w", "Q", "5"), ("v", "B", "6")], "text string, gold string, id string")
    choice = {"state": "text", "gold": "gold", "id": "id", "options": ds.listed_options("choice", ["A", "B", "C"])}
    good, bad = ds.mapped_items(rows, "m", "choice", choice)
    assert [r["question_id"] for r in good.collect()] == ["6"]
    assert sorted((r["question_id"], r["problem"]) for r in bad.collect()) == [("", "no id"), ("1", "duplicate id"), ("1", "duplicate id"), ("4", "no state"), ("5", "gold")]
    unnamed = {k: v for k, v in choice.items() if k != "id"}
    ids = lambda df: {r["question_id"] for r in ds.mapped_items(df, "m", "choice", unnamed)[0].collect()}
    assert len(ids(rows)) == 4 and ids(rows) == ids(rows.repartition(3, "text"))
    ds.register_benchmark("mine", qtype="noul", license="mine", splits={"test": "all"})(lambda s: items.union(items))
    ds.register_benchmark("wrong", qtype="choice", license="mine", splits={"test": "all"})(lambda s: items.withColumn("item_id", F.lit("w")))
    _, problems = ds.load_benchmarks(spark, ["mine", "wrong"])
    assert {(r["item_id"], r["problem"]) for r in problems.collect()} == {("mine:1", "duplicate id"), ("w", "question type")}
    assert [b.name for b in ds.list_benchmarks()] == ["mine", "wrong"]


def test_class_names_come_from_the_footer(spark, tmp_path):
    import json

    import pyarrow as pa
    import pyarrow.parquet as pq

    from plumbline.sources.readers import class_names

    held = json.dumps({"info": {"features": {"label": {"names": ["no", "yes"]}, "twice": {"names": ["x", "x"]}}}})
    pq.write_table(pa.table({"label": [0, 1]}).replace_schema_metadata({"huggingface": held}), tmp_path / "t.parquet")
    pq.write_table(pa.table({"label": [0, 1]}), tmp_path / "bare.parquet")
    assert class_names(spark, str(tmp_path / "t.parquet"), "label") == ["no", "yes"]
    for file, column in (("t.parquet", "twice"), ("t.parquet", "other"), ("bare.parquet", "label")):
        with pytest.raises(ds.SourceError):
            class_names(spark, str(tmp_path / file), column)


def test_bad_rows_are_reported(spark):
    rows = spark.createDataFrame([("q1", "t", ["a", "b"], 1, "B"), ("q2", "t", ["a", "b"], 1, "A"), ("q3", "t", ["a", "b"], 2, "C")], "question_id string, question string, options array<string>, answer_index int, answer string")
    items = ds.multiple_choice(rows, "m")
    assert items.count() == 3 and {r["question_id"] for r in ds.item_violations(items).collect()} == {"q2", "q3"}
    arc = spark.createDataFrame([("a", "t", (["x", "y"], ["1", "2"]), "2"), ("b", "t", (["x", "y"], ["1", "2"]), "7")], "id string, question string, choices struct<text: array<string>, label: array<string>>, answerKey string")
    assert {r["question_id"]: r["gold"] for r in ds.labelled_choice(arc, "m").collect()} == {"a": "B", "b": None}
    labels = spark.createDataFrame([("1", "t", 0), ("2", "t", 9), ("3", "t", 1)], "row string, text string, label int")
    named = ds.classification(labels, "m", "text", "label", ["x", "y"], "?", ["y"])
    assert {r["question_id"]: r["gold"] for r in named.collect()} == {"1": "x", "2": None}
    bank = rows.withColumnsRenamed({"answer_index": "gold_index", "answer": "subject"})
    assert ds.too_short(bank, 3).count() == 3 and ds.question_bank(bank, "m", n_permutations=2).count() == 6
    with pytest.raises(Exception, match="fewer than 3 options"):
        ds.question_bank(bank, "m", n_permutations=3).collect()


def test_markdown(spark):
    df = spark.createDataFrame([("b", 0.5, None), ("a", 0.25, 1.0)], "name string, acc double, mae double")
    text = wr.markdown_table(df, [("name", "Name", ""), ("acc", "Accuracy", ".3f"), ("mae", "MAE", ".1f")], ["name"])
    assert text == "| Name | Accuracy | MAE |\n| --- | --- | --- |\n| a | 0.250 | 1.0 |\n| b | 0.500 |  |\n"


def test_frontier_with_ties(spark):
    points = [("a", 10.0, 0.5), ("b", 10.0, 0.6), ("c", 8.0, 0.6), ("d", 5.0, 0.9), ("e", 1.0, 0.9), ("f", 0.5, 0.95)]
    df = spark.createDataFrame(points, "name string, x double, y double")
    assert {r["name"] for r in W.frontier(df, "x", "y").collect()} == {"b", "d", "f"}


def test_registry_fallback_chain(spark):
    requests = spark.createDataFrame([("api", "m", "t", "s1"), ("api", "m", "t", "s2"), ("api", "n", "t", "s1")], "backend string, model string, template_id string, signature string")
    exact = spark.createDataFrame([("api", "m", "t", "s1", 2.0)], "backend string, model string, template_id string, signature string, temperature double")
    general = spark.createDataFrame([("m", "t", 3.0)], "model string, template_id string, temperature double")
    got = {(r["model"], r["signature"]): (r["temperature"], r["source"]) for r in X.resolve_temperature(requests, exact, general).collect()}
    assert got == {("m", "s1"): (2.0, "exact"), ("m", "s2"): (3.0, "temperature_fallback"), ("n", "s1"): (1.0, "identity")}


def stream_log(spark, path):
    return ST.records_stream(spark, path, max_files=1).select(
        F.lit("s").alias("system_id"), F.lit("b").alias("benchmark"), "item_id", F.col("error").isNull().alias("ok"),
        F.unix_micros("ts").alias("line_no"), "cost_usd", "cached", "ts",
    )


def test_stream_resumes_exactly_once_and_success_wins(spark, tmp_path):
    log, base = tmp_path / "log", str(tmp_path)
    log.mkdir()
    write_lines(log / "1.jsonl", [record("i1", ts="2026-01-01T00:00:01Z"), record("i2", ok=False, cost=2.0, ts="2026-01-01T00:00:02Z")], tail='{"item')
    run = lambda: (
        ST.ingest(stream_log(spark, str(log)), f"{base}/out", f"{base}/c1").awaitTermination(),
        ST.keep_latest(stream_log(spark, str(log)), f"{base}/latest", f"{base}/c2").awaitTermination(),
    )
    run()
    write_lines(log / "2.jsonl", [record("i1", ok=False, cost=4.0, ts="2026-01-01T00:00:03Z"), record("i2", cost=1.0, ts="2026-01-01T00:00:04Z")])
    run()
    run()
    assert spark.read.parquet(f"{base}/out").count() == 4
    got = {r["item_id"]: r for r in ST.merged_latest(spark, f"{base}/latest").collect()}
    assert all(r["ok"] for r in got.values()) and got["i2"]["failed_usd"] == 2.0 and got["i1"]["n_attempts"] == 2
    ST.compact(spark, f"{base}/latest", f"{base}/compact")
    assert ST.merged_latest(spark, f"{base}/compact").count() == 2


def test_a_budget_stops_the_stream(spark, tmp_path):
    log = tmp_path / "log"
    log.mkdir()
    for k, cost in enumerate((3.0, 4.0, 100.0)):
        write_lines(log / f"{k}.jsonl", [record(f"i{k}", cost=cost)])
        os.utime(log / f"{k}.jsonl", (1_000 + k, 1_000 + k))
    watch = lambda limit, name: ST.within_budget(ST.watch_budget(stream_log(spark, str(log)), limit, f"{tmp_path}/{name}", f"{tmp_path}/c-{name}"))
    assert watch(5.0, "small") is False
    got = ST.over_budget(spark, f"{tmp_path}/small").first()
    assert got["spent_usd"] == 7.0 and got["stop"]
    assert watch(500.0, "large") is True and ST.over_budget(spark, f"{tmp_path}/large").first()["spent_usd"] == 107.0


def test_progress_counts_open_windows_and_late_rows(spark, tmp_path):
    log = tmp_path / "log"
    log.mkdir()
    times = ("2026-01-03T00:00:01Z", "2026-01-01T00:00:01Z", "2026-01-03T00:00:05Z")
    for k, ts in enumerate(times):
        write_lines(log / f"{k}.jsonl", [record(f"i{k}", cost=1.0, ts=ts)])
        os.utime(log / f"{k}.jsonl", (1_000 + k, 1_000 + k))
    ST.keep_progress(stream_log(spark, str(log)), f"{tmp_path}/out", f"{tmp_path}/c", "1 day").awaitTermination()
    got = {str(r["window_start"])[:10]: (r["n_called"], r["spent_usd"]) for r in ST.merged_progress(spark, f"{tmp_path}/out").collect()}
    assert got == {"2026-01-01": (1, 1.0), "2026-01-03": (2, 2.0)}
