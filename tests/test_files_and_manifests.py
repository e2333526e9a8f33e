"""Pinned files, line order, manifests, levels of increments, structured prompts, debiasers per system."""

from __future__ import annotations

import datetime as dt
import hashlib
import json
import os
import random

import pytest
from pyspark.sql import functions as F

from plumbline.functions import questions as Q
from plumbline.operators import alignment as A
from plumbline.operators import debias as P
from plumbline.operators import records as R
from plumbline.sources import chatlog
from plumbline.sources import datasets as ds
from plumbline.sources import readers as rd
from plumbline.sources import writers as wr
from plumbline.streaming import records as ST

FILES = {
    "a/data.bin": bytes(range(256)) * 900, "b/data.bin": b"line\nline\r\n" * 20_000, "c.txt": b"\xef\xbb\xbfmarked\n" + b"x" * 200_000, "d.txt": b"\xef\xbb\xbf" + b"y\n" * 100_000,
    "small": b"abc", "none": b"", "packed.gz": b"\x1f\x8bnot really" * 30_000, "e": b"\n" * 150_000,
}


@pytest.mark.parametrize("whole", [64 * 2**20, 1000])
def test_digests_of_files_read_whole_and_as_streams(spark, tmp_path, whole):
    for name, data in FILES.items():
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(data)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")  # many splits a file
    try:
        got = {r["name"]: r for r in rd.file_digests(spark, str(tmp_path), whole).collect()}
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert set(got) == set(FILES)
    for name, data in FILES.items():
        assert got[name]["sha256"] == hashlib.sha256(data).hexdigest(), name
        assert got[name]["git_blob_sha1"] == hashlib.sha1(b"blob %d\0" % len(data) + data).hexdigest(), name


def test_pins_go_by_relative_path_and_are_enforced(spark, tmp_path):
    for name in ("a/x", "b/x"):
        (tmp_path / name).parent.mkdir()
        (tmp_path / name).write_text(name)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    pins = lambda *p: spark.createDataFrame(list(p), "name string, sha256 string, git_blob_sha1 string")
    assert rd.verified_files(spark, str(tmp_path), pins(("a/x", sha("a/x"), None), ("b/x", sha("b/x"), None))).count() == 2
    with pytest.raises(rd.SourceError, match="b/x"):
        rd.verified_files(spark, str(tmp_path), pins(("a/x", sha("a/x"), None), ("b/x", sha("a/x"), None)))
    with pytest.raises(rd.SourceError, match="gone"):
        rd.verified_files(spark, str(tmp_path), pins(("gone", sha("a/x"), None)))


def test_line_order_does_not_depend_on_splits(spark, tmp_path):
    lines = [f"vllm-1  | INFO 01-02 03:04:05 [x.py:1] Model loading took {k}.5 GiB memory and {k} seconds" for k in range(3, 900)]
    lines[5] = "vllm-1  | vllm serve first --x"
    lines[700] = "vllm-1  | vllm serve second"
    lines[9] = "vllm-1  | INFO 01-02 03:04:05 [x.py:1] Using Marlin kernel"
    lines[8] = "vllm-1  | (EngineCore pid=9) Initializing a V1 LLM engine (v1) quantization=awq_marlin, seed=0"
    lines[300] = "vllm-1  | INFO 01-02 03:04:05 [x.py:1] Using Marlin kernel"
    lines[200] = "vllm-1  | w4a16 path"
    (tmp_path / "server.log").write_text("\n".join(lines) + "\n")
    found = []
    for size in ("128m", "1500"):
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        spark.conf.set("spark.sql.files.openCostInBytes", "1")
        try:
            rows = chatlog.log_lines(spark, str(tmp_path / "server.log"))
            found.append((
                rows.rdd.getNumPartitions() > 30, chatlog.log_facts(rows).first()["weights_gib"], tuple(chatlog.log_texts(rows).first())[1:],
                [r["message"] for r in chatlog.kernel_lines(rows).orderBy("rank").collect()],
            ))
        finally:
            spark.conf.unset("spark.sql.files.maxPartitionBytes")
            spark.conf.unset("spark.sql.files.openCostInBytes")
    assert found[0][0] is False and found[1][0] is True
    assert found[0][1:] == found[1][1:] == (3.5, ("vllm serve first --x", "awq_marlin"), ["Using Marlin kernel", "w4a16 path"])


def run_row(system, calls, n_ok=1):
    stamp = lambda day: dt.datetime(2026, 1, day, microsecond=123_456)
    listed = [(stamp(d), None if open_ else stamp(d + 1), "running" if open_ else "finished", 4, n, 0, 0, 0.0) for d, n, open_ in calls]
    return (system, "b.select", "b", "select", "running", 10, n_ok, 0, 0.5, listed)


def calls_of(row):
    return [(i["started_at"].day, i["n_called"], i["finished_at"] is not None) for i in row["invocations"]]


def test_two_writers_and_a_replay_leave_one_whole_manifest(spark, tmp_path, monkeypatch):
    folder = str(tmp_path / "manifest")
    rows = lambda *r: spark.createDataFrame(list(r), wr.MANIFEST_SCHEMA)
    assert wr.read_manifest(spark, folder).count() == 0
    first = rows(run_row("s", [(1, 5, False), (3, 0, True)], 3))
    assert wr.commit_manifest(first, folder) == 1
    # Another writer publishes between this one's read and its rename.
    seen, real = [], wr.read_manifest

    def read_late(spark, folder, version=None):
        known = real(spark, folder, version)
        if not seen:
            seen.append(known.collect())
            assert wr.commit_manifest(rows(run_row("t", [(2, 1, False)])), folder) == 2
        return known

    monkeypatch.setattr(wr, "read_manifest", read_late)
    assert wr.commit_manifest(rows(run_row("s", [(3, 7, False)], 8)), folder) == 3
    monkeypatch.setattr(wr, "read_manifest", real)
    assert wr.commit_manifest(first, folder) == 3  # a replay changes nothing
    got = {r["system_id"]: r for r in wr.read_manifest(spark, folder).collect()}
    assert set(got) == {"s", "t"} and calls_of(got["s"]) == [(1, 5, True), (3, 7, True)] and got["s"]["n_ok"] == 8
    assert [r["n_ok"] for r in wr.read_manifest(spark, folder, 1).collect()] == [3]
    assert not [f for f in os.listdir(folder) if f.startswith("_aside")]


def test_manifests_read_from_json(spark, tmp_path):
    run = {"benchmark": "b", "split": "select", "status": "complete", "n_items": 2, "n_ok": 2, "n_errors": 0, "spent_usd": 0.1, "invocations": []}
    (tmp_path / "manifest.json").write_text(json.dumps({"system_id": "s", "runs": {"b.select": run}}, indent=2))
    rows = rd.manifest_rows(spark, str(tmp_path / "manifest.json"))
    wr.commit_manifest(rows, str(tmp_path / "out"))
    assert wr.read_manifest(spark, str(tmp_path / "out")).first()["n_items"] == 2


def one(item, ok, line, cost=1.0):
    return ("s", "b", item, ok, line, cost)


def increments_of(spark, batches, table, runs):
    schema = "system_id string, benchmark string, item_id string, ok boolean, line_no bigint, cost_usd double"

    class Fake:
        """Calls the sink as the engine would, one batch after the other."""

        def __getattr__(self, _):
            return lambda *a, **k: self

        def foreachBatch(self, write):  # noqa: N802
            for batch_id, rows in batches:
                write(spark.createDataFrame(rows, schema), batch_id)
            return self

    stream = type("Stream", (), {"writeStream": Fake()})()
    ST.keep_latest(stream, table, "unused", level_runs=runs)


def test_increments_are_merged_in_levels_and_replays_count_once(spark, tmp_path):
    table, rng = str(tmp_path / "t"), random.Random(2)
    batches = [(k, [one(f"i{rng.randint(0, 6)}", rng.random() < 0.4, 10 * k + j) for j in range(4)]) for k in range(11)]
    increments_of(spark, batches, table, 3)
    listed = ST.increments(spark, table)
    # 11 batches: one of nine (level 2), two of level 0.
    assert [(level, first, last) for level, first, last, _ in listed] == [(2, 0, 8), (0, 9, 9), (0, 10, 10)]
    log = spark.createDataFrame([r for _, rows in batches for r in rows], "system_id string, benchmark string, item_id string, ok boolean, line_no bigint, cost_usd double")
    want = {r["item_id"]: (r["ok"], r["line_no"], r["n_attempts"]) for r in R.latest_records(log).collect()}
    read = lambda: {r["item_id"]: (r["ok"], r["line_no"], r["n_attempts"]) for r in ST.merged_latest(spark, table).collect()}
    assert read() == want
    increments_of(spark, [batches[4], batches[10]], table, 3)  # replays: one merged long ago, one of the last batch
    assert read() == want
    # A crash after a merge and before its sources went: they are covered.
    ST._combined(spark.read.parquet(*[r[3] for r in ST.increments(spark, table)]), R.RECORD_KEYS).write.parquet(f"{table}/level=3/first=0/last=10")
    assert [(r[0], r[1], r[2]) for r in ST.increments(spark, table)] == [(3, 0, 10)] and read() == want
    # A crash within a merge leaves no success mark: the folder does not count.
    os.remove(f"{table}/level=3/first=0/last=10/_SUCCESS")
    assert len(ST.increments(spark, table)) == 3 and read() == want


def test_structured_values_are_written_as_json(spark):
    texts = ['plain', 'q"uo\\te', "tab\tline\nbreak\r\b\f", "\x00\x0b\x1f\x7f é日本😀", ""]
    numbers = [0.0, -0.0, 1.0, 0.1, 1e-4, 9.99e-5, 123456.75, 1e7, 1.5e15, 1e16, 1.25e-9, -2.5e22, 3e100]
    assert [r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(Q.json_string(F.col("t"))).collect()] == [json.dumps(t, ensure_ascii=False) for t in texts]
    assert [r[0] for r in spark.createDataFrame([(x,) for x in numbers], "x double").select(Q.json_number(F.col("x"))).collect()] == [json.dumps(x) for x in numbers]
    value = {"name": "x", "n": 3, "ok": True, "none": None, "list": [1, 2], "empty": [], "map": {'a"b': 0.5}, "rows": [{"a": "b", "c": None}]}
    schema = "v struct<name: string, n: int, ok: boolean, none: string, list: array<int>, empty: array<int>, map: map<string, double>, rows: array<struct<a: string, c: double>>>"
    df = spark.createDataFrame([(tuple(value[k] if k != "rows" else [("b", None)] for k in value),), (None,)], schema)
    got = [r[0] for r in df.select(Q.render_value(F.col("v"), df.schema["v"].dataType)).collect()]
    assert got == [json.dumps(value, indent=2, ensure_ascii=False), None]
    plain = spark.createDataFrame([("as it is",)], "s string")
    assert plain.select(Q.render_value(F.col("s"), plain.schema["s"].dataType)).first()[0] == "as it is"


def test_equal_rows_without_ids_are_all_items(spark):
    rows = spark.createDataFrame([("s", "true"), ("s", "true"), ("t", "false"), ("s", "true")], "state string, gold string")
    items, rejected = ds.mapped_items(rows, "mine", "noul", {"state": "state", "gold": "gold"})
    ids = sorted(r["question_id"] for r in items.collect())
    assert rejected.count() == 0 and len(ids) == len(set(ids)) == 4 and sum("-" in i for i in ids) == 2


TWO = [("a", "i", [0.9, 0.1]), ("b", "i", [0.2, 0.8])]


def test_debiasers_keep_systems_apart(spark):
    items = spark.createDataFrame([(s, i, [0.5, 0.5], [True, True], "k", "h") for s, i, _ in TWO], "system string, item_id string, probs array<double>, free array<boolean>, prior_key string, question_hash string")
    shown = spark.createDataFrame([(s, i, [0, 1], p) for s, i, p in TWO], "system string, item_id string, order array<int>, shown_probs array<double>")
    answer = lambda df: {r["system"]: [round(x, 6) for x in r["debiased"]] for r in df.collect()}
    assert answer(P.make_debiaser("permutation").apply(items, shown)) == {"a": [0.9, 0.1], "b": [0.2, 0.8]}
    priors = spark.createDataFrame([(s, "k", p, 5) for s, _, p in TWO], "system string, prior_key string, prior array<double>, n int")
    divided = P.make_debiaser("batch").apply(items, priors)
    assert divided.count() == 2 and answer(divided) == {"a": [0.1, 0.9], "b": [0.8, 0.2]}
    answers = spark.createDataFrame([(s, "h", [True, True], p) for s, _, p in TWO], "system string, question_hash string, free array<boolean>, probs array<double>")
    context = P.make_debiaser("contextual")
    both = answer(context.apply(items, answers))
    assert both == {"a": [0.1, 0.9], "b": [0.8, 0.2]}
    assert answer(context.apply(items.where("system = 'a'"), answers))["a"] == both["a"]
    with pytest.raises(ValueError, match="system"):
        P.make_debiaser("batch").apply(items, priors.drop("system"))


def test_raw_reads_are_compared_label_by_label(spark):
    inf = float("inf")
    df = spark.createDataFrame([("g", {"A": -1.0, "B": -2.0, "C": -inf}, {"A": -1.5, "C": -3.0, "D": -4.0}), ("g", {}, {"A": float("nan")})], "g string, raw_a map<string, double>, raw_b map<string, double>")
    got = A.raw_comparison(df, ["g"]).first()
    assert (got["raw_mae"], got["n_finite"], got["n_one_sided"], got["n_infinite"], got["n_nonfinite"]) == (0.5, 1, 3, 1, 4)


def test_protocol_breaches(spark):
    latest = spark.createDataFrame([("s", "b", "i1", True, 1), ("s", "b", "i2", False, 1), ("s", "b", "x", True, 2), ("s", "c", "j", True, 1)], "system_id string, benchmark string, item_id string, ok boolean, n_calls bigint")
    items = spark.createDataFrame([("b", "i1"), ("b", "i2"), ("b", "i3"), ("c", "j")], "benchmark string, item_id string")
    settings = spark.createDataFrame([("s", "b", "k", "1"), ("s", "c", "k", "2"), ("s", "d", "k", "1")], "system_id string, benchmark string, name string, value string")
    got = {(r["benchmark"], r["reason"]): r["n"] for r in R.protocol_breaches(latest, items, settings).collect()}
    assert got == {("b", "missing"): 1, ("b", "foreign"): 1, ("b", "unanswered"): 1, ("b", "calls"): 1, ("c", "settings"): 1}


def test_bad_lines_keep_their_text(spark, tmp_path):
    (tmp_path / "x.jsonl").write_text('{"text": "b"}\nnot json\n')
    from pyspark.sql import types as T

    schema = T.StructType([T.StructField("text", T.StringType()), T.StructField("label", T.IntegerType())])
    _, bad = rd.jsonl_records(spark, str(tmp_path / "x.jsonl"), schema, ["text", "label"])
    assert sorted(r["line"] for r in bad.collect()) == ["not json", '{"text":"b"}']
