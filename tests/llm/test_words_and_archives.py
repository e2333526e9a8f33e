"""Spelling variants, WARC archives and periodic runs against plain code."""

from __future__ import annotations

import base64
import gzip
import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict
from glob import glob

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.llm import periodic_runs as pr
from plumbline.llm import spelling, warc
from plumbline.llm.queries import QUERIES
from tests.llm.helpers import DOC, documents, edge_texts, rows

HERE = "/root/testdata/sf0.001"


# Spelling variants


def edited_once(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    a, b = sorted((a, b), key=len)
    i = next((k for k, (x, y) in enumerate(zip(a, b)) if x != y), len(a))
    return a[i + 1 :] == b[i + 1 :] if len(a) == len(b) else a[i:] == b[i + 1 :]


def plain_variants(table, drop_every, least=5, count=3):
    seen = Counter()
    for key, text in table:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if key is None else key}:{run}".encode())
            if drop_every and h % drop_every == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            seen[run] += 1
    words = {w: n for w, n in seen.items() if n >= count and len(w) >= least}
    holes = defaultdict(set)
    for w in words:
        for k in range(len(w)):
            holes[w[:k] + w[k + 1 :]].add(w)
    near = defaultdict(set)
    for hole, ws in holes.items():
        for w in ws | ({hole} & words.keys()):
            near[w] |= {v for v in ws | ({hole} & words.keys()) if edited_once(v, w)}
    form = {}
    for w in words:
        best = min(near[w], key=lambda v: (-words[v], v), default=None)
        form[w] = best if best is not None and words[best] >= 2 * words[w] else None
    out = set()
    for w in words:
        root = w
        while form[root] is not None:
            root = form[root]
        out.add((w, words[w], len(near[w]), form[w], words[form[w]] if form[w] else None, root))
    return out


def found_variants(df):
    return {(r.word, r.n, r.n_near, r.form, r.form_n, r.root) for r in df.collect()}


def test_pairs_of_a_sorted_list():
    rng = random.Random(5)
    for turn in range(3000):
        letters, size = "abc"[: rng.randint(1, 3)], rng.randint(0, 5)
        length = (lambda: size + rng.randint(0, 1)) if turn % 2 else (lambda: rng.randint(0, 6))
        words = sorted({"".join(rng.choice(letters) for _ in range(length())) for _ in range(rng.randint(0, 20))})
        below = rng.choice([1 << 30, 0, 1, 2, 3])
        want = {(i, j) for j, b in enumerate(words) for i, a in enumerate(words[:j]) if edited_once(a, b) and spelling.shared(a, b) < below}
        got = list(spelling.near_in_list(words, below))
        assert set(got) == want and len(got) == len(want)


@pytest.mark.parametrize("longest", [256, 4])
def test_variants_of_drawn_words(spark, longest):
    """Short lists are filed again down to one free letter with ``longest=4``; results are the same."""
    rng = random.Random(7)
    stems = ["".join(rng.choice("abé") for _ in range(rng.randint(4, 8))) for _ in range(60)] + ["z" * 40, "z" * 41, "y" + "z" * 39]
    texts = [" ".join(rng.choice(stems) + rng.choice(["", "", "a", "Ü"]) for _ in range(300)) for _ in range(20)]
    texts += [None, "", "Été×÷ 日本ñandú—ñandú ñandú", "ABCDE abcde Abcde abcdf", texts[0], texts[0]]
    df = documents(spark, texts, odd=True)
    got = found_variants(spelling.variant_groups(df, drop_every=7, longest=longest))
    assert got == plain_variants(list(enumerate(texts)), 7)
    assert any(r[3] for r in got) and any(r[5] not in (r[0], r[3]) for r in got)


def test_variants_of_the_given_table(spark):
    table = [(r.doc_id, r.text) for r in spark.read.parquet(f"{HERE}/documents.parquet").select("doc_id", "text").collect()]
    assert found_variants(QUERIES["op11_spelling"](spark, HERE)) == plain_variants(table, 97)


def test_variants_of_odd_tables(spark):
    assert spelling.variant_groups(spark.createDataFrame([], DOC)).count() == 0
    assert spelling.variant_groups(documents(spark, [None, "", "one two", "12345 !!"])).count() == 0
    df = spark.createDataFrame([(None, "abcde abcde abcde abcdx " * 3, None, None, None)], DOC)
    assert found_variants(spelling.variant_groups(df, drop_every=3)) == plain_variants([(None, "abcde abcde abcde abcdx " * 3)], 3)
    with pytest.raises(ValueError):
        spelling.variant_groups(df, times=1)


# WARC


PAGE = "page_id bigint, url string, html string, id string, digest string, file string, keep string"


def pages(spark, held):
    return spark.createDataFrame([(k, u, h, "x", "y", "z", "w") for k, u, h in held], PAGE)


def plain_records(held):
    largest = {}
    for key, _, html in held:
        if key is not None:
            largest[html or ""] = max(key, largest.get(html or "", key))
    out = []
    for key, _, html in held:
        raw = (html or "").encode()
        keep = largest.get(html or "")
        again = keep is not None and key != keep
        out.append((key, len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(), "revisit" if again else "response", keep if again else None))
    return sorted(out, key=str)


def told(df):
    return sorted(((r.id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in df.collect()), key=str)


HELD = [
    (1, "http://www.Example.com/b?q=1", "<p>same</p>"), (2, "https://example.com:8080/a", "WARC/1.1\r\nWARC-Type: response\r\nContent-Length: 3\r\n\r\nabc\r\n\r\nWARC/1.1\r\n"),
    (3, None, "<p>same</p>"), (4, "a b\r\nWARC/1.1\r\nX: y", None), (5, "", ""), (6, "http://[bad", "é日本😀\r\n\r\n"), (None, "http://n", "<p>same</p>"), (None, "http://n", "only without key"),
    (7, "http://example.com/", "x" * 200_000 + "\n" * 5), (7, "http://example.com/", "x" * 200_000 + "\n" * 5), (-9, "http://example.com/", "WARC/1.1\r\n"),
]


def test_archives_round_trip(spark, tmp_path):
    folder = str(tmp_path / "warc")
    got = warc.capture_histories(pages(spark, HELD).repartition(3), folder=folder)
    assert told(got) == plain_records(HELD)
    assert [r.problem for r in got.select("problem").distinct().collect()] == [None]
    raw = {f.rsplit("/", 1)[1]: gzip.open(f).read() for f in glob(folder + "/*.gz")}
    for r in got.collect():
        record = raw[r.file][r.offset : r.offset + r.length]
        assert record.startswith(b"WARC/1.1\r\nWARC-Type: " + r.record_type.encode()) and record.endswith(b"\r\n\r\n")
        head, block = record.split(b"\r\n\r\n", 1)
        size = int(re.search(rb"Content-Length: (\d+)", head)[1])
        assert len(block) == size + 4
        if r.record_type == "response":
            assert base64.b32encode(hashlib.sha1(block[:size].split(b"\r\n\r\n", 1)[1]).digest()).decode() == r.payload_digest
    assert sum(len(x) for x in raw.values()) == sum(r.length for r in got.collect())


def test_small_payloads_are_no_revisits(spark):
    got = {r.id: r.record_type for r in warc.capture_histories(pages(spark, HELD), least_bytes=1).collect()}
    assert got[4] == got[5] == "response" and got[1] == "revisit"


def test_histories_are_in_global_order(spark, monkeypatch):
    rng = random.Random(3)
    held = [(k, "http://hot.example/" if k % 3 else f"http://h{rng.randint(0, 20)}.example/p{rng.randint(0, 9)}", f"page {k}") for k in range(600)]
    for name, value in (("RUN_ROWS", 40), ("MERGE_ROWS", 50)):
        monkeypatch.setattr(warc, name, value)
    got = warc.capture_histories(pages(spark, held).repartition(4)).orderBy("place").collect()
    assert len(got) == 600 and len({r.place >> 33 for r in got}) > 5
    keys = [(r.urlkey, r.timestamp, r.file, r.offset) for r in got]
    assert keys == sorted(keys)
    hot = [r.timestamp for r in got if r.urlkey == "example,hot)/"]
    assert len(hot) == 400 and hot == sorted(hot)


def test_loser_tree_merges():
    rng = random.Random(1)
    for k in range(40):
        runs = [sorted((0, chr(rng.randint(97, 99)), "", 0, 0, 0, 0, 0, "f", rng.randint(0, 9)) for _ in range(rng.randint(0, 8))) for _ in range(k % 9)]
        merged = list(warc.LoserTree([sorted(r, key=warc._place) for r in runs]))
        assert [warc._place(r) for r in merged] == sorted(warc._place(r) for run in runs for r in run)


def test_broken_archives_are_told():
    good = b"WARC-Type: response\r\nWARC-Payload-Digest: sha1:AAAA\r\nContent-Length: 2\r\n\r\nab\r\n\r\n"
    got = list(warc.read_records([b"", good, b"no header", b"Content-Length: 99\r\n\r\nshort\r\n\r\n"]))
    assert [g[4] for g in got] == [None, "no header or length", "length does not fit"]
    assert warc.entry("f", *got[0])[-1] == "digest does not fit"
    assert list(warc.read_records([])) == list(warc.read_records([b""])) == []


def test_archives_of_odd_tables(spark):
    assert warc.capture_histories(pages(spark, [])).count() == 0
    nulls = spark.createDataFrame([(None, None, None)] * 2, "page_id bigint, url string, html string")
    assert told(warc.capture_histories(nulls)) == plain_records([(None, None, None)] * 2)
    dated = nulls.withColumn("when", F.lit("2024-05-06 07:08:09").cast("timestamp"))
    assert {r.timestamp for r in warc.capture_histories(dated, date="when").collect()} == {"20240506070809"}
    line = warc.cdx_lines(warc.capture_histories(pages(spark, HELD[:1]))).first().line
    assert line.startswith("com,example)/b?q=1 20000101000001 http://www.Example.com/b?q=1 response ")


# Periodic runs


def plain_runs(w):
    n, out = len(w), []
    for q in range(1, n // 4 + 1):
        i = 0
        while i < n - q:
            if w[i] != w[i + q]:
                i += 1
                continue
            s = i
            while i < n - q and w[i] == w[i + q]:
                i += 1
            length = i + q - s
            if length >= max(6, 4 * q):
                x = w[s : s + length]
                if next(p for p in range(1, length + 1) if x[p:] == x[: length - p]) == q:
                    out.append((s, length, q))
    return sorted(out, key=lambda r: (r[0], r[2]))


def plain_digests(key, text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n = len(words)
    if key is not None and (h := zlib.crc32(str(key).encode())) % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    runs = plain_runs(words)
    gone = {i for s, length, q in runs for i in range(s + q, s + length)}
    best = max(runs, key=lambda r: (r[1], -r[0], -r[2]), default=None)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    longest = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
    return key, len(runs), *longest, sha("".join(f"{s},{m},{q}\n" for s, m, q in runs)), sha(" ".join(w for i, w in enumerate(words) if i not in gone))


def drawn_words(rng):
    out, letters = [], rng.randint(1, 3)
    while len(out) < rng.randint(0, 60):
        block = [rng.randint(0, letters) for _ in range(rng.randint(1, 9))]
        out += block * rng.choice([1, 1, 2, 3, 5, 7]) + block[: rng.randint(0, len(block))]
    return out


def test_runs_of_drawn_words():
    rng = random.Random(11)
    for _ in range(4000):
        words = drawn_words(rng)
        assert pr.runs_of(np.array(words, np.int64)) == plain_runs(words)


def test_runs_of_long_texts():
    n = 200_000
    assert pr.runs_of(np.zeros(n, np.int64)) == [(0, n, 1)]
    assert pr.runs_of(np.arange(n) % 30_000) == [(0, n, 30_000)]
    words = np.concatenate([np.arange(50_000), np.arange(100_000) % 7, np.arange(50_000)])
    assert pr.runs_of(words) == [(50_000, 100_000, 7)]


def found_digests(df):
    return sorted(((r.doc_id, r.n_runs, r.start, r.length, r.period, r.exponent_milli, r.runs_sha256, r.collapsed_sha256) for r in df.collect()), key=str)


def test_run_digests(spark):
    rng = random.Random(13)
    texts = [" ".join("abcd"[w] for w in drawn_words(rng)) for _ in range(150)] + edge_texts() + ["x " * 50_000, "\x0bé\x0c é\té é é é  \x1fq"]
    df = documents(spark, texts, odd=True)
    got = found_digests(pr.digests(pr.periodic_runs(pr.with_repeats(df))))
    assert got == sorted((plain_digests(k, t) for k, t in enumerate(texts)), key=str)
    assert sum(g[1] > 0 for g in got) > 30


def test_runs_of_the_given_table(spark):
    table = spark.read.parquet(f"{HERE}/documents.parquet").select("doc_id", "text").collect()
    short = {r.doc_id for r in table if len(r.text or "") < 6000}
    want = sorted((plain_digests(r.doc_id, r.text) for r in table if r.doc_id in short), key=str)
    assert [g for g in found_digests(QUERIES["op13_periodic_runs"](spark, HERE)) if g[0] in short] == want


def test_runs_of_odd_tables(spark):
    assert pr.periodic_runs(spark.createDataFrame([], DOC)).count() == 0
    held = [(None, "a a a a a a", None, None, None), (None, None, None, None, None), (5, "b", None, None, None), (5, "b", None, None, None)]
    got = rows(pr.periodic_runs(pr.with_repeats(spark.createDataFrame(held, DOC))))
    assert sorted((r["n_words"], len(r["runs"]), r["collapsed"]) for r in got) == [(0, 0, ""), (1, 0, "b"), (1, 0, "b"), (6, 1, "a")]
