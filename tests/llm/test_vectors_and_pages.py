"""Nearest neighbours against brute force, and page extraction."""

from __future__ import annotations

import html.parser
import re
import time
from collections import Counter

import numpy as np
import pytest

from plumbline.llm import ann, dom, html_extract
from tests.llm.helpers import rows


def brute(ids, vectors, query_id, query, k):
    q = np.array(query)
    found = []
    for i, v in zip(ids, vectors):
        if v is None or i == query_id or len(v) != len(query) or any(x is None or not np.isfinite(x) for x in v) or not any(v):
            continue
        v = np.array(v)
        found.append((-(v * q).sum() / (np.sqrt((v * v).sum()) * np.sqrt((q * q).sum())), i))
    return [(i, -s) for s, i in sorted(found)[:k]]


@pytest.mark.parametrize("dim", [64, 16, 100])
def test_neighbours(spark, dim):
    rng = np.random.default_rng(dim)
    centres = rng.normal(size=(40, dim))
    vectors = [(centres[k % 40] + 0.4 * rng.normal(size=dim)).tolist() for k in range(1500)]
    vectors[100:130] = [vectors[100]] * 30  # ties
    vectors[200], vectors[201], vectors[202], vectors[203] = None, [0.0] * dim, [float("nan")] + vectors[5][1:], [None] + vectors[5][1:]
    df = spark.createDataFrame([(k, v, 1, "c") for k, v in enumerate(vectors)], "vec_id bigint, embedding array<double>, label int, mark string")
    got = {}
    for r in rows(ann.nearest(df)):
        got.setdefault(r["query_id"], {})[r["rank"]] = (r["vec_id"], r["score"])
    asked = [k for k in range(0, 1500, 50) if k != 200]
    assert set(got) == set(asked)
    hits = 0
    for q in asked:
        want = brute(range(1500), vectors, q, vectors[q], 5)
        mine = [got[q][n] for n in range(1, 6)]
        assert mine == sorted(mine, key=lambda m: (-m[1], m[0])) and all(abs(dict(want)[i] - s) < 1e-12 for i, s in mine if i in dict(want))
        hits += len({i for i, _ in want} & {i for i, _ in mine})
    assert hits >= 0.9 * 5 * len(asked)
    assert [got[100][n][0] for n in range(1, 6)] == [101, 102, 103, 104, 105]


def test_every_code_within_the_radius_is_found_once():
    rng = np.random.default_rng(0)
    codes = rng.integers(0, 1 << 63, (3000, ann.PARTS), dtype=np.uint64)
    codes[:50] = codes[50] ^ (np.uint64(1) << rng.integers(0, 63, (50, ann.PARTS)).astype(np.uint64))
    tables, balls = [ann.Table(codes, t) for t in range(ann.TABLES)], {}
    for radius in (0, 1, 3, 17, 40, 64, 110, 256):
        for q in codes[:60:13]:
            found = np.concatenate([t.within(q, radius, balls) for t in tables])
            assert sorted(found.tolist()) == np.flatnonzero(ann.apart(codes, q) <= radius).tolist()


@pytest.mark.parametrize("radius", [9, 35])
def test_cells_hold_every_pair_within_the_radius_once(spark, monkeypatch, radius):
    monkeypatch.setattr(ann, "CELL_ROWS", 200)
    monkeypatch.setattr(ann, "QUERY_ROWS", 9)
    rng = np.random.default_rng(radius)
    centres = rng.integers(0, 1 << 63, (30, ann.PARTS), dtype=np.uint64)
    codes = centres[np.arange(900) % 30]
    for _ in range(radius // 2 + 1):
        codes = codes ^ (np.uint64(1) << rng.integers(0, 64, (900, 1)).astype(np.uint64)) * (np.arange(ann.PARTS) == rng.integers(0, ann.PARTS, (900, 1))).astype(np.uint64)
    coded = spark.createDataFrame([(k, k, 8, bytearray(c.tobytes())) for k, c in enumerate(codes)], "id bigint, mark bigint, dim int, code binary")
    assert ann.selective(radius) and not ann.selective(120)
    got = sorted((r["query_id"], r["id"]) for r in ann.probed_cells(coded, coded.where("id % 25 = 0"), 8, radius, 900, 36).collect())
    want = [(q, int(i)) for q in range(0, 900, 25) for i in np.flatnonzero(ann.apart(codes, codes[q]) <= radius)]
    assert got == sorted(want) and len(want) > 36


def test_vectors_of_a_tight_family_are_probed(spark, monkeypatch):
    """Near copies: the measured radius is small, tables are probed, and nothing is missed."""
    monkeypatch.setattr(ann, "CELL_ROWS", 300)
    rng = np.random.default_rng(12)
    centres = rng.normal(size=(150, 64))
    vectors = (centres[np.arange(1200) % 150] + 0.01 * rng.normal(size=(1200, 64))).tolist()
    df = spark.createDataFrame(list(enumerate(vectors)), "vec_id bigint, embedding array<double>")
    seen, real = [], ann.probed_cells
    monkeypatch.setattr(ann, "probed_cells", lambda *a: seen.append(a[3]) or real(*a))
    got = {}
    for r in sorted(rows(ann.nearest(df)), key=lambda r: (r["query_id"], r["rank"])):
        got.setdefault(r["query_id"], []).append(r["vec_id"])
    assert len(seen) == 1 and seen[0] < 60
    hits = sum(len({i for i, _ in brute(range(1200), vectors, q, vectors[q], 5)} & set(got[q])) for q in range(0, 1200, 50))
    assert set(got) == set(range(0, 1200, 50)) and hits >= 0.95 * 5 * 24


def test_far_vectors_have_neighbours_too(spark):
    """Rows that the measured radius does not reach find theirs among the nearest codes."""
    rng = np.random.default_rng(9)
    close = (np.ones(16) + 0.01 * rng.normal(size=(800, 16))).tolist()
    lone = (rng.normal(size=(3, 16)) - 3).tolist()
    df = spark.createDataFrame(list(enumerate(close + lone, start=1)) + [(1000, lone[0])], "vec_id bigint, embedding array<double>")
    got = [r["vec_id"] for r in sorted(rows(ann.nearest(df)), key=lambda r: (r["query_id"], r["rank"])) if r["query_id"] == 1000]
    assert got == [i for i, _ in brute(range(1, 804), close + lone, 1000, lone[0], 5)] and got[0] == 801


def test_few_rows_and_none(spark):
    schema = "vec_id bigint, embedding array<float>"
    few = spark.createDataFrame([(0, [1.0, 0.0]), (1, [1.0, 1.0]), (None, [0.0, 1.0]), (50, [1.0, 2.0, 3.0]), (1, [1.0, 1.0])], schema)
    got = sorted((r["query_id"], r["rank"], r["vec_id"]) for r in rows(ann.nearest(few)))
    assert got == [(0, 1, 1), (0, 2, 1), (0, 3, None)]
    assert ann.nearest(few.where("false")).count() == 0


TEXT = "One sentence of the story follows another, and so it goes on for a while. "
PAGES = {
    "nav": f'<html><head><title>t</title><script>var a="</p>";</script></head><body><nav><ul><li><a href=/>Home</a></li></ul></nav><div class="ad">Buy</div>'
    f"<article><h1>Head &amp; more</h1><p>{TEXT}\n  <b>bold</b><i>er</i> &eacute;<p>{TEXT*2}</article><footer>&copy; us</footer></body></html>",
    "comments": f'<body><header><h1>Site</h1></header><div class="entry-content"><p>{TEXT*3}</p><p>{TEXT*2}</p></div><div id="comments"><p>{TEXT}</p></div></body>',
    "form": f"<main><p>{TEXT*2}</p><form><label>Mail</label><input></form><p>{TEXT*3}</p></main><div class='cookie-notice'><p>We use cookies.</p></div>",
}


def pages(spark, sources):
    return spark.createDataFrame([(k, f"u{k}", s, "clash", 1) for k, s in enumerate(sources)], "page_id bigint, url string, html string, text string, key int")


def test_extraction(spark):
    odd = [None, "", "plain words", "<<<>>> <a b=\"c <p>x", "<!-- open", "<p>" * 300, "<script>alert(1)</script>", "</div></p>"]
    sources = [*PAGES.values()] * 8 + odd
    got = {r["page_id"]: r for r in rows(html_extract.extracted(pages(spark, sources)))}
    assert len(got) == len(sources) and all(r["n_chars"] == len(r["text"]) and r["url"] == f"u{k}" for k, r in got.items())
    one, two, three = (t.strip() for t in (TEXT, TEXT * 2, TEXT * 3))
    assert got[0]["text"] == f"Head & more\n{one} bolder é\n{two}"
    assert got[1]["text"] == f"{three}\n{two}" and got[2]["text"] == f"{two}\n{three}"
    assert got[len(PAGES) * 8]["text"] == got[len(PAGES) * 8 + 1]["text"] == ""
    assert html_extract.extracted(pages(spark, [None]).where("false")).count() == 0


def test_decoding_is_the_best_consistent_choice():
    rng = np.random.default_rng(2)
    for _ in range(60):
        n = int(rng.integers(2, 10))
        parent = np.array([0, *[int(rng.integers(0, k)) for k in range(1, n)]])
        depth = np.zeros(n, np.int64)
        for k in range(1, n):
            depth[k] = depth[parent[k]] + 1
        scores = rng.normal(size=n) * 2
        model = type("Fixed", (html_extract.Extractor,), {"scores": lambda self, f, s=scores: s.copy()})(0.0, ())
        kept = model.kept(dom.Nodes(parent, depth, np.zeros(n, bool), np.zeros((n, 1)), np.zeros(1, np.int64)))
        best = max(
            (sum(scores[k] for k in range(n) if m >> k & 1) for m in range(1 << n) if all(not m >> k & 1 or k == 0 or m >> int(parent[k]) & 1 for k in range(n))),
        )
        assert abs(scores[kept].sum() - best) < 1e-9 and all(not kept[k] or kept[parent[k]] for k in range(n))


def test_reader_forgives():
    page = dom.parse("<ul><li>a<li>b</ul><table><tr><td>1<td>2</table><p>x<div>y</div>z")
    texts = [(page.tags[page.parents[k]], page.texts[k]) for k in range(len(page.tags)) if page.tags[k] == "#"]
    assert texts == [("li", "a"), ("li", "b"), ("td", "1"), ("td", "2"), ("p", "x"), ("div", "y"), ("", "z")]


@pytest.mark.parametrize(
    "source, nodes",
    [("<a " * 300_000, 2), ("<div>" * 60_000 + "</span>" * 60_000, 60_001), ('<a "' * 200_000 + ">", 2), ("<a \"'" * 200_000 + ">", 3), ("<!x " * 200_000, 2), ("<p>x" + "<b> " * 100_000, 100_003)],
)
def test_broken_pages_are_read_in_linear_time(source, nodes):
    began = time.process_time()
    page = dom.parse(source)
    assert len(page.tags) == nodes and time.process_time() - began < 10
    assert max(page.parents) < nodes


def test_deep_and_long_pages_are_extracted():
    model = html_extract.Extractor(1.0, ())  # keeps every node
    deep = "<div>" * 50_000 + "deep" + "</div>" * 50_000
    assert model.texts([deep, "<p>a</p>" * 100_000, "<p>b"]) == ["deep", "\n".join(["a"] * 100_000), "b"]


def test_a_block_closes_its_paragraph_whatever_lies_between():
    page = dom.parse("<p>" + "<b>" * 30 + "x<div>y</div>")
    assert [page.tags[page.parents[k]] for k, t in enumerate(page.texts) if t == "y"] == ["div"] and page.tags[page.parents[page.tags.index("div")]] == ""
    page = dom.parse("<i><p>x<p>y")
    assert [page.tags[page.parents[k]] for k, t in enumerate(page.tags) if t == "p"] == ["i", "i"]


class Reading(html.parser.HTMLParser):
    """An independent reader: what lies in the article, outside what surrounds it."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.open, self.lines, self.text = [], [], ""

    AROUND = ("nav", "aside", "footer", "header", "form", "script", "style")
    BLOCKS = ("p", "div", "li", "ul", "h1", "h2", "h3", "article", "section", "blockquote", "main", "td", "tr", "table")

    def handle_starttag(self, tag, attrs):
        if tag in self.BLOCKS:
            self.flush()
        if tag == "br":
            self.text += " "
        elif tag not in dom.VOID:
            if tag == "p" and self.open and self.open[-1][0] == "p":
                self.open.pop()
            marks = " ".join(v or "" for k, v in attrs if k in ("class", "id", "role")).lower()
            self.open.append((tag, tag in self.AROUND or any(w in dom.BAD for w in re.findall("[a-z]+", marks)), tag in ("article", "main")))

    def handle_endtag(self, tag):
        if tag in self.BLOCKS:
            self.flush()
        if tag in [t for t, *_ in self.open]:
            while self.open.pop()[0] != tag:
                pass

    def handle_data(self, data):
        if any(a for *_, a in self.open) and not any(around for _, around, _ in self.open):
            self.text += data

    def flush(self):
        if line := " ".join(self.text.split()):
            self.lines.append(line)
        self.text = ""


def test_given_pages_against_another_reader(spark):
    """Pages whose article names itself: the words found are those of another reader's rule."""
    table = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    got = {r["page_id"]: r["text"] for r in rows(html_extract.extracted(table))}
    shares = []
    for r in table.collect():
        reader = Reading()
        reader.feed(r["html"] or "")
        reader.close()
        reader.flush()
        want = Counter(" ".join(reader.lines).split())
        if want:
            mine = Counter(got[r["page_id"]].split())
            shares.append(2 * sum((want & mine).values()) / (sum(want.values()) + sum(mine.values())))
    assert len(shares) > 50 and np.mean(shares) > 0.95
