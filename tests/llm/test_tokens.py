"""Token counts, encoding and packing against the tokenizers library."""

from __future__ import annotations

import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from plumbline.llm import bpe, packing, token_counts
from tests.llm.helpers import documents, edge_texts, rows

BYTE, WORD = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")
TEXTS = edge_texts()


def library(path, texts):
    return [e.ids for e in Tokenizer.from_file(path).encode_batch([t or "" for t in texts], add_special_tokens=False)]


def noise(n=200, alphabet="aB \n\t.'s1é中😀<|½ÀĮi-_'ll\x1c\x85 "):
    rng = random.Random(4)
    return ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 120))) for _ in range(n)]


def test_counts_equal_the_library(spark):
    texts = TEXTS + noise()
    got = {r["doc_id"]: r for r in rows(token_counts.token_counts(documents(spark, texts, odd=True), BYTE))}
    for k, ids in enumerate(library(BYTE, texts)):
        raw = (texts[k] or "").encode()
        assert (got[k]["n_bytes"], got[k]["n_tokens"], got[k]["over_limit"]) == (len(raw), len(ids), len(ids) > 1024)


def test_ids_and_decoding_equal_the_library(spark):
    texts = TEXTS + noise()
    docs, ids = documents(spark, texts, odd=True), library(BYTE, texts)
    tokenizer = Tokenizer.from_file(BYTE)
    got = {r["doc_id"]: r for r in rows(bpe.round_trip_digests(docs, BYTE))}
    full = {r["doc_id"]: r["ids"] for r in rows(bpe.encode_texts(docs, BYTE))}
    for k, own in enumerate(ids):
        assert full[k] == own and got[k]["n_tokens"] == len(own)
        assert got[k]["ids_sha256"] == hashlib.sha256(",".join(map(str, own)).encode()).hexdigest()
        assert got[k]["decoded_sha256"] == hashlib.sha256(tokenizer.decode(own, skip_special_tokens=False).encode()).hexdigest()


def test_long_words_take_either_tree():
    codec = bpe.Codec(BYTE)
    for word in ("antidisestablishmentarianism" * 9, "ab" * 200, "z" * 65, "y" * 64):
        own = library(BYTE, [word])[0]
        assert list(codec.ids_of([word])[0]) == own == bpe.encode_long(codec.vocabulary, word.encode())
        assert token_counts.surviving_symbols(codec.vocabulary, [word.encode(), b"", b"a"]).tolist() == [len(own), 0, 1]


def test_first_fit_decreasing_is_first_fit():
    rng = random.Random(2)
    for _ in range(30):
        lengths = [rng.randint(1, 50) for _ in range(rng.randint(1, 60))]
        got, rooms = packing.first_fit_decreasing(lengths, 50), []
        for k in sorted(range(len(lengths)), key=lambda k: -lengths[k]):
            place = next((b for b, room in enumerate(rooms) if room >= lengths[k]), len(rooms))
            if place == len(rooms):
                rooms.append(50)
            rooms[place] -= lengths[k]
            assert got[k] == place


def test_packing_covers_every_id_once(spark):
    texts = TEXTS + noise(60)
    got = rows(packing.packed_tokens(documents(spark, texts, odd=True), WORD, capacity=64))
    ids = [own + [2] for own in library(WORD, texts)]
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in got:
        by_doc[r["doc_id"]].append(r)
        by_sequence[r["sequence_id"]].append((r["offset"], r["length"]))
        piece = ids[r["doc_id"]][r["start"] : r["start"] + r["length"]]
        assert r["doc_tokens"] == len(ids[r["doc_id"]]) and r["ids_crc32"] == zlib.crc32(np.array(piece, "<u4").tobytes())
    for k, own in enumerate(ids):
        at = 0
        for r in sorted(by_doc[k], key=lambda r: r["start"]):
            assert r["start"] == at
            at += r["length"]
        assert at == len(own)
    for pieces in by_sequence.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= 64
    assert sum(map(len, ids)) > 0.9 * 64 * len(by_sequence)


@pytest.mark.parametrize("run", [lambda d: token_counts.token_counts(d, BYTE), lambda d: bpe.round_trip_digests(d, BYTE), lambda d: packing.packed_tokens(d, WORD)])
def test_empty_tables_and_null_keys(spark, run):
    assert run(documents(spark, [])).count() == 0
    some = documents(spark, ["a b", None]).selectExpr("cast(null as bigint) doc_id", "text", "lang", "source", "n_chars")
    got = rows(run(some.union(some)))
    assert len(got) == 4 and all(r["doc_id"] is None for r in got)
