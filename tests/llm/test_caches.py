"""What workers remember of words is bounded by characters, not by number alone."""

from __future__ import annotations

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from plumbline.llm import bpe, common, token_counts
from plumbline.llm.queries import BYTE_BPE

LONG = ["".join(chr(97 + (i * k) % 26) for i in range(3000)) for k in range(1, 30)]


def test_recent_words_are_put_aside_by_characters(monkeypatch):
    monkeypatch.setattr(common, "CACHE_CHARS", 100)
    held = common.RecentWords(1000)
    for k in range(50):
        for w in held.absent([f"{k:0>30}"]):
            held.young[w] = k
        assert sum(map(len, [*held.young, *held.old])) <= 2 * 130


@pytest.mark.parametrize("chars", [1 << 23, 5_000])
def test_long_pre_tokens_are_forgotten_and_counted_right(monkeypatch, chars):
    monkeypatch.setattr(bpe, "CACHE_CHARS", chars)
    monkeypatch.setattr(token_counts, "CACHE_CHARS", chars)
    path = public_tokenizers.path(BYTE_BPE)
    library, codec, counter = Tokenizer.from_file(path), bpe.Codec(path), token_counts.Counter(path)
    for text in LONG:
        want = library.encode(text, add_special_tokens=False).ids
        assert [i for ids, _, _ in codec.encode([text])[0] for i in ids] == want and counter.count([text]) == [len(want)]
        assert codec.chars <= max(chars, len(text)) and counter.chars <= max(chars, len(text))
