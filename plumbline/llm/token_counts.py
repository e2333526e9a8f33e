"""Token counts by rank-synchronous array merging.

Pre-tokens are held as one ragged numpy array. A round looks up the rank of every adjacent pair,
takes the lowest rank of each sequence and merges that pair everywhere in its sequence at once;
sequences without a mergeable pair leave. What is counted is the symbols that survive.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame

from plumbline.llm.bytebpe import NO_RANK, Vocabulary, unseen
from plumbline.llm.common import CACHE_CHARS, map_texts, narrow, schema_of

CACHE_WORDS = 500_000
"""Pre-tokens whose counts a worker keeps."""
ROUND_BYTES = 1 << 20
"""Bytes of pre-tokens merged together (one longer pre-token is merged alone)."""


def surviving_symbols(vocabulary: Vocabulary, words: list[bytes]) -> np.ndarray:
    """Symbols left of each pre-token (bytes, possibly empty) when no pair can be merged."""
    counts = np.array([len(w) for w in words], np.int64)
    live = np.flatnonzero(counts > 1)
    if not len(live):
        return counts
    symbols = vocabulary.byte_ids[np.frombuffer(b"".join(words[i] for i in live), np.uint8)]
    lengths = counts[live]
    pairs = vocabulary.pairs
    while len(live):
        ends = np.cumsum(lengths)
        starts = ends - lengths
        slots = pairs.slots(symbols[:-1], symbols[1:])
        ranks = np.append(pairs.ranks[slots], NO_RANK)
        ranks[ends - 1] = NO_RANK
        lowest = np.minimum.reduceat(ranks, starts)
        owner = np.repeat(np.arange(len(live)), lengths)
        hit = (ranks == lowest[owner]) & (ranks < NO_RANK)
        at = np.flatnonzero(hit)
        # Overlapping hits (a pair of equal symbols) merge from the left: every second one of a run.
        first = np.ones(len(at), bool)
        first[1:] = at[1:] != at[:-1] + 1
        run_start = np.maximum.accumulate(np.where(first, np.arange(len(at)), 0))
        at = at[(np.arange(len(at)) - run_start) % 2 == 0]
        symbols[at] = pairs.merged[slots[at]]
        lengths -= np.bincount(owner[at], minlength=len(live))
        keep = np.ones(len(symbols), bool)
        keep[at + 1] = False
        done = lowest == NO_RANK
        done |= lengths == 1
        if done.any():
            counts[live[done]] = lengths[done]
            keep &= ~done[owner]
            live, lengths = live[~done], lengths[~done]
        symbols = symbols[keep]
    return counts


class Counter:
    """Counts tokens of texts; pre-tokens met before come from a bounded cache."""

    def __init__(self, path: str):
        self.vocabulary = Vocabulary(path)
        self.cache: dict[str, int] = dict.fromkeys(self.vocabulary.special, 1)
        self.chars = 0

    def count(self, texts: list[str]) -> list[int]:
        split = [self.vocabulary.pre_tokens(t) for t in texts]
        fresh = unseen(iter(split), self.cache)
        if len(self.cache) + len(fresh) > CACHE_WORDS or self.chars + sum(map(len, fresh)) > CACHE_CHARS:
            self.cache, self.chars = dict.fromkeys(self.vocabulary.special, 1), 0
            fresh = unseen(iter(split), self.cache)
        self.chars += sum(map(len, fresh))
        fresh.sort(key=len)
        at = 0
        while at < len(fresh):
            size, block = 0, []
            while at < len(fresh) and (not block or size + 4 * len(fresh[at]) <= ROUND_BYTES):
                block.append(fresh[at].encode("utf-8"))
                size += len(block[-1])
                at += 1
            self.cache.update(zip(fresh[at - len(block) : at], surviving_symbols(self.vocabulary, block).tolist()))
        get = self.cache.__getitem__
        return [sum(map(get, words)) for words in split]


@lru_cache(maxsize=2)
def counter(path: str) -> Counter:
    return Counter(path)


def token_counts(df: DataFrame, tokenizer_path: str, limit: int = 1024, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key``, n_bytes (UTF-8), n_tokens and over_limit (n_tokens > ``limit``) per row of ``df``.

    NULL texts count as empty (0 tokens, not over), NULL keys stay NULL, repeated rows are counted
    each, an empty table gives an empty one, further columns are left out.
    """

    def work(keys: list, texts: list[str]) -> list:
        tokens = counter(tokenizer_path).count(texts)
        return [keys, [len(t.encode("utf-8")) for t in texts], tokens, [n > limit for n in tokens]]

    schema = schema_of(f"`{key}` bigint, n_bytes bigint, n_tokens bigint, over_limit boolean")
    return map_texts(narrow(df, key, text), work, schema)
