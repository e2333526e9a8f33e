"""BPE encoding with a segment tree over adjacent pair ranks, and decoding.

Each leaf of the tree holds the rank of the pair that starts at a symbol, packed with its position,
and each inner node the smaller of its children. The root is thus the lowest-ranked pair, the
leftmost of equals. A merge changes three leaves at most, each by a walk to the root. Short
pre-tokens of like size are advanced together, one row of arrays each; a long one gets a tree of
its own.
"""

from __future__ import annotations

import hashlib
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame

from plumbline.llm.bytebpe import NO_RANK, Vocabulary, unseen
from plumbline.llm.common import CACHE_CHARS, map_texts, narrow, schema_of

CACHE_WORDS = 300_000
"""Pre-tokens whose ids a worker keeps."""
WIDEST = 64
"""Symbols of a pre-token up to which trees are advanced as rows of one array."""
ROWS = 1 << 14
"""Trees advanced together."""


def encode_rows(vocabulary: Vocabulary, words: list[bytes], width: int) -> list[list[int]]:
    """Ids of pre-tokens of 1 to ``width`` (a power of two) bytes."""
    n, pairs = len(words), vocabulary.pairs
    lengths = np.array([len(w) for w in words])
    place = np.arange(width)
    symbols = np.full((n, width), -1, np.int64)
    symbols[place < lengths[:, None]] = vocabulary.byte_ids[np.frombuffer(b"".join(words), np.uint8)]
    after = np.where(place + 1 < lengths[:, None], place + 1, width)  # width: no neighbour
    before = np.broadcast_to(place - 1, (n, width)).copy()
    tree = np.full((n, 2 * width), NO_RANK, np.int64)
    row, col = np.nonzero(after < width)
    slot = pairs.slots(symbols[row, col], symbols[row, col + 1])
    ranks = pairs.ranks[slot]
    tree[row, width + col] = np.where(ranks < NO_RANK, ranks * width + col, NO_RANK)
    level = width
    while level > 1:
        level //= 2
        tree[:, level : 2 * level] = np.minimum(tree[:, 2 * level : 4 * level : 2], tree[:, 2 * level + 1 : 4 * level : 2])

    def put(rows: np.ndarray, cols: np.ndarray) -> None:
        """New rank of the pairs that start at ``cols``, carried to the root."""
        follows = after[rows, cols]
        paired = np.flatnonzero((follows < width) & (symbols[rows, cols] >= 0))
        value = np.full(len(rows), NO_RANK, np.int64)
        found = pairs.ranks[pairs.slots(symbols[rows[paired], cols[paired]], symbols[rows[paired], follows[paired]])]
        value[paired] = np.where(found < NO_RANK, found * width + cols[paired], NO_RANK)
        node = width + cols
        tree[rows, node] = value
        while node[0] > 1:
            node = node // 2
            tree[rows, node] = np.minimum(tree[rows, 2 * node], tree[rows, 2 * node + 1])

    live = np.flatnonzero(tree[:, 1] < NO_RANK)
    while len(live):
        at = tree[live, 1] % width
        gone = after[live, at]
        symbols[live, at] = pairs.merged[pairs.slots(symbols[live, at], symbols[live, gone])]
        beyond = after[live, gone]
        after[live, at] = beyond
        linked = np.flatnonzero(beyond < width)
        before[live[linked], beyond[linked]] = at[linked]
        symbols[live, gone] = -1
        put(live, gone)
        put(live, at)
        prior = before[live, at]
        has = np.flatnonzero(prior >= 0)
        if len(has):
            put(live[has], prior[has])
        live = live[tree[live, 1] < NO_RANK]
    kept = symbols >= 0
    flat, ends = symbols[kept].tolist(), np.cumsum(kept.sum(axis=1)).tolist()
    return [flat[a:b] for a, b in zip([0, *ends[:-1]], ends)]


def encode_long(vocabulary: Vocabulary, word: bytes) -> list[int]:
    """Ids of one pre-token of any length."""
    merge_of = vocabulary.merge_of
    symbols = vocabulary.byte_ids[np.frombuffer(word, np.uint8)].tolist()
    n = len(symbols)
    size = 1 << max(0, n - 1).bit_length()
    none = int(NO_RANK) * size
    after, before = [*range(1, n), -1], list(range(-1, n - 1))

    def leaf(i: int) -> int:
        j = after[i]
        found = merge_of.get((symbols[i], symbols[j])) if j >= 0 and symbols[i] >= 0 else None
        return none if found is None else found[0] * size + i

    tree = [none] * size + [leaf(i) for i in range(n)] + [none] * (size - n)
    for k in range(size - 1, 0, -1):
        tree[k] = min(tree[2 * k], tree[2 * k + 1])
    while tree[1] < none:
        i = tree[1] % size
        j = after[i]
        symbols[i] = merge_of[symbols[i], symbols[j]][1]
        symbols[j] = -1
        after[i] = after[j]
        if after[j] >= 0:
            before[after[j]] = i
        for k in (j, i, before[i]):
            if k >= 0:
                node = size + k
                tree[node] = leaf(k)
                while node > 1:
                    node //= 2
                    tree[node] = min(tree[2 * node], tree[2 * node + 1])
    return [s for s in symbols if s >= 0]


Piece = tuple[tuple[int, ...], str, bytes]
"""Ids of a pre-token, the same as comma-joined decimals, and the bytes they decode to."""


class Codec:
    """Encodes and decodes texts; pre-tokens met before come from a bounded cache."""

    def __init__(self, path: str):
        self.vocabulary = Vocabulary(path)
        self.cache: dict[str, Piece] = {}
        self.forget()

    def forget(self) -> None:
        self.cache, self.chars = {s: self.piece([i]) for s, i in self.vocabulary.special.items()}, 0

    def piece(self, ids: list[int]) -> Piece:
        return tuple(ids), ",".join(map(str, ids)), b"".join(map(self.vocabulary.bytes_of.__getitem__, ids))

    def ids_of(self, words: list[str]) -> list[list[int]]:
        """Ids of pre-tokens, in their order."""
        raw = [w.encode("utf-8") for w in words]
        out: list = [[]] * len(raw)
        by_width: dict[int, list[int]] = {}
        for k, w in enumerate(raw):
            if len(w) > WIDEST:
                out[k] = encode_long(self.vocabulary, w)
            elif w:
                by_width.setdefault(1 << (len(w) - 1).bit_length(), []).append(k)
        for width, members in by_width.items():
            for a in range(0, len(members), ROWS):
                block = members[a : a + ROWS]
                for k, ids in zip(block, encode_rows(self.vocabulary, [raw[k] for k in block], width)):
                    out[k] = ids
        return out

    def encode(self, texts: list[str]) -> list[list[Piece]]:
        """Per text its encoded pre-tokens; their ids chained are the text's ids."""
        split = [self.vocabulary.pre_tokens(t) for t in texts]
        fresh = unseen(iter(split), self.cache)
        if len(self.cache) + len(fresh) > CACHE_WORDS or self.chars + sum(map(len, fresh)) > CACHE_CHARS:
            self.forget()
            fresh = unseen(iter(split), self.cache)
        self.chars += sum(map(len, fresh))
        self.cache.update(zip(fresh, map(self.piece, self.ids_of(fresh))))
        get = self.cache.__getitem__
        return [list(map(get, words)) for words in split]

    def decode(self, pieces: list[Piece]) -> str:
        return b"".join([p[2] for p in pieces]).decode("utf-8", "replace")


@lru_cache(maxsize=2)
def codec(path: str) -> Codec:
    return Codec(path)


def encode_texts(df: DataFrame, tokenizer_path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key`` and ids (array<int>) of every row's whole text.

    NULL and empty texts have no ids, NULL keys stay NULL, repeated rows are encoded each, an empty
    table gives an empty one, further columns are left out.
    """

    def work(keys: list, texts: list[str]) -> list:
        return [keys, [[i for ids, _, _ in pieces for i in ids] for pieces in codec(tokenizer_path).encode(texts)]]

    return map_texts(narrow(df, key, text), work, schema_of(f"`{key}` bigint, ids array<int>"))


def round_trip_digests(df: DataFrame, tokenizer_path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key``, n_tokens, and lowercase SHA-256 of the comma-joined decimal ids and of the text
    decoded from those ids. Rows are treated as in :func:`encode_texts`; ids do not leave the task."""

    def work(keys: list, texts: list[str]) -> list:
        own = codec(tokenizer_path)
        counts, digests, decoded = [], [], []
        for pieces in own.encode(texts):
            counts.append(sum([len(p[0]) for p in pieces]))
            digests.append(hashlib.sha256(",".join([p[1] for p in pieces]).encode()).hexdigest())
            decoded.append(hashlib.sha256(own.decode(pieces).encode("utf-8")).hexdigest())
        return [keys, counts, digests, decoded]

    schema = schema_of(f"`{key}` bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string")
    return map_texts(narrow(df, key, text), work, schema)
