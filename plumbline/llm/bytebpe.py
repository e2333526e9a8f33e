"""What the byte-level BPE operators share: the vocabulary file, pre-tokens and the pair table."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import numpy as np
import regex

NO_RANK = np.int64(1) << 40

# The white space and the pre-token pattern of byte-level BPE vocabularies.
WHITE = "\\t\\n\\x0b\\x0c\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
PRE_TOKEN = regex.compile(
    f"'s|'t|'re|'ve|'m|'ll|'d| ?\\p{{L}}+| ?\\p{{N}}+| ?[^{WHITE}\\p{{L}}\\p{{N}}]+|[{WHITE}]+(?![^{WHITE}])|[{WHITE}]+"
)

# The same pattern for texts of these characters only; the plain engine runs it faster.
LATIN_LETTERS, LATIN_NUMBERS = "A-Za-z\\xaa\\xb5\\xba\\xc0-\\xd6\\xd8-\\xf6\\xf8-\\u012f", "0-9\\xb2\\xb3\\xb9\\xbc-\\xbe"
NOT_LATIN = re.compile("[^\\t\\n\\r\\x20-\\x7e\\xa1-\\u012f]")
LATIN_PRE_TOKEN = re.compile(
    f" ?[{LATIN_LETTERS}]+| ?[{LATIN_NUMBERS}]+|'(?:s|t|re|ve|m|ll|d)"
    f"| ?[^\\t\\n\\r {LATIN_LETTERS}{LATIN_NUMBERS}]+|[\\t\\n\\r ]+(?![^\\t\\n\\r ])|[\\t\\n\\r ]+"
)


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte in a byte-level vocabulary: printable
    Latin-1 bytes stand for themselves, the rest for the letters from U+0100 on, in order."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(spare)) for b in range(256)]


class PairTable:
    """Rank and merged symbol of symbol pairs, looked up for whole arrays: pairs sit in an
    open-addressing table that is probed until every key is found or meets an empty slot."""

    BITS = 18

    def __init__(self, left: np.ndarray, right: np.ndarray, merged: np.ndarray):
        size = 1 << max(self.BITS, int(len(left) * 4).bit_length())
        self.mask = size - 1
        self.keys = np.full(size, -1, np.int64)
        self.ranks = np.full(size, NO_RANK, np.int64)
        self.merged = np.zeros(size, np.int64)
        keys = (left.astype(np.int64) << 32) | right
        for rank, (key, slot) in enumerate(zip(keys.tolist(), self._slot(keys).tolist())):
            while self.keys[slot] != -1:
                slot = (slot + 1) & self.mask
            self.keys[slot], self.ranks[slot], self.merged[slot] = key, rank, merged[rank]

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            mixed = keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        return ((mixed >> np.uint64(32)) & np.uint64(self.mask)).astype(np.int64)

    def slots(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Where each pair is, or an empty slot (its rank is NO_RANK)."""
        keys = (left.astype(np.int64) << 32) | right
        slot = self._slot(keys)
        held = self.keys[slot]
        open_ = np.flatnonzero((held != keys) & (held != -1))
        while len(open_):
            slot[open_] = (slot[open_] + 1) & self.mask
            held = self.keys[slot[open_]]
            open_ = open_[(held != keys[open_]) & (held != -1)]
        return slot


class Vocabulary:
    """A byte-level BPE vocabulary of a ``tokenizers`` JSON file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        pre = spec["pre_tokenizer"] or {}
        plain = pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space") and spec["normalizer"] is None
        if model["type"] != "BPE" or not plain or model.get("end_of_word_suffix") or model.get("ignore_merges"):
            raise ValueError(f"{path}: only plain byte-level BPE vocabularies are read")
        letters = byte_letters()
        byte_of = {c: b for b, c in enumerate(letters)}
        ids = model["vocab"]
        self.byte_ids = np.array([ids[c] for c in letters], np.int64)
        self.bytes_of = {i: bytes(byte_of[c] for c in word) for word, i in ids.items()}
        merges = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        left = np.array([ids[a] for a, _ in merges], np.int64)
        right = np.array([ids[b] for _, b in merges], np.int64)
        merged = np.array([ids[a + b] for a, b in merges], np.int64)
        self.pairs = PairTable(left, right, merged)
        self.merge_of = {(a, b): (r, m) for r, (a, b, m) in enumerate(zip(left.tolist(), right.tolist(), merged.tolist()))}
        self.special = {}
        for t in spec["added_tokens"]:
            if t["single_word"] or t["lstrip"] or t["rstrip"]:
                raise ValueError(f"{path}: added tokens that take in their surroundings are not read")
            self.special[t["content"]] = t["id"]
            self.bytes_of[t["id"]] = t["content"].encode()
        longest_first = sorted(self.special, key=len, reverse=True)
        self._specials = regex.compile("(" + "|".join(map(regex.escape, longest_first)) + ")") if longest_first else None

    def pre_tokens(self, text: str) -> list[str]:
        """Pre-tokens in order; strings of special tokens stay whole, as the library keeps them."""
        if self._specials is None or not any(s in text for s in self.special):
            return (PRE_TOKEN if NOT_LATIN.search(text) else LATIN_PRE_TOKEN).findall(text)
        out: list[str] = []
        for part in self._specials.split(text):
            if part in self.special:
                out.append(part)
            elif part:
                out.extend(PRE_TOKEN.findall(part))
        return out


def unseen(words: Iterator[list[str]], cache: dict) -> list[str]:
    fresh: set[str] = set()
    for w in words:
        fresh.update(w)
    return [w for w in fresh if w not in cache]
