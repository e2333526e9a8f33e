"""Packing token sequences into rows of a fixed length.

Each document is cut at multiples of the row length; whole rows stand alone and what remains (at
most one piece a document) is packed first-fit decreasing, in randomised groups of documents that
do not depend on each other. A tournament tree over the free room of a group's rows finds the first
row that can take a piece in logarithmic time.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from plumbline.llm.common import RecentWords, narrow, schema_of, small_batches, text_chunks
from plumbline.session import checkpoint

CACHE_WORDS = 150_000
"""Words whose ids a worker keeps (twice as many at most)."""
TOGETHER = 256
"""Texts or words given to the library at once."""
GROUP_PIECES = 4096
"""Pieces of a group on average."""
GROUP_SEQUENCES = 1 << 31
"""Sequence numbers set aside for each group."""

# Characters for which lower case, white space and words do not depend on their surroundings.
UNUSUAL = r"[^\t\n\r\x20-\x7e\x{a1}-\x{12f}]|<\|"
LETTERS, NUMBERS = "a-z\xaa\xb5\xba\xdf-\xf6\xf8-\u012f", "0-9\xb2\xb3\xb9\xbc-\xbe"
WORDS = re.compile(f"'(?:s|t|re|ve|m|ll|d)|[{LETTERS}]+|[{NUMBERS}]|[^{LETTERS}{NUMBERS}]+")


class WordTokenizer:
    """Ids (little-endian unsigned 32-bit) by the ``tokenizers`` library. Where its file splits at
    white space and lower-cases, texts of usual characters are looked up by white-space-separated
    part, each different part once a batch, the library being asked for new words only; other texts go to the library whole."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        steps = [s["type"] for s in (spec["normalizer"] or {}).get("normalizers", [])]
        splits = [s.get("pattern", {}).get("Regex") for s in (spec["pre_tokenizer"] or {}).get("pretokenizers", [])]
        # Fixed value: the pattern that WORDS stands for.
        known = "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"
        self.by_word = steps == ["NFC", "Replace", "Lowercase"] and splits[:1] == [known]
        self.words = RecentWords(CACHE_WORDS)

    def whole(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as it stands, :data:`TOGETHER` texts at a time (the library's encodings take
        many times the room of their ids)."""
        out: list[bytes] = []
        for a in range(0, len(texts), TOGETHER):
            encoded = self.library.encode_batch_fast(texts[a : a + TOGETHER], add_special_tokens=False)
            out += [np.array(e.ids, "<u4").tobytes() for e in encoded]
        return out

    def _ids_of_parts(self, parts: list[str]) -> list[bytes]:
        cut = [WORDS.findall(p.lower()) for p in parts]
        new = self.words.absent(set(chain.from_iterable(cut)))
        self.words.young.update(zip(new, self.whole(new)))
        get = self.words.young.__getitem__
        return [get(w[0]) if len(w) == 1 else b"".join(map(get, w)) for w in cut]

    def _by_part(self, texts: pa.Array) -> list[bytes]:
        split = pc.ascii_split_whitespace(texts)
        coded = split.flatten().dictionary_encode()
        known = self._ids_of_parts(coded.dictionary.to_pylist())
        sizes = np.fromiter(map(len, known), np.int64, len(known)) // 4
        starts, pool = np.cumsum(sizes) - sizes, np.frombuffer(b"".join(known), "<u4")
        part = coded.indices.to_numpy()
        counts = sizes[part]
        ends = np.concatenate([[0], np.cumsum(counts)])
        ids = pool[np.repeat(starts[part] - ends[:-1], counts) + np.arange(ends[-1])]
        cuts = ends[split.offsets.to_numpy() - split.offsets[0].as_py()]
        return [ids[x:y].tobytes() for x, y in zip(cuts[:-1], cuts[1:])]

    def ids(self, texts: list[str]) -> list[bytes]:
        if not self.by_word:
            return self.whole(texts)
        held = pa.array(texts, pa.large_string())
        unusual = pc.match_substring_regex(held, UNUSUAL).to_numpy(zero_copy_only=False)
        out: list = [b""] * len(texts)
        apart = np.flatnonzero(unusual).tolist()
        for k, ids in zip(apart, self.whole([texts[k] for k in apart])):
            out[k] = ids
        usual = np.flatnonzero(~unusual)
        for k, ids in zip(usual.tolist(), self._by_part(held.take(usual)) if len(usual) else []):
            out[k] = ids
        return out


@lru_cache(maxsize=2)
def word_tokenizer(path: str) -> WordTokenizer:
    return WordTokenizer(path)


class Rooms:
    """Free room of numbered bins as a tournament tree: each node holds the most room below it."""

    def __init__(self, bins: int, capacity: int):
        self.size = 1 << max(0, bins - 1).bit_length()
        self.most = [0] * (2 * self.size)
        self.most[self.size : self.size + bins] = [capacity] * bins
        for k in range(self.size - 1, 0, -1):
            self.most[k] = max(self.most[2 * k], self.most[2 * k + 1])

    def first_with(self, need: int) -> int:
        """The lowest bin with room for ``need``, or -1."""
        if self.most[1] < need:
            return -1
        k = 1
        while k < self.size:
            k *= 2
            if self.most[k] < need:
                k += 1
        return k - self.size

    def take(self, bin_: int, used: int) -> None:
        k = bin_ + self.size
        self.most[k] -= used
        while k > 1:
            k //= 2
            self.most[k] = max(self.most[2 * k], self.most[2 * k + 1])


def first_fit_decreasing(lengths: list[int], capacity: int) -> list[int]:
    """Bin of every piece (each at most ``capacity`` long)."""
    rooms = Rooms(max(1, len(lengths)), capacity)
    out = [0] * len(lengths)
    for k in sorted(range(len(lengths)), key=lambda k: -lengths[k]):
        out[k] = rooms.first_with(lengths[k])
        rooms.take(out[k], lengths[k])
    return out


def packed_tokens(df: DataFrame, tokenizer_path: str, capacity: int = 4096, end_id: int = 2, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per piece: ``key``, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    A document is its ids and ``end_id``; pieces cover each id once. Groups are drawn by hashing the
    number of the tokenised row, so equal rows and equal keys spread. NULL and empty texts give the
    one id ``end_id``, NULL keys stay NULL, an empty table gives an empty one, further columns are
    left out.
    """
    cut_schema = schema_of("key bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint")
    arrow = to_arrow_schema(cut_schema)
    last = np.array([end_id], "<u4").tobytes()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for keys, texts in text_chunks(batches):
            rows = []
            for k, ids in zip(keys, word_tokenizer(tokenizer_path).ids(texts)):
                ids += last
                n = len(ids) // 4
                rows += [(k, a, min(capacity, n - a), zlib.crc32(ids[4 * a : 4 * (a + capacity)]), n) for a in range(0, n, capacity)]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), arrow)], schema=arrow)

    # A narrow table: its numbers of rows stay as they are when an executor is lost.
    pieces = checkpoint(small_batches(narrow(df, key, text)).mapInArrow(cut, cut_schema)).withColumn("row", F.monotonically_increasing_id())
    groups = max(1, -(-pieces.count() // GROUP_PIECES))

    def pack(group: pd.DataFrame) -> pd.DataFrame:
        lengths = group["length"].to_numpy()
        bins = np.array(first_fit_decreasing(lengths.tolist(), capacity), np.int64)
        order = np.lexsort((group["row"].to_numpy(), bins))
        ends = np.cumsum(lengths[order])
        begins = ends - lengths[order]
        first = np.ones(len(order), bool)
        first[1:] = bins[order][1:] != bins[order][:-1]
        offset = begins - np.maximum.accumulate(np.where(first, begins, 0))
        out = group.iloc[order].assign(offset=offset, sequence_id=group["group"].iloc[0] * GROUP_SEQUENCES + bins[order])
        return out[["key", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]]

    schema = "key bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint"
    dealt = pieces.withColumn("group", F.pmod(F.xxhash64("row"), F.lit(groups)))
    packed = dealt.groupBy("group").applyInPandas(pack, schema)
    return packed.withColumnRenamed("key", key)
