"""Spelling variants: words within one edit of each other, by dynamic programming down sorted lists.

Two words within one edit share their first half or the rest of their letters, so each word is filed
under both (for its own length and for the one below, as words may differ by a letter). A list of
words filed together is sorted without what they share. Each word is compared with those after it by
rows of a banded edit matrix, one for each letter of the other word; rows are kept for as many letters
as the next word shares with this one, and where a row exceeds one edit all words that share its
letters are skipped. Long lists are filed again, under halves of what is still free, until a list is
short or only one letter is free (then the alphabet bounds it): no list is one task's burden, and no
pair is looked at in two lists.
"""

from __future__ import annotations

import re
import zlib
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from plumbline.llm.common import BATCH_ROWS, narrow, schema_of, small_batches, text_chunks
from plumbline.session import broadcast_if_small, checkpoint, lookup

LETTERS = bytes(c | 0x20 if 0x41 <= c <= 0x5A else c if 0x61 <= c <= 0x7A or c >= 0xC0 else 0x20 for c in range(256))
"""Latin-1 code points: A-Z lower-cased, other letters as they are, all else a space."""
OTHER = re.compile("[^\u0000-ÿ]+")
HELD_WORDS = 200_000
"""Different words that a task counts before it passes their counts on."""
LIST_WORDS = 256
"""Longest list that is not filed again while more than one letter is free."""
TOP = chr(0x10FFFF)


def words_of(text: str) -> list[bytes]:
    """Runs of Latin letters, A-Z lower-cased, as Latin-1 bytes (one a code point)."""
    try:
        raw = text.encode("latin-1")
    except UnicodeEncodeError:
        raw = OTHER.sub(" ", text).encode("latin-1")
    return raw.translate(LETTERS).split()


def counted(key: int | None, text: str, least: int, drop_every: int | None, into: dict[bytes, int]) -> None:
    """Adds the words of a text, of ``least`` letters or more, to ``into``. Those whose crc32 of
    ``key:word`` is divisible by ``drop_every`` lose the letter that it numbers."""
    prefix = zlib.crc32(b"%d:" % key if key is not None else b":")
    crc = zlib.crc32
    for word, n in Counter(words_of(text)).items():
        if drop_every is not None:
            h = crc(word if word.isascii() else word.decode("latin-1").encode(), prefix)
            if h % drop_every == 0:
                at = h % len(word)
                word = word[:at] + word[at + 1 :]
        if len(word) >= least:
            into[word] = into.get(word, 0) + n


def vocabulary(df: DataFrame, key: str = "doc_id", text: str = "text", least_letters: int = 5, least_count: int = 3, drop_every: int | None = None) -> DataFrame:
    """word, n: the words of all texts with at least ``least_letters`` and ``least_count``."""
    schema = to_arrow_schema(schema_of("word string, n bigint"))

    def flush(held: dict[bytes, int]) -> Iterator[pa.RecordBatch]:
        words = [w.decode("latin-1") for w in held]
        yield pa.RecordBatch.from_arrays([pa.array(words, pa.string()), pa.array(list(held.values()), pa.int64())], schema=schema)
        held.clear()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[bytes, int] = {}
        for keys, texts in text_chunks(batches):
            for k, t in zip(keys, texts):
                counted(k, t, least_letters, drop_every, held)
                if len(held) >= HELD_WORDS:
                    yield from flush(held)
        yield from flush(held)

    partial = small_batches(narrow(df, key, text)).mapInArrow(work, "word string, n bigint")
    return partial.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least_count)


def filed(rows: DataFrame, free: Column) -> DataFrame:
    """Each row filed anew under the first half and under the rest of its free letters. ``free``: how
    many of the shorter word's are free; ``below``: pairs that share this many are another list's."""
    head, whole = F.floor(free / 2).cast("int"), F.length("mid")
    tail = (free - head).cast("int")
    front = F.struct(
        F.concat_ws(" ", "list", F.lit("<"), F.substring("mid", F.lit(1), head)).alias("list"),
        F.col("mid").substr(head + 1, whole).alias("mid"),
        tail.alias("free"),
        (F.col("below") - head).cast("int").alias("below"),
    )
    back = F.struct(
        F.concat_ws(" ", "list", F.lit(">"), F.col("mid").substr(whole - tail + 1, whole)).alias("list"),
        F.col("mid").substr(F.lit(1), whole - tail).alias("mid"),
        head.alias("free"),
        F.least("below", head).alias("below"),
    )
    both = F.when(head > 0, F.array(front, back)).otherwise(F.array(front))
    return rows.withColumn("at", F.explode(both)).select("word", "n", "own", "at.list", "at.mid", "at.free", "at.below")


def lists(words: DataFrame, longest: int = LIST_WORDS) -> DataFrame:
    """word, n, own (0 where filed as the longer of a pair), list, mid, free, below."""
    size = F.length("word")
    lengths = F.array(F.struct(size.alias("m"), F.lit(1).alias("own")), F.struct((size - 1).alias("m"), F.lit(0).alias("own")))
    rows = words.withColumn("as", F.explode(lengths)).where("`as`.m > 0")
    rows = rows.select("word", "n", "as.own", F.col("as.m").cast("string").alias("list"), F.col("word").alias("mid"), F.col("as.m").alias("free"), F.lit(1 << 30).alias("below"))
    now = checkpoint(filed(rows, F.col("free")))
    done = None
    while True:
        crowded = checkpoint(now.where("free > 1").groupBy("list").agg(F.count(F.lit(1)).alias("words")).where(F.col("words") > longest).select("list"))
        if crowded.isEmpty():
            return now if done is None else done.unionByName(now)
        crowded = broadcast_if_small(crowded)
        short = checkpoint(now.join(crowded, "list", "left_anti").select(*now.columns))
        done = short if done is None else done.unionByName(short)
        now = checkpoint(filed(now.join(crowded, "list", "left_semi").select(*now.columns), F.col("free")))


def shared(a: str, b: str) -> int:
    n = 0
    for x, y in zip(a, b):
        if x != y:
            break
        n += 1
    return n


def near_in_list(mids: list[str], below: int = 1 << 30) -> Iterator[tuple[int, int]]:
    """(i, j), i < j: all pairs of the sorted ``mids`` within one edit that share fewer than ``below``
    first letters. Equal mids are no pair."""
    n = len(mids)
    for i in range(n - 1):
        x = mids[i]
        size = len(x)
        padded = x + "\0\0"
        rows = [(2, 0, 1 if size else 2)]  # row t, letters t-1, t, t+1 of x: edits to make t letters of y of them
        j = i + 1
        while j < n:
            y = mids[j]
            t, end = len(rows) - 1, len(y)
            low, mid, high = rows[t]
            while t < end:
                c = y[t]
                a = low if t and x[t - 1 : t] == c else low + 1
                if mid + 1 < a:
                    a = mid + 1
                b = mid if padded[t : t + 1] == c else mid + 1
                b = min(b, high + 1, a + 1)
                if t + 1 > size:
                    b = 2
                d = high if padded[t + 1 : t + 2] == c else high + 1
                d = 2 if t + 2 > size else min(d, b + 1)
                low, mid, high = min(a, 2), min(b, 2), min(d, 2)
                if t > size:
                    low = 2
                if low > 1 and mid > 1 and high > 1:
                    break
                rows.append((low, mid, high))
                t += 1
            else:
                off = size - end  # rows[end] has the letters end-1, end, end+1 of x
                if -1 <= off <= 1 and rows[end][off + 1] == 1 and (below > size or shared(x, y) < below):
                    yield i, j
            following = j + 1
            if t < end and following < n:  # no word with these t + 1 letters is near
                if mids[following].startswith(y[: t + 1]):
                    following = bisect_left(mids, y[: t + 1] + TOP, following)
            if following < n:
                del rows[shared(y, mids[following]) + 1 :]
            j = following


def near_words(words: DataFrame, longest: int = LIST_WORDS) -> DataFrame:
    """word, n_near, form, form_n for words (``word`` distinct, ``n``) that have near words: how many,
    and the most frequent one (ties: the first in code-point order)."""
    schema = to_arrow_schema(schema_of("word string, near bigint, best string, best_n bigint"))

    def of_list(rows: list[tuple]) -> Iterator[tuple]:
        names, counts, own = [r[0] for r in rows], [r[1] for r in rows], [r[2] for r in rows]
        near: dict[int, int] = {}
        best: dict[int, int] = {}
        for i, j in near_in_list([r[4] for r in rows], rows[0][5]):
            if not (own[i] or own[j]):
                continue  # both are longer: a pair of another list
            for a, b in ((i, j), (j, i)):
                near[a] = near.get(a, 0) + 1
                k = best.get(a)
                if k is None or counts[b] > counts[k] or counts[b] == counts[k] and names[b] < names[k]:
                    best[a] = b
        for a, k in best.items():
            yield names[a], near[a], names[k], counts[k]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []

        def full() -> pa.RecordBatch:
            batch = pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)
            out.clear()
            return batch

        held: list[tuple] = []
        for b in batches:
            for row in zip(*[c.to_pylist() for c in b.columns]):
                if held and held[0][3] != row[3]:
                    if len(held) > 1:
                        out.extend(of_list(held))
                        if len(out) >= BATCH_ROWS:
                            yield full()
                    held = []
                held.append(row)
        if len(held) > 1:
            out.extend(of_list(held))
        if out:
            yield full()

    dealt = lists(words, longest).select("word", "n", "own", "list", "mid", "below").repartition("list").sortWithinPartitions("list", "mid", "word")
    found = small_batches(dealt).mapInArrow(work, "word string, near bigint, best string, best_n bigint")
    best = F.min(F.struct((-F.col("best_n")).alias("n"), F.col("best").alias("word")))
    return found.groupBy("word").agg(F.sum("near").alias("n_near"), best.alias("b")).select("word", "n_near", F.col("b.word").alias("form"), (-F.col("b.n")).alias("form_n"))


def roots(forms: DataFrame) -> DataFrame:
    """word, root of (word, form): forms followed to the last one, doubling the steps each round."""
    now = checkpoint(forms.select("word", F.col("form").alias("root")))
    while True:
        onward = lookup(now.select(F.col("word").alias("root"), F.col("root").alias("next")))
        now = checkpoint(now.join(onward, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
        if now.where("moved").isEmpty():
            return now.select("word", "root")
        now = now.drop("moved")


def variant_groups(
    df: DataFrame, key: str = "doc_id", text: str = "text", least_letters: int = 5, least_count: int = 3, times: int = 2, drop_every: int | None = None, longest: int = LIST_WORDS
) -> DataFrame:
    """word, n, n_near, form, form_n, root of every word of :func:`vocabulary`: its form is its most
    frequent near word (one letter inserted, deleted or replaced; ties: first in code-point order) if
    that is at least ``times`` (2 or more) as frequent, else NULL; its root is the last of its forms'
    forms, itself without any.

    NULL texts have no words, a NULL key counts as an empty one, repeated rows count each; an empty
    table gives an empty one; further columns take no part.
    """
    if times < 2:
        raise ValueError("forms must be more frequent than their words")
    words = checkpoint(vocabulary(df, key, text, least_letters, least_count, drop_every))
    near = near_words(words, longest)
    told = words.join(near, "word", "left").withColumn("kept", F.coalesce(F.col("form_n") >= times * F.col("n"), F.lit(False)))
    told = checkpoint(
        told.select("word", "n", F.coalesce("n_near", F.lit(0).cast("bigint")).alias("n_near"), F.when(F.col("kept"), F.col("form")).alias("form"), F.when(F.col("kept"), F.col("form_n")).alias("form_n"))
    )
    ends = roots(told.where("form is not null"))
    return told.join(ends, "word", "left").withColumn("root", F.coalesce("root", "word"))
