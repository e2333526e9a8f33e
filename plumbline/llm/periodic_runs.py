"""Periodic runs of words by online sparse diagonal dynamic programming.

Words are read in order. A diagonal of lag d holds how many words in a row equalled the word d
before them; each word lengthens the active diagonals whose earlier occurrence it meets and ends the
others, which emit their run at once if it is long enough.

An earlier occurrence opens a diagonal only where a run can begin: the block of words that ends here
(5 words, or the power of two above the lag) occurred before, its latest occurrence lies d words back
and the word before the block differs from the one d before it. A run of smallest period q and
4 q words or more has exactly one such place, as a block of q words or more recurs in it every q words
and not earlier; so every run is found, with its smallest period, and a text of n words takes
O(n log n) steps even if all its words are the same.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import map_texts, narrow, schema_of

SHORTEST, TIMES = 6, 4
"""A run has at least this many words, and at least this many periods (at least 4: the place where a
diagonal opens rests on it)."""
BLOCK = 5
"""Words that recur before a diagonal opens, at least (one less than the shortest run)."""
SPACE = r"[ \t\n\x0B\f\r]+"


def word_numbers(words: list[bytes]) -> np.ndarray:
    """Equal numbers for equal words."""
    seen: dict[bytes, int] = {}
    return np.array([seen.setdefault(w, len(seen)) for w in words], np.int64)


def _paired(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    return np.unique(left * (int(right.max()) + 1) + right, return_inverse=True)[1] if len(left) else left


def _lags(blocks: np.ndarray) -> np.ndarray:
    """Distance of each block to its latest earlier occurrence, 0 if there is none."""
    order = np.argsort(blocks, kind="stable")
    out = np.zeros(len(blocks), np.int64)
    same = blocks[order[1:]] == blocks[order[:-1]]
    out[order[1:][same]] = (order[1:] - order[:-1])[same]
    return out


def openings(ids: np.ndarray) -> list[tuple[int, int, int]]:
    """(word, lag, match length) at which diagonals open, in reading order."""
    n, found = len(ids), []
    if n <= BLOCK:
        return found
    pairs = _paired(ids[:-1], ids[1:])
    fours = _paired(pairs[:-2], pairs[2:])
    blocks, size, low, high = _paired(fours[:-1], fours[1:]), BLOCK, 1, 4  # lags low to high - 1
    whole, width = fours, 4
    while len(blocks):
        lags = _lags(blocks)
        if not lags.any():
            break
        at = np.flatnonzero((lags >= low) & (lags < high))
        if len(at):
            lag, before = lags[at], at - 1
            other = before - lag
            fresh = (other < 0) | (ids[np.maximum(before, 0)] != ids[np.maximum(other, 0)])
            found += [(int(i) + size - 1, int(d), size) for i, d in zip(at[fresh], lag[fresh])]
        if width * 2 > n:
            break
        whole, width = _paired(whole[:-width], whole[width:]), width * 2
        blocks, size, low, high = whole, width, width // 2, width
    return sorted(found)


def runs_of(ids: np.ndarray) -> list[tuple[int, int, int]]:
    """(start, length, period) of all maximal runs, by start, then period."""
    opened = openings(ids)
    if not opened:
        return []
    words, n, out = ids.tolist(), len(ids), []
    active: dict[int, int] = {}
    upcoming, at = 0, opened[0][0]
    while at < n or active:
        ended = [d for d in active if at == n or words[at] != words[at - d]]
        for d in ended:
            length = active.pop(d) + d
            if length >= max(SHORTEST, TIMES * d):
                out.append((at - length, length, d))
        if at == n:
            break
        for d in active:
            active[d] += 1
        while upcoming < len(opened) and opened[upcoming][0] == at:
            active[opened[upcoming][1]] = opened[upcoming][2]
            upcoming += 1
        at += 1
        if not active:
            if upcoming == len(opened):
                break
            at = opened[upcoming][0]
    return sorted(out, key=lambda r: (r[0], r[2]))


def collapsed(words: list[bytes], runs: list[tuple[int, int, int]]) -> bytes:
    """The words but those that a run holds after its first period, joined by one space."""
    if not runs:
        return b" ".join(words)
    kept = bytearray(b"\x01") * len(words)
    for start, length, period in runs:
        kept[start + period : start + length] = bytes(length - period)
    return b" ".join([w for w, k in zip(words, kept) if k])


def _work(keys: list, texts: list[str]) -> list:
    rows: list[list] = [[], [], [], []]
    for key, text in zip(keys, texts):
        words = text.encode("utf-8", "surrogatepass").split()
        runs = runs_of(word_numbers(words))
        for column, value in zip(rows, (key, len(words), [{"start": s, "length": m, "period": q} for s, m, q in runs], collapsed(words, runs).decode("utf-8", "replace"))):
            column.append(value)
    return rows


def periodic_runs(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key``, n_words, runs (array of start, length, period; by start, then period) and collapsed
    (the text's words without repetitions, joined by one space) of every row.

    Words are stretches of other than ASCII white space, numbered from 0. NULL and empty texts have
    no words and no runs; repeated rows and NULL keys each give a row; an empty table gives an empty
    one; further columns are left out. A text is read in one task, in time O(n log n) of its words.
    """
    out = "key bigint, n_words bigint, runs array<struct<start: bigint, length: bigint, period: bigint>>, collapsed string"
    return map_texts(narrow(df, key, text), _work, schema_of(out)).withColumnRenamed("key", key)


def with_repeats(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key`` and ``text``, where every tenth key by crc32 has its words repeated with a period p
    from word a on: word i >= a becomes word a + (i - a) % p. Rows without key or words stay."""
    h = F.crc32(F.col("key").cast("string").cast("binary"))
    words = F.filter(F.split("text", SPACE, -1), lambda w: w != "")
    n = F.size("_words").cast("bigint")
    g = F.expr("_h div 10")
    rows = narrow(df, key, text).withColumn("_h", h).withColumn("_hit", F.coalesce(F.col("_h") % 10 == 0, F.lit(False)))
    rows = rows.withColumn("_words", F.when(F.col("_hit"), words).otherwise(F.array().cast("array<string>")))
    rows = rows.withColumn("_a", F.when(n > 0, g % n)).withColumn("_p", F.expr("1 + (size(_words) - _a) div (3 + (_h div 10) % 8)"))

    def repeated(word: Column, i: Column) -> Column:
        return F.when(i < F.col("_a"), word).otherwise(F.get(F.col("_words"), (F.col("_a") + (i - F.col("_a")) % F.col("_p")).cast("int")))

    done = F.when(F.size("_words") > 0, F.array_join(F.transform("_words", repeated), " ")).otherwise(F.col("text"))
    return rows.select(F.col("key").alias(key), done.alias(text))


def digests(found: DataFrame, key: str = "doc_id") -> DataFrame:
    """One row of figures for each row of :func:`periodic_runs`: n_runs, the longest run (ties to the
    smallest start, then period; NULLs without runs) and SHA-256 digests of runs and collapsed text."""
    best = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    listed = F.transform("runs", lambda r: F.concat(r["start"].cast("string"), F.lit(","), r["length"].cast("string"), F.lit(","), r["period"].cast("string"), F.lit("\n")))
    rows = found.withColumn("_best", best)
    return rows.select(
        F.col(f"`{key}`"),
        F.size("runs").cast("bigint").alias("n_runs"),
        (-F.col("_best.start")).alias("start"),
        F.col("_best.length").alias("length"),
        (-F.col("_best.period")).alias("period"),
        F.expr("(1000 * _best.length) div (-_best.period)").alias("exponent_milli"),
        F.sha2(F.array_join(listed, ""), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
