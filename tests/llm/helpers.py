"""Small tables for the text operators' tests."""

from __future__ import annotations

import random

DOC = "doc_id bigint, text string, lang string, source string, n_chars bigint"
ODD = "key string, score double, fp bigint, statistics string, b int, n_tokens string"


def documents(spark, texts, first=0, odd=False):
    """A documents table; ``odd`` adds columns whose names operators use inside or for results."""
    rows = [(first + k, t, "en", "s", None if t is None else len(t)) for k, t in enumerate(texts)]
    schema = DOC
    if odd:
        rows = [(*r, "k", 0.5, 7, "x", 3, "y") for r in rows]
        schema = f"{DOC}, {ODD}"
    return spark.createDataFrame(rows, schema)


def edge_texts(seed=1):
    rng = random.Random(seed)
    words = "the of and a in is alpha beta gamma delta running tables quickly".split()
    sentence = lambda n: " ".join(rng.choice(words) for _ in range(n)).capitalize() + "."
    base = [sentence(rng.randint(5, 30)) + "\n" + sentence(12) for _ in range(12)]
    odd = [None, "", " ", "\n\n", "x", "é日本 😀 ½ don't we'll", "<|endoftext|> in text", "\tTabs  and   spaces \r\n", "a" * 3000]
    return [*base, *odd, base[0], base[0], "\n".join(sentence(40) for _ in range(300))]


def rows(df):
    return [r.asDict() for r in df.collect()]
