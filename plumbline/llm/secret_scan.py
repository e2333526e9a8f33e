"""Secrets in texts: fixed patterns, and strings that look random to character Markov models.

Two first-order models, one of random strings and one of ordinary identifiers, are trained on
labelled samples; a run of token characters is reported where the random model explains it better
by a clear log-likelihood ratio.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from plumbline.llm.common import map_texts, narrow, schema_of, small_batches, text_chunks

# The three kinds of base secrets, in the order in which they are listed.
KINDS = ("assign", "access", "hex")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
LEAST = {"assign": 6, "access": 20, "hex": 24}
RANDOM = "random"

LONG = 20
"""Characters of a run that is scored; shorter words are the samples of identifiers."""
RUN = re.compile(r"[A-Za-z0-9+/_=-]{20,}")
WORD = re.compile(r"[A-Za-z_][A-Za-z0-9_]{3,}")
# A text without any of these has no span of any kind.
PLACES = (r"(?i:password|passwd|secret|token|api_?key)", r"AKIA[A-Z0-9]{16}", r"[0-9a-f]{24}", r"[A-Za-z0-9+/_=-]{20}")

ALPHABET = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/_=-"
EDGE = len(ALPHABET)
CODE = np.full(128, EDGE, np.int64)
CODE[np.frombuffer(ALPHABET.encode(), np.uint8)] = np.arange(len(ALPHABET))
SAMPLE_ROWS = 4_000
"""Texts, about, whose words and secrets train the models (all of a smaller table)."""
DRAWN = 400
"""Random strings drawn for each alphabet besides the secrets of the sample."""
LEAST_RATIO = 12.0
"""Nats by which the random model must explain a run better, and by 0.5 nats a character."""


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) in code points, leftmost non-overlapping within each kind."""
    out = [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= LEAST["assign"]]
    out += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text) if len(m[0]) >= LEAST["access"]]
    out += [(m.start(), m.end(), "hex") for m in HEX.finditer(text) if len(m[0]) >= LEAST["hex"]]
    return sorted(out, key=lambda s: (s[0], KINDS.index(s[2])))


def transitions(words: list[str]) -> np.ndarray:
    """Counts of adjacent characters, the edges of a word included."""
    counts = np.zeros((EDGE + 1) ** 2, np.int64)
    if words:
        codes = CODE[np.frombuffer(("\n" + "\n".join(words) + "\n").encode("ascii", "replace"), np.uint8) & 127]
        counts += np.bincount(codes[:-1] * (EDGE + 1) + codes[1:], minlength=len(counts))
    return counts


@dataclass(frozen=True)
class RandomStrings:
    """Log-likelihood ratio of each transition: random string against ordinary identifier."""

    ratio: np.ndarray

    @classmethod
    def of(cls, random_counts: np.ndarray, ordinary_counts: np.ndarray) -> RandomStrings:
        def logs(counts: np.ndarray) -> np.ndarray:
            table = counts.reshape(EDGE + 1, EDGE + 1).astype(float)
            single = table.sum(axis=0) + 1.0
            smooth = single / single.sum()  # backs off to single characters
            return np.log((table + 8 * smooth) / (table.sum(axis=1, keepdims=True) + 8))

        return cls(logs(random_counts) - logs(ordinary_counts))

    def score(self, run: str) -> float:
        """Sum over the transitions inside the run."""
        codes = CODE[np.frombuffer(run.encode("ascii"), np.uint8)]
        return float(self.ratio[codes[:-1], codes[1:]].sum())

    def spans(self, text: str, taken: list[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
        """Runs that look random and meet none of ``taken``."""
        out = []
        for m in RUN.finditer(text):
            score = self.score(m[0])
            if score > LEAST_RATIO and score > 0.5 * len(m[0]) and not any(a < m.end() and m.start() < b for a, b, _ in taken):
                out.append((m.start(), m.end(), RANDOM))
        return out


def drawn_counts(seed: int = 5) -> np.ndarray:
    """Transitions of strings drawn at random from the usual alphabets of keys."""
    rng = np.random.default_rng(seed)
    alphabets = (ALPHABET[:64], ALPHABET[:62], "0123456789abcdef", "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789", ALPHABET)
    words = ["".join(rng.choice(list(a), int(n))) for a in alphabets for n in rng.integers(20, 64, DRAWN)]
    return transitions(words)


def learn(docs: DataFrame, key: str = "doc_id", text: str = "text", sample: int = SAMPLE_ROWS) -> RandomStrings:
    """Models of a table: its base secrets and drawn strings against its words. Counting runs on the
    executors; what comes back is the two tables of transitions."""
    rows = narrow(docs, key, text)
    n = rows.count()
    share = sample / n if n > sample else 1.0
    picked = rows if share == 1.0 else rows.where(F.pmod(F.xxhash64("key", "text"), F.lit(1_000_000)) < F.lit(int(share * 1_000_000) + 1))
    schema = schema_of("kind int, cell int, n bigint")
    arrow = to_arrow_schema(schema)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals = np.zeros((2, (EDGE + 1) ** 2), np.int64)
        for _, texts in text_chunks(batches):
            for t in texts:
                spans = base_spans(t)
                totals[0] += transitions([t[a:b].split("=")[-1].split(":")[-1].strip("\"' ") if k == "assign" else t[a:b] for a, b, k in spans])
                totals[1] += transitions([m[0] for m in WORD.finditer(t) if len(m[0]) < LONG and not any(a < m.end() and m.start() < b for a, b, _ in spans)])
        kind, cell = np.nonzero(totals)
        yield pa.RecordBatch.from_arrays([pa.array(kind, pa.int32()), pa.array(cell, pa.int32()), pa.array(totals[kind, cell])], schema=arrow)

    totals = np.zeros((2, (EDGE + 1) ** 2), np.int64)
    for r in small_batches(picked).mapInArrow(count, schema).groupBy("kind", "cell").agg(F.sum("n").alias("n")).collect():  # at most two tables
        totals[r["kind"], r["cell"]] = r["n"]
    return RandomStrings.of(totals[0] + drawn_counts(), totals[1])


def _candidates(texts: list[str]) -> np.ndarray:
    held = pa.array(texts, pa.large_string())
    found = np.zeros(len(texts), bool)
    for pattern in PLACES:
        found |= pc.match_substring_regex(held, pattern).to_numpy(zero_copy_only=False)
    return found


def all_spans(model: RandomStrings, texts: list[str]) -> list[tuple[list, list]]:
    """Per text its base spans and those that the models add."""
    out: list = [([], [])] * len(texts)
    for k in np.flatnonzero(_candidates(texts)).tolist():
        base = base_spans(texts[k])
        out[k] = (base, model.spans(texts[k], base))
    return out


def _written(spans: list[tuple[int, int, str]]) -> str:
    return ",".join([f"{kind}:{a}:{b}" for a, b, kind in spans])


def secret_spans(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key``, n_assign, n_access, n_hex, base_sha256, spans, n_random of every row.

    NULL and empty texts have no spans, NULL keys stay NULL, repeated rows are scanned each, an
    empty table gives an empty one, further columns are left out.
    """
    model = learn(docs, key, text)

    def work(keys: list, texts: list[str]) -> list:
        counts: list[list[int]] = [[], [], []]
        digests, written, added = [], [], []
        for base, more in all_spans(model, texts):
            kinds = [s[2] for s in base]
            for c, kind in zip(counts, KINDS):
                c.append(kinds.count(kind))
            digests.append(hashlib.sha256(_written(base).encode()).hexdigest())
            written.append(_written(sorted(base + more, key=lambda s: (s[0], (*KINDS, RANDOM).index(s[2])))))
            added.append(len(more))
        return [keys, *counts, digests, written, added]

    schema = schema_of(f"`{key}` bigint, n_assign bigint, n_access bigint, n_hex bigint, base_sha256 string, spans string, n_random bigint")
    return map_texts(narrow(docs, key, text), work, schema)


def redact(text: str, spans: list[tuple[int, int, str]], put: str = "[SECRET]") -> str:
    """``text`` with every stretch covered by spans replaced."""
    out, at = [], 0
    for a, b, _ in sorted(spans):
        if a >= at:
            out += [text[at:a], put]
        at = max(at, b)
    return "".join([*out, text[at:]])


def without_secrets(docs: DataFrame, key: str = "doc_id", text: str = "text", length: str = "n_chars") -> DataFrame:
    """``docs`` with secrets replaced in the text and, where there is one, the column ``length``
    set to the new number of code points; all other rows and columns stay as they are.

    NULL texts and keys stay NULL, repeated rows are changed alike, an empty table gives an empty one,
    and further columns, whatever their names, are carried along.
    """
    model = learn(docs, key, text)
    at = docs.columns.index(text)
    size = docs.columns.index(length) if length in docs.columns else None
    schema = T.StructType([T.StructField(f.name, f.dataType) for f in docs.schema])
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = [c.cast(f.type) for c, f in zip(batch.columns, arrow)]
            texts = columns[at].to_pylist()
            known = [t if t is not None else "" for t in texts]
            found = [(k, base + more) for k, (base, more) in enumerate(all_spans(model, known)) if base or more]
            if found:
                sizes = columns[size].to_pylist() if size is not None else None
                for k, spans in found:
                    texts[k] = redact(texts[k], spans)
                    if sizes is not None:
                        sizes[k] = len(texts[k])
                columns[at] = pa.array(texts, arrow[at].type)
                if sizes is not None:
                    columns[size] = pa.array(sizes, arrow[size].type)
            yield pa.RecordBatch.from_arrays(columns, schema=arrow)

    return small_batches(docs).mapInArrow(run, schema)
