"""Text quality by a sparse rule ensemble.

Shallow trees grown on statistics of labelled texts give conjunctive rules (every path from the
root), a lasso-penalised logistic regression keeps the few that matter, and these become Spark
column expressions. Only the fit runs on the driver, over a bounded sample; statistics come from
Arrow batches and scores from the compiled expression.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.llm.common import hash_sample, small_batches, text_chunks

SAMPLE_ROWS = 12_000
"""Labelled rows that a fit reads at most: those with the smallest hashes."""

PENALTIES, SLACK = (0.03, 0.01, 0.003, 0.001), 0.02
"""L1 penalties tried, and the mean log-loss by which a larger one may be worse."""

STATISTICS = (
    "chars", "words", "lines", "word_length", "line_length", "upper", "digits", "symbols", "stops", "spaces", "wide",
    "distinct_words", "distinct_lines", "short_words", "wordless", "capital_words", "commonest",
)

_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True
_STOP = np.isin(np.arange(256), np.frombuffer(b".,;:?", np.uint8))
_SPACE = np.isin(np.arange(256), np.frombuffer(b" \t\n\r\x0b\x0c", np.uint8))
_LETTER = _UPPER | np.isin(np.arange(256), np.arange(97, 123)) | (np.arange(256) >= 128)
_SYMBOL = ~(_LETTER | _DIGIT | _STOP | _SPACE)


def statistics(text: str) -> tuple[float, ...]:
    """Values of :data:`STATISTICS` over the whole text; shares are 0 where there is nothing to
    share."""
    raw = text.encode("utf-8", "surrogatepass")
    bytes_ = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    words, lines = raw.split(), raw.split(b"\n") if raw else []
    n, total = max(1, len(words)), max(1, len(raw))
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    distinct = set(words)
    share = lambda mask: float(bytes_[mask].sum()) / total
    wordless = sum(words.count(w) for w in distinct if len(w) <= 2 and not w.isalnum() and w[0] < 128)
    return (
        float(len(text)), float(len(words)), float(len(lines)), float(lengths.sum()) / n, len(words) / max(1, len(lines)),
        share(_UPPER), share(_DIGIT), share(_SYMBOL), share(_STOP), share(_SPACE), share(np.arange(256) >= 128),
        len(distinct) / n, len(set(lines)) / max(1, len(lines)), float((lengths <= 3).sum()) / n, wordless / n,
        sum(map(bytes.isupper, words)) / n, float(bytes_[_SYMBOL].max()) / total,
    )


def with_statistics(df: DataFrame, text: str = "text", name: str = "statistics") -> DataFrame:
    """``df`` with a struct column of the statistics of its text (NULL: empty)."""
    if name in df.columns:
        raise ValueError(f"there is a column {name} already")
    schema = T.StructType([*df.schema.fields, T.StructField(name, T.StructType([T.StructField(s, T.DoubleType()) for s in STATISTICS]))])
    at = df.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held = pa.RecordBatch.from_arrays([pa.nulls(len(batch)), batch.column(at).cast(pa.large_string()).fill_null("")], ["key", "text"])
            rows = [statistics(t) for _, texts in text_chunks([held]) for t in texts]
            values = np.array(rows, np.float64).reshape(len(rows), len(STATISTICS))
            struct = pa.StructArray.from_arrays([pa.array(values[:, k]) for k in range(len(STATISTICS))], list(STATISTICS))
            yield pa.RecordBatch.from_arrays([*batch.columns, struct], [*batch.schema.names, name])

    return small_batches(df).mapInArrow(run, schema)


@dataclass(frozen=True)
class Rule:
    """A conjunction of (statistic, threshold, above): value > threshold or value <= threshold."""

    terms: tuple[tuple[int, float, bool], ...]

    def holds(self, x: np.ndarray) -> np.ndarray:
        out = np.ones(len(x), bool)
        for k, t, above in self.terms:
            out &= (x[:, k] > t) == above
        return out

    def column(self, name: str) -> Column:
        out = F.lit(True)
        for k, t, above in self.terms:
            value = F.col(name)[STATISTICS[k]]
            out = out & ((value > F.lit(t)) if above else (value <= F.lit(t)))
        return out


@dataclass(frozen=True)
class RuleModel:
    intercept: float
    rules: tuple[Rule, ...]
    weights: tuple[float, ...]

    def score(self, x: np.ndarray) -> np.ndarray:
        z = np.full(len(x), self.intercept)
        for rule, w in zip(self.rules, self.weights):
            z += w * rule.holds(x)
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))

    def column(self, name: str = "statistics") -> Column:
        """The score as an expression over the struct column ``name``."""
        z = F.lit(self.intercept)
        for rule, w in zip(self.rules, self.weights):
            z = z + F.when(rule.column(name), F.lit(w)).otherwise(F.lit(0.0))
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-F.greatest(F.least(z, F.lit(30.0)), F.lit(-30.0))))


def _grow(x: np.ndarray, target: np.ndarray, rows: np.ndarray, features: np.ndarray, terms: tuple, depth: int, least: int, found: list) -> np.ndarray:
    """Squared-error tree on ``rows``; appends every path to ``found`` and returns the fitted step."""
    step = np.zeros(len(x))
    step[rows] = target[rows].mean()
    if terms:
        found.append(Rule(terms))
    if depth == 0 or len(rows) < 2 * least:
        return step
    best, total, n = (0.0, None), target[rows].sum(), len(rows)
    for k in features:
        order = np.argsort(x[rows, k], kind="stable")
        values, sums = x[rows, k][order], np.cumsum(target[rows][order])
        left = np.arange(1, n)
        gain = sums[:-1] ** 2 / left + (total - sums[:-1]) ** 2 / (n - left) - total**2 / n
        gain[(values[1:] <= values[:-1]) | (left < least) | (n - left < least)] = 0
        i = int(np.argmax(gain)) if n > 1 else 0
        if n > 1 and gain[i] > best[0] + 1e-9:
            best = (gain[i], (k, float((values[i] + values[i + 1]) / 2)))
    if best[1] is None:
        return step
    k, t = best[1]
    above = x[rows, k] > t
    for side, part in ((False, rows[~above]), (True, rows[above])):
        inner = _grow(x, target, part, features, (*terms, (int(k), t, side)), depth - 1, least, found)
        step[part] = inner[part]
    return step


def grow_rules(x: np.ndarray, y: np.ndarray, trees: int = 40, depth: int = 3, seed: int = 7) -> list[Rule]:
    """Paths of boosted trees, each on half of the rows and half of the statistics, without
    repeats."""
    rng = np.random.default_rng(seed)
    z, found = np.full(len(x), np.log((y.mean() + 1e-3) / (1 - y.mean() + 1e-3))), []
    for _ in range(trees):
        rows = np.flatnonzero(rng.random(len(x)) < 0.5)
        features = rng.permutation(x.shape[1])[: max(1, (x.shape[1] + 1) // 2)]
        if len(rows):
            p = 1 / (1 + np.exp(-z))
            terms: list[Rule] = []
            _grow(x, y - p, rows, features, (), depth, max(5, len(rows) // 200), terms)
            for rule in terms:
                held = rule.holds(x)
                if held.any():
                    z[held] += 0.3 * (y - p)[held].mean()
            found += terms
    return list(dict.fromkeys(found))


def fit_lasso(h: np.ndarray, y: np.ndarray, penalty: float, steps: int = 400) -> tuple[float, np.ndarray]:
    """Logistic weights of standardised 0/1 columns (float32) under an L1 penalty, by accelerated
    proximal gradient steps; the intercept is not penalised. The standardised columns are never laid
    out: products with them come from ``h`` itself."""
    n = len(h)
    mean = h.mean(axis=0, dtype=np.float64)
    spread = np.maximum(np.sqrt(mean * (1 - mean)), 0.05)
    times = lambda v: v[0] + h @ (v[1:] / spread).astype(np.float32) - float(mean @ (v[1:] / spread))
    back = lambda r: np.concatenate([[r.sum()], (r.astype(np.float32) @ h - mean * r.sum()) / spread])
    v = np.ones(h.shape[1] + 1)
    largest = 1.0
    for _ in range(30):  # the largest eigenvalue, for the step length
        v /= np.linalg.norm(v)
        v = back(times(v)) / n
        largest = np.linalg.norm(v)
    rate = 4 / (1.1 * max(largest, 1.0))
    w = v = np.zeros(h.shape[1] + 1)
    t = 1.0
    for _ in range(steps):
        slope = back(1 / (1 + np.exp(-np.clip(times(v), -30, 30))) - y) / n
        new = v - rate * slope
        new[1:] = np.sign(new[1:]) * np.maximum(np.abs(new[1:]) - rate * penalty, 0)
        t_new = (1 + np.sqrt(1 + 4 * t * t)) / 2
        v, w, t = new + (t - 1) / t_new * (new - w), new, t_new
    weights = w[1:] / spread
    return float(w[0] - weights @ mean), weights


def fit_rules(x: np.ndarray, y: np.ndarray, seed: int = 7) -> RuleModel:
    """The ensemble; its penalty is the largest that comes close to the best on a fifth of the rows, so
    that few rules are kept. Without two classes the score is
    the smoothed share of label 1."""
    share = (y.sum() + 1.0) / (len(y) + 2.0)
    if len(y) < 20 or y.min() == y.max():
        return RuleModel(float(np.log(share / (1 - share))), (), ())
    rules = grow_rules(x, y, seed=seed)
    if not rules:
        return RuleModel(float(np.log(share / (1 - share))), (), ())
    h = np.empty((len(x), len(rules)), np.float32)
    for k, r in enumerate(rules):
        h[:, k] = r.holds(x)
    test = np.random.default_rng(seed).random(len(y)) < 0.2
    losses = {}
    for penalty in PENALTIES:
        b, w = fit_lasso(h[~test], y[~test], penalty, 200)
        p = np.clip(1 / (1 + np.exp(-np.clip(b + h[test] @ w, -30, 30))), 1e-6, 1 - 1e-6)
        losses[penalty] = -(y[test] * np.log(p) + (1 - y[test]) * np.log(1 - p)).mean() if test.any() else 0.0
    chosen = max(k for k, loss in losses.items() if loss <= min(losses.values()) + SLACK)
    b, w = fit_lasso(h, y, chosen)
    kept = np.flatnonzero(np.abs(w) > 1e-6)
    return RuleModel(b, tuple(rules[k] for k in kept), tuple(float(w[k]) for k in kept))


def held_out(key: Column) -> Column:
    """Rows never learned from: CRC-32 of the key as text leaves 1 modulo 3 (NULL: learned from
    never, held out not)."""
    return F.coalesce(F.crc32(key.cast("bigint").cast("string").cast("binary")) % 3 == 1, F.lit(False))


def training_rows(docs: DataFrame, labels: DataFrame, label: str = "quality", key: str = "doc_id", text: str = "text", bound: int = SAMPLE_ROWS) -> DataFrame:
    """statistics and y of at most ``bound`` labelled rows outside the held-out third; labels other
    than 0 and 1 and NULL keys are passed over."""
    known = labels.select(F.col(f"`{key}`").cast("bigint").alias("key"), F.col(f"`{label}`").cast("int").alias("y"))
    known = known.where(F.col("key").isNotNull() & F.col("y").isin(0, 1) & ~held_out(F.col("key")))
    hashed = hash_sample(known, bound, "key", "y")
    # At most ``bound`` rows of three numbers, so the broadcast is bounded.
    rows = docs.select(F.col(f"`{key}`").cast("bigint").alias("key"), F.col(f"`{text}`").alias("text")).join(F.broadcast(hashed), "key")
    sampled = with_statistics(rows.select("key", "y", F.coalesce("text", F.lit("")).alias("text")), "text").drop("text")
    return sampled.orderBy("key", "y", "statistics").limit(bound).select("y", "statistics")


def learn(docs: DataFrame, labels: DataFrame, label: str = "quality", key: str = "doc_id", text: str = "text", bound: int = SAMPLE_ROWS) -> RuleModel:
    rows = training_rows(docs, labels, label, key, text, bound)
    held = rows.select("y", *[F.col("statistics")[s].alias(s) for s in STATISTICS]).toArrow()  # bounded
    x = np.column_stack([held.column(s).to_numpy() for s in STATISTICS])
    return fit_rules(x, held.column("y").to_numpy().astype(np.float64))


def quality_scores(docs: DataFrame, labels: DataFrame, label: str = "quality", key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key``, held_out, score (0 to 1) and predicted of every row of ``docs``.

    NULL texts score as empty ones, NULL keys are scored too, repeated rows each, an empty table
    gives an empty one; without labels of both kinds the score is one number. Further columns are
    left out and never read.
    """
    model = learn(docs, labels, label, key, text)
    rows = with_statistics(docs.select(F.col(f"`{key}`").cast("bigint").alias("key"), F.col(f"`{text}`").cast("string").alias("text")))
    scored = rows.select("key", held_out(F.col("key")).alias("held_out"), model.column().alias("score"))
    return scored.select(F.col("key").alias(key), "held_out", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, label: str = "quality", key: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows of ``docs`` that the classifier accepts (score of at least 0.5), all columns kept.

    NULL texts are scored as empty ones and NULL keys like any other (they have no label to learn from);
    repeated rows stay or go together; an empty table gives an empty one; with fewer than 20 labels, or
    labels of one kind, all rows have one score, (ones + 1) / (labels + 2), and stay or go together;
    further columns, whatever their names, are carried along.
    """
    name = "statistics"
    while name in docs.columns:
        name += "_"
    model = learn(docs, labels, label, key, text)
    return with_statistics(docs, text, name).where(model.column(name) >= 0.5).drop(name)
