"""Calibrators fitted as aggregation jobs, for every group and held-out fold at once.

A fit sees rows ``(keys..., fold, z, gold_idx)``: ``z`` are floored logits. With folds, target ``f``
is trained on the rows of every other fold, so one pass over the data advances all
(group, target) fits together and a fitted parameter table is joined back on (group, fold).
Parameter tables are checkpointed between iterations; rows never leave the executors.
"""

from __future__ import annotations

import warnings
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from plumbline.functions import vectors as V
from plumbline.functions.hashing import keyed_hash
from plumbline.operators.ranking import with_prefix_sums, with_rank
from plumbline.session import (
    BROADCAST_BYTES, BROADCAST_ROWS, broadcast_if_small, cached, checkpoint, row_bytes,
)

T_MIN, T_MAX = 1e-3, 1e3
UNTRIED_LOW, UNTRIED_HIGH = 0.999 / T_MAX, 1.001 / T_MIN
"""Bracket ends of 1/T just outside the bounds: the bounds themselves are still to be tried."""
VECTOR_L2 = 1e-3
HISTOGRAM_BINS = 10
DEFAULT_FOLDS = 5
MIN_GROUP = 30
"""Groups with fewer training rows use the global temperature of their fold."""
NEWTON_TOLERANCE = 1e-6
"""A Newton step this small leaves an error of about its square."""
GRADIENT_TOLERANCE = 1e-10
"""Mean slope in log T below which a temperature is final (separable rows have no optimum)."""
ALL_ROWS = -1
"""Target of a fit that holds nothing out."""


def assign_folds(
    items: DataFrame, n_folds: int = DEFAULT_FOLDS, seed: int | str = 0
) -> DataFrame:
    """(benchmark, question_id, stratum, fold): questions dealt round-robin over the folds in
    stratum order, hashed order within a stratum, the deal carrying on between strata."""
    questions = items.select("benchmark", "question_id", "stratum").distinct()
    hashed = questions.withColumn(
        "_hash", keyed_hash(seed, F.col("benchmark"), F.col("question_id"))
    )
    return with_rank(hashed, ["benchmark"], ["stratum", "_hash"], "_rank", "_size").select(
        "benchmark", "question_id", "stratum", ((F.col("_rank") - 1) % n_folds).cast("int").alias("fold")
    )


def spanning_questions(items: DataFrame) -> DataFrame:
    """Questions that lie in two strata: folds would split them."""
    return (
        items.groupBy("benchmark", "question_id")
        .agg(F.min("stratum").alias("first_stratum"), F.max("stratum").alias("last_stratum"))
        .where("first_stratum <> last_stratum")
    )


def training_rows(items: DataFrame, keys: Sequence[str], floor: float = V.PROB_FLOOR) -> DataFrame:
    """``items`` (keys, fold, probs, gold_idx) as centred logits."""
    return items.select(*keys, "fold", V.centered(V.probs_to_logits(F.col("probs"), floor)).alias("z"), "gold_idx")


def with_targets(rows: DataFrame, n_folds: int | None) -> DataFrame:
    """One row per fit a row trains: every target but its own fold, or the single full fit."""
    if n_folds is None:
        return rows.withColumn("target", F.lit(ALL_ROWS))
    others = F.filter(F.sequence(F.lit(0), F.lit(n_folds - 1)), lambda f: f != F.col("fold"))
    return rows.withColumn("target", F.explode(others))


def _iterate(
    state: DataFrame,
    step: Callable[[DataFrame, bool], DataFrame],
    max_iterations: int,
    tolerance: float,
) -> DataFrame:
    """Advance ``state`` (one row per fit, with a ``moved`` column) until no fit moves. ``step``
    gets the state and whether its measured size allows a broadcast. ``converged`` says of each fit
    whether it had settled within ``max_iterations``; those that had not are counted in a warning."""
    measure = lambda s: s.agg(F.count(F.lit(1)), F.sum(row_bytes(s)), F.max("moved")).first()
    state = checkpoint(state)
    rows, size, moved = measure(state)
    for _ in range(max_iterations):
        small = rows <= BROADCAST_ROWS and (size or 0) <= BROADCAST_BYTES
        state = checkpoint(step(state, small))
        rows, size, moved = measure(state)
        if moved is None or moved < tolerance:
            break
    else:
        still = state.where(F.col("moved") >= tolerance).count()
        warnings.warn(f"{still} of {rows} fits had not settled after {max_iterations} rounds", stacklevel=3)
    return state.withColumn("converged", F.col("moved") < tolerance)


def _targets(n_folds: int | None) -> list[int]:
    return [ALL_ROWS] if n_folds is None else list(range(n_folds))


def _training_counts(data: DataFrame, keys: Sequence[str], n_folds: int | None) -> DataFrame:
    """(keys, target, n_train): rows outside each held-out fold, from one count per fold."""
    fold = F.lit(0) if n_folds is None else F.col("fold")
    per_fold = data.groupBy(*keys, fold.alias("fold")).agg(F.count(F.lit(1)).alias("n"))
    target = F.explode(F.array(*[F.lit(t) for t in _targets(n_folds)]))
    return (
        per_fold.withColumn("target", target)
        .where(F.col("fold") != F.col("target"))
        .groupBy(*keys, "target")
        .agg(F.sum("n").alias("n_train"))
    )


def _matrix(column: pa.Array) -> np.ndarray:
    """A list column as an (n, K) matrix; shorter rows are padded with zero-probability entries."""
    values = column.flatten().to_numpy(zero_copy_only=False)
    ends = column.offsets.to_numpy()
    sizes = np.diff(ends)
    if not len(sizes):
        return np.empty((0, 1))
    width = int(sizes.max())
    if (sizes == width).all():
        return np.maximum(values.reshape(-1, width), -1e6)
    out = np.full((len(sizes), width), -1e6)
    out[np.arange(width) < sizes[:, None]] = values
    return np.maximum(out, -1e6)


def _fold_sums(
    data: DataFrame,
    state: DataFrame,
    keys: Sequence[str],
    n_folds: int | None,
    kernel: Callable[[np.ndarray, np.ndarray, np.ndarray], np.ndarray],
    small: bool,
) -> DataFrame:
    """(keys, target, sums): ``kernel(z, gold, theta)`` added up over each fit's training rows.

    A row meets the parameters of all its targets at once, so rows are neither copied per fold nor
    shuffled; tasks keep one vector per fit and Spark adds those up by position.
    """
    keys, targets = list(keys), _targets(n_folds)
    entry = F.struct("target", "theta")
    packed = state.groupBy(*keys).agg(F.sort_array(F.collect_list(entry)).alias("_fits"))  # one per fold
    fold = F.lit(0) if n_folds is None else F.col("fold")
    joined = data.join(F.broadcast(packed) if small else packed, keys).select(
        *keys, fold.cast("int").alias("_fold"), "gold_idx", "z",
        F.transform("_fits", lambda f: f["target"]).alias("_t"),
        F.flatten(F.transform("_fits", lambda f: f["theta"])).alias("_theta"),
    )
    key_fields = [data.schema[k] for k in keys]
    schema = T.StructType(
        [*key_fields, T.StructField("target", T.IntegerType()), T.StructField("pos", T.IntegerType()), T.StructField("value", T.DoubleType())]
    )
    arrow = to_arrow_schema(schema)

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[tuple, np.ndarray] = {}
        for batch in batches:
            if not batch.num_rows:
                continue
            table = batch.select(keys).to_pandas()
            z = _matrix(batch.column("z"))
            gold = batch.column("gold_idx").to_numpy(zero_copy_only=False).astype(np.int64)
            own = batch.column("_fold").to_numpy(zero_copy_only=False)
            for key, index in table.groupby(keys, sort=False, dropna=False).indices.items():
                key = key if isinstance(key, tuple) else (key,)
                fits = batch.column("_t")[int(index[0])].as_py()
                theta = np.array(batch.column("_theta")[int(index[0])].as_py()).reshape(len(fits), -1)
                for target, params in zip(fits, theta, strict=True):
                    used = index[own[index] != target]
                    if len(used):
                        value = kernel(z[used], gold[used], params)
                        old = totals.get((*key, target))
                        totals[(*key, target)] = value if old is None else old + value
        for key, value in totals.items():
            n = len(value)
            columns = [pa.array([v] * n, arrow.field(i).type) for i, v in enumerate(key)]
            columns += [pa.array(range(n), pa.int32()), pa.array(value, pa.float64())]
            yield pa.RecordBatch.from_arrays(columns, schema=arrow)

    added = joined.mapInArrow(partial, schema).groupBy(*keys, "target", "pos").agg(F.sum("value").alias("value"))
    # One entry per parameter of a fit and its derivatives.
    return added.groupBy(*keys, "target").agg(F.sort_array(F.collect_list(F.struct("pos", "value"))).alias("_s")).select(
        *keys, "target", F.transform("_s", lambda x: x["value"]).alias("sums")
    )


# --- temperature -----------------------------------------------------------------------------------


def fit_temperature(
    rows: DataFrame, keys: Sequence[str], n_folds: int | None = DEFAULT_FOLDS
) -> DataFrame:
    """(keys, target) -> n_train, temperature minimising the mean NLL of ``softmax(z / T)``.

    The NLL is convex in ``1 / T``; each pass sums its first two derivatives per fit and takes a
    Newton step inside the bracket the gradient signs leave (a geometric midpoint otherwise).
    """
    on = [*keys, "target"]
    data = cached(rows.select(*keys, "fold", "z", "gold_idx"))
    start = _training_counts(data, keys, n_folds).withColumns(
        {
            "theta": F.array(F.lit(1.0)), "low": F.lit(UNTRIED_LOW), "high": F.lit(UNTRIED_HIGH),
            "moved": F.lit(float("inf")),
        }
    )

    def slopes(z: np.ndarray, gold: np.ndarray, theta: np.ndarray) -> np.ndarray:
        e = np.exp(theta[0] * z)
        ez = e * z
        total = e.sum(axis=1)
        mean = ez.sum(axis=1) / total
        second = (ez * z).sum(axis=1) / total
        return np.array([(mean - z[np.arange(len(z)), gold]).sum(), (second - mean * mean).sum()])

    def step(state: DataFrame, small: bool) -> DataFrame:
        sums = _fold_sums(data, state, keys, n_folds, slopes, small)
        joined = state.join(sums, on)
        g, h, beta = F.get("sums", F.lit(0)), F.get("sums", F.lit(1)), F.get("theta", F.lit(0))
        low = F.when(g < 0, beta).otherwise(F.col("low"))
        high = F.when(g > 0, beta).otherwise(F.col("high"))
        guess = beta - F.try_divide(g, h)
        inside = guess.isNotNull() & (guess >= F.greatest(low, F.lit(1.0 / T_MAX))) & (guess <= F.least(high, F.lit(1.0 / T_MIN)))
        # An overshoot tries the bound itself; a fit the slope still pushes outward there is done.
        first, last = 1.0 / T_MAX, 1.0 / T_MIN
        stuck = ((beta == first) & (g > 0)) | ((beta == last) & (g < 0))
        nxt = (
            F.when((F.abs(g * beta) < GRADIENT_TOLERANCE * F.col("n_train")) | stuck, beta)
            .when(inside, guess)
            .when((guess < low) & (low < first), F.lit(first))
            .when((guess > high) & (high > last), F.lit(last))
            .otherwise(F.sqrt(low * high))
        )
        return joined.withColumn("_next", nxt).select(
            *on, "n_train", F.array("_next").alias("theta"), low.alias("low"), high.alias("high"),
            F.abs(F.ln(F.col("_next") / beta)).alias("moved"),
        )

    state = _iterate(start, step, 40, NEWTON_TOLERANCE)
    data.unpersist()
    return state.select(*on, "n_train", (1.0 / F.get("theta", F.lit(0))).alias("temperature"), "converged")


# --- Platt -----------------------------------------------------------------------------------------


def platt_feature(z: Column) -> Column:
    """Log-odds a Platt fit sees: first key against second for two keys, else the top key's."""
    binary = F.greatest(
        F.lit(-V.LOGIT_BOUND), F.least(F.lit(V.LOGIT_BOUND), F.get(z, F.lit(0)) - F.get(z, F.lit(1)))
    )
    return F.when(F.size(z) == 2, binary).otherwise(V.top_label_logit(V.softmax(z)))


def sigmoid(u: Column) -> Column:
    e = F.exp(-F.abs(u))
    return F.when(u >= 0, 1.0 / (1.0 + e)).otherwise(e / (1.0 + e))


def fit_platt(rows: DataFrame, keys: Sequence[str], n_folds: int | None = DEFAULT_FOLDS) -> DataFrame:
    """(keys, target) -> n_train, a, b of ``sigmoid(a * s + b)`` with Platt's smoothed targets:
    damped Newton, one pass per step for all fits."""
    on = [*keys, "target"]
    positive = F.when(F.size("z") == 2, F.col("gold_idx") == 0).otherwise(
        V.argmax(F.col("z")) == F.col("gold_idx")
    )
    narrow = rows.select(*keys, "fold", platt_feature(F.col("z")).alias("s"), positive.alias("hit"))
    training = cached(with_targets(narrow, n_folds).drop("fold"))
    start = (
        training.groupBy(*on)
        .agg(F.count(F.lit(1)).alias("n_train"), F.count_if("hit").alias("_pos"))
        .withColumns(
            {
                "t_hit": (F.col("_pos") + 1.0) / (F.col("_pos") + 2.0),
                "t_miss": 1.0 / (F.col("n_train") - F.col("_pos") + 2.0),
                "a": F.lit(1.0), "b": F.lit(0.0), "moved": F.lit(float("inf")),
            }
        )
        .drop("_pos")
    )

    def step(state: DataFrame, small: bool) -> DataFrame:
        joined = training.join(F.broadcast(state) if small else state, on)
        q = sigmoid(F.col("a") * F.col("s") + F.col("b"))
        rows_ = joined.withColumn("_q", q).withColumns(
            {
                "_g": F.col("_q") - F.when(F.col("hit"), F.col("t_hit")).otherwise(F.col("t_miss")),
                "_v": F.col("_q") * (1.0 - F.col("_q")),
            }
        )
        s = F.col("s")
        sums = rows_.groupBy(*on).agg(
            *[F.first(c).alias(c) for c in ("n_train", "t_hit", "t_miss", "a", "b")],
            F.sum(F.col("_g") * s).alias("ga"), F.sum("_g").alias("gb"),
            F.sum(F.col("_v") * s * s).alias("haa"), F.sum(F.col("_v") * s).alias("hab"), F.sum("_v").alias("hbb"),
        )
        ridge = 1e-10 * F.col("n_train")
        haa, hab, hbb = F.col("haa") + ridge, F.col("hab"), F.col("hbb") + ridge
        det = haa * hbb - hab * hab
        da = (hbb * F.col("ga") - hab * F.col("gb")) / det
        db = (haa * F.col("gb") - hab * F.col("ga")) / det
        stepped = sums.withColumns({"_da": da, "_db": db}).withColumn(
            "_shrink", F.least(F.lit(1.0), 2.0 / F.greatest(F.abs("_da"), F.abs("_db"), F.lit(1e-12)))
        )
        return stepped.select(
            *on, "n_train", "t_hit", "t_miss",
            (F.col("a") - F.col("_shrink") * F.col("_da")).alias("a"),
            (F.col("b") - F.col("_shrink") * F.col("_db")).alias("b"),
            F.greatest(F.abs("_da"), F.abs("_db")).alias("moved"),
        )

    state = _iterate(start, step, 40, NEWTON_TOLERANCE)
    training.unpersist()
    return state.select(*on, "n_train", "a", "b", "converged")


# --- vector scaling ----------------------------------------------------------------------------------


def fit_vector(
    rows: DataFrame, keys: Sequence[str], n_folds: int | None = DEFAULT_FOLDS, l2: float = VECTOR_L2
) -> DataFrame:
    """(keys, target) -> n_train, temperature, bias of ``softmax(z / T + b)``, mean NLL plus
    ``l2 / 2 |b|^2``, bias centred. Rows with fewer keys than others of their group take part with
    the first biases.

    Newton steps in (1/T, b): tasks add up gradient and Hessian per fit, Spark adds the partial
    sums, and each fit solves its own small system.
    """
    on = [*keys, "target"]
    data = cached(rows.select(*keys, "fold", "z", "gold_idx"))
    sizes = data.groupBy(*keys).agg(F.max(F.size("z")).alias("_k"))
    start = (
        _training_counts(data, keys, n_folds)
        .join(sizes, list(keys))
        .withColumn("theta", F.concat(F.array(F.lit(1.0)), F.array_repeat(F.lit(0.0), F.col("_k"))))
        .withColumn("moved", F.lit(float("inf")))
        .drop("_k")
    )

    def derivatives(z: np.ndarray, gold: np.ndarray, theta: np.ndarray) -> np.ndarray:
        width = len(theta) - 1
        if z.shape[1] < width:
            z = np.column_stack([z, np.full((len(z), width - z.shape[1]), -1e6)])
        z = z[:, :width]
        s = theta[0] * z + theta[1:]
        p = np.exp(s - s.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        n, k = z.shape
        z = np.where(p > 0, z, 0.0)  # keys a question lacks weigh nothing
        mean = (p * z).sum(axis=1)
        grad = np.concatenate([[(mean - z[np.arange(n), gold]).sum()], p.sum(axis=0) - np.bincount(gold, minlength=k)])
        hess = np.empty((k + 1, k + 1))
        hess[0, 0] = ((p * z * z).sum(axis=1) - mean * mean).sum()
        hess[0, 1:] = hess[1:, 0] = (p * (z - mean[:, None])).sum(axis=0)
        hess[1:, 1:] = np.diag(p.sum(axis=0)) - p.T @ p
        return np.concatenate([grad, hess.ravel()])

    @F.pandas_udf(T.ArrayType(T.DoubleType()))
    def solve(theta: pd.Series, sums: pd.Series, n: pd.Series) -> pd.Series:
        out = []
        for t, s, count in zip(theta, sums, n, strict=True):
            t, s = np.asarray(t, dtype=np.float64), np.asarray(s, dtype=np.float64)
            d = t.shape[0]
            penalty = np.full(d, l2)
            penalty[0] = 0.0
            grad = s[:d] / count + penalty * t
            hess = s[d:].reshape(d, d) / count + np.diag(penalty) + 1e-12 * np.eye(d)
            delta = np.linalg.solve(hess, grad)
            delta *= min(1.0, 2.0 / max(np.abs(delta).max(), 1e-12))
            new = t - delta
            new[0] = min(max(new[0], t[0] / 10.0, 1.0 / T_MAX), 1.0 / T_MIN)
            out.append(new.tolist())
        return pd.Series(out)

    def step(state: DataFrame, small: bool) -> DataFrame:
        sums = _fold_sums(data, state, keys, n_folds, derivatives, small)
        moved = F.array_max(F.zip_with("theta", "_new", lambda x, y: F.abs(x - y)))
        return (
            state.join(sums, on)
            .withColumn("_new", solve("theta", "sums", F.col("n_train").cast("double")))
            .select(*on, "n_train", F.col("_new").alias("theta"), moved.alias("moved"))
        )

    state = _iterate(start, step, 30, NEWTON_TOLERANCE)
    data.unpersist()
    bias = F.slice("theta", F.lit(2), F.size("theta") - 1)
    return state.select(
        *on, "n_train", (1.0 / F.get("theta", F.lit(0))).alias("temperature"),
        V.let(V.vsum(bias) / F.size(bias), lambda m: F.transform(bias, lambda x: x - m)).alias("bias"), "converged",
    )


# --- histogram binning -----------------------------------------------------------------------------


def _top_rows(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, fold, conf, hit): top probability and whether the top key is right."""
    p = rows.withColumn("_p", V.softmax(F.col("z")))
    return p.select(
        *keys, "fold", F.array_max("_p").alias("conf"), (V.argmax(F.col("_p")) == F.col("gold_idx")).cast("int").alias("hit")
    )


def _out_of_fold_counts(rows: DataFrame, keys: Sequence[str], n_folds: int | None) -> DataFrame:
    """Distinct confidences per group with running counts per fold: every target's training
    distribution is a difference of two of them."""
    folds = [ALL_ROWS] if n_folds is None else list(range(n_folds))
    fold = F.lit(ALL_ROWS) if n_folds is None else F.col("fold")
    counted = rows.groupBy(*keys, "conf").agg(
        *[F.count_if(fold == f).alias(f"n{i}") for i, f in enumerate(folds)]
    )
    return with_prefix_sums(counted, keys, ["conf"], [f"n{i}" for i in range(len(folds))])


def fit_histogram(
    rows: DataFrame, keys: Sequence[str], n_folds: int | None = DEFAULT_FOLDS, bins: int = HISTOGRAM_BINS
) -> DataFrame:
    """(keys, target) -> n_train, edges, values: top-key accuracy of equal-mass bins of the top
    probability. Edges are data values (the smallest value reaching each share), so a run of ties
    never straddles two bins; an edge equal to the maximum is dropped."""
    keys, on = list(keys), [*keys, "target"]
    top = cached(_top_rows(rows, keys))
    n = 1 if n_folds is None else n_folds
    placed = _out_of_fold_counts(top, keys, n_folds)
    targets = []
    for i in range(n):
        own = F.lit(0) if n_folds is None else F.col(f"n{i}")
        cum_own = F.lit(0) if n_folds is None else F.col(f"cum_n{i}")
        total_own = F.lit(0) if n_folds is None else F.col(f"total_n{i}")
        here = sum((F.col(f"n{j}") for j in range(n)), F.lit(0)) - own
        cum = sum((F.col(f"cum_n{j}") for j in range(n)), F.lit(0)) - cum_own
        total = sum((F.col(f"total_n{j}") for j in range(n)), F.lit(0)) - total_own
        targets.append(
            F.struct(
                F.lit(ALL_ROWS if n_folds is None else i).alias("target"), here.alias("here"),
                cum.alias("cum"), total.alias("total"),
            )
        )
    per = placed.select(*keys, "conf", F.explode(F.array(*targets)).alias("_t")).where("_t.here > 0")
    ranks = F.transform(
        F.sequence(F.lit(1), F.lit(bins - 1)), lambda j: F.ceil(F.col("_t.total") * j / bins)
    )
    is_edge = F.exists(ranks, lambda r: (r > F.col("_t.cum") - F.col("_t.here")) & (r <= F.col("_t.cum")))
    # The edge list of a fit holds at most bins - 1 values.
    edges = (
        per.groupBy(*keys, F.col("_t.target").alias("target"))
        .agg(
            F.max("conf").alias("_max"), F.max("_t.total").alias("n_train"),
            F.sort_array(F.collect_set(F.when(is_edge, F.col("conf")))).alias("_e"),
        )
        .select(*on, "n_train", F.filter("_e", lambda e: e < F.col("_max")).alias("edges"))
    )
    edges = checkpoint(edges)
    training = with_targets(top, n_folds)
    binned = training.join(broadcast_if_small(edges), on).withColumn(
        "bin", F.size(F.filter("edges", lambda e: e < F.col("conf")))
    )
    values = (
        binned.groupBy(*on, "bin").agg(F.avg("hit").alias("value"))
        .groupBy(*on).agg(F.sort_array(F.collect_list(F.struct("bin", "value"))).alias("_v"))
        .select(*on, F.transform("_v", lambda x: x["value"]).alias("values"))
    )
    return checkpoint(edges.join(values, on))


def histogram_value(conf: Column, edges: Column, values: Column) -> Column:
    return F.get(values, F.size(F.filter(edges, lambda e: e < conf)))


# --- isotonic regression -----------------------------------------------------------------------------

CELLS = 256
"""Confidence cells of the isotonic lookup table."""


def pool_blocks(low: np.ndarray, high: np.ndarray, hits: np.ndarray, weight: np.ndarray) -> list[tuple]:
    """Adjacent blocks (in ascending order) merged until their means do not decrease."""
    done: list[list[float]] = []
    for block in zip(low.tolist(), high.tolist(), hits.tolist(), weight.tolist(), strict=True):
        current = list(block)
        while done and done[-1][2] * current[3] >= current[2] * done[-1][3]:
            earlier = done.pop()
            current = [earlier[0], current[1], earlier[2] + current[2], earlier[3] + current[3]]
        done.append(current)
    return [tuple(b) for b in done]


def fit_isotonic(rows: DataFrame, keys: Sequence[str], n_folds: int | None = DEFAULT_FOLDS) -> DataFrame:
    """(keys, target, low, high, value, n_train): constant stretches of the non-decreasing fit of
    top-key correctness on the top probability.

    Equal confidences are added up first, sorted ranges are pooled where they lie, and only the
    pooled blocks of a fit (at most about n^(2/3) of n outcomes, far fewer in practice) meet in
    one place for the last pooling.
    """
    keys, on = list(keys), [*keys, "target"]
    counted = (
        with_targets(_top_rows(rows, keys), n_folds)
        .groupBy(*on, "conf")
        .agg(F.sum("hit").cast("double").alias("hits"), F.count(F.lit(1)).cast("double").alias("weight"))
    )
    ordered = counted.repartitionByRange(*on, "conf").sortWithinPartitions(*on, "conf")
    block_schema = T.StructType(
        [counted.schema[c] for c in on]
        + [T.StructField(c, T.DoubleType()) for c in ("low", "high", "hits", "weight")]
    )

    def local(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for key, part in pdf.groupby(on, sort=False, dropna=False):
                conf = part["conf"].to_numpy()
                blocks = pool_blocks(conf, conf, part["hits"].to_numpy(), part["weight"].to_numpy())
                out = pd.DataFrame(blocks, columns=["low", "high", "hits", "weight"])
                key = key if isinstance(key, tuple) else (key,)
                for i, (name, v) in enumerate(zip(on, key, strict=True)):
                    out.insert(i, name, v)
                yield out

    fit_schema = T.StructType(
        [counted.schema[c] for c in on]
        + [T.StructField(c, T.DoubleType()) for c in ("low", "high", "value", "weight")]
    )

    def final(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("low")
        blocks = pool_blocks(*(pdf[c].to_numpy() for c in ("low", "high", "hits", "weight")))
        out = pd.DataFrame(blocks, columns=["low", "high", "hits", "weight"])
        out["value"] = out["hits"] / out["weight"]
        for i, name in enumerate(on):
            out.insert(i, name, pdf[name].iloc[0])
        return out[[*on, "low", "high", "value", "weight"]]

    return checkpoint(ordered.mapInPandas(local, block_schema).groupBy(*on).applyInPandas(final, fit_schema))


def isotonic_lookup(blocks: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, target, cell, segments): the piecewise linear map cut into confidence cells, so it
    is applied by an equality join. Segments are flat over a block and linear between blocks."""
    on = [*keys, "target"]
    following = Window.partitionBy(*on).orderBy("low")  # pooled blocks only
    ends = blocks.withColumns(
        {
            "_next_low": F.lead("low").over(following),
            "_next_value": F.lead("value").over(following),
            "_first": F.row_number().over(following) == 1,
        }
    )

    def segment(x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
        return F.struct(x0.alias("x0"), y0.alias("y0"), x1.alias("x1"), y1.alias("y1"))

    low, high, value = F.col("low"), F.col("high"), F.col("value")
    pieces = F.array(
        segment(F.when(F.col("_first"), F.lit(0.0)).otherwise(low), value, F.coalesce(F.when(F.col("_next_low").isNull(), F.lit(1.0)), high), value),
        segment(high, value, F.coalesce("_next_low", F.lit(1.0)), F.coalesce("_next_value", value)),
    )
    cut = ends.select(*on, F.explode(pieces).alias("s"))
    cells = F.sequence(_cell(F.col("s.x0")), _cell(F.col("s.x1")))
    spread = cut.select(*on, F.explode(cells).alias("cell"), "s")
    return spread.groupBy(*on, "cell").agg(F.sort_array(F.collect_list("s")).alias("segments"))


def _cell(x: Column) -> Column:
    return F.least(F.floor(x * CELLS), F.lit(CELLS - 1)).cast("int")


def isotonic_value(conf: Column, segments: Column) -> Column:
    """Linear interpolation on the segment that holds ``conf``."""
    found = F.filter(segments, lambda s: (s["x0"] <= conf) & (conf <= s["x1"]))
    s = F.get(found, F.lit(0))
    width = s["x1"] - s["x0"]
    return F.when(width > 0, s["y0"] + (s["y1"] - s["y0"]) * (conf - s["x0"]) / width).otherwise(s["y1"])
