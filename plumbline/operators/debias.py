"""Position debiasing: label priors estimated by aggregation and divided out by a join.

``free`` marks the positions that may move; a prior holds one entry per free position. Estimation
works on exploded (key, position) rows, so a prior key of any size is a partial aggregate.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, fields

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions import vectors as V
from plumbline.functions.hashing import hash_uniform, keyed_hash
from plumbline.functions.questions import cyclic_shifts, random_orders
from plumbline.session import lookup

PRIOR_FLOOR = 1e-6
MIN_BATCH = 30
MAX_FREE_OPTIONS = 32
DEALT_ROWS = 1 << 15
"""Presentations (and items) that one task takes."""


def log_of(p: Column) -> Column:
    """``ln`` with ``-Infinity`` for zero."""
    return F.transform(p, lambda x: F.when(x > 0, F.ln(x)).otherwise(F.lit(V.NEG_INF)))


def apply_prior(logp: Column, prior: Column, free: Column) -> Column:
    """``logp`` with its free positions divided by ``prior`` and renormalised. The log prior is
    centred, so fixed positions keep their weight against the free block."""
    logs = F.transform(prior, lambda x: F.ln(F.greatest(x, F.lit(PRIOR_FLOOR))))

    def shift(values: Column) -> Column:
        mean = V.vsum(values) / F.size(values)

        def subtract(m: Column) -> Column:
            ranks = _free_ranks(free)
            return V.log_normalize(
                F.zip_with(
                    logp,
                    ranks,
                    lambda z, r: F.when(r < 0, z).otherwise(z - (F.get(values, r) - m)),
                )
            )

        return V.let(mean, subtract)

    return V.let(logs, shift)


def _free_ranks(free: Column) -> Column:
    """Per position its index among the free positions, -1 when fixed."""
    return F.transform(
        free,
        lambda f, i: F.when(f, F.size(F.filter(F.slice(free, F.lit(1), i), lambda x: x))).otherwise(F.lit(-1)),
    )


def divide_by_prior(p: Column, prior: Column, free: Column) -> Column:
    """Probabilities divided by a prior; unchanged where there is none."""
    divided = F.transform(apply_prior(log_of(p), prior, free), lambda x: F.exp(x))
    return F.when(prior.isNull(), p).otherwise(divided)


# --- presentations -----------------------------------------------------------------------------


def dealt(keys: Sequence[str], *tables: DataFrame) -> list[DataFrame]:
    """``tables`` dealt out by ``keys``, :data:`DEALT_ROWS` rows a task: presentations are alike, so
    their bytes in a shuffle, which Spark would cut tasks by, say little of what they take in memory."""
    tasks = max(1, -(-sum(t.count() for t in tables) // DEALT_ROWS))
    return [t.repartition(tasks, *keys) for t in tables]


def average_presentations(shown: DataFrame, keys: Sequence[str], deal: bool = True) -> DataFrame:
    """(keys, probs): each option's mean probability over presentations, in original order.

    ``shown``: keys, ``order`` (original index at each position) and ``shown_probs`` by position;
    without ``deal`` they are dealt out by (some of) the keys already.
    """
    if deal:
        (shown,) = dealt(keys, shown)
    by_option = shown.select(*keys, F.posexplode(F.arrays_zip("order", "shown_probs"))).select(
        *keys, F.col("col.order").alias("option"), F.col("col.shown_probs").alias("p")
    )
    mean = by_option.groupBy(*keys, "option").agg(F.avg("p").alias("p"))
    # One array entry per option of one question.
    return mean.groupBy(*keys).agg(
        F.sort_array(F.collect_list(F.struct("option", "p"))).alias("_o")
    ).select(*keys, V.normalize(F.transform("_o", lambda o: o["p"])).alias("probs"))


def full_cycles(shown: DataFrame, keys: Sequence[str], free: str = "free", deal: bool = True) -> DataFrame:
    """(keys, full): do the presentations show every free option at every free position exactly
    once, fixed positions never moving."""
    if deal:
        (shown,) = dealt(keys, shown)
    per_position = (
        shown.withColumn("_n_free", F.size(F.filter(free, lambda f: f)))
        .select(*keys, "_n_free", F.posexplode(F.arrays_zip("order", free)))
        .groupBy(*keys, "pos")
        .agg(
            F.count(F.lit(1)).alias("_rows"),
            F.count_distinct("col.order").alias("_options"),
            F.max(f"col.{free}").alias("_free"),
            F.max("_n_free").alias("_n_free"),
            F.every(F.col("col.order") == F.col("pos")).alias("_home"),
        )
    )
    complete = F.when(F.col("_free"), F.col("_options") == F.col("_n_free")).otherwise(F.col("_home"))
    return per_position.groupBy(*keys).agg(
        F.every(
            complete & (F.col("_rows") == F.col("_n_free")) & (F.col("_n_free") >= 2)
        ).alias("full")
    )


def item_priors(shown: DataFrame, keys: Sequence[str], free: str = "free", deal: bool = True) -> DataFrame:
    """(keys, pos, prior): softmax over free positions of the mean log-probability by position,
    for questions shown in a full cycle. ``pos`` counts free positions."""
    if deal:
        (shown,) = dealt(keys, shown)
    rows = shown.select(*keys, F.posexplode(F.arrays_zip("shown_probs", _free_ranks(F.col(free)).alias("rank"))))
    floored = F.ln(F.greatest(F.col("col.shown_probs"), F.lit(PRIOR_FLOOR)))
    per = (
        rows.where(F.col("col.rank") >= 0)
        .groupBy(*keys, F.col("col.rank").alias("pos"))
        .agg(F.exp(F.avg(floored)).alias("_w"))
    )
    total = per.groupBy(*keys).agg(F.sum("_w").alias("_t"))
    return per.join(total, list(keys)).select(*keys, "pos", (F.col("_w") / F.col("_t")).alias("prior"))


# --- label priors ------------------------------------------------------------------------------


def _priors(rows: DataFrame, keys: Sequence[str], method: str, min_count: int) -> DataFrame:
    """Renormalised mean of (keys, pos, value) rows as (keys, method, prior, n)."""
    mean = rows.groupBy(*keys, "pos").agg(F.avg("value").alias("m"), F.count(F.lit(1)).alias("n"))
    packed = mean.groupBy(*keys).agg(
        F.sort_array(F.collect_list(F.struct("pos", "m"))).alias("_m"), F.max("n").alias("n")
    )
    return packed.where(F.col("n") >= min_count).select(
        *keys, F.lit(method).alias("method"),
        V.normalize(F.transform("_m", lambda x: x["m"])).alias("prior"), "n",
    )


def free_rows(items: DataFrame, keys: Sequence[str], probs: str, free: str = "free") -> DataFrame:
    """(keys, pos, value): probabilities of the free positions, numbered among themselves."""
    return (
        items.select(*keys, F.posexplode(F.arrays_zip(F.col(probs).alias("p"), _free_ranks(F.col(free)).alias("rank"))))
        .where(F.col("col.rank") >= 0)
        .select(*keys, F.col("col.rank").alias("pos"), F.col("col.p").alias("value"))
    )


def batch_priors(
    items: DataFrame, keys: Sequence[str] = ("prior_key",), probs: str = "probs", min_count: int = 1
) -> DataFrame:
    """Mean probability of each free position per prior key."""
    return _priors(free_rows(items, keys, probs), keys, "batch", min_count)


def pride_priors(
    shown: DataFrame, item_keys: Sequence[str], keys: Sequence[str] = ("prior_key",), min_count: int = 1
) -> DataFrame:
    """Mean of the full-cycle questions' item priors per prior key. ``item_keys`` identify a
    question and include ``keys``."""
    (shown,) = dealt(item_keys, shown)
    full = full_cycles(shown, item_keys, deal=False).where("full").select(*item_keys)
    priors = item_priors(shown, item_keys, deal=False).join(full, list(item_keys), "left_semi")
    return _priors(
        priors.select(*keys, "pos", F.col("prior").alias("value")), keys, "pride", min_count
    )


def out_of_fold_priors(
    rows: DataFrame, keys: Sequence[str], method: str, n_folds: int, min_count: int = 1
) -> DataFrame:
    """Priors per held-out fold from (keys, fold, pos, value) rows: sums over all folds less the
    fold's own, so the data is aggregated once however many folds there are."""
    per_fold = rows.groupBy(*keys, "pos", "fold").agg(F.sum("value").alias("s"), F.count(F.lit(1)).alias("n"))
    totals = per_fold.groupBy(*keys, "pos").agg(
        F.sum("s").alias("S"), F.sum("n").alias("N"),
        F.map_from_entries(F.collect_list(F.struct("fold", F.struct("s", F.col("n").alias("c"))))).alias("own"),
    )
    held_out = totals.withColumn("fold", F.explode(F.sequence(F.lit(0), F.lit(n_folds - 1))))
    own = F.try_element_at("own", F.col("fold"))
    count = F.col("N") - F.coalesce(own["c"], F.lit(0))
    total = F.col("S") - F.coalesce(own["s"], F.lit(0.0))
    trained = held_out.select(*keys, "fold", "pos", total.alias("s"), count.alias("n")).where(F.col("n") > 0)
    packed = trained.groupBy(*keys, "fold").agg(
        F.sort_array(F.collect_list(F.struct("pos", (F.col("s") / F.col("n")).alias("m")))).alias("_m"),
        F.max("n").alias("n"),
    )
    return packed.where(F.col("n") >= min_count).select(
        *keys, "fold", F.lit(method).alias("method"),
        V.normalize(F.transform("_m", lambda x: x["m"])).alias("prior"), "n",
    )


def debias_offline(
    items: DataFrame, method: str, shown: DataFrame | None = None, n_folds: int = 5,
    min_batch: int = MIN_BATCH,
) -> DataFrame:
    """Items (item_id, fold, prior_key, free, raw, ...) with ``debiased`` probabilities.

    ``none`` keeps the raw ones; ``batch`` and ``pride`` divide by the prior of the other folds,
    and a question shown in a full cycle answers with the average of its presentations (pride).
    A prior key without a prior keeps its raw probabilities. Where items have them, ``system`` and
    ``benchmark`` are part of an item's key, and priors are estimated for each system by itself;
    presentations must then name the system too.
    """
    if method == "none":
        return items.withColumn("debiased", F.col("raw"))
    per_system = ["system"] if "system" in items.columns else []
    item = [*per_system, *(["benchmark"] if "benchmark" in items.columns else []), "item_id"]
    keys = [*per_system, "prior_key"]
    if method == "batch":
        rows = free_rows(items, [*keys, "fold"], "raw")
        priors = out_of_fold_priors(rows, keys, method, n_folds, min_batch)
    elif method == "pride":
        lacking = [k for k in item if k not in shown.columns]
        if lacking:
            raise ValueError(f"presentations lack {lacking}")
        shown, items = dealt(item, shown, items)
        tagged = shown.join(items.select(*item, "fold"), item)
        ids = [*item, "fold", "prior_key"]
        full = full_cycles(tagged, ids, deal=False).where("full").select(*item)
        rows = item_priors(tagged, ids, deal=False).join(full, item, "left_semi")
        priors = out_of_fold_priors(
            rows.select(*keys, "fold", "pos", F.col("prior").alias("value")), keys, "pride", n_folds
        )
    else:
        raise ValueError(f"unknown debias method {method!r}")
    divided = items.join(lookup(priors.select(*keys, "fold", "prior")), [*keys, "fold"], "left").withColumn(
        "debiased", divide_by_prior(F.col("raw"), F.col("prior"), F.col("free"))
    )
    if method == "pride":
        averaged = average_presentations(
            tagged.join(full, item, "left_semi"), item, deal=False
        ).withColumnRenamed("probs", "_averaged")
        divided = divided.join(averaged, item, "left").withColumn(
            "debiased", F.coalesce("_averaged", "debiased")
        ).drop("_averaged")
    return divided.drop("prior")


def _own_keys(items: DataFrame, other: DataFrame, key: str, owners: tuple[str, ...] = ("system", "benchmark")) -> list[str]:
    """``key`` and those of ``owners`` that items have: the other table must name them too, so what
    belongs to one system is never used for another."""
    keys = [*[c for c in owners if c in items.columns], key]
    lacking = [k for k in keys if k not in other.columns]
    if lacking:
        raise ValueError(f"items have {lacking}, what they are debiased with has not")
    return keys


# --- debiasers as values (extension point) --------------------------------------------------------
#
# A debiaser is a frozen dataclass: its fields are its options, ``apply`` its DataFrame transform.


@dataclass(frozen=True)
class PermutationAverage:
    """Answer with the average presentation of the same system's item; questions with fewer than two
    or more than ``max_options`` free options keep their own answer (with a warning in the latter case)."""

    kind: str = "cyclic"
    n: int | None = None
    seed: int = 0
    max_options: int | None = MAX_FREE_OPTIONS

    def orders(self, free: Column, *keys: Column | str) -> Column:
        """The presentations to ask for: ``n`` shifts, or ``n`` hashed orders of the keys."""
        if self.kind == "cyclic":
            return cyclic_shifts(free) if self.n is None else cyclic_shifts(free, self.n)
        return random_orders(free, self.n or 2, F.lit(self.seed), *keys)

    def apply(self, items: DataFrame, shown: DataFrame) -> DataFrame:
        item = _own_keys(items, shown, "item_id")
        averaged = average_presentations(shown, item).withColumnRenamed("probs", "_averaged")
        n_free = F.size(F.filter("free", lambda f: f))
        over = F.lit(False) if self.max_options is None else n_free > self.max_options
        applies = (n_free >= 2) & ~over
        warning = F.when(over, F.format_string("permutation: %d free options > max_options=%d", n_free, F.lit(self.max_options or 0)))
        return (
            items.join(averaged, item, "left")
            .withColumn("debiased", F.when(applies, F.coalesce("_averaged", "probs")).otherwise(F.col("probs")))
            .withColumn("warning", warning)
            .drop("_averaged")
        )


@dataclass(frozen=True)
class StoredPrior:
    """Divide each question by the prior stored for its key (and system), with a warning where there is none.
    Priors of fewer than ``min_count`` questions do not count."""

    min_count: int = 1

    def apply(self, items: DataFrame, priors: DataFrame) -> DataFrame:
        n_free = F.size(F.filter("free", lambda f: f))
        keys = _own_keys(items, priors, "prior_key", ("system",))
        known = priors if "n" not in priors.columns else priors.where(F.col("n") >= self.min_count)
        prior = F.when(n_free >= 2, F.col("prior"))
        return (
            items.join(lookup(known.select(*keys, "prior")), keys, "left")
            .withColumn("debiased", divide_by_prior(F.col("probs"), prior, F.col("free")))
            .withColumn(
                "warning",
                F.when((n_free >= 2) & F.col("prior").isNull(), F.concat(F.lit("batch: no prior for "), F.col("prior_key"))),
            )
            .drop("prior")
        )


@dataclass(frozen=True)
class PermutedPrior(StoredPrior):
    """Stored priors of permuted questions; ``alpha`` is the share of questions to permute when they
    are estimated."""

    alpha: float = 0.05
    seed: int = 0

    def sampled(self, items: DataFrame, item: str = "item_id") -> DataFrame:
        return items.where(hash_uniform(keyed_hash(self.seed, F.col(item))) < self.alpha)


@dataclass(frozen=True)
class ContextualPrior:
    """Divide by the mean answer to ``content_free`` states, estimated once per distinct question (of
    each system by itself, where items name one).

    ``answers``: question_hash, free, probs of each content-free answer (and system).
    """

    content_free: tuple[str, ...] = ("N/A", "", "[MASK]")

    def apply(self, items: DataFrame, answers: DataFrame) -> DataFrame:
        keys = _own_keys(items, answers, "question_hash", ("system",))
        priors = batch_priors(answers, keys)
        n_free = F.size(F.filter("free", lambda f: f))
        return (
            items.join(lookup(priors.select(*keys, "prior")), keys, "left")
            .withColumn(
                "debiased", divide_by_prior(F.col("probs"), F.when(n_free >= 2, F.col("prior")), F.col("free"))
            )
            .drop("prior")
        )


DEBIASERS: dict[str, type] = {
    "permutation": PermutationAverage, "batch": StoredPrior, "pride": PermutedPrior, "contextual": ContextualPrior
}
"""Debiasers by name; add dataclasses with an ``apply`` method here."""


def make_debiaser(name: str, **options: object) -> object:
    """A debiaser with options given by keyword. Text values (of a configuration or a command line)
    take the type of the option's default; ``none`` and ``all`` lift a limit."""
    if name not in DEBIASERS:
        raise ValueError(f"unknown debiaser {name!r}; known: {sorted(DEBIASERS)}")
    defaults = {f.name: f.default for f in fields(DEBIASERS[name])}
    typed = {}
    for option, value in options.items():
        if option not in defaults:
            raise ValueError(f"bad parameter {option!r} of {name}; known: {sorted(defaults)}")
        if isinstance(value, str):
            kind = type(defaults[option])
            if value in ("none", "all") and not isinstance(defaults[option], str):
                value = None
            elif kind is tuple:
                value = tuple(value.split("|"))
            elif kind in (int, float, type(None)):
                value = float(value) if kind is float else int(value)
        typed[option] = value
    return DEBIASERS[name](**typed)
