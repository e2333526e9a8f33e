"""Out-of-fold calibration arms, deployment registries and their application."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions import vectors as V
from plumbline.operators import calibration as C
from plumbline.session import broadcast_if_small, checkpoint, lookup

SCOPES = ("global", "benchmark", "signature")
# The arms of a study unless others are asked for.
DEFAULT_ARMS = (
    "identity@global", "temperature@global", "temperature@benchmark", "temperature@signature",
    "vector@signature", "platt@signature", "isotonic@signature", "histogram@signature",
)
RAW = "raw"


def arm_table() -> dict[str, tuple[str, str]]:
    """Every arm: what it is called -> (calibrator, scope of a fit). A bare calibrator is global."""
    bare = {c: (c, "global") for c in CALIBRATORS}
    return bare | {f"{c}@{s}": (c, s) for c in CALIBRATORS for s in SCOPES}


def read_arms(names: Sequence[str]) -> list[tuple[str, str]]:
    table = arm_table()
    unknown = [n for n in names if n not in table]
    if unknown:
        raise ValueError(f"no such arms: {unknown}; there are {sorted(table)}")
    return [table[n] for n in names]


def fit_group(scope: str) -> Column:
    """What rows share a fit."""
    return F.lit("all") if scope == "global" else F.col(scope)


class Calibrator:
    """Extension point: ``fit`` returns one parameter row per (keys, target), ``transform`` the
    calibrated vector of a row that carries logits ``z`` and those parameters. Subclass and add to
    :data:`CALIBRATORS`."""

    name = "identity"
    params: tuple[str, ...] = ()

    def fit(self, rows: DataFrame, keys: Sequence[str], n_folds: int | None) -> DataFrame | None:
        return None

    def transform(self, z: Column) -> Column:
        return V.softmax(z)

    def join(self, items: DataFrame, fits: DataFrame, on: Sequence[str]) -> DataFrame:
        return items.join(broadcast_if_small(fits), list(on), "left")


class Temperature(Calibrator):
    name, params = "temperature", ("temperature",)

    def fit(self, rows, keys, n_folds):
        return C.fit_temperature(rows, keys, n_folds)

    def transform(self, z):
        return V.softmax(F.transform(z, lambda x: x / F.col("temperature")))


class VectorScaling(Calibrator):
    name, params = "vector", ("temperature", "bias")

    def fit(self, rows, keys, n_folds):
        return C.fit_vector(rows, keys, n_folds)

    def transform(self, z):
        # A question with fewer keys than the group's longest uses the first biases.
        return V.softmax(F.transform(z, lambda x, i: x / F.col("temperature") + F.coalesce(F.get("bias", i), F.lit(0.0))))


class Platt(Calibrator):
    name, params = "platt", ("a", "b")

    def fit(self, rows, keys, n_folds):
        return C.fit_platt(rows, keys, n_folds)

    def transform(self, z):
        q = C.sigmoid(F.col("a") * C.platt_feature(z) + F.col("b"))
        return F.when(F.size(z) == 2, F.array(q, 1.0 - q)).otherwise(V.with_top_label(V.softmax(z), q))


class Histogram(Calibrator):
    name, params = "histogram", ("edges", "values")

    def fit(self, rows, keys, n_folds):
        return C.fit_histogram(rows, keys, n_folds)

    def transform(self, z):
        value = C.histogram_value(F.array_max(V.softmax(z)), F.col("edges"), F.col("values"))
        return V.with_top_label(V.softmax(z), value)


class Isotonic(Calibrator):
    name, params = "isotonic", ("segments",)

    def fit(self, rows, keys, n_folds):
        blocks = C.fit_isotonic(rows, keys, n_folds)
        counts = blocks.groupBy(*keys, "target").agg(F.sum("weight").cast("bigint").alias("n_train"))
        return checkpoint(C.isotonic_lookup(blocks, keys).join(counts, [*keys, "target"]))

    def join(self, items, fits, on):
        cells = items.withColumn("cell", C._cell(F.array_max(V.softmax(F.col("z")))))
        return cells.join(broadcast_if_small(fits), [*on, "cell"], "left").drop("cell")

    def transform(self, z):
        value = C.isotonic_value(F.array_max(V.softmax(z)), F.col("segments"))
        return V.with_top_label(V.softmax(z), value)


CALIBRATORS: dict[str, Calibrator] = {
    c.name: c for c in (Calibrator(), Temperature(), VectorScaling(), Platt(), Isotonic(), Histogram())
}


def crossfit(
    items: DataFrame,
    arms: Sequence[str] = DEFAULT_ARMS,
    keys: Sequence[str] = ("system",),
    n_folds: int = C.DEFAULT_FOLDS,
    min_group: int = C.MIN_GROUP,
    floor: float = V.PROB_FLOOR,
) -> tuple[DataFrame, DataFrame]:
    """Out-of-fold calibrated vectors of every arm, and the fits behind them.

    ``items``: keys, benchmark, signature, item_id, question_id, fold, probs (normalised),
    gold_idx. Returns (keys, benchmark, item_id, question_id, gold_idx, arm, probs) and
    (keys, arm, target, grp, n_train, fallback, temperature, converged: NULL where a fit is not
    iterative). A group with fewer than ``min_group`` training rows uses the temperature fitted on all
    rows of its training folds.
    """
    keys = list(keys)
    logits = items.withColumn("z", V.centered(V.probs_to_logits(F.col("probs"), floor)))
    carried = [*keys, "benchmark", "item_id", "question_id", "gold_idx"]
    parsed = read_arms(arms)
    scopes = {"global"} | {scope for name, scope in parsed if name == "temperature"}
    temperatures = None
    if any(name != "identity" for name, _ in parsed):
        # One fit loop serves every temperature arm and the fallback.
        scoped = F.array(
            *[F.struct(F.lit(s).alias("scope"), fit_group(s).alias("grp")) for s in sorted(scopes)]
        )
        rows = logits.select(*keys, "fold", "z", "gold_idx", F.inline(scoped))
        temperatures = C.fit_temperature(rows, [*keys, "scope", "grp"], n_folds)
        fallback = temperatures.where("scope = 'global'").select(
            *keys, F.col("target").alias("fold"), F.col("temperature").alias("_t_all"), F.col("converged").alias("_c_all")
        )
    outputs, fits_out = [], []
    for name, scope in parsed:
        calibrator, label = CALIBRATORS[name], f"{name}@{scope}"
        grouped = logits.withColumn("grp", fit_group(scope))
        if name == "identity":
            out = grouped.withColumn("_p", calibrator.transform(F.col("z")))
        else:
            rows = grouped.select(*keys, "grp", "fold", "z", "gold_idx")
            on = [*keys, "grp"]
            if name == "temperature":
                fits = temperatures.where(F.col("scope") == scope).drop("scope")
            else:
                fits = calibrator.fit(rows, on, n_folds)
            usable = fits.where(F.col("n_train") >= min_group).drop("converged")
            applied = calibrator.join(
                grouped, usable.withColumnRenamed("target", "fold"), [*on, "fold"]
            ).join(broadcast_if_small(fallback.drop("_c_all")), [*keys, "fold"], "left")
            fitted = F.col("n_train").isNotNull()
            base = V.softmax(F.transform("z", lambda x: x / F.col("_t_all")))
            out = applied.withColumn(
                "_p", F.when(fitted, calibrator.transform(F.col("z"))).otherwise(base)
            )
            own = F.col("temperature") if "temperature" in calibrator.params else F.lit(None).cast("double")
            settled = F.col("converged") if "converged" in fits.columns else F.lit(None).cast("boolean")
            present = grouped.select(*on, F.col("fold").alias("target")).distinct()
            summary = (
                present.join(fits.groupBy(*on, "target").agg(F.max("n_train").alias("n_train"), F.max(own).alias("_t"), F.min(settled).alias("_c")), [*on, "target"], "left")
                .join(fallback.withColumnRenamed("fold", "target"), [*keys, "target"], "left")
            )
            short = F.coalesce(F.col("n_train"), F.lit(0)) < min_group
            fits_out.append(
                summary.select(
                    *keys, F.lit(label).alias("arm"), "target", "grp",
                    F.coalesce("n_train", F.lit(0)).alias("n_train"), short.alias("fallback"),
                    F.when(short, F.col("_t_all")).otherwise(F.col("_t")).alias("temperature"),
                    F.when(short, F.col("_c_all")).otherwise(F.col("_c")).alias("converged"),
                )
            )
        outputs.append(out.select(*carried, F.lit(label).alias("arm"), F.col("_p").alias("probs")))
    predictions = outputs[0]
    for more in outputs[1:]:
        predictions = predictions.unionByName(more)
    fits_table = None
    for f in fits_out:
        fits_table = f if fits_table is None else fits_table.unionByName(f)
    return predictions, fits_table


# --- deployment ------------------------------------------------------------------------------------


def fit_registry(
    items: DataFrame,
    backend: str,
    model: str,
    template_id: str,
    name: str = "temperature",
    min_group: int = C.MIN_GROUP,
    floor: float = V.PROB_FLOOR,
) -> tuple[DataFrame, DataFrame]:
    """(exact, fallbacks): ``name`` fitted per question signature with at least ``min_group``
    items, and one temperature over all items as the (model, template) fallback."""
    rows = items.select(
        F.col("signature").alias("grp"), F.lit(0).alias("fold"),
        V.centered(V.probs_to_logits(F.col("probs"), floor)).alias("z"), "gold_idx",
    )
    identity = [F.lit(backend).alias("backend"), F.lit(model).alias("model"), F.lit(template_id).alias("template_id")]
    calibrator = CALIBRATORS[name]
    fits = calibrator.fit(rows, ["grp"], None).where(F.col("n_train") >= min_group)
    exact = fits.select(
        *identity, F.col("grp").alias("signature"), F.lit(name).alias("name"), "n_train",
        *calibrator.params, *(["cell"] if name == "isotonic" else []), *(["converged"] if "converged" in fits.columns else []),
    )
    overall = C.fit_temperature(rows.withColumn("grp", F.lit("all")), ["grp"], None)
    fallbacks = overall.select(*identity[1:], F.lit("temperature").alias("name"), "n_train", "temperature")
    return exact, fallbacks


REGISTRY_KEY = ("backend", "model", "template_id", "signature")
PARAMETERS = {
    "temperature": "double", "bias": "array<double>", "a": "double", "b": "double", "edges": "array<double>", "values": "array<double>",
}
"""Columns of a registry: what any calibrator may need, NULL where another does not. Segments of
isotonic maps are a table of their own, one row per confidence cell."""


def registry_tables(fits: Sequence[DataFrame]) -> tuple[DataFrame, DataFrame]:
    """(entries, segments) of one registry, from what :func:`fit_registry` gave for several
    calibrators: one row per key with the calibrator's name and its parameters, and (key, cell,
    segments) of the isotonic ones. A key that is registered twice is an error."""
    entries, segments = None, None
    for fit in fits:
        own = [F.col(c) if c in fit.columns else F.lit(None).cast(t).alias(c) for c, t in PARAMETERS.items()]
        rows = fit.select(*REGISTRY_KEY, "name", "n_train", *own)
        if "cell" in fit.columns:
            rows = rows.distinct()
            cells = fit.select(*REGISTRY_KEY, "cell", "segments")
            segments = cells if segments is None else segments.unionByName(cells)
        entries = rows if entries is None else entries.unionByName(rows)
    if entries is None:
        raise ValueError("a registry needs at least one fit")
    if segments is None:
        piece = "array<struct<x0: double, y0: double, x1: double, y1: double>>"
        segments = entries.where("false").select(*REGISTRY_KEY, F.lit(0).alias("cell"), F.lit(None).cast(piece).alias("segments"))
    entries = checkpoint(entries)
    twice = entries.groupBy(*REGISTRY_KEY).count().where("count > 1").limit(1).collect()  # one row
    if twice:
        raise ValueError(f"registered more than once: {[twice[0][k] for k in REGISTRY_KEY]}")
    unknown = [r["name"] for r in entries.select("name").distinct().limit(len(CALIBRATORS) + 1).collect() if r["name"] not in CALIBRATORS]
    if unknown:
        raise ValueError(f"no such calibrators: {unknown}")
    return entries, segments


def apply_registry(
    requests: DataFrame, entries: DataFrame, segments: DataFrame, fallbacks: DataFrame, floor: float = V.PROB_FLOOR
) -> DataFrame:
    """Requests (registry key, probs, ...) with ``calibrated`` probabilities and ``calibrator``, as
    ``<name>:<source>``: each row is transformed by the calibrator registered for its key, else by its
    (model, template) fallback temperature, else not at all (its renormalised probabilities).

    Which calibrator applies is decided row by row, from one lookup of the key; isotonic keys then find
    the segments of their row's confidence cell by equality, not by comparing with every segment.
    """
    for taken in ("z", "cell", "segments", "calibrated", "calibrator", "name", *PARAMETERS):
        if taken in requests.columns:
            raise ValueError(f"requests have a column {taken!r}")
    logits = requests.withColumn("z", V.centered(V.probs_to_logits(F.col("probs"), floor)))
    own = logits.join(lookup(entries.select(*REGISTRY_KEY, "name", *PARAMETERS)), list(REGISTRY_KEY), "left")
    celled = own.withColumn("cell", F.when(F.col("name") == Isotonic.name, C._cell(F.array_max(V.softmax(F.col("z"))))))
    found = celled.join(lookup(segments), [*REGISTRY_KEY, "cell"], "left")
    general = fallbacks.select("model", "template_id", F.col("temperature").alias("_fallback"))
    found = found.join(lookup(general), ["model", "template_id"], "left")
    z = F.col("z")
    calibrated = None
    for name, calibrator in CALIBRATORS.items():
        chosen = F.when(F.col("name") == name, calibrator.transform(z)) if calibrated is None else calibrated.when(F.col("name") == name, calibrator.transform(z))
        calibrated = chosen
    by_fallback = V.softmax(F.transform(z, lambda x: x / F.col("_fallback")))
    calibrated = calibrated.when(F.col("_fallback").isNotNull(), by_fallback).otherwise(V.normalize("probs"))
    source = (
        F.when(F.col("name").isNotNull(), F.concat("name", F.lit(":exact")))
        .when(F.col("_fallback").isNotNull(), F.lit("temperature:temperature_fallback"))
        .otherwise(F.lit("identity:identity"))
    )
    return found.withColumn("calibrated", calibrated).withColumn("calibrator", source).select(*requests.columns, "calibrated", "calibrator")


def resolve_temperature(
    requests: DataFrame, exact: DataFrame, fallbacks: DataFrame
) -> DataFrame:
    """Requests (backend, model, template_id, signature, ...) with the temperature that applies
    and its source: the exact key, the (model, template) fallback, or the identity."""
    own = exact.select("backend", "model", "template_id", "signature", F.col("temperature").alias("_exact"))
    general = fallbacks.select("model", "template_id", F.col("temperature").alias("_fallback"))
    return (
        requests.join(lookup(own), ["backend", "model", "template_id", "signature"], "left")
        .join(lookup(general), ["model", "template_id"], "left")
        .withColumn("temperature", F.coalesce("_exact", "_fallback", F.lit(1.0)))
        .withColumn(
            "source",
            F.when(F.col("_exact").isNotNull(), "exact")
            .when(F.col("_fallback").isNotNull(), "temperature_fallback")
            .otherwise("identity"),
        )
        .drop("_exact", "_fallback")
    )
