"""Calibrator fits, cross-fitting, registries and confidence fits."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbline.functions import vectors as V
from plumbline.functions.scores import with_item_metrics
from plumbline.operators import calibration as C
from plumbline.operators import crossfit as X
from plumbline.operators import summaries as S
from plumbline.operators.confidence_fit import fit_power
from plumbline.queries import derived as D
from plumbline.queries.registry import n, query, r
from plumbline.queries.scoring import normalised
from plumbline.queries.summaries import ece_sql


def cal_items(spark, sf):
    """Normalised answers with a signature and a fold per question."""
    return normalised(spark, sf).withColumns(
        {
            "fold": (F.col("question_id").cast("bigint") % 5).cast("int"),
            "signature": F.concat(F.lit("choice:10:"), (F.col("item_id").cast("bigint") % 2).cast("string")),
        }
    )


def rows(spark, sf):
    return C.training_rows(cal_items(spark, sf), ["system"])


_CAL = """cal AS (SELECT system, item_id, gold_idx, question_id::BIGINT % 5 AS fold, list_transform(probs, lambda x: ln(greatest(1e-4, least(1.0, x)))) AS z FROM metrics),
train AS (SELECT c.*, f AS target FROM cal c, (SELECT unnest(range(0, 5)) AS f) WHERE fold <> f)"""


def _level(k: int, centre: str, step: float) -> str:
    """One round of a log-temperature grid around the previous best."""
    grid = f"(SELECT unnest(range(-30, 31)) AS i)"
    return f"""l{k} AS (SELECT system, target, arg_min(g, (loss, g)) AS g FROM (
      SELECT system, target, g, avg(ln(list_reduce(list_transform(z, lambda x: exp(x / exp(g))), lambda a, y: a + y)) - z[gold_idx + 1] / exp(g)) AS loss FROM (
        SELECT t.system, t.target, t.z, t.gold_idx, {centre} + i * {step} AS g FROM {'train t' if k == 1 else f'train t JOIN l{k - 1} USING (system, target)'}, {grid}) GROUP BY 1, 2, 3) GROUP BY 1, 2)"""


_TEMPERATURE = ", ".join([_level(1, "0.0", 0.08), _level(2, "g", 0.003), _level(3, "g", 0.0001), _level(4, "g", 0.000004)])


@query(
    "temperature_fits",
    f"WITH {_CAL}, {_TEMPERATURE} SELECT system, {n('target', 'target')}, round(exp(g), 3) + 0.0::DOUBLE AS temperature, {n('(SELECT count(*) FROM train t WHERE t.system = l4.system AND t.target = l4.target)', 'n_train')} FROM l4", ("metrics",),
)
def temperature_fits(spark, sf):
    """Out-of-fold temperatures (three decimals) of every system and held-out fold."""
    fits = C.fit_temperature(rows(spark, sf), ["system"])
    return fits.select("system", "target", F.round("temperature", 3).alias("temperature"), "n_train")


@query(
    "temperature_summary",
    f"WITH {_CAL}, {_TEMPERATURE} SELECT system, {n('count(*)', 'n_folds')}, round(avg(exp(g)), 2) + 0.0::DOUBLE AS mean_temperature, round(min(exp(g)), 2) + 0.0::DOUBLE AS min_temperature, round(max(exp(g)), 2) + 0.0::DOUBLE AS max_temperature FROM l4 GROUP BY 1", ("metrics",),
)
def temperature_summary(spark, sf):
    """Mean and range of the fitted temperatures over folds."""
    fits = C.fit_temperature(rows(spark, sf), ["system"]).withColumn("fallback", F.col("n_train") < C.MIN_GROUP)
    out = S.parameter_summary(fits, ["system"])
    return out.select("system", "n_folds", *[F.round(c, 2).alias(c) for c in out.columns if c.endswith("temperature")])


_TOP = """top AS (SELECT system, fold, exp(list_max(z)) / total AS conf, (list_position(z, list_max(z)) - 1 = gold_idx)::INTEGER AS hit FROM (
  SELECT *, list_reduce(list_transform(z, lambda x: exp(x)), lambda a, y: a + y) AS total FROM cal)), tt AS (SELECT system, round(conf, 9) AS conf, hit, f AS target FROM top, (SELECT unnest(range(0, 5)) AS f) WHERE fold <> f)"""


def top_rows(spark, sf):
    """Logits whose top probability is rounded to nine decimals (equal on both engines)."""
    p = V.softmax(V.probs_to_logits(F.col("probs")))
    conf = F.round(F.array_max(p), 9)
    items = cal_items(spark, sf)
    hit = V.argmax(F.col("probs")) == F.col("gold_idx")
    return items.select(
        "system", "fold", F.array(F.ln(conf), F.ln(1.0 - conf)).alias("z"), F.when(hit, 0).otherwise(1).alias("gold_idx"), conf.alias("conf")
    )


@query(
    "histogram_fits",
    f"""WITH {_CAL}, {_TOP}, e AS (SELECT system, target, unnest([{', '.join(f'quantile_disc(conf, {j / 10})' for j in range(1, 10))}]) AS edge, max(conf) AS top_ FROM tt GROUP BY 1, 2),
    ed AS (SELECT system, target, list_sort(list(DISTINCT edge)) AS edges FROM e WHERE edge < top_ GROUP BY 1, 2),
    b AS (SELECT system, target, len(list_filter(edges, lambda x: x < conf)) AS bin, hit, edges FROM tt JOIN ed USING (system, target))
    SELECT system, {n('target', 'target')}, bin::BIGINT AS bin, {r('avg(hit)', 'value')}, {r('any_value(edges)[bin]', 'lower_edge')} FROM b GROUP BY system, target, bin""",
    ("metrics",),
)
def histogram_fits(spark, sf):
    """Out-of-fold histogram calibrators: bin edges and accuracies."""
    two = _two_way(spark, sf)
    fits = C.fit_histogram(two, ["system"])
    bins = fits.select("system", "target", "edges", F.posexplode("values").alias("bin", "value"))
    return bins.select("system", "target", "bin", "value", F.when(F.col("bin") > 0, F.get("edges", F.col("bin") - 1)).alias("lower_edge"))


def _two_way(spark, sf):
    """Rows for the top-probability calibrators: a vector whose top entry is the rounded top
    probability, gold 0 when the top key was right."""
    items = top_rows(spark, sf)
    # Five equal other entries keep the top entry on top whatever the confidence.
    rest = F.array_repeat(F.ln((1.0 - F.col("conf")) / 50.0), F.lit(50))
    return items.select("system", "fold", F.concat(F.array(F.ln("conf")), rest).alias("z"), "gold_idx")


_ISO = """d AS (SELECT system, target, round(conf, 6) AS conf, sum(hit)::DOUBLE AS h, count(*)::DOUBLE AS w FROM tt GROUP BY 1, 2, 3),
i AS (SELECT *, row_number() OVER (PARTITION BY system, target ORDER BY conf) AS k, sum(h) OVER q AS ch, sum(w) OVER q AS cw FROM d WINDOW q AS (PARTITION BY system, target ORDER BY conf ROWS UNBOUNDED PRECEDING)),
p AS (SELECT a.system, a.target, a.k AS j, b.k AS k, (b.ch - a.ch + a.h) / (b.cw - a.cw + a.w) AS m FROM i a JOIN i b ON a.system = b.system AND a.target = b.target AND a.k <= b.k),
lo AS (SELECT system, target, j, k, min(m) OVER (PARTITION BY system, target, j ORDER BY k DESC ROWS UNBOUNDED PRECEDING) AS m FROM p),
fit AS (SELECT system, target, k, max(m) AS v FROM lo GROUP BY 1, 2, 3)"""


@query(
    "isotonic_fits",
    f"""WITH {_CAL}, {_TOP}, {_ISO} SELECT f.system, {n('f.target', 'target')}, {r('min(conf)', 'low')}, {r('max(conf)', 'high')}, {r('v', 'value')}, {r('sum(w)', 'weight')} FROM fit f JOIN i ON i.system = f.system AND i.target = f.target AND i.k = f.k GROUP BY f.system, f.target, round(v, 12), v""",
    ("metrics",),
)
def isotonic_fits(spark, sf):
    """Out-of-fold isotonic fits: stretches of constant accuracy over the top probability."""
    items = top_rows(spark, sf).withColumn("conf", F.round("conf", 6))
    rest = F.array_repeat(F.ln((1.0 - F.col("conf")) / 50.0), F.lit(50))
    two = items.select("system", "fold", F.concat(F.array(F.ln("conf")), rest).alias("z"), "gold_idx")
    return C.fit_isotonic(two, ["system"])


_PLATT_ROUNDS = 14


def _platt_round(k: int) -> str:
    """One damped Newton step of every fit, written out."""
    sums = "any_value(p.n) AS n, any_value(t_hit) AS t_hit, any_value(t_miss) AS t_miss, any_value(a) AS a, any_value(b) AS b"
    return f"""p{k} AS (SELECT system, target, n, t_hit, t_miss, a - shrink * da AS a, b - shrink * db AS b FROM (SELECT *, least(1.0, 2.0 / greatest(abs(da), abs(db), 1e-12)) AS shrink FROM (
      SELECT *, (hbb * ga - hab * gb) / (haa * hbb - hab * hab) AS da, (haa * gb - hab * ga) / (haa * hbb - hab * hab) AS db FROM (
        SELECT system, target, {sums}, sum(g * s) AS ga, sum(g) AS gb, sum(v * s * s) + 1e-10 * any_value(n) AS haa, sum(v * s) AS hab, sum(v) + 1e-10 * any_value(n) AS hbb FROM (
          SELECT *, q - CASE WHEN hit THEN t_hit ELSE t_miss END AS g, q * (1 - q) AS v FROM (SELECT st.system, st.target, s, hit, n, t_hit, t_miss, a, b, 1 / (1 + exp(-(a * s + b))) AS q FROM st JOIN p{k - 1} USING (system, target))) p GROUP BY 1, 2))))"""


_PLATT = f"""st AS (SELECT system, target, greatest(-30.0, least(30.0, list_max(z) - ln(list_reduce(list_transform(z, lambda x: exp(x)), lambda x, y: x + y) - exp(list_max(z))))) AS s, list_position(z, list_max(z)) - 1 = gold_idx AS hit FROM train),
p0 AS (SELECT system, target, count(*) AS n, (count(*) FILTER (WHERE hit) + 1.0) / (count(*) FILTER (WHERE hit) + 2.0) AS t_hit, 1.0 / (count(*) FILTER (WHERE NOT hit) + 2.0) AS t_miss, 1.0::DOUBLE AS a, 0.0::DOUBLE AS b FROM st GROUP BY 1, 2),
{', '.join(_platt_round(k) for k in range(1, _PLATT_ROUNDS + 1))}"""


@query(
    "platt_fits",
    f"WITH {_CAL}, {_PLATT} SELECT system, {n('target', 'target')}, {n('n', 'n_train')}, {r('a', 'a')}, {r('b', 'b')}, true AS converged FROM p{_PLATT_ROUNDS}", ("metrics",),
)
def platt_fits(spark, sf):
    """Out-of-fold Platt parameters."""
    return C.fit_platt(rows(spark, sf), ["system"])


@query("vector_fits")
def vector_fits(spark, sf):
    """Out-of-fold vector scaling (iterative, rows only)."""
    fits = C.fit_vector(rows(spark, sf), ["system"])
    return fits.select("system", "target", "temperature", F.posexplode("bias").alias("pos", "bias"))


@query(
    "crossfit_temperature_arm",
    f"""WITH {_CAL}, {_TEMPERATURE}, t AS (SELECT system, target AS fold, exp(g) AS t FROM l4),
    p AS (SELECT c.system, c.item_id, c.gold_idx, list_transform(z, lambda x: exp(x / t)) AS e FROM cal c JOIN t USING (system, fold))
    SELECT system, {n('count(*)', 'n')}, round(avg(-ln(greatest(1e-6, e[gold_idx + 1] / list_reduce(e, lambda a, y: a + y)))), 4) + 0.0::DOUBLE AS nll FROM p GROUP BY 1""",
    ("metrics",),
)
def crossfit_temperature_arm(spark, sf):
    """Log loss of every system calibrated out of fold by temperature (four decimals: the SQL searches
    temperatures on a grid)."""
    predictions, _ = X.crossfit(cal_items(spark, sf), ["temperature@global"])
    return with_item_metrics(predictions).groupBy("system").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("nll"), 4).alias("nll"))


@query(
    "crossfit_platt_arm",
    f"""WITH {_CAL}, {_PLATT}, e AS (SELECT c.system, c.item_id, gold_idx, z, list_position(z, list_max(z)) AS top, list_reduce(list_transform(z, lambda x: exp(x)), lambda x, y: x + y) AS total, a, b
      FROM cal c JOIN p{_PLATT_ROUNDS} p ON p.system = c.system AND p.target = c.fold),
    q AS (SELECT *, list_transform(z, lambda x, i: CASE WHEN i = top THEN 0.0 ELSE exp(x) / total END) AS o, 1 / (1 + exp(-(a * greatest(-30.0, least(30.0, list_max(z) - ln(total - exp(list_max(z))))) + b))) AS told FROM e),
    k AS (SELECT *, list_reduce(o, lambda x, y: x + y) AS rest, greatest(told, list_max(o) / (list_max(o) + list_reduce(o, lambda x, y: x + y))) AS kept FROM q)
    SELECT system, {n('count(*)', 'n')}, round(avg(-ln(least(1.0, greatest(1e-6, CASE WHEN gold_idx = top - 1 THEN kept ELSE o[gold_idx + 1] / rest * (1 - kept) END)))), 5) + 0.0::DOUBLE AS nll FROM k GROUP BY 1""",
    ("metrics",),
)
def crossfit_platt_arm(spark, sf):
    """Log loss of every system calibrated out of fold by Platt scaling."""
    predictions, _ = X.crossfit(cal_items(spark, sf), ["platt@global"])
    return with_item_metrics(predictions).groupBy("system").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("nll"), 5).alias("nll"))


@query(
    "identity_arm",
    f"""WITH c AS (SELECT system, benchmark, item_id, gold_idx, list_transform(probs, lambda x: greatest(1e-4, least(1.0, x))) AS q FROM metrics),
    m AS (SELECT *, list_transform(q, lambda x: x / list_reduce(q, lambda a, y: a + y)) AS probs FROM c), s AS (
      SELECT system, benchmark, item_id, list_max(probs) AS confidence, list_position(probs, list_max(probs)) - 1 = gold_idx AS correct, -ln(probs[gold_idx + 1]) AS nll FROM m)
    SELECT system, benchmark, {r('any_value(ece)', 'ece')}, {r('avg(nll)', 'nll')} FROM s JOIN ({ece_sql('s')}) USING (system, benchmark) GROUP BY 1, 2""",
    ("metrics",),
)
def identity_arm(spark, sf):
    """The uncalibrated arm: floored probabilities renormalised."""
    predictions, _ = X.crossfit(cal_items(spark, sf), ["identity@global"])
    m = with_item_metrics(predictions)
    return m.groupBy("system", "benchmark").agg(F.avg("nll").alias("nll")).join(S.ece_equal_mass(m, ["system", "benchmark"]), ["system", "benchmark"])


@query("crossfit_arms")
def crossfit_arms(spark, sf):
    """Every default calibrator arm out of fold: accuracy, log loss and Brier per system and arm
    (iterative fits, rows only)."""
    predictions, _ = X.crossfit(cal_items(spark, sf))
    m = with_item_metrics(predictions)
    return m.groupBy("system", "arm").agg(
        F.count(F.lit(1)).alias("n"), F.avg(S.as_double("correct")).alias("accuracy"), F.avg("nll").alias("nll"), F.avg("brier").alias("brier")
    )


@query(
    "fit_records",
    f"""WITH c AS (SELECT system, benchmark AS grp, question_id::BIGINT % 5 AS fold FROM metrics)
    SELECT system, 'temperature@benchmark' AS arm, grp, {n('target', 'target')}, {n('count(*) FILTER (WHERE fold <> target)', 'n_train')}, count(*) FILTER (WHERE fold <> target) < 100 AS fallback FROM c, (SELECT unnest(range(0, 5)) AS target)
    GROUP BY 1, 3, 4 HAVING count(*) FILTER (WHERE fold = target) > 0""",
    ("metrics",),
)
def fit_records(spark, sf):
    """Which fits had enough rows and which fell back to the fold's global temperature."""
    _, fits = X.crossfit(cal_items(spark, sf), ["temperature@benchmark"], min_group=100)
    return fits.select("system", "arm", "grp", "target", "n_train", "fallback")


@query(
    "registry_resolution",
    f"""WITH req AS (SELECT conv_id, turn, role AS backend, 'm' || conv_id % 3 AS model, 't' || turn % 2 AS template_id, 's' || conv_id % 5 AS signature FROM conversations),
    ex AS (SELECT DISTINCT backend, model, template_id, signature, 1 + right(signature, 1)::DOUBLE / 10 AS t FROM req WHERE signature IN ('s0', 's1')),
    fb AS (SELECT DISTINCT model, template_id, 2 + right(model, 1)::DOUBLE / 10 AS t FROM req WHERE model <> 'm2')
    SELECT conv_id, turn, {r('coalesce(ex.t, fb.t, 1)', 'temperature')}, CASE WHEN ex.t IS NOT NULL THEN 'exact' WHEN fb.t IS NOT NULL THEN 'temperature_fallback' ELSE 'identity' END AS source
    FROM req LEFT JOIN ex USING (backend, model, template_id, signature) LEFT JOIN fb ON fb.model = req.model AND fb.template_id = req.template_id""",
)
def registry_resolution(spark, sf):
    """Parameters found by exact key, by model and template, or not at all."""
    c = D.table(spark, sf, "conversations")
    req = c.select(
        "conv_id", "turn", F.col("role").alias("backend"), F.concat(F.lit("m"), (F.col("conv_id") % 3).cast("string")).alias("model"),
        F.concat(F.lit("t"), (F.col("turn") % 2).cast("string")).alias("template_id"), F.concat(F.lit("s"), (F.col("conv_id") % 5).cast("string")).alias("signature"),
    )
    last = lambda c: F.substring(c, 2, 1).cast("double") / 10
    exact = req.where(F.col("signature").isin("s0", "s1")).select(
        "backend", "model", "template_id", "signature", (1 + last("signature")).alias("temperature")
    ).distinct()
    general = req.where("model <> 'm2'").select("model", "template_id", (2 + last("model")).alias("temperature")).distinct()
    return X.resolve_temperature(req, exact, general).select("conv_id", "turn", "temperature", "source")


@query(
    "deployment_registry",
    f"""WITH s AS (SELECT system || ':' || (item_id::BIGINT % 2) AS grp, gold_idx, list_transform(probs, lambda x: ln(greatest(1e-4, least(1.0, x)))) AS z FROM metrics),
    train AS (SELECT grp AS system, 0 AS target, z, gold_idx FROM s UNION ALL SELECT 'all', 0, z, gold_idx FROM s), {_TEMPERATURE}, c AS (SELECT system, count(*) AS k FROM train GROUP BY 1)
    SELECT system AS signature, {n('k', 'n_train')}, round(exp(g), 3) + 0.0::DOUBLE AS temperature FROM l4 JOIN c USING (system) WHERE k >= 30 OR system = 'all'""",
    ("metrics",),
)
def deployment_registry(spark, sf):
    """Temperatures of the signatures with enough items, and of all items (signature ``all``, the
    fallback); three decimals."""
    signature = F.concat_ws(":", "system", (F.col("item_id").cast("bigint") % 2).cast("string"))
    exact, fallbacks = X.fit_registry(cal_items(spark, sf).withColumn("signature", signature), "api", "m", "t")
    rows_ = exact.select("signature", "n_train", "temperature").unionByName(fallbacks.select(F.lit("all").alias("signature"), "n_train", "temperature"))
    return rows_.withColumn("temperature", F.round("temperature", 3))


# Fixed values of the registry below: one signature for each calibrator, and a fallback.
_T, _BIAS, _A, _B = 1.7, [0.3, -0.1, 0.2, 0.0, -0.4, 0.1, 0.0, 0.25, -0.35, 0.0], 0.8, -0.2
_EDGES, _VALUES = [0.2, 0.35, 0.6], [0.15, 0.3, 0.5, 0.8]
_BLOCKS = [(0.15, 0.3, 0.2), (0.34, 0.5, 0.4), (0.55, 0.9, 0.7)]
_FALLBACK = 2.5


def registry_parts(spark):
    """(fits, fallbacks): what fits of five calibrators would have left for five signatures."""
    key = "'api' AS backend, 'm' AS model, 't' AS template_id"
    listed = lambda xs: "array(" + ", ".join(f"{x}D" for x in xs) + ")"
    one = lambda sig, name, params: spark.sql(f"SELECT {key}, 's{sig}' AS signature, '{name}' AS name, 100 AS n_train, {params}")
    blocks = spark.createDataFrame([("s4", C.ALL_ROWS, *b) for b in _BLOCKS], "signature string, target int, low double, high double, value double")
    cells = C.isotonic_lookup(blocks, ["signature"]).selectExpr(
        "'api' AS backend", "'m' AS model", "'t' AS template_id", "signature", "'isotonic' AS name", "100 AS n_train", "cell", "segments"
    )
    fits = [
        one(0, "temperature", f"{_T}D AS temperature"), one(1, "vector", f"{_T}D AS temperature, {listed(_BIAS)} AS bias"), one(2, "platt", f"{_A}D AS a, {_B}D AS b"),
        one(3, "histogram", f"{listed(_EDGES)} AS edges, {listed(_VALUES)} AS values"), cells,
    ]
    return fits, spark.sql(f"SELECT 'm' AS model, 't' AS template_id, 'temperature' AS name, 9 AS n_train, {_FALLBACK}D AS temperature")


_POINTS = [(0.0, _BLOCKS[0][2]), *[(x, v) for low, high, v in _BLOCKS for x in (low, high)], (1.0, _BLOCKS[-1][2])]
_ISOTONIC = "CASE " + " ".join(f"WHEN conf <= {x1} THEN {y0} + ({y1} - {y0}) * (conf - {x0}) / ({x1} - {x0})" for (x0, y0), (x1, y1) in zip(_POINTS, _POINTS[1:])) + " END"
_TOTAL = "list_reduce({0}, lambda a, y: a + y)"


@query(
    "registry_applied",
    f"""WITH req AS (SELECT system, item_id, probs, 's' || item_id::BIGINT % 6 AS signature, CASE WHEN item_id::BIGINT % 11 = 0 THEN 'u' ELSE 't' END AS template_id FROM metrics),
    q AS (SELECT *, list_transform(probs, lambda x: ln(greatest(1e-4, least(1.0, x)))) AS z, CASE WHEN template_id = 't' THEN signature ELSE 'none' END AS s FROM req),
    e AS (SELECT *, list_transform(z, lambda x: exp(x - list_max(z))) AS ex FROM q), p0 AS (SELECT *, list_transform(ex, lambda x: x / {_TOTAL.format('ex')}) AS p FROM e),
    p1 AS (SELECT *, list_max(p) AS conf, list_position(p, list_max(p)) AS top FROM p0),
    c AS (SELECT *, CASE s WHEN 's2' THEN 1 / (1 + exp(-({_A} * greatest(-30, least(30, ln(conf) - ln(1 - conf))) + {_B}))) WHEN 's3' THEN {_VALUES}[1 + (conf > {_EDGES[0]})::INTEGER + (conf > {_EDGES[1]})::INTEGER + (conf > {_EDGES[2]})::INTEGER]
      WHEN 's4' THEN {_ISOTONIC} END AS told, list_transform(p, lambda x, i: CASE WHEN i = top THEN 0 ELSE x END) AS o FROM p1),
    d AS (SELECT *, greatest(told, list_max(o) / (list_max(o) + {_TOTAL.format('o')})) AS kept,
      list_transform(z, lambda x, i: exp(CASE s WHEN 's0' THEN x / {_T} WHEN 's1' THEN x / {_T} + {_BIAS}[i] ELSE x / {_FALLBACK} END)) AS w FROM c),
    f AS (SELECT *, CASE WHEN s = 'none' THEN list_transform(probs, lambda x: x / {_TOTAL.format('probs')}) WHEN s IN ('s2', 's3', 's4') THEN list_transform(o, lambda x, i: CASE WHEN i = top THEN kept ELSE x / {_TOTAL.format('o')} * (1 - kept) END)
      ELSE list_transform(w, lambda x: x / {_TOTAL.format('w')}) END AS calibrated,
      CASE s WHEN 'none' THEN 'identity:identity' WHEN 's0' THEN 'temperature:exact' WHEN 's1' THEN 'vector:exact' WHEN 's2' THEN 'platt:exact' WHEN 's3' THEN 'histogram:exact' WHEN 's4' THEN 'isotonic:exact' ELSE 'temperature:temperature_fallback' END AS calibrator FROM d)
    SELECT system, item_id, calibrator, {n('unnest(range(0, 10))', 'pos')}, round(unnest(calibrated), 6) + 0.0::DOUBLE AS p FROM f""",
    ("metrics",),
)
def registry_applied(spark, sf):
    """Every answer calibrated by what its signature has registered: temperature, vector scaling,
    Platt, histogram or isotonic, else the fallback temperature, else nothing."""
    i = F.col("item_id").cast("bigint")
    requests = normalised(spark, sf).select(
        "system", "item_id", "probs", F.lit("api").alias("backend"), F.lit("m").alias("model"),
        F.when(i % 11 == 0, "u").otherwise("t").alias("template_id"), F.concat(F.lit("s"), (i % 6).cast("string")).alias("signature"),
    )
    fits, fallbacks = registry_parts(spark)
    out = X.apply_registry(requests, *X.registry_tables(fits), fallbacks)
    return out.select("system", "item_id", "calibrator", F.posexplode("calibrated").alias("pos", "p"))


def _power_level(k: int, step: float) -> str:
    src = "s" if k == 1 else f"s JOIN g{k - 1} USING (kind)"
    centre = "0.0" if k == 1 else "g"
    return f"""g{k} AS (SELECT kind, arg_min(g, (loss, g)) AS g FROM (SELECT kind, g, avg(power(power(x, exp(g)) - y, 2)) AS loss FROM (
      SELECT kind, x, y, greatest(ln(0.2), least(ln(5.0), {centre} + i * {step})) AS g FROM {src}, (SELECT unnest(range(-30, 31)) AS i)) GROUP BY 1, 2) GROUP BY 1)"""


@query(
    "confidence_power_fit",
    f"""WITH s AS (SELECT qtype AS kind, list_max(probs) / list_reduce(probs, lambda a, y: a + y) AS x, power(list_max(probs), 0.7 + 0.1 * (item_id::BIGINT % 5)) AS y FROM all_preds WHERE qtype <> 'noul'),
    {_power_level(1, 0.054)}, {_power_level(2, 0.002)}, {_power_level(3, 0.0001)} SELECT kind, round(exp(g), 2) + 0.0::DOUBLE AS gamma FROM g3""",
    ("all_preds",),
)
def confidence_power_fit(spark, sf):
    """The exponent that best maps the top probability to a reported confidence, per kind."""
    p = D.all_preds(spark, sf).where("qtype <> 'noul'")
    reported = F.pow(F.array_max("probs"), 0.7 + 0.1 * (F.col("item_id").cast("bigint") % 5))
    samples = p.select(F.col("qtype").alias("kind"), V.normalize("probs").alias("probs"), reported.alias("reported"))
    return fit_power(samples, "max_prob").select("kind", F.round("gamma", 2).alias("gamma"))
