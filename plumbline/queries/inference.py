"""Paired inference on hashed Poisson resamples."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbline.functions.scores import with_scores
from plumbline.operators import alignment as A
from plumbline.operators import bootstrap as B
from plumbline.queries import derived as D
from plumbline.queries.registry import n, query, r

RESAMPLES = B.DEFAULT_RESAMPLES
CLUSTER = ("benchmark", "question_id")
_M = B.MODULUS
_WEIGHT = "(" + " + ".join(f"(u >= {s})::INTEGER" for s in B.POISSON_STEPS) + ")"


def resample_sql(source: str, groups: str, values: tuple[str, ...], resamples: int = RESAMPLES) -> str:
    """(groups, r, w, s_*) of the same hashed Poisson resamples."""
    sums = ", ".join(f"sum(({v})::DOUBLE) AS v{i}" for i, v in enumerate(values))
    weighted = ", ".join(f"sum({_WEIGHT} * v{i}) AS s{i}" for i in range(len(values)))
    return f"""SELECT {groups}, r, sum({_WEIGHT} * n) AS w, {weighted} FROM (
      SELECT *, (a + r * b) % {_M} AS u FROM (
        SELECT {groups}, count(*) AS n, {sums},
          ('0x' || substr(sha256(concat_ws(chr(31), '0', benchmark, question_id)), 1, 15))::BIGINT % {_M} AS a,
          ('0x' || substr(sha256(concat_ws(chr(31), '0', benchmark, question_id)), 16, 15))::BIGINT % {_M} AS b
        FROM {source} GROUP BY {groups}, benchmark, question_id), (SELECT unnest(range(0, {resamples})) AS r)) GROUP BY {groups}, r"""


def _phi(x: str) -> str:
    """The normal distribution function of a SQL expression between -8 and 8, by its power series."""
    term = f"CASE WHEN abs({x}) < 1e-12 THEN 0.0::DOUBLE ELSE exp((2 * i + 1) * ln(abs({x})) - ((i + 1) * ln(2.0) + lgamma(i + 1.5) - 0.5 * ln(pi()))) END"
    return f"(0.5 + sign({x}) * exp(-({x}) * ({x}) / 2) / sqrt(2 * pi()) * list_sum(list_transform(range(0, 120), lambda i: {term})))"


_STEPS = "[0.0::DOUBLE, " + ", ".join(f"{4 / 2**k!r}::DOUBLE" for k in range(56)) + "]"
_Z = -1.959963984540054


def moments_sql(source: str, groups: str, values: tuple[str, ...], cluster: str = "question_id") -> str:
    """(groups, k, e<i>, q<i>, c<i>): clusters, means, and sums of squares and cubes of how far the mean
    of the leave-one-cluster-out means lies above each of them."""
    i_, over = range(len(values)), f"OVER (PARTITION BY {groups})"
    own = ", ".join(f"sum(({v})::DOUBLE) AS s{i}" for i, v in enumerate(values))
    whole = ", ".join(f"sum(s{i}) {over} AS all_{i}" for i in i_)
    left = ", ".join(f"all_{i} / all_n AS e{i}, (all_{i} - s{i}) / nullif(all_n - own_n, 0) AS j{i}" for i in i_)
    away = ", ".join(f"avg(j{i}) {over} - j{i} AS d{i}" for i in i_)
    sums = ", ".join(f"any_value(e{i}) AS e{i}, coalesce(sum(d{i} * d{i}), 0) AS q{i}, coalesce(sum(d{i} * d{i} * d{i}), 0) AS c{i}" for i in i_)
    return f"""SELECT {groups}, count(*) AS k, {sums} FROM (SELECT *, {away} FROM (SELECT *, {left} FROM (SELECT *, sum(own_n) {over} AS all_n, {whole} FROM (
      SELECT {groups}, {cluster}, count(*)::DOUBLE AS own_n, {own} FROM {source} GROUP BY {groups}, {cluster})))) GROUP BY {groups}"""


def macro_moments_sql(moments: str, keys: str, n_values: int) -> str:
    """The moments of the average over benchmarks."""
    sums = ", ".join(f"avg(e{i}) AS e{i}, sum(q{i}) / power(count(*), 2) AS q{i}, sum(c{i}) / power(count(*), 3) AS c{i}" for i in range(n_values))
    return f"SELECT {keys + ',' if keys else ''} sum(k) AS k, {sums} FROM {moments} {'GROUP BY ' + keys if keys else ''}"


def ends_sql(replicates: str, moments: str, groups: str, n_values: int, min_clusters: int = B.BCA_MIN_CLUSTERS) -> str:
    """(groups, e<i>, l<i>, h<i>): means and both interval ends from replicates m<i>: BCa from
    ``min_clusters`` clusters, percentiles below."""
    i_ = range(n_values)
    lists = ", ".join(f"list_sort(list(m{i}) FILTER (WHERE m{i} IS NOT NULL)) AS b{i}" for i in i_)
    shares = ", ".join(f"greatest(0.5 / len(b{i}), least(1 - 0.5 / len(b{i}), len(list_filter(b{i}, lambda x: x < e{i}))::DOUBLE / len(b{i}))) AS f{i}" for i in i_)
    accelerations = ", ".join(f"CASE WHEN q{i} > 0 THEN c{i} / (6 * power(q{i}, 1.5)) ELSE 0 END AS a{i}" for i in i_)
    starts = ", ".join(f"list_reduce({_STEPS}, lambda x, s: x + CASE WHEN {_phi('x')} < f{i} THEN s ELSE -s END) AS z{i}" for i in i_)
    inner = lambda i, z: f"greatest(-8.0, least(8.0, z{i} + (z{i} + {z}) / (1 - a{i} * (z{i} + {z}))))"
    points = ", ".join(f"{inner(i, _Z)} AS x{i}, {inner(i, -_Z)} AS y{i}" for i in i_)
    levels = ", ".join(f"CASE WHEN k >= {min_clusters} THEN {_phi(f'x{i}')} ELSE 0.025 END * (len(b{i}) - 1) AS u{i}, CASE WHEN k >= {min_clusters} THEN {_phi(f'y{i}')} ELSE 0.975 END * (len(b{i}) - 1) AS v{i}" for i in i_)
    at = lambda i, u: f"CASE WHEN b{i}[1] = b{i}[-1] THEN e{i} ELSE b{i}[1 + floor({u}{i})::BIGINT] * (1 - {u}{i} + floor({u}{i})) + b{i}[least(2 + floor({u}{i})::BIGINT, len(b{i}))] * ({u}{i} - floor({u}{i})) END"
    out = ", ".join(f"e{i}, {at(i, 'u')} AS l{i}, {at(i, 'v')} AS h{i}" for i in i_)
    joined = f"(SELECT {groups}, {lists} FROM {replicates} GROUP BY {groups}) JOIN (SELECT * FROM {moments}) USING ({groups})" if groups else f"(SELECT {lists} FROM {replicates}), {moments}"
    return f"""SELECT {groups + ',' if groups else ''} {out} FROM (SELECT *, {levels} FROM (SELECT *, {points} FROM (SELECT *, {starts} FROM (SELECT *, {shares}, {accelerations} FROM {joined}))))"""


def _ends(names: tuple[str, ...]) -> str:
    return ", ".join(r(f"e{i}", v) + ", " + r(f"l{i}", "low_" + v) + ", " + r(f"h{i}", "high_" + v) for i, v in enumerate(names))


def _drawn(n_values: int) -> str:
    return ", ".join(f"s{i} / w AS m{i}" for i in range(n_values))


def ece_replicates_sql(source: str, groups: str, resamples: int = RESAMPLES) -> str:
    """(groups, r, ece): calibration error of every resample, whose copies are written out."""
    return f"""SELECT {groups}, r, sum(abs(h - c)) / sum(k) AS ece FROM (SELECT {groups}, r, bin, sum(confidence) AS c, sum(accuracy) AS h, count(*) AS k FROM (
      SELECT *, ntile(10) OVER (PARTITION BY {groups}, r ORDER BY confidence, ('0x' || substr(sha256(item_id), 1, 15))::BIGINT, copy) AS bin FROM (
        SELECT {groups}, item_id, confidence, accuracy, r, unnest(range(0, {_WEIGHT})) AS copy FROM (
          SELECT *, (a + r * b) % {_M} AS u FROM (SELECT *, ('0x' || substr(sha256(concat_ws(chr(31), '0', benchmark, question_id)), 1, 15))::BIGINT % {_M} AS a,
            ('0x' || substr(sha256(concat_ws(chr(31), '0', benchmark, question_id)), 16, 15))::BIGINT % {_M} AS b FROM {source}), (SELECT unnest(range(0, {resamples})) AS r)))) GROUP BY {groups}, r, bin) GROUP BY {groups}, r"""


def scored(spark, sf):
    return with_scores(D.preds(spark, sf))


_PAIRS = """pairs AS (SELECT a.benchmark, a.question_id, a.item_id, a.correct::INTEGER - b.correct::INTEGER AS d_accuracy, a.nll - b.nll AS d_nll, a.brier - b.brier AS d_brier,
  a.correct AS correct_a, b.correct AS correct_b FROM scored_choice a JOIN scored_choice b ON a.item_id = b.item_id AND a.system = 'a' AND b.system = 'b')"""


def pairs(spark, sf):
    """Per-item differences of the two systems."""
    p = A.pair_systems(scored(spark, sf), "a", "b", ["question_id", "correct", "nll", "brier"])
    return p.select(
        "benchmark", F.col("question_id_a").alias("question_id"), "item_id", "correct_a", "correct_b",
        (F.col("correct_a").cast("int") - F.col("correct_b").cast("int")).alias("d_accuracy"),
        (F.col("nll_a") - F.col("nll_b")).alias("d_nll"), (F.col("brier_a") - F.col("brier_b")).alias("d_brier"),
    )


VALUES = ("d_accuracy", "d_nll", "d_brier")


@query(
    "bootstrap_sums",
    f"""SELECT system, benchmark, r::BIGINT AS r, {r('w', 'w')}, {r('s0', 's_correct')} FROM ({resample_sql('noul', 'system, benchmark', ('correct',))})""".replace(
        "FROM noul ", "FROM (SELECT *, probs[1 + gold_idx] >= 0.5 AND (gold_idx = 0 OR probs[1] < 0.5) AS correct FROM noul_preds) "
    ),
    ("noul_preds",),
)
def bootstrap_sums(spark, sf):
    """Weighted sums of all hashed resamples of line-item clusters."""
    rows = with_scores(D.noul_preds(spark, sf))
    return B.bootstrap_sums(rows, ["system", "benchmark"], CLUSTER, ["correct"], RESAMPLES)


@query(
    "paired_bootstrap",
    f"""WITH {_PAIRS}, b AS (SELECT benchmark, {_drawn(3)} FROM ({resample_sql('pairs', 'benchmark', VALUES)}) WHERE w > 0), mo AS ({moments_sql('pairs', 'benchmark', VALUES)}), c AS (SELECT benchmark, count(*) AS n FROM pairs GROUP BY 1)
    SELECT benchmark, {n('n', 'n')}, {_ends(VALUES)} FROM ({ends_sql('b', 'mo', 'benchmark', 3)}) JOIN c USING (benchmark)""",
    ("scored_choice",),
)
def paired_bootstrap(spark, sf):
    """Paired cluster bootstrap intervals of three score differences per benchmark."""
    return B.bootstrap_intervals(pairs(spark, sf), ["benchmark"], CLUSTER, VALUES, RESAMPLES)


_SCORES = ("correct", "nll", "brier")


@query(
    "macro_intervals",
    f"""WITH src AS (SELECT system, benchmark, question_id, correct::INTEGER AS correct, nll, brier FROM scored_choice), b AS ({resample_sql('src', 'system, benchmark', _SCORES)}),
    m AS (SELECT system, r, avg(s0 / w) AS m0, avg(s1 / w) AS m1, avg(s2 / w) AS m2 FROM b WHERE w > 0 GROUP BY 1, 2),
    mo AS ({moments_sql('src', 'system, benchmark', _SCORES)}), ma AS ({macro_moments_sql('mo', 'system', 3)}), p AS (SELECT system, count(*) AS n_benchmarks FROM mo GROUP BY 1)
    SELECT system, {n('n_benchmarks', 'n_benchmarks')}, {_ends(_SCORES)} FROM ({ends_sql('m', 'ma', 'system', 3)}) JOIN p USING (system)""",
    ("scored_choice",),
)
def macro_intervals(spark, sf):
    """Macro averages with stratified bootstrap intervals."""
    return B.macro_intervals(scored(spark, sf), ["system"], CLUSTER, ["correct", "nll", "brier"], RESAMPLES)


@query(
    "subset_combined",
    f"""WITH b AS ({resample_sql('scored_choice', 'system, benchmark', ('nll',))}), m AS (SELECT system, r, avg(s0 / w) AS m0 FROM b WHERE benchmark IN ('b0', 'b2') GROUP BY 1, 2)
    SELECT system, {r('quantile_cont(m0, 0.025)', 'low_nll')}, {r('quantile_cont(m0, 0.975)', 'high_nll')} FROM m GROUP BY 1""",
    ("scored_choice",),
)
def subset_combined(spark, sf):
    """Replicates of two benchmarks combined."""
    means = B.replicate_means(B.bootstrap_sums(scored(spark, sf), ["system", "benchmark"], CLUSTER, ["nll"], RESAMPLES), ["nll"])
    macro = B.macro_replicates(means.where(F.col("benchmark").isin("b0", "b2")), ["system"], ["nll"])
    return B.percentile_intervals(macro, ["system"], ["nll"])


@query(
    "replicate_deltas",
    f"""WITH b AS ({resample_sql('scored_choice', 'system, benchmark', ('correct', 'nll'))}), d AS (
      SELECT x.benchmark, x.s0 / x.w - y.s0 / y.w AS d0, x.s1 / x.w - y.s1 / y.w AS d1 FROM b x JOIN b y ON x.benchmark = y.benchmark AND x.r = y.r AND x.system = 'b' AND y.system = 'a')
    SELECT benchmark, {r('quantile_cont(d0, 0.025)', 'low_correct')}, {r('quantile_cont(d0, 0.975)', 'high_correct')}, {r('quantile_cont(d1, 0.025)', 'low_nll')}, {r('quantile_cont(d1, 0.975)', 'high_nll')},
      quantile_cont(d1, 0.025) > 0 OR quantile_cont(d1, 0.975) < 0 AS excludes_zero FROM d GROUP BY 1""",
    ("scored_choice",),
)
def replicate_deltas(spark, sf):
    """Deltas between two series on shared resamples."""
    means = B.replicate_means(B.bootstrap_sums(scored(spark, sf), ["system", "benchmark"], CLUSTER, ["correct", "nll"], RESAMPLES), ["correct", "nll"])
    deltas = B.replicate_deltas(means, ["benchmark"], "system", "a", ["correct", "nll"])
    out = B.percentile_intervals(deltas, ["benchmark"], ["correct", "nll"])
    return out.withColumn("excludes_zero", B.excludes_zero(F.col("low_nll"), F.col("high_nll")))


@query(
    "jackknife_acceleration",
    f"""WITH c AS (SELECT system, benchmark, question_id, sum(correct::INTEGER)::DOUBLE AS s, count(*) AS n FROM scored_choice GROUP BY 1, 2, 3),
    t AS (SELECT system, benchmark, sum(s) AS S_, sum(n) AS N_, count(*) AS k FROM c GROUP BY 1, 2),
    j AS (SELECT c.system, c.benchmark, k, S_ / N_ AS est, (S_ - s) / (N_ - n) AS v FROM c JOIN t ON c.system = t.system AND c.benchmark = t.benchmark),
    m AS (SELECT system, benchmark, k, est, v, avg(v) OVER (PARTITION BY system, benchmark) AS mv FROM j)
    SELECT system, benchmark, {n('any_value(k)', 'n_clusters')}, {r('any_value(est)', 'estimate')}, {r('sum(power(mv - v, 3)) / (6 * power(sum(power(mv - v, 2)), 1.5))', 'acceleration')} FROM m GROUP BY 1, 2""",
    ("scored_choice",),
)
def jackknife_acceleration(spark, sf):
    return B.jackknife_moments(scored(spark, sf), ["system", "benchmark"], CLUSTER, "correct").select(
        "system", "benchmark", "n_clusters", "estimate", "acceleration"
    )


@query(
    "bca_intervals",
    f"""WITH src AS (SELECT system, benchmark, question_id, (probs[1 + gold_idx] >= 0.5 AND (gold_idx = 0 OR probs[1] < 0.5))::INTEGER AS correct FROM noul_preds),
    b AS (SELECT system, benchmark, s0 / w AS m0 FROM ({resample_sql('src', 'system, benchmark', ('correct',))}) WHERE w > 0), mo AS ({moments_sql('src', 'system, benchmark', ('correct',))})
    SELECT system, benchmark, {r('x.e0', 'estimate')}, {r('l0', 'low')}, {r('h0', 'high')}, {n('k', 'n_clusters')}, CASE WHEN k >= {B.BCA_MIN_CLUSTERS} THEN 'bca' ELSE 'percentile' END AS method,
      {r('CASE WHEN q0 > 0 THEN c0 / (6 * power(q0, 1.5)) ELSE 0 END', 'acceleration')} FROM ({ends_sql('b', 'mo', 'system, benchmark', 1)}) x JOIN mo USING (system, benchmark)""",
    ("noul_preds",),
)
def bca_intervals(spark, sf):
    """Bias-corrected accelerated intervals of the accuracy, clustered by order."""
    rows = with_scores(D.noul_preds(spark, sf))
    return B.bca_intervals(rows, ["system", "benchmark"], CLUSTER, "correct", RESAMPLES)


_LNFACT = "lgamma(x + 1)"


@query(
    "mcnemar_test",
    f"""WITH {_PAIRS}, c AS (SELECT benchmark, count(*) FILTER (WHERE correct_a AND NOT correct_b) AS oa, count(*) FILTER (WHERE correct_b AND NOT correct_a) AS ob FROM pairs GROUP BY 1)
    SELECT benchmark, {n('oa', 'only_a')}, {n('ob', 'only_b')}, {r("CASE WHEN oa + ob = 0 THEN 1 ELSE least(1, 2 * list_sum(list_transform(range(0, least(oa, ob) + 1), lambda i: exp(lgamma(oa + ob + 1) - lgamma(i + 1) - lgamma(oa + ob - i + 1) - (oa + ob) * ln(2.0))))) END", 'p_value')} FROM c""",
    ("scored_choice",),
)
def mcnemar_test(spark, sf):
    return B.mcnemar(pairs(spark, sf), ["benchmark"], "correct_a", "correct_b")


@query(
    "group_influence",
    f"""WITH {_PAIRS}, b AS (SELECT benchmark, avg(d_accuracy) AS d, count(*) AS n FROM pairs GROUP BY 1), m AS (SELECT avg(d) AS macro, avg(d) FILTER (WHERE benchmark <> 'b0') AS without_group,
      sum(d) FILTER (WHERE benchmark = 'b0') / count(*) AS part, sum(d * n) / sum(n) AS item_weighted FROM b)
    SELECT {r('macro', 'macro')}, {r('without_group', 'without_group')}, {r('part / nullif(macro, 0)', 'share')}, {r('item_weighted', 'item_weighted')} FROM m""",
    ("scored_choice",),
)
def group_influence(spark, sf):
    """How much of a macro difference rests on one benchmark: its share, the macro without it, and
    the difference with every item weighing the same."""
    per = pairs(spark, sf).groupBy("benchmark").agg(F.avg("d_accuracy").alias("d"), F.count(F.lit(1)).alias("n"))
    mine = F.col("benchmark") == "b0"
    return per.agg(
        F.avg("d").alias("macro"), F.avg(F.when(~mine, F.col("d"))).alias("without_group"),
        F.try_divide(F.sum(F.when(mine, F.col("d"))) / F.count(F.lit(1)), F.avg("d")).alias("share"),
        (F.sum(F.col("d") * F.col("n")) / F.sum("n")).alias("item_weighted"),
    )


@query("ece_replicates", f"WITH src AS (SELECT system, benchmark, question_id, item_id, confidence, correct::INTEGER AS accuracy FROM scored_choice) SELECT system, benchmark, {n('r', 'r')}, {r('ece', 'ece')} FROM ({ece_replicates_sql('src', 'system, benchmark')})", ("scored_choice",))
def ece_replicates(spark, sf):
    """Calibration error of every resample, on the same resamples as the other metrics."""
    return B.ece_replicates(scored(spark, sf), ["system", "benchmark"], CLUSTER, RESAMPLES)
