"""Whole analyses as queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbline.operators import records as R
from plumbline.plans import study as P
from plumbline.queries import derived as D
from plumbline.queries.calibration_area import cal_items
from plumbline.queries.costs_area import prices
from plumbline.queries.inference import RESAMPLES, _ends, ece_replicates_sql, ends_sql, macro_moments_sql, moments_sql, resample_sql
from plumbline.queries.registry import n, query, r
from plumbline.queries.summaries import ece_sql



_TAIL = "least(1, 2 * list_sum(list_transform(range(0, least(oa, ob) + 1), lambda i: exp(lgamma(oa + ob + 1) - lgamma(i + 1) - lgamma(oa + ob - i + 1) - (oa + ob) * ln(2.0)))))"
_DELTAS = ("d_accuracy", "d_nll", "d_brier")
_PER = f"""per AS (SELECT benchmark, e0, l0, h0, e1, l1, h1, e2, l2, h2 FROM ({ends_sql('bs', 'mo', 'benchmark', 3)}))"""


@query(
    "system_comparison",
    f"""WITH pr AS (SELECT a.benchmark, a.item_id AS question_id, a.correct::INTEGER - b.correct::INTEGER AS d_accuracy, a.nll - b.nll AS d_nll, a.brier - b.brier AS d_brier, a.correct AS ca, b.correct AS cb
      FROM scored_choice a JOIN scored_choice b ON a.item_id = b.item_id AND a.system = 'a' AND b.system = 'b'),
    rs AS ({resample_sql('pr', 'benchmark', _DELTAS)}), bs AS (SELECT benchmark, r, s0 / w AS m0, s1 / w AS m1, s2 / w AS m2 FROM rs WHERE w > 0), mo AS ({moments_sql('pr', 'benchmark', _DELTAS)}), {_PER},
    mr AS (SELECT r, avg(m0) AS m0, avg(m1) AS m1, avg(m2) AS m2 FROM bs GROUP BY 1), ma AS ({macro_moments_sql('mo', '', 3)}), mac AS (SELECT 'macro' AS benchmark, * FROM ({ends_sql('mr', 'ma', '', 3)})),
    pt AS (SELECT benchmark, count(*) AS n, avg(ca::INTEGER) AS pa, avg(cb::INTEGER) AS pb, count(*) FILTER (WHERE ca AND NOT cb) AS oa, count(*) FILTER (WHERE cb AND NOT ca) AS ob FROM pr GROUP BY 1),
    pts AS (SELECT *, CASE WHEN oa + ob = 0 THEN 1 ELSE {_TAIL} END AS p FROM pt UNION ALL SELECT 'macro', sum(n), avg(pa), avg(pb), NULL, NULL, NULL FROM pt)
    SELECT benchmark, {n('n', 'n')}, {r('pa', 'accuracy_a')}, {r('pb', 'accuracy_b')}, {_ends(_DELTAS)}, {n('oa', 'only_a')}, {n('ob', 'only_b')}, {r('p', 'p_value')} FROM (SELECT * FROM per UNION ALL SELECT * FROM mac) JOIN pts USING (benchmark)""",
    ("scored_choice",),
)
def system_comparison(spark, sf):
    """Two systems on shared items, per benchmark and macro: differences with BCa intervals (from 500
    items), and McNemar's test."""
    out = P.compare(D.preds(spark, sf), "a", "b", RESAMPLES)
    ends = [f"{e}{v}" for v in _DELTAS for e in ("", "low_", "high_")]
    return out.select("benchmark", "n", "accuracy_a", "accuracy_b", *ends, "only_a", "only_b", "p_value")


_VALUES = ("accuracy", "nll", "brier")


@query(
    "answer_summary_with_intervals",
    f"""WITH src AS (SELECT system, benchmark, item_id AS question_id, correct::INTEGER AS accuracy, nll, brier, abstained, idk_idx, p_gold, abs_error, within_one FROM scored),
    rs AS (SELECT system, benchmark, r, s0 / w AS m0, s1 / w AS m1, s2 / w AS m2 FROM ({resample_sql('src', 'system, benchmark', _VALUES)}) WHERE w > 0), mo AS ({moments_sql('src', 'system, benchmark', _VALUES)}),
    per AS (SELECT * FROM ({ends_sql('rs', 'mo', 'system, benchmark', 3)})), mr AS (SELECT system, r, avg(m0) AS m0, avg(m1) AS m1, avg(m2) AS m2 FROM rs GROUP BY 1, 2), ma AS ({macro_moments_sql('mo', 'system', 3)}),
    mac AS (SELECT * FROM ({ends_sql('mr', 'ma', 'system', 3)})),
    pt AS (SELECT system, benchmark, count(*) AS n, CASE WHEN max(idk_idx) IS NOT NULL THEN avg(abstained::INTEGER) END AS idk_rate, avg(p_gold) AS mean_p_gold, avg(abs_error) AS mae, avg(within_one::INTEGER) AS within_one FROM src GROUP BY 1, 2),
    ec AS ({ece_sql('scored')})
    SELECT system, benchmark, {n('n', 'n')}, {r('e0', 'accuracy')}, {r('l0', 'accuracy_low')}, {r('h0', 'accuracy_high')}, {r('e1', 'nll')}, {r('e2', 'brier')}, {', '.join(r(c, c) for c in ('idk_rate', 'mean_p_gold', 'mae', 'within_one', 'ece'))}
    FROM per JOIN pt USING (system, benchmark) JOIN ec USING (system, benchmark)
    UNION ALL BY NAME SELECT system, 'macro' AS benchmark, {n('k', 'n')}, {r('e0', 'accuracy')}, {r('l0', 'accuracy_low')}, {r('h0', 'accuracy_high')}, {r('e1', 'nll')}, {r('e2', 'brier')} FROM mac JOIN (SELECT system, sum(n) AS k FROM pt GROUP BY 1) USING (system)""",
    ("scored",),
)
def answer_summary_with_intervals(spark, sf):
    """Run summary with accuracy intervals and the macro row."""
    out = P.summarize(D.all_preds(spark, sf), n_resamples=RESAMPLES)
    return out.select("system", "benchmark", "n", "accuracy", "accuracy_low", "accuracy_high", "nll", "brier", "idk_rate", "mean_p_gold", "mae", "within_one", "ece")


@query(
    "run_statistics",
    f"""WITH l AS (SELECT system_id, benchmark, item_id, arg_max(ok, (ok::INTEGER, line_no)) AS ok, arg_max(latency_ms, (ok::INTEGER, line_no)) AS latency_ms, arg_max(struct_pack(t := input_tokens), (ok::INTEGER, line_no)) AS u FROM records GROUP BY 1, 2, 3)
    SELECT system_id, benchmark, {n('count(*)', 'n_items')}, {n('count(*) FILTER (WHERE ok)', 'n_ok')}, {n('sum(u.t)', 'input_tokens')}, {r('quantile_cont(latency_ms, 0.5) FILTER (WHERE ok)', 'latency_p50_ms')}, {r('quantile_cont(latency_ms, 0.95) FILTER (WHERE ok)', 'latency_p95_ms')}
    FROM l GROUP BY GROUPING SETS ((system_id, benchmark), (system_id))""",
    ("records",),
)
def run_statistics(spark, sf):
    """Usage, latency and cost statistics per benchmark and pooled."""
    latest = R.latest_records(D.records(spark, sf)).withColumns(
        {
            "price_id": F.lit("en"), "cache_write_tokens": F.lit(0).cast("bigint"),
            "correct": F.col("ok") & (F.col("latency_ms") < 60),
        }
    )
    calls = D.invocations(spark, sf).withColumn("benchmark", F.concat(F.lit("b"), (F.dayofmonth("started") % 4).cast("string")))
    calls = calls.withColumn("system_id", F.concat(F.lit("s"), (F.length("system_id") % 3).cast("string")))
    stats = P.run_statistics(latest, prices(spark), calls)
    return stats.select("system_id", "benchmark", "n_items", "n_ok", "input_tokens", "latency_p50_ms", "latency_p95_ms")


def study_items(spark, sf):
    return cal_items(spark, sf).drop("fold")


@query("calibration_study")
def calibration_study(spark, sf):
    """Estimates of the cross-fitted study: raw and every default arm."""
    return P.calibration_study(study_items(spark, sf), reference="a", n_resamples=RESAMPLES).estimates


@query("calibration_study_deltas")
def calibration_study_deltas(spark, sf):
    """Differences of the study's arms to the raw answers and to the reference system."""
    return P.calibration_study(study_items(spark, sf), reference="a", n_resamples=RESAMPLES).deltas


_M = ("accuracy", "nll", "brier")
_SERIES = "system, arm, benchmark"
_ARMS = f"""base AS (SELECT system, benchmark, item_id, question_id, gold_idx, probs FROM metrics), cut AS (SELECT *, list_transform(probs, lambda x: greatest(1e-4, least(1.0, x))) AS q FROM base),
arms AS (SELECT system, benchmark, item_id, question_id, gold_idx, probs, 'raw' AS arm FROM base UNION ALL
  SELECT system, benchmark, item_id, question_id, gold_idx, list_transform(q, lambda x: x / list_reduce(q, lambda a, y: a + y)) AS probs, 'identity@global' AS arm FROM cut),
src AS (SELECT system, arm, benchmark, question_id, item_id, correct::INTEGER AS accuracy, nll, brier, confidence FROM ({D.item_metrics_sql('arms')})),
pe AS (SELECT {_SERIES}, sum(abs(h - c)) / sum(k) AS ece FROM (SELECT {_SERIES}, bin, sum(confidence) AS c, sum(accuracy) AS h, count(*) AS k FROM (
  SELECT *, ntile(10) OVER (PARTITION BY {_SERIES} ORDER BY confidence, ('0x' || substr(sha256(item_id), 1, 15))::BIGINT) AS bin FROM src) GROUP BY ALL) GROUP BY ALL),
pts AS (SELECT {_SERIES}, count(*) AS n, avg(accuracy) AS accuracy, avg(nll) AS nll, avg(brier) AS brier, any_value(ece) AS ece FROM src JOIN pe USING ({_SERIES}) GROUP BY ALL),
points AS (SELECT * FROM pts UNION ALL SELECT system, arm, 'macro', sum(n), avg(accuracy), avg(nll), avg(brier), avg(ece) FROM pts GROUP BY 1, 2),
er AS ({ece_replicates_sql('src', _SERIES)}),
rs AS (SELECT {_SERIES}, r, s0 / w AS m0, s1 / w AS m1, s2 / w AS m2, ece AS m3 FROM ({resample_sql('src', _SERIES, _M)}) JOIN er USING ({_SERIES}, r) WHERE w > 0),
reps AS (SELECT * FROM rs UNION ALL SELECT system, arm, 'macro', r, avg(m0), avg(m1), avg(m2), avg(m3) FROM rs GROUP BY 1, 2, 4)"""
_ECE_ENDS = f"{r('quantile_cont(m3, 0.025)', 'low_ece')}, {r('quantile_cont(m3, 0.975)', 'high_ece')}"


def _study_ends(moments: str, replicates: str) -> str:
    return f"""mo AS (SELECT * FROM {moments} UNION ALL BY NAME SELECT *, 'macro' AS benchmark FROM ({macro_moments_sql(moments, 'system, arm', 3)})), en AS ({ends_sql(replicates, 'mo', _SERIES, 3)}), ee AS (SELECT {_SERIES}, {_ECE_ENDS} FROM {replicates} GROUP BY ALL)"""


_LOWS = ", ".join(r(f"l{i}", f"low_{m}") + ", " + r(f"h{i}", f"high_{m}") for i, m in enumerate(_M))
_ENDS_OUT = [*_M, "ece", *[f"{e}_{m}" for m in (*_M, "ece") for e in ("low", "high")]]


@query(
    "study_estimates",
    f"""WITH {_ARMS}, ms AS ({moments_sql('src', _SERIES, _M)}), {_study_ends('ms', 'reps')}
    SELECT {_SERIES}, {n('n', 'n')}, {', '.join(r(m, m) for m in (*_M, 'ece'))}, {_LOWS}, low_ece, high_ece, {n('k', 'n_clusters')} FROM points JOIN en USING ({_SERIES}) JOIN ee USING ({_SERIES}) JOIN (SELECT {_SERIES}, k FROM mo) USING ({_SERIES})""",
    ("metrics",),
)
def study_estimates(spark, sf):
    """Estimates and interval ends of the study's raw and identity arms, calibration errors and macro
    rows included."""
    study = P.calibration_study(study_items(spark, sf), ["identity@global"], reference="a", n_resamples=RESAMPLES)
    return study.estimates.select("system", "arm", "benchmark", "n", *_ENDS_OUT, "n_clusters")


@query(
    "study_deltas",
    f"""WITH {_ARMS}, ds AS (SELECT x.system, x.arm, x.benchmark, x.question_id, x.accuracy - y.accuracy AS accuracy, x.nll - y.nll AS nll, x.brier - y.brier AS brier FROM src x JOIN src y ON x.item_id = y.item_id AND x.benchmark = y.benchmark AND x.arm = y.arm AND x.system = 'b' AND y.system = 'a'),
    ms AS ({moments_sql('ds', _SERIES, _M)}), dr AS (SELECT x.system, x.arm, x.benchmark, x.m0 - y.m0 AS m0, x.m1 - y.m1 AS m1, x.m2 - y.m2 AS m2, x.m3 - y.m3 AS m3 FROM reps x JOIN reps y ON x.benchmark = y.benchmark AND x.arm = y.arm AND x.r = y.r AND x.system = 'b' AND y.system = 'a'), {_study_ends('ms', 'dr')},
    dp AS (SELECT x.system, x.arm, x.benchmark, x.accuracy - y.accuracy AS d_accuracy, x.nll - y.nll AS d_nll, x.brier - y.brier AS d_brier, x.ece - y.ece AS d_ece FROM points x JOIN points y ON x.benchmark = y.benchmark AND x.arm = y.arm AND x.system = 'b' AND y.system = 'a')
    SELECT {_SERIES}, {', '.join(r(f'd_{m}', f'd_{m}') for m in (*_M, 'ece'))}, {_LOWS}, low_ece, high_ece, l1 > 0 OR h1 < 0 AS nll_excludes_zero FROM dp JOIN en USING ({_SERIES}) JOIN ee USING ({_SERIES})""",
    ("metrics",),
)
def study_deltas(spark, sf):
    """Each arm of system b less that of system a, on shared resamples."""
    study = P.calibration_study(study_items(spark, sf), ["identity@global"], reference="a", n_resamples=RESAMPLES)
    rows = study.deltas.where("against = 'reference'")
    return rows.select("system", "arm", "benchmark", *[f"d_{m}" for m in (*_M, "ece")], *[c for c in _ENDS_OUT if c.startswith(("low", "high"))], "nll_excludes_zero")


@query(
    "view_summary",
    f"""SELECT system, {n('sum(n)', 'n')}, {r('avg(accuracy)', 'accuracy')}, {r('avg(nll)', 'nll')} FROM (SELECT system, benchmark, count(*) AS n, avg(correct::INTEGER) AS accuracy, avg(nll) AS nll FROM metrics WHERE benchmark IN ('b0', 'b1') GROUP BY 1, 2) GROUP BY 1""",
    ("metrics",),
)
def view_summary(spark, sf):
    """Raw macro quality of the study's systems over two of its benchmarks."""
    study = P.calibration_study(study_items(spark, sf), ["identity@global"], n_resamples=RESAMPLES)
    return P.view_summary(study, ["b0", "b1"]).where("arm = 'raw'").select("system", "n", "accuracy", "nll")
