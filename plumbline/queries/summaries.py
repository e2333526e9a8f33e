"""Benchmark summaries, calibration error and report aggregates."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbline.functions import vectors as V
from plumbline.functions.hashing import hash_int, keyed_hash
from plumbline.functions.scores import with_item_metrics, with_scores
from plumbline.operators import alignment as A
from plumbline.operators import summaries as S
from plumbline.operators.confidence_fit import evaluate_confidence
from plumbline.queries import derived as D
from plumbline.queries.registry import n, query, r
from plumbline.queries.scoring import normalised

TIE = "('0x' || substr(sha256(item_id), 1, 15))::BIGINT"


def bins_sql(source: str, groups: str = "system, benchmark", bins: int = 10, conf: str = "confidence", hit: str = "correct::INTEGER") -> str:
    return f"""SELECT {groups}, bin - 1 AS bin, count(*) AS n, min(c) AS lo, max(c) AS hi, avg(c) AS conf, avg(h) AS acc
      FROM (SELECT {groups}, {conf} AS c, {hit} AS h,
                   ntile({bins}) OVER (PARTITION BY {groups} ORDER BY {conf}, {TIE}) AS bin FROM {source}) GROUP BY {groups}, bin"""


def ece_sql(source: str, groups: str = "system, benchmark", **kw) -> str:
    return f"SELECT {groups}, sum(n * abs(acc - conf)) / sum(n) AS ece FROM ({bins_sql(source, groups, **kw)}) GROUP BY {groups}"


def scored(spark, sf):
    return with_scores(D.all_preds(spark, sf))


def metrics(spark, sf):
    return with_item_metrics(normalised(spark, sf))


@query(
    "benchmark_summary",
    f"""WITH per AS (
      SELECT system, benchmark, count(*) AS n, avg(correct::INTEGER) AS accuracy,
        CASE WHEN max(idk_idx) IS NOT NULL THEN avg(abstained::INTEGER) END AS idk_rate, avg(p_gold) AS mean_p_gold,
        avg(nll) AS nll, avg(brier) AS brier, avg(abs_error) AS mae, avg(within_one::INTEGER) AS within_one FROM scored GROUP BY 1, 2),
    both_ AS (SELECT * FROM per JOIN ({ece_sql('scored')}) USING (system, benchmark))
    SELECT system, benchmark, {n('n', 'n')}, {', '.join(r(c, c) for c in ('accuracy', 'idk_rate', 'mean_p_gold', 'nll', 'brier', 'mae', 'within_one', 'ece'))} FROM both_
    UNION ALL BY NAME
    SELECT system, 'macro' AS benchmark, {n('sum(n)', 'n')}, {', '.join(r(f'avg({c})', c) for c in ('accuracy', 'nll', 'brier', 'ece'))} FROM both_ GROUP BY 1""",
    ("scored",),
)
def benchmark_summary(spark, sf):
    """Per-benchmark summary and the macro row of every system."""
    per = S.benchmark_summary(scored(spark, sf))
    macro = per.groupBy("system").agg(
        F.lit("macro").alias("benchmark"), F.sum("n").alias("n"),
        *[F.avg(c).alias(c) for c in ("accuracy", "nll", "brier", "ece")],
    )
    return per.unionByName(macro, allowMissingColumns=True)


@query(
    "accuracy_by_benchmark",
    f"SELECT system, benchmark, {r('avg(correct::INTEGER)', 'accuracy')} FROM scored GROUP BY 1, 2", ("scored",),
)
def accuracy_by_benchmark(spark, sf):
    return scored(spark, sf).groupBy("system", "benchmark").agg(F.avg(S.as_double("correct")).alias("accuracy"))


@query(
    "ece_equal_mass",
    f"SELECT system, benchmark, {r('ece', 'ece')} FROM ({ece_sql('scored')})", ("scored",),
)
def ece_equal_mass(spark, sf):
    return S.ece_equal_mass(scored(spark, sf), ["system", "benchmark"])


_WIDTH = "least(floor(greatest(0, least(1, confidence)) * {b}), {b} - 1)"


@query(
    "ece_equal_width",
    f"""SELECT system, benchmark, {r('sum(n * abs(a - c)) / sum(n)', 'ece')} FROM (
      SELECT system, benchmark, {_WIDTH.format(b=10)} AS bin, count(*) AS n, avg(correct::INTEGER) AS a, avg(confidence) AS c FROM scored GROUP BY 1, 2, 3) GROUP BY 1, 2""",
    ("scored",),
)
def ece_equal_width(spark, sf):
    return S.ece_equal_width(scored(spark, sf), ["system", "benchmark"])


@query(
    "reliability_bins",
    f"""SELECT system, benchmark, bin::BIGINT AS bin, {n('n', 'n')}, {r('lo', 'confidence_low')}, {r('hi', 'confidence_high')},
      {r('conf', 'mean_confidence')}, {r('acc', 'accuracy')} FROM ({bins_sql('scored')})""",
    ("scored",),
)
def reliability_bins(spark, sf):
    return S.reliability(scored(spark, sf), ["system", "benchmark"])


@query(
    "reliability_equal_width",
    f"""SELECT system, bin::BIGINT AS bin, {n('n', 'n')}, {r('c', 'mean_confidence')}, {r('a', 'accuracy')}, {r('bin / 20', 'low')}, {r('(bin + 1) / 20', 'high')} FROM (
      SELECT system, {_WIDTH.format(b=20)} AS bin, count(*) AS n, avg(correct::INTEGER) AS a, avg(confidence) AS c FROM scored GROUP BY 1, 2) WHERE n >= 10""",
    ("scored",),
)
def reliability_equal_width(spark, sf):
    return S.reliability_equal_width(scored(spark, sf), ["system"], bins=20, min_items=10)


@query(
    "weighted_ece",
    f"""WITH w AS (SELECT *, ('0x' || substr(sha256('w' || chr(31) || item_id), 1, 15))::BIGINT % 4 AS weight FROM scored_choice),
    expanded AS (SELECT system, benchmark, item_id, confidence, correct, unnest(range(0, weight)) AS copy FROM w)
    SELECT system, benchmark, {r('sum(n * abs(acc - conf)) / sum(n)', 'ece')} FROM (
      SELECT system, benchmark, bin, count(*) AS n, avg(confidence) AS conf, avg(correct::INTEGER) AS acc FROM (
        SELECT *, ntile(10) OVER (PARTITION BY system, benchmark ORDER BY confidence, {TIE}, copy) AS bin FROM expanded) GROUP BY 1, 2, 3) GROUP BY 1, 2""",
    ("scored_choice",),
)
def weighted_ece(spark, sf):
    """Calibration error of the sample holding each item 0 to 3 times."""
    rows = with_scores(D.preds(spark, sf)).withColumn("weight", hash_int(keyed_hash("w", F.col("item_id"))) % 4)
    return S.weighted_ece(rows, ["system", "benchmark"], "weight")


@query(
    "macro_average",
    f"""SELECT system, {n('count(*)', 'n_benchmarks')}, {r('avg(accuracy)', 'accuracy')}, {r('avg(nll)', 'nll')}, {r('avg(brier)', 'brier')} FROM (
      SELECT system, benchmark, avg(correct::INTEGER) AS accuracy, avg(nll) AS nll, avg(brier) AS brier FROM scored GROUP BY 1, 2) GROUP BY 1""",
    ("scored",),
)
def macro_average(spark, sf):
    per = S.score_summary(scored(spark, sf), ["system", "benchmark"])
    return S.macro_average(per, ["system"], ["accuracy", "nll", "brier"])


@query(
    "latency_percentiles",
    f"""SELECT system_id, {r('quantile_cont(latency_ms, 0.5)', 'latency_p50_ms')}, {r('quantile_cont(latency_ms, 0.95)', 'latency_p95_ms')}
    FROM records WHERE ok GROUP BY 1""",
    ("records",),
)
def latency_percentiles(spark, sf):
    return S.latency_percentiles(D.records(spark, sf).where("ok"), ["system_id"])


@query(
    "absolute_metrics",
    f"""WITH base AS (SELECT system, count(*) AS n, avg(correct::INTEGER) AS accuracy, avg(correct::INTEGER) FILTER (WHERE NOT abstained) AS answered_accuracy,
      avg(abstained::INTEGER) AS idk_rate, avg(p_gold) AS p_gold, avg(nll) AS nll, avg(brier) AS brier, avg(confidence) AS mean_confidence FROM scored_choice GROUP BY 1),
    width AS (SELECT system, sum(n * abs(a - c)) / sum(n) AS ece_width FROM (
      SELECT system, {_WIDTH.format(b=10)} AS bin, count(*) AS n, avg(correct::INTEGER) AS a, avg(confidence) AS c FROM scored_choice GROUP BY 1, 2) GROUP BY 1)
    SELECT system, {n('n', 'n')}, {', '.join(r(c, c) for c in ('accuracy', 'answered_accuracy', 'idk_rate', 'p_gold', 'nll', 'brier', 'mean_confidence', 'ece_width'))}, {r('ece', 'ece_mass')}
    FROM base JOIN width USING (system) JOIN ({ece_sql('scored_choice', 'system')}) USING (system)""",
    ("scored_choice",),
)
def absolute_metrics(spark, sf):
    return S.absolute_metrics(with_scores(D.preds(spark, sf)), ["system"])


@query(
    "confidence_shares",
    f"""SELECT system, bin::BIGINT AS bin, {n('n', 'n')}, {r('n / sum(n) OVER (PARTITION BY system)', 'share')},
      {r('sum(c) OVER (PARTITION BY system) / sum(n) OVER (PARTITION BY system)', 'mean_confidence')} FROM (
      SELECT system, {_WIDTH.format(b=20)} AS bin, count(*) AS n, sum(confidence) AS c FROM scored GROUP BY 1, 2)""",
    ("scored",),
)
def confidence_shares(spark, sf):
    return S.confidence_shares(scored(spark, sf), ["system"], bins=20)


@query(
    "pooled_ece",
    f"SELECT system, {r('ece', 'ece')} FROM ({ece_sql('scored', 'system')})", ("scored",),
)
def pooled_ece(spark, sf):
    """Calibration error over all benchmarks together."""
    return S.ece_equal_mass(scored(spark, sf), ["system"])


@query(
    "rounding_floor_check",
    f"""SELECT system, {n('sum(n)', 'n')}, {n('sum(z)', 'n_gold_zero')}, {r('avg(nll)', 'macro_nll')}, {r('avg(f)', 'macro_nll_floored')} FROM (
      SELECT system, benchmark, count(*) AS n, count(*) FILTER (WHERE p_gold <= 1e-6) AS z, avg(nll) AS nll, avg(least(nll, -ln(0.005))) AS f FROM scored GROUP BY 1, 2) GROUP BY 1""",
    ("scored",),
)
def rounding_floor_check(spark, sf):
    return S.rounding_floor_check(scored(spark, sf), ["system"])


@query(
    "as_returned_metrics",
    f"""WITH src AS (SELECT *, least(1.0, {"list_max(probs)"} * 1.1) AS reported FROM preds),
    m AS (SELECT *, list_position(probs, list_max(probs)) - 1 = gold_idx AS correct, list_max(probs) AS confidence, coalesce(probs[gold_idx + 1], 0) AS p_gold FROM src),
    s AS (SELECT system, avg(-ln(least(1.0, greatest(p_gold, 1e-6)))) AS nll,
            avg(list_reduce(list_transform(probs, lambda x: x * x), lambda a, y: a + y) - 2 * p_gold + 1) AS brier, count(reported) AS n_confidence FROM m GROUP BY 1)
    SELECT s.system, {r('nll', 'nll')}, {r('brier', 'brier')}, {n('n_confidence', 'n_confidence')}, {r('e.ece', 'ece')}, {r('c.ece', 'ece_confidence')} FROM s
    JOIN ({ece_sql('m', 'system')}) e ON e.system = s.system
    JOIN ({ece_sql('m', 'system', conf='reported', hit='(choice_idx = gold_idx)::INTEGER')}) c ON c.system = s.system""",
    ("preds",),
)
def as_returned_metrics(spark, sf):
    """Unnormalised answers and the calibration of their reported confidence."""
    rows = with_item_metrics(D.preds(spark, sf)).withColumn(
        "reported_confidence", F.least(F.lit(1.0), F.array_max("probs") * 1.1)
    )
    return S.as_returned(rows, ["system"])


@query(
    "paired_distribution_summary",
    f"""WITH p AS (SELECT a.benchmark, a.probs AS pa, b.probs AS pb, a.gold_idx AS g FROM metrics a JOIN metrics b
          ON a.item_id = b.item_id AND a.system = 'a' AND b.system = 'b'),
    d AS (SELECT benchmark,
        greatest(0, list_reduce(list_transform(pa, lambda x, i: (x + 1e-12) / (1 + 10 * 1e-12) * (ln((x + 1e-12) / (1 + 10 * 1e-12)) - ln((pb[i] + 1e-12) / (1 + 10 * 1e-12)))), lambda s, y: s + y)) AS kl,
        0.5 * list_reduce(list_transform(pa, lambda x, i: abs(x - pb[i])), lambda s, y: s + y) AS tv,
        (list_position(pa, list_max(pa)) = list_position(pb, list_max(pb)))::INTEGER AS agree, abs(pb[g + 1] - pa[g + 1]) AS dp FROM p),
    e AS (SELECT *, [x[1] > 0.02 FOR x IN list_zip(pa, pb)] AS ha, [x[2] > 0.05 FOR x IN list_zip(pa, pb)] AS hb, [i % 10 = 3 FOR i IN range(0, 10)] AS cut FROM p),
    u AS (SELECT benchmark, unnest(pa) AS x, unnest(pb) AS y, unnest(ha) AS ia, unnest(hb) AS ib, unnest(cut) AS inf_b FROM e),
    w AS (SELECT benchmark, {r('avg(abs(ln(y) - ln(x))) FILTER (WHERE ia AND ib AND NOT inf_b)', 'raw_mae')}, {n('count(*) FILTER (WHERE ia AND ib AND NOT inf_b)', 'n_finite')}, {n('count(*) FILTER (WHERE ia <> ib)', 'n_one_sided')},
      {n('count(*) FILTER (WHERE ia AND ib AND inf_b)', 'n_infinite')}, {n('count(*) FILTER (WHERE ia <> ib OR (ia AND ib AND inf_b))', 'n_nonfinite')} FROM u GROUP BY 1),
    ms AS (SELECT benchmark, list_reduce(list_concat([0.0::DOUBLE], list_transform(pb, lambda y, i: CASE WHEN hb[i] AND NOT cut[i] THEN y ELSE 0 END)), lambda s, y: s + y) - list_reduce(list_concat([0.0::DOUBLE], list_transform(pa, lambda x, i: CASE WHEN ha[i] THEN x ELSE 0 END)), lambda s, y: s + y) AS dm FROM e),
    mm AS (SELECT benchmark, {r('avg(dm)', 'd_mass')}, {r('avg(abs(dm))', 'abs_d_mass')} FROM ms GROUP BY 1)
    SELECT * FROM (SELECT benchmark, {n('count(*)', 'n')}, {r('avg(agree)', 'agreement')}, {r('avg(kl)', 'kl_mean')}, {r('max(kl)', 'kl_max')}, {r('avg(tv)', 'tv_mean')},
      {r('avg(dp)', 'abs_d_p_gold')}, {r('quantile_cont(kl, 0.5)', 'kl_median')}, {r('quantile_cont(kl, 0.95)', 'kl_p95')} FROM d GROUP BY 1) JOIN w USING (benchmark) JOIN mm USING (benchmark)""",
    ("metrics",),
)
def paired_distribution_summary(spark, sf):
    """Two systems' distributions on shared items, and their raw label logprobs: a lists labels above
    0.02, b those above 0.05, with one label masked."""
    pairs = A.pair_systems(normalised(spark, sf), "a", "b", ["probs", "gold_idx", "keys"]).withColumnRenamed("gold_idx_a", "gold_idx")

    def listed(side: str, floor: float, masked: int):
        entry = lambda p, i: F.struct(F.get("keys_a", i).alias("k"), F.when(i % 10 == masked, F.lit(float("-inf"))).otherwise(F.ln(p)).alias("lp"), p.alias("p"))
        kept = F.filter(F.transform(f"probs_{side}", entry), lambda e: e["p"] > floor)
        return F.map_from_arrays(F.transform(kept, lambda e: e["k"]), F.transform(kept, lambda e: e["lp"]))

    return A.paired_distribution_summary(pairs.withColumns({"raw_a": listed("a", 0.02, -1), "raw_b": listed("b", 0.05, 3)}), ["benchmark"])


@query(
    "answer_deltas",
    f"""WITH x AS (SELECT *, CASE qtype WHEN 'noul' THEN [1 - probs[1], probs[1]] ELSE list_concat(probs[2:], probs[1:1]) END AS other,
        score + (gold_idx % 2) AS other_score FROM all_preds)
    SELECT benchmark, {n("count(*) FILTER (WHERE qtype = 'choice')", 'choice_n')},
      {r("avg((list_position(probs, list_max(probs)) = list_position(other, list_max(other)))::INTEGER) FILTER (WHERE qtype = 'choice')", 'choice_agreement')},
      {r("avg(0.5 * list_reduce(list_transform(probs, lambda x, i: abs(x - other[i])), lambda s, y: s + y)) FILTER (WHERE qtype = 'choice')", 'choice_tv_mean')},
      {r("max(0.5 * list_reduce(list_transform(probs, lambda x, i: abs(x - other[i])), lambda s, y: s + y)) FILTER (WHERE qtype = 'choice')", 'choice_tv_max')},
      {n("count(*) FILTER (WHERE qtype = 'score')", 'score_n')}, {r("avg(abs(other_score - score)) FILTER (WHERE qtype = 'score')", 'score_mean')},
      {r("max(abs(other_score - score)) FILTER (WHERE qtype = 'score')", 'score_max')}, {n("count(*) FILTER (WHERE qtype = 'noul')", 'noul_n')},
      {r("avg(abs(other[1] - probs[1])) FILTER (WHERE qtype = 'noul')", 'noul_mean')}, {r("max(abs(other[1] - probs[1])) FILTER (WHERE qtype = 'noul')", 'noul_max')}
    FROM x GROUP BY 1""",
    ("all_preds",),
)
def answer_deltas(spark, sf):
    """Deltas between answers and a changed copy of them, by question type."""
    x = D.all_preds(spark, sf)
    other = F.when(F.col("qtype") == "noul", F.array(1.0 - F.get("probs", F.lit(0)), F.get("probs", F.lit(0)))).otherwise(
        F.concat(F.slice("probs", F.lit(2), F.size("probs") - 1), F.slice("probs", 1, 1))
    )
    pairs = x.select(
        "benchmark", "qtype", F.col("probs").alias("probs_a"), other.alias("probs_b"),
        F.col("score").alias("score_a"), (F.col("score") + F.col("gold_idx") % 2).alias("score_b"),
    )
    return A.answer_deltas(pairs, ["benchmark"])


@query(
    "grid_share",
    f"""WITH x AS (SELECT system, benchmark, list_transform(probs, lambda p, i: CASE WHEN item_id::BIGINT % 3 = 0 THEN round(ln(p) * 8) / 8 ELSE ln(p) END) AS raw FROM preds)
    SELECT system, benchmark, {n('count(*)', 'n')}, {r('avg((list_bool_and(list_transform(raw, lambda v: abs((v - raw[1]) / 0.125 - round_even((v - raw[1]) / 0.125, 0)) * 0.125 < 2e-3)))::INTEGER)', 'grid_share')} FROM x GROUP BY 1, 2""",
    ("preds",),
)
def grid_share(spark, sf):
    """Share of answers whose label logprobs move on a grid of eighths."""
    third = F.col("item_id").cast("bigint") % 3 == 0
    raw = F.transform("probs", lambda p: F.when(third, F.round(F.ln(p) * 8) / 8).otherwise(F.ln(p)))
    rows = D.preds(spark, sf).withColumn("raw", raw)
    return A.grid_share(rows, ["system", "benchmark"], "raw", 0.125)


@query(
    "api_read_completeness",
    f"""WITH x AS (SELECT system, benchmark, probs, list_position(probs, list_max(probs)) AS top,
        list_filter([1, 2, 3, 4, 5, 6, 7, 8, 9, 10], lambda i: probs[i] < 0.03 OR (item_id::BIGINT % 11 = 0 AND i = 1)) AS miss FROM preds)
    SELECT system, benchmark, {n('count(*)', 'n')}, {r('avg((len(miss) > 0)::INTEGER)', 'missing_label_share')},
      {r('min(coalesce(list_reduce(list_transform(probs, lambda p, i: CASE WHEN list_contains(miss, i) THEN 0 ELSE p END), lambda a, y: a + y), 0))', 'min_label_mass')},
      {n('count(*) FILTER (WHERE list_contains(miss, top))', 'n_missing_top')} FROM x GROUP BY 1, 2""",
    ("preds",),
)
def api_read_completeness(spark, sf):
    """How complete reads with unlisted labels were: share of answers missing a label, least label
    mass, answers whose top label is a bounded one."""
    eleventh = F.col("item_id").cast("bigint") % 11 == 0
    missing = F.filter(
        F.transform("probs", lambda p, i: F.when((p < 0.03) | (eleventh & (i == 0)), i)), lambda i: i.isNotNull()
    )
    rows = D.preds(spark, sf).withColumn("miss", missing)
    mass = V.vsum(F.transform("probs", lambda p, i: F.when(F.array_contains(F.col("miss"), i), 0.0).otherwise(p)))
    return rows.groupBy("system", "benchmark").agg(
        F.count(F.lit(1)).alias("n"), F.avg((F.size("miss") > 0).cast("double")).alias("missing_label_share"),
        F.min(mass).alias("min_label_mass"),
        F.count_if(F.array_contains("miss", V.argmax(F.col("probs")))).alias("n_missing_top"),
    )


_REPORTED = "least(1.0, greatest(0.0, list_max(probs) + (item_id::BIGINT % 5) * 0.01))"


@query(
    "confidence_fit_table",
    f"""WITH s AS (SELECT qtype AS kind, len(probs) AS k, {_REPORTED} AS reported,
        list_transform(probs, lambda x: x / list_reduce(probs, lambda a, y: a + y)) AS p FROM all_preds WHERE qtype <> 'noul'),
    e AS (
      SELECT 'max_prob' AS candidate, kind, k, reported - round(round_even(list_max(p) / 0.01, 0) * 0.01, 12) AS err FROM s
      UNION ALL
      SELECT 'peak_linear', kind, k, reported - round(round_even(greatest(0, least(1, (k * list_max(p) - 1) / (k - 1))) / 0.01, 0) * 0.01, 12) FROM s)
    SELECT candidate, coalesce(kind, 'all') AS kind, {n('k', 'k')}, {n('count(*)', 'n')}, {r('avg(abs(err))', 'mae')},
      {r('avg((abs(err) < 0.005)::INTEGER)', 'exact')}, {r('avg((abs(err) < 0.015)::INTEGER)', 'within_001')}, {r('avg(err)', 'bias')}
    FROM e GROUP BY GROUPING SETS ((candidate, kind, k), (candidate, kind), (candidate))""",
    ("all_preds",),
)
def confidence_fit_table(spark, sf):
    """How well two confidence functions reproduce a reported confidence, per kind and size, per
    kind and overall."""
    rows = D.all_preds(spark, sf).where("qtype <> 'noul'")
    samples = rows.select(
        F.col("qtype").alias("kind"), V.normalize("probs").alias("probs"),
        F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.array_max("probs") + (F.col("item_id").cast("bigint") % 5) * 0.01)).alias("reported"),
    )
    return evaluate_confidence(samples, ["max_prob", "peak_linear"])
