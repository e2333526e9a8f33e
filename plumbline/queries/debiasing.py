"""Position priors and debiased answers of every system, each by itself."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbline.functions import vectors as V
from plumbline.operators import debias as B
from plumbline.queries import derived as D
from plumbline.queries.registry import n, query, r
from plumbline.queries.scoring import normalised

ITEM = ["system", "item_id"]
_LONG = "long AS (SELECT *, unnest(ord) AS opt, unnest(shown_probs) AS p, unnest(range(0, 10)) AS pos FROM presentations)"


def free_column():
    return F.array_repeat(F.lit(True), F.lit(10))


def shown(spark, sf):
    return D.presentations(spark, sf).withColumn("free", free_column())


def with_gaps(spark, sf):
    """Presentations with one shift missing for every sixth item."""
    return shown(spark, sf).where(~((F.col("item_id").cast("bigint") % 6 == 0) & (F.col("shift") == 3)))


_GAPS = "gaps AS (SELECT * FROM presentations WHERE NOT (item_id::BIGINT % 6 = 0 AND shift = 3))"
_FULL = "full_ AS (SELECT system, item_id FROM gaps GROUP BY 1, 2 HAVING count(*) = 10)"
_LONG_GAPS = _LONG.replace("FROM presentations", "FROM gaps")


def _shares(of: str = "w") -> str:
    return r(f"{of} / sum({of}) OVER (PARTITION BY system, item_id)", "p")


@query(
    "averaged_presentations",
    f"""WITH {_LONG}, m AS (SELECT system, item_id, opt, avg(p) AS p FROM long GROUP BY 1, 2, 3) SELECT system, item_id, {n('opt', 'opt')}, {_shares('p')} FROM m""",
    ("presentations",),
)
def averaged_presentations(spark, sf):
    averaged = B.average_presentations(shown(spark, sf), ITEM)
    return averaged.select(*ITEM, F.posexplode("probs").alias("opt", "p"))


@query("full_cycles", f"WITH {_GAPS} SELECT system, item_id, count(*) = 10 AS full FROM gaps GROUP BY 1, 2", ("presentations",))
def full_cycles(spark, sf):
    return B.full_cycles(with_gaps(spark, sf), ITEM)


_ITEM_PRIOR = """ip AS (SELECT system, item_id, prior_key, pos, w / sum(w) OVER (PARTITION BY system, item_id) AS prior FROM (
  SELECT system, item_id, prior_key, pos, exp(avg(ln(greatest(p, 1e-6)))) AS w FROM long GROUP BY 1, 2, 3, 4))"""


@query("item_priors", f"WITH {_LONG}, {_ITEM_PRIOR} SELECT system, item_id, {n('pos', 'pos')}, {r('prior', 'prior')} FROM ip", ("presentations",))
def item_priors(spark, sf):
    return B.item_priors(shown(spark, sf), ITEM)


@query(
    "pride_priors",
    f"""WITH {_GAPS}, {_LONG_GAPS}, {_ITEM_PRIOR}, {_FULL},
    m AS (SELECT system, prior_key, pos, avg(prior) AS v, count(*) AS c FROM ip JOIN full_ USING (system, item_id) GROUP BY 1, 2, 3)
    SELECT system, prior_key, {n('pos', 'pos')}, {r('v / sum(v) OVER (PARTITION BY system, prior_key)', 'prior')}, {n('c', 'n')} FROM m""",
    ("presentations",),
)
def pride_priors(spark, sf):
    """Position priors of the questions shown in a full cycle."""
    priors = B.pride_priors(with_gaps(spark, sf), [*ITEM, "prior_key"], ["system", "prior_key"])
    return priors.select("system", "prior_key", F.posexplode("prior").alias("pos", "prior"), "n")


def keyed_items(spark, sf):
    """Raw answers of both systems with prior key, fold and free positions."""
    i = F.col("item_id").cast("bigint")
    return normalised(spark, sf).select(
        *ITEM, "benchmark", "gold_idx", F.col("probs").alias("raw"), "probs",
        F.concat(F.lit("choice:10:"), (i % 2).cast("string")).alias("prior_key"),
        (F.col("question_id").cast("bigint") % 5).cast("int").alias("fold"), free_column().alias("free"),
    )


_KEY = "'choice:10:' || (item_id::BIGINT % 2)"
_ITEMS = f"items AS (SELECT system, item_id, probs, {_KEY} AS prior_key, question_id::BIGINT % 5 AS fold FROM metrics), il AS (SELECT *, unnest(probs) AS p, unnest(range(0, 10)) AS pos FROM items)"


@query(
    "batch_priors",
    f"""WITH {_ITEMS}, m AS (SELECT system, prior_key, pos, avg(p) AS v, count(*) AS c FROM il GROUP BY 1, 2, 3)
    SELECT system, prior_key, {n('pos', 'pos')}, {r('v / sum(v) OVER (PARTITION BY system, prior_key)', 'prior')}, {n('c', 'n')} FROM m""",
    ("metrics",),
)
def batch_priors(spark, sf):
    priors = B.batch_priors(keyed_items(spark, sf), ["system", "prior_key"], min_count=B.MIN_BATCH)
    return priors.select("system", "prior_key", F.posexplode("prior").alias("pos", "prior"), "n")


_OOF = "oof AS (SELECT system, prior_key, f AS fold, pos, avg(v) AS m FROM src, (SELECT unnest(range(0, 5)) AS f) WHERE fold <> f GROUP BY 1, 2, 3, 4)"
_DIVIDED = "JOIN oof USING (system, prior_key, fold, pos)"


def _batch_sql(keys: str) -> str:
    return f"""WITH {_ITEMS}, src AS (SELECT system, prior_key, fold, pos, p AS v FROM il), {_OOF}, d AS (SELECT system, item_id, pos, p / m AS w FROM il {_DIVIDED})
    SELECT {keys}, {n('pos', 'pos')}, {_shares()} FROM d"""


@query("batch_debiased", _batch_sql("system, item_id"), ("metrics",))
def batch_debiased(spark, sf):
    """Answers divided by the mean answer of the other folds."""
    return B.debias_offline(keyed_items(spark, sf), "batch").select(*ITEM, F.posexplode("debiased").alias("pos", "p"))


_PRIDE = f"""WITH {_ITEMS}, {_GAPS}, {_LONG_GAPS}, {_ITEM_PRIOR}, {_FULL},
    src AS (SELECT i.system, i.prior_key, i.fold, ip.pos, ip.prior AS v FROM ip JOIN full_ USING (system, item_id) JOIN items i USING (system, item_id)), {_OOF},
    div AS (SELECT system, item_id, pos, p / m AS w FROM il {_DIVIDED} WHERE (system, item_id) NOT IN (SELECT (system, item_id) FROM full_)),
    av AS (SELECT system, item_id, opt AS pos, avg(p) AS w FROM long JOIN full_ USING (system, item_id) GROUP BY 1, 2, 3), u AS (SELECT * FROM div UNION ALL SELECT * FROM av)
    SELECT system, item_id, {n('pos', 'pos')}, {_shares()} FROM u"""


@query("pride_debiased", _PRIDE, ("metrics", "presentations"))
def pride_debiased(spark, sf):
    """Answers divided by the other folds' permutation priors; fully permuted questions answer with
    their average."""
    out = B.debias_offline(keyed_items(spark, sf), "pride", with_gaps(spark, sf))
    return out.select(*ITEM, F.posexplode("debiased").alias("pos", "p"))


@query(
    "prior_with_fixed_option",
    f"""WITH {_ITEMS}, m AS (SELECT system, prior_key, pos, avg(p) AS v FROM il WHERE pos < 9 GROUP BY 1, 2, 3), q AS (SELECT *, ln(greatest(v / sum(v) OVER (PARTITION BY system, prior_key), 1e-6)) AS lp FROM m),
    c AS (SELECT system, prior_key, pos, lp - avg(lp) OVER (PARTITION BY system, prior_key) AS shift FROM q),
    d AS (SELECT il.system, item_id, il.pos, p * exp(-coalesce(shift, 0)) AS w FROM il LEFT JOIN c ON c.system = il.system AND c.prior_key = il.prior_key AND c.pos = il.pos)
    SELECT system, item_id, {n('pos', 'pos')}, {_shares()} FROM d""",
    ("metrics",),
)
def prior_with_fixed_option(spark, sf):
    """A prior over nine free positions; the fixed last option keeps its weight."""
    free = F.concat(F.array_repeat(F.lit(True), F.lit(9)), F.array(F.lit(False)))
    items = keyed_items(spark, sf).withColumn("free", free)
    priors = B.batch_priors(items, ["system", "prior_key"])
    out = B.make_debiaser("batch").apply(items, priors)
    return out.select(*ITEM, F.posexplode("debiased").alias("pos", "p"))


@query(
    "prior_lookup",
    f"""WITH {_ITEMS}, m AS (SELECT system, prior_key, pos, avg(p) AS v FROM il WHERE prior_key = 'choice:10:1' GROUP BY 1, 2, 3),
    d AS (SELECT il.system, item_id, il.pos, p / coalesce(v, 0.1) AS w, v IS NULL AS none_ FROM il LEFT JOIN m ON m.system = il.system AND m.prior_key = il.prior_key AND m.pos = il.pos)
    SELECT system, item_id, {n('pos', 'pos')}, {_shares()}, CASE WHEN none_ THEN 'batch: no prior for choice:10:0' END AS warning FROM d""",
    ("metrics",),
)
def prior_lookup(spark, sf):
    """Stored priors applied by system and key; keys without one keep their answer and are warned
    about."""
    items = keyed_items(spark, sf)
    priors = B.batch_priors(items.where("prior_key = 'choice:10:1'"), ["system", "prior_key"])
    out = B.make_debiaser("batch").apply(items, priors)
    return out.select(*ITEM, F.posexplode(V.normalize("debiased")).alias("pos", "p"), "warning")


@query(
    "permutation_policy",
    f"""WITH {_LONG}, items AS (SELECT system, item_id, probs, item_id::BIGINT % 4 AS k FROM metrics), av AS (SELECT system, item_id, opt AS pos, avg(p) AS p FROM long GROUP BY 1, 2, 3),
    an AS (SELECT system, item_id, pos, p / sum(p) OVER (PARTITION BY system, item_id) AS p FROM av), il AS (SELECT *, unnest(probs) AS own, unnest(range(0, 10)) AS pos FROM items)
    SELECT system, item_id, {n('pos', 'pos')}, {r('CASE WHEN k = 0 THEN own WHEN k = 1 THEN own ELSE an.p END', 'p')}, CASE WHEN k = 1 THEN 'permutation: 10 free options > max_options=8' END AS warning
    FROM il JOIN an USING (system, item_id, pos)""",
    ("metrics", "presentations"),
)
def permutation_policy(spark, sf):
    """Averaging presentations only for questions with two to eight free options."""
    k = F.col("item_id").cast("bigint") % 4
    free = F.when(k == 0, F.transform(F.sequence(F.lit(0), F.lit(9)), lambda i: i == 0)).when(k == 1, free_column()).otherwise(
        F.transform(F.sequence(F.lit(0), F.lit(9)), lambda i: i < 8)
    )
    items = keyed_items(spark, sf).withColumn("free", free)
    out = B.make_debiaser("permutation", max_options="8").apply(items, shown(spark, sf))
    return out.select(*ITEM, F.posexplode("debiased").alias("pos", "p"), "warning")


@query(
    "contextual_debiased",
    f"""WITH l AS (SELECT system, item_id, question_id, unnest(probs) AS p, unnest(range(0, 10)) AS pos FROM metrics),
    cf AS (SELECT CASE system WHEN 'a' THEN 'b' ELSE 'a' END AS system, question_id, pos, avg(p) AS m FROM l GROUP BY 1, 2, 3),
    d AS (SELECT system, item_id, pos, p / greatest(m, 1e-6) AS w FROM l JOIN cf USING (system, question_id, pos))
    SELECT system, item_id, {n('pos', 'pos')}, {_shares()} FROM d""",
    ("metrics",),
)
def contextual_debiased(spark, sf):
    """Answers divided by the same system's mean answer to content-free states of the question (the
    other system's answers stand in for those)."""
    p = normalised(spark, sf).withColumn("free", free_column()).withColumnRenamed("question_id", "question_hash")
    answers = p.select(F.when(F.col("system") == "a", "b").otherwise("a").alias("system"), "question_hash", "free", "probs")
    out = B.make_debiaser("contextual").apply(p, answers)
    return out.select(*ITEM, F.posexplode("debiased").alias("pos", "p"))


@query("batch_debiased_systems", _batch_sql("system, benchmark, item_id").replace("probs, 'choice", "benchmark, probs, 'choice").replace("d AS (SELECT system, item_id", "d AS (SELECT system, benchmark, item_id"), ("metrics",))
def batch_debiased_systems(spark, sf):
    """Both systems' answers, each divided by its own mean answer of the other folds."""
    return B.debias_offline(keyed_items(spark, sf), "batch").select("system", "benchmark", "item_id", F.posexplode("debiased").alias("pos", "p"))


@query("pride_debiased_systems", _PRIDE, ("metrics", "presentations"))
def pride_debiased_systems(spark, sf):
    """Both systems' answers, each divided by its own permutation priors of the other folds; what a
    system gets does not depend on the others."""
    out = [B.debias_offline(keyed_items(spark, sf).where(F.col("system") == s), "pride", with_gaps(spark, sf)) for s in ("a", "b")]
    return out[0].unionByName(out[1]).select(*ITEM, F.posexplode("debiased").alias("pos", "p"))
