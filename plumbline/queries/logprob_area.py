"""Label probabilities from logged token logprobs."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbline.functions import vectors as V
from plumbline.functions.questions import letter
from plumbline.operators import logprobs as L
from plumbline.queries import derived as D
from plumbline.queries.registry import n, query, r

_LABELS = "labels_(pos, label, surface) AS (SELECT i, chr((65 + i)::INTEGER), unnest([chr((65 + i)::INTEGER), ' ' || chr((65 + i)::INTEGER)]) FROM range(0, 10) t(i))"
_MERGED = f"{_LABELS}, merged AS (SELECT request_id, pos, label, ln(sum(exp(logprob))) AS lp FROM token_topk JOIN labels_ ON token = surface GROUP BY 1, 2, 3)"


def labels(spark):
    return L.label_dimension(spark, "letters", 10)


@query("observed_label_logprobs", f"WITH {_MERGED} SELECT request_id, label, {r('lp', 'logprob')} FROM merged", ("token_topk",))
def observed_label_logprobs(spark, sf):
    """Listed surfaces of every label with their variants added."""
    merged = L.merge_variants(L.observed_surfaces(D.token_topk(spark, sf), labels(spark)))
    return merged.select("request_id", "label", "logprob")


def _read_sql(bound: str) -> str:
    return f"""WITH {_MERGED}, b AS (SELECT request_id, {bound} AS bound FROM token_topk GROUP BY 1),
    g AS (SELECT b.request_id, l.label, coalesce(m.lp, b.bound) AS raw, m.lp IS NULL AS missing, m.lp FROM b CROSS JOIN (SELECT DISTINCT label FROM labels_) l LEFT JOIN merged m ON m.request_id = b.request_id AND m.label = l.label)
    SELECT request_id, label, {r('raw', 'raw')}, {r('raw - ln(sum(exp(raw)) OVER w)', 'logprob')}, missing, {r('least(1, sum(CASE WHEN missing THEN 0 ELSE exp(lp) END) OVER w)', 'observed_mass')},
      max(missing) OVER w AS truncated, least(1, sum(CASE WHEN missing THEN 0 ELSE exp(lp) END) OVER w) < 0.5 AS low_mass FROM g WINDOW w AS (PARTITION BY request_id)"""


@query("first_token_read", _read_sql("min(logprob)"), ("token_topk",))
def first_token_read(spark, sf):
    """Label distributions of first-token reads; unlisted labels get the least listed logprob."""
    return L.first_token_read(D.token_topk(spark, sf), labels(spark)).drop("pos")


@query(
    "first_token_read_leftover", _read_sql("least(min(logprob), ln(greatest(1 - sum(exp(logprob)), power(2.0, -23))))"), ("token_topk",),
)
def first_token_read_leftover(spark, sf):
    """The same read with unlisted labels also capped by the mass the list leaves over."""
    return L.first_token_read(D.token_topk(spark, sf), labels(spark), leftover=True).drop("pos")


@query(
    "masked_read_bounds",
    f"SELECT request_id, {r('ln(greatest(1 - sum(exp(logprob)), power(2.0, -23)))', 'bound')} FROM token_topk GROUP BY 1", ("token_topk",),
)
def masked_read_bounds(spark, sf):
    """Bounds of unlisted labels when the list's mask is reflected in its logprobs."""
    return L.upper_bounds(D.token_topk(spark, sf), masked=True)


@query(
    "packed_reads",
    f"""WITH {_MERGED}, q AS (SELECT request_id FROM token_topk GROUP BY 1) SELECT q.request_id, 'ABCDEFGHIJ' AS keys, coalesce(string_agg(l.label, '' ORDER BY l.label) FILTER (WHERE m.lp IS NULL), '') AS missing
    FROM q CROSS JOIN (SELECT DISTINCT label FROM labels_) l LEFT JOIN merged m ON m.request_id = q.request_id AND m.label = l.label GROUP BY 1""",
    ("token_topk",),
)
def packed_reads(spark, sf):
    """Reads as arrays in label order."""
    packed = L.pack_read(L.first_token_read(D.token_topk(spark, sf), labels(spark)))
    return packed.select("request_id", F.array_join("keys", "").alias("keys"), F.array_join("missing", "").alias("missing"))


@query(
    "masked_logprobs",
    f"""SELECT event_type, {n('count(*)', 'n')}, {n('count(*) FILTER (WHERE value > 450)', 'n_masked')}, {n('count(*) FILTER (WHERE value < 1)', 'n_invalid')}, {r('sum(CASE WHEN value >= 1 AND value <= 450 THEN least(0, 0.0005 * (value < 2)::INTEGER - value * (value >= 2)::INTEGER / 100) END)', 'total')} FROM events GROUP BY 1""",
)
def masked_logprobs(spark, sf):
    """Logged logprobs cleaned: masked ones floored, tiny positive ones clamped, others refused."""
    v = F.col("value")
    lp = F.when(v > 450, F.lit(-9999.0)).when(v < 1, F.lit(0.5)).when(v < 2, F.lit(0.0005)).otherwise(-v / 100)
    rows = D.table(spark, sf, "events").select("event_type", L.clean_logprob(lp).alias("lp"))
    return rows.groupBy("event_type").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("lp") == V.NEG_INF).alias("n_masked"), F.count_if(F.col("lp").isNull()).alias("n_invalid"),
        F.sum(F.when(F.col("lp") > V.NEG_INF, F.col("lp"))).alias("total"),
    )


@query(
    "echo_rescaled_read",
    f"""WITH {_MERGED}, b AS (SELECT request_id, min(logprob) AS bound FROM token_topk GROUP BY 1), grid AS (SELECT b.request_id, l.pos, l.label, coalesce(m.lp, bound) AS raw0, m.lp IS NULL AS missing FROM b CROSS JOIN (SELECT DISTINCT pos, label FROM labels_) l LEFT JOIN merged m ON m.request_id = b.request_id AND m.label = l.label),
    s AS (SELECT request_id, surface, ln(sum(exp(logprob))) AS lp FROM token_topk JOIN labels_ ON token = surface GROUP BY 1, 2), an AS (SELECT request_id, arg_max(surface, (lp, surface)) AS surface, max(lp) AS lp FROM s GROUP BY 1),
    echo AS (SELECT vec_id::VARCHAR AS request_id, pos, labels_.label AS label, surface, CASE WHEN vec_id % 5 = 0 AND pos = 0 THEN '-inf'::DOUBLE ELSE -1.0 - pos / 4.0 - (surface <> labels_.label)::INTEGER END AS lp FROM embeddings, labels_),
    o AS (SELECT an.request_id, e.lp - an.lp AS off FROM an JOIN echo e ON e.request_id = an.request_id AND e.surface = an.surface WHERE e.lp > '-inf'::DOUBLE),
    t AS (SELECT request_id, label, CASE WHEN sum(exp(lp)) > 0 THEN ln(sum(exp(lp))) ELSE '-inf'::DOUBLE END AS lp FROM echo GROUP BY 1, 2),
    f AS (SELECT g.request_id, g.label, g.missing, CASE WHEN g.missing AND off IS NOT NULL THEN t.lp - off ELSE raw0 END AS raw, CASE WHEN g.missing THEN CASE WHEN off IS NOT NULL THEN 'echo' ELSE 'upper_bound' END END AS policy
      FROM grid g LEFT JOIN o ON o.request_id = g.request_id JOIN t ON t.request_id = g.request_id AND t.label = g.label)
    SELECT request_id, label, {r('exp(raw)', 'weight')}, {r('exp(raw) / sum(exp(raw)) OVER (PARTITION BY request_id)', 'p')}, missing, policy FROM f""",
    ("token_topk",),
)
def echo_rescaled_read(spark, sf):
    """Missing labels filled from echo scores put on the constrained scale by an anchor."""
    topk, names = D.token_topk(spark, sf), labels(spark)
    i = F.col("vec_id")
    lp = F.when((i % 5 == 0) & (F.col("pos") == 0), F.lit(V.NEG_INF)).otherwise(
        -1.0 - F.col("pos") / 4.0 - (F.col("surface") != F.col("label")).cast("int")
    )
    surfaces = F.flatten(
        F.transform(
            F.sequence(F.lit(0), F.lit(9)),
            lambda k: F.transform(
                F.array(letter(k), F.concat(F.lit(" "), letter(k))),
                lambda s: F.struct(k.alias("pos"), letter(k).alias("label"), s.alias("surface")),
            ),
        )
    )
    echo = D.table(spark, sf, "embeddings").select("vec_id", F.inline(surfaces)).select(
        i.cast("string").alias("request_id"), "surface", "label", lp.alias("logprob")
    )
    read = L.echo_rescale(L.first_token_read(topk, names), L.observed_surfaces(topk, names), echo)
    return read.select("request_id", "label", F.exp("raw").alias("weight"), F.exp("logprob").alias("p"), "missing", "policy")


def sequences(spark, sf):
    """Echo-scored continuations of 16 tokens per request, some far below the range of ``exp``; each
    request asks one of three questions."""
    e = D.table(spark, sf, "embeddings")
    spans = F.transform(
        F.sequence(F.lit(0), F.lit(3)),
        lambda k: F.struct(
            F.concat(F.lit("o"), k.cast("string")).alias("label"),
            F.transform(F.slice("embedding", 1 + k * 16, 16), lambda x: -F.abs(400.0 * x.cast("double"))).alias("token_logprobs"),
        ),
    )
    return e.select(F.col("vec_id").cast("string").alias("request_id"), (F.col("vec_id") % 3).alias("question_id"), F.inline(spans))


_SEQ = "seq AS (SELECT vec_id::VARCHAR AS request_id, vec_id, 'o' || k AS label, 16 AS len, list_reduce(list_transform(embedding[1 + k * 16:16 + k * 16], lambda x: -abs(400.0::DOUBLE * x::DOUBLE)), lambda a, y: a + y) AS total FROM embeddings, (SELECT unnest(range(0, 4)) AS k))"


@query(
    "sequence_scores",
    f"""WITH {_SEQ}, u AS (SELECT request_id, label, 'sum' AS mode, total AS score FROM seq UNION ALL SELECT request_id, label, 'mean', total / len FROM seq
      UNION ALL SELECT s.request_id, s.label, 'pmi', s.total - n.total FROM seq s JOIN seq n ON n.vec_id < 3 AND n.vec_id = s.vec_id % 3 AND n.label = s.label),
    m AS (SELECT *, max(score) OVER (PARTITION BY mode, request_id) AS top FROM u)
    SELECT mode, request_id, label, {r('score', 'score')}, {r('score - top - ln(sum(exp(score - top)) OVER (PARTITION BY mode, request_id))', 'logprob')} FROM m""",
)
def sequence_scores(spark, sf):
    """Echo scores as totals, means per token and differences to the question's content-free request."""
    s = sequences(spark, sf)
    out = None
    for mode in ("sum", "mean", "pmi"):
        null = s.where("request_id in ('0', '1', '2')") if mode == "pmi" else None
        part = L.sequence_scores(s, mode, null).withColumn("mode", F.lit(mode))
        out = part if out is None else out.unionByName(part)
    total = out.groupBy("mode", "request_id").agg(L.log_sum("score").alias("_t"))
    return out.join(total, ["mode", "request_id"]).select(
        "mode", "request_id", "label", "score", (F.col("score") - F.col("_t")).alias("logprob")
    )


@query(
    "trie_read",
    f"""WITH b AS (SELECT vec_id::VARCHAR AS request_id, 6 * embedding[1]::DOUBLE AS ca, 6 * embedding[2]::DOUBLE AS pin, 6 * embedding[3]::DOUBLE - 1 AS rd, 6 * embedding[4]::DOUBLE - 12 AS sh, -abs(6 * embedding[5]::DOUBLE) - 0.1 AS fee, vec_id % 7 = 3 AS gap FROM embeddings),
    t AS (SELECT *, ca - ln(exp(ca) + exp(pin)) AS p_ca, pin - ln(exp(ca) + exp(pin)) AS p_pin, CASE WHEN gap THEN 0 ELSE rd - ln(exp(rd) + exp(sh)) END AS p_rd,
      CASE WHEN gap THEN least(rd, ln(greatest(1 - exp(rd), power(2.0, -23)))) ELSE sh - ln(exp(rd) + exp(sh)) END AS p_sh FROM b),
    u AS (SELECT request_id, ' pin' AS label, p_pin AS raw, false AS pruned FROM t
      UNION ALL SELECT request_id, ' cash', CASE WHEN p_ca < ln(0.5) THEN p_ca ELSE p_ca + p_sh END, p_ca < ln(0.5) FROM t
      UNION ALL SELECT request_id, ' card', CASE WHEN p_ca < ln(0.5) THEN p_ca WHEN p_ca + p_rd < ln(0.5) THEN p_ca + p_rd ELSE p_ca + p_rd + ln(1 - exp(fee)) END, p_ca + p_rd < ln(0.5) FROM t
      UNION ALL SELECT request_id, ' card fee', CASE WHEN p_ca < ln(0.5) THEN p_ca WHEN p_ca + p_rd < ln(0.5) THEN p_ca + p_rd ELSE p_ca + p_rd + fee END, p_ca + p_rd < ln(0.5) FROM t)
    SELECT u.request_id, label, {r('u.raw', 'raw')}, {r('u.raw - ln(sum(exp(u.raw)) OVER (PARTITION BY u.request_id))', 'logprob')}, pruned, coalesce(label = ' cash' AND t.gap AND NOT pruned, false) AS missing
    FROM u JOIN t ON t.request_id = u.request_id""",
)
def trie_read(spark, sf):
    """Label logprobs as products of the conditionals along their token paths, pruned below 0.5."""
    texts = {" card": [" ca", "rd"], " cash": [" ca", "sh"], " card fee": [" ca", "rd", " fee"], " pin": [" pin"]}
    paths = spark.createDataFrame(list(texts.items()), "label string, path array<string>")
    x = lambda k: 6.0 * F.get("embedding", F.lit(k)).cast("double")
    rows = [
        ("", " ca", x(0), False), ("", " pin", x(1), False), (" ca", "rd", x(2) - 1.0, False), (" ca", "sh", x(3) - 12.0, False),
        (" card", " fee", -F.abs(x(4)) - 0.1, True),
    ]
    reads = F.array(
        *[F.struct(F.lit(a).alias("node"), F.lit(b).alias("child"), lp.alias("logprob"), F.lit(e).alias("ends")) for a, b, lp, e in rows]
    )
    branches = D.table(spark, sf, "embeddings").select(F.col("vec_id").cast("string").alias("request_id"), F.inline(reads))
    gap = (F.col("request_id").cast("bigint") % 7 == 3) & (F.col("child") == "sh")  # not listed
    return L.trie_read(paths, branches.where(~gap), tau=0.5)


@query(
    "surface_profile",
    f"""WITH {_LABELS}, names AS (SELECT DISTINCT label FROM labels_), t AS (SELECT request_id, request_id::BIGINT % 4 AS grp, token, exp(logprob) AS p, label FROM token_topk JOIN names ON trim(token) = label),
    i AS (SELECT grp, request_id, sum(CASE WHEN token = label THEN p ELSE 0 END) AS bare, sum(CASE WHEN token <> label THEN p ELSE 0 END) AS space, 10 - count(DISTINCT label) AS miss FROM t GROUP BY 1, 2)
    SELECT grp, {n('count(*)', 'n')}, {r('avg(bare)', 'mean_bare')}, {r('avg(space)', 'mean_space')}, {r('0', 'mean_decorated')}, {r('avg(bare + space)', 'observed_mean')}, {r('min(bare + space)', 'observed_min')},
      {r('avg(miss)', 'mean_missing')}, {n('count(*) FILTER (WHERE miss > 0)', 'items_with_missing')}, {r('quantile_disc(bare + space, 0.05)', 'observed_p05')} FROM i GROUP BY 1""",
    ("token_topk",),
)
def surface_profile(spark, sf):
    """How labels are written: mass per surface class, observed mass and missing labels."""
    topk = D.token_topk(spark, sf).withColumn("grp", F.col("request_id").cast("bigint") % 4)
    stats, _ = L.surface_profile(topk, labels(spark), ["grp"])
    return stats


@query(
    "surface_other_tokens",
    f"""WITH w AS (SELECT doc_id % 3 AS grp, unnest(string_split_regex(text, '\\s+')) AS token FROM documents), c AS (SELECT grp, token, count(*) AS n FROM w WHERE token <> '' AND trim(token, '*()[].:_`''"- ' || chr(10) || chr(9)) NOT IN ('A', 'B', 'C', 'D', 'E', 'F', 'G', 'H', 'I', 'J') GROUP BY 1, 2)
    SELECT grp, token, {n('n', 'n')}, {n('k', 'rank')} FROM (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY n DESC, token) AS k FROM c) WHERE k <= 8""",
)
def surface_other_tokens(spark, sf):
    """The eight most frequent tokens that are no label, per group."""
    words = D.table(spark, sf, "documents").select(
        (F.col("doc_id") % 3).alias("grp"), F.col("doc_id").cast("string").alias("request_id"),
        F.explode(F.split("text", r"\s+")).alias("token"), F.lit(-1.0).alias("logprob"),
    ).where("token <> ''")
    _, frequent = L.surface_profile(words, labels(spark), ["grp"])
    return frequent


@query(
    "strategy_selection",
    f"""SELECT role, strategy, {n('count(*)', 'n')} FROM (SELECT role, CASE WHEN fits AND structured THEN 'constrained' WHEN fits THEN 'first_token' WHEN NOT prefill THEN NULL WHEN echo THEN 'echo' ELSE 'trie' END AS strategy FROM (
      SELECT role, coalesce(CASE WHEN k <= 52 THEN k END * CASE WHEN prefill THEN 2 ELSE 1 END <= 20, false) AS fits, prefill, echo, structured FROM (
        SELECT role, 2 + length(text) % 70 AS k, turn % 2 = 0 AS prefill, conv_id % 3 = 0 AS echo, conv_id % 2 = 0 AS structured FROM conversations))) GROUP BY 1, 2""",
)
def strategy_selection(spark, sf):
    """Which recorded read serves a question of so many labels on such a backend."""
    c = D.table(spark, sf, "conversations")
    k = 2 + F.length("text") % 70
    chosen = L.select_strategy(F.when(k <= 52, k), F.lit(20), F.col("conv_id") % 2 == 0, F.col("turn") % 2 == 0, F.col("conv_id") % 3 == 0)
    return c.groupBy("role", chosen.alias("strategy")).agg(F.count(F.lit(1)).alias("n"))
