"""Item construction, question banks, prompts, splits, folds and samples."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbline.functions import questions as Q
from plumbline.operators import calibration as C
from plumbline.operators import sampling as P
from plumbline.operators.logprobs import capacity, label_dimension
from plumbline.operators.summaries import display_order, drop_excluded
from plumbline.queries import derived as D
from plumbline.queries.registry import n, query
from plumbline.sources import datasets as ds
from plumbline.sources.readers import list_column
from plumbline.sources.writers import table_digest

US = "chr(31)"


def sha(*parts: str) -> str:
    return f"sha256(concat_ws({US}, {', '.join(parts)}))"


# --- adapters --------------------------------------------------------------------------------------


def mcq(spark, sf):
    return D.mcq_rows(spark, sf).withColumnRenamed("gold_index", "answer_index")


@query(
    "multiple_choice_items",
    """SELECT 'parts:' || question_id AS item_id, question_id, chr((65 + gold_index)::INTEGER) AS stratum, question AS state,
      chr((65 + gold_index)::INTEGER) AS gold, array_to_string(list_transform(options, lambda o, i: chr((64 + i)::INTEGER) || ') ' || o), chr(10)) AS shown FROM mcq_rows""",
    ("mcq_rows",),
)
def multiple_choice_items(spark, sf):
    items = ds.multiple_choice(mcq(spark, sf), "parts")
    return items.select("item_id", "question_id", "stratum", "state", "gold", Q.render_options(F.col("options")).alias("shown"))


@query(
    "labelled_choice_items",
    """SELECT 'arc:' || question_id AS item_id, question AS state, chr((65 + gold_index)::INTEGER) AS gold,
      array_to_string(list_transform(options, lambda o, i: chr((64 + i)::INTEGER)), '') AS keys FROM mcq_rows""",
    ("mcq_rows",),
)
def labelled_choice_items(spark, sf):
    """Rows whose options are labelled by digits or letters, keyed by letters."""
    rows = D.mcq_rows(spark, sf)
    digits = F.col("question_id").cast("bigint") % 2 == 0
    label = F.transform("options", lambda o, i: F.when(digits, (i + 1).cast("string")).otherwise(Q.letter(i)))
    shaped = rows.select(
        F.col("question_id").alias("id"), "question", F.struct(F.col("options").alias("text"), label.alias("label")).alias("choices"),
        F.get(label, F.col("gold_index")).alias("answerKey"),
    )
    items = ds.labelled_choice(shaped, "arc")
    return items.select("item_id", "state", "gold", F.array_join(Q.keys_of(F.col("options")), "").alias("keys"))


@query(
    "classification_items",
    """SELECT 'news:' || d.doc_id AS item_id, CASE lang WHEN 'en' THEN 'English' ELSE lang END AS gold, length(text) AS n_state,
      array_to_string(list_sort((SELECT list(DISTINCT CASE lang WHEN 'en' THEN 'English' ELSE lang END) FROM documents WHERE lang <> 'de')), ',') AS keys
    FROM documents d WHERE lang <> 'de'""",
)
def classification_items(spark, sf):
    """Documents as a choice among languages, one class out of scope."""
    d = D.table(spark, sf, "documents")
    codes = [row["lang"] for row in d.select("lang").distinct().orderBy("lang").collect()]  # classification() refuses more than 255
    names = ["English" if c == "en" else c for c in codes]
    place = F.array_position(F.array(*[F.lit(c) for c in codes]), F.col("lang")).cast("int") - 1
    items = ds.classification(
        d.withColumn("label", place), "news", "text", "label", names, "Which language is this?", ["de"], "doc_id"
    )
    return items.select(
        "item_id", "gold", F.length("state").cast("bigint").alias("n_state"),
        F.array_join(F.array_sort(Q.keys_of(F.col("options"))), ",").alias("keys"),
    )


@query(
    "boolean_items",
    """SELECT 'toxic:' || d.doc_id AS item_id, (toxic = 1)::VARCHAR AS gold, 'is document ' || d.doc_id || ' toxic?' AS instructions,
      CASE WHEN toxic = 1 THEN 'yes' ELSE 'no' END AS stratum, 'true,false' AS keys FROM documents d JOIN labels l ON d.doc_id = l.doc_id""",
)
def boolean_items(spark, sf):
    rows = D.table(spark, sf, "documents").join(D.table(spark, sf, "labels"), "doc_id").select(
        "doc_id", "text", (F.col("toxic") == 1).alias("answer"),
        F.concat(F.lit("is document "), F.col("doc_id").cast("string"), F.lit(" toxic")).alias("question"),
    )
    items = ds.boolean(rows, "toxic", "question", "text", "answer", "doc_id")
    keys = Q.answer_keys(F.col("qtype"), F.col("options"))
    return items.select("item_id", "gold", "instructions", "stratum", F.array_join(keys, ",").alias("keys"))


@query(
    "ordinal_items",
    """SELECT 'priority:' || o_orderkey AS item_id, (substr(o_orderpriority, 1, 1)::INTEGER - 1)::VARCHAR AS gold,
      ['very negative', 'negative', 'neutral', 'positive', 'very positive'][substr(o_orderpriority, 1, 1)::INTEGER] AS stratum, '0,1,2,3,4' AS keys FROM orders""",
)
def ordinal_items(spark, sf):
    rows = D.table(spark, sf, "orders").select(
        "o_orderkey", F.concat(F.lit("order "), F.col("o_orderkey").cast("string")).alias("text"),
        (F.substring("o_orderpriority", 1, 1).cast("int") - 1).alias("level"),
    )
    items = ds.ordinal(rows, "priority", "text", "level", ds.SENTIMENT_LEVELS, ds.SENTIMENT_QUESTION, "o_orderkey")
    return items.select("item_id", "gold", "stratum", F.array_join(Q.keys_of(F.col("options")), ",").alias("keys"))


@query(
    "mapped_file_items",
    f"""SELECT 'mine:' || event_id AS item_id, CASE WHEN event_type IN ('click', 'purchase') THEN 'true' WHEN event_type <> 'error' THEN 'false' END AS gold, event_type AS tag,
      CASE WHEN props IS NULL THEN 'no state' WHEN event_type = 'error' THEN 'gold' END AS problem FROM events""",
)
def mapped_file_items(spark, sf):
    """A user's table with a column mapping: yes/no gold in several spellings, bad gold rejected."""
    e = D.table(spark, sf, "events")
    gold = (
        F.when(F.col("event_type") == "click", " Yes").when(F.col("event_type") == "purchase", "1")
        .when(F.col("event_type") == "error", "maybe").otherwise("FALSE")
    )
    fields = {"state": "props", "gold": "gold", "id": "event_id", "instructions": F.lit("Is it?")}
    items, rejected = ds.mapped_items(e.withColumn("gold", gold), "mine", "noul", fields, ("event_type",))
    judged = items.withColumn("problem", F.lit(None).cast("string")).unionByName(rejected)
    return judged.select("item_id", "gold", F.col("event_type").alias("tag"), "problem")


@query(
    "gold_coercion",
    f"""SELECT event_type, {n("count(*)", 'n')}, {n("count(*) FILTER (WHERE event_type <> 'error')", 'n_level')}, {n("coalesce(sum(CASE WHEN event_type <> 'error' THEN floor(value)::BIGINT END), 0)", 'total')} FROM events GROUP BY 1""",
)
def gold_coercion(spark, sf):
    """Level numbers read from text cells; text that is no number is refused."""
    e = D.table(spark, sf, "events")
    cell = F.when(F.col("event_type") == "error", "n/a").otherwise(
        F.concat(F.lit(" "), F.floor("value").cast("string"))
    )
    level = ds.coerce_gold("score", cell).cast("bigint")
    return e.withColumn("level", level).groupBy("event_type").agg(
        F.count(F.lit(1)).alias("n"), F.count("level").alias("n_level"), F.coalesce(F.sum("level"), F.lit(0)).alias("total")
    )


@query(
    "parsed_list_column",
    f"SELECT question_id, unnest(range(0, 4)) AS pos, unnest(options) AS option FROM mcq_rows", ("mcq_rows",),
)
def parsed_list_column(spark, sf):
    """Stringified lists parsed back to arrays, single and double quotes mixed."""
    rows = D.mcq_rows(spark, sf)
    quoted = F.transform(
        "options", lambda o, i: F.when(i % 2 == 0, F.concat(F.lit("'"), o, F.lit("'"))).otherwise(F.concat(F.lit('"'), o, F.lit('"')))
    )
    text = F.concat(F.lit("["), F.array_join(quoted, ", "), F.lit("]"))
    return rows.withColumn("text", text).select("question_id", F.posexplode(list_column(F.col("text"))).alias("pos", "option"))


@query(
    "included_benchmarks",
    f"""SELECT benchmark, {n('count(*)', 'n')}, {n("CASE benchmark WHEN 'ag_news' THEN 1 WHEN 'boolq' THEN 2 WHEN 'aaa' THEN 3 ELSE 4 END", 'place')} FROM (
      SELECT ['boolq', 'yelp_stars', 'zzz', 'ag_news', 'aaa'][1 + doc_id % 5] AS benchmark FROM documents) WHERE benchmark <> 'yelp_stars' GROUP BY 1""",
)
def included_benchmarks(spark, sf):
    """Excluded benchmarks dropped, the rest in display order."""
    from plumbline.operators.ranking import with_rank

    names = F.array(*[F.lit(x) for x in ("boolq", "yelp_stars", "zzz", "ag_news", "aaa")])
    rows = D.table(spark, sf, "documents").select(F.get(names, (F.col("doc_id") % 5).cast("int")).alias("benchmark"))
    counts = drop_excluded(rows).groupBy("benchmark").agg(F.count(F.lit(1)).alias("n"))
    known, name = display_order(F.col("benchmark"))
    return with_rank(counts.withColumn("_known", known), [], ["_known", "benchmark"], "place", "_n").drop("_known", "_n")


# --- banks -----------------------------------------------------------------------------------------

_BANK = f"""
base AS (SELECT *, list_transform(list_sort(list_transform(range(0, 4), lambda i: {{'h': {sha("'0'", 'question_id', 'i::VARCHAR')}, 'i': i}})), lambda x: x.i) AS b FROM mcq_rows),
bank AS (SELECT 'parts:' || question_id || ':' || s AS item_id, question_id, s AS permutation_id, gold_index, options, question, subject,
    list_concat(b[s + 1:], b[1:s]) AS ord FROM base, (SELECT unnest(range(0, 3)) AS s)),
shown AS (SELECT *, chr((64 + list_position(ord, gold_index))::INTEGER) AS gold,
    array_to_string(list_append(list_transform(ord, lambda j, i: chr((64 + i)::INTEGER) || ') ' || options[j + 1]), 'E) I don''t know'), chr(10)) AS block FROM bank)"""


def bank(spark, sf):
    return ds.question_bank(D.mcq_rows(spark, sf), "parts", 0, True, 3)


@query(
    "question_bank",
    f"""WITH {_BANK.strip()} SELECT item_id, gold, array_to_string(ord, ',') AS option_order, sha256(block) AS options_sha256,
    subject AS stratum, 'Which option correctly answers the question? A wrong answer costs 1 point, a correct answer earns 1 point, and E (I don''t know) earns 0.' AS instructions FROM shown""",
    ("mcq_rows",),
)
def question_bank(spark, sf):
    """Three cyclic shifts of a hashed option order per question, "I don't know" last."""
    return bank(spark, sf).select(
        "item_id", "gold", F.array_join(F.transform("option_order", lambda i: i.cast("string")), ",").alias("option_order"),
        "options_sha256", "stratum", "instructions",
    )


@query(
    "bank_violations",
    f"""SELECT rule, {n('count(*)', 'n')} FROM (SELECT CASE WHEN question_id % 7 = 0 THEN 'gold' WHEN question_id % 7 = 1 THEN 'hash' END AS rule FROM (SELECT question_id::BIGINT AS question_id FROM mcq_rows, range(3))) WHERE rule IS NOT NULL GROUP BY 1""",
    ("mcq_rows",),
)
def bank_violations(spark, sf):
    """A bank with tampered gold keys and hashes."""
    k = F.col("question_id").cast("bigint") % 7
    tampered = bank(spark, sf).withColumn("gold", F.when(k == 0, "E").otherwise(F.col("gold"))).withColumn(
        "options_sha256", F.when(k == 1, F.lit("0")).otherwise(F.col("options_sha256"))
    )
    return ds.bank_violations(tampered).groupBy("rule").agg(F.count(F.lit(1)).alias("n"))


@query(
    "item_violations",
    f"""SELECT qtype, {n('count(*)', 'n')} FROM (SELECT qtype, gold_idx FROM all_preds WHERE gold_idx = 1) GROUP BY 1""",
    ("all_preds",),
)
def item_violations(spark, sf):
    """Items whose gold is not a key of their question."""
    p = D.all_preds(spark, sf)
    options = Q.named_options(F.col("keys"))
    gold = F.when(F.col("gold_idx") == 1, "?").otherwise(F.get("keys", F.col("gold_idx")))
    items = p.select("item_id", "qtype", options.alias("options"), gold.alias("gold"))
    return ds.item_violations(items).groupBy("qtype").agg(F.count(F.lit(1)).alias("n"))


@query(
    "bank_benchmark_items",
    f"""WITH {_BANK.strip()} SELECT subject, {n('count(*)', 'n')}, {n('count(DISTINCT question_id)', 'n_questions')}, {n("count(*) FILTER (WHERE gold = 'A')", 'gold_a')} FROM shown GROUP BY 1""",
    ("mcq_rows",),
)
def bank_benchmark_items(spark, sf):
    """Bank items as benchmark items, profiled by subject."""
    return bank(spark, sf).groupBy(F.col("stratum").alias("subject")).agg(
        F.count(F.lit(1)).alias("n"), F.count_distinct("question_id").alias("n_questions"), F.count_if(F.col("gold") == "A").alias("gold_a")
    )


@query(
    "table_digest",
    f"""WITH {_BANK.strip()},
    h AS (SELECT subject, sha256(to_json({{'item_id': item_id, 'gold': gold, 'options_sha256': sha256(block)}})::VARCHAR) AS h FROM shown),
    b AS (SELECT subject, ('0x' || substr(h, 1, 3))::BIGINT AS bucket, count(*) AS c, sum(('0x' || substr(h, 4, 12))::BIGINT) AS l0,
        sum(('0x' || substr(h, 16, 12))::BIGINT) AS l1, sum(('0x' || substr(h, 28, 12))::BIGINT) AS l2, sum(('0x' || substr(h, 40, 12))::BIGINT) AS l3 FROM h GROUP BY 1, 2)
    SELECT subject, {n('sum(c)', 'n_rows')}, sha256(string_agg(bucket || '=' || sha256(concat_ws(':', c, l0, l1, l2, l3)), chr(10) ORDER BY bucket)) AS digest FROM b GROUP BY 1""",
    ("mcq_rows",),
)
def table_digest_query(spark, sf):
    """Order-independent digest of the bank's items per subject."""
    rows = bank(spark, sf).select(F.col("stratum").alias("subject"), "item_id", "gold", "options_sha256")
    return table_digest(rows, ["subject"])


@query(
    "permuted_presentations",
    f"""SELECT question_id, {n('s', 'shift')}, array_to_string(list_transform(range(0, 5), lambda i: chr((65 + i)::INTEGER) || '=' || coalesce(options[1 + CASE WHEN i = 4 THEN 4 ELSE (i + s) % 4 END], 'I don''t know')), ';') AS shown
    FROM mcq_rows, (SELECT unnest(range(0, 4)) AS s)""",
    ("mcq_rows",),
)
def permuted_presentations(spark, sf):
    """Every cyclic shift of the free options; the last option stays."""
    rows = D.mcq_rows(spark, sf)
    options = Q.lettered_options(F.concat("options", F.array(F.lit(Q.IDK_TEXT))))
    q = rows.withColumn("o", options).withColumn("free", Q.free_positions(F.lit("choice"), F.col("o")))
    shifted = q.withColumn("shift", F.explode(Q.cyclic_shifts(F.col("free"))))
    shown = Q.present(F.col("o"), Q.shifted_order(F.col("free"), F.col("shift")))
    return shifted.select(
        "question_id", "shift", F.array_join(F.transform(shown, lambda x: F.concat(x["key"], F.lit("="), x["text"])), ";").alias("shown")
    )


@query(
    "random_presentations",
    f"""WITH nums AS (SELECT question_id, k + 1 AS pos, 1 + (('0x' || substr({sha("'0'", 'question_id', "'place'")}, 1, 15))::BIGINT % 23 + k * 5) % 23 AS num FROM mcq_rows, (SELECT unnest(range(0, 4)) AS k)),
    a AS (SELECT *, num // 6 AS x, num % 6 AS rest, [0, 1, 2, 3] AS l FROM nums), b AS (SELECT *, list_filter(l, lambda v: v <> x) AS m FROM a),
    c AS (SELECT *, m[rest // 2 + 1] AS y FROM b), d AS (SELECT *, list_filter(m, lambda v: v <> y) AS o, rest % 2 AS z FROM c)
    SELECT question_id, {n('pos', 'pos')}, concat_ws(',', x, y, o[z + 1], o[2 - z]) AS option_order FROM d UNION ALL SELECT question_id, 0::BIGINT, '0,1,2,3' FROM mcq_rows""",
    ("mcq_rows",),
)
def random_presentations(spark, sf):
    """The identity and four distinct hashed orders per question."""
    rows = D.mcq_rows(spark, sf)
    free = F.transform("options", lambda o: F.lit(True))
    orders = Q.random_orders(F.col("free"), 5, F.lit("0"), F.col("question_id"))
    return rows.withColumn("free", free).select("question_id", F.posexplode(orders).alias("pos", "o")).select(
        "question_id", "pos", F.array_join(F.transform("o", lambda i: i.cast("string")), ",").alias("option_order")
    )


@query(
    "question_signatures",
    f"""SELECT qtype || ':' || len(keys) || ':' || substr(sha256(to_json(CASE WHEN qtype = 'noul' THEN ['true', 'false'] ELSE keys END)::VARCHAR), 1, 16) AS signature,
      {n('count(*)', 'n')} FROM all_preds GROUP BY 1""",
    ("all_preds",),
)
def question_signatures(spark, sf):
    p = D.all_preds(spark, sf)
    options = F.when(F.col("qtype") == "score", Q.level_options(F.col("keys"))).otherwise(Q.named_options(F.col("keys")))
    return p.groupBy(Q.signature(F.col("qtype"), options).alias("signature")).agg(F.count(F.lit(1)).alias("n"))


@query(
    "prior_keys",
    f"""SELECT CASE WHEN idk THEN 'choice:5:' || substr(sha256('["A","B","C","D","E"]'), 1, 16) || '|fixed=4' ELSE 'choice:4:' || substr(sha256('["A","B","C","D"]'), 1, 16) END AS prior_key,
      CASE WHEN idk THEN 'E' END AS idk_key, {n('count(*)', 'n')} FROM (SELECT question_id::BIGINT % 3 = 0 AS idk FROM mcq_rows) GROUP BY 1, 2""",
    ("mcq_rows",),
)
def prior_keys(spark, sf):
    """Prior keys and "I don't know" keys of questions with and without that option."""
    rows = D.mcq_rows(spark, sf)
    idk = F.col("question_id").cast("bigint") % 3 == 0
    options = Q.lettered_options(F.when(idk, F.concat("options", F.array(F.lit(Q.IDK_TEXT)))).otherwise(F.col("options")))
    q = rows.select(options.alias("o"))
    free = Q.free_positions(F.lit("choice"), F.col("o"))
    key = Q.prior_key(Q.signature(F.lit("choice"), F.col("o")), free)
    return q.groupBy(key.alias("prior_key"), Q.idk_key(F.col("o")).alias("idk_key")).agg(F.count(F.lit(1)).alias("n"))


_PROMPT = """'State:' || chr(10) || question || chr(10) || chr(10) || 'Question:' || chr(10) || 'Which option correctly answers the question?' || chr(10) || chr(10) ||
  'Options:' || chr(10) || array_to_string(list_transform(options, lambda o, i: chr((64 + i)::INTEGER) || ') ' || chr((64 + i)::INTEGER) || ': ' || o), chr(10)) || chr(10) || chr(10) || 'Respond with the letter only.'"""


@query(
    "rendered_prompts",
    f"SELECT question_id, {_PROMPT} AS prompt, 'Answer:' AS prefill FROM mcq_rows", ("mcq_rows",),
)
def rendered_prompts(spark, sf):
    """Prompt text of every question, state first."""
    rows = D.mcq_rows(spark, sf)
    messages = Q.render_prompt(
        F.col("question"), F.lit("choice"), F.lit(Q.QUESTION_TEXT), Q.lettered_options(F.col("options")), F.lit("letters")
    )
    return rows.withColumn("m", messages).select(
        "question_id", F.get("m", F.lit(0))["content"].alias("prompt"), F.get("m", F.lit(1))["content"].alias("prefill")
    )


@query(
    "rendered_structured_prompts",
    """WITH o AS (SELECT o_orderkey, o_orderpriority, o_comment, o_totalprice::DOUBLE AS price, o_shippriority, list(l_partkey ORDER BY l_linenumber, l_partkey) FILTER (WHERE l_linenumber IS NOT NULL) AS parts
      FROM (SELECT o_orderkey, o_orderpriority, coalesce(o_orderstatus, '') || ' "quoted" \\ ' || chr(9) || o_clerk AS o_comment, o_totalprice, o_orderkey % 3 AS o_shippriority, o_clerk FROM orders_) LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY ALL),
    t AS (SELECT *, '{' || chr(10) || '  "priority": "' || o_orderpriority || '",' || chr(10) || '  "note": "' || replace(replace(replace(o_comment, chr(92), chr(92) || chr(92)), '"', chr(92) || '"'), chr(9), chr(92) || 't') || '",' || chr(10) ||
      '  "share": ' || CASE o_shippriority WHEN 0 THEN '0.25' WHEN 1 THEN '1e-05' ELSE '2.0' END || ',' || chr(10) || '  "open": ' || CASE WHEN o_shippriority = 0 THEN 'true' ELSE 'false' END || ',' || chr(10) ||
      '  "empty": null,' || chr(10) || '  "parts": ' || CASE WHEN parts IS NULL THEN '[]' ELSE '[' || chr(10) || array_to_string(list_transform(parts, lambda p: '    {' || chr(10) || '      "part": ' || p || chr(10) || '    }'), ',' || chr(10)) || chr(10) || '  ]' END || chr(10) || '}' AS state FROM o)
    SELECT o_orderkey::VARCHAR AS item_id, 'State:' || chr(10) || state || chr(10) || chr(10) || 'Question:' || chr(10) || '[' || chr(10) || '  "How urgent?",' || chr(10) || '  "Answer briefly."' || chr(10) || ']' || chr(10) || chr(10) ||
      'Levels:' || chr(10) || '0) low' || chr(10) || '1) high' || chr(10) || chr(10) || 'Respond with the digit only.' AS prompt FROM t""".replace("orders_", "(SELECT o_orderkey, o_orderpriority, o_orderstatus, o_totalprice, 'clerk ' || o_custkey AS o_clerk FROM orders)"),
)
def rendered_structured_prompts(spark, sf):
    """Prompts about objects with nested lists, and with a list as instructions: written as JSON."""
    orders = D.table(spark, sf, "orders")
    lines = D.table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.sort_array(F.collect_list(F.struct("l_linenumber", "l_partkey"))).alias("lines"))
    kind = F.col("o_orderkey") % 3
    state = F.struct(
        F.col("o_orderpriority").alias("priority"),
        F.concat(F.coalesce("o_orderstatus", F.lit("")), F.lit(' "quoted" \\ \tclerk '), F.col("o_custkey").cast("string")).alias("note"),
        F.when(kind == 0, 0.25).when(kind == 1, 1e-05).otherwise(2.0).alias("share"), (kind == 0).alias("open"), F.lit(None).cast("string").alias("empty"),
        F.coalesce(F.transform("lines", lambda x: F.struct(x["l_partkey"].alias("part"))), F.expr("cast(array() as array<struct<part: bigint>>)")).alias("parts"),
    )
    rows = orders.join(lines, F.col("o_orderkey") == F.col("l_orderkey"), "left").select(F.col("o_orderkey").cast("string").alias("item_id"), state.alias("state"))
    asked = F.array(F.lit("How urgent?"), F.lit("Answer briefly."))
    rows = rows.withColumn("asked", asked)
    messages = Q.render_prompt(
        Q.render_value(F.col("state"), rows.schema["state"].dataType), F.lit("score"), Q.render_value(F.col("asked"), rows.schema["asked"].dataType),
        Q.level_options(F.array(F.lit("low"), F.lit("high"))), F.lit("digits"),
    )
    return rows.select("item_id", F.get(messages, F.lit(0))["content"].alias("prompt"))


@query(
    "rendered_level_prompts",
    f"""SELECT o_orderkey::VARCHAR AS item_id, 'Read the state in the next message, then answer.' || chr(10) || chr(10) || 'Question:' || chr(10) || 'How urgent?' || chr(10) || chr(10) || 'Levels:' || chr(10) ||
      '0) low' || chr(10) || '1) high' || chr(10) || chr(10) || 'Respond with the digit only.' AS system, 'State:' || chr(10) || o_orderpriority AS user FROM orders""",
)
def rendered_level_prompts(spark, sf):
    """Prompts of an ordinal question, question first, without a prefill."""
    o = D.table(spark, sf, "orders")
    options = Q.level_options(F.array(F.lit("low"), F.lit("high")))
    messages = Q.render_prompt(
        F.col("o_orderpriority"), F.lit("score"), F.lit("How urgent?"), options, F.lit("digits"), "question_first", False
    )
    return o.withColumn("m", messages).select(
        F.col("o_orderkey").cast("string").alias("item_id"), F.get("m", F.lit(0))["content"].alias("system"),
        F.get("m", F.lit(1))["content"].alias("user"),
    )


@query(
    "label_surfaces",
    f"""SELECT request_id, label, {n('count(*)', 'n')} FROM token_topk JOIN (
      SELECT chr((65 + i)::INTEGER) AS label, unnest([chr((65 + i)::INTEGER), ' ' || chr((65 + i)::INTEGER)]) AS surface FROM range(0, 10) t(i)) ON token = surface GROUP BY 1, 2""",
    ("token_topk",),
)
def label_surfaces(spark, sf):
    """Listed tokens that are a surface of a label."""
    labels = label_dimension(spark, "letters", 10)
    return D.token_topk(spark, sf).join(F.broadcast(labels), F.col("token") == F.col("surface")).groupBy("request_id", "label").agg(
        F.count(F.lit(1)).alias("n")
    )


@query(
    "label_capacity",
    f"""SELECT CASE qtype WHEN 'choice' THEN 'letters' WHEN 'score' THEN 'digits' ELSE 'yes_no' END AS scheme, {n('len(keys)', 'n_labels')}, {n('CASE qtype WHEN $$choice$$ THEN 21 ELSE 11 END', 'n_first_tokens')}, len(keys) * 2 <= 11 AS fits, {n('count(*)', 'n_questions')}
    FROM all_preds GROUP BY qtype, len(keys)""".replace("$$", "'"),
    ("all_preds",),
)
def label_capacity(spark, sf):
    """Questions per label scheme, the first tokens a constraint over its surfaces allows, and
    whether all its surfaces fit a top-11 list."""
    labels = label_dimension(spark, "letters", 10).unionByName(label_dimension(spark, "digits", 5)).unionByName(label_dimension(spark, "yes_no", 2))
    asked = D.all_preds(spark, sf).groupBy(Q.scheme_for(F.col("qtype"), F.size("keys")).alias("scheme")).agg(F.count(F.lit(1)).alias("n_questions"))
    return asked.join(capacity(labels, 11), "scheme").select("scheme", "n_labels", "n_first_tokens", "fits", "n_questions")


@query(
    "request_fan_in",
    f"""SELECT conv_id::VARCHAR AS request_id, {n('count(*)', 'n_questions')}, {n('sum(length(text))', 'input_tokens')}, string_agg(turn || ':' || role, ',' ORDER BY turn) AS answers FROM conversations GROUP BY 1""",
)
def request_fan_in(spark, sf):
    """Answers of requests that were fanned out to one row per question, gathered again: the turns'
    labels only, their texts stay where they are."""
    asked = D.table(spark, sf, "conversations").select("conv_id", "turn", "role", F.length("text").cast("bigint").alias("tokens"))
    return asked.groupBy(F.col("conv_id").cast("string").alias("request_id")).agg(
        F.count(F.lit(1)).alias("n_questions"), F.sum("tokens").alias("input_tokens"),
        F.array_join(
            F.transform(F.sort_array(F.collect_list(F.struct("turn", "role"))), lambda x: F.concat(x["turn"].cast("string"), F.lit(":"), x["role"])), ","
        ).alias("answers"),
    )


# --- splits and samples ------------------------------------------------------------------------------


def split_items(spark, sf):
    """Line items as a benchmark of unique questions with strata."""
    return D.noul_preds(spark, sf).select("benchmark", F.col("item_id").alias("question_id"), "stratum")


_HALVES = f"""SELECT benchmark, question_id, stratum, place, CASE WHEN place % 2 = 1 THEN 'select' ELSE 'holdout' END AS half FROM (
  SELECT benchmark, item_id AS question_id, stratum, row_number() OVER (PARTITION BY benchmark ORDER BY stratum, {sha("'0'", 'benchmark', 'item_id')}, item_id) AS place FROM noul_preds)"""


@query("split_halves", f"SELECT benchmark, question_id, stratum, half FROM ({_HALVES})", ("noul_preds",))
def split_halves(spark, sf):
    return P.split_halves(split_items(spark, sf)).select("benchmark", "question_id", "stratum", "half")


@query(
    "screen_split",
    f"""WITH sel AS (SELECT * FROM ({_HALVES}) WHERE half = 'select'),
    c AS (SELECT benchmark, stratum, count(*) AS n FROM sel GROUP BY 1, 2),
    t AS (SELECT *, sum(n) OVER (PARTITION BY benchmark)::BIGINT AS total FROM c),
    s AS (SELECT *, n * 301 // total AS f, n * 301 % total AS rest FROM t),
    q AS (SELECT *, f + (row_number() OVER (PARTITION BY benchmark ORDER BY -rest, {sha("'0'", 'benchmark', 'stratum')}, stratum) <= 301 - sum(f) OVER (PARTITION BY benchmark))::INTEGER AS quota FROM s),
    p AS (SELECT benchmark, question_id, stratum, row_number() OVER (PARTITION BY benchmark, stratum ORDER BY {sha("'0'", 'benchmark', 'question_id')}, question_id) AS place FROM sel)
    SELECT benchmark, question_id, stratum FROM p JOIN q USING (benchmark, stratum) WHERE place <= CASE WHEN total <= 301 THEN n ELSE quota END""",
    ("noul_preds",),
)
def screen_split(spark, sf):
    return P.screen_split(split_items(spark, sf), 301).select("benchmark", "question_id", "stratum")


@query(
    "fold_assignment",
    f"""SELECT benchmark, question_id, stratum, {n('(row_number() OVER (PARTITION BY benchmark ORDER BY stratum, ' + sha("'0'", 'benchmark', 'question_id') + ') - 1) % 5', 'fold')} FROM (
      SELECT DISTINCT benchmark, question_id, stratum FROM noul_preds)""",
    ("noul_preds",),
)
def fold_assignment(spark, sf):
    return C.assign_folds(D.noul_preds(spark, sf))


@query(
    "spanning_questions",
    "SELECT benchmark, question_id, min(stratum) AS first_stratum, max(stratum) AS last_stratum FROM (SELECT benchmark, question_id, (item_id::BIGINT % 3)::VARCHAR AS stratum FROM preds) GROUP BY 1, 2 HAVING count(DISTINCT stratum) > 1",
    ("preds",),
)
def spanning_questions(spark, sf):
    p = D.preds(spark, sf).withColumn("stratum", (F.col("item_id").cast("bigint") % 3).cast("string"))
    return C.spanning_questions(p)


@query(
    "capped_sample",
    f"""SELECT priority, o_orderkey FROM (SELECT o_orderpriority AS priority, o_orderkey, row_number() OVER (PARTITION BY o_orderpriority ORDER BY {sha("'0'", 'o_orderkey::VARCHAR')}, o_orderkey) AS k FROM orders) WHERE k <= 100""",
)
def capped_sample(spark, sf):
    """A hundred orders per priority, those with the smallest hash."""
    o = D.table(spark, sf, "orders").select(F.col("o_orderpriority").alias("priority"), "o_orderkey")
    return P.capped_sample(o, ["priority"], "o_orderkey", 100)


@query(
    "estimation_share",
    f"""SELECT item_id FROM noul_preds WHERE ('0x' || substr({sha("'0'", 'item_id')}, 1, 13))::BIGINT::DOUBLE / 4503599627370496 < 0.05""",
    ("noul_preds",),
)
def estimation_share(spark, sf):
    return P.fraction_by_hash(D.noul_preds(spark, sf), 0.05, F.col("item_id")).select("item_id")


@query(
    "exact_fraction",
    f"""SELECT item_id FROM (SELECT item_id, row_number() OVER (ORDER BY {sha("'0'", 'item_id')}, item_id) AS k, count(*) OVER () AS n FROM noul_preds) WHERE k <= ceil(0.013 * n)""",
    ("noul_preds",),
)
def exact_fraction(spark, sf):
    return P.fraction_exact(D.noul_preds(spark, sf).select("item_id"), 0.013, "item_id")


@query(
    "question_strata",
    f"""SELECT question_id, stratum, {n('count(*)', 'n')} FROM (SELECT coalesce(CASE WHEN doc_id % 2 = 0 THEN (doc_id // 4)::VARCHAR END, 'd' || doc_id) AS question_id,
      coalesce(CASE WHEN doc_id % 3 = 0 THEN lang END, CASE WHEN doc_id % 3 = 1 THEN source END, '') AS stratum FROM documents) GROUP BY 1, 2""",
)
def question_strata(spark, sf):
    """Question ids and strata of items whose metadata may lack either."""
    i = F.col("doc_id")
    qid = P.question_id(F.when(i % 2 == 0, F.floor(i / 4).cast("string")), F.concat(F.lit("d"), i.cast("string")))
    group = P.stratum(F.when(i % 3 == 0, F.col("lang")), F.when(i % 3 == 1, F.col("source")))
    return D.table(spark, sf, "documents").groupBy(qid.alias("question_id"), group.alias("stratum")).agg(F.count(F.lit(1)).alias("n"))


@query("first_items", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_orderkey LIMIT 50")
def first_items(spark, sf):
    return P.first_n(D.table(spark, sf, "orders").select("o_orderkey", "o_totalprice"), ["o_orderkey"], 50)


@query(
    "round_robin_pick",
    f"SELECT grp, o_orderkey, {n('turn', 'turn')} FROM (SELECT o_orderpriority AS grp, o_orderkey, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_orderkey) AS turn FROM orders) ORDER BY turn, grp LIMIT 23",
)
def round_robin_pick(spark, sf):
    o = D.table(spark, sf, "orders").select(F.col("o_orderpriority").alias("grp"), "o_orderkey")
    return P.round_robin(o, "grp", ["o_orderkey"], 23)
