"""Datasets as labelled item tables: adapters, user files and a registry of loaders.

An item row: item_id, benchmark, question_id, stratum, qtype, state, instructions, options
ARRAY<STRUCT<key, text>>, gold (key text, level number or true/false as text).
"""

from __future__ import annotations

import os
from collections.abc import Callable, Iterable, Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.functions import questions as Q
from plumbline.functions.hashing import keyed_hash
from plumbline.operators.records import duplicate_ids
from plumbline.sources.readers import SourceError, csv_records, jsonl_records, require_columns

MAX_CLASSES = 255
"""Options of a choice at most."""
QUESTION_TYPES = ("choice", "score", "noul")

# Level names of the ordinal benchmarks: fixed values.
SENTIMENT_LEVELS = ("very negative", "negative", "neutral", "positive", "very positive")
STAR_LEVELS = ("1 star", "2 stars", "3 stars", "4 stars", "5 stars")
SENTIMENT_QUESTION = "What sentiment does this sentence from a movie review express?"
STAR_QUESTION = "How many stars did the reviewer give?"


def make_item(
    df: DataFrame, benchmark: str, *, question_id: Column, state: Column, qtype: str,
    instructions: Column, options: Column, gold: Column, stratum: Column, keep: Sequence[str] = (),
) -> DataFrame:
    """Rows as items named ``<benchmark>:<question_id>``."""
    return df.select(
        F.concat_ws(":", F.lit(benchmark), question_id.cast("string")).alias("item_id"),
        F.lit(benchmark).alias("benchmark"),
        question_id.cast("string").alias("question_id"),
        stratum.cast("string").alias("stratum"),
        F.lit(qtype).alias("qtype"),
        state.alias("state"),
        instructions.cast("string").alias("instructions"),
        options.alias("options"),
        gold.cast("string").alias("gold"),
        *keep,
    )


def multiple_choice(df: DataFrame, benchmark: str, stratum: Column | None = None) -> DataFrame:
    """Rows (question_id, question, options, answer_index[, answer]) as lettered choices. Gold is NULL
    (which :func:`item_violations` reports) where the index is none of an option or the answer's
    letter says otherwise."""
    index = F.col("answer_index")
    gold = F.when((index >= 0) & (index < F.size("options")), Q.letter(index))
    if "answer" in df.columns:
        gold = F.when(F.upper(F.trim("answer")) == gold, gold)
    return make_item(
        df, benchmark, question_id=F.col("question_id"), state=F.col("question"), qtype="choice",
        instructions=F.lit(Q.QUESTION_TEXT), options=Q.lettered_options(F.col("options")), gold=gold,
        stratum=gold if stratum is None else stratum,
    )


def labelled_choice(df: DataFrame, benchmark: str) -> DataFrame:
    """Rows (id, question, choices STRUCT<text, label>, answerKey): option labels may be letters
    or digits; items are keyed by letters either way."""
    place = F.array_position(F.col("choices.label"), F.col("answerKey")).cast("int") - 1
    rows = df.select(
        F.col("id").alias("question_id"), "question", F.col("choices.text").alias("options"),
        place.alias("answer_index"),
    )
    return multiple_choice(rows, benchmark)


def classification(
    df: DataFrame, benchmark: str, text: str, label: str, names: Sequence[str], instructions: str,
    exclude: Sequence[str] = (), row_id: str = "row",
) -> DataFrame:
    """Rows as a choice among class names; rows of excluded classes go, and so do those options. A row
    whose label names no class stays, with NULL gold (which :func:`item_violations` reports)."""
    if len(set(names)) != len(names) or len(names) - len(exclude) > MAX_CLASSES:
        raise ValueError(f"{benchmark}: class names must differ and be at most {MAX_CLASSES}")
    shown = F.array(*[F.lit(n) for n in names if n not in exclude])
    name = F.get(F.array(*[F.lit(n) for n in names]), F.col(label))
    kept = df.withColumn("_name", name).where(F.col("_name").isNull() | ~F.col("_name").isin(list(exclude) or [""]))
    return make_item(
        kept, benchmark, question_id=F.col(row_id), state=F.col(text), qtype="choice",
        instructions=F.lit(instructions), options=Q.named_options(shown), gold=F.col("_name"), stratum=F.col("_name"),
    )


def boolean(df: DataFrame, benchmark: str, question: str, passage: str, answer: str, row_id: str = "row") -> DataFrame:
    """Rows as yes-no questions about a passage."""
    gold = F.col(answer).cast("boolean").cast("string")
    return make_item(
        df, benchmark, question_id=F.col(row_id), state=F.col(passage), qtype="noul",
        instructions=F.concat(F.col(question), F.lit("?")), options=Q.noul_options(), gold=gold,
        stratum=F.when(F.col(answer), "yes").otherwise("no"),
    )


def ordinal(
    df: DataFrame, benchmark: str, text: str, level: str, levels: Sequence[str], instructions: str, row_id: str = "row"
) -> DataFrame:
    """Rows as ordered-level questions."""
    names = F.array(*[F.lit(x) for x in levels])
    return make_item(
        df, benchmark, question_id=F.col(row_id), state=F.col(text), qtype="score",
        instructions=F.lit(instructions), options=Q.level_options(names), gold=F.col(level),
        stratum=F.get(names, F.col(level)),
    )


# --- question banks --------------------------------------------------------------------------------


def question_bank(
    rows: DataFrame, dataset: str, seed: int | str = 0, idk: bool = True, n_permutations: int = 1
) -> DataFrame:
    """Rows (question_id, question, options, gold_index, subject) with each question's options in
    a hashed order of its own, ``n_permutations`` cyclic shifts of it, and "I don't know" last.

    The order is a pure function of (seed, question, option): no row position enters, so a bank
    of any size is one projection. A question with fewer options than ``n_permutations`` is an error
    (:func:`too_short` finds such rows beforehand).
    """
    n = F.size("options")
    hashed = F.array_sort(
        F.transform(
            F.sequence(F.lit(0), n - 1),
            lambda i: F.struct(keyed_hash(seed, F.col("question_id"), i).alias("h"), i.alias("i")),
        )
    )
    base = F.transform(hashed, lambda x: x["i"])
    short = F.raise_error(F.concat(F.lit(f"{dataset}: fewer than {n_permutations} options: "), F.col("question_id")))
    steps = F.sequence(F.lit(0), F.lit(n_permutations - 1))
    shifts = F.explode(F.when(n >= n_permutations, steps).otherwise(short.cast("array<int>")))
    shifted = rows.withColumn("_base", base).withColumn("permutation_id", shifts)
    ordered = shifted.withColumn("option_order", Q.rotate(F.col("_base"), F.col("permutation_id")))
    texts = F.transform("option_order", lambda i: F.get("options", i))
    shown = F.concat(texts, F.array(F.lit(Q.IDK_TEXT))) if idk else texts
    return (
        ordered.withColumn("_shown", Q.lettered_options(shown))
        .select(
            F.concat_ws(":", F.lit(dataset), "question_id", F.col("permutation_id").cast("string")).alias("item_id"),
            F.lit(dataset).alias("benchmark"), "question_id", "permutation_id",
            F.coalesce("subject", F.lit("")).alias("stratum"), F.lit("choice").alias("qtype"),
            F.col("question").alias("state"), Q.bank_instructions(n, idk).alias("instructions"),
            F.col("_shown").alias("options"),
            Q.letter((F.array_position("option_order", F.col("gold_index")) - 1).cast("int")).alias("gold"),
            "option_order", Q.options_sha256(F.col("_shown")).alias("options_sha256"), F.lit(idk).alias("idk"),
        )
    )


def too_short(rows: DataFrame, n_permutations: int) -> DataFrame:
    """Questions that have fewer options than a bank is to have permutations."""
    return rows.where(~F.coalesce(F.size("options") >= n_permutations, F.lit(False)))


def bank_violations(bank: DataFrame) -> DataFrame:
    """Bank items that break a rule, with the rule's name."""
    n = F.size("option_order")
    expected = F.transform(F.sequence(F.lit(0), n - 1 + F.col("idk").cast("int")), lambda i: Q.letter(i))
    rule = (
        F.when(F.col("item_id") != F.concat_ws(":", "benchmark", "question_id", F.col("permutation_id").cast("string")), "item_id")
        .when((n < 2) | (n > Q.MAX_BANK_OPTIONS), "n_options")
        .when(Q.keys_of(F.col("options")) != expected, "keys")
        .when(F.array_sort("option_order") != F.sequence(F.lit(0), n - 1), "permutation")
        .when(F.col("idk") & (F.element_at("options", -1)["text"] != Q.IDK_TEXT), "idk_last")
        .when(~F.array_contains(F.slice(expected, F.lit(1), n), F.col("gold")), "gold")
        .when(Q.options_sha256(F.col("options")) != F.col("options_sha256"), "hash")
    )
    return bank.withColumn("rule", rule).where(F.col("rule").isNotNull())


def item_violations(items: DataFrame) -> DataFrame:
    """Items whose gold does not fit their question."""
    keys = Q.answer_keys(F.col("qtype"), F.col("options"))
    n = F.size("options")
    bad = (
        (F.col("item_id") == "")
        | ~F.array_contains(keys, F.col("gold"))
        | ((F.col("qtype") == "choice") & ((n < 2) | (n > 255)))
        | ((F.col("qtype") == "score") & ((n < 2) | (n > 10)))
    )
    return items.where(F.coalesce(bad, F.lit(True)))


# --- user files ------------------------------------------------------------------------------------

FIELDS = ("state", "gold", "id", "instructions", "options")
"""What a user's columns can stand for. A value is a column's name or an expression (a literal, say)."""
TEXT_FORMATS = {".jsonl": "jsonl", ".ndjson": "jsonl", ".csv": "csv"}


def coerce_gold(qtype: str, value: Column) -> Column:
    """Gold text of a cell: a key, a level number, or true/false from yes/no, 1/0; NULL if none."""
    text = F.trim(value.cast("string"))
    if qtype == "choice":
        return value.cast("string")
    if qtype == "score":
        return F.when(text.rlike(r"^[+-]?\d+$"), text.try_cast("int").cast("string"))
    low = F.lower(text)
    return F.when(low.isin("true", "yes", "1"), "true").when(low.isin("false", "no", "0"), "false")


def options_of(qtype: str, value: Column) -> Column:
    """Options from an ARRAY<STRING>, or from text: a JSON list, or a JSON object of keys."""
    listed = Q.level_options if qtype == "score" else Q.named_options
    texts = F.from_json(value.cast("string"), "array<string>")
    entries = F.transform(F.map_entries(F.from_json(value.cast("string"), "map<string,string>")), lambda e: F.struct(e["key"].alias("key"), e["value"].alias("text")))
    return listed(texts) if qtype == "score" else F.coalesce(listed(texts), entries)


def listed_options(qtype: str, texts: Sequence[str]) -> Column:
    """The same options for every row."""
    values = F.array(*[F.lit(t) for t in texts])
    return Q.level_options(values) if qtype == "score" else Q.named_options(values)


def mapped_items(rows: DataFrame, name: str, qtype: str, fields: Mapping[str, str | Column], keep: Sequence[str] = ()) -> tuple[DataFrame, DataFrame]:
    """(items, rejected) of a user's table by what its columns stand for (:data:`FIELDS`).

    Rejected rows have gold that does not fit, no state, no id, or an id that another row has
    (``problem`` says which). Without an id, rows are named by a hash of their content, so ids do not
    depend on how a table is partitioned; equal rows are numbered (``<hash>``, ``<hash>-2``, ...).
    """
    if qtype not in QUESTION_TYPES:
        raise SourceError(f"{name}: {qtype!r} is no question type; there are {QUESTION_TYPES}")
    needed = {"state", "gold", *(["options"] if qtype != "noul" else [])}
    if not needed <= set(fields) <= set(FIELDS):
        raise SourceError(f"{name}: {qtype} items need {sorted(needed)} and can have {FIELDS}; given are {sorted(fields)}")
    chosen = require_columns(rows, [*[c for c in fields.values() if isinstance(c, str)], *keep], name)
    of = {k: F.col(f"`{v}`") if isinstance(v, str) else v for k, v in fields.items()}
    content = F.substring(F.sha2(F.to_json(F.struct(*[F.col(f"`{c}`") for c in chosen.columns])), 256), 1, 16)
    if "id" not in of:
        # Equal rows need no order among themselves: each is one of their count.
        counted_rows = chosen.withColumn("_content", content).groupBy("_content", *[f"`{c}`" for c in chosen.columns]).agg(F.count(F.lit(1)).alias("_copies"))
        chosen = counted_rows.withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("_copies"))))
        content = F.when(F.col("_copy") == 1, F.col("_content")).otherwise(F.concat_ws("-", "_content", F.col("_copy").cast("string")))
    options = Q.noul_options() if "options" not in fields else options_of(qtype, of["options"]) if isinstance(fields["options"], str) else of["options"]
    items = make_item(
        chosen, name, question_id=F.coalesce(of["id"].cast("string"), F.lit("")) if "id" in of else content,
        state=of["state"].cast("string"), qtype=qtype, instructions=of.get("instructions", F.lit(None)), options=options,
        gold=coerce_gold(qtype, of["gold"]), stratum=F.lit(""), keep=keep,
    )
    repeated = items.groupBy("question_id").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > 1)
    counted = items.join(repeated, "question_id", "left")
    keys = Q.answer_keys(F.col("qtype"), F.col("options"))
    problem = (
        F.when(F.col("question_id") == "", "no id")
        .when(F.col("state").isNull(), "no state")
        .when(~F.coalesce(F.array_contains(keys, F.col("gold")), F.lit(False)), "gold")
        .when(F.col("_n") > 1, "duplicate id")
    )
    judged = counted.select(*items.columns, problem.alias("problem"))
    return judged.where(F.col("problem").isNull()).drop("problem"), judged.where(F.col("problem").isNotNull())


def custom_file(
    spark: SparkSession, name: str, path: str, qtype: str, fields: Mapping[str, str | Column], keep: Sequence[str] = (), format: str | None = None
) -> tuple[DataFrame, DataFrame]:
    """(items, rejected) of a user's JSON-lines or CSV file."""
    kind = format or TEXT_FORMATS.get(os.path.splitext(path)[1].lower())
    read = list(dict.fromkeys([*[c for c in fields.values() if isinstance(c, str)], *keep]))
    required = [fields[f] for f in ("state", "gold") if isinstance(fields.get(f), str)]
    if kind == "csv":
        rows, _ = csv_records(spark, path, read, required[:1])
    elif kind == "jsonl":
        rows, _ = jsonl_records(spark, path, T.StructType([T.StructField(c, T.StringType()) for c in read]), required)
    else:
        raise SourceError(f"{path}: say whether its format is 'jsonl' or 'csv'")
    return mapped_items(rows, name, qtype, fields, keep)


# --- registry --------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Benchmark:
    name: str
    qtype: str
    loader: Callable[[SparkSession], DataFrame]
    license: str
    splits: Mapping[str, str]
    tags: frozenset[str] = frozenset()


BENCHMARKS: dict[str, Benchmark] = {}


def register_benchmark(
    name: str, *, qtype: str, license: str, splits: Mapping[str, str], tags: Iterable[str] = ()
) -> Callable[[Callable[[SparkSession], DataFrame]], Callable[[SparkSession], DataFrame]]:
    """Register a loader ``spark -> items``."""
    if qtype not in QUESTION_TYPES or not license or not splits:
        raise ValueError(f"{name}: a benchmark needs a question type, a license and split roles")

    def add(loader: Callable[[SparkSession], DataFrame]) -> Callable[[SparkSession], DataFrame]:
        if name in BENCHMARKS:
            raise ValueError(f"benchmark {name!r} is already registered")
        BENCHMARKS[name] = Benchmark(name, qtype, loader, license, dict(splits), frozenset(tags))
        return loader

    return add


def list_benchmarks() -> list[Benchmark]:
    return [BENCHMARKS[name] for name in sorted(BENCHMARKS)]


def load_benchmarks(spark: SparkSession, names: Sequence[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """(items of all named benchmarks, violations): wrong question types and repeated ids."""
    chosen = sorted(BENCHMARKS) if names is None else list(names)
    unknown = [n for n in chosen if n not in BENCHMARKS]
    if unknown:
        raise ValueError(f"unknown benchmarks {unknown}; registered: {sorted(BENCHMARKS)}")
    tables = [BENCHMARKS[n].loader(spark).withColumn("_expected", F.lit(BENCHMARKS[n].qtype)) for n in chosen]
    items = tables[0]
    for t in tables[1:]:
        items = items.unionByName(t, allowMissingColumns=True)
    wrong = items.where(F.col("qtype") != F.col("_expected")).select("item_id", F.lit("question type").alias("problem"))
    repeated = duplicate_ids(items, ["item_id"], "question_id").select("item_id", F.lit("duplicate id").alias("problem"))
    return items.drop("_expected"), wrong.unionByName(repeated)
