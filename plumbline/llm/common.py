"""Helpers shared by the text operators: narrow inputs, Arrow passes over texts, components."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from plumbline.session import checkpoint

CHUNK_CHARS = 1 << 23
"""Characters of text that a Python pass keeps unpacked at once (one longer text is kept alone)."""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def narrow(df: DataFrame, key: str, text: str) -> DataFrame:
    """Only the key and the text (NULL read as empty): further columns, whatever their names, do
    not take part."""
    return df.select(F.col(f"`{key}`").cast("bigint").alias("key"), F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias("text"))


def text_chunks(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[list, list[str]]]:
    """(keys, texts) of the batches, :data:`CHUNK_CHARS` characters at a time."""
    for batch in batches:
        keys, texts = batch.column(0).to_pylist(), batch.column(1)
        at = 0
        while at < len(keys):
            size, held = 0, []
            while at < len(keys) and (not held or size < CHUNK_CHARS):
                held.append(texts[at].as_py())
                size += len(held[-1])
                at += 1
            yield keys[at - len(held) : at], held


BATCH_ROWS = 2_000
"""Rows of an Arrow batch at most: a batch is held several times over on its way through Python."""


def small_batches(df: DataFrame) -> DataFrame:
    """``df``, its session set to Arrow batches of at most :data:`BATCH_ROWS` rows. The setting stays: a
    plan reads it when it runs, which is after this returns."""
    conf, name = df.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(conf.get(name)) <= BATCH_ROWS:
        conf.set(name, str(BATCH_ROWS))
    return df


def hash_sample(rows: DataFrame, bound: int, *columns: str) -> DataFrame:
    """At most ``bound`` rows, those with the smallest hashes of ``columns``. A threshold that about
    twice as many rows meet comes first, so that tasks pass on few."""
    n = rows.count()
    top = 1 << 30
    mix = F.pmod(F.xxhash64(*columns), F.lit(top))
    met = rows.withColumn("_mix", mix)
    if n > 2 * bound:
        met = met.where(F.col("_mix") <= int(top * 2 * bound / n))
    return met.orderBy("_mix", *columns).limit(bound).drop("_mix")


def map_texts(rows: DataFrame, work: Callable[[list, list[str]], list], schema: T.StructType) -> DataFrame:
    """``work(keys, texts)`` over all rows of :func:`narrow`; it returns one list per column."""
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for keys, texts in text_chunks(batches):
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(work(keys, texts), arrow)], schema=arrow)

    return small_batches(rows).mapInArrow(run, schema)


CACHE_CHARS = 1 << 23
"""Characters of the words that a worker remembers, whatever their number (those at hand apart)."""


class RecentWords:
    """What a worker remembers of words: the newest ``limit`` or so, or :data:`CACHE_CHARS` of them, and
    those used since they were put aside; twice that (and the words at hand) at most."""

    def __init__(self, limit: int):
        self.limit, self.chars, self.young, self.old = limit, 0, {}, {}

    def absent(self, words: Iterable[str]) -> list[str]:
        """The words not remembered; those that are move to the newest."""
        if len(self.young) > self.limit or self.chars > CACHE_CHARS:
            self.chars, self.young, self.old = 0, {}, self.young
        out = []
        for w in words:
            if w not in self.young:
                known = self.old.get(w)
                if known is None:
                    out.append(w)
                else:
                    self.young[w] = known
                self.chars += len(w)
        return out


def schema_of(ddl: str) -> T.StructType:
    return T.StructType.fromDDL(ddl)


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.lit(0))).first())


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node of the undirected ``edges`` (u, v: bigint), root the smallest
    node reachable. Alternating large-star and small-star rounds: only minima are aggregated, so
    no neighbour list is ever gathered; each round is checkpointed and the number of rounds grows
    with the logarithm of the component size."""
    now = checkpoint(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct())
    seen = _state(now)
    while True:
        both = now.union(now.select("v", "u"))
        least = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
        large = both.join(least, "u").where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        down = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(down, "u")
        small = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).union(joined.select("u", F.col("m").alias("v")))
        now = checkpoint(small.where("u <> v").distinct())
        state = _state(now)
        if state == seen:
            roots = now.select(F.col("u").alias("node"), F.col("v").alias("root"))
            return roots.union(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
        seen = state
