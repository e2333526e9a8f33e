"""SimHash near-duplicates by multi-index hashing.

Two 64-bit fingerprints that differ in at most 3 bits agree in one half up to one bit. Every
distinct fingerprint is thus filed under both halves and looked up under all values within one bit
of each half (a Hamming ball of 33 values); what is found is verified over all 64 bits. Equal
fingerprints are one entry, and one entry has at most 43,744 others within 3 bits, so copies never
multiply into pairs.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plumbline.llm.common import components, map_texts, narrow, schema_of
from plumbline.session import broadcast_if_small, checkpoint

SEED = 42
CROWD, PREFIX = 2_000, 16
"""Fingerprints that may share a half before they are filed on by so many bits of the other."""
SHINGLES = 1 << 16
"""Shingles whose bits are counted together."""


def fingerprint(text: str, width: int = 3) -> int:
    """64-bit fingerprint (as a signed integer) of the word shingles of ``text``."""
    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    if len(words) < width:
        shingles = iter([b" ".join(words)])
        total = 1
    else:
        shingles = map(b" ".join, zip(*[words[i:] for i in range(width)]))
        total = len(words) - width + 1
    ones = np.zeros(64, np.int64)
    digest = xxhash.xxh64_digest
    for start in range(0, total, SHINGLES):
        n = min(SHINGLES, total - start)
        block = np.frombuffer(b"".join([digest(next(shingles), SEED) for _ in range(n)]), np.uint8)
        ones += np.unpackbits(block.reshape(n, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > total).tobytes(), "big", signed=True)


def fingerprints(df: DataFrame, key: str = "doc_id", text: str = "text", width: int = 3) -> DataFrame:
    """key, fp (bigint) of every row of ``df``; words are runs of other than ASCII white space, A-Z
    lower-cased. NULL texts count as empty."""
    return map_texts(narrow(df, key, text), lambda keys, texts: [keys, [fingerprint(t, width) for t in texts]], schema_of("key bigint, fp bigint"))


def links(distinct: DataFrame, radius: int = 3) -> DataFrame:
    """(u, v), u > v: pairs of the distinct fingerprints ``fp`` that differ in 1 to ``radius`` bits
    (at most 3)."""
    if not 0 <= radius <= 3:
        raise ValueError("two halves probed within one bit find up to 3 differing bits")
    low, high = F.col("fp").bitwiseAND(F.lit(0xFFFFFFFF)), F.shiftrightunsigned("fp", 32)
    halves = F.array(*[F.struct(F.lit(h).alias("half"), v.alias("value"), o.alias("rest")) for h, v, o in ((0, low, high), (1, high, low))])
    filed = distinct.select("fp", F.explode(halves).alias("at")).select("fp", "at.half", "at.value", "at.rest")
    flips = F.array(F.lit(0).cast("bigint"), *[F.lit(1 << b).cast("bigint") for b in range(32)])
    near = F.bit_count(F.col("u").bitwiseXOR(F.col("v"))) <= radius
    # Halves that very many fingerprints share are filed on by the first bits of the other half: two
    # fingerprints within the radius differ there in 3 bits at most, so a ball of prefixes is probed.
    crowded = checkpoint(filed.groupBy("half", "value").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > CROWD).select("half", "value"))
    some = not crowded.isEmpty()

    def found(filed: DataFrame, keys: list[str], probes: DataFrame) -> DataFrame:
        # Spark's estimate leaves out that exploding multiplies rows: without the hint it may collect all
        # probes on the driver to broadcast them.
        return probes.join(filed.select(F.col("fp").alias("v"), *keys).hint("merge"), keys).where((F.col("u") > F.col("v")) & near).select("u", "v")

    keys = ["half", "value"]
    probes = filed.select(F.col("fp").alias("u"), "half", "rest", F.explode(flips).alias("flip"), "value")
    probes = probes.withColumn("value", F.col("value").bitwiseXOR(F.col("flip")))
    if not some:
        return found(filed, keys, probes).distinct()
    crowded = broadcast_if_small(crowded)
    prefix = lambda rest: F.shiftrightunsigned(rest, 32 - PREFIX)
    masks = F.array(*[F.lit(sum(1 << b for b in bits)).cast("bigint") for k in range(radius + 1) for bits in combinations(range(PREFIX), k)])
    calm = found(filed.join(crowded, keys, "left_anti"), keys, probes.join(crowded, keys, "left_anti"))
    hot = filed.join(crowded, keys, "left_semi").withColumn("prefix", prefix(F.col("rest")))
    hot_probes = probes.join(crowded, keys, "left_semi").withColumn("mask", F.explode(masks))
    # Flipping a bit of this half leaves fewer to differ in the other one.
    hot_probes = hot_probes.where(F.bit_count("mask") + F.bit_count("flip") <= radius).withColumn("prefix", prefix(F.col("rest")).bitwiseXOR(F.col("mask")))
    return calm.unionByName(found(hot, [*keys, "prefix"], hot_probes)).distinct()


def classes(marked: DataFrame, radius: int = 3) -> DataFrame:
    """(fp, root) for fingerprints that link to another: root is the smallest linked fingerprint."""
    return components(links(marked.select("fp").distinct(), radius)).withColumnRenamed("node", "fp")


def near_duplicates(df: DataFrame, key: str = "doc_id", text: str = "text", width: int = 3, radius: int = 3) -> DataFrame:
    """``key``, fingerprint (16 hex digits) and component_id of every row: the smallest key that
    links of at most ``radius`` differing bits reach.

    Rows with equal fingerprints (equal texts among them, and all texts without words, whose
    fingerprint is zero) are linked. NULL keys are no component's smallest unless it has no other
    (then NULL); repeated rows each give a row; an empty table gives an empty one; further columns
    are left out.
    """
    marked = checkpoint(fingerprints(df, key, text, width))
    rooted = checkpoint(
        marked.groupBy("fp").agg(F.min("key").alias("least")).join(classes(marked, radius), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    )
    least = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    named = rooted.join(least, "root").select("fp", "component_id")
    return marked.join(named, "fp").select(F.col("key").alias(key), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = 3, radius: int = 3) -> DataFrame:
    """``docs`` with one row of each class of near-duplicates: the smallest key (NULL last), ties by
    a hash of the row; of rows equal throughout, one stays. All columns are kept."""
    mark = "_row"
    while any(c.startswith(mark) for c in docs.columns):
        mark += "_"
    plain = [f"`{f.name}`" for f in docs.schema if f.dataType.typeName() not in ("map", "variant")]
    marked_docs = docs.withColumn(mark, F.xxhash64(*plain))
    held = marked_docs.select(F.col(f"`{key}`").cast("bigint").alias("key"), mark, F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias("text"))

    def work(rows: list, texts: list[str]) -> list:
        return [[r["key"] for r in rows], [r["row"] for r in rows], [fingerprint(t, width) for t in texts]]

    pairs = held.select(F.struct("key", F.col(mark).alias("row")).alias("key"), "text")
    marked = checkpoint(map_texts(pairs, work, schema_of("key bigint, row bigint, fp bigint")))
    order = F.struct(F.col("key").isNull().alias("late"), "key", "row")
    best = marked.groupBy("fp").agg(F.min(order).alias("best")).join(classes(marked, radius), "fp", "left")
    kept = best.groupBy(F.coalesce("root", "fp").alias("root")).agg(F.min("best").alias("best"))
    kept = kept.select(F.col("best.key").alias(mark + "key"), F.col("best.row").alias(mark + "same"))
    same = (F.col(mark) == F.col(mark + "same")) & F.col(f"`{key}`").cast("bigint").eqNullSafe(F.col(mark + "key"))
    chosen = marked_docs.join(kept, same, "left_semi")
    first = F.row_number().over(Window.partitionBy(mark, f"`{key}`").orderBy(F.lit(1)))
    return chosen.withColumn(mark + "n", first).where(F.col(mark + "n") == 1).drop(mark, mark + "n")
