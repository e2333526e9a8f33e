"""Document fingerprints: invertible Bloom lookup sketches of paragraph digests.

A text is cut into paragraphs (lines, and the sentences and columns within), each with a 64-bit
digest. A sketch has three tables; a digest falls into one cell of each, and a cell holds how many
digests it has, their XOR and the XOR of their check values. Subtracting two sketches cancels what
the texts share; cells left with one digest give it away, and taking it out of its other cells
(peeling) frees the next, until the digests that differ are known. When peeling gets stuck the
pair is sketched four times as large, again and again until it peels. Long texts are sketched in shards of about 48 digests, so the
work on a text grows with its length. Cells are grouped sums over exploded digests, peeling works
on one shard's array of cells; everything is built-in column functions.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


PARAGRAPH_END = "\n|(?<=[.!?;:|])\\s"
BASE = 8
"""Cells in each of the three tables of the published fingerprint."""
SHARD = 48
"""Digests of a text in a shard at most, on average."""
BUCKET_ROWS, MOST_CUTS, MOST_PARTS = 500, 4096, 16
_STEPS = [1 << k for k in range(30, -1, -1)]


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with the value worked out once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def digests(text: Column) -> Column:
    """Sorted digests of the paragraphs of ``text``; the n-th repeat of a paragraph has a digest of
    its own. An empty text has one empty paragraph."""
    hashed = F.array_sort(F.transform(F.split(text, PARAGRAPH_END), lambda p: F.xxhash64(p)))

    def numbered(s: Column) -> Column:
        def first_of_run(x: Column, i: Column) -> Column:
            back = lambda at, step: F.when((at >= step) & (F.get(s, at - step) == x), at - step).otherwise(at)
            return F.aggregate(F.array(*[F.lit(k) for k in _STEPS]), i, back)

        repeat = lambda x, i: F.when((i > 0) & (F.get(s, i - 1) == x), F.xxhash64(x, i - first_of_run(x, i))).otherwise(x)
        return F.array_sort(F.transform(s, repeat))

    return let(hashed, numbered)


def places(x: Column, size: Column) -> list[Column]:
    """The cell of a digest in each of the three tables of ``size`` (a power of two) cells."""
    mask = size - 1
    return [F.shiftrightunsigned(x, 18 * t).bitwiseAND(mask) + size * t for t in range(3)]


def base_sketch(s: Column) -> Column:
    """Cells (n, x) of the published fingerprint, in order."""

    def cell(t: int, j: int) -> Column:
        held = F.filter(s, lambda x: F.shiftrightunsigned(x, 18 * t).bitwiseAND(F.lit(BASE - 1).cast("bigint")) == F.lit(j).cast("bigint"))
        xor = lambda f: F.aggregate(f, F.lit(0).cast("bigint"), lambda a, x: a.bitwiseXOR(x))
        return let(held, lambda f: F.struct(F.size(f).alias("n"), xor(f).alias("x")))

    return F.array(*[cell(t, j) for t in range(3) for j in range(BASE)])


def merged(entries: Column) -> Column:
    """Entries (c, n, x, k) summed up to one for each cell c, in order of c."""
    low = (1 << 32) - 1

    def runs(v: Column) -> Column:
        e, s = v["e"], v["s"]  # s: cell and place in e of each entry, sorted
        begins = F.filter(F.transform(s, lambda _, i: i), lambda i: (i == 0) | (F.shiftright(F.get(s, i), 32) != F.shiftright(F.get(s, i - 1), 32)))
        entry = lambda i: F.get(e, F.get(s, i).bitwiseAND(F.lit(low)).cast("int"))
        both = lambda u, w: F.struct(w["c"].alias("c"), (u["n"] + w["n"]).alias("n"), u["x"].bitwiseXOR(w["x"]).alias("x"), u["k"].bitwiseXOR(w["k"]).alias("k"))

        def run(at: Column, end: Column) -> Column:
            first = entry(at)
            more = lambda z: F.aggregate(F.transform(F.sequence(at + 1, z - 1), entry), first, both)
            return let(end, lambda z: F.when(z == at + 1, first).otherwise(more(z)))

        return let(begins, lambda r: F.transform(r, lambda at, i: run(at, F.coalesce(F.get(r, i + 1), F.size(s)))))

    keyed = lambda e: F.sort_array(F.transform(e, lambda c, i: F.shiftleft(c["c"], 32) + i))
    return let(let(entries, lambda e: F.struct(e.alias("e"), keyed(e).alias("s"))), runs)


def entries(s: Column, n: int, size: Column) -> Column:
    """The three entries (c, n, x, k) of each digest in ``s``."""
    own = lambda x: F.array(*[F.struct(c.alias("c"), F.lit(n).alias("n"), x.alias("x"), F.xxhash64(x).alias("k")) for c in places(x, size)])
    return F.flatten(F.transform(s, own))


def filled(cells: Column) -> Column:
    return F.filter(cells, lambda c: (c["n"] != 0) | (c["x"] != 0) | (c["k"] != 0))


def peel(cells: Column, size: Column) -> Column:
    """How many digests the cells (c, n, x, k: none blank) of a difference of sketches give back, or
    NULL where it does not come apart whole. Each round takes out all that stand alone; a round that
    finds none ends it."""

    def round_(state: Column, _: Column) -> Column:
        alone = F.filter(state["cells"], lambda c: (F.abs(c["n"]) == 1) & (F.xxhash64(c["x"]) == c["k"]))
        named = lambda f, n: F.array_distinct(F.transform(F.filter(f, lambda c: c["n"] == n), lambda c: c["x"]))

        def taken(f: Column) -> Column:
            left = filled(merged(F.concat(state["cells"], entries(f["more"], -1, size), entries(f["less"], 1, size))))
            return F.struct(left.alias("cells"), (state["found"] + F.size(f["more"]) + F.size(f["less"])).alias("found"), F.lit(True).alias("on"))

        stop = F.struct(state["cells"].alias("cells"), state["found"].alias("found"), F.lit(False).alias("on"))
        both = let(alone, lambda f: F.struct(named(f, 1).alias("more"), named(f, -1).alias("less")))
        return F.when(~state["on"], state).otherwise(let(both, lambda f: F.when(F.size(f["more"]) + F.size(f["less"]) > 0, taken(f)).otherwise(stop)))

    start = F.struct(cells.alias("cells"), F.lit(0).alias("found"), F.lit(True).alias("on"))
    return let(F.aggregate(F.sequence(F.lit(1), F.lit(40)), start, round_), lambda s: F.when(F.size(s["cells"]) == 0, s["found"]))


def _power_of_two(n: Column) -> Column:
    """The smallest power of two of at least ``n``."""
    return F.pow(F.lit(2.0), F.ceil(F.log2(F.greatest(n.cast("double"), F.lit(1.0))))).cast("bigint")


def bound(df: DataFrame, **columns: Column) -> DataFrame:
    """``df`` with further columns, worked out once each: a generator of one row keeps them from
    being folded into the (per element) functions that use them."""
    held = df.withColumn("_bound", F.explode(F.array(F.struct(*[c.alias(n) for n, c in columns.items()]))))
    return held.select(*df.columns, *[F.col("_bound")[n].alias(n) for n in columns])


GROWN, MOST_CELLS = 4, 1 << 18
"""How many times larger a pair of shards is sketched each time peeling got stuck, and the cells of
a table that all bits of a digest tell apart."""
_GROWTHS = 9


def difference(a: Column, b: Column, size: Column) -> Column:
    """Cells (c, n, x, k: none blank) of the sketch of ``a`` less that of ``b``, for one pair."""
    return filled(merged(F.concat(entries(a, 1, size), entries(b, -1, size))))


def shard_bits(n: Column) -> Column:
    """A text of ``n`` digests has two to this power shards."""
    return F.ceil(F.log2(F.greatest(n / SHARD, F.lit(1.0)))).cast("int")


def shard_of(x: Column, bits: Column) -> Column:
    """The shard of a digest among ``2 ** bits``: its first bits, so a shard is a range of digests."""
    return F.when(bits == 0, F.lit(0).cast("bigint")).otherwise(F.call_function("shiftright", x, 64 - bits))


def held_by(s: Column, shard: Column, bits: Column) -> Column:
    """The digests of a shard, found in the sorted ``s`` by halving."""
    below = lambda v: lambda at, step: F.when((at + step <= F.size(s)) & (shard_of(F.get(s, at + step - 1), bits) < v), at + step).otherwise(at)
    first = lambda v: F.aggregate(F.array(*[F.lit(k) for k in _STEPS]), F.lit(0), below(v))
    within = lambda r: F.transform(F.sequence(r["lo"], r["hi"] - 1), lambda i: F.get(s, i))
    return let(F.struct(first(shard).alias("lo"), first(shard + 1).alias("hi")), lambda r: F.when(r["hi"] > r["lo"], within(r)).otherwise(F.array().cast("array<bigint>")))


def peeled_larger(a: Column, b: Column, size: Column) -> Column:
    """How many digests differ between ``a`` and ``b``, whose sketches of ``size`` cells a table got
    stuck: sketched ever larger until they peel. Digests that no size tells apart (all three places of
    two of them are the same) would never peel; where the largest sketch is stuck too, the digests
    themselves are compared."""

    def larger(state: Column, _: Column) -> Column:
        size = F.least(state["m"] * GROWN, F.lit(MOST_CELLS).cast("bigint"))
        return F.when(state["d"].isNotNull(), state).otherwise(let(size, lambda m: F.struct(m.alias("m"), peel(difference(a, b, m), m).alias("d"))))

    start = F.struct(size.alias("m"), F.lit(None).cast("int").alias("d"))
    exact = F.size(F.array_except(a, b)) + F.size(F.array_except(b, a))
    return F.aggregate(F.sequence(F.lit(1), F.lit(_GROWTHS)), start, larger, lambda s: F.coalesce(s["d"], exact))


def compared(lines: DataFrame, payload: list[str]) -> DataFrame:
    """``payload`` with near_edited and near_next: the likeness of the digests h to eh and to nh of
    each row of ``lines``, which are dealt by ``b``.

    Sketches of both pairs are taken by one grouping over exploded digests (sign 1 for the first
    text, -1 for the second, which is the difference of their sketches) and peeled shard by shard.
    Every shard that gets stuck is sketched larger until it peels. All groups lie within a row's
    bucket, so nothing is shuffled again.
    """
    ne, nn = F.greatest(F.size("h"), F.size("eh")), F.greatest(F.size("h"), F.size("nh"))
    first = lambda n, s: F.when(s == 0, F.greatest(_power_of_two(n), F.lit(4).cast("bigint"))).otherwise(F.lit(64).cast("bigint"))
    held = bound(lines.withColumn("rid", F.monotonically_increasing_id()), se=shard_bits(ne), sn=shard_bits(nn))
    held = bound(held, me=first(ne, F.col("se")), mn=first(nn, F.col("sn")), payload=F.struct(*payload, "h", "eh", "nh", "se", "sn"))
    held = held.withColumns({"p1": F.size("h"), "p2": F.size("h") + F.size("eh"), "p3": F.size("h") * 2 + F.size("eh"), "p4": F.size("h") * 2 + F.size("eh") + F.size("nh")})
    everything = F.concat("h", "eh", "h", "nh", F.array(F.lit(0).cast("bigint")))  # the last entry carries the payload
    rows = held.select("b", "rid", "payload", "se", "sn", "me", "mn", "p1", "p2", "p3", "p4", F.posexplode(everything).alias("pos", "x"))
    pair = F.when(F.col("pos") < F.col("p2"), 0).when(F.col("pos") < F.col("p4"), 1).otherwise(2)
    sign = F.when((F.col("pos") < F.col("p1")) | ((F.col("pos") >= F.col("p2")) & (F.col("pos") < F.col("p3"))), 1).otherwise(-1)
    own_bits, own_size = F.when(pair == 0, F.col("se")).otherwise(F.col("sn")), F.when(pair == 0, F.col("me")).otherwise(F.col("mn"))
    rows = rows.select(
        "b", "rid", "x", pair.alias("pair"), sign.alias("sign"), own_size.alias("m"), shard_of(F.col("x"), own_bits).alias("shard"),
        F.when(pair == 2, F.col("payload")).alias("payload"),
    )
    cells = F.when(F.col("pair") < 2, F.array(*places(F.col("x"), F.col("m")))).otherwise(F.array(F.lit(-1).cast("bigint")))
    each = rows.withColumn("c", F.explode(cells))
    keys = ["b", "rid", "pair", "shard", "m", "payload"]
    summed = each.groupBy(*keys, "c").agg(F.sum("sign").cast("int").alias("n"), F.bit_xor("x").alias("x"), F.bit_xor(F.xxhash64("x")).alias("k"))
    blank = (F.col("n") == 0) & (F.col("x") == 0) & (F.col("k") == 0)
    one = F.when((F.col("pair") < 2) & ~blank, F.struct("c", "n", "x", "k"))
    # One entry per cell of a shard, at most six times its digests.
    shard = summed.groupBy(*keys).agg(F.collect_list(one).alias("cells"))
    shard = bound(shard, d=F.when(F.col("pair") < 2, peel(F.col("cells"), F.col("m"))))
    stuck = (F.col("pair") < 2) & F.col("d").isNull()
    side = lambda k: F.coalesce(F.sum(F.when(F.col("pair") == k, F.col("d"))), F.lit(0))
    joined = shard.groupBy("b", "rid").agg(
        side(0).alias("e"), side(1).alias("n"), F.first("payload", ignorenulls=True).alias("p"),
        F.collect_list(F.when(stuck, F.struct("pair", "shard", "m"))).alias("todo"),
    )

    def again(w: Column) -> Column:
        own = lambda s, count: held_by(s, w["shard"], count)
        count, other = (F.when(w["pair"] == 0, F.col(f"p.{e}")).otherwise(F.col(f"p.{n}")) for e, n in (("se", "sn"), ("eh", "nh")))
        solved = let(count, lambda c: let(own(F.col("p.h"), c), lambda a: let(let(other, lambda o: own(o, c)), lambda b: peeled_larger(a, b, w["m"]))))
        return F.struct(w["pair"].alias("pair"), solved.alias("d"))

    joined = bound(joined, redone=F.transform("todo", again))
    more = lambda k: F.aggregate(F.filter("redone", lambda r: r["pair"] == k), F.lit(0).cast("bigint"), lambda v, r: v + r["d"])
    like = lambda k, d, other: F.greatest(F.lit(0.0), 1.0 - (F.col(d) + more(k)) / (F.size("p.h") + F.size(f"p.{other}")))
    return joined.select(*[F.col("p")[c].alias(c) for c in payload], like(0, "e", "eh").alias("near_edited"), like(1, "n", "nh").alias("near_next"))


def written(cells: Column, count: Column) -> Column:
    """A fingerprint as text: number of paragraphs, then count and XOR of each cell in hex."""
    return F.concat(F.hex(count), F.lit(":"), F.array_join(F.transform(cells, lambda c: F.concat(F.hex(c["n"]), F.lit("."), F.hex(c["x"]))), " "))


def with_next(rows: DataFrame) -> DataFrame:
    """``rows`` (key, text, h) in descending key (NULL last, ties by a hash of the text) with their
    bucket b and next_text and nh, the text and h of the row that follows (for the last, of the first).

    Rows are dealt into buckets of neighbouring keys with about equally many rows; the first row of
    each bucket also goes to the bucket before it, so no window spans more than a bucket. Keys that
    hold several buckets' rows (they are several cuts at once), and rows without a key, are dealt on by
    the hash that orders ties.
    """
    n, late, low, high = rows.agg(F.count(F.lit(1)), F.count_if(F.col("key").isNull()), F.min("key"), F.max("key")).first()
    buckets = max(1, min(MOST_CUTS, -(-n // BUCKET_ROWS)))
    parts = max(1, min(MOST_PARTS, -(-n // (BUCKET_ROWS * buckets))))
    cuts = rows.approxQuantile("key", [k / buckets for k in range(1, buckets)], 0.1 / buckets) if buckets > 1 and low is not None else []
    times = Counter(int(c) for c in cuts)
    several = {c: k * parts for c, k in times.items() if k > 1}
    cuts = sorted(times)
    late_slices = max(1, -(-late * buckets // max(1, n)) * parts)
    width = max([late_slices, *several.values()]) + 1
    bucket = F.lit(0)
    if cuts:
        steps = [1 << k for k in range(len(cuts).bit_length() - 1, -1, -1)]
        held = F.lit(cuts).cast("array<bigint>")
        below = lambda at, step: F.when((at + step <= len(cuts)) & (F.get(held, at + step - 1) <= F.col("key")), at + step).otherwise(at)
        bucket = F.aggregate(F.array(*[F.lit(s) for s in steps]), F.lit(0), below)
    if parts > 1:  # a bucket between two cuts in even steps of the key
        ends = F.lit([low, *cuts, high]).cast("array<double>")
        at = let(bucket, lambda c: F.struct(c.alias("c"), F.get(ends, c).alias("lo"), F.get(ends, c + 1).alias("hi")))
        step = lambda v: F.floor((F.col("key").cast("double") - v["lo"]) / F.greatest(v["hi"] - v["lo"], F.lit(1.0)) * parts)
        bucket = let(at, lambda v: v["c"].cast("bigint") * parts + F.least(F.greatest(step(v), F.lit(0)), F.lit(parts - 1)))
    placed = rows.withColumn("b", F.when(F.col("key").isNull(), F.lit(-1)).otherwise(bucket).cast("bigint")).withColumn("tie", F.xxhash64("text"))
    # Rows of a key that is dealt on follow those of larger keys of their bucket, by their hash.
    slices = F.when(F.col("key").isNull(), F.lit(late_slices))
    if several:
        slices = slices.otherwise(F.try_element_at(F.create_map(*[F.lit(x).cast("bigint") if k % 2 == 0 else F.lit(x) for k, x in enumerate(x for c in several.items() for x in c)]), F.col("key")))
    own = F.shiftright((F.shiftright("tie", 48) + 32768) * slices, 16)
    placed = placed.withColumn("b", F.col("b") * width + F.coalesce(width - 2 - own, F.lit(width - 1)))
    order = F.struct(F.col("key").isNull().alias("late"), F.bitwise_not("key").alias("down"), "tie")
    heads = placed.groupBy("b").agg(F.min(order).alias("head"))  # at most MOST_CUTS * MOST_PARTS + 1 narrow rows
    line = Window.orderBy("b")
    whole = line.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    sent = heads.withColumn("to", F.coalesce(F.lead("b").over(line), F.first("b").over(whole)))
    joined = placed.join(F.broadcast(sent), "b")
    is_head = F.col("head") == order
    copies = F.when(is_head, F.array(F.struct(F.col("b").alias("b"), F.lit(0).alias("ahead")), F.struct(F.col("to").alias("b"), F.lit(1).alias("ahead"))))
    copies = copies.otherwise(F.array(F.struct(F.col("b").alias("b"), F.lit(0).alias("ahead"))))
    dealt = joined.select("key", "text", "h", "tie", F.explode(copies).alias("c")).select("key", "text", "h", "tie", "c.b", "c.ahead")
    # As many partitions as buckets: what a task sums up and peels stays small.
    dealt = dealt.repartition(buckets * parts, "b")
    bucket_order = Window.partitionBy("b").orderBy("ahead", F.col("key").desc_nulls_last(), "tie")
    out = dealt.withColumns({"next_text": F.lead("text").over(bucket_order), "next_h": F.lead("h").over(bucket_order)})
    return out.where(F.col("ahead") == 0).select("b", "key", "text", "h", "next_text", F.col("next_h").alias("nh"))


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key``, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next of
    every row: the edited text has its last third replaced by the start of the next row's text.

    NULL texts are empty (one empty paragraph; two empty texts have likeness 1); NULL keys come last;
    rows with equal keys follow each other by a hash of their texts; a single row is its own next; an
    empty table gives an empty one; further columns are left out.
    """
    rows = docs.select(F.col(f"`{key}`").cast("bigint").alias("key"), F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias("text"))
    paired = with_next(rows.withColumn("h", digests(F.col("text"))))
    third = F.floor(F.length("text") / 3).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), F.length("text") - third), F.substring(F.col("next_text"), F.lit(1), third))
    lines = bound(paired.withColumn("n_chars", F.length("text").cast("bigint")), edited=edited).drop("text", "next_text")
    lines = bound(lines.withColumn("edited_sha256", F.sha2("edited", 256)), eh=digests(F.col("edited"))).drop("edited")
    marks = {"fingerprint": written(base_sketch(F.col("h")), F.size("h")), "edited_fingerprint": written(base_sketch(F.col("eh")), F.size("eh"))}
    payload = ["key", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint"]
    return compared(bound(lines, **marks), payload).withColumnRenamed("key", key)
