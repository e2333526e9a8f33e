"""Nearest neighbours by multi-index hashing.

Vectors become 256-bit codes (signs after learned rotations). A search takes in every row whose code
lies within a Hamming radius of the query's; the radius is measured: it takes in 99 of 100 true
neighbours of some rows, found among all rows. The codes are cut into sixteen 16-bit substrings with one
table each. By the pigeonhole principle a code within radius r = 16 a + b lies within a of the query in
one of the first b + 1 substrings or within a - 1 in one of the others, so only those balls are probed
and whole codes verified. Tables are cut into cells by the first bits of their substring, which all
queries share; queries go to the cells that their balls reach. Vectors are fetched for what is left, and
exact cosines decide. Where the balls would reach more than all rows (the vectors are spread evenly, so
neighbours' codes lie far apart), rows are dealt to cells once instead of to sixteen tables; a cell reads
its codes through and ranks what lies within the radius itself, so no pair leaves it but the best.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.llm.common import hash_sample, schema_of, small_batches
from plumbline.session import checkpoint, lookup

PART, PARTS = 64, 4
BITS = PART * PARTS
WIDTH = 16
TABLES = BITS // WIDTH
SAMPLE_ROWS = 4_096
"""Vectors that the rotations are fitted on: those with the smallest hashes."""
MEASURED = 64
"""Rows of the sample whose true neighbours set the radius."""
COVERED = 0.99
"""Share of those neighbours that the radius takes in."""
CELL_ROWS, QUERY_ROWS = 65_536, 65_536
"""Codes and queries, about, that one task holds (fewer of long vectors)."""
CELL_BYTES = 1 << 25
PAIRS_AT_ONCE = 1 << 21
SPARE = 16
"""Of queries with too few rows within the radius, each cell gives so many times k nearest codes."""


@dataclass(frozen=True)
class Coder:
    """Projection of ``dim`` numbers to :data:`BITS` signs."""

    dim: int
    projection: np.ndarray

    def codes(self, unit: np.ndarray) -> np.ndarray:
        """(n, 4) words of 64 bits."""
        return np.packbits(unit @ self.projection > 0, axis=1).view(">u8").astype(np.uint64).reshape(len(unit), PARTS)


def fit_coder(dim: int, sample: np.ndarray, rounds: int = 30, seed: int = 3) -> Coder:
    """Four rotations of 64 directions each, every one turned so that signs lose least (alternating
    least squares from its own start). More than 64 dimensions are first cut to the principal ones (each
    rotation has its own 64 of them, as far as there are), fewer are spread over 64 random directions.
    ``sample``: unit vectors, possibly none."""
    rng = np.random.default_rng(seed)
    parts = []
    axes = np.linalg.svd(sample, full_matrices=False)[2] if dim > PART and len(sample) else np.zeros((0, dim))
    for part in range(PARTS):
        own = axes[part * PART : (part + 1) * PART]
        if dim > PART:
            basis = own.T if len(own) == PART else np.linalg.qr(rng.normal(size=(dim, PART)))[0]
        else:
            basis = np.eye(dim) if dim == PART else rng.normal(size=(dim, PART))
        turn = np.linalg.qr(rng.normal(size=(PART, PART)))[0]
        flat = sample @ basis
        for _ in range(rounds if len(sample) else 0):
            u, _, v = np.linalg.svd(flat.T @ np.where(flat @ turn > 0, 1.0, -1.0))
            turn = u @ v
        parts.append(basis @ turn)
    return Coder(dim, np.hstack(parts))


def apart(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Hamming distances of codes (last axis: words)."""
    return np.bitwise_count(a ^ b).sum(axis=-1, dtype=np.int64)


def substring(codes: np.ndarray, table: int) -> np.ndarray:
    word, place = divmod(table, PART // WIDTH)
    return ((codes[..., word] >> np.uint64(WIDTH * place)) & np.uint64((1 << WIDTH) - 1)).astype(np.uint32)


def ball(radius: int, width: int = WIDTH) -> np.ndarray:
    """All masks of ``width`` bits with at most ``radius`` set."""
    return np.array([sum(1 << b for b in bits) for n in range(radius + 1) for bits in combinations(range(width), n)], np.uint32)


def ball_size(radius: int, width: int = WIDTH) -> int:
    size, term = 0, 1
    for n in range(min(radius, width) + 1):
        size += term
        term = term * (width - n) // (n + 1)
    return size


def reaches(radius: int) -> list[int]:
    """How far to look in each table for codes within ``radius`` (-1: not at all)."""
    whole, rest = divmod(radius, TABLES)
    return [min(WIDTH, whole if t <= rest else whole - 1) for t in range(TABLES)]


def selective(radius: int) -> bool:
    """Do the balls of all tables hold fewer entries than one table, were substrings spread evenly?"""
    return sum(ball_size(r) for r in reaches(radius) if r >= 0) < 1 << WIDTH


class Table:
    """The entries of a cell of one table, filed by substring."""

    def __init__(self, codes: np.ndarray, table: int):
        self.codes, self.table = codes, table
        part = substring(codes, table)
        self.order = np.argsort(part, kind="stable")
        self.keys, starts = np.unique(part[self.order], return_index=True)
        self.starts = np.append(starts, len(codes))

    def within(self, query: np.ndarray, radius: int, balls: dict[int, np.ndarray]) -> np.ndarray:
        """Rows within ``radius`` of the query that no earlier table finds."""
        reach = reaches(radius)
        own = reach[self.table]
        if own < 0 or not len(self.codes):
            return np.zeros(0, np.int64)
        part = substring(query, self.table)
        if ball_size(own) <= len(self.keys):
            if own not in balls:
                balls[own] = ball(own)
            probes = balls[own] ^ part
            at = np.minimum(np.searchsorted(self.keys, probes), len(self.keys) - 1)
            hit = at[self.keys[at] == probes]
        else:  # more values than buckets: the buckets in the ball are the same
            hit = np.flatnonzero(np.bitwise_count(self.keys ^ part) <= own)
        sizes = self.starts[hit + 1] - self.starts[hit]
        before = np.cumsum(sizes) - sizes
        rows = self.order[np.repeat(self.starts[hit] - before, sizes) + np.arange(sizes.sum())]
        rows = rows[apart(self.codes[rows], query) <= radius]
        earlier = np.zeros(len(rows), bool)
        for t in range(self.table):
            if reach[t] >= 0:
                earlier |= np.bitwise_count(substring(self.codes[rows], t) ^ substring(query, t)) <= reach[t]
        return rows[~earlier]


def _codes(column: pd.Series) -> np.ndarray:
    return np.frombuffer(b"".join(column), np.uint64).reshape(len(column), PARTS)


def probed(queries: pd.DataFrame, rows: pd.DataFrame, table: int, radius: int) -> pd.DataFrame:
    """(query_id, query_mark, id, mark) of a cell's entries within ``radius`` of its queries."""
    if not len(queries) or not len(rows):
        return pd.DataFrame({"query_id": [], "query_mark": [], "id": [], "mark": []}).astype("Int64")
    held, balls, asking = Table(_codes(rows["code"]), table), {}, _codes(queries["code"])
    found = [held.within(code, radius, balls) for code in asking]
    q, r = np.repeat(np.arange(len(found)), [len(f) for f in found]), np.concatenate(found)
    return pd.DataFrame({"query_id": queries["id"].array[q], "query_mark": queries["mark"].to_numpy()[q], "id": rows["id"].array[r], "mark": rows["mark"].to_numpy()[r]})


def ranked(queries: pd.DataFrame, rows: pd.DataFrame, dim: int, radius: int, k: int, nearest_codes: int | None) -> pd.DataFrame:
    """The ``k`` best of a cell's rows within ``radius`` of each of its queries (or of the
    ``nearest_codes`` nearest codes and all as near as the last of them), with their cosines."""
    columns = ["query_id", "query_mark", "vec_id", "score", "copies", "within"]
    if not len(queries) or not len(rows):
        return pd.DataFrame({c: [] for c in columns}).astype({c: float if c == "score" else "Int64" for c in columns})
    codes, asking = _codes(rows["code"]), _codes(queries["code"])
    vectors, ask = (np.frombuffer(b"".join(x["vec"])).reshape(len(x), dim) for x in (rows, queries))
    lengths, ask_lengths = np.sqrt((vectors * vectors).sum(axis=1)), np.sqrt((ask * ask).sum(axis=1))
    none = rows["id"].isna().to_numpy()
    ids = rows["id"].fillna(np.iinfo(np.int64).max).to_numpy(np.int64)
    own = queries["id"].to_numpy(np.int64)
    out = []
    step, at_once = max(1, PAIRS_AT_ONCE // len(codes)), max(1, PAIRS_AT_ONCE // dim)
    for a in range(0, len(asking), step):
        far = apart(asking[a : a + step, None, :], codes[None])
        limit = radius
        if nearest_codes is not None:
            limit = np.partition(far, nearest_codes, axis=1)[:, nearest_codes : nearest_codes + 1] if nearest_codes < len(codes) else BITS
        q, r = np.nonzero(far <= limit)
        q += a
        other = none[r] | (ids[r] != own[q])
        q, r = q[other], r[other]
        scores = np.empty(len(q))
        for b in range(0, len(q), at_once):
            qq, rr = q[b : b + at_once], r[b : b + at_once]
            scores[b : b + at_once] = (vectors[rr] * ask[qq]).sum(axis=1) / (lengths[rr] * ask_lengths[qq])
        order = np.lexsort((ids[r], -scores, q))
        q, r, scores = q[order], r[order], scores[order]
        first = np.searchsorted(q, q)
        best = np.arange(len(q)) - first < k
        within = np.searchsorted(q, q, side="right") - first
        out.append((q[best], r[best], scores[best], within[best]))
    q, r, scores, within = (np.concatenate(c) for c in zip(*out))
    found = (queries["id"].array[q], queries["mark"].to_numpy()[q], rows["id"].array[r], scores, rows["copies"].to_numpy()[r], within)
    return pd.DataFrame(dict(zip(columns, found)))


def usable(vector: Column) -> Column:
    """Neither NULL, empty or zero nor with NULL or non-finite components."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce((F.size(vector) > 0) & ~bad & F.exists(vector, lambda x: x != 0), F.lit(False))


def _by_length(batch: pa.RecordBatch, place: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(row numbers, vectors, unit vectors) of a batch's vectors of each length."""
    column = batch.column(place)
    sizes = np.diff(column.offsets.to_numpy())
    values = column.flatten().to_numpy(zero_copy_only=False)
    starts = np.cumsum(sizes) - sizes
    for dim in np.unique(sizes):
        at = np.flatnonzero(sizes == dim)
        v = values[starts[at][:, None] + np.arange(dim)]
        biggest = np.abs(v).max(axis=1, keepdims=True)
        unit = v / biggest
        yield at, v, unit / np.sqrt((unit * unit).sum(axis=1, keepdims=True))


def with_codes(rows: DataFrame, coders: dict[int, Coder]) -> DataFrame:
    """id, mark, copies, dim, code and vec (the vector's bytes) of (id, mark, copies, v)."""
    schema = pa.schema([("id", pa.int64()), ("mark", pa.int64()), ("copies", pa.int64()), ("dim", pa.int32()), ("code", pa.binary()), ("vec", pa.binary())])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spare: dict[int, Coder] = {}
        for batch in batches:
            dims, codes, raw = np.zeros(batch.num_rows, np.int32), np.empty(batch.num_rows, object), np.empty(batch.num_rows, object)
            for at, v, unit in _by_length(batch, 3):
                dim = v.shape[1]
                coder = coders.get(dim) or spare.setdefault(dim, fit_coder(dim, np.zeros((0, dim))))
                dims[at] = dim
                codes[at], raw[at] = [c.tobytes() for c in coder.codes(unit)], [x.tobytes() for x in v]
            own = [batch.column(0), batch.column(1), batch.column(2)]
            yield pa.RecordBatch.from_arrays([*own, pa.array(dims), pa.array(codes, pa.binary()), pa.array(raw, pa.binary())], schema=schema)

    return small_batches(rows.select("id", "mark", "copies", "v")).mapInArrow(work, "id bigint, mark bigint, copies bigint, dim int, code binary, vec binary")


def measured_radius(rows: DataFrame, coder: Coder, asking: list[tuple[int | None, np.ndarray]], k: int) -> int:
    """The radius that takes in :data:`COVERED` of the true ``k`` nearest rows of ``asking`` (unit
    vectors with their keys), found by reading all rows."""
    ids = [i for i, _ in asking]
    units = np.array([u for _, u in asking])
    codes = coder.codes(units)
    schema = pa.schema([("q", pa.int32()), ("score", pa.float64()), ("apart", pa.int64())])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = batch.column(0).to_pylist()
            for at, v, unit in _by_length(batch, 2):
                if v.shape[1] != coder.dim:
                    continue
                scores = units @ unit.T
                for q, own in enumerate(ids):
                    scores[q, [j for j, i in enumerate(at) if keys[i] == own]] = -np.inf
                best = np.argsort(-scores, axis=1)[:, :k]
                far = apart(codes[:, None], coder.codes(unit)[best])
                q = np.repeat(np.arange(len(units), dtype=np.int32), best.shape[1])
                found = np.take_along_axis(scores, best, axis=1).ravel()
                ok = found > -np.inf
                yield pa.RecordBatch.from_arrays([pa.array(q[ok]), pa.array(found[ok]), pa.array(far.ravel()[ok])], schema=schema)

    near = small_batches(rows.select("id", "mark", "v")).mapInArrow(work, "q int, score double, apart bigint")
    top = Window.partitionBy("q").orderBy(F.col("score").desc(), "apart")
    best = near.withColumn("n", F.row_number().over(top)).where(F.col("n") <= k).select("apart").collect()  # MEASURED * k rows
    return int(np.ceil(np.quantile([r["apart"] for r in best], COVERED))) if best else BITS


def probed_cells(coded: DataFrame, asked: DataFrame, dim: int, radius: int, n_rows: int, n_asked: int) -> DataFrame:
    """(query_id, query_mark, id, mark): rows of length ``dim`` whose codes lie within ``radius`` of a
    query's, each once."""
    reach = reaches(radius)
    searched = [t for t in range(TABLES) if reach[t] >= 0]
    bits = max(0, min(WIDTH, int(np.ceil(np.log2(max(1, n_rows) / CELL_ROWS)))))
    turns = max(1, -(-n_asked // QUERY_ROWS))
    # A code's words are little-endian: substring t is bytes 2 t + 1 and 2 t of it.
    value = lambda t: F.conv(F.hex(F.concat(F.substring("code", 2 * t + 2, 1), F.substring("code", 2 * t + 1, 1))), 16, 10).cast("int")
    place = lambda t: F.shiftright(value(t), WIDTH - bits)
    near = lambda t: F.transform(F.array(*[F.lit(int(m)) for m in ball(min(reach[t], bits), bits)]), lambda m: F.struct(F.lit(t).alias("t"), place(t).bitwiseXOR(m).alias("g")))
    fields = ["id", "mark", "code", F.col("at.t").alias("t"), F.col("at.g").alias("g")]
    own = coded.where(F.col("dim") == dim).withColumn("at", F.explode(F.array(*[F.struct(F.lit(t).alias("t"), place(t).alias("g")) for t in searched])))
    own = own.select(*fields, F.explode(F.sequence(F.lit(0), F.lit(turns - 1))).alias("turn"))
    asking = asked.where(F.col("dim") == dim).withColumn("at", F.explode(F.concat(*[near(t) for t in searched])))
    asking = asking.select(*fields, F.pmod(F.xxhash64("id", "mark", F.lit(2)), F.lit(turns)).cast("int").alias("turn"))

    def cell(key: tuple, queries: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        return probed(queries, rows, int(key[0]), radius)

    keys = ["t", "g", "turn"]
    return asking.groupBy(*keys).cogroup(own.groupBy(*keys)).applyInPandas(cell, "query_id bigint, query_mark bigint, id bigint, mark bigint")


FOUND = "query_id bigint, query_mark bigint, vec_id bigint, score double, copies bigint, within bigint"


def read_cells(coded: DataFrame, asked: DataFrame, dim: int, radius: int, n_rows: int, n_asked: int, k: int, nearest_codes: int | None = None) -> DataFrame:
    """:data:`FOUND`: each cell's ``k`` best rows for each query, and how many it ranked."""
    held = max(1, min(CELL_ROWS, CELL_BYTES // (8 * dim)))
    count, turns = max(1, -(-n_rows // held)), max(1, -(-n_asked // held))
    slot = lambda seed, n: F.pmod(F.xxhash64("id", "mark", F.lit(seed)), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    fields = ["id", "mark", "copies", "code", "vec"]
    own = coded.where(F.col("dim") == dim).select(*fields, slot(1, count).alias("g"), every(turns).alias("turn"))
    asking = asked.where(F.col("dim") == dim).select(*fields, every(count).alias("g"), slot(2, turns).alias("turn"))

    def cell(queries: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        return ranked(queries, rows, dim, radius, k, nearest_codes)

    return asking.groupBy("g", "turn").cogroup(own.groupBy("g", "turn")).applyInPandas(cell, FOUND)


def nearest(df: DataFrame, k: int = 5, every: int = 50, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: for each row whose key is divisible by ``every``, its ``k``
    nearest other rows by cosine, ties to the smaller key.

    Rows with an unusable vector take no part (a query among them has no result); vectors of another
    length are not compared; rows with the query's own key are not its neighbours; equal query rows
    count as one; a row without a key can only be found, last among ties. Fewer rows than ``k`` are
    all returned, an empty table gives an empty one, further columns are left out.
    """
    rows = df.select(F.col(f"`{key}`").cast("bigint").alias("id"), F.col(f"`{vector}`").cast("array<double>").alias("v")).where(usable(F.col("v")))
    # Equal rows are one, with their number.
    rows = checkpoint(rows.withColumn("mark", F.xxhash64("v")).groupBy("id", "mark").agg(F.first("v").alias("v"), F.count(F.lit(1)).alias("copies")))
    sample = [(r["id"], np.array(r["v"])) for r in hash_sample(rows.select("id", "mark", "v"), SAMPLE_ROWS, "id", "mark").collect()]  # bounded
    units: dict[int, list] = {}
    for i, v in sample:
        v = v / np.abs(v).max()
        units.setdefault(len(v), []).append((i, v / np.sqrt((v * v).sum())))
    coders = {dim: fit_coder(dim, np.array([u for _, u in held])) for dim, held in units.items()}
    coded = checkpoint(with_codes(rows, coders))
    asked = checkpoint(coded.where(F.col("id") % every == 0))
    sizes = {r["dim"]: (r["n"], r["asked"]) for r in coded.groupBy("dim").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("id") % every == 0).alias("asked")).collect()}  # one row a length
    found = df.sparkSession.createDataFrame([], FOUND)
    for dim, (n, n_asked) in sizes.items():
        if not n_asked:
            continue
        radius = measured_radius(rows, coders[dim], units[dim][:MEASURED], k) if dim in coders else BITS
        if selective(radius):
            pairs = probed_cells(coded, asked, dim, radius, n, n_asked)
            found = found.unionByName(scored(pairs, rows, every, k))
        else:
            found = found.unionByName(read_cells(coded, asked, dim, radius, n, n_asked, k))
    found = checkpoint(found)
    # Queries with too few rows that near look at the nearest codes of every cell.
    enough = found.groupBy("query_id", "query_mark").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= k)
    short = checkpoint(asked.join(enough, (F.col("id") == F.col("query_id")) & (F.col("mark") == F.col("query_mark")), "left_anti"))
    left = {r["dim"]: r["n"] for r in short.groupBy("dim").agg(F.count(F.lit(1)).alias("n")).collect()}
    if left:
        found = found.join(short.select(F.col("id").alias("_q"), F.col("mark").alias("_m")), (F.col("query_id") == F.col("_q")) & (F.col("query_mark") == F.col("_m")), "left_anti")
        for dim, n_short in left.items():
            found = found.unionByName(read_cells(coded, short, dim, BITS, sizes[dim][0], n_short, k, SPARE * k))
        found = checkpoint(found)
    best = Window.partitionBy("query_id", "query_mark").orderBy(F.col("score").desc(), F.col("vec_id").asc_nulls_last())
    each = found.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("bigint"), F.least("copies", F.lit(k).cast("bigint")))))
    return each.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def scored(pairs: DataFrame, rows: DataFrame, every: int, k: int) -> DataFrame:
    """:data:`FOUND` of probed pairs: their vectors fetched, the ``k`` best of each query."""
    pairs = pairs.where(~F.col("id").eqNullSafe(F.col("query_id")))
    queries = rows.where(F.col("id") % every == 0).select(F.col("id").alias("query_id"), F.col("mark").alias("query_mark"), F.col("v").alias("_qv"))
    own = rows.select(F.col("id").alias("_id"), F.col("mark").alias("_mark"), F.col("v").alias("_v"), "copies")
    joined = pairs.join(own, F.col("id").eqNullSafe(F.col("_id")) & (F.col("mark") == F.col("_mark"))).join(lookup(queries), ["query_id", "query_mark"])
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    score = dot("_v", "_qv") / (F.sqrt(dot("_v", "_v")) * F.sqrt(dot("_qv", "_qv")))
    all_ = joined.select("query_id", "query_mark", F.col("id").alias("vec_id"), score.alias("score"), "copies", F.lit(1).cast("bigint").alias("within"))
    best = Window.partitionBy("query_id", "query_mark").orderBy(F.col("score").desc(), F.col("vec_id").asc_nulls_last())
    return all_.withColumn("n", F.row_number().over(best)).where(F.col("n") <= k).drop("n")
