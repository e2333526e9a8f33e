"""WARC archives: written by Spark's text sink, read back as a stream, indexed by an external merge.

Captures become records of WARC/1.1 (payloads seen before become revisit records) in gzipped files
of the checkpoint folder. Reading follows Content-Length, so payloads may hold anything, record
headers included. Each task sorts what it read into runs of the index; the runs are dealt out by
ranges of (URL key, timestamp), and each range's runs are merged by a loser tree, which gives
capture histories in one global order.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterable, Iterator
from urllib.parse import urlsplit
from uuid import uuid4

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from plumbline.llm.common import BATCH_ROWS, schema_of, small_batches
from plumbline.session import checkpoint, ensure_checkpoint_dir, lookup

# Fixed values of the formats: record start, line end, the revisit profile, base32 digits.
START = "WARC/1.1\r\n"
CRLF = "\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"

ID = "urn:capture:"
FIRST_DATE = "2000-01-01 00:00:00"
"""Date of capture 0 where a table has no dates; capture n follows n seconds later."""
RUN_ROWS = 100_000
"""Index entries that a task sorts at once."""
MERGE_ROWS = 100_000
"""Index entries, about, that one task merges."""
INDEX = "id bigint, urlkey string, timestamp string, url string, record_type string, payload_bytes bigint, payload_digest string, refers_to bigint, file string, offset bigint, length bigint, problem string"
ORDER = ("urlkey", "timestamp", "file", "offset")


def base32_sha1(payload: Column) -> Column:
    """Base32 SHA-1 of a string's UTF-8 bytes: 20 bits are 5 hexadecimal and 4 base32 digits."""
    digits = F.sha1(payload.cast("binary"))
    quads = [F.lpad(F.conv(F.substring(digits, 5 * g + 1, 5), 16, 32), 4, "0") for g in range(8)]
    return F.translate(F.upper(F.concat(*quads)), "0123456789ABCDEFGHIJKLMNOPQRSTUV", BASE32)


def captured(df: DataFrame, key: str, url: str, body: str, date: str | None) -> DataFrame:
    """id, url, body, at (timestamp), bytes and digest of every row."""
    seconds = F.coalesce(F.col(f"`{key}`").cast("bigint"), F.lit(0))
    at = F.col(f"`{date}`").cast("timestamp") if date else F.expr(f"timestamp'{FIRST_DATE}Z'") + F.make_dt_interval(secs=seconds)
    rows = df.select(
        F.col(f"`{key}`").cast("bigint").alias("id"),
        F.col(f"`{url}`").cast("string").alias("url"),
        F.coalesce(F.col(f"`{body}`").cast("string"), F.lit("")).alias("body"),
        F.coalesce(at, F.expr(f"timestamp'{FIRST_DATE}Z'")).alias("at"),
    )
    return rows.withColumn("bytes", F.octet_length("body").cast("bigint")).withColumn("digest", base32_sha1(F.col("body")))


def records(df: DataFrame, key: str = "page_id", url: str = "url", body: str = "html", date: str | None = None, least_bytes: int = 0) -> DataFrame:
    """One string column: the WARC record of every row, but for its last line end. Of rows with
    equal payloads of ``least_bytes`` or more, that with the largest key is a response and the others
    revisit it (rows that share the largest key are all responses; so are rows without a key if no
    row of their payload has one)."""
    rows = captured(df, key, url, body, date)
    again = rows.where(F.col("bytes") >= least_bytes).groupBy("digest").agg(F.max("id").alias("keep"), F.count(F.lit(1)).alias("n"))
    rows = rows.join(lookup(again.where("n > 1 and keep is not null").select("digest", "keep")), "digest", "left")
    revisit = F.coalesce((F.col("bytes") >= least_bytes) & F.col("keep").isNotNull() & ~F.col("id").eqNullSafe(F.col("keep")), F.lit(False))
    answer = F.concat(F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}Content-Length: "), F.col("bytes").cast("string"), F.lit(CRLF * 2))
    block = F.when(revisit, answer).otherwise(F.concat(answer, "body"))
    field = lambda name, value: F.coalesce(F.concat(F.lit(f"{name}: "), value, F.lit(CRLF)), F.lit(""))
    clean = F.regexp_replace("url", r"[\x00-\x20\x7F]", "%20")
    header = F.concat(
        F.lit(START),
        field("WARC-Type", F.when(revisit, "revisit").otherwise("response")),
        field("WARC-Record-ID", F.concat(F.lit(f"<{ID}"), F.col("id").cast("string"), F.lit(">"))),
        field("WARC-Date", F.date_format(F.to_utc_timestamp("at", F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss'Z'")),
        field("WARC-Target-URI", clean),
        field("WARC-Payload-Digest", F.concat(F.lit("sha1:"), "digest")),
        F.when(revisit, F.concat(F.lit(f"WARC-Profile: {PROFILE}{CRLF}WARC-Refers-To: <{ID}"), F.col("keep").cast("string"), F.lit(f">{CRLF}"))).otherwise(F.lit("")),
        F.lit(f"Content-Type: application/http; msgtype=response{CRLF}"),
        field("Content-Length", F.octet_length(block).cast("string")),
    )
    return rows.select(F.concat(header, F.lit(CRLF), block, F.lit(CRLF)).alias("record"))


def write_archives(recs: DataFrame, folder: str) -> None:
    """Gzipped archives, one for each partition of :func:`records`; the sink ends each record."""
    recs.write.option("lineSep", CRLF).option("compression", "gzip").text(folder)


def url_key(url: str | None) -> str:
    """Sort key of a URL: host labels reversed, then path and query, lower-case; no scheme or ``www``."""
    if not url:
        return ""
    try:
        parts = urlsplit(url if "//" in url else f"//{url}")
        host, port = (parts.hostname or "").removeprefix("www."), parts.port
    except ValueError:
        return url.lower()
    name = ",".join(reversed(host.split("."))) + (f":{port}" if port not in (None, 80, 443) else "")
    return f"{name}){parts.path or '/'}".lower() + (f"?{parts.query}".lower() if parts.query else "")


def _fields(head: bytes) -> dict[str, str]:
    pairs = (line.split(":", 1) for line in head.decode("utf-8", "replace").split(CRLF) if ":" in line)
    return {name.strip().lower(): value.strip() for name, value in pairs}


def _id(uri: str | None) -> int | None:
    number = (uri or "").strip("<>").removeprefix(ID)
    return int(number) if number.lstrip("-").isdigit() else None


def read_records(pieces: Iterable[bytes]) -> Iterator[tuple[int, int, dict[str, str], bytes, str | None]]:
    """(offset, length, header fields, block, problem) of an archive given in pieces, cut at (and
    without) every :data:`START`. A piece is a record unless a block holds that line itself."""
    start, end = START.encode(), b"\r\n\r\n"
    offset, held = 0, iter(pieces)
    offset += len(next(held, b""))  # before the first record
    for piece in held:
        at = piece.find(end)
        fields = _fields(piece[:at] if at >= 0 else piece)
        size = int(fields.get("content-length", "-1")) if fields.get("content-length", "").isdigit() else -1
        whole, need = [piece], at + 4 + size + 4
        have = len(piece)
        while at >= 0 and size >= 0 and have < need:
            more = next(held, None)
            if more is None:
                break
            whole += [start, more]
            have += len(start) + len(more)
        data = b"".join(whole) if len(whole) > 1 else piece
        problem = None
        if at < 0 or size < 0:
            problem = "no header or length"
        elif have != need or data[-4:] != end:
            problem = "length does not fit"
        yield offset, len(start) + have, fields, data[at + 4 : at + 4 + size] if size >= 0 else b"", problem
        offset += len(start) + have


def entry(file: str, offset: int, length: int, fields: dict[str, str], block: bytes, problem: str | None) -> tuple:
    """The index row of a record; figures of a response come from its payload."""
    kind = fields.get("warc-type")
    at = block.find(b"\r\n\r\n")
    stated = fields.get("warc-payload-digest", "").removeprefix("sha1:") or None
    if kind == "response":
        body = block[at + 4 :]
        size, digest = len(body), base64.b32encode(hashlib.sha1(body).digest()).decode()
        if problem is None and stated not in (None, digest):
            problem = "digest does not fit"
    else:
        told = _fields(block[: max(at, 0)]).get("content-length", "")
        size, digest = int(told) if told.isdigit() else None, stated
    url = fields.get("warc-target-uri")
    stamp = "".join(c for c in fields.get("warc-date", "") if c.isdigit())
    refers = _id(fields.get("warc-refers-to"))
    return _id(fields.get("warc-record-id")), url_key(url), stamp, url, kind, size, digest, refers, file, offset, length, problem


def _place(row: tuple) -> tuple:
    return row[1], row[2], row[8], row[9]


def _batches(rows: Iterable[tuple], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    held: list[tuple] = []
    for row in rows:
        held.append(row)
        if len(held) == BATCH_ROWS:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)
            held = []
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)


def index_runs(spark: SparkSession, folder: str) -> DataFrame:
    """Index entries of the archives of ``folder``, in locally sorted runs of :data:`RUN_ROWS`."""
    schema = to_arrow_schema(schema_of(INDEX))

    def by_file(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, Iterator[bytes]]]:
        names: list[str] = []
        pieces = ((b.column(1)[i].as_py(), b.column(0)[i].as_py()) for b in batches for i in range(b.num_rows))
        ahead = next(pieces, None)

        def own(name: str) -> Iterator[bytes]:
            nonlocal ahead
            while ahead is not None and ahead[0] == name:
                piece = ahead[1]
                ahead = next(pieces, None)
                yield piece

        while ahead is not None:
            names.append(ahead[0])
            yield ahead[0], own(ahead[0])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        run: list[tuple] = []
        for name, pieces in by_file(batches):
            for record in read_records(pieces):
                run.append(entry(name, *record))
                if len(run) == RUN_ROWS:
                    yield from _batches(sorted(run, key=_place), schema)
                    run = []
        yield from _batches(sorted(run, key=_place), schema)

    pieces = spark.read.option("lineSep", START).text(folder).select(F.col("value").cast("binary").alias("piece"), F.col("_metadata.file_name").alias("file"))
    return small_batches(pieces).mapInArrow(work, INDEX)


class LoserTree:
    """Merges sorted lists: inner nodes hold the list that lost there, so the next smallest item costs
    one comparison for each level above the list that won last."""

    def __init__(self, runs: list[list[tuple]]):
        self.runs, self.at = runs, [0] * len(runs)
        self.size = 1
        while self.size < len(runs):
            self.size *= 2
        self.losers = [-1] * self.size
        self.winner = self._played(1) if runs else -1

    def _played(self, node: int) -> int:
        if node >= self.size:
            return node - self.size if node - self.size < len(self.runs) else -1
        left, right = self._played(2 * node), self._played(2 * node + 1)
        win, self.losers[node] = (left, right) if self._before(left, right) else (right, left)
        return win

    def _before(self, a: int, b: int) -> bool:
        if a < 0 or self.at[a] >= len(self.runs[a]):
            return False
        if b < 0 or self.at[b] >= len(self.runs[b]):
            return True
        return _place(self.runs[a][self.at[a]]) <= _place(self.runs[b][self.at[b]])

    def __iter__(self) -> Iterator[tuple]:
        while self.winner >= 0 and self.at[self.winner] < len(self.runs[self.winner]):
            yield self.runs[self.winner][self.at[self.winner]]
            self.at[self.winner] += 1
            now, node = self.winner, (self.winner + self.size) // 2
            while node:
                if self._before(self.losers[node], now):
                    now, self.losers[node] = self.losers[node], now
                node //= 2
            self.winner = now


def ascending(rows: Iterable[tuple]) -> list[list[tuple]]:
    """``rows`` cut where they stop ascending: the runs, in whatever order they arrive."""
    runs: list[list[tuple]] = []
    for row in rows:
        if runs and _place(runs[-1][-1]) <= _place(row):
            runs[-1].append(row)
        else:
            runs.append([row])
    return runs


def merged_runs(runs: DataFrame) -> DataFrame:
    """All entries by URL key, timestamp, file and offset; ``place`` numbers them in that order
    (ascending, with gaps). Ranges are cut within a URL too, so one URL may hold any share of them."""
    runs = checkpoint(runs)
    schema = to_arrow_schema(schema_of(INDEX))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arrived = (row for b in batches for row in zip(*[c.to_pylist() for c in b.columns]))
        yield from _batches(LoserTree(ascending(arrived)), schema)

    ranges = runs.count() // MERGE_ROWS + 1
    return small_batches(runs.repartitionByRange(ranges, *ORDER)).mapInArrow(work, INDEX).withColumn("place", F.monotonically_increasing_id())


def capture_histories(df: DataFrame, key: str = "page_id", url: str = "url", body: str = "html", date: str | None = None, least_bytes: int = 0, folder: str | None = None) -> DataFrame:
    """``df`` written as archives to ``folder`` (a new one below the checkpoint folder unless given),
    read back and indexed: one row for each row, in the order of :func:`merged_runs`.

    NULL bodies count as empty; rows without a URL have an empty urlkey, and rows without a date the
    first one; control characters and spaces of a URL become %20; repeated rows each give a record (see
    :func:`records`); an empty table gives an empty one; further columns are left out. ``problem`` says
    what is wrong with a record, NULL if nothing is.
    """
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    folder = folder or f"{spark.sparkContext.getCheckpointDir()}/warc-{uuid4().hex}"
    write_archives(records(df, key, url, body, date, least_bytes), folder)
    return merged_runs(index_runs(spark, folder))


def cdx_lines(histories: DataFrame) -> DataFrame:
    """The histories as lines of a CDX index: urlkey, timestamp, URL, type, digest, offset, file."""
    fields = [F.coalesce(F.col(c).cast("string"), F.lit("-")) for c in ("urlkey", "timestamp", "url", "record_type", "payload_digest", "offset", "file")]
    return histories.select("place", F.concat_ws(" ", *fields).alias("line"))
