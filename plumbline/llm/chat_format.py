"""Chat formatting: conversations rendered by a compiled template, with the stretches a model is to
learn, and read back from what was rendered.

A conversation is never gathered: its turns arrive sorted in one task and pass through the
template, the reader and the digests one at a time, so memory does not grow with its length.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from plumbline.llm.common import schema_of
from plumbline.llm.templates import Sink, compile_template

CONTROLS = ("<s>", "</s>", "[INST] ", " [/INST]", "[ROLE]", "[TEXT]", "[/ROLE]", "[INST]", "[/INST]")
"""Strings that mark turns, or parts of such."""

TEMPLATE = """<s>
{%- for m in messages -%}
{%- if m.role == 'user' -%} {{ '[INST] ' ~ (m.text | escape) ~ ' [/INST]' }}
{%- elif m.role == 'assistant' -%} {% generation %}{{ m.text | escape }}{% endgeneration %}{{ '</s>' }}
{%- else -%} [ROLE]{{ m.role | escape }}[TEXT]{{ m.text | escape }}[/ROLE]
{%- endif -%}
{%- endfor -%}"""

_INSIDE = re.compile("(?=" + "|".join(re.escape(c.strip()) for c in CONTROLS) + ")(.)", re.DOTALL)
_BACK = re.compile(r"\\(\\?)")
_PIECE = re.compile(r"\[INST\] (?P<user>.*?) \[/INST\]|\[ROLE\](?P<role>.*?)\[TEXT\](?P<other>.*?)\[/ROLE\]|(?P<assistant>.*?)</s>", re.DOTALL)


def escape(text: str | None) -> str:
    """``text`` with backslashes doubled and one put after the first character of every control
    string, so that none is left."""
    return _INSIDE.sub(lambda m: m[1] + "\\", (text or "").replace("\\", "\\\\"))


def unescape(text: str) -> str:
    return _BACK.sub(lambda m: m[1], text)


@lru_cache(maxsize=8)
def renderer(template: str):
    return compile_template(template, {"escape": escape})


def read_turns(formatted: str) -> list[tuple[str, str]]:
    """(role, text) of whole turns written by :data:`TEMPLATE` (without its opening mark)."""
    out, at = [], 0
    while at < len(formatted):
        m = _PIECE.match(formatted, at)
        if not m:
            raise ValueError("the text ends within a turn")
        if m["user"] is not None:
            out.append(("user", unescape(m["user"])))
        elif m["role"] is not None:
            out.append((unescape(m["role"]), unescape(m["other"])))
        else:
            out.append(("assistant", unescape(m["assistant"])))
        at = m.end()
    return out


class Reader:
    """Digests of a conversation, from its formatted text alone, turn by turn."""

    def __init__(self) -> None:
        self.turns, self.loss = hashlib.sha256(), hashlib.sha256()
        self.n_turns = self.loss_chars = self.chars = 0
        self.opened = False

    def feed(self, formatted: str, spans: list[tuple[int, int]]) -> None:
        """``formatted``: what was written since the last call; ``spans``: marked stretches in it, by
        their place in the whole."""
        for a, b in spans:
            learned = unescape(formatted[a - self.chars : b - self.chars])
            self.loss_chars += len(learned)
            self.loss.update(learned.encode("utf-8", "surrogatepass"))
        self.chars += len(formatted)
        if not self.opened and formatted:
            if not formatted.startswith("<s>"):
                raise ValueError("the opening mark is missing")
            formatted, self.opened = formatted[3:], True
        for role, text in read_turns(formatted):
            self.n_turns += 1
            self.turns.update(f"{role}\n{text}\n".encode("utf-8", "surrogatepass"))


def format_one(messages: Iterable[dict], template: str = TEMPLATE) -> tuple[str, list[tuple[int, int]]]:
    """Formatted text of one conversation and the stretches under its loss mask (code points)."""
    sink = Sink()
    renderer(template)({"messages": messages}, sink)
    return sink.take()


def _conversations(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[int | None, Iterator[dict]]]:
    """Conversations of batches that are sorted by conversation, each as a stream of messages."""

    def rows() -> Iterator[tuple]:
        for batch in batches:
            yield from zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist())

    stream = rows()
    row = next(stream, None)

    def turns(key: int | None) -> Iterator[dict]:
        nonlocal row
        while row is not None and row[0] == key:
            yield {"role": row[1], "text": row[2]}
            row = next(stream, None)

    while row is not None:
        key = row[0]
        own = turns(key)
        yield key, own
        for _ in own:  # what the template left unread
            pass


def _sorted(df: DataFrame, key: str, turn: str, role: str, text: str) -> DataFrame:
    rows = df.select(
        F.col(f"`{key}`").cast("bigint").alias("key"),
        F.col(f"`{turn}`").cast("bigint").alias("turn"),
        F.coalesce(F.col(f"`{role}`").cast("string"), F.lit("")).alias("role"),
        F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias("text"),
    )
    return rows.repartition("key").sortWithinPartitions("key", "turn", "role", "text").select("key", "role", "text")


def formatted_conversations(df: DataFrame, template: str = TEMPLATE, key: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """``key``, formatted, loss_spans (start, end) of every conversation. Unlike
    :func:`conversation_digests` this holds one formatted conversation in memory at a time."""
    schema = schema_of(f"`{key}` bigint, formatted string, loss_spans array<struct<start: bigint, end: bigint>>")
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for k, messages in _conversations(batches):
            out, spans = format_one(messages, template)
            yield pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip((k, out, [{"start": a, "end": b} for a, b in spans]), arrow)], schema=arrow)

    return _sorted(df, key, turn, role, text).mapInArrow(run, schema)


def conversation_digests(df: DataFrame, key: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Per conversation, read back from its formatted text: ``key``, n_turns, turns_sha256,
    loss_chars, loss_sha256, formatted_chars.

    Turns are ordered by turn (NULL first), equal turns by role and text; NULL roles and texts are
    empty; rows without a key are one conversation with a NULL key; repeated rows are turns of their
    own; an empty table gives an empty one; further columns are left out.
    """
    schema = schema_of(f"`{key}` bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint")
    arrow = to_arrow_schema(schema)

    def digest(messages: Iterator[dict]) -> tuple:
        sink, reader = Sink(), Reader()

        def passing() -> Iterator[dict]:
            for message in messages:
                yield message
                reader.feed(*sink.take())  # the message has been written by now

        renderer(TEMPLATE)({"messages": passing()}, sink)
        reader.feed(*sink.take())
        return reader.n_turns, reader.turns.hexdigest(), reader.loss_chars, reader.loss.hexdigest(), reader.chars

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        for k, messages in _conversations(batches):
            rows.append((k, *digest(messages)))
            if len(rows) == 4096:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), arrow)], schema=arrow)
                rows = []
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), arrow)], schema=arrow)

    return _sorted(df, key, turn, role, text).mapInArrow(run, schema)
