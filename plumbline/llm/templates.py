"""A small sandboxed template language, compiled to Python closures.

Syntax: text, ``{{ expression }}``, ``{% for x in xs %}``, ``{% if %} {% elif %} {% else %}``,
``{% generation %}`` (what a model is to learn) and ``{# comments #}``; ``-`` inside a tag trims the
white space on its side. Expressions have string and integer literals, names, ``x.field`` and
``x['field']`` (entries of dictionaries only), ``== != not and or``, ``~`` for concatenation and
``| filter`` from a fixed list. Nothing can be called, and nothing outside the values given is
reachable. A template is parsed to a tree, constants are folded and neighbouring texts merged, and
each node becomes one closure that writes to a sink, so a loop over a stream renders as it reads.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable
from dataclasses import dataclass
from typing import Any


class TemplateError(ValueError):
    """The template can't be read."""


@dataclass(frozen=True)
class Const:
    value: Any


@dataclass(frozen=True)
class Name:
    name: str


@dataclass(frozen=True)
class Field:
    of: Any
    name: Any


@dataclass(frozen=True)
class Apply:
    op: str
    args: tuple


@dataclass(frozen=True)
class Emit:
    value: Any


@dataclass(frozen=True)
class Loop:
    target: str
    over: Any
    body: tuple


@dataclass(frozen=True)
class Branch:
    test: Any
    then: tuple
    other: tuple


@dataclass(frozen=True)
class Generation:
    body: tuple


class Sink:
    """Collects output; :attr:`spans` are the stretches under generation markers."""

    def __init__(self) -> None:
        self.parts: list[str] = []
        self.length = 0
        self.spans: list[tuple[int, int]] = []
        self.opened = -1

    def write(self, text: str) -> None:
        self.parts.append(text)
        self.length += len(text)

    def open(self) -> None:
        self.opened = self.length

    def close(self) -> None:
        self.spans.append((self.opened, self.length))

    def take(self) -> tuple[str, list[tuple[int, int]]]:
        """Output and spans (absolute positions) since the last call."""
        out = "".join(self.parts), self.spans
        self.parts, self.spans = [], []
        return out


def _text(value: Any) -> str:
    return "" if value is None else str(value)


OPERATIONS: dict[str, Callable] = {
    "==": lambda a, b: a == b,
    "!=": lambda a, b: a != b,
    "not": lambda a: not a,
    "~": lambda a, b: _text(a) + _text(b),
    "|trim": lambda a: _text(a).strip(),
    "|upper": lambda a: _text(a).upper(),
    "|lower": lambda a: _text(a).lower(),
}

_TAG = re.compile(r"\{\{-?.*?-?\}\}|\{%-?.*?-?%\}|\{#.*?#\}", re.DOTALL)
_PART = re.compile(r"\s*(?:('(?:[^'\\]|\\.)*'|\"(?:[^\"\\]|\\.)*\")|(\d+)|([A-Za-z_]\w*)|(==|!=|[|~.()\[\]]))")
_WORDS = {"and", "or", "not"}


class _Reader:
    """Expressions, by precedence: or, and, not, comparison, ``~``, filters, fields."""

    def __init__(self, source: str, filters: Iterable[str]):
        self.filters, self.source, self.items, at = set(filters), source, [], 0
        source = source.rstrip()
        while at < len(source):
            m = _PART.match(source, at)
            if not m:
                raise TemplateError(f"can't read {source[at:]!r}")
            if m[1] is not None:
                self.items.append(("text", re.sub(r"\\(.)", lambda k: {"n": "\n", "t": "\t"}.get(k[1], k[1]), m[1][1:-1])))
            elif m[2] is not None:
                self.items.append(("number", int(m[2])))
            else:
                self.items.append(("name" if m[3] and m[3] not in _WORDS else "sign", m[3] or m[4]))
            at = m.end()
        self.at = 0

    def next_is(self, *signs: str) -> str | None:
        if self.at < len(self.items) and self.items[self.at][0] == "sign" and self.items[self.at][1] in signs:
            self.at += 1
            return self.items[self.at - 1][1]
        return None

    def need(self, kind: str) -> Any:
        if self.at >= len(self.items) or self.items[self.at][0] != kind:
            raise TemplateError(f"a {kind} is missing in {self.source!r}")
        self.at += 1
        return self.items[self.at - 1][1]

    def whole(self) -> Any:
        out = self.either()
        if self.at != len(self.items):
            raise TemplateError(f"too much in {self.source!r}")
        return out

    def either(self) -> Any:
        out = self.both()
        while self.next_is("or"):
            out = Apply("or", (out, self.both()))
        return out

    def both(self) -> Any:
        out = self.negated()
        while self.next_is("and"):
            out = Apply("and", (out, self.negated()))
        return out

    def negated(self) -> Any:
        return Apply("not", (self.negated(),)) if self.next_is("not") else self.compared()

    def compared(self) -> Any:
        out = self.joined()
        while op := self.next_is("==", "!="):
            out = Apply(op, (out, self.joined()))
        return out

    def joined(self) -> Any:
        out = self.filtered()
        while self.next_is("~"):
            out = Apply("~", (out, self.filtered()))
        return out

    def filtered(self) -> Any:
        out = self.simple()
        while self.next_is("|"):
            name = self.need("name")
            if name not in self.filters:
                raise TemplateError(f"there is no filter {name}")
            out = Apply("|" + name, (out,))
        return out

    def simple(self) -> Any:
        if self.next_is("("):
            out = self.either()
            if not self.next_is(")"):
                raise TemplateError(f"a parenthesis is open in {self.source!r}")
        elif self.at < len(self.items) and self.items[self.at][0] in ("text", "number"):
            self.at += 1
            out = Const(self.items[self.at - 1][1])
        else:
            out = Name(self.need("name"))
        while sign := self.next_is(".", "["):
            if sign == ".":
                out = Field(out, Const(self.need("name")))
            else:
                out = Field(out, self.either())
                if not self.next_is("]"):
                    raise TemplateError(f"a bracket is open in {self.source!r}")
        return out


def parse(source: str, filters: Iterable[str] = ()) -> tuple:
    """The tree of a template."""
    known = {k[1:] for k in OPERATIONS if k[0] == "|"} | set(filters)
    items: list[tuple[str, str]] = []
    at, trim = 0, False
    for m in [*_TAG.finditer(source), None]:
        text = source[at : m.start() if m else len(source)]
        text = text.lstrip() if trim else text
        if m:
            text = text.rstrip() if m[0][2] == "-" else text
            at, trim = m.end(), m[0][-3] == "-"
        if text:
            items.append(("text", text))
        if m and m[0][1] != "#":
            items.append((m[0][:2], m[0][2:-2].strip("-").strip()))
    place = 0

    def block(ends: tuple[str, ...]) -> tuple[tuple, str]:
        nonlocal place
        out: list = []
        while place < len(items):
            kind, body = items[place]
            place += 1
            word = body.split(None, 1)[0] if kind == "{%" and body else ""
            rest = body[len(word) :].strip() if word else ""
            if kind == "text":
                out.append(Emit(Const(body)))
            elif kind == "{{":
                out.append(Emit(_Reader(body, known).whole()))
            elif word in ends:
                return tuple(out), body
            elif word == "for":
                m = re.fullmatch(r"([A-Za-z_]\w*)\s+in\s+(.+)", rest, re.DOTALL)
                if not m:
                    raise TemplateError(f"can't read {body!r}")
                inner, _ = block(("endfor",))
                out.append(Loop(m[1], _Reader(m[2], known).whole(), inner))
            elif word == "if":
                out.append(branch(rest))
            elif word == "generation":
                inner, _ = block(("endgeneration",))
                out.append(Generation(inner))
            else:
                raise TemplateError(f"unexpected {body!r}")
        if ends:
            raise TemplateError(f"{ends[-1]} is missing")
        return tuple(out), ""

    def branch(test: str) -> Branch:
        then, end = block(("elif", "else", "endif"))
        if end.startswith("elif"):
            other: tuple = (branch(end[4:].strip()),)
        elif end.startswith("else"):
            other, _ = block(("endif",))
        else:
            other = ()
        return Branch(_Reader(test, known).whole(), then, other)

    return block(())[0]


def fold(node: Any, operations: dict[str, Callable]) -> Any:
    """The node with constant operations carried out, decided branches taken and neighbouring texts
    merged."""
    if isinstance(node, tuple):
        out: list = []
        for n in (fold(n, operations) for n in node):
            for one in n if isinstance(n, tuple) else (n,):
                if isinstance(one, Emit) and isinstance(one.value, Const):
                    text = _text(one.value.value)
                    if out and isinstance(out[-1], Emit) and isinstance(out[-1].value, Const):
                        out[-1] = Emit(Const(out[-1].value.value + text))
                    elif text:
                        out.append(Emit(Const(text)))
                else:
                    out.append(one)
        return tuple(out)
    if isinstance(node, Emit):
        return Emit(fold(node.value, operations))
    if isinstance(node, Loop):
        return Loop(node.target, fold(node.over, operations), fold(node.body, operations))
    if isinstance(node, Generation):
        return Generation(fold(node.body, operations))
    if isinstance(node, Branch):
        test, then, other = fold(node.test, operations), fold(node.then, operations), fold(node.other, operations)
        if isinstance(test, Const):
            return then if test.value else other
        return Branch(test, then, other)
    if isinstance(node, Field):
        return Field(fold(node.of, operations), fold(node.name, operations))
    if isinstance(node, Apply):
        args = tuple(fold(a, operations) for a in node.args)
        if node.op in ("and", "or"):
            if isinstance(args[0], Const):
                return args[1] if bool(args[0].value) == (node.op == "and") else args[0]
        elif all(isinstance(a, Const) for a in args):
            return Const(operations[node.op](*[a.value for a in args]))
        return Apply(node.op, args)
    return node


def _value(node: Any, operations: dict[str, Callable]) -> Callable[[dict], Any]:
    if isinstance(node, Const):
        return lambda env, v=node.value: v
    if isinstance(node, Name):
        return lambda env, k=node.name: env.get(k)
    if isinstance(node, Field):
        of, name = _value(node.of, operations), _value(node.name, operations)

        def field(env: dict) -> Any:
            held = of(env)
            return held.get(name(env)) if type(held) is dict else None

        return field
    args = [_value(a, operations) for a in node.args]
    if node.op == "and":
        return lambda env: args[0](env) and args[1](env)
    if node.op == "or":
        return lambda env: args[0](env) or args[1](env)
    op = operations[node.op]
    if len(args) == 1:
        return lambda env, a=args[0]: op(a(env))
    return lambda env, a=args[0], b=args[1]: op(a(env), b(env))


def _writer(node: Any, operations: dict[str, Callable]) -> Callable[[dict, Sink], None]:
    if isinstance(node, tuple):
        steps = [_writer(n, operations) for n in node]

        def several(env: dict, sink: Sink) -> None:
            for step in steps:
                step(env, sink)

        return steps[0] if len(steps) == 1 else several
    if isinstance(node, Emit):
        value = _value(node.value, operations)
        return lambda env, sink: sink.write(_text(value(env)))
    if isinstance(node, Generation):
        inner = _writer(node.body, operations)

        def marked(env: dict, sink: Sink) -> None:
            sink.open()
            inner(env, sink)
            sink.close()

        return marked
    if isinstance(node, Branch):
        test, then, other = _value(node.test, operations), _writer(node.then, operations), _writer(node.other, operations)
        return lambda env, sink: (then if test(env) else other)(env, sink)
    over, body, target = _value(node.over, operations), _writer(node.body, operations), node.target

    def loop(env: dict, sink: Sink) -> None:
        for k, item in enumerate(over(env) or ()):
            body({**env, target: item, "loop": {"index0": k, "first": k == 0}}, sink)

    return loop


def compile_template(source: str, filters: dict[str, Callable[[Any], Any]] | None = None) -> Callable[[dict, Sink], None]:
    """``render(values, sink)`` of a template; ``filters`` are further ``|`` functions."""
    operations = OPERATIONS | {"|" + k: f for k, f in (filters or {}).items()}
    return _writer(fold(parse(source, filters or {}), operations), operations)
