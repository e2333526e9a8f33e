"""Templates, and conversations read back from their formatted text."""

from __future__ import annotations

import hashlib
import random

import pytest

from plumbline.llm import chat_format as C
from plumbline.llm import templates as T
from tests.llm.helpers import rows


def render(source, filters=None, **values):
    sink = T.Sink()
    T.compile_template(source, filters)(values, sink)
    return sink.take()


def test_language():
    assert render("a {{- ' b' -}} c{# note #}!")[0] == "a bc!"
    assert render("{% for x in xs %}{{ loop.index0 }}{% if loop.first %}*{% endif %}{{ x['v'] }};{% endfor %}", xs=[{"v": 1}, {"v": "q"}])[0] == "0*1;1q;"
    source = "{% if a == 'x' and not b %}1{% elif b or a != 'y' %}2{% else %}3{% endif %}"
    assert [render(source, a=a, b=b)[0] for a, b in (("x", 0), ("x", 1), ("y", 0))] == ["1", "2", "3"]
    assert render("p{% generation %}{{ t | trim }}{% endgeneration %}q", t=" ab ") == ("pabq", [(1, 3)])
    assert render("{{ nothing }}{{ nothing.at.all }}") == ("", [])


def test_constants_are_folded():
    tree = T.fold(T.parse("a{{ 'b' ~ 1 }}{% if 'x' == 'x' %}{{ 'c' | upper }}{% else %}{{ y }}{% endif %}"), T.OPERATIONS)
    assert tree == (T.Emit(T.Const("ab1C")),)


@pytest.mark.parametrize("source", ["{{ x( ) }}", "{{ x | open }}", "{% for in y %}{% endfor %}", "{% if x %}", "{{ x.y. }}", "{% endfor %}", "{{ 'a }}"])
def test_what_is_refused(source):
    with pytest.raises(T.TemplateError):
        T.parse(source)


def test_nothing_outside_the_values_is_reachable():
    assert render("{{ x.__class__ }}{{ x['keys'] }}{{ s.upper }}", x={"a": 1}, s="t")[0] == ""


def test_round_trip_of_control_strings():
    rng = random.Random(3)
    parts = ["</s>", "[INST]", " [/INST]", "[ROLE]", "[TEXT]", "[/ROLE]", "\\", "<", "[", "/s>", "INST] ", "a", " ", "\n", "<s>", "é"]
    for _ in range(800):
        draw = lambda: "".join(rng.choice(parts) for _ in range(rng.randint(0, 8)))
        messages = [{"role": rng.choice(["user", "assistant", "system", "", draw()]), "text": draw()} for _ in range(rng.randint(0, 5))]
        out, spans = C.format_one(messages)
        assert C.read_turns(out[3:]) == [(m["role"], m["text"]) for m in messages]
        assert [C.unescape(out[a:b]) for a, b in spans] == [m["text"] for m in messages if m["role"] == "assistant"]


def test_conversations(spark):
    given = [
        (1, 1, "assistant", "yes </s>"), (1, 0, "user", "[INST] \\ hé"), (1, 2, "user", None), (1, 3, "assistant", "fin"),
        (2, None, None, None), (2, 5, "assistant", ""), (None, 0, "user", "x"), (None, 0, "user", "x"), (3, 0, "tool", "t"), (3, 0, "assistant", "s"),
    ]
    df = spark.createDataFrame([(*g, "clash", 1) for g in given], "conv_id bigint, turn bigint, role string, text string, formatted string, key int")
    got = {r["conv_id"]: r for r in rows(C.conversation_digests(df))}
    full = {r["conv_id"]: r for r in rows(C.formatted_conversations(df))}
    for key in {g[0] for g in given}:
        turns = sorted(((g[1] is not None, g[1] or 0, g[2] or "", g[3] or "") for g in given if g[0] == key))
        learned = "".join(t[3] for t in turns if t[2] == "assistant")
        digest = hashlib.sha256("".join(f"{t[2]}\n{t[3]}\n" for t in turns).encode()).hexdigest()
        r = got[key]
        assert (r["n_turns"], r["turns_sha256"], r["loss_chars"]) == (len(turns), digest, len(learned))
        assert r["loss_sha256"] == hashlib.sha256(learned.encode()).hexdigest() and r["formatted_chars"] == len(full[key]["formatted"])
    assert C.conversation_digests(df.where("false")).count() == 0


def test_long_conversation_streams(spark):
    long = spark.range(30_000).selectExpr("5L conv_id", "id turn", "if(id % 2 = 0, 'user', 'assistant') role", "concat('[INST] ', id) text")
    r = rows(C.conversation_digests(long))[0]
    assert r["n_turns"] == 30_000 and r["loss_chars"] == sum(len(f"[INST] {k}") for k in range(1, 30_000, 2))
