"""Questions as columns: option rows, keys, signatures, presentations and prompt text.

A question is ``qtype`` plus ``options ARRAY<STRUCT<key STRING, text STRING>>`` in order; option
order carries meaning, so no MAP is used. ``text`` is NULL for an option without a description.
"""

from __future__ import annotations

from collections.abc import Sequence
from math import factorial

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Fixed texts and keys of the data model.
IDK_TEXT = "I don't know"
QUESTION_TEXT = "Which option correctly answers the question?"
NOUL_KEYS = ("true", "false")
NOUL_LABELS = ("Yes", "No")
ANSWER_PREFILL = "Answer:"
RESPOND_WITH = {
    "letters": "the letter",
    "digits": "the digit",
    "yes_no": "Yes or No",
    "keys": "the option name",
}
MAX_BANK_OPTIONS = 25
LETTER_CAPACITY = 52
DIGIT_CAPACITY = 10


def letter(index: Column) -> Column:
    """``A``..``Z`` then ``a``..``z`` for 0..51."""
    return F.char(F.when(index < 26, index + 65).otherwise(index + 71).cast("int"))


def code(index: Column) -> Column:
    """Two-capital codes ``AA``, ``AB``, ... for 0..675."""
    return F.concat(F.char((F.floor(index / 26) + 65).cast("int")), F.char((index % 26 + 65).cast("int")))


def lettered_options(texts: Column) -> Column:
    """Option texts keyed ``A``, ``B``, ... in the given order."""
    return F.transform(texts, lambda t, i: F.struct(letter(i).alias("key"), t.alias("text")))


def named_options(keys: Column) -> Column:
    """Options that are their own names, without descriptions."""
    return F.transform(
        keys, lambda k: F.struct(k.alias("key"), F.lit(None).cast("string").alias("text"))
    )


def level_options(levels: Column) -> Column:
    """Ordered levels keyed ``"0"``, ``"1"``, ..."""
    return F.transform(levels, lambda t, i: F.struct(i.cast("string").alias("key"), t.alias("text")))


def noul_options() -> Column:
    return F.array(
        *[
            F.struct(F.lit(k).alias("key"), F.lit(None).cast("string").alias("text"))
            for k in NOUL_KEYS
        ]
    )


def keys_of(options: Column) -> Column:
    return F.transform(options, lambda o: o["key"])


def texts_of(options: Column) -> Column:
    return F.transform(options, lambda o: o["text"])


def answer_keys(qtype: Column, options: Column) -> Column:
    """Keys an answer is reported under: option keys, level numbers, or true/false."""
    levels = F.transform(options, lambda o, i: i.cast("string"))
    return (
        F.when(qtype == "choice", keys_of(options))
        .when(qtype == "score", levels)
        .otherwise(F.array(*[F.lit(k) for k in NOUL_KEYS]))
    )


def signature(qtype: Column, options: Column) -> Column:
    """``<type>:<K>:<16 hex>`` of the answer space: option keys of a choice, level texts of a
    score question, the fixed keys of a yes-no question. Option descriptions do not enter."""
    space = (
        F.when(qtype == "choice", keys_of(options))
        .when(qtype == "score", texts_of(options))
        .otherwise(F.array(*[F.lit(k) for k in NOUL_KEYS]))
    )
    digest = F.substring(F.sha2(F.to_json(space), 256), 1, 16)
    return F.concat_ws(":", qtype, F.size(space).cast("string"), digest)


def free_positions(
    qtype: Column, options: Column, fixed_texts: Sequence[str] = (IDK_TEXT,)
) -> Column:
    """Per option: may it move and be debiased. Only choice options can be fixed."""
    fixed = F.array(*[F.lit(t) for t in fixed_texts])
    return F.transform(
        options,
        lambda o: ~F.coalesce((qtype == "choice") & F.array_contains(fixed, o["text"]), F.lit(False)),
    )


def prior_key(sig: Column, free: Column) -> Column:
    """The signature, plus ``|fixed=<positions>`` when some position is fixed."""
    fixed = F.filter(F.transform(free, lambda f, i: F.when(~f, i.cast("string"))), lambda x: x.isNotNull())
    return F.when(F.size(fixed) > 0, F.concat(sig, F.lit("|fixed="), F.array_join(fixed, ","))).otherwise(
        sig
    )


def idk_key(options: Column) -> Column:
    """Key of the last "I don't know" option, NULL without one."""
    found = F.filter(options, lambda o: o["text"] == IDK_TEXT)
    return F.when(F.size(found) > 0, F.try_element_at(found, F.lit(-1))["key"])


def render_options(options: Column) -> Column:
    """``<key>) <text>`` lines."""
    return F.array_join(F.transform(options, lambda o: F.concat(o["key"], F.lit(") "), o["text"])), "\n")


def options_sha256(options: Column) -> Column:
    return F.sha2(render_options(options), 256)


def bank_instructions(n_options: Column, idk: bool) -> Column:
    if not idk:
        return F.lit(QUESTION_TEXT)
    return F.concat(
        F.lit(QUESTION_TEXT + " A wrong answer costs 1 point, a correct answer earns 1 point, and "),
        letter(n_options),
        F.lit(f" ({IDK_TEXT}) earns 0."),
    )


# --- orders ------------------------------------------------------------------------------------


def rotate(order: Column, shift: Column) -> Column:
    """``order`` rotated left by ``shift`` (0 <= shift < size)."""
    n = F.size(order)
    return F.concat(F.slice(order, shift + 1, n - shift), F.slice(order, F.lit(1), shift))


def free_slots(free: Column) -> Column:
    return F.filter(F.transform(free, lambda f, i: F.when(f, i)), lambda x: x.isNotNull())


def shifted_order(free: Column, shift: Column) -> Column:
    """The option order of one cyclic shift of the free positions (fixed positions stay)."""
    slots = free_slots(free)
    n = F.size(slots)

    def place(f: Column, i: Column) -> Column:
        rank = F.array_position(slots, i) - 1
        return F.when(f, F.get(slots, ((rank + shift) % n).cast("int"))).otherwise(i)

    return F.transform(free, place)


def cyclic_shifts(free: Column, n_shifts: int | None = None) -> Column:
    """Shifts to present: every one, or ``n_shifts`` evenly spaced ones; just 0 below two free
    positions."""
    n = F.size(free_slots(free))
    if n_shifts is None:
        shifts = F.sequence(F.lit(0), n - 1)
    else:
        wanted = F.greatest(F.lit(1), F.least(F.lit(n_shifts), n))
        shifts = F.array_sort(
            F.array_distinct(
                F.transform(
                    F.sequence(F.lit(0), wanted - 1),
                    lambda j: (F.rint(j * n / wanted).cast("int") % n),
                )
            )
        )
    return F.when(n < 2, F.array(F.lit(0))).otherwise(shifts)


def is_letter_keyed(options: Column) -> Column:
    expected = F.transform(options, lambda o, i: letter(i))
    return keys_of(options) == expected


def present(options: Column, order: Column) -> Column:
    """Options shown in ``order`` (``order[i]`` = original index at position i): letter keys stay
    in place and the texts move, named options move whole."""
    moved = F.transform(order, lambda j: F.get(options, j.cast("int")))
    lettered = F.transform(
        order,
        lambda j, i: F.struct(
            F.get(options, i.cast("int"))["key"].alias("key"),
            F.get(options, j.cast("int"))["text"].alias("text"),
        ),
    )
    return F.when(is_letter_keyed(options), lettered).otherwise(moved)


# --- prompts -----------------------------------------------------------------------------------

# How a JSON string writes the characters it cannot hold as they are.
JSON_ESCAPES = {"\\": "\\\\", '"': '\\"', "\n": "\\n", "\r": "\\r", "\t": "\\t", "\b": "\\b", "\f": "\\f"}
JSON_ESCAPES |= {chr(c): f"\\u{c:04x}" for c in range(32) if chr(c) not in JSON_ESCAPES}


def json_string(text: Column) -> Column:
    """A JSON string literal; characters beyond ASCII stay as they are."""
    escaped = text
    for char, written in JSON_ESCAPES.items():
        escaped = F.replace(escaped, F.lit(char), F.lit(written))
    return F.concat(F.lit('"'), F.when(text.rlike(r'[\x00-\x1F"\\]'), escaped).otherwise(text), F.lit('"'))


def json_number(value: Column) -> Column:
    """A double in the shortest digits that read back as it: plain from 1e-4 to 1e16, else with an
    exponent of two digits or more; whole numbers end in ``.0``."""
    text = F.lit(None).cast("string")
    for digits in (14, 15, 16):
        written = F.format_string(f"%.{digits}e", value)
        text = F.coalesce(text, F.when((written.try_cast("double") == value) | F.lit(digits == 16), written))
    parts = F.split(F.regexp_replace(text, "^-", ""), "e")
    significant = F.regexp_replace(F.replace(F.get(parts, F.lit(0)), F.lit("."), F.lit("")), "(?<=.)0+$", "")
    point = F.get(parts, F.lit(1)).cast("int") + 1  # the value is 0.<significant> * 10^point
    small = F.concat(F.lit("0."), F.repeat(F.lit("0"), F.greatest(-point, F.lit(0))), significant)
    large = F.when(F.length(significant) <= point, F.concat(F.rpad(significant, point, "0"), F.lit(".0"))).otherwise(
        F.concat(F.left(significant, point), F.lit("."), F.substring(significant, point + 1, F.length(significant)))
    )
    first, others = F.left(significant, F.lit(1)), F.substring(significant, 2, 400)
    power = point - 1
    sign = F.when(power < 0, "-").otherwise("+")
    scientific = F.concat(
        first, F.when(others == "", "").otherwise(F.concat(F.lit("."), others)), F.lit("e"), sign, F.lpad(F.abs(power).cast("string"), F.greatest(F.length(F.abs(power).cast("string")), F.lit(2)), "0")
    )
    plain = F.when(value == 0, F.lit("0.0")).when((point > 16) | (point < -3), scientific).when(point <= 0, small).otherwise(large)
    signed = F.concat(F.when(text.startswith("-"), "-").otherwise(""), plain)
    return F.when(F.isnan(value), F.lit("NaN")).when(F.abs(value) == float("inf"), F.when(value > 0, "Infinity").otherwise("-Infinity")).otherwise(signed)


def json_text(value: Column, kind: T.DataType, indent: int = 0) -> Column:
    """``value`` as indented JSON (two spaces a level), by its data type ``kind``: structs and maps are
    objects with their fields or entries in order, arrays are lists, what is neither text, number nor
    truth value is written as a string, and NULL is ``null``."""
    inner, outer = "\n" + "  " * (indent + 1), "\n" + "  " * indent

    def block(entries: Column, opening: str, closing: str) -> Column:
        return F.when(F.size(entries) == 0, F.lit(opening + closing)).otherwise(
            F.concat(F.lit(opening + inner), F.array_join(entries, "," + inner), F.lit(outer + closing))
        )

    if isinstance(kind, T.StructType):
        fields = [F.concat(json_string(F.lit(f.name)), F.lit(": "), json_text(value[f.name], f.dataType, indent + 1)) for f in kind.fields]
        written = block(F.array(*fields) if fields else F.array().cast("array<string>"), "{", "}")
    elif isinstance(kind, T.MapType):
        entries = F.transform(F.map_entries(value), lambda e: F.concat(json_string(e["key"].cast("string")), F.lit(": "), json_text(e["value"], kind.valueType, indent + 1)))
        written = block(entries, "{", "}")
    elif isinstance(kind, T.ArrayType):
        written = block(F.transform(value, lambda x: json_text(x, kind.elementType, indent + 1)), "[", "]")
    elif isinstance(kind, (T.DoubleType, T.FloatType)):
        written = json_number(value.cast("double"))
    elif isinstance(kind, (T.IntegralType, T.DecimalType, T.BooleanType)):
        written = value.cast("string")
    else:
        written = json_string(value.cast("string"))
    return F.coalesce(written, F.lit("null"))


def render_value(value: Column, kind: T.DataType) -> Column:
    """A state, instruction or description as prompt text: strings as they are, anything structured as
    :func:`json_text`; NULL stays NULL (it is left out of a prompt)."""
    return value if isinstance(kind, T.StringType) else F.when(value.isNotNull(), json_text(value, kind))



def _question_block(qtype: Column, instructions: Column, options: Column, scheme: Column) -> Column:
    described = lambda o: F.coalesce(F.concat(F.lit(": "), o["text"]), F.lit(""))
    choice = F.array_join(
        F.transform(
            options,
            lambda o, i: F.concat(
                F.when(scheme == "keys", F.lit("- "))
                .when(scheme == "codes", F.concat(code(i), F.lit(") ")))
                .otherwise(F.concat(letter(i), F.lit(") "))),
                o["key"],
                described(o),
            ),
        ),
        "\n",
    )
    levels = F.array_join(
        F.transform(
            options,
            lambda o, i: F.concat(
                i.cast("string"), F.lit(")"), F.coalesce(F.concat(F.lit(" "), o["text"]), F.lit(""))
            ),
        ),
        "\n",
    )
    labels = F.array(*[F.lit(x) for x in NOUL_LABELS])
    criteria = F.array_join(
        F.filter(
            F.transform(
                options, lambda o, i: F.concat(F.get(labels, i.cast("int")), F.lit(": "), o["text"])
            ),
            lambda line: line.isNotNull(),
        ),
        "\n",
    )
    body = (
        F.when(qtype == "choice", F.concat(F.lit("Options:\n"), choice, F.lit("\n\n")))
        .when(qtype == "score", F.concat(F.lit("Levels:\n"), levels, F.lit("\n\n")))
        .when(criteria != "", F.concat(F.lit("Criteria:\n"), criteria, F.lit("\n\n")))
        .otherwise(F.lit(""))
    )
    asked = F.coalesce(F.concat(F.lit("Question:\n"), instructions, F.lit("\n\n")), F.lit(""))
    # Codes are worded like letters.
    respond = F.lit(RESPOND_WITH["letters"])
    for name, words in RESPOND_WITH.items():
        respond = F.when(scheme == name, F.lit(words)).otherwise(respond)
    return F.concat(asked, body, F.lit("Respond with "), respond, F.lit(" only."))


def render_prompt(
    state: Column,
    qtype: Column,
    instructions: Column,
    options: Column,
    scheme: Column,
    layout: str = "state_first",
    prefill: bool = True,
) -> Column:
    """Chat messages ``ARRAY<STRUCT<role, content>>`` asking the question about ``state`` (texts: see
    :func:`render_value` for structured ones)."""
    if layout not in ("state_first", "question_first"):
        raise ValueError(f"unknown layout {layout!r}")
    block = _question_block(qtype, instructions, options, scheme)
    shown = F.concat(F.lit("State:\n"), state)

    def message(role: str, content: Column) -> Column:
        return F.struct(F.lit(role).alias("role"), content.alias("content"))

    if layout == "state_first":
        messages = [message("user", F.concat(shown, F.lit("\n\n"), block))]
    else:
        opening = F.lit("Read the state in the next message, then answer.\n\n")
        messages = [message("system", F.concat(opening, block)), message("user", shown)]
    if prefill:
        messages.append(message("assistant", F.lit(ANSWER_PREFILL)))
    return F.array(*messages)


def scheme_for(qtype: Column, n_options: Column, sequence: bool = False) -> Column:
    """Label scheme of a question, NULL above its capacity. ``sequence`` schemes score whole
    label texts, so choices use their own keys."""
    choice = F.lit("keys") if sequence else F.when(n_options <= LETTER_CAPACITY, F.lit("letters"))
    return (
        F.when(qtype == "choice", choice)
        .when(qtype == "score", F.when(n_options <= DIGIT_CAPACITY, F.lit("digits")))
        .otherwise(F.lit("yes_no"))
    )


def scheme_labels(scheme: Column, options: Column) -> Column:
    """Labels in display order for a scheme."""
    return (
        F.when(scheme == "letters", F.transform(options, lambda o, i: letter(i)))
        .when(scheme == "codes", F.transform(options, lambda o, i: code(i)))
        .when(scheme == "digits", F.transform(options, lambda o, i: i.cast("string")))
        .when(scheme == "keys", keys_of(options))
        .otherwise(F.array(*[F.lit(x) for x in NOUL_LABELS]))
    )


def random_orders(free: Column, n: int, *keys: Column | str) -> Column:
    """The identity and ``n - 1`` other orders of the free positions, all different (all orders, where
    there are fewer). The orders of f positions are numbered from 0 (the identity) to f! - 1; the
    numbers taken are evenly apart from a hashed place on, so none repeats and none is tried twice.
    More than 18 free positions, whose orders outnumber a BIGINT, are shuffled by a hash for each order;
    one order more is drawn than asked for, so that a repeat can be left out."""
    from plumbline.functions.hashing import hash_int, keyed_hash
    from plumbline.functions.vectors import let

    identity = F.transform(free, lambda f, i: i)
    counts = F.array(*[F.lit(factorial(k)).cast("bigint") for k in range(19)])
    whole = lambda a, b: F.call_function("div", a, b)

    def order(m: Column, number: Column) -> Column:
        """The order with this number: its factorial-base digits pick from the positions left."""

        def pick(state: Column, left_after: Column) -> Column:
            weight = F.get(counts, left_after)
            chosen = F.get(state["left"], whole(state["rest"], weight).cast("int"))
            return F.struct(
                F.array_remove(state["left"], chosen).alias("left"),
                F.concat(state["out"], F.array(chosen)).alias("out"),
                (state["rest"] % weight).alias("rest"),
            )

        start = F.struct(m.alias("left"), F.slice(m, 1, 0).alias("out"), number.alias("rest"))
        left_after = F.transform(m, lambda _, i: F.size(m) - 1 - i)
        placed = F.aggregate(left_after, start, pick, lambda s: s["out"])
        at = lambda i: F.array_position(m, i).cast("int")
        return let(placed, lambda o: F.transform(free, lambda _, i: F.when(at(i) > 0, F.get(o, at(i) - 1)).otherwise(i)))

    def others(m: Column) -> Column:
        more = F.get(counts, F.size(m)) - 1  # orders besides the identity
        taken = F.least(F.lit(n - 1).cast("bigint"), more)
        place = F.pmod(hash_int(keyed_hash(*keys, "place")), F.greatest(more, F.lit(1)))
        apart = whole(more, F.greatest(taken, F.lit(1)))
        draw = lambda k: order(m, 1 + F.pmod(place + k * apart, more))
        return F.when(taken < 1, F.slice(F.array(identity), 1, 0)).otherwise(F.transform(F.sequence(F.lit(0).cast("bigint"), taken - 1), draw))

    def shuffled(m: Column) -> Column:
        def draw(k: Column) -> Column:
            hashed = F.array_sort(F.transform(m, lambda s: F.struct(keyed_hash(*keys, "order", k, s).alias("h"), s.alias("s"))))
            at = lambda i: F.array_position(m, i).cast("int")
            return let(hashed, lambda o: F.transform(free, lambda _, i: F.when(at(i) > 0, F.get(o, at(i) - 1)["s"]).otherwise(i)))

        return F.transform(F.sequence(F.lit(1), F.lit(n)), draw)

    drawn = let(free_slots(free), lambda m: F.when(F.size(m) > 18, shuffled(m)).otherwise(others(m)))
    return F.slice(F.array_distinct(F.concat(F.array(identity), drawn)), 1, n)
