"""Chat formatting: heterogeneous prompt, instruction and message records to one template.

A record is a JSON text. Its nested field paths, without the scalar types, are
hashed; the hash selects a declarative mapping, which names where roles and texts
lie. The mapped turns go through a reversible template. Everything is built from
SQL functions.

Cases: a null text is an empty one; a record that is no JSON, or whose layout no
mapping declares, has a null ``layout`` and no turns; an empty table gives an
empty one; columns besides the record's are carried along unchanged, and those
named ``layout``, ``turns``, ``formatted`` or ``loss_spans`` are replaced. A
conversation is one row, so it must fit in one string (2 GB). The layout of a record
that VARIANT cannot hold is read from a copy without its texts; one whose layout alone
is too large for VARIANT is an error.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TURNS = "array<struct<role:string,text:string>>"

#: Markers of the template, each with a space to the text. Fixed values.
OPEN_CLOSE = {"system": ("<<SYS>> ", " <</SYS>>"), "user": ("[INST] ", " [/INST]"), "assistant": ("<s> ", " </s>")}
OTHER = ("<|role|> ", " <|text|> ", " <|end|>")
#: Strings with a meaning in the template; inside texts they get a backslash after their first character.
CONTROL = ["<<SYS>>", "<</SYS>>", "[INST]", "[/INST]", "<s>", "</s>", "<|role|>", "<|text|>", "<|end|>"]

_SCALARS = r"(STRING|BIGINT|DOUBLE|FLOAT|BOOLEAN|VOID|VARIANT|DATE|TIMESTAMP_NTZ|TIMESTAMP|BINARY|DECIMAL\([0-9]+,[0-9]+\))"

#: A valid JSON string without its quotes; possessive, so that length costs no stack.
_STRING = r'[^"\\\x00-\x1f]*+(?:\\(?:["\\/bfnrt]|u[0-9A-Fa-f]{4})[^"\\\x00-\x1f]*+)*+'
#: Above so many characters a record, or its copy without texts, may pass a limit of VARIANT or of its parser.
LARGE = 4_000_000
#: Jackson's own limit is 20,000,000 characters.
_ANY_LENGTH = {"maxStringLen": str(2**31 - 1)}


@dataclass(frozen=True)
class Mapping:
    """How a layout becomes turns.

    ``shapes`` are the layouts as nested field names: ``{}`` for objects, ``[]`` for arrays, names in order.
    With ``items`` the turns are that array's objects; without, they are ``fields``: pairs of role and the
    names whose non-empty texts are joined by a blank line.
    """

    name: str
    shapes: tuple[str, ...]
    items: str = ""
    role: str = "role"
    text: str = "content"
    roles: dict[str, str] = field(default_factory=dict)
    fields: tuple[tuple[str, tuple[str, ...]], ...] = ()


MAPPINGS = (
    Mapping("messages", ("{messages[{content,role}]}", "{messages[{role}]}", "{messages[]}"), items="messages"),
    Mapping("conversations", ("{conversations[{from,value}]}", "{conversations[]}"), items="conversations", role="from", text="value", roles={"human": "user", "gpt": "assistant"}),
    Mapping("prompt", ("{prompt,response}", "{prompt}"), fields=(("user", ("prompt",)), ("assistant", ("response",)))),
    Mapping(
        "instruction",
        ("{instruction,output}", "{input,instruction,output}", "{instruction,output,system}", "{input,instruction,output,system}"),
        fields=(("system", ("system",)), ("user", ("instruction", "input")), ("assistant", ("output",))),
    ),
)


def _quoted(name: str) -> str:
    return "'" + name.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _bare(record: Column) -> Column:
    """A record of the same shape: texts become empty, of equal flat objects in a row one is left; keys and what is no JSON stay."""
    out = F.regexp_replace(record, rf'("{_STRING}"\s*+:)|(")(?:{_STRING})(")', "$1$2$3")
    return F.regexp_replace(out, r"(\{[^{}\[\]]*+\})(?:\s*+,\s*+\1)++", "$1")


def _large(bare: Column) -> Column:
    """Schema of a large record's bare copy. JSON that VARIANT cannot hold even so is an error, no empty conversation."""
    valid = F.from_json(bare, "map<string,string>", _ANY_LENGTH).isNotNull()
    error = F.raise_error(F.lit("chat: a record's layout is too large for VARIANT")).cast("string")
    return F.coalesce(F.schema_of_variant(F.try_parse_json(bare)), F.when((F.length(bare) > LARGE) & valid, error))


def shape(record: Column) -> Column:
    """Nested field names of a JSON text: ``{messages[{content,role}]}``; null where it is no JSON."""
    s = F.schema_of_variant(F.try_parse_json(record))
    s = F.coalesce(s, F.when(F.length(record) > LARGE, _large(_bare(record))))
    s = F.regexp_replace(s, rf"(: |ARRAY<|^){_SCALARS}(?=[,>]|$)", "$1")
    s = F.replace(F.replace(s, F.lit("OBJECT<"), F.lit("{")), F.lit("ARRAY<"), F.lit("["))
    # the closing brackets are told apart by nothing but their partner; one kind is enough for a fingerprint
    return F.regexp_replace(F.replace(s, F.lit(": "), F.lit("")), ", ", ",")


def _same(declared: str) -> str:
    """A declared shape as ``shape`` writes it."""
    return declared.replace("}", ">").replace("]", ">")


def fingerprint(record: Column) -> Column:
    return F.sha2(shape(record), 256)


def _mapped(record: Column, m: Mapping) -> Column:
    if m.items:
        kind = f"struct<`{m.items}`:array<struct<`{m.role}`:string,`{m.text}`:string>>>"
        items = F.from_json(record, kind, _ANY_LENGTH)[m.items]

        def turn(x: Column) -> Column:
            role = F.coalesce(x[m.role], F.lit(""))
            for old, new in m.roles.items():
                role = F.when(x[m.role] == old, new).otherwise(role)
            return F.struct(role.alias("role"), F.coalesce(x[m.text], F.lit("")).alias("text"))

        return F.transform(items, turn)
    names = [n for _, group in m.fields for n in group]
    parsed = F.from_json(record, "struct<" + ",".join(f"`{n}`:string" for n in names) + ">", _ANY_LENGTH)
    turns = []
    for role, group in m.fields:
        there = F.coalesce(*[parsed[n] for n in group])
        text = F.array_join(F.filter(F.array(*[parsed[n] for n in group]), lambda x: x != ""), "\n\n")
        turns.append(F.when(there.isNotNull(), F.struct(F.lit(role).alias("role"), text.alias("text"))))
    return F.array_compact(F.array(*turns))


def to_turns(df: DataFrame, record: str = "record", mappings: tuple[Mapping, ...] = MAPPINGS) -> DataFrame:
    """Adds ``layout`` and ``turns``: the mapping that the fingerprint selects, and what it gives."""
    by = {hashlib.sha256(_same(s).encode()).hexdigest(): m for m in mappings for s in m.shapes}
    df = df.withColumn("_fp", fingerprint(F.col(record)))
    layout, turns = F.lit(None).cast("string"), F.array().cast(TURNS)
    for m in mappings:
        own = F.col("_fp").isin([k for k, v in by.items() if v is m])
        layout = F.when(own, m.name).otherwise(layout)
        turns = F.when(own, _mapped(F.col(record), m)).otherwise(turns)
    return df.withColumn("layout", layout).withColumn("turns", F.coalesce(turns.cast(TURNS), F.array().cast(TURNS))).drop("_fp")


def escape(text: Column) -> Column:
    """Backslashes are doubled, then control strings broken by one, so none is left."""
    out = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    return F.regexp_replace(out, "|".join(rf"(?<=(?=\Q{c}\E).)" for c in CONTROL), r"\\")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def _piece(t: Column) -> Column:
    """A turn in the template, with the place and length of its text."""
    text, head, tail = escape(t["text"]), F.concat(F.lit(OTHER[0]), escape(t["role"]), F.lit(OTHER[1])), F.lit(OTHER[2])
    for role, (a, b) in OPEN_CLOSE.items():
        head, tail = F.when(t["role"] == role, a).otherwise(head), F.when(t["role"] == role, b).otherwise(tail)
    return F.struct(t["role"].alias("role"), head.alias("head"), text.alias("text"), tail.alias("tail"))


def format_turns(df: DataFrame, loss_roles: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """Adds ``formatted`` and ``loss_spans`` (start from 0 and length, in code points of ``formatted``)."""
    df = df.withColumn("_pieces", F.transform("turns", _piece))
    one = lambda p: F.concat(p["head"], p["text"], p["tail"])
    empty = F.array().cast("array<struct<start:bigint,length:bigint>>")

    def step(acc: Column, p: Column) -> Column:
        n = F.length(p["text"]).cast("bigint")
        at = acc["at"] + F.length(p["head"])
        span = F.array(F.struct(at.alias("start"), n.alias("length")))
        return F.struct((at + n + F.length(p["tail"])).alias("at"), F.when(p["role"].isin(*loss_roles), F.concat(acc["spans"], span)).otherwise(acc["spans"]).alias("spans"))

    start = F.struct(F.lit(0).cast("bigint").alias("at"), empty.alias("spans"))
    return (
        df.withColumn("formatted", F.array_join(F.transform("_pieces", one), ""))
        .withColumn("loss_spans", F.aggregate("_pieces", start, step, lambda acc: acc["spans"]))
        .drop("_pieces")
    )


def read_turns(formatted: Column) -> Column:
    """The turns that a formatted text was made of."""
    lit = lambda s: rf"\Q{s}\E"
    kinds = [f"{lit(a)}.*?{lit(b)}" for a, b in [*OPEN_CLOSE.values(), (OTHER[0], OTHER[2])]]
    pieces = F.regexp_extract_all(formatted, F.lit(f"(?s){'|'.join(kinds)}"), F.lit(0))

    def turn(p: Column) -> Column:
        body = F.substring_index(F.substr(p, F.lit(len(OTHER[0]) + 1)), OTHER[1], 1)
        role, text = unescape(body), F.substr(p, F.lit(len(OTHER[0]) + len(OTHER[1]) + 1) + F.length(body), F.length(p) - F.length(body) - sum(map(len, OTHER)))
        for name, (a, b) in OPEN_CLOSE.items():
            own = F.startswith(p, F.lit(a))
            role = F.when(own, name).otherwise(role)
            text = F.when(own, F.substr(p, F.lit(len(a) + 1), F.length(p) - len(a) - len(b))).otherwise(text)
        return F.struct(role.alias("role"), unescape(text).alias("text"))

    return F.transform(pieces, turn)


def loss_text(formatted: Column, spans: Column) -> Column:
    """All text under the loss mask, as it was before formatting."""
    return F.array_join(F.transform(spans, lambda s: unescape(F.substr(formatted, (s["start"] + 1).cast("int"), s["length"].cast("int")))), "")
