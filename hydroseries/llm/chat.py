"""Chat formatting: records of many layouts become canonical turns, turns become one templated string with a loss mask.

A record's layout is told by its schema fingerprint: the SHA-256 of all its nested field paths, types left out, as its variant's schema
shows them. Each known fingerprint selects a declarative mapping, a row of LAYOUTS, and new layouts are added as data. Rows of a table go
the same way: each row is a record of its columns. All of it is Spark SQL.

Defined cases: a null text or role is empty; rows of one conversation are ordered by turn, ties by role and text, nulls first; repeated
rows stay; a record whose fingerprint is unknown has null turns, a row has an empty turn, and a record's fingerprint is kept, so it can be
counted and mapped; a field that is null counts as a field; the fields of a list's items are those of all its items together, and an empty
list or one of unlike items has none; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

TURN, END = "<|turn|>", "<|end|>"
#: In texts these strings must not be mistaken for the template's own marks; each begins with < or [.
CONTROL = (TURN, END, "<s>", "</s>", "[INST]", "[/INST]")
TURNS = "array<struct<role:string,text:string>>"


@dataclass(frozen=True)
class Layout:
    """paths: the nested field paths of a record; list_path, role, text: where its messages are; or fixed: (role, path) pairs; else role, text: of a row."""

    paths: tuple[str, ...]
    list_path: str = ""
    role: str = ""
    text: str = ""
    fixed: tuple[tuple[str, str], ...] = ()
    roles: tuple[tuple[str, str], ...] = ()

    @property
    def fingerprint(self) -> str:
        return paths_fingerprint(self.paths)


def paths_fingerprint(paths) -> str:
    """Of a record with these paths: a.b for the fields of an object, a[] for the items of a list."""
    tree: dict = {}
    for path in paths:
        at = tree
        for name in re.findall(r"\[\]|[^.\[\]]+", path):
            at = at.setdefault(name, {})

    def shape(node: dict) -> str:
        if "[]" in node:
            return f"ARRAY<{shape(node['[]'])}>"
        fields = [f"{k if re.fullmatch('[A-Za-z_][A-Za-z_0-9]*', k) else f'`{k}`'}: {shape(node[k])}" for k in sorted(node)]
        return f"OBJECT<{', '.join(fields)}>" if fields else "_"

    return hashlib.sha256(shape(tree).encode()).hexdigest()


LAYOUTS = (
    Layout(("role", "text"), role="role", text="text"),
    Layout(("messages[].role", "messages[].content"), "$.messages", "role", "content"),
    Layout(("conversations[].from", "conversations[].value"), "$.conversations", "from", "value", roles=(("human", "user"), ("gpt", "assistant"))),
    Layout(("instruction", "output"), fixed=(("user", "$.instruction"), ("assistant", "$.output"))),
    Layout(("instruction", "input", "output"), fixed=(("user", "$.instruction"), ("user", "$.input"), ("assistant", "$.output"))),
    Layout(("prompt", "completion"), fixed=(("user", "$.prompt"), ("assistant", "$.completion"))),
    Layout(("prompt", "response"), fixed=(("user", "$.prompt"), ("assistant", "$.response"))),
    Layout(("system", "prompt", "response"), fixed=(("system", "$.system"), ("user", "$.prompt"), ("assistant", "$.response"))),
)


def variant_fingerprint(value: Column) -> Column:
    """The fingerprint of all nested field paths of a variant; null if it is not an object."""
    schema = F.schema_of_variant(value)
    return F.when(F.startswith(schema, F.lit("OBJECT<")), F.sha2(F.regexp_replace(schema, r"(?<=: |ARRAY<)[A-Z_]+(\([0-9,]*\))?(?=[,>])", "_"), 256))


def record_fingerprint(json_text: Column) -> Column:
    """The fingerprint of each JSON record. A record that is not a JSON object, or is larger than a variant may be, has a null one."""
    return variant_fingerprint(F.try_parse_json(json_text))


def _message(layout: Layout):
    """A function from one message, a variant, to a canonical turn."""

    def turn(v: Column) -> Column:
        role = F.coalesce(F.try_variant_get(v, f"$.{layout.role}", "string"), F.lit(""))
        for was, now in layout.roles:
            role = F.when(role == was, now).otherwise(role)
        return F.struct(role.alias("role"), F.coalesce(F.try_variant_get(v, f"$.{layout.text}", "string"), F.lit("")).alias("text"))

    return turn


def record_turns(json_text: Column, fingerprint: Column, layouts=LAYOUTS) -> Column:
    """Canonical turns of JSON records, by the mapping that the fingerprint selects; null for an unknown layout."""
    value = F.try_parse_json(json_text)
    out = F.lit(None).cast(TURNS)
    for x in layouts:
        if x.fixed:
            pairs = [F.struct(F.lit(role).alias("role"), F.try_variant_get(value, path, "string").alias("text")) for role, path in x.fixed]
            turns = F.filter(F.array(*pairs), lambda t: t["text"].isNotNull() & (t["text"] != ""))
        elif x.list_path:
            items = F.try_variant_get(value, x.list_path, "array<variant>")
            turns = F.transform(items, _message(x))
        else:
            continue
        out = F.when(fingerprint == x.fingerprint, turns.cast(TURNS)).otherwise(out)
    return out


def turns_of_records(df: DataFrame, record: str, layouts=LAYOUTS) -> DataFrame:
    """Adds schema_fingerprint and turns to a table of JSON records."""
    df = df.drop("schema_fingerprint", "turns").withColumn("schema_fingerprint", record_fingerprint(F.col(record)))
    return df.withColumn("turns", record_turns(F.col(record), F.col("schema_fingerprint"), layouts))


def row_fingerprint(df: DataFrame, columns: list[str]) -> Column:
    """The fingerprint of each row of df as a record of these columns. Of strings only whether they are null goes into the variant, so long texts cost nothing."""
    held = [F.when(F.col(c).isNotNull(), F.lit("")).alias(c) if isinstance(df.schema[c].dataType, T.StringType) else F.col(c) for c in columns]
    return variant_fingerprint(F.to_variant_object(F.struct(*held)))


def turns_of_rows(df: DataFrame, key: str = "conv_id", turn: str = "turn", layouts=LAYOUTS) -> DataFrame:
    """One row a conversation from one row a turn: key, turns.

    Each row is a record of those of its columns, besides key and turn, that some row layout names; its fingerprint selects the layout. A
    conversation is the unit that is formatted, so its rows meet in one row; no other group is gathered.
    """
    rows = [x for x in layouts if not x.fixed and not x.list_path]
    named = {p.split(".")[0].removesuffix("[]") for x in rows for p in x.paths}
    columns = [c for c in df.columns if c in named - {key, turn}]
    rows = [x for x in rows if x.role in columns and x.text in columns]
    if not rows:
        raise ValueError("no row layout has these columns: " + ", ".join(df.columns))
    told = df.select(key, turn, *columns, row_fingerprint(df, columns).alias("_layout"))

    def by_layout(column: str) -> Column:
        return F.coalesce(*[F.when(F.col("_layout") == x.fingerprint, F.col(getattr(x, column))) for x in rows], F.lit(""))

    turns = told.select(key, turn, by_layout("role").alias("role"), by_layout("text").alias("text"))
    ordered = F.array_sort(F.collect_list(F.struct(F.col(turn).isNotNull().alias("known"), F.coalesce(turn, F.lit(0)).alias("turn"), "role", "text")))
    return turns.groupBy(key).agg(F.transform(ordered, lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))).alias("turns"))


def escape(text: Column) -> Column:
    """Reversible: afterwards no control string can occur, for each of them begins with < or [."""
    return F.replace(F.replace(F.replace(text, F.lit("~"), F.lit("~0")), F.lit("<"), F.lit("~1")), F.lit("["), F.lit("~2"))


def unescape(text: Column) -> Column:
    return F.replace(F.replace(F.replace(text, F.lit("~2"), F.lit("[")), F.lit("~1"), F.lit("<")), F.lit("~0"), F.lit("~"))


def _escape_role(role: Column) -> Column:
    return F.replace(escape(role), F.lit("\n"), F.lit("~3"))


def _unescape_role(role: Column) -> Column:
    return unescape(F.replace(role, F.lit("~3"), F.lit("\n")))


def format_turns(df: DataFrame, loss_roles: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """Adds formatted, and loss_spans: start (from 0) and length, in code points of formatted, of each text that is trained on."""
    parts = F.transform("turns", lambda t: F.struct(F.concat(F.lit(TURN), _escape_role(t["role"]), F.lit("\n")).alias("head"), escape(t["text"]).alias("body"), t["role"].isin(*loss_roles).alias("loss")))
    df = df.drop("formatted", "loss_spans").withColumn("_parts", parts)
    tail = F.lit(END + "\n")
    spans = F.aggregate(
        "_parts",
        F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,length:int>>").alias("spans")),
        lambda acc, p: F.struct(
            (acc["at"] + F.char_length(p["head"]) + F.char_length(p["body"]) + len(END) + 1).alias("at"),
            F.when(p["loss"], F.concat(acc["spans"], F.array(F.struct((acc["at"] + F.char_length(p["head"])).alias("start"), F.char_length(p["body"]).alias("length"))))).otherwise(acc["spans"]).alias("spans"),
        ),
        lambda acc: acc["spans"],
    )
    text = F.array_join(F.transform("_parts", lambda p: F.concat(p["head"], p["body"], tail)), "")
    return df.withColumn("formatted", text).withColumn("loss_spans", spans).drop("_parts")


def parse_formatted(formatted: Column) -> Column:
    """The turns, read back from a formatted string."""
    pieces = F.slice(F.split(formatted, r"<\|turn\|>"), 2, F.lit(1 << 30))
    return F.transform(
        pieces,
        lambda p: F.struct(
            _unescape_role(F.substring_index(p, "\n", 1)).alias("role"),
            unescape(F.substring(p, F.instr(p, "\n") + 1, F.char_length(p) - F.instr(p, "\n") - len(END) - 1)).alias("text"),
        ),
    )


def loss_text(formatted: Column, spans: Column) -> Column:
    """All text under the loss mask, unescaped, nothing between."""
    return unescape(F.array_join(F.transform(spans, lambda s: F.substring(formatted, s["start"] + 1, s["length"])), ""))
