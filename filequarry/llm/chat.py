"""Chat formatting: records of many layouts to canonical turns, then to one marked string.

A record is a variant. Its nested field paths, values and types left out, are hashed to a
fingerprint (``layout_fingerprint``). Where they are exactly those of a declarative mapping (which
path holds the turns or the prompt and the answer, which keys hold role and text), its fingerprint
selects that mapping; a record with further fields takes the first mapping, in the order given, all
of whose paths it has, null values included. A record that fits none gets null for layout and turns.
All of it is built-in functions, one shuffle where turns come as rows.

Template, for each turn: ``<|im_start|>role``, a newline, the text, ``<|im_end|>``, a newline.
Control strings inside a text or role get a backslash after their first character, and those with
backslashes there one more, so ``unescape`` gives back every text exactly. In roles a backslash
and a newline are written as two characters, too.

Null text or role counts as empty. Equal turn numbers are ordered by role, then text; a null turn
number comes first and null ids form one conversation. Null turns give a null string and mask, no
turns empty ones. No rows give no rows.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

START, END = "<|im_start|>", "<|im_end|>\n"
#: What a text may not contain unescaped, after its first character.
CONTROL = r"(\|im_start\|>|\|im_end\|>|\|endoftext\|>|/?s>|/?INST\]|/?SYS>>)"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, r"([<\[])(\\*)" + CONTROL, r"$1\\$2$3")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"([<\[])\\(\\*)" + CONTROL, "$1$2$3")


def escape_role(role: Column) -> Column:
    return F.replace(F.replace(escape(role), F.lit("\\"), F.lit("\\\\")), F.lit("\n"), F.lit("\\n"))


def unescape_role(role: Column) -> Column:
    lines = F.regexp_replace(role, r"(?<!\\)((?:\\\\)*)\\n", "$1\n")  # after an even number of backslashes
    return unescape(F.replace(lines, F.lit("\\\\"), F.lit("\\")))


@dataclass(frozen=True)
class Mapping:
    """Turns at ``turns`` with keys ``role`` and ``text``, or single fields in ``fields`` as (path, role)."""

    name: str
    turns: str = ""
    role: str = ""
    text: str = ""
    fields: tuple[tuple[str, str], ...] = ()

    foreign: bool = True
    """Whether roles go by other names, in ``ROLES``."""

    @property
    def shape(self) -> str:
        """The nested field paths of a record that has the mapping's paths and no more, as ``shape`` gives them."""
        if not self.turns:
            return f"OBJECT<{', '.join(sorted(p[2:] for p, _ in self.fields))}>"
        out = f"ARRAY<OBJECT<{', '.join(sorted((self.role, self.text)))}>>"
        for name in reversed(self.turns[2:].split(".")):
            out = f"OBJECT<{name}: {out}>"
        return out


#: Layouts known so far; further ones are passed to ``canonical_turns``.
MAPPINGS = (
    Mapping("messages", "$.messages", "role", "content"),
    Mapping("conversations", "$.conversations", "from", "value"),
    Mapping("turns", "$.turns", "role", "text", foreign=False),
    Mapping("prompt_completion", fields=(("$.prompt", "user"), ("$.completion", "assistant"))),
    Mapping("prompt_response", fields=(("$.prompt", "user"), ("$.response", "assistant"))),
    Mapping("instruction", fields=(("$.instruction", "user"), ("$.output", "assistant"))),
    Mapping("instruction_input", fields=(("$.instruction", "system"), ("$.input", "user"), ("$.output", "assistant"))),
    Mapping("question_answer", fields=(("$.question", "user"), ("$.answer", "assistant"))),
    Mapping("nested_data", "$.data.messages", "role", "content"),
)
#: Names of roles in other layouts; rows made to records by ``rows_to_records`` keep theirs.
ROLES = {"human": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant"}


def shape(record: Column) -> Column:
    """The record's nested field paths, keys in order: its schema without the types of single values."""
    return F.regexp_replace(F.schema_of_variant(record), r": (?!OBJECT<|ARRAY<)[A-Z_]+(\([0-9, ]+\))?", "")


def fits(record: Column, m: Mapping) -> Column:
    """Whether the record has all paths of the mapping, be their values null; an array's keys are its
    elements' own, so an empty array fits none."""
    if not m.turns:
        return _all(F.try_variant_get(record, p, "variant").isNotNull() for p, _ in m.fields)
    rows = F.try_variant_get(record, m.turns, "array<map<string, variant>>")
    return _all(F.exists(rows, lambda r: F.map_contains_key(r, k)) for k in (m.role, m.text))


def _all(tests) -> Column:
    return reduce(lambda a, b: a & b, [F.coalesce(t, F.lit(False)) for t in tests])


def canonical_turns(records: DataFrame, record: str = "record", mappings: tuple[Mapping, ...] = MAPPINGS) -> DataFrame:
    """Adds layout_fingerprint, layout (the mapping's name) and turns, array of struct(role, text);
    columns of these names are replaced, all others kept. An empty array of turns shows no layout, but no turns either."""
    v = F.col(record)
    print_ = F.xxhash64(shape(v))
    exact = [F.when(print_ == F.xxhash64(F.lit(m.shape)), F.lit(m.name)) for m in mappings]
    layout = F.coalesce(*exact, *(F.when(fits(v, m), F.lit(m.name)) for m in mappings))

    def turns(m: Mapping) -> Column:
        if m.turns:
            got = F.try_variant_get(v, m.turns, f"array<struct<{m.role}: string, {m.text}: string>>")
            return F.transform(got, lambda t: turn(m, t[m.role], t[m.text]))
        return F.array(*(turn(m, F.lit(role), F.try_variant_get(v, p, "string")) for p, role in m.fields))

    def turn(m: Mapping, role: Column, text: Column) -> Column:
        others = [F.when(role == a, F.lit(b)) for a, b in ROLES.items()] if m.foreign else []
        return F.struct(F.coalesce(*others, role, F.lit("")).alias("role"), F.coalesce(text, F.lit("")).alias("text"))

    out = records.withColumns({"layout_fingerprint": print_, "layout": layout})
    none = F.array().cast("array<struct<role:string, text:string>>")
    empty = (F.when(F.size(F.try_variant_get(v, m.turns, "array<variant>")) == 0, none) for m in mappings if m.turns)
    return out.withColumn("turns", F.coalesce(*(F.when(F.col("layout") == m.name, turns(m)) for m in mappings), *empty))


def rows_to_records(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """conv, record: one variant for each conversation, its rows as ``turns``."""
    blank = [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(n) for c, n in ((role, "role"), (text, "text"))]
    row = F.struct(F.col(turn).alias("turn"), *blank)
    ordered = F.array_sort(F.collect_list(row), lambda a, b: _compare(a, b, ("turn", "role", "text")))
    turns = F.transform(ordered, lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text")))
    grouped = rows.groupBy(F.col(conv).alias("conv_id")).agg(turns.alias("turns"))
    return grouped.select("conv_id", F.to_variant_object(F.struct("turns")).alias("record"))


def _compare(a: Column, b: Column, keys: tuple[str, ...]) -> Column:
    out = F.lit(0)
    for k in reversed(keys):
        x, y = a[k], b[k]
        out = F.when(x.isNull() & y.isNotNull(), -1).when(x.isNotNull() & y.isNull(), 1).when(x < y, -1).when(x > y, 1).otherwise(out)
    return out


def format_turns(records: DataFrame, turns: str = "turns") -> DataFrame:
    """Adds formatted (string) and loss_mask (array of struct(start, end), code points of assistant texts)."""

    def piece(t: Column) -> Column:
        return F.concat(F.lit(START), escape_role(t["role"]), F.lit("\n"), escape(t["text"]), F.lit(END))

    def sizes(t: Column) -> Column:
        head, size = F.length(escape_role(t["role"])) + len(START) + 1, F.length(escape(t["text"]))
        return F.struct(head.alias("h"), size.alias("s"), (t["role"] == "assistant").alias("own"))

    spans = F.aggregate(
        F.transform(turns, sizes),
        F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<struct<start: bigint, end: bigint>>").alias("spans")),
        lambda acc, x: F.struct(
            (acc["at"] + x["h"] + x["s"] + len(END)).alias("at"),
            F.when(x["own"], F.concat(acc["spans"], F.array(F.struct((acc["at"] + x["h"]).alias("start"), (acc["at"] + x["h"] + x["s"]).alias("end"))))).otherwise(acc["spans"]).alias("spans"),
        ),
        lambda acc: acc["spans"],
    )
    return records.withColumn("formatted", F.array_join(F.transform(turns, piece), "")).withColumn("loss_mask", spans)


def read_back(formatted: Column) -> Column:
    """Turns, array of struct(role, text), from a formatted string alone."""
    parts = F.filter(F.split(formatted, r"<\|im_end\|>\n"), lambda p: p != "")
    body = F.transform(parts, lambda p: F.substring(p, len(START) + 1, 1 << 30))
    return F.transform(body, lambda b: F.struct(unescape_role(F.substring_index(b, "\n", 1)).alias("role"), unescape(F.substring(b, F.instr(b, "\n") + 1, F.lit(1 << 30))).alias("text")))


def loss_text(formatted: Column, loss_mask: Column) -> Column:
    """All text under the mask, unescaped, nothing between."""
    return F.array_join(F.transform(loss_mask, lambda s: unescape(F.substring(formatted, (s["start"] + 1).cast("int"), (s["end"] - s["start"]).cast("int")))), "")
