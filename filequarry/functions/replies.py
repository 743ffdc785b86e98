"""What a model answered: JSON found in its text, and the fields of an analysis."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, functions as F

from filequarry.functions import text

MARK = re.compile(r'"(?:[^"\\]|\\.)*(?:"|\\?\Z)|[{}\[\]]', re.S)
SCALAR = r'^(?:"(?:[^"\\\\]|\\\\.)*"|true|false|null|-?\d[\d.eE+-]*)$'


def unfenced(reply: Column) -> Column:
    """The inside of the first code fence, without its language; the reply itself where there is none."""

    def bare(s: Column) -> Column:
        return text.stripped(F.regexp_replace(s, "^(?i:json)", ""))

    t = text.stripped(reply)
    parts = F.split(t, "```", 3)
    single = bare(F.regexp_replace(F.regexp_replace(F.regexp_replace(t, "^`+", ""), "^(?i:json)", ""), "^`+", ""))
    return F.when(~t.startswith("```"), t).when(F.size(parts) >= 3, bare(F.get(parts, F.lit(1)))).otherwise(single)


def escaped(reply: Column) -> Column:
    """Backslashes that begin no JSON escape are doubled."""
    return F.regexp_replace(reply, r'\\(?!["\\/bfnrtu])', r"\\\\")


def first_value(reply: str | None) -> str | None:
    """The first object or array with all its brackets closed; one that starts later is tried where the first stays open."""
    starts = sorted(k for k in (reply.find("{"), reply.find("[")) if k >= 0) if reply else []
    for start in starts:
        depth = 0
        for m in MARK.finditer(reply, start):
            if m[0][0] != '"':
                depth += 1 if m[0] in "{[" else -1
                if depth == 0:
                    return reply[start : m.end()]
    return None


def json_of(reply: Column) -> Column:
    """The JSON in a reply: all of it, with its escapes mended, or the first value in it; null if none is valid."""
    found = F.pandas_udf(lambda replies: pd.Series([first_value(r) for r in replies], dtype=object), "string")
    whole = unfenced(reply)
    mended = escaped(whole)
    first, then = found(whole), found(mended)
    tries = [F.when(t.eqNullSafe(v) | ~t.rlike(r"^[\[{]") & t.rlike(SCALAR), t) for t, v in ((whole, first), (mended, then))]
    return F.coalesce(*(F.when(F.try_parse_json(t).isNotNull(), t) for t in (*tries, first, then)))


def fields(json: Column) -> dict[str, Column]:
    """Columns of an analysis: description, tags (20 at most), suggested_name, confidence, transcript, detected_date.

    Tags may be an array or one string with commas; a date may lack its day, or day and month.
    """

    def field(name: str) -> Column:
        return F.get_json_object(json, f"$.{name}")

    listed = F.from_json(field("tags"), "array<string>")
    comma = F.filter(F.transform(F.split(field("tags"), ","), text.stripped), lambda t: t != "")
    tags = F.when(field("tags").startswith("["), listed).otherwise(comma)
    day = F.substring(text.stripped(F.coalesce(F.nullif(field("detected_date"), F.lit("")), field("date"))), 1, 10)
    dates = (F.when(day.rlike(shape), F.try_to_date(F.concat(day, F.lit(rest)), "yyyy-M-d")) for shape, rest in ((r"^\d{4}-\d{1,2}-\d{1,2}$", ""), (r"^\d{4}-\d{1,2}$", "-1"), (r"^\d{4}$", "-1-1")))
    return {
        "description": text.stripped(F.coalesce(field("description"), F.lit(""))),
        "tags": F.slice(F.coalesce(tags, F.array().cast("array<string>")), 1, 20),
        "suggested_name": text.sanitised(field("suggested_name")),
        "confidence": F.coalesce(field("confidence").try_cast("double"), F.lit(0.5)),
        "transcript": text.stripped(F.coalesce(field("transcript"), F.lit(""))),
        "detected_date": F.coalesce(*dates),
    }
