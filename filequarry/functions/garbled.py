"""Names that were read in the wrong encoding, and what they were."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, functions as F

# Encodings tried, in order, and the letters of the scripts that are looked for.
WRONG_ENCODINGS = ["cp1252", "latin1", "mac_roman", "utf-8"]
RIGHT_ENCODINGS = ["cp1255", "cp862", "cp1256", "cp1251", "utf-8"]
LETTERS = "\u05d0-\u05ea\u0621-\u064a\u0410-\u044f\u0391-\u03c9\u4e00-\u9fff\u3040-\u309f\u30a0-\u30ff\uac00-\ud7af"
SCRIPTS = "\u0590-\u05ff\u0600-\u06ff\u0400-\u04ff\u0500-\u052f\u0370-\u03ff\u4e00-\u9fff\u3040-\u309f\u30a0-\u30ff\uac00-\ud7af"
# End of fixed values.
BROKEN = re.compile("[\x00-\x1f\ufffd]")


def readings(name: str) -> list[str]:
    """Every other text that the name's bytes may stand for, in the order in which they are tried."""
    out = []
    for wrong in WRONG_ENCODINGS:
        for right in RIGHT_ENCODINGS:
            try:
                read = name.encode(wrong).decode(right)
            except UnicodeError:
                continue
            if wrong != right and read != name and not BROKEN.search(read):
                out.append(read)
    return out


def likeness_to_words(name: Column) -> Column:
    """Different letters of a known script; 0 where they are few, repeated, amid other signs, or their case keeps changing."""
    letters = F.regexp_replace(name, f"[^{LETTERS}]", "")
    signs = F.length(F.regexp_replace(name, r"(?U)\s", ""))
    unlike = F.size(F.filter(F.array_distinct(F.split(letters, "")), lambda c: c != ""))
    cased = F.regexp_replace(name, r"[^\p{Lu}\p{Ll}]", "")
    changes = F.size(F.split(cased, r"(?<=\p{Lu})(?=\p{Ll})|(?<=\p{Ll})(?=\p{Lu})")) - 1
    worded = (unlike >= 2) & (2 * F.length(letters) >= signs) & (2 * unlike >= F.length(letters)) & (2 * changes <= F.greatest(F.length(cased) - 1, F.lit(0)))
    return F.when(worded, unlike).otherwise(0)


def recovered(name: Column) -> Column:
    """What a garbled name was, null where it is sound or nothing like words comes of it; the first reading on ties.

    Names of ASCII alone are sound, as are those with a letter of another script than Latin.
    """
    read = F.pandas_udf(lambda names: pd.Series([readings(n) if n else [] for n in names], dtype=object), "array<string>")
    suspect = F.when(name.rlike(r"[^\x00-\x7f]") & ~name.rlike(f"[{SCRIPTS}]"), name)
    scored = F.transform(read(suspect), lambda r, k: F.struct(likeness_to_words(r).alias("score"), (-k).alias("place"), r.alias("name")))
    best = F.array_max(F.filter(scored, lambda s: s["score"] > 0))
    return best["name"]
