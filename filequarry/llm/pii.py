"""Personal data: an automaton finds anchors, local parsers expand and validate them.

One Aho-Corasick pass over a text finds at-signs, plus signs, digits, schemes and identifier
cues. From each anchor a deterministic parser walks outwards over the characters its kind allows,
so it reads a zone once, however long, and validates what it finds:

email, ip, card, phone: the leftmost non-overlapping matches of the patterns below; matches that
fail their check are dropped without another try.
url: ``scheme://user:secret@host`` (credentials in an address). account: after a cue such as
``iban``, ``account``, ``acct``, ``ssn``, an identifier of 6 to 34 letters, digits and hyphens
with at least 4 digits, or an IBAN in groups with spaces between, of its country's length and with
right check digits.

Offsets are code points, ends exclusive. Null and empty texts have no spans.
"""

from __future__ import annotations

import re

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from filequarry.llm.common import slices, small_batches

KINDS = ("email", "ip", "card", "phone")
ALL_KINDS = (*KINDS, "url", "account")
CUES = ("iban", "account", "acct", "ssn", "passport", "routing")
SCHEMES = ("://",)
SPAN = "struct<kind: string, start: int, end: int>"

LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
DOTTED = re.compile(r"[0-9]+(?:\.[0-9]+)*")
GROUPED = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PLUS = re.compile(r"\+[0-9][\x20().0-9-]+")
NOT_DIGIT = re.compile(r"[^0-9]")
SEPARATORS = r"(?:[\x20:#.=]|no|number|is|nr)+"
ACCOUNT = re.compile(SEPARATORS + r"([A-Za-z0-9](?:[A-Za-z0-9-]{4,32})[A-Za-z0-9])(?![A-Za-z0-9-])", re.IGNORECASE)
#: An IBAN in groups of four; which groups belong to it is settled by its country's length.
IBAN = re.compile(SEPARATORS + r"([A-Z]{2}[0-9]{2}(?:\x20[A-Z0-9]{1,4}){2,8})", re.IGNORECASE)
IBAN_LENGTHS = {w[:2]: int(w[2:]) for w in """AD24 AE23 AL28 AT20 AZ28 BA20 BE16 BG22 BH22 BR29 BY28 CH21 CR22 CY28 CZ24 DE22 DK18 DO28 EE20 EG29 ES24 FI18 FO18
FR27 GB22 GE22 GI23 GL18 GR27 GT28 HR21 HU28 IE22 IL23 IQ23 IS26 IT27 JO30 KW30 KZ20 LB28 LC32 LI21 LT20 LU20 LV21 MC27 MD24 ME22 MK19 MR27 MT31 MU30 NL18 NO15
PK24 PL28 PS29 PT25 QA29 RO24 RS22 SA24 SC31 SE24 SI19 SK24 SM27 TN24 TR26 UA29 VA22 VG24 XK20""".split()}
URL = re.compile(r"://[^\s/@:]+:[^\s/@]+@[A-Za-z0-9.-]+")  # the next "://" ends a scan, so nothing is read twice


def automaton():
    a = ahocorasick.Automaton()
    for w in ("@", "+", *"0123456789"):
        a.add_word(w, w)
    for w in SCHEMES:
        a.add_word(w, "scheme")
    for w in CUES:
        for form in {w, w.upper(), w.capitalize()}:
            a.add_word(form, "cue")
    a.make_automaton()
    return a


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def grouped_iban(text: str, start: int, stop: int) -> int:
    """Where the IBAN from ``start`` ends, or 0 if there is none with its country's length and check digits."""
    size, at = IBAN_LENGTHS.get(text[start : start + 2].upper(), 0), start
    code = ""
    while at < stop and len(code) < size:
        code += text[at].strip()
        at += 1
    if not size or len(code) < size or text[at : at + 1].isalnum():
        return 0
    return at if int("".join(str(int(c, 36)) for c in code[4:] + code[:4])) % 97 == 1 else 0


def find(text: str, cues) -> list[tuple[str, int, int]]:
    """(kind, start, end) of one text, by kind as in ALL_KINDS, then start."""
    found: dict[str, list[tuple[int, int]]] = {k: [] for k in ALL_KINDS}
    email_to = dotted_to = grouped_to = plus_to = url_to = account_to = 0
    for end, what in cues.iter(text):
        if what == "@":
            start = end
            while start > email_to and text[start - 1] in LOCAL:
                start -= 1
            if start < end and (m := DOMAIN.match(text, end)):
                found["email"].append((start, m.end()))
                email_to = m.end()
            else:
                # every start in this run fails at the same at-sign
                email_to = max(email_to, end)
        elif what == "+":
            if end >= plus_to and (m := PLUS.match(text, end)):
                stop = m.end()
                while not "0" <= text[stop - 1] <= "9":
                    stop -= 1
                if stop - end >= 4:
                    plus_to = stop
                    if 9 <= len(NOT_DIGIT.sub("", text[end:stop])) <= 15:
                        found["phone"].append((end, stop))
        elif what == "scheme":
            at = end - 2
            if at >= url_to and (m := URL.match(text, at)):
                start = at
                while start > url_to and text[start - 1].isascii() and text[start - 1].isalpha():
                    start -= 1
                if start < at:
                    found["url"].append((start, m.end()))
                    url_to = m.end()
        elif what == "cue":
            if end >= account_to and (m := IBAN.match(text, end + 1)) and (stop := grouped_iban(text, m.start(1), m.end(1))):
                found["account"].append((m.start(1), stop))
                account_to = stop
            elif end >= account_to and (m := ACCOUNT.match(text, end + 1)) and len(NOT_DIGIT.sub("", m[1])) >= 4:
                found["account"].append(m.span(1))
                account_to = m.end(1)
        else:
            if end >= dotted_to:
                m = DOTTED.match(text, end)
                dotted_to = m.end()
                parts = m[0].split(".")
                at = end
                for i in range(0, len(parts) - 3, 4):
                    four = parts[i : i + 4]
                    stop = at + sum(map(len, four)) + 3
                    if all(len(p.lstrip("0")) <= 3 and int(p[-4:]) <= 255 for p in four):
                        found["ip"].append((at, stop))
                    at = stop + 1
            if end >= grouped_to:
                if m := GROUPED.match(text, end):
                    grouped_to = m.end()
                    digits = NOT_DIGIT.sub("", m[0])
                    if 13 <= len(digits) <= 19 and luhn(digits):
                        found["card"].append(m.span())
                else:
                    grouped_to = end + 1
    return [(k, s, e) for k in ALL_KINDS for s, e in found[k]]


def find_pii(docs: DataFrame, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """id_column, spans (array of kind, start, end): one row for each row of ``docs``."""
    small_batches(docs.sparkSession)

    def run(batches):
        cues = automaton()
        for part in slices(batches, "text"):
            spans = [[{"kind": k, "start": s, "end": e} for k, s, e in find(t, cues)] if t else [] for t in part.column("text").to_pylist()]
            kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))
            yield pa.record_batch({id_column: part.column(id_column), "spans": pa.array(spans, kind)})

    rows = docs.select(F.col(id_column), F.col(text).alias("text"))
    return rows.mapInArrow(run, f"{id_column} {rows.schema[id_column].dataType.simpleString()}, spans array<{SPAN}>")
