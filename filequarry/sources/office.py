"""Text of DOCX and XLSX files, read from the parts of their containers."""

from __future__ import annotations

import contextlib
import io
import posixpath
import re
import zipfile
import zlib
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, functions as F, types

# What a text is made of.
SHEETS, SHEET_ROWS, LONGEST = 2, 20, 3000
WORD_EXTENSIONS, SHEET_EXTENSIONS = [".docx", ".doc"], [".xlsx", ".xls"]
WORDS = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
CELLS = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
LINKS = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"
# End of fixed values.
#: Parts of up to so many bytes are read at once, which costs far less than step by step.
SMALL_PART = 1 << 17
_UNREADABLE = (zipfile.BadZipFile, zlib.error, ElementTree.ParseError, KeyError, ValueError, RuntimeError, EOFError, OSError)


def _elements(part: io.IOBase, name: str, depth: int) -> Iterator[ElementTree.Element]:
    """The elements ``name`` at ``depth`` (the root's is 1) in order; of a large part each is let go when the next is read."""
    if len(part.read(SMALL_PART + 1)) <= SMALL_PART:
        part.seek(0)
        with contextlib.suppress(ElementTree.ParseError):  # what lies before the fault is still read, in steps
            found = [ElementTree.fromstring(part.read())]
            for _ in range(depth - 1):
                found = [c for e in found for c in e]
            yield from (e for e in found if e.tag == name)
            return
    part.seek(0)
    level, above = 0, []
    for event, e in ElementTree.iterparse(part, events=("start", "end")):
        if event == "start":
            level += 1
            above.append(e)
            continue
        if level == depth and e.tag == name:
            yield e
        level -= 1
        above.pop()
        if level < depth and above:
            above[-1].remove(e)


def _run_text(run: ElementTree.Element) -> str:
    signs = {WORDS + "tab": "\t", WORDS + "br": "\n", WORDS + "cr": "\n", WORDS + "noBreakHyphen": "-"}
    return "".join(e.text or "" if e.tag == WORDS + "t" else signs.get(e.tag, "") for e in run)


def _paragraphs(file: zipfile.ZipFile) -> list[list[str]]:
    """The paragraphs of the body that aren't blank, one cell each, as many as the text needs."""
    out, length = [], 0
    with file.open("word/document.xml") as part:
        for p in _elements(part, WORDS + "p", 3):
            said = "".join(_run_text(r) for c in p for r in ((c,) if c.tag == WORDS + "r" else c.findall(WORDS + "r") if c.tag == WORDS + "hyperlink" else ()))
            if said.strip():
                out.append([said])
                length += len(said) + 1
                if length > LONGEST:
                    break
    return out


def _sheets(file: zipfile.ZipFile) -> list[str]:
    """The parts of the first sheets, in the workbook's order."""
    links = {e.get("Id"): e for e in ElementTree.fromstring(file.read("xl/_rels/workbook.xml.rels"))}
    sheets = [links[e.get(LINKS + "id")] for e in ElementTree.fromstring(file.read("xl/workbook.xml")).iter(CELLS + "sheet")]
    return [posixpath.normpath(posixpath.join("/xl", e.get("Target"))).lstrip("/") for e in sheets if e.get("Type", "").endswith("/worksheet")][:SHEETS]


def _strings(e: ElementTree.Element) -> str:
    """A string's text, its runs in turn, readings left out."""
    return "".join(t.text or "" for c in e for t in ((c,) if c.tag == CELLS + "t" else c.findall(CELLS + "t") if c.tag == CELLS + "r" else ()))


def _value(cell: ElementTree.Element) -> str | int | None:
    """What a cell shows: a text, or the number of a shared string; None where it is empty."""
    kind = cell.get("t", "n")
    if kind == "inlineStr":
        own = cell.find(CELLS + "is")
        return None if own is None else _strings(own)
    v = cell.findtext(CELLS + "v")
    if v is None or v == "" and kind != "str":
        return None
    if kind == "s":
        return int(v)
    if kind == "b":
        return "True" if v == "1" else "False"
    if kind == "n":
        return str(float(v) if re.search("[.eE]", v) else int(v))
    return v


def _sheet_rows(file: zipfile.ZipFile) -> list[list[str]]:
    """The cells with a value of the first rows of the first sheets; rows without one are left out."""
    found = []
    for name in _sheets(file):
        with file.open(name) as part:
            before = 0
            for row in _elements(part, CELLS + "row", 3):
                before = int(row.get("r", before + 1))
                if before > SHEET_ROWS:
                    break
                found.append([v for v in map(_value, row.findall(CELLS + "c")) if v is not None])
    wanted = {v for row in found for v in row if isinstance(v, int)}
    shared = {}
    if wanted:
        with file.open("xl/sharedStrings.xml") as part:
            for k, e in enumerate(_elements(part, CELLS + "si", 2)):
                if k in wanted:
                    shared[k] = _strings(e)
                if len(shared) == len(wanted):
                    break
    return [[shared[v] if isinstance(v, int) else v for v in row] for row in found if row]


@F.pandas_udf(types.ArrayType(types.ArrayType(types.StringType())))
def office_rows(content: pd.Series, kind: pd.Series) -> pd.Series:
    """The paragraphs (kind ``word``) or rows of cells (kind ``sheet``) of each file; none of one that can't be read."""

    def read(data: bytes | None, kind: str | None) -> list[list[str]]:
        if data is None or kind is None:
            return []
        try:
            with zipfile.ZipFile(io.BytesIO(data)) as file:
                return _paragraphs(file) if kind == "word" else _sheet_rows(file)
        except _UNREADABLE:
            return []

    return pd.Series([read(c, k) for c, k in zip(content, kind)], dtype=object)


def office_kind(extension: Column, mime: Column) -> Column:
    """word or sheet, by extension or MIME type; null for other files."""
    ext, m = F.lower(F.coalesce(extension, F.lit(""))), F.lower(F.coalesce(mime, F.lit("")))
    pdf = (ext == ".pdf") | m.contains("pdf")
    word = ext.isin(WORD_EXTENSIONS) | m.contains("word")
    return F.when(~pdf & word, "word").when(~pdf & (ext.isin(SHEET_EXTENSIONS) | m.contains("spreadsheet") | m.contains("excel")), "sheet")


def office_text(content: Column, kind: Column) -> Column:
    """Paragraphs, or rows with commas between their cells, one a line; empty for other files, which stay out of Python."""
    return F.array_join(F.transform(office_rows(F.when(kind.isNotNull(), content), kind), lambda row: F.array_join(row, ", ")), "\n")


def plain_text(content: Column) -> Column:
    """Bytes as UTF-8, else as Windows-1252, else (where they hold bytes it lacks) as Latin-1; line ends as newlines."""
    named = [(chr(b), bytes([b]).decode("cp1252", "ignore")) for b in range(0x80, 0xA0)]
    latin = F.decode(content, "ISO-8859-1")
    western = F.translate(latin, "".join(b for b, c in named if c), "".join(c for b, c in named if c))
    lacking = latin.rlike("[" + "".join(b for b, c in named if not c) + "]")
    return F.regexp_replace(F.coalesce(F.try_validate_utf8(content), F.when(lacking, latin).otherwise(western)), "\r\n?", "\n")
