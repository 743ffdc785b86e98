"""Dates written inside image and audio files: EXIF tags from the bytes of JPEG, TIFF and PNG files, and tags of media."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, types

# Numbers of the format, and the files whose EXIF date is asked for.
DATE_TIME, EXIF_DIRECTORY, DATE_TIME_ORIGINAL, DATE_TIME_DIGITIZED, ASCII = 0x0132, 0x8769, 0x9003, 0x9004, 2
EXIF_EXTENSIONS = [".jpg", ".jpeg", ".tif", ".tiff", ".heic", ".heif", ".png", ".webp"]
# End of fixed values.
_TAGS = types.StructType([types.StructField(n, types.StringType()) for n in ("original", "digitized", "image")])


def _tiff(data: bytes) -> memoryview | None:
    """The TIFF structure within an image: a TIFF file itself, a JPEG's APP1 segment, a PNG's eXIf or a WebP's EXIF chunk; None without."""
    view = memoryview(data)
    if data[:4] in (b"II*\0", b"MM\0*"):
        return view
    if data[:2] == b"\xff\xd8":
        at = 2
        while at + 4 <= len(data) and data[at] == 0xFF:
            kind = data[at + 1]
            if kind == 0xFF or kind == 0x01 or 0xD0 <= kind <= 0xD7:  # fill bytes and markers without a length
                at += 1 if kind == 0xFF else 2
                continue
            length = int.from_bytes(data[at + 2 : at + 4], "big")
            if kind in (0xDA, 0xD9) or length < 2:  # the picture begins or the file ends
                return None
            if kind == 0xE1 and data[at + 4 : at + 10] == b"Exif\0\0":
                return view[at + 10 : at + 2 + length]
            at += 2 + length
        return None
    png, webp = data[:8] == b"\x89PNG\r\n\x1a\n", data[:4] == b"RIFF" and data[8:12] == b"WEBP"
    at = 8 if png else 12
    while (png or webp) and at + 8 <= len(data):
        name, size = (data[at + 4 : at + 8], data[at : at + 4]) if png else (data[at : at + 4], data[at + 4 : at + 8])
        size = int.from_bytes(size, "big" if png else "little")
        if name == (b"eXIf" if png else b"EXIF"):
            body = view[at + 8 : at + 8 + size]
            return body[6:] if bytes(body[:6]) == b"Exif\0\0" else body
        at += 8 + size + (4 if png else size % 2)
    return None


def _strings(tiff: memoryview) -> dict[int, str]:
    """The text tags of the first directory and of its EXIF directory; what lies beyond the end is left out."""
    order = {b"II": "little", b"MM": "big"}.get(bytes(tiff[:2]))
    number = lambda at, size: int.from_bytes(tiff[at : at + size], order)
    out, todo = {}, [(number(4, 4), True)] if order and len(tiff) >= 8 and number(2, 2) == 42 else []
    for start, outer in todo:
        for k in range(number(start, 2)):
            at = start + 2 + 12 * k
            if start < 8 or at + 12 > len(tiff):
                break
            tag, kind, count = number(at, 2), number(at + 2, 2), number(at + 4, 4)
            if tag == EXIF_DIRECTORY and outer:
                todo.append((number(at + 8, 4), False))
            elif kind == ASCII and tag in ((DATE_TIME,) if outer else (DATE_TIME_ORIGINAL, DATE_TIME_DIGITIZED)):
                place = at + 8 if count <= 4 else number(at + 8, 4)
                if place + count <= len(tiff):
                    out.setdefault(tag, bytes(tiff[place : place + count]).split(b"\0")[0].decode("latin-1"))
    return out


@F.pandas_udf(_TAGS)
def exif_tags(content: pd.Series) -> pd.DataFrame:
    """original, digitized, image: the date tags of each image as written; null where there is none, or no image."""
    found = [_strings(t) if c is not None and (t := _tiff(bytes(c))) is not None else {} for c in content]
    return pd.DataFrame({n: [f.get(t) for f in found] for n, t in (("original", DATE_TIME_ORIGINAL), ("digitized", DATE_TIME_DIGITIZED), ("image", DATE_TIME))}, dtype=object)


def _made(value: Column, pattern: str, fields: int) -> Column:
    """The time that the groups of ``pattern`` write, missing ones as in January, the first, midnight; null where there is no such time."""
    pick = lambda k, rest: F.regexp_extract(value, pattern, k).try_cast("int") if k <= fields else F.lit(rest)
    made = F.try_make_timestamp_ntz(*(pick(k, rest) for k, rest in ((1, 1), (2, 1), (3, 1), (4, 0), (5, 0))), pick(6, 0).cast("decimal(16,6)"))
    return F.when(value.rlike(pattern) & (pick(1, 1) >= 1), made)


def exif_time(value: Column) -> Column:
    """``YYYY:MM:DD HH:MM:SS`` as a time; null for anything else and for times that don't exist."""
    return _made(F.btrim(value, F.lit(" \t\r\n\f\v")), r"^(\d{4}):(\d{1,2}):(\d{1,2})\s+(\d{1,2}):(\d{1,2}):([0-5]?\d)$", 6)


def exif_date(tags: Column) -> Column:
    """The first of the tags (see ``exif_tags``) that is a time: original, digitized, image."""
    return F.coalesce(*(exif_time(tags[n]) for n in ("original", "digitized", "image")))


def media_date(values: Column) -> Column:
    """The first of a file's date tags (an array, most telling first) that is a day, a year, or a day and time, by the whole text."""
    forms = ((r"^(\d{4})-(\d{1,2})-(\d{1,2})$", 3), (r"^(\d{4})$", 1), (r"^(\d{4})-(\d{1,2})-(\d{1,2})T(\d{1,2}):(\d{1,2}):([0-5]?\d)$", 6))
    times = F.transform(values, lambda v: F.coalesce(*(_made(F.btrim(v, F.lit(" \t\r\n\f\v")), p, n) for p, n in forms)))
    return F.get(F.filter(times, lambda t: t.isNotNull()), F.lit(0))


def with_exif(rows: DataFrame) -> DataFrame:
    """Adds date_exif to rows (extension, content): of images only, null for the rest; no other file's bytes go to Python."""
    image = F.lower(F.coalesce("extension", F.lit(""))).isin(EXIF_EXTENSIONS)
    tags = rows.withColumn("_tags", exif_tags(F.when(image, F.col("content"))))
    return tags.withColumn("date_exif", exif_date(F.col("_tags"))).drop("_tags")
