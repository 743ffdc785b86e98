"""Registered queries of what lies inside files: EXIF dates and the text of office files, whose bytes Spark makes from the given tables."""

from __future__ import annotations

import io
import zipfile
from xml.sax.saxutils import escape

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types

from filequarry.functions import paths
from filequarry.plans.registry import files, query, table
from filequarry.sources import embedded, office

# ---------------------------------------------------------------- EXIF dates


def photo(original: Column, digitized: Column, image: Column, little: bool) -> Column:
    """A TIFF structure with three dates of 19 characters."""
    number = lambda x, size: x.to_bytes(size, "little" if little else "big").hex()
    entry = lambda tag, kind, count, value: number(tag, 2) + number(kind, 2) + number(count, 4) + number(value, 4)
    head = ("49492a00" if little else "4d4d002a") + number(8, 4) + number(2, 2) + entry(0x0132, 2, 20, 68) + entry(0x8769, 4, 1, 38) + number(0, 4)
    head += number(2, 2) + entry(0x9003, 2, 20, 88) + entry(0x9004, 2, 20, 108) + number(0, 4)
    return F.concat(F.unhex(F.lit(head)), *(F.concat(F.encode(d, "UTF-8"), F.unhex(F.lit("00"))) for d in (image, original, digitized)))


def photos(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files as JPEG, PNG, TIFF and text of the same bytes; some dates blank, zero or past the calendar, some files cut off."""
    f, k = files(spark, sf_dir), F.col("id")
    shown = lambda d: F.date_format(d, "yyyy:MM:dd HH:mm:ss")
    original = F.when(k % 5 == 0, "0000:00:00 00:00:00").when(k % 5 == 1, "2021:02:30 10:00:00").otherwise(shown(F.col("date_modified")))
    digitized = F.when(k % 10 == 1, " " * 19).when(k % 15 == 5, "not a date at all  ").otherwise(shown(F.col("date_created")))
    image = F.when(k % 3 == 0, shown(F.col("date_exif"))).otherwise("20xx:01:01 00:00:00")
    tiff = F.when(k % 2 == 0, photo(original, digitized, image, True)).otherwise(photo(original, digitized, image, False))
    jpeg = F.concat(F.unhex(F.lit("ffd8ffe00010" + "4a46494600" + "00" * 9 + "ffe10088" + "457869660000")), tiff, F.unhex(F.lit("ffda0002ffd9")))
    png = F.concat(F.unhex(F.lit("89504e470d0a1a0a" + "0000000d" + "49484452" + "00" * 17 + "00000080" + "65584966")), tiff, F.unhex(F.lit("00" * 4)))
    whole = F.when(k % 4 == 0, jpeg).when(k % 4 == 1, png).otherwise(tiff)
    ext = F.element_at(F.array(*map(F.lit, (".jpg", ".PNG", ".tif", ".txt"))), (k % 4 + 1).cast("int"))
    year = F.date_format("date_created", "yyyy")
    media = F.when(k % 6 == 0, F.array(F.lit("unknown"), year)).when(k % 6 == 1, F.array(F.date_format("date_created", "yyyy-M-d"))).when(k % 6 == 2, F.array(F.date_format("date_created", "yyyy-MM-dd'T'HH:mm:ss"))).otherwise(F.array(F.lit("2021-02-30")))
    birth = F.when(k % 8 == 7, F.col("date_created"))
    return f.withColumns({"extension": ext, "content": F.when(k % 11 == 0, F.substring(whole, 1, 60)).otherwise(whole), "media": media, "birth": birth}).drop("date_exif")


PHOTOS_SQL = """,
seen AS (SELECT id, date_modified, date_created, CASE WHEN id % 8 = 7 THEN date_created END AS birth,
  CASE WHEN id % 4 = 3 OR id % 11 = 0 THEN NULL WHEN id % 5 > 1 THEN date_modified WHEN id % 10 <> 1 AND id % 15 <> 5 THEN date_created ELSE date_exif END AS exif,
  CASE id % 6 WHEN 0 THEN date_trunc('year', date_created) WHEN 1 THEN date_trunc('day', date_created) WHEN 2 THEN date_created END AS media FROM files)
SELECT id, epoch(exif)::BIGINT AS exif, epoch(media)::BIGINT AS media, epoch(coalesce(birth, exif, media, date_modified))::BIGINT AS created,
  CASE WHEN birth IS NOT NULL THEN 'birthtime' WHEN exif IS NOT NULL THEN 'exif_fallback' WHEN media IS NOT NULL THEN 'mutagen_fallback' ELSE 'mtime_fallback' END AS source FROM seen"""


@query(PHOTOS_SQL)
def embedded_dates(spark, sf_dir):
    """Dates from EXIF tags and media tags, and the created date with its source."""
    seen = embedded.with_exif(photos(spark, sf_dir)).withColumn("media_date", embedded.media_date(F.col("media")))
    created, source = paths.created_date(F.col("birth"), F.lit(None).cast("timestamp_ntz"), F.col("date_exif"), F.col("media_date"), F.col("date_modified"))
    at = lambda d: F.unix_seconds(d.cast("timestamp"))
    return seen.select("id", at(F.col("date_exif")).alias("exif"), at(F.col("media_date")).alias("media"), at(created).alias("created"), source.alias("source"))


# ---------------------------------------------------------------- office files


def _container(parts: dict[str, str]) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, body in parts.items():
            z.writestr(name, body)
    return out.getvalue()


def word_file(lines: list[str]) -> bytes:
    """A DOCX file of paragraphs, each in two runs, the second in a link; a blank one and a table lie between."""
    run = lambda x: f'<w:r><w:t xml:space="preserve">{escape(x)}</w:t></w:r>'
    body = "<w:p/><w:tbl><w:tr><w:tc><w:p>" + run("in a table") + "</w:p></w:tc></w:tr></w:tbl>"
    body += "".join(f"<w:p><w:pPr/>{run(x[: len(x) // 2])}<w:hyperlink>{run(x[len(x) // 2 :])}</w:hyperlink></w:p><w:p>{run('  ')}</w:p>" for x in lines)
    return _container({"word/document.xml": f'<w:document xmlns:w="{office.WORDS[1:-1]}"><w:body>{body}</w:body></w:document>'})


def sheet_file(lines: list[str], rows: int = 25) -> bytes:
    """An XLSX file of three sheets of ``rows`` lines, a word a cell after the line's number; words are shared or inline by turns."""
    shared = {w: k for k, w in enumerate(dict.fromkeys(w for x in lines for w in x.split(" ")[::2]))}
    word = lambda w, k: f'<c t="inlineStr"><is><r><t>{escape(w)}</t></r></is></c>' if k % 2 else f'<c t="s"><v>{shared[w]}</v></c>'
    sheet = lambda part: "".join(f'<row r="{i}"><c><v>{i}</v></c><c/>' + "".join(word(w, k) for k, w in enumerate(x.split(" "))) + "</row>" for i, x in enumerate(part, 1))
    main, links = office.CELLS[1:-1], office.LINKS[1:-1]
    parts = {f"xl/worksheets/sheet{3 - k}.xml": f'<worksheet xmlns="{main}"><cols/><sheetData>{sheet(lines[k * rows : (k + 1) * rows])}</sheetData></worksheet>' for k in range(3)}
    parts["xl/workbook.xml"] = f'<workbook xmlns="{main}" xmlns:r="{links}"><sheets>' + "".join(f'<sheet name="s{k}" sheetId="{k + 1}" r:id="r{k}"/>' for k in range(3)) + "</sheets></workbook>"
    parts["xl/_rels/workbook.xml.rels"] = "<Relationships>" + "".join(f'<Relationship Id="r{k}" Type="{links}/worksheet" Target="{"/xl/" if k else ""}worksheets/sheet{3 - k}.xml"/>' for k in range(3)) + "</Relationships>"
    parts["xl/sharedStrings.xml"] = f'<sst xmlns="{main}">' + "".join(f"<si><t>{escape(w)}</t></si>" for w in shared) + "</sst>"
    return _container(parts)


@F.pandas_udf(types.BinaryType())
def office_file(lines: pd.Series, kind: pd.Series) -> pd.Series:
    return pd.Series([word_file(list(x)) if k == "word" else sheet_file(list(x)) for x, k in zip(lines, kind)], dtype=object)


WORDS_SQL = "regexp_extract_all(text, '[a-zA-Z&<]+')"
OFFICE_SQL = f"""WITH texts AS (SELECT doc_id AS id, coalesce({WORDS_SQL}, []) AS words FROM documents),
lines AS (SELECT id, list_transform(range(0, (len(words) + 9) // 10), lambda i: words[i * 10 + 1 : i * 10 + 10]) AS lines FROM texts)
SELECT id, CASE WHEN id % 2 = 0 THEN rtrim(substr(coalesce(array_to_string(list_transform(lines, lambda x: array_to_string(x, ' ')), chr(10)), ''), 1, 3000), ' ' || chr(10))
  ELSE rtrim(substr(coalesce(array_to_string(list_transform(lines[1:20], lambda x, i: i || ', ' || array_to_string(x, ', ')) || list_transform(lines[26:45], lambda x, i: i || ', ' || array_to_string(x, ', ')), chr(10)), ''), 1, 3000), ' ' || chr(10)) END AS text FROM lines"""


@query(OFFICE_SQL, uses_files=False)
def office_texts(spark, sf_dir):
    """Documents as DOCX and XLSX files, and the text that is read from them."""
    from filequarry.sources import scan

    words = F.coalesce(F.regexp_extract_all("text", F.lit("[a-zA-Z&<]+"), F.lit(0)), F.array().cast("array<string>"))
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), words.alias("words"))
    count = F.ceil(F.size("words") / 10).cast("int")
    lines = F.when(count > 0, F.transform(F.sequence(F.lit(0), count - 1), lambda i: F.array_join(F.slice("words", i * 10 + 1, F.lit(10)), " "))).otherwise(F.array().cast("array<string>"))
    kind = F.when(F.col("id") % 2 == 0, "word").otherwise("sheet")
    made = docs.select("id", office_file(lines, kind).alias("content"), F.when(F.col("id") % 2 == 0, ".docx").otherwise(".XLSX").alias("extension"), F.lit(None).cast("string").alias("mime_type"))
    return scan.extract_text(made.withColumn("size_bytes", F.octet_length("content").cast("long"))).select("id", "text")
