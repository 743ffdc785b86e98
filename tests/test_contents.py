"""Dates and text inside files: odd structures, broken files, nulls, encodings."""

import datetime
import io
import random
import struct
import zipfile

import pytest
from filequarry.plans import contents, registry
from filequarry.sources import embedded, office, scan
from pyspark.sql import functions as F

AT = datetime.datetime(2020, 5, 6, 7, 8, 9)


def tiff(order="<", outer=(), inner=()):
    """A TIFF structure with text tags (number, text) in both directories."""
    head = (b"II" if order == "<" else b"MM") + struct.pack(order + "HI", 42, 8)
    count = len(outer) + 1
    exif_at = 8 + 2 + 12 * count + 4
    data_at = exif_at + 2 + 12 * len(inner) + 4
    data = b""

    def entries(tags):
        nonlocal data
        out = b""
        for tag, text in tags:
            raw = text.encode() + b"\0"
            out += struct.pack(order + "HHI", tag, 2, len(raw))
            if len(raw) <= 4:
                out += raw.ljust(4, b"\0")
            else:
                out += struct.pack(order + "I", data_at + len(data))
                data += raw
        return out

    first = struct.pack(order + "H", count) + entries(outer) + struct.pack(order + "HHII", 0x8769, 4, 1, exif_at) + b"\0" * 4
    second = struct.pack(order + "H", len(inner)) + entries(inner) + b"\0" * 4
    return head + first + second + data


def jpeg(body, before=b""):
    return b"\xff\xd8" + before + b"\xff\xe1" + struct.pack(">H", len(body) + 8) + b"Exif\0\0" + body + b"\xff\xda\0\2\xff\xd9"


def webp(body):
    chunks = b"VP8X" + struct.pack("<I", 9) + b"\0" * 10 + b"EXIF" + struct.pack("<I", len(body)) + body
    return b"RIFF" + struct.pack("<I", len(chunks) + 4) + b"WEBP" + chunks


GOOD = "2020:05:06 07:08:09"
CASES = [
    (jpeg(tiff("<", [(0x0132, "2001:01:01 00:00:00")], [(0x9003, GOOD)])), AT),
    (jpeg(tiff(">", [(0x0132, GOOD)], [(0x9003, ""), (0x9004, "0000:00:00 00:00:00")])), AT),
    (jpeg(tiff(">", [], [(0x9004, " " + GOOD + " ")]), b"\xff\xe1\0\x08http:/" + b"\xff\xff\xfe\0\4hi"), AT),  # another APP1 first, fill bytes, a comment
    (webp(tiff("<", [], [(0x9003, GOOD)])), AT),
    (webp(b"Exif\0\0" + tiff("<", [], [(0x9003, GOOD)])), AT),
    (tiff("<", [(0x9003, GOOD)], [(0x0132, GOOD)]), None),  # each tag in the other's directory
    (tiff("<", [(0x0132, "abc")], []), None),
    (b"\xff\xd8\xff\xda\0\2" + jpeg(tiff("<", [], [(0x9003, GOOD)])), None),  # after the picture has begun
    (b"II*\0\xff\xff\xff\xff", None), (b"II*\0\0\0\0\0", None), (b"MM\0*", None), (b"\xff\xd8\xff", None), (b"\xff\xd8\xff\xe1\0\0", None), (b"", None), (None, None),
    (jpeg(tiff("<", [], [(0x9003, "2020:13:06 07:08:09"), (0x9004, "2020:05:06 07:08:60")])), None),
]


def test_exif_dates(spark):
    rows = [(i, ".jpg", None if c is None else bytearray(c)) for i, (c, _) in enumerate(CASES)]
    got = embedded.with_exif(spark.createDataFrame(rows, "id int, extension string, content binary")).orderBy("id").collect()
    assert [r.date_exif for r in got] == [w for _, w in CASES]


def test_only_images_are_asked_and_cut_files_do_no_harm(spark):
    whole, rng = jpeg(tiff("<", [(0x0132, GOOD)], [(0x9003, GOOD)])), random.Random(3)
    rows = [(ext, bytearray(whole)) for ext in (".txt", None, ".HEIC", ".JPG")] + [(".jpg", bytearray(whole[:n])) for n in range(len(whole))]
    rows += [(".jpg", bytearray(b if rng.random() > 0.05 else rng.randrange(256) for b in whole)) for _ in range(200)]
    got = [r.date_exif for r in embedded.with_exif(spark.createDataFrame(rows, "extension string, content binary").coalesce(1)).collect()]
    assert got[:4] == [None, None, AT, AT] and len(got) == len(rows)


@pytest.mark.parametrize("values, want", [
    (["2019-8-1"], datetime.datetime(2019, 8, 1)), (["2019-08-01"], datetime.datetime(2019, 8, 1)), (["x", None, "2019"], datetime.datetime(2019, 1, 1)),
    (["2019-08-01T01:02:03"], datetime.datetime(2019, 8, 1, 1, 2, 3)), (["2019-02-30"], None), (["0000"], None), ([], None), (None, None), (["12-01-2019"], None),
])
def test_media_dates(spark, values, want):
    assert spark.createDataFrame([(values,)], "v array<string>").select(embedded.media_date(F.col("v"))).first()[0] == want


def read(spark, files):
    rows = [(i, ext, None, None if c is None else len(c), None if c is None else bytearray(c)) for i, (ext, c) in enumerate(files)]
    return [r.text for r in scan.extract_text(spark.createDataFrame(rows, "id int, extension string, mime_type string, size_bytes long, content binary")).orderBy("id").collect()]


def test_office_files(spark):
    long = contents.word_file([f"paragraph {i} " + "word " * 20 for i in range(100)])
    broken = contents.word_file(["one"])
    files = [(".docx", contents.word_file(["Hello & <world>", "second"])), (".docx", long), (".docx", broken[:40]), (".docx", b""), (".docx", None), (".xlsx", broken), (".docx", contents.word_file([])), (".xlsx", contents.sheet_file([])), (None, broken), (".pdf", broken)]
    got = read(spark, files)
    assert got[0] == "Hello & <world>\nsecond" and len(got[1]) == 3000 and got[1].startswith("paragraph 0 word")
    assert got[2:] == [""] * 8


def test_cells(spark):
    main, links = office.CELLS[1:-1], office.LINKS[1:-1]
    cells = '<c r="A1"><v>1.50</v></c><c><v>1E3</v></c><c t="b"><v>1</v></c><c t="e"><v>#N/A</v></c><c t="str"><f>A1</f><v>sum</v></c><c/><c t="s"><v>1</v></c>'
    parts = {
        "xl/workbook.xml": f'<workbook xmlns="{main}" xmlns:r="{links}"><sheets><sheet name="chart" r:id="c"/><sheet name="a" r:id="a"/></sheets></workbook>',
        "xl/_rels/workbook.xml.rels": f'<Relationships><Relationship Id="c" Type="{links}/chartsheet" Target="chartsheets/s.xml"/><Relationship Id="a" Type="{links}/worksheet" Target="worksheets/a.xml"/></Relationships>',
        "xl/worksheets/a.xml": f'<worksheet xmlns="{main}"><sheetData><row>{cells}</row><row r="5"><c/></row><row r="20"><c><v>7</v></c></row><row r="21"><c><v>8</v></c></row></sheetData></worksheet>',
        "xl/sharedStrings.xml": f'<sst xmlns="{main}"><si><t>no</t></si><si><r><t>sha</t></r><r><t>red</t></r><rPh><t>reading</t></rPh></si></sst>',
    }
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, body in parts.items():
            z.writestr(name, body)
    assert read(spark, [(".xlsx", out.getvalue())]) == ["1.5, 1000.0, True, #N/A, sum, shared\n7"]


def test_encodings(spark):
    assert read(spark, [(".txt", "naïve “ok”".encode("cp1252")), (".txt", b"caf\xe9 \x81"), (".md", "日本\r\nx\ry".encode()), (".txt", b""), (".bin", b"abc")]) == ["naïve “ok”", "café \x81", "日本\nx\ny", "", ""]


def test_catalogue_after_enrichment(spark, tmp_path):
    (tmp_path / "a.jpg").write_bytes(jpeg(tiff("<", [], [(0x9003, GOOD)])))
    (tmp_path / "b.txt").write_bytes(b"x")
    scanned = scan.scan(spark, str(tmp_path), content=True)
    known = scanned.drop("content").withColumn("status", F.when(F.col("filename") == "b.txt", "analyzed").otherwise("pending"))
    gone = known.filter("filename = 'a.jpg'").withColumns({"path": F.lit("/gone.jpg"), "filename": F.lit("gone.jpg")})
    got = {r.filename: r for r in scan.enriched(known.unionByName(gone), scanned).collect()}
    assert got["a.jpg"].status == "enriched" and got["a.jpg"].date_exif == AT and got["a.jpg"].date_best == AT and got["a.jpg"].hash_md5
    assert got["b.txt"].status == "analyzed" and got["b.txt"].hash_md5 is None
    assert got["gone.jpg"].status == "error" and got["gone.jpg"].error_message == "File not found: /gone.jpg"


def test_queries_find_dates(spark):
    got = registry.QUERIES["embedded_dates"](spark, "/root/testdata/sf0.001")
    assert {r.source for r in got.select("source").distinct().collect()} == {"birthtime", "exif_fallback", "mutagen_fallback", "mtime_fallback"}
