"""Path parts, categories and dates as Column expressions."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column, functions as F

# The category of each extension.
CATEGORIES = {
    "image": [".jpg", ".jpeg", ".png", ".gif", ".bmp", ".tiff", ".tif", ".webp", ".heic", ".heif", ".ico", ".jp2"],
    "design": [".psd", ".ai", ".sketch", ".fig", ".xd", ".afdesign", ".afphoto", ".cdr", ".indd", ".eps"],
    "3d": [".max", ".3ds", ".3dm", ".obj", ".fbx", ".dae", ".blend", ".stl", ".ply", ".gltf", ".glb", ".usd", ".usdz", ".c4d", ".ma", ".mb", ".lwo", ".lws", ".skp"],
    "cad": [".dwg", ".dxf", ".step", ".stp", ".iges", ".igs", ".sat"],
    "document": [".pdf", ".docx", ".doc", ".odt", ".rtf", ".txt", ".md", ".rst", ".tex", ".xlsx", ".xls", ".ods", ".pptx", ".ppt", ".odp", ".csv", ".tsv"],
    "web": [".html", ".htm", ".xml", ".xhtml", ".json", ".yaml", ".yml", ".toml"],
    "audio": [".mp3", ".m4a", ".wav", ".flac", ".ogg", ".oga", ".aac", ".wma", ".opus", ".aiff", ".aif"],
    "video": [".mp4", ".mov", ".avi", ".mkv", ".wmv", ".m4v", ".3gp", ".webm", ".flv", ".mpg", ".mpeg"],
    "archive": [".zip", ".rar", ".7z", ".tar", ".gz", ".bz2", ".xz", ".tgz", ".tbz", ".iso"],
    "code": [".py", ".js", ".ts", ".jsx", ".tsx", ".java", ".c", ".cpp", ".h", ".hpp", ".cs", ".go", ".rs", ".rb", ".php", ".swift", ".kt", ".scala", ".sh", ".bat", ".ps1", ".sql"],
    "font": [".ttf", ".otf", ".woff", ".woff2", ".eot"],
    "email": [".eml", ".msg"],
    "contact": [".vcf"],
    "calendar": [".ics"],
}
LABELS = {"image": "Images", "design": "Design_Files", "3d": "3D_Models", "cad": "CAD_Drawings", "document": "Documents", "video": "Videos", "audio": "Audio", "code": "Code", "web": "Web_Files", "archive": "Archives"}
# End of fixed values.


def name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def parent(path: Column) -> Column:
    return F.regexp_replace(path, "/[^/]*$", "")


def suffix(path: Column) -> Column:
    """The last extension with its dot; a leading dot alone begins no extension."""
    return F.regexp_extract(name(path), r"^.+(\.[^.]+)$", 1)


def stem(path: Column) -> Column:
    n = name(path)
    return F.substring(n, F.lit(1), F.length(n) - F.length(suffix(path)))


def folder_chain(path: Column, most: int = 4) -> Column:
    """Names of the nearest folders, the outer ones first."""
    parts = F.filter(F.split(parent(path), "/"), lambda p: p != "")
    return F.slice(parts, F.greatest(F.size(parts) - most + 1, F.lit(1)), most)


def with_ancestors(path: Column) -> Column:
    """The folders that hold ``path``, the outermost first, and itself."""
    parts = F.split(path, "/")
    return F.filter(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, F.lit(1), k), "/")), lambda p: p != "")


def joined(folder: str, inner: Column) -> Column:
    """``inner`` below ``folder``, which it is itself where ``inner`` is empty; slashes at its ends don't count."""
    inner = F.regexp_replace(inner, "^/+|/+$", "")
    return F.when(inner == "", F.lit(folder)).otherwise(F.concat(F.lit(folder + "/"), inner))


def category(mime: Column, extension: Column) -> Column:
    """By extension; else by MIME type; else other."""
    known = F.create_map(*(F.lit(x) for x in chain.from_iterable((e, c) for c, es in CATEGORIES.items() for e in es)))
    ext = F.lower(F.coalesce(extension, F.lit("")))
    ext = F.when((ext == "") | ext.startswith("."), ext).otherwise(F.concat(F.lit("."), ext))
    m = F.lower(F.coalesce(mime, F.lit("")))
    top, sub = F.substring_index(m, "/", 1), F.substring(m, F.instr(m, "/") + 1, F.lit(200))
    by_mime = (
        F.when(~m.contains("/"), None)
        .when(top.isin("image", "video", "audio", "text", "font", "model"), top)
        .when(top != "application", None)
        .when(sub.contains("pdf"), "document")
        .when(sub.rlike("zip|compressed|tar"), "archive")
        .when(sub.rlike("photoshop|postscript"), "design")
        .when(sub.rlike("msword|officedocument|opendocument"), "document")
    )
    return F.coalesce(F.try_element_at(known, ext), by_mime, F.lit("other"))


def best_date(exif: Column, modified: Column, created: Column) -> Column:
    return F.coalesce(exif, modified, created)


def date_prefix(date: Column, with_time: bool = False) -> Column:
    day = F.date_format(date, "yyyy-MM-dd")
    if not with_time:
        return F.coalesce(day, F.lit(""))
    midnight = F.date_format(date, "HHmmss") == "000000"
    return F.coalesce(F.when(midnight, day).otherwise(F.date_format(date, "yyyy-MM-dd_HH-mm-ss")), F.lit(""))


def meaningful_date(exif: Column, modified: Column, created: Column) -> Column:
    """An EXIF date, or a modified date not within a minute of the created one."""
    apart = F.abs(F.unix_seconds(modified.cast("timestamp")) - F.unix_seconds(created.cast("timestamp")))
    return exif.isNotNull() | (modified.isNotNull() & (created.isNull() | (apart >= 60)))


def created_date(birth: Column, windows_ctime: Column, exif: Column, media: Column, modified: Column) -> tuple[Column, Column]:
    """The first date there is, and the name of its source."""
    named = (("birthtime", birth), ("ctime_windows", windows_ctime), ("exif_fallback", exif), ("mutagen_fallback", media))
    label = F.coalesce(*(F.when(c.isNotNull(), F.lit(n)) for n, c in named), F.lit("mtime_fallback"))
    return F.coalesce(birth, windows_ctime, exif, media, modified), label


def hamming(a: Column, b: Column) -> Column:
    """Bits in which two hex strings differ; null where they can't be compared."""
    ok = (a != "") & (F.length(a) == F.length(b)) & a.rlike("^[0-9a-fA-F]+$") & b.rlike("^[0-9a-fA-F]+$")
    digits = F.zip_with(F.split(a, ""), F.split(b, ""), lambda x, y: F.bit_count(F.conv(x, 16, 10).cast("int").bitwiseXOR(F.conv(y, 16, 10).cast("int"))))
    return F.when(ok, F.aggregate(digits, F.lit(0), lambda s, d: s + d))
