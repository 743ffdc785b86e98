"""Name and text functions as Column expressions; they fuse into the surrounding stage."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from filequarry.functions import paths

# Results depend on these patterns and lists.
USELESS_STEMS = [
    r"^\d+$",
    r"^\d+([._-]\d+)+$",
    r"^[a-z]$",
    r"^untitled[\s_-]*\d*$",
    r"^new[\s_-]*(file|document|image|folder)?[\s_-]*\d*$",
    r"^document[\s_-]*\d*$",
    r"^copy([\s_-]*of[\s_-]*)?$",
    r"^scan[\s_-]*\d*$",
    r"^img[\s_-]*\d*$",
    r"^image[\s_-]*\d*$",
    r"^dsc[\s_-]*\d*$",
    r"^p\d+$",
    r"^photo[\s_-]*\d*$",
    r"^picture[\s_-]*\d*$",
    r"^file[\s_-]*\d*$",
    r"^pdf[\s_-]*\d*$",
    r"^doc[\s_-]*\d*$",
    r"^temp[\s_-]*\d*$",
    r"^tmp[\s_-]*\d*$",
    r"^[a-z]{1,3}\d{1,4}$",
]
ILLEGAL = r'[<>:"|?*\\/\x00-\x1f]'
NOISY = r"[()\[\]{}#&%!;,@$=+`~^]"
GENERIC_FOLDERS = [
    r"^\d+$",
    r"^\d+[\s._-].*",
    r"^(temp|tmp|new[\s_-]?folder|untitled|folder[\s_-]?\d*|item[\s_-]?\d*)$",
    r"^(section|part|chapter|stage|phase)[\s_-]?\d*$",
]
ECHO_STOPWORDS = ["the", "and", "for", "with", "from", "into", "onto", "this", "that", "report", "list", "notes", "draft", "final", "copy", "version"]
HEBREW = {
    "א": "a", "ב": "b", "ג": "g", "ד": "d", "ה": "h", "ו": "v", "ז": "z", "ח": "ch", "ט": "t", "י": "y",
    "כ": "k", "ל": "l", "מ": "m", "נ": "n", "ס": "s", "ע": "a", "פ": "p", "צ": "tz", "ק": "k", "ר": "r",
    "ש": "sh", "ת": "t", "ך": "k", "ם": "m", "ן": "n", "ף": "p", "ץ": "tz",
}
GENERIC_TAGS = ["artwork", "photo", "image", "picture", "file", "document", "text", "other", "place", "object", "scene", "unknown", "misc"]
GENERIC_TAG_PREFIXES = ["photo_", "image_", "picture_"]
ERROR_WORDS = [
    "could not open", "cannot identify", "cannot open", "error", "failed to", "failed", "not found", "no such file", "unsupported",
    "unable to", "traceback", "exception", "inference failed", "backend is unhealthy", "circuit breaker",
]
FOLDER_TAGS_DROPPED = ["file", "image", "photo", "document", "drawing", "scan"]
GENERIC_STEMS = [
    "drawing", "document", "floor_plan", "plan", "scan", "sheet", "architectural_drawing", "architectural_floor_plan",
    "architectural_floor_plan_drawing", "architectural_floor_plan_layout", "floor_plan_drawing", "floor_plan_layout", "floor_plan_layout_drawing",
    "site_plan", "section_drawing", "structural_plan_drawing", "building_floor_plans", "elevation", "layout",
]
CONTENT_TYPES = {
    "image": ["jpg", "jpeg", "png", "gif", "bmp", "webp", "tif", "tiff", "heic", "raw"],
    "video": ["mp4", "mov", "avi", "mkv", "webm", "wmv", "flv", "m4v"],
    "audio": ["mp3", "wav", "flac", "m4a", "aac", "ogg", "wma"],
    "document": ["pdf", "doc", "docx", "txt", "rtf", "odt", "tex"],
    "spreadsheet": ["xls", "xlsx", "csv", "ods", "tsv"],
    "presentation": ["ppt", "pptx", "odp", "key"],
    "drawing": ["dwg", "dxf", "3dm", "3ds", "skp", "step", "stp", "iges", "igs"],
    "archive": ["zip", "rar", "7z", "tar", "gz", "bz2", "xz"],
}
TIMED = [".jpg", ".jpeg", ".png", ".gif", ".bmp", ".tiff", ".tif", ".webp", ".heic", ".heif", ".mp4", ".mov", ".avi", ".mkv", ".wmv", ".m4v", ".3gp", ".mp3", ".m4a", ".flac", ".wav"]
DATED = [".pdf", ".docx", ".doc", ".odt", ".xlsx", ".xls", ".pptx", ".ppt", ".txt", ".md", ".rtf"]
STRICT_PREFIX = r"(?U)^(\d+(?:[._]\d+)*)[\s_.\-]"
LOOSE_PREFIX = r"^(\d+(?:\.\d+)*)"
# Tags that say nothing.
UNTELLING_TAGS = [
    "file", "files", "document", "documents", "image", "images", "photo", "photos",
    "picture", "pictures", "media", "content", "data", "stuff", "thing", "object",
    "item", "items", "misc", "other", "unknown", "n_a", "na", "none", "general",
    "various", "untitled", "default", "test", "sample",
    "photo_object", "photo_place", "photo_scene", "image_file", "picture_file",
]
# End of fixed values.


def _sub(text: Column, pattern: str, to: str) -> Column:
    """Replace with Unicode-aware classes."""
    return F.regexp_replace(text, "(?U)" + pattern, to)


def stripped(text: Column) -> Column:
    return _sub(text, r"^\s+|\s+$", "")


def slug(text: Column, longest: int = 60) -> Column:
    """Lower-case slug of word characters, underscores and hyphens."""
    s = _sub(F.lower(text), r"^\s+|\s+$", "")
    s = _sub(s, r"[^\w\s-]", "")
    s = _sub(_sub(s, r"[\s_]+", "_"), "-+", "-")
    return F.substring(_sub(s, "^[_-]+|[_-]+$", ""), 1, longest)


def hygienic(stem: Column) -> Column:
    """Clean separators and punctuation, keeping case and length."""
    s = _sub(stem, r"^\s+|\s+$", "")
    s = _sub(_sub(s, ILLEGAL, "_"), NOISY, "_")
    s = _sub(_sub(_sub(s, r"\s+", "_"), "_+", "_"), "-+", "-")
    return _sub(s, r"^[._\- ]+|[._\- ]+$", "")


def needs_hygiene(stem: Column) -> Column:
    clean = hygienic(stem)
    return (clean != "") & (clean != stem)


def useless(stem: Column, further: list[str] | None = None) -> Column:
    """True for blank stems and those that carry no information."""
    s = F.lower(_sub(F.coalesce(stem, F.lit("")), r"^\s+|\s+$", ""))
    return (s == "") | s.rlike("|".join(f"(?:{p})" for p in [*USELESS_STEMS, *(further or [])]))


def dedupe_words(stem: Column) -> Column:
    return F.array_join(F.array_distinct(F.filter(F.split(stem, "_"), lambda w: w != "")), "_")


def strip_echo(stem: Column, *places: Column) -> Column:
    """Drop words that the names in ``places`` already say, unless nothing informative would be left."""
    said = F.flatten(F.array(*(F.split(F.lower(F.coalesce(p, F.lit(""))), r"(?U)[\s_\-.]+") for p in places)))
    block = F.filter(said, lambda t: (F.length(t) >= 4) & ~t.isin(ECHO_STOPWORDS))
    kept = F.filter(F.split(stem, "_"), lambda t: (t != "") & ~F.array_contains(block, F.lower(t)))
    informative = F.exists(kept, lambda t: (F.length(t) >= 3) & ~t.rlike(r"^\d+$"))
    return F.when(informative & (F.size(block) > 0), F.array_join(kept, "_")).otherwise(stem)


def strict_prefix(stem: Column) -> Column:
    """Leading number groups before a separator, dots as underscores; null if there are none."""
    return F.nullif(F.replace(F.regexp_extract(stem, STRICT_PREFIX, 1), F.lit("."), F.lit("_")), F.lit(""))


def loose_prefix(stem: Column) -> Column:
    return F.nullif(F.regexp_extract(stem, LOOSE_PREFIX, 1), F.lit(""))


def ensure_prefix(stem: Column, original: Column) -> Column:
    p = strict_prefix(original)
    has = stem.startswith(F.concat(p, F.lit("_"))) | stem.startswith(F.replace(p, F.lit("_"), F.lit("."))) | stem.startswith(F.concat(p, F.lit("-")))
    return F.when(p.isNull() | has, stem).otherwise(F.concat_ws("_", p, stem))


def folder_name(name: Column) -> Column:
    s = _sub(F.regexp_replace(name, r'[<>:"/\\|?*\x00-\x1f]', "_"), r"^\s+|\s+$", "")
    return _sub(_sub(_sub(s, r"\s+", "_"), "_+", "_"), "^[._]+|[._]+$", "")


def label_slug(text: Column, longest: int = 40) -> Column:
    s = F.lower(_sub(F.coalesce(text, F.lit("")), r"^\s+|\s+$", ""))
    s = F.regexp_replace(_sub(s, r"[\s/\\.]+", "_"), r"[^a-z0-9_\-]+", "")
    s = F.regexp_replace(F.regexp_replace(s, r"[_\-]{2,}", "_"), r"^[_-]+|[_-]+$", "")
    s = F.when(s == "", F.lit("group")).otherwise(s)
    return F.regexp_replace(F.substring(s, 1, longest), "[_-]+$", "")


def transliterate(text: Column) -> Column:
    """Hebrew letters to Latin, ASCII letters and digits in lower case, separators to underscores, the rest dropped."""
    s = _sub(F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), r"[\s\-]", "_")
    s = F.regexp_replace(s, "[^a-z0-9_" + "".join(HEBREW) + "]", "")
    for letter, latin in HEBREW.items():
        if len(latin) > 1:
            s = F.replace(s, F.lit(letter), F.lit(latin))
    single = {k: v for k, v in HEBREW.items() if len(v) == 1}
    return F.translate(s, "".join(single), "".join(single.values()))


def generic_folder(name: Column) -> Column:
    return (name != "") & name.rlike("(?i)" + "|".join(f"(?:{p})" for p in GENERIC_FOLDERS))


def tokens(text: Column) -> Column:
    """Words of a name, split at case changes and punctuation, of two characters or more."""
    s = F.regexp_replace(text, "([a-z])([A-Z])", "$1 $2")
    return F.filter(F.split(s, r"(?U)[\W_]+"), lambda w: F.length(w) > 1)


def human_size(size: Column) -> Column:
    """Bytes as B, KB, MB ...: whole numbers as such, else one decimal, ties to the even digit."""
    out = F.lit(None).cast("string")
    for k, unit in reversed(list(enumerate(("B", "KB", "MB", "GB", "TB")))):
        v = size / F.lit(float(1 << (10 * k)))
        shown = F.when(v == F.floor(v), F.floor(v).cast("string")).otherwise(F.format_string("%.1f", F.bround(v, 1)))
        out = F.when(size < (1 << (10 * (k + 1))), F.concat_ws(" ", shown, F.lit(unit))).otherwise(out) if k < 4 else F.concat_ws(" ", shown, F.lit(unit))
    return out


def clean_tags(tags: Column, filename: Column, folder: Column, most: int = 15) -> Column:
    """Trimmed tags, as they are written, of 40 characters at most, that say something: not generic, of three letters or more,
    not what a word of four letters or more of the file's or folder's name says, in it or around it. Of tags that differ in
    case or spaces the first stays. Null tags fall out."""
    separators = r"(?U)[\s_\-.]+"
    name = F.regexp_replace(F.coalesce(filename, F.lit("")), r"^(.+)\.[^.]+$", "$1")
    said = F.filter(F.concat(F.split(F.lower(name), separators), F.split(F.lower(F.coalesce(folder, F.lit(""))), separators)), lambda t: F.length(t) >= 4)

    trimmed = F.transform(F.filter(tags, lambda t: t.isNotNull()), lambda t: _sub(t, r"^\s+|\s+$", ""))
    both = F.struct(said.alias("said"), F.transform(trimmed, lambda t: F.struct(t.alias("tag"), F.regexp_replace(F.lower(t), r"(?U)\s+", "_").alias("plain"))).alias("tags"))

    def telling(x: Column) -> Column:
        echo = lambda t: F.exists(x["said"], lambda w: t["plain"].contains(w) | w.contains(t["plain"]))
        return F.filter(x["tags"], lambda t: (F.length(t["tag"]) <= 40) & (F.length(t["plain"]) >= 3) & ~t["plain"].isin(UNTELLING_TAGS) & ~echo(t))

    def first(kept: Column) -> Column:
        return F.filter(kept, lambda t, k: ~F.exists(F.slice(kept, F.lit(1), k), lambda u: u["plain"] == t["plain"]))

    # arrays of one, so that each step is worked out once
    kept = F.get(F.transform(F.transform(F.array(both), telling), first), F.lit(0))
    return F.slice(F.transform(kept, lambda t: t["tag"]), 1, most)


def content_type(extension: Column) -> Column:
    """What kind of file an extension names; file where it names none."""
    e = F.regexp_replace(F.lower(F.coalesce(extension, F.lit(""))), r"^\.+", "")
    return F.coalesce(*(F.when(e.isin(known), F.lit(kind)) for kind, known in CONTENT_TYPES.items()), F.lit("file"))


def folder_context(parent: Column, stem: Column, extension: Column) -> Column:
    """A name for a file whose stem says nothing: its folder's name (or what kind of file it is), then the stem."""
    both = F.struct(slug(F.coalesce(parent, F.lit(""))).alias("place"), slug(stem).alias("own"), content_type(extension).alias("kind"))

    def named(x: Column) -> Column:
        place, own = x["place"], x["own"]
        foreign = F.when(own != "", F.concat_ws("_", x["kind"], own))
        return F.when(place == "", foreign).when(own == "", place).when(own.startswith(place), own).otherwise(F.concat_ws("_", place, own))

    return F.get(F.transform(F.array(both), named), F.lit(0))  # so that each part is worked out once


def sanitised(stem: Column, longest: int = 80) -> Column:
    s = _sub(F.regexp_replace(F.coalesce(stem, F.lit("")), r'[<>:"/\\|?*\x00-\x1f]', "_"), r"^\s+|\s+$", "")
    return F.substring(_sub(_sub(_sub(s, r"\s+", "_"), "_+", "_"), "^[._]+|[._]+$", ""), 1, longest)


def content_stem(suggested: Column, tags: Column, description: Column) -> Column:
    """A stem from what is known of the content: the suggested name, else the first three specific tags,
    else words of three letters or more among the first six of the description."""
    low = F.transform(tags, lambda t: F.replace(F.lower(t), F.lit(" "), F.lit("_")))
    specific = F.filter(low, lambda t: ~t.isin(GENERIC_TAGS) & ~_any(t.startswith(p) for p in GENERIC_TAG_PREFIXES))
    words = F.filter(F.split(F.regexp_replace(description, r"[^a-zA-Z0-9\s]", " "), r"(?U)\s+"), lambda w: w != "")
    words = F.transform(F.filter(F.slice(words, 1, 6), lambda w: F.length(w) > 2), F.lower)
    stems = (slug(suggested), slug(dedupe_words(F.array_join(F.slice(specific, 1, 3), "_"))), slug(dedupe_words(F.array_join(words, "_"))))
    return F.coalesce(*(F.nullif(s, F.lit("")) for s in stems))


def _any(tests) -> Column:
    out = F.lit(False)
    for t in tests:
        out = out | t
    return out


def failed_description(description: Column) -> Column:
    return _any(F.lower(description).contains(w) for w in ERROR_WORDS)


def tag_token(tag: Column) -> Column:
    """A tag as part of a folder's name; null if it says too little."""
    t = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.lower(tag), "[^a-z0-9_]", "_"), "_+", "_"), "^_+|_+$", "")
    return F.when((F.length(t) >= 3) & ~t.isin(FOLDER_TAGS_DROPPED), t)


def context(path: Column, day: Column, modified: Column, mime: Column, size: Column, names: Column, told: Column) -> Column:
    """What surrounds a file, in lines, as a model is told it.

    names: neighbours in its folder; told: neighbours (name, description), of which the first five with a description are shown.
    """
    chain = paths.folder_chain(path)
    said = F.flatten(F.transform(F.reverse(chain), tokens))
    own = tokens(paths.stem(path))
    mb = size / F.lit(1048576.0)
    shown = F.when(mb >= 1, F.format_string("%.1f MB", F.bround(mb, 1))).otherwise(F.format_string("%.0f KB", F.bround(size / F.lit(1024.0), 0)))
    known = F.slice(F.filter(told, lambda t: t["description"] != ""), 1, 5)
    listed = F.array_join(F.transform(known, lambda t: F.concat(F.lit("  • "), t["name"], F.lit(": "), t["description"])), "\n")
    lines = (
        F.when(F.size(chain) > 0, F.concat(F.lit("Folder path: "), F.array_join(chain, " / "))),
        F.when(F.size(said) > 0, F.concat(F.lit("Folder keywords: "), F.array_join(said, ", "))),
        F.concat(F.lit("Filename: "), paths.name(path)),
        F.when(F.size(own) > 0, F.concat(F.lit("Filename keywords: "), F.array_join(own, ", "))),
        F.coalesce(F.concat(F.lit("Date (best guess): "), F.date_format(day, "yyyy-MM-dd")), F.concat(F.lit("Date modified: "), F.date_format(modified, "yyyy-MM-dd"))),
        F.when(mime != "", F.concat(F.lit("File type: "), mime)),
        F.when(size > 0, F.concat(F.lit("File size: "), shown)),
        F.when(F.size(names) > 0, F.concat(F.lit("Other files in same folder: "), F.array_join(names, ", "))),
        F.when(F.size(known) > 0, F.concat(F.lit("Nearby files with known descriptions:\n"), listed)),
    )
    return F.concat_ws("\n", *lines)
