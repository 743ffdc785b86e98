"""Directory scans, ignore rules, logs and archives as DataFrames."""

from __future__ import annotations

import io
import re
import zipfile

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from filequarry.functions import paths
from filequarry.sources import embedded, office

# What a scan leaves out.
SKIP_DIRS = ["System Volume Information", "$RECYCLE.BIN", "RECYCLER", ".git", ".svn", "__pycache__", "node_modules", ".Spotlight-V100", ".Trashes", ".fseventsd", "lost+found"]
SKIP_EXTENSIONS = [".lnk", ".url", ".tmp", ".part", ".sys", ".dll", ".exe", ".com", ".ini", ".dat", ".log", ".db", ".db-shm", ".db-wal", ".ctb", ".3dmbak", ".plt"]
SKIP_NAMES = [".DS_Store", "Thumbs.db", "desktop.ini", "._.DS_Store"]
TEXT_EXTENSIONS = [".txt", ".md", ".csv", ".json", ".xml", ".yaml", ".yml", ".html", ".htm", ".rtf"]
# End of fixed values.
MIME_BY_EXTENSION = {".txt": "text/plain", ".md": "text/markdown", ".csv": "text/csv", ".json": "application/json", ".html": "text/html", ".jpg": "image/jpeg", ".jpeg": "image/jpeg", ".png": "image/png", ".gif": "image/gif", ".pdf": "application/pdf", ".zip": "application/zip", ".mp3": "audio/mpeg", ".mp4": "video/mp4"}
MANIFEST = 120


def wildcard(pattern: str) -> str:
    """A shell pattern as a Java regex; * and ? cross slashes."""
    out, i = "", 0
    while i < len(pattern):
        c = pattern[i]
        end = pattern.find("]", i + 2) if c == "[" else -1
        if end > 0:
            body = pattern[i + 1 : end]
            out += "[" + ("^" + body[1:] if body[0] == "!" else body).replace("\\", "\\\\") + "]"
            i = end
        else:
            out += {"*": "(?s:.*)", "?": "(?s:.)"}.get(c, re.sub(r"([^\w\s/])", r"\\\1", c))
        i += 1
    return f"^{out}$"


def rule_matches(path: Column, rule: str, is_dir: bool) -> Column:
    """Whether one ignore rule (without its !) matches a path relative to the root."""
    only_dir, rule = rule.endswith("/"), rule.rstrip("/") if rule.endswith("/") else rule
    if only_dir and not is_dir:
        return F.lit(False)
    rooted, rule = rule.startswith("/"), rule[1:] if rule.startswith("/") else rule
    parts = F.split(path, "/")
    out = F.lit(False)
    if rule.startswith("**/"):
        out = F.exists(parts, lambda p: p.rlike(wildcard(rule[3:]))) | path.rlike(wildcard(rule.replace("**/", "*")))
    rule = rule.replace("**", "*")
    if rooted:
        return out | (~path.contains("/") & path.rlike(wildcard(rule)))
    out = out | path.rlike(wildcard(rule))
    if "/" not in rule:
        out = out | paths.name(path).rlike(wildcard(rule))
        if not only_dir:
            out = out | F.exists(parts, lambda p: p.rlike(wildcard(rule)))
    return out


def ignored(path: Column, rules: list[str], is_dir: bool = False) -> Column:
    """Ignore rules in order, blank lines and # comments left out, ! takes back; the last match decides."""
    out = F.lit(False)
    for rule in (r.strip() for r in rules):
        if rule and not rule.startswith("#"):
            keep = rule.startswith("!")
            out = F.when(rule_matches(path, rule[1:] if keep else rule, is_dir), F.lit(not keep)).otherwise(out)
    return out


def in_skipped_dir(relative: Column) -> Column:
    """A folder on the way is hidden or on the list."""
    folders = F.slice(F.split(relative, "/"), F.lit(1), F.greatest(F.size(F.split(relative, "/")) - 1, F.lit(0)))
    return F.exists(folders, lambda p: p.isin(SKIP_DIRS) | p.startswith("."))


def scan(spark: SparkSession, root: str, rules: list[str] = (), session_id: str = "s0", content: bool = False) -> DataFrame:
    """The files below ``root`` that a scan keeps: path, filename, extension, size, modified, status.

    The listing is Spark's; without ``content`` no file is opened.
    """
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    base = root.rstrip("/")
    relative = F.regexp_replace("path", "^.*?" + re.sub(r"([^\w/])", r"\\\1", re.sub(r"^[a-z]+:/*", "/", base)) + "/", "")
    rows = listed.withColumn("relative", relative)
    name, ext = paths.name(F.col("relative")), F.lower(paths.suffix(F.col("relative")))
    skip = in_skipped_dir(F.col("relative")) | name.isin(SKIP_NAMES) | name.startswith("._") | ext.isin(SKIP_EXTENSIONS) | ignored(F.col("relative"), list(rules))
    return rows.filter(~skip).select(
        F.lit(session_id).alias("session_id"), "path", "relative", name.alias("filename"), F.nullif(ext, F.lit("")).alias("extension"),
        F.col("length").alias("size_bytes"), F.col("modificationTime").alias("date_modified"), F.lit("pending").alias("status"),
        *([F.col("content")] if content else []),
    )


def incremental(catalogue: DataFrame, scanned: DataFrame, force: bool = False) -> DataFrame:
    """The catalogue after a scan: new paths are added; known ones stay, or are replaced if forced."""
    if force:
        return catalogue.join(scanned.select("path"), "path", "left_anti").unionByName(scanned, allowMissingColumns=True)
    return catalogue.unionByName(scanned.join(catalogue.select("path"), "path", "left_anti"), allowMissingColumns=True)


def enrich(scanned: DataFrame) -> DataFrame:
    """Adds MIME type, MD5, SHA-256 and the EXIF date (of images) of pending rows read with their content."""
    known = F.create_map(*(F.lit(x) for kv in MIME_BY_EXTENSION.items() for x in kv))
    magic = F.hex(F.substring("content", 1, 4))
    sniffed = F.when(magic.startswith("89504E47"), "image/png").when(magic.startswith("FFD8FF"), "image/jpeg").when(magic == "25504446", "application/pdf").when(magic == "504B0304", "application/zip")
    mime = F.coalesce(sniffed, F.try_element_at(known, F.col("extension")), F.lit("application/octet-stream"))
    out = embedded.with_exif(scanned).withColumns({"mime_type": mime, "hash_md5": F.md5("content"), "hash_sha256": F.sha2("content", 256)})
    return out.withColumn("status", F.lit("enriched")).drop("content")


def enriched(catalogue: DataFrame, scanned: DataFrame) -> DataFrame:
    """The catalogue after enrichment: pending rows as ``enrich`` leaves them, with date_best; those whose file is gone
    (its path isn't among ``scanned``, read with content) have status error and a message; other rows stay."""
    known = [c for c in catalogue.columns if c not in ("mime_type", "hash_md5", "hash_sha256", "date_exif", "date_best", "error_message", "status")]
    pending = catalogue.filter("status = 'pending'").select(known)
    found = enrich(pending.join(scanned.select("path", "content"), "path"))
    created = F.col("date_created") if "date_created" in catalogue.columns else F.lit(None)
    found = found.withColumn("date_best", paths.best_date(F.col("date_exif").cast("timestamp"), F.col("date_modified").cast("timestamp"), created.cast("timestamp")))
    gone = pending.join(scanned.select("path"), "path", "left_anti").withColumns({"status": F.lit("error"), "error_message": F.concat(F.lit("File not found: "), F.col("path"))})
    rest = catalogue.filter("status IS NULL OR status <> 'pending'")
    return rest.unionByName(found, allowMissingColumns=True).unionByName(gone, allowMissingColumns=True)


def extract_text(rows: DataFrame, longest: int = office.LONGEST, largest: int = 100 << 20) -> DataFrame:
    """Adds text: the first characters of plain text, DOCX and XLSX files, empty for the rest and for huge ones."""
    kind = office.office_kind(F.col("extension"), F.col("mime_type"))
    plain = F.col("mime_type").startswith("text/") | F.lower("extension").isin(TEXT_EXTENSIONS)
    read = F.when(F.col("size_bytes") <= largest, F.col("content"))
    text = F.when(kind.isNotNull(), office.office_text(read, kind)).when(plain, office.plain_text(read))
    return rows.withColumn("text", F.coalesce(F.regexp_replace(F.substring(text, 1, longest), r"(?U)^\s+|\s+$", ""), F.lit("")))


def zip_manifests(rows: DataFrame) -> DataFrame:
    """path, entry, ord, total: the first entries of each archive; an unreadable one gives a row without entry."""

    def run(batches):
        for b in batches:
            out = []
            for path, content in zip(b.column("path").to_pylist(), b.column("content").to_pylist()):
                try:
                    names = zipfile.ZipFile(io.BytesIO(content or b"")).namelist()
                except (zipfile.BadZipFile, OSError):
                    out.append((path, None, None, None))
                    continue
                out += [(path, n, i, len(names)) for i, n in enumerate(names[:MANIFEST])]
            cols = list(zip(*out)) or [[], [], [], []]
            types = [pa.string(), pa.string(), pa.int32(), pa.int32()]
            yield pa.record_batch({k: pa.array(c, t) for k, c, t in zip(("path", "entry", "ord", "total"), cols, types)})

    return rows.select("path", "content").mapInArrow(run, "path string, entry string, ord int, total int")


def read_log(spark: SparkSession, path: str) -> DataFrame:
    """An undo log of JSON lines; malformed and blank lines are left out."""
    schema = "operation string, original_path string, new_path string, ts timestamp, sha256 string, session_id string, extra map<string,string>"
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)


def append_log(entries: DataFrame, path: str) -> None:
    entries.write.mode("append").json(path)


def keep_last(log: DataFrame, n: int) -> DataFrame:
    """The last n entries, by time, then by what they hold."""
    return log.orderBy(F.desc("ts"), F.desc(F.to_json(F.struct(*log.columns)))).limit(n)


def upsert_groups(old: DataFrame, new: DataFrame) -> DataFrame:
    """Groups (dupe_type, group_hash, keep_file_id): an old keeper stays, a missing one is filled."""
    n = new.withColumnRenamed("keep_file_id", "fresh")
    both = old.join(n, ["dupe_type", "group_hash"], "full_outer")
    return both.select("dupe_type", "group_hash", F.coalesce("keep_file_id", "fresh").alias("keep_file_id"))


def upsert_members(old: DataFrame, new: DataFrame) -> DataFrame:
    """Members (dupe_type, group_hash, file_id, similarity): those there are and the new ones, each once, the old similarity first."""
    both = old.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)))
    return both.groupBy("dupe_type", "group_hash", "file_id").agg(F.min_by("similarity", "_new").alias("similarity"))
