"""Counts, searches, pages and roll-ups of the catalogue."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

SORTABLE = ("id", "filename", "extension", "size_bytes", "status", "path")
STATUSES = ("pending", "enriched", "analyzed", "proposed", "skipped", "applied", "error")


def search(files: DataFrame, term: str, *columns: str) -> DataFrame:
    """Rows with the term, in any case, in one of the columns; % and _ count as themselves."""
    safe = term.replace("\\", "\\\\").replace("%", "\\%").replace("_", "\\_")
    found = F.lit(False)
    for c in columns:
        found = found | F.coalesce(F.col(c).ilike(f"%{safe}%"), F.lit(False))
    return files.filter(found)


def page(rows: DataFrame, sort: str, offset: int, limit: int, descending: bool = False) -> DataFrame:
    """A page by a known column (others: filename), ties by id, nulls first upwards."""
    sort = sort if sort in SORTABLE else "filename"
    key = F.desc_nulls_last(sort) if descending else F.asc_nulls_first(sort)
    return rows.orderBy(key, "id").offset(offset).limit(limit)


def with_status(rows: DataFrame, status: str | None) -> DataFrame:
    """Filter by status; an unknown one filters nothing."""
    return rows.filter(F.col("status") == status) if status in STATUSES else rows


def mime_families(files: DataFrame) -> DataFrame:
    family = F.when(F.col("mime_type").contains("/"), F.substring_index("mime_type", "/", 1)).otherwise("unknown")
    return files.groupBy(family.alias("family")).agg(F.count("*").alias("n"))


def top_extensions(files: DataFrame, most: int = 15) -> DataFrame:
    return files.filter("extension IS NOT NULL").groupBy("extension").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "extension").limit(most)


def session_rollup(files: DataFrame, proposals: DataFrame, groups: DataFrame) -> DataFrame:
    """session_id, files, bytes, proposals, groups: three aggregations joined on the session."""
    f = files.groupBy("session_id").agg(F.count("*").alias("files"), F.sum("size_bytes").alias("bytes"))
    p = proposals.groupBy("session_id").agg(F.count("*").alias("proposals"))
    g = groups.groupBy("session_id").agg(F.count("*").alias("groups"))
    return f.join(p, "session_id", "left").join(g, "session_id", "left").fillna(0, ["proposals", "groups"])


def page_with_total(rows: DataFrame, sort: str, offset: int, limit: int, descending: bool = False) -> DataFrame:
    """``page`` with total, the number of rows before the cut; counted in a pass of its own."""
    return page(rows, sort, offset, limit, descending).withColumn("total", F.lit(rows.count()).cast("long"))


def views(files: DataFrame) -> DataFrame:
    """Rows as they are shown: tags read from JSON (null where it is none), dates in ISO form."""
    dates = {c: F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss") for c in ("date_modified", "date_exif") if c in files.columns}
    return files.withColumns({"ai_tags": F.from_json("ai_tags", "array<string>"), **dates})
