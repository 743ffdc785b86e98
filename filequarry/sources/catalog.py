"""The files table: its schema, and one derived from the documents and labels tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from filequarry.functions import paths


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Stems and extensions by id, so that naming rules have something to do.
STEM = """CASE id % 8
  WHEN 0 THEN concat('IMG_', lpad(cast(id % 10000 AS string), 4, '0'))
  WHEN 1 THEN concat('notes_', cast(id % 50 AS string))
  WHEN 2 THEN concat('Untitled ', cast(id % 7 AS string))
  WHEN 3 THEN concat(cast(id % 30 AS string), '.', cast(id % 12 AS string), '-plan')
  WHEN 4 THEN concat('My Report (', cast(id % 20 AS string), ') final')
  WHEN 5 THEN concat('report_', lang, '_report_', cast(id % 9 AS string))
  WHEN 6 THEN concat('doc-', cast(id % 100 AS string))
  ELSE concat('Quarterly   Budget #', cast(id % 13 AS string)) END"""
EXTENSION = "element_at(array('.txt', '.md', '.jpg', '.pdf', '.mp4', '.zip', '.HTML'), cast(id % 7 AS int) + 1)"
MIME = "element_at(array('text/plain', 'text/markdown', 'image/jpeg', 'application/pdf', 'video/mp4', 'application/zip', ''), cast(id % 7 AS int) + 1)"


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each document as if it were a file."""
    # what is read from texts is told before the join, so that texts need not be shuffled; a split goes no further than asked
    told = {"size_bytes": F.octet_length("text").cast("long"), "hash_md5": F.md5("text"), "ai_tags": F.slice(F.split(F.lower("text"), " ", 7), 1, 6)}
    docs = table(spark, sf_dir, "documents").withColumnRenamed("doc_id", "id").withColumns(told)
    labels = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("id"), "quality")
    out = docs.join(labels, "id", "left").withColumns({"stem": F.expr(STEM), "extension": F.expr(EXTENSION), "mime_type": F.expr(MIME)})
    out = out.withColumn("dir", F.concat(F.lit("/corpus/"), "source", F.lit("/"), "lang")).withColumn("filename", F.concat("stem", "extension"))
    return out.select(
        "id",
        F.concat(F.lit("s"), (F.col("id") % 3).cast("string")).alias("session_id"),
        F.concat("dir", F.lit("/"), "filename").alias("path"),
        "dir", "filename", "stem", "extension", "mime_type",
        "size_bytes", "hash_md5",
        F.expr("timestampadd(HOUR, cast(id * 37 % 20000 AS int), timestamp_ntz'2020-01-01 00:00:00')").alias("date_modified"),
        F.expr("timestampadd(SECOND, -cast(id % 5 AS int) * 20, timestampadd(HOUR, cast(id * 37 % 20000 AS int), timestamp_ntz'2020-01-01 00:00:00'))").alias("date_created"),
        F.expr("CASE WHEN id % 3 = 0 THEN timestampadd(HOUR, cast(id * 11 % 9000 AS int), timestamp_ntz'2019-01-01 00:00:00') END").alias("date_exif"),
        F.expr("CASE WHEN quality IS NULL THEN 'pending' WHEN quality = 1 THEN 'analyzed' ELSE 'enriched' END").alias("status"),
        "ai_tags",
        F.expr("CASE WHEN id % 10 = 0 THEN NULL ELSE (id % 10) / 10.0D END").alias("ai_confidence"),
        "text", "lang", "source",
    )


def with_best_date(frame: DataFrame) -> DataFrame:
    return frame.withColumn("date_best", paths.best_date(F.col("date_exif"), F.col("date_modified"), F.col("date_created")))


FILES_SQL = r"""
files AS (
  SELECT f.*, dir || '/' || filename AS path FROM (
    SELECT g.*, stem || extension AS filename FROM (
      SELECT d.doc_id AS id, 's' || CAST(d.doc_id % 3 AS VARCHAR) AS session_id, '/corpus/' || source || '/' || lang AS dir,
        CASE d.doc_id % 8
          WHEN 0 THEN 'IMG_' || lpad(CAST(d.doc_id % 10000 AS VARCHAR), 4, '0')
          WHEN 1 THEN 'notes_' || CAST(d.doc_id % 50 AS VARCHAR)
          WHEN 2 THEN 'Untitled ' || CAST(d.doc_id % 7 AS VARCHAR)
          WHEN 3 THEN CAST(d.doc_id % 30 AS VARCHAR) || '.' || CAST(d.doc_id % 12 AS VARCHAR) || '-plan'
          WHEN 4 THEN 'My Report (' || CAST(d.doc_id % 20 AS VARCHAR) || ') final'
          WHEN 5 THEN 'report_' || lang || '_report_' || CAST(d.doc_id % 9 AS VARCHAR)
          WHEN 6 THEN 'doc-' || CAST(d.doc_id % 100 AS VARCHAR)
          ELSE 'Quarterly   Budget #' || CAST(d.doc_id % 13 AS VARCHAR) END AS stem,
        ['.txt', '.md', '.jpg', '.pdf', '.mp4', '.zip', '.HTML'][CAST(d.doc_id % 7 AS INT) + 1] AS extension,
        ['text/plain', 'text/markdown', 'image/jpeg', 'application/pdf', 'video/mp4', 'application/zip', ''][CAST(d.doc_id % 7 AS INT) + 1] AS mime_type,
        CAST(octet_length(encode(text)) AS BIGINT) AS size_bytes, md5(text) AS hash_md5,
        TIMESTAMP '2020-01-01 00:00:00' + to_hours(CAST(d.doc_id * 37 % 20000 AS INT)) AS date_modified,
        TIMESTAMP '2020-01-01 00:00:00' + to_hours(CAST(d.doc_id * 37 % 20000 AS INT)) - to_seconds(CAST(d.doc_id % 5 AS INT) * 20) AS date_created,
        CASE WHEN d.doc_id % 3 = 0 THEN TIMESTAMP '2019-01-01 00:00:00' + to_hours(CAST(d.doc_id * 11 % 9000 AS INT)) END AS date_exif,
        CASE WHEN quality IS NULL THEN 'pending' WHEN quality = 1 THEN 'analyzed' ELSE 'enriched' END AS status,
        string_split(lower(text), ' ')[1:6] AS ai_tags,
        CASE WHEN d.doc_id % 10 = 0 THEN NULL ELSE (d.doc_id % 10) / 10.0::DOUBLE END AS ai_confidence, text, lang, source
      FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id) g) f
)
"""
