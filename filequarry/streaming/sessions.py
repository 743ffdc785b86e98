"""Streams: gap sessions of a log and catalogue ingestion in micro-batches."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F


def gap_sessions(log: DataFrame, key: str = "user_id", gap: str = "300 seconds", late: str = "1 hour") -> DataFrame:
    """key, started, ended, n of sessions: entries up to ``gap`` apart belong together.

    State is kept until the watermark passes a session's end. The end is its last entry plus the gap.
    """
    timed = log.withColumn("at", F.col("ts").cast("timestamp")).withWatermark("at", late)
    grouped = timed.groupBy(F.col(key), F.session_window("at", gap).alias("w")).agg(F.count("*").alias("n"))
    return grouped.select(key, F.col("w.start").alias("started"), F.col("w.end").alias("ended"), "n")


def read_events(spark: SparkSession, folder: str, schema: str, per_batch: int = 100) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_batch).parquet(folder)


RUNS = "run string, batch long, found long, fresh long, skipped long, last string, at timestamp"


def ingest(spark: SparkSession, source: DataFrame, target: str, checkpoint: str, key: str | None = None, log: str | None = None):
    """Add a stream's rows to the table at ``target``, all that there are now; the checkpoint remembers
    what was read, so a rerun adds only what is new.

    A batch is the table's partition of that number: one that is run again after a failure replaces what it wrote. With ``key``,
    rows whose key an earlier batch has are skipped, and of equal keys in a batch one stays. With ``log``, each batch leaves a
    line there: the run, how many rows it found, added and skipped, and the last key. One stream a table.
    """
    run = uuid.uuid4().hex

    def write(batch: DataFrame, batch_id: int) -> None:
        session = batch.sparkSession
        fresh = batch
        if key:
            fresh = batch.dropDuplicates([key])
            if batch_id:
                known = session.read.parquet(target).filter(F.col("batch") < batch_id)
                fresh = fresh.join(known.select(key), key, "left_anti").select(batch.columns)
        fresh.write.mode("overwrite").parquet(f"{target}/batch={batch_id}")
        if log:
            added = session.read.parquet(f"{target}/batch={batch_id}").count()
            last = F.max(F.col(key).cast("string")) if key else F.lit(None).cast("string")
            line = batch.agg(F.count("*").alias("found"), last.alias("last"))
            line = line.select(F.lit(run).alias("run"), F.lit(batch_id).cast("long").alias("batch"), "found", F.lit(added).cast("long").alias("fresh"), (F.col("found") - added).alias("skipped"), "last", F.current_timestamp().alias("at"))
            line.coalesce(1).write.mode("overwrite").json(f"{log}/batch-{batch_id}")

    return source.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def runs(spark: SparkSession, log: str) -> DataFrame:
    """run, batches, found, fresh, skipped, last, started, ended of the runs that :func:`ingest` logged, the latest first."""
    lines = spark.read.schema(RUNS).json(f"{log}/*")
    each = lines.groupBy("run").agg(F.count("*").alias("batches"), *(F.sum(c).alias(c) for c in ("found", "fresh", "skipped")), F.max_by("last", "batch").alias("last"), F.min("at").alias("started"), F.max("at").alias("ended"))
    return each.orderBy(F.desc("started"), "run")


def resume_point(spark: SparkSession, log: str) -> str | None:
    """The last key of the last batch that was finished."""
    row = spark.read.schema(RUNS).json(f"{log}/*").agg(F.max_by("last", "batch").alias("last")).first()
    return row["last"]
