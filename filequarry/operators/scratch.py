"""Cutting lineage between passes: tables in the folder that spark.checkpoint.dir names."""

from __future__ import annotations

import atexit
import functools
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, Window, functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; one of our own only where that is unset and Spark runs in one process."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        path = _own_dir()
    return path.rstrip("/")


@functools.cache
def _own_dir() -> str:
    path = tempfile.mkdtemp(prefix="filequarry-")
    atexit.register(shutil.rmtree, path, ignore_errors=True)
    return "file://" + path


def saved(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back, so that a lost executor costs no earlier pass."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: A key is hot if it has more than one in so many rows; so there are fewer hot keys than this.
HOT_SHARE = 2000


def join_hot(rows: DataFrame, table: DataFrame, keys: list[str], weight: str) -> DataFrame:
    """Inner join of ``rows`` with a written ``table`` that knows by ``weight`` how many rows each key has.

    Hot keys, fewer than ``HOT_SHARE`` by their definition, are broadcast so that their rows stay
    where they are; all others go through a shuffle.
    """
    total = table.agg(F.sum(weight)).first()[0] or 0
    hot = table.filter(F.col(weight) * HOT_SHARE > total)
    rest = table.filter(F.col(weight) * HOT_SHARE <= total)
    here = rows.join(F.broadcast(hot), keys)
    return here.unionByName(rows.join(F.broadcast(hot.select(*keys)), keys, "left_anti").join(rest.hint("merge"), keys).select(here.columns))


def ranked(rows: DataFrame, keys: list[str], order: list, name: str) -> DataFrame:
    """``rows`` with ``name``: 1, 2, ... within ``keys`` in ``order``, which tells rows apart.

    Rows are numbered within ranges of (keys, order), after the counts of the ranges before, so a key with
    many rows lies in many tasks. A range begins amid one key at most: no more counts than ranges are sent out.
    """
    ranged = saved(rows.repartitionByRange(*keys, *order).withColumn("_range", F.spark_partition_id()), "ranges")
    here = F.row_number().over(Window.partitionBy("_range", *keys).orderBy(*order))
    counts = ranged.groupBy("_range", *keys).agg(F.count("*").alias("_rows"))
    before = F.sum("_rows").over(Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1))
    before = saved(counts.withColumn("_before", before).filter("_before > 0").select("_before", F.col("_range").alias("_in"), *(F.col(k).alias(f"_of_{k}") for k in keys)), "before")
    same = F.col("_range") == F.col("_in")
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_of_{k}"))
    out = ranged.withColumn("_here", here).join(F.broadcast(before), same, "left")
    return out.select(*rows.columns, (F.col("_here") + F.coalesce("_before", F.lit(0))).alias(name))
