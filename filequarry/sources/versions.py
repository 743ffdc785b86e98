"""Tables in versions: a write is seen whole or not at all, and the same write again changes nothing.

Each version is a folder of its own below the table's path; a line in the manifest, written last, makes it the
live one. A write that fails before leaves the old version live, and its folder is written anew by the next. A
write carries a key; one whose key is in the manifest has happened already. One writer at a time.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F

_MANIFEST = "version long, key string"


def _read(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines at ``path``; none where nothing has been written yet."""
    try:
        return spark.read.schema(schema).json(path)
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """version, key of the table's versions."""
    return _read(spark, f"{path}/_manifest", _MANIFEST)


def live(spark: SparkSession, path: str, version: int | None = None) -> DataFrame | None:
    """The table as of ``version``, the latest where none is given; None before the first."""
    known = manifest(spark, path)
    last = known.agg(F.max("version")).first()[0] if version is None else version
    return None if last is None else spark.read.parquet(f"{path}/version-{last}")


def commit(table: DataFrame, path: str, key: str) -> int:
    """Makes ``table`` the live version, with no row of those before, and returns its number, or that of the version that ``key`` has made before."""
    spark = table.sparkSession
    known = manifest(spark, path)
    made, last = known.agg(F.max(F.when(F.col("key") == key, F.col("version"))), F.max("version")).first()
    if made is not None:
        return made
    version = (last or 0) + 1
    table.write.mode("overwrite").parquet(f"{path}/version-{version}")
    spark.createDataFrame([(version, key)], _MANIFEST).coalesce(1).write.mode("append").json(f"{path}/_manifest")
    return version


def merge(new: DataFrame, path: str, key: str, how) -> int:
    """Makes ``how(live, new)`` the live version; ``new`` alone where there is none."""
    old = live(new.sparkSession, path)
    return commit(new if old is None else how(old, new), path, key)
