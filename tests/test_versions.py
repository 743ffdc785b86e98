"""Versions and batches: writes that fail half-way and are done again."""

import pytest
from filequarry.operators import execution
from filequarry.sources import scan, versions
from filequarry.streaming import sessions
from pyspark.errors import StreamingQueryException
from pyspark.sql import DataFrameWriter


def rows(df):
    return sorted(map(tuple, df.collect()))


def test_versions(spark, tmp_path):
    path = f"file://{tmp_path}/t"
    assert versions.live(spark, path) is None
    one, two = spark.createDataFrame([(1, "a")], "id long, v string"), spark.createDataFrame([(2, "b")], "id long, v string")
    assert versions.commit(one, path, "first") == 1
    assert versions.merge(two, path, "second", lambda old, new: old.unionByName(new)) == 2
    # the same write again, and one by a key that has been
    assert versions.merge(two, path, "second", lambda old, new: old.unionByName(new)) == 2
    assert rows(versions.live(spark, path)) == [(1, "a"), (2, "b")]
    assert rows(versions.live(spark, path, 1)) == [(1, "a")]
    assert versions.commit(two, path, "wiped") == 3 and rows(versions.live(spark, path)) == [(2, "b")]


def test_a_version_without_its_line_is_not_seen(spark, tmp_path, monkeypatch):
    path = f"file://{tmp_path}/t"
    one, two = spark.createDataFrame([(1,)], "id long"), spark.createDataFrame([(2,)], "id long")
    versions.commit(one, path, "first")
    with monkeypatch.context() as m:
        m.setattr(DataFrameWriter, "json", lambda *a, **b: (_ for _ in ()).throw(OSError("lost")))
        with pytest.raises(OSError):
            versions.commit(two, path, "second")
    assert rows(versions.live(spark, path)) == [(1,)]
    assert versions.commit(two, path, "second") == 2 and rows(versions.live(spark, path)) == [(2,)]


def test_batch_that_fails_after_its_write_is_not_doubled(spark, tmp_path, monkeypatch):
    source, target, log, checkpoint = (f"file://{tmp_path}/{n}" for n in ("in", "out", "log", "check"))
    schema = "path string, size long"
    put = lambda *rows: spark.createDataFrame(list(rows), schema).coalesce(1).write.mode("append").parquet(source)
    read = lambda: sessions.ingest(spark, sessions.read_events(spark, source, schema), target, checkpoint, "path", log).awaitTermination()
    put(("/a", 1), ("/b", 2), ("/b", 2))
    with monkeypatch.context() as m:
        m.setattr(DataFrameWriter, "json", lambda *a, **b: (_ for _ in ()).throw(OSError("lost")))
        with pytest.raises(StreamingQueryException):
            read()
    assert rows(spark.read.parquet(target).select("path")) == [("/a",), ("/b",)]  # written, but not known to be
    read()
    assert rows(spark.read.parquet(target).select("path", "size")) == [("/a", 1), ("/b", 2)]
    put(("/b", 9), ("/c", 3))
    read()
    assert rows(spark.read.parquet(target).select("path", "size")) == [("/a", 1), ("/b", 2), ("/c", 3)]
    told = [(r.batches, r.found, r.fresh, r.skipped, r["last"]) for r in sessions.runs(spark, log).collect()]
    assert told == [(1, 2, 1, 1, "/c"), (1, 3, 2, 1, "/b")] and sessions.resume_point(spark, log) == "/c"


def test_upserts(spark):
    old = spark.createDataFrame([("exact", "h1", 1), ("exact", "h2", None), ("exact", "h3", 3)], "dupe_type string, group_hash string, keep_file_id long")
    new = spark.createDataFrame([("exact", "h1", 9), ("exact", "h2", 8), ("near", "h1", 7)], old.schema)
    assert rows(scan.upsert_groups(old, new)) == [("exact", "h1", 1), ("exact", "h2", 8), ("exact", "h3", 3), ("near", "h1", 7)]
    schema = "dupe_type string, group_hash string, file_id long, similarity double"
    members = scan.upsert_members(spark.createDataFrame([("exact", "h1", 1, 0.5)], schema), spark.createDataFrame([("exact", "h1", 1, 1.0), ("exact", "h1", 2, 1.0)], schema))
    assert rows(members) == [("exact", "h1", 1, 0.5), ("exact", "h1", 2, 1.0)]


def test_steps_of_an_undo_survive_a_write(spark, tmp_path):
    log = spark.createDataFrame([(i, "MOVE", i // 2) for i in range(50)], "id long, operation string, ts long").repartition(7)
    execution.undo_plan(log).write.parquet(f"file://{tmp_path}/plan")
    got = {r.id: r.step for r in spark.read.parquet(f"file://{tmp_path}/plan").collect()}
    assert got == {i: 50 - i for i in range(50)}
