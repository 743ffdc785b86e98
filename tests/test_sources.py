import os
import zipfile

import pytest
from filequarry.functions import paths, text
from filequarry.operators import dedup, execution, naming
from filequarry.sources import catalog, scan
from filequarry.streaming import sessions
from pyspark.sql import functions as F


def one(spark, value, f, kind="string"):
    return spark.createDataFrame([(value,)], f"v {kind}").select(f(F.col("v"))).first()[0]


@pytest.mark.parametrize("stem, want", [("My Report (Final Draft)", "My_Report_Final_Draft"), ("file&with#bad!chars", "file_with_bad_chars"), ("too    many", "too_many"), ("שלום עולם", "שלום_עולם")])
def test_hygiene(spark, stem, want):
    assert one(spark, stem, text.hygienic) == want


def test_slug(spark):
    assert one(spark, "שלום, World! 2", text.slug) == "שלום_world_2"
    assert len(one(spark, "a" * 100, text.slug)) == 60


def test_transliterate(spark):
    assert one(spark, "צרפתי", text.transliterate) == "tzrpty"
    assert one(spark, "תכניות עדכניות-A!", text.transliterate) == "tknyvt_adknyvt_a"


@pytest.mark.parametrize("stem, want", [("IMG_1234", True), ("", True), ("15.12", True), ("budget", False), (None, True)])
def test_useless(spark, stem, want):
    assert one(spark, stem, text.useless) is want


def test_hidden_name_has_no_suffix(spark):
    assert one(spark, "/a/.hidden", paths.suffix) == "" and one(spark, "/a/x.tar.gz", paths.suffix) == ".gz" and one(spark, "/a/.hidden", paths.stem) == ".hidden"


def test_hamming(spark):
    pairs = [("ff00", "ff00", 0), ("ff00", "ff01", 1), ("ffffffffffffffff", "0000000000000000", 64), ("ff", "fff", None), ("zz", "ff", None), ("", "", None), (None, "ff", None)]
    got = spark.createDataFrame(pairs, "a string, b string, d int").select("d", paths.hamming(F.col("a"), F.col("b")).alias("g")).collect()
    assert all(r.d == r.g for r in got)


@pytest.mark.parametrize("rules, path, is_dir, want", [
    (["*.log"], "a/b.log", False, True), (["*.log", "!keep.log"], "keep.log", False, False), (["build/"], "build", True, True),
    (["build/"], "build", False, False), (["/top.txt"], "a/top.txt", False, False), (["/top.txt"], "top.txt", False, True),
    (["**/node_modules"], "a/node_modules/x.js", False, True), (["# no", ""], "a", False, False), (["node_modules"], "node_modules/p", False, True),
])
def test_ignore(spark, rules, path, is_dir, want):
    assert one(spark, path, lambda c: scan.ignored(c, rules, is_dir)) is want


def test_scan_enrich_and_manifest(spark, tmp_path):
    for name, data in {"a.txt": b"hello", "b/c.TXT": b"caf\xe9", "node_modules/x.txt": b"", "d/._m": b"", "e.log": b"", "b/z.bin": b"\x89PNG1"}.items():
        (tmp_path / name).parent.mkdir(exist_ok=True, parents=True)
        (tmp_path / name).write_bytes(data)
    with zipfile.ZipFile(tmp_path / "f.zip", "w") as z:
        z.writestr("in/1.txt", "x")
        z.writestr("in/2.txt", "y")
    (tmp_path / "bad.zip").write_bytes(b"no zip")
    rows = scan.scan(spark, str(tmp_path), ["bad.zip"], content=True)
    full = scan.extract_text(scan.enrich(rows).join(rows.select("path", "content"), "path"))
    got = {r.relative: r for r in full.collect()}
    assert set(got) == {"a.txt", "b/c.TXT", "b/z.bin", "f.zip"}
    assert got["a.txt"].text == "hello" and got["b/c.TXT"].text == "café" and got["b/z.bin"].mime_type == "image/png"
    assert got["a.txt"].hash_md5 == "5d41402abc4b2a76b9719d911017c592"
    everything = scan.scan(spark, str(tmp_path), content=True).filter("extension = '.zip'")
    entries = sorted((os.path.basename(r.path), r.entry, r.total) for r in scan.zip_manifests(everything).collect() if r.entry)
    assert entries == [("f.zip", "in/1.txt", 2), ("f.zip", "in/2.txt", 2)]
    again = scan.incremental(rows.drop("content"), rows.drop("content"))
    assert again.count() == 4


def test_greedy_groups_chain_and_star(spark):
    edges = [(1, 2), (2, 3), (3, 4), (10, 11), (10, 12), (11, 12), (20, 22), (21, 22)]
    got = {(r.anchor, r.member) for r in dedup.greedy_groups(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {(1, 2), (3, 4), (10, 11), (10, 12), (20, 22)}


def test_collisions(spark):
    wanted = [(1, "/d", "plan", ".pdf", "10.8-x", "a.pdf"), (2, "/d", "plan", ".pdf", "y", "b.pdf"), (3, "/d", "plan", ".pdf", "z", "c.pdf"), (4, "/e", "new", ".pdf", "q", "q.pdf")]
    there = [("/d", "plan.pdf"), ("/d", "plan_1.pdf"), ("/e", "q.pdf")]
    df = spark.createDataFrame(wanted, "id long, dir string, stem string, ext string, original string, current string")
    got = {r.id: r.final for r in naming.resolve_collisions(df, spark.createDataFrame(there, "dir string, filename string")).collect()}
    assert got == {1: "10_8_plan.pdf", 2: "plan_2.pdf", 3: "plan_3.pdf", 4: "new.pdf"}


def test_validity_and_undo(spark):
    files = spark.createDataFrame([("/a",), ("/b",)], "path string")
    p = spark.createDataFrame([(1, "/a", "/c"), (2, "/a", "/b"), (3, "/x", "/y"), (4, "/a", "/a")], "id long, current_value string, proposed_value string")
    assert {r.id: r.outcome for r in execution.validity(p, files).collect()} == {1: "ok", 2: "taken", 3: "missing_source", 4: "no_op"}


def test_stream_gap_sessions(spark, tmp_path):
    rows = [(1, "2024-01-01 00:00:00"), (1, "2024-01-01 00:05:00"), (1, "2024-01-01 00:10:01"), (2, "2024-01-01 00:00:00"), (9, "2024-01-02 00:00:00")]
    spark.createDataFrame(rows, "user_id long, ts string").selectExpr("user_id", "cast(ts AS timestamp) AS ts").write.parquet(str(tmp_path / "in"))
    stream = sessions.gap_sessions(sessions.read_events(spark, str(tmp_path / "in"), "user_id long, ts timestamp"))
    q = stream.writeStream.format("memory").queryName("gaps").outputMode("append").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "ck")).start()
    q.awaitTermination(60)
    assert sorted((r.user_id, r.n) for r in spark.table("gaps").collect()) == [(1, 1), (1, 2), (2, 1)]


def test_ingest_reads_new_files_once(spark, tmp_path):
    for k in range(2):
        spark.range(k * 10, k * 10 + 10).write.mode("append").parquet(str(tmp_path / "in"))
        sessions.ingest(spark, sessions.read_events(spark, str(tmp_path / "in"), "id long"), str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination(60)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 20


def test_texts_do_not_pass_through_the_join_of_files(spark):
    told = catalog.files(spark, "/root/testdata/sf0.001").select("id", "status", "size_bytes", "hash_md5", "ai_tags")
    node = told._jdf.queryExecution().optimizedPlan()
    while node.nodeName() != "Join":
        node = node.children().head()
    names = [node.children().head().output().apply(k).name() for k in range(node.children().head().output().size())]
    assert sorted(names) == ["ai_tags", "hash_md5", "id", "size_bytes"]
