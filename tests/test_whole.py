"""Queries and operators do their whole job: rows, lengths and kinds that the small tables lack."""

import difflib
import random
import re

from filequarry.operators import dedup, folders, naming
from filequarry.plans import registry


def documents(spark, tmp_path, texts):
    """A folder with the tables that files() reads, one document per text, ids from 0, all in /corpus/s/en."""
    spark.createDataFrame([(i, t, "en", "s") for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "doc_id long, quality long, toxic long").write.parquet(str(tmp_path / "labels.parquet"))
    return str(tmp_path)


def test_rare_spelling_late_in_a_text_is_found(spark, tmp_path):
    texts = ["decathlon decathlon " + "so it is " * 30 + "dekathlon", "decathlon"]
    got = registry.QUERIES["spelling_variants"](spark, documents(spark, tmp_path, texts)).collect()
    assert [tuple(r) for r in got] == [("dekathlon", "decathlon")]


def test_spelling_equals_brute_force(spark):
    rng, counts = random.Random(5), {}
    for _ in range(60):
        word = rng.choice(("so", "de")) + "".join(rng.choices("abcd", k=rng.randint(3, 26)))
        for _ in range(6):
            t = list(word)
            for _ in range(rng.randint(0, 3)):
                k = rng.randint(2, len(t))
                t[k : k + rng.randint(0, 1)] = rng.choice(("", "a", "e"))
            if len(t) >= 5:
                counts["".join(t)] = rng.randint(1, 4)
    ranked, want = sorted(counts, key=lambda t: (-counts[t], t)), {}
    for k, y in enumerate(ranked):
        # the first one before it that is not taken itself
        want.update({y: x for x in ranked[:k][::-1] if x not in want and x[:2] == y[:2] and difflib.SequenceMatcher(None, x, y).ratio() >= 0.85})
    got = naming.spelling(spark.createDataFrame(list(counts.items()), "token string, n long")).collect()
    assert len(want) > 50 and max(map(len, want)) > naming.LONGEST_KEYED
    assert dict(map(tuple, got)) == want


def test_spelling_of_no_tokens(spark):
    assert naming.spelling(spark.createDataFrame([], "token string, n long")).collect() == []


def test_padded_series_are_found(spark, tmp_path):
    got = registry.QUERIES["sequence_detect_all"](spark, documents(spark, tmp_path, ["a"] * 25)).filter("base = 'IMG'").collect()
    assert [(r.n, r.lowest, r.highest, r.width) for r in got] == [(4, 0, 24, 4)]


def test_tag_outliers_and_root_files(spark):
    rows = [(i, "/r/a", "image" if i % 2 else "video", 10 + i, ["beach", "sun"]) for i in range(6)] + [(6, "/r/a", "image", 900, None)]
    rows += [(10 + i, "/r/b", "image", 10, [f"t{k}" for k in range(8)][i:] * 2) for i in range(5)] + [(15, "/r/b", "document", 1, ["t0"]), (16, "/r/b", "image", 99, ["odd"]), (17, "/r/b", "other", 99, [])]
    rows += [(20 + i, "/r", "image", i, ["a"] if i < 2 else []) for i in range(3)]
    got = folders.misfits(spark.createDataFrame(rows, "id long, dir string, category string, size_bytes long, ai_tags array<string>"), "/r").orderBy("dir", "rank").collect()
    assert [(r.id, r.dominant, r.by_category, r.by_tags) for r in got if r.dir == "/r/b"] == [(15, "image", True, False), (16, "image", False, True)]
    assert [r.id for r in got if r.dir == "/r"] == [21, 20, 22]
    assert not [r for r in got if r.dir == "/r/a" and r.by_tags]
    mixed = [(i, "/r/c", ("image", "video")[i % 2], 1, [f"c{i % 8}", f"c{(i + 1) % 8}"]) for i in range(10)] + [(10, "/r/c", "image", 1, ["zzz"])]
    got = folders.misfits(spark.createDataFrame(mixed, "id long, dir string, category string, size_bytes long, ai_tags array<string>"), "/r").collect()
    assert [(r.id, r.dominant, r.by_category, r.by_tags, r.rank) for r in got] == [(10, None, False, True, 1)]


def test_sizes_of_long_documents_are_shown(spark, tmp_path):
    texts = ["x" * n for n in (1000, 1048575, 1048576, 3 << 19, 20 << 20)]
    got = registry.QUERIES["human_size"](spark, documents(spark, tmp_path, texts)).orderBy("id").collect()
    assert [r.shown for r in got] == ["1000 B", "1024.0 KB", "1 MB", "1.5 MB", "20 MB"]


def test_hamming_pairs_equal_brute_force(spark):
    rng = random.Random(9)
    base = [rng.getrandbits(64) for _ in range(12)]
    rows = []
    for i in range(150):
        h = rng.choice(base)
        for _ in range(rng.randint(0, 12)):
            h ^= 1 << rng.randrange(64)
        rows.append((i, f"{h:064b}"))
    rows += [(200, rows[0][1]), (201, rows[0][1]), (202, None)]
    df = spark.createDataFrame(rows, "id long, bits string")
    for most in (0, 3, 8, 13):
        got = {tuple(r) for r in dedup.hamming_pairs(df, most).collect()}
        dist = lambda x, y: (int(x, 2) ^ int(y, 2)).bit_count()
        first = {x: (min(i for i, y in rows if y == x), sum(y == x for _, y in rows)) for _, x in rows if x}
        want = {(a, b, dist(x, y), m, n) for x, (a, m) in first.items() for y, (b, n) in first.items() if a < b and dist(x, y) <= most}
        assert got == want and (want or most == 0)


def test_collisions_equal_settling_one_by_one(spark):
    rng = random.Random(10)
    stems = ["plan", "plan_1", "1_plan", "1_5_plan", "2", "2_1", "2020-01-02_x", "x"]
    wanted = [(i, rng.choice("de"), rng.choice(stems), rng.choice((".a", ".b")), rng.choice(("1.5-q", "2_r", "none", "1-z")), f"cur{i}.a") for i in range(90)]
    there = sorted({(rng.choice("de"), rng.choice(stems) + rng.choice((".a", ".b"))) for _ in range(9)} | {(d, c) for _, d, *_, c in wanted[:20]})
    taken, want = {}, {}
    for d, n in there:
        taken.setdefault(d, set()).add(n)
    for i, d, stem, ext, original, current in sorted(wanted):
        own, name, m = taken.setdefault(d, set()), stem + ext, re.match(r"(\d+(?:[._]\d+)*)[\s_.\-]", original)
        prefix = m and m[1].replace(".", "_")
        if name in own and name != current and prefix and not stem.startswith(prefix + "_") and not re.match(r"\d{4}-\d{2}-\d{2}", stem):
            stem = f"{prefix}_{stem}"
            name = stem + ext
        k = 0
        while name in own and name != current:
            k += 1
            name = f"{stem}_{k}{ext}"
        own.add(name)
        want[i] = name
    df = spark.createDataFrame(wanted, "id long, dir string, stem string, ext string, original string, current string")
    got = {r.id: r.final for r in naming.resolve_collisions(df, spark.createDataFrame(there, "dir string, filename string")).collect()}
    assert got == want


def test_spelling_broadcasts_no_tokens(spark, monkeypatch):
    plans, write = {}, naming.saved
    monkeypatch.setattr(naming, "saved", lambda df, label: plans.update({label: df._jdf.queryExecution().executedPlan().toString()}) or write(df, label))
    got = naming.spelling(spark.createDataFrame([("abcdefgh", 3), ("abcdefgi", 1), ("abcdefgi" * 3, 2), ("abcdefgi" * 3 + "x", 1)], "token string, n long"))
    assert {tuple(r) for r in got.collect()} == {("abcdefgi", "abcdefgh"), ("abcdefgi" * 3 + "x", "abcdefgi" * 3)}
    assert plans["near"].count("SortMergeJoin") == 2 and not any("BroadcastHashJoin" in p for p in plans.values())


def test_one_name_wanted_by_many_files(spark):
    n = 6000
    rows = [(i, "d", "x", ".a", "none", f"x_{n - i}.a" if i % 2 else "y.a") for i in range(n)]
    taken, want = {f"x_{k}.a" for k in (3, 5, n - 1)}, {}
    counter = 0
    for i, *_, current in rows:
        name = "x.a"
        if name in taken and name != current:
            k = int(current[2:-2]) if current != "y.a" else None
            while f"x_{counter + 1}.a" in taken and f"x_{counter + 1}.a" != current:
                counter += 1
            name = current if k and k <= counter else f"x_{counter + 1}.a"
        taken.add(name)
        want[i] = name
    df = spark.createDataFrame(rows, "id long, dir string, stem string, ext string, original string, current string")
    got = naming.resolve_collisions(df, spark.createDataFrame([("d", f"x_{k}.a") for k in (3, 5, n - 1)], "dir string, filename string"))
    assert {r.id: r.final for r in got.collect()} == want
