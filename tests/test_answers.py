"""Answers of a model, odd folder names and renames hard to tell apart, against plain second computations."""

import difflib
import random
from datetime import datetime

from filequarry.functions import garbled, replies, text
from filequarry.operators import dedup, folders, proposing, relations
from pyspark.sql import functions as F


def ratio(a, b):
    return difflib.SequenceMatcher(None, a, b).ratio()


def some_names(seed, count=40):
    rng, out = random.Random(seed), set()
    for _ in range(count):
        word = "".join(rng.choices("abcde_1", k=rng.randint(1, 16)))
        for _ in range(5):
            t = list(word)
            for _ in range(rng.randint(0, 3)):
                k = rng.randint(0, len(t))
                t[k : k + rng.randint(0, 1)] = rng.choice(("", "a", "x"))
            out.add("".join(t))
    return sorted(out)


def test_name_pairs_equal_brute_force(spark):
    rows = [(i, i % 2, n) for i, n in enumerate(some_names(3))] + [(-1, 0, ""), (-2, 1, None)]
    frame = spark.createDataFrame(rows, "id long, block long, text string")
    for least in (0.8, 0.92):
        want = {(a, b) for a, x, s in rows for b, y, t in rows if a != b and x == y and s and t and ratio(s, t) >= least}
        got = [(r.a, r.b) for r in dedup.name_pairs(frame, least).collect()]
        assert len(want) > 20 and len(got) == len(set(got)) and set(got) == want


def renames(spark):
    rng, names = random.Random(4), some_names(5, 20) + ["plan", "7_plan", "other"]
    rows = [(i, f"{rng.randint(1, 9)}.{i}-x" if i % 3 else "x", f"/d{i % 2}/" + ("4_" if i % 5 == 0 else "") + n + ".PDF"[: 4 * (i % 2)] + ".txt", rng.randint(1, 2), rng.choice((None, 1, 2, 3))) for i, n in enumerate(n for n in names if n)]
    rows += [(900, "1.1-a", "/alone/plan.txt", 1, 1), (901, "2.2-b", "/two/plan.txt", 1, 1), (902, "x", "/two/qqqqq.txt", 1, 1), (903, "5.5-c", "/two/qqqqq.txt", 1, 2)]
    day = lambda d: d and datetime(2020, 1, d)
    files = spark.createDataFrame([(i, s, size, day(d)) for i, s, _, size, d in rows], "id long, stem string, size_bytes long, date_modified timestamp_ntz")
    return rows, files, spark.createDataFrame([(i, p) for i, _, p, _, _ in rows], "file_id long, proposed_value string")


def parts(path):
    place, name = path.rsplit("/", 1)
    stem, dot, ext = name.rpartition(".")
    return place, stem, dot + ext


def core(stem):
    head = stem.lstrip("0123456789")
    return head[1:] if head != stem and head[:1] in ("_", ".") and head[:1] else stem


def test_told_apart_equals_brute_force(spark):
    rows, files, proposed = renames(spark)
    got = {r.file_id: r.proposed_value for r in proposing.told_apart(files, proposed).collect()}
    want = {}
    for i, present, path, _, _ in rows:
        place, stem, ext = parts(path)
        others = [core(parts(p)[1]) for j, _, p, _, _ in rows if j != i and parts(p)[0] == place]
        own = core(stem)
        if others and "-" in present and (own in text.GENERIC_STEMS or any(o == own or (o and own and ratio(own, o) >= 0.8) for o in others)):
            want[i] = f"{place}/{present.split('-')[0].replace('.', '_')}_{own}{ext}"
    assert 900 not in want and {901, 903} <= set(want) and len(want) > 10
    assert got == want


def test_near_duplicates_equal_brute_force(spark):
    rows, files, proposed = renames(spark)
    got = {r.file_id: (r.keep_id, round(r.similarity, 9)) for r in proposing.near_duplicate_proposals(files, proposed).collect()}
    firsts, pairs = {}, []
    for i, _, path, size, d in rows:
        place, stem, ext = parts(path)
        firsts.setdefault((place, ext.lower(), size, stem.lower()), []).append((i, d))
    for (place, ext, size, stem), members in firsts.items():
        pairs += [(members[0], m, 1.0) for m in members[1:]]
        pairs += [(members[0], o[0], ratio(stem, s)) for (p, e, z, s), o in firsts.items() if (p, e, z) == (place, ext, size) and s and stem and o[0][0] > members[0][0] and s != stem and ratio(stem, s) >= 0.92]
    want = {}
    for (a, da), (b, db), score in sorted(pairs, key=lambda p: (p[0][0], p[1][0])):
        late, keep = (b, a) if (db or 0) > (da or 0) else (a, b)
        want.setdefault(late, (keep, round(score, 9)))
    assert len(want) > 2 and got == want


def test_valid_groups_equal_brute_force(spark):
    rng = random.Random(6)
    known = {r: [f"f{k}" for k in range(rng.randint(0, 6))] for r in range(60)}
    answers = []
    for r in known:
        groups = [(rng.choice(("A b", None, "")), rng.choice((" why ", None)), [(rng.choice([f"f{k}" for k in range(8)] + [None]), rng.choice(("Source", "x", None, "export"))) for _ in range(rng.randint(0, 5))]) for _ in range(rng.randint(0, 5))]
        answers.append((r, groups if r else None))
    frame = spark.createDataFrame(answers, "response_id long, groups array<struct<label:string,reason:string,members:array<struct<filename:string,role:string>>>>")
    found = relations.valid_groups(frame, spark.createDataFrame([(r, f) for r, fs in known.items() for f in fs], "response_id long, filename string"))
    got = sorted((r.response_id, r.place, r.label, r.reason, tuple(map(tuple, r.members))) for r in found.collect())
    want = []
    for r, groups in answers:
        taken = set()
        for place, (label, reason, members) in enumerate(groups or []):
            own = {}
            for name, role in members:
                role = (role or "sibling").lower()
                if name in known[r]:
                    own.setdefault(name, role if role in relations.ROLES else "sibling")
            left = [(n, v) for n, v in own.items() if n not in taken]
            if len(own) >= 2 and len(left) >= 2:
                taken.update(n for n, _ in left)
                want.append((r, place, "a_b" if label == "A b" else "group", (reason or "").strip(), tuple(left)))
    assert len(want) > 15 and got == want


def test_json_of_replies(spark):
    cases = {
        '{"a": 1}': '{"a": 1}',
        " ```JSON\n[1]\n``` and more": "[1]",
        "```\n[1]": "[1]",
        'say {"p": "C:\\dir"} done': '{"p": "C:\\\\dir"}',
        'x [1, {"b": "}"}] y {': '[1, {"b": "}"}]',
        '{"a": 1} tail': '{"a": 1}',
        "tell { [3]": "[3]",
        '{"open": [1} [2]': None,
        '{"cut": "off': None,
        "{'a': 1}": None,
        '"just"': '"just"',
        "12": "12",
        "none": None,
        "": None,
        None: None,
    }
    frame = spark.createDataFrame([(k,) for k in cases], "reply string")
    assert {r.reply: r.json for r in frame.withColumn("json", replies.json_of(F.col("reply"))).collect()} == cases


def test_fields_of_odd_answers(spark):
    frame = spark.createDataFrame([('{"tags": "a, ,b", "date": "2020-02-30", "confidence": "high"}',), ("[1]",), ('{"tags": ' + str(["x"] * 25).replace("'", '"') + ', "detected_date": "", "date": "2021-3"}',), (None,)], "json string")
    got = frame.select(*(c.alias(k) for k, c in replies.fields(F.col("json")).items())).collect()
    assert [(r.tags, r.confidence, str(r.detected_date)) for r in got] == [(["a", "b"], 0.5, "None"), ([], 0.5, "None"), (["x"] * 20, 0.5, "2021-03-01"), ([], 0.5, "None")]
    assert {(r.description, r.suggested_name, r.transcript) for r in got} == {("", "", "")}


def test_recovered_names(spark):
    cases = {"ùìåí": "שלום", "Ìîñêâà": "Москва", "שלום".encode().decode("latin1"): "שלום", "München": None, "plain": None, "שלום": None, "": None, None: None}
    frame = spark.createDataFrame([(k,) for k in cases], "name string")
    assert {r.name: r.was for r in frame.withColumn("was", garbled.recovered(F.col("name"))).collect()} == cases


def test_likeness_equals_plain_count(spark):
    rng = random.Random(8)
    names = ["".join(rng.choices("אבגдЖЩщAbé 1_", k=rng.randint(1, 9))) for _ in range(300)]
    frame = spark.createDataFrame([(n,) for n in set(names)], "name string")

    def plain(name):
        letters = [c for c in name if c in "אבגдЖЩщ"]
        cased = [c for c in name if c.isupper() or c.islower()]
        changes = sum(a.isupper() != b.isupper() for a, b in zip(cased, cased[1:]))
        unlike = len(set(letters))
        bad = unlike < 2 or 2 * len(letters) < len(name.replace(" ", "")) or 2 * unlike < len(letters) or (len(cased) > 1 and changes > 0.5 * (len(cased) - 1))
        return 0 if bad else unlike

    assert all(r.score == plain(r.name) for r in frame.withColumn("score", garbled.likeness_to_words(F.col("name"))).collect())


def test_folders_of_other_scripts(spark):
    dirs = ["/r/漢字", "/r/.漢", "/r/_x y", "/r/--", "/r/done 1", "/r/a/漢字漢", "/r/.trash/b c", "/r/plain", "/other/x y", "/r/קב 1"]
    files = spark.createDataFrame([(i, d, ["Sea side"] if d == "/r/a/漢字漢" else None) for i, d in enumerate(dirs)], "id long, dir string, ai_tags array<string>")
    done = spark.createDataFrame([("/R/DONE 1/",)], "current_value string")
    got = {r.current_value: (r.proposed_value, r.confidence) for r in proposing.nonlatin_folders(files, "/r", done).collect()}
    assert got == {"/r/漢字": ("/r/non_latin_folder_1", 0.5), "/r/a/漢字漢": ("/r/a/sea_side", 0.6), "/r/קב 1": ("/r/kb_1", 0.6)}


def test_siblings_of_a_large_folder(spark):
    rows = [(i, "/d", f"{i:03d}.{e}", "." + e) for i, e in ((i, ("txt", "PDF", "pdf", "jpg")[i % 4]) for i in range(60))] + [(100, "/e", "only.txt", ".txt")]
    frame = spark.createDataFrame(rows, "id long, dir string, filename string, extension string")
    for r in folders.siblings(frame).collect():
        _, d, _, e = next(x for x in rows if x[0] == r.id)
        near = sorted(x for x in rows if x[1] == d and x[0] != r.id)
        kind = [[x[2] for x in near if (x[3].lower() == e.lower()) is same][:7] for same in (True, False)]
        assert r.names == kind[0] + kind[1]


def test_near_names_equal_all_pairs(spark, monkeypatch):
    rng = random.Random(12)
    words = ["report", "notes", "Übersicht", "plan\U0001f600", "a", "quarterly_budget", "x" * 70]
    texts = [(i, rng.choice("pqr"), "_".join(rng.choices(words, k=rng.randint(1, 3))) + rng.choice(("", "_1", "_27"))) for i in range(150)]
    texts = [(i, b, "".join(c for c in t if rng.random() > 0.07)) for i, b, t in texts] + [(900, "p", ""), (901, "p", ""), (902, "p", None)]
    want = {i for i, b, s in texts for j, c, t in texts if i != j and b == c and s and t and difflib.SequenceMatcher(None, s, t).ratio() >= 0.8}
    for size in (4096, 16):
        monkeypatch.setattr(dedup, "NAME_BLOCK", size)
        near = dedup.near_names(spark.createDataFrame(texts, "id long, block string, text string"), 0.8)
        assert sorted(r.id for r in near.collect()) == sorted(want) and 20 < len(want) < 150


def test_names_of_one_folder_go_to_many_tasks(spark, monkeypatch):
    monkeypatch.setattr(dedup, "NAME_BLOCK", 10)
    rows = spark.range(200).selectExpr("id", "'d' AS block", "concat('name_', id) AS text")
    dealt = dedup._dealt(rows)
    assert max(r["count"] for r in dealt.groupBy("block", "p", "q").count().collect()) < 80
    assert dealt.rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))
