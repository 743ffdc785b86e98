"""Folder profiles and the tree text against plain loops, with ties, nulls, empty tables and clashing columns."""

import random
from collections import Counter, defaultdict

from filequarry.operators import profile

SCHEMA = "id long, dir string, path string, filename string, category string, size_bytes long, status string, ai_tags array<string>, ai_description string, n long, kind string, place int"


def random_files(seed, count):
    rng, out = random.Random(seed), []
    dirs = ["/r", "/r/a", "/r/a/b", "/r/a b", "/r/z/deep", "/other"]
    for i in range(count):
        d, name = rng.choice(dirs), f"f{rng.randrange(9)}.txt"
        tags = rng.choice([None, [], [rng.choice(["Sea", "sea", "Sky", None, "sun", "moss", "ash", "fir", "oak", "elm", "yew"]) for _ in range(rng.randrange(7))]])
        said = rng.choice([None, "", "  The (harbour), the HARBOUR. Ship's mast; a 'quay' of it all one two harbour", "ships sail", "x, yy; zzz"])
        out.append((i, d, f"{d}/{name}", rng.choice([name, None]), rng.choice(["image", "image", "document", "other"]), rng.choice([None, 0, 1023, 1536, 5 << 20]), rng.choice(["analyzed", "skipped", None, "pending"]), tags, said, 7, "tag", 3))
    return out


def expected(rows):
    by = defaultdict(list)
    for r in rows:
        if r[6] != "skipped":
            by[r[1]].append(r)
    out = {}
    for d, files in by.items():
        cats, tags, words = Counter(), Counter(), Counter()
        for f in files:
            cats[f[4]] += 1
            tags.update(t.lower() for t in (f[7] or [])[:5] if t is not None)
            words.update(w for w in (w.strip(".,;:!?\"'()[]") for w in (f[8] or "").lower().split()[:10]) if len(w) > 3)
        inner = sorted(x.rsplit("/", 1)[1] for x in by if x.rsplit("/", 1)[0] == d)
        out[d] = (len(files), sum(f[5] or 0 for f in files), cats.most_common(), [t for t, _ in tags.most_common(8)], [w for w, _ in words.most_common(5)], [f[3] or f[2].rsplit("/", 1)[1] for f in files[:5]], inner[:8], len(inner))
    return out


def test_profiles_equal_a_loop(spark):
    for seed, count in ((1, 300), (2, 12), (3, 0)):
        rows = random_files(seed, count)
        got = {r.dir: (r.n, r.bytes, [tuple(c) for c in r.categories], r.tags, r.words, r.samples, r.children, r.n_children) for r in profile.profiles(spark.createDataFrame(rows, SCHEMA)).collect()}
        assert got == expected(rows)


def test_a_folder_with_many_children_lists_eight_and_counts_all(spark):
    rows = [(i, f"/r/c{i:02}" if i else "/r", "/r/p", "p", "other", 1, "pending", None, None, 0, "", 0) for i in range(40)]
    top = profile.profiles(spark.createDataFrame(rows, SCHEMA)).filter("dir = '/r'").first()
    assert top.children == [f"c{i:02}" for i in range(1, 9)] and top.n_children == 39


def test_tree_is_in_order_and_texts_join_to_it(spark, tmp_path):
    lines = profile.tree(spark.createDataFrame(random_files(4, 200), SCHEMA), "/r")
    got = lines.orderBy("place").collect()
    assert [r.place for r in got] == list(range(1, 7)) and [r.dir for r in got] == sorted(r.dir for r in got)
    assert got[0].text.startswith("[/other]  ") and got[1].text.startswith("[(root)]  ") and got[2].text.startswith("[a]  ")
    assert got[1].text.count("loose file at archive root") == min(20, sum(r[1] == "/r" and r[6] != "skipped" for r in random_files(4, 200)))
    whole = "\n".join(r.text for r in got)
    assert "\n".join(r.text for r in profile.tree_texts(lines, 4).orderBy("part").collect()) == whole
    profile.write_tree(lines, str(tmp_path / "tree"))
    parts = sorted((tmp_path / "tree").glob("part-*"))
    assert "".join(p.read_text() for p in parts) == whole + "\n"


def test_line_of_a_folder(spark):
    rows = [(i, "/r/a", f"/r/a/{i}", f"{i}.jpg", "document" if i == 2 else "image", 512, "pending", ["Sea", "sky"] if i < 2 else ["ink"] if i == 3 else None, "Blue harbour" if i == 0 else None, 0, "", 0) for i in range(4)]
    (got,) = profile.tree(spark.createDataFrame(rows, SCHEMA), "/r").collect()
    assert got.text == "\n".join([
        "[a]  4 files, 2 KB  |  75% image, 25% document  |  Tags: sea, sky, ink  |  Keywords: blue, harbour  |  Examples: 0.jpg, 1.jpg, 2.jpg",
        "    OUTLIER: 2.jpg (512 B, document) — type=document (folder is image)",
    ])
