"""Groups of near duplicates against loops over all rows; equal rows are not paired with each other."""

import random
from difflib import SequenceMatcher

import pytest
from filequarry.operators import dedup
from filequarry.plans import registry


def greedy(ids, alike):
    taken, out = set(), set()
    for a in sorted(ids):
        if a not in taken:
            for b in sorted(ids):
                if b > a and b not in taken and alike(a, b):
                    taken.add(b)
                    out.add((a, b))
    return out


def changed(rng, text):
    letters = list(text)
    for _ in range(rng.randint(0, 8)):
        letters[rng.randrange(len(letters))] = rng.choice("abc ")
    return "".join(letters)


def test_text_groups_equal_loop(spark):
    rng = random.Random(1)
    base = ["".join(rng.choice("abcdefgh ") for _ in range(60)) for _ in range(6)]
    rows = [(i, rng.choice("xy"), changed(rng, rng.choice(base)) if i % 3 else rng.choice(base)) for i in range(120)] + [(900, "x", ""), (901, "x", None), (902, "y", "")]
    of = {i: (block, text) for i, block, text in rows}

    def alike(a, b):
        (p, x), (q, y) = of[a], of[b]
        return bool(p == q and x and y and abs(len(x) - len(y)) <= 0.1 * max(len(x), len(y)) and SequenceMatcher(None, x, y).ratio() >= 0.9)

    got = dedup.text_near_groups(spark.createDataFrame(rows, "id long, block string, text string"))
    assert {tuple(r) for r in got.collect()} == greedy(of, alike)


def test_semantic_groups_equal_loop(spark):
    rng = random.Random(2)
    words = ["red", "Blue", "green", "old", "new", "tall", "wide"]
    said = ["a red house by the sea", "a red horse by the sea", "Plans of a bridge", "", None]
    rows = [(i, rng.choice(["image", "image", "text", ""]), rng.choice(said), rng.sample(words, rng.randint(0, 4)) + rng.choice([[], [None], ["RED"]])) for i in range(110)] + [(500, "text", "x", None)]
    of = {i: (family, (d or "").lower(), {t.lower() for t in tags or [] if t}) for i, family, d, tags in rows}

    def alike(a, b):
        (f, d, s), (g, e, t) = of[a], of[b]
        if not s or not t or (f != g and f and g):
            return False
        text = SequenceMatcher(None, d, e).ratio() if d and e else 0.0
        return 0.4 * text + 0.6 * (len(s & t) / len(s | t)) >= 0.55

    got = dedup.semantic_groups(spark.createDataFrame(rows, "id long, family string, description string, tags array<string>"))
    assert {tuple(r) for r in got.collect()} == greedy(of, alike)


@pytest.mark.parametrize("copies", [60])
def test_equal_rows_are_one(spark, copies):
    same = spark.createDataFrame([(i, "x", "text " * 9, ["a", "b"], "1" * 64) for i in range(copies)], "id long, block string, text string, tags array<string>, bits string")
    assert dedup.hamming_pairs(same, 8).collect() == dedup.tag_pairs(same, 0.5).collect() == dedup.text_near_pairs(same).collect() == []
    assert dedup.length_band_pairs(same.withColumnRenamed("id", "id").selectExpr("id", "block", "length(text) AS size")).collect() == []
    assert {tuple(r) for r in dedup.text_near_groups(same).collect()} == {(0, i) for i in range(1, copies)}
    assert {tuple(r) for r in dedup.class_groups(dedup.classes(same, "bits"), dedup.hamming_pairs(same, 8)).collect()} == {(0, i) for i in range(1, copies)}


def test_hashes_compared_in_blocks_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(dedup, "HASH_BLOCK", 40)
    rng = random.Random(4)
    for bits, most in ((64, 16), (90, 24), (10, 4)):
        base = [rng.getrandbits(bits) for _ in range(8)]
        own = [(i, rng.choice(base) ^ sum(1 << b for b in rng.sample(range(bits), rng.randint(0, min(bits, 14))))) for i in range(150)]
        rng.shuffle(own)
        first = {x: (min(i for i, y in own if y == x), sum(y == x for _, y in own)) for _, x in own}
        want = sorted((a, b, (x ^ y).bit_count(), m, n) for x, (a, m) in first.items() for y, (b, n) in first.items() if a < b and (x ^ y).bit_count() <= most)
        pairs = dedup.hamming_pairs(spark.createDataFrame([(i, f"{x:0{bits}b}") for i, x in own] + [(999, None)], "id long, bits string"), most, bits)
        assert sorted(tuple(r) for r in pairs.collect()) == want and want
        assert "Join" not in pairs._jdf.queryExecution().executedPlan().toString()


def test_bands_are_never_broadcast(spark):
    pairs = dedup.hamming_pairs(spark.createDataFrame([(i, f"{i:064b}") for i in range(50)], "id long, bits string"), 8)
    plan = pairs._jdf.queryExecution().executedPlan().toString()
    assert plan.count("SortMergeJoin") == 3 and "BroadcastHashJoin" not in plan


def embeddings(spark, tmp_path, rng):
    vectors = [[rng.choice((-1.0, 1.0)) for _ in range(64)] for _ in range(4)]
    vectors += [[-x if k < 5 else x for k, x in enumerate(v)] for v in vectors[:2]]
    rows = [(i, vectors[rng.randrange(6)] if i % 9 else None) for i in range(60)]
    spark.createDataFrame(rows, "vec_id long, embedding array<double>").write.parquet(f"{tmp_path}/embeddings.parquet")
    return {i: v for i, v in rows if v}


def test_pairs_of_hashes_tell_every_row(spark, tmp_path):
    of = embeddings(spark, tmp_path, random.Random(5))
    got = registry.QUERIES["near_hamming_pairs"](spark, str(tmp_path)).collect()
    first = {i: min(j for j in of if of[j] == of[i]) for i in of}
    assert {(r.b, r.a) for r in got if r.distance == 0} == {(i, a) for i, a in first.items() if i != a}
    apart = lambda a, b: sum(x != y for x, y in zip(of[a], of[b]))
    # all pairs of rows follow from those of classes and their members
    members = {a: [i for i in of if first[i] == a] for a in first.values()}
    links = {tuple(sorted((i, j))) for r in got if r.distance for i in members[r.a] for j in members[r.b]} | {(i, j) for own in members.values() for i in own for j in own if i < j}
    assert links == {(i, j) for i in of for j in of if i < j and apart(i, j) <= 16}
    sizes = {i: len(m) for m in members.values() for i in m}
    assert all((r.na, r.nb) == (sizes[r.a], sizes[r.b]) for r in got)


def test_all_pairs_of_rows_are_listed(spark, tmp_path):
    of = embeddings(spark, tmp_path, random.Random(15))
    apart = lambda a, b: sum(x != y for x, y in zip(of[a], of[b]))
    got = sorted(tuple(r) for r in registry.QUERIES["near_hamming_row_pairs"](spark, str(tmp_path)).collect())
    assert got == sorted((i, j, apart(i, j)) for i in of for j in of if i < j and apart(i, j) <= 16) and {0, 5} <= {d for _, _, d in got}


def documents(spark, tmp_path, texts):
    rows = [(i, t, "en" if i % 2 else "de", "s", len(t or "")) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    return {i: ("en" if i % 2 else "de", t) for i, t in enumerate(texts)}


def links(got, of, same):
    """All pairs of rows that pairs of classes and members stand for."""
    first = {i: min(j for j in of if of[j] == of[i]) for i in of}
    assert sorted((r.b, r.a) for r in got if same(r)) == sorted((i, a) for i, a in first.items() if i != a)
    members = {a: [i for i in of if first[i] == a] for a in first.values()}
    assert all((r.na, r.nb) == (len(members[first[r.a]]), len(members[first[r.b]])) for r in got)
    return {tuple(sorted((i, j))) for r in got if not same(r) for i in members[r.a] for j in members[r.b]} | {(i, j) for own in members.values() for i in own for j in own if i < j}


def test_pairs_of_tags_tell_every_file(spark, tmp_path):
    rng = random.Random(6)
    texts = [" ".join(rng.choices("abcd", k=rng.randint(1, 7))) for _ in range(70)] + [None, None, "", ""]
    of = {i: (d, frozenset(t.split(" ")[:6])) for i, (d, t) in documents(spark, tmp_path, texts).items() if t is not None}
    got = registry.QUERIES["tag_jaccard_pairs"](spark, str(tmp_path)).collect()
    alike = {(i, j) for i, (d, s) in of.items() for j, (e, t) in of.items() if i < j and d == e and 2 * len(s & t) >= len(s | t)}
    assert links(got, of, lambda r: r.jaccard == 1) == alike


def test_pairs_of_sizes_tell_every_file(spark, tmp_path):
    rng = random.Random(7)
    texts = ["x" * rng.choice((1, 9, 10, 11, 40, 43, 44, 47)) for _ in range(60)] + ["", "", "", "", None, None]
    of = {i: (d, len(t)) for i, (d, t) in documents(spark, tmp_path, texts).items() if t is not None}
    got = registry.QUERIES["text_len_band_pairs"](spark, str(tmp_path)).collect()
    alike = {(i, j) for i, (d, s) in of.items() for j, (e, t) in of.items() if i < j and d == e and abs(s - t) <= 0.1 * max(s, t)}
    assert links(got, of, lambda r: r.sa == r.sb) == alike
