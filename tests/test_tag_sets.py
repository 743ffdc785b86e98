"""Sets of tags meet on several tags at once: no pair is lost, and frequent tags alone make no candidates."""

import random
from difflib import SequenceMatcher

import pytest
from filequarry.operators import dedup


@pytest.mark.parametrize("least, wild", [(0.25, ""), (0.5, None)])
def test_tag_pairs_equal_loop(spark, least, wild):
    rng = random.Random(11)
    tags = [f"t{k}" for k in range(34)]
    rows = [(i, rng.choice(["x", "y", ""]), rng.sample(tags[:9], rng.randint(1, 7)) if i % 3 else rng.sample(tags, rng.randint(8, 30))) for i in range(160)]
    first = {(b, frozenset(t)): i for i, b, t in reversed(rows)}
    meet = lambda b, c: b == c or (wild is not None and wild in (b, c))
    want = {(i, j) for (b, s), i in first.items() for (c, t), j in first.items() if i < j and meet(b, c) and len(s & t) / len(s | t) >= least}
    got = dedup.tag_pairs(spark.createDataFrame(rows, "id long, block string, tags array<string>"), least, wild)
    assert {(r.a, r.b) for r in got.collect()} == want and want


def test_frequent_tags_make_no_candidates(spark):
    rows = [(i, "x", ["the", "of", f"a{i}", f"b{i}", f"c{i}", f"d{i}"]) for i in range(200)]
    sets = spark.createDataFrame(rows, "id long, block string, tags array<string>")
    assert dedup.tag_candidates(sets, 0.25).count() == 0


def test_pairs_are_scored_over_all_tasks(spark):
    rng = random.Random(13)
    rows = [(i, "text", " ".join(t), t) for i in range(60) for t in [rng.sample(["red", "blue", "green", "old", "new"], 3)]]
    pairs = dedup.semantic_pairs(spark.createDataFrame(rows, "id long, family string, description string, tags array<string>"))
    assert pairs.rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions")) > 1 and pairs.count()


def test_likeness_is_exact_where_it_counts():
    rng = random.Random(14)
    for _ in range(400):
        a, b = ("".join(rng.choices("abcd ", k=rng.randint(0, 12))) for _ in "ab")
        jaccard = rng.choice([0.25, 1 / 3, 0.5, 0.6, 1.0])
        want = 0.4 * (SequenceMatcher(None, a, b).ratio() if a and b else 0.0) + 0.6 * jaccard
        assert dedup.likeness(a, b, jaccard, 0.55) == (want if want >= 0.55 else pytest.approx(0, abs=0.55))
