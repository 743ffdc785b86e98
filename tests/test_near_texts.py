"""Marks of texts: no pair that reaches the ratio is lost, and unlike texts with the same characters don't meet."""

import random
from difflib import SequenceMatcher

import pytest
from filequarry.operators import dedup, near_texts
from pyspark.sql import functions as F


def edited(rng, text, letters, share):
    text = list(text)
    for _ in range(int(len(text) * rng.uniform(0, share))):
        k = rng.randrange(len(text))
        text[k : k + rng.randint(0, 1)] = rng.choice(["", rng.choice(letters)])
    return "".join(text)


@pytest.mark.parametrize("least", [0.8, 0.9])
def test_no_near_text_is_lost(spark, monkeypatch, least):
    monkeypatch.setattr(near_texts, "TEXT_BLOCK", 12)
    rng = random.Random(8)
    texts = []
    for letters, length in (("abcdefgh ", 120), ("aeinrst hdlou.,TXYZ", 230), ("aeinrst hdlou.,TXYZ", 700), ("字漢aeiλ 𝒳", 300), ("aaaab ", 260)):
        base = ["".join(rng.choices(letters, [9] * 5 + [1] * (len(letters) - 5), k=length)) for _ in range(3)]
        texts += [edited(rng, rng.choice(base), letters, 0.08) for _ in range(24)]
    texts += ["x", "xy", "", "x", None]
    rng.shuffle(texts)
    first = {t: i for i, t in reversed(list(enumerate(texts))) if t}
    near = lambda x, y: abs(len(x) - len(y)) <= 0.1 * max(len(x), len(y)) and SequenceMatcher(None, x, y).ratio() >= least
    want = {(i, j) for x, i in first.items() for y, j in first.items() if i < j and near(x, y)}
    got = dedup.text_near_pairs(spark.createDataFrame([(i, "f", t) for i, t in enumerate(texts)], "id long, block string, text string"), least)
    assert {(r.a, r.b) for r in got.collect()} == want and any(len(texts[i]) > 200 for i, _ in want)
    assert all(near_texts.reaches(texts[i], texts[j], least) for i, j in want)


def test_unlike_texts_of_the_same_characters_do_not_meet(spark):
    rng = random.Random(9)
    words = ["".join(rng.choices(["th", "er", "in", "and", "on", "re", "ti"], k=3)) for _ in range(400)]
    texts = [". ".join(" ".join(rng.choices(words, k=9)).capitalize() for _ in range(25)) for _ in range(60)]
    rows = spark.createDataFrame(list(enumerate(texts)), "id long, text string").select("id", F.lit("f").alias("block"), "text", F.length("text").alias("size"))
    assert near_texts.candidates(rows, 0.9, 0.1).count() * 20 < 60 * 59 / 2


def test_marks_take_less_room_than_texts():
    rng = random.Random(10)
    words = ["".join(rng.choices(["th", "er", "in", "and", "on", "re", "ti", "bo", "ku", "wa", "gy"], k=3)) for _ in range(400)]
    frequent = near_texts._codes("aeinrt ")
    for lines, cells in ((9, 1 << 12), (100, 1 << 16)):
        text = ". ".join(" ".join(rng.choices(words, k=9)).capitalize() for _ in range(lines))
        _, asked, *_ = marks = near_texts.text_marks(text, frequent, 0.9, cells)
        assert asked and sum(len(m) for m in marks if isinstance(m, bytes)) < len(text)


def test_copies_meet_their_anchor_only(spark):
    rng = random.Random(12)
    letters = "aeinrst hdlou.,TXYZ"
    base = ["".join(rng.choices(letters, k=150)) for _ in range(2)]
    rows = spark.createDataFrame([(i, "f", edited(rng, base[i % 2], letters, 0.03)) for i in range(50)], "id long, block string, text string")
    pairs, scored = dedup.text_near_pairs(rows), dedup.text_anchor_pairs(rows)
    assert scored.count() * 5 < pairs.count()
    assert set(dedup.greedy_groups(scored).collect()) == set(dedup.greedy_groups(pairs).collect())
