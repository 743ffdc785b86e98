"""Near duplicates against all pairs on made-up near copies, with the limits of tasks set low."""

import random

import pytest
from filequarry.llm import minhash
from filequarry.operators import scratch


def brute(rows, words, percent):
    sets = []
    for _, t in rows:
        w = (t or "").lower().split()
        sets.append({tuple(w[i : i + words]) for i in range(max(1, len(w) - words + 1))} if w else set())
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, (a, _) in enumerate(rows):
        for j in range(i):
            near = sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j])
            if a is not None and rows[j][0] is not None and (near or a == rows[j][0]):
                root[find(i)] = find(j)
    least = {}
    for i, (a, _) in enumerate(rows):
        least[find(i)] = min(least.get(find(i), a), a) if a is not None else None
    return {(a, t, len(s), least[find(i)]) for i, ((a, t), s) in enumerate(zip(rows, sets))}


def made_up(seed, n, repeat_ids):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    bases = [rng.choices(vocabulary, k=rng.randint(30, 90)) for _ in range(3)]
    rows = []
    for i in range(n):
        w = list(bases[min(2, int(rng.expovariate(1.2)))])
        for _ in range(rng.choice((0, 0, 1, 1, 2, 3))):
            w[rng.randrange(len(w))] = rng.choice(vocabulary)
        rows.append((rng.randrange(n // 2) if repeat_ids else i, " ".join(w)))
    return rows + [(n + 1, None), (n + 2, ""), (None, rows[0][1]), (n + 3, "two words"), (n + 4, "Two words")]


@pytest.mark.parametrize("repeat_ids", [False, True])
def test_all_pairs(spark, monkeypatch, repeat_ids):
    monkeypatch.setattr(minhash, "BLOCK", 8)
    monkeypatch.setattr(minhash, "SALTED", 4)
    monkeypatch.setattr(minhash, "BROADCAST_IDS", 0)
    monkeypatch.setattr(scratch, "HOT_SHARE", 10)
    rows = made_up(11, 160, repeat_ids)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = minhash.near_duplicates(docs, words=3, percent=85)
    want = brute(rows, 3, 85)
    assert {(r.doc_id, r.n_shingles, r.component_id) for r in got.collect()} == {(a, n, c) for a, _, n, c in want}


def test_rows_that_share_an_id(spark):
    a, b = " ".join(f"a{i}" for i in range(60)), " ".join(f"b{i}" for i in range(60))
    rows = [(5, a), (5, b), (9, b + " z"), (8, a + " y")]
    got = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), words=3, percent=85).collect()
    assert sorted((r.doc_id, r.component_id, r.kept) for r in got) == [(5, 5, True), (5, 5, True), (8, 5, False), (9, 5, False)]
