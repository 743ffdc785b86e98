"""Groups of every kind with their similarity, keepers and proposals, against plain loops."""

import difflib
import random
from decimal import Decimal

from filequarry.operators import dedup
from pyspark.sql import functions as F

FILES = "id long, path string, size_bytes long, date_best timestamp_ntz, date_modified timestamp_ntz, date_created timestamp_ntz"


def test_rounding_is_of_the_binary_value(spark):
    values = [2.675, 0.125, 0.375, 1.005, 0.8675, 2.5, None, float("inf")]
    got = [r[0] for r in spark.createDataFrame([(v,) for v in values], "v double").coalesce(1).select(dedup.rounded(F.col("v"), 2)).collect()]
    assert got == [None if v is None else round(v, 2) for v in values]
    assert spark.createDataFrame([(0.9625,)], "v double").select(dedup.rounded(F.col("v"), 3)).first()[0] == round(0.9625, 3) == 0.963


def test_text_candidates(spark):
    rows = [("text/x", None, 1, True), (None, "PY", 200_000, True), (None, ".md", 200_001, False), ("text/plain", ".txt", 0, False), ("text/plain", ".txt", None, False), ("image/png", ".png", 5, False), (None, None, 5, False)]
    got = spark.createDataFrame(rows, "m string, e string, s long, want boolean").select("want", dedup.text_candidate(F.col("m"), F.col("e"), F.col("s")).alias("got")).collect()
    assert all(r.want == r.got for r in got)


def test_similarity_of_text_groups_equals_a_loop(spark):
    rng, texts = random.Random(8), []
    for _ in range(6):
        base = "".join(rng.choices("abcdef ", k=60))
        for _ in range(5):
            t = list(base)
            for _ in range(rng.randrange(4)):
                t[rng.randrange(60)] = rng.choice("abcdef ")
            texts.append("".join(t))
    rng.shuffle(texts)
    taken, want = set(), {}
    for i, a in enumerate(texts):
        if i not in taken:
            near = {j: r for j in range(i + 1, len(texts)) if j not in taken and (r := difflib.SequenceMatcher(None, a, texts[j]).ratio()) >= 0.9}
            if near:
                taken |= {i, *near}
                want[i] = (sorted([i, *near]), round(float(sum(Decimal(repr(r)) for r in near.values())) / len(near), 3))
    rows = spark.createDataFrame([(i, "", t) for i, t in enumerate(texts)], "id long, block string, text string")
    classes = dedup.classes(rows.withColumn("digest", F.sha2("text", 256)), "block", "digest")
    got = {}
    for r in dedup.group_members(dedup.scored_groups(classes, dedup.text_near_pairs(rows)), "content").collect():
        got.setdefault(r.group_id, [[], r.similarity, r.n])[0].append(r.file_id)
    assert {k: sorted(m) for k, (m, _, _) in got.items()} == {k: m for k, (m, _) in want.items()} and all(n == len(m) for m, _, n in got.values())
    assert {k: s for k, (_, s, _) in got.items()} == {k: s for k, (_, s) in want.items()}


def test_keepers_and_marks(spark):
    files = spark.createDataFrame([(1, "/a", 5, None, None, None), (2, "/a/long", 1, None, None, None), (3, "/c", 1, None, None, None), (4, "/d", 1, None, None, None), (5, "/e", 1, None, None, None)], FILES)
    members = spark.createDataFrame(
        [("exact", 7, 1, 1.0, None), ("exact", 7, 2, 1.0, None), ("semantic", 1, 1, 0.3, 3), ("semantic", 1, 3, 0.3, 3), ("content", 4, 4, 0.905, None), ("content", 4, 99, 0.905, None), ("perceptual", 3, 3, 0.95, None), ("perceptual", 3, 4, 0.95, 4), ("perceptual", 3, 5, 0.95, None)],
        "kind string, group_id long, file_id long, similarity double, keep_id long",
    )
    kept = dedup.with_keepers(members, files)
    # the longest path; a keeper there is; a group with one file left falls out
    assert {(r.kind, r.keep_id) for r in kept.collect()} == {("exact", 2), ("semantic", 3), ("perceptual", 4)}
    marked = spark.createDataFrame([(5,)], "file_id long")
    got = {r.file_id: (r.kind, r.proposed_value, r.confidence, r.reasoning) for r in dedup.marks(kept, marked, files, "bin").collect()}
    assert got == {
        1: ("exact", "/a/long", 1.0, "exact byte-for-byte duplicate (similarity=1.00). Will be moved to bin. Keeper: /a/long"),
        3: ("perceptual", "/d", 0.95, "perceptual near-duplicate (visually identical) (similarity=0.95). Will be moved to bin. Keeper: /d"),
    }
    assert dedup.marks(kept.limit(0), marked, files).count() == 0
    alone = dedup.marks(dedup.with_keepers(members.filter("kind = 'semantic'"), files), marked, files).first()
    assert (alone.file_id, alone.confidence) == (1, 0.5)
