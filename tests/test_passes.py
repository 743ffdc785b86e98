"""Composed passes against a plain loop; names from files to the end."""

import pytest
from filequarry.operators import passes, proposing
from filequarry.plans import registry, reorganised
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"


def test_passes_see_what_those_before_left(spark):
    files = spark.range(20).selectExpr("id", "concat('/r/', id, '.txt') AS path")
    of = lambda rows: rows.selectExpr("id AS file_id", "path AS current_value")
    add = lambda n, v: lambda files, known: of(files.filter(f"id % {n} = 0")).withColumns({"proposed_value": F.concat(F.lit(f"/r/{v}"), "file_id"), "confidence": F.lit(0.5)})
    steps = [
        passes.Pass("threes", add(3, "three")),
        passes.Pass("breaks", lambda files, known: known.filter(F.raise_error(F.lit("no")).isNotNull())),
        passes.Pass("twos", add(2, "two")),
        passes.Pass("longer", lambda files, known: known.filter("pass = 'twos'").select("file_id", F.concat("proposed_value", F.lit("_x")).alias("proposed_value")), passes.REWRITES),
        passes.Pass("double", lambda files, known: known.filter("proposed_value LIKE '%two8_x' OR file_id = 3").selectExpr("file_id", "0L AS keep_id", "1.0D AS similarity"), passes.MARKS),
        passes.Pass("rest", add(1, "rest")),
        passes.Pass("not there", lambda files, known: files.select("nowhere")),
    ]
    done = passes.compose(files, steps, files.filter("id = 4").selectExpr("id AS file_id"))
    want = {}
    for i in range(20):
        if i not in (3, 4, 8):
            want[i] = ("threes", f"/r/three{i}") if i % 3 == 0 else ("twos", f"/r/two{i}_x") if i % 2 == 0 else ("rest", f"/r/rest{i}")
    assert {r.file_id: (r["pass"], r.proposed_value) for r in done.proposals.collect()} == want
    assert {(r.file_id, r.keep_id, r["pass"]) for r in done.duplicates.collect()} == {(3, 0, "double"), (8, 0, "double")}
    told = {r["pass"]: (r.changed, r.error is None) for r in done.outcomes.collect()}
    assert told == {"threes": (7, True), "breaks": (0, False), "twos": (5, True), "longer": (5, True), "double": (2, True), "rest": (7, True), "not there": (0, False)}


@pytest.fixture(scope="module")
def composed(spark):
    return reorganised.composed_renames(spark, SF)


def test_names_from_files_to_the_end(spark, composed):
    files, done = composed
    outcomes = {r["pass"]: r for r in done.outcomes.collect()}
    assert [r.error for r in outcomes.values()] == [None] * 8
    before = {r.file_id: r for r in done.proposals.collect()}
    assert sum(r.changed for r in outcomes.values() if r["pass"] in ("content", "siblings", "groups", "useless", "hygiene")) == len(before) + done.duplicates.count()
    final = {r.file_id: r for r in passes.without_collisions(done.proposals, files).collect()}
    rows = {r.id: r for r in files.select("id", "dir", "path").collect()}
    assert not any(i % 11 == 3 for i in final)
    # whoever is not renamed keeps its name, and nobody else gets it
    ends = [final[i].proposed_value if i in final else None for i in rows]
    ends = [e for e in ends if e]
    assert len(set(ends)) == len(ends) > 50
    assert not set(ends) & {r.path for i, r in rows.items() if i not in final}
    assert all(r.proposed_value.rsplit("/", 1)[0] == rows[i].dir and r.current_value == rows[i].path for i, r in final.items())


def test_a_failed_pass_is_no_result(spark, monkeypatch):
    monkeypatch.setattr(proposing, "rename_proposals", lambda files, *more: files.filter(F.raise_error(F.lit("no")).isNotNull()))
    with pytest.raises(RuntimeError, match="pass content failed"):
        registry.QUERIES["final_renames"](spark, SF).collect()


def test_nothing_to_do(spark):
    files = spark.range(0).selectExpr("id", "'' AS path")
    done = passes.compose(files, [])
    assert done.proposals.collect() == done.duplicates.collect() == done.outcomes.collect() == []
