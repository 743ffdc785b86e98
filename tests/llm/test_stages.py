"""Each pipeline stage on nulls, empty texts, repeated rows and ids, clashing columns and empty tables."""

import corpus_pipeline
import pytest
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"
COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"
EN = "the people of the town came to the market with their goods and their children every day of the week"
FR = "les gens de la ville venaient au marché avec leurs enfants et leurs produits tous les jours de la semaine"


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(1, EN, "en", "a"), (1, EN, "en", "a"), (2, FR, "fr", "b"), (3, None, "en", "a"), (4, "", None, None), (None, EN + " again", "en", "a"), (5, EN + " too", "en", None), (6, "12 34", "fr", "b"), (5, FR + " aussi", "fr", "b")]
    df = spark.createDataFrame([(*r, len(r[1] or "")) for r in rows], COLUMNS)
    return df.withColumns({"kept_id": F.lit(1), "bad_id": F.lit(1), "copies": F.lit(9), "k": F.lit(0), "size": F.lit("x")})


@pytest.mark.parametrize("name,stage", corpus_pipeline.STAGES)
def test_empty(spark, docs, name, stage):
    out = stage(spark, docs.filter("false"), SF)
    assert out.collect() == [] and (name == "token_output" or out.columns == corpus_pipeline.COLUMNS)


def test_language(spark, docs):
    got = corpus_pipeline.language(spark, docs, SF).collect()
    assert sorted(r.doc_id or 0 for r in got) == [0, 1, 1, 2, 5, 5]


def test_near_duplicates(spark, docs):
    got = corpus_pipeline.near_duplicates(spark, docs, SF).collect()
    # 5 is linked with 1 by its first row and with 2 by its second
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in got) == [(False, 1), (False, 3), (False, 4), (False, 6), (True, 0)]


def test_decontaminate(spark, docs):
    item = spark.read.parquet(f"{SF}/benchmark.parquet").first().text
    more = docs.unionByName(docs.limit(1).withColumns({"doc_id": F.lit(99).cast("long"), "text": F.lit(item)}))
    assert sorted(r.doc_id or 0 for r in corpus_pipeline.decontaminate(spark, more, SF).collect()) == sorted(r.doc_id or 0 for r in docs.collect())


def test_mix(spark, docs):
    got = corpus_pipeline.mix(spark, docs, SF).collect()
    assert got and {r.doc_id for r in got} <= {r.doc_id for r in docs.collect()}


def test_tokens(spark, docs):
    got = {r.doc_id: r.n_tokens for r in corpus_pipeline.tokens(spark, docs, SF).collect()}
    assert got[3] == got[4] == 1 and got[6] == 5
