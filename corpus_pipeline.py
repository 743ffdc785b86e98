"""Five stages from raw documents to token files; each works on all that the one before kept.

All stages: columns other than those of documents are dropped, whatever their names. An empty table
gives no rows. Rows with a null id are documents of their own; a null text counts as empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from filequarry.llm import decontamination, langid, minhash, mixing, token_output
from filequarry.llm.common import written
from filequarry.llm.queries import table, tokenizer

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: Documents whose language is less certain than this go.
LEAST_SCORE = 0.4


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents with a language; null text, text without letters and text in no one language goes.

    Repeated rows are judged alike. If no row has a label, no language is known and all go.
    """
    labelled = langid.identify(docs.select(*COLUMNS), langid.learn(docs))
    return labelled.filter((F.col("lang_pred") != "und") & (F.col("score") >= LEAST_SCORE)).select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document, the smallest id, of each group of near duplicates.

    Rows that share an id are one document: of those the row with the least text stays. Rows with a
    null id are linked with nothing and stay, as do empty texts.
    """
    docs = docs.select(*COLUMNS)
    kept = minhash.near_duplicates(docs).filter("kept").select(F.col("doc_id").alias("kept_id")).distinct()
    # as many ids as documents: never broadcast
    stay = docs.join(written(kept, "kept").hint("merge"), docs.doc_id.eqNullSafe(F.col("kept_id")), "left_semi")
    if docs.filter("doc_id IS NOT NULL").groupBy("doc_id").count().filter("count > 1").isEmpty():
        return stay
    order = Window.partitionBy("doc_id").orderBy(F.asc_nulls_last("text"), "source", "lang", "n_chars")
    first = stay.filter("doc_id IS NOT NULL").withColumn("k", F.row_number().over(order)).filter("k = 1").select(*COLUMNS)
    return first.unionByName(stay.filter("doc_id IS NULL"))


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that cover a benchmark item, with all rows of their id; null texts and an empty benchmark drop nothing."""
    found = decontamination.contamination(docs, table(spark, sf_dir, "benchmark"))
    bad = written(found.filter("contaminated").select(F.col("doc_id").alias("bad_id")).distinct(), "bad")
    docs = docs.select(*COLUMNS)
    return docs.join(bad, docs.doc_id.eqNullSafe(F.col("bad_id")), "left_anti")


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as many times as the mix takes it; rows that share an id go as often as the one taken most.

    A null source is a source of its own. Texts without words go round with their shard.
    """
    copies = mixing.mix(docs).filter("copies > 0").select(F.col("doc_id").alias("mixed_id"), F.col("size"), "copies")
    copies = written(copies.groupBy("mixed_id").agg(F.max("copies").alias("copies")), "copies")
    docs = docs.select(*COLUMNS)
    taken = docs.join(copies.hint("merge"), docs.doc_id.eqNullSafe(F.col("mixed_id")))
    return taken.withColumn("turn", F.explode(F.sequence(F.lit(1), "copies"))).select(*COLUMNS)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token files; returns what is read back from them, the end id alone for a null text, ties in id by text."""
    return token_output.token_output(docs, tokenizer("word_bpe_49k.json"), end_id=2)


STAGES = [
    ("language_id", language),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontaminate),
    ("mixing", mix),
    ("token_output", tokens),
]

#: SQL can't express the stages (a trained model, signatures, tiling, a tokenizer).
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
