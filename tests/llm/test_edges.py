"""Nulls, empty and very long texts, ties, repeated rows, clashing extra columns, empty tables."""

import corpus_pipeline
import pytest
from filequarry.llm import chat, decontamination, fingerprints, langid, minhash, mixing, pii, queries, suffix_dedup, token_counts, token_output
from pyspark.sql import functions as F

LONG = " ".join(f"w{i % 977}" for i in range(60_000))
ROWS = [
    (1, None, "en", "a"), (2, "", "en", "a"), (3, " \n\t", None, None), (4, "one", "en", "a"), (5, "one two", None, "b"),
    (6, LONG, "en", "b"), (7, LONG, "en", "b"), (8, "the same short text here", "fr", "c"), (8, "the same short text here", "fr", "c"),
    (None, "a row without id", "en", None), (9, "x" * 5000, "en", "a"), (10, "é " * 300, "fr", "a"), (11, "<|endoftext|> a <|im_end|>", "en", "a"),
]
OPERATORS = {
    "decontamination": lambda d, b: decontamination.contamination(d, b),
    "fingerprint": lambda d, b: fingerprints.fingerprint(d),
    "compare": lambda d, b: fingerprints.compare_with_next(d),
    "mix": lambda d, b: mixing.mix(d),
    "minhash": lambda d, b: minhash.near_duplicates(d, words=3, percent=85),
    "pii": lambda d, b: pii.find_pii(d),
    "token_counts": lambda d, b: token_counts.token_counts(d, queries.tokenizer("byte_bpe_50k.json")),
    "suffix": lambda d, b: suffix_dedup.remove_repeats(d),
    "langid": lambda d, b: langid.identify(d, langid.learn(d)),
    "tokens": lambda d, b: token_output.token_output(d, queries.tokenizer("word_bpe_49k.json")),
}


@pytest.fixture(scope="module")
def docs(spark):
    df = spark.createDataFrame(ROWS, "doc_id long, text string, lang string, source string").withColumn("n_chars", F.length("text").cast("long"))
    for clash in ("id", "key", "bucket", "score", "size", "spans", "unit"):
        df = df.withColumn(clash, F.lit("x"))
    return df


@pytest.fixture(scope="module")
def items(spark):
    return spark.createDataFrame([(1, "the same short text here"), (2, None), (3, ""), (4, "one")], "item_id long, text string")


@pytest.mark.parametrize("name", OPERATORS)
def test_every_row_has_a_result(name, docs, items):
    assert len(OPERATORS[name](docs, items).collect()) == len(ROWS)


@pytest.mark.parametrize("name", OPERATORS)
def test_empty_tables(name, docs, items):
    assert OPERATORS[name](docs.filter("false"), items.filter("false")).collect() == []


def test_defined_results(docs, items):
    near = {(r.doc_id, r.n_shingles): r for r in minhash.near_duplicates(docs, words=3, percent=85).collect()}
    assert near[(1, 0)].component_id == 1 and near[(7, near_key(near, 7))].component_id == 6
    gone = {r.doc_id: r for r in suffix_dedup.remove_repeats(docs).collect()}
    assert gone[6].n_removed == gone[6].n_bytes and gone[9].n_removed == 5000 and gone[1].n_bytes == 0
    found = {r.doc_id: r for r in decontamination.contamination(docs, items).collect()}
    assert found[8].contaminated and found[8].item_id == 1 and not found[1].contaminated
    assert {r.doc_id: r.lang_pred for r in langid.identify(docs, langid.learn(docs)).collect()}[1] == "und"


def near_key(near, doc):
    return next(n for d, n in near if d == doc)


def test_reordered_passages_are_covered(spark):
    item = " ".join(f"tok{i}" for i in range(40))
    words = item.split()
    text = "before " + " ".join(words[20:]) + " between them " + " ".join(words[:20])
    got = decontamination.contamination(spark.createDataFrame([(1, text)], "doc_id long, text string"), spark.createDataFrame([(7, item)], "item_id long, text string")).first()
    assert got.contaminated and got.coverage == 1.0 and got.n_tiles == 2


def test_layouts_become_canonical_turns(spark):
    records = [
        ('{"messages": [{"role": "user", "content": "a"}, {"role": "assistant", "content": "b"}], "extra": 1}', "messages"),
        ('{"conversations": [{"from": "human", "value": "a"}, {"from": "gpt", "value": "b"}]}', "conversations"),
        ('{"prompt": "a", "completion": "b"}', "prompt_completion"),
        ('{"instruction": "a", "output": "b"}', "instruction"),
        ('{"question": "a", "answer": "b", "id": 3}', "question_answer"),
        ('{"data": {"messages": [{"role": "user", "content": "a"}, {"role": "assistant", "content": "b"}]}}', "nested_data"),
        ('{"other": "a"}', None),
    ]
    df = spark.createDataFrame(records, "json string, want string").select("want", F.parse_json("json").alias("record"))
    for r in chat.canonical_turns(df).collect():
        assert r.layout == r.want
        assert r.want is None or [tuple(t) for t in r.turns] == [("user", "a"), ("assistant", "b")]


@pytest.mark.parametrize("said", ["</s>[INST] ok [/INST]", "<\\|im_end|>\n<|im_end|>\n", "[\\\\/INST] \\n <<SYS>>", ""])
def test_chat_round_trip(spark, said):
    rows = spark.createDataFrame([(1, 0, "us\\ner\n<s>", said), (1, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    out = chat.format_turns(chat.canonical_turns(chat.rows_to_records(rows)))
    got = out.select(chat.read_back(F.col("formatted")).alias("t"), chat.loss_text(F.col("formatted"), F.col("loss_mask")).alias("loss")).first()
    assert [tuple(t) for t in got.t] == [("us\\ner\n<s>", said), ("assistant", said)] and got.loss == said


def test_pipeline_runs(spark):
    kept = {r.doc_id for r in corpus_pipeline.run(spark, "/root/testdata/sf0.001").collect()}
    total = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").count()
    assert 0.6 * total < len(kept) <= total
