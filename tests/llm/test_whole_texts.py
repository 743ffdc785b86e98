"""Operators on whole texts: lengths and kinds that the small tables lack."""

from filequarry.llm import decontamination, pii


def test_several_blocks_of_items_equal_one(spark, monkeypatch):
    items = [(i, " ".join(f"w{i}x{k}" for k in range(12))) for i in range(40)]
    texts = [(j, f"before {items[j][1]} between {items[(j + 1) % 40][1]} after") for j in range(30)] + [(30, None), (31, "clean text"), (5, items[7][1]), (5, items[7][1])]
    docs = spark.createDataFrame(texts, "doc_id long, text string").repartition(3)
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = sorted(map(tuple, decontamination.contamination(docs, bench).collect()))
    monkeypatch.setattr(decontamination, "BLOCK_BYTES", 2000)
    got = sorted(map(tuple, decontamination.contamination(docs, bench).collect()))
    assert len(got) == len(texts) and got == want and sum(r[-1] for r in got) == 32


def test_grouped_ibans_separators_and_long_secrets():
    def spans(text, kind):
        return [text[a:b] for k, a, b in pii.find(text, pii.automaton()) if k == kind]

    assert spans("IBAN DE89 3704 0044 0532 0130 00 was paid", "account") == ["DE89 3704 0044 0532 0130 00"]
    assert spans("IBAN: GB82 WEST 1234 5698 7654 32.", "account") == ["GB82 WEST 1234 5698 7654 32"]
    assert spans("IBAN DE88 3704 0044 0532 0130 00", "account") == []
    assert spans("account number is: 123456", "account") == spans("acct 123456", "account") == ["123456"]
    url = "https://user:" + "s" * 200 + "@host.example"
    assert spans(f"see {url} now", "url") == [url]
    assert spans("://a:" * 100_000, "url") == [] == spans("account" + " " * 100_000, "account")
