"""The operators' methods against plain second computations, and their defined results in odd cases."""

import itertools
import random
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from filequarry.llm import chat, common, decontamination, fingerprints, langid, mixing, queries, suffix_dedup, token_counts, token_output
from filequarry.operators import scratch
from pyspark.sql import functions as F

ODD = ["a", "B", "é", "İ", "ß", "Σ", ".", ",", "!", "'s", "#", " ", "  ", "\n", "\x1c", "\x85", "\xa0", "　", "​", "́", "क़", "한", "1", "²", "×", "<|endoftext|>", "<|ENDOFTEXT|>", "<|", "\x00"]


def odd_texts(seed, n):
    rng = random.Random(seed)
    return ["".join(rng.choices(ODD, k=rng.randint(0, 14))) for _ in range(n)] + [None, ""]


def test_ids_of_odd_texts():
    from tokenizers import Tokenizer

    path = queries.tokenizer("word_bpe_49k.json")
    tok, texts = Tokenizer.from_file(path), odd_texts(1, 4000)
    ids, n = token_output.encode_texts(pa.array(texts, pa.string()), path, 2)
    for t, own in zip(texts, np.split(ids, np.cumsum(n)[:-1])):
        assert own.tolist() == [*tok.encode(t or "", add_special_tokens=False).ids, 2]


@pytest.mark.parametrize("hot", [20, 100_000])
def test_counts_of_odd_texts(spark, hot):
    from tokenizers import Tokenizer

    path = queries.tokenizer("byte_bpe_50k.json")
    tok, texts = Tokenizer.from_file(path), odd_texts(2, 4000)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = {r.doc_id: (r.n_bytes, r.n_tokens) for r in token_counts.token_counts(docs, path, hot=hot).collect()}
    assert got == {i: (len((t or "").encode()), len(tok.encode(t or "", add_special_tokens=False).ids)) for i, t in enumerate(texts)}


def test_no_key_of_all_documents(spark):
    """Only pre-tokens beyond the frequent ones are joined."""
    docs = spark.createDataFrame([(i, f"alpha beta word{i}") for i in range(500)], "doc_id long, text string").repartition(4)
    plan = token_counts.token_counts(docs, queries.tokenizer("byte_bpe_50k.json"))._jdf.queryExecution().optimizedPlan().toString()
    assert "isnotnull(unit" in plan and "isnull(unit" in plan


def test_common_long_pre_tokens(spark, monkeypatch):
    """A ruler of eighty hyphens in every text is joined where its rows are."""
    from tokenizers import Tokenizer

    seen = []
    monkeypatch.setattr(token_counts, "join_hot", lambda rows, table, keys, weight: seen.append(table) or common.join_hot(rows, table, keys, weight))
    path = queries.tokenizer("byte_bpe_50k.json")
    texts = [f"{'-' * 80} text {i} {'=' * 90 if i % 2 else ''} {'x' * (70 + i)}" for i in range(400)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = {r.doc_id: r.n_tokens for r in token_counts.token_counts(docs, path).collect()}
    tok = Tokenizer.from_file(path)
    assert got == {i: len(tok.encode(t, add_special_tokens=False).ids) for i, t in enumerate(texts)}
    weights = [r.weight for r in seen[0].collect()]
    rest = [w for w in weights if w * scratch.HOT_SHARE <= sum(weights)]
    assert max(weights) >= 200 and max(rest, default=0) <= max(1, sum(weights) // scratch.HOT_SHARE)


def test_sample_reaches_all_of_a_text(spark):
    """Words that tell the languages apart come after the first 150."""
    filler = " ".join(["mu"] * 400)
    texts = [(i, f"{filler} {' '.join([w] * 400)}", lang) for i, (w, lang) in enumerate([("alpha", "en"), ("omega", "fr")] * 40)]
    docs = spark.createDataFrame(texts, "doc_id long, text string, lang string")
    got = {r.doc_id: r.lang_pred for r in langid.identify(docs, langid.learn(docs)).collect()}
    assert got == {i: lang for i, _, lang in texts}


def test_keys_of_nested_objects_and_empty_arrays(spark):
    said = ['{"messages":[{"meta":{"a":1,"role":"q"},"content":"hi"}],"k":1}', '{"messages":[],"k":1}', '{"messages":[{"role":"user","content":"hi","meta":{"content":"no"}},{"role":null,"content":null}],"k":1}', '{"messages":["a"],"k":1}']
    df = spark.createDataFrame(list(enumerate(said)), "id int, j string").select("id", F.parse_json("j").alias("record"))
    got = {r.id: (r.layout, r.turns) for r in chat.canonical_turns(df).select("id", "layout", "turns").collect()}
    assert got[0] == (None, None) and got[3] == (None, None)
    assert got[1] == (None, [])
    assert got[2][0] == "messages" and [tuple(t) for t in got[2][1]] == [("user", "hi"), ("", "")]


def test_token_files(spark, tmp_path):
    docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.concat_ws(" ", F.lit("some words of document"), "id").alias("text"))
    out = f"{tmp_path}/tokens"
    token_output.write_tokens(docs, out, queries.tokenizer("word_bpe_49k.json"), 2)
    for file in (tmp_path / "tokens").glob("*.parquet"):
        group = pq.ParquetFile(file).metadata.row_group(0)
        for k in range(group.num_columns):
            c = group.column(k)
            assert c.has_offset_index and c.has_column_index
            if c.path_in_schema.startswith("ids"):
                assert c.has_dictionary_page
            if c.path_in_schema in ("doc_id", "start_in_block", "n_tokens"):
                assert "DELTA_BINARY_PACKED" in c.encodings
    got = token_output.read_tokens(spark, out).orderBy("doc_id").collect()
    assert [r.doc_id for r in got] == list(range(3000))
    assert [r.start for r in got] == [0, *itertools.accumulate(r.n_tokens for r in got)][:-1]


def longest_first(item, text, least):
    free_i, free_t, out = [True] * len(item), [True] * len(text), []
    while True:
        best = None
        for i, k in itertools.product(range(len(item)), range(len(text))):
            n = 0
            while i + n < len(item) and k + n < len(text) and item[i + n] == text[k + n] and free_i[i + n] and free_t[k + n]:
                n += 1
            if n >= least and (best is None or (-n, i, k) < best):
                best = (-n, i, k)
        if best is None:
            return sorted(out)
        n, i, k = -best[0], *best[1:]
        free_i[i : i + n] = free_t[k : k + n] = [False] * n
        out.append((i, k, n))


def test_tiles():
    rng = random.Random(3)
    for _ in range(300):
        letters = rng.choice((1, 2, 3, 5))
        item = [rng.randrange(letters) for _ in range(rng.randint(1, 30))]
        text = [rng.randrange(letters) for _ in range(rng.randint(1, 40))]
        if rng.random() < 0.5:
            text[rng.randrange(len(text)) : 0] = item[rng.randrange(len(item)) :]
        least = rng.randint(1, 5)
        assert sorted(decontamination.tiles(np.array(item, np.uint64), np.array(text, np.uint64), least)) == longest_first(item, text, least)


def test_coverage_of_all_items(spark):
    rng = random.Random(4)
    words = [f"t{i}" for i in range(12)]
    items = [(i if i else None, " ".join(rng.choices(words, k=rng.randint(1, 14)))) for i in range(12)] + [(None, items_twin := "t1 t2 t3 t4 t5 t6"), (77, items_twin)]
    docs = [(i, " ".join(rng.choices(words, k=rng.randint(0, 60))) + " " + rng.choice(items)[1]) for i in range(40)]
    frame = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    for r in decontamination.contamination(*frame).collect():
        own = docs[r.doc_id][1].split()
        found = []
        for i, t in items:
            tiles = longest_first(t.split(), own, min(5, len(t.split())))
            if tiles:
                found.append((-sum(n for *_, n in tiles) / len(t.split()), i is None, i or 0, len(tiles)))
        best = min(found) if found else (0, True, 0, 0)
        assert (r.n_items, r.coverage, r.item_id, r.n_tiles) == (len(found), pytest.approx(-best[0]), None if best[1] else best[2], best[3])


def test_quotas_are_highest_quotients():
    rng = random.Random(5)
    for _ in range(200):
        votes = [rng.randint(0, 60) for _ in range(rng.randint(1, 8))]
        caps = [rng.randint(1, 30) for _ in votes]
        seats = rng.randint(0, 40)
        want = [0] * len(votes)
        for _ in range(seats):
            open_ = [i for i in range(len(votes)) if want[i] < caps[i] and votes[i]]
            if not open_:
                break
            want[max(open_, key=lambda i: (votes[i] / (2 * want[i] + 1), -i))] += 1
        assert mixing.sainte_lague(votes, seats, caps) == want


def test_mix_takes_whole_blocks(spark):
    docs = spark.createDataFrame([(i, " ".join(["w"] * (i % 50)), "ab"[i % 3 > 0]) for i in range(300)], "doc_id long, text string, source string")
    got = mixing.mix(docs, block=7).collect()
    assert sorted(r.doc_id for r in got) == list(range(300)) and sorted(got) == sorted(mixing.mix(docs.repartition(7), block=7).collect())
    for s in "ab":
        own = [r for r in got if r.source == s]
        assert abs(sum(r.taken for r in own) - own[0].target) <= 14 and all(0 <= r.taken <= 3 * r.size for r in own)
        assert abs(sum(r.copies * r.size for r in own) - own[0].target) <= 0.2 * own[0].target


def plain_names(text):
    """Phrase names of one text, level by level, symbol by symbol."""
    mix = lambda x: int(fingerprints.mix64(np.array([x], np.uint64))[0])
    full = (1 << 64) - 1
    symbols, out, level = [mix(ord(c) + 1) for c in text], [], 0
    out += [(0, mix(s)) for s in symbols]
    while symbols:
        level += 1
        runs = [(s, len(list(g))) for s, g in itertools.groupby(symbols)]
        out += [(level, s) for s, n in runs if n > 1]
        symbols = [s if n == 1 else mix(s ^ mix(n)) for s, n in runs]
        label = symbols
        for _ in range(fingerprints.ROUNDS):
            new = []
            for k, x in enumerate(label):
                left = label[k - 1] if k else ~x & full
                low = ((x ^ left) & -(x ^ left)).bit_length() - 1
                new.append(low << 1 | (x >> low & 1))
            label = new
        cut = [k for k in range(len(label)) if k == 0 or (0 < k < len(label) - 1 and label[k - 1] < label[k] > label[k + 1])]
        phrases = [symbols[a:b] for a, b in zip(cut, [*cut[1:], len(symbols)])]
        symbols = [mix(sum(mix(s ^ (k * 0xD6E8FEB86659FD93 & full)) for k, s in enumerate(p)) & full ^ level) for p in phrases]
        out += [(level, s) for s in symbols]
        if len(symbols) == 1:
            break
    return sorted(out)


def test_phrase_names():
    rng = random.Random(6)
    texts = ["", "a", "aaaa", "abababab", *("".join(rng.choices("abc d", k=rng.randint(1, 120))) for _ in range(60))]
    named = fingerprints.phrase_names(texts)
    for k, t in enumerate(texts):
        assert sorted((level, int(x)) for level, owner, name in named for x in name[owner == k]) == plain_names(t)


def test_likeness_at_every_length():
    text = " ".join(f"word{i * 7919 % 1000}" for i in range(300))
    for n in (5, 20, 47, 80, 400, 2000):
        a = fingerprints.fingerprints([text[:n], text[: n + 1]])
        assert fingerprints.likeness(a[:1], a[1:])[0] > 0.65


def test_forward_backward_against_all_paths():
    rng = np.random.default_rng(7)
    e, a = np.exp(rng.normal(size=(1, 5, 3))), np.exp(rng.normal(size=(3, 3)))
    post = langid.forward_backward(e, np.ones((1, 5), bool), a)[0][0]
    want = np.zeros((5, 3))
    for path in itertools.product(range(3), repeat=5):
        p = np.prod([e[0, t, s] for t, s in enumerate(path)]) * np.prod([a[x, y] for x, y in zip(path, path[1:])])
        for t, s in enumerate(path):
            want[t, s] += p
    assert np.allclose(post, want / want.sum(axis=1, keepdims=True))


def test_long_chains_in_chunks(monkeypatch):
    model = langid.train([("the quick brown fox jumps over it", "en"), ("le renard brun saute par dessus", "fr")] * 4)
    texts = [("the quick fox le renard brun " * k).split() for k in (1, 9, 40)]
    whole = langid.Labeller(model).posteriors(texts)[0]
    monkeypatch.setattr(langid, "CHUNK", 4)
    assert np.allclose(whole, langid.Labeller(model).posteriors(texts)[0])


def test_letters_decide(spark):
    docs = spark.createDataFrame([(1, "hello over there", "en"), (3, "bonjour tout le monde", "fr"), (5, "² ½ Ⅷ 12", None), (6, None, None)], "doc_id long, text string, lang string")
    got = {r.doc_id: (r.lang_pred, r.score) for r in langid.identify(docs, langid.learn(docs)).collect()}
    assert got[5] == got[6] == ("und", 0.0) and got[1][0] == "en"


def test_every_language_is_learned(spark):
    docs = spark.createDataFrame([(i, f"word{i % 300} of tongue{i % 300}", f"l{i % 300:03}") for i in range(1200)], "doc_id long, text string, lang string")
    assert len(langid.learn(docs).languages) == 300


@pytest.mark.parametrize("group", [1, 4])
def test_crowded_anchors(spark, monkeypatch, group):
    monkeypatch.setattr(suffix_dedup, "GROUP", group)
    rng = random.Random(8)
    words = [f"w{i}" for i in range(200)]
    base = rng.choices(words, k=60)
    texts = []
    for _ in range(60):
        w = list(base)
        for _ in range(rng.randint(0, 3)):
            w[rng.randrange(60)] = rng.choice(words)
        texts.append(" ".join(w))
    texts += ["x" * 300, "x" * 120, None]
    raw = [(t or "").encode() for t in texts]
    seen = {}
    for b in raw:
        for i in range(len(b) - 49):
            seen[b[i : i + 50]] = seen.get(b[i : i + 50], 0) + 1
    got = suffix_dedup.remove_repeats(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), length=50).collect()
    for r in got:
        b = raw[r.doc_id]
        gone = {j for i in range(len(b) - 49) if seen[b[i : i + 50]] > 1 for j in range(i, i + 50)}
        assert bytes(r.kept) == bytes(x for j, x in enumerate(b) if j not in gone)


def test_chat_odd_records(spark):
    records = [
        ('{"prompt": "a", "completion": "b", "response": "c"}', "prompt_completion"), ('{"messages": [{"role": "user", "content": null}], "prompt": "p"}', "messages"),
        ('{"messages": []}', None), ('{"prompt": null, "response": "b", "x": {"y": [1]}}', "prompt_response"), ("[1, 2]", None), (None, None),
    ]
    df = spark.createDataFrame(records, "json string, want string").select("want", F.lit(1).alias("_head"), F.parse_json("json").alias("record"))
    got = chat.canonical_turns(df).collect()
    assert all(r.layout == r.want and r._head == 1 for r in got)
    assert [tuple(t) for t in got[1].turns] == [("user", "")]
    assert [tuple(t) for t in got[3].turns] == [("user", ""), ("assistant", "b")]


def test_chat_rows_keep_roles_and_order(spark):
    rows = [(1, 1, "gpt", "b"), (1, None, "human", "a"), (1, 1, "gpt", "a"), (2, 0, None, None), (None, 0, "user", "x")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    out = chat.format_turns(chat.canonical_turns(chat.rows_to_records(df))).select("conv_id", chat.read_back(F.col("formatted")).alias("t")).collect()
    got = {r.conv_id: [tuple(t) for t in r.t] for r in out}
    assert got == {1: [("human", "a"), ("gpt", "a"), ("gpt", "b")], 2: [("", "")], None: [("user", "x")]}
    assert chat.rows_to_records(df.filter("false")).collect() == []


def test_crc_of_ids(spark):
    docs = spark.createDataFrame([(2, "b"), (1, "a")], "doc_id long, text string")
    for r in token_output.token_output(docs, queries.tokenizer("word_bpe_49k.json")).collect():
        ids, _ = token_output.encode_texts(pa.array(["", "a", "b"][r.doc_id : r.doc_id + 1]), queries.tokenizer("word_bpe_49k.json"), 2)
        assert r.ids_crc32 == zlib.crc32(ids.astype("<u4").tobytes())
