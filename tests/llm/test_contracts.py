"""Each registered query against a brute-force version over whole small tables."""

import hashlib
import re
import zlib

import duckdb
import pytest
from filequarry.llm import queries

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs():
    return duckdb.sql(f"SELECT doc_id, text, source, lang FROM '{SF}/documents.parquet' ORDER BY doc_id").fetchall()


def rows(spark, name, key="doc_id"):
    return {r[key]: r.asDict() for r in queries.QUERIES[name](spark, SF).collect()}


def sha(text):
    return hashlib.sha256(text.encode() if isinstance(text, str) else text).hexdigest()


def test_op3(spark, docs):
    got = rows(spark, "op3_mixing")
    size = {d: len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for d, t, *_ in docs}
    sources = sorted({s for *_, s, _ in docs})
    per = {s: sum(size[d] for d, _, x, _ in docs if x == s) for s in sources}
    weight = {s: 1 + i % 3 for i, s in enumerate(sources)}
    target, active, left = {}, set(sources), sum(per.values())
    while active:
        rate = left / sum(weight[s] for s in active)
        full = [s for s in active if weight[s] * rate > 3 * per[s]]
        for s in full:
            target[s] = 3 * per[s]
            left -= target[s]
        active -= set(full)
        if not full:
            target.update({s: weight[s] * rate for s in active})
            break
    taken = dict.fromkeys(sources, 0)
    for d, _, s, _ in docs:
        r = got[d]
        assert (r["size"], r["source_size"]) == (size[d], per[s]) and r["target"] == pytest.approx(target[s])
        assert 0 <= r["taken"] <= 3 * size[d]
        taken[s] += r["taken"]
    for s in sources:
        assert taken[s] == pytest.approx(target[s], abs=max(2, 0.02 * target[s]))


def test_op4(spark):
    got = rows(spark, "op4_chat", "conv_id")
    want = duckdb.sql(queries.OP4_SQL.replace("FROM conversations", f"FROM '{SF}/conversations.parquet'")).df()
    assert len(got) == len(want)
    for r in want.to_dict("records"):
        assert got[r["conv_id"]] == r
    assert -7 in got


def test_op6(spark, docs):
    email = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
    ip = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
    card = re.compile(r"[0-9]([\x20-]?[0-9])+")
    phone = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
    digits = lambda s: re.sub("[^0-9]", "", s)
    luhn = lambda s: sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(s))) % 10 == 0
    checks = {
        "email": (email, lambda m: True),
        "ip": (ip, lambda m: all(int(p) <= 255 for p in m.split("."))),
        "card": (card, lambda m: 13 <= len(digits(m)) <= 19 and luhn(digits(m))),
        "phone": (phone, lambda m: 9 <= len(digits(m)) <= 15),
    }
    got = rows(spark, "op6_pii")
    for d, t, *_ in docs:
        spans = {k: [m.span() for m in p.finditer(t) if ok(m[0])] for k, (p, ok) in checks.items()}
        assert {k: got[d][f"n_{k}"] for k in spans} == {k: len(v) for k, v in spans.items()}
        base = ",".join(f"{k}:{s}:{e}" for k, v in spans.items() for s, e in v)
        assert got[d]["base_sha256"] == sha(base)
        assert set(filter(None, base.split(","))) <= set(got[d]["spans"].split(","))


def test_op7(spark, docs):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(queries.tokenizer("byte_bpe_50k.json"))
    got = rows(spark, "op7_token_counts")
    for d, t, *_ in docs:
        n = len(tok.encode(t, add_special_tokens=False).ids)
        assert got[d] == {"doc_id": d, "n_bytes": len(t.encode()), "n_tokens": n, "over_limit": n > 1024}


def test_op10(spark, docs):
    import numpy as np
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(queries.tokenizer("word_bpe_49k.json"))
    got, start = rows(spark, "op10_token_output"), 0
    for d, t, *_ in docs:
        ids = [*tok.encode(t, add_special_tokens=False).ids, 2]
        assert got[d] == {"doc_id": d, "start": start, "n_tokens": len(ids), "ids_crc32": zlib.crc32(np.array(ids, "<u4").tobytes())}
        start += len(ids)


def test_op1(spark, docs):
    items = duckdb.sql(f"SELECT item_id, text FROM '{SF}/benchmark.parquet'").fetchall()
    words = lambda t: re.findall(r"[a-z0-9\u0080-\U0010ffff]+", re.sub("[A-Z]", lambda m: m[0].lower(), t))
    got = rows(spark, "op1_decontamination")
    whole = {i: " ".join(words(t)) for i, t in items}
    for d, t, *_ in docs:
        text = f" {' '.join(words(t))} "
        assert got[d]["contaminated"] or not any(f" {w} " in text for w in whole.values())
        if got[d]["contaminated"]:
            seen = set(words(t))
            assert len(seen & set(whole[got[d]["item_id"]].split())) >= 0.6 * len(set(whole[got[d]["item_id"]].split())) * 0.9


def test_op2(spark, docs):
    got, texts = rows(spark, "op2_fingerprints"), {}
    for k, (d, t, *_) in enumerate(docs):
        after = docs[(k + 1) % len(docs)]
        half = len(t) // 2
        assert got[d]["n_chars"] == len(t) and got[d]["edited_sha256"] == sha(t[: len(t) - half] + after[1][:half])
        texts.setdefault(t, set()).add(got[d]["fingerprint"])
        assert 0 <= got[d]["near_next"] <= 1 and (got[d]["near_next"] == 1 or t != after[1])
    assert all(len(f) == 1 for f in texts.values())
    long = [r for r in got.values() if r["n_chars"] > 300]
    assert sum(r["near_edited"] > r["near_next"] + 0.1 for r in long) > 0.97 * len(long)


def test_op5(spark, docs):
    got = rows(spark, "op5_minhash")
    sets = {}
    for d, t, *_ in docs:
        w = t.encode().lower().split()
        sets[d] = {tuple(w[i : i + 3]) for i in range(max(1, len(w) - 2))} if w else set()
        assert got[d]["n_shingles"] == len(sets[d])
    root = {d: d for d in sets}
    while True:
        before = dict(root)
        for a in sets:
            for b in sets:
                if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b]):
                    root[a] = root[b] = min(root[a], root[b])
        if root == before:
            break
    assert {d: r["component_id"] for d, r in got.items()} == root
    assert all(r["kept"] == (d == root[d]) for d, r in got.items())


@pytest.mark.parametrize("group", [2048, 2])
def test_op8(spark, docs, group, monkeypatch):
    from collections import Counter

    from filequarry.llm import suffix_dedup

    monkeypatch.setattr(suffix_dedup, "GROUP", group)
    got = rows(spark, "op8_suffix_dedup")
    raw = {d: t.encode() for d, t, *_ in docs}
    count = Counter(b[i : i + 200] for b in raw.values() for i in range(len(b) - 199))
    for d, b in raw.items():
        gone = bytearray(len(b))
        for i in range(len(b) - 199):
            if count[b[i : i + 200]] > 1:
                gone[i : i + 200] = b"\1" * 200
        kept = bytes(x for x, g in zip(b, gone) if not g)
        spans = len(re.findall(b"\1+", bytes(gone)))
        assert got[d] == {"doc_id": d, "n_bytes": len(b), "n_removed": sum(gone), "n_spans": spans, "kept_sha256": sha(kept)}


def test_op9(spark, docs):
    got = rows(spark, "op9_language")
    held = [(d, lang) for d, _, _, lang in docs if zlib.crc32(str(d).encode()) % 4 == 2]
    assert {d for d, r in got.items() if r["held_out"]} == {d for d, _ in held}
    assert sum(got[d]["lang_pred"] == lang for d, lang in held) >= 0.95 * len(held)
