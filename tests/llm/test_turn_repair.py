"""Repair of turns: alignments against a search over all edits, the query against a plain loop."""

import heapq
import hashlib
import random
import re
import zlib
from collections import defaultdict

import duckdb
import pytest
from filequarry.llm import queries, turn_repair

SF = "/root/testdata/sf0.001"


def searched(rows):
    """Least (cost, audit) by best-first search over (row, place of the grammar); rows: (initial, forced, truncated)."""
    moves = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}
    heap, done = [(0, "", 0, "", ())], set()
    while heap:
        cost, audit, i, last, out = heapq.heappop(heap)
        if i == len(rows) and last in ("", "a"):
            return cost, audit, out
        if (i, last) in done:
            continue
        done.add((i, last))
        if i < len(rows):
            init, forced, truncated = rows[i]
            heapq.heappush(heap, (cost + 2, audit + "D", i + 1, last, out))
            if not forced:
                if (last, init) in moves:
                    heapq.heappush(heap, (cost + 5 * truncated, audit + "K", i + 1, init, (*out, (i, init))))
                for new in "ua":
                    if (last, new) in moves:
                        heapq.heappush(heap, (cost + 1 + 5 * truncated, audit + "R", i + 1, new, (*out, (i, "R" + new))))
        for new in "ua":
            if (last, new) in moves:
                heapq.heappush(heap, (cost + 5, audit + "I", i, new, (*out, (None, new))))


def random_rows(rng, n):
    return [(rng.choice("suaauuo"), rng.random() < 0.15, rng.random() < 0.15) for _ in range(n)]


def kinds_of(rows):
    return "".join("x" if forced else init.upper() if cut else init for init, forced, cut in rows)


def test_alignment_equals_search():
    rng = random.Random(1)
    for _ in range(1500):
        rows = random_rows(rng, rng.randint(1, 12))
        kinds = kinds_of(rows)
        assert turn_repair.best_edits(kinds, (1,) * len(rows), turn_repair.START, turn_repair.END) == searched(rows)[:2], kinds


def test_copies_have_to_go():
    assert turn_repair.best_edits("ua", (3, 1), turn_repair.START, turn_repair.END) == (4, "KDDK")


def plain(rows):
    """conv_id -> the contract's row, from damaged rows and all ids."""
    by = defaultdict(list)
    ids = []
    for conv, turn, role, text in rows:
        ids.append(conv)
        shown = lambda v: " " if v is None else str(v)
        hit = zlib.crc32(f"{shown(conv)}:{shown(turn)}".encode()) % 20
        role, text = shown(role), shown(text)
        if hit == 1:
            text = ""
        if hit == 2:
            text = re.sub("[.!?]", "", text)
        if hit == 4:
            role = "user"
        by[conv] += [(turn, role, text)] * (0 if hit == 0 else 2 if hit == 3 else 1)
    out = {}
    for conv in ids:
        mine = sorted(by[conv], key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.md5(f"{r[1]}\0{r[2]}".encode()).digest()))
        turns = [t for t, _, _ in mine if t is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        seen, faults, aligned = set(), [], []
        for _, role, text in mine:
            words = text.strip(" \t\n\x0b\x0c\r")
            fault = "blank" if not words else "duplicate" if (role, text) in seen else "truncated" if words[-1] not in ".!?" else ""
            seen.add((role, text))
            faults.append(fault)
            aligned.append((role[:1] if role[:1] in ("s", "u", "a") else "o", fault in ("blank", "duplicate"), fault == "truncated"))
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(mine, mine[1:]))
        cost, audit, made = searched(aligned)
        name = {"u": "user", "a": "assistant"}
        lines = [f"{name[how]}:" if i is None else f"{name[how[1]] if how[0] == 'R' else mine[i][1]}:{mine[i][2]}" for i, how in made]
        sha = hashlib.sha256("\n".join(lines).encode()).hexdigest()
        out[conv] = (conv, gaps, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), illegal, cost, audit, sha)
    return out


COLUMNS = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]


def result(df):
    got = df.select(COLUMNS).collect()
    assert len({r.conv_id for r in got}) == len(got)
    return {r.conv_id: tuple(r) for r in got}


def test_query_equals_plain_loop(spark):
    rows = duckdb.sql(f"SELECT conv_id, turn, role, text FROM '{SF}/conversations.parquet'").fetchall()
    assert result(queries.op12_turn_repair(spark, SF)) == plain(rows)


def made_up(rng):
    text = lambda: rng.choice(["", " ", "\x0b\n", "Yes.", "yes", "No! ", "é", "x" * 300 + "?", None])
    role = lambda: rng.choice(["user", "assistant", "system", "tool", "", "u2", None])
    rows = [(rng.randint(1, 60), rng.choice([None, *range(9)]), role(), text()) for _ in range(500)]
    rows += [(None, rng.choice([None, *range(40)]), role(), f"line {rng.randint(0, 60)}.") for _ in range(120)]
    rows += [(99, 0, "user", "Same.")] * 40 + [(98, i, rng.choice(["user", "assistant"]), f"Turn {i}{rng.choice('.,')}") for i in range(300)]
    return rows


@pytest.mark.parametrize(("block", "fan_in"), [(64, 4096), (5, 4)])
def test_long_and_odd_conversations(spark, monkeypatch, block, fan_in):
    monkeypatch.setattr(turn_repair, "BLOCK", block)
    monkeypatch.setattr(turn_repair, "FAN_IN", fan_in)
    rows = made_up(random.Random(7))
    df = spark.createDataFrame([(*r, "k", 1, "o") for r in rows], "conv_id long, turn long, role string, text string, kind string, n int, op string")
    assert result(turn_repair.repair(queries.damaged(df), df)) == plain(rows)


def test_empty(spark):
    df = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert turn_repair.repair(df).collect() == []


def test_all_dropped(spark):
    turn = next(t for t in range(99) if zlib.crc32(f"1:{t}".encode()) % 20 == 0)
    df = spark.createDataFrame([(1, turn, "user", "Hi.")], "conv_id long, turn long, role string, text string")
    assert result(turn_repair.repair(queries.damaged(df), df)) == {1: (1, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())}
