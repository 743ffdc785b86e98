"""Conversation structure repair: the cheapest edits that make turns alternate.

Roles must read ``(s?(ua)+)?`` by their initials. The edits of a conversation are Keep (0), Rerole to user or
assistant (1), Delete (2) and Insert of an empty user or assistant turn (5); blank turns and repeats of
an earlier turn have to go, and a truncated turn that stays costs 5. Turns are aligned by Wagner and
Fischer's table to each target string that the grammar allows, nearest lengths first; the best cost so
far bounds which lengths are looked at and, as Ukkonen's band, which cells of their tables. Among cheapest
edits the one whose initials (D, I, K, R) come first in ASCII is taken, by comparing backtraced audits.

A conversation may be of any length. Its turns are ordered in ranges and cut into blocks of at most
``BLOCK``; a long one is aligned block by block, for each state of the grammar in which a block may begin
and end, and the blocks' costs are combined in levels. Texts meet the edits once, in a stream sorted by
conversation: memory there is a batch, not a conversation. Only a digest of a whole conversation is
sequential by nature.

Nulls, ties, odd rows: a null role or text counts as one space, a null turn comes first, rows with a null
id are one conversation. Turns of one number come by role, then by a digest of their text; equal rows are
repeats. A role of other initials than s, u and a can only be reroled or deleted. An empty table gives
none. Further columns are dropped.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from filequarry.llm.common import written

#: Different turns that one alignment takes.
BLOCK = 64
#: Blocks, then groups of them, that one combining step takes.
FAN_IN = 4096
DELETE, INSERT, REROLE, TRUNCATED = 2, 5, 1, 5
SPACE = " \t\n\x0b\x0c\r"
ROLES = {"u": "user", "a": "assistant"}
#: Places of the grammar: nothing yet, after s, after u, after a; END: the conversation ends well here.
START, AFTER_S, AFTER_U, AFTER_A, END = range(5)
_NEVER = 1 << 60


def is_blank(text: Column) -> Column:
    return F.rtrim(text, F.lit(SPACE)) == ""


def is_truncated(text: Column) -> Column:
    return ~F.right(F.rtrim(text, F.lit(SPACE)), F.lit(1)).isin(".", "!", "?")


def turns_of(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text without nulls but in the first two, and a digest of role and text."""
    rows = conversations.select("conv_id", "turn", F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"))
    return rows.withColumn("digest", F.unhex(F.md5(F.concat("role", F.lit("\0"), "text"))))


def faults(turns: DataFrame) -> DataFrame:
    """One row for each different (conv_id, turn, role, digest): n rows of it, init, blank, repeat, truncated.

    repeat: an earlier turn says the same. Further copies of a row (n > 1) are repeats in any case.
    """
    init = F.substr("role", F.lit(1), F.lit(1))
    init = F.when(init.isin("s", "u", "a"), init).otherwise("o")
    runs = turns.groupBy("conv_id", "turn", "role", "digest").agg(F.count("*").alias("n"), F.first(is_blank(F.col("text"))).alias("blank"), F.first(is_truncated(F.col("text"))).alias("cut"))
    runs = written(runs, "runs")
    first = runs.groupBy(F.col("conv_id").alias("in_id"), F.col("role").alias("by"), F.col("digest").alias("said")).agg(F.min(F.struct("turn")).alias("first"))
    same = runs.conv_id.eqNullSafe(F.col("in_id")) & (runs.role == F.col("by")) & (runs.digest == F.col("said"))
    runs = runs.join(first, same).withColumn("again", ~F.col("first.turn").eqNullSafe(F.col("turn")))
    return runs.select(
        "conv_id", "turn", "role", "digest", "n", init.alias("init"), "blank", (~F.col("blank") & F.col("again")).alias("repeat"), (~F.col("blank") & ~F.col("again") & F.col("cut")).alias("truncated")
    )


def counts(runs: DataFrame) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated."""
    turn = F.col("turn").cast("long")
    return runs.groupBy("conv_id").agg(
        F.coalesce(F.max(turn) - F.min(turn) + 1 - F.count_distinct(turn), F.lit(0)).alias("gaps"),
        F.sum(F.when(F.col("blank"), F.col("n")).otherwise(0)).alias("blank"),
        F.sum(F.when(F.col("blank"), 0).when(F.col("repeat"), F.col("n")).otherwise(F.col("n") - 1)).alias("duplicate"),
        F.sum(F.col("truncated").cast("long")).alias("truncated"),
    )


def settled(runs: DataFrame) -> DataFrame:
    """Blocks of conversations with their edits: conv_id, block, items, cost, audit, illegal, first, last, ops.

    ops holds for each item the initials of turns to insert before it, then K, D, or R with the new
    initial, then those to insert after it.
    """
    ordered = runs.repartitionByRange("conv_id", "turn", "role", "digest").sortWithinPartitions("conv_id", "turn", "role", "digest")
    ordered = written(ordered.withColumn("place", F.monotonically_increasing_id()), "ordered")
    kind = F.when(F.col("blank") | F.col("repeat"), F.lit("x")).when(F.col("truncated"), F.upper("init")).otherwise(F.col("init"))
    item = F.struct("place", "turn", "role", "digest", "n", "init", kind.alias("kind"))
    blocks = ordered.groupBy("conv_id", F.expr(f"place div {BLOCK}").alias("block")).agg(F.sort_array(F.collect_list(item)).alias("items"))
    blocks = blocks.select("conv_id", "block", "items", _joined("kind").alias("kinds"), _joined("init").alias("inits"), F.col("items.n").alias("copies"))
    blocks = written(blocks, "blocks")
    many = blocks.groupBy("conv_id").agg(F.count("*").alias("k")).filter("k > 1").select(F.col("conv_id").alias("long_id"))
    of_long = blocks.conv_id.eqNullSafe(F.col("long_id"))
    whole = blocks.join(many, of_long, "left_anti").withColumn("entry", F.lit(START)).withColumn("leave", F.lit(END))
    parts = blocks.join(many, of_long, "left_semi")
    chosen = choices(parts).select(F.col("conv_id").alias("long_id"), F.col("node").alias("at"), "entry", "leave")
    parts = parts.join(chosen, of_long & (blocks.block == F.col("at"))).drop("long_id", "at")
    schema = "conv_id long, block long, items {}, cost long, audit string, illegal long, first string, last string, ops array<string>".format(blocks.schema["items"].dataType.simpleString())
    return written(whole.unionByName(parts).mapInArrow(_settle, schema), "settled")


def _joined(field: str) -> Column:
    return F.array_join(F.transform("items", lambda i: i[field]), "")


def choices(parts: DataFrame) -> DataFrame:
    """conv_id, node, entry, leave for each block (conv_id, block, kinds, copies) of conversations in several.

    Upwards, up to ``FAN_IN`` neighbours become one node with the cost of each way through it and their
    order by audit, until a conversation is one node; downwards, each node hands its children their part of the way.
    """
    node = "conv_id long, node long, costs array<long>, ranks array<int>"
    levels = [written(parts.select("conv_id", F.col("block").alias("node"), "kinds", "copies").mapInArrow(_ways, node), "ways")]
    while not levels[-1].groupBy("conv_id").count().filter("count > 1").isEmpty():
        below = F.sort_array(F.collect_list(F.struct("node", "costs", "ranks"))).alias("below")
        above = levels[-1].groupBy("conv_id", F.expr(f"node div {FAN_IN}").alias("node")).agg(below)
        levels.append(written(above.mapInArrow(_combined, f"{node}, children array<long>, paths array<binary>"), "ways"))
    chosen = levels[-1].select("conv_id", "node", F.lit(START).alias("entry"), F.lit(END).alias("leave"))
    for level in reversed(levels[1:]):
        up = chosen.select(F.col("conv_id").alias("up_id"), F.col("node").alias("up"), "entry", "leave")
        path = level.join(up, level.conv_id.eqNullSafe(F.col("up_id")) & (level.node == F.col("up")))
        path = path.select("conv_id", "children", "entry", F.col("paths")[F.col("entry") * 5 + F.col("leave")].alias("path"))
        step = path.select("conv_id", "entry", "path", F.posexplode("children").alias("k", "node"))
        state = lambda k: F.conv(F.hex(F.substring("path", k, F.lit(1))), 16, 10).cast("int")
        chosen = step.select("conv_id", "node", F.when(F.col("k") == 0, F.col("entry")).otherwise(state(F.col("k"))).alias("entry"), state(F.col("k") + 1).alias("leave"))
    return chosen


def repaired(turns: DataFrame, edits: DataFrame) -> DataFrame:
    """conv_id, role, text of repaired conversations, each conversation's turns in order in one partition."""
    item = F.explode(F.arrays_zip("items", "ops")).alias("z")
    ops = edits.select("conv_id", item).select("conv_id", "z.items.turn", "z.items.role", "z.items.digest", F.col("z.ops").alias("op"))
    both = turns.withColumn("op", F.lit(None).cast("string")).unionByName(ops, allowMissingColumns=True)
    both = both.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "digest", F.desc("op"))
    return both.select("conv_id", "role", "text", "op").mapInArrow(_edited, "conv_id long, role string, text string")


def digests(lines: DataFrame) -> DataFrame:
    """conv_id and the SHA-256 of its ``role:text`` lines, from :func:`repaired`."""
    return lines.mapInArrow(_hashed, "conv_id long, repaired_sha256 string")


def repair(conversations: DataFrame, original: DataFrame | None = None) -> DataFrame:
    """Faults, edits and a digest of the repaired turns, a row for each conv_id of ``original`` (default: the same rows)."""
    turns = turns_of(conversations)
    runs = written(faults(turns), "faults")
    edits = settled(runs)
    block = F.sort_array(F.collect_list(F.struct("block", "audit", "first", "last")))
    by_conv = edits.groupBy("conv_id").agg(F.sum("cost").alias("cost"), F.sum("illegal").alias("illegal"), block.alias("blocks"))
    seams = F.zip_with(F.slice("blocks", 1, F.size("blocks") - 1), F.slice("blocks", 2, F.size("blocks")), lambda a, b: F.concat(a["last"], b["first"]))
    seams = F.size(F.filter(seams, lambda s: ~s.isin("su", "ua", "au")))
    audits = by_conv.select("conv_id", "cost", (F.col("illegal") + F.when(F.size("blocks") > 1, seams).otherwise(0)).alias("illegal"), F.array_join("blocks.audit", "").alias("audit"))
    parts = (original if original is not None else conversations).select(F.col("conv_id").cast("long").alias("conv_id"))
    for more in (counts(runs), audits, digests(repaired(turns, edits))):
        parts = parts.unionByName(more, allowMissingColumns=True)
    numbers = [F.coalesce(F.max(c), F.lit(0)).cast("long").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    empty = hashlib.sha256(b"").hexdigest()
    return parts.groupBy("conv_id").agg(*numbers, F.coalesce(F.max("audit"), F.lit("")).alias("audit"), F.coalesce(F.max("repaired_sha256"), F.lit(empty)).alias("repaired_sha256"))


def _targets(entry: int, leave: int, longest: int) -> list[str]:
    """The strings up to a length that lead from one place of the grammar to another."""
    heads = ["", "s"] if entry == START else [""]
    turns = ("au" if entry == AFTER_U else "ua") * (longest // 2 + 1)
    found = [head + turns[:k] for head in heads for k in range(longest - len(head) + 1)]
    ends = (START, AFTER_A) if leave == END else (leave,)
    after = {"s": AFTER_S, "u": AFTER_U, "a": AFTER_A}
    return [t for t in found if (after[t[-1]] if t else entry) in ends]


@functools.lru_cache(200_000)
def best_edits(kinds: str, copies: tuple[int, ...], entry: int, leave: int) -> tuple[int, str]:
    """Least cost and first audit of a block between two places of the grammar; a cost of ``_NEVER`` where there is none.

    kinds: s, u, a or o for each item, upper-case if truncated, x if it has to go; further copies have to go.
    A block that another follows ends with no insertion: the next one begins with it.
    """
    rows = [(k, 1) if k != "x" else (k, n) for k, n in zip(kinds, copies)]
    rows = [r for (k, w), n in zip(rows, copies) for r in ([(k, w), ("x", n - 1)] if k != "x" and n > 1 else [(k, w)])]
    free = [0]
    for kind, _ in rows:
        free.append(free[-1] + (kind != "x"))
    forced = DELETE * sum(w for k, w in rows if k == "x")
    best, audit = _NEVER, ""
    # all edits of one cost at most: rows deleted, a whole target inserted
    longest = free[-1] + 2 + DELETE * free[-1] // INSERT
    for target in sorted(_targets(entry, leave, longest), key=lambda t: abs(len(t) - free[-1])):
        off = len(target) - free[-1]
        limit = min(best, forced + DELETE * free[-1] + INSERT * len(target))
        if forced + (INSERT * off if off > 0 else -DELETE * off) > limit:
            continue
        cost, table = _table(rows, free, target, limit - forced, leave == END)
        if cost <= min(best, limit):
            found = _backtraced(rows, target, table)
            if cost < best or found < audit:
                best, audit = cost, found
    return best, audit


def _table(rows: list[tuple[str, int]], free: list[int], target: str, budget: int, trailing: bool) -> tuple[int, list[dict[int, int]]]:
    """Costs of aligning the rows from i on with the target from j on, in the cells that a way within ``budget`` can pass.

    A way through a cell inserts or deletes at least what it is off the diagonal before and after it.
    """
    n, m = len(rows), len(target)
    off = m - free[-1]
    above = (budget + DELETE * off) // (INSERT + DELETE)
    below = -((budget - INSERT * off) // (INSERT + DELETE))
    last = {j: INSERT * (m - j) for j in range(max(0, free[n] + below), min(m, free[n] + above) + 1) if j == m or (trailing and target[j] != "s")}
    table = [last]
    for i in range(n - 1, -1, -1):
        kind, weight = rows[i]
        under, here = table[-1], {}
        stay = TRUNCATED if kind.isupper() else 0
        init = kind.lower()
        for j in range(min(m, free[i] + above), max(0, free[i] + below) - 1, -1):
            cost = under.get(j, _NEVER) + DELETE * weight
            if j < m:
                want = target[j]
                if kind != "x":
                    if init == want:
                        cost = min(cost, under.get(j + 1, _NEVER) + stay)
                    elif want != "s":
                        cost = min(cost, under.get(j + 1, _NEVER) + REROLE + stay)
                if want != "s":
                    cost = min(cost, here.get(j + 1, _NEVER) + INSERT)
            here[j] = cost
        table.append(here)
    table.reverse()
    return table[0].get(0, _NEVER), table


def _backtraced(rows: list[tuple[str, int]], target: str, table: list[dict[int, int]]) -> str:
    """The first audit in ASCII among the cheapest."""
    i, j, out = 0, 0, []
    while i < len(rows) or j < len(target):
        cost = table[i][j]
        want = target[j] if j < len(target) else ""
        if i < len(rows):
            kind, weight = rows[i]
            stay = TRUNCATED if kind.isupper() else 0
            if cost == table[i + 1].get(j, _NEVER) + DELETE * weight:
                out.append("D" * weight)
                i += 1
                continue
        if want and want != "s" and cost == table[i].get(j + 1, _NEVER) + INSERT:
            out.append("I")
            j += 1
            continue
        keep = kind.lower() == want
        out.append("K" if keep else "R")
        i, j = i + 1, j + 1
    return "".join(out)


def _ops(kinds: str, copies: tuple[int, ...], entry: int, audit: str) -> list[str]:
    """The audit by items; see :func:`settled`."""
    out, at, place = [], 0, entry

    def inserted() -> str:
        nonlocal at, place
        said = ""
        while at < len(audit) and audit[at] == "I":
            place = AFTER_A if place == AFTER_U else AFTER_U
            said, at = said + "sua"[place - 1], at + 1
        return said

    for kind, n in zip(kinds, copies):
        said = inserted()
        letter = audit[at]
        at += n
        if letter == "K" and kind in "sS":
            place = AFTER_S
        elif letter in "KR":
            place = AFTER_A if place == AFTER_U else AFTER_U
        out.append(said + letter + ("sua"[place - 1] if letter == "R" else ""))
    out[-1] += inserted()
    return out


def _settle(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        made = []
        for kinds, inits, copies, entry, leave in zip(*(batch.column(c).to_pylist() for c in ("kinds", "inits", "copies", "entry", "leave"))):
            cost, audit = best_edits(kinds, tuple(copies), entry, leave)
            illegal = sum(n - 1 for n in copies) + sum(a + b not in ("su", "ua", "au") for a, b in zip(inits, inits[1:]))
            made.append((cost, audit, illegal, inits[0], inits[-1], _ops(kinds, tuple(copies), entry, audit)))
        columns = list(zip(*made)) or [()] * 6
        types = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.list_(pa.string())]
        yield pa.RecordBatch.from_arrays(
            [batch.column(c) for c in ("conv_id", "block", "items")] + [pa.array(c, t) for c, t in zip(columns, types)],
            names=["conv_id", "block", "items", "cost", "audit", "illegal", "first", "last", "ops"],
        )


def _ways(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Cost of each way through a block, and its order among those from the same place by audit."""
    for batch in batches:
        costs, ranks = [], []
        for kinds, copies in zip(batch.column("kinds").to_pylist(), batch.column("copies").to_pylist()):
            cost, rank = [], []
            for entry in range(4):
                found = [best_edits(kinds, tuple(copies), entry, leave) for leave in range(5)]
                order = sorted(range(5), key=lambda q: found[q][1])
                cost += [c for c, _ in found]
                rank += [order.index(q) for q in range(5)]
            costs.append(cost)
            ranks.append(rank)
        yield pa.RecordBatch.from_arrays(
            [batch.column("conv_id"), batch.column("node"), pa.array(costs, pa.list_(pa.int64())), pa.array(ranks, pa.list_(pa.int32()))], names=["conv_id", "node", "costs", "ranks"]
        )


def _combined(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        made = [_one_node(below) for below in batch.column("below").to_pylist()]
        columns = list(zip(*made)) or [()] * 4
        types = [pa.list_(pa.int64()), pa.list_(pa.int32()), pa.list_(pa.int64()), pa.list_(pa.binary())]
        arrays = [batch.column("conv_id"), batch.column("node")] + [pa.array(c, t) for c, t in zip(columns, types)]
        yield pa.RecordBatch.from_arrays(arrays, names=["conv_id", "node", "costs", "ranks", "children", "paths"])


def _one_node(below: list[dict]) -> tuple[list[int], list[int], list[int], list[bytes]]:
    """Neighbouring nodes as one: the cheapest way from place to place, first by audit among equals."""
    k = len(below)
    costs = np.array([b["costs"] for b in below]).reshape(k, 4, 5)
    ranks = np.array([b["ranks"] for b in below]).reshape(k, 4, 5)
    to_go = np.full((k, 4, 5), _NEVER, np.int64)  # from before each child and a place to each end
    to_go[-1] = costs[-1]
    for i in range(k - 2, -1, -1):
        to_go[i] = np.minimum((costs[i, :, :4, None] + to_go[i + 1][None]).min(axis=1), _NEVER)
    paths, orders = [], []
    for entry in range(4):
        mine = []
        for leave in range(5):
            place, path, order = entry, [], []
            for i in range(k):
                if to_go[i, place, leave] >= _NEVER:
                    break
                ends = [leave] if i == k - 1 else [q for q in range(4) if costs[i, place, q] + to_go[i + 1, q, leave] == to_go[i, place, leave]]
                q = min(ends, key=lambda q: ranks[i, place, q])
                order.append(int(ranks[i, place, q]))
                path.append(q)
                place = q
            paths.append(bytes(path))
            mine.append(order)
        by_audit = sorted(range(5), key=mine.__getitem__)
        orders += [by_audit.index(q) for q in range(5)]
    return to_go[0].ravel().tolist(), orders, [b["node"] for b in below], paths


def _edited(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by conversation and turn, before each different turn its edits: the turns that result."""
    after, op, conv = "", "D", None
    for batch in batches:
        out = []
        for conv_id, role, text, edit in zip(*(c.to_pylist() for c in batch.columns)):
            if edit is not None:
                out += [(conv, ROLES[c], "") for c in after]
                at = next(i for i, c in enumerate(edit) if c in "KDR")
                conv, op = conv_id, edit[at]
                out += [(conv, ROLES[c], "") for c in edit[:at]]
                new, after = (edit[at + 1], edit[at + 2 :]) if op == "R" else (None, edit[at + 1 :])
            elif op != "D":
                out.append((conv_id, ROLES[new] if new else role, text))
                op = "D"
        yield _lines(out)
    yield _lines([(conv, ROLES[c], "") for c in after])


def _lines(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows)) or [(), (), ()]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.string(), pa.string()))], names=["conv_id", "role", "text"])


def _hashed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    begun, conv, digest = False, None, None
    for batch in batches:
        done = []
        for conv_id, role, text in zip(*(c.to_pylist() for c in batch.columns)):
            if not begun or conv_id != conv:
                if begun:
                    done.append((conv, digest.hexdigest()))
                begun, conv, digest = True, conv_id, hashlib.sha256()
            else:
                digest.update(b"\n")
            digest.update(f"{role}:{text}".encode())
        yield _digest_rows(done)
    if begun:
        yield _digest_rows([(conv, digest.hexdigest())])


def _digest_rows(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.string())], names=["conv_id", "repaired_sha256"])
