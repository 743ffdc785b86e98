"""Document fingerprints by locally consistent parsing.

A text is a row of symbols, one per code point. A level collapses runs of equal symbols, then
shortens the labels by deterministic coin tossing against the left neighbour (four rounds leave
labels below six with neighbours distinct), cuts phrases at local maxima of the labels and names
each phrase by the hash of its symbols. The phrase names are the next level's symbols. Where a
phrase is cut depends on a few neighbours only, so equal substrings get equal names inside,
wherever they stand.

The fingerprint keeps, for each of ``SLOTS`` parts of the hash range, 16 bits of the least name of
all levels, of symbols and of what any run repeats, too. Names of symbols and of the first level are
common to most texts, so their ranks are raised by ``RAISED`` powers of two: they fill slots where
a text has few higher names and hardly count where it has many, by one rule for every length. The
share j of equal slots among those that either text fills estimates the (weighted) Jaccard index of
the names; likeness is 2 j / (1 + j), so a text and one that keeps half of it come near one half.

Null counts as empty; the empty text fills no slot, and two empty texts are alike (1).
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from filequarry.llm.common import mix64, shuffle_partitions, slices, small_batches, written

SLOTS, ROUNDS = 64, 4
#: By how many bits the ranks of names are raised: of symbols, of the first level, of all above.
RAISED = (6, 3, 0)
_ONE = np.uint64(1)


def phrase_names(texts: list[str]) -> list[tuple[int, np.ndarray, np.ndarray]]:
    """(level, owner, name), symbols first: the index of the text and the 64-bit name of each phrase.

    A level has at most half the phrases of the one below, and one in the end, where a text stops.
    """
    lengths = np.fromiter(map(len, texts), np.int64, len(texts))
    points = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32)
    symbols, owner = mix64(points.astype(np.uint64) + _ONE), np.repeat(np.arange(len(texts)), lengths)
    out = [(0, owner, mix64(symbols))]
    level = 0
    while len(symbols):
        level += 1
        first = np.diff(owner, prepend=-1) != 0
        new = first.copy()
        new[1:] |= symbols[1:] != symbols[:-1]
        at = np.flatnonzero(new)
        run = np.diff(at, append=len(symbols))
        symbols, owner, first = symbols[at], owner[at], first[at]
        again = run > 1
        if again.any():
            out.append((level, owner[again], symbols[again]))  # what repeats, however often
        symbols[again] = mix64(symbols[again] ^ mix64(run[again].astype(np.uint64)))

        label = symbols
        for _ in range(ROUNDS):
            left = np.empty_like(label)
            left[1:] = label[:-1]
            left[first] = ~label[first]  # no left neighbour: differ at the lowest bit
            low = (label ^ left)
            low = np.bitwise_count((low & (~low + _ONE)) - _ONE).astype(np.uint64)
            label = (low << _ONE) | ((label >> low) & _ONE)
        small = label.astype(np.int16)
        before, after = np.empty_like(small), np.empty_like(small)
        before[1:], after[:-1] = small[:-1], small[1:]
        before[first] = 999
        after[np.append(np.flatnonzero(first)[1:] - 1, len(small) - 1)] = 999
        cut = np.flatnonzero(first | ((small > before) & (small > after)))
        size = np.diff(cut, append=len(symbols))
        place = np.arange(len(symbols)) - np.repeat(cut, size)
        spread = mix64(symbols ^ (place.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)))
        symbols = mix64(np.add.reduceat(spread, cut) ^ np.uint64(level))
        owner = owner[cut]

        out.append((level, owner, symbols))
        done = np.bincount(owner, minlength=len(texts))[owner] == 1
        symbols, owner = symbols[~done], owner[~done]
    return out


def fingerprints(texts: list[str]) -> np.ndarray:
    """One row of SLOTS 16-bit values for each text, 0 where a slot has no name."""
    out = np.zeros((len(texts), SLOTS), np.uint16)
    for start in range(0, len(texts), 1 << 15):
        keys = []
        for level, owner, name in phrase_names(texts[start : start + (1 << 15)]):
            name = mix64(name)
            # six bits of slot, 36 of rank, raised
            rank = ((name >> np.uint64(22)) & np.uint64((1 << 36) - 1)) << np.uint64(RAISED[min(level, len(RAISED) - 1)])
            keys.append(owner.astype(np.uint64) << np.uint64(48) | (name >> np.uint64(58)) << np.uint64(42) | rank)
        key = np.sort(np.concatenate(keys))
        if len(key):
            slot = key >> np.uint64(42)  # owner and slot
            at = np.flatnonzero(np.diff(slot, prepend=~slot[:1]) != 0)
            least = (mix64(key[at] & np.uint64((1 << 48) - 1)) & np.uint64(0xFFFF)).astype(np.uint16)
            out.reshape(-1)[start * SLOTS + slot[at].astype(np.int64)] = np.maximum(least, 1)
    return out


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    filled = ((a != 0) | (b != 0)).sum(axis=1)
    share = ((a == b) & (a != 0)).sum(axis=1) / np.maximum(filled, 1)
    return np.where(filled == 0, 1.0, 2 * share / (1 + share))


def hexed(rows: np.ndarray) -> list[str]:
    return [r.tobytes().hex() for r in rows.astype(">u2")]


def unhexed(rows: list[str]) -> np.ndarray:
    return np.frombuffer(bytes.fromhex("".join(rows)), ">u2").astype(np.uint16).reshape(len(rows), SLOTS)


def fingerprint(docs: DataFrame, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """id_column, fingerprint (hex): one row for each row of ``docs``."""
    small_batches(docs.sparkSession)

    def run(batches):
        for part in slices(batches, "text"):
            got = fingerprints([t or "" for t in part.column("text").to_pylist()])
            yield pa.record_batch({id_column: part.column(id_column), "fingerprint": pa.array(hexed(got))})

    rows = docs.select(F.col(id_column), F.col(text).alias("text"))
    return rows.mapInArrow(run, f"{id_column} {rows.schema[id_column].dataType.simpleString()}, fingerprint string")


EDITED = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _compared(ids, texts, nexts, own, after) -> dict:
    """The columns of EDITED, given each text's and its next text's fingerprints."""
    edited = [t[: len(t) - len(t) // 2] + n[: len(t) // 2] for t, n in zip(texts, nexts)]
    changed = fingerprints(edited)
    return {
        "doc_id": pa.array(ids, pa.int64()),
        "n_chars": pa.array([len(t) for t in texts], pa.int64()),
        "edited_sha256": pa.array([hashlib.sha256(e.encode()).hexdigest() for e in edited], pa.string()),
        "fingerprint": pa.array(hexed(own), pa.string()),
        "edited_fingerprint": pa.array(hexed(changed), pa.string()),
        "near_edited": pa.array(likeness(own, changed), pa.float64()),
        "near_next": pa.array(likeness(own, after), pa.float64()),
    }


def compare_with_next(docs: DataFrame, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """EDITED for each row: likeness to the next document (by id, the last's is the first) and to
    the text whose second half is replaced by the next document's beginning.

    Rows are dealt by ranges of id, so a document's next is the row after it; where a range ends,
    the row waits for the first of the next range, one pair for each partition.
    """
    spark = docs.sparkSession
    small_batches(spark)

    def run(batches):
        part_id, wait = TaskContext.get().partitionId(), None

        def block(cols, kind, texts):
            n = len(texts)
            return pa.record_batch({**cols, "part": pa.array([part_id] * n, pa.int32()), "kind": pa.array([kind] * n, pa.int32()), "text": pa.array(texts, pa.string())})

        def held(row, kind):
            i, t, f = row
            cols = {"doc_id": [i], "n_chars": [len(t)], "edited_sha256": [""], "fingerprint": hexed(f[None]), "edited_fingerprint": [""], "near_edited": [0.0], "near_next": [0.0]}
            types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
            return block({k: pa.array(v, x) for (k, v), x in zip(cols.items(), types)}, kind, [t])

        for part in slices(batches, "text"):
            ids, texts = part.column("doc_id").to_pylist(), [t or "" for t in part.column("text").to_pylist()]
            own = fingerprints(texts)
            if wait is None:
                yield held((ids[0], texts[0], own[0]), 1)
            else:
                ids, texts, own = [wait[0], *ids], [wait[1], *texts], np.concatenate([wait[2][None], own])
            wait = ids[-1], texts[-1], own[-1]
            if len(ids) > 1:
                yield block(_compared(ids[:-1], texts[:-1], texts[1:], own[:-1], own[1:]), 0, [None] * (len(ids) - 1))
        if wait is not None:
            yield held(wait, 2)

    rows = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text).alias("text"))
    dealt = rows.repartitionByRange(shuffle_partitions(spark), "doc_id").sortWithinPartitions("doc_id", "text")
    done = written(dealt.mapInArrow(run, f"{EDITED}, part int, kind int, text string"), "compared")

    heads, lasts = done.filter("kind = 1"), done.filter("kind = 2")
    parts = sorted(r.part for r in heads.select("part").collect())  # numbers of partitions
    follow = spark.createDataFrame(list(zip(parts, parts[1:] + parts[:1])), "part int, follow int")
    ends = lasts.select("part", "doc_id", "text", "fingerprint").join(F.broadcast(follow), "part").join(heads.select(F.col("part").alias("follow"), F.col("text").alias("next"), F.col("fingerprint").alias("after")), "follow")

    def finish(batches):
        for part in slices(batches, "text"):
            c = {k: part.column(k).to_pylist() for k in ("doc_id", "text", "next", "fingerprint", "after")}
            yield pa.record_batch(_compared(c["doc_id"], c["text"], c["next"], unhexed(c["fingerprint"]), unhexed(c["after"])))

    ends = ends.select("doc_id", "text", "next", "fingerprint", "after").mapInArrow(finish, EDITED)
    return done.filter("kind = 0").drop("part", "kind", "text").unionByName(ends)
