"""Benchmark decontamination by greedy string tiling.

Tokens are lower-cased runs of ASCII letters and digits and of other bytes beyond ASCII. Runs of
``seed`` tokens that a document shares with a test item join the two. For each such pair the
longest common stretches that don't overlap earlier ones are marked as tiles, over and over, by
running Karp-Rabin with falling search lengths, until none of ``seed`` tokens is left. Tiles may
come in any order, so passages that were moved about are covered too. A document is contaminated
if the tiles cover ``threshold`` of some item's tokens.

Every tile consists of shared seeds, so only those parts of a document are tiled. Items go to all
tasks in blocks of at most ``BLOCK_BYTES`` of text; more items take more passes over the
documents, none is left out.

Items with fewer tokens than a seed are matched whole. Null, empty or blank texts and items match
nothing. Rows of ``docs`` that repeat each get a row; among equal coverages the smallest item id
is named, an item without id last. An empty benchmark or table gives coverage 0 or no rows.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from filequarry.llm.common import PUNCTUATION, hash_words, mix64, slices, small_batches
from filequarry.operators.scratch import saved

SEED, THRESHOLD = 5, 0.6
BLOCK_BYTES = 32 << 20
OUT = "n_words long, n_items long, item_id long, coverage double, n_tiles long"


def runs(words: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all runs of n words."""
    out = np.full(max(0, len(words) - n + 1), n, np.uint64)
    for i in range(n):
        out = mix64(out ^ words[i : len(words) - n + 1 + i])
    return out


def tiles(item: np.ndarray, text: np.ndarray, least: int) -> list[tuple[int, int, int]]:
    """(item start, text start, length) of greedy tiles of at least ``least`` equal tokens, the longest
    first, then the first in item and text."""
    used_i, used_t = np.zeros(len(item), bool), np.zeros(len(text), bool)
    out, length = [], max(least, min(20, len(item)))
    while True:
        found = _matches(item, text, used_i, used_t, length)
        longest = -found[0][0] if found else 0
        if longest > 2 * length:
            length = longest  # a very long match: search again at its length
            continue
        while found:
            n, i, k = heapq.heappop(found)
            n = -n
            taken = used_i[i : i + n] | used_t[k : k + n]
            if not taken.any():
                used_i[i : i + n] = used_t[k : k + n] = True
                out.append((i, k, n))
                if not len(_free(used_i, length)):
                    break
                continue
            # what earlier tiles leave of the match
            edge = np.flatnonzero(np.diff(taken, prepend=True, append=True))
            for a, b in zip(edge[::2].tolist(), edge[1::2].tolist()):
                if b - a >= length:
                    heapq.heappush(found, (a - b, i + a, k + a))
        if length == least:
            return out
        length = length // 2 if length > 2 * least else length - 1


def _matches(item: np.ndarray, text: np.ndarray, used_i: np.ndarray, used_t: np.ndarray, length: int) -> list[tuple[int, int, int]]:
    """A heap of (-length, item start, text start) of the matches of free tokens that can't be extended,
    found by Karp-Rabin fingerprints of all free windows."""
    i_at, t_at = _free(used_i, length), _free(used_t, length)
    if not len(i_at) or not len(t_at):
        return []
    t_hash = _rolled(text, length)[t_at]
    order = np.argsort(t_hash, kind="stable")
    t_hash, t_at = t_hash[order], t_at[order]
    i_hash = _rolled(item, length)[i_at]
    lo, hi = np.searchsorted(t_hash, i_hash), np.searchsorted(t_hash, i_hash, "right")
    found = []
    for i, a, b in zip(i_at.tolist(), lo.tolist(), hi.tolist()):
        k = t_at[a:b]
        if not len(k):
            continue
        if i and not used_i[i - 1]:
            # only where a match begins: not where the tokens before are free and equal, too
            before = k - 1
            k = k[(before < 0) | used_t[before] | (text[before] != item[i - 1])]
        n, live = np.zeros(len(k), np.int64), np.arange(len(k))
        for step in range(len(item) - i):
            at = k[live] + step
            inside = at < len(text)
            at = np.minimum(at, len(text) - 1)
            live = live[inside & (text[at] == item[i + step]) & ~used_t[at]] if not used_i[i + step] else live[:0]
            if not len(live):
                break
            n[live] += 1
        found.extend((-x, i, y) for x, y in zip(n.tolist(), k.tolist()) if x >= length)
    heapq.heapify(found)
    return found


_KR = 0x9E3779B97F4A7C13 | 3


def _rolled(tokens: np.ndarray, n: int) -> np.ndarray:
    """Karp-Rabin fingerprints, modulo 2**64, of all windows of n tokens."""
    out = np.zeros(len(tokens) - n + 1, np.uint64)
    for k in range(n):
        out = out * np.uint64(_KR) + tokens[k : len(tokens) - n + 1 + k]
    return out


def _free(used: np.ndarray, length: int) -> np.ndarray:
    """Starts of all windows of ``length`` without a used token."""
    if len(used) < length:
        return np.empty(0, np.int64)
    total = np.concatenate([[0], np.cumsum(used)])
    return np.flatnonzero(total[length:] == total[:-length])


class Items:
    """A block of test items: their tokens and an index from seeds to items."""

    def __init__(self, rows: list[tuple[int, str]], seed: int):
        self.ids = [i for i, _ in rows]
        words, bounds = hash_words([t for _, t in rows], space=PUNCTUATION)
        self.tokens = [words[a:b] for a, b in zip(bounds[:-1], bounds[1:])]
        self.lengths = sorted({min(seed, len(t)) for t in self.tokens if len(t)}, reverse=True)
        key, owner = [], []
        for k, t in enumerate(self.tokens):
            if len(t):
                own = runs(t, min(seed, len(t)))
                key.append(own)
                owner.append(np.full(len(own), k))
        self.key = np.concatenate(key) if key else np.empty(0, np.uint64)
        order = np.argsort(self.key, kind="stable")
        self.key, self.owner = self.key[order], (np.concatenate(owner) if owner else np.empty(0, np.int64))[order]
        self.sieve = np.zeros(1 << 22, bool)
        self.sieve[self.key >> np.uint64(42)] = True

    def hits(self, words: np.ndarray, n: int) -> np.ndarray:
        """Where in ``words`` a run of n is a seed of some item."""
        got = runs(words, n)
        at = np.flatnonzero(self.sieve[got >> np.uint64(42)])
        place = np.searchsorted(self.key, got[at])
        return at[(place < len(self.key)) & (self.key[np.minimum(place, len(self.key) - 1)] == got[at])] if len(self.key) else at[:0]


def cover(words: np.ndarray, hits: dict[int, np.ndarray], items: Items, seed: int) -> list[tuple[float, int, int]]:
    """(coverage, item id, tiles) for each item that shares a seed with the text."""
    own: dict[int, dict[int, list[int]]] = {}
    for n, at in hits.items():
        if len(at):
            got = runs_at(words, at, n)
            lo, hi = np.searchsorted(items.key, got), np.searchsorted(items.key, got, "right")
            for k, a, b in zip(at.tolist(), lo.tolist(), hi.tolist()):
                for o in set(items.owner[a:b].tolist()):
                    own.setdefault(o, {}).setdefault(n, []).append(k)
    out = []
    for o, by in own.items():
        item = items.tokens[o]
        n = min(seed, len(item))
        if n not in by:
            continue
        at = np.array(by[n])
        inside = np.zeros(len(words) + 1, np.int64)
        np.add.at(inside, at, 1)
        np.add.at(inside, at + n, -1)
        seeded = np.flatnonzero(np.cumsum(inside))
        # stretches of seeds one after the other; no tile passes the gap between two
        gap = np.flatnonzero(np.diff(seeded) > 1) + 1
        found = tiles(item, np.insert(words[seeded], gap, absent(item)), n)
        out.append((sum(x for *_, x in found) / len(item), items.ids[o], len(found)))
    return out


def absent(item: np.ndarray) -> np.uint64:
    """A token that is not in ``item``."""
    token = np.uint64(1)
    while (item == token).any():
        token += np.uint64(1)
    return token


def runs_at(words: np.ndarray, at: np.ndarray, n: int) -> np.ndarray:
    out = np.full(len(at), n, np.uint64)
    for i in range(n):
        out = mix64(out ^ words[at + i])
    return out


def contamination(docs: DataFrame, benchmark: DataFrame, seed: int = SEED, threshold: float = THRESHOLD, id_column: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """id_column, n_words, n_items (that share a tile), item_id and coverage (the best), n_tiles, contaminated."""
    spark = docs.sparkSession
    small_batches(spark)
    items = benchmark.select(F.col(item_id).cast("long").alias("item_id"), F.coalesce(F.col(item_text), F.lit("")).alias("text"))
    size = items.agg(F.sum(F.octet_length("text") + 100)).first()[0] or 0
    blocks = size // BLOCK_BYTES + 1
    rows = docs.select(F.col(id_column).alias("id"), F.col(text).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    if blocks > 1:
        # written once with a key of each row, so that all passes agree on it
        rows = saved(rows.mapInArrow(_keyed, f"key long, id {kind}, text string"), "docs")
    parts = []
    for b in range(blocks):
        block = items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == b).orderBy("item_id", "text")
        shared = spark.sparkContext.broadcast(Items([tuple(r) for r in block.collect()], seed))
        part = rows.mapInArrow(_tiler(shared, seed), f"key long, id {kind}, {OUT}")
        if blocks > 1:
            part = saved(part, "block")
            shared.unpersist()
        parts.append(part)
    if blocks == 1:
        out = parts[0]
    else:
        best = F.max(F.struct("coverage", (-F.col("item_id")).alias("item"), "n_tiles"))
        every = parts[0]
        for p in parts[1:]:
            every = every.unionByName(p)
        out = every.groupBy("key").agg(F.first("id").alias("id"), F.first("n_words").alias("n_words"), F.sum("n_items").alias("n_items"), best.alias("best"))
        out = out.select("id", "n_words", "n_items", (-F.col("best.item")).alias("item_id"), F.col("best.coverage").alias("coverage"), F.col("best.n_tiles").alias("n_tiles"))
    return out.select(F.col("id").alias(id_column), "n_words", "n_items", "item_id", "coverage", "n_tiles", (F.col("coverage") >= threshold).alias("contaminated"))


def _keyed(batches):
    first = TaskContext.get().partitionId() << 33
    for batch in batches:
        key = pa.array(np.arange(first, first + batch.num_rows), pa.int64())
        yield pa.record_batch({"key": key, "id": batch.column("id"), "text": batch.column("text")})
        first += batch.num_rows


def _tiler(shared, seed: int):
    def run(batches):
        items = shared.value
        for part in slices(batches, "text"):
            words, bounds = hash_words(part.column("text").to_pylist(), space=PUNCTUATION)
            marks = {n: items.hits(words, n) for n in items.lengths}
            got = []
            for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
                own = {n: at[slice(*np.searchsorted(at, [a, b - n + 1]))] - a for n, at in marks.items()}
                found = cover(words[a:b], own, items, seed) if any(map(len, own.values())) else []
                best = min(found, key=lambda f: (-f[0], f[1] is None, f[1] or 0)) if found else (0.0, None, 0)
                got.append((b - a, len(found), best[1], best[0], best[2]))
            n, shares, item, share, count = zip(*got)
            key = part.column("key") if "key" in part.schema.names else pa.nulls(len(n), pa.int64())
            yield pa.record_batch({"key": key, "id": part.column("id"), "n_words": pa.array(n, pa.int64()), "n_items": pa.array(shares, pa.int64()), "item_id": pa.array(item, pa.int64()), "coverage": pa.array(share, pa.float64()), "n_tiles": pa.array(count, pa.int64())})

    return run
