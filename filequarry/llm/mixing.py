"""Mixing sources to target weights by Sainte-Lague apportionment of equal-token blocks.

Each source's target is its weight's share of all words, at most ``most`` times its own size;
what is above is shared again by weight. Blocks of ``block`` words (a fixed number, whatever the
table's size) are apportioned to the sources by the highest quotients target / (2 n + 1), then each
source's blocks to its shards the same way, so every shard has an integer quota it can fill alone.
A shard is a seeded part of a source's documents; they follow one another in seeded order, and the
shard is cut into blocks from there. A quota above a shard's size takes the whole shard, as often as
it fits, and the blocks of the rest are those that a seeded permutation of the block numbers puts
first. So a document is taken in parts of its blocks, and never more than ``most`` times.

A source's words come within a block or two, for each of its shards, of its target.

Null text or no words: size 0, taken 0. Null source is a source of its own, the last. Rows with
equal ids stay apart (ordered by size; equal ones are interchangeable). An empty table gives no rows.
One row for each source comes to the driver, to apportion among them: as many as a mix has weights.
"""

from __future__ import annotations

import heapq

import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from filequarry.llm.common import written

#: Words of a shard, about, and of a block.
SHARD_WORDS, BLOCK_WORDS = 2_000_000, 16
#: Up to so many sources or shards are broadcast; more go through a shuffled join.
BROADCAST_ROWS = 100_000
#: Multipliers of the permutations of block numbers: primes above any shard's number of blocks.
PRIMES = (2147483647, 1000000007, 998244353, 1000000009)


def word_count(text) -> F.Column:
    """Runs of characters other than ASCII white space; null counts 0."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def targets(sizes: list[int], weights: list[float], most: float) -> list[float]:
    """Shares of sum(sizes) by weight, none above ``most`` times its size."""
    out, active, left = [0.0] * len(sizes), set(range(len(sizes))), float(sum(sizes))
    while active:
        rate = left / sum(weights[i] for i in sorted(active))
        full = [i for i in sorted(active) if weights[i] * rate > most * sizes[i]]
        if not full:
            for i in active:
                out[i] = weights[i] * rate
            break
        for i in full:
            out[i] = float(most * sizes[i])
            left -= out[i]
            active.remove(i)
    return out


def sainte_lague(votes: list[float], seats: int, caps: list[int]) -> list[int]:
    """Seats by highest quotients v / (2 n + 1), the first on ties, none above its cap.

    Starts at the rounded shares, from which only a few seats have to move.
    """
    total = sum(votes)
    if total <= 0 or seats <= 0:
        return [0] * len(votes)
    got = [min(c, int(v * seats / total + 0.5)) for v, c in zip(votes, caps)]
    spare = seats - sum(got)
    if spare > 0:
        heap = [(-votes[i] / (2 * got[i] + 1), i) for i in range(len(votes)) if got[i] < caps[i] and votes[i] > 0]
        heapq.heapify(heap)
        while spare and heap:
            _, i = heapq.heappop(heap)
            got[i] += 1
            spare -= 1
            if got[i] < caps[i]:
                heapq.heappush(heap, (-votes[i] / (2 * got[i] + 1), i))
    elif spare < 0:
        heap = [(votes[i] / (2 * got[i] - 1), -i) for i in range(len(votes)) if got[i]]
        heapq.heapify(heap)
        while spare:
            _, i = heapq.heappop(heap)
            got[-i] -= 1
            spare += 1
            if got[-i]:
                heapq.heappush(heap, (votes[-i] / (2 * got[-i] - 1), i))
    return got


def mix(docs: DataFrame, weights=(1, 2, 3), most: int = 3, seed: int = 17, block: int = BLOCK_WORDS, id_column: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """id_column, source, size, source_size, target, taken, copies: one row for each row of ``docs``.

    ``weights`` repeat over the sources in code point order, null last. ``taken`` counts words,
    ``copies`` whole documents: the times round, and one more if the block of its middle word is in the rest.
    """
    spark = docs.sparkSession
    sized = docs.select(F.col(id_column).alias("id"), F.col(source).alias("source"), word_count(F.col(text)).alias("size"))
    sized = written(sized, "sizes")
    rows = sized.groupBy("source").agg(F.sum("size").alias("source_size")).collect()
    rows.sort(key=lambda r: (r.source is None, r.source or ""))
    sizes = [r.source_size for r in rows]
    goal = targets(sizes, [weights[i % len(weights)] for i in range(len(rows))], most)
    quota = sainte_lague(goal, (sum(sizes) + block // 2) // block, [-(-most * s // block) for s in sizes])
    plan = [(i, r.source, r.source_size, g, q, r.source_size // SHARD_WORDS + 1) for i, (r, g, q) in enumerate(zip(rows, goal, quota))]
    per_source = spark.createDataFrame(plan, "number long, source string, source_size long, target double, quota long, shards long")
    per_source = F.broadcast(per_source) if len(plan) <= BROADCAST_ROWS else per_source

    shard = F.pmod(F.xxhash64(F.lit(seed), F.lit("shard"), "id"), F.col("shards"))
    dealt = sized.withColumnRenamed("source", "own").join(per_source, F.col("own").eqNullSafe(F.col("source"))).drop("own").withColumn("shard", shard)

    def divide(cells: pd.DataFrame) -> pd.DataFrame:
        cells = cells.sort_values("shard", ignore_index=True)
        words = [int(x) for x in cells["words"]]
        cells["blocks"] = sainte_lague(words, int(cells["quota"].iloc[0]), [-(-most * w // block) for w in words])
        return cells[["number", "shard", "words", "blocks"]]

    cells = dealt.groupBy("number", "shard", "quota").agg(F.sum("size").alias("words"))
    cells = written(cells.groupBy("number").applyInPandas(divide, "number long, shard long, words long, blocks long"), "quotas")
    take = F.least(F.col("blocks") * block, most * F.col("words"))
    words = F.greatest("words", F.lit(1))
    cell = cells.select("number", "shard", F.floor(take / words).alias("turns"), F.round(take % words / block).cast("long").alias("rest"), F.ceil(words / block).alias("all"))
    cell = F.broadcast(cell) if cell.count() <= BROADCAST_ROWS else cell

    order = Window.partitionBy("number", "shard").orderBy(F.xxhash64(F.lit(seed), F.lit("order"), "id"), "id", "size")
    placed = dealt.withColumn("end", F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, 0))).join(cell, ["number", "shard"])
    multiplier = F.element_at(F.array(*map(F.lit, PRIMES)), (F.pmod(F.xxhash64(F.lit(seed), F.lit("prime"), "number", "shard"), F.lit(len(PRIMES))) + 1).cast("int"))
    shift = F.pmod(F.xxhash64(F.lit(seed), F.lit("shift"), "number", "shard"), F.lit(1 << 31))
    placed = placed.withColumns({"begin": F.col("end") - F.col("size"), "multiplier": multiplier, "shift": shift})

    def chosen(number):
        """Whether the permutation puts a block among the first ``rest``."""
        return F.pmod(number * F.col("multiplier") + F.col("shift"), F.col("all")) < F.col("rest")

    def chosen_words(total, number):
        inside = F.least("end", (number + 1) * block) - F.greatest("begin", number * block)
        return total + F.when(chosen(number), inside).otherwise(F.lit(0))

    numbers = F.sequence(F.floor(F.col("begin") / block), F.floor((F.col("end") - 1) / block))
    part = F.when((F.col("size") > 0) & (F.col("rest") > 0), F.aggregate(numbers, F.lit(0).cast("long"), chosen_words)).otherwise(F.lit(0))
    out = placed.withColumn("part", part)
    return out.select(
        F.col("id").alias(id_column), "source", "size", "source_size", "target",
        (F.col("turns") * F.col("size") + F.col("part")).cast("long").alias("taken"),
        (F.col("turns") + ((F.col("size") > 0) & chosen(F.floor((F.col("begin") + F.col("end")) / (2 * block)))).cast("long")).cast("int").alias("copies"),
    )
