"""Removal of bytes covered by a string of ``length`` bytes that also starts anywhere else.

Where to look. Each window of ``length`` bytes is owned by the least hash among its 32-byte grams
(its anchor, the leftmost on ties); neighbouring windows with one anchor form a stretch. Equal
windows have equal anchors, so a window repeats only if its anchor does. Two passes over the texts
find the anchors that occur twice and the stretches of those. The anchors go from the first to the
second as a bit table of bounded size; what it lets through wrongly falls out by the exact counts
(past some 2**29 anchors it lets more and more through: the second pass then writes more, no more).

Comparison, within a task for whole groups of one anchor: each different stretch once, with its
number of occurrences, in a suffix array by two-stage sorting. Suffixes smaller than their
successors are sorted directly, by ``length`` bytes; the others are induced by scanning the buckets
of first bytes in order; then adjacent common prefixes of ``length`` bytes mark the repeats.

An anchor with more than ``GROUP`` different stretches is divided first. Its windows are told apart
by where they have the anchor; all windows of one half of those places share the bytes around the
anchor, so the two halves of each stretch are grouped anew by those bytes, and so on until a group
is small or one window wide. Equal windows always stay in one group, halves that are alone fall
out, and equal halves count once: the work grows with the number of stretches, not of their pairs.

Null counts as empty. Texts shorter than ``length`` lose nothing. Equal rows are copies of each
other. Offsets are bytes of UTF-8. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from filequarry.llm.common import join_hot, mix64, shuffle_partitions, slices, small_batches, written

GRAM = 32
#: Bits for each anchor in a bit table, and the log2 of its most bits (64 MB).
SIEVE_BITS, SIEVE_MOST = 16, 29
GROUP = 2048
#: Stretches a task remembers, so as not to hand on their bytes again.
SEEN = 500_000
#: Up to so many anchors with many stretches are broadcast; more go through a shuffled join.
BROADCAST_ANCHORS = 100_000
#: Bytes of stretches sorted in one array; a group is never cut.
SORTED_BYTES = 4 << 20
_BYTE = np.random.default_rng(11).integers(1, 1 << 63, 256, np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C13 | 3
_HIGH = np.uint64(((1 << 64) - 1) ^ ((1 << 28) - 1))
_LOW = np.int64((1 << 28) - 1)


def stretches(texts: list[bytes], length: int) -> tuple[bytes, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The texts joined; for each stretch its text, first window start (in the joined bytes), number
    of windows, anchor start and anchor hash come as rows of arrays."""
    joined = b"".join(texts)
    data = np.frombuffer(joined, np.uint8)
    n = np.fromiter(map(len, texts), np.int64, len(texts))
    ends = np.cumsum(n)
    none = np.empty(0, np.int64)
    if not (n >= length).any():
        return joined, none, none, none, none
    h, step = _BYTE[data], 1
    while step < GRAM:
        h = h[:-step] * np.uint64(pow(_BASE, step, 1 << 64)) + h[step:]
        step *= 2
    h = mix64(h)
    key = (h & _HIGH) | np.arange(len(h), dtype=np.uint64)
    span, step = length - GRAM + 1, 1
    while step * 2 <= span:
        key = np.minimum(key[:-step], key[step:])
        step *= 2
    if step < span:
        key = np.minimum(key[: len(key) - (span - step)], key[span - step :])
    # windows inside one text
    valid = np.zeros(len(data) + 1, np.int64)
    long = n >= length
    np.add.at(valid, (ends - n)[long], 1)
    np.add.at(valid, (ends - length + 1)[long], -1)
    start = np.flatnonzero(np.cumsum(valid)[: len(key)])
    anchor = (key[start] & np.uint64(_LOW)).astype(np.int64)
    first = np.flatnonzero((np.diff(anchor, prepend=-1) != 0) | (np.diff(start, prepend=-9) != 1))
    lo, count = start[first], np.diff(first, append=len(start))
    # anchors are least hashes: hash again, or their high bits would hardly differ
    again = mix64(h[anchor[first]] ^ np.uint64(_BASE)).view(np.int64)
    return joined, np.searchsorted(ends, lo, "right"), lo, count, np.stack([anchor[first], again])


def suffix_order(data: np.ndarray, begin: np.ndarray, windows: np.ndarray, end: np.ndarray, length: int) -> np.ndarray:
    """Starts of all windows of the stretches in the order of their ``length`` bytes.

    data: the stretches' bytes with eight zeros after each; stretch k is data[begin[k]:end[k]].
    """
    byte = data.astype(np.int16) + 1
    byte[_inside(end, 8)] = 0
    size = len(byte)
    # type B: smaller than the successor; equal bytes take the type of the run's end
    rise = np.zeros(size, bool)
    change = np.flatnonzero(byte[1:] != byte[:-1])
    nxt = np.searchsorted(change, np.arange(size - 1))
    inner = nxt < len(change)
    at = change[np.minimum(nxt, len(change) - 1)]
    rise[:-1] = inner & (byte[np.minimum(at + 1, size - 1)] > byte[at])
    # suffixes needed: from each stretch's begin to the first B at or after its last window
    is_b = np.flatnonzero(rise)
    stop = np.minimum(np.append(is_b, size)[np.searchsorted(is_b, begin + windows - 1)], end)
    need = np.zeros(size + 1, np.int64)
    np.add.at(need, begin, 1)
    np.add.at(need, stop + 1, -1)
    need = np.cumsum(need)[:size] > 0
    limit = np.repeat(end, np.diff(np.append(begin, size)))

    word = np.zeros(size, np.uint64)
    for k in range(8):
        word[: size - k] |= data[k:].astype(np.uint64) << np.uint64(56 - 8 * k)
    b = np.flatnonzero(need & rise)
    b = _sorted_directly(word, b, np.minimum(limit[b] - b, length), length)

    is_a = need & ~rise
    ends = np.flatnonzero(need & (byte == 0))
    order, buckets = [], [[] for _ in range(258)]
    starts = np.searchsorted(byte[b], np.arange(258))

    def induce(js, c):
        prev = js - 1
        prev = prev[(prev >= 0) & is_a[prev]]
        prev = prev[byte[prev] > 0]
        heads = byte[prev]
        for v in np.unique(heads):
            if v != c:
                buckets[v].append(prev[heads == v])
        return prev[heads == c]

    induce(ends, 0)
    for c in range(1, 257):
        front = np.concatenate(buckets[c]) if buckets[c] else b[:0]
        while len(front):
            order.append(front)
            front = induce(front, c)
        own = b[starts[c] : starts[c + 1]]
        if len(own):
            order.append(own)
            induce(own, c)
    out = np.concatenate(order) if order else b
    last = np.repeat(begin + windows, np.diff(np.append(begin, size)))
    return out[out < last[out]], word


def _inside(end: np.ndarray, n: int) -> np.ndarray:
    return (end[:, None] + np.arange(n)).reshape(-1)


_MASK = np.array([0] + [((1 << 64) - 1) ^ ((1 << (64 - 8 * k)) - 1) for k in range(1, 9)], np.uint64)


def _sorted_directly(word: np.ndarray, at: np.ndarray, limit: np.ndarray, length: int) -> np.ndarray:
    """``at`` in the order of the bytes there, eight at a time while some tie; limit: bytes each has."""
    if not len(at):
        return at

    def part(rows, k):
        left = np.clip(limit[rows] - 8 * k, 0, 8)
        return word[np.minimum(at[rows] + 8 * k, len(word) - 1)] & _MASK[left]

    rows = np.arange(len(at))
    order = np.argsort(part(rows, 0), kind="stable")
    place, rows = np.arange(len(at)), rows[order]  # where the tied rows stand in the result
    out = rows.copy()
    key = part(rows, 0)
    group = np.cumsum(np.diff(key, prepend=~key[:1]) != 0)
    for k in range(1, -(-length // 8)):
        tied = np.zeros(len(rows), bool)
        same = group[1:] == group[:-1]
        tied[1:] |= same
        tied[:-1] |= same
        if not tied.any():
            break
        place, rows, group = place[tied], rows[tied], group[tied]
        key = part(rows, k)
        order = np.lexsort((key, group))
        rows, key = rows[order], key[order]
        out[place] = rows
        group = np.cumsum((np.diff(group, prepend=group[0] - 1) != 0) | (np.diff(key, prepend=~key[:1]) != 0))
    return at[out]


def repeated(parts: list[bytes], windows: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of all windows of the stretches: stretch, offset, and the number of its class of equal windows,
    classes in suffix order."""
    size = np.fromiter(map(len, parts), np.int64, len(parts))
    begin = np.cumsum(size + 8) - size - 8
    end = begin + size
    data = np.frombuffer((b"\0" * 8).join([*parts, b""]), np.uint8)
    order, word = suffix_order(data, begin, windows, end, length)
    a, b = order[:-1], order[1:]
    tie = np.arange(len(a))
    for k in range(length // 8):
        tie = tie[word[a[tie] + 8 * k] == word[b[tie] + 8 * k]]
    if length % 8:
        tail = length - 8
        tie = tie[word[a[tie] + tail] == word[b[tie] + tail]]
    new = np.ones(len(order), bool)
    new[tie + 1] = False
    owner = np.searchsorted(begin, order, "right") - 1
    return owner, order - begin[owner], np.cumsum(new) - 1


def _rows(docs: DataFrame, length: int, schema: str, make) -> DataFrame:
    """One row for each stretch, as the function that ``make`` gives for a task makes them of its text's id and check, start, windows, anchor and bytes."""

    def run(batches):
        emit = make()
        for part in slices(batches, "text", 512 << 10):
            texts = [(t or "").encode() for t in part.column("text").to_pylist()]
            joined, owner, lo, count, anchor = stretches(texts, length)
            if len(lo):
                out = emit(part, texts, joined, owner, lo, count, anchor)
                if out is not None and out.num_rows:
                    yield out

    return docs.mapInArrow(run, schema)


def _context(joined: bytes, lo: int, count: int, anchor: int, length: int) -> int:
    """A digest of a stretch's bytes and of the anchor's place in it, signed."""
    h = xxhash.xxh3_64_intdigest(joined[lo : lo + count + length - 1], anchor - lo)
    return h - (1 << 64) if h >> 63 else h


def _sieve(anchors: DataFrame) -> np.ndarray:
    """A bit table of the anchors, as bytes; false for none of them."""
    log2 = min(SIEVE_MOST, max(16, (SIEVE_BITS * anchors.count()).bit_length()))
    slot = F.shiftrightunsigned("anchor", 64 - log2)
    bits = F.expr("bit_or(shiftleft(1L, cast(slot & 63 as int)))")
    words = anchors.select(slot.alias("slot")).groupBy(F.shiftright("slot", 6).cast("int").alias("at")).agg(bits.alias("bits"))
    got = words.toArrow()
    table = np.zeros(1 << (log2 - 6), np.int64)
    table[got.column("at").to_numpy()] = got.column("bits").to_numpy()
    return table


def _in_sieve(table: np.ndarray, anchor: np.ndarray) -> np.ndarray:
    log2 = (len(table) * 64).bit_length() - 1
    slot = anchor.view(np.uint64) >> np.uint64(64 - log2)
    return (table[(slot >> np.uint64(6)).astype(np.int64)].view(np.uint64) >> (slot & np.uint64(63))) & np.uint64(1) != 0


def remove_repeats(docs: DataFrame, length: int = 200, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """id_column, n_bytes, n_removed, n_spans, kept (binary): one row for each row of ``docs``."""
    spark = docs.sparkSession
    small_batches(spark)
    rows = docs.select(F.col(id_column).alias("id"), F.xxhash64(text).bitwiseAND(0x7FFFFFFF).cast("int").alias("check"), F.col(text).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()

    def only_anchor(part, texts, joined, owner, lo, count, anchor):
        return pa.record_batch({"anchor": pa.array(anchor[1])})

    every = _rows(rows, length, "anchor long", lambda: only_anchor)
    again = written(every.groupBy("anchor").count().filter("count > 1").select("anchor"), "anchors")
    wanted = spark.sparkContext.broadcast(_sieve(again))

    def describer():
        seen = set()

        def described(part, texts, joined, owner, lo, count, anchor):
            at = np.flatnonzero(_in_sieve(wanted.value, anchor[1]))
            ctx, held = [], []
            if len(seen) > SEEN:
                seen.clear()
            for s, c, a, h in zip(lo[at].tolist(), count[at].tolist(), anchor[0][at].tolist(), anchor[1][at].tolist()):
                digest = _context(joined, s, c, a, length)
                ctx.append(digest)
                if (h, digest) in seen:
                    held.append(None)
                else:
                    seen.add((h, digest))
                    held.append(joined[s : s + c + length - 1])
            base = np.cumsum([0, *map(len, texts)])
            own = pa.array(owner[at])
            return pa.record_batch({
                "id": part.column("id").take(own), "check": part.column("check").take(own), "start": pa.array((lo - base[owner])[at].astype(np.int32)),
                "windows": pa.array(count[at].astype(np.int32)), "anchor": pa.array(anchor[1][at]), "ctx": pa.array(ctx, pa.int64()),
                "place": pa.array((anchor[0] - lo)[at].astype(np.int32)), "bytes": pa.array(held, pa.binary()),
            })

        return described

    found = _rows(rows, length, f"id {kind}, check int, start int, windows int, anchor long, ctx long, place int, bytes binary", describer)
    found = written(found, "stretches")
    counts = written(found.groupBy("anchor", "ctx").agg(F.count("*").alias("n")), "groups")
    held = found.filter("bytes IS NOT NULL").select("anchor", "ctx", F.lit(0).cast("long").alias("n"), "place", "bytes")
    # one row for each different stretch with its count, and its bytes from each task that met it
    held = held.unionByName(counts.select("anchor", "ctx", "n"), allowMissingColumns=True)
    crowded = written(counts.groupBy("anchor").count().filter(F.col("count") > GROUP).select("anchor"), "crowded")
    crowds = crowded.count()
    few = held
    if crowds:
        list_ = F.broadcast(crowded) if crowds <= BROADCAST_ANCHORS else crowded
        few = held.join(list_, "anchor", "left_anti")
    marks = _compared(few, length, ["anchor", "ctx"])
    if crowds:
        marks = marks.unionByName(_in_halves(held.join(list_, "anchor", "left_semi"), length))
    marks = written(marks, "marks")

    spans = join_hot(found.select("id", "check", "start", "anchor", "ctx"), marks, ["anchor", "ctx"], "n")
    spans = spans.select("id", "check", F.inline("runs"), "start")
    spans = spans.groupBy("id", "check").agg(F.collect_set(F.struct((F.col("start") + F.col("offset")).alias("start"), "windows")).alias("spans"))
    spans = spans.withColumnsRenamed({"id": "span_id", "check": "span_check"})
    joined = rows.join(spans, rows.id.eqNullSafe(F.col("span_id")) & rows.check.eqNullSafe(F.col("span_check")), "left")
    return _removed(joined.select("id", "text", "spans"), length, kind).withColumnRenamed("id", id_column)


RUNS = "runs array<struct<offset: int, windows: int>>"


def _compared(held: DataFrame, length: int, key: list[str]) -> DataFrame:
    """key, n, runs: the repeated windows of each different stretch.

    held: key (group and member, longs), n, bytes; a member's count and bytes come in rows of their
    own, the bytes perhaps several times. Groups are whole: dealt by the first key.
    """
    group_key, member_key = key
    run_type = pa.list_(pa.struct([("offset", pa.int32()), ("windows", pa.int32())]))

    def run(batches):
        held, size = [], 0  # (group, member, n, bytes) of whole groups
        members, last = {}, None

        def close():
            """The group that ended joins those held, if it can repeat."""
            if len(members) > 1 or any(n > 1 for n, _ in members.values()):
                held.extend((last, m, n, body) for m, (n, body) in members.items())
                return sum(len(body) for _, body in members.values())
            return 0

        def flush():
            if not held:
                return
            group, member, n, body = (list(x) for x in zip(*held))
            windows = np.fromiter(map(len, body), np.int64, len(body)) - length + 1
            owner, offset, cls = repeated(body, windows, length)
            times = np.bincount(cls, weights=np.array(n, float)[owner])
            hit = np.flatnonzero(times[cls] > 1)
            hit = hit[np.lexsort((offset[hit], owner[hit]))]
            o, f = owner[hit], offset[hit]
            cut = np.flatnonzero((np.diff(o, prepend=-1) != 0) | (np.diff(f, prepend=-9) != 1))
            many = np.diff(cut, append=len(hit))
            runs = pa.StructArray.from_arrays([pa.array(f[cut].astype(np.int32)), pa.array(many.astype(np.int32))], ["offset", "windows"])
            own = o[cut]
            first = np.flatnonzero(np.diff(own, prepend=-1) != 0)
            which = own[first]
            lists = pa.ListArray.from_arrays(pa.array(np.append(first, len(own)).astype(np.int32)), runs)
            out = {group_key: pa.array(np.array(group, np.int64)[which]), member_key: pa.array(np.array(member, np.int64)[which])}
            yield pa.record_batch({**out, "n": pa.array(np.array(n, np.int64)[which]), "runs": lists.cast(run_type)})

        for batch in batches:
            for g, m, n, body in zip(*(batch.column(x).to_pylist() for x in (group_key, member_key, "n", "bytes"))):
                if g != last:
                    size += close()
                    members, last = {}, g
                    if size > SORTED_BYTES:
                        yield from flush()
                        held, size = [], 0
                own = members.get(m, (0, None))
                members[m] = (own[0] + n, body if own[1] is None else own[1])
        close()
        yield from flush()

    dealt = held.repartition(shuffle_partitions(held.sparkSession), group_key).sortWithinPartitions(group_key)
    return dealt.select(group_key, member_key, "n", "bytes").mapInArrow(run, f"{group_key} long, {member_key} long, n long, {RUNS}")


HALF = "anchor long, ctx long, n long, place int, lo int, hi int, off int, bytes binary, group long, member long"


def _in_halves(held: DataFrame, length: int) -> DataFrame:
    """anchor, ctx, n, runs of the stretches of crowded anchors.

    held: anchor, ctx, n, place (of the anchor in the stretch), bytes, in rows as for ``_compared``.
    lo, hi: the places in a window that the anchor has in a half; off: where a half starts in its stretch.
    """

    def run(batches):
        def signed(h):
            return h - (1 << 64) if h >> 63 else h

        for batch in batches:
            out = []
            for r in batch.to_pylist():
                place, body, mid = r["place"], r["bytes"], (r["lo"] + r["hi"]) // 2
                windows = len(body) - length + 1
                for lo, hi in ((r["lo"], mid), (mid + 1, r["hi"])):
                    # window f has the anchor at place - f
                    first, last = max(0, place - hi), min(windows - 1, place - lo)
                    if lo > hi or first > last:
                        continue
                    half = body[first : last + length]
                    # what every window with the anchor in lo..hi holds
                    common = body[place - lo : place + length - hi]
                    group = xxhash.xxh3_64_intdigest(common, xxhash.xxh3_64_intdigest(f"{r['anchor']} {lo} {hi}"))
                    member = xxhash.xxh3_64_intdigest(half, place - first)
                    out.append((r["anchor"], r["ctx"], r["n"], place - first, lo, hi, r["off"] + first, half, signed(group), signed(member)))
            if out:
                cols = list(zip(*out))
                types = [pa.int64(), pa.int64(), pa.int64(), *[pa.int32()] * 4, pa.binary(), pa.int64(), pa.int64()]
                names = [x.split()[0] for x in HALF.split(", ")]
                yield pa.record_batch({k: pa.array(v, t) for k, v, t in zip(names, cols, types)})

    whole = held.groupBy("anchor", "ctx").agg(F.max("n").alias("n"), F.max("place").alias("place"), F.max("bytes").alias("bytes"))
    open_ = whole.select("anchor", "ctx", "n", "place", F.lit(0).alias("lo"), F.lit(length - GRAM).alias("hi"), F.lit(0).alias("off"), "bytes")
    done = []
    while True:
        halves = written(open_.mapInArrow(run, HALF), "halves")
        members = halves.groupBy("group", "member").agg(F.sum("n").alias("n"), F.count("*").alias("rows"), F.max("bytes").alias("bytes"))
        members = written(members, "members")
        sizes = members.groupBy("group").agg(F.count("*").alias("kinds"), F.sum("n").alias("all"), F.sum("rows").alias("rows")).filter("all > 1")
        sizes = written(sizes, "sizes")
        small = join_hot(members.select("group", "member", "n", "bytes"), sizes.filter(F.col("kinds") <= GROUP).select("group", "kinds"), ["group"], "kinds")
        marks = written(_compared(small.drop("kinds"), length, ["group", "member"]), "half-marks")
        marks = marks.join(members.select("group", "member", "rows"), ["group", "member"]).select("group", "member", "rows", "runs")
        back = join_hot(halves.select("group", "member", "anchor", "ctx", "n", "off"), written(marks, "half-marks"), ["group", "member"], "rows")
        moved = F.transform("runs", lambda r: F.struct((r["offset"] + F.col("off")).alias("offset"), r["windows"].alias("windows")))
        done.append(written(back.select("anchor", "ctx", "n", moved.alias("runs")), "half-marks"))
        # groups one window wide have one member, so the halving ends
        open_ = join_hot(halves.drop("member"), sizes.filter(F.col("kinds") > GROUP).select("group", "rows"), ["group"], "rows").drop("group", "rows")
        open_ = written(open_, "open")
        if open_.isEmpty():
            break
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return out


def _removed(joined: DataFrame, length: int, kind: str) -> DataFrame:
    def run(batches):
        for part in slices(batches, "text"):
            out = []
            for t, spans in zip(part.column("text").to_pylist(), part.column("spans").to_pylist()):
                raw, merged = (t or "").encode(), []
                for s, e in sorted((x["start"], x["start"] + x["windows"] + length - 1) for x in spans or ()):
                    if merged and s <= merged[-1][1]:
                        merged[-1][1] = max(merged[-1][1], e)
                    else:
                        merged.append([s, e])
                gone = sum(e - s for s, e in merged)
                at, kept = 0, []
                for s, e in merged:
                    kept.append(raw[at:s])
                    at = e
                out.append((len(raw), gone, len(merged), b"".join([*kept, raw[at:]])))
            n, gone, many, kept = zip(*out)
            yield pa.record_batch({"id": part.column("id"), "n_bytes": pa.array(n, pa.int64()), "n_removed": pa.array(gone, pa.int64()), "n_spans": pa.array(many, pa.int64()), "kept": pa.array(kept, pa.binary())})

    return joined.mapInArrow(run, f"id {kind}, n_bytes long, n_removed long, n_spans long, kept binary")
