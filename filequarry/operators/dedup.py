"""Exact, perceptual, tag and text duplicates, greedy groups, keepers and proposals."""

from __future__ import annotations

import difflib
import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F, types

from filequarry.operators import near_texts
from filequarry.operators.scratch import join_hot, saved


def keeper_rank(date: Column, path: Column, size: Column, id_: Column) -> Column:
    """The keeper has the least of these: date, then longest path, then largest size, then id."""
    late = F.lit("9999-01-01 00:00:00").cast("timestamp_ntz")
    return F.struct(F.coalesce(date, late), -F.length(path), -F.coalesce(size, F.lit(0)), id_)


def exact_groups(files: DataFrame) -> DataFrame:
    """hash_md5, n, keep_id, wasted_bytes of each hash that several files share.

    One aggregation with map-side partial results; hot hashes are combined before the shuffle.
    """
    size = F.coalesce("size_bytes", F.lit(0))
    keep = F.min_by(F.struct("id", size.alias("size")), keeper_rank(F.coalesce("date_best", "date_modified", "date_created"), F.col("path"), F.col("size_bytes"), F.col("id")))
    grouped = files.filter("hash_md5 IS NOT NULL").groupBy("hash_md5").agg(F.count("*").alias("n"), F.sum(size).alias("total"), keep.alias("keep"))
    return grouped.filter("n > 1").select("hash_md5", "n", F.col("keep.id").alias("keep_id"), (F.col("total") - F.col("keep.size")).alias("wasted_bytes"))


def exact_members(files: DataFrame) -> DataFrame:
    """hash_md5, file_id, keep_id, similarity: members of the exact groups."""
    return join_hot(files.select("id", "hash_md5"), saved(exact_groups(files), "groups"), ["hash_md5"], "n").select("hash_md5", F.col("id").alias("file_id"), "keep_id", F.lit(1.0).alias("similarity"))


def sign_hash(vector: Column) -> Column:
    """One bit for each dimension, as a string of 0 and 1."""
    return F.array_join(F.transform(vector, lambda x: F.when(x > 0, "1").otherwise("0")), "")


#: Bits of a band of hashes, about: wide enough that few hashes share one by chance.
BAND_BITS = 16


def classes(rows: DataFrame, *key: str) -> DataFrame:
    """id, class: rows (id) of equal ``key`` belong to the one of least id. A key with many rows is joined where they are."""
    sizes = saved(rows.groupBy(*key).agg(F.min("id").alias("class"), F.count("*").alias("n")), "classes")
    return join_hot(rows.select("id", *key), sizes, list(key), "n").select("id", "class")


def class_groups(classes: DataFrame, pairs: DataFrame) -> DataFrame:
    """anchor, member of greedy groups over rows in ``classes`` (id, class), from ``pairs`` (a, b) between classes.

    Equal rows are alike and alike to the same others. The first of them is an anchor, which the rest
    follow, or it goes to an anchor before it, and so do they.
    """
    return _grouped(classes, greedy_groups(pairs.select("a", "b"))).select("anchor", "member")


def scored_groups(classes: DataFrame, pairs: DataFrame, same: Column | None = None) -> DataFrame:
    """``class_groups`` with similarity: that of ``pairs`` (a, b, similarity) between anchor and member, ``same`` (1; a
    Column of ``classes``) for rows equal to their anchor."""
    groups = greedy_groups(pairs.select("a", "b")).join(pairs.select(F.col("a").alias("anchor"), F.col("b").alias("member"), "similarity"), ["anchor", "member"])
    scored = _grouped(classes.withColumn("same", F.lit(1.0) if same is None else same), groups)
    return scored.select("anchor", "member", F.coalesce("similarity", "same").alias("similarity"))


def _grouped(classes: DataFrame, groups: DataFrame) -> DataFrame:
    """anchor, member of rows in ``classes`` whose class is in ``groups`` (anchor, member) or has several rows, with the columns of both."""
    sizes = classes.groupBy("class").agg(F.count("*").alias("n"))
    near = join_hot(classes, saved(sizes.join(groups.withColumnRenamed("member", "class"), "class", "left"), "anchors"), ["class"], "n")
    return near.withColumn("anchor", F.coalesce("anchor", "class")).withColumnRenamed("id", "member").filter("anchor <> member")


#: Bits that a band may differ by so that few hashes meet on it; for more, hashes are compared in blocks of so many.
BAND_RADIUS, HASH_BLOCK = 2, 16384


def hamming_pairs(hashes: DataFrame, most: int, bits: int = 64) -> DataFrame:
    """a < b, distance, na, nb for hashes (id, bits as a 0/1 string) at most ``most`` apart; equal hashes are one, with
    their least id and number.

    Of b bands, two hashes within the distance differ in at most most / b bits on one. One side offers
    all values that half of these bits can turn the band into, the other those of the rest, so the two
    meet in an equi-join on a value between them. Past ``BAND_RADIUS`` bits a large part of all hashes would meet
    on some band: blocks of hashes are compared instead, each pair of blocks a group.
    """
    count = max(1, round(bits / BAND_BITS))
    cut = [round(k * bits / count) for k in range(count + 1)]
    spans = list(zip(cut, cut[1:]))
    words = F.array(*(F.conv(F.substring("bits", s + 1, e - s), 2, 10).cast("long") for s, e in spans))
    distinct = hashes.filter("bits IS NOT NULL").groupBy("bits").agg(F.min("id").alias("id"), F.count("*").alias("n"))
    coded = saved(distinct.select(words.alias("words"), "id", "n"), "hashes")
    radius = most // count
    if radius > BAND_RADIUS:
        return _block_pairs(coded, most, [e - s for s, e in spans])

    def met(name: str, flips: int) -> DataFrame:
        def band(k: int) -> Column:
            masks = F.array(*map(F.lit, _masks(cut[k + 1] - cut[k], flips)))
            return F.struct(F.lit(k).alias("band"), F.transform(masks, lambda m: F.col("words")[k].bitwiseXOR(m)).alias("values"))

        rows = coded.select(F.col("words").alias(name), F.explode(F.array(*map(band, range(count)))).alias("b"))
        return rows.select(name, "b.band", F.explode("b.values").alias("value"))

    distance = sum((F.bit_count(F.col("x")[k].bitwiseXOR(F.col("y")[k])) for k in range(count)), F.lit(0))
    # a file of hashes is small next to the values they offer: never broadcast
    close = met("x", radius - radius // 2).hint("merge").join(met("y", radius // 2), ["band", "value"]).filter((F.col("x") != F.col("y")) & (distance <= most))
    # either may have been the side with more flips
    close = close.select(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y")).distinct().withColumn("distance", distance.cast("int"))
    one, two = (coded.select(F.col("words").alias(w), F.col("id").alias(f"i{w}"), F.col("n").alias(f"n{w}")).hint("merge") for w in "xy")
    ordered = close.join(one, "x").join(two, "y").select("distance", F.struct(F.col("ix").alias("id"), F.col("nx").alias("n")).alias("p"), F.struct(F.col("iy").alias("id"), F.col("ny").alias("n")).alias("q"))
    return ordered.select(F.least("p.id", "q.id").alias("a"), F.greatest("p.id", "q.id").alias("b"), "distance", F.least("p", "q")["n"].alias("na"), F.greatest("p", "q")["n"].alias("nb"))


def _block_pairs(coded: DataFrame, most: int, widths: list[int]) -> DataFrame:
    """``hamming_pairs`` of all ``coded`` (words, id, n): each hash goes to every pair of blocks that its own is in."""
    blocks = math.ceil(max(1, coded.count()) / HASH_BLOCK)
    own = coded.withColumn("block", F.pmod(F.xxhash64("words"), F.lit(blocks)).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("other")
    dealt = own.select("words", "id", "n", "block", other).select("words", "id", "n", "block", F.least("block", "other").alias("p"), F.greatest("block", "other").alias("q"))

    def packed(words: pd.Series) -> list[np.ndarray]:
        """Bands side by side in as few columns of 64 bits as they need."""
        out, free = [], 0
        for column, width in zip(np.array(words.tolist(), dtype=np.uint64).reshape(-1, len(widths)).T, widths):
            if width > free:
                out.append(np.zeros(len(column), np.uint64))
                free = 64
            out[-1] = out[-1] << np.uint64(width) | column
            free -= width
        return out

    def compare(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        p, q = key
        left, right = (rows[rows["block"] == k].sort_values("id") for k in (p, q))
        x, y = packed(left["words"]), packed(right["words"])
        found = [np.zeros((3, 0), np.int64)]
        for at in range(0, len(left), 8):
            first = at if p == q else 0  # within a block, those before were met already
            apart = sum(np.bitwise_count(u[at : at + 8, None] ^ v[None, first:]).astype(np.int16) for u, v in zip(x, y))
            i, j = np.nonzero(apart <= most)
            found.append(np.stack([i + at, j + first, apart[i, j]]))
        i, j, distance = np.concatenate(found, axis=1)
        ids, ns = (np.stack([left[c].to_numpy()[i], right[c].to_numpy()[j]]) for c in ("id", "n"))
        turned = ids[0] > ids[1]
        out = pd.DataFrame({"a": ids.min(0), "b": ids.max(0), "distance": distance, "na": np.where(turned, ns[1], ns[0]), "nb": np.where(turned, ns[0], ns[1])})
        return out[(ids[0] < ids[1]) if p == q else (ids[0] != ids[1])]

    return dealt.groupBy("p", "q").applyInPandas(compare, "a long, b long, distance int, na long, nb long")


def with_copies(pairs: DataFrame, rows: DataFrame, key: list[str], **same: Column) -> DataFrame:
    """``pairs`` (a, b, ..., na, nb) between classes of ``rows`` (id) with equal ``key``, and a row for each further member b of a class
    a: ``same`` gives the other columns, na and nb are the number of its members."""
    sizes = saved(rows.groupBy(*key).agg(F.min("id").alias("a"), F.count("*").alias("n")).filter("n > 1"), "copies")
    copies = join_hot(rows.select(F.col("id").alias("b"), *key), sizes, key, "n").filter("a <> b").withColumns({**same, "na": F.col("n"), "nb": F.col("n")})
    return pairs.unionByName(copies.select(pairs.columns))


def row_pairs(pairs: DataFrame, members: DataFrame, **same: Column) -> DataFrame:
    """All pairs a < b of rows in ``members`` (id, class), with the other columns of ``pairs`` (a, b, ..., na, nb) of their classes, or
    ``same`` within a class."""
    own = saved(members, "members")
    several = own.groupBy("class").agg(F.count("*").alias("n")).filter("n > 1")
    within = several.select(F.col("class").alias("a"), F.col("class").alias("b"), *(c.alias(k) for k, c in same.items()))
    both = pairs.select("a", "b", *same).unionByName(within)
    one, two = (own.select(F.col("class").alias(k), F.col("id").alias(f"i{k}")).hint("merge") for k in "ab")
    full = both.join(one, "a").join(two, "b").filter("a <> b OR ia < ib")
    return full.select(F.least("ia", "ib").alias("a"), F.greatest("ia", "ib").alias("b"), *same)


def _masks(width: int, flips: int) -> list[int]:
    """All values of ``width`` bits with at most ``flips`` set."""
    return [sum(1 << k for k in c) for n in range(min(flips, width) + 1) for c in combinations(range(width), n)]


def tag_sets(rows: DataFrame) -> DataFrame:
    """``rows`` with tags as sorted sets without nulls; those without tags are left out."""
    return rows.withColumn("tags", F.array_sort(F.array_distinct(F.filter("tags", lambda t: t.isNotNull())))).filter(F.size("tags") > 0)


#: Tags that two sets meet on at once, and up to which size of the larger set they are three or two.
SHARED, THREE, TWO = 3, 12, 24


def _key_plan(sizes: list[int], least: float) -> list[tuple[int, int, int, int]]:
    """n, together, sizes, prefix: keys of a set of n tags are all subsets of ``together`` of the first ``prefix`` of them.

    Two sets of n and m tags share t = least (n + m) / (1 + least) tags at least, and so k of them within the first
    n - t + k and m - t + k. Where k isn't ``SHARED``, keys hold both sizes, lest others meet on fewer tags than they must
    share; sets past ``TWO`` tags meet on one.
    """
    out = {}
    for n in sizes:
        for m in sizes:
            small, large = min(n, m), max(n, m)
            if small < least * large - 1e-9:
                continue
            shared = max(1, math.ceil(least * (n + m) / (1 + least) - 1e-9))
            together = min(shared, SHARED if large <= THREE else 2 if large <= TWO else 1)
            key = (n, together, 0 if together == SHARED or large > TWO else small * 100 + large)
            out[key] = max(out.get(key, 0), n - shared + together)
    return [(*key, prefix) for key, prefix in out.items()]


def _subsets(items: Column, count: int) -> Column:
    """All subsets of ``count`` of an array, in its order."""
    if count == 1:
        return F.transform(items, lambda x: F.array(x))
    rest = lambda x, i: F.transform(_subsets(F.slice(items, i + 2, F.size(items)), count - 1), lambda s: F.concat(F.array(x), s))
    return F.flatten(F.transform(items, rest))


def tag_pairs(rows: DataFrame, least: float, wild: str | None = None) -> DataFrame:
    """a < b, jaccard, na, nb of rows (id, block, tags) of one block whose tag sets have Jaccard >= ``least``; equal sets
    of a block are one, with their least id and number. Rows of the block ``wild`` meet those of every block.

    Prefix filter: of each set's tags, rarest first, only so many can be missed by a partner that
    similar, and as many as the two must share lie so far ahead. Pairs meet on up to ``SHARED`` tags at once
    (see :func:`_key_plan`), so that frequent tags alone make no candidates.
    """
    sets = tag_sets(rows.select("id", "block", "tags")).groupBy("block", "tags").agg(F.min("id").alias("id"), F.count("*").alias("copies"))
    sets = saved(sets, "sets")
    close = tag_candidates(sets, least, wild)
    one, two = (sets.select(F.col("id").alias(k), F.col("tags").alias(f"t{k}"), F.col("copies").alias(f"n{k}")) for k in "ab")
    jaccard = F.size(F.array_intersect("ta", "tb")) / F.size(F.array_union("ta", "tb"))
    return close.join(one, "a").join(two, "b").select("a", "b", jaccard.alias("jaccard"), "na", "nb").filter(F.col("jaccard") >= least)


def tag_candidates(sets: DataFrame, least: float, wild: str | None = None) -> DataFrame:
    """a < b of ``sets`` (id, block, tags) that may have Jaccard ``least``; see :func:`tag_pairs`."""
    within = ["tag"] if wild is not None else ["block", "tag"]
    often = sets.select("block", F.explode("tags").alias("tag")).groupBy(*within).agg(F.count("*").alias("df"))
    ranked = sets.select("id", "block", F.explode("tags").alias("tag")).join(often, within).groupBy("id", "block").agg(F.array_sort(F.collect_list(F.struct("df", "tag"))).alias("tags"))
    ranked = ranked.select("id", "block", F.size("tags").alias("n"), F.transform("tags", lambda t: t["tag"]).alias("tags"))
    plan = _key_plan(sorted(r[0] for r in sets.select(F.size("tags")).distinct().collect()), least)
    plan = sets.sparkSession.createDataFrame(plan, "n int, together int, sizes int, prefix int")
    prefix = ranked.join(F.broadcast(plan), "n").withColumn("tags", F.slice("tags", F.lit(1), F.col("prefix")))
    keys = F.when(F.col("together") == 1, _subsets(F.col("tags"), 1)).when(F.col("together") == 2, _subsets(F.col("tags"), 2)).otherwise(_subsets(F.col("tags"), SHARED))
    # by hashes: a collision only makes a candidate, and candidates are compared by their tags
    keyed = saved(prefix.select("id", "block", "n", F.explode(F.transform(keys, lambda k: F.xxhash64("together", "sizes", k))).alias("key")), "keys")
    left, right = keyed.select(F.col("id").alias("a"), "block", "key", F.col("n").alias("na")), keyed.select(F.col("id").alias("b"), "block", "key", F.col("n").alias("nb"))
    # what a key costs doesn't show in its bytes: dealt over all tasks
    tasks = int(sets.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    close = left.repartition(tasks, "block", "key").hint("merge").join(right.repartition(tasks, "block", "key"), ["block", "key"]).filter("a < b").select("a", "b", "na", "nb")
    if wild is not None:
        any_ = left.filter(F.col("block") == wild).drop("block").join(right.filter(F.col("block") != wild).drop("block"), "key").filter("a <> b")
        close = close.unionByName(any_.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "na", "nb"))
    return close.filter(f"least(na, nb) >= {least} * greatest(na, nb)").select("a", "b").distinct()


def length_band_pairs(rows: DataFrame, share: float = 0.10) -> DataFrame:
    """a < b, sa, sb, na, nb of rows (id, block, size) of one block whose sizes differ, by at most ``share`` of the larger;
    rows of one size are one, with their least id and number. Nothing but its copies is near an empty row.

    Sizes fall into geometric buckets so wide that partners lie in the same or the next one: an
    equi-join on the bucket stands for the range join.
    """
    sized = saved(rows.groupBy("block", "size").agg(F.min("id").alias("id"), F.count("*").alias("n")), "sizes")
    return _in_band(sized, share)


def _in_band(sized: DataFrame, share: float) -> DataFrame:
    """a < b, sa, sb, na, nb of rows (id, block, size, n)."""
    width = -math.log(1 - share)
    sized = sized.withColumn("bucket", F.floor(F.log(F.col("size").cast("double")) / width))
    left = sized.select(F.col("id").alias("a"), "block", F.col("size").alias("sa"), F.col("n").alias("na"), F.explode(F.array(F.col("bucket") - 1, F.col("bucket"), F.col("bucket") + 1)).alias("bucket"))
    right = sized.select(F.col("id").alias("b"), "block", F.col("size").alias("sb"), F.col("n").alias("nb"), "bucket")
    near = F.abs(F.col("sa") - F.col("sb")) <= share * F.greatest("sa", "sb")
    return left.join(right, ["block", "bucket"]).filter((F.col("a") < F.col("b")) & near).select("a", "b", "sa", "sb", "na", "nb")


def likeness(a: str, b: str, jaccard: float, least: float) -> float:
    """0.4 ratio of matching characters, the first text first (it isn't symmetric), + 0.6 ``jaccard``; 0 where it can't be ``least``."""
    if not a or not b:
        return 0.6 * jaccard
    needed = (least - 0.6 * jaccard) / 0.4 - 1e-9
    if 2.0 * min(len(a), len(b)) / (len(a) + len(b)) < needed:
        return 0.0
    matcher = difflib.SequenceMatcher(None, a, b)
    return 0.4 * matcher.ratio() + 0.6 * jaccard if matcher.quick_ratio() >= needed else 0.0


def _whole_texts(rows: DataFrame) -> DataFrame:
    """id, block, text, n, size of rows (id, block, text): equal texts of a block are one, with their least id and number."""
    whole = rows.filter("text <> ''").groupBy("block", F.sha2("text", 256).alias("digest")).agg(F.min_by("text", "id").alias("text"), F.min("id").alias("id"), F.count("*").alias("n"))
    return saved(whole.select("id", "block", "text", "n", F.length("text").alias("size")), "texts")


def text_near_pairs(rows: DataFrame, least: float = 0.90, share: float = 0.10) -> DataFrame:
    """a < b, similarity, na, nb for rows (id, block, text) of one block with ratio >= ``least``, the first text first;
    equal texts are one, with their least id and number.

    Whole texts meet only where their marks allow the ratio (see ``near_texts``).
    """
    whole = _whole_texts(rows)
    return _scored(near_texts.candidates(whole, least, share), whole, least).select("a", "b", "similarity", "na", "nb")


def _scored(pairs: DataFrame, whole: DataFrame, least: float) -> DataFrame:
    """a, b, similarity, na, nb of those ``pairs`` (a, b) of texts (id, text, n) with ratio ``least`` or more."""

    def score(batches):
        for rows in batches:
            # not a filter on a function of columns, which Spark would work out before it deals the pairs
            rows["similarity"] = [near_texts.ratio(x, y, least) for x, y in zip(rows["ta"], rows["tb"])]
            yield rows.loc[rows["similarity"] >= least, ["a", "b", "similarity", "na", "nb"]]

    one, two = (whole.select(F.col("id").alias(k), F.col("text").alias(f"t{k}"), F.col("n").alias(f"n{k}")) for k in "ab")
    # what a pair costs doesn't show in its bytes: dealt over all tasks
    tasks = int(whole.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    met = pairs.join(one, "a").repartition(tasks, "b").join(two.repartition(tasks, "b"), "b")
    return met.mapInPandas(score, "a long, b long, similarity double, na long, nb long")


def text_anchor_pairs(rows: DataFrame, least: float = 0.90, share: float = 0.10) -> DataFrame:
    """Those of :func:`text_near_pairs` that greedy groups hang on: nearly all have an anchor as a.

    A text with no earlier one left that it may be like is an anchor, and only anchors' pairs are scored; what they take
    is out as an anchor, and as a member for any later one. So texts meet about as often as there are members, not
    as there are pairs in groups. Once no more pairs are left than texts, or a round settles less than half of them, all of them are scored.
    """
    whole = _whole_texts(rows)
    left = saved(near_texts.candidates(whole, least, share), "candidates")
    ids = saved(left.select(F.col("a").alias("id")).union(left.select("b")).distinct(), "ids")
    texts, enough = saved(whole.join(ids, "id", "left_semi"), "candidate_texts"), ids.count()
    found, before, now = [], math.inf, left.count()
    while enough < now <= before / 2:
        waiting = left.select(F.col("b").alias("a")).distinct()
        found.append(saved(_scored(left.join(waiting, "a", "left_anti"), texts, least), "near"))
        taken = found[0]
        for more in found[1:]:
            taken = taken.unionByName(more)
        taken = saved(taken.groupBy("b").agg(F.min("a").alias("anchor")), "taken")
        still = left.join(waiting, "a", "left_semi").join(taken.select(F.col("b").alias("a")), "a", "left_anti")
        left = saved(still.join(taken, "b", "left").filter("anchor IS NULL OR a < anchor").select("a", "b"), "candidates")
        before, now = now, left.count()
    out = saved(_scored(left, texts, least), "near")
    for more in found:
        out = out.unionByName(more)
    return out


def text_near_groups(rows: DataFrame, least: float = 0.90, share: float = 0.10) -> DataFrame:
    """anchor, member of greedy groups of rows (id, block, text) by :func:`text_near_pairs`."""
    own = rows.filter("text <> ''")
    return class_groups(classes(own.withColumn("digest", F.sha2("text", 256)), "block", "digest"), text_anchor_pairs(own, least, share))


#: Names compared at once: those of a block are dealt into pieces of about so many, each pair of pieces a group.
NAME_BLOCK = 1024


def name_pairs(rows: DataFrame, least: float) -> DataFrame:
    """a, b, similarity for rows (id, block, text) of one block, a's text first, whose ratio is ``least`` or more.

    For short texts; both orders are compared, since the ratio isn't symmetric.
    """

    def compare(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        ids, parts = _pieces(key, rows)
        texts, found = [t for part in parts for t in part], []
        for i, others in _candidates(parts, least):
            for j in others:
                for a, b in ((i, j), (j, i)):
                    similarity = difflib.SequenceMatcher(None, texts[a], texts[b]).ratio()
                    if similarity >= least:
                        found.append((ids[a], ids[b], similarity))
        return pd.DataFrame(found, columns=["a", "b", "similarity"])

    return _dealt(rows).groupBy("block", "p", "q").applyInPandas(compare, "a long, b long, similarity double")


def near_names(rows: DataFrame, least: float) -> DataFrame:
    """id of rows (id, block, text) that are an a of :func:`name_pairs`; a row is done with the first b that is found."""

    def compare(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        ids, parts = _pieces(key, rows)
        texts = [t for part in parts for t in part]
        near = np.zeros(len(texts), bool)
        for i, others in _candidates(parts, least, near):
            for j in others:
                for a, b in ((i, j), (j, i)):
                    if not near[a]:
                        near[a] = difflib.SequenceMatcher(None, texts[a], texts[b]).ratio() >= least
        return pd.DataFrame({"id": ids[near]})

    return _dealt(rows).groupBy("block", "p", "q").applyInPandas(compare, "id long").distinct()


def _dealt(rows: DataFrame) -> DataFrame:
    """id, block, text, piece, p, q: each row of a block of several goes to every pair of pieces that its own is in."""
    own = rows.filter("text <> ''").select("id", "block", "text")
    sizes = saved(own.groupBy("block").agg(F.count("*").alias("n")).filter("n > 1"), "blocks")
    cut = join_hot(own, sizes, ["block"], "n").withColumn("pieces", F.ceil(F.col("n") / NAME_BLOCK).cast("int"))
    cut = cut.withColumn("piece", F.pmod(F.xxhash64("id"), F.col("pieces")).cast("int"))
    dealt = cut.select("id", "block", "text", "piece", F.explode(F.sequence(F.lit(0), F.col("pieces") - 1)).alias("other"))
    dealt = dealt.select("id", "block", "text", "piece", F.least("piece", "other").alias("p"), F.greatest("piece", "other").alias("q"))
    # what a group costs doesn't show in its bytes, by which tasks would be put together
    return dealt.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), "block", "p", "q")


def _pieces(key: tuple, rows: pd.DataFrame) -> tuple[np.ndarray, list[list[str]]]:
    """Ids and texts of the one piece or the two pieces of a group."""
    parts = [rows[rows["piece"] == k] for k in dict.fromkeys(key[1:])]
    return np.concatenate([r["id"].to_numpy() for r in parts]), [r["text"].tolist() for r in parts]


def _candidates(parts: list[list[str]], least: float, done: np.ndarray | None = None) -> Iterator[tuple[int, np.ndarray]]:
    """Each text of one list with those after it that may have ratio ``least``, or of two lists one with the other's, likely
    ones first. Pairs of which both are ``done`` by then are left out.

    The ratio counts characters that both have in the same order: no more than both have at all, nor than their
    longest common subsequence, found for all others at once with a bit for each character of the text.
    """
    texts = [t for part in parts for t in part]
    lengths = np.array([len(t) for t in texts])
    flat = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    known, flat = np.unique(flat, return_inverse=True)
    codes = np.full((len(texts), lengths.max(initial=0)), len(known))
    codes[np.arange(codes.shape[1]) < lengths[:, None]] = flat
    counts = np.zeros((len(texts), 32), np.int16)  # characters share places: bounds only grow by it
    np.add.at(counts, (np.repeat(np.arange(len(texts)), lengths), flat % 32), 1)
    codes = np.ascontiguousarray(codes.T)
    for i in range(len(parts[0])):
        first = i + 1 if len(parts) == 1 else len(parts[0])
        needed = least * (lengths[first:] + lengths[i]) / 2 - 1e-9
        fits = np.minimum(lengths[first:], lengths[i]) >= needed
        at = np.flatnonzero(fits if done is None else fits & ~(done[i] & done[first:]))
        at = at[np.minimum(counts[first + at], counts[i]).sum(1) >= needed[at]]
        if lengths[i] <= 64 and len(at):
            common = _common(codes[: lengths[i], i], codes[: lengths[first + at].max(), first + at], len(known))
            keep = common >= needed[at]
            at = at[keep][np.argsort(-common[keep] / needed[at][keep], kind="stable")]
        yield i, first + at


def _common(text: np.ndarray, others: np.ndarray, characters: int) -> np.ndarray:
    """Lengths of the longest common subsequences of ``text``, 64 codes at most, with the columns of ``others``."""
    places = np.zeros(characters + 1, np.uint64)
    for k, c in enumerate(text):
        places[c] |= np.uint64(1 << k)
    left = np.full(others.shape[1], 2**64 - 1, np.uint64)
    for row in others:
        met = left & places[row]
        left = (left + met) | (left - met)
    return np.bitwise_count(~left & np.uint64((1 << len(text)) - 1)).astype(int)


def described(rows: DataFrame) -> DataFrame:
    """id, family, description, tags in lower case, tags as sorted sets; rows without tags are left out."""
    return tag_sets(rows.select("id", "family", F.lower(F.coalesce("description", F.lit(""))).alias("description"), F.transform("tags", F.lower).alias("tags")))


def semantic_pairs(rows: DataFrame, least: float = 0.55) -> DataFrame:
    """a < b, similarity, na, nb for rows (id, family, description, tags): 0.4 ratio + 0.6 tag Jaccard >= ``least``; rows
    with equal family, description and tags are one, with their least id and number.

    The ratio adds at most 0.4, so pairs need a tag Jaccard of (least - 0.4) / 0.6 at least and
    come from the tag join; a blank family matches every family. ``least`` is at most 0.6, so equal tags are enough.
    """
    if not 0.4 < least <= 0.6:
        raise ValueError("least lies above 0.4 and is 0.6 at most")

    def score(batches):
        for pairs in batches:
            pairs["similarity"] = [likeness(x, y, j, least) for x, y, j in zip(pairs["da"], pairs["db"], pairs["jaccard"])]
            yield pairs.loc[pairs["similarity"] >= least, ["a", "b", "similarity", "na", "nb"]]

    whole = saved(described(rows).groupBy("family", "description", "tags").agg(F.min("id").alias("id"), F.count("*").alias("n")), "described")
    sets = tag_pairs(whole.select("id", F.col("family").alias("block"), "tags"), (least - 0.4) / 0.6 - 1e-9, wild="").select("a", "b", "jaccard")
    # pairs of sets stand for those of all that have them, and what has one set is alike in tags
    own = saved(classes(whole.withColumn("block", F.col("family")), "block", "tags").join(whole.drop("tags"), "id"), "members")
    same = own.select(F.col("class").alias("a"), F.col("class").alias("b"), F.lit(1.0).alias("jaccard")).distinct()
    both = sets.unionByName(same)
    side = [own.select(F.col("class").alias(k), F.col("id").alias(f"i{k}"), F.col("description").alias(f"d{k}"), F.col("n").alias(f"n{k}")) for k in "ab"]
    full = both.join(side[0], "a").join(side[1], "b").filter("a <> b OR ia < ib")
    # the ratio isn't symmetric: the first text is that of the lesser id
    full = full.select("jaccard", *(F.when(F.col("ia") < F.col("ib"), F.col(f"{c}{x}")).otherwise(F.col(f"{c}{y}")).alias(f"{c}{x}") for c in "idn" for x, y in ("ab", "ba")))
    # what a pair costs doesn't show in its bytes: dealt over all tasks, and scored once, not by a filter that Spark would put before
    full = full.select(F.col("ia").alias("a"), F.col("ib").alias("b"), "jaccard", "da", "db", "na", "nb")
    dealt = full.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), "a", "b")
    return dealt.mapInPandas(score, "a long, b long, similarity double, na long, nb long")


def semantic_groups(rows: DataFrame, least: float = 0.55) -> DataFrame:
    """anchor, member of greedy groups by :func:`semantic_pairs`."""
    return class_groups(classes(described(rows), "family", "description", "tags"), semantic_pairs(rows, least))


def greedy_groups(pairs: DataFrame) -> DataFrame:
    """anchor, member: rows in id order; each row not yet taken takes all later similar rows not yet taken.

    Done in rounds over all rows at once: a row is an anchor once all its smaller neighbours are
    members, and a member once one of them is an anchor; a member goes to its smallest anchor.
    """
    pairs = saved(pairs.select("a", "b").distinct(), "pairs")
    state = saved(pairs.select(F.col("a").alias("id")).union(pairs.select("b")).distinct().withColumn("kind", F.lit("?")), "state")
    while not state.filter("kind = '?'").isEmpty():
        smaller = pairs.join(state.select(F.col("id").alias("a"), "kind"), "a").groupBy(F.col("b").alias("id"))
        smaller = smaller.agg(F.max(F.col("kind") == "anchor").alias("taken"), F.max(F.col("kind") == "?").alias("open"))
        kind = F.when(F.col("kind") != "?", F.col("kind")).when(F.col("taken"), "member").when(F.col("open"), "?").otherwise("anchor")
        state = saved(state.join(smaller, "id", "left").fillna(False, ["taken", "open"]).select("id", kind.alias("kind")), "state")
    anchors, members = state.filter("kind = 'anchor'").select(F.col("id").alias("a")), state.filter("kind = 'member'").select(F.col("id").alias("b"))
    return pairs.join(anchors, "a").join(members, "b").groupBy(F.col("b").alias("member")).agg(F.min("a").alias("anchor")).select("anchor", "member")


def rounded(value: Column, digits: int) -> Column:
    """``value`` to ``digits`` places by what it is in binary, an exact tie to the even digit, which built-in rounding doesn't do."""

    def run(values: pd.Series) -> pd.Series:
        return pd.Series([None if pd.isna(v) else round(v, digits) for v in values.tolist()], dtype="float64")

    return F.pandas_udf(run, types.DoubleType())(value)


# Kinds of duplicates in the order in which they are found, the digits of their similarity (perceptual ones
# have one similarity), what they are called, and which files count as text.
KINDS = ["exact", "perceptual", "semantic", "content"]
DIGITS = {"semantic": 2, "content": 3}
PERCEPTUAL_SIMILARITY, LEAST_CONFIDENCE, LARGEST_TEXT = 0.95, 0.5, 200_000
CALLED = {"exact": "exact byte-for-byte duplicate", "perceptual": "perceptual near-duplicate (visually identical)", "semantic": "semantic near-duplicate (similar AI tags/description)", "content": "near-identical text content"}
TEXT_EXTENSIONS = [".txt", ".md", ".html", ".htm", ".xml", ".json", ".yaml", ".yml", ".csv", ".tsv", ".log", ".srt", ".vtt", ".rst", ".ini", ".cfg", ".py", ".js", ".ts", ".css", ".scss"]
# End of fixed values.


def text_candidate(mime: Column, extension: Column, size: Column) -> Column:
    """Whether a file is compared by its text: not empty, not huge, of a text type or extension."""
    ext = F.lower(F.coalesce(extension, F.lit("")))
    ext = F.when((ext == "") | ext.startswith("."), ext).otherwise(F.concat(F.lit("."), ext))
    return F.coalesce((size > 0) & (size <= LARGEST_TEXT), F.lit(False)) & (F.coalesce(mime.startswith("text/"), F.lit(False)) | ext.isin(TEXT_EXTENSIONS))


def group_members(groups: DataFrame, kind: str) -> DataFrame:
    """kind, group_id, file_id, similarity, n: all members of greedy groups (anchor, member, similarity), the anchor among
    them. A group has one similarity, the average of its members' to the anchor, and goes by its anchor, its least id.
    """
    total = F.sum(F.col("similarity").cast("decimal(28,18)")).cast("double") if kind in DIGITS else None  # in decimals: the same in any order of rows
    similarity = rounded(total / F.count("similarity"), DIGITS[kind]) if kind in DIGITS else F.lit(PERCEPTUAL_SIMILARITY)
    sizes = saved(groups.groupBy(F.col("anchor").alias("group_id")).agg(similarity.alias("similarity"), (F.count("*") + 1).alias("n")), "sizes")
    each = join_hot(groups.select(F.col("anchor").alias("group_id"), F.col("member").alias("file_id")), sizes, ["group_id"], "n")
    all_ = each.unionByName(sizes.withColumn("file_id", F.col("group_id")))
    return all_.select(F.lit(kind).alias("kind"), "group_id", "file_id", "similarity", "n")


def with_keepers(members: DataFrame, files: DataFrame) -> DataFrame:
    """``members`` (kind, group_id, file_id, ...; keep_id where there is one already) with keep_id elected where it is
    null; members without a file don't count, and a group of one is left out."""
    if "keep_id" not in members.columns:
        members = members.withColumn("keep_id", F.lit(None).cast("long"))
    rank = keeper_rank(F.coalesce("date_best", "date_modified", "date_created"), F.col("path"), F.col("size_bytes"), F.col("id"))
    known = members.join(files.select(F.col("id").alias("file_id"), rank.alias("rank")), "file_id")
    groups = known.groupBy("kind", "group_id").agg(F.count("*").alias("known"), F.coalesce(F.max("keep_id"), F.min_by("file_id", "rank")).alias("keeper"))
    keepers = saved(groups.filter("known > 1"), "keepers")
    return join_hot(members, keepers, ["kind", "group_id"], "known").withColumn("keep_id", F.col("keeper")).drop("known", "keeper")


def marks(members: DataFrame, marked: DataFrame, files: DataFrame, trash: str = "trash") -> DataFrame:
    """file_id, kind, current_value, proposed_value, confidence, reasoning: one proposal for each member that isn't its
    group's keeper and isn't in ``marked`` (file_id); the first group wins, by kind (see ``KINDS``), then by least id."""
    order = F.array_position(F.array(*map(F.lit, KINDS)), F.col("kind"))
    chosen = duplicate_proposals(members.withColumn("group_id", F.struct(order.alias("order"), F.col("group_id").cast("string").alias("name"), F.col("similarity"))), marked, "group_id")
    called = F.create_map(*(F.lit(x) for kv in CALLED.items() for x in kv))
    kind = F.element_at(F.array(*map(F.lit, KINDS)), F.col("group_id.order").cast("int"))
    own = files.select(F.col("id").alias("file_id"), F.col("path").alias("current_value"))
    keep = files.select(F.col("id").alias("keep_id"), F.col("path").alias("keep_path"))
    said = chosen.join(own, "file_id").join(keep, "keep_id", "left").withColumns({"kind": kind, "proposed_value": F.coalesce("keep_path", F.lit("(unknown)"))})
    why = F.format_string(f"%s (similarity=%.2f). Will be moved to {trash}. Keeper: %s", called[F.col("kind")], F.coalesce("group_id.similarity", F.lit(0.0)), "proposed_value")
    return said.select("file_id", "kind", "current_value", "proposed_value", "confidence", why.alias("reasoning"))


def duplicate_proposals(members: DataFrame, marked: DataFrame, *more: str) -> DataFrame:
    """file_id, keep_id, confidence, and columns ``more`` of members: one proposal for each non-keeper not marked before; the first group wins.

    members: group_id, file_id, keep_id, similarity, kind.
    """
    fresh = members.filter("file_id <> keep_id").join(marked.select("file_id"), "file_id", "left_anti")
    confidence = F.when(F.col("kind") == "exact", 1.0).otherwise(F.greatest("similarity", F.lit(LEAST_CONFIDENCE)))
    best = F.min_by(F.struct("keep_id", confidence.alias("confidence"), *more), "group_id").alias("best")
    return fresh.groupBy("file_id").agg(best).select("file_id", "best.keep_id", "best.confidence", *(f"best.{c}" for c in more))
