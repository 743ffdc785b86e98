"""Near duplicates: circulant MinHash, banding, exact Jaccard verification.

Signatures use two permutations: the first scatters shingles over D positions, the second orders
positions, and coordinate k is the least rank under the second permutation shifted circularly by
k. All coordinates of a shingle are one contiguous row of ranks, so a signature is a gather of
rows and a minimum down the columns.

Documents with equal shingle sets form a class; only one of its rows goes on, by a number of its own:
its smallest id, or a number past all ids where another class has that one. Classes that agree
on a band share a bucket. Round one links each member of a bucket to the bucket's leader, the
member that shares most buckets with others (the origin, where copies have one), and confirms
the links on full shingle sets. Jaccard distance is a metric, so whatever links to a document
linked to a leader has an index of at least 2 t - 1 with that leader. Round two takes each
leader's family, the members with that index, and compares those in different components with
one another on full sets inside a task, by counting shared shingles; only links leave the task.
Round three looks, within buckets that still hold more than one component, at the pairs of
different components without a family in common whose signatures agree enough, and confirms
those. Pairs inside one component cannot change the result. Families and buckets of more than
``BLOCK`` members are compared in blocks, so no task holds one whole and no pair is skipped: members
of the most frequent component go to one block each, only the others to all blocks.

With 25 bands of 5 a pair at the threshold of 0.85 meets with probability 1 - 4e-7, and the
signature test of round three passes it with probability 1 - 3e-7; both rise with similarity.

Null, empty and blank texts: 0 shingles, a component of their own. Fewer words than a shingle
count as one shingle. Rows that share an id are one document: whatever one of them links to is linked
with all. A null id is linked with nothing: component null, kept. An empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from filequarry.llm.common import join_hot, mix64, shingle_sets, slices, small_batches, written
from filequarry.llm.components import components, merged

BANDS, ROWS = 25, 5
POSITIONS_LOG2 = 20
BLOCK = 2048
#: Shingles of a family in a block, which bounds a task's memory.
BLOCK_SHINGLES = 2_000_000
#: Up to so many ids are broadcast to pick texts before a join; more go through a shuffled join.
BROADCAST_IDS = 500_000
#: Pairs of one leader that meet in a task.
SALTED = 4096
#: Standard deviations that the signature test of round three allows below the threshold.
SLACK = 5.0

_ranks: dict = {}


def circulant_ranks(k: int) -> np.ndarray:
    """Row p: the ranks of positions p, p + 1 ... p + k - 1, round the circle."""
    if k not in _ranks:
        order = np.random.default_rng(7).permutation(1 << POSITIONS_LOG2).astype(np.uint32)
        _ranks[k] = np.lib.stride_tricks.sliding_window_view(np.concatenate([order, order[: k - 1]]), k)
    return _ranks[k]


def signature(shingles: np.ndarray, k: int = BANDS * ROWS) -> np.ndarray:
    """k coordinates of a set of 64-bit hashes; long sets are taken in pieces."""
    at = (mix64(shingles) >> np.uint64(64 - POSITIONS_LOG2)).astype(np.int64)
    rows, out = circulant_ranks(k), np.full(k, 1 << POSITIONS_LOG2, np.uint32)
    for i in range(0, len(at), 4096):
        np.minimum(out, rows[at[i : i + 4096]].min(axis=0), out=out)
    return out


def _signed(docs: DataFrame, words: int) -> DataFrame:
    """id, check, n, d1, d2 (a digest of the set), bands, sig."""

    def run(batches):
        weight = mix64(np.arange(1, ROWS + 1, dtype=np.uint64))
        band = mix64(np.arange(100, BANDS + 100, dtype=np.uint64))
        for part in slices(batches, "text"):
            sets = shingle_sets(part.column("text").to_pylist(), words)
            sigs = np.stack([signature(s) for s in sets])
            keys = mix64((mix64(sigs.astype(np.uint64).reshape(-1, BANDS, ROWS) + weight) * weight).sum(axis=2) ^ band).view(np.int64)
            digest = np.array([np.frombuffer(xxhash.xxh3_128_digest(s.tobytes()), np.int64) for s in sets])
            full = [len(s) > 0 for s in sets]
            yield pa.record_batch({
                "id": part.column("id"), "check": part.column("check"),
                "n": pa.array([len(s) for s in sets], pa.int64()),
                "d1": pa.array(digest[:, 0]), "d2": pa.array(digest[:, 1]),
                "bands": pa.array([k if f else [] for k, f in zip(keys.tolist(), full)], pa.list_(pa.int64())),
                "sig": pa.array([s.tobytes() for s in sigs.astype(np.uint16)], pa.binary()),
            })

    return docs.mapInArrow(run, "id long, check long, n long, d1 long, d2 long, bands array<bigint>, sig binary")


class Texts:
    """The texts of classes: docs (id, check, text), nodes (node, id, check); repeats: some rows are equal."""

    def __init__(self, docs: DataFrame, nodes: DataFrame, repeats: bool):
        self.docs, self.nodes, self.repeats = docs, nodes, repeats

    def of(self, ids: DataFrame) -> DataFrame:
        """id, text: the text of each class in ``ids``, one row each."""
        ids = written(self.nodes.join(ids.distinct().select(F.col("id").alias("node")), "node").select("node", "id", "check"), "ids")
        picked = self.docs.join(F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids, ["id", "check"]).select(F.col("node").alias("id"), "text")
        return picked.dropDuplicates(["id"]) if self.repeats else picked


def _confirmed(texts: Texts, pairs: DataFrame, words: int, percent: int, linked: int) -> DataFrame:
    """Those of ``pairs`` (a, b; a written table) whose full sets satisfy 100 * intersection >= percent * union,
    and whether they do so for ``linked`` percent, too."""
    both = texts.of(pairs.select(F.col("a").alias("id")).unionByName(pairs.select(F.col("b").alias("id"))))
    # a leader of many pairs has its text in several places
    many = written(pairs.groupBy("a").agg(F.count("*").alias("pairs")), "pairs-of")
    salts = F.ceil(F.col("pairs") / SALTED).cast("int")
    salted = join_hot(pairs, many, ["a"], "pairs").withColumn("salt", F.pmod(F.xxhash64("b"), salts).cast("int")).drop("pairs")
    other = both.select(F.col("id").alias("a"), F.col("text").alias("other")).join(many, "a")
    other = other.withColumn("salt", F.explode(F.sequence(F.lit(0), salts - 1))).drop("pairs")
    joined = salted.join(both.select(F.col("id").alias("b"), F.col("text").alias("text")), "b").join(other, ["a", "salt"]).sortWithinPartitions("a")

    def run(batches):
        last, own = None, None
        for part in slices(batches, "text"):
            found = []
            a, b = part.column("a").to_pylist(), part.column("b").to_pylist()
            other = part.column("other")
            for i, s in enumerate(shingle_sets(part.column("text").to_pylist(), words)):
                if a[i] != last:
                    last, own = a[i], shingle_sets([other[i].as_py()], words)[0]
                both = len(s) + len(own) - len(np.union1d(s, own)) if len(s) and len(own) else 0
                every = len(s) + len(own) - both
                if both and 100 * both >= percent * every:
                    found.append((a[i], b[i], 100 * both >= linked * every))
            x, y, z = zip(*found) if found else ((), (), ())
            yield pa.record_batch({"a": pa.array(x, pa.int64()), "b": pa.array(y, pa.int64()), "linked": pa.array(z, pa.bool_())})

    return written(joined.select("a", "b", "text", "other").mapInArrow(run, "a long, b long, linked boolean"), "links")


def _cells(members: DataFrame, key: str, limit: F.Column, carried: list[str]) -> DataFrame:
    """key, p, q, block and ``carried``: the members of each group dealt to cells in which they are compared.

    members: key, id, component and what ``limit`` (the number of blocks for its rows) aggregates. Members
    of the group's most frequent component (main) go to one block each, p = q = -1 - block; the others to
    each of these, as another ``block``, and to the cells of pairs p <= q of their own blocks. Within a
    cell of p = q >= 0 all are compared, in the others those of different ``block``.
    """
    share = written(members.groupBy(key, "component").agg(F.count("*").alias("c"), limit.alias("b")), "shares")
    main = F.max_by(F.struct("component", "b"), F.struct("c", "component"))
    sizes = share.groupBy(key).agg(main.alias("m"), F.sum("b").alias("b"), F.sum("c").alias("c"))
    sizes = sizes.select(key, F.col("m.component").alias("main"), F.ceil("m.b").cast("int").alias("mains"), F.ceil(F.col("b") - F.col("m.b")).cast("int").alias("others"), "c")
    rows = join_hot(members, written(sizes, "sizes"), [key], "c")
    is_main = F.col("component") == F.col("main")
    draw = F.xxhash64("id")
    own = F.pmod(draw, F.when(is_main, F.greatest("mains", F.lit(1))).otherwise(F.greatest("others", F.lit(1)))).cast("int")

    def cell(p, q, block):
        return F.struct(p.cast("int").alias("p"), q.cast("int").alias("q"), block.cast("int").alias("block"))

    to_mains = F.transform(F.sequence(F.lit(0), F.col("mains") - 1), lambda k: cell(-1 - k, -2 - k, F.lit(1)))
    to_others = F.transform(F.sequence(F.lit(0), F.col("others") - 1), lambda k: cell(F.least(k, "own"), F.greatest(k, "own"), F.col("own")))
    cells = F.when(is_main, F.array(cell(-1 - F.col("own"), -2 - F.col("own"), F.lit(0)))).otherwise(F.concat(to_mains, to_others))
    return rows.withColumn("own", own).withColumn("cell", F.explode(cells)).select(key, "cell.p", "cell.q", "cell.block", *carried)


def _family_links(texts: Texts, families: DataFrame, words: int, percent: int) -> DataFrame:
    """a, b: links on full sets between members of a family in different components.

    families: leader, id, n, component, only of leaders with more than one component.
    """
    limit = F.greatest(F.count("*") / BLOCK, F.sum("n") / BLOCK_SHINGLES)
    rows = _cells(families, "leader", limit, ["id", "component"]).withColumnRenamed("leader", "bucket")
    rows = rows.join(texts.of(families.select("id")), "id")

    def links_of(ids, component, block, sets, across):
        size = np.fromiter(map(len, sets), np.int64, len(sets))
        names, label, count = np.unique(component, return_inverse=True, return_counts=True)
        if len(names) < 2:
            return
        value, at = np.unique(np.concatenate(sets), return_inverse=True)
        of = np.repeat(np.arange(len(sets)), size)
        order = np.argsort(at, kind="stable")
        holders, first = of[order], np.concatenate([[0], np.cumsum(np.bincount(at, minlength=len(value)))])
        begin = np.cumsum(size) - size
        done = np.zeros(len(sets), bool)
        for i in np.flatnonzero(label != count.argmax()).tolist():
            done[i] = True
            mine = at[begin[i] : begin[i] + size[i]]
            many = first[mine + 1] - first[mine]
            ends = np.cumsum(many)
            spots = np.arange(ends[-1]) + np.repeat(first[mine] - (ends - many), many)
            both = np.bincount(holders[spots], minlength=len(sets))
            ok = ~done & (label != label[i]) & (100 * both >= percent * (size + size[i] - both))
            if across:
                ok &= block != block[i]
            # one link to each other component is enough
            for j in {int(label[j]): j for j in np.flatnonzero(ok).tolist()}.values():
                yield int(ids[i]), int(ids[j])

    def run(batches):
        key, held = None, []

        def emit():
            if len(held) > 1:
                ids, component, block, sets = zip(*held)
                found = list(links_of(ids, np.array(component), np.array(block), list(sets), key[1] != key[2]))
                if found:
                    yield pa.record_batch({"a": pa.array([x for x, _ in found], pa.int64()), "b": pa.array([y for _, y in found], pa.int64())})

        for part in slices(batches, "text"):
            sets = shingle_sets(part.column("text").to_pylist(), words)
            cols = [part.column(c).to_pylist() for c in ("bucket", "p", "q", "id", "component", "block")]
            for (*k, i, c, b), own in zip(zip(*cols), sets):
                if k != key:
                    yield from emit()
                    key, held = k, []
                held.append((i, c, b, own))
        yield from emit()

    dealt = rows.repartition("bucket", "p", "q").sortWithinPartitions("bucket", "p", "q")
    return written(dealt.select("bucket", "p", "q", "id", "component", "block", "text").mapInArrow(run, "a long, b long"), "family-links")


def _near(members: DataFrame, least: int, percent: int) -> DataFrame:
    """a, b: pairs of one bucket and different components that agree on ``least`` coordinates.

    members: bucket, p, q (the blocks compared), block, id, n, component, families, sig.
    """

    def pairs_of(ids, n, block, component, families, sig, across):
        m = len(ids)
        names, label, count = np.unique(component, return_inverse=True, return_counts=True)
        if len(names) < 2:
            return
        rare = np.flatnonzero(label != count.argmax())
        leaders = {f: k for k, f in enumerate({f for fs in families for f in fs or ()})}
        within = np.zeros((m, len(leaders) + 1), bool)
        for i, fs in enumerate(families):
            within[i, [leaders[f] for f in fs or ()]] = True
        done = np.zeros(m, bool)
        for i in rare.tolist():
            done[i] = True
            can = ~within[:, within[i]].any(axis=1) & ~done & (label != label[i]) & (100 * np.minimum(n, n[i]) >= percent * np.maximum(n, n[i]))
            if across:
                can &= block != block[i]
            at = np.flatnonzero(can)
            if len(at):
                near = at[(sig[at] == sig[i]).sum(axis=1) >= least]
                for j in near.tolist():
                    yield (int(ids[i]), int(ids[j]))

    def run(batches):
        rest = None
        for batch in batches:
            t = pa.Table.from_batches([batch])
            rest = t if rest is None else pa.concat_tables([rest, t])
            if rest.num_rows < 4096:
                continue
            *ready, rest = _groups(rest)
            yield from emit(ready)
        if rest is not None and rest.num_rows:
            yield from emit(_groups(rest))

    def _groups(t):
        key = np.stack([t.column(c).to_numpy() for c in ("bucket", "p", "q")])
        cuts = [0, *(np.flatnonzero((np.diff(key, axis=1) != 0).any(axis=0)) + 1).tolist(), t.num_rows]
        return [t.slice(s, e - s) for s, e in zip(cuts, cuts[1:])]

    def emit(groups):
        out = set()
        for g in groups:
            if g.num_rows > 1:
                sig = np.frombuffer(b"".join(g.column("sig").to_pylist()), np.uint16).reshape(g.num_rows, -1)
                cols = [g.column(c).to_numpy() for c in ("id", "n", "block", "component")]
                out.update((max(x), min(x)) for x in pairs_of(*cols, g.column("families").to_pylist(), sig, g.column("p")[0].as_py() != g.column("q")[0].as_py()))
        if out:
            yield pa.record_batch({"a": pa.array([x for x, _ in out], pa.int64()), "b": pa.array([y for _, y in out], pa.int64())})

    dealt = members.repartition("bucket", "p", "q").sortWithinPartitions("bucket", "p", "q")
    return dealt.mapInArrow(run, "a long, b long").distinct()


def near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """id_column, n_shingles, component_id, kept: one row for each row of ``docs``."""
    small_batches(docs.sparkSession)
    docs = docs.select(F.col(id_column).cast("long").alias("id"), F.xxhash64(F.col(text)).alias("check"), F.col(text).alias("text"))
    signed = written(_signed(docs, words), "signatures")
    sets = signed.select("id", "n", "d1", "d2")
    full = signed.filter("n > 0 AND id IS NOT NULL").select("id", "check", "n", "d1", "d2")

    digest = ["n", "d1", "d2"]
    nodes = _numbered(full.groupBy(*digest).agg(F.min(F.struct("id", "check")).alias("one"), F.count("*").alias("copies")), full)
    classes = join_hot(full.select("id", *digest), nodes.select(*digest, F.col("node").alias("class"), "copies"), digest, "copies").select("id", "class")
    by_id = written(classes.groupBy("id").agg(F.min("class").alias("class"), F.max("class").alias("last"), F.count("*").alias("rows")), "ids")
    texts = Texts(docs, nodes, not by_id.filter("rows > 1").isEmpty())

    # classes that share a bucket with another
    reps = signed.join(nodes.select("id", "check", *digest, "node"), ["id", "check", *digest]).drop("id", "check").withColumnRenamed("node", "id")
    if texts.repeats:
        reps = reps.dropDuplicates(["id"])
    member = reps.select("id", "n", F.explode("bands").alias("bucket"))
    crowd = member.groupBy("bucket").agg(F.count("*").alias("crowd")).filter("crowd > 1")
    member = written(member.join(crowd, "bucket"), "members")
    standing = member.groupBy("id").agg(F.sum("crowd").alias("standing"))
    leader = member.join(standing, "id").groupBy("bucket").agg(F.max_by(F.struct("id", "n"), F.struct("standing", -F.col("id"))).alias("leader"))
    led = member.join(leader, "bucket").filter("id <> leader.id AND 100 * least(n, leader.n) >= :p * greatest(n, leader.n)".replace(":p", str(percent)))
    tried = written(led.select(F.col("leader.id").alias("a"), F.col("id").alias("b")).distinct(), "pairs")
    # rows that share an id link their classes
    forks = by_id.filter("class < last").select("id", F.col("class").alias("b"))
    same = classes.join(forks, "id").select(F.col("class").alias("a"), "b").distinct()
    near = _confirmed(texts, tried, words, max(1, 2 * percent - 100), percent)
    links = near.filter("linked").select("a", "b").unionByName(same)

    # what the leaders left apart: inside families
    part = written(components(links), "components")
    member = member.join(part, "id", "left").withColumn("component", F.coalesce("component", "id"))
    family = near.select(F.col("a").alias("leader"), F.col("b").alias("id"))
    known = member.select("id", "n", "component").distinct()
    family = written(family.unionByName(near.select(F.col("a").alias("leader"), F.col("a").alias("id"))).distinct().join(known, "id"), "families")
    parted = family.groupBy("leader").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).filter("lo < hi").select("leader")
    parted = written(family.join(parted, "leader", "left_semi"), "parted")
    part = written(merged(part, _family_links(texts, parted, words, percent)), "components")

    # and between families, inside buckets
    within = family.groupBy("id").agg(F.collect_set("leader").alias("families"))
    member = member.drop("component").join(part, "id", "left").withColumn("component", F.coalesce("component", "id"))
    mixed = member.groupBy("bucket").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).filter("lo < hi").select("bucket")
    open_ = written(member.join(mixed, "bucket", "left_semi").select("bucket", "id", "n", "component"), "open")
    open_ = _cells(open_, "bucket", F.count("*") / BLOCK, ["id", "n", "component"])
    open_ = open_.join(reps.select("id", "sig"), "id").join(within, "id", "left")
    open_ = open_.select("bucket", "p", "q", "block", "id", "n", "component", "families", "sig")
    share, k = percent / 100, BANDS * ROWS
    least = int(k * share - SLACK * (k * share * (1 - share)) ** 0.5)
    tried = tried.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    further = written(_near(open_, least, percent).join(tried, ["a", "b"], "left_anti"), "pairs")
    part = merged(part, _confirmed(texts, further, words, percent, percent).filter("linked").select("a", "b"))

    # copies are in the component of their class; numbers past all ids are never the least of one
    label = nodes.select(*digest, "copies", "node").join(part.withColumnRenamed("id", "node"), "node", "left")
    label = written(label.select(*digest, "copies", F.coalesce("component", "node").alias("component")), "labels")
    found = join_hot(full.select("id", *digest), label, digest, "copies").groupBy("id").agg(F.min("component").alias("component"))
    component = F.coalesce("component", "id")
    return sets.join(found, "id", "left").select(F.col("id").alias(id_column), F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(component == F.col("id"), F.lit(True)).alias("kept"))


def _numbered(classes: DataFrame, rows: DataFrame) -> DataFrame:
    """n, d1, d2, id, check (of one of its rows), copies and node of each class.

    node is the id, or, for all but one of the classes with that id, a number past all ids. Those are
    linked with the id's other class, so they are never the least of a component.
    """
    classes = written(classes.select("n", "d1", "d2", "one.id", "one.check", "copies"), "classes")
    forked = classes.groupBy("id").agg(F.count("*").alias("kinds"), F.min(F.struct("n", "d1", "d2")).alias("head")).filter("kinds > 1")
    forked = written(forked.select("id", "kinds", "head"), "forked")
    if forked.isEmpty():
        return classes.withColumn("node", F.col("id"))
    top = rows.agg(F.max("id")).first()[0]
    some = join_hot(classes, forked, ["id"], "kinds")
    node = F.when(F.col("head") == F.struct("n", "d1", "d2"), F.col("id")).otherwise(F.lit(top) + 1 + F.monotonically_increasing_id())
    some = some.withColumn("node", node).drop("kinds", "head")
    return written(classes.join(forked, "id", "left_anti").withColumn("node", F.col("id")).unionByName(some), "classes")
