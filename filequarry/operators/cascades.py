"""Folder renames: what they make of each other, of files, of proposals and of the tree.

A table of renames has step (the order they run in, each once), old and new. A rename acts on the folder
and on all below it, at a separator: a rename of /a leaves /ab alone. Its own values follow the renames
before it, so they are given as they read before the first. Renames with a null, or with old = new, do
nothing. Paths that are null stay null.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from filequarry.functions import paths
from filequarry.operators.scratch import join_hot, saved

#: Bytes of paths up to which a table of renames goes to every task; beyond, it is joined by folder.
SMALL = 8 << 20
_ALL = (1 << 62) - 1


def followed(places: DataFrame, renames: DataFrame) -> DataFrame:
    """path, before, now: each path after those renames whose step is less than ``before``, their values taken as they are.

    The first step that fits a path or one of its folders is an equi-join on these; what it moved is open
    for later steps only, in another round. A round writes the paths that moved in the one before, no others.
    """
    known = saved(renames.select("step", "old", "new"), "renames")
    return _followed(places, known, _is_small(known))


def _is_small(known: DataFrame) -> bool:
    return (known.agg(F.sum(F.octet_length("old") + F.octet_length("new") + 64)).first()[0] or 0) <= SMALL


def _followed(places: DataFrame, known: DataFrame, small: bool) -> DataFrame:
    """The same for written ``renames`` whose size has been looked at."""
    known = known.filter("old <> new")
    open_ = places.filter("path IS NOT NULL").select("path", F.col("before").cast("long").alias("before")).distinct().withColumns({"now": F.col("path"), "done": F.lit(-1 << 62)})
    rounds = [open_]
    while True:
        each = open_.select("path", "before", "now", "done", F.explode(paths.with_ancestors(F.col("now"))).alias("old"))
        fit = each.join(F.broadcast(known), "old") if small else _fit(each, known)
        fit = fit.filter("step > done AND step < before")
        first = fit.groupBy("path", "before").agg(F.min_by(F.struct("step", "old", "new", "now"), "step").alias("f"))
        now = F.concat("f.new", F.substring("f.now", F.length("f.old") + 1, F.length("f.now")))
        open_ = saved(first.select("path", "before", now.alias("now"), F.col("f.step").alias("done")), "open")
        if open_.isEmpty():
            break
        rounds.append(open_)
    every = rounds[0]
    for more in rounds[1:]:
        every = every.unionByName(more)
    return every.groupBy("path", "before").agg(F.max_by("now", "done").alias("now"))


def _fit(each: DataFrame, known: DataFrame) -> DataFrame:
    """Every path has the outermost folders: how many paths there are of each decides how it is joined."""
    hits = saved(each.groupBy("old").agg(F.count("*").alias("paths")).join(known, "old"), "hits")
    return join_hot(each, hits, ["old"], "paths").drop("paths")


def settled(renames: DataFrame) -> DataFrame:
    """step, old, new of ``renames`` as they read when their turn comes.

    Once the first k are right the next is, and a rename only depends on those of folders above it, so this
    is repeated as often as renames hang on each other, not once for each.
    """
    given = saved(renames.filter("old IS NOT NULL AND new IS NOT NULL").select(F.col("step").cast("long").alias("step"), "old", "new"), "renames")
    ends = given.select(F.col("old").alias("path"), F.col("step").alias("before")).unionByName(given.select(F.col("new").alias("path"), F.col("step").alias("before")))
    current, small = given, _is_small(given)  # what renames make of each other may be longer, by a folder's name each
    while True:
        now = _followed(ends, current, small)
        old, new = (now.select(F.col("path").alias(k), F.col("before").alias("step"), F.col("now").alias(f"{k}_now")) for k in ("old", "new"))
        again = saved(given.join(old, ["old", "step"]).join(new, ["new", "step"]).select("step", F.col("old_now").alias("old"), F.col("new_now").alias("new")), "renames")
        if again.join(current, ["step", "old", "new"], "left_anti").isEmpty():
            return again
        current = again


def _moved_folders(values: DataFrame, renames: DataFrame) -> DataFrame:
    """folder, now, files: the folders of ``values`` (folder), how many there are of each, and where they lie after all renames."""
    dirs = saved(values.filter("folder IS NOT NULL").groupBy("folder").agg(F.count("*").alias("files")), "folders")
    now = followed(dirs.select(F.col("folder").alias("path"), F.lit(_ALL).alias("before")), renames)
    return saved(dirs.join(now.select(F.col("path").alias("folder"), "now"), "folder"), "moved")


def follow(rows: DataFrame, renames: DataFrame, *columns: str) -> DataFrame:
    """``rows`` with the paths of files in ``columns`` as they read after ``renames`` (:func:`settled`)."""
    for column in columns:
        own = rows.withColumn("folder", paths.parent(F.col(column)))
        moved = _moved_folders(own.select("folder"), renames)
        out = join_hot(own, moved, ["folder"], "files").withColumn(column, F.concat_ws("/", "now", paths.name(F.col(column)))).select(rows.columns)
        rows = out.unionByName(own.filter("folder IS NULL").select(rows.columns))
    return rows


def follow_proposals(proposals: DataFrame, renames: DataFrame) -> DataFrame:
    """``proposals`` on files after folder renames, and no_op: those that want a file where it is by now."""
    out = follow(proposals, renames, "current_value", "proposed_value")
    return out.withColumn("no_op", F.coalesce(F.col("current_value") == F.col("proposed_value"), F.lit(False)))


def after_tree(files: DataFrame, renames: DataFrame, moves: DataFrame) -> DataFrame:
    """dir, before, after: files in each folder now, and after folder renames and the moves (file_id, proposed_value) that follow.

    Of several moves of a file the one with the least target counts.
    """
    target = follow(moves, renames, "proposed_value").groupBy("file_id").agg(F.min("proposed_value").alias("target"))
    now = follow(files.select("id", "path", "dir"), renames, "path").join(target.withColumnRenamed("file_id", "id"), "id", "left")
    after = now.select(paths.parent(F.coalesce("target", "path")).alias("dir"), F.lit(0).alias("before"), F.lit(1).alias("after"))
    both = now.select("dir", F.lit(1).alias("before"), F.lit(0).alias("after")).unionByName(after)
    return both.groupBy("dir").agg(F.sum("before").alias("before"), F.sum("after").alias("after"))
