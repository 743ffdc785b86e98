"""Which proposals run, in what order, with which effect; undo sessions and plans."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from filequarry.functions import paths
from filequarry.operators.proposing import numbered
from filequarry.operators.scratch import ranked


def selected(proposals: DataFrame, least: float = 0.7, with_modified: bool = True) -> DataFrame:
    """Pending, approved and edited proposals sure enough, or of unknown confidence."""
    states = ["pending", "approved"] + (["modified"] if with_modified else [])
    return proposals.filter(F.col("status").isin(states) & ((F.col("confidence") >= least) | F.col("confidence").isNull()))


def ordered(proposals: DataFrame) -> DataFrame:
    """Adds step: folder renames (deepest first), renames, moves, the rest; then id."""
    kind = F.col("proposal_type")
    group = F.when(kind == "rename_folder", 0).when(kind == "rename", 1).when(kind == "move", 2).otherwise(3)
    depth = F.when(kind == "rename_folder", -F.regexp_count("current_value", F.lit("/"))).otherwise(0)
    return proposals.withColumns({"step_group": group, "step_depth": depth}).orderBy("step_group", "step_depth", "id")


def validity(proposals: DataFrame, files: DataFrame) -> DataFrame:
    """Adds outcome: no_op, missing_source, taken or ok, from the catalogue's paths."""
    there = files.select(F.col("path").alias("current_value")).distinct().withColumn("has_source", F.lit(True))
    target = files.select(F.col("path").alias("proposed_value")).distinct().withColumn("has_target", F.lit(True))
    out = proposals.join(there, "current_value", "left").join(target, "proposed_value", "left")
    outcome = F.when(F.col("current_value") == F.col("proposed_value"), "no_op").when(F.col("has_source").isNull(), "missing_source").when(F.col("has_target").isNotNull(), "taken").otherwise("ok")
    return out.withColumn("outcome", outcome).drop("has_source", "has_target")


def moves_after_renames(moves: DataFrame, renames: DataFrame) -> DataFrame:
    """``moves`` (file_id, current_value, proposed_value) as they read once ``renames`` (id and the same
    columns) have run: a renamed file is moved from its new path, under its new name. The first
    rename of a file by id counts."""
    first = renames.groupBy("file_id", "current_value").agg(F.min_by("proposed_value", "id").alias("renamed"))
    target = F.concat(paths.parent(F.col("proposed_value")), F.lit("/"), paths.name(F.col("renamed")))
    out = moves.join(first, ["file_id", "current_value"], "left")
    return out.withColumns({"current_value": F.coalesce("renamed", "current_value"), "proposed_value": F.coalesce(target, "proposed_value")}).drop("renamed")


def gap_sessions(log: DataFrame, key: str = "user_id", gap: int = 300) -> DataFrame:
    """key, session, started, ended, n: entries more than ``gap`` seconds after the last one begin a session."""
    order = Window.partitionBy(key).orderBy("ts", "event_id")
    far = F.timestamp_diff("MICROSECOND", F.lag("ts").over(order), F.col("ts")) > gap * 1_000_000
    numbered = log.withColumn("session", F.sum(F.coalesce(far, F.lit(True)).cast("int")).over(order))
    return numbered.groupBy(key, "session").agg(F.min("ts").alias("started"), F.max("ts").alias("ended"), F.count("*").alias("n"))


def operation_counts(log: DataFrame, key: str = "user_id", gap: int = 300) -> DataFrame:
    """key, session, counts (map from operation to number) of gap sessions."""
    order = Window.partitionBy(key).orderBy("ts", "event_id")
    far = F.timestamp_diff("MICROSECOND", F.lag("ts").over(order), F.col("ts")) > gap * 1_000_000
    numbered = log.withColumn("session", F.sum(F.coalesce(far, F.lit(True)).cast("int")).over(order))
    counted = numbered.groupBy(key, "session", "event_type").agg(F.count("*").alias("n"))
    return counted.groupBy(key, "session").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("event_type", "n")))).alias("counts"))


def last_batch(log: DataFrame, key: str = "user_id", gap: int = 300) -> DataFrame:
    """Entries within ``gap`` seconds of their key's last."""
    last = log.groupBy(F.col(key).alias("k")).agg(F.max("ts").alias("last"))
    return log.join(last, F.col(key) == F.col("k")).filter(F.col("ts") >= F.col("last") - F.make_dt_interval(secs=F.lit(gap))).drop("k", "last")


def undo_plan(log: DataFrame) -> DataFrame:
    """Adds action and step: the log backwards; moves and renames back, trash restored, others skipped.

    step counts down in time, so the order survives a write; entries of one instant go by id, the last first.
    """
    op = F.upper("operation")
    action = F.when(op.isin("MOVE", "RENAME"), "move_back").when(op.isin("DELETE", "TRASH"), "restore").when(op == "RENAME_FOLDER", "rename_folder_back").otherwise("skip")
    numbered_ = ranked(log.withColumns({"action": action, "_one": F.lit(1)}), ["_one"], [F.desc("ts"), F.desc("id")], "step")
    return numbered_.drop("_one").orderBy("step")


def without_stale(proposals: DataFrame, session_id: str) -> DataFrame:
    """``proposals`` less the session's pending moves and folder renames, which a new run makes again."""
    stale = (F.col("session_id") == session_id) & (F.col("status") == "pending") & F.col("proposal_type").isin("move", "rename_folder")
    return proposals.filter(~F.coalesce(stale, F.lit(False)))


def with_outcomes(proposals: DataFrame, results: DataFrame, dry_run: bool = False) -> DataFrame:
    """``proposals`` after a run, with their new status and outcome: applied, failed (rejected, unless it was a dry run) or not run.

    results: id, ok; an exception counts as failed.
    """
    out = proposals.join(results.groupBy("id").agg(F.min(F.coalesce("ok", F.lit(False))).alias("ok")), "id", "left")
    outcome = F.when(F.col("ok"), "applied").when(~F.col("ok"), "failed").otherwise("not_run")
    status = F.col("status") if dry_run else F.when(F.col("ok"), "applied").when(~F.col("ok"), "rejected").otherwise(F.col("status"))
    return out.withColumns({"outcome": outcome, "status": status}).drop("ok")


def emptied_folders(sources: DataFrame, remaining: DataFrame, levels: int = 6) -> DataFrame:
    """dir, depth of folders left without a file, deepest first: those that files were moved out of and their ancestors.

    sources: dir; remaining: dir of each file that is still there.
    """

    def lineage(frame: DataFrame, most: int | None) -> DataFrame:
        parts = F.filter(F.split("dir", "/"), lambda p: p != "")
        lowest = F.lit(1) if most is None else F.greatest(F.size(parts) - most + 1, F.lit(1))
        deep = frame.select("dir").distinct().filter(F.size(parts) > 0).select(parts.alias("parts"), F.explode(F.sequence(lowest, F.size(parts))).alias("depth"))
        return deep.select(F.concat(F.lit("/"), F.array_join(F.slice("parts", F.lit(1), F.col("depth")), "/")).alias("dir"), "depth").distinct()

    return lineage(sources, levels).join(lineage(remaining, None).select("dir"), "dir", "left_anti").orderBy(F.desc("depth"), "dir")


def trash_plan(files: DataFrame, root: str, folder: str = ".trash") -> DataFrame:
    """file_id, current_value, proposed_value of files put into the root's trash ``folder``; names met again are counted up."""
    own = files.select(F.col("id").alias("file_id"), F.col("path").alias("current_value"), F.lit(f"{root}/{folder}").alias("place"), "filename")
    out = numbered(own, "place", "filename", ["file_id"], first=1)
    return out.select("file_id", "current_value", F.concat_ws("/", "place", "filename").alias("proposed_value"))


def touched_folders(applied: DataFrame, root: str, existing: DataFrame) -> DataFrame:
    """dir: folders that applied moves and renames lead to, and the root, that are not there (dir) yet."""
    parents = applied.select(paths.parent(F.col("proposed_value")).alias("dir"))
    top = applied.sparkSession.range(1).select(F.lit(root).alias("dir"))
    return parents.unionByName(top).distinct().join(existing.select("dir"), "dir", "left_anti")


def approved(proposals: DataFrame, least: float) -> DataFrame:
    """Pending proposals of at least that confidence approved; changed says which, so that counting it needs no other pass."""
    hit = F.coalesce((F.col("status") == "pending") & (F.col("confidence") >= least), F.lit(False))
    return proposals.withColumns({"changed": hit, "status": F.when(hit, "approved").otherwise(F.col("status"))})
