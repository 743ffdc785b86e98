"""Passes of proposals one after the other, each seeing what those before left, down to names that don't collide.

A pass that adds gives proposals for files that have none; one that rewrites gives new values for files that
have one; one that marks turns proposals into duplicates. What a pass leaves is written before the next one
starts. A pass that fails leaves everything as it was, and the passes after it run; its outcome tells the error, or
it is raised where all passes are asked for.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from typing import NamedTuple

from pyspark.sql import DataFrame, functions as F

from filequarry.functions import paths
from filequarry.operators import naming, proposing
from filequarry.operators.scratch import saved

#: What a pass may do with proposals.
ADDS, REWRITES, MARKS = "adds", "rewrites", "marks"
PROPOSALS = "file_id long, pass string, current_value string, proposed_value string, confidence double"


@dataclass(frozen=True)
class Pass:
    """run(files, known): known has the proposals so far (:data:`PROPOSALS`). It returns file_id, current_value,
    proposed_value, confidence if it adds, file_id, proposed_value if it rewrites, file_id, keep_id, similarity if it marks."""

    name: str
    run: Callable[[DataFrame, DataFrame], DataFrame]
    kind: str = ADDS


class Composed(NamedTuple):
    proposals: DataFrame  # PROPOSALS
    duplicates: DataFrame  # file_id, pass, keep_id, similarity
    outcomes: DataFrame  # place, pass, changed, error


def compose(files: DataFrame, passes: list[Pass], existing: DataFrame | None = None, whole: bool = False) -> Composed:
    """Runs ``passes`` in order. Files in ``existing`` (file_id) get no proposal. With ``whole`` the first pass that fails
    raises its error: for who takes the proposals and doesn't look at the outcomes.

    Of several proposals of one pass for a file the one with the least value counts, of duplicates the one with the least file to keep.
    """
    spark = files.sparkSession
    known = saved(spark.createDataFrame([], PROPOSALS), "proposals")
    doubles = saved(spark.createDataFrame([], "file_id long, pass string, keep_id long, similarity double"), "duplicates")
    outcomes = []
    for place, step in enumerate(passes):
        try:
            found = step.run(files, known)
            if step.kind == ADDS:
                best = F.min(F.struct("proposed_value", "current_value", F.col("confidence").cast("double").alias("confidence"))).alias("p")
                fresh = found.groupBy("file_id").agg(best).join(known.select("file_id"), "file_id", "left_anti").join(doubles.select("file_id"), "file_id", "left_anti")
                if existing is not None:
                    fresh = fresh.join(existing.select("file_id").distinct(), "file_id", "left_anti")
                fresh = saved(fresh.select("file_id", F.lit(step.name).alias("pass"), "p.current_value", "p.proposed_value", "p.confidence"), "added")
                changed = fresh.count()
                known = known.unionByName(fresh)
            elif step.kind == REWRITES:
                new = saved(found.groupBy("file_id").agg(F.min("proposed_value").alias("new")).join(known.select("file_id", "proposed_value"), "file_id").filter("new <> proposed_value").select("file_id", "new"), "rewritten")
                changed = new.count()
                known = saved(known.join(new, "file_id", "left").withColumn("proposed_value", F.coalesce("new", "proposed_value")).drop("new"), "proposals")
            else:
                marked = saved(found.groupBy("file_id").agg(F.min(F.struct("keep_id", "similarity")).alias("d")).join(known.select("file_id"), "file_id", "left_semi"), "marked")
                changed = marked.count()
                doubles = doubles.unionByName(marked.select("file_id", F.lit(step.name).alias("pass"), "d.keep_id", "d.similarity"))
                known = saved(known.join(marked, "file_id", "left_anti"), "proposals")
            outcomes.append((place, step.name, changed, None))
        except Exception as error:  # whatever a pass meets, the others still run
            if whole:
                raise RuntimeError(f"pass {step.name} failed") from error
            outcomes.append((place, step.name, 0, type(error).__name__))
    return Composed(known, doubles, spark.createDataFrame(outcomes, "place int, pass string, changed long, error string"))


def rename_passes(root: str, groups: DataFrame) -> list[Pass]:
    """The passes of renames: from content, siblings and groups, told apart, from the folder, tidied, respelled, near duplicates marked.

    groups: group_id, file_id, role, group_confidence. Siblings and groups come before the passes that know less of a file.
    """

    def hygiene(files: DataFrame, known: DataFrame) -> DataFrame:
        return naming.hygiene_renames(files, known).withColumnRenamed("id", "file_id")

    def spelling(files: DataFrame, known: DataFrame) -> DataFrame:
        stems = known.select(paths.stem(F.col("proposed_value")).alias("stem"))
        return naming.respelled(known, naming.spelling(naming.token_frequency(stems)))

    return [
        Pass("content", lambda files, known: proposing.rename_proposals(files, known, root)),
        Pass("siblings", proposing.sibling_renames),
        Pass("groups", lambda files, known: proposing.group_renames(groups, files, known)),
        Pass("told_apart", proposing.told_apart, REWRITES),
        Pass("useless", proposing.useless_renames),
        Pass("hygiene", hygiene),
        Pass("spelling", spelling, REWRITES),
        Pass("near_duplicates", proposing.near_duplicate_proposals, MARKS),
    ]


def without_collisions(proposals: DataFrame, files: DataFrame) -> DataFrame:
    """``proposals`` (:data:`PROPOSALS`) with names made unique in their folders, against each other and the files there;
    those that would leave a file as it is are left out."""
    to = F.col("proposed_value")
    own = proposals.join(files.select(F.col("id").alias("file_id"), F.col("stem").alias("original"), F.col("filename").alias("current")), "file_id")
    wanted = own.select(F.col("file_id").alias("id"), paths.parent(to).alias("dir"), paths.stem(to).alias("stem"), paths.suffix(to).alias("ext"), "original", "current")
    final = naming.resolve_collisions(wanted, files.select("dir", "filename")).withColumnRenamed("id", "file_id")
    out = proposals.join(final, "file_id").withColumn("proposed_value", F.concat_ws("/", paths.parent(to), "final")).drop("final")
    return out.filter(~F.col("proposed_value").eqNullSafe(F.col("current_value")))
