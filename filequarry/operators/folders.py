"""Folder summaries, outliers, labels and before/after trees."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from filequarry.functions import paths
from filequarry.operators.scratch import ranked


def summary(files: DataFrame) -> DataFrame:
    """dir, n, bytes, categories (map) and the dominant category (share >= 0.6) of each folder."""
    cats = files.groupBy("dir", "category").agg(F.count("*").alias("c"), F.sum(F.coalesce("size_bytes", F.lit(0))).alias("b"))
    entry = F.struct("category", "c")
    out = cats.groupBy("dir").agg(F.sum("c").alias("n"), F.sum("b").alias("bytes"), F.map_from_entries(F.array_sort(F.collect_list(entry))).alias("categories"), F.max(F.struct("c", "category")).alias("top"))
    return out.select("dir", "n", "bytes", "categories", F.when(F.col("top.c") >= 0.6 * F.col("n"), F.col("top.category")).alias("dominant"))


def content_label(categories: Column) -> Column:
    """The first category in a set order with 40 % of the files; else the largest with 35 %; else mixed."""
    total = F.aggregate(F.map_values(categories), F.lit(0).cast("long"), lambda s, c: s + c)
    label = F.lit(None).cast("string")
    for c, named in reversed(paths.LABELS.items()):
        label = F.when(F.coalesce(F.try_element_at(categories, F.lit(c)), F.lit(0)) >= 0.4 * total, named).otherwise(label)
    top = F.array_max(F.transform(F.map_entries(categories), lambda e: F.struct(e["value"].alias("c"), e["key"].alias("k"))))
    return F.when(total == 0, None).otherwise(F.coalesce(label, F.when(top["c"] >= 0.35 * total, F.concat(F.initcap(top["k"]), F.lit("_Files"))), F.lit("Mixed_Content")))


def top_per_folder(rows: DataFrame, item: str, most: int) -> DataFrame:
    """dir, item, n, rank: the most frequent items of each folder, the first seen (by id) on ties."""
    counted = rows.groupBy("dir", item).agg(F.count("*").alias("n"), F.min("id").alias("first_id"))
    rank = F.row_number().over(Window.partitionBy("dir").orderBy(F.desc("n"), "first_id", item))
    return counted.withColumn("rank", rank).filter(F.col("rank") <= most).select("dir", item, "n", "rank")


def outliers(files: DataFrame, most: int = 5) -> DataFrame:
    """id, dir, category, dominant, rank: in folders of four files or more, those of another category
    than the dominant one, largest first."""
    known = summary(files).filter("n >= 4 AND dominant IS NOT NULL").select("dir", "dominant")
    odd = files.join(known, "dir").filter("category <> dominant AND category <> 'other'")
    rank = F.row_number().over(Window.partitionBy("dir").orderBy(F.desc("size_bytes"), "id"))
    return odd.withColumn("rank", rank).filter(F.col("rank") <= most).select("id", "dir", "category", "dominant", "rank")


def misfits(files: DataFrame, root: str, most: int = 5, most_at_root: int = 20) -> DataFrame:
    """id, dir, category, dominant, by_category, by_tags, rank: files that don't fit their folder.

    In folders of four files or more, those of another category than the dominant one, then those
    whose tags (ai_tags) have none of the folder's eight theme tags, largest first. In the folder
    ``root`` every file, those with tags first, then the largest.
    """
    tags = lowered_tags(files).select("id", "dir", F.explode(F.slice("tags", 1, 5)).alias("tag"))
    themes = top_per_folder(tags, "tag", 8).groupBy("dir").agg(F.collect_list("tag").alias("theme"))
    known = summary(files).select("dir", "n", "dominant").join(themes, "dir", "left")
    return unfit(files, known, root, most, most_at_root).select("id", "dir", "category", "dominant", "by_category", "by_tags", "rank")


def lowered_tags(files: DataFrame) -> DataFrame:
    """Adds tags: those of ai_tags in lower case, none where it is null."""
    return files.withColumn("tags", F.transform(F.coalesce("ai_tags", F.array().cast("array<string>")), F.lower))


def unfit(files: DataFrame, known: DataFrame, root: str, most: int, most_at_root: int) -> DataFrame:
    """The files that don't fit their folder (see ``misfits``), of which ``known`` tells n, dominant and theme; adds tags, by_category, by_tags, rank."""
    files = lowered_tags(files)
    at_root = F.col("dir") == root
    by_category = F.coalesce((F.col("category") != F.col("dominant")) & (F.col("category") != "other"), F.lit(False))
    by_tags = (F.size("tags") > 0) & F.coalesce(~F.arrays_overlap("tags", "theme"), F.lit(False))
    odd = files.join(known, "dir").withColumns({"by_category": by_category, "by_tags": by_tags})
    odd = odd.filter(at_root | (F.col("n") >= 4) & (F.col("by_category") | F.col("by_tags")))
    first = F.when(at_root, F.size("tags") == 0).otherwise(~F.col("by_category"))
    rank = F.row_number().over(Window.partitionBy("dir").orderBy(first, F.desc(F.coalesce("size_bytes", F.lit(0))), "id"))
    return odd.withColumn("rank", rank).filter(F.col("rank") <= F.when(at_root, most_at_root).otherwise(most))


def tree_delta(files: DataFrame, moves: DataFrame) -> DataFrame:
    """dir, before, after: file counts of folders before and after moves (file_id, to_dir)."""
    before = files.select("dir", F.lit(1).alias("before"), F.lit(0).alias("change"))
    moved = moves.join(files.select(F.col("id").alias("file_id"), "dir"), "file_id")
    minus = moved.select("dir", F.lit(0).alias("before"), F.lit(-1).alias("change"))
    plus = moved.select(F.col("to_dir").alias("dir"), F.lit(0).alias("before"), F.lit(1).alias("change"))
    both = before.unionByName(minus).unionByName(plus).groupBy("dir").agg(F.sum("before").alias("before"), F.sum("change").alias("change"))
    return both.select("dir", "before", F.greatest(F.col("before") + F.col("change"), F.lit(0).cast("long")).alias("after"))


def ancestors(files: DataFrame, root: str) -> DataFrame:
    """dir, n, bytes, depth of every folder below ``root``, files counted in all their ancestors."""
    parts = F.split(F.substring("dir", F.lit(len(root) + 2), F.length("dir")), "/")
    steps = F.sequence(F.lit(1), F.size(parts))
    chain = F.transform(steps, lambda k: F.struct(k.alias("depth"), F.concat(F.lit(root + "/"), F.array_join(F.slice(parts, F.lit(1), k), "/")).alias("dir")))
    each = files.filter(F.col("dir").startswith(root + "/")).select(F.explode(chain).alias("a"), "size_bytes")
    return each.groupBy("a.dir", "a.depth").agg(F.count("*").alias("n"), F.sum("size_bytes").alias("bytes"))


def lineage(dirs: DataFrame, root: str) -> DataFrame:
    """dir, folder: each folder (dir) below ``root`` with itself and all folders between the two."""
    parts = F.split(F.substring("dir", F.lit(len(root) + 2), F.length("dir")), "/")
    chain = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.concat(F.lit(root + "/"), F.array_join(F.slice(parts, F.lit(1), k), "/")))
    return dirs.filter(F.col("dir").startswith(root + "/")).select("dir", F.explode(chain).alias("folder"))


def siblings(files: DataFrame, most: int = 7) -> DataFrame:
    """id, names: for each file the first files of its folder (by name) with its extension, then the first with another, ``most`` of either.

    The first others of any extension are among the first of the ``most`` + 1 extensions that begin the folder, so a folder needs that many names, however large it is.
    """
    own = files.select("id", "dir", "filename", F.lower("extension").alias("ext"))
    place = F.row_number().over(Window.partitionBy("dir", "ext").orderBy("filename", "id"))
    leading = own.withColumn("place", place).filter(F.col("place") <= most + 1)
    kinds = leading.groupBy("dir", "ext").agg(F.array_sort(F.collect_list(F.struct("filename", "id"))).alias("same"))
    turn = F.row_number().over(Window.partitionBy("dir").orderBy(F.col("same")[0]))
    first = kinds.withColumn("turn", turn).filter(F.col("turn") <= most + 1)
    head = first.groupBy("dir").agg(F.array_sort(F.flatten(F.collect_list(F.transform("same", lambda s: F.struct(s["filename"].alias("filename"), s["id"].alias("id"), F.col("ext").alias("ext")))))).alias("head"))
    out = own.join(kinds, ["dir", "ext"]).join(head, "dir")
    same = F.slice(F.filter("same", lambda s: s["id"] != F.col("id")), 1, most)
    others = F.slice(F.filter("head", lambda s: s["ext"] != F.col("ext")), 1, most)
    return out.select("id", F.concat(F.transform(same, lambda s: s["filename"]), F.transform(others, lambda s: s["filename"])).alias("names"))


def chunks(files: DataFrame, size: int = 100) -> DataFrame:
    """Adds chunk: each folder's files by id in chunks of ``size``; a folder with many files is numbered in ranges."""
    placed = ranked(files, ["dir"], ["id"], "place")
    return placed.withColumn("chunk", F.floor((F.col("place") - 1) / size).cast("int")).drop("place")


def first_of_folder(files: DataFrame, most: int) -> DataFrame:
    """Adds rank and keeps the first files of each folder: those with tags (ai_tags), then the largest."""
    order = (F.size(F.coalesce("ai_tags", F.array().cast("array<string>"))) == 0, F.desc(F.coalesce("size_bytes", F.lit(0))), "id")
    return files.withColumn("rank", F.row_number().over(Window.partitionBy("dir").orderBy(*order))).filter(F.col("rank") <= most)
