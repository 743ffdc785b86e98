"""Profiles of folders (what lies in them, in counts and samples) and the folder tree as text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from filequarry.functions import paths, text
from filequarry.operators.folders import lowered_tags, unfit
from filequarry.operators.scratch import ranked, saved

# How much of each kind a profile keeps, and the punctuation that doesn't belong to a word.
MOST = {"tag": 8, "word": 5, "sample": 5}
TAGS_OF_FILE, WORDS_OF_FILE, SHORTEST_WORD = 5, 10, 4
PUNCTUATION = ".,;:!?\"'()[]"
# End of fixed values.
#: Names of child folders that a profile lists; n_children counts them all.
CHILDREN = 8
#: Files that don't fit, shown below a folder and below the root.
UNFIT, UNFIT_AT_ROOT = 5, 20


def _items(kind: str, items: Column) -> Column:
    return F.transform(items, lambda x, i: F.struct(F.lit(kind).alias("kind"), x.alias("item"), i.alias("pos")))


def description_words(description: Column) -> Column:
    """The first ten words in lower case, their outer punctuation cut off, those of four letters or more; none of a null."""
    words = F.filter(F.split(F.lower(F.coalesce(description, F.lit(""))), r"(?U)\s+"), lambda w: w != "")
    return F.filter(F.transform(F.slice(words, 1, WORDS_OF_FILE), lambda w: F.btrim(w, F.lit(PUNCTUATION))), lambda w: F.length(w) >= SHORTEST_WORD)


def children(dirs: DataFrame) -> DataFrame:
    """dir, child: each folder of ``dirs`` (dir, distinct) with the names of those of them that lie right in it."""
    inner = dirs.filter(F.col("dir").contains("/")).select(paths.parent(F.col("dir")).alias("dir"), paths.name(F.col("dir")).alias("child"))
    return dirs.select("dir").join(inner, "dir")


def profiles(files: DataFrame) -> DataFrame:
    """dir, n, bytes, categories, tags, words, samples, children, n_children of each folder with files.

    Skipped files don't count. ``categories`` (item, n) has the most frequent first; ``tags`` holds the eight most
    frequent of each file's first five, ``words`` the five most frequent of descriptions, ``samples`` the first five
    names. Order is by id, then by place in the file; it decides ties. Null sizes are 0, null tags and words fall out.

    Categories, tags and words are counted together in one shuffle, whose keys split large folders by item. Ranks are
    limited before their shuffle (Spark's group limit), so of a folder at most a few rows for each task come together.
    """
    seen = lowered_tags(files.filter("status IS NULL OR status <> 'skipped'"))
    said = F.concat(_items("category", F.array("category")), _items("tag", F.slice("tags", 1, TAGS_OF_FILE)), _items("word", description_words(F.col("ai_description"))))
    each = seen.select("dir", "id", F.coalesce("size_bytes", F.lit(0)).alias("size"), F.explode(said).alias("s")).filter("s.item IS NOT NULL")
    counted = each.groupBy("dir", "s.kind", "s.item").agg(F.count("*").alias("n"), F.sum("size").alias("bytes"), F.min(F.struct("id", "s.pos")).alias("first"))
    by = Window.partitionBy("dir", "kind").orderBy(F.desc("n"), "first", "item")
    whole = counted.filter("kind = 'category'").withColumn("place", F.row_number().over(by))
    top = counted.filter("kind <> 'category'").withColumn("place", F.row_number().over(by)).filter(F.col("place") <= max(MOST.values()))
    name = F.coalesce("filename", paths.name(F.col("path")))
    first = F.row_number().over(Window.partitionBy("dir").orderBy("id", name))
    samples = seen.select("dir", F.lit("sample").alias("kind"), name.alias("item"), first.alias("place")).filter(F.col("place") <= MOST["sample"])
    inner = children(seen.select("dir").distinct())
    listed = inner.withColumn("place", F.row_number().over(Window.partitionBy("dir").orderBy("child"))).filter(F.col("place") <= CHILDREN)
    count = inner.groupBy("dir").agg(F.count("*").alias("n"))
    parts = whole.unionByName(top).drop("first")
    for more in (samples, listed.select("dir", F.lit("child").alias("kind"), F.col("child").alias("item"), "place"), count.select("dir", F.lit("children").alias("kind"), "n")):
        parts = parts.unionByName(more, allowMissingColumns=True)

    def of(kind: str, most: int | None = None) -> Column:
        mine = (F.col("kind") == kind) & (F.col("place") <= most) if most else F.col("kind") == kind
        return F.transform(F.array_sort(F.collect_list(F.when(mine, F.struct("place", "item", "n")))), lambda x: F.struct(x["item"].alias("item"), x["n"].alias("n")))

    def names(kind: str, most: int) -> Column:
        return F.transform(of(kind, most), lambda x: x["item"])

    total = lambda column: F.sum(F.when(F.col("kind") == "category", F.col(column)))
    return parts.groupBy("dir").agg(
        total("n").alias("n"), total("bytes").alias("bytes"), of("category").alias("categories"), names("tag", MOST["tag"]).alias("tags"), names("word", MOST["word"]).alias("words"),
        names("sample", MOST["sample"]).alias("samples"), names("child", CHILDREN).alias("children"), F.coalesce(F.max(F.when(F.col("kind") == "children", F.col("n"))), F.lit(0).cast("long")).alias("n_children"),
    )


def _relative(root: str) -> Column:
    d = F.col("dir")
    return F.when(d == root, "(root)").when(d.startswith(root.rstrip("/") + "/"), F.substring(d, F.lit(len(root.rstrip("/")) + 2), F.length(d))).otherwise(d)


def tree(files: DataFrame, root: str) -> DataFrame:
    """place, dir, text: a line for each folder, by path, with lines of the files that don't fit below it.

    Shares are cut to whole percents. A folder's text is bounded; ``place`` runs through all folders, numbered in ranges.
    """
    # The wording of the lines.
    bar, at_root, other_tags = "  |  ", "loose file at archive root — needs subfolder assignment", "tags unrelated to folder theme"
    # End of fixed values.
    profile = saved(profiles(files), "profiles")
    kept = files.filter("status IS NULL OR status <> 'skipped'")

    def part(label: str, items: Column, most: int) -> Column:
        return F.when(F.size(items) > 0, F.concat(F.lit(bar + label), F.array_join(F.slice(items, 1, most), ", "))).otherwise("")

    shares = F.transform("categories", lambda c: F.concat(F.floor(c["n"] / F.col("n") * 100).cast("string"), F.lit("% "), c["item"]))
    line = F.concat(
        F.lit("["), _relative(root), F.lit("]  "), F.col("n").cast("string"), F.lit(" files, "), text.human_size(F.col("bytes")), F.lit(bar), F.array_join(shares, ", "),
        part("Tags: ", F.col("tags"), 5), part("Keywords: ", F.col("words"), 3), part("Subfolders: ", F.col("children"), CHILDREN), part("Examples: ", F.col("samples"), 3),
    )
    top = F.col("categories")[0]
    known = profile.select("dir", "n", F.when(top["n"] >= 0.6 * F.col("n"), top["item"]).alias("dominant"), F.when(F.size("tags") > 0, F.col("tags")).alias("theme"))
    odd = unfit(kept.select("id", "dir", "path", "filename", "category", "size_bytes", "ai_tags"), known, root, UNFIT, UNFIT_AT_ROOT)
    why = F.when(F.col("dir") == root, at_root).otherwise(
        F.concat_ws("; ", F.when(F.col("by_category"), F.concat(F.lit("type="), "category", F.lit(" (folder is "), "dominant", F.lit(")"))), F.when(F.col("by_tags"), F.lit(other_tags)))
    )
    tags = F.when(F.size("tags") > 0, F.concat(F.lit(", tags=["), F.array_join(F.slice("tags", 1, TAGS_OF_FILE), ", "), F.lit("]"))).otherwise("")
    shown = F.concat(F.lit("    OUTLIER: "), F.coalesce("filename", paths.name(F.col("path"))), F.lit(" ("), text.human_size(F.coalesce("size_bytes", F.lit(0))), F.lit(", "), "category", tags, F.lit(") — "), why)
    below = odd.groupBy("dir").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", shown.alias("shown")))), lambda x: x["shown"]).alias("below"))
    lines = profile.select("dir", line.alias("line")).join(below, "dir", "left")
    return ranked(lines.select("dir", F.concat_ws("\n", "line", "below").alias("text")), [], ["dir"], "place").select("place", "dir", "text")


def tree_texts(lines: DataFrame, folders: int = 200) -> DataFrame:
    """part, text: the tree (place, text) in texts of ``folders`` folders each, in order; only the last has fewer."""
    parts = lines.groupBy(F.floor((F.col("place") - 1) / folders).alias("part"))
    return parts.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "text"))), lambda x: x["text"]), "\n").alias("text"))


def write_tree(lines: DataFrame, path: str) -> None:
    """Writes the tree as text files that hold it in order, one after the other."""
    lines.sort("place").select("text").write.mode("overwrite").text(path)
