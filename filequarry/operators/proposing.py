"""Names and places proposed for files, each pass a projection and joins over all files at once.

Proposals have file_id, current_value, proposed_value and confidence. Passes that may propose one path
twice go through ``numbered`` (moves) or ``naming.resolve_collisions`` (renames) afterwards.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from filequarry.functions import garbled, paths, text
from filequarry.operators import dedup, folders, naming
from filequarry.operators.scratch import saved


def named(files: DataFrame, root: str) -> DataFrame:
    """``files`` with new_name, null where nothing better than the present name is known.

    files: id, dir, stem, extension, ai_suggested_name, ai_tags (array), ai_description, ai_confidence,
    date_exif, date_modified, date_created. Without a word on the content, a stem that says nothing takes
    its folder's name, and one with untidy characters is cleaned; with an error for a description, or
    no confidence, it is only cleaned. Otherwise the content gives the stem, without what folder and
    root say already, after a date where there is a good one; a file of a numbered series keeps its
    series' name and number instead of the date.
    """
    stem, parent = F.col("stem"), F.element_at(F.split("dir", "/"), -1)
    ext = F.lower("extension")
    no_tags = F.col("ai_tags").isNull() | (F.size("ai_tags") == 0)
    silent = (F.coalesce("ai_description", F.lit("")) == "") & no_tags
    tidy = F.when(text.needs_hygiene(stem), F.concat(text.hygienic(stem), ext))
    failed = F.coalesce(text.failed_description(F.col("ai_description")), F.lit(False)) | F.coalesce(F.col("ai_confidence") == 0, F.lit(False))

    content = text.content_stem(F.col("ai_suggested_name"), F.when(~no_tags, F.col("ai_tags")), F.nullif("ai_description", F.lit("")))
    said = text.dedupe_words(text.strip_echo(F.col("said"), parent, F.element_at(F.split(F.lit(root), "/"), -1)))
    good = paths.meaningful_date(F.col("date_exif"), F.col("date_modified"), F.col("date_created"))
    date = F.when(good, F.coalesce("date_exif", "date_modified"))
    day = F.when(ext.isin(text.TIMED), paths.date_prefix(date, True)).when(ext.isin(text.DATED), paths.date_prefix(date))
    dated = F.concat_ws("_", F.nullif(day, F.lit("")), "said")
    number = F.regexp_replace("digits", "^0+(?=.)", "")
    padded = F.when(F.length(number) >= F.col("width"), number).otherwise(F.lpad(number, F.col("width"), F.lit("0")))
    in_series = F.concat(F.col("base"), F.col("sep"), padded, F.lit("_"), F.col("said"))
    whole = F.regexp_replace(F.regexp_replace(F.coalesce(in_series, dated), "_+", "_"), "^_+|_+$", "")

    width = F.max(F.when(F.col("digits").startswith("0") & (F.length("digits") > 1), F.length("digits")).otherwise(1))
    series = naming.series_members(files)
    widths = series.groupBy("dir", "base", "sep").agg(width.cast("int").alias("width"))
    series = series.join(widths, ["dir", "base", "sep"]).select("id", "base", "sep", "digits", "width")
    useful = F.when(text.useless(stem), F.concat(text.folder_context(parent, stem, F.col("extension")), ext))
    name = F.when(silent, F.coalesce(useful, tidy)).when(failed | F.col("said").isNull(), tidy).otherwise(F.concat(text.dedupe_words(whole), ext))
    # columns of their own, so that each is worked out once
    return files.withColumn("said", content).withColumn("said", said).join(series, "id", "left").withColumn("new_name", name).drop("said", "base", "sep", "digits", "width")


def rename_proposals(files: DataFrame, renamed: DataFrame, root: str) -> DataFrame:
    """One rename for each analysed file whose new name differs and that has none (file_id) yet, its number prefix kept."""
    own = named(files, root).filter("status = 'analyzed' AND new_name IS NOT NULL")
    bare = F.substring("new_name", F.lit(1), F.length("new_name") - F.length("extension"))
    final = F.concat(text.ensure_prefix(bare, F.col("stem")), F.lower("extension"))
    fresh = own.withColumn("final", final).filter("final <> filename").join(renamed.select(F.col("file_id").alias("id")), "id", "left_anti")
    sure = F.when(F.coalesce("ai_confidence", F.lit(0.0)) == 0, 0.5).otherwise(F.col("ai_confidence"))
    return _proposals(fresh, F.concat("dir", F.lit("/"), "final"), sure)


def useless_renames(files: DataFrame, renamed: DataFrame) -> DataFrame:
    """Files without a rename whose stem says nothing, named after their folder."""
    parent = F.element_at(F.split("dir", "/"), -1)
    name = F.concat(text.folder_context(parent, F.col("stem"), F.col("extension")), F.lower("extension"))
    rest = files.join(renamed.select(F.col("file_id").alias("id")), "id", "left_anti").filter(text.useless(F.col("stem")))
    return _proposals(rest.withColumn("name", name).filter(~F.col("name").eqNullSafe(F.col("filename")) & F.col("name").isNotNull()), F.concat("dir", F.lit("/"), "name"), F.lit(0.6))


def sibling_renames(files: DataFrame, renames: DataFrame) -> DataFrame:
    """Files without a rename that have a renamed file's stem (any case) in its folder take its new stem.

    renames: file_id, proposed_value. Of several the file with the least id counts.
    """
    primaries = files.join(renames.select(F.col("file_id").alias("id"), "proposed_value"), "id")
    first = primaries.groupBy("dir", F.lower("stem").alias("s")).agg(F.min_by("proposed_value", "id").alias("of"))
    rest = files.join(renames.select(F.col("file_id").alias("id")), "id", "left_anti").withColumn("s", F.lower("stem")).join(first, ["dir", "s"])
    target = F.concat("dir", F.lit("/"), paths.stem(F.col("of")), "extension")
    return _proposals(rest.withColumn("target", target).filter("target <> path"), F.col("target"), F.lit(0.6))


def group_renames(members: DataFrame, files: DataFrame, renames: DataFrame) -> DataFrame:
    """Members of a group without a rename take the stem of the group's best renamed member: the source, else
    the surest, else the first by name. Roles other than source and sibling are put behind it.

    members: group_id, file_id, role, group_confidence; groups below 0.5 are left alone, and of several
    groups of a file the first counts. renames: file_id, proposed_value, confidence.
    """
    best = renames.groupBy("file_id").agg(F.max_by(F.struct("proposed_value", "confidence"), F.coalesce("confidence", F.lit(0.0))).alias("r"))
    sure = members.filter("group_confidence >= 0.5").join(files.select(F.col("id").alias("file_id"), "path", "filename", "extension"), "file_id")
    known = sure.join(best, "file_id", "left")
    rank = F.struct(F.when(F.col("role") == "source", 0).otherwise(1), -F.coalesce("r.confidence", F.lit(0.0)), "filename", "file_id")
    source = known.filter("r IS NOT NULL").groupBy("group_id").agg(F.min_by("r.proposed_value", rank).alias("of"))
    stem = F.regexp_replace(paths.stem(F.col("of")), r"^(.+)_\d+$", "$1")
    behind = F.when(F.col("role").isin("source", "sibling"), "").otherwise(F.concat(F.lit("_"), "role"))
    wanted = known.filter("r IS NULL").join(source, "group_id").withColumn("name", F.concat(stem, behind, "extension")).filter((stem != "") & (F.col("name") != F.col("filename")))
    first = wanted.groupBy("file_id").agg(F.min_by(F.struct("path", "name"), "group_id").alias("w"))
    return first.select("file_id", F.col("w.path").alias("current_value"), F.concat(paths.parent(F.col("w.path")), F.lit("/"), "w.name").alias("proposed_value"), F.lit(0.55).alias("confidence"))


def cluster_moves(members: DataFrame, files: DataFrame, renames: DataFrame, moved: DataFrame) -> DataFrame:
    """Moves of the members of groups with one common folder into ``<folder>/<label>/``, under their new names.

    members: group_id, label, group_confidence, file_id; groups below 0.5 or of fewer than two files are left
    alone, as are files with a move (file_id). A file of several groups goes with the first.
    """
    own = members.filter("group_confidence >= 0.5").join(files.select(F.col("id").alias("file_id"), "dir", "path", "filename"), "file_id")
    whole = own.groupBy("group_id").agg(F.count("*").alias("n"), F.min("dir").alias("lo"), F.max("dir").alias("hi")).filter("n >= 2 AND lo = hi").select("group_id")
    named = renames.groupBy("file_id").agg(F.max_by(paths.name(F.col("proposed_value")), "proposed_value").alias("new"))
    rest = own.join(whole, "group_id", "left_semi").join(moved.select("file_id"), "file_id", "left_anti").join(named, "file_id", "left")
    first = rest.groupBy("file_id").agg(F.min_by(F.struct("group_id", "group_confidence", "label", "dir", "path", F.coalesce("new", "filename").alias("name")), "group_id").alias("m")).select("file_id", "m.*")
    out = numbered(first.withColumn("target", F.concat_ws("/", "dir", F.coalesce("label", F.lit("cluster")))), "target", "name", ["group_id", "file_id"])
    return out.select("file_id", F.col("path").alias("current_value"), F.concat_ws("/", "target", "name").alias("proposed_value"), F.col("group_confidence").alias("confidence"))


def numbered(rows: DataFrame, place: str, name: str, order: list[str], first: int = 2) -> DataFrame:
    """``rows`` with ``name`` made unique within ``place``: in ``order``, all but the first of a name get _2, _3 ...

    Repeated while a numbered name meets another; each round is one ranking by name.
    """
    rows = saved(rows, "numbered")
    while not rows.groupBy(place, name).count().filter("count > 1").isEmpty():
        rank = F.row_number().over(Window.partitionBy(place, name).orderBy(*order))
        ext = F.regexp_extract(name, r"^.+(\.[^.]+)$", 1)
        stem = F.substring(name, F.lit(1), F.length(name) - F.length(ext))
        later = F.concat(stem, F.lit("_"), (F.col("_rank") - 2 + first).cast("string"), ext)
        rows = saved(rows.withColumn("_rank", rank).withColumn(name, F.when(F.col("_rank") == 1, F.col(name)).otherwise(later)).drop("_rank"), "numbered")
    return rows


def loose_root_files(files: DataFrame, root: str, moved: DataFrame) -> DataFrame:
    """Moves of files at or below ``root`` into a folder for their category, where two files or more have it.

    files: id, path, filename, category.
    """
    own = files.filter(F.col("path").startswith(root + "/") & (F.col("category") != "other"))
    kinds = own.groupBy("category").agg(F.count("*").alias("n")).filter("n >= 2")
    kinds = kinds.withColumn("label", folders.content_label(F.map_from_arrays(F.array("category"), F.array("n")))).select("category", "label")
    rest = own.join(kinds, "category").join(moved.select(F.col("file_id").alias("id")), "id", "left_anti")
    target = F.concat_ws("/", F.lit(root), "label", "filename")
    return _proposals(rest.filter(target != F.col("path")), target, F.lit(0.55))


def skipped_companions(files: DataFrame, moves: DataFrame) -> DataFrame:
    """Skipped files with the stem of a moved file of their folder follow it."""
    primaries = files.join(moves.select(F.col("file_id").alias("id"), "proposed_value"), "id")
    first = primaries.groupBy("dir", F.lower("stem").alias("s")).agg(F.min_by("proposed_value", "id").alias("of"))
    rest = files.filter("status = 'skipped'").join(moves.select(F.col("file_id").alias("id")), "id", "left_anti")
    rest = rest.withColumn("s", F.lower("stem")).join(first, ["dir", "s"])
    return _proposals(rest, F.concat(paths.parent(F.col("of")), F.lit("/"), "filename"), F.lit(0.6))


def folder_names_from_tags(files: DataFrame, most: int = 3, root: str | None = None) -> DataFrame:
    """dir, name: the folder's most frequent tags, the first met (by file, then place) on ties.

    With ``root`` the tags count for all folders below it that hold the file, however deep.
    """
    tags = files.select("id", "dir", F.posexplode("ai_tags").alias("at", "tag")).withColumn("token", text.tag_token(F.col("tag"))).filter("token IS NOT NULL")
    counted = tags.groupBy("dir", "token").agg(F.count("*").alias("n"), F.min(F.struct("id", "at")).alias("first"))
    if root is not None:
        above = folders.lineage(counted.select("dir").distinct(), root)
        counted = counted.join(above, "dir").groupBy(F.col("folder").alias("dir"), "token").agg(F.sum("n").alias("n"), F.min("first").alias("first"))
    rank = F.row_number().over(Window.partitionBy("dir").orderBy(F.desc("n"), "first"))
    top = counted.withColumn("k", rank).filter(F.col("k") <= most)
    return top.groupBy("dir").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "token"))), lambda t: t["token"]), "_").alias("name"))


def garbled_folders(files: DataFrame, root: str, renamed: DataFrame) -> DataFrame:
    """Renames of folders below ``root`` whose names were read in the wrong encoding, the file of least id for an anchor.

    renamed: current_value of folders that have a rename already.
    """
    own = _folders(files, root).withColumn("was", garbled.recovered(F.col("name")))
    clean = own.withColumn("clean", text.folder_name(F.col("was"))).filter("clean <> '' AND clean <> name")
    fresh = clean.join(renamed.select(F.col("current_value").alias("path")), "path", "left_anti")
    return _proposals(fresh, F.concat(paths.parent(F.col("path")), F.lit("/"), "clean"), F.lit(0.75))


def nonlatin_folders(files: DataFrame, root: str, renamed: DataFrame, trash: str = ".trash") -> DataFrame:
    """Renames of folders below ``root`` whose names hold anything but ASCII letters and digits: after the tags of
    their files, else transliterated (both 0.6), else non_latin_folder_<n>, counted in order of their paths (0.5).

    renamed: current_value of folders with a rename already, in any case. Hidden folders, those beginning with an
    underscore and what lies in the ``trash`` folder stay.
    """
    odd = F.col("name").rlike("[^a-zA-Z0-9]") & F.col("name").rlike(r"[a-zA-Z0-9]|[^\x00-\x7f]") & ~F.col("name").rlike("^[._]") & ~F.col("path").contains(f"/{trash}/")
    known = renamed.select(F.lower(F.regexp_replace("current_value", r"[/\\]+$", "")).alias("key")).distinct()
    own = _folders(files, root).filter(odd).withColumn("key", F.lower("path")).join(known, "key", "left_anti")
    tagged = folder_names_from_tags(files, root=root).select(F.col("dir").alias("path"), F.col("name").alias("tagged"))
    latin = text.transliterate(F.col("name"))
    named = own.join(tagged, "path", "left").withColumn("new", F.coalesce("tagged", F.when((latin != "") & (latin != F.col("name")), latin)))
    named = saved(named.select("id", "path", "name", "new").repartitionByRange(F.split("path", "/")).withColumn("part", F.spark_partition_id()), "folders")
    # numbered within the ranges, after the count of the ranges before: one row a range
    blank = named.filter("new IS NULL")
    ranges = blank.groupBy("part").agg(F.count("*").alias("n"))
    before = ranges.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))
    place = F.row_number().over(Window.partitionBy("part").orderBy(F.split("path", "/")))
    blank = blank.withColumn("place", place).join(before, "part").withColumn("new", F.concat(F.lit("non_latin_folder_"), (F.col("before") + F.col("place")).cast("string")))
    both = named.filter("new IS NOT NULL").select("id", "path", "name", "new", F.lit(0.6).alias("sure")).unionByName(blank.select("id", "path", "name", "new", F.lit(0.5).alias("sure")))
    fresh = both.withColumn("new", text.folder_name(F.col("new"))).filter("new <> '' AND new <> name")
    return _proposals(fresh, F.concat(paths.parent(F.col("path")), F.lit("/"), "new"), F.col("sure"))


def _folders(files: DataFrame, root: str) -> DataFrame:
    """path, name, id (the least of its files) of each folder below ``root`` that holds files, however deep."""
    dirs = files.groupBy("dir").agg(F.min("id").alias("id"))
    own = dirs.join(folders.lineage(dirs.select("dir"), root), "dir").groupBy(F.col("folder").alias("path")).agg(F.min("id").alias("id"))
    return own.withColumn("name", paths.name(F.col("path")))


def _cores(renames: DataFrame) -> DataFrame:
    """``renames`` with place, stem, core (the stem without its first number) and suffix of what they propose."""
    to = F.col("proposed_value")
    own = renames.withColumns({"place": paths.parent(to), "stem": paths.stem(to), "suffix": paths.suffix(to)})
    return own.withColumn("core", F.regexp_replace("stem", r"(?U)^\d+[_.]", ""))


def told_apart(files: DataFrame, renames: DataFrame, least: float = 0.8) -> DataFrame:
    """file_id, proposed_value of pending renames to a stem that is generic, or that another rename of the same folder
    shares or nearly shares (ratio >= ``least``): the number prefix of the file's present name is put first.

    renames: file_id, proposed_value. Each is judged on the renames as given. Names met twice after this
    go to ``naming.resolve_collisions``.
    """
    own = saved(_cores(renames), "cores")
    cores = own.groupBy("place", "core").agg(F.count("*").alias("rows"), F.min("file_id").alias("id"))
    near = dedup.near_names(cores.select("id", F.col("place").alias("block"), F.col("core").alias("text")), least)
    many = own.groupBy("place").agg(F.count("*").alias("all")).filter(F.col("all") >= 2).select("place")
    vague = cores.join(near.withColumn("near", F.lit(True)), "id", "left").filter(F.col("near") | (F.col("rows") > 1) | F.col("core").isin(text.GENERIC_STEMS)).select("place", "core")
    prefix = files.select(F.col("id").alias("file_id"), text.strict_prefix(F.col("stem")).alias("prefix")).filter("prefix IS NOT NULL")
    odd = own.join(vague, ["place", "core"], "left_semi").join(many, "place", "left_semi").join(prefix, "file_id")
    return odd.select("file_id", F.concat("place", F.lit("/"), "prefix", F.lit("_"), "core", "suffix").alias("proposed_value"))


def near_duplicate_proposals(files: DataFrame, renames: DataFrame, least: float = 0.92) -> DataFrame:
    """file_id, keep_id, similarity: pending renames into one folder with the same extension, size and nearly the same stem.

    The later file of a pair (by date_modified, none first; on ties the one of lesser id) is a duplicate of the
    other and loses its rename; of several pairs it is named in, the first by ids counts. Equal names count as pairs
    with the least id of them, so that they aren't all compared with each other.
    """
    kept = files.select(F.col("id").alias("file_id"), "size_bytes", "date_modified")
    own = _cores(renames).join(kept, "file_id").withColumns({"stem": F.lower("stem"), "suffix": F.lower("suffix")})
    own = saved(own.select("file_id", F.struct("place", "suffix", "size_bytes").alias("block"), "stem", "date_modified"), "proposed")
    first = own.groupBy("block", "stem").agg(F.min("file_id").alias("id"), F.min_by("date_modified", "file_id").alias("since"))
    pairs = dedup.name_pairs(first.select("id", "block", F.col("stem").alias("text")), least).filter("a < b")
    since = first.select("id", "since")
    close = pairs.join(since.select(F.col("id").alias("a"), F.col("since").alias("sa")), "a").join(since.select(F.col("id").alias("b"), F.col("since").alias("sb")), "b")
    same = own.join(first, ["block", "stem"]).filter("file_id <> id").select(F.col("id").alias("a"), F.col("file_id").alias("b"), F.lit(1.0).alias("similarity"), F.col("since").alias("sa"), F.col("date_modified").alias("sb"))
    later = F.coalesce(F.col("sb") > F.col("sa"), F.col("sb").isNotNull() & F.col("sa").isNull())
    told = close.unionByName(same).select("a", "b", "similarity", F.when(later, F.col("b")).otherwise(F.col("a")).alias("file_id"), F.when(later, F.col("a")).otherwise(F.col("b")).alias("keep_id"))
    best = F.min_by(F.struct("keep_id", "similarity"), F.struct("a", "b")).alias("best")
    return told.groupBy("file_id").agg(best).select("file_id", "best.keep_id", "best.similarity")


def _proposals(rows: DataFrame, target: Column, confidence: Column) -> DataFrame:
    return rows.select(F.col("id").alias("file_id"), F.col("path").alias("current_value"), target.alias("proposed_value"), confidence.cast("double").alias("confidence"))
