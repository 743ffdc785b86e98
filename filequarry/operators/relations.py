"""Groups of related files: numeric prefixes, merging, labels, singletons."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from filequarry.functions import paths, text
from filequarry.operators.scratch import join_hot, ranked, saved

#: What a member may be in its group.
ROLES = ["source", "export", "backup", "version", "sibling"]


def prefix_clusters(files: DataFrame) -> DataFrame:
    """dir, prefix, n, first_id, confidence: files of a folder with the same leading number."""
    led = files.withColumn("prefix", text.loose_prefix(F.col("stem"))).filter("prefix IS NOT NULL")
    return led.groupBy("dir", "prefix").agg(F.count("*").alias("n"), F.min("id").alias("first_id")).filter("n >= 2").withColumn("confidence", F.lit(0.3))


def unique_labels(groups: DataFrame) -> DataFrame:
    """group_id, label: the second and later uses of a label in a session get _2, _3 ..."""
    k = F.col("k")
    numbered = ranked(groups.select("group_id", "session_id", "label"), ["session_id", "label"], ["group_id"], "k")
    return numbered.select("group_id", "session_id", F.when(k > 1, F.concat_ws("_", "label", k)).otherwise(F.col("label")).alias("label"))


def singletons(files: DataFrame, members: DataFrame) -> DataFrame:
    """Files in no group."""
    return files.join(members.select(F.col("file_id").alias("id")), "id", "left_anti")


def valid_groups(responses: DataFrame, known: DataFrame) -> DataFrame:
    """response_id, label, reason, members (filename, role) of the groups in answers of a model that hold up.

    responses: response_id, groups (array of label, reason, members: array of filename, role), one answer a row.
    known: response_id, filename of the files that were asked about. Members with other names and repeats fall out, unknown roles are
    siblings, a file goes with the first group that holds it, groups left with fewer than two members fall
    out and free their files. An answer is one row already, so its groups are settled in order within the row.
    """
    each = responses.select("response_id", F.posexplode("groups").alias("place", "g"))
    members = each.select("response_id", "place", F.posexplode("g.members").alias("at", "m")).select("response_id", "place", "at", "m.filename", F.lower(F.coalesce("m.role", F.lit("sibling"))).alias("role"))
    found = members.join(known.select("response_id", "filename"), ["response_id", "filename"], "left_semi")
    role = F.when(F.col("role").isin(ROLES), F.col("role")).otherwise("sibling")
    once = found.groupBy("response_id", "place", "filename").agg(F.min(F.struct("at", role.alias("role"))).alias("first"))
    whole = once.groupBy("response_id", "place").agg(F.array_sort(F.collect_list(F.struct("first.at", "filename", "first.role"))).alias("members")).filter(F.size("members") >= 2)
    answers = whole.groupBy("response_id").agg(F.array_sort(F.collect_list(F.struct("place", "members"))).alias("groups"))

    def settle(state: Column, group: Column) -> Column:
        left = F.filter(group["members"], lambda m: ~F.array_contains(state["taken"], m["filename"]))
        counts = F.size(left) >= 2
        taken = F.when(counts, F.concat(state["taken"], F.transform(left, lambda m: m["filename"]))).otherwise(state["taken"])
        kept = F.when(counts, F.concat(state["kept"], F.array(F.struct(group["place"].alias("place"), left.alias("members"))))).otherwise(state["kept"])
        return F.struct(taken.alias("taken"), kept.alias("kept"))

    start = F.struct(F.array().cast("array<string>").alias("taken"), F.array().cast("array<struct<place:int,members:array<struct<at:int,filename:string,role:string>>>>").alias("kept"))
    settled = answers.select("response_id", F.explode(F.aggregate("groups", start, settle)["kept"]).alias("k")).select("response_id", "k.place", "k.members")
    said = each.select("response_id", "place", text.label_slug(F.coalesce("g.label", F.lit("group"))).alias("label"), F.substring(text.stripped(F.coalesce("g.reason", F.lit(""))), 1, 500).alias("reason"))
    return settled.join(said, ["response_id", "place"]).select("response_id", "place", "label", "reason", F.transform("members", lambda m: F.struct(m["filename"].alias("filename"), m["role"].alias("role"))).alias("members"))


def merge_by_prefix(members: DataFrame) -> DataFrame:
    """prefix, groups, n: groups (group_id, file_id, stem) whose numbered members agree on one prefix, merged."""
    led = members.withColumn("prefix", text.loose_prefix(F.col("stem")))
    own = led.groupBy("group_id").agg(F.count("prefix").alias("led"), F.min("prefix").alias("prefix"), F.max("prefix").alias("other"))
    own = own.filter("led >= 2 AND prefix = other").select("group_id", "prefix")
    return led.drop("prefix").join(own, "group_id").groupBy("prefix").agg(F.countDistinct("group_id").alias("groups"), F.countDistinct("file_id").alias("n"))


def merged_groups(groups: DataFrame, members: DataFrame, longest: int = 500) -> tuple[DataFrame, DataFrame]:
    """Groups of a session whose numbered members agree on one prefix, as one; the others as they are.

    groups: session_id, group_id (their order), label, reason, confidence. members: session_id, group_id, place (their
    order), filename, role. Returns groups (session_id, group_no, group_id, label, reason, confidence, n) and
    members (session_id, group_no, place, filename, role), both numbered from 1. A merged group has the
    label of its primary, the one with a source, else the most members, else the first; the members and reasons of
    the others follow in that order, reasons up to ``longest`` characters. Of equal filenames in a group the first stays.
    """
    named = members.withColumn("prefix", text.loose_prefix(paths.stem(F.col("filename"))))
    facts = named.groupBy("session_id", "group_id").agg(F.count("*").alias("n"), F.max(F.coalesce(F.col("role") == "source", F.lit(False))).alias("source"), F.count("prefix").alias("led"), F.min("prefix").alias("prefix"), F.max("prefix").alias("other"))
    shared = F.when((F.col("led") >= 2) & (F.col("prefix") == F.col("other")), F.col("prefix"))
    rank = F.struct((~F.col("source")).alias("late"), (-F.col("n")).alias("few"), "group_id")
    own = saved(groups.join(facts, ["session_id", "group_id"], "left").fillna({"n": 0, "source": False}).select(*groups.columns, shared.alias("prefix"), rank.alias("rank")), "groups")
    first = saved(own.filter("prefix IS NOT NULL").groupBy("session_id", "prefix").agg(F.min("rank").alias("first"), F.count("*").alias("groups")), "primaries")
    led = join_hot(own.filter("prefix IS NOT NULL"), first, ["session_id", "prefix"], "groups").withColumn("primary", F.col("first.group_id"))
    joined = led.select(*own.columns, "primary").unionByName(own.filter("prefix IS NULL").withColumn("primary", F.col("group_id")))
    joined = saved(joined, "joined")
    numbers = ranked(joined.filter("primary = group_id").select("session_id", "primary"), ["session_id"], ["primary"], "group_no")
    joined = saved(joined.join(numbers, ["session_id", "primary"]), "numbered")

    order = F.struct((F.col("primary") != F.col("group_id")).alias("later"), "rank")
    placed = members.join(joined.select("session_id", "group_id", "group_no", order.alias("order")), ["session_id", "group_id"])
    once = placed.groupBy("session_id", "group_no", "filename").agg(F.min(F.struct("order", "place", "role")).alias("m"))
    once = ranked(once.select("session_id", "group_no", "filename", "m.order", F.col("m.place").alias("was"), "m.role"), ["session_id", "group_no"], ["order", "was", "filename"], "place")
    once = saved(once.select("session_id", "group_no", "place", "filename", "role"), "members")

    # a reason takes four characters at least, so no more of them than this are ever seen
    told = joined.filter("primary = group_id OR reason <> ''").select("session_id", "group_no", order.alias("order"), F.coalesce("reason", F.lit("")).alias("reason"))
    told = ranked(told, ["session_id", "group_no"], ["order"], "k").filter(F.col("k") <= longest // 4 + 2)
    told = told.groupBy("session_id", "group_no").agg(F.array_sort(F.collect_list(F.struct("k", "reason"))).alias("told"))
    sizes = once.groupBy("session_id", "group_no").agg(F.count("*").alias("n"))
    whole = F.array_join("told.reason", " | ")
    reason = F.when(F.size("told") == 1, F.col("told")[0]["reason"]).otherwise(F.substring(F.btrim(whole, F.lit(" |")), 1, longest))
    out = joined.filter("primary = group_id").join(told, ["session_id", "group_no"]).join(sizes, ["session_id", "group_no"], "left")
    return out.select("session_id", "group_no", "group_id", "label", reason.alias("reason"), "confidence", F.coalesce("n", F.lit(0)).alias("n")), once


def link_singletons(alone: DataFrame, groups: DataFrame, least: float = 0.5) -> DataFrame:
    """id, session_id, group_id, role: singletons (id, session_id, stem) linked to the first group of their session whose label
    holds the number their stem begins with, or begins with the stem's first word of four letters or more.

    groups: session_id, group_id (their order), label, confidence (``least`` or more). A label offers the parts of
    its numbers and the beginnings of its first letters as keys, each with the first group that has it, so a
    singleton meets one row for its number and one for its word. Words end where letters, digits and underscores do.
    """
    low = F.lower(F.col("label"))
    cut = lambda run, begins: F.flatten(F.transform(begins, lambda i: F.transform(F.sequence(F.lit(1), F.length(run) - i + 1), lambda n: F.substring(run, i, n))))
    numbers = F.flatten(F.transform(F.regexp_extract_all(low, F.lit(r"([0-9]+)"), 1), lambda run: cut(run, F.sequence(F.lit(1), F.length(run)))))
    letters = F.regexp_extract(low, "^[a-z]*", 0)
    words = F.filter(F.when(letters != "", cut(letters, F.array(F.lit(1)))).otherwise(F.array().cast("array<string>")), lambda w: F.length(w) >= 4)
    sure = groups.filter(F.col("confidence") >= least)
    offered = sure.select("session_id", "group_id", F.explode(F.array_distinct(F.concat(numbers, words))).alias("key"))
    offered = offered.groupBy("session_id", "key").agg(F.min("group_id").alias("group_id"))

    stem = F.lower(F.col("stem"))
    word = F.regexp_extract(stem, r"(?<![\p{L}\p{N}_])([a-z]{4,})(?![\p{L}\p{N}_])", 1)
    asked = alone.select("id", "session_id", F.explode(F.array(F.regexp_extract(stem, "^[0-9]+", 0), word)).alias("key")).filter("key <> ''")
    weights = saved(asked.groupBy("session_id", "key").agg(F.count("*").alias("asked")).join(offered, ["session_id", "key"]), "keys")
    met = join_hot(asked, weights, ["session_id", "key"], "asked")
    return met.groupBy("id", "session_id").agg(F.min("group_id").alias("group_id")).withColumn("role", F.lit("sibling"))
