"""URL filters: a sort-merge range join of URLs with nested prefix rules, in built-in functions only.

A canonical key turns a prefix into an interval: hosts with their labels reversed, each label ended by
a dot, so that ``org.example.`` begins the keys of the host and of all its subdomains. Such intervals
nest or are apart, so the rules that hold at a key are those open at the last rule that starts at or
before it. One sweep over the hosts finds the rule hosts a URL lies under, a second one over
(rule host, path) finds the longest path rule of each. A sweep sorts URLs and rules together in ranges;
the stack of open rules travels with the rules, and what is open where a range begins is carried over.

Nulls, ties, odd rows: a null URL or one without ``://`` has an empty host and path. Of several rules
that fit, the one with the longest host and path together decides, among equally long ones that with
the longer host; equal rules with both verdicts block. A rule's null host or path counts as empty; a
rule without verdict or with a slash in its host fits nothing. Every row of the input gives a row,
repeated and null ids included; an empty table gives none. Further columns are dropped, whatever their
names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from filequarry.llm.common import written

#: Rules that one step of the sweep over rules takes together.
BLOCK = 256


def _lower(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def host_of(url: Column) -> Column:
    """What follows the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased."""
    return F.coalesce(_lower(F.regexp_extract(_after_scheme(url), "^[^/?#]*", 0)), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(_after_scheme(url), "^[^/?#]*([^?#]*)", 1), F.lit(""))


def _after_scheme(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substr(url, at + 3))


def host_key(host: Column) -> Column:
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.")), "."), F.lit("."))


def judge(pages: DataFrame, rules: DataFrame, default: str = "allow") -> DataFrame:
    """page_id, host, path, rule, verdict of each row of ``pages`` (page_id, url).

    ``rules`` (host, path, verdict ``allow`` or ``block``): a rule fits its host and all subdomains
    where the path begins with the rule's. Where none fits, rule is null and the verdict ``default``.
    """
    rules = rules.select(_lower(F.coalesce("host", F.lit(""))).alias("host"), F.coalesce("path", F.lit("")).alias("path"), "verdict")
    rules = rules.filter("verdict IS NOT NULL AND NOT contains(host, '/')").groupBy("host", "path").agg(F.max("verdict").alias("verdict"))
    rules = written(rules.withColumn("host_key", host_key(F.col("host"))), "rules")
    what = F.struct(F.length(F.concat("host", "path")).alias("chars"), F.length("host").alias("host_chars"), F.concat("host", "path").alias("rule"), "verdict")
    hosts = rules.select(F.col("host_key").alias("key"), F.lit(True).alias("what")).distinct()
    paths = rules.select(_path_key(F.col("host_key"), F.col("path")).alias("key"), what.alias("what"))

    urls = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    urls = urls.withColumn("key", host_key(F.col("host"))).withColumn("row", F.monotonically_increasing_id())
    under = sweep(urls, hosts, "row").withColumn("under", F.explode_outer("open.key")).drop("open", "key")
    met = sweep(under.withColumn("key", F.coalesce(_path_key(F.col("under"), F.col("path")), F.lit(""))), paths, "row")
    best = met.groupBy("row").agg(
        F.first("page_id").alias("page_id"), F.first("host").alias("host"), F.first("path").alias("path"), F.max(F.try_element_at("open", F.lit(-1))["what"]).alias("best")
    )
    return best.select("page_id", "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit(default)).alias("verdict"))


def _path_key(host_key: Column, path: Column) -> Column:
    """No host holds a slash, so the first one ends it."""
    return F.concat(host_key, F.lit("/"), path)


def sweep(points: DataFrame, starts: DataFrame, tie: str) -> DataFrame:
    """``points`` with ``open``: those of ``starts`` whose key their key begins with, shortest first.

    points: a column key, and ``tie`` (long) to divide rows of one key; starts: key (each once), what.
    """
    lines = stacks(starts).select("key", F.lit(-1).cast("long").alias(tie), "stack").unionByName(points, allowMissingColumns=True)
    # written, since a range may begin elsewhere when it is computed again
    lines = written(lines.repartitionByRange("key", tie).withColumn("part", F.spark_partition_id()), "ranges")
    before = Window.partitionBy("part").orderBy("key", tie).rowsBetween(Window.unboundedPreceding, 0)
    here = lines.withColumn("last", F.last("stack", ignorenulls=True).over(before)).filter("stack IS NULL")
    ends = lines.filter("stack IS NOT NULL").groupBy("part").agg(F.max_by("stack", "key").alias("end"))
    parts = lines.select("part").distinct().join(ends, "part", "left")
    # one row for each range
    carried = parts.select("part", F.last("end", ignorenulls=True).over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)).alias("carried"))
    stack = F.coalesce("last", "carried", F.array().cast(lines.schema["stack"].dataType))
    here = here.join(F.broadcast(carried), "part").withColumn("open", F.filter(stack, lambda s: F.startswith(F.col("key"), s["key"])))
    return here.select(*points.columns, "open")


def stacks(starts: DataFrame) -> DataFrame:
    """key, stack: the rules open at each rule (key, what) in the order of keys, itself last.

    The sorted rules are swept in blocks of ``BLOCK``. What is open where a block begins are the rules
    whose key its first key begins with: a join on its prefixes of the lengths that rules have.
    """
    ordered = starts.repartitionByRange("key").sortWithinPartitions("key").withColumn("block", F.expr(f"monotonically_increasing_id() div {BLOCK}"))
    ordered = written(ordered, "ordered")
    # the distinct lengths of keys: k of them need k * k / 2 characters of rules
    lengths = sorted(ordered.agg(F.collect_set(F.length("key"))).first()[0])
    blocks = ordered.groupBy("block").agg(F.sort_array(F.collect_list(F.struct("key", "what"))).alias("items"))
    first = F.col("items")[0]["key"]
    shorter = F.filter(F.array(*map(F.lit, lengths)).cast("array<int>"), lambda n: n < F.length(first))
    prefixes = blocks.select("block", F.explode(F.transform(shorter, lambda n: F.substr(first, F.lit(1), n))).alias("key"))
    opened = prefixes.join(ordered.select("key", "what"), "key").groupBy("block").agg(F.sort_array(F.collect_list(F.struct("key", "what"))).alias("opened"))
    none = F.slice("items", 1, 0)

    def step(held, item):
        stack = F.concat(F.filter(held["stack"], lambda s: F.startswith(item["key"], s["key"])), F.array(item))
        return F.struct(stack.alias("stack"), F.concat(held["out"], F.array(stack)).alias("out"))

    begin = F.struct(F.coalesce("opened", none).alias("stack"), F.slice(F.array(none), 1, 0).alias("out"))
    swept = blocks.join(opened, "block", "left").select(F.explode(F.aggregate("items", begin, step)["out"]).alias("stack"))
    return swept.select(F.element_at("stack", -1)["key"].alias("key"), "stack")
