"""Registered queries over the given tables and the SQL each is held against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from filequarry.functions import paths, text
from filequarry.operators import dedup, execution, folders, naming, reads, relations
from filequarry.sources import scan
from filequarry.sources.catalog import FILES_SQL, files, table, with_best_date

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None, uses_files: bool = True, recursive: bool = False):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = (f"WITH {'RECURSIVE ' if recursive else ''}{FILES_SQL} " if uses_files else "") + sql
        return f

    return add


def categorised(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files(spark, sf_dir).withColumn("category", paths.category(F.col("mime_type"), F.col("extension")))


CATEGORY_SQL = "CASE lower(extension) WHEN '.txt' THEN 'document' WHEN '.md' THEN 'document' WHEN '.jpg' THEN 'image' WHEN '.pdf' THEN 'document' WHEN '.mp4' THEN 'video' WHEN '.zip' THEN 'archive' ELSE 'web' END"

# ---------------------------------------------------------------- duplicates

EXACT_SQL = """
SELECT hash_md5, count(*) AS n,
  arg_min(id, (coalesce(date_modified, date_created), -length(path), -size_bytes, id)) AS keep_id,
  CAST(sum(size_bytes) - arg_min(size_bytes, (coalesce(date_modified, date_created), -length(path), -size_bytes, id)) AS BIGINT) AS wasted_bytes
FROM files GROUP BY hash_md5 HAVING count(*) > 1"""


def dated(spark, sf_dir):
    return files(spark, sf_dir).withColumn("date_best", F.col("date_modified"))


@query(EXACT_SQL)
def dup_exact_groups(spark, sf_dir):
    return dedup.exact_groups(dated(spark, sf_dir))


@query(f"SELECT f.hash_md5, f.id AS file_id, g.keep_id, 1.0::DOUBLE AS similarity FROM files f JOIN ({EXACT_SQL}) g ON f.hash_md5 = g.hash_md5")
def dup_keeper(spark, sf_dir):
    return dedup.exact_members(dated(spark, sf_dir))


@query(f"SELECT count(*) AS groups, CAST(sum(n - 1) AS BIGINT) AS duplicates, CAST(sum(wasted_bytes) AS BIGINT) AS wasted_bytes FROM ({EXACT_SQL})")
def dup_summary(spark, sf_dir):
    g = dedup.exact_groups(dated(spark, sf_dir))
    return g.agg(F.count("*").alias("groups"), F.sum(F.col("n") - 1).alias("duplicates"), F.sum("wasted_bytes").alias("wasted_bytes"))


@query(f"""SELECT f.id AS file_id, g.keep_id, 1.0::DOUBLE AS confidence FROM files f JOIN ({EXACT_SQL}) g ON f.hash_md5 = g.hash_md5
WHERE f.id <> g.keep_id AND f.id % 9 <> 0""")
def dup_proposals(spark, sf_dir):
    members = dedup.exact_members(dated(spark, sf_dir)).withColumns({"group_id": F.col("hash_md5"), "kind": F.lit("exact")})
    marked = files(spark, sf_dir).filter("id % 9 = 0").select(F.col("id").alias("file_id"))
    return dedup.duplicate_proposals(members, marked)


@query(f"""SELECT g.hash_md5 AS group_hash, coalesce(o.keep_id, g.keep_id) AS keep_file_id, count(*) AS members, CAST(count(*) FILTER (o.hash_md5 IS NOT NULL AND f.id % 3 <> 0) AS BIGINT) AS known FROM ({EXACT_SQL}) g
LEFT JOIN (SELECT hash_md5, CASE WHEN min(id) % 2 = 0 THEN max(id) END AS keep_id FROM files WHERE id % 3 <> 0 GROUP BY hash_md5 HAVING count(*) > 1) o ON o.hash_md5 = g.hash_md5 JOIN files f ON f.hash_md5 = g.hash_md5 GROUP BY ALL""")
def dup_upsert(spark, sf_dir):
    """Groups known from two thirds of the files, half of them with a keeper, brought up to date with those of all."""
    f = dated(spark, sf_dir)
    kind = F.lit("exact").alias("dupe_type")
    seen = f.filter("id % 3 <> 0").groupBy("hash_md5").agg(F.count("*").alias("n"), F.min("id").alias("lo"), F.max("id").alias("hi")).filter("n > 1")
    old = seen.select(kind, F.col("hash_md5").alias("group_hash"), F.when(F.col("lo") % 2 == 0, F.col("hi")).alias("keep_file_id"))
    new = dedup.exact_groups(f).select(kind, F.col("hash_md5").alias("group_hash"), F.col("keep_id").alias("keep_file_id"))
    members = dedup.exact_members(f).select(kind, F.col("hash_md5").alias("group_hash"), "file_id", "similarity")
    before = members.filter("file_id % 3 <> 0").join(old.select("group_hash"), "group_hash", "left_semi").withColumn("similarity", F.lit(0.5))
    known = scan.upsert_members(before, members)
    sizes = known.groupBy("group_hash").agg(F.count("*").alias("members"), F.count_if(F.col("similarity") == 0.5).alias("known"))
    return scan.upsert_groups(old, new).join(sizes, "group_hash").select("group_hash", "keep_file_id", "members", "known")


SIGNS_SQL = "signs AS (SELECT vec_id AS id, list_aggregate(list_transform(embedding, lambda x: CASE WHEN x > 0 THEN '1' ELSE '0' END), 'string_agg', '') AS bits FROM embeddings)"
#: The vectors at hand have no pairs within the usual 8 bits; 16 shows some.
SIGN_BITS = 16
CLASSES_SQL = "classes AS (SELECT min(id) AS id, bits, count(*) AS n FROM signs GROUP BY bits)"
PAIRS_SQL = f"SELECT x.id AS a, y.id AS b, CAST(hamming(x.bits, y.bits) AS INT) AS distance, x.n AS na, y.n AS nb FROM classes x JOIN classes y ON x.id < y.id AND hamming(x.bits, y.bits) <= {SIGN_BITS}"
COPIES_SQL = "SELECT c.id AS a, s.id AS b, CAST(0 AS INT) AS distance, n AS na, n AS nb FROM classes c JOIN signs s ON s.bits = c.bits AND s.id <> c.id"


def signs(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), dedup.sign_hash(F.col("embedding")).alias("bits"))


@query(f"WITH {SIGNS_SQL}, {CLASSES_SQL} {PAIRS_SQL} UNION ALL {COPIES_SQL}", uses_files=False)
def near_hamming_pairs(spark, sf_dir):
    """Between different hashes, each with its least id and how many rows have it; at distance 0 the other rows of a hash."""
    own = signs(spark, sf_dir).filter("bits IS NOT NULL")
    return dedup.with_copies(dedup.hamming_pairs(own, SIGN_BITS), own, ["bits"], distance=F.lit(0))


@query(f"WITH {SIGNS_SQL} SELECT x.id AS a, y.id AS b, CAST(hamming(x.bits, y.bits) AS INT) AS distance FROM signs x JOIN signs y ON x.id < y.id AND hamming(x.bits, y.bits) <= {SIGN_BITS}", uses_files=False)
def near_hamming_row_pairs(spark, sf_dir):
    """Every pair of rows, copies and rows alike to copies too, which ``near_hamming_pairs`` tells by classes and their members."""
    own = signs(spark, sf_dir).filter("bits IS NOT NULL")
    return dedup.row_pairs(dedup.hamming_pairs(own, SIGN_BITS), dedup.classes(own, "bits"), distance=F.lit(0))


GREEDY_SQL = """
nodes AS (SELECT id, row_number() OVER (ORDER BY id) AS k, (SELECT coalesce(list(a), []) FROM edges WHERE b = id) AS smaller
  FROM (SELECT a AS id FROM edges UNION SELECT b FROM edges)),
step AS (SELECT CAST(0 AS BIGINT) AS k, CAST([] AS BIGINT[]) AS anchors UNION ALL
  SELECT step.k + 1, CASE WHEN list_has_any(anchors, smaller) THEN anchors ELSE list_append(anchors, id) END FROM step JOIN nodes ON nodes.k = step.k + 1),
found AS (SELECT unnest(anchors) AS anchor FROM (SELECT anchors FROM step ORDER BY k DESC LIMIT 1))
SELECT min(anchor) AS anchor, e.b AS member FROM edges e JOIN found ON found.anchor = e.a WHERE e.b NOT IN (SELECT anchor FROM found) GROUP BY e.b"""


@query(f"WITH RECURSIVE {SIGNS_SQL}, edges AS (SELECT x.id AS a, y.id AS b FROM signs x JOIN signs y ON x.id < y.id AND hamming(x.bits, y.bits) <= {SIGN_BITS}), {GREEDY_SQL}", uses_files=False)
def near_hamming_groups(spark, sf_dir):
    own = signs(spark, sf_dir).filter("bits IS NOT NULL")
    return dedup.class_groups(dedup.classes(own, "bits"), dedup.hamming_pairs(own, SIGN_BITS))


@query("""
, sets AS (SELECT dir, list_sort(list_distinct(ai_tags)) AS t, min(id) AS id, count(*) AS n FROM files WHERE len(ai_tags) > 0 GROUP BY 1, 2)
SELECT a.id AS a, b.id AS b, len(list_intersect(a.t, b.t)) / len(list_distinct(list_concat(a.t, b.t)))::DOUBLE AS jaccard, a.n AS na, b.n AS nb FROM sets a JOIN sets b ON a.dir = b.dir AND a.id < b.id
WHERE len(list_intersect(a.t, b.t)) * 2 >= len(list_distinct(list_concat(a.t, b.t)))
UNION ALL SELECT s.id, f.id, 1.0::DOUBLE, n, n FROM sets s JOIN files f ON f.dir = s.dir AND list_sort(list_distinct(ai_tags)) = t AND f.id <> s.id""")
def tag_jaccard_pairs(spark, sf_dir):
    """Between different sets of tags of a folder, each with its least id and how many files have it; at 1 the other files of a set."""
    own = dedup.tag_sets(files(spark, sf_dir).select("id", F.col("dir").alias("block"), F.col("ai_tags").alias("tags")))
    return dedup.with_copies(dedup.tag_pairs(own, 0.5), own, ["block", "tags"], jaccard=F.lit(1.0))


@query("""
, sizes AS (SELECT dir, size_bytes AS s, min(id) AS id, count(*) AS n FROM files GROUP BY 1, 2)
SELECT a.id AS a, b.id AS b, a.s AS sa, b.s AS sb, a.n AS na, b.n AS nb FROM sizes a JOIN sizes b ON a.dir = b.dir AND a.id < b.id WHERE abs(a.s - b.s) <= 0.1 * greatest(a.s, b.s)
UNION ALL SELECT c.id, f.id, s, s, n, n FROM sizes c JOIN files f ON f.dir = c.dir AND size_bytes = s AND f.id <> c.id""")
def text_len_band_pairs(spark, sf_dir):
    """Between different sizes in a folder, each with its least id and how many files have it; with sa = sb the other files of a size."""
    own = files(spark, sf_dir).select("id", F.col("dir").alias("block"), F.col("size_bytes").alias("size"))
    return dedup.with_copies(dedup.length_band_pairs(own), own, ["block", "size"], sa=F.col("size"), sb=F.col("size"))


@query()
def text_near_groups(spark, sf_dir):
    rows = files(spark, sf_dir).filter("size_bytes > 0 AND size_bytes <= 200000").select("id", F.col("dir").alias("block"), "text")
    return dedup.text_near_groups(rows)


@query()
def semantic_groups(spark, sf_dir):
    rows = files(spark, sf_dir).filter("status = 'analyzed'").select("id", F.substring_index("mime_type", "/", 1).alias("family"), F.concat_ws(" ", "ai_tags").alias("description"), F.col("ai_tags").alias("tags"))
    return dedup.semantic_groups(rows)


# ---------------------------------------------------------------- reads


@query("SELECT count(*) AS files, CAST(coalesce(sum(size_bytes), 0) AS BIGINT) AS bytes FROM files")
def stats_total(spark, sf_dir):
    return files(spark, sf_dir).agg(F.count("*").alias("files"), F.coalesce(F.sum("size_bytes"), F.lit(0)).alias("bytes"))


@query("SELECT status, count(*) AS n FROM files GROUP BY status")
def stats_by_status(spark, sf_dir):
    return files(spark, sf_dir).groupBy("status").agg(F.count("*").alias("n"))


@query("SELECT extension, count(*) AS n FROM files GROUP BY extension ORDER BY n DESC, extension LIMIT 15")
def stats_top_ext(spark, sf_dir):
    return reads.top_extensions(files(spark, sf_dir))


@query("SELECT CASE WHEN contains(mime_type, '/') THEN split_part(mime_type, '/', 1) ELSE 'unknown' END AS family, count(*) AS n FROM files GROUP BY 1")
def stats_by_mime_family(spark, sf_dir):
    return reads.mime_families(files(spark, sf_dir))


@query("""
SELECT s.session_id, s.files, s.bytes, coalesce(p.n, 0) AS proposals, coalesce(g.n, 0) AS groups
FROM (SELECT session_id, count(*) AS files, CAST(sum(size_bytes) AS BIGINT) AS bytes FROM files GROUP BY 1) s
LEFT JOIN (SELECT session_id, count(*) AS n FROM files WHERE id % 8 IN (2, 4, 7) GROUP BY 1) p ON p.session_id = s.session_id
LEFT JOIN (SELECT session_id, count(*) AS n FROM (SELECT session_id, hash_md5 FROM files GROUP BY 1, 2 HAVING count(*) > 1) GROUP BY 1) g ON g.session_id = s.session_id""")
def session_rollup(spark, sf_dir):
    f = files(spark, sf_dir)
    groups = f.groupBy("session_id", "hash_md5").count().filter("count > 1")
    return reads.session_rollup(f, f.filter(text.needs_hygiene(F.col("stem"))), groups)


@query("SELECT id, filename, size_bytes FROM files WHERE status = 'analyzed' ORDER BY size_bytes DESC, id OFFSET 20 LIMIT 50")
def files_page(spark, sf_dir):
    return reads.page(reads.with_status(files(spark, sf_dir), "analyzed"), "size_bytes", 20, 50, descending=True).select("id", "filename", "size_bytes")


@query("SELECT id, filename FROM files WHERE filename ILIKE '%REPORT\\_%' ESCAPE '\\' OR path ILIKE '%REPORT\\_%' ESCAPE '\\'")
def files_search(spark, sf_dir):
    return reads.search(files(spark, sf_dir), "Report_", "filename", "path").select("id", "filename")


PROPOSALS_SQL = """proposals AS (SELECT o_orderkey AS id, o_custkey AS file_id,
  CASE o_orderkey % 5 WHEN 0 THEN 'rename_folder' WHEN 1 THEN 'rename' WHEN 2 THEN 'move' WHEN 3 THEN 'add_tags' ELSE 'mark_duplicate' END AS proposal_type,
  CASE o_orderstatus WHEN 'O' THEN 'pending' WHEN 'F' THEN 'approved' ELSE 'modified' END AS status,
  CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE (o_orderkey % 10) / 10.0::DOUBLE END AS confidence,
  repeat('/d', CAST(o_custkey % 6 AS INT)) || '/x' AS current_value, o_orderpriority AS reasoning, o_totalprice AS price FROM orders)"""


def proposals(spark, sf_dir):
    """Orders in the role of proposals."""
    return table(spark, sf_dir, "orders").selectExpr(
        "o_orderkey AS id", "o_custkey AS file_id",
        "element_at(array('rename_folder', 'rename', 'move', 'add_tags', 'mark_duplicate'), cast(o_orderkey % 5 AS int) + 1) AS proposal_type",
        "CASE o_orderstatus WHEN 'O' THEN 'pending' WHEN 'F' THEN 'approved' ELSE 'modified' END AS status",
        "CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE (o_orderkey % 10) / 10.0D END AS confidence",
        "concat(repeat('/d', cast(o_custkey % 6 AS int)), '/x') AS current_value", "o_orderpriority AS reasoning", "o_totalprice AS price",
    )


@query(f"WITH {PROPOSALS_SQL} SELECT p.id, c.c_name, p.confidence FROM proposals p JOIN customer c ON c.c_custkey = p.file_id WHERE p.status = 'pending' AND p.confidence >= 0.5 ORDER BY p.confidence DESC, p.id LIMIT 100", uses_files=False)
def proposals_page(spark, sf_dir):
    joined = proposals(spark, sf_dir).filter("status = 'pending' AND confidence >= 0.5").join(table(spark, sf_dir, "customer"), F.col("file_id") == F.col("c_custkey"))
    return joined.orderBy(F.desc("confidence"), "id").limit(100).select("id", "c_name", "confidence")


@query(f"WITH {PROPOSALS_SQL} SELECT id, proposal_type, confidence FROM proposals WHERE confidence >= 0.7 OR confidence IS NULL", uses_files=False)
def execute_select(spark, sf_dir):
    return execution.selected(proposals(spark, sf_dir)).select("id", "proposal_type", "confidence")


@query(f"WITH {PROPOSALS_SQL} SELECT id, confidence FROM proposals WHERE status = 'pending' AND NOT (coalesce(confidence, 0) <> 0 AND coalesce(confidence, 0) < 0.6)", uses_files=False)
def preview_gate(spark, sf_dir):
    c = F.coalesce("confidence", F.lit(0.0))
    return proposals(spark, sf_dir).filter((F.col("status") == "pending") & ~((c != 0) & (c < 0.6))).select("id", "confidence")


@query(f"""WITH {PROPOSALS_SQL} SELECT id, proposal_type,
  CASE proposal_type WHEN 'rename_folder' THEN 0 WHEN 'rename' THEN 1 WHEN 'move' THEN 2 ELSE 3 END AS step_group,
  CASE WHEN proposal_type = 'rename_folder' THEN -(length(current_value) - length(replace(current_value, '/', ''))) ELSE 0 END::INT AS step_depth FROM proposals""", uses_files=False)
def execution_order(spark, sf_dir):
    return execution.ordered(proposals(spark, sf_dir)).select("id", "proposal_type", "step_group", "step_depth")


@query(f"WITH {PROPOSALS_SQL} SELECT status, count(*) AS n, CAST(count(confidence) AS BIGINT) AS sure FROM proposals GROUP BY status", uses_files=False)
def proposals_by_status(spark, sf_dir):
    return proposals(spark, sf_dir).groupBy("status").agg(F.count("*").alias("n"), F.count("confidence").alias("sure"))


@query(f"WITH {PROPOSALS_SQL} SELECT file_id, id, confidence FROM (SELECT *, row_number() OVER (PARTITION BY file_id ORDER BY confidence DESC NULLS LAST, id) AS k FROM proposals WHERE proposal_type = 'rename') WHERE k = 1", uses_files=False)
def best_rename(spark, sf_dir):
    p = proposals(spark, sf_dir).filter("proposal_type = 'rename'")
    best = F.max_by(F.struct("id", "confidence"), F.struct(F.coalesce("confidence", F.lit(-1.0)), -F.col("id")))
    return p.groupBy("file_id").agg(best.alias("b")).select("file_id", "b.id", "b.confidence")


@query("SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderkey % 5 = 1)", uses_files=False)
def files_without_rename(spark, sf_dir):
    renamed = proposals(spark, sf_dir).filter("proposal_type = 'rename'").select(F.col("file_id").alias("c_custkey"))
    return table(spark, sf_dir, "customer").join(renamed, "c_custkey", "left_anti").select("c_custkey")


@query("SELECT l_orderkey, l_linenumber, l_quantity FROM (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber) AS k FROM lineitem) WHERE k <= 12", uses_files=False)
def largest_per_folder(spark, sf_dir):
    from pyspark.sql import Window

    rank = F.row_number().over(Window.partitionBy("l_suppkey").orderBy(F.desc("l_extendedprice"), "l_orderkey", "l_linenumber"))
    return table(spark, sf_dir, "lineitem").withColumn("k", rank).filter("k <= 12").select("l_orderkey", "l_linenumber", "l_quantity")


# ---------------------------------------------------------------- folders

SUMMARY_SQL = f"""cats AS (SELECT dir, {CATEGORY_SQL} AS category, count(*) AS c, sum(size_bytes) AS b FROM files GROUP BY 1, 2),
folders AS (SELECT dir, CAST(sum(c) AS BIGINT) AS n, CAST(sum(b) AS BIGINT) AS bytes, max(c) AS most, arg_max(category, (c, category)) AS top FROM cats GROUP BY dir)"""


@query(f", {SUMMARY_SQL} SELECT dir, n, bytes, CASE WHEN most >= 0.6 * n THEN top END AS dominant FROM folders")
def folder_summary(spark, sf_dir):
    return folders.summary(categorised(spark, sf_dir)).drop("categories")


@query(f""", {SUMMARY_SQL}, share AS (SELECT dir, category, c / sum(c) OVER (PARTITION BY dir) AS s FROM cats)
SELECT f.dir, coalesce((SELECT arg_min(l, k) FROM (SELECT CASE category WHEN 'image' THEN 'Images' WHEN 'document' THEN 'Documents' WHEN 'video' THEN 'Videos' WHEN 'web' THEN 'Web_Files' WHEN 'archive' THEN 'Archives' END AS l,
  CASE category WHEN 'image' THEN 1 WHEN 'document' THEN 2 WHEN 'video' THEN 3 WHEN 'web' THEN 4 ELSE 5 END AS k, dir, s FROM share) x WHERE x.dir = f.dir AND x.s >= 0.4),
  CASE WHEN most >= 0.35 * n THEN upper(top[1:1]) || top[2:] || '_Files' ELSE 'Mixed_Content' END) AS label FROM folders f""")
def folder_content_label(spark, sf_dir):
    return folders.summary(categorised(spark, sf_dir)).select("dir", folders.content_label(F.col("categories")).alias("label"))


@query("""SELECT dir, tag, n, rank FROM (SELECT dir, tag, n, row_number() OVER (PARTITION BY dir ORDER BY n DESC, first_id, tag) AS rank FROM (
  SELECT dir, tag, count(*) AS n, min(id) AS first_id FROM (SELECT id, dir, unnest(ai_tags[1:5]) AS tag FROM files) GROUP BY dir, tag)) WHERE rank <= 8""".replace("SELECT dir, tag, n, rank", "SELECT dir, tag, n, CAST(rank AS INT) AS rank"))
def folder_top_tags(spark, sf_dir):
    tags = files(spark, sf_dir).select("id", "dir", F.explode(F.slice("ai_tags", 1, 5)).alias("tag"))
    return folders.top_per_folder(tags, "tag", 8)


@query(f""", {SUMMARY_SQL} SELECT id, dir, category, dominant, CAST(rank AS INT) AS rank FROM (
  SELECT f.id, f.dir, {CATEGORY_SQL} AS category, top AS dominant, row_number() OVER (PARTITION BY f.dir ORDER BY size_bytes DESC, f.id) AS rank
  FROM files f JOIN folders g ON g.dir = f.dir WHERE n >= 4 AND most >= 0.5 * n AND {CATEGORY_SQL} <> top) WHERE rank <= 5""".replace("most >= 0.5", "most >= 0.6"))
def folder_outliers(spark, sf_dir):
    return folders.outliers(categorised(spark, sf_dir))


@query(f""", {SUMMARY_SQL}, tags AS (SELECT id, dir, unnest(ai_tags[1:5]) AS tag FROM files),
ranked AS (SELECT dir, tag, row_number() OVER (PARTITION BY dir ORDER BY count(*) DESC, min(id), tag) AS k FROM tags GROUP BY dir, tag),
themes AS (SELECT dir, list(tag) AS theme FROM ranked WHERE k <= 8 GROUP BY dir),
odd AS (SELECT f.id, f.dir, size_bytes, n, {CATEGORY_SQL} AS category, CASE WHEN most >= 0.6 * n THEN top END AS dominant,
  coalesce(most >= 0.6 * n AND {CATEGORY_SQL} <> top, false) AS by_category, len(ai_tags) > 0 AND coalesce(NOT list_has_any(ai_tags, theme), false) AS by_tags
  FROM files f JOIN folders g ON g.dir = f.dir LEFT JOIN themes t ON t.dir = f.dir)
SELECT id, dir, category, dominant, by_category, by_tags, CAST(rank AS INT) AS rank FROM (
  SELECT *, row_number() OVER (PARTITION BY dir ORDER BY by_category DESC, size_bytes DESC, id) AS rank FROM odd WHERE n >= 4 AND (by_category OR by_tags)) WHERE rank <= 5""")
def folder_misfits(spark, sf_dir):
    """Outliers by category or tags; ``folder_outliers`` is held to SQL of the first kind only."""
    return folders.misfits(categorised(spark, sf_dir), "/corpus")


@query("""SELECT dir, count(*) FILTER (w = 'b') AS before, CAST(greatest(sum(CASE w WHEN 'm' THEN -1 ELSE 1 END), 0) AS BIGINT) AS after FROM (
  SELECT dir, 'b' AS w FROM files UNION ALL SELECT dir, 'm' FROM files WHERE id % 4 = 0 UNION ALL SELECT '/corpus/moved/' || lang, 'p' FROM files WHERE id % 4 = 0) GROUP BY dir""")
def tree_delta(spark, sf_dir):
    f = files(spark, sf_dir)
    moves = f.filter("id % 4 = 0").select(F.col("id").alias("file_id"), F.concat(F.lit("/corpus/moved/"), "lang").alias("to_dir"))
    return folders.tree_delta(f, moves)


@query("""SELECT dir, CAST(depth AS INT) AS depth, count(*) AS n, CAST(sum(size_bytes) AS BIGINT) AS bytes FROM (
  SELECT '/corpus/' || source AS dir, 1 AS depth, size_bytes FROM files UNION ALL SELECT dir, 2, size_bytes FROM files) GROUP BY dir, depth""")
def folder_ancestors(spark, sf_dir):
    return folders.ancestors(files(spark, sf_dir), "/corpus")


# ---------------------------------------------------------------- relations


PREFIX_SQL = r"SELECT dir, regexp_extract(stem, '^(\d+(?:\.\d+)*)', 1) AS prefix, count(*) AS n, min(id) AS first_id, 0.3::DOUBLE AS confidence FROM files WHERE regexp_matches(stem, '^\d') GROUP BY 1, 2 HAVING count(*) >= 2"


@query(PREFIX_SQL)
def prefix_clusters(spark, sf_dir):
    return relations.prefix_clusters(files(spark, sf_dir))


@query("""SELECT id AS group_id, session_id, CASE WHEN k > 1 THEN label || '_' || k ELSE label END AS label FROM (
  SELECT id, session_id, lang || '_' || (id % 5) AS label, row_number() OVER (PARTITION BY session_id, lang || '_' || (id % 5) ORDER BY id) AS k FROM files)""")
def label_dedup(spark, sf_dir):
    groups = files(spark, sf_dir).select(F.col("id").alias("group_id"), "session_id", F.concat_ws("_", "lang", F.col("id") % 5).alias("label"))
    return relations.unique_labels(groups)


@query(f"SELECT f.id FROM files f LEFT JOIN ({PREFIX_SQL}) p ON p.dir = f.dir AND p.prefix = regexp_extract(f.stem, '^(\\d+(?:\\.\\d+)*)', 1) WHERE p.dir IS NULL")
def singletons(spark, sf_dir):
    f = files(spark, sf_dir)
    led = f.withColumn("prefix", text.loose_prefix(F.col("stem"))).join(relations.prefix_clusters(f).select("dir", "prefix"), ["dir", "prefix"])
    return relations.singletons(f, led.select(F.col("id").alias("file_id"))).select("id")


@query(r"""SELECT prefix, count(DISTINCT dir) AS groups, count(DISTINCT id) AS n FROM (
  SELECT id, dir, nullif(regexp_extract(stem, '^(\d+(?:\.\d+)*)', 1), '') AS p FROM files) f
JOIN (SELECT dir AS d, min(p) AS prefix FROM (SELECT dir, nullif(regexp_extract(stem, '^(\d+(?:\.\d+)*)', 1), '') AS p FROM files) GROUP BY dir HAVING count(p) >= 2 AND min(p) = max(p)) g ON f.dir = g.d GROUP BY prefix""")
def merge_by_prefix(spark, sf_dir):
    return relations.merge_by_prefix(files(spark, sf_dir).select(F.col("dir").alias("group_id"), F.col("id").alias("file_id"), "stem"))


# ---------------------------------------------------------------- names


@query(r"SELECT id, rtrim(ltrim(regexp_replace(regexp_replace(regexp_replace(lower(trim(stem)), '[^a-z0-9_\s-]', '', 'g'), '[\s_]+', '_', 'g'), '-+', '-', 'g'), '_-'), '_-')[1:60] AS slug FROM files")
def slug60(spark, sf_dir):
    return files(spark, sf_dir).select("id", text.slug(F.col("stem")).alias("slug"))


HYGIENE_SQL = r"rtrim(ltrim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(trim(stem), '[<>:\"|?*\\/\x00-\x1f()\[\]{}#&%!;,@$=+`~^]', '_', 'g'), '\s+', '_', 'g'), '_+', '_', 'g'), '-+', '-', 'g'), '._- '), '._- ')"


@query(f"SELECT id, {HYGIENE_SQL} AS clean, {HYGIENE_SQL} <> stem AS needed FROM files")
def hygiene_stem(spark, sf_dir):
    return files(spark, sf_dir).select("id", text.hygienic(F.col("stem")).alias("clean"), text.needs_hygiene(F.col("stem")).alias("needed"))


RENAMED_SQL = f"{HYGIENE_SQL} <> '' AND {HYGIENE_SQL} <> stem"
CLEAN_SQL = f"{HYGIENE_SQL} || lower(extension)"


@query(f"""SELECT id, path AS current_value, dir || '/' || {CLEAN_SQL} AS proposed_value, 0.5::DOUBLE AS confidence FROM files
WHERE {RENAMED_SQL} AND id NOT IN (SELECT o_custkey FROM orders WHERE o_orderkey % 5 = 1)""")
def hygiene_renames(spark, sf_dir):
    return naming.hygiene_renames(files(spark, sf_dir), proposals(spark, sf_dir).filter("proposal_type = 'rename'"))


@query(f"""SELECT id AS file_id, CASE WHEN {RENAMED_SQL} THEN dir || '/' || {CLEAN_SQL} ELSE path END AS current_value,
  '/corpus/moved/' || lang || '/' || CASE WHEN {RENAMED_SQL} THEN {CLEAN_SQL} ELSE filename END AS proposed_value FROM files WHERE extension <> '.txt'""")
def moves_after_renames(spark, sf_dir):
    f = files(spark, sf_dir)
    renames = naming.hygiene_renames(f, f.filter("false").select(F.col("id").alias("file_id"))).withColumn("file_id", F.col("id"))
    moves = f.filter("extension <> '.txt'").select(F.col("id").alias("file_id"), F.col("path").alias("current_value"), F.concat(F.lit("/corpus/moved/"), "lang", F.lit("/"), "filename").alias("proposed_value"))
    return execution.moves_after_renames(moves, renames)


@query("SELECT id, id % 8 IN (0, 2, 6) AS useless FROM files")
def useless_stem(spark, sf_dir):
    return files(spark, sf_dir).select("id", text.useless(F.col("stem")).alias("useless"))


@query("SELECT id, CASE WHEN id % 8 = 5 THEN 'report_' || lang || '_' || (id % 9) ELSE stem END AS words FROM files")
def word_dedupe(spark, sf_dir):
    return files(spark, sf_dir).select("id", text.dedupe_words(F.col("stem")).alias("words"))


@query("SELECT id, CASE WHEN length(source) >= 4 THEN 'budget_2024' ELSE source || '_budget_2024' END AS kept FROM files")
def echo_strip(spark, sf_dir):
    return files(spark, sf_dir).select("id", text.strip_echo(F.concat("source", F.lit("_budget_2024")), F.col("source")).alias("kept"))


@query(f"SELECT id, {CATEGORY_SQL} AS category FROM files")
def file_category(spark, sf_dir):
    return categorised(spark, sf_dir).select("id", "category")


@query("""SELECT id, strftime(coalesce(date_exif, date_modified, date_created), '%Y-%m-%d') AS day,
  date_exif IS NOT NULL OR abs(epoch(date_modified) - epoch(date_created)) >= 60 AS meaningful FROM files""")
def best_date(spark, sf_dir):
    f = with_best_date(files(spark, sf_dir))
    return f.select("id", paths.date_prefix(F.col("date_best")).alias("day"), paths.meaningful_date(F.col("date_exif"), F.col("date_modified"), F.col("date_created")).alias("meaningful"))


@query(r"""SELECT id, nullif(replace(regexp_extract(stem, '^(\d+(?:[._]\d+)*)[\s_.\-]', 1), '.', '_'), '') AS strict,
  nullif(regexp_extract(stem, '^(\d+(?:\.\d+)*)', 1), '') AS loose,
  CASE WHEN id % 8 = 3 THEN (id % 30) || '_' || (id % 12) || '_plan' ELSE 'plan' END AS ensured FROM files""")
def numeric_prefix(spark, sf_dir):
    s = F.col("stem")
    return files(spark, sf_dir).select("id", text.strict_prefix(s).alias("strict"), text.loose_prefix(s).alias("loose"), text.ensure_prefix(F.lit("plan"), s).alias("ensured"))


@query(r"""SELECT p_partkey, rtrim(rtrim(ltrim(regexp_replace(regexp_replace(regexp_replace(lower(trim(p_type)), '[\s/\\.]+', '_', 'g'), '[^a-z0-9_\-]+', '', 'g'), '[_\-]{2,}', '_', 'g'), '_-'), '_-')[1:40], '_-') AS label,
  rtrim(ltrim(regexp_replace(regexp_replace(trim(p_name), '\s+', '_', 'g'), '_+', '_', 'g'), '._'), '._') AS folder,
  p_partkey % 2 = 0 AS generic, list_filter(string_split_regex(p_name, '[^A-Za-z0-9]+'), lambda w: length(w) > 1) AS tokens FROM part""", uses_files=False)
def folder_names(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    odd = F.when(F.col("p_partkey") % 2 == 0, F.concat(F.col("p_partkey"), F.lit(" Milestone"))).otherwise("p_type")
    return p.select("p_partkey", text.label_slug(F.col("p_type")).alias("label"), text.folder_name(F.col("p_name")).alias("folder"), text.generic_folder(odd).alias("generic"), text.tokens(F.col("p_name")).alias("tokens"))


SHOWN = "CASE WHEN size_bytes % {d} = 0 THEN (size_bytes // {d}) || ' {u}' ELSE format('{{:.1f}} {u}', size_bytes / {d}.0::DOUBLE) END"
SHOWN_SQL = "CASE " + " ".join(f"WHEN size_bytes < {1 << 10 * (k + 1)} THEN " + SHOWN.format(d=1 << 10 * k, u=u) for k, u in enumerate(("B", "KB", "MB", "GB"))) + " ELSE " + SHOWN.format(d=1 << 40, u="TB") + " END"


@query(f"SELECT id, {SHOWN_SQL} AS shown FROM files")
def human_size(spark, sf_dir):
    return files(spark, sf_dir).select("id", text.human_size(F.col("size_bytes")).alias("shown"))


@query("""SELECT id, path, regexp_replace(path, '/[^/]*$', '') AS parent, filename AS name, extension AS suffix, stem, [source, lang] AS chain FROM
  (SELECT * REPLACE (stem AS stem) FROM files)""")
def path_parts(spark, sf_dir):
    p = F.col("path")
    return files(spark, sf_dir).select("id", "path", paths.parent(p).alias("parent"), paths.name(p).alias("name"), paths.suffix(p).alias("suffix"), paths.stem(p).alias("stem"), paths.folder_chain(p, 2).alias("chain"))


SERIES_SQL = ", found AS (" + " UNION ALL ".join(
    f"SELECT id, dir, {k} AS k, '{sep}' AS sep, trim(regexp_extract(stem, '{p}', 1)) AS base, regexp_extract(stem, '{p}', 2) AS digits FROM files"
    for k, (sep, p) in enumerate((("_", r"^(.+?)_(\d+)$"), ("-", r"^(.+?)-(\d+)$"), (" ", r"^(.+?)\s(\d+)$"), ("", r"^(.+?)(\d+)$")))
) + """), shared AS (SELECT dir, k, base FROM found WHERE length(base) >= 2 GROUP BY ALL HAVING count(*) >= 2),
chosen AS (SELECT f.*, row_number() OVER (PARTITION BY f.id ORDER BY f.k) AS choice FROM found f JOIN shared s ON s.dir = f.dir AND s.k = f.k AND s.base = f.base)
SELECT dir, base, sep, count(*) AS n, min(CAST(digits AS BIGINT)) AS lowest, max(CAST(digits AS BIGINT)) AS highest,
  CAST(max(CASE WHEN digits LIKE '0%' AND length(digits) > 1 THEN length(digits) ELSE 1 END) AS INT) AS width FROM chosen WHERE choice = 1 GROUP BY dir, base, sep"""


@query(SERIES_SQL)
def sequence_detect(spark, sf_dir):
    return naming.sequences(files(spark, sf_dir))


@query(SERIES_SQL)
def sequence_detect_all(spark, sf_dir):
    """The same by its earlier name."""
    return sequence_detect(spark, sf_dir)


@query("""SELECT f.id, p.primary_id FROM files f JOIN (SELECT dir, lower(stem) AS s, min(id) AS primary_id FROM files WHERE status = 'analyzed' GROUP BY 1, 2) p
ON p.dir = f.dir AND p.s = lower(f.stem) WHERE f.id <> p.primary_id""")
def stem_companions(spark, sf_dir):
    f = files(spark, sf_dir)
    return naming.companions(f, f.filter("status = 'analyzed'"))


@query("SELECT token, count(*) AS n FROM (SELECT unnest(regexp_extract_all(lower(stem), '[a-z]{5,}')) AS token FROM files) GROUP BY token")
def token_frequency(spark, sf_dir):
    return naming.token_frequency(files(spark, sf_dir))


@query()
def collision_resolve(spark, sf_dir):
    f = files(spark, sf_dir)
    wanted = f.select("id", "dir", text.slug(F.col("stem")).alias("stem"), F.lower("extension").alias("ext"), F.col("stem").alias("original"), F.col("filename").alias("current"))
    return naming.resolve_collisions(wanted, f.select("dir", "filename"))


@query()
def spelling_variants(spark, sf_dir):
    return naming.spelling(naming.token_frequency(table(spark, sf_dir, "documents").select(F.col("text").alias("stem"))))


# ---------------------------------------------------------------- logs

SESSIONS_SQL = """s AS (SELECT *, sum(CASE WHEN gap IS NULL OR gap > 300000000 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS session FROM (
  SELECT *, epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS gap FROM events))"""


@query(f"WITH {SESSIONS_SQL} SELECT user_id, CAST(session AS BIGINT) AS session, epoch_us(min(ts)) AS started, epoch_us(max(ts)) AS ended, count(*) AS n FROM s GROUP BY user_id, session", uses_files=False)
def undo_sessions(spark, sf_dir):
    return execution.gap_sessions(table(spark, sf_dir, "events")).select("user_id", "session", F.unix_micros(F.col("started").cast("timestamp")).alias("started"), F.unix_micros(F.col("ended").cast("timestamp")).alias("ended"), "n")


@query(f"WITH {SESSIONS_SQL} SELECT user_id, CAST(session AS BIGINT) AS session, event_type, count(*) AS n FROM s GROUP BY 1, 2, 3", uses_files=False)
def undo_session_counts(spark, sf_dir):
    return execution.operation_counts(table(spark, sf_dir, "events")).select("user_id", "session", F.explode("counts").alias("event_type", "n"))


@query("SELECT event_id, user_id FROM (SELECT *, max(ts) OVER (PARTITION BY user_id) AS last FROM events) WHERE ts >= last - INTERVAL 300 SECOND", uses_files=False)
def last_batch(spark, sf_dir):
    return execution.last_batch(table(spark, sf_dir, "events")).select("event_id", "user_id")


@query("SELECT page_id, regexp_extract(url, '^[a-z]+://([^/]+)', 1) AS host, len(string_split(regexp_replace(regexp_replace(url, '^[a-z]+://[^/]+/?', ''), '[?#].*$', ''), '/'))::INT AS depth FROM pages", uses_files=False)
def url_hierarchy(spark, sf_dir):
    path = F.regexp_replace(F.regexp_replace("url", "^[a-z]+://[^/]+/?", ""), "[?#].*$", "")
    return table(spark, sf_dir, "pages").select("page_id", F.regexp_extract("url", "^[a-z]+://([^/]+)", 1).alias("host"), F.size(F.split(path, "/")).alias("depth"))


from filequarry.plans import answers, contents, duplicates, profiled, proposed, reorganised  # noqa: E402, F401  (they register their queries here)
