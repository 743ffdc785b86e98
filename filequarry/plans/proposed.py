"""Registered queries of proposals: names, moves, folders and what running them leaves."""

from __future__ import annotations

from pyspark.sql import functions as F

from filequarry.functions import paths, text
from filequarry.operators import execution, folders, proposing, reads
from filequarry.plans.registry import CATEGORY_SQL, HYGIENE_SQL, PROPOSALS_SQL, SERIES_SQL, categorised, files, proposals, query, table


def slug_sql(x: str) -> str:
    return f"rtrim(ltrim(regexp_replace(regexp_replace(regexp_replace(lower(trim({x})), '[^\\p{{L}}\\p{{N}}_\\s-]', '', 'g'), '[\\s_]+', '_', 'g'), '-+', '-', 'g'), '_-'), '_-')[1:60]"


def words_sql(x: str) -> str:
    """The words of a stem, each once, in order."""
    parts = f"list_filter(string_split({x}, '_'), lambda w: w <> '')"
    return f"list_aggregate(list_filter({parts}, lambda w, i: list_position({parts}, w) = i), 'string_agg', '_')"


def quoted(words: list[str]) -> str:
    return ", ".join("'" + w + "'" for w in words)


USELESS_SQL = "regexp_matches(lower(trim(stem)), '" + "|".join(f"(?:{p})" for p in text.USELESS_STEMS) + "')"
CONTENT_TYPE_SQL = "CASE " + " ".join(f"WHEN ltrim(lower(extension), '.') IN ({quoted(e)}) THEN '{k}'" for k, e in text.CONTENT_TYPES.items()) + " ELSE 'file' END"
CONTEXT_SQL = f"CASE WHEN {slug_sql('stem')} = '' THEN {slug_sql('lang')} WHEN starts_with({slug_sql('stem')}, {slug_sql('lang')}) THEN {slug_sql('stem')} ELSE {slug_sql('lang')} || '_' || {slug_sql('stem')} END"


def described(spark, sf_dir):
    """Files with what a model might have said of them."""
    about = F.when(F.col("id") % 4 == 3, None).when(F.col("id") % 16 == 6, "Could not open the file").otherwise(F.array_join(F.slice(F.split("text", " "), 1, 9), " "))
    asked = F.when(F.col("id") % 5 == 1, F.concat(F.lit("Corpus Item "), "lang", F.lit(" item "), (F.col("id") % 7).cast("string")))
    return files(spark, sf_dir).withColumns({"ai_description": about, "ai_suggested_name": asked, "ai_tags": F.when(F.col("id") % 4 == 3, None).when(F.col("id") % 8 == 4, F.array(F.lit("Photo Place"), F.lit("image"))).otherwise(F.col("ai_tags"))})


TAG_SQL = f"list_filter(list_transform(tags, lambda t: replace(lower(t), ' ', '_')), lambda t: t NOT IN ({quoted(text.GENERIC_TAGS)}) AND NOT starts_with(t, 'photo_') AND NOT starts_with(t, 'image_') AND NOT starts_with(t, 'picture_'))"
DESC_SQL = r"list_transform(list_filter(list_filter(string_split_regex(regexp_replace(description, '[^a-zA-Z0-9\s]', ' ', 'g'), '\s+'), lambda w: w <> '')[1:6], lambda w: length(w) > 2), lambda w: lower(w))"
ERROR_SQL = " OR ".join(f"contains(lower(description), '{w}')" for w in text.ERROR_WORDS)
NAMES_SQL = SERIES_SQL[: SERIES_SQL.rindex("SELECT dir, base, sep, count(*)")] + f""", series AS (SELECT id, base, sep, digits,
  max(CASE WHEN digits LIKE '0%' AND length(digits) > 1 THEN length(digits) ELSE 1 END) OVER (PARTITION BY dir, base, sep) AS width FROM chosen WHERE choice = 1),
n0 AS (SELECT *, lower(extension) AS ext, CASE WHEN id % 4 = 3 THEN NULL WHEN id % 16 = 6 THEN 'Could not open the file' ELSE list_aggregate(string_split(text, ' ')[1:9], 'string_agg', ' ') END AS description,
  CASE WHEN id % 5 = 1 THEN 'Corpus Item ' || lang || ' item ' || (id % 7) END AS suggested, CASE WHEN id % 4 = 3 THEN NULL WHEN id % 8 = 4 THEN ['Photo Place', 'image'] ELSE ai_tags END AS tags FROM files),
n1 AS (SELECT *, list_aggregate(({TAG_SQL})[1:3], 'string_agg', '_') AS tagged, list_aggregate({DESC_SQL}, 'string_agg', '_') AS worded FROM n0),
n2 AS (SELECT *, coalesce(nullif({slug_sql('suggested')}, ''), nullif({slug_sql(words_sql('tagged'))}, ''), nullif({slug_sql(words_sql('worded'))}, '')) AS content FROM n1),
n3 AS (SELECT *, list_filter(string_split(content, '_'), lambda t: t <> '' AND lower(t) <> 'corpus') AS kept FROM n2),
n4 AS (SELECT *, {words_sql(r"CASE WHEN len(list_filter(kept, lambda t: length(t) >= 3 AND NOT regexp_matches(t, '^[0-9]+$'))) > 0 THEN list_aggregate(kept, 'string_agg', '_') ELSE content END")} AS said FROM n3),
n5 AS (SELECT n4.*, s.base, s.sep, s.width, nullif(regexp_replace(s.digits, '^0+(.)', '\\1'), '') AS number,
  CASE WHEN date_exif IS NOT NULL OR abs(epoch(date_modified) - epoch(date_created)) >= 60 THEN coalesce(date_exif, date_modified) END AS good FROM n4 LEFT JOIN series s ON s.id = n4.id),
n6 AS (SELECT *, CASE WHEN ext IN ({quoted(text.TIMED)}) THEN CASE WHEN strftime(good, '%H%M%S') = '000000' THEN strftime(good, '%Y-%m-%d') ELSE strftime(good, '%Y-%m-%d_%H-%M-%S') END
  WHEN ext IN ({quoted(text.DATED)}) THEN strftime(good, '%Y-%m-%d') END AS day FROM n5),
n7 AS (SELECT *, regexp_replace(regexp_replace(coalesce(base || sep || CASE WHEN length(number) >= width THEN number ELSE lpad(number, CAST(width AS INT), '0') END || '_' || said, coalesce(day || '_', '') || said), '_+', '_', 'g'), '^_+|_+$', '', 'g') AS whole,
  CASE WHEN {HYGIENE_SQL} <> '' AND {HYGIENE_SQL} <> stem THEN {HYGIENE_SQL} || ext END AS tidy, CASE WHEN {USELESS_SQL} THEN {CONTEXT_SQL} || ext END AS useful FROM n6),
names AS (SELECT *, CASE WHEN coalesce(description, '') = '' AND (tags IS NULL OR len(tags) = 0) THEN coalesce(useful, tidy)
  WHEN coalesce({ERROR_SQL}, false) OR coalesce(ai_confidence = 0, false) OR said IS NULL THEN tidy ELSE {words_sql('whole')} || ext END AS new_name FROM n7)"""


@query(f"{NAMES_SQL} SELECT id, new_name FROM names")
def built_names(spark, sf_dir):
    return proposing.named(described(spark, sf_dir), "/corpus").select("id", "new_name")


@query(rf"""{NAMES_SQL}, bare AS (SELECT *, new_name[1:length(new_name) - length(extension)] AS b, nullif(replace(regexp_extract(stem, '^(\d+(?:[._]\d+)*)[\s_.\-]', 1), '.', '_'), '') AS p FROM names WHERE status = 'analyzed' AND new_name IS NOT NULL),
final AS (SELECT *, CASE WHEN p IS NULL OR starts_with(b, p || '_') OR starts_with(b, replace(p, '_', '.')) OR starts_with(b, p || '-') THEN b ELSE p || '_' || b END || ext AS f FROM bare)
SELECT id AS file_id, path AS current_value, dir || '/' || f AS proposed_value, coalesce(nullif(ai_confidence, 0), 0.5)::DOUBLE AS confidence FROM final
WHERE f <> filename AND id NOT IN (SELECT o_custkey FROM orders WHERE o_orderkey % 5 = 1)""")
def rename_proposals(spark, sf_dir):
    return proposing.rename_proposals(described(spark, sf_dir), proposals(spark, sf_dir).filter("proposal_type = 'rename'"), "/corpus")


@query(f"""SELECT id AS file_id, path AS current_value, dir || '/' || {CONTEXT_SQL} || lower(extension) AS proposed_value, 0.6::DOUBLE AS confidence FROM files
WHERE {USELESS_SQL} AND {CONTEXT_SQL} || lower(extension) <> filename AND id NOT IN (SELECT o_custkey FROM orders WHERE o_orderkey % 5 = 1)""")
def useless_renames(spark, sf_dir):
    return proposing.useless_renames(files(spark, sf_dir), proposals(spark, sf_dir).filter("proposal_type = 'rename'"))


def known_renames(spark, sf_dir):
    """A new name for two files in seven."""
    f = files(spark, sf_dir).filter("id % 7 IN (1, 4)")
    return f.select(F.col("id").alias("file_id"), F.concat("dir", F.lit("/renamed_"), (F.col("id") % 10).cast("string"), F.lower("extension")).alias("proposed_value"), "ai_confidence").withColumnRenamed("ai_confidence", "confidence")


KNOWN_SQL = "renames AS (SELECT id AS file_id, dir || '/renamed_' || (id % 10) || lower(extension) AS proposed_value, ai_confidence AS confidence FROM files WHERE id % 7 IN (1, 4))"


@query(f""", {KNOWN_SQL}, first AS (SELECT dir, lower(stem) AS s, arg_min(id % 10, id) AS k FROM files WHERE id % 7 IN (1, 4) GROUP BY 1, 2)
SELECT f.id AS file_id, f.path AS current_value, f.dir || '/renamed_' || k || f.extension AS proposed_value, 0.6::DOUBLE AS confidence
FROM files f JOIN first ON first.dir = f.dir AND first.s = lower(f.stem) WHERE f.id % 7 NOT IN (1, 4)""")
def sibling_renames(spark, sf_dir):
    return proposing.sibling_renames(files(spark, sf_dir), known_renames(spark, sf_dir))


def groups(spark, sf_dir):
    """Files in related groups: some lie in one folder, some don't."""
    f = files(spark, sf_dir)
    group = F.when(F.col("id") % 2 == 0, F.concat_ws("#", "dir", F.col("id") % 6)).otherwise(F.concat_ws("#", "lang", F.col("id") % 9))
    role = F.element_at(F.array(*map(F.lit, ("source", "sibling", "draft", "variant", "export"))), (F.col("id") % 5 + 1).cast("int"))
    return f.select(group.alias("group_id"), F.concat(F.lit("set_"), (F.col("id") % 6).cast("string")).alias("label"), F.col("id").alias("file_id"), role.alias("role"), F.when(F.length("lang") > 2, 0.3).otherwise(0.7).alias("group_confidence"))


GROUPS_SQL = """members AS (SELECT CASE WHEN id % 2 = 0 THEN dir || '#' || (id % 6) ELSE lang || '#' || (id % 9) END AS group_id, 'set_' || (id % 6) AS label, id AS file_id,
  ['source', 'sibling', 'draft', 'variant', 'export'][CAST(id % 5 AS INT) + 1] AS role FROM files WHERE length(lang) <= 2)"""


@query(f""", {KNOWN_SQL}, {GROUPS_SQL}, ranked AS (SELECT group_id, proposed_value, row_number() OVER (PARTITION BY group_id ORDER BY role <> 'source', coalesce(confidence, 0) DESC, filename, m.file_id) AS k
  FROM members m JOIN renames r ON r.file_id = m.file_id JOIN files f ON f.id = m.file_id),
best AS (SELECT group_id, regexp_replace(regexp_replace(regexp_extract(proposed_value, '[^/]+$'), '\\.[^.]+$', ''), '^(.+)_\\d+$', '\\1') AS stem FROM ranked WHERE k = 1)
SELECT id AS file_id, path AS current_value, dir || '/' || name AS proposed_value, 0.55::DOUBLE AS confidence FROM (
  SELECT f.id, f.path, f.dir, f.filename, best.stem || CASE WHEN role IN ('source', 'sibling') THEN '' ELSE '_' || role END || extension AS name
  FROM members m JOIN best ON best.group_id = m.group_id JOIN files f ON f.id = m.file_id WHERE m.file_id NOT IN (SELECT file_id FROM renames)) WHERE name <> filename""")
def group_renames(spark, sf_dir):
    return proposing.group_renames(groups(spark, sf_dir), files(spark, sf_dir), known_renames(spark, sf_dir))


@query(f""", {KNOWN_SQL}, {GROUPS_SQL}, single AS (SELECT group_id FROM members m JOIN files f ON f.id = m.file_id GROUP BY group_id HAVING count(*) >= 2 AND min(dir) = max(dir)),
own AS (SELECT m.group_id, m.file_id, f.path, f.dir || '/' || label AS target, coalesce(regexp_extract(proposed_value, '[^/]+$'), filename) AS name
  FROM members m JOIN single s ON s.group_id = m.group_id JOIN files f ON f.id = m.file_id LEFT JOIN renames r ON r.file_id = m.file_id WHERE m.file_id % 4 <> 0)
SELECT count(*) AS n, count(*) AS names, CAST(sum(file_id) AS BIGINT) AS ids FROM own""")
def cluster_moves(spark, sf_dir):
    """In short: every file goes, each to a place of its own. Which number it gets can take rounds that SQL has no words for."""
    moved = files(spark, sf_dir).filter("id % 4 = 0").select(F.col("id").alias("file_id"))
    moves = proposing.cluster_moves(groups(spark, sf_dir), files(spark, sf_dir), known_renames(spark, sf_dir), moved)
    return moves.agg(F.count("*").alias("n"), F.count_distinct("proposed_value").alias("names"), F.sum("file_id").alias("ids"))


@query(f""", kinds AS (SELECT *, {CATEGORY_SQL} AS category FROM files WHERE starts_with(path, '/corpus/src1/')), many AS (SELECT category FROM kinds GROUP BY category HAVING count(*) >= 2)
SELECT id AS file_id, path AS current_value, '/corpus/src1/' || CASE category WHEN 'image' THEN 'Images' WHEN 'document' THEN 'Documents' WHEN 'video' THEN 'Videos' WHEN 'web' THEN 'Web_Files' ELSE 'Archives' END || '/' || filename AS proposed_value, 0.55::DOUBLE AS confidence
FROM kinds WHERE category IN (SELECT category FROM many) AND id % 4 <> 0""")
def loose_root_files(spark, sf_dir):
    moved = files(spark, sf_dir).filter("id % 4 = 0").select(F.col("id").alias("file_id"))
    return proposing.loose_root_files(categorised(spark, sf_dir), "/corpus/src1", moved)


@query("""SELECT f.id AS file_id, f.path AS current_value, '/corpus/kept/' || p.k || '/' || f.filename AS proposed_value, 0.6::DOUBLE AS confidence FROM files f
JOIN (SELECT dir, lower(stem) AS s, arg_min(lang || (id % 5), id) AS k FROM files WHERE status = 'analyzed' GROUP BY 1, 2) p ON p.dir = f.dir AND p.s = lower(f.stem) WHERE f.status = 'enriched'""")
def skipped_companions(spark, sf_dir):
    f = files(spark, sf_dir)
    moves = f.filter("status = 'analyzed'").select(F.col("id").alias("file_id"), F.concat(F.lit("/corpus/kept/"), "lang", (F.col("id") % 5).cast("string"), F.lit("/"), "filename").alias("proposed_value"))
    return proposing.skipped_companions(f.replace("enriched", "skipped", "status"), moves)


@query(f""", raw AS (SELECT id, dir, unnest(ai_tags) AS tag, generate_subscripts(ai_tags, 1) AS place FROM files),
t AS (SELECT id, dir, place, regexp_replace(regexp_replace(regexp_replace(lower(tag), '[^a-z0-9_]', '_', 'g'), '_+', '_', 'g'), '^_+|_+$', '', 'g') AS token FROM raw),
ranked AS (SELECT dir, token, row_number() OVER (PARTITION BY dir ORDER BY count(*) DESC, min((id, place))) AS k FROM t WHERE length(token) >= 3 AND token NOT IN ({quoted(text.FOLDER_TAGS_DROPPED)}) GROUP BY dir, token)
SELECT dir, string_agg(token, '_' ORDER BY k) AS name FROM ranked WHERE k <= 3 GROUP BY dir""")
def folder_names_from_tags(spark, sf_dir):
    return proposing.folder_names_from_tags(files(spark, sf_dir))


@query(f"SELECT id, {CONTENT_TYPE_SQL} AS kind, {CONTEXT_SQL} AS in_folder, {CONTENT_TYPE_SQL} || '_' || {slug_sql('stem')} AS in_foreign FROM files")
def context_names(spark, sf_dir):
    f, stem, ext = files(spark, sf_dir), F.col("stem"), F.col("extension")
    return f.select("id", text.content_type(ext).alias("kind"), text.folder_context(F.col("lang"), stem, ext).alias("in_folder"), text.folder_context(F.lit("?!"), stem, ext).alias("in_foreign"))


@query(r"""SELECT id, rtrim(ltrim(regexp_replace(regexp_replace(trim(regexp_replace(s, '[<>:"/\\|?*\x00-\x1f]', '_', 'g')), '\s+', '_', 'g'), '_+', '_', 'g'), '._'), '._')[1:80] AS safe FROM (SELECT id, ' .' || stem || ': a/b?' || repeat('x y_', 30) AS s FROM files)""")
def sanitised_stems(spark, sf_dir):
    odd = F.concat(F.lit(" ."), "stem", F.lit(": a/b?"), F.lit("x y_" * 30))
    return files(spark, sf_dir).select("id", text.sanitised(odd).alias("safe"))


@query("SELECT p_partkey, 'shlvm_' || replace(lower(p_name), ' ', '_') || '_12' AS latin FROM part", uses_files=False)
def transliterated(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", text.transliterate(F.concat(F.lit("שלום "), "p_name", F.lit("-1!2"))).alias("latin"))


PLAIN_SQL = r"regexp_replace(lower(t), '\s+', '_', 'g')"


@query(rf""", said AS (SELECT id, list_transform(list_concat(ai_tags, ['Photos', ' Old  Report', ' ' || ai_tags[1], repeat('x', 41), 'Quarterly', 'budget plan', 'NEW thing', 'new Thing']), lambda t: regexp_replace(t, '^\s+|\s+$', '', 'g')) AS tags,
  list_filter(string_split_regex(lower(stem || ' ' || source || ' files'), '[\s_\-.]+'), lambda w: length(w) >= 4) AS names FROM files),
kept AS (SELECT id, list_filter(tags, lambda t: length(t) <= 40 AND length({PLAIN_SQL}) >= 3 AND {PLAIN_SQL} NOT IN ({quoted(text.UNTELLING_TAGS)}) AND len(list_filter(names, lambda w: contains({PLAIN_SQL}, w) OR contains(w, {PLAIN_SQL}))) = 0) AS tags FROM said),
keyed AS (SELECT id, tags, list_transform(tags, lambda t: {PLAIN_SQL}) AS k FROM kept)
SELECT id, list_filter(tags, lambda t, i: list_position(k, k[i]) = i)[1:15] AS tags FROM keyed""")
def clean_tags(spark, sf_dir):
    f = files(spark, sf_dir)
    more = F.array(F.lit("Photos"), F.lit(" Old  Report"), F.concat(F.lit(" "), F.get("ai_tags", F.lit(0))), F.lit("x" * 41), F.lit("Quarterly"), F.lit("budget plan"), F.lit("NEW thing"), F.lit("new Thing"))
    return f.select("id", text.clean_tags(F.concat("ai_tags", more), F.col("filename"), F.concat("source", F.lit(" files"))).alias("tags"))


@query(f"WITH {PROPOSALS_SQL}, s AS (SELECT *, 's' || (id % 3) AS session_id FROM proposals) SELECT id, proposal_type, status FROM s WHERE NOT (session_id = 's1' AND status = 'pending' AND proposal_type IN ('move', 'rename_folder'))", uses_files=False)
def without_stale(spark, sf_dir):
    p = proposals(spark, sf_dir).withColumn("session_id", F.concat(F.lit("s"), (F.col("id") % 3).cast("string")))
    return execution.without_stale(p, "s1").select("id", "proposal_type", "status")


@query(f"""WITH {PROPOSALS_SQL} SELECT id, CASE WHEN id % 4 = 1 THEN 'not_run' WHEN id % 7 = 0 THEN 'failed' ELSE 'applied' END AS outcome,
  CASE WHEN id % 4 = 1 THEN status WHEN id % 7 = 0 THEN 'rejected' ELSE 'applied' END AS status FROM proposals""", uses_files=False)
def run_outcomes(spark, sf_dir):
    p = proposals(spark, sf_dir)
    return execution.with_outcomes(p, p.filter("id % 4 <> 1").select("id", (F.col("id") % 7 != 0).alias("ok"))).select("id", "outcome", "status")


@query("""SELECT dir, CAST(depth AS INT) AS depth FROM (SELECT DISTINCT '/corpus/' || source || '/' || lang AS dir, 3 AS depth FROM files UNION SELECT DISTINCT '/corpus/' || source, 2 FROM files UNION SELECT '/corpus', 1 WHERE EXISTS (SELECT 1 FROM files)) d
WHERE NOT EXISTS (SELECT 1 FROM files f WHERE NOT (source IN ('src1', 'src3') OR lang = 'en') AND (f.dir = d.dir OR starts_with(f.dir, d.dir || '/')))
  AND EXISTS (SELECT 1 FROM files f WHERE (source IN ('src1', 'src3') OR lang = 'en') AND (f.dir = d.dir OR starts_with(f.dir, d.dir || '/')))""")
def emptied_folders(spark, sf_dir):
    gone = F.col("source").isin("src1", "src3") | (F.col("lang") == "en")
    f = files(spark, sf_dir)
    return execution.emptied_folders(f.filter(gone), f.filter(~gone))


@query("SELECT id AS file_id, path AS current_value, '/corpus/.trash/' || CASE WHEN k = 1 THEN filename ELSE stem || '_' || (k - 1) || extension END AS proposed_value FROM (SELECT *, row_number() OVER (PARTITION BY filename ORDER BY id) AS k FROM files WHERE id % 8 IN (4, 7))")
def trash_plan(spark, sf_dir):
    return execution.trash_plan(files(spark, sf_dir).filter("stem LIKE 'My Report%' OR stem LIKE 'Quarterly%'"), "/corpus")


@query("SELECT DISTINCT dir FROM (SELECT '/corpus/moved/' || lang AS dir FROM files WHERE id % 4 = 0 UNION SELECT '/corpus' UNION SELECT dir FROM files WHERE id % 4 = 1) WHERE dir NOT IN (SELECT dir FROM files)")
def touched_folders(spark, sf_dir):
    f = files(spark, sf_dir)
    applied = f.filter("id % 4 IN (0, 1)").select(F.when(F.col("id") % 4 == 0, F.concat(F.lit("/corpus/moved/"), "lang", F.lit("/"), "filename")).otherwise(F.col("path")).alias("proposed_value"))
    return execution.touched_folders(applied, "/corpus", f.select("dir").distinct())


@query("""SELECT id, CASE WHEN k IS NULL THEN 'mtime_fallback' ELSE k END AS source, epoch(coalesce(date_exif, date_modified))::BIGINT AS at FROM (SELECT *, CASE WHEN date_exif IS NOT NULL THEN 'exif_fallback' END AS k FROM files)""")
def created_dates(spark, sf_dir):
    none = F.lit(None).cast("timestamp_ntz")
    date, label = paths.created_date(none, none, F.col("date_exif"), none, F.col("date_modified"))
    return files(spark, sf_dir).select("id", label.alias("source"), F.unix_seconds(date.cast("timestamp")).alias("at"))


@query("SELECT id, dir, CAST((row_number() OVER (PARTITION BY dir ORDER BY id) - 1) // 100 AS INT) AS chunk FROM files")
def relation_chunks(spark, sf_dir):
    return folders.chunks(files(spark, sf_dir)).select("id", "dir", "chunk")


@query("SELECT id, dir, size_bytes, CAST(k AS INT) AS rank FROM (SELECT id, dir, size_bytes, row_number() OVER (PARTITION BY dir ORDER BY len(ai_tags) = 0, size_bytes DESC, id) AS k FROM files) WHERE k <= 20")
def first_at_root(spark, sf_dir):
    f = files(spark, sf_dir)
    return folders.first_of_folder(f, 20).select("id", "dir", "size_bytes", "rank")


@query(f"WITH {PROPOSALS_SQL} SELECT p.id, coalesce(c.c_name, '(unknown)') AS shown FROM proposals p LEFT JOIN (SELECT * FROM customer WHERE c_custkey % 3 <> 0) c ON c.c_custkey = p.file_id", uses_files=False)
def shown_members(spark, sf_dir):
    known = table(spark, sf_dir, "customer").filter("c_custkey % 3 <> 0").select(F.col("c_custkey").alias("file_id"), "c_name")
    return proposals(spark, sf_dir).join(known, "file_id", "left").select("id", F.coalesce("c_name", F.lit("(unknown)")).alias("shown"))


@query(f"WITH {PROPOSALS_SQL} SELECT c_custkey, c_name FROM customer WHERE c_custkey IN (SELECT file_id FROM proposals WHERE proposal_type = 'move' AND status = 'approved')", uses_files=False)
def files_with_moves(spark, sf_dir):
    moved = proposals(spark, sf_dir).filter("proposal_type = 'move' AND status = 'approved'").select(F.col("file_id").alias("c_custkey"))
    return table(spark, sf_dir, "customer").join(moved, "c_custkey", "left_semi").select("c_custkey", "c_name")


@query(f"WITH {PROPOSALS_SQL} SELECT p.id, c_name FROM proposals p JOIN customer ON c_custkey = file_id WHERE status = 'pending' AND (c_name ILIKE '%001%' OR current_value ILIKE '%001%' OR reasoning ILIKE '%urgent%')", uses_files=False)
def proposals_search(spark, sf_dir):
    joined = proposals(spark, sf_dir).join(table(spark, sf_dir, "customer"), F.col("file_id") == F.col("c_custkey"))
    pending = reads.with_status(joined, "pending")
    either = reads.search(pending, "001", "c_name", "current_value").select("id", "c_name")
    return either.unionByName(reads.search(pending, "urgent", "reasoning").select("id", "c_name")).distinct()


@query("SELECT id, mime_type FROM files WHERE mime_type ILIKE 'image/%' OR mime_type ILIKE 'video/%'")
def media_files(spark, sf_dir):
    return files(spark, sf_dir).filter(F.col("mime_type").ilike("image/%") | F.col("mime_type").ilike("video/%")).select("id", "mime_type")


@query("SELECT id, len(ai_tags) AS tags, ai_tags[1] AS first_tag, strftime(date_modified, '%Y-%m-%dT%H:%M:%S') AS modified, CASE WHEN date_exif IS NULL THEN NULL ELSE strftime(date_exif, '%Y-%m-%dT%H:%M:%S') END AS taken, upper(status) AS status FROM files")
def file_views(spark, sf_dir):
    stored = files(spark, sf_dir).withColumn("ai_tags", F.to_json("ai_tags"))
    return reads.views(stored).select("id", F.size("ai_tags").cast("long").alias("tags"), F.get("ai_tags", F.lit(0)).alias("first_tag"), F.col("date_modified").alias("modified"), F.col("date_exif").alias("taken"), F.upper("status").alias("status"))


@query("SELECT id, total FROM (SELECT id, count(*) OVER () AS total, size_bytes FROM files WHERE status = 'analyzed') ORDER BY size_bytes DESC, id OFFSET 20 LIMIT 50")
def files_page_total(spark, sf_dir):
    return reads.page_with_total(reads.with_status(files(spark, sf_dir), "analyzed"), "size_bytes", 20, 50, descending=True).select("id", "total")


@query(f"WITH {PROPOSALS_SQL} SELECT proposal_type, count(*) AS seen, CAST(count(*) FILTER (status = 'pending' AND confidence >= 0.5) AS BIGINT) AS changed FROM proposals GROUP BY 1", uses_files=False)
def bulk_approval(spark, sf_dir):
    return execution.approved(proposals(spark, sf_dir), 0.5).groupBy("proposal_type").agg(F.count("*").alias("seen"), F.count_if("changed").alias("changed"))


@query("SELECT session_id FROM files GROUP BY session_id ORDER BY max(date_modified) DESC, session_id LIMIT 1")
def latest_session(spark, sf_dir):
    return files(spark, sf_dir).groupBy("session_id").agg(F.max("date_modified").alias("last")).orderBy(F.desc("last"), "session_id").limit(1).select("session_id")
