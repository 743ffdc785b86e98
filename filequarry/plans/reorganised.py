"""Registered queries of folder renames, actions on folders, groups merged and linked, and composed passes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from filequarry.operators import actions, cascades, naming, passes, relations
from filequarry.plans.proposed import described, groups
from filequarry.plans.registry import files, query, table

# ---------------------------------------------------------------- folder renames

RENAMES_SQL = """dirs AS (SELECT dir, source, lang, row_number() OVER (ORDER BY dir) AS k FROM (SELECT DISTINCT dir, source, lang FROM files)),
renames AS (SELECT k AS step, dir AS old, '/corpus/' || source || '/L_' || lang AS new FROM dirs WHERE lang IN ('en', 'de')
  UNION ALL SELECT 1000000000 + min(k), '/corpus/' || source, '/corpus/S_' || source FROM dirs WHERE source <> 'src3' GROUP BY source
  UNION ALL SELECT 2000000000 + k, dir, dir || '/french' FROM dirs WHERE lang = 'fr'
  UNION ALL SELECT 3000000000, '/corpus', '/archive' WHERE EXISTS (SELECT 1 FROM dirs)
  UNION ALL SELECT 4000000000 + k, dir, '/corpus/' || source || '/en' FROM dirs WHERE lang = 'es')"""
#: All renames in turn on lists of paths, the later renames among them.
TURN = "lambda x: CASE WHEN x = olds[k + 1] OR starts_with(x, olds[k + 1] || '/') THEN news[k + 1] || substr(x, length(olds[k + 1]) + 1) ELSE x END"
WALK_SQL = f"""{RENAMES_SQL}, places AS (SELECT list(path ORDER BY path) AS was FROM ({{places}})),
walk AS (SELECT 0 AS k, (SELECT list(old ORDER BY step) FROM renames) AS olds, (SELECT list(new ORDER BY step) FROM renames) AS news, was AS now FROM places
  UNION ALL SELECT k + 1, list_transform(olds, {TURN}), list_transform(news, {TURN}), list_transform(now, {TURN}) FROM walk WHERE k < len(olds)),
followed AS (SELECT unnest(was) AS path, unnest(now) AS now FROM walk, places WHERE k = len(olds))"""


def folder_renames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Inner folders first, then outer ones, then inner ones by their old paths, the root, and one into another's place."""
    dirs = files(spark, sf_dir).select("dir", "source", "lang").distinct().withColumn("k", F.row_number().over(Window.orderBy("dir")).cast("long"))
    of_source = F.concat(F.lit("/corpus/"), "source")
    parts = (
        dirs.filter("lang IN ('en', 'de')").select(F.col("k").alias("step"), F.col("dir").alias("old"), F.concat(of_source, F.lit("/L_"), "lang").alias("new")),
        dirs.filter("source <> 'src3'").groupBy("source").agg(F.min("k").alias("k")).select(F.col("k") + 1_000_000_000, of_source, F.concat(F.lit("/corpus/S_"), "source")),
        dirs.filter("lang = 'fr'").select(F.col("k") + 2_000_000_000, "dir", F.concat("dir", F.lit("/french"))),
        dirs.select(F.lit(3_000_000_000), F.lit("/corpus"), F.lit("/archive")).distinct(),
        dirs.filter("lang = 'es'").select(F.col("k") + 4_000_000_000, "dir", F.concat(of_source, F.lit("/en"))),
    )
    out = parts[0]
    for more in parts[1:]:
        out = out.union(more)
    return cascades.settled(out)


@query((", " + WALK_SQL.format(places="SELECT DISTINCT dir AS path FROM files") + " SELECT id, now || '/' || filename AS path FROM files JOIN followed ON followed.path = dir"), recursive=True)
def folder_cascade(spark, sf_dir):
    return cascades.follow(files(spark, sf_dir).select("id", "path"), folder_renames(spark, sf_dir), "path").select("id", "path")


MOVES_SQL = "moves AS (SELECT id AS file_id, path AS current_value, '/corpus/' || source || '/' || CASE id % 4 WHEN 0 THEN 'L_en' WHEN 2 THEN 'es' ELSE lang END || '/' || filename AS proposed_value FROM files WHERE id % 5 <> 0)"


def some_moves(spark, sf_dir):
    place = F.when(F.col("id") % 4 == 0, "L_en").when(F.col("id") % 4 == 2, "es").otherwise(F.col("lang"))
    return files(spark, sf_dir).filter("id % 5 <> 0").select(F.col("id").alias("file_id"), F.col("path").alias("current_value"), F.concat_ws("/", F.lit("/corpus"), "source", place, "filename").alias("proposed_value"))


PLACES_SQL = "SELECT dir AS path FROM files UNION SELECT regexp_extract(proposed_value, '^(.*)/[^/]*$', 1) FROM moves"
FOLLOWED_SQL = f", {MOVES_SQL}, {WALK_SQL.format(places=PLACES_SQL)}"


@query(f"""{FOLLOWED_SQL} SELECT file_id, a.now || '/' || filename AS current_value, b.now || '/' || filename AS proposed_value, a.now = b.now AS no_op
FROM moves m JOIN files f ON f.id = m.file_id JOIN followed a ON a.path = dir JOIN followed b ON b.path = regexp_extract(proposed_value, '^(.*)/[^/]*$', 1)""", recursive=True)
def cascade_proposals(spark, sf_dir):
    return cascades.follow_proposals(some_moves(spark, sf_dir), folder_renames(spark, sf_dir))


@query(f"""{FOLLOWED_SQL}, ends AS (SELECT dir, 1 AS b, 0 AS a FROM files UNION ALL SELECT now, 0, 1 FROM files f LEFT JOIN moves m ON m.file_id = f.id
  JOIN followed ON followed.path = coalesce(regexp_extract(proposed_value, '^(.*)/[^/]*$', 1), dir)) SELECT dir, CAST(sum(b) AS BIGINT) AS before, CAST(sum(a) AS BIGINT) AS after FROM ends GROUP BY dir""", recursive=True)
def after_tree(spark, sf_dir):
    return cascades.after_tree(files(spark, sf_dir), folder_renames(spark, sf_dir), some_moves(spark, sf_dir))


# ---------------------------------------------------------------- actions

ACTIONS_SQL = """raw AS (SELECT s_suppkey AS action_id, ['rename_folder', 'move_files', 'merge', 'move', 'rename_folder', 'move_files', NULL][CAST(s_suppkey % 7 AS INT) + 1] AS action,
  CASE s_suppkey % 9 WHEN 8 THEN NULL WHEN 7 THEN 'none' WHEN 6 THEN 'src' || (s_suppkey % 5) ELSE 'src' || (s_suppkey % 5) || '/' || ['en', 'de', 'fr', 'es'][CAST(s_suppkey % 4 AS INT) + 1] END AS source_folder,
  CASE s_suppkey % 11 WHEN 5 THEN 'src' || (s_suppkey % 5) || '/' || ['en', 'de', 'fr', 'es'][CAST(s_suppkey % 4 AS INT) + 1] WHEN 4 THEN '' ELSE 'Sorted  by/' || s_nationkey END AS destination_folder,
  CASE s_suppkey % 6 WHEN 5 THEN '../' ELSE 'root/New ' || (s_suppkey % 3) END AS new_name, ['doc-' || (s_suppkey % 20) || '.txt', 'notes_' || (s_suppkey % 9) || '.md', ' IMG_0007.txt', ''] AS filenames,
  ['all', 'the,of', NULL][CAST(s_suppkey % 3 AS INT) + 1] AS file_filter, CASE WHEN s_suppkey % 2 = 0 THEN s_name END AS reasoning, CASE WHEN s_suppkey % 4 <> 3 THEN (s_suppkey % 13) / 10.0 - 0.1 END AS confidence FROM supplier)"""
DONE_SQL = "done AS (SELECT id AS file_id, 'move' AS proposal_type, path AS current_value FROM files WHERE id % 10 = 3 UNION ALL SELECT NULL, 'rename_folder', '/corpus/src2/en')"
READ_SQL = r"""able AS (SELECT action_id, coalesce(action, '') AS kind, '/corpus/' || source_folder AS src, regexp_replace('/corpus/' || replace(destination_folder, '  ', '_'), '/$', '') AS dst,
    'New_' || (action_id % 3) AS name, list_transform(filenames[1:3], lambda n: trim(n)) AS wanted, file_filter = 'the,of' AS asks, coalesce(reasoning, '') AS reasoning, least(greatest(coalesce(confidence, 0.5), 0), 1)::DOUBLE AS confidence,
    source_folder IS NULL OR CASE WHEN action = 'rename_folder' THEN new_name = '../' ELSE destination_folder = '' END AS lacking FROM raw),
  within AS (SELECT a.*, f.id, f.path, f.filename, f.status, (contains(lower(CAST(to_json(ai_tags) AS VARCHAR)), 'the') OR NOT coalesce(asks, false)) AS heard FROM able a JOIN files f ON starts_with(f.path, src || '/') WHERE NOT lacking),
  named AS (SELECT action_id, wanted_name, min(id) AS id FROM (SELECT *, unnest(wanted) AS wanted_name FROM within WHERE kind = 'move_files' AND status = 'analyzed') WHERE filename = wanted_name GROUP BY 1, 2),
  wanted AS (SELECT w.action_id, w.id, path, dst || '/' || filename AS target FROM within w JOIN named n ON n.action_id = w.action_id AND n.id = w.id
    UNION ALL SELECT action_id, id, path, dst || substr(path, length(src) + 1) FROM within WHERE kind NOT IN ('move_files', 'rename_folder') AND status = 'analyzed' AND heard),
  fresh AS (SELECT id, min(action_id) AS first FROM wanted WHERE target <> path AND id NOT IN (SELECT file_id FROM done WHERE proposal_type = 'move') GROUP BY id),
  renames AS (SELECT a.action_id, min(id) AS id, src AS path, regexp_replace(src, '[^/]*$', '') || name AS target FROM able a LEFT JOIN within w USING (action_id, src, name) WHERE a.kind = 'rename_folder' AND NOT a.lacking GROUP BY ALL),
  ones AS (SELECT path, min(action_id) AS first FROM renames WHERE id IS NOT NULL AND path <> target AND path NOT IN (SELECT current_value FROM done WHERE proposal_type = 'rename_folder') GROUP BY path),
  told AS (SELECT action_id, w.id, 'move' AS proposal_type, path, target, CASE WHEN target = path THEN 'no_change' WHEN first IS DISTINCT FROM action_id THEN 'already_proposed' END AS rejected FROM wanted w LEFT JOIN fresh ON fresh.id = w.id
    UNION ALL SELECT action_id, NULL, 'move', NULL, NULL, 'missing_file' FROM (SELECT action_id, unnest(wanted) AS wanted_name FROM able WHERE kind = 'move_files' AND NOT lacking) x WHERE (action_id, wanted_name) NOT IN (SELECT (action_id, wanted_name) FROM named)
    UNION ALL SELECT action_id, NULL, 'move', NULL, NULL, 'no_files' FROM able WHERE kind NOT IN ('move_files', 'rename_folder') AND NOT lacking AND action_id NOT IN (SELECT action_id FROM within WHERE status = 'analyzed')
    UNION ALL SELECT action_id, NULL, CASE WHEN kind = 'rename_folder' THEN kind ELSE 'move' END, NULL, NULL, 'incomplete' FROM able WHERE lacking
    UNION ALL SELECT action_id, id, 'rename_folder', r.path, target, CASE WHEN r.path = target THEN 'no_change' WHEN id IS NULL THEN 'no_files' WHEN first IS DISTINCT FROM action_id THEN 'already_proposed' END FROM renames r LEFT JOIN ones ON ones.path = r.path)"""


def folder_actions(spark, sf_dir):
    """Suppliers in the role of actions."""
    k = F.col("s_suppkey")
    pick = lambda by, *of: F.element_at(F.array(*map(F.lit, of)), (k % by + 1).cast("int"))
    number = lambda by: (k % by).cast("string")
    source = F.concat(F.lit("src"), number(5))
    inner = F.concat_ws("/", source, pick(4, "en", "de", "fr", "es"))
    names = F.array(F.concat(F.lit("doc-"), number(20), F.lit(".txt")), F.concat(F.lit("notes_"), number(9), F.lit(".md")), F.lit(" IMG_0007.txt"), F.lit(""))
    return table(spark, sf_dir, "supplier").select(
        k.alias("action_id"),
        pick(7, "rename_folder", "move_files", "merge", "move", "rename_folder", "move_files", None).alias("action"),
        F.when(k % 9 == 8, None).when(k % 9 == 7, "none").when(k % 9 == 6, source).otherwise(inner).alias("source_folder"),
        F.when(k % 11 == 5, inner).when(k % 11 == 4, "").otherwise(F.concat(F.lit("Sorted  by/"), F.col("s_nationkey").cast("string"))).alias("destination_folder"),
        F.when(k % 6 == 5, "../").otherwise(F.concat(F.lit("root/New "), number(3))).alias("new_name"),
        names.alias("filenames"),
        pick(3, "all", "the,of", None).alias("file_filter"),
        F.when(k % 2 == 0, F.col("s_name")).alias("reasoning"),
        F.when(k % 4 != 3, (k % 13) / 10 - 0.1).alias("confidence"),
    )


@query(f""", {ACTIONS_SQL}, {DONE_SQL}, {READ_SQL} SELECT t.action_id, id AS file_id, proposal_type, path AS current_value, CASE WHEN rejected IS NULL THEN target END AS proposed_value,
  CASE WHEN rejected IS NULL THEN reasoning END AS reasoning, CASE WHEN rejected IS NULL THEN confidence END AS confidence, rejected FROM told t JOIN able USING (action_id)""")
def action_proposals(spark, sf_dir):
    f = files(spark, sf_dir)
    done = f.filter("id % 10 = 3").select(F.col("id").alias("file_id"), F.lit("move").alias("proposal_type"), F.col("path").alias("current_value"))
    done = done.union(spark.sql("SELECT CAST(NULL AS BIGINT), 'rename_folder', '/corpus/src2/en'"))
    return actions.action_proposals(folder_actions(spark, sf_dir), f.withColumn("ai_description", F.lit(None).cast("string")), done, "/corpus")


# ---------------------------------------------------------------- related groups

SETS_SQL = """members AS (SELECT session_id, dir || '#' || (id % 60) AS group_id, id AS place, filename, ['source', 'sibling', 'export', 'backup', 'version'][CAST(id % 5 AS INT) + 1] AS role,
    nullif(regexp_extract(stem, '^(\\d+(?:\\.\\d+)*)', 1), '') AS p FROM files),
  sets AS (SELECT session_id, group_id, CASE WHEN length(group_id) % 2 = 0 THEN group_id END AS reason, count(*) AS n, bool_or(role = 'source') AS src, CASE WHEN count(p) >= 2 AND min(p) = max(p) THEN min(p) END AS prefix FROM members GROUP BY ALL),
  led AS (SELECT *, CASE WHEN prefix IS NULL THEN group_id ELSE first_value(group_id) OVER w END AS main, CASE WHEN prefix IS NULL THEN 1 ELSE row_number() OVER w END AS turn FROM sets WINDOW w AS (PARTITION BY session_id, prefix ORDER BY NOT src, -n, group_id)),
  numbers AS (SELECT session_id, main, row_number() OVER (PARTITION BY session_id ORDER BY main) AS group_no FROM led WHERE main = group_id),
  placed AS (SELECT m.*, group_no, turn, row_number() OVER (PARTITION BY m.session_id, group_no, filename ORDER BY turn, place) AS copy FROM members m JOIN led l USING (session_id, group_id) JOIN numbers n ON n.session_id = l.session_id AND n.main = l.main)"""


def sets(spark, sf_dir):
    """Groups of files by folder and id, those with one number scattered over folders."""
    f = files(spark, sf_dir).withColumn("group_id", F.concat_ws("#", "dir", (F.col("id") % 60).cast("string")))
    role = F.element_at(F.array(*map(F.lit, ("source", "sibling", "export", "backup", "version"))), (F.col("id") % 5 + 1).cast("int"))
    members = f.select("session_id", "group_id", F.col("id").alias("place"), "filename", role.alias("role"))
    reason = F.when(F.length("group_id") % 2 == 0, F.col("group_id"))
    groups = f.select("session_id", "group_id").distinct().select("session_id", "group_id", F.col("group_id").alias("label"), reason.alias("reason"), F.lit(0.7).alias("confidence"))
    return groups, members


@query(f""", {SETS_SQL}, told AS (SELECT session_id, main, count(*) FILTER (turn = 1 OR reason <> '') AS k, trim(string_agg(coalesce(reason, ''), ' | ' ORDER BY turn) FILTER (turn = 1 OR reason <> ''), ' |') AS whole FROM led GROUP BY 1, 2),
  held AS (SELECT session_id, group_no, count(*) AS n FROM placed WHERE copy = 1 GROUP BY 1, 2)
SELECT t.session_id, CAST(n.group_no AS INT) AS group_no, t.main AS group_id, t.main AS label, CASE WHEN k = 1 THEN whole ELSE whole[1:500] END AS reason, 0.7::DOUBLE AS confidence, h.n FROM told t JOIN numbers n USING (session_id, main) JOIN held h ON h.session_id = n.session_id AND h.group_no = n.group_no""")
def merged_groups(spark, sf_dir):
    return relations.merged_groups(*sets(spark, sf_dir))[0].withColumn("group_no", F.col("group_no").cast("int"))


@query(f""", {SETS_SQL} SELECT session_id, CAST(group_no AS INT) AS group_no, CAST(row_number() OVER (PARTITION BY session_id, group_no ORDER BY turn, place) AS INT) AS place, filename, role FROM placed WHERE copy = 1""")
def merged_members(spark, sf_dir):
    return relations.merged_groups(*sets(spark, sf_dir))[1].withColumns({"group_no": F.col("group_no").cast("int"), "place": F.col("place").cast("int")})


@query(r""", groups AS (SELECT id AS group_id, session_id, ai_confidence AS confidence, CASE id % 4 WHEN 0 THEN 'project_' || (id % 30) || '_' || (id % 7) WHEN 1 THEN 'Report_' || lang WHEN 2 THEN 'quarterlies ' || (id % 50) ELSE lang || '_untitled' END AS label FROM files WHERE status = 'analyzed'),
  alone AS (SELECT id, session_id, regexp_extract(lower(stem), '^[0-9]+') AS number, regexp_extract(lower(stem), '(?:^|[^\pL\pN_])([a-z]{4,})(?:$|[^\pL\pN_])', 1) AS word FROM files WHERE status <> 'analyzed')
SELECT id, a.session_id, min(group_id) AS group_id, 'sibling' AS role FROM alone a JOIN groups g ON g.session_id = a.session_id AND confidence >= 0.5
  AND (number <> '' AND contains(lower(label), number) OR word <> '' AND starts_with(lower(label), word)) GROUP BY id, a.session_id""")
def linked_singletons(spark, sf_dir):
    f, k = files(spark, sf_dir), F.col("id")
    number = lambda by: (k % by).cast("string")
    label = F.when(k % 4 == 0, F.concat_ws("_", F.lit("project"), number(30), number(7))).when(k % 4 == 1, F.concat(F.lit("Report_"), "lang")).when(k % 4 == 2, F.concat(F.lit("quarterlies "), number(50))).otherwise(F.concat("lang", F.lit("_untitled")))
    groups = f.filter("status = 'analyzed'").select(k.alias("group_id"), "session_id", label.alias("label"), F.col("ai_confidence").alias("confidence"))
    return relations.link_singletons(f.filter("status <> 'analyzed'").select("id", "session_id", "stem"), groups)


# ---------------------------------------------------------------- names in several passes


@query(r""", tokens AS (SELECT DISTINCT unnest(regexp_extract_all(lower(stem), '[a-z]{5,}')) AS token FROM files), known AS (SELECT map(list(token), list(canonical)) AS m FROM (SELECT token, min(token) OVER (PARTITION BY length(token)) AS canonical FROM tokens)),
  parts AS (SELECT id, dir, extension, stem, regexp_extract_all(stem, '[a-zA-Z]{5,}') AS runs, string_split_regex(stem, '[a-zA-Z]{5,}') AS gaps FROM files),
  said AS (SELECT *, list_aggregate(list_transform(range(1, len(gaps) + 1), lambda i: gaps[i] || coalesce(m[lower(runs[i])], runs[i], '')), 'string_agg', '') AS new, len(list_filter(runs, lambda r: m[lower(r)] <> lower(r))) AS hits FROM parts, known)
SELECT id AS file_id, dir || '/' || new || extension AS proposed_value FROM said WHERE hits > 0""")
def respelled_renames(spark, sf_dir):
    """Words of files' names as spelling of the first word of their length."""
    f = files(spark, sf_dir)
    tokens = naming.token_frequency(f).select("token")
    first = tokens.groupBy(F.length("token").alias("length")).agg(F.min("token").alias("canonical"))
    canonical = tokens.withColumn("length", F.length("token")).join(first, "length").select("token", "canonical")
    return naming.respelled(f.select(F.col("id").alias("file_id"), F.col("path").alias("proposed_value")), canonical)


def composed_renames(spark, sf_dir, whole=False):
    f = described(spark, sf_dir)
    return f, passes.compose(f, passes.rename_passes("/corpus", groups(spark, sf_dir)), f.filter("id % 11 = 3").select(F.col("id").alias("file_id")), whole)


@query()
def final_renames(spark, sf_dir):
    """From files to the names they end with, by all passes; if one fails there is no result. ``rename_outcomes`` tells of each."""
    f, done = composed_renames(spark, sf_dir, whole=True)
    return passes.without_collisions(done.proposals, f)


@query()
def rename_outcomes(spark, sf_dir):
    return composed_renames(spark, sf_dir)[1].outcomes
