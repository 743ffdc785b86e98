"""Registered queries of a model's answers, folders with odd names and renames that are hard to tell apart."""

from __future__ import annotations

from pyspark.sql import functions as F

from filequarry.functions import replies, text
from filequarry.operators import folders, proposing, relations
from filequarry.plans.registry import files, query, table, with_best_date


@query("""SELECT doc_id, CASE WHEN doc_id % 5 < 3 THEN '{"id": ' || doc_id || ', "tags": ["' || coalesce(lang, '?') || '"]}' WHEN doc_id % 5 = 3 THEN '{"at": "C:\\\\dir ' || coalesce(lang, '?') || '"}' END AS json FROM documents""", uses_files=False)
def json_replies(spark, sf_dir):
    """JSON alone, fenced, amid the document's text, with a wrong escape, and the words of the text that hold none."""
    lang, body = F.coalesce("lang", F.lit("?")), F.coalesce("text", F.lit(""))
    own = F.concat(F.lit('{"id": '), F.col("doc_id").cast("string"), F.lit(', "tags": ["'), lang, F.lit('"]}'))
    broken = F.concat(F.lit('{"at": "C:\\dir '), lang, F.lit('"}'))
    words = F.concat(F.lit("Answer: "), F.regexp_replace(body, r"[\[{]", " "))
    reply = F.element_at(F.array(own, F.concat(F.lit("```json\n"), own, F.lit("\n```")), F.concat(F.lit("Sure: "), own, body, F.lit("{")), broken, words), (F.col("doc_id") % 5 + 1).cast("int"))
    return table(spark, sf_dir, "documents").select("doc_id", replies.json_of(reply).alias("json"))


@query(r"""SELECT id, list_aggregate(string_split(text, ' ')[1:9], 'string_agg', ' ') AS description, CASE WHEN id % 3 = 0 THEN [lang, 'k' || (id % 4), 'x'] WHEN id % 3 = 1 THEN [lang, source] ELSE [] END AS tags,
  source || '_' || lang AS suggested_name, CASE WHEN id % 2 = 0 THEN 0.25 ELSE 0.5 END::DOUBLE AS confidence,
  CASE id % 4 WHEN 0 THEN strftime(date_modified, '%Y-%m-%d') WHEN 1 THEN strftime(date_modified, '%Y-%m-01') WHEN 2 THEN strftime(date_modified, '%Y-01-01') END AS day FROM files""")
def reply_fields(spark, sf_dir):
    kind = F.col("id") % 3
    listed = F.to_json(F.array("lang", F.concat(F.lit("k"), (F.col("id") % 4).cast("string")), F.lit("x")))
    tags = F.when(kind == 0, listed).when(kind == 1, F.concat(F.lit('" '), "lang", F.lit(",, "), "source", F.lit(' "')))
    shape = F.element_at(F.array(*(F.date_format("date_modified", p) for p in ("yyyy-MM-dd'T'HH:mm", "yyyy-MM", "yyyy", "'on' dd"))), (F.col("id") % 4 + 1).cast("int"))
    said = F.to_json(F.struct(F.concat(F.lit(" "), F.array_join(F.slice(F.split("text", " "), 1, 9), " ")).alias("description"), F.concat("source", F.lit(" / "), "lang", F.lit(".")).alias("suggested_name"), F.when(F.col("id") % 2 == 0, 0.25).alias("confidence"), shape.alias("date")))
    json = F.concat(F.lit("{"), F.coalesce(F.concat(F.lit('"tags":'), tags, F.lit(",")), F.lit("")), F.substring(said, F.lit(2), F.length(said)))
    f = files(spark, sf_dir).select("id", json.alias("json"))
    got = f.select("id", *(c.alias(k) for k, c in replies.fields(F.col("json")).items()))
    return got.select("id", "description", "tags", "suggested_name", "confidence", F.date_format("detected_date", "yyyy-MM-dd").alias("day"))


@query("""SELECT * FROM (SELECT min(id) AS file_id, '/corpus/ùìåí_' || source[4:] AS current_value, '/corpus/שלום_' || source[4:] AS proposed_value, 0.75::DOUBLE AS confidence FROM files GROUP BY source
UNION ALL SELECT min(id), '/corpus/ùìåí_' || source[4:] || '/Ðîññèÿ', '/corpus/ùìåí_' || source[4:] || '/Россия', 0.75::DOUBLE FROM files WHERE lang = 'de' GROUP BY source) WHERE NOT current_value LIKE '%\\_1' ESCAPE '\\'""")
def garbled_folders(spark, sf_dir):
    place = F.concat(F.lit("/corpus/ùìåí_"), F.substring("source", 4, 9), F.lit("/"), F.when(F.col("lang") == "de", "Ðîññèÿ").when(F.col("lang") == "fr", "Français").otherwise(F.col("lang")))
    done = files(spark, sf_dir).filter("source = 'src1'").select(F.lit("/corpus/ùìåí_1").alias("current_value")).distinct()
    return proposing.garbled_folders(files(spark, sf_dir).withColumn("dir", place), "/corpus", done)


ODD_SQL = f""", placed AS (SELECT id, '/corpus/' || CASE WHEN source IN ('src2', 'src3') THEN source || ' files' WHEN source = 'src1' THEN 'קבצים-1' ELSE source END AS outer_dir,
  CASE WHEN lang = 'de' THEN '漢字' WHEN lang = 'fr' THEN 'fr-1' WHEN lang = 'es' THEN '_es' ELSE lang END AS inner_name, CASE WHEN source IN ('src3', 'src4') THEN ai_tags END AS tags FROM files),
under AS (SELECT id, outer_dir AS path, regexp_extract(outer_dir, '[^/]+$') AS name, tags FROM placed UNION ALL SELECT id, outer_dir || '/' || inner_name, inner_name, tags FROM placed),
odd AS (SELECT path, name, min(id) AS id FROM under WHERE regexp_matches(name, '[^a-zA-Z0-9]') AND name <> '_es' GROUP BY ALL),
raw AS (SELECT id, path, unnest(tags) AS tag, generate_subscripts(tags, 1) AS place FROM under),
tok AS (SELECT id, path, place, regexp_replace(regexp_replace(regexp_replace(lower(tag), '[^a-z0-9_]', '_', 'g'), '_+', '_', 'g'), '^_+|_+$', '', 'g') AS token FROM raw),
ranked AS (SELECT path, token, row_number() OVER (PARTITION BY path ORDER BY count(*) DESC, min((id, place))) AS k FROM tok WHERE length(token) >= 3 AND token NOT IN ({", ".join("'" + w + "'" for w in text.FOLDER_TAGS_DROPPED)}) GROUP BY path, token),
tagged AS (SELECT path, string_agg(token, '_' ORDER BY k) AS t FROM ranked WHERE k <= 3 GROUP BY path),
named AS (SELECT odd.*, coalesce(t, CASE WHEN name = 'fr-1' THEN 'fr_1' WHEN name LIKE 'src%' THEN replace(name, ' ', '_') WHEN name = 'קבצים-1' THEN 'kbtzym_1' END) AS new FROM odd LEFT JOIN tagged ON tagged.path = odd.path),
counted AS (SELECT *, row_number() OVER (PARTITION BY new IS NULL ORDER BY string_split(path, '/')) AS n FROM named)
SELECT id AS file_id, path AS current_value, regexp_extract(path, '^(.*)/[^/]*$', 1) || '/' || coalesce(new, 'non_latin_folder_' || n) AS proposed_value, CASE WHEN new IS NULL THEN 0.5 ELSE 0.6 END::DOUBLE AS confidence FROM counted"""


@query(ODD_SQL)
def nonlatin_folders(spark, sf_dir):
    outer = F.when(F.col("source").isin("src2", "src3"), F.concat("source", F.lit(" files"))).when(F.col("source") == "src1", "קבצים-1").otherwise(F.col("source"))
    inner = F.when(F.col("lang") == "de", "漢字").when(F.col("lang") == "fr", "fr-1").when(F.col("lang") == "es", "_es").otherwise(F.col("lang"))
    tags = F.when(F.col("source").isin("src3", "src4"), F.col("ai_tags"))
    f = files(spark, sf_dir).withColumns({"dir": F.concat_ws("/", F.lit("/corpus"), outer, inner), "ai_tags": tags})
    none = f.filter("false").select(F.col("dir").alias("current_value"))
    return proposing.nonlatin_folders(f, "/corpus", none)


def slugged(spark, sf_dir):
    """A rename of every file to the slug of its stem."""
    return files(spark, sf_dir).select(F.col("id").alias("file_id"), F.concat("dir", F.lit("/"), text.slug(F.col("stem")), F.lower("extension")).alias("proposed_value"))


@query()
def told_apart(spark, sf_dir):
    return proposing.told_apart(files(spark, sf_dir), slugged(spark, sf_dir))


@query()
def near_duplicate_proposals(spark, sf_dir):
    """A folder for each language and sizes in thousands of bytes, so that there are files of one size."""
    f = files(spark, sf_dir)
    renames = f.select(F.col("id").alias("file_id"), F.concat(F.lit("/corpus/"), "lang", F.lit("/"), text.slug(F.col("stem")), F.lower("extension")).alias("proposed_value"))
    return proposing.near_duplicate_proposals(f.withColumn("size_bytes", F.floor(F.col("size_bytes") / 1000)), renames)


GROUP = "CASE WHEN id % 4 = {k} OR id % 3 = 0 AND (id + 1) % 4 = {k} THEN true ELSE false END"
STEPS_SQL = ", ".join(
    f"""l{k} AS (SELECT r, filename, arg_min(role, spot) AS role FROM a WHERE ({GROUP.format(k=k)}) {"AND (r, filename) NOT IN (SELECT (r, filename) FROM t%d)" % (k - 1) if k else ""} GROUP BY r, filename),
g{k} AS (SELECT {k} AS place, l.* FROM l{k} l JOIN (SELECT r FROM l{k} GROUP BY r HAVING count(*) >= 2) USING (r)),
t{k} AS ({f"SELECT * FROM t{k - 1} UNION ALL " if k else ""}SELECT r, filename FROM g{k})"""
    for k in range(4)
)


@query(f""", a AS (SELECT id, id AS spot, filename, dir || '#' || (id // 50) AS r, ['source', 'sibling', 'sibling', 'backup'][CAST(id % 4 AS INT) + 1] AS role FROM files WHERE id % 7 <> 0), {STEPS_SQL}
SELECT r AS response_id, 'set_' || place AS label, filename, role FROM ({" UNION ALL ".join(f"SELECT * FROM g{k}" for k in range(4))})""")
def valid_groups(spark, sf_dir):
    """Answers on fifty ids of a folder each; one file in seven wasn't asked about."""
    f = files(spark, sf_dir).withColumn("response_id", F.concat_ws("#", "dir", F.floor(F.col("id") / 50)))
    role = F.element_at(F.array(*map(F.lit, ("Source", "sibling", "made up", "backup"))), (F.col("id") % 4 + 1).cast("int"))
    member = F.struct("id", "filename", role.alias("role"))
    groups = [F.array_sort(F.collect_list(F.when(F.expr(GROUP.format(k=k)), member))) for k in range(4)]
    groups = [F.struct(F.lit(f"Set {k}").alias("label"), F.lit("alike").alias("reason"), F.transform(g, lambda m: F.struct(m["filename"].alias("filename"), m["role"].alias("role"))).alias("members")) for k, g in enumerate(groups)]
    responses = f.groupBy("response_id").agg(F.array(*groups).alias("groups"))
    found = relations.valid_groups(responses, f.filter("id % 7 <> 0"))
    return found.select("response_id", "label", F.explode("members").alias("m")).select("response_id", "label", "m.filename", "m.role")


SIBLINGS_SQL = """, two AS (SELECT a.id, b.filename, lower(a.extension) <> lower(b.extension) AS other, row_number() OVER (PARTITION BY a.id, lower(a.extension) <> lower(b.extension) ORDER BY b.filename, b.id) AS k FROM files a JOIN files b ON a.dir = b.dir AND a.id <> b.id),
near AS (SELECT id, list(filename ORDER BY other, k) AS names FROM two WHERE k <= 7 GROUP BY id)"""


@query(f"{SIBLINGS_SQL} SELECT f.id, coalesce(names, []) AS names FROM files f LEFT JOIN near ON near.id = f.id")
def sibling_names(spark, sf_dir):
    return folders.siblings(files(spark, sf_dir))


@query(rf"""{SIBLINGS_SQL} SELECT f.id, 'Folder path: corpus / ' || source || ' / ' || lang || E'\nFolder keywords: ' || lang || ', ' || source || ', corpus' || E'\nFilename: ' || filename
  || coalesce(E'\nFilename keywords: ' || nullif(list_aggregate(list_filter(string_split_regex(regexp_replace(stem, '([a-z])([A-Z])', '\1 \2', 'g'), '[\W_]+'), lambda w: length(w) > 1), 'string_agg', ', '), ''), '')
  || E'\nDate (best guess): ' || strftime(coalesce(date_exif, date_modified), '%Y-%m-%d') || CASE WHEN mime_type <> '' THEN E'\nFile type: ' || mime_type ELSE '' END
  || CASE WHEN size_bytes >= 1048576 THEN E'\nFile size: ' || format('{{:.1f}} MB', size_bytes / 1048576.0::DOUBLE) WHEN size_bytes > 0 THEN E'\nFile size: ' || format('{{:.0f}} KB', size_bytes / 1024.0::DOUBLE) ELSE '' END
  || coalesce(E'\nOther files in same folder: ' || list_aggregate(names, 'string_agg', ', '), '') AS context FROM files f LEFT JOIN near ON near.id = f.id""")
def context_texts(spark, sf_dir):
    f = with_best_date(files(spark, sf_dir))
    told = F.array().cast("array<struct<name:string,description:string>>")
    near = folders.siblings(f)
    return f.join(near, "id").select("id", text.context(F.col("path"), F.col("date_best"), F.col("date_modified"), F.col("mime_type"), F.col("size_bytes"), F.col("names"), told).alias("context"))
