"""Registered queries of folder profiles and the folder tree."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from filequarry.functions import paths
from filequarry.operators import profile
from filequarry.plans.proposed import described
from filequarry.plans.registry import CATEGORY_SQL, query

PLACED_SQL = f"""placed AS (SELECT id, filename, size_bytes, {CATEGORY_SQL} AS category,
  CASE id % 9 WHEN 0 THEN '/corpus' WHEN 1 THEN '/corpus/' || source WHEN 2 THEN dir || '/old papers' ELSE dir END AS dir,
  CASE WHEN id % 4 = 3 THEN NULL WHEN id % 16 = 6 THEN 'Could not open the file' ELSE list_aggregate(string_split(text, ' ')[1:9], 'string_agg', ' ') END AS description,
  CASE WHEN id % 4 = 3 THEN [] WHEN id % 8 = 4 THEN ['photo place', 'image'] ELSE coalesce(list_transform(ai_tags, lambda t: lower(t)), []) END AS tags FROM files WHERE id % 13 <> 0),
words AS (SELECT id, dir, list_filter(list_transform(list_filter(string_split_regex(lower(description), '\\s+'), lambda w: w <> '')[1:10], lambda w: trim(w, '.,;:!?"()[]''')), lambda w: length(w) > 3) AS words FROM placed),
items AS (SELECT 'category' AS kind, dir, category AS item, id, 0 AS pos FROM placed
  UNION ALL SELECT 'tag', dir, unnest(tags[1:5]), id, generate_subscripts(tags[1:5], 1) FROM placed
  UNION ALL SELECT 'word', dir, unnest(words), id, generate_subscripts(words, 1) FROM words),
counted AS (SELECT dir, kind, item, n, row_number() OVER (PARTITION BY dir, kind ORDER BY n DESC, first, item) AS place FROM (SELECT dir, kind, item, count(*) AS n, min((id, pos)) AS first FROM items GROUP BY ALL)),
dirs AS (SELECT DISTINCT dir FROM placed),
inner_dirs AS (SELECT d.dir, list(regexp_extract(c.dir, '[^/]*$') ORDER BY regexp_extract(c.dir, '[^/]*$')) AS children FROM dirs d JOIN dirs c ON regexp_replace(c.dir, '/[^/]*$', '') = d.dir GROUP BY d.dir),
totals AS (SELECT dir, count(*) AS n, CAST(sum(size_bytes) AS BIGINT) AS bytes, list(filename ORDER BY id)[1:5] AS samples FROM placed GROUP BY dir),
tops AS (SELECT dir, coalesce(list(item ORDER BY place) FILTER (kind = 'tag' AND place <= 8), []) AS tags, coalesce(list(item ORDER BY place) FILTER (kind = 'word' AND place <= 5), []) AS words,
  list(item ORDER BY place) FILTER (kind = 'category') AS names, list(n ORDER BY place) FILTER (kind = 'category') AS counts FROM counted GROUP BY dir),
folders AS (SELECT t.*, p.* EXCLUDE (dir), coalesce(children, []) AS children FROM totals t JOIN tops p ON p.dir = t.dir LEFT JOIN inner_dirs i ON i.dir = t.dir)"""


def sized(x: str) -> str:
    """A size for display in SQL, up to MB; larger ones as GB."""
    shown = lambda k, u: f"CASE WHEN {x} % {1 << 10 * k} = 0 THEN ({x} // {1 << 10 * k}) || ' {u}' ELSE format('{{:.1f}} {u}', {x} / {1 << 10 * k}.0::DOUBLE) END"
    return "CASE " + " ".join(f"WHEN {x} < {1 << 10 * (k + 1)} THEN {shown(k, u)}" for k, u in enumerate(("B", "KB", "MB"))) + f" ELSE {shown(3, 'GB')} END"


TREE_SQL = f""", {PLACED_SQL},
odd AS (SELECT p.*, f.names[1] AS top, f.n, coalesce(p.dir <> '/corpus' AND counts[1] >= 0.6 * f.n AND p.category <> f.names[1], false) AS by_category,
  len(p.tags) > 0 AND len(f.tags) > 0 AND NOT list_has_any(p.tags, f.tags) AS by_tags FROM placed p JOIN folders f ON f.dir = p.dir),
chosen AS (SELECT *, row_number() OVER (PARTITION BY dir ORDER BY CASE WHEN dir = '/corpus' THEN len(tags) = 0 ELSE NOT by_category END, size_bytes DESC, id) AS rank FROM odd WHERE dir = '/corpus' OR n >= 4 AND (by_category OR by_tags)),
below AS (SELECT dir, string_agg('    OUTLIER: ' || filename || ' (' || {sized('size_bytes')} || ', ' || category || CASE WHEN len(tags) > 0 THEN ', tags=[' || array_to_string(tags[1:5], ', ') || ']' ELSE '' END || ') — '
  || CASE WHEN dir = '/corpus' THEN 'loose file at archive root — needs subfolder assignment' ELSE concat_ws('; ', CASE WHEN by_category THEN 'type=' || category || ' (folder is ' || top || ')' END, CASE WHEN by_tags THEN 'tags unrelated to folder theme' END) END, chr(10) ORDER BY rank) AS below
  FROM chosen WHERE rank <= CASE WHEN dir = '/corpus' THEN 20 ELSE 5 END GROUP BY dir)
SELECT row_number() OVER (ORDER BY f.dir) AS place, f.dir, concat_ws(chr(10), '[' || CASE WHEN f.dir = '/corpus' THEN '(root)' ELSE substr(f.dir, 9) END || ']  ' || n || ' files, ' || {sized('bytes')} || '  |  '
  || array_to_string(list_transform(names, lambda c, i: CAST(floor(counts[i] / n * 100) AS INT) || '% ' || c), ', ')
  || CASE WHEN len(tags) > 0 THEN '  |  Tags: ' || array_to_string(tags[1:5], ', ') ELSE '' END || CASE WHEN len(words) > 0 THEN '  |  Keywords: ' || array_to_string(words[1:3], ', ') ELSE '' END
  || CASE WHEN len(children) > 0 THEN '  |  Subfolders: ' || array_to_string(children[1:8], ', ') ELSE '' END || '  |  Examples: ' || array_to_string(samples[1:3], ', '), below) AS text FROM folders f LEFT JOIN below b ON b.dir = f.dir"""


def placed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files with descriptions, some at the root, some between, some deeper, some skipped."""
    f, k = described(spark, sf_dir), F.col("id") % 9
    place = F.when(k == 0, "/corpus").when(k == 1, F.concat(F.lit("/corpus/"), "source")).when(k == 2, F.concat("dir", F.lit("/old papers"))).otherwise(F.col("dir"))
    status = F.when(F.col("id") % 13 == 0, "skipped").otherwise(F.col("status"))
    return f.withColumns({"dir": place, "status": status, "category": paths.category(F.col("mime_type"), F.col("extension"))})


@query(f", {PLACED_SQL} SELECT dir, n, bytes, names, counts, tags, words, samples, children[1:8] AS children, CAST(len(children) AS BIGINT) AS n_children FROM folders")
def folder_profiles(spark, sf_dir):
    out = profile.profiles(placed(spark, sf_dir))
    return out.select("dir", "n", "bytes", F.transform("categories", lambda c: c["item"]).alias("names"), F.transform("categories", lambda c: c["n"]).alias("counts"), "tags", "words", "samples", "children", "n_children")


@query(TREE_SQL)
def folder_tree_text(spark, sf_dir):
    return profile.tree(placed(spark, sf_dir), "/corpus")
