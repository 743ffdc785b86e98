"""Registered queries of duplicates of several kinds: groups with their similarity, keepers, and proposals to mark them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from filequarry.operators import dedup
from filequarry.plans.registry import EXACT_SQL, GREEDY_SQL, dated, query, signs

#: Bits in which pictures that are alike may differ.
NEAR_BITS = 8
#: The hash ``bits`` with the one at a place that depends on the id turned over; the same text in both engines.
TURNED = "concat(substr(bits, 1, {p} - 1), translate(substr(bits, {p}, 1), '01', '10'), substr(bits, {p} + 1))"
PLACES = ("CAST(id % 13 + 1 AS INT)", "CAST(id % 29 + 20 AS INT)")
#: Pictures and films of 28 ids in turn are copies of one vector with two bits turned.
PERCEPTUAL_SQL = f"""vectors AS (SELECT vec_id, list_aggregate(list_transform(embedding, lambda x: CASE WHEN x > 0 THEN '1' ELSE '0' END), 'string_agg', '') AS bits FROM embeddings),
copies AS (SELECT id, bits FROM files JOIN vectors ON vec_id = id - id % 28 WHERE starts_with(mime_type, 'image/') OR starts_with(mime_type, 'video/')),
signs AS (SELECT id, {TURNED.format(p=PLACES[1])} AS bits FROM (SELECT id, {TURNED.format(p=PLACES[0])} AS bits FROM copies)),
edges AS (SELECT x.id AS a, y.id AS b FROM signs x JOIN signs y ON x.id < y.id AND hamming(x.bits, y.bits) <= {NEAR_BITS}),
alike AS (WITH RECURSIVE {GREEDY_SQL}), seen AS (SELECT anchor, member AS id FROM alike UNION SELECT anchor, anchor FROM alike)"""
KEPT_SQL = """kept AS (SELECT anchor, arg_min(f.id, (date_modified, -length(path), -size_bytes, f.id)) AS keep_id FROM seen JOIN files f ON f.id = seen.id GROUP BY anchor)"""


def pictures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """kind, group_id, file_id, similarity, n of groups of pictures and films that are alike."""
    seen = dated(spark, sf_dir).filter("mime_type LIKE 'image/%' OR mime_type LIKE 'video/%'").selectExpr("id", "id - id % 28 AS vec")
    own = seen.join(signs(spark, sf_dir).withColumnRenamed("id", "vec"), "vec").filter("bits IS NOT NULL").select("id", "bits")
    for place in PLACES:
        own = own.select("id", F.expr(TURNED.format(p=place)).alias("bits"))
    return dedup.group_members(dedup.class_groups(dedup.classes(own, "bits"), dedup.hamming_pairs(own, NEAR_BITS)), "perceptual")


@query(f", {PERCEPTUAL_SQL}, {KEPT_SQL} SELECT seen.anchor AS group_id, seen.id AS file_id, keep_id, 0.95::DOUBLE AS similarity, count(*) OVER (PARTITION BY seen.anchor) AS n FROM seen JOIN kept ON kept.anchor = seen.anchor", recursive=True)
def dup_perceptual_members(spark, sf_dir):
    return dedup.with_keepers(pictures(spark, sf_dir), dated(spark, sf_dir)).select("group_id", "file_id", "keep_id", "similarity", "n")


@query(f""", exact AS ({EXACT_SQL}), {PERCEPTUAL_SQL}, {KEPT_SQL},
all_members AS (SELECT 'exact' AS kind, 1 AS o, e.hash_md5 AS name, f.id, keep_id FROM exact e JOIN files f ON f.hash_md5 = e.hash_md5
  UNION ALL SELECT 'perceptual', 2, CAST(seen.anchor AS VARCHAR), seen.id, keep_id FROM seen JOIN kept ON kept.anchor = seen.anchor),
chosen AS (SELECT id, kind, keep_id FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY o, name) AS k FROM all_members WHERE id <> keep_id AND id % 9 <> 0) WHERE k = 1)
SELECT c.id AS file_id, kind, f.path AS current_value, g.path AS proposed_value, CASE kind WHEN 'exact' THEN 1.0 ELSE 0.95 END::DOUBLE AS confidence,
  CASE kind WHEN 'exact' THEN 'exact byte-for-byte duplicate (similarity=1.00)' ELSE 'perceptual near-duplicate (visually identical) (similarity=0.95)' END || '. Will be moved to trash. Keeper: ' || g.path AS reasoning
FROM chosen c JOIN files f ON f.id = c.id JOIN files g ON g.id = c.keep_id""", recursive=True)
def dup_marks(spark, sf_dir):
    """Proposals from exact groups, which have their keepers, and from pictures that are alike, of files not marked before."""
    f = dated(spark, sf_dir)
    exact = dedup.exact_members(f).select(F.lit("exact").alias("kind"), F.col("hash_md5").alias("group_id"), "file_id", "keep_id", "similarity")
    alike = dedup.with_keepers(pictures(spark, sf_dir), f).select("kind", F.col("group_id").cast("string").alias("group_id"), "file_id", "keep_id", "similarity")
    return dedup.marks(exact.unionByName(alike), f.filter("id % 9 = 0").select(F.col("id").alias("file_id")), f)
