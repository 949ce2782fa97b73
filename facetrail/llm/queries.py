"""Queries of the llm problems, and SQL for those it can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from facetrail.llm.canon import candidates, map_values, typed_relations
from facetrail.llm.cooccur import associations, faces_of_photos
from facetrail.llm.mixing import mix_sources
from facetrail.llm.names import linked_records, same_person
from facetrail.llm.setjoin import record_sets, similar_records, similar_sets
from facetrail.llm.splitting import split_texts
from facetrail.llm.tokens import encode_corpus
from facetrail.llm.topn import best_names
from facetrail.session import table


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return linked_records(table(spark, d, "name_clusters"), table(spark, d, "target_persons"))


def p1_persons(spark: SparkSession, d: str) -> DataFrame:
    """Every record that names somebody with its person."""
    return same_person(table(spark, d, "name_clusters"), table(spark, d, "target_persons"))


def p1_surfaces(spark: SparkSession, d: str) -> DataFrame:
    """Every surface of an album's texts with its person: the id of a cluster or registered person, or the surface itself."""
    who = same_person(*[table(spark, d, t) for t in ("name_clusters", "target_persons", "text_units")])
    return who.where("startswith(rec, '~')").select("user_id", F.expr("substring(rec, 2)").alias("surface"), "person")


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return best_names(table(spark, d, "identity_edges"), 3).select("user_id", "face_id", "edge_id")


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    baskets = faces_of_photos(table(spark, d, "photos"), table(spark, d, "face_units"))
    pairs = associations(baskets, "user_id", "photo_id", "faces", min_count=5, min_lift=2.0)
    return pairs.select("user_id", F.col("item_a").alias("face_a"), F.col("item_b").alias("face_b"))


def p4_lift(spark: SparkSession, d: str) -> DataFrame:
    baskets = faces_of_photos(table(spark, d, "photos"), table(spark, d, "face_units"))
    pairs = associations(baskets, "user_id", "photo_id", "faces")
    return pairs.select("user_id", F.col("item_a").alias("face_a"), F.col("item_b").alias("face_b"), "n_ab", "n_a", "n_b", "n_baskets", F.round("lift", 6).alias("lift"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    typed = typed_relations(table(spark, d, "predicted_persons"), table(spark, d, "target_persons"))
    mapped = map_values(typed, "value", table(spark, d, "relation_entries"), "kind", ["from_table", "row_id", "field_name"])
    return mapped.select("from_table", "row_id", "field_name", "entry_id").distinct()


def p5_candidates(spark: SparkSession, d: str) -> DataFrame:
    """Every entry within the distance of every distinct typed value of its kind, and the edits to it."""
    typed = typed_relations(table(spark, d, "predicted_persons"), table(spark, d, "target_persons")).select("kind", "value").distinct()
    return candidates(typed, "value", table(spark, d, "relation_entries"), "kind")


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    pairs = similar_records(table(spark, d, "event_nodes"), "event_id", TERMS, 0.6, 4)
    return pairs.select(F.col("id_a").alias("event_a"), F.col("id_b").alias("event_b"))


TERMS = ["terms", "activity_terms", "venue_terms"]


def p6_set_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of different sets of values, each by the least event that has it; p6_members tells all events of a set."""
    sets, _ = record_sets(table(spark, d, "event_nodes"), "event_id", TERMS, 4)
    return similar_sets(sets, 0.6)


def p6_members(spark: SparkSession, d: str) -> DataFrame:
    return record_sets(table(spark, d, "event_nodes"), "event_id", TERMS, 4)[1]


def p7_ids(spark: SparkSession, d: str) -> DataFrame:
    return encode_corpus(table(spark, d, "documents"), "doc_id", "text")


def p8_mix(spark: SparkSession, d: str) -> DataFrame:
    return mix_sources(table(spark, d, "documents"), table(spark, d, "mix_targets"))[0]


def p8_shares(spark: SparkSession, d: str) -> DataFrame:
    return mix_sources(table(spark, d, "documents"), table(spark, d, "mix_targets"))[1]


def p8_languages(spark: SparkSession, d: str) -> DataFrame:
    """What each language of a source had to give to a mix, was to give, and gave."""
    return mix_sources(table(spark, d, "documents"), table(spark, d, "mix_targets"))[2]


def p9_pieces(spark: SparkSession, d: str) -> DataFrame:
    return split_texts(table(spark, d, "documents"), table(spark, d, "split_settings"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (p1_found, p1_persons, p1_surfaces, p3_found, p4_found, p4_lift, p5_found, p5_candidates, p6_found, p6_set_pairs, p6_members, p7_ids, p8_mix, p8_shares, p8_languages, p9_pieces)}


P3_SQL = """
WITH valid AS (
  SELECT user_id, face_id, lower(trim(name_surface)) AS name, score, edge_id FROM identity_edges
  WHERE score >= 0 AND score <= 1 AND NOT isnan(score) AND trim(name_surface) <> ''),
best AS (
  SELECT user_id, face_id, name, score, edge_id,
    row_number() OVER (PARTITION BY user_id, face_id, name ORDER BY score DESC, edge_id) AS k FROM valid),
ranked AS (
  SELECT user_id, face_id, edge_id, row_number() OVER (PARTITION BY user_id, face_id ORDER BY score DESC, name) AS r
  FROM best WHERE k = 1)
SELECT user_id, face_id, edge_id FROM ranked WHERE r <= 3
"""

P4_PAIRS = """
WITH listed AS (
  SELECT user_id, photo_id, unnest(visible_face_ids) AS face FROM photos
  UNION ALL SELECT user_id, photo_id, face_id FROM face_units
  UNION ALL SELECT user_id, photo_id, unnest(co_faces) FROM face_units),
seen AS (SELECT DISTINCT user_id, photo_id, face FROM listed WHERE face IS NOT NULL AND photo_id IS NOT NULL),
total AS (SELECT user_id, count(DISTINCT photo_id) AS n FROM seen GROUP BY user_id),
single AS (SELECT user_id, face, count(*) AS n FROM seen GROUP BY user_id, face),
pair AS (
  SELECT a.user_id, a.face AS fa, b.face AS fb, count(*) AS n
  FROM seen a JOIN seen b ON a.user_id = b.user_id AND a.photo_id = b.photo_id AND a.face < b.face
  GROUP BY a.user_id, a.face, b.face)
"""
P4_SQL = P4_PAIRS + """
SELECT p.user_id, p.fa AS face_a, p.fb AS face_b FROM pair p
JOIN single a ON a.user_id = p.user_id AND a.face = p.fa JOIN single b ON b.user_id = p.user_id AND b.face = p.fb
JOIN total t ON t.user_id = p.user_id WHERE p.n >= 5 AND p.n * t.n >= 2 * a.n * b.n
"""
P4_LIFT_SQL = P4_PAIRS + """
SELECT p.user_id, p.fa AS face_a, p.fb AS face_b, p.n AS n_ab, a.n AS n_a, b.n AS n_b, t.n AS n_baskets,
  round(p.n * t.n / (a.n * b.n)::DOUBLE, 6) AS lift FROM pair p
JOIN single a ON a.user_id = p.user_id AND a.face = p.fa JOIN single b ON b.user_id = p.user_id AND b.face = p.fb
JOIN total t ON t.user_id = p.user_id
"""


P6_SETS = """
WITH raw AS (
  SELECT event_id, list_concat(list_concat(coalesce(terms, []), coalesce(activity_terms, [])), coalesce(venue_terms, [])) AS t FROM event_nodes WHERE event_id IS NOT NULL),
clean AS (SELECT event_id, min(list_sort(list_distinct(list_filter(list_transform(t, lambda x: lower(trim(x))), lambda x: x <> '')))) AS items FROM raw GROUP BY event_id),
sized AS (SELECT event_id, items, len(items) AS n FROM clean WHERE len(items) >= 4)
"""
P6_SQL = P6_SETS + """,
item AS (SELECT event_id, n, unnest(items) AS v FROM sized),
pair AS (
  SELECT a.event_id AS event_a, b.event_id AS event_b, a.n AS na, b.n AS nb, count(*) AS c FROM item a JOIN item b ON a.v = b.v AND a.event_id < b.event_id
  GROUP BY ALL)
SELECT event_a, event_b FROM pair WHERE c * 10 >= 6 * (na + nb - c)
"""
P6_SET_PAIRS_SQL = P6_SETS + """,
sets AS (SELECT min(event_id) AS rep, items, len(items) AS n FROM sized GROUP BY items),
item AS (SELECT rep, n, unnest(items) AS v FROM sets),
pair AS (SELECT a.rep AS rep_a, b.rep AS rep_b, count(*) AS common, a.n + b.n - count(*) AS either FROM item a JOIN item b ON a.v = b.v AND a.rep < b.rep GROUP BY a.rep, b.rep, a.n, b.n)
SELECT rep_a, rep_b, common, either FROM pair WHERE common * 10 >= 6 * either
"""
P6_MEMBERS_SQL = P6_SETS + "SELECT event_id AS id, min(event_id) OVER (PARTITION BY items) AS rep FROM sized"


def oracle_sql() -> dict[str, str]:
    return {"p6_found": P6_SQL, "p6_set_pairs": P6_SET_PAIRS_SQL, "p6_members": P6_MEMBERS_SQL, "p3_found": P3_SQL, "p4_found": P4_SQL, "p4_lift": P4_LIFT_SQL}
