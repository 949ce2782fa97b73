"""Queries over albums: registries, owners, episodes, nodes, bridges, pair scores."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from facetrail.operators import albums as A
from facetrail.session import table


def _t(spark: SparkSession, d: str, *names: str) -> list[DataFrame]:
    return [table(spark, d, n) for n in names]


def registry_rebuild(spark: SparkSession, d: str) -> DataFrame:
    return A.face_registry(*_t(spark, d, "photos"))


def owner_argmax(spark: SparkSession, d: str) -> DataFrame:
    return A.owner_faces(*_t(spark, d, "photos"))


def owner_names_ranked(spark: SparkSession, d: str) -> DataFrame:
    return A.owner_names(*_t(spark, d, "text_units")).select("user_id", "name", F.round("score", 3).alias("score"), "mentions", "n_photos", "is_full", "rank")


def home_city(spark: SparkSession, d: str) -> DataFrame:
    (p,) = _t(spark, d, "photos")
    return A.home_cities(p, A.owner_faces(p))


def episode_rollup(spark: SparkSession, d: str) -> DataFrame:
    return A.episodes(*_t(spark, d, "photos"))


def co_face_clues(spark: SparkSession, d: str) -> DataFrame:
    return A.co_face_clues(*_t(spark, d, "photos"))


def event_nodes_rebuilt(spark: SparkSession, d: str) -> DataFrame:
    return A.rebuilt_nodes(*_t(spark, d, "photos", "text_units"))


def same_photo_weight(spark: SparkSession, d: str) -> DataFrame:
    return A.same_photo_weights(*_t(spark, d, "photos", "name_clusters")).withColumn("weight", F.round("weight", 9))


def bridge_counts(spark: SparkSession, d: str) -> DataFrame:
    """Bridges of every album by kind; counted by spot and date, as A.bridge_counts does."""
    faces, texts = _t(spark, d, "face_units", "text_units")
    one = texts.select("user_id", F.lit("").alias("cluster_id"), F.col("photo_id").alias("text_photo")).distinct()
    kinds = F.array(*[F.struct(F.lit(b).alias("bridge"), F.col(c).alias("n")) for b, c in zip(A.BRIDGES, ("strict", "city", "near"))])
    rows = A.bridge_counts(faces, texts, one).select("user_id", "face_id", F.explode(kinds).alias("b")).where("b.n > 0")
    return rows.groupBy("user_id", "b.bridge").agg(F.sum("b.n").alias("n"), F.count_distinct("face_id").alias("n_faces"))


def activity_overlap(spark: SparkSession, d: str) -> DataFrame:
    return A.multiset_overlap(*_t(spark, d, "face_units", "name_clusters"), "activity_terms")


def identity_pair_score(spark: SparkSession, d: str) -> DataFrame:
    return A.pair_scores(*_t(spark, d, "photos", "face_units", "text_units", "name_clusters"))


def edge_margin(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "identity_edges").where("score >= 0 and score <= 1 and not isnan(score) and trim(name_surface) <> ''").select("user_id", "face_id", F.lower(F.trim("name_surface")).alias("name"), "score")
    best = e.groupBy("user_id", "face_id", "name").agg(F.max("score").alias("score"))
    out = A.with_margin(best, ["user_id", "face_id"], "name")
    confidence = F.round(F.greatest(F.lit(0.05), F.least(F.lit(0.95), 0.36 + 0.52 * F.col("score") + 0.30 * F.col("margin"))), 6)
    return out.withColumn("confidence", confidence)


def album_summary(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "photos")
    one = A.once(p, ["user_id", "photo_id"], {"ym": F.coalesce("year_month", F.lit(""))})
    dated = F.when(F.col("ym") != "", F.col("ym"))
    return one.groupBy("user_id").agg(F.count("*").alias("n_photos"), F.min(dated).alias("first_month"), F.max(dated).alias("last_month"))


def public_photo_ids(spark: SparkSession, d: str) -> DataFrame:
    from pyspark.sql import Window as W

    one = A.once(table(spark, d, "photos"), ["user_id", "photo_id"], {"ts": F.coalesce("timestamp", F.lit(""))})
    n = F.row_number().over(W.partitionBy("user_id").orderBy("ts", "photo_id"))
    return one.select("user_id", "photo_id", F.format_string("photo_%05d", n).alias("public_id"))


FUNCTIONS = (registry_rebuild, owner_argmax, owner_names_ranked, home_city, episode_rollup, co_face_clues, event_nodes_rebuilt, same_photo_weight, bridge_counts, activity_overlap, identity_pair_score, edge_margin, album_summary, public_photo_ids)
QUERIES = {f.__name__: f for f in FUNCTIONS}

SEEN = "SELECT DISTINCT user_id, photo_id, face_id FROM (SELECT user_id, photo_id, unnest(visible_face_ids) AS face_id FROM photos) WHERE face_id IS NOT NULL"
OWNER = f"SELECT user_id, face_id AS owner_face FROM (SELECT user_id, face_id, count(*) AS n FROM ({SEEN}) GROUP BY user_id, face_id) QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY n DESC, face_id) = 1"
FOLD = "trim(regexp_replace(lower(strip_accents({0})), '[^a-z0-9]+', ' ', 'g'))"
FULL = r"(len(string_split(trim(regexp_replace({0}, '\s+', ' ', 'g')), ' ')) >= 2)"


def _bridges(faces: str) -> str:
    c, p = FOLD.format("gps_city"), FOLD.format("gps_location")
    day = r"try_cast(nullif(regexp_extract(regexp_replace(timestamp, '^(\d{4})(\d{2})(\d{2})(\D|$)', '\1-\2-\3\4'), '^(\d{4}-\d{2}-\d{2})', 1), '') AS DATE)"
    return f"""
f AS (SELECT DISTINCT user_id, face_id, photo_id AS face_photo, year_month AS ym, {c} AS city, {p} AS place, {day} AS day FROM {faces}),
t AS (SELECT DISTINCT user_id, photo_id AS text_photo, year_month AS ym, {c} AS city, {p} AS place, {day} AS day FROM text_units),
cand AS (
  SELECT f.user_id, face_id, face_photo, text_photo, 0 AS k FROM f JOIN t ON f.user_id = t.user_id AND f.ym = t.ym AND f.ym <> '' AND f.place <> '' AND t.place <> ''
    AND face_photo <> text_photo AND (contains(f.place, t.place) OR contains(t.place, f.place))
  UNION ALL SELECT f.user_id, face_id, face_photo, text_photo, 1 FROM f JOIN t ON f.user_id = t.user_id AND f.city = t.city AND f.city <> '' AND face_photo <> text_photo AND f.ym <> '' AND f.ym = t.ym
  UNION ALL SELECT f.user_id, face_id, face_photo, text_photo, 2 FROM f JOIN t ON f.user_id = t.user_id AND f.city = t.city AND f.city <> '' AND face_photo <> text_photo AND abs(date_diff('day', f.day, t.day)) <= 14),
bridge AS (SELECT user_id, face_id, face_photo, text_photo, ['location_month', 'city_month', 'near_date_city'][min(k) + 1] AS bridge FROM cand GROUP BY ALL)"""


def _same(clusters: str) -> str:
    return f"""
seen AS ({SEEN}), nf AS (SELECT user_id, photo_id, count(*) AS nf FROM seen GROUP BY ALL),
nn AS (SELECT user_id, photo_id, max(len(list_filter(coalesce(text_entities, []), lambda e: lower(e.entity_type) = 'person'))) AS nn FROM photos GROUP BY ALL),
m AS (SELECT DISTINCT user_id, cluster_id, unnest(mention_photo_ids) AS photo_id FROM {clusters}),
same AS (SELECT s.user_id, s.face_id, m.cluster_id, count(*) AS n_same, sum(1.0::DOUBLE / (greatest(nf, 1) * greatest(nn, 1))) AS weight
  FROM m JOIN nn USING (user_id, photo_id) JOIN nf USING (user_id, photo_id) JOIN seen s USING (user_id, photo_id) GROUP BY ALL)"""


def _overlap(name: str, faces: str, clusters: str, column: str) -> str:
    side = lambda t, k: f"(SELECT user_id, {k}, lower(t) AS t, count(*) AS n FROM (SELECT user_id, {k}, unnest({column}) AS t FROM {t}) WHERE t IS NOT NULL GROUP BY ALL)"
    return f"{name} AS (SELECT a.user_id, a.face_id, b.cluster_id, sum(least(a.n, b.n))::BIGINT AS overlap FROM {side(faces, 'face_id')} a JOIN {side(clusters, 'cluster_id')} b USING (user_id, t) GROUP BY ALL)"


SQL = {
    "registry_rebuild": f"""
WITH s AS ({SEEN}), m AS (SELECT user_id, photo_id, nullif(min(coalesce(year_month, '')), '') AS ym FROM photos GROUP BY ALL)
SELECT user_id, face_id, count(ym) AS n_appearances, min(ym) AS first_month, max(ym) AS last_month, count(*) AS n_photos FROM s JOIN m USING (user_id, photo_id) GROUP BY user_id, face_id""",
    "owner_argmax": OWNER,
    "owner_names_ranked": f"""
WITH one AS (SELECT user_id, unit_id, min(photo_id) AS photo_id, min(coalesce(owner_reference_score, 0)) AS ref, max(coalesce(has_face, false)) AS hf, min(person_surfaces) AS names FROM text_units GROUP BY ALL),
n AS (SELECT user_id, photo_id, ref, hf, unnest(names) AS name FROM one),
s AS (SELECT user_id, name, round(sum(1.0::DOUBLE + 1.6::DOUBLE * ref + CASE WHEN hf THEN 0.4 ELSE 0 END::DOUBLE + 0.2::DOUBLE + CASE WHEN {FULL.format('name')} THEN 0.8 ELSE 0 END::DOUBLE), 3) AS score,
  count(*) AS mentions, count(DISTINCT photo_id) AS n_photos, {FULL.format('name')} AS is_full FROM n WHERE trim(name) <> '' GROUP BY user_id, name)
SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY is_full DESC, score DESC, mentions DESC, name) AS rank FROM s""",
    "home_city": f"""
WITH o AS ({OWNER}), s AS ({SEEN}), c AS (SELECT user_id, photo_id, min(trim(metadata.gps_city)) AS city FROM photos GROUP BY ALL),
k AS (SELECT c.user_id, city, count(*) AS na, count(o.owner_face) AS no FROM c LEFT JOIN (SELECT s.user_id, s.photo_id, o.owner_face FROM s JOIN o ON s.user_id = o.user_id AND s.face_id = o.owner_face) o ON o.user_id = c.user_id AND o.photo_id = c.photo_id
  WHERE city <> '' GROUP BY c.user_id, city)
SELECT user_id, city, CASE WHEN no > 0 THEN no ELSE na END AS n FROM k QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY (no = 0), n DESC, city) = 1""",
    "episode_rollup": f"""
WITH one AS (SELECT user_id, photo_id, min(coalesce(year_month, '')) AS year_month, min(coalesce(lower(trim(metadata.gps_city)), '')) AS city FROM photos GROUP BY ALL)
SELECT user_id, year_month, city, count(DISTINCT photo_id) AS n_photos, count(DISTINCT face_id) AS n_faces, min(photo_id) AS first_photo
FROM one LEFT JOIN ({SEEN}) USING (user_id, photo_id) GROUP BY user_id, year_month, city""",
    "co_face_clues": f"""
WITH s AS ({SEEN}), p AS (SELECT a.user_id, a.face_id, b.face_id AS other, count(*) AS n FROM s a JOIN s b ON a.user_id = b.user_id AND a.photo_id = b.photo_id AND a.face_id <> b.face_id GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY user_id, face_id ORDER BY n DESC, other) AS r FROM p)
SELECT user_id, face_id, string_agg(other || ':' || n, ' ' ORDER BY r) AS clues FROM r WHERE r <= 8 GROUP BY user_id, face_id""",
    "event_nodes_rebuilt": f"""
WITH one AS (SELECT user_id, photo_id, min(coalesce(year_month, '')) AS ym, min(coalesce({FOLD.format('metadata.gps_city')}, '')) AS city, min(coalesce({FOLD.format('metadata.gps_location')}, '')) AS place FROM photos GROUP BY ALL),
k AS (SELECT user_id, photo_id, ym || '|' || city || '|' || place AS event_key FROM one),
tx AS (SELECT DISTINCT user_id, photo_id FROM text_units), s AS ({SEEN}),
nm AS (SELECT user_id, photo_id, lower(trim(unnest(person_surfaces))) AS v FROM text_units),
tm AS (SELECT user_id, photo_id, lower(trim(unnest(activity_terms))) AS v FROM text_units UNION ALL SELECT user_id, photo_id, lower(trim(unnest(venue_terms))) FROM text_units),
a AS (SELECT user_id, event_key, count(*) AS n_photos, count(tx.photo_id) AS n_text_photos FROM k LEFT JOIN tx USING (user_id, photo_id) GROUP BY ALL),
b AS (SELECT user_id, event_key, count(DISTINCT photo_id) AS n_face_photos, count(DISTINCT face_id) AS n_faces FROM k JOIN s USING (user_id, photo_id) GROUP BY ALL),
c AS (SELECT user_id, event_key, count(DISTINCT v) AS n_names FROM k JOIN nm USING (user_id, photo_id) GROUP BY ALL),
e AS (SELECT user_id, event_key, count(DISTINCT v) AS n_terms FROM k JOIN tm USING (user_id, photo_id) GROUP BY ALL)
SELECT user_id, event_key, n_photos, n_text_photos, coalesce(n_face_photos, 0) AS n_face_photos, coalesce(n_faces, 0) AS n_faces, coalesce(n_names, 0) AS n_names, coalesce(n_terms, 0) AS n_terms
FROM a LEFT JOIN b USING (user_id, event_key) LEFT JOIN c USING (user_id, event_key) LEFT JOIN e USING (user_id, event_key)""",
    "same_photo_weight": f"WITH {_same('name_clusters')} SELECT user_id, face_id, cluster_id, n_same, round(weight, 9) AS weight FROM same",
    "bridge_counts": f"WITH {_bridges('face_units')} SELECT user_id, bridge, count(*) AS n, count(DISTINCT face_id) AS n_faces FROM bridge GROUP BY user_id, bridge",
    "activity_overlap": f"WITH {_overlap('o', 'face_units', 'name_clusters', 'activity_terms')} SELECT * FROM o",
    "identity_pair_score": f"""
WITH fu AS (SELECT user_id, face_id, photo_id, min(year_month) AS year_month, min(timestamp) AS timestamp, min(gps_city) AS gps_city, min(gps_location) AS gps_location, max(owner_present) AS owner_present,
  min(relation_terms) AS relation_terms, min(activity_terms) AS activity_terms, min(venue_terms) AS venue_terms FROM face_units GROUP BY user_id, face_id, photo_id),
cl AS (SELECT user_id, cluster_id, min(primary_surface) AS primary_surface, min(mention_photo_ids) AS mention_photo_ids, min(relation_terms) AS relation_terms, min(activity_terms) AS activity_terms, min(venue_terms) AS venue_terms
  FROM name_clusters GROUP BY user_id, cluster_id HAVING len(min(mention_photo_ids)) > 0),
{_bridges('fu')}, {_same('cl')}, {_overlap('act', 'fu', 'cl', 'activity_terms')}, {_overlap('ven', 'fu', 'cl', 'venue_terms')},
met AS (SELECT b.user_id, b.face_id, m.cluster_id, count(*) FILTER (bridge = 'location_month') AS strict, count(*) FILTER (bridge = 'city_month') AS city, count(*) FILTER (bridge = 'near_date_city') AS near
  FROM bridge b JOIN m ON m.user_id = b.user_id AND m.photo_id = b.text_photo GROUP BY ALL),
keys AS (SELECT user_id, face_id, cluster_id FROM same UNION SELECT user_id, face_id, cluster_id FROM met UNION SELECT user_id, face_id, cluster_id FROM act UNION SELECT user_id, face_id, cluster_id FROM ven),
o AS ({OWNER}),
fr AS (SELECT user_id, face_id, list_distinct(flatten(list(coalesce(relation_terms, [])))) AS fr, avg(CASE WHEN owner_present THEN 1.0 ELSE 0.0 END::DOUBLE) AS rate FROM fu GROUP BY ALL),
x AS (SELECT k.*, coalesce(n_same, 0) AS n_same, coalesce(weight, 0) AS weight, coalesce(strict, 0) AS strict, coalesce(city, 0) AS city, coalesce(near, 0) AS near, coalesce(act.overlap, 0) AS act, coalesce(ven.overlap, 0) AS ven,
  len(list_distinct(list_concat(coalesce(cl.relation_terms, []), fr.fr))) AS rel, rate, coalesce({FULL.format('cl.primary_surface')}, false) AS is_full
  FROM keys k JOIN fr USING (user_id, face_id) JOIN cl USING (user_id, cluster_id) LEFT JOIN same USING (user_id, face_id, cluster_id) LEFT JOIN met USING (user_id, face_id, cluster_id)
  LEFT JOIN act USING (user_id, face_id, cluster_id) LEFT JOIN ven USING (user_id, face_id, cluster_id)
  WHERE NOT EXISTS (SELECT 1 FROM o WHERE o.user_id = k.user_id AND o.owner_face = k.face_id)),
s AS (SELECT user_id, face_id, cluster_id, round(greatest(0, least(1, 0.50::DOUBLE * least(1, weight) + 0.25::DOUBLE * least(1, ln(strict + 1) / ln(6)) + 0.08::DOUBLE * least(1, ln(city + 1) / ln(13)) + 0.08::DOUBLE * least(1, ln(near + 1) / ln(9))
  + 0.06::DOUBLE * least(1, act / 3.0::DOUBLE) + 0.04::DOUBLE * least(1, ven / 3.0::DOUBLE) + 0.08::DOUBLE * least(1, rel / 2.0::DOUBLE) + 0.06::DOUBLE * least(1, rate * 1.4::DOUBLE) + 0.06::DOUBLE * CASE WHEN is_full THEN 1.0 ELSE 0.45 END
  - CASE WHEN city > 30 AND strict = 0 AND n_same = 0 THEN 0.10 ELSE 0 END - CASE WHEN NOT is_full AND n_same = 0 THEN 0.06 ELSE 0 END)), 6) AS score FROM x)
SELECT user_id, face_id, cluster_id, score, row_number() OVER w AS rank, round(greatest(0, score - coalesce(lead(score) OVER w, 0)), 6) AS margin FROM s WHERE score > 0
WINDOW w AS (PARTITION BY user_id, face_id ORDER BY score DESC, cluster_id) QUALIFY rank <= 12""",
    "edge_margin": """
WITH b AS (SELECT user_id, face_id, lower(trim(name_surface)) AS name, max(score) AS score FROM identity_edges WHERE score >= 0 AND score <= 1 AND NOT isnan(score) AND trim(name_surface) <> '' GROUP BY ALL),
r AS (SELECT *, row_number() OVER w AS rank, round(greatest(0, score - coalesce(lead(score) OVER w, 0)), 6) AS margin FROM b WINDOW w AS (PARTITION BY user_id, face_id ORDER BY score DESC, name))
SELECT *, round(greatest(0.05, least(0.95, 0.36::DOUBLE + 0.52::DOUBLE * score + 0.30::DOUBLE * margin)), 6) AS confidence FROM r""",
    "album_summary": """
WITH one AS (SELECT user_id, photo_id, nullif(min(coalesce(year_month, '')), '') AS ym FROM photos GROUP BY ALL)
SELECT user_id, count(*) AS n_photos, min(ym) AS first_month, max(ym) AS last_month FROM one GROUP BY user_id""",
    "public_photo_ids": """
WITH one AS (SELECT user_id, photo_id, min(coalesce(timestamp, '')) AS ts FROM photos GROUP BY ALL)
SELECT user_id, photo_id, printf('photo_%05d', row_number() OVER (PARTITION BY user_id ORDER BY ts, photo_id)) AS public_id FROM one""",
}
