"""Queries over candidates and the groups of faces and names."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from facetrail.functions.text import fold
from facetrail.operators import albums as A
from facetrail.operators import groups as G
from facetrail.plans import albums as AQ
from facetrail.plans import language as LQ
from facetrail.session import table


def _ranked(spark: SparkSession, d: str) -> DataFrame:
    return AQ.edge_margin(spark, d).select("user_id", "face_id", "name", "score", "rank", "margin")


def face_flags(spark: SparkSession, d: str) -> DataFrame:
    return G.face_flags(_ranked(spark, d))


def _persons(spark: SparkSession, d: str) -> DataFrame:
    n = F.size(F.filter(F.coalesce("text_entities", F.array()), lambda e: F.lower(e["entity_type"]) == "person"))
    return table(spark, d, "photos").groupBy("user_id", "photo_id").agg(F.max(n).alias("n_persons"))


def _scenes(spark: SparkSession, d: str) -> DataFrame:
    photos, ranked = table(spark, d, "photos"), _ranked(spark, d)
    return G.scene_groups(A.appearances(photos), A.owner_faces(photos), ranked, G.face_flags(ranked), _persons(spark, d))


def _pairs(spark: SparkSession, d: str) -> DataFrame:
    ranked = _ranked(spark, d)
    return G.pair_groups(A.appearances(table(spark, d, "photos")), ranked, G.face_flags(ranked))


def _shown(g: DataFrame) -> DataFrame:
    return g.withColumn("faces", F.concat_ws(",", "faces")).withColumn("names", F.md5(F.concat_ws("|", "names")))


def scene_groups(spark: SparkSession, d: str) -> DataFrame:
    return _shown(_scenes(spark, d))


def pair_groups(spark: SparkSession, d: str) -> DataFrame:
    return _shown(_pairs(spark, d))


def name_conflicts(spark: SparkSession, d: str) -> DataFrame:
    return _shown(G.name_conflicts(_ranked(spark, d)))


def joint_groups(spark: SparkSession, d: str) -> DataFrame:
    """All groups of an album, without those that overlap with a better one."""
    cols = ["user_id", "group_id", "faces", "names", "priority"]
    every = reduce(DataFrame.unionByName, [x.select(*cols) for x in (_scenes(spark, d), _pairs(spark, d), G.name_conflicts(_ranked(spark, d)))])
    return _shown(G.suppress_overlaps(every))


def review_slots(spark: SparkSession, d: str) -> DataFrame:
    """The first ten groups of an album for review, three of them pairs if there are so many."""
    cols = ["user_id", "group_id", "priority"]
    every = _scenes(spark, d).select(*cols).unionByName(_pairs(spark, d).select(*cols))
    return G.reserved_first(every, ["user_id"], [F.col("priority").desc(), F.col("group_id")], F.col("group_id").startswith("pair"), 10, 3).select("user_id", "group_id", "place")


def broadened_candidates(spark: SparkSession, d: str) -> DataFrame:
    """Three names a face, and up to three more that several events speak for."""
    e = table(spark, d, "identity_edges").where("score >= 0 and score <= 1 and not isnan(score) and trim(name_surface) <> ''")
    n = e.groupBy("user_id", "face_id", F.lower(F.trim("name_surface")).alias("name")).agg(F.max(F.coalesce(F.size("event_ids"), F.lit(0))).alias("n_events"))
    r = _ranked(spark, d).join(n, ["user_id", "face_id", "name"])
    return G.broadened(r, F.when(F.col("n_events") >= 2, F.col("score") * 0.5 + 0.04).otherwise(F.col("score") * 0.5), 3).select("user_id", "face_id", "name", "place")


def face_channels(spark: SparkSession, d: str) -> DataFrame:
    features = LQ._features(spark, d).groupBy("user_id", "photo_id").agg(F.min("channels").alias("channels"))
    return G.channel_scores(table(spark, d, "face_units"), features)


def edge_clusters(spark: SparkSession, d: str) -> DataFrame:
    """Cluster of every edge's name: that of the same name, else the only one of its album with the same first word."""
    e = table(spark, d, "identity_edges").select("user_id", fold(F.col("name_surface")).alias("key")).where("key <> ''").distinct()
    c = table(spark, d, "name_clusters").select("user_id", "cluster_id", F.explode("surfaces").alias("s")).select("user_id", "cluster_id", fold(F.col("s")).alias("key")).where("key <> ''").distinct()
    exact = c.groupBy("user_id", "key").agg(F.min("cluster_id").alias("exact"))
    first = c.select("user_id", "cluster_id", F.split("key", " ")[0].alias("first")).distinct().groupBy("user_id", "first").agg(F.count("*").alias("n"), F.min("cluster_id").alias("unique")).where("n = 1").drop("n")
    j = e.withColumn("first", F.split("key", " ")[0]).join(exact, ["user_id", "key"], "left").join(first, ["user_id", "first"], "left")
    return j.select("user_id", "key", F.coalesce("exact", "unique").alias("cluster_id"), F.when(F.col("exact").isNotNull(), "exact").when(F.col("unique").isNotNull(), "first_word").alias("matched_by"))


def completed_candidates(spark: SparkSession, d: str) -> DataFrame:
    """Every name that a cluster gives to a face's photos, with its edge's score, or a low one made up where there is no edge."""
    c = table(spark, d, "name_clusters").select("user_id", F.lower(F.trim("primary_surface")).alias("name"), F.explode("mention_photo_ids").alias("photo_id")).where("name <> ''").distinct()
    pairs = c.join(A.appearances(table(spark, d, "photos")), ["user_id", "photo_id"]).select("user_id", "face_id", "name").distinct()
    out = pairs.join(_ranked(spark, d).select("user_id", "face_id", "name", "score"), ["user_id", "face_id", "name"], "left")
    return out.select("user_id", "face_id", "name", F.coalesce("score", F.lit(0.2)).alias("score"), F.col("score").isNull().alias("made_up"))


def applied_choices(spark: SparkSession, d: str) -> DataFrame:
    """Candidates after the choices of the full variant are applied."""
    p = table(spark, d, "predicted_persons").where("variant = 'full' and face_id <> '' and trim(canonical_name) <> '' and confidence is not null and not isnan(confidence)")
    chosen = p.select("user_id", "face_id", F.lower(F.trim("canonical_name")).alias("name"), "confidence").groupBy("user_id", "face_id", "name").agg(F.max("confidence").alias("confidence"))
    return G.applied(_ranked(spark, d), chosen).where("chosen or rank <= 2")


FUNCTIONS = (face_flags, scene_groups, pair_groups, name_conflicts, joint_groups, review_slots, broadened_candidates, face_channels, edge_clusters, completed_candidates, applied_choices)
QUERIES = {f.__name__: f for f in FUNCTIONS}

SEEN, OWNER, FOLD = AQ.SEEN, AQ.OWNER, AQ.FOLD
BASE = f"""
ranked AS (SELECT user_id, face_id, name, score, rank FROM ({AQ.SQL['edge_margin']})),
tops AS (SELECT user_id, face_id, count(*) AS n_names, max(score) FILTER (rank = 1) AS top, coalesce(max(score) FILTER (rank = 2), 0) AS second FROM ranked GROUP BY ALL),
nears AS (SELECT r.user_id, r.face_id, count(*) FILTER (r.rank <= 5 AND r.score >= t.top - 0.12::DOUBLE) AS n_near FROM ranked r JOIN tops t ON t.user_id IS NOT DISTINCT FROM r.user_id AND t.face_id IS NOT DISTINCT FROM r.face_id GROUP BY ALL),
fl0 AS (SELECT t.user_id, t.face_id, n_names, top, n_near, round(greatest(0, top - second), 9) AS margin FROM tops t JOIN nears n ON t.user_id IS NOT DISTINCT FROM n.user_id AND t.face_id IS NOT DISTINCT FROM n.face_id),
flags AS (SELECT *, n_names >= 2 AND (margin < 0.16::DOUBLE OR n_near >= 3) AS ambiguous, round(top + greatest(0, 0.25::DOUBLE - margin), 9) AS priority, round(greatest(0, 0.22::DOUBLE - margin) * 1.8::DOUBLE + least(0.24::DOUBLE, 0.04::DOUBLE * n_near), 9) AS bonus FROM fl0),
seen AS ({SEEN}), owner AS ({OWNER}), np AS (SELECT user_id, photo_id, max(len(list_filter(coalesce(text_entities, []), lambda e: lower(e.entity_type) = 'person'))) AS np FROM photos GROUP BY ALL),
sf AS (SELECT s.user_id, s.photo_id, s.face_id, f.bonus FROM seen s JOIN flags f USING (user_id, face_id) WHERE NOT EXISTS (SELECT 1 FROM owner o WHERE o.user_id = s.user_id AND o.owner_face = s.face_id)),
sc AS (SELECT user_id, photo_id, list_sort(list(face_id)) AS faces, sum(bonus) AS bonus FROM sf GROUP BY ALL HAVING count(*) BETWEEN 2 AND 8),
sn AS (SELECT sc.user_id, sc.photo_id, r.name, count(*) AS n, max(r.score) AS b FROM sc JOIN sf USING (user_id, photo_id) JOIN ranked r ON r.user_id = sc.user_id AND r.face_id = sf.face_id AND r.rank <= 2 GROUP BY ALL),
sk AS (SELECT *, row_number() OVER (PARTITION BY user_id, photo_id ORDER BY n DESC, b DESC, name) AS k FROM sn), sl AS (SELECT user_id, photo_id, list_sort(list(name)) AS names FROM sk WHERE k <= 12 GROUP BY ALL HAVING count(*) >= 2),
scenes AS (SELECT sc.user_id, 'scene:' || sc.photo_id AS group_id, faces, names, round(1.0::DOUBLE + 0.22::DOUBLE * len(faces) + 0.12::DOUBLE * len(names) + CASE WHEN np >= 2 THEN 0.28 ELSE 0 END::DOUBLE + bonus, 6) AS priority FROM sc JOIN sl USING (user_id, photo_id) LEFT JOIN np USING (user_id, photo_id)),
pb AS (SELECT x.user_id, x.face_id AS a, y.face_id AS b, count(*) AS n_shared FROM ranked x JOIN ranked y ON x.user_id = y.user_id AND x.name = y.name AND x.face_id < y.face_id WHERE x.rank <= 5 AND y.rank <= 5 GROUP BY ALL),
ps AS (SELECT x.user_id, x.face_id AS a, y.face_id AS b, count(*) AS n_photos FROM seen x JOIN seen y ON x.user_id = y.user_id AND x.photo_id = y.photo_id AND x.face_id < y.face_id GROUP BY ALL),
pn AS (SELECT user_id, face_id, list(name) AS names FROM ranked WHERE rank <= 4 GROUP BY ALL),
pairs AS (SELECT pb.user_id, 'pair:' || pb.a || ':' || pb.b AS group_id, [pb.a, pb.b] AS faces, list_sort(list_distinct(list_concat(na.names, nb.names))) AS names,
    round(2.55::DOUBLE + 0.26::DOUBLE * n_shared + least(0.45::DOUBLE, 0.08::DOUBLE * n_photos) + fa.bonus + fb.bonus, 6) AS priority, n_shared, least(n_photos, 10) AS n_photos
  FROM pb JOIN ps ON ps.user_id = pb.user_id AND ps.a = pb.a AND ps.b = pb.b JOIN flags fa ON fa.user_id = pb.user_id AND fa.face_id = pb.a AND fa.n_names >= 2 JOIN flags fb ON fb.user_id = pb.user_id AND fb.face_id = pb.b AND fb.n_names >= 2
  JOIN pn na ON na.user_id = pb.user_id AND na.face_id = pb.a JOIN pn nb ON nb.user_id = pb.user_id AND nb.face_id = pb.b WHERE n_shared >= 2 OR fa.ambiguous OR fb.ambiguous)"""
SHOW = "array_to_string(faces, ',') AS faces, md5(array_to_string(names, '|')) AS names"
SQL = {
    "face_flags": f"WITH {BASE} SELECT user_id, face_id, n_names, top, n_near, margin, ambiguous, priority, bonus FROM flags",
    "scene_groups": f"WITH {BASE} SELECT user_id, group_id, {SHOW}, priority FROM scenes",
    "pair_groups": f"WITH {BASE} SELECT user_id, group_id, {SHOW}, priority, n_shared, n_photos FROM pairs",
    "name_conflicts": f"""WITH {BASE}, t AS (SELECT r.*, top FROM ranked r JOIN tops USING (user_id, face_id) WHERE r.rank <= 4 AND r.score >= top - 0.05::DOUBLE),
g AS (SELECT user_id, name, list_sort(list_distinct(list(face_id))) AS faces, max(score) AS best FROM t GROUP BY ALL HAVING count(DISTINCT face_id) >= 2)
SELECT user_id, 'name:' || name AS group_id, array_to_string(faces, ',') AS faces, md5(name) AS names, round(1.4::DOUBLE + 0.2::DOUBLE * len(faces) + best, 6) AS priority FROM g""",
    "review_slots": f"""WITH {BASE}, e AS (SELECT user_id, group_id, priority FROM scenes UNION ALL SELECT user_id, group_id, priority FROM pairs),
r AS (SELECT *, group_id LIKE 'pair%' AS s, row_number() OVER (PARTITION BY user_id ORDER BY priority DESC, group_id) AS r FROM e), q AS (SELECT *, row_number() OVER (PARTITION BY user_id, s ORDER BY r) AS sr, count(*) FILTER (s AND r <= 10) OVER (PARTITION BY user_id) AS i, count(*) FILTER (s) OVER (PARTITION BY user_id) AS n FROM r),
k AS (SELECT *, greatest(i, least(n, 3)) AS t FROM q)
SELECT user_id, group_id, row_number() OVER (PARTITION BY user_id ORDER BY (r > 10), r) AS place FROM k WHERE CASE WHEN s THEN r <= 10 OR sr <= t ELSE sr <= 10 - t END""",
    "broadened_candidates": f"""WITH {BASE}, n AS (SELECT user_id, face_id, lower(trim(name_surface)) AS name, max(coalesce(len(event_ids), 0)) AS n FROM identity_edges WHERE score >= 0 AND score <= 1 AND NOT isnan(score) AND trim(name_surface) <> '' GROUP BY ALL),
r AS (SELECT ranked.*, CASE WHEN n >= 2 THEN score * 0.5::DOUBLE + 0.04::DOUBLE ELSE score * 0.5::DOUBLE END AS recall FROM ranked JOIN n USING (user_id, face_id, name)),
x AS (SELECT *, row_number() OVER (PARTITION BY user_id, face_id ORDER BY recall DESC, score DESC, name) AS x FROM r WHERE rank > 3 AND recall >= 0.28::DOUBLE),
b AS (SELECT user_id, face_id, name, score FROM r WHERE rank <= 3 UNION ALL SELECT user_id, face_id, name, score FROM x WHERE x <= 3)
SELECT user_id, face_id, name, row_number() OVER (PARTITION BY user_id, face_id ORDER BY score DESC, name) AS place FROM b""",
    "face_channels": f"""WITH p AS (SELECT user_id, photo_id, lower(concat_ws(' ', caption, array_to_string(visible_text, ' '), array_to_string(list_transform(text_entities, lambda e: e.surface), ' '), metadata.gps_location, metadata.gps_city)) AS low FROM photos),
a AS (SELECT *, list_sort(list_distinct(list_concat(list_intersect(regexp_extract_all(low, '[a-z][a-z0-9''_-]*'), {LQ._list([t for t in LQ.L.EVENT_TERMS if len(t) >= 4])}), {LQ.PHRASE_TERMS}))) AS t FROM p),
f AS (SELECT user_id, photo_id, min(list_sort(list_distinct(list_concat(list_filter({LQ.PHRASES}, lambda c: c IS NOT NULL), {LQ.CHANNELS})))) AS c FROM a GROUP BY ALL),
u0 AS (SELECT user_id, face_id, photo_id, list_transform(list_concat(list_concat(coalesce(relation_terms, []), coalesce(activity_terms, [])), coalesce(venue_terms, [])), lambda x: lower(x)) AS t FROM face_units),
u AS (SELECT user_id, face_id, photo_id, min({LQ.CHANNELS}) AS c FROM u0 GROUP BY ALL),
e AS (SELECT user_id, face_id, unnest(c) AS channel, 1.0::DOUBLE AS s FROM u UNION ALL SELECT u.user_id, u.face_id, unnest(f.c), 0.65::DOUBLE FROM u JOIN f USING (user_id, photo_id))
SELECT user_id, face_id, channel, round(sum(s), 6) AS score FROM e GROUP BY ALL""",
    "edge_clusters": f"""WITH e AS (SELECT DISTINCT user_id, {FOLD.format('name_surface')} AS key FROM identity_edges), c AS (SELECT DISTINCT user_id, cluster_id, {FOLD.format('s')} AS key FROM (SELECT user_id, cluster_id, unnest(surfaces) AS s FROM name_clusters)),
x AS (SELECT user_id, key, min(cluster_id) AS exact FROM c WHERE key <> '' GROUP BY ALL), f AS (SELECT user_id, string_split(key, ' ')[1] AS first, min(cluster_id) AS uniq FROM c WHERE key <> '' GROUP BY ALL HAVING count(DISTINCT cluster_id) = 1)
SELECT e.user_id, e.key, coalesce(exact, uniq) AS cluster_id, CASE WHEN exact IS NOT NULL THEN 'exact' WHEN uniq IS NOT NULL THEN 'first_word' END AS matched_by FROM e LEFT JOIN x ON x.user_id = e.user_id AND x.key = e.key LEFT JOIN f ON f.user_id = e.user_id AND f.first = string_split(e.key, ' ')[1] WHERE e.key <> ''""",
    "completed_candidates": f"""WITH ranked AS (SELECT user_id, face_id, name, score FROM ({AQ.SQL['edge_margin']})), c AS (SELECT DISTINCT user_id, lower(trim(primary_surface)) AS name, unnest(mention_photo_ids) AS photo_id FROM name_clusters WHERE trim(primary_surface) <> ''), s AS ({SEEN}),
p AS (SELECT DISTINCT c.user_id, face_id, name FROM c JOIN s USING (user_id, photo_id)) SELECT p.user_id, p.face_id, p.name, coalesce(score, 0.2) AS score, score IS NULL AS made_up FROM p LEFT JOIN ranked USING (user_id, face_id, name)""",
    "applied_choices": f"""WITH ranked AS (SELECT user_id, face_id, name, score FROM ({AQ.SQL['edge_margin']})),
ch AS (SELECT user_id, face_id, lower(trim(canonical_name)) AS name, max(confidence) AS confidence FROM predicted_persons WHERE variant = 'full' AND face_id <> '' AND trim(canonical_name) <> '' AND confidence IS NOT NULL AND NOT isnan(confidence) GROUP BY ALL),
v AS (SELECT ch.* FROM ch JOIN ranked USING (user_id, face_id, name) WHERE confidence >= 0.55), o AS (SELECT * FROM v QUALIFY row_number() OVER (PARTITION BY user_id, name ORDER BY confidence DESC, face_id) = 1),
one AS (SELECT * FROM o QUALIFY row_number() OVER (PARTITION BY user_id, face_id ORDER BY confidence DESC, name) = 1),
x AS (SELECT r.*, a.name AS n, a.confidence, b.face_id AS f FROM ranked r LEFT JOIN one a ON a.user_id = r.user_id AND a.face_id = r.face_id LEFT JOIN one b ON b.user_id = r.user_id AND b.name = r.name),
s AS (SELECT user_id, face_id, name, round(greatest(0, least(1, CASE WHEN n = name THEN greatest(score + 0.08::DOUBLE, confidence) WHEN n IS NOT NULL THEN score - 0.05::DOUBLE WHEN f IS NOT NULL AND f <> face_id THEN score - 0.05::DOUBLE ELSE score END)), 6) AS score, coalesce(n = name, false) AS chosen FROM x),
k AS (SELECT *, row_number() OVER w AS rank, round(greatest(0, score - coalesce(lead(score) OVER w, 0)), 6) AS margin FROM s WINDOW w AS (PARTITION BY user_id, face_id ORDER BY score DESC, name)) SELECT * FROM k WHERE chosen OR rank <= 2""",
}
