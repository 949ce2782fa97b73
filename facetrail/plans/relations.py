"""Donors, as-of joins, evictions, assignment, event graph, perturbations, audits."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from facetrail.functions.text import stable_integer
from facetrail.operators import albums as A
from facetrail.operators import audit, graph, perturb
from facetrail.operators import relational as R
from facetrail.session import table

SEED = 20260609


def asof_view(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    left = e.where("event_type = 'purchase'").select("event_id", "user_id", "ts")
    right = e.where("event_type = 'view'").select("user_id", "ts", F.col("value").alias("view_value"), F.col("event_id").alias("t"))
    return R.asof_join(left, right, "user_id", "ts", "view_value", "t").select("event_id", "user_id", "view_value")


def cyclic_shift(spark: SparkSession, d: str) -> DataFrame:
    users = R.numbered(table(spark, d, "photos").select("user_id").distinct(), ["user_id"], "i")
    n = users.count()
    other = users.select(F.col("user_id").alias("donor_user"), F.pmod(F.col("i") - 3, F.lit(n)).alias("i"))
    return users.join(other, "i").select("user_id", "donor_user", "i")


def caption_donors(spark: SparkSession, d: str) -> DataFrame:
    text = F.when(F.col("v") == 0, "t0").when(F.col("v") <= 3, "t1").otherwise("t2")
    p = table(spark, d, "photos").select("user_id", "photo_id", "timestamp", "year_month", F.size(F.coalesce("visible_text", F.array().cast("array<string>"))).alias("v"), F.size(F.coalesce("visible_face_ids", F.array().cast("array<string>"))).alias("f"))
    one = p.groupBy("user_id", "photo_id").agg(F.min(F.coalesce("timestamp", "year_month", F.lit(""))).alias("ts"), F.max("v").alias("v"), F.max("f").alias("f"))
    month = F.when(F.length("ts") >= 7, F.substring("ts", 6, 2)).otherwise("00")
    b = one.select("user_id", "photo_id", month.alias("month"), text.alias("text"), (F.col("f") > 0).cast("int").alias("face"))
    shift = cyclic_shift(spark, d).select("user_id", "donor_user")
    from pyspark.sql import Window as W

    ordinal = (F.row_number().over(W.partitionBy("user_id").orderBy("photo_id")) - 1).alias("ordinal")
    targets = b.select("*", ordinal).join(shift, "user_id")
    donors = b.withColumnRenamed("user_id", "donor_user")
    out = R.fallback_donors(targets, donors, [["donor_user", "month", "text", "face"], ["donor_user", "month"], ["donor_user"]], "ordinal", "photo_id")
    return out.select("user_id", "photo_id", "donor_user", "donor", "level")


def lru_evictions(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    limit = (docs.agg(F.sum("n_chars")).first()[0] or 0) * 7 // 10
    return R.evictions(docs, "n_chars", "ingested_at", "doc_id", limit)


def unpivot_targets(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "target_persons").select("row_id", "person_id", "canonical_name", "relation", "relation_category").distinct()
    return R.unpivot(t, ["row_id", "person_id"], {"canonical_name": "person_name", "relation": "person_relation", "relation_category": "person_category"})


def batch_chunking(spark: SparkSession, d: str) -> DataFrame:
    faces = A.appearances(table(spark, d, "photos")).select("user_id", "face_id").distinct()
    return R.batches(faces, ["user_id"], [F.col("face_id")], 8).groupBy("user_id", "batch_no").agg(F.count("*").alias("n"), F.min("face_id").alias("first_face"), F.max("face_id").alias("last_face"))


def greedy_assignment(spark: SparkSession, d: str) -> DataFrame:
    scores = A.pair_scores(*[table(spark, d, t) for t in ("photos", "face_units", "text_units", "name_clusters")], per_face=None)
    return R.assign_one_to_one(scores, "user_id", "face_id", "cluster_id", "score", "margin")


def event_graph_direct(spark: SparkSession, d: str) -> DataFrame:
    return graph.direct_edges(table(spark, d, "event_nodes"))


def event_graph_cross(spark: SparkSession, d: str) -> DataFrame:
    return graph.cross_edges(table(spark, d, "event_nodes"))


def stress_retention(spark: SparkSession, d: str) -> DataFrame:
    """What each setting leaves of all photos (each delivery counts)."""
    p = table(spark, d, "photos")
    owners = A.owner_faces(p)
    sets = [("none", p), *((s, perturb.stress(p, owners, s, SEED)) for s in perturb.SETTINGS)]
    return reduce(DataFrame.unionByName, [perturb.album_counts(x).withColumn("setting", F.lit(s)) for s, x in sets])


def face_dropout(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "photos")
    return A.appearances(perturb.stress(p, A.owner_faces(p), "face_miss_15", SEED))


def modality_masks(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "photos")
    return reduce(DataFrame.unionByName, [perturb.album_counts(perturb.mask(p, m)).withColumn("setting", F.lit(m)) for m in perturb.MASKS])


def stable_timestamps(spark: SparkSession, d: str) -> DataFrame:
    one = A.once(table(spark, d, "photos"), ["user_id", "photo_id"], {"ym": F.col("year_month")}).where("ym is not null and ym <> ''")
    key = F.concat_ws(":", "user_id", "photo_id")
    return one.select("user_id", "photo_id", (stable_integer(key, 28) + 1).alias("day"), stable_integer(F.concat(key, F.lit(":m")), 1440).alias("minute"))


def dual_view_audit(spark: SparkSession, d: str) -> DataFrame:
    return audit.violations(*[table(spark, d, t) for t in ("photos", "face_units", "target_persons", "predicted_persons")]).groupBy("rule", "user_id").agg(F.count("*").alias("n"), F.min("subject").alias("first_subject"))


def leak_scan(spark: SparkSession, d: str) -> DataFrame:
    return audit.leaks(table(spark, d, "documents"), "doc_id", "text")


def id_map_audit(spark: SparkSession, d: str) -> DataFrame:
    faces = table(spark, d, "target_persons").where("face_id <> ''").select(F.concat_ws("/", "user_id", "person_id").alias("private"), F.concat_ws("/", "user_id", "face_id").alias("public"))
    return audit.bijection_faults(faces, "private", "public")


FUNCTIONS = (asof_view, cyclic_shift, caption_donors, lru_evictions, unpivot_targets, batch_chunking, greedy_assignment, event_graph_direct, event_graph_cross, stress_retention, face_dropout, modality_masks, stable_timestamps, dual_view_audit, leak_scan, id_map_audit)
QUERIES = {f.__name__: f for f in FUNCTIONS}

SEEN = "SELECT DISTINCT user_id, photo_id, face_id FROM (SELECT user_id, photo_id, unnest(visible_face_ids) AS face_id FROM photos) WHERE face_id IS NOT NULL"
OWNER = f"SELECT user_id, face_id AS owner_face FROM (SELECT user_id, face_id, count(*) AS n FROM ({SEEN}) GROUP BY user_id, face_id) QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY n DESC, face_id) = 1"
UNIT = "(('0x' || sha256({0})[1:12])::UBIGINT::DOUBLE / 281474976710656.0::DOUBLE)"
FULL = r"(len(string_split(trim(regexp_replace({0}, '\s+', ' ', 'g')), ' ')) >= 2)"
CYCLE = "u AS (SELECT user_id, row_number() OVER (ORDER BY user_id) - 1 AS i, count(*) OVER () AS n FROM (SELECT DISTINCT user_id FROM photos)), cyc AS (SELECT a.user_id, b.user_id AS donor_user, a.i FROM u a JOIN u b ON b.i = (a.i + 3) % a.n)"
LISTS = ", ".join(f"list_distinct(list_filter(list_transform(flatten(list(coalesce({c}, []))), lambda x: trim(x)), lambda x: x <> '')) AS {c}" for c in ("face_ids", "name_surfaces", "text_photo_ids", "face_photo_ids", "relation_terms", "channels", "terms"))
NODES = f"""
c AS (SELECT event_id, min(user_id) AS user_id, coalesce(min(year_month), '') AS ym, coalesce(trim(regexp_replace(lower(strip_accents(min(gps_city))), '[^a-z0-9]+', ' ', 'g')), '') AS city, coalesce(min(location_key), '') AS place,
  coalesce(min(primary_channel), 'general') AS channel, coalesce(max(owner_present), false) AS owner, {LISTS} FROM event_nodes GROUP BY event_id)"""
BEST = "SELECT user_id, face_id, lower(name) AS name_key, max(score) AS score, arg_min(event_id, (-score, event_id)) AS event_id FROM e GROUP BY user_id, face_id, lower(name)"
WORDS = r"len(list_filter(regexp_split_to_array(coalesce(caption, ''), '\s+'), lambda w: w <> ''))"
FIRST = r"CASE WHEN len(string_split(trim(regexp_replace(coalesce(caption, ''), '\s+', ' ', 'g'), ' '), ' ')) > {0} THEN regexp_replace(array_to_string(string_split(trim(regexp_replace(coalesce(caption, ''), '\s+', ' ', 'g'), ' '), ' ')[1:{0}], ' '), '[ ,;:]+$', '') || '.' ELSE coalesce(caption, '') END"


def _counts(source: str, setting: str) -> str:
    return f"""SELECT count(*) AS n_photos, count(*) FILTER (trim(coalesce(caption, '')) <> '') AS captions, sum({WORDS})::BIGINT AS caption_words, sum(len(coalesce(visible_text, [])))::BIGINT AS texts,
  sum(len(coalesce(text_entities, [])))::BIGINT AS entities, sum(len(coalesce(visible_face_ids, [])))::BIGINT AS faces, count(*) FILTER (coalesce(gps_city, '') <> '') AS places, '{setting}' AS setting FROM {source}"""


def _stressed(setting: str) -> str:
    s = perturb.SETTINGS[setting]
    key = lambda tail: UNIT.format(f"'{SEED}::{setting}::' || coalesce(p.user_id, '') || '::' || coalesce(p.photo_id, '') || '::' || {tail}")
    cap = FIRST.format(s["words"]) if "words" in s else "caption"
    ents = "text_entities"
    if "words" in s:
        ents = f"list_filter({ents}, lambda e: lower(trim(e.source)) <> 'caption' OR contains(lower({cap}), lower(e.surface)))"
    lost = f"({key(repr('ocr'))} < {s['ocr']})" if "ocr" in s else "false"
    ents = f"CASE WHEN {lost} THEN list_filter({ents}, lambda e: lower(trim(e.source)) <> 'visible_text') ELSE {ents} END"
    place = f"CASE WHEN {key(repr('location'))} < {s['place']} THEN '' ELSE metadata.gps_city END" if "place" in s else "metadata.gps_city"
    unit = UNIT.format(f"'{SEED}::{setting}::' || coalesce(p.user_id, '') || '::' || coalesce(p.photo_id, '') || '::' || coalesce(f, '') || '::face'")
    faces = f"list_filter(visible_face_ids, lambda f: {unit} >= CASE WHEN f = o.owner_face THEN {s['owner']} ELSE {s['face']} END)" if "face" in s else "visible_face_ids"
    return f"(SELECT p.user_id, p.photo_id, {cap} AS caption, CASE WHEN {lost} THEN [] ELSE visible_text END AS visible_text, {ents} AS text_entities, {faces} AS visible_face_ids, {place} AS gps_city FROM photos p LEFT JOIN ({OWNER}) o ON o.user_id = p.user_id)"


PLAIN = "(SELECT *, metadata.gps_city AS gps_city FROM photos)"
MASKED = {
    "full": PLAIN,
    "text_off": "(SELECT '' AS caption, [] AS visible_text, [] AS text_entities, visible_face_ids, metadata.gps_city AS gps_city FROM photos)",
    "face_off": "(SELECT caption, visible_text, text_entities, [] AS visible_face_ids, metadata.gps_city AS gps_city FROM photos)",
    "metadata_off": "(SELECT caption, visible_text, text_entities, visible_face_ids, '' AS gps_city FROM photos)",
    "visual_off": "(SELECT caption, visible_text, text_entities, [] AS visible_face_ids, metadata.gps_city AS gps_city FROM photos)",
}
SQL = {
    "asof_view": """
WITH l AS (SELECT event_id, user_id, ts FROM events WHERE event_type = 'purchase'), r AS (SELECT event_id AS t, user_id, ts, value FROM events WHERE event_type = 'view')
SELECT l.event_id, l.user_id, (SELECT arg_max(value, (r.ts, r.t)) FROM r WHERE r.user_id = l.user_id AND r.ts <= l.ts) AS view_value FROM l""",
    "cyclic_shift": f"WITH {CYCLE} SELECT user_id, donor_user, i FROM cyc",
    "caption_donors": f"""
WITH {CYCLE}, one AS (SELECT user_id, photo_id, min(coalesce(timestamp, year_month, '')) AS ts, max(len(coalesce(visible_text, []))) AS v, max(len(coalesce(visible_face_ids, []))) AS f FROM photos GROUP BY ALL),
b AS (SELECT user_id, photo_id, CASE WHEN length(ts) >= 7 THEN ts[6:7] ELSE '00' END AS month, CASE WHEN v = 0 THEN 't0' WHEN v <= 3 THEN 't1' ELSE 't2' END AS text, (f > 0)::INT AS face FROM one),
t AS (SELECT b.*, donor_user, row_number() OVER (PARTITION BY user_id ORDER BY photo_id) - 1 AS o FROM b JOIN cyc USING (user_id)),
d AS (SELECT *, row_number() OVER (PARTITION BY user_id, month, text, face ORDER BY photo_id) - 1 AS i0, count(*) OVER (PARTITION BY user_id, month, text, face) AS n0,
  row_number() OVER (PARTITION BY user_id, month ORDER BY photo_id) - 1 AS i1, count(*) OVER (PARTITION BY user_id, month) AS n1, row_number() OVER (PARTITION BY user_id ORDER BY photo_id) - 1 AS i2, count(*) OVER (PARTITION BY user_id) AS n2 FROM b)
SELECT t.user_id, t.photo_id, t.donor_user, coalesce(a.photo_id, m.photo_id, e.photo_id) AS donor, CASE WHEN a.photo_id IS NOT NULL THEN 0 WHEN m.photo_id IS NOT NULL THEN 1 WHEN e.photo_id IS NOT NULL THEN 2 END AS level FROM t
LEFT JOIN d a ON a.user_id = t.donor_user AND a.month = t.month AND a.text = t.text AND a.face = t.face AND a.i0 = t.o % a.n0
LEFT JOIN d m ON m.user_id = t.donor_user AND m.month = t.month AND m.i1 = t.o % m.n1 LEFT JOIN d e ON e.user_id = t.donor_user AND e.i2 = t.o % e.n2""",
    "lru_evictions": """
WITH e AS (SELECT doc_id, coalesce(n_chars, 0) AS size, ingested_at FROM documents), t AS (SELECT sum(size) AS total, (SELECT coalesce(sum(n_chars), 0) FROM documents) * 7 // 10 AS lim FROM e),
r AS (SELECT doc_id, size, sum(size) OVER (ORDER BY ingested_at NULLS FIRST, doc_id ROWS UNBOUNDED PRECEDING) - size AS gone FROM e)
SELECT doc_id, size, gone::BIGINT AS freed_before FROM r, t WHERE total > lim AND gone < total - 0.8::DOUBLE * lim""",
    "unpivot_targets": """
WITH t AS (SELECT DISTINCT row_id, person_id, canonical_name, relation, relation_category FROM target_persons),
u AS (SELECT row_id, person_id, 'person_name' AS target_type, canonical_name AS target_value FROM t UNION ALL SELECT row_id, person_id, 'person_relation', relation FROM t UNION ALL SELECT row_id, person_id, 'person_category', relation_category FROM t)
SELECT * FROM u WHERE trim(target_value) <> ''""",
    "batch_chunking": f"""
WITH f AS (SELECT DISTINCT user_id, face_id FROM ({SEEN})), b AS (SELECT *, (row_number() OVER (PARTITION BY user_id ORDER BY face_id) - 1) // 8 AS batch_no FROM f)
SELECT user_id, batch_no, count(*) AS n, min(face_id) AS first_face, max(face_id) AS last_face FROM b GROUP BY user_id, batch_no""",
    "event_graph_direct": f"""
WITH {NODES}, x AS (SELECT *, unnest(name_surfaces) AS name FROM (SELECT *, unnest(face_ids) AS face_id FROM c)),
e AS (SELECT user_id, face_id, name, event_id, round(greatest(0, least(1, 0.58::DOUBLE + CASE WHEN owner THEN 0.06 ELSE 0 END + CASE WHEN len(relation_terms) > 0 THEN 0.06 ELSE 0 END + CASE WHEN channel <> 'general' THEN 0.05 ELSE 0 END
  + CASE WHEN {FULL.format('name')} THEN 0.08 ELSE 0 END + CASE WHEN len(face_ids) <= 3 THEN 0.04 ELSE -least(0.10, 0.01 * (len(face_ids) - 3)) END)), 6) AS score FROM x) {BEST}""",
    "event_graph_cross": f"""
WITH {NODES}, pr AS (
  SELECT t.user_id, t.event_id AS te, f.event_id AS fe, CASE WHEN t.place <> '' AND t.place = f.place THEN 0.58 WHEN t.city <> '' AND t.city = f.city THEN 0.42 END::DOUBLE AS base, t.channels AS tc, f.channels AS fc, t.terms AS tt, f.terms AS ft,
    t.owner OR f.owner AS ow, t.name_surfaces, f.face_ids FROM c t JOIN c f ON t.user_id = f.user_id AND t.ym = f.ym AND t.ym <> '' AND t.event_id <> f.event_id
  WHERE len(t.name_surfaces) > 0 AND len(t.text_photo_ids) > 0 AND len(f.face_ids) > 0 AND len(f.face_photo_ids) > 0),
s AS (SELECT *, round(least(1, base + least(0.22, 0.10 * len(list_intersect(tc, fc))) + least(0.12, 0.04 * len(list_intersect(tt, ft))) + CASE WHEN ow THEN 0.03 ELSE 0 END), 6) AS bridge, len(list_intersect(tc, fc)) > 0 AS sc FROM pr WHERE base IS NOT NULL),
k AS (SELECT * FROM s WHERE bridge >= 0.5 QUALIFY row_number() OVER (PARTITION BY user_id, te ORDER BY bridge DESC, fe) <= 12),
x AS (SELECT *, unnest(name_surfaces) AS name FROM (SELECT *, unnest(face_ids) AS face_id FROM k)),
e AS (SELECT user_id, face_id, name, te AS event_id, round(greatest(0, least(1, 0.30::DOUBLE + 0.55::DOUBLE * bridge + CASE WHEN ow THEN 0.04 ELSE 0 END + CASE WHEN sc THEN 0.04 ELSE 0 END + CASE WHEN {FULL.format('name')} THEN 0.04 ELSE 0 END
  - CASE WHEN len(face_ids) > 4 THEN least(0.08, 0.01 * (len(face_ids) - 4)) ELSE 0 END)), 6) AS score FROM x) {BEST}""",
    "stress_retention": " UNION ALL ".join([_counts(PLAIN, "none"), *(_counts(_stressed(s), s) for s in perturb.SETTINGS)]),
    "face_dropout": f"SELECT DISTINCT user_id, photo_id, face_id FROM (SELECT user_id, photo_id, unnest(visible_face_ids) AS face_id FROM {_stressed('face_miss_15')}) WHERE face_id IS NOT NULL",
    "modality_masks": " UNION ALL ".join(_counts(MASKED[m], m) for m in perturb.MASKS),
    "stable_timestamps": """
WITH one AS (SELECT user_id, photo_id, min(year_month) AS ym FROM photos GROUP BY ALL)
SELECT user_id, photo_id, ('0x' || sha256(user_id || ':' || photo_id)[1:8])::BIGINT % 28 + 1 AS day, ('0x' || sha256(user_id || ':' || photo_id || ':m')[1:8])::BIGINT % 1440 AS minute FROM one WHERE ym IS NOT NULL AND ym <> ''""",
    "dual_view_audit": """
WITH p AS (SELECT DISTINCT user_id, photo_id, timestamp FROM photos), f AS (SELECT DISTINCT user_id, unnest(visible_face_ids) AS face_id FROM photos),
e AS (SELECT user_id, photo_id, unnest(text_entities) AS e FROM photos), t AS (SELECT DISTINCT user_id, person_id, face_id, canonical_name, accepted_aliases FROM target_persons),
v AS (
  SELECT 'private_photo_id' AS rule, user_id, photo_id AS subject FROM p WHERE regexp_matches(lower(photo_id), '(^|[^a-z0-9_])(kp_fact_|kp_node_|evt_[0-9]|amb_[0-9])')
  UNION SELECT 'owner_as_face', user_id, face_id FROM f WHERE face_id = 'owner'
  UNION SELECT 'unit_of_unknown_face', user_id, face_id FROM face_units u WHERE face_id IS NOT NULL AND NOT EXISTS (SELECT 1 FROM f WHERE f.user_id = u.user_id AND f.face_id = u.face_id)
  UNION SELECT 'target_without_aliases', user_id, person_id FROM t WHERE len(list_filter(coalesce(accepted_aliases, []), lambda x: trim(x) <> '')) = 0
  UNION SELECT 'person_without_reasoning', user_id, row_id::VARCHAR FROM predicted_persons WHERE trim(coalesce(reasoning_path, '')) = ''
  UNION SELECT 'unknown_photo_cited', user_id, row_id::VARCHAR FROM (SELECT user_id, row_id, unnest(evidence_photo_ids) AS photo_id FROM predicted_persons) c WHERE photo_id IS NOT NULL AND NOT EXISTS (SELECT 1 FROM p WHERE p.user_id = c.user_id AND p.photo_id = c.photo_id)
  UNION
  SELECT 'bad_photo_id' AS rule, user_id, photo_id AS subject FROM p WHERE NOT regexp_matches(photo_id, '^photo_[0-9]{4,}$')
  UNION SELECT 'bad_face_id', user_id, face_id FROM f WHERE NOT regexp_matches(face_id, '^face_[0-9]{3,}$')
  UNION SELECT 'entity_without_surface', user_id, photo_id FROM e WHERE trim(coalesce(e.surface, '')) = ''
  UNION SELECT 'entity_source', user_id, photo_id FROM e WHERE coalesce(e.source, '') NOT IN ('caption', 'visible_text')
  UNION SELECT 'entity_type', user_id, photo_id FROM e WHERE coalesce(e.entity_type, '') NOT IN ('person', 'organization', 'location', 'event')
  UNION SELECT 'unit_of_unknown_photo', user_id, photo_id FROM face_units u WHERE NOT EXISTS (SELECT 1 FROM p WHERE p.user_id = u.user_id AND p.photo_id = u.photo_id)
  UNION SELECT 'target_face_not_shown', user_id, person_id FROM t WHERE face_id <> '' AND NOT EXISTS (SELECT 1 FROM f WHERE f.user_id = t.user_id AND f.face_id = t.face_id)
  UNION SELECT 'target_without_name', user_id, person_id FROM t WHERE trim(coalesce(canonical_name, '')) = ''
  UNION SELECT 'photo_with_two_dates', user_id, photo_id FROM p GROUP BY user_id, photo_id HAVING count(DISTINCT timestamp) > 1)
SELECT rule, user_id, count(*) AS n, min(subject) AS first_subject FROM v GROUP BY rule, user_id""",
    "leak_scan": r"""
WITH t AS (SELECT doc_id, lower(text) AS t FROM documents)
SELECT doc_id, 'home_path' AS kind FROM t WHERE regexp_matches(t, '/(home|users)/[a-z0-9_.-]+/')
UNION ALL SELECT doc_id, 'secret_key' FROM t WHERE regexp_matches(t, '(api[_-]?key|secret|token)[ ]*[:=][ ]*[a-z0-9_-]{12,}')
UNION ALL SELECT doc_id, 'private_id' FROM t WHERE regexp_matches(t, '(^|[^a-z0-9_])(kp_fact_|kp_node_|evt_[0-9]|amb_[0-9])')""",
    "id_map_audit": """
WITH m AS (SELECT DISTINCT user_id || '/' || person_id AS a, user_id || '/' || face_id AS b FROM target_persons WHERE face_id <> '')
SELECT 'private' AS side, a AS id, count(*) AS n FROM m GROUP BY a HAVING count(*) > 1 UNION ALL SELECT 'public', b, count(*) FROM m GROUP BY b HAVING count(*) > 1""",
}
