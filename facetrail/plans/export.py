"""Queries of the export: views, sources, rosters, alignments, identifiers, evidence, profiles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from facetrail.operators import albums as A
from facetrail.operators import audit, derive as D
from facetrail.operators import export as X
from facetrail.operators import profiles as P
from facetrail.operators import reports as R
from facetrail.plans import albums as AQ
from facetrail.plans import derivations as DQ
from facetrail.plans import evaluation as EQ
from facetrail.plans import judging as JQ
from facetrail.plans import profiles as PQ
from facetrail.plans import relations as RQ
from facetrail.session import table

SEED = 20260609


def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return table(spark, d, name)


def public_photos(spark: SparkSession, d: str) -> DataFrame:
    p = _t(spark, d, "photos")
    out = X.public_photos(p, X.public_ids(p), X.permuted_faces(A.appearances(p), SEED))
    return out.select("user_id", "photo_id", F.md5("caption").alias("caption_md5"), F.size("visible_text").alias("n_texts"), F.concat_ws(",", "visible_face_ids").alias("faces"), "gps_city", "device")


def permuted_faces(spark: SparkSession, d: str) -> DataFrame:
    return X.permuted_faces(A.appearances(_t(spark, d, "photos")), SEED)


def remapped_evidence(spark: SparkSession, d: str) -> DataFrame:
    p = JQ._predicted(spark, d).select("row_id", "user_id", "evidence_photo_ids")
    out = X.remapped(p, "row_id", "evidence_photo_ids", X.public_ids(_t(spark, d, "photos")), "photo_id", "public_id")
    return out.select("row_id", F.concat_ws(",", "evidence_photo_ids").alias("ids"))


def known_evidence(spark: SparkSession, d: str) -> DataFrame:
    """How many of the cited photos of every predicted person the album has, and how many it lacks."""
    p = JQ._predicted(spark, d).select("row_id", "user_id", F.explode(F.array_distinct("evidence_photo_ids")).alias("photo_id")).where("photo_id is not null")
    k = _t(spark, d, "photos").select("user_id", "photo_id").distinct().withColumn("k", F.lit(1))
    return p.join(k, ["user_id", "photo_id"], "left").groupBy("row_id").agg(F.count("k").alias("n_known"), F.count_if(F.col("k").isNull()).alias("n_unknown"))


def _cited(spark: SparkSession, d: str) -> DataFrame:
    return JQ._predicted(spark, d).select("user_id", F.explode("evidence_photo_ids").alias("photo_id")).distinct()


def photo_sources(spark: SparkSession, d: str) -> DataFrame:
    s = X.photo_sources(_t(spark, d, "photos"), _t(spark, d, "event_nodes"), _cited(spark, d))
    return s.groupBy("user_id", "source").agg(F.count("*").alias("n"), F.min("photo_id").alias("first_photo"))


def planned_metadata(spark: SparkSession, d: str) -> DataFrame:
    return X.planned_metadata(_t(spark, d, "photos"))


def target_atoms(spark: SparkSession, d: str) -> DataFrame:
    return X.aliases_as_atoms(_t(spark, d, "target_persons"))


def entity_alignment(spark: SparkSession, d: str) -> DataFrame:
    t, c, p = (_t(spark, d, x) for x in ("target_persons", "name_clusters", "photos"))
    m = c.select("user_id", F.explode("mention_photo_ids").alias("photo_id")).distinct()
    rows = t.where("face_id <> ''").groupBy("user_id", "person_id").agg(F.min("face_id").alias("face_id")).join(m, "user_id")
    seen = A.appearances(p).withColumn("easy", F.lit(True))
    easy = rows.join(seen, ["user_id", "photo_id", "face_id"]).select("user_id", "person_id", "photo_id", F.lit("easy").alias("difficulty")).distinct()
    out = X.entity_alignment(t, c, easy)
    return out.withColumn("n_photos", F.size("photos")).drop("photos")


def _mentions(spark: SparkSession, d: str) -> DataFrame:
    from facetrail.functions.text import fold

    t, c = _t(spark, d, "target_persons"), _t(spark, d, "name_clusters")
    names = t.select("user_id", "person_id", fold(F.col("canonical_name")).alias("k")).where("k <> ''").distinct()
    said = c.select("user_id", F.explode("mention_photo_ids").alias("photo_id"), fold(F.col("primary_surface")).alias("k")).distinct()
    return names.join(said, ["user_id", "k"]).select("user_id", "person_id", "photo_id").distinct()


def person_roster(spark: SparkSession, d: str) -> DataFrame:
    out = X.roster(_t(spark, d, "target_persons"), A.appearances(_t(spark, d, "photos")), _mentions(spark, d))
    return out.withColumn("both", F.concat_ws(",", "both"))


def evidence_sequence(spark: SparkSession, d: str) -> DataFrame:
    return X.supports(JQ._predicted(spark, d).select("user_id", "row_id", "evidence_photo_ids"), "evidence_photo_ids", ["row_id"])


def ranked_evidence(spark: SparkSession, d: str) -> DataFrame:
    p = JQ._predicted(spark, d).select("row_id", "user_id", "face_id", F.col("canonical_name").alias("name"), F.col("evidence_photo_ids").alias("cited"))
    texts = _t(spark, d, "photos").groupBy("user_id", "photo_id").agg(F.min("caption").alias("text")).where("text is not null")
    return X.ranked_evidence(p, A.appearances(_t(spark, d, "photos")), texts)


def album_sizes(spark: SparkSession, d: str) -> DataFrame:
    return X.gaussian_sizes(_t(spark, d, "photos").select("user_id").distinct(), 500, 1000, SEED)


def merged_facts(spark: SparkSession, d: str) -> DataFrame:
    p = JQ._predicted(spark, d).where("reasoning_path is not null").select("user_id", F.col("row_id").alias("fact_id"), F.col("reasoning_path").alias("text"), "variant")
    return X.merged_facts(p, D.signature(F.col("text")), F.coalesce(F.col("variant") == "full", F.lit(False)), 12)


def recomposed_albums(spark: SparkSession, d: str) -> DataFrame:
    """Persons of the full variant with the facts of the others, and the owner's face."""
    p = JQ._predicted(spark, d)
    owner = A.owner_faces(_t(spark, d, "photos"))
    a = p.where("variant = 'full'").groupBy("user_id").agg(F.array_sort(F.collect_set("canonical_name")).alias("persons")).join(owner, "user_id", "left")
    b = p.where("variant <> 'full'").groupBy("user_id").agg(F.count("reasoning_path").alias("facts")).withColumn("owner_face", F.lit("?"))
    return R.recomposed(a, b).select("user_id", "owner_face", F.size("persons").alias("n_persons"), F.col("facts").alias("n_facts"))


def albums_to_do(spark: SparkSession, d: str) -> DataFrame:
    """Albums without predictions, or whose photos or targets an audit finds fault with."""
    faults = audit.violations(*[_t(spark, d, t) for t in ("photos", "face_units", "target_persons")]).where("rule in ('target_without_name', 'photo_with_two_dates')")
    return R.unfinished(_t(spark, d, "photos").where("user_id is not null"), _t(spark, d, "predicted_persons"), faults)


def event_participants(spark: SparkSession, d: str) -> DataFrame:
    """Faces of every event by how many events of the album they take part in."""
    e = _t(spark, d, "event_nodes").select("user_id", "event_id", F.explode("face_ids").alias("face_id")).where("face_id is not null").distinct()
    return e.groupBy("user_id", "face_id").agg(F.count("*").alias("n_events"), F.min("event_id").alias("first_event"), F.max("event_id").alias("last_event"))


def photo_events(spark: SparkSession, d: str) -> DataFrame:
    """The event of every photo: the last by id where several have it."""
    return _t(spark, d, "event_nodes").select("user_id", "event_id", F.explode("photo_ids").alias("photo_id")).where("photo_id is not null").groupBy("user_id", "photo_id").agg(F.max("event_id").alias("event_id"), F.count_distinct("event_id").alias("n_events"))


def face_catalog(spark: SparkSession, d: str) -> DataFrame:
    """Registered persons at faces that photos show, and the owner's face: who each face is."""
    seen = A.appearances(_t(spark, d, "photos")).select("user_id", "face_id").distinct()
    t = _t(spark, d, "target_persons").where("face_id <> ''").select("user_id", "face_id", "person_id").distinct().join(seen, ["user_id", "face_id"], "left_semi").withColumn("role", F.lit("person"))
    o = A.owner_faces(_t(spark, d, "photos")).select("user_id", F.col("owner_face").alias("face_id"), F.lit("owner").alias("person_id"), F.lit("owner").alias("role"))
    return t.unionByName(o)


def face_profiles(spark: SparkSession, d: str) -> DataFrame:
    """The best name of every face by its edges, with its evidence; faces without one unresolved."""
    e = _t(spark, d, "identity_edges").where("score >= 0 and score <= 1 and not isnan(score) and trim(name_surface) <> ''")
    one = e.groupBy("user_id", "face_id", F.lower(F.trim("name_surface")).alias("name")).agg(*[F.min_by(c, F.struct(-F.col("score"), "edge_id")).alias(k) for k, c in (("same", "evidence_photo_ids"), ("text", "text_photo_ids"), ("face", "face_photo_ids"))])
    top = AQ.edge_margin(spark, d).where("rank = 1 and score >= 0.34").select("user_id", "face_id", "name", "score", "margin").join(one, ["user_id", "face_id", "name"])
    out = X.profile_rows(top, A.appearances(_t(spark, d, "photos")))
    return out.withColumn("evidence", F.concat_ws(",", "evidence"))


def narratives(spark: SparkSession, d: str) -> DataFrame:
    """A sentence for every cluster: how many photos and texts name it and what they call the person."""
    c = _t(spark, d, "name_clusters").groupBy("cluster_id").agg(F.min("primary_surface").alias("name"), F.max(F.coalesce(F.size("mention_photo_ids"), F.lit(0))).alias("n"), F.max(F.coalesce(F.size("text_unit_ids"), F.lit(0))).alias("m"))
    r = P.relations_by_priority(_t(spark, d, "name_clusters"))
    zero = F.lit(0)
    return c.join(r, "cluster_id", "left").select("cluster_id", X.narrative(F.col("name"), F.greatest("n", zero), F.greatest("m", zero), zero, F.col("relation")).alias("narrative"))


def owner_pronouns(spark: SparkSession, d: str) -> DataFrame:
    g = PQ.owner_gender(spark, d)
    subject, possessive = X.pronouns(F.col("gender"))
    return g.select("user_id", subject.alias("subject"), possessive.alias("possessive"))


def birth_years(spark: SparkSession, d: str) -> DataFrame:
    """The birth year that an album's texts give, and the age at the end of the last month of its photos."""
    b = D.birth_dates(_t(spark, d, "text_units"))
    end = _t(spark, d, "photos").where("year_month rlike '^[0-9]{4}-[0-9]{2}$'").groupBy("user_id").agg(F.max("year_month").alias("ym"))
    on = F.last_day(F.concat("ym", F.lit("-01")).try_cast("date"))
    return b.join(end, "user_id").select("user_id", "year", D.age_at(F.col("year"), F.col("month"), F.col("day"), on).alias("age"))


FUNCTIONS = (
    public_photos, permuted_faces, remapped_evidence, known_evidence, photo_sources, planned_metadata, target_atoms, entity_alignment, person_roster, evidence_sequence, ranked_evidence, album_sizes, merged_facts, recomposed_albums, albums_to_do,
    event_participants, photo_events, face_catalog, face_profiles, narratives, owner_pronouns, birth_years,
)
QUERIES = {f.__name__: f for f in FUNCTIONS}

SEEN, OWNER, FOLD, PRED = AQ.SEEN, AQ.OWNER, EQ.FOLD, JQ.PRED
PUB = "one AS (SELECT user_id, photo_id, min(coalesce(timestamp, '')) AS ts FROM photos GROUP BY ALL), pub AS (SELECT user_id, photo_id, printf('photo_%05d', row_number() OVER (PARTITION BY user_id ORDER BY ts, photo_id)) AS public_id FROM one)"
PERM = f"fc AS (SELECT DISTINCT user_id, face_id FROM ({SEEN})), perm AS (SELECT user_id, face_id, printf('face_%03d', row_number() OVER (PARTITION BY user_id ORDER BY sha256('{SEED}|' || user_id || '|' || face_id), face_id)) AS public_face FROM fc)"
SQL = {
    "public_photos": f"""WITH {PUB}, {PERM}, s AS ({SEEN}), f AS (SELECT s.user_id, s.photo_id, string_agg(public_face, ',' ORDER BY public_face) AS faces FROM s JOIN perm USING (user_id, face_id) GROUP BY ALL),
p AS (SELECT user_id, photo_id, min(coalesce(caption, '')) AS c, min(visible_text) AS v, min(metadata) AS m FROM photos GROUP BY ALL)
SELECT p.user_id, public_id AS photo_id, md5(c) AS caption_md5, len(coalesce(v, [])) AS n_texts, coalesce(faces, '') AS faces, coalesce(m.gps_city, '') AS gps_city, coalesce(m.device, '') AS device FROM p JOIN pub USING (user_id, photo_id) LEFT JOIN f USING (user_id, photo_id)""",
    "permuted_faces": f"WITH {PERM} SELECT user_id, face_id, public_face FROM perm",
    "remapped_evidence": f"""WITH {PUB}, {PRED}, e AS (SELECT row_id, user_id, unnest(ids) AS photo_id, generate_subscripts(ids, 1) AS i FROM pr), m AS (SELECT row_id, public_id, min(i) AS i FROM e JOIN pub USING (user_id, photo_id) GROUP BY ALL)
SELECT row_id, string_agg(public_id, ',' ORDER BY i) AS ids FROM m GROUP BY row_id""",
    "known_evidence": f"""WITH {PRED}, e AS (SELECT DISTINCT row_id, user_id, unnest(ids) AS photo_id FROM pr), k AS (SELECT DISTINCT user_id, photo_id FROM photos)
SELECT row_id, count(k.photo_id) AS n_known, count(*) FILTER (k.photo_id IS NULL) AS n_unknown FROM e LEFT JOIN k USING (user_id, photo_id) WHERE e.photo_id IS NOT NULL GROUP BY row_id""",
    "photo_sources": f"""WITH {PRED}, c AS (SELECT DISTINCT user_id, unnest(ids) AS photo_id FROM pr), e AS (SELECT DISTINCT user_id, unnest(photo_ids) AS photo_id FROM event_nodes), p AS (SELECT DISTINCT user_id, photo_id FROM photos),
s AS (SELECT p.*, CASE WHEN c.photo_id IS NOT NULL THEN 'key_evidence' WHEN e.photo_id IS NOT NULL THEN 'event' ELSE 'ambient' END AS source FROM p LEFT JOIN c USING (user_id, photo_id) LEFT JOIN e USING (user_id, photo_id))
SELECT user_id, source, count(*) AS n, min(photo_id) AS first_photo FROM s GROUP BY user_id, source""",
    "planned_metadata": r"""WITH o AS (SELECT user_id, photo_id, min(year_month) AS ym, min(concat_ws(', ', nullif(metadata.gps_location, ''), nullif(metadata.gps_city, ''))) AS place FROM photos GROUP BY ALL),
k AS (SELECT *, ('0x' || sha256(user_id || ':' || photo_id)[1:8])::BIGINT % 28 + 1 AS d, ('0x' || sha256(user_id || ':' || photo_id || ':m')[1:8])::BIGINT % 1440 AS m FROM o WHERE regexp_matches(ym, '^[0-9]{4}-[0-9]{2}$'))
SELECT user_id, photo_id, printf('%s-%02dT%02d:%02d:00', ym, d, m // 60, m % 60) AS timestamp, place FROM k""",
    "target_atoms": """WITH t AS (SELECT person_id, min(canonical_name) AS c, list_filter(coalesce(min(accepted_aliases), []), lambda x: trim(x) <> '') AS a FROM target_persons GROUP BY person_id),
d AS (SELECT person_id, CASE WHEN len(a) > 0 THEN list_filter(a, lambda x, i: list_position(a, x) = i) WHEN trim(c) <> '' THEN [c] ELSE [] END AS a FROM t)
SELECT person_id, (generate_subscripts(a, 1) - 1)::INT AS atom_no, unnest(a) AS atom FROM d""",
    "entity_alignment": f"""WITH s AS ({SEEN}), n AS (SELECT DISTINCT user_id, person_id, {FOLD.format('s')} AS k FROM (SELECT user_id, person_id, unnest(list_concat([canonical_name], coalesce(accepted_aliases, []))) AS s FROM target_persons)),
c AS (SELECT DISTINCT user_id, cluster_id, mention_photo_ids AS m, {FOLD.format('s')} AS k FROM (SELECT user_id, cluster_id, mention_photo_ids, unnest(surfaces) AS s FROM name_clusters)),
j AS (SELECT n.user_id, n.person_id, n.k, cluster_id, unnest(CASE WHEN coalesce(len(m), 0) = 0 THEN [NULL] ELSE m END) AS photo_id FROM n JOIN c USING (user_id, k) WHERE k <> ''),
t AS (SELECT user_id, person_id, min(face_id) AS face_id FROM target_persons WHERE face_id <> '' GROUP BY ALL),
l AS (SELECT j.*, CASE WHEN j.photo_id IS NOT NULL THEN CASE WHEN EXISTS (SELECT 1 FROM t JOIN s ON s.user_id = t.user_id AND s.face_id = t.face_id WHERE t.user_id = j.user_id AND t.person_id = j.person_id AND s.photo_id = j.photo_id) THEN 0 ELSE 2 END END AS l FROM j)
SELECT user_id, person_id, k AS surface_key, count(DISTINCT cluster_id) AS n_clusters, ['easy', 'medium', 'hard'][min(l) + 1] AS difficulty, count(DISTINCT photo_id) AS n_photos FROM l GROUP BY user_id, person_id, k""",
    "person_roster": f"""WITH s AS ({SEEN}), t AS (SELECT user_id, person_id, min(face_id) AS face_id FROM target_persons GROUP BY ALL), f AS (SELECT t.user_id, t.person_id, s.photo_id FROM t JOIN s USING (user_id, face_id)),
n AS (SELECT DISTINCT user_id, person_id, {FOLD.format('canonical_name')} AS k FROM target_persons), c AS (SELECT DISTINCT user_id, unnest(mention_photo_ids) AS photo_id, {FOLD.format('primary_surface')} AS k FROM name_clusters),
m AS (SELECT DISTINCT n.user_id, n.person_id, c.photo_id FROM n JOIN c USING (user_id, k) WHERE k <> '')
SELECT t.user_id, t.person_id, (SELECT count(*) FROM f WHERE f.user_id = t.user_id AND f.person_id = t.person_id) AS n_face_photos, (SELECT count(*) FROM m WHERE m.user_id = t.user_id AND m.person_id = t.person_id) AS n_mention_photos,
  coalesce((SELECT string_agg(f.photo_id, ',' ORDER BY f.photo_id) FROM f JOIN m USING (user_id, person_id, photo_id) WHERE f.user_id = t.user_id AND f.person_id = t.person_id), '') AS both FROM t""",
    "evidence_sequence": f"""WITH {PRED}, e AS (SELECT user_id, row_id, unnest(ids) AS photo_id, generate_subscripts(ids, 1) AS i FROM pr) SELECT user_id, row_id, photo_id, row_number() OVER (PARTITION BY user_id ORDER BY row_id, i) AS sequence FROM e""",
    "ranked_evidence": f"""WITH {PRED}, s AS ({SEEN}), p AS (SELECT row_id, user_id, face_id, ids, {FOLD.format("coalesce(cn, '')")} AS name FROM pr), tx AS (SELECT user_id, photo_id, ' ' || {FOLD.format('min(caption)')} || ' ' AS t FROM photos GROUP BY user_id, photo_id HAVING min(caption) IS NOT NULL),
u AS (SELECT row_id, s.photo_id, 4.0 AS f, 0.0 AS n, 0.0 AS c FROM p JOIN s USING (user_id, face_id)
  UNION ALL SELECT row_id, tx.photo_id, 0, CASE WHEN contains(t, ' ' || name || ' ') THEN 4.0 ELSE 1.5 END, 0 FROM p JOIN tx USING (user_id) WHERE string_split(name, ' ')[1] <> '' AND contains(t, ' ' || string_split(name, ' ')[1] || ' ')
  UNION ALL SELECT row_id, photo_id, 0, 0, 1 FROM (SELECT row_id, unnest(ids) AS photo_id FROM p) WHERE photo_id IS NOT NULL),
g AS (SELECT row_id, photo_id, max(f) AS f, max(n) AS n, max(c) AS c FROM u GROUP BY ALL), k AS (SELECT row_id, photo_id, (f + n + c + CASE WHEN f > 0 AND n > 0 THEN 2 ELSE 0 END)::DOUBLE AS score FROM g)
SELECT row_id, row_number() OVER (PARTITION BY row_id ORDER BY score DESC, photo_id) AS rank, photo_id, score FROM k QUALIFY rank <= 8""",
    "album_sizes": f"""WITH u AS (SELECT DISTINCT user_id FROM photos), z AS (SELECT user_id, sqrt(-2.0::DOUBLE * ln(greatest({RQ.UNIT.format(f"'{SEED}:' || user_id || ':a'")}, 1e-12))) * cos(2 * pi() * {RQ.UNIT.format(f"'{SEED}:' || user_id || ':b'")}) AS z FROM u)
SELECT user_id, greatest(500, least(1000, floor(750 + z * 500 / 6.0::DOUBLE + 0.5)))::INT AS target FROM z""",
    "merged_facts": f"""WITH {PRED}, t AS (SELECT row_id, user_id, variant, {DQ.SQL['fact_signatures'].split('SELECT doc_id, ')[1].split(' AS w FROM')[0].replace('text', 'path')} AS w FROM pr WHERE path IS NOT NULL), s AS (SELECT row_id, user_id, variant, {JQ.SIG} AS sig FROM t),
o AS (SELECT user_id, sig, min((CASE WHEN variant = 'full' THEN 0 ELSE 1 END, row_id)) AS o FROM s WHERE sig <> '' GROUP BY ALL), m AS (SELECT user_id, arg_min(row_id, (CASE WHEN variant = 'full' THEN 0 ELSE 1 END, row_id)) AS fact_id, min(CASE WHEN variant = 'full' THEN 0 ELSE 1 END) AS p FROM s WHERE sig <> '' GROUP BY user_id, sig)
SELECT user_id, fact_id, row_number() OVER (PARTITION BY user_id ORDER BY p, fact_id) AS rank FROM m QUALIFY rank <= 12""",
    "recomposed_albums": f"""WITH {PRED}, o AS ({OWNER}), a AS (SELECT user_id, count(DISTINCT cn) AS n FROM pr WHERE variant = 'full' GROUP BY user_id), b AS (SELECT user_id, count(path) AS f FROM pr WHERE variant <> 'full' GROUP BY user_id)
SELECT a.user_id, coalesce(nullif(o.owner_face, ''), '?') AS owner_face, n AS n_persons, f AS n_facts FROM a JOIN b USING (user_id) LEFT JOIN o USING (user_id)""",
    "albums_to_do": f"""WITH v AS ({RQ.SQL['dual_view_audit']}), f AS (SELECT DISTINCT user_id FROM v WHERE rule IN ('target_without_name', 'photo_with_two_dates')), done AS (SELECT DISTINCT user_id FROM predicted_persons WHERE user_id NOT IN (SELECT user_id FROM f WHERE user_id IS NOT NULL))
SELECT DISTINCT user_id FROM photos WHERE user_id IS NOT NULL AND user_id NOT IN (SELECT user_id FROM done WHERE user_id IS NOT NULL)""",
    "event_participants": """WITH e AS (SELECT DISTINCT user_id, event_id, unnest(face_ids) AS face_id FROM event_nodes) SELECT user_id, face_id, count(*) AS n_events, min(event_id) AS first_event, max(event_id) AS last_event FROM e WHERE face_id IS NOT NULL GROUP BY user_id, face_id""",
    "photo_events": """WITH e AS (SELECT user_id, event_id, unnest(photo_ids) AS photo_id FROM event_nodes) SELECT user_id, photo_id, max(event_id) AS event_id, count(DISTINCT event_id) AS n_events FROM e WHERE photo_id IS NOT NULL GROUP BY user_id, photo_id""",
    "face_catalog": f"""WITH s AS (SELECT DISTINCT user_id, face_id FROM ({SEEN})) SELECT DISTINCT t.user_id, t.face_id, t.person_id, 'person' AS role FROM target_persons t JOIN s ON s.user_id = t.user_id AND s.face_id = t.face_id WHERE t.face_id <> ''
UNION ALL SELECT user_id, owner_face, 'owner', 'owner' FROM ({OWNER})""",
    "face_profiles": f"""WITH e AS (SELECT user_id, face_id, lower(trim(name_surface)) AS name, score, edge_id, evidence_photo_ids, text_photo_ids, face_photo_ids FROM identity_edges WHERE score >= 0 AND score <= 1 AND NOT isnan(score) AND trim(name_surface) <> ''),
o AS (SELECT user_id, face_id, name, arg_min({{'s': evidence_photo_ids, 't': text_photo_ids, 'f': face_photo_ids}}, (-score, edge_id)) AS l FROM e GROUP BY ALL),
t AS (SELECT m.user_id, m.face_id, m.name, m.score, m.margin, list_filter(list_concat(list_concat(coalesce(l.s, []), coalesce(l.t, [])), coalesce(l.f, [])), lambda x: x IS NOT NULL) AS ev FROM ({AQ.SQL['edge_margin']}) m JOIN o USING (user_id, face_id, name) WHERE m.rank = 1 AND m.score >= 0.34::DOUBLE),
f AS (SELECT DISTINCT user_id, face_id FROM ({SEEN}))
SELECT f.user_id, f.face_id, coalesce(name, '') AS name, CASE WHEN name IS NULL THEN 0 ELSE round(greatest(0.05, least(0.95, 0.36::DOUBLE + 0.52::DOUBLE * score + 0.30::DOUBLE * margin)), 3) END AS confidence, coalesce(array_to_string(list_filter(ev, lambda x, i: list_position(ev, x) = i)[1:8], ','), '') AS evidence, CASE WHEN name IS NULL THEN 'unresolved' ELSE 'resolved' END AS status
FROM f LEFT JOIN t USING (user_id, face_id)""",
    "narratives": f"""WITH r AS ({PQ.SQL['cluster_relations']}), c AS (SELECT cluster_id, min(primary_surface) AS name, max(coalesce(len(mention_photo_ids), 0)) AS n, max(coalesce(len(text_unit_ids), 0)) AS m FROM name_clusters GROUP BY cluster_id)
SELECT c.cluster_id, coalesce(name, '?') || ': ' || coalesce(nullif(concat_ws('; ', CASE WHEN n > 0 THEN 'shown and named on ' || n || ' photos' END, CASE WHEN m > 0 THEN m || ' bridges of place and month' END, CASE WHEN coalesce(relation, '') <> '' THEN 'texts call them ' || relation END), ''), 'no evidence') || '.' AS narrative
FROM c LEFT JOIN r USING (cluster_id)""",
    "owner_pronouns": f"""WITH g AS ({PQ.SQL['owner_gender']}) SELECT user_id, CASE gender WHEN 'woman' THEN 'she' WHEN 'man' THEN 'he' ELSE 'they' END AS subject, CASE gender WHEN 'woman' THEN 'her' WHEN 'man' THEN 'his' ELSE 'their' END AS possessive FROM g""",
}
