"""Queries over names, claims, lexicon terms, event features, entities, and the units built from photos."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from facetrail.functions import claims as C
from facetrail.functions import lexicons as L
from facetrail.functions import people as P
from facetrail.functions.text import one_space
from facetrail.operators import albums as A
from facetrail.operators import inventory as V
from facetrail.session import table


def name_checks(spark: SparkSession, d: str) -> DataFrame:
    """Every surface of the texts and clusters: may it be a person's name, of use for an edge, or noise."""
    said = table(spark, d, "text_units").select(F.explode("person_surfaces").alias("s")).unionByName(table(spark, d, "name_clusters").select(F.explode("surfaces").alias("s")))
    n = said.where("s is not null").select(one_space(F.col("s")).alias("name")).distinct()
    return n.select("name", P.plausible_name(F.col("name")).alias("plausible"), P.usable_edge_name(F.col("name")).alias("usable"), P.noise_name(F.col("name")).alias("noise"))


def owner_like_clusters(spark: SparkSession, d: str) -> DataFrame:
    """Clusters whose name may be the owner's: the album's first name by weighted mentions."""
    owner = A.owner_names(table(spark, d, "text_units")).where("rank = 1").select("user_id", F.col("name").alias("owner"))
    c = table(spark, d, "name_clusters").select("user_id", "cluster_id", "primary_surface").where("primary_surface is not null").distinct()
    return c.join(owner, "user_id").select("cluster_id", "primary_surface", P.owner_like(F.col("primary_surface"), F.col("owner")).alias("owner_like"))


def misread_entities(spark: SparkSession, d: str) -> DataFrame:
    """Person entities of photos that text recognition may have made up."""
    p = table(spark, d, "photos").select("user_id", "photo_id", "caption", "visible_text", "visible_face_ids", F.explode("text_entities").alias("e")).where("lower(e.entity_type) = 'person' and e.surface is not null")
    faces = F.coalesce(F.size("visible_face_ids"), F.lit(0)) > 0
    rows = p.select("user_id", "photo_id", "e.surface", P.misread_name(F.col("e.surface"), F.col("e.source"), F.col("caption"), V.texts_of("visible_text"), F.lit(False), faces).alias("misread")).distinct()
    return rows.groupBy("user_id").agg(F.count("*").alias("n"), F.count_if("misread").alias("n_misread"))


def claim_checks(spark: SparkSession, d: str) -> DataFrame:
    t = F.col("text")
    flags = table(spark, d, "documents").where("text is not null").select("doc_id", C.hedged(t).alias("hedged"), C.broad_clothing(t).alias("clothing"), C.home_like(t).alias("home_like"), C.specific_detail(t, A.empty_list()).alias("specific"))
    return flags


def document_terms(spark: SparkSession, d: str) -> DataFrame:
    """Documents that hold each relation, activity and venue term."""
    t = F.col("text")
    kinds = F.array(*[F.struct(F.lit(k).alias("kind"), f(t).alias("terms")) for k, f in (("relation", C.relation_terms), ("activity", C.activity_terms), ("venue", C.venue_terms))])
    rows = table(spark, d, "documents").where("text is not null").select("doc_id", F.explode(kinds).alias("k")).select("doc_id", "k.kind", F.explode("k.terms").alias("term"))
    value, category = C.relation_value(F.col("term"))
    counted = rows.groupBy("kind", "term").agg(F.count("*").alias("n_docs"), F.min("doc_id").alias("first_doc"))
    none = F.lit("")
    return counted.select("kind", "term", F.when(F.col("kind") == "relation", value).otherwise(none).alias("relation"), F.when(F.col("kind") == "relation", category).otherwise(none).alias("category"), "n_docs", "first_doc")


def owner_references(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").where("text is not null").select("doc_id", C.owner_reference(F.col("text")).alias("score")).where("score > 0")


def _features(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "photos")
    text = F.concat_ws(" ", "caption", "visible_text", F.transform("text_entities", lambda e: e["surface"]), "metadata.gps_location", "metadata.gps_city")
    terms, channels = C.event_features(text)
    return p.select("user_id", "photo_id", terms.alias("terms"), channels.alias("channels"))


def event_features(spark: SparkSession, d: str) -> DataFrame:
    return _features(spark, d).select("user_id", "photo_id", F.concat_ws(",", "terms").alias("terms"), F.concat_ws(",", "channels").alias("channels")).distinct()


def found_entities(spark: SparkSession, d: str) -> DataFrame:
    """Capitalised entities of all captions, by kind."""
    rows = table(spark, d, "photos").select("user_id", "photo_id", F.explode(C.capitalised_entities(F.col("caption"))).alias("e")).distinct()
    return rows.groupBy("e.entity_type", "e.surface").agg(F.count("*").alias("n_photos"), F.count_distinct("user_id").alias("n_albums"))


def names_in_captions(spark: SparkSession, d: str) -> DataFrame:
    """Photos whose captions name a registered person of the album, in full or by the first name.

    Names meet captions on the first name's word, an equality join on album and word."""
    word = lambda c: F.split(F.trim(F.regexp_replace(F.lower(c), "[^a-z0-9_]+", " ")), " ")
    t = table(spark, d, "target_persons").where("trim(canonical_name) <> ''").select("user_id", "person_id", "canonical_name", F.element_at(word(F.col("canonical_name")), 1).alias("w")).where("w <> ''").distinct()
    p = table(spark, d, "photos").select("user_id", "photo_id", "caption", F.explode(F.array_distinct(word(F.col("caption")))).alias("w"))
    hit = p.join(t, ["user_id", "w"]).where(P.names_in(F.col("caption"), F.col("canonical_name")))
    return hit.select("user_id", "person_id", "photo_id").distinct().groupBy("user_id", "person_id").agg(F.count("*").alias("n_photos"), F.min("photo_id").alias("first_photo"))


def built_text_units(spark: SparkSession, d: str) -> DataFrame:
    """Text units made from photos: their terms, reference to the owner and face."""
    u = V.text_units(table(spark, d, "photos"))
    return u.select("user_id", "photo_id", F.size("visible_text").alias("n_texts"), F.concat_ws(",", "activity_terms").alias("activities"), F.concat_ws(",", "venue_terms").alias("venues"), "owner_reference_score", "has_face").where("n_texts > 0 or activities <> '' or venues <> ''")


def built_face_units(spark: SparkSession, d: str) -> DataFrame:
    photos = table(spark, d, "photos")
    u = V.face_units(photos, A.owner_faces(photos))
    return u.groupBy("user_id", "face_id").agg(F.count("*").alias("n_units"), F.sum(F.size("co_faces")).alias("n_co_faces"), F.count_if("owner_present").alias("n_with_owner"), F.sum(F.size("activity_terms")).alias("n_activities"))


def album_inventory(spark: SparkSession, d: str) -> DataFrame:
    return V.inventory(table(spark, d, "photos")).select("user_id", "n_photos", "first_month", "last_month", "n_faces", "n_face_photos", "n_face_units", "owner_face")


def photo_briefs(spark: SparkSession, d: str) -> DataFrame:
    b = V.photo_brief(table(spark, d, "photos"), 60, 3, 4, 2)
    return b.select("user_id", "photo_id", F.md5("caption").alias("caption_md5"), F.md5(F.concat_ws("|", "visible_text")).alias("texts_md5"), F.size("text_entities").alias("n_entities"), F.concat_ws(",", "visible_face_ids").alias("faces"), "gps_city")


def face_contexts(spark: SparkSession, d: str) -> DataFrame:
    c = V.face_context(table(spark, d, "photos"))
    return c.select("user_id", "face_id", "n_photos", "n_context", F.concat_ws(",", F.transform("context", lambda x: x["photo_id"])).alias("photos"))


FUNCTIONS = (
    name_checks, owner_like_clusters, misread_entities, claim_checks, document_terms, owner_references, event_features, found_entities, names_in_captions, built_text_units, built_face_units, album_inventory, photo_briefs, face_contexts,
)
QUERIES = {f.__name__: f for f in FUNCTIONS}


def _list(words) -> str:
    return "[" + ", ".join("'" + w.replace("'", "''") + "'" for w in words) + "]"


def _borders(pattern: str) -> str:
    """A pattern whose word borders hold for the letters of any script."""
    body = pattern
    if body.startswith(r"\b"):
        body = r"(^|[^\p{L}\p{M}\p{N}_])" + body[2:]
    if body.endswith(r"\b"):
        body = body[:-2] + r"($|[^\p{L}\p{M}\p{N}_])"
    return body.replace(r"\b", r"([^\p{L}\p{M}\p{N}_]|$)").replace("'", "''")


ONE = r"trim(regexp_replace({0}, '\s+', ' ', 'g'), ' ')"
WORDS = r"regexp_extract_all({0}, '[\p{{L}}\p{{N}}_]+')"
LETTERS = r"regexp_replace({0}, '[^\p{{L}}]', '', 'g')"
SHARE = r"(length(regexp_replace(lower({0}), '[^\p{{L}}]|[aeiou]', '', 'g')) / nullif(length(regexp_replace({0}, '[^\p{{L}}]', '', 'g')), 0)::DOUBLE)"
SHOUTED = r"(regexp_matches({0}, '\p{{Lu}}') AND NOT regexp_matches({0}, '\p{{Ll}}'))"
PLAUSIBLE = rf"""(trim(name) <> '' AND NOT regexp_matches(name, '[_@#&/]|\p{{Nd}}') AND NOT list_contains({_list((*L.NO_PERSONS, *L.RELATIONS))}, lower(name)) AND NOT (length(name) > 6 AND {SHOUTED.format('name')})
  AND w[1] NOT IN ('the', 'new', 'old') AND len(list_filter(w[2:], lambda x: list_contains({_list(L.NO_NAME_WORDS)}, regexp_replace(x, '^[.,]+|[.,]+$', '', 'g')))) = 0
  AND NOT (len(w) = 1 AND (length(w[1]) < 2 OR list_contains({_list(L.NO_NAME_WORDS)}, lower(name)))))"""


def _terms_sql(text: str, lexicon) -> str:
    """Terms as C.terms_in gives them, from text (lower case, single blanks)."""
    plain = [t for t in lexicon if " " not in t and "-" not in t and "'" not in t]
    odd = [t for t in lexicon if " " not in t and t not in plain]
    phrases = [t for t in lexicon if " " in t]
    parts = [f"list_filter({_list(plain)}, lambda z: list_contains({WORDS.format(text)}, z))"]
    if odd:
        parts.append("list_filter([" + ", ".join(f"CASE WHEN regexp_matches({text}, '{_borders(chr(92) + 'b' + t + chr(92) + 'b')}') THEN '{t}' END" for t in odd) + "], lambda z: z IS NOT NULL)")
    if phrases:
        parts.append(f"list_filter({_list(phrases)}, lambda z: contains({text}, z))")
    return f"list_transform(list_sort(list_transform(flatten([{', '.join(parts)}]), lambda z: {{'n': -length(z), 't': z}})), lambda s: s.t)"


LOW = ONE.format("lower({0})")
FIRST_PHOTO = """p AS (SELECT user_id, photo_id, arg_min({'caption': caption, 'visible_text': visible_text, 'text_entities': text_entities, 'visible_face_ids': visible_face_ids, 'metadata': metadata, 'year_month': year_month, 'timestamp': timestamp},
  (ingested_at, coalesce(caption, ''))) AS p FROM photos GROUP BY user_id, photo_id)"""
BLOB = r"array_to_string(list_filter(list_concat(list_concat([p.caption], coalesce(p.visible_text, [])), coalesce(list_transform(p.text_entities, lambda e: e.surface), [])), lambda t: trim(t) <> ''), chr(10))"
CHANNELS = "list_filter([" + ", ".join(f"CASE WHEN len(list_intersect(t, {_list(w)})) > 0 THEN '{c}' END" for c, w in sorted(L.CHANNEL_TERMS.items())) + "], lambda c: c IS NOT NULL)"
PHRASES = "[" + ", ".join(f"CASE WHEN contains(low, '{p.replace(chr(39), chr(39) * 2)}') THEN '{c}' END" for p, (c, _) in L.PHRASE_CHANNELS.items()) + "]"
PHRASE_TERMS = "flatten([" + ", ".join(f"CASE WHEN contains(low, '{p.replace(chr(39), chr(39) * 2)}') THEN {_list(t)} ELSE [] END" for p, (_, t) in L.PHRASE_CHANNELS.items()) + "])"
SEEN = A_SEEN = "SELECT DISTINCT user_id, photo_id, face_id FROM (SELECT user_id, photo_id, unnest(visible_face_ids) AS face_id FROM photos) WHERE face_id IS NOT NULL"
OWNER = f"SELECT user_id, face_id AS owner_face FROM (SELECT user_id, face_id, count(*) AS n FROM ({SEEN}) GROUP BY user_id, face_id) QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY n DESC, face_id) = 1"
from facetrail.plans.albums import SQL as ALBUM_SQL  # noqa: E402
from facetrail.plans.derivations import RELATIONS, WRITTEN  # noqa: E402

HEDGED = " OR ".join(f"regexp_matches(t, '{_borders(p)}')" for p in L.HEDGES)
KEY = "trim(regexp_replace(lower({0}), '[^a-z0-9_]+', ' ', 'g'))"
SQL = {
    "name_checks": rf"""
WITH s AS (SELECT unnest(person_surfaces) AS s FROM text_units UNION ALL SELECT unnest(surfaces) FROM name_clusters),
n AS (SELECT DISTINCT {ONE.format('s')} AS name FROM s WHERE s IS NOT NULL), x AS (SELECT name, string_split(lower(name), ' ') AS w, regexp_extract_all(lower(name), '[a-z]+') AS k FROM n),
y AS (SELECT *, {PLAUSIBLE} AS plausible FROM x)
SELECT name, plausible, plausible AND NOT (regexp_matches(lower(name), '^(and|with|from|dear) ') OR lower(name) IN ('mom', 'dad', 'friends', 'friend') OR len(k) = 0 OR (list_contains({_list(L.HONORIFICS)}, k[1]) AND len(k) <= 2)
  OR len(list_intersect(k, {_list(L.NO_EDGE_WORDS)})) > 0 OR (len(k) = 2 AND k[1] IN ('hello', 'dear', 'happy'))) AS usable,
  (contains(lower(name), 'billie idol') OR contains(lower(name), 'shakespeare') OR contains(lower(name), 'trump') OR regexp_matches(name, '[_@#$]|\p{{Nd}}') OR coalesce(length({LETTERS.format('name')}) >= 10 AND {SHARE.format('name')} > 0.78, false)) AS noise FROM y""",
    "owner_like_clusters": rf"""
WITH o AS (SELECT user_id, {LOW.format('name')} AS o FROM ({ALBUM_SQL['owner_names_ranked']}) WHERE rank = 1),
c AS (SELECT DISTINCT user_id, cluster_id, primary_surface, {LOW.format('primary_surface')} AS a FROM name_clusters WHERE primary_surface IS NOT NULL),
j AS (SELECT *, string_split(a, ' ') AS aw, string_split(o, ' ') AS ow FROM c JOIN o USING (user_id)),
k AS (SELECT *, CASE WHEN len(aw) >= 2 THEN regexp_replace(aw[-1], '^\.+|\.+$', '', 'g') ELSE '' END AS al, CASE WHEN len(ow) >= 2 THEN regexp_replace(ow[-1], '^\.+|\.+$', '', 'g') ELSE '' END AS ol FROM j)
SELECT cluster_id, primary_surface, a <> '' AND o <> '' AND (a = o OR (aw[1] = ow[1] AND len(aw) < 2) OR (al = ol AND length(aw[1]) <= 2 AND starts_with(ow[1], replace(aw[1], '.', '')))) AS owner_like FROM k""",
    "misread_entities": rf"""
WITH e AS (SELECT user_id, photo_id, caption, list_filter(coalesce(visible_text, []), lambda t: trim(t) <> '') AS v, coalesce(len(visible_face_ids), 0) > 0 AS f, unnest(text_entities) AS e FROM photos),
r AS (SELECT DISTINCT user_id, photo_id, e.surface AS surface, lower(coalesce(e.source, '')) = 'visible_text' AND f AND NOT regexp_matches(lower(coalesce(caption, '')), '{'|'.join(L.TEXT_ARTIFACTS)}') AND (len(v) <= 4
  OR len(list_filter(v, lambda t: trim(t) <> e.surface AND length({LETTERS.format('t')}) >= 5 AND ({SHOUTED.format('t')} OR {SHARE.format('t')} > 0.72))) >= 1) AS misread FROM e WHERE lower(e.entity_type) = 'person' AND e.surface IS NOT NULL)
SELECT user_id, count(*) AS n, count(*) FILTER (misread) AS n_misread FROM r GROUP BY user_id""",
    "claim_checks": rf"""
WITH t AS (SELECT doc_id, text, lower(text) AS t FROM documents WHERE text IS NOT NULL)
SELECT doc_id, {' OR '.join(f"regexp_matches(t, '{_borders(p)}')" for p in L.HEDGES)} AS hedged, regexp_matches(t, '{_borders(chr(92) + 'b(' + '|'.join(L.BROAD_CLOTHING) + ')' + chr(92) + 'b')}') AS clothing, regexp_matches(t, '{'|'.join(L.HOME_PLACES)}') AS home_like,
  regexp_matches(text, '(^|[^\p{{L}}\p{{M}}\p{{N}}_])[A-Z][A-Za-z0-9&.-]+([A-Za-z0-9]($|[^\p{{L}}\p{{M}}\p{{N}}_])|[&.-][\p{{L}}\p{{N}}_])') OR regexp_matches(t, '{_borders(L.DETAIL_HOURS)}') OR regexp_matches(t, '{_borders(chr(92) + 'b(' + '|'.join(L.DETAIL_WORDS) + ')' + chr(92) + 'b')}') AS specific FROM t""",
    "document_terms": f"""
WITH t AS (SELECT doc_id, {LOW.format('text')} AS t FROM documents WHERE text IS NOT NULL),
k AS (SELECT doc_id, 'relation' AS kind, unnest({_terms_sql('t', L.RELATIONS)}) AS term FROM t UNION ALL SELECT doc_id, 'activity', unnest({_terms_sql('t', L.ACTIVITIES)}) FROM t UNION ALL SELECT doc_id, 'venue', unnest({_terms_sql('t', L.VENUES)}) FROM t),
v AS (SELECT * FROM (VALUES {', '.join("('" + t.replace("'", "''") + f"', '{a}', '{b}')" for t, (a, b) in L.RELATIONS.items())}) v(term, relation, category))
SELECT kind, k.term, CASE WHEN kind = 'relation' THEN v.relation ELSE '' END AS relation, CASE WHEN kind = 'relation' THEN v.category ELSE '' END AS category, count(*) AS n_docs, min(doc_id) AS first_doc FROM k LEFT JOIN v USING (term) GROUP BY ALL""",
    "owner_references": f"""
WITH t AS (SELECT doc_id, {LOW.format('text')} AS t FROM documents WHERE text IS NOT NULL)
SELECT * FROM (SELECT doc_id, round(least(6.0::DOUBLE, {' + '.join(f"CASE WHEN contains(t, '{x}') THEN {w} ELSE 0 END::DOUBLE" for x, w in L.OWNER_REFERENCES.items())}), 6) AS score FROM t) WHERE score > 0""",
    "event_features": f"""
WITH p AS (SELECT user_id, photo_id, lower(concat_ws(' ', caption, array_to_string(visible_text, ' '), array_to_string(list_transform(text_entities, lambda e: e.surface), ' '), metadata.gps_location, metadata.gps_city)) AS low FROM photos),
a AS (SELECT *, list_sort(list_distinct(list_concat(list_intersect(regexp_extract_all(low, '[a-z][a-z0-9''_-]*'), {_list([t for t in L.EVENT_TERMS if len(t) >= 4])}), {PHRASE_TERMS}))) AS t FROM p),
b AS (SELECT user_id, photo_id, t, list_sort(list_distinct(list_concat(list_filter({PHRASES}, lambda c: c IS NOT NULL), {CHANNELS}))) AS c FROM a)
SELECT DISTINCT user_id, photo_id, array_to_string(t, ',') AS terms, array_to_string(c, ',') AS channels FROM b""",
    "found_entities": rf"""
WITH e AS (SELECT DISTINCT user_id, photo_id, unnest(regexp_extract_all(regexp_replace(caption, '[\x{{00C0}}-\x{{024F}}\x{{0370}}-\x{{1FFF}}\x{{3040}}-\x{{D7FF}}]', '0', 'g'), '{C.ENTITY}')) AS s FROM photos),
k AS (SELECT *, CASE WHEN regexp_matches(s, '{'|'.join(L.ORGANIZATION_MARKS)}') THEN 'organization' WHEN regexp_matches(s, '{'|'.join(L.EVENT_MARKS)}') THEN 'event' WHEN regexp_matches(s, '{'|'.join(L.LOCATION_MARKS)}') THEN 'location' ELSE 'person' END AS entity_type
  FROM e WHERE NOT list_contains({_list(L.NO_ENTITY_STARTS)}, regexp_split_to_array(s, '\s+')[1]))
SELECT entity_type, s AS surface, count(*) AS n_photos, count(DISTINCT user_id) AS n_albums FROM k GROUP BY ALL""".replace("['’]s", "[''’]s"),
    "names_in_captions": f"""
WITH t AS (SELECT DISTINCT user_id, person_id, {KEY.format('canonical_name')} AS k FROM target_persons WHERE trim(canonical_name) <> ''), p AS (SELECT DISTINCT user_id, photo_id, ' ' || {KEY.format('caption')} || ' ' AS c FROM photos WHERE caption IS NOT NULL),
h AS (SELECT DISTINCT user_id, person_id, photo_id FROM t JOIN p USING (user_id) WHERE k <> '' AND contains(c, ' ' || string_split(k, ' ')[1] || ' '))
SELECT user_id, person_id, count(*) AS n_photos, min(photo_id) AS first_photo FROM h GROUP BY ALL""",
    "built_text_units": f"""
WITH {FIRST_PHOTO}, e0 AS (SELECT user_id, photo_id, {WRITTEN.format('e.surface')} AS n FROM (SELECT user_id, photo_id, unnest(p.text_entities) AS e, coalesce(len(p.visible_face_ids), 0) AS nf FROM p) WHERE lower(e.entity_type) = 'person' AND NOT (nf > 0 AND lower(coalesce(e.source, '')) = 'visible_text')),
e AS (SELECT user_id, photo_id, {WRITTEN.format("CASE WHEN len(string_split(n, ' ')) >= 2 AND list_contains(" + RELATIONS + ", regexp_replace(lower(string_split(n, ' ')[1]), '[.]', '', 'g')) THEN array_to_string(string_split(n, ' ')[2:], ' ') ELSE n END")} AS name FROM e0),
pe AS (SELECT DISTINCT user_id, photo_id FROM (SELECT *, string_split(lower(name), ' ') AS w FROM e) WHERE {PLAUSIBLE}),
b AS (SELECT *, {BLOB} AS b FROM p), t AS (SELECT user_id, photo_id, p, {LOW.format('b')} AS t, {LOW.format("concat_ws(chr(10), b, p.metadata.gps_location, p.metadata.gps_city)")} AS tv FROM b),
u AS (SELECT user_id, photo_id, len(list_filter(coalesce(p.visible_text, []), lambda x: trim(x) <> '')) AS n_texts, array_to_string({_terms_sql('t', L.ACTIVITIES)}, ',') AS activities, array_to_string({_terms_sql('tv', L.VENUES)}, ',') AS venues,
  round(least(6.0::DOUBLE, {' + '.join(f"CASE WHEN contains(t, '{x}') THEN {w} ELSE 0 END::DOUBLE" for x, w in L.OWNER_REFERENCES.items())}), 6) AS owner_reference_score, coalesce(len(p.visible_face_ids), 0) > 0 AS has_face, coalesce(p.caption, '') AS c FROM t)
SELECT user_id, photo_id, n_texts, activities, venues, owner_reference_score, has_face FROM u WHERE (n_texts > 0 OR c <> '' OR EXISTS (SELECT 1 FROM pe WHERE pe.user_id = u.user_id AND pe.photo_id = u.photo_id)) AND (n_texts > 0 OR activities <> '' OR venues <> '')""",
    "built_face_units": f"""
WITH {FIRST_PHOTO}, o AS ({OWNER}), b AS (SELECT user_id, photo_id, list_distinct(list_filter(p.visible_face_ids, lambda f: f IS NOT NULL)) AS faces, {LOW.format(BLOB)} AS t FROM p),
f AS (SELECT b.user_id, photo_id, faces, coalesce(list_contains(faces, owner_face), false) AS own, len({_terms_sql('t', L.ACTIVITIES)}) AS na FROM b LEFT JOIN o USING (user_id) WHERE len(faces) > 0), u AS (SELECT *, unnest(faces) AS face_id FROM f)
SELECT user_id, face_id, count(*) AS n_units, sum(len(faces) - 1)::BIGINT AS n_co_faces, count(*) FILTER (own) AS n_with_owner, sum(na)::BIGINT AS n_activities FROM u GROUP BY user_id, face_id""",
    "album_inventory": f"""
WITH {FIRST_PHOTO}, c AS (SELECT user_id, count(*) AS n_photos, min(nullif(p.year_month, '')) AS first_month, max(nullif(p.year_month, '')) AS last_month FROM p GROUP BY user_id), o AS ({OWNER}),
f AS (SELECT user_id, count(DISTINCT face_id) AS n_faces, count(DISTINCT photo_id) AS n_face_photos, count(*) AS n_face_units FROM ({SEEN}) GROUP BY user_id)
SELECT user_id, n_photos, first_month, last_month, coalesce(n_faces, 0) AS n_faces, coalesce(n_face_photos, 0) AS n_face_photos, coalesce(n_face_units, 0) AS n_face_units, owner_face FROM c LEFT JOIN f USING (user_id) LEFT JOIN o USING (user_id)""",
    "photo_briefs": f"""
WITH {FIRST_PHOTO}, q AS (SELECT user_id, photo_id, p, {ONE.format("coalesce(p.caption, '')")} AS c, list_transform(list_filter(coalesce(p.visible_text, []), lambda t: trim(t) <> '')[1:3], lambda t: {ONE.format('t')}) AS v FROM p)
SELECT user_id, photo_id, md5(CASE WHEN length(c) <= 60 THEN c ELSE rtrim(substring(c, 1, 57), ' ') || '...' END) AS caption_md5, md5(array_to_string(list_transform(v, lambda t: CASE WHEN length(t) <= 60 THEN t ELSE rtrim(substring(t, 1, 57), ' ') || '...' END), '|')) AS texts_md5,
  len(coalesce(p.text_entities, [])[1:4]) AS n_entities, array_to_string(coalesce(p.visible_face_ids, [])[1:2], ',') AS faces, coalesce(p.metadata.gps_city, '') AS gps_city FROM q""",
    "face_contexts": f"""
WITH {FIRST_PHOTO}, s AS ({SEEN}), r AS (SELECT s.user_id, face_id, s.photo_id, row_number() OVER (PARTITION BY s.user_id, face_id ORDER BY coalesce(p.p.timestamp, ''), s.photo_id) AS k FROM s JOIN p USING (user_id, photo_id))
SELECT user_id, face_id, count(*) AS n_photos, count(*) FILTER (k <= 6) AS n_context, string_agg(photo_id, ',' ORDER BY k) FILTER (k <= 6) AS photos FROM r GROUP BY user_id, face_id""",
}
