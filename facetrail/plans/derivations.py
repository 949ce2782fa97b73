"""Queries over derived names, places, phrases, entities, difficulties, slots and dates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from facetrail.functions.text import query_terms
from facetrail.functions.timestamps import instant_micros
from facetrail.operators import albums as A
from facetrail.operators import derive as D
from facetrail.session import table


def written_names(spark: SparkSession, d: str) -> DataFrame:
    n = table(spark, d, "name_clusters").select("cluster_id", "primary_surface").where("primary_surface is not null").distinct()
    name, relation = D.without_relation(F.col("primary_surface"))
    return n.select("cluster_id", D.written_name(F.col("primary_surface")).alias("written"), name.alias("bare"), relation.alias("relation"))


def place_city(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "photos").select("user_id", "photo_id", F.concat_ws(", ", "metadata.gps_location", "metadata.gps_city").alias("place")).distinct()
    city, text = D.place_parts(F.col("place"), F.lit("home"))
    return p.select("user_id", "photo_id", city.alias("city"), text.alias("place"))


def caption_phrases(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "photos").where("caption is not null").select("user_id", "photo_id", "caption").distinct()
    return p.select("user_id", "photo_id", F.concat_ws("|", D.phrases(F.col("caption"))).alias("phrases")).where("phrases <> ''").distinct()


def fact_signatures(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").where("text is not null").groupBy(D.signature(F.col("text")).alias("signature")).agg(F.count("*").alias("n"), F.min("doc_id").alias("first_doc"))


def entity_cleaning(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "photos").select("user_id", "photo_id", F.explode(D.clean_entities(F.col("text_entities"))).alias("e")).distinct()
    return e.groupBy("user_id", "e.entity_type", "e.source").agg(F.count("*").alias("n"), F.count_distinct("e.surface").alias("n_surfaces"))


def planned_faces(spark: SparkSession, d: str) -> DataFrame:
    u = table(spark, d, "face_units").groupBy("user_id", "face_id", "photo_id").agg(F.array_sort(F.array_distinct(F.array_compact(F.flatten(F.collect_list(F.coalesce("co_faces", F.array().cast("array<string>"))))))).alias("co"), F.max(F.coalesce("owner_present", F.lit(False))).alias("o"))
    framing = F.when(F.size("co") >= 3, "group").when(F.size("co") == 1, "pair").otherwise("solo")
    visibility = F.when(F.col("photo_id").endswith("0"), "none").when(F.col("photo_id").endswith("1"), "weak").otherwise("medium")
    faces = D.visible_faces(F.array("face_id"), F.col("co"), visibility, framing)
    return u.select("user_id", "face_id", "photo_id", F.concat_ws(",", faces).alias("faces"), D.faces_in_words(faces).alias("words"))


def device_upgrades(spark: SparkSession, d: str) -> DataFrame:
    """The device in force in each month, from the months in which an album first shows a device."""
    p = table(spark, d, "photos").where("year_month <> '' and metadata.device <> 'unknown'").groupBy("user_id", "metadata.device").agg(F.min("year_month").alias("from_month"))
    from pyspark.sql import Window as W

    plan = p.withColumn("ord", F.row_number().over(W.partitionBy("user_id").orderBy("from_month", "device")))
    months = table(spark, d, "photos").where("year_month <> ''").select("user_id", "year_month").distinct()
    return D.device_at(months, plan)


def alignment_difficulty(spark: SparkSession, d: str) -> DataFrame:
    m = table(spark, d, "name_clusters").select("user_id", "cluster_id", F.explode("mention_photo_ids").alias("photo_id")).distinct()
    owner = A.owner_faces(table(spark, d, "photos")).withColumnRenamed("owner_face", "face_id")
    out = D.mention_difficulty(m.join(owner, "user_id"), table(spark, d, "photos"), table(spark, d, "event_nodes"))
    return out.groupBy("user_id", "difficulty").agg(F.count("*").alias("n"))


def row_generator_slots(spark: SparkSession, d: str) -> DataFrame:
    n = table(spark, d, "event_nodes").groupBy("event_id").agg(F.max(F.coalesce(F.size("photo_ids"), F.lit(0))).alias("wanted"), F.max(F.coalesce(F.size("text_photo_ids"), F.lit(0))).alias("have"))
    return D.slots(n, "wanted", "have").select("event_id", "slot")


def best_text_hit(spark: SparkSession, d: str) -> DataFrame:
    texts = F.array_compact(F.concat(F.array("caption"), F.coalesce("visible_text", F.array().cast("array<string>"))))
    p = table(spark, d, "photos").select("user_id", "photo_id", D.best_text(texts, query_terms(F.lit("birthday dinner with cake and balloons"))).alias("hit"))
    return p.where("hit is not null").distinct()


def unit_day_gaps(spark: SparkSession, d: str) -> DataFrame:
    """Days between the first and last dated unit of each month of an album."""
    u = table(spark, d, "text_units").select("user_id", "year_month", instant_micros("timestamp").alias("us")).where("year_month <> ''")
    return u.groupBy("user_id", "year_month").agg(F.min("us").alias("a"), F.max("us").alias("b")).select("user_id", "year_month", D.days_apart(F.col("b"), F.col("a")).alias("days"), D.month_number(F.col("year_month")).alias("month_no"))


def relation_synonyms(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "relation_entries").where("entry_kind = 'relation'")
    words = e.select(F.explode(F.array_append("other_labels", F.col("entry_label"))).alias("phrase"), F.col("entry_label").alias("canonical"))
    p = table(spark, d, "target_persons").where("trim(relation) <> ''").select("row_id", "relation").distinct()
    return D.canonical_terms(p, "relation", words).select("row_id", "canonical")


FUNCTIONS = (written_names, place_city, caption_phrases, fact_signatures, entity_cleaning, planned_faces, device_upgrades, alignment_difficulty, row_generator_slots, best_text_hit, unit_day_gaps, relation_synonyms)
QUERIES = {f.__name__: f for f in FUNCTIONS}

SEEN, OWNER, FOLD = ("SELECT DISTINCT user_id, photo_id, face_id FROM (SELECT user_id, photo_id, unnest(visible_face_ids) AS face_id FROM photos) WHERE face_id IS NOT NULL", None, "trim(regexp_replace(lower(strip_accents({0})), '[^a-z0-9]+', ' ', 'g'))")
OWNER = f"SELECT user_id, face_id FROM (SELECT user_id, face_id, count(*) AS n FROM ({SEEN}) GROUP BY user_id, face_id) QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY n DESC, face_id) = 1"
ONE = r"trim(regexp_replace({0}, '\s+', ' ', 'g'), ' ')"
#: A name written out, as operators.derive.written_name gives it.
WRITTEN = (
    r"array_to_string(list_transform(string_split(regexp_replace(regexp_replace(regexp_replace(" + ONE.replace("{{", "{").replace("}}", "}") + r", '^[#@\-\s:]+', ''), '\s+\([^)]+\)$', ''), '^[ ,.;:!?]+|[ ,.;:!?]+$', '', 'g'), ' '), "
    r"lambda x: CASE WHEN lower(x) IN ('de','del','dela','van','von','da','di') THEN lower(x) WHEN regexp_matches(x, '^[A-Za-z]\.$') THEN upper(x) "
    r"ELSE array_to_string(list_transform(string_split(regexp_replace(x, '([-''])', '\1' || chr(1), 'g'), chr(1)), lambda y: CASE WHEN regexp_matches(y, '^[\p{{L}}.,()]*[-'']?$') THEN upper(substring(y, 1, 1)) || lower(substring(y, 2)) ELSE y END), '') END), ' ')"
)
RELATIONS = "[" + ", ".join(f"'{r}'" for r in D.RELATION_WORDS) + "]"
STOP = "['the','and','for','with','from','this','that']"
TERMS = "list_filter(list_distinct(list_transform(regexp_extract_all({0}, '[A-Za-z][A-Za-z0-9_-]{{2,}}'), lambda z: lower(z))), lambda z: NOT list_contains(" + STOP + ", z))"
MONTH = "coalesce(try_cast({0}[1:4] AS INT) * 12 + try_cast({0}[6:7] AS INT), 0)"
HAS = "regexp_matches(' ' || w || ' ', '{0}')"
SQL = {
    "written_names": rf"""
WITH n AS (SELECT DISTINCT cluster_id, primary_surface AS p FROM name_clusters WHERE primary_surface IS NOT NULL), w AS (SELECT cluster_id, string_split({ONE.format('p')}, ' ') AS ow, {WRITTEN.format('p')} AS written FROM n),
r AS (SELECT *, regexp_replace(lower(ow[1]), '^\.+|\.+$', '', 'g') AS f FROM w)
SELECT cluster_id, written, CASE WHEN len(ow) >= 2 AND list_contains({RELATIONS}, f) THEN array_to_string(ow[2:], ' ') ELSE array_to_string(ow, ' ') END AS bare, CASE WHEN len(ow) >= 2 AND list_contains({RELATIONS}, f) THEN f END AS relation FROM r""",
    "place_city": f"""
WITH p AS (SELECT DISTINCT user_id, photo_id, concat_ws(', ', metadata.gps_location, metadata.gps_city) AS place FROM photos), t AS (SELECT user_id, photo_id, {ONE.format('place')} AS t FROM p),
q AS (SELECT *, list_filter(list_transform(string_split(t, ','), lambda x: trim(x)), lambda x: x <> '') AS parts FROM t)
SELECT user_id, photo_id, CASE WHEN coalesce(t, '') = '' THEN 'home' WHEN len(parts) >= 2 THEN parts[-1] ELSE 'home' END AS city, CASE WHEN coalesce(t, '') = '' THEN 'home' ELSE t END AS place FROM q""",
    "caption_phrases": rf"""
WITH p AS (SELECT DISTINCT user_id, photo_id, list_transform(regexp_extract_all(caption, '[A-Za-z0-9][A-Za-z0-9''&.-]*(?:[ \t\n]+[A-Za-z0-9][A-Za-z0-9''&.-]*){{1,4}}'), lambda x: lower(x)) AS r FROM photos WHERE caption IS NOT NULL),
f AS (SELECT user_id, photo_id, list_filter(r, lambda x: len({TERMS.format('x')}) >= 2) AS r FROM p), d AS (SELECT user_id, photo_id, list_filter(r, lambda x, i: list_position(r, x) = i)[1:8] AS r FROM f)
SELECT DISTINCT user_id, photo_id, array_to_string(r, '|') AS phrases FROM d WHERE len(r) > 0""",
    "fact_signatures": f"""
WITH t AS (SELECT doc_id, trim(regexp_replace(lower({ONE.format('text')}), '[^a-z0-9]+', ' ', 'g')) AS w FROM documents WHERE text IS NOT NULL),
s AS (SELECT doc_id, CASE WHEN w = '' THEN '' WHEN {HAS.format(' name ')} THEN 'owner_name' WHEN {HAS.format(' [0-9]{2} years old ')} THEN 'owner_age' WHEN {HAS.format(' (birth year|date of birth|born) ')} THEN 'owner_birth' WHEN {HAS.format(' (based in|lives in|living in) ')} THEN 'owner_base' ELSE w END AS signature FROM t)
SELECT signature, count(*) AS n, min(doc_id) AS first_doc FROM s GROUP BY signature""",
    "entity_cleaning": """
WITH e AS (SELECT user_id, photo_id, unnest(text_entities) AS e FROM photos),
c AS (SELECT DISTINCT user_id, photo_id, trim(e.surface) AS surface, CASE WHEN trim(e.entity_type) IN ('person', 'organization', 'location', 'event') THEN trim(e.entity_type) ELSE 'person' END AS entity_type, trim(e.source) AS source FROM e)
SELECT user_id, entity_type, source, count(*) AS n, count(DISTINCT surface) AS n_surfaces FROM c WHERE surface <> '' AND source IN ('caption', 'visible_text') GROUP BY ALL""",
    "planned_faces": """
WITH u AS (SELECT user_id, face_id, photo_id, list_sort(list_distinct(flatten(list(coalesce(co_faces, []))))) AS c0 FROM face_units GROUP BY user_id, face_id, photo_id), v AS (SELECT *, list_filter(c0, lambda x: x IS NOT NULL) AS co FROM u),
f AS (SELECT *, CASE WHEN photo_id LIKE '%0' THEN [] WHEN photo_id LIKE '%1' THEN [face_id] WHEN len(co) >= 3 THEN list_concat([face_id], list_filter(co[1:2], lambda x: x <> face_id)) WHEN len(co) = 1 THEN list_concat([face_id], list_filter(co[1:1], lambda x: x <> face_id)) ELSE [face_id] END AS f FROM v)
SELECT user_id, face_id, photo_id, array_to_string(f, ',') AS faces, CASE len(f) WHEN 0 THEN 'no clearly identifiable face is visible' WHEN 1 THEN 'one clearly identifiable recurring person is visible' ELSE len(f) || ' clearly identifiable people are visible' END AS words FROM f""",
    "device_upgrades": f"""
WITH p AS (SELECT user_id, metadata.device AS device, min(year_month) AS m FROM photos WHERE year_month <> '' AND metadata.device <> 'unknown' GROUP BY ALL), q AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY m, device) AS o FROM p),
x AS (SELECT DISTINCT user_id, year_month FROM photos WHERE year_month <> '')
SELECT x.user_id, x.year_month, arg_max(device, o) AS device FROM x LEFT JOIN q ON q.user_id = x.user_id AND {MONTH.format('q.m')} <= {MONTH.format('x.year_month')} GROUP BY x.user_id, x.year_month""",
    "alignment_difficulty": f"""
WITH m AS (SELECT DISTINCT user_id, cluster_id, unnest(mention_photo_ids) AS photo_id FROM name_clusters), o AS ({OWNER}), s AS ({SEEN}), ev AS (SELECT DISTINCT user_id, event_id, unnest(photo_ids) AS photo_id FROM event_nodes),
n AS (SELECT DISTINCT e2.user_id, e2.photo_id, s.face_id FROM ev e1 JOIN s ON s.user_id = e1.user_id AND s.photo_id = e1.photo_id JOIN ev e2 ON e2.user_id = e1.user_id AND e2.event_id = e1.event_id),
d AS (SELECT m.user_id, CASE WHEN EXISTS (SELECT 1 FROM s WHERE s.user_id = m.user_id AND s.photo_id = m.photo_id AND s.face_id = o.face_id) THEN 'easy' WHEN EXISTS (SELECT 1 FROM n WHERE n.user_id = m.user_id AND n.photo_id = m.photo_id AND n.face_id = o.face_id) THEN 'medium' ELSE 'hard' END AS difficulty FROM m JOIN o USING (user_id))
SELECT user_id, difficulty, count(*) AS n FROM d GROUP BY ALL""",
    "row_generator_slots": """
WITH n AS (SELECT event_id, max(coalesce(len(photo_ids), 0)) - max(coalesce(len(text_photo_ids), 0)) AS n FROM event_nodes GROUP BY event_id)
SELECT event_id, unnest(range(1, n + 1))::INT AS slot FROM n WHERE n > 0""",
    "best_text_hit": f"""
WITH p AS (SELECT user_id, photo_id, list_filter(list_concat([caption], coalesce(visible_text, [])), lambda x: x IS NOT NULL) AS t FROM photos), q AS (SELECT {TERMS.format("'birthday dinner with cake and balloons'")} AS q),
x AS (SELECT row_number() OVER () AS r, * FROM p), u AS (SELECT r, user_id, photo_id, unnest(t) AS t, generate_subscripts(t, 1) AS i FROM x),
k AS (SELECT r, user_id, photo_id, t, i, len(list_intersect({TERMS.format('t')}, q)) AS n FROM u, q)
SELECT DISTINCT user_id, photo_id, t AS hit FROM (SELECT *, row_number() OVER (PARTITION BY r ORDER BY n DESC, i) AS z FROM k WHERE n > 0) WHERE z = 1""",
    "relation_synonyms": f"""
WITH s AS (SELECT DISTINCT {FOLD.format('phrase')} AS phrase, canonical FROM (SELECT unnest(list_append(other_labels, entry_label)) AS phrase, entry_label AS canonical FROM relation_entries WHERE entry_kind = 'relation')),
p AS (SELECT DISTINCT row_id, {FOLD.format('relation')} AS f FROM target_persons WHERE trim(relation) <> ''),
h AS (SELECT row_id, f, arg_min(canonical, (-length(phrase), phrase)) AS c FROM p JOIN s ON contains(' ' || f || ' ', ' ' || phrase || ' ') GROUP BY row_id, f)
SELECT p.row_id, coalesce(h.c, p.f) AS canonical FROM p LEFT JOIN h USING (row_id, f)""",
}
from facetrail.plans.sessions import SESSIONS_SQL  # noqa: E402

SQL["unit_day_gaps"] = SESSIONS_SQL.split("ranked AS")[0].replace("SELECT user_id, unit_id, photo_id, regexp_extract", "SELECT user_id, year_month, unit_id, photo_id, regexp_extract").replace("SELECT user_id, unit_id, photo_id, replace", "SELECT user_id, year_month, unit_id, photo_id, replace").replace("SELECT user_id, unit_id, photo_id,\n    epoch_us", "SELECT user_id, year_month, unit_id, photo_id,\n    epoch_us") + f"""
m AS (SELECT user_id, year_month, min(us) AS a, max(us) AS b FROM dated WHERE year_month <> '' GROUP BY user_id, year_month),
k AS (SELECT DISTINCT user_id, year_month FROM text_units WHERE year_month <> '')
SELECT k.user_id, k.year_month, coalesce(abs(floor((b - a) / 86400000000.0)), 99999)::BIGINT AS days, {MONTH.format('k.year_month')} AS month_no FROM k LEFT JOIN m USING (user_id, year_month)"""
