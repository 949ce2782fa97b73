"""Text functions and retrieval over documents and photos."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from facetrail.functions import text as X
from facetrail.operators.search import first_k, keyword_scores, quota_first
from facetrail.session import table

QUERY = "birthday dinner with the owner beside a trophy"
QUERIES_3 = ["rehearsal at the chapel", "two strangers copy the pose", "badge and ticket for the festival"]


def keyword_search_topk(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", "text").where("text is not null")
    hits = keyword_scores(docs, X.query_terms(F.col("text")), [QUERY], "text")
    return hits.select("doc_id", F.round("score", 9).alias("score")).orderBy(F.col("score").desc(), "doc_id").limit(50)


def multi_query_retrieve(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", "text").where("text is not null")
    hits = keyword_scores(docs, X.query_terms(F.col("text")), QUERIES_3, "text").select("doc_id", "query_no", F.round("score", 9).alias("score"))
    top = first_k(hits, ["query_no"], [F.col("score").desc(), F.col("doc_id")], 20)
    return first_k(top, ["doc_id"], [F.col("query_no"), F.col("rank")], 1, "k").select("doc_id", "query_no", "rank")


def _photo_terms(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "photos")
    parts = F.concat(F.array("caption"), F.coalesce("visible_text", F.array().cast("array<string>")), F.coalesce(F.transform("text_entities", lambda e: e["surface"]), F.array().cast("array<string>")), F.coalesce("visible_face_ids", F.array().cast("array<string>")), F.array("metadata.gps_city", "metadata.gps_location"))
    one = p.select("user_id", "photo_id", "timestamp", X.query_terms(F.concat_ws(" ", parts)).alias("terms"))
    return one.groupBy("user_id", "photo_id").agg(F.min("timestamp").alias("ts"), F.array_distinct(F.flatten(F.collect_list("terms"))).alias("terms"))


def photo_search_topk(spark: SparkSession, d: str) -> DataFrame:
    hits = keyword_scores(_photo_terms(spark, d), F.col("terms"), ["birthday cake dinner with balloons"]).withColumn("score", F.round("score", 9))
    order = [F.col("score").desc(), F.coalesce("ts", F.lit("")), F.col("photo_id")]
    return first_k(hits, ["user_id"], order, 5).select("user_id", "photo_id", "rank", "score")


def _photo_features(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "photos")
    shown = F.size(F.filter(F.coalesce("visible_text", F.array().cast("array<string>")), lambda x: F.trim(x) != ""))
    faces = F.size(F.array_distinct(F.array_compact(F.coalesce("visible_face_ids", F.array().cast("array<string>")))))
    rows = p.select("user_id", "photo_id", "timestamp", F.length(F.coalesce("caption", F.lit(""))).alias("c"), shown.alias("v"), F.size(F.coalesce("text_entities", F.array())).alias("e"), faces.alias("f"))
    return rows.groupBy("user_id", "photo_id").agg(F.coalesce(F.min("timestamp"), F.lit("")).alias("ts"), *[F.max(x).alias(x) for x in "cvef"])


def text_rich_photos(spark: SparkSession, d: str) -> DataFrame:
    score = F.round(0.02 * F.col("c") + 1.5 * F.col("v") + F.col("e") + F.when(F.col("f") > 0, 0.6).otherwise(0.0), 6)
    rows = _photo_features(spark, d).withColumn("score", score).where("score > 0")
    return first_k(rows, ["user_id"], [F.col("score").desc(), F.col("ts"), F.col("photo_id")], 5).select("user_id", "photo_id", "rank", "score")


def dense_photos_in_time(spark: SparkSession, d: str) -> DataFrame:
    score = F.round(0.01 * F.col("c") + 1.25 * F.col("v") + 0.7 * F.col("f"), 6)
    top = first_k(_photo_features(spark, d).withColumn("score", score), ["user_id"], [F.col("score").desc(), F.col("ts"), F.col("photo_id")], 10)
    return first_k(top, ["user_id"], [F.col("ts"), F.col("photo_id")], 10, "place").select("user_id", "place", "photo_id")


def private_text_filter(spark: SparkSession, d: str) -> DataFrame:
    kinds = X.contact_kinds(F.col("text"))
    rows = table(spark, d, "documents").where("text is not null").select("doc_id", *[c.alias(k) for k, c in kinds.items()])
    return rows.where("email or phone or street")


def truncations(spark: SparkSession, d: str) -> DataFrame:
    t = F.col("text")
    return table(spark, d, "documents").where("text is not null").select("doc_id", F.md5(X.first_words(t, 12)).alias("words"), F.md5(X.shorten(t, 80)).alias("short"), F.md5(X.one_space(t)).alias("spaced"))


def clean_fields(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "predicted_persons")
    return p.select(
        "row_id", X.strip_signs(F.col("canonical_name")).alias("name"), X.clean_relation(F.col("relation_to_owner")).alias("relation"), X.clean_category(F.col("relation_category")).alias("category"),
        X.clean_sentence(F.col("reasoning_path")).alias("reason"), X.bounded(F.col("confidence"), 0.5).alias("confidence"),
    ).distinct()


def folded_names(spark: SparkSession, d: str) -> DataFrame:
    n = F.col("canonical_name")
    return table(spark, d, "target_persons").where("canonical_name is not null").select("person_id", X.fold(n).alias("folded"), X.first_token(n).alias("first"), X.is_full_name(n).alias("is_full")).distinct()


def frequent_terms(spark: SparkSession, d: str) -> DataFrame:
    words = table(spark, d, "documents").select("doc_id", F.explode(X.query_terms(F.col("text"))).alias("term")).groupBy("term").agg(F.count_distinct("doc_id").alias("n_docs"))
    return words.orderBy(F.col("n_docs").desc(), "term").limit(40)


def relation_words(spark: SparkSession, d: str) -> DataFrame:
    """Units whose captions name a relation, by its label: labels and other labels of any number of words, an equality join on
    their first words. What lies inside a longer one (the mother of mother-in-law) isn't counted."""
    e = table(spark, d, "relation_entries").where("entry_kind = 'relation'")
    names = F.concat(F.array("entry_label"), F.coalesce("other_labels", F.array().cast("array<string>")))
    e = e.select(F.col("entry_label").alias("word"), F.explode(names).alias("name")).select("word", F.split(X.fold(F.col("name")), " ").alias("w"))
    entries = e.select("word", "w", F.element_at("w", 1).alias("first"), F.size("w").alias("n")).where("first <> ''").distinct()
    units = table(spark, d, "text_units").select("user_id", "unit_id", F.split(X.fold(F.col("caption")), " ").alias("words")).distinct()
    hits = units.select("*", F.posexplode("words").alias("i", "first")).join(entries, "first").where(F.slice("words", F.col("i") + 1, F.col("n")) == F.col("w"))
    of = hits.groupBy("user_id", "unit_id", "words").agg(F.collect_list(F.struct("i", "n", "word")).alias("hits"))
    inside = lambda h, o: (o["n"] > h["n"]) & (o["i"] <= h["i"]) & (h["i"] + h["n"] <= o["i"] + o["n"])
    kept = F.filter("hits", lambda h: ~F.exists("hits", lambda o: inside(h, o)))
    return of.select("user_id", "unit_id", F.explode(kept).alias("h")).select("user_id", "unit_id", "h.word").distinct().groupBy("user_id", "word").agg(F.count("*").alias("n_units"))


def json_salvage(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "documents").where("text like '%{%'").select("doc_id", X.json_field(F.col("text"), "verdict").alias("verdict"), X.json_field(F.col("text"), "score").try_cast("double").alias("score"))
    return rows.where("verdict is not null")


def cited_photos(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "documents").select("doc_id", X.photo_ids_in(F.col("text")).alias("ids")).where("size(ids) > 0")
    return rows.select("doc_id", F.size("ids").alias("n_photos"), F.md5(F.concat_ws(",", "ids")).alias("ids_md5"))


def props_by_type(spark: SparkSession, d: str) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("long")
    return table(spark, d, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.sum(k).alias("sum_k"), F.max(k).alias("max_k"))


def source_quota_docs(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").where("n_chars is not null").select("doc_id", F.coalesce("source", F.lit("?")).alias("source"), "n_chars")
    return quota_first(docs, "source", [F.col("n_chars").desc(), F.col("doc_id")], 2, 60).select("doc_id", "source", "n_chars")


FUNCTIONS = (keyword_search_topk, multi_query_retrieve, photo_search_topk, text_rich_photos, dense_photos_in_time, private_text_filter, truncations, clean_fields, folded_names, frequent_terms, relation_words, json_salvage, cited_photos, props_by_type, source_quota_docs)
QUERIES = {f.__name__: f for f in FUNCTIONS}

STOP = "['the','and','for','with','from','this','that']"
TERMS = "list_filter(list_distinct(list_transform(regexp_extract_all({0}, '[A-Za-z][A-Za-z0-9_-]{{2,}}'), lambda x: lower(x))), lambda x: NOT list_contains(" + STOP.replace("{", "{{") + ", x))"
FOLDED = "trim(regexp_replace(lower(strip_accents({0})), '[^a-z0-9]+', ' ', 'g'))"
ONE_SPACE = r"trim(regexp_replace({0}, '\s+', ' ', 'g'), ' ')"


def _terms(c: str) -> str:
    return TERMS.format(c)


def _space(c: str) -> str:
    return ONE_SPACE.format(c)


def _strip(c: str) -> str:
    return f"regexp_replace({_space(c)}, '^[ ,.;:\\-]+|[ ,.;:\\-]+$', '', 'g')[1:80]"


PHOTO = """
SELECT user_id, photo_id, coalesce(min(timestamp), '') AS ts, max(length(coalesce(caption, ''))) AS c,
  max(len(list_filter(coalesce(visible_text, []), lambda x: trim(x) <> ''))) AS v, max(len(coalesce(text_entities, []))) AS e,
  max(len(list_distinct(list_filter(coalesce(visible_face_ids, []), lambda x: x IS NOT NULL)))) AS f FROM photos GROUP BY user_id, photo_id
"""
SQL = {
    "keyword_search_topk": f"""
WITH t AS (SELECT doc_id, {_terms('text')} AS terms FROM documents WHERE text IS NOT NULL), q AS (SELECT {_terms("'" + QUERY + "'")} AS q),
s AS (SELECT doc_id, len(list_intersect(terms, q)) AS n, len(terms) AS m FROM t, q)
SELECT doc_id, round(n / sqrt(greatest(m, 1)), 9) AS score FROM s WHERE n > 0 ORDER BY score DESC, doc_id LIMIT 50""",
    "multi_query_retrieve": f"""
WITH t AS (SELECT doc_id, {_terms('text')} AS terms FROM documents WHERE text IS NOT NULL),
q AS (SELECT query_no, {_terms('q')} AS q FROM (VALUES {', '.join(f"({i}, '{x}')" for i, x in enumerate(QUERIES_3))}) v(query_no, q)),
s AS (SELECT doc_id, query_no, len(list_intersect(terms, q)) AS n, len(terms) AS m FROM t, q),
r AS (SELECT doc_id, query_no, row_number() OVER (PARTITION BY query_no ORDER BY round(n / sqrt(greatest(m, 1)), 9) DESC, doc_id) AS rank FROM s WHERE n > 0)
SELECT doc_id, query_no, rank FROM r WHERE rank <= 20 QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY query_no, rank) = 1""",
    "photo_search_topk": f"""
WITH one AS (SELECT user_id, photo_id, timestamp, {_terms("concat_ws(' ', caption, array_to_string(visible_text, ' '), array_to_string(list_transform(text_entities, lambda e: e.surface), ' '), array_to_string(visible_face_ids, ' '), metadata.gps_city, metadata.gps_location)")} AS terms FROM photos),
p AS (SELECT user_id, photo_id, min(timestamp) AS ts, list_distinct(flatten(list(terms))) AS terms FROM one GROUP BY user_id, photo_id),
s AS (SELECT *, len(list_intersect(terms, {_terms("'birthday cake dinner with balloons'")})) AS n FROM p),
r AS (SELECT user_id, photo_id, round(n / sqrt(greatest(len(terms), 1)), 9) AS score, ts FROM s WHERE n > 0)
SELECT user_id, photo_id, row_number() OVER (PARTITION BY user_id ORDER BY score DESC, coalesce(ts, ''), photo_id) AS rank, score FROM r QUALIFY rank <= 5""",
    "text_rich_photos": f"""
WITH p AS ({PHOTO}), s AS (SELECT *, round(0.02::DOUBLE * c + 1.5::DOUBLE * v + e + CASE WHEN f > 0 THEN 0.6 ELSE 0 END::DOUBLE, 6) AS score FROM p)
SELECT user_id, photo_id, row_number() OVER (PARTITION BY user_id ORDER BY score DESC, ts, photo_id) AS rank, score FROM s WHERE score > 0 QUALIFY rank <= 5""",
    "dense_photos_in_time": f"""
WITH p AS ({PHOTO}), s AS (SELECT *, round(0.01::DOUBLE * c + 1.25::DOUBLE * v + 0.7::DOUBLE * f, 6) AS score FROM p),
t AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY score DESC, ts, photo_id) <= 10)
SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, photo_id) AS place, photo_id FROM t""",
    "private_text_filter": r"""
WITH t AS (SELECT doc_id, lower(text) AS t FROM documents WHERE text IS NOT NULL),
k AS (SELECT doc_id, regexp_matches(t, '[a-z0-9_.+-]+@[a-z0-9_.-]+\.[a-z]{2,}') AS email,
  regexp_matches(t, '(^|[^a-z0-9_])[0-9]{3}[-. \t\n][0-9]{3}[-. \t\n][0-9]{4}($|[^a-z0-9_])') AS phone,
  regexp_matches(t, '(^|[^a-z0-9_])[0-9]{1,5}[ \t\n]+[a-z0-9 .''-]+[ \t\n]+(street|st|road|rd|avenue|ave|drive|dr|lane|ln|apartment|apt)($|[^a-z0-9_])') AS street FROM t)
SELECT * FROM k WHERE email OR phone OR street""",
    "truncations": f"""
WITH t AS (SELECT doc_id, text, {_space('text')} AS s FROM documents WHERE text IS NOT NULL), w AS (SELECT *, string_split(s, ' ') AS w FROM t)
SELECT doc_id, md5(CASE WHEN len(w) > 12 THEN regexp_replace(array_to_string(w[1:12], ' '), '[ ,;:]+$', '') || '.' ELSE text END) AS words,
  md5(CASE WHEN length(s) <= 80 THEN s ELSE rtrim(substring(s, 1, 77), ' ') || '...' END) AS short, md5(s) AS spaced FROM w""",
    "clean_fields": f"""
WITH t AS (SELECT row_id, {_strip('canonical_name')} AS name, {_strip('lower(relation_to_owner)')} AS relation, {_strip('lower(relation_category)')} AS c,
  regexp_replace({_space('reasoning_path')}, '^[ \\-]+|[ \\-]+$', '', 'g') AS r, CASE WHEN confidence IS NULL OR isnan(confidence) THEN 0.5 ELSE confidence END AS x FROM predicted_persons)
SELECT DISTINCT row_id, name, relation, CASE c WHEN 'coworker' THEN 'colleague' WHEN 'co-worker' THEN 'colleague' WHEN 'work colleague' THEN 'colleague' WHEN 'relative' THEN 'family' WHEN 'partner' THEN 'family' WHEN 'spouse' THEN 'family' ELSE c END AS category,
  substring(CASE WHEN r = '' OR regexp_matches(r, '[.!?]$') THEN r ELSE r || '.' END, 1, 260) AS reason, round(least(greatest(x, 0), 1), 3) AS confidence FROM t""",
    "folded_names": f"""
WITH t AS (SELECT person_id, canonical_name AS n, trim(regexp_replace(lower(strip_accents(canonical_name)), '[^a-z0-9]+', ' ', 'g')) AS folded FROM target_persons WHERE canonical_name IS NOT NULL)
SELECT DISTINCT person_id, folded, string_split(folded, ' ')[1] AS first, len(string_split({_space('n')}, ' ')) >= 2 AS is_full FROM t""",
    "frequent_terms": f"""
WITH t AS (SELECT doc_id, unnest({_terms('text')}) AS term FROM documents)
SELECT term, count(DISTINCT doc_id) AS n_docs FROM t GROUP BY term ORDER BY n_docs DESC, term LIMIT 40""",
    "relation_words": f"""
WITH e AS (SELECT DISTINCT entry_label AS word, string_split({FOLDED.format('n')}, ' ') AS w FROM (SELECT entry_label, unnest(list_concat([entry_label], coalesce(other_labels, []))) AS n FROM relation_entries WHERE entry_kind = 'relation') WHERE {FOLDED.format('n')} <> ''),
u AS (SELECT DISTINCT user_id, unit_id, string_split({FOLDED.format('caption')}, ' ') AS words FROM text_units), x AS (SELECT user_id, unit_id, words, unnest(range(1, len(words) + 1)) AS i FROM u),
h AS (SELECT x.*, e.word, len(e.w) AS n FROM x JOIN e ON x.words[i] = e.w[1] AND x.words[i:i + len(e.w) - 1] = e.w),
k AS (SELECT DISTINCT user_id, unit_id, word FROM h WHERE NOT EXISTS (SELECT 1 FROM h o WHERE o.user_id = h.user_id AND o.unit_id = h.unit_id AND o.words = h.words AND o.n > h.n AND o.i <= h.i AND h.i + h.n <= o.i + o.n))
SELECT user_id, word, count(*) AS n_units FROM k GROUP BY ALL""",
    "json_salvage": r"""
WITH t AS (SELECT doc_id, text, regexp_extract(text, '\{[^{}]*\}') AS f FROM documents WHERE text LIKE '%{%'),
j AS (SELECT doc_id, CASE WHEN json_valid(text) THEN text WHEN json_valid(f) THEN f END AS j FROM t)
SELECT doc_id, json_extract_string(j, '$.verdict') AS verdict, try_cast(json_extract_string(j, '$.score') AS DOUBLE) AS score FROM j WHERE json_extract_string(j, '$.verdict') IS NOT NULL""",
    "cited_photos": """
WITH t AS (SELECT doc_id, list_sort(list_distinct(list_transform(regexp_extract_all(lower(text), 'photo[_ -]?([0-9]{1,5})', 1), lambda d: 'photo_' || lpad(d, 5, '0')))) AS ids FROM documents)
SELECT doc_id, len(ids) AS n_photos, md5(array_to_string(ids, ',')) AS ids_md5 FROM t WHERE len(ids) > 0""",
    "props_by_type": "SELECT event_type, count(*) AS n, sum((props->>'$.k')::BIGINT) AS sum_k, max((props->>'$.k')::BIGINT) AS max_k FROM events GROUP BY event_type",
    "source_quota_docs": """
WITH t AS (SELECT doc_id, coalesce(source, '?') AS source, n_chars FROM documents WHERE n_chars IS NOT NULL),
r AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS k FROM t)
SELECT doc_id, source, n_chars FROM r ORDER BY (k > 2), n_chars DESC, doc_id LIMIT 60""",
}
