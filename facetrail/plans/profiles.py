"""Queries over names, owner facts, evidence and failures."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from facetrail.functions.text import fold
from facetrail.operators import albums as A
from facetrail.operators import evaluation as E
from facetrail.operators import profiles as P
from facetrail.plans import albums as AQ
from facetrail.plans import evaluation as EQ
from facetrail.session import table


def name_clusters_built(spark: SparkSession, d: str) -> DataFrame:
    return P.name_clusters(table(spark, d, "text_units")).withColumn("surfaces", F.concat_ws("|", "surfaces"))


def canonical_names(spark: SparkSession, d: str) -> DataFrame:
    return P.canonical_names(table(spark, d, "name_clusters"))


def cluster_relations(spark: SparkSession, d: str) -> DataFrame:
    return P.relations_by_priority(table(spark, d, "name_clusters"))


def owner_facts(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "photos")
    return P.owner_facts(table(spark, d, "text_units"), p, A.owner_faces(p))


def owner_gender(spark: SparkSession, d: str) -> DataFrame:
    return P.owner_gender(table(spark, d, "face_units"), A.owner_faces(table(spark, d, "photos")))


def redacted_captions(spark: SparkSession, d: str) -> DataFrame:
    """Captions without the names of the album's registered persons, in full or by their first word."""
    texts = table(spark, d, "photos").where("caption is not null").groupBy("user_id", "photo_id").agg(F.min("caption").alias("caption"))
    t = table(spark, d, "target_persons").where("trim(canonical_name) <> ''").select("user_id", F.trim("canonical_name").alias("name"))
    names = t.unionByName(t.select("user_id", F.split("name", " ")[0].alias("name"))).distinct()
    out = P.redacted(texts, names, "caption", "photo_id", "someone")
    return out.select("user_id", "photo_id", F.md5("caption").alias("caption_md5"), F.contains("caption", F.lit("someone")).alias("changed"))


def wanted_names(spark: SparkSession, d: str) -> DataFrame:
    return P.near_top(AQ.edge_margin(spark, d).select("user_id", "face_id", "name", "score"))


def representative_photos(spark: SparkSession, d: str) -> DataFrame:
    return P.representative_photos(table(spark, d, "face_units"))


def name_faithfulness(spark: SparkSession, d: str) -> DataFrame:
    """Mean faithfulness of predicted names at the faces of registered persons, by variant."""
    p = table(spark, d, "predicted_persons").groupBy("row_id").agg(*[F.min(c).alias(c) for c in ("user_id", "face_id", "canonical_name", "evidence_photo_ids", "reasoning_path")])
    s = EQ._scored(spark, d).select("row_id", "person_id", "variant", "name_score").join(p, "row_id")
    seen = A.appearances(table(spark, d, "photos"))
    known = seen.select("user_id", "photo_id").distinct().unionByName(table(spark, d, "photos").select("user_id", "photo_id")).distinct()
    caption = table(spark, d, "photos").groupBy("user_id", "photo_id").agg(F.min("caption").alias("caption"))
    ids = s.select("row_id", "person_id", "user_id", "face_id", "canonical_name", F.explode_outer("evidence_photo_ids").alias("photo_id"))
    joined = ids.join(known.withColumn("known", F.lit(1)), ["user_id", "photo_id"], "left").join(seen.withColumn("face", F.lit(1)), ["user_id", "photo_id", "face_id"], "left").join(caption, ["user_id", "photo_id"], "left")
    text = F.coalesce(F.contains(fold(F.col("caption")), fold(F.col("canonical_name"))) & (fold(F.col("canonical_name")) != ""), F.lit(False))
    e = joined.groupBy("row_id", "person_id").agg(F.count("photo_id").alias("n_ids"), (F.count("photo_id") == F.count(F.when(F.col("photo_id").isNotNull(), F.col("known")))).alias("all_known"), (F.count("face") > 0).alias("has_face"), F.max(text).alias("anchored"))
    rows = s.join(e, ["row_id", "person_id"])
    score = P.faithfulness(F.lit("person_name"), F.col("name_score"), F.col("name_score"), F.lit(True), F.col("canonical_name"), F.col("n_ids"), F.col("all_known"), F.col("reasoning_path"), F.col("has_face"), F.col("anchored"))
    return rows.withColumn("efs", score).groupBy("variant").agg(F.count("*").alias("n"), F.round(F.avg("efs"), 9).alias("efs"), F.round(F.avg(F.when(F.col("name_score") >= 1, F.col("efs"))), 9).alias("efs_given_correct"))


def identity_failures(spark: SparkSession, d: str) -> DataFrame:
    rows = EQ._identity(spark, d)
    reason = F.when(F.col("bound") == 1, "correct").when(F.col("discovered") == 1, "wrong_face_assignment").when(F.col("blank_name") == 1, "blank_target_face").otherwise("wrong_name")
    return rows.groupBy("variant", reason.alias("reason")).agg(F.count("*").alias("n"))


def edge_recall(spark: SparkSession, d: str) -> DataFrame:
    """Share of registered persons whose name is among the first 1, 3, 5 names of their face, by difficulty."""
    t = table(spark, d, "target_persons").groupBy("user_id", "person_id").agg(F.min("face_id").alias("face_id"), F.min("canonical_name").alias("c"), F.min("alignment_difficulty").alias("difficulty")).withColumn("name_key", fold(F.coalesce("c", F.lit(""))))
    e = table(spark, d, "identity_edges").where("score >= 0 and score <= 1 and not isnan(score)").select("user_id", "face_id", fold(F.col("name_surface")).alias("name"), "score").where("name <> ''").groupBy("user_id", "face_id", "name").agg(F.max("score").alias("score"))
    ranked = A.with_margin(e, ["user_id", "face_id"], "name").select("user_id", "face_id", F.col("name").alias("name_key"), "rank")
    j = t.join(ranked, ["user_id", "face_id", "name_key"], "left")
    at = lambda k: F.round(F.avg((F.coalesce("rank", F.lit(1 << 30)) <= k).cast("double")), 9)
    return j.groupBy(F.coalesce("difficulty", F.lit("unknown")).alias("difficulty")).agg(F.count("*").alias("n"), at(1).alias("r1"), at(3).alias("r3"), at(5).alias("r5"))


def variant_delta(spark: SparkSession, d: str) -> DataFrame:
    per_user = E.pir(EQ._identity(spark, d), ["variant", "user_id"]).groupBy("variant").agg(F.avg("pir").alias("pir"))
    # one row: the full variant
    full = per_user.where("variant = 'full'").select(F.col("pir").alias("base"))
    return per_user.join(F.broadcast(full), F.lit(True)).select("variant", F.round("pir", 9).alias("pir"), F.round(F.col("pir") - F.col("base"), 9).alias("delta"))


def weakest_users(spark: SparkSession, d: str) -> DataFrame:
    return E.pir(EQ._identity(spark, d), ["variant", "user_id"]).select("variant", "user_id", F.round("pir", 9).alias("pir")).orderBy("pir", "variant", "user_id").limit(10)


def judge_cache_hits(spark: SparkSession, d: str) -> DataFrame:
    """Requests of the second variant that the answers of the first already hold."""
    p = table(spark, d, "predicted_persons").where("trim(relation_to_owner) <> ''").select("variant", F.sha1(F.concat_ws("|", F.lit("relation"), F.lower(F.trim("relation_to_owner")))).alias("key")).distinct()
    cache = p.where("variant = 'full'").select("key").withColumn("hit", F.lit(1))
    return p.where("variant <> 'full'").join(cache, "key", "left").groupBy("variant").agg(F.count("*").alias("requests"), F.count("hit").alias("hits"))


FUNCTIONS = (name_clusters_built, canonical_names, cluster_relations, owner_facts, owner_gender, redacted_captions, wanted_names, representative_photos, name_faithfulness, identity_failures, edge_recall, variant_delta, weakest_users, judge_cache_hits)
QUERIES = {f.__name__: f for f in FUNCTIONS}

SEEN, OWNER, FOLD, FULL = AQ.SEEN, AQ.OWNER, AQ.FOLD, AQ.FULL
PRIORITY = "[" + ", ".join(f"'{r}'" for r in P.RELATION_PRIORITY) + "]"
RULES = ", ".join(f"('{n}', [{', '.join(repr(t) for t in terms)}], {least}, {score}::DOUBLE, {base}::DOUBLE)" for n, terms, least, score, base in P.OWNER_RULES)
PIR_OF = "SELECT variant, user_id, coalesce(2 * idr * ibr / nullif(idr + ibr, 0), 0) AS pir FROM (SELECT variant, user_id, avg(discovered) AS idr, coalesce(sum(bound) / nullif(sum(discovered), 0), 0) AS ibr FROM idr GROUP BY variant, user_id)"
SQL = {
    "canonical_names": rf"""
WITH c AS (SELECT cluster_id, min(primary_surface) AS p, min(first_name) AS f, first(last_name_candidates) FILTER (last_name_candidates IS NOT NULL) AS m FROM name_clusters GROUP BY cluster_id),
l AS (SELECT *, list_max(list_transform(map_entries(m), lambda e: {{'n': e.value, 'k': e.key}})).k AS l, {FULL.format('p')} AS is_full FROM c),
s AS (SELECT *, CASE WHEN is_full THEN 'observed_full_name' WHEN l IS NOT NULL AND f IS NOT NULL THEN 'observed_first_plus_text_last' ELSE 'observed_first_name' END AS name_source FROM l)
SELECT cluster_id, CASE WHEN name_source = 'observed_first_plus_text_last' THEN f || ' ' || l ELSE trim(regexp_replace(p, '\s+', ' ', 'g'), ' ') END AS canonical, name_source FROM s WHERE canonical IS NOT NULL""",
    "cluster_relations": f"""
WITH t AS (SELECT DISTINCT cluster_id, lower(trim(unnest(relation_terms))) AS t FROM name_clusters), r AS (SELECT *, list_position({PRIORITY}, t) AS k FROM t)
SELECT cluster_id, arg_min(t, k) AS relation FROM r WHERE k > 0 GROUP BY cluster_id""",
    "owner_facts": f"""
WITH o AS ({OWNER}), hf AS (SELECT s.user_id, s.photo_id FROM ({SEEN}) s JOIN o ON s.user_id = o.user_id AND s.face_id = o.owner_face),
u AS (SELECT user_id, unit_id, min(photo_id) AS photo_id, max(coalesce(owner_reference_score, 0)) AS ref, max(coalesce(len(visible_text), 0) > 0) AS ocr,
  ' ' || regexp_replace(lower(array_to_string(list_concat([min(coalesce(caption, ''))], list_sort(list_distinct(flatten(list(list_concat(coalesce(activity_terms, []), coalesce(venue_terms, []))))))), ' ')), '[^a-z0-9]+', ' ', 'g') || ' ' AS t FROM text_units GROUP BY user_id, unit_id),
r AS (SELECT * FROM (VALUES {RULES}) v(fact, terms, mp, ms, base)),
h AS (SELECT u.*, hf.photo_id IS NOT NULL AS face, fact, mp, ms, base, len(list_filter(terms, lambda x: contains(u.t, ' ' || x || ' '))) AS hits FROM u LEFT JOIN hf ON u.user_id = hf.user_id AND u.photo_id = hf.photo_id, r),
b AS (SELECT user_id, photo_id, fact, mp, ms, base, max((0.65::DOUBLE + 0.9::DOUBLE * ref + CASE WHEN face THEN 1.0 ELSE 0 END::DOUBLE + CASE WHEN ocr THEN 0.25 ELSE 0 END::DOUBLE) * (0.9::DOUBLE + least(1.8::DOUBLE, 0.35::DOUBLE * hits))
  + CASE WHEN face THEN 0.8 ELSE 0 END::DOUBLE + CASE WHEN ocr THEN 0.35 ELSE 0 END::DOUBLE) AS score FROM h WHERE hits > 0 GROUP BY ALL),
k AS (SELECT *, row_number() OVER (PARTITION BY user_id, fact ORDER BY score DESC, photo_id) AS k, count(*) OVER (PARTITION BY user_id, fact) AS na FROM b)
SELECT user_id, fact, round(sum(score), 3) AS score, round(least(0.88, base + least(0.12, 0.015::DOUBLE * count(*))), 3) AS confidence, count(*) AS n_photos FROM k WHERE k <= 8 GROUP BY user_id, fact, mp, ms, base, na HAVING na >= mp AND sum(score) >= ms""",
    "owner_gender": f"""
WITH o AS ({OWNER}), f AS (SELECT DISTINCT f.user_id, f.face_id, photo_id, caption FROM face_units f JOIN o ON f.user_id = o.user_id AND f.face_id = o.owner_face),
v AS (SELECT user_id, coalesce(sum(regexp_matches(lower(caption), '(^|[^a-z0-9_])(woman|female|lady|her|she)($|[^a-z0-9_])')::INT), 0)::BIGINT AS woman, coalesce(sum(regexp_matches(lower(caption), '(^|[^a-z0-9_])(man|male|gentleman|his|he)($|[^a-z0-9_])')::INT), 0)::BIGINT AS man FROM f GROUP BY user_id)
SELECT *, CASE WHEN woman = 0 AND man = 0 THEN NULL WHEN woman >= man THEN 'woman' ELSE 'man' END AS gender FROM v""",
    "wanted_names": f"""
WITH e AS ({AQ.SQL['edge_margin']}), k AS (SELECT *, first_value(score) OVER (PARTITION BY user_id, face_id ORDER BY score DESC, name) AS top FROM e)
SELECT user_id, name, count(DISTINCT face_id) AS n_faces, max(score) AS best FROM k WHERE rank <= 4 AND score >= top - 0.05::DOUBLE GROUP BY user_id, name HAVING count(DISTINCT face_id) >= 2""",
    "representative_photos": """
WITH o AS (SELECT user_id, face_id, photo_id, max(coalesce(owner_present, false)::INT) AS o, max(least(coalesce(len(visible_text), 0), 3)) AS v, max((coalesce(len(co_faces), 0) <= 2)::INT) AS s, min(coalesce(timestamp, '')) AS ts FROM face_units GROUP BY user_id, face_id, photo_id)
SELECT user_id, face_id, row_number() OVER (PARTITION BY user_id, face_id ORDER BY 2 * o + greatest(v, 0) + s DESC, ts, photo_id) AS rank, photo_id FROM o QUALIFY rank <= 5""",
    "name_faithfulness": f"""
WITH {EQ.SCORED}, q AS (SELECT row_id, min(user_id) AS user_id, min(face_id) AS face_id, min(canonical_name) AS cn, min(evidence_photo_ids) AS ids, min(reasoning_path) AS why FROM predicted_persons GROUP BY row_id),
s AS (SELECT x.row_id, x.person_id, x.variant, x.name_score, q.user_id, q.face_id, q.cn, q.ids, q.why FROM scored x JOIN q USING (row_id)),
seen AS ({SEEN}), known AS (SELECT user_id, photo_id, min(caption) AS caption FROM photos GROUP BY user_id, photo_id),
i AS (SELECT row_id, person_id, user_id, face_id, cn, unnest(ids) AS photo_id FROM s),
e AS (SELECT i.row_id, i.person_id, count(i.photo_id) AS n, count(k.photo_id) AS nk, count(f.photo_id) AS nf, max(coalesce(contains({FOLD.format('k.caption')}, {FOLD.format('cn')}) AND {FOLD.format('cn')} <> '', false)) AS anchored
  FROM i LEFT JOIN known k ON k.user_id = i.user_id AND k.photo_id = i.photo_id LEFT JOIN seen f ON f.user_id = i.user_id AND f.photo_id = i.photo_id AND f.face_id = i.face_id GROUP BY i.row_id, i.person_id),
z AS (SELECT s.variant, s.name_score, CASE WHEN trim(coalesce(cn, '')) = '' OR coalesce(n, 0) = 0 OR n <> nk THEN 0.0 WHEN name_score < 1 THEN 0.0 WHEN nf > 0 AND (anchored OR trim(coalesce(why, '')) <> '') THEN 1.0 ELSE 0.5 END::DOUBLE AS efs FROM s LEFT JOIN e USING (row_id, person_id))
SELECT variant, count(*) AS n, round(avg(efs), 9) AS efs, round(avg(efs) FILTER (name_score >= 1), 9) AS efs_given_correct FROM z GROUP BY variant""",
    "identity_failures": f"""WITH {EQ.IDENTITY}
SELECT variant, CASE WHEN bound = 1 THEN 'correct' WHEN discovered = 1 THEN 'wrong_face_assignment' WHEN blank_name = 1 THEN 'blank_target_face' ELSE 'wrong_name' END AS reason, count(*) AS n FROM idr GROUP BY ALL""",
    "edge_recall": f"""
WITH t AS (SELECT user_id, person_id, min(face_id) AS face_id, {FOLD.format("coalesce(min(canonical_name), '')")} AS k, coalesce(min(alignment_difficulty), 'unknown') AS difficulty FROM target_persons GROUP BY user_id, person_id),
e AS (SELECT user_id, face_id, {FOLD.format('name_surface')} AS k, max(score) AS score FROM identity_edges WHERE score >= 0 AND score <= 1 AND NOT isnan(score) GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY user_id, face_id ORDER BY score DESC, k) AS rank FROM e WHERE k <> '')
SELECT difficulty, count(*) AS n, round(avg((coalesce(rank, 1000000) <= 1)::INT), 9) AS r1, round(avg((coalesce(rank, 1000000) <= 3)::INT), 9) AS r3, round(avg((coalesce(rank, 1000000) <= 5)::INT), 9) AS r5 FROM t LEFT JOIN r USING (user_id, face_id, k) GROUP BY difficulty""",
    "variant_delta": f"WITH {EQ.IDENTITY}, u AS ({PIR_OF}), v AS (SELECT variant, avg(pir) AS pir FROM u GROUP BY variant) SELECT variant, round(pir, 9) AS pir, round(pir - (SELECT pir FROM v WHERE variant = 'full'), 9) AS delta FROM v",
    "weakest_users": f"WITH {EQ.IDENTITY}, u AS ({PIR_OF}) SELECT variant, user_id, round(pir, 9) AS pir FROM u ORDER BY 3, 1, 2 LIMIT 10",
    "judge_cache_hits": """
WITH p AS (SELECT DISTINCT variant, lower(trim(relation_to_owner)) AS k FROM predicted_persons WHERE trim(relation_to_owner) <> '')
SELECT variant, count(*) AS requests, count(*) FILTER (k IN (SELECT k FROM p WHERE variant = 'full')) AS hits FROM p WHERE variant <> 'full' GROUP BY variant""",
}
