"""Evaluation, calibration, agreement and resampling of predicted persons."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from facetrail.functions.text import clean_category, fold
from facetrail.operators import evaluation as E
from facetrail.session import table


def _identity(spark: SparkSession, d: str) -> DataFrame:
    return E.identity_rows(table(spark, d, "predicted_persons"), table(spark, d, "target_persons"))


def identity_match(spark: SparkSession, d: str) -> DataFrame:
    return _identity(spark, d)


def _rounded(df: DataFrame) -> DataFrame:
    return df.select(*[F.round(c, 9).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def harmonic_pir(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(E.pir(_identity(spark, d), ["variant"]))


def pir_macro(spark: SparkSession, d: str) -> DataFrame:
    per_user = E.pir(_identity(spark, d), ["variant", "user_id"])
    return _rounded(per_user.groupBy("variant").agg(F.count("*").alias("n_users"), F.avg("idr").alias("idr"), F.avg("ibr").alias("ibr"), F.avg("pir").alias("pir")))


def difficulty_table(spark: SparkSession, d: str) -> DataFrame:
    """Every difficulty is there, with or without persons."""
    rows = _identity(spark, d)
    levels = spark.createDataFrame([("easy",), ("medium",), ("hard",)], "difficulty string")
    domain = rows.select("variant").distinct().join(F.broadcast(levels), F.lit(True))
    got = rows.groupBy("variant", "difficulty").agg(F.count("*").alias("n"), F.avg("strict").alias("strict"), F.avg("soft").alias("soft"), F.avg(F.when(F.col("discovered") == 1.0, F.col("bound"))).alias("bound_if_found"))
    return _rounded(domain.join(got, ["variant", "difficulty"], "left").fillna(0, ["n"]))


def _scored(spark: SparkSession, d: str) -> DataFrame:
    """Predictions at the face of a registered person: confidence, and scores of the name and the category."""
    p = table(spark, d, "predicted_persons").groupBy("row_id").agg(*[F.min(c).alias(c) for c in ("user_id", "variant", "face_id", "canonical_name", "relation_category", "confidence")])
    t = table(spark, d, "target_persons").groupBy("user_id", "person_id").agg(F.min("face_id").alias("face_id"), F.min("canonical_name").alias("target_name"), F.min("relation_category").alias("target_category"))
    j = p.join(t, ["user_id", "face_id"])
    a, b = fold(F.coalesce("canonical_name", F.lit(""))), fold(F.coalesce("target_name", F.lit("")))
    shared = F.size(F.array_intersect(F.split(a, " "), F.split(b, " ")))
    name = F.when((a == "") | (b == ""), 0.0).when((a == b) | F.contains(a, b) | F.contains(b, a), 1.0).when(shared > 0, 0.5).otherwise(0.0)
    category = F.when(clean_category(F.col("relation_category")) == clean_category(F.col("target_category")), 1.0).otherwise(0.0)
    return j.select("row_id", "person_id", "user_id", "variant", "confidence", name.alias("name_score"), category.alias("category_score"))


def value_ladder(spark: SparkSession, d: str) -> DataFrame:
    return _scored(spark, d).groupBy("variant", "name_score", "category_score").agg(F.count("*").alias("n"))


def ece_pooled(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(E.calibration_error(_scored(spark, d), [], "confidence", "name_score"))


def ece_by_variant(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(E.calibration_error(_scored(spark, d), ["variant"], "confidence", "name_score"))


def kappa_names_categories(spark: SparkSession, d: str) -> DataFrame:
    return E.weighted_kappa(E.confusion(_scored(spark, d), "name_score", "category_score"))


def kendall_names_confidence(spark: SparkSession, d: str) -> DataFrame:
    cells = _scored(spark, d).where("confidence is not null").groupBy("name_score", F.round("confidence", 1).alias("c")).agg(F.count("*").alias("n"))
    return _rounded(E.kendall(cells, "name_score", "c", "n"))


def correlations(spark: SparkSession, d: str) -> DataFrame:
    per_user = _scored(spark, d).groupBy("variant", "user_id").agg(F.round(F.avg("confidence"), 9).alias("c"), F.round(F.avg("name_score"), 9).alias("y"))
    ranked = E.average_ranks(E.average_ranks(per_user, ["variant"], "c", "rc"), ["variant"], "y", "ry")
    return _rounded(ranked.groupBy("variant").agg(F.count("*").alias("n"), F.corr("c", "y").alias("pearson"), F.corr("rc", "ry").alias("spearman"), F.avg(F.abs(F.col("c") - F.col("y"))).alias("mae")))


def bootstrap_variants(spark: SparkSession, d: str) -> DataFrame:
    per_user = _scored(spark, d).groupBy("user_id").agg(F.round(F.avg(F.when(F.col("variant") == "full", F.col("name_score"))), 9).alias("a"), F.round(F.avg(F.when(F.col("variant") != "full", F.col("name_score"))), 9).alias("b"))
    return E.paired_bootstrap(per_user, "user_id", "a", "b", 200, 20260609)


def evidence_f1(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "predicted_persons").groupBy("row_id").agg(F.min("user_id").alias("user_id"), F.min("face_id").alias("face_id"), F.min("evidence_photo_ids").alias("ids"))
    seen = table(spark, d, "face_units").select("user_id", "face_id", "photo_id").distinct().groupBy("user_id", "face_id").agg(F.collect_set("photo_id").alias("photos"))
    return p.join(seen, ["user_id", "face_id"], "left").select("row_id", F.round(E.set_f1(F.col("ids"), F.col("photos")), 9).alias("f1"))


FUNCTIONS = (identity_match, harmonic_pir, pir_macro, difficulty_table, value_ladder, ece_pooled, ece_by_variant, kappa_names_categories, kendall_names_confidence, correlations, bootstrap_variants, evidence_f1)
QUERIES = {f.__name__: f for f in FUNCTIONS}

FOLD = "trim(regexp_replace(lower(strip_accents({0})), '[^a-z0-9]+', ' ', 'g'))"
IDENTITY = f"""
t AS (SELECT user_id, person_id, min(face_id) AS face_id, min(canonical_name) AS cn, min(accepted_aliases) AS aa, min(alignment_difficulty) AS difficulty FROM target_persons GROUP BY user_id, person_id),
s AS (SELECT user_id, person_id, unnest(list_concat([cn], coalesce(aa, []))) AS s FROM t),
names AS (SELECT DISTINCT user_id, person_id, {FOLD.format('s')} AS name, string_split({FOLD.format('s')}, ' ')[1] AS first FROM s WHERE {FOLD.format('s')} <> ''),
p AS (SELECT row_id, min(user_id) AS user_id, min(variant) AS variant, min(face_id) AS face_id, {FOLD.format("coalesce(min(canonical_name), '')")} AS name FROM predicted_persons GROUP BY row_id),
uniq AS (SELECT user_id, first, min(person_id) AS person_id FROM names GROUP BY user_id, first HAVING count(DISTINCT person_id) = 1),
exact AS (SELECT DISTINCT row_id, person_id FROM p JOIN names USING (user_id, name)),
single AS (SELECT row_id, person_id FROM p JOIN uniq ON p.user_id = uniq.user_id AND p.name = uniq.first WHERE name <> ''),
match AS (SELECT * FROM exact UNION SELECT * FROM single),
found AS (SELECT DISTINCT variant, person_id FROM match JOIN p USING (row_id)),
here AS (SELECT variant, user_id, face_id, row_id, name FROM p WHERE face_id <> '' QUALIFY row_number() OVER (PARTITION BY variant, user_id, face_id ORDER BY row_id DESC) = 1),
base AS (SELECT v.variant, t.* FROM t JOIN (SELECT DISTINCT variant, user_id FROM p WHERE variant IS NOT NULL) v USING (user_id)),
identity AS (
  SELECT b.variant, b.user_id, b.person_id, b.difficulty, CASE WHEN f.person_id IS NULL THEN 0.0 ELSE 1.0 END::DOUBLE AS discovered,
    CASE WHEN EXISTS (SELECT 1 FROM match m WHERE m.row_id = h.row_id AND m.person_id = b.person_id) THEN 1.0 ELSE 0.0 END::DOUBLE AS bound,
    CASE WHEN EXISTS (SELECT 1 FROM exact m WHERE m.row_id = h.row_id AND m.person_id = b.person_id) THEN 1.0 ELSE 0.0 END::DOUBLE AS strict,
    CASE WHEN EXISTS (SELECT 1 FROM names n WHERE n.user_id = b.user_id AND n.person_id = b.person_id AND n.first = string_split(h.name, ' ')[1]) THEN 0.5 ELSE 0.0 END::DOUBLE AS partial,
    CASE WHEN coalesce(h.name, '') = '' THEN 1.0 ELSE 0.0 END::DOUBLE AS blank_name
  FROM base b LEFT JOIN here h ON h.variant = b.variant AND h.user_id = b.user_id AND h.face_id = b.face_id LEFT JOIN found f ON f.variant = b.variant AND f.person_id = b.person_id),
idr AS (SELECT variant, user_id, person_id, difficulty, discovered, bound, strict, greatest(strict, partial) AS soft, CASE WHEN discovered = 1 AND bound = 0 THEN 1.0 ELSE 0.0 END::DOUBLE AS wrong_face, blank_name FROM identity)
"""
CAT = "CASE {0} WHEN 'coworker' THEN 'colleague' WHEN 'co-worker' THEN 'colleague' WHEN 'work colleague' THEN 'colleague' WHEN 'relative' THEN 'family' WHEN 'partner' THEN 'family' WHEN 'spouse' THEN 'family' ELSE {0} END"
CLEAN = r"regexp_replace(trim(regexp_replace(lower({0}), '\s+', ' ', 'g'), ' '), '^[ ,.;:\-]+|[ ,.;:\-]+$', '', 'g')[1:80]"
SCORED = f"""
p AS (SELECT row_id, min(user_id) AS user_id, min(variant) AS variant, min(face_id) AS face_id, {FOLD.format("coalesce(min(canonical_name), '')")} AS a, min(relation_category) AS rc, min(confidence) AS confidence FROM predicted_persons GROUP BY row_id),
t AS (SELECT user_id, person_id, min(face_id) AS face_id, {FOLD.format("coalesce(min(canonical_name), '')")} AS b, min(relation_category) AS tc FROM target_persons GROUP BY user_id, person_id),
scored AS (SELECT row_id, person_id, p.user_id, variant, confidence,
  CASE WHEN a = '' OR b = '' THEN 0.0 WHEN a = b OR contains(a, b) OR contains(b, a) THEN 1.0 WHEN len(list_intersect(string_split(a, ' '), string_split(b, ' '))) > 0 THEN 0.5 ELSE 0.0 END::DOUBLE AS name_score,
  CASE WHEN {CAT.format(CLEAN.format('rc'))} = {CAT.format(CLEAN.format('tc'))} THEN 1.0 ELSE 0.0 END::DOUBLE AS category_score FROM p JOIN t USING (user_id, face_id))
"""
PIR = "count(*) AS n, avg(discovered) AS idr, coalesce(sum(bound) / nullif(sum(discovered), 0), 0) AS ibr"


def _ece(group: str) -> str:
    g = f"{group}, " if group else ""
    return f"""
WITH {SCORED}, r AS (SELECT {g}least(greatest(confidence, 0), 1) AS c, name_score AS y FROM scored WHERE confidence IS NOT NULL AND NOT isnan(confidence)),
b AS (SELECT {g}least(floor(c * 10), 9) AS bin, count(*) AS k, avg(c) AS ac, avg(y) AS ay FROM r GROUP BY {g}bin)
SELECT {g}sum(k)::BIGINT AS n, round(sum(k * abs(ac - ay)) / sum(k), 9) AS ece FROM b {f'GROUP BY {group}' if group else ''}"""


SQL = {
    "identity_match": f"WITH {IDENTITY} SELECT * FROM idr",
    "harmonic_pir": f"""WITH {IDENTITY}, a AS (SELECT variant, {PIR}, avg(strict) AS strict, avg(soft) AS soft, avg(wrong_face) AS wrong_face, avg(blank_name) AS blank_name FROM idr GROUP BY variant)
SELECT variant, n, round(idr, 9) AS idr, round(ibr, 9) AS ibr, round(strict, 9) AS strict, round(soft, 9) AS soft, round(wrong_face, 9) AS wrong_face, round(blank_name, 9) AS blank_name,
  round(coalesce(2 * idr * ibr / nullif(idr + ibr, 0), 0), 9) AS pir FROM a""",
    "pir_macro": f"""WITH {IDENTITY}, a AS (SELECT variant, user_id, {PIR} FROM idr GROUP BY variant, user_id)
SELECT variant, count(*) AS n_users, round(avg(idr), 9) AS idr, round(avg(ibr), 9) AS ibr, round(avg(coalesce(2 * idr * ibr / nullif(idr + ibr, 0), 0)), 9) AS pir FROM a GROUP BY variant""",
    "difficulty_table": f"""WITH {IDENTITY}, dom AS (SELECT variant, difficulty FROM (SELECT DISTINCT variant FROM idr), (VALUES ('easy'), ('medium'), ('hard')) v(difficulty)),
g AS (SELECT variant, difficulty, count(*) AS n, avg(strict) AS strict, avg(soft) AS soft, avg(bound) FILTER (discovered = 1) AS bif FROM idr GROUP BY variant, difficulty)
SELECT variant, difficulty, coalesce(n, 0) AS n, round(strict, 9) AS strict, round(soft, 9) AS soft, round(bif, 9) AS bound_if_found FROM dom LEFT JOIN g USING (variant, difficulty)""",
    "value_ladder": f"WITH {SCORED} SELECT variant, name_score, category_score, count(*) AS n FROM scored GROUP BY ALL",
    "ece_pooled": _ece(""),
    "ece_by_variant": _ece("variant"),
    "kappa_names_categories": f"""WITH {SCORED},
c AS (SELECT CASE WHEN name_score <= 0.25 THEN 0 WHEN name_score <= 0.75 THEN 1 ELSE 2 END AS i, CASE WHEN category_score <= 0.25 THEN 0 WHEN category_score <= 0.75 THEN 1 ELSE 2 END AS j, count(*) AS n FROM scored GROUP BY ALL),
o AS (SELECT sum(n) AS t, sum((i - j) ** 2 / 4.0::DOUBLE * n) / sum(n) AS o FROM c),
e AS (SELECT sum((r.i - k.j) ** 2 / 4.0::DOUBLE * r.n * k.n) AS e FROM (SELECT i, sum(n)::DOUBLE AS n FROM c GROUP BY i) r, (SELECT j, sum(n)::DOUBLE AS n FROM c GROUP BY j) k)
SELECT t::BIGINT AS n, round(1 - o / nullif(e / (t * t), 0), 6) AS kappa FROM o, e""",
    "kendall_names_confidence": f"""WITH {SCORED}, c AS (SELECT name_score AS x, round(confidence, 1) AS y, count(*)::DOUBLE AS n FROM scored WHERE confidence IS NOT NULL GROUP BY ALL),
q AS (SELECT sign(a.x - b.x) * sign(a.y - b.y) AS s, a.n * b.n AS m FROM c a JOIN c b ON a.x > b.x)
SELECT round(sum(s * m) / nullif(sum(m) FILTER (s <> 0), 0), 9) AS tau FROM q""",
    "correlations": f"""WITH {SCORED}, u AS (SELECT variant, user_id, round(avg(confidence), 9) AS c, round(avg(name_score), 9) AS y FROM scored GROUP BY variant, user_id),
r AS (SELECT *, CASE WHEN c IS NOT NULL THEN rank() OVER (PARTITION BY variant ORDER BY c) + (count(*) OVER (PARTITION BY variant, c) - 1) / 2.0::DOUBLE END AS rc,
  CASE WHEN y IS NOT NULL THEN rank() OVER (PARTITION BY variant ORDER BY y) + (count(*) OVER (PARTITION BY variant, y) - 1) / 2.0::DOUBLE END AS ry FROM u)
SELECT variant, count(*) AS n, round(corr(c, y), 9) AS pearson, round(corr(rc, ry), 9) AS spearman, round(avg(abs(c - y)), 9) AS mae FROM r GROUP BY variant""",
    "bootstrap_variants": f"""WITH {SCORED}, u AS (SELECT user_id, round(avg(name_score) FILTER (variant = 'full'), 9) - round(avg(name_score) FILTER (variant <> 'full'), 9) AS delta FROM scored GROUP BY user_id),
d AS (SELECT user_id, delta FROM u WHERE delta IS NOT NULL), n AS (SELECT count(*) AS n FROM d),
x AS (SELECT r, delta, ('0x' || sha256('20260609:' || r || ':' || user_id)[1:8])::BIGINT % 4294967296 AS x FROM d, (SELECT unnest(range(200)) AS r)),
w AS (SELECT r, delta, len(list_filter({E.poisson_steps()}, lambda s: x >= s)) AS w FROM x),
m AS (SELECT r, coalesce(sum(w * delta) / nullif(sum(w), 0), 0) AS m FROM w GROUP BY r), k AS (SELECT m, row_number() OVER (ORDER BY m, r) - 1 AS k FROM m)
SELECT round((SELECT avg(delta) FROM d), 6) AS mean_delta, round(max(m) FILTER (k = 4), 6) AS ci_low, round(max(m) FILTER (k = 194), 6) AS ci_high,
  round(CASE WHEN (SELECT avg(delta) FROM d) = 0 THEN 1 ELSE least(1, 2 * least(avg((m <= 0)::INT), avg((m >= 0)::INT))) END, 6) AS p_two_sided, (SELECT n FROM n) AS n_pairs FROM k""",
    "evidence_f1": """
WITH p AS (SELECT row_id, min(user_id) AS user_id, min(face_id) AS face_id, min(evidence_photo_ids) AS ids FROM predicted_persons GROUP BY row_id),
s AS (SELECT user_id, face_id, list(DISTINCT photo_id) AS photos FROM face_units GROUP BY ALL),
x AS (SELECT row_id, list_distinct(list_filter(coalesce(ids, []), lambda v: trim(v) <> '')) AS a, list_distinct(list_filter(coalesce(photos, []), lambda v: trim(v) <> '')) AS b FROM p LEFT JOIN s USING (user_id, face_id))
SELECT row_id, round(CASE WHEN len(a) + len(b) = 0 THEN 1.0 ELSE 2.0::DOUBLE * len(list_intersect(a, b)) / (len(a) + len(b)) END, 9) AS f1 FROM x""",
}
