"""Queries of judging: fact matches, verdicts, fidelity, validated facts, the metric suite, run reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from facetrail.functions.text import clean_category, fold
from facetrail.operators import albums as A
from facetrail.operators import derive as D
from facetrail.operators import evaluation as E
from facetrail.operators import judging as J
from facetrail.operators import profiles as P
from facetrail.operators import reports as R
from facetrail.plans import derivations as DQ
from facetrail.plans import evaluation as EQ
from facetrail.plans.language import HEDGED
from facetrail.session import table


def _predicted(spark: SparkSession, d: str) -> DataFrame:
    """One row per predicted person."""
    p = table(spark, d, "predicted_persons")
    return p.groupBy("row_id").agg(*[F.min(c).alias(c) for c in p.columns if c != "row_id"])


def fact_matches(spark: SparkSession, d: str) -> DataFrame:
    """Reasonings of the full variant as facts to find among those of the other variants of the album."""
    p = _predicted(spark, d).where("trim(reasoning_path) <> ''")
    gold = p.where("variant = 'full'").select("user_id", F.col("row_id").alias("target_id"), F.col("reasoning_path").alias("text"))
    return J.best_matches(gold, p.where("variant <> 'full'").select("user_id", F.col("row_id").alias("fact_id"), F.col("reasoning_path").alias("text")))


def judge_verdicts(spark: SparkSession, d: str) -> DataFrame:
    """What documents say of a match and of faithfulness, by verdict."""
    t = F.col("text")
    faith, score = J.faith_verdict(t)
    rows = table(spark, d, "documents").where("text is not null").select("doc_id", J.value_verdict(t).alias("verdict"), J.matched_index(t).alias("matched_index"), faith.alias("faith"), score.alias("score"))
    return rows.where("verdict is not null or faith is not null or matched_index is not null")


def json_answers(spark: SparkSession, d: str) -> DataFrame:
    """Documents that hold a JSON object, in whatever wrapping: how many fields, and its verdict."""
    rows = table(spark, d, "documents").where("text like '%{%'").select("doc_id", J.json_object(F.col("text")).alias("j")).where("j is not null")
    return rows.select("doc_id", F.size("j").alias("n_fields"), F.col("j")["verdict"].alias("verdict"))


def reasoning_fidelity(spark: SparkSession, d: str) -> DataFrame:
    """Fidelity of every reasoning to that of the full variant at the same face."""
    p = _predicted(spark, d).where("face_id <> ''")
    gold = p.where("variant = 'full'").groupBy("user_id", "face_id").agg(F.max("row_id").alias("row_id")).join(p.select("row_id", F.col("reasoning_path").alias("gold_path"), F.col("canonical_name").alias("value")), "row_id").drop("row_id")
    j = p.where("variant <> 'full'").join(gold, ["user_id", "face_id"])
    s = j.select("variant", J.fidelity(F.coalesce("reasoning_path", F.lit("")), F.col("gold_path"), F.col("canonical_name"), F.col("value")).alias("fidelity"))
    return s.groupBy("variant", "fidelity").agg(F.count("*").alias("n"))


def proposed_facts(spark: SparkSession, d: str) -> DataFrame:
    p = _predicted(spark, d).select("user_id", F.col("row_id").alias("fact_id"), F.col("reasoning_path").alias("text"), F.col("evidence_photo_ids").alias("photo_ids"))
    return J.checked_facts(p, table(spark, d, "photos")).select("fact_id", "reason")


def _person_rows(spark: SparkSession, d: str) -> DataFrame:
    """One row per variant and registered person, with what metric_suite needs."""
    ident = EQ._identity(spark, d)
    p = _predicted(spark, d)
    t = table(spark, d, "target_persons").groupBy("user_id", "person_id").agg(F.min("face_id").alias("face_id"), F.min("relation").alias("target_relation"), F.min("relation_category").alias("target_category"))
    last = p.where("face_id <> ''").groupBy("variant", "user_id", "face_id").agg(F.max("row_id").alias("row_id"))
    e = table(spark, d, "relation_entries").where("entry_kind = 'relation'")
    words = e.select(F.explode(F.array_append("other_labels", F.col("entry_label"))).alias("phrase"), F.col("entry_label").alias("canonical"))
    here = last.join(p.drop("variant", "user_id", "face_id"), "row_id")
    here = D.canonical_terms(here, "relation_to_owner", words).withColumnRenamed("canonical", "predicted_relation")
    gold = D.canonical_terms(t, "target_relation", words).withColumnRenamed("canonical", "gold_relation")
    seen, known = A.appearances(table(spark, d, "photos")), table(spark, d, "photos").select("user_id", "photo_id").distinct()
    ids = here.select("row_id", "user_id", "face_id", F.explode("evidence_photo_ids").alias("photo_id"))
    ev = ids.join(known.withColumn("k", F.lit(1)), ["user_id", "photo_id"], "left").join(seen.withColumn("f", F.lit(1)), ["user_id", "photo_id", "face_id"], "left").groupBy("row_id").agg(F.count("photo_id").alias("n_ids"), (F.count("photo_id") == F.count("k")).alias("all_known"), (F.count("f") > 0).alias("has_face"))
    rows = ident.join(gold, ["user_id", "person_id"]).join(here.join(ev, "row_id", "left"), ["variant", "user_id", "face_id"], "left")
    bound, path = F.col("bound") == 1.0, F.coalesce("reasoning_path", F.lit(""))
    same_category = clean_category(F.coalesce("relation_category", F.lit(""))) == clean_category(F.coalesce("target_category", F.lit("")))
    relation = F.when(F.trim("target_relation") != "", F.when((F.col("predicted_relation") == F.col("gold_relation")) & (F.col("gold_relation") != ""), 1.0).when(same_category & (F.trim("target_category") != ""), 0.5).otherwise(0.0))
    category = F.when(F.trim("target_category") != "", F.when(same_category, 1.0).otherwise(0.0))
    rows = rows.withColumn("relation_score", relation).withColumn("category_score", category).fillna(0, ["n_ids"]).fillna(False, ["all_known", "has_face"])
    efs = lambda kind, correct, raw, said: P.faithfulness(F.lit(kind), correct, raw, bound, said, F.col("n_ids"), F.col("all_known"), path, F.col("has_face"), F.lit(False))
    held = lambda c: F.when(bound, F.col(c)).otherwise(0.0)
    return (
        rows.withColumn("efs_name", efs("person_name", F.col("bound"), F.col("bound"), F.col("canonical_name")))
        .withColumn("efs_relation", F.when(F.col("relation_score").isNotNull(), efs("person_relation", held("relation_score"), F.col("relation_score"), F.col("relation_to_owner"))))
        .withColumn("efs_category", F.when(F.col("category_score").isNotNull(), efs("person_category", held("category_score"), F.col("category_score"), F.col("relation_category"))))
    )


def metric_suite(spark: SparkSession, d: str) -> DataFrame:
    return EQ._rounded(J.metric_suite(_person_rows(spark, d)))


def metric_suite_macro(spark: SparkSession, d: str) -> DataFrame:
    """The suite of every variant: means over albums."""
    s = J.metric_suite(_person_rows(spark, d))
    return EQ._rounded(s.groupBy("variant").agg(F.count("*").alias("n_albums"), *[F.avg(c).alias(c) for c in ("pir", "pir_hard", "prr_id", "prr_e2e", "pcr", "efs", "ece")], F.sum("n_targets").alias("n_targets")))


def scores_by_category(spark: SparkSession, d: str) -> DataFrame:
    """Category scores by the target's category: over persons, and over albums that count alike."""
    r = _person_rows(spark, d).where("category_score is not null").withColumn("category", clean_category(F.col("target_category")))
    flat = r.groupBy("variant", "category").agg(F.count("*").alias("n"), F.avg("category_score").alias("mean_score"))
    return EQ._rounded(flat.join(J.macro_by(r, ["variant", "category"], "user_id", "category_score"), ["variant", "category"]).withColumnRenamed("category_score", "macro_score"))


def evidence_coverage(spark: SparkSession, d: str) -> DataFrame:
    """Share of an album's photos that a variant cites."""
    cited = _predicted(spark, d).select("user_id", "variant", F.explode("evidence_photo_ids").alias("photo_id")).distinct()
    photos = table(spark, d, "photos").select("user_id", "photo_id").distinct()
    per = photos.groupBy("user_id").agg(F.count("*").alias("n_photos"))
    c = cited.join(photos, ["user_id", "photo_id"]).groupBy("user_id", "variant").agg(F.count("*").alias("n_cited"))
    return c.join(per, "user_id").select("user_id", "variant", "n_cited", "n_photos", F.round(F.col("n_cited") / F.greatest("n_photos", F.lit(1)), 9).alias("coverage"))


def judge_budget(spark: SparkSession, d: str) -> DataFrame:
    """Judge calls and words that the targets of every album need."""
    t = table(spark, d, "target_persons").select("row_id", "person_id", "user_id", "canonical_name", "relation", "relation_category").distinct()
    return R.judge_budget(t.select("user_id", "person_id", "canonical_name", "relation", "relation_category").distinct(), {"canonical_name": (0, 900), "relation": (1, 700), "relation_category": (1, 600)})


def cost_summary(spark: SparkSession, d: str) -> DataFrame:
    """Calls, characters and albums by source of the documents, taken as stages of a run."""
    return R.cost_summary(table(spark, d, "documents").select(F.coalesce("source", F.lit("?")).alias("stage"), "user_id", F.col("n_chars").alias("tokens")), "stage")


def usage_by_stage(spark: SparkSession, d: str) -> DataFrame:
    """Usage of two runs, the English and the other documents, merged by stage."""
    docs = table(spark, d, "documents").select(F.coalesce("source", F.lit("?")).alias("stage"), F.col("n_chars").alias("tokens"), (F.coalesce("lang", F.lit("")) == "en").alias("first"))
    return R.merged_usage(docs.where("first"), docs.where("not first"), "stage")


def typed_totals(spark: SparkSession, d: str) -> DataFrame:
    """Counts summed and everything else averaged over the albums of each variant."""
    s = J.metric_suite(_person_rows(spark, d))
    return EQ._rounded(R.typed_aggregate(s, ["variant"], ["n_persons", "n_targets", "pir", "efs"]))


def flattened_metadata(spark: SparkSession, d: str) -> DataFrame:
    p = R.flattened(table(spark, d, "photos").select("user_id", "photo_id", "metadata"), "metadata", "meta_")
    return p.groupBy("meta_gps_city", "meta_device").agg(F.count("*").alias("n"))


FUNCTIONS = (
    fact_matches, judge_verdicts, json_answers, reasoning_fidelity, proposed_facts, metric_suite, metric_suite_macro, scores_by_category, evidence_coverage, judge_budget, cost_summary, usage_by_stage, typed_totals, flattened_metadata,
)
QUERIES = {f.__name__: f for f in FUNCTIONS}

FOLD, CAT, CLEAN = EQ.FOLD, EQ.CAT, EQ.CLEAN
TOKENS = "list_distinct(list_filter(list_transform(regexp_extract_all(coalesce({0}, ''), '[A-Za-z][A-Za-z0-9''_-]*'), lambda z: lower(z)), lambda z: length(z) > 2))"
PRED = "pr AS (SELECT row_id, min(user_id) AS user_id, min(variant) AS variant, min(face_id) AS face_id, min(canonical_name) AS cn, min(relation_to_owner) AS rel, min(relation_category) AS cat, min(evidence_photo_ids) AS ids, min(confidence) AS conf, min(reasoning_path) AS path FROM predicted_persons GROUP BY row_id)"
ONE = r"trim(regexp_replace({0}, '\s+', ' ', 'g'), ' ')"
WORD = "regexp_matches(t, '(^|[^a-z0-9_]){0}($|[^a-z0-9_])')"
SYN = f"syn AS (SELECT DISTINCT {FOLD.format('phrase')} AS phrase, canonical FROM (SELECT unnest(list_append(other_labels, entry_label)) AS phrase, entry_label AS canonical FROM relation_entries WHERE entry_kind = 'relation') WHERE {FOLD.format('phrase')} <> '')"
EFS = "CASE WHEN trim(coalesce({said}, '')) = '' OR n_ids = 0 OR NOT all_known THEN 0.0 ELSE {score} END::DOUBLE"
OTHER = "CASE WHEN bound = 1 THEN CASE WHEN {c} >= 1 THEN CASE WHEN has_face OR path <> '' THEN 1.0 ELSE 0.5 END WHEN {c} >= 0.5 THEN 0.5 ELSE 0.0 END WHEN {c} > 0 THEN 0.5 ELSE 0.0 END"
PERSONS = f"""
WITH {EQ.IDENTITY}, {PRED}, {SYN},
tp AS (SELECT user_id, person_id, min(face_id) AS face_id, min(relation) AS tr, min(relation_category) AS tc FROM target_persons GROUP BY user_id, person_id),
lst AS (SELECT variant, user_id, face_id, max(row_id) AS row_id FROM pr WHERE face_id <> '' GROUP BY ALL),
gk AS (SELECT DISTINCT k FROM (SELECT {FOLD.format("coalesce(tr, '')")} AS k FROM tp UNION ALL SELECT {FOLD.format("coalesce(rel, '')")} FROM pr)),
canon AS (SELECT gk.k, coalesce(arg_min(canonical, (-length(phrase), phrase)), gk.k) AS c FROM gk LEFT JOIN syn ON contains(' ' || gk.k || ' ', ' ' || phrase || ' ') GROUP BY gk.k),
seen AS (SELECT DISTINCT user_id, photo_id, unnest(visible_face_ids) AS face_id FROM photos), known AS (SELECT DISTINCT user_id, photo_id FROM photos),
ii AS (SELECT row_id, user_id, face_id, unnest(ids) AS photo_id FROM pr),
ev AS (SELECT ii.row_id, count(ii.photo_id) AS n_ids, count(ii.photo_id) = count(k.photo_id) AS all_known, count(s.face_id) > 0 AS has_face FROM ii LEFT JOIN known k ON k.user_id = ii.user_id AND k.photo_id = ii.photo_id
  LEFT JOIN seen s ON s.user_id = ii.user_id AND s.photo_id = ii.photo_id AND s.face_id = ii.face_id GROUP BY ii.row_id),
x AS (SELECT idr.*, pr.cn, pr.rel, pr.cat, pr.conf, coalesce(nullif(trim(coalesce(pr.path, '')), ''), '') AS path, coalesce(ev.n_ids, 0) AS n_ids, coalesce(ev.all_known, false) AS all_known, coalesce(ev.has_face, false) AS has_face, tp.tr, tp.tc, g.c AS gr, q.c AS prl,
    {CAT.format(CLEAN.format("coalesce(pr.cat, '')"))} = {CAT.format(CLEAN.format("coalesce(tp.tc, '')"))} AS same
  FROM idr JOIN tp ON tp.user_id = idr.user_id AND tp.person_id = idr.person_id LEFT JOIN lst ON lst.variant = idr.variant AND lst.user_id = idr.user_id AND lst.face_id = tp.face_id LEFT JOIN pr ON pr.row_id = lst.row_id
  LEFT JOIN ev ON ev.row_id = pr.row_id LEFT JOIN canon g ON g.k = {FOLD.format("coalesce(tp.tr, '')")} LEFT JOIN canon q ON pr.row_id IS NOT NULL AND q.k = {FOLD.format("coalesce(pr.rel, '')")}),
y AS (SELECT *, CASE WHEN trim(tr) <> '' THEN CASE WHEN coalesce(prl = gr, false) AND gr <> '' THEN 1.0 WHEN same AND trim(coalesce(tc, '')) <> '' THEN 0.5 ELSE 0.0 END END::DOUBLE AS rs, CASE WHEN trim(tc) <> '' THEN CASE WHEN same THEN 1.0 ELSE 0.0 END END::DOUBLE AS cs FROM x),
z AS (SELECT *, {EFS.format(said='cn', score="CASE WHEN bound < 1 THEN 0.0 WHEN has_face AND path <> '' THEN 1.0 ELSE 0.5 END")} AS en,
  CASE WHEN rs IS NOT NULL THEN {EFS.format(said='rel', score=OTHER.format(c='rs'))} END AS er, CASE WHEN cs IS NOT NULL THEN {EFS.format(said='cat', score=OTHER.format(c='cs'))} END AS ec FROM y),
cal AS (SELECT variant, user_id, least(greatest(coalesce(conf, 0), 0), 1) AS c, unnest([bound, CASE WHEN rs IS NOT NULL THEN CASE WHEN bound = 1 THEN rs ELSE 0 END END, CASE WHEN cs IS NOT NULL THEN CASE WHEN bound = 1 THEN cs ELSE 0 END END]) AS y FROM z WHERE NOT isnan(coalesce(conf, 0))),
bins AS (SELECT variant, user_id, least(floor(c * 10), 9) AS b, count(*) AS k, avg(c) AS ac, avg(y) AS ay FROM cal WHERE y IS NOT NULL GROUP BY ALL), ece AS (SELECT variant, user_id, sum(k * abs(ac - ay)) / sum(k) AS ece FROM bins GROUP BY ALL),
suite AS (SELECT variant, user_id, count(*) AS n_persons, avg(discovered) AS idr, coalesce(sum(bound) / nullif(sum(discovered), 0), 0) AS ibr, avg(strict) AS strict, avg(soft) AS soft, avg(wrong_face) AS wrong_face, avg(blank_name) AS blank_name,
    avg(rs) FILTER (bound = 1) AS prr_id, avg(CASE WHEN bound = 1 THEN rs ELSE 0 END) FILTER (rs IS NOT NULL) AS prr_e2e, avg(cs) AS pcr, avg(CASE WHEN bound = 1 THEN cs ELSE 0 END) FILTER (cs IS NOT NULL) AS pcr_e2e, avg(cs) FILTER (bound = 1) AS pcr_id,
    avg(en) AS efs_name, avg(er) AS efs_relation, avg(ec) AS efs_category, sum(coalesce(en, 0) + coalesce(er, 0) + coalesce(ec, 0)) / nullif(count(en) + count(er) + count(ec), 0) AS efs, count(*) + count(rs) + count(cs) AS n_targets,
    count(*) FILTER (difficulty = 'hard') AS nh, avg(discovered) FILTER (difficulty = 'hard') AS ih, coalesce(sum(bound) FILTER (difficulty = 'hard') / nullif(sum(discovered) FILTER (difficulty = 'hard'), 0), 0) AS bh FROM z GROUP BY ALL),
full_suite AS (SELECT suite.*, ece.ece, coalesce(2 * idr * ibr / nullif(idr + ibr, 0), 0) AS pir, CASE WHEN nh > 0 THEN coalesce(2 * ih * bh / nullif(ih + bh, 0), 0) END AS pir_hard FROM suite LEFT JOIN ece USING (variant, user_id))"""
_R = lambda *cs: ", ".join(f"round({c}, 9) AS {c}" for c in cs)
SIG = DQ.SQL["fact_signatures"].split("s AS (SELECT doc_id, ")[1].split(" AS signature FROM t)")[0]
SQL = {
    "fact_matches": f"""
WITH {PRED}, p AS (SELECT user_id, row_id, variant, {TOKENS.format('path')} AS w FROM pr WHERE trim(path) <> ''), t AS (SELECT user_id, row_id AS target_id, len(w) AS n, w FROM p WHERE variant = 'full'),
tw AS (SELECT user_id, target_id, n, unnest(w) AS w FROM t), fw AS (SELECT user_id, row_id AS fact_id, unnest(w) AS w FROM p WHERE variant <> 'full'),
c AS (SELECT tw.user_id, target_id, fact_id, count(*) / n::DOUBLE AS o FROM tw JOIN fw ON tw.user_id = fw.user_id AND tw.w = fw.w GROUP BY tw.user_id, target_id, n, fact_id),
b AS (SELECT user_id, target_id, arg_min(fact_id, (-o, fact_id)) AS fact_id, max(o) AS o FROM c GROUP BY user_id, target_id),
r AS (SELECT t.user_id, t.target_id, b.fact_id, round(coalesce(b.o, 0), 9) AS overlap FROM t LEFT JOIN b USING (user_id, target_id))
SELECT *, CASE WHEN overlap >= 0.55 THEN 'match' WHEN overlap >= 0.25 THEN 'partial' ELSE 'mismatch' END AS verdict, CASE WHEN overlap >= 0.55 THEN 1.0 WHEN overlap >= 0.25 THEN 0.5 ELSE 0.0 END::DOUBLE AS score FROM r""",
    "judge_verdicts": rf"""
WITH d AS (SELECT doc_id, {ONE.format('lower(text)')} AS t FROM documents WHERE text IS NOT NULL),
v AS (SELECT doc_id, CASE WHEN {WORD.format('mismatch')} OR contains(t, 'not match') THEN 'mismatch' WHEN {WORD.format('partial')} THEN 'partial' WHEN {WORD.format('match')} THEN 'match' END AS verdict,
  try_cast(nullif(regexp_extract(t, '(?:^|[^a-z0-9])(?:matched_)?index(?:$|[^a-z0-9_])[^0-9-]*(-?[0-9]+)', 1), '') AS INT) AS matched_index, CASE WHEN contains(t, 'unfaithful') THEN 'unfaithful' WHEN contains(t, 'partial') THEN 'partial' WHEN contains(t, 'faithful') THEN 'faithful' END AS faith,
  try_cast(nullif(regexp_extract(t, '(?:^|[^a-z0-9_])score(?:$|[^a-z0-9_])[^0-9]*(1(?:\.0)?|0(?:\.5|\.0)|0?\.[0-9]+)', 1), '') AS DOUBLE) AS s FROM d)
SELECT doc_id, verdict, matched_index, faith, CASE WHEN faith IS NOT NULL THEN coalesce(s, CASE faith WHEN 'faithful' THEN 1.0 WHEN 'partial' THEN 0.5 ELSE 0.0 END::DOUBLE) END AS score FROM v WHERE verdict IS NOT NULL OR faith IS NOT NULL OR matched_index IS NOT NULL""",
    "reasoning_fidelity": rf"""
WITH {PRED}, p AS (SELECT * FROM pr WHERE face_id <> ''), g AS (SELECT user_id, face_id, max(row_id) AS r FROM p WHERE variant = 'full' GROUP BY user_id, face_id), gv AS (SELECT g.user_id, g.face_id, p.path AS gp, p.cn AS gv FROM g JOIN p ON p.row_id = g.r),
j AS (SELECT p.variant, coalesce(p.path, '') AS path, p.cn, gp, gv, {TOKENS.format('gp')} AS gt, {TOKENS.format('p.path')} AS pt, {FOLD.format("coalesce(p.cn, '')")} AS said FROM p JOIN gv USING (user_id, face_id) WHERE p.variant <> 'full'),
k AS (SELECT *, regexp_matches(lower(path), 'photo[_ -]?[0-9]+') OR regexp_matches(path, '{'|'.join(J.STAGES)}') AS grounded, coalesce(len(list_intersect(gt, pt)) / nullif(len(gt), 0)::DOUBLE, 0) AS o,
  coalesce(cn, '') <> '' AND len(list_filter(string_split({ONE.format("coalesce(gv, '')")}, ' '), lambda w: length(w) > 2 AND (contains(said, {FOLD.format('w')}) OR contains({FOLD.format('w')}, said)))) > 0 AS fits FROM j)
SELECT variant, CASE WHEN NOT grounded THEN 0.0 WHEN o >= 0.4 AND fits THEN 0.66 ELSE 0.33 END::DOUBLE AS fidelity, count(*) AS n FROM k GROUP BY ALL""",
    "proposed_facts": f"""
WITH {PRED}, known AS (SELECT DISTINCT user_id, photo_id FROM photos), ok AS (SELECT DISTINCT row_id FROM (SELECT row_id, user_id, unnest(ids) AS photo_id FROM pr) JOIN known USING (user_id, photo_id)),
t AS (SELECT row_id, user_id, path AS text, {DQ.SQL['fact_signatures'].split('SELECT doc_id, ')[1].split(' AS w FROM')[0].replace('text', 'path')} AS w, lower(path) AS t FROM pr),
s AS (SELECT row_id, user_id, {SIG} AS sig, CASE WHEN len(list_filter(string_split({ONE.format("coalesce(text, '')")}, ' '), lambda q: q <> '')) < 4 THEN 'too_short' WHEN {HEDGED} THEN 'hedged' WHEN row_id NOT IN (SELECT row_id FROM ok) THEN 'no_known_photo' END AS reason FROM t),
f AS (SELECT user_id, sig, min(row_id) AS first FROM s WHERE reason IS NULL GROUP BY ALL)
SELECT s.row_id AS fact_id, coalesce(reason, CASE WHEN s.row_id > first THEN 'repeated' ELSE 'accepted' END) AS reason FROM s LEFT JOIN f ON f.user_id IS NOT DISTINCT FROM s.user_id AND f.sig IS NOT DISTINCT FROM s.sig""",
    "metric_suite": PERSONS + f""" SELECT variant, user_id, n_persons, n_targets, {_R('idr', 'ibr', 'strict', 'soft', 'wrong_face', 'blank_name', 'prr_id', 'prr_e2e', 'pcr', 'pcr_e2e', 'pcr_id', 'efs_name', 'efs_relation', 'efs_category', 'efs', 'ece', 'pir', 'pir_hard')} FROM full_suite""",
    "metric_suite_macro": PERSONS + " SELECT variant, count(*) AS n_albums, " + ", ".join(f"round(avg({c}), 9) AS {c}" for c in ("pir", "pir_hard", "prr_id", "prr_e2e", "pcr", "efs", "ece")) + ", sum(n_targets)::BIGINT AS n_targets FROM full_suite GROUP BY variant",
    "scores_by_category": PERSONS + f""", q AS (SELECT variant, user_id, {CAT.format(CLEAN.format('tc'))} AS category, cs FROM z WHERE cs IS NOT NULL), u AS (SELECT variant, category, user_id, avg(cs) AS m FROM q GROUP BY ALL), m AS (SELECT variant, category, count(*) AS n_users, avg(m) AS mm FROM u GROUP BY ALL)
SELECT q.variant, q.category, count(*) AS n, round(avg(cs), 9) AS mean_score, any_value(n_users) AS n_users, round(any_value(mm), 9) AS macro_score FROM q JOIN m USING (variant, category) GROUP BY q.variant, q.category""",
    "evidence_coverage": f"""
WITH {PRED}, p AS (SELECT DISTINCT user_id, photo_id FROM photos), n AS (SELECT user_id, count(*) AS n_photos FROM p GROUP BY user_id), c AS (SELECT DISTINCT user_id, variant, unnest(ids) AS photo_id FROM pr)
SELECT user_id, variant, count(*) AS n_cited, any_value(n_photos) AS n_photos, round(count(*) / greatest(any_value(n_photos), 1), 9) AS coverage FROM c JOIN p USING (user_id, photo_id) JOIN n USING (user_id) GROUP BY user_id, variant""",
    "judge_budget": """
WITH t AS (SELECT DISTINCT user_id, person_id, canonical_name, relation, relation_category FROM target_persons),
u AS (SELECT user_id, 'canonical_name' AS kind, 0 AS calls, 900 AS words FROM t WHERE trim(canonical_name) <> '' UNION ALL SELECT user_id, 'relation', 1, 700 FROM t WHERE trim(relation) <> '' UNION ALL SELECT user_id, 'relation_category', 1, 600 FROM t WHERE trim(relation_category) <> '')
SELECT user_id, kind, count(*) AS n_targets, sum(calls)::BIGINT AS n_calls, sum(calls * words)::BIGINT AS n_words FROM u GROUP BY user_id, kind""",
    "cost_summary": """
WITH d AS (SELECT coalesce(source, '?') AS stage, user_id, n_chars AS tokens FROM documents)
SELECT stage, count(*) AS n_calls, count(tokens) AS n_with_usage, coalesce(sum(tokens), 0)::BIGINT AS tokens, count(DISTINCT user_id) AS n_users, round(sum(tokens) / nullif(count(tokens), 0), 6) AS tokens_per_call, round(sum(tokens) / nullif(count(DISTINCT user_id), 0), 6) AS tokens_per_user, round(count(tokens) / nullif(count(*), 0), 6) AS coverage
FROM d GROUP BY stage""",
    "usage_by_stage": """
WITH d AS (SELECT coalesce(source, '?') AS stage, n_chars AS tokens, coalesce(lang, '') = 'en' AS f FROM documents)
SELECT stage, count(*) FILTER (f) AS calls_a, count(*) FILTER (NOT f) AS calls_b, count(*) AS calls, coalesce(sum(tokens), 0)::BIGINT AS tokens, round(count(tokens) / count(*), 6) AS coverage FROM d GROUP BY stage""",
    "typed_totals": PERSONS + " SELECT variant, sum(n_persons)::BIGINT AS n_persons, sum(n_targets)::BIGINT AS n_targets, round(avg(pir), 9) AS pir, round(avg(efs), 9) AS efs FROM full_suite GROUP BY variant",
    "flattened_metadata": "SELECT metadata.gps_city AS meta_gps_city, metadata.device AS meta_device, count(*) AS n FROM photos GROUP BY ALL",
}
