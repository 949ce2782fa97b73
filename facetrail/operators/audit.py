"""Audits: rules that find violations, each a filter over one table; leak scans over texts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: What a public photo and face id look like, and what entities may say.
PHOTO_ID, FACE_ID = r"^photo_[0-9]{4,}$", r"^face_[0-9]{3,}$"
SOURCES, KINDS = ("caption", "visible_text"), ("person", "organization", "location", "event")
#: Patterns that a public text must not hold.
LEAKS = {
    "home_path": r"/(home|users)/[a-z0-9_.-]+/",
    "secret_key": r"(api[_-]?key|secret|token)[ ]*[:=][ ]*[a-z0-9_-]{12,}",
    "private_id": r"(^|[^a-z0-9_])(kp_fact_|kp_node_|evt_[0-9]|amb_[0-9])",
}


#: Columns that a public photo must not have.
FORBIDDEN_COLUMNS = ("category", "event_context_tags", "event_id", "has_image", "image_path", "photo_role", "text_verified", "traceability", "visual_entities")


def forbidden_columns(photos: DataFrame) -> list[str]:
    """Columns of a table of public photos that it must not have."""
    return sorted(set(photos.columns) & set(FORBIDDEN_COLUMNS))


def violations(photos: DataFrame, face_units: DataFrame, targets: DataFrame, predicted: DataFrame | None = None) -> DataFrame:
    """(rule, user_id, subject): ill-formed ids and ids that tell private ones, the owner as a face, entities without surface or
    of unknown source or kind, face units of unknown photos or with faces that no photo shows, targets at faces that no photo
    shows, without a name or without aliases, photo ids delivered with different dates; with ``predicted``, also persons
    without a reasoning and persons that cite unknown photos."""
    p = photos.select("user_id", "photo_id", "timestamp", "visible_face_ids", "text_entities").distinct()
    faces = p.select("user_id", F.explode("visible_face_ids").alias("face_id")).distinct()
    entities = p.select("user_id", "photo_id", F.explode("text_entities").alias("e"))
    rule = lambda df, name, subject: df.select(F.lit(name).alias("rule"), "user_id", F.col(subject).alias("subject")).distinct()
    t = targets.select("user_id", "person_id", "face_id", "canonical_name", "accepted_aliases").distinct()
    known = p.select("user_id", "photo_id").distinct()
    found = [
        rule(p.where(~F.col("photo_id").rlike(PHOTO_ID)), "bad_photo_id", "photo_id"),
        rule(faces.where(~F.col("face_id").rlike(FACE_ID)), "bad_face_id", "face_id"),
        rule(entities.where("trim(coalesce(e.surface, '')) = ''"), "entity_without_surface", "photo_id"),
        rule(entities.where(~F.coalesce(F.col("e.source").isin(*SOURCES), F.lit(False))), "entity_source", "photo_id"),
        rule(entities.where(~F.coalesce(F.col("e.entity_type").isin(*KINDS), F.lit(False))), "entity_type", "photo_id"),
        rule(face_units.join(p.select("user_id", "photo_id").distinct(), ["user_id", "photo_id"], "left_anti"), "unit_of_unknown_photo", "photo_id"),
        rule(t.where("face_id <> ''").join(faces, ["user_id", "face_id"], "left_anti"), "target_face_not_shown", "person_id"),
        rule(t.where("trim(coalesce(canonical_name, '')) = ''"), "target_without_name", "person_id"),
        rule(p.where(F.lower("photo_id").rlike(LEAKS["private_id"])), "private_photo_id", "photo_id"),
        rule(faces.where("face_id = 'owner'"), "owner_as_face", "face_id"),
        rule(face_units.select("user_id", "face_id").where("face_id is not null").distinct().join(faces, ["user_id", "face_id"], "left_anti"), "unit_of_unknown_face", "face_id"),
        rule(t.where(F.size(F.filter(F.coalesce("accepted_aliases", F.array().cast("array<string>")), lambda x: F.trim(x) != "")) == 0), "target_without_aliases", "person_id"),
        rule(p.groupBy("user_id", "photo_id").agg(F.count_distinct("timestamp").alias("n")).where("n > 1"), "photo_with_two_dates", "photo_id"),
    ]
    if predicted is not None:
        q = predicted.select("user_id", F.col("row_id").cast("string").alias("row_id"), "reasoning_path", "evidence_photo_ids").distinct()
        found.append(rule(q.where("trim(coalesce(reasoning_path, '')) = ''"), "person_without_reasoning", "row_id"))
        cited = q.select("user_id", "row_id", F.explode("evidence_photo_ids").alias("photo_id")).where("photo_id is not null")
        found.append(rule(cited.join(known, ["user_id", "photo_id"], "left_anti"), "unknown_photo_cited", "row_id"))
    return reduce(DataFrame.unionByName, found)


def leaks(texts: DataFrame, key: str, text: str) -> DataFrame:
    """(key, kind) of every text that holds something a public text must not."""
    low = F.lower(F.col(text))
    kinds = F.filter(F.array(*[F.when(low.rlike(p), F.lit(k)) for k, p in LEAKS.items()]), lambda x: x.isNotNull())
    return texts.select(key, F.explode(kinds).alias("kind"))


def bijection_faults(mapping: DataFrame, private: str, public: str) -> DataFrame:
    """(side, id, n): ids of a mapping that stand for more than one id of the other side."""
    m = mapping.select(private, public).distinct()
    a = m.groupBy(private).agg(F.count("*").alias("n")).where("n > 1").select(F.lit("private").alias("side"), F.col(private).cast("string").alias("id"), "n")
    b = m.groupBy(public).agg(F.count("*").alias("n")).where("n > 1").select(F.lit("public").alias("side"), F.col(public).cast("string").alias("id"), "n")
    return a.unionByName(b)
