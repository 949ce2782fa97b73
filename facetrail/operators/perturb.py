"""Seeded perturbations and masks of albums: the same on every run and engine."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from facetrail.functions.text import first_words, unit_interval

#: Words kept of a caption, and the chances to lose the texts, the place, a face, the owner's face.
SETTINGS = {
    "caption_sparse": {"words": 28},
    "ocr_dropout_35": {"ocr": 0.35},
    "location_sparse_40": {"place": 0.40},
    "face_miss_15": {"face": 0.15, "owner": 0.03},
    "combined_mild": {"words": 36, "ocr": 0.25, "place": 0.30, "face": 0.10, "owner": 0.02},
}
MASKS = ("full", "text_off", "face_off", "metadata_off", "visual_off")


def seeded(seed: int, setting: str, *parts: Column) -> Column:
    return unit_interval(F.concat_ws("::", F.lit(str(seed)), F.lit(setting), *[F.coalesce(p, F.lit("")) for p in parts]))


def stress(photos: DataFrame, owners: DataFrame, setting: str, seed: int = 20260609) -> DataFrame:
    """Photos as a worse source would give them. owners: (user_id, owner_face). Unknown settings raise KeyError."""
    s = SETTINGS[setting]
    out = photos.join(owners, "user_id", "left")
    user, photo = F.col("user_id"), F.col("photo_id")
    if "words" in s:
        out = out.withColumn("caption", first_words(F.coalesce("caption", F.lit("")), s["words"]))
        said = F.lower("caption")
        out = out.withColumn("text_entities", F.filter("text_entities", lambda e: (F.lower(F.trim(e["source"])) != "caption") | F.contains(said, F.lower(e["surface"]))))
    if "ocr" in s:
        lost = seeded(seed, setting, user, photo, F.lit("ocr")) < s["ocr"]
        out = out.withColumn("text_entities", F.when(lost, F.filter("text_entities", lambda e: F.lower(F.trim(e["source"])) != "visible_text")).otherwise(F.col("text_entities")))
        out = out.withColumn("visible_text", F.when(lost, F.array().cast("array<string>")).otherwise(F.col("visible_text")))
    if "place" in s:
        lost = seeded(seed, setting, user, photo, F.lit("location")) < s["place"]
        blank = F.col("metadata").withField("gps_city", F.lit("")).withField("gps_location", F.lit(""))
        out = out.withColumn("metadata", F.when(lost, blank).otherwise(F.col("metadata")))
    if "face" in s:
        chance = lambda f: F.when(f == F.col("owner_face"), s["owner"]).otherwise(s["face"])
        out = out.withColumn("visible_face_ids", F.filter("visible_face_ids", lambda f: seeded(seed, setting, user, photo, f, F.lit("face")) >= chance(f)))
    return out.drop("owner_face")


def mask(photos: DataFrame, setting: str) -> DataFrame:
    """Photos without one kind of signal."""
    if setting not in MASKS:
        raise ValueError(f"unknown setting: {setting}")
    none = F.array().cast("array<string>")
    if setting == "text_off":
        return photos.withColumns({"caption": F.lit(""), "visible_text": none, "text_entities": F.filter("text_entities", lambda e: F.lit(False))})
    if setting in ("face_off", "visual_off"):
        return photos.withColumn("visible_face_ids", none)
    if setting == "metadata_off":
        return photos.withColumns({"timestamp": F.lit(""), "year_month": F.lit(""), "metadata": F.col("metadata").withField("gps_city", F.lit("")).withField("gps_location", F.lit(""))})
    return photos


def album_counts(photos: DataFrame) -> DataFrame:
    """n_photos, captions, caption_words, texts, entities, faces, places: what the photos of all albums hold."""
    size = lambda c: F.coalesce(F.size(F.coalesce(F.col(c), F.array())), F.lit(0))
    words = F.size(F.filter(F.split(F.coalesce("caption", F.lit("")), r"\s+"), lambda w: w != ""))
    return photos.agg(
        F.count("*").alias("n_photos"), F.count_if(F.trim(F.coalesce("caption", F.lit(""))) != "").alias("captions"), F.sum(words).alias("caption_words"), F.sum(size("visible_text")).alias("texts"),
        F.sum(size("text_entities")).alias("entities"), F.sum(size("visible_face_ids")).alias("faces"), F.count_if(F.coalesce("metadata.gps_city", F.lit("")) != "").alias("places"),
    )
