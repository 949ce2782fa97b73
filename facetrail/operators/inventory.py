"""From an album to its evidence: text units, face units, the inventory of an album, and the excerpts that a reader gets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from facetrail.functions import claims as C
from facetrail.functions import people as P
from facetrail.functions.text import one_space, shorten
from facetrail.operators import albums as A
from facetrail.operators.derive import without_relation, written_name


def whole_photos(photos: DataFrame) -> DataFrame:
    """One row per photo: of repeated deliveries the one that came in first, the least caption on ties."""
    order = F.struct("ingested_at", F.coalesce("caption", F.lit(""))) if "ingested_at" in photos.columns else F.struct(F.coalesce("caption", F.lit("")))
    cols = [c for c in photos.columns if c not in ("user_id", "photo_id")]
    return photos.groupBy("user_id", "photo_id").agg(F.min_by(F.struct(*cols), order).alias("p")).select("user_id", "photo_id", "p.*")


def texts_of(c: str | Column) -> Column:
    return F.filter(F.coalesce(c if isinstance(c, Column) else F.col(c), A.empty_list()), lambda t: F.trim(t) != "")


def blob() -> Column:
    """Caption, visible texts and entities of a photo, a line each."""
    surfaces = F.coalesce(F.transform("text_entities", lambda e: e["surface"]), A.empty_list())
    return F.array_join(texts_of(F.concat(F.array("caption"), F.coalesce("visible_text", A.empty_list()), surfaces)), "\n")


def merged(a: Column, b: Column) -> Column:
    """Distinct values of two lists, those of the first first."""
    return F.array_distinct(F.array_compact(F.concat(a, b)))


def text_units(photos: DataFrame) -> DataFrame:
    """One row per photo that says anything: its texts, plausible person names without the relation before them, relations,
    activities, venues, organizations, reference to the owner, whether it shows a face.

    Names that the text recognition may have made up on photos of faces are left out. Photos without a caption, texts and
    names have no unit; null lists count as empty."""
    p = whole_photos(photos).withColumn("__blob", blob())
    entity = F.coalesce("text_entities", F.array())
    persons = F.filter(entity, lambda e: F.lower(e["entity_type"]) == "person")
    relation_of = lambda e: C.relation_value(without_relation(written_name(e["surface"]))[1])[0]
    prefixed = F.filter(F.transform(persons, relation_of), lambda r: r != "")
    p = p.withColumn("relation_terms", merged(C.relation_terms(F.col("__blob")), prefixed)).withColumn("visible_text", texts_of("visible_text"))
    has_face = F.coalesce(F.size("visible_face_ids"), F.lit(0)) > 0
    named = F.transform(persons, lambda e: F.struct(written_name(without_relation(written_name(e["surface"]))[0]).alias("name"), e["source"].alias("source")))
    kept = F.filter(named, lambda n: P.plausible_name(n["name"]) & ~P.misread_name(n["name"], n["source"], F.col("caption"), F.col("visible_text"), F.size("relation_terms") > 0, has_face))
    organizations = F.array_distinct(F.transform(F.filter(entity, lambda e: (F.lower(e["entity_type"]) == "organization") & (F.trim(e["surface"]) != "")), lambda e: one_space(e["surface"])))
    where = F.concat_ws("\n", "__blob", "metadata.gps_location", "metadata.gps_city")
    rows = p.select(
        "user_id", F.concat(F.lit("text::"), F.col("photo_id")).alias("unit_id"), "photo_id", F.coalesce("year_month", F.lit("")).alias("year_month"), F.coalesce("timestamp", F.lit("")).alias("timestamp"),
        F.coalesce("metadata.gps_city", F.lit("")).alias("gps_city"), F.coalesce("metadata.gps_location", F.lit("")).alias("gps_location"), F.coalesce("caption", F.lit("")).alias("caption"), "visible_text",
        F.array_distinct(F.transform(kept, lambda n: n["name"])).alias("person_surfaces"), "relation_terms", C.activity_terms(F.col("__blob")).alias("activity_terms"), C.venue_terms(where).alias("venue_terms"),
        organizations.alias("organization_terms"), C.owner_reference(F.col("__blob")).alias("owner_reference_score"), has_face.alias("has_face"),
    )
    return rows.where("caption <> '' or size(visible_text) > 0 or size(person_surfaces) > 0")


def face_units(photos: DataFrame, owners: DataFrame) -> DataFrame:
    """One row per face of a photo: the other faces, whether the owner is among them, the photo's terms.

    owners: (user_id, owner_face). A face listed twice is one; null faces are none."""
    p = whole_photos(photos).withColumn("faces", F.array_distinct(F.array_compact("visible_face_ids"))).where("size(faces) > 0").withColumn("__blob", blob())
    p = p.select("*", C.relation_terms(F.col("__blob")).alias("relation_terms"), C.activity_terms(F.col("__blob")).alias("activity_terms"), C.venue_terms(F.col("__blob")).alias("venue_terms"))
    owned = p.join(owners, "user_id", "left")
    return owned.select("*", F.explode("faces").alias("face_id")).select(
        "user_id", "face_id", "photo_id", "year_month", "timestamp", F.col("metadata.gps_city").alias("gps_city"), F.col("metadata.gps_location").alias("gps_location"), "caption", texts_of("visible_text").alias("visible_text"),
        F.array_remove("faces", F.col("face_id")).alias("co_faces"), F.coalesce(F.array_contains("faces", F.col("owner_face")), F.lit(False)).alias("owner_present"), "relation_terms", "activity_terms", "venue_terms",
    )


def inventory(photos: DataFrame) -> DataFrame:
    """One row per album: photos, photos with faces, faces, the owner's face and name, text and face units, first and last month."""
    units, owners = text_units(photos), A.owner_faces(photos)
    p = whole_photos(photos)
    seen = A.appearances(photos)
    counts = p.groupBy("user_id").agg(F.count("*").alias("n_photos"), F.min(F.nullif("year_month", F.lit(""))).alias("first_month"), F.max(F.nullif("year_month", F.lit(""))).alias("last_month"))
    faces = seen.groupBy("user_id").agg(F.count_distinct("face_id").alias("n_faces"), F.count_distinct("photo_id").alias("n_face_photos"), F.count("*").alias("n_face_units"))
    named = A.owner_names(units).where("rank = 1").select("user_id", F.col("name").alias("owner_name"))
    texts = units.groupBy("user_id").agg(F.count("*").alias("n_text_units"))
    out = counts.join(faces, "user_id", "left").join(owners, "user_id", "left").join(named, "user_id", "left").join(texts, "user_id", "left")
    return out.fillna(0, ["n_faces", "n_face_photos", "n_face_units", "n_text_units"])


def photo_brief(photos: DataFrame, chars: int = 240, texts: int = 8, entities: int = 8, faces: int = 12) -> DataFrame:
    """Photos cut to what fits a reader: caption and texts shortened to ``chars``, lists to their first values."""
    return whole_photos(photos).select(
        "user_id", "photo_id", F.coalesce("timestamp", F.lit("")).alias("timestamp"), shorten(F.coalesce("caption", F.lit("")), chars).alias("caption"),
        F.transform(F.slice(texts_of("visible_text"), 1, texts), lambda t: shorten(t, chars)).alias("visible_text"),
        F.slice(F.coalesce(F.transform("text_entities", lambda e: F.struct(e["surface"].alias("surface"), e["entity_type"].alias("entity_type"), e["source"].alias("source"))), F.array()), 1, entities).alias("text_entities"),
        F.slice(F.coalesce("visible_face_ids", A.empty_list()), 1, faces).alias("visible_face_ids"), F.coalesce("metadata.gps_city", F.lit("")).alias("gps_city"), F.coalesce("metadata.gps_location", F.lit("")).alias("gps_location"),
    )


def face_context(photos: DataFrame, max_photos: int = 6, chars: int = 180) -> DataFrame:
    """(user_id, face_id, n_photos, n_context, context): briefs of the first photos of every face by time, as an array.

    The rank limit comes before the briefs are brought together, so a face on very many photos costs no more than others."""
    seen = A.appearances(photos)
    total = seen.groupBy("user_id", "face_id").agg(F.count("*").alias("n_photos"))
    brief = photo_brief(photos, chars)
    w = W.partitionBy("user_id", "face_id").orderBy("timestamp", "photo_id")
    first = seen.join(brief.select("user_id", "photo_id", "timestamp"), ["user_id", "photo_id"]).withColumn("k", F.row_number().over(w)).where(F.col("k") <= max_photos)
    rows = first.drop("timestamp").join(brief, ["user_id", "photo_id"])
    packed = rows.groupBy("user_id", "face_id").agg(F.array_sort(F.collect_list(F.struct("k", "photo_id", "timestamp", "caption", "visible_text", "gps_city"))).alias("context"))
    return packed.join(total, ["user_id", "face_id"]).select("user_id", "face_id", "n_photos", F.size("context").alias("n_context"), "context")
