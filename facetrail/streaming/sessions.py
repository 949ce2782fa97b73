"""Structured Streaming forms of the session and registry operators."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def session_stream(events: DataFrame, user: str, at: str, unit: str, gap: str = "90 minutes", late: str = "1 day") -> DataFrame:
    """user_id, start, end (of the last event), n_events of sessions of a stream; late events are waited for ``late`` long.

    Spark ends a session where the next event comes ``gap`` or more later, so the gap is widened by a microsecond to keep the
    batch rule (exactly the gap doesn't end it). Units delivered again within the watermark count once."""
    e = events.select(F.col(user).alias("user_id"), F.col(at).alias("at"), F.col(unit).alias("unit")).withWatermark("at", late).dropDuplicatesWithinWatermark(["user_id", "unit"])
    w = F.session_window("at", F.concat(F.lit(gap), F.lit(" 1 microsecond")))
    return e.groupBy("user_id", w.alias("w")).agg(F.max("at").alias("end"), F.count("*").alias("n_events")).select("user_id", F.col("w.start").alias("start"), "end", "n_events")


def face_counts(photos: DataFrame) -> DataFrame:
    """Running number of photos of every face of a stream of photos (complete or update mode), exact: the state keeps every
    face of every photo, so photos delivered again count once whenever they come."""
    seen = photos.select("user_id", "photo_id", F.explode(F.array_distinct("visible_face_ids")).alias("face_id")).dropDuplicates(["user_id", "photo_id", "face_id"])
    return seen.groupBy("user_id", "face_id").agg(F.count("photo_id").alias("n_photos"))
