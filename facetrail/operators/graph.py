"""Identity edges of the event graph: faces and names of one event, or of events that time and place bring together."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from facetrail.functions.text import fold, is_full_name


def clean_nodes(nodes: DataFrame) -> DataFrame:
    """One row per event, with distinct lists without nulls and blanks."""
    text = ("user_id", "year_month", "gps_city", "location_key", "primary_channel")
    several = ("face_ids", "name_surfaces", "text_photo_ids", "face_photo_ids", "relation_terms", "channels", "terms")
    none = F.array().cast("array<string>")
    lists = lambda c: F.array_distinct(F.filter(F.transform(c, lambda x: F.trim(x)), lambda x: x != ""))
    one = nodes.groupBy("event_id").agg(*[F.min(c).alias(c) for c in text], *[F.flatten(F.collect_list(F.coalesce(F.col(c), none))).alias(c) for c in several], F.max("owner_present").alias("owner"))
    return one.select(
        "event_id", "user_id", F.coalesce("year_month", F.lit("")).alias("ym"), F.coalesce(fold(F.col("gps_city")), F.lit("")).alias("city"), F.coalesce(F.col("location_key"), F.lit("")).alias("place"), F.coalesce("primary_channel", F.lit("general")).alias("channel"),
        F.coalesce("owner", F.lit(False)).alias("owner"), *[lists(F.col(c)).alias(c) for c in ("face_ids", "name_surfaces", "text_photo_ids", "face_photo_ids", "relation_terms", "channels", "terms")],
    )


def best_edges(edges: DataFrame) -> DataFrame:
    """The best-scored edge of every face and name (lower case), the least event on ties."""
    k = F.struct((-F.col("score")).alias("s"), "event_id", "name")
    return edges.groupBy("user_id", "face_id", F.lower("name").alias("name_key")).agg(F.min(k).alias("b")).select("user_id", "face_id", "name_key", (-F.col("b.s")).alias("score"), F.col("b.event_id").alias("event_id"))


def _faces_by_names(df: DataFrame) -> DataFrame:
    return df.withColumn("face_id", F.explode("face_ids")).withColumn("name", F.explode("name_surfaces"))


def unit(c):
    return F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), c)), 6)


def direct_edges(nodes: DataFrame) -> DataFrame:
    """Edges between the faces and the names of one event."""
    n = F.size("face_ids")
    few = F.when(n <= 3, 0.04).otherwise(-F.least(F.lit(0.10), 0.01 * (n - 3)))
    score = 0.58 + F.when(F.col("owner"), 0.06).otherwise(0.0) + F.when(F.size("relation_terms") > 0, 0.06).otherwise(0.0) + F.when(F.col("channel") != "general", 0.05).otherwise(0.0) + F.when(is_full_name(F.col("name")), 0.08).otherwise(0.0) + few
    return best_edges(_faces_by_names(clean_nodes(nodes)).select("user_id", "face_id", "name", unit(score).alias("score"), "event_id"))


def node_bridges(nodes: DataFrame, least: float, per_text: int) -> DataFrame:
    """(user_id, text_event, face_event, score): events of one month that share the place, or else the city; shared channels
    and terms and the owner's presence add to the score; the best ``per_text`` of every text event. Two equality joins."""
    c = clean_nodes(nodes).where("ym <> ''")
    t = c.where("size(name_surfaces) > 0 and size(text_photo_ids) > 0").select("user_id", "ym", F.col("event_id").alias("text_event"), "city", "place", F.col("channels").alias("tc"), F.col("terms").alias("tt"), F.col("owner").alias("to"))
    f = c.where("size(face_ids) > 0 and size(face_photo_ids) > 0").select("user_id", "ym", F.col("event_id").alias("face_event"), "city", "place", F.col("channels").alias("fc"), F.col("terms").alias("ft"), F.col("owner").alias("fo"))
    place = t.where("place <> ''").join(f.drop("city"), ["user_id", "ym", "place"]).withColumn("base", F.lit(0.58))
    city = t.where("city <> ''").join(f.withColumnRenamed("place", "place2"), ["user_id", "ym", "city"]).where("place = '' or place <> place2").drop("place2").withColumn("base", F.lit(0.42))
    cols = ["user_id", "text_event", "face_event", "base", "tc", "fc", "tt", "ft", "to", "fo"]
    both = place.select(*cols).unionByName(city.select(*cols)).where("text_event <> face_event")
    score = F.col("base") + F.least(F.lit(0.22), 0.10 * F.size(F.array_intersect("tc", "fc"))) + F.least(F.lit(0.12), 0.04 * F.size(F.array_intersect("tt", "ft"))) + F.when(F.col("to") | F.col("fo"), 0.03).otherwise(0.0)
    scored = both.select("user_id", "text_event", "face_event", unit(score).alias("score"), F.arrays_overlap("tc", "fc").alias("same_channel")).where(F.col("score") >= least)
    w = W.partitionBy("user_id", "text_event").orderBy(F.col("score").desc(), "face_event")
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= per_text)


def cross_edges(nodes: DataFrame, least: float = 0.5, per_text: int = 12) -> DataFrame:
    """Edges between the names of an event and the faces of a bridged one."""
    c = clean_nodes(nodes)
    b = node_bridges(nodes, least, per_text).withColumnRenamed("score", "bridge")
    rows = b.join(c.select(F.col("event_id").alias("text_event"), "name_surfaces", F.col("owner").alias("to")), "text_event").join(c.select(F.col("event_id").alias("face_event"), "face_ids", F.col("owner").alias("fo")), "face_event")
    n = F.size("face_ids")
    score = 0.30 + 0.55 * F.col("bridge") + F.when(F.col("to") | F.col("fo"), 0.04).otherwise(0.0) + F.when(F.col("same_channel"), 0.04).otherwise(0.0) + F.when(is_full_name(F.col("name")), 0.04).otherwise(0.0) - F.when(n > 4, F.least(F.lit(0.08), 0.01 * (n - 4))).otherwise(0.0)
    return best_edges(_faces_by_names(rows).select("user_id", "face_id", "name", unit(score).alias("score"), F.col("text_event").alias("event_id")))


def bridge_score(strong, generic, channels, text_has_faces, persons, faces, strong_channel):
    """Score of two photos by shared keywords and channels: columns of counts and flags."""
    words = F.least(F.lit(0.38), 0.12 * strong + 0.04 * generic) + F.least(F.lit(0.42), 0.18 * channels) + F.when((channels > 0) & (strong > 0), 0.08).otherwise(0.0)
    weak = F.when((channels > 0) & (strong == 0) & ~strong_channel, 0.35 * words).otherwise(words)
    total = weak + F.when(text_has_faces, -0.04).otherwise(0.08) - F.when((persons >= 2) & text_has_faces, 0.06).otherwise(0.0) + F.when(faces <= 2, 0.03).otherwise(0.0)
    return F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), total)), 4)
