"""Albums: faces, owners, episodes, names, event nodes and the bridges between faces and texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from facetrail.functions.text import fold, is_full_name
from facetrail.session import cut


def empty_list() -> Column:
    return F.array().cast("array<string>")


def once(df: DataFrame, keys: list[str], columns: dict[str, Column]) -> DataFrame:
    """One row per key: every column is the least of its values, so repeated deliveries give the same row on every run."""
    return df.select(*keys, *[c.alias(n) for n, c in columns.items()]).groupBy(*keys).agg(*[F.min(n).alias(n) for n in columns])


def appearances(photos: DataFrame) -> DataFrame:
    """(user_id, photo_id, face_id), each once; null and empty lists and null faces are left out."""
    return photos.select("user_id", "photo_id", F.explode("visible_face_ids").alias("face_id")).where("face_id is not null").distinct()


def face_registry(photos: DataFrame) -> DataFrame:
    """(user_id, face_id, n_appearances, first_month, last_month, n_photos); photos without a month are no appearances."""
    month = once(photos, ["user_id", "photo_id"], {"year_month": F.coalesce("year_month", F.lit(""))})
    seen = appearances(photos).join(month, ["user_id", "photo_id"])
    dated = F.when(F.col("year_month") != "", F.col("year_month"))
    return seen.groupBy("user_id", "face_id").agg(F.count(dated).alias("n_appearances"), F.min(dated).alias("first_month"), F.max(dated).alias("last_month"), F.count("*").alias("n_photos"))


def owner_faces(photos: DataFrame) -> DataFrame:
    """(user_id, owner_face): the most frequent face of each album, the least id on ties."""
    return appearances(photos).groupBy("user_id", "face_id").agg(F.count("*").alias("n")).groupBy("user_id").agg(F.min_by("face_id", F.struct(-F.col("n"), "face_id")).alias("owner_face"))


def owner_names(units: DataFrame) -> DataFrame:
    """(user_id, name, score, mentions, n_photos, full, rank): the owner's name by weighted mentions, full names first.

    A mention weighs 1 + 1.6 times the unit's owner reference score, + 0.4 with a face, + 0.2, + 0.8 for a full name."""
    one = units.groupBy("user_id", "unit_id").agg(F.min("photo_id").alias("photo_id"), F.min(F.coalesce("owner_reference_score", F.lit(0.0))).alias("ref"), F.max(F.coalesce("has_face", F.lit(False))).alias("has_face"), F.min("person_surfaces").alias("names"))
    named = one.select("user_id", "photo_id", "ref", "has_face", F.explode("names").alias("name")).where("trim(name) <> ''")
    weight = 1.0 + 1.6 * F.col("ref") + F.when(F.col("has_face"), 0.4).otherwise(0.0) + 0.2 + F.when(is_full_name(F.col("name")), 0.8).otherwise(0.0)
    scored = named.groupBy("user_id", "name").agg(F.round(F.sum(weight), 3).alias("score"), F.count("*").alias("mentions"), F.count_distinct("photo_id").alias("n_photos")).withColumn("is_full", is_full_name(F.col("name")))
    return scored.withColumn("rank", F.row_number().over(W.partitionBy("user_id").orderBy(F.col("is_full").desc(), F.col("score").desc(), F.col("mentions").desc(), "name")))


def home_cities(photos: DataFrame, owners: DataFrame) -> DataFrame:
    """(user_id, city, n): the city met most often on photos of the owner, else on all photos; the first by name on ties."""
    city = once(photos, ["user_id", "photo_id"], {"city": F.trim("metadata.gps_city")}).where("city <> ''")
    mine = appearances(photos).join(owners.withColumnRenamed("owner_face", "face_id"), ["user_id", "face_id"]).select("user_id", "photo_id")
    counted = city.join(mine.withColumn("own", F.lit(1)), ["user_id", "photo_id"], "left").groupBy("user_id", "city").agg(F.count("*").alias("n_all"), F.count("own").alias("n_own"))
    level = F.struct((F.col("n_own") == 0).cast("int").alias("other"), (-F.when(F.col("n_own") > 0, F.col("n_own")).otherwise(F.col("n_all"))).alias("n"), "city")
    best = counted.groupBy("user_id").agg(F.min(level).alias("b"))
    return best.select("user_id", "b.city", (-F.col("b.n")).alias("n"))


def episodes(photos: DataFrame) -> DataFrame:
    """(user_id, year_month, city, n_photos, n_faces, first_photo): photos of a month in a city."""
    one = once(photos, ["user_id", "photo_id"], {"year_month": F.coalesce("year_month", F.lit("")), "city": F.coalesce(F.lower(F.trim("metadata.gps_city")), F.lit(""))})
    faces = appearances(photos)
    return one.join(faces, ["user_id", "photo_id"], "left").groupBy("user_id", "year_month", "city").agg(F.count_distinct("photo_id").alias("n_photos"), F.count_distinct("face_id").alias("n_faces"), F.min("photo_id").alias("first_photo"))


def co_face_clues(photos: DataFrame, k: int = 8) -> DataFrame:
    """(user_id, face_id, clues): the k faces seen most often with each face, as ``id:n`` joined by blanks.

    Pairs are made inside each photo from its own list of faces."""
    lists = appearances(photos).groupBy("user_id", "photo_id").agg(F.collect_set("face_id").alias("faces"))
    pairs = lists.select("user_id", "faces", F.explode("faces").alias("face_id")).select("user_id", "face_id", F.explode(F.array_remove("faces", F.col("face_id"))).alias("other"))
    counted = pairs.groupBy("user_id", "face_id", "other").agg(F.count("*").alias("n"))
    top = counted.withColumn("r", F.row_number().over(W.partitionBy("user_id", "face_id").orderBy(F.col("n").desc(), "other"))).where(f"r <= {k}")
    return top.groupBy("user_id", "face_id").agg(F.concat_ws(" ", F.transform(F.array_sort(F.collect_list(F.struct("r", "other", "n"))), lambda s: F.concat(s["other"], F.lit(":"), s["n"].cast("string")))).alias("clues"))


def rebuilt_nodes(photos: DataFrame, units: DataFrame) -> DataFrame:
    """Event nodes from photos: (user_id, event_key, n_photos, n_text_photos, n_face_photos, n_faces, n_names, n_terms).

    A node holds the photos of one month, city and place. Names and terms come from the text units of its photos."""
    one = once(photos, ["user_id", "photo_id"], {"ym": F.coalesce("year_month", F.lit("")), "city": F.coalesce(fold(F.col("metadata.gps_city")), F.lit("")), "place": F.coalesce(fold(F.col("metadata.gps_location")), F.lit(""))})
    keyed = one.select("user_id", "photo_id", F.concat_ws("|", "ym", "city", "place").alias("event_key"))
    faces = appearances(photos).groupBy("user_id", "photo_id").agg(F.collect_set("face_id").alias("faces"))
    words = lambda c: F.transform(F.coalesce(F.col(c), empty_list()), lambda x: F.lower(F.trim(x)))
    text = units.groupBy("user_id", "photo_id").agg(F.array_distinct(F.flatten(F.collect_list(words("person_surfaces")))).alias("names"), F.array_distinct(F.flatten(F.collect_list(F.concat(words("activity_terms"), words("venue_terms"))))).alias("terms"))
    rows = keyed.join(faces, ["user_id", "photo_id"], "left").join(text, ["user_id", "photo_id"], "left")
    union = lambda c: F.size(F.array_distinct(F.array_compact(F.flatten(F.collect_list(c)))))
    return rows.groupBy("user_id", "event_key").agg(F.count("*").alias("n_photos"), F.count("names").alias("n_text_photos"), F.count("faces").alias("n_face_photos"), union("faces").alias("n_faces"), union("names").alias("n_names"), union("terms").alias("n_terms"))


def same_photo_weights(photos: DataFrame, clusters: DataFrame) -> DataFrame:
    """(user_id, face_id, cluster_id, n_same, weight): faces and name clusters that share photos.

    A shared photo weighs 1 / (its faces * its person names), at least one each."""
    persons = F.size(F.filter(F.coalesce("text_entities", F.array()), lambda e: F.lower(e["entity_type"]) == "person"))
    names = photos.groupBy("user_id", "photo_id").agg(F.max(persons).alias("n_names"))
    seen = appearances(photos)
    n_faces = seen.groupBy("user_id", "photo_id").agg(F.count("*").alias("n_faces"))
    mentions = clusters.select("user_id", "cluster_id", F.explode("mention_photo_ids").alias("photo_id")).distinct()
    rows = mentions.join(names, ["user_id", "photo_id"]).join(n_faces, ["user_id", "photo_id"]).join(seen, ["user_id", "photo_id"])
    w = 1.0 / (F.greatest("n_faces", F.lit(1)) * F.greatest("n_names", F.lit(1)))
    return rows.groupBy("user_id", "face_id", "cluster_id").agg(F.count("*").alias("n_same"), F.sum(w).alias("weight"))


def placed(units: DataFrame, *ids: str) -> DataFrame:
    """(user_id, ids.., photo_id, ym, city, place, day) of units, one row per photo and id: the least of its values; '' and null
    alike are no month, city or place. Days are as written, dashed or compact."""
    written = F.regexp_extract("timestamp", r"^(\d{4}-\d{2}-\d{2}|\d{8}(?!\d))", 1)
    day = F.regexp_replace(written, r"^(\d{4})(\d{2})(\d{2})$", "$1-$2-$3").try_cast("date")
    none = F.lit("")
    rows = units.select("user_id", *ids, "photo_id", F.coalesce("year_month", none).alias("ym"), F.coalesce(fold(F.col("gps_city")), none).alias("city"), F.coalesce(fold(F.col("gps_location")), none).alias("place"), day.alias("day"))
    return rows.groupBy("user_id", *ids, "photo_id").agg(F.min(F.struct("ym", "city", "place", "day")).alias("w")).select("user_id", *ids, "photo_id", "w.*")


SPOT, DATED = ["ym", "city", "place"], ["ym", "city", "day"]


def _spots(f: DataFrame, t: DataFrame) -> DataFrame:
    """(user_id, ym, city, place, city2, place2, k) of the spots of one month that bridge: k 0 if one place contains the other,
    else 1 if the city is the same. Spots are few, however many photos an album has."""
    a = f.where("ym <> ''").select("user_id", *SPOT).distinct()
    b = t.where("ym <> ''").select("user_id", "ym", F.col("city").alias("city2"), F.col("place").alias("place2")).distinct()
    inside = (F.col("place") != "") & (F.col("place2") != "") & (F.contains("place", F.col("place2")) | F.contains("place2", F.col("place")))
    k = F.when(inside, 0).when((F.col("city") != "") & (F.col("city") == F.col("city2")), 1)
    return a.join(b, ["user_id", "ym"]).withColumn("k", k).where("k is not null")


def _near(f: DataFrame, t: DataFrame, days: int) -> DataFrame:
    """(user_id, city, ym, day, ym2, day2): dates in one city, at most ``days`` apart and not of one month. Dates meet in
    stretches of ``days`` and those beside them, an equality join."""
    number = lambda c: F.unix_date(F.col(c))
    a = f.where("city <> '' and day is not null").select("user_id", *DATED).distinct().withColumn("b", F.floor(number("day") / days))
    b = t.where("city <> '' and day is not null").select("user_id", "city", F.col("ym").alias("ym2"), F.col("day").alias("day2")).distinct()
    b = b.withColumn("b", F.explode(F.transform(F.array(F.lit(-1), F.lit(0), F.lit(1)), lambda x: F.floor(number("day2") / days) + x)))
    return a.join(b, ["user_id", "city", "b"]).where((F.abs(number("day") - number("day2")) <= days) & ((F.col("ym") != F.col("ym2")) | (F.col("ym") == ""))).drop("b")


BRIDGES = ("location_month", "city_month", "near_date_city")


def bridges(face_units: DataFrame, text_units: DataFrame, near_days: int = 14) -> DataFrame:
    """(user_id, face_id, face_photo, text_photo, bridge): faces and texts on different photos that time and place bring
    together: 'location_month' (one place contains the other), else 'city_month', else 'near_date_city' within
    ``near_days`` of the dates as written, dashed or compact. Photos meet only at spots and dates that bridge."""
    f = placed(face_units, "face_id").withColumnRenamed("photo_id", "face_photo")
    t = placed(text_units).withColumnRenamed("photo_id", "text_photo")
    other = t.select("user_id", "text_photo", *[F.col(c).alias(f"{c}2") for c in ("ym", "city", "place", "day")])
    spots = f.join(_spots(f, t), ["user_id", *SPOT]).join(other.withColumn("ym", F.col("ym2")).drop("day2", "ym2"), ["user_id", "ym", "city2", "place2"])
    near = f.join(_near(f, t, near_days), ["user_id", *DATED]).join(other.withColumn("city", F.col("city2")).drop("city2", "place2"), ["user_id", "city", "ym2", "day2"]).withColumn("k", F.lit(2))
    keys = ["user_id", "face_id", "face_photo", "text_photo"]
    every = spots.select(*keys, "k").unionByName(near.select(*keys, "k")).where("face_photo <> text_photo")
    names = F.element_at(F.array(*map(F.lit, BRIDGES)), F.col("k") + 1)
    return every.select(*keys, names.alias("bridge"))


def bridge_counts(face_units: DataFrame, text_units: DataFrame, mentions: DataFrame, near_days: int = 14) -> DataFrame:
    """(user_id, face_id, cluster_id, strict, city, near): bridges from each face to the text photos of each cluster, counted
    without being made: photos are counted by spot and date on both sides first, the counts of those that bridge multiplied.

    mentions: (user_id, cluster_id, text_photo), distinct. What a photo would bridge to itself is counted and taken off."""
    f, t = cut(placed(face_units, "face_id")), cut(placed(text_units))
    m = t.join(mentions.withColumnRenamed("text_photo", "photo_id"), ["user_id", "photo_id"])
    spots, near = cut(_spots(f, t)), cut(_near(f, t, near_days))
    n = lambda df, who, keys, name, two="": df.groupBy("user_id", who, *keys).agg(F.count("*").alias(name)).withColumnsRenamed({c: c + two for c in keys})
    by_spot = n(f, "face_id", SPOT, "nf").join(spots, ["user_id", *SPOT]).join(n(m, "cluster_id", SPOT, "nt", "2").withColumnRenamed("ym2", "ym"), ["user_id", "ym", "city2", "place2"])
    by_date = n(f, "face_id", DATED, "nf").join(near, ["user_id", *DATED]).join(n(m, "cluster_id", DATED, "nt", "2").withColumnRenamed("city2", "city"), ["user_id", "city", "ym2", "day2"]).withColumn("k", F.lit(2))
    own = f.join(m.select("user_id", "photo_id", "cluster_id", *[F.col(c).alias(f"{c}2") for c in ("ym", "city", "place", "day")]), ["user_id", "photo_id"])
    own_spot = own.where("ym = ym2").join(spots, ["user_id", "ym", "city", "place", "city2", "place2"])
    own_date = own.where("city = city2").join(near, ["user_id", "city", "ym", "day", "ym2", "day2"]).withColumn("k", F.lit(2))
    key = ["user_id", "face_id", "cluster_id", "k"]
    times = F.col("nf") * F.col("nt")
    less = F.lit(-1).cast("long")
    rows = by_spot.select(*key, times.alias("n")).unionByName(by_date.select(*key, times.alias("n"))).unionByName(own_spot.select(*key, less.alias("n"))).unionByName(own_date.select(*key, less.alias("n")))
    of = lambda k: F.coalesce(F.sum(F.when(F.col("k") == k, F.col("n"))), F.lit(0))
    return rows.groupBy("user_id", "face_id", "cluster_id").agg(of(0).alias("strict"), of(1).alias("city"), of(2).alias("near")).where("strict > 0 or city > 0 or near > 0")


def strength(n: Column, scale: int) -> Column:
    """Saturating logarithm of a count: 1 from ``scale`` on."""
    return F.least(F.lit(1.0), F.log(n + 1.0) / F.log(F.lit(scale + 1.0)))


def multiset_overlap(face_units: DataFrame, clusters: DataFrame, column: str) -> DataFrame:
    """(user_id, face_id, cluster_id, overlap): sum over terms of the lesser of their counts on both sides."""
    term = lambda df, key: df.select("user_id", key, F.explode(column).alias("t")).select("user_id", key, F.lower("t").alias("t")).where("t is not null").groupBy("user_id", key, "t").agg(F.count("*").alias("n"))
    a, b = term(face_units, "face_id"), term(clusters, "cluster_id").withColumnRenamed("n", "m")
    return a.join(b, ["user_id", "t"]).groupBy("user_id", "face_id", "cluster_id").agg(F.sum(F.least("n", "m")).alias("overlap"))


def pair_scores(photos: DataFrame, face_units: DataFrame, text_units: DataFrame, clusters: DataFrame, per_face: int | None = 12) -> DataFrame:
    """(user_id, face_id, cluster_id, score, margin, rank): names scored for every face that is not the owner's.

    The score is the weighted sum of shared photos, bridges, shared activities and places, relations, company of the owner
    and quality of the name, less penalties, within 0..1; the margin is the lead over the next name. A pair is a candidate
    if it shares a photo, a bridge or a term, found by equality joins; pairs with none of these are not made up. ``per_face``
    null gives all candidates."""
    fu = face_units.groupBy("user_id", "face_id", "photo_id").agg(
        F.min("year_month").alias("year_month"), F.min("timestamp").alias("timestamp"), F.min("gps_city").alias("gps_city"), F.min("gps_location").alias("gps_location"), F.max("owner_present").alias("owner_present"), F.min("relation_terms").alias("relation_terms"), F.min("activity_terms").alias("activity_terms"), F.min("venue_terms").alias("venue_terms"))
    cl = clusters.groupBy("user_id", "cluster_id").agg(F.min("primary_surface").alias("primary_surface"), F.min("mention_photo_ids").alias("mention_photo_ids"), F.min("relation_terms").alias("relation_terms"), F.min("activity_terms").alias("activity_terms"), F.min("venue_terms").alias("venue_terms")).where("size(mention_photo_ids) > 0")
    key = ["user_id", "face_id", "cluster_id"]
    mention = cl.select("user_id", "cluster_id", F.explode("mention_photo_ids").alias("text_photo")).distinct()
    met = bridge_counts(fu, text_units, mention)
    same = same_photo_weights(photos, cl)
    act, ven = multiset_overlap(fu, cl, "activity_terms").withColumnRenamed("overlap", "act"), multiset_overlap(fu, cl, "venue_terms").withColumnRenamed("overlap", "ven")
    pairs = same.join(met, key, "full").join(act, key, "full").join(ven, key, "full").fillna(0)
    owner = owner_faces(photos).withColumnRenamed("owner_face", "face_id")
    per_face_terms = fu.groupBy("user_id", "face_id").agg(F.array_distinct(F.flatten(F.collect_list(F.coalesce("relation_terms", empty_list())))).alias("fr"), F.avg(F.coalesce(F.col("owner_present"), F.lit(False)).cast("double")).alias("rate"))
    rows = pairs.join(owner, ["user_id", "face_id"], "left_anti").join(per_face_terms, ["user_id", "face_id"]).join(cl.select("user_id", "cluster_id", "primary_surface", F.col("relation_terms").alias("cr")), ["user_id", "cluster_id"])
    relations = F.size(F.array_union(F.coalesce("cr", empty_list()), "fr"))
    full = F.coalesce(is_full_name(F.col("primary_surface")), F.lit(False))
    penalty = F.when((F.col("city") > 30) & (F.col("strict") == 0) & (F.col("n_same") == 0), 0.10).otherwise(0.0) + F.when(~full & (F.col("n_same") == 0), 0.06).otherwise(0.0)
    score = (
        0.50 * F.least(F.lit(1.0), "weight") + 0.25 * strength(F.col("strict"), 5) + 0.08 * strength(F.col("city"), 12) + 0.08 * strength(F.col("near"), 8)
        + 0.06 * F.least(F.lit(1.0), F.col("act") / 3.0) + 0.04 * F.least(F.lit(1.0), F.col("ven") / 3.0) + 0.08 * F.least(F.lit(1.0), relations / 2.0)
        + 0.06 * F.least(F.lit(1.0), F.col("rate") * 1.4) + 0.06 * F.when(full, 1.0).otherwise(0.45) - penalty
    )
    scored = rows.select(*key, F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), score)), 6).alias("score")).where("score > 0")
    ranked = with_margin(scored, ["user_id", "face_id"], "cluster_id")
    return ranked if per_face is None else ranked.where(f"rank <= {per_face}")


def with_margin(df: DataFrame, groups: list[str], tie: str, score: str = "score") -> DataFrame:
    """Adds rank and margin: the lead over the next score of the group, over 0 for the last."""
    w = W.partitionBy(*groups).orderBy(F.col(score).desc(), tie)
    return df.withColumn("rank", F.row_number().over(w)).withColumn("margin", F.round(F.greatest(F.lit(0.0), F.col(score) - F.coalesce(F.lead(score).over(w), F.lit(0.0))), 6))
