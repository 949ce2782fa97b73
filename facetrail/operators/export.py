"""Export of albums: public and private views, photo sources, rosters, alignments, targets, identifiers, evidence."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from facetrail.functions.text import fold, stable_integer, unit_interval
from facetrail.operators import albums as A


def public_ids(photos: DataFrame, digits: int = 5) -> DataFrame:
    """(user_id, photo_id, public_id): photos of each album numbered by time and id."""
    one = A.once(photos, ["user_id", "photo_id"], {"ts": F.coalesce("timestamp", F.lit(""))})
    n = F.row_number().over(W.partitionBy("user_id").orderBy("ts", "photo_id"))
    return one.select("user_id", "photo_id", F.format_string(f"photo_%0{digits}d", n).alias("public_id"))


def permuted_faces(faces: DataFrame, seed: int) -> DataFrame:
    """(user_id, face_id, public_face): the faces of each album numbered in the order of a seeded hash."""
    n = F.row_number().over(W.partitionBy("user_id").orderBy(F.sha2(F.concat_ws("|", F.lit(str(seed)), "user_id", "face_id"), 256), "face_id"))
    return faces.select("user_id", "face_id").distinct().select("user_id", "face_id", F.format_string("face_%03d", n).alias("public_face"))


def remapped(rows: DataFrame, key: str, ids: str, mapping: DataFrame, old: str, new: str) -> DataFrame:
    """(key, ids): the ids of a list column replaced through (user_id, old, new), each once, in order; unknown ids are left out."""
    each = rows.select(key, "user_id", F.posexplode(ids).alias("i", old))
    m = each.join(mapping.select("user_id", old, new), ["user_id", old])
    first = m.groupBy(key, new).agg(F.min("i").alias("i"))
    return first.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", new))), lambda s: s[new]).alias(ids))


def public_photos(photos: DataFrame, ids: DataFrame, faces: DataFrame) -> DataFrame:
    """What a reader sees of a photo: public ids, texts, entities without confidence, faces by their public ids, place and
    device; nothing else. ids: as public_ids gives them, faces: as permuted_faces."""
    one = photos.groupBy("user_id", "photo_id").agg(F.min(F.coalesce("caption", F.lit(""))).alias("caption"), F.min("visible_text").alias("visible_text"), F.min(F.transform("text_entities", lambda e: F.struct(e["surface"].alias("surface"), e["entity_type"].alias("entity_type"), e["source"].alias("source")))).alias("text_entities"), F.min(F.coalesce("timestamp", F.lit(""))).alias("timestamp"), F.min("metadata").alias("metadata"))
    shown = A.appearances(photos).join(faces, ["user_id", "face_id"]).groupBy("user_id", "photo_id").agg(F.array_sort(F.collect_set("public_face")).alias("visible_face_ids"))
    out = one.join(ids, ["user_id", "photo_id"]).join(shown, ["user_id", "photo_id"], "left")
    none = F.coalesce("visible_face_ids", A.empty_list())
    return out.select("user_id", F.col("public_id").alias("photo_id"), "timestamp", "caption", F.coalesce("visible_text", A.empty_list()).alias("visible_text"), "text_entities", none.alias("visible_face_ids"), F.coalesce("metadata.gps_city", F.lit("")).alias("gps_city"), F.coalesce("metadata.device", F.lit("")).alias("device"))


def photo_sources(photos: DataFrame, nodes: DataFrame, cited: DataFrame) -> DataFrame:
    """(user_id, photo_id, source): every photo of an album as key evidence if it is cited, else of an event if a node has it,
    else ambient. cited: (user_id, photo_id)."""
    p = photos.select("user_id", "photo_id").distinct()
    key = cited.select("user_id", "photo_id").distinct().withColumn("k", F.lit(1))
    of = nodes.select("user_id", F.explode("photo_ids").alias("photo_id")).distinct().withColumn("e", F.lit(1))
    j = p.join(key, ["user_id", "photo_id"], "left").join(of, ["user_id", "photo_id"], "left")
    return j.select("user_id", "photo_id", F.when(F.col("k") == 1, "key_evidence").when(F.col("e") == 1, "event").otherwise("ambient").alias("source"))


def planned_metadata(photos: DataFrame) -> DataFrame:
    """(user_id, photo_id, timestamp, place): a stable instant within a photo's month from a hash of its key, and its place
    with its city."""
    one = A.once(photos, ["user_id", "photo_id"], {"ym": F.col("year_month"), "place": F.concat_ws(", ", F.nullif("metadata.gps_location", F.lit("")), F.nullif("metadata.gps_city", F.lit("")))}).where("ym rlike '^[0-9]{4}-[0-9]{2}$'")
    key = F.concat_ws(":", "user_id", "photo_id")
    day, minute = stable_integer(key, 28) + 1, stable_integer(F.concat(key, F.lit(":m")), 1440)
    stamp = F.format_string("%s-%02dT%02d:%02d:00", F.col("ym"), day, F.floor(minute / 60), minute % 60)
    return one.select("user_id", "photo_id", stamp.alias("timestamp"), "place")


def aliases_as_atoms(targets: DataFrame) -> DataFrame:
    """(person_id, atom_no, atom): the accepted names of every person as atomic targets; the canonical name where there are none."""
    t = targets.groupBy("person_id").agg(F.min("canonical_name").alias("c"), F.min("accepted_aliases").alias("a"))
    clean = F.array_distinct(F.filter(F.coalesce("a", A.empty_list()), lambda x: F.trim(x) != ""))
    atoms = F.when(F.size(clean) > 0, clean).when(F.trim("c") != "", F.array("c")).otherwise(A.empty_list())
    return t.select("person_id", F.posexplode(atoms).alias("atom_no", "atom"))


def entity_alignment(targets: DataFrame, clusters: DataFrame, difficulty: DataFrame) -> DataFrame:
    """(user_id, person_id, surface_key, n_clusters, photos, difficulty): every accepted name of a person with the photos on
    which clusters of that name are mentioned, and the least difficulty of them (easy, medium, hard).

    difficulty: (user_id, person_id, photo_id, difficulty); photos without one are hard."""
    names = targets.select("user_id", "person_id", F.explode(F.array_union(F.array("canonical_name"), F.coalesce("accepted_aliases", A.empty_list()))).alias("s")).select("user_id", "person_id", fold(F.col("s")).alias("surface_key")).where("surface_key <> ''").distinct()
    said = clusters.select("user_id", "cluster_id", "mention_photo_ids", F.explode("surfaces").alias("s")).select("user_id", "cluster_id", "mention_photo_ids", fold(F.col("s")).alias("surface_key")).distinct()
    rows = names.join(said, ["user_id", "surface_key"]).select("user_id", "person_id", "surface_key", "cluster_id", F.explode(F.when(F.size("mention_photo_ids") > 0, F.col("mention_photo_ids")).otherwise(F.array(F.lit(None).cast("string")))).alias("photo_id")).join(difficulty, ["user_id", "person_id", "photo_id"], "left")
    level = F.when(F.col("photo_id").isNotNull(), F.when(F.col("difficulty") == "easy", 0).when(F.col("difficulty") == "medium", 1).otherwise(2))
    g = rows.groupBy("user_id", "person_id", "surface_key").agg(F.count_distinct("cluster_id").alias("n_clusters"), F.array_sort(F.collect_set("photo_id")).alias("photos"), F.min(level).alias("l"))
    level = F.element_at(F.array(F.lit("easy"), F.lit("medium"), F.lit("hard")), F.col("l") + 1)
    return g.withColumn("difficulty", F.when(F.size("photos") > 0, level)).drop("l")


def roster(targets: DataFrame, seen: DataFrame, mentions: DataFrame) -> DataFrame:
    """(user_id, person_id, n_face_photos, n_mention_photos, both): photos that show a person, that mention them, and both.

    seen: (user_id, photo_id, face_id), mentions: (user_id, person_id, photo_id)."""
    t = targets.groupBy("user_id", "person_id").agg(F.min("face_id").alias("face_id"))
    shown = t.join(seen, ["user_id", "face_id"]).select("user_id", "person_id", "photo_id", F.lit(1).alias("f"))
    rows = shown.join(mentions.select("user_id", "person_id", "photo_id", F.lit(1).alias("m")).distinct(), ["user_id", "person_id", "photo_id"], "full")
    g = rows.groupBy("user_id", "person_id").agg(F.count("f").alias("n_face_photos"), F.count("m").alias("n_mention_photos"), F.array_sort(F.collect_list(F.when(F.col("f").isNotNull() & F.col("m").isNotNull(), F.col("photo_id")))).alias("both"))
    return t.select("user_id", "person_id").join(g, ["user_id", "person_id"], "left").fillna(0, ["n_face_photos", "n_mention_photos"]).withColumn("both", F.coalesce("both", A.empty_list()))


def supports(rows: DataFrame, ids: str, order: list[str]) -> DataFrame:
    """Each row's list flattened, with a running number per album: (user_id, order.., photo_id, sequence)."""
    flat = rows.select("user_id", *order, F.posexplode(ids).alias("i", "photo_id"))
    return flat.withColumn("sequence", F.row_number().over(W.partitionBy("user_id").orderBy(*order, "i"))).drop("i")


def ranked_evidence(persons: DataFrame, seen: DataFrame, texts: DataFrame, limit: int = 8) -> DataFrame:
    """(row_id, rank, photo_id, score): the photos that carry a predicted person best: 4 for the face, 4 for the full name in the
    texts or 1.5 for its first word, 2 if both are there, 1 if the photo was cited; then by id.

    persons: (row_id, user_id, face_id, name, cited), texts: (user_id, photo_id, text). Photos are found by equality joins: on
    the face, on the first word of the name, and on the cited ids."""
    word = lambda c: F.split(fold(c), " ")
    p = persons.select("row_id", "user_id", "face_id", fold(F.coalesce("name", F.lit(""))).alias("name"), "cited").withColumn("first", F.split("name", " ")[0])
    by_face = p.join(seen, ["user_id", "face_id"]).select("row_id", "photo_id", F.lit(4.0).alias("f"), F.lit(0.0).alias("n"), F.lit(0.0).alias("c"))
    said = texts.select("user_id", "photo_id", fold(F.col("text")).alias("t"), F.explode(F.array_distinct(word(F.col("text")))).alias("first")).where("first <> ''")
    full = F.contains(F.concat(F.lit(" "), F.col("t"), F.lit(" ")), F.concat(F.lit(" "), F.col("name"), F.lit(" ")))
    by_name = p.join(said, ["user_id", "first"]).select("row_id", "photo_id", F.lit(0.0).alias("f"), F.when(full, 4.0).otherwise(1.5).alias("n"), F.lit(0.0).alias("c"))
    by_cite = p.select("row_id", F.explode("cited").alias("photo_id")).where("photo_id is not null").select("row_id", "photo_id", F.lit(0.0).alias("f"), F.lit(0.0).alias("n"), F.lit(1.0).alias("c"))
    g = by_face.unionByName(by_name).unionByName(by_cite).groupBy("row_id", "photo_id").agg(*[F.max(x).alias(x) for x in "fnc"])
    score = F.col("f") + F.col("n") + F.col("c") + F.when((F.col("f") > 0) & (F.col("n") > 0), 2.0).otherwise(0.0)
    s = g.withColumn("score", score)
    return s.withColumn("rank", F.row_number().over(W.partitionBy("row_id").orderBy(F.col("score").desc(), "photo_id"))).where(F.col("rank") <= limit).select("row_id", "rank", "photo_id", "score")


def gaussian_sizes(users: DataFrame, low: int, high: int, seed: int) -> DataFrame:
    """(user_id, target): a number of photos for every album, normally distributed between low and high, from two hashed units
    (Box and Muller), the same on every run."""
    u = lambda tail: unit_interval(F.concat_ws(":", F.lit(str(seed)), "user_id", F.lit(tail)))
    z = F.sqrt(-2.0 * F.log(F.greatest(u("a"), F.lit(1e-12)))) * F.cos(2 * math.pi * u("b"))
    size = F.floor((low + high) / 2 + z * (high - low) / 6.0 + 0.5)
    return users.select("user_id", F.greatest(F.lit(low), F.least(F.lit(high), size)).cast("int").alias("target"))


def merged_facts(facts: DataFrame, signature: Column, primary: Column, limit: int) -> DataFrame:
    """(user_id, rank, fact_id): facts of each album, those of the primary run first, one of each signature, ``limit`` at most.

    facts: (user_id, fact_id, text)."""
    order = F.struct((~primary).cast("int").alias("p"), F.col("fact_id"))
    one = facts.withColumn("__s", signature).where("__s <> ''").groupBy("user_id", "__s").agg(F.min(order).alias("o"))
    return one.select("user_id", F.col("o.fact_id").alias("fact_id"), F.row_number().over(W.partitionBy("user_id").orderBy("o")).alias("rank")).where(F.col("rank") <= limit)


def profile_rows(resolved: DataFrame, faces: DataFrame, limit: int = 8) -> DataFrame:
    """One row per face of an album: the resolved ones with their evidence (photos of both, then of the text, then of the face, each
    once, ``limit`` at most), the others unresolved, without a name.

    resolved: (user_id, face_id, name, score, margin, same, text, face) with three photo lists; faces: (user_id, face_id)."""
    lists = F.concat(*[F.coalesce(c, A.empty_list()) for c in ("same", "text", "face")])
    confidence = F.round(F.greatest(F.lit(0.05), F.least(F.lit(0.95), 0.36 + 0.52 * F.col("score") + 0.30 * F.col("margin"))), 3)
    r = resolved.select("user_id", "face_id", "name", confidence.alias("confidence"), F.slice(F.array_distinct(F.array_compact(lists)), 1, limit).alias("evidence"))
    j = faces.select("user_id", "face_id").distinct().join(r, ["user_id", "face_id"], "left")
    return j.select("user_id", "face_id", F.coalesce("name", F.lit("")).alias("name"), F.coalesce("confidence", F.lit(0.0)).alias("confidence"), F.coalesce("evidence", A.empty_list()).alias("evidence"), F.when(F.col("name").isNull(), "unresolved").otherwise("resolved").alias("status"))


def narrative(name: Column, n_same: Column, n_strict: Column, n_city: Column, relation: Column) -> Column:
    """What speaks for a name at a face, in a sentence."""
    parts = [
        F.when(n_same > 0, F.format_string("shown and named on %d photos", n_same.cast("int"))), F.when(n_strict > 0, F.format_string("%d bridges of place and month", n_strict.cast("int"))),
        F.when(n_city > 0, F.format_string("%d bridges of city", n_city.cast("int"))), F.when(F.coalesce(relation, F.lit("")) != "", F.concat(F.lit("texts call them "), relation)),
    ]
    return F.concat(F.coalesce(name, F.lit("?")), F.lit(": "), F.coalesce(F.nullif(F.concat_ws("; ", *parts), F.lit("")), F.lit("no evidence")), F.lit("."))


def pronouns(gender: Column) -> tuple[Column, Column]:
    """(subject, possessive) of a gender; they and their if it is unknown."""
    return F.when(gender == "woman", "she").when(gender == "man", "he").otherwise("they"), F.when(gender == "woman", "her").when(gender == "man", "his").otherwise("their")
