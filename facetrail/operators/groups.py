"""Candidates of faces and the groups in which they are weighed against each other."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from facetrail.functions.claims import channels_of
from facetrail.operators import albums as A
from facetrail.session import cut, forget

FACE = ["user_id", "face_id"]


def face_flags(ranked: DataFrame) -> DataFrame:
    """(user_id, face_id, n_names, top, margin, n_near, ambiguous, priority, bonus) of faces with candidates.

    ranked: (user_id, face_id, name, score, rank). A face is ambiguous if its lead is under 0.16 or three of its first five
    names are within 0.12 of the first; with one name it is not. The priority is the first score and what the lead lacks of
    0.25; the bonus counts towards the groups that the face is in."""
    top = F.max(F.when(F.col("rank") == 1, F.col("score")))
    r = ranked.withColumn("__top", F.max("score").over(W.partitionBy(*FACE)))
    near = F.count_if((F.col("rank") <= 5) & (F.col("score") >= F.col("__top") - 0.12))
    a = r.groupBy(*FACE).agg(F.count("*").alias("n_names"), top.alias("top"), F.coalesce(F.max(F.when(F.col("rank") == 2, F.col("score"))), F.lit(0.0)).alias("second"), near.alias("n_near"))
    lead = F.round(F.greatest(F.lit(0.0), F.col("top") - F.col("second")), 9)
    a = a.withColumn("margin", lead).withColumn("ambiguous", (F.col("n_names") >= 2) & ((F.col("margin") < 0.16) | (F.col("n_near") >= 3)))
    bonus = F.greatest(F.lit(0.0), 0.22 - F.col("margin")) * 1.8 + F.least(F.lit(0.24), 0.04 * F.col("n_near"))
    return a.withColumn("priority", F.round(F.col("top") + F.greatest(F.lit(0.0), 0.25 - F.col("margin")), 9)).withColumn("bonus", F.round(bonus, 9)).drop("second")


def scene_groups(seen: DataFrame, owners: DataFrame, ranked: DataFrame, flags: DataFrame, persons: DataFrame, most_faces: int = 8, most_names: int = 12) -> DataFrame:
    """One group per photo with two faces or more that have candidates: (user_id, group_id, faces, names, priority).

    seen: (user_id, photo_id, face_id); persons: (user_id, photo_id, n_persons). The owner is left out, photos with more than
    ``most_faces`` faces too. Names are the first two of each face; those of more than ``most_names`` that more faces want, then
    with the better score, stay. The priority grows with faces, names, named persons and ambiguity."""
    faces = seen.join(owners.withColumnRenamed("owner_face", "face_id"), FACE, "left_anti").join(flags.select(*FACE, "bonus"), FACE)
    scenes = faces.groupBy("user_id", "photo_id").agg(F.array_sort(F.collect_set("face_id")).alias("faces"), F.sum("bonus").alias("bonus")).where(F.size("faces").between(2, most_faces))
    wanted = scenes.select("user_id", "photo_id", F.explode("faces").alias("face_id")).join(ranked.where("rank <= 2").select(*FACE, "name", "score"), FACE)
    each = wanted.groupBy("user_id", "photo_id", "name").agg(F.count("*").alias("n"), F.max("score").alias("best"))
    names = each.groupBy("user_id", "photo_id").agg(F.transform(F.slice(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("n"), (-F.col("best")).alias("b"), "name"))), 1, most_names), lambda s: s["name"]).alias("names"))
    g = scenes.join(names.where("size(names) >= 2"), ["user_id", "photo_id"]).join(persons, ["user_id", "photo_id"], "left")
    priority = 1.0 + 0.22 * F.size("faces") + 0.12 * F.size("names") + F.when(F.col("n_persons") >= 2, 0.28).otherwise(0.0) + F.col("bonus")
    return g.select("user_id", F.concat(F.lit("scene:"), F.col("photo_id")).alias("group_id"), "faces", F.array_sort("names").alias("names"), F.round(priority, 6).alias("priority"))


def pair_groups(seen: DataFrame, ranked: DataFrame, flags: DataFrame, most_photos: int = 10) -> DataFrame:
    """Two faces of an album that share photos and want the same names: (user_id, group_id, faces, names, priority, n_shared,
    n_photos).

    Pairs are made from the names that both have among their first five (an equality join on album and name), then the photos
    they share are counted; a pair with one common name only counts if one of its faces is ambiguous."""
    r = ranked.where("rank <= 5").select("user_id", "name", "face_id")
    both = r.withColumnRenamed("face_id", "a").join(r.withColumnRenamed("face_id", "b"), ["user_id", "name"]).where("a < b").groupBy("user_id", "a", "b").agg(F.count("*").alias("n_shared"))
    photos = seen.groupBy("user_id", "photo_id").agg(F.array_sort(F.collect_set("face_id")).alias("f")).where("size(f) > 1")
    i = photos.select("user_id", F.posexplode("f").alias("i", "a"), "f").select("user_id", "a", F.explode(F.slice("f", F.col("i") + 2, F.size("f"))).alias("b"))
    shown = i.groupBy("user_id", "a", "b").agg(F.count("*").alias("n_photos"))
    fl = lambda c: flags.where("n_names >= 2").select("user_id", F.col("face_id").alias(c), F.col("ambiguous").alias(f"amb_{c}"), F.col("bonus").alias(f"bonus_{c}"))
    p = both.join(shown, ["user_id", "a", "b"]).join(fl("a"), ["user_id", "a"]).join(fl("b"), ["user_id", "b"]).where("n_shared >= 2 or amb_a or amb_b")
    first = ranked.where("rank <= 4").groupBy(*FACE).agg(F.collect_set("name").alias("names"))
    own = lambda c: first.select("user_id", F.col("face_id").alias(c), F.col("names").alias(f"names_{c}"))
    p = p.join(own("a"), ["user_id", "a"]).join(own("b"), ["user_id", "b"])
    priority = 2.55 + 0.26 * F.col("n_shared") + F.least(F.lit(0.45), 0.08 * F.col("n_photos")) + F.col("bonus_a") + F.col("bonus_b")
    return p.select(
        "user_id", F.concat_ws(":", F.lit("pair"), "a", "b").alias("group_id"), F.array("a", "b").alias("faces"), F.array_sort(F.array_union("names_a", "names_b")).alias("names"), F.round(priority, 6).alias("priority"), "n_shared", F.least("n_photos", F.lit(most_photos)).alias("n_photos")
    )


def name_conflicts(ranked: DataFrame, within: float = 0.05) -> DataFrame:
    """Names that two faces or more want among those near their first: (user_id, group_id, faces, names, priority)."""
    top = ranked.withColumn("__top", F.max("score").over(W.partitionBy(*FACE))).where((F.col("rank") <= 4) & (F.col("score") >= F.col("__top") - within))
    g = top.groupBy("user_id", "name").agg(F.array_sort(F.collect_set("face_id")).alias("faces"), F.max("score").alias("best")).where("size(faces) >= 2")
    return g.select("user_id", F.concat(F.lit("name:"), F.col("name")).alias("group_id"), "faces", F.array("name").alias("names"), F.round(1.4 + 0.2 * F.size("faces") + F.col("best"), 6).alias("priority"))


def overlap(a: Column, b: Column) -> Column:
    """Common values over the smaller list."""
    return F.size(F.array_intersect(a, b)) / F.greatest(F.least(F.size(a), F.size(b)), F.lit(1))


def suppress_overlaps(groups: DataFrame, least_faces: float = 0.7, least_names: float = 0.45, most_rounds: int = 100) -> DataFrame:
    """Groups (user_id, group_id, faces, names, priority) without those that overlap with a kept one of higher priority.

    Taking groups in turn, the greatest priority first (the smaller id of equals), is found for all albums at once, in rounds:
    a group that no open group before it overlaps is kept, and what it overlaps is dropped. Only groups that share a face are
    compared; each round is written and the one before deleted."""
    g = cut(groups.select("user_id", "group_id", "faces", "names", "priority"))
    order = lambda c: F.struct((-F.col(f"{c}priority")).alias("p"), F.col(f"{c}group_id").alias("g"))
    # a pair meets at the least face it shares
    by_face = g.select("user_id", F.explode("faces").alias("face"), "group_id", "faces", "names", "priority")
    right = by_face.select("user_id", "face", *[F.col(c).alias(f"x_{c}") for c in ("group_id", "faces", "names", "priority")])
    meet = by_face.join(right, ["user_id", "face"]).where(order("") < order("x_")).where(F.col("face") == F.array_min(F.array_intersect("faces", "x_faces")))
    pairs = cut(meet.where((overlap(F.col("faces"), F.col("x_faces")) >= least_faces) & (overlap(F.col("names"), F.col("x_names")) >= least_names)).select("user_id", "group_id", F.col("x_group_id").alias("later")))
    left, kept = pairs, None
    dropped = pairs.select("user_id", "group_id").where("false")
    for _ in range(most_rounds):
        if left.isEmpty():
            break
        # open groups with none before them are kept; what they overlap is dropped, with all its pairs
        firm = left.select("user_id", "group_id").distinct().join(left.select("user_id", F.col("later").alias("group_id")), ["user_id", "group_id"], "left_anti")
        out = cut(left.join(firm, ["user_id", "group_id"]).select("user_id", F.col("later").alias("group_id")).distinct())
        dropped = dropped.unionByName(out)
        later = left.join(out, ["user_id", "group_id"], "left_anti").join(out.withColumnRenamed("group_id", "later"), ["user_id", "later"], "left_anti").join(firm, ["user_id", "group_id"], "left_anti")
        now = cut(later)
        if kept is not None:
            forget(kept)
        left = kept = now
    else:
        raise RuntimeError("the groups did not settle")
    return g.join(dropped, ["user_id", "group_id"], "left_anti")


def reserved_first(df: DataFrame, groups: list[str], order: list[Column], special: Column, k: int, reserve: int) -> DataFrame:
    """The first k rows of each group, ``reserve`` of them special ones if there are so many: the last others give way.

    Adds ``place``, from 1: others keep their order, special rows taken in come last."""
    w = W.partitionBy(*groups).orderBy(*order)
    r = df.withColumn("__r", F.row_number().over(w)).withColumn("__s", special)
    r = r.withColumn("__sr", F.row_number().over(W.partitionBy(*groups, "__s").orderBy("__r")))
    r = r.where((F.col("__r") <= k) | (F.col("__s") & (F.col("__sr") <= reserve)))
    g = W.partitionBy(*groups)
    inside = F.count_if(F.col("__s") & (F.col("__r") <= k)).over(g)
    taken = F.greatest(inside, F.least(F.count_if("__s").over(g), F.lit(reserve)))
    r = r.withColumn("__keep", F.when(F.col("__s"), (F.col("__r") <= k) | (F.col("__sr") <= taken)).otherwise(F.col("__sr") <= k - taken))
    return r.where("__keep").withColumn("place", F.row_number().over(W.partitionBy(*groups).orderBy((F.col("__r") > k).asc(), "__r"))).drop("__r", "__s", "__sr", "__keep")


def broadened(ranked: DataFrame, recall: Column, k: int, more: int = 3, least: float = 0.28) -> DataFrame:
    """The first k names of every face, then up to ``more`` others by ``recall`` of ``least`` or more; in order of score again."""
    r = ranked.withColumn("__recall", recall)
    extra = r.where((F.col("rank") > k) & (F.col("__recall") >= least)).withColumn("__x", F.row_number().over(W.partitionBy(*FACE).orderBy(F.col("__recall").desc(), F.col("score").desc(), "name"))).where(F.col("__x") <= more).drop("__x")
    both = r.where(F.col("rank") <= k).unionByName(extra)
    return both.withColumn("place", F.row_number().over(W.partitionBy(*FACE).orderBy(F.col("score").desc(), "name"))).drop("__recall")


def channel_scores(face_units: DataFrame, features: DataFrame) -> DataFrame:
    """(user_id, face_id, channel, score): channels of social life of every face: 1 for a unit whose terms speak for it, 0.65
    for one whose photo's event features do. features: (user_id, photo_id, channels)."""
    none = A.empty_list()
    low = lambda c: F.transform(F.coalesce(F.col(c), none), lambda x: F.lower(x))
    u = face_units.select("user_id", "face_id", "photo_id", channels_of(F.array_compact(F.concat(low("relation_terms"), low("activity_terms"), low("venue_terms")))).alias("c")).groupBy("user_id", "face_id", "photo_id").agg(F.min("c").alias("c"))
    said = u.select("user_id", "face_id", F.explode("c").alias("channel"), F.lit(1.0).alias("s"))
    shown = u.select("user_id", "face_id", "photo_id").join(features, ["user_id", "photo_id"]).select("user_id", "face_id", F.explode("channels").alias("channel"), F.lit(0.65).alias("s"))
    return said.unionByName(shown).groupBy("user_id", "face_id", "channel").agg(F.round(F.sum("s"), 6).alias("score"))


def applied(ranked: DataFrame, chosen: DataFrame, boost: float = 0.08, demote: float = 0.05) -> DataFrame:
    """ranked (user_id, face_id, name, score) after a decision: a chosen name's score is raised to its confidence at least and by
    ``boost``, that of the face's other names lowered by ``demote``, and of the name at other faces too; ranks and margins anew.

    chosen: (user_id, face_id, name, confidence). A choice is not applied if its name is none of the face's candidates, if its
    confidence is under 0.55, or if another face with more confidence (the smaller id of equals) is given the name."""
    valid = chosen.where("confidence >= 0.55").join(ranked.select(*FACE, "name"), [*FACE, "name"], "left_semi")
    one = valid.withColumn("__k", F.row_number().over(W.partitionBy("user_id", "name").orderBy(F.col("confidence").desc(), "face_id"))).where("__k = 1")
    one = one.withColumn("__j", F.row_number().over(W.partitionBy(*FACE).orderBy(F.col("confidence").desc(), "name"))).where("__j = 1").select(*FACE, "name", "confidence")
    r = ranked.select(*FACE, "name", "score").join(one.select(*FACE, F.col("name").alias("__name"), "confidence"), FACE, "left").join(one.select("user_id", "name", F.col("face_id").alias("__face")), ["user_id", "name"], "left")
    score = (
        F.when(F.col("__name") == F.col("name"), F.greatest(F.col("score") + boost, F.col("confidence"))).when(F.col("__name").isNotNull(), F.col("score") - demote)
        .when(F.col("__face").isNotNull() & (F.col("__face") != F.col("face_id")), F.col("score") - demote).otherwise(F.col("score"))
    )
    out = r.select(*FACE, "name", F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), score)), 6).alias("score"), F.coalesce(F.col("__name") == F.col("name"), F.lit(False)).alias("chosen"))
    return A.with_margin(out, FACE, "name")
