"""Profiles: name clusters, canonical names, relations, owner facts, evidence faithfulness, failure reasons, model calls."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from facetrail.functions.people import plausible_name
from facetrail.functions.text import fold, is_full_name, one_space
from facetrail.operators.albums import appearances, empty_list

#: Relations by priority, the first that a name's texts mention counts.
RELATION_PRIORITY = (
    "mother", "mom", "father", "dad", "wife", "husband", "spouse", "partner", "boyfriend", "girlfriend", "sister", "brother", "daughter", "son", "aunt", "auntie", "uncle", "cousin",
    "coworker", "co-worker", "colleague", "classmate", "neighbor", "close friend", "best friend", "friend", "friends",
)
#: Owner facts: name, terms that speak for it, photos and score needed, confidence to begin with.
OWNER_RULES = (
    ("gardens", ("gardening", "greenhouse", "seedlings"), 3, 4.0, 0.6),
    ("cycles", ("cycling", "bicycle", "bike"), 3, 4.0, 0.6),
    ("plays_music", ("choir", "guitar", "rehearsal", "band practice"), 3, 4.0, 0.55),
    ("celebrates", ("birthday", "wedding", "reunion", "graduation"), 3, 5.0, 0.5),
    ("climbs", ("climbing", "hiking", "summit"), 2, 3.0, 0.6),
    ("travels", ("train", "ferry", "airport", "road trip"), 3, 4.0, 0.5),
)


def surname_fits(a: str, b: str) -> bool:
    """Family names that may be one: equal, missing, or one the initial of the other."""
    a, b = a.strip("."), b.strip(".")
    return not a or not b or a == b or (len(a) == 1 and b.startswith(a)) or (len(b) == 1 and a.startswith(b))


def merge_surfaces(pdf: pd.DataFrame) -> pd.DataFrame:
    """Groups of the surfaces of one album and given name: the most frequent, then longest, leads all that fit it and have no
    leader yet, as ``surname_fits`` says. A surface without a family name joins
    the full names if there is only one group of them. Each surface is looked up by its family name and its initial, so the
    time is linear but for the sort."""
    full = pdf[pdf["is_full"]].sort_values(["n", "size", "surface"], ascending=[False, False, True])["surface"].tolist()
    last = {s: s.split()[-1].lower().strip(".") for s in full}
    by_name: dict[str, list[str]] = {}
    by_letter: dict[str, list[str]] = {}
    for s in full:
        by_name.setdefault(last[s], []).append(s)
        by_letter.setdefault(last[s][:1], []).append(s)
    leader: dict[str, str] = {}
    for s in full:
        if s not in leader:
            name = last[s]
            fitting = by_letter[name] if len(name) == 1 else by_name[name] + by_name.get(name[:1], [])
            for other in [s, *fitting]:
                leader.setdefault(other, s)
    leads = list(dict.fromkeys(leader[s] for s in full))
    for s in pdf.loc[~pdf["is_full"], "surface"]:
        leader[s] = leads[0] if len(leads) == 1 else s
    return pd.DataFrame({"user_id": pdf["user_id"], "first": pdf["first"], "surface": pdf["surface"], "leader": [leader[s] for s in pdf["surface"]], "n": pdf["n"]})


def near_given_names(names: DataFrame, least: float = 0.82, gap: float = 0.08) -> DataFrame:
    """(user_id, short, first): single names of four or more letters and the one given name of a full name that is like
    enough (matching-blocks ratio) and ahead of the next by ``gap``. names: (user_id, short, firsts array)."""

    @F.pandas_udf("string")
    def best(short: pd.Series, firsts: pd.Series) -> pd.Series:
        out = []
        for s, fs in zip(short, firsts):
            scored = sorted(((SequenceMatcher(None, s, f).ratio(), f) for f in fs if len(f) >= 4), reverse=True)
            scored = [x for x in scored if x[0] >= least]
            out.append(scored[0][1] if scored and len(s) >= 4 and (len(scored) == 1 or scored[0][0] - scored[1][0] >= gap) else None)
        return pd.Series(out, dtype=object)

    return names.select("user_id", "short", best("short", "firsts").alias("first")).where("first is not null")


def name_clusters(units: DataFrame) -> DataFrame:
    """(user_id, leader, surfaces, n_mentions, n_photos): surfaces of an album that share a given name and fit in surname.

    Only the distinct surfaces of one given name in one album meet in a group. A single name that is no given name of a full one
    goes to the only given name that is near enough to it (``near_given_names``). Signs, firms and words of places are no
    names (``plausible_name``)."""
    one = units.groupBy("user_id", "unit_id").agg(F.min("photo_id").alias("photo_id"), F.array_distinct(F.flatten(F.collect_list(F.coalesce("person_surfaces", empty_list())))).alias("names"))
    m = one.select("user_id", "photo_id", F.explode("names").alias("raw")).select("user_id", "photo_id", F.initcap(one_space(F.col("raw"))).alias("surface"))
    m = m.where(plausible_name(F.col("surface")))
    counted = m.groupBy("user_id", "surface").agg(F.count("*").alias("n")).withColumn("first", F.lower(F.split("surface", " ")[0])).withColumn("is_full", is_full_name(F.col("surface"))).withColumn("size", F.length("surface"))
    # single names near one given name of the album's full names count as that given name
    firsts = counted.where("is_full").groupBy("user_id").agg(F.collect_set("first").alias("firsts"))
    alone = counted.where("not is_full").select("user_id", F.col("first").alias("short")).distinct().join(firsts, "user_id").where(~F.array_contains("firsts", F.col("short")))
    near = near_given_names(alone).select("user_id", F.col("first").alias("__near"), F.col("short").alias("first"), F.lit(False).alias("is_full"))
    counted = counted.join(near, ["user_id", "first", "is_full"], "left").withColumn("first", F.coalesce("__near", "first")).drop("__near")
    led = counted.groupBy("user_id", "first").applyInPandas(merge_surfaces, "user_id string, first string, surface string, leader string, n long")
    return m.join(led.drop("n"), ["user_id", "surface"]).groupBy("user_id", "leader").agg(F.array_sort(F.collect_set("surface")).alias("surfaces"), F.count("*").alias("n_mentions"), F.count_distinct("photo_id").alias("n_photos"))


def canonical_names(clusters: DataFrame) -> DataFrame:
    """(cluster_id, canonical, name_source): a full primary surface as it is, else the given name with its most frequent
    family name (the last by name on ties), else the primary surface."""
    one = clusters.groupBy("cluster_id").agg(F.min("primary_surface").alias("p"), F.min("first_name").alias("f"), F.first("last_name_candidates", True).alias("m"))
    best = F.array_max(F.transform(F.map_entries("m"), lambda e: F.struct(e["value"].alias("n"), e["key"].alias("k"))))["k"]
    text, last = one_space(F.col("p")), best
    full = is_full_name(F.col("p"))
    source = F.when(full, "observed_full_name").when(last.isNotNull() & F.col("f").isNotNull(), "observed_first_plus_text_last").otherwise("observed_first_name")
    return one.select("cluster_id", F.when(source == "observed_first_plus_text_last", F.concat_ws(" ", "f", last)).otherwise(text).alias("canonical"), source.alias("name_source")).where("canonical is not null")


def relations_by_priority(clusters: DataFrame) -> DataFrame:
    """(cluster_id, relation): the relation of highest priority among a cluster's terms."""
    order = F.array(*map(F.lit, RELATION_PRIORITY))
    terms = clusters.select("cluster_id", F.explode("relation_terms").alias("t")).select("cluster_id", F.lower(F.trim("t")).alias("t")).distinct()
    ranked = terms.withColumn("k", F.array_position(order, F.col("t"))).where("k > 0")
    return ranked.groupBy("cluster_id").agg(F.min_by("t", "k").alias("relation"))


def owner_facts(units: DataFrame, photos: DataFrame, owners: DataFrame, rules=OWNER_RULES) -> DataFrame:
    """(user_id, fact, score, confidence, n_photos): facts about the owner whose terms enough texts mention.

    A text weighs 0.65 + 0.9 times its reference to the owner, + 1 with the owner's face, + 0.25 with visible text; its hits
    0.9 + 0.35 each, at most 1.8 more; + 0.8 with the face, + 0.35 with visible text. A photo counts with its best text, a
    fact with its best eight photos. Single words need word borders, phrases don't; all rules are matched in one pass."""
    has_owner = appearances(photos).join(owners.withColumnRenamed("owner_face", "face_id"), ["user_id", "face_id"]).select("user_id", "photo_id", F.lit(True).alias("face"))
    u = units.groupBy("user_id", "unit_id").agg(F.min("photo_id").alias("photo_id"), F.max(F.coalesce("owner_reference_score", F.lit(0.0))).alias("ref"), F.max(F.coalesce(F.size("visible_text"), F.lit(0)) > 0).alias("ocr"), F.concat_ws(" ", F.min(F.coalesce("caption", F.lit(""))), F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.concat(F.coalesce("activity_terms", empty_list()), F.coalesce("venue_terms", empty_list()))))))).alias("blob"))
    text = F.concat(F.lit(" "), F.regexp_replace(F.lower("blob"), "[^a-z0-9]+", " "), F.lit(" "))
    hit = lambda term: F.contains("__text", F.lit(f" {term} ")).cast("int")
    found = [F.struct(F.lit(name).alias("fact"), sum((hit(t) for t in terms), F.lit(0)).alias("hits"), F.lit(least).alias("min_photos"), F.lit(score).alias("min_score"), F.lit(base).alias("base")) for name, terms, least, score, base in rules]
    rows = u.join(has_owner, ["user_id", "photo_id"], "left").withColumn("face", F.coalesce("face", F.lit(False))).withColumn("__text", text).withColumn("r", F.explode(F.filter(F.array(*found), lambda s: s["hits"] > 0)))
    owner_score = 0.65 + 0.9 * F.col("ref") + F.when(F.col("face"), 1.0).otherwise(0.0) + F.when(F.col("ocr"), 0.25).otherwise(0.0)
    score = owner_score * (0.9 + F.least(F.lit(1.8), 0.35 * F.col("r.hits"))) + F.when(F.col("face"), 0.8).otherwise(0.0) + F.when(F.col("ocr"), 0.35).otherwise(0.0)
    best = rows.groupBy("user_id", "photo_id", "r.fact", "r.min_photos", "r.min_score", "r.base").agg(F.max(score).alias("score"))
    w = W.partitionBy("user_id", "fact").orderBy(F.col("score").desc(), "photo_id")
    n_all = best.groupBy("user_id", "fact").agg(F.count("*").alias("n_all"))
    top = best.withColumn("k", F.row_number().over(w)).where("k <= 8").groupBy("user_id", "fact", "min_photos", "min_score", "base").agg(F.sum("score").alias("score"), F.count("*").alias("n_photos"))
    kept = top.join(n_all, ["user_id", "fact"]).where("n_all >= min_photos and score >= min_score")
    return kept.select("user_id", "fact", F.round("score", 3).alias("score"), F.round(F.least(F.lit(0.88), F.col("base") + F.least(F.lit(0.12), 0.015 * F.col("n_photos"))), 3).alias("confidence"), "n_photos")


def owner_gender(face_units: DataFrame, owners: DataFrame) -> DataFrame:
    """(user_id, woman, man, gender): votes of the captions of the owner's photos; 'woman' on ties, null without votes."""
    word = lambda words: F.lower("caption").rlike(f"(^|[^a-z0-9_])({words})($|[^a-z0-9_])").cast("int")
    own = face_units.select("user_id", "face_id", "photo_id", "caption").distinct().join(owners.withColumnRenamed("owner_face", "face_id"), ["user_id", "face_id"])
    votes = own.groupBy("user_id").agg(F.coalesce(F.sum(word("woman|female|lady|her|she")), F.lit(0)).alias("woman"), F.coalesce(F.sum(word("man|male|gentleman|his|he")), F.lit(0)).alias("man"))
    return votes.withColumn("gender", F.when((F.col("woman") == 0) & (F.col("man") == 0), None).when(F.col("woman") >= F.col("man"), "woman").otherwise("man"))


def redacted(texts: DataFrame, names: DataFrame, text: str, key: str | None = None, mark: str = "[NAME]", allowed: DataFrame | None = None) -> DataFrame:
    """texts (user_id, ..) with the names of their album replaced at word borders, regardless of case, the longest first; a
    possessive stays one (someone's), runs of white space become single blanks.

    names: (user_id, name[, mark]). Only names whose first word the text has are tried on it: they meet by an equality join on
    album and word. ``key`` tells the texts of an album apart, by default their content does. ``allowed``: (user_id, key,
    allowed), texts whose names are left alone (those they hold, in lower case)."""
    if key is None:
        return redacted(texts.withColumn("__key", F.sha1(F.col(text))), names, text, "__key", mark).drop("__key")
    marked = names.withColumn("mark", F.lit(mark)) if "mark" not in names.columns else names
    first = lambda c: F.regexp_extract(F.lower(c), r"[\p{L}\p{N}_]+", 0)
    n = marked.select("user_id", F.trim("name").alias("name"), "mark", first(F.col("name")).alias("w")).where("w <> ''").groupBy("user_id", "name", "w").agg(F.min("mark").alias("mark"))
    words = texts.select("user_id", key, text).distinct().select("user_id", key, F.explode(F.array_distinct(F.regexp_extract_all(F.lower(F.col(text)), F.lit(r"[\p{L}\p{N}_]+"), F.lit(0)))).alias("w"))
    met = words.join(n, ["user_id", "w"])
    if allowed is not None:
        met = met.join(allowed.select("user_id", key, F.lower("allowed").alias("__allowed")), ["user_id", key], "left").where(~F.coalesce(F.contains("__allowed", F.lower("name")), F.lit(False)))
    order = F.struct((-F.length("name")).alias("n"), "name", "mark")
    of = met.groupBy("user_id", key).agg(F.array_sort(F.collect_set(order)).alias("__names"))
    out = texts.join(of, ["user_id", key], "left")
    quoted = lambda x: F.concat(F.lit(r"(?iu)(?<![\p{L}\p{N}_])\Q"), F.regexp_replace(x["name"], r"\\E", ""), F.lit(r"\E('s|’s)?(?![\p{L}\p{N}_])"))
    # the mark comes behind a sign that no text has, so that what has been replaced is not read again
    step = lambda acc, x: F.regexp_replace(F.regexp_replace(acc, F.concat(quoted(x), F.lit("(?<=['’]s)")), F.concat(F.lit("\u0001"), x["mark"], F.lit("'s"))), quoted(x), F.concat(F.lit("\u0001"), x["mark"]))
    done = F.aggregate("__names", one_space(F.col(text)), step)
    return out.withColumn(text, F.when(F.col("__names").isNull(), one_space(F.col(text))).otherwise(F.regexp_replace(done, "\u0001", ""))).drop("__names")


def faithfulness(kind: Column, correct: Column, value: Column, bound: Column, prediction: Column, n_ids: Column, all_known: Column, reasoning: Column, has_face: Column, anchored: Column) -> Column:
    """Score 0, 0.5 or 1 of how well cited photos carry a prediction: none without prediction, citations or where a cited
    photo is unknown; names need the face and a text or a reason; relations count once the identity is bound."""
    usable = (F.trim(F.coalesce(prediction, F.lit(""))) != "") & (n_ids > 0) & all_known
    why = F.trim(F.coalesce(reasoning, F.lit(""))) != ""
    fact = F.when(correct >= 1, F.when(why, 1.0).otherwise(0.5)).when(correct >= 0.5, 0.5).otherwise(0.0)
    name = F.when(correct < 1, 0.0).when(has_face & (anchored | why), 1.0).otherwise(0.5)
    other = F.when(bound, F.when(correct >= 1, F.when(has_face | why, 1.0).otherwise(0.5)).when(correct >= 0.5, 0.5).otherwise(0.0)).when(value > 0, 0.5).otherwise(0.0)
    return F.when(~usable, 0.0).when(kind == "owner_fact_atom", fact).when(kind == "person_name", name).when(kind.isin("person_relation", "person_category"), other).otherwise(0.0)


def call_model(requests: DataFrame, cache: DataFrame, client: Callable[[str], str], key: str = "key", prompt: str = "prompt") -> DataFrame:
    """(key, prompt, response, cached): each distinct request answered once, from the cache (key, response) if it is there.

    ``client`` is any callable from a prompt to a text and is called on the workers, in Arrow batches, for misses only. A
    request without a prompt is not sent and has a null response."""
    asked = requests.select(key, prompt).distinct()
    known = asked.join(cache.select(key, "response").dropDuplicates([key]), key).withColumn("cached", F.lit(True))
    missing = asked.join(cache.select(key).distinct(), key, "left_anti")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            b["response"] = [client(p) if isinstance(p, str) and p.strip() else None for p in b[prompt]]
            yield b

    fields = ", ".join(f"{c} {t}" for c, t in asked.dtypes)
    return known.unionByName(missing.mapInPandas(run, f"{fields}, response string").withColumn("cached", F.lit(False)))


def request_key(kind: str, *columns: str) -> Column:
    """Key of a request: SHA-1 of its kind and fields in order."""
    return F.sha1(F.to_json(F.struct(F.lit(kind).alias("kind"), *columns)))


def near_top(edges: DataFrame, within: float = 0.05, per_face: int = 4) -> DataFrame:
    """(user_id, name, n_faces, best): names that two or more faces of an album want, by each face's near-top candidates."""
    w = W.partitionBy("user_id", "face_id").orderBy(F.col("score").desc(), "name")
    top = F.first("score").over(w)
    wanted = edges.withColumn("top", top).withColumn("k", F.row_number().over(w)).where((F.col("k") <= per_face) & (F.col("score") >= F.col("top") - within))
    return wanted.groupBy("user_id", "name").agg(F.count_distinct("face_id").alias("n_faces"), F.max("score").alias("best")).where("n_faces >= 2")


def representative_photos(face_units: DataFrame, k: int = 5) -> DataFrame:
    """(user_id, face_id, rank, photo_id): photos that show a face best: with the owner, with text, with few others."""
    one = face_units.groupBy("user_id", "face_id", "photo_id").agg(F.max(F.coalesce("owner_present", F.lit(False)).cast("int")).alias("o"), F.max(F.least(F.coalesce(F.size("visible_text"), F.lit(0)), F.lit(3))).alias("v"), F.max((F.coalesce(F.size("co_faces"), F.lit(0)) <= 2).cast("int")).alias("s"), F.min(F.coalesce("timestamp", F.lit(""))).alias("ts"))
    w = W.partitionBy("user_id", "face_id").orderBy((2 * F.col("o") + F.greatest("v", F.lit(0)) + F.col("s")).desc(), "ts", "photo_id")
    return one.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("user_id", "face_id", "rank", "photo_id")
