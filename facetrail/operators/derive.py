"""Derivations: names, places, phrases, signatures, entities, visible faces, targets, slots, dates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from facetrail.functions.text import fold, one_space, query_terms
from facetrail.operators.albums import appearances

#: Particles that stay in lower case, relations written before a name, kinds of entities.
PARTICLES = ("de", "del", "dela", "van", "von", "da", "di")
RELATION_WORDS = ("aunt", "auntie", "uncle", "cousin", "mom", "mother", "dad", "father", "grandma", "grandpa", "grandmother", "grandfather", "sister", "brother")
ENTITY_KINDS, ENTITY_SOURCES = ("person", "organization", "location", "event"), ("caption", "visible_text")


def written_name(c: Column) -> Column:
    """A name as it is written out: signs around it and a trailing remark in brackets dropped, particles in lower case,
    initials in upper case, other words with a capital after each hyphen and apostrophe. Parts of a word with digits, quotes
    or other signs stay as they are written."""
    text = F.regexp_replace(one_space(c), r"^[#@\-\s:]+", "")
    text = F.regexp_replace(F.regexp_replace(text, r"\s+\([^)]+\)$", ""), r"^[ ,.;:!?]+|[ ,.;:!?]+$", "")
    piece = lambda p: F.when(p.rlike(r"^[\p{L}.,()]*[-']?$"), F.concat(F.upper(F.substring(p, 1, 1)), F.lower(F.substring(p, F.lit(2), F.length(p))))).otherwise(p)
    # hyphens and apostrophes are kept by marking the place behind them
    parts = lambda w: F.array_join(F.transform(F.split(F.regexp_replace(w, "([-'])", "$1\u0001"), "\u0001"), piece), "")
    word = lambda w: F.when(F.lower(w).isin(*PARTICLES), F.lower(w)).when(w.rlike(r"^[A-Za-z]\.$"), F.upper(w)).otherwise(parts(w))
    return F.array_join(F.transform(F.split(text, " "), word), " ")


def without_relation(c: Column) -> tuple[Column, Column]:
    """(name, relation): a relation written before a name taken off, null if there is none."""
    words = F.split(one_space(c), " ")
    first = F.regexp_replace(F.lower(words[0]), r"^\.+|\.+$", "")
    has = (F.size(words) >= 2) & first.isin(*RELATION_WORDS)
    return F.when(has, F.array_join(F.slice(words, F.lit(2), F.size(words)), " ")).otherwise(F.array_join(words, " ")), F.when(has, first)


def place_parts(c: Column, home: Column) -> tuple[Column, Column]:
    """(city, place) of a written place: the city is the part after the last comma, else ``home``."""
    text = one_space(c)
    parts = F.filter(F.transform(F.split(text, ","), lambda x: F.trim(x)), lambda x: x != "")
    empty = F.coalesce(text, F.lit("")) == ""
    return F.when(empty, home).when(F.size(parts) >= 2, F.element_at(parts, -1)).otherwise(home), F.when(empty, home).otherwise(text)


def phrases(c: Column, most: int = 8) -> Column:
    """Distinct runs of two to five words of a text, in order, that hold two or more terms; lower case."""
    runs = F.transform(F.regexp_extract_all(c, F.lit(r"[A-Za-z0-9][A-Za-z0-9'&.-]*(?:[ \t\n]+[A-Za-z0-9][A-Za-z0-9'&.-]*){1,4}"), F.lit(0)), lambda x: F.lower(x))
    return F.slice(F.array_distinct(F.filter(runs, lambda r: F.size(query_terms(r)) >= 2)), 1, most)


def signature(c: Column) -> Column:
    """Key of what a fact says: facts on name, age, birth and home count as one each, others by their words."""
    low = F.lower(one_space(c))
    words = F.trim(F.regexp_replace(low, "[^a-z0-9]+", " "))
    has = lambda p: F.concat(F.lit(" "), words, F.lit(" ")).rlike(p)
    return F.when(words == "", "").when(has(" name "), "owner_name").when(has(" [0-9]{2} years old "), "owner_age").when(has(" (birth year|date of birth|born) "), "owner_birth").when(has(" (based in|lives in|living in) "), "owner_base").otherwise(words)


def clean_entities(c: Column) -> Column:
    """Entities with a surface and a known source; unknown kinds count as persons."""
    e = F.transform(c, lambda x: F.struct(F.trim(x["surface"]).alias("surface"), F.when(F.trim(x["entity_type"]).isin(*ENTITY_KINDS), F.trim(x["entity_type"])).otherwise("person").alias("entity_type"), F.trim(x["source"]).alias("source")))
    return F.filter(e, lambda x: (x["surface"] != "") & x["source"].isin(*ENTITY_SOURCES))


def visible_faces(required: Column, optional: Column, visibility: Column, framing: Column) -> Column:
    """Faces shown on a planned photo: none, the required ones, or some of the optional ones too by the framing."""
    req, opt = (F.array_distinct(F.array_compact(F.coalesce(c, F.array().cast("array<string>")))) for c in (required, optional))
    extra = F.when(framing == "group", 2).when(framing == "pair", 1).when(F.size(req) == 0, 1).otherwise(0)
    none = F.array().cast("array<string>")
    seen = F.lower(F.trim(F.coalesce(visibility, F.lit("medium"))))
    return F.when(seen == "none", none).when(seen == "weak", req).otherwise(F.array_distinct(F.concat(req, F.slice(opt, F.lit(1), extra))))


def faces_in_words(faces: Column) -> Column:
    n = F.size(faces)
    owner = F.array_contains(faces, "owner")
    return (
        F.when(n <= 0, "no clearly identifiable face is visible").when((n == 1) & owner, "the owner is the only clearly identifiable person").when(n == 1, "one clearly identifiable recurring person is visible")
        .when((n == 2) & owner, "the owner and one other clearly identifiable person are visible").otherwise(F.concat(n.cast("string"), F.lit(" clearly identifiable people are visible")))
    )


def month_number(c: Column) -> Column:
    """Months since year 0 of a ``yyyy-mm`` text, 0 if it is none."""
    return F.coalesce(F.substring(c, 1, 4).try_cast("int") * 12 + F.substring(c, 6, 2).try_cast("int"), F.lit(0))


def device_at(months: DataFrame, plan: DataFrame, month: str = "year_month") -> DataFrame:
    """months (user_id, month, ...) with the device in force: of the plan's upgrades (user_id, ord, from_month, device) not
    later than the month, the last in the list. A range join on the album's few upgrades."""
    p = plan.select("user_id", "ord", month_number(F.col("from_month")).alias("from"), "device")
    rows = months.withColumn("__m", month_number(F.col(month))).withColumn("__row", F.struct(*months.columns))
    hit = rows.join(p, "user_id").where("from <= __m").groupBy("__row").agg(F.max_by("device", "ord").alias("device"))
    return rows.join(hit, "__row", "left").select(*months.columns, "device")


def mention_difficulty(mentions: DataFrame, photos: DataFrame, nodes: DataFrame) -> DataFrame:
    """mentions (user_id, photo_id, face_id, ...) with ``difficulty``: easy if the face is on the photo of the mention, medium
    if it is on another photo of the same event, hard otherwise."""
    seen = appearances(photos)
    same = seen.withColumn("here", F.lit(True))
    of = nodes.select("user_id", "event_id", F.explode("photo_ids").alias("photo_id")).distinct()
    near = of.join(seen, ["user_id", "photo_id"]).select("user_id", "event_id", "face_id").distinct().join(of, ["user_id", "event_id"]).select("user_id", "photo_id", "face_id").distinct().withColumn("near", F.lit(True))
    out = mentions.join(same, ["user_id", "photo_id", "face_id"], "left").join(near, ["user_id", "photo_id", "face_id"], "left")
    return out.withColumn("difficulty", F.when(F.col("here"), "easy").when(F.col("near"), "medium").otherwise("hard")).drop("here", "near")


def slots(events: DataFrame, wanted: str, have: str) -> DataFrame:
    """One row per photo still to be planned of an event: ``slot`` from 1 to wanted - have."""
    missing = F.greatest(F.coalesce(F.col(wanted), F.lit(0)) - F.coalesce(F.col(have), F.lit(0)), F.lit(0)).cast("int")
    return events.withColumn("__n", missing).where("__n > 0").withColumn("slot", F.explode(F.sequence(F.lit(1), F.col("__n")))).drop("__n")


def best_text(texts: Column, terms: Column) -> Column:
    """The text of a list with the most terms, the first of equals; null if none has one."""
    scored = F.transform(texts, lambda t, i: F.struct((-F.size(F.array_intersect(query_terms(t), terms))).alias("k"), i.alias("i"), t.alias("t")))
    return F.array_min(F.filter(scored, lambda s: s["k"] < 0))["t"]


def birth_dates(units: DataFrame) -> DataFrame:
    """(user_id, year, month, day): the birth date that an album's texts give, full dates and texts on the owner first."""
    text = F.concat_ws("\n", "caption", "visible_text")
    date = r"(?i)(?:date of birth|dob|birth date)[: \t\n]*([01]?[0-9])[/-]([0-3]?[0-9])[/-]((?:19|20)[0-9]{2})"
    year = r"(?i)(?:born|birth year|year of birth)[: \t\n]*(?:in[ \t\n]*)?((?:19|20)[0-9]{2})"
    part = lambda p, k: F.nullif(F.regexp_extract("t", p, k), F.lit("")).cast("int")
    r = units.select("user_id", "unit_id", F.coalesce("owner_reference_score", F.lit(0.0)).alias("ref"), text.alias("t"))
    r = r.select("user_id", "unit_id", "ref", part(date, 3).alias("y1"), part(date, 1).alias("m"), part(date, 2).alias("d"), part(year, 1).alias("y2")).where("y1 is not null or y2 is not null")
    rank = F.struct((-(F.when(F.col("y1").isNotNull(), 2.0).otherwise(1.0) + F.col("ref"))).alias("s"), "unit_id")
    return r.groupBy("user_id").agg(F.min_by(F.struct(F.coalesce("y1", "y2").alias("year"), F.when(F.col("y1").isNotNull(), F.col("m")).alias("month"), F.when(F.col("y1").isNotNull(), F.col("d")).alias("day")), rank).alias("b")).select("user_id", "b.*")


def age_at(year: Column, month: Column, day: Column, on: Column) -> Column:
    """Age on a date, less one before the birthday; null outside 1..119."""
    before = F.coalesce(F.struct(F.month(on), F.dayofmonth(on)) < F.struct(month, day), F.lit(False)) & month.isNotNull() & day.isNotNull()
    age = F.year(on) - year - before.cast("int")
    return F.when((age > 0) & (age < 120), age)


def days_apart(a: Column, b: Column) -> Column:
    """Whole days between two instants in microseconds, counted down before they are made positive; 99999 if one is missing."""
    return F.coalesce(F.abs(F.floor((a - b) / 86_400_000_000)), F.lit(99999))


def canonical_terms(df: DataFrame, text: str, synonyms: DataFrame) -> DataFrame:
    """df with ``canonical``: the canonical term of the longest phrase of ``synonyms`` (phrase, canonical) in the folded text
    at word borders, else the folded text. Distinct texts are looked up once, by an equality join on a phrase's first word."""
    key = F.sha1(F.coalesce(F.col(text), F.lit("")))
    d = df.withColumn("__f", fold(F.coalesce(F.col(text), F.lit("")))).withColumn("__k", key)
    # phrases of any number of words meet the text on their first word
    known = synonyms.select(fold(F.col("phrase")).alias("phrase"), "canonical").where("phrase <> ''").distinct().select("phrase", "canonical", F.split("phrase", " ")[0].alias("first"))
    each = d.select("__k", "__f").distinct().select("__k", "__f", F.explode(F.array_distinct(F.split("__f", " "))).alias("first"))
    within = F.contains(F.concat(F.lit(" "), F.col("__f"), F.lit(" ")), F.concat(F.lit(" "), F.col("phrase"), F.lit(" ")))
    best = each.join(known, "first").where(within).groupBy("__k").agg(F.min_by("canonical", F.struct((-F.length("phrase")).alias("n"), "phrase")).alias("__c"))
    return d.join(best, "__k", "left").withColumn("canonical", F.coalesce("__c", "__f")).drop("__k", "__f", "__c")
