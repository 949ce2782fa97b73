"""Variant spellings of names typed by people: which records of an album mean the same person.

Each surface is read as given name and family name (parts may be reordered, abbreviated, titled, run together or torn
apart), nicknames are replaced by the names they stand for. Full names are points of a metric space; points within the
radius are found by the pivot join of ``metricjoin`` and verified by length and by how established both spellings are.
Records are connected through their points. Records without a full name (initials, a family or a given name alone) are then
tied to the person of their album that fits, if only one does.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from facetrail.llm.components import components
from facetrail.llm.metricjoin import cell_counts, radius_join
from facetrail.session import cut, spread

#: Nicknames and the names they stand for.
NICKNAMES = {
    "abby": "abigail", "gail": "abigail", "alex": "alexander", "al": "alexander", "sandy": "alexander", "andy": "andrew", "drew": "andrew", "annie": "anna", "tony": "anthony",
    "ben": "benjamin", "benny": "benjamin", "charlie": "charles", "chuck": "charles", "lottie": "charlotte", "charly": "charlotte", "chris": "christopher", "kit": "christopher", "topher": "christopher",
    "dan": "daniel", "danny": "daniel", "dave": "david", "debbie": "deborah", "deb": "deborah", "debby": "deborah", "lola": "dolores", "dolly": "dolores",
    "ned": "edward", "eddie": "edward", "ed": "edward", "ted": "theodore", "teddy": "theodore", "theo": "theodore", "nell": "eleanor", "nora": "eleanor", "ellie": "eleanor", "ella": "eleanor",
    "liz": "elizabeth", "beth": "elizabeth", "betty": "elizabeth", "lizzie": "elizabeth", "eliza": "elizabeth", "libby": "elizabeth", "betsy": "elizabeth", "lisa": "elizabeth",
    "paco": "francisco", "pancho": "francisco", "frank": "francis", "fred": "frederick", "freddie": "frederick", "freddy": "frederick", "fritz": "friedrich", "gabby": "gabriella", "gabi": "gabriella", "ella": "gabriella",
    "beppe": "giuseppe", "peppe": "giuseppe", "pino": "giuseppe", "greg": "gregory", "gwen": "gwendolyn", "hal": "harold", "harry": "harold", "bella": "isabella", "izzy": "isabella", "belle": "isabella",
    "jim": "james", "jimmy": "james", "jamie": "james", "hans": "johannes", "hannes": "johannes", "jack": "john", "johnny": "john", "josie": "josephine", "jo": "josephine", "fina": "josephine", "joe": "joseph",
    "kate": "katherine", "kathy": "katherine", "katie": "katherine", "kitty": "katherine", "kat": "katherine", "larry": "lawrence", "laurie": "lawrence", "len": "leonard", "lenny": "leonard", "leo": "leonard",
    "maggie": "margaret", "peggy": "margaret", "meg": "margaret", "greta": "margaret", "madge": "margaret", "rita": "margaret", "matt": "matthew", "mike": "michael", "mick": "michael", "mickey": "michael",
    "nick": "nicholas", "nicky": "nicholas", "klaus": "nicholas", "patty": "patricia", "pat": "patricia", "trish": "patricia", "tricia": "patricia", "penny": "penelope", "percy": "percival", "pete": "peter", "pippa": "philippa", "pip": "philippa",
    "ray": "raymond", "becky": "rebecca", "becca": "rebecca", "rick": "richard", "dick": "richard", "rich": "richard", "richie": "richard", "rob": "robert", "bob": "robert", "bobby": "robert", "robbie": "robert", "bert": "robert",
    "roz": "rosalind", "rosie": "rosalind", "sam": "samuel", "sammy": "samuel", "steve": "stephen", "sue": "susan", "sveta": "svetlana", "lana": "svetlana", "tadek": "tadeusz", "tim": "timothy", "timmy": "timothy", "tom": "thomas", "tommy": "thomas", "tomek": "tomasz",
    "uli": "ulrich", "val": "valerian", "vera": "veronique", "vicky": "victoria", "vic": "victoria", "tori": "victoria", "will": "william", "bill": "william", "billy": "william", "willy": "william", "liam": "william",
    "zach": "zachary", "zack": "zachary", "zak": "zachary", "bea": "beatriz", "aga": "agnieszka", "ximi": "ximena", "xave": "xaverine", "mandy": "amanda", "jen": "jennifer", "jenny": "jennifer", "jon": "jonathan", "nate": "nathaniel", "vince": "vincent", "walt": "walter",
}
#: Titles before a family name, before a given name, and generations after a name.
FORMAL = {"dr", "prof", "mr", "mrs", "ms", "miss", "herr", "frau", "mme", "mlle", "sr", "sra", "sir", "rev", "professor", "doctor"}
FAMILIAR = {"uncle", "aunt", "auntie", "nonna", "nonno", "oma", "opa", "tio", "tia", "tante", "onkel", "cousin", "coach", "grandma", "grandpa", "granny", "abuela", "abuelo", "papa", "mama", "brother", "sister", "big", "little", "old", "young"}
GENERATIONS = {"jr", "junior", "senior", "ii", "iii", "iv", "2nd", "3rd"}
#: Letters that don't come apart, and digits and signs read for letters.
LETTERS = str.maketrans({"ł": "l", "ø": "o", "đ": "d", "ß": "ss", "æ": "ae", "œ": "oe", "ı": "i", "þ": "th", "ð": "d"})
LOOKALIKES = str.maketrans("0134578@$", "oleastbas")

FULL, INITIAL, FAMILY, GIVEN = "F", "I", "L", "G"
#: Scripts whose signs are syllables or words, written without blanks, family name first.
SYLLABLES = re.compile("[\u3040-\u30ff\u3400-\u9fff\uac00-\ud7af\uf900-\ufaff]")


def plain(text: str) -> str:
    """Lower case letters of any script, without accents."""
    text = unicodedata.normalize("NFKD", text.lower().translate(LETTERS))
    text = "".join(c for c in text if not unicodedata.combining(c)).translate(LOOKALIKES)
    return text if text.isascii() and text.isalpha() else "".join(c for c in text if unicodedata.category(c) in ("Ll", "Lo"))


def words_of(surface: str) -> tuple[list[str], bool]:
    """Words of a surface in the order given, family, and whether that order was marked."""
    text = unicodedata.normalize("NFKC", surface).replace("’", "'").replace("`", "'").strip()
    m = re.fullmatch(r"(?i)the\s+(.+?)s?'s?\s+(.+)", text)
    if m:
        return [*m.group(2).split(), m.group(1)], True
    text = re.sub(r"[\"“”«»][^\"“”«»]*[\"“”«»]", " ", text)
    m = re.fullmatch(r"(.+?)\s*\(([^()]+)\)\s*", text)
    if m:
        return [*m.group(2).split(), *m.group(1).split()], True
    if text.count(",") == 1:
        a, b = (x.strip() for x in text.split(","))
        if a and b and plain(b) not in GENERATIONS:
            return [*b.split(), *a.split()], True
        text = f"{a} {b}"
    if " " not in text:
        m = re.fullmatch(r"(\w)\.(\w{3,})", text)
        if m:
            return [m.group(1) + ".", m.group(2)], True
        parts = re.findall(r"[^\W\d_][^A-ZÀ-ÖØ-ÞŠŽ]*(?:-[^\W\d_][^A-ZÀ-ÖØ-ÞŠŽ]*)*", text)
        if not text.isupper() and len(parts) == 2 and text[0].isupper() and all(len(p) > 2 for p in parts):
            return parts, True
        m = re.fullmatch(r"(\w{2,})[._](\w{3,})", text)
        if m:
            return [m.group(1), m.group(2)], True
    return text.split(), False


def read(surface: str | None) -> tuple[str, str, str, str] | None:
    """(kind, given, family, generation) of a surface, None if it has no name.

    Kind F has both names in full; I an initial or the beginning of the given name; L only a family name; G only a given
    name. Given names are those that nicknames stand for; of a double family name the first counts."""
    if not surface or not surface.strip():
        return None
    return _read_once(surface) if len(surface) < 200 else _read(surface)


def _read(surface: str) -> tuple[str, str, str, str] | None:
    words, marked = words_of(surface)
    if len(words) == 1 and 2 <= len(words[0]) <= 4 and all(map(SYLLABLES.match, words[0])):
        words, marked = [words[0][1:], words[0][0]], True
    # a single syllable sign is a name of its own
    least = lambda w, n: 1 if SYLLABLES.search(w) else n
    generation = formal = familiar = ""
    rest = []
    for w in words:
        bare = re.sub(r"[^a-z0-9]", "", unicodedata.normalize("NFKD", w.lower()))
        if bare in GENERATIONS and rest:
            generation = {"junior": "jr", "senior": "sr", "2nd": "ii", "3rd": "iii"}.get(bare, bare)
        elif bare == "sr" and len(rest) >= 2:
            generation = "sr"
        elif bare in FORMAL and not rest:
            formal = bare
        elif bare in FAMILIAR and not rest and len(words) > 1:
            familiar = bare
        else:
            rest.append(w)
    if not rest:
        return None
    short = lambda w: bool(re.fullmatch(r"(?:\w\.?){1,3}", w)) and (w.endswith(".") or len(w) == 1) and not SYLLABLES.match(w)
    if len(rest) == 1:
        name = plain(rest[0].split("-")[0] if len(rest[0].split("-")[0]) > 2 else rest[0])
        if len(name) < least(rest[0], 2):
            return None
        if formal and not familiar:
            return FAMILY, "", name, generation
        return GIVEN, NICKNAMES.get(name, name), "", generation
    # "Family I." has its initial last
    if not marked and short(rest[-1]) and not short(rest[0]):
        rest = [rest[-1], *rest[:-1]]
    first = rest[0]
    # initials between the names don't count; parts that were torn apart come together
    tail = [w for w in rest[1:] if not short(w)] or rest[-1:]
    head = plain(first)
    if len(tail) > 1 and not marked:
        lower = [w[:1].islower() for w in tail]
        if not (any(lower[1:]) and not lower[0]) and first[:1].isupper() and lower[0] and not short(first) and not first.isupper():
            # the given name itself was torn apart: "Ale xander Pendornak"
            head, tail = plain(first + tail[0]), tail[1:]
        elif not any(lower) or all(lower):
            tail = tail[-1:] if len(plain(tail[-1])) > 2 and all(len(plain(w)) > 3 for w in tail) else tail
    family = "".join(tail)
    family = plain(family.split("-")[0] if len(family.split("-")[0]) > 2 else family)
    if len(family) < least("".join(tail), 2) or not head:
        return None
    if short(first):
        return INITIAL, head[0], family, generation
    if first.endswith(".") and len(head) >= 2:
        return INITIAL, head, family, generation
    if len(head) < least(first, 2):
        return INITIAL, head, family, generation
    return FULL, NICKNAMES.get(head, head), family, generation


_read_once = lru_cache(100_000)(_read)


RADIUS = 2
#: A spelling is taken for a name of its own, not for an error, if at least so many albums have it and it is at least so
#: often met as a share of the other spelling.
ESTABLISHED, SHARE = 3, 0.5

READINGS = T.StructType([T.StructField(c, T.StringType()) for c in ("user_id", "rec", "kind", "given", "family", "generation")])


def records(clusters: DataFrame, persons: DataFrame) -> DataFrame:
    """(user_id, rec, surfaces, first_name, families): one row per cluster and registered person that names somebody.

    Clusters that only a sign or an organization gave are left out: flagged so, and without a family name."""
    noise = F.coalesce(F.arrays_overlap("quality_flags", F.array(F.lit("ocr_like"), F.lit("organization_like"))), F.lit(False)) & F.col("last_name_candidates").isNull()
    families = F.transform(F.sort_array(F.transform(F.map_entries(F.coalesce("last_name_candidates", F.create_map().cast("map<string,int>"))), lambda e: F.struct((-e["value"]).alias("n"), e["key"].alias("k")))), lambda s: s["k"])
    a = clusters.where(~noise).select("user_id", F.col("cluster_id").alias("rec"), F.concat(F.coalesce("surfaces", F.array().cast("array<string>")), F.array("primary_surface")).alias("surfaces"), "first_name", families.alias("families"))
    b = persons.select("user_id", F.col("person_id").alias("rec"), F.concat(F.array("canonical_name"), F.coalesce("accepted_aliases", F.array().cast("array<string>"))).alias("surfaces"), F.lit(None).cast("string").alias("first_name"), F.array().cast("array<string>").alias("families"))
    return a.unionByName(b).where("user_id is not null and rec is not null")


def surface_records(units: DataFrame, clusters: DataFrame) -> DataFrame:
    """Records of the distinct surfaces of an album's texts, as ``records`` gives them; their ids begin with '~'.

    Null and blank surfaces, and those that a cluster of the album flags as sign or organization, are left out."""
    noise = clusters.where(F.arrays_overlap("quality_flags", F.array(F.lit("ocr_like"), F.lit("organization_like"))) & F.col("last_name_candidates").isNull())
    none = noise.select("user_id", F.explode("surfaces").alias("s")).distinct()
    said = units.select("user_id", F.explode("person_surfaces").alias("s")).where("user_id is not null and trim(s) <> ''").distinct()
    return said.join(none, ["user_id", "s"], "left_anti").select("user_id", F.concat(F.lit("~"), F.col("s")).alias("rec"), F.array("s").alias("surfaces"), F.lit(None).cast("string").alias("first_name"), F.array().cast("array<string>").alias("families"))


def readings(recs: DataFrame) -> DataFrame:
    """READINGS of all records: kinds F, I, L, G as read from the surfaces and from the cluster's own columns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = set()
            for user, rec, surfaces, first, families in zip(*(c.to_pylist() for c in batch.columns)):
                got = {r for s in surfaces or [] if (r := read(s))}
                known = {r[2] for r in got if r[2]}
                given = read(first) if first and len(plain(first)) > 2 and not first.endswith(".") else None
                given = given[1] if given and given[0] == GIVEN and given[1] not in known | {r[1] for r in got if r[0] == INITIAL} else ""
                if given and not any(r[0] == FULL for r in got):
                    named = known or {f for x in (families or [])[:1] if not x.endswith((".", ")")) and len(f := plain(x.split("-")[0])) > 2 and f not in {r[1] for r in got}}
                    mark = next((r[3] for r in got if r[3]), "")
                    got |= {(FULL, given, f, mark) for f in named}
                for kind, g, f, mark in got:
                    out.add((user, rec, kind, g, f, mark))
            cols = list(zip(*sorted(out))) or [()] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in cols], names=READINGS.fieldNames())

    return spread(recs).select("user_id", "rec", "surfaces", "first_name", "families").mapInArrow(run, READINGS).distinct()


def sound(name: Column) -> Column:
    """Consonants of a name as they sound: spellings that only sound alike are never names of their own."""
    for pattern, to in (("ph", "f"), ("qu", "kv"), ("ck|c|q", "k"), ("ks", "x"), ("w", "v"), ("z", "s"), ("[aeiouyh]", ""), (r"(.)\1+", "$1")):
        name = F.regexp_replace(name, pattern, to)
    return name


def _same_name(found: DataFrame, full: DataFrame) -> DataFrame:
    """Pairs of points that may be one name: near enough in both parts for their lengths, and not two spellings that are both
    established as names of their own."""
    by_length = lambda a, b: F.expr(f"case when least(length({a}), length({b})) < 3 then 0 when least(length({a}), length({b})) < 5 then 1 else 2 end")
    pairs = found.where((F.col("dg") <= by_length("g1", "g2")) & (F.col("df") <= by_length("f1", "f2")))
    spelled = full.select("user_id", F.explode(F.array(*[F.struct(F.lit(p).alias("part"), F.col(p).alias("name")) for p in ("given", "family")])).alias("x"))
    met = cut(spelled.distinct().groupBy("x.part", "x.name").agg(F.count("*").alias("n")).where(f"n >= {ESTABLISHED}"))
    for part, one, two in (("given", "g1", "g2"), ("family", "f1", "f2")):
        for k, c in ((1, one), (2, two)):
            pairs = pairs.join(met.where(F.col("part") == part).select(F.col("name").alias(c), F.col("n").alias(f"{part}{k}")), c, "left")
    for part, one, two, d in (("given", "g1", "g2", "dg"), ("family", "f1", "f2", "df")):
        n1, n2 = F.col(f"{part}1"), F.col(f"{part}2")
        own = n1.isNotNull() & n2.isNotNull() & (F.least(n1, n2) >= F.lit(SHARE) * F.greatest(n1, n2))
        pairs = pairs.where((F.col(d) == 0) | ~own | (sound(F.col(one)) == sound(F.col(two))))
    return pairs.select("cell", "g1", "f1", "g2", "f2")


def joined(*parts) -> Column:
    return F.concat_ws("\x1e", *parts)


def full_space(full: DataFrame) -> DataFrame:
    """Points of full names: one space per album and generation."""
    return full.select(joined(F.lit("F"), "user_id", "generation").alias("cell"), "given", "family", F.lit(RADIUS).alias("radius")).distinct()


def pivot_figures(clusters: DataFrame, persons: DataFrame) -> DataFrame:
    """(cell, names, pivots, visits) of the spaces of full names, as ``cell_counts`` gives them."""
    return cell_counts(full_space(readings(records(clusters, persons)).where(F.col("kind") == FULL)).drop("radius"), RADIUS)


def same_person(clusters: DataFrame, persons: DataFrame, units: DataFrame | None = None) -> DataFrame:
    """(user_id, rec, person): the records that name somebody, with the least record of their person as its id.

    With ``units``, the distinct surfaces of the album's texts are records too, with '~' before the surface as their id.

    Null and blank surfaces are not read, records without a readable name are persons of their own; repeated rows count
    once; persons of different albums are different. Extra columns don't matter.

    Full names and, with radius 1, what records without one may be short for are joined in one radius join; components are
    found among the points of full names, not among records."""
    recs = records(clusters, persons)
    if units is not None:
        recs = recs.unionByName(surface_records(units, clusters))
    read_ = cut(readings(recs))
    full = read_.where(F.col("kind") == FULL)
    weak = read_.join(full.select("user_id", "rec").distinct(), ["user_id", "rec"], "left_anti")
    known = full.select("user_id", "given", "family", "generation").distinct()
    # what a weak reading may mean: names of the same album with a near family or the same given name
    form = lambda df, kind, given, family, *extra: df.select(joined(F.lit(kind), "user_id").alias("cell"), given.alias("g"), family.alias("f"), *extra)
    begin, none = F.substring("given", 1, 1), F.lit("")
    named = ["user_id", F.col("given").alias("whole"), "generation", "family"]
    targets = form(known, INITIAL, begin, F.col("family"), *named).unionByName(form(known, FAMILY, none, F.col("family"), *named)).unionByName(form(known, GIVEN, F.col("given"), none, *named))
    given = F.when(F.col("kind") == INITIAL, begin).when(F.col("kind") == FAMILY, none).otherwise(F.col("given"))
    asked = cut(weak.select(joined("kind", "user_id").alias("cell"), given.alias("g"), F.col("family").alias("f"), "user_id", "rec", "kind", F.col("given").alias("beginning"), F.col("generation").alias("mark")))
    targets = targets.join(asked.select("cell").distinct(), "cell", "left_semi")
    space = targets.select("cell", "g", "f").unionByName(asked.select("cell", "g", "f")).distinct().select("cell", F.col("g").alias("given"), F.col("f").alias("family"), F.lit(1).alias("radius"))
    found = radius_join(full_space(full).unionByName(space))
    is_full = F.col("cell").startswith(FULL + "\x1e")
    # persons of full names: components of points that are one name, or names of one record
    point = lambda g, f: joined("user_id", "generation", g, f)
    c = F.split("cell", "\x1e")
    pairs = _same_name(found.where(is_full), full).select(F.get(c, F.lit(1)).alias("user_id"), F.coalesce(F.get(c, F.lit(2)), F.lit("")).alias("generation"), "g1", "f1", "g2", "f2")
    of_record = full.groupBy("user_id", "rec").agg(F.array_sort(F.collect_set(point("given", "family"))).alias("p")).where("size(p) > 1")
    edges = pairs.select("user_id", point("g1", "f1").alias("u"), point("g2", "f2").alias("v")).unionByName(of_record.select("user_id", F.col("p")[0].alias("u"), F.explode("p").alias("v")))
    roots = components(edges, "user_id").select(F.col("node").alias("point"), "root")
    rooted = known.withColumn("point", point("given", "family")).join(roots, "point", "left").select("user_id", "given", "family", "generation", F.coalesce("root", "point").alias("root"))
    strong = full.join(rooted, ["user_id", "given", "family", "generation"]).groupBy("user_id", "rec").agg(F.min("root").alias("root"))
    # a form that several persons share stands for none of them: their least and greatest root tell
    meant = targets.join(rooted.withColumnRenamed("given", "whole"), ["user_id", "whole", "family", "generation"]).groupBy("cell", "g", "f", "whole", "generation").agg(F.min("root").alias("root"), F.max("root").alias("other"))
    close = found.where(~is_full & ((F.col("dg") == 0) | ~F.col("cell").startswith(INITIAL + "\x1e"))).withColumn("d", F.col("dg") + F.col("df"))
    turned = close.select("cell", F.col("g2").alias("g1"), F.col("f2").alias("f1"), F.col("g1").alias("g2"), F.col("f1").alias("f2"), "d")
    near = close.select("cell", "g1", "f1", "g2", "f2", "d").unionByName(turned)
    ask = asked.select("cell", F.col("g").alias("g1"), F.col("f").alias("f1"), "user_id", "rec", "kind", "beginning", "mark")
    met = ask.join(near, ["cell", "g1", "f1"]).drop("g1", "f1").unionByName(ask.withColumnsRenamed({"g1": "g2", "f1": "f2"}).withColumn("d", F.lit(0)))
    hits = met.withColumnsRenamed({"g2": "g", "f2": "f"}).join(meant, ["cell", "g", "f"]).where(f"generation = mark and (kind <> '{INITIAL}' or startswith(whole, beginning))")
    # the strongest kind of reading, then the nearest names; tied only if one person is left
    order = F.struct(F.when(F.col("kind") == INITIAL, 0).when(F.col("kind") == FAMILY, 1).otherwise(2).alias("k"), "d")
    best = hits.groupBy("user_id", "rec", order.alias("o")).agg(F.min("root").alias("root"), F.max("other").alias("other")).groupBy("user_id", "rec").agg(F.min_by(F.struct("root", "other"), "o").alias("b"))
    tied = best.where("b.root = b.other").select("user_id", "rec", "b.root")
    # weak records that read alike and fit nobody are one person
    alone = asked.where(F.col("kind") == INITIAL).groupBy("user_id", "rec").agg(F.min(joined(F.lit("~"), "user_id", "g", "f", "mark")).alias("alone"))
    every = strong.unionByName(alone.join(tied, ["user_id", "rec"], "full").select("user_id", "rec", F.coalesce("root", "alone").alias("root")))
    root = F.coalesce("root", joined(F.lit("!"), "user_id", "rec"))
    whole = cut(recs.select("user_id", "rec").distinct().join(every, ["user_id", "rec"], "left").select("user_id", "rec", root.alias("root")))
    least = whole.groupBy("user_id", "root").agg(F.min("rec").alias("person"))
    return whole.join(least, ["user_id", "root"]).select("user_id", "rec", "person")


def linked_records(clusters: DataFrame, persons: DataFrame) -> DataFrame:
    """(rec_a, rec_b) of all pairs of records of one album that mean the same person, rec_a < rec_b."""
    who = cut(same_person(clusters, persons))
    a, b = (who.select(F.col("user_id"), F.col("person"), F.col("rec").alias(x)) for x in ("rec_a", "rec_b"))
    return a.join(b, ["user_id", "person"]).where("rec_a < rec_b").select("rec_a", "rec_b").distinct()
