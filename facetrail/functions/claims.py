"""Predicates and lexicons on texts: claims, details, relations, activities, venues, event features, entities."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from facetrail.functions import lexicons as L
from facetrail.functions.text import one_space


def hedged(text: Column) -> Column:
    """Whether a claim is hedged, holds contact data, or speaks of somebody else than the owner."""
    low = F.lower(text)
    found = F.lit(False)
    for p in L.HEDGES:
        found = found | low.rlike(p)
    return F.coalesce(found, F.lit(False))


def specific_detail(caption: Column, texts: Column) -> Column:
    """Whether a photo's texts name something: a capitalised word in the caption, an hour, a telling thing."""
    blob = F.lower(F.concat_ws(" ", caption, texts))
    return F.coalesce(caption.rlike(L.DETAIL_NAMES), F.lit(False)) | blob.rlike(L.DETAIL_HOURS) | blob.rlike(rf"\b({'|'.join(L.DETAIL_WORDS)})\b")


def broad_clothing(fact: Column) -> Column:
    return F.coalesce(F.lower(fact).rlike(rf"\b({'|'.join(L.BROAD_CLOTHING)})\b"), F.lit(False))


def home_like(place: Column) -> Column:
    return F.coalesce(F.lower(place).rlike("|".join(L.HOME_PLACES)), F.lit(False))


def terms_in(text: Column, lexicon) -> Column:
    """Terms of a lexicon in a text, the longest first: single words at word borders, phrases anywhere.

    One pattern finds all single words in one pass; each phrase is looked for by itself."""
    low = F.lower(one_space(F.coalesce(text, F.lit(""))))
    single = [t for t in lexicon if " " not in t]
    phrases = [t for t in lexicon if " " in t]
    # words with a hyphen or an apostrophe also count as their first part, as at any word border
    plain = [t for t in single if re.fullmatch(r"\w+", t)]
    found = F.array_intersect(F.regexp_extract_all(low, F.lit(r"[\p{L}\p{N}_]+"), F.lit(0)), F.array(*map(F.lit, plain)))
    odd = [F.when(low.rlike(rf"\b{re.escape(t)}\b"), F.lit(t)) for t in single if t not in plain]
    more = [F.when(F.contains(low, F.lit(t)), F.lit(t)) for t in phrases]
    every = F.concat(found, F.array_compact(F.array(*odd, *more))) if odd or more else found
    keyed = F.array_sort(F.transform(every, lambda t: F.struct((-F.length(t)).alias("n"), t.alias("t"))))
    return F.transform(keyed, lambda s: s["t"])


def relation_terms(text: Column) -> Column:
    return terms_in(text, L.RELATIONS)


def activity_terms(text: Column) -> Column:
    return terms_in(text, L.ACTIVITIES)


def venue_terms(text: Column) -> Column:
    return terms_in(text, L.VENUES)


def relation_value(term: Column) -> tuple[Column, Column]:
    """(relation, category) that a written relation means, '' if it means none."""
    pick = lambda k: F.coalesce(F.create_map(*[F.lit(x) for t, v in L.RELATIONS.items() for x in (t, v[k])])[F.lower(term)], F.lit(""))
    return pick(0), pick(1)


def owner_reference(text: Column) -> Column:
    """How much a text refers to the owner: the weights of the terms it holds, 6 at most."""
    low = F.lower(one_space(F.coalesce(text, F.lit(""))))
    total = F.lit(0.0)
    for t, w in L.OWNER_REFERENCES.items():
        total = total + F.when(F.contains(low, F.lit(t)), w).otherwise(0.0)
    return F.round(F.least(total, F.lit(6.0)), 6)


def channels_of(terms: Column) -> Column:
    """Channels of social life that terms speak for, by name."""
    found = [F.when(F.arrays_overlap(terms, F.array(*map(F.lit, words))), F.lit(c)) for c, words in sorted(L.CHANNEL_TERMS.items())]
    return F.array_compact(F.array(*found))


def event_features(text: Column) -> tuple[Column, Column]:
    """(terms, channels) of an event from a photo's texts: its words that are event terms, and those that phrases stand for."""
    low = F.lower(F.coalesce(text, F.lit("")))
    long = [t for t in L.EVENT_TERMS if len(t) >= 4]
    single = F.array_intersect(F.regexp_extract_all(low, F.lit("[a-z][a-z0-9'_-]*"), F.lit(0)), F.array(*map(F.lit, long)))
    none = F.array().cast("array<string>")
    by_phrase = [F.when(F.contains(low, F.lit(p)), F.array(*map(F.lit, terms)) if terms else none).otherwise(none) for p, (_, terms) in L.PHRASE_CHANNELS.items()]
    terms = F.array_sort(F.array_distinct(F.concat(single, *by_phrase)))
    named = F.array_compact(F.array(*[F.when(F.contains(low, F.lit(p)), F.lit(c)) for p, (c, _) in L.PHRASE_CHANNELS.items()]))
    return terms, F.array_sort(F.array_distinct(F.concat(named, channels_of(terms))))


ENTITY = r"\b(?:[A-Z][a-z]+['’]s|[A-Z][a-z]+)(?:\s+(?:[A-Z][a-z]+['’]s|[A-Z][a-z]+)){1,3}\b"


def entity_kind(surface: Column) -> Column:
    holds = lambda marks: surface.rlike("|".join(marks))
    return F.when(holds(L.ORGANIZATION_MARKS), "organization").when(holds(L.EVENT_MARKS), "event").when(holds(L.LOCATION_MARKS), "location").otherwise("person")


def capitalised_entities(text: Column) -> Column:
    """(surface, entity_type) of runs of two to four capitalised words, in order, each once, by the words they hold."""
    runs = F.array_distinct(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(ENTITY), F.lit(0)))
    kept = F.filter(runs, lambda s: ~F.split(s, r"\s+")[0].isin(*L.NO_ENTITY_STARTS))
    return F.transform(kept, lambda s: F.struct(s.alias("surface"), entity_kind(s).alias("entity_type")))
