"""Predicates on names and on candidates for a face, as JVM expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from facetrail.functions import lexicons as L
from facetrail.functions.text import is_full_name, one_space


def words(c: Column) -> Column:
    return F.split(one_space(c), " ")


def letter_words(c: Column) -> Column:
    """Runs of ASCII letters, lower case, joined by blanks."""
    return F.array_join(F.regexp_extract_all(F.lower(c), F.lit("[a-z]+"), F.lit(0)), " ")


def consonant_share(c: Column) -> Column:
    """Share of a text's letters that are no vowels; 0 without letters."""
    letters = F.regexp_replace(F.lower(c), r"[^\p{L}]", "")
    return F.coalesce(F.length(F.regexp_replace(letters, "[aeiou]", "")) / F.nullif(F.length(letters), F.lit(0)), F.lit(0.0))


def letter_count(c: Column) -> Column:
    return F.length(F.regexp_replace(c, r"[^\p{L}]", ""))


def plausible_name(name: Column) -> Column:
    """Whether a written name may be a person's: no signs, digits, firms, relations or words of places; not all capitals if
    longer than six characters, no article before it. Null and empty names are none."""
    low = F.lower(name)
    parts = words(name)
    later = F.exists(F.slice(parts, F.lit(2), F.size(parts)), lambda w: F.regexp_replace(F.lower(w), "^[.,]+|[.,]+$", "").isin(*L.NO_NAME_WORDS))
    shouted = (F.length(name) > 6) & name.rlike(r"\p{Lu}") & ~name.rlike(r"\p{Ll}")
    bad = name.rlike(r"[_@#&/]|\p{Nd}") | low.isin(*L.NO_PERSONS, *L.RELATIONS) | shouted | F.lower(parts[0]).isin("the", "new", "old") | later
    alone = (F.size(parts) == 1) & ((F.length(parts[0]) < 2) | low.isin(*L.NO_NAME_WORDS))
    return F.coalesce((F.trim(name) != "") & ~bad & ~alone, F.lit(False))


def usable_edge_name(name: Column) -> Column:
    """A plausible name that isn't the beginning of a letter, a relation, an honorific with one word, or a shop or thing."""
    low = F.lower(name)
    parts = F.split(letter_words(name), " ")
    first = parts[0]
    bad = low.rlike("^(and|with|from|dear) ") | low.isin("mom", "dad", "friends", "friend") | (letter_words(name) == "") | (first.isin(*L.HONORIFICS) & (F.size(parts) <= 2))
    bad = bad | F.arrays_overlap(parts, F.array(*map(F.lit, L.NO_EDGE_WORDS))) | ((F.size(parts) == 2) & first.isin("hello", "dear", "happy"))
    return plausible_name(name) & ~F.coalesce(bad, F.lit(True))


def noise_name(name: Column) -> Column:
    """A name of a public figure, with digits or signs, or with ten letters or more of which over 0.78 are no vowels."""
    low = F.lower(name)
    public = F.lit(False)
    for x in L.PUBLIC_NAMES:
        public = public | F.contains(low, F.lit(x))
    return F.coalesce(public | name.rlike(r"[_@#$]|\p{Nd}") | ((letter_count(name) >= 10) & (consonant_share(name) > 0.78)), F.lit(False))


def owner_like(name: Column, owner: Column) -> Column:
    """Whether a name may be the owner's: the same, their given name alone, or its initial with their family name."""
    a, b = F.lower(one_space(name)), F.lower(one_space(owner))
    given, own = F.split(a, " ")[0], F.split(b, " ")[0]
    last = lambda c: F.when(F.size(F.split(c, " ")) >= 2, F.regexp_replace(F.element_at(F.split(c, " "), -1), r"^\.+|\.+$", "")).otherwise("")
    initial = (last(a) == last(b)) & (F.length(given) <= 2) & own.startswith(F.regexp_replace(given, r"\.", ""))
    like = (a == b) | ((given == own) & ~is_full_name(a)) | initial
    return F.coalesce((a != "") & (b != "") & like, F.lit(False))


def noisy_texts(name: Column, texts: Column) -> Column:
    """Visible texts other than the name that look misread: five letters or more, all capitals or few vowels."""
    shouted = lambda t: t.rlike(r"\p{Lu}") & ~t.rlike(r"\p{Ll}")
    odd = lambda t: (F.trim(t) != name) & (letter_count(t) >= 5) & (shouted(t) | (consonant_share(t) > 0.72))
    return F.size(F.filter(F.coalesce(texts, F.array().cast("array<string>")), lambda t: F.coalesce(odd(t), F.lit(False))))


def misread_name(name: Column, source: Column, caption: Column, texts: Column, has_relation: Column, has_face: Column) -> Column:
    """Whether a name read off a photo with faces is left out: it shows no text artifact, names no relation, and has few
    texts or a misread one."""
    artifact = has_relation
    for t in L.TEXT_ARTIFACTS:
        artifact = artifact | F.contains(F.lower(F.coalesce(caption, F.lit(""))), F.lit(t))
    few = F.coalesce(F.size(F.filter(texts, lambda t: F.trim(t) != "")), F.lit(0)) <= 4
    return (F.lower(F.coalesce(source, F.lit(""))) == "visible_text") & has_face & ~artifact & (few | (noisy_texts(name, texts) >= 1))


def names_in(text: Column, name: Column) -> Column:
    """Whether a text has a name, or its first word, at word borders; regardless of case."""
    low, full = F.concat(F.lit(" "), F.regexp_replace(F.lower(one_space(text)), "[^a-z0-9_]+", " "), F.lit(" ")), F.trim(F.regexp_replace(F.lower(one_space(name)), "[^a-z0-9_]+", " "))
    has = lambda x: (x != "") & F.contains(low, F.concat(F.lit(" "), x, F.lit(" ")))
    return F.coalesce(has(full) | has(F.split(full, " ")[0]), F.lit(False))


def direct_anchor(n_same: Column) -> Column:
    return F.coalesce(n_same > 0, F.lit(False))


def strong_anchor(n_same: Column, weight: Column) -> Column:
    """A shared photo with a weight of 0.45 or more."""
    return F.coalesce((n_same > 0) & (weight >= 0.45), F.lit(False))


def over_broad(bridges: Column, weight: Column) -> Column:
    """A candidate that 60 bridges or more and no strong photo speak for."""
    return F.coalesce((bridges >= 60) & (F.coalesce(weight, F.lit(0.0)) < 0.45), F.lit(False))
