"""Scalar text functions as JVM expressions. White space is ASCII white space throughout."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words that a keyword query does not count.
STOP_WORDS = ("the", "and", "for", "with", "from", "this", "that")
#: Categories written in other ways.
CATEGORY_NAMES = {"coworker": "colleague", "co-worker": "colleague", "work colleague": "colleague", "relative": "family", "partner": "family", "spouse": "family"}


def _accents() -> tuple[str, str]:
    """Latin letters that decompose into an ASCII letter and marks, and those letters."""
    pairs = [(chr(c), unicodedata.normalize("NFKD", chr(c))[0]) for r in (range(0xC0, 0x250), range(0x1E00, 0x1F00)) for c in r]
    pairs = [(a, b) for a, b in pairs if b != a and b.isascii() and b.isalpha() and len([x for x in unicodedata.normalize("NFKD", a) if not unicodedata.combining(x)]) == 1]
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


ACCENTED, BARE = _accents()


def one_space(c: Column) -> Column:
    """White space runs as single blanks, none at the ends; null stays null."""
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def fold(c: Column) -> Column:
    """Lower case ASCII words of a text, accents taken off, everything else a single blank."""
    return F.trim(F.regexp_replace(F.lower(F.translate(c, ACCENTED, BARE)), "[^a-z0-9]+", " "))


def first_token(c: Column) -> Column:
    """First word of the folded text, '' if there is none."""
    return F.split(fold(c), " ")[0]


def query_terms(c: Column) -> Column:
    """Distinct words of three or more characters that begin with a letter, lower case, without stop words."""
    words = F.transform(F.regexp_extract_all(c, F.lit("[A-Za-z][A-Za-z0-9_-]{2,}"), F.lit(0)), F.lower)
    return F.array_except(words, F.array(*map(F.lit, STOP_WORDS)))


def first_words(c: Column, n: int) -> Column:
    """A text of more than n words cut after n, without a comma, colon or semicolon at its end, and closed with a stop."""
    words = F.split(one_space(c), " ")
    cut = F.concat(F.regexp_replace(F.concat_ws(" ", F.slice(words, 1, n)), "[ ,;:]+$", ""), F.lit("."))
    return F.when(F.size(words) > n, cut).otherwise(c)


def shorten(c: Column, n: int) -> Column:
    """At most n characters, the last three of a longer text being dots."""
    text = one_space(c)
    return F.when(F.length(text) <= n, text).otherwise(F.concat(F.rtrim(F.substring(text, 1, n - 3)), F.lit("...")))


def strip_signs(c: Column, n: int = 80) -> Column:
    return F.substring(F.regexp_replace(one_space(c), r"^[ ,.;:\-]+|[ ,.;:\-]+$", ""), 1, n)


def clean_relation(c: Column) -> Column:
    return strip_signs(F.lower(c))


def clean_category(c: Column) -> Column:
    text = clean_relation(c)
    names = F.create_map(*[F.lit(x) for kv in CATEGORY_NAMES.items() for x in kv])
    return F.coalesce(names[text], text)


def clean_sentence(c: Column) -> Column:
    text = F.regexp_replace(one_space(c), r"^[ \-]+|[ \-]+$", "")
    return F.substring(F.when(text == "", text).when(text.rlike("[.!?]$"), text).otherwise(F.concat(text, F.lit("."))), 1, 260)


def contact_kinds(c: Column) -> dict[str, Column]:
    """Whether a text holds an e-mail address, a telephone number, a street address (ASCII word borders)."""
    low = F.lower(c)
    return {
        "email": low.rlike(r"[a-z0-9_.+-]+@[a-z0-9_.-]+\.[a-z]{2,}"),
        "phone": low.rlike(r"(^|[^a-z0-9_])[0-9]{3}[-. \t\n][0-9]{3}[-. \t\n][0-9]{4}($|[^a-z0-9_])"),
        "street": low.rlike(r"(^|[^a-z0-9_])[0-9]{1,5}[ \t\n]+[a-z0-9 .'-]+[ \t\n]+(street|st|road|rd|avenue|ave|drive|dr|lane|ln|apartment|apt)($|[^a-z0-9_])"),
    }


def unit_interval(c: Column) -> Column:
    """A number in 0..1 from the first 12 hexadecimal digits of a SHA-256: the same on every run and engine."""
    return F.conv(F.substring(F.sha2(c, 256), 1, 12), 16, 10).cast("double") / F.lit(float(16**12))


def stable_integer(c: Column, modulo: int) -> Column:
    return (F.conv(F.substring(F.sha2(c, 256), 1, 8), 16, 10).cast("long") % modulo).cast("long")


def bounded(c: Column, fallback: float) -> Column:
    """A number within 0..1 to three digits; what is no number counts as the fallback."""
    x = F.coalesce(c.try_cast("double"), F.lit(fallback))
    return F.round(F.least(F.greatest(F.when(F.isnan(x), F.lit(fallback)).otherwise(x), F.lit(0.0)), F.lit(1.0)), 3)


def json_field(c: Column, field: str) -> Column:
    """A field of the JSON object in a noisy text: of the text itself, else of its first flat object in braces."""
    return F.coalesce(F.get_json_object(c, f"$.{field}"), F.get_json_object(F.regexp_extract(c, r"\{[^{}]*\}", 0), f"$.{field}"))


def photo_ids_in(c: Column) -> Column:
    """Photo ids cited in a text, as photo_ and five digits, distinct, sorted."""
    digits = F.regexp_extract_all(F.lower(c), F.lit("photo[_ -]?([0-9]{1,5})"), F.lit(1))
    return F.array_sort(F.array_distinct(F.transform(digits, lambda d: F.concat(F.lit("photo_"), F.lpad(d, 5, "0")))))


def is_full_name(c: Column) -> Column:
    """Two or more words."""
    return F.size(F.split(one_space(c), " ")) >= 2
