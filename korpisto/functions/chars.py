"""Character, case and string scalars as column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Character classes of the analyser, as regular expression class bodies.
LETTER = "A-Za-zÁ-ÖØ-öø-ʯЀ-ҁҊ-ԧ᐀-ᗃﬀ-ﬄ"
DIGIT = "0-9"
SPACE = "\t-\r \u0085  ᠎ -     　"
PUNCTUATION = ".,;\\-!?:'()\\[\\]{}/&\"­»‐‑–—’“”…"
VOWELS = "aeiouyäö"
CONSONANTS = "bcdfghjklmnpqrstvwxzšž"
BACK_VOWELS = "aouAOU"
FRONT_VOWELS = "äöyÄÖY"
SPLIT_VOWELS = ("ae", "ao", "ea", "eo", "ia", "io", "oa", "oe", "ua", "ue", "ye", "eä", "eö", "iä", "iö", "yä", "äe", "öe")
# End of fixed values.


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` evaluated once a row."""
    return F.element_at(F.transform(F.array(value), body), 1)


def characters(s: Column) -> Column:
    return F.filter(F.split(s, ""), lambda c: c != "")


def per_character(s: Column, f: Callable[[Column], Column]) -> Column:
    return F.array_join(F.transform(characters(s), f), "")


def simple_lower(s: Column) -> Column:
    """Lower case character by character, each giving the first of its mapping; lengths stay."""
    return F.when(s.rlike("[İΣ]"), per_character(s, lambda c: F.substring(F.lower(c), 1, 1))).otherwise(F.lower(s))


def simple_upper(s: Column) -> Column:
    return F.when(F.length(F.upper(s)) != F.length(s), per_character(s, lambda c: F.substring(F.upper(c), 1, 1))).otherwise(F.upper(s))


def char_type(c: Column) -> Column:
    """LETTER, WHITESPACE, PUNCTUATION, DIGIT or UNKNOWN of a one-character string; tested in this order."""
    return (
        F.when(c.rlike(f"^[{LETTER}]"), "LETTER").when(c.rlike(f"^[{SPACE}]"), "WHITESPACE")
        .when(c.rlike(f"^[{PUNCTUATION}]"), "PUNCTUATION").when(c.rlike(f"^[{DIGIT}]"), "DIGIT").otherwise("UNKNOWN")
    )


def is_upper(c: Column) -> Column:
    return (c != simple_lower(c)) | (c == "Ə")


def is_lower(c: Column) -> Column:
    return c != simple_upper(c)


def is_vowel(c: Column) -> Column:
    return simple_lower(c).rlike(f"^[{VOWELS}]$")


def equals_ignore_case(a: Column, b: Column) -> Column:
    return simple_lower(a) == simple_lower(b)


def case_type(word: Column) -> Column:
    """NO_LETTERS, ALL_LOWER, FIRST_UPPER, COMPLEX or ALL_UPPER.

    A word without lower-case letters is ALL_UPPER, even of one letter.
    """
    low, up = simple_lower(word), simple_upper(word)
    any_upper = (word != low) | word.contains("Ə")
    any_lower = word != up
    rest = F.substring(word, F.lit(2), F.length(word))
    rest_upper = (rest != simple_lower(rest)) | rest.contains("Ə")
    first = F.substring(word, 1, 1)
    return (
        F.when(~any_upper & ~any_lower, "NO_LETTERS").when(~any_lower, "ALL_UPPER")
        .when(rest_upper, "COMPLEX").when(is_upper(first), "FIRST_UPPER").otherwise("ALL_LOWER")
    )


def set_case(word: Column, case: Column) -> Column:
    """The word in a case type; NO_LETTERS and COMPLEX leave it."""
    first_upper = F.concat(simple_upper(F.substring(word, 1, 1)), simple_lower(F.substring(word, F.lit(2), F.length(word))))
    return F.when(case == "ALL_LOWER", simple_lower(word)).when(case == "ALL_UPPER", simple_upper(word)).when(case == "FIRST_UPPER", first_upper).otherwise(word)


def as_bytes(s: Column) -> Column:
    """One character for each UTF-8 byte, so that character functions count bytes."""
    return F.decode(F.encode(s, "UTF-8"), "ISO-8859-1")


def byte_levenshtein(a: Column, b: Column, threshold: int | None = None) -> Column:
    """Edit distance over UTF-8 bytes; -1 beyond the threshold, if given."""
    return F.levenshtein(as_bytes(a), as_bytes(b)) if threshold is None else F.levenshtein(as_bytes(a), as_bytes(b), threshold)


def compressed_shape(word: Column) -> Column:
    """X, x, d or the character itself for the first 20 characters, runs collapsed."""
    shape = F.regexp_replace(F.substring(word, 1, 20), "\\p{IsUppercase}", "X")
    shape = F.regexp_replace(shape, "(?!X)\\p{IsLowercase}", "x")
    return F.regexp_replace(F.regexp_replace(shape, "[0-9]", "d"), "(?s)(.)\\1+", "$1")
